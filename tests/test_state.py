"""Stateful watch: streams in any batches give the rows of the table."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from plumbline.streaming import state

T0 = datetime(2024, 5, 1)
AT = lambda minutes: T0 + timedelta(minutes=minutes)


def observations(spark):
    rows = [("a", 0, 0, "x", 0), ("a", 5, 1, "x", 0), ("a", 5, 2, "y", 2), ("a", 30, 3, "y", 2), ("a", 31, 4, "y", 0), ("a", 60, 5, "z", None), ("b", 2, 6, None, 1), ("b", 3, 7, None, 1), ("b", 4, 8, "q", 0),
            ("c", 100, 9, "x", 0), (None, 1, 10, "x", 0), ("d", 100, 11, "x", 0), ("d", 100, 11, "x", 0)]
    return spark.createDataFrame([(s, AT(m), o, d, e) for s, m, o, d, e in rows] + [("e", None, 12, "x", 0)], state.OBSERVATION)


WANT = [
    ("a", AT(0), "new", "x", True), ("a", AT(5), "changed", "y", False), ("a", AT(15), "stale", "y", False), ("a", AT(30), "back", "y", False), ("a", AT(41), "stale", "y", True), ("a", AT(60), "changed", "z", True),
    ("a", AT(70), "stale", "z", True), ("b", AT(2), "new", None, False), ("b", AT(4), "changed", "q", True), ("b", AT(14), "stale", "q", True), ("c", AT(100), "new", "x", True), ("d", AT(100), "new", "x", True),
]


def test_changes_of_a_table(spark):
    assert sorted(map(tuple, state.changes(observations(spark), 10).collect()), key=str) == sorted(WANT, key=str)
    assert state.changes(observations(spark).limit(0), 10).count() == 0


@pytest.mark.parametrize("cuts", [[], [5, 30, 61]])
def test_any_batches_give_the_same(spark, tmp_path, cuts):
    found = state.replay(observations(spark), str(tmp_path), [AT(m) for m in cuts], 10)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(WANT, key=str)


def test_settings_come_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with state.state_store(spark):
        assert "RocksDB" in spark.conf.get(key)
    assert spark.conf.get(key) == before


def test_a_source_takes_one_look_at_its_state():
    class Fake:
        """State of one source and its timers, with the calls made on them."""

        def __init__(self):
            self.calls, self.value = [], None

        def __getattr__(self, name):
            return lambda *args: self.calls.append(name)

        def getValueState(self, *args):  # noqa: N802 - Spark's name
            return self

        def get(self):
            self.calls.append("get")
            return self.value

    watch, fake = state.SourceWatch(600_000), Fake()
    watch.init(fake)
    row = state.Row(millis=0, ord=0, digest="x", errors=0)
    for value, want in ((None, []), ((0, "x", 0, False), ["deleteTimer"]), ((0, "x", 0, True), [])):
        fake.calls, fake.value = [], value
        list(watch.handleInputRows(("a",), iter([row]), None))
        assert fake.calls == ["get", *want, "registerTimer", "update"]
