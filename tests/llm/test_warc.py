"""WARC: exact round trips, magic inside payloads, broken tails."""

from __future__ import annotations

from hashlib import sha1
from pathlib import Path

import pytest

from plumbline.llm import warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nWARC-Payload-Digest: sha1:0\r\nWARC-Payload-Length: 3\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
SCHEMA = "page_id long, url string, html string, digest string"


def expected(pages):
    full = [(p, (h or "").encode()) for p, _, h, _ in pages]
    last = {}
    for p, b in full:
        if len(b) >= 1000 and p is not None:
            last[b] = max(p, last.get(b, p))
    return sorted(((p, len(b), sha1(b).hexdigest(), "revisit" if b in last and p != last[b] else "response", last[b] if b in last and p != last[b] else None) for p, b in full), key=str)


def plain(found):
    assert all(r["body_ok"] == (True if r["record_type"] == "response" else None) for r in found)
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=str)


@pytest.mark.parametrize("block", ["128m", "700"])
def test_round_trip_with_magic_in_payloads(spark, rows, block):
    """With one block for each file, and with blocks far shorter than a record."""
    page = "<p>é</p>\r\n\r\n" * 120
    pages = [
        (1, "http://a/1", page, "x"), (2, "http://a/2", page, "x"), (3, None, None, "x"), (4, "u", "", "x"), (5, "u", FAKE, "x"), (6, "u", FAKE * 30, "x"), (7, "u", FAKE * 30, "x"),
        (8, "u\r\nWARC-Type: x", "\r\n\r\n", "x"), (9, "u", "x" * 999, "x"), (10, "u", "x" * 999, "x"), (11, "u", page, "x"), (11, "u", page, "x"), (12, "u", "WARC/1.1\r\n", "x"),
        (13, "u", "y" * 20_000 + FAKE + "z", "x"), *[(100 + i, "u", f"row {i} " * (i % 50), "x") for i in range(200)],
    ]
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = rows(warc.round_trip(spark.createDataFrame(pages, SCHEMA).repartition(3)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert plain(got) == expected(pages)


def test_records_read_by_hand_and_a_broken_tail(spark, rows, tmp_path):
    record = lambda n, body: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Payload-Digest: sha1:{sha1(body.encode()).hexdigest()}\r\nWARC-Payload-Length: {len(body)}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    Path(tmp_path, "a.warc").write_bytes((record(1, "one") + record(2, FAKE) + record(3, "three") + "WARC/1.1\r\nbroken\r\n\r\n" + record(4, "lost")).encode())
    got = rows(warc.page_records(warc.read_warc(spark, str(tmp_path))))
    assert sorted(r["page_id"] for r in got) == [1, 2, 3] and all(r["body_ok"] for r in got)


def test_a_wrong_digest_is_noticed(spark, rows, tmp_path):
    body = FAKE.replace("abc", "xyz")
    Path(tmp_path, "a.warc").write_bytes(body.encode())
    assert [(r["page_id"], r["body_ok"]) for r in rows(warc.page_records(warc.read_warc(spark, str(tmp_path))))] == [(999, False)]


def test_odd_rows(spark, rows):
    pages = spark.createDataFrame([(None, None, None, "d"), (None, "u", "x" * 2000, "d"), (5, "u", "x" * 2000, "d")], SCHEMA)
    got = rows(warc.round_trip(pages))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == [("5", 2000, "response", None), ("None", 0, "response", None), ("None", 2000, "revisit", 5)]
    assert warc.round_trip(pages.limit(0)).count() == 0
