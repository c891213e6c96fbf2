"""A run: resolved rules over frames, then caps, order and summary as plans."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.model import ARTIFACT_REF, LOCATION, SEVERITIES, Frames
from plumbline.plans.rules import Plugin, Rule, RowRule, catalogue
from plumbline.shared import written

LOG = logging.getLogger(__name__)

# The defaults of the global options.
DEFAULTS = {"timeout": 30_000, "maxDetails": 100, "maxDiagnostics": 1_000}
NO_PROVIDER, LOAD_FAILED, RULE_ERROR, TRUNCATED = "artifact/no-provider", "artifact/load-failed", "engine/rule-error", "engine/max-diagnostics"


@dataclass(frozen=True)
class Setting:
    """What holds for a rule on some sources; severity ``off`` switches it off."""

    severity: str
    options: Any = None

    @staticmethod
    def of(entry: str | list | tuple) -> Setting:
        return Setting(entry) if isinstance(entry, str) else Setting(entry[0], entry[1])


@dataclass(frozen=True)
class Resolved:
    """Rules in run order, each with its base setting and what each override says of it."""

    rules: tuple[Rule | RowRule, ...]
    base: dict[str, Setting]
    overrides: tuple[tuple[tuple[str, ...], dict[str, Setting]], ...]
    options: dict[str, Any]


def glob_regex(pattern: str) -> str:
    """Regular expression of a path glob: ``**/`` folders, ``**`` anything, ``*`` and ``?`` within a folder."""
    pattern = pattern.replace("\\", "/").removeprefix("./")
    out = ""
    for token in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token) or re.escape(token)
    return f"^{out}$"


def normal_path(source: Column) -> Column:
    """Forward slashes, no leading ``./``."""
    return F.regexp_replace(F.replace(source, F.lit("\\"), F.lit("/")), r"^\./", "")


def resolve(rules: Iterable[Rule | RowRule], config: dict | None = None) -> Resolved:
    """Severities and options of a run. Ids in the configuration that no rule has are passed over.

    Recommended rules are on with their own severity. Rules that only an override switches on come
    last in run order.
    """
    config = config or {}
    known = catalogue(rules)
    base = {i: Setting(r.severity if r.recommended else "off") for i, r in known.items()}
    base |= {i: Setting.of(e) for i, e in (config.get("rules") or {}).items() if i in known}
    overrides = tuple(
        (tuple(glob_regex(f) for f in o.get("files", [])), {i: Setting.of(e) for i, e in (o.get("rules") or {}).items() if i in known})
        for o in config.get("overrides") or []
    )
    on = [i for i in known if base[i].severity != "off"]
    late = [i for _, settings in overrides for i, s in settings.items() if i not in on and s.severity != "off"]
    order = [*on, *dict.fromkeys(late)]
    return Resolved(tuple(known[i] for i in order), base, overrides, DEFAULTS | (config.get("options") or {}))


def setting_of(resolved: Resolved, rule_id: str, source: Column) -> tuple[Column, list[Setting]]:
    """Number of the setting that holds for a source, and the settings. The last matching override wins."""
    settings = [resolved.base[rule_id]]
    chosen = F.lit(0)
    for patterns, entries in resolved.overrides:
        if rule_id in entries and patterns:
            settings.append(entries[rule_id])
            fits = reduce(lambda a, b: a | b, [normal_path(source).rlike(p) for p in patterns])
            chosen = F.when(fits, F.lit(len(settings) - 1)).otherwise(chosen)
    return chosen, settings


def _ref() -> Column:
    return F.struct(F.col("artifact_type").alias("type"), F.col("source"), F.lit(None).cast("string").alias("label")).cast(ARTIFACT_REF)


def infrastructure(artifacts: DataFrame) -> DataFrame:
    """Diagnostics of sources without a provider and of failed loads."""
    lost = artifacts.where(F.col("artifact_type") == "unknown").withColumn("ruleId", F.lit(NO_PROVIDER)).withColumn("message", F.concat(F.lit("No provider for "), "source"))
    failed = artifacts.where((F.col("artifact_type") != "unknown") & F.col("load_error").isNotNull() & ~F.col("artifact_type").startswith("Invalid"))
    failed = failed.withColumn("ruleId", F.lit(LOAD_FAILED)).withColumn("message", F.concat(F.lit("Could not load: "), "load_error"))
    rows = lost.unionByName(failed)
    none = F.lit(None).cast("string")
    return rows.select(
        "source_idx", F.lit(-1).alias("rule_idx"), F.array(F.lit(0).cast("long")).alias("emit_seq"), "ruleId", F.lit("error").alias("severity"), "message",
        F.lit(None).cast(LOCATION).alias("location"), none.alias("suggestion"), none.alias("docsUrl"), none.alias("data"),
    )


def loaded(artifacts: DataFrame) -> DataFrame:
    """Artifacts that rules see: loaded ones, and styles that failed to parse."""
    return artifacts.where((F.col("artifact_type") != "unknown") & (F.col("load_error").isNull() | F.col("artifact_type").startswith("Invalid")))


def rule_diagnostics(frames: Frames, resolved: Resolved) -> list[DataFrame]:
    """One plan for each rule and distinct setting that can hold; disabled branches are not built."""
    return [plan for _, plans in rule_plans(frames, resolved) for plan in plans]


def rule_plans(frames: Frames, resolved: Resolved) -> Iterator[tuple[int, list[DataFrame]]]:
    """The number of each rule that has plans, and those."""
    frames = frames.complete()
    for number, rule in enumerate(resolved.rules):
        out = []
        chosen, settings = setting_of(resolved, rule.id, F.col("source"))
        for k, setting in enumerate(settings):
            if setting.severity == "off":
                continue
            usable = loaded(frames.artifacts).where(F.col("artifact_type").isin(*rule.artifact_types))
            one = Frames(usable, frames.layers, frames.features, frames.styles, frames.style_layers, frames.texts)
            if len(settings) > 1:
                one = one.only(chosen == k)
            found = rule.build(one, dict(setting.options or {}))
            if found is None:
                continue
            crashed = F.col("crashed") if "crashed" in found.columns else F.lit(False)
            out.append(found.select(
                "source_idx", F.lit(number).alias("rule_idx"), "emit_seq", F.when(crashed, F.lit(RULE_ERROR)).otherwise(F.lit(rule.id)).alias("ruleId"),
                F.when(crashed, F.lit("error")).otherwise(F.lit(setting.severity)).alias("severity"), "message", "location", "suggestion",
                F.when(~crashed, F.lit(rule.docs_url)).alias("docsUrl"), "data",
            ))
        if out:
            yield number, out


def with_artifact(diagnostics: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Diagnostics with the reference to their artifact; best after the caps, which need none."""
    joined = diagnostics.join(artifacts.select("source_idx", _ref().alias("artifact")), "source_idx")
    at = diagnostics.columns.index("message") + 1
    return joined.select(*diagnostics.columns[:at], "artifact", *diagnostics.columns[at:])


def cap_details(diagnostics: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of each artifact and rule, in order of emission; crashes are not counted out."""
    order = Window.partitionBy("source_idx", "rule_idx").orderBy("emit_seq")
    return diagnostics.withColumn("_n", F.row_number().over(order)).where((F.col("_n") <= limit) | (F.col("ruleId") == RULE_ERROR)).drop("_n")


EMISSION = ("source_idx", "rule_idx", "emit_seq")


def cap_total(diagnostics: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of the run, the last of them replaced by a notice; fewer rows stay as they are.

    Only ``limit`` rows are ordered as a whole (a top-k, then a window over those).
    """
    if limit <= 0:
        return diagnostics.limit(0)
    first = diagnostics.orderBy(*EMISSION).limit(limit).withColumn("_n", F.row_number().over(Window.orderBy(*EMISSION)))
    notice = F.col("_n") == limit
    none = F.lit(None).cast("string")
    swap = {
        "ruleId": F.lit(TRUNCATED), "severity": F.lit("warning"), "message": F.lit(f"Stopped at the limit of {limit} diagnostics."),
        "location": F.lit(None).cast(LOCATION), "suggestion": F.lit("Raise maxDiagnostics to see more."), "docsUrl": none, "data": none,
    }
    return first.withColumns({c: F.when(notice, v).otherwise(F.col(c)) for c, v in swap.items()}).drop("_n")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def sort_keys() -> list[Column]:
    """Source, severity, rule, then layer, feature and part (missing ones first), then emission."""
    return [
        F.col("artifact.source"), severity_rank(F.col("severity")), F.col("ruleId"), F.coalesce("location.layer", F.lit("")),
        F.coalesce("location.featureIndex", F.lit(0)), F.coalesce("location.partIndex", F.lit(0)), *[F.col(c) for c in EMISSION],
    ]


def sort_diagnostics(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.orderBy(*sort_keys())


def executions(frames: Frames, resolved: Resolved) -> DataFrame:
    """``(source_idx, rule_idx)`` of every rule that a run starts on an artifact."""
    pairs = []
    for number, rule in enumerate(resolved.rules):
        chosen, settings = setting_of(resolved, rule.id, F.col("source"))
        on = [k for k, s in enumerate(settings) if s.severity != "off"]
        rows = loaded(frames.artifacts).where(F.col("artifact_type").isin(*rule.artifact_types) & chosen.isin(*on))
        pairs.append(rows.select("source_idx", F.lit(number).alias("rule_idx")))
    return reduce(DataFrame.unionByName, pairs)


def summarize(diagnostics: DataFrame, artifacts: DataFrame, started: DataFrame, sources: int | None = None) -> DataFrame:
    """One row: counts by severity, sources, artifacts, rule executions, ``truncated`` and ``pass``.

    A truncated run counts the executions up to the row at which it stopped and the artifacts up to that row's
    source, and passes if the rows that were kept hold no error. ``sources`` is their number where ``artifacts`` lacks some.
    """
    counts = diagnostics.agg(
        *[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in SEVERITIES], F.coalesce(F.bool_or(F.col("ruleId") == TRUNCATED), F.lit(False)).alias("truncated"),
        F.max(F.when(F.col("ruleId") == TRUNCATED, F.struct("source_idx", "rule_idx"))).alias("stop"),
    )
    good = (F.col("artifact_type") != "unknown") & (F.col("load_error").isNull() | F.col("artifact_type").startswith("Invalid"))
    reached = F.col("stop").isNull() | (F.col("source_idx") <= F.col("stop.source_idx"))
    given = artifacts.join(F.broadcast(counts.select("stop")), F.lit(True), "left").agg(F.count(F.lit(1)).alias("sourceCount"), F.count_if(good & reached).alias("artifactCount"))
    given = given if sources is None else given.withColumn("sourceCount", F.lit(sources).cast("long"))
    # The counts are one row, so these joins pair one row with one row or with each execution once.
    ran = started.join(F.broadcast(counts.select("stop")), F.col("stop").isNull() | (F.struct("source_idx", "rule_idx") <= F.col("stop")), "inner").agg(F.count(F.lit(1)).alias("ruleExecutions"))
    return counts.drop("stop").join(given, F.lit(True)).join(ran, F.lit(True)).withColumn("pass", F.col("errors") == 0)


@dataclass(frozen=True)
class RunResult:
    diagnostics: DataFrame
    summary: DataFrame


class Engine:
    """Immutable: plugins and configuration; :meth:`run` may be called again and again."""

    def __init__(self, plugins: Iterable[Plugin], config: dict | None = None) -> None:
        self.plugins = tuple(plugins)
        self.resolved = resolve([r for p in self.plugins for r in p.rules], config)

    def run(self, frames: Frames, reporter: Callable[[RunResult], object] | None = None, isolate: bool = False) -> RunResult:
        """Diagnostics in report order and the summary row; rules are evaluated once for both.

        The capped rows (``maxDiagnostics`` of them at most) are persisted. An error of ``reporter`` is logged
        and does not touch the result. With ``isolate`` each rule's rows are written by a job of its own: a rule
        whose plan fails is an error on every artifact that it was started on, and the next rule runs.
        """
        frames = self._settled(frames) if isolate else frames
        result = self._run(frames, isolate)
        if reporter is not None:
            try:
                reporter(result)
            except Exception:  # a reporter that fails does not decide the run
                LOG.exception("the reporter failed")
        return result

    def _settled(self, frames: Frames) -> Frames:
        """The frames with their artifacts written, as every rule's job reads them."""
        return replace(frames, artifacts=written(frames.artifacts, "artifacts"))

    def _isolated(self, frames: Frames) -> DataFrame:
        """The rows of :meth:`_capped`, each rule's from a job of its own."""
        found, started = [infrastructure(frames.artifacts)], executions(frames, self.resolved)
        for number, parts in rule_plans(frames, self.resolved):
            try:
                found.append(written(cap_details(reduce(DataFrame.unionByName, parts), self.resolved.options["maxDetails"]), "rule"))
            except Exception as error:  # noqa: BLE001 - any failure of a rule's plan is data
                none, text = F.lit(None).cast("string"), str(error).split("\n", 1)[0][:500]
                rows = started.where(F.col("rule_idx") == number)
                found.append(rows.select(
                    "source_idx", "rule_idx", F.array(F.lit(0).cast("long")).alias("emit_seq"), F.lit(RULE_ERROR).alias("ruleId"), F.lit("error").alias("severity"),
                    F.lit(f"Rule {self.resolved.rules[number].id} failed: {text}").alias("message"), F.lit(None).cast(LOCATION).alias("location"), none.alias("suggestion"), none.alias("docsUrl"), none.alias("data"),
                ))
        return reduce(DataFrame.unionByName, found)

    def _run(self, frames: Frames, isolate: bool = False) -> RunResult:
        kept = with_artifact(cap_total(self._isolated(frames) if isolate else self._capped(frames), self.resolved.options["maxDiagnostics"]), frames.artifacts).persist()
        return RunResult(sort_diagnostics(kept), summarize(kept, frames.artifacts, executions(frames, self.resolved)))

    def _capped(self, frames: Frames) -> DataFrame:
        """Findings on some frames, ``maxDetails`` for each artifact and rule."""
        parts = rule_diagnostics(frames, self.resolved)
        return reduce(DataFrame.unionByName, [infrastructure(frames.artifacts), *([cap_details(reduce(DataFrame.unionByName, parts), self.resolved.options["maxDetails"])] if parts else [])])

    def run_until(self, raw: DataFrame, load: Callable[[DataFrame], Frames], first: int = 256, listed: DataFrame | None = None) -> RunResult:
        """The same result as :meth:`run` over ``load(raw)``, without loading sources beyond the limit of diagnostics.

        ``raw`` has ``source_idx`` and what ``load`` takes; ``listed`` holds the same ``source_idx`` where they can be
        read without making ``raw``. Sources are taken in slices of their order, each as
        long as all before it; the run ends with the slice that fills ``maxDiagnostics``. Each slice's
        findings, artifacts and executions are written once, so no source is loaded twice.
        """
        limit = self.resolved.options["maxDiagnostics"]
        bounds = (raw if listed is None else listed).agg(F.count(F.lit(1)).alias("n"), F.min("source_idx").alias("low"), F.max("source_idx").alias("high")).first()
        slices, held, low, size = [], 0, bounds.low, first
        while low is not None and low <= bounds.high and (held < limit or not slices):
            frames = load(raw.where(F.col("source_idx").between(low, low + size - 1)))
            slices.append([written(df, "slice") for df in (self._capped(frames), frames.artifacts, executions(frames, self.resolved))])
            held += slices[-1][0].count()
            low, size = low + size, size + low - bounds.low
        if not slices:
            return self._run(load(raw))
        found, artifacts, started = (reduce(DataFrame.unionByName, dfs) for dfs in zip(*slices, strict=True))
        kept = with_artifact(cap_total(found, limit), artifacts).persist()
        return RunResult(sort_diagnostics(kept), summarize(kept, artifacts, started, bounds.n))
