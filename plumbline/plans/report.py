"""Sinks of a run: JSON and text reports, and file writers for whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.engine import RunResult, sort_keys

ICONS = {"error": "x", "warning": "!", "info": "i"}
Reporter = Callable[[RunResult, float], str]


def _dropped(value: Any) -> Any:
    """The value without members that are null."""
    return {k: _dropped(v) for k, v in value.items() if v is not None} if isinstance(value, dict) else value


def rows_of(result: RunResult) -> tuple[list[dict], dict]:
    """The capped diagnostics, in report order, and the summary, as plain dicts."""
    found = [r.asDict(recursive=True) for r in result.diagnostics.collect()]
    return found, result.summary.first().asDict()


def json_report(result: RunResult, seconds: float = 0.0) -> str:
    """``{diagnostics, summary}``, optional members left out where they are null."""
    found, summary = rows_of(result)
    shown = []
    for d in found:
        d["data"] = None if d["data"] is None else json.loads(d["data"])
        shown.append(_dropped({k: d[k] for k in ("ruleId", "severity", "message", "artifact", "location", "suggestion", "docsUrl", "data")}))
    total = {
        "errors": summary["errors"], "warnings": summary["warnings"], "infos": summary["infos"], "pass": summary["pass"], "truncated": summary["truncated"],
        "sources": summary["sourceCount"], "artifacts": summary["artifactCount"], "rules": summary["ruleExecutions"], "duration": round(seconds * 1000),
    }
    return json.dumps({"diagnostics": shown, "summary": total}, indent=2, ensure_ascii=False)


def _count(n: int, noun: str) -> str:
    return f"{n} {noun}{'' if n == 1 else 's'}"


def _place(where: dict | None) -> str:
    if not where:
        return ""
    names = (("layer", "layer"), ("featureIndex", "feature"), ("partIndex", "part"), ("jsonPath", "path"), ("line", "line"), ("column", "column"))
    return ", ".join(f"{label} {where[k]}" for k, label in names if where.get(k) is not None)


def text_report(result: RunResult, seconds: float = 0.0) -> str:
    """Diagnostics by source in the order of first occurrence, then the totals."""
    found, summary = rows_of(result)
    by_source: dict[str, list[dict]] = {}
    for d in found:
        by_source.setdefault(d["artifact"]["source"], []).append(d)
    lines: list[str] = []
    for source, rows in by_source.items():
        lines.append(source)
        for d in rows:
            lines.append(f"  {ICONS[d['severity']]} {d['ruleId']}  {d['message']}")
            extra = (("at", _place(d["location"])), ("hint", d["suggestion"]), ("docs", d["docsUrl"]))
            lines += [f"      {k}: {v}" for k, v in extra if v]
        lines.append("")
    totals = ", ".join(_count(summary[f"{s}s"], s) for s in ICONS)
    lines.append(f"{'passed' if summary['pass'] else 'failed'}: {totals} in {_count(summary['sourceCount'], 'source')}, {_count(summary['ruleExecutions'], 'rule execution')}, {seconds * 1000:.0f} ms")
    return "\n".join(lines)


REPORTERS: dict[str, Reporter] = {"text": text_report, "json": json_report}


def find_reporter(name: str | list | tuple | None) -> Reporter:
    """Reporter of a name or a (name, options) pair; text by default, an unknown name is an error."""
    name = "text" if name is None else name if isinstance(name, str) else name[0]
    if name not in REPORTERS:
        raise ValueError(f"unknown reporter {name!r}; known: {', '.join(sorted(REPORTERS))}")
    return REPORTERS[name]


def json_lines(diagnostics: DataFrame) -> DataFrame:
    """One JSON text a row, null members left out; for distributed sinks of any size."""
    data = F.from_json("data", "map<string,string>")
    names = ["ruleId", "severity", "message", "artifact", "location", "suggestion", "docsUrl"]
    return diagnostics.select(F.to_json(F.struct(*names, data.alias("data"))).alias("value"))


def write(df: DataFrame, path: str, kind: str = "json") -> None:
    """Write a table as json, csv, parquet or orc files."""
    writer = df.write.mode("overwrite")
    {"json": writer.json, "csv": lambda p: writer.option("header", True).csv(p), "parquet": writer.parquet, "orc": writer.orc}[kind](path)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small table as Markdown."""
    rows = [[("" if v is None else str(v)).replace("|", "\\|") for v in r] for r in df.limit(limit).collect()]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


__all__ = ["REPORTERS", "find_reporter", "json_lines", "json_report", "markdown", "rows_of", "sort_keys", "text_report", "write"]
