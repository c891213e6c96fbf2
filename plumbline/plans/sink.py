"""A report as one file from many tasks: a data source whose writers leave parts and whose commit joins them.

``diagnostics`` go in order, so each task holds a stretch of the report; it writes that as a part beside the
target and tells the driver only the part's name and counts. The commit puts header, parts and totals together
in a new file and moves it to its name in one step; without a commit nothing is left, neither file nor parts.
The folder of the target must be one that driver and executors share.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from plumbline.model import SEVERITIES
from plumbline.plans.engine import RunResult, sort_diagnostics

FORMAT = "plumbline_report"
ROWS = "value string, severity string, source string"
#: Bytes that the commit copies at a time.
COPY = 1 << 20


@dataclass
class Part(WriterCommitMessage):
    """What a task tells: where its part is in the order, its name, rows by severity, and sources at both ends."""

    number: int
    name: str
    counts: dict[str, int]
    first: str | None
    last: str | None
    sources: int


class JsonLayout:
    """``{"diagnostics": [...], "summary": {...}}``, a diagnostic a line."""

    def begin(self, row: Row, last: str | None, first_row: bool) -> str:
        return row.value if first_row else ",\n" + row.value

    def between(self) -> str:
        return ",\n"

    def head(self) -> str:
        return '{"diagnostics": [\n'

    def foot(self, summary: dict) -> str:
        return '\n],\n"summary": ' + json.dumps(summary) + "}\n"


class TextLayout:
    """Diagnostics under the name of their source, then a line of totals."""

    def begin(self, row: Row, last: str | None, first_row: bool) -> str:
        return f"{row.source}\n  {row.value}\n" if row.source != last else f"  {row.value}\n"

    def between(self) -> str:
        return ""

    def head(self) -> str:
        return ""

    def foot(self, summary: dict) -> str:
        return ("passed" if summary["pass"] else "failed") + ": " + ", ".join(f"{summary[s + 's']} {s}{'' if summary[s + 's'] == 1 else 's'}" for s in SEVERITIES) + "\n"


LAYOUTS = {"json": JsonLayout, "text": TextLayout}


class ReportWriter(DataSourceWriter):
    def __init__(self, path: str, layout: str, summary: dict, overwrite: bool) -> None:
        self.path, self.layout, self.summary, self.overwrite = path, layout, summary, overwrite
        self.parts = os.path.join(os.path.dirname(os.path.abspath(path)), f".{os.path.basename(path)}-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[Row]) -> Part:
        os.makedirs(self.parts, exist_ok=True)
        number, layout = TaskContext.get().partitionId(), LAYOUTS[self.layout]()
        name = os.path.join(self.parts, f"{number:08d}-{uuid.uuid4().hex}")
        part = Part(number, name, dict.fromkeys(SEVERITIES, 0), None, None, 0)
        with open(name, "w", encoding="utf-8") as out:
            for row in iterator:
                new = sum(part.counts.values()) == 0
                out.write(layout.begin(row, part.last, new))
                part.counts[row.severity] += 1
                part.sources += new or row.source != part.last
                part.first, part.last = row.source if new else part.first, row.source
        return part

    def commit(self, messages: list[Part]) -> None:
        layout, target = LAYOUTS[self.layout](), f"{self.parts}.whole"
        try:
            if not self.overwrite and os.path.exists(self.path):
                raise FileExistsError(self.path)
            found = [m for m in sorted(messages, key=lambda m: m.number) if sum(m.counts.values())]
            counts = {f"{s}s": sum(m.counts[s] for m in found) for s in SEVERITIES}
            with open(target, "w", encoding="utf-8") as out:
                out.write(layout.head())
                for k, part in enumerate(found):
                    with open(part.name, encoding="utf-8") as own:
                        if k:
                            out.write(layout.between())
                            if self.layout == "text" and part.first == found[k - 1].last:
                                own.readline()  # the source's name stands there already
                        shutil.copyfileobj(own, out, COPY)
                out.write(layout.foot(counts | self.summary))
            os.replace(target, self.path)
        finally:
            self._clear(target)

    def abort(self, messages: list[Part | None]) -> None:
        self._clear(f"{self.parts}.whole")

    def _clear(self, *files: str) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)
        for name in files:
            if os.path.exists(name):
                os.unlink(name)


class ReportSink(DataSource):
    """``df.write.format("plumbline_report").option("path", ...)``; options ``layout`` (json or text) and ``summary`` (JSON)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        layout = self.options.get("layout", "json")
        if layout not in LAYOUTS or schema.fieldNames() != ["value", "severity", "source"]:
            raise ValueError(f"a report has rows of {ROWS} and one of the layouts {', '.join(LAYOUTS)}")
        return ReportWriter(self.options["path"], layout, json.loads(self.options.get("summary", '{"pass": true}')), overwrite)


def report_rows(diagnostics: DataFrame, layout: str = "json") -> DataFrame:
    """The sink's rows of diagnostics that carry their artifact, in their order. Members that are null are left out."""
    names = ["ruleId", "severity", "message", "artifact", "location", "suggestion", "docsUrl"]
    whole = F.to_json(F.struct(*names, F.try_parse_json("data").alias("data")))
    return diagnostics.select((whole if layout == "json" else F.concat_ws("  ", "severity", "ruleId", "message")).alias("value"), "severity", F.col("artifact.source").alias("source"))


def save_report(result: RunResult, path: str, layout: str = "json", seconds: float = 0.0, overwrite: bool = True) -> None:
    """Write a run's report; rows go from the tasks to the file's parts, and only the summary's one row to the driver."""
    spark: SparkSession = result.diagnostics.sparkSession
    spark.dataSource.register(ReportSink)
    row = result.summary.first()
    names = {"truncated": "truncated", "sources": "sourceCount", "artifacts": "artifactCount", "rules": "ruleExecutions", "pass": "pass"}
    summary = {k: row[v] for k, v in names.items()} | {"duration": round(seconds * 1000)}
    rows = report_rows(sort_diagnostics(result.diagnostics), layout)
    rows.write.format(FORMAT).option("path", path).option("layout", layout).option("summary", json.dumps(summary)).mode("overwrite" if overwrite else "append").save()
