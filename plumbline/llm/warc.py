"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Archives are read as splittable text that is cut at every occurrence of the version line, inside
payloads too. Each piece is a candidate record whose header names its successor's offset. Tasks
follow the chains inside their own block of a file, pointer jumping over the blocks' entries starts
at the file start, and only records that it reaches are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha1

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import checkpoint, shared_dir, write_stage

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are always written in full.
MIN_REVISIT = 1000
#: Groups of equal payloads that may be broadcast (28 bytes each); more are joined by a shuffle.
MAX_BROADCAST_GROUPS = 500_000
#: Width in bytes of the cells in which cut payloads meet their pieces.
SPAN = 1 << 16


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """Append ``payload, n_bytes, digest, refers_to``.

    Among records with equal payloads of at least ``least`` bytes, the rows with the largest id stay
    in full and the others refer to it. Null payloads are empty, null ids count as smallest.
    """
    full = pages.withColumn("payload", F.coalesce(F.col(payload_col), F.lit("")))
    full = full.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    last = full.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.max(id_col).alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null")
    last = write_stage(last.select(F.unhex("digest").alias("_key"), "last"), "warc-groups")
    if last.count() <= MAX_BROADCAST_GROUPS:  # payloads stay where they are
        last = F.broadcast(last)
    full = full.join(last, F.unhex("digest") == F.col("_key"), "left").drop("_key")
    return full.withColumn("refers_to", F.when((F.col("n_bytes") >= least) & ~F.col(id_col).eqNullSafe(F.col("last")), F.col("last"))).drop("last")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write one WARC/1.1 record for every row of ``pages`` under ``path``, a file for each task.

    A null URL is written without a target, a null id as an empty one. Records are separated by the
    two line ends that the format asks for; the writer adds them after each value.
    """
    full = with_revisits(pages, id_col, payload_col)
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    number = lambda col: F.coalesce(F.col(col).cast("string"), F.lit(""))
    safe = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", "")
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), number(id_col), F.lit(">"))),
        F.when(F.col(url_col).isNotNull(), line("WARC-Target-URI", safe)).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("n_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), number("refers_to"), F.lit(">"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )
    full.select(record.alias("value")).write.option("lineSep", END).text(path)


FIELDS = "record_type string, record_id string, target string, digest string, payload_bytes long, refers_to string, body_ok boolean"
_NAMES = {b"warc-type": 0, b"warc-record-id": 1, b"warc-target-uri": 2, b"warc-payload-digest": 3, b"warc-payload-length": 4, b"warc-refers-to": 5, b"content-length": 6}


def parse_head(piece: bytes) -> tuple[list, int, int] | None:
    """Header fields, header size and content size of a candidate, without the version line."""
    stop = piece.find(b"\r\n\r\n")
    if stop < 0:
        return None
    values: list = [None] * 7
    for text in piece[:stop].split(b"\r\n"):
        name, colon, value = text.partition(b":")
        if not colon:
            return None
        if (at := _NAMES.get(name.strip().lower())) is not None:
            values[at] = value.strip().decode("utf-8", "replace")
    if values[6] is None or not values[6].isascii() or not values[6].isdigit():
        return None
    return values, stop + 4, int(values[6])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the uncompressed WARC files under ``path``, in columns ``file, offset`` and ``FIELDS``.

    ``body_ok`` says whether a full payload has the digest and length that its header names (null
    for a revisit, whose payload is elsewhere). Version lines inside payloads are not records. The
    chain of a file ends at the first place where no readable record starts. No files give no rows.
    """
    pieces = (
        spark.read.option("lineSep", MAGIC).text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        .where("value is not null")
    )

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Offsets count from the first version line that the block's own pieces follow.

        A piece keeps its bytes where another record's payload may need them: everywhere but in a
        file's first block outside all spans that earlier candidates claim.
        """
        last, at, seq, claimed = None, 0, 0, 0
        magic = len(MAGIC)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for value, file, block in zip(*(batch.column(i) for i in range(3)), strict=True):
                file, block = file.as_py(), block.as_py()
                if (file, block) != last:
                    last, at, seq, claimed = (file, block), 0, 0, 0
                piece = value.as_buffer().to_pybytes()
                found = parse_head(piece) if not (block == 0 and seq == 0) else None
                row: list = [file, block, seq, at, len(piece) + magic, None]
                if found is not None:
                    values, head, size = found
                    row[5] = magic + head + size + 4
                    body_ok = None
                    if values[0] != "revisit":
                        body = piece[head : head + size] if head + size <= len(piece) else None
                        digest = (values[3] or "").removeprefix("sha1:")
                        body_ok = None if body is None else sha1(body).hexdigest() == digest and str(size) == values[4]
                    needed = block > 0 or at - magic < claimed or head + size > len(piece)
                    claimed = max(claimed, at - magic + row[5])
                    row += [values[0], values[1], values[2], (values[3] or "").removeprefix("sha1:"), int(values[4]) if (values[4] or "").isdigit() else None, values[5], body_ok, head, piece if needed else None]
                else:
                    row += [None] * 7 + [0, piece]
                at += len(piece) + magic
                seq += 1
                for col, x in zip(out, row, strict=True):
                    col.append(x)
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    schema = "file string, block long, seq long, rel long, size long, step long, " + FIELDS + ", head long, rest binary"
    names = [f.split()[0] for f in schema.split(", ")]
    found = write_stage(pieces.mapInArrow(candidates, schema), "warc-candidates")
    order = Window.partitionBy("file").orderBy("block")
    blocks = found.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    blocks = blocks.withColumn("start", F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("bytes")
    placed = found.join(blocks, ["file", "block"]).withColumn("offset", F.col("start") + F.col("rel") - len(MAGIC)).withColumn("next", F.col("offset") + F.col("step")).drop("start")
    links = checkpoint(placed.select("file", "block", "offset", "next"))

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        """Where the chain of each candidate leaves its block."""
        pdf = pdf.sort_values("offset", ascending=False)
        out: dict[int, float] = {}
        for offset, step in zip(pdf["offset"].tolist(), pdf["next"].tolist(), strict=True):
            out[offset] = out.get(step, step)
        return pd.DataFrame({"file": pdf["file"], "offset": list(out), "out": pd.array(list(out.values()), dtype="Float64").astype("Int64")})

    leaps = links.groupBy("file", "block").applyInPandas(exits, "file string, offset long, out long")
    leaps = checkpoint(leaps.where("out is not null"))
    # Entries of blocks: file starts and whatever a chain of another block leads to.
    targets = leaps.select("file", F.col("out").alias("offset")).unionByName(links.select("file", F.lit(0).cast("long").alias("offset"))).distinct()
    jump = leaps.join(targets, ["file", "offset"], "left_semi")
    reached = checkpoint(links.where("offset = 0").select("file", "offset"))
    known = reached.count()
    while True:
        further = reached.join(jump, ["file", "offset"]).select("file", F.col("out").alias("offset"))
        reached = checkpoint(reached.unionByName(further).distinct())
        now = reached.count()
        if now == known:
            break
        known = now
        twice = jump.select("file", F.col("offset").alias("out"), F.col("out").alias("out2"))
        jump = checkpoint(jump.join(twice, ["file", "out"]).select("file", "offset", F.col("out2").alias("out")))

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        """The candidates of a block that the chains from its reached entries visit."""
        after = dict(zip(pdf["offset"], pdf["next"], strict=True))
        hit: set[int] = set()
        for at in pdf.loc[pdf["entry"], "offset"]:
            while at in after and at not in hit and not pd.isna(after[at]):
                hit.add(at)
                at = after[at]
        return pd.DataFrame({"file": pdf["file"].iloc[0], "offset": pd.Series(sorted(hit), dtype="int64")})

    marks = links.join(reached.withColumn("entry", F.lit(True)), ["file", "offset"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    valid = checkpoint(marks.groupBy("file", "block").applyInPandas(follow, "file string, offset long"))
    fields = [f.split()[0] for f in FIELDS.split(", ")]
    records = placed.join(valid, ["file", "offset"])
    is_cut = "body_ok is null and not (record_type <=> 'revisit')"
    whole = records.where(f"not ({is_cut})").select("file", "offset", *fields)
    # Payloads that hold the version line lie in several pieces; each piece goes to the record whose span it is in.
    parts = placed.where("rest is not null").select("file", "offset", "head", "rest")
    cut = records.where(is_cut).select("file", F.col("offset").alias("own"), "next")
    spans = cut.select("file", "own", "next", F.explode(F.sequence(F.floor(F.col("own") / SPAN), F.floor((F.col("next") - 1) / SPAN))).alias("cell"))
    pieces_of = parts.withColumn("cell", F.floor(F.col("offset") / SPAN)).join(spans, ["file", "cell"]).where("offset >= own and offset < next")
    pieces_of = pieces_of.withColumn("rest", F.when(F.col("offset") == F.col("own"), F.expr("substring(rest, cast(head as int) + 1)")).otherwise(F.col("rest")))
    joined = pieces_of.groupBy("file", "own").agg(F.array_sort(F.collect_list(F.struct("offset", "rest"))).alias("p"))

    @F.pandas_udf("boolean")
    def intact(parts: pd.Series, digest: pd.Series, size: pd.Series, revisit: pd.Series) -> pd.Series:
        bodies = (MAGIC.encode().join(bytes(x["rest"]) for x in p)[: int(n) if n == n else 0] for p, n in zip(parts, size, strict=True))
        return pd.Series([sha1(b).hexdigest() == d and len(b) == n for b, d, n in zip(bodies, digest, size, strict=True)])

    cut_records = records.where(is_cut).drop("body_ok").join(joined.withColumnRenamed("own", "offset"), ["file", "offset"])
    cut_records = cut_records.withColumn("body_ok", intact("p", "digest", "payload_bytes", F.col("record_type") == "revisit")).select("file", "offset", *fields)
    return whole.unionByName(cut_records)


def page_records(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, body_ok`` of what :func:`read_warc` returns."""
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return records.select(
        number(F.col("record_id")).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        "record_type", number(F.col("refers_to")).alias("refers_to"), "body_ok",
    )


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` as archives in the shared folder and return :func:`page_records` of what is read back."""
    path = f"{shared_dir(pages.sparkSession)}/plumbline/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, id_col, url_col, payload_col)
    return page_records(read_warc(pages.sparkSession, path))
