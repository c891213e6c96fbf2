"""From a list of sources to frames: expansion, routing, file and HTTP scans, tile and style loads."""

from __future__ import annotations

import glob as globbing
import os
import time
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import mvt, styles
from plumbline.model import EMPTY_STYLE, INVALID_STYLE, STYLE, UNKNOWN, VECTOR_TILE, Frames
from plumbline.operators import style_rules, tile_rules
from plumbline.plans.engine import glob_regex
from plumbline.plans.rules import Plugin, Provider
from plumbline.shared import numbered

# Suffixes by provider, and those that a folder scan takes by default.
TILE_SUFFIXES = (".pbf", ".mvt", ".vector.pbf", ".mbtiles")
STYLE_SUFFIXES = (".json", ".style", ".style.json")
FOLDER_SUFFIXES = (".pbf", ".json")
HTTP_TIMEOUT_MS = 30_000


def is_tile(source: Column) -> Column:
    """Whether a source looks like a tile, by its suffix."""
    name = F.lower(F.trim(source))
    return reduce(lambda a, b: a | b, [name.endswith(s) for s in TILE_SUFFIXES])


def is_style(source: Column) -> Column:
    """Whether a source is inline JSON or has a style's suffix."""
    name = F.lower(F.trim(source))
    return F.ltrim(source).rlike(r"^\s*[\[{]") | reduce(lambda a, b: a | b, [name.endswith(s) for s in STYLE_SUFFIXES])


def route(sources: DataFrame, providers: Iterable[Provider] | None = None) -> DataFrame:
    """Append ``provider`` and ``artifact_type`` of the first provider that takes the source, else ``unknown``."""
    kinds = [(p.id, p.artifact_types[0], p.can_handle(F.col("source"))) for p in providers] if providers is not None else [("tile", VECTOR_TILE, is_tile(F.col("source"))), ("style", STYLE, is_style(F.col("source")))]
    name, kind = F.lit(None).cast("string"), F.lit(UNKNOWN)
    for ident, artifact, takes in reversed(kinds):
        name, kind = F.when(takes, F.lit(ident)).otherwise(name), F.when(takes, F.lit(artifact)).otherwise(kind)
    return sources.withColumn("provider", name).withColumn("artifact_type", kind)


def is_url(source: str) -> bool:
    return source.startswith(("http://", "https://"))


def expand_sources(sources: Iterable[str], suffixes: tuple[str, ...] = FOLDER_SUFFIXES) -> list[str]:
    """Globs become files, folders their tiles and styles, anything else stays; the first of equals counts."""
    out: dict[str, None] = {}
    for source in sources:
        if is_url(source) or source.lstrip()[:1] in ("{", "["):
            found = [source]
        elif os.path.isdir(source):
            found = sorted(os.path.join(d, f) for d, _, files in os.walk(os.path.abspath(source)) for f in files if f.endswith(suffixes))
        elif globbing.has_magic(source):
            found = sorted(os.path.abspath(f) for f in globbing.glob(source, recursive=True) if os.path.isfile(f))
        else:
            found = [source]
        out |= dict.fromkeys(found)
    return list(out)


def batch_list(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a list file: one a line, blank lines and ``#`` comments dropped."""
    lines = spark.read.text(path).select(F.trim("value").alias("source"), F.monotonically_increasing_id().alias("line"))
    return first_seen(lines.where("source <> '' and not startswith(source, '#')"), "line").select("source_idx", "source")


def first_seen(sources: DataFrame, order: str) -> DataFrame:
    """Distinct ``source`` values numbered as ``source_idx`` in order of first occurrence."""
    first = sources.groupBy("source").agg(F.min(order).alias("_first"))
    return numbered(first, [F.asc("_first"), F.asc("source")], "source_idx").select("source_idx", "source")


def scan_roots(spark: SparkSession, roots: Iterable[str], suffixes: tuple[str, ...] = FOLDER_SUFFIXES) -> DataFrame:
    """``(source_idx, source, content, read_error)`` of the files of folders, globs and files, on any file system that Spark reads.

    Spark lists and reads them; a folder's suffixes and a glob's last part are filters of its scan, and
    large folders are split by size. ``**`` in a glob stands for any folders. Sources are numbered by root and then by
    path; of a file that several roots hold the first counts. A root that is not there is a row with an error,
    a glob that matches nothing gives none.
    """
    schema, found = "content binary, root int, source string, read_error string", []
    none = F.lit(None)
    for number, root in enumerate(roots):
        head, _, tail = root.partition("**")
        path = spark._jvm.org.apache.hadoop.fs.Path(head if tail else root)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
        if not len(there):
            if not any(c in root for c in "*?["):
                found.append(spark.createDataFrame([(None, number, root, "file not found")], schema))
            continue
        reader, wanted = spark.read.format("binaryFile").option("recursiveFileLookup", True), F.lit(True)
        if tail:
            last = tail.rsplit("/", 1)[-1]
            reader = reader if "**" in last else reader.option("pathGlobFilter", last)
            wanted = F.col("path").rlike(glob_regex(str(there[0].getPath()).rstrip("/") + "/**" + tail))
        elif len(there) == 1 and there[0].isDirectory():
            reader = reader.option("pathGlobFilter", "{" + ",".join(f"*{s}" for s in suffixes) + "}")
        files = reader.load(head if tail else root).where(wanted)
        found.append(files.select("content", F.lit(number).alias("root"), F.regexp_replace("path", "^file:/*", "/").alias("source"), none.cast("string").alias("read_error")))
    if not found:
        return spark.createDataFrame([], "source_idx long, source string, content binary, read_error string")
    every = reduce(DataFrame.unionByName, found)
    first = every.groupBy("source").agg(F.min("root").alias("root"))  # reads no content
    numbers = numbered(first, [F.asc("root"), F.asc("source")], "source_idx")
    return every.join(numbers, ["source", "root"]).select("source_idx", "source", "content", "read_error")


def source_frame(spark: SparkSession, sources: Iterable[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(sources)), "source_idx long, source string")


def read_files(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """Append ``content`` and ``read_error`` of file sources; a source that cannot be read is data.

    Paths are opened inside tasks by Spark's own file reader, one scan for all of them.
    """
    paths = [r["source"] for r in sources.select("source").distinct().toLocalIterator()]
    have = [os.path.abspath(p) for p in paths if os.path.isfile(p)]
    files = spark.read.format("binaryFile").load(have).select("path", "content") if have else spark.createDataFrame([], "path string, content binary")
    files = files.select(F.regexp_replace("path", r"^file:/*", "/").alias("_path"), "content")
    keyed = sources.withColumn("_path", full_path(F.col("source")))
    read = keyed.join(files, "_path", "left").drop("_path")
    return read.withColumn("read_error", F.when(F.col("content").isNull(), F.lit("file not found")))


def full_path(source: Column) -> Column:
    """Absolute path of a source, as the driver sees it."""
    here = os.getcwd()
    return F.when(source.startswith("/"), source).otherwise(F.concat(F.lit(here + "/"), F.regexp_replace(source, r"^\./", "")))


def fetch(sources: DataFrame, timeout_ms: int = HTTP_TIMEOUT_MS, headers: dict[str, str] | None = None, retries: int = 0, pause_ms: int = 200) -> DataFrame:
    """Append ``content`` and ``read_error`` of HTTP sources, fetched inside tasks; nothing is raised.

    Failed connections and answers of 429 or 500 and above are tried again ``retries`` times, each after a pause
    twice as long as the one before.
    """
    names = sources.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, errors = [], []
            for url in batch.column(names.index("source")).to_pylist():
                content = error = None
                for attempt in range(retries + 1):
                    content = error = None
                    try:
                        with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout_ms / 1000) as reply:
                            content = reply.read()
                    except urllib.error.HTTPError as failed:
                        error = f"HTTP {failed.code}"
                        if failed.code != 429 and failed.code < 500:
                            break
                    except (OSError, ValueError) as failed:
                        error = f"{type(failed).__name__}: {failed}"
                    if error is None:
                        break
                    if attempt < retries:
                        time.sleep(pause_ms / 1000 * 2**attempt)
                contents.append(content)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(contents, pa.binary()), pa.array(errors, pa.string())], [*names, "content", "read_error"])

    fields = ", ".join(f"`{n}` {t}" for n, t in sources.dtypes)
    return sources.mapInArrow(run, f"{fields}, content binary, read_error string")


def load_tiles(raw: DataFrame, light: bool = False, int_zigzag: bool = False, dealt: bool = False, keep: bool = True) -> Frames:
    """Frames of ``(source_idx, source, content, read_error)`` rows of tiles. Load failures are data.

    With ``dealt`` the rows are decoded in the partitions they come in. ``keep`` stores the decoded tiles for all
    frames; whoever reads one frame once decodes as it reads.
    """
    content = F.when(F.lower(F.trim("source")).endswith(".mbtiles"), F.lit(None)).otherwise(F.col("content"))
    # Decoding costs far more than moving the bytes: deal the tiles out evenly over all cores.
    raw = raw if dealt else raw.repartition(3 * raw.sparkSession.sparkContext.defaultParallelism, "source_idx")
    tiles = raw.withColumn("tile", mvt.decode(content, light, int_zigzag)).drop("content")
    # Decoded once for all rules: the frames below read the stored columns, not the decoder.
    tiles = tiles.persist() if keep else tiles
    archive = F.when(F.lower(F.trim("source")).endswith(".mbtiles"), F.lit("tile archives cannot be loaded"))
    error = F.coalesce("read_error", archive, "tile.error")
    artifacts = tiles.select("source_idx", "source", F.lit(VECTOR_TILE).alias("artifact_type"), "tile.bytes", "tile.decoded_bytes", "tile.gzipped", error.alias("load_error"))
    return Frames(artifacts, mvt.layer_rows(tiles), mvt.feature_rows(tiles))


def load_styles(raw: DataFrame, keep: bool = True) -> Frames:
    """Frames of ``(source_idx, source, text, read_error)`` rows of styles.

    ``keep`` stores all columns for all frames; without it a frame reads what it needs of the texts.
    """
    parsed = styles.load(raw)
    parsed = parsed.persist() if keep else parsed
    kind = F.when(F.col("read_error").isNotNull(), F.lit(STYLE)).otherwise(F.col("style.artifact_type"))
    size = F.when(F.col("style.artifact_type") == EMPTY_STYLE, F.lit(0)).otherwise(F.octet_length("text")).cast("long")
    artifacts = parsed.select("source_idx", "source", kind.alias("artifact_type"), size.alias("bytes"), size.alias("decoded_bytes"), F.lit(False).alias("gzipped"), F.coalesce("read_error", F.when(F.col("style.artifact_type") == INVALID_STYLE, F.col("style.error"))).alias("load_error"))
    readable = parsed.where("read_error is null")
    layers = styles.style_layer_rows(readable)
    return Frames(artifacts, None, None, styles.style_rows(readable), layers.persist() if keep else layers)


def load_sources(spark: SparkSession, sources: Iterable[str], timeout_ms: int = HTTP_TIMEOUT_MS, http: bool = True, plugins: Iterable[Plugin] | None = None) -> Frames:
    """Frames of a list of paths, URLs and inline styles, in their order.

    Sources go to the first provider of the plugins, in their order, that takes them. A provider
    that is not built in loads rows ``(source_idx, source, content, read_error)`` itself.
    """
    providers = [p for plugin in (DEFAULT_PLUGINS if plugins is None else plugins) for p in plugin.providers]
    routed = route(source_frame(spark, sources), providers).persist()
    remote = F.col("source").rlike("^https?://")
    inline = F.ltrim("source").rlike(r"^\s*[\[{]")
    files = read_files(spark, routed.where(F.col("provider").isNotNull() & ~remote & ~inline))
    urls = routed.where(F.col("provider").isNotNull() & remote)
    urls = fetch(urls, timeout_ms) if http else urls.select("*", F.lit(None).cast("binary").alias("content"), F.lit("HTTP scans are off").alias("read_error"))
    raw = files.unionByName(urls)
    given = routed.where(F.col("provider").isNotNull() & inline).select("*", F.col("source").cast("binary").alias("content"), F.lit(None).cast("string").alias("read_error"))
    own = [p.load(raw.unionByName(given).where(F.col("provider") == p.id).select("source_idx", "source", "content", "read_error")) for p in providers if p not in (TILE_PROVIDER, STYLE_PROVIDER)]
    given = given.where("provider = 'style'")
    tiles = load_tiles(raw.where("provider = 'tile'").select("source_idx", "source", "content", "read_error"))
    texts = raw.where("provider = 'style'").unionByName(given).select("source_idx", "source", F.decode("content", "UTF-8").alias("text"), "read_error")
    found = load_styles(texts)
    none = F.lit(None)
    lost = routed.where("provider is null").select("source_idx", "source", "artifact_type", none.cast("long").alias("bytes"), none.cast("long").alias("decoded_bytes"), none.cast("boolean").alias("gzipped"), none.cast("string").alias("load_error"))
    built_in = Frames(tiles.artifacts.unionByName(found.artifacts).unionByName(lost), tiles.layers, tiles.features, found.styles, found.style_layers)
    return reduce(joined, own, built_in)


def joined(a: Frames, b: Frames) -> Frames:
    """The tables of both."""
    both = lambda x, y: y if x is None else x if y is None else x.unionByName(y, allowMissingColumns=True)
    return Frames(*(both(getattr(a, n), getattr(b, n)) for n in ("artifacts", "layers", "features", "styles", "style_layers", "texts")))


TILE_PROVIDER = Provider("tile", (VECTOR_TILE,), is_tile, load_tiles)
STYLE_PROVIDER = Provider("style", (STYLE, INVALID_STYLE, EMPTY_STYLE), is_style, load_styles)
TILE_PLUGIN = Plugin("tile", "Vector tiles", "0.1.0", (TILE_PROVIDER,), tile_rules.RULES)
STYLE_PLUGIN = Plugin("style", "Map styles", "0.1.0", (STYLE_PROVIDER,), style_rules.RULES)
DEFAULT_PLUGINS = (TILE_PLUGIN, STYLE_PLUGIN)


def tile_pyramid(spark: SparkSession, last_full_zoom: int = 3, extra_zoom: int = 4, extra: int = 15) -> DataFrame:
    """``(z, x, y)`` of all tiles up to a zoom, and the first ones of one zoom more."""
    levels = spark.range(last_full_zoom + 1).select(F.col("id").cast("int").alias("z"))
    side = F.expr("shiftleft(1, z)")
    whole = levels.withColumn("x", F.explode(F.sequence(F.lit(0), side - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), side - 1)))
    n = 1 << extra_zoom
    more = spark.range(extra).select(F.lit(extra_zoom).alias("z"), F.floor(F.col("id") / n).cast("int").alias("x"), (F.col("id") % n).cast("int").alias("y"))
    return whole.unionByName(more)


def tile_address(path: Column) -> Column:
    """z, x and y of a file name ``z-x-y.pbf``; nulls where it has another form."""
    part = lambda i: F.regexp_extract(path, r"(\d+)-(\d+)-(\d+)\.pbf$", i).try_cast("int")
    return F.struct(part(1).alias("z"), part(2).alias("x"), part(3).alias("y"))


def cache_complete(folder: str, expected: int, share: float = 0.9) -> bool:
    """Whether a tile cache holds at least a share of the expected non-empty files."""
    held = sum(os.path.getsize(os.path.join(folder, f)) > 0 for f in os.listdir(folder)) if os.path.isdir(folder) else 0
    return held >= share * expected
