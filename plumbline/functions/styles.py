"""Map styles: strict JSON as VARIANT, read into kind-tagged columns inside the JVM.

Numbers are JSON's own (no NaN, no leading zeros), nothing may follow the value, and of a repeated key the
last value counts. Texts nested more than a thousand deep are taken as broken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.model import EMPTY_STYLE, INVALID_STYLE, STYLE

#: Arrays within arrays that a message's text still spells out.
TEXT_DEPTH = 3
#: Doubles from here on are not written out digit by digit.
LONG_NUMBER = 1e21
#: Keys of a layer that rules look at.
LAYER_KEYS = ("id", "source", "minzoom", "maxzoom", "ref")


def parsed_pair(text: Column) -> Column:
    """VARIANT of an array of a text's value and a digest of the text; :func:`is_whole` says whether the text is JSON.

    The parser stops after one value, so the text is read as the first of two entries of an array; the
    second is a digest of the text, which no text can hold itself.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.sha2(text, 256), F.lit('"]')))


def is_whole(pair: Column, text: Column) -> Column:
    """Whether a text is one JSON value: its digest is the second entry, and the last."""
    return (F.try_variant_get(pair, "$[1]", "string") == F.sha2(text, 256)) & F.try_variant_get(pair, "$[2]", "variant").isNull()


def entries(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def members(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def json_kind(value: Column, schema: Column | None = None) -> Column:
    """Kind of a VARIANT; ``undefined`` where there is none. Its ``schema``, where that is a column already, is not made again for each comparison."""
    kind = F.schema_of_variant(value) if schema is None else schema
    named = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    return F.when(value.isNull(), "undefined").otherwise(named)


def as_number(value: Column, kind: Column) -> Column:
    """The number of a VARIANT whose kind is that."""
    return F.when(kind == "number", F.try_variant_get(value, "$", "double"))


def as_string(value: Column, kind: Column) -> Column:
    """The text of a VARIANT whose kind is that of a string."""
    return F.when(kind == "string", F.try_variant_get(value, "$", "string"))


def as_text(value: Column, depth: int = TEXT_DEPTH) -> Column:
    """The text that a message shows for a value."""
    kind, number = F.schema_of_variant(value), F.try_variant_get(value, "$", "double")
    digits = F.when((number == F.floor(number)) & (F.abs(number) < LONG_NUMBER), number.cast("decimal(38,0)").cast("string")).otherwise(number.cast("string"))
    text = F.when(value.isNull(), "undefined").when(kind == "VOID", "null").when(kind.isin("STRING", "BOOLEAN"), F.try_variant_get(value, "$", "string")).when(kind.startswith("OBJECT"), "[object Object]")
    if depth:
        inner = lambda v: F.when(F.is_variant_null(v), "").otherwise(as_text(v, depth - 1))
        text = text.when(kind.startswith("ARRAY"), F.array_join(F.transform(entries(value), inner), ","))
    return text.otherwise(digits)


def once(value: Column) -> Column:
    """A column from a generator of one row: filters and columns asked for above it do not compute its value again."""
    return F.explode(F.array(value))


def load(raw: DataFrame, text: str = "text", out: str = "style") -> DataFrame:
    """Append the struct of a style's checked keys, with its layers as a VARIANT; a text that is no JSON is data, not an error."""
    raw.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    body = F.coalesce(text, F.lit(""))
    blank, pair = body.rlike(r"(?U)^\s*$"), F.col(f"{out}_pair")
    kind = F.when(blank, EMPTY_STYLE).when(is_whole(pair, body), STYLE).otherwise(INVALID_STYLE)
    parsed = raw.select("*", once(F.when(~blank, parsed_pair(body))).alias(f"{out}_pair")).select("*", once(kind).alias(f"{out}_kind"))
    kind = F.col(f"{out}_kind")
    version, sources, layers = (F.when(kind == STYLE, F.try_variant_get(pair, f"$[0].{k}", "variant")) for k in ("version", "sources", "layers"))
    # An array's kind shows in its first entry; only what is no array, or empty, is looked at as a whole.
    layers_kind = F.when((kind == STYLE) & F.try_variant_get(pair, "$[0].layers[0]", "variant").isNotNull(), "array").otherwise(json_kind(layers))
    found = F.struct(
        kind.alias("artifact_type"), F.when(kind == INVALID_STYLE, F.lit("the text is not one JSON value")).alias("error"), json_kind(version).alias("version_kind"), as_number(version, json_kind(version)).alias("version_number"), as_text(version).alias("version_text"),
        F.when(members(sources).isNotNull(), "object").otherwise(json_kind(sources)).alias("sources_kind"), as_text(sources).alias("sources_text"), F.map_keys(members(sources)).alias("source_names"),
        layers_kind.alias("layers_kind"), F.when(layers_kind == "array", "").otherwise(as_text(layers)).alias("layers_text"), layers.alias("layers"),
    )
    return parsed.withColumn(out, found).drop(f"{out}_pair", f"{out}_kind")


def style_rows(loaded: DataFrame, style: str = "style") -> DataFrame:
    """``styles`` frame: parsed styles only."""
    names = ["version_kind", "version_number", "version_text", "sources_kind", "sources_text", "source_names", "layers_kind", "layers_text"]
    return loaded.where(F.col(f"{style}.artifact_type") == STYLE).select("source_idx", *[F.col(f"{style}.{n}").alias(n) for n in names])


def style_layer_rows(loaded: DataFrame, style: str = "style") -> DataFrame:
    """``style_layers`` frame: a row for each entry of ``layers``; ``record_index`` counts objects alone.

    Entries become rows first and columns then, so a rule computes only the columns that it reads, and the work
    grows with the number of entries.
    """
    layers = F.col(f"{style}.layers")
    fields = ", ".join(f"{k}: variant" for k in LAYER_KEYS)
    both = F.struct(entries(layers).alias("listed"), F.try_variant_get(layers, "$", f"array<struct<{fields}>>").alias("objects"))
    held = loaded.where(F.col(f"{style}.artifact_type") == STYLE).select("source_idx", once(both).alias("held"))
    places = lambda wanted: F.filter(F.transform("held.objects", lambda o, i: F.when(wanted(o), i)), lambda i: i.isNotNull())
    row = lambda i, number: F.struct(i.alias("raw_index"), number.alias("record_index"), F.get("held.objects", i).alias("record"), F.when(number.isNull(), F.get("held.listed", i)).alias("other"))
    rows = F.concat(F.transform(places(lambda o: o.isNotNull()), row), F.transform(places(lambda o: o.isNull()), lambda i: row(i, F.lit(None).cast("int"))))
    found = held.select("source_idx", F.explode(rows).alias("l")).select("source_idx", "l.raw_index", "l.record_index", F.col("l.other").alias("other"), "l.record.*")
    found = found.withColumns({f"{k}_schema": F.schema_of_variant(k) for k in LAYER_KEYS if k != "ref"})
    found = found.withColumns({f"{k}_kind": json_kind(F.col(k), F.col(f"{k}_schema")) for k in LAYER_KEYS if k != "ref"})
    text, number = (lambda k: as_string(F.col(k), F.col(f"{k}_kind"))), (lambda k: as_number(F.col(k), F.col(f"{k}_kind")))
    return found.select(
        "source_idx", "raw_index", "record_index", F.when(F.col("record_index").isNotNull(), "object").otherwise(json_kind(F.col("other"))).alias("kind"), "id_kind", text("id").alias("id"), "source_kind", text("source").alias("source_name"),
        "minzoom_kind", number("minzoom").alias("minzoom"), "maxzoom_kind", number("maxzoom").alias("maxzoom"), F.col("ref").isNotNull().alias("has_ref"), as_text(F.col("ref")).alias("ref_text"),
    )
