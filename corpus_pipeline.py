"""A training-corpus pipeline over ``documents``: five stages, each written as Parquet and reread.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, language, mixing, secrets, shingles
from plumbline.llm.common import numbered, restored, write_stage

#: A text of at least this many letters is rejected if its score is lower than LEAST_SCORE.
LETTERS, LEAST_SCORE = 200, 0.1
MASK = "[SECRET]"


def _inner(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with numbered columns, which no name of a stage can meet, and the new names of some."""
    return numbered(docs), [f"in{docs.columns.index(n)}" for n in names]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null included) and longer ones that no learned language resembles.

    Profiles are learned from all labelled documents; if none is labelled only letters count. A text that
    two languages resemble alike goes to the first by name, which changes nothing here. Rows are judged
    each by itself, repeated ones alike. An empty table stays empty. Columns of any name keep their values.
    """
    own, (text, lang) = _inner(docs, "text", "lang")
    prototypes = language.learn_prototypes(own, text, lang)
    judged = language.predict_language(own, prototypes, text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    kept = letters > 0
    if prototypes:
        kept &= (F.col("score") >= LEAST_SCORE) | (letters < LETTERS)
    return restored(judged.where(kept), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, Jaccard 0.8 or more) stays, that with the smallest id.

    Null and wordless texts are copies of each other. Of rows that share the smallest id one stays, that
    whose text has the smallest hash. An empty table stays empty. Columns of any name keep their values.
    """
    return shingles.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Rows that share an id with one go too, null ids with null ids.

    Null and empty texts and items match nothing. Empty tables change nothing. Columns of any name keep
    their values.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    own, (ident, text) = _inner(docs, "doc_id", "text")
    hits = decontaminate.contaminated(own, items, ident, text).select(F.col(ident).alias("hit")).distinct()
    return restored(own.join(hits, F.col(ident).eqNullSafe(F.col("hit")), "left_anti"), docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of a secret is masked; ``n_chars`` follows the new text.

    A null text stays null. Spans that overlap become one mask. Rows are judged each by itself, repeated
    ones alike. An empty table stays empty. Columns of any name keep their values.
    """
    own, (text,) = _inner(docs, "text")
    scanned = secrets.scan_secrets(own, text, mask=MASK)
    if "n_chars" in docs.columns:
        size = f"in{docs.columns.index('n_chars')}"
        scanned = scanned.withColumn(size, F.when(F.col("spans") != "", F.length(text).cast("long")).otherwise(F.col(size)))
    return restored(scanned, docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources: a row for each time a document is read, with its block and slot.

    A null source is a source of its own; null texts have no words. Ties of slots go by id. An empty table
    gives no rows. Columns of any name keep their values, but for those that the mixture appends.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
]

#: Learned language profiles, fingerprints and edit matching are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and reread before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_stage(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
