"""Target-distribution importance resampling over hashed n-grams.

A position table holds a row for each word and its place; a window of ``lead()`` over each document
joins the following words on for every order above the first. Phrases are hashed to buckets, counted
in the corpus and in the target, and each bucket's log ratio of shares is its gain. A document's weight is
the mean gain of its phrases; Gumbel noise from its id turns the highest sums into a draw without
replacement.

Odd rows: a null text has no words; a null id hashes as the empty string; rows that repeat an id or a
whole row are judged each by itself (their ranks among one another are arbitrary); an empty corpus
gives no rows, an empty target gains from counts of zero. Columns other than id and text are never
looked at, so their names cannot clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from plumbline.llm.common import ordinals, write_stage

#: Everything but digits, letters and what lies beyond ASCII parts words.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Positions of one window: a longer document is cut into this many words at a time, each with the next few words.
SEGMENT = 65_536


def words_of(text: Column) -> Column:
    """The words of a text, not yet in lower case; none for null."""
    return F.array_remove(F.split(text, BETWEEN_WORDS), "")


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case and nothing else; words of ASCII alone take the fast way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def position_table(docs: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys, pos, word``: a row for each word; one with nulls for a text without any."""
    found = docs.select(*keys, F.posexplode_outer(words_of(F.col(text_col))).alias("pos", "word"))
    return found.withColumn("word", lower_ascii(F.col("word")))


def phrases(words: DataFrame, keys: list[str], max_order: int, segment: int = SEGMENT) -> DataFrame:
    """``keys, size, phrase``: all runs of 1 to ``max_order`` words, joined by one space; ``size`` is a run's number of words."""
    if max_order == 1:
        return words.select(*keys, F.lit(1).alias("size"), F.col("word").alias("phrase"))
    own = F.floor(F.col("pos") / segment)
    ahead = (F.col("pos") >= segment) & (F.col("pos") % segment < max_order - 1)
    cut = words.withColumn("own", own).withColumn("part", F.explode(F.when(ahead, F.array("own", F.col("own") - 1)).otherwise(F.array("own"))))
    following = W.Window.partitionBy(*keys, "part").orderBy("pos")
    led = [F.col("word"), *[F.lead("word", k).over(following) for k in range(1, max_order)]]
    table = cut.select(*keys, "own", "part", *[c.alias(f"w{k}") for k, c in enumerate(led)]).where("own <=> part")
    runs = [F.when(F.col(f"w{k}").isNotNull(), F.struct(F.lit(k + 1).alias("size"), F.concat_ws(" ", *[f"w{i}" for i in range(k + 1)]).alias("phrase"))) for k in range(max_order)]
    kept = F.filter(F.array(*runs), lambda x: x.isNotNull())
    return table.select(*keys, F.explode_outer(kept).alias("run")).select(*keys, "run.size", "run.phrase")


def bucket_of(phrase: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(phrase.cast("binary")), F.lit(buckets))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``bucket, gain`` for every bucket, from the ``phrase`` columns of two frames: one row a bucket, so at most ``buckets``."""
    counted = [f.where("phrase is not null").groupBy(bucket_of(F.col("phrase"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias(n)) for f, n in ((corpus, "s"), (target, "t"))]
    every = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    for c in counted:
        every = every.join(c, "bucket", "left")
    every = write_stage(every.fillna(0, ["s", "t"]), "buckets")
    total = every.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    up = (F.col("t") + 1).cast("double") * F.lit(float(total.s + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(total.t + buckets))
    return every.select("bucket", F.floor(1000 * F.log(up / down)).alias("gain"))


def gumbel(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of sha256 of seed and id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_order: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """A row for each document: its id, ``n_words, n_features, weight, score, rank`` (all long; rank null where it is not drawn).

    Of the N documents with ``least_words`` words or more, ``floor(percent * N / 100)`` are drawn by score.
    """
    keys = ["row", "id"]
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    corpus = phrases(position_table(plain, keys, "text"), keys, max_order)
    aims = target.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{text_col}`").alias("text"))
    aimed = phrases(position_table(aims, ["row"], "text"), ["row"], max_order)
    gain = F.broadcast(gains(corpus, aimed, buckets))
    joined = corpus.withColumn("bucket", bucket_of(F.col("phrase"), buckets)).join(gain, "bucket", "left")
    n, total = F.count("phrase"), F.coalesce(F.sum("gain"), F.lit(0))
    sums = joined.groupBy(*keys).agg(n.alias("n_features"), F.count(F.when((F.col("size") == 1) & F.col("phrase").isNotNull(), 1)).alias("n_words"), total.alias("total"))
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    scored = sums.select("row", "id", "n_words", "n_features", mean.alias("weight"))
    scored = write_stage(scored.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "importance")
    able = scored.where(F.col("n_words") >= least_words)
    ranked, n_able = ordinals(able, [F.desc("score"), F.asc("id"), F.asc("row")], "rank")
    drawn = n_able * percent // 100
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **settings: object) -> DataFrame:
    """The drawn documents themselves, all their columns (rows that share a drawn id with others all stay; null ids never do)."""
    drawn = importance(docs, target, id_col, **settings).where("rank is not null").select(F.col(f"`{id_col}`").alias("drawn id")).distinct()
    return docs.join(drawn, F.col(f"`{id_col}`") == F.col("`drawn id`"), "left_semi")
