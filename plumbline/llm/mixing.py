"""Mixing sources to target weights: temperature by bisection, then budgeted block permutations.

Token shares are raised to an exponent between 0 (uniform) and 1 (as they are). The exponent is
bisected on a grid of 2**-20: the largest that still meets the target entropy, raised if need be to
the smallest that keeps every source within the repetition limit. Each source then fills its quota
by whole epochs and the head of one more, each epoch a permutation of its own, and every output
block takes from each source its share of the block's budget.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import write_stage

GRID_BITS = 20
#: Bits settled by each Spark job of the bisection.
STEP_BITS = 5


def n_words(text: Column) -> Column:
    """Words of a text (runs of anything but ASCII white space); null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _bisect(shares: DataFrame, floor_entropy: float, factor: float, limit: float) -> int:
    """Grid number of the exponent. One job settles STEP_BITS levels of both bisections.

    ``factor`` is budget / total; a source repeats ``factor * p**(a - 1) / sum(p**a)`` times.
    """
    top = 1 << GRID_BITS
    most, least = (0, top), (0, top)  # entropy holds at most[0]; repetition holds at least[1]
    step = top
    while step > 1:
        step >>= STEP_BITS
        tries = sorted({k for low, high in (most, least) for k in range(low, high + 1, step) if k in range(top + 1)})
        sums = []
        for k in tries:
            a = k / top
            sums += [
                F.sum(F.pow("p", F.lit(a))).alias(f"z{k}"),
                F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias(f"y{k}"),
                F.max(F.pow("p", F.lit(a - 1))).alias(f"r{k}"),
            ]
        row = shares.agg(*sums).first().asDict()
        entropy = {k: log(row[f"z{k}"]) - k / top * row[f"y{k}"] / row[f"z{k}"] for k in tries}
        repeats = {k: factor * row[f"r{k}"] / row[f"z{k}"] for k in tries}
        good = max((k for k in tries if most[0] <= k <= most[1] and entropy[k] >= floor_entropy), default=0)
        most = (good, min(good + step, top))
        fine = min((k for k in tries if least[0] <= k <= least[1] and repeats[k] <= limit), default=top)
        least = (max(fine - step, 0), fine)
    return max(most[0], least[1])


def _permuted(seed: int) -> Column:
    """60 pseudo-random bits of (seed, epoch, id); a null id counts as an empty text."""
    text = F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    entropy_share: float = 0.95, max_repeats: float = 4.0, budget_share: float = 1.0, block_tokens: int = 1_000_000, seed: int = 17,
) -> DataFrame:
    """The mixture: one row for each time a document is taken, with ``n_tokens, epoch, block, slot`` appended.

    ``entropy_share`` is the target entropy as a share of that of the uniform mix; ``budget_share``
    the budget as a share of all tokens (cut to ``max_repeats``); reading order is block, then slot.
    In each source and epoch the documents stand in the order of their slots (ties by id and
    length); a document of the last epoch is taken if it begins before the quota ends, so a source
    exceeds its quota by part of one document at most.

    A null source is a source of its own. Null and wordless texts have no tokens: they are taken if
    their place is within the quota, and a source of nothing but such texts gives nothing. Repeated
    rows are separate documents. An empty table gives an empty result. Input columns named like the
    appended ones are replaced (but for the id, text and source themselves, which stay in place of
    the appended one); all others are kept whatever their names.
    """
    added = ["n_tokens", "epoch", "block", "slot"]
    named = (id_col, text_col, source_col)
    kept = [c for c in docs.columns if c not in added or c in named]
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit(""))
    counts = [F.col(f"`{id_col}`").alias("id"), key.alias("s"), n_words(F.col(f"`{text_col}`")).alias("n_tokens")]
    # Words are counted once for the sums, from narrow rows, and once more where whole rows are dealt out.
    narrow = write_stage(docs.select(*counts), "mix-counts")
    totals = write_stage(narrow.groupBy("s").agg(F.sum("n_tokens").alias("t")).where("t > 0"), "mix-sources")
    total, n = totals.agg(F.sum("t"), F.count(F.lit(1))).first()
    total = total or 0
    factor = min(budget_share, max_repeats)
    shares = totals.withColumn("p", F.col("t") / F.lit(float(max(total, 1))))
    grid = _bisect(shares, entropy_share * log(n), factor, max_repeats) if n else 0
    power = F.pow("p", F.lit(grid / (1 << GRID_BITS)))
    z = shares.agg(F.sum(power)).first()[0] or 1.0
    budget = factor * total
    plan = shares.select("s", "t", F.round(power / F.lit(z) * F.lit(budget)).cast("long").alias("quota"))
    plan = plan.withColumn("full", F.floor(F.col("quota") / F.col("t"))).withColumn("rest", F.col("quota") - F.col("full") * F.col("t"))
    blocks = max(1, -(-int(budget) // block_tokens))

    # The slots' top bits cut each source into even cells, so that prefix sums need no whole source in a task.
    def dealt(rows: DataFrame) -> DataFrame:
        taken = rows.join(plan, "s").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
        taken = taken.withColumn("slot", _permuted(seed))
        return taken.withColumn("d1", F.shiftright("slot", 52)).withColumn("d2", F.shiftright("slot", 44).bitwiseAND(F.lit(255)))

    cell = ["s", "epoch", "d1", "d2"]
    before = lambda by, order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    leaves = dealt(narrow).groupBy(*cell).agg(F.sum("n_tokens").alias("n"))
    tops = leaves.groupBy(*cell[:3]).agg(F.sum("n").alias("n"))
    tops = tops.select(*cell[:3], F.coalesce(F.sum("n").over(before(cell[:2], ["d1"])), F.lit(0)).alias("b1"))
    starts = leaves.select(*cell, F.coalesce(F.sum("n").over(before(cell[:3], ["d2"])), F.lit(0)).alias("b2"))
    starts = starts.join(tops, cell[:3]).select(*cell, (F.col("b1") + F.col("b2")).alias("begin"))
    local = F.coalesce(F.sum("n_tokens").over(before(cell, ["slot", "id", "n_tokens"])), F.lit(0))
    # Columns of the input go by their number, so no name of theirs can meet one of the plan's.
    whole = docs.select(*[F.col(f"`{c}`").alias(f"in{i}") for i, c in enumerate(kept)], *counts)
    placed = dealt(whole).join(starts, cell).withColumn("start", F.col("begin") + local)
    placed = placed.where((F.col("epoch") < F.col("full")) | (F.col("start") < F.col("rest")))
    at = F.floor((F.col("epoch") * F.col("t") + F.col("start")) * F.lit(blocks) / F.col("quota")).cast("long")
    placed = placed.withColumn("block", F.least(at, F.lit(blocks - 1).cast("long")))
    return placed.select(*[F.col(f"in{i}").alias(c) for i, c in enumerate(kept)], *[F.col(c) for c in added if c not in named])
