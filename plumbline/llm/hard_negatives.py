"""Hard negatives by dual-tree search.

Anchors and candidates are laid into trees of balls, once by label (for positives) and once over all rows
(for negatives). Nodes are split at medians along the main direction of a bounded sample, all rows of a
round at once, until they are leaves. The search starts with pairs of roots; a pair of nodes whose
inner-product interval cannot reach what any of the node's anchors still needs goes with everything below it,
the others are replaced by the pairs of their children. Pairs of leaves are scored exactly. A first narrow
descent finds good scores, so that the full one has thresholds from its first level on.

Scores are integers: components become ``floor(scale * x)`` and products are summed in doubles while these
are exact, else in whole numbers, cut to 64 bits.

Odd rows: rows with a null id, label or vector, or with a null or non-finite component, take no part; ids are
whole numbers; vectors of different lengths have no score with each other; zero and empty vectors score 0.
Rows that repeat an id are rows of their own, also to each other. No rows or no anchors give no rows. Only the
named columns are looked at, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from plumbline.llm.common import hot_join, write_stage

#: Most rows of a leaf, of anchors and of candidates.
ANCHOR_LEAF, LEAF = 256, 512
#: Halvings of a node in one round, rows that a node's directions are fitted on, rows that are dealt to children at a time.
BITS, SAMPLE, CHUNK = 5, 4096, 2048
#: Leaves of the first, narrow descent for each group of anchors; pairs of leaves scored in one group.
BEAM, PAIRS = 2, 128
LEAST, MOST = -(2**63) + 1, 2**63 - 1


def decoded(parts: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length, a row for each part."""
    whole = np.frombuffer(b"".join(parts), kind)
    return whole.reshape(len(parts), len(whole) // max(1, len(parts)))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows, cut to 64 bits."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    bound = np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * max(1, a.shape[1])
    if bound < 2.0**53:
        return (x @ y.T).astype(np.int64)
    if bound < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST, MOST).astype(np.int64)


def directions(x: np.ndarray, bits: int) -> np.ndarray:
    """``2**bits - 1`` splits in heap order, each a direction and a threshold (NaN where all rows are equal)."""
    out = np.full((2**bits - 1, x.shape[1] + 1), np.nan)
    held = {0: x}
    for k in range(len(out)):
        own = held.pop(k)
        centred = own - own.mean(axis=0) if len(own) else own
        if centred.any():
            main = centred[np.argmax((centred * centred).sum(axis=1))]
            for _ in range(8):
                main = main / np.abs(main).max()
                main = centred.T @ (centred @ main)
                main = main / np.linalg.norm(main) if main.any() else centred[np.argmax((centred * centred).sum(axis=1))]
            main = main / np.linalg.norm(main)
            along = own @ main
            out[k] = np.r_[main, np.median(along)]
            if not (along > out[k, -1]).any():
                out[k, -1] = along[along < along.max()].max(initial=-np.inf)
            right = along > out[k, -1]
        else:
            right = np.arange(len(own)) % 2 == 1
        held[2 * k + 1], held[2 * k + 2] = own[~right], own[right]
    return out


def children(x: np.ndarray, keys: np.ndarray, splits: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """The child of each row; equal rows are halved by a hash of their key that differs from depth to depth."""
    mixed = (keys.astype(np.uint64) + np.uint64(depth * 2 + 1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    at = np.zeros(len(x), np.int64)
    for k in range(bits):
        split = splits[at]
        by_hash = (mixed >> np.uint64(40 + k) & np.uint64(1)).astype(bool)
        along = np.einsum("ij,ij->i", x, np.nan_to_num(split[:, :-1]))
        at = 2 * at + 1 + np.where(np.isnan(split[:, -1]), by_hash, along > split[:, -1])
    return at - (2**bits - 1)


def parent_of(node: Column) -> Column:
    return F.when(node.contains("/"), F.regexp_replace(node, "/[^/]*$", ""))


def grow(rows: DataFrame, kind: str, leaves: tuple[int, int]) -> DataFrame:
    """``rows`` (``key, id, label, node, v``), each with a leaf below its ``node``; roots of anchors begin with ``a``."""
    done, depth = [], 0

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = decoded(pdf.v.tolist(), kind).astype(np.float64)
        return pd.DataFrame({"node": [pdf.node[0]], "model": [directions(x, int(pdf.bits[0])).tobytes()]})

    def deal(rows: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        out = rows[["key", "id", "label", "node", "v"]]
        if len(rows):
            x, bits = decoded(rows.v.tolist(), kind).astype(np.float64), int(rows.bits[0])
            empty = np.full((2**bits - 1, x.shape[1] + 1), np.nan)
            splits = np.frombuffer(models.model[0]).reshape(empty.shape) if len(models) else empty
            out = out.assign(node=[f"{n}/{c:02x}" for n, c in zip(rows.node, children(x, rows.key.to_numpy(), splits, bits, depth), strict=True)])
        return out

    while True:
        limit = F.when(F.col("node").startswith("a"), leaves[0]).otherwise(leaves[1])
        counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        bits = F.when(F.col("n") <= limit, 0).otherwise(F.least(F.lit(BITS), F.ceil(F.log2(F.col("n") / limit)).cast("int")))
        counts = write_stage(counts.withColumn("bits", bits), "counts")
        marked = hot_join(rows, counts, "node")
        done.append(marked.where("bits = 0").select("key", "id", "label", "node", "v"))
        if not counts.where("bits > 0").limit(1).count():
            break
        chunks = F.ceil(F.col("n") / CHUNK)
        split = write_stage(marked.where("bits > 0").withColumn("chunk", F.pmod(F.xxhash64("key"), chunks)), "split")
        sampled = split.where(F.pmod(F.xxhash64("key", F.lit(depth)), F.lit(1 << 32)) < F.lit(float(SAMPLE << 32)) / F.col("n"))
        models = write_stage(sampled.groupBy("node").applyInPandas(fit, "node string, model binary"), "models")
        spread = models.join(counts, "node").select("node", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), "model")
        dealt = split.groupBy("node", "chunk").cogroup(spread.toDF("to", "part", "model").groupBy("to", "part")).applyInPandas(deal, rows.schema)
        rows, depth = write_stage(dealt, "dealt"), depth + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def packed(rows: DataFrame, kind: str) -> DataFrame:
    """A row for each leaf: its members by id, their ball and their vectors in one piece."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "key"])
        m = decoded(pdf.v.tolist(), kind)
        centre = m.astype(np.float64).mean(axis=0)
        far = np.sqrt(((m - centre) ** 2).sum(axis=1).max())
        return pd.DataFrame({"node": [pdf.node.iloc[0]], "n": [len(pdf)], "key": [pdf.key.to_numpy()], "id": [pdf.id.to_numpy()], "label": [pdf.label.to_numpy()], "m": [m.tobytes()], "centre": [centre.tobytes()], "radius": [far * (1 + 1e-9)]})

    return rows.groupBy("node").applyInPandas(pack, "node string, n long, key array<long>, id array<long>, label array<string>, m binary, centre binary, radius double")


def balls(leaves: DataFrame) -> tuple[DataFrame, int]:
    """``node, parent, leaf, centre, radius`` of leaves and of all nodes above them, and the greatest depth."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        centres, n = decoded(pdf.centre.tolist(), "f8"), pdf.n.to_numpy()
        centre = (centres * n[:, None]).sum(axis=0) / n.sum()
        far = (np.sqrt(((centres - centre) ** 2).sum(axis=1)) + pdf.radius.to_numpy()).max()
        return pd.DataFrame({"node": [pdf.parent.iloc[0]], "n": [n.sum()], "centre": [centre.tobytes()], "radius": [far * (1 + 1e-9)]})

    depth = F.size(F.split("node", "/")) - 1
    flat = leaves.select("node", "n", "centre", "radius", F.lit(True).alias("leaf"), depth.alias("depth"), parent_of(F.col("node")).alias("parent"))
    deepest = flat.agg(F.max("depth")).first()[0] or 0
    every, above = flat, None
    for d in range(deepest, 0, -1):
        own = flat.where(F.col("depth") == d)
        own = own if above is None else own.unionByName(above)
        merged = own.select("parent", "n", "centre", "radius").groupBy("parent").applyInPandas(merge, "node string, n long, centre binary, radius double")
        above = write_stage(merged, "balls").withColumns({"leaf": F.lit(False), "depth": F.lit(d - 1), "parent": parent_of(F.col("node"))})
        every = every.unionByName(above)
    return every.select("node", "parent", "leaf", "centre", "radius"), deepest


def intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The interval of all inner products between two balls: its middle and half its width."""
    for pdf in batches:
        mid, half = np.zeros(len(pdf)), np.zeros(len(pdf))
        sizes = pdf.a_centre.map(len).to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            a, c = (decoded(pdf[f"{s}_centre"].iloc[at].tolist(), "f8") for s in "ac")
            ra, rc = (pdf[f"{s}_radius"].to_numpy()[at] for s in "ac")
            mid[at] = np.einsum("ij,ij->i", a, c)
            norm_a, norm_c = np.linalg.norm(a, axis=1), np.linalg.norm(c, axis=1)
            half[at] = (norm_a * rc + norm_c * ra + ra * rc + 1e-9 * norm_a * norm_c) * (1 + 1e-9) + 1e-6
        yield pdf[["a", "c", "a_leaf", "c_leaf", "low", "high"]].assign(mid=mid, half=half)


def below(nodes: DataFrame, side: str, extra: list[str]) -> DataFrame:
    """``up`` and the nodes one step below it (a leaf is below itself), columns named for a side of the pairs."""
    columns = [F.col("node").alias(side), F.col("leaf").alias(f"{side}_leaf"), F.col("centre").alias(f"{side}_centre"), F.col("radius").alias(f"{side}_radius"), *extra]
    stay = nodes.where("leaf").select(F.col("node").alias(f"{side}_up"), *columns)
    return nodes.where("parent is not null").select(F.col("parent").alias(f"{side}_up"), *columns).unionByName(stay)


def descend(nodes: DataFrame, limits: DataFrame, by_label: bool, depth: int, beam: int | None) -> DataFrame:
    """Pairs ``(a, c)`` of leaves that may hold scores from ``low`` to ``high`` of ``limits`` (by leaf of anchors).

    With ``beam`` only so many of the nodes most alike (or nearest to ``high``) stay for each node of anchors.
    """
    parts = F.split("node", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    wanted = limits.select(F.explode(ups).alias("node"), "low", "high").groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    mine = F.substring_index("node", "/", 1).rlike(r"\.." if by_label else r"\.$")
    anchors = write_stage(nodes.where(F.col("node").startswith("a") & mine).join(wanted, "node"), "anchors")
    others = nodes.where(F.col("node").startswith("c") & mine)
    root = F.substring("node", 2, 1000)
    pairs = anchors.where("parent is null").select(F.col("node").alias("a"), root.alias("root")).join(others.where("parent is null").select(F.col("node").alias("c"), root.alias("root")), "root").drop("root")
    step_a, step_c = below(anchors, "a", ["low", "high"]), below(others, "c", [])
    for _ in range(max(1, depth)):
        met = pairs.toDF("a_up", "c_up").join(step_a, "a_up").join(step_c, "c_up")
        found = met.mapInPandas(intervals, "a string, c string, a_leaf boolean, c_leaf boolean, low double, high double, mid double, half double")
        found = found.where((F.col("mid") + F.col("half") >= F.col("low")) & (F.col("mid") - F.col("half") <= F.col("high")))
        if beam:
            liked = F.when(F.col("high") < float(MOST), -F.abs(F.col("mid") - F.col("high"))).otherwise(F.col("mid"))
            found = found.withColumn("place", F.row_number().over(W.Window.partitionBy("a").orderBy(F.desc(liked), "c"))).where(F.col("place") <= beam)
        pairs = write_stage(found.select("a", "c"), "pairs")
    return pairs


def scored(pairs: DataFrame, anchors: DataFrame, leaves: DataFrame, kind: str, best: int, same_label: bool, low: int, high: int) -> DataFrame:
    """``key, j, score, id, other``: the best rows of each group of leaf pairs, ``best`` for each anchor and entry of ``needs``.

    ``needs`` holds positives' scores, an entry each; where it is null all scores count.
    """

    def thresholds(needs: list, n: int) -> tuple[np.ndarray, np.ndarray]:
        if needs is None:
            return np.full((n, 1), LEAST), np.full((n, 1), MOST)
        lo, hi = np.full((n, max(map(len, needs))), MOST), np.full((n, max(map(len, needs))), LEAST)
        for i, own in enumerate(needs):
            for j, s in enumerate(own):
                lo[i, j], hi[i, j] = limit(int(s), low, high)
        return lo, hi

    def score(others: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = {n: [] for n in ("key", "j", "score", "id", "other")}
        if len(own) and len(others):
            a, keys, labels = decoded_leaf(own.iloc[0], kind)
            lo, hi = thresholds(own.needs.iloc[0], len(a))
            shape = (*lo.shape, best)
            top, ids, near = np.full(shape, LEAST - 1), np.zeros(shape, np.int64), np.full(shape, -1)
            norms, line = np.linalg.norm(a.astype(np.float64), axis=1), np.arange(len(a))
            for _, row in others.iterrows():
                centre, radius = np.frombuffer(row.centre), row.radius
                reach = a.astype(np.float64) @ centre + norms * radius * (1 + 1e-9) + 1e-9 * norms * np.linalg.norm(centre) + 1e-6
                if (reach[:, None] < np.maximum(top[..., -1], lo)).all():
                    continue
                c, c_keys, c_labels = decoded_leaf(row, kind)
                c_ids = np.asarray(row.id)
                codes = pd.factorize(np.concatenate([labels, c_labels]))[0]
                able = codes[: len(a), None] == codes[None, len(a) :]
                able = able & (keys[:, None] != c_keys[None, :]) if same_label else ~able
                s = inner(a, c)
                for j in range(shape[1]):
                    left = np.where(able & (s >= lo[:, j, None]) & (s <= hi[:, j, None]), s, LEAST - 1)
                    new = np.full((3, len(a), best), LEAST - 1)
                    new[2] = -1
                    for t in range(min(best, left.shape[1])):
                        at = left.argmax(axis=1)
                        value = left[line, at]
                        ok = value >= LEAST
                        if not ok.any():
                            break
                        new[0][ok, t], new[1][ok, t], new[2][ok, t] = value[ok], c_ids[at[ok]], c_keys[at[ok]]
                        left[line, at] = LEAST - 1
                    merged = [np.concatenate([x[:, j], y], axis=1) for x, y in zip((top, ids, near), new, strict=True)]
                    order = np.lexsort((merged[2], merged[1], ~merged[0]), axis=-1)[:, :best]
                    for x, y in zip((top, ids, near), merged, strict=True):
                        x[:, j] = np.take_along_axis(y, order, axis=1)
            i, j, t = np.nonzero(near >= 0)
            out = {"key": keys[i], "j": j, "score": top[i, j, t], "id": ids[i, j, t], "other": near[i, j, t]}
        return pd.DataFrame({n: np.asarray(v, np.int64) for n, v in out.items()})

    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).alias("groups"))
    dealt = pairs.join(groups, "a").select("a", "c", F.pmod(F.xxhash64("c"), F.col("groups")).alias("part"))
    right = dealt.join(leaves, F.col("c") == F.col("node")).select("a", "part", "key", "id", "label", "m", "centre", "radius").toDF("c_a", "c_part", "key", "id", "label", "m", "centre", "radius")
    left = dealt.select("a", "part").distinct().join(anchors, F.col("a") == F.col("node")).select("a", "part", "key", "label", "m", "needs")
    return right.groupBy("c_a", "c_part").cogroup(left.groupBy("a", "part")).applyInPandas(score, "key long, j long, score long, id long, other long")


def decoded_leaf(row: pd.Series, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.asarray(row.key)
    whole = np.frombuffer(row.m, kind)
    return whole.reshape(len(keys), len(whole) // len(keys)), keys, np.asarray(row.label, object)


def limit(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest whole number s with ``low * score <= 100 * s <= high * score``."""
    return max(LEAST, -(-low * score // 100)), min(MOST, high * score // 100)


def best_rows(found: DataFrame, best: int) -> DataFrame:
    """The ``best`` of each anchor's entry by score, id and row, with their ``place`` from 1."""
    order = W.Window.partitionBy("key", "j").orderBy(F.desc("score"), "id", "other")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= best)


def search(nodes: DataFrame, depth: int, anchors: DataFrame, leaves: DataFrame, entries: DataFrame, kind: str, best: int, by_label: bool, low: int = 0, high: int = 0) -> DataFrame:
    """The ``best`` rows of every entry (``node, key, j, low, high``): a narrow descent, then the full one with its thresholds."""
    limits = entries.groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    first = write_stage(descend(nodes, limits, by_label, depth, BEAM), "first")
    seeds = write_stage(scored(first, anchors, leaves, kind, best, by_label, low, high), "seeds")
    kth = seeds.groupBy("key", "j").agg(F.count(F.lit(1)).alias("found"), F.sort_array(F.collect_list("score"), False).alias("scores"))
    kth = kth.select("key", "j", F.when(F.col("found") >= best, F.element_at("scores", best)).cast("double").alias("kth"))
    reached = entries.join(kth, ["key", "j"], "left").withColumn("low", F.greatest("low", "kth"))
    limits = write_stage(reached.groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high")), "limits")
    rest = descend(nodes, limits, by_label, depth, None).join(first, ["a", "c"], "left_anti")
    rest = scored(write_stage(rest, "rest"), anchors, leaves, kind, best, by_label, low, high)
    return write_stage(best_rows(seeds.unionByName(rest), best), "best")


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, leaves: tuple[int, int] = (ANCHOR_LEAF, LEAF)) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor's positives are its ``positives`` best other rows of its label; for each, the ``negatives``
    best rows of other labels with ``low * positive_score <= 100 * negative_score <= high * positive_score``.
    Higher scores come first, ties by smaller id.
    """
    whole = F.transform(f"`{vector_col}`", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    finite = F.forall(f"`{vector_col}`", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), whole.alias("v"), finite.alias("finite"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where("finite and id is not null and label is not null").drop("finite")
    peak = rows.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v") - 1))).first()[0] or 0
    kind = "<i2" if peak < 1 << 15 else "<i4" if peak < 1 << 31 else "<i8"

    def binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(3)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.r_[0, np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))] * flat.itemsize
            data = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], data, *batch.columns[4:]], ["key", "id", "label", "v", "size", "anchor"])

    rows = rows.select(F.monotonically_increasing_id().alias("key"), "id", "label", "v", F.size("v").alias("size"), "anchor")
    rows = write_stage(rows.mapInArrow(binary, "key long, id long, label string, v binary, size int, anchor boolean"), "vectors")
    sides = F.when(F.col("anchor"), F.array(F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("c")))
    rooted = rows.withColumn("side", F.explode(sides)).withColumn("by", F.explode(F.array(F.lit(""), F.md5(F.col("label").cast("binary")))))
    rooted = rooted.select("key", "id", "label", F.concat("side", F.col("size").cast("string"), F.lit("."), "by").alias("node"), "v")
    tree = write_stage(packed(grow(write_stage(rooted, "rooted"), kind, leaves), kind), "leaves")
    nodes, depth = balls(tree)
    nodes = write_stage(nodes, "nodes")
    candidates = tree.where(F.col("node").startswith("c"))
    by_label = F.col("node").startswith("a") & F.substring_index("node", "/", 1).rlike(r"\..")
    owners = tree.where(by_label).withColumn("needs", F.lit(None).cast("array<array<long>>"))
    entries = owners.select("node", F.explode("key").alias("key"), F.lit(0).cast("long").alias("j"), F.lit(float(LEAST)).alias("low"), F.lit(float(MOST)).alias("high"))
    found = search(nodes, depth, owners, candidates, entries, kind, positives, True)
    need = found.select("key", F.col("place").cast("long").alias("j"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))

    mixed = tree.where(F.col("node").startswith("a") & ~by_label)
    members = mixed.select("node", F.posexplode("key").alias("pos", "key"))
    sorted_needs = need.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "positive_score"))), lambda x: x["positive_score"]).alias("own"))
    held = members.join(sorted_needs, "key", "left").select("node", F.struct("pos", F.coalesce("own", F.array().cast("array<long>")).alias("own")).alias("need"))
    held = held.groupBy("node").agg(F.transform(F.sort_array(F.collect_list("need")), lambda x: x["own"]).alias("needs"))
    owners = write_stage(mixed.join(held, "node"), "owners")
    bound = lambda percent: F.col("positive_score").cast("double") * (percent / 100)
    slack = F.abs("positive_score") * 1e-9 + 1
    entries = members.join(need, "key").select("node", "key", (F.col("j") - 1).alias("j"), (bound(low) - slack).alias("low"), (bound(high) + slack).alias("high"))
    hard = search(nodes, depth, owners, candidates, write_stage(entries, "entries"), kind, negatives, False, low, high)
    named = need.join(rows.select("key", F.col("id").alias("anchor_id")), "key").withColumn("j", F.col("j") - 1)
    joined = hard.select("key", "j", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["key", "j"])
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
