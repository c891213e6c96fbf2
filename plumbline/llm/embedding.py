"""Embedding near-duplicates by product quantisation.

Unit vectors go to coarse inverted lists (k-means); each list member keeps the residual's subspace
codes and the exact length of what the codes leave out. A query probes every list whose centroid is
near enough, compares by asymmetric table lookups, keeps all members that the lookup distance and
the stored error cannot rule out, and reranks those by exact cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import connected_components, write_stage
from plumbline.llm.simhash import forest

#: Vectors that the index is fitted on, at most about this many (a hash sample of the distinct ones).
FIT_SAMPLE = 16_384
#: Coarse lists: one for every LIST_SIZE distinct vectors, up to MAX_LISTS.
LIST_SIZE, MAX_LISTS = 32, 1024
SUBSPACES, CODES = 16, 256
#: Lists that a query probes. Recall against brute force is measured in the tests.
PROBES = 12
#: Members and queries that meet in one task's block; larger lists are split.
BLOCK = 2048


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm on a bounded sample; empty clusters keep their centre."""
    k = max(1, min(k, len(x)))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, without those of x itself (same order of centres for each row)."""
    return (centres * centres).sum(axis=1)[None, :] - 2 * (x @ centres.T)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin(distances(x[i : i + 4096], centres), axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


class Quantiser:
    """Coarse centroids and one codebook for each subspace of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        self.coarse = kmeans(sample, lists)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.books = [kmeans(part, CODES, 4) for part in np.split(rest, SUBSPACES, axis=1)]

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals and the exact length of what they leave out."""
        parts = np.split(rest, SUBSPACES, axis=1)
        codes = np.stack([nearest(p, b) for p, b in zip(parts, self.books, strict=True)], axis=1).astype(np.uint8)
        back = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return codes, np.linalg.norm(rest - back, axis=1)

    def lookup(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances between query residuals and coded members."""
        out = np.zeros((len(rest), len(codes)), np.float32)
        for m, (part, book) in enumerate(zip(np.split(rest, SUBSPACES, axis=1), self.books, strict=True)):
            table = distances(part, book) + (part * part).sum(axis=1)[:, None]
            out += table[:, codes[:, m]]
        return out


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(blobs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Double vectors padded to ``width`` and their true dimensions."""
    dims = np.array([len(b) // 8 for b in blobs], np.int64)
    out = np.zeros((len(blobs), width))
    for i, b in enumerate(blobs):
        out[i, : dims[i]] = np.frombuffer(b, np.float64)
    out /= np.maximum(np.abs(out).max(axis=1, keepdims=True), 1e-300)  # keeps squares in range
    return out / np.linalg.norm(out, axis=1, keepdims=True), dims


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row of ``vectors``.

    Two rows link when their vectors' cosine in double precision is at least ``threshold``;
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id reachable
    (its own included) and ``kept`` says whether that is the row's own id.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an
    id, link with nothing: no links, their own id as component. Vectors of different length never
    link. Equal vectors are one class for the search, so copies are never paired with each other;
    they count as links of one another. Rows that share an id count as one node and each as a link
    of the others it meets. An empty table gives an empty result; other columns are not carried.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(usable(F.col("v")) & F.col("id").isNotNull(), F.col("v")))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("copies"))
    classes = write_stage(classes, "vectors")
    n, width = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if n:
        found = write_stage(_links(classes, n, -(-width // SUBSPACES) * SUBSPACES, threshold), "vector-links")
        counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("more"))
        roots = connected_components(found.where("b is not null").select("a", "b"))
    else:
        counts = spark.createDataFrame([], "cid long, more long")
        roots = spark.createDataFrame([], "node long, component long")
    classes = (
        classes.join(counts, "cid", "left")
        .join(roots, F.col("cid") == F.col("node"), "left")
        .select("v", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("component", "cid").alias("root"))
    )
    out = rows.join(classes, "v", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _links(classes: DataFrame, n: int, width: int, threshold: float) -> DataFrame:
    """Rows (a, null, number of links of a) and the edges (a, b, 0) of forests that join all links."""
    sc = classes.sparkSession.sparkContext
    share = min(1.0, FIT_SAMPLE / n)
    sample = classes.where(F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select("v").limit(2 * FIT_SAMPLE).toPandas()["v"]
    fitted, _ = unit([np.asarray(v, np.float64).tobytes() for v in sample] or [np.ones(1).tobytes()], width)
    model = sc.broadcast(Quantiser(fitted.astype(np.float32), max(1, min(MAX_LISTS, n // LIST_SIZE))))
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                blobs = [np.asarray(v, np.float64).tobytes() for v in batch.column("v").to_numpy(zero_copy_only=False)]
                x = unit(blobs, width)[0].astype(np.float32)
                d = distances(x, q.coarse)
                k = min(PROBES, d.shape[1])
                probes = np.argpartition(d, k - 1, axis=1)[:, :k]
                probes = np.take_along_axis(probes, np.argsort(np.take_along_axis(d, probes, 1), axis=1), 1).astype(np.int32)
                codes, error = q.encode(x - q.coarse[probes[:, 0]])
                probed = [p.tobytes() for p in probes]
                rank = np.tile(np.arange(k), len(x))
                take = pa.array(np.repeat(np.arange(len(x)), k))
                home = pa.array(rank == 0)
                cols = [pa.array(probes.ravel()), home, *(c.take(take) for c in (batch.column("cid"), batch.column("copies"), pa.array(blobs, pa.binary()), pa.array(probed, pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error.astype(np.float64))))]
                yield pa.RecordBatch.from_arrays(cols, ["list", "home", "cid", "copies", "v", "probes", "codes", "error"])

    dealt = classes.select("cid", "copies", "v").mapInArrow(deal, "list int, home boolean, cid long, copies long, v binary, probes binary, codes binary, error double")
    dealt = write_stage(dealt, "vector-lists")
    # At most MAX_LISTS rows, whatever the data.
    sizes = dealt.groupBy("list").agg(F.count_if("home").alias("members"), F.count(F.lit(1)).alias("queries"))
    sizes = sizes.select("list", F.ceil(F.col("members") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("queries") / BLOCK).cast("int").alias("qb"))
    salt = F.xxhash64("cid")
    spread = F.sequence(F.lit(0), F.col("mb") - 1)
    dealt = dealt.join(F.broadcast(sizes.where("mb > 0")), "list").withColumn("q", F.pmod(salt, F.col("qb")).cast("int")).withColumn("m", F.pmod(salt, F.col("mb")).cast("int"))
    as_query = dealt.select("list", F.explode(spread).alias("m"), "q", F.lit(False).alias("member"), "cid", "copies", "v", "probes", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("error"))
    as_member = dealt.where("home").select("list", "m", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), F.lit(True).alias("member"), "cid", "copies", "v", "probes", "codes", "error")

    def search(key: tuple, table: pa.Table) -> pa.Table:
        q = model.value
        own = key[0].as_py()
        member = table.column("member").to_numpy()
        queries, members = table.filter(pa.array(~member)), table.filter(pa.array(member))
        x, xdim = unit(members.column("v").to_pylist(), width)
        xid, xcopies = members.column("cid").to_numpy(), members.column("copies").to_numpy()
        codes = np.frombuffer(b"".join(members.column("codes").to_pylist()), np.uint8).reshape(len(x), SUBSPACES)
        error = members.column("error").to_numpy()
        xprobes = np.frombuffer(b"".join(members.column("probes").to_pylist()), np.int32).reshape(len(x), -1)
        y, ydim = unit(queries.column("v").to_pylist(), width)
        yid, ycopies = queries.column("cid").to_numpy(), queries.column("copies").to_numpy()
        yhome = np.frombuffer(b"".join(queries.column("probes").to_pylist()), np.int32).reshape(len(y), -1)[:, 0]
        more_x, more_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        ends_a, ends_b = [], []
        for at in range(0, len(y), 256):
            part = slice(at, at + 256)
            near = q.lookup((y[part] - q.coarse[own]).astype(np.float32), codes)
            i, j = np.nonzero(np.sqrt(np.maximum(near, 0)) <= radius + error[None, :] + 1e-3)
            i += at
            fits = (yid[i] != xid[j]) & (ydim[i] == xdim[j])
            i, j = i[fits], j[fits]
            if not len(i):
                continue
            fits = np.concatenate([np.einsum("ij,ij->i", y[i[s : s + 65536]], x[j[s : s + 65536]]) for s in range(0, len(i), 65536)]) >= threshold
            i, j = i[fits], j[fits]
            # The other direction finds the same pair if the member probes the query's list.
            once = ~(xprobes[j] == yhome[i][:, None]).any(axis=1)
            np.add.at(more_y, i, xcopies[j])
            np.add.at(more_x, j[once], ycopies[i[once]])
            lab = forest(i - at, j + 256, 256 + len(x))
            hit = np.flatnonzero(lab != np.arange(len(lab)))
            names = np.concatenate([yid[part], np.zeros(256 - len(yid[part]), np.int64), xid])
            ends_a.append(names[hit])
            ends_b.append(names[lab[hit]])
        a = np.concatenate([yid[more_y > 0], xid[more_x > 0], *ends_a])
        links = np.concatenate([more_y[more_y > 0], more_x[more_x > 0]])
        b = np.concatenate([np.zeros(0, np.int64), *ends_b])
        return pa.table({
            "a": pa.array(a, pa.int64()),
            "b": pa.concat_arrays([pa.nulls(len(links), pa.int64()), pa.array(b, pa.int64())]),
            "n": pa.array(np.concatenate([links, np.zeros(len(b), np.int64)]), pa.int64()),
        })

    return as_query.unionByName(as_member).groupBy("list", "m", "q").applyInArrow(search, "a long, b long, n long")
