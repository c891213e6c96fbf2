"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, embedding, hard_negatives, importance, language, lm, mixing, packing, secrets, simhash, suffixes, url_filter, warc

# The URL rules of the contract, as verdict, host and path.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bucket(n: int):
    """crc32 of the id as text, modulo n (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.95."""
    return embedding.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents at 95 % of the uniform entropy, each source at most four times."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "source", "n_tokens", "epoch", "block", "slot")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text, with structurally confirmed keys and tokens among the spans."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a repeated 400-byte string covers, and the digest of the rest.

    ``n_shared`` reports shorter passages (250 bytes, about fifty words) that repeat too; they stay.
    """
    found = suffixes.repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"), shared=250)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "n_shared")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item it holds within a tenth of the item's characters in edits."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and maximum-entropy scores of all documents; one residue of seven is held out."""
    return lm.score_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), _bucket(7) == 2)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: three-word shingles, three bits."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from two thirds of the labelled ones."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", _bucket(3) == 1)
    prototypes = language.learn_prototypes(docs.where("not held_out"))
    return language.predict_language(docs.drop("lang"), prototypes).select("doc_id", "held_out", "lang_pred", "score")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the host-suffix and path-prefix rules on every page's URL."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge_urls(pages, url_filter.rules_frame(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records, read back, with their revisits."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "body_ok")


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of every document towards the benchmark's words, and the ranks of the tenth that is drawn."""
    docs, target = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("text")
    found = importance.importance(docs, target, max_order=1, buckets=10_000, seed=2024, least_words=20, percent=10)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 2048 tokens and their places in as few sequences."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, end_id=0)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests, 2048, ["doc_id", "piece"])


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, for each of its five best positives."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95, scale=256.0)


_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)

OP9_SQL = rf"""
WITH rules(verdict, h, p) AS (VALUES {_RULES_SQL}),
u AS (
  SELECT page_id, url, row_number() OVER () AS k,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
best AS (
  SELECT k, max(struct_pack(n := length(h || p), rule := h || p, verdict := verdict)) AS b
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY k)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM u LEFT JOIN best USING (k)
"""


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS s,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
t AS (SELECT s, sum(n_tokens)::BIGINT AS t FROM d GROUP BY s HAVING sum(n_tokens) > 0),
p AS (SELECT s, t, t::DOUBLE / (SELECT sum(t) FROM t)::DOUBLE AS p FROM t),
g AS (
  SELECT k, sum(pow(p, k / 1048576.0::DOUBLE)) AS z, sum(pow(p, k / 1048576.0::DOUBLE) * ln(p)) AS y,
    max(pow(p, k / 1048576.0::DOUBLE - 1)) AS r
  FROM range(0, 1048577) AS x(k), p GROUP BY k),
a AS (
  SELECT greatest(
    coalesce(max(k) FILTER (ln(z) - k / 1048576.0::DOUBLE * y / z >= 0.95 * (SELECT ln(count(*)) FROM p)), 0),
    coalesce(min(k) FILTER (r / z <= 4.0), 1048576)) / 1048576.0::DOUBLE AS a FROM g),
q AS (
  SELECT s, t, round(pow(p, a) / (SELECT sum(pow(p, a)) FROM p, a) * (SELECT sum(t) FROM t))::BIGINT AS quota FROM p, a),
e AS (
  SELECT d.*, t, quota, quota // t AS w, quota - quota // t * t AS rest, unnest(range(0, quota // t + 1)) AS epoch
  FROM d JOIN q USING (s)),
h AS (
  SELECT *, ('0x' || substr(md5('17|' || epoch || '|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS slot FROM e),
o AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY s, epoch ORDER BY slot, doc_id, n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM h),
b AS (SELECT greatest(1, ceil((SELECT sum(t) FROM t) / 1000000.0))::BIGINT AS n)
SELECT doc_id, source, n_tokens, epoch, least(floor((epoch * t + start) * n / quota)::BIGINT, n - 1) AS block, slot
FROM o, b WHERE epoch < w OR start < rest
"""

OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
l AS (SELECT digest, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to,
  CASE WHEN last IS NULL OR page_id = last THEN true END AS body_ok
FROM p LEFT JOIN l USING (digest)
"""

OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
e AS (SELECT k, unnest(w) AS w FROM d),
crc_table AS (
  SELECT list(c ORDER BY i) AS c FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS r(i))),
bytes AS (
  SELECT w, list_transform(range(length(hex(w)) // 2), lambda i: ('0x' || substr(hex(w), (2 * i + 1)::INT, 2))::BIGINT) AS x
  FROM (SELECT w FROM e UNION SELECT w FROM b)),
code AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, x), lambda a, y: xor(a >> 8, c[xor(a & 255, y) + 1]))) % 10000 AS bucket
  FROM bytes, crc_table),
s AS (SELECT bucket, count(*) AS s FROM e JOIN code USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN code USING (w) GROUP BY bucket),
gain AS (
  SELECT x.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM e) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) AS x(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weight AS (SELECT k, count(*) AS n, sum(gain)::BIGINT AS g FROM e JOIN code USING (w) JOIN gain USING (bucket) GROUP BY k),
score AS (
  SELECT k, doc_id, coalesce(n, 0) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM d LEFT JOIN weight USING (k)),
ranked AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) END AS r FROM score)
SELECT doc_id, n_features, weight, weight + noise AS score,
  CASE WHEN r <= 10 * (SELECT count(*) FROM score WHERE n_features >= 20) // 100 THEN r END AS rank
FROM ranked
"""

OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.k AS a, a.vec_id AS anchor_id, b.k AS b, b.vec_id, a.label = b.label AS same,
    CASE WHEN len(a.e) = 0 THEN 0 ELSE list_inner_product(a.e, b.e) END::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.k <> b.k AND len(a.e) = len(b.e)),
p AS (
  SELECT a, anchor_id, b AS p, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.p ORDER BY score DESC, vec_id)::INT AS rank
  FROM p JOIN s ON p.a = s.a AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
  least(vec_id, (SELECT min(b) FROM reach WHERE a = vec_id)) AS component_id,
  vec_id <= coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id) AS kept
FROM embeddings
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline: language ID, near-dedup, decontamination, secret masks, mixture."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_embedding_dedup": op1_embedding_dedup,
        "op2_mix_sources": op2_mix_sources,
        "op3_secret_scan": op3_secret_scan,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_decontaminate": op5_decontaminate,
        "op6_lm_score": op6_lm_score,
        "op7_simhash": op7_simhash,
        "op8_language_id": op8_language_id,
        "op9_url_filter": op9_url_filter,
        "op10_warc": op10_warc,
        "op11_importance_resample": op11_importance_resample,
        "op12_best_fit_packing": op12_best_fit_packing,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": OP1_SQL, "op2_mix_sources": OP2_SQL, "op9_url_filter": OP9_SQL, "op10_warc": OP10_SQL, "op11_importance_resample": OP11_SQL, "op13_hard_negatives": OP13_SQL}
