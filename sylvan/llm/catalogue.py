"""The queries of this subpackage: each applies one operator to its whole table and keeps its digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sylvan.llm import mixing, neardup, packing, pii, quality, repair, rules, topk, toxicity, warc

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _bounds() -> str:
    return " AND ".join(f"{a} + {s} >= {lo!r}::DOUBLE * {b} AND {a} - {s} <= {hi!r}::DOUBLE * {b}" for _, a, b, lo, hi, s in rules.THRESHOLDS)


def _op3_sql() -> str:
    stop = ", ".join("'" + w + "'" for w in sorted({f(w) for w in rules.STOP_WORDS for f in (str, str.capitalize, str.upper)}))
    return rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT rid, i, list_aggregate(words[i:i + 4], 'string_agg', ' ') AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM base WHERE len(words) >= 5)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM win) WHERE n > 1),
cover AS (
  SELECT rid, sum(CASE WHEN gap IS NULL THEN 5 ELSE least(gap, 5) END)::BIGINT AS n
  FROM (SELECT rid, i - lag(i) OVER (PARTITION BY rid ORDER BY i) AS gap FROM hit) GROUP BY rid),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda w: w IN ({stop})))::BIGINT AS n_stop_words
  FROM base LEFT JOIN cover USING (rid)),
f AS (SELECT *, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_bounds()} AS kept FROM f
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    first = F.get("positions", F.lit(0))["position"]
    return plan.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position")).repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position")


OP8_SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS ord
  FROM documents),
rws AS (
  SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS pos FROM base),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM base GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][rank % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM src),
lv AS (
  SELECT *, cap / w AS fill,
         (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT source, source_size, rank % 3 AS turn,
         least(cap, coalesce((SELECT level FROM lv WHERE level <= fill ORDER BY fill, rank LIMIT 1) * w, cap)) AS target FROM lv),
p AS (
  SELECT rws.*, source_size, target, turn,
         greatest(0, least(size, floor(target + 0.5)::BIGINT - pos)) AS first_words,
         greatest(0, least(size, floor(target + 0.5)::BIGINT - source_size - pos)) AS again_words
  FROM rws JOIN t ON rws.source IS NOT DISTINCT FROM t.source),
y AS (
  SELECT *, (pos + first_words / 2.0::DOUBLE) / target AS y, [0.5, 1.0, 1.5][turn + 1]::DOUBLE AS w0, [1.0, 0.0, -1.0][turn + 1]::DOUBLE AS slope FROM p WHERE target > 0
  UNION ALL SELECT *, NULL, NULL, NULL FROM p WHERE target = 0)
SELECT doc_id, size, source_size, target, (first_words + again_words)::BIGINT AS taken,
       CASE WHEN first_words > 0 THEN least(1.0::DOUBLE, 2.0::DOUBLE * y / (w0 + sqrt(w0 * w0 + 2.0::DOUBLE * slope * y))) END AS first_position
FROM y
"""

def op5_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.through_files(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.through_archives(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    out = out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position")
    return out.repartitionByRange("position").sortWithinPartitions("position")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, regexp_extract(coalesce(url, ''), '^[a-z]+://([^/?#]*)([^?#]*)([?][^#]+)?', ['host', 'path', 'query']) AS u,
         strftime(TIMESTAMP '2020-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured
  FROM pages),
d AS (
  SELECT page_id, captured, octet_length(b)::BIGINT AS n, sha256(b) AS digest,
         list_aggregate(list_reverse(string_split(regexp_replace(lower(u.host), '^www[.]', ''), '.')), 'string_agg', ',') || ')' || lower(CASE WHEN u.path = '' THEN '/' ELSE u.path END || u.query) AS url_key
  FROM p),
m AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first, row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS position FROM d)
SELECT url_key, captured, position, page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to FROM m
"""


#: The key of the registered query; a production job brings its own secret.
PII_KEY = "op4-registered-query"


def op4_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op6_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {"op6_boosted_toxicity": op6_boosted_toxicity, "op9_random_indexing": op9_random_indexing, "op4_feistel_pii": op4_feistel_pii, "op10_index_merge": op10_index_merge, "op2_branch_and_bound": op2_branch_and_bound, "op1_dart_minhash": op1_dart_minhash, "op5_repair": op5_repair, "op7_packing": op7_packing, "op3_quality_rules": op3_quality_rules, "op8_mixing": op8_mixing}
SQL = {"op10_index_merge": OP10_SQL, "op2_branch_and_bound": OP2_SQL, "op3_quality_rules": _op3_sql(), "op8_mixing": OP8_SQL}
