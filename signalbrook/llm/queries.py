"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, decontamination, divergence, embedding_dedup, line_dedup, lm, mixing, quality, sharding, simhash, topk, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that match an earlier one (sets of words, Jaccard 0.8 or more): doc_id, n_lines, n_removed, removed (line, of_doc,
    of_line), text."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "removed", "text")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector: vec_id, n_links (others at cosine 0.9 or more), component_id, kept. See near_duplicates for vectors that take no part."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url: page_id, host, path, rule (or null), verdict (the rule's, else the model's), block_probability."""
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_probability")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, expected_grade (0 to 2), tail_probability (of grade 2), kept. Null and wordless texts are judged by the thresholds alone."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return quality.classify(docs, labels).select("doc_id", "expected_grade", "tail_probability", "kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in the mix: doc_id, size, source_size, target (of its source), taken (words, repeats counted)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, columns=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). Null texts are empty."""
    return lm.score_corpus(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 16 shards of near equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = sharding.assign_shards(rows, "size", ["doc_id", "text_crc32", "size"], 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of vectors whose id is divisible by 100 the 10 best others by integer inner product: query_id, rank, vec_id, score."""
    rows = topk.integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.exact_top_k(rows.where(F.col("id") % 100 == 0), rows, 10)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256. Null texts are empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip_digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, fingerprint (16 hex digits), component_id (null where the component has null ids only)."""
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of sources of a language and each source's first ten terms: lang, source, part, item, value, rank."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")), copies="copies")[0]


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_words, n_hit (words in windows of the benchmark), n_items, items_sha256 (of their ids), contaminated."""
    found = decontamination.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_sharding": op7_sharding,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_bpe": op9_bpe,
    "op10_simhash": op10_simhash,
    "op11_source_audit": op11_source_audit,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_decontamination": op13_decontamination,
}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL: dict[str, str] = {
    "op11_source_audit": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d
), kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10
), v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY 1
), g AS (SELECT DISTINCT lang, source FROM d
), c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3
), sums AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2
), p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (lang_n + 2)) // (lang_total + 2 * v) AS q
  FROM sums JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 3
), parts AS (
  SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
""",
    "op13_decontamination": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item, array_to_string(list_slice(w, i, i + 9), ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
), runs AS (
  SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)
), met AS (SELECT r, i, n, item FROM runs JOIN wins USING (n, win)
), hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM met) GROUP BY 1
), named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
""",
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9 ELSE FALSE END
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), part AS (SELECT a, min(b) AS b FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(part.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(part.b, vec_id)) AS kept
FROM embeddings LEFT JOIN part ON part.a = vec_id LEFT JOIN degree ON degree.a = vec_id
""",
    "op8_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.ints AS DOUBLE[]), CAST(c.ints AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
}
