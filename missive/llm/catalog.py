"""Registered queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.llm import (bpe, centroids, chat, exact, jaccard, langid, lexical, licenses, mixing, outliers, quality, secrets,
                         warc)
from missive.llm.common import read

#: A conversation whose texts consist of control strings (fixed value).
PLANTED = "</s>[INST] ok [/INST]"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    nodes = chat.conversation_nodes(rows.unionByName(planted))
    digest = chat.chat_digest(chat.format_paths(nodes)).withColumnRenamed("tree", "conv_id")
    return digest.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(read(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("__key")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality_rules(read(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(read(spark, sf_dir, "documents")).drop("times")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.centroid_clusters(read(spark, sf_dir, "embeddings")))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_digest(spark, warc.archive_pages(read(spark, sf_dir, "pages")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_chat_formatting, op2_license_scan, op3_language_id, op4_quality_classifier, op5_byte_bpe, op6_quality_rules,
    op7_secret_scan, op8_exact_dedup, op9_ngram_jaccard, op10_mixing, op11_lexical_search, op12_centroid_clustering,
    op13_warc, pipeline)}



def _clustering_sql(dims: int = 64, k: int = 16, rounds: int = 3) -> str:
    """SQL that computes all distances anew in each round."""
    steps = [f"""
kept AS (
  SELECT vec_id, row_number() OVER () AS row, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x::DOUBLE))) = {dims}),
c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v
  FROM (SELECT v, sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h FROM kept ORDER BY h, v LIMIT {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS (
  SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min((d, k)) AS best
  FROM (SELECT n.row, n.vec_id, n.v, c.k, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(n.v, c.v)])::BIGINT AS d
        FROM kept n CROSS JOIN c{r} c) GROUP BY row)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT k, list(m ORDER BY i) AS v
  FROM (SELECT best[2] AS k, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS m FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY 1, 2)
  GROUP BY k),
c{r + 1} AS (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON c.k = m.k)""")
    return f"""
WITH {','.join(steps)}
SELECT a.vec_id, a.best[2]::INTEGER AS cluster, a.best[1] AS distance, sum(a.best[1]) OVER (PARTITION BY a.best[2])::BIGINT AS cluster_inertia,
       sum(a.best[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.best[2] = c.k"""


ORACLE = {
    "op11_lexical_search": r"""
WITH terms AS (
  SELECT row, doc_id, unnest(words) AS term, len(words)::BIGINT AS n
  FROM (SELECT row_number() OVER () AS row, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents)),
held AS (SELECT row, any_value(doc_id) AS doc_id, term, any_value(n) AS n, count(*)::BIGINT AS tf FROM terms GROUP BY row, term),
whole AS (SELECT count(DISTINCT row)::BIGINT AS docs, count(*)::BIGINT AS words FROM terms),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
           FROM held, whole GROUP BY term),
asked AS (
  SELECT item, any_value(item_id) AS item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item, item_id,
               unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)) GROUP BY item, term),
scored AS (
  SELECT item, any_value(item_id) AS item_id, row, any_value(doc_id) AS doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // words)))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weight USING (term), whole GROUP BY item, row)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, row) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10""",
    "op12_centroid_clustering": _clustering_sql(),
    "op13_warc": r"""
WITH page AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS sha, row_number() OVER () AS row, url
  FROM pages),
bits AS (
  SELECT *, array_to_string([lpad(bin(('0x' || c)::INTEGER), 4, '0') FOR c IN string_split(sha, '')], '') AS b,
         first_value(row) OVER g AS head, first_value(page_id) OVER g AS head_id
  FROM page WINDOW g AS (PARTITION BY sha, payload_bytes ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST, row))
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ('0b' || substr(b, (i * 5 + 1)::INTEGER, 5))::INTEGER + 1, 1)
                        FOR i IN range(0, 32)], '') AS payload_digest,
       CASE WHEN row = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN row = head THEN NULL ELSE head_id END AS refers_to
FROM bits""",
    "op1_chat_formatting": r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (
  SELECT *, regexp_replace(regexp_replace(text, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g') AS body,
         regexp_replace(regexp_replace(role, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g') AS head
  FROM said)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<s>[INST]') + length(head) + length('[/INST]') + length(body) + length('</s>'))::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id""",
    "op8_exact_dedup": r"""
WITH prints AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AND row_number() OVER (PARTITION BY text_sha256, doc_id) = 1 AS kept,
       text_sha256
FROM prints WINDOW g AS (PARTITION BY text_sha256)""",
    "op10_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15) AS hash
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
fill AS (
  SELECT *, 2.0 * source_size / weight AS ratio,
         (1.5 * sum(source_size) OVER ()
          - coalesce(sum(2.0 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per WINDOW w AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST)),
target AS (
  SELECT source, source_size,
         coalesce(least(2.0 * source_size, weight * (SELECT level FROM fill WHERE ratio > level ORDER BY ratio LIMIT 1)),
                  2.0 * source_size)::DOUBLE AS target
  FROM fill),
need AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM target),
units AS (
  SELECT source, hash, sum(size) AS words FROM sized GROUP BY source, hash),
run AS (
  SELECT source, hash, words, sum(words) OVER (PARTITION BY source ORDER BY hash) AS after FROM units),
cut AS (
  SELECT r.source, r.hash,
         r.after - (n.target - n.copies * n.source_size) < (n.target - n.copies * n.source_size) - (r.after - r.words) AS taken
  FROM run r JOIN need n ON r.source IS NOT DISTINCT FROM n.source
  WHERE r.after - r.words <= n.target - n.copies * n.source_size AND r.after > n.target - n.copies * n.source_size)
SELECT s.doc_id, s.size, n.source_size, n.target,
       (s.size * (n.copies + CASE WHEN s.hash < c.hash OR (s.hash = c.hash AND c.taken) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN need n ON s.source IS NOT DISTINCT FROM n.source
LEFT JOIN cut c ON s.source IS NOT DISTINCT FROM c.source""",
}
