"""Registered queries of the training-data operators, and check SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelab.llm import (
    byte_shards, centroid_clusters, curriculum, decontaminate, fingerprint, html_extract, jaccard_join, language_spans, quality_rules, suffix_dedup,
    token_alignment, token_counts, token_store,
)
from pipelab.session import scratch_path

END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_size() -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).get_vocab_size()


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), out, tokenizer_path(), END_ID, vocabulary_size())
    return token_store.read_documents(spark, out)


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_neighbours(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, share=85)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.fit_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.with_quality(docs, model).select(
        "doc_id",
        quality_rules.is_held_out(F.col("doc_id")).alias("held_out"),
        F.col("rule_score").alias("score"),
        F.col("rule_label").alias("predicted"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = html_extract.fit_content_model(html_extract.labelled_pages())
    return html_extract.extract_pages(table(spark, sf_dir, "pages"), model)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = quality_rules.is_held_out(F.col("doc_id"))
    model = language_spans.fit_languages(docs.filter(~held_out))
    return language_spans.label_languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, in the order in which the curriculum first comes to it; its check SQL fixes the columns."""
    ordered = curriculum.documents_in_order(curriculum.plan_mixture(table(spark, sf_dir, "documents")))
    return ordered.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.size("mix_positions") * F.col("mix_size")).alias("taken"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "token-alignment")
    token_alignment.write_alignment(table(spark, sf_dir, "documents"), out, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return token_alignment.measured_documents(spark, out)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards.balanced_shards(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_fingerprint": op2_fingerprint,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_counts": op5_token_counts,
    "op6_curriculum": op6_curriculum,
    "op7_html_extract": op7_html_extract,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_language_spans": op9_language_spans,
    "op10_decontaminate": op10_decontaminate,
    "op11_token_alignment": op11_token_alignment,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_byte_shards": op13_byte_shards,
}


def _cluster_rounds(rounds: int) -> str:
    """CTEs ``at0``, ``c0`` and so on: nearest centroid of every vector, and the centroids after that round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS (SELECT v.vec_id, c.n, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{k} c),
at{k} AS (SELECT vec_id, CAST(arg_min(n, [CAST(d AS BIGINT), n]) AS INT) AS cluster, CAST(min(d) AS BIGINT) AS distance FROM d{k} GROUP BY vec_id)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT a.cluster, i.i, CAST(floor(sum(v.x[i.i]) / count(*)) AS BIGINT) AS m FROM at{k} a JOIN v ON a.vec_id = v.vec_id, (SELECT unnest(range(1, 65)) AS i) i GROUP BY a.cluster, i.i),
c{k + 1} AS (SELECT c.n, coalesce((SELECT list(m ORDER BY i) FROM s{k} WHERE cluster = c.n), c.x) AS x FROM c{k} c)""")
    return ",\n".join(steps)


CHECK_SQL = {
    "op12_centroid_clusters": f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256(concat('2:', vec_id))) - 1 AS n, x FROM (SELECT * FROM v ORDER BY sha256(concat('2:', vec_id)) LIMIT 40)),
{_cluster_rounds(centroid_clusters.ROUNDS)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM at{centroid_clusters.ROUNDS} JOIN c{centroid_clusters.ROUNDS} c ON cluster = c.n""",
    "op13_byte_shards": r"""
WITH t AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS tab),
sized AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 16 AS BIGINT) AS size,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
                         lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, t),
placed AS (
  SELECT *, CAST(sum(size) OVER w - size AS BIGINT) AS ahead, CAST(sum(size) OVER () AS BIGINT) AS total, row_number() OVER w AS place
  FROM sized WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cut AS (SELECT *, CAST(((2 * ahead + size) * 40) // (2 * total) AS INT) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM cut""",
    "op6_curriculum": r"""
WITH sized AS (
  SELECT doc_id, source, text, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         CAST(source_size * 3 AS DOUBLE) AS most FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0.0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0::DOUBLE)) AS level
  FROM weighted WINDOW b AS (ORDER BY most / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(most, (SELECT max(level) FROM levels) * w) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size, s.text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
         least(3, floor(t.target / nullif(t.source_size, 0))) AS passes
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0
            ELSE (passes + CASE WHEN passes < 3 AND ahead + size / 2.0::DOUBLE <= target - passes * source_size THEN 1 ELSE 0 END) * size END AS BIGINT) AS taken
FROM placed""",
}
