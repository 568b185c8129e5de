"""The queries of the corpus operators over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floetrack.llm import decontaminate, hilbert, htmltext, jaccard, langid, licences, media, mixing, pii, toxicity

DIMENSIONS = [("lang", "label"), ("source", "label"), ("size", "size")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str = "doc_id"):
    """Whether a row is kept from training: the checksum of its id, as text, is divisible by five."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text")))


def toxicity_model(docs: DataFrame, labels: DataFrame):
    """Trained on the rows that are not held out."""
    return toxicity.fit(docs.select("doc_id", "text"), labels.where(~held_out()))


def op3_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.predict(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = hilbert.shard(docs, dimensions=DIMENSIONS, n_shards=8, law="rows", keep_text=False)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "start", "length", "width", "height")


def op6_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op10_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


OP9_SQL = """
WITH RECURSIVE shares AS (
  SELECT source, greatest(round(1000.0::DOUBLE * sqrt(count(*)::DOUBLE) / sum(sqrt(count(*)::DOUBLE)) OVER ()), 1)::BIGINT AS quota
  FROM documents GROUP BY source),
one AS (SELECT list(quota ORDER BY source NULLS FIRST) AS q, list(source ORDER BY source NULLS FIRST) AS s, sum(quota)::BIGINT AS m FROM shares),
edf(t, served, who) AS (
  SELECT 0::BIGINT, list_transform(q, lambda x: 0::BIGINT), NULL::BIGINT FROM one
  UNION ALL
  SELECT t + 1, list_transform(served, lambda n, i: CASE WHEN i = pick THEN n + 1 ELSE n END), pick
  FROM (SELECT t, served, list_min(list_filter(list_transform(served, lambda n, i:
                 CASE WHEN n * m // q[i] <= t THEN (((n + 1) * m + q[i] - 1) // q[i]) * 1000000 + i END), lambda x: x IS NOT NULL)) % 1000000 AS pick
        FROM edf, one WHERE t < m)),
turns AS (SELECT s[who] AS source, q[who] AS quota, m, t - 1 AS pick, row_number() OVER (PARTITION BY who ORDER BY t) - 1 AS turn FROM edf, one WHERE who IS NOT NULL),
ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS r FROM documents),
blocks AS (SELECT r.doc_id, r.source, x.quota, r.r, r.r // 4 AS block, o.m FROM ranked r JOIN shares x ON r.source IS NOT DISTINCT FROM x.source, one o)
SELECT b.doc_id, b.source, b.quota, b.block, b.block * b.m // b.quota AS release, ((b.block + 1) * b.m + b.quota - 1) // b.quota AS deadline,
       (b.block // b.quota) * b.m + t.pick AS slot, ((b.block // b.quota) * b.m + t.pick) * 4 + b.r % 4 AS place
FROM blocks b JOIN turns t ON b.source IS NOT DISTINCT FROM t.source AND t.turn = b.block % b.quota
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_naive_bayes_language, op2_anchor_pii, op3_recurrent_toxicity, op4_hilbert_shards, op5_media_columns, op6_metric_join, op7_licence_scan, op8_positional_index, op9_pfair_mix, op10_tag_path_text)}


def oracle_sql() -> dict[str, str]:
    return {"op7_licence_scan": licences.scan_sql(), "op9_pfair_mix": OP9_SQL}
