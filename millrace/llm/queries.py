"""The queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, centroids, decontaminate, langid, mixing, near_dup, onebit_ann, oracles, quality, reputation, site_templates, surrogates, threshold_search, toxicity
from .common import fold, stash

PII_KEY = "spark.millrace.pii.key"  # where the key of surrogates is set; without it they can be made again by anyone
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get(PII_KEY, "millrace")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), key=pii_key(spark))


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pareto_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff_lm.score_texts(table(spark, sf_dir, "documents"))
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})  # sums of floats, for comparison


def op5_onebit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit_ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.judge_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold() != 0).select("text", "lang"))
    return langid.identify(docs, model).withColumn("held_out", fold() == 0).select("doc_id", "held_out", "lang_pred", "score")


LABELS_SENT = 2_000_000


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, text, y of the labelled documents to learn from.

    Up to LABELS_SENT labels (of two numbers each, counted first) go to the texts; beyond that texts are joined by shuffle
    once and kept.
    """
    y = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y is not null")
    read = docs.select("doc_id", "text").where(fold() != 0)
    if y.count() <= LABELS_SENT:
        return read.join(F.broadcast(y), "doc_id")
    return stash(read.join(y, "doc_id"), "labelled")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(labelled(docs, table(spark, sf_dir, "labels"), "toxic"))
    scored = toxicity.score_toxicity(docs, index)
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, labelled(docs, table(spark, sf_dir, "labels"), "quality"))
    return quality.score_quality(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_templates.main_text(table(spark, sf_dir, "pages"))


def op12_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_digests(*centroids.cluster(table(spark, sf_dir, "embeddings")))


QUERIES = {f.__name__: f for f in (op1_pii_surrogates, op2_pareto_mix, op3_latent_decontamination, op4_backoff_lm, op5_onebit_ann, op6_host_reputation, op7_langid, op8_toxicity, op9_jaccard_join, op10_quality, op11_site_templates, op12_threshold_search, op13_centroids)}
ORACLES = {"op2_pareto_mix": oracles.MIX, "op4_backoff_lm": oracles.LM, "op5_onebit_ann": oracles.ANN, "op6_host_reputation": oracles.urls(RULES), "op9_jaccard_join": oracles.JACCARD, "op11_site_templates": oracles.PAGES, "op12_threshold_search": oracles.SEARCH, "op13_centroids": oracles.CENTROIDS}
