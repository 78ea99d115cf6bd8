"""Registered queries of the numbered operators, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm.centroids import cluster, digests
from proofmill.llm.collision_search import nearest
from proofmill.llm.common import fold_of
from proofmill.llm.decontaminate import contaminated
from proofmill.llm.language_model import score_texts
from proofmill.llm.license_scan import license_scan
from proofmill.llm.mixing import mixing_weights
from proofmill.llm.near_duplicates import near_duplicates
from proofmill.llm.oracles import ORACLES  # noqa: F401
from proofmill.llm.quality import fit_quality
from proofmill.llm.repetition import repetition_rules
from proofmill.llm.substring_dedup import remove_repeats
from proofmill.llm.token_counts import token_counts
from proofmill.llm.url_filter import judge_urls, rule_table
from proofmill.llm.vector_codes import code_text, compress


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_class_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"), fold_of("doc_id", 7) != 2)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), rule_table(spark))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing_weights(_table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("weight", "probability", "residual")})


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_id", "n_copies", "n_links", "kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), normalize=True)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), "word_bpe_49k.json")


def op7_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_quality(docs, _table(spark, sf_dir, "labels"), fold_of("doc_id", 3) != 1)
    return model.score(docs).select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compress(_table(spark, sf_dir, "embeddings"), keep=["label"])
    sums = rows.groupBy(F.col("_0").alias("_l")).agg(F.sum("error").alias("label_error"))
    # A hot label's rows meet one row; Spark broadcasts the sums where they are few and splits a hot label where they are many.
    coded = rows.join(sums, F.col("_0").eqNullSafe(F.col("_l")))
    return coded.select(F.col("_id").alias("vec_id"), code_text().alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(_table(spark, sf_dir, "embeddings"))
    sums = rows.groupBy("cluster").agg(F.sum("distance").cast("long").alias("cluster_inertia"))
    found = [(r.cluster, r.cluster_inertia) for r in sums.collect()]  # at most a row for each centroid
    sha, total = digests(centroids), sum(s for _, s in found)
    facts = spark.createDataFrame([(c, s, total, sha[c]) for c, s in found], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(F.col("_id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_class_language_model, op2_url_filter, op3_source_mixing, op4_ngram_jaccard_join, op5_substring_dedup, op6_token_counts, op7_repetition_rules, op8_license_scan, op9_quality_classifier, op10_decontamination, op11_vector_codes, op12_centroid_clusters, op13_nearest_vectors)}
