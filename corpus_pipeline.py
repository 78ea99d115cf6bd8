"""The corpus pipeline: documents in, a cleaned and mixed corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns
of documents; `run` writes every stage's rows as Parquet to the shared folder
and reads them again as the next one's docs, so a lost executor costs one stage
at most and no lineage grows.

1. quality_classifier: rows that the classifier rejects go.
2. near_duplicates: one document of each group of near copies stays.
3. substring_dedup: words of repeated 13-word passages go, the first stays; a
   document of which no word is left goes.
4. decontamination: documents that overlap a test item go.
5. mixing: documents are sampled to the target shares of source, language, topic,
   three quarters of the tokens in expectation.

Nulls: a null text counts as empty; null ids are allowed.  An empty table passes
every stage.  SQL can't express the fit of the first stage, so ORACLE_SQL is
None and the stages are tested against brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proofmill.llm.common import fold_of, written
from proofmill.llm.decontaminate import drop_contaminated
from proofmill.llm.mixing import sample_mix
from proofmill.llm.near_duplicates import drop_near_duplicates
from proofmill.llm.quality import fit_quality
from proofmill.llm.substring_dedup import drop_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold_of("doc_id", 3) != 1)
    return model.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeats(docs, chars_col="n_chars" if "n_chars" in docs.columns else None)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sample_mix(docs)


STAGES: list[tuple[str, Stage]] = [(f.__name__, f) for f in (quality_classifier, near_duplicates, substring_dedup, decontamination, mixing)]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
