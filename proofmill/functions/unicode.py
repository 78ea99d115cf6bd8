"""Unicode normal forms and case folding of columns, in Arrow batches: Spark has no function for them.

The forms are the standard library's, applied to the different values of a batch
that aren't plain ASCII.  (Arrow's own utf8_normalize is not used: the release at
hand takes texts apart for NFC and NFKC but doesn't compose them again.)  NULL
stays NULL.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.functions.text import collapse_space

FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def _by_value(values: pa.Array, of: Callable[[str], str]) -> pa.Array:
    """of(value) for each value, computed once for equal ones."""
    kinds = pc.dictionary_encode(values)
    return pc.take(pa.array([of(v) for v in kinds.dictionary.to_pylist()], pa.string()), kinds.indices)


def _small_batches() -> None:
    """Batches of bounded bytes unless the session says how large they are: 10,000 whole texts are tens of megabytes, several times over."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def normal_form(c: Column, form: str) -> Column:
    """The canonical (NFC, NFD) or compatibility (NFKC, NFKD) form of a text: decomposed, marks in canonical order, and for the C forms composed again."""
    if form not in FORMS:
        raise ValueError(f"{form} is none of {FORMS}")
    _small_batches()

    @F.arrow_udf("string")
    def normalized(values: pa.Array) -> pa.Array:
        return _by_value(values, lambda v: v if v.isascii() else unicodedata.normalize(form, v))

    return normalized(c)


def case_folded(c: Column) -> Column:
    """The text without differences of case, in canonical form: what two names must not share on a file system that knows no case.

    Folding is that of Unicode (ß as ss, final sigma as sigma), between two
    canonical forms, so that equal names have one result.
    """

    @F.arrow_udf("string")
    def folded(values: pa.Array) -> pa.Array:
        canonical = lambda v: unicodedata.normalize("NFC", v)
        return _by_value(values, lambda v: canonical(canonical(v).casefold()))

    return folded(c)


def query_key(c: Column) -> Column:
    """What equal queries share: compatibility form, lower case, spaces collapsed."""
    return collapse_space(F.lower(normal_form(c, "NFKC")))


def tags_in(metadata: Column, caption: Column) -> Column:
    """the different tags of a list and of a caption's #words, in their first order, in compatibility form and lower case."""
    plain = normal_form(caption, "NFKC")
    words = F.coalesce(F.regexp_extract_all(plain, F.lit(r"#([\p{L}\p{N}_]+)"), 1), F.array().cast("array<string>"))
    named = F.split(normal_form(F.array_join(F.coalesce(metadata, F.array().cast("array<string>")), "\n"), "NFKC"), "\n")
    tags = F.transform(F.concat(named, words), lambda t: F.lower(F.regexp_replace(F.trim(t), "^#", "")))
    return F.filter(F.array_distinct(tags), lambda t: t != "")


def name_collisions(df: DataFrame, name: str) -> DataFrame:
    """name, form, first, n: each different name that shares its folded form with another one, and the first of them in code-point order.

    Forms are counted before names meet them, so a form that very many names
    share is one row of the join.
    """
    names = df.select(F.col(name).alias("name")).filter("name is not null").distinct().withColumn("form", case_folded(F.col("name")))
    shared = names.groupBy(F.col("form").alias("_form")).agg(F.count("*").alias("n"), F.min("name").alias("first")).filter("n > 1")
    return names.join(shared, F.col("form") == F.col("_form")).select("name", "form", "first", "n")
