"""Distinct values, unions and orders that keep the order in which things were first seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.operators.windows import global_rank


def first_seen(df: DataFrame, key: str, position: str) -> DataFrame:
    """Each value once, with the position at which it was first seen."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(position).alias("first"))


def structural_distinct(df: DataFrame, by: str, item: Column) -> DataFrame:
    """The sorted distinct structures of each key; two that hold equal values are one."""
    return df.groupBy(by).agg(F.array_sort(F.collect_set(item)).alias("items"))


def union_in_order(inputs: list[DataFrame]) -> DataFrame:
    """All rows of the inputs with the number of their input, which keeps the caller's order."""
    out = inputs[0].withColumn("input", F.lit(0))
    for n, more in enumerate(inputs[1:], 1):
        out = out.unionByName(more.withColumn("input", F.lit(n)))
    return out


def merged_sources(df: DataFrame, key: str, sources: str) -> DataFrame:
    """The distinct sources over all lists of a key."""
    each = df.select(key, F.explode_outer(sources).alias("_s"))
    return each.groupBy(key).agg(F.array_sort(F.collect_set("_s")).alias("sources"))


def least_depth(df: DataFrame, key: str, depths: list[str]) -> DataFrame:
    """The smallest known depth over all rows and columns of a key; NULL if none is known."""
    known = [F.min(c) for c in depths]
    return df.groupBy(key).agg((F.least(*known) if len(known) > 1 else known[0]).alias("depth"))


def placed(df: DataFrame, order: list[tuple[str, bool]], place: str = "place") -> DataFrame:
    """Every row with its place in an order of (column, descending); unknown values come last in both directions.

    The last column must tell rows apart, or equal rows have places by chance.
    """
    keys = df
    names = []
    for n, (column, down) in enumerate(order):
        keys = keys.withColumns({f"_null{n}": F.col(column).isNull(), f"_key{n}": _reversed(df, column) if down else F.col(column)})
        names += [f"_null{n}", f"_key{n}"]
    return global_rank(keys, names, place).drop(*names)


def _reversed(df: DataFrame, column: str) -> Column:
    """A value that falls as the column rises."""
    kind = dict(df.dtypes)[column]
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return -F.unix_micros(F.col(column).cast("timestamp"))
    if kind == "boolean":
        return ~F.col(column)
    if kind == "string":
        raise ValueError("texts are placed in ascending order only")
    return -F.col(column)


def until_budget(df: DataFrame, order: list[tuple[str, bool]], target: int) -> DataFrame:
    """The first `target` rows in order, each with its place; a target is the caller's own."""
    return placed(df, order).filter(F.col("place") <= target)
