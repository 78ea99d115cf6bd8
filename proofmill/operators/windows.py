"""Window operators: attribution, latest value, runs, gaps and islands, rates.

Ranks over a whole table first reduce to one row for each key, and a global
rank is made of counts below range partitions, so no operator here sorts a
whole table in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.folders import written


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """The place of each row in a total order, from 1.

    Rows are range-partitioned and written with the number of their partition,
    so counts and rows are of the same partitions; the counts (a row each) give
    every partition its offset, and ranking needs no single task.
    """
    spread = written(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    sizes = spread.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_pid", "_before")
    ranked = spread.withColumn("_in", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
    return ranked.join(F.broadcast(before), "_pid").withColumn(name, F.col("_in") + F.col("_before")).drop("_pid", "_in", "_before")


def split_at(df: DataFrame, order: list[str], target: int) -> DataFrame:
    """Rank and pool: the first `target` rows of the ranking are the target, the rest overflow."""
    return global_rank(df, order).withColumn("pool", F.when(F.col("rank") <= target, "target").otherwise("overflow"))


def latest(df: DataFrame, keys: list[str], time: str, arrival: str, values: list[str]) -> DataFrame:
    """The values observed last; of equal times the later arrival; unknown times are before all."""
    at = F.struct(F.coalesce(F.col(time), F.lit("0001-01-01").cast("timestamp")), F.col(arrival))
    return df.groupBy(*keys).agg(F.max_by(F.struct(time, *values), at).alias("_v")).select(*keys, "_v.*")


def best_by_rank(df: DataFrame, keys: list[str], rank: list[Column], values: list[str]) -> DataFrame:
    """The row whose rank columns are largest, compared from left to right."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*[c.alias(f"_{i}") for i, c in enumerate(rank)])).alias("_v")).select(*keys, "_v.*")


def merge_with_fallback(df: DataFrame, keys: list[str], time: str, arrival: str, fields: list[str]) -> DataFrame:
    """Replay of observations: one older than the latest so far is ignored; an unknown field keeps the
    earlier value and the time at which that was observed."""
    past = Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    live = df.withColumn("_top", F.max(time).over(past)).filter(F.col(time).isNull() | (F.col(time) >= F.col("_top")))
    seen = {f: F.max_by(F.when(F.col(f).isNotNull(), F.struct(F.col(f).alias("v"), F.col(time).alias("t"))), F.when(F.col(f).isNotNull(), F.col(arrival))) for f in fields}
    merged = live.groupBy(*keys).agg(F.max(time).alias(time), F.count("*").alias("applied"), *[c.alias(f"_{f}") for f, c in seen.items()])
    return merged.select(*keys, time, "applied", *[F.col(f"_{f}.v").alias(f) for f in fields], *[F.col(f"_{f}.t").alias(f"{f}_observed_at") for f in fields])


def chain_breaks(df: DataFrame, keys: list[str], order: str, request: Column, following: Column) -> DataFrame:
    """Rows whose request isn't what the row before announced."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("expected", F.lag(following).over(w)).withColumn("position", F.row_number().over(w)).filter((F.col("position") > 1) & ~request.eqNullSafe(F.col("expected")))


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column) -> DataFrame:
    """Island number of each row: it grows where `breaks` is true."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("island", F.sum(F.when(breaks, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def trailing_run(df: DataFrame, keys: list[str], order: str, holds: str) -> DataFrame:
    """How many rows at the end of each key hold without a break."""
    broken = F.max(F.when(~F.col(holds), F.col(order)))
    last = df.groupBy(*keys).agg(broken.alias("_broken"))
    joined = df.join(last, keys)
    return joined.groupBy(*keys).agg(F.count_if(F.col("_broken").isNull() | (F.col(order) > F.col("_broken"))).alias("run"))


def regressions(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value is below the last known value before them."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("previous", F.last(value, ignorenulls=True).over(w)).filter(F.col(value) < F.col("previous"))


def supersede_retries(df: DataFrame, keys: list[str], order: list[str], same: list[str], clean: str, advances: str) -> DataFrame:
    """Of consecutive rows alike in `same`, the earlier ones go if all of them are clean retries and the last advances."""
    w = Window.partitionBy(*keys).orderBy(*order)
    alike = F.lit(True)
    for c in same:
        alike = alike & F.col(c).eqNullSafe(F.lag(c).over(w))
    marked = islands(df.withColumn("_new", F.row_number().over(w).eqNullSafe(1) | ~alike), keys, order, F.col("_new"))
    group = Window.partitionBy(*keys, "island")
    ordered = group.orderBy(*order)
    full = marked.withColumns({
        "_rn": F.row_number().over(ordered), "_n": F.count("*").over(group),
        "_last": F.last(F.col(advances)).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    full = full.withColumn("_bad", F.count_if((F.col("_rn") < F.col("_n")) & ~F.col(clean)).over(group))
    return full.filter((F.col("_rn") == F.col("_n")) | (F.col("_bad") > 0) | ~F.col("_last")).drop("_new", "_rn", "_n", "_last", "_bad", "island")


def duplicate_flags(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """Every row, with `duplicate`: an earlier row has the same key."""
    return df.withColumn("duplicate", F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1)


def sliding_count(df: DataFrame, keys: list[str], time: str, seconds: int) -> DataFrame:
    """Rows of the key in the window of seconds that ends at each row, and the gap to the row before."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy(F.col("_at"))
    return df.withColumn("_at", at).withColumn("in_window", F.count("*").over(w.rangeBetween(-seconds * 1_000_000, 0))).withColumn("gap_micros", F.col("_at") - F.lag("_at").over(w)).drop("_at")


def sequence_gaps(df: DataFrame, keys: list[str], number: str, start: int = 0) -> DataFrame:
    """For each key the ranges (missing_from to missing_to) of numbers from `start` on that are absent below its largest one."""
    w = Window.partitionBy(*keys).orderBy(number)
    rows = df.select(*keys, number).filter(F.col(number) >= start).distinct()
    after = rows.withColumn("_after", F.coalesce(F.lag(number).over(w), F.lit(start - 1)))
    return after.filter(F.col(number) > F.col("_after") + 1).select(*keys, (F.col("_after") + 1).alias("missing_from"), (F.col(number) - 1).alias("missing_to"))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Every row with its place in its key and whether it is among the first k."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).withColumn("chosen", F.col("place") <= k)


def frozen_sample(df: DataFrame, keys: list[str], salt: Column, n: int) -> DataFrame:
    """The n rows of each key with the smallest SHA-256 of the salted id: the same rows in every run."""
    return top_per_key(df.withColumn("draw", F.sha2(salt, 256)), keys, [F.col("draw")], n).filter("chosen").drop("chosen")


def batches(df: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """Lists of at most `size` values of each key, in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
    return numbered.groupBy(*keys, "batch").agg(F.array_sort(F.collect_list(order)).alias("ids"))
