"""Aggregations whose unknowns stay unknown, and predicates that write issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tally(df: DataFrame, key: str) -> DataFrame:
    """Rows by key, NULL as `unknown`."""
    return df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias(key)).agg(F.count("*").alias("n"))


def fixed_domain(df: DataFrame, key: str, domain: list[str], measures: dict[str, Column]) -> DataFrame:
    """Measures by key for every value of the domain, absent ones too: counts 0, sums NULL."""
    spark = df.sparkSession
    base = spark.createDataFrame([(d,) for d in domain], f"{key} string")
    return base.join(df.groupBy(key).agg(*[c.alias(n) for n, c in measures.items()]), key, "left")


def route_metrics(rows: DataFrame, route: str, entity: str, first: str, ms: Column) -> DataFrame:
    """By route: rows, distinct entities, entities first credited to it, known time, credit by minute."""
    known = F.sum(ms)
    credited = F.count_distinct(F.when(F.col(first), F.col(entity)))
    return rows.groupBy(route).agg(
        F.count("*").alias("n_rows"), F.count_distinct(entity).alias("entities"), credited.alias("credited"), known.alias("known_ms"), F.count_if(ms.isNull()).alias("untimed"),
        F.try_divide(credited * 60000.0, known).alias("credited_per_minute"),
    )


def _tally_text(df: DataFrame, route: str, value: str, name: str) -> DataFrame:
    """By route one text of value:count pairs in order; unknown values count as unknown."""
    counts = df.groupBy(F.col(route).alias("_r"), F.coalesce(F.col(value).cast("string"), F.lit("unknown")).alias("_v")).agg(F.count("*").alias("_n"))
    return counts.groupBy("_r").agg(F.array_join(F.array_sort(F.collect_list(F.concat("_v", F.lit(":"), F.col("_n").cast("string")))), ",").alias(name))


def route_measures(observations: DataFrame, actions: DataFrame, targets: DataFrame) -> DataFrame:
    """The measures of every route that has observations or actions.

    observations: route, handle, kind, candidate, first (the candidate row that
    credits its handle); actions: route, role (cost role), ms, status, stop;
    targets: handle.  Counts of a route without rows are 0, known times NULL.
    """
    pool = targets.select(F.col("handle").alias("_t")).distinct()
    seen = observations.join(pool, F.col("handle") == F.col("_t"), "left").withColumn("target", F.col("_t").isNotNull())
    of = lambda cond: F.count_distinct(F.when(cond, F.col("handle")))
    c = F.col
    own = seen.groupBy(c("route").alias("route")).agg(
        F.count("*").alias("observation_rows"), F.count_distinct("handle").alias("own_unique"), of(c("candidate")).alias("candidate_unique"), of(c("first")).alias("first_unique"),
        of(c("first") & c("target")).alias("first_target_unique"), of(c("candidate") & c("target")).alias("target_pool_unique"),
    ).withColumn("support_only_unique", c("own_unique") - c("candidate_unique"))
    counted = c("role").isin("discovery", "enrichment")
    ms = lambda cond: F.sum(F.when(cond, c("ms")))
    done = actions.groupBy(c("route").alias("_route")).agg(
        F.count_if(counted).alias("actions"), ms(counted).alias("known_ms"), F.count_if(counted & c("ms").isNull()).alias("untimed"), F.count("*").alias("all_attempts"), F.sum("ms").alias("all_known_ms"),
        ms(c("role") == "diagnostic").alias("diagnostic_ms"), ms(c("role") == "unknown").alias("unknown_role_ms"),
    )
    both = own.join(done, c("route") == c("_route"), "full").withColumn("route", F.coalesce("route", "_route")).drop("_route")
    for tally in (_tally_text(observations, "route", "kind", "kinds"), _tally_text(actions.filter(counted), "route", "status", "statuses"), _tally_text(actions.filter(counted), "route", "stop", "stop_reasons")):
        both = both.join(tally, c("route") == c("_r"), "left").drop("_r")
    zero = [n for n in both.columns if n.endswith(("_unique", "_rows")) or n in ("actions", "untimed", "all_attempts")]
    return both.fillna(0, zero).fillna("", ["kinds", "statuses", "stop_reasons"])


def identities(df: DataFrame, stable: str, handle: str) -> tuple[DataFrame, DataFrame]:
    """A10: stable ids with several handles (aliases), and handles with several stable ids (conflicts)."""
    by = lambda k, v: df.groupBy(k).agg(F.count_distinct(v).alias("n")).filter("n > 1")
    return by(stable, handle), by(handle, stable)


def merge_actions(df: DataFrame, keys: list[str], order: list[str], fields: list[str], source: str) -> DataFrame:
    """By key the number of attempts, the last attempt's fields and the sorted set of sources."""
    return df.groupBy(*keys).agg(F.count("*").alias("attempts"), F.max_by(F.struct(*fields), F.struct(*order)).alias("_l"), F.array_sort(F.collect_set(source)).alias("sources")).select(*keys, "attempts", "_l.*", "sources")


def names_and_aliases(df: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """The first known name by order, and all others."""
    first = F.min_by(F.col(name), F.when(F.col(name).isNotNull(), F.col(order)))
    return df.groupBy(key).agg(first.alias("name"), F.array_sort(F.collect_set(name)).alias("_all")).select(key, "name", F.array_remove(F.col("_all"), F.col("name")).alias("aliases"))


def coverage(df: DataFrame, key: str, expected: Column, got: Column) -> DataFrame:
    """By key and, where the key is NULL, over all: expected, received and their ratio."""
    return df.rollup(key).agg(F.sum(expected).alias("expected"), F.sum(got).alias("received")).withColumn("ratio", F.try_divide("received", "expected"))


def rates(df: DataFrame, key: str, done: Column, good: Column, blocked: Column, hours: Column) -> DataFrame:
    """By key: rate by hour, pass rate and share blocked; NULL where a part is unknown or zero."""
    return df.groupBy(key).agg(F.count_if(done).alias("done"), F.count_if(good).alias("good"), F.count_if(blocked).alias("blocked"), hours.alias("hours")).select(
        key, F.try_divide("done", "hours").alias("per_hour"), F.try_divide("good", "done").alias("pass_rate"), F.try_divide("blocked", F.col("done") + F.col("blocked")).alias("blocked_rate")
    )


def assessment(entities: DataFrame, reviews: DataFrame, key: str, verdict: str) -> DataFrame:
    """Qualified, rejected, pending and unreviewed entities, and two coverage ratios."""
    joined = entities.select(key).distinct().join(reviews.select(key, verdict), key, "left")
    n = lambda v: F.count_if(F.col(verdict) == v)
    counts = joined.agg(F.count("*").alias("entities"), n("qualified").alias("qualified"), n("rejected").alias("rejected"), n("pending").alias("pending"), F.count_if(F.col(verdict).isNull()).alias("unreviewed"))
    decided = F.col("qualified") + F.col("rejected")
    return counts.withColumns({"decided_share": F.try_divide(decided, F.col("entities")), "qualified_share": F.try_divide(F.col("qualified"), decided)})


def issues(df: DataFrame, rules: dict[str, tuple[str, str, Column]]) -> DataFrame:
    """Every row with `issues`: structs of area, level and code for each rule that holds; rows are never dropped."""
    found = [F.when(c, F.struct(F.lit(area).alias("area"), F.lit(level).alias("level"), F.lit(code).alias("code"))) for code, (area, level, c) in rules.items()]
    return df.withColumn("issues", F.array_compact(F.array(*found)))


def issue_counts(df: DataFrame) -> DataFrame:
    """Issues by area, level and code."""
    return df.select(F.explode("issues").alias("i")).groupBy("i.area", "i.level", "i.code").agg(F.count("*").alias("n"))


def ladder(default: str, *steps: tuple[Column, str]) -> Column:
    """The name of the first step that holds."""
    out = None
    for cond, name in steps:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(default)


def bucket(time: Column, start: Column, end: Column) -> Column:
    """in_range, outside_range or unknown; both ends are inside."""
    return F.when(time.isNull(), "unknown").when(time.between(start, end), "in_range").otherwise("outside_range")


def matched_terms(text: Column, terms: list[str]) -> Column:
    """The terms that a text contains, whatever their case."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(text), F.lower(t)))
