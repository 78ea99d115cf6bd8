"""Join operators: baselines, evidence, reconciliation, graphs.

A side is broadcast by Spark where its measured size allows; nothing here
forces one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.folders import written
from proofmill.functions import text as T
from proofmill.operators.pairs import pair_counts


def attach_last(rows: DataFrame, actions: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Each row with the fields of the last action of its key; the row's own values come first."""
    last = actions.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*fields), F.col(order)).alias("_a"))
    own = [f for f in fields if f in rows.columns]
    joined = rows.join(last, F.col(key) == F.col("_k"), "left")
    values = {f: F.coalesce(F.col(f), F.col(f"_a.{f}")) if f in own else F.col(f"_a.{f}") for f in fields}
    return joined.withColumns(values).drop("_k", "_a")


def without(rows: DataFrame, frozen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't in the frozen set."""
    return rows.join(frozen.select(*keys).distinct(), keys, "left_anti")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Both sides by key: status (same, changed, left_only, right_only) and the fields that differ."""
    a = left.select(*keys, F.struct(*fields).alias("_l"))
    b = right.select(*keys, F.struct(*fields).alias("_r"))
    both = a.join(b, keys, "full_outer")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"_l.{f}").eqNullSafe(F.col(f"_r.{f}")), F.lit(f)) for f in fields]))
    status = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(F.size(differs) == 0, "same").otherwise("changed")
    return both.select(*keys, status.alias("status"), F.when(status == "changed", differs).otherwise(F.array().cast("array<string>")).alias("differs"))


def link_evidence(reviews: DataFrame, evidence: DataFrame, review_key: list[str], ids: str, evidence_id: str, evidence_time: str) -> DataFrame:
    """Each review with how many of its evidence ids exist and the latest time of those."""
    asked = reviews.select(*review_key, F.explode_outer(F.array_distinct(ids)).alias("_id"))
    met = asked.join(evidence.select(F.col(evidence_id).alias("_e"), F.col(evidence_time).alias("_t")), F.col("_id") == F.col("_e"), "left")
    return met.groupBy(*review_key).agg(F.count_distinct("_id").alias("asked"), F.count_distinct("_e").alias("linked"), F.max("_t").alias("latest"))


def orphans(children: DataFrame, parent_ref: str, parents: DataFrame, parent_id: str) -> DataFrame:
    """References to parents that are absent, each once, with the number of children."""
    missing = children.filter(F.col(parent_ref).isNotNull()).join(parents.select(F.col(parent_id).alias("_p")).distinct(), F.col(parent_ref) == F.col("_p"), "left_anti")
    return missing.groupBy(parent_ref).agg(F.count("*").alias("children"))


#: Most groups for which pairs without a common entity are listed with zero.
ZERO_PAIR_GROUPS = 2_000


def overlaps(rows: DataFrame, entity: str, group: str, zeros: bool = True) -> DataFrame:
    """For each pair of groups how many entities have both; with `zeros`, pairs without one count zero.

    The distinct rows are written; tasks count the pairs of their entities before a shuffle (`pair_counts`).
    Zero pairs are a report on a short domain: more than ZERO_PAIR_GROUPS groups are refused.
    """
    own = written(rows.select(F.col(entity).alias("_e"), F.col(group).alias("a")).filter("a is not null").distinct())
    found = pair_counts(own)
    if not zeros:
        return found
    names = sorted(r[0] for r in rows.select(group).distinct().filter(F.col(group).isNotNull()).limit(ZERO_PAIR_GROUPS + 1).collect())
    if len(names) > ZERO_PAIR_GROUPS:
        raise ValueError(f"more than {ZERO_PAIR_GROUPS} groups; ask for zeros=False")
    # Each name is paired with the later ones of one short list: rows grow with pairs of the report, not of the data.
    later = F.filter(F.array(*[F.lit(n) for n in names]), lambda b: b > F.col("a"))
    grid = rows.sparkSession.createDataFrame([(n,) for n in names], f"a {rows.schema[group].dataType.simpleString()}").select("a", F.explode(later).alias("b")) if names else found.select("a", "b")
    return grid.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("common", F.lit(0)).alias("common"))


def resolve_owners(unresolved: DataFrame, owners: DataFrame, key: str, owner: str) -> DataFrame:
    """Each key with pending, resolved or conflict, after how many owners it has."""
    held = owners.groupBy(F.col(key).alias("_k")).agg(F.count_distinct(owner).alias("owners"), F.min(owner).alias("_o"))
    joined = unresolved.select(key).distinct().join(held, F.col(key) == F.col("_k"), "left")
    n = F.coalesce("owners", F.lit(0))
    return joined.select(key, n.alias("owners"), F.when(n == 0, "pending").when(n == 1, "resolved").otherwise("conflict").alias("state"), F.when(n == 1, F.col("_o")).alias("owner"))


def allowed(rows: DataFrame, key: str, tags: DataFrame, tag: str, allow: list[str] | None, deny: list[str]) -> DataFrame:
    """Rows without a denied tag and, where there is an allow list, with an allowed one; an empty list allows none."""
    out = rows.join(tags.filter(F.col(tag).isin(*deny)).select(key).distinct(), key, "left_anti") if deny else rows
    if allow is None:
        return out
    return out.join(tags.filter(F.col(tag).isin(*allow)).select(key).distinct(), key, "left_semi") if allow else out.limit(0)


def pair_streams(left: DataFrame, right: DataFrame, keys: list[str], agrees: Column) -> DataFrame:
    """Rows of both sides with equal keys that also agree; works on batches and on streams with watermarks."""
    return left.join(right, keys).filter(agrees)


def contains_quote(texts: DataFrame, quotes: DataFrame, key: str, text: str, quote: str) -> DataFrame:
    """Quotes found in the text of their own key, both with white space collapsed."""
    from proofmill.functions.text import collapse_space

    return quotes.join(texts, key).withColumn("found", F.contains(collapse_space(F.col(text)), collapse_space(F.col(quote))))


def compare_sets(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys were retained, are missing and are new."""
    a = old.select(*keys).distinct().withColumn("_a", F.lit(1))
    b = new.select(*keys).distinct().withColumn("_b", F.lit(1))
    return a.join(b, keys, "full_outer").agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("retained"), F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("new")
    )


def upsert_checked(rows: DataFrame, key: str, owner: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and the later rows that name another owner."""
    from proofmill.operators.windows import first_by

    first = first_by(rows, [key], order)
    conflicts = rows.join(first.select(key, F.col(owner).alias("_first")), key).filter(~F.col(owner).eqNullSafe(F.col("_first"))).drop("_first")
    return first, conflicts


def walk_chain(rows: DataFrame, key: str, cursor: str, following: str, head: str) -> DataFrame:
    """How many cursors the chain from `head` reaches in each key and whether it comes to an end.

    Pointers are doubled in written rounds until no new cursor is reached, so
    rounds follow the logarithm of the longest chain and a cycle ends by itself.
    A chain is incomplete where a cursor is absent, in a cycle, or where a
    cursor that is reached repeats with another following one (the least is
    followed).  Keys without `head` have no row.
    """
    node = rows.groupBy(F.col(key).alias("_k"), F.col(cursor).alias("at")).agg(F.min(following).alias("next"), F.bool_or(F.col(following).isNull()).alias("_ends"), F.count_distinct(following).alias("_n"))
    nodes = written(node.select("_k", "at", "next", ((F.col("_n") > 1) | F.col("_ends") & (F.col("_n") > 0)).alias("_repeats")))

    def met(of: DataFrame, at: str) -> tuple[DataFrame, Column]:
        """`of` under other names, and the condition that its cursor is `at`."""
        return of.select(F.col("_k").alias("_j"), F.col("at").alias("_at"), *[F.col(c).alias(f"_{c}") for c in of.columns[2:]]), F.col("_k").eqNullSafe(F.col("_j")) & (F.col(at) == F.col("_at"))

    jump = written(nodes.filter(F.col("next").isNotNull()).select("_k", "at", F.col("next").alias("to")))
    reached = written(nodes.filter(F.col("at") == head).select("_k", "at"))
    known = nodes.select("_k", "at")
    size = reached.count()
    while True:
        further, on = met(jump, "at")
        ahead = reached.join(further, on).select("_k", F.col("_to").alias("at"))
        there, on = met(known, "at")
        reached = written(reached.unionByName(ahead.join(there, on, "left_semi")).distinct())
        before, size = size, reached.count()
        if size == before:
            break
        twice, on = met(jump, "to")
        jump = written(jump.join(twice, on).select("_k", "at", F.col("_to").alias("to")))
    of_node, on = met(nodes, "at")
    walked = reached.join(of_node, on).groupBy(F.col("_k").alias(key))
    return walked.agg(F.count("*").alias("depth"), (F.bool_or(F.col("_next").isNull()) & ~F.bool_or("__repeats")).alias("complete"))


def rule_matches(lines: DataFrame, text: str, rules: dict[str, str], guard: str | None = None) -> DataFrame:
    """A row for each line and named pattern that it matches; `guard` names text that stops a match."""
    hit = F.array_compact(F.array(*[F.when(T.rule_matches(F.col(text), n, p), F.lit(n)) for n, p in rules.items()]))
    kept = lines if guard is None else lines.filter(~F.col(text).rlike(guard))
    return kept.withColumn("rule", F.explode(hit))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
