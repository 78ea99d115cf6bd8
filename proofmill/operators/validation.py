"""Validation of intakes, policies, scopes and typed fields, with coded outcomes instead of exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.functions import text as T


def coded(*rules: tuple[Column, str]) -> Column:
    """Codes of the rules that hold, in order; an unknown condition doesn't hold."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in rules]))


def intake_status(errors: Column, questions: Column) -> Column:
    """P25: errors make an intake invalid, open questions incomplete; else it is ready."""
    return F.when(F.size(errors) > 0, "invalid").when(F.size(questions) > 0, "needs_answers").otherwise("ready")


def bounded(value: Column, low: float, high: float, default: float | None = None) -> Column:
    """The value where it is a number inside the bounds; the default where it is absent; else NULL."""
    inside = F.when(value.between(low, high), value)
    return inside if default is None else F.when(value.isNull(), F.lit(default)).otherwise(inside)


def conflict(a: Column, b: Column) -> Column:
    """Both spellings of a setting are given and differ."""
    return F.coalesce(a != b, F.lit(False))


def typed_text(value: Column, path: str) -> tuple[Column, Column]:
    """The text at a path of a JSON value, and an issue where there is something that is no text."""
    kind = json_kind(value, path)
    text = F.try_variant_get(T.whole_json(value), path, "string")
    return F.when(kind == "text", text), F.when(~kind.isin("text", "null"), F.concat(F.lit("not_text:"), kind))


def json_kind(value: Column, path: str) -> Column:
    """Text, integer, number, boolean, array, object or null of what lies at a path; a truth value is no integer."""
    found = F.try_variant_get(T.whole_json(value), path, "variant")
    kind = F.schema_of_variant(found)
    return (
        F.when(found.isNull() | F.is_variant_null(found), "null").when(kind == "STRING", "text").when(kind == "BIGINT", "integer").when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number")
    )


def same_scope(fields: dict[str, tuple[Column, Column]]) -> Column:
    """Every field of two scopes is equal, unknown to unknown."""
    out = F.lit(True)
    for a, b in fields.values():
        out = out & a.eqNullSafe(b)
    return out


def weight_policy(policy: DataFrame, key: str, weight: str, known: list[str], low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Each row of a policy and why it is refused: unknown key, repeated key, no weight or one out of bounds."""
    counts = policy.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    joined = policy.join(counts, F.col(key).eqNullSafe(F.col("_k")))
    why = F.when(~F.coalesce(F.col(key).isin(*known), F.lit(False)), "unknown_key").when(F.col("_n") > 1, "repeated_key").when(F.col(weight).isNull(), "no_weight").when(~F.col(weight).between(low, high), "out_of_bounds")
    return joined.withColumn("refused", why).drop("_k", "_n")


def card_signature(ids: Column) -> Column:
    """One text for a set of cards, whatever their order."""
    return F.array_join(F.array_sort(F.array_distinct(ids)), "|")


def search_ready(shown: Column, answered: Column, shown_query: Column, query: Column) -> Column:
    """The cards on view come from this query's own response."""
    return F.coalesce((T.collapse_space(F.lower(shown_query)) == T.collapse_space(F.lower(query))) & F.arrays_overlap(shown, answered), F.lit(False))


def retain_after_timeout(shown: Column, before: Column, shown_query: Column, query: Column) -> Column:
    """What is on view after a timeout counts if it is of the same query and the cards changed."""
    return F.coalesce((shown_query == query) & (F.size(shown) > 0) & (card_signature(shown) != card_signature(before)), F.lit(False))


def empty_for_query(message: Column, query: Column, pattern: str) -> Column:
    """A message of no results names this query (the pattern's first group)."""
    return F.coalesce(T.collapse_space(F.lower(T.found(message, pattern))) == T.collapse_space(F.lower(query)), F.lit(False))


def suppress_untrusted(df: DataFrame, trusted: Column, fixed: dict[str, Column]) -> DataFrame:
    """Where the run isn't trusted, the named columns hold their fixed values."""
    return df.withColumns({c: F.when(F.coalesce(trusted, F.lit(False)), F.col(c)).otherwise(v) for c, v in fixed.items()})


def proposals(df: DataFrame, run: str, eligible: Column, target: str, trusted: Column) -> DataFrame:
    """By run its distinct eligible targets and the state: blocked if untrusted, none without targets, else proposed."""
    found = df.groupBy(run).agg(F.array_sort(F.collect_set(F.when(eligible, F.col(target)))).alias("targets"), F.coalesce(F.bool_and(trusted), F.lit(False)).alias("_t"))
    return found.select(run, "targets", F.when(~F.col("_t"), "blocked").when(F.size("targets") == 0, "none").otherwise("proposed").alias("state"))


def unavailable(df: DataFrame, item: str, thread: str, kind: Column, reason: str, order: str) -> DataFrame:
    """For each marked item, or thread where the kind is 'thread', the reason that was recorded first."""
    marked = df.filter(F.col(reason).isNotNull()).select(F.when(kind == "thread", "thread").otherwise("item").alias("level"), F.when(kind == "thread", F.col(thread)).otherwise(F.col(item)).alias("id"), reason, order)
    return marked.groupBy("level", "id").agg(F.min_by(reason, order).alias("reason"), F.count("*").alias("marks"))


def checkpoint_faults(checkpoints: DataFrame, version: int, existing: DataFrame) -> DataFrame:
    """Checkpoints (id, schema_version, pages, next_page, history: list of names) and the codes of what is wrong with each."""
    named = checkpoints.select("id", F.explode("history").alias("name")).join(existing.select(F.col("name").alias("_there")).distinct(), F.col("name") == F.col("_there"), "left")
    missing = named.groupBy(F.col("id").alias("_id")).agg(F.count_if(F.col("_there").isNull()).alias("_missing"))
    rules = coded(
        (~F.col("schema_version").eqNullSafe(version), "version"), (~F.col("next_page").eqNullSafe(F.col("pages") + 1), "page_arithmetic"), (F.size("history") <= 0, "no_history"),
        (F.size(F.array_distinct("history")) < F.size("history"), "repeated_file"), (F.col("_missing") > 0, "missing_file"),
    )
    return checkpoints.join(missing, F.col("id") == F.col("_id"), "left").select("id", rules.alias("faults"))
