"""Operators on nested evidence, reviews and runs: trees of JSON, experiment gates, ledgers and guards.

Nested JSON is walked as variants (operators/trees.py); only `without_secrets`, which
writes JSON again, works in Arrow batches.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.functions import text as T
from proofmill.functions import values as V
from proofmill.operators.joins import reconcile
from proofmill.operators.trees import marked_objects

#: Names of fields that must not reach an output.
SECRET_FIELD = r"^_|^(?:cookies?|authorization|password|access_?token|refresh_?token|session_?token|headers|storageState)$"
#: Fixed value: how deep items of a response may lie.
DEEPEST = 7


def without_secrets(column: Column, pattern: str = SECRET_FIELD) -> Column:
    """A JSON text without the fields whose names match, at any depth; NULL if it isn't JSON."""
    deny = re.compile(pattern, re.IGNORECASE)

    @F.pandas_udf("string")
    def clean(values: pd.Series) -> pd.Series:
        def walk(v):
            if isinstance(v, dict):
                return {k: walk(x) for k, x in v.items() if not deny.search(k)}
            return [walk(x) for x in v] if isinstance(v, list) else v

        def one(text):
            try:
                return None if text is None else json.dumps(walk(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        return values.map(one)

    return clean(column)


def nested_objects(df: DataFrame, key: str, column: str, marks: list[str], deepest: int | None = DEEPEST) -> DataFrame:
    """A row (key, path, object) for each outermost object that has all fields of `marks`, down to `deepest` levels (None: all)."""
    return marked_objects(df, key, column, marks, deepest).select(key, "path", "object")


def payload_outcome(payload: Column, kind: Column, item: Column) -> Column:
    """Ok, or what is wrong with a response of a thread or of more children."""
    v = T.whole_json(payload)
    text = lambda path: F.try_variant_get(v, path, "string")
    rows = lambda path: F.try_variant_get(v, path, "array<variant>")
    listing = (text("$[0].kind") == "Listing") & (text("$[1].kind") == "Listing") & rows("$[0].data.children").isNotNull() & rows("$[1].data.children").isNotNull()
    same = text("$[0].data.children[0].data.id") == item
    more = (F.size(rows("$.json.errors")) == 0) & rows("$.json.data.things").isNotNull()
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(v.isNull(), "not_json").when((kind == "more") & no(more), "bad_more_shape").when(kind == "more", "ok")
        .when(no(listing), "bad_listing_shape").when(no(same), "identity_mismatch").otherwise("ok")
    )


LISTING = "struct<itemList:array<struct<id:string,desc:string,createTime:double,author:struct<uniqueId:string>,imagePost:string,isPinned:boolean,stats:map<string,double>>>,hasMore:string,cursor:string>"


def listing(df: DataFrame, key: str, body: str, owner: str) -> DataFrame:
    """Items of the owner with a numeric id and a caption, how many were rejected, more (true, false, NULL) and the cursor."""
    d = F.from_json(F.col(body), LISTING)
    rows = df.select(key, F.lower(F.regexp_replace(owner, "^@", "")).alias("_owner"), d.alias("d"))
    good = F.filter("d.itemList", lambda i: F.coalesce(i["id"].rlike(r"^\d+$") & (F.lower(i["author"]["uniqueId"]) == F.col("_owner")) & i["desc"].isNotNull(), F.lit(False)))
    known = F.transform(good, lambda i: F.struct(i["id"].alias("id"), i["desc"].alias("caption"), F.when(i["createTime"] > 0, i["createTime"]).alias("created"), F.when(i["imagePost"].isNotNull(), "photo").otherwise("video").alias("type"), F.map_filter(i["stats"], lambda _, x: x >= 0).alias("stats")))
    more = F.when(F.lower("d.hasMore").isin("true", "1"), True).when(F.lower("d.hasMore").isin("false", "0"), False)
    return rows.select(key, known.alias("items"), (F.size("d.itemList") - F.size(good)).alias("rejected"), more.alias("more"), F.col("d.cursor").alias("cursor"))


def index_faults(index: DataFrame, files: DataFrame, facts: DataFrame) -> DataFrame:
    """Index rows (path, sha256) whose file is absent or changed, and facts (path) without an index row."""
    against = reconcile(index.select("path", "sha256"), files.select("path", "sha256"), ["path"], ["sha256"])
    faults = against.filter(F.col("status").isin("left_only", "changed")).select("path", F.when(F.col("status") == "changed", "changed").otherwise("absent").alias("fault"))
    return faults.unionByName(facts.select("path").distinct().join(index.select("path"), "path", "left_anti").withColumn("fault", F.lit("not_indexed")))


def label_tags(entities: DataFrame, key: str, tags: str, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities by the label of their tags (labels: tag, label), and tags in use without a label."""
    used = entities.select(key, F.explode(tags).alias("tag"))
    met = used.join(labels, "tag")
    # Counts and tags apart: together, each entity's tags would be an object of its own until its label is counted.
    counts = met.select("label", key).distinct().groupBy("label").agg(F.count(key).alias("entities"))
    names = met.groupBy(F.col("label").alias("_label")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    named = counts.join(names, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return named, used.join(labels, "tag", "left_anti").groupBy("tag").agg(F.count_distinct(key).alias("entities"))


def run_metrics(df: DataFrame) -> DataFrame:
    """Rates of a run from its counts; a rate with an unknown part is NULL; counts that contradict each other are an error.

    Columns: actions, blocked, new_accounts, reviewed, passed, active_ms, wait_ms, planned, completed.
    """
    c = F.col
    wrong = F.coalesce(c("reviewed") > c("new_accounts"), F.lit(False)) | F.coalesce(c("passed") > c("reviewed"), F.lit(False)) | F.coalesce(c("blocked") > c("actions"), F.lit(False)) | F.coalesce(c("completed") > c("planned"), F.lit(False))
    hours = (c("active_ms") + c("wait_ms")) / 3_600_000.0
    checked = df.withColumn("actions", F.when(wrong, F.raise_error(F.lit("counts contradict each other")).cast("bigint")).otherwise(c("actions")))
    return checked.withColumns({
        "new_per_hour": V.safe_ratio(c("new_accounts"), hours), "passed_per_hour": V.safe_ratio(c("passed"), hours), "pass_rate": V.safe_ratio(c("passed"), c("reviewed")),
        "coverage": V.safe_ratio(c("reviewed"), c("new_accounts")), "blocked_rate": V.safe_ratio(c("blocked"), c("actions")), "completion": V.safe_ratio(c("completed"), c("planned")),
    })


#: What an experiment must reach before it may change a policy.
GATE = {"actions": 20, "reviewed": 30, "coverage": 0.5, "gain": 1.05}


def experiment_gate(baseline: DataFrame, candidate: DataFrame, key: str = "experiment") -> DataFrame:
    """For each experiment the reasons against the candidate; none means that it may be adopted.  Inputs are run_metrics."""
    b, c = (df.select(key, F.struct(*[x for x in df.columns if x != key]).alias(n)) for df, n in ((baseline, "b"), (candidate, "c")))
    no = lambda cond: ~F.coalesce(cond, F.lit(False))
    at = lambda n, f: F.col(f"{n}.{f}")
    why = [F.when(no(at(n, "actions") >= GATE["actions"]), f"{side}_few_actions") for n, side in (("b", "baseline"), ("c", "candidate"))]
    why += [F.when(no(at(n, "reviewed") >= GATE["reviewed"]), f"{side}_few_reviews") for n, side in (("b", "baseline"), ("c", "candidate"))]
    why += [F.when(no(at(n, "coverage") >= GATE["coverage"]), f"{side}_low_coverage") for n, side in (("b", "baseline"), ("c", "candidate"))]
    why += [
        F.when(no(at("c", "passed_per_hour") >= at("b", "passed_per_hour") * GATE["gain"]), "throughput_not_better"),
        F.when(no(at("c", "pass_rate") >= at("b", "pass_rate")), "pass_rate_worse"), F.when(no(at("c", "coverage") >= at("b", "coverage")), "coverage_worse"),
        F.when(no(at("c", "blocked_rate") <= at("b", "blocked_rate")), "blocked_worse"), F.when(no(at("c", "completion") >= at("b", "completion")), "completion_worse"),
    ]
    return b.join(c, key).select(key, F.array_compact(F.array(*why)).alias("reasons")).withColumn("adopt", F.size("reasons") == 0)


def review_faults(reviews: DataFrame, works: DataFrame) -> DataFrame:
    """Each review (review_id, reference_id, window_start, window_end, quote, work_id) with what is wrong with it.

    works: reference_id, work_id, caption, window_start, window_end.  One review
    stands for one reference; its quote is in the caption of its own work.
    """
    from pyspark.sql import Window

    own = works.select("reference_id", "work_id", F.col("caption"), F.col("window_start").alias("_start"), F.col("window_end").alias("_end")).dropDuplicates(["reference_id", "work_id"])
    known = works.select(F.col("reference_id")).distinct().withColumn("_known", F.lit(True))
    joined = reviews.join(known, "reference_id", "left").join(own, ["reference_id", "work_id"], "left").withColumn("_n", F.count("*").over(Window.partitionBy("reference_id")))
    has = F.contains(F.lower(T.collapse_space(F.col("caption"))), F.lower(T.collapse_space(F.col("quote"))))
    faults = [
        F.when(F.col("_known").isNull(), "unknown_reference"), F.when(F.col("_n") > 1, "several_reviews"), F.when(F.col("_known").isNotNull() & F.col("caption").isNull(), "unknown_work"),
        F.when(~(F.col("window_start").eqNullSafe(F.col("_start")) & F.col("window_end").eqNullSafe(F.col("_end"))) & F.col("caption").isNotNull(), "window_differs"),
        F.when(T.nonempty(F.col("quote")).isNull(), "no_quote").when(~has, "quote_not_found"),
    ]
    return joined.select("review_id", "reference_id", F.array_compact(F.array(*faults)).alias("faults"))


def sample_statistics(df: DataFrame, key: str, likes: str, comments: str, plays: str, created: str) -> DataFrame:
    """By key the exact median rate of works with every number known, how many had not, and works by week of their span."""
    rate = V.interaction_rate(F.col(likes), F.col(comments), F.col(plays))
    days = F.greatest(F.date_diff(F.max(created), F.min(created)), F.lit(1))
    return df.withColumn("_r", rate).groupBy(key).agg(F.median("_r").alias("median_rate"), F.count("_r").alias("usable"), F.count_if(F.col("_r").isNull()).alias("missing"), F.when(F.count(created) > 1, V.per_week(F.count(created), days)).alias("per_week"))


def first_facts(frames: list[DataFrame], key: str, fields: list[str]) -> DataFrame:
    """For each key the first frame's value of every field that isn't NULL there."""
    spread = [f.select(key, F.lit(i).alias("_i"), *fields) for i, f in enumerate(frames)]
    rows = spread[0]
    for more in spread[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(key).agg(*[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("_i"))).alias(f) for f in fields])


def route_findings(df: DataFrame, route: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """Each route with lists of the highlights, risks and defects whose rule holds; a route that comes twice is an error."""
    from pyspark.sql import Window

    once = df.withColumn(route, F.when(F.count("*").over(Window.partitionBy(route)) > 1, F.raise_error(F.concat(F.lit("repeated route "), F.col(route))).cast("string")).otherwise(F.col(route)))
    lists = {kind: F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(c, F.lit(n)) for n, (k, c) in rules.items() if k == kind])) for kind in ("highlight", "risk", "defect")}
    return once.select(route, *[c.alias(f"{k}s") for k, c in lists.items()])


def unique_edges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Edges once each by the hash of their key; the first by order stays."""
    from proofmill.operators.windows import first_by

    return first_by(df.withColumn("edge_id", F.sha2(F.to_json(F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])), 256)), ["edge_id"], [F.col(c) for c in order])


def size_of(value: Column) -> Column:
    """Elements of a JSON array or fields of a JSON object; NULL for anything else."""
    v = T.whole_json(value)
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    return F.coalesce(F.size(F.try_variant_get(v, "$", "array<variant>")), F.when(fields.isNotNull(), F.size(F.map_keys(fields))))


def config_fingerprint(**fields: Column) -> Column:
    """SHA-256 of the chosen settings with names in order; an absent one is left out."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def effective_attempts(df: DataFrame, started: str, status: str) -> DataFrame:
    """Attempts without those that were dispatched and never started."""
    return df.filter(~(F.col(started).isNull() & F.coalesce(F.col(status).isin("pending", "retryable"), F.lit(False))))


def metadata_faults(df: DataFrame, key: str, fields: str, required: list[str], optional: list[str], version: str, expected: str) -> DataFrame:
    """Coded faults of metadata held as a map: missing and unknown fields, and a version that differs."""
    keys = V.exact_keys(F.col(fields), required)
    extra = F.array_except(keys["unknown"], F.array(*[F.lit(o) for o in optional]).cast("array<string>"))
    wrong = ~F.try_element_at(fields, F.lit(version)).eqNullSafe(F.col(expected))
    return df.select(key, F.concat(F.transform(keys["missing"], lambda k: F.concat(F.lit("missing:"), k)), F.transform(extra, lambda k: F.concat(F.lit("unknown:"), k)), F.when(wrong, F.array(F.lit("version"))).otherwise(F.array().cast("array<string>"))).alias("faults"))


def same_batches(ledger: DataFrame, batches: DataFrame) -> DataFrame:
    """Batches (sequence, record) whose hash isn't the ledger's (sequence, sha256), and those that one side lacks."""
    now = batches.select("sequence", F.sha2("record", 256).alias("sha256"))
    return reconcile(ledger.select("sequence", "sha256"), now, ["sequence"], ["sha256"]).filter("status <> 'same'")


def mark_pending(markers: DataFrame, fresh: DataFrame) -> DataFrame:
    """Markers (fingerprint, state) after new ones: a completed review of the same fingerprint is kept, others become pending."""
    both = markers.select("fingerprint", "state").unionByName(fresh.select("fingerprint", F.lit("pending").alias("state")))
    return both.groupBy("fingerprint").agg(F.when(F.bool_or(F.col("state") == "completed"), "completed").otherwise("pending").alias("state"))


def require_same(stored: DataFrame, now: DataFrame) -> None:
    """Raise if a frozen input or sample would change (a bounded check: the first differences name themselves)."""
    for a, b, what in ((stored, now, "gone"), (now, stored, "new")):
        odd = a.select(*sorted(a.columns)).exceptAll(b.select(*sorted(b.columns))).take(3)
        if odd:
            raise ValueError(f"frozen rows differ ({what}): {odd}")
