"""Whole audits: account discovery, page chains, channel reports.

Each takes DataFrames and returns named DataFrames; nothing is collected.
Order of arrival is data: inputs carry `input_index` and `line`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.functions import text as T
from proofmill.functions import values as V
from proofmill.operators import aggregates as A
from proofmill.operators import joins as J
from proofmill.operators import windows as W
from proofmill.operators.predicates import candidate_evidence, cost_role, either

FIELDS = "handle evidenceKind routeId evidenceId observedAt actionKey sourceUrl contentUrl workUrl contentId seed parentSeed sourceWorkUrl cueEvidenceId routeVariant lookupOnly".split()
INHERITED = ("route_id", "route_variant", "lookup_only", "parent_seed", "source_work_url", "cue_evidence_id")


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def account_audit(accounts: DataFrame, actions: DataFrame, invalid: DataFrame, baseline: DataFrame, target: int, hosts: list[str]) -> dict[str, DataFrame]:
    """Entities credited to their first candidate observation, route metrics, overlaps, costs and exclusions.

    accounts and actions may name fields in camel or snake case; invalid has
    (handle, evidence_id), baseline has (handle).
    """
    rows = accounts.select("input_index", "line", *[either(accounts, f).alias(_snake(f)) for f in FIELDS]).withColumns({
        "handle": T.normal_handle(F.col("handle"), hosts), "evidence_id": T.evidence_id(F.col("evidence_id")), "lookup_only": F.col("lookup_only").cast("boolean"), "time": V.zoned_time(F.col("observed_at")),
    })
    acts = actions.select("input_index", "line", *[either(actions, f).alias(_snake(f)) for f in ("actionKey", "attemptId", "routeId", "status", "phase", "slot", "costRole", "durationMs", "startedAt", "finishedAt", "routeVariant", "lookupOnly", "parentSeed", "sourceWorkUrl", "cueEvidenceId")])
    acts = acts.withColumn("lookup_only", F.col("lookup_only").cast("boolean")).withColumn("_ord", F.struct("input_index", "line"))
    merged = J.attach_last(rows, acts.select("action_key", "_ord", *INHERITED), "action_key", "_ord", list(INHERITED)).withColumn("route_id", F.coalesce("route_id", F.lit("unknown")))

    refused = invalid.select(T.normal_handle(F.col("handle"), hosts).alias("handle"), T.evidence_id(F.col("evidence_id")).alias("evidence_id"), F.lit(True).alias("_invalid")).distinct()
    frozen = baseline.select(T.normal_handle(F.col("handle"), hosts).alias("handle"), F.lit(True).alias("_frozen")).filter("handle is not null").distinct()
    judged = merged.join(refused, ["handle", "evidence_id"], "left").join(frozen, "handle", "left")
    excluded = A.ladder(
        "", (F.col("handle").isNull(), "invalid_handle"), (F.coalesce(F.col("evidence_kind") == "reference_only", F.lit(False)), "reference_only"), (F.col("_invalid").isNotNull(), "exact_invalid"),
        (F.col("evidence_id").isNull() | F.col("time").isNull(), "missing_evidence"), (F.col("_frozen").isNotNull(), "baseline"),
    )
    judged = judged.withColumn("excluded", F.nullif(excluded, F.lit("")))
    enriching = F.col("route_id").rlike(r"(?i)^(?:profile_)?enrich(?:ment)?$")
    live = judged.filter("excluded is null").withColumn("candidate", ~enriching & candidate_evidence({c: F.col(c) for c in (_snake(f) for f in FIELDS)}, hosts)).drop("_invalid", "_frozen", "excluded")

    order = ["time", "input_index", "line"]
    first = W.first_by(live.filter("candidate"), ["handle"], [F.col(c) for c in order])
    pools = W.split_at(first.select("handle", F.col("route_id").alias("first_route"), *order), order, target).select("handle", "first_route", "rank", "pool")
    seen = live.groupBy("handle").agg(F.min("time").alias("first_seen"), F.count("*").alias("n_rows"), F.array_sort(F.collect_set("route_id")).alias("routes"), F.array_sort(F.collect_set(F.when(F.col("candidate"), F.col("route_id")))).alias("candidate_routes"))
    entities = seen.join(pools, "handle", "left").withColumn("pool", F.coalesce("pool", F.lit("support_only")))

    own = live.join(pools, "handle", "left")
    first_in = lambda cond: F.count_distinct(F.when(cond & (F.col("first_route") == F.col("route_id")), F.col("handle")))
    routes = own.groupBy("route_id").agg(
        F.count("*").alias("n_rows"), F.count_distinct("handle").alias("own_new"), F.count_distinct(F.when(F.col("candidate"), F.col("handle"))).alias("candidate_new"),
        first_in(F.lit(True)).alias("first_credited"), first_in(F.col("pool") == "target").alias("first_target"), F.count_distinct(F.when(F.col("candidate") & (F.col("pool") == "target"), F.col("handle"))).alias("target_observed"),
    )
    role = cost_role(F.col("cost_role"), F.col("phase"), F.col("slot"), F.col("route_id"))
    ms = V.duration_ms(F.col("duration_ms").cast("bigint"), V.zoned_time(F.col("started_at")), V.zoned_time(F.col("finished_at")))
    attempts = W.first_by(acts.filter("action_key is not null"), ["action_key", "attempt_id"], [F.desc("input_index"), F.desc("line")])
    started = attempts.filter(~(V.zoned_time(F.col("started_at")).isNull() & F.coalesce(F.col("status").isin("pending", "retryable"), F.lit(False)))).withColumns({"role": role, "ms": ms})
    costs = A.fixed_domain(started, "role", ["discovery", "enrichment", "diagnostic", "unknown"], {"n": F.count("*"), "known_ms": F.sum("ms"), "untimed": F.count_if(F.col("ms").isNull())})
    spent = started.groupBy(F.coalesce("route_id", F.lit("unknown")).alias("route_id")).agg(F.count("*").alias("attempts"), F.sum("ms").alias("known_ms"))
    return {
        "entities": entities,
        "routes": routes.join(spent, "route_id", "full_outer"),
        "overlaps": J.overlaps(live.filter("candidate"), "handle", "route_id"),
        "costs": costs.withColumns({"n": F.coalesce("n", F.lit(0)), "untimed": F.coalesce("untimed", F.lit(0))}),
        "exclusions": judged.filter("excluded is not null").groupBy("excluded").agg(F.count("*").alias("n")),
    }


def page_chain_audit(pages: DataFrame, start: Column, page_size: int, required: int = 5) -> dict[str, DataFrame]:
    """Is the chain of pages of each scope unbroken, and does it end in enough pages that are all older than start?

    pages: scope, page, request_cursor, next_cursor, has_next, stream_final,
    status, posts array<struct<post_id, published_at>>.  Two verdicts stay apart:
    a broken chain says nothing about the posts themselves.
    """
    dates = F.transform("posts", lambda p: V.zoned_time(p["published_at"]))
    ids = F.array_distinct(F.transform("posts", lambda p: p["post_id"]))
    ok = (F.col("status") == "ok") & F.col("stream_final") & F.col("has_next").isNotNull()
    old = (F.size("posts") >= page_size) & (F.size(ids) >= page_size) & F.forall(dates, lambda d: F.coalesce(d < start, F.lit(False)))
    facts = pages.select("scope", "page", "request_cursor", "next_cursor", F.coalesce(ok, F.lit(False)).alias("ok"), F.coalesce(old, F.lit(False)).alias("old"), F.array_min(dates).alias("earliest"), F.array_max(dates).alias("latest"), ids.alias("ids"))
    good = facts.filter("ok")
    broken = W.chain_breaks(good, ["scope"], "page", F.col("request_cursor"), F.col("next_cursor"))
    per_scope = facts.groupBy("scope").agg(F.count("*").alias("pages"), F.count_if(~F.col("ok")).alias("failed"), F.count_distinct("page").alias("different"), F.max("page").alias("last"))
    gaps = broken.groupBy("scope").agg(F.count("*").alias("breaks"))
    feed = good.filter("page > 0")
    run = W.trailing_run(feed, ["scope"], "page", "old")
    ended = feed.join(run, "scope").join(feed.groupBy("scope").agg(F.max("page").alias("_top")), "scope").filter(F.col("page") > F.col("_top") - F.col("run"))
    old_ids = ended.select("scope", F.explode("ids").alias("id")).groupBy("scope").agg(F.count_distinct("id").alias("old_posts"))
    before = F.lag("earliest").over(Window.partitionBy("scope").orderBy("page"))
    late = feed.filter("latest is not null").withColumn("_before", before).filter(F.col("latest") > F.col("_before")).groupBy("scope").agg(F.count("*").alias("regressions"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = per_scope
    for part in (gaps, run, old_ids, late):
        joined = joined.join(part, "scope", "left")
    verdict = joined.select("scope", "pages", "failed", zero("breaks"), zero("run"), zero("old_posts"), zero("regressions"), ((F.col("different") == F.col("last") + 1) & (F.col("pages") == F.col("different"))).alias("complete"))
    chain = F.col("complete") & (F.col("failed") == 0) & (F.col("breaks") == 0)
    boundary = chain & (F.col("run") >= required) & (F.col("old_posts") >= required * page_size)
    return {"verdicts": verdict.withColumns({"chain_verified": chain, "boundary_verified": boundary, "needs_review": boundary & (F.col("regressions") > 0)}), "breaks": broken}


def channel_report(cards: DataFrame, actions: DataFrame, baseline: DataFrame, target: int) -> dict[str, DataFrame]:
    """Channels by stable id with first discovery and pool, works, route metrics and the queue of unresolved works.

    cards: observed_at, evidence_file, route, action_key, counts boolean, kind,
    work_id, channel_id, channel_name, owner_url; actions: route, status, duration_ms.
    """
    known = cards.filter(F.col("channel_id").isNotNull() & (F.col("route") != "playlist_search") & (F.col("kind") != "playlist"))
    checked = known.withColumn("channel_id", F.when(F.col("channel_id").rlike(r"^UC[A-Za-z0-9_-]{22}$"), F.col("channel_id")).otherwise(F.raise_error(F.concat(F.lit("invalid stable id "), F.col("channel_id"))).cast("string")))
    fresh = J.without(checked, baseline.select("channel_id"), ["channel_id"]).filter("counts")
    order = ["observed_at", "evidence_file", "action_key"]
    first = W.first_by(fresh, ["channel_id"], [F.col(c) for c in order])
    pools = W.split_at(first.select("channel_id", F.col("route").alias("first_route"), *order), ["observed_at", "evidence_file", "channel_id"], target).select("channel_id", "first_route", "rank", "pool")
    named = A.names_and_aliases(checked, "channel_id", "channel_name", "evidence_file").withColumnRenamed("aliases", "other_names")
    urls = checked.groupBy("channel_id").agg(F.array_sort(F.collect_set("owner_url")).alias("urls"), F.count_distinct(F.when(F.col("kind") == "video", F.col("work_id"))).alias("n_works"))
    channels = named.join(urls, "channel_id").join(pools, "channel_id", "left")
    credit = fresh.join(pools, "channel_id")
    per_route = credit.groupBy("route").agg(F.count_distinct("channel_id").alias("independent"), F.count_distinct(F.when((F.col("pool") == "target") & (F.col("first_route") == F.col("route")), F.col("channel_id"))).alias("first_attributed"))
    spent = actions.groupBy("route").agg(F.count("*").alias("actions"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("duration_ms").alias("duration_ms"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    metrics = spent.join(per_route, "route", "left").select("route", "actions", "failed", "duration_ms", zero("independent"), zero("first_attributed")).withColumn("per_minute", F.try_divide(F.col("first_attributed") * 60000.0, F.col("duration_ms")))
    unresolved = cards.filter(F.col("channel_id").isNull() & (F.col("kind") == "video") & F.col("work_id").isNotNull() & (F.col("route") != "playlist_search"))
    queue = J.resolve_owners(unresolved, checked.filter("kind = 'video'"), "work_id", "channel_id")
    return {"channels": channels, "metrics": metrics, "queue": queue}


def sample_frame(metrics_rows: DataFrame, route: str, entity: str, size: int) -> DataFrame:
    """The frozen sample of each route: smallest hashes of route:entity."""
    return W.frozen_sample(metrics_rows.select(route, entity).distinct(), [route], F.concat_ws(":", route, entity), size)
