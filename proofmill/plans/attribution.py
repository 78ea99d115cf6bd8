"""Queries of first attribution, runs, ranks and route metrics over the events and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.catalog import query, table
from proofmill.operators import aggregates as A
from proofmill.operators import joins as J
from proofmill.operators import windows as W

TARGET = 50
_US = "epoch_us({})"


def _us(c: str) -> Column:
    return F.unix_micros(F.col(c))


def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("user_id"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users outside the frozen baseline (suppliers in debt stand in for it), without error evidence."""
    events = table(spark, sf_dir, "events")
    frozen = _baseline(spark, sf_dir)
    return J.without(events, frozen, ["user_id"]).filter("event_type <> 'error'")


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.first_by(_candidates(spark, sf_dir), ["user_id"], [F.col("ts"), F.col("event_id")])


_FIRST = """WITH cand AS (SELECT * FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) AND event_type <> 'error'),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) rn FROM cand) WHERE rn = 1)"""


@query(_FIRST + " SELECT user_id, event_id, event_type FROM first")
def first_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(spark, sf_dir).select("user_id", "event_id", "event_type")


@query(_FIRST + f" SELECT user_id, row_number() OVER (ORDER BY ts, event_id) AS rank, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= {TARGET} THEN 'target' ELSE 'overflow' END AS pool FROM first")
def target_overflow_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.split_at(_first(spark, sf_dir), ["ts", "event_id"], TARGET).select("user_id", F.col("rank").cast("long").alias("rank"), "pool")


@query(_FIRST + """, credit AS (SELECT c.*, f.event_id IS NOT NULL AS is_first, CASE WHEN c.event_id % 4 <> 0 THEN CAST(floor(c.value) AS BIGINT) END AS ms FROM cand c LEFT JOIN first f USING (event_id)),
dom(event_type) AS (VALUES ('click'), ('view'), ('purchase'), ('never_seen'))
SELECT event_type, coalesce(count(event_id), 0) AS n_rows, count(DISTINCT user_id) AS entities, count(DISTINCT CASE WHEN is_first THEN user_id END) AS credited, CAST(sum(ms) AS BIGINT) AS known_ms,
count(event_id) FILTER (WHERE ms IS NULL) AS untimed, round(count(DISTINCT CASE WHEN is_first THEN user_id END) * 60000.0 / nullif(sum(ms), 0), 6) AS credited_per_minute
FROM dom LEFT JOIN credit USING (event_type) GROUP BY event_type""")
def route_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).select("event_id", "user_id", "event_type", "value", "ts")
    credited = rows.join(_first(spark, sf_dir).select(F.col("event_id").alias("_e")), F.col("event_id") == F.col("_e"), "left").withColumn("is_first", F.col("_e").isNotNull())
    ms = F.when(F.col("event_id") % 4 != 0, F.floor("value").cast("long"))
    found = A.route_metrics(credited, "event_type", "user_id", "is_first", ms)
    domain = spark.createDataFrame([("click",), ("view",), ("purchase",), ("never_seen",)], "event_type string")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_rows", "entities", "credited", "untimed")}
    return domain.join(found, "event_type", "left").withColumns(zero | {"credited_per_minute": F.round("credited_per_minute", 6)})


@query(_FIRST + """ SELECT (SELECT count(*) FROM first) = (SELECT count(DISTINCT user_id) FROM cand) AS one_row_each, (SELECT count(*) FROM first JOIN supplier ON user_id = s_suppkey WHERE s_acctbal < 0) = 0 AS none_frozen,
(SELECT count(*) FROM first WHERE event_type = 'error') = 0 AS none_invalid""")
def qa_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).select("user_id", F.lit(0).alias("is_first"), "event_type").unionByName(_first(spark, sf_dir).select("user_id", F.lit(1).alias("is_first"), "event_type"))
    first = F.col("is_first") == 1
    frozen = _baseline(spark, sf_dir).select("user_id", F.lit(True).alias("frozen"))
    return rows.join(frozen, "user_id", "left").agg(
        (F.count_if(first) == F.count_distinct("user_id")).alias("one_row_each"), (F.count_if(first & F.col("frozen").isNotNull()) == 0).alias("none_frozen"), (F.count_if(first & (F.col("event_type") == "error")) == 0).alias("none_invalid")
    )


@query("""WITH p AS (SELECT DISTINCT user_id, event_type FROM events), n AS (SELECT DISTINCT event_type FROM p)
SELECT x.event_type AS a, y.event_type AS b, (SELECT count(*) FROM p p1 JOIN p p2 USING (user_id) WHERE p1.event_type = x.event_type AND p2.event_type = y.event_type) AS common FROM n x JOIN n y ON x.event_type < y.event_type""")
def route_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.overlaps(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT user_id, event_type, epoch_us(ts) AS ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1")
def latest_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = W.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", ["event_id", "value"])
    return found.withColumn("ts", _us("ts"))


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC, o_totalprice DESC, o_orderdate DESC, o_orderkey DESC) rn FROM orders) WHERE rn = 1")
def best_review_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = [F.col(c) for c in ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderkey")]
    return W.best_by_rank(table(spark, sf_dir, "orders"), ["o_custkey"], rank, ["o_orderkey", "o_orderpriority"])


_OBS = "WITH obs AS (SELECT user_id, event_id, ts - CASE WHEN event_id % 5 = 0 THEN INTERVAL 2 DAY ELSE INTERVAL 0 DAY END AS ts, CASE WHEN event_id % 3 <> 0 THEN value END AS value, CASE WHEN event_id % 4 <> 0 THEN event_type END AS kind FROM events)"


@query(_OBS + """, live AS (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS top FROM obs)
SELECT user_id, epoch_us(max(ts)) AS ts, count(*) AS applied, arg_max(value, CASE WHEN value IS NOT NULL THEN event_id END) AS value, epoch_us(arg_max(ts, CASE WHEN value IS NOT NULL THEN event_id END)) AS value_observed_at,
arg_max(kind, CASE WHEN kind IS NOT NULL THEN event_id END) AS kind, epoch_us(arg_max(ts, CASE WHEN kind IS NOT NULL THEN event_id END)) AS kind_observed_at FROM live WHERE ts >= top GROUP BY user_id""")
def merge_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.when(F.col("event_id") % 5 == 0, F.col("ts") - F.expr("INTERVAL 2 DAYS")).otherwise(F.col("ts"))
    obs = table(spark, sf_dir, "events").select("user_id", "event_id", late.alias("ts"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("kind"))
    merged = W.merge_with_fallback(obs, ["user_id"], "ts", "event_id", ["value", "kind"])
    return merged.withColumns({c: _us(c) for c in ("ts", "value_observed_at", "kind_observed_at")})


_LINES = "WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"


@query(_LINES + ", c AS (SELECT *, lag(l_linenumber + 1) OVER w AS expected, row_number() OVER w AS position FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)) SELECT l_orderkey, l_linenumber, expected, position FROM c WHERE position > 1 AND l_linenumber <> expected")
def cursor_chain_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return W.chain_breaks(lines, ["l_orderkey"], "l_linenumber", F.col("l_linenumber"), F.col("l_linenumber") + 1).select("l_orderkey", "l_linenumber", "expected", "position")


@query("""WITH n AS (SELECT l_orderkey, l_linenumber AS n, lag(l_linenumber, 1, -1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS b FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R'))
SELECT l_orderkey, b + 1 AS missing_from, n - 1 AS missing_to FROM n WHERE n > b + 1""")
def page_sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sequence_gaps(table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'"), ["l_orderkey"], "l_linenumber")


@query("""WITH b AS (SELECT user_id, max(CASE WHEN value >= 20 THEN event_id END) AS broken FROM events GROUP BY user_id)
SELECT user_id, count(*) FILTER (WHERE broken IS NULL OR event_id > broken) AS run FROM events JOIN b USING (user_id) GROUP BY user_id""")
def boundary_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("old", F.col("value") < 20)
    return W.trailing_run(events, ["user_id"], "event_id", "old")


@query("SELECT o_custkey, o_orderkey, epoch_us(previous) AS previous FROM (SELECT *, last_value(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM orders) WHERE o_orderkey % 5 <> 0 AND o_orderdate < previous")
def date_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("seen", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")))
    return W.regressions(orders, ["o_custkey"], ["o_orderkey"], "seen").select("o_custkey", "o_orderkey", _us("previous").alias("previous"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, value < 60 AS clean, value < 30 AS advances FROM events),
m AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AND row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 THEN 0 ELSE 1 END AS brk FROM e),
i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM m),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) rn, count(*) OVER (PARTITION BY user_id, island) n, last_value(advances) OVER (PARTITION BY user_id, island ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS adv FROM i),
h AS (SELECT *, count(*) FILTER (WHERE rn < n AND NOT clean) OVER (PARTITION BY user_id, island) AS bad FROM g)
SELECT user_id, event_id, event_type FROM h WHERE rn = n OR bad > 0 OR NOT adv""")
def retry_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.col("value") < 60).alias("clean"), (F.col("value") < 30).alias("advances"))
    return W.supersede_retries(events, ["user_id"], ["event_id"], ["event_type"], "clean", "advances").select("user_id", "event_id", "event_type")


@query("SELECT doc_id, row_number() OVER (PARTITION BY trim(regexp_replace(lower(text), '[ \\t\\n]+', ' ', 'g')) ORDER BY doc_id) > 1 AS duplicate FROM documents")
def duplicate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.md5(F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n]+", " ")))
    return W.duplicate_flags(table(spark, sf_dir, "documents"), key, [F.col("doc_id")]).select("doc_id", "duplicate")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS in_window, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS gap_micros FROM events")
def sliding_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sliding_count(table(spark, sf_dir, "events"), ["user_id"], "ts", 6 * 3600).select("event_id", "in_window", "gap_micros")


@query("SELECT o_custkey, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def seed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = W.top_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)
    return found.filter("chosen").select("o_custkey", "o_orderkey", "place")


@query("SELECT event_type, user_id, draw FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY draw) rn FROM (SELECT DISTINCT event_type, user_id, sha256(event_type || ':' || user_id) AS draw FROM events)) WHERE rn <= 24")
def frozen_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "events").select("event_type", "user_id").distinct()
    return W.frozen_sample(pairs, ["event_type"], F.concat_ws(":", "event_type", F.col("user_id").cast("string")), 24).select("event_type", "user_id", "draw")


@query("SELECT l_orderkey, batch, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS ids FROM (SELECT l_orderkey, l_linenumber, CAST(floor((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) / 3) AS BIGINT) AS batch FROM lineitem) GROUP BY 1, 2")
def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = W.batches(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber", 3)
    return found.select("l_orderkey", "batch", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT user_id, sum(CASE WHEN new_run THEN 1 ELSE 0 END) AS runs, max(len) AS longest FROM (SELECT user_id, island, count(*) AS len, true AS new_run FROM (SELECT user_id, sum(brk) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM (SELECT user_id, event_id, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS brk FROM events)) GROUP BY 1, 2) GROUP BY 1")
def no_growth_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    changed = ~F.col("event_type").eqNullSafe(F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")))
    marked = W.islands(events.withColumn("_c", changed), ["user_id"], ["event_id"], F.col("_c"))
    return marked.groupBy("user_id", "island").agg(F.count("*").alias("len")).groupBy("user_id").agg(F.count("*").alias("runs"), F.max("len").alias("longest"))


@query("SELECT o_custkey, o_orderpriority, count(*) AS attempts, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, list_aggregate(list_sort(list_distinct(list(o_orderstatus))), 'string_agg', ',') AS sources FROM orders GROUP BY 1, 2")
def action_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.merge_actions(table(spark, sf_dir, "orders").withColumn("source", F.col("o_orderstatus")), ["o_custkey", "o_orderpriority"], ["o_orderkey"], ["o_orderkey", "o_orderstatus"], "source")
    return found.withColumn("sources", F.array_join("sources", ","))
