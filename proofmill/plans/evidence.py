"""Queries of evidence, review and run operators over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.catalog import query, table
from proofmill.operators import evidence as E
from proofmill.operators import joins as J

_RUNS = """WITH r AS (SELECT o_orderpriority AS experiment, o_orderstatus AS side, count(*) AS actions, count(*) FILTER (WHERE o_totalprice < 20000) AS blocked, count(*) FILTER (WHERE o_totalprice > 100000) AS new_accounts, count(*) FILTER (WHERE o_totalprice > 200000) AS reviewed, count(*) FILTER (WHERE o_totalprice > 300000) AS passed, CASE WHEN o_orderpriority <> '5-LOW' THEN count(*) * 1000 END AS active_ms, 500 AS wait_ms, count(*) AS planned, count(*) - 1 AS completed FROM orders GROUP BY 1, 2),
m AS (SELECT *, passed / nullif((active_ms + wait_ms) / 3600000.0, 0) AS passed_per_hour, passed / nullif(reviewed, 0) AS pass_rate, reviewed / nullif(new_accounts, 0) AS coverage, blocked / nullif(actions, 0) AS blocked_rate, completed / nullif(planned, 0) AS completion FROM r)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("experiment"), F.col("o_orderstatus").alias("side")).agg(
        F.count("*").alias("actions"), F.count_if(p < 20000).alias("blocked"), F.count_if(p > 100000).alias("new_accounts"), F.count_if(p > 200000).alias("reviewed"), F.count_if(p > 300000).alias("passed"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.count("*") * 1000).alias("active_ms"), F.lit(500).alias("wait_ms"), F.count("*").alias("planned"), (F.count("*") - 1).alias("completed"),
    )
    return E.run_metrics(runs)


@query(_RUNS + " SELECT experiment, side, round(passed_per_hour, 6) AS passed_per_hour, round(pass_rate, 6) AS pass_rate, round(coverage, 6) AS coverage, round(blocked_rate, 6) AS blocked_rate FROM m")
def run_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("experiment", "side", *[F.round(c, 6).alias(c) for c in ("passed_per_hour", "pass_rate", "coverage", "blocked_rate")])


def _lacks(cond: str) -> str:
    return f"NOT coalesce({cond}, false)"


_WHY = ", ".join(f"CASE WHEN {_lacks(c)} THEN '{n}' END" for n, c in [
    ("baseline_few_actions", "b.actions >= 20"), ("candidate_few_actions", "c.actions >= 20"), ("baseline_few_reviews", "b.reviewed >= 30"), ("candidate_few_reviews", "c.reviewed >= 30"),
    ("baseline_low_coverage", "b.coverage >= 0.5"), ("candidate_low_coverage", "c.coverage >= 0.5"), ("throughput_not_better", "c.passed_per_hour >= b.passed_per_hour * 1.05"),
    ("pass_rate_worse", "c.pass_rate >= b.pass_rate"), ("coverage_worse", "c.coverage >= b.coverage"), ("blocked_worse", "c.blocked_rate <= b.blocked_rate"), ("completion_worse", "c.completion >= b.completion"),
])


@query(_RUNS + f" SELECT b.experiment, concat_ws(',', {_WHY}) AS reasons FROM m b JOIN m c ON b.experiment = c.experiment AND b.side = 'O' AND c.side = 'F'")
def experiment_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    gated = E.experiment_gate(runs.filter("side = 'O'").drop("side"), runs.filter("side = 'F'").drop("side"))
    return gated.select("experiment", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT l_suppkey, round(median((l_tax + l_discount) / l_quantity) FILTER (WHERE l_linenumber <> 3), 8) AS median_rate, count(*) FILTER (WHERE l_linenumber <> 3) AS usable, count(*) FILTER (WHERE l_linenumber = 3) AS missing, round(count(*) * 7 / greatest(date_diff('day', CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE)), 1), 6) AS per_week FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def work_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("plays", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))
    found = E.sample_statistics(rows, "l_suppkey", "l_tax", "l_discount", "plays", "l_shipdate").filter("usable + missing > 1")
    return found.withColumns({"median_rate": F.round("median_rate", 8), "per_week": F.round("per_week", 6)})


@query("""SELECT o_orderkey, trim(CASE WHEN c_custkey IS NULL THEN 'unknown_reference ' ELSE '' END || CASE WHEN n > 1 THEN 'several_reviews ' ELSE '' END || CASE WHEN c_custkey IS NOT NULL AND o_orderstatus = 'P' THEN 'unknown_work ' ELSE '' END
|| CASE WHEN c_custkey IS NOT NULL AND o_orderstatus <> 'P' AND NOT contains(lower(c_name), lower('#00000' || substr(CAST(10000 + o_custkey % 97 AS VARCHAR), 2))) THEN 'quote_not_found' ELSE '' END) AS faults
FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) o LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""")
def review_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("reference_id"), F.lit("w").alias("work_id"), F.col("c_name").alias("caption"), F.lit(1).alias("window_start"), F.lit(2).alias("window_end"))
    quote = F.concat(F.lit("#00000"), F.substring((10000 + F.col("o_custkey") % 97).cast("string"), 2, 4))
    orders = table(spark, sf_dir, "orders")
    reviews = orders.select(F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("reference_id"), F.when(F.col("o_orderstatus") == "P", "none").otherwise("w").alias("work_id"), F.lit(1).alias("window_start"), F.lit(2).alias("window_end"), quote.alias("quote"))
    found = E.review_faults(reviews, works)
    # A quote can't be looked up without its work, which is a fault of its own.
    return found.select(F.col("review_id").alias("o_orderkey"), F.array_join("faults", " ").alias("faults"))


@query("SELECT l_returnflag AS label, count(DISTINCT l_orderkey) AS entities FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def tag_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A list for each flag of an order: sets of an order would be aggregated as objects, by sorting whole partitions.
    lists = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag").distinct().select("l_orderkey", F.array("l_returnflag").alias("tags"))
    labels = spark.createDataFrame([("A", "A"), ("R", "R")], "tag string, label string")
    return E.label_tags(lists, "l_orderkey", "tags", labels)[0].select("label", "entities")


@query("SELECT c_custkey, coalesce(o_orderstatus, c_mktsegment) AS status FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON o_custkey = c_custkey")
def first_valid_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    own = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("status"))
    facts = E.first_facts([last, own], "c_custkey", ["status"])
    return facts.join(own.select("c_custkey"), "c_custkey", "left_semi")


@query("SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k, 1 AS fields FROM events")
def clean_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.regexp_replace("props", r"^\{", '{"Cookie": "x", "_t": 1, ')
    cleaned = table(spark, sf_dir, "events").select("event_id", E.without_secrets(raw).alias("j"))
    return cleaned.select("event_id", F.get_json_object("j", "$.k").cast("int").alias("k"), E.size_of(F.col("j")).alias("fields"))


@query("SELECT o_custkey, count(*) AS edges FROM (SELECT DISTINCT o_custkey, o_orderpriority, o_orderstatus FROM orders) GROUP BY 1")
def unique_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.unique_edges(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority", "o_orderstatus"], ["o_orderkey"])
    return found.groupBy("o_custkey").agg(F.count("*").alias("edges"))


@query("SELECT event_id FROM events WHERE NOT (event_id % 4 = 0 AND event_type = 'click')")
def effective_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    started = F.when(F.col("event_id") % 4 != 0, F.col("ts"))
    rows = table(spark, sf_dir, "events").select("event_id", started.alias("started"), F.when(F.col("event_type") == "click", "pending").otherwise("complete").alias("status"))
    return E.effective_attempts(rows, "started", "status").select("event_id")


@query("SELECT p_partkey AS key, CASE WHEN p_size > 40 THEN 'changed' WHEN p_size < 5 THEN 'left_only' ELSE 'right_only' END AS status FROM part WHERE p_size > 40 OR p_size < 5 OR p_size = 7")
def ledger_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sequence"), F.col("p_name").alias("record"), "p_size")
    lost = F.col("p_size") == 7
    ledger = parts.filter(~lost | (F.col("p_size") > 40) | (F.col("p_size") < 5)).select("sequence", F.sha2(F.when(F.col("p_size") > 40, "other").otherwise(F.col("record")), 256).alias("sha256"))
    return E.same_batches(ledger, parts.filter("p_size >= 5")).select(F.col("sequence").alias("key"), "status")


@query("SELECT a.user_id AS user_id, count(*) AS n FROM events a JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') b USING (user_id) WHERE a.event_type = 'view' GROUP BY 1")
def seen_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    buyers = events.filter("event_type = 'purchase'").select("user_id").distinct()
    return J.pair_streams(events.filter("event_type = 'view'"), buyers, ["user_id"], F.lit(True)).groupBy("user_id").agg(F.count("*").alias("n"))
