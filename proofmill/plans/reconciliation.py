"""Queries of joins: baselines, reconciliation, identities, evidence and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.catalog import query, table
from proofmill.operators import aggregates as A
from proofmill.operators import joins as J
from proofmill.operators import windows as W


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 60), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND value > 70)
SELECT (SELECT count(*) FROM a JOIN b USING (user_id)) AS retained, (SELECT count(*) FROM a ANTI JOIN b USING (user_id)) AS missing, (SELECT count(*) FROM b ANTI JOIN a USING (user_id)) AS new""")
def baseline_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return J.compare_sets(events.filter("event_type = 'purchase' AND value > 60"), events.filter("event_type = 'click' AND value > 70"), ["user_id"])


_SNAP = """WITH j AS (SELECT l_orderkey AS k, count(*) AS n, max(l_linenumber) AS top FROM lineitem WHERE l_tax > 0 GROUP BY 1),
s AS (SELECT l_orderkey AS k, count(DISTINCT l_linenumber) AS n, max(l_linenumber) AS top FROM lineitem WHERE l_discount > 0 GROUP BY l_orderkey),
r AS (SELECT k, CASE WHEN s.k IS NULL THEN 'left_only' WHEN j.k IS NULL THEN 'right_only' WHEN s.n = j.n AND s.top = j.top THEN 'same' ELSE 'changed' END AS status,
CASE WHEN s.k IS NULL OR j.k IS NULL THEN '' ELSE concat_ws(',', CASE WHEN s.n <> j.n THEN 'n' END, CASE WHEN s.top <> j.top THEN 'top' END) END AS differs FROM j FULL JOIN s USING (k))"""


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k")
    journal = lines.filter("l_tax > 0").groupBy("k").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("top"))
    snapshot = lines.filter("l_discount > 0").groupBy("k").agg(F.count_distinct("l_linenumber").alias("n"), F.max("l_linenumber").alias("top"))
    return J.reconcile(journal, snapshot, ["k"], ["n", "top"])


@query(_SNAP + " SELECT k, status, differs FROM r")
def reconcile_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir).withColumn("differs", F.array_join("differs", ","))


@query(_SNAP + " SELECT status, count(*) AS n FROM r GROUP BY 1")
def reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tally(_reconciled(spark, sf_dir), "status")


@query("SELECT p_partkey, CASE WHEN l_partkey IS NULL THEN 'left_only' WHEN p_partkey IS NULL THEN 'right_only' ELSE 'same' END AS status FROM part FULL JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40) ON p_partkey = l_partkey WHERE p_partkey IS NOT NULL")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "part").select("p_partkey", F.lit(1).alias("there"))
    used = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"), F.lit(1).alias("there")).distinct()
    return J.reconcile(listed, used, ["p_partkey"], ["there"]).filter("status <> 'right_only'").select("p_partkey", "status")


@query("""WITH o AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS s FROM lineitem WHERE l_quantity >= 49 GROUP BY 1)
SELECT p_partkey, coalesce(n, 0) AS owners, CASE WHEN coalesce(n, 0) = 0 THEN 'pending' WHEN n = 1 THEN 'resolved' ELSE 'conflict' END AS state, CASE WHEN n = 1 THEN s END AS owner FROM part LEFT JOIN o ON p_partkey = l_partkey""")
def identity_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    return J.resolve_owners(table(spark, sf_dir, "part"), owners, "p_partkey", "l_suppkey")


@query("SELECT 'alias' AS kind, p_brand AS key, count(DISTINCT p_type) AS n FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1 UNION ALL SELECT 'conflict', p_type, count(DISTINCT p_brand) FROM part GROUP BY p_type HAVING count(DISTINCT p_brand) > 1")
def identity_alias_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases, conflicts = A.identities(table(spark, sf_dir, "part"), "p_brand", "p_type")
    return aliases.select(F.lit("alias").alias("kind"), F.col("p_brand").alias("key"), "n").union(conflicts.select(F.lit("conflict"), "p_type", "n"))


@query("SELECT o_custkey, count(*) AS children FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0) GROUP BY 1")
def orphan_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.orphans(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").filter("c_acctbal >= 0"), "c_custkey")


@query("""WITH r AS (SELECT o_custkey, unnest([o_orderkey, o_orderkey + 1, o_orderkey * 3]) AS id FROM orders)
SELECT o_custkey, count(DISTINCT id) AS asked, count(DISTINCT o.o_orderkey) AS linked, epoch_us(max(o_orderdate)) AS latest FROM r LEFT JOIN (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F') o ON id = o.o_orderkey GROUP BY 1""")
def evidence_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    reviews = orders.select("o_custkey", F.array(k, k + 1, k * 3).alias("ids"))
    linked = J.link_evidence(reviews, orders.filter("o_orderstatus = 'F'"), ["o_custkey"], "ids", "o_orderkey", "o_orderdate")
    return linked.withColumn("latest", F.unix_micros("latest"))


@query("SELECT d.doc_id, contains(trim(regexp_replace(text, '[ \\n\\t]+', ' ', 'g')), trim(regexp_replace(quote, '[ \\n\\t]+', ' ', 'g'))) AS found FROM documents d JOIN (SELECT doc_id + (doc_id % 2) AS doc_id, substr(text, 5, 40) AS quote FROM documents) q USING (doc_id)")
def quote_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    quotes = docs.select((F.col("doc_id") + F.col("doc_id") % 2).alias("doc_id"), F.substring("text", 5, 40).alias("quote"))
    return J.contains_quote(docs, quotes, "doc_id", "text", "quote").select("doc_id", "found")


_LAB = "SELECT doc_id, CASE WHEN toxic = 1 THEN 'pending' WHEN quality = 1 THEN 'qualified' ELSE 'rejected' END AS verdict FROM labels"


@query(f"""WITH l AS ({_LAB}), c AS (SELECT count(*) AS entities, count(*) FILTER (WHERE verdict = 'qualified') AS qualified, count(*) FILTER (WHERE verdict = 'rejected') AS rejected, count(*) FILTER (WHERE verdict = 'pending') AS pending, count(*) FILTER (WHERE verdict IS NULL) AS unreviewed FROM documents LEFT JOIN l USING (doc_id))
SELECT *, (qualified + rejected) / entities AS decided_share, qualified / nullif(qualified + rejected, 0) AS qualified_share FROM c""")
def assessment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("toxic") == 1, "pending").when(F.col("quality") == 1, "qualified").otherwise("rejected")
    return A.assessment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", verdict.alias("verdict")), "doc_id", "verdict")


@query("SELECT e.event_id, coalesce(CASE WHEN e.event_id % 2 = 0 THEN e.event_type END, a.event_type) AS event_type, a.value AS last_value FROM events e LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events WHERE event_type <> 'view' GROUP BY 1) a USING (user_id)")
def attach_last_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = events.select("event_id", "user_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("event_type"))
    actions = events.filter("event_type <> 'view'").select("user_id", "event_id", "event_type", F.col("value").alias("last_value"))
    return J.attach_last(rows, actions, "user_id", "event_id", ["event_type", "last_value"]).select("event_id", "event_type", "last_value")


@query("SELECT event_id FROM events WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE value > 95 AND user_id IS NOT NULL AND event_type IS NOT NULL)")
def exact_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return J.without(events, events.filter("value > 95"), ["user_id", "event_type"]).select("event_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority IN ('5-LOW', '2-HIGH'))")
def allow_deny_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return J.allowed(table(spark, sf_dir, "customer"), "c_custkey", tags, "o_orderpriority", ["5-LOW", "2-HIGH"], ["1-URGENT"]).select("c_custkey")


@query("SELECT a.conv_id, a.turn, length(b.text) AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant' AND length(b.text) >= length(a.text)")
def pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.length("text").alias("n"))
    answered = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").alias("answer"))
    return J.pair_streams(asked, answered, ["conv_id", "turn"], F.col("answer") >= F.col("n")).select("conv_id", "turn", "answer")


@query("SELECT conv_id, CAST(max(turn) + 1 AS INTEGER) AS depth, true AS complete FROM conversations GROUP BY 1 HAVING count(DISTINCT turn) = max(turn) + 1")
def thread_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _threads(table(spark, sf_dir, "conversations")).filter("complete")


@query("""WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM (SELECT DISTINCT conv_id, turn FROM conversations))
SELECT conv_id, CAST(count(*) FILTER (WHERE turn = place) AS INTEGER) AS depth, false AS complete FROM n GROUP BY 1 HAVING count(*) FILTER (WHERE turn = place) < max(turn) + 1""")
def thread_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _threads(table(spark, sf_dir, "conversations")).filter("not complete")


def _threads(conversations: DataFrame) -> DataFrame:
    """Each conversation with the turns that follow one another from the first, and whether these are all."""
    turns = conversations.select("conv_id", "turn").distinct()
    last = conversations.groupBy(F.col("conv_id").alias("_c")).agg(F.max("turn").alias("top"))
    ends = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("turn") == F.col("top"))
    chain = turns.join(last, ends, "left").select("conv_id", F.col("turn").cast("string").alias("cursor"), F.when(F.col("top").isNull(), (F.col("turn") + 1).cast("string")).alias("following"))
    walked = J.walk_chain(chain, "conv_id", "cursor", "following", "0").withColumnRenamed("conv_id", "_w")
    every = last.join(walked, F.col("_c").eqNullSafe(F.col("_w")), "left")
    return every.select(F.col("_c").alias("conv_id"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), F.coalesce("complete", F.lit(False)).alias("complete"))


@query("WITH f AS (SELECT l_partkey, arg_min(l_suppkey, l_orderkey * 100 + l_linenumber) AS s FROM lineitem GROUP BY 1) SELECT l_partkey, count(*) AS conflicts FROM lineitem JOIN f USING (l_partkey) WHERE l_suppkey <> s GROUP BY 1")
def conflict_checked_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("at"), "l_quantity", "l_extendedprice")
    _, conflicts = J.upsert_checked(lines, "l_partkey", "l_suppkey", [F.col("at")])
    return conflicts.groupBy("l_partkey").agg(F.count("*").alias("conflicts"))


@query("SELECT p_brand, arg_min(p_type, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey END) AS name, count(DISTINCT CASE WHEN p_partkey % 3 <> 0 THEN p_type END) - CASE WHEN count(CASE WHEN p_partkey % 3 <> 0 THEN 1 END) > 0 THEN 1 ELSE 0 END AS n_aliases FROM part GROUP BY 1")
def names_and_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("label", F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")))
    return A.names_and_aliases(parts, "p_brand", "label", "p_partkey").select("p_brand", "name", F.size("aliases").alias("n_aliases"))


@query("SELECT 'kept' AS side, count(*) AS n FROM (SELECT user_id, event_type FROM events WHERE value < 5 INTERSECT SELECT user_id, event_type FROM events WHERE value >= 5) UNION ALL SELECT 'lost', count(*) FROM (SELECT user_id, event_type FROM events WHERE value < 5 EXCEPT SELECT user_id, event_type FROM events WHERE value >= 5)")
def set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    even, odd = (events.filter(cond).select("user_id", "event_type") for cond in ("value < 5", "value >= 5"))
    count = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return count(even.intersect(odd), "kept").union(count(even.subtract(odd), "lost"))


@query("SELECT * FROM (SELECT 0 AS input, user_id FROM events WHERE event_type = 'error' AND value > 50 UNION ALL SELECT 1, user_id FROM events WHERE event_type <> 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 50))")
def incremental_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "value", "user_id")
    prior = events.filter("event_type = 'error' AND value > 50").select(F.lit(0).alias("input"), "user_id")
    fresh = J.without(events.filter("event_type <> 'error'").select(F.lit(1).alias("input"), "user_id"), prior, ["user_id"])
    return prior.unionByName(fresh)


@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY total DESC, n_name LIMIT 5")
def top_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("total")).orderBy(F.desc("total"), "n_name").limit(5)
