"""Queries of validation, ordering and derived fields over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.catalog import query, table
from proofmill.functions import text as T
from proofmill.functions import values as N
from proofmill.operators import aggregates as A
from proofmill.operators import ordering as O  # noqa: E741
from proofmill.operators import predicates as P
from proofmill.operators import validation as V


@query("""WITH c AS (SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'negative_budget' END, CASE WHEN c_name IS NULL OR NOT regexp_matches(c_name, '[02468]$') THEN 'bad_name' END, CASE WHEN c_nationkey <> c_custkey % 25 THEN 'conflicting_nation' END) AS errors,
concat_ws(',', CASE WHEN c_mktsegment = 'BUILDING' THEN 'which_segment' END, CASE WHEN c_acctbal BETWEEN 0 AND 100 THEN 'confirm_budget' END) AS questions, CASE WHEN c_acctbal BETWEEN 0 AND 5000 THEN c_acctbal END AS budget FROM customer)
SELECT *, CASE WHEN errors <> '' THEN 'invalid' WHEN questions <> '' THEN 'needs_answers' ELSE 'ready' END AS status FROM c""")
def intake_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    errors = V.coded((c("c_acctbal") < 0, "negative_budget"), (~F.coalesce(c("c_name").rlike("[02468]$"), F.lit(False)), "bad_name"), (V.conflict(c("c_nationkey"), c("c_custkey") % 25), "conflicting_nation"))
    questions = V.coded((c("c_mktsegment") == "BUILDING", "which_segment"), (c("c_acctbal").between(0, 100), "confirm_budget"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.array_join(errors, ",").alias("errors"), F.array_join(questions, ",").alias("questions"), V.bounded(c("c_acctbal"), 0, 5000).alias("budget"), V.intake_status(errors, questions).alias("status")
    )


@query("""WITH p AS (SELECT o_orderpriority AS key, round(avg(o_totalprice) / 100000, 3) AS weight FROM orders GROUP BY o_orderpriority UNION ALL SELECT o_orderstatus, round(avg(o_totalprice) / 100000, 3) FROM orders GROUP BY o_orderstatus UNION ALL SELECT '5-LOW', NULL)
SELECT key, weight, CASE WHEN key NOT IN ('1-URGENT', '2-HIGH', '5-LOW', 'P') THEN 'unknown_key' WHEN count(*) OVER (PARTITION BY key) > 1 THEN 'repeated_key' WHEN weight IS NULL THEN 'no_weight' WHEN weight NOT BETWEEN 0.5 AND 1.45 THEN 'out_of_bounds' END AS refused FROM p""")
def weight_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = [orders.groupBy(F.col(c).alias("key")).agg(F.round(F.avg("o_totalprice") / 100000, 3).alias("weight")) for c in ("o_orderpriority", "o_orderstatus")]
    policy = rows[0].unionByName(rows[1]).unionByName(spark.createDataFrame([("5-LOW", None)], "key string, weight double"))
    return V.weight_policy(policy, "key", "weight", ["1-URGENT", "2-HIGH", "5-LOW", "P"], 0.5, 1.45)


@query("""WITH t AS (SELECT event_id, json_type(props, '$.k') AS k, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{"k": "' || event_type || '"}' ELSE '{"k": [' || user_id || ']}' END AS j FROM events)
SELECT event_id, CASE WHEN json_type(j, '$.k') = 'VARCHAR' THEN j ->> '$.k' END AS k, CASE json_type(j, '$.k') WHEN 'VARCHAR' THEN NULL WHEN 'UBIGINT' THEN 'not_text:integer' WHEN 'BIGINT' THEN 'not_text:integer' WHEN 'ARRAY' THEN 'not_text:array' WHEN 'DOUBLE' THEN 'not_text:number' END AS issue FROM t""")
def typed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("event_id") % 3
    j = F.when(third == 0, F.col("props")).when(third == 1, F.concat(F.lit('{"k": "'), "event_type", F.lit('"}'))).otherwise(F.concat(F.lit('{"k": ['), F.col("user_id").cast("string"), F.lit("]}")))
    text, issue = V.typed_text(j, "$.k")
    return table(spark, sf_dir, "events").select("event_id", text.alias("k"), issue.alias("issue"))


@query("SELECT l_orderkey, l_linenumber, (o_orderstatus IS NOT DISTINCT FROM l_linestatus) AND (nullif(l_returnflag, 'N') IS NOT DISTINCT FROM CASE WHEN o_orderstatus = 'F' THEN 'R' END) AS same FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def scope_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), c("l_orderkey") == c("o_orderkey"))
    fields = {"status": (c("o_orderstatus"), c("l_linestatus")), "flag": (F.nullif(c("l_returnflag"), F.lit("N")), F.when(c("o_orderstatus") == "F", "R"))}
    return joined.select("l_orderkey", "l_linenumber", V.same_scope(fields).alias("same"))


_CARDS = """WITH a AS (SELECT o_custkey, list(o_orderkey % 50) AS shown, list(o_orderkey % 50) FILTER (WHERE o_orderstatus = 'F') AS answered, list(o_orderkey % 50) FILTER (WHERE o_orderpriority <> '1-URGENT') AS earlier, min(o_orderpriority) AS asked, max(o_orderpriority) AS seen FROM orders GROUP BY 1)"""


@query(_CARDS + """ SELECT o_custkey, coalesce(seen = asked AND list_has_any(shown, answered), false) AS ready, seen = asked AND list_sort(list_distinct(shown)) <> list_sort(list_distinct(coalesce(earlier, []))) AS retained,
'No results for ' || seen || '.' = 'No results for ' || asked || '.' AS empty FROM a""")
def search_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    card = (c("o_orderkey") % 50).cast("string")
    views = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.collect_list(card).alias("shown"), F.collect_list(F.when(c("o_orderstatus") == "F", card)).alias("answered"), F.collect_list(F.when(c("o_orderpriority") != "1-URGENT", card)).alias("earlier"),
        F.min("o_orderpriority").alias("asked"), F.max("o_orderpriority").alias("seen"),
    )
    message = F.concat(F.lit("No results for  "), F.upper("seen"), F.lit("."))
    return views.select(
        "o_custkey", V.search_ready(c("shown"), c("answered"), c("seen"), c("asked")).alias("ready"), V.retain_after_timeout(c("shown"), c("earlier"), c("seen"), c("asked")).alias("retained"),
        V.empty_for_query(message, c("asked"), r"No results for +(.*)\.$").alias("empty"),
    )


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'suppressed' END AS o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE 0 END AS o_custkey FROM orders")
def untrusted_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey", "o_orderstatus")
    return V.suppress_untrusted(rows, F.col("o_orderstatus") == "F", {"o_orderpriority": F.lit("suppressed"), "o_custkey": F.lit(0)}).drop("o_orderstatus")


@query("""WITH g AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority) FILTER (WHERE o_totalprice > 150000))) AS t, bool_and(o_orderstatus <> 'P') AS ok FROM orders GROUP BY 1)
SELECT o_custkey, coalesce(array_to_string(t, ','), '') AS targets, CASE WHEN NOT ok THEN 'blocked' WHEN len(coalesce(t, [])) = 0 THEN 'none' ELSE 'proposed' END AS state FROM g""")
def run_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.proposals(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_totalprice") > 150000, "o_orderpriority", F.col("o_orderstatus") != "P")
    return found.withColumn("targets", F.array_join("targets", ","))


@query("""WITH m AS (SELECT CASE WHEN event_type = 'error' THEN 'thread' ELSE 'item' END AS level, CASE WHEN event_type = 'error' THEN user_id ELSE event_id % 97 END AS id, event_type AS reason, event_id FROM events WHERE value > 60)
SELECT level, id, arg_min(reason, event_id) AS reason, count(*) AS marks FROM m GROUP BY ALL""")
def unavailable_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 97).alias("item"), "event_type", F.when(F.col("value") > 60, F.col("event_type")).alias("reason"))
    return V.unavailable(rows, "item", "user_id", F.when(F.col("event_type") == "error", "thread").otherwise("item"), "reason", "event_id")


@query("""WITH c AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 2 ELSE 3 END AS v, c_nationkey AS pages, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN c_nationkey ELSE c_nationkey + 1 END AS nxt, list_concat(list(o_orderpriority ORDER BY o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL AND o_totalprice > 250000), []) AS h FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT id, concat_ws(',', CASE WHEN v <> 3 THEN 'version' END, CASE WHEN nxt <> pages + 1 THEN 'page_arithmetic' END, CASE WHEN len(coalesce(h, [])) = 0 THEN 'no_history' END, CASE WHEN len(list_distinct(h)) < len(h) THEN 'repeated_file' END, CASE WHEN list_contains(h, '5-LOW') THEN 'missing_file' END) AS faults FROM c""")
def checkpoint_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    orders = table(spark, sf_dir, "orders").filter("o_totalprice > 250000").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("h"))
    customers = table(spark, sf_dir, "customer").join(orders, c("o_custkey") == c("c_custkey"), "left")
    made = customers.select(
        c("c_custkey").alias("id"), F.when(c("c_acctbal") < 0, 2).otherwise(3).alias("schema_version"), c("c_nationkey").alias("pages"),
        F.when(c("c_mktsegment") == "AUTOMOBILE", c("c_nationkey")).otherwise(c("c_nationkey") + 1).alias("next_page"), F.coalesce("h", F.array().cast("array<string>")).alias("history"),
    )
    there = table(spark, sf_dir, "orders").filter("o_orderpriority <> '5-LOW'").select(c("o_orderpriority").alias("name"))
    return V.checkpoint_faults(made, 3, there).withColumn("faults", F.array_join("faults", ","))


@query("SELECT l_partkey, CAST(min(l_orderkey * 10 + l_linenumber) AS BIGINT) AS first FROM lineitem GROUP BY 1")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("at"))
    return O.first_seen(rows, "l_partkey", "at")


@query("SELECT o_custkey, count(DISTINCT (o_orderstatus, o_orderpriority)) AS n, min(o_orderstatus) AS first FROM orders GROUP BY 1")
def structural_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.structural_distinct(table(spark, sf_dir, "orders"), "o_custkey", F.struct("o_orderstatus", "o_orderpriority"))
    return found.select("o_custkey", F.size("items").cast("long").alias("n"), F.element_at("items", 1)["o_orderstatus"].alias("first"))


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(flatten(list([o_orderstatus, o_orderpriority])))), ',') AS sources FROM orders GROUP BY 1")
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "orders").select("o_custkey", F.array("o_orderstatus", "o_orderpriority").alias("s"))
    return O.merged_sources(lists, "o_custkey", "s").withColumn("sources", F.array_join("sources", ","))


@query("SELECT l_suppkey, least(min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END), min(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS INTEGER) END)) AS depth FROM lineitem GROUP BY 1")
def least_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(flag == "R", F.col("l_linenumber")).alias("source"), F.when(flag == "A", F.col("l_quantity").cast("int")).alias("profile"))
    return O.least_depth(rows, "l_suppkey", ["source", "profile"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate END DESC NULLS LAST, o_orderkey) AS place FROM orders")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderdate")).alias("day"))
    return O.placed(rows, [("day", True), ("o_orderkey", False)]).select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY (c_mktsegment <> 'BUILDING'), c_name, c_custkey) AS place, row_number() OVER (ORDER BY CASE WHEN c_acctbal > 0 THEN c_nationkey END NULLS LAST, c_name, c_custkey) AS by_rank FROM customer")
def people_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", (F.col("c_mktsegment") == "BUILDING").alias("topic"), F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("rank_"))
    by_topic = O.placed(rows, [("topic", True), ("c_name", False), ("c_custkey", False)])
    return O.placed(by_topic, [("rank_", False), ("c_name", False), ("c_custkey", False)], "by_rank").select("c_custkey", F.col("place").cast("long").alias("place"), F.col("by_rank").cast("long").alias("by_rank"))


@query("SELECT p_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY p_type QUALIFY place <= 20")
def tags_until_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return O.until_budget(counts, [("n", True), ("p_type", False)], 20).select("p_type", "n", F.col("place").cast("long").alias("place"))


@query("SELECT 0 AS input, n_nationkey AS key FROM nation UNION ALL SELECT 1, r_regionkey FROM region UNION ALL SELECT 2, n_nationkey FROM nation WHERE n_regionkey = 1")
def union_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = lambda df, c: df.select(F.col(c).alias("key"))
    return O.union_in_order([key(nations, "n_nationkey"), key(regions, "r_regionkey"), key(nations.filter("n_regionkey = 1"), "n_nationkey")])


@query("SELECT l_returnflag, l_linestatus, CASE WHEN l_linenumber > 2 THEN l_linenumber END AS line, CASE WHEN l_quantity > 40 THEN 'large' END AS size, count(*) AS n, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT AS errors FROM lineitem GROUP BY ALL")
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by four keys that may be unknown; unknown is a group of its own."""
    keys = ["l_returnflag", "l_linestatus", F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).alias("line"), F.when(F.col("l_quantity") > 40, "large").alias("size")]
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("errors"))


@query(r"""WITH t AS (SELECT lang, 'tag' AS kind, unnest(regexp_extract_all(replace(text, ' th', ' #th'), '#([\p{L}\p{N}_]+)', 1)) AS name FROM documents)
SELECT lang, kind, lower(name) AS name, count(*) AS n FROM t GROUP BY ALL""")
def tags_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each tag stands in the texts of a reference."""
    tags = F.regexp_extract_all(F.replace("text", F.lit(" th"), F.lit(" #th")), F.lit(r"#([\p{L}\p{N}_]+)"), 1)
    each = table(spark, sf_dir, "documents").select("lang", F.explode(tags).alias("name"))
    return each.groupBy("lang", F.lit("tag").alias("kind"), F.lower("name").alias("name")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS records, count(*) FILTER (WHERE quality = 1) AS accepted, count(*) FILTER (WHERE quality = 0) AS rejected, count(*) FILTER (WHERE toxic = 1) AS flagged, count(*) FILTER (WHERE quality IS NULL) AS open FROM documents LEFT JOIN labels USING (doc_id)")
def store_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a store in one pass."""
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    q = F.col("quality")
    return rows.agg(F.count("*").alias("records"), F.count_if(q == 1).alias("accepted"), F.count_if(q == 0).alias("rejected"), F.count_if(F.col("toxic") == 1).alias("flagged"), F.count_if(q.isNull()).alias("open"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'p' ELSE 'reel' END AS format, CASE WHEN p_size % 4 > 0 THEN 'Ab_' || p_partkey END AS shortcode, CASE WHEN p_size % 4 = 2 THEN 'author.' || p_size END AS author FROM part""")
def work_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, code = F.col("p_size") % 4, F.concat(F.lit("Ab_"), F.col("p_partkey").cast("string"))
    path = F.when(kind == 0, F.concat(F.lit("/x/y/"), code)).when(kind == 1, F.concat(F.lit("/p/"), code, F.lit("/"))).when(kind == 2, F.concat(F.lit("/author."), F.col("p_size").cast("string"), F.lit("/reels/"), code)).otherwise(F.concat(F.lit("/reel/"), code))
    work = T.work_url(F.concat(F.lit("https://www.site.com"), path), ["www.site.com"])
    return table(spark, sf_dir, "part").select("p_partkey", work["format"].alias("format"), work["shortcode"].alias("shortcode"), work["author"].alias("author"))


@query("SELECT o_orderkey, lower(to_base(o_orderkey, 36)) AS short, 'search|' || o_orderpriority || '|' || CASE WHEN o_custkey > 50 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS action, o_custkey % 2 = 0 AS agrees FROM orders")
def work_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short ids, action keys, and whether a url names its own group and id."""
    c = F.col
    group = F.when(c("o_custkey") % 2 == 0, c("o_custkey")).otherwise(c("o_custkey") + 1).cast("string")
    url = F.concat(F.lit("https://site.com/groups/"), group, F.lit("/posts/"), c("o_orderkey").cast("string"), F.lit("/"))
    agrees = T.url_id_agrees(url, c("o_orderkey").cast("string"), c("o_custkey").cast("string"), r"/groups/([^/]+)/posts/(\d+)")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.base36(c("o_orderkey")).alias("short"), T.action_key(F.lit("search"), c("o_orderpriority"), F.when(c("o_custkey") > 50, c("o_custkey"))).alias("action"), agrees.alias("agrees"))


@query("SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN floor(c_acctbal) * 1000 WHEN 1 THEN floor(abs(c_acctbal)) WHEN 2 THEN NULL ELSE floor(abs(c_acctbal)) * 10000 END AS followers FROM customer WHERE c_acctbal >= 0 OR c_nationkey % 4 <> 0")
def follower_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, n = F.col("c_nationkey") % 4, F.floor(F.abs("c_acctbal")).cast("string")
    raw = F.when(kind == 0, F.concat(n, F.lit("K"))).when(kind == 1, n).when(kind == 2, F.concat(F.lit("about "), n)).otherwise(F.concat(n, F.lit(" 万")))
    return table(spark, sf_dir, "customer").filter("c_acctbal >= 0 or c_nationkey % 4 <> 0").select("c_custkey", N.follower_count(raw).alias("followers"))


@query("SELECT doc_id, md5(replace(replace(text, chr(10), chr(7)), chr(7), '\\u0007')) AS escaped FROM documents")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.escape_illegal_xml(F.replace("text", F.lit("\n"), F.lit("\x07")))).alias("escaped"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, p_type) AS brand FROM part")
def either_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("brandName"), F.col("p_type").alias("brand_name"))
    return rows.select("p_partkey", P.either(rows, "brandName").alias("brand"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN true WHEN '2-HIGH' THEN o_orderstatus = 'F' WHEN '5-LOW' THEN o_orderstatus <> 'P' ELSE false END AS credited FROM orders""")
def candidate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards by route, authors by a work url that agrees with the content id, lookups by their whole chain."""
    c, none = F.col, F.lit(None).cast("string")
    prio, status, key = c("o_orderpriority"), c("o_orderstatus"), F.concat(F.lit("w"), c("o_orderkey").cast("string"))
    handle = F.concat(F.lit("cust."), c("o_custkey").cast("string"))
    profile, work = F.concat(F.lit("https://site.com/"), handle, F.lit("/")), F.concat(F.lit("https://site.com/p/"), key, F.lit("/"))
    card, author, lookup = prio == "1-URGENT", prio == "2-HIGH", prio == "5-LOW"
    row = {
        "handle": handle, "route_id": F.when(card, "following").when(author, "keyword_content").when(lookup, "profile_credit_repost").otherwise("unknown"),
        "evidence_kind": F.when(card, "account_card").when(author, "content_author").when(lookup, "profile").otherwise("none"),
        "source_url": F.when(card | lookup, profile), "content_url": F.when(author, work), "work_url": none, "source_work_url": F.when(lookup & (status != "P"), work),
        "content_id": F.when(author, F.when(status == "F", key).otherwise("another")), "lookup_only": lookup, "route_variant": F.when(lookup, "named_profile_lookup"),
        "seed": handle, "parent_seed": F.lit("parent.seed"), "cue_evidence_id": F.lit("cue-1"),
    }
    return table(spark, sf_dir, "orders").select("o_orderkey", P.candidate_evidence(row, ["site.com"]).alias("credited"))


@query("SELECT c_custkey, c_name, n_name AS channel, CASE WHEN o_orderkey IS NULL THEN 'unstarted' ELSE 'started' END AS state, o_orderkey AS latest FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3 LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON o_custkey = c_custkey")
def declared_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared references joined to the corpus (missing ones are unstarted), and profile rows to channels by stable id, latest row wins."""
    c = F.col
    latest = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("latest"))
    channels = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select("n_nationkey", c("n_name").alias("channel"))
    rows = table(spark, sf_dir, "customer").join(channels, c("n_nationkey") == c("c_nationkey"), "left").join(latest, c("o_custkey") == c("c_custkey"), "left")
    return rows.select("c_custkey", "c_name", "channel", F.when(c("latest").isNull(), "unstarted").otherwise("started").alias("state"), "latest")


_ROUTES = """WITH o AS (SELECT event_type AS route, user_id AS handle, CASE WHEN event_id % 9 > 0 THEN 'k' || event_id % 3 END AS kind, value > 30 AS candidate, value > 30 AND event_id = min(CASE WHEN value > 30 THEN event_id END) OVER (PARTITION BY user_id) AS first, user_id % 4 = 0 AS target FROM events WHERE event_type <> 'error'),
a AS (SELECT event_type AS route, ['discovery', 'enrichment', 'diagnostic', 'unknown'][event_id % 4 + 1] AS role, CASE WHEN event_id % 7 > 0 THEN event_id END AS ms, 's' || event_id % 2 AS status, CASE WHEN event_id % 5 > 0 THEN 'end' END AS stop FROM events WHERE event_type <> 'view'),
r AS (SELECT route, count(*) AS observation_rows, count(DISTINCT handle) AS own_unique, count(DISTINCT handle) FILTER (WHERE candidate) AS candidate_unique, count(DISTINCT handle) FILTER (WHERE first) AS first_unique, count(DISTINCT handle) FILTER (WHERE first AND target) AS first_target_unique, count(DISTINCT handle) FILTER (WHERE candidate AND target) AS target_pool_unique FROM o GROUP BY 1),
d AS (SELECT route, count(*) FILTER (WHERE role IN ('discovery', 'enrichment')) AS actions, CAST(sum(ms) FILTER (WHERE role IN ('discovery', 'enrichment')) AS BIGINT) AS known_ms, count(*) FILTER (WHERE role IN ('discovery', 'enrichment') AND ms IS NULL) AS untimed, count(*) AS all_attempts, CAST(sum(ms) AS BIGINT) AS all_known_ms, CAST(sum(ms) FILTER (WHERE role = 'diagnostic') AS BIGINT) AS diagnostic_ms, CAST(sum(ms) FILTER (WHERE role = 'unknown') AS BIGINT) AS unknown_role_ms FROM a GROUP BY 1),
k AS (SELECT route, string_agg(v || ':' || n, ',' ORDER BY v) AS kinds FROM (SELECT route, coalesce(kind, 'unknown') AS v, count(*) AS n FROM o GROUP BY ALL) GROUP BY 1),
s AS (SELECT route, string_agg(v || ':' || n, ',' ORDER BY v) AS statuses FROM (SELECT route, status AS v, count(*) AS n FROM a WHERE role IN ('discovery', 'enrichment') GROUP BY ALL) GROUP BY 1),
t AS (SELECT route, string_agg(v || ':' || n, ',' ORDER BY v) AS stop_reasons FROM (SELECT route, coalesce(stop, 'unknown') AS v, count(*) AS n FROM a WHERE role IN ('discovery', 'enrichment') GROUP BY ALL) GROUP BY 1)
SELECT route, coalesce(observation_rows, 0) AS observation_rows, coalesce(own_unique, 0) AS own_unique, coalesce(candidate_unique, 0) AS candidate_unique, coalesce(first_unique, 0) AS first_unique, coalesce(first_target_unique, 0) AS first_target_unique, coalesce(target_pool_unique, 0) AS target_pool_unique, coalesce(own_unique - candidate_unique, 0) AS support_only_unique,
coalesce(actions, 0) AS actions, known_ms, coalesce(untimed, 0) AS untimed, coalesce(all_attempts, 0) AS all_attempts, all_known_ms, diagnostic_ms, unknown_role_ms, coalesce(kinds, '') AS kinds, coalesce(statuses, '') AS statuses, coalesce(stop_reasons, '') AS stop_reasons
FROM r FULL JOIN d USING (route) LEFT JOIN k USING (route) LEFT JOIN s USING (route) LEFT JOIN t USING (route)"""


@query(_ROUTES)
def route_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    events = table(spark, sf_dir, "events")
    candidate = c("value") > 30
    first = events.filter(candidate & (c("event_type") != "error")).groupBy(c("user_id").alias("_u")).agg(F.min("event_id").alias("_first"))
    joined = events.filter("event_type <> 'error'").join(first, c("user_id") == c("_u"), "left")
    seen = joined.select(c("event_type").alias("route"), c("user_id").alias("handle"), F.when(c("event_id") % 9 > 0, F.concat(F.lit("k"), (c("event_id") % 3).cast("string"))).alias("kind"), candidate.alias("candidate"), (candidate & (c("event_id") == c("_first"))).alias("first"))
    role = F.element_at(F.array(*[F.lit(x) for x in ("discovery", "enrichment", "diagnostic", "unknown")]), (c("event_id") % 4 + 1).cast("int"))
    actions = events.filter("event_type <> 'view'").select(
        c("event_type").alias("route"), role.alias("role"), F.when(c("event_id") % 7 > 0, c("event_id")).alias("ms"), F.concat(F.lit("s"), (c("event_id") % 2).cast("string")).alias("status"), F.when(c("event_id") % 5 > 0, "end").alias("stop")
    )
    return A.route_measures(seen, actions, events.filter("user_id % 4 = 0").select(c("user_id").alias("handle")))


@query("SELECT o_orderkey, l_lines AS works, 'orders' AS source, 1 AS schema_version, o_orderstatus = 'F' AS closed FROM orders JOIN (SELECT l_orderkey, count(*) AS l_lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived count and constants; helper columns go, flags stay."""
    works = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("_works"))
    rows = table(spark, sf_dir, "orders").withColumn("closed", F.col("o_orderstatus") == "F").join(works, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("o_orderkey", F.size("_works").cast("long").alias("works"), F.lit("orders").alias("source"), F.lit(1).alias("schema_version"), "closed")


@query("SELECT o_custkey, count(*) AS expected, count(*) FILTER (WHERE o_orderstatus <> 'F') AS unassessed FROM orders GROUP BY 1")
def unassessed_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that the scope expects and no assessment has."""
    orders = table(spark, sf_dir, "orders")
    left = orders.join(orders.filter("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", "left_anti").groupBy("o_custkey").agg(F.count("*").alias("unassessed"))
    return orders.groupBy("o_custkey").agg(F.count("*").alias("expected")).join(left, "o_custkey", "left").fillna(0, ["unassessed"])
