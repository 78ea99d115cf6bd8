"""Queries over what was read: journal batches, payloads, catalogs, reviews and frozen rows, each made from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.catalog import query, table
from proofmill.folders import shared_folder
from proofmill.functions import text as T
from proofmill.operators import evidence as E
from proofmill.operators import predicates as P
from proofmill.sources import readers as R
from proofmill.sources import sinks as S
from proofmill.streaming import state as ST

#: How each order's batch differs from what its journal should hold, by key modulo 7.
_BATCH_FAULTS = {1: "NAME", 2: "ENVELOPE", 3: "SEQUENCE", 4: "HASH"}


def _key() -> Column:
    return F.col("o_orderkey")


def _batches(orders: DataFrame) -> DataFrame:
    way, text = _key() % 7, _key().cast("string")
    sequence = F.when(way == 3, F.concat(text, F.lit("9"))).otherwise(text)
    record = F.concat(F.lit('{"sequence":'), sequence, F.lit(',"status":"'), "o_orderstatus", F.lit('"}'))
    hashed = F.sha2(F.when(way == 4, F.concat(record, F.lit(" "))).otherwise(record), 256)
    value = F.when(way == 2, record.substr(2, 9999)).otherwise(F.concat(F.lit('{"record":'), record, F.lit(',"sha256":"'), hashed, F.lit('"}')))
    file = F.concat(F.when(way == 1, text).otherwise(F.lpad(text, 8, "0")), F.lit(".json"))
    return orders.select(file.alias("file"), value.alias("value"), _key().alias("sequence"), record.alias("record"), way.alias("way"))


@query("SELECT CASE WHEN o_orderkey % 7 = 1 THEN CAST(o_orderkey AS VARCHAR) ELSE lpad(CAST(o_orderkey AS VARCHAR), 8, '0') END || '.json' AS file, CASE o_orderkey % 7 WHEN 1 THEN 'NAME' WHEN 2 THEN 'ENVELOPE' WHEN 3 THEN 'SEQUENCE' WHEN 4 THEN 'HASH' END AS refused FROM orders")
def batch_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered batches, one for each order, and why one is refused."""
    return R.batch_faults(_batches(table(spark, sf_dir, "orders"))).select("file", "refused")


@query("SELECT o_orderkey AS sequence, CASE WHEN o_orderkey % 7 = 5 THEN 'left_only' WHEN o_orderkey % 7 = 6 THEN 'right_only' ELSE 'changed' END AS status FROM orders WHERE o_orderkey % 7 IN (4, 5, 6)")
def ledger_against_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches whose hash isn't the ledger's, and those that only one side has."""
    rows = _batches(table(spark, sf_dir, "orders"))
    said = F.sha2(F.when(F.col("way") == 4, F.lit("other")).otherwise(F.col("record")), 256)
    return E.same_batches(rows.filter("way <> 6").select("sequence", said.alias("sha256")), rows.filter("way <> 5")).select("sequence", "status")


@query("""
WITH t AS (SELECT conv_id, turn, (conv_id + turn) % 7 AS way FROM conversations)
SELECT conv_id, turn, CASE way WHEN 1 THEN 'not_json' WHEN 2 THEN 'bad_listing_shape' WHEN 3 THEN 'identity_mismatch' WHEN 5 THEN 'bad_more_shape' ELSE 'ok' END AS outcome FROM t
""")
def payload_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as responses of threads and of more children, and what is wrong with each."""
    way = (F.col("conv_id") + F.col("turn")) % 7
    text = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("body")))
    item = F.concat(F.lit("t"), F.col("turn").cast("string"))
    thread = F.concat(F.lit('[{"kind":"Listing","data":{"children":[{"data":{"id":"'), F.when(way == 3, "other").otherwise(item), F.lit('"}}]}},{"kind":"'), F.when(way == 2, "Other").otherwise("Listing"), F.lit('","data":{"children":['), text, F.lit("]}}]"))
    more = F.concat(F.lit('{"json":{"errors":['), F.when(way == 5, "1").otherwise(""), F.lit('],"data":{"things":['), text, F.lit("]}}}"))
    kind = F.when(way.isin(4, 5), "more").otherwise("initial")
    payload = F.when(way == 1, thread.substr(2, 99999999)).when(kind == "more", more).otherwise(thread)
    turns = table(spark, sf_dir, "conversations").withColumns({"payload": payload, "kind": kind, "item": item})
    return turns.select("conv_id", "turn", E.payload_outcome(F.col("payload"), F.col("kind"), F.col("item")).alias("outcome"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey % 5 AS way, CAST(round(o_totalprice) AS BIGINT) AS plays FROM orders)
SELECT o_custkey, count(*) FILTER (way < 3) AS items, CAST(sum(CASE WHEN way < 3 THEN plays END) AS BIGINT) AS plays, count(*) FILTER (way >= 3) AS rejected, CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS more FROM o GROUP BY o_custkey
""")
def item_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing for each customer: items of the owner with captions, how many others were rejected, and whether more follow."""
    way = _key() % 5
    author = F.when(way == 3, "someone").otherwise(F.concat(F.lit("Owner"), F.col("o_custkey").cast("string")))
    caption = F.when(way != 4, F.concat(F.lit("caption "), "o_orderstatus"))
    item = F.struct(_key().cast("string").alias("id"), caption.alias("desc"), F.lit(1.5e9).alias("createTime"), F.struct(author.alias("uniqueId")).alias("author"), F.create_map(F.lit("plays"), F.round("o_totalprice").cast("bigint")).alias("stats"))
    c = F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(item).alias("itemList"))
    more = F.when(c % 3 == 0, "true").when(c % 3 == 1, "0").otherwise("later")
    body = rows.select("o_custkey", F.concat(F.lit("@OWNER"), c.cast("string")).alias("owner"), F.to_json(F.struct("itemList", more.alias("hasMore"), F.lit("c1").alias("cursor"))).alias("body"))
    found = E.listing(body.withColumn("owner", F.lower("owner")), "o_custkey", "body", "owner")
    plays = F.aggregate("items", F.lit(None).cast("double"), lambda a, i: F.coalesce(a, F.lit(0.0)) + i["stats"]["plays"])
    return found.select("o_custkey", F.size("items").alias("items"), plays.cast("bigint").alias("plays"), "rejected", "more")


@query("SELECT page_id, len(regexp_extract_all(html, '<p>')) AS paragraphs, md5(url) AS url FROM pages")
def script_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that a page carries as JSON in a script, read back; other scripts are none."""
    n = F.size(F.regexp_extract_all("html", F.lit("<p>"), 0))
    seed = F.to_json(F.struct("page_id", n.alias("paragraphs"), F.struct("url").alias("page")))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.lit('<script async type="application/json" data-x>'), seed, F.lit("</script>")).alias("html"))
    found = pages.select("page_id", F.explode(R.script_json(F.col("html"))).alias("j")).select("page_id", F.try_parse_json("j").alias("v"))
    return found.select("page_id", F.try_variant_get("v", "$.paragraphs", "bigint").alias("paragraphs"), F.md5(F.try_variant_get("v", "$.page.url", "string").cast("binary")).alias("url"))


@query("""
WITH e AS (SELECT CASE p_partkey % 4 WHEN 1 THEN upper(p_brand) ELSE 'part-' || (p_partkey - p_partkey % 4) END AS name, CASE p_partkey % 4 WHEN 3 THEN 'a/../' ELSE 'a/' END || p_partkey AS path, p_partkey % 4 AS way FROM part),
n AS (SELECT *, count(*) OVER (PARTITION BY name) AS again FROM e)
SELECT path, CASE WHEN way = 1 THEN 'name' WHEN again > 1 THEN 'duplicate' WHEN way = 3 THEN 'parent' END AS refused FROM n
""")
def catalog_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of parts, and which entries break a rule."""
    k = F.col("p_partkey")
    name = F.when(k % 4 == 1, F.upper("p_brand")).otherwise(F.concat(F.lit("part-"), (k - k % 4).cast("string")))
    path = F.concat(F.when(k % 4 == 3, "a/../").otherwise("a/"), k.cast("string"))
    return R.catalog_issues(table(spark, sf_dir, "part").select(name.alias("name"), path.alias("path"))).select("path", "refused")


@query("SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN source END AS source, length(coalesce(text, '')) AS chars FROM documents WHERE NOT contains(coalesce(text, ''), '```')")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and source of whole texts from the head of a file, and the text without the fenced code around it."""
    docs = table(spark, sf_dir, "documents").filter(~F.contains(F.coalesce("text", F.lit("")), F.lit("```")))
    line = lambda name, c: F.coalesce(F.concat(F.lit(f'{name}: "'), c, F.lit('"\n')), F.lit(""))
    head = F.concat(F.lit("---\n"), line("lang", F.col("lang")), F.when(F.col("doc_id") % 2 == 0, line("source", F.col("source"))).otherwise(""), F.lit("other: 1\n---\n"))
    files = docs.select("doc_id", F.concat(head, F.lit("```\ncode\n```"), F.coalesce("text", F.lit("")), F.lit("```x```")).alias("file"))
    body = T.strip_fences(F.regexp_replace("file", r"(?s)^---\n.*?\n---\n", ""))
    m = files.select("doc_id", R.front_matter(F.col("file")).alias("m"), body.alias("body"))
    return m.select("doc_id", F.try_element_at("m", F.lit("lang")).alias("lang"), F.try_element_at("m", F.lit("source")).alias("source"), F.length("body").alias("chars"))


@query("""
SELECT doc_id, regexp_matches(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS email, contains(coalesce(text, ''), 'der ') AS token FROM documents
""")
def escaped_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """addresses and a caller's token are found in whole texts whose @ and blanks are written as escapes."""
    hidden = F.coalesce("text", F.lit(""))
    # What an escape is made of is escaped itself, so that decoding gives the text again, character by character.
    for plain, escape in (("\\", "\\\\"), ('"', '\\"'), ("%", "%25"), ("+", "%2B"), ("@", "\\u0040"), ("der ", "d\\u0065r ")):
        hidden = F.replace(hidden, F.lit(plain), F.lit(escape))
    found = T.escaped_leaks(hidden, ["der "], {"email": T.PERSONAL_PATTERNS["email"]})
    return table(spark, sf_dir, "documents").select("doc_id", F.array_contains(found, "email").alias("email"), F.array_contains(found, "token:der ").alias("token"))


@query("SELECT o_orderkey, 'https://site.test/search?q=' || replace(o_orderpriority, ' ', '%20') || '%26' AS url, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS id FROM orders")
def request_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search addresses of requests; ids that are no whole numbers are unknown."""
    number = _key().cast("double") + F.when(_key() % 3 == 1, 0.5).when(_key() % 3 == 2, 2.0**53).otherwise(0.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", T.search_url("https://site.test/search", F.concat("o_orderpriority", F.lit("&"))).alias("url"), T.id_text(number, "double").alias("id"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_linestatus = 'F' AS ok FROM lineitem)
SELECT l_orderkey, count(*) FILTER (ok) AS applied, min(l_linenumber) FILTER (ok) AS first, count(*) FILTER (NOT ok) AS evidence FROM l GROUP BY 1
""")
def replayed_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a journal to apply again after a crash, committed ones only; failed ones stay evidence."""
    pages = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linestatus") == "F").alias("ok"))
    good, failed = ST.replay_committed(pages, ["l_orderkey"], ["l_linenumber"], "ok")
    both = good.withColumn("kind", F.lit(1)).unionByName(failed.withColumn("kind", F.lit(0)))
    return both.groupBy("l_orderkey").agg(F.count_if(F.col("kind") == 1).alias("applied"), F.min(F.when(F.col("kind") == 1, F.col("l_linenumber"))).alias("first"), F.count_if(F.col("kind") == 0).alias("evidence"))


@query("SELECT o_custkey AS fingerprint, CASE WHEN max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 1 THEN 'completed' ELSE 'pending' END AS state FROM orders GROUP BY 1")
def pending_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of reviews by fingerprint after all runs ask again: a completed one is kept."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "fingerprint")
    return E.mark_pending(orders.select("fingerprint", F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("state")), orders.select("fingerprint"))


#: What each kind of retry evidence looks like, by order key modulo 4; 3 agrees with its audit row in nothing.
@query("SELECT o_orderkey, o_orderkey % 4 = 0 AS incomplete, o_orderkey % 4 = 1 AS terminal, o_orderkey % 4 = 2 AS advancing FROM orders")
def clean_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which journal rows are bounded retry evidence, and of which kind."""
    way, id_ = _key() % 4, _key().cast("string")
    posts = lambda n: F.array(*[F.struct(F.concat(id_, F.lit(str(i))).alias("post_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_at")) for i in range(n)])
    held = F.when(way == 0, posts(1)).when(way == 2, posts(3)).otherwise(F.slice(posts(1), 1, 0))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit(2).alias("page"), F.lit("c1").alias("request_cursor"), held.alias("posts"), F.when(way == 0, "pagination_incomplete").otherwise("ok").alias("status"),
        (way != 0).alias("stream_final"), F.when(way != 0, way == 2).alias("has_next"), F.when(way == 2, "c2").alias("next_cursor"), way.alias("way"),
    )
    audit = F.struct(
        F.lit("page").alias("kind"), "page", "status", "stream_final", "has_next", F.when(F.col("way") == 3, 500).otherwise(200).alias("http_status"), F.lit(1).alias("frame_count"), F.lit(0).alias("malformed_frames"), F.lit(0).alias("rejected_stories"),
        F.array().cast("array<string>").alias("errors"), F.size("posts").alias("count"), F.transform("posts", lambda p: p["post_id"]).alias("ids"), F.transform("posts", lambda p: p["published_at"]).alias("dates"),
    )
    rows = rows.withColumn("audit", audit)
    return rows.select("o_orderkey", *[P.clean_retry(k).alias(k) for k in ("incomplete", "terminal", "advancing")])


@query("""
WITH r AS (SELECT o_orderpriority AS route, count(*) AS n, avg(o_totalprice) AS price, max(o_totalprice) AS most FROM orders GROUP BY 1)
SELECT route, CASE WHEN price > 100000 THEN 'high_price' ELSE '' END AS highlights, CASE WHEN n < 3000 THEN 'few' ELSE '' END AS risks, CASE WHEN most > 400000 THEN 'outlier' ELSE '' END AS defects FROM r
""")
def route_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlights, risks and defects of each route by rule."""
    routes = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("route")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("price"), F.max("o_totalprice").alias("most"))
    found = E.route_findings(routes, "route", {"high_price": ("highlight", F.col("price") > 100_000), "few": ("risk", F.col("n") < 3000), "outlier": ("defect", F.col("most") > 400_000)})
    return found.select("route", *[F.array_join(c, ",").alias(c) for c in ("highlights", "risks", "defects")])


@query("SELECT 'orders/' || o_orderkey || '.json' AS path, CASE o_orderkey % 5 WHEN 1 THEN 'changed' WHEN 2 THEN 'absent' WHEN 3 THEN 'not_indexed' END AS fault FROM orders WHERE o_orderkey % 5 BETWEEN 1 AND 3")
def index_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows whose file is gone or changed, and facts without an index row."""
    way = _key() % 5
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("orders/"), _key().cast("string"), F.lit(".json")).alias("path"), F.sha2("o_orderstatus", 256).alias("sha256"), way.alias("way"))
    files = rows.filter("way <> 2").select("path", F.when(F.col("way") == 1, "0").otherwise(F.col("sha256")).alias("sha256"))
    return E.index_faults(rows.filter("way <> 3"), files, rows.select("path"))


#: Rows that one file of a frozen sample holds at most.
FROZEN_FILE_ROWS = 500_000


@query("SELECT count(*) AS rows, 0 AS changed_before, 1 AS changed_after, 3 AS refused, true AS report FROM orders")
def frozen_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frozen sample is compared with itself and with a changed one; its files are checked against their manifest before and after one more appears."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    at, manifest = shared_folder(spark), shared_folder(spark)
    # Files of bounded size, written by all tasks: the check of a manifest reads each file whole.
    orders.write.option("maxRecordsPerFile", FROZEN_FILE_ROWS).json(at)
    S.write_manifest(spark, at, manifest)
    listed = spark.read.schema("path string, bytes bigint, sha256 string").json(manifest)
    before = S.verify_manifest(spark, at, listed).count()
    stored = spark.read.schema(orders.schema).json(at)
    E.require_same(stored, orders)
    refused = 0
    for other in (orders.filter("o_orderstatus <> 'F'"), orders.unionByName(orders.limit(1)), orders.withColumn("o_orderstatus", F.lit("X"))):
        try:
            E.require_same(stored, other)
        except ValueError:
            refused += 1
    orders.limit(1).coalesce(1).write.mode("append").json(at)
    after = S.verify_manifest(spark, at, listed).count()
    report = S.write_markdown(stored.groupBy("o_orderstatus").agg(F.count("*").alias("n")), "Orders")
    return orders.agg(F.count("*").alias("rows")).withColumns({"changed_before": F.lit(before), "changed_after": F.lit(after), "refused": F.lit(refused), "report": F.lit(report.startswith("# Orders\n\n| o_orderstatus | n |"))})
