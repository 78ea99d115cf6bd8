"""Queries of predicates, aggregates, text and value functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.catalog import query, table
from proofmill.folders import written
from proofmill.functions import text as T
from proofmill.functions import values as V
from proofmill.operators import aggregates as A
from proofmill.operators import joins as J
from proofmill.operators.pairs import pair_counts


@query("SELECT doc_id, CASE WHEN ok IS NULL THEN 'unknown' WHEN ok THEN 'pass' ELSE 'fail' END AS fit FROM (SELECT doc_id, (n_chars BETWEEN 500 AND 4000) AND (quality = 1) AND (toxic = 0) AS ok FROM documents LEFT JOIN labels USING (doc_id))")
def three_valued_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", V.three_valued(V.within(F.col("n_chars"), F.lit(500), F.lit(4000)) & (F.col("quality") == 1) & (F.col("toxic") == 0)).alias("fit"))


@query("SELECT doc_id, CASE WHEN c IS NULL OR c = 'unknown' THEN 'unknown' WHEN c = 'non_US' THEN 'unknown' WHEN c IN ('de', 'fr') THEN 'pass' ELSE 'fail' END AS gate FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' WHEN 2 THEN 'non_US' ELSE lang END AS c FROM documents)")
def country_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 5
    country = F.when(m == 0, F.lit(None)).when(m == 1, "unknown").when(m == 2, "non_US").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", V.three_valued(V.country_gate(country, ["de", "fr"])).alias("gate"))


@query("SELECT CASE WHEN d IS NULL THEN 'unknown' WHEN d BETWEEN TIMESTAMP '1997-02-28' AND TIMESTAMP '1997-08-31' THEN 'in_range' ELSE 'outside_range' END AS bucket, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS d FROM orders) GROUP BY 1")
def date_bucketing(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.lit("1997-08-31").cast("timestamp")
    day = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").groupBy(A.bucket(day, V.months_before(end, 6), end).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT status, category, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'failed' WHEN value IS NULL THEN 'unknown' WHEN value > 75 THEN 'complete' WHEN value > 25 THEN 'partial' ELSE 'empty' END AS status, CASE WHEN regexp_matches(event_type, '^(click|view)$') THEN 'browse' WHEN event_type = 'purchase' THEN 'discovery' ELSE 'diagnostic' END AS category FROM events) GROUP BY 1, 2")
def status_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = F.col("value"), F.col("event_type")
    status = A.ladder("empty", (e == "error", "failed"), (v.isNull(), "unknown"), (v > 75, "complete"), (v > 25, "partial"))
    category = A.ladder("diagnostic", (e.rlike("^(click|view)$"), "browse"), (e == "purchase", "discovery"))
    return table(spark, sf_dir, "events").groupBy(status.alias("status"), category.alias("category")).agg(F.count("*").alias("n"))


TERMS = ["license", "with", "worthless", "queñ"]


@query("SELECT doc_id, array_to_string(list_filter(['license', 'with', 'worthless', 'queñ'], lambda t: contains(lower(text), t)), ',') AS terms FROM documents")
def term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(A.matched_terms(F.col("text"), TERMS), ",").alias("terms"))


_LEAKS = T.LEAK_PATTERNS | T.PERSONAL_PATTERNS
_RULES = ", ".join("('{}', '{}')".format(n, p.replace("'", "''")) for n, p in (_LEAKS | T.WITHOUT_LOOKBEHIND).items())


@query(f"""WITH p(rule, pat) AS (VALUES {_RULES}), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT rule, count(*) AS n_lines, count(DISTINCT doc_id) AS docs FROM l JOIN p ON regexp_matches(line, pat) GROUP BY 1""")
def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return J.rule_matches(lines, "line", _LEAKS).groupBy("rule").agg(F.count("*").alias("n_lines"), F.count_distinct("doc_id").alias("docs"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^ \n\t]+', '[url]', 'g'), 'Bearer +[A-Za-z0-9._-]+', 'Bearer [secret]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[mail]', 'g'), '(token|password|secret|api_key|cookie)=[^ \n\t&]+', '\1=[secret]', 'g')) AS clean FROM documents""")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.redact(F.col("text"), None)).alias("clean"))


@query(r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^([^?#]*)', 1) AS base,
CASE WHEN regexp_matches(url, '[?&]page=') THEN regexp_extract(url, '^([^?#]*)', 1) || '?' || regexp_extract(url, '[?&](page=[^&#]*)', 1) ELSE regexp_extract(url, '^([^?#]*)', 1) END AS paged FROM pages""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url(url, F.lit("PROTOCOL")).alias("scheme"), F.parse_url(url, F.lit("HOST")).alias("host"), T.path_only(url).alias("base"), T.keep_parameter(url, "page").alias("paged"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https://[^/]*example\\.org/') THEN regexp_extract(url, '^https://[^/?#]+([^?#]*)', 1) END AS path, nullif(regexp_extract(url, '^[a-z]+://[^/?#]+/(en)/([^/?#]+)', 2), '') AS slug FROM (SELECT page_id, CASE WHEN regexp_matches(url, '^https?://(www\\.)?[a-z]+\\.example\\.org/') THEN regexp_replace(url, '^(https?)://[^/]+', '\\1://www.example.org') ELSE url END AS url FROM pages)")
def allowed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.when(F.col("url").rlike(r"^https?://(www\.)?[a-z]+\.example\.org/"), F.regexp_replace("url", r"^(https?)://[^/]+", "$1://www.example.org")).otherwise(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", one.alias("url"))
    path = F.when(F.col("url").rlike(r"^https://[^/]*example\.org/"), F.try_parse_url("url", F.lit("PATH")))
    return pages.select("page_id", path.alias("path"), T.path_part(F.col("url"), "en").alias("slug"))


@query("""WITH m AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN printf('%.1fK', o_totalprice / 1000) WHEN 1 THEN CAST(o_orderkey AS VARCHAR) || ' followers' WHEN 2 THEN NULL WHEN 3 THEN '1,2' || CAST(o_orderkey AS VARCHAR) WHEN 4 THEN 'none' ELSE CAST(o_orderkey % 9 AS VARCHAR) || ' M' END AS raw FROM orders)
SELECT o_orderkey, CAST(round(TRY_CAST(regexp_extract(replace(raw, ',', ''), '(?i)([0-9.]+)\\s*(亿|万|[KMB])?', 1) AS DOUBLE) * CASE upper(regexp_extract(replace(raw, ',', ''), '(?i)([0-9.]+)\\s*(亿|万|[KMB])?', 2)) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1 END) AS BIGINT) AS value,
CASE WHEN regexp_matches(raw, '[0-9]') THEN regexp_extract(replace(raw, ',', ''), '(?i)([0-9.]+)\\s*(亿|万|[KMB])?', 2) <> '' END AS approximate FROM m""".replace("\\\\", "\\"))
def metric_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 6
    # format_number rounds the double itself, halves to even, as printf of C does; format_string rounds its shortest decimal up.
    tenths = F.replace(F.format_number(F.col("o_totalprice") / 1000, 1), F.lit(","), F.lit(""))
    raw = (
        F.when(m == 0, F.concat(tenths, F.lit("K"))).when(m == 1, F.concat(k.cast("string"), F.lit(" followers"))).when(m == 2, F.lit(None))
        .when(m == 3, F.concat(F.lit("1,2"), k.cast("string"))).when(m == 4, "none").otherwise(F.concat((k % 9).cast("string"), F.lit(" M")))
    )
    found = table(spark, sf_dir, "orders").select("o_orderkey", V.compact_metric(raw).alias("m"))
    return found.select("o_orderkey", "m.value", "m.approximate")


@query("""WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey - 8 AS BIGINT) END AS exact, CASE o_orderkey % 3 WHEN 0 THEN '15.' || CAST(o_orderkey % 10 AS VARCHAR) || 'K likes' WHEN 1 THEN CAST(o_orderkey AS VARCHAR) || ' likes' ELSE ' ' END AS label FROM orders)
SELECT o_orderkey, CASE WHEN exact >= 0 THEN exact WHEN exact IS NULL AND o_orderkey % 3 = 1 THEN o_orderkey END AS value, CASE WHEN exact IS NULL AND o_orderkey % 3 = 0 THEN regexp_extract(label, '^([0-9.]+K)', 1) END AS text,
CASE WHEN exact >= 0 THEN 'exact' WHEN exact IS NOT NULL THEN 'invalid' WHEN trim(label) = '' THEN 'missing' WHEN o_orderkey % 3 = 0 THEN 'approximate' ELSE 'exact_label' END AS status FROM m""")
def compact_metric_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    exact = F.when(k % 4 == 0, k - 8)
    label = F.when(k % 3 == 0, F.concat(F.lit("15."), (k % 10).cast("string"), F.lit("K likes"))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(" likes"))).otherwise(" ")
    found = table(spark, sf_dir, "orders").select("o_orderkey", V.resolved_metric(exact, label).alias("m"))
    return found.select("o_orderkey", "m.value", "m.text", "m.status")


_TAGS = "WITH t AS (SELECT DISTINCT doc_id, tag FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS tag FROM documents) WHERE tag IN ('the', 'and', 'que', 'der', 'les', 'thin'))"


@query(_TAGS + ", n AS (SELECT DISTINCT tag FROM t) SELECT x.tag AS a, y.tag AS b, (SELECT count(*) FROM t p JOIN t q USING (doc_id) WHERE p.tag = x.tag AND q.tag = y.tag) AS common FROM n x JOIN n y ON x.tag < y.tag")
def hashtag_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("tag")).filter(F.col("tag").isin("the", "and", "que", "der", "les", "thin"))
    return J.overlaps(tags, "doc_id", "tag")


@query()
def tag_frequencies_and_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A09 of all tags of whole texts (those of hashtags_mentions): texts with tag a, and where b is given with both."""
    t = F.regexp_replace(F.regexp_replace("text", " th", " #Th"), " re", " @Re")
    tags = written(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_e"), F.explode(T.hashtags(t)).alias("a")).distinct())
    alone = tags.groupBy("a").agg(F.count("*").alias("texts"))
    return alone.select("a", F.lit(None).cast("string").alias("b"), "texts").unionByName(pair_counts(tags).withColumnRenamed("common", "texts"))


@query("SELECT l_suppkey, count(*) FILTER (WHERE l_discount > 0) AS used, count(*) FILTER (WHERE l_discount <= 0) AS excluded, round(median(l_quantity) FILTER (WHERE l_discount > 0), 6) AS middle FROM lineitem GROUP BY 1")
def median_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = F.col("l_discount") > 0
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(used).alias("used"), F.count_if(~used).alias("excluded"), F.round(F.median(F.when(used, F.col("l_quantity"))), 6).alias("middle"))


@query("""WITH g AS (SELECT event_type, count(*) FILTER (WHERE value > 10) AS done, count(*) FILTER (WHERE value > 60) AS good, count(*) FILTER (WHERE value < 2) AS blocked, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN 0.0 ELSE 8.0 END AS hours FROM events GROUP BY event_type)
SELECT event_type, round(done / nullif(hours, 0), 6) AS per_hour, round(good / nullif(done, 0), 6) AS pass_rate, round(blocked / nullif(done + blocked, 0), 6) AS blocked_rate FROM g""")
def rates_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = F.col("value"), F.first("event_type")
    hours = F.when(e == "view", F.lit(None)).when(e == "click", F.lit(0.0)).otherwise(F.lit(8.0))
    found = A.rates(table(spark, sf_dir, "events"), "event_type", v > 10, v > 60, v < 2, hours)
    return found.withColumns({c: F.round(c, 6) for c in ("per_hour", "pass_rate", "blocked_rate")})


def _rules() -> dict:
    c = F.col
    return {
        "DISCOUNT_WITHOUT_TAX": ("review", "warning", (c("l_discount") > 0.08) & (c("l_tax") == 0)),
        "QUANTITY_LARGE": ("validity", "error", c("l_quantity") > 48),
        "RETURNED_OPEN": ("coverage", "error", (c("l_returnflag") == "R") & (c("l_linestatus") == "O")),
    }


_ISSUES = """SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN l_discount > 0.08 AND l_tax = 0 THEN {'area': 'review', 'level': 'warning', 'code': 'DISCOUNT_WITHOUT_TAX'} END, CASE WHEN l_quantity > 48 THEN {'area': 'validity', 'level': 'error', 'code': 'QUANTITY_LARGE'} END, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN {'area': 'coverage', 'level': 'error', 'code': 'RETURNED_OPEN'} END], lambda x: x IS NOT NULL)) AS i FROM lineitem"""


@query(f"SELECT i.area AS area, i.level AS level, i.code AS code, count(*) AS n FROM ({_ISSUES}) GROUP BY 1, 2, 3")
def issue_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.issue_counts(A.issues(table(spark, sf_dir, "lineitem"), _rules()))


@query("SELECT o_orderkey, substr(sha256('{\"custkey\":' || o_custkey || ',\"priority\":\"' || o_orderpriority || '\",\"status\":\"' || o_orderstatus || '\"}'), 1, 24) AS key FROM orders")
def semantic_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.semantic_key(24, status=F.col("o_orderstatus"), custkey=F.col("o_custkey"), priority=F.col("o_orderpriority")).alias("key"))


@query("SELECT CAST(props ->> '$.k' AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS orders, CAST(max(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))) - min(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))) AS INTEGER) AS days, round(count(*) * 7 / nullif(max(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))) - min(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))), 0), 6) AS weekly FROM orders GROUP BY 1")
def posting_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.date_diff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"))
    return g.withColumn("weekly", F.round(V.per_week(F.col("orders"), F.col("days")), 6))


@query("SELECT lang, CAST(sum(v) AS BIGINT) AS known, count(*) AS n FROM (SELECT lang, CASE WHEN lang <> 'fr' AND doc_id % 2 = 0 THEN n_chars END AS v FROM documents) GROUP BY 1")
def null_preserving_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when((F.col("lang") != "fr") & (F.col("doc_id") % 2 == 0), F.col("n_chars"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(v).alias("known"), F.count("*").alias("n"))


@query("SELECT coalesce(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END, 'unknown') AS status, count(*) AS n FROM orders GROUP BY 1")
def tally_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tally(table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("status")), "status")


@query("SELECT l_returnflag, CAST(sum(l_quantity) AS BIGINT) AS expected, CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS BIGINT) AS received, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) / nullif(sum(l_quantity), 0), 6) AS ratio FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    return A.coverage(table(spark, sf_dir, "lineitem"), "l_returnflag", q, F.when(F.col("l_linestatus") == "F", q).otherwise(0)).withColumn("ratio", F.round("ratio", 6))


@query("SELECT p_partkey, CASE WHEN regexp_matches(v, '^[=+@-]') THEN '''' || v ELSE v END AS guarded FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '' ELSE '@' END || p_name AS v FROM part)")
def formula_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("p_partkey") % 4
    v = F.concat(F.when(m == 0, "=").when(m == 1, "+").when(m == 2, "").otherwise("@"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.guard_formula(v).alias("guarded"))


@query("SELECT c_custkey, lower(c_name) AS handle, 'site:handle:' || lower(replace(c_name, '#', '.')) AS entity_key, 'provisional_handle' AS status FROM customer")
def account_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace(F.col("c_name"), F.lit("#"), F.lit("."))
    handle = T.normal_handle(F.concat(F.lit("@"), name), ["site.example"])
    acc = T.account(handle, F.lit(None).cast("string"), F.lit(None).cast("string"), "site")
    return table(spark, sf_dir, "customer").select("c_custkey", T.handle_key(F.col("c_name")).alias("handle"), acc["entity_key"].alias("entity_key"), acc["identity_status"].alias("status"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(floor(value) AS BIGINT) WHEN event_id % 3 = 1 THEN 1500 END AS ms FROM events")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 3
    end = F.when(m == 1, F.col("ts") + F.expr("INTERVAL 1500 MILLISECONDS")).when(m == 2, F.col("ts") - F.expr("INTERVAL 5 SECONDS"))
    return table(spark, sf_dir, "events").select("event_id", V.duration_ms(F.when(m == 0, F.floor("value")), F.col("ts"), end).alias("ms"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN epoch_us(date_trunc('second', ts)) END AS us FROM events")
def zoned_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    zoned = F.when(F.col("event_id") % 2 == 0, F.concat(raw, F.lit("Z"))).otherwise(raw)
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(V.zoned_time(zoned)).alias("us"))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n"))


@query("SELECT c_mktsegment, sha256(string_agg(c, chr(10) ORDER BY c)) AS print FROM (SELECT DISTINCT c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c FROM customer) GROUP BY 1")
def set_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(T.fingerprint(F.collect_set(F.col("c_nationkey").cast("string"))).alias("print"))


@query("""SELECT l_returnflag, coalesce(n, 0) AS n, total FROM (VALUES ('A'), ('N'), ('R'), ('X')) d(l_returnflag) LEFT JOIN (SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem GROUP BY 1) USING (l_returnflag)""")
def fixed_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.fixed_domain(table(spark, sf_dir, "lineitem"), "l_returnflag", ["A", "N", "R", "X"], {"n": F.count("*"), "total": F.sum(F.col("l_quantity").cast("long"))})
    return found.withColumn("n", F.coalesce("n", F.lit(0)))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '#([\p{L}\p{N}_]+)', 1), lambda x: lower(x)))), ',') AS tags, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?:^|\s)@([A-Za-z0-9_.]+)', 1), lambda x: lower(x)))), ',') AS names FROM (SELECT doc_id, regexp_replace(regexp_replace(text, ' th', ' #Th', 'g'), ' re', ' @Re', 'g') AS t FROM documents)")
def hashtags_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_replace(F.regexp_replace("text", " th", " #Th"), " re", " @Re")
    docs = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    flat = lambda c: F.array_join(F.array_sort(c), ",")
    return docs.select("doc_id", flat(T.hashtags(F.col("t"))).alias("tags"), flat(T.mentions(F.col("t"))).alias("names"))


@query("SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.json' AS file, CASE WHEN p_size > 25 THEN true ELSE false END AS newer, printf('%d.%d.%d', p_size // 10, p_size % 10, 0) AS v FROM part")
def versions_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    v = F.concat_ws(".", F.floor(size / 10).cast("string"), (size % 10).cast("string"), F.lit("0"))
    return table(spark, sf_dir, "part").select("p_partkey", T.sequence_name(F.col("p_partkey")).alias("file"), (T.version(v) > T.version(F.lit("2.5.0"))).alias("newer"), v.alias("v"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'OTHER' ELSE 'CODE_' || CAST(doc_id % 7 AS VARCHAR) END AS code FROM documents")
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    message = F.when(k % 4 == 0, F.concat(F.lit("plain text "), k.cast("string"))).otherwise(F.concat(F.lit("CODE_"), (k % 7).cast("string"), F.lit(": what happened")))
    return table(spark, sf_dir, "documents").select("doc_id", T.error_code(message).alias("code"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'absolute' WHEN 1 THEN 'parent' WHEN 2 THEN 'device' WHEN 3 THEN 'character' WHEN 4 THEN 'trailing' END AS broken FROM pages""")
def portable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("page_id") % 6
    name = F.when(m == 0, "/etc/x").when(m == 1, "a/../b").when(m == 2, "dir/NUL.txt").when(m == 3, "a?b").when(m == 4, "dir./file").otherwise("dir/file.txt")
    return table(spark, sf_dir, "pages").select("page_id", T.portable_name(name).alias("broken"))


@query("SELECT page_id, n_links, n_forms FROM (SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a[^>]*\\shref=[\"'']([^\"'']*)[\"'']', 1))) AS n_links, len(regexp_extract_all(html, '<p')) AS n_forms FROM pages)")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofmill.sources.readers import page_links as links

    return table(spark, sf_dir, "pages").select("page_id", F.size(links(F.col("html"))).cast("long").alias("n_links"), F.regexp_count("html", F.lit("<p")).cast("long").alias("n_forms"))


@query("SELECT user_id, count(*) AS frames, count(*) FILTER (WHERE event_id % 9 = 0) AS bad_frames, CAST(sum(CASE WHEN event_id % 9 <> 0 THEN event_id % 3 ELSE 0 END) AS BIGINT) AS n_items, bool_or(event_id % 9 <> 0 AND event_id % 5 = 0) AS final FROM events GROUP BY 1")
def framed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofmill.sources.readers import framed_responses as parse

    k = F.col("event_id")
    items = F.when(k % 3 == 0, "[]").when(k % 3 == 1, "[1]").otherwise("[1,2]")
    good = F.concat(F.lit('for (;;);{"data":{"items":'), items, F.lit(',"next":"c'), k.cast("string"), F.lit('"},"is_final":'), F.when(k % 5 == 0, "true").otherwise("false"), F.lit("}"))
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(k % 9 == 0, "{broken").otherwise(good).alias("frame"))
    bodies = events.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "frame"))), lambda x: x["frame"]), "\n").alias("body"))
    found = parse(bodies, "user_id", "body", "$.data.items", "$.data.next", "$.is_final")
    return found.select("user_id", (F.col("frames") + F.col("bad_frames")).alias("frames"), "bad_frames", "n_items", "final")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS bio, coalesce(nullif(CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END, ''), p_brand) AS label FROM part")
def placeholders_and_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    bio = F.when(k % 3 == 0, " N/A ").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.without_placeholder(bio).alias("bio"), V.first_present(F.when(k % 4 == 0, "").otherwise(F.col("p_type")), F.col("p_brand")).alias("label"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS BIGINT) * 1000 WHEN 1 THEN 90000 WHEN 2 THEN 0 END AS wait FROM orders")
def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, now = F.col("o_orderkey"), F.lit("2024-01-01T00:00:00Z").cast("timestamp")
    raw = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, "2024-01-01T00:01:30Z").when(k % 4 == 2, "2023-12-31T00:00:00Z").otherwise("soon")
    wait = F.when(k % 4 != 3, V.retry_after_ms(raw, now))
    return table(spark, sf_dir, "orders").select("o_orderkey", wait.alias("wait"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN true ELSE false END AS agrees FROM supplier")
def epoch_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    raw = F.date_format(F.timestamp_seconds(k * 3600), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return table(spark, sf_dir, "supplier").select("s_suppkey", V.epoch_agrees(raw, k * 3600.0 + F.when(k % 3 == 0, 0.0005).otherwise(0.01)).alias("agrees"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN true ELSE false END AS paid FROM customer")
def paid_disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    said = F.when(k % 2 == 0, F.concat(F.lit("Paid partnership with "), F.col("c_mktsegment"), F.lit(" today"))).when(k % 3 == 0, F.concat(F.lit("this is not sponsored by "), F.col("c_mktsegment"))).otherwise("sponsored by others")
    return table(spark, sf_dir, "customer").select("c_custkey", T.paid_disclosure(said, F.col("c_mktsegment")).alias("paid"))


@query("SELECT doc_id, text IS NOT NULL AND length(trim(text)) >= 0 AS equal, length(text) > 60 AS cut FROM documents")
def caption_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    return docs.select("doc_id", T.caption_matches(text, text).alias("equal"), T.caption_matches(F.concat(F.substring(T.collapse_space(text), 1, 40), F.lit("…")), F.when(F.length(text) > 60, text).otherwise("x")).alias("cut"))


@query("SELECT event_id, CASE WHEN n >= 1 AND n < 3 THEN CAST(10000 * pow(2, n - 1) AS BIGINT) END AS wait FROM (SELECT event_id, event_id % 5 AS n FROM events)")
def back_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofmill.streaming.state import back_off_ms

    return table(spark, sf_dir, "events").select("event_id", back_off_ms(F.col("event_id") % 5).alias("wait"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0 THEN round((l_tax + l_discount) / l_quantity, 8) END AS rate FROM lineitem")
def interaction_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(V.interaction_rate(F.col("l_tax"), F.col("l_discount"), F.col("l_quantity")), 8).alias("rate"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'b' ELSE '' END AS missing, CASE WHEN n_nationkey % 3 = 0 THEN 'z' ELSE '' END AS unknown FROM nation")
def exact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, one = F.col("n_nationkey"), F.lit(1)
    m = F.map_concat(F.create_map(F.lit("a"), one), F.when(k % 2 != 0, F.create_map(F.lit("b"), one)).otherwise(F.create_map().cast("map<string,int>")), F.when(k % 3 == 0, F.create_map(F.lit("z"), one)).otherwise(F.create_map().cast("map<string,int>")))
    keys = V.exact_keys(m, ["a", "b"])
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(keys["missing"], ",").alias("missing"), F.array_join(keys["unknown"], ",").alias("unknown"))
