"""The post audit over orders: each order becomes a saved post, sound or with one of many faults, and each customer a run."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.catalog import query, table
from proofmill.operators import post_audit as A

_SOUND = {
    "post_id": "@ID@", "url": "https://www.facebook.com/groups/g.one/posts/@ID@/", "published_at": "@DATE@T00:00:00Z", "published_at_raw": "@EPOCH@", "collected_at": "2024-01-01T00:00:00Z", "body": "text", "shares": 1, "reactions": "2,345", "comments": None,
    "comments_raw": "7 comments", "count_observed_at": {m: "2024-01-01T00:00:00Z" for m in A.METRICS}, "field_observed_at": {"body": "2024-01-01T00:00:00Z"}, "media_types": ["Photo"], "attachment_count": 1, "is_shared": False, "body_known": True,
}
_NO_BODY = {"body": "", "media_types": [], "attachment_count": 0}
#: Changes to a sound post, by the order's key modulo their number, and the codes with fields that follow.
FAULTS: list[tuple[dict | str, list[tuple[str, str | None]]]] = [
    ({}, []),
    ("[1]", [("POST_NOT_OBJECT", None), ("INVALID_POST_ID", None), ("URL_ID_OR_GROUP_MISMATCH", None), ("UNKNOWN_PUBLICATION_DATE", None), ("UNKNOWN_COLLECTION_TIME", None), ("EMPTY_BODY_UNCLASSIFIED", None), *[("COUNT_NOT_AVAILABLE", m) for m in A.METRICS]]),
    ({"post_id": "@NUMBER@"}, [("NUMERIC_ID_COERCED_TO_TEXT", None)]),
    ({"post_id": "p@ID@"}, [("INVALID_POST_ID", None), ("URL_ID_OR_GROUP_MISMATCH", None)]),
    ({"url": "https://www.facebook.com/groups/other/posts/@ID@"}, [("URL_ID_OR_GROUP_MISMATCH", None)]),
    ({"shared_body": 5}, [("TEXT_FIELD_NOT_TEXT", "shared_body")]),
    ({"published_at": "@DATE@T00:00:00"}, [("UNKNOWN_PUBLICATION_DATE", None)]),
    ({"published_at_raw": 86400.5}, [("EPOCH_ISO_MISMATCH", None)]),
    ({"published_at_raw": 1e300}, [("EPOCH_ISO_MISMATCH", None), ("INVALID_EPOCH", None)]),
    ({"published_at_raw": True}, [("INVALID_RAW_TIME_TYPE", None)]),
    ({"collected_at": "2024-02-30T00:00:00Z"}, [("UNKNOWN_COLLECTION_TIME", None)]),
    ({"shares": -1, "reactions": 2.5, "comments": 3.0}, [("INVALID_COUNT", "shares"), ("INVALID_COUNT", "reactions")]),
    ({"shares": [1]}, [("INVALID_COUNT_TYPE", "shares")]),
    ({"shares": " "}, [("COUNT_NOT_AVAILABLE", "shares")]),
    ({"shares": "1.2K"}, [("APPROXIMATE_COUNT", "shares")]),
    ({"shares": "1 of 2"}, [("UNREADABLE_COUNT", "shares")]),
    ({"count_observed_at": 1}, [("INVALID_COUNT_OBSERVATION_OBJECT", None), *[("COUNT_OBSERVATION_TIME_UNAVAILABLE", m) for m in A.METRICS]]),
    ({"count_observed_at": {"shares": "now", "reactions": "2024-01-01T00:00:00Z", "comments": "2024-01-01T00:00:00Z"}}, [("INVALID_COUNT_OBSERVATION_TIME", "shares"), ("COUNT_OBSERVATION_TIME_UNAVAILABLE", "shares")]),
    ({"field_observed_at": []}, [("INVALID_FIELD_OBSERVATION_OBJECT", None)]),
    ({"field_observed_at": {"url": "x"}}, [("INVALID_FIELD_OBSERVATION_TIME", "of_url")]),
    ({"retained_fields": {}}, [("INVALID_RETAINED_FIELDS", None)]),
    ({"retained_fields": [{"field": "shares"}, {"field": "body", "reason": "unavailable_in_new_observation", "from_collected_at": "2024-01-01T00:00:00Z"}]}, [("INVALID_FIELD_RETENTION_RECORD", None), ("FIELDS_RETAINED_FROM_PRIOR_OBSERVATION", None)]),
    ({"media_types": ["Photo", 1]}, [("INVALID_MEDIA_TYPES", None)]),
    ({"attachment_count": 1.5}, [("INVALID_ATTACHMENT_COUNT", None)]),
    ({"is_shared": "no"}, [("INVALID_SHARED_FLAG", None)]),
    ({"body_known": 1}, [("INVALID_BODY_KNOWN_FLAG", None)]),
    ({"body": " ", "body_known": False}, [("BODY_UNAVAILABLE", None)]),
    (_NO_BODY, [("EMPTY_BODY_UNCLASSIFIED", None)]),
    (_NO_BODY | {"is_shared": True}, []),
    ({"body_truncated": True}, [("BODY_TRUNCATED", None)]),
    ("twice", [("DUPLICATE_POST_ID", None)]),
    ("wrong list", []),
    ("undated list", [("DATED_POST_IN_UNDATED_BUCKET", None)]),
]
SPAN = ("1993-01-01", "1996-12-31")
LEVELS = {r.code: (r.area, r.level) for r in (*A.RUN_RULES, *A.BUCKET_RULES, *A.POST_RULES)}


def _post(change: dict | str) -> str:
    if change == "[1]":
        return "[1]"
    text = json.dumps(_SOUND | (change if isinstance(change, dict) else {}), ensure_ascii=False)
    return text.replace('"@EPOCH@"', "@EPOCH@").replace('"@NUMBER@"', "@ID@")


def saved_runs(orders: DataFrame) -> DataFrame:
    """run, document: a run for each customer with its orders as posts; every ninth customer has a second run with broken lists."""
    m = F.col("o_orderkey") % len(FAULTS)
    special = {c: i for i, (c, _) in enumerate(FAULTS) if isinstance(c, str)}
    post = F.element_at(F.array(*[F.lit(_post(c)) for c, _ in FAULTS]), (m + 1).cast("int"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    for mark, value in (("@ID@", F.col("o_orderkey").cast("string")), ("@DATE@", day), ("@EPOCH@", F.unix_seconds(F.to_timestamp(day)).cast("string"))):
        post = F.replace(post, F.lit(mark), value)
    within = day.between(*SPAN)
    bucket = F.when(m == special["undated list"], "undated_posts").when(within != (m == special["wrong list"]), "posts").otherwise("outside_range_posts")
    each = F.when(m == special["twice"], F.array(post, post)).otherwise(F.array(post))
    rows = orders.select(F.col("o_custkey").alias("run"), bucket.alias("bucket"), "o_orderkey", F.posexplode(each).alias("copy", "post"))
    lists = rows.groupBy("run").agg(*[F.array_sort(F.collect_list(F.when(F.col("bucket") == b, F.struct("o_orderkey", "copy", "post")))).alias(b) for b in A.BUCKETS])
    text = lambda b: F.concat(F.lit(f', "{b}": ['), F.array_join(F.transform(b, lambda x: x["post"]), ", "), F.lit("]"))
    said = (F.size("posts") + (F.col("run") % 5 == 0).cast("int")).cast("string")
    head = F.concat(F.lit(f'{{"metadata": {{"group_id": "77", "group_url": "https://www.facebook.com/groups/g.one", "start": "{SPAN[0]}T00:00:00Z", "end": "{SPAN[1]}T23:59:59Z", "in_range_count": '), said, F.lit("}"))
    whole = lists.select("run", F.concat(head, *[text(b) for b in A.BUCKETS], F.lit("}")).alias("document"))
    broken = lists.filter(F.col("run") % 9 == 4).select((-F.col("run")).alias("run"), F.lit('{"metadata": {}, "posts": null, "outside_range_posts": "x"}').alias("document"))
    return whole.unionByName(broken)


def _q(text: str | None) -> str:
    return "NULL" if text is None else f"'{text}'"


_CODES = ", ".join(f"({i}, {_q(code)}, {_q(field)})" for i, (_, codes) in enumerate(FAULTS) for code, field in codes)
_LEVELS = ", ".join(f"({_q(c)}, {_q(a)}, {_q(x)})" for c, (a, x) in LEVELS.items())
_WRONG = [i for i, (c, _) in enumerate(FAULTS) if c == "wrong list"][0]
_UNDATED = [i for i, (_, codes) in enumerate(FAULTS) if ("UNKNOWN_PUBLICATION_DATE", None) in codes]


@query(f"""
WITH o AS (SELECT o_custkey AS run, o_orderkey % {len(FAULTS)} AS m, strftime(o_orderdate, '%Y-%m-%d') BETWEEN '{SPAN[0]}' AND '{SPAN[1]}' AS within FROM orders),
level(code, area, level) AS (VALUES {_LEVELS}),
found AS (
  SELECT code, field FROM o JOIN (VALUES {_CODES}) f(m, code, field) USING (m)
  UNION ALL SELECT CASE WHEN within THEN 'OUTSIDE_BUCKET_CONTAINS_TARGET_POST' ELSE 'TARGET_POST_OUTSIDE_SCOPE' END, NULL FROM o WHERE m = {_WRONG}
  UNION ALL SELECT 'METADATA_COUNT_MISMATCH', 'posts' FROM (SELECT DISTINCT run FROM o) WHERE run % 5 = 0
  UNION ALL SELECT unnest(['BUCKET_IS_NULL', 'BUCKET_NOT_ARRAY']), NULL FROM (SELECT DISTINCT run FROM o) WHERE run % 9 = 4
  UNION ALL SELECT 'UNKNOWN_DATES_PREVENT_FULL_WINDOW_VERIFICATION', NULL FROM (SELECT DISTINCT run FROM o WHERE m IN ({', '.join(map(str, _UNDATED))})))
SELECT area, level, code, field, count(*) AS n FROM found JOIN level USING (code) GROUP BY ALL
""")
def post_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: how often each of the 38 codes is found, by field, in the runs of all customers."""
    log = A.audit_log(saved_runs(table(spark, sf_dir, "orders")), "run", "document")
    return log.groupBy("area", "level", "code", "field").agg(F.count("*").alias("n"))
