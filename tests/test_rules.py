"""The rule compiler, and each of the 38 codes of the post audit on a row that breaks it."""

import json

import pytest
from pyspark.sql import functions as F

from proofmill.operators import post_audit as A
from proofmill.operators import rules as R
from proofmill.plans import audit as P


def test_every_code_once():
    codes = [r.code for r in (*A.RUN_RULES, *A.BUCKET_RULES, *A.POST_RULES)]
    assert len(codes) == len(set(codes)) == 38
    broken = {c for _, found in P.FAULTS for c, _ in found} | {"TARGET_POST_OUTSIDE_SCOPE", "OUTSIDE_BUCKET_CONTAINS_TARGET_POST", "METADATA_COUNT_MISMATCH", "BUCKET_IS_NULL", "BUCKET_NOT_ARRAY", "UNKNOWN_DATES_PREVENT_FULL_WINDOW_VERIFICATION"}
    assert broken == set(codes)


def document(posts, bucket="posts", **metadata):
    meta = {"group_id": 77, "group_url": "https://www.facebook.com/groups/g.one", "start": "1993-01-01T00:00:00Z", "end": "1996-12-31T23:59:59Z"} | metadata
    return json.dumps({"metadata": meta, bucket: posts})


def sound(change=None, number=1):
    text = P._post(change or {})
    return json.loads(text.replace("@ID@", str(number)).replace("@DATE@", "1994-05-06").replace("@EPOCH@", "768182400"))


def test_each_fault_gives_its_codes(spark):
    cases = [(c, codes) for c, codes in P.FAULTS if c not in ("twice", "wrong list", "undated list")]
    df = spark.createDataFrame([(i, document([sound(c)])) for i, (c, _) in enumerate(cases)], "run int, document string")
    got = {r.run: sorted((i.code, i.field) for i in r.issues) for r in A.audit_posts(df, "run", "document").collect()}
    key = lambda x: (x[0], x[1] or "")
    assert {k: sorted(v, key=key) for k, v in got.items()} == {i: sorted(codes, key=key) for i, (_, codes) in enumerate(cases)}


def test_places_scopes_and_lists(spark):
    rows = [
        (1, document([sound(number=1), sound(number=1), sound(number=2)], in_range_count=3)),
        (2, document([sound()], bucket="outside_range_posts", outside_range_count=2)),
        (3, document([sound({"published_at": "2001-01-01T00:00:00Z", "published_at_raw": None})])),
        (4, document([sound()], bucket="undated_posts", start=None)),
        (5, document([sound({"published_at": None})])),
        (6, '{"posts": 5, "undated_posts": null}'), (7, "[]"), (8, "no"), (None, None),
    ]
    df = spark.createDataFrame(rows, "run int, document string")
    got = sorted((r.run, r.bucket or "", -1 if r["index"] is None else r["index"], r.code, r.field or "") for r in A.audit_log(df, "run", "document").collect())
    assert got == [
        (1, "posts", 1, "DUPLICATE_POST_ID", ""), (2, "", -1, "METADATA_COUNT_MISMATCH", "outside_range_posts"), (2, "outside_range_posts", 0, "OUTSIDE_BUCKET_CONTAINS_TARGET_POST", ""),
        (3, "posts", 0, "TARGET_POST_OUTSIDE_SCOPE", ""), (5, "", -1, "UNKNOWN_DATES_PREVENT_FULL_WINDOW_VERIFICATION", ""), (5, "posts", 0, "UNKNOWN_PUBLICATION_DATE", ""),
        (6, "posts", -1, "BUCKET_NOT_ARRAY", ""), (6, "undated_posts", -1, "BUCKET_IS_NULL", ""),
    ]


def test_strict_counts_warnings(spark):
    df = spark.createDataFrame([(1, document([sound(number=1), sound({"body_truncated": True}, 2), sound({"shares": -1}, 3)]))], "run int, document string")
    valid = lambda strict: [r.valid for r in A.audit_posts(df, "run", "document", strict).orderBy("index").collect()]
    assert valid(False) == [True, True, False] and valid(True) == [True, False, False]


def test_rules_are_checked_against_the_schema(spark):
    df = spark.createDataFrame([(1, "x"), (-2, None)], "n int, t string")
    rules = spark.createDataFrame([("B_SHORT", "review", "warning", "length({f}) < 2", ["t"]), ("A_NEGATIVE", "validity", "error", "n < 0", None)], "code string, area string, level string, holds string, fields array<string>")
    got = R.judged(df, R.rules_of(rules)).orderBy("n").collect()
    assert [[(i.code, i.field) for i in r.issues] for r in got] == [[("A_NEGATIVE", None)], [("B_SHORT", "t")]] and [r.valid for r in got] == [False, True]
    bad = [R.Rule("X", "validity", "error", "nope > 1"), R.Rule("X", "odd", "error", "n + 1"), R.Rule("Y", "review", "warning", "length({f}) = 1", ("t", "gone"))]
    with pytest.raises(ValueError) as e:
        R.compiled(df, bad)
    assert [f in str(e.value) for f in ("X: UNRESOLVED", "X: repeated", "X: odd", "a int is no condition", "Y (gone): UNRESOLVED")] == [True] * 5
    assert R.judged(df, []).select(F.size("issues").alias("s")).distinct().collect()[0].s == 0


def test_documents_are_read_once(spark):
    rows = [
        (1, " \n" + document([sound(number=1), None, [sound()]], in_range_count=3)), (1, document([sound(number=1)], bucket="outside_range_posts")),
        (2, '{"posts": {"a": 1}, "outside_range_posts": [], "undated_posts": true}'), (3, '{"metadata": {}} x'), (4, '["{"]'), (None, document([], in_range_count=1)),
    ]
    log = A.audit_log(spark.createDataFrame(rows, "run int, document string"), "run", "document")
    assert "parseJson" not in log._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.run or 0, r.bucket or "", -1 if r["index"] is None else r["index"], r.code, r.field or "") for r in log.collect() if r.code in ("DUPLICATE_POST_ID", "POST_NOT_OBJECT", "METADATA_COUNT_MISMATCH", "BUCKET_NOT_ARRAY", "OUTSIDE_BUCKET_CONTAINS_TARGET_POST"))
    assert got == [
        (0, "", -1, "METADATA_COUNT_MISMATCH", "posts"), (1, "outside_range_posts", 0, "DUPLICATE_POST_ID", ""), (1, "outside_range_posts", 0, "OUTSIDE_BUCKET_CONTAINS_TARGET_POST", ""),
        (1, "posts", 1, "POST_NOT_OBJECT", ""), (1, "posts", 2, "POST_NOT_OBJECT", ""), (2, "posts", -1, "BUCKET_NOT_ARRAY", ""), (2, "undated_posts", -1, "BUCKET_NOT_ARRAY", ""),
    ]
