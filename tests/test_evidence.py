import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from proofmill.operators import evidence as E


def test_secrets_go_at_any_depth(spark):
    df = spark.createDataFrame([('{"a":{"Cookie":1,"b":[{"_x":1,"y":"é"}]},"access_token":2}',), ("nope",), (None,)], "j string")
    assert [r.c for r in df.select(E.without_secrets(F.col("j")).alias("c")).collect()] == ['{"a":{"b":[{"y":"é"}]}}', None, None]


def test_nested_objects_stop_at_a_match(spark):
    tree = {"x": [{"id": 1, "desc": "a", "in": {"id": 2, "desc": "b"}}, {"q": {"id": 3, "desc": "c"}}]}
    deep = {"a": {"a": {"a": {"a": {"a": {"a": {"a": {"a": {"id": 9, "desc": "z"}}}}}}}}}
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, json.dumps(deep)), (3, "bad"), (4, None)], "k int, j string")
    got = [(r.k, r.path, json.loads(r.object)["id"]) for r in E.nested_objects(df, "k", "j", ["id", "desc"]).orderBy("path").collect()]
    assert got == [(1, "$.x[0]", 1), (1, "$.x[1].q", 3)]


def test_payload_outcome(spark):
    good = json.dumps([{"kind": "Listing", "data": {"children": [{"data": {"id": "p"}}]}}, {"kind": "Listing", "data": {"children": []}}])
    rows = [(good, "initial", "p"), (good, "initial", "q"), ("{}", "initial", "p"), ("{", "more", "p"), ('{"json":{"errors":[],"data":{"things":[]}}}', "more", "p"), ('{"json":{"errors":[1],"data":{"things":[]}}}', "more", "p")]
    df = spark.createDataFrame(rows, "p string, k string, i string")
    assert [r.o for r in df.select(E.payload_outcome(F.col("p"), F.col("k"), F.col("i")).alias("o")).collect()] == ["ok", "identity_mismatch", "bad_listing_shape", "not_json", "ok", "bad_more_shape"]


def test_listing_is_three_valued(spark):
    items = [{"id": "1", "desc": "x", "author": {"uniqueId": "Ann"}, "stats": {"play": 3, "digg": -1}}, {"id": "a", "desc": "x", "author": {"uniqueId": "ann"}}, {"id": "2", "author": {"uniqueId": "ann"}}, {"id": "3", "desc": "y", "author": {"uniqueId": "bob"}}]
    df = spark.createDataFrame([(1, json.dumps({"itemList": items, "hasMore": True, "cursor": "9"}), "@ann"), (2, '{"itemList":[]}', "ann")], "k int, b string, o string")
    a, b = E.listing(df, "k", "b", "o").orderBy("k").collect()
    assert (len(a["items"]), a["items"][0].stats, a.rejected, a.more, a.cursor) == (1, {"play": 3.0}, 3, True, "9")
    assert (b["items"], b.rejected, b.more, b.cursor) == ([], 0, None, None)


def test_index_faults_and_ledger(spark):
    index = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    files = spark.createDataFrame([("a", "1"), ("b", "9"), ("z", "0")], "path string, sha256 string")
    facts = spark.createDataFrame([("a",), ("d",), ("d",)], "path string")
    assert {(r.path, r.fault) for r in E.index_faults(index, files, facts).collect()} == {("b", "changed"), ("c", "absent"), ("d", "not_indexed")}
    batches = spark.createDataFrame([(1, "x"), (2, "y")], "sequence int, record string")
    ledger = batches.select("sequence", F.sha2(F.when(F.col("sequence") == 1, "x").otherwise("other"), 256).alias("sha256"))
    assert [(r.sequence, r.status) for r in E.same_batches(ledger, batches).collect()] == [(2, "changed")]


RUN = "experiment string, actions long, blocked long, new_accounts long, reviewed long, passed long, active_ms long, wait_ms long, planned long, completed long"


def test_experiment_gate(spark):
    run = lambda *rows: E.run_metrics(spark.createDataFrame(list(rows), RUN))
    hour = 3_600_000
    base = run(("ok", 20, 1, 40, 30, 10, hour, 0, 9, 9), ("slow", 20, 1, 40, 30, 10, hour, 0, 9, 9), ("unknown", 20, None, 40, 30, 10, hour, 0, 9, 9))
    cand = run(("ok", 25, 1, 40, 30, 11, hour, 0, 9, 9), ("slow", 25, 1, 40, 30, 10, hour, 0, 9, 9), ("unknown", 10, 1, 40, 30, 11, hour, None, 9, 8))
    got = {r.experiment: (r.reasons, r.adopt) for r in E.experiment_gate(base, cand).collect()}
    assert got["ok"] == ([], True) and got["slow"] == (["throughput_not_better"], False)
    assert got["unknown"] == (["candidate_few_actions", "throughput_not_better", "blocked_worse", "completion_worse"], False)
    with pytest.raises(Exception, match="contradict"):
        run(("x", 1, 2, 1, 1, 1, 1, 1, 1, 1)).collect()


def test_review_faults(spark):
    works = spark.createDataFrame([("r1", "w1", "Hello  big world", "a", "b"), ("r2", "w2", "x", "a", "b"), ("r3", "w3", "x", "a", "b")], "reference_id string, work_id string, caption string, window_start string, window_end string")
    reviews = [(1, "r1", "a", "b", "hello big", "w1"), (2, "r2", "a", "c", "zzz", "w2"), (3, "r3", "a", "b", "x", "w9"), (4, "r3", "a", "b", " ", "w3"), (5, "r9", "a", "b", "x", "w1")]
    got = {r.review_id: r.faults for r in E.review_faults(spark.createDataFrame(reviews, "review_id int, reference_id string, window_start string, window_end string, quote string, work_id string"), works).collect()}
    assert got == {1: [], 2: ["window_differs", "quote_not_found"], 3: ["several_reviews", "unknown_work"], 4: ["several_reviews", "no_quote"], 5: ["unknown_reference"]}


def test_statistics_exclude_unknown(spark):
    rows = [("a", 10, 2, 100, datetime(2024, 1, 1)), ("a", 1, None, 10, datetime(2024, 1, 8)), ("a", 5, 5, 0, datetime(2024, 1, 15)), ("b", 1, 1, None, None)]
    got = {r.k: (r.median_rate, r.usable, r.missing, r.per_week) for r in E.sample_statistics(spark.createDataFrame(rows, "k string, l int, c int, p int, t timestamp"), "k", "l", "c", "p", "t").collect()}
    assert got == {"a": (0.12, 1, 2, 1.5), "b": (None, 0, 1, None)}


def test_small_ones(spark):
    tags = spark.createDataFrame([(1, ["x", "y"]), (2, ["x", "z"])], "k int, t array<string>")
    named, left = E.label_tags(tags, "k", "t", spark.createDataFrame([("x", "L"), ("y", "L")], "tag string, label string"))
    assert [tuple(r) for r in named.collect()] == [("L", 2, ["x", "y"])] and [tuple(r) for r in left.collect()] == [("z", 1)]
    a, b = spark.createDataFrame([("k", None, 1)], "k string, x int, y int"), spark.createDataFrame([("k", 5, 9)], "k string, x int, y int")
    assert tuple(E.first_facts([a, b], "k", ["x", "y"]).first()) == ("k", 5, 1)
    routes = spark.createDataFrame([("r", 3)], "route string, n int")
    rules = {"busy": ("highlight", F.col("n") > 2), "idle": ("defect", F.col("n") == 0)}
    assert tuple(E.route_findings(routes, "route", rules).first()) == ("r", ["busy"], [], [])
    with pytest.raises(Exception, match="repeated route"):
        E.route_findings(routes.union(routes), "route", rules).collect()
    edges = spark.createDataFrame([("a", None, 2), ("a", None, 1), ("a", "b", 3)], "s string, t string, n int")
    assert sorted(r.n for r in E.unique_edges(edges, ["s", "t"], ["n"]).collect()) == [1, 3]
    sizes = spark.createDataFrame([("[1,2]",), ('{"a":1}',), ("3",), ("{",)], "j string")
    assert [r.n for r in sizes.select(E.size_of(F.col("j")).alias("n")).collect()] == [2, 1, None, None]
    one = spark.range(1)
    x, y = one.select(E.config_fingerprint(a=F.lit(1), b=F.lit(None).cast("string")).alias("f"), E.config_fingerprint(a=F.lit(1)).alias("g")).first()
    assert x == y
    meta = spark.createDataFrame([(1, {"name": "a", "extra": "b", "version": "2"}, "1")], "k int, m map<string,string>, v string")
    assert E.metadata_faults(meta, "k", "m", ["name", "kind", "version"], [], "version", "v").first().faults == ["missing:kind", "unknown:extra", "version"]
    attempts = spark.createDataFrame([(None, "pending"), ("t", "pending"), (None, "complete"), (None, None)], "s string, st string")
    assert E.effective_attempts(attempts, "s", "st").count() == 3
    marks = E.mark_pending(spark.createDataFrame([("a", "completed"), ("b", "failed")], "fingerprint string, state string"), spark.createDataFrame([("a",), ("c",)], "fingerprint string"))
    assert {r.fingerprint: r.state for r in marks.collect()} == {"a": "completed", "b": "pending", "c": "pending"}
    E.require_same(edges, edges.select("n", "s", "t"))
    with pytest.raises(ValueError, match="frozen rows differ"):
        E.require_same(edges, edges.limit(2))
