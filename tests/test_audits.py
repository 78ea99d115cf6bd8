import pytest
from pyspark.sql import functions as F

from proofmill.operators.predicates import clean_retry, cost_role
from proofmill.plans.audits import account_audit, channel_report, page_chain_audit, sample_frame

HOSTS = ["site.example"]
ACCOUNT = "input_index int, line int, handle string, evidenceKind string, route_id string, evidenceId string, observedAt string, actionKey string, sourceUrl string, contentUrl string, contentId string"
ACTION = "input_index int, line int, actionKey string, attemptId string, routeId string, status string, startedAt string, finishedAt string, durationMs long, costRole string, phase string"


@pytest.fixture
def audit(spark):
    card, work = "https://site.example/list", "https://site.example/p/Ab1"
    rows = [
        ("@Alice", "account_card", "following", "e1", "2024-01-01T00:00:00Z", "k1", card, None, None),
        ("bob", "content_author", "keyword_content", "e2", "2024-01-02T00:00:00Z", "k2", None, work, "Ab1"),
        ("bob", "account_card", "following", "e9", "2024-01-09T00:00:00Z", "k1", card, None, None),
        ("carol", "content_author", "keyword_content", "e3", "2024-01-03T00:00:00Z", "k2", None, work, "other"),
        ("dave", "account_card", None, "e4", "2024-01-04T00:00:00+00:00", "k1", card, None, None),
        ("old", "account_card", "following", "e5", "2024-01-01T00:00:00Z", "k1", card, None, None),
        ("bad name", "account_card", "following", "e6", "2024-01-01T00:00:00Z", "k1", card, None, None),
        ("eve", "account_card", "following", "e7", "2024-01-01T00:00:00", "k1", card, None, None),
        ("fred", "account_card", "following", "snapshots/e8", "2024-01-01T00:00:00Z", "k1", card, None, None),
        ("gina", "reference_only", "following", "e10", "2024-01-01T00:00:00Z", "k1", card, None, None),
    ]
    accounts = spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows, 1)], ACCOUNT)
    acts = [("k1", "a", "following", "complete", None, None, 1000, None, None), ("k2", "b", "keyword_content", "complete", "2024-01-01T00:00:00Z", "2024-01-01T00:00:02Z", None, None, None), ("k3", "c", "profile_enrichment", "failed", None, None, None, None, None), ("k4", "d", "x", "pending", None, None, None, None, None), ("k5", "e", "x", "complete", None, None, 5, "odd", None)]
    actions = spark.createDataFrame([(1, i, *r) for i, r in enumerate(acts, 1)], ACTION)
    invalid = spark.createDataFrame([("fred", "e8"), ("alice", "other")], "handle string, evidence_id string")
    baseline = spark.createDataFrame([("OLD",), (None,)], "handle string")
    return account_audit(accounts, actions, invalid, baseline, 2, HOSTS)


def test_account_audit_pools(audit):
    got = {r.handle: (r.pool, r.rank, r.first_route) for r in audit["entities"].collect()}
    assert got == {"alice": ("target", 1, "following"), "bob": ("target", 2, "keyword_content"), "dave": ("overflow", 3, "following"), "carol": ("support_only", None, None)}


def test_account_audit_routes_and_costs(audit):
    routes = {r.route_id: r for r in audit["routes"].collect()}
    f, k = routes["following"], routes["keyword_content"]
    assert (f.own_new, f.candidate_new, f.first_credited, f.first_target, f.target_observed, f.known_ms) == (3, 3, 2, 1, 2, 1000)
    assert (k.own_new, k.candidate_new, k.first_credited, k.first_target, k.known_ms) == (2, 1, 1, 1, 2000)
    assert [tuple(r) for r in audit["overlaps"].collect()] == [("following", "keyword_content", 1)]
    costs = {r.role: (r.n, r.known_ms, r.untimed) for r in audit["costs"].collect()}
    assert costs == {"discovery": (2, 3000, 0), "enrichment": (1, None, 1), "diagnostic": (0, None, 0), "unknown": (1, 5, 0)}
    assert {r.excluded: r.n for r in audit["exclusions"].collect()} == {"invalid_handle": 1, "missing_evidence": 1, "exact_invalid": 1, "reference_only": 1, "baseline": 1}


def pages_of(spark, scope, days, break_at=None, fail_at=None):
    rows = []
    for n, day in enumerate(days):
        posts = [(f"{n}{i}", f"2024-01-{day:02d}T00:00:0{i}Z") for i in range(3)]
        rows.append((scope, n, "x" if n == break_at else f"c{n}", f"c{n + 1}", True, n != fail_at, "ok", posts))
    return spark.createDataFrame(rows, "scope string, page int, request_cursor string, next_cursor string, has_next boolean, stream_final boolean, status string, posts array<struct<post_id:string,published_at:string>>")


def test_page_chain(spark):
    start = F.lit("2024-01-20").cast("timestamp")
    days = [30, 25, 15, 14, 13, 12, 11]
    pages = pages_of(spark, "good", days).union(pages_of(spark, "broken", days, break_at=3)).union(pages_of(spark, "failed", days, fail_at=2)).union(pages_of(spark, "short", days[:5])).union(pages_of(spark, "order", [30, 25, 15, 14, 16, 12, 11]))
    got = {r.scope: r for r in page_chain_audit(pages, start, 3)["verdicts"].collect()}
    assert (got["good"].chain_verified, got["good"].boundary_verified, got["good"].run, got["good"].old_posts, got["good"].needs_review) == (True, True, 5, 15, False)
    assert not got["broken"].chain_verified and got["broken"].breaks == 1
    assert not got["failed"].chain_verified and got["failed"].failed == 1
    assert got["short"].chain_verified and not got["short"].boundary_verified
    assert got["order"].boundary_verified and got["order"].needs_review and got["order"].regressions == 1


def test_channel_report(spark):
    uc = lambda c: "UC" + c * 22
    cards = [
        ("2024-01-01", "f1", "search", "k1", True, "video", "v1", uc("a"), "A", "u/a"),
        ("2024-01-02", "f2", "watch", "k2", True, "video", "v2", uc("b"), None, "u/b"),
        ("2024-01-03", "f3", "watch", "k2", True, "video", "v1", uc("a"), "A2", "u/a2"),
        ("2024-01-03", "f3", "watch", "k2", False, "video", "v3", uc("c"), "C", None),
        ("2024-01-01", "f0", "search", "k1", True, "video", "v4", uc("z"), "Z", None),
        ("2024-01-04", "f4", "search", "k1", True, "video", "v1", None, None, None),
        ("2024-01-04", "f4", "search", "k1", True, "video", "v9", None, None, None),
    ]
    frame = spark.createDataFrame(cards, "observed_at string, evidence_file string, route string, action_key string, counts boolean, kind string, work_id string, channel_id string, channel_name string, owner_url string")
    actions = spark.createDataFrame([("search", "complete", 60000), ("watch", "failed", 0), ("idle", "complete", None)], "route string, status string, duration_ms long")
    got = channel_report(frame, actions, spark.createDataFrame([(uc("z"),)], "channel_id string"), 1)
    channels = {r.channel_id[2]: (r.name, r.pool, r.urls, r.other_names) for r in got["channels"].collect()}
    assert channels["a"] == ("A", "target", ["u/a", "u/a2"], ["A2"]) and channels["b"][1] == "overflow" and channels["c"][1] is None and channels["z"][1] is None
    metrics = {r.route: (r.actions, r.failed, r.independent, r.first_attributed, r.per_minute) for r in got["metrics"].collect()}
    assert metrics == {"search": (1, 0, 1, 1, 1.0), "watch": (1, 1, 2, 0, None), "idle": (1, 0, 0, 0, None)}
    assert {r.work_id: r.state for r in got["queue"].collect()} == {"v1": "resolved", "v9": "pending"}
    bad = frame.limit(1).withColumn("channel_id", F.lit("UCshort"))
    with pytest.raises(Exception, match="invalid stable id"):
        channel_report(bad, actions, frame.select("channel_id").limit(0), 1)["channels"].collect()
    sample = sample_frame(frame.filter("channel_id is not null"), "route", "channel_id", 1)
    assert sample.count() == 2 and sample.collect() == sample.collect()


def test_clean_retry_kinds(spark):
    audit = "struct<kind:string,page:int,status:string,stream_final:boolean,has_next:boolean,http_status:int,frame_count:int,malformed_frames:int,rejected_stories:int,errors:array<int>,count:int,ids:array<string>,dates:array<string>>"
    schema = f"n int, page int, request_cursor string, next_cursor string, has_next boolean, stream_final boolean, status string, posts array<struct<post_id:string,published_at:string>>, audit {audit}"

    def row(n, status, final, more, cursor, k, page=2, code=200):
        posts = [(str(i), None) for i in range(k)]
        return (n, page, "c", cursor, more, final, status, posts, ("page", page, status, final, more, code, 1, 0, 0, [], k, [p[0] for p in posts], [None] * k))

    rows = [row(1, "pagination_incomplete", False, None, None, 2), row(2, "ok", True, False, None, 0), row(3, "ok", True, True, "d", 3), row(4, "ok", True, True, "c", 3), row(5, "ok", True, True, "d", 3, code=500), row(6, "ok", True, True, "d", 3, page=0)]
    df = spark.createDataFrame(rows, schema)
    found = {k: [r.n for r in df.filter(clean_retry(k)).orderBy("n").collect()] for k in ("incomplete", "terminal", "advancing")}
    assert found == {"incomplete": [1], "terminal": [2], "advancing": [3]}


def test_cost_role(spark):
    df = spark.createDataFrame([("discovery", None, None, "x"), ("odd", None, None, "x"), (None, "diagnostic", None, "x"), (None, None, None, "Enrich"), (None, None, None, None)], "e string, p string, s string, r string")
    assert [r.c for r in df.select(cost_role(*[F.col(c) for c in "epsr"]).alias("c")).collect()] == ["discovery", "unknown", "diagnostic", "enrichment", "discovery"]
