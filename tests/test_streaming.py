from datetime import UTC, datetime, timedelta

import pytest

from proofmill.streaming import state as S

START = datetime(2024, 1, 1, tzinfo=UTC)


@pytest.fixture
def stream(spark, tmp_path):
    def of(rows, schema, name="in", batches=1):
        folder = tmp_path / name
        for b in range(batches):
            spark.createDataFrame(rows[b::batches] if batches > 1 else rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    return of


def test_late_rows_never_overwrite(stream):
    rows = [("a", START + timedelta(hours=h), i, v) for i, (h, v) in enumerate([(1, "old"), (3, "new"), (2, "late"), (3, "same time, later"), (0, "oldest")])]
    found = S.latest_rows(S.available_now(S.newest(stream(rows, "k string, t timestamp, n int, v string"), "k", "t", "n", "v"), "update"), ["k"])
    assert found.first().v == "same time, later"


def test_tree_state_replay_and_gaps(stream):
    rows = [("t", 0, "a", None), ("t", 1, "b", "a"), ("t", 1, "d", "zz"), ("t", 2, "c", "b"), ("t", 2, "b", "x"), ("t", 2, "c", "b"), ("t", 4, "e", "c"), ("u", 5, "r", None)]
    found = S.latest_rows(S.available_now(S.tree_state(stream(rows + rows, "k string, s bigint, n string, p string"), "k", "s", "n", "p"), "update"), ["tree"])
    t, u = (r for r in found.orderBy("tree").collect())
    assert (t.last_applied, t.n_nodes, t.n_waiting, t.n_missing, t.depth, t.gaps) == (4, 5, 0, 1, 4, ["parent:b"])
    assert (u.n_nodes, u.depth, u.gaps) == (1, 1, [])


def test_rerun_continues_from_checkpoint(spark, stream, tmp_path):
    rows = [("a", START), ("b", START)]
    events = stream(rows, "k string, t timestamp")
    at = f"file://{tmp_path}/out"
    assert S.available_now(S.unique_events(events, ["k"], "t", "1 day"), at=at).count() == 2
    spark.createDataFrame([("a", START), ("c", START)], "k string, t timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "in"))
    assert sorted(r.k for r in S.available_now(S.unique_events(again, ["k"], "t", "1 day"), at=at).collect()) == ["a", "b", "c"]


def test_pairs_meet_whichever_comes_first(stream):
    left = stream([("k", 1, START), ("k", 2, START + timedelta(hours=9))], "k string, a int, ta timestamp", "left")
    right = stream([("k", 7, START + timedelta(minutes=5)), ("j", 8, START)], "k string, b int, tb timestamp", "right")
    got = S.available_now(S.paired(left, right, ["k"], "ta", "tb", "1 day", "1 HOUR")).collect()
    assert [(r.a, r.b) for r in got] == [(1, 7)]


def test_replay_takes_committed_rows_only(spark):
    journal = spark.createDataFrame([("p", 2, True), ("p", 1, True), ("p", 3, False)], "k string, n int, ok boolean")
    good, failed = S.replay_committed(journal, ["k"], ["n"], "ok")
    assert [r.n for r in good.collect()] == [1, 2] and failed.count() == 1
