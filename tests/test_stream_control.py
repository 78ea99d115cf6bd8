"""Tree state against a plain fold, snapshots, pauses, cuts and progress."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from proofmill.streaming import control as C
from proofmill.streaming import state as S
from proofmill.streaming import trees as TR

SCHEMA = "k string, s bigint, n string, p string"


def parts(spark, folder, batches, schema=SCHEMA):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def fold(rows, most=2):
    """A tree for each key, with the whole tree looked at for each sequence."""
    out = {}
    for k in {r[0] for r in rows}:
        tree, waiting, gaps, last = {}, {}, set(), -1
        for s in sorted({r[1] for r in rows if r[0] == k}):
            last = s
            for _, _, n, p in sorted((r for r in rows if r[0] == k and r[1] == s), key=lambda r: r[2]):
                if n not in tree:
                    tree[n] = p
                elif tree[n] != p:
                    gaps.add(f"parent:{n}")
                waiting.pop(n, None)
            for p in tree.values():
                if p and p not in tree:
                    waiting.setdefault(p, 0)
            waiting = {p: t + 1 for p, t in waiting.items()}
        depth = {n: 1 for n, p in tree.items() if not p}
        while more := {n: depth[p] + 1 for n, p in tree.items() if n not in depth and p in depth}:
            depth |= more
        missing = sum(t > most for t in waiting.values())
        out[k] = (last, len(tree), len(waiting) - missing, missing, max(depth.values(), default=0), sorted(gaps))
    return out


def random_rows(seed, n=160):
    rnd = random.Random(seed)
    rows, first = [], {}
    for _ in range(n):
        k, s, node = rnd.choice("tuv"), rnd.randint(0, 14), f"n{rnd.randint(0, 25)}"
        p = None if node == "n0" else f"n{rnd.randint(0, 25)}"
        # One row of a node in a sequence: two with different parents would have no first one.
        if (k, s, node) not in first:
            first[k, s, node] = p
            rows.append((k, s, node, p))
    return rows


def result(df):
    return {r.tree: (r.last_applied, r.n_nodes, r.n_waiting, r.n_missing, r.depth, sorted(r.gaps)) for r in df.collect()}


@pytest.mark.parametrize("batches", [1, 4])
def test_tree_state_equals_a_fold(spark, tmp_path, batches):
    rows = random_rows(5)
    size = 15 // batches + 1
    cut = [[r for r in rows if b * size <= r[1] < (b + 1) * size] for b in range(batches)]
    cut.append(cut[0] + [("t", None, "x", None), (None, 3, "x", None), ("t", 3, None, None)])  # a replay, and rows that are no evidence
    stream = parts(spark, tmp_path / "in", [c for c in cut if c])
    got = result(S.latest_rows(S.available_now(S.tree_state(stream, "k", "s", "n", "p"), "update"), ["tree"]))
    assert got == fold(rows)


def test_snapshot_goes_on_like_one_run(spark, tmp_path):
    rows = random_rows(6)
    first, second = [r for r in rows if r[1] < 7], [r for r in rows if r[1] >= 7 and r[0] != "v"]
    one, two, saved = (f"file://{tmp_path}/{n}" for n in ("one", "two", "saved"))
    C.run_controlled(S.tree_state(parts(spark, tmp_path / "a", [first]), "k", "s", "n", "p"), one, mode="update")
    snap = TR.tree_snapshot(spark, f"{one}/checkpoint")
    digest = TR.save_snapshot(snap, saved)
    assert digest == TR.snapshot_digest(snap.repartition(7))
    C.run_controlled(TR.tree_state(parts(spark, tmp_path / "b", [second]), "k", "s", "n", "p", start=TR.load_snapshot(spark, saved)), two, mode="update")
    want = fold(first + second)
    got = {r.key.tree: (r.value.last_applied, r.value.n_nodes, r.value.n_waiting, r.value.n_missing, r.value.depth) for r in TR.state_rows(spark, f"{two}/checkpoint", "counters").collect()}
    assert got == {k: v[:5] for k, v in want.items()}
    gaps = {}
    for r in TR.state_rows(spark, f"{two}/checkpoint", "gaps").collect():
        gaps.setdefault(r.key.tree, []).append(r.user_map_key.gap)
    assert {k: sorted(v) for k, v in gaps.items()} == {k: v[5] for k, v in want.items() if v[5]}
    snap.limit(3).write.mode("overwrite").parquet(f"{saved}/state")
    with pytest.raises(ValueError, match="isn't what was saved"):
        TR.load_snapshot(spark, saved)


def test_pause_and_restart_repeat_nothing(spark, tmp_path):
    batches = [[(f"k{b}", b, f"n{i}", None) for i in range(b + 1)] for b in range(4)]
    stream = parts(spark, tmp_path / "in", batches)
    at, asked = f"file://{tmp_path}/out", []

    def control(n):
        asked.append(n)
        return "cooling" if n == 1 and asked.count(1) < 3 else None

    assert C.run_controlled(stream, at, control) == "cooling"
    assert C.committed_batch(spark, at) == 0 and C.sink_rows(spark, at, stream.schema).count() == 1
    assert C.run_controlled(stream, at, control) == "cooling"
    assert C.run_controlled(stream, at, control) == "done"
    assert asked == [0, 1, 1, 1, 2, 3]
    got = sorted((r.k, r.n, r.batch) for r in C.sink_rows(spark, at, stream.schema).collect())
    assert got == sorted((k, n, b) for b, rows in enumerate(batches) for k, _, n, _ in rows)


def test_control_table(spark, tmp_path):
    at = f"file://{tmp_path}/control"
    say = lambda *row: spark.createDataFrame([row], "batch bigint, status string, not_before string").coalesce(1).write.mode("append").json(at)
    say(None, "running", None)
    ask = C.control_table(spark, at)
    assert ask(0) is None and ask(9) is None
    say(5, "paused", None)
    assert ask(4) is None and ask(5) == "paused" and ask(6) == "paused"
    say(5, "running", "2999-01-01T00:00:00Z")
    assert ask(5) == "cooling"
    say(7, "running", "2001-01-01T00:00:00Z")
    assert ask(5) == "cooling" and ask(7) is None


def test_cut_leaves_out_what_one_stream_has_more(spark, tmp_path):
    batches = [[("k", b, f"n{b}", None)] for b in range(3)]
    a, b = parts(spark, tmp_path / "a", batches), parts(spark, tmp_path / "b", batches)
    runs = [(f"file://{tmp_path}/oa", a.schema), (f"file://{tmp_path}/ob", b.schema)]
    assert C.finalized(spark, runs)[1] == {"cut": -1, "status": "partial", "ahead": [0, 0]}
    C.run_controlled(b, runs[1][0], lambda n: "paused" if n == 1 else None)
    assert C.finalized(spark, runs)[1]["cut"] == -1
    C.run_controlled(a, runs[0][0], lambda n: "paused" if n == 2 else None)
    shutil.copytree(tmp_path / "oa/rows/batch=1", tmp_path / "ob/rows/batch=1")  # written, never committed
    frames, report = C.finalized(spark, runs)
    assert report == {"cut": 0, "status": "partial", "ahead": [1, 0]}
    before = [[r.n for r in f.collect()] for f in frames]
    C.run_controlled(a, runs[0][0])
    assert before == [["n0"], ["n0"]] == [[r.n for r in f.collect()] for f in C.finalized(spark, runs)[0]]
    C.run_controlled(b, runs[1][0])
    assert C.finalized(spark, runs)[1] == {"cut": 2, "status": "complete", "ahead": [0, 0]}


def test_progress_rows_add_up(spark, tmp_path):
    batches = [[("k", b, f"n{i}", None) for i in range(b + 1)] for b in range(3)]
    stream = parts(spark, tmp_path / "in", batches).observe("seen", F.count("*").alias("n"))
    C.run_controlled(stream, f"file://{tmp_path}/out", progress=f"file://{tmp_path}/progress")
    got = spark.read.schema(C.PROGRESS_SCHEMA).json(f"file://{tmp_path}/progress").orderBy("batch").collect()
    assert [(r.batch, r.input_rows, r.observed) for r in got] == [(b, b + 1, f'{{"seen": {{"n": {b + 1}}}}}') for b in range(3)]
