"""Chains of any length, broken ones, cycles and repeated cursors."""

import __spark_entry__ as entry
from proofmill.operators.joins import walk_chain


def test_walk_chain(spark):
    rows = [("long", str(i), str(i + 1) if i < 1499 else None) for i in range(1500)]
    rows += [("gap", "0", "1"), ("gap", "1", "2"), ("gap", "3", None), ("cycle", "0", "1"), ("cycle", "1", "2"), ("cycle", "2", "1")]
    rows += [("twice", "0", "1"), ("twice", "0", "2"), ("twice", "1", None), ("twice", "2", None), ("one", "0", None), ("one", "0", None), (None, "0", "1"), (None, "1", None), ("no head", "1", None)]
    got = {r.k: (r.depth, r.complete) for r in walk_chain(spark.createDataFrame(rows, "k string, c string, f string"), "k", "c", "f", "0").collect()}
    assert got == {"long": (1500, True), "gap": (2, False), "cycle": (3, False), "twice": (2, False), "one": (1, True), None: (2, True)}


def test_threads_whole_and_broken(spark, tmp_path):
    turns = [(1, t) for t in range(1200)] + [(2, 0), (2, 1), (2, 3), (3, 1), (4, 0), (4, 0)]
    spark.createDataFrame(turns, "conv_id long, turn long").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {name: {r.conv_id: (r.depth, r.complete) for r in entry.queries()[name](spark, str(tmp_path)).collect()} for name in ("thread_depth", "thread_breaks")}
    assert found["thread_depth"] == {1: (1200, True), 4: (1, True)}
    assert found["thread_breaks"] == {2: (2, False), 3: (0, False)}
