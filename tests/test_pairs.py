"""Pairs of groups counted inside tasks: cut entities, many shares, equal to brute force; nothing is joined by entity."""

import random
from collections import Counter
from itertools import combinations

import numpy as np

from proofmill.operators import pairs as P


def test_pairs_of_cut_entities_in_many_shares(spark, monkeypatch):
    monkeypatch.setattr(P, "HELD", 50)
    monkeypatch.setattr(P, "SHARE", 40)
    rnd = random.Random(4)
    sets = [rnd.sample([f"g{i:02}" for i in range(40)], rnd.choice([0, 1, 2, 5, 40])) for _ in range(60)] + [["always", "x"]] * 300
    own = spark.createDataFrame([(e or None, g) for e, s in enumerate(sets) for g in s], "_e int, a string")
    got = P.pair_counts(own)
    plan = got._jdf.queryExecution().toString()
    rows = got.collect()
    expected = Counter(p for s in sets for p in combinations(sorted(s), 2))
    assert {(r.a, r.b): r.common for r in rows} == dict(expected) and len(rows) == len(expected)
    assert "MapInArrow" in plan and "_e" not in plan  # no row for each pair of an entity


def test_pairs_of_no_rows(spark):
    assert P.pair_counts(spark.createDataFrame([(1, "a"), (2, "a")], "_e int, a string")).count() == 0
    assert P.pair_counts(spark.createDataFrame([], "_e int, a string")).count() == 0


def test_mixed_pairs_come_back():
    keys = P.pairs_of(np.array([3, 5, 2**31], np.uint64), np.array([2, 1, 0])) * P._BACK
    assert [(int(k) >> 32, int(k) & 0xFFFFFFFF) for k in keys] == [(3, 5), (3, 2**31), (5, 2**31)]
