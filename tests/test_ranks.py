"""Ranks over range partitions, ranges of missing numbers, pairs of an entity's groups, and the shared folder."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from proofmill import folders
from proofmill.operators import joins as J
from proofmill.operators import windows as W


def test_global_rank_over_many_partitions(spark):
    rnd = random.Random(1)
    values = [(rnd.randrange(10**6), i) for i in range(500)]
    rows = spark.createDataFrame(values, "v long, id long").repartition(9)
    got = W.split_at(rows, ["v", "id"], 20).collect()
    place = {v: i for i, v in enumerate(sorted(values), 1)}
    assert {(r.v, r.id): r["rank"] for r in got} == place and sum(r.pool == "target" for r in got) == 20
    assert W.global_rank(rows.limit(0), ["v", "id"]).count() == 0


def test_gaps_are_ranges(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 3), ("a", 3), ("a", 4), ("b", 2_000_000_000), ("c", None), ("d", 0)], "k string, n int")
    assert {(r.k, r.missing_from, r.missing_to) for r in W.sequence_gaps(rows, ["k"], "n").collect()} == {("a", 1, 2), ("b", 0, 1_999_999_999)}


def test_overlaps_of_an_entity_with_many_groups(spark):
    rows = [(e, g) for e, groups in {1: range(300), 2: (5, 7), None: (5, 7), 3: (7, None)}.items() for g in groups]
    got = {(r.a, r.b): r.common for r in J.overlaps(spark.createDataFrame(rows, "e int, g int"), "e", "g", zeros=False).collect()}
    assert got == {(a, b): 3 if (a, b) == (5, 7) else 1 for a, b in itertools.combinations(range(300), 2)}


def test_shared_folder_off_a_local_session(spark, monkeypatch):
    class Elsewhere:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

            class _jsc:  # noqa: N801
                sc = staticmethod(lambda: type("C", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})())

    with pytest.raises(ValueError, match="checkpoint"):
        folders.shared_folder(Elsewhere)
    kept = folders.written(spark.range(3).withColumn("x", F.lit(1)))
    assert kept.count() == 3
