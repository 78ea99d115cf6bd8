"""Sets of outputs that become visible at once or not at all."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from proofmill.sources import publishing as P


@pytest.fixture
def at(tmp_path):
    return f"file://{tmp_path}/sets"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, "a"), (2, None)], "k int, t string")


def listed(at):
    folder = at.removeprefix("file://")
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


def test_a_set_is_there_whole(spark, at, rows):
    assert P.publish(spark, at, {"a": rows, "b.txt": "é\n", "c": lambda path: rows.write.parquet(path)}) == 1
    assert P.publish(spark, at, {"a": rows.limit(1)}) == 2
    one = P.published(spark, at, 1)
    assert spark.read.schema("k int, t string").json(f"{one}/a").count() == 2 == spark.read.parquet(f"{one}/c").count()
    assert spark.read.text(f"{one}/b.txt").first().value == "é"
    assert spark.read.json(f"{P.published(spark, at)}/a").count() == 1 and listed(at) == ["v00000001", "v00000002"]


@pytest.mark.parametrize("where", ["second output", "before the rename"])
def test_a_failure_between_outputs_shows_none(spark, at, rows, where):
    def lost(*_):
        raise OSError("lost")

    second = lost if where == "second output" else rows
    with pytest.raises(OSError, match="lost"):
        P.publish(spark, at, {"a": rows, "b": second, "c": rows}, None if where == "second output" else lost)
    assert P.versions(spark, at) == [] and listed(at) == []
    with pytest.raises(FileNotFoundError):
        P.published(spark, at)
    assert P.publish(spark, at, {"a": rows}) == 1


def test_a_failing_row_shows_none(spark, at, rows):
    with pytest.raises(Exception, match="boom"):
        P.publish(spark, at, {"a": rows, "b": rows.select(F.raise_error(F.lit("boom")).cast("string").alias("x"))})
    assert listed(at) == []


def test_recovery_finishes_or_discards(spark, at, rows):
    P.publish(spark, at, {"a": rows, "b.txt": "x"})
    folder = at.removeprefix("file://")
    whole, torn, unlisted = (f"{folder}/{P.STAGING}{n}" for n in ("1", "2", "3"))
    for name in (whole, torn, unlisted):
        shutil.copytree(f"{folder}/v00000001", name)
    for f in (f"{torn}/b.txt", f"{torn}/.b.txt.crc"):
        os.remove(f)
    shutil.rmtree(f"{unlisted}/{P.MANIFEST}")
    assert P.recover(spark, at) == {f"{P.STAGING}1": 2, f"{P.STAGING}2": None, f"{P.STAGING}3": None}
    assert listed(at) == ["v00000001", "v00000002"] and P.recover(spark, at) == {}
    with open(f"{folder}/v00000002/more.txt", "w") as f:
        f.write("not listed")
    with pytest.raises(FileNotFoundError):
        P.published(spark, at)
    assert P.published(spark, at, 1).endswith("v00000001")


def test_bundles(spark, at, rows):
    seen = spark.createDataFrame([(True, "x"), (True, "x"), (False, "y")], "eligible boolean, target string")
    P.publish(spark, at, P.review_bundle(rows, seen, "Review", True))
    folder = P.published(spark, at)
    got = spark.read.json(f"{folder}/proposal.json").first()
    assert (got.state, got.targets) == ("proposed", ["x"])
    assert P.review_bundle(rows, seen, "Review", False)["proposal.json"] == '{"state": "blocked", "targets": []}'
    assert P.publish(spark, at, P.next_input(rows, seen, {"most": 5}, folder)) == 2
    assert spark.read.json(f"{P.published(spark, at)}/input.json").first().limits.most == 5
