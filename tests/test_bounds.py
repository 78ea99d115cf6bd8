"""Plans and files whose size a task must not take from the table."""

import os

import pytest

import __spark_entry__ as entry
from proofmill.plans import readings

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tag_labels_makes_no_object_of_an_order(spark):
    df = entry.queries()["tag_labels"](spark, SF)
    assert not [line for line in plan(df).splitlines() if "Aggregate [l_orderkey" in line and "collect_set" in line]


def test_page_cards_shuffles_no_markup(spark):
    lines = plan(entry.queries()["page_cards"](spark, SF)).splitlines()
    shuffle = [i for i, line in enumerate(lines) if "RepartitionByExpression" in line]
    assert len(shuffle) == 1 and not [line for line in lines[: shuffle[0]] if "token#" in line]


def test_frozen_sample_is_several_files(spark, monkeypatch):
    files, whole = [], readings.S.write_manifest
    monkeypatch.setattr(readings, "FROZEN_FILE_ROWS", 400, raising=False)
    monkeypatch.setattr(readings.S, "write_manifest", lambda s, folder, path: (files.extend(s.read.json(folder).inputFiles()), whole(s, folder, path)))
    rows = entry.queries()["frozen_outputs"](spark, SF).collect()
    assert len(files) > 1 and [tuple(r) for r in rows] == [(rows[0]["rows"], 0, 1, 3, True)]


def test_normal_forms_bounds_its_batches(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting, None)
    spark.conf.unset(setting)
    entry.queries()["normal_forms"](spark, SF)
    assert spark.conf.get(setting) == "4m"
    if before is None:
        spark.conf.unset(setting)
