"""The pipeline's stages on a small corpus, each against a brute-force version on its own input."""

import random

import pytest
from pyspark.sql import functions as F
from test_corpus_operators import brute_links, brute_overlaps, brute_repeats

import corpus_pipeline
from proofmill.llm.mixing import mixing_weights


@pytest.fixture
def folder(spark, tmp_path, corpus):
    rnd = random.Random(4)
    item = " ".join(f"quiz{rnd.randrange(500)}" for _ in range(40))
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}", len(t or "")) for i, t in corpus]
    rows += [(200 + i, " ".join(f"AB{(i + j) % 5}!!" for j in range(60)), "en", "s0", 300) for i in range(40)]
    rows += [(300, corpus[2][1] + " " + item, "en", "s1", 9), (None, "no id but words " + " ".join(f"z{j}" for j in range(50)), "fr", None, None)]
    at = f"file://{tmp_path}/sf"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1) for i, _ in corpus if i % 2] + [(200 + i, 0) for i in range(0, 40, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None]


def test_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = pairs(docs)
        docs = corpus_pipeline.written(stage(spark, docs, folder))
        assert docs.columns == columns, name
        after = dict(pairs(docs))
        seen[name] = (before, after)
        assert docs.filter("doc_id is null").count() <= 1
    before, after = seen["quality_classifier"]
    assert not any(200 <= i < 240 for i in after) and set(after) <= set(dict(before))
    before, after = seen["near_duplicates"]
    links = brute_links(sorted(before))
    assert set(after) == {c for c, _, _ in links.values()}
    before, after = seen["substring_dedup"]
    for i, (n, removed, kept) in brute_repeats(before).items():
        if removed == 0:
            assert after[i] == dict(before)[i]
        elif removed < n:
            assert after[i] == kept
        else:
            assert i not in after
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute_overlaps(before, items)}
    assert 300 in bad and set(after) == set(dict(before)) - bad
    before, after = seen["mixing"]
    assert set(after) < set(dict(before)) and after


def test_run_is_the_stages_and_repeats(spark, folder):
    first, second = (corpus_pipeline.run(spark, folder) for _ in range(2))
    assert sorted(map(str, pairs(first))) == sorted(map(str, pairs(second))) and first.count() > 5
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark, folder, tmp_path):
    at = f"file://{tmp_path}/empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0


def test_sampled_rows_are_those_with_a_small_draw(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.mixing(spark, docs, folder).collect()}
    assert kept == {r.doc_id for r in mixing_weights(docs).filter(F.col("sampled")).collect()}
