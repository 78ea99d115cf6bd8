"""Every operator and pipeline stage on a table with clashing columns, null and repeated ids, repeated rows and a long text."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from proofmill.llm.common import fold_of
from proofmill.llm.decontaminate import contaminated, drop_contaminated
from proofmill.llm.language_model import score_texts
from proofmill.llm.license_scan import license_scan
from proofmill.llm.mixing import mixing_weights, sample_mix
from proofmill.llm.near_duplicates import drop_near_duplicates, near_duplicates
from proofmill.llm.quality import fit_quality
from proofmill.llm.repetition import repetition_rules
from proofmill.llm.substring_dedup import remove_repeats
from proofmill.llm.token_counts import token_counts

#: Names that some operator uses inside or returns.
NAMES = """_all _blob _cell_source _d _digest _draw _gone _h _held _id _k _key _kind _n _n_removed _n_words _o _order _r _rest _row _stats _t _text _tokens _v _y
a b back block blocks c class_id cls copies copy_id ctx depth diagonal digest first group grams h held_out hits hs i item item_words j kept known label left long m mask mass mine n n_bytes n_copies
n_links n_places n_removed n_shingles n_tokens n_words no node node2 other own paths perplexity place plus predicted print probability quality rare rep residual row salt same score seed seen
share span spans spaced spelling t template text_ theirs topic tree u v weight weights words""".split()


@pytest.fixture(scope="module")
def table(spark):
    word = lambda i, n: " ".join(f"w{(i * 7 + j * j) % 911}" for j in range(n))
    rows = [(i, word(i, 30 + i % 40), "en", f"s{i % 3}") for i in range(40)]
    rows += [rows[3], rows[3], (3, rows[4][1], "en", "s1"), (None, word(1, 50), None, None), (None, word(1, 50), None, None), (None, None, None, None), (77, "", "fr", "s0"), (78, word(5, 250_000), "en", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    return docs.withColumns({c: F.lit(f"mine {c}") for c in NAMES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").withColumn("_y", F.lit("x"))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(f"quiz{i}" for i in range(20))), (None, None)], "item_id long, text string")


@pytest.mark.parametrize("name", ["op1", "op3", "op4", "op6", "op7", "op8", "op9"])
def test_a_row_for_each_row(table, labels, name):
    run = {
        "op1": lambda: score_texts(table, fold_of("doc_id", 7) != 2),
        "op3": lambda: mixing_weights(table),
        "op4": lambda: near_duplicates(table),
        "op6": lambda: token_counts(table, "word_bpe_49k.json"),
        "op7": lambda: repetition_rules(table),
        "op8": lambda: license_scan(table),
        "op9": lambda: fit_quality(table, labels, fold_of("doc_id", 3) != 1).score(table),
    }
    if name == "op6":
        pytest.importorskip("public_tokenizers")
    got, n = run[name]().collect(), table.count()
    assert len(got) == n and sum(r.doc_id is None for r in got) == 3


@pytest.mark.parametrize("name", ["sample_mix", "remove_repeats", "drop_near_duplicates", "drop_contaminated", "keep", "contaminated"])
def test_columns_pass_through(table, labels, items, name):
    if name == "contaminated":
        assert contaminated(table, items).count() == 0
        return
    run = {
        "sample_mix": lambda: sample_mix(table),
        "remove_repeats": lambda: remove_repeats(table),
        "drop_near_duplicates": lambda: drop_near_duplicates(table),
        "drop_contaminated": lambda: drop_contaminated(table, items),
        "keep": lambda: fit_quality(table, labels, fold_of("doc_id", 3) != 1).keep(table, least=0.0),
    }
    done = run[name]()
    kept = [c for c in NAMES if name != "remove_repeats" or c not in ("n_words", "n_removed")]
    assert set(done.columns) == set(table.columns)
    rows = done.collect()
    assert rows and all(r[c] == f"mine {c}" for r in rows for c in kept)


def test_pipeline_stages(spark, table, labels, items, tmp_path):
    at = f"file://{tmp_path}/sf"
    for name, df in (("documents", table), ("labels", labels), ("benchmark", items)):
        df.write.parquet(f"{at}/{name}.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        done = corpus_pipeline.written(stage(spark, docs, at))
        assert done.columns == table.columns, name
        assert {r[0] for r in done.select("n_removed").distinct().collect()} <= {"mine n_removed"}, name
        docs = done if done.count() else docs
