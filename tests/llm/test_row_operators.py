"""Operators that judge each text alone, against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmill.llm.license_scan import license_scan
from proofmill.llm.quality import fit_quality, isotonic
from proofmill.llm.repetition import repetition_rules
from proofmill.llm.token_counts import WholeTokenCounter, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_repetition_counts(docs, corpus):
    got = {r.doc_id: r for r in repetition_rules(docs).collect()}
    assert len(got) == len(corpus)
    for i, text in corpus:
        text = text or ""
        words = WORD.findall(text)
        grams = Counter(tuple(words[a : a + 3]) for a in range(len(words) - 2))
        repeat = {a + j for a in range(len(words) - 2) if grams[tuple(words[a : a + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat)), i
        assert r.base_failed == (len(words) < 50 or 100 * len(repeat) > 50 * len(words))
        assert not (r.kept and r.base_failed)


def test_repetition_shares(spark):
    line = " ".join(f"w{i}" for i in range(60))
    text = line + "\n" + line
    r = repetition_rules(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert r.line_share == pytest.approx(0.5) and r.gram_5_share == pytest.approx(0.5) and r.n_dup_lines == 1 and not r.kept


def test_token_counts_equal_the_library(docs, corpus):
    public = pytest.importorskip("public_tokenizers")
    counter = WholeTokenCounter(public.path("word_bpe_49k.json"))
    odd = ["<|endoftext|> a<|startoftext|>b", "ΑΣ ΟΔΟΣ İst don't WE'LL 'S", "e\u0301 ﬁ ½ a\u00a0b\u0085c ÀÉß Ÿ", "123 4a5 $$'s"]
    for text in [t or "" for _, t in corpus] + odd:
        assert counter.count(text) == len(counter.lib.encode(text, add_special_tokens=False).ids), text
    small = WholeTokenCounter(public.path("word_bpe_49k.json"), memo_entries=5)
    assert [small.count(t or "") for _, t in corpus] == [counter.count(t or "") for _, t in corpus]
    got = {r.doc_id: r for r in token_counts(docs, "word_bpe_49k.json", limit=100).collect()}
    for i, text in corpus:
        n = counter.count(text or "")
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 100)


def test_token_counts_of_any_code_points():
    """Random code points, which the Unicode tables of the library and of Python class differently, and pieces that the cuts depend on."""
    public = pytest.importorskip("public_tokenizers")
    counter = WholeTokenCounter(public.path("word_bpe_49k.json"))
    rnd = random.Random(12)
    bits = ["'s", "'", "''s", "$'t", "'LL", "'re", "'v", "'ve1", "x'mé", "1'd", " ", "\n", "\t\u00a0", "-", "a", "É", "e\u0301", "7", "½", "\u2015\u208f", "-$\U000190f8", "\u200d\U00018ecc", "\u0130", "\u0130\u0316", "ß", "日本", "<|endoftext|>", "<|", "\u3000"]
    texts = ["".join(rnd.choice(bits) if rnd.random() < 0.6 else chr(rnd.choice([rnd.randrange(32, 0x250), rnd.randrange(0xE000, 0x110000), rnd.randrange(0x250, 0xD800)])) for _ in range(12)) for _ in range(20_000)]
    got = counter.counts(texts)
    expected = [len(e.ids) for e in counter.lib.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, expected) if a != b] == []


def test_token_counts_in_parts(spark, monkeypatch):
    import proofmill.llm.token_counts as tc

    public = pytest.importorskip("public_tokenizers")
    counter = WholeTokenCounter(public.path("word_bpe_49k.json"))
    monkeypatch.setattr(tc, "SLICE_CHARS", 100)
    text = " ".join(f"word{i} it's" for i in range(2000)) + "x" * 5000
    assert counter.count(text) == counter.merged(text) and len(list(tc._cut(text))) > 50 and "".join(tc._cut(text)) == text
    rows = [(None, "it's"), (None, "it's"), (1, None), (1, text)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x")), "word_bpe_49k.json").collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == sorted([(4, 2), (4, 2), (0, 0), (len(text), counter.merged(text))])


def test_license_base_places(docs, corpus):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    got = {r.doc_id: r for r in license_scan(docs).collect()}
    assert len(got) == len(corpus)
    for i, text in corpus:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(a, label) for p, label in phrases.items() for a in range(len(words)) if words[a : a + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places)), i
        assert (r.first_word, r.last_word) == ((min(p[0] for p in places), max(p[0] for p in places)) if places else (None, None))
        assert r.base_labels == ",".join(sorted({p[1] for p in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_neighbouring_diagonals(spark):
    text = "foo Permission is hereby kindly granted, free of charge, to any person obtaining a copy of this software and associated documentation files bar"
    r = license_scan(spark.createDataFrame([(1, text), (1, text)], "doc_id int, text string")).collect()
    assert len(r) == 2 and r[0] == r[1]
    assert r[0].labels == "mit" and r[0].base_labels == "" and 0.8 <= r[0].score < 1


def test_quality_learns_and_keeps_rows(spark):
    good = [(i, " ".join(f"word{(i * 7 + j * j) % 97}" for j in range(60 + i % 20)) + ".") for i in range(200)]
    bad = [(200 + i, " ".join(f"AB{(i + j) % 5}!!" for j in range(40 + i % 30))) for i in range(100)]
    docs = spark.createDataFrame(good + bad + [(None, None), (999, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = fit_quality(docs, labels, F.col("doc_id") % 3 != 1)
    scores = {r.doc_id: r.score for r in model.score(docs).collect()}
    held = [(s >= 0.5) == (i < 200) for i, s in scores.items() if i is not None and i < 300 and i % 3 == 1]
    assert sum(held) / len(held) > 0.97 and all(0 <= s <= 1 for s in scores.values()) and len(scores) == 302
    kept = model.keep(docs.withColumn("extra", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "extra"] and kept.filter("doc_id < 200").count() >= 195
    unlabelled = fit_quality(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in unlabelled.score(docs).collect()} == {0.5}


def test_quality_fit_equals_numpy(spark):
    """Moments, normal equations, ridge weights and calibration from the statistics of the same rows, without Spark."""
    import proofmill.llm.quality as q
    from proofmill.llm import textgrid as tg

    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choice(["Abc", "de", "f!", "12", "ghij."]) for _ in range(rnd.randint(1, 60)))) for i in range(300)]
    marks = [(i, int(len(t) % 3 == 0 or i % 5 == 0)) for i, t in rows]
    docs = spark.createDataFrame([*rows, (999, "not labelled"), (None, "x")], "doc_id long, text string")
    model = fit_quality(docs, spark.createDataFrame([*marks, (7000, 1), (None, 0)], "doc_id long, quality int"), F.col("doc_id") % 3 != 1)
    used = [i for i, _ in marks if i % 3 != 1]
    held = {r.v for r in spark.createDataFrame([(i,) for i in used], "v long").filter("pmod(xxhash64(v, 'calibrate'), 5) = 0").collect()}
    raw = [t.encode() for _, t in rows]
    stats = q.statistics(tg.Slice(0, 300, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))).astype(np.float32).astype(float)
    x, y = stats[used], np.array([marks[i][1] for i in used], float)
    centre, scale = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-8))
    assert np.allclose(model.centre, centre) and np.allclose(model.scale, scale, rtol=1e-4)
    fit = np.array([i not in held for i in used])
    z = model.features(x)
    a = z[fit].T @ z[fit] + q.RIDGE * fit.sum() / q.FEATURES * np.eye(q.FEATURES + 1)
    # Rows of one design whose eigenvalues differ by much: the solutions are compared by what they predict.
    assert np.allclose(z @ model.weights, z @ np.linalg.solve(a, z[fit].T @ y[fit]), atol=1e-4)
    out, truth = (z @ model.weights)[~fit], y[~fit]
    assert abs(model.probability(x[~fit]).mean() - truth.mean()) < 0.1 and len(out) == len(truth)
    got = {r.doc_id: r.score for r in model.score(docs).collect()}
    assert all(got[i] == pytest.approx(p, abs=1e-6) for i, p in zip(range(300), model.probability(q.statistics(tg.Slice(0, 300, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))))))


def test_license_scan_without_the_filter(spark, docs, monkeypatch):
    import proofmill.llm.license_scan as ls

    whole = sorted(map(str, license_scan(docs).collect()))
    monkeypatch.setattr(ls, "BROADCAST_GRAMS", 3)
    assert sorted(map(str, license_scan(docs).collect())) == whole


def test_isotonic_is_monotone():
    x, y = isotonic(np.arange(6.0), np.array([0.0, 1, 0, 1, 0.5, 1]), np.ones(6))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all()


def test_empty_tables(no_docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert repetition_rules(no_docs).count() == 0
    assert license_scan(no_docs).count() == 0
    assert fit_quality(no_docs, labels, F.lit(True)).score(no_docs).count() == 0
    pytest.importorskip("public_tokenizers")
    assert token_counts(no_docs, "word_bpe_49k.json").count() == 0


def test_several_labels_of_one_id(spark):
    """Each label row counts, also where two differ; scores stay one for each row of documents."""
    docs = spark.createDataFrame([(i, ("clean words that go on and on " * 9) if i % 2 else "$$$ ### junk !!! " * 9) for i in range(40)] + [(1, None)], "doc_id long, text string")
    rows = [(i, i % 2) for i in range(40)]
    labels = spark.createDataFrame(rows * 2 + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = fit_quality(docs, labels, F.lit(True)).score(docs).collect()
    assert len(got) == 41 and all(0 <= r.score <= 1 for r in got)
    clean, junk = (sum(r.score for r in got if r.doc_id % 2 == k and r.doc_id > 1) for k in (1, 0))
    assert clean > junk
    assert fit_quality(docs, labels.limit(0), F.lit(True)).score(docs.limit(0)).count() == 0
