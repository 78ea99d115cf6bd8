"""The class model against brute force: counts, classes' likelihood, scores of given classes."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import proofmill.llm.language_model as lm
from proofmill.llm import textgrid as tg
from proofmill.llm.common import fold_of
from proofmill.llm.language_model import CLASSES, class_count, exchange, fit_classes, likelihood, score_texts, score_with

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tokens_of(text):
    return [*WORD.findall(ascii_lower(text or "")), None]


def learns(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2


@pytest.mark.parametrize("table_words", [20, 100_000])
def test_counts_and_base_score(docs, corpus, no_docs, table_words):
    got = {r.doc_id: r for r in score_texts(docs, fold_of("doc_id", 7) != 2, table_words=table_words).collect()}
    tokens = {i: tokens_of(t) for i, t in corpus}
    counts = Counter(w for i, ws in tokens.items() if learns(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(corpus)
    for i, ws in tokens.items():
        r = got[i]
        assert r.held_out == (not learns(i))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0 and math.isfinite(r.score)
    known = [r for r in got.values() if not r.held_out]
    assert sum(r.score for r in known) > sum(r.base_score for r in known)
    assert score_texts(no_docs, F.lit(True)).count() == 0


def word_facts(model):
    """(class as history, class, count) of a word, from the model's own tables."""
    table, of = model.table, model.classes_of
    rare = {r.h: (r.cls, r.c) for r in model.rare.collect()}

    def facts(word):
        if word is None:
            return of[-1], of[-1], None
        raw = np.frombuffer(word.encode(), np.uint8)
        s = tg.Slice(0, 1, raw, np.array([0, len(raw)]))
        w = tg.words(s)
        h = tg.segment_hash(raw, w.starts, w.ends)
        at, known = table.find(h)
        if known[0]:
            cls = of[table.ranks[at[0]]]
            return cls, cls, int(table.counts[at[0]])
        bucket = of[len(table.hashes) + lm._spelling(raw, w)[0]]
        cls, c = rare.get(int(h.view(np.int64)[0]), (bucket, 0))
        return bucket, cls, c

    return facts


@pytest.mark.parametrize("table_words", [0, 30, 100_000])
def test_scores_of_given_classes(spark, docs, corpus, table_words):
    model = fit_classes(docs.filter(fold_of("doc_id", 7) != 2), table_words=table_words)
    facts = word_facts(model)
    k = len(model.bigrams)
    pairs, mass = np.zeros((k, k)), Counter()
    vocabulary = Counter()
    for i, t in corpus:
        if learns(i):
            before = None
            for w in tokens_of(t):
                pairs[facts(before)[0], facts(w)[1]] += 1
                vocabulary[w] += 1
                before = w
    assert (model.bigrams == pairs).all()
    for w, c in vocabulary.items():
        mass[facts(w)[1]] += c
        assert w is None or facts(w)[2] == c
    once = [w for w, c in vocabulary.items() if c == 1 and w is not None]
    unseen = defaultdict(lambda: 1.0, {c: n + 1.0 for c, n in Counter(model.classes_of[len(model.table.hashes) + lm._spelling(r, tg.words(tg.Slice(0, 1, r, np.array([0, len(r)]))))[0]] for r in (np.frombuffer(w.encode(), np.uint8) for w in once)).items()})
    transition, whole, missing = model.weights()
    total = sum(unseen[c] for c in range(k))
    hidden = max(1.0, len(once) * (len(once) - 1) / (2 * (sum(c == 2 for w, c in vocabulary.items() if w is not None) + 1)))
    assert 10**missing == pytest.approx(total / max(hidden, total / min(unseen[c] for c in range(k))))
    # Every class's words and the share of unseen words in it sum to one; so does every row of transitions.
    for c in range(k - 1):
        assert (mass[c] + unseen[c]) / 10 ** whole[c] == pytest.approx(1)
    assert np.allclose((10**transition).sum(1), 1)
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.lit(False).alias("_held"))
    got = {r._id: r.score for r in score_with(model, rows).collect()}
    n = pairs.sum()
    prior = (pairs.sum(0) + 1) / (n + k)
    for i, t in corpus:
        score, before = 0.0, None
        for w in tokens_of(t):
            h, (_, cls, c) = facts(before)[0], facts(w)
            score += math.log10((pairs[h, cls] + lm.BACK_OFF * prior[cls]) / (pairs[h].sum() + lm.BACK_OFF))
            if w is not None:
                score += math.log10((c or 10**missing) / (mass[cls] + unseen[cls]))
            before = w
        assert got[i] == pytest.approx(score), i


def test_null_and_repeated_ids_and_long_texts(spark):
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    rows = [(None, "a b c"), (None, "a b c"), (4, "a b c"), (4, "a b c"), (5, long), (6, ""), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit(1)).withColumn("score", F.lit("x"))
    got = score_texts(docs, fold_of("doc_id", 7) != 2).collect()
    assert len(got) == len(rows) and sum(r.n_tokens for r in got) == 4 * 4 + 200_001 + 2
    assert len({r.score for r in got if r.n_tokens == 4}) == 1 and all(r.held_out == (not learns(r.doc_id)) for r in got)
    assert all(math.isfinite(r.score) for r in score_texts(docs, F.lit(False)).collect())


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(1)
    of = np.arange(81) % 4
    bigrams = rng.poisson(np.where(of[:, None] == (of[None, :] + 1) % 4, 20, 1)).astype(float)

    def of_classes(c, k):
        m = np.zeros((81, k))
        m[np.arange(81), c] = 1
        return likelihood(m.T @ bigrams @ m)

    found = exchange(bigrams, classes=5)
    start = np.empty(81, int)
    start[np.argsort(-(bigrams.sum(0) + bigrams.sum(1))[:-1], kind="stable")] = np.arange(80) % 4
    start[-1] = 4
    assert of_classes(found, 5) > of_classes(start, 5) and found[-1] == 4 and (found[:-1] != 4).all() and CLASSES > 5


def test_best_class_is_the_best_move():
    """The gain of every move equals the likelihood of the whole table after it."""
    rng = np.random.default_rng(4)
    units, k = 12, 4
    bigrams = rng.poisson(3, (units, units)).astype(float)
    np.fill_diagonal(bigrams, 0)
    of = rng.integers(0, k - 1, units)

    def table(of):
        m = np.eye(k)[of]
        return m.T @ bigrams @ m

    for u in range(units):
        ctx = np.concatenate([np.arange(units), units + np.arange(units)])
        n = np.concatenate([bigrams[:, u], bigrams[u]])
        row, cls, c = lm.by_class(ctx, np.array([2 * units]), n, of, units, k)
        some = c > 0
        new = lm.best_classes(of[[u]], row[some], cls[some], c[some], lm._sides(table(of)))[0]
        # The neighbours in a unit's own class move with it in the approximation; all others are exact.
        reached = [likelihood(table(np.where(np.arange(units) == u, g, of))) for g in range(k - 1)]
        assert reached[new] >= reached[of[u]] - 30


def test_rounds_class_words_beyond_the_head(spark, monkeypatch):
    """Words that share one spelling bucket and lie beyond the head and the table get classes by their contexts."""
    rnd = random.Random(3)
    kinds = [[f"{''.join(rnd.choice('bcdfg') for _ in range(6))}ing" for _ in range(60)] for _ in range(2)]
    rows = [(i, " ".join(x for _ in range(12) for x in (("the", rnd.choice(kinds[0])) if rnd.random() < 0.5 else ("of", rnd.choice(kinds[1]))))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for head, table in ((8, 1000), (1023, 10)):
        monkeypatch.setattr(lm, "HEAD_UNITS", head)
        model = fit_classes(docs, table_words=table)
        facts = word_facts(model)
        both = [Counter(facts(w)[1] for w in kind) for kind in kinds]
        assert sum((both[0] & both[1]).values()) <= 6, both


def test_class_count_rises_with_the_vocabulary():
    assert class_count(0) == CLASSES and CLASSES < class_count(10**6) < class_count(10**7)


def test_counts_beyond_32_bits_add_up():
    units, half = 4, 2**31 - 1
    rows = lambda u, ctx, n: list(lm._context_rows(False, np.array(u), None, np.array(ctx), np.array(n)))
    got = pa.Table.from_batches(lm.merge(iter([*rows([1, 1], [2, 5], [half, 3]), *rows([1], [2], [half]), *rows([1, 2], [2, 0], [half, 1])]), units)).to_pylist()
    assert [(r["u"], r["ctx"], r["n"]) for r in got] == [(1, [2, 5], [3 * half, 3]), (2, [0], [1])]


def test_scores_do_not_depend_on_partitions(spark, docs):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    found = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            rows = lm.score_texts(docs.repartition(int(parts)), fold_of("doc_id", 7) != 2).collect()
            found.append(sorted((r.doc_id, r.score) for r in rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert [i for i, _ in found[0]] == [i for i, _ in found[1]] and [s for _, s in found[0]] == pytest.approx([s for _, s in found[1]], rel=1e-9)
