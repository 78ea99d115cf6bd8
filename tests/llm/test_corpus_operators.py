"""Operators that compare texts with each other or with the corpus, against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import proofmill.llm.near_duplicates as nd
import proofmill.llm.substring_dedup as sd
from proofmill.llm import textgrid as tg
from proofmill.llm import url_filter
from proofmill.llm.components import connected_components
from proofmill.llm.decontaminate import LEAST_EQUAL, MASKS, WINDOW, allowed, contaminated, drop_contaminated, masks_of
from proofmill.llm.mixing import mixing_weights, rake, sample_mix, sampling_scale
from proofmill.llm.near_duplicates import chance, drop_near_duplicates, near_duplicates, shortest_depth
from proofmill.llm.substring_dedup import deep_nodes, drop_repeats, remove_repeats
from proofmill.llm.url_filter import RULES, judge_urls, rule_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_repeats(corpus, size=13):
    words = {i: WORD.findall(t or "") for i, t in corpus}
    first = {}
    for i in sorted(words):
        for a in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][a : a + size]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for a in range(len(w) - size + 1):
            if first[tuple(w[a : a + size])] < i:
                gone[a : a + size] = [True] * size
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("partitions,batch", [("4", "10000"), ("23", "3")])
def test_substring_dedup(spark, docs, corpus, partitions, batch):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(before, (partitions, "false", batch)):
            spark.conf.set(k, v)
        got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in remove_repeats(docs, normalize=True).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {i: (a, b, c or "") for i, (a, b, c) in got.items()} == brute_repeats(corpus)


def test_substring_dedup_odd_rows(spark, no_docs):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(None, long), (None, long), (3, long), (3, "x " + long), (1, "y " + long), (2, None)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1))).collect()
    by = Counter((r.doc_id, r.text, r.n_removed) for r in got)
    assert by == Counter({(None, "", 30): 2, (3, "", 30): 1, (3, "x", 30): 1, (1, "y " + long, 0): 1, (2, None, 0): 1})
    assert remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("heavy", [2, 64])
def test_substring_dedup_splits_groups(spark, monkeypatch, heavy):
    """A run that a third of all documents hold fills batches of the census: its prefix group is split and settled across tasks."""
    monkeypatch.setattr(sd, "HEAVY", heavy)
    rnd = random.Random(8)
    passage = [f"p{i}" for i in range(30)]
    corpus = []
    for i in range(240):
        body = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(5, 30))]
        if i % 3 == 0:
            body[3:3] = passage
        if i % 7 == 0:
            body[1:1] = passage[8:21]
        if i % 5 == 0:
            body += [*passage[5:10], "end"]  # the anchor without the window
        corpus.append((i, " ".join(body)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(before, ("7", "false", "4")):
            spark.conf.set(k, v)
        docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(6)
        got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in remove_repeats(docs, normalize=True).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_repeats(corpus)


def test_deep_nodes_are_the_repeats_of_a_suffix_tree():
    rnd = np.random.default_rng(5)
    words = rnd.integers(0, 3, 400).astype(np.uint64)
    first, group = np.arange(380), rnd.integers(0, 2, 380)
    alive, node = deep_nodes(group, words, first, 6)
    keys = {}
    for i in range(380):
        keys.setdefault((group[i], tuple(words[i : i + 6])), set()).add(i)
    found = {}
    for i, n in zip(alive, node):
        found.setdefault(n, set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in keys.values() if len(v) > 1)


def test_substring_dedup_ids_and_columns(spark, corpus):
    docs = spark.createDataFrame([(f"k{i:03d}", t, 1, 2, 3) for i, t in corpus], "doc_id string, text string, n_words int, n_removed int, n_chars int")
    expected = brute_repeats(corpus)
    got = remove_repeats(docs, normalize=True)
    assert got.columns == ["doc_id", "text", "n_chars", "n_words", "n_removed"]
    assert {int(r.doc_id[1:]): (r.n_words, r.n_removed, r.text) for r in got.collect()} == expected
    left = drop_repeats(docs, chars_col="n_chars")
    assert left.columns == docs.columns
    rows = {int(r.doc_id[1:]): r for r in left.collect()}
    assert set(rows) == {i for i, (n, gone, _) in expected.items() if not gone or gone < n}
    assert all(r.n_words == 1 and r.n_chars == (len(r.text) if expected[i][1] else 3) for i, r in rows.items())


def brute_links(corpus):
    reps = {}
    for i, t in corpus:
        reps.setdefault(t or "", i)
    sets = {}
    for t, i in reps.items():
        w = WORD.findall(ascii_lower(t))
        sets[i] = {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()
    links = Counter()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (find(reps[t or ""]), reps[t or ""], links[reps[t or ""]]) for i, t in corpus}


def test_near_duplicates(spark, docs, corpus, no_docs):
    got = near_duplicates(docs).collect()
    assert {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in got} == brute_links(corpus)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.class_id for r in got}
    assert near_duplicates(no_docs).count() == 0 and drop_near_duplicates(no_docs).count() == 0


def test_near_duplicate_groups_in_blocks(spark, monkeypatch):
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(1000)}" for _ in range(200)]
    corpus = []
    for i in range(60):
        w = list(base)
        w[rnd.randrange(200)] = f"edit{i}"
        corpus.append((i, " ".join(w)))
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 7)
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    assert got == brute_links(corpus)


def test_near_duplicates_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (9, None), (8, "")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6 and {(r.class_id, r.n_copies) for r in got} == {(4, 4), (8, 2)}
    assert drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == 2


def test_shortest_depth_reaches_recall():
    d = shortest_depth(0.8, 40, 10, 0.9999)
    assert chance(0.8, d) >= 0.9999 > chance(0.8, d + 1) and d < 10


def test_paths_are_prefix_tries():
    """The order of paths is that of their values, and shared prefixes have the chance that similarity gives them."""
    a = np.array([0, 0b000001_000000, 63 << 54], np.uint64)
    assert nd.shared_prefix(a, np.array([0, 0b000001_000001, 62 << 54], np.uint64), 10).tolist() == [10, 9, 0]
    rnd = np.random.default_rng(3)
    sets = [(lambda own: (np.concatenate([own, rnd.integers(0, 1 << 62, 20)]), np.concatenate([own, rnd.integers(0, 1 << 62, 20)])))(rnd.integers(0, 1 << 62, 160)) for _ in range(150)]
    grams = np.concatenate([x for pair in sets for x in pair]).astype(np.uint64)
    found = nd.paths(tg.mix(grams), np.arange(0, len(grams) + 1, 180), 40, 10)
    depth = np.array([nd.shared_prefix(found[2 * i], found[2 * i + 1], 10).max() for i in range(150)])
    assert abs((depth >= 10).mean() - chance(0.8, 10)) < 0.05 and (depth >= shortest_depth()).all()


@pytest.mark.parametrize("batch,partitions", [(1000, 1), (3, 1), (4, 5)])
def test_links_join_every_node_at_every_depth(spark, batch, partitions):
    """Groups of the links of a depth are those of equal prefixes, whatever the batches and tasks; no text is far from the first."""
    rnd = random.Random(9)
    rows = [(i, [int("".join(f"{rnd.randrange(2):06b}" for _ in range(10)), 2) for _ in range(2)]) for i in range(120)]
    classes = spark.createDataFrame([(i, [p & ~((1 << 12) - 1) | rnd.randrange(1 << 12) for p in ps]) for i, ps in rows], "rep long, paths array<bigint>")
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(before, (str(batch), str(partitions), "false")):
            spark.conf.set(k, v)
        links = [(r.a, r.b, r.depth) for r in nd.forest_links(classes).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    paths = {r.rep: r.paths for r in classes.collect()}
    for depth in range(shortest_depth(), 11):
        def groups(pairs):
            of = {i: i for i in paths}
            for a, b in pairs:
                x, y = of[a], of[b]
                of = {i: min(x, y) if c in (x, y) else c for i, c in of.items()}
            return of
        same = [(a, b) for a in paths for b in paths if a < b and any(x >> 6 * (10 - depth) == y >> 6 * (10 - depth) for x, y in zip(paths[a], paths[b]))]
        assert groups(same) == groups([(a, b) for a, b, d in links if d >= depth]), depth


def test_prefixes_are_shortened_to_the_recall(spark):
    """Near copies that differ by a word keep long prefixes; copies close to the threshold need shorter ones."""
    rnd = random.Random(6)

    def links_of(edits):
        rows = []
        for i in range(60):
            base = [f"w{rnd.randrange(10**5)}" for _ in range(220)]
            other = list(base)
            for e in range(edits):
                other[10 + 22 * e] = "changed"
            rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
        _, classes = nd._classes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", nd.TREES, nd.DEEPEST)
        return nd.matched_depth(nd.forest_links(classes), classes)

    close, far = links_of(1), links_of(5)
    assert close[0] == nd.DEEPEST and close[1] >= nd.RECALL and shortest_depth() <= far[0] < nd.DEEPEST and far[1] >= 0.999


def test_every_link_counts_for_the_matched_depth(spark):
    path = [[7] * nd.TREES] * 2
    for first in range(0, 12, 2):
        classes = spark.createDataFrame([(first, path[0]), (first + 1, path[1])], "rep long, paths array<long>")
        depth, reached = nd.matched_depth(spark.createDataFrame([(first + 1, first, nd.DEEPEST)], "a long, b long, depth tinyint"), classes)
        assert depth == nd.DEEPEST and reached >= nd.RECALL


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + rnd.randrange(1, 50)) for _ in range(60)] + [(300, 301), (301, 300), (400, 400)]
    got = {r.v: r.c for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[301] == 300 and {got[v] for v in got if 100 <= v < 200} == {100} and 400 not in got


def brute_url(url, rules):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = ascii_lower(host)
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_url_filter(spark, seed, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARE_ROWS", 8)
    monkeypatch.setattr(url_filter, "SHARE_PER_BOUNDARY", 1)
    rnd = random.Random(seed)
    hosts, paths = ["a", "b.a", "c.b.a", "x.c.b.a", "b", ".a", "a.", "", "B.A", "bb.a", "a-b.a", "a.b.a"], ["", "/", "/x", "/x/", "/x/y", "/x/yy", "/xé", "/x/y/z", "/\U0010ffff"]
    rules = list({(h, p): (h, p, v) for h, p, v in ((rnd.choice(hosts).lower(), rnd.choice(paths), rnd.choice(["allow", "block"])) for _ in range(25))}.values())
    urls = [rnd.choice(["http://", "", "://"]) + rnd.choice(hosts) + rnd.choice(paths) + rnd.choice(["", "?q", "#f", "?a://b/c"]) for _ in range(300)] + [None, "http://a/\nx"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rule_table(spark, rules)).collect()}
    assert got == {i: brute_url(u, rules) for i, u in enumerate(urls)}


def test_url_filter_equal_rules(spark):
    rules = spark.createDataFrame([("a.org", "/x", "block"), ("a.org", "/x", "allow"), ("a.org", "/x", None), (None, "/", "block"), ("b.org", None, "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.org/x/y"), (2, "http://b.org/")], "page_id long, url string").withColumns({c: F.lit("mine") for c in ("host", "path", "verdict", "_host", "_path", "_id", "depth", "key")})
    assert {r.page_id: (r.rule, r.verdict) for r in judge_urls(pages, rules).collect()} == {1: ("a.org/x", "block"), 2: (None, "allow")}


def test_url_filter_empty_sides(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None)], "page_id long, url string")
    assert {r.verdict for r in judge_urls(pages, rule_table(spark).limit(0)).collect()} == {"allow"}
    assert [r.rule for r in judge_urls(pages, rule_table(spark)).orderBy("page_id").collect()] == [None, "org/", "org/"]
    assert judge_urls(pages.limit(0), rule_table(spark, RULES)).count() == 0


def brute_overlaps(docs, items):
    """Every alignment of every text with every item: {(id, item): (windows, most equal words)}."""
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    found = {}
    for d, text in docs:
        w = split(text)
        for item, text_ in items:
            x = split(text_)
            n = min(WINDOW, len(x))
            if not n:
                continue
            for shift in range(-len(x), len(w)):
                same = [0 <= k + shift < len(w) and w[k + shift] == x[k] for k in range(len(x))]
                for lo in range(max(0, -shift), min(len(x), len(w) - shift) - n + 1):
                    equal = sum(same[lo : lo + n])
                    if equal >= n - n * 2 // 13:
                        windows, most = found.setdefault((d, item), (set(), 0))
                        windows.add((lo, shift))
                        found[d, item] = windows, max(most, equal)
    return {k: (len(windows), most) for k, (windows, most) in found.items()}


def test_masks_are_complete():
    """Wherever words of a window are replaced, as many as may be, one mask lies on equal words."""
    for gone in itertools.combinations(range(WINDOW), WINDOW - LEAST_EQUAL):
        assert any(not any(bit == "1" and i + a in gone for i, bit in enumerate(m)) for m in MASKS for a in range(WINDOW - len(m) + 1)), gone
    for n in range(1, WINDOW):
        for gone in itertools.combinations(range(n), allowed(n)):
            assert any(len(m) == n and not any(m[i] == "1" for i in gone) for m in masks_of(n)), (n, gone)
    assert [allowed(n) for n in (1, 6, 7, 12, WINDOW)] == [0, 0, 1, 1, WINDOW - LEAST_EQUAL]


@pytest.mark.parametrize("broadcast_seeds", [500_000, 3])
def test_items_of_every_length(spark, monkeypatch, broadcast_seeds):
    import proofmill.llm.decontaminate as dc

    monkeypatch.setattr(dc, "BROADCAST_SEEDS", broadcast_seeds)
    rnd, rows = random.Random(3), []
    items = [(n, " ".join(f"k{n}x{i}" for i in range(n))) for n in range(1, 31)]
    for n, text in items:
        for gone in range(4):
            for turn in range(3):
                w = text.split()
                for i in rnd.sample(range(n), min(gone, n)):
                    w[i] = "other"
                rows.append((n * 100 + gone * 10 + turn, f"before it {' '.join(w)} after"))
        rows.append((n * 100 + 50, " ".join(text.split()[1:])))
    expected = brute_overlaps(rows, items)
    assert {d // 100 for d, _ in expected} == set(range(1, 31)) and (710, 7) in expected and (610, 6) not in expected and (1220, 12) not in expected
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id): (r.n_places, r.most_equal) for r in contaminated(docs, tests).collect()} == expected


@pytest.fixture
def test_set(corpus):
    rnd = random.Random(9)
    items = [(i, " ".join(f"T{rnd.randrange(300)}" for _ in range(n))) for i, n in enumerate((40, 30, 12, 5, 20, 4, 13))] + [(9, None), (10, ""), (None, " ".join(f"N{i}" for i in range(20)))]
    rows = list(corpus[:25])
    for d, (item, edits) in enumerate([(0, 0), (1, 2), (2, 0), (3, 0), (4, 1), (0, 9), (5, 0), (6, 2), (6, 3), (9, 1), (2, 1)], 100):
        w = items[item][1].split()
        for e in range(edits):
            w[(3 + e * 5) % len(w)] = f"other{e}"
        rows.append((d, "start of it " + " ".join(w).lower() + ", end."))
    # Every fifth word replaced, at every phase; an item twice under its id with the same and with another text.
    w = items[1][1].split()
    rows += [(200 + p, " ".join("gone" if i % 5 == p else x for i, x in enumerate(w))) for p in range(5)]
    items += [items[4], (4, " ".join(f"again{i}" for i in range(15)))]
    rows += [(300, " ".join(f"again{i}" for i in range(15))), (300, " ".join(f"again{i}" for i in range(15)))]
    return rows, items


@pytest.mark.parametrize("broadcast_seeds", [500_000, 3])
def test_decontamination(spark, test_set, monkeypatch, broadcast_seeds):
    import proofmill.llm.decontaminate as dc

    rows, items = test_set
    monkeypatch.setattr(dc, "BROADCAST_SEEDS", broadcast_seeds)
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = brute_overlaps(dict(rows).items(), items)
    hit = {d for d, _ in expected}
    assert hit >= {100, 101, 102, 103, 104, 106, 107, 109, 110, 200, 201, 202, 203, 204, 300} and 108 not in hit and (9, 4) not in expected
    got = {(r.doc_id, r.item_id): (r.n_places, r.most_equal) for r in contaminated(docs, tests).collect()}
    assert got == expected
    clashing = docs.withColumns({c: F.lit("mine") for c in ("seed", "no", "i", "j", "words", "_key", "_id", "item", "span", "_row", "_digest", "a.b")})
    clean = drop_contaminated(clashing, tests)
    assert clean.columns == clashing.columns and sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in rows if d not in hit)
    assert contaminated(docs.limit(0), tests).count() == 0 and contaminated(docs, tests.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast_seeds", [500_000, 3])
def test_decontamination_of_very_long_items(spark, monkeypatch, broadcast_seeds):
    import proofmill.llm.decontaminate as dc

    monkeypatch.setattr(dc, "BROADCAST_SEEDS", broadcast_seeds)
    rnd = random.Random(1)
    long = [f"v{rnd.randrange(10**6)}" for _ in range(20_000)]
    docs = spark.createDataFrame([(1, " ".join(long[7000:7050])), (None, " ".join(long[:13])), (3, " ".join(long[:12])), (4, " ".join(long))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_places, r.most_equal) for r in contaminated(docs, spark.createDataFrame([(None, " ".join(long)), (2, "x y z a b")], "item_id long, text string")).collect()}
    assert got == {(1, None): (38, 13), (None, None): (1, 13), (4, None): (19_988, 13)}


def test_mixing_meets_margins(spark, docs, corpus, no_docs):
    full = mixing_weights(docs).toPandas()
    assert len(full) == len(corpus) and (full.probability <= 1).all()
    tokens = {i: len(WORD.findall(t or "")) for i, t in corpus}
    assert all(full.set_index("doc_id").n_tokens[i] == n for i, n in tokens.items())
    for dim in ("source", "lang", "topic"):
        raw = full.groupby(dim).n_tokens.sum()
        goal = raw.where(raw > 0) ** 0.9
        goal = goal / goal.sum() * raw.sum()
        have = (full.n_tokens * full.weight).groupby(full[dim]).sum()
        assert np.allclose(have[goal.notna()], goal.dropna(), rtol=0.02), dim
    kept = sample_mix(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(full[full.sampled].doc_id)
    assert mixing_weights(no_docs).count() == 0 and sample_mix(no_docs).count() == 0


def test_mixing_given_targets(spark):
    rows = [(i, "one two three", "a" if i % 4 else "b", "en", 0) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    goal = spark.createDataFrame([("a", 6000.0), ("b", 6000.0)], "_source string, target double")
    kept = sample_mix(docs, {"source": F.col("source")}, targets={"source": goal}, share=0.5).groupBy("source").count().collect()
    counts = {r.source: r["count"] for r in kept}
    assert counts["b"] == 1000 and abs(counts["a"] - 1000) < 120


def test_sampling_meets_its_budget_whatever_the_rarest_cell(spark):
    """The expected tokens are the share asked for; a single rare cell with a huge weight is capped at one."""
    cells = spark.createDataFrame([(5000.0, 1.0), (3000.0, 0.7), (10.0, 900.0), (500.0, 2.5), (20.0, 0.0), (0.0, 3.0)], "mass double, weight double")
    rows = cells.collect()
    for share in (0.05, 0.3, 0.75, 0.99):
        scale = sampling_scale(cells, share)
        assert sum(r.mass * min(1, scale * r.weight) for r in rows) == pytest.approx(share * sum(r.mass for r in rows))
    assert sampling_scale(cells, 0.999) is None and sampling_scale(cells.limit(0), 0.5) is None


def test_raking_that_needs_many_sweeps(spark):
    """Cells that hang together by little converge slowly; what can't be met is said."""
    cells = spark.createDataFrame([("a", "x", 1000.0, 1.0), ("a", "y", 1.0, 1.0), ("b", "x", 1.0, 1.0), ("b", "y", 1000.0, 1.0)], "_s string, _l string, mass double, weight double")
    goals = {"s": spark.createDataFrame([("a", 1300.0), ("b", 702.0)], "_s string, target double"), "l": spark.createDataFrame([("x", 900.0), ("y", 1102.0)], "_l string, target double")}
    with pytest.warns(UserWarning, match="sweeps"):
        _, left = rake(cells, goals, sweeps=3)
    assert left > 1e-4
    done, left = rake(cells, goals, sweeps=200)
    have = {r._s: r.m for r in done.groupBy("_s").agg(F.sum(F.col("mass") * F.col("weight")).alias("m")).collect()}
    assert left <= 1e-4 and have["a"] == pytest.approx(1300, rel=1e-3)
    with pytest.warns(UserWarning):
        _, left = rake(cells.filter("_s = _l or mass > 10"), goals, sweeps=5)
    assert left > 0.1


def test_mixing_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 3}", "en", f"t{i % 2}") for i in range(200)], "doc_id long, text string, source string, lang string, topic string")
    odd = docs.withColumns({c: F.lit("mine") for c in ("probability", "_source", "_cell_source", "weight", "_row", "_draw", "residual", "mass", "_id", "n_tokens")})
    kept = sample_mix(odd)
    assert kept.columns == odd.columns and 0 < kept.count() < 200 and {r.probability for r in kept.collect()} == {"mine"}
    assert {r.topic for r in mixing_weights(odd).collect()} == {"t0", "t1"}


def test_kept_text_hash(docs, corpus):
    got = remove_repeats(docs, normalize=True).select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("h")).collect()
    expected = brute_repeats(corpus)
    assert all(r.h == hashlib.sha256(expected[r.doc_id][2].encode()).hexdigest() for r in got if expected[r.doc_id][0])


def test_raking_goes_on_until_it_meets_the_targets_or_rests(spark):
    cells = spark.createDataFrame([("a", "x", 100.0, 1.0), ("a", "y", 10.0, 1.0), ("b", "x", 10.0, 1.0), ("b", "y", 100.0, 1.0), ("c", "z", 50.0, 1.0)], "_s string, _l string, mass double, weight double")
    goal = lambda name, **values: spark.createDataFrame(list(values.items()), f"_{name} string, target double")
    done, left = rake(cells, {"s": goal("s", a=130.0, b=90.0, c=50.0), "l": goal("l", x=120.0, y=100.0, z=50.0)})
    have = {r._l: r.m for r in done.groupBy("_l").agg(F.sum(F.col("mass") * F.col("weight")).alias("m")).collect()}
    assert left <= 1e-4 and have == pytest.approx({"x": 120, "y": 100, "z": 50}, rel=1e-3)
    with pytest.warns(UserWarning, match="met its targets"):  # c and z are each other's only cell, and their targets differ
        _, left = rake(cells, {"s": goal("s", a=130.0, b=90.0, c=60.0), "l": goal("l", x=120.0, y=100.0, z=50.0)})
    assert left == pytest.approx(0.2, abs=0.01)
    assert rake(cells.limit(0), {"s": goal("s", a=1.0), "l": goal("l", x=1.0)})[1] == 0.0


def test_few_documents_that_repeat_one_prefix_are_dealt_out(spark):
    """Twelve documents say six words thousands of times: no task gets more than twice the mean of their suffixes, and the result is whole."""
    rows = [(i, f"start{i} " + "one two three four five six " * 4000 + f"end{i}") for i in range(12)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(before, ("8", "false")):
            spark.conf.set(k, v)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        packed = sd._packed(docs, "doc_id", "text").select("_k", "_o", "_blob")
        dealt = sd._suffixes(packed, sd._shared_prefixes(packed, sd.WINDOW, sd.ANCHOR), sd.WINDOW, sd.ANCHOR).repartition("h", "salt")
        sizes = [r.n for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).collect()]
        got = {r.doc_id: (r.n_words, r.n_removed) for r in remove_repeats(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(sizes) == 8 and max(sizes) <= 2 * sum(sizes) / 8
    assert got == {i: (24_002, 24_000 if i else 0) for i in range(12)}
