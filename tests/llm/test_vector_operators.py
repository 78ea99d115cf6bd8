"""Operators 11 to 13 against full scans, and on odd tables."""

import hashlib
import math

import numpy as np
import pytest

from proofmill.llm import centroids, collision_search, vector_codes
from proofmill.llm.queries import QUERIES

DIMS = 64


def unit(rng, n, spread=0.5):
    """Unit vectors around few directions, with copies."""
    x = rng.normal(size=(5, DIMS))[rng.integers(0, 5, n)] * spread + rng.normal(size=(n, DIMS))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[n // 2 : n // 2 + n // 5] = x[0]
    return x.astype(np.float32)


def frame(spark, rows):
    """rows: (vec_id, vector, label); columns that the operators use inside are there too."""
    return spark.createDataFrame([(i, v, y, "mine", "mine", "mine") for i, v, y in rows], "vec_id long, embedding array<float>, label int, cluster string, code string, _id string")


@pytest.fixture(scope="module")
def odd_rows():
    rng = np.random.default_rng(3)
    x = unit(rng, 300)
    rows = [(int(i), [float(c) for c in v], None if i % 7 == 0 else int(i % 4)) for i, v in zip(rng.permutation(300) - 20, x, strict=True)]
    rows += [rows[5], rows[5], (rows[6][0], rows[7][1], 2), (None, rows[8][1], None), (None, rows[9][1], 1)]
    bad = list(rows[0][1])
    rows += [(900, None, 1), (901, [], 1), (902, bad[:63], 1), (903, [*bad[:63], None], 1), (904, [*bad[:63], float("nan")], 1), (905, [*bad[:63], float("-inf")], 1), (None, None, None)]
    return rows


def kept(rows):
    return [(i, v, y) for i, v, y in rows if v is not None and len(v) == DIMS and all(c is not None and math.isfinite(c) for c in v)]


def ints(rows):
    return np.array([[math.floor(256 * np.float64(np.float32(c))) for c in v] for _, v, _ in rows], np.int64).reshape(-1, DIMS)


def by_id(rows):
    x = ints(rows)
    return sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, tuple(x[r])))


def lloyd(x, start, rounds):
    """Full scans, ties to the lower number; the squared distances of the last one."""
    c = start.copy()
    for r in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        at = d.argmin(1)
        if r < rounds:
            for k in range(len(c)):
                if (at == k).any():
                    c[k] = x[at == k].sum(0) // (at == k).sum()
    return at, d.min(1), c


def written(spark, tmp_path, df):
    df.write.parquet(f"file://{tmp_path}/embeddings.parquet")
    return f"file://{tmp_path}"


@pytest.mark.parametrize("count", [None, 30, 1])
def test_codes_equal_full_scans(spark, tmp_path, odd_rows, count):
    rows = odd_rows if count is None else odd_rows[:count]
    good, x = kept(rows), ints(kept(rows))
    first = by_id(good)[:64]
    codes, error, books = np.zeros((len(x), 16), int), np.zeros(len(x), int), []
    for p in range(16):
        part = x[:, 4 * p : 4 * p + 4]
        codes[:, p], d, c = lloyd(part, part[first], 2)
        error += d
        books.append(c)
    sha = hashlib.sha256(",".join(str(v) for c in books for v in c.ravel()).encode()).hexdigest()
    total = {}
    for (_, _, y), e in zip(good, error, strict=True):
        total[y] = total.get(y, 0) + e
    want = [(i, "".join(f"{k:02x}" for k in codes[r]), error[r], total[y], sha) for r, (i, _, y) in enumerate(good)]
    df = QUERIES["op11_vector_codes"](spark, written(spark, tmp_path, frame(spark, rows)))
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr((i, c, int(e), int(t), s)) for i, c, e, t, s in want)


def test_bounds_spare_scans_and_lose_nothing():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (20, 4))
    x = (centres[rng.integers(0, 20, 3000)] + rng.integers(-30, 30, (3000, 4))).astype(float)
    x[::9] = x[4]
    entries = x[:64].astype(np.int64)[None]
    books = vector_codes.Codebooks(entries, vector_codes.grouped(entries))
    assert (books.entries[0][0] == books.entries[0]).all(1).sum() >= 1
    code, low, full = None, np.zeros((3000, books.n_groups)), 0
    taken = 0
    for _ in range(6):
        now = books.entries[0].astype(float)
        code, low, best, n = vector_codes.assign_part(x, now, books.groups[0], code, low)
        d = ((x[:, None] - now[None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all() and (best == d.min(1)).all()
        others = np.where(np.arange(64)[None] == code[:, None], np.inf, d)
        for g in range(books.n_groups):
            assert (low[:, g] <= np.sqrt(others[:, books.groups[0] == g].min(1))).all()
        taken, full = taken + n, full + d.size
        new = books.moved([(0, int(k), int((code == k).sum()), *map(int, x[code == k].sum(0))) for k in np.unique(code)])
        low, books = np.maximum(low - new.drift(books)[0], 0), new
    assert taken < 0.7 * full


@pytest.mark.parametrize("count", [None, 20, 1])
def test_clusters_equal_full_scans(spark, tmp_path, odd_rows, count):
    rows = odd_rows if count is None else odd_rows[:count]
    good, x = kept(rows), ints(kept(rows))
    draw = lambda r: "~" if good[r][0] is None else hashlib.sha256(f"2:{good[r][0]}".encode()).hexdigest()
    first = sorted(range(len(good)), key=lambda r: (draw(r), tuple(x[r])))[:40]
    at, d, c = lloyd(x, x[first], 5)
    sha = [hashlib.sha256(",".join(map(str, k)).encode()).hexdigest() for k in c.tolist()]
    want = [(i, int(at[r]), int(d[r]), int(d[at == at[r]].sum()), int(d.sum()), sha[at[r]]) for r, (i, _, _) in enumerate(good)]
    df = QUERIES["op12_centroid_clusters"](spark, written(spark, tmp_path, frame(spark, rows)))
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want))


def test_annulus_spares_distances_and_keeps_ties():
    rng = np.random.default_rng(2)
    x = (rng.integers(-9, 9, (2000, 3)) * rng.integers(1, 400, (2000, 1))).astype(float)
    c = (rng.integers(-9, 9, (50, 3)) * rng.integers(1, 400, (50, 1))).astype(float)
    c[7] = c[30]
    c[11] = -c[12]
    x[::5] = 0
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    for before in (None, rng.integers(0, 50, 2000)):
        at, best, taken = centroids.nearest(x, c, before)
        assert (at == d.argmin(1)).all() and (best == d.min(1)).all() and taken < d.size


def exact(rows, k=20, every=20):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in kept(rows) if any(v)]
    for i, q in good:
        if i is not None and i % every == 0:
            all_ = [(float((x * q).sum()), j) for j, x in good if j != i]
            yield i, sorted(all_, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]


def test_search_of_few_rows_is_exact(spark, odd_rows):
    rows = [*odd_rows[:15], (0, odd_rows[3][1], 1), (5000, [0.0] * DIMS, 1), *odd_rows[-9:]]
    got = collision_search.nearest(frame(spark, rows), k=40).collect()
    want = [(i, rank, j, round(s, 12)) for i, found in exact(rows, k=40) for rank, (s, j) in enumerate(found, 1)]
    assert want and sorted(map(repr, ((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in got))) == sorted(map(repr, want))


def test_search_finds_the_nearest(spark, tmp_path, odd_rows):
    rng = np.random.default_rng(8)
    x = unit(rng, 3000, 0.8)
    x *= rng.uniform(0.2, 3, (len(x), 1)).astype(np.float32)
    x[1500:2100] = x[0]
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    df = frame(spark, rows)
    got = {}
    for r in collision_search.nearest(df, point_block=700).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for i, found in exact(rows):
        mine = sorted(got[i])
        assert [m[0] for m in mine] == list(range(1, 21)) and [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        for _, j, s in mine:
            assert j != i and s == pytest.approx(float(x[j].astype(float) @ x[i].astype(float)), abs=1e-12)
        hits, total = hits + len({m[1] for m in mine} & {j for _, j in found}), total + 20
    assert len(got) == 150 and hits >= 0.9 * total


def test_search_query_columns(spark, tmp_path, odd_rows):
    df = QUERIES["op13_nearest_vectors"](spark, written(spark, tmp_path, frame(spark, odd_rows)))
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    asked = {i for i, v, _ in kept(odd_rows) if i is not None and i % 20 == 0}
    assert {r.query_id for r in df.collect()} == asked


def test_collisions_needed_is_the_binomial_quantile():
    rng = np.random.default_rng(0)
    near = (np.abs(rng.normal(size=(20_000, 32))) <= 0.8).sum(1)
    c = collision_search.collisions_needed(32, 0.8, 0.95)
    assert (near >= c).mean() >= 0.94 and (near >= c + 1).mean() < 0.955
    assert collision_search.expected_here(20, 1) == 20 and collision_search.expected_here(20, 10**6) == 1


@pytest.mark.parametrize("n", [300, 70_000])
def test_collisions_are_the_points_in_the_windows(n):
    rng = np.random.default_rng(6)
    order = np.argsort(rng.normal(size=(5, n)), 1)
    left = rng.integers(0, n + 1, (7, 5))
    right = np.minimum(left + rng.integers(0, n, (7, 5)), n)
    left[0], right[0], left[1], right[1] = 0, n, n, n
    want = np.array([np.bincount(np.concatenate([order[i, left[q, i] : right[q, i]] for i in range(5)]), minlength=n) for q in range(7)])
    assert (collision_search.collisions(collision_search.ranks_of(order), left, right) == want).all()


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_centroid_clusters", "op13_nearest_vectors"])
def test_empty_tables(spark, tmp_path, name, odd_rows):
    assert QUERIES[name](spark, written(spark, tmp_path, frame(spark, odd_rows).limit(0))).count() == 0
    assert QUERIES[name](spark, written(spark, tmp_path / "bad", frame(spark, odd_rows[-7:]))).count() == 0


def test_components_too_large_are_an_error(spark):
    df = frame(spark, [(1, [20_000.0] * DIMS, 0)])
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(df)


def test_neighbours_broadcast_nothing(spark):
    from proofmill.llm.collision_search import nearest

    rows = spark.createDataFrame([(i, [float(i % 7 + j) for j in range(64)]) for i in range(60)], "vec_id long, embedding array<float>")
    plan = nearest(rows)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
