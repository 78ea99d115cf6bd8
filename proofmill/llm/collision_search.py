"""Approximate nearest neighbours by collision-counting hashing (operator 13).

Largest inner products become nearest points: with M the largest norm, every
vector gets one more component that lifts its norm to M, and every query is
scaled to norm M; then a larger product is a smaller distance.

Each of `hashes` Gaussian projections of the points is an array sorted by
value.  A query opens in each array a window around its own value; at radius R
the window reaches `REACH` * R to both sides, and virtual rehashing widens R
level by level.  A window is found by binary search and is a range of places in
its array; which points lie in the windows is told by comparing places of two
bytes, for a run of queries at once.  A point in
a window is a collision; a point with enough collisions is verified by its
exact inner product.  A query stops in a block once as many verified points lie
within R as the block can hold of its k nearest (points are dealt at random, so
that number is binomial; all k where there is one block).  A point within R falls in a window with probability 2 * Phi(REACH) - 1; the
collisions asked for are the most that such a point reaches with probability
`recall`.  Beyond the last level all points left are verified, so no query ends
short.

Points are dealt to blocks of some thousands, each with its own arrays, and
queries to blocks of some hundreds; every query block meets every point block
by an equality join on their numbers, in units that each hold one point block
and a bounded run of query blocks.  A block returns its own k best of each
query, and the k best of these are the result: a task holds one pair of blocks,
whatever the tables' size or the copies of a vector.

Defined cases: a vector that is null, zero, of another length than `dims`, or
holds a null or non-finite component is neither query nor candidate; a query's
own row is any of its id, so repeated rows of an id never find each other, while
each of them is a query and a candidate of others; a null id is a candidate
only, last among equal scores; equal scores go by id; fewer candidates than k
are all returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm.common import bounded_batches
from proofmill.llm.vectors import usable

DIMS, EVERY, NEIGHBOURS = 64, 20, 20
HASHES, REACH, RECALL = 32, 0.8, 0.95
#: Radii as shares of the largest norm: from FIRST by GROWTH up to the largest distance, two norms.
FIRST, GROWTH = 0.5, 1.2
#: Chance that one block holds more of a query's nearest than it looks for.
MISS = 0.001
POINT_BLOCK, QUERY_BLOCK, UNIT_BLOCKS = 4096, 512, 64
#: Queries whose collisions are counted at once: their counts stay in a core's cache.
QUERY_RUN = 32
SEED = 20


def collisions_needed(hashes: int = HASHES, reach: float = REACH, recall: float = RECALL) -> int:
    """The most collisions that a point at the radius has with probability recall or more."""
    p = math.erf(reach / math.sqrt(2))
    tail = 0.0
    for c in range(hashes, 0, -1):
        tail += math.comb(hashes, c) * p**c * (1 - p) ** (hashes - c)
        if tail >= recall:
            return c
    return 1


def expected_here(k: int, blocks: int, miss: float = MISS) -> int:
    """How many of the k nearest lie in one of blocks at most, but for a chance of miss: points are dealt at random."""
    share, tail = 1 / blocks, 0.0
    for c in range(k, 0, -1):
        tail += math.comb(k, c) * share**c * (1 - share) ** (k - c)
        if tail > miss:
            return min(c + 1, k)
    return 1


def directions(dims: int, hashes: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dims + 1, hashes))


def sorted_arrays(x: np.ndarray, largest: float, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Projections of the lifted points, sorted, and whose they are: hashes x points."""
    lift = np.sqrt(np.maximum(largest**2 - (x * x).sum(1), 0.0))
    value = (x @ turn[:-1] + lift[:, None] * turn[-1]).T
    order = np.argsort(value, axis=1, kind="stable")
    return np.take_along_axis(value, order, 1), order


def ranks_of(order: np.ndarray) -> np.ndarray:
    """The place of each point in each sorted array, in as few bytes as hold it."""
    rank = np.empty(order.shape, np.uint16 if order.shape[1] < 1 << 16 else np.uint32)
    np.put_along_axis(rank, order, np.arange(order.shape[1], dtype=rank.dtype)[None], 1)
    return rank


def collisions(rank: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many of its windows left <= place < right hold each point: queries x points."""
    counts = np.zeros((len(left), rank.shape[1]), np.uint8 if len(rank) < 256 else np.uint16)
    left, width = left.astype(rank.dtype), (right - left).astype(rank.dtype)
    for i, places in enumerate(rank):
        counts += places[None] - left[:, i, None] < width[:, i, None]  # unsigned: a place before the window is far beyond it
    return counts


def search_block(
    value: np.ndarray, order: np.ndarray, x: np.ndarray, ids: np.ndarray, known: np.ndarray, queries: np.ndarray, query_ids: np.ndarray,
    largest: float, turn: np.ndarray, k: int, enough: int, needed: int, reach: float = REACH,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its number, its k best points found here and their scores, best first.

    A query stops once enough verified points lie within its radius.  known tells
    which ids are not null; a null id has the largest long in ids.
    """
    (hashes, n), rank = order.shape, ranks_of(order.astype(np.intp))
    norm = np.sqrt((queries * queries).sum(1))
    own = (queries * (largest / norm)[:, None]) @ turn[:-1]
    seen = (ids[None, :] == query_ids[:, None]) & known[None, :]
    found = [(np.empty(0, np.int64), np.empty(0))] * len(queries)
    active, radius = list(range(len(queries))), FIRST * largest
    while active:
        last = n <= k or radius >= 2 * largest
        if not last:
            left, right = np.empty((len(queries), hashes), np.intp), np.empty((len(queries), hashes), np.intp)
            for i in range(hashes):
                left[:, i] = np.searchsorted(value[i], own[:, i] - reach * radius, "left")
                right[:, i] = np.searchsorted(value[i], own[:, i] + reach * radius, "right")
        going = []
        # Windows that can't yet hold enough points with the collisions needed are left for a wider level.
        wide = None if last else (right - left).sum(1) >= needed * enough
        met = () if last else [q for q in active if wide[q]]
        runs = {q: (met[at : at + QUERY_RUN], i) for at in range(0, len(met), QUERY_RUN) for i, q in enumerate(met[at : at + QUERY_RUN])}
        for q in active:
            if not last and not wide[q]:
                going.append(q)
                continue
            if last:
                fresh = np.flatnonzero(~seen[q])
            else:
                run, i = runs[q]
                if i == 0:
                    enough_met = (collisions(rank, left[run], right[run]) >= needed) & ~seen[run]
                fresh = np.flatnonzero(enough_met[i])
            at, score = found[q]
            if len(fresh):
                seen[q, fresh] = True
                at, score = np.concatenate([at, fresh]), np.concatenate([score, np.einsum("ij,j->i", x[fresh], queries[q])])
                if len(at) > k:  # all that tie with the k-th stay until they are ordered by id
                    stay = score >= np.partition(score, len(score) - k)[len(score) - k]
                    at, score = at[stay], score[stay]
                found[q] = at, score
            within = (2 * largest**2 - radius**2) * norm[q] / (2 * largest)
            if last or np.count_nonzero(score >= within) >= enough:
                best = np.lexsort((ids[at], -score))[:k]
                yield q, at[best], score[best]
            else:
                going.append(q)
        active, radius = going, radius * GROWTH


def _packed(rows: DataFrame, number: str, dims: int, points: tuple[float, np.ndarray] | None) -> DataFrame:
    """One row for each block: its number, ids, vectors and, for points, the sorted arrays."""

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(block["v"].to_numpy()).astype(np.float64)
        known = block["_id"].notna().to_numpy()
        ids = block["_id"].fillna(np.iinfo(np.int64).max).to_numpy().astype(np.int64)
        out = {number: [block[number].iloc[0]], "ids": [ids.tobytes()], "known": [known.tobytes()], "x": [x.tobytes()]}
        if points:
            value, order = sorted_arrays(x, *points)
            out |= {"value": [value.tobytes()], "order": [order.astype(np.int32).tobytes()]}
        return pd.DataFrame(out)

    kinds = f"{number} int, ids binary, known binary, x binary" + ", value binary, order binary" * bool(points)
    return rows.groupBy(number).applyInPandas(pack, kinds)


def nearest(
    vectors: DataFrame, is_query: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
    k: int = NEIGHBOURS, dims: int = DIMS, hashes: int = HASHES, recall: float = RECALL, point_block: int = POINT_BLOCK, seed: int = SEED,
) -> DataFrame:
    """query_id, rank, the id column, score: the k largest inner products found for each query row.

    is_query defaults to ids divisible by EVERY; ids are whole numbers.
    """
    vector = F.col(f"`{vector_col}`")
    rows = vectors.filter(usable(vector, dims)).select(
        F.col(f"`{id_col}`").cast("long").alias("_id"), vector.alias("v"),
        F.coalesce(F.col(f"`{id_col}`") % EVERY == 0 if is_query is None else is_query, F.lit(False)).alias("asks"),
        F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("size"),
    ).filter("size > 0")
    seen = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("queries"), F.max("size").alias("size")).first()
    largest, turn = math.sqrt(seen.size or 1.0), directions(dims, hashes, seed)
    blocks, query_blocks = max(1, math.ceil(seen.n / point_block)), max(1, math.ceil(seen.queries / QUERY_BLOCK))
    units = math.ceil(query_blocks / UNIT_BLOCKS)
    bounded_batches(vectors.sparkSession)

    # Dealt by a seeded draw, not by content: copies of one vector or id spread over all blocks.
    deal = lambda n, salt: F.least(F.floor(F.rand(seed + salt) * n), F.lit(n - 1)).cast("int")
    points = _packed(rows.select("_id", "v", deal(blocks, 0).alias("b")), "b", dims, (largest, turn))
    points = points.withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(units - 1))))
    asked = _packed(rows.filter("asks").select("_id", "v", deal(query_blocks, 1).alias("q")), "q", dims, None)
    asked = asked.select("q", F.col("ids").alias("query_ids"), F.col("x").alias("queries"), F.floor(F.col("q") / UNIT_BLOCKS).cast("int").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    needed, enough = collisions_needed(hashes, REACH, recall), expected_here(k, blocks)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in range(batch.num_rows):
                raw = {c: batch.column(i)[pair].as_py() for i, c in enumerate(batch.schema.names)}
                ids, known = np.frombuffer(raw["ids"], np.int64), np.frombuffer(raw["known"], bool)
                query_ids, x = np.frombuffer(raw["query_ids"], np.int64), np.frombuffer(raw["x"]).reshape(-1, dims)
                value, order = np.frombuffer(raw["value"]).reshape(hashes, -1), np.frombuffer(raw["order"], np.int32).reshape(hashes, -1)
                got = list(search_block(value, order, x, ids, known, np.frombuffer(raw["queries"]).reshape(-1, dims), query_ids, largest, turn, k, enough, needed))
                of = np.concatenate([np.full(len(at), q) for q, at, _ in got])
                at = np.concatenate([at for _, at, _ in got])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(of), raw["q"], np.int32)), pa.array(of.astype(np.int32)), pa.array(query_ids[of]), pa.array(ids[at], mask=~known[at]), pa.array(np.concatenate([s for _, _, s in got]))],
                    names=["q", "place", "query_id", "_id", "score"],
                )

    # Spark's estimate doesn't know how often the query blocks are repeated: left to it, it may gather them all on the driver.
    pairs = points.hint("merge").join(asked, ["b", "u"]).select("ids", "known", "x", "value", "order", "q", "query_ids", "queries")
    best = pairs.mapInArrow(search, "q int, place int, query_id long, _id long, score double")
    # The limit by rank is applied in each task before the shuffle too.
    by = Window.partitionBy("q", "place").orderBy(F.col("score").desc(), F.col("_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("_id").alias(id_col), "score")
