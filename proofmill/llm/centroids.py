"""Centroid clustering by annulus search (operator 12).

Lloyd's rounds over integer vectors.  Centroids are sorted by their norm.  A
vector's upper bound is its exact distance to its centroid of the round before,
or, where there is none or that is nearer, to the centroid next to it in norm.
By the triangle inequality a centroid at least as near has a norm within that
bound of the vector's own: two binary searches give the run of such centroids,
one unit wider than float error, and these alone are compared by their integer
squared distances and then by number, so that ties on the rim are kept.

The rows' state (integers, centroid) is written each round to the shared folder
and read once by the next; the sums of a centroid are partial per task before
they are shuffled, and the driver holds the centroids only.

Defined cases: a vector that is null, of another length than `dims`, or holds a
null or non-finite component is left out; a component of magnitude above 16,384
is an error; repeated rows count each, and each may be a first centroid; null
ids come last among first centroids; equal ids are ordered by their vectors;
with fewer rows than centroids there are as many as rows; an empty table gives
no rows; equal centroids: the lower number gets the rows, the other stays;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import bounded_batches
from proofmill.llm.vectors import Rounds, integers, matrix, usable

DIMS, CENTROIDS, ROUNDS, SALT = 64, 40, 5, "2:"
#: How far beyond its bound an annulus reaches, against float error in norms and roots.
RIM = 1e-3


def nearest(x: np.ndarray, centroids: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid and squared distance of each row of x, and how many distances were taken."""
    size = np.sqrt((centroids * centroids).sum(1))
    order = np.argsort(size, kind="stable")
    size = size[order]
    norm = np.sqrt((x * x).sum(1))
    at = order[np.minimum(np.searchsorted(size, norm), len(size) - 1)]
    best, taken = ((x - centroids[at]) ** 2).sum(1), len(x)
    if before is not None:
        d = ((x - centroids[before]) ** 2).sum(1)
        taken += len(x)
        nearer = (d < best) | ((d == best) & (before < at))
        best, at = np.where(nearer, d, best), np.where(nearer, before, at)
    reach = np.sqrt(best) + RIM
    lo, hi = np.searchsorted(size, norm - reach, "left"), np.searchsorted(size, norm + reach, "right")
    for j in range(int(lo.min(initial=len(size))), int(hi.max(initial=0))):
        rows = np.flatnonzero((lo <= j) & (j < hi))
        c = order[j]
        d = ((x[rows] - centroids[c]) ** 2).sum(1)
        taken += len(rows)
        better = rows[(d < best[rows]) | ((d == best[rows]) & (c < at[rows]))]
        best[better], at[better] = ((x[better] - centroids[c]) ** 2).sum(1), c
    return at, best, taken


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows with cluster and distance as the centroids are now; a column cluster of the round before narrows the search."""
    dims = centroids.shape[1]
    known = "cluster" in rows.columns
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    points = centroids.astype(np.float64)
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            at, best, _ = nearest(matrix(got["v"], dims), points, got["cluster"].to_numpy().astype(np.int64) if known else None)
            yield pa.RecordBatch.from_arrays([got["_id"], got["v"], pa.array(at.astype(np.int32)), pa.array(best.astype(np.int64))], names=["_id", "v", "cluster", "distance"])

    return rows.select("_id", "v", *["cluster"] * known).mapInArrow(run, f"_id {kinds['_id']}, v array<int>, cluster int, distance long")


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    dims: int = DIMS, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT,
) -> tuple[DataFrame, np.ndarray]:
    """A row for each usable vector: _id, v (integers), cluster, distance (squared); and the final centroids."""
    spark = vectors.sparkSession
    rows = vectors.filter(usable(F.col(f"`{vector_col}`"), dims)).select(F.col(f"`{id_col}`").alias("_id"), integers(F.col(f"`{vector_col}`")).alias("v"))
    draw = F.sha2(F.concat(F.lit(salt), F.col("_id").cast("string")).cast("binary"), 256)
    first = rows.select(draw.alias("draw"), "v").orderBy(F.col("draw").asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(len(first), dims)
    if not first:
        return rows.withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}), centroids
    state = Rounds(spark)
    for _ in range(rounds):
        rows = state.put(assigned(rows, centroids))
        for r in rows.groupBy("cluster").agg(F.count("*"), *[F.sum(F.col("v")[i]) for i in range(dims)]).collect():
            centroids[r[0]] = [total // r[1] for total in r[2:]]
    return state.put(assigned(rows, centroids)), centroids


def digests(centroids: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
