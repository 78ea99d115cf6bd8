"""Pairs of groups that share entities, counted: J12, A09.

Groups are numbered, and each entity is a row with the numbers of its groups.
A task makes the pairs of its entities as longs and counts equal ones before
anything is shuffled; what it found so far goes on as packed pieces, one for
each share of all pairs.  A share is a range of a mixed form of the pair, so that
no group, however common, makes one share larger than others, and there are as
many shares as keep one small.  An entity of very many groups is dealt out in
parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.folders import written
from proofmill.operators.windows import global_rank

#: Pairs that a task holds before it counts them, pairs of a share on average before any are counted, pairs of a map task, rows of a batch.
HELD, SHARE, TASK, ROWS = 1 << 23, 1 << 22, 1 << 25, 1 << 16
#: Bytes of group names up to which they are broadcast.
NAMES_BYTES = 16 << 20
#: Odd, so that multiplying by it modulo 2^64 can be undone.
_MIX = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_MIX, -1, 1 << 64))


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each is there."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.intp)
    return keys[first], np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first) if len(keys) else counts


def pairs_of(values: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Mixed pairs of each value with the `after` values that follow it; values are ascending within an entity."""
    ends = np.cumsum(after)
    other = np.arange(ends[-1]) - np.repeat(ends - after - np.arange(1, len(after) + 1), after)
    return ((np.repeat(values, after) << np.uint64(32)) | values[other]) * np.uint64(_MIX)


def _runs(after: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of positions with at most `most` pairs in all, or one position."""
    ends, at = np.cumsum(after), 0
    while at < len(after):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _pieces(keys: np.ndarray, counts: np.ndarray, shares: int) -> Iterator[pa.RecordBatch]:
    edges = np.searchsorted(((keys >> np.uint64(32)) * np.uint64(shares)) >> np.uint64(32), np.arange(shares + 1))
    small = counts.astype(np.min_scalar_type(int(counts.max())))
    for lo in range(0, shares, 64):
        some = [s for s in range(lo, min(lo + 64, shares)) if edges[s] < edges[s + 1]]
        if some:
            parts = [slice(edges[s], edges[s + 1]) for s in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([keys[p].tobytes() for p in parts], pa.binary()), pa.array([small[p].tobytes() for p in parts], pa.binary())], names=["share", "keys", "counts"])


def pair_counts(own: DataFrame) -> DataFrame:
    """a, b, common: for each pair a < b of values of `a` that some `_e` has both of, how many have.

    own has distinct rows (_e, a), a not null, and is read several times: written rows serve best.
    """
    spark = own.sparkSession
    names = written(global_rank(own.select("a").distinct(), ["a"], "_n").select("a", (F.col("_n") - 1).alias("_n")))
    numbered = own.join(names.withColumnRenamed("a", "_name"), F.col("a") == F.col("_name")).select("_e", "_n")
    n = F.size("ids").cast("long")
    sets = written(numbered.groupBy("_e").agg(F.collect_list("_n").alias("ids")).select("ids").filter(n > 1).withColumn("parts", F.ceil(n * (n - 1) / 2 / F.lit(HELD)).cast("int")))
    total = sets.agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    shares = max(1, math.ceil(total / SHARE))
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(total / TASK))
    dealt = sets.select("ids", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).repartition(tasks)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, parts, part = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            flat, sizes = ids.flatten().to_numpy().astype(np.uint64), np.diff(ids.offsets.to_numpy())
            owner, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
            flat = flat[np.lexsort((flat, owner))]
            place = np.arange(len(flat)) - starts[owner]
            after = np.where(place % parts[owner] == part[owner], sizes[owner] - place - 1, 0)
            for lo, hi in _runs(after, HELD):
                own_pairs = int(after[lo:hi].sum())
                if held and size + own_pairs > HELD:
                    yield from _pieces(*counted(np.concatenate(held)), shares)
                    held, size = [], 0
                if own_pairs:
                    # An entity's values reach beyond the run where it is cut inside the entity.
                    reach = starts[owner[hi - 1]] + sizes[owner[hi - 1]]
                    held.append(pairs_of(flat[lo:reach], np.append(after[lo:hi], np.zeros(reach - hi, after.dtype))))
                    size += own_pairs
        if held:
            yield from _pieces(*counted(np.concatenate(held)), shares)

    def summed(table: pa.Table) -> pa.Table:
        keys, counts = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()], []
        for k, c in zip(keys, table.column("counts").to_pylist(), strict=True):
            counts.append(np.frombuffer(c, f"u{len(c) // len(k)}").astype(np.int64))
        keys, counts = counted(np.concatenate(keys), np.concatenate(counts))
        keys = keys * _BACK
        return pa.table({"x": (keys >> np.uint64(32)).astype(np.int64), "y": (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), "common": counts})

    found = dealt.mapInArrow(pairs, "share int, keys binary, counts binary")
    # Shares are equal; a number given to repartition keeps Spark from joining what looks small.
    found = found.repartition(max(spark.sparkContext.defaultParallelism, min(shares, 20_000)), "share").groupBy("share").applyInArrow(summed, "x long, y long, common long")
    few = (names.agg(F.sum(F.length(F.col("a").cast("string")) + 16)).first()[0] or 0) <= NAMES_BYTES
    for number, name in (("x", "a"), ("y", "b")):
        side = names.select(F.col("a").alias(name), F.col("_n").alias(f"_{name}"))
        found = found.join(F.broadcast(side) if few else side, F.col(number) == F.col(f"_{name}"))
    return found.select("a", "b", "common")
