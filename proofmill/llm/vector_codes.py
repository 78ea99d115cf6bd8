"""Vector code compression: product codebooks fitted by Yinyang Lloyd rounds (operator 11).

Vectors of integers are cut into equal parts; each part position has a codebook.
A round assigns every part to its nearest entry and moves each entry to the
floored mean of its parts.

Entries of a codebook are clustered once into groups.  Each part of a vector
keeps its code and one lower bound a group: no entry of the group, other than
its own, is nearer.  When entries have moved, a bound falls by the largest move
within its group; only groups whose fallen bound isn't clearly above the exact
distance to the own entry are scanned.  Bounds are floats kept on the safe
side, whereas every choice compares integer squared distances, then indexes,
so the codes are those of a full scan.

State (integers, codes, bounds) is written each round to the shared folder and
read once by the next; sums of entries are partial per task before they are
shuffled, and what the driver holds is the codebooks: parts x entries rows.

Defined cases: a vector that is null, of another length than `dims`, or holds a
null or non-finite component is left out; a component of magnitude above 16,384
is an error; repeated rows count each; rows with a null id come last among the
first entries; equal ids are ordered by their vectors; with fewer rows than
entries the codebook is as large as the rows; an empty table gives no rows;
equal distances go to the lower index, also between equal entries; null labels
are a label; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import bounded_batches
from proofmill.llm.vectors import Rounds, integers, lists, matrix, usable

DIMS, PARTS, ENTRIES, ROUNDS = 64, 16, 64, 2
#: Entries that a group of a codebook has on average, and the rounds that cluster entries into groups.
GROUP_ENTRIES, GROUP_ROUNDS = 10, 5
#: A bound counts only where it exceeds the distance by more than float error.
MARGIN = 1e-6


@dataclass
class Codebooks:
    """Integer entries (part, entry, position) and the fixed group of each entry."""

    entries: np.ndarray
    groups: np.ndarray

    @property
    def n_groups(self) -> int:
        return int(self.groups.max(initial=-1)) + 1

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def moved(self, sums: list) -> Codebooks:
        """Entries at the floored means of rows (part, entry, count, sums of components); entries without rows stay."""
        new = self.entries.copy()
        for part, entry, count, *total in sums:
            new[part, entry] = [t // count for t in total]
        return Codebooks(new, self.groups)

    def drift(self, before: Codebooks) -> np.ndarray:
        """The largest move of an entry within each group, by part."""
        move = np.sqrt(((self.entries - before.entries).astype(np.float64) ** 2).sum(2))
        return np.stack([[move[p][self.groups[p] == g].max(initial=0.0) for g in range(self.n_groups)] for p in range(len(move))])


def grouped(entries: np.ndarray) -> np.ndarray:
    """A group number for each entry of each part, by a few rounds of k-means over the entries alone."""
    parts, n, _ = entries.shape
    k = max(1, -(-n // GROUP_ENTRIES))
    out = np.zeros((parts, n), np.int64)
    for p in range(parts):
        x = entries[p].astype(np.float64)
        centres = x[np.linspace(0, n - 1, k).astype(int)]
        for _ in range(GROUP_ROUNDS):
            out[p] = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.stack([x[out[p] == g].mean(0) if (out[p] == g).any() else centres[g] for g in range(k)])
    return out


def assign_part(x: np.ndarray, entries: np.ndarray, groups: np.ndarray, code: np.ndarray | None, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes, bounds and squared distances of one part, and how many distances to entries were taken.

    x: rows x width of integers as floats; code: the entries before, or None in
    the first round; low: bounds by group, already fallen by the drift.
    """
    n, k = len(x), low.shape[1]
    own = (x * x).sum(1)
    low, taken = low.copy(), 0
    if code is None:
        best, at, scan = np.full(n, np.inf), np.full(n, len(entries)), np.ones((n, k), bool)
    else:
        at = code.copy()
        best = ((x - entries[at]) ** 2).sum(1)
        scan, taken = low <= np.sqrt(best)[:, None] * (1 + MARGIN) + MARGIN, n
    held, first, near = best.copy(), at.copy(), {}
    for g in range(k):
        mine, rows = np.flatnonzero(groups == g), np.flatnonzero(scan[:, g])
        if not len(mine):
            low[:, g] = np.inf
        elif len(rows):
            c = entries[mine]
            d = own[rows, None] - 2 * (x[rows] @ c.T) + (c * c).sum(1)  # integers below 2^53: exact
            taken += d.size
            near[g] = (mine, rows, d)
            i = d.argmin(1)  # of equal distances the first, thus the lowest index of the group
            got, e = d[np.arange(len(rows)), i], mine[i]
            better = (got < best[rows]) | ((got == best[rows]) & (e < at[rows]))
            best[rows[better]], at[rows[better]] = got[better], e[better]
    for g, (mine, rows, d) in near.items():  # the bound leaves out the own entry only
        low[rows, g] = np.sqrt(np.where(mine[None, :] == at[rows, None], np.inf, d).min(1)) * (1 - MARGIN)
    if code is not None:  # an entry that lost its rows is again one of its group
        left = np.flatnonzero(first != at)
        of = groups[first[left]]
        low[left, of] = np.minimum(low[left, of], np.sqrt(held[left]) * (1 - MARGIN))
    return at, low, best, taken


def assigned(rows: DataFrame, books: Codebooks, drift: np.ndarray | None) -> DataFrame:
    """rows with code, low and error as books have them now; drift is None in the first round, when there are no bounds."""
    parts, k, width = len(books.entries), books.n_groups, books.entries.shape[2]
    entries, groups, dims = books.entries.astype(np.float64), books.groups, parts * width
    keep = [c for c in rows.columns if c not in ("code", "low", "error")]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            x, n = matrix(got["v"], dims), batch.num_rows
            code = np.empty((n, parts), np.int32)
            low = np.zeros((n, parts, k)) if drift is None else np.maximum(matrix(got["low"], parts * k).reshape(n, parts, k) - drift, 0.0)
            before, error = None if drift is None else matrix(got["code"], parts, np.int64), np.zeros(n)
            for p in range(parts):
                at, low[:, p], best, _ = assign_part(x[:, p * width : (p + 1) * width], entries[p], groups[p], None if before is None else before[:, p], low[:, p])
                code[:, p], error = at, error + best
            yield pa.RecordBatch.from_arrays([*[got[c] for c in keep], lists(code, pa.int32()), lists(low.reshape(n, parts * k), pa.float64()), pa.array(error.astype(np.int64))], names=[*keep, "code", "low", "error"])

    return rows.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in keep], "code array<int>, low array<double>, error long"]))


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: list[str] | None = None,
    dims: int = DIMS, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, Codebooks]:
    """A row for each usable vector: _id, the columns of keep as _0, _1, ..., v (integers), code (indexes by part), error; and the final codebooks."""
    if dims % parts:
        raise ValueError("the parts must be equal")
    spark, width = vectors.sparkSession, dims // parts
    others = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep or [])]
    rows = vectors.filter(usable(F.col(f"`{vector_col}`"), dims)).select(F.col(f"`{id_col}`").alias("_id"), *others, integers(F.col(f"`{vector_col}`")).alias("v"))
    first = rows.select("_id", "v").orderBy(F.col("_id").asc_nulls_last(), "v").limit(entries).collect()
    start = np.array([r.v for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    books, drift, state = Codebooks(start, grouped(start) if len(first) else np.zeros((parts, 0), np.int64)), None, Rounds(spark)
    if not first:
        return rows.withColumns({"code": F.array().cast("array<int>"), "error": F.lit(0).cast("long")}), books
    for _ in range(rounds):
        rows = state.put(assigned(rows, books, drift))
        pieces = rows.select("v", F.posexplode("code").alias("part", "entry"))
        at = F.col("part") * width
        sums = pieces.groupBy("part", "entry").agg(F.count("*"), *[F.sum(F.col("v")[at + i]) for i in range(width)]).collect()
        before, books = books, books.moved([tuple(r) for r in sums])
        drift = books.drift(before)
    return state.put(assigned(rows, books, drift).drop("low")), books


def code_text(code: str = "code") -> F.Column:
    """Indexes in part order, two lower-case hex digits each."""
    return F.array_join(F.transform(code, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
