"""Quality classifier: random Fourier features and ridge, calibrated isotonically (operator 9).

A text becomes a few document statistics.  Random Fourier features approximate
a Gaussian kernel over the standardized statistics; each partition of the
labelled rows sums its part of the normal equations; their sum fits the ridge
weights.  An isotonic fit on labelled rows that the ridge fit didn't see turns
its output into a score from 0 to 1.

The fit may use at most `max_rows` labelled rows (taken by hash of the id, so
the same everywhere), and only the documents of these rows are measured for it;
scoring covers every row in one narrow map.

Defined cases: null and empty texts have the statistics of no words and get a
score; a very long text is measured whole; null ids and null labels are not
learned from; several labels of one id count as so many rows, also where they
differ, and repeated rows of documents likewise; repeated rows are scored alike;
an empty table gives no scores; without labelled rows every score is 0.5; other columns are ignored by
`score` and passed through by `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.llm import textgrid as tg
from proofmill.llm.common import bounded_batches, map_slices, written

FEATURES = 256
WIDTH = 4.0
RIDGE = 1e-3
MAX_ROWS = 200_000
SUM_PARTITIONS = 8
BINS = 512

_CLASS = np.zeros(256, np.uint8)
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b"|", b"!?", b".,;:"), 1):
    _CLASS[list(_set)] = _i
STATISTICS = 17


def statistics(s: tg.Slice) -> np.ndarray:
    """A row of STATISTICS numbers for each text of the slice."""
    n, data, off = s.rows, s.data, s.offsets
    w = tg.words(s)
    per = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    inside = per(~tg.SPACE[data] & ((data & 0xC0) != 0x80))
    of = lambda c: c[off[1:]] - c[off[:-1]]
    chars = np.maximum(of(inside), 1).astype(float)
    n_words = np.diff(w.bounds).astype(float)
    some = np.maximum(n_words, 1)
    kinds = _CLASS[data]
    shares = [of(per(kinds == i)) / chars for i in range(1, 7)]
    wide = of(per(data >= 0xC0)) / chars
    by_row = lambda x: np.bincount(w.row, x, n)
    length = (inside[w.ends] - inside[w.starts]).astype(float)
    mean = by_row(length) / some
    spread = np.sqrt(np.maximum(by_row(length**2) / some - mean**2, 0))
    code = tg.mix(np.arange(1, n + 1, dtype=np.uint64))
    hashes = tg.segment_hash(tg.LOWER[data], w.starts, w.ends)

    def fresh(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How many different keys each row has."""
        _, at = np.unique(keys ^ code[rows], return_index=True)
        return np.bincount(rows[at], minlength=n).astype(float)

    k3, ok = tg.window_hash(hashes, 3), tg.window_valid(w.row, 3)
    at = np.flatnonzero(ok)
    grams = np.bincount(w.row[at], minlength=n)
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (w.row[1:] == w.row[:-1])
    newline = np.zeros(256, bool)
    newline[10] = True
    lines = tg.words(s, newline)
    n_lines = np.maximum(np.diff(lines.bounds), 1)
    return np.column_stack([
        np.log1p(n_words), mean, np.log1p(spread), *shares, wide,
        fresh(hashes, w.row) / some, fresh(k3[at], w.row[at]) / np.maximum(grams, 1), by_row(same) / some,
        by_row(length <= 3) / some, by_row(kinds[w.starts] == 1) / some, np.log1p(n_words / n_lines),
        fresh(tg.segment_hash(data, lines.starts, lines.ends), lines.row) / n_lines,
    ])


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing fit of y on sorted x by pooling neighbours that are out of order: block centres and values."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, weight, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            top = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], top, strict=True)]
    sums = np.array(blocks)
    return sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]


@dataclass
class QualityModel:
    """What a fit keeps: some tens of kilobytes, whatever the corpus."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]
    width: float
    seed: int

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Cosine features of the standardized statistics and a constant one."""
        draw = np.random.default_rng(self.seed)
        d = len(self.weights) - 1
        turn, shift = draw.normal(0, 1 / self.width, (STATISTICS, d)), draw.uniform(0, 2 * np.pi, d)
        z = np.clip((stats - self.centre) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2 / d) * np.cos(z @ turn + shift), np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def probability(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.steps), 0, 1)

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """id and score of every row."""
        kind = docs.schema[id_col].dataType.simpleString()
        return map_slices(docs, text_col, [id_col], lambda s, rows: [rows.column(0), pa.array(self.probability(statistics(s)))], f"{id_col} {kind}, score double")

    def keep(self, docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
        """The rows of docs, all columns as they are, whose score is least or more."""
        bounded_batches(docs.sparkSession)
        at = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in tg.text_slices(batch.column(at)):
                    yield batch.slice(part.lo, part.rows).filter(pa.array(self.probability(statistics(part)) >= least))

        return docs.mapInArrow(run, docs.schema)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_ROWS,
    seed: int = 7,
) -> QualityModel:
    """Fit on the labelled rows for which `learn` (of the id) holds, at most about max_rows of them."""
    chosen = labels.filter(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
    n = chosen.count()
    if n > max_rows:
        chosen = chosen.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))
    # The labelled rows are at most about max_rows ids and numbers, so they are broadcast: only their documents are measured.
    known = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_t")).join(F.broadcast(chosen), F.col("_d") == F.col("_id")).select("_id", "_y", "_t")
    kinds = dict(known.dtypes)
    stats = map_slices(known, "_t", ["_id", "_y"], lambda s, rows: [*rows.columns, pa.array([r.tobytes() for r in statistics(s).astype(np.float32)], pa.binary())], f"_id {kinds['_id']}, _y double, _stats binary")
    sample = written(stats.withColumn("_held", F.pmod(F.xxhash64("_id", F.lit("calibrate")), F.lit(5)) == 0).repartition(SUM_PARTITIONS))

    def table(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        raw = b"".join(x.as_py() for x in batch.column("_stats"))
        return np.frombuffer(raw, np.float32).reshape(-1, STATISTICS).astype(float), batch.column("_y").to_numpy(zero_copy_only=False)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, STATISTICS))
        for batch in batches:
            x, _ = table(batch)
            total += [np.full(STATISTICS, len(x)), x.sum(0), (x**2).sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def summed(df: DataFrame, fn) -> np.ndarray:
        return sum((np.frombuffer(r.part) for r in df.mapInArrow(fn, "part binary").collect()), np.zeros(1))

    total = summed(sample, moments)
    if len(total) == 1 or total[0] == 0:
        return QualityModel(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(2), (np.array([0.0, 1.0]), np.array([0.5, 0.5])), WIDTH, seed)
    count, first, second = total.reshape(3, STATISTICS)
    centre = first / count
    scale = np.sqrt(np.maximum(second / count - centre**2, 1e-8))
    model = QualityModel(centre, scale, np.zeros(FEATURES + 1), (np.array([0.0, 1.0]), np.array([0.0, 1.0])), WIDTH, seed)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = FEATURES + 1
        total = np.zeros((size, size + 1))
        for batch in batches:
            x, y = table(batch)
            z = model.features(x)
            total[:, :size] += z.T @ z
            total[:, size] += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    sums = summed(sample.filter("not _held"), normal).reshape(FEATURES + 1, FEATURES + 2)
    model.weights = np.linalg.solve(sums[:, :-1] + RIDGE * max(1.0, sums[-1, -2]) / FEATURES * np.eye(FEATURES + 1), sums[:, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, BINS))
        for batch in batches:
            x, y = table(batch)
            raw = model.raw(x)
            bin_ = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            total += [np.bincount(bin_, w, BINS) for w in (np.ones(len(y)), y, raw)]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    for held in ("_held", "true"):
        weight, good, raw = summed(sample.filter(held), binned).reshape(3, BINS)
        seen = weight > 0
        if seen.any():
            model.steps = isotonic(raw[seen] / weight[seen], good[seen] / weight[seen], weight[seen])
            break
    return model
