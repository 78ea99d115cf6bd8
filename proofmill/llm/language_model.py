"""LM scoring: a Brown class-based bigram model with exchange clustering (operator 1).

Units of the clustering are the most frequent words (TABLE_WORDS at most, in a
broadcast table), SPELLING_UNITS buckets of the last bytes of all other words,
and the text boundary.  One pass over the training texts gathers each unit's
sparse counts of the units before and after it (`contexts`), merged by a shuffle
on the unit; the exchange rounds then only read that table:

1. the HEAD_UNITS most frequent units are clustered on the driver from their own
   bigrams, a matrix of fixed size (`exchange`);
2. every other unit enters the class where the likelihood rises most;
3. in ROUNDS rounds half of the units in turn move to their best class by the
   class bigrams of the round, the same for all, so that the outcome doesn't
   depend on how units are dealt to tasks.  The likelihood is summed anew after
   each round; a round that lowers it is taken back and the next moves fewer.

Words beyond the table have contexts of their own in the same pass.  Each that
was seen FLOOR times or more takes its best class by them, however many there
are; words seen less often, or never, take the class of their spelling bucket.
The number of classes rises with the vocabulary (`class_count`).

P(word | before) = P(class | history class) x P(word | class).  The history
class of a word is its class, and that of its spelling bucket for a word beyond
the table.  Transitions are interpolated with the class unigram.  A class keeps
mass for words never seen: that of its words seen once and one more, shared out
over an estimate of the number of such words, so emissions sum to one.

Words beyond the table are joined to their count and class by a shuffle on
their hash; none of them can be hot.  Words are compared by 64-bit hashes.

Defined cases: null and empty texts hold only the end token; a null id counts
as the empty text for the fold and stays null; a very long text is counted and
scored whole; of equally frequent words all or none are in the table, ranked
by their hashes; repeated rows are learned from
and scored each; other columns are ignored; an empty table gives an empty
result; without training rows every word is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.llm import textgrid as tg
from proofmill.llm.common import bounded_batches, longs, map_slices, shared_folder, written

#: Most words of the broadcast table: 16 bytes each, 4 MB.
TABLE_WORDS = 262_144
#: Units that the driver clusters at the start.
HEAD_UNITS = 1023
SPELLING_UNITS = 256
#: Times a word beyond the table must be seen to have a class by its own contexts.
FLOOR = 2
#: Least number of classes.
CLASSES = 8
SWEEPS = 4
ROUNDS = 4
#: Weight of the class unigram in the class transitions, in tokens.
BACK_OFF = 50.0
#: Bigrams that a task holds before it sends them.
BUFFER = 1 << 22
ROWS = 1 << 14


@dataclass
class FrequentWords:
    """Hashes in ascending order with their training counts and ranks by count."""

    hashes: np.ndarray
    counts: np.ndarray
    ranks: np.ndarray

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each hash and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


def class_count(n_words: int) -> int:
    """Classes for so many words: 57 for 186,000, 311 for 30 million."""
    return max(CLASSES, int(np.ceil(np.cbrt(n_words))))


def _lowered(s: tg.Slice) -> tg.Slice:
    return tg.Slice(s.lo, s.hi, tg.LOWER[s.data], s.offsets)


def _spelling(data: np.ndarray, w: tg.Words) -> np.ndarray:
    """Bucket of a word's last two bytes and whether it is long: a cheap stand-in for its ending."""
    last = data[w.ends - 1].astype(np.uint64)
    before = data[np.maximum(w.ends - 2, w.starts)].astype(np.uint64)
    long_ = (w.ends - w.starts > 8).astype(np.uint64)
    return (tg.mix(last | before << np.uint64(8) | long_ << np.uint64(16)) % np.uint64(SPELLING_UNITS)).astype(np.int64)


def _h(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def likelihood(table: np.ndarray) -> float:
    """Class-bigram log-likelihood, without the part that no class changes."""
    return float(_h(table).sum() - _h(table.sum(0)).sum() - _h(table.sum(1)).sum())


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit by exchange clustering of a unit-bigram matrix; the last unit, the edge, keeps a class of its own.

    A unit moves to the class where the class-bigram log-likelihood
    sum n(c,d) log n(c,d) - sum n(c) log n(c) - sum n(d) log n(d) is highest.
    """
    n_units = len(bigrams)
    weight = bigrams.sum(0) + bigrams.sum(1)
    of = np.empty(n_units, np.int64)
    of[np.argsort(-weight[:-1], kind="stable")] = np.arange(n_units - 1) % (classes - 1)
    of[-1] = classes - 1
    member = np.zeros((n_units, classes))
    member[np.arange(n_units), of] = 1
    right, left = bigrams @ member, member.T @ bigrams
    table = member.T @ right
    for _ in range(sweeps):
        moved = 0
        for u in np.argsort(-weight[:-1], kind="stable"):
            if not weight[u]:
                break
            old, self_ = of[u], bigrams[u, u]
            r, c = right[u].copy(), left[:, u].copy()
            r[old] -= self_
            c[old] -= self_
            table[old] -= right[u]
            table[:, old] -= left[:, u]
            table[old, old] += self_
            rows, cols = table.sum(1), table.sum(0)
            # Gain of adding the unit to each class g, the rest unchanged.
            gain = (_h(table + r) - _h(table)).sum(1) + (_h(table + c[:, None]) - _h(table)).sum(0)
            d = np.diagonal(table)
            gain += _h(d + r + c + self_) - _h(d + r) - _h(d + c) + _h(d)
            gain -= _h(rows + r.sum() + self_) - _h(rows) + _h(cols + c.sum() + self_) - _h(cols)
            gain[classes - 1] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            of[u] = new
            table[new] += r
            table[:, new] += c
            table[new, new] += self_
            if new != old:
                moved += 1
                right[:, old] -= bigrams[:, u]
                right[:, new] += bigrams[:, u]
                left[old] -= bigrams[u]
                left[new] += bigrams[u]
        if not moved:
            break
    return of


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column in a row and the length of each list; null counts as empty."""
    return column.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _as_lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])


def _with_edges(codes: np.ndarray, w: tg.Words, rows: int, edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Previous and next code of every transition (each text starts after and ends with the edge); where each word's own is."""
    full = np.full(len(codes) + rows, edge, np.int64)
    place = np.arange(len(codes)) + w.row
    full[place] = codes
    return np.concatenate([[edge], full[:-1]])[: len(full)], full, place


def _codes(t: FrequentWords, s: tg.Slice) -> tuple[tg.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a lower-cased slice: hashes, spelling, unit of each, place in the table, whether it is there."""
    w = tg.words(s)
    hashes, spelling = tg.segment_hash(s.data, w.starts, w.ends), _spelling(s.data, w)
    at, known = t.find(hashes)
    units = len(t.hashes) + spelling
    units[known] = t.ranks[at[known]]
    return w, hashes, spelling, units, at, known


#: What a task sends (its counts end at BUFFER), and the same with the counts of all tasks added up.
PARTIAL = "rare boolean, u bigint, spelling int, ctx array<int>, n array<int>"
CONTEXTS = PARTIAL.replace("n array<int>", "n array<bigint>")


def _context_rows(rare: bool, u: np.ndarray, spelling: np.ndarray | None, ctx: np.ndarray, n: np.ndarray, kind: type = np.int32) -> Iterator[pa.RecordBatch]:
    """Rows of PARTIAL, or with 64-bit counts of CONTEXTS, from entries sorted by u."""
    start = _runs(u)
    ends = np.append(start[1:], len(u))
    for lo in range(0, len(start), ROWS):
        a, z = start[lo : lo + ROWS], ends[lo : lo + ROWS]
        part = slice(a[0], z[-1])
        own = np.zeros(len(a), np.int32) if spelling is None else spelling[a].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), rare)), longs(u[a]), pa.array(own), _as_lists(ctx[part].astype(np.int32), z - a), _as_lists(n[part].astype(kind), z - a)], names=["rare", "u", "spelling", "ctx", "n"])


def merge(batches: Iterator[pa.RecordBatch], units: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by word: entries of one word are added up; the last word waits for the next batch."""
    waiting: tuple[np.ndarray, ...] | None = None

    def added(rare: np.ndarray, u: np.ndarray, spelling: np.ndarray, ctx: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        group = np.cumsum(np.concatenate([[0], (u[1:] != u[:-1]) | (rare[1:] != rare[:-1])])[: len(u)])
        key = group * (2 * units) + ctx
        order = np.argsort(key, kind="stable")
        start = _runs(key[order])
        first = order[start]
        return rare[first], u[first], spelling[first], ctx[first], np.add.reduceat(n[order], start)

    def out(rare: np.ndarray, u: np.ndarray, spelling: np.ndarray, ctx: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for kind in (False, True):
            of = rare == kind
            if of.any():
                yield from _context_rows(kind, u[of], spelling[of], ctx[of], n[of], np.int64)

    for b in batches:
        if not b.num_rows:
            continue
        (ctx, length), (n, _) = _lists(b.column(3)), _lists(b.column(4))
        row = np.repeat(np.arange(len(length)), length)
        now = (b.column(0).to_numpy(zero_copy_only=False)[row], b.column(1).to_numpy()[row], b.column(2).to_numpy()[row], ctx.astype(np.int64), n.astype(np.int64))
        if waiting is not None:
            now = tuple(np.concatenate([x, y]) for x, y in zip(waiting, now, strict=True))
        done = added(*now)
        last = (done[1] == done[1][-1]) & (done[0] == done[0][-1])
        waiting = tuple(x[last] for x in done)
        if not last.all():
            yield from out(*(x[~last] for x in done))
    if waiting is not None:
        yield from out(*waiting)


def contexts(train: DataFrame, text_col: str, shared, units: int) -> DataFrame:
    """For each unit, and each word beyond the table by its hash (`rare`): the units before it (ctx) and after it (ctx - units) with counts n."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, others, held = [], [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            both, times = np.unique(np.concatenate(pairs), return_counts=True)
            a, b = both // units, both % units
            yield from _context_rows(False, a, None, b + units, times)
            order = np.argsort(b, kind="stable")
            yield from _context_rows(False, b[order], None, a[order], times[order])
            h, spelling, before, after = (np.concatenate(x) for x in zip(*others, strict=True))
            order = np.repeat(np.argsort(h, kind="stable"), 2)
            ctx = np.where(np.arange(len(order)) % 2 == 0, before[order], after[order] + units)
            yield from _context_rows(True, h[order], spelling[order], ctx, np.ones(len(ctx), np.int32))

        for batch in batches:
            for s in tg.text_slices(batch.column(0)):
                w, hashes, spelling, code, _, known = _codes(shared.value, _lowered(s))
                before, after, place = _with_edges(code, w, s.rows, units - 1)
                pairs.append(before * units + after)
                rest = np.flatnonzero(~known)
                at = place[rest]
                others.append((hashes[rest].view(np.int64), spelling[rest], before[at], after[at + 1]))
                held += len(after)
                if held > BUFFER:
                    yield from sent()
                    pairs, others, held = [], [], 0
        if pairs:
            yield from sent()

    spark = train.sparkSession
    bounded_batches(spark)
    met = train.select(text_col).mapInArrow(gather, PARTIAL).repartition("rare", "u").sortWithinPartitions("rare", "u").mapInArrow(lambda batches: merge(batches, units), CONTEXTS)
    at = shared_folder(spark)
    met.write.partitionBy("rare").parquet(at)
    return spark.read.schema(CONTEXTS).parquet(at)


def by_class(ctx: np.ndarray, length: np.ndarray, n: np.ndarray, of: np.ndarray, units: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries added up by row and class of the unit: row, class (of a unit after the word: `classes` higher), count; units without a class are left out."""
    row, cls = np.repeat(np.arange(len(length)), length), of[ctx % units]
    have = cls >= 0
    key = row[have] * (2 * classes) + cls[have] + (ctx[have] >= units) * classes
    order = np.argsort(key, kind="stable")
    start = _runs(key[order])
    key = key[order[start]]
    return key // (2 * classes), key % (2 * classes), np.add.reduceat(n[have][order], start).astype(np.float64) if len(start) else np.zeros(0)


def best_classes(cls: np.ndarray, row: np.ndarray, ctx: np.ndarray, c: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Each word's best class but the last, given its counts c with classes ctx (`by_class`, sorted by row).

    `sides` holds, for each class before and then each class after, its counts
    with every class.  Best is the highest rise of the likelihood when the word
    is taken from its old class (-1: it has none) and put there, all others
    held; where no class is better, the old one stays.  `sides` is the round's and
    isn't changed, so a word's move doesn't depend on which others its task holds.
    """
    k, old = sides.shape[1], cls[row]
    # Counts are positive, so the logarithm needs no guard here; that of `sides` is taken once a batch, not once an entry.
    more = sides[ctx] + c[:, None]
    gain = np.log(more)
    gain *= more
    gain -= _h(sides)[ctx]
    mine = np.flatnonzero(old >= 0)
    have = sides[ctx[mine], old[mine]]
    gain[mine, old[mine]] = _h(have) - _h(have - c[mine])
    score = np.zeros((len(cls), k))
    start = _runs(row)
    if len(start):
        score[row[start]] = np.add.reduceat(gain, start, axis=0)
    unit = np.flatnonzero(cls >= 0)
    for side in (0, 1):
        whole = sides[side * k : side * k + k].sum(0)
        m = np.bincount(row, c * ((ctx >= k) == side), len(cls))
        put = _h(whole + m[:, None]) - _h(whole)
        put[unit, cls[unit]] = _h(whole[cls[unit]]) - _h(np.maximum(whole[cls[unit]] - m[unit], 0))
        score -= put
    score[:, -1] = -np.inf
    new = score.argmax(1)
    stay = unit[score[unit, new[unit]] <= score[unit, cls[unit]] + 1e-9]
    new[stay] = cls[stay]
    return new


def _sides(table: np.ndarray) -> np.ndarray:
    return np.concatenate([table, table.T])


def _class_bigrams(rows: DataFrame, fn, classes: int) -> np.ndarray:
    """Class bigrams of rows; fn gives a batch's own classes, and (row, class before, count)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes)
        for b in batches:
            own, row, before, c = fn(b)
            good = own[row] >= 0
            total += np.bincount(before[good] * classes + own[row[good]], c[good], classes * classes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([longs(at), longs(total[at])], names=["pair", "c"])

    sums = rows.mapInArrow(count, "pair bigint, c bigint").groupBy("pair").agg(F.sum("c").alias("c")).toPandas()  # classes squared at most
    table = np.zeros(classes * classes)
    table[sums.pair.to_numpy(np.int64)] = sums.c.to_numpy(np.float64)
    return table.reshape(classes, classes)


def exchange_rounds(near: DataFrame, units: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each unit after the best round, and the class bigrams of units alone."""
    spark, edge = near.sparkSession, units - 1
    near = near.select("u", "ctx", "n")
    n_head = min(HEAD_UNITS, edge)
    ids = np.append(np.arange(n_head), edge)
    is_head = lambda c: (c < n_head) | (c == edge)
    after = F.filter(F.arrays_zip("ctx", "n"), lambda e: (e["ctx"] >= units) & is_head(e["ctx"] - units))
    found = near.filter(is_head(F.col("u"))).select("u", F.explode(after).alias("e")).select("u", F.col("e.ctx").alias("v"), F.col("e.n").alias("c")).toPandas()  # HEAD_UNITS squared at most
    start = np.zeros((n_head + 1, n_head + 1))
    start[np.minimum(found.u.to_numpy(np.int64), n_head), np.minimum(found.v.to_numpy(np.int64) - units, n_head)] = found.c.to_numpy(np.float64)
    of = np.full(units, -1, np.int64)
    of[ids] = exchange(start, classes)

    def table_of(of: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(of)

        def sums(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            (ctx, length), (n, _) = _lists(b.column(1)), _lists(b.column(2))
            row, ctx_cls, c = by_class(ctx.astype(np.int64), length, n, shared.value, units, classes)
            left = ctx_cls < classes
            return shared.value[b.column(0).to_numpy()], row[left], ctx_cls[left], c[left]

        return _class_bigrams(near, sums, classes)

    def moved(of: np.ndarray, table: np.ndarray, chosen: Column) -> np.ndarray:
        shared = spark.sparkContext.broadcast((of, table))

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, table = shared.value
            sides = _sides(table)
            for whole in batches:
                # Few units at a time: a unit of every context would else fill the memory with others like it.
                for lo in range(0, len(whole), 64):
                    b = whole.slice(lo, 64)
                    u = b.column(0).to_numpy()
                    (ctx, length), (n, _) = _lists(b.column(1)), _lists(b.column(2))
                    new = best_classes(of[u], *by_class(ctx.astype(np.int64), length, n, of, units, classes), sides)
                    yield pa.RecordBatch.from_arrays([b.column(0), longs(new)], names=["u", "cls"])

        got = near.filter((F.col("u") != edge) & chosen).mapInArrow(move, "u bigint, cls bigint").toPandas()  # a row for each unit at most
        out = of.copy()
        out[got.u.to_numpy(np.int64)] = got.cls.to_numpy(np.int64)
        return out

    of = moved(of, table_of(of), F.col("u") >= n_head)
    best, share = None, 0.5
    for done in range(ROUNDS + 1):
        table = table_of(of)
        reached = likelihood(table)
        if best is None or reached > best[0]:
            best = (reached, of, table)
        else:
            share /= 2
        if done < ROUNDS:
            turn = F.pmod(F.xxhash64("u") + F.lit(done * 512), F.lit(1024))
            of = moved(best[1], best[2], turn < int(share * 1024))
    of = best[1].copy()
    of[of < 0] = 0  # units without training tokens: their spelling buckets may still be asked for
    return of, best[2]


@dataclass
class ClassModel:
    """A fitted model: arrays bounded by the table and the classes squared, and (h, c, cls) of the words beyond the table."""

    table: FrequentWords
    classes_of: np.ndarray
    rare: DataFrame
    bigrams: np.ndarray
    words: int
    tokens: int
    texts: int
    once: np.ndarray
    twice: int

    @property
    def units(self) -> int:
        return len(self.table.hashes) + SPELLING_UNITS + 1

    def weights(self) -> tuple[np.ndarray, np.ndarray, float]:
        """log10 of the transitions, of each class's emission denominator, and of the mass of one word never seen."""
        k, n = len(self.bigrams), self.bigrams
        prior = (n.sum(0) + 1) / (n.sum() + k)
        transition = np.log10((n + BACK_OFF * prior) / (n.sum(1, keepdims=True) + BACK_OFF))
        unseen = np.bincount(self.classes_of[len(self.table.hashes) : -1], self.once, k) + 1.0
        # The number of words never seen, by those seen once and twice; a class has its part of them.
        once = self.once.sum()
        hidden = max(1.0, once * (once - 1) / (2 * (self.twice + 1)))
        each = unseen.sum() / max(hidden, unseen.sum() / unseen.min())
        whole = np.log10(n.sum(0) + unseen)
        whole[-1] = 0.0  # the boundary's class holds nothing else
        return transition, whole, float(np.log10(each))


def fit_classes(rows: DataFrame, text_col: str = "text", table_words: int = TABLE_WORDS) -> ClassModel:
    """The model of the texts of rows."""
    spark = rows.sparkSession

    def count_words(s: tg.Slice, _: pa.RecordBatch) -> list[pa.Array]:
        s = _lowered(s)
        w = tg.words(s)
        hashes, first, counts = np.unique(tg.segment_hash(s.data, w.starts, w.ends), return_index=True, return_counts=True)
        return [pa.array(hashes.view(np.int64)), longs(_spelling(s.data, w)[first]), longs(counts)]

    counts = written(map_slices(rows, text_col, [], count_words, "h bigint, spelling bigint, c bigint").groupBy("h", "spelling").agg(F.sum("c").alias("c")))
    sums = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") == 2).alias("twice"), F.count_if(F.col("c") >= FLOOR).alias("units")).first()
    once = np.zeros(SPELLING_UNITS)
    for r in counts.filter("c = 1").groupBy("spelling").count().collect():  # at most SPELLING_UNITS rows
        once[r.spelling] = r["count"]
    # The frequent words are those above a count that a histogram of log counts (some thousand rows at most) gives,
    # so no task sends more words than the table may hold in all.
    level = F.floor(F.log2("c") * 64).cast("int")
    sizes = sorted(((r.level, r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    fits = int(np.searchsorted(np.cumsum([c for _, c in sizes]), table_words, side="right")) if sizes else 0
    cut = sizes[fits - 1][0] if fits else 1 << 30
    top = counts.filter(level >= cut).toPandas().sort_values(["c", "h"], ascending=[False, True], ignore_index=True)
    hashes = top.h.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes, kind="stable")
    table = FrequentWords(hashes[order], top.c.to_numpy(np.int64)[order], np.arange(len(top))[order])
    units, classes = len(top) + SPELLING_UNITS + 1, class_count(int(sums.units))
    met = contexts(rows, text_col, spark.sparkContext.broadcast(table), units)
    of, bigrams = exchange_rounds(met.filter("not rare"), units, classes)
    shared = spark.sparkContext.broadcast((of, bigrams))
    n_top = len(top)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, bigrams = shared.value
        sides = _sides(bigrams)
        for whole in batches:
            for lo in range(0, len(whole), 1024):
                b = whole.slice(lo, 1024)
                (ctx, length), (n, _) = _lists(b.column(2)), _lists(b.column(3))
                row, cls, c = by_class(ctx.astype(np.int64), length, n, of, units, classes)
                left = cls < classes
                times = np.bincount(row[left], c[left], len(b)).astype(np.int64)
                new = np.where(times >= FLOOR, best_classes(np.full(len(b), -1), row, cls, c, sides), of[n_top + b.column(1).to_numpy()])
                yield pa.RecordBatch.from_arrays([b.column(0), longs(times), pa.array(new.astype(np.int32)), _as_lists(cls[left].astype(np.int32), np.bincount(row[left], minlength=len(b))), _as_lists(c[left].astype(np.int64), np.bincount(row[left], minlength=len(b)))], names=["h", "c", "cls", "before", "n"])

    rare = written(met.filter("rare").select(F.col("u").alias("h"), "spelling", "ctx", "n").mapInArrow(classed, "h bigint, c bigint, cls int, before array<int>, n array<bigint>"))

    def sums_of(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        (before, length), (n, _) = _lists(b.column(1)), _lists(b.column(2))
        return b.column(0).to_numpy().astype(np.int64), np.repeat(np.arange(len(length)), length), before.astype(np.int64), n.astype(np.float64)

    # The words beyond the table leave their spelling buckets: as what is predicted each counts for its own class.
    parts = [_class_bigrams(rare.select("cls", "before", "n"), sums_of, classes)]
    shared_of = spark.sparkContext.broadcast(of)

    def own_of(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        (ctx, length), (n, _) = _lists(b.column(1)), _lists(b.column(2))
        row, cls, c = by_class(ctx.astype(np.int64), length, n, shared_of.value, units, classes)
        left = cls < classes
        return shared_of.value[b.column(0).to_numpy()], row[left], cls[left], c[left]

    own = met.filter("not rare").filter((F.col("u") < n_top) | (F.col("u") == units - 1)).select("u", "ctx", "n")
    parts.append(_class_bigrams(own, own_of, classes))
    return ClassModel(table, of, rare.select("h", "c", "cls"), sum(parts), int(sums.v), int(sums.n), rows.count(), once, int(sums.twice))


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", table_words: int = TABLE_WORDS) -> DataFrame:
    """Every row's score under a model of the rows for which `learn` holds.

    Columns: id, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigram), score (the class model), perplexity.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), (~learn).alias("_held"))
    return score_with(fit_classes(rows.filter(~F.col("_held")), "_text", table_words), rows).withColumnRenamed("_id", id_col)


def score_with(model: ClassModel, rows: DataFrame) -> DataFrame:
    """Scores of rows (_id, _text, _held)."""
    spark, units = rows.sparkSession, model.units
    kind, n_top, edge = rows.schema["_id"].dataType.simpleString(), len(model.table.hashes), units - 1
    transition, whole, missing = model.weights()
    shared = spark.sparkContext.broadcast((model.table, model.classes_of, transition, whole))
    lists = "hs array<bigint>, history array<int>, own array<int>"

    def by_table(s: tg.Slice, kept: pa.RecordBatch) -> list[pa.Array]:
        t, of, transition, whole = shared.value
        w, hashes, _, code, at, known = _codes(t, _lowered(s))
        before, after, place = _with_edges(of[code], w, s.rows, of[edge])
        step = transition[before, after] - whole[after]
        c = t.counts[at[known]] if n_top else np.zeros(0, np.int64)
        rest = np.flatnonzero(~known)
        step[place[rest]] = 0
        row = np.repeat(np.arange(s.rows), np.diff(w.bounds) + 1)
        times = np.bincount(w.row[rest], minlength=s.rows)
        add = lambda x: np.bincount(w.row[known], x, s.rows).astype(np.float64)
        return [
            *kept.columns, longs(np.diff(w.bounds) + 1), longs(add(None)), pa.array(add(np.log10(c + 1))), pa.array(add(np.log10(np.maximum(c, 1))) + np.bincount(row, step, s.rows)),
            _as_lists(hashes[rest].view(np.int64), times), _as_lists(before[place[rest]].astype(np.int32), times), _as_lists(of[code[rest]].astype(np.int32), times),
        ]

    def by_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, transition, whole = shared.value
        for b in batches:
            history, own = (b.column(i).to_numpy() for i in (1, 2))
            c, cls = b.column(3).fill_null(0).to_numpy(), b.column(4).fill_null(-1).to_numpy()
            cls = np.where(cls < 0, own, cls)
            mass = np.where(c > 0, np.log10(np.maximum(c, 1)), missing)
            yield pa.RecordBatch.from_arrays([b.column(0), longs(c > 0), pa.array(np.log10(c + 1)), pa.array(transition[history, cls] - whole[cls] + mass)], names=["_r", "known", "plus", "score"])

    first = map_slices(rows, "_text", ["_id", "_held"], by_table, f"_id {kind}, _held boolean, n_tokens bigint, n_known bigint, plus double, score double, {lists}")
    # Once written, a row's number is fixed; it keeps repeated rows apart.
    first = written(first.withColumn("_row", F.monotonically_increasing_id()))
    each = first.select(F.col("_row").alias("_r"), F.explode(F.arrays_zip("hs", "history", "own")).alias("w")).select("_r", F.col("w.hs").alias("_h"), "w.history", "w.own")
    met = each.join(model.rare, F.col("_h") == F.col("h"), "left").select("_r", "history", "own", "c", "cls").mapInArrow(by_count, "_r bigint, known bigint, plus double, score double")
    sums = met.groupBy("_r").agg(F.sum("known").alias("_known"), F.sum("plus").alias("_plus"), F.sum("score").alias("_score"))
    n, v, ends = model.tokens + model.texts, model.words + (model.texts > 0), model.texts
    added = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    out = first.drop("hs", "history", "own").join(sums, F.col("_row") == F.col("_r"), "left").select(
        "_id", F.col("_held").alias("held_out"), "n_tokens",
        (added("n_known", "_known") + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (added("plus", "_plus") + float(np.log10(ends + 1)) - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        added("score", "_score").alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
