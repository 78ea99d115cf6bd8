"""Substring dedup by prefix-partitioned suffix trees (operator 5).

A suffix starts at each word.  Only its first WINDOW words matter: a node of
that depth with leaves in two documents is a repeat, and the windows of such
nodes, overlapping, make the maximal repeats.  The trees are built in three
distributed steps.

1. Prefix census.  A suffix is partitioned by a prefix of variable length: it
   ends with the run of ANCHOR words that has the least hash among those in the
   suffix's first WINDOW words, so equal suffixes have equal prefixes of ANCHOR
   to WINDOW words.  The runs of all texts are sorted by (run, document) over
   range partitions; prefixes whose run is in one document only are dropped, for
   no branch can be below them.
2. Subtrees.  The suffixes left go with their words to groups by prefix.  A
   group that does not fit a batch of the census, or of which one shows
   HEAVY_PLACES places, is split further, over salts of document and place.
   A task lengthens the prefixes of its suffixes word by word: each level splits
   the groups by the next word, and a group with one suffix is a leaf and ends.
   The groups left at depth WINDOW are the deep internal nodes; each knows its
   smallest document.  Nodes of a split group are settled by a join with the
   nodes that the other tasks report for it.
3. Removal.  The places found go back to the whole texts.

Words are compared by 64-bit hashes, all WINDOW words of a suffix one by one;
nodes that meet in the join by two 64-bit hashes of their words.

Defined cases: null and empty texts have no words; windows never span
documents; a very long text is searched whole, and what it repeats often is dealt
over many tasks; rows that repeat an id are one document to each other (neither
loses words to the other) and each is returned; null ids count as larger than
every other id and as equal to each other; ids that are no integers are
ordered as Spark orders them; other columns are passed through, but for those
named n_words and n_removed, which `remove_repeats` returns its own of; empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmill.llm import textgrid as tg
from proofmill.llm.common import bounded_batches, longs, signed, whole_row, written

WINDOW = 13
ANCHOR = 5
#: Documents that a batch of the census shows of a group that may go on elsewhere, from which on it goes over so many salts.
HEAVY = 64
#: Places that a batch shows of any group, from which on it goes over as many salts: a few documents can repeat one prefix very often.
HEAVY_PLACES = 4096
SALTS = 256
_LAST = (1 << 63) - 1
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def _anchors(s: tg.Slice, window: int, anchor: int) -> tuple[tg.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words; the suffixes with a whole window in their row (by first word); where each one's anchor is; hashes of runs."""
    w = tg.words(s)
    grams = tg.window_hash(tg.segment_hash(s.data, w.starts, w.ends), anchor)
    at = np.flatnonzero(tg.window_valid(w.row, window))
    best, place = grams[at], at.copy()
    for j in range(1, window - anchor + 1):
        other = grams[at + j]
        less = other < best
        best = np.where(less, other, best)
        place[less] = at[less] + j
    return w, at, place, grams


def _row_code(n: int) -> np.ndarray:
    return tg.mix(np.arange(1, n + 1, dtype=np.uint64))


def _print(s: tg.Slice) -> np.ndarray:
    """A hash of each row's text: tells rows of one key apart."""
    return tg.segment_hash(s.data, s.offsets[:-1], s.offsets[1:]).view(np.int64)


def _ordered(docs: DataFrame, id_col: str) -> tuple[DataFrame, Column]:
    """docs and the order of their ids as a long; null comes last."""
    kind = docs.schema[id_col].dataType
    if isinstance(kind, T.IntegralType):
        return docs.select(whole_row(docs).alias("_all")), F.coalesce(F.col(f"_all.`{id_col}`").cast("long"), F.lit(_LAST))
    # Numbers that rise with the ids; written, so that they are fixed.
    ids = docs.select(F.col(id_col).alias("_v")).filter("_v is not null").distinct().repartitionByRange("_v").sortWithinPartitions("_v")
    numbers = written(ids.withColumn("_n", F.monotonically_increasing_id()))
    return docs.select(whole_row(docs).alias("_all")).join(numbers, F.col(f"_all.`{id_col}`") == F.col("_v"), "left"), F.coalesce("_n", F.lit(_LAST))


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with the key `_k` of their document, its rank `_o`, the text compressed as `_blob`, and the other columns."""
    rest = [f for f in docs.schema.fields if f.name != text_col]
    rows, rank = _ordered(docs, id_col)
    col = lambda name: F.col(f"_all.`{name}`")
    hashed = [col(f.name) for f in rest if not any(x in f.dataType.simpleString() for x in ("map", "variant"))]
    keyed = rows.select(F.xxhash64(*hashed, col(text_col)).alias("_k"), rank.alias("_o"), col(text_col).alias("_blob"), F.struct(*[col(f.name).alias(f.name) for f in rest]).alias("_rest"))
    schema = T.StructType([T.StructField("_k", T.LongType()), T.StructField("_o", T.LongType()), T.StructField("_blob", T.BinaryType()), T.StructField("_rest", T.StructType(rest))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            texts = b.column(2).cast(pa.binary())
            blobs = pa.array([None if t is None else squeeze(t) for t in texts.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), blobs, b.column(3)], names=["_k", "_o", "_blob", "_rest"])

    return keyed.mapInArrow(pack, schema)


def _unpacked(blobs: pa.Array) -> Iterator[tg.Slice]:
    """Bounded slices of compressed texts."""
    open_ = zstandard.ZstdDecompressor().decompress
    texts: list[bytes] = []
    size, lo = 0, 0
    for i, b in enumerate(blobs):
        text = b"" if not b.is_valid else open_(b.as_py())
        if texts and size + len(text) > tg.SLICE_BYTES:
            yield _slice(lo, texts)
            texts, size, lo = [], 0, i
        texts.append(text)
        size += len(text)
    if texts:
        yield _slice(lo, texts)


def _slice(lo: int, texts: list[bytes]) -> tg.Slice:
    return tg.Slice(lo, lo + len(texts), np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))


class _Gathered:
    """Facts of a document, sorted before its texts, gathered over the batches of a task."""

    def __init__(self, columns: list[str]):
        self.columns = columns
        self.key: int | None = None
        self.open: list[list[np.ndarray]] = []

    def take(self, batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, list[np.ndarray]]:
        """The batch's texts; for each fact about them, its text's row; the facts."""
        key = batch.column(batch.schema.get_field_index("_k")).to_numpy()
        is_text = batch.column(batch.schema.get_field_index("_kind")).to_numpy() == 1
        texts = batch.filter(pa.array(is_text))
        facts = [batch.column(batch.schema.get_field_index(c)).fill_null(0).to_numpy(zero_copy_only=False)[~is_text] for c in self.columns]
        fact_key, text_key = key[~is_text], key[is_text]
        if self.open and len(key):
            carried = [np.concatenate(x) for x in zip(*self.open, strict=True)]
            same = key[0] == self.key
            if same:
                fact_key = np.concatenate([np.full(len(carried[0]), self.key, np.int64), fact_key])
                facts = [np.concatenate([a, b]) for a, b in zip(carried, facts, strict=True)]
        if len(key):
            last = key[-1]
            stay = fact_key == last
            self.key, self.open = last, [[f[stay] for f in facts]]
        # Keys come in ascending order, so the texts of a fact are found by bisection; rows that repeat an id all get it.
        lo, hi = np.searchsorted(text_key, fact_key, "left"), np.searchsorted(text_key, fact_key, "right")
        times = hi - lo
        which = np.repeat(np.arange(len(fact_key)), times)
        row = np.repeat(lo, times) + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        return texts, row, [f[which] for f in facts]


def _shared_prefixes(packed: DataFrame, window: int, anchor: int) -> DataFrame:
    """(_k, h, parts) of every anchor that another document may have too; never misses one that does.

    parts is 0 for a group that was seen whole, else over how many salts its rows
    go: a group that a batch may not have seen whole is settled across tasks.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            for s in _unpacked(b.column(1)):
                w, _, place, grams = _anchors(s, window, anchor)
                spot = np.unique(place)
                row = w.row[spot]
                _, first, n = np.unique(grams[spot] ^ _row_code(s.rows)[row], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([signed(grams[spot[first]]), longs(keys[s.lo : s.hi][row[first]]), pa.array(n.astype(np.int32))], names=["h", "_k", "n"])

    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, k, n = (b.column(i).to_numpy() for i in range(3))
            if not len(h):
                continue
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            end = np.concatenate([start[1:], [len(h)]])
            shared, parts = k[start] != k[end - 1], np.zeros(len(start), np.int64)
            # The first and last anchor of a batch may go on in another one, so their groups are settled across tasks;
            # of the documents of a heavy one each batch shows some.
            shared[[0, -1]] = True
            parts[[0, -1]] = np.where((end - start)[[0, -1]] < HEAVY, 1, SALTS)
            parts[np.add.reduceat(n.astype(np.int64), start) >= HEAVY_PLACES] = SALTS
            keep = np.repeat(shared, end - start)
            yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(h[keep]), longs(np.repeat(parts, end - start)[keep])], names=["_k", "h", "parts"])

    rows = packed.select("_k", "_blob").mapInArrow(emit, "h bigint, _k bigint, n int")
    # The range of a hot anchor is cut by document, which a partitioning by the anchor could not do.
    return rows.repartitionByRange("h", "_k").sortWithinPartitions("h", "_k").mapInArrow(census, "_k bigint, h bigint, parts bigint")


def _with_facts(packed: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """Facts and texts of each document in one task, the facts first."""
    empty = [F.lit(None).cast(packed.schema[c].dataType).alias(c) for c in packed.columns if c != "_k"]
    return (
        facts.select("_k", F.lit(0).cast("tinyint").alias("_kind"), *columns, *empty)
        .unionByName(packed.select("_k", F.lit(1).cast("tinyint").alias("_kind"), *[F.lit(None).cast("bigint").alias(c) for c in columns], *[c for c in packed.columns if c != "_k"]))
        .repartition("_k")
        .sortWithinPartitions("_k", "_kind")
    )


def _suffixes(packed: DataFrame, shared: DataFrame, window: int, anchor: int) -> DataFrame:
    """Suffixes below shared prefixes: a row for each run of n suffixes with one anchor, with the words from the first's first to the last's last."""
    names = ["h", "salt", "_o", "_k", "print", "place", "n", "words"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Gathered(["h", "parts"])
        for b in batches:
            texts, fact_row, (fact_h, fact_parts) = state.take(b)
            if not texts.num_rows:
                continue
            keys, ranks = texts.column("_k").to_numpy(), texts.column("_o").to_numpy()
            order = np.argsort(fact_row, kind="stable")
            fact_row, fact_h, fact_parts = fact_row[order], fact_h[order].view(np.uint64), fact_parts[order]
            for s in _unpacked(texts.column("_blob")):
                lo, hi = np.searchsorted(fact_row, [s.lo, s.hi])
                if lo == hi:
                    continue
                code = _row_code(s.rows)
                w, at, place, grams = _anchors(s, window, anchor)
                known = fact_h[lo:hi] ^ code[fact_row[lo:hi] - s.lo]
                by = np.argsort(known)
                known, parts = known[by], fact_parts[lo:hi][by]
                start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])[: len(place)])
                run = grams[place[start]] ^ code[w.row[at[start]]]
                found = np.minimum(np.searchsorted(known, run), len(known) - 1)
                hit = known[found] == run
                n = np.diff(np.append(start, len(at)))[hit]
                start, parts = start[hit], parts[found[hit]]
                if not len(start):
                    continue
                first, row = at[start], w.row[at[start]]
                a, z = w.starts[first], w.ends[first + n + window - 2]
                size = z - a
                bounds = np.concatenate([[0], np.cumsum(size)])
                bytes_ = s.data[np.arange(bounds[-1]) + np.repeat(a - bounds[:-1], size)]
                runs = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(bytes_.tobytes())])
                key = keys[s.lo : s.hi][row]
                # By place too: one document's own repeats are dealt out as well.
                spread = (key + (first - w.bounds[row]) * 40_503) % np.maximum(parts, 1)
                salt = np.where(parts > 0, spread, -1)
                yield pa.RecordBatch.from_arrays([signed(grams[place[start]]), longs(salt), longs(ranks[s.lo : s.hi][row]), longs(key), longs(_print(s)[row]), longs(first - w.bounds[row]), longs(n), runs], names=names)

    return _with_facts(packed.select("_k", "_o", "_blob"), shared, ["h", "parts"]).mapInArrow(emit, "h bigint, salt bigint, _o bigint, _k bigint, print bigint, place bigint, n bigint, words binary")


def deep_nodes(group: np.ndarray, words: np.ndarray, first: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (by number) below internal nodes of that depth, and the node of each.

    words holds hashes, first the place of each suffix's first word, group the
    prefix group that it starts in.  The prefix grows by one word a level; what is
    alone under its prefix is a leaf and goes no deeper.
    """
    alive, node = np.arange(len(first)), group
    for d in range(depth):
        if not len(alive):
            break
        word = words[first[alive] + d]
        order = np.lexsort((word, node))
        ranked, letter = node[order], word[order]
        new = np.concatenate([[True], (ranked[1:] != ranked[:-1]) | (letter[1:] != letter[:-1])])
        number = np.cumsum(new) - 1
        branch = np.bincount(number)[number] > 1
        alive, node = alive[order[branch]], number[branch]
    return alive, node


def _subtrees(window: int):
    """Rows sorted by anchor and salt to what they settle: kind 0, places whose suffix an earlier document has (bits of
    mask); kind 1, other suffixes of split groups; kind 2, nodes of split groups with their smallest document."""
    names = ["kind", "_k", "print", "place", "mask", "node", "node2", "_o"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key: tuple[int, int] | None = None

        def settle(rows: pa.RecordBatch, seen: tuple[np.ndarray, ...] | None) -> tuple[list[pa.RecordBatch], tuple[np.ndarray, ...]]:
            """Facts of whole groups; seen: nodes of the group that goes on, and their smallest documents."""
            h, salt, o, k, print_, place, n = (rows.column(i).to_numpy() for i in range(7))
            runs = rows.column(7)
            raw = np.frombuffer(runs.buffers()[1], np.int32, len(runs) + 1, runs.offset * 4).astype(np.int64)
            data = np.frombuffer(runs.buffers()[2], np.uint8)[raw[0] : raw[-1]]
            s = tg.Slice(0, len(h), data, raw - raw[0])
            w = tg.words(s)
            words = tg.segment_hash(data, w.starts, w.ends)
            run = np.repeat(np.arange(len(h)), n)
            j = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
            first = w.bounds[run] + j
            group = np.cumsum(np.concatenate([[0], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])]))[run]
            split = salt[run] >= 0
            rank = o[run]
            # A split group's suffixes all stay, alone or not: their like may be in another task.
            alive, node = deep_nodes(group, words, first, window)
            least = np.full(int(node.max()) + 1 if len(node) else 0, _LAST)
            np.minimum.at(least, node, rank[alive])
            smallest = rank.copy()
            smallest[alive] = least[node]
            at = np.flatnonzero(split)
            full, other = tg.window_hash(words, window), tg.window_hash(words, window, _OTHER)
            open_ = group == group[-1]
            if seen is not None and len(seen[0]):
                here = np.flatnonzero(group == 0)
                spot = np.minimum(np.searchsorted(seen[0], full[first[here]]), len(seen[0]) - 1)
                met = (seen[0][spot] == full[first[here]]) & (seen[1][spot] == other[first[here]])
                smallest[here[met]] = np.minimum(smallest[here[met]], seen[2][spot[met]])
            repeat = rank > smallest
            mask = np.zeros(len(h), np.int64)
            np.bitwise_or.at(mask, run[repeat], np.int64(1) << j[repeat])
            out = []
            some = np.flatnonzero(mask)
            if len(some):
                zero = longs(np.zeros(len(some)))
                out.append(pa.RecordBatch.from_arrays([pa.array(np.zeros(len(some), np.int8)), pa.array(k[some]), pa.array(print_[some]), pa.array(place[some]), pa.array(mask[some]), zero, zero, zero], names=names))
            at = at[~repeat[at]]
            if len(at):
                # Of suffixes with one node all may go on; the node itself is reported once with its smallest document.
                r = run[at]
                out.append(pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int8)), pa.array(k[r]), pa.array(print_[r]), pa.array(place[r]), pa.array(np.int64(1) << j[at]), signed(full[first[at]]), signed(other[first[at]]), pa.array(rank[at])], names=names))
                by = np.lexsort((rank[at], other[first[at]], full[first[at]]))  # salts of one group may lie in one batch
                a, b = full[first[at]][by], other[first[at]][by]
                once = at[by[np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])]]
                zero = longs(np.zeros(len(once)))
                out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(once), 2, np.int8)), zero, zero, zero, zero, signed(full[first[once]]), signed(other[first[once]]), pa.array(rank[once])], names=names))
            mine = np.flatnonzero(open_)
            a, b, c = full[first[mine]], other[first[mine]], smallest[mine]
            if seen is not None and group[-1] == 0:
                a, b, c = np.concatenate([seen[0], a]), np.concatenate([seen[1], b]), np.concatenate([seen[2], c])
            order = np.lexsort((c, b, a))
            keep = order[np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])] if len(order) else order
            return out, (a[keep], b[keep], c[keep])

        seen: tuple[np.ndarray, ...] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            goes_on = key == (b.column(0)[0].as_py(), b.column(1)[0].as_py())
            out, seen = settle(b, seen if goes_on else None)
            key = (b.column(0)[-1].as_py(), b.column(1)[-1].as_py())
            yield from out

    return walk


def repeated_windows(packed: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(_k, print, place, mask): bit j of mask says that the suffix at place + j repeats a smaller document."""
    suffixes = _suffixes(packed, _shared_prefixes(packed, window, anchor), window, anchor)
    # Anchors are uniform hashes and heavy ones are salted, so hash partitions are even without a sample of the rows.
    grouped = suffixes.repartition("h", "salt").sortWithinPartitions("h", "salt", "_o", "_k")
    walked = written(grouped.mapInArrow(_subtrees(window), "kind tinyint, _k bigint, print bigint, place bigint, mask bigint, node bigint, node2 bigint, _o bigint"))
    settled = walked.filter("kind = 0").select("_k", "print", "place", "mask")
    # Written, so that both sides of the join are plain shuffles, which Spark can split where a text repeats one window.
    earlier = written(walked.filter("kind = 2").groupBy("node", "node2").agg(F.min("_o").alias("least")))
    late = walked.filter("kind = 1").join(earlier, ["node", "node2"]).filter("_o > least").select("_k", "print", "place", "mask")
    return settled.unionByName(late)


def _stripped(docs: DataFrame, id_col: str, text_col: str, window: int, anchor: int, normalize: bool) -> DataFrame:
    """_rest (all columns but the text), _text without the words of repeated windows, _n_words, _n_removed."""
    if not anchor < window <= anchor + 60:
        raise ValueError("a window must be longer than its anchor, by 60 words at most")
    bounded_batches(docs.sparkSession)
    packed = _packed(docs, id_col, text_col)
    places = repeated_windows(packed.select("_k", "_o", "_blob"), window, anchor)
    schema = T.StructType([T.StructField("_rest", packed.schema["_rest"].dataType), T.StructField("_text", T.StringType()), T.StructField("_n_words", T.LongType()), T.StructField("_n_removed", T.LongType())])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Gathered(["print", "place", "mask"])
        for b in batches:
            texts, fact_row, (print_, place, mask) = state.take(b)
            if not texts.num_rows:
                continue
            order = np.argsort(fact_row, kind="stable")
            fact_row, print_, place, mask = fact_row[order], print_[order], place[order], mask[order]
            blobs = texts.column("_blob")
            for s in _unpacked(blobs):
                w = tg.words(s)
                lo, hi = np.searchsorted(fact_row, [s.lo, s.hi])
                row = fact_row[lo:hi] - s.lo
                mine = print_[lo:hi] == _print(s)[row]
                row, m = row[mine], mask[lo:hi][mine]
                at = w.bounds[row] + place[lo:hi][mine]
                step = np.zeros(len(w.row) + window + 1, np.int32)
                for j in range(window - anchor + 1):
                    there = at[(m >> j) & 1 == 1] + j
                    np.add.at(step, there, 1)
                    np.add.at(step, there + window, -1)
                gone = np.cumsum(step)[: len(w.row)] > 0
                n_removed = np.bincount(w.row[gone], minlength=s.rows)
                out: list[bytes | None] = []
                for i in range(s.rows):
                    if not n_removed[i] and not normalize:
                        out.append(s.data[s.offsets[i] : s.offsets[i + 1]].tobytes() if blobs[s.lo + i].is_valid else None)
                        continue
                    a, z = w.bounds[i], w.bounds[i + 1]
                    text = s.data[s.offsets[i] : s.offsets[i + 1]].tobytes().split()
                    out.append(b" ".join(x for x, g in zip(text, gone[a:z].tolist(), strict=True) if not g) if n_removed[i] else b" ".join(text))
                yield pa.RecordBatch.from_arrays([texts.column("_rest").slice(s.lo, s.rows), pa.array(out, pa.binary()).cast(pa.string()), longs(np.diff(w.bounds)), longs(n_removed)], names=schema.names)

    return _with_facts(packed, places, ["print", "place", "mask"]).mapInArrow(strip, schema)


def _columns(docs: DataFrame, text_col: str, without: tuple[str, ...] = ()) -> list[Column]:
    return [F.col("_text").alias(c) if c == text_col else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns if c not in without]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, normalize: bool = False) -> DataFrame:
    """docs, all columns, with the words of repeated windows removed from the text, and `n_words`, `n_removed`.

    A changed text is its kept words joined by one space; with normalize so is
    an unchanged one.
    """
    done = _stripped(docs, id_col, text_col, window, anchor, normalize)
    return done.select(*_columns(docs, text_col, ("n_words", "n_removed")), F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs, the columns as they are, with the words of repeated windows removed; texts of which nothing is left go.

    chars_col names a column that holds the length of the text and follows it.
    """
    done = _stripped(docs, id_col, text_col, window, anchor, False).filter("_n_removed = 0 or _n_removed < _n_words")
    columns = dict(zip(docs.columns, _columns(docs, text_col), strict=True))
    if chars_col is not None:
        length = F.length("_text").cast(docs.schema[chars_col].dataType)
        columns[chars_col] = F.when(F.col("_n_removed") > 0, length).otherwise(F.col(f"_rest.`{chars_col}`")).alias(chars_col)
    return done.select(*columns.values())
