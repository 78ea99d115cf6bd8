"""N-gram Jaccard join by a MinHash LSH forest with exact verification (operator 4).

Texts that are equal are one class from the start; a class is represented by
one text.  Each text has a path in each of TREES prefix tries: DEEPEST minimum
hashes, BITS bits of each, as one integer, so the order of integers is that of
the trie.  The paths of a trie are sorted over range partitions, and texts
are linked with the length of the prefix that they share; a node of any size,
in one task or several, costs one row for each text.

The links of the longest prefix count first.  The prefix is then shortened,
value by value: a link is found at a depth with a chance that depends on its
similarity, which the paths of both texts estimate; the links found, over the
sum of their inverse chances, are the recall reached.  Shortening ends where it
reaches RECALL, and at the depth where a pair at the threshold reaches it
(`shortest_depth`) at the latest; a corpus without links goes there too.

Links join to candidate groups.  All texts of a group are compared exactly, by
their sets of word five-grams, in blocks of bounded size: a large group is
dealt out as pairs of blocks, never as pairs of texts.  Only counts and a
spanning forest of the verified links leave a block.

Defined cases: a null text is the empty text; texts of one to four words have
their whole word sequence as their only shingle; texts without words have none
and are near nothing but their copies; a very long text is compared whole, by the
hashes of all its shingles; repeated rows are copies; null ids are
returned as null and come after all others; columns of other names are ignored
by `near_duplicates` and passed through by `drop_near_duplicates`, whatever
their names; of rows that repeat an id and a text that stays, the one with the
least hash of all columns stays; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm import textgrid as tg
from proofmill.llm.common import map_slices, whole_row, written
from proofmill.llm.components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 40
DEEPEST = 10
BITS = 6
RECALL = 0.9999
#: Texts and shingles that one side of a block comparison holds.
BLOCK_TEXTS = 512
BLOCK_SHINGLES = 1 << 19


def chance(similarity: float | np.ndarray, depth: int, trees: int = TREES) -> float | np.ndarray:
    """That two texts share a prefix of that depth in some trie; BITS bits agree by accident too."""
    agree = similarity + (1 - similarity) / (1 << BITS)
    return 1 - (1 - agree**depth) ** trees


def shortest_depth(threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold is found with the target recall."""
    depth = deepest
    while depth > 1 and chance(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def shingles(s: tg.Slice, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased word n-grams of a slice, in row order, and the bounds of each row; a shorter text has one."""
    s = tg.Slice(s.lo, s.hi, tg.LOWER[s.data], s.offsets)
    w = tg.words(s)
    hashes = tg.segment_hash(s.data, w.starts, w.ends)
    grams = tg.window_hash(hashes, size)
    at = np.flatnonzero(tg.window_valid(w.row, size))
    n = np.diff(w.bounds)
    short = np.flatnonzero((n > 0) & (n < size))
    if not len(short):
        return grams[at], np.searchsorted(w.row[at], np.arange(s.rows + 1))
    own = np.zeros(len(short), np.uint64)
    for i, r in enumerate(short):
        own[i] = tg.window_hash(hashes[w.bounds[r] : w.bounds[r + 1]], int(n[r]))[0]
    row = np.concatenate([w.row[at], short])
    order = np.argsort(row, kind="stable")
    return np.concatenate([grams[at], own])[order], np.searchsorted(row[order], np.arange(s.rows + 1))


def paths(grams: np.ndarray, bounds: np.ndarray, trees: int, deepest: int) -> np.ndarray:
    """A row for each text with shingles: its path in each trie, the first minimum in the highest bits."""
    full = np.flatnonzero(np.diff(bounds))
    starts = bounds[:-1][full]
    draw = np.random.default_rng(20).integers(1, 1 << 63, (trees * deepest, 2), dtype=np.int64).astype(np.uint64)
    out = np.zeros((len(full), trees), np.uint64)
    if not len(full):
        return out
    for t in range(trees):
        key = np.zeros(len(full), np.uint64)
        for d in range(deepest):
            a, b = draw[t * deepest + d]
            # An odd factor permutes 64-bit values; mixed, the low bits of the least one are even.
            least = np.minimum.reduceat(grams * (a | np.uint64(1)) + b, starts)
            key = key << np.uint64(BITS) | tg.mix(least) & np.uint64((1 << BITS) - 1)
        out[:, t] = key
    return out


def shared_prefix(a: np.ndarray, b: np.ndarray, deepest: int) -> np.ndarray:
    """How many values paths have in common from the root on."""
    differ = (a ^ b).astype(np.uint64)
    depth = np.full(len(differ), deepest, np.int64)
    for d in range(deepest):
        depth[differ >> np.uint64(BITS * d) != 0] = deepest - d - 1
    return depth


def _neighbours(deepest: int, floor: int):
    """Rows (tree, path, v) in order to links (kind 0: a, b, shared depth) and the task's first and last row (kind 1).

    A text that shares a prefix with its neighbour before is linked to the first
    text that shares as long a prefix with all between: at every depth a node's
    texts hang together, over as many links as there are depths and not texts.
    """
    names = ["kind", "tree", "path", "a", "b", "depth"]
    levels = np.arange(floor, deepest + 1)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        heads = np.zeros(len(levels), np.int64)  # of the last row, at each depth
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, path, v = (batch.column(i).to_numpy() for i in range(3))
            if last is None:
                first = last = (tree[0], path[0], v[0])
                heads[:] = v[0]
            before = [np.concatenate([[x], y[:-1]]) for x, y in zip(last, (tree, path), strict=False)]
            depth = np.where(tree == before[0], shared_prefix(path, before[1], deepest), 0)
            last = (tree[-1], path[-1], v[-1])
            head = np.empty((len(levels), len(v)), np.int64)
            for i, d in enumerate(levels):
                start = np.maximum.accumulate(np.where(depth < d, np.arange(len(v)), -1))
                head[i] = np.where(start < 0, heads[i], v[np.maximum(start, 0)])
            heads = head[:, -1].copy()
            near = np.flatnonzero(depth >= floor)
            to = head[depth[near] - floor, near]
            near, to = near[to != v[near]], to[to != v[near]]
            if len(near):
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(near), np.int8)), pa.array(tree[near].astype(np.int8)), pa.array(path[near]), pa.array(v[near]), pa.array(to), pa.array(depth[near].astype(np.int8))], names=names)
        if first is not None:
            ends = sorted({first, last})
            n = len(ends)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int8)), pa.array([int(x[0]) for x in ends], pa.int8()), pa.array([int(x[1]) for x in ends], pa.int64()), pa.array([int(x[2]) for x in ends], pa.int64()), pa.array([0] * n, pa.int64()), pa.array([0] * n, pa.int8())], names=names)

    return link


def _classes(docs: DataFrame, id_col: str, text_col: str, trees: int, deepest: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, digest of the text, row number) and classes of equal texts (digest, rep, copies, shingles, paths)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(s: tg.Slice, rows: pa.RecordBatch) -> list[pa.Array]:
        grams, bounds = shingles(s)
        full = np.diff(bounds) > 0
        found = paths(grams, bounds, trees, deepest)
        offsets = np.concatenate([[0], np.cumsum(full * trees)]).astype(np.int32)
        return [*rows.columns, pa.array(np.diff(bounds).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel().view(np.int64)))]

    keyed = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumn("t", F.unhex(F.md5(F.col("_t").cast("binary"))))
    signed = map_slices(keyed, "_t", ["_id", "t"], sign, f"_id {kind}, t binary, n_shingles bigint, paths array<bigint>")
    rows = written(signed.withColumn("row", F.monotonically_increasing_id()))
    classes = written(rows.groupBy("t").agg(F.coalesce(F.min_by("row", "_id"), F.min("row")).alias("rep"), F.count("*").alias("copies"), F.min("_id").alias("copy_id"), F.max("n_shingles").alias("n_shingles"), F.max("paths").alias("paths")))
    return rows, classes


def forest_links(classes: DataFrame, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> DataFrame:
    """(a, b, depth): neighbours in some trie, with the longest prefix that they share there, as far as any shortening can go."""
    floor = shortest_depth(THRESHOLD, trees, deepest, recall)
    placed = classes.select(F.posexplode("paths").alias("tree", "path"), F.col("rep").alias("v"))
    linked = written(placed.repartitionByRange("tree", "path", "v").sortWithinPartitions("tree", "path", "v").mapInArrow(_neighbours(deepest, floor), "kind tinyint, tree tinyint, path bigint, a bigint, b bigint, depth tinyint"))
    # The last row of a task and the first of the next one are neighbours too; a few rows for each task.
    order = Window.partitionBy("tree").orderBy("path", "a")
    ends = linked.filter("kind = 1").select("tree", "path", "a", F.lag("a").over(order).alias("b"), F.lag("path").over(order).alias("other"))
    differ = F.expr("path ^ other")
    depth = F.when(differ == 0, deepest)
    for d in range(1, deepest):
        depth = depth.when(F.shiftrightunsigned(differ, BITS * d) == 0, deepest - d)
    across = ends.filter("b is not null and a <> b").withColumn("depth", depth.otherwise(0).cast("tinyint")).filter(F.col("depth") >= floor)
    both = linked.filter("kind = 0").select("a", "b", "depth").unionByName(across.select("a", "b", "depth"))
    return written(both.groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.max("depth").alias("depth")))


def matched_depth(links: DataFrame, classes: DataFrame, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> tuple[int, float | None]:
    """Depth to which prefixes are shortened, and the recall estimated there from all links (None: without links, nothing is known)."""
    floor = shortest_depth(THRESHOLD, trees, deepest, recall)
    of = lambda name: classes.select(F.col("rep").alias(f"_{name}"), F.col("paths").alias(f"p_{name}"))
    pairs = links.join(of("a"), F.col("a") == F.col("_a")).join(of("b"), F.col("b") == F.col("_b")).select("depth", "p_a", "p_b")
    values = trees * deepest

    def similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(i).flatten().to_numpy().view(np.uint64) for i in (1, 2))
            same = sum(((x ^ y) >> np.uint64(BITS * d) & np.uint64((1 << BITS) - 1) == 0).reshape(-1, trees).sum(1) for d in range(deepest))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same.astype(np.int32))], names=["depth", "same"])

    counted = pairs.mapInArrow(similarity, "depth tinyint, same int").groupBy("depth", "same").count().collect()  # at most all depths times all values
    agree = np.array([r.same / values for r in counted])
    s = np.clip((agree - 1 / (1 << BITS)) / (1 - 1 / (1 << BITS)), 0, 1)
    n, depth_of = np.array([r["count"] for r in counted], float), np.array([r.depth for r in counted])
    near, reached = s >= THRESHOLD, None
    for depth in range(deepest, floor - 1, -1):
        found = near & (depth_of >= depth)
        if found.any():
            reached = float(n[found].sum() / (n[found] / chance(s[found], depth, trees)).sum())
            if reached >= recall:
                return depth, reached
    return floor, reached


def _candidates(classes: DataFrame, trees: int, deepest: int, recall: float) -> DataFrame:
    """(v, c): texts that share a prefix of the matched depth with another one, by candidate group."""
    links = forest_links(classes, trees, deepest, recall)
    depth, _ = matched_depth(links, classes, trees, deepest, recall)
    return connected_components(links.filter(F.col("depth") >= depth).select("a", "b"))


def _compare(key: tuple, table: pa.Table, threshold: float = THRESHOLD) -> pa.Table:
    """Exact links inside a block or between two blocks: for each text the number of linked texts, and links of a spanning forest."""
    x, y = key[1].as_py(), key[2].as_py()
    v = table.column("v").to_numpy()
    side = table.column("block").to_numpy()
    lists = table.column("grams").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    grams = lists.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(v)), sizes)
    # A shingle of one text only is in no intersection; of the rest each is a column.
    _, column, times = np.unique(grams, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    width = int(column.max()) + 1 if len(column) else 0
    left = np.flatnonzero(side == x)
    right = left if x == y else np.flatnonzero(side == y)
    both = np.zeros((len(left), len(right)), np.float32)
    place = np.full(len(v), -1)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    step = max(1, (1 << 21) // max(1, len(left) + len(right)))  # 8 MB of a dense strip of columns
    for lo in range(0, width, step):
        a, z = np.searchsorted(column, [lo, lo + step])
        own, col = owner[a:z], column[a:z] - lo
        strips = []
        for texts in (left, right):
            place[:] = -1
            place[texts] = np.arange(len(texts))
            here = place[own] >= 0
            strip = np.zeros((len(texts), min(step, width - lo)), np.float32)
            strip[place[own[here]], col[here]] = 1
            strips.append(strip)
            if x == y:
                break
        both += strips[0] @ strips[-1].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    near = (both > 0) & (both >= threshold * union - 1e-6)
    if x == y:
        np.fill_diagonal(near, False)
    counts = np.zeros(len(v), np.int64)
    counts[left] += near.sum(1)
    if x != y:
        counts[right] += near.sum(0)
    # A spanning forest by search from each text not yet reached.
    forest: list[tuple[int, int]] = []
    near_t = near.T
    seen_l, seen_r = np.zeros(len(left), bool), np.zeros(len(right), bool)
    if x == y:
        seen_r = seen_l
    for i in np.flatnonzero(near.any(1)):
        if seen_l[i]:
            continue
        seen_l[i] = True
        queue = [(0, i)]
        while queue:
            where, j = queue.pop()
            reach = near[j] & ~seen_r if where == 0 else near_t[j] & ~seen_l
            for k in np.flatnonzero(reach):
                (seen_r if where == 0 else seen_l)[k] = True
                mine, other = (left[j], right[k]) if where == 0 else (right[j], left[k])
                forest.append((v[mine], v[other]))
                queue.append((1 - where if x != y else 0, k))
    n = len(v)
    return pa.table({
        "a": pa.array(np.concatenate([v, np.array([e[0] for e in forest], np.int64)])),
        "b": pa.array(np.concatenate([v, np.array([e[1] for e in forest], np.int64)])),
        "links": pa.array(np.concatenate([counts, np.zeros(len(forest), np.int64)])),
    }) if n else pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "links")})


def _verified(docs: DataFrame, text_col: str, classes: DataFrame, candidates: DataFrame) -> DataFrame:
    """(a, b, links): a = b: verified links of a text in one comparison; else a link of the forest."""
    members = classes.join(candidates, F.col("rep") == F.col("v")).select("t", "v", "c", "n_shingles")
    sizes = members.groupBy("c").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).select(F.col("c").alias("_c"), F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = members.join(sizes, F.col("c") == F.col("_c")).select("t", "v", "c", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("block"), "blocks")
    keyed = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_blob")).withColumn("_t", F.unhex(F.md5("_blob")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            digest = b.column(1)
            # Copies inside a batch are sent once; the others meet in the aggregation below.
            at = pa.array(np.unique(digest.to_numpy(zero_copy_only=False).astype("S16"), return_index=True)[1]) if b.num_rows else pa.array([], pa.int64())
            b = b.take(at)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([squeeze(x) for x in b.column(0).to_pylist()], pa.binary())], names=["_t", "_blob"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for b in batches:
            done = 0
            texts = [open_(x) for x in b.column(0).to_pylist()]
            for s in tg.text_slices(pa.array(texts, pa.binary())):
                grams, bounds = shingles(s)
                parts = [np.unique(grams[bounds[i] : bounds[i + 1]]) for i in range(s.rows)]
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                values = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*[c.slice(done, s.rows) for c in b.columns[1:]], pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["v", "c", "block", "blocks", "grams"])
                done += s.rows

    texts = keyed.select("_blob", "_t").mapInArrow(pack, "_t binary, _blob binary")
    met = dealt.join(texts, F.col("t") == F.col("_t")).dropDuplicates(["v"]).select("_blob", "v", "c", "block", "blocks")
    sets = met.mapInArrow(unpack, "v bigint, c bigint, block int, blocks int, grams array<bigint>")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = sets.withColumn("other", other).select("v", "c", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "grams")
    return written(spread.groupBy("c", "x", "y").applyInArrow(lambda key, t: _compare(key, t), "a bigint, b bigint, links bigint"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> DataFrame:
    """One row for each input row: class_id (smallest id linked to it, directly or over others), copy_id (smallest id
    with the same text), n_copies of its text, n_links (different texts that are near it), kept (one row of each class)."""
    rows, classes = _classes(docs, id_col, text_col, trees, deepest)
    compared = _verified(docs, text_col, classes, _candidates(classes, trees, deepest, recall))
    links = compared.filter("a = b").groupBy(F.col("a").alias("_v")).agg(F.sum("links").alias("n_links"))
    groups = connected_components(compared.filter("a <> b").select("a", "b"))
    named = (
        classes.join(groups, F.col("rep") == F.col("v"), "left")
        .join(links, F.col("rep") == F.col("_v"), "left")
        .select(F.col("t").alias("_t"), "rep", "copies", "copy_id", F.coalesce("c", "rep").alias("c"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    # Written, so that its join has plain shuffles on both sides and Spark can split the texts of one large class.
    heads = written(named.groupBy(F.col("c").alias("_c")).agg(F.min("copy_id").alias("class_id"), F.coalesce(F.min_by("rep", "copy_id"), F.min("rep")).alias("head")))
    full = named.join(heads, F.col("c") == F.col("_c"))
    return rows.join(full, F.col("t") == F.col("_t")).select(
        F.col("_id").alias(id_col), F.col("class_id"), F.col("copy_id"), F.col("copies").alias("n_copies"), "n_links", (F.col("row") == F.col("head")).alias("kept"), F.col("t").alias("digest")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row, all columns as they are, of each class of near duplicates: the first of the text that stands for it."""
    key: Column = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map", "variant"))]
    found = near_duplicates(docs, id_col, text_col, **options).filter("kept").select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_k"), F.col("digest").alias("_d"))
    whole = docs.select(whole_row(docs).alias("_row"), key.alias("_key"), digest.alias("_digest"), F.xxhash64(*hashed).alias("_order"))
    kept = whole.join(found, (F.col("_key") == F.col("_k")) & (F.col("_digest") == F.col("_d")), "left_semi")
    # Rows that repeat an id and a text are one document; one of them stays.
    return kept.groupBy("_key", "_digest").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")
