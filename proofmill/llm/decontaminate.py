"""Benchmark decontamination by spaced-seed hashing (operator 10, DataFrame only).

A document and a test item overlap where WINDOW consecutive words of both,
aligned without gaps, have at least LEAST_EQUAL equal words: two of thirteen may
be replaced.  An item of fewer words overlaps as a whole, with as many words
replaced as are two thirteenths of it, rounded down: one of 7 to 12 words, none
of 6 or less.  Items of any length count; a caller to whom very short ones say
nothing leaves them out of `items`.

Fixed masks pick the words of a place that are hashed; the others may differ.
MASKS are complete: wherever two words of a window are replaced, one of the
masks lies in the window on equal words (a test tries all placements).  For each
shorter length there is one mask of all words, or, where one may be replaced, two
that take turns.  So every overlap is met by an equal hash, and each hash hit is verified on the words of
the windows around it.

Hashes of all places of the items meet those of all documents in one join.
Seeds are (hash, item number, place), never texts: they are broadcast while they
are at most BROADCAST_SEEDS, some 30 bytes each, and the words around a hit go
along; more seeds are joined by a shuffle of hashes, and the words of the texts
that were hit are fetched by the digest of the text.  Both ways find the same
hits.  The items' words are joined by number afterwards.

Defined cases: null and empty texts have no words and never match; very long
texts and items are searched whole; rows that
repeat an id and a text give one result; items that share an id, with whatever
texts, are one item in the result, null ids included; columns other than the
named ones are ignored, and `drop_contaminated` keeps them as they are, whatever
their names; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import whole_row, written

WINDOW = 13
LEAST_EQUAL = 11
#: Fixed masks: 1 hashes the word, 0 ignores it.
MASKS = ("11101011", "1011000111")
BROADCAST_SEEDS = 500_000


def allowed(words: int) -> int:
    """How many words of a window, or of a shorter item, may be replaced."""
    return words * (WINDOW - LEAST_EQUAL) // WINDOW


def masks_of(words: int) -> list[str]:
    """The masks of a whole item that is shorter than a window."""
    return ["1" * words] if not allowed(words) else [("10" * words)[:words], ("01" * words)[:words]]


def word_list(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def digest_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _places(df: DataFrame, words: str, at: str, masks: list[str]) -> DataFrame:
    """A row for each place and mask that fits there: `at`, the mask's `span`, whether it is one of MASKS (`spaced`), and the hash `seed`.

    No exchange, union or write may follow before the words are cut or dropped:
    a stage holds all rows that one text makes, each with all its words.
    """
    size = F.size(words)
    placed = df.filter(size >= min(map(len, masks))).withColumn(at, F.explode(F.sequence(F.lit(0), size - min(map(len, masks)))))

    def seed(mask: str) -> Column:
        hashed = F.xxhash64(F.lit(mask), *[F.get(words, F.col(at) + i) for i, bit in enumerate(mask) if bit == "1"])
        return F.when(F.col(at) + len(mask) <= size, F.struct(hashed.alias("seed"), F.lit(len(mask)).alias("span"), F.lit(mask in MASKS).alias("spaced")))

    return placed.withColumn("_s", F.explode(F.array(*map(seed, masks)))).filter("_s is not null").withColumns({c: F.col(f"_s.{c}") for c in ("seed", "span", "spaced")}).drop("_s")


def _around(words: str, at: str) -> Column:
    """The words of every window that holds the mask at `at`: from `back` places before it to WINDOW after its start."""
    return F.slice(words, F.col(at) - F.col("back") + 1, F.col("back") + F.lit(WINDOW))


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Verified windows: _id, _key (digest of the text), item, equal words, first and end in the document, lo and hi in the item."""
    tests = items.select(F.col(item_col).alias("item"), word_list(F.col(item_text_col)).alias("item_words")).filter(F.size("item_words") > 0).distinct()
    tests = written(tests.withColumn("no", F.monotonically_increasing_id()))  # once written, a number is fixed
    n_item = F.size("item_words")
    # An item shorter than a window has masks of its own length; there are fewer such lengths than words in a window.
    short = sorted(r.n for r in tests.filter(n_item < WINDOW).select(n_item.alias("n")).distinct().collect())
    seeds = [_places(tests.filter(n_item >= WINDOW), "item_words", "j", list(MASKS))]
    seeds += [_places(tests.filter(n_item == n), "item_words", "j", masks_of(n)) for n in short]
    table = seeds[0].select("seed", "no", "j")
    for more in seeds[1:]:
        table = table.union(more.select("seed", "no", "j"))
    table = written(table)
    # A window starts at most WINDOW - span places before a mask of a long item, and with the hash of a short one.
    back = F.when(F.col("spaced"), F.least(F.lit(WINDOW) - F.col("span"), "i", "j")).otherwise(0)
    texts = docs.select(F.col(id_col).alias("_id"), digest_of(F.col(text_col)).alias("_key"), word_list(F.col(text_col)).alias("words"))
    own = _places(texts, "words", "i", [*MASKS, *(m for n in short for m in masks_of(n))])
    if table.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        met = own.join(F.broadcast(table), "seed").withColumn("back", back)
    else:
        hits = own.select("_id", "_key", "i", "span", "spaced", "seed").join(table, "seed").drop("seed").distinct()
        once = texts.select(F.col("_key").alias("_k"), "words").dropDuplicates(["_k"])
        met = hits.join(once, F.col("_key") == F.col("_k")).withColumn("back", back)
    # Only the words around a hit leave the join.
    near = met.select("_id", "_key", "no", "i", "j", "back", "span", "spaced", _around("words", "i").alias("mine")).distinct()
    lengths = F.when(F.col("spaced"), F.lit(WINDOW)).otherwise(F.col("span"))
    both = near.join(tests, "no").withColumns({"theirs": _around("item_words", "j"), "long": lengths})
    equal = F.zip_with("mine", "theirs", lambda a, b: F.when(a == b, 1).otherwise(0))
    start = F.sequence(F.lit(0), F.least(F.size("mine"), F.size("theirs")) - F.col("long"))
    judged = both.filter(F.least(F.size("mine"), F.size("theirs")) >= F.col("long")).withColumn("same", equal)
    found = judged.withColumn("at", F.explode(start)).withColumn("equal", F.aggregate(F.slice("same", F.col("at") + 1, F.col("long")), F.lit(0), lambda a, x: a + x))
    enough = F.when(F.col("spaced"), F.lit(LEAST_EQUAL)).otherwise(F.col("span") - F.floor(F.col("span") * (WINDOW - LEAST_EQUAL) / WINDOW))
    first, lo = F.col("i") - F.col("back") + F.col("at"), F.col("j") - F.col("back") + F.col("at")
    return found.filter(F.col("equal") >= enough).select("_id", "_key", "item", "equal", first.alias("first"), (first + F.col("long")).alias("end"), lo.alias("lo"), (lo + F.col("long")).alias("hi"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and test item that share an overlap: its windows (of both), most equal words, and where they lie."""
    found = overlaps(docs, items, id_col, text_col, item_col, item_text_col)
    return found.groupBy("_id", "item").agg(
        F.count_distinct("first", "lo").cast("long").alias("n_places"),
        F.max("equal").cast("long").alias("most_equal"),
        F.min("first").cast("long").alias("first_word"),
        F.max("end").cast("long").alias("end_word"),
        F.min("lo").cast("long").alias("item_first"),
        F.max("hi").cast("long").alias("item_end"),
    ).withColumnsRenamed({"_id": id_col, "item": item_col})


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """The rows of docs, all columns as they are, whose text shares no overlap with a test item."""
    bad = written(overlaps(docs, items, id_col, text_col, **names).select("_key").distinct())
    return docs.select(whole_row(docs).alias("_row"), digest_of(F.col(text_col)).alias("_digest")).join(bad, F.col("_digest") == F.col("_key"), "left_anti").select("_row.*")
