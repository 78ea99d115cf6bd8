"""License scans by diagonal voting (operator 8).

All rolling word k-grams of whole texts are hashed; Spark joins them to the
k-gram positions of the templates (a fixed table, broadcast because its size is
checked); each hit votes for a diagonal, the offset between text and template;
votes are counted by (document, template, diagonal), neighbouring diagonals are
merged, and a span is verified when the k-grams found there, compared as text,
cover enough of the template.  A hash filter made of the template hashes runs
with the hashing, so that only k-grams that can join leave the workers.

Defined cases: null and empty texts have no words and no labels; a very long
text is scanned whole; a place that fits several phrases or templates counts for
each, and labels are sorted, so no tie is left; a null id is kept; repeated rows give repeated results; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill.llm import textgrid as tg
from proofmill.llm.common import longs, map_slices

#: The phrases every scan counts exactly.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Longer wordings that the method may find with words changed, added or lost.
WORDINGS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this work is licensed under a creative commons attribution": "cc-by",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
}
NEAR_DIAGONALS = 3
LEAST_COVER = 0.8
BROADCAST_GRAMS = 200_000

GAP = np.zeros(256, bool)
GAP[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


@dataclass(frozen=True)
class Template:
    text: str
    label: str
    base: bool

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def k(self) -> int:
        return min(3, len(self.words))


def templates() -> list[Template]:
    return [*(Template(t, v, True) for t, v in PHRASES.items()), *(Template(t, v, False) for t, v in WORDINGS.items())]


def _slice_of(text: str) -> tg.Slice:
    raw = np.frombuffer(text.encode(), np.uint8)
    return tg.Slice(0, 1, raw, np.array([0, len(raw)]))


def _gram_table(items: list[Template]) -> list[tuple]:
    rows = []
    for number, t in enumerate(items):
        s = _slice_of(t.text)
        w = tg.words(s, GAP)
        hashes = tg.window_hash(tg.segment_hash(s.data, w.starts, w.ends), t.k)
        for p, h in enumerate(hashes.view(np.int64).tolist()):
            rows.append((t.k, h, " ".join(t.words[p : p + t.k]), number, p))
    return rows


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", items: list[Template] | None = None) -> DataFrame:
    """One row for each input row: counts, labels, score and the verified spans."""
    spark: SparkSession = docs.sparkSession
    items = templates() if items is None else items
    table = _gram_table(items)
    # The filter travels with the tasks, so it is left out where the templates are many; the join alone then decides.
    small = len(table) <= BROADCAST_GRAMS
    wanted = {k: np.unique(np.array([h for kk, h, *_ in table if kk == k], np.int64)) if small else None for k in {r[0] for r in table}}
    kind = docs.schema[id_col].dataType.simpleString()
    hit_type = pa.list_(pa.struct([("k", pa.int32()), ("hash", pa.int64()), ("pos", pa.int64()), ("gram", pa.string())]))

    def hash_grams(s: tg.Slice, rows: pa.RecordBatch) -> list[pa.Array]:
        s = tg.Slice(s.lo, s.hi, tg.LOWER[s.data], s.offsets)
        data, w = s.data, tg.words(s, GAP)
        hashes = tg.segment_hash(data, w.starts, w.ends)
        found: list[list[dict]] = [[] for _ in range(s.rows)]
        for k, keys in wanted.items():
            grams = tg.window_hash(hashes, k).view(np.int64)
            at = np.flatnonzero(tg.window_valid(w.row, k) if keys is None else tg.window_valid(w.row, k) & np.isin(grams, keys))
            for i in at.tolist():
                gram = " ".join(data[w.starts[j] : w.ends[j]].tobytes().decode("utf-8", "replace") for j in range(i, i + k))
                found[w.row[i]].append({"k": k, "hash": int(grams[i]), "pos": int(i - w.bounds[w.row[i]]), "gram": gram})
        return [rows.column(0), longs(np.diff(w.bounds)), pa.array(found, hit_type)]

    hashed = map_slices(docs, text_col, [id_col], hash_grams, f"{id_col} {kind}, n_words bigint, hits array<struct<k:int,hash:bigint,pos:bigint,gram:string>>")
    grams = spark.createDataFrame(table, "k int, hash bigint, gram string, template int, t_pos int")
    about = spark.createDataFrame([(n, t.label, t.base, len(t.words), t.k) for n, t in enumerate(items)], "template int, label string, base boolean, t_words int, t_k int")
    if small:
        grams, about = F.broadcast(grams), F.broadcast(about)
    # A row id keeps repeated rows apart; it travels with the row from here on and is never recomputed for a lookup.
    rows = hashed.withColumn("_row", F.monotonically_increasing_id())
    hits = rows.select(id_col, "_row", "n_words", F.explode_outer("hits").alias("h")).select(id_col, "_row", "n_words", "h.*")
    votes = (
        hits.join(grams, ["k", "hash", "gram"], "left")
        .groupBy(id_col, "_row", "n_words", "template", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
        .agg(F.collect_set("t_pos").alias("at"))
        .join(about, "template", "left")
    )
    across = Window.partitionBy("_row", "template").orderBy("diagonal")
    spans = (
        votes.withColumn("new", F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(across) > NEAR_DIAGONALS) | F.lag("diagonal").over(across).isNull(), 1).otherwise(0))
        .withColumn("span", F.sum("new").over(across))
        .groupBy(id_col, "_row", "n_words", "template", "label", "base", "t_words", "t_k", "span")
        .agg(F.min("diagonal").alias("start"), F.max("diagonal").alias("last"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
        .withColumn("covered", F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + F.col("t_k") - 1))))))
        .withColumn("cover", F.when(F.col("template").isNotNull(), F.col("covered") / (F.col("t_words") + F.col("last") - F.col("start"))))
        .withColumn("good", F.coalesce(F.when(F.col("base"), F.col("covered") == F.col("t_words")).otherwise(F.col("cover") >= LEAST_COVER), F.lit(False)))
    )
    base = F.col("good") & F.col("base")
    names = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    return spans.groupBy(id_col, "_row", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("good")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("good"), F.least(F.lit(1.0), F.col("cover")))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("good"), F.struct("start", (F.col("last") + F.col("t_words")).alias("end"), "label", "cover")))).alias("spans"),
    ).drop("_row")
