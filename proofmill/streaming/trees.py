"""Keyed tree state with transformWithState: per row only what the row touches, and snapshots to restart from.

State of a key, all in the state store and never loaded whole:
nodes (node: parent, depth; depth 0 is unknown), orphans (a node whose depth is
unknown: its children so far), waiting (a parent that isn't there: the sequence
count at which it was first asked for), asked (a count: how many still wait since
then), gaps, and counters.  A node's depth is set once, when its parent has one,
and then handed down to the orphans below it, so all work follows the new rows.

A key is one task's work by the nature of keyed state; its rows of one
micro-batch are sorted in memory, so a micro-batch should be bounded
(maxFilesPerTrigger).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TREE_SCHEMA = "tree string, last_applied bigint, n_nodes bigint, n_waiting bigint, n_missing bigint, depth int, gaps array<string>"
#: One row of a snapshot: which state, its item, and what it holds.
SNAPSHOT_SCHEMA = "tree string, state string, item string, text string, number bigint, list array<string>"
COUNTERS = ("last_applied", "count", "n_nodes", "n_waiting", "n_missing", "depth")


class TreeProcessor(StatefulProcessor):
    """Rows (tree, sequence, node, parent) in any grouping."""

    def __init__(self, most_tries: int) -> None:
        self.most = most_tries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.nodes = handle.getMapState("nodes", "node string", "parent string, depth int")
        self.orphans = handle.getMapState("orphans", "parent string", "children array<string>")
        self.waiting = handle.getMapState("waiting", "parent string", "since bigint")
        self.asked = handle.getMapState("asked", "since bigint", "n bigint")
        self.gaps = handle.getMapState("gaps", "gap string", "number bigint")
        self.counters = handle.getValueState("counters", ", ".join(f"{c} bigint" for c in COUNTERS))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        c = dict(zip(COUNTERS, self.counters.get() if self.counters.exists() else (-1, 0, 0, 0, 0, 0), strict=True))
        for sequence, group in pd.concat(list(rows)).sort_values(["sequence", "node"]).groupby("sequence"):
            if sequence <= c["last_applied"]:
                continue
            c["last_applied"], c["count"] = int(sequence), c["count"] + 1
            # Who has waited for as many sequences as allowed is missing from now on.
            due = c["count"] - self.most
            if self.asked.containsKey((due,)):
                n = self.asked.getValue((due,))[0]
                self.asked.removeKey((due,))
                c["n_missing"], c["n_waiting"] = c["n_missing"] + n, c["n_waiting"] - n
            fresh = []
            for node, parent in zip(group["node"], group["parent"], strict=True):
                parent = parent if isinstance(parent, str) else ""
                if not self.nodes.containsKey((node,)):
                    self._put(node, parent, c)
                    fresh.append(parent)
                elif self.nodes.getValue((node,))[0] != parent and not self.gaps.containsKey((f"parent:{node}",)):
                    self.gaps.updateValue((f"parent:{node}",), (c["count"],))
            for parent in fresh:
                if parent and not self.nodes.containsKey((parent,)) and not self.waiting.containsKey((parent,)):
                    self.waiting.updateValue((parent,), (c["count"],))
                    self._count(c["count"], 1)
                    c["n_waiting"] += 1
        self.counters.update(tuple(c[k] for k in COUNTERS))
        gaps = [g[0] for g in sorted(self.gaps.keys())]
        yield pd.DataFrame([(str(key[0]), c["last_applied"], c["n_nodes"], c["n_waiting"], c["n_missing"], c["depth"], gaps)], columns=[f.split()[0] for f in TREE_SCHEMA.split(", ")])

    def _count(self, since: int, more: int) -> None:
        n = (self.asked.getValue((since,))[0] if self.asked.containsKey((since,)) else 0) + more
        if n:
            self.asked.updateValue((since,), (n,))
        else:
            self.asked.removeKey((since,))

    def _put(self, node: str, parent: str, c: dict) -> None:
        c["n_nodes"] += 1
        if self.waiting.containsKey((node,)):
            since = self.waiting.getValue((node,))[0]
            self.waiting.removeKey((node,))
            if since <= c["count"] - self.most:
                c["n_missing"] -= 1
            else:
                c["n_waiting"] -= 1
                self._count(since, -1)
        above = 0 if not parent else self.nodes.getValue((parent,))[1] if self.nodes.containsKey((parent,)) else None
        depth = 1 if not parent else above + 1 if above else 0
        self.nodes.updateValue((node,), (parent, depth))
        if not depth:
            known = list(self.orphans.getValue((parent,))[0]) if self.orphans.containsKey((parent,)) else []
            self.orphans.updateValue((parent,), ([*known, node],))
            return
        todo = [(node, depth)]
        while todo:
            at, d = todo.pop()
            c["depth"] = max(c["depth"], d)
            if self.orphans.containsKey((at,)):
                for child in self.orphans.getValue((at,))[0]:
                    self.nodes.updateValue((child,), (at, d + 1))
                    todo.append((child, d + 1))
                self.orphans.removeKey((at,))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:  # noqa: N802, N803
        counters = {}
        for r in initialState.itertuples():
            if r.state == "nodes":
                self.nodes.updateValue((r.item,), (r.text, int(r.number)))
            elif r.state == "orphans":
                self.orphans.updateValue((r.item,), (list(r.list),))
            elif r.state == "waiting":
                self.waiting.updateValue((r.item,), (int(r.number),))
            elif r.state == "asked":
                self.asked.updateValue((int(r.item),), (int(r.number),))
            elif r.state == "gaps":
                self.gaps.updateValue((r.item,), (int(r.number),))
            else:
                counters[r.item] = int(r.number)
        self.counters.update(tuple(counters[c] for c in COUNTERS))

    def close(self) -> None:
        pass


def tree_state(stream: DataFrame, key: str, sequence: str, node: str, parent: str, most_tries: int = 2, start: DataFrame | None = None) -> DataFrame:
    """A tree for each key built from rows (sequence, node, parent) in any grouping.

    A sequence at or below the last applied one is a replay and changes nothing;
    the first row of a node wins, a later one with another parent is a gap; a
    parent that isn't there is waited for, and missing after `most_tries` more
    sequences.  A null parent is a root; rows with a null key, sequence or node
    are no evidence and are left out.  start is a snapshot's rows to go on from.
    """
    rows = stream.select(F.col(key).cast("string").alias("tree"), F.col(sequence).cast("bigint").alias("sequence"), F.col(node).cast("string").alias("node"), F.col(parent).cast("string").alias("parent"))
    keyed = rows.dropna(subset=["tree", "sequence", "node"]).groupBy("tree")
    return keyed.transformWithStateInPandas(TreeProcessor(most_tries), TREE_SCHEMA, "Update", "None", None if start is None else start.groupBy("tree"))


def state_rows(spark: SparkSession, checkpoint: str, name: str, batch: int | None = None) -> DataFrame:
    """The rows of one state variable as they were after a batch, by default the last."""
    reader = spark.read.format("statestore").option("stateVarName", name)
    return (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)


def tree_snapshot(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """The whole state of a tree_state query as rows of SNAPSHOT_SCHEMA, read from its checkpoint."""
    none = {"item": F.lit(None), "text": F.lit(None), "number": F.lit(None), "list": F.lit(None)}
    kinds = {"item": "string", "text": "string", "number": "bigint", "list": "array<string>"}

    def rows(name: str, **have: str) -> DataFrame:
        got = none | {k: F.col(v) for k, v in have.items()}
        return state_rows(spark, checkpoint, name, batch).select(F.col("key.tree").alias("tree"), F.lit(name).alias("state"), *[got[k].cast(t).alias(k) for k, t in kinds.items()])

    counters = state_rows(spark, checkpoint, "counters", batch).select(F.col("key.tree").alias("tree"), F.lit("counters").alias("state"), F.explode(F.create_map(*[x for c in COUNTERS for x in (F.lit(c), F.col(f"value.{c}"))])).alias("item", "number"))
    out = counters.select("tree", "state", "item", none["text"].cast("string").alias("text"), "number", none["list"].cast("array<string>").alias("list"))
    for part in (
        rows("nodes", item="user_map_key.node", text="user_map_value.parent", number="user_map_value.depth"), rows("orphans", item="user_map_key.parent", list="user_map_value.children"),
        rows("waiting", item="user_map_key.parent", number="user_map_value.since"), rows("asked", item="user_map_key.since", number="user_map_value.n"), rows("gaps", item="user_map_key.gap", number="user_map_value.number"),
    ):
        out = out.unionByName(part)
    return out


def snapshot_digest(rows: DataFrame) -> str:
    """A digest of a snapshot that doesn't depend on the order or the partitions of its rows."""
    # Two sums of independent 64-bit hashes and the count: one row to the driver.
    text = F.to_json(F.struct(*rows.columns))
    got = rows.agg(F.count("*").alias("n"), *[F.sum(F.xxhash64(F.lit(seed), text).cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)]).first()
    return f"{got.n}:{got.s1 or 0}:{got.s2 or 0}"


def save_snapshot(rows: DataFrame, at: str) -> str:
    """Write a snapshot and beside it its digest, last; returns the digest."""
    rows.write.parquet(f"{at}/state")
    digest = snapshot_digest(rows.sparkSession.read.parquet(f"{at}/state"))
    rows.sparkSession.createDataFrame([(digest,)], "digest string").coalesce(1).write.json(f"{at}/digest")
    return digest


def load_snapshot(spark: SparkSession, at: str) -> DataFrame:
    """The rows of a saved snapshot; one that is unfinished or changed is refused."""
    rows = spark.read.schema(SNAPSHOT_SCHEMA).parquet(f"{at}/state")
    if [r.digest for r in spark.read.schema("digest string").json(f"{at}/digest").collect()] != [snapshot_digest(rows)]:
        raise ValueError(f"the snapshot {at} isn't what was saved")
    return rows
