"""Queries that run as streams over the event and conversation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.catalog import query, table
from proofmill.folders import shared_folder
from proofmill.streaming import control as C
from proofmill.streaming import state as S
from proofmill.streaming import trees as TR


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    # A stream reads folders; a table that is one file is the only file of its name in the folder above.
    df = reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


@query("SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY 1")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.newest(_stream(spark, sf_dir, "events").withColumn("arrival", F.col("event_id")), "user_id", "ts", "arrival", "value")
    return S.latest_rows(S.available_now(found, "update"), ["user_id"]).select("user_id", F.col("arrival").alias("event_id"), "value")


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    return S.available_now(S.unique_events(events, ["user_id", "event_type"], "ts", "3650 days")).select("user_id", "event_type")


@query("SELECT CAST(conv_id AS VARCHAR) AS tree, max(turn) AS last_applied, count(DISTINCT turn) AS n_nodes FROM conversations GROUP BY 1")
def stream_tree_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _stream(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("sequence"), F.col("turn").alias("node"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent"))
    found = S.tree_state(turns, "conv_id", "sequence", "node", "parent")
    return S.latest_rows(S.available_now(found, "update"), ["tree"]).select("tree", "last_applied", "n_nodes")


@query("SELECT a.event_id, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts - INTERVAL 2 HOUR AND a.ts + INTERVAL 2 HOUR")
def stream_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir, "events")
    left = events.filter("event_type = 'click'").select("user_id", "event_id", "ts")
    right = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("other"), F.col("ts").alias("ts_b"))
    return S.available_now(S.paired(left, right, ["user_id"], "ts", "ts_b", "1 day", "2 HOURS")).select("event_id", "other")


def _parts(df: DataFrame, by: Column, parts: int, *, files: int = 1) -> str:
    """df written as so many sets of files one after the other, so that a stream that takes `files` files a batch gets them in turn."""
    at = shared_folder(df.sparkSession)
    for n in range(parts):
        df.filter(by == n).coalesce(files).write.mode("append").parquet(at)
    return at


def _read(spark: SparkSession, df: DataFrame, at: str) -> DataFrame:
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)


@query("SELECT CAST(conv_id AS VARCHAR) AS tree, max(turn) AS last_applied, count(DISTINCT turn) AS n_nodes, max(turn) + 1 AS depth FROM conversations GROUP BY 1 HAVING max(turn) + 1 = count(DISTINCT turn)")
def stream_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree stream stops after the even conversations and the first turns of the odd ones; its state is read as a table, saved, and a new stream goes on from it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent"))
    later = ((F.col("conv_id") % 2 == 1) & (F.col("turn") > 1)).cast("int")
    first, second = shared_folder(spark), shared_folder(spark)
    turns.filter(later == 0).write.parquet(first)
    turns.filter(later == 1).write.parquet(second)
    one, two, saved = shared_folder(spark), shared_folder(spark), shared_folder(spark)
    read = lambda at: spark.readStream.schema(turns.schema).parquet(at)
    C.run_controlled(TR.tree_state(read(first), "conv_id", "turn", "turn", "parent"), one, mode="update")
    TR.save_snapshot(TR.tree_snapshot(spark, f"{one}/checkpoint"), saved)
    C.run_controlled(TR.tree_state(read(second), "conv_id", "turn", "turn", "parent", start=TR.load_snapshot(spark, saved)), two, mode="update")
    found = TR.state_rows(spark, f"{two}/checkpoint", "counters").select(F.col("key.tree").alias("tree"), "value.last_applied", "value.n_nodes", "value.depth")
    return found.filter(F.col("last_applied") + 1 == F.col("n_nodes"))  # those without a gap in their turns


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, 2 AS runs FROM events GROUP BY 1")
def stream_paused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A control table holds the stream before its third batch; after a row that lets it go on, nothing is missing or twice."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    at, control = shared_folder(spark), shared_folder(spark)
    stream = _read(spark, events, _parts(events, F.col("event_id") % 4, 4))
    say = lambda status: spark.createDataFrame([(2, status, None)], C.CONTROL_SCHEMA).coalesce(1).write.mode("append").json(control)
    runs = 0
    for status in ("paused", "running"):
        say(status)
        runs += 1
        if C.run_controlled(stream, at, C.control_table(spark, control)) == "done":
            break
    rows = C.sink_rows(spark, at, events.schema)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).withColumn("runs", F.lit(runs))


@query("SELECT 'events' AS source, event_id AS id FROM events WHERE event_id % 3 < 2 UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_orderkey % 3 < 2")
def stream_finalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream is held after two batches, the other is ahead; what both have committed is delivered."""
    runs = []
    for name, key in (("events", "event_id"), ("orders", "o_orderkey")):
        rows = table(spark, sf_dir, name).select(F.lit(name).alias("source"), F.col(key).alias("id"))
        at = shared_folder(spark)
        C.run_controlled(_read(spark, rows, _parts(rows, F.col("id") % 3, 3)), at, (lambda n: "paused" if n == 2 else None) if name == "orders" else None)
        runs.append((at, rows.schema))
    (a, b), _ = C.finalized(spark, runs)
    return a.unionByName(b).drop("batch")


@query("SELECT 4 AS batches, count(*) AS input_rows, count(*) AS observed_rows, CAST(sum(event_id) AS BIGINT) AS observed_ids, count(*) AS sink_rows FROM events")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each batch with what it observed; together they are the rows of the sink."""
    events = table(spark, sf_dir, "events").select("event_id")
    at, progress = shared_folder(spark), shared_folder(spark)
    stream = _read(spark, events, _parts(events, F.col("event_id") % 4, 4)).observe("seen", F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    C.run_controlled(stream, at, progress=progress)
    seen = F.from_json("observed", "struct<seen:struct<n:bigint,ids:bigint>>").seen
    rows = spark.read.schema(C.PROGRESS_SCHEMA).json(progress)
    out = rows.agg(F.count_distinct("batch").cast("int").alias("batches"), F.sum("input_rows").alias("input_rows"), F.sum(seen.n).alias("observed_rows"), F.sum(seen.ids).alias("observed_ids"))
    return out.withColumn("sink_rows", F.lit(C.sink_rows(spark, at, events.schema).count()))
