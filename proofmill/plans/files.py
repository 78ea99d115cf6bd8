"""Queries that write rows to the shared folder and read them back with the library's readers."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.catalog import query, table
from proofmill.folders import shared_folder
from proofmill.sources import publishing as PB
from proofmill.sources import readers as R
from proofmill.sources import sinks as S


@query("SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def committed_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines written and read as committed records."""
    at = shared_folder(spark)
    S.write_jsonl(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), at)
    rows = R.committed_jsonl(spark, at, "o_orderkey bigint, o_orderstatus string")
    return rows.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT 'record' AS kind, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'gap', count(*) FROM orders WHERE o_orderstatus = 'P'")
def tolerant_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no JSON objects are gaps, not errors."""
    at = shared_folder(spark)
    line = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit('{"k": '), F.col("o_orderkey").cast("string"))).otherwise(F.to_json(F.struct(F.col("o_orderkey").alias("k"))))
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(at)
    good, gaps = R.tolerant_jsonl(spark, at, "k bigint")
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(good, "record").unionByName(count(gaps, "gap"))


@query("SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END AS pos, o_orderkey AS k FROM orders")
def journals_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of several journals with the place that the history gives each file."""
    at = shared_folder(spark)
    rows = table(spark, sf_dir, "orders").withColumn("pos", F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 0).otherwise(1))
    names = []
    for pos in (0, 1):
        rows.filter(F.col("pos") == pos).select(F.to_json(F.struct(F.col("o_orderkey").alias("k"))).alias("value")).coalesce(1).write.option("compression", "none").text(f"{at}/{pos}")
        found = spark.read.text(f"{at}/{pos}").select("_metadata.file_path").distinct().collect()  # one file
        names += [(pos, r.file_path) for r in found]
        # A history names journals by their ending; the writer's part files are renamed to it.
        names[-1] = (pos, _renamed(spark, names[-1][1], f"{at}/{pos}.jsonl"))
    good, _ = R.ordered_journals(spark, spark.createDataFrame(names, "pos int, path string"), "k bigint")
    return good.select("pos", "k")


def _renamed(spark: SparkSession, old: str, new: str) -> str:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    source = path(spark.sparkContext._jvm.java.net.URI(old))
    source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(source, path(new))
    return new


@query("SELECT n_nationkey, n_name, 'there' AS source FROM nation")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object for each file; a source that is missing has no rows."""
    at = shared_folder(spark)
    nations = table(spark, sf_dir, "nation")
    nations.select("n_nationkey", "n_name", F.col("n_nationkey").alias("file")).repartition("file").write.partitionBy("file").json(at)
    there = R.json_documents(spark, f"{at}/*/*.json", "n_nationkey bigint, n_name string").select("n_nationkey", "n_name", F.lit("there").alias("source"))
    return there.unionByName(R.optional(spark, f"{at}/missing.json", "n_nationkey bigint, n_name string").withColumn("source", F.lit("missing")))


@query("SELECT n_nationkey, CAST(strlen(n_name) + 1 AS BIGINT) AS bytes, sha256(n_name || chr(10)) AS sha256 FROM nation")
def inventory_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and hash of every file of a folder."""
    at = shared_folder(spark)
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"), F.col("n_nationkey").alias("file")).repartition("file").write.partitionBy("file").text(at)
    files = R.inventory(spark, at).filter(F.col("path").endswith(".txt"))
    return files.select(F.regexp_extract("path", r"file=(\d+)/", 1).cast("int").alias("n_nationkey"), "bytes", "sha256")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '''=' ELSE '' END || c_name AS name, '''' || c_custkey AS id, c_mktsegment || '；' || c_name AS tags FROM customer""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded and quoted CSV, read back as text."""
    at = shared_folder(spark)
    name = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("="), "c_name")).otherwise(F.col("c_name"))
    S.write_csv(table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), F.col("c_custkey").cast("string").alias("id"), F.array("c_mktsegment", "c_name").alias("tags")), at, ids=("id",))
    return spark.read.schema("c_custkey bigint, name string, id string, tags string").csv(at, header=True, escape='"')


@query("SELECT p_partkey, p_retailprice AS price FROM part")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report without NaN or infinity."""
    at = shared_folder(spark)
    S.write_report(table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price")), at)
    return spark.read.schema("p_partkey bigint, price double").json(at)


@query("SELECT s AS status, count(o_orderkey) AS n FROM (SELECT unnest(['F', 'O', 'P', 'none']) AS s) LEFT JOIN orders ON o_orderstatus = s GROUP BY 1")
def partitioned_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each decision, also for those without rows."""
    at = shared_folder(spark)
    domain = ["F", "O", "P", "none"]
    S.write_partitioned(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), at, "o_orderstatus", domain)
    out = None
    for value in domain:
        n = spark.read.parquet(f"{at}/o_orderstatus={value}").agg(F.lit(value).alias("status"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT doc_id, CAST(i AS INTEGER) AS part, md5(substr(text, i * 1000 + 1, 1000)) AS piece FROM (SELECT doc_id, text, unnest(range(greatest(1, (length(text) + 999) // 1000))) AS i FROM documents WHERE text IS NOT NULL)")
def long_text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts in numbered parts."""
    parts = S.split_long(table(spark, sf_dir, "documents").filter("text is not null"), "doc_id", "text", 1000)
    return parts.select("doc_id", "part", F.md5("text").alias("piece"))


@query("SELECT o_orderstatus AS status, count(*) AS n, CASE o_orderstatus WHEN 'P' THEN 'O' END AS target, 2 AS version FROM orders GROUP BY 1")
def published_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review published twice, the second time after an attempt that fails between its outputs; what is read is the last whole set."""
    at = shared_folder(spark)
    orders = table(spark, sf_dir, "orders")
    facts = orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    seen = facts.select("status", (F.col("status") == "P").alias("eligible"), F.lit("O").alias("target"))
    bundle = PB.review_bundle(facts, seen, "Orders", True)
    PB.publish(spark, at, bundle)
    failing = bundle | {"late": orders.select(F.raise_error(F.lit("lost")).cast("string").alias("x"))}
    with contextlib.suppress(Exception):
        PB.publish(spark, at, failing)
    PB.recover(spark, at)
    version = PB.publish(spark, at, bundle)
    folder = PB.published(spark, at)
    proposal = spark.read.json(f"{folder}/proposal.json").select(F.explode("targets").alias("target"))
    rows = spark.read.schema("status string, n bigint").json(f"{folder}/facts")
    seen = spark.read.schema("status string, eligible boolean, target string").json(f"{folder}/observations").filter("eligible").join(proposal, "target").select(F.col("status").alias("_s"), "target")
    return rows.join(seen, F.col("status") == F.col("_s"), "left").select("status", "n", "target", F.lit(version).alias("version"))
