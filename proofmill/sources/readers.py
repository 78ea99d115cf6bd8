"""Readers of evidence files: committed journals, JSON documents, inventories, archives, framed responses.

Journals are read as splittable text, so a large journal is many tasks; whether
its last line is committed follows from byte counts, not from loading the file.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmill.functions.text import portable_name, whole_json


def json_documents(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON object for each file, a byte-order mark allowed; a file that isn't one is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("text"))
    return raw.select("file", F.from_json("text", schema, {"mode": "FAILFAST"}).alias("d")).select("file", "d.*")


def journal_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """File, line (from 1), text, committed and valid_utf8 of each line.

    A line counts only if a line feed ends it.  The bytes of a file's lines with
    a line feed each add up to the file's size exactly if the last one is
    committed (a byte-order mark, which the reader skips, takes three more).
    """
    rows = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("text")
    )
    # Lines are numbered inside their block of the file; a short table of blocks gives each the lines before it.
    blocks = rows.groupBy("file", "_block", "_size").agg(F.count("*").alias("_rows"), F.sum(F.octet_length("text") + 1).alias("_b"))
    whole = Window.partitionBy("file")
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = F.sum("_b").over(whole).isin(F.col("_size"), F.col("_size") - 3)
    placed = blocks.select("file", "_block", before.alias("_before"), F.sum("_rows").over(whole).alias("_n"), ends.alias("_ends"))
    inside = F.row_number().over(Window.partitionBy("file", "_block").orderBy("_at"))
    marked = rows.withColumn("_in", inside).join(placed, ["file", "_block"]).withColumn("line", (F.col("_in") + F.col("_before")).cast("int"))
    return marked.select("file", "line", "text", (F.col("_ends") | (F.col("line") < F.col("_n"))).alias("committed"), F.is_valid_utf8("text").alias("valid_utf8"))


def committed_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """File, line and fields of the committed records; a bad committed line is an error that names its line."""
    lines = journal_lines(spark, path).filter("committed")
    object_ = F.col("valid_utf8") & F.coalesce(F.schema_of_variant(whole_json(F.col("text"))).startswith("OBJECT"), F.lit(False))
    bad = F.concat(F.lit("bad committed line "), F.col("line").cast("string"), F.lit(" of "), F.col("file"))
    checked = F.when(object_, F.col("text")).otherwise(F.raise_error(bad).cast("string"))
    return lines.select("file", "line", F.from_json(checked, schema).alias("d")).select("file", "line", "d.*")


def tolerant_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """Records, and a gap (file, line) for each line that isn't a JSON object; empty lines are neither."""
    lines = journal_lines(spark, path).filter(F.trim("text") != "")
    object_ = F.coalesce(F.schema_of_variant(whole_json(F.col("text"))).startswith("OBJECT"), F.lit(False))
    good = lines.filter(object_).select("file", "line", F.from_json("text", schema).alias("d")).select("file", "line", "d.*")
    return good, lines.filter(~object_).select("file", "line")


def ordered_journals(spark: SparkSession, history: DataFrame, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """Records of the files that a history (pos, path) declares, by (pos, line), and typed issues.

    The list of paths is a checkpoint's own, as short as its number of batches.
    """
    bad_name = F.when(~F.col("path").endswith(".jsonl"), "NOT_JSONL").when(F.col("path").startswith("//") | F.col("path").startswith("\\\\"), "UNC_PATH")
    seen = F.count("*").over(Window.partitionBy("path"))
    judged = history.withColumn("code", F.coalesce(bad_name, F.when(seen > 1, "REPEATED_FILE")))
    names = [r.path for r in judged.filter("code is null").select("path").collect()]
    there = [n for n in names if _exists(spark, n)]
    missing = spark.createDataFrame([(n,) for n in names if n not in there], "path string").select("path", F.lit("MISSING_FILE").alias("code"))
    issues = judged.filter("code is not null").select("path", "code").unionByName(missing)
    if not there:
        return spark.createDataFrame([], T.StructType([T.StructField("pos", T.LongType()), T.StructField("line", T.IntegerType())])), issues
    lines = journal_lines(spark, there)
    # Whole qualified paths: the reader's are percent-encoded, the history's are as they were declared.
    full = spark.createDataFrame([(n, _qualified(spark, n)) for n in there], "_path string, _k string")
    at = history.join(full, F.col("path") == F.col("_path")).select("pos", "_k")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    placed = lines.join(at, plain(F.col("file")) == plain(F.col("_k")))
    torn = placed.filter("not committed").select(F.col("file").alias("path"), F.lit("NO_FINAL_LINE_FEED").alias("code"))
    parsed = placed.filter("committed").withColumn("d", F.from_json("text", schema))
    broken = placed.filter(F.col("committed") & whole_json(F.col("text")).isNull()).select(F.col("file").alias("path"), F.lit("BAD_LINE").alias("code"))
    good = parsed.filter(whole_json(F.col("text")).isNotNull()).select("pos", "line", "d.*")
    return good, issues.unionByName(torn).unionByName(broken)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as a file reader reports it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()


def optional(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines of a file, or an empty relation where it is missing; other errors stay errors."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Path below the folder, bytes and SHA-256 of every file.

    The file reader passes over empty files; their names come from a listing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    empty = spark.createDataFrame([(n, 0, bytearray()) for n in _empty_files(spark, path)], "path string, length bigint, content binary")
    root = F.regexp_replace(F.lit(path), "^file:/*", "/")
    name = F.regexp_replace("path", "^file:/*", "/")
    return files.select("path", "length", "content").union(empty).select(F.substring(name, F.length(root) + 2, F.length(name)).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    names = []
    while found.hasNext():
        f = found.next()
        if f.getLen() == 0:
            names.append(f.getPath().toString())
    return names


def checked_batches(spark: SparkSession, path: str) -> DataFrame:
    """Numbered batch files and why one is refused: name, envelope, sequence or hash."""
    return batch_faults(spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file"), F.col("value")))


def batch_faults(raw: DataFrame) -> DataFrame:
    """The same for batches held as rows (file, value)."""
    v = whole_json(F.col("value"))
    number = F.regexp_extract("file", r"^(\d{8})\.json$", 1)
    record = F.regexp_extract("value", r'(?s)"record"\s*:\s*(\{.*\})\s*,\s*"sha256"', 1)
    why = (
        F.when(number == "", "NAME").when(v.isNull(), "ENVELOPE")
        .when(~F.coalesce(F.try_variant_get(v, "$.record.sequence", "bigint"), F.lit(-1)).eqNullSafe(number.try_cast("bigint")), "SEQUENCE")
        .when(~F.sha2(record, 256).eqNullSafe(F.try_variant_get(v, "$.sha256", "string")), "HASH")
    )
    return raw.select("file", record.alias("record"), why.alias("refused"))


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of ZIP archives with bytes, SHA-256 and the rule that a name breaks, if it does."""

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for frame in frames:
            rows = []
            for archive, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.infolist():
                        odd = "encrypted" if m.flag_bits & 1 else "link" if (m.external_attr >> 28) == 0xA else None
                        data = b"" if m.is_dir() or odd == "encrypted" else z.read(m)
                        rows.append((archive, m.filename, m.file_size, hashlib.sha256(data).hexdigest(), odd))
            yield pd.DataFrame(rows, columns=["archive", "member", "bytes", "sha256", "odd"])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, member string, bytes bigint, sha256 string, odd string")
    again = F.count("*").over(Window.partitionBy("archive", F.lower("member"))) > 1
    return found.select("archive", "member", "bytes", "sha256", F.coalesce("odd", portable_name(F.col("member")), F.when(again, "collision")).alias("refused"))


def front_matter(text: Column) -> Column:
    """The flat key: value lines between two --- lines at the start, as a map; NULL without them."""
    body = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---(?:\n|$)", 1)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^[A-Za-z0-9_-]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([^:]+):", 1).alias("key"), F.regexp_replace(F.regexp_extract(x, r"^[^:]+:\s*(.*)$", 1), r"^([\"'])(.*)\1$", "$2").alias("value")))
    return F.when(body != "", F.map_from_entries(pairs))


def framed_responses(responses: DataFrame, key: str, body: str, items: str, cursor: str, final: str) -> DataFrame:
    """For each response: frames, bad frames, number of items, the last cursor and whether a frame was final.

    Frames are lines, each with an optional guard for(;;); `items`, `cursor`
    and `final` are paths in a frame.
    """
    line = F.trim(F.regexp_replace("_line", r"^for\s*\(;;\);", ""))
    frames = responses.select(key, F.posexplode(F.split(body, r"\r?\n")).alias("_n", "_line")).select(key, "_n", line.alias("_line")).filter("_line <> ''")
    v = frames.withColumn("_v", whole_json(F.col("_line")))
    got = F.try_variant_get("_v", cursor, "string")
    return v.groupBy(key).agg(
        F.count_if(F.col("_v").isNotNull()).alias("frames"),
        F.count_if(F.col("_v").isNull()).alias("bad_frames"),
        F.sum(F.coalesce(F.size(F.try_variant_get("_v", items, "array<variant>")), F.lit(0))).alias("n_items"),
        F.max_by(got, F.when(got.isNotNull(), F.col("_n"))).alias("cursor"),
        F.coalesce(F.bool_or(F.try_variant_get("_v", final, "boolean")), F.lit(False)).alias("final"),
    )


def script_json(html: Column) -> Column:
    """The JSON texts of a page's application/json script elements."""
    return F.regexp_extract_all(html, F.lit(r"(?s)<script[^>]*application/json[^>]*>(.*?)</script>"), 1)


def page_links(html: Column) -> Column:
    """Distinct link targets of a stored page, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""<a[^>]*\shref=["']([^"']*)["']"""), 1))


def catalog_issues(entries: DataFrame) -> DataFrame:
    """Entries (name, path) with the rule each breaks: name, duplicate or a path that leaves the root."""
    again = F.count("*").over(Window.partitionBy("name")) > 1
    return entries.withColumn("refused", F.when(~F.col("name").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), "name").when(again, "duplicate").otherwise(portable_name(F.col("path"))))


