"""Writers: guarded CSV, JSON lines, write-once output, partitioned outputs and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.functions.text import guard_formula
from proofmill.sources.readers import inventory

LIST_SEPARATOR = "；"


def flat_for_csv(df: DataFrame, ids: tuple[str, ...] = (), guard: bool = True) -> DataFrame:
    """Every column as text: lists of texts joined, other nested values as JSON, ids kept as text by an
    apostrophe, texts that a spreadsheet would run guarded."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "array<string>":
            c = F.array_join(c, LIST_SEPARATOR)
        elif kind.startswith(("array", "struct", "map")):
            c = F.to_json(c)
        elif kind == "string" and name in ids:
            c = F.concat(F.lit("'"), c)
        elif kind == "string" and guard:
            c = guard_formula(c)
        out.append(c.cast("string").alias(name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, ids: tuple[str, ...] = (), guard: bool = True, line_end: str = "\n") -> None:
    """A folder of quoted CSV files with headers; an existing folder is refused."""
    flat_for_csv(df, ids, guard).write.mode("errorifexists").csv(path, header=True, quoteAll=True, escape='"', lineSep=line_end, emptyValue="")


def write_jsonl(df: DataFrame, path: str) -> None:
    """A folder of JSON lines, NULL fields written; an existing folder is refused."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines without NaN or infinity: a value that isn't a finite number is an error."""
    bad = {c: F.when(F.isnan(c) | F.abs(F.col(c)).eqNullSafe(float("inf")), F.raise_error(F.lit(f"{c} isn't finite")).cast("double")).otherwise(F.col(c)) for c, kind in df.dtypes if kind == "double"}
    write_jsonl(df.withColumns(bad) if bad else df, path)


def write_partitioned(df: DataFrame, path: str, key: str, domain: list[str]) -> None:
    """A folder for each value of the domain, also for those without rows."""
    df.write.mode("errorifexists").partitionBy(key).parquet(path)
    have = {r[0] for r in df.filter(F.col(key).isin(*domain)).select(key).distinct().collect()}
    for value in domain:
        if value not in have:
            df.drop(key).limit(0).write.mode("errorifexists").parquet(f"{path}/{key}={value}")


def write_manifest(spark, folder: str, path: str) -> None:
    """(path, bytes, sha256) of every data file of a written folder, as JSON lines."""
    write_jsonl(inventory(spark, folder).filter(~F.col("path").rlike(r"(^|/)[_.]")), path)


def verify_manifest(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """Files that changed, are missing or are new against a manifest."""
    from proofmill.operators.joins import reconcile

    now = inventory(spark, folder).filter(~F.col("path").rlike(r"(^|/)[_.]"))
    return reconcile(manifest.select("path", "bytes", "sha256"), now, ["path"], ["bytes", "sha256"]).filter("status <> 'same'")


def split_long(df: DataFrame, key: str, column: str, most: int = 30_000) -> DataFrame:
    """Long texts as numbered parts of at most `most` characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(column) - 1, F.lit(0)), F.lit(most))
    return df.select(key, column, F.posexplode(starts).alias("part", "_at")).select(key, "part", F.substring(column, F.col("_at") + 1, F.lit(most)).alias(column))


def write_markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A summary of at most `most` rows as a Markdown table; it is a report, not the data."""
    rows = df.limit(most).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return f"# {title}\n\n{head}\n" + "".join("| " + " | ".join(cell(v) for v in r) + " |\n" for r in rows)
