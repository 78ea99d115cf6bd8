"""JSON of any depth as rows: a frontier of variants that is taken apart level by level until no container is left.

Each level is one lateral explode of the containers of the level before, written
to the shared folder: no Python worker, no limit of depth or length, and a lost
executor costs one level's tasks.  Rows of one document are independent of each
other, so a huge document spreads over tasks after its first level.

Defined cases: a text that is null, no JSON, repeats a key within an object or is
larger than a variant can be has no rows (`unread` lists it); an empty object or
array is a row without children; rows with equal or null keys stay apart as
separate rows of the result; the key's name must not be one of the result's; other
columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.folders import written
from proofmill.functions.text import whole_json

#: Fixed value: what a made-up entry of a shared file looks like.
PLACEHOLDER = r"^(?:REPLACE_WITH|PLACEHOLDER)(?:_[A-Z0-9]+)+$"
TYPES = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def _token(name: Column) -> Column:
    """A field name inside an RFC 6901 pointer."""
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def variant_type(v: Column) -> Column:
    """object, array, string, boolean, null or number."""
    head = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return F.coalesce(*[F.when(head == k, name) for k, name in TYPES.items()], F.when(v.isNotNull(), "number"))


def variant_levels(df: DataFrame, key: str, column: str, stop: Callable[[Column], Column] | None = None, deepest: int | None = None) -> DataFrame:
    """A row for each value: key, pointer, path, name, type, depth, v, stopped.

    stop tells of an object that it isn't to be taken apart; deepest is the last
    level that is.
    """
    session = df.sparkSession
    parsed = df.select(F.col(key).alias("_k"), whole_json(F.col(column)).alias("v")).filter("v is not null")
    level = parsed.select("_k", F.lit("").alias("pointer"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), "v")
    levels: list[DataFrame] = []
    while deepest is None or len(levels) <= deepest:
        ends = F.coalesce(stop(F.col("v")) & (F.col("type") == "object"), F.lit(False)) if stop else F.lit(False)
        level = written(level.withColumn("type", variant_type(F.col("v"))).withColumn("depth", F.lit(len(levels))).withColumn("stopped", ends))
        levels.append(level)
        inner = level.filter(F.col("type").isin("object", "array") & ~F.col("stopped"))
        if inner.isEmpty():
            break
        # pos, key and value of each field or element; elements have no key.
        child = inner.select("_k", "pointer", "path", F.col("v").alias("parent")).lateralJoin(session.tvf.variant_explode(F.col("parent").outer()))
        field = F.coalesce("key", F.col("pos").cast("string"))
        level = child.select(
            "_k", F.concat("pointer", F.lit("/"), _token(field)).alias("pointer"),
            F.concat("path", F.when(F.col("key").isNull(), F.concat(F.lit("["), field, F.lit("]"))).otherwise(F.concat(F.lit("."), field))).alias("path"),
            F.col("key").alias("name"), F.col("value").alias("v"),
        )
    out = levels[0]
    for one in levels[1:]:
        out = out.unionByName(one)
    return out.withColumnRenamed("_k", key)


def json_tree(df: DataFrame, key: str, column: str) -> DataFrame:
    """Key, pointer, name (NULL in arrays), type, value of every value at any depth; containers have no value."""
    scalar = F.when(~F.col("type").isin("object", "array", "null"), F.try_variant_get("v", "$", "string"))
    return variant_levels(df, key, column).select(key, "pointer", "name", "type", scalar.alias("value"), "depth")


def unread(df: DataFrame, key: str, column: str) -> DataFrame:
    """Keys of texts that can't be taken apart though they are there."""
    return df.filter(F.col(column).isNotNull() & whole_json(F.col(column)).isNull()).select(key)


def marked_objects(df: DataFrame, key: str, column: str, marks: Sequence[str], deepest: int | None = None) -> DataFrame:
    """Key, path, pointer, object of each outermost object that has all fields of marks, whatever their values."""
    rows = variant_levels(df, key, column, lambda v: _all(v, marks), deepest)
    return rows.filter("stopped").select(key, "path", "pointer", F.to_json("v").alias("object"))


def _all(v: Column, marks: Sequence[str]) -> Column:
    out = F.lit(True)
    for m in marks:
        out = out & F.try_variant_get(v, f"$['{m}']", "variant").isNotNull()
    return out


def distinct_values(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """The different text values of fields called name, at any depth, by key: such as the media types of an attachment tree."""
    found = json_tree(df, key, column).filter((F.col("name") == name) & (F.col("type") == "string"))
    return found.groupBy(key).agg(F.array_sort(F.collect_set("value")).alias("found"))


def json_faults(df: DataFrame, key: str, column: str, forbidden: Sequence[str], patterns: Mapping[str, str], made_up: Sequence[str] = ()) -> DataFrame:
    """key, pointer, fault of every field whose bare name is forbidden, every text that a pattern matches, and every element of a list called as in made_up that is no placeholder.

    A bare name has letters and digits only, in lower case.
    """
    tree = json_tree(df, key, column)
    bare = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    text = F.col("type") == "string"
    listed = bare(F.regexp_extract("pointer", r"/([^/]*)/\d+$", 1)).isin(*made_up) & F.col("name").isNull() if made_up else F.lit(False)
    faults = F.array_compact(F.array(
        F.when(bare(F.col("name")).isin(*forbidden), F.concat(F.lit("field:"), bare(F.col("name")))),
        F.when(listed & ~F.coalesce(text & F.col("value").rlike(PLACEHOLDER), F.lit(False)), "concrete"),
        *[F.when(text & F.col("value").rlike(p), rule) for rule, p in patterns.items()],
    ))
    return tree.select(key, "pointer", F.explode(faults).alias("fault"))
