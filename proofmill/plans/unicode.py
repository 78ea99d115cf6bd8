"""Queries over texts and names whose characters are written in more than one way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.catalog import query, table
from proofmill.functions import unicode as U

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_WIDE = "".join(chr(ord(x) + 0xFEE0) for x in _LETTERS)
#: Composed letters of the texts and their parts: a letter and a combining mark.
_PARTS = {chr(w): chr(b) + chr(m) for w, b, m in ((0xE9, 0x65, 0x301), (0xE8, 0x65, 0x300), (0xEA, 0x65, 0x302), (0xE7, 0x63, 0x327), (0xF1, 0x6E, 0x303), (0xF3, 0x6F, 0x301), (0xE4, 0x61, 0x308), (0xFC, 0x75, 0x308))}


def apart(c: Column) -> Column:
    for whole, parts in _PARTS.items():
        c = F.replace(c, F.lit(whole), F.lit(parts))
    return c


@query("""
SELECT doc_id, sha256(coalesce(text, '')) AS canonical, sha256(translate(coalesce(text, ''), chr(160), ' ')) AS compatible,
       (SELECT count(*) FROM (SELECT DISTINCT lower(unnest(regexp_extract_all('#' || regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]+', ' #', 'g'), '#([\\p{L}\\p{N}_]+)', 1))))) AS tags
FROM documents
""")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whole texts with letters taken apart or made wide come back by their normal forms; their words as tags are as many as before."""
    text = F.coalesce("text", F.lit(""))
    wide = F.translate(apart(text), _LETTERS, _WIDE)
    tagged = F.concat(F.lit("#"), F.regexp_replace(wide, r"[^\p{L}\p{N}\p{M}]+", " #"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return table(spark, sf_dir, "documents").select(
        "doc_id", sha(U.normal_form(apart(text), "NFC")).alias("canonical"), sha(U.normal_form(wide, "NFKC")).alias("compatible"), F.size(U.tags_in(F.array().cast("array<string>"), tagged)).cast("long").alias("tags")
    )


_NAME = "lower(regexp_replace(p_name, '[^A-Za-z0-9]', '_', 'g'))"


@query(f"""
WITH n AS (SELECT DISTINCT 'é/' || {_NAME} AS form, p_partkey % 3 AS way FROM part), g AS (SELECT form, count(*) AS n FROM n GROUP BY 1)
SELECT form, n, count(*) AS names FROM g JOIN n USING (form) WHERE n > 1 GROUP BY ALL
""")
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part names written plainly, in capitals and with marks apart, and which of them are one name to a file system."""
    plain = F.concat(F.lit("é/"), F.lower(F.regexp_replace("p_name", "[^A-Za-z0-9]", "_")))
    way = F.col("p_partkey") % 3
    names = table(spark, sf_dir, "part").select(F.when(way == 0, plain).when(way == 1, F.upper(plain)).otherwise(apart(plain)).alias("path"))
    return U.name_collisions(names, "path").groupBy("form", "n").agg(F.count("*").alias("names"))


@query("SELECT lower(lang) AS key, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def merged_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that differ in width, case and spaces only are one action."""
    odd = F.col("doc_id") % 2 == 1
    asked = F.when(odd, F.translate("lang", _LETTERS, _WIDE)).otherwise(F.concat(F.lit(" "), F.upper("lang"), F.lit("　")))
    docs = table(spark, sf_dir, "documents").filter("lang is not null").select("doc_id", F.trim(U.query_key(asked)).alias("key"))
    return docs.groupBy("key").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))
