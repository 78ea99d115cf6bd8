"""Queries over JSON of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.catalog import query, table
from proofmill.operators import trees as T

#: Bare names of fields that must not reach a shared file, of which the query's data has profileid and runid.
FORBIDDEN = [
    "taskid", "basetaskid", "finaltaskid", "sourcetaskid", "runtaskid", "runid", "profile", "profileid", "profilename", "postid", "commentid",
    "liveredditcollection", "previousliveattempt", "offlinepausedsnapshot", "postsrequested", "postsskipped", "taskdate", "rundate", "runstatistics",
    "runtimecontract", "runtimereference", "sourcegitsha", "testedscope",
]


def reply_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one JSON text in which every turn holds the next: two levels more for each turn."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("turn", "role", "text")))).alias("turns"))
    own = lambda t: F.to_json(F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text"), F.when(t["turn"] % 3 == 0, t["turn"]).alias("Profile-ID"), F.struct((t["turn"] % 2 == 0).alias("ru/n~id")).alias("a~/b")))
    chain = F.aggregate("turns", F.lit(""), lambda inner, t: F.concat(F.regexp_replace(own(t), r"\}$", ""), F.lit(', "next": ['), inner, F.lit("]}")))
    return turns.select("conv_id", chain.alias("chain"))


_AT = "repeat('/next/0', (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT)"


@query(f"""
WITH t AS (SELECT conv_id, turn, role, text, {_AT} AS p0, turn = max(turn) OVER (PARTITION BY conv_id) AS ends FROM conversations)
SELECT conv_id, p0 AS pointer, 'object' AS type, NULL::VARCHAR AS value FROM t
UNION ALL SELECT conv_id, p0 || '/turn', 'number', turn::VARCHAR FROM t
UNION ALL SELECT conv_id, p0 || '/role', 'string', role FROM t WHERE role IS NOT NULL
UNION ALL SELECT conv_id, p0 || '/text', 'string', text FROM t WHERE text IS NOT NULL
UNION ALL SELECT conv_id, p0 || '/Profile-ID', 'number', turn::VARCHAR FROM t WHERE turn % 3 = 0
UNION ALL SELECT conv_id, p0 || '/a~0~1b', 'object', NULL FROM t
UNION ALL SELECT conv_id, p0 || '/a~0~1b/ru~1n~0id', 'boolean', (turn % 2 = 0)::VARCHAR FROM t
UNION ALL SELECT conv_id, p0 || '/next', 'array', NULL FROM t
""")
def json_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every conversation's nested chain of turns, by pointer."""
    return T.json_tree(reply_chains(spark, sf_dir), "conv_id", "chain").select("conv_id", "pointer", "type", "value")


@query(f"""
WITH t AS (SELECT conv_id, turn, role, text, {_AT} AS p0 FROM conversations)
SELECT conv_id, p0 || '/Profile-ID' AS pointer, 'field:profileid' AS fault FROM t WHERE turn % 3 = 0
UNION ALL SELECT conv_id, p0 || '/a~0~1b/ru~1n~0id', 'field:runid' FROM t
UNION ALL SELECT conv_id, p0 || '/text', 'long_number' FROM t WHERE regexp_matches(text, '[0-9]{{4,}}')
UNION ALL SELECT conv_id, p0 || '/role', 'role' FROM t WHERE role = 'system'
""")
def json_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """forbidden fields and matched texts of the nested chains, by pointer."""
    return T.json_faults(reply_chains(spark, sf_dir), "conv_id", "chain", FORBIDDEN, {"long_number": "[0-9]{4,}", "role": "^system$"})


@query(f"SELECT conv_id, '$' || replace({_AT}, '/next/0', '.next[0]') AS path, turn::BIGINT AS turn FROM conversations QUALIFY turn = 3 ")
def json_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outermost objects that have a field mark, at whatever depth; here turn 3 of each chain gets it."""
    chains = reply_chains(spark, sf_dir).withColumn("chain", F.regexp_replace("chain", r'\{"turn":3,', '{"mark":null,"turn":3,'))
    found = T.marked_objects(chains, "conv_id", "chain", ["mark", "turn"])
    return found.select("conv_id", "path", F.try_variant_get(F.parse_json("object"), "$.turn", "bigint").alias("turn"))
