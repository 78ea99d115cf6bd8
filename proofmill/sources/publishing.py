"""Several outputs, all or nothing: staged, listed with their hashes, then made visible by one rename.

A set is published below a folder as v00000001, v00000002 and so on.  Phase one
writes every output and then a manifest, the last file, into a staging folder
beside them.  Phase two renames the staging folder to the next version.  Readers
look at versions only, so they see no output of an attempt that failed anywhere.
`recover` ends what a lost driver left: an attempt whose manifest is there and
true is finished, any other is discarded.

The rename is one step on HDFS and on local and most shared file systems; on a
store without such a rename a version is whole once its manifest is there, which
is copied last, and `published` checks it.  One writer a folder at a time: a
second one finds the version taken, and its rename is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.operators.joins import reconcile
from proofmill.sources.readers import inventory

STAGING, MANIFEST = "staging-", "manifest"
MANIFEST_SCHEMA = "path string, bytes bigint, sha256 string"

Output = DataFrame | str | Callable[[str], None]


def _files(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, at: str) -> list[str]:
    path, fs = _files(spark, at)
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


def versions(spark: SparkSession, at: str) -> list[int]:
    """Numbers of the published sets below a folder."""
    return [int(n[1:]) for n in _names(spark, at) if n[:1] == "v" and n[1:].isdigit()]


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes, sha256 of the data files of a set, without the manifest and what committers leave."""
    return inventory(spark, folder).filter(~F.col("path").rlike(rf"(^|/)[_.]|^{MANIFEST}/"))


def _whole(spark: SparkSession, folder: str) -> bool:
    if "_SUCCESS" not in _names(spark, f"{folder}/{MANIFEST}"):
        return False
    listed = spark.read.schema(MANIFEST_SCHEMA).json(f"{folder}/{MANIFEST}")
    return reconcile(listed, _contents(spark, folder), ["path"], ["bytes", "sha256"]).filter("status <> 'same'").isEmpty()


def publish(spark: SparkSession, at: str, outputs: Mapping[str, Output], before_rename: Callable[[], None] | None = None) -> int:
    """Write all outputs, then make them visible at once; returns the version's number.

    An output is a DataFrame (a folder of JSON lines, NULL fields written), a
    text (one file), or a function that writes to the path it gets.  If anything
    fails, the attempt is deleted and the error raised; nothing becomes visible.
    """
    stage = f"{at.rstrip('/')}/{STAGING}{uuid.uuid4().hex}"
    path, fs = _files(spark, stage)
    try:
        for name, output in outputs.items():
            if isinstance(output, DataFrame):
                output.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{stage}/{name}")
            elif isinstance(output, str):
                _put(spark, f"{stage}/{name}", output)
            else:
                output(f"{stage}/{name}")
        _contents(spark, stage).write.mode("errorifexists").json(f"{stage}/{MANIFEST}")
        if before_rename:
            before_rename()
        return _reveal(spark, stage, at)
    except Exception:
        fs.delete(path, True)
        raise


def _put(spark: SparkSession, at: str, text: str) -> None:
    path, fs = _files(spark, at)
    out = fs.create(path, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _reveal(spark: SparkSession, stage: str, at: str) -> int:
    number = max(versions(spark, at), default=0) + 1
    source, fs = _files(spark, stage)
    target, _ = _files(spark, f"{at.rstrip('/')}/v{number:08d}")
    if fs.exists(target) or not fs.rename(source, target):
        raise FileExistsError(f"version {number} is taken")
    return number


def recover(spark: SparkSession, at: str) -> dict[str, int | None]:
    """What became of each attempt that was left: the version that it was finished as, or None if it was discarded."""
    ended: dict[str, int | None] = {}
    for name in _names(spark, at):
        if name.startswith(STAGING):
            stage = f"{at.rstrip('/')}/{name}"
            if _whole(spark, stage):
                ended[name] = _reveal(spark, stage, at)
            else:
                path, fs = _files(spark, stage)
                fs.delete(path, True)
                ended[name] = None
    return ended


def published(spark: SparkSession, at: str, version: int | None = None) -> str:
    """The folder of a version, by default the last; refused if its files aren't those of its manifest."""
    have = versions(spark, at)
    number = version if version is not None else max(have, default=0)
    folder = f"{at.rstrip('/')}/v{number:08d}"
    if number not in have or not _whole(spark, folder):
        raise FileNotFoundError(f"{folder} is no whole version")
    return folder


def review_bundle(facts: DataFrame, observations: DataFrame, title: str, trusted: bool) -> dict[str, Output]:
    """The outputs of a review: facts and observations as data, a Markdown report, and a proposal bound to them.

    The proposal names the distinct targets of eligible observations; an
    untrusted run has none and is blocked.
    """
    from proofmill.sources.sinks import write_markdown

    targets = sorted(r.target for r in observations.filter(F.col("eligible")).select("target").distinct().collect()) if trusted else []
    state = "blocked" if not trusted else "proposed" if targets else "none"
    return {"facts": facts, "observations": observations, "review.md": write_markdown(facts, title), "proposal.json": json.dumps({"state": state, "targets": targets}, sort_keys=True)}


def next_input(baseline: DataFrame, actions: DataFrame, limits: Mapping[str, int], source: str) -> dict[str, Output]:
    """The outputs of a compiled input: baseline and actions as data, limits and where they come from as one object."""
    return {"baseline": baseline, "actions": actions, "input.json": json.dumps({"limits": dict(limits), "source": source, "schema_version": 1}, sort_keys=True)}
