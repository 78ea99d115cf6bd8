import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from proofmill.sources import readers as R
from proofmill.sources import sinks as S


def test_uncommitted_tail_is_ignored(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"n": 1}\n{"n": 2}\n{"n": 3}')
    (tmp_path / "b.jsonl").write_bytes(b'{"n": 4}\r\n{"n": 5}\n')
    (tmp_path / "c.jsonl").write_bytes(b'\xef\xbb\xbf{"n": 6}\n{"n": 7}\n')
    got = R.committed_jsonl(spark, str(tmp_path), "n int")
    assert sorted((r.line, r.n) for r in got.collect()) == [(1, 1), (1, 4), (1, 6), (2, 2), (2, 5), (2, 7)]


def test_bad_committed_line_names_itself(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"n": 1}\n[2]\n')
    with pytest.raises(Exception, match="bad committed line 2"):
        R.committed_jsonl(spark, str(tmp_path), "n int").collect()
    (tmp_path / "a.jsonl").write_bytes(b'{"n": 1}\n{"n": "\xff"}\n')
    with pytest.raises(Exception, match="bad committed line 2"):
        R.committed_jsonl(spark, str(tmp_path), "n string").collect()


def test_tolerant_scan_reports_gaps(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"n": 1}\nnope\n\n{"n": 3}\n')
    rows, gaps = R.tolerant_jsonl(spark, str(tmp_path), "n int")
    assert [r.n for r in rows.orderBy("line").collect()] == [1, 3] and [r.line for r in gaps.collect()] == [2]


def test_declared_order_of_journals(spark, tmp_path):
    for name, text in (("x.jsonl", '{"p": 1}\n'), ("y.jsonl", '{"p": 2}\nbad\n{"p": 3}')):
        (tmp_path / name).write_text(text)
    paths = [f"{tmp_path}/y.jsonl", f"{tmp_path}/x.jsonl", f"{tmp_path}/none.jsonl", "a.txt"]
    history = spark.createDataFrame(list(enumerate(paths)), "pos int, path string")
    rows, issues = R.ordered_journals(spark, history, "p int")
    assert [r.p for r in rows.orderBy("pos", "line").collect()] == [2, 1]
    assert sorted(r.code for r in issues.collect()) == ["BAD_LINE", "MISSING_FILE", "NOT_JSONL", "NO_FINAL_LINE_FEED"]


def test_journals_of_one_name_in_several_folders(spark, tmp_path):
    for folder in ("a/x", "b/x", "y z", "c%20d"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "1.jsonl").write_text(f'{{"n": "{folder}"}}\n')
    names = [f"{tmp_path}/{x}/1.jsonl" for x in ("b/x", "y z", "a/x", "c%20d")]
    history = spark.createDataFrame(list(enumerate(names)), "pos long, path string")
    good, issues = R.ordered_journals(spark, history, "n string")
    assert [(r.pos, r.n) for r in good.orderBy("pos").collect()] == [(0, "b/x"), (1, "y z"), (2, "a/x"), (3, "c%20d")] and issues.count() == 0


def test_json_documents_and_optional(spark, tmp_path):
    (tmp_path / "d.json").write_bytes(b'\xef\xbb\xbf{"a":\n 1}')
    assert R.json_documents(spark, f"{tmp_path}/d.json", "a int").first().a == 1
    assert R.optional(spark, f"{tmp_path}/none.jsonl", "a int").count() == 0


def test_inventory_manifest_and_change(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a").write_bytes(b"abc")
    (tmp_path / "in" / "sub" / "b").write_bytes(b"")
    found = {r.path: (r.bytes, r.sha256) for r in R.inventory(spark, f"{tmp_path}/in").collect()}
    assert found == {"a": (3, hashlib.sha256(b"abc").hexdigest()), "sub/b": (0, hashlib.sha256(b"").hexdigest())}
    S.write_manifest(spark, f"{tmp_path}/in", f"{tmp_path}/manifest")
    manifest = spark.read.schema("path string, bytes bigint, sha256 string").json(f"{tmp_path}/manifest")
    assert S.verify_manifest(spark, f"{tmp_path}/in", manifest).count() == 0
    (tmp_path / "in" / "a").write_bytes(b"abd")
    assert [tuple(r) for r in S.verify_manifest(spark, f"{tmp_path}/in", manifest).collect()] == [("a", "changed", ["sha256"])]


def test_checked_batches(spark, tmp_path):
    def put(name, record, sha=None):
        text = json.dumps(record, separators=(",", ":"))
        (tmp_path / name).write_text('{"record":' + text + ',"sha256":"' + (sha or hashlib.sha256(text.encode()).hexdigest()) + '"}')

    put("00000001.json", {"sequence": 1, "x": "{}"})
    put("00000002.json", {"sequence": 3})
    put("00000003.json", {"sequence": 3}, "0")
    put("1.json", {"sequence": 1})
    got = {r.file: r.refused for r in R.checked_batches(spark, str(tmp_path)).collect()}
    assert got == {"00000001.json": None, "00000002.json": "SEQUENCE", "00000003.json": "HASH", "1.json": "NAME"}


def test_archive_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("ok/a.txt", "../b", "OK/a.txt", "c?d"):
            z.writestr(name, name)
    got = {r.member: (r.bytes, r.refused) for r in R.archive_members(spark, f"{tmp_path}/a.zip").collect()}
    assert got == {"ok/a.txt": (8, "collision"), "../b": (4, "parent"), "OK/a.txt": (8, "collision"), "c?d": (3, "character")}


def test_front_matter_and_catalog(spark):
    df = spark.createDataFrame([('---\nname: "x y"\nkind: z\n---\nbody',), ("no",)], "t string")
    assert [r.m for r in df.select(R.front_matter(F.col("t")).alias("m")).collect()] == [{"name": "x y", "kind": "z"}, None]
    entries = spark.createDataFrame([("a-b", "x/y"), ("A", "x"), ("c", "../x"), ("d", "p"), ("d", "q")], "name string, path string")
    assert [r.refused for r in R.catalog_issues(entries).orderBy("name", "path").collect()] == ["name", None, "parent", "duplicate", "duplicate"]


def test_csv_guards_and_refuses_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("123456789012345678901", "=x", ["a", "b"], None)], "id string, t string, l array<string>, n int").coalesce(1)
    S.write_csv(df, f"{tmp_path}/out", ids=("id",))
    (part,) = (tmp_path / "out").glob("*.csv")
    assert part.read_text() == '"id","t","l","n"\n"\'123456789012345678901","\'=x","a；b",""\n'
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        S.write_csv(df, f"{tmp_path}/out")


def test_report_refuses_nan(spark, tmp_path):
    S.write_report(spark.createDataFrame([(1.5, None)], "a double, b int").coalesce(1), f"{tmp_path}/good")
    (part,) = (tmp_path / "good").glob("*.json")
    assert json.loads(part.read_text()) == {"a": 1.5, "b": None}
    with pytest.raises(Exception, match="isn't finite"):
        S.write_report(spark.createDataFrame([(float("nan"),)], "a double"), f"{tmp_path}/bad")


def test_partitions_without_rows_exist(spark, tmp_path):
    S.write_partitioned(spark.createDataFrame([(1, "x")], "a int, k string"), f"{tmp_path}/p", "k", ["x", "y"])
    assert spark.read.parquet(f"{tmp_path}/p/k=y").count() == 0 and spark.read.parquet(f"{tmp_path}/p/k=x").count() == 1


def test_long_texts_split_and_join_again(spark):
    df = spark.createDataFrame([(1, "abcdefg"), (2, "")], "k int, t string")
    parts = S.split_long(df, "k", "t", 3).orderBy("k", "part").collect()
    assert [(r.k, r.part, r.t) for r in parts] == [(1, 0, "abc"), (1, 1, "def"), (1, 2, "g"), (2, 0, "")]
    assert "| k | t |" in S.write_markdown(df, "x")


def test_large_journal_in_many_blocks(spark, tmp_path):
    text = "".join(f'{{"n": {i}, "pad": "{"x" * 50}"}}\n' for i in range(5000))
    (tmp_path / "a.jsonl").write_text(text + '{"n": 5000}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = R.committed_jsonl(spark, f"{tmp_path}/a.jsonl", "n int").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted((r.line, r.n) for r in rows) == [(i + 1, i) for i in range(5000)]
