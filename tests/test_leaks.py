"""Leak rules, escapes, tokens of the caller and lines that are made up."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from proofmill.functions import text as T


def test_every_rule_finds_its_text(spark):
    texts = {
        "private_key": "-----BEGIN EC PRIVATE KEY-----", "github_token": "x ghp_" + "a1" * 12, "aws_access_key": "AKIA" + "A1" * 8, "slack_token": "xoxb-123456789012-x", "bearer_token": "Authorization: Bearer abcdefghijklmn",
        "assigned_secret": "api_key = 'abcdefghijklmnop'", "windows_path": r"in C:\Users\me", "unc_path": r"at \\server\share name", "posix_device_path": "see /home/me/x", "facebook_target": "https://www.facebook.com/groups/abcd1",
        "instagram_target": "http://instagram.com/abc", "tiktok_target": "https://www.tiktok.com/@abc", "reddit_target": "https://reddit.com/r/x/comments/abc12",
    }
    assert set(texts) == set(T.LEAK_PATTERNS)
    rows = spark.createDataFrame([*texts.items(), ("none", "https://site.org/home/a, 3:45, a\\b, ghp_short")], "name string, text string")
    got = {r.name: r.found for r in rows.select("name", T.leaks(F.col("text")).alias("found")).collect()}
    assert all(n in got[n] for n in texts) and got["none"] == []


def test_device_paths_with_and_without_lookbehind(spark):
    lines = {
        "windows_path": ([r"C:\Users", "(d:/data)", r"é:x E:\\tmp"], [r"xC:\Users", r"C:\a", "9c:/data", "C:"]),
        "unc_path": ([r"\\host\share", r"'\\\\host\\share'"], [r"\\\host\share", r"\\host\\share", r"\\\\host\share", r"\\\\\host\\share", r"\host\share"]),
        "posix_device_path": (["/home/me", "x:/root/y", "a\n/mnt/z"], ["a/home/me", "-/home/me", "./root/x", "/home/", "/Home/me"]),
    }
    for name, (found, clean) in lines.items():
        rows = spark.createDataFrame([(t, True) for t in found] + [(t, False) for t in clean], "text string, want boolean")
        text = F.col("text")
        got = rows.select("text", "want", text.rlike(T.LEAK_PATTERNS[name]).alias("a"), T.rule_matches(text, name, T.LEAK_PATTERNS[name]).alias("b"), text.rlike(T.WITHOUT_LOOKBEHIND[name]).alias("c")).collect()
        assert [(r.text, r.a, r.b, r.c) for r in got] == [(r.text, r.want, r.want, r.want) for r in got]


def test_escaped_texts_and_tokens(spark):
    rows = spark.createDataFrame([(1, r"x \/home\/me\/y"), (2, r"C:\u005cUsers"), (3, "%2Fhome%2Fme"), (4, r"my secre\u0074-name"), (5, 'say "hi" \n 100% sure'), (6, None)], "id int, text string")
    got = {r.id: r.found for r in rows.select("id", T.escaped_leaks(F.col("text"), ["secret-name"]).alias("found")).collect()}
    assert got[1] == got[3] == ["posix_device_path"] and got[2] == ["windows_path"] and got[4] == ["token:secret-name"] and got[5] == []


def test_decoding_keeps_controls_and_reads_repeated_quotes(spark):
    texts = {1: "der\tx", 2: r'a "" my secre\u0074-name', 3: r'b \\" my secre\u0074-name', 4: "my secret\x0b-name"}
    rows = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {r.id: r.found for r in rows.select("id", T.escaped_leaks(F.col("text"), ["der ", "secret-name"]).alias("found")).collect()}
    assert got == {1: [], 2: ["token:secret-name"], 3: ["token:secret-name"], 4: []}


def test_escaped_scan_equals_sql_on_odd_texts(spark, tmp_path):
    texts = ["der\tx", "der\n", "der x", 'd"er x', "d%er ", '%@host.org', 'a"@host.org', "a@ho+st.org", 'a@"host.org', r"a\u0040b.org", "a%40b.org", r"der\ ", 'x "" a@b.org', "der+x", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.email, r.token) for r in entry.queries()["escaped_scan"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == {i: (email, token) for i, email, token in con.execute(entry.oracle_sql()["escaped_scan"]).fetchall()}


def test_made_up_lines(spark):
    rows = spark.createDataFrame([("tests/a.py", "synthetic key", True), ("src/a.py", "synthetic key", False), ("src/a.py", "REPLACE_WITH_KEY", True), (None, None, False)], "path string, line string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", T.synthetic_line(F.col("path"), F.col("line")).alias("got")).collect())
