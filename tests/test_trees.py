"""JSON trees against json.loads, of any depth, length and odd names."""

import json
import random

import pytest
from pyspark.sql import functions as F

from proofmill.functions.text import whole_json
from proofmill.operators import trees as T


def walk(v, at=""):
    if isinstance(v, dict):
        yield at, "object", None
        for k, x in v.items():
            yield from walk(x, f"{at}/{k.replace('~', '~0').replace('/', '~1')}")
    elif isinstance(v, list):
        yield at, "array", None
        for i, x in enumerate(v):
            yield from walk(x, f"{at}/{i}")
    else:
        yield at, {bool: "boolean", str: "string", type(None): "null"}.get(type(v), "number"), None if v is None else v if isinstance(v, str) else json.dumps(v)


def tree(rnd, depth=0):
    kind = rnd.random()
    if depth > 6 or kind < 0.4:
        return rnd.choice([None, True, False, 0, -7, 123456789012, "", "é/~", "1", "x" * 20])
    if kind < 0.7:
        return [tree(rnd, depth + 1) for _ in range(rnd.randint(0, 4))]
    return {k: tree(rnd, depth + 1) for k in rnd.sample(["a", "a/b", "m~n", "0", "", "key", "pos", "value", "v", "é"], rnd.randint(0, 4))}


@pytest.fixture(scope="module")
def values():
    rnd = random.Random(2)
    deep = 1
    for _ in range(12):
        deep = {"d": [deep]}
    return [tree(rnd) for _ in range(60)] + [deep, list(range(3000))]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, v string")


def test_every_value_by_its_pointer(spark, values):
    df = frame(spark, [json.dumps(v, ensure_ascii=k % 2 == 0) for k, v in enumerate(values)])
    got = {(r.k, r.pointer): (r.type, r.value) for r in T.json_tree(df, "k", "v").collect()}
    assert got == {(k, p): (t, x) for k, v in enumerate(values) for p, t, x in walk(v)}


def test_all_of_a_text_is_json_or_none_of_it(spark):
    good = ["1", ' {"a": [1, {"b": "]}"}]} ', '"x"', "null", "[]"]
    bad = ['{"a":1} x', "1 2", "1,2", "1] [2", "1} {", '1,"w":2', "", " ", "]", "}", '{"a":1}]', "[1", "nope", None]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    assert [r.v is not None for r in df.select(F.to_json(whole_json(F.col("t"))).alias("v")).collect()] == [True] * len(good) + [False] * len(bad)


def test_texts_that_are_no_trees(spark):
    df = spark.createDataFrame([(1, None), (2, "{"), (None, '{"a":1'), (None, "[]"), (None, "[]"), (3, '{"a":1,"a":2}'), (4, "null")], "k int, j string")
    got = sorted((str(r.k), r.pointer, r.type) for r in T.json_tree(df, "k", "j").collect())
    assert got == [("4", "", "null"), ("None", "", "array"), ("None", "", "array")]
    assert sorted(str(r.k) for r in T.unread(df, "k", "j").collect()) == ["2", "3", "None"]
    assert T.json_tree(df.limit(0), "k", "j").count() == 0


def test_outermost_objects_with_marks(spark, values):
    def outer(v, at=""):
        if isinstance(v, dict) and "a" in v and "a/b" in v:
            yield at, v
        elif isinstance(v, dict | list):
            for k, x in v.items() if isinstance(v, dict) else enumerate(v):
                yield from outer(x, f"{at}/{str(k).replace('~', '~0').replace('/', '~1')}")

    df = frame(spark, [json.dumps(v) for v in values])
    got = sorted((r.k, r.pointer, json.dumps(json.loads(r.object), sort_keys=True)) for r in T.marked_objects(df, "k", "v", ["a", "a/b"]).collect())
    assert got == sorted((k, p, json.dumps(o, sort_keys=True)) for k, v in enumerate(values) for p, o in outer(v)) and got


def test_faults_by_pointer(spark):
    text = {"Run-ID": 1, "in": [{"profile_name": "x", "posts": ["REPLACE_WITH_POST", "https://x", 3]}, "task_0123456789abcdef0"], "runIdea": 2}
    df = frame(spark, [json.dumps(text)])
    got = sorted((r.pointer, r.fault) for r in T.json_faults(df, "k", "v", ["runid", "profilename"], {"task": r"\btask_[0-9a-f]{16,}\b"}, ["posts"]).collect())
    assert got == [("/Run-ID", "field:runid"), ("/in/0/posts/1", "concrete"), ("/in/0/posts/2", "concrete"), ("/in/0/profile_name", "field:profilename"), ("/in/1", "task")]


def test_different_values_of_a_field(spark):
    df = frame(spark, ['{"media":{"type":"b","all":[{"media":{"type":"a"}},{"type":"b"},{"type":1}]}}', "{}"])
    assert [(r.k, r.found) for r in T.distinct_values(df, "k", "v", "type").collect()] == [(0, ["a", "b"])]
