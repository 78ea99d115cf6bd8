"""Normal forms against the standard library, folded names and tags."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from proofmill.functions import unicode as U

#: Combining marks out of order, ligatures, Hangul syllables and their parts, widths, signs and composition exclusions.
ODD = ["é", "q̣̇", "ẛ̣", "ﬁn ﬀ", "한글", "한글", "하", "ＡＢＣ１２", "①½™", "ÅÅ", "क़", "יִ", "ﷺ", "i̇", "ΑΣ", "ß", "", "à̖́", "̈́"]


def values():
    rnd = random.Random(7)
    pool = "".join(ODD) + "abcXYZ _#"
    return ODD + ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 12))) for _ in range(400)] + [None]


@pytest.mark.parametrize("form", U.FORMS)
def test_forms(spark, form):
    texts = values()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.n for r in df.select("i", U.normal_form(F.col("t"), form).alias("n")).orderBy("i").collect()]
    assert got == [None if t is None else unicodedata.normalize(form, t) for t in texts]
    with pytest.raises(ValueError):
        U.normal_form(F.col("t"), "NFX")


def test_folding(spark):
    texts = values()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.n for r in df.select("i", U.case_folded(F.col("t")).alias("n")).orderBy("i").collect()]
    nfc = lambda t: unicodedata.normalize("NFC", t)
    assert got == [None if t is None else nfc(nfc(t).casefold()) for t in texts]


def test_collisions(spark):
    names = ["Straße.md", "STRASSE.md", "café", "CAFÉ", "café", "한", "한", "alone", "alone", None]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = sorted((r.name, r.form, r["first"], r.n) for r in U.name_collisions(df, "p").collect())
    assert got == sorted([("Straße.md", "strasse.md", "STRASSE.md", 2), ("STRASSE.md", "strasse.md", "STRASSE.md", 2), *[(n, "café", "CAFÉ", 3) for n in ("café", "CAFÉ", "café")], *[(n, "한", "한", 2) for n in ("한", "한")]])


def test_tags_and_queries(spark):
    df = spark.createDataFrame([(["#Ｎews", " É ", None, ""], "x #é #ﬁt #news and #한글!"), (None, None), ([], "#")], "m array<string>, c string")
    assert [r.t for r in df.select(U.tags_in(F.col("m"), F.col("c")).alias("t")).collect()] == [["news", "é", "fit", "한글"], [], []]
    one = spark.createDataFrame([("  Ｆｏｏ　 BAR",), (None,)], "q string")
    assert [r.k for r in one.select(U.query_key(F.col("q")).alias("k")).collect()] == ["foo bar", None]
