from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from proofmill.functions import text as T
from proofmill.functions import values as V

HOSTS = ["site.example", "www.site.example"]


@pytest.fixture
def at(spark):
    def value(column, **row):
        names = list(row)
        kinds = ", ".join(f"{n} {k}" for n, (_, k) in row.items())
        df = spark.createDataFrame([tuple(row[n][0] for n in names)], kinds) if names else spark.range(1)
        return df.select(column.alias("v")).first().v

    return value


@pytest.mark.parametrize(
    "raw,want",
    [("@Alice", "alice"), ("https://www.site.example/Bob.B/", "bob.b"), ("https://other.example/bob", None), ("https://site.example/p/x", None), ("explore", None), ("a b", None), ("", None), (None, None), ("x" * 31, None)],
)
def test_handle(at, raw, want):
    assert at(T.normal_handle(F.col("x"), HOSTS), x=(raw, "string")) == want


@pytest.mark.parametrize(
    "url,want",
    [("https://site.example/reels/AbC_1/", ("reel", "AbC_1", None)), ("https://site.example/ann/p/Zz9", ("p", "Zz9", "ann")), ("http://site.example/p/Zz9", None), ("https://u@site.example/p/Zz9", None), ("https://site.example:8/p/Zz9", None), (None, None)],
)
def test_work_url(at, url, want):
    got = at(T.work_url(F.col("x"), HOSTS), x=(url, "string"))
    assert (tuple(got) if got else None) == want


def test_account_needs_both_id_and_namespace(at):
    acc = T.account(F.col("h"), F.col("i"), F.col("n"), "s")
    kinds = lambda h, i, n: tuple(at(acc, h=(h, "string"), i=(i, "string"), n=(n, "string")))
    assert kinds("a", "1", "app") == ("s:app:1", "namespaced_id_supplied")
    assert kinds("a", "1", None) == ("s:handle:a", "provisional_handle")
    assert kinds(None, "1", " ") == (None, "invalid")


@pytest.mark.parametrize("raw,want", [("15.6K", (15600, True)), ("1,234", (1234, False)), ("2 M views", (2_000_000, True)), ("3万", (30000, True)), ("none", (None, None)), (None, (None, None))])
def test_compact_metric(at, raw, want):
    assert tuple(at(V.compact_metric(F.col("x")), x=(raw, "string"))) == want


@pytest.mark.parametrize("raw,want", [("1.5K", 1500.0), (" 12 ", 12.0), ("12 followers", None), (None, None), ("K", None)])
def test_follower_count(at, raw, want):
    assert at(V.follower_count(F.col("x")), x=(raw, "string")) == want


@pytest.mark.parametrize(
    "exact,label,want",
    [(0, None, (0, None, "exact")), (-1, "5", (None, None, "invalid")), (None, " ", (None, None, "missing")), (None, "about 1.2K", (None, "1.2K", "approximate")), (None, "1,234 likes", (1234, None, "exact_label")), (None, "1.5", (None, None, "invalid")), (None, "3 of 4", (None, None, "invalid"))],
)
def test_resolved_metric(at, exact, label, want):
    assert tuple(at(V.resolved_metric(F.col("e"), F.col("l")), e=(exact, "bigint"), l=(label, "string"))) == want


@pytest.mark.parametrize("raw,known", [("2024-01-02T03:04:05Z", True), ("2024-01-02T03:04:05+02:00", True), ("2024-01-02T03:04:05", False), ("2024-02-30T00:00:00Z", False), (None, False)])
def test_zoned_time(at, raw, known):
    assert (at(V.zoned_time(F.col("x")), x=(raw, "string")) is not None) == known


def test_months_before_cuts_the_day(at):
    assert at(V.months_before(F.lit("2023-08-31").cast("timestamp"), 6)).day == 28


def test_unknown_is_never_zero(at):
    assert at(V.safe_ratio(F.lit(1), F.lit(0))) is None
    assert at(V.safe_ratio(F.lit(None), F.lit(2))) is None
    assert at(V.interaction_rate(F.lit(1), F.lit(None), F.lit(4))) is None
    assert at(V.three_valued(F.lit(None).cast("boolean") & F.lit(False))) == "fail"
    assert at(V.three_valued(F.lit(None).cast("boolean") & F.lit(True))) == "unknown"
    assert at(V.three_valued(V.country_gate(F.lit("non_US"), ["US"]))) == "fail"
    assert at(V.three_valued(V.country_gate(F.lit("non_US"), ["DE", "US"]))) == "unknown"
    assert at(V.three_valued(V.country_gate(F.lit(None), []))) == "pass"


def test_duration_prefers_the_supplied_value(at):
    a, b = datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 1, 0, 0, 2, tzinfo=UTC)
    d = V.duration_ms(F.col("s"), F.col("a"), F.col("b"))
    assert at(d, s=(7, "bigint"), a=(a, "timestamp"), b=(b, "timestamp")) == 7
    assert at(d, s=(-7, "bigint"), a=(a, "timestamp"), b=(b, "timestamp")) == 2000
    assert at(d, s=(None, "bigint"), a=(b, "timestamp"), b=(a, "timestamp")) is None


@pytest.mark.parametrize("raw,want", [("=1+1", "'=1+1"), ("  @x", "'  @x"), ("\tx", "'\tx"), ("plain", "plain"), (None, None)])
def test_formula_guard(at, raw, want):
    assert at(T.guard_formula(F.col("x")), x=(raw, "string")) == want


def test_small_text_functions(at):
    one = lambda f, raw: at(f(F.col("x")), x=(raw, "string"))
    assert one(T.collapse_space, " a  b\n") == "a b"
    assert one(lambda c: T.keep_parameter(c, "q"), "https://h/p?a=1&q=x&q=y#f") == "https://h/p?q=x&q=y"
    assert one(lambda c: T.path_part(c, "groups"), "https://h/groups/a%20b/x") == "a b"
    assert at(T.search_url("https://h/search", F.lit("a b+c"))) == "https://h/search?q=a%20b%2Bc"
    assert one(T.redact, "go https://x.y/z token=abc to a@b.cd Bearer xyz") == "go [url] token=[secret] to [mail] Bearer [secret]"
    assert one(T.hashtags, "#Été #a_1 #A_1 x#") == ["été", "a_1"]
    assert one(T.mentions, "@A.b c@d @E") == ["a.b", "e"]
    assert one(T.markdown_links, "[a](b.md#x) [c](#y) ![d](e.png)") == ["b.md", "e.png"]
    assert one(T.evidence_id, r" snapshots\a\b ") == "a/b"
    assert one(T.error_code, "BAD_THING: x") == "BAD_THING" and one(T.error_code, "x") == "OTHER"
    assert one(T.strip_fences, "a ```x\ny``` b") == "a  b"
    assert one(T.escape_illegal_xml, "a\x01b\n") == "a\\u0001b\n"
    assert one(lambda c: T.leaks(c, T.LEAK_PATTERNS | T.PERSONAL_PATTERNS), "mail a@b.cd from /home/me") == ["email", "posix_device_path"]
    assert at(T.base36(F.lit(35))) == "z"
    assert at(T.id_text(F.lit(3.0), "double")) == "3" and at(T.id_text(F.lit(3.5), "double")) is None
    assert at(T.version(F.lit("1.10.0")) > T.version(F.lit("1.9.9"))) is True
    assert at(T.url_id_agrees(F.lit("https://h/groups/g/posts/12"), F.lit("12"), F.lit("g"), r"/groups/([^/]+)/posts/(\d+)")) is True
    assert at(T.action_key(F.lit("search"), F.lit(None), F.lit(3))) == "search||3"


def test_canonical_json_ignores_argument_order(at):
    a, b = T.semantic_key(24, x=F.lit(1), a=F.lit(None).cast("string")), T.semantic_key(24, a=F.lit(None).cast("string"), x=F.lit(1))
    assert at(a) == at(b) and len(at(a)) == 24
    assert at(T.canonical_json(b=F.lit(1), a=F.lit(None).cast("string"))) == '{"a":null,"b":1}'
    assert at(T.fingerprint(F.array(F.lit("b"), F.lit("a"), F.lit("b")))) == at(T.fingerprint(F.array(F.lit("a"), F.lit("b"))))
