"""URL filters by sort-merge range joins over reversed-host keys (operator 2, DataFrame only).

A url's key is its reversed host labels, each ended by a dot; a rule host
becomes the interval of all keys that start with its own, which are itself and
its subdomains.  Intervals of prefixes are nested or disjoint.  Two sorted
sweeps judge the urls:

1. by hosts: boundaries of rule hosts and url keys are sorted together; a sweep
   in key order keeps a stack of the rule hosts open at each place, held as the
   last one opened at each depth, and gives each url its whole stack;
2. by paths, for each rule host on a url's stack: keys are the reversed host, a
   zero byte and the path, rules are intervals of them, nested likewise, and the
   top of the stack is the longest rule of that host whose path is a prefix.

The longest rule of all hosts on the stack wins; that it may be one of an outer
host with a longer path is why one stack of hosts and paths can't decide.

The first sweep runs by share of the urls, the second by rule host and share.
There are as many shares as the urls need, and the boundaries are repeated for
each; the shares are so few that the repeated boundaries stay below the urls in
number.  Rule hosts nest no deeper than a host name has labels, and the first
sweep holds one column for each depth that the rules reach.

Defined cases: a null url or one without :// has an empty host and path and
fits no rule; ties between equal rules go to block before allow; repeated rows
are judged each; a null page id stays null; empty tables give empty results;
an empty rule table leaves every url to the default; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill.llm.common import written

#: The rules of the query, as (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Urls that a share gets at least, and how many for each boundary.
SHARE_ROWS, SHARE_PER_BOUNDARY = 1024, 8
BROADCAST_RULES = 20_000


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ://."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def reversed_host(host: Column) -> Column:
    """Reversed host labels, each ended by a dot: a host's key starts with the key of every host above it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def canonical_key(host: Column, path: Column) -> Column:
    """Reversed host, a zero byte, the path: bytes whose prefixes are exactly the keys' prefixes."""
    return F.encode(F.concat(reversed_host(host), F.lit("\0"), path), "UTF-8")


def _edges(first: Column) -> Column:
    """A prefix's interval opens before every key that starts with it and closes after the last of them."""
    return F.explode(F.array(F.struct(first.alias("key"), F.lit(0).alias("turn"), F.lit(1).alias("step")), F.struct(F.concat(first, F.lit(b"\xff")).alias("key"), F.lit(2).alias("turn"), F.lit(-1).alias("step"))))


def host_stacks(keys: DataFrame, hosts: DataFrame, deepest: int, shares: int) -> DataFrame:
    """keys (_host, _path) with one row for each of `hosts` (host) that is the host or one above it, by a sorted sweep."""
    key = lambda h: F.encode(reversed_host(F.col(h)), "UTF-8")
    share = F.pmod(F.xxhash64("_host", "_path"), F.lit(shares)).cast("int")
    points = keys.select(share.alias("share"), key("_host").alias("key"), F.lit(1).alias("turn"), F.lit(0).alias("step"), F.lit(None).cast("string").alias("host"), "_host", "_path")
    edges = hosts.select("host", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), key("host").alias("first")).select("host", "share", _edges(F.col("first")).alias("e"))
    edges = edges.select("share", "e.key", "e.turn", "e.step", "host", F.lit(None).cast("string").alias("_host"), F.lit(None).cast("string").alias("_path"))
    sweep = Window.partitionBy("share").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = points.unionByName(edges).withColumn("depth", F.sum("step").over(sweep))
    # One window for all depths, so one sort; below its own depth a place sees the hosts that are open there.
    opened = [F.last(F.when((F.col("step") == 1) & (F.col("depth") == d), F.col("host")), ignorenulls=True).over(sweep).alias(f"_{d}") for d in range(1, deepest + 1)]
    stack = F.slice(F.array(*[F.col(f"_{d}") for d in range(1, deepest + 1)]), F.lit(1), F.col("depth").cast("int"))
    return swept.select("turn", "depth", "_host", "_path", *opened).filter("turn = 1 and depth > 0").select("_host", "_path", F.explode(stack).alias("host"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row for each input row: id, host, path, rule, verdict."""
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path"))
    best_verdict = F.max("verdict")  # of equal rules, block comes after allow
    own = rules.filter("host is not null and path is not null").groupBy("host", "path").agg(best_verdict.alias("verdict"))
    labels = F.split("host", r"\.")
    # The nesting of rule hosts: for each, how many of its suffixes are rule hosts.
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    hosts = own.groupBy("host").agg((2 * F.count("*")).alias("boundaries"))
    names = hosts.select("host")
    nested = names.select(F.col("host").alias("inner"), F.explode(suffixes).alias("host")).join(names, "host").groupBy("inner").agg(F.count("*").alias("d"))
    about = hosts.join(nested, F.col("host") == F.col("inner")).agg(F.count("*").alias("hosts"), F.coalesce(F.max("d"), F.lit(1)).alias("deepest"), F.coalesce(F.sum("boundaries"), F.lit(0)).alias("boundaries")).first()
    small = about.boundaries <= 2 * BROADCAST_RULES

    # Equal host and path are judged once; a hot pair is one row from here to the last join.
    keys = urls.groupBy("_host", "_path").agg(F.count("*").alias("_n"))
    shares = max(1, -(-pages.count() // max(SHARE_ROWS, SHARE_PER_BOUNDARY * 2 * about.hosts)))
    stacks = host_stacks(keys, names, about.deepest, shares).join(F.broadcast(hosts) if small else hosts, "host")
    asks = written(stacks)  # the shares and the second sweep both read them

    sizes = asks.groupBy("host").agg(F.count("*").alias("urls"), F.max("boundaries").alias("boundaries"))
    shares = sizes.select("host", F.ceil(F.col("urls") / F.greatest(F.lit(SHARE_ROWS), SHARE_PER_BOUNDARY * F.col("boundaries"))).cast("int").alias("shares"))
    dealt = F.broadcast(shares) if small else shares
    share = F.pmod(F.xxhash64("_host", "_path"), F.col("shares")).cast("int")
    points = asks.join(dealt, "host").select("host", share.alias("share"), canonical_key(F.col("host"), F.col("_path")).alias("key"), F.lit(1).alias("turn"), F.lit(0).alias("step"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("verdict"), "_host", "_path")

    ends = _edges(canonical_key(F.col("host"), F.col("path")))
    edges = own.join(dealt, "host").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("host", "path", "verdict", "share", ends.alias("e"))
    edges = edges.select("host", "share", "e.key", "e.turn", "e.step", "path", "verdict", F.lit(None).cast("string").alias("_host"), F.lit(None).cast("string").alias("_path"))

    # At one place closings come last, of longer rules first; openings come first, of shorter rules first.
    order = ["key", "turn", F.col("step") * F.length("path")]
    sweep = Window.partitionBy("host", "share").orderBy(*order)
    stack = Window.partitionBy("host", "share", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.last(F.when(F.col("step") == 1, F.struct("path", "verdict")), ignorenulls=True)
    found = (
        points.unionByName(edges)
        .withColumn("depth", F.sum("step").over(sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("top", F.when(F.col("depth") > 0, opened.over(stack)))
        .filter("turn = 1 and top is not null")
    )
    best = F.max(F.struct((F.length("host") + F.length("top.path")).alias("len"), F.length("host").alias("h"), "top.verdict", F.concat("host", "top.path").alias("rule")))
    # Written, so that its join has plain shuffles on both sides and Spark can split the rows of one hot host and path.
    verdicts = written(found.groupBy("_host", "_path").agg(best.alias("b")).select(F.col("_host").alias("_h"), F.col("_path").alias("_p"), "b.rule", "b.verdict"))
    return urls.join(verdicts, (F.col("_host") == F.col("_h")) & (F.col("_path") == F.col("_p")), "left").select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
