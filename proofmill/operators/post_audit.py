"""The audit of saved posts: one JSON document a run, three lists of posts in it, and 38 codes for what can be wrong.

Documents are taken apart as variants, once: a row for each entry of each list,
with the counts that its run states.  Posts, lists and runs have their own parts
of the rule table; what a post alone decides is judged where it is taken out,
and only a repeated post id and the counts of a run need a shuffle.  A document that is no JSON object has no rows (`trees.unread` lists
it); a field that is JSON null counts as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.folders import written
from proofmill.functions import values as V
from proofmill.functions.text import whole_json
from proofmill.operators.rules import Rule, compiled, judged

BUCKETS = {"posts": "in_range_count", "outside_range_posts": "outside_range_count", "undated_posts": "unknown_date_count"}
TEXTS = ("url", "body", "shared_body", "published_at", "collected_at", "shares_raw", "reactions_raw", "comments_raw")
METRICS = ("shares", "reactions", "comments")
SAID = [f"said_{b}" for b in BUCKETS]
OBSERVED = ("body", "url", "publication_time")
_OTHERS = ("post_id", "published_at_raw", "count_observed_at", "field_observed_at", "retained_fields", "media_types", "attachment_count", "is_shared", "body_known", "body_truncated")
_NO_NUMBER = "num_{f} < 0 OR num_{f} <> floor(num_{f})"
_LABEL = "kind_{f} IN ('NONE', 'STRING') AND label_{f} IS NOT NULL"
_COMPACT = r"rlike(label_{f}, '(?i)\\d(?:[.,]\\d+)?\\s*(?:[kmb]\\b|[万亿萬億千])')"
_ONE_NUMBER = r"size(regexp_extract_all(label_{f}, '\\d{1,3}(?:[,\\u00a0 ]\\d{3})+|\\d+', 0)) = 1 AND NOT rlike(label_{f}, '-\\s*\\d|\\d\\.\\d')"

#: The 38 codes with area and level are fixed values; the conditions are over the columns that `_post_columns` makes.
RUN_RULES = [
    Rule("METADATA_COUNT_MISMATCH", "validity", "error", "said_{f} IS NOT NULL AND said_{f} <> have_{f}", tuple(BUCKETS)),
    Rule("UNKNOWN_DATES_PREVENT_FULL_WINDOW_VERIFICATION", "coverage", "warning", "undated > 0"),
]
BUCKET_RULES = [
    Rule("BUCKET_IS_NULL", "validity", "error", "kind = 'VOID'"),
    Rule("BUCKET_NOT_ARRAY", "validity", "error", "kind NOT IN ('VOID', 'ARRAY')"),
]
POST_RULES = [
    Rule("POST_NOT_OBJECT", "validity", "error", "kind <> 'OBJECT'"),
    Rule("NUMERIC_ID_COERCED_TO_TEXT", "review", "warning", "kind_post_id = 'BIGINT' AND num_post_id >= 0"),
    Rule("INVALID_POST_ID", "validity", "error", r"NOT coalesce(rlike(post_id, '^\\d+$'), false)"),
    Rule("DUPLICATE_POST_ID", "validity", "error", r"rlike(post_id, '^\\d+$') AND place > 1"),
    Rule("URL_ID_OR_GROUP_MISMATCH", "validity", "error", "NOT coalesce(url_post = post_id AND array_contains(aliases, url_group), false)"),
    Rule("TEXT_FIELD_NOT_TEXT", "validity", "error", "kind_{f} NOT IN ('NONE', 'STRING')", TEXTS),
    Rule("UNKNOWN_PUBLICATION_DATE", "review", "warning", "published IS NULL"),
    Rule("TARGET_POST_OUTSIDE_SCOPE", "validity", "error", "bucket = 'posts' AND NOT (published BETWEEN starts AND ends)"),
    Rule("OUTSIDE_BUCKET_CONTAINS_TARGET_POST", "validity", "error", "bucket = 'outside_range_posts' AND published BETWEEN starts AND ends"),
    Rule("DATED_POST_IN_UNDATED_BUCKET", "review", "warning", "bucket = 'undated_posts' AND published IS NOT NULL AND starts IS NOT NULL AND ends IS NOT NULL"),
    Rule("EPOCH_ISO_MISMATCH", "validity", "error", "abs(epoch - unix_micros(published) / 1e6) > 0.001"),
    Rule("INVALID_EPOCH", "validity", "error", "num_published_at_raw IS NOT NULL AND NOT (num_published_at_raw BETWEEN -62135596800 AND 253402300799)"),
    Rule("INVALID_RAW_TIME_TYPE", "validity", "error", "num_published_at_raw IS NULL AND kind_published_at_raw NOT IN ('NONE', 'STRING')"),
    Rule("UNKNOWN_COLLECTION_TIME", "review", "warning", "collected IS NULL"),
    Rule("INVALID_COUNT", "validity", "error", _NO_NUMBER, METRICS),
    Rule("INVALID_COUNT_TYPE", "validity", "error", "num_{f} IS NULL AND kind_{f} NOT IN ('NONE', 'STRING')", METRICS),
    Rule("COUNT_NOT_AVAILABLE", "review", "warning", "kind_{f} IN ('NONE', 'STRING') AND label_{f} IS NULL", METRICS),
    Rule("APPROXIMATE_COUNT", "review", "warning", f"{_LABEL} AND {_COMPACT}", METRICS),
    Rule("UNREADABLE_COUNT", "validity", "error", f"{_LABEL} AND NOT {_COMPACT} AND NOT ({_ONE_NUMBER})", METRICS),
    Rule("INVALID_COUNT_OBSERVATION_OBJECT", "validity", "error", "kind_count_observed_at NOT IN ('NONE', 'OBJECT')"),
    Rule("INVALID_COUNT_OBSERVATION_TIME", "validity", "error", "seen_kind_{f} <> 'NONE' AND seen_{f} IS NULL", METRICS),
    Rule("COUNT_OBSERVATION_TIME_UNAVAILABLE", "review", "warning", f"seen_{{f}} IS NULL AND (num_{{f}} IS NOT NULL OR ({_LABEL} AND (kind_{{f}} = 'STRING' OR {_COMPACT} OR ({_ONE_NUMBER}))))", METRICS),
    Rule("INVALID_FIELD_OBSERVATION_OBJECT", "validity", "error", "kind_field_observed_at NOT IN ('NONE', 'OBJECT')"),
    Rule("INVALID_FIELD_OBSERVATION_TIME", "validity", "error", "seen_kind_{f} <> 'NONE' AND seen_{f} IS NULL", tuple(f"of_{f}" for f in OBSERVED)),
    Rule("INVALID_RETAINED_FIELDS", "validity", "error", "kind_retained_fields NOT IN ('NONE', 'ARRAY')"),
    Rule("INVALID_FIELD_RETENTION_RECORD", "validity", "error", "size(retained) > kept"),
    Rule("FIELDS_RETAINED_FROM_PRIOR_OBSERVATION", "review", "warning", "kept > 0"),
    Rule("INVALID_MEDIA_TYPES", "validity", "error", "NOT media_fine"),
    Rule("INVALID_ATTACHMENT_COUNT", "validity", "error", "kind_attachment_count <> 'NONE' AND (kind_attachment_count <> 'BIGINT' OR num_attachment_count < 0)"),
    Rule("INVALID_SHARED_FLAG", "validity", "error", "kind_is_shared NOT IN ('NONE', 'BOOLEAN')"),
    Rule("INVALID_BODY_KNOWN_FLAG", "validity", "error", "kind_body_known NOT IN ('NONE', 'BOOLEAN')"),
    Rule("BODY_UNAVAILABLE", "review", "warning", "class = 'unavailable'"),
    Rule("EMPTY_BODY_UNCLASSIFIED", "review", "warning", "class = 'unclassified'"),
    Rule("BODY_TRUNCATED", "review", "warning", "flag_body_truncated"),
]


def _kind(v: Column, none: str | None = None) -> Column:
    kind = F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)
    return kind if none is None else F.coalesce(F.nullif(kind, F.lit("VOID")), F.lit(none))


def _large_kind(v: Column, kind: str, as_type: str) -> Column:
    """The kind of a value that is mostly a large array or object: its schema, which walks through all of it, is only made for other values."""
    return F.when(F.try_variant_get(v, "$", as_type).isNotNull(), kind).otherwise(_kind(v))


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _text(v: Column, path: str) -> Column:
    return F.when(_kind(_at(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def _url(url: Column) -> tuple[Column, Column]:
    """Group and post that a post's address names; NULL for any other address."""
    pattern = r"^https://(?:[A-Za-z0-9-]+\.)*facebook\.com(?::\d+)?/groups/([^/?#]+)/(?:posts|permalink)/(\d+)/?(?:[?#].*)?$"
    return F.nullif(F.try_url_decode(F.regexp_extract(url, pattern, 1)), F.lit("")), F.nullif(F.regexp_extract(url, pattern, 2), F.lit(""))


def _documents(df: DataFrame, run: str, document: str) -> DataFrame:
    """A row for each document that is an object: run, starts, ends, aliases, said counts, v."""
    v = F.col("v")
    group = F.regexp_extract(F.coalesce(F.col("_url"), F.lit("")), r"^https://(?:[A-Za-z0-9-]+\.)*facebook\.com(?::\d+)?/groups/([^/?#]+)", 1)
    aliases = F.array_compact(F.array(F.try_variant_get(v, "$.metadata.group_id", "string"), F.nullif(F.try_url_decode(group), F.lit(""))))
    # Generated, not projected: a filter on v doesn't parse the document once more.
    objects = df.filter(F.col(document).rlike(r"^[ \t\r\n]*\{"))
    parsed = objects.select(F.col(run).alias("run"), F.inline(F.array(F.struct(whole_json(F.col(document)).alias("v"))))).filter("v is not null")
    texts = parsed.select("run", "v", *[_text(v, f"$.metadata.{f}").alias(f"_{f.split('_')[-1]}") for f in ("start", "end", "group_url")])
    return texts.select("run", "v", V.zoned_time(F.col("_start")).alias("starts"), V.zoned_time(F.col("_end")).alias("ends"), aliases.alias("aliases"), *[F.try_variant_get(v, f"$.metadata.{m}", "bigint").alias(f"said_{b}") for b, m in BUCKETS.items()])


def _entries(df: DataFrame, run: str, document: str) -> DataFrame:
    """A row for each entry of each list, with its document's columns; a list that is absent, empty or no array is one row without index."""
    lists = _documents(df, run, document).select("run", "starts", "ends", "aliases", *SAID, F.explode(F.array(*[F.struct(F.lit(i).alias("bucket_no"), F.lit(b).alias("bucket"), _at(F.col("v"), f"$.{b}").alias("list")) for i, b in enumerate(BUCKETS)])).alias("_b"))
    lists = lists.select("run", "starts", "ends", "aliases", *SAID, "_b.*").withColumn("list_kind", F.when(F.col("list").isNotNull(), _large_kind(F.col("list"), "ARRAY", "array<variant>")))
    array = F.when(F.col("list_kind") == "ARRAY", F.col("list"))
    return lists.lateralJoin(df.sparkSession.tvf.variant_explode_outer(array.outer())).drop("list", "key").withColumnsRenamed({"value": "v", "pos": "index"})


def _post_columns(posts: DataFrame) -> DataFrame:
    """The columns that the rules name but `place`.  What is used more than once is a column of an earlier projection, so that it is evaluated once."""
    v, c = F.col("v"), F.col
    inside = {f: f"$.count_observed_at.{f}" for f in METRICS} | {f"of_{f}": f"$.field_observed_at.{f}" for f in OBSERVED}
    fields = list(dict.fromkeys([*TEXTS, *METRICS, *_OTHERS]))
    posts = posts.withColumns({f"_{f}": _at(v, f"$.{f}") for f in fields} | {f"_seen_{f}": _at(v, p) for f, p in inside.items()})
    posts = posts.withColumns({"kind": _large_kind(v, "OBJECT", "map<string, variant>")} | {f"kind_{f}": _kind(c(f"_{f}"), "NONE") for f in fields} | {f"seen_kind_{f}": _kind(c(f"_seen_{f}"), "NONE") for f in inside})
    text = lambda f, kind="kind_": F.when(c(f"{kind}{f}") == "STRING", F.try_variant_get(c(f"_{'seen_' if kind != 'kind_' else ''}{f}"), "$", "string"))
    number = lambda f: F.when(c(f"kind_{f}").isin("BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(c(f"_{f}"), "$", "double"))
    flag = lambda f: F.when(c(f"kind_{f}") == "BOOLEAN", F.try_variant_get(c(f"_{f}"), "$", "boolean"))
    posts = posts.withColumns(
        {f"text_{f}": text(f) for f in (*TEXTS, *METRICS, "post_id", "published_at_raw")} | {f"seen_text_{f}": text(f, "seen_kind_") for f in inside}
        | {f"num_{f}": number(f) for f in (*METRICS, "post_id", "published_at_raw", "attachment_count")} | {f"flag_{f}": flag(f) for f in ("body_truncated", "body_known", "is_shared")}
        | {"retained": F.coalesce(F.try_variant_get(c("_retained_fields"), "$", "array<variant>"), F.array().cast("array<variant>")), "media": F.try_variant_get(c("_media_types"), "$", "array<variant>")}
    )
    url_group, url_post = _url(c("text_url"))
    label = {f"label_{m}": F.when(F.trim(F.coalesce(c(f"text_{m}"), F.lit(""))) != "", c(f"text_{m}")).otherwise(F.nullif(c(f"text_{m}_raw"), F.lit(""))) for m in METRICS}
    raw = F.coalesce(c("num_published_at_raw"), F.when(c("text_published_at_raw").rlike(r"^\d+(?:\.\d+)?$"), c("text_published_at_raw").cast("double")))
    record = lambda r: _text(r, "$.field").isin("body", "url", "published_at") & (_text(r, "$.reason") == "unavailable_in_new_observation") & V.zoned_time(_text(r, "$.from_collected_at")).isNotNull()
    array = c("kind_media_types") == "ARRAY"
    posts = posts.withColumns(label | {f"seen_{f}": V.zoned_time(c(f"seen_text_{f}")) for f in inside} | {
        "post_id": F.coalesce(c("text_post_id"), F.when((c("kind_post_id") == "BIGINT") & (c("num_post_id") >= 0), F.try_variant_get(c("_post_id"), "$", "string"))),
        "url_group": url_group, "url_post": url_post, "published": V.zoned_time(c("text_published_at")), "collected": V.zoned_time(c("text_collected_at")), "epoch": raw,
        "media_fine": (c("kind_media_types") == "NONE") | F.coalesce(array & F.forall("media", lambda m: F.coalesce(_kind(m) == "STRING", F.lit(False))), F.lit(False)),
        "n_media": F.when(array, F.size("media")), "kept": F.size(F.filter("retained", lambda r: F.coalesce(record(r), F.lit(False)))),
    })
    some = lambda t: F.coalesce(F.trim(c(t)) != "", F.lit(False))
    attached = (c("kind_attachment_count") == "BIGINT") & (c("num_attachment_count") > 0)
    return posts.withColumn("class", F.when(some("text_body"), "body").when(c("flag_body_known") == F.lit(False), "unavailable").when(F.coalesce(c("flag_is_shared"), F.lit(False)) | some("text_shared_body"), "shared").when(c("media_fine") & (c("n_media") > 0), "media").when(attached, "attachment").otherwise("unclassified"))


def _placed(posts: DataFrame) -> DataFrame:
    return posts.withColumn("place", F.row_number().over(Window.partitionBy("run", "post_id").orderBy("bucket_no", "index")))


def audit_posts(df: DataFrame, run: str, document: str, strict: bool = False) -> DataFrame:
    """P20: run, bucket, index, valid, issues of every post; a post without issues has an empty list."""
    posts = _placed(_post_columns(_entries(df, run, document).filter("index is not null")))
    return judged(posts, POST_RULES, strict).select("run", "bucket", "index", "post_id", "valid", "issues")


def audit_log(df: DataFrame, run: str, document: str) -> DataFrame:
    """P20: one row for each issue of runs, lists and posts: run, bucket, index, area, level, code, field.

    Documents are read once: each entry of a list is judged where it is taken out,
    and its issues are written with the few columns that the other rules need.
    """
    entries = _post_columns(_entries(df, run, document))
    alone, by_place = [r for r in POST_RULES if "place" not in r.holds], [r for r in POST_RULES if "place" in r.holds]
    is_post = F.col("index").isNotNull()
    kept = written(entries.withColumn("issues", F.when(is_post, compiled(entries, alone))).select("run", "bucket_no", "bucket", "index", "list_kind", *SAID, "post_id", (is_post & F.col("published").isNull()).alias("undated"), "issues"))
    posts = kept.filter(is_post)
    lists = kept.filter("list_kind is not null and coalesce(index, 0) = 0").withColumnRenamed("list_kind", "kind")
    runs = kept.filter("bucket_no = 0 and coalesce(index, 0) = 0").select("run", *SAID)
    found = posts.groupBy("run").agg(F.count_if("undated").alias("undated"), *[F.count_if(F.col("bucket") == b).alias(f"have_{b}") for b in BUCKETS])
    counted = runs.join(found.withColumnRenamed("run", "_run"), F.col("run") == F.col("_run"), "left").fillna(0, ["undated", *[f"have_{b}" for b in BUCKETS]])
    place = lambda rows, bucket, index: rows.select("run", bucket.alias("bucket"), index.cast("int").alias("index"), F.explode("issues").alias("i")).select("run", "bucket", "index", "i.*")
    none = F.lit(None).cast("string")
    return (
        place(posts, F.col("bucket"), F.col("index"))
        .unionByName(place(judged(_placed(posts.drop("issues")), by_place), F.col("bucket"), F.col("index")))
        .unionByName(place(judged(lists.drop("issues"), BUCKET_RULES), F.col("bucket"), none))
        .unionByName(place(judged(counted, RUN_RULES), none, none))
    )
