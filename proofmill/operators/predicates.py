"""Composite predicates: candidate evidence, clean retries, validation with coded issues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofmill.functions import text as T

#: Routes that can credit an account, by the evidence they need.
CARD_ROUTES = ("profile_similar", "following")
WORK_ROUTES = ("keyword_content", "hashtag_content", "brand_tagged", "profile_collab_authors", "profile_credit_repost")
AUTHOR_KINDS = ("content_author", "cached_content_author")
LOOKUP_VARIANTS = ("named_profile_lookup", "named_profile_from_verified_prior_work")


def either(df, camel: str) -> Column:
    """A field by its camel-case or its snake-case name, whichever the frame has; NULL if neither."""
    snake = "".join(f"_{c.lower()}" if c.isupper() else c for c in camel)
    found = [F.col(n) for n in dict.fromkeys((camel, snake)) if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def candidate_evidence(row: dict[str, Column], hosts: list[str]) -> Column:
    """May this observation credit its handle?

    Account cards need a source on the site; authors need a work url that
    agrees with the content id; a named lookup needs its whole chain: seed,
    profile url, parent seed, source work and cue.
    """
    handle, site = row["handle"], T.site_path(row["source_url"], hosts).isNotNull()
    by_card = row["route_id"].isin(*CARD_ROUTES) & (row["evidence_kind"] == "account_card") & site
    work = F.coalesce(*[T.work_url(row[c], hosts) for c in ("content_url", "work_url", "source_url", "source_work_url")])
    same_work = row["content_id"].isNull() | (row["content_id"] == work["shortcode"]) | F.endswith(row["content_id"], F.concat(F.lit(":work:"), work["shortcode"]))
    by_author = row["route_id"].isin(*WORK_ROUTES) & row["evidence_kind"].isin(*AUTHOR_KINDS) & work.isNotNull() & same_work
    chain = [
        row["route_id"] == "profile_credit_repost", row["evidence_kind"] == "profile", row["lookup_only"], row["route_variant"].isin(*LOOKUP_VARIANTS),
        handle == T.normal_handle(row["seed"], hosts), T.normal_handle(row["source_url"], hosts) == handle, T.normal_handle(row["parent_seed"], hosts).isNotNull(),
        T.work_url(row["source_work_url"], hosts).isNotNull(), T.nonempty(row["cue_evidence_id"]).isNotNull(),
    ]
    by_lookup = F.lit(True)
    for c in chain:
        by_lookup = by_lookup & F.coalesce(c, F.lit(False))
    return handle.isNotNull() & F.coalesce(by_card, F.lit(False)) | handle.isNotNull() & F.coalesce(by_author, F.lit(False)) | handle.isNotNull() & by_lookup


def cost_role(explicit: Column, phase: Column, slot: Column, route: Column) -> Column:
    """The stated role if it is one; else diagnostic phases, enrichment routes, discovery."""
    known = ("discovery", "enrichment", "diagnostic")
    return (
        F.when(explicit.isNotNull(), F.when(explicit.isin(*known), explicit).otherwise("unknown"))
        .when((phase == "diagnostic") | (slot == "diagnostic"), "diagnostic")
        .when(route.rlike(r"(?i)^(?:profile_)?enrich(?:ment)?$"), "enrichment")
        .otherwise("discovery")
    )


def clean_retry(kind: str) -> Column:
    """Is a journal row (with its audit row as struct `audit`) bounded retry evidence of this kind?

    The page's own facts must agree with its audit row in every field before
    the kind (incomplete, terminal or advancing) is looked at.
    """
    c, a = F.col, lambda n: F.col(f"audit.{n}")
    ids = F.transform("posts", lambda p: p["post_id"])
    base = [
        c("page") >= 1, T.nonempty(c("request_cursor")).isNotNull(), c("posts").isNotNull(), F.forall(ids, lambda i: F.coalesce(i.rlike(r"^\d+$"), F.lit(False))), F.size(F.array_distinct(ids)) == F.size(ids),
        a("kind") == "page", a("page") == c("page"), a("status").eqNullSafe(c("status")), a("stream_final").eqNullSafe(c("stream_final")), a("has_next").eqNullSafe(c("has_next")),
        a("http_status") == 200, a("frame_count") >= 1, a("malformed_frames") == 0, a("rejected_stories") == 0, F.size(a("errors")) == 0, a("count") == F.size("posts"),
        a("ids") == ids, a("dates").eqNullSafe(F.transform("posts", lambda p: p["published_at"])),
    ]
    n, no_cursor = F.size("posts"), F.col("next_cursor").isNull()
    kinds = {
        "incomplete": [c("status") == "pagination_incomplete", ~c("stream_final"), c("has_next").isNull(), no_cursor, n.between(1, 3)],
        "terminal": [c("status") == "ok", c("stream_final"), ~c("has_next"), no_cursor, n == 0],
        "advancing": [c("status") == "ok", c("stream_final"), c("has_next"), n == 3, T.nonempty(c("next_cursor")).isNotNull(), c("next_cursor") != c("request_cursor")],
    }
    out = F.lit(True)
    for cond in base + kinds[kind]:
        out = out & F.coalesce(cond, F.lit(False))
    return out
