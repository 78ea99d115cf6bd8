"""SQL of the numbered operators that SQL can express, written from their definitions and not from their methods."""

from __future__ import annotations

from proofmill.llm import centroids as centroids_
from proofmill.llm import vector_codes as vector_codes_
from proofmill.llm.decontaminate import LEAST_EQUAL, WINDOW
from proofmill.llm.license_scan import LEAST_COVER, NEAR_DIAGONALS, templates
from proofmill.llm.mixing import SHARE, STILL, TEMPER, TOLERANCE
from proofmill.llm.near_duplicates import SHINGLE, THRESHOLD
from proofmill.llm.repetition import GRAM_LIMITS, LINE_LIMIT
from proofmill.llm.substring_dedup import WINDOW as REPEAT

WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

URL_FILTER = r"""
WITH parts AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
hp AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM hp JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hp LEFT JOIN best USING (page_id)
"""

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT doc_id, a, array_to_string(list_slice(ws, a, a + {REPEAT - 1}), ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - {REPEAT - 2})) AS a FROM w)),
first AS (SELECT g, min(doc_id) AS f FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, a + {REPEAT})) AS p FROM win JOIN first USING (g) WHERE f < doc_id),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(gone.p) AS n_removed, string_agg(x, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL) AS t FROM word LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
copy AS (SELECT text, min(doc_id) AS copy_id, count(*) AS n_copies FROM t GROUP BY text),
w AS (SELECT copy_id, regexp_extract_all({_LOWER.format('text')}, '{WORD}') AS ws FROM copy),
s AS (SELECT DISTINCT copy_id, hash(array_to_string(list_slice(ws, a, a + {SHINGLE - 1}), ' ')) AS g FROM (SELECT *, unnest(range(1, greatest(len(ws) - {SHINGLE - 2}, 2))) AS a FROM w WHERE len(ws) > 0)),
n AS (SELECT copy_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT x.copy_id AS a, y.copy_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.copy_id <> y.copy_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n na ON a = na.copy_id JOIN n nb ON b = nb.copy_id WHERE c >= {THRESHOLD} * (na.n + nb.n - c) - 1e-6),
reach(a, b) AS (SELECT copy_id, copy_id FROM copy UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
class AS (SELECT a AS copy_id, min(b) AS class_id FROM reach GROUP BY 1),
links AS (SELECT a AS copy_id, count(*) AS n_links FROM link GROUP BY 1)
SELECT doc_id, class_id, copy_id, n_copies, coalesce(n_links, 0) AS n_links, doc_id = class_id AS kept
FROM t JOIN copy USING (text) JOIN class USING (copy_id) LEFT JOIN links USING (copy_id)
"""


#: Any window with at most two words replaced has four equal words in a row at its start, its fourth or its eighth place; a shorter item that overlaps has an equal word.
DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ts FROM benchmark),
dg AS (SELECT doc_id, i, array_to_string(list_slice(ws, i + 1, i + 4), ' ') AS g FROM (SELECT *, unnest(range(0, len(ws) - 3)) AS i FROM d)),
bg AS (SELECT item_id, ts, j, array_to_string(list_slice(ts, j + 1, j + 4), ' ') AS g FROM (SELECT *, unnest(range(0, len(ts) - 3)) AS j FROM b)),
dw AS (SELECT doc_id, ws[i + 1] AS g, i FROM (SELECT *, unnest(range(0, len(ws))) AS i FROM d) WHERE EXISTS (SELECT 1 FROM b WHERE len(ts) < {WINDOW})),
bw AS (SELECT item_id, ts, ts[j + 1] AS g, j FROM (SELECT *, unnest(range(0, len(ts))) AS j FROM b WHERE len(ts) < {WINDOW})),
met AS (SELECT DISTINCT doc_id, item_id, ts, i - j AS shift FROM dg JOIN bg USING (g) WHERE len(ts) >= {WINDOW} UNION SELECT DISTINCT doc_id, item_id, ts, i - j FROM dw JOIN bw USING (g)),
part AS (SELECT doc_id, item_id, ws, ts, shift, least({WINDOW}, len(ts)) AS n, unnest(range(greatest(0, -shift), least(len(ts), len(ws) - shift) - least({WINDOW}, len(ts)) + 1)) AS lo FROM met JOIN d USING (doc_id)),
same AS (SELECT *, len(list_filter(range(lo, lo + n), lambda k: ws[k + shift + 1] = ts[k + 1])) AS equal FROM part)
SELECT doc_id, item_id, count(DISTINCT (lo, shift)) AS n_places, max(equal) AS most_equal, min(lo + shift) AS first_word, max(lo + shift + n) AS end_word, min(lo) AS item_first, max(lo + n) AS item_end
FROM same WHERE equal >= n - n * {WINDOW - LEAST_EQUAL} // {WINDOW} GROUP BY 1, 2
"""


def repetition() -> str:
    def covered(k: int, later: bool) -> str:
        which = "nth > 1" if later else "times > 1"
        return f"""g{k} AS (SELECT doc_id, a, row_number() OVER w AS nth, count(*) OVER (PARTITION BY doc_id, g) AS times FROM (SELECT doc_id, a, array_to_string(list_slice(ws, a, a + {k - 1}), ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - {k - 2})) AS a FROM w)) WINDOW w AS (PARTITION BY doc_id, g ORDER BY a)),
c{k} AS (SELECT doc_id, count(*) AS words, CAST(sum(length(x)) AS BIGINT) AS chars FROM (SELECT DISTINCT doc_id, unnest(range(a, a + {k})) AS p FROM g{k} WHERE {which}) JOIN word USING (doc_id, p) GROUP BY 1)"""

    shares = ", ".join(f"coalesce(c{k}.chars, 0) / greatest(word_chars, 1) AS gram_{k}_share" for k in GRAM_LIMITS)
    joins = " ".join(f"LEFT JOIN c{k} USING (doc_id)" for k in (3, *GRAM_LIMITS))
    limits = " AND ".join(f"gram_{k}_share <= {most}" for k, most in GRAM_LIMITS.items())
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
{covered(3, False)},
{', '.join(covered(k, True) for k in GRAM_LIMITS)},
line AS (SELECT doc_id, l, pos, length(regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars, row_number() OVER (PARTITION BY doc_id, l ORDER BY pos) AS nth FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS pos FROM w)),
lines AS (SELECT doc_id, count(*) FILTER (WHERE nth > 1) AS n_dup_lines, CAST(sum(chars) FILTER (WHERE nth > 1) AS BIGINT) AS chars FROM line WHERE chars > 0 GROUP BY 1),
base AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
m AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c3.words, 0) AS n_repeat_words, {shares}, coalesce(lines.chars, 0) / greatest(word_chars, 1) AS line_share FROM base LEFT JOIN lines USING (doc_id) {joins}),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND line_share <= {LINE_LIMIT} AND {limits} AS kept FROM f
"""


def license_scan() -> str:
    rows = ", ".join(f"({n}, '{t.label}', {t.base}, {t.words}, {t.k})" for n, t in enumerate(templates()))
    gap = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    grams = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, pos, array_to_string(list_slice(ws, pos + 1, pos + {k}), ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {k - 1})) AS pos FROM d)" for k in sorted({t.k for t in templates()}))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{gap}') AS ws FROM documents),
t(template, label, base, words, k) AS (VALUES {rows}),
tg AS (SELECT template, k, p, array_to_string(list_slice(words, p + 1, p + k), ' ') AS gram FROM (SELECT *, unnest(range(0, len(words) - k + 1)) AS p FROM t)),
dg AS ({grams}),
vote AS (SELECT DISTINCT doc_id, template, k, pos - p AS diagonal, p FROM dg JOIN tg USING (k, gram)),
diag AS (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS step FROM (SELECT DISTINCT doc_id, template, diagonal FROM vote)),
span AS (SELECT doc_id, template, diagonal, sum(CASE WHEN base OR step IS NULL OR step > {NEAR_DIAGONALS} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM diag JOIN t USING (template)),
word AS (SELECT doc_id, template, span, count(DISTINCT w) AS covered FROM (SELECT doc_id, template, span, unnest(range(p, p + k)) AS w FROM vote JOIN span USING (doc_id, template, diagonal)) GROUP BY ALL),
ends AS (SELECT doc_id, template, span, min(diagonal) AS start, max(diagonal) AS last FROM span GROUP BY ALL),
judged AS (SELECT *, covered / (len(words) + last - start) AS cover, CASE WHEN base THEN covered = len(words) ELSE covered / (len(words) + last - start) >= {LEAST_COVER} END AS good FROM ends JOIN word USING (doc_id, template, span) JOIN t USING (template)),
one AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word, list_sort(list_distinct(list(label) FILTER (WHERE base))) AS base_labels, list_sort(list_distinct(list(label))) AS labels, max(least(1.0, cover)) AS score FROM judged WHERE good GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base_labels, ','), '') AS base_labels, coalesce(array_to_string(labels, ','), '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN one USING (doc_id)
"""


def mixing() -> str:
    dims = list(TEMPER)
    space = r"[\x09-\x0D\x20]+"
    names = ", ".join(dims)
    stages = []
    for i, dim in enumerate(dims):
        stages.append(f"s{i} AS (SELECT *, CASE WHEN sum(mass * w) OVER (PARTITION BY {dim}) > 0 THEN goal_{dim} / sum(mass * w) OVER (PARTITION BY {dim}) ELSE 1.0 END AS f_{dim} FROM {'r0' if i == 0 else f'(SELECT * REPLACE (w * f_{dims[i - 1]} AS w) FROM s{i - 1})'})")
    last = len(dims) - 1
    off = ", ".join(f"abs(f_{d} - 1) * (CASE WHEN w * f_{dims[last]} > 0 THEN 1 ELSE 0 END)" for d in dims)
    goals = ", ".join(f"sum(mass) OVER () * (CASE WHEN sum(mass) OVER (PARTITION BY {d}) > 0 THEN pow(sum(mass) OVER (PARTITION BY {d}), {TEMPER[d]}) ELSE 0 END) / (SELECT sum(pow(m, {TEMPER[d]})) FROM (SELECT sum(mass) AS m FROM c0 GROUP BY {d}) WHERE m > 0) AS goal_{d}" for d in dims)
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
  CASE WHEN length(t) = 0 THEN 'empty' WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, 'License') OR contains(t, 'license') THEN 'legal' WHEN contains(t, '!!') OR contains(t, '$$$') THEN 'noise' WHEN length(t) < 1000 THEN 'short' WHEN length(t) < 6000 THEN 'medium' ELSE 'long' END AS topic,
  len(list_filter(string_split_regex(t, '{space}'), lambda x: x <> '')) AS n_tokens,
  CAST('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), t)), 1, 12) AS BIGINT) / 281474976710656.0 AS draw
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
c0 AS (SELECT {names}, CAST(sum(n_tokens) AS DOUBLE) AS mass FROM d GROUP BY ALL),
c AS (SELECT *, {goals} FROM c0),
walk AS (
  SELECT 0 AS sweep, *, CAST(1.0 AS DOUBLE) AS w, CAST(1.0 AS DOUBLE) AS worst, CAST(1.0 AS DOUBLE) AS moved FROM c
  UNION ALL
  (WITH r0 AS (SELECT *, w AS w_before FROM walk WHERE worst > {TOLERANCE} AND moved > {STILL}),
  {', '.join(stages)}
  SELECT sweep + 1, {names}, mass, {', '.join(f'goal_{x}' for x in dims)}, w * f_{dims[last]}, max(greatest({off})) OVER (), sum(mass * abs(w * f_{dims[last]} - w_before)) OVER () / nullif(sum(mass) OVER (), 0) FROM s{last})),
final AS (SELECT {names}, mass, w, worst FROM walk WHERE sweep = (SELECT max(sweep) FROM walk)),
line AS (SELECT sum(mass) OVER heavy AS m, (SELECT sum(mass * w) FROM final) - sum(mass * w) OVER heavy AS rest FROM final WHERE mass * w > 0 WINDOW heavy AS (ORDER BY w DESC ROWS UNBOUNDED PRECEDING)),
budget AS (SELECT {SHARE} * sum(mass) AS b, sum(mass * w) AS moved, sum(CASE WHEN w > 0 THEN mass ELSE 0 END) AS most FROM final),
scale AS (SELECT CASE WHEN most <= b THEN NULL ELSE greatest(b / moved, (SELECT max((b - m) / rest) FROM line WHERE rest > 1e-9 * moved)) END AS k FROM budget),
chance AS (SELECT {names}, w, worst, CASE WHEN k IS NULL THEN CAST(w > 0 AS INT) ELSE least(1.0, w * k) END AS p FROM final, scale)
SELECT doc_id, {names}, n_tokens, round(w, 6) AS weight, round(p, 6) AS probability, round(worst, 6) AS residual, draw < p AS sampled FROM d JOIN chance USING ({names})
"""


ORACLES = {
    "op2_url_filter": URL_FILTER,
    "op3_source_mixing": mixing(),
    "op4_ngram_jaccard_join": NEAR_DUPLICATES,
    "op5_substring_dedup": SUBSTRING_DEDUP,
    "op7_repetition_rules": repetition(),
    "op8_license_scan": license_scan(),
    "op10_decontamination": DECONTAMINATION,
}


def _kept(dims: int) -> str:
    fine = f"embedding IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}"
    return f"kept AS MATERIALIZED (SELECT *, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {fine})"


_FLOOR = "(({s}) - ((({s}) % {n}) + {n}) % {n}) // {n}"


def vector_codes(dims: int, parts: int, entries: int, rounds: int) -> str:
    """Lloyd rounds over the parts by full scans."""
    width = dims // parts
    at = ", ".join(f"v[p * {width} + {i + 1}] AS x{i}" for i in range(width))
    square = " + ".join(f"(x{i} - c{i}) ** 2" for i in range(width))
    steps = [
        _kept(dims),
        f"part AS MATERIALIZED (SELECT vec_id, label, p, {at} FROM kept, range({parts}) t(p))",
        "c_0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, " + ", ".join(f"x{i} AS c{i}" for i in range(width)) + f" FROM part WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))",
    ]
    for r in range(rounds + 1):
        steps.append(f"a_{r} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, p, min(d * {entries} + e) AS de, {', '.join(f'any_value(x{i}) AS x{i}' for i in range(width))} FROM (SELECT *, ({square})::BIGINT AS d FROM part JOIN c_{r} USING (p)) GROUP BY vec_id, p)")
        if r < rounds:
            moved = ", ".join(f"coalesce({_FLOOR.format(s=f's{i}', n='n')}, c{i})::BIGINT AS c{i}" for i in range(width))
            sums = ", ".join(f"sum(x{i})::BIGINT AS s{i}" for i in range(width))
            steps.append(f"c_{r + 1} AS MATERIALIZED (SELECT p, e, {moved} FROM c_{r} LEFT JOIN (SELECT p, de % {entries} AS e, count(*) AS n, {sums} FROM a_{r} GROUP BY ALL) USING (p, e))")
    numbers = " || ',' || ".join(f"c{i}" for i in range(width))
    return f"""
WITH {', '.join(steps)},
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', (de % {entries})::INT), '' ORDER BY p) AS code, sum(de // {entries})::BIGINT AS error FROM a_{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg({numbers}, ',' ORDER BY p, e)) FROM c_{rounds}) AS codebooks_sha256
FROM coded
"""


def centroid_clusters(dims: int, k: int, rounds: int, salt: str) -> str:
    """Lloyd rounds by full scans."""
    steps = [_kept(dims), f"c_0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id)) - 1 AS c, v AS w FROM kept ORDER BY sha256('{salt}' || vec_id) LIMIT {k})"]
    square = "list_inner_product(v::DOUBLE[], v::DOUBLE[]) - 2 * list_inner_product(v::DOUBLE[], w::DOUBLE[]) + list_inner_product(w::DOUBLE[], w::DOUBLE[])"
    for r in range(rounds + 1):
        steps.append(f"a_{r} AS MATERIALIZED (SELECT vec_id, min(d * {k} + c) AS dc FROM (SELECT vec_id, c, ({square})::BIGINT AS d FROM kept, c_{r}) GROUP BY vec_id)")
        if r < rounds:
            steps.append(f"m_{r} AS MATERIALIZED (SELECT c, list({_FLOOR.format(s='s', n='n')} ORDER BY i) AS w FROM (SELECT dc % {k} AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM kept JOIN a_{r} USING (vec_id), range(1, {dims + 1}) t(i) GROUP BY ALL) GROUP BY c)")
            steps.append(f"c_{r + 1} AS MATERIALIZED (SELECT c, coalesce(m_{r}.w, c_{r}.w) AS w FROM c_{r} LEFT JOIN m_{r} USING (c))")
    return f"""
WITH {', '.join(steps)},
last AS (SELECT vec_id, (dc % {k})::INT AS cluster, dc // {k} AS distance FROM a_{rounds})
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(w, ',')) AS centroid_sha256
FROM last JOIN c_{rounds} ON c = cluster
"""


ORACLES |= {
    "op11_vector_codes": vector_codes(vector_codes_.DIMS, vector_codes_.PARTS, vector_codes_.ENTRIES, vector_codes_.ROUNDS),
    "op12_centroid_clusters": centroid_clusters(centroids_.DIMS, centroids_.CENTROIDS, centroids_.ROUNDS, centroids_.SALT),
}
