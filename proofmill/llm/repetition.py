"""Quality rules: repetition coverage by rolling n-gram hashes (operator 7).

Every n-gram of words of a text is hashed in numpy; equal hashes in one text
are repeats.  The characters below repeated n-grams and repeated lines, as a
share of the text's word characters, decide whether the text is kept.  One
narrow map over whole texts: no shuffle, memory bounded by a slice of rows.

Defined cases: a null or empty text, or one of white space, has no words and
fails the base rule (fewer than min_words); repeated rows are judged alike; a
null id is returned as null; a very long text is measured whole; equal lines and
windows have their places for an order, so no tie is left; an empty table gives an empty result; other input
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from proofmill.llm import textgrid as tg
from proofmill.llm.common import longs, map_slices

#: Largest share of word characters inside n-grams seen before in the text, by n, and inside lines seen before.
GRAM_LIMITS = {5: 0.45, 7: 0.40, 10: 0.35}
LINE_LIMIT = 0.40

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is it equal to an earlier one; is it equal to any other one."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    if len(keys):
        ranked = keys[order]
        same[1:-1] = ranked[1:] == ranked[:-1]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = same[:-1]
    any_[order] = same[:-1] | same[1:]
    return later, any_


def _covered(marked: np.ndarray, k: int, n_words: int) -> np.ndarray:
    """Words below a marked window of k words."""
    step = np.zeros(n_words + 1, np.int32)
    at = np.flatnonzero(marked)
    np.add.at(step, at, 1)
    np.add.at(step, at + k, -1)
    return np.cumsum(step)[:n_words] > 0


def measure(s: tg.Slice, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """The counts of each row of a slice; gram_<n> and line are characters of repeated n-grams and lines."""
    n, data, off = s.rows, s.data, s.offsets
    w = tg.words(s)
    in_text = np.concatenate([[0], np.cumsum(~tg.SPACE[data] & ((data & 0xC0) != 0x80))])
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[data])])
    chars = in_text[w.ends] - in_text[w.starts]
    by_row = lambda weights: np.bincount(w.row, weights, n).astype(np.int64)
    hashes = tg.segment_hash(data, w.starts, w.ends)
    row_code = tg.mix(np.arange(1, n + 1, dtype=np.uint64))
    out = {"n_words": np.diff(w.bounds), "word_chars": in_text[off[1:]] - in_text[off[:-1]], "n_symbols": symbols[off[1:]] - symbols[off[:-1]]}
    for k in (3, *lengths):
        grams, valid = tg.window_hash(hashes, k), tg.window_valid(w.row, k)
        at = np.flatnonzero(valid)
        later, any_ = _groups(grams[at] ^ row_code[w.row[at]])
        marked = np.zeros(len(w.row), bool)
        if k == 3:
            marked[at[any_]] = True
            out["n_repeat_words"] = by_row(_covered(marked, 3, len(w.row)))
        if k in lengths:
            marked[:] = False
            marked[at[later]] = True
            out[f"gram_{k}"] = by_row(_covered(marked, k, len(w.row)) * chars)
    lines = tg.words(s, NEWLINE)
    line_chars = in_text[lines.ends] - in_text[lines.starts]
    full = np.flatnonzero(line_chars > 0)
    row = lines.row[full]
    later, _ = _groups(tg.segment_hash(data, lines.starts[full], lines.ends[full]) ^ row_code[row])
    out["n_dup_lines"] = np.bincount(row, later, n).astype(np.int64)
    out["line"] = np.bincount(row, later * line_chars[full], n).astype(np.int64)
    return out


def repetition_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    gram_limits: dict[int, float] | None = None,
    line_limit: float = LINE_LIMIT,
    min_words: int = 50,
) -> DataFrame:
    """One row for each input row: its counts, the covered shares and the verdict `kept`."""
    limits = GRAM_LIMITS if gram_limits is None else gram_limits
    kind = docs.schema[id_col].dataType.simpleString()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = [f"gram_{k}" for k in limits]
    schema = ", ".join([f"{id_col} {kind}", *[f"{c} bigint" for c in counts], "base_failed boolean", "kept boolean", *[f"{c}_share double" for c in [*shares, "line"]]])

    def judge(s: tg.Slice, rows: pa.RecordBatch) -> list[pa.Array]:
        m = measure(s, tuple(limits))
        failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        total = np.maximum(m["word_chars"], 1)
        part = {c: m[c] / total for c in [*shares, "line"]}
        kept = ~failed & (part["line"] <= line_limit)
        for k, most in limits.items():
            kept &= part[f"gram_{k}"] <= most
        return [rows.column(0), *[longs(m[c]) for c in counts], pa.array(failed), pa.array(kept), *[pa.array(v) for v in part.values()]]

    return map_slices(docs, text_col, [id_col], judge, schema)
