"""Token counts by the whole-token shortcut (operator 6).

Loading a tokenizer proves, once for each Python worker, which vocabulary
strings stand for a whole pre-token that the tokenizer itself encodes alone as
one token.  Pre-tokens found there count one without merging; only the rest are
merged by the library, and a bounded memo keeps their counts.

Pre-tokens are cut in numpy, a slice of texts at a time, by the kind of each code
point: letters, numbers, white space and others.  Loading asks the library's own
pre-tokenizer about every code point; texts with one on which it and the table
of kinds differ, as Unicode versions do, go whole to the library, and so do texts
that hold an added special string or whose normal form isn't stable.  Each different pre-token of a slice is looked
up once.  The map is narrow: no shuffle, no state between rows but the memo.

Defined cases: null and empty texts have 0 bytes and 0 tokens; a null id stays
null; repeated rows are counted alike; a text of any length is cut at white space
into parts of bounded size; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm import textgrid as tg
from proofmill.llm.common import bounded_batches

#: Pre-tokens that the memo keeps, and how long they may be.
MEMO_ENTRIES = 1 << 18
MEMO_CHARS = 64
#: Code points that are cut at once.
SLICE_CHARS = 1 << 20
#: Fixed value: the splitting expression that the kinds of code points stand for, and its endings after an apostrophe.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
OTHER, LETTER, NUMBER, SPACE, DOUBTFUL = range(5)


class WholeTokenCounter:
    """Counts the tokens of texts as a `tokenizers` file with word ends gives them."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        import regex
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        spec = json.loads(self.lib.to_str())
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.norm = self.lib.normalizer.normalize_str if self.lib.normalizer else (lambda x: x)
        if self._pattern(spec) != PATTERN:
            raise ValueError("the whole-token shortcut needs the splitting expression PATTERN")
        self.pattern = regex.compile(PATTERN, regex.V1)
        self.kinds = self._kinds(regex)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.latin_lower = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"}
        self.limit = memo_entries
        self.whole = self._prove(spec)
        self.memo: dict[str, int] = {}

    @staticmethod
    def _pattern(spec: dict) -> str:
        """The expression whose matches are the pre-tokens, as the file states it."""
        parts = [spec["pre_tokenizer"]] if spec["pre_tokenizer"]["type"] != "Sequence" else spec["pre_tokenizer"]["pretokenizers"]
        splits = [p for p in parts if p["type"] == "Split"]
        if len(splits) != 1 or not splits[0]["invert"] or splits[0]["behavior"] != "Removed":
            raise ValueError("the whole-token shortcut needs one splitting expression whose matches are the pre-tokens")
        return splits[0]["pattern"]["Regex"]

    def _kinds(self, regex) -> np.ndarray:
        """The kind of each code point; DOUBTFUL where the library's pre-tokenizer disagrees."""
        points = np.array([i for i in range(0x110000) if not 0xD800 <= i < 0xE000], np.uint32)
        text = points.tobytes().decode("utf-32-le")
        kinds = np.full(0x110000, OTHER, np.uint8)
        for kind, cls in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            kinds[_points("".join(regex.findall(cls, text)))] = kind
        cut = self.lib.pre_tokenizer.pre_tokenize_str

        def agrees(part: np.ndarray, kind: int) -> bool:
            s = part.tobytes().decode("utf-32-le")
            letter, other = len(cut("a" + s)), len(cut("-" + s))
            want = {LETTER: (1, 2), OTHER: (2, 1), NUMBER: (len(part) + 1, len(part) + 1), SPACE: (1, 1)}[kind]
            return (letter, other) == want and (kind != SPACE or not cut(s))

        def doubt(part: np.ndarray, kind: int) -> None:
            if agrees(part, kind):
                return
            if len(part) == 1:
                kinds[part[0]] = DOUBTFUL
                return
            doubt(part[: len(part) // 2], kind)
            doubt(part[len(part) // 2 :], kind)

        for kind in (OTHER, LETTER, NUMBER, SPACE):
            mine = points[kinds[points] == kind]
            for lo in range(0, len(mine), 4096):
                doubt(mine[lo : lo + 4096], kind)
        return kinds

    def _prove(self, spec: dict) -> frozenset[str]:
        """Pre-tokens that the library encodes alone as exactly one token."""
        end = spec["model"].get("end_of_word_suffix") or ""
        byte_of = {c: b for b, c in _byte_letters().items()}
        texts = []
        for token in spec["model"]["vocab"]:
            if end and not token.endswith(end):
                continue
            raw = token[: len(token) - len(end)]
            try:
                text = bytes(byte_of[c] for c in raw).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if text and self.norm(text) == text and self.pattern.findall(text) == [text] and not any(s in text for s in self.special):
                texts.append(text)
        found = self.lib.encode_batch(texts, add_special_tokens=False)
        return frozenset(t for t, e in zip(texts, found, strict=True) if len(e.ids) == 1)

    def normal(self, text: str) -> str:
        """The library's normal form.  Latin-1 letters have no combining forms and one lower case, and white space is dropped, so plain lower() gives the same pre-tokens there."""
        if self.latin_lower:
            try:
                text.encode("latin-1")
                return text.lower()
            except UnicodeEncodeError:
                pass
        return self.norm(text)

    def stable(self, text: str) -> bool:
        """Whether the normal form of the normal form is itself, so that pieces can be merged alone: the one letter that lower-cases to two may break that."""
        if "\u0130" not in text:
            return True
        once = self.norm(text)
        return self.norm(once) == once

    def merged(self, piece: str) -> int:
        return len(self.lib.encode(piece, add_special_tokens=False).ids)

    def pieces(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points of a normal text, their kinds, and starts and ends of its pre-tokens."""
        points = _points(text)
        kinds, n = self.kinds[points], len(points)
        start = kinds != SPACE
        start[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
        alone = np.flatnonzero(start & (points == 0x27))
        alone = alone[alone + 1 < n]
        alone = alone[kinds[alone + 1] == LETTER]
        after = np.append(points, np.zeros(3, points.dtype))
        for ending in ENDINGS:
            here = alone[np.logical_and.reduce([after[alone + 1 + i] == ord(x) for i, x in enumerate(ending)])]
            start[here + 1] = False
            rest = here + 1 + len(ending)
            rest = rest[rest < n]
            start[rest[kinds[rest] == LETTER]] = True
        starts = np.flatnonzero(start)
        stops = np.append(np.flatnonzero(start | (kinds == SPACE)), n)
        return points, kinds, starts, stops[np.searchsorted(stops, starts, "right")]

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        part, rows, size = [], [], 0
        for i, whole in enumerate(texts):
            for text in _cut(whole):
                if any(s in text for s in self.special) or not self.stable(text):
                    out[i] += self.merged(text)
                    continue
                part.append(text)
                rows.append(i)
                size += len(text)
                if size >= SLICE_CHARS:
                    np.add.at(out, rows, self._slice(part))
                    part, rows, size = [], [], 0
        if part:
            np.add.at(out, rows, self._slice(part))
        return out

    def count(self, text: str) -> int:
        return int(self.counts([text])[0])

    def _slice(self, texts: list[str]) -> np.ndarray:
        normal = [self.normal(t) for t in texts]
        joined = "\n".join(normal)
        begins = np.cumsum([0, *[len(t) + 1 for t in normal]])
        points, kinds, starts, ends = self.pieces(joined)
        row = np.searchsorted(begins, starts, "right") - 1
        hashes = tg.segment_hash(points.view(np.uint8), starts * 4, ends * 4)
        _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        different = [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        out = np.bincount(row, self._looked_up(different)[of], len(texts)).astype(np.int64)
        for i in np.unique(np.searchsorted(begins, np.flatnonzero(kinds == DOUBTFUL), "right") - 1):
            out[i] = self.merged(texts[i])
        return out

    def _looked_up(self, pieces: list[str]) -> np.ndarray:
        """The number of tokens of each of different pre-tokens."""
        whole, memo = self.whole, self.memo
        got = [1 if p in whole else memo.get(p, 0) for p in pieces]
        missing = [i for i, n in enumerate(got) if not n]
        if missing:
            found = self.lib.encode_batch([pieces[i] for i in missing], add_special_tokens=False)
            if len(memo) + len(missing) > self.limit:
                memo.clear()
            for i, e in zip(missing, found, strict=True):
                got[i] = len(e.ids)
                if len(pieces[i]) <= MEMO_CHARS and len(memo) < self.limit:
                    memo[pieces[i]] = got[i]
        return np.array(got, np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _cut(text: str) -> Iterator[str]:
    """The text in parts of bounded size, cut at blanks: no pre-token and no normal form spans one."""
    lo = 0
    while len(text) - lo > 4 * SLICE_CHARS:
        at = text.find(" ", lo + SLICE_CHARS)
        if at < 0:
            break
        yield text[lo:at]
        lo = at
    yield text[lo:] if lo else text


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: printable Latin-1 bytes are themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(plain))
    return table


_counters: dict[str, WholeTokenCounter] = {}


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    path_module: str | None = "public_tokenizers",
) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each input row.

    tokenizer names a file that each worker finds: by path_module's path(),
    or as a path where path_module is None.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "n_tokens", "over_limit"]
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = importlib.import_module(path_module).path(tokenizer) if path_module else tokenizer
        counter = _counters.get(path) or _counters.setdefault(path, WholeTokenCounter(path))
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            counts = counter.counts([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counts), pa.array(counts > limit)], names=names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
