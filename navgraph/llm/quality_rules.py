"""Quality rules by repetition coverage.

Words are mapped to 64-bit values; rolling hashes over them, for several n-gram lengths at once in numpy, tell which
windows of a document stand in it twice or more. Coverage is the share of a document's word characters inside
duplicated windows of a length (each character once, however many windows cover it), and the share inside lines that
repeat an earlier line. A document fails where a coverage passes the limit for its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navgraph.llm.common import slices, text_bytes

#: Byte classes. Blanks are [\x20\x09-\x0D]; symbols are the characters of [#*$%&|<>].
BLANK_BYTES = b" \t\n\x0b\x0c\r"
SYMBOL_BYTES = b"#*$%&|<>"
BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class RepetitionLimits:
    """Largest allowed shares. ``ngrams``: by n-gram length, characters inside duplicated n-grams (published limits
    of web-corpus filters for lengths 5 to 10). ``lines``: characters inside repeated lines."""

    ngrams: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    lines: float = 0.20
    symbols_per_word: float = 0.3
    base_words: int = 10
    base_window: int = 5
    base_percent: int = 20


def in_repeated_windows(values: np.ndarray, n: int) -> np.ndarray:
    """Which words stand inside an n-word window that the document holds twice or more (the first one included)."""
    if len(values) < n:
        return np.zeros(len(values), bool)
    with np.errstate(over="ignore"):
        h = np.zeros(len(values) - n + 1, np.uint64)
        for k in range(n):
            h = h * BASE + values[k : k + len(h)]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(values) + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def word_values(words: list[bytes]) -> np.ndarray:
    """Equal values for equal words of the document: numbers in order of appearance, mixed to 64 bits."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        ids = (ids + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        ids ^= ids >> np.uint64(31)
        return ids * np.uint64(0x94D049BB133111EB)


def chars(raw: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(raw) - int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80)) if raw else 0


def measure(raw: bytes, limits: RepetitionLimits) -> tuple:
    """All columns of one text."""
    words = raw.split()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n_words = len(words)
    word_chars = int(counts.sum() - counts[0x80:0xC0].sum()) - sum(int(counts[b]) for b in BLANK_BYTES)
    n_symbols = sum(int(counts[b]) for b in SYMBOL_BYTES)

    seen: set[bytes] = set()
    n_dup_lines = dup_line_chars = 0
    for line in raw.split(b"\n"):
        if line in seen:
            n_dup_lines += 1
            dup_line_chars += chars(b"".join(line.split()))
        elif not line.isspace() and line:
            seen.add(line)

    values = word_values(words)
    lengths = None
    n_repeat_words, covered = 0, {}
    repeated = True  # a window repeats only if the shorter windows in it do: after a length without repeats there are none
    for n in sorted({limits.base_window, *limits.ngrams}):
        inside = in_repeated_windows(values, n) if repeated else np.zeros(n_words, bool)
        repeated = bool(inside.any())
        if n == limits.base_window:
            n_repeat_words = int(inside.sum())
        if n in limits.ngrams:
            if repeated:
                if lengths is None:
                    lengths = np.fromiter((chars(w) if not w.isascii() else len(w) for w in words), np.int64, n_words)
                covered[n] = int(lengths[inside].sum())
            else:
                covered[n] = 0
    whole = max(word_chars, 1)
    base_failed = n_words < limits.base_words or 100 * n_repeat_words > limits.base_percent * n_words
    over = any(covered[n] > share * whole for n, share in limits.ngrams.items())
    passed = not over and dup_line_chars <= limits.lines * whole and n_symbols <= limits.symbols_per_word * max(n_words, 1)
    most = max(covered.values(), default=0) / whole
    return n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, passed and not base_failed, most, dup_line_chars / whole


SHAPE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ngram_cover double, line_cover double"


def judge(docs: DataFrame, limits: RepetitionLimits | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and the columns of ``SHAPE``.

    A null or empty text has no words, hence fails the base rules. Other columns of ``docs`` are not read.
    """
    rules = limits or RepetitionLimits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64(), pa.float64())
        names = [c.strip().split(" ")[0] for c in SHAPE.split(",")]
        for part in slices(batches, 1024):
            rows = zip(*(measure(raw.as_py(), rules) for raw in part.column(1)), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(rows, kinds, strict=True))], [id_col, *names])

    source = docs.select(id_col, text_bytes(text_col).alias("text"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, {SHAPE}")


def keep_good(docs: DataFrame, limits: RepetitionLimits | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the rules reject; columns unchanged, whatever their names. The verdict is made
    beside the text, one text at a time, so rows need no join (repeated ids do not matter). Null, empty and blank texts
    have no words and go; an empty table stays empty."""
    rules = limits or RepetitionLimits()

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        return pa.array([measure(raw.as_py(), rules)[6] for raw in texts], pa.bool_())

    return docs.where(good(text_bytes(text_col)))
