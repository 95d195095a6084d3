"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared as lower-case words with one blank between. An item of n characters may stand in a
document with up to ``budget`` * n edits. It is split into that many pieces plus one: whatever the edits hit, one piece
is whole. An Aho-Corasick automaton finds all whole pieces in one pass over a text. A hit is verified from the piece
outwards, by doubling: of two halves of m and n pieces with fewer edits than m + n in all, one has fewer than m or the
other fewer than n, so the hit's half, then the half around it, must each hold with fewer edits than it has pieces, up
to the whole item. Myers' bit-parallel search does each check; most chance hits end at two pieces. Test items are a stated query set: they come to the tasks in blocks
of bounded size, one pass over the documents for each block, and documents never move.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navgraph.llm.common import as_str, slices, text_bytes

WORD = re.compile(r"[^\W_]+")
#: Characters of items in one block: bounds what is sent to a task.
BLOCK_CHARS = 4_000_000


def normal(text: str) -> str:
    return " ".join(WORD.findall(text.lower()))


def marks(text: str) -> str:
    """What items without any word are compared by: all their marks, one blank for white space."""
    return " ".join(text.lower().split())


def edits(length: int, budget: float) -> int:
    return int(length * budget)


def ancestry(parts: int) -> list[list[tuple[int, int]]]:
    """For each piece the stretches of pieces that halving the item leaves around it, from two pieces or more to all."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(parts)]

    def halve(a: int, b: int) -> None:
        if b - a > 1:
            middle = (a + b) // 2
            halve(a, middle)
            halve(middle, b)
            for p in range(a, b):
                out[p].append((a, b))

    halve(0, parts)
    return out


def pieces(item: str, parts: int) -> list[tuple[int, str]]:
    """(offset, piece): ``parts`` stretches of nearly equal length."""
    borders = [len(item) * k // parts for k in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(borders, borders[1:], strict=False)]


class Pattern:
    """Myers' bit vectors of one item; Python integers hold vectors of any length."""

    def __init__(self, item: str):
        self.size, self.at = len(item), {}
        for k, c in enumerate(item):
            self.at[c] = self.at.get(c, 0) | 1 << k

    def nearest(self, text: str) -> tuple[int, int]:
        """Smallest edit distance to any stretch of ``text``, and the first place where such a stretch ends."""
        full, high = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, score, best = full, 0, self.size, (self.size, 0)
        at = self.at.get
        for end, c in enumerate(text, 1):
            same = at(c, 0)
            x = (((same & up) + up) ^ up) | same
            plus, minus = down | (full & ~(x | up)), up & x
            if plus & high:
                score += 1
            elif minus & high:
                score -= 1
                if score < best[0]:
                    best = (score, end)
            plus, minus = (plus << 1) & full, (minus << 1) & full
            v = same | down
            up, down = minus | (full & ~(v | plus)), plus & v
        return best


class Matcher:
    """All items of a block (as ``normal`` or, without a word, ``marks`` has them); those under ``least_chars``
    characters match whole words without edits, those without a word match as they are."""

    def __init__(self, items: list[tuple[object, str]], budget: float, least_chars: int = 0):
        self.least_chars = least_chars
        self.items = [(no, text, edits(len(text), budget) if len(text) >= least_chars else 0) for no, text in items]
        self.wordless = [k for k, (_, text, _) in enumerate(self.items) if not WORD.search(text)]
        skipped = set(self.wordless)
        self.patterns: dict[tuple[int, int, int], Pattern] = {}
        self.borders: list[list[int]] = []
        self.around: dict[int, list[list[tuple[int, int]]]] = {}
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, most) in enumerate(self.items):
            cut = pieces(text, most + 1)
            self.borders.append([*(offset for offset, _ in cut), len(text)])
            if k in skipped:
                continue
            self.around.setdefault(most + 1, ancestry(most + 1))
            for p, (_, piece) in enumerate(cut):
                where.setdefault(piece, []).append((k, p))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in where.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def pattern(self, k: int, a: int, b: int) -> Pattern:
        """Pieces ``a`` to ``b`` of an item."""
        key = (k, a, b)
        if key not in self.patterns:
            self.patterns[key] = Pattern(self.items[k][1][self.borders[k][a] : self.borders[k][b]])
        return self.patterns[key]

    def holds(self, k: int, p: int, start: int, text: str) -> bool:
        """Whether every stretch of pieces around piece ``p``, but for the whole item, holds where the hit would have it."""
        borders = self.borders[k]
        for a, b in self.around[len(borders) - 1][p][:-1]:
            first, most = start + borders[a], b - a - 1
            if self.pattern(k, a, b).nearest(text[max(0, first - most) : max(0, first + borders[b] - borders[a] + most)])[0] > most:
                return False
        return True

    def found(self, raw: str) -> dict[int, tuple[int, int]]:
        """item number -> (edits, end in the text) of its nearest stretch within the item's budget."""
        out: dict[int, tuple[int, int]] = {}
        if self.wordless and (whole := marks(raw)):
            for k in self.wordless:
                if (at := whole.find(self.items[k][1])) >= 0:
                    out[k] = (0, at + len(self.items[k][1]))
        text = normal(raw)
        if self.empty or not text:
            return out
        seen: dict[int, tuple[int, int]] = {}
        for end, (size, owners) in self.automaton.iter(text):
            for k, p in owners:
                if out.get(k, (1,))[0] == 0:
                    continue
                _, item, most = self.items[k]
                if len(item) < self.least_chars:
                    if text[end - size : end - size + 1] in ("", " ") and text[end + 1 : end + 2] in ("", " "):
                        out[k] = (0, end + 1)
                    continue
                start = end - size + 1 - self.borders[k][p]
                low, high = max(0, start - most), min(len(text), start + len(item) + most)
                # Stretches on nearly the same diagonal share a search: it covers twice the budget to both sides. Hits
                # come in order, so the item's last search is the one to look at.
                if k in seen and seen[k][0] <= low and high <= seen[k][1] or not self.holds(k, p, start, text):
                    continue
                low, high = max(0, low - most), min(len(text), high + most)
                seen[k] = (low, high)
                distance, stop = self.pattern(k, 0, most + 1).nearest(text[low:high])
                if distance <= most and distance < out.get(k, (most + 1,))[0]:
                    out[k] = (distance, low + stop)
        return out


_matchers: dict[tuple, Matcher] = {}


def matcher(items: list[tuple[object, str]], budget: float, least_chars: int) -> Matcher:
    """A worker keeps the matcher of the block that it met last."""
    key = (hash(tuple(items)), budget, least_chars)
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(items, budget, least_chars)
    return _matchers[key]


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for row in items.select(id_col, text_col).toLocalIterator():
        text = normal(row[1] or "") or marks(row[1] or "")
        if not text:
            continue
        block.append((row[0], text))
        size += len(text)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, budget: float = 0.10, least_chars: int = 24, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item that it holds: ``doc_id, item_id, edits, item_chars, end_char``.

    ``edits`` is the smallest distance over the document, ``end_char`` where that stretch ends in the text of joined
    words. Items with fewer than ``least_chars`` characters of joined words are too short to tell an edited copy from
    chance: they match without edits, from word border to word border. Items of marks only match those marks in a row
    (white space counts as one blank); blank and null items match nothing. Null and empty texts hold no item; repeated
    rows give repeated rows; other columns, whatever their names, are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text"))
    item = items.schema[item_col].dataType
    shape = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, item_id {item.simpleString()}, edits int, item_chars int, end_char int"

    def scan_for(block: list[tuple[object, str]]):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = matcher(block, budget, least_chars)
            for part in slices(batches):
                rows = []
                for doc, raw in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    for k, (distance, end) in sorted(own.found(as_str(raw.as_py())).items()):
                        no, text, _ = own.items[k]
                        rows.append((doc, no, distance, len(text), end))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (part.schema.field(0).type, None, pa.int32(), pa.int32(), pa.int32())
                arrays = [pa.array(c, t) if t else pa.array(c) for c, t in zip(columns, kinds, strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "edits", "item_chars", "end_char"])

        return scan

    found = [source.mapInArrow(scan_for(block), shape) for block in item_blocks(items, item_col, item_text_col)]
    if not found:
        return source.sparkSession.createDataFrame([], shape)
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def without_leaks(docs: DataFrame, items: DataFrame, budget: float = 0.10, least_chars: int = 24, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold an item by the rules of ``leaks``; columns unchanged, whatever their names.

    Null and empty texts hold no item and stay, as does everything where there is no item; repeated rows stay or go
    together.
    """

    def clean_of(block: list[tuple[object, str]]):
        @F.arrow_udf("boolean")
        def clean(texts: pa.Array) -> pa.Array:
            own = matcher(block, budget, least_chars)
            return pa.array([not own.found(as_str(raw.as_py())) for raw in texts], pa.bool_())

        return clean

    for block in item_blocks(items, item_col, item_text_col):
        docs = docs.where(clean_of(block)(text_bytes(text_col)))
    return docs
