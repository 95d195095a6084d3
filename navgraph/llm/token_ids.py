"""Token ids of whole texts, by the ``tokenizers`` library with a memo of words.

Both supported tokenizers split a text before every blank that has non-blank neighbours, so a text's ids are the ids
of its blank-separated parts in a row. Many texts are split at once with Arrow, which also tells their distinct parts;
each distinct part is looked up or encoded once, and the texts' ids are gathered from the parts' ids with numpy. Words
come back often; each worker remembers the ids of the parts and words it has met and asks the library for the rest
only. A word of plain letters goes straight to the library's model; every other part (marks, digits, apostrophes, other
scripts, special tokens) goes through its whole pipeline.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from navgraph.llm.common import as_str

#: Entries of one generation of a worker's memo (about 200 bytes each, Python's own included), and the longest part
#: that it keeps. Before a slice of texts a full memo becomes the old generation and the former old one is forgotten:
#: this bounds the memory of a worker, not the result.
MEMO_ENTRIES, MEMO_CHARS = 250_000, 48
#: Bytes of text that are split at once.
SLICE_BYTES = 6_000_000
#: Characters on which the library's splitting is known to be letters; with digits, other marks and line feed.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
WORD = re.compile(rf" ?[{LETTERS}]+")
PLAIN = re.compile(rf" ?[{LETTERS}0-9!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{{|}}~][{LETTERS}0-9!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{{|}}~\n]*")
PLAIN_RE2 = rf"\A(?:{PLAIN.pattern})\z"
#: Stands between the words of a plain part, which has no such character.
BORDER = "\x1f"


def byte_alphabet() -> list[str]:
    """The printable stand-in for each byte in byte-level BPE: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        table.setdefault(b, chr(0x100 + len(table) - len(shown)))
    return [table[b] for b in range(256)]


def gathered(values: np.ndarray, start: np.ndarray, count: np.ndarray, codes: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` (``count`` from ``start`` on, by code) of all ``codes`` in a row, and where ``borders``
    between codes come to lie in it."""
    n = count[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((start[codes] - (ends - n)).astype(kind), n)
    at += np.arange(total, dtype=kind)
    return values[at], np.append(np.zeros(1, np.int64), ends)[borders]


class Encoder:
    """``ids(text)`` equals ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``.

    Ids come as a numpy array of ``dtype`` (16 bits where the vocabulary allows it). ``keep_blank`` tells the
    tokenizers that keep a blank with the word after it from those that drop white space.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 0x10000 else "<u4")
        self.keep_blank = self.tokenizer.normalizer is None
        self.alphabet = byte_alphabet()
        blank = " ?" if self.keep_blank else ""
        digits = "[0-9]+" if self.keep_blank else "[0-9]"
        feed = "|\n+" if self.keep_blank else ""
        pretoken = rf"{blank}[{LETTERS}]+|{blank}{digits}|{blank}[^\s{LETTERS}0-9]+{feed}"
        self.pretoken = re.compile(pretoken)
        self.cut_re2 = f"({pretoken})" if self.keep_blank else rf"({pretoken.replace(chr(92) + 's', chr(92) + 's' + BORDER)})"
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return array(self.dtype.char, ids).tobytes()

    def word(self, word: str) -> bytes:
        """A word of letters, digits or marks that the library's splitting keeps together."""
        known = self.memo.get(word)
        if known is None:
            known = self.old.get(word)
            if known is None:
                if word.isascii():
                    shown = self.alphabet[32] + word[1:] if word[0] == " " else self.alphabet[10] * len(word) if word[0] == "\n" else word
                else:
                    shown = "".join([self.alphabet[b] for b in word.encode()])
                known = self.packed([t.id for t in self.model.tokenize(shown)])
            if len(word) <= MEMO_CHARS:
                self.memo[word] = known
        return known

    def part(self, part: str) -> bytes:
        """A text without blanks but for one in front."""
        known = self.memo.get(part)
        if known is not None:
            return known
        if not part:
            return b""
        if (known := self.old.get(part)) is None:
            shown = part if self.keep_blank else part.lower()
            if (shown.isascii() and (shown if shown[0] != " " else shown[1:]).isalpha()) or WORD.fullmatch(part):
                known = self.word(shown)
            elif PLAIN.fullmatch(part) and "<|" not in part and "\n\n" not in part:
                known = b"".join(map(self.word, self.pretoken.findall(shown)))
            else:
                known = self.packed(self.tokenizer.encode(part, add_special_tokens=False).ids)
        if len(part) <= MEMO_CHARS:
            self.memo[part] = known
        return known

    def batch(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, ``end_id`` after each text, and the borders between texts (one more than texts)."""
        if len(self.memo) > MEMO_ENTRIES:
            self.old, self.memo = self.memo, {}
        try:
            strings = texts.cast(pa.string())
        except pa.ArrowInvalid:  # not UTF-8
            strings = pa.array([as_str(x.as_py()) for x in texts], pa.string())
        lists = pc.split_pattern(strings, " ")
        first = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        distinct, codes = coded.dictionary, coded.indices.to_numpy()
        if self.keep_blank:
            distinct = pc.binary_join_element_wise(pa.scalar(" "), distinct, pa.scalar(""))
        del strings, lists, coded
        # Plain parts are cut into words in Arrow; each distinct word and each other part is encoded once.
        plain = pc.match_substring_regex(distinct, PLAIN_RE2)
        for odd in ("<|", "\n\n"):
            plain = pc.and_not(plain, pc.match_substring(distinct, odd))
        plain = plain.to_numpy(zero_copy_only=False)
        cut = distinct.filter(pa.array(plain))
        if not self.keep_blank:
            cut = pc.replace_substring(pc.utf8_lower(cut), "\n", BORDER)
        cut = pc.split_pattern(pc.replace_substring_regex(cut, self.cut_re2, rf"\1{BORDER}"), BORDER)
        pieces = cut.flatten()
        full = pc.binary_length(pieces).to_numpy() > 0
        upto = np.append(0, np.cumsum(full))[cut.offsets.to_numpy()]
        pieces = pieces.filter(pa.array(full)).dictionary_encode()
        words = pieces.dictionary.to_pylist()
        table = list(map(self.memo.get, words))
        for k, ids in enumerate(table):
            if ids is None:
                table[k] = self.word(words[k])
        others = np.flatnonzero(~plain)
        other = distinct.take(pa.array(others)).to_pylist()
        # Each part's run of table entries.
        run = [pieces.indices.to_numpy(), np.arange(len(table), len(table) + len(other))]
        start, count = np.zeros(len(plain), np.int64), np.ones(len(plain), np.int64)
        start[plain], count[plain] = upto[:-1], np.diff(upto)
        start[others] = len(run[0]) + np.arange(len(other))
        table += map(self.part, other)
        if self.keep_blank:
            # A part that is empty or has white space at its end next to a blank belongs together with its neighbour.
            opens, shuts = np.zeros(len(plain), bool), pc.ends_with(distinct, "\n").to_numpy(zero_copy_only=False).copy()
            opens[others] = [len(w) == 1 or w[1].isspace() for w in other]
            shuts[others] = [w[-1].isspace() for w in other]
            new = np.ones(len(codes), bool)
            new[1:] = ~(shuts[codes[:-1]] | opens[codes[1:]])
            new[first[:-1]] = True
            begin = np.flatnonzero(new)
            stop = np.append(begin[1:], len(codes))
            head = np.zeros(len(codes), bool)
            head[first[:-1]] = True
            grouped, extra = codes[begin].astype(np.int64), []
            for k in np.flatnonzero(head[begin] | (stop - begin > 1)).tolist():
                a, b = int(begin[k]), int(stop[k])
                whole = "".join([distinct[c].as_py() for c in codes[a:b].tolist()])
                grouped[k] = len(start) + len(extra)
                extra.append(self.part(whole[1:] if head[a] else whole))
            run.append(np.arange(len(table), len(table) + len(extra)))
            start = np.append(start, len(run[0]) + len(run[1]) + np.arange(len(extra)))
            count = np.append(count, np.ones(len(extra), np.int64))
            table += extra
            first = np.append(np.searchsorted(begin, first[:-1]), len(begin))
            codes = grouped
        entries, borders = gathered(np.concatenate(run), start, count, codes, first)
        size = np.fromiter(map(len, table), np.int64, len(table)) // self.dtype.itemsize
        ids, borders = gathered(np.frombuffer(b"".join(table), self.dtype), np.cumsum(size) - size, size, entries, borders)
        if end_id is not None:
            ids = np.insert(ids, borders[1:], self.dtype.type(end_id))
            borders = borders + np.arange(len(borders))
        return ids, borders

    def ids(self, text: str) -> np.ndarray:
        return self.batch(pa.array([text], pa.string()))[0]


def text_slices(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of about ``SLICE_BYTES`` bytes of text, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy().astype(np.int64))
        at, done = 0, 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
            yield batch.slice(at, stop - at)
            at, done = stop, int(ends[stop - 1])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file; it stays for the worker's later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
