"""Language identification by nearest centroids.

A text is a vector of hashed character n-grams (lengths 1 to 3 over letters, all else a blank), damped, weighted by
inverse document frequency and normalised. Each language has several centroids, found by spherical k-means, so that
its registers need not share one mean. A text takes the language of the centroid nearest by cosine; a text farther
from it than nearly all of that language's learning texts is rejected.

Fitting reads a sample of bounded size (``fit_rows``), taken evenly over the languages; prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navgraph.llm.common import as_str, drawn, slices, text_bytes

DIMENSIONS = 4096
#: Code points up to here are told letters from others by a table; those above count as letters if Python says so.
TABLE = 0x3000
SHARPNESS = 0.05
MARKS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(TABLE)])


_LETTER = letter_table()


def letters(text: str) -> tuple[np.ndarray, bool]:
    """Code points in lower case with one blank (0) for each run of other characters; and whether there is a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    low = points < TABLE
    letter = np.zeros(len(points), bool)
    letter[low] = _LETTER[points[low]]
    for at in np.flatnonzero(~low):
        letter[at] = chr(points[at]).isalpha()
    kept = np.where(letter, points, 0).astype(np.uint32)
    kept = np.concatenate([np.zeros(1, np.uint32), kept, np.zeros(1, np.uint32)])
    return kept[(kept != 0) | np.append(True, kept[:-1] != 0)], bool(letter.any())


def counts(points: np.ndarray) -> np.ndarray:
    """How often each hashed n-gram stands in the text."""
    total = np.zeros(DIMENSIONS, np.int64)
    shift = np.uint32(32 - (DIMENSIONS.bit_length() - 1))
    with np.errstate(over="ignore"):
        h = np.zeros(len(points), np.uint32)
        for n, mark in enumerate(MARKS):
            h = (h[: len(points) - n] ^ points[n:]) * np.uint32(mark)
            h ^= h >> np.uint32(15)
            total += np.bincount((h * np.uint32(0x27D4EB2F)) >> shift, minlength=DIMENSIONS)
            h = h[: max(len(points) - n - 1, 0)]
    return total


@dataclass(frozen=True)
class Languages:
    names: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    #: Row of ``names`` for each centroid, and the least cosine that counts as that language.
    owner: np.ndarray
    least: np.ndarray

    def vectors(self, raw: np.ndarray) -> np.ndarray:
        x = np.log1p(raw.astype(np.float32)) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def cosines(self, x: np.ndarray) -> np.ndarray:
        """Best cosine for each language."""
        near = x @ self.centroids.T
        return np.stack([near[:, self.owner == k].max(axis=1) for k in range(len(self.names))], axis=1)


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out seeds: the first vector's farthest, then each time the worst covered one."""
    seeds = [int(np.argmin(x @ x.mean(axis=0)))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(axis=1))))
    c = x[seeds]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        new = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
        if np.allclose(new, c, atol=1e-5):
            break
        c = new
    return c


def fit_counts(raw: np.ndarray, langs: list[str], per_language: int = 4, reject_share: float = 0.005) -> Languages:
    names = sorted(set(langs))
    idf = (np.log((1 + len(raw)) / (1 + (raw > 0).sum(axis=0))) + 1).astype(np.float32)
    model = Languages(names, idf, np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(0))
    if not names:
        return model
    x, label = model.vectors(raw), np.array([names.index(v) for v in langs])
    found = [clusters(x[label == k], per_language) for k in range(len(names))]
    owner = np.repeat(np.arange(len(names)), [len(c) for c in found])
    model = Languages(names, idf, np.concatenate(found).astype(np.float32), owner, np.zeros(len(names)))
    near = model.cosines(x)
    least = np.array([np.quantile(near[label == k, k], reject_share) for k in range(len(names))])
    return Languages(names, idf, model.centroids, owner, least)


def fit(labelled: DataFrame, fit_rows: int = 4_000, per_language: int = 4, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id") -> Languages:
    """Fit on about ``fit_rows`` rows at most, an equal number from each language, chosen by a hash of ``order_col``.

    Rows with a null language or a text without a letter teach nothing; with no row left the model knows no language.
    """
    rows = labelled.where(F.col(lang_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit_counts(np.zeros((0, DIMENSIONS)), [])
    each = max(1, fit_rows // len(sizes))
    chosen = rows.where(reduce(or_, ((F.col(lang_col) == lang) & drawn(F.col(order_col), each, n) for lang, n in sorted(sizes.items()))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for raw, lang in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                points, any_letter = letters(as_str(raw.as_py()))
                if any_letter:
                    n = counts(points)
                    at = np.flatnonzero(n)
                    out.append((lang, at.astype("<u2").tobytes(), n[at].astype("<u4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["lang", "at", "counts"])

    told = chosen.select(text_bytes(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(count, "lang string, at binary, counts binary").toArrow()
    raw = np.zeros((told.num_rows, DIMENSIONS), np.uint32)
    for k, (at, n) in enumerate(zip(told["at"].to_pylist(), told["counts"].to_pylist(), strict=True)):
        raw[k, np.frombuffer(at, "<u2")] = np.frombuffer(n, "<u4")
    return fit_counts(raw, told["lang"].to_pylist(), per_language)


def predict(docs: DataFrame, model: Languages, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` with ``lang_pred`` (nearest language; ``und`` for null texts and texts without a letter, or where no
    language is known), ``score`` (0 to 1), ``cosine`` and ``rejected`` (too far from what was learnt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raw, sure = np.zeros((part.num_rows, DIMENSIONS), np.int64), np.zeros(part.num_rows, bool)
            for k, text in enumerate(part.column(part.num_columns - 1)):
                points, sure[k] = letters(as_str(text.as_py()))
                if sure[k]:
                    raw[k] = counts(points)
            names, score, near, reject = ["und"] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows), ~sure
            if model.names:
                cosine = model.cosines(model.vectors(raw))
                best = cosine.argmax(axis=1)
                power = np.exp((cosine - cosine.max(axis=1, keepdims=True)) / SHARPNESS)
                names = [model.names[b] if ok else "und" for b, ok in zip(best, sure, strict=True)]
                near = np.where(sure, cosine.max(axis=1), 0.0)
                score = np.where(sure, 1 / power.sum(axis=1), 0.0)
                reject = ~sure | (near < model.least[best])
            columns = [pa.array(names), pa.array(np.clip(score, 0, 1).astype(float)), pa.array(near.astype(float)), pa.array(reject)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*id_cols, "lang_pred", "score", "cosine", "rejected"])

    source = docs.select(*id_cols, text_bytes(text_col).alias("__navgraph_text"))
    shape = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in id_cols)
    return source.mapInArrow(run, f"{shape}lang_pred string, score double, cosine double, rejected boolean")
