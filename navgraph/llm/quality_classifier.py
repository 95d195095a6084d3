"""Quality classifier from weak labels.

Heuristic labellers look at a text's figures and vote good, bad or nothing. How often each combination of votes occurs
in the corpus is counted over all documents (at most 3 ** labellers combinations); expectation-maximisation on those
counts estimates each labeller's accuracy and every combination's posterior. Posterior labels train a linear scorer
over hashed word shapes, frequent function words and neighbour repeats, which alone scores texts.

Counts cover all documents; the scorer's training rows are a sample of bounded size (``fit_rows``).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navgraph.llm.common import drawn, slices, text_bytes

DIMENSIONS = 1 << 14
MEMO_WORDS = 300_000
#: Function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    w.encode()
    for w in (
        "the of and to in a is that it was for on are with as be at by this have from or an not "
        "de la le et les des en un une du que est pour qui dans par sur pas au ce il se avec "
        "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es an "
        "el que los del las por con para una su al lo como"
    ).split()
)
SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _LOWER[97:123] = True


def figures(raw: bytes) -> tuple[float, ...]:
    """words, symbols a word, share of capitals, neighbour repeats, distinct words, function words, marks a word, ended lines, repeated lines."""
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) + (0.0,) * 8
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(by_byte[_UPPER].sum()), int(by_byte[_LOWER].sum())
    symbols = sum(int(by_byte[b]) for b in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ended = sum(x.rstrip()[-1:] in b".!?\"" for x in lines)
    return (
        n, symbols / n, upper / max(upper + lower, 1), sum(map(eq, words, words[1:])) / n, len(set(words)) / n,
        sum(map(FUNCTION_WORDS.__contains__, raw.lower().split())) / n, int(by_byte[33]) / n, ended / len(lines), 1 - len(set(lines)) / len(lines),
    )


def votes(raw: bytes) -> str:
    """One letter for each labeller: g(ood), b(ad) or - (no vote)."""
    n, symbols, upper, repeats, distinct, function, marks, ended, again = figures(raw)
    if n == 0:
        return "bbbbbbbbb"

    def vote(value: float, bad: bool, good: bool) -> str:
        return "b" if bad else "g" if good else "-"

    return "".join((
        vote(n, False, n >= 20),
        vote(symbols, symbols > 0.2, symbols < 0.05),
        vote(upper, upper > 0.5, upper < 0.2),
        vote(repeats, repeats > 0.1, repeats < 0.03),
        vote(distinct, distinct < 0.15, n < 2_000 and distinct > 0.4),
        vote(function, n >= 20 and function < 0.02, function > 0.08),
        vote(marks, marks > 0.3, marks < 0.05),
        vote(ended, ended < 0.2, ended > 0.7),
        vote(again, again > 0.3, again < 0.1),
    ))


@dataclass(frozen=True)
class LabelModel:
    """Share of good rows, and each labeller's chances of its votes in good and bad rows; no vote says nothing."""

    prior: float
    good: np.ndarray
    bad: np.ndarray

    def posterior(self, code: np.ndarray) -> np.ndarray:
        """``code`` (rows x labellers): 0 bad, 1 none, 2 good."""
        at = np.arange(code.shape[1])
        z = np.log(self.prior / (1 - self.prior)) + ((np.log(self.good[at, code]) - np.log(self.bad[at, code])) * (code != 1)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def codes(patterns: list[str]) -> np.ndarray:
    return np.array([["b-g".index(c) for c in p] for p in patterns], np.int64).reshape(len(patterns), -1)


def fit_label_model(patterns: list[str], weight: np.ndarray, rounds: int = 60) -> LabelModel:
    """EM over distinct vote combinations and their counts. It starts from the balance of votes, which names the classes."""
    code = codes(patterns)
    weight = np.asarray(weight, float)
    # A bad vote is rare and meant; good votes are easily given: two bad votes outweigh all good ones at the start.
    bad_votes, good_votes = (code == 0).sum(axis=1), (code == 2).sum(axis=1)
    q = np.where(bad_votes >= 2, 0.1, np.where(bad_votes == 1, 0.4, np.where(good_votes >= 3, 0.95, 0.6)))
    model = None
    for _ in range(rounds):
        tables = []
        for share in (q, 1 - q):
            w = weight * share
            bad, good = (np.array([w[code[:, j] == v].sum() + 0.5 for j in range(code.shape[1])]) for v in (0, 2))
            tables.append(np.stack([bad, np.ones_like(bad), good], axis=1) / np.stack([bad + good, np.ones_like(bad), bad + good], axis=1))
        prior = float(np.clip((weight * q).sum() / max(weight.sum(), 1e-9), 0.01, 0.99))
        model = LabelModel(prior, *tables)
        new = model.posterior(code)
        if np.abs(new - q).max(initial=0) < 1e-5:
            break
        q = new
    return model


def shape(word: bytes) -> bytes:
    """Runs of capitals, small letters (bytes over 127 too), digits and each other mark: ``A``, ``a``, ``9``, the mark."""
    out = bytearray()
    for c in word:
        kind = 65 if 65 <= c <= 90 else 97 if c >= 128 or 97 <= c <= 122 else 57 if 48 <= c <= 57 else c
        if not out or out[-1] != kind:
            out.append(kind)
    return bytes(out[:12])


def hashed(kind: bytes, value: bytes) -> int:
    return zlib.crc32(kind + value) % DIMENSIONS


def features(raw: bytes, memo: dict[bytes, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers and values: damped shares of shapes and function words, repeats, and the length's class."""
    tally: Counter[int] = Counter()
    words = raw.split()
    for word, n in Counter(words).items():
        known = memo.get(word)
        if known is None:
            low = word.lower()
            known = (hashed(b"s", shape(word)), *([hashed(b"w", low), hashed(b"f", b"")] if low in FUNCTION_WORDS else []))
            memo[word] = known
        for f in known:
            tally[f] += n
    n = max(len(words), 1)
    tally[hashed(b"r", b"")] += sum(map(eq, words, words[1:]))
    at, value = np.array(list(tally), np.int32), np.sqrt(np.array(list(tally.values()), np.float32) / n)
    lines = raw.split(b"\n")
    extra = [(hashed(b"n", str(min(len(words), 1 << 20).bit_length()).encode()), 1.0), (hashed(b"l", b""), 1 - len(set(lines)) / len(lines))]
    return np.append(at, [x for x, _ in extra]).astype(np.int32), np.append(value, [v for _, v in extra]).astype(np.float32)


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, l2: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels; Adam over whole passes."""
    w, bias = np.zeros(DIMENSIONS), 0.0
    if not rows:
        return w, bias
    at = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    cols, values = (np.concatenate(x) for x in zip(*rows, strict=True))
    m1, m2 = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for turn in range(1, rounds + 1):
        z = bias + np.bincount(at, w[cols] * values, minlength=len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        slope = np.append(np.bincount(cols, error[at] * values, minlength=DIMENSIONS) / len(rows) + l2 * w, error.mean())
        m1 = 0.9 * m1 + 0.1 * slope
        m2 = 0.99 * m2 + 0.01 * slope**2
        step = 0.1 * (m1 / (1 - 0.9**turn)) / (np.sqrt(m2 / (1 - 0.99**turn)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel | None
    weights: np.ndarray
    bias: float

    def score(self, raw: bytes, memo: dict) -> float:
        at, value = features(raw, memo)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[at] @ value, -30, 30))))


def fit(docs: DataFrame, fit_rows: int = 6_000, text_col: str = "text", order_col: str = "doc_id") -> QualityModel:
    """Fit without any given label. An empty table gives a scorer of 0.5 for every text."""
    source = docs.select(F.col(order_col).alias("order"), text_bytes(text_col).alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([votes(x.as_py()) for x in part.column(0)])], ["votes"])

    told = source.select("text").mapInArrow(vote, "votes string").groupBy("votes").agg(F.count("*").alias("n")).collect()
    if not told:
        return QualityModel(None, np.zeros(DIMENSIONS), 0.0)
    n = sum(r["n"] for r in told)
    told.sort(key=lambda r: r["votes"])
    labels = fit_label_model([r["votes"] for r in told], np.array([r["n"] for r in told]))
    chosen = source.where(drawn(F.col("order"), fit_rows, n))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, tuple[int, ...]] = {}
        for part in slices(batches):
            rows = [(votes(raw), *(x.tobytes() for x in features(raw, memo))) for raw in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["votes", "at", "value"])

    sample = chosen.select("text").mapInArrow(take, "votes string, at binary, value binary").toArrow()
    rows = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for a, v in zip(sample["at"].to_pylist(), sample["value"].to_pylist(), strict=True)]
    target = labels.posterior(codes(sample["votes"].to_pylist())) if rows else np.zeros(0)
    return QualityModel(labels, *fit_linear(rows, target))


def score(docs: DataFrame, model: QualityModel, id_cols: list[str], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id_cols`` with ``score`` (0 to 1, higher is better) and ``predicted`` (1 from the threshold on).

    Null and empty texts count as empty; every row gets a score; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, tuple[int, ...]] = {}
        for part in slices(batches):
            if len(memo) > MEMO_WORDS:
                memo.clear()
            scores = np.array([model.score(raw.as_py(), memo) for raw in part.column(part.num_columns - 1)], float)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*id_cols, "score", "predicted"])

    source = docs.select(*id_cols, text_bytes(text_col).alias("__navgraph_text"))
    kinds = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in id_cols)
    return source.mapInArrow(run, f"{kinds}score double, predicted int")
