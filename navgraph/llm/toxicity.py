"""Toxicity by weak supervision.

Voters: words and word beginnings (also: a beginning that several words of a text share) that stand surely oftener in
documents labelled toxic; a fixed list of insults; patterns of shouting and exclaiming; and the annotators' label, one
voter among them. A generative label model (expectation-maximisation) estimates every voter's firing rate in toxic and
clean documents, the annotators' hit and false alarm rates by what the other voters say, and the voters' correlations,
by which votes that say the same thing count less. Its posterior labels train a linear classifier over the lexicon
voters, and that classifier alone scores texts.

Fitting reads a sample of labelled rows of bounded size (``fit_rows``); scoring reads every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navgraph.llm.common import as_str, checkpointed, drawn, slices, text_bytes

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features, and numbers of words that must share one for a further feature.
STEMS, SHARED = (3, 4, 5, 6, 7, 8, 9), (2, 4)
#: Insults in common use, one voter together.
INSULTS = frozenset("idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown clowns imbecile".split())
MEMO_WORDS = 300_000
#: A mined voter stands surely more than twice as often in toxic rows: if it did not, its counts would be less likely
#: than exp(-SURPRISE) (Chernoff's bound of the binomial tail; the bound allows for the number of features tried).
TIMES, SURPRISE = 2.0, 9.0
#: Pseudo-counts (yes, no) of the annotators' hits and false alarms, before a row is seen.
HIT_PRIOR, WRONG_PRIOR = (9.0, 1.0), (1.0, 49.0)


def stems(word: str) -> list[str]:
    """A lower-case word and its beginnings (marked by a dash)."""
    return [word, *(word[:k] + "-" for k in STEMS if len(word) >= k)]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features(words: set[str]) -> list[str]:
    """The words, their beginnings, and beginnings that several of them share (``abc-2``, ``abc-4``)."""
    tally = Counter(f for w in words for f in stems(w))
    return [*tally, *(f"{f}{n}" for f, k in tally.items() for n in SHARED if k >= n)]


def pattern_votes(text: str, words: set[str]) -> list[str]:
    """Names of the fixed voters that fire."""
    out = []
    if words & INSULTS:
        out.append("*insults")
    letters = sum(map(str.isalpha, text))
    if letters >= 40 and sum(map(str.isupper, text)) > 0.5 * letters:
        out.append("*shouting")
    if text.count("!") > 0.05 * max(len(text), 1):
        out.append("*exclaiming")
    return out


FIXED_VOTERS = ("*insults", "*shouting", "*exclaiming")


@dataclass(frozen=True)
class LabelModel:
    fire_toxic: np.ndarray
    fire_clean: np.ndarray
    discount: np.ndarray
    annotator: tuple[float, float]
    prior: float


def _discounts(at: np.ndarray, cols: np.ndarray, q: np.ndarray, one: np.ndarray, zero: np.ndarray, block: int = 2_000) -> np.ndarray:
    """1 / (1 + a voter's correlations that the class does not explain), from blocks of rows."""
    m = len(one)
    both = np.zeros((m, m), np.float32)
    for low in range(0, len(q), block):
        here = slice(*np.searchsorted(at, [low, low + block]))
        share = q[low : low + block]
        rest = -(np.outer(share, one) + np.outer(1 - share, zero)).astype(np.float32)
        rest[at[here] - low, cols[here]] += 1
        both += rest.T @ rest
    spread = np.sqrt(np.diagonal(both)) + 1e-9
    both /= spread[:, None]
    both /= spread
    np.abs(both, out=both)
    np.fill_diagonal(both, 0)
    both[both < 0.1] = 0
    return 1 / (1 + both.sum(axis=0, dtype=np.float64))


def fit_label_model(rows: list[np.ndarray], n_voters: int, labels: np.ndarray, rounds: int = 25) -> tuple[LabelModel, np.ndarray]:
    """Each row's firing voters and the annotators' labels; the model and each row's posterior of being toxic."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = (np.concatenate(rows) if rows else np.zeros(0)).astype(np.int64)
    q = np.clip(labels.astype(float), 0.1, 0.9)
    by_votes, discount = q, np.ones(n_voters)
    for turn in range(rounds):
        prior = (q.sum() + 1) / (len(q) + 2)
        one = (np.bincount(cols, q[at], minlength=n_voters) + 0.05) / (q.sum() + 1)
        zero = (np.bincount(cols, (1 - q)[at], minlength=n_voters) + 0.05) / ((1 - q).sum() + 1)
        # The annotators are judged by what the voters alone say, else they would only be judged by themselves.
        hit = ((by_votes * labels).sum() + HIT_PRIOR[0]) / (by_votes.sum() + sum(HIT_PRIOR))
        wrong = (((1 - by_votes) * labels).sum() + WRONG_PRIOR[0]) / ((1 - by_votes).sum() + sum(WRONG_PRIOR))
        if turn in (0, 4, 9, 14):
            discount = _discounts(at, cols, q, one, zero)
        weight_on, weight_off = np.log(one / zero) * discount, np.log((1 - one) / (1 - zero)) * discount
        logit = np.log(prior / (1 - prior)) + weight_off.sum() + np.bincount(at, (weight_on - weight_off)[cols], minlength=len(rows))
        by_votes = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        logit = logit + np.where(labels > 0, np.log(hit / wrong), np.log((1 - hit) / (1 - wrong)))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        done = turn > 14 and np.abs(new - q).max(initial=0) < 1e-4
        q = new
        if done:
            break
    return LabelModel(one, zero, discount, (float(hit), float(wrong)), float(prior)), q


def fit_linear(rows: list[np.ndarray], n_features: int, target: np.ndarray, l2: float = 5e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels on feature presence; Adam over whole passes (rows: each row's feature numbers)."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    cols = cols.astype(np.int64)
    w, mean = np.zeros(n_features), np.clip(target.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(mean / (1 - mean)))
    m1, m2 = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for turn in range(1, rounds + 1):
        z = bias + np.bincount(at, w[cols], minlength=len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        slope = np.append(np.bincount(cols, error[at], minlength=n_features) / len(rows) + l2 * w, error.mean())
        m1 = 0.9 * m1 + 0.1 * slope
        m2 = 0.99 * m2 + 0.01 * slope**2
        step = 0.1 * (m1 / (1 - 0.9**turn)) / (np.sqrt(m2 / (1 - 0.99**turn)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


@dataclass(frozen=True)
class ToxicModel:
    """Weights by feature (a word, or a beginning with a dash and the number of words that share it, if several)."""

    weights: dict[str, float]
    bias: float
    #: Word or beginning -> (weight, then the weights for several words that share it).
    steps: dict[str, tuple[float, ...]] = field(init=False)

    def __post_init__(self) -> None:
        bases = {f.rstrip("24") for f in self.weights}
        object.__setattr__(self, "steps", {f: tuple(self.weights.get(f"{f}{n}", 0.0) for n in ("", *SHARED)) for f in bases})

    def score(self, text: str, memo: dict[str, tuple[str, ...]]) -> float:
        met: dict[str, int] = {}
        for word in words_of(text):
            known = memo.get(word)
            if known is None:
                known = memo[word] = tuple(f for f in stems(word) if f in self.steps)
            for f in known:
                met[f] = met.get(f, 0) + 1
        z = self.bias + math.fsum(w for f, k in met.items() for n, w in zip((1, *SHARED), self.steps[f], strict=True) if k >= n)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_rows_model(voters: list[str], present: list[list[str]], labels: np.ndarray, seed: int = 1) -> ToxicModel:
    """From each row's present voters (mined features and fixed ones) and label.

    The classifier also meets each row with about a third of its features, so that a text with few of them is not left
    to those that come in company.
    """
    number = {f: k for k, f in enumerate(voters)}
    rows = [np.array(sorted(number[f] for f in row), np.int64) for row in present]
    _, posterior = fit_label_model(rows, len(voters), labels)
    n = len(voters) - len(FIXED_VOTERS)  # the fixed voters stand last
    rows = [r[r < n] for r in rows]
    rng = np.random.default_rng(seed)
    thin = [r[rng.random(len(r)) < 0.3] if len(r) > 2 else r for r in rows]
    w, bias = fit_linear(rows + thin, n, np.concatenate([posterior, posterior]))
    return ToxicModel({f: float(x) for f, x in zip(voters, w, strict=False)}, bias)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """Fit on about ``fit_rows`` labels at most, chosen by a hash of ``id_col``; null labels are left out.

    The chosen labels are bounded by ``fit_rows``, so they are broadcast and no text is shuffled; the chosen texts are
    read once and kept in the shared folder while the model is fitted. With no toxic or no clean row the model is the
    constant share of toxic rows (0.5 with no row). Other columns of both tables are not read.
    """
    given = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
    chosen = given.where(drawn(F.col("__id"), fit_rows, given.count()))
    texts = docs.select(F.col(id_col).alias("__own"), text_bytes(text_col).alias("text"))
    source = checkpointed(texts.join(F.broadcast(chosen), F.col("__own") == F.col("__id")).select("text", F.col("__label").alias("label")))
    sizes = source.agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).first()
    n_toxic, n_all = int(sizes["toxic"] or 0), int(sizes["n"])
    if not 0 < n_toxic < n_all:
        share = (n_toxic + 0.5) / (n_all + 1)
        return ToxicModel({}, float(np.log(share / (1 - share))))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            names: list[str] = []
            tags: list[int] = []
            for raw, label in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                met = features(words_of(as_str(raw.as_py())))
                names += met
                tags += [label] * len(met)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(tags, pa.int32())], ["feature", "label"])

    counted = source.mapInArrow(each, "feature string, label int").groupBy("feature").agg(F.sum("label").alias("a"), (F.count("*") - F.sum("label")).alias("b"))
    base = TIMES * n_toxic / (TIMES * n_toxic + n_all - n_toxic)
    share = F.col("a") / (F.col("a") + F.col("b"))
    clean = F.when(F.col("b") == 0, 0.0).otherwise(F.col("b") * F.log((1 - share) / (1 - base)))
    mined = sorted(r["feature"] for r in counted.where((share > base) & (F.col("a") * F.log(share / base) + clean > SURPRISE)).select("feature").collect())
    wanted = frozenset(mined)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            rows_ = []
            for raw in part.column(0):
                text = as_str(raw.as_py())
                words = words_of(text)
                rows_.append(sorted(wanted.intersection(features(words))) + pattern_votes(text, words))
            yield pa.RecordBatch.from_arrays([pa.array(rows_, pa.list_(pa.string())), part.column(1)], ["present", "label"])

    votes = source.mapInArrow(vote, "present array<string>, label int").toArrow().sort_by([("label", "ascending")])
    order = sorted(range(votes.num_rows), key=lambda k: (votes["label"][k].as_py(), votes["present"][k].as_py()))  # rows in an order of their own
    present, told = votes["present"].to_pylist(), votes["label"].to_pylist()
    return fit_rows_model([*mined, *FIXED_VOTERS], [present[k] for k in order], np.array([told[k] for k in order]))


def score(docs: DataFrame, model: ToxicModel, id_cols: list[str], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id_cols`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on); null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[str, ...]] = {}
        for part in slices(batches):
            if len(memo) > MEMO_WORDS:
                memo.clear()
            scores = np.array([model.score(as_str(raw.as_py()), memo) for raw in part.column(part.num_columns - 1)], float)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*id_cols, "score", "predicted"])

    source = docs.select(*id_cols, text_bytes(text_col).alias("__navgraph_text"))
    shape = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in id_cols)
    return source.mapInArrow(run, f"{shape}score double, predicted int")
