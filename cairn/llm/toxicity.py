"""Toxicity by classifier chains: linear models for the categories in a fixed order, each fed with the earlier ones' probabilities.

The last category decides; the ones before it are its finer kinds.

Fitting takes a bounded sample of the labelled rows: for each value of the last category at most ``max_per_class`` documents, the
first by a hash of their id, weighted back to the shares that the whole label table has. Features are a text's
words and their first 3 to 7 letters, at least once, twice and four times; of those words and beginnings that tell the categories apart
(z score of ``MIN_Z`` or more) at most ``max_features`` are kept. A later model is trained on
out-of-fold probabilities of the earlier ones, so that it sees them as wrong as they will be on new texts; for
scoring, each model is fitted once more on the whole sample. Every document is scored, over its whole text.

Defined results: a null or empty text has no features and gets the models' base probabilities; a null ``doc_id`` stays null; repeated rows
stay rows; texts of any length are read whole; a label row with a null that leaves its last category open is no label, and repeated labels count by their largest value; without labelled documents, or in a
category without positives, all probabilities are 0; other columns are passed on or ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_rows, has, in_arrow, plain_words, text_of, written

#: Categories in the chain's order, as conditions on the label table's columns. The last one decides.
CATEGORIES = {"toxic_junk": "toxic = 1 AND quality = 0", "toxic_prose": "toxic = 1 AND quality = 1", "toxic": "toxic = 1"}
MAX_PER_CLASS = 6000
MAX_FEATURES = 4000
MIN_Z = 5.0
TIMES = (1, 2, 4)  # occurrences at which a feature counts
FOLDS = 5
THRESHOLD = 0.5
PREFIXES = (3, 4, 5, 6, 7)
CACHE_WORDS = 200_000


def word_features(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in PREFIXES if len(word) > k)]


@dataclass
class Chain:
    """Feature numbers, and for each category its weights: features, then earlier probabilities, then the intercept."""

    names: list[str]
    known: dict[str, int]
    weights: list[np.ndarray]
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self):
        return (self.names, self.known, self.weights)

    def __setstate__(self, state):
        self.names, self.known, self.weights = state
        self.memo = {}

    def features(self, text: str) -> list[int]:
        """Numbers of the known features of a text, each once."""
        if len(self.memo) > CACHE_WORDS:
            self.memo.clear()
        found: dict[int, int] = {}
        memo, known = self.memo, self.known
        for w, n in Counter(plain_words(text)).items():
            ids = memo.get(w)
            if ids is None:
                ids = memo[w] = tuple(known[f] for f in word_features(w) if f in known)
            for i in ids:
                found[i] = found.get(i, 0) + n
        return sorted(len(TIMES) * i + k for i, n in found.items() for k, least in enumerate(TIMES) if n >= least)

    def score(self, rows: list[list[int]]) -> np.ndarray:
        """Probabilities, one row per text and one column per category."""
        x, out = _Rows(rows), np.zeros((len(rows), len(self.names)))
        for c, w in enumerate(self.weights):
            out[:, c] = _probability(x, out[:, :c], w) if len(w) else 0.0
        return out


class _Rows:
    """Sparse 0/1 rows."""

    def __init__(self, rows: list[list[int]]):
        self.n = len(rows)
        self.size = np.array([len(r) for r in rows], np.int64)
        self.flat = np.array([i for r in rows for i in r], np.int64)
        self.row = np.repeat(np.arange(self.n), self.size)

    def take(self, which: np.ndarray) -> "_Rows":
        out = object.__new__(_Rows)
        number = np.full(self.n, -1)
        number[which] = np.arange(len(which))
        keep = number[self.row] >= 0
        out.n, out.size, out.flat, out.row = len(which), self.size[which], self.flat[keep], number[self.row[keep]]
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.flat], self.n)

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.flat, r[self.row], width)


def _probability(x: _Rows, before: np.ndarray, w: np.ndarray) -> np.ndarray:
    c = before.shape[1]
    z = x.times(w[: len(w) - 1 - c]) + before @ w[len(w) - 1 - c : -1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: _Rows, before: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int, l2: float = 0.1, rounds: int = 150) -> np.ndarray:
    """Weighted logistic regression by accelerated gradient steps, each coordinate scaled by its curvature."""
    c = before.shape[1]
    curve = np.concatenate([x.back(weight, width), (before**2 * weight[:, None]).sum(0), [weight.sum()]]) / 4 + l2
    spread = max(1.0, float((x.size + c + 1).mean()) ** 0.5)
    w = np.zeros(width + c + 1)
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        r = weight * (_probability(x, before, ahead) - y)
        g = np.concatenate([x.back(r, width), before.T @ r, [r.sum()]]) + l2 * np.concatenate([ahead[:-1], [0.0]])
        new = ahead - g / curve / spread
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / nt * (new - w), new, nt
    return w


def train_chain(rows: list[list[int]], labels: np.ndarray, weight: np.ndarray, fold: np.ndarray, width: int) -> list[np.ndarray]:
    x, weights = _Rows(rows), []
    before = np.zeros((len(rows), 0))  # out-of-fold
    for c in range(labels.shape[1]):
        y = labels[:, c]
        if not y.any():
            weights.append(np.zeros(0))
            before = np.column_stack([before, np.zeros(len(rows))])
            continue
        held_out = np.zeros(len(rows))
        for k in range(FOLDS):
            out, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
            if len(out) and y[rest].any():
                held_out[out] = _probability(x.take(out), before[out], _fit(x.take(rest), before[rest], y[rest], weight[rest], width))
        weights.append(_fit(x, before, y, weight, width))
        before = np.column_stack([before, held_out])
    return weights


def _sampled(docs: DataFrame, labels: DataFrame, categories: dict[str, str], max_per_class: int) -> tuple[DataFrame, list[float]]:
    """The sample's texts with their categories, and each class's weight."""
    names = list(categories)
    last = f"y{len(names) - 1}"
    told = labels.where("doc_id IS NOT NULL").where(F.expr(categories[names[-1]]).isNotNull())
    flags = told.select("doc_id", *[F.coalesce(F.expr(e), F.lit(False)).cast("int").alias(f"y{i}") for i, e in enumerate(categories.values())])
    flags = flags.groupBy("doc_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))])
    sizes = {r[last]: r.n for r in flags.groupBy(last).agg(F.count("*").alias("n")).collect()}
    picked = reduce(DataFrame.unionByName, [bounded_rows(flags.where(F.col(last) == v), max_per_class, F.xxhash64("doc_id"), "doc_id") for v in (0, 1)])
    taken = {v: min(max_per_class, sizes.get(v, 0)) for v in (0, 1)}
    scale = sum(taken.values()) / max(1, sum(sizes.values()))
    weight = [sizes.get(v, 0) / max(1, taken[v]) * scale for v in (0, 1)]
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", text_of().alias("text"))
    # at most 2 * max_per_class rows of a few bytes: a bounded broadcast
    return written(texts.join(F.broadcast(picked), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")), "toxicity-sample"), weight


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, max_per_class: int = MAX_PER_CLASS, max_features: int = MAX_FEATURES) -> Chain:
    has(docs, "doc_id", "text")
    has(labels, "doc_id")
    categories = categories or CATEGORIES
    names, ys = list(categories), [f"y{i}" for i in range(len(categories))]
    sample, class_weight = _sampled(docs, labels, categories, max_per_class)
    total = sample.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(y), F.lit(0)).alias(y) for y in ys]).first()
    if not total.n or not total[ys[-1]]:
        return Chain(names, {}, [np.zeros(0)] * len(names))
    # counts of words in the sample, then of the features that words share
    words = sample.select(*ys, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0)))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys])
    shared = counts.select("n", *ys, F.explode(F.array(F.concat(F.lit("="), "word"), *[F.when(F.length("word") > k, F.substring("word", 1, k)) for k in PREFIXES])).alias("f")).where("f IS NOT NULL")
    shared = shared.groupBy("f").agg(F.sum("n").alias("n"), *[F.sum(y).alias(y) for y in ys]).where("n > 1")

    def z(y: str):
        pos, neg = float(total[y]), float(total.n - total[y])
        rate = (F.col("n") + 1) / (total.n + 2)
        return F.abs(F.col(y) / max(pos, 1.0) - (F.col("n") - F.col(y)) / max(neg, 1.0)) / F.sqrt(rate * (1 / max(pos, 1.0) + 1 / max(neg, 1.0)))

    best = shared.select("f", (F.greatest(*[z(y) for y in ys]) if len(ys) > 1 else z(ys[0])).alias("z"))
    known = {r.f: k for k, r in enumerate(bounded_rows(best.where(F.col("z") >= MIN_Z), max_features, F.desc("z"), "f").collect())}
    chain = Chain(names, known, [])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([chain.features(t) for t in b.column(0).to_pylist()], pa.list_(pa.int32())), *(b.column(k) for k in range(1, b.num_columns))], ["x", "doc_id", "fold", *ys])

    got = in_arrow(sample.select("text", "doc_id", "fold", *ys), encode, "x array<int>, doc_id long, fold int, " + ", ".join(f"{y} int" for y in ys)).toArrow().sort_by([("doc_id", "ascending")])
    labels_ = np.column_stack([got[y].to_numpy() for y in ys]).astype(float)
    chain.weights = train_chain(got["x"].to_pylist(), labels_, np.array(class_weight)[labels_[:, -1].astype(int)], got["fold"].to_numpy(), len(TIMES) * len(known))
    return chain


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_<category> for each category, toxic: whether the last category reaches the threshold."""
    cols = [f"p_{n}" for n in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = chain.score([chain.features(t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= threshold)], ["doc_id", *cols, "toxic"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), run, "doc_id long, " + ", ".join(f"{c} double" for c in cols) + ", toxic boolean")


def keep_rows(docs: DataFrame, keep: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """The documents, with all their columns, whose text ``keep`` says yes to."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(np.asarray(keep([t or "" for t in b.column(at).to_pylist()]), bool)))

    return in_arrow(docs, run, docs.schema)


def without_toxic(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    return keep_rows(docs, lambda texts: chain.score([chain.features(t) for t in texts])[:, -1] < threshold)
