"""Mixing sources to target weights with soft membership.

A naive Bayes classifier, counted on a bounded sample of the labelled documents, gives every document's posterior over the
domains (language and quality of the labelled rows). With token counts n and posteriors p, document rates r should make the
expected totals s_k = sum r n p_k equal to the targets T_k. Distributed projected gradient steps on the relative
residuals do that: every step sums the K totals over all documents, and moves each rate by
-sum_k p_k (s_k - T_k) / m_k, kept between ``min_rate`` and ``max_rate`` (m_k: the total at rate one). In the metric that divides by n, the
Hessian's rows sum to one, so that a step of one never overshoots. A rate depends on its document and the K residuals of
each step alone: rates are replayed from those few numbers instead of being stored, and nothing is lost with an executor.

Targets are shares by domain; left out, they are the expected shares to the power ``smoothing``. The total is the input's, or with
``grow`` the least at which no domain must shrink. Copies of a document: the whole part of its rate, and one more with the
rest's probability, by a hash of its id and text.

Defined results: a null or empty text has no tokens, the prior as posterior, and a rate like any other; a null ``doc_id`` stays null;
repeated rows are documents of their own; null labels are no labels; without labels all documents are one domain; an
empty table gives no rows; texts of any length are read whole; other columns are passed on or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import bounded_rows, has, in_arrow, plain_words, text_of, written

MAX_LABELLED = 8000
MAX_WORDS = 50_000
SMOOTHING = 0.7
STEPS = 40
TOLERANCE = 1e-3
SHARPNESS = 12.0  # as many words as a text's mean log likelihood counts for, so that posteriors stay soft
CACHE_WORDS = 200_000


@dataclass
class Domains:
    names: list[str]
    prior: np.ndarray
    known: dict[str, int]
    table: np.ndarray  # words x domains, log likelihoods; the last row is for unknown words

    def posterior(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts (words) and posteriors of each text."""
        get, other = self.known.get, len(self.table) - 1
        n, p = np.zeros(len(texts), np.int64), np.empty((len(texts), len(self.names)))
        for k, t in enumerate(texts):
            words = plain_words(t)
            n[k] = len(words)
            distinct = set(words)
            score = self.table[[get(w, other) for w in distinct]].mean(0) * min(SHARPNESS, len(distinct)) if distinct else 0.0
            p[k] = self.prior + score
        p = np.exp(p - p.max(1, keepdims=True)) if len(texts) else p
        return n, p / p.sum(1, keepdims=True)


def fit_domains(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_words: int = MAX_WORDS) -> Domains:
    """Domains are language/good and language/poor of labelled documents; at most ``max_labelled`` of them, the first by a hash of the id."""
    has(docs, "doc_id", "text", "lang")
    has(labels, "doc_id", "quality")
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = bounded_rows(one, max_labelled, F.xxhash64("doc_id"), "doc_id")
    domain = F.concat(F.coalesce("lang", F.lit("?")), F.when(F.col("quality") == 1, "/good").otherwise("/poor"))
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", text_of().alias("text"), "lang")
    sample = written(texts.join(F.broadcast(picked), "doc_id").select(domain.alias("domain"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))).alias("words")), "mixing-sample")
    sizes = sorted((r.domain, r.n) for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect())
    if not sizes:
        return Domains(["all"], np.zeros(1), {}, np.zeros((1, 1)))
    names = [d for d, _ in sizes]
    counts = sample.select("domain", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"), *[F.count_if(F.col("domain") == d).alias(f"d{k}") for k, d in enumerate(names)])
    rows = bounded_rows(counts, max_words, F.desc("n"), "w").toArrow()
    seen = np.column_stack([rows[f"d{k}"].to_numpy() for k in range(len(names))]).astype(float) if rows.num_rows else np.zeros((0, len(names)))
    n = np.array([c for _, c in sizes], float)
    table = np.log(np.concatenate([(seen + 0.1) / (n + 1), np.full((1, len(names)), 0.1 / (n + 1).mean())]))
    return Domains(names, np.log(n / n.sum()), {w: k for k, w in enumerate(rows["w"].to_pylist())}, table)


def posteriors(docs: DataFrame, domains: Domains) -> DataFrame:
    """doc_id, draw (a fixed uniform number of the row), n (tokens), p (posteriors)."""
    shared = docs.sparkSession.sparkContext.broadcast(domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            n, p = shared.value.posterior(texts)
            draw = [_draw(d, t) for d, t in zip(b.column(0).to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(draw, pa.float64()), pa.array(n), pa.array(p.tolist(), pa.list_(pa.float64()))], ["doc_id", "draw", "n", "p"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), run, "doc_id long, draw double, n long, p array<double>")


def _draw(doc_id, text: str) -> float:
    return xxhash.xxh64_intdigest(f"{doc_id}:{text}".encode("utf-8", "surrogatepass"), 11) / 2**64


def replay(p: np.ndarray, history: list[np.ndarray], bounds: tuple[float, float]) -> np.ndarray:
    """The rates of documents with posteriors p after these steps."""
    r = np.clip(np.ones(len(p)), *bounds)
    for g in history:
        r = np.clip(r - p @ g, *bounds)
    return r


def _totals(narrow: DataFrame, k: int, history: list[np.ndarray], bounds: tuple[float, float]) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for b in batches:
            p = b.column(1).flatten().to_numpy().reshape(-1, k)
            total += (replay(p, history, bounds) * b.column(0).to_numpy()) @ p
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], [f"s{i}" for i in range(k)])

    row = in_arrow(narrow.select("n", "p"), run, ", ".join(f"s{i} double" for i in range(k))).agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)) for i in range(k)]).first()
    return np.array(row)


@dataclass
class Mix:
    domains: Domains
    history: list[np.ndarray]
    bounds: tuple[float, float]
    target: dict[str, float]
    reached: dict[str, float]

    def rates(self, p: np.ndarray) -> np.ndarray:
        return replay(p, self.history, self.bounds)

    def missed(self, share: float = 0.05) -> dict[str, float]:
        """The domains whose totals are farther from their targets than this share of them, with the difference as a share."""
        off = {d: (self.reached[d] - t) / t for d, t in self.target.items() if t > 0}
        return {d: x for d, x in off.items() if abs(x) > share}


def fit_mix(narrow: DataFrame, domains: Domains, shares: dict[str, float] | None = None, smoothing: float = SMOOTHING, grow: bool = False, min_rate: float = 0.0, max_rate: float = float("inf"), steps: int = STEPS, tolerance: float = TOLERANCE) -> Mix:
    """``narrow``: the rows of ``posteriors``, best from a written table, as each step reads them."""
    k, bounds = len(domains.names), (min_rate, max_rate)
    mass = _totals(narrow, k, [], (1.0, 1.0))
    live = mass > 0
    want = np.array([shares.get(d, 0.0) for d in domains.names]) if shares else np.where(live, (mass / max(mass.sum(), 1e-300)) ** smoothing, 0.0)
    want = np.where(live, want, 0.0)
    target = want / max(want.sum(), 1e-300) * mass.sum()
    if grow and (target > 0).any():
        target *= (mass[target > 0] / target[target > 0]).max()
    history: list[np.ndarray] = []
    s = mass
    for _ in range(steps):
        g = np.where(live, (s - target) / np.where(live, mass, 1.0), 0.0)
        if np.abs(g).max(initial=0.0) < tolerance:
            break
        history.append(g)
        s, before = _totals(narrow, k, history, bounds), s
        if np.abs(s - before).max() <= tolerance**2 * mass.sum():
            break  # the bounds allow no more
    name = lambda v: dict(zip(domains.names, v.tolist(), strict=True))
    return Mix(domains, history, bounds, name(target), name(s))


def mixed_rates(docs: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None, **how) -> tuple[DataFrame, Mix]:
    """doc_id, n_tokens, domain (the likeliest), posterior (its), rate, copies of every document; and the fitted mix."""
    domains = fit_domains(docs, labels)
    narrow = written(posteriors(docs, domains), "posteriors")
    mix = fit_mix(narrow, domains, shares, **how)
    k = len(domains.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(3).flatten().to_numpy().reshape(-1, k)
            r, top = mix.rates(p), p.argmax(1)
            copies = np.floor(r + b.column(1).to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([domains.names[t] for t in top], pa.string()), pa.array(p[np.arange(len(p)), top]), pa.array(r), pa.array(copies)], ["doc_id", "n_tokens", "domain", "posterior", "rate", "copies"])

    return in_arrow(narrow, run, "doc_id long, n_tokens long, domain string, posterior double, rate double, copies long"), mix


def resampled(docs: DataFrame, mix: Mix) -> DataFrame:
    """The documents with all their columns, each as often as its copies say."""
    shared = docs.sparkSession.sparkContext.broadcast(mix)
    text, doc = docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            _, p = shared.value.domains.posterior(texts)
            draw = np.array([_draw(d, t) for d, t in zip(b.column(doc).to_pylist(), texts, strict=True)])
            copies = np.floor(shared.value.rates(p) + draw).astype(np.int64)
            for k in range(int(copies.max(initial=0))):  # one copy of each row at a time
                yield b.filter(pa.array(copies > k))

    return in_arrow(docs, run, docs.schema)
