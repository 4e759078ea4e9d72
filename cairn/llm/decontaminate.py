"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all documents give the weights (idf).
2. The benchmark is dealt into blocks of about ``ROWS`` TF-IDF rows: each item, and the passages of items of over ``LONG`` words. A
   randomised SVD of each block (a product with a random sign matrix, orthonormalised, refined by power steps) finds its leading right
   singular vectors, half as many as it has rows: words that stand together in items fall together. A row of which they keep less than
   ``KEEP`` adds the direction of what is left, so that no item is lost, however unlike the others it is.
3. Every document is cut into overlapping passages of 32 words. A passage's latent vector is a sum of word vectors, so blocks of
   16 words are added once and pairs of neighbours make the passages. A passage's length along an item's latent direction, over the
   passage's whole length, is compared with what an exact copy has, as the space keeps less of some items than of others. A passage with too small a part in the latent
   space is dropped before it is compared with any item. A passage that holds most of an item's own weight is
   compared too, as common words between rare ones have a small cosine.
4. Candidates are checked in the text: the longest common subsequence of the item's words and the words around the passage. Most of the
   item in order is a leak; a paraphrase with less needs the item's answer (its last words) as well.

The rank is spent on the benchmark's own passages, as the corpus' leading directions are its commonest words, which tell no
item from another; the corpus decides the weights. Blocks are made by tasks and kept in a table. The driver loads ``GROUP`` of them at a time
and broadcasts them; a task reads its texts' words once for a group. Further groups are passes of their own, put together by the texts' digests.

Texts and items of any length are read whole.
Defined results: a null or empty text is clean; an item without words is never found; repeated items are reported by each id; null ids
are reported as nulls; a null ``doc_id`` stays null; repeated rows stay rows; an empty benchmark leaves all clean; other columns are
passed on or ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import has, in_arrow, text_of, written
from .toxicity import keep_rows

BUCKETS = 1 << 18
ROWS = 256  # of a block, about
RANK = 0.5  # directions for each of its rows
KEEP = 0.25  # of a row's squared length, at least, lies in the latent space
OVERSAMPLE = 16
POWER_STEPS = 2
GROUP = 16  # blocks of items that a task holds
BLOCK = 16  # words; a passage is two blocks
LONG = 4 * BLOCK  # words; longer items are looked for by their passages too
COSINE = 0.3
HELD = 0.75  # of an item's weight inside a passage: found among any words, however rare those are
LEAK = 0.75  # of the item's words, in order
PARAPHRASE = 0.5  # of them, when the answer is there too
ANSWER_WORDS = 5
ANSWER = 0.8  # of the answer's words, in order
CACHE_WORDS = 200_000
_PUNCTUATION = bytes(32 if (33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126) else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words, ASCII punctuation as space."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION).split()


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        b = self[word] = zlib.crc32(word) & (BUCKETS - 1)
        return b

    def many(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def idf(docs: DataFrame) -> np.ndarray:
    """Weight of each bucket from the number of (document, different word) pairs that fall into it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, seen, n = _Buckets(), np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for k in range(0, b.num_rows, 500):
                words = [w for t in b.column(0).slice(k, 500).to_pylist() for w in set(words_of(t))]
                seen += np.bincount(buckets.many(words), minlength=BUCKETS)
            n += b.num_rows
        at = np.flatnonzero(seen)
        for k in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 50_000]), pa.array(seen[at[k : k + 50_000]])], ["bucket", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([n])], ["bucket", "n"])

    got = in_arrow(docs.select(text_of().alias("text")), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS + 1 rows
    at, n = got["bucket"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(BUCKETS)
    df[at[at >= 0]] = n[at >= 0]
    return np.log((n[at < 0].sum() + 1) / (df + 1)).astype(np.float32)


def passages_of(item: list[bytes]) -> list[list[bytes]]:
    """The item, and where it is long its even pieces of at most a passage."""
    n = -(-len(item) // (2 * BLOCK)) if len(item) > LONG else 0
    edges = [len(item) * k // n for k in range(n + 1)] if n else []
    return [item, *(item[i:j] for i, j in zip(edges, edges[1:], strict=False))]


def tfidf(words: list[bytes], weight: np.ndarray, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets and their weights, of unit length in all; the length before."""
    b, n = np.unique(buckets.many(words), return_counts=True)
    w = n * np.maximum(weight[b], 1e-6)
    size = float(np.linalg.norm(w))
    return b, w / size, size


def _signs(buckets: np.ndarray, k: int) -> np.ndarray:
    """A row of random signs for each bucket, the same on every executor."""
    with np.errstate(over="ignore"):
        x = (buckets[:, None].astype(np.uint64) * np.uint64(k) + np.arange(k, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.where(x >> np.uint64(40) & np.uint64(1), 1.0, -1.0)


@dataclass
class Basis:
    """Rows of the basis for the buckets that the benchmark has; ``at`` maps a bucket to its row or -1."""

    at: np.ndarray
    rows: np.ndarray

    def of(self, buckets: np.ndarray) -> np.ndarray:
        i = self.at[buckets]
        out = self.rows[i]
        out[i < 0] = 0
        return out


def randomised_svd(rows: list[tuple[np.ndarray, np.ndarray]], rank: int) -> Basis:
    """The leading right singular vectors of a block's TF-IDF rows, then directions for the rows that these keep less than ``KEEP`` of."""
    at = np.full(BUCKETS, -1, np.int32)
    if not rows:
        return Basis(at, np.zeros((1, 1), np.float32))
    seen = np.unique(np.concatenate([b for b, _ in rows]))
    at[seen] = np.arange(len(seen))
    table = np.zeros((len(rows), len(seen)))
    for line, (b, w) in zip(table, rows, strict=True):
        line[at[b]] = w
    q = _signs(seen, rank + OVERSAMPLE)
    for _ in range(POWER_STEPS + 1):
        q = np.linalg.qr(table.T @ np.linalg.qr(table @ q)[0])[0]
    _, size, turn = np.linalg.svd(table @ q, full_matrices=False)
    # strongest directions first
    q = (q @ turn[size > size[0] * 1e-6].T)[:, :rank]
    poor = table[((table @ q) ** 2).sum(1) < KEEP]
    if len(poor):
        _, size, more = np.linalg.svd(poor - poor @ q @ q.T, full_matrices=False)
        q = np.hstack([q, more[size > size[0] * 1e-6].T])
    return Basis(at, np.ascontiguousarray(q).astype(np.float32))


def common_subsequence(item: list[bytes], words: list[bytes]) -> int:
    """Length of the longest common subsequence, all cells of a row at once in one integer."""
    at: dict[bytes, int] = {}
    for k, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in words:
        if m := at.get(w):
            u = row & m
            row = (row + u | row - u) & full
    return len(item) - row.bit_count()


class Passages:
    """The words of some texts in blocks: what does not depend on the items looked for."""

    def __init__(self, words: list[list[bytes]], weight: np.ndarray, buckets: _Buckets):
        size = np.array([len(w) for w in words], np.int64)
        blocks = -(-size // BLOCK)
        self.first = np.cumsum(blocks) - blocks
        self.bucket = buckets.many([w for ws in words for w in ws])
        doc = np.repeat(np.arange(len(words)), size)
        pos = np.arange(len(self.bucket)) - np.repeat(np.cumsum(size) - size, size)
        self.block = self.first[doc] + pos // BLOCK
        self.weight = weight[self.bucket]
        self.n = n = int(blocks.sum())
        energy = np.bincount(self.block, self.weight.astype(float) ** 2, n)
        self.owner = np.repeat(np.arange(len(words)), blocks)
        self.joined = np.zeros(n, bool)
        self.joined[:-1] = self.owner[1:] == self.owner[:-1]
        self.two = np.flatnonzero(self.joined)
        self.energy = energy.copy()  # of passages
        self.energy[self.two] += energy[self.two + 1]


@dataclass
class Searcher:
    """Everything that a task needs to look for a block of items in texts: bounded by the block's rows and their words."""

    ids: list
    items: list[list[bytes]]
    of: np.ndarray  # the item of each row
    latent: np.ndarray  # rows x rank: directions of items and passages
    kept: np.ndarray  # of the rows' unit vectors: their lengths in the latent space
    basis: Basis
    weight: np.ndarray
    sizes: np.ndarray  # of the rows' vectors before they were made unit vectors
    cosine: float = COSINE
    _lengths: np.ndarray | None = None
    buckets: _Buckets = field(default_factory=_Buckets, repr=False)
    _counts: list[Counter] | None = None

    @property
    def lengths(self) -> np.ndarray:
        """Lengths of the basis' rows."""
        if self._lengths is None:
            self._lengths = np.linalg.norm(self.basis.rows, axis=1)
        return self._lengths

    @property
    def counts(self) -> list[Counter]:
        """How often each item has each of its words."""
        if self._counts is None:
            self._counts = [Counter(w) for w in self.items]
        return self._counts

    def __getstate__(self):
        return self.__dict__ | {"buckets": None, "_counts": None}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.buckets = _Buckets()

    def candidates(self, words: list[list[bytes]], read: Passages | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word, item and cosine (1 for a copy) of the passages within the threshold, best first."""
        read = read or Passages(words, self.weight, self.buckets)
        first, bucket, block, weight, n = read.first, read.bucket, read.block, read.weight, read.n
        owner, joined, two, whole_energy = read.owner, read.joined, read.two, read.energy
        row = self.basis.at[bucket]
        # a sum of vectors is no longer than the sum of their lengths: most passages end here, before any vector is added
        bound = np.bincount(block, weight * np.where(row >= 0, self.lengths[row], 0.0), n)
        bound[two] += bound[two + 1].copy()
        enough, held = self.cosine * self.kept, HELD * self.sizes * self.kept
        least = np.minimum(enough.min(initial=1.0) ** 2 * np.maximum(whole_energy, 1e-9), held.min(initial=np.inf) ** 2)
        may = bound**2 >= least
        needed = may.copy()
        needed[1:] |= may[:-1] & joined[:-1]
        known = np.flatnonzero((row >= 0) & needed[block])
        latent = np.zeros((n, self.basis.rows.shape[1]), np.float32)
        if len(known):
            begins = np.flatnonzero(np.concatenate([[True], block[known][1:] != block[known][:-1]]))
            latent[block[known][begins]] = np.add.reduceat(self.basis.rows[row[known]] * weight[known][:, None], begins, axis=0)
        # a passage is a block and the next one of the same document; the last block stands alone
        whole = latent.copy()
        whole[two] += latent[two + 1]
        near = np.flatnonzero(may)
        near = near[(whole[near] ** 2).sum(1) >= least[near]]
        out = []
        for k in range(0, len(near), 4096):
            some = near[k : k + 4096]
            for j in range(0, len(self.latent), 4096):
                part = whole[some] @ self.latent[j : j + 4096].T
                cos = part / np.sqrt(np.maximum(whole_energy[some], 1e-9))[:, None]
                p, i = np.nonzero((cos >= enough[j : j + 4096]) | (part >= held[j : j + 4096]))
                out.append((some[p], self.of[i + j], np.minimum(cos[p, i] / self.kept[i + j], 1)))
        if not out:
            return (np.zeros(0, int),) * 4
        p, i, c = (np.concatenate(x) for x in zip(*out, strict=True))
        by = np.argsort(-c, kind="stable")
        p, i, c = p[by], i[by], c[by]
        return owner[p], (p - first[owner[p]]) * BLOCK, i, c

    def search(self, texts: list[str]) -> list[dict[int, tuple[float, float]]]:
        """For each text the items found: number -> (share of the item's words, cosine)."""
        return self.look([words_of(t) for t in texts])

    def look(self, words: list[list[bytes]], read: Passages | None = None) -> list[dict[int, tuple[float, float]]]:
        found: list[dict[int, tuple[float, float]]] = [{} for _ in words]
        for d, at, i, c in zip(*(x.tolist() for x in self.candidates(words, read)), strict=True):
            if i in found[d]:
                continue
            item = self.items[i]
            around = words[d][max(0, at - len(item)) : at + 2 * BLOCK + len(item)]
            # no subsequence is longer than what both have in any order
            count = self.counts[i]
            if sum(count[w] for w in count.keys() & around) < PARAPHRASE * len(item):
                continue
            share = common_subsequence(item, around) / len(item)
            if share >= LEAK or share >= PARAPHRASE and common_subsequence(item[-ANSWER_WORDS:], around) >= ANSWER * len(item[-ANSWER_WORDS:]):
                found[d][i] = (share, c)
        return found


class Searchers(Sequence):
    """The searchers of all blocks: rows of a written table, of which the driver holds those that are asked for."""

    def __init__(self, stored: DataFrame, weight: np.ndarray, cosine: float):
        self.stored, self.weight, self.cosine = stored, weight, cosine
        self.blocks = sorted(r.block for r in stored.select("block").collect())  # a number for each of the blocks

    def __len__(self) -> int:
        return len(self.blocks)

    def __getitem__(self, at):
        if not isinstance(at, slice):
            return self[slice(at, at + 1)][0]
        wanted = self.blocks[at]
        rows = self.stored.where(F.col("block").isin(wanted)).orderBy("block").collect() if wanted else []
        return [self._load(pickle.loads(r.made)) for r in rows]

    def _load(self, made: dict) -> Searcher:
        at = np.full(BUCKETS, -1, np.int32)
        at[made["seen"]] = np.arange(len(made["seen"]))
        return Searcher(made["ids"], made["items"], made["of"], made["latent"], made["kept"], Basis(at, made["rows"]), self.weight, made["sizes"], self.cosine)


def _made(ids: list, items: list[list[bytes]], weight: np.ndarray) -> dict:
    """What a searcher of these items is loaded from."""
    buckets = _Buckets()
    rows = [(j, tfidf(p, weight, buckets)) for j, w in enumerate(items) for p in passages_of(w)]
    basis = randomised_svd([r[:2] for _, r in rows], ceil(RANK * len(rows)))
    latent = np.zeros((len(rows), basis.rows.shape[1]), np.float32)
    for k, (_, (b, w, _)) in enumerate(rows):
        latent[k] = w @ basis.of(b)
    kept = np.linalg.norm(latent, axis=1)
    seen = np.flatnonzero(basis.at >= 0)
    return {"ids": ids, "items": items, "of": np.array([j for j, _ in rows], np.int64), "latent": latent / kept[:, None], "kept": kept, "seen": seen[np.argsort(basis.at[seen])], "rows": basis.rows, "sizes": np.array([r[2] for _, r in rows], np.float32)}


def searchers(docs: DataFrame, benchmark: DataFrame, rows: int = ROWS, cosine: float = COSINE, block_items: int = ROWS) -> Searchers:
    """One searcher for each block of about ``rows`` rows and at most about ``block_items`` items, dealt by a hash and made by a task each."""
    has(docs, "doc_id", "text")
    has(benchmark, "item_id", "text")
    weight = idf(docs)
    shared = docs.sparkSession.sparkContext.broadcast(weight)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [len(passages_of(w)) if (w := words_of(t)) else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lines, pa.int64())], [*b.schema.names, "lines"])

    def make(key: tuple, items: pa.Table) -> pa.Table:
        items = items.sort_by([("item_id", "ascending"), ("text", "ascending")])
        made = _made(items["item_id"].to_pylist(), [words_of(t) for t in items["text"].to_pylist()], shared.value)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "made": pa.array([pickle.dumps(made)], pa.binary())})

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"), F.xxhash64("item_id", "text").alias("hash"))
    items = written(in_arrow(items, count, "item_id long, text string, hash long, lines long").where("lines > 0"), "benchmark-items")
    size = items.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.count("*").alias("n")).first()
    n = max(1, -(-size.lines // rows), -(-size.n // block_items))
    dealt = items.select(F.pmod("hash", F.lit(n)).alias("block"), "item_id", "text")
    return Searchers(written(dealt.groupBy("block").applyInArrow(make, "block long, made binary"), "searchers"), weight, cosine)


TEXTS_AT_ONCE = 200
_HIT = "item_ids array<long>, share double, cosine double"


def _found_in(group: list[Searcher], texts: list[str]) -> Iterator[tuple[list, tuple]]:
    """For each text the items' ids and the share and cosine of the best one."""
    if not group:
        yield from (([], (None, None)) for _ in texts)
        return
    for k in range(0, len(texts), TEXTS_AT_ONCE):
        words = [words_of(t) for t in texts[k : k + TEXTS_AT_ONCE]]
        read = Passages(words, group[0].weight, group[0].buckets)
        for hits in zip(*(s.look(words, read) for s in group), strict=True):
            ids = [s.ids[i] for s, h in zip(group, hits, strict=True) for i in h]
            yield ids, max((v for h in hits for v in h.values()), default=(None, None))


def _ordered(ids: list) -> list:
    return sorted(ids, key=lambda x: (x is not None, x or 0))


def _hits(docs: DataFrame, shared) -> DataFrame:
    """text_key, item_ids, share, cosine of the texts that hold an item of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(key, ids, *best) for key, (ids, best) in zip(b.column(0).to_pylist(), _found_in(shared.value, b.column(1).to_pylist()), strict=True) if ids]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.list_(pa.int64()), pa.float64(), pa.float64()))], ["text_key", "item_ids", "share", "cosine"])

    return in_arrow(docs.select(F.md5(text_of()).alias("text_key"), text_of().alias("text")), run, f"text_key string, {_HIT}")


def _all_hits(docs: DataFrame, found: Sequence) -> DataFrame:
    """text_key, item_ids, share, cosine over all groups; one pass over the texts for each, and one group at a time on the driver."""
    parts = []
    for k in range(0, len(found), GROUP):
        shared = docs.sparkSession.sparkContext.broadcast(found[k : k + GROUP])
        parts.append(written(_hits(docs, shared), "leaks"))
        shared.destroy()
    # copies of a text have the same hits
    each = reduce(DataFrame.unionByName, parts).groupBy("text_key", "item_ids", "share", "cosine").agg(F.lit(1).alias("one"))
    best = F.max(F.struct("share", "cosine"))
    return each.groupBy("text_key").agg(F.array_sort(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), best.alias("best")).select("text_key", "item_ids", "best.share", "best.cosine")


def contamination(docs: DataFrame, found: Sequence) -> DataFrame:
    """doc_id, contaminated, item_ids (ascending, nulls first), share and cosine of the best item found."""
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    if len(found) <= GROUP:
        shared = docs.sparkSession.sparkContext.broadcast(found[:])
        rows = in_arrow(docs.select(doc_id, text_of().alias("text")), partial(_add_hits, shared), f"doc_id long, {_HIT}")
    else:
        rows = docs.select(doc_id, F.md5(text_of()).alias("text_key")).join(_all_hits(docs, found), "text_key", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<long>"))
    nulls = F.filter(ids, lambda x: x.isNull())
    return rows.select("doc_id", (F.size(ids) > 0).alias("contaminated"), F.concat(nulls, F.filter(ids, lambda x: x.isNotNull())).alias("item_ids"), "share", "cosine")


def _add_hits(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = list(_found_in(shared.value, b.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_ordered(ids) for ids, _ in got], pa.list_(pa.int64())), pa.array([best[0] for _, best in got], pa.float64()), pa.array([best[1] for _, best in got], pa.float64())], ["doc_id", "item_ids", "share", "cosine"])


def _clean(shared, texts: list[str]) -> np.ndarray:
    return np.array([not ids for ids, _ in _found_in(shared.value, texts)], bool)


def without_leaks(docs: DataFrame, found: Sequence) -> DataFrame:
    if len(found) <= GROUP:
        return keep_rows(docs, partial(_clean, docs.sparkSession.sparkContext.broadcast(found[:])))
    key, leaks = F.md5(text_of()), _all_hits(docs, found).select(F.col("text_key").alias("_leak"))
    return docs.join(leaks, key == F.col("_leak"), "left_anti")
