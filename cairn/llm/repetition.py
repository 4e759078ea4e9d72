"""Quality rules: repetition inside a text by suffix and longest-common-prefix arrays over its words.

Texts are handled in batches: their words become integers, every text ends with a mark of its own, and one suffix array is
built for all by prefix doubling on the suffixes whose order is still open. The ranks of each doubling give the common
prefixes of neighbours in the array. Where a prefix interval of at least ``min_words`` words begins, the text repeats;
the union of those spans gives the covered fraction, the deepest interval the longest repeat.

Defined results: a null or empty text has no words and fails the base rules; a null ``doc_id`` stays null; repeated rows stay rows;
an empty table gives no rows; other columns are ignored. A text longer than a batch is a batch of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import has, in_arrow, text_of

MIN_WORDS = 8  # words of the shortest repeat that counts
MAX_COVERED = 0.3  # of the words
MAX_LONGEST = 200  # words
BATCH_WORDS = 300_000
_SPACE = re.compile("[\x20\x09-\x0d]")
_SYMBOLS = "#*$%&|<>"


def ranks(words: np.ndarray) -> list[np.ndarray]:
    """Rank arrays: entry t orders all suffixes by their first 2**t words; equal ranks mean equal words.

    The last array orders the suffixes fully (its inverse is the suffix array). ``words`` must end each text with a
    value found nowhere else, so that no equal prefixes reach over the end of a text.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    sorted_words = words[order]
    new = np.concatenate([[True], sorted_words[1:] != sorted_words[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    out, step = [rank], 1
    while True:
        size = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_):
            return out
        own, after = rank[open_], rank[np.minimum(open_ + step, n - 1)]
        by = np.lexsort((after, own))
        own, after, at = own[by], after[by], np.arange(len(by))
        group = np.concatenate([[True], own[1:] != own[:-1]])
        part = group | np.concatenate([[True], after[1:] != after[:-1]])
        first_of_group = np.maximum.accumulate(np.where(group, at, 0))
        first_of_part = np.maximum.accumulate(np.where(part, at, 0))
        rank = rank.copy()
        rank[open_[by]] = own + first_of_part - first_of_group
        out.append(rank)
        step *= 2


def common_prefixes(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and for each suffix in it the words it shares with the one before."""
    n = len(levels[-1])
    suffix = np.empty(n, np.int64)
    suffix[levels[-1]] = np.arange(n)
    a, b = suffix[:-1].copy(), suffix[1:].copy()
    shared = np.zeros(n, np.int64)
    for t in reversed(range(len(levels))):
        x, y = np.minimum(a + shared[1:], n - 1), np.minimum(b + shared[1:], n - 1)
        shared[1:] += np.where((levels[t][x] == levels[t][y]) & (x != y), 1 << t, 0)
    return suffix, shared


def repeats(levels: list[np.ndarray]) -> np.ndarray:
    """For each position the length of the longest string that begins there and again elsewhere in its text."""
    suffix, shared = common_prefixes(levels)
    longest = np.zeros(len(suffix), np.int64)
    longest[suffix] = np.maximum(shared, np.concatenate([shared[1:], [0]]))
    return longest


def _measure(texts: list[str], split: list[list[bytes]], min_words: int) -> list[tuple]:
    counts = np.array([len(s) for s in split], np.int64)
    known: dict[bytes, int] = {}
    flat = [known.setdefault(w, len(known)) for s in split for w in s]
    text = np.repeat(np.arange(len(texts)), counts + 1)
    ends = np.cumsum(counts + 1) - 1
    inner = np.ones(len(text), bool)
    inner[ends] = False
    words = np.empty(len(text), np.int64)
    words[inner] = np.array(flat, np.int64) + text[inner] * len(known)  # the same word in two texts is two values
    words[ends] = len(texts) * len(known) + np.arange(len(texts))
    levels = ranks(words)
    # three-word windows: equal first pairs and equal pairs one word on
    pair = levels[min(1, len(levels) - 1)]
    key = pair * len(pair) + np.concatenate([pair[1:], [0]])
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    window = np.flatnonzero(times[back] > 1) if len(levels) > 1 else np.zeros(0, np.int64)
    in_window = np.zeros(len(text) + 3, np.int64)
    for k in range(3):
        in_window[window + k] = 1
    n_repeat = np.bincount(text[inner], in_window[: len(text)][inner], len(texts)).astype(np.int64)
    longest = repeats(levels)
    begins = np.flatnonzero(longest >= min_words)
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + longest[begins], -1)
    covered = np.bincount(text, np.cumsum(edge)[:-1] > 0, len(texts)).astype(np.int64)
    deepest = np.zeros(len(texts), np.int64)
    np.maximum.at(deepest, text[begins], longest[begins])
    out = []
    for k, t in enumerate(texts):
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line in seen:
                dup += 1
            elif line and line.encode("utf-8", "surrogatepass").split():
                seen.add(line)
        out.append((int(counts[k]), len(t) - len(_SPACE.findall(t)), sum(map(t.count, _SYMBOLS)), dup, int(n_repeat[k]), int(covered[k]), int(deepest[k])))
    return out


def measures(texts: list[str], min_words: int = MIN_WORDS) -> list[tuple]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, longest_repeat of each text."""
    out: list[tuple] = []
    held, split, size = [], [], 0
    for t in texts:
        held.append(t)
        split.append(t.encode("utf-8", "surrogatepass").split())
        size += len(split[-1])
        if size >= BATCH_WORDS:
            out += _measure(held, split, min_words)
            held, split, size = [], [], 0
    return out + (_measure(held, split, min_words) if held else [])


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def quality(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """doc_id, the measures, base_failed and kept."""
    has(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                some = batch.slice(k, 1000)
                rows = measures(some.column(1).to_pylist(), min_words)
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array([r[c] for r in rows], pa.int64()) for c in range(len(COLUMNS)))], ["doc_id", *COLUMNS])

    found = in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), run, "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return found.withColumn("base_failed", base).withColumn("kept", ~base & good)
