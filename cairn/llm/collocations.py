"""Phrase collocations per language: suffix pointers of words, routed by their leading words, sorted by multikey three-way quicksort to a maximum depth.

* A suffix is the words of a piece of text from one word on, cut after ``longest``. A task turns its texts into numbers of a sorted vocabulary, collapses equal
  suffixes to one with a weight, so that copies of a text cost one, and cuts the sorted suffixes at global splitters.
* The splitters are taken from the different suffixes of a sample of documents. They are whole suffixes, (lang, word, word, word): a hot
  leading word or word pair is dealt to as many ranges as its different continuations need, and equal suffixes are always together.
* Each range sorts pointers to its suffixes by three-way quicksort, all partitions of a depth at once: the pointers that equal the pivot's word go on at the next word, and their
  weight is the count of the phrase so far. A partition that weighs less than ``least`` is abandoned.
* A phrase that a splitter begins with may lie in several ranges: its parts are counted in each and added up. All other counts are whole in one range.

Defined results: a null text is an empty one and has no words; a null language is ``und``; the document's id isn't read; of phrases with equal score and count the first in byte order comes
first; repeated rows count again; a text is cut into slices of ``SLICE`` bytes, and words that a cut parts from each other are put together again, so that texts of any length are counted whole; an empty
table gives no rows; other columns are ignored. Counts to 10^15 give exact scores.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import has, in_arrow, shuffle_parts, text_of, written

LONGEST = 3
LEAST = 10
TOP = 2000
SEED = 11
#: Suffixes that a task holds before it sends them on, and that a range should hold.
HELD = 1_500_000
#: Bytes of a text that are cut into words at once.
SLICE = 1 << 22
#: Documents that are sampled for a splitter, and suffixes of each.
SAMPLED_DOCS = 4
SAMPLED_SUFFIXES = 16
#: Parts of a language whose first phrases are found apart from each other.
RANK_PARTS = 32

_STOPS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)
_BLOCK = "part int, lang string, words array<string>, suffixes array<array<int>>, weights array<long>"


def _slices(text: str) -> Iterator[tuple[list[bytes], bool]]:
    """A text's lower-cased words, with ``.`` for the end of a piece (no word holds one), and whether the text goes on."""
    data = text.encode("utf-8", "surrogatepass").lower().translate(_STOPS)
    at = 0
    while at < len(data):
        to = at + SLICE
        if to < len(data):
            space = max(data.rfind(c, at, to) for c in (b" ", b"\t", b"."))
            if space < at:  # one word fills the slice
                space = min((x for c in (b" ", b"\t", b".") if (x := data.find(c, to)) >= 0), default=len(data))
            to = space + 1
        yield data[at:to].replace(b".", b" . ").split(), to < len(data)
        at = to


class _Numbers(dict):
    """Words to numbers from 1 on, in order of appearance; 0 ends a piece."""

    def __init__(self):
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Held:
    """A language's words that a task has seen and not sent on."""

    def __init__(self, longest: int):
        self.numbers, self.pieces, self.longest = _Numbers(), [], longest

    def add(self, text: str) -> int:
        k, before, got = self.longest, np.empty(0, np.int64), 0
        for words, more in _slices(text):
            codes = np.concatenate([before, np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))])
            got += len(words)
            if more:  # suffixes that begin with the last words wait for the next slice
                self.pieces.append((codes, max(0, len(codes) - k + 1)))
                before = codes[max(0, len(codes) - k + 1) :]
            else:
                self.pieces.append((np.concatenate([codes, np.zeros(k, np.int64)]), len(codes)))
        return got

    def suffixes(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words in byte order (the first is empty: no word), the different suffixes as rows of their places in it, in order, and how often each stands."""
        words = sorted(w for w in self.numbers if w != b".")
        place = np.zeros(len(self.numbers), np.int64)
        place[np.fromiter((self.numbers[w] for w in words), np.int64, len(words))] = np.arange(1, len(words) + 1)
        columns = [place[np.concatenate([place[:0], *(c[d : d + n] for c, n in self.pieces)])] for d in range(self.longest)]
        for d in range(1, self.longest):
            columns[d] *= columns[d - 1] > 0  # nothing follows the end of a piece
        rows = np.stack([c[columns[0] > 0] for c in columns], 1)
        width = len(words) + 1
        if width**self.longest < 1 << 63:
            key = rows[:, 0]
            for d in range(1, self.longest):
                key = key * width + rows[:, d]
            key, weight = np.unique(key, return_counts=True)
            out = np.empty((len(key), self.longest), np.int64)
            for d in reversed(range(self.longest)):
                key, out[:, d] = np.divmod(key, width)
        else:
            out, weight = np.unique(rows, axis=0, return_counts=True)
        return [b"", *words], out, weight.astype(np.int64)


def _place(splitter: tuple[bytes, ...], words: list[bytes], rows: np.ndarray) -> int:
    """How many of the sorted rows are less than the splitter."""
    low, high = 0, len(rows)
    for d, word in enumerate(splitter):
        at = bisect_left(words, word)
        column = rows[low:high, d]
        first = low + int(np.searchsorted(column, at))
        if at == len(words) or words[at] != word:
            return first
        low, high = first, low + int(np.searchsorted(column, at, "right"))
    return low


def _blocks(batches: Iterator[pa.RecordBatch], longest: int, splitters: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Texts (lang, text) to blocks of suffixes, one for each range and language."""
    held: dict[str, _Held] = {}
    got = 0

    def sent():
        for lang, some in sorted(held.items()):
            words, rows, weights = some.suffixes()
            key = lang.encode("utf-8", "surrogatepass")
            before = sum(s[0] < key for s in splitters)
            cuts = [_place(s[1:], words, rows) for s in splitters if s[0] == key]
            edges = [0, *cuts, len(rows)]
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                if a == b:
                    continue
                used, codes = np.unique(rows[a:b], return_inverse=True)
                codes = codes.reshape(-1, longest).astype(np.int32)
                used = [words[i].decode("utf-8", "surrogatepass") for i in used.tolist()]
                yield pa.RecordBatch.from_pylist([{"part": before + k, "lang": lang, "words": used, "suffixes": [codes[:, d] for d in range(longest)], "weights": weights[a:b]}], _schema())

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            got += held.setdefault(lang, _Held(longest)).add(text.as_py())
            if got >= HELD:
                yield from sent()
                held, got = {}, 0
    yield from sent()


def _schema() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("suffixes", pa.list_(pa.list_(pa.int32()))), ("weights", pa.list_(pa.int64()))])


def equal_parts(keys: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of pointers to the columns of ``keys`` (a row for each depth; a 0 ends a suffix), all partitions at once.

    Gives depth, pointers and weights: of each group of suffixes that are equal to that depth and weigh ``least`` or more, one pointer and the group's weight.
    """
    depths, size = keys.shape
    flat = keys.reshape(-1)
    at = np.arange(size)
    part, depth = np.zeros(size, np.int64), np.zeros(min(size, 1), np.int64)
    while len(at):
        begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = np.append(begins[1:], len(at))
        word = flat[depth[part] * size + at]
        pivot = np.sort(np.stack([word[begins], word[(begins + ends) // 2], word[ends - 1]]), axis=0)[1][part]
        kept_at, kept_part, kept_depth, n = [], [], [], 0
        for side, chosen in (("less", word < pivot), ("equal", word == pivot), ("more", word > pivot)):
            some, of = at[chosen], part[chosen]
            if not len(some):
                continue
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            weight = np.add.reduceat(weights[some], starts)
            heavy = weight >= least
            deep = depth[of[starts]]
            if side == "equal":
                heavy &= word[chosen][starts] > 0
                for d in np.unique(deep[heavy]).tolist():
                    told = heavy & (deep == d)
                    yield d + 1, some[starts[told]], weight[told]
                deep = deep + 1
                heavy &= deep < depths
            lengths = np.diff(np.append(starts, len(some)))
            kept_at.append(some[np.repeat(heavy, lengths)])
            kept_part.append(np.repeat(np.cumsum(heavy) - 1 + n, lengths)[np.repeat(heavy, lengths)])
            kept_depth.append(deep[heavy])
            n += int(heavy.sum())
        at, part, depth = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (kept_at, kept_part, kept_depth))


def _counted(batches: Iterator[pa.RecordBatch], longest: int, least: int, splitters: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Blocks of a range to its phrases and their counts; those that go on in other ranges, as a splitter at its ends begins with them, whatever they weigh. The empty phrase counts a
    language's words."""
    words: dict[str, int] = {"": 0}
    langs: dict[str, int] = {}
    columns, weights, parts = [], [], set()
    for batch in batches:
        parts.update(batch.column(0).to_pylist())
        for lang, own, suffixes, weight in zip(*(batch.column(k) for k in range(1, 5))):
            place = np.array([words.setdefault(w, len(words)) for w in own.values.to_pylist()], np.int32)
            codes = [place[s.values.to_numpy()] for s in suffixes.values]
            weights.append(weight.values.to_numpy())
            columns.append(np.stack([np.full(len(weights[-1]), langs.setdefault(lang.as_py(), len(langs) + 1), np.int32), *codes]))
    if not weights:
        return
    keys, weights = np.concatenate(columns, 1), np.concatenate(weights)
    ends = [tuple(x.decode("utf-8", "surrogatepass") for x in splitters[k]) for p in parts for k in (p - 1, p) if 0 <= k < len(splitters)]
    open_phrases = {s[: d + 1] for s in ends for d in range(1, longest) if s[d]}
    named, spelled = [None, *langs], list(words)
    out: dict[tuple, int] = {}
    for depth, some, weight in equal_parts(keys, weights, least):
        for k, w in zip(keys[:depth, some].T.tolist(), weight.tolist()):
            phrase = (named[k[0]], *(spelled[x] for x in k[1:]))
            if depth > 1 and phrase not in open_phrases:
                out[phrase] = w
    for lang, code in langs.items():
        out[(lang,)] = int(weights[keys[0] == code].sum())
    for phrase in open_phrases:
        if phrase[0] in langs and all(w in words for w in phrase[1:]):
            same = keys[0] == langs[phrase[0]]
            for d, w in enumerate(phrase[1:], 1):
                same &= keys[d] == words[w]
            if same.any():
                out[phrase] = int(weights[same].sum())
    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.string()), pa.array([list(p[1:]) for p in out], pa.list_(pa.string())), pa.array(list(out.values()), pa.int64())], ["lang", "words", "n"])


def _texts(docs: DataFrame) -> DataFrame:
    has(docs, "text", "lang")
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))


@dataclass
class Ranges:
    """Sorted splitters (lang, words ...): the first suffix of each range but the first one's."""

    splitters: list[tuple]
    parts: int


def ranges(docs: DataFrame, longest: int = LONGEST) -> Ranges:
    """From the different suffixes of a sample: at most ``SAMPLED_DOCS * SAMPLED_SUFFIXES`` of them for each range come to the driver."""
    texts, parts = _texts(docs), shuffle_parts(docs.sparkSession)
    total = texts.count()

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                (held := _Held(longest)).add(text.as_py())
                words, rows, weights = held.suffixes()
                if not len(rows):
                    continue
                chosen = rows[np.unique(np.linspace(0, len(rows) - 1, SAMPLED_SUFFIXES).astype(int))]
                spelled = [[words[i].decode("utf-8", "surrogatepass") for i in r] for r in chosen.tolist()]
                yield pa.RecordBatch.from_pylist([{"lang": lang, "words": s, "n": int(weights.sum()) if k == 0 else 0} for k, s in enumerate(spelled)], pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("n", pa.int64())]))

    def sampled(n: int) -> DataFrame:
        return in_arrow(texts.sample(min(1.0, max(400, SAMPLED_DOCS * n) / max(total, 1)), SEED), some, "lang string, words array<string>, n long")

    share = min(1.0, max(400, SAMPLED_DOCS * parts) / max(total, 1))
    words = sampled(parts).agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = max(parts, int(words / share / HELD) + 1)
    got = sorted({(r["lang"].encode("utf-8", "surrogatepass"), *(w.encode("utf-8", "surrogatepass") for w in r["words"])) for r in sampled(parts).select("lang", "words").distinct().collect()})
    return Ranges(sorted({got[k * len(got) // parts] for k in range(1, parts)}) if got else [], parts)


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, phrase (space-joined; empty: all words), words (how many), n: every phrase of up to ``longest`` words that stands ``least`` times or more."""
    cut = ranges(docs, longest)
    splitters = cut.splitters
    blocks = in_arrow(_texts(docs), lambda b: _blocks(b, longest, splitters), _BLOCK)
    routed = blocks.repartitionById(cut.parts, F.col("part"))
    counted = in_arrow(routed, lambda b: _counted(b, longest, least, splitters), "lang string, words array<string>, n long")
    whole = counted.groupBy("lang", F.concat_ws(" ", "words").alias("phrase"), F.size("words").alias("words")).agg(F.sum("n").alias("n"))
    return whole.where((F.col("n") >= least) | (F.col("words") == 0))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of two words and more by their weakest cut."""
    counts = written(phrase_counts(docs, longest, least), "phrase-counts")
    many = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    at = F.split("phrase", " ")
    cut = many.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice(at, F.lit(1), F.col("k"))).alias("head"), F.concat_ws(" ", F.slice(at, F.col("k") + 1, F.col("words") - F.col("k"))).alias("tail"))
    known = counts.where("words > 0")
    heads, tails = known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), known.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    parts = cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    parts = parts.withColumns({"top": wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)"), "under": wide("l") * wide("r")}).withColumn("score", F.expr("CAST(top AS DECIMAL(38,0)) DIV CAST(under AS DECIMAL(38,0))"))
    scored = parts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("least"))
    # every phrase inside a longer candidate, with the largest count of those
    inside = many.where("words > 2").select("lang", "a", "words", at.alias("at"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("w"))
    inside = inside.select("lang", "a", "at", "w", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("w") + 1)).alias("b"))
    longer = inside.groupBy("lang", F.concat_ws(" ", F.slice("at", F.col("b"), F.col("w"))).alias("phrase")).agg(F.max("a").alias("longer"))
    left = written(scored.join(longer, ["lang", "phrase"], "left").where("longer IS NULL OR longer * 2 < a").select("lang", "phrase", "a", "least.*"), "phrases")
    # a language may hold most phrases: its first ones are found in parts, and those of the parts are ranked
    order = "PARTITION BY {} ORDER BY score DESC, a DESC, phrase"
    firsts = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).withColumn("nth", F.expr(f"row_number() OVER ({order.format('lang, part')})")).where(F.col("nth") <= top)
    ranked = firsts.withColumn("rank", F.expr(f"row_number() OVER ({order.format('lang')})").cast("long")).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
