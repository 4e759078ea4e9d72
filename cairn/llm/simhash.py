"""SimHash near-duplicates: fingerprints of word shingles, compared bit-sliced inside buckets, linked into components.

A fingerprint has ``lanes`` words of 64 bits; a bit is 1 if it is set in over half of the shingles' hashes. Buckets come from

* ``masks``: the fingerprint is cut into ``blocks`` pieces, and every choice of ``blocks - radius`` pieces is a key. Two
  fingerprints within the radius share at least one such key, so nothing is lost; or
* ``sketch``: pairs of min-hashes of the shingle set. For large radii no choice of pieces is selective: at a similarity of
  0.8 about 20 % of the bits differ. Two sets of Jaccard similarity J share a key with probability 1 - (1 - J^2)^12: over
  0.99999 at 0.8, and 0.999 at 2/3, where texts of one length have a cosine of 0.8.

Equal fingerprints collapse before any comparison, and each bucket yields a spanning forest of its links instead of all
pairs. In buckets beyond ``BLOCK_ROWS`` fingerprints those within the radius of one of them, the pivot, are linked with it and with each other by that;
only the rest is compared with all, in blocks, so that a large group of near copies costs little more than one comparison each.

Defined results: a null text is an empty one; a text without words has the fingerprint zero and is linked like any other
(``sketch``: only with other empty ones); a null ``doc_id`` gets its group's class and never names one unless the whole group has
null ids; repeated rows stay rows; an empty table gives no rows; other columns are ignored; texts of any length are read whole, their shingles in pieces.
A ``doc_id`` of 2^63 - 1 counts as null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import bitslice
from .common import has, in_arrow, shuffle_parts, text_of, written
from .components import components

SEED = 42
BLOCK_ROWS = 4096
SMALL = 8  # larger buckets are searched, smaller ones compared all at once
SKETCH_KEYS = 12
NO_ID = (1 << 63) - 1
CHUNK_WORDS = 1 << 16  # of one text in memory as shingles

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, salt) -> np.ndarray:
    """A fresh hash from a hash (the splitmix64 finaliser); several salts in a column give a row each."""
    with np.errstate(over="ignore"):
        x = x + _GOLD * np.asarray(salt, np.uint64)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, repeats included, in pieces of bounded size."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space cuts
    digest = xxhash.xxh64_intdigest
    if 0 < len(found) < words:
        yield np.array([digest(b" ".join(found), SEED)], np.uint64)
    for start in range(0, max(0, len(found) - words + 1), CHUNK_WORDS):
        some = found[start : start + CHUNK_WORDS + words - 1]
        joined = b" ".join(some)
        ends, at = [], -1
        for w in some:
            at += len(w) + 1
            ends.append(at)
        begin = 0
        out = []
        for e, w in zip(islice(ends, words - 1, None), some, strict=False):
            out.append(digest(joined[begin:e], SEED))
            begin += len(w) + 1
        yield np.array(out, np.uint64)


def _bit_counts(x: np.ndarray) -> np.ndarray:
    """How many of the hashes in each row have each bit: rows x hashes to rows x 64. Eight bits are counted in the bytes of one word, 255 hashes at a time."""
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8), axis=2, bitorder="little").view(np.uint64)
    part = np.add.reduceat(bits, np.arange(0, x.shape[1], 255), axis=1)
    return part.view(np.uint8).sum(1, dtype=np.int64)


_LANES = np.arange(1, 64)[:, None]
_SKETCH = np.arange(100, 100 + 2 * SKETCH_KEYS)[:, None]


def fingerprint(text: str, words: int, lanes: int, sketch: bool) -> tuple[bytes, list[int]]:
    """The fingerprint's bytes and, for a sketch, the keys of its buckets."""
    total, ones = 0, np.zeros((lanes, 64), np.int64)
    least = np.full(2 * SKETCH_KEYS, bitslice.ALL, np.uint64)
    for h in shingle_hashes(text, words):
        total += len(h)
        ones += _bit_counts(np.concatenate([h[None], _mix(h, _LANES[: lanes - 1])]))
        if sketch:
            least = np.minimum(least, _mix(h, _SKETCH).min(1))
    keys = (_mix(_mix(least[::2], 7) ^ least[1::2], 8) + np.arange(SKETCH_KEYS, dtype=np.uint64)).view(np.int64).tolist() if sketch else []
    return np.packbits(ones.reshape(-1) * 2 > total, bitorder="little").tobytes(), keys


def masks(bits: int, blocks: int, radius: int) -> list[np.ndarray]:
    edges = np.linspace(0, bits, blocks + 1).round().astype(int)
    out = []
    for chosen in combinations(range(blocks), blocks - radius):
        m = np.zeros(bits, np.uint8)
        for b in chosen:
            m[edges[b] : edges[b + 1]] = 1
        out.append(np.packbits(m, bitorder="little").view(np.uint64))
    return out


def _mask_keys(prints: np.ndarray, chosen: list[np.ndarray]) -> np.ndarray:
    """Keys of each fingerprint, one for each mask; a clash of keys costs a comparison, never a link."""
    out = []
    for t, m in enumerate(chosen):
        key = np.full(len(prints), t + 1, np.uint64)
        for lane in range(prints.shape[1]):
            key = _mix(prints[:, lane] & m[lane] ^ _mix(key, 3), t + 11)
        out.append(key.view(np.int64))
    return np.stack(out, 1)


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1, sketch: bool = False) -> DataFrame:
    """doc_id, text_hash, fp (binary, ``8 * lanes`` bytes, least significant first), keys (of the sketch's buckets)."""
    has(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [fingerprint(t.as_py(), words, lanes, sketch) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.list_(pa.int64()))], ["doc_id", "text_hash", "fp", "keys"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text")), run, "doc_id long, text_hash long, fp binary, keys array<long>")


def _keyed(prints: DataFrame, blocks: int, radius: int, lanes: int) -> DataFrame:
    chosen = masks(64 * lanes, blocks, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64).reshape(-1, lanes)
            keys = _mask_keys(fp, chosen)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1, dtype=np.int32) * len(chosen)), pa.array(keys.reshape(-1)))], ["fp", "keys"])

    return in_arrow(prints.select("fp"), run, "fp binary, keys array<long>")


def _around_pivots(rows: DataFrame, lanes: int, radius: int, tail: int) -> tuple[DataFrame, DataFrame]:
    """For large buckets (fp, key, n): the rows fp, key, i, j that are left to compare, and the links a, b of pivots with those near them.

    Fingerprints near the pivot are one component by it. Any other link has an end that is far from it: the far ones, in blocks j, meet all, in blocks i.
    """
    pivots = written(rows.groupBy("key").agg(F.min("fp").alias("pivot")), "pivots")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, lanes + tail)[:, :lanes] for k in (0, 3))
            far = np.bitwise_count(a ^ b).sum(1, dtype=np.int64) > radius
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far)], [*batch.schema.names, "far"])

    told = written(in_arrow(rows.join(pivots, "key").select("fp", "key", "n", "pivot"), split, "fp binary, key long, n long, pivot binary, far boolean"), "around-pivots")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_ROWS).cast("int")
    counts = written(told.where("far").groupBy("key").agg(F.count("*").alias("r")), "far-counts")
    left = told.join(counts, "key").select("fp", "key", "far", blocks("n").alias("ni"), blocks("r").alias("nj"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda n, salt: F.pmod(F.xxhash64("fp", F.lit(salt)), F.col(n)).cast("int")
    every = left.select("fp", "key", block("ni", 1).alias("i"), each("nj").alias("j"))
    far = left.where("far").select("fp", "key", each("ni").alias("i"), block("nj", 2).alias("j"))
    return every.unionByName(far), told.where("NOT far AND fp <> pivot").select(F.col("pivot").alias("a"), F.col("fp").alias("b"))


def links(keyed: DataFrame, lanes: int, radius: int, tail: int = 0) -> DataFrame:
    """Links a, b between distinct fingerprints: in each bucket a spanning forest of the pairs within the radius. ``keyed``: fp, keys.

    ``tail``: words of 64 bits behind each fingerprint that belong to its name and aren't compared.
    """
    rows = written(keyed.select("fp", F.explode(F.array_distinct("keys")).alias("key")), "buckets")
    sizes = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    none = F.lit(0).alias("i"), F.lit(0).alias("j")
    dealt = rows.join(sizes.where(F.col("n") <= BLOCK_ROWS).select("key"), "key").select("fp", "key", *none)
    large, to_pivot = sizes.where(F.col("n") > BLOCK_ROWS), None
    if not large.isEmpty():
        apart, to_pivot = _around_pivots(rows.join(large, "key"), lanes, radius, tail)
        dealt = dealt.unionByName(apart)
    dealt = dealt.repartition(shuffle_parts(keyed.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(fp, a, b):
            size = 8 * (lanes + tail)
            raw = fp.tobytes()
            cut = lambda x: [raw[k * size : k * size + size] for k in x.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(cut(a), pa.binary()), pa.array(cut(b), pa.binary())], ["a", "b"])

        def solve(fp, group):
            sizes = np.diff(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])))
            small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
            if small.any():
                few = fp[small]
                yield out(few, *bitslice.small_groups(np.ascontiguousarray(few[:, :lanes]), sizes[(sizes > 1) & (sizes <= SMALL)], radius))
            ends = np.cumsum(sizes)
            for g in np.flatnonzero(sizes > SMALL):
                some = fp[ends[g] - sizes[g] : ends[g]]
                yield out(some, *bitslice.forest(np.ascontiguousarray(some[:, :lanes]), radius))

        held_fp, held_key, kept = [], [], 0
        for batch in batches:
            fp = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64).reshape(-1, lanes + tail)
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3)], 1)
            held_fp.append(fp)
            held_key.append(key)
            kept += len(fp)
            if kept < 20_000:
                continue  # more at once is faster; groups are bounded
            fp, key = np.concatenate(held_fp), np.concatenate(held_key)
            new = np.concatenate([[True], (key[1:] != key[:-1]).any(1)])
            last = int(np.flatnonzero(new)[-1])  # the last group may go on in the next batch
            if last:
                yield from solve(fp[:last], np.cumsum(new)[:last])
            held_fp, held_key, kept = [fp[last:]], [key[last:]], len(fp) - last
        if kept:
            fp, key = np.concatenate(held_fp), np.concatenate(held_key)
            yield from solve(fp, np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])))

    found = in_arrow(dealt.select("fp", "key", "i", "j"), compare, "a binary, b binary")
    return (found if to_pivot is None else found.unionByName(to_pivot)).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, lanes: int = 1, radius: int = 3, blocks: int = 6, sketch: bool = False) -> DataFrame:
    """doc_id, fp, component_id: the smallest ``doc_id`` among the documents that links reach, itself included; stays: whether
    the row is its component's first one by id (null last), then by a hash of the text."""
    made = written(fingerprints(docs, words, lanes, sketch), "fingerprints")
    row = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text_hash")
    if sketch:  # the buckets' keys belong to the text: texts with the same print and keys collapse
        alike = made.groupBy("fp", "keys").agg(F.min(row).alias("first"))
        keyed, reps = alike.select("fp", "keys"), alike.groupBy("fp").agg(F.min("first").alias("first"))
    else:
        reps = made.groupBy("fp").agg(F.min(row).alias("first"))
        keyed = _keyed(reps, blocks, radius, lanes)
    reached = components(links(keyed, lanes, radius))
    # both sides of the join by root are tables, so that AQE can deal the members of a large class to several tasks
    classes = written(reps.join(reached.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "classes")
    least = written(classes.groupBy("root").agg(F.min("first").alias("least")), "least")
    of_print = classes.join(least, "root").select("fp", "least")
    return made.join(of_print, "fp").select("doc_id", "fp", F.nullif("least.id", F.lit(NO_ID)).alias("component_id"), (row == F.col("least")).alias("stays"), "text_hash")


def hex_of(fp):
    """A one-lane fingerprint column as 16 lower-case hex digits."""
    return F.concat(*[F.lower(F.hex(F.substring(fp, k, 1))) for k in range(8, 0, -1)])


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """text_hash, shingles: the different hashes of each text's shingles, sorted. ``docs``: text_hash, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # sorted as the signed numbers that they travel as: they are searched in
            sets = [np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(t.as_py(), words)]).view(np.int64)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["text_hash", "shingles"])

    return in_arrow(docs, run, "text_hash long, shingles array<long>")


def _text_of_node(c: str):
    """The last 16 hex digits of a node are its text's hash."""
    return F.conv(F.right(F.hex(c), F.lit(16)), 16, -10).cast("long")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b: nodes) whose texts' shingle sets have this Jaccard similarity or more; two empty sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    of = lambda c: sets.select(F.col("text_hash").alias(f"_{c}"), F.col("shingles").alias(f"set_{c}"))
    hashed = pairs.withColumns({"_a": _text_of_node("a"), "_b": _text_of_node("b")})
    return in_arrow(hashed.join(of("a"), "_a").join(of("b"), "_b").select("a", "b", "set_a", "set_b"), run, "a binary, b binary")


def _joined(prints: np.ndarray, label: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links between texts of different labels, within the radius and alike, that join all labels that any such link joins.

    The most central text goes first: it is alike with most of a group of near copies, more than they are with each other. Then each text outside the largest group meets all
    texts of other groups, so that every pair of groups is met from one side at least.
    """
    out, label = [], label.copy()
    ends = np.cumsum([0, *map(len, sets)])
    every = np.concatenate([np.empty(0, np.int64), *sets])

    def meet(k: int, big: int) -> None:
        others = np.flatnonzero((label != label[k]) & (np.bitwise_count(prints ^ prints[k]).sum(1, dtype=np.int64) <= radius))
        if not len(others):
            return
        sizes = ends[others + 1] - ends[others]
        of = np.repeat(np.arange(len(others)), sizes)
        values = every[np.repeat(ends[others] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        own = sets[k]
        hit = own[np.minimum(np.searchsorted(own, values), max(len(own) - 1, 0))] == values if len(own) else np.zeros(len(values), bool)
        both = np.bincount(of, hit, len(others))
        good = others[both >= similarity * (len(own) + sizes - both) - 1e-9]
        named, first = np.unique(label[good], return_index=True)
        out.extend((k, int(g)) for g in good[first])
        to = big if big in named else label[k]
        label[np.isin(label, named) | (label == label[k])] = to

    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1)
    count = bits.sum(0, dtype=np.int64)
    far = np.where(bits, len(bits) - count, count).sum(1)
    order = np.argsort(far, kind="stable").tolist()
    meet(order[0], -1)
    names, n = np.unique(label, return_counts=True)
    big = int(names[n.argmax()])
    for k in order:
        if label[k] != big:
            meet(k, big)
    return out


def _between_groups(rows: DataFrame, lanes: int, radius: int, similarity: float) -> DataFrame:
    """Links a, b between texts of different groups (``root``) of a set that hangs together by candidates (``whole``). ``rows``: fp (node), whole, root, shingles.

    Only sets with several groups are looked at, large ones in pairs of blocks; each gives at most a link for each group in it.
    """
    sizes = written(rows.groupBy("whole").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("whole", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")), "mixed")
    own = rows.join(sizes, "whole").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(3)), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = met.select("fp", "root", "shingles", "whole", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = dealt.repartition(shuffle_parts(rows.sparkSession), "whole", "i", "j").sortWithinPartitions("whole", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, roots, sets, place = [], [], [], None

        def solved():
            prints = np.frombuffer(b"".join(names), np.uint64).reshape(-1, lanes + 1)[:, :lanes]
            numbers: dict = {}
            label = np.array([numbers.setdefault(r, len(numbers)) for r in roots])
            found = _joined(np.ascontiguousarray(prints), label, sets, radius, similarity)
            return pa.RecordBatch.from_arrays([pa.array([names[k] for k, _ in found], pa.binary()), pa.array([names[m] for _, m in found], pa.binary())], ["a", "b"])

        for batch in batches:
            for fp, root, whole, i, j, shingles in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5)), batch.column(2)):
                if (whole, i, j) != place:
                    if names:
                        yield solved()
                    names, roots, sets, place = [], [], [], (whole, i, j)
                names.append(fp)
                roots.append(root)
                sets.append(shingles.values.to_numpy())
        if names:
            yield solved()

    return in_arrow(dealt, compare, "a binary, b binary").distinct()


def similar_texts(docs: DataFrame, words: int, lanes: int, radius: int, similarity: float) -> DataFrame:
    """As ``near_duplicates`` with sketch buckets, but a link needs the shingle sets' Jaccard similarity as well: the bit-sliced comparison finds candidates only.

    Nodes are different texts (fingerprint and hash). Each bucket's forest of candidates is confirmed. Where some of its links fail, the sides may still be joined by
    other pairs: in each set that candidates hold together the groups that are left meet once more, by their shingle sets, so that no link within the radius is lost.
    """
    made = written(fingerprints(docs, words, lanes, True), "fingerprints")
    node = F.concat("fp", F.unhex(F.lpad(F.hex("text_hash"), 16, "0")))
    row = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text_hash")
    reps = written(made.groupBy(node.alias("fp")).agg(F.min(row).alias("first"), F.first("keys").alias("keys")), "texts")
    found = written(links(reps.select("fp", "keys"), lanes, radius, 1), "candidates")
    ends = written(found.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "candidate-texts")
    wanted = ends.join(reps.select("fp", "first"), "fp").select(F.col("first.id").alias("_id"), F.col("first.text_hash").alias("text_hash"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    once = texts.join(wanted, ["_id", "text_hash"], "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))
    sets = written(shingle_sets(once, words), "shingle-sets")
    good = written(confirmed(found, sets, similarity), "confirmed")
    if good.count() < found.count():
        root_of = lambda links_, name: components(links_).select(F.col("node").alias("fp"), F.col("root").alias(name))
        rows = written(ends.join(root_of(found, "whole"), "fp").join(root_of(good, "root"), "fp", "left").select("fp", "whole", F.coalesce("root", "fp").alias("root")), "groups")
        rows = rows.withColumn("text_hash", _text_of_node("fp")).join(sets, "text_hash").select("fp", "whole", "root", "shingles")
        good = good.unionByName(written(_between_groups(rows, lanes, radius, similarity), "confirmed-later"))
    reached = components(good)
    classes = written(reps.select("fp", "first").join(reached.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "classes")
    least = written(classes.groupBy("root").agg(F.min("first").alias("least")), "least")
    of_text = classes.join(least, "root").select(F.col("fp").alias("node"), "least")
    return made.withColumn("node", node).join(of_text, "node").select("doc_id", "fp", F.nullif("least.id", F.lit(NO_ID)).alias("component_id"), (row == F.col("least")).alias("stays"), "text_hash")


#: A Jaccard similarity of 0.8 or more between the sets of five-word shingles. Texts of one length then have a cosine of 0.89: a bit of their fingerprints differs with
#: probability 0.15, 39 of 256 on average and 6 as the deviation, more for texts of a few shingles; a radius of 63 loses none of them but the shortest's rare ones.
SIMILAR = {"words": 5, "lanes": 4, "radius": 63, "similarity": 0.8}


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The documents, with all their columns, that come first in their group: smallest id (null last), then by a hash of the
    text. Of rows with the same id and text one stays."""
    groups = similar_texts(docs, **how) if "similarity" in how else near_duplicates(docs, **how)
    first = written(groups.where("stays").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "first-of-group")
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_hash": F.xxhash64(text_of())})
    whole = F.struct(*docs.columns)
    return keyed.join(first, ["_id", "_hash"], "left_semi").groupBy("_id", "_hash").agg(F.first(whole).alias("_row")).select("_row.*")
