"""Exact duplicates by content sort: sampled splitters deal the texts out in order, each range is sorted, and neighbours are compared in full.

Texts are equal when they are identical after every run of ASCII white space is one space. Spark's range partitioning samples its splitters from
(head, hash, doc_id): the first characters and a hash of the whole normalised text, so that no sample holds a long text, and the id, so that a large group of copies
is dealt to many ranges. Inside a range the sort is over (head, hash, whole text, doc_id) and spills; equal texts are adjacent, the smallest id first. One pass
compares each text with the one before it, as a whole. A group that may go on in another range (it has the head and hash of the range's first or last
row) leaves one row with its text, two a range or so; those few are joined by their whole text, and correct the ids and sizes of their rows.

Defined results: a null text is an empty one; null ids come last, and a group of null ids only has a null ``keep_id``; of repeated rows of
the smallest id one is kept; texts of any length are compared whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import has, in_arrow, text_of, written

#: Characters of the text in front of its hash in the order; they only place a text, they never decide that two are equal.
HEAD = 32
#: Runs of white space that are not one space already.
_SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"

_RUNS = "doc_id long, keep_id long, group_size long, first boolean, text_sha256 string, part long, run long, edge_text string"


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), _SPACES, " ")


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, norm, head, hash: in content order over the partitions and inside each."""
    last = F.col("doc_id").asc_nulls_last()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm"), F.monotonically_increasing_id().alias("tie"))
    keyed = texts.select("*", F.substring("norm", 1, HEAD).alias("head"), F.xxhash64("norm").alias("hash"))
    return keyed.repartitionByRange("head", "hash", last, "tie").sortWithinPartitions("head", "hash", "norm", last, "tie").select("doc_id", "norm", "head", "hash")


class _Run:
    """Equal texts one after the other in a range."""

    def __init__(self, text: str):
        self.text, self.ids, self.nulls = text, [], 0

    def rows(self, part: int | None, number: int) -> pa.RecordBatch:
        ids = np.concatenate(self.ids) if self.ids else np.empty(0, np.int64)
        n = len(ids) + self.nulls
        doc = pa.concat_arrays([pa.array(ids), pa.nulls(self.nulls, pa.int64())])
        sha = hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).hexdigest()
        same = lambda x, kind: pa.repeat(pa.scalar(x, kind), n)
        first = np.zeros(n, bool)
        first[0] = True
        edge = pa.array([None if part is None else self.text] + [None] * (n - 1), pa.string())
        keep = int(ids[0]) if len(ids) else None
        return pa.RecordBatch.from_arrays(
            [doc, same(keep, pa.int64()), same(n, pa.int64()), pa.array(first), same(sha, pa.string()), same(part, pa.int64()), same(number, pa.int64()), edge],
            ["doc_id", "keep_id", "group_size", "first", "text_sha256", "part", "run", "edge_text"],
        )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of a sorted range. Those that share head and hash with its first or last row may go on elsewhere: they get the range's number."""
    part, place, group, count, first_place = TaskContext.get().partitionId(), None, [], 0, None

    def done(edge: bool):
        nonlocal count
        for run in group:
            yield run.rows(part if edge else None, count)
            count += 1

    def joined(out: list[pa.RecordBatch]):
        return pa.Table.from_batches(out).combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, texts, heads, hashes = (batch.column(k) for k in range(4))
        change = pc.not_equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(texts)]])
        out = []
        for a, b in zip(starts.tolist(), starts[1:].tolist()):
            text, here = texts[a].as_py(), (heads[a].as_py(), hashes[a].as_py())
            if here != place:
                out += done(place == first_place)
                place, group = here, []
                first_place = here if first_place is None else first_place
            if not group or group[-1].text != text:
                group.append(_Run(text))
            some = ids.slice(a, b - a)
            group[-1].nulls += some.null_count
            if some.null_count < len(some):
                group[-1].ids.append(some.drop_null().to_numpy())
        if out:
            yield from joined(out)
    if group:
        yield from joined(list(done(True)))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each document."""
    has(docs, "doc_id", "text")
    rows = written(in_arrow(in_order(docs), _neighbours, _RUNS), "content-runs")
    edges = rows.where("edge_text IS NOT NULL")
    least = F.min(F.struct(F.col("keep_id").isNull().alias("none"), F.col("keep_id").alias("id"), F.col("part").alias("at"), F.col("run").alias("nth"))).alias("least")
    whole = edges.groupBy("edge_text").agg(least, F.sum("group_size").alias("size"))
    mended = written(edges.select("part", "run", "edge_text").join(whole, "edge_text").select("part", "run", "least", "size"), "content-edges")
    stays = F.col("first") & (F.col("least.at") == F.col("part")) & (F.col("least.nth") == F.col("run"))
    at_edges = rows.where("part IS NOT NULL").join(mended, ["part", "run"]).select("doc_id", F.col("least.id").alias("keep_id"), F.col("size").alias("group_size"), stays.alias("kept"), "text_sha256")
    return rows.where("part IS NULL").select("doc_id", "keep_id", "group_size", F.col("first").alias("kept"), "text_sha256").unionByName(at_edges)


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    stay = written(exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")), "content-kept")
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_sha": F.sha2(normalised(), 256)})
    same = keyed["_id"].eqNullSafe(stay["_id"]) & (keyed["_sha"] == stay["_sha"])
    return keyed.join(stay, same, "left_semi").groupBy("_id", "_sha").agg(F.first(F.struct(*docs.columns)).alias("_row")).select("_row.*")
