"""Phrases, exact copies and whitened vectors: against SQL, brute force and odd rows."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, PROSE, clashing, empty_docs, odd_docs
from pyspark.sql import functions as F, types as T

from cairn.llm import collocations as C, contentsort, queries, whitening
from cairn.llm.common import table
from cairn.plans.checks import compare


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, sf, name):
    assert compare(spark, name, queries.QUERIES[name], queries.SQL[name], sf) == ""


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def pieces(text):
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or ""))]


def brute_counts(rows, longest=3):
    found = Counter()
    for lang, text in rows:
        for p in pieces(text):
            found[(lang,)] += len(p)
            for k in range(1, longest + 1):
                found.update((lang, *p[i : i + k]) for i in range(len(p) - k + 1))
    return found


def brute_collocations(rows, least, top):
    f = brute_counts([("und" if lang is None else lang, text) for lang, text in rows])
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for p, a in cand.items():
        lang, words = p[0], p[1:]
        if any(q[0] == lang and len(q) > len(p) and 100 * b >= 50 * a and any(q[1 + i : 1 + i + len(words)] == words for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])]))
    return sorted((lang, r, p.decode(), -a, x, y, f[(lang,)], -s) for lang, found in out.items() for r, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1))


ODD = [("en", "The cat, the CAT! the cat the cat\tthe  cat\x1cdog"), (None, "a b c. a b c\x0ba b\x00 c a b c"), ("", "x y x y x y"), ("en", None), ("en", ""), ("de", "éa éa Éa éa." * 5), ("en", "The cat, the CAT! the cat the cat\tthe  cat\x1cdog")]


@pytest.mark.parametrize("least", [1, 2, 4])
def test_collocations_on_odd_rows(spark, least):
    docs = clashing(spark.createDataFrame([(k, t, lang, "a", 0) for k, (lang, t) in enumerate(ODD)], DOCS))
    got = sorted(map(tuple, C.collocations(docs, least=least, top=5).collect()))
    assert got == brute_collocations(ODD, least, 5) and got


def test_collocations_of_nothing(spark):
    assert C.collocations(empty_docs(spark)).count() == 0
    assert C.collocations(odd_docs(spark)).count() > 0


def test_a_hot_pair_lies_in_many_ranges(spark):
    """Half of all words are one pair, with ever other words after it: several splitters begin with it, and its counts are whole."""
    rows = [("en", " ".join(f"hot pair w{i}x{k % 7}" for k in range(40))) for i in range(120)]
    docs = spark.createDataFrame([(k, t, lang, "a", 0) for k, (lang, t) in enumerate(rows)], DOCS)
    cut = C.ranges(docs)
    assert sum(s[:3] == (b"en", b"hot", b"pair") for s in cut.splitters) >= 2
    got = {(r.lang, *(r.phrase.split(" ") if r.phrase else [])): r.n for r in C.phrase_counts(docs).collect()}
    want = brute_counts(rows)
    assert got == {p: n for p, n in want.items() if n >= 10 or len(p) == 1}


def test_words_cut_apart_are_put_together(monkeypatch):
    text = "one two three, four five six seven. " * 9 + "a-single-very-long-word" * 3 + " tail one two"
    whole = C._Held(3)
    whole.add(text)
    want = brute_counts([("", text)])
    for size in (1, 5, 17, 64):
        monkeypatch.setattr(C, "SLICE", size)
        held = C._Held(3)
        held.add(text)
        words, rows, weights = held.suffixes()
        words2, rows2, weights2 = whole.suffixes()
        assert words == words2 and (rows == rows2).all() and (weights == weights2).all()
        for d in (1, 2, 3):
            got = Counter()
            for r, w in zip(rows.tolist(), weights.tolist()):
                if r[d - 1]:
                    got[("", *(words[x].decode() for x in r[:d]))] += w
            assert got == {p: n for p, n in want.items() if len(p) == d + 1}


def test_ranges_and_small_tasks_lose_no_count(monkeypatch):
    """Tasks that send their suffixes on after every few words, and splitters of all kinds, end words included."""
    rng = np.random.default_rng(3)
    rows = [(f"l{rng.integers(3)}", " ".join(rng.choice(["a", "b", "cc", "d.", "é", "f,"], rng.integers(0, 40)))) for _ in range(60)]
    monkeypatch.setattr(C, "HELD", 50)
    splitters = [(b"l0", b"b", b"", b""), (b"l0", b"b", b"cc", b"a"), (b"l1", b"a", b"a", b"a"), (b"l1", b"b", b"b", b"zz"), (b"l1", b"b", b"cc", b""), (b"l2", b"zz", b"", b"")]
    batches = [pa.RecordBatch.from_pylist([{"lang": a, "text": b} for a, b in rows[k : k + 13]]) for k in range(0, 60, 13)]
    blocks = list(C._blocks(iter(batches), 3, splitters))
    got = Counter()
    for part in {p for b in blocks for p in b.column(0).to_pylist()}:
        own = [b for b in blocks if b.column(0)[0].as_py() == part]
        for out in C._counted(iter(own), 3, 4, splitters):
            for lang, words, n in zip(*(out.column(k).to_pylist() for k in range(3))):
                got[(lang, *words)] += n
    want = brute_counts(rows)
    assert {p: n for p, n in got.items() if n >= 4 or len(p) == 1} == {p: n for p, n in want.items() if n >= 4 or len(p) == 1}


def test_equal_parts_are_counts():
    rng = np.random.default_rng(7)
    keys = np.minimum(rng.zipf(1.4, (4, 3000)), 40).astype(np.int32) - 1
    keys[0] += 1
    for d in range(1, 4):
        keys[d] *= keys[d - 1] > 0
    weights = rng.integers(1, 5, 3000)
    want = Counter()
    for col, w in zip(keys.T.tolist(), weights.tolist()):
        for d in range(1, 5):
            if col[d - 1]:
                want[tuple(col[:d])] += w
    for least in (1, 10, 100):
        got = {}
        for d, some, weight in C.equal_parts(keys, weights, least):
            for k, w in zip(keys[:d, some].T.tolist(), weight.tolist()):
                assert tuple(k) not in got
                got[tuple(k)] = w
        assert got == {p: n for p, n in want.items() if n >= least}


def brute_copies(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (d, _), x in zip(rows, norm):
        same = [i for (i, _), y in zip(rows, norm) if x == y]
        ids = [i for i in same if i is not None]
        out.append((d, min(ids, default=None), len(same), hashlib.sha256(x.encode()).hexdigest()))
    return sorted(out, key=str)


def copies_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def check_copies(docs):
    rows = contentsort.exact_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == brute_copies(copies_of(docs))
    kept = [r for r in rows if r.kept]
    assert len({r.text_sha256 for r in rows}) == len(kept) and all(r.doc_id == r.keep_id for r in kept)


def test_copies_of_odd_rows(spark):
    docs = clashing(odd_docs(spark)).withColumn("norm", F.lit("x")).withColumn("part", F.lit(1)).withColumn("hash", F.lit(1))
    check_copies(docs)
    check_copies(docs.unionByName(docs))
    assert contentsort.exact_duplicates(empty_docs(spark)).count() == 0
    stay = contentsort.without_copies(docs)
    assert stay.columns == docs.columns and stay.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in copies_of(docs)})


def test_a_large_group_lies_in_many_ranges(spark):
    """Over half of the rows are one text, some without an id; another long text differs in its last character only."""
    long = PROSE * 50
    rows = [(None if k % 50 == 0 else 7919 * k % 5003, long if k % 3 else (long + ("x" if k % 2 else " \n y")), None, "a", 0) for k in range(2000)] + [(10_000 + k, f"{PROSE}{k % 90}", "en", "b", 0) for k in range(900)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    check_copies(docs)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    try:
        check_copies(docs)
        order = contentsort.in_order(docs).select(F.spark_partition_id().alias("p"), "norm").groupBy("norm").agg(F.countDistinct("p").alias("n"))
        assert order.agg(F.max("n")).first()[0] > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert contentsort.exact_duplicates(docs).where("kept").count() == 3 + 90


def test_copies_are_told_by_the_whole_text(monkeypatch):
    """Texts with the same head and hash are still different ones, and groups of them at the ends of a range are joined by their text."""
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array(["h"] * len(rows)), pa.array([1] * len(rows), pa.int64())], ["doc_id", "norm", "head", "hash"])

    class Task:
        @staticmethod
        def get():
            return type("T", (), {"partitionId": staticmethod(lambda: 4)})

    monkeypatch.setattr(contentsort, "TaskContext", Task)
    out = pa.Table.from_batches(contentsort._neighbours(iter([batch([(1, "a"), (5, "a")]), batch([(None, "a"), (2, "b")]), batch([(9, "b")])]))).to_pylist()
    assert [(r["doc_id"], r["keep_id"], r["group_size"], r["first"], r["part"], r["run"], r["edge_text"]) for r in out] == [(1, 1, 3, True, 4, 0, "a"), (5, 1, 3, False, 4, 0, None), (None, 1, 3, False, 4, 0, None), (2, 2, 2, True, 4, 1, "b"), (9, 2, 2, False, 4, 1, None)]


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute_whitening(rows, most=4):
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) and abs(c) * 256 < 2**53 for c in v)]
    widths = Counter(len(x) for _, x in good)
    width = max(widths, key=lambda w: (widths[w], w), default=0)
    good = [(i, x) for i, x in good if len(x) == width]
    fit = sorted({tuple(x) for _, x in good})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - b) / n for a, b in zip(x, s)] for x in fit]).reshape(n, width)
    v = centred.T @ centred / n if n else np.zeros((0, 0))
    e, u = np.linalg.eigh(v) if n else (np.zeros(0), np.zeros((0, 0)))
    order = [k for k in np.argsort(-e)[:most] if e[k] > e.max() * width * 2.0**-50 and e[k] > 0]
    y = {i: None for i, _ in good}
    return good, n, s, e[order], u[:, order], np.trace(v) if n else 0


def check_whitening(df):
    good, n, s, e, u, trace = brute_whitening([(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()])
    rows = whitening.whitened(df).collect()
    assert len(rows) == len(good) * len(e)
    if not rows:
        return
    dev = Counter((i, sum((n * a - b) ** 2 for a, b in zip(x, s))) for i, x in good)
    assert Counter((r.vec_id, r.deviation) for r in rows if r.component == 1) == dev and all(r.n == n for r in rows)
    got = {(r.vec_id, r.deviation, r.component): r.whitened for r in rows}
    for k in range(len(e)):
        want = np.array([((n * np.array(x) - np.array(s)) / n) @ u[:, k] / math.sqrt(e[k]) for _, x in good])
        have = np.array([got[(i, sum((n * a - b) ** 2 for a, b in zip(x, s)), k + 1)] for i, x in good])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-8 * max(1, np.abs(want).max())
        assert all(abs(r.explained - e[k] / trace) <= 1e-9 for r in rows if r.component == k + 1)
    assert all(r.identity_error < 1e-6 for r in rows)


def test_whitening_of_the_table(spark, sf):
    check_whitening(table(spark, sf, "embeddings"))


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    rows = [(k, [float(c) for c in rng.normal(size=3) * (3, 2, 1)], 0) for k in range(40)]
    rows += [(100, None, 0), (101, [], 0), (102, [1.0, None, 0.5], 0), (103, [1.0, nan, 0.5], 0), (104, [inf, 1.0, 0.5], 0), (105, [1.0, 2.0], 0), (106, [3e30, 1.0, 1.0], None), (107, [-0.0, 0.0, -1e-30], None)]
    rows += [(None, rows[3][1], 0), (3, rows[3][1], 0), *[(200 + k, rows[5][1], 0) for k in range(50)]]
    df = spark.createDataFrame(rows, VECTORS)
    for c in ("x", "at", "y", "n", "component", "k", "_part", "width", "row"):
        df = df.withColumn(c, F.lit("z"))
    check_whitening(df)
    # fewer directions than components, a single vector, and none
    check_whitening(spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0], 0) for k in range(9)], VECTORS))
    for few in ([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, None, 0)], []):
        out = whitening.whitened(spark.createDataFrame(few, VECTORS))
        assert out.count() == 0 and "identity_error" in out.columns


def test_blocks_of_few_rows_and_columns(spark, monkeypatch):
    """Many blocks each way, and a multiplication that is dealt to several tasks."""
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 3)
    rng = np.random.default_rng(8)
    check_whitening(spark.createDataFrame([(k, [float(c) for c in rng.normal(size=8) * np.arange(8, 0, -1)], 0) for k in range(100)], VECTORS))


def test_deviation_past_64_bits_is_null(spark):
    df = spark.createDataFrame([(1, [1e13, 0.0], 0), (2, [-1e13, 0.5], 0), (3, [0.0, 1.0], 0)], VECTORS)
    rows = whitening.whitened(df).collect()
    assert {r.deviation is None for r in rows if r.vec_id < 3} == {True} and len(rows) == 3  # the other direction has no variance beside that one
