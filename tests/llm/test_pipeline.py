"""The pipeline's stages on the given tables and on odd rows, each against a plain version."""

from itertools import combinations

import numpy as np
import pytest
from helpers import PROSE, clashing, empty_docs, odd_docs

import corpus_pipeline as P
from cairn.llm import simhash
from cairn.llm.common import table


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)}


def test_groups_of_similar_texts(spark):
    """Against exact similarities: copies and near copies of a text are one group, other texts stand alone."""
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts, origin = [], []
    for g in range(40):
        base = rng.choice(vocabulary, 200)
        for c in range(1 + g % 4):
            w = base.copy()
            w[rng.integers(0, 200, c)] = rng.choice(vocabulary, c)
            texts.append(" ".join(w))
            origin.append(g)
    docs = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(docs, **simhash.SIMILAR).collect()}
    for i, j in combinations(range(len(texts)), 2):
        a, b = shingles(texts[i]), shingles(texts[j])
        if len(a & b) >= 0.8 * len(a | b):
            assert got[100 - i] == got[100 - j]
        if origin[i] != origin[j]:
            assert got[100 - i] != got[100 - j]
    kept = {r.doc_id for r in simhash.one_of_each(docs, **simhash.SIMILAR).collect()}
    assert kept == set(got.values())


def test_one_of_each_keeps_rows_whole(spark):
    docs = clashing(odd_docs(spark))
    out = simhash.one_of_each(docs, **simhash.SIMILAR)
    assert out.columns == docs.columns
    # texts without words are one group; a text and its thousandfold repetition have the same shingles but other counts
    assert sorted((r.doc_id for r in out.collect() if r.doc_id not in (5, 6)), key=str) == [1, 4, 8, None]
    assert simhash.one_of_each(empty_docs(spark), **simhash.SIMILAR).count() == 0
    twins = spark.createDataFrame([(1, "a b c d e f"), (1, "u v w x y z"), (None, "q w e r t z"), (None, "m n o p q r"), (None, "m n o p q r")], "doc_id long, text string")
    assert simhash.one_of_each(twins, **simhash.SIMILAR).count() == 4


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = table(spark, sf, "documents"), []
    for name, f in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        f(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages(spark, sf, stages):
    docs = table(spark, sf, "documents")
    for before, after in zip([docs, *stages[:-2]], stages[:-1], strict=True):
        assert after.columns == docs.columns
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in stages]
    assert ids[3] == ids[2]  # mixing repeats rows and drops none
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    clean = [d for d, t in labels.items() if not t]
    assert all(d in ids[0] for d in clean)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    kept = [texts[d] for d in ids[1]]
    assert len(set(kept)) == len(kept)  # no exact copies
    items = [" ".join(r.text.split()) for r in table(spark, sf, "benchmark").collect()]
    assert not any(i in " ".join(texts[d].split()) for d in ids[2] for i in items)
    rows = sorted(stages[4].collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in stages[3].select("doc_id").collect())
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


def test_stages_take_odd_rows(spark, sf):
    for docs in (clashing(odd_docs(spark)), empty_docs(spark)):
        for _, f in P.STAGES:
            out = f(spark, docs, sf)
            assert out.count() <= 4 * max(1, docs.count())


def test_stages_on_odd_rows_exactly(spark, sf):
    """Every stage returns rows that it was given, unchanged; which ones is defined."""
    from test_exact import brute_tokens, docs_of

    docs = clashing(odd_docs(spark))
    given = sorted(map(tuple, docs.collect()), key=str)
    stage = {n: f(spark, docs, sf) for n, f in P.STAGES}
    rows = {n: sorted(map(tuple, df.collect()), key=str) for n, df in stage.items()}
    assert all(stage[n].columns == docs.columns and set(rows[n]) <= set(given) for n in list(stage)[:-1])
    assert rows["decontamination"] == given and {r for r in given if not (r[1] or "").strip()} <= set(rows["toxicity"])
    # the texts without words, the two of one sentence and its repetition, and four others: five rows come of no group
    assert sorted((r[0] for r in rows["near_duplicates"] if r[0] not in (5, 6)), key=str) == [1, 4, 8, None] and {5, 6} & {r[0] for r in rows["near_duplicates"]}
    assert set(rows["mixing"]) == set(given) and all(given.count(r) <= rows["mixing"].count(r) <= 4 * given.count(r) for r in given)
    assert sorted(map(tuple, stage["tokens"].select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=str) == brute_tokens(docs_of(docs))
    assert all(f(spark, empty_docs(spark), sf).count() == 0 for _, f in P.STAGES)


def test_recall_by_similarity(spark):
    """Pairs of every similarity: all that are alike in 0.8 of their shingles or more, and no others."""
    rng = np.random.default_rng(16)
    vocabulary = [f"w{i}" for i in range(6000)]
    texts, pairs = [], []
    for k in range(240):
        base = rng.choice(vocabulary, 300)
        near = base.copy()
        near[rng.choice(300, 1 + k % 40, replace=False)] = rng.choice(vocabulary, 1 + k % 40)
        texts += [" ".join(base), " ".join(near)]
        a, b = shingles(texts[-2]), shingles(texts[-1])
        pairs.append(len(a & b) / len(a | b))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(docs, **simhash.SIMILAR).collect()}
    found = [got[2 * k] == got[2 * k + 1] for k in range(240)]
    assert found == [p >= 0.8 for p in pairs] and 30 < sum(found) < 200


def test_links_are_confirmed(spark, monkeypatch):
    """A group that hangs together by links of 0.8 only; texts just below it, which the bits alone would join, stay apart, in buckets cut to blocks as well."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = rng.choice(vocabulary, 120)
    texts = []
    for k in range(60):  # ever further from the first, each near the one before it
        if k % 6 == 0:
            base = rng.choice(vocabulary, 120)
        base = base.copy()
        base[rng.choice(120, 2 + k % 3, replace=False)] = rng.choice(vocabulary, 2 + k % 3)
        texts.append(" ".join(base))
    sets = [shingles(t) for t in texts]
    label = list(range(60))
    for i, j in combinations(range(60), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            label = [label[i] if x == label[j] else x for x in label]
    want = [label.index(x) for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows in (4096, 8):
        monkeypatch.setattr(simhash, "BLOCK_ROWS", rows)
        got = {r.doc_id: r.component_id for r in simhash.similar_texts(docs, **simhash.SIMILAR).collect()}
        assert [got[k] for k in range(60)] == want
    assert 10 < len(set(want)) < 60


@pytest.mark.parametrize("seed", range(6))
def test_groups_meet_by_their_sets(seed):
    """Against all pairs, on shingle hashes of both signs: whatever groups there were, those that a link joins are one."""
    rng = np.random.default_rng(seed)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 60)
    sets, n = [np.empty(0, np.int64), np.empty(0, np.int64)], 40
    for _ in range(n - 2):
        x = base.copy()
        k = rng.integers(1, 14)
        x[rng.choice(60, k, replace=False)] = rng.integers(-(1 << 63), (1 << 63) - 1, k)
        sets.append(np.unique(x))
    label = rng.integers(0, 30, n)
    prints = rng.integers(0, 1 << 10, (n, 4), dtype=np.uint64)

    def joined(links):
        out = label.copy()
        for a, b in links:
            out[out == out[b]] = out[a]
        return [out.tolist().index(x) for x in out.tolist()]

    alike = [(i, j) for i, j in combinations(range(n), 2) if len(both := np.intersect1d(sets[i], sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - len(both))]
    links = simhash._joined(prints, label, sets, 256, 0.8)
    assert joined(links) == joined(alike) and set(map(frozenset, links)) <= set(map(frozenset, alike)) and len(links) < n


def test_shingle_sets_are_sorted(spark):
    rows = simhash.shingle_sets(spark.createDataFrame([(1, PROSE * 3), (2, "")], "text_hash long, text string"), 5).collect()
    assert all(r.shingles == sorted(set(r.shingles)) for r in rows) and min(rows[0].shingles) < 0 < max(rows[0].shingles)


def test_registered(spark, sf):
    assert P.ORACLE_SQL is None and [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]
    assert PROSE and P.run(spark, sf).count() > 0
