"""Operators with fitted models: held-out accuracy, planted cases, brute-force versions of their exact parts."""

import numpy as np
import pytest
from helpers import PROSE, clashing, empty_docs, odd_docs
from pyspark.sql import functions as F

from cairn.llm import decontaminate, licenses, mixing, queries, secrets, toxicity
from cairn.llm.common import table

LABELS = "doc_id long, quality int, toxic int"


def made(spark, n=600):
    """Two languages; every sixth text is toxic by one of a few words."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        words = list(rng.choice(["ma", "lo", "ti", "re", "su", "ka"] if i % 2 else ["stein", "burg", "feld", "wald", "bach"], 60))
        words = [a + b for a, b in zip(words, rng.permutation(words), strict=True)]
        if bad:
            for k in rng.integers(0, 60, 4):
                words[k] = str(rng.choice(["vilecur", "rotscum", "vilepig"]))
        rows.append((i, " ".join(words), "en" if i % 2 else "de", f"s{i % 3}", 0))
        labels.append((i, int(i % 5 > 0), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, LABELS)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = made(spark)
    chain = toxicity.fit(docs, labels.where("doc_id % 2 = 0 OR doc_id % 3 = 0"))
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    held = [i for i in got if i % 2 and i % 3]
    assert not any(got[i].toxic for i in held)
    assert all(got[i].toxic == (i % 6 == 0) for i in got)
    again = toxicity.fit(docs, labels.where("doc_id < 300"))
    wrong = sum(r.toxic != (r.doc_id % 6 == 0) for r in toxicity.score(docs.where("doc_id >= 300"), again).collect())
    assert wrong <= 3
    kept = toxicity.without_toxic(docs, chain)
    assert kept.schema == docs.schema and kept.where("doc_id % 6 = 0").count() == 0 and kept.count() == 500


def test_chain_feeds_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    x = [sorted(set(rng.integers(0, 30, 6).tolist())) for _ in range(400)]
    y0 = np.array([3 in r for r in x], float)
    labels = np.column_stack([y0, y0 * np.array([5 in r for r in x])])
    weights = toxicity.train_chain(x, labels, np.ones(400), np.arange(400) % toxicity.FOLDS, 30)
    assert [len(w) for w in weights] == [31, 32] and weights[1][30] > 0.5  # the second model uses the first one's probability
    p = toxicity.Chain(["a", "b"], {}, weights).score(x)
    assert ((p[:, 0] >= 0.5) == (y0 > 0)).mean() > 0.98


def test_toxicity_odd_rows(spark):
    docs, labels = made(spark, 120)
    chain = toxicity.fit(docs, labels)
    assert len(toxicity.score(clashing(odd_docs(spark)), chain).collect()) == 10
    assert toxicity.score(empty_docs(spark), chain).count() == 0
    blank = toxicity.fit(empty_docs(spark), spark.createDataFrame([(None, None, None), (1, None, None)], LABELS))
    assert not any(r.toxic for r in toxicity.score(odd_docs(spark), blank).collect())
    assert toxicity.without_toxic(clashing(odd_docs(spark)), blank).count() == 10


@pytest.fixture(scope="module")
def leaks(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return docs, items, decontaminate.searchers(docs, items)


def test_decontamination_finds_what_the_text_holds(spark, leaks):
    docs, items, found = leaks
    got = {r.doc_id: set(r.item_ids) for r in decontaminate.contamination(docs, found).collect()}
    words = {r.item_id: b" ".join(decontaminate.words_of(r.text)) for r in items.collect()}
    for r in docs.collect():
        text = b" " + b" ".join(decontaminate.words_of(r.text or "")) + b" "
        held = {i for i, w in words.items() if b" " + w + b" " in text}
        assert held <= got[r.doc_id]
        assert bool(held) == bool(got[r.doc_id])


def test_decontamination_paraphrases(spark, leaks):
    _, items, (found,) = leaks
    texts, want = [], []
    for r in items.collect()[:12]:
        w = r.text.split()
        lead = PROSE.split() * 2
        texts.append(" ".join(lead + [x for k, x in enumerate(w) if k % 8] + lead))  # an eighth left out
        want.append(True)
        texts.append(" ".join(lead + w[: len(w) // 3] + lead))  # a third alone
        want.append(False)
        texts.append(" ".join(w).upper().replace(" ", ", "))
        want.append(True)
    got = [bool(h) for h in found.search(texts)]
    assert got == want


def test_latent_space_has_half_the_rank_and_loses_no_item(spark, leaks):
    found = leaks[2][0]
    q = found.basis.rows[np.unique(found.basis.at[found.basis.at >= 0])]
    assert len(found.latent) / 2 <= q.shape[1] < len(found.latent)
    assert np.allclose(q.T @ q, np.eye(q.shape[1]), atol=1e-3)
    assert np.allclose(np.linalg.norm(found.latent, axis=1), 1, atol=1e-2)
    assert found.kept.min() ** 2 >= decontaminate.KEEP - 1e-3 and np.median(found.kept) < 0.99


def test_an_item_unlike_all_others_stays_in_the_latent_space():
    weight = np.ones(decontaminate.BUCKETS, np.float32)
    alike = [[b"a", b"b", b"c%d" % k] for k in range(9)]
    made = decontaminate._made(list(range(10)), [*alike, [b"x", b"y", b"z"]], weight)
    assert made["rows"].shape[1] < 10 and made["kept"].min() ** 2 >= decontaminate.KEEP - 1e-3
    found = decontaminate.Searchers._load(type("Loaded", (), {"weight": weight, "cosine": decontaminate.COSINE})(), made)
    assert [set(h) for h in found.search(["x y z", "lorem ipsum " * 6 + "X, y z. " + "dolor sit " * 6, "lorem ipsum"])] == [{9}, {9}, set()]


def test_latent_cosine_joins_words_that_no_item_shares():
    """``lorry`` and ``truck`` stand beside the same words: an item with one is near to a text with the other, which TF-IDF calls unlike."""
    weight = np.ones(decontaminate.BUCKETS, np.float32)
    items = [[b"lorry", b"road"], [b"truck", b"road"], [b"bread", b"oven"], [b"roll", b"oven"]]
    made = decontaminate._made(list(range(4)), items, weight)
    found = decontaminate.Searchers._load(type("Loaded", (), {"weight": weight, "cosine": decontaminate.COSINE})(), made)
    _, _, near, _ = found.candidates([[b"truck"]])
    assert sorted(near.tolist()) == [0, 1]
    assert made["rows"].shape[1] == 2


def test_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.choice([b"a", b"b", b"c"], rng.integers(1, 12)).tolist() for _ in range(2))
        table_ = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table_[i + 1, j + 1] = table_[i, j] + 1 if x == y else max(table_[i, j + 1], table_[i + 1, j])
        assert decontaminate.common_subsequence(a, b) == table_[-1, -1]


def test_items_in_several_blocks(spark, leaks):
    docs, items, found = leaks
    split = decontaminate.searchers(docs, items, block_items=7)
    assert len(split) > 3
    rows = lambda f: sorted((r.doc_id, tuple(r.item_ids), r.contaminated) for r in decontaminate.contamination(docs, f).collect())
    assert rows(split) == rows(found)
    assert decontaminate.without_leaks(docs, split).count() == decontaminate.without_leaks(docs, found).count()


def test_decontamination_odd_rows(spark, leaks):
    found = leaks[2]
    assert not any(r.contaminated for r in decontaminate.contamination(clashing(odd_docs(spark)), found).collect())
    assert decontaminate.contamination(empty_docs(spark), found).count() == 0
    items = "item_id long, text string"
    nothing = decontaminate.searchers(odd_docs(spark), spark.createDataFrame([], items))
    assert decontaminate.without_leaks(clashing(odd_docs(spark)), nothing).count() == 10
    nulls = decontaminate.searchers(odd_docs(spark), spark.createDataFrame([(None, PROSE), (1, None), (2, PROSE)], items))
    rows = decontaminate.contamination(odd_docs(spark), nulls).collect()
    assert sorted(r.doc_id for r in rows if r.contaminated) == [5, 6, 6, 7] and all(r.item_ids == [None, 2] for r in rows if r.contaminated)
    nobody = decontaminate.searchers(empty_docs(spark), spark.createDataFrame([(1, PROSE)], items))
    assert decontaminate.contamination(empty_docs(spark), nobody).count() == 0


def test_mixing_reaches_its_targets(spark):
    docs, labels = made(spark)
    shares = {"de/good": 0.3, "en/good": 0.7}
    rates, mix = mixing.mixed_rates(docs, labels.where("doc_id < 400").withColumn("quality", F.lit(1)), shares)
    for d, t in mix.target.items():
        assert abs(mix.reached[d] - t) <= 0.01 * sum(mix.target.values())
    rows = rates.collect()
    assert len(rows) == 600 and all(r.rate >= 0 for r in rows)
    right = sum(r.domain[:2] == ("en" if r.doc_id % 2 else "de") for r in rows)
    assert right >= 590  # the language of held-out rows too


def test_mixing_is_the_least_squares_fit():
    """Against plain projected gradient steps on the same objective, all rates in one array."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4] * 4, 300)
    n = rng.integers(1, 500, 300).astype(float)
    mass = n @ p
    target = mass * np.array([0.2, 1.5, 0.6, 1.0])
    history = []
    r = np.ones(300)
    for _ in range(400):
        g = ((n * r) @ p - target) / mass
        history.append(g)
        r = np.maximum(0, r - p @ g)
    assert np.abs((n * r) @ p - target).max() < 1e-3 * mass.max() and (r >= 0).all()
    assert np.allclose(mixing.replay(p, history, (0.0, np.inf)), r)


def test_resampling_keeps_rows_and_columns(spark):
    docs, labels = made(spark, 200)
    domains = mixing.fit_domains(docs, labels)
    mix = mixing.fit_mix(mixing.posteriors(docs, domains).cache(), domains, grow=True, min_rate=1.0)
    out = mixing.resampled(docs, mix)
    assert out.schema == docs.schema and out.select("doc_id").distinct().count() == 200 and out.count() >= 200
    rates, _ = mixing.mixed_rates(docs, labels, grow=True, min_rate=1.0)
    assert {(r.doc_id, r.copies) for r in rates.collect()} == {(r.doc_id, r["count"]) for r in out.groupBy("doc_id").count().collect()}


def test_mixing_odd_rows(spark):
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], LABELS)
    rates, _ = mixing.mixed_rates(clashing(odd_docs(spark)), none)
    assert rates.count() == 10
    rates, _ = mixing.mixed_rates(clashing(odd_docs(spark)), spark.createDataFrame([(5, 1, 0), (5, 0, 0), (8, 0, 0), (1, 1, 1)], LABELS))
    assert rates.count() == 10
    rates, _ = mixing.mixed_rates(empty_docs(spark), none)
    assert rates.count() == 0


def test_secrets(spark):
    rng = np.random.default_rng(9)
    rows, want = [], set()
    for i in range(300):
        key = "".join(rng.choice(list("0123456789abcdef"), 40))
        if i % 3 == 0:
            rows.append((i, f'some words token = "{key}" and more'))
            want.add(i)
        else:
            rows.append((i, f"some {'wordsandwordsandmore' if i % 3 == 1 else '1234567890123456'} and more"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = secrets.findings(docs).collect()
    assert {r.doc_id for r in got if r.is_secret} == want and len(got) == 300
    text = dict(rows)
    assert all(text[r.doc_id][r.start : r.end] == r.value for r in got)
    labelled = secrets.candidates(docs).select("value", "before", "after", F.col("value").rlike("^[0-9]+$").cast("int").alias("label"))
    told = secrets.findings(docs, labelled).collect()
    assert {r.doc_id for r in told if r.is_secret} == {i for i in range(300) if i % 3 == 2}


def test_secrets_odd_rows(spark):
    assert secrets.findings(empty_docs(spark)).count() == 0
    assert secrets.findings(clashing(odd_docs(spark))).count() == 0
    one = spark.createDataFrame([(None, 'password: "abc123abc123abc123abc"'), (1, 'password: "abc123abc123abc123abc"'), (1, 'password: "abc123abc123abc123abc"')], "doc_id long, text string")
    assert [r.is_secret for r in secrets.findings(one).collect()] == [True] * 3


def test_licenses(spark):
    notices = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    rows = [(k, PROSE + "\n" + v) for k, v in enumerate(notices.values())] + [(10 + k, PROSE.strip() * 9 + ". " + v) for k, v in enumerate(notices.values())]
    rows += [(20, "He got a driving license in May and lost it in June, with no warranty at all."), (21, licenses.TEMPLATES["MIT"].replace("free of charge", "for a small fee"))]
    got = {r.doc_id: r for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k].license for k in got if k < 20} == dict(list(enumerate(notices)) + [(10 + k, n) for k, n in enumerate(notices)])
    assert 20 not in got and got[21].license == "MIT" and "+fee" in got[21].differences and "-charge" in got[21].differences
    assert all(dict(rows)[k][r.start : r.end].endswith(list(notices.values())[k % 10]) for k, r in got.items() if k < 20)
    assert licenses.licenses(empty_docs(spark)).count() == 0 and licenses.licenses(clashing(odd_docs(spark))).count() == 0


def test_registered_queries_run(spark, sf):
    for name in ("op4_secrets", "op7_mixing", "op8_toxicity", "op9_decontamination", "op10_licenses"):
        assert queries.QUERIES[name](spark, sf).count() > 0


def test_decontamination_finds_verbatim_copies_of_many_items(spark, monkeypatch):
    """Three thousand invented items, short and long, each planted whole inside another text: none is lost."""
    rng = np.random.default_rng(12)
    word = lambda k: "".join(chr(97 + (k // 26**j) % 26) for j in range(4))
    prose = lambda n: " ".join(map(word, rng.zipf(1.12, n) % 200_000))
    items = [prose(int(n)) for n in np.concatenate([rng.integers(15, 58, 2950), rng.integers(300, 900, 50)])]
    texts = [prose(int(rng.integers(40, 90))) + " " + t + " " + prose(60) for t in items] + [prose(150) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    found = decontaminate.searchers(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    told = lambda df: {r.doc_id: r for r in decontaminate.contamination(df, found).drop("cosine").collect()}
    one_pass = told(docs)
    assert all(k in one_pass[k].item_ids for k in range(3000)) and len(one_pass) == 3100
    assert not any(one_pass[3000 + k].contaminated for k in range(100))
    monkeypatch.setattr(decontaminate, "GROUP", 5)  # several passes find the same
    assert len(found) > 10
    some = docs.where("doc_id % 10 = 0")
    assert told(some) == {k: r for k, r in one_pass.items() if k % 10 == 0}
    assert decontaminate.without_leaks(some, found).count() == 10


def test_pipeline_mixing_tells_missed_targets(spark, sf, monkeypatch):
    import corpus_pipeline

    fit = mixing.fit_mix
    monkeypatch.setattr(mixing, "fit_mix", lambda *a, **how: fit(*a, smoothing=0.1, **how))
    with pytest.warns(UserWarning, match="off their target"):
        corpus_pipeline.mix_domains(spark, table(spark, sf, "documents"), sf)


def test_licenses_inside_prose_and_beside_each_other():
    fixed = tuple(sorted(licenses.TEMPLATES.items()))
    told = lambda text: [(r[2], text[r[0] : r[1]]) for r in licenses.scan(text, fixed)]
    mit, nc = "Licensed under the MIT license.", "Licensed under CC BY-NC 4.0."
    line = PROSE.strip().capitalize() + ". " + mit + " " + PROSE.strip().capitalize() + "."
    assert len(line) < 2 * licenses.WIDE and told(line) == [("MIT", mit)]
    assert told(nc + "\nReleased under the MIT License.") == [("CC-BY-NC-4.0", nc), ("MIT", "Released under the MIT License.")]
    assert told("Copyright 2024 by the Society of Old Stone Bridges\n" + mit) == [("MIT", mit)]
    for name in ("Apache-2.0", "GPL-3.0"):
        both = licenses.TEMPLATES[name] + "\nReleased under the MIT License."
        assert [n for n, _ in told(both)] == [name, "MIT"]
    assert [n for n, _ in told(licenses.TEMPLATES["MIT"])] == ["MIT"]


def test_version_numbers_and_names_decide():
    fixed = tuple(sorted(licenses.TEMPLATES.items()))
    told = lambda text: [r[2] for r in licenses.scan(text, fixed)]
    gnu = "This work is licensed under the GNU {}General Public License, version {}."
    want = {gnu.format("", "2"): ["GPL-2.0"], gnu.format("", "3"): ["GPL-3.0"], gnu.format("Lesser ", "2.1"): ["LGPL-2.1"], gnu.format("Lesser ", "3"): ["LGPL-3.0"], gnu.format("Affero ", "3"): ["AGPL-3.0"], gnu.format("", "4"): []}
    want |= {"Licensed under CC BY 3.0.": [], "Licensed under CC BY 4.0.": ["CC-BY-4.0"], "Licensed under CC BY-SA 4.0.": ["CC-BY-SA-4.0"], "Licensed under the Apache License, Version 1.1.": [], "Released under the ISC License.": ["ISC"], "Released under the BSD 2-Clause License.": ["BSD-2-Clause"], "Released under the BSD 3-Clause License.": ["BSD-3-Clause"]}
    assert {t: told(t) for t in want} == want
    assert all(told(t) == [n] for n, t in fixed)


def test_licenses_in_clauses_and_identifier_lines():
    fixed = tuple(sorted(licenses.TEMPLATES.items()))
    told = lambda text: [(r[2], text[r[0] : r[1]]) for r in licenses.scan(text, fixed)]
    long = "Our tool, which many people in many countries use at home, {} and hosted online with a forum of its own for everybody."
    for name, wording in (("MIT", "is released under the MIT License"), ("GPL-3.0", "is licensed under the GNU General Public License, version 3"), ("CC-BY-NC-4.0", "is licensed under CC BY-NC 4.0")):
        assert told(long.format(wording)) == [(name, wording.removeprefix("is "))]
    for name in licenses.TEMPLATES:
        assert [n for n, _ in told(f"# SPDX-License-Identifier: {name}\nimport os\n")] == [name]
    for text in ("The license, as they said, and the library of the town, gave permission.", "Without a license, he said, it is no good and the Apache tribe has no license.", "The MIT, where many study, has a license to sell beer."):
        assert told(text) == [], text


def test_license_ranking_by_single_compressions():
    """Every template's saving on parts of every template, against compressions made one by one."""
    import zstandard

    fixed = tuple(sorted(licenses.TEMPLATES.items()))
    how = zstandard.ZstdCompressionParameters.from_level(licenses.LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False)
    size = lambda part, **d: len(zstandard.ZstdCompressor(compression_params=how, **d).compress(part.lower().encode()))
    for _, t in fixed:
        for part in (t, t[: len(t) // 2], t[40:120]):
            plain = size(part)
            want = sorted((size(part, dict_data=zstandard.ZstdCompressionDict(u.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) / plain - 1, n) for n, u in fixed)
            assert licenses.ranking(part, fixed) == [(-x, n) for x, n in want]


def test_secret_features_by_plain_python(spark, sf):
    import re

    docs = table(spark, sf, "documents")
    pieces = {r.piece for r in secrets.dictionary_pieces(docs).collect()}
    counts = {}
    for r in docs.collect():
        for w in re.findall("[a-z]{4,}", (r.text or "").lower()):
            if len(w) < 16:
                counts[w] = counts.get(w, 0) + 1
    common = [w for w, n in counts.items() if n >= max(2, secrets.COMMON * sum(counts.values()))]
    assert pieces == {w[k : k + 4] for w in common for k in range(len(w) - 3)}
    frame = spark.createDataFrame([(p,) for p in pieces], "piece string")
    rows = secrets.featured(secrets.candidates(docs), frame).collect()
    assert rows
    cover = lambda s: (lambda ps: sum(p in pieces for p in ps) / len(ps) if ps else 0.0)(re.findall("(?=([a-z]{4}))", s.lower()))
    kind = lambda c: 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3
    for r in rows:
        v, far = r.value, r.before[: max(0, len(r.before) - secrets.BESIDE)] + " " + r.after[secrets.BESIDE :]
        assert r.length == len(v) and r.distinct == len(set(v)) / min(len(v), 64)
        assert abs(r.digits - sum(c in "0123456789" for c in v) / len(v)) < 1e-9 and abs(r.vowels - sum(c in "aeiouAEIOU" for c in v) / len(v)) < 1e-9
        assert abs(r.changes - sum(kind(a) != kind(b) and kind(a) < 3 for a, b in zip(v, v[1:], strict=False)) / len(v)) < 1e-9
        assert abs(r.covered - cover(v)) < 1e-9 and abs(r.known_around - cover(far)) < 1e-9


def test_secrets_in_given_texts(spark, sf):
    """Keys planted in the given texts: all found, nothing else is, and the same on documents without labels of their own."""
    rng = np.random.default_rng(2)
    rows, planted = [], set()
    for r in table(spark, sf, "documents").select("doc_id", "text").collect():
        lines = (r.text or "").split("\n")
        middle = len(lines) // 2
        if r.doc_id % 5 == 0:
            key = "".join(rng.choice(list("0123456789abcdef"), 40))
            planted.add((r.doc_id, key))
            lines.insert(middle, f'some words token = "{key}" and more')
        elif r.doc_id % 5 < 3:
            lines.insert(middle, f"some words {rng.integers(10**15, 10**16)} and more")
        rows.append((r.doc_id, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.value) for r in secrets.findings(docs).where("is_secret").collect()}
    assert planted and got == planted
    half = secrets.labelled_by_context(secrets.candidates(docs.where("doc_id % 2 = 0"))).where("label IS NOT NULL")
    held = {(r.doc_id, r.value) for r in secrets.findings(docs, half).where("is_secret AND doc_id % 2 = 1").collect()}
    assert held == {p for p in planted if p[0] % 2}


def test_the_forest_does_not_see_what_labels_go_by(spark):
    """What is next to a value changes its label and none of its features, and a bare key gets a verdict of its own."""
    key, far = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8", "w" * 30
    rows = [(1, f'{far} token  =  "{key}" and so on {far}'), (2, f"{far} the value was {key} and so on  {far}")]
    found = secrets.labelled_by_context(secrets.candidates(spark.createDataFrame(rows, "doc_id long, text string")))
    same = {r.doc_id: r for r in secrets.featured(found, spark.createDataFrame([("wwww",)], "piece string")).where(F.col("value") == key).collect()}
    assert [same[k].label for k in (1, 2)] == [1.0, 0.0]
    assert all(same[1][f] == same[2][f] for f in secrets.FEATURES if f not in ("known_around", "words_around"))


def test_secrets_of_any_shape(spark):
    """Short and marked values count when they are assigned to a name; a run inside one is part of it; open cases get a verdict of their own."""
    rows = [(1, 'password = "hunter2024"'), (2, "db_passwd: Tr0ub4dor&3!x#aaaaaaaaaaaaaaaaaaaa next"), (3, "the token is short"), (4, "secret = abc"), (5, "x" * 40_000)]
    got = {(r.doc_id, r.value) for r in secrets.candidates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "hunter2024"), (2, "Tr0ub4dor&3!x#aaaaaaaaaaaaaaaaaaaa"), (5, "x" * 40_000)}
    odd = secrets.findings(clashing(odd_docs(spark))).collect()
    assert odd == []


def test_mixing_query_in_one_array(spark, sf):
    """The registered query against projected gradient steps over one array of all documents."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    domains = mixing.fit_domains(docs, labels)
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    n, p = domains.posterior([t for _, t in rows])
    mass = n @ p
    want = (mass / mass.sum()) ** mixing.SMOOTHING
    target = want / want.sum() * mass.sum()
    rate = np.ones(len(n))
    for _ in range(mixing.STEPS):
        g = ((n * rate) @ p - target) / mass
        if np.abs(g).max() < mixing.TOLERANCE:
            break
        rate = np.maximum(0, rate - p @ g)
    got = {r.doc_id: r for r in queries.op7_mixing(spark, sf).collect()}
    assert len(got) == len(rows)
    for k, (d, _) in enumerate(rows):
        assert abs(got[d].rate - rate[k]) < 1e-6 and got[d].n_tokens == n[k] and got[d].domain == domains.names[p[k].argmax()]
    assert np.abs((n * rate) @ p - target).max() <= 0.01 * target.max()


def test_toxicity_query_by_plain_sums(spark, sf):
    """The registered query's probabilities from dictionaries and loops; its verdict on labelled rows."""
    import math

    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    chain = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    assert {r.doc_id: r.toxic for r in queries.op8_toxicity(spark, sf).collect()} == {d: r.toxic for d, r in got.items()}
    for r in docs.orderBy("doc_id").limit(60).collect():
        times = {}
        for w in toxicity.plain_words(r.text or ""):
            for f in toxicity.word_features(w):
                if f in chain.known:
                    times[chain.known[f]] = times.get(chain.known[f], 0) + 1
        before = []
        for name, w in zip(chain.names, chain.weights, strict=True):
            z = w[-1] + sum(w[3 * i + k] for i, n in times.items() for k, least in enumerate(toxicity.TIMES) if n >= least) + sum(a * b for a, b in zip(before, w[len(w) - 1 - len(before) : -1], strict=True)) if len(w) else None
            before.append(1 / (1 + math.exp(-z)) if z is not None else 0.0)
            assert abs(getattr(got[r.doc_id], f"p_{name}") - before[-1]) < 1e-9
    told = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in got and r.toxic is not None}
    assert sum(got[d].toxic != bool(t) for d, t in told.items()) <= 0.05 * len(told)


def test_null_labels_are_no_labels(spark):
    docs, labels = made(spark, 600)
    nulls = labels.withColumn("toxic", F.when(F.col("doc_id") % 6 < 5, F.col("toxic")))
    sample, weight = toxicity._sampled(docs, nulls, toxicity.CATEGORIES, 6000)
    assert sample.count() == 500 and sample.where("doc_id % 6 = 5").count() == 0 and weight == [1.0, 1.0]
    got = toxicity.score(docs, toxicity.fit(docs, nulls)).collect()
    assert sum(r.toxic != (r.doc_id % 6 == 0) for r in got) <= 6


def test_searchers_are_loaded_from_their_table(spark, leaks):
    docs, items, _ = leaks
    split = decontaminate.searchers(docs, items, block_items=9)
    assert [s.ids for s in split[1:3]] == [split[1].ids, split[2].ids]
    assert sorted(i for s in split for i in s.ids) == sorted(r.item_id for r in items.collect())
