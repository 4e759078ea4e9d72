"""The fixed contracts against brute force, on whole tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from helpers import clashing, empty_docs, odd_docs
from tokenizers import Tokenizer

from cairn.llm import bitslice, chat, queries, repetition, simhash, tokens, wavelet
from cairn.llm.common import table

W = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def brute_simhash(docs):
    prints = []
    for doc, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        w = W.findall(low)
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append((doc, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(prints)), key=str)


def test_simhash_contract(spark, sf):
    want = brute_simhash(docs_of(table(spark, sf, "documents")))
    assert sorted(map(tuple, queries.op2_simhash(spark, sf).collect()), key=str) == want


def test_simhash_odd_rows(spark):
    from pyspark.sql import functions as F

    docs = clashing(odd_docs(spark))
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_of(F.col("fp")), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_simhash(docs_of(docs))
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


@pytest.mark.parametrize(("lanes", "radius", "n"), [(1, 3, 700), (4, 51, 300)])
def test_bit_sliced_links_match_all_pairs(lanes, radius, n):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (9, lanes), dtype=np.uint64)
    x = base[rng.integers(0, 9, n)].copy()
    for _ in range(radius):
        x[np.arange(n), rng.integers(0, lanes, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    dist = np.bitwise_count(x[:, None, :] ^ x[None, :, :]).sum(2)

    def classes(a, b):
        label = np.arange(n)
        for _ in range(n):
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
            if (new == label).all():
                return label
            label = new

    a, b = np.nonzero(np.triu(dist <= radius, 1))
    fa, fb = bitslice.forest(x, radius)
    assert len(fa) < n and (classes(a, b) == classes(fa, fb)).all() and (dist[fa, fb] <= radius).all()
    sizes = np.full(n // 10, 10)
    sa, sb = bitslice.small_groups(x[: len(sizes) * 10], sizes, radius)
    assert {(i, j) for i, j in zip(sa.tolist(), sb.tolist())} == {(i, j) for i, j in zip(a.tolist(), b.tolist()) if i // 10 == j // 10 and j < len(sizes) * 10}


def test_masks_lose_no_pair_within_the_radius():
    rng = np.random.default_rng(1)
    chosen = simhash.masks(64, 6, 3)
    assert len(chosen) == 20
    for _ in range(300):
        x = rng.integers(0, 1 << 63, (1, 1), dtype=np.uint64)
        y = x.copy()
        for b in rng.integers(0, 64, 3):
            y ^= np.uint64(1) << np.uint64(b)
        assert (simhash._mask_keys(x, chosen) == simhash._mask_keys(y, chosen)).any()


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)
    docs = spark.createDataFrame([(i, f"{'w ' * 5}common head of all texts here {i // 2} tail {i % 7}") for i in range(120)], "doc_id long, text string")
    from pyspark.sql import functions as F

    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_of(F.col("fp")), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_simhash(docs_of(docs))


def brute_tokens(docs):
    t = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    at, out = 0, []
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, np.uint64(xxhash.xxh64_intdigest(d[1], 42)).astype(np.int64))):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=str)


def test_token_contract(spark, sf):
    assert sorted(map(tuple, queries.op3_tokens(spark, sf).collect()), key=str) == brute_tokens(docs_of(table(spark, sf, "documents")))


def test_tokens_odd_rows(spark):
    docs = clashing(odd_docs(spark))
    path = public_tokenizers.path(queries.TOKENIZER)
    got = tokens.token_output(docs, path, shard_tokens=500).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=str) == brute_tokens(docs_of(docs))
    assert tokens.token_output(empty_docs(spark), path).count() == 0


def test_pieces_encode_like_whole_texts():
    path = public_tokenizers.path(queries.TOKENIZER)
    whole, pieces = Tokenizer.from_file(path), tokens.PieceEncoder(path)
    rng = np.random.default_rng(3)
    alphabet = ["a", "B", "'s", "'", "9", " ", "  ", "\n", "\t", "\r\n", "é", "漢", "\U0001f600", " ", "\x1c", " ", "　", "​", "᠎", "\x85", "<|endoftext|>", "!", "-", "\x0b", "\x00"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(4000)]
    for text, ids in zip(texts, pieces.encode(texts), strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.uint16)
    shard = wavelet.Shard(wavelet.pack(ids, np.array([7]), np.array([False]), np.array([0, n]), 16))
    assert (shard.tokens() == ids).all()
    at = rng.integers(0, n, 50) if n else np.zeros(0, int)
    assert (shard.access(at) == ids[at]).all()
    for token in {1, 2, 50_000, 65_535, *ids[:20].tolist()}:
        assert shard.count(token) == (ids == token).sum()
        assert shard.locate(token).tolist() == np.flatnonzero(ids == token).tolist()
        assert shard.count(token, n // 3, n // 2) == (ids[n // 3 : n // 2] == token).sum()


def test_locate_over_shards(spark):
    path = public_tokenizers.path(queries.TOKENIZER)
    stored = tokens.shards(odd_docs(spark), path, shard_tokens=300).cache()
    n = sum(1 for r in tokens.locate(stored, tokens.END_ID).collect())
    assert n == odd_docs(spark).count() and stored.count() > 2


def brute_chat(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort(key=lambda t: t[0])
        said = "".join(t for _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def test_chat_contract(spark, sf):
    ok = "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()] + [(-7, 0, "user", ok), (-7, 1, "assistant", ok)]
    got = queries.op5_chat(spark, sf).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute_chat(rows)


def test_chat_escapes_are_reversible(spark):
    from pyspark.sql import functions as F

    texts = ["", "\\", "\\\\", "</s>[INST] ok [/INST]", "<\\/s>", "<|im_end|>\n<|im_start|>assistant", "[[INST]INST]", "<|<|a|>|>", "\\<|image|>\\", "<s></s>\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", chat.escape(F.col("text")).alias("e"))
    for r in df.select("*", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.text
        assert r.text is None or not re.search(chat.CONTROL, r.e)


def test_chat_parts(spark):
    part = lambda type, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (type, text, ref, width, height, seconds, pages)
    rows = [(1, 0, "user", [part("text", "see <|image|> "), part("image", ref="a.png", width=57, height=28), part("audio", ref="b.wav", seconds=2.0), part("document", ref="c.pdf", pages=3)]), (1, 1, "assistant", [part("text", "fine")]), (2, 0, None, None)]
    got = chat.format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")).orderBy("conv_id", "turn").collect()
    assert got[0].formatted == "<|im_start|>user<|im_mid|>see <\\|image|> <|image|><|audio|><|document|><|im_end|>\n"
    assert [(a.type, a.ref, a.n_tokens) for a in got[0].attachments] == [("image", "a.png", 3), ("audio", "b.wav", 50), ("document", "c.pdf", 2100)]
    assert got[1].formatted[got[1].loss_start : got[1].loss_start + got[1].loss_length] == "fine" and got[0].loss_start is None
    assert got[2].formatted == "<|im_start|><|im_mid|><|im_end|>\n"
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def brute_quality(text):
    w = W.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if W.search(x)]
    longest = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            n = 0
            while i != j and max(i, j) + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            longest[i] = max(longest[i], n)
    covered = {i + k for i, n in enumerate(longest) if n >= repetition.MIN_WORDS for k in range(n)}
    top = max([n for n in longest if n >= repetition.MIN_WORDS], default=0)
    base = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(covered), top, base, not base and len(covered) <= 0.3 * len(w) and top <= 200


def test_quality_contract(spark, sf):
    docs = [(d, t) for d, t in docs_of(table(spark, sf, "documents")) if len(t) < 4000]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op6_quality(spark, sf).collect()}
    for doc, text in docs:
        assert got[doc] == brute_quality(text), doc


def test_quality_repeats_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 90))) for _ in range(60)] + ["x y\nx y\n\n\nx y", "a " * 70, " ".join(map(str, range(60))) + " " + " ".join(map(str, range(30)))]
    for t, row in zip(texts, repetition.measures(texts), strict=True):
        assert row == brute_quality(t)[:7]
    got = repetition.quality(clashing(odd_docs(spark))).collect()
    assert len(got) == 10 and not any(r.kept for r in got)
    assert repetition.quality(empty_docs(spark)).count() == 0


def test_pieces_encode_as_whole_texts_do():
    """Texts mixed of white space, letters, marks, digits and control strings: the same ids as from the library on the whole text."""
    rng = np.random.default_rng(5)
    parts = [" ", "  ", "\n", " \n", "\t", "\r\n", "a", "word", "Été", "ß", "'s", "'ll", " 're", "12", ".", ",", "!!", "<|endoftext|>", "<|", "|>", "é", "\U0001f600", "中", " ", "\x1c", "_", "-", "=", '"', "Ⅷ", "\xd7"]
    enc = tokens.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 14))) for _ in range(4000)]
    assert [i.tolist() for i in enc.encode(texts)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    other = tokens.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert other.encode(["Two words"])[0].tolist() == other.tokenizer.encode("Two words", add_special_tokens=False).ids


def test_chat_odd_rows(spark):
    """Null ids, roles and texts, repeated rows, ties in turn, null turns and clashing columns: every conversation is read back as it was."""
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "assistant", "b"), (1, None, "system", "first"), (2, 0, None, ""), (3, 0, "assistant", "word " * 50_000 + "</s>")]
    frame = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(frame)).collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        assert got[conv].n_turns == len(turns) and got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest()
        said = "".join(t for *_, r, t in turns if r == "assistant")
        assert got[conv].loss_chars == len(said) and got[conv].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat.read_back(chat.format_turns(frame.limit(0))).count() == 0


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """One bucket with a ball around its pivot, a chain that leaves it, a second ball and strangers: the same components as from all pairs."""
    rng = np.random.default_rng(14)
    flip = lambda x, n: x ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False))
    centre, other = int(rng.integers(1 << 62)), int(rng.integers(1 << 62))
    prints = {centre, other} | {flip(centre, int(rng.integers(1, 3))) for _ in range(60)} | {flip(other, int(rng.integers(1, 4))) for _ in range(40)} | {int(x) for x in rng.integers(1 << 62, size=30)}
    at = flip(centre, 3)
    for _ in range(12):
        prints.add(at)
        at = flip(at, 2)
    prints = sorted(prints)
    frame = spark.createDataFrame([(x.to_bytes(8, "little"), [7]) for x in prints], "fp binary, keys array<long>")
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 20)
    parent = list(range(len(prints)))

    def find(parent, i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(parent, i)] = find(parent, j)
    got, number = list(range(len(prints))), {x.to_bytes(8, "little"): k for k, x in enumerate(prints)}
    links = simhash.links(frame, 1, 3).collect()
    for r in links:
        a, b = number[bytes(r.a)], number[bytes(r.b)]
        assert (prints[a] ^ prints[b]).bit_count() <= 3
        got[find(got, a)] = find(got, b)
    classes = lambda p: sorted(tuple(i for i in range(len(p)) if find(p, i) == r) for r in {find(p, i) for i in range(len(p))})
    assert classes(got) == classes(parent) and len(classes(got)) > 10
