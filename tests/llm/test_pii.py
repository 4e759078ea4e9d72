"""Personal data: the base findings against Python's regular expressions, disclosing terms on a made corpus."""

import hashlib
import re

import pytest
from helpers import clashing, empty_docs, odd_docs

from cairn.llm import pii, queries
from cairn.llm.common import table

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for i, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), i, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


TRICKY = [
    "a@b.c%d@e.f x@y z@.q p@q..r u@v.w-",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3 9.9.9.9.",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111119999 4111  1111 1111 1111",
    "+1 (415) 555-2671 ++1 415 5552671) +12 +1()()() +44.20.7946.0958- +123456789012345678",
    "\U0001f600 me@x.org \U0001f600 +1 415 555 2671 é 4111111111111111",
    "1" * 5000,
    "a" * 20000 + " b@c.de",
    "4 " * 4000,
    "1.1.1.1@a.bc+14155552671",
    "",
]


def test_base_matches_plain_expressions(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    got = {r.doc_id: r.b for r in pii.with_base(docs).select("doc_id", pii.listed(pii.F.col("base")).alias("b")).collect()}
    for k, t in enumerate(TRICKY):
        assert got[k] == brute(t), t[:80]


@pytest.fixture(scope="module")
def op1(spark, sf):
    return queries.op1_pii(spark, sf).collect()


def test_contract(spark, sf, op1):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    assert len(op1) == len(texts)
    for r in op1:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want.split(",")) for k in BASE]
        assert set(want.split(",")) - {""} <= set(r.spans.split(","))


def test_disclosing_terms(spark):
    plain = [(i, f"common words {i % 7} here and there nothing else {chr(97 + i % 26) * 4}") for i in range(200)]
    told = [(1000 + i, f"letter {'xyz'[i % 3] * 5} from Rumpelstilz whose mail is r@tower.org and more common words {i}") for i in range(8)]
    copies = [(2000 + i, "Unique copied phrase with q@r.st only in copies") for i in range(50)]
    docs = spark.createDataFrame(plain + told + copies, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.findings(docs).collect()}
    kinds = {docs_text[s.start : s.end].lower(): s.kind for d, docs_text in told for s in got[d].spans}
    assert kinds["r@tower.org"] == "email" and kinds["rumpelstilz"] == "removed" and "common" not in kinds and "words" not in kinds
    assert [s.kind for s in got[2000].spans] == ["email"]  # copies are one text
    assert all(not got[d].spans for d, _ in plain)
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "Rumpelstilz" not in clean[1000] and "[email]" in clean[1000] and clean[3] == plain[3][1]


def test_odd_rows(spark):
    got = pii.findings(clashing(odd_docs(spark))).collect()
    assert len(got) == 10 and sum(len(r.spans) for r in got) == 1
    assert pii.findings(empty_docs(spark)).count() == 0


def test_names_beside_rare_addresses(spark):
    """A name beside an address of two texts is found; the words of one text, its copies and its near copies are no evidence."""
    plain = [(i, f"common words {i % 7} here and there nothing else {chr(97 + i % 26) * 4}") for i in range(200)]
    told = [(1000, "a parcel for Rumpelstilz at r@tower.org was common"), (1001, "ask there whether Rumpelstilz (r@tower.org) has words")]
    same = "Unique written phrase with q@r.st in common words " + "here and there nothing else " * 12
    once = [(1002, "only Dornroeschen has d@castle.org"), (1003, same), (1004, same), (1005, same + "tail")]
    docs = spark.createDataFrame(plain + told + once, "doc_id long, text string")
    got = {r.doc_id: [(dict(plain + told + once)[r.doc_id][s.start : s.end], s.kind) for s in r.spans] for r in pii.findings(docs).collect()}
    assert all(got[k] == sorted([("Rumpelstilz", "removed"), ("r@tower.org", "email")]) for k in (1000, 1001))
    assert got[1002] == [("d@castle.org", "email")] and all(got[k] == [("q@r.st", "email")] for k in (1003, 1004, 1005))
    assert "Rumpelstilz" not in " ".join(r.text for r in pii.sanitised(docs).collect())


def brute_entities(kind, value):
    if kind == "email":
        return {f"email:{value.lower()}", f"domain:{value.lower().rsplit('@', 1)[1]}"}
    if kind == "ip":
        return {f"ip:{value}", "net:" + value.rsplit(".", 1)[0]}
    return {kind + ":" + re.sub("[^0-9]", "", value)}


def test_disclosure_against_all_counts(spark):
    """Rules from plain loops over a corpus of copies, rare and repeated addresses: the same terms with the same ratios."""
    import math
    import random

    rng = random.Random(8)
    letters = "abcdefghij"
    word = lambda: "".join(rng.choices(letters, k=3)) + rng.choice(letters) * rng.randint(0, 2)
    names = [f"name{a}{b}" for a in letters for b in letters]
    docs = []
    for i in range(900):
        w = [word() for _ in range(rng.randint(5, 30))]
        if i % 3 == 0:
            k = rng.randrange(60)
            value = f"u{k % 40}@site{k % 7}.org" if k % 2 else f"10.{k % 5}.0.{k}"
            w.insert(rng.randrange(len(w)), f"{names[k].replace('name', 'nm')} {value}")
        docs.append((i, " ".join(w)))
    docs += [(2000 + i, docs[3][1]) for i in range(5)]
    letters_only = lambda t: set(re.findall(r"[^\W\d_]{3,}", t.lower()))
    seen = []  # entity, surroundings
    for _, t in docs:
        found = {}
        for x in filter(None, brute(t).split(",")):
            kind, a, b = x.split(":")[0], *map(int, x.split(":")[1:])
            left, right = t[max(0, a - 150) : a], t[b : b + 150]
            left = re.sub(r"^\S*", "", left) if a > 150 else left
            right = re.sub(r"\S*$", "", right) if len(right) == 150 else right
            for e in brute_entities(kind, t[a:b]):
                found.setdefault(e, frozenset(letters_only(re.sub(r"\S*$", "", left) + " " + re.sub(r"^\S*", "", right))))
        seen += found.items()
    want = {}
    every = [letters_only(t) for _, t in docs]
    for e in {e for e, _ in seen}:
        mine = [s for f, s in seen if f == e]
        n_c, n = len(set(mine)), len(docs) - len(mine) + len(set(mine))
        for t in set().union(*mine):
            n_ct = len({s for s in mine if t in s})
            n_t = sum(t in w for w in every) - sum(t in s for s in mine) + n_ct
            ratio = 1 + math.log(n_ct / (n_t + pii.PRIOR / n_ct**2)) / math.log(n / n_c)
            if ratio >= pii.GENERALISE:
                want[e, t] = round(ratio, 6)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rules, _ = pii.disclosing(frame, pii.base_findings(frame))
    got = {(r.entity, r.term): round(r.ratio, 6) for r in rules.collect()}
    assert got == want and len({r for r in want.values() if r >= pii.REMOVE}) > 0 and len(want) > 20


def test_rare_words_of_a_large_corpus(spark):
    """The same single text discloses nothing among 200 and something among 4000."""
    one = [(9000, "only Dornroeschen has d@castle.org here")]
    few, many = ([(i, f"only common words {i % 7} has here and there") for i in range(n)] for n in (200, 4000))
    spans = lambda rows: [s.value for r in pii.findings(spark.createDataFrame(rows + one, "doc_id long, text string")).where("doc_id = 9000").collect() for s in r.spans]
    assert spans(few) == ["d@castle.org"] and spans(many) == ["Dornroeschen", "d@castle.org"]
