"""Rules, walks, chains and vetoes on small made tables."""

import pytest

from cairn.operators import graph as G, rules as R
from cairn.operators.session import checkpoints

FACT = "tenant_id string, subject_id string, predicate string, object_id string, matter_id string, epistemic_class string, confidence double, review_state string, superseded_at timestamp, assertion_id string, document_id string"


def fact(i, s, p, o, matter=None, cls="EXTRACTED_MODEL", conf=0.9, state="APPROVED", doc=None):
    return ("t", s, p, o, matter, cls, conf, state, None, i, doc)


def table(spark, rows):
    checkpoints(spark)
    return spark.createDataFrame(rows, FACT)


RULE = {r.rule_id: r for r in R.RULES}


def conclusions(df):
    return {(r.subject_id, r.predicate, r.object_id): (list(r.premises), round(r.confidence, 6), r.matter_id) for r in df.collect()}


def test_conflict_through_affiliates(spark):
    rows = [fact("1", "counsel:a", "REPRESENTS", "party:n", "M-1"), fact("2", "party:n", "AFFILIATE_OF", "party:h", "M-1", conf=0.8), fact("3", "party:h", "AFFILIATE_OF", "party:c", "M-1"), fact("4", "matter:x", "ADVERSE_TO", "party:c", "M-1")]
    got = conclusions(R.infer([RULE["conflict_via_affiliate"]], table(spark, rows)))
    assert got == {("matter:x", "POTENTIAL_CONFLICT", "party:n"): (["1", "2", "3", "4"], round(0.8 * 0.95**2, 6), "M-1")}
    assert not conclusions(R.infer([RULE["conflict_check"]], table(spark, rows)))


@pytest.mark.parametrize("change", [{"state": "PENDING"}, {"state": "REJECTED"}, {"cls": "PREDICTED"}, {"cls": "INFERRED"}])
def test_untrusted_premises_do_not_count(spark, change):
    rows = [fact("1", "counsel:a", "REPRESENTS", "party:n"), fact("2", "matter:x", "ADVERSE_TO", "party:n", **change)]
    assert not conclusions(R.infer([RULE["conflict_check"]], table(spark, rows)))


def test_shortest_proof_and_shared_matter(spark):
    rows = [fact("1", "case:c", "INVESTIGATES", "customer:1", "M-1"), fact("2", "customer:1", "CONTROLS", "merchant:m", "M-2"), fact("3", "customer:1", "CONTROLS", "customer:2"), fact("4", "customer:2", "CONTROLS", "merchant:m")]
    got = conclusions(R.infer([RULE["related_party_resale"]], table(spark, rows)))
    assert got[("case:c", "RELATED_PARTY_RESALE", "merchant:m")] == (["1", "2"], round(0.9 * 0.95, 6), None)


def test_three_hops_at_most_and_no_cycles(spark):
    ladder = [fact(str(k), f"customer:{k}", "CONTROLS", f"customer:{k + 1}") for k in range(1, 4)] + [fact("9", "customer:4", "CONTROLS", "merchant:m"), fact("8", "customer:2", "CONTROLS", "customer:1")]
    for start, n in ((1, 0), (2, 1)):
        rows = [*ladder, fact("c", "case:c", "INVESTIGATES", f"customer:{start}")]
        assert len(conclusions(R.infer([RULE["related_party_resale"]], table(spark, rows)))) == n


def test_a_fact_is_no_two_premises(spark):
    rule = R.Rule("twice", (R.Premise("a", "KNOWS", "b"), R.Premise("a", "KNOWS", "c")), R.Premise("b", "MET", "c"))
    assert not conclusions(R.infer([rule], table(spark, [fact("1", "p:1", "KNOWS", "p:2")])))


def test_report_names_the_starved_premise(spark):
    rows = table(spark, [fact("1", "counsel:a", "REPRESENTS", "party:n"), fact("2", "matter:x", "ADVERSE_TO", "party:z")])
    got = {r.premise: (r.candidates, r.bindings, r.starved) for r in R.report([RULE["conflict_check"]], rows).collect()}
    assert got == {1: (1, 1, False), 2: (1, 0, True)}


P = R.Premise
RANDOM = [
    R.Rule("path_between", (P("c", "A", "q"), P("q", "B", "p", "n", "n", 3), P("m", "C", "p")), P("m", "Z", "q")),
    R.Rule("path_back", (P("d", "A", "c"), P("x", "B", "c", None, "n", 3)), P("d", "Z", "x")),
    R.Rule("path_first", (P("x", "B", "y", "n", "n", 2), P("y", "C", "z")), P("x", "Z", "z")),
    R.Rule("shared", (P("x", "B", "y"), P("y", "B", "z", "n", None, 3)), P("x", "Z", "z")),
    R.Rule("triangle", (P("f", "A", "b"), P("g", "B", "f"), P("g", "C", "b")), P("f", "Z", "b")),
    R.Rule("loop", (P("f", "A", "b"), P("b", "C", "b")), P("f", "Z", "b")),
]


def random_facts(n=140, nodes=11, seed=4):
    import random

    r = random.Random(seed)
    node = lambda: f"{r.choice('nnk')}:{r.randrange(nodes)}"
    return [fact(f"{k * 37 % 1000:03d}", node(), r.choice("ABBC"), node(), r.choice([None, "M-1", "M-2"]), conf=round(r.uniform(0.5, 1), 2)) for k in range(n)]


def proved(df):
    return sorted((r.rule_id, r.subject_id, r.object_id, list(r.premises), round(r.confidence, 9), r.matter_id or "") for r in df.collect())


def every_proof(rules, facts):
    """The best of all proofs, from the bindings with every walk."""
    out = []
    for rule in rules:
        best = {}
        for r in R.bindings(rule, facts)[-1].collect():
            key = (r[rule.conclusion.subject], r[rule.conclusion.object])
            ids = [u.id for u in r.used]
            matters = {u.matter for u in r.used}
            row = (len(ids), ids, round(min(u.confidence for u in r.used) * 0.95 ** (1 + len(ids) - len(rule.premises)), 9), matters.pop() or "" if len(matters) == 1 else "")
            best[key] = min(best.get(key, row), row)
        out += [(rule.rule_id, s, o, ids, c, m) for (s, o), (_, ids, c, m) in best.items()]
    return sorted(out)


def test_directed_walks_find_the_best_proof(spark):
    facts = table(spark, [*random_facts(), fact("998", "n:1", "A", "n:2"), fact("999", "n:2", "C", "n:2")])
    want = every_proof(RANDOM, facts)
    assert proved(R.infer(RANDOM, facts)) == want and {w[0] for w in want} == {r.rule_id for r in RANDOM}


def test_new_facts_and_old_ones_prove_the_same(spark):
    """In three arrivals: what new facts prove, beside what was proved before, is what all facts so far prove."""
    rows, rules = random_facts(100, 9, 8), [RANDOM[0], RANDOM[3]]
    old, said = [], None
    for k in range(3):
        new = rows[k::3]
        old += new
        found = spark.createDataFrame(R.infer(rules, table(spark, old), table(spark, new)).collect(), "rule_id string, subject_id string, predicate string, object_id string, premises array<string>, confidence double, matter_id string")
        said = found if said is None else R.best_proofs(said.unionByName(found))
    assert proved(said) == every_proof(rules, table(spark, old))


def test_a_dense_graph_is_walked_from_the_bound_ends(spark):
    """Three hops at a fan-out of 50 from two cases: 37 million walks, and at most one row for a start and an end."""
    rows = [fact(f"{a:03d}-{k:02d}", f"customer:{a}", "CONTROLS", f"{'merchant' if k == 7 else 'customer'}:{(a * 13 + k * 7 + 1) % 300}") for a in range(300) for k in range(50)]
    facts = table(spark, rows + [fact("i1", "case:1", "INVESTIGATES", "customer:5"), fact("i2", "case:2", "INVESTIGATES", "customer:9")])
    rule = RULE["related_party_resale"]
    edges, starts = R._edges(facts, "CONTROLS"), spark.createDataFrame([("customer:5",), ("customer:9",)], "s string")
    assert all(x.count() <= 2 * 600 for x in R.reach(edges, starts, 3))
    assert R.infer([rule], facts).count() > 100


def test_a_variable_of_one_premise_multiplies_no_proofs(spark):
    """Forty counsels of each party: the affiliates are joined with one row a party, and the first counsel's fact is in the proof."""
    rows = [fact(f"r{q}-{k:02d}", f"counsel:{k}", "REPRESENTS", f"party:{q}") for q in range(3) for k in range(40)]
    rows += [fact(f"a{q}", f"party:{q}", "AFFILIATE_OF", f"party:{q + 1}") for q in range(3)] + [fact(f"v{k}", f"matter:{k}", "ADVERSE_TO", "party:3") for k in range(5)]
    rule, facts = RULE["conflict_via_affiliate"], table(spark, rows)
    assert R.proofs(rule, facts).count() == 3 * 5
    assert R.proofs(rule, facts, facts.where("predicate = 'REPRESENTS'")).count() == 3 * 5
    assert proved(R.infer([rule], facts)) == every_proof([rule], facts)


@pytest.mark.parametrize("listed", [2, 64])
def test_conclusions_are_compared_where_their_proofs_are_made(spark, monkeypatch, listed):
    """Matters come to the parties' tasks as lists, and no conclusion is shuffled, from all facts and from new ones."""
    monkeypatch.setattr(R, "LISTED", listed)
    rows = [fact(f"r{q}-{k}", f"counsel:{k}", "REPRESENTS", f"party:{q}") for q in range(4) for k in range(3)]
    rows += [fact(f"a{q}-{k}", f"party:{q}", "AFFILIATE_OF", f"party:{(q + k) % 9}") for q in range(9) for k in (1, 2, 4)]
    rows += [fact(f"v{p}-{k}", f"matter:{(p * k) % 11}", "ADVERSE_TO", f"party:{p}", f"M-{k % 2}", conf=0.8 + k / 100) for p in range(9) for k in range(7)]
    rule, facts = RULE["conflict_via_affiliate"], table(spark, rows)
    late = facts.where("assertion_id LIKE 'v%3' OR assertion_id LIKE 'a3%' OR assertion_id LIKE 'r1%'")
    found, more = R.infer([rule], facts), R.infer([rule], facts, late)
    for df in (found, more):
        assert "hashpartitioning(subject_id" not in df._jdf.queryExecution().executedPlan().toString()
    assert proved(found) == every_proof([rule], facts)
    before = R.infer([rule], R._others(facts, late))
    assert proved(R.best_proofs(before.unionByName(more))) == proved(found)


def test_a_new_counsel_who_is_not_the_first_repeats_no_conclusion(spark):
    rows = [fact("1", "counsel:a", "REPRESENTS", "party:n"), fact("2", "party:n", "AFFILIATE_OF", "party:h"), fact("3", "matter:x", "ADVERSE_TO", "party:h"), fact("5", "counsel:b", "REPRESENTS", "party:n")]
    rule, facts = RULE["conflict_via_affiliate"], table(spark, rows)
    assert not conclusions(R.infer([rule], facts, facts.where("assertion_id = '5'")))
    first = table(spark, [*rows, fact("0", "counsel:c", "REPRESENTS", "party:n")])
    assert [r.premises for r in R.infer([rule], first, first.where("assertion_id = '0'")).collect()] == [["0", "2", "3"]]


def test_one_conclusion_of_two_rules_is_one_fact(spark):
    """Whatever the order of the rules: the proof of fewest facts stands, then the first by premises."""
    rows = [fact("5", "counsel:a", "REPRESENTS", "party:n"), fact("6", "matter:x", "ADVERSE_TO", "party:n"), fact("1", "party:n", "AFFILIATE_OF", "party:c"), fact("2", "matter:x", "ADVERSE_TO", "party:c")]
    facts = table(spark, rows)
    two = [RULE["conflict_check"], RULE["conflict_via_affiliate"]]
    for rules in (two, two[::-1]):
        got = R.infer_and_stage(rules, facts, facts.limit(0)).collect()
        assert [(r.rule_id, r.premises) for r in got] == [("conflict_check", ["5", "6"])]


def test_conclusions_of_a_stream(spark, tmp_path):
    """Facts wait until they are signed off, count once, and meet facts of earlier arrivals; a batch that is run again adds nothing."""
    from cairn.streaming import ingest as I

    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [[fact("1", "counsel:a", "REPRESENTS", "party:n", state="PENDING")], [fact("2", "matter:x", "ADVERSE_TO", "party:n")], [fact("1", "counsel:a", "REPRESENTS", "party:n"), fact("2", "matter:x", "ADVERSE_TO", "party:n")], [fact("3", "matter:y", "ADVERSE_TO", "party:n")]]
    seen = []
    for rows in parts:
        table(spark, rows).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(FACT).parquet(inbox)
        I.infer_on_arrival(stream, [RULE["conflict_check"]], out, str(tmp_path / "check")).awaitTermination()
        folders = I._folders(spark, f"{out}/conclusions")
        seen.append(sorted(r.subject_id for r in I.conclusions(spark, out).collect()) if folders else [])
    assert seen == [[], [], ["matter:x"], ["matter:x", "matter:y"]]
    # the new rows of the last batch hold nothing that was proved before
    assert [r.subject_id for r in spark.read.parquet(f"{out}/conclusions/batch-3").collect()] == ["matter:y"]


def test_keys_are_read_by_prefix(spark, tmp_path):
    from cairn.streaming import ingest as I

    keys = I.Keys(str(tmp_path / "keys"), "k")
    rows = spark.createDataFrame([(f"key{i}",) for i in range(40)], "k string")
    assert keys.without_known(rows, 0).count() == 40
    keys.add(rows, 0)
    keys.add(rows, 0)
    assert keys.without_known(rows, 0).count() == 40 and keys.without_known(rows.limit(5).union(spark.createDataFrame([("new",)], "k string")), 1).collect()[0].k == "new"
    one = rows.limit(1)
    asked = [r.prefix for r in one.select(I._prefix("k")).collect()]
    read = keys.of_prefixes(spark, asked, 1)
    assert len(read.inputFiles()) == 1 and {r.prefix for r in read.collect()} == set(asked)


def test_state_of_a_stream_is_bounded(spark, tmp_path):
    """Windows that the watermark has passed leave the state; what was written of them stays."""
    from cairn.streaming import ingest as I

    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "document_id long, created_at timestamp, seq long, state string"
    rows = []
    for day in range(1, 9):
        new = [(d, f"2024-01-{day:02d} 0{h}:00:00", day * 10 + d, s) for d, h, s in ((1, 1, "PARSING"), (2, 2, "LIVE" if day == 1 else "FETCHING"), (3, 3, "CHUNKING"))]
        rows += new
        spark.createDataFrame(new, "document_id long, created_at string, seq long, state string").selectExpr("document_id", "CAST(created_at AS timestamp) AS created_at", "seq", "state").coalesce(1).write.mode("append").parquet(inbox)
        q = I.keep_states(spark.readStream.schema(schema).parquet(inbox), out, str(tmp_path / "check"), delay="1 day")
        q.awaitTermination()
    held = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert held <= 3 * 3
    assert {(r.document_id, r.state) for r in I.states(spark, out).collect()} == {(1, "PARSING"), (2, "LIVE"), (3, "CHUNKING")}


def test_rule_faults():
    declared = {p.predicate: p.hops > 1 for r in R.RULES for p in r.premises} | {r.conclusion.predicate: False for r in R.RULES}
    declared |= {p.predicate: True for r in R.RULES for p in r.premises if p.hops > 1}
    assert all(R.faults(r, declared) == [] for r in R.RULES)
    bad = R.Rule("bad", (R.Premise("a", "CITES", "b", hops=5), R.Premise("c", "NOPE", "d")), R.Premise("a", "CITES", "z", hops=2))
    said = " ".join(R.faults(bad, declared))
    assert all(x in said for x in ("share no variables", "not bound", "is a path", "not declared", "not transitive", "walks 5 hops"))
    assert "two premises" in R.faults(R.Rule("one", (R.Premise("a", "CITES", "b"),), R.Premise("a", "CITES", "b")), declared)[0]


def test_vocabulary_faults(spark):
    rows = [("A", ["x"], ["y"], True, False, None, None), ("B", ["x"], ["y"], False, True, "left", "shout"), ("C", ["x"], ["q"], False, False, "both", "notify")]
    v = spark.createDataFrame(rows, "predicate string, domain array<string>, range array<string>, symmetric boolean, transitive boolean, blocks string, effect string")
    kinds = spark.createDataFrame([("x",), ("y",)], "kind string")
    assert {tuple(r) for r in R.vocabulary_faults(v, kinds).collect()} == {("A", "symmetric ends"), ("B", "blocks"), ("B", "effect"), ("B", "transitive ends"), ("C", "unknown kind q")}


def test_chain_of_three(spark):
    rows = [fact("1", "customer:c", "PLACED_ORDER", "order:o"), fact("2", "return:r", "RETURN_OF", "order:o"), fact("3", "associate:a", "APPROVED_RETURN", "return:r"), fact("4", "document:d", "MENTIONS", "order:o")]
    got = G.chains(table(spark, rows)).collect()
    assert [(r.length, r.assertion_ids) for r in got] == [(3, ["1", "2", "3"])]


@pytest.mark.parametrize(("nodes", "edges", "cap"), [(9, 30, 2), (30, 45, 1), (14, 25, 12)])
def test_chains_against_all_paths(spark, nodes, edges, cap):
    """Also where a full neighbourhood knows a step from one side only. Paths aren't shuffled to be told apart."""
    import random

    r = random.Random(nodes)
    facts = table(spark, [fact(f"{k * 7 % 1000:03d}", f"n:{r.randrange(nodes)}", "KNOWS", f"n:{r.randrange(nodes)}", conf=r.choice([0.5, 0.7, 0.9])) for k in range(edges)])
    subject, step = {x.assertion_id: x.subject_id for x in facts.collect()}, {}
    for x in sorted(G.adjacency(facts, cap).collect(), key=lambda x: (-x.confidence, x.assertion_id)):
        step.setdefault((x.node, x.other), (x.assertion_id, x.confidence))
    paths, every = [k for k in step if k[0] != k[1]], {}
    for _ in range(3):
        paths = [(*p, b) for p in paths for a, b in step if a == p[-1] and b not in p]
        for p in sorted(paths):
            every.setdefault(min(p, p[::-1]), p)
    pieces = {min(q, q[::-1]) for p in every for n in range(3, len(p)) for k in range(len(p) - n + 1) for q in [p[k : k + n]]}
    want = set()
    for key, p in every.items():
        if key not in pieces:
            ids = tuple(step[x][0] for x in zip(p, p[1:], strict=False))
            turned, weakest = tuple(subject[i] != n for i, n in zip(ids, p, strict=False)), min(step[x][1] for x in zip(p, p[1:], strict=False))
            want.add((p[::-1], ids[::-1], tuple(not t for t in turned[::-1]), len(ids), weakest) if ids[::-1] < ids else (p, ids, turned, len(ids), weakest))
    df = G.chains(facts, cap=cap, kept=None)
    got = [(tuple(x.nodes), tuple(x.assertion_ids), tuple(x.reversed), x.length, x.weakest) for x in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5
    assert "hashpartitioning(key" not in df._jdf.queryExecution().executedPlan().toString()


def test_expand_goes_through_documents(spark):
    rows = [fact("1", "a:1", "P", "b:1", doc="d1"), fact("2", "b:1", "P", "c:1"), fact("3", "x:1", "P", "y:1", doc="d9")]
    t = table(spark, rows)
    hops = lambda seed, depth: {r.assertion_id: r.hop for r in G.expand(t, spark.createDataFrame([(seed,)], "node string"), depth).collect()}
    assert hops("document:d1", 1) == {"1": 1} and hops("d1", 2) == {"1": 1, "2": 2} and hops("a:1", 4) == {"1": 1, "2": 2} and hops("nobody", 2) == {}


def test_a_walk_joins_no_facts_by_id(spark, monkeypatch):
    """Each fact once by its nearest node, with its own columns; by broadcast no fact is shuffled, and never by its id."""
    from cairn.operators import session

    facts = table(spark, [fact(str(k), f"n:{k}", "KNOWS", f"n:{k + 1}", conf=k / 10) for k in range(8)] + [fact("x", "n:3", "KNOWS", "n:0", conf=0.1)])
    seeds = spark.createDataFrame([("n:0",), (None,)], "node string")
    for limit, shuffled in ((1000, False), (0, True)):
        monkeypatch.setattr(session, "SENT", limit)
        df = G.expand(facts, seeds, 3, False, more=("confidence",))
        assert sorted(map(tuple, df.collect())) == [("0", 0.0, 1), ("1", 0.1, 2), ("2", 0.2, 2), ("3", 0.3, 2), ("4", 0.4, 3), ("x", 0.1, 1)]
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(assertion_id" not in plan and (shuffled or "hashpartitioning(" not in plan)


def test_parallel_edges_are_one_path(spark):
    rows = [fact("1", "a:1", "KNOWS", "b:1", conf=0.7), fact("2", "b:1", "OWNS", "a:1", conf=0.9), fact("3", "b:1", "KNOWS", "c:1", conf=0.8)]
    got = G.chains(table(spark, rows)).collect()
    assert [(r.nodes, r.assertion_ids, r.reversed, r.weakest) for r in got] == [(["a:1", "b:1", "c:1"], ["2", "3"], [True, False], 0.8)]


def test_catalog_is_told_by_its_ends(spark):
    rows = [fact("1", "table:s:db.orders", "DESCRIBED_AS", "description:order rows"), fact("2", "order:7", "PLACED_BY", "customer:orders-inc"), fact("3", "synonym:turnover", "NAMES", "column:s:db.orders.total")]
    t = table(spark, rows)
    q = spark.createDataFrame([(1, ["order"]), (2, ["turnover"])], "question_id int, terms array<string>")
    assert {(r.question_id, r.assertion_id) for r in G.search(t, q).collect()} == {(1, "2")}
    assert {(r.question_id, r.node) for r in G.catalog_search(t, q).collect()} == {(1, "table:s:db.orders"), (1, "column:s:db.orders.total"), (2, "column:s:db.orders.total")}


def test_search_by_index(spark):
    """Against plain containment: words, phrases, terms of any length, repeated, empty and null ones, one question or many."""
    words = ["acme", "acme-union", "ion", "un", "or", "orders", "rder", "zz", "a1b2", "1b"]
    rows = [fact(str(k), f"party:{words[k % 10]}", "PLACED_ORDER" if k % 2 else "KNOWS", f"order:{words[(k * 3 + 1) % 10]}") for k in range(40)]
    hay = {r[9]: f"{r[1][6:]} {r[3][6:]} {r[2]}".replace("-", " ").replace("_", " ").lower() for r in rows}
    terms = [*words, "union ion", "n k", " ", "", "placed order", "e", "acme union or", "no such phrase", "ion un", None]
    index = G.search_index(table(spark, rows))
    for n in (1, 100):
        q = [(k, [terms[k % 20], terms[(k * 7 + 3) % 20], terms[k % 20]]) for k in range(n)]
        want = sorted((k, i, tuple(t for t in ts if t is not None and t in h)) for k, ts in q for i, h in hay.items() if any(t is not None and t in h for t in ts))
        got = sorted((r.question_id, r.assertion_id, tuple(r.matched)) for r in G.search(index, spark.createDataFrame(q, "question_id int, terms array<string>")).collect())
        assert got == want and got


def test_search_reads_the_facts_in_place(spark, monkeypatch):
    """Against plain containment, in one block of questions and in several; nothing is stored, and no fact is shuffled."""
    words = ["acme", "acme-union", "ion", "un", "or", "orders", "rder", "zz", "a1b2", "1b"]
    rows = [fact(str(k), f"party:{words[k % 10]}", "PLACED_ORDER" if k % 2 else "KNOWS", f"order:{words[(k * 3 + 1) % 10]}") for k in range(40)]
    hay = {r[9]: f"{r[1][6:]} {r[3][6:]} {r[2]}".replace("-", " ").replace("_", " ").lower() for r in rows}
    terms = [*words, "union ion", "n k", " ", "", "placed order", "e", "acme union or", "no such phrase", "ion un", None]
    facts = table(spark, rows)
    monkeypatch.setattr(G, "stored", None)
    for n, block in ((1, 100), (60, 100), (60, 7)):
        monkeypatch.setattr(G, "ASKED", block)
        q = [(k, [terms[k % 20], terms[(k * 7 + 3) % 20], terms[k % 20]]) for k in range(n)]
        found = G.search(facts, spark.createDataFrame(q, "question_id int, terms array<string>"))
        assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        want = sorted((k, i, tuple(t for t in ts if t is not None and t in h)) for k, ts in q for i, h in hay.items() if any(t is not None and t in h for t in ts))
        assert sorted((r.question_id, r.assertion_id, tuple(r.matched)) for r in found.collect()) == want and want
        each = spark.createDataFrame([(t,) for t in set(terms)], "term string")
        got = sorted((r.assertion_id, r.term) for r in G.containing(G.worded(facts), each).collect())
        assert got == sorted((i, t) for i, h in hay.items() for t in set(terms) if t is not None and t in h)
    assert G.search(facts, spark.createDataFrame([(1, [None]), (2, [])], "question_id int, terms array<string>")).count() == 0


def test_few_hits_are_ranked(spark):
    """The k best of many hits, with ties, odd confidences and ids: a bound drops most hits before they are sorted."""
    import random

    r = random.Random(3)
    rows = [(q, f"{r.choice(['', 'é', 'ab'])}{r.randrange(10**6):x}-{k}", ["t"] * r.choice([1, 1, 1, 2]), r.choice([1.0, 1.0, 0.5, 0.0, -1.0, 7.0, None])) for q in range(3) for k in range((9, 400, 3000)[q])]
    hits = spark.createDataFrame(rows, "question_id int, assertion_id string, matched array<string>, confidence double")
    first = lambda q: sorted((x for x in rows if x[0] == q), key=lambda x: (-len(x[2]), -(-99 if x[3] is None else x[3]), x[1].encode()))[:25]
    got = G.top_hits(hits, 25)
    assert {(x.question_id, x.assertion_id, x.rank) for x in got.collect()} == {(q, x[1], k + 1) for q in range(3) for k, x in enumerate(first(q))}
    assert "coarse" in got._jdf.queryExecution().optimizedPlan().toString()


def test_pieces_that_end_like_no_term_are_not_made(spark):
    rows = G.worded(table(spark, [fact("1", "customer:12345", "PLACED_ORDER", "order:1290")])).select("hay")
    asked = spark.createDataFrame([("123",), ("1295",), ("345 1",)], "term string")
    assert {r.term for r in G._pieces_of(rows, G._tried(asked)).collect()} == {"123", "345 1"}


def test_rows_with_a_term_of_many_questions_are_dealt(spark):
    """All of them in one file's partition: several tasks answer the questions."""
    facts = table(spark, [fact(str(k), f"case:{k}", "INVESTIGATES", f"party:{k * 7}") for k in range(64)]).coalesce(1)
    found = G.search(facts, spark.createDataFrame([(k, ["investigates", f"{k} "]) for k in range(G.SHARED + 1)], "question_id int, terms array<string>"))
    assert found.count() == 64 * (G.SHARED + 1)
    assert len({r.task for r in found.where("size(matched) = 1").selectExpr("spark_partition_id() AS task").distinct().collect()}) > 4


@pytest.mark.parametrize("seed", range(3))
def test_best_hits_without_all_hits(spark, monkeypatch, seed):
    """Against all hits in order: terms that most questions share, repeated, empty and null ones, and questions that share several. Hits of all questions are not made."""
    import random

    r = random.Random(seed)
    words = ["acme", "union", "ion", "un", "or", "placed", "12", "123", "23", "3", "", None, "none such"]
    rows = [fact(f"{r.randrange(10**6):06x}-{k}", f"party:{r.choice(words[:6])}-{r.randrange(999)}", r.choice(["PLACED_ORDER", "KNOWS"]), f"order:{r.randrange(99999)}", conf=r.choice([0.7, 0.9, 1.0])) for k in range(300)]
    hay = {x[9]: f"{x[1][6:]} {x[3][6:]} {x[2]}".replace("-", " ").replace("_", " ").lower() for x in rows}
    conf = {x.assertion_id: x.confidence for x in table(spark, rows).collect()}
    shared = (["acme"], ["placed", "or"], [])[seed]
    asked = {n: shared + [r.choice(words) for _ in range(r.randrange(4))] for n in range(40)} | {40: [], 41: [None]}
    questions = spark.createDataFrame(list(asked.items()), "question_id int, terms array<string>")
    want = set()
    for n, terms in asked.items():
        hits = [(i, [t for t in terms if t is not None and t in h]) for i, h in hay.items()]
        ordered = sorted(((i, m) for i, m in hits if m), key=lambda x: (-len(x[1]), -conf[x[0]], x[0]))
        want |= {(n, i, tuple(m), k + 1) for k, (i, m) in enumerate(ordered[:5])}
    monkeypatch.setattr(G, "search", None)
    for block in (7, 1000):
        monkeypatch.setattr(G, "ASKED", block)
        got = G.best_hits(table(spark, rows), questions, 5)
        assert {(x.question_id, x.assertion_id, tuple(x.matched), x.rank) for x in got.collect()} == want and want


def test_walks_by_broadcast_and_by_shuffle_agree(spark, monkeypatch):
    """The same hops whether nodes are sent to every task or facts are shuffled by their ends."""
    from cairn.operators import session

    rows = [fact(str(k), f"n:{k * 5 % 23}", "P", f"n:{k * 7 % 31}", doc=f"d{k % 9}" if k % 3 else None) for k in range(60)]
    seeds = spark.createDataFrame([("n:5",), ("document:d4",), ("d7",)], "node string")
    got = []
    for limit in (1000, 0):
        monkeypatch.setattr(session, "SENT", limit)
        for by_document in (True, False):
            got.append(sorted((r.assertion_id, r.hop) for r in G.expand(table(spark, rows), seeds, 3, by_document).collect()))
    assert got[:2] == got[2:] and len(set(got[0])) == len(got[0]) > 20


@pytest.mark.parametrize(("nodes", "edges", "first"), [(9, 30, 2), (40, 60, 4), (6, 5, 64), (30, 12, 64)])
def test_top_chains_are_the_first_of_all(spark, nodes, edges, first):
    import random

    r = random.Random(nodes)
    rows = [fact(f"{k * 7 % 1000:03d}", f"n:{r.randrange(nodes)}", "KNOWS", f"n:{r.randrange(nodes)}", conf=r.choice([0.5, 0.7, 0.9, 0.95])) for k in range(edges)]
    facts = table(spark, rows)
    every = [tuple(x) for x in G.chains(facts, kept=12).collect()]
    got = [tuple(x)[:-1] for x in G.top_chains(facts, first=first).collect()]
    assert got == every and (edges < 20 or got)


def test_ties_of_top_chains_are_not_all_built(spark):
    """A thousand stars joined in a ring, all steps equally firm: the first chains by id come without the rest, also beside few firmer ones."""
    rows = [fact(f"{(k * 37) % 5003:05d}", f"hub:{k % 400}", "KNOWS", f"leaf:{k}") for k in range(1600)]
    rows += [fact(f"{(k * 37) % 5003:05d}", f"hub:{k - 1600}", "KNOWS", f"hub:{(k - 1599) % 400}") for k in range(1600, 2000)]
    firm = [fact(f"z{k}", f"far:{k}", "KNOWS", f"far:{k + 1}", conf=0.99) for k in range(6)]
    for some in (rows, rows + firm):
        every = G.chains(table(spark, some), kept=None)
        want = [tuple(x) for x in G.chains(table(spark, some)).collect()]
        got = G.top_chains(table(spark, some), first=16).collect()
        assert [tuple(x)[:-1] for x in got] == want
        assert got[0].built < every.count() / 4


def test_a_small_vocabulary_is_broadcast(spark, monkeypatch):
    """Facts are not shuffled by predicate, and only the vocabulary's predicates are read; a larger vocabulary is left to the optimizer."""
    from cairn.operators import session

    facts = table(spark, [fact(str(k), f"a:{k}", "KNOWS" if k % 2 else "MET", f"b:{k}") for k in range(50)])
    effects = spark.createDataFrame([("KNOWS", "object", "notify")], "predicate string, blocks string, effect string")
    found = G.findings(facts, effects)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(predicate" not in plan(found) and "BroadcastHashJoin" in plan(found)
    monkeypatch.setattr(session, "VOCABULARY", 0)
    assert sorted(map(tuple, G.findings(facts, effects).collect())) == sorted(map(tuple, found.collect())) and found.count() == 25


def test_an_unknown_method_outranks_nobody(spark):
    from cairn.operators import catalog as C

    columns = spark.createDataFrame([("c",), ("d",)], "node_id string")
    said = spark.createDataFrame([("c", "crowd:x", 0.1, "by a crowd", "APPROVED"), ("c", "human", 0.9, "by a person", "APPROVED"), ("d", "crowd:x", 0.1, "by a crowd", "APPROVED")], "node_id string, method string, confidence double, description string, review_state string")
    assert {r.node_id: r.description for r in C.overlaid(columns, said).collect()} == {"c": "by a person", "d": "by a crowd"}


def test_screen(spark):
    """Seeds are cleared or flagged, rows withheld by any of their four keys, screens named with reason and contact, a failed check clears nothing."""
    facts = table(spark, [fact("1", "case:1", "INVESTIGATES", "party:a"), fact("2", "memo:1", "WARNS_OF", "party:b", conf=0.6), fact("3", "memo:2", "WARNS_OF", "party:c", conf=0.9)])
    effects = spark.createDataFrame([("INVESTIGATES", "object", "withhold"), ("WARNS_OF", "object", "notify")], "predicate string, blocks string, effect string")
    found = G.findings(facts, effects)
    assert [r.tainted for r in G.in_order(found).collect()] == ["party:a", "party:c", "party:b"]
    seeds = spark.createDataFrame([(1, "party:a"), (1, "party:b"), (1, "party:z"), (2, "party:z")], "question_id int, node string")
    screens = spark.createDataFrame([("M-9", None, "ann@x.org")], "matter_id string, reason string, contact string")
    rows = spark.createDataFrame([(1, "r1", "party:a", "x:1", None), (1, "r2", "x:1", "party:a", None), (1, "r3", "x:1", "party:b", None), (1, "r4", "x:1", "x:2", "M-9"), (2, "r5", "party:a", "x:1", None), (2, "r6", "x:1", "x:2", "M-9")], "question_id int, row_id string, subject_id string, object_id string, matter_id string")
    blocks = G.blocks_for(seeds, found, screens)
    assert {(r.question_id, r.subject, r.rule, r.contact, r.effect) for r in blocks.collect()} == {(1, "M-9", "ethical_screen", "ann@x.org", "withhold"), (2, "M-9", "ethical_screen", "ann@x.org", "withhold"), (1, "party:a", "INVESTIGATES", None, "withhold"), (1, "party:b", "WARNS_OF", None, "notify")}
    assert {r.row_id for r in G.kept_rows(rows, blocks).collect()} == {"r3", "r5"}
    report = lambda why=None: {r.question_id: tuple(r)[1:] for r in G.screen_report(seeds, rows, blocks, why).collect()}
    assert report() == {1: (3, 1, 2, 3, None), 2: (1, 1, 0, 1, None)} and report("no graph") == {1: (3, 0, 2, 3, "no graph"), 2: (1, 0, 0, 1, "no graph")}
    assert {r.assertion_id for r in G.touched(facts, spark.createDataFrame([("a",), ("memo:2",)], "node string")).collect()} == {"1", "3"}


def test_proof_tree_keeps_gaps(spark):
    d = spark.createDataFrame([("r", ["a", "b"]), ("a", ["c"]), ("b", ["d"])], "assertion_id string, premises array<string>")
    seen = spark.createDataFrame([("r",), ("a",), ("c",)], "assertion_id string")
    got = {(r.assertion_id, r.level, r.visible) for r in G.proof_tree(d, d.where("assertion_id = 'r'"), visible=seen).collect()}
    assert got == {("r", 0, True), ("a", 1, True), ("b", 1, False), ("c", 2, True)}


def test_facts_of_some_predicates_are_those_of_the_table(spark, sf):
    """Tables that make no fact of the predicates are not read."""
    from cairn.sources import derived

    whole, some = derived.facts(spark, sf), derived.facts(spark, sf, predicates=("CONTROLS", "INVESTIGATES"))
    want = sorted(map(tuple, whole.where("predicate IN ('CONTROLS', 'INVESTIGATES')").select(*some.columns).collect()), key=repr)
    assert sorted(map(tuple, some.collect()), key=repr) == want and want
    plan = derived.made(spark, sf).where("predicate IN ('CONTROLS', 'INVESTIGATES')")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan and "o_orderkey" not in plan


def test_touched_facts_by_broadcast_and_by_shuffle_agree(spark, monkeypatch):
    from cairn.operators import session

    rows = [fact(str(k), f"n:{k % 11}", "P", f"n:{k % 7}", matter=f"M-{k % 5}" if k % 2 else None, doc=f"d{k % 9}" if k % 3 else None) for k in range(60)]
    seeds, got = spark.createDataFrame([("3",), ("n:5",), ("document:d4",), ("matter:M-3",), ("",), ("3",)], "node string"), []
    for limit in (1000, 0):
        monkeypatch.setattr(session, "SENT", limit)
        found = G.touched(table(spark, rows), seeds)
        assert limit == 0 or "hashpartitioning(assertion_id" not in found._jdf.queryExecution().executedPlan().toString()
        got.append(sorted(map(tuple, found.collect()), key=repr))
    assert got[0] == got[1] and 20 < len(got[0]) < 60


def test_hits_are_counted_without_a_sort(spark):
    """Ids that begin alike, short and missing ones: the least of each term is the true one, and no hit is sorted or shuffled as it is."""
    rows = [(f"aaaaaaaaaa{k % 7}{k}" if k % 3 else f"é{k}", f"word {k % 5} x") for k in range(60)] + [("aa", "word 1 x"), ("", "word 2 x"), (None, "only here"), (None, "word 3 x")]
    facts = spark.createDataFrame(rows, "assertion_id string, hay string")
    terms = spark.createDataFrame([(w,) for w in ("word", "1", "d 2", "3 x", "only", "4", "none")], "term string")
    hits = G.containing(facts, terms).collect()
    want = {w: (sum(h.term == w for h in hits), min((h.assertion_id for h in hits if h.term == w and h.assertion_id is not None), default=None, key=lambda s: s.encode())) for w in {h.term for h in hits}}
    ran, write = [], G.stored
    G.stored = lambda df, what, *by: (ran.append(df._jdf.queryExecution().executedPlan().toString()), write(df, what, *by))[1]
    try:
        got = G.counted(facts, terms)
    finally:
        G.stored = write
    assert {r.term: (r.facts, r["first"]) for r in got.collect()} == want and want["only"] == (1, None) and want["d 2"][1] == ""
    assert "HashAggregate" in ran[0] and "SortAggregate" not in ran[0]


def test_many_terms_are_counted_in_one_pass(spark, monkeypatch):
    """More terms than a broadcast takes: short, empty, repeated and missing ones, and rows that hold a term twice."""
    rows = [(f"{k * 7919 % 1000:03d}", f"{k} {k % 7} supplied by {k * 3}") for k in range(80)] + [("5", ""), ("6", None), (None, "ab ab"), ("é", "é ab é")]
    words = ["", " ", "b", "ab", "é", "7 s", "supplied by 12", "by", "zz", None, *[f"{k} s" for k in range(30)]]
    facts, terms = spark.createDataFrame(rows, "assertion_id string, hay string"), spark.createDataFrame([(w,) for w in words], "term string")
    want = {}
    for w in words:
        ids = [i for i, hay in rows if w is not None and hay is not None and w in hay]
        if ids:
            want[w] = (len(ids), min((i for i in ids if i is not None), default=None, key=lambda s: s.encode()))
    few = {r.term: (r.facts, r["first"]) for r in G.counted(facts, terms).collect()}
    monkeypatch.setattr(G, "ASKED", 3)
    monkeypatch.setattr(G, "containing", None)  # no pass for each block
    assert {r.term: (r.facts, r["first"]) for r in G.counted(facts, terms).collect()} == few == want and len(want) > 10


def test_terms_are_passed_over_once_for_as_many_as_are_sent(spark, monkeypatch):
    """The size of a block of questions makes no more passes for their terms; several blocks of terms find the same."""
    facts, terms = spark.createDataFrame([(str(k), f"{k} {k % 7} by {k * 3}") for k in range(50)], "assertion_id string, hay string"), spark.createDataFrame([(f"{k} b",) for k in range(30)], "term string")
    found, passes = G._found, []
    monkeypatch.setattr(G, "_found", lambda rows, asked: (passes.append(1), found(rows, asked))[1])
    monkeypatch.setattr(G, "ASKED", 3)
    got = []
    for sent, most in ((1000, 1), (9, 5)):
        monkeypatch.setattr(G, "SENT", sent)
        passes.clear()
        got.append(sorted(tuple(r) for r in G.containing(facts, terms).select("assertion_id", "term").collect()))
        assert 1 <= len(passes) <= most
    assert got[0] == got[1] == sorted((str(k), f"{j} b") for k in range(50) for j in range(30) if f"{j} b" in f"{k} {k % 7} by {k * 3}")


def test_chains_of_an_answer_shuffle_no_fact_for_the_walk(spark):
    facts = table(spark, [fact(str(k), f"n:{k}", "KNOWS", f"n:{k + 1}", doc="d0" if k < 4 else None) for k in range(9)])
    v = spark.createDataFrame([(0, [1.0, 0.0], "d0", None), (1, [0.0, 1.0], "d1", None)], "vec_id long, embedding array<double>, document_id string, matter_id string")
    walked, found = G.vector_first_answer(facts, v, v.where("vec_id = 0"), k=1)
    assert {r.assertion_id for r in walked.collect()} == {"0", "1", "2", "3"} and [r.assertion_ids for r in found.collect()] == [["0", "1", "2", "3"]]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = G.vector_first_answer(facts, v, v.where("vec_id = 0"), k=1)[1]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin [assertion_id" in plan and "LeftSemi, BuildRight" in plan


def test_chains_and_documents_without_a_cap(spark):
    """A hub of twenty neighbours joins any two of them; an answer has all of its sixty source documents."""
    facts = table(spark, [fact(f"{k:02d}", "n:hub", "KNOWS", f"n:{k}", doc="d0") for k in range(20)])
    pairs = {(f"{a:02d}", f"{b:02d}") for a in range(20) for b in range(a + 1, 20)}
    assert {tuple(r.assertion_ids) for r in G.chains(facts, cap=None, kept=None).collect()} == pairs and G.adjacency(facts, None).count() == 40
    assert "Window" not in G.adjacency(facts, None)._jdf.queryExecution().executedPlan().toString()
    v = spark.createDataFrame([(0, [1.0, 0.0], "d0", None)], "vec_id long, embedding array<double>, document_id string, matter_id string")
    assert G.vector_first_answer(facts, v, v, k=1, kept=None, cap=None)[1].count() == len(pairs)
    many = table(spark, [fact(f"{k:02d}", "n:hub", "KNOWS", f"n:{k}", doc=f"d{k:02d}") for k in range(60)])
    question = spark.createDataFrame([(1, ["hub"])], "question_id int, terms array<string>")
    assert G.graph_first(many, question)[1].count() == 50
    assert {r.document_id for r in G.graph_first(many, question, documents=None)[1].collect()} == {f"d{k:02d}" for k in range(60)}
    v = spark.createDataFrame([(k, [60.0 - k, float(k)], f"d{k:02d}", None) for k in range(60)], "vec_id long, embedding array<double>, document_id string, matter_id string")
    asked, catalog = v.where("vec_id = 59"), facts.limit(0)
    near = lambda **more: [r.id for r in G.graph_first_answer(many, question, v, asked, catalog, k=1, **more).where("part = 'passage'").collect()]
    assert near() == ["49"] and near(documents=None) == ["59"]
