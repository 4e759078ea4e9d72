"""Routing scores, metric matching, table relevance and blank claims against the written rules."""

from pyspark.sql import functions as F

from cairn.operators import documents as D, vectors as V

HITS = "question_id int, layer string, vec_id int, score double"


def test_layers_are_scored_by_their_best_two(spark):
    rows = [(1, "x", 1, 0.9), (1, "x", 2, 0.8), (1, "x", 3, 0.8), (1, "y", 4, 0.2), (1, "z", 5, 0.8), (2, "x", 6, 0.1), (2, "y", 7, 0.2)]
    scores = V.layer_scores(spark.createDataFrame(rows, HITS), boosts={"z": 0.05})
    got = {(r.question_id, r.layer): tuple(r)[2:] for r in scores.collect()}
    assert got[1, "x"] == (0.85, 0.85, 0.0, 3, 1.0, True) and got[1, "z"] == (0.85, 0.8, 0.05, 1, 1.0, True)
    assert got[1, "y"] == (0.0, 0.0, 0.0, 0, 0.0, False) and got[2, "x"] == (0.0, 0.0, 0.0, 0, 0.0, False) and len(got) == 5
    tiers = spark.createDataFrame([("x", 2), ("z", 1), ("y", 2), ("y", 3)], "layer string, tier int")
    run = {(r.question_id, r.tier, r.degraded) for r in V.tiers_to_run(scores, tiers).collect()}
    assert run == {(1, 2, False), (1, 1, False), (2, 1, True), (2, 2, True), (2, 3, True)}


METRICS = [("order_count", "order_count", ["orders"], "how often customers buy"), ("revenue", "revenue", ["net sales"], "money of all orders"), ("sales_tax", "sales_tax", [], "tax on net amounts")]


def test_one_matcher(spark):
    m = spark.createDataFrame(METRICS, "metric_id string, name string, synonyms array<string>, definition string")
    asked = {1: "tell me about orders", 2: "what are the net sales", 3: "count order rows", 4: "what came in", 5: "sales tax and net sales revenue", 6: "of the", 7: "where is it all going", 8: "count order sales net"}
    q = spark.createDataFrame(list(asked.items()), "question_id int, text string")
    words = {r.question_id: (r.metric_id, r.points, r.n_terms) for r in V.match_metrics(q, m).collect()}
    # one word is no intent, however it is spelled; a tie is declined
    assert 1 not in words and words[2] == ("revenue", 4, 2) and words[3] == ("order_count", 4, 2) and words[5] == ("revenue", 8, 3) and set(words) == {2, 3, 5}
    c = spark.createDataFrame([(4, "revenue", 0.7), (4, "gone", 0.9), (7, "revenue", 0.7), (7, "order_count", 0.68), (2, "order_count", 0.99), (6, "revenue", 0.9), (1, "order_count", 0.8), (8, "revenue", 0.99)], "question_id int, metric_id string, score double")
    got = {r.question_id: (r.metric_id, r.selected_by, r.similarity) for r in V.matched_metrics(q, m, c).collect()}
    assert got[2] == ("revenue", "keyword", None) and got[4] == ("revenue", "router", 0.7) and got[1] == ("order_count", "router", 0.8) and not {6, 7, 8} & set(got)
    assert set(words) == {k for k, v in got.items() if v[1] == "keyword"}


def test_claims_without_evidence_are_dropped(spark):
    rows = [(1, "a b c", "", "mentions"), (2, "a b c", "  ", "mentions"), (3, "a b c", "a  b", "mentions"), (4, "a b c", "b c", "supplied by")]
    c = spark.createDataFrame(rows, "n int, chunk_text string, quote string, predicate_said string").withColumns({"subject": F.lit("party:a"), "object": F.lit("party:b"), "confidence": F.lit(0.95)})
    v = spark.createDataFrame([("MENTIONS", "mentions", False, ["party"], ["party"]), ("SUPPLIED_BY", "supplied by", False, ["party"], ["party"])], "predicate string, label string, symmetric boolean, domain array<string>, range array<string>")
    got = {r.n: (r.drop_reason, r.epistemic_class, r.capped) for r in D.validated(c, v, ["party"]).collect()}
    assert got[1][0] == got[2][0] == "quote not found" and got[3] == (None, "EXTRACTED_DET", 0.79) and got[4] == (None, "EXTRACTED_MODEL", 0.79)
    state = spark.createDataFrame([("DECLARED", "P"), ("DECLARED", "G"), ("EXTRACTED_DET", "P"), ("EXTRACTED_MODEL", "P")], "c string, p string")
    states = lambda strict: [r.s for r in state.select(D.review_state(F.col("c"), F.lit(strict), F.col("p"), ["G"]).alias("s")).collect()]
    assert states(False) == ["AUTO_ASSERTED", "PENDING", "AUTO_ASSERTED", "PENDING"] and states(True) == ["AUTO_ASSERTED", "PENDING", "PENDING", "PENDING"]


def test_cut_points_and_chunks():
    page = "One two. Three\n \n\nfour  five;\tsix"
    blanks, sentences, spaces = D.cut_points(page)
    assert blanks == [17, 18] and sentences == [9, 30] and len(spaces) == 9
    assert D.chunk_spans("  \n ", 50, 0) == [] and D.chunk_spans("", 50, 0) == []
    text = "word " * 100 + "end.\n\n" + "x" * 700
    spans = D.chunk_spans(text, 600, 100)
    assert spans[0] == (0, 506)
    assert all(b - a <= 600 and not text[a].isspace() for a, b in spans) and spans[-1][1] == len(text)


def test_a_value_proposed_twice_stands_at_its_first_position(spark):
    """Eight synonyms are kept: of nine the one that comes last, not one whose later copy a task met first."""
    cols = spark.createDataFrame([("t", "c")], "node string, column_name string")
    rows = [("t", "c", "synonym", "a", 99)] + [("t", "c", "synonym", f"w{k}", k) for k in range(2, 10)] + [("t", "c", "synonym", "a", 1)]
    said = spark.createDataFrame(rows, "node string, column_name string, kind string, value string, position int").coalesce(1)
    assert {r.object_id for r in D.enrichment(said, cols).collect()} == {"synonym:a"} | {f"synonym:w{k}" for k in range(2, 9)}
