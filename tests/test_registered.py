"""Every registered query against its SQL in DuckDB on the smallest tables; queries without SQL against plain versions."""

import pytest

from cairn.plans import registered
from cairn.plans.checks import compare

QUERIES, SQL = registered()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, name):
    assert compare(spark, name, QUERIES[name], SQL[name], sf) == ""


def test_import_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 200 and set(e.oracle_sql()) <= set(e.queries())"], cwd=root, check=True)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_chunks_cover_the_text(spark, sf):
    """Against a plain reading of the rules: chunks stay in their page, are cut at a boundary or the hard limit, and leave out only white space."""
    from cairn.plans.texts import paged
    from cairn.operators import documents as D

    chunked = D.chunks(paged(spark, sf), 1200, 150)
    assert D.misplaced(chunked).count() == 0
    by = {}
    for r in chunked.select("doc_id", "page", "ordinal", "start", "end", "text", "char_end").orderBy("doc_id", "page", "ordinal").collect():
        by.setdefault((r.doc_id, r.page), []).append(r)
    for rows in by.values():
        text = rows[0].text
        for a, b in zip(rows, rows[1:]):
            assert a.end - a.start <= 1200 and b.start <= a.end + len(text[a.end : b.start]) and text[a.end : b.start].strip() == ""
            assert a.end - a.start == 1200 or text[a.end - 1].isspace()
        assert text[rows[-1].end : rows[-1].char_end].strip() == ""


def test_loose_quotes(spark, sf):
    """A quote with doubled spaces is the same words in the text."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["f16_loose_quotes"](spark, sf).collect()
    assert len(rows) > 0.9 * sum(len(t) > 60 for t in texts.values())
    assert all(texts[r.doc_id][r.start : r.end].split() == texts[r.doc_id][10:60].split() for r in rows)


def test_relevant_tables(spark, sf):
    rows = QUERIES["v5_relevant_tables"](spark, sf).where("rank = 1").collect()
    assert {r.table_name for r in rows if r.question_id % 3 == 1} == {"orders"} and {r.table_name for r in rows if r.question_id % 3 == 0} == {"lineitem"}


def test_approximate_neighbours(spark, sf):
    """Recall of 0.9 or more against the exact search; ranks go by exact scores, inside the wall."""
    rows = QUERIES["v1_approximate"](spark, sf).collect()
    exact = {(r.query_id, r.vec_id): r.score for r in QUERIES["v1_knn"](spark, sf).collect()}
    hits = [r for r in rows if r.exact]
    assert len(hits) >= 0.9 * len(exact) and all(exact[r.query_id, r.vec_id] == r.score for r in hits) and {(r.query_id, r.vec_id) for r in hits} <= set(exact)
    by = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert all(x == sorted(x) and len(x) == 5 for x in by.values())


def test_an_index_of_projections_takes_odd_vectors(spark):
    from cairn.operators import vectors as V

    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (None, [1.0, 0.0]), (5, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = V.ProjectionIndex(v.where("embedding IS NOT NULL")).knn(v.where("vec_id = 1"), 2).collect()
    assert [(r.vec_id, r.rank) for r in sorted(found, key=lambda r: r.rank)][0] == (1, 1) and {r.vec_id for r in found} == {1, 2}


def test_search_multiplies_blocks_and_pairs_no_rows(spark):
    """Copies, zero, null, broken and infinite vectors, other widths and several blocks of queries rank as by a fold over each pair; no join makes the pairs."""
    import random

    from pyspark.sql import Window as W, functions as F

    from cairn.operators import vectors as V

    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 360)]
    rows += [(360, None), (361, [1.0, None] * 4), (362, [float("nan")] * 8), (363, [float("inf")] + [0.0] * 7), (364, [0.0] * 8), (365, [1.0, 2.0]), (366, [3.0, 1.0]), (367, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = v.where("vec_id % 5 = 0 OR vec_id > 355")
    got = V.knn(asked, v, 4, F.col("vec_id") % 3 != 0, block=20)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    pairs = V.unit(asked).select(F.col("vec_id").alias("query_id"), F.col("unit").alias("q")).crossJoin(V.unit(v.where("vec_id % 3 <> 0")).select("vec_id", "unit"))
    pairs = pairs.withColumn("score", F.round(F.aggregate(F.zip_with("unit", "q", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 6))
    want = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where("rank <= 4")
    shown = lambda df: sorted((x.query_id, x["rank"], x.vec_id, str(x.score)) for x in df.collect())
    assert shown(got) == shown(want)
