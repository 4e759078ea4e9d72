"""What a governed metric refuses, and what it warns of."""

import pytest

from cairn.operators import metrics as M
from cairn.plans import warehouse as P


@pytest.fixture(scope="module")
def t(spark, sf):
    return P.tables(spark, sf)


@pytest.mark.parametrize(
    "call",
    [
        lambda t: M.simple_metric(P.REVENUE, t, filters=(M.Filter("l_comment", "=", "x"),)),
        lambda t: M.simple_metric(P.REVENUE, t, filters=(M.Filter("l_quantity", "IN", []),)),
        lambda t: M.simple_metric(P.REVENUE, t, filters=(M.Filter("l_quantity", "BETWEEN", [1]),)),
        lambda t: M.simple_metric(P.REVENUE, t, filters=(M.Filter("l_quantity", "~", 1),)),
        lambda t: M.simple_metric(P.REVENUE, t, time_grain="day"),
        lambda t: M.simple_metric(P.REVENUE, t, time_grain="decade"),
        lambda t: M.simple_metric(P.REVENUE, t, dimensions=["l_shipdate"]),
        lambda t: M.simple_metric(P.REVENUE, t, order_by=[("l_tax", "ASC")]),
        lambda t: M.simple_metric(M.Metric("x", "sum(c_acctbal)", "customer", grain=("c_name",), aggregation="semi_additive"), t, dimensions=["c_mktsegment"]),
        lambda t: M.simple_metric(M.Metric("x", "count(*)", "customer"), t, time_grain="month"),
        lambda t: M.simple_metric(M.Metric("x", "count(*)", "nothing"), t),
        lambda t: M.simple_metric(M.Metric("x", "count(*)", "orders", parameters=(M.Parameter("o_orderstatus", True),)), t),
        lambda t: M.derived_metric(M.Metric("x", "a / b", base_metrics=("a", "b")), {}, t),
        lambda t: M.derived_metric(M.Metric("x", "revenue", base_metrics=("revenue", "order_count")), P.METRICS, t, dimensions=("l_returnflag",)),
        lambda t: M.derived_metric(M.Metric("x", "y", base_metrics=("y",)), {"y": M.Metric("y", "z", base_metrics=("z",))}, t),
    ],
)
def test_refusals(t, call):
    with pytest.raises(M.Refused):
        call(t)


def test_default_grain_is_the_coarsest(t):
    assert M.simple_metric(P.REVENUE, t).df.count() == t["orders"].selectExpr("year(o_orderdate)").distinct().count()


def test_warnings(t):
    assert any("non-additive" in w for w in M.simple_metric(P.BALANCE, t).warnings)
    fan = M.Metric("x", "sum(o_totalprice)", "orders", (M.Join("lineitem", "o_orderkey", "l_orderkey"),), primary_keys={"lineitem": ("l_orderkey", "l_linenumber")})
    assert any("repeat rows" in w for w in M.simple_metric(fan, t).warnings)
    assert any("unknown dimensions" in w for w in M.simple_metric(P.ORDERS, t, dimensions=["nope"]).warnings)
    assert M.missing_columns(M.Metric("x", "sum(nope) / count(o_orderkey)", "orders"), t) == ["nope"] and M.missing_columns(P.REVENUE, t) == []


def test_metric_pack(spark):
    pack = spark.createDataFrame([("a", 1, "simple", []), ("a", 2, "simple", []), ("d", 3, "derived", ["a"]), ("e", 4, "derived", ["d"]), ("f", 5, "derived", ["zz"])], "metric_id string, position int, type string, base_metrics array<string>")
    kept, errors = M.load_pack(pack)
    assert sorted(r.metric_id for r in kept.collect()) == ["a", "d"]
    assert {tuple(r) for r in errors.collect()} == {("a", "duplicate"), ("e", "nested base"), ("f", "unknown base")}


def test_unknown_names(t):
    """Names are told from texts, functions, lambda variables and keywords by Spark's parser."""
    of = lambda e: M.missing_columns(M.Metric("m", e, "orders"), t)
    assert of("sum(CASE WHEN O_OrderStatus = 'nope' AND o_totalprice IS NOT NULL THEN `my col` END) / interval_days") == ["interval_days", "my col"]
    assert of("max(aggregate(array(o_totalprice), 0D, (acc, x) -> acc + x + gone))") == ["gone"]
    assert of("count(DISTINCT orders.o_custkey)") == [] and of("count(DISTINCT orders.nope)") == ["orders.nope"]


def test_additivity_by_the_resolved_expression(t):
    rows = t["orders"]
    assert [M.is_sum(e, rows) for e in ("sum(o_totalprice)", "sum(o_totalprice) / count(*)", "max(length('sum('))", "sum(nope)")] == [True, False, False, False]
    assert [M.counts_rows(e, rows) for e in ("count(DISTINCT o_custkey)", "sum(o_totalprice) / count(DISTINCT o_custkey)", "avg(o_totalprice)", "max(o_totalprice)", "count(*)")] == [False, True, True, False, True]
