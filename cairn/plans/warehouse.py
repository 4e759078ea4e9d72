"""Queries over the warehouse tables: governed metrics, joins, aggregates, filters, and the SQL that says the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import metrics as M
from ..sources import tables as S

REVENUE = M.Metric(
    "revenue", "sum(l_extendedprice * (1 - l_discount))", "lineitem", (M.Join("orders", "l_orderkey", "o_orderkey"),), grain=("o_orderdate",), time_grains=("month", "quarter", "year"), parameters=(M.Parameter("l_returnflag"), M.Parameter("o_orderstatus"), M.Parameter("o_orderpriority"), M.Parameter("l_quantity"), M.Parameter("l_shipdate")), synonyms=("turnover", "net sales"), definition="discounted price of all items sold", unit="usd", primary_keys={"orders": ("o_orderkey",)}
)
QUANTITY = M.Metric("quantity", "sum(l_quantity)", "lineitem", (M.Join("orders", "l_orderkey", "o_orderkey"),), grain=("o_orderdate",), time_grains=("month", "quarter", "year"), unit="pieces")
ORDERS = M.Metric("order_count", "count(DISTINCT o_orderkey)", "orders", grain=("o_orderdate",), time_grains=("day", "month", "year"), parameters=(M.Parameter("o_orderstatus"),), synonyms=("number of orders",), definition="distinct orders placed")
RETURNED = M.Metric("returned", "sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END)", "lineitem", (M.Join("orders", "l_orderkey", "o_orderkey"),), grain=("o_orderdate",), time_grains=("month", "year"), unit="usd")
BALANCE = M.Metric("balance", "avg(c_acctbal)", "customer", (M.Join("nation", "c_nationkey", "n_nationkey"),), grain=("n_name",), aggregation="non_additive", primary_keys={"nation": ("n_nationkey",)})
METRICS = {m.name: m for m in (REVENUE, QUANTITY, ORDERS, RETURNED, BALANCE)}
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: S.read(spark, folder, n) for n in NAMES}


def money(df: DataFrame, *columns: str, digits: int = 2) -> DataFrame:
    """Sums of doubles depend on the order of the rows in their last digits."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def revenue_by_month(spark: SparkSession, folder: str) -> DataFrame:
    t = tables(spark, folder)
    return money(M.simple_metric(REVENUE, t, time_grain="month", filters=(M.Filter("o_orderstatus", "IN", ["F", "O"]),)).df, "revenue")


QUERIES = {"m1_revenue_by_month": revenue_by_month}
SQL = {
    "m1_revenue_by_month": """SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1"""
}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


for _g in M.GRAINS:

    def _by_grain(spark, folder, g=_g):
        metric = M.Metric("n", "count(*)", "events", grain=("ts",), time_grains=M.GRAINS)
        return M.simple_metric(metric, tables(spark, folder), time_grain=g).df

    QUERIES[f"f1_events_by_{_g}"] = _by_grain
    SQL[f"f1_events_by_{_g}"] = f"SELECT date_trunc('{_g}', ts)::TIMESTAMP AS ts, count(*) AS n FROM events GROUP BY 1"

_JOINED = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN"}
for _how, _sql in _JOINED.items():

    def _joined(spark, folder, how=_how):
        metric = M.Metric("n", "count(*)", "customer", (M.Join("orders", "c_custkey", "o_custkey", how),), ("c_acctbal < 5000 OR c_acctbal IS NULL",), grain=("c_mktsegment", "o_orderstatus"))
        return M.simple_metric(metric, tables(spark, folder)).df

    QUERIES[f"j1_{_how}_join"] = _joined
    SQL[f"j1_{_how}_join"] = f"SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM customer {_sql} orders ON c_custkey = o_custkey WHERE c_acctbal < 5000 OR c_acctbal IS NULL GROUP BY 1, 2"

_FILTERS = {
    "equal": (M.Filter("l_returnflag", "=", "R"), "l_returnflag = 'R'"),
    "not_equal": (M.Filter("l_returnflag", "!=", "R"), "l_returnflag <> 'R'"),
    "above": (M.Filter("l_quantity", ">", 25), "l_quantity > 25"),
    "below": (M.Filter("l_quantity", "<", 25), "l_quantity < 25"),
    "at_least": (M.Filter("l_quantity", ">=", 25), "l_quantity >= 25"),
    "at_most": (M.Filter("l_quantity", "<=", 25), "l_quantity <= 25"),
    "in": (M.Filter("o_orderpriority", "IN", ["1-URGENT", "2-HIGH"]), "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "not_in": (M.Filter("o_orderpriority", "NOT IN", ["1-URGENT"]), "o_orderpriority NOT IN ('1-URGENT')"),
    "like": (M.Filter("o_orderpriority", "LIKE", "%I%"), "o_orderpriority LIKE '%I%'"),
    "between": (M.Filter("l_quantity", "BETWEEN", [10, 20]), "l_quantity BETWEEN 10 AND 20"),
}
for _n, (_f, _w) in _FILTERS.items():

    def _filtered(spark, folder, f=_f):
        return money(M.simple_metric(REVENUE, tables(spark, folder), dimensions=["l_returnflag"], filters=(f,)).df, "revenue")

    QUERIES[f"p1_filter_{_n}"] = _filtered
    SQL[f"p1_filter_{_n}"] = f"SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {_w} GROUP BY 1"


@query("SELECT count(*) AS order_count FROM orders")
def a2_ungrouped(spark, folder):
    return M.simple_metric(ORDERS, tables(spark, folder), dimensions=[]).df


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS states, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1")
def a3_distinct_counts(spark, folder):
    return S.read(spark, folder, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("states"), F.count_distinct("o_orderpriority").alias("priorities"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount,
round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at FROM lineitem GROUP BY 1, 2""")
def a1_pricing_summary(spark, folder):
    df = S.read(spark, folder, "lineitem")
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.expr("sum(l_extendedprice * (1 - l_discount) * (1 + l_tax))"), 2).alias("charge"), F.min("l_shipdate").alias("first_at"), F.max("l_shipdate").alias("last_at"))


@query("SELECT o_orderpriority, round(avg(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)), 6) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def f2_date_difference(spark, folder):
    metric = M.Metric("days", "avg(datediff(DAY, CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)))", "lineitem", (M.Join("orders", "l_orderkey", "o_orderkey"),), grain=("o_orderpriority",))
    return money(M.simple_metric(metric, tables(spark, folder)).df, "days", digits=6)


@query("SELECT n_name, round(avg(c_acctbal), 4) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def m5_non_additive(spark, folder):
    return money(M.simple_metric(BALANCE, tables(spark, folder)).df, "balance", digits=4)


@query("""WITH r AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS returned FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
s AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
o AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, count(DISTINCT o_orderkey) AS order_count FROM orders GROUP BY 1)
SELECT coalesce(r.period, s.period, o.period) AS period, round(returned / nullif(revenue, 0) / nullif(order_count, 0), 8) AS return_rate
FROM r FULL JOIN s ON r.period = s.period FULL JOIN o ON coalesce(r.period, s.period) = o.period""")
def m2_derived_by_month(spark, folder):
    rate = M.Metric("return_rate", "returned / nullif(revenue, 0) / nullif(order_count, 0)", base_metrics=("returned", "revenue", "order_count"))
    return money(M.derived_metric(rate, METRICS, tables(spark, folder), time_grain="month").df, "return_rate", digits=8)


@query("""SELECT round((SELECT sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) FROM lineitem) / nullif((SELECT sum(l_extendedprice * (1 - l_discount)) FROM lineitem), 0), 8) AS return_rate""")
def j4_one_row_derived(spark, folder):
    rate = M.Metric("return_rate", "returned / nullif(revenue, 0)", base_metrics=("returned", "revenue"))
    return money(M.derived_metric(rate, METRICS, tables(spark, folder)).df, "return_rate", digits=8)


@query("""WITH a AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS k, sum(c_acctbal) AS a FROM customer GROUP BY 1),
b AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS k, count(*) AS b FROM customer GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, round(coalesce(a, 0) + coalesce(b, 0), 2) AS v FROM a FULL JOIN b ON a.k = b.k""")
def j3_null_keys_stay_apart(spark, folder):
    c = S.read(spark, folder, "customer")
    t = {"x": c.withColumn("k", F.expr("CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END")), "y": c.withColumn("k", F.expr("CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END"))}
    two = {"a": M.Metric("a", "sum(c_acctbal)", "x"), "b": M.Metric("b", "count(*)", "y")}
    v = M.Metric("v", "coalesce(a, 0) + coalesce(b, 0)", base_metrics=("a", "b"))
    return money(M.derived_metric(v, two, t, dimensions=("k",)).df, "v")


@query("SELECT r_name, c_mktsegment, count(*) AS n FROM region, customer WHERE c_nationkey >= r_regionkey GROUP BY 1, 2")
def j2_cross_join(spark, folder):
    metric = M.Metric("n", "count(*)", "region", (M.Join("customer", "", "", "CROSS"),), ("c_nationkey >= r_regionkey",), grain=("r_name", "c_mktsegment"))
    return M.simple_metric(metric, tables(spark, folder)).df


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def m6_fan_out(spark, folder):
    return M.fan_out(S.read(spark, folder, "lineitem"), "l_suppkey")


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY total DESC NULLS LAST, o_custkey LIMIT 100")
def l1_top_customers(spark, folder):
    metric = M.Metric("total", "round(sum(o_totalprice), 2)", "orders", grain=("o_custkey",))
    return M.simple_metric(metric, tables(spark, folder), order_by=[("total", "DESC"), ("o_custkey", "ASC")], limit=100).df


@query("SELECT o_orderkey, true AS truncated FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 500)")
def s2_capped_result(spark, folder):
    return S.capped(S.read(spark, folder, "orders").select("o_orderkey").orderBy("o_orderkey"), 500)


@query("SELECT n_name, 'nation:' || n_name AS entity_id, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def m9_result_to_entity(spark, folder):
    metric = M.Metric("n", "count(*)", "customer", (M.Join("nation", "c_nationkey", "n_nationkey"),), grain=("n_name",))
    return M.to_entities(M.simple_metric(metric, tables(spark, folder)).df, "n_name", "nation")


@query("""WITH w AS (SELECT o_custkey AS metric_id, o_orderdate AS "at", o_orderkey AS body FROM orders),
v AS (SELECT *, row_number() OVER (PARTITION BY metric_id ORDER BY "at", body) AS version, min("at") OVER (PARTITION BY metric_id) AS first_at, row_number() OVER (PARTITION BY metric_id ORDER BY "at" DESC, body DESC) AS age FROM w)
SELECT metric_id, "at", body, version, first_at FROM v WHERE age <= 10""")
def m10_versions(spark, folder):
    writes = S.read(spark, folder, "orders").select(F.col("o_custkey").alias("metric_id"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("body"))
    return M.versions(writes, keep=10)


@query("""SELECT l_linestatus, l_returnflag, round(sum(l_quantity), 2) AS a, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 6) AS unit_price FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_tax < 0.05 GROUP BY 1, 2""")
def p3_stored_filters(spark, folder):
    t = tables(spark, folder)
    a = M.Metric("a", "round(sum(l_quantity), 2)", "lineitem", filters=("l_shipdate >= TIMESTAMP '1995-01-01'", "l_tax < 0.05"), grain=("l_linestatus", "l_returnflag"))
    b = M.Metric("unit_price", "round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 6)", "lineitem", filters=a.filters, grain=a.grain)
    return M.simple_metric(a, t, ordered=False).df.join(M.simple_metric(b, t, ordered=False).df, list(a.grain))


#: Expressions over orders joined with their items, which repeat an order's row: whether the whole is a sum, and whether repeated rows distort it.
_JUDGED = {
    "sum(o_totalprice)": (True, True),
    "sum(o_totalprice) / count(DISTINCT o_custkey)": (False, True),
    "sum(o_totalprice) / count(*)": (False, True),
    "count(DISTINCT o_custkey)": (False, False),
    "max(o_totalprice) - min(o_totalprice)": (False, False),
    "max(length(concat('sum(', o_orderpriority)))": (False, False),
    "mean(o_totalprice)": (False, True),
    "SUM ( o_totalprice )": (True, True),
}


@query(" UNION ALL ".join(f"SELECT '{e.replace(chr(39), chr(39) * 2)}' AS expression, {str(a).lower()} AS refused, {str(b).lower()} AS warned, round({e}, 2)::DOUBLE AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey" for e, (a, b) in _JUDGED.items()))
def m6_judged_expressions(spark, folder):
    """Semi-additive and joined metrics: which are refused above their grain, which are warned of, and their values."""
    t, out = tables(spark, folder), []
    for e in _JUDGED:
        semi = M.Metric("value", e, "orders", (M.Join("lineitem", "o_orderkey", "l_orderkey"),), grain=("o_orderstatus",), aggregation="semi_additive", primary_keys={"lineitem": ("l_orderkey", "l_linenumber")})
        try:
            M.simple_metric(semi, t, dimensions=[])
            refused = False
        except M.Refused:
            refused = True
        answer = M.simple_metric(M.Metric(semi.name, e, semi.source_table, semi.joins, primary_keys=semi.primary_keys), t)
        warned = any("repeat rows" in w for w in answer.warnings)
        out.append(answer.df.select(F.lit(e).alias("expression"), F.lit(refused).alias("refused"), F.lit(warned).alias("warned"), F.round(F.col("value").cast("double"), 2).alias("value")))
    return reduce(DataFrame.unionByName, out)
