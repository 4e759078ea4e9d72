"""Governed metrics: a declared metric becomes one DataFrame plan, or is refused with a reason.

A metric names its expression (Spark SQL), source table, joins, stored filters, grain, allowed time grains, parameters (the only
columns a caller may filter on) and additivity. ``tables`` maps table names to DataFrames; an unknown table is an error.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import scans

GRAINS = ("hour", "day", "week", "month", "quarter", "year")  # from fine to coarse
CALENDAR = {"day", "date", "week", "month", "quarter", "year", "hour"}
OPERATORS = ("=", "!=", ">", "<", ">=", "<=", "IN", "NOT IN", "LIKE", "BETWEEN")
JOINS = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full", "CROSS": "cross"}


class Refused(ValueError):
    """The question breaks a rule of the metric."""


@dataclass(frozen=True)
class Join:
    table: str
    source_column: str
    target_column: str
    how: str = "INNER"


@dataclass(frozen=True)
class Parameter:
    column: str
    required: bool = False


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: object


@dataclass(frozen=True)
class Metric:
    name: str
    expression: str
    source_table: str = ""
    joins: tuple[Join, ...] = ()
    filters: tuple[str, ...] = ()
    grain: tuple[str, ...] = ()
    time_column: str | None = None
    time_grains: tuple[str, ...] = ()
    parameters: tuple[Parameter, ...] = ()
    aggregation: str = "additive"  # or semi_additive, non_additive
    unit: str | None = None
    base_metrics: tuple[str, ...] = ()
    synonyms: tuple[str, ...] = ()
    definition: str = ""
    primary_keys: dict[str, tuple[str, ...]] = field(default_factory=dict, hash=False)


@dataclass
class Answer:
    df: DataFrame
    warnings: list[str]


def condition(f: Filter, column: Column | None = None) -> Column:
    """A caller's filter as a column; values are literals and never become SQL text."""
    c, op, v = F.col(f.column) if column is None else column, f.operator.upper(), f.value
    if op not in OPERATORS:
        raise Refused(f"operator {f.operator} is not allowed")
    if op in ("IN", "NOT IN"):
        values = list(v) if isinstance(v, (list, tuple, set)) else [v]
        if not values:
            raise Refused(f"{op} on {f.column} needs values")
        return c.isin(values) if op == "IN" else ~c.isin(values)
    if op == "BETWEEN":
        if not isinstance(v, (list, tuple)) or len(v) != 2:
            raise Refused(f"BETWEEN on {f.column} needs two bounds")
        return c.between(*v)
    if isinstance(v, (list, tuple, set)):
        raise Refused(f"{op} on {f.column} takes one value")
    if op == "LIKE":
        return c.like(str(v))
    return {"=": c == v, "!=": c != v, ">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}[op]


def _temporal(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes).get(name, "").startswith(("date", "timestamp", "time"))


def source(metric: Metric, tables: dict[str, DataFrame]) -> DataFrame:
    """The star of the metric's joins with its stored filters."""
    if metric.source_table not in tables:
        raise Refused(f"unknown table {metric.source_table}")
    df = tables[metric.source_table]
    for j in metric.joins:
        if j.table not in tables or j.how.upper() not in JOINS:
            raise Refused(f"unknown join {j.how} {j.table}")
        other = tables[j.table]
        df = df.crossJoin(other) if j.how.upper() == "CROSS" else df.join(other, df[j.source_column] == other[j.target_column], JOINS[j.how.upper()])
    return reduce(lambda d, f: d.where(F.expr(f)), metric.filters, df)


def _axis(metric: Metric, df: DataFrame) -> str | None:
    return metric.time_column or next((c for c in metric.grain if _temporal(df, c)), None)


def _grain(metric: Metric, asked: str | None) -> str | None:
    declared = [g.lower() for g in metric.time_grains]
    if asked is None:
        return max(declared, key=GRAINS.index) if declared else None  # the coarsest one
    grain = asked.lower()
    if grain not in GRAINS or declared and grain not in declared:
        raise Refused(f"time grain {asked} is not among {sorted(declared) or GRAINS}")
    return grain


def _check_filters(metric: Metric, filters: tuple[Filter, ...]) -> None:
    allowed = {p.column for p in metric.parameters}
    if extra := [f.column for f in filters if f.column not in allowed]:
        raise Refused(f"{metric.name} cannot be filtered by {', '.join(extra)}")
    if missing := [p.column for p in metric.parameters if p.required and p.column not in {f.column for f in filters}]:
        raise Refused(f"{metric.name} needs a filter on {', '.join(missing)}")


def _names(tree: str) -> list[dict]:
    return [{"class": n["class"].rpartition(".")[2]} | {k: n[k] for k in ("isDistinct", "nameParts") if k in n} for n in json.loads(tree)]


def resolved(expression: str, df: DataFrame) -> list[dict]:
    """The expression as Spark resolves it over the rows, from the outside in: class and, of aggregates, whether distinct. Empty if it can't be resolved."""
    try:
        plan = json.loads(df.agg(F.expr(expression).alias("value"))._jdf.queryExecution().analyzed().toJSON())
    except (AnalysisException, ParseException):
        return []
    return _names(json.dumps(plan[0]["aggregateExpressions"][0]))[1:]


def is_sum(expression: str, df: DataFrame) -> bool:
    """Whether the whole expression is a sum."""
    return [n["class"] for n in resolved(expression, df)[:2]] == ["AggregateExpression", "Sum"]


def counts_rows(expression: str, df: DataFrame) -> bool:
    """Whether any sum, average or count in it grows with repeated rows; a distinct count doesn't."""
    nodes = resolved(expression, df)
    return any(n["class"] == "AggregateExpression" and of["class"] in ("Sum", "Average", "Count") and not (of["class"] == "Count" and n["isDistinct"]) for n, of in zip(nodes, nodes[1:]))


def _fans_out(metric: Metric, df: DataFrame) -> list[str]:
    other_key = [j.table for j in metric.joins if j.table in metric.primary_keys and metric.primary_keys[j.table] != (j.target_column,)]
    return other_key if other_key and counts_rows(metric.expression, df) else []


def fan_out(target: DataFrame, key: str) -> DataFrame:
    """Keys that stand on several rows of a join's target, with their number: sums over such a join count twice."""
    return target.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def _ordered(df: DataFrame, order_by, known: list[str], default: str | None) -> DataFrame:
    if order_by:
        if bad := [c for c, _ in order_by if c not in known]:
            raise Refused(f"cannot order by {', '.join(bad)}")
        return df.orderBy(*[F.desc_nulls_last(c) if d.upper() == "DESC" else F.asc_nulls_last(c) for c, d in order_by])
    return df.orderBy(F.desc_nulls_last(default)) if default else df


def simple_metric(metric: Metric, tables: dict[str, DataFrame], dimensions=None, filters: tuple[Filter, ...] = (), order_by=None, limit: int | None = None, time_grain: str | None = None, ordered: bool = True) -> Answer:
    """One aggregate over the metric's star, by ``dimensions`` (its own grain if none are given)."""
    warnings: list[str] = []
    _check_filters(metric, filters)
    df = source(metric, tables)
    axis = _axis(metric, df)
    dims = list(metric.grain if dimensions is None else dimensions)
    if unknown := [d for d in dims if d not in df.columns]:
        warnings.append(f"dropped unknown dimensions {', '.join(unknown)}")
        dims = [d for d in dims if d in df.columns]
    if time_grain and axis and axis not in dims:
        dims.append(axis)
    if metric.time_grains and (by_time := [d for d in dims if d != axis and (_temporal(df, d) or d.lower() in CALENDAR)]):
        raise Refused(f"{', '.join(by_time)} would go around the declared time grains")
    grain = _grain(metric, time_grain) if axis in dims or time_grain else None
    if time_grain and not axis:
        raise Refused(f"{metric.name} has no time axis")
    if metric.aggregation == "semi_additive" and (grain or set(dims) != set(metric.grain)) and is_sum(metric.expression, df):
        raise Refused(f"{metric.name} is semi-additive: it is not summed over time or above its grain")
    if metric.aggregation == "non_additive":
        warnings.append(f"{metric.name} is non-additive: its values must not be added up")
    warnings += [f"the join to {t} may repeat rows" for t in _fans_out(metric, df)]
    for f in filters:
        df = df.where(condition(f))
    keys = []
    for d in dims:
        cut = F.date_trunc(grain, d) if d == axis and grain else F.col(d)
        keys.append((cut.cast("date") if d == axis and grain and dict(df.dtypes)[d] == "date" else cut).alias(d))
    value = F.expr(metric.expression).alias(metric.name)
    out = df.groupBy(*keys).agg(value) if keys else df.agg(value)
    if ordered:
        out = _ordered(out, order_by, [*dims, metric.name], metric.name if dims else None)
    return Answer(out.limit(limit) if limit else out, warnings)


def derived_metric(metric: Metric, metrics: dict[str, Metric], tables: dict[str, DataFrame], dimensions=(), filters: tuple[Filter, ...] = (), order_by=None, limit: int | None = None, time_grain: str | None = None) -> Answer:
    """An expression over base metrics, each recomputed at the shared grain and aligned on the dimensions and ``period``."""
    warnings: list[str] = []
    bases = []
    for b in metric.base_metrics:
        if b not in metrics:
            raise Refused(f"unknown base metric {b}")
        if metrics[b].base_metrics:
            raise Refused(f"{b} is derived itself")
        bases.append(metrics[b])
    if not bases:
        raise Refused(f"{metric.name} has no base metrics")
    if len({b.unit for b in bases if b.unit}) > 1:
        warnings.append("the base metrics have several units")
    parts = []
    for b in bases:
        df = source(b, tables)
        axis = _axis(b, df)
        if missing := [d for d in dimensions if d not in df.columns]:
            raise Refused(f"{b.name} has no {', '.join(missing)}")
        grain = _grain(b, time_grain) if time_grain else None
        if time_grain and not axis:
            raise Refused(f"{b.name} has no time axis")
        one = simple_metric(b, tables, [*dimensions, *([axis] if grain else [])], time_grain=time_grain, ordered=False)
        warnings += one.warnings
        parts.append(one.df.withColumnRenamed(axis, "period") if grain else one.df)
    keys = [*dimensions, *(["period"] if time_grain else [])]

    def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
        if not keys:
            return left.crossJoin(right)  # one row each
        named = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
        on = reduce(Column.__and__, [left[k] == named[f"_{k}"] for k in keys])  # null keys stay apart
        rest = [c for c in left.columns if c not in keys] + [c for c in named.columns if c[1:] not in keys or c[0] != "_"]
        return left.join(named, on, "full").select(*[F.coalesce(left[k], named[f"_{k}"]).alias(k) for k in keys], *rest)

    out = reduce(aligned, parts).select(*keys, F.expr(metric.expression).alias(metric.name))
    for f in filters:
        if f.column not in keys:
            raise Refused(f"{metric.name} is filtered by its dimensions only, not by {f.column}")
        out = out.where(condition(f))
    out = _ordered(out, order_by, [*keys, metric.name], metric.name if keys else None)
    return Answer(out.limit(limit) if limit else out, warnings)


def missing_columns(metric: Metric, tables: dict[str, DataFrame]) -> list[str]:
    """Names in the expression that are no column of the metric's tables, by case-insensitive comparison. Spark's parser tells names from functions, texts and lambda variables."""
    df = source(metric, tables)
    known = {c.lower() for c in df.columns}
    parsed = json.loads(df.sparkSession._jsparkSession.sessionState().sqlParser().parseExpression(metric.expression).toJSON())
    found: set[str] = set()

    def walk(at: int, bound: frozenset) -> int:
        """The place after the node at ``at`` and what is under it."""
        node, kind = parsed[at], parsed[at]["class"].rpartition(".")[2]
        names = node["nameParts"].strip("[]").split(", ") if "Unresolved" in kind and "Function" not in kind and "nameParts" in node else None
        # a.b is a field of the column a, or a column b of a table a
        if names and not {names[0].lower(), names[-1].lower()} & (known | bound):
            found.add(".".join(names))
        if kind == "LambdaFunction":  # its body, then its variables
            ends = [at + 1]
            for _ in range(node["num-children"]):
                ends.append(after(ends[-1]))
            bound |= {parsed[e]["nameParts"].strip("[]").lower() for e in ends[1:-1]}
        to = at + 1
        for _ in range(node["num-children"]):
            to = walk(to, bound)
        return to

    def after(at: int) -> int:
        to = at + 1
        for _ in range(parsed[at]["num-children"]):
            to = after(to)
        return to

    walk(0, frozenset())
    return sorted(found)


def to_entities(result: DataFrame, column: str, kind: str) -> DataFrame:
    """``entity_id`` of a result column: the exact key, never a likeness."""
    return result.withColumn("entity_id", F.when(F.col(column).isNotNull(), F.concat(F.lit(kind + ":"), F.col(column).cast("string"))))


def versions(writes: DataFrame, keep: int = 10, tie: tuple[str, ...] = ("body",)) -> DataFrame:
    """Writes (metric_id, at, ...) with their version, the first write's time, and only the newest ``keep`` of each metric; ``tie`` orders writes of one moment."""
    rows = scans.numbered(writes, "metric_id", ["at", *tie])
    return rows.where(F.col("_n") > F.col("_total") - keep).select(*writes.columns, F.col("_n").alias("version"), F.col("_first").alias("first_at"))


def restored(stored: DataFrame, wanted: DataFrame, at: Column) -> DataFrame:
    """The writes that bring back versions (``wanted``: metric_id, version) that are still kept: the old values as a new write."""
    return stored.join(wanted, ["metric_id", "version"], "left_semi").drop("version", "first_at").withColumn("at", at)


def served(stored: DataFrame) -> DataFrame:
    """The newest version of each metric, if it is approved; no status counts as approved."""
    last = F.max_by(F.struct(*stored.columns), F.col("version")).alias("x")
    return stored.groupBy("metric_id").agg(last).select("x.*").where("coalesce(status, 'approved') = 'approved'")


def load_pack(pack: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metric rows (metric_id, position, type, base_metrics): the first of each id, and the errors with a reason."""
    first = pack.withColumn("n", F.row_number().over(W.partitionBy("metric_id").orderBy("position")))
    repeated = first.where("n > 1").select("metric_id", F.lit("duplicate").alias("reason"))
    kept = first.where("n = 1").drop("n")
    needs = kept.where("type = 'derived'").select("metric_id", F.explode_outer("base_metrics").alias("base"))
    known = kept.select(F.col("metric_id").alias("base"), F.col("type").alias("base_type"))
    bad = needs.join(known, "base", "left").where("base_type IS NULL OR base_type = 'derived'").select("metric_id", F.when(F.col("base_type").isNull(), "unknown base").otherwise("nested base").alias("reason")).distinct()
    return kept.join(bad.select("metric_id").distinct(), "metric_id", "left_anti"), repeated.unionByName(bad)
