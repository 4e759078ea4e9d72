"""Scans along the rows of a key, where one key may hold most rows: a value before each row, and row numbers.

A window by the key would put all its rows in one task. Here the rows are dealt by key and order to ranges, whose splitters Spark samples, so that a large key lies in
many. The first pass scans each range by itself and keeps what a key carries out of it, one row for a key and range. The carries, at most one a range for each key, are
scanned in the second pass and joined back by key and range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .session import stored


def _dealt(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, key, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def _by(key: str):
    return W.partitionBy(key).orderBy("_range")


def previous(df: DataFrame, key: str, order: list[str], value: str, name: str, skip_nulls: bool = False) -> DataFrame:
    """The rows with the key's value before them in the order, null for the first; with ``skip_nulls`` the last one that isn't null. ``order`` tells all rows of a key apart."""
    rows = _dealt(df, key, order)
    held = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"))) if skip_nulls else F.struct(F.col(value).alias("v"))
    inside = W.partitionBy(key, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_held", held)
    when = F.when(F.col("_held").isNotNull(), F.struct(*order))
    out = rows.groupBy(key, "_range").agg(F.max_by("_held", when).alias("_carried"))
    into = stored(out.withColumn("_into", F.last("_carried", ignorenulls=True).over(_by(key).rowsBetween(W.unboundedPreceding, -1))).select(F.col(key).alias("_key"), F.col("_range").alias("_r"), "_into"), "carries")
    local = rows.withColumn("_local", F.last("_held", ignorenulls=True).over(inside))
    both = local.join(into, local[key].eqNullSafe(into["_key"]) & (local["_range"] == into["_r"]))
    return both.select(*df.columns, F.coalesce("_local", "_into")["v"].alias(name))


def numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows with ``_n``, their number in the key's order, ``_total``, the key's number of rows, and ``_first``, the least of the first order column."""
    rows = _dealt(df, key, order)
    counts = rows.groupBy(key, "_range").agg(F.count("*").alias("c"), F.min(order[0]).alias("f"))
    whole = W.partitionBy(key)
    into = counts.select(F.col(key).alias("_key"), F.col("_range").alias("_r"), F.coalesce(F.sum("c").over(_by(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("c").over(whole).alias("_total"), F.min("f").over(whole).alias("_first"))
    into = stored(into, "carries")
    local = rows.withColumn("_local", F.row_number().over(W.partitionBy(key, "_range").orderBy(*order)))
    both = local.join(into, local[key].eqNullSafe(into["_key"]) & (local["_range"] == into["_r"]))
    return both.select(*df.columns, (F.col("_local") + F.col("_before")).cast("int").alias("_n"), "_total", "_first")
