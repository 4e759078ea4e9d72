"""Sources: warehouse tables, capped results, whole-text documents, page assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PAGE_MARK = "\f"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def capped(df: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` rows, each with ``truncated``: whether there were more. One row beyond the cap tells them apart."""
    few = df.limit(cap + 1)
    more = few.agg((F.count("*") > cap).alias("truncated"))
    return few.limit(cap).crossJoin(F.broadcast(more))  # one row


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document per file: path, filename, text; each is a single page."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), safe_name(name).alias("filename"), F.col("value").alias("text"))


def safe_name(name: Column) -> Column:
    """The last part of a path in letters, digits, dots, dashes and underscores, at most 120; nothing left gives ``document``."""
    last = F.element_at(F.split(F.regexp_replace(name, r"\\", "/"), "/"), -1)
    kept = F.substring(F.regexp_replace(F.regexp_replace(last, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", ""), 1, 120)
    return F.when(F.length(kept) > 0, kept).otherwise("document")


def key_parts(key: Column, prefix: str = "processed/") -> Column:
    """tenant, content_sha256 and filename of a stored document's key ``prefix/tenant/hash/filename``; null for keys of other shapes or with unsafe parts."""
    parts = F.split(F.substring(key, len(prefix) + 1, F.length(key)), "/")
    safe = F.forall(parts, lambda p: (F.length(p) > 0) & (p == safe_name(p)))
    return F.when(F.startswith(key, F.lit(prefix)) & (F.size(parts) == 3) & safe, F.struct(parts[0].alias("tenant"), F.get(parts, 1).alias("content_sha256"), F.get(parts, 2).alias("filename")))


def pages(documents: DataFrame, text: str = "text") -> DataFrame:
    """A row per page of each document: page (from 1), page_text, char_start and char_end in the whole text."""
    parts = F.split(text, PAGE_MARK)
    sizes = F.transform(parts, lambda p: F.length(p) + 1)
    rows = documents.select("*", F.posexplode(F.arrays_zip(parts.alias("p"), sizes.alias("n"))).alias("i", "z"), sizes.alias("sizes"))
    start = F.aggregate(F.slice("sizes", F.lit(1), F.col("i")), F.lit(0), lambda a, x: a + x)
    return rows.select("*", (F.col("i") + 1).alias("page"), F.col("z.p").alias("page_text"), start.alias("char_start"), (start + F.length("z.p")).alias("char_end")).drop("i", "z", "sizes")
