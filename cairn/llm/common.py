"""Helpers that the corpus operators share: tables, shared scratch space, bounded broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words of the contracts: runs of anything but ASCII white space. ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where none is set in local mode."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def has(df: DataFrame, *needed: str) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")


def bounded_rows(df: DataFrame, limit: int, *order) -> DataFrame:
    """At most ``limit`` rows, the first by ``order``: a documented bound for what is fitted or broadcast."""
    return df.orderBy(*order).limit(limit)


BATCH_ROWS = 500


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows: texts are long, and a batch is in memory on both sides.

    Spark takes the size from the session when the plan runs, so that it is lowered there and stays so: later Arrow plans of the session use it too.
    """
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


_LETTERS = re.compile(r"\w+")


def plain_words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())
