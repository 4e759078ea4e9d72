"""Where checkpoints go: the folder that the cluster names, or a temporary one in local mode. Tables beside them, and broadcasts with a checked bound."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, functions as F

#: Rows of a vocabulary that are sent to every task; larger ones are joined as any table.
VOCABULARY = 1000
#: Rows of a few short columns that are sent to every task where one side of a join is small.
SENT = 1_000_000
#: Folders that a task writes side by side.
FOLDERS = 16


def checkpoints(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def write_unsorted(writer: DataFrameWriter, path: str) -> None:
    """Parquet in folders, with a file open for each of up to ``FOLDERS`` folders in a task: Spark sorts the rows by folder first otherwise, and what it sorts is spilled."""
    conf, name = writer._spark.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name, "0")
    conf.set(name, str(FOLDERS))
    try:
        writer.parquet(path)
    finally:
        conf.set(name, before)


def stored(df: DataFrame, what: str, *by: str) -> DataFrame:
    """The rows as a table beside the checkpoints, in folders by some columns: it cuts the lineage and can be read more than once."""
    spark = df.sparkSession
    checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{what}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(rows: DataFrame) -> DataFrame:
    """The rows as a broadcast side if they are at most ``SENT``, which are counted: stored rows have no size that the optimizer knows. Others are left as they are."""
    return F.broadcast(rows) if rows.limit(SENT + 1).count() <= SENT else rows


def with_vocabulary(rows: DataFrame, vocabulary: DataFrame, key: str = "predicate", how: str = "inner") -> DataFrame:
    """The join by a key of few values with a vocabulary of at most ``VOCABULARY`` rows, which is counted: it is broadcast, and an inner join reads its keys' rows only.

    By such a key the rows would be shuffled to as many tasks as there are words. A larger vocabulary is left to the optimizer.
    """
    words = vocabulary.select(key).limit(VOCABULARY + 1).collect()
    if len(words) > VOCABULARY:
        return rows.join(vocabulary, key, how)
    if how == "inner":
        rows = rows.where(F.col(key).isin(sorted({w[0] for w in words if w[0] is not None})))
    return rows.join(F.broadcast(vocabulary), key, how)
