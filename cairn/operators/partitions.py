"""Tables in folders by partition: whole partitions are replaced or removed, the files of all others stay as they are.

What replaces a partition is written beside the table first and counted; then Spark's dynamic partition overwrite puts it in place, one commit of a job. The same replacement again
changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


class NotReplaced(ValueError):
    """What was written beside the table isn't what was asked for; the table is as it was."""


class PartitionedTable:
    """Parquet at ``root`` in folders by the column ``by`` (text or whole numbers)."""

    def __init__(self, spark: SparkSession, root: str, by: str):
        self.spark, self.root, self.by = spark, root.rstrip("/"), by

    def _path(self, *more: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *more]))
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def create(self, rows: DataFrame) -> PartitionedTable:
        rows.write.partitionBy(self.by).parquet(self.root)
        return self

    def read(self, *partitions) -> DataFrame:
        """All rows, or those of some partitions, whose folders alone are read."""
        df = self.spark.read.parquet(self.root)
        return df.where(F.col(self.by).isin(list(partitions))) if partitions else df

    def files(self) -> dict[str, tuple[int, int]]:
        """Of each data file its length and time of change, by its path under the root."""
        p, fs = self._path()
        found, listed = {}, fs.listFiles(p, True)
        while listed.hasNext():
            s = listed.next()
            name = str(s.getPath().toString()).partition(self.root)[2]
            if not s.getPath().getName().startswith(("_", ".")):
                found[name] = (s.getLen(), s.getModificationTime())
        return found

    def replace(self, rows: DataFrame, expected: int | None = None) -> dict:
        """The partitions that ``rows`` hold get these rows in place of theirs: partition to number of rows.

        They are counted once they are written beside the table: an empty replacement, a row without a partition, or another number than ``expected`` is refused.
        """
        beside = f"{self.root}.beside-{uuid.uuid4().hex}"
        rows.write.partitionBy(self.by).parquet(beside)
        p, fs = PartitionedTable(self.spark, beside, self.by)._path()
        try:
            # a folder has no other types than the table's own columns, so that it is read by their schema
            staged = self.spark.read.schema(rows.schema).parquet(beside)
            counts = {r[0]: r[1] for r in staged.groupBy(self.by).count().collect()}  # as many as partitions are replaced
            if not counts or None in counts:
                raise NotReplaced(f"a replacement needs rows, all with a {self.by}")
            if expected is not None and sum(counts.values()) != expected:
                raise NotReplaced(f"{sum(counts.values())} rows in place of {expected}")
            staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.by).parquet(self.root)
        finally:
            fs.delete(p, True)
        return counts

    def remove(self, *partitions) -> list:
        """Deletes the folders of these partitions; those that were there."""
        gone = []
        for value in partitions:
            p, fs = self._path(f"{self.by}={value}")
            if fs.exists(p) and fs.delete(p, True):
                gone.append(value)
        return gone

    def upsert(self, rows: DataFrame, key: str, at: str) -> dict:
        """The newest row of each key, in the partitions that ``rows`` hold only: the others aren't read either. A key stays in its partition."""
        asked = [r[0] for r in rows.select(self.by).distinct().collect()]
        both = self.read(*asked).withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
        columns = [c for c in both.columns if c not in ("_new", key)]
        newest = both.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, "_new")).alias("x")).select(key, "x.*")
        return self.replace(newest, both.select(key).distinct().count())


def reset(tables: dict[str, PartitionedTable], tenant: str, layers: set[str]) -> dict[str, list]:
    """Removes a tenant's partition from each of the layers, and from no other."""
    return {name: t.remove(tenant) for name, t in tables.items() if name in layers}
