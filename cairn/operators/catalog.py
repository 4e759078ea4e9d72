"""The catalog as data: scans become facts, later scans replace earlier ones of a source, descriptions are overlaid by rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

# Who described a column, from the most to the least trusted.
METHOD_RANK = {"human": 0, "catalog": 1, "model": 2}


def scan(spark: SparkSession, source_id: str, databases: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Columns (source_id, database, table, position, column, type, is_partition, node_id) and errors (database, table, message) of the session's catalog.

    A database or table that cannot be read is an error row; the scan goes on. Names come from the metastore, data is not read.
    """
    rows, errors = [], []
    for db in databases or [d.name for d in spark.catalog.listDatabases()]:
        try:
            tables = spark.catalog.listTables(db)
        except Exception as e:  # noqa: BLE001
            errors.append((db, None, str(e)[:200]))
            continue
        for t in tables:
            try:
                name = t.name if t.isTemporary else f"{db}.{t.name}"
                for k, c in enumerate(sorted(spark.catalog.listColumns(name), key=lambda c: c.isPartition)):
                    rows.append((source_id, db, t.name, k, c.name, c.dataType, c.isPartition, f"column:{source_id}:{db}.{t.name}.{c.name}"))
            except Exception as e:  # noqa: BLE001
                errors.append((db, t.name, str(e)[:200]))
    columns = spark.createDataFrame(rows, "source_id string, database string, table string, position int, column string, type string, is_partition boolean, node_id string")
    return columns, spark.createDataFrame(errors, "database string, table string, message string")


def facts(columns: DataFrame) -> DataFrame:
    """HAS_TABLE, HAS_COLUMN and PARTITIONED_BY facts of a scan, declared at 1.0."""
    table = F.concat(F.lit("table:"), "source_id", F.lit(":"), "database", F.lit("."), "table")
    source = F.concat(F.lit("source:"), "source_id")
    one = lambda s, p, o, d: d.select(s.alias("subject_id"), F.lit(p).alias("predicate"), o.alias("object_id")).distinct()
    rows = [one(source, "HAS_TABLE", table, columns), one(table, "HAS_COLUMN", F.col("node_id"), columns), one(table, "PARTITIONED_BY", F.col("node_id"), columns.where("is_partition"))]
    return reduce(DataFrame.unionByName, rows).select("*", F.lit("DECLARED").alias("epistemic_class"), F.lit(1.0).alias("confidence"))


def listing(columns: DataFrame) -> DataFrame:
    return columns.groupBy("database").agg(F.count_distinct("table").alias("tables"), F.count("*").alias("columns"))


def replaced(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """The stored rows of other sources, and the new scan's."""
    return stored.join(scanned.select("source_id").distinct(), "source_id", "left_anti").unionByName(scanned)


def hydrated(stored: DataFrame, graph: DataFrame) -> DataFrame:
    """Missing tables filled in from the graph; an existing table's rows win."""
    key = ["source_id", "database", "table"]
    return stored.unionByName(graph.join(stored.select(*key).distinct(), key, "left_anti").select(stored.columns))


def sources_of(tables: DataFrame, sources: DataFrame) -> DataFrame:
    """source_id, table_count, last_scanned_at of each source (source_id, last_scanned_at): its own time of scan, else its newest table's (``tables``: source_id, database, table, scanned_at)."""
    per = tables.groupBy("source_id").agg(F.count_distinct("database", "table").alias("n"), F.max("scanned_at").alias("newest"))
    return sources.join(per, "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("table_count"), F.coalesce("last_scanned_at", "newest").alias("last_scanned_at"))


def grouped(columns: DataFrame) -> DataFrame:
    """One row per table with its columns in order."""
    return columns.groupBy("source_id", "database", "table").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "column", "type"))), lambda c: F.concat(c["column"], F.lit(":"), c["type"])).alias("columns"))


def newest_nodes(nodes: DataFrame) -> DataFrame:
    """Of each (tenant_id, node_id) the last write."""
    return nodes.withColumn("n", F.row_number().over(W.partitionBy("tenant_id", "node_id").orderBy(F.desc("at"), F.desc("seq")))).where("n = 1").drop("n")


def overlaid(columns: DataFrame, descriptions: DataFrame) -> DataFrame:
    """The columns with the best description: human before catalog before model, then by confidence, then by method, then by text. A method without a rank comes after all that have one.

    ``descriptions``: node_id, method (one of the ranks, or ``model:name@version``), confidence, description, review_state; rejected ones don't count.
    """
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in METHOD_RANK.items() for x in kv]), F.substring_index("method", ":", 1)), F.lit(len(METHOD_RANK)))
    best = descriptions.where("review_state IN ('APPROVED', 'AUTO_ASSERTED')").withColumn("rank", rank)
    best = best.groupBy("node_id").agg(F.min_by(F.struct("description", "method"), F.struct("rank", -F.col("confidence"), "method", "description")).alias("x")).select("node_id", "x.*")
    return columns.join(best, "node_id", "left")


def words_of(nodes: DataFrame, claims: DataFrame) -> DataFrame:
    """Per node its approved synonyms and topics, sorted and distinct."""
    good = claims.where("review_state IN ('APPROVED', 'AUTO_ASSERTED')")
    per = good.groupBy("node_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("predicate") == p, F.col("value")))).alias(n) for p, n in (("HAS_SYNONYM", "synonyms"), ("CONCERNS_TOPIC", "topics"))])
    none = F.array().cast("array<string>")
    return nodes.join(per, "node_id", "left").select(*nodes.columns, F.coalesce("synonyms", none).alias("synonyms"), F.coalesce("topics", none).alias("topics"))


def lineage(metrics: DataFrame, tables: DataFrame) -> DataFrame:
    """metric_id, table_name of the approved metrics (no status is approved) and the known tables that they read."""
    return metrics.where("coalesce(status, 'approved') = 'approved'").select("metric_id", F.explode("tables").alias("table_name")).distinct().join(tables.select("table_name").distinct(), "table_name", "left_semi")
