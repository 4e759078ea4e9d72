"""Partitions are replaced and removed for real, and no others."""

import pytest

from cairn.operators.partitions import NotReplaced, PartitionedTable, reset


def made(spark, path):
    rows = spark.createDataFrame([(k, f"t{k % 3}", k * 2) for k in range(30)], "id long, tenant string, n long")
    return PartitionedTable(spark, str(path), "tenant").create(rows)


def others(t, *but):
    return {f: x for f, x in t.files().items() if not any(f"tenant={b}/" in f for b in but)}


def test_only_the_replaced_partition_changes(spark, tmp_path):
    t = made(spark, tmp_path / "t")
    before = others(t, "t1")
    new = spark.createDataFrame([(100, "t1", 1), (101, "t1", 2)], "id long, tenant string, n long")
    for _ in range(2):
        assert t.replace(new, 2) == {"t1": 2}
        assert others(t, "t1") == before and sorted(r.id for r in t.read("t1").collect()) == [100, 101] and t.read().count() == 22
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_wrong_replacement_leaves_the_table(spark, tmp_path):
    t = made(spark, tmp_path / "t")
    before = t.files()
    rows = spark.createDataFrame([(1, "t0", 1), (2, None, 1)], "id long, tenant string, n long")
    for bad, expected in ((rows, None), (rows.limit(0), None), (rows.where("tenant IS NOT NULL"), 5)):
        with pytest.raises(NotReplaced):
            t.replace(bad, expected)
    assert t.files() == before and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_removal_and_reset(spark, tmp_path):
    a, b = made(spark, tmp_path / "a"), made(spark, tmp_path / "b")
    kept, whole = others(a, "t2"), b.files()
    assert reset({"a": a, "b": b}, "t2", {"a"}) == {"a": ["t2"]} and a.files() == kept and b.files() == whole
    assert a.remove("t2", "nobody") == [] and {r.tenant for r in a.read().collect()} == {"t0", "t1"}


def test_upsert_reads_and_writes_its_partitions(spark, tmp_path):
    t = made(spark, tmp_path / "t")
    before = others(t, "t0")
    new = spark.createDataFrame([(0, "t0", 99), (3, "t0", 1), (300, "t0", 5)], "id long, tenant string, n long")
    assert t.upsert(new, "id", "n") == {"t0": 11} and others(t, "t0") == before
    assert {r.id: r.n for r in t.read("t0").collect()} == {k: 2 * k for k in range(0, 30, 3)} | {0: 99, 300: 5}


def test_the_fact_table_is_written_without_a_sort(spark, sf, monkeypatch):
    """A task holds a file for each tenant open; with Spark's default it sorts all its rows by tenant."""
    from pyspark.sql import DataFrameWriter
    from cairn.sources import derived

    name, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    monkeypatch.setattr(derived, "_STORED", {})
    plain = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(int(spark.conf.get(name, "0"))), plain(self, *a, **k))[1])
    before = spark.conf.get(name, "0")
    assert derived.facts(spark, sf).select("tenant_id").distinct().count() == 2
    assert seen and min(seen) >= 2 and spark.conf.get(name, "0") == before
