"""Scans across ranges, and states from snapshots, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import lifecycle as L, scans


def rows(n=600):
    r = random.Random(5)
    return [(None if k % 50 == 0 else "hot" if k % 2 else f"k{k % 9}", r.randrange(40), k, r.choice([None, "a", "b", "c"])) for k in range(n)]


@pytest.mark.parametrize("skip", [True, False])
def test_previous_across_ranges(spark, skip):
    given = rows()
    df = spark.createDataFrame(given, "k string, at int, seq int, v string").repartition(5)
    want, last = {}, {}
    for k, at, seq, v in sorted(given, key=lambda x: (str(x[0]), x[1], x[2])):
        want[seq] = last.get(k)
        if v is not None or not skip:
            last[k] = v
    got = {r.seq: r.before for r in scans.previous(df, "k", ["at", "seq"], "v", "before", skip).collect()}
    assert got == want
    # half of the rows are one key, and it lies in many ranges
    spread = scans._dealt(df, "k", ["at", "seq"]).where("k = 'hot'").groupBy("_range").count().collect()
    assert len(spread) >= 4 and max(r["count"] for r in spread) < 200


def test_numbers_across_ranges(spark):
    given = rows()
    df = spark.createDataFrame(given, "k string, at int, seq int, v string").repartition(5)
    want = {}
    for key in {k for k, *_ in given}:
        own = sorted((at, seq) for k, at, seq, _ in given if k == key)
        want |= {seq: (i + 1, len(own), own[0][0]) for i, (at, seq) in enumerate(own)}
    assert {r.seq: (r._n, r._total, r._first) for r in scans.numbered(df, "k", ["at", "seq"]).collect()} == want
    assert scans.numbered(df.limit(0), "k", ["at", "seq"]).count() == 0


def test_states_from_snapshots(spark, tmp_path):
    r = random.Random(3)
    names = ["approve", "reject", "supersede", "refile", "retract"]
    ev = [(f"a{r.randrange(30)}", r.choice(names), f"2024-01-{r.randrange(1, 29):02d} {r.randrange(24):02d}:00:00", k, r.choice([None, "M-1", "M-2"]), r.random() < 0.3) for k in range(200)]
    events = spark.createDataFrame(ev, "assertion_id string, event string, at string, seq int, matter_id string, descriptive boolean").withColumn("at", F.col("at").cast("timestamp"))
    facts = spark.createDataFrame([(f"a{k}", "PENDING" if k % 3 else "APPROVED", "M-0", 0.5, None) for k in range(32)], "assertion_id string, review_state string, matter_id string, confidence double, superseded_at timestamp")
    log = L.EventLog(spark, str(tmp_path / "log"))
    log.append(events)
    log.snapshot("2024-01-10 12:00:00")
    log.snapshot("2024-01-20 00:00:00")
    read = log._since("2024-01-20 00:00:00", "2024-01-25 00:00:00").select(F.input_file_name().alias("f")).distinct()
    assert "PartitionFilters: [isnotnull(day" in read._jdf.queryExecution().executedPlan().toString()
    read = [r.f for r in read.collect()]
    assert read and all("2024-01-20" <= f.split("day=")[1][:10] <= "2024-01-25" for f in read)
    for t in ("2024-01-05 00:00:00", "2024-01-10 12:00:00", "2024-01-15 06:00:00", "2024-01-31 00:00:00"):
        assert sorted(map(str, log.fold(facts, t).collect())) == sorted(map(str, L.fold(facts, events, t).collect()))


def test_a_snapshot_answers_for_its_own_moment(spark, tmp_path):
    """No event is read or merged again for the moment of a snapshot."""
    from cairn.operators import lifecycle as L

    log = L.EventLog(spark, str(tmp_path / "log"))
    rows = [("a", "approve", 5), ("b", "reject", 7), ("a", "reject", 9)]
    e = spark.createDataFrame(rows, "assertion_id string, event string, seq long")
    log.append(e.selectExpr("assertion_id", "event", "timestamp_seconds(1704067200 + seq * 86400) AS at", "seq", "CAST(NULL AS STRING) AS matter_id", "false AS descriptive"))
    log.snapshot("2024-01-09 00:00:00")
    states = log.states("2024-01-09 00:00:00")
    assert {(r.assertion_id, r.decided.event) for r in states.collect()} == {("a", "approve"), ("b", "reject")}
    assert "Exchange" not in states._jdf.queryExecution().executedPlan().toString()


def test_ids_are_packed_and_events_shuffled_once(spark, tmp_path):
    """Ids of hex digits take half their bytes in the log's files, others come back as they are; a state from a snapshot is one shuffle."""
    ids = ["00ff" * 8, "0" * 32, "00" * 16, "ab", "abc", "AB", "", "a1\u00e9", "\x01ab", "\x00", "x" * 16, "f" * 31]
    rows = [(i, ("approve", "reject", "refile")[k % 3], 3 + k % 5) for k, i in enumerate(ids) for _ in range(2)] + [(i, "approve", 20) for i in ids]
    e = spark.createDataFrame(rows, "assertion_id string, event string, seq long").selectExpr("assertion_id", "event", "timestamp_seconds(1704067200 + seq * 86400) AS at", "seq", "'M-' || seq AS matter_id", "false AS descriptive")
    facts = spark.createDataFrame([(i, "PENDING", "M-0", 0.5, None) for i in sorted({*ids, "none"})], "assertion_id string, review_state string, matter_id string, confidence double, superseded_at timestamp")
    log = L.EventLog(spark, str(tmp_path / "log"))
    log.append(e)
    kept = {bytes(r.assertion_id) for r in spark.read.parquet(str(tmp_path / "log" / "events")).collect()}
    assert len(kept) == len(set(ids)) and max(len(k) for k in kept if k[:1] == b"\1") == 17
    log.snapshot("2024-01-10 00:00:00")
    later = log.states("2024-02-01 00:00:00")
    assert later._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {r.assertion_id for r in later.collect()} == set(ids)
    for t in ("2024-01-10 00:00:00", "2024-02-01 00:00:00"):
        got = sorted(map(str, log.fold(facts, t).collect()))
        assert got == sorted(map(str, L.fold(facts, e, t).collect())) and len(got) == facts.count()
