"""Snapshots and retention: what a reader sees at every point, and what a broken run leaves."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.sources import retention
from lumenlog.sources.files import Files
from lumenlog.sources.snapshots import SnapshotTable

SCHEMA = T.StructType().add("source", "string").add("mark", "long").add("at", "timestamp")
T0 = dt.datetime(2024, 1, 1)


def folder(name="t"):
    return tempfile.mkdtemp(prefix="tables-") + f"/{name}"


def snapshots(spark, order="at", **how):
    return SnapshotTable(spark, folder(), SCHEMA, "source", order, **how)


def rows_of(df):
    return sorted((r.source or "", r.mark) for r in df.collect())


def marks(spark, *rows):
    return spark.createDataFrame([(s, m, T0 + dt.timedelta(minutes=at)) for s, m, at in rows], SCHEMA)


def test_files_claimed_once(spark):
    files, path = Files(spark), folder("x y%/name")
    assert files.claim(path, "eins ü") and not files.claim(path, "zwei") and files.read(path) == "eins ü"
    assert files.names(os.path.dirname(path)) == ["name"] and files.names(path + "-none") == []


def test_fifty_upserts_leave_few_files(spark):
    t = snapshots(spark, max_deltas=5)
    assert t.read().collect() == [] and t.versions() == []
    for i in range(50):
        t.upsert(marks(spark, (f"s{i % 3}", i, i), (None, i, i)))
    assert rows_of(t.read()) == [("", 49), ("s0", 48), ("s1", 49), ("s2", 47)]
    found = [f for _, _, names in os.walk(t.path) for f in names if not f.endswith(".crc") and f != "_SUCCESS"]
    assert len(found) < 20 and len(t.versions()) <= 3


def test_newest_row_wins_whatever_the_order_of_writes(spark):
    t = snapshots(spark, max_deltas=100, keep=10)
    for rows in ([("a", 1, 10)], [("a", 2, 5)], [("a", 3, 10)], [("b", 4, 0), ("b", 5, 9)]):
        t.upsert(marks(spark, *rows))
    assert rows_of(t.read()) == [("a", 3), ("b", 5)] and rows_of(t.read(2)) == [("a", 1)]
    t.compact()
    assert rows_of(t.read()) == [("a", 3), ("b", 5)] and t._manifest()["deltas"] == []
    last = snapshots(spark, order=None)
    for m in (9, 2, 4):
        last.upsert(marks(spark, ("a", m, -m)))
    assert rows_of(last.read()) == [("a", 4)]


def test_reader_keeps_its_state_and_broken_writers_change_nothing(spark, monkeypatch):
    t = snapshots(spark)
    t.upsert(marks(spark, ("a", 1, 1)))
    before = t.read()
    monkeypatch.setattr(SnapshotTable, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        t.upsert(marks(spark, ("a", 2, 2)))
    monkeypatch.undo()
    assert rows_of(t.read()) == [("a", 1)]
    t.upsert(marks(spark, ("a", 3, 3)))
    assert rows_of(before) == [("a", 1)] and rows_of(t.read()) == [("a", 3)]


def test_two_writers(spark, monkeypatch):
    """Another upsert gets the number first, or comes while deltas are merged: neither is lost."""
    t = snapshots(spark, max_deltas=100, keep=100)
    t.upsert(marks(spark, ("a", 1, 1)))
    commit, once = SnapshotTable._commit, []

    def raced(self, *args):
        if not once:
            once.append(1)
            self.upsert(marks(spark, ("b", 2, 2)))
        return commit(self, *args)

    monkeypatch.setattr(SnapshotTable, "_commit", raced)
    t.upsert(marks(spark, ("c", 3, 3)))
    assert rows_of(t.read()) == [("a", 1), ("b", 2), ("c", 3)]
    once.clear()
    monkeypatch.setattr(SnapshotTable, "_commit", raced)
    t.compact()
    assert rows_of(t.read()) == [("a", 1), ("b", 2), ("c", 3)] and len(t._manifest()["deltas"]) == 1


def event_table(spark, days=40):
    path = folder("events table")
    rows = [(i, T0 + dt.timedelta(hours=i)) for i in range(24 * days)]
    df = spark.createDataFrame(rows, "eventId bigint, timestamp timestamp").withColumn("event_date", F.to_date("timestamp"))
    df.write.partitionBy("event_date").parquet(path)
    return path, folder("archive")


TODAY = dt.date(2024, 2, 10)  # days before 11 January expire


def ids(df):
    return sorted(r.eventId for r in df.select("eventId").collect()) if df is not None else []


def check(spark, table, archive, days=40):
    assert ids(retention.read_archive(spark, archive)) == list(range(240)) and ids(spark.read.parquet(table)) == list(range(240, 24 * days))


def test_a_second_run_changes_nothing(spark):
    table, archive = event_table(spark)
    assert retention.read_archive(spark, archive) is None
    assert retention.expire_days(spark, table, archive, TODAY)
    check(spark, table, archive)
    assert retention.expire_days(spark, table, archive, TODAY) is None
    check(spark, table, archive)
    assert retention.expire_days(spark, table, archive, TODAY + dt.timedelta(days=1))
    assert ids(retention.read_archive(spark, archive)) == list(range(264))


def test_broken_runs_lose_nothing(spark, monkeypatch):
    def lost(*_):
        raise RuntimeError("lost")

    table, archive = event_table(spark)
    monkeypatch.setattr(Files, "claim", lost)  # after the copy, before the record
    with pytest.raises(RuntimeError):
        retention.expire_days(spark, table, archive, TODAY)
    monkeypatch.undo()
    assert len(ids(spark.read.parquet(table))) == 960 and retention.read_archive(spark, archive) is None
    monkeypatch.setattr(retention, "_delete_copied", lost)  # after the record, before the deletion
    with pytest.raises(RuntimeError):
        retention.expire_days(spark, table, archive, TODAY)
    monkeypatch.undo()
    assert len(ids(spark.read.parquet(table))) == 960 and ids(retention.read_archive(spark, archive)) == list(range(240))
    # late rows of an expired day come in before the run goes on
    late = spark.createDataFrame([(5000, T0)], "eventId bigint, timestamp timestamp").withColumn("event_date", F.to_date("timestamp"))
    late.write.mode("append").partitionBy("event_date").parquet(table)
    retention.finish_runs(spark, archive)
    assert ids(spark.read.parquet(table)) == [*range(240, 960), 5000]
    retention.expire_days(spark, table, archive, TODAY)
    assert ids(retention.read_archive(spark, archive)) == [*range(240), 5000] and ids(spark.read.parquet(table)) == list(range(240, 960))


def test_only_expired_days_are_read(spark):
    table, _ = event_table(spark)
    rows = retention.expired(spark.read.parquet(table), TODAY)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    assert "PartitionFilters: [isnotnull(event_date" in rows._jdf.queryExecution().explainString(mode)
    days = {r.d for r in rows.select(F.regexp_extract(F.col("_metadata.file_path"), "event_date=([0-9-]+)", 1).alias("d")).distinct().collect()}
    assert days == {f"2024-01-{d:02d}" for d in range(1, 11)}
