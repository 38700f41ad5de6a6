"""Retention on the stored event table: expired days go to an archive, and then from the table.

A run copies the files of the expired days to a folder of its own, commits a record that names it, and only
then deletes exactly the files it has copied. Broken before the record, it has changed nothing that
anybody reads; broken after it, the next run deletes the rest. What is appended to an expired day while a
run goes on lies in other files and waits for the next run.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.sources.files import Files


def expired(events: DataFrame, today: dt.date, days: int = 30) -> DataFrame:
    """Rows of days that ended more than ``days`` before ``today`` began: a filter on the partition column alone."""
    return events.where(F.col("event_date") < F.lit(today - dt.timedelta(days=days)))


def expire_days(spark: SparkSession, table: str, archive: str, today: dt.date, days: int = 30) -> str | None:
    """Move the expired days of the table (partitioned by ``event_date``) to the archive; the run's name, None without any.

    Whole days expire: a row is kept for ``days`` days and the rest of its own. A second run finds nothing to do.
    """
    finish_runs(spark, archive)
    rows = expired(spark.read.parquet(table), today, days)  # its list of files is fixed from here on
    run = uuid.uuid4().hex
    copied = f"{archive}/files/{run}"
    rows.select(F.col("_metadata.file_path").alias("file")).distinct().write.parquet(copied)
    if spark.read.schema("file string").parquet(copied).isEmpty():
        Files(spark).delete(copied)
        return None
    rows.write.partitionBy("event_date").parquet(f"{archive}/rows/run={run}")
    record = json.dumps({"run": run, "before": (today - dt.timedelta(days=days)).isoformat()})
    Files(spark).claim(f"{archive}/_runs/{run}", record)
    finish_runs(spark, archive)
    return run


def finish_runs(spark: SparkSession, archive: str) -> None:
    """Delete from the table what committed runs have copied; a run that is done has a mark."""
    files = Files(spark)
    done = set(files.names(f"{archive}/_done"))
    for run in files.names(f"{archive}/_runs"):
        if run not in done and not run.startswith("_"):
            _delete_copied(spark, files, f"{archive}/files/{run}")
            files.claim(f"{archive}/_done/{run}", "")


def _delete_copied(spark: SparkSession, files: Files, copied: str) -> None:
    for row in spark.read.schema("file string").parquet(copied).toLocalIterator():
        files.delete_uri(row["file"])  # one that is gone already is no error


def read_archive(spark: SparkSession, archive: str) -> DataFrame | None:
    """The archived rows of committed runs; None without any."""
    runs = [r for r in Files(spark).names(f"{archive}/_runs") if not r.startswith("_")]
    if not runs:
        return None
    return spark.read.parquet(f"{archive}/rows").where(F.col("run").cast("string").isin(runs)).drop("run")
