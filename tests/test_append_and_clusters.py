"""Appends by day prune what they compare with; the quality of clusters tells good labels from dealt ones."""

import datetime as dt
import tempfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumenlog.operators import assembly, clusters, embedding

T0 = dt.datetime(2024, 1, 1)
NOW = "2024-03-01"


def folders():
    root = tempfile.mkdtemp(prefix="append-")
    return f"{root}/table", f"{root}/progress"


def rows(spark, ids, days=20):
    at = lambda i: None if i % 50 == 49 else T0 + dt.timedelta(days=i % days, seconds=i)
    return spark.createDataFrame([(i, at(i), [float(i)]) for i in ids], "eventId bigint, timestamp timestamp, embedding array<double>")


def append(spark, df, table, progress, **how):
    return embedding.append_by_day(df, table, progress, "events", F.lit(NOW).cast("timestamp"), **how)


def test_append_adds_each_event_once(spark):
    table, progress = folders()
    assert append(spark, rows(spark, range(100)), table, progress).error is None
    run = append(spark, rows(spark, range(50, 300)), table, progress)
    assert run.done == run.groups > 1
    append(spark, rows(spark, range(300)), table, progress)
    assert sorted(r.eventId for r in spark.read.parquet(table).collect()) == list(range(300))
    mark = embedding.read_mark(spark.read.parquet(progress), "events")
    assert mark == (T0 + dt.timedelta(days=19, seconds=279), 279)


def test_only_the_days_of_a_range_are_read(spark, monkeypatch):
    table, progress = folders()
    append(spark, rows(spark, range(400)), table, progress)
    plans, real = [], embedding.new_rows

    def watched(batch, seen, *how):
        plans.append((seen._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")), seen.select(F.col("_metadata.file_path")).distinct().count()))
        return real(batch, seen, *how)

    monkeypatch.setattr(embedding, "new_rows", watched)
    append(spark, rows(spark, range(400, 800)), table, progress, groups=5)
    assert len(plans) == 5 and all("PartitionFilters" in p and "event_date" in p.split("PartitionFilters")[1][:200] for p, _ in plans)
    files = spark.read.parquet(table).where("eventId < 400").select(F.col("_metadata.file_path")).distinct().count()
    assert sum(n for _, n in plans) <= 2 * files and max(n for _, n in plans) < files


def test_the_error_of_a_range_is_returned(spark):
    table, progress = folders()
    broken = rows(spark, range(200)).withColumn("embedding", F.when((F.col("eventId") % 20 > 15) & F.col("timestamp").isNotNull(), F.array(F.raise_error(F.lit("no vector")).cast("double"))).otherwise(F.col("embedding")))
    run = append(spark, broken, table, progress)
    assert 0 < run.done < run.groups and "no vector" in run.error
    kept = {r.eventId for r in spark.read.parquet(table).collect()}
    assert kept and all(i % 20 <= 15 or i % 50 == 49 for i in kept)
    assert append(spark, rows(spark, range(200)), table, progress).error is None
    assert sorted(r.eventId for r in spark.read.parquet(table).collect()) == list(range(200))


def test_a_failed_append_is_no_result(spark):
    """The error of a group is raised, and the next run adds what the failed one left out."""
    table, progress = folders()
    bad = F.when(F.col("eventId") == 199, F.array(F.raise_error(F.lit("no vector")).cast("double"))).otherwise(F.col("embedding"))
    every = rows(spark, range(200)).withColumn("timestamp", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("eventId")))
    go = lambda df: embedding.append_embeddings(df, table, progress, "events", F.lit(NOW).cast("timestamp"))
    with pytest.raises(PySparkException, match="no vector"):
        go(every.withColumn("embedding", bad))
    kept = sorted(r.eventId for r in spark.read.parquet(table).collect())
    assert kept == list(range(len(kept))) and 0 < len(kept) < 199
    assert embedding.read_mark(spark.read.parquet(progress), "events")[1] == kept[-1]
    assert go(every) > 1
    assert sorted(r.eventId for r in spark.read.parquet(table).collect()) == list(range(200))
    assert embedding.read_mark(spark.read.parquet(progress), "events")[1] == 199


def test_quality_tells_clusters_from_dealt_labels(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 12))
    label = rng.integers(0, 6, 600)
    x = (centres[label] + 0.3 * rng.standard_normal((600, 12))) * rng.uniform(0.1, 9, (600, 1))
    data = [(int(a), int(b), v) for a, b, v in zip(label, rng.integers(0, 6, 600), x.tolist())] + [(0, 0, None), (1, 1, [0.0] * 12), (1, 1, [1.0, None]), (2, 2, [float("nan")] * 12), (3, 3, [1.0])]
    df = spark.createDataFrame(data, "good int, dealt int, embedding array<double>").repartition(3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for name, labels in (("good", label), ("dealt", np.array([d[1] for d in data[:600]]))):
        out = {r.cluster: r for r in clusters.cluster_quality(df.where(F.size("embedding") == 12).select(F.col(name).alias("cluster"), "embedding")).collect()}
        middle = np.array([unit[labels == c].sum(0) for c in range(6)])
        near = unit @ (middle / np.linalg.norm(middle, axis=1, keepdims=True)).T
        for c in range(6):
            own = near[labels == c]
            assert out[c].members == len(own) and out[c].cohesion == pytest.approx(own[:, c].mean())
            assert out[c].nearestShare == pytest.approx((own.argmax(1) == c).mean())
        found[name] = out
    assert all(r.nearestShare > 0.95 and r.silhouette > 0.4 for r in found["good"].values())
    assert all(r.nearestShare < 0.6 and r.silhouette < 0.1 for r in found["dealt"].values())
    one = clusters.cluster_quality(df.select(F.lit(7).alias("cluster"), "embedding").where(F.size("embedding") == 12)).collect()
    assert [(r.cluster, r.nearestShare, r.silhouette) for r in one] == [(7, 1.0, None)]
    assert clusters.cluster_quality(df.limit(0).withColumnRenamed("good", "cluster")).collect() == []


def test_finalize_reads_its_input_once(spark):
    data = [("a", 2, "x"), ("a", 1, "y"), ("a", 1, "z"), (None, 1, "n"), (None, 1, "n"), (None, 2, "n"), ("b", None, "w")]
    df = spark.createDataFrame(data, "requestId string, at int, v string")
    out = assembly.finalize_once(df, ["at", "v"])
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [("a", 1, "y"), (None, 1, "n"), (None, 1, "n"), (None, 2, "n"), ("b", None, "w")]))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1 and out.columns == df.columns


def test_the_append_queries_embed_once(spark, sf_dir, monkeypatch):
    """No range of a run computes vectors again: what is appended is read, not embedded."""
    from lumenlog.catalog import load
    from lumenlog.session import ship_package

    plans = []

    def watch(name):
        real = getattr(embedding, name)

        def watched(rows, *args, **how):
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
            return real(rows, *args, **how)

        monkeypatch.setattr(embedding, name, watched)

    watch("append_by_day")
    watch("append_embeddings")
    ship_package(spark)
    for name in ("f9_append_by_day", "f9_append_and_mark"):
        load()[0][name](spark, sf_dir)
    assert len(plans) == 5 and not any("EvalPython" in p for p in plans)
