"""Incident clusters of summary vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.functions import vectors as vx
from lumenlog.session import materialize


def assign_clusters(embedded: DataFrame, k: int = 20, seed: int = 7, max_iter: int = 20) -> DataFrame:
    """Cosine k-means over the embeddings; zero vectors have no direction and are left out.

    Training aggregates k centres per task, so nothing but the centres moves. The
    input is written once, because every iteration reads it again.
    """
    nonzero = materialize(embedded.filter(F.exists("embedding", lambda x: x != 0)), "cluster-input")
    rows = nonzero.withColumn("_vec", array_to_vector("embedding"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, distanceMeasure="cosine", featuresCol="_vec", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("_vec")


def cluster_quality(assigned: DataFrame) -> DataFrame:
    """Per cluster: size, mean cosine of its members to its own centre and to the best other one, the share of members
    nearest to their own centre, and the mean simplified silhouette.

    Centres are the means of the members' directions: one vector per cluster comes to the driver. Vectors of another
    length than their cluster's centre, null and zero ones are left out. A single cluster has no other centre: its
    silhouette is null and all its members are nearest.
    """
    unit = assigned.select(F.col("cluster").cast("int").alias("cluster"), F.col("embedding").cast("array<double>").alias("v"))
    unit = unit.withColumn("n", vx.norm(F.col("v"))).where((F.col("n") > 0) & ~F.isnan("n"))
    unit = unit.select("cluster", F.transform("v", lambda x: F.try_divide(x, F.col("n"))).alias("v"))
    sums = unit.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c")).collect()
    rows = sorted((r for r in rows if any(r["c"])), key=lambda r: r["cluster"])
    names = [r["cluster"] for r in rows]
    width = max((len(r["c"]) for r in rows), default=1)
    centres = np.array([list(r["c"]) + [0.0] * (width - len(r["c"])) for r in rows]).reshape(len(rows), width)
    centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {c: i for i, c in enumerate(names)}
        for batch in batches:
            cluster = batch["cluster"].to_pylist()
            known = [i for i, (c, v) in enumerate(zip(cluster, batch["v"], strict=True)) if c in place and len(v) == width]
            if not known:
                continue
            x = np.array(batch["v"].take(pa.array(known)).to_pylist(), dtype=float)
            near = x @ centres.T
            own = np.array([place[cluster[i]] for i in known])
            mine = near[np.arange(len(own)), own].copy()
            near[np.arange(len(own)), own] = -np.inf
            other = near.max(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([cluster[i] for i in known], pa.int32()), pa.array(mine), pa.array([None if np.isinf(o) else o for o in other], pa.float64())],
                ["cluster", "own", "other"],
            )

    a, b = 1 - F.col("own"), 1 - F.col("other")
    found = unit.select("cluster", "v").mapInArrow(compare, "cluster int, own double, other double")
    return found.groupBy("cluster").agg(
        F.count("*").alias("members"),
        F.avg("own").alias("cohesion"),
        F.avg("other").alias("otherCohesion"),
        F.avg(F.coalesce(F.col("own") >= F.col("other") - 1e-12, F.lit(True)).cast("double")).alias("nearestShare"),
        F.avg((b - a) / F.greatest(a, b, F.lit(1e-12))).alias("silhouette"),
    )


def related_traces(assigned: DataFrame) -> DataFrame:
    """Request ids per cluster, one row each; a cluster may hold any share of the events."""
    return assigned.select(F.col("cluster").alias("incidentId"), "requestId").distinct()


def incident_summary(assigned: DataFrame) -> DataFrame:
    """One row per cluster: size, first event, share of errors and severity."""
    share = F.col("errors") / F.col("events")
    return (
        assigned.groupBy(F.col("cluster").alias("incidentId"))
        .agg(
            F.count("*").alias("events"),
            F.count("error").alias("errors"),
            F.min("timestamp").alias("startTime"),
            F.max("timestamp").alias("lastTime"),
            F.approx_count_distinct("requestId").alias("traces"),
        )
        .withColumn("severity", F.when(share > 0.5, "ERROR").when(F.col("errors") > 0, "WARN").otherwise("NORMAL"))
    )


def cluster_incidents(embedded: DataFrame, k: int = 20, seed: int = 7) -> DataFrame:
    return incident_summary(assign_clusters(embedded, k, seed))
