"""Density clusters against all pairs, at thresholds that prune and at ones that can't."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlog.operators import density


def brute(ids, x, least, points):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(x @ x.T, 12) >= least
    n = near.sum(1)
    core, cluster = n >= points, {}
    for i in np.flatnonzero(core):  # ids ascend, so the first to reach a core has the smallest id
        todo = [i] if i not in cluster else []
        while todo:
            j = todo.pop()
            if j not in cluster:
                cluster[j] = i
                todo += np.flatnonzero(near[j] & core).tolist()
    out = {}
    for i, name in enumerate(ids):
        reached = [cluster[j] for j in np.flatnonzero(near[i] & core)]
        kind = "core" if core[i] else "border" if reached else "noise"
        own = cluster[i] if core[i] else min(reached, default=None)
        out[name] = (int(n[i]), kind, None if own is None else ids[own])
    return out


def points(seed, n=400):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 16))
    x = centres[rng.integers(0, 12, n)] + 0.45 * rng.standard_normal((n, 16))
    x[: n // 3] = centres[0] + 0.05 * rng.standard_normal((n // 3, 16))  # a third of all in one place
    return np.vstack([x, rng.standard_normal((40, 16))])


def frame(spark, ids, x):
    return spark.createDataFrame([(i, v) for i, v in zip(ids, x.tolist())], "eventId long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("least,points_", [(0.97, 4), (0.8, 5), (0.35, 4), (-1.0, 3)])
def test_clusters_against_all_pairs(spark, least, points_):
    x = points(int(least * 100) + 200)
    ids = [3 * i + 1 for i in range(len(x))]
    out = density.density_clusters(frame(spark, ids, x), least, points_, block_rows=32).collect()
    assert {r.id: (r.neighbours, r.kind, r.cluster) for r in out} == brute(ids, x, least, points_)


def test_no_tile_above_its_bound(spark):
    """Every cell is a guest of every cell: tiles stay at about a block on either side, and meet every pair once."""
    x = points(5, 900)
    ids = list(range(len(x)))
    rows = frame(spark, ids, x).select(F.col("eventId").alias("id"), F.col("embedding").alias("v"), F.lit(False).alias("core"))
    cells = spark.sparkContext.broadcast(density.Cells(x[:20], -1.0))
    sizes = {r.cell: (r.own, r.guests) for r in density.cell_sizes(rows, cells).collect()}
    assert {g for _, g in sizes.values()} == {len(x)} and sum(o for o, _ in sizes.values()) == len(x)
    out = density.tiles(rows, cells, sizes, 32, False).groupBy("cell", "own_block", "guest_block").agg(
        F.count_if("own").alias("own"), F.count_if(~F.col("own")).alias("guests")
    ).collect()
    assert max(max(r.own, r.guests) for r in out) <= 64 and len(out) > 500
    assert sum(r.own * r.guests for r in out) == len(x) ** 2


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "eventId long, embedding array<double>")
    out = {r.id: (r.neighbours, r.kind, r.cluster) for r in density.density_clusters(df, 0.9, 3).collect()}
    assert out == {i: (3, "core", 1) if i in (1, 2, 8) else (0, "noise", None) for i in range(1, 9)}
    assert density.density_clusters(df.limit(0), 0.9, 3).collect() == []


def test_vectors_are_sent_a_bounded_number_of_times(spark, monkeypatch):
    """Where cells leave nothing out, what the tiles hold grows with the table, not with its square."""
    sent, real = [], density.tiles

    def watched(*args):
        out = real(*args)
        sent.append(out.count())
        return out

    monkeypatch.setattr(density, "tiles", watched)
    n = 32_768
    x = np.random.default_rng(n).standard_normal((n, 16))
    assert density.density_clusters(frame(spark, list(range(n)), x), 0.7, 4).count() == n
    assert len(sent) == 2 and all(s <= 17 * n for s in sent)


def test_two_blocks_meet_once_and_one_cluster_not_again(spark, monkeypatch):
    """Where one cell holds all, every pair of blocks meets once, and what already is one cluster is not compared again."""
    n = 9000
    x = 1 + 0.3 * np.random.default_rng(4).standard_normal((n, 16))
    rows = frame(spark, list(range(n)), x).select(F.col("eventId").alias("id"), F.col("embedding").alias("v"))
    cells = spark.sparkContext.broadcast(density.Cells(x[:1], -1.0))
    met = density.tiles(rows, cells, {0: (n, n)}, 2048, True).groupBy("own_block", "guest_block").agg(F.count_if("own").alias("own"), F.count_if(~F.col("own")).alias("guests")).collect()
    assert sorted((r.own_block, r.guest_block) for r in met) == [(a, b) for a in range(5) for b in range(a, 5)]
    assert sum(r.own * r.guests for r in met) + sum(r.own * (r.own - 1) // 2 for r in met if r.own_block == r.guest_block) == n * (n - 1) // 2

    sent, real = [], density.tiles

    def watched(*args):
        out = real(*args)
        sent.append(out.count())
        return out

    monkeypatch.setattr(density, "tiles", watched)
    out = density.density_clusters(frame(spark, list(range(n)), x), 0.3, 4)
    assert out.groupBy("kind", "cluster").count().collect() == [("core", 0, n)]
    assert sent[0] <= 8 * n and sent[1:] == [0]


def test_parts_of_a_cluster_that_only_one_pair_links(spark):
    """The link is neither the first nor the last neighbour of its two cores, so only the second comparison meets it."""
    angle = {i: 0.0 for i in [*range(50), *range(200, 250)]} | {i: 60.0 for i in [*range(50, 100), *range(150, 200)]} | {100: 20.0, 120: 40.0}
    ids = sorted(angle)
    rad = np.radians([angle[i] + 0.01 * (i % 7) for i in ids])
    x = np.column_stack([np.cos(rad), np.sin(rad)])
    least = float(np.cos(np.radians(25)))
    for block_rows in (None, 16):
        out = density.density_clusters(frame(spark, ids, x), least, 3, block_rows=block_rows).collect()
        assert {r.id: (r.neighbours, r.kind, r.cluster) for r in out} == brute(ids, x, least, 3) and {r.cluster for r in out} == {0}


def test_similarities_at_the_threshold_are_taken_in_double():
    """Single floats are off by more than what parts these pairs from the threshold."""
    x = np.random.default_rng(9).standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    exact = np.round(x @ x.T, 12)
    for least in (float(exact[3, 7]), float(exact[3, 7]) + 1e-9, float(exact[5, 5]), -1.0):
        assert (density._Near(x, x, least).hits(0, 300) == (exact >= least)).all()
        assert (density._Near(x, x, least).hits(10, 200, 5) == (exact >= least)[10:200, 5:]).all()
