import numpy as np
import pytest

from lumenlog.llm import posting_ann as A
from lumenlog.llm.common import table
from lumenlog.llm.queries import op7_posting_ann


def brute(rows, k=20):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], dtype=float)
    out = {}
    for i, q in zip(ids, v, strict=True):
        if i % 20 == 0:
            s = (v * q).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


def lists(out):
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_recall_on_embeddings(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    want, got = brute(rows), lists(op7_posting_ann(spark, sf).collect())
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit / (20 * len(want)) >= 0.9
    exact = dict(rows)
    for q, found in got.items():
        for i, s in found:
            assert s == pytest.approx(float(np.dot(np.array(exact[q], float), np.array(exact[i], float))), abs=1e-12)


def test_blocks_of_queries_change_nothing(spark):
    """Many blocks of queries give the rows of one block."""
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    whole = A.nearest_neighbours(df, query_every=3).collect()
    cut = A.nearest_neighbours(df, query_every=3, asked_rows=40)
    assert {tuple(r) for r in cut.collect()} == {tuple(r) for r in whole}
    assert len({r.query_id for r in whole}) > 4 * 40  # five blocks


def test_graph_search_finds_the_nearest():
    rng = np.random.default_rng(0)
    c = rng.normal(size=(600, 12))
    points = rng.normal(size=(50, 12))
    near, d = A.CentroidGraph(c).nearest(points, 10, 96)
    full = ((points[:, None] - c) ** 2).sum(2)
    want = np.argsort(full, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(near, want, strict=True)]) > 0.95
    assert np.allclose(d, np.take_along_axis(full, near, 1), atol=1e-3)


def test_centroids_are_balanced():
    x = np.random.default_rng(1).normal(size=(3000, 8)) * np.array([9, 5, 1, 1, 1, 1, 1, 1])
    c = A.balanced_centroids(x, 30)
    size = np.bincount(((x[:, None] - c) ** 2).sum(2).argmin(1), minlength=len(c))
    assert len(c) == 30 and size.max() <= 5 * 100


def test_ties_hot_vectors_and_edges(spark):
    rng = np.random.default_rng(3)
    hot = [4.0, 2.0, 1.0]
    rows = [(i, hot) for i in range(0, 300)] + [(i, rng.normal(size=3).tolist()) for i in range(300, 420)]
    bad = [(1000, None), (1020, [0.0, 0.0, 0.0]), (1040, [1.0, None, 2.0]), (1060, [float("nan"), 1.0, 1.0]), (1080, [float("inf"), 1.0, 0.0]), (None, hot)]
    frame = spark.createDataFrame(rows + rows[:40] + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score")
    want, got = brute(rows), lists(A.nearest_neighbours(frame, part_rows=16, list_size=8).collect())
    assert got.keys() == want.keys()
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]] and [i for i, _ in got[280]] == [i for i, _ in want[280]]
    hit = sum(len({s for _, s in got[q]} & {s for _, s in want[q]}) / len({s for _, s in want[q]}) for q in want)
    assert hit / len(want) > 0.95
    few = spark.createDataFrame([(0, hot), (5, hot), (7, [3.0, 0.0, 0.0]), (20, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert lists(A.nearest_neighbours(few).collect()) == {0: [(5, 21.0), (7, 12.0)]}
    assert A.nearest_neighbours(few.limit(0)).collect() == []


def test_groups_meet_in_every_partition(spark):
    """Both sides of a group lie in one partition, also where no small partitions are merged."""
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    merged = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = lists(A.nearest_neighbours(df).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    assert got.keys() == want.keys()
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 20 * len(want)


def test_short_queries_find_their_neighbours(spark):
    """A query's length changes neither its neighbours nor the lists that are searched for it."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::20] *= 0.01
    rows = list(enumerate(x.tolist()))
    want, got = brute(rows), lists(A.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), list_size=5).collect())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 20 * len(want)
