"""The stored vector index: probe order, recall, reads that grow more slowly than the table, hot keys."""

import itertools
import random
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lumenlog.operators import retrieval
from lumenlog.operators import vector_index as vi


def folder():
    return tempfile.mkdtemp(prefix="index-")


def frame(spark, x, first=0):
    rows = [(first + i, v, "s", None) for i, v in enumerate(x.tolist())]
    return spark.createDataFrame(rows, "eventId long, embedding array<double>, service string, timestamp timestamp").repartition(4)


def test_cheapest_flips_first():
    rng = random.Random(3)
    for bits in (1, 3, 7):
        margins = np.array([rng.random() for _ in range(bits)])
        cost = lambda mask: sum(margins[i] ** 2 for i in range(bits) if mask >> i & 1)  # noqa: B023, E731
        masks = vi.flips(margins, 1 << bits)
        assert sorted(masks) == list(range(1 << bits)) and masks[0] == 0
        assert all(cost(a) <= cost(b) + 1e-12 for a, b in itertools.pairwise(masks)) and vi.flips(margins, 3) == masks[:3]


def near(spark, x, n_queries=40):
    v = frame(spark, x)
    plan = vi.build_index(v, folder(), x.shape[1], recall=0.95)
    q = frame(spark, x[:n_queries] + 0.1).select(F.col("eventId").alias("queryId"), "embedding")
    got = {(r.queryId, r.eventId): r.score for r in vi.indexed_top_k(q, v, plan, 5).collect()}
    exact = {(r.queryId, r.eventId): r.score for r in retrieval.top_k(q, v, 5).collect()}
    assert all(abs(s - exact[p]) < 1e-9 for p, s in got.items() if p in exact)
    reads = vi.probed_entries(q, plan).count() / n_queries
    assert vi.read_plan(spark, plan.path) == plan
    return plan, len(got.keys() & exact.keys()) / len(exact), reads


def test_recall_and_reads(spark):
    """Sixteen times the vectors: recall holds, and a query reads far less than sixteen times the rows."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 32))
    x = centres[rng.integers(0, 40, 16_000)] + 0.7 * rng.standard_normal((16_000, 32))
    small, recall_small, reads_small = near(spark, x[:1000])
    large, recall_large, reads_large = near(spark, x)
    assert recall_small >= 0.9 and recall_large >= 0.9 and small.recall >= 0.95 and large.recall >= 0.95
    assert large.bits == small.bits + 4 and reads_large < 8 * reads_small


def test_hot_key_is_split(spark, monkeypatch):
    monkeypatch.setattr(vi, "HOT_ROWS", 50)
    rng = np.random.default_rng(2)
    x = np.vstack([np.tile(rng.standard_normal(8), (300, 1)), rng.standard_normal((200, 8))])
    v = frame(spark, x)
    plan = vi.build_index(v, folder(), 8)
    entries = spark.read.parquet(f"{plan.path}/entries")
    assert entries.count() == vi.BANDS * 500 and entries.groupBy("band", "key", "part").count().agg(F.max("count")).first()[0] < 120
    q = v.where("eventId IN (3, 400)").select(F.col("eventId").alias("queryId"), "embedding")
    out = vi.indexed_top_k(q, v, plan, 5).collect()
    assert [r.eventId for r in sorted(out, key=lambda r: (r.queryId, r.rank)) if r.queryId == 3] == [0, 1, 2, 3, 4]
    assert [r.eventId for r in out if r.queryId == 400 and r["rank"] == 1] == [400]


def test_odd_vectors_and_empty_tables(spark):
    schema = "eventId long, embedding array<double>, service string, timestamp timestamp"
    rows = [(1, [1.0, 0.0], None, None), (2, None, None, None), (3, [0.0, 0.0], None, None), (4, [1.0], None, None), (5, [0.9, 0.1], None, None)]
    v = spark.createDataFrame(rows, schema)
    plan = vi.build_index(v, folder(), 2)
    q = v.select(F.col("eventId").alias("queryId"), "embedding")
    assert sorted((r.queryId, r.eventId) for r in vi.indexed_top_k(q, v, plan, 2).collect() if r["rank"] == 1) == [(1, 1), (5, 5)]
    empty = vi.build_index(v.limit(0), folder(), 2)
    assert vi.indexed_top_k(q, v, empty, 2).collect() == [] == vi.indexed_top_k(q.limit(0), v, plan, 2).collect()


def test_recall_where_signatures_hardly_tell(spark):
    """Vectors without structure: as many candidates are scored as the sample needs, not a fixed number."""
    x = np.random.default_rng(8).standard_normal((10_000, 64))
    v = frame(spark, x)
    plan = vi.build_index(v, folder(), 64)
    q = v.where("eventId % 100 = 0").select(F.col("eventId").alias("queryId"), "embedding")
    got = {(r.queryId, r.eventId) for r in vi.indexed_top_k(q, v, plan, 5).collect()}
    exact = {(r.queryId, r.eventId) for r in retrieval.top_k(q, v, 5).collect()}
    assert len(got) == len(exact) == 500 and len(got & exact) >= 450
    assert plan.candidates > 100


def test_all_cheapest_flips_at_once():
    for bits, n in ((1, 1), (3, 5), (7, 40), (12, 200), (5, 100)):
        margins = np.random.default_rng(bits).random((20, bits))
        assert [sorted(m) for m in vi.cheapest(margins, n).tolist()] == [sorted(vi.flips(m, n)) for m in margins]


def test_many_queries_get_the_answers_of_few(spark, monkeypatch):
    """Queries in blocks find what each finds alone, also by keys too long for a table, and no probed entry becomes a row."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((3000, 24))
    x[100:160] = x[100]  # copies
    v = frame(spark, x).unionByName(frame(spark, x[:5])).unionByName(frame(spark, np.zeros((2, 24)), first=3000))
    v = v.unionByName(spark.createDataFrame([(3002, None, None, None), (3003, [1.0], None, None)], v.schema))
    plan = vi.build_index(v, folder(), 24)
    q = v.where("eventId % 5 = 0 OR eventId < 200 OR eventId >= 3000").select(F.col("eventId").alias("queryId"), "embedding")
    rows = lambda df: sorted((r.queryId, r.eventId, round(r.score, 9), r["rank"]) for r in df.collect())
    alone = [part for a in range(4) for part in rows(vi.indexed_top_k(q.where(F.pmod(F.xxhash64("queryId"), F.lit(4)) == a), v, plan, 5))]
    assert q.count() > vi.FEW_QUERIES
    monkeypatch.setattr(vi, "probed_entries", None)
    together = rows(vi.indexed_top_k(q, v, plan, 5))
    assert together == sorted(alone) and len(together) > 3500
    monkeypatch.setattr(vi, "BLOCK_ROWS", 700)  # a block's nearest by signature are more than those of all
    exact = {(r.queryId, r.eventId) for r in retrieval.top_k(q.where("queryId < 3000"), v, 5).collect()}
    hits = lambda found: len({f[:2] for f in found} & exact)
    assert hits(rows(vi.indexed_top_k(q, v, plan, 5))) >= hits(together) >= 0.9 * len(exact)


def test_keys_without_a_table():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16))
    plan = vi.IndexPlan("", 16, 6, 9, 1.0, 400, 7)
    product = x / np.linalg.norm(x, axis=1, keepdims=True) @ plan.planes()
    keys, signs = vi._keys(product, 6), vi._signature(product, 6)
    index = {"eventId": np.arange(400), "keys": keys.tolist(), **{f"s{i}": signs[:, i] for i in range(4)}}
    table = pa.concat_tables([pa.table({**index, "_vector": [False] * 400}), pa.table({"eventId": np.arange(400), "embedding": x.tolist(), "_vector": [True] * 400})], promote_options="default")
    asked = pa.table({"queryId": np.arange(50), "_q": x[:50].tolist()})
    tile = vi._Tile(table, plan)
    by_table = tile.best(asked, 5, 60)
    tile.table = None
    assert all((a == b).all() for one, two in zip(by_table, tile.best(asked, 5, 60), strict=True) for a, b in zip(one, two, strict=True))
    for q, ids, _ in by_table:
        near = {i for i in range(400) if any(keys[i][b] ^ keys[q[0]][b] in vi.flips(np.abs(product[q[0], b * 6 : b * 6 + 6]), 9) for b in range(vi.BANDS))}
        far = sorted(near, key=lambda i: (int(sum(bin(int(w) & (1 << 64) - 1).count("1") for w in signs[i] ^ signs[q[0]])), i))[:60]
        score = {i: round(float(x[i] @ x[q[0]] / np.linalg.norm(x[i]) / np.linalg.norm(x[q[0]])), 12) for i in far}
        assert ids.tolist() == sorted(score, key=lambda i: (-score[i], i))[:5]
