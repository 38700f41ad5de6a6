"""Vector search against brute force, plug-ins, incremental embedding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlog.catalog import fixtures as fx
from lumenlog.operators import embedding, retrieval

VEC = "eventId bigint, embedding array<float>, service string, timestamp timestamp"


def brute(vectors, query, k, keep=lambda v: True):
    def cos(a, b):
        a, b = np.array(a, float), np.array(b, float)
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(a @ b / n) if len(a) == len(b) and n else 0.0

    scored = [(-round(cos(query, v[1]), 12), v[0]) for v in vectors if keep(v)]
    return [i for _, i in sorted(scored)[:k]]


@pytest.fixture(scope="module")
def table():
    import datetime as dt

    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 16)).astype("float32")
    base[50:120] = base[49]  # a group of exact copies
    base[7] = 0
    t0 = dt.datetime(2024, 1, 1)
    return [(i, base[i].tolist(), f"s{i % 3}", t0 + dt.timedelta(hours=i)) for i in range(300)]


def search(spark, table, queries, k=5, **kw):
    v = spark.createDataFrame(table, VEC).repartition(6)
    q = spark.createDataFrame(queries, "queryId bigint, embedding array<float>, service string")
    out = {}
    for r in retrieval.top_k(q, v, k, **kw).orderBy("queryId", "rank").collect():
        out.setdefault(r.queryId, []).append(r.eventId)
    return out


def test_matches_brute_force(spark, table):
    queries = [(i, table[i][1], None) for i in (0, 49, 7, 200)] + [(900, [1.0, 2.0], None)]
    got = search(spark, table, queries)
    for qid, vec, _ in queries:
        assert got[qid] == brute(table, vec, 5), qid


def test_service_filter_and_relaxation(spark, table):
    queries = [(1, table[3][1], "s1"), (2, table[4][1], "absent")]
    strict = search(spark, table, queries)
    assert strict == {1: brute(table, table[3][1], 5, lambda v: v[2] == "s1")}
    relaxed = search(spark, table, queries, relax_service=True)
    assert relaxed[1] == strict[1] and relaxed[2] == brute(table, table[4][1], 5)


def test_blocks_of_queries_and_slices_of_vectors(spark, table, monkeypatch):
    monkeypatch.setattr(retrieval, "SCORED_ROWS", 7)
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 13)
    queries = [(i, table[i][1], None if i % 2 else "s0") for i in range(0, 20)]
    got = search(spark, table, queries, block_queries=3)
    for qid, vec, svc in queries:
        assert got[qid] == brute(table, vec, 5, lambda v: svc is None or v[2] == svc)


def test_an_answer_does_not_depend_on_the_other_queries(spark, sf_dir):
    vectors = fx.embedded(spark, sf_dir)
    signed = retrieval.signatures(vectors, 64, bits=8)
    many = vectors.select("eventId", "embedding").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(9))))
    many = many.select((F.col("eventId") * 10 + F.col("n")).alias("queryId"), "embedding")
    one = many.filter("queryId = 70")
    assert many.count() == 5000

    def answers(df):
        return sorted((r.eventId, r.score, r["rank"]) for r in df.filter("queryId = 70").collect())

    assert answers(retrieval.top_k(many, vectors, 5)) == answers(retrieval.top_k(one, vectors, 5))
    ann = dict(k=5, dim=64, bits=8, factor=1)
    assert answers(retrieval.ann_top_k(many, signed, **ann)) == answers(retrieval.ann_top_k(one, signed, **ann))


def test_many_queries_are_one_group_per_tile(spark, sf_dir):
    """The plan is the same for any number of queries beyond a block, and none of them comes to the driver."""
    vectors = fx.embedded(spark, sf_dir)
    signed = retrieval.signatures(vectors, 64, bits=64)

    def plans(copies):
        queries = vectors.select(F.col("eventId").alias("queryId"), "embedding").crossJoin(spark.range(copies).withColumnRenamed("id", "n"))
        queries = queries.select((F.col("queryId") * 100 + F.col("n")).alias("queryId"), "embedding")
        found = retrieval.top_k(queries, vectors, 3, block_queries=50), retrieval.ann_top_k(queries, signed, 3, 64, bits=64, block_queries=50)
        return [df._jdf.queryExecution().optimizedPlan().toString().count("\n") for df in found], found[0]

    few, many = plans(1), plans(7)
    assert few[0] == many[0] and many[1]._jdf.queryExecution().executedPlan().toString().count("FlatMapCoGroups") == 1


def test_approximate_search_leaves_out_null_and_odd_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [0.9, 0.1, 0.0]), (5, [-1.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "eventId bigint, embedding array<double>")
    signed = retrieval.signatures(vectors, 3, bits=32)
    assert {r.eventId for r in signed.filter("signature IS NULL").collect()} == {2, 3}
    queries = vectors.withColumnRenamed("eventId", "queryId")
    got = retrieval.ann_top_k(queries, signed, 2, 3, bits=32).collect()
    assert {r.queryId for r in got} == {1, 4, 5} and [r.eventId for r in sorted(got, key=lambda r: r["rank"]) if r.queryId == 1] == [1, 4]
    assert retrieval.ann_top_k(queries.limit(0), signed, 2, 3).collect() == []


def test_empty_sides(spark, table):
    assert search(spark, table, []) == {}
    assert search(spark, [], [(1, table[0][1], None)]) == {}


def test_approximate_search_recall(spark, sf_dir):
    from lumenlog.catalog.retrieval_queries import label_queries

    vectors = fx.embedded(spark, sf_dir)
    queries = label_queries(spark, sf_dir)
    exact = {(r.queryId, r.eventId) for r in retrieval.top_k(queries, vectors, 5).collect()}
    near = {(r.queryId, r.eventId) for r in retrieval.ann_top_k(queries, retrieval.signatures(vectors, 64), 5, 64).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_rerank_keeps_first_order_on_ties(spark):
    rows = [(1, 10, 0.9, 1, "a b", "x"), (1, 11, 0.8, 2, "a b", "b a"), (1, 12, 0.7, 3, "a b", "a"), (1, 13, 0.6, 4, "a b", "z")]
    df = spark.createDataFrame(rows, "queryId bigint, eventId bigint, score double, rank bigint, ask string, doc string")
    got = [r.eventId for r in retrieval.rerank(df, "ask", "doc", 3).orderBy("rank").collect()]
    assert got == [11, 12, 10]
    by_length = lambda q, d: F.length(d).cast("double")
    assert retrieval.rerank(df, "ask", "doc", 1, by_length).first().eventId == 11


def test_embedder_plug_in_sees_groups_of_fifty(spark):
    df = spark.range(0, 120, 1, 1).select(F.col("id").alias("eventId"), F.col("id").cast("string").alias("t"))

    def embedder(texts):
        return [[float(len(texts)), float(len(t))] for t in texts]

    rows = embedding.embed_rows(df, F.col("t"), embedder, "m").orderBy("eventId").collect()
    assert [r.embedding[0] for r in rows] == [50.0] * 100 + [20.0] * 20 and rows[0].model == "m"


def test_hashed_vector_edges(spark):
    df = spark.createDataFrame([(0, ""), (1, None), (2, "a a b"), (3, "  A, b a!")], "i int, t string")
    v = [r.v for r in df.select("i", embedding.hashed_vector(F.col("t"), 8).alias("v")).orderBy("i").collect()]
    assert sum(v[0]) == 0 and sum(v[1]) == 0 and v[2] == v[3] and abs(sum(x * x for x in v[2]) - 1) < 1e-6


def test_incremental_embedding_adds_nothing_twice(spark, sf_dir):
    now = F.lit("2024-02-01").cast("timestamp")
    stored = fx.stored_events(spark, sf_dir)
    first = embedding.pending_events(stored, limit=100)
    done = embedding.embed_events(first, now).cache()
    mark = embedding.read_mark(embedding.advance_mark(done, "wide_events", now), "wide_events")
    rest = embedding.pending_events(stored, mark)
    assert rest.count() == stored.count() - 100
    assert rest.join(done, "eventId", "left_semi").count() == 0
    assert embedding.new_rows(embedding.embed_events(first, now), done).count() == 0


def test_clusters_group_like_with_like(spark):
    from lumenlog.operators.clusters import assign_clusters, related_traces

    rows = [(i, f"r{i}", [1.0, 0.01 * (i % 5)] if i % 2 else [0.01 * (i % 5), 1.0]) for i in range(40)] + [(99, "zero", [0.0, 0.0])]
    got = assign_clusters(spark.createDataFrame(rows, "eventId bigint, requestId string, embedding array<float>"), k=2)
    by = {r.eventId: r.cluster for r in got.collect()}
    assert len({by[i] for i in range(1, 40, 2)}) == 1 and by[1] != by[0] and 99 not in by
    assert related_traces(got).count() == 40


def test_signature_candidates_of_near_vectors_in_numbers(spark):
    """Two thousand vectors, four copies each, hardly nearer than others: factor * k candidates don't hold the nearest."""
    import numpy as np

    rng = np.random.default_rng(11)
    x = np.repeat(rng.standard_normal((2000, 64)), 4, axis=0)
    vectors = spark.createDataFrame([(i, v, "s", None) for i, v in enumerate(x.tolist())], "eventId long, embedding array<double>, service string, timestamp timestamp")
    q = 0.5 * x[::400] + 0.9 * rng.standard_normal((20, 64))
    queries = spark.createDataFrame(list(enumerate(q.tolist())), "queryId long, embedding array<double>")
    signed = retrieval.signatures(vectors, 64)
    exact = {(r.queryId, r.eventId): r.score for r in retrieval.top_k(queries, vectors, 8).collect()}
    for block in (2048, 7):
        got = {(r.queryId, r.eventId): r.score for r in retrieval.ann_top_k(queries, signed, 8, 64, factor=2, block_queries=block).collect()}
        assert len(got) == len(exact) == 160 and len(got.keys() & exact.keys()) >= 152
        assert all(abs(s - exact[p]) < 1e-9 for p, s in got.items() if p in exact)


def test_vectors_are_sent_a_bounded_number_of_times(spark, monkeypatch):
    """The blocks that the vectors are sent to don't grow with the queries, and answers stay those of one block."""
    import numpy as np

    blocks, real = [], retrieval._tiles

    def watched(asked, rows, queries, block_queries):
        blocks.append(-(-queries // block_queries))
        return real(asked, rows, queries, block_queries)

    monkeypatch.setattr(retrieval, "_tiles", watched)
    x = np.round(np.random.default_rng(4).standard_normal((1500, 6)), 0)  # ties in numbers
    vectors = spark.createDataFrame([(i, v, "s", None) for i, v in enumerate(x.tolist())], "eventId long, embedding array<double>, service string, timestamp timestamp")
    queries = vectors.select(F.col("eventId").alias("queryId"), "embedding")
    cut = {tuple(r) for r in retrieval.top_k(queries, vectors, 5, block_queries=20).collect()}
    assert cut == {tuple(r) for r in retrieval.top_k(queries, vectors, 5).collect()} and len(cut) == 7500
    assert blocks == [16]
