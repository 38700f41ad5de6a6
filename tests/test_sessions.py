"""Session operators against brute force and at their edges."""

import datetime as dt

from pyspark.sql import functions as F

from lumenlog.operators import sessions
from lumenlog.plans import timelines

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "sessionId string, turn bigint, question string, answer string, createdAt timestamp, intent string, confidence double, sources array<string>"


def history(spark, n, sid="s", step=60, answers=None):
    rows = [
        (sid, i, f"service q{i}", answers[i] if answers else f"a{i}", T0 + dt.timedelta(seconds=step * i), "SEMANTIC", 0.5, [f"r{i % 3}"])
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_compression_edges(spark):
    assert sessions.compress_history(history(spark, 0)).count() == 0
    assert sessions.compress_history(history(spark, 10)).filter("position = 0").count() == 0
    rows = sessions.compress_history(history(spark, 11)).orderBy("position").collect()
    assert len(rows) == 11 and rows[0].answer == "Previous conversation covered 1 interactions about services."
    assert [r.question for r in rows[1:]] == [f"service q{i}" for i in range(1, 11)]
    old = sessions.old_turn_sources(history(spark, 15)).orderBy("firstCitedAt").collect()
    assert [r.source for r in old] == ["r0", "r1", "r2"]
    assert sessions.old_turn_sources(history(spark, 5)).count() == 0


def test_rendering_cuts_answers(spark):
    h = history(spark, 2, answers=["x" * 200, "y" * 201])
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    text = sessions.render_history(sessions.compress_history(h), now).first().historyText
    assert text == (
        "\nChat History (Ordered from oldest to most recent):\nTurn 1 [10 mins ago]:\nQ: service q0\nA: " + "x" * 200
        + "\n\nTurn 2 [9 mins ago] (LAST TURN):\nQ: service q1\nA: " + "y" * 200 + "..."
    )
    lines = sessions.summariser_lines(history(spark, 2, answers=["x" * 150, "y" * 151])).orderBy("position").collect()
    assert lines[0].text == "Q1: service q0\nA1: " + "x" * 150 and lines[1].text.endswith("y" * 150 + "...")


def test_ttl_boundary(spark):
    gaps = [0, 1800_000, 1800_001, 5]  # exactly the TTL stays, one millisecond more does not
    times, t = [], T0
    for g in gaps:
        t = t + dt.timedelta(milliseconds=g)
        times.append((t,))
    df = spark.createDataFrame([("s", t[0]) for t in times], "sessionId string, createdAt timestamp")
    got = [(r.session_no, r.n) for r in sessions.sessions_by_ttl(df).orderBy("session_no").collect()]
    assert got == [(1, 2), (2, 2)]
    r = sessions.access_replay(df.withColumnRenamed("createdAt", "at")).first()
    assert (r.accesses, r.hits, r.misses, r.expiries) == (4, 2, 2, 1)


def test_hot_session_matches_brute_force(spark):
    """One session holds most rows; bucketed plans must equal a plain scan."""
    import random

    rng = random.Random(3)
    rows, t = [], 0
    for i in range(3000):
        t += rng.choice([1, 7, 300, 1799, 1800, 1801, 4000])
        rows.append(("hot" if rng.random() < 0.7 else f"s{i % 5}", T0 + dt.timedelta(seconds=t)))
    df = spark.createDataFrame(rows, "sessionId string, createdAt timestamp")
    want, last = {}, {}
    for sid, at in rows:
        fresh = sid not in last or (at - last[sid]).total_seconds() > 1800
        want.setdefault(sid, []).append(1) if fresh else want[sid].append(want[sid].pop() + 1)
        last[sid] = at
    got = {}
    for r in sessions.sessions_by_ttl(df).orderBy("sessionId", "session_no").collect():
        got.setdefault(r.sessionId, []).append(r.n)
    assert got == want


def test_pairing_crosses_buckets(spark):
    turns = [("c", i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(0, 40)] + [("d", 5, "user", "x"), ("d", 900, "assistant", "y"), ("d", 901, "assistant", "z")]
    df = spark.createDataFrame(turns, "conv string, turn bigint, role string, text string")
    got = sorted(map(tuple, sessions.pair_turns(df, "conv", "turn", "role", "text", width=3).collect()))
    want = [("c", i, f"t{i}", f"t{i + 1}") for i in range(0, 40, 2)] + [("d", 5, "x", "y")]
    assert got == sorted(want)


def test_running_total_levels(spark):
    df = spark.range(500).select((F.col("id") * 17 % 500).alias("pos"), F.lit(1).alias("v"))
    out = timelines.running_total(df, [], "pos", [F.col("pos")], "v", [7, 50], "total")
    assert all(r.total == r.pos + 1 for r in out.collect()) and out.count() == 500
