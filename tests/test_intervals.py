"""Interval joins and merged incidents against plain loops."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lumenlog.operators import incidents
from lumenlog.plans import intervals as iv

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_interval_join_against_all_pairs(spark):
    rng = random.Random(8)
    key = lambda: rng.choice(["a", "b", None])
    # a third of all points in one second: the cell is split
    points = [(i, key(), 777 if i % 3 == 0 else rng.choice([None, rng.randint(-500, 5000)])) for i in range(1500)]
    spans = [(i, key(), s, s + rng.choice([0, -5, 1, 7, 60, 61, 700, 4000])) for i, s in enumerate(rng.randint(-600, 5000) for _ in range(60))]
    spans += [(60, "a", 0, 60), (61, None, 777, 778), (62, "b", 777, 778)]
    p = spark.createDataFrame([(i, k, at(t)) for i, k, t in points], "point long, k string, at timestamp").repartition(4)
    s = spark.createDataFrame([(i, k, at(a), at(b)) for i, k, a, b in spans], "span long, k2 string, a timestamp, b timestamp")
    want = sorted((i, j) for i, k, t in points for j, k2, a, b in spans if t is not None and k == k2 and a <= t < b)
    for cell in (1, 60, 100_000):
        out = iv.interval_join(p, s.select("span", F.col("k2").alias("k"), "a", "b"), ["k"], "at", "a", "b", cell)
        assert sorted((r.point, r.span) for r in out.collect()) == want and len(want) > 1000
        assert "NestedLoop" not in plan_of(out) and "Cartesian" not in plan_of(out)
        assert out.columns == ["point", "k", "at", "span", "a", "b"]
    assert iv.interval_join(p.limit(0), s.select("span", F.col("k2").alias("k"), "a", "b"), ["k"], "at", "a", "b", 60).collect() == []


def test_merge_of_windows(spark):
    rows = [("a", 0, 10), ("a", 5, 15), ("a", 15, 20), ("a", 21, 30), ("a", 22, 23), ("a", 24, 40), (None, 0, 5), (None, 5, 6), ("b", 3, 4)]
    df = spark.createDataFrame([(k, at(a), at(b)) for k, a, b in rows], "k string, a timestamp, b timestamp")
    out = iv.merge_overlapping(df, ["k"], "a", "b", n=F.count("*")).collect()
    got = sorted(((r.k or ""), (r.a - T0).seconds, (r.b - T0).seconds, r.n) for r in out)
    assert got == [("", 0, 6, 2), ("a", 0, 20, 3), ("a", 21, 40, 3), ("b", 3, 4, 1)]


def test_incident_from_sliding_windows(spark):
    event = "requestId string, timestamp timestamp, service string, route string, user struct<id: string, role: string>, error struct<code: string, message: string>"
    rows = []
    for i in range(24):  # two bursts of twelve errors, a day apart
        rows.append((f"r{i:02d}", at((i % 12) * 10 + 86_400 * (i // 12)), "s", "GET /", (f"u{i % 5}", None), ("E", None)))
    rows += [("ok", at(30), "s", "GET /", ("u9", None), None), ("other", at(40), "s", "GET /", None, ("F", None)), ("far", at(4000), "s", "GET /", None, ("E", None))]
    df = spark.createDataFrame(rows, event)
    windows = incidents.incidents(df, "5 minutes", "1 minute", 10)
    stretches = incidents.incident_stretches(windows, 10)
    out = {r.incidentId: r for r in incidents.incident_impact(df, stretches).collect()}
    first = out["s|GET /|E|2023-12-31T23:57"]
    assert len(out) == 2 and windows.count() == 8 and first.windows == 4 and first.peakErrors == 12 and first.severity == "minor"
    assert (first.requests, first.errors, first.users, first.relatedTraces) == (14, 12, 5, ["r00", "r01", "r02"])
    assert first.endedAt == at(300) and first.firstAt == T0 and first.lastAt == at(110) and first.errorRate == 1200 / 14
    brief = incidents.system_briefing(df, stretches).collect()
    rows = {(r.day.isoformat(), r.section, r["rank"]): (r.errorCode, r.errors, r.change) for r in brief}
    assert rows == {
        ("2024-01-01", "code", 1): ("E", 13, 13), ("2024-01-01", "code", 2): ("F", 1, 1),
        ("2024-01-01", "trend", 1): ("E", 13, 13), ("2024-01-01", "trend", 2): ("F", 1, 1),
        ("2024-01-01", "incident", 1): ("E", 12, None),
        ("2024-01-02", "code", 1): ("E", 12, -1), ("2024-01-02", "incident", 1): ("E", 12, None),
    }
