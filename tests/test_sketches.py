"""Stored latency sketches against exact ranks."""

import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from lumenlog.operators import sketches as sk

T0 = dt.datetime(2024, 1, 1, 22)
EVENT = "timestamp timestamp, service string, route string, error struct<code: string, message: string>, performance struct<durationMs: bigint>"


def test_days_from_stored_minutes(spark):
    rng = random.Random(12)
    rows = []
    for i in range(60_000):
        route = "hot" if i % 3 else rng.choice(["a", None])
        took = None if i % 50 == 0 else int(rng.lognormvariate(4, 1))
        rows.append((T0 + dt.timedelta(seconds=i * 0.2), "s", route, ("E", "m") if i % 40 == 0 else None, (took,)))
    rows += [(T0, "s", "untimed", None, None), (None, "s", "a", None, (1,))]
    events = spark.createDataFrame(rows, EVENT)
    path = tempfile.mkdtemp(prefix="sketches-") + "/t"
    for half in (0, 1):  # a window may come in two parts
        sk.append_sketches(sk.minute_sketches(events.where(F.pmod(F.xxhash64("timestamp"), F.lit(2)) == half)), path)
    stored = spark.read.parquet(path)
    want = {}
    for at, _, route, error, took in rows:
        if at:
            want.setdefault((at.date(), route), []).append((took[0] if took else None, error is not None))
    hours = sk.rolled_up(stored, "hour")
    for source in (stored, hours):  # minutes to days, and hours to days
        out = sk.sketched_percentiles(sk.rolled_up(source, "day"), (0.0, 0.5, 0.95, 0.99, 1.0)).collect()
        assert {(r.start.date(), r.route) for r in out} == want.keys()
        for r in out:
            all_, timed = want[r.start.date(), r.route], sorted(t for t, _ in want[r.start.date(), r.route] if t is not None)
            assert (r.requests, r.errors, r.timed) == (len(all_), sum(e for _, e in all_), len(timed))
            if not timed:
                assert r.p50 is None and r.maxMs is None
                continue
            assert (r.p0, r.p100, r.maxMs) == (timed[0], timed[-1], timed[-1])
            for share, value in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
                below, upto = (sum(t < value for t in timed), sum(t <= value for t in timed))
                assert below <= (share + sk.RANK_ERROR) * len(timed) + 1 and upto >= (share - sk.RANK_ERROR) * len(timed) - 1
    above = {r.route: r.shareAbove for r in sk.share_above(sk.rolled_up(stored, "week"), 100).collect()}
    hot = [t for k, v in want.items() if k[1] == "hot" for t, _ in v if t is not None]
    assert abs(above["hot"] - sum(t > 100 for t in hot) / len(hot)) < 2 * sk.RANK_ERROR and above["untimed"] is None


def test_day_reads_its_own_minutes_only(spark):
    rows = [(T0 + dt.timedelta(days=i % 5), "s", "a", None, (i,)) for i in range(100)]
    path = tempfile.mkdtemp(prefix="sketches-") + "/t"
    sk.append_sketches(sk.minute_sketches(spark.createDataFrame(rows, EVENT)), path)
    day = spark.read.parquet(path).where(F.col("day") == dt.date(2024, 1, 3))
    assert len(day.inputFiles()) > 1 and "PartitionFilters: [isnotnull(day" in day._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    out = sk.sketched_percentiles(sk.rolled_up(day, "day"), (0.5,)).collect()
    assert len(out) == 1 and out[0].requests == 20 and 2 <= out[0].p50 <= 97
