"""Session histories in stream state: sliding expiry, late rows, restarts, hot sessions."""

import datetime as dt
import random
import tempfile

from lumenlog.streaming import pipelines
from lumenlog.streaming import session_history as sh

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "sessionId string, createdAt timestamp, turn bigint, question string, answer string"


def at(minutes, us=0):
    return T0 + dt.timedelta(minutes=minutes, microseconds=us)


class Stream:
    """Every call is a run of its own: the query stops and resumes from its checkpoint."""

    def __init__(self, spark, keep=3, lateness="10 minutes"):
        root = tempfile.mkdtemp(prefix="run-")
        self.spark, self.keep, self.lateness = spark, keep, lateness
        self.inp, self.out, self.cp = f"{root}/in", f"{root}/out", f"{root}/cp"

    def feed(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.inp)
        source = self.spark.readStream.schema(SCHEMA).parquet(self.inp)
        with sh.rocksdb(self.spark):
            pipelines.to_table(sh.session_history(source, keep=self.keep, lateness=self.lateness), self.out, self.cp).awaitTermination()
        return self.closed()

    def closed(self):
        return sorted(self.tuples(self.spark.read.parquet(self.out)))

    def open(self):
        return sorted(self.tuples(sh.open_sessions(self.spark, self.cp, keep=self.keep)))

    @staticmethod
    def tuples(df):
        return [(r.sessionId or "", r.startedAt, r.lastAt, r.accesses, r.turns, [h.turn for h in r.history]) for r in df.collect()]


def turn(session, minutes, n, question="q", us=0):
    return (session, at(minutes, us), n, question, f"a{n}")


def test_sliding_expiry_over_restarts(spark):
    s = Stream(spark)
    assert s.feed([turn("a", 0, 0), turn("a", 25, 1), turn("b", 0, 0), turn("c", 30, 0, us=1), turn("c", 0, 1)]) == []
    # one TTL to the microsecond keeps a session, one more ends it
    s.feed([turn("a", 55, 2), turn("a", 85, 3), turn(None, 70, 0)])
    assert s.open() == [("", at(70), at(70), 1, 1, [0]), ("a", at(0), at(85), 4, 4, [1, 2, 3])]
    assert s.closed() == [("b", at(0), at(0), 1, 1, [0]), ("c", at(0), at(0), 1, 1, [1]), ("c", at(30, 1), at(30, 1), 1, 1, [0])]
    s.feed([turn("z", 600, 0)])
    assert [r[0] for r in s.open()] == ["z"]
    assert [r for r in s.closed() if r[0] == "a"] == [("a", at(0), at(85), 4, 4, [1, 2, 3])] and len(s.closed()) == 5
    assert s.feed([turn("a", 601, 9)])[-1][0] == "c" and [(r[0], r[5]) for r in s.open()] == [("a", [9]), ("z", [0])]


def test_late_rows_join_and_accesses_keep_alive(spark):
    s = Stream(spark, lateness="2 hours")
    s.feed([turn("a", 0, 0), turn("a", 50, 2), ("b", at(0), 0, "q", "a"), ("b", at(29), None, None, None)])
    assert len(s.open()) == 3
    s.feed([turn("a", 25, 1), turn("b", 55, 1), (None, None, 0, "q", "a")])  # late, within the bound
    assert s.open() == [("a", at(0), at(50), 3, 3, [0, 1, 2]), ("b", at(0), at(55), 3, 2, [0, 1])]
    s.feed([turn("y", 1000, 0)])
    assert s.closed() == [("a", at(0), at(50), 3, 3, [0, 1, 2]), ("b", at(0), at(55), 3, 2, [0, 1])]
    s.feed([turn("a", 40, 7)])  # behind the watermark
    assert len(s.closed()) == 2 and [r[0] for r in s.open()] == ["y"]


def test_order_of_rows_changes_nothing(spark):
    rng = random.Random(4)
    rows = [turn(f"s{rng.randint(0, 3)}", rng.randint(0, 600), n) for n in range(300)]
    rows += [turn("hot", n / 10, n) for n in range(30_000)]  # many input chunks
    rng.shuffle(rows)
    results = []
    for parts in ([rows], [rows[:9000], rows[9000:]]):
        s = Stream(spark, keep=4, lateness="100 days")
        for part in parts:
            s.feed(part)
        results.append(s.open())
    assert results[0] == results[1]
    hot = [r for r in results[0] if r[0] == "hot"]
    assert hot == [("hot", at(0), rows and at(29_999 / 10), 30_000, 30_000, [29_996, 29_997, 29_998, 29_999])]
    by_hand = {}
    for name in {r[0] for r in rows}:
        ts = sorted(r[1] for r in rows if r[0] == name)
        by_hand[name] = 1 + sum(b - a > dt.timedelta(minutes=30) for a, b in zip(ts, ts[1:]))
    assert by_hand == {name: sum(r[0] == name for r in results[0]) for name in by_hand}
