"""Streaming behaviour the registered queries do not show: restarts, lateness, dead letters."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from lumenlog.sources import events as src
from lumenlog.streaming import pipelines

T0 = dt.datetime(2024, 1, 1)


def paths():
    root = tempfile.mkdtemp(prefix="run-")
    return f"{root}/in", f"{root}/out", f"{root}/cp"


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).parquet(path)


EV = "requestId string, timestamp timestamp"


def test_dedup_across_batches_and_restarts(spark):
    inp, out, cp = paths()

    def go(rows):
        feed(spark, inp, rows, EV)
        pipelines.to_table(pipelines.deduplicate(stream(spark, inp, EV), "10 minutes"), out, cp).awaitTermination()
        return sorted(r.requestId for r in spark.read.parquet(out).collect())

    assert go([("a", T0), ("a", T0), ("b", T0)]) == ["a", "b"]
    assert go([("a", T0 + dt.timedelta(minutes=5)), ("c", T0 + dt.timedelta(minutes=5))]) == ["a", "b", "c"]
    go([("d", T0 + dt.timedelta(hours=2))])
    # far behind the watermark: dropped, not emitted again
    assert go([("a", T0)]) == ["a", "b", "c", "d"]


def test_late_rows_are_diverted_not_dropped(spark):
    inp, out, cp = paths()
    for rows in ([("a", T0)], [("b", T0 + dt.timedelta(hours=1))], [("late", T0 + dt.timedelta(minutes=49)), ("ok", T0 + dt.timedelta(minutes=50))]):
        feed(spark, inp, rows, EV)
        pipelines.divert_late(stream(spark, inp, EV), out, cp, 600).awaitTermination()
    got = {r.requestId: r.arrival for r in spark.read.parquet(f"{out}/rows").collect()}
    assert got == {"a": "on_time", "b": "on_time", "late": "late", "ok": "on_time"}


def test_dead_letters_keep_value_and_reason(spark):
    inp, out, cp = paths()
    good = '{"event":{"requestId":"r","timestamp":"2024-01-01T00:00:00.123Z","service":"s","route":"GET /"},"_metadata":{"k":{"n":1}},"summary":"x"}'
    feed(spark, inp, [("r", good), ("x", "{oops"), ("n", None), ("e", '{"event":{"requestId":""}}')], "key string, value string")
    pipelines.persist_batches(stream(spark, inp, "key string, value string"), out, cp).awaitTermination()
    rows = spark.read.parquet(f"{out}/events")
    ok = rows.filter("outcome = 'valid'").first()
    assert ok.requestId == "r" and ok._metadata == '{"k":{"n":1}}' and ok.timestamp == dt.datetime(2024, 1, 1, 0, 0, 0, 123000)
    dead = {r.value: r.reasons for r in rows.filter("outcome = 'rejected'").collect()}
    assert dead["{oops"] == ["unreadable message"] and "service is empty" in dead['{"event":{"requestId":""}}']
    s = spark.read.parquet(f"{out}/stats").first()
    assert (s.events, s.successes, s.failures) == (3, 1, 2)


def test_replayed_batch_replaces_its_output(spark):
    """A batch run again after a crash (checkpoint lost) does not add rows."""
    inp, out, cp = paths()
    feed(spark, inp, [("r", "{oops")], "key string, value string")
    for checkpoint in (cp, cp + "-again"):
        pipelines.persist_batches(stream(spark, inp, "key string, value string"), out, checkpoint).awaitTermination()
    assert spark.read.parquet(f"{out}/events").count() == 1


def test_stream_and_batch_embed_the_same(spark, sf_dir):
    from lumenlog.catalog import fixtures as fx
    from lumenlog.operators.embedding import embed_events

    inp, out, cp = paths()
    stored = fx.stored_events(spark, sf_dir)
    stored.write.parquet(inp)
    now = F.lit("2024-02-01").cast("timestamp")
    for _ in range(2):  # the second run finds nothing new
        pipelines.embed_incrementally(stream(spark, inp, stored.schema), out, cp, now).awaitTermination()
    want = embed_events(stored, now)
    got = spark.read.parquet(out).select(want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_json_lines_keep_corrupt_text(spark):
    path = tempfile.mkdtemp(prefix="run-") + "/lines"
    spark.createDataFrame([('{"requestId":"a","service":"s"}',), ("{bad",)], "value string").write.text(path)
    rows = {r.requestId: r for r in src.read_json_lines(spark, path).collect()}
    assert rows["a"]._corrupt_record is None and rows[None]._corrupt_record == "{bad"


def test_ingested_days_are_not_written_by_every_task(spark):
    """Files grow with days plus partitions, not their product; a single day is still spread over tasks."""

    def ingested(days):
        inp, out, cp = paths()
        message = '{{"event":{{"requestId":"r{0}","timestamp":"{1}Z","service":"s","route":"GET /"}}}}'
        times = [T0 + dt.timedelta(days=i % days, seconds=i) for i in range(400)]
        rows = [(f"r{i}", message.format(i, t.isoformat())) for i, t in enumerate(times)]
        spark.createDataFrame(rows, "key string, value string").repartition(8).write.parquet(inp)
        pipelines.ingest(stream(spark, inp, "key string, value string"), out, cp).awaitTermination()
        got = spark.read.parquet(out)
        assert {(r.requestId, r.timestamp, r.event_date) for r in got.collect()} == {(f"r{i}", t, t.date()) for i, t in enumerate(times)}
        assert got.count() == 400
        return got.select(F.input_file_name()).distinct().count()

    assert ingested(20) <= 20 + int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert ingested(1) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
