"""The physical plans that make the operators scale."""

import re

from pyspark.sql import functions as F

from lumenlog.catalog import fixtures as fx
from lumenlog.operators import audits, filters, metrics, sessions
from lumenlog.operators.filters import QueryMetadata
from lumenlog.sources import events as src


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_examples_are_limited_before_the_shuffle(spark, sf_dir):
    p = plan(metrics.top_error_codes(fx.events(spark, sf_dir)))
    assert p.count("WindowGroupLimit") >= 2 and "TakeOrderedAndProject" in p
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_filters_reach_the_scan(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    fx.stored_events(spark, sf_dir).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    md = QueryMetadata(service="payments", error_code="CARD_EXPIRED", start_time="2024-01-02")
    p = plan(filters.apply_metadata(t, md).select("requestId"))
    pushed = re.search(r"PushedFilters: \[(.*)", p).group(1)
    assert "EqualTo(service,payments)" in pushed and "error.code" in pushed and "timestamp" in pushed
    schema = re.search(r"ReadSchema: (.*)", p).group(1)
    assert "route" not in schema and "_summary" not in schema and "message" not in schema


def test_last_turns_are_limited_before_the_shuffle(spark, sf_dir):
    assert plan(sessions.last_turns(fx.history(spark, sf_dir), 10)).count("WindowGroupLimit") >= 2


def test_percentiles_never_sort_raw_rows(spark, sf_dir):
    p = plan(metrics.latency_percentile(fx.events(spark, sf_dir)))
    below_first_aggregate = p[p.rindex("HashAggregate") :]
    assert "Sort" not in below_first_aggregate and "Window" not in below_first_aggregate


def test_no_all_pairs_join_in_any_registered_batch_query(spark, sf_dir):
    from lumenlog.catalog import load

    queries, _ = load()
    skip = ("a1_", "a2_", "a5_", "a8_", "e15_", "i1_", "i2_", "i3_", "i4_s", "i5_s", "i6_", "i7_", "i8_", "i9_", "f18_")
    for name, fn in queries.items():
        if not name.startswith(skip):
            p = plan(fn(spark, sf_dir))
            assert "CartesianProduct" not in p and "NestedLoopJoin" not in p, name


def test_concurrency_windows_are_bucketed(spark, sf_dir):
    e = fx.events(spark, sf_dir).select("requestId", F.col("timestamp").alias("a"), F.col("timestamp").alias("b"))
    p = plan(audits.concurrency(e, "a", "b"))
    single = [line for line in p.splitlines() if "Exchange SinglePartition" in line]
    # one single-partition step: the window over days
    assert len(single) == 1


def test_messages_are_read_once_whatever_is_filtered(spark, tmp_path):
    good = '{"event":{"requestId":"r","timestamp":"2024-01-01T00:00:00Z","service":"s","route":"GET /"},"summary":"x"}'
    rows = [(good,), ("{oops",), ("",), ("[]",), ('{"event":null}',), (good.replace('"s"', '""'),), (None,)]
    spark.createDataFrame(rows, "value string").write.parquet(str(tmp_path / "m"))
    parsed = src.parse_messages(spark.read.schema("value string").parquet(str(tmp_path / "m")))
    valid, rejected = parsed.filter(F.size("reasons") == 0), parsed.filter(F.size("reasons") > 0)
    for df in (parsed, valid, rejected, valid.drop("reasons", "value")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [r.requestId for r in valid.collect()] == ["r"]
    reasons = {r.value: r.reasons for r in rejected.collect()}
    empty = [f"{name} is empty" for name in ("requestId", "timestamp", "service", "route")]
    unreadable = ["unreadable message"]
    assert reasons == {"{oops": unreadable, "[]": unreadable, "": empty, '{"event":null}': empty, rows[5][0]: ["service is empty"]}
