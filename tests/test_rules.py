"""Hand-computed rows for every branch of the row rules."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lumenlog.functions import events as ev
from lumenlog.functions import normalize as nz
from lumenlog.functions import questions as qn
from lumenlog.functions import text as tx
from lumenlog.functions import vectors as vx
from lumenlog.operators import audits, consistency, filters, grounding, metrics, result_cache, sampling, validation
from lumenlog.operators.filters import QueryMetadata
from lumenlog.operators.metrics import MetricParams

EVENT = "eventId bigint, requestId string, timestamp timestamp, service string, route string, user struct<id:string,role:string>, error struct<code:string,message:string>, performance struct<durationMs:bigint>"


def values(spark, schema, rows, expr):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], f"_i int, {schema}")
    return [r[0] for r in df.orderBy("_i").select(expr).collect()]


def event(i, code=None, ms=10, route="GET /a", service="s", role=None, ts="2024-01-01 00:00:00"):
    import datetime as dt

    return Row(
        eventId=i, requestId=f"r{i}", timestamp=dt.datetime.fromisoformat(ts), service=service, route=route,
        user=Row(id=f"u{i}", role=role) if role else None, error=Row(code=code, message="m") if code else None,
        performance=Row(durationMs=ms) if ms is not None else None,
    )


def events(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT)


def test_latency_bucket_edges(spark):
    got = values(spark, "d bigint", [None, 0, 49, 50, 199, 200, 499, 500, 999, 1000], ev.latency_bucket(F.col("d")))
    assert got == [
        "P_UNKNOWN", "P_SUB_50MS", "P_SUB_50MS", "P_50_200MS", "P_50_200MS", "P_200_500MS", "P_200_500MS",
        "P_500_1000MS", "P_500_1000MS", "P_OVER_1000MS",
    ]


def test_outcome_error_wins(spark):
    rows = [("E", None), ("E", 1500), (None, 1000), (None, None), (None, 999)]
    got = values(spark, "e string, d bigint", rows, ev.outcome(F.col("e"), F.col("d")))
    assert got == ["FAILED", "FAILED", "WARNING", "EDGE_CASE", "SUCCESS"]


def test_roles_and_names(spark):
    assert values(spark, "r string", ["admin", "gold", None, "Admin"], ev.coerce_role(F.col("r"))) == ["admin", "guest", None, "guest"]
    assert values(spark, "r string", ["ANONYMOUS_USER", "PREMIUM", "Odd"], ev.role_display(F.col("r"))) == ["anonymous", "premium", "odd"]
    routes = ["POST /payments/checkout", "get /users/profile", "POST /users/register", "GET /products", "GET /", "/a//b/"]
    assert values(spark, "r string", routes, ev.route_display(F.col("r"))) == [
        "checkout", "profile access", "registration", "/products", "/", "b",
    ]
    codes = ["UNAUTHORIZED", "CARD_EXPIRED", "NOT_FOUND"]
    assert values(spark, "c string", codes, ev.error_description(F.col("c"))) == [
        "authorization failure", "card expired", "resource not found",
    ]


def test_dual_layer_summary(spark):
    df = events(spark, event(1, "GATEWAY_TIMEOUT", 1500, "POST /payments/checkout", "payments", "premium"), event(2, None, 20, "GET /users/profile", "users"))
    a, b = [r[0] for r in df.orderBy("eventId").select(ev.dual_layer_summary(**ev.event_args())).collect()]
    assert a == (
        "A premium user experienced a payment failure during checkout due to gateway timeout: m.\n\n"
        "Outcome: FAILED, Service: payments, Route: POST /payments/checkout, Error: GATEWAY_TIMEOUT, ErrorMessage: m, "
        "UserRole: premium, LatencyBucket: P_OVER_1000MS"
    )
    assert b.startswith("A anonymous user successfully completed users profile access.\n\nOutcome: SUCCESS, ")


def test_canonical_route(spark):
    rows = [("get", "a/b?x=1", None), ("Post", "/v1/a", None), ("put", "/v1x", "/t/:id"), ("delete", "/q?a?b", "")]
    schema = "m string, p string, t string"
    assert values(spark, schema, rows, nz.canonical_route(F.col("m"), F.col("p"))) == ["GET /a/b", "POST /v1/a", "PUT /v1x", "DELETE /q"]
    assert values(spark, schema, rows, nz.canonical_route(F.col("m"), F.col("p"), F.col("t"), "/v1/")) == [
        "GET /v1/a/b", "POST /v1/a", "PUT /v1/t/:id", "DELETE /v1/q",
    ]


def test_error_normalisation(spark):
    rows = [
        ('{"errorCode":"","code":"C1"}', 400), ('{"error":"Bad","statusCode":7}', 400), ("{}", 418), ("[1,2]", 418),
        ('"text"', 418), (None, 422), ('{"statusCode":503}', 500),
    ]
    assert values(spark, "r string, s int", rows, nz.error_code(F.col("r"), F.col("s"))) == [
        "C1", "Bad", "418", "418", "HTTP_418", "VALIDATION_ERROR", "503",
    ]
    msgs = ['["a","b","c"]', '["a","b","c","d"]', '{"message":["x","y"]}', '{"error":"E"}', "{}", None, '"' + "z" * 200 + '"', '"' + "z" * 201 + '"']
    assert values(spark, "r string", msgs, nz.error_message(F.col("r"), F.lit("fb"))) == [
        "a; b; c", "a; b; c... (+1 more)", "x,y", "E", "fb", "fb", "z" * 200, "z" * 197 + "...",
    ]
    many = "[" + ",".join(f'"{i}"' for i in range(12)) + "]"
    got = values(spark, "r string", [many, '{"errors":["e"]}', '{"message":"m"}', None], nz.validation_errors(F.col("r")))
    assert got == [[str(i) for i in range(10)], ["e"], None, None]


def test_redaction_rules():
    rules = nz.DEFAULT_REDACT_PATHS
    assert nz.is_redacted("body.password", rules) and nz.is_redacted("query.password", rules)
    assert not nz.is_redacted("body.amount", rules) and not nz.is_redacted("password", rules)
    assert nz.is_redacted("body.card.pin", ["body.pin"])


def test_request_meta(spark):
    df = spark.createDataFrame([('{"a":{"b":"v"},"pin":"1","n":null}', None, '{"b":"w"}', "{}")], "body string, params string, query string, headers string")
    m = df.select(nz.request_meta(["body.a.b", "query.b", "body.pin", "params.id", "body.n", "x.y"], ["body.pin"], "****")).first()[0]
    assert m == {"b": "w", "pin": "****"}


def test_request_meta_bounds_nested_values(spark):
    import json

    body = {
        "user": {"name": "n" * 201, "tags": [1, [2, 3]], "deep": {"x": {"y": 1}, "l": [1, 2, 3]}},
        "list": list(range(12)), "flag": True, "ratio": 1.5, "text": '{"not":"parsed"}', "none": None,
    }
    df = spark.createDataFrame([(json.dumps(body), "{}", "{}", "{bad")], "body string, params string, query string, headers string")
    m = df.select(nz.request_meta(["body.user", "body.list", "body.flag", "body.ratio", "body.text", "body.none", "headers.a"])).first()[0]
    user = json.loads(m["user"])
    assert user["name"] == "n" * 200 + "..." and user["tags"] == [1, "[Array(2)]"]
    assert user["deep"] == {"l": "[Array(3)]", "x": "[Object]"}
    assert json.loads(m["list"]) == list(range(10))
    assert (m["flag"], m["ratio"], m["text"]) == ("true", "1.5", '{"not":"parsed"}') and set(m) == {"user", "list", "flag", "ratio", "text"}


def test_sanitize(spark):
    df = spark.createDataFrame([(("s" * 201, list("abcdefghijkl"), {str(i): i for i in range(25)}, ([1, 2],)),)], "v struct<s:string,a:array<string>,m:map<string,int>,n:struct<x:array<int>>>")
    v = df.select(nz.sanitize(F.col("v"), df.schema["v"].dataType)).first()[0]
    assert v.s == "s" * 200 + "..." and v.a == list("abcdefghij") and len(v.m) == 20 and v.n.x == "[Array(2)]"


def test_sampling_rules(spark):
    df = events(
        spark, event(1, ms=1999), event(2, ms=2000), event(3, ms=2001), event(4, "E", 5000), event(5, route="POST /payments"), event(6, ms=None)
    )
    policy = sampling.SamplingPolicy(normal_rate=0.0, critical_routes=("POST /payments",))
    got = {r.eventId: r.reason for r in sampling.decide(df, policy).collect()}
    assert got == {1: "NOT_SAMPLED", 2: "NOT_SAMPLED", 3: "SLOW_REQUEST", 4: "HAS_ERROR", 5: "CRITICAL_ROUTE", 6: "NOT_SAMPLED"}
    by_path = sampling.SamplingPolicy(normal_rate=1.0, critical_routes=("/payments",), match="path")
    got = {r.eventId: r.reason for r in sampling.decide(df, by_path).collect()}
    assert got[5] == "CRITICAL_ROUTE" and got[1] == "SAMPLED_NORMAL"
    exact = sampling.SamplingPolicy(normal_rate=0.0, critical_routes=("/payments",))
    assert {r.reason for r in sampling.decide(df.filter("eventId = 5"), exact).collect()} == {"NOT_SAMPLED"}
    env = sampling.SamplingPolicy.from_env({"LOG_SAMPLING_NORMAL_RATE": "x", "LOG_SLOW_THRESHOLD_MS": "5", "LOG_CRITICAL_ROUTES": " a, ,b"})
    assert env == sampling.SamplingPolicy(0.01, 5, ("a", "b"))


def test_sampling_keeps_every_error_and_slow_request(spark, sf_dir):
    from lumenlog.catalog import fixtures as fx

    r = sampling.retention_report(fx.events(spark, sf_dir), sampling.SamplingPolicy()).first()
    assert r.errors == r.errorsKept and r.slow == r.slowKept and r.kept < r.total and r.reductionPct > 0


def test_metric_filter_modes(spark):
    df = events(spark, event(1, "A", ts="2024-01-01 00:00:00"), event(2, "B", ts="2024-01-02 00:00:00"), event(3, ts="2024-01-03 00:00:00"))

    def ids(md, compat=False):
        return sorted(r.eventId for r in filters.apply_metadata(df, md, compat).collect())

    assert ids(QueryMetadata()) == [1, 2, 3]
    assert ids(QueryMetadata(has_error=True)) == [1, 2] and ids(QueryMetadata(has_error=False)) == [3]
    assert ids(QueryMetadata(error_code="A", has_error=True)) == [1]
    assert ids(QueryMetadata(error_code="A", has_error=True), compat=True) == [1, 2]
    assert ids(QueryMetadata(error_code="A", has_error=False)) == []
    assert ids(QueryMetadata(start_time="2024-01-01 00:00:00", end_time="2024-01-02 00:00:00")) == [1, 2]


def test_watermark_keyset(spark):
    df = events(spark, *[event(i, ts=t) for i, t in ((1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-02"), (4, "2024-01-01"), (5, "2024-01-03"))])
    df = df.withColumn("_summary", F.when(F.col("eventId") == 5, "").otherwise("x"))
    got = [r.eventId for r in filters.pending_page(df, "2024-01-02", 2, 10).collect()]
    assert got == [3]
    assert [r.eventId for r in filters.pending_page(df, limit=2).collect()] == [1, 4]


@pytest.mark.parametrize("n", [1, 2, 20, 100])
def test_floor_rank_percentiles(spark, n):
    from lumenlog.plans.ranks import floor_rank_percentiles

    data = [(i * 37) % n * 10 for i in range(n)] + []
    want = sorted(data)
    r = floor_rank_percentiles(spark.createDataFrame([(d,) for d in data], "v bigint"), "v", metrics.PERCENTILES).first()
    assert (r.p50, r.p95, r.p99) == tuple(want[int(p * n)] for p in (0.5, 0.95, 0.99))
    assert r["count"] == n and r.max == want[-1]


def test_percentiles_of_nothing_and_of_ties(spark):
    from lumenlog.plans.ranks import floor_rank_percentiles

    assert floor_rank_percentiles(spark.createDataFrame([], "v bigint"), "v", metrics.PERCENTILES).count() == 0
    df = spark.range(1000).select(F.when(F.col("id") < 990, 7).otherwise(F.col("id")).cast("double").alias("v"))
    r = floor_rank_percentiles(df, "v", {"p50": 0.5, "p99": 0.99, "p999": 0.999}).first()
    assert (r.p50, r.p99, r.p999) == (7.0, 990.0, 999.0)
    neg = spark.range(101).select((F.col("id") - 50).cast("double").alias("v"))
    assert floor_rank_percentiles(neg, "v", {"p50": 0.5}).first().p50 == 0.0


def test_error_rate_of_nothing_has_no_row(spark):
    df = events(spark, event(1))
    assert metrics.error_rate(df, MetricParams(QueryMetadata(service="absent"))).count() == 0
    with pytest.raises(KeyError):
        metrics.run_metric(df, "NO_SUCH_METRIC")


def test_registered_metric(spark):
    metrics.register_metric("COUNT", lambda df, params: df.agg(F.count("*").alias("n")))
    assert metrics.run_metric(events(spark, event(1)), "COUNT").first().n == 1
    del metrics.METRICS["COUNT"]


def test_approximate_percentile_error(spark, sf_dir):
    from lumenlog.catalog import fixtures as fx

    ev_ = fx.events(spark, sf_dir)
    approx = {r.route: r for r in metrics.approx_latency_by_route(ev_).collect()}
    rows = ev_.filter("performance is not null").select("route", F.col("performance.durationMs").alias("d")).collect()
    for route, r in approx.items():
        ds = sorted(x.d for x in rows if x.route == route)
        rank = sum(d <= r.p95 for d in ds) / len(ds)
        assert abs(rank - 0.95) <= 0.01


def test_delivery_health(spark):
    def run(ok, bad):
        data = [(f"2024-01-01 00:00:{i % 60:02d}", i, None if i < ok else f"e{i}") for i in range(ok + bad)]
        df = spark.createDataFrame(data, "at string, id int, error string").withColumn("at", F.col("at").cast("timestamp"))
        return audits.delivery_health(df).first()

    assert (run(8, 1).healthy, run(8, 1).warn) == (True, False)
    assert (run(90, 9).healthy, run(90, 9).warn) == (False, False)
    assert (run(94, 6).healthy, run(94, 6).warn) == (False, True)
    assert (run(95, 5).healthy, run(95, 5).warn) == (True, False)
    assert run(2, 1).successRate == 66.67 and run(2, 1).lastError == "e2"
    empty = audits.delivery_health(spark.createDataFrame([], "at timestamp, id int, error string")).first()
    assert empty.successRate == 100.0 and empty.healthy


def test_chunkers(spark):
    def run(texts, expr):
        return values(spark, "t string", texts, expr)

    long_part = "k" * 250
    two = "a" * 120 + ", " + "b" * 120
    assert run(["", "x" * 200, two, long_part + ", y", ", , " + "z" * 199], tx.chunk_summary(F.col("t"))) == [
        [""], ["x" * 200], ["a" * 120, "b" * 120], [long_part, "y"], ["z" * 199],
    ]
    text = "".join(chr(97 + i % 26) for i in range(400))
    got = run([text, "q" * 150, "q" * 151], tx.overlapping_chunks(F.col("t")))
    assert got[0] == [text[0:150], text[120:270], text[240:390], text[360:400]]
    assert got[1] == ["q" * 150] and got[2] == ["q" * 150, "q" * 31]
    wide = run([text], tx.overlapping_chunks(F.col("t"), 100, 70))[0]
    assert wide[:2] == [text[0:100], text[30:130]] and wide[-1][-1] == text[-1] and len(wide) == 11
    with pytest.raises(ValueError):
        tx.overlapping_chunks(F.col("t"), 10, 10)
    fields = run(["Outcome: X, plain, :odd, Service: y: z"], tx.chunk_by_fields(F.col("t")))[0]
    assert [(f.text, f.field) for f in fields] == [("Outcome: X", "outcome"), ("plain", None), (":odd", None), ("Service: y: z", "service")]
    assert run(["x" * 200, "x" * 201], tx.should_chunk(F.col("t"))) == [False, True]
    assert run(["A: 1, b : 2, a: 3, c"], tx.field_map(F.col("t"))) == [{"a": "3", "b": "2"}]


def test_consistency(spark):
    doc = "A x.\n\nOutcome: FAILED, Service: payments, Route: POST /p, Error: E, ErrorMessage: m, UserRole: guest, LatencyBucket: B"
    same = doc
    any_q = "q\n\nOutcome: FAILED, Service: orders, Route: ANY, Error: NONE, ErrorMessage: ANY, UserRole: admin, LatencyBucket: ANY"
    df = spark.createDataFrame([(0, doc, same, "m", "m"), (1, doc, any_q, "m", None)], "i int, d string, q string, dm string, qm string")
    rows = {r.i: r for r in consistency.consistency_report(df, "d", "q", "dm", "qm").collect()}
    assert rows[0].recommendations == [consistency.ADVICE_GOOD]
    assert rows[1].mismatched == ["service", "userRole"] and rows[1].fieldOrderMatch and not rows[1].modelMatch
    assert [r[:1] for r in rows[1].recommendations] == ["⚠", "⚠", "💡"]
    compat = consistency.field_match(df, "d", "q", compat=True).filter("i = 1").first().fields
    # names with capitals are never found, and the narrative hides the first name
    assert compat.userRole.match and compat.userRole.document == "" and compat.outcome.match


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])]
    assert values(spark, "a array<double>, b array<double>", rows, vx.cosine(F.col("a"), F.col("b"))) == [1.0, -1.0, 0.0, 0.0]


def test_question_rules(spark):
    def one(text, expr):
        return values(spark, "t string", [text], expr)[0]

    t = F.col("t")
    assert one("What did I just ask about the top errors?", qn.intent(t)) == "CONVERSATIONAL"
    assert one("Top errors", qn.intent(t)) == "STATISTICAL" and one("hello", qn.intent(t)) == "SEMANTIC"
    assert one("a|b", qn.language(t)) == "English" and one("에러", qn.language(t)) == "Korean"
    assert one("it went by", qn.outcome_hint(t, F.lit(None).cast("boolean"), F.lit(None).cast("string"))) == "ANY"
    assert one("book a trip", qn.outcome_hint(t, F.lit(False), F.lit(""))) == "SUCCESS"  # "ok" inside a word
    assert one("book a trip", qn.outcome_hint(t, F.lit(False), F.lit(""), word_boundary=True)) == "ANY"
    assert one("half second", qn.latency_hint(t)) == "P_500_1000MS"
    assert one("x /a/B-1_c?d", qn.route_hint(t, F.lit(None).cast("string"))) == "/a/B-1_c"
    assert one(" Payment ", qn.normalize_service(t)) == "payments" and one("Odd", qn.normalize_service(t)) == "Odd"
    assert one("top 12 codes", qn.top_n(t)) == 12 and one("top codes", qn.top_n(t)) == 5
    assert one("card_expired?", qn.mentioned_code(t)) == "CARD_EXPIRED"
    assert one("x", qn.has_references(F.lit("show me"), F.lit(0))) is False
    assert one("x", qn.has_references(F.lit("show me"), F.lit(2))) is True


def test_standalone_guards_empty_text(spark):
    rows = [("a", ""), ("", ""), ("abc?", "abc"), ("abc", "zzzzzzz"), ("abcdefghi", "zzzzzzzzzz")]
    got = values(spark, "o string, r string", rows, qn.is_standalone(F.col("o"), F.col("r")))
    assert got == [True, True, True, False, True]


def test_time_ranges(spark):
    now = F.lit("2024-03-10 12:30:00").cast("timestamp")
    texts = ["last hour", "Last 3 days", "yesterday", "errors today", "none"]
    got = values(spark, "t string", texts, qn.time_range(F.col("t"), now))
    text = [None if r is None else (str(r.startTime), str(r.endTime)) for r in got]
    assert text == [
        ("2024-03-10 11:30:00", "2024-03-10 12:30:00"), ("2024-03-07 12:30:00", "2024-03-10 12:30:00"),
        ("2024-03-09 00:00:00", "2024-03-09 23:59:59"), ("2024-03-10 00:00:00", "2024-03-10 12:30:00"), None,
    ]


def test_grounding(spark):
    raw = [
        ("Answer: yes\nConfidence: 0.9", '```json\n{"action":"REJECT_ANSWER"}\n```'),
        ("plain", '{"action":"ADJUST_CONFIDENCE","confidenceAdjustment":0,"unverifiedClaims":[]}'),
        ("answer: a\nb\nconfidence: .5", '{"action":"ADJUST_CONFIDENCE","confidenceAdjustment":7,"unverifiedClaims":["c"]}'),
        ("Answer: k", '{"action":"KEEP_ANSWER"}'),
        ("Answer: u", "{broken"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(raw)], "i int, o string, v string")
    df = df.withColumn("a", grounding.parse_answer(F.col("o"))).withColumn("v", grounding.parse_verdict(F.col("v")))
    df = df.withColumn("d", grounding.decide(F.col("a.answer"), F.col("a.confidence"), F.col("v")))
    got = [(r.d.answer, round(r.d.confidence, 6)) for r in df.orderBy("i").collect()]
    assert got == [
        (grounding.REJECTED_ANSWER, 0.0), ("plain", 0.0),
        ("a\nb\n\n[Note: Some claims could not be fully verified: c]", 0.5), ("k", 0.5),
        ("u\n\n[Note: Some claims could not be fully verified: Verification process failed]", 0.15),
    ]


def test_cache_edges(spark):
    q = "queryId bigint, cacheKey string, askedAt timestamp, embedding array<float>"
    e = "entryId bigint, cacheKey string, cachedAt timestamp, ttlMs bigint, embedding array<float>"
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1, 0, 0)

    def at(ms):
        return t0 + dt.timedelta(milliseconds=ms)

    entries = spark.createDataFrame(
        [(1, "k", at(0), 900_000, [1.0, 0.0]), (2, "k", at(3_000_000), 3_600_000, [0.0, 1.0]), (3, "o", at(0), 3_600_000, [1.0, 0.0])], e
    )
    asks = spark.createDataFrame(
        [
            (1, "k", at(900_000), [1.0, 0.0]), (2, "k", at(900_001), [1.0, 0.0]), (3, "k", at(3_100_000), [1.0, 0.0]),
            (4, "k", at(3_100_000), [0.01, 1.0]), (5, "o", at(3_600_000), [1.0, 0.0]), (6, "o", at(3_600_001), [1.0, 0.0]), (7, "none", at(0), [1.0, 0.0]),
        ],
        q,
    )
    got = {r.queryId: r.hit for r in result_cache.lookup(asks, entries).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True, 6: False, 7: False}
    key = lambda start: result_cache.cache_key(F.lit("s"), F.lit(None), F.lit(None), F.lit(None), F.lit(start).cast("timestamp"), F.lit(None))
    r = spark.range(1).select(key("2024-01-01 10:05:00").alias("a"), key("2024-01-01 10:55:00").alias("b"), key("2024-01-01 11:05:00").alias("c")).first()
    assert r.a == r.b != r.c


def test_validation(spark):
    df = events(spark, event(1), event(2, role="boss"), event(3, service=""), event(4, role="admin"))
    valid, rejected = validation.split(df, validation.event_reasons())
    assert sorted(r.eventId for r in valid.collect()) == [1, 4]
    assert {r.eventId: r.reasons for r in rejected.collect()} == {2: ["user.role is unknown"], 3: ["service is empty"]}


def test_rows_with_null_keys_and_times_stay(spark):
    from lumenlog.operators import assembly, sessions
    from lumenlog.plans.timelines import running_total, with_next

    rows = [(None, 1, 2), (None, 2, 3), ("a", 1, 5), ("a", None, 7)]
    df = spark.createDataFrame(rows, "k string, at bigint, v bigint")
    total = running_total(df, ["k"], "at", [F.col("at")], "v", [10, 100], "sum").collect()
    assert sorted((r.k or "", r.at or 0, r.sum) for r in total) == [("", 1, 2), ("", 2, 5), ("a", 0, 7), ("a", 1, 12)]
    led = with_next(df, ["k"], "at", 10, {"v": "next"}).collect()
    assert sorted((r.k or "", r.at or 0, r.next) for r in led) == [("", 1, 3), ("", 2, None), ("a", 0, 5), ("a", 1, None)]
    once = assembly.finalize_once(df, ["at"], "k").collect()
    assert sorted((r.k or "", r.v) for r in once) == [("", 2), ("", 3), ("a", 7)]

    t = dt.datetime(2024, 1, 1)
    calls = [("r1", t, t + dt.timedelta(seconds=5)), ("r2", None, None), ("r3", t, t + dt.timedelta(seconds=1))]
    spans = spark.createDataFrame(calls, "requestId string, a timestamp, b timestamp")
    assert audits.concurrency(spans, "a", "b").count() == 3
    events = spark.createDataFrame(
        [(f"r{i}", t if i % 2 else None, {"code": "E"} if i % 5 == 0 else None, {"durationMs": 3000 if i % 7 == 0 else 1}) for i in range(100)],
        "requestId string, timestamp timestamp, error struct<code:string>, performance struct<durationMs:bigint>",
    )
    decided = sampling.decide_adaptive(events, sampling.SamplingPolicy(normal_rate=0.0)).collect()
    assert len(decided) == 100 and sum(r.reason == "HAS_ERROR" for r in decided) == 20
    history = [(None, None, 1, "q", "a"), (None, t, 2, "q2", "a2"), ("s", None, 1, "q3", "a3")]
    turns = spark.createDataFrame(history, "sessionId string, createdAt timestamp, turn bigint, question string, answer string")
    assert sessions.summariser_lines(turns).count() == 3


def test_top_numbers_are_read_whole(spark):
    from lumenlog.functions import questions

    rows = [("top 1000000 codes",), ("top 99999999999999999999",), ("top 0",), ("Top 7",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(questions.top_n(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [1000000, 5, 5, 7, 5]


def test_bounded_objects_keep_their_first_twenty_keys_in_input_order(spark):
    body = "{" + ",".join(f'"k{i:02d}":{{"z":"{i}","a":[{i},"x",true]}}' for i in range(24, -1, -1)) + "}"
    df = spark.createDataFrame([('{"big":' + body + ',"s":"true","t":true}', "{}", "{}", "{}")], "body string, params string, query string, headers string")
    m = df.select(nz.request_meta(["body.big", "body.s", "body.t"])).first()[0]
    kept = "{" + ",".join(f'"k{i:02d}":{{"z":"{i}","a":"[Array(3)]"}}' for i in range(24, 4, -1)) + "}"
    assert m == {"big": kept, "s": "true", "t": "true"}
