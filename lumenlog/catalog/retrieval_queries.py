"""Registered queries: embeddings, vector search, chunks, consistency."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.catalog import fixtures as fx
from lumenlog.catalog import sqltext as q
from lumenlog.catalog.metrics_queries import _top_flat, top_sql
from lumenlog.catalog.question_queries import STRUCTURED, asked, meta_args
from lumenlog.catalog.registry import query
from lumenlog.functions import events as ev
from lumenlog.functions import questions as qn
from lumenlog.functions import text as tx
from lumenlog.functions import vectors as vx
from lumenlog.operators import chunks, clusters, consistency, density, embedding, incidents, retrieval, vector_index
from lumenlog.operators.filters import QueryMetadata, grounding_postfilter
from lumenlog.session import fresh_path, materialize

E = ("event_embeddings",)

# Query vectors: the mean vector of every label, one query per label.
CENTROIDS = """cent AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (
  SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM event_embeddings) GROUP BY 1, 2) GROUP BY 1)"""


def label_queries(spark, sf):
    e = fx.embedded(spark, sf).select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vec = F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
    return means.groupBy(F.col("label").cast("bigint").alias("queryId")).agg(vec.alias("embedding"))


SERVICE_OF_LABEL = "CASE label % 3 WHEN 0 THEN 'payments' WHEN 1 THEN 'absent' END"


def _service_of_label():
    k = F.col("queryId") % 3
    return F.when(k == 0, "payments").when(k == 1, "absent")


def _ranked(score_table, k):
    return f"""SELECT query_id, event_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) AS rank FROM {score_table}
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) <= {k}"""


def _names(df):
    return df.select(
        F.col("queryId").alias("query_id"), F.col("eventId").alias("event_id"), F.round("score", 6).alias("score"), "rank"
    )


SCORES = f"""{CENTROIDS}, s AS (SELECT c.label::BIGINT AS query_id, e.event_id, round(list_cosine_similarity(c.c, e.embedding::DOUBLE[]), 12) AS score, e.service, e.event_ts, c.label
  FROM cent c, event_embeddings e)"""


@query(
    "f1_cosine",
    f"""WITH {CENTROIDS} SELECT e.event_id, round(list_cosine_similarity(c.c, e.embedding::DOUBLE[]), 6) AS similarity
    FROM event_embeddings e JOIN cent c ON c.label = e.label""",
    E,
)
def _(spark, sf):
    cent = label_queries(spark, sf).select(F.col("queryId").cast("int").alias("label"), F.col("embedding").alias("c"))
    both = fx.embedded(spark, sf).join(cent, "label")
    return both.select(F.col("eventId").alias("event_id"), F.round(vx.cosine(F.col("c"), F.col("embedding")), 6).alias("similarity"))


@query("f2_vector_top_k", f"WITH {SCORES} SELECT query_id, event_id, round(score, 6) AS score, rank FROM ({_ranked('s', 10)})", E)
def _(spark, sf):
    return _names(retrieval.top_k(label_queries(spark, sf), fx.embedded(spark, sf), 10))


@query(
    "f2_filtered_top_k",
    f"""WITH {SCORES}, f AS (SELECT * FROM s WHERE (label % 3 <> 0 OR service = 'payments') AND event_ts >= TIMESTAMP '2024-01-01 06:00:00')
    SELECT query_id, event_id, round(score, 6) AS score, rank FROM ({_ranked('f', 5)})""",
    E,
)
def _(spark, sf):
    queries = label_queries(spark, sf).withColumn("service", F.when(F.col("queryId") % 3 == 0, "payments"))
    queries = queries.withColumn("startTime", F.lit("2024-01-01 06:00:00").cast("timestamp"))
    return _names(retrieval.top_k(queries, fx.embedded(spark, sf), 5))


# Every vector asks, in blocks far smaller than their number.
@query(
    "f2_every_vector_asks",
    f"""WITH s AS (SELECT a.event_id AS query_id, b.event_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS score
      FROM event_embeddings a, event_embeddings b)
    SELECT query_id, event_id, round(score, 6) AS score, rank FROM ({_ranked('s', 3)})""",
    E,
)
def _(spark, sf):
    e = fx.embedded(spark, sf)
    return _names(retrieval.top_k(e.select(F.col("eventId").alias("queryId"), "embedding"), e, 3, block_queries=100))


# Approximate: every returned score is exact, and of the five nearest of a query at least four are found.
@query("f3_ann_top_k", f"WITH {CENTROIDS} SELECT label::BIGINT AS query_id, 5::BIGINT AS hits, TRUE AS scores_exact, TRUE AS recall_ok FROM cent", E)
def _(spark, sf):
    e, asked = fx.embedded(spark, sf), label_queries(spark, sf)
    found = retrieval.ann_top_k(asked, retrieval.signatures(e, 64), 5, 64, block_queries=4)
    best = retrieval.top_k(asked, e, 5).select("queryId", "eventId", F.lit(True).alias("near"))
    true = asked.select("queryId", F.col("embedding").alias("q"))
    return (
        found.join(best, ["queryId", "eventId"], "left")
        .join(true, "queryId")
        .join(e.select("eventId", "embedding"), "eventId")
        .withColumn("exact", F.abs(F.col("score") - vx.cosine(F.col("q"), F.col("embedding"))) < 1e-9)
        .groupBy(F.col("queryId").alias("query_id"))
        .agg(F.count("*").alias("hits"), F.bool_and("exact").alias("scores_exact"), (F.count("near") >= 4).alias("recall_ok"))
    )


# Every vector asks a stored index for its five nearest: the scores are exact, and nine in ten of the true ones are found.
@query(
    "f3_indexed_top_k",
    "SELECT 5 * count(*) AS hits, TRUE AS scores_exact, TRUE AS recall_ok, TRUE AS sample_ok FROM event_embeddings",
    E,
)
def _(spark, sf):
    e = materialize(fx.embedded(spark, sf).select("eventId", "embedding", "service", "timestamp"), "vectors")  # joined once
    plan = vector_index.build_index(e, fresh_path(spark, "vector-index"), 64)
    asked = e.select(F.col("eventId").alias("queryId"), "embedding")
    found = vector_index.indexed_top_k(asked, e, plan, 5)
    best = retrieval.top_k(asked, e, 5).select("queryId", "eventId", F.col("score").alias("best"), F.lit(True).alias("near"))
    return found.join(best, ["queryId", "eventId"], "left").agg(
        F.count("*").alias("hits"), F.bool_and(F.coalesce(F.abs(F.col("score") - F.col("best")) < 1e-9, F.lit(True))).alias("scores_exact"),
        (F.count("near") >= 0.9 * F.count("*")).alias("recall_ok"), F.lit(plan.recall >= 0.9).alias("sample_ok"),
    )


FALLBACK = f"""{SCORES}, svc AS (SELECT *, {SERVICE_OF_LABEL} AS wanted FROM s), strict AS (SELECT * FROM svc WHERE wanted IS NULL OR service = wanted),
  f AS (SELECT * FROM strict UNION ALL SELECT * FROM svc WHERE query_id NOT IN (SELECT query_id FROM strict))"""


@query("f4_service_fallback", f"WITH {FALLBACK} SELECT query_id, event_id, round(score, 6) AS score, rank FROM ({_ranked('f', 5)})", E)
def _(spark, sf):
    queries = label_queries(spark, sf).withColumn("service", _service_of_label())
    return _names(retrieval.top_k(queries, fx.embedded(spark, sf), 5, relax_service=True))


# Each label's question is fixed text; documents are the canonical summaries.
ASK = "CASE label % 3 WHEN 0 THEN 'payments failed with gateway timeout' WHEN 1 THEN 'slow orders for premium user' ELSE 'users profile success' END"


def _ask(k):
    return (
        F.when(k % 3 == 0, "payments failed with gateway timeout")
        .when(k % 3 == 1, "slow orders for premium user")
        .otherwise("users profile success")
    )


TOK = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9가-힣]+'), lambda t: t <> '')"
RERANK = f"""{SCORES}, h AS ({_ranked('s', 10)}),
  d AS (SELECT h.query_id, h.event_id, h.rank AS first_rank, {ASK.replace('label', 'h.query_id')} AS ask, {q.SUMMARY} AS doc FROM h JOIN wide_events USING (event_id)),
  o AS (SELECT *, len(list_intersect(list_distinct({TOK.format('ask')}), {TOK.format('doc')})) / len(list_distinct({TOK.format('ask')}))::DOUBLE AS relevance FROM d),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, first_rank) AS k FROM o)"""


def _reranked(spark, sf):
    hits = retrieval.top_k(label_queries(spark, sf), fx.embedded(spark, sf), 10)
    docs = fx.stored_events(spark, sf).select("eventId", F.col("_summary").alias("doc"))
    return retrieval.rerank(hits.join(docs, "eventId").withColumn("ask", _ask(F.col("queryId"))), "ask", "doc", 5)


@query("f5_rerank", f"WITH {RERANK} SELECT query_id, event_id, round(relevance, 6) AS relevance, k AS rank FROM r WHERE k <= 5", E)
def _(spark, sf):
    return _reranked(spark, sf).select(
        F.col("queryId").alias("query_id"), F.col("eventId").alias("event_id"), F.round("relevance", 6).alias("relevance"), "rank"
    )


@query(
    "f6_grounding_pack",
    f"WITH {RERANK} SELECT query_id, k AS rank, request_id, error_code FROM r JOIN wide_events USING (event_id) WHERE k <= 5 AND error_code IS NOT NULL",
    E,
)
def _(spark, sf):
    pack = retrieval.ground(_reranked(spark, sf), fx.events(spark, sf))
    kept = grounding_postfilter(pack, QueryMetadata(has_error=True))
    return kept.select(
        F.col("queryId").alias("query_id"), "rank", F.col("requestId").alias("request_id"), F.col("error.code").alias("error_code")
    )


@query("f6_sources", f"WITH {RERANK} SELECT query_id, string_agg('req-' || event_id, ',' ORDER BY k) AS sources FROM r WHERE k <= 5 GROUP BY 1", E)
def _(spark, sf):
    pack = retrieval.ground(_reranked(spark, sf), fx.events(spark, sf).select("eventId", "requestId"))
    return retrieval.sources(pack).select(F.col("queryId").alias("query_id"), F.array_join("sources", ",").alias("sources"))


@query(
    "f7_pending_events",
    """WITH mark AS (SELECT max((event_ts, event_id)) AS m FROM event_embeddings)
    SELECT event_id FROM wide_events WHERE (event_ts, event_id) > (SELECT m FROM mark)""",
    E,
)
def _(spark, sf):
    progress = embedding.advance_mark(fx.embedded(spark, sf), "wide_events", F.lit("2024-02-01").cast("timestamp"))
    pending = embedding.pending_events(fx.stored_events(spark, sf), embedding.read_mark(progress, "wide_events"))
    return pending.select(F.col("eventId").alias("event_id"))


VECTOR = f"""WITH {q.DUAL_VIEW}, t AS (SELECT event_id, unnest({TOK.format('dual_text')}) AS w FROM dual),
  c AS (SELECT event_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS slot, count(*) AS n FROM t GROUP BY 1, 2),
  l AS (SELECT event_id, sqrt(sum(n * n)) AS len FROM c GROUP BY 1)"""


@query(
    "f8_hashed_embedding",
    VECTOR + " SELECT event_id, string_agg(slot::VARCHAR || ':' || round(n / len * 10000)::BIGINT::VARCHAR, ' ' ORDER BY slot) AS weights FROM c JOIN l USING (event_id) GROUP BY 1",
    ("wide_events",),
)
def _(spark, sf):
    out = embedding.embed_events(fx.events(spark, sf), F.lit("2024-02-01").cast("timestamp"))

    def cell(x, i):
        weight = F.round(x.cast("double") * 10_000).cast("bigint")
        return F.when(x > 0, F.concat(i.cast("string"), F.lit(":"), weight.cast("string")))

    return out.select(F.col("eventId").alias("event_id"), F.array_join(F.transform("embedding", cell), " ").alias("weights"))


@query(
    "f9_append_and_mark",
    """SELECT 'wide_events' AS source, count(*) AS appended, arg_max(event_id, (event_ts, event_id)) AS last_event_id, max(event_ts) AS last_event_ts
    FROM wide_events WHERE event_id NOT IN (SELECT vec_id FROM embeddings)""",
    ("wide_events",),
)
def _(spark, sf):
    now = F.lit("2024-02-01").cast("timestamp")
    # embedded once, however many ranges and runs read it
    batch = materialize(embedding.embed_events(fx.stored_events(spark, sf), now), "embedded-batch")
    table, progress = fresh_path(spark, "embeddings"), fresh_path(spark, "progress")
    before = batch.join(fx.embedded(spark, sf).select("eventId"), "eventId", "left_semi")
    before.write.parquet(table)
    fresh = embedding.new_rows(batch, before)
    for _ in range(2):  # the second run finds nothing to add
        embedding.append_embeddings(fresh, table, progress, "wide_events", now)
    n = spark.read.parquet(table).count() - before.count()
    mark = spark.read.parquet(progress).groupBy("source").agg(F.max(F.struct("lastEmbeddedEventTimestamp", "lastEmbeddedEventId")).alias("m"))
    return mark.select("source", F.lit(n).cast("long").alias("appended"), F.col("m.lastEmbeddedEventId").alias("last_event_id"), F.col("m.lastEmbeddedEventTimestamp").alias("last_event_ts"))


# The same by days: the table holds the events that have a vector, a second run adds nothing.
@query(
    "f9_append_by_day",
    """SELECT CAST(event_ts AS DATE)::VARCHAR AS day, count(*) AS rows_of_day, count(*) FILTER (event_id IN (SELECT vec_id FROM embeddings)) AS before,
      TRUE AS runs_ok, (SELECT max(event_id) FROM wide_events WHERE event_ts = (SELECT max(event_ts) FROM wide_events)) AS last_event_id FROM wide_events GROUP BY 1""",
    ("wide_events",),
)
def _(spark, sf):
    now = F.lit("2024-02-01").cast("timestamp")
    # embedded once, however many ranges and runs read it
    batch = materialize(embedding.embed_events(fx.stored_events(spark, sf), now), "embedded-batch")
    table, progress = fresh_path(spark, "embeddings"), fresh_path(spark, "progress")
    before = batch.join(fx.embedded(spark, sf).select("eventId"), "eventId", "left_semi")
    runs = [embedding.append_by_day(rows, table, progress, "wide_events", now) for rows in (before, batch, batch)]
    ok = F.lit(all(r.error is None and r.done == r.groups for r in runs))
    held = spark.read.parquet(table).join(before.select("eventId", F.lit(True).alias("_old")), "eventId", "left")
    mark = spark.read.parquet(progress).agg(F.max(F.struct("lastEmbeddedEventTimestamp", "lastEmbeddedEventId")).alias("m"))
    days = held.groupBy(F.col("event_date").cast("string").alias("day")).agg(F.count("*").alias("rows_of_day"), F.count("_old").alias("before"))
    return days.withColumns({"runs_ok": ok, "last_event_id": mark.select("m.lastEmbeddedEventId").scalar()})


@query("f8_token_usage", f"WITH {q.DUAL_VIEW} SELECT event_id, len({TOK.format('dual_text')}) AS tokens FROM dual", ("wide_events",))
def _(spark, sf):
    return embedding.token_usage(fx.events(spark, sf)).select(F.col("eventId").alias("event_id"), "tokens")


# --- chunks ---------------------------------------------------------------------
WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160) || chr(65279) || chr(8232) || chr(8233)"
PACK = f"""WITH parts AS (SELECT doc_id, list_filter(string_split(text, ', '), lambda p: trim(p, {WS}) <> '') AS ps, text FROM documents),
  packed AS (SELECT doc_id, text, list_reduce(list_transform(ps, lambda p: {{'cur': p, 'out': []::VARCHAR[]}}),
    lambda acc, x: CASE WHEN length(acc.cur) > 0 AND length(acc.cur) + length(x.cur) + 2 > 200 THEN {{'cur': x.cur, 'out': list_append(acc.out, trim(acc.cur, {WS}))}}
      WHEN length(acc.cur) > 0 THEN {{'cur': acc.cur || ', ' || x.cur, 'out': acc.out}} ELSE {{'cur': x.cur, 'out': acc.out}} END,
    {{'cur': '', 'out': []::VARCHAR[]}}) AS r FROM parts),
  c AS (SELECT doc_id, CASE WHEN length(text) <= 200 THEN [text] WHEN trim(r.cur, {WS}) <> '' THEN list_append(r.out, trim(r.cur, {WS})) ELSE r.out END AS cs FROM packed)"""


@query("f10_chunk_by_length", PACK + " SELECT doc_id, i - 1 AS chunk_no, chunk FROM (SELECT doc_id, unnest(cs) AS chunk, generate_subscripts(cs, 1) AS i FROM c)")
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    return chunks.explode_chunks(docs, tx.chunk_summary(F.col("text")), ["doc_id"])


@query(
    "f11_overlapping_chunks",
    f"""WITH n AS (SELECT doc_id, text, CASE WHEN length(text) <= 150 THEN 1 ELSE ceil((length(text) - 150) / 120.0)::BIGINT + 1 END AS k FROM documents),
    i AS (SELECT doc_id, text, unnest(range(k)) AS i FROM n)
    SELECT doc_id, i AS chunk_no, CASE WHEN length(text) <= 150 THEN text ELSE trim(substr(text, i * 120 + 1, 150), {WS}) END AS chunk FROM i""",
)
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    return chunks.explode_chunks(docs, tx.overlapping_chunks(F.col("text")), ["doc_id"])


@query(
    "f12_chunk_by_fields",
    f"""WITH {q.DUAL_VIEW}, p AS (SELECT event_id, unnest(list_filter(string_split(dual_text, ', '), lambda p: trim(p, {WS}) <> '')) AS p,
      generate_subscripts(list_filter(string_split(dual_text, ', '), lambda p: trim(p, {WS}) <> ''), 1) - 1 AS chunk_no FROM dual)
    SELECT event_id, chunk_no, trim(p, {WS}) AS chunk, CASE WHEN instr(p, ':') > 1 THEN lower(substr(p, 1, instr(p, ':') - 1)) END AS field FROM p""",
    ("wide_events",),
)
def _(spark, sf):
    text = ev.dual_layer_summary(**ev.event_args())
    parts = fx.events(spark, sf).select(F.col("eventId").alias("event_id"), F.posexplode(tx.chunk_by_fields(text)).alias("chunk_no", "c"))
    return parts.select("event_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.col("c.text").alias("chunk"), "c.field")


@query("f13_should_chunk", "SELECT doc_id, length(text) > 200 AS should_chunk FROM documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", tx.should_chunk(F.col("text")).alias("should_chunk"))


# --- consistency -------------------------------------------------------------------
@query(
    "f14_field_map",
    f"""SELECT event_id, {q.OUTCOME} AS outcome, service, coalesce(error_code, 'NONE') AS error, {q.BUCKET} AS latencybucket, 7::BIGINT AS fields FROM wide_events""",
    ("wide_events",),
)
def _(spark, sf):
    m = fx.stored_events(spark, sf).select("eventId", tx.field_map(F.col("_summary")).alias("m"))
    return m.select(
        F.col("eventId").alias("event_id"), *[F.col("m")[k].alias(k) for k in ("outcome", "service", "error", "latencybucket")],
        F.size("m").cast("bigint").alias("fields"),
    )


# Each logged question is paired with the event of the same id.
def _pairs(spark, sf):
    docs = fx.events(spark, sf).select("eventId", ev.dual_layer_summary(**ev.event_args()).alias("document"))
    pairs = asked(spark, sf).select(
        F.col("query_id").alias("eventId"), qn.structured_text(F.col("text"), **meta_args()).alias("query")
    )
    model = F.when(F.col("eventId") % 9 == 0, F.lit("other")).otherwise("hash-64")
    return docs.join(pairs, "eventId").withColumn("docModel", F.lit("hash-64")).withColumn("queryModel", model)


LAST = "string_split({0}, chr(10) || chr(10))[-1]"
ENTRIES = "list_transform(list_filter(string_split({0}, ', '), lambda p: instr(p, ':') > 1), lambda p: {{'n': lower(trim(substr(p, 1, instr(p, ':') - 1))), 'v': trim(substr(p, instr(p, ':') + 1))}})"
PAIRS = f"""WITH {q.DUAL_VIEW}, z AS (SELECT query_id, {STRUCTURED} AS query FROM query_log),
  p AS (SELECT event_id, {ENTRIES.format(LAST.format('dual_text'))} AS d, {ENTRIES.format(LAST.format('query'))} AS q,
    CASE WHEN event_id % 9 = 0 THEN 'other' ELSE 'hash-64' END AS qm FROM dual JOIN z ON z.query_id = event_id)"""


def _val(side, name):
    return f"list_filter({side}, lambda e: e.n = '{name.lower()}')[-1].v"


def _match(name, always):
    d, v = _val("d", name), _val("q", name)
    return f"({d} IS NOT DISTINCT FROM {v} OR coalesce({v} IN ({', '.join(chr(39) + a + chr(39) for a in always)}), FALSE))"


MATCHES = {f: _match(f, a) for f, a in consistency.FIELDS.items()}


@query("f15_field_match", PAIRS + " SELECT event_id, " + ", ".join(f"{m} AS {f}_match" for f, m in MATCHES.items()) + " FROM p", ("wide_events", "query_log"))
def _(spark, sf):
    m = consistency.field_match(_pairs(spark, sf), "document", "query")
    return m.select(F.col("eventId").alias("event_id"), *[F.col(f"fields.{f}.match").alias(f"{f}_match") for f in consistency.FIELDS])


ORDER = "list_transform(d, lambda e: e.n) = list_transform(q, lambda e: e.n)"


@query("f16_field_order", PAIRS + f" SELECT event_id, {ORDER} AS same_order FROM p", ("wide_events", "query_log"))
def _(spark, sf):
    return _pairs(spark, sf).select(
        F.col("eventId").alias("event_id"), consistency.same_order(F.col("document"), F.col("query")).alias("same_order")
    )


WRONG = "list_filter([" + ", ".join(
    f"CASE WHEN NOT {m} AND coalesce({_val('q', f)}, '') NOT IN ('ANY', 'NONE') THEN '{f}' END" for f, m in MATCHES.items()
) + "], lambda x: x IS NOT NULL)"
REPORT = PAIRS + f""", w AS (SELECT *, {WRONG} AS wrong, {ORDER} AS same_order, qm = 'hash-64' AS same_model FROM p)"""


@query(
    "f17_consistency_report",
    REPORT
    + f""" SELECT event_id, same_order, same_model, array_to_string(wrong, ',') AS mismatched,
      (NOT same_model)::INT::BIGINT + (NOT same_order)::INT::BIGINT + (len(wrong) > 0)::INT::BIGINT
      + (coalesce({_val('q', 'route')}, '') = 'ANY')::INT::BIGINT + (same_model AND same_order AND len(wrong) = 0)::INT::BIGINT AS advice,
      CASE WHEN NOT same_model THEN '⚠️ Model mismatch: Document uses "hash-64" but query uses "other". Use the same model for both.'
        WHEN NOT same_order THEN '{consistency.ADVICE_ORDER}' ELSE '{consistency.ADVICE_GOOD}' END AS first_advice FROM w""",
    ("wide_events", "query_log"),
)
def _(spark, sf):
    r = consistency.consistency_report(_pairs(spark, sf), "document", "query", "docModel", "queryModel")
    return r.select(
        F.col("eventId").alias("event_id"), F.col("fieldOrderMatch").alias("same_order"), F.col("modelMatch").alias("same_model"),
        F.array_join("mismatched", ",").alias("mismatched"), F.size("recommendations").cast("bigint").alias("advice"),
        F.col("recommendations")[0].alias("first_advice"),
    )


@query(
    "f17_consistency_rollup",
    REPORT
    + """ SELECT count(*) AS pairs, count(*) FILTER (same_model AND same_order AND len(wrong) = 0) AS consistent, count(*) FILTER (NOT same_model) AS model_mismatches,
      count(*) FILTER (NOT same_order) AS order_mismatches, """
    + ", ".join(f"count(*) FILTER (NOT {m}) AS {f}_mismatches" for f, m in MATCHES.items())
    + " FROM w",
    ("wide_events", "query_log"),
)
def _(spark, sf):
    r = consistency.consistency_report(_pairs(spark, sf), "document", "query", "docModel", "queryModel")
    return consistency.consistency_rollup(r).toDF(
        "pairs", "consistent", "model_mismatches", "order_mismatches", *[f"{f}_mismatches" for f in consistency.FIELDS]
    )


# --- searches that feed metrics ------------------------------------------------------
QUANT = f"""{SCORES}, h AS ({_ranked('s', 5)}),
  scope AS (SELECT * FROM wide_events WHERE error_code IN (SELECT error_code FROM wide_events JOIN h USING (event_id) WHERE error_code IS NOT NULL))"""


@query("e19_quantify_hits", "WITH " + QUANT + ", " + top_sql("error_code IS NOT NULL", "scope")[5:], E)
def _(spark, sf):
    hits = retrieval.top_k(label_queries(spark, sf), fx.embedded(spark, sf), 5)
    return _top_flat(incidents.quantify_hits(fx.events(spark, sf), hits))


def _incident_rows(spark, sf):
    return fx.embedded(spark, sf).join(fx.events(spark, sf).select("eventId", "error"), "eventId")


# k-means has no SQL form; whatever the clusters are, they part the events without loss.
@query(
    "f18_kmeans_clusters",
    """SELECT count(*) AS events, count(error_code) AS errors, min(w.event_ts) AS started, max(w.event_ts) AS ended, TRUE AS clusters_ok, TRUE AS severities_ok
    FROM event_embeddings e JOIN wide_events w USING (event_id)""",
    ("wide_events", "event_embeddings"),
)
def _(spark, sf):
    c = clusters.cluster_incidents(_incident_rows(spark, sf), k=8)
    severe = F.when(F.col("errors") * 2 > F.col("events"), "ERROR").when(F.col("errors") > 0, "WARN").otherwise("NORMAL")
    return c.agg(
        F.sum("events").alias("events"), F.sum("errors").alias("errors"), F.min("startTime").alias("started"), F.max("lastTime").alias("ended"),
        (F.count("*").between(2, 8) & (F.countDistinct("incidentId") == F.count("*"))).alias("clusters_ok"), F.bool_and(F.col("severity") == severe).alias("severities_ok"),
    )


# Every vector is nearest to its own centre, or nearly every one, and the clusters hold together better than a Lloyd run would by chance.
@query(
    "f18_cluster_quality",
    "SELECT count(*) AS events, TRUE AS nearest_ok, TRUE AS tighter_than_dealt, TRUE AS silhouette_ok FROM event_embeddings",
    E,
)
def _(spark, sf):
    found = materialize(clusters.assign_clusters(fx.embedded(spark, sf), k=8).select("eventId", "embedding", "cluster"), "clusters")
    total = lambda q: q.agg(
        F.sum("members").alias("events"), (F.sum(F.col("nearestShare") * F.col("members")) / F.sum("members")).alias("nearest"),
        (F.sum(F.col("cohesion") * F.col("members")) / F.sum("members")).alias("cohesion"),
        (F.sum(F.col("silhouette") * F.col("members")) / F.sum("members")).alias("silhouette"),
    )
    dealt = found.withColumn("cluster", F.pmod(F.xxhash64("eventId"), F.lit(8)).cast("int"))
    random = total(clusters.cluster_quality(dealt)).select("cohesion").scalar()
    return total(clusters.cluster_quality(found)).select(
        "events", (F.col("nearest") >= 0.95).alias("nearest_ok"), (F.col("cohesion") > 1.5 * random).alias("tighter_than_dealt"),
        (F.col("silhouette") > 0).alias("silhouette_ok"),
    )


# Every request of the clustered events is traced, in one incident each.
@query("f18_related_traces", "SELECT request_id, 1::BIGINT AS incidents FROM event_embeddings", E)
def _(spark, sf):
    traces = clusters.related_traces(clusters.assign_clusters(_incident_rows(spark, sf), k=8))
    return traces.groupBy(F.col("requestId").alias("request_id")).agg(F.count("*").alias("incidents"))


# Similar at 0.35 and more, four points to a core; the cluster is named by its smallest core.
DENSITY = """near AS (SELECT a.event_id AS a, b.event_id AS b FROM event_embeddings a, event_embeddings b
    WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) >= 0.35),
  n AS (SELECT a AS event_id, count(*) AS neighbours FROM near GROUP BY 1), core AS (SELECT event_id FROM n WHERE neighbours >= 4),
  linked AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
  reach AS (SELECT event_id AS node, event_id AS root FROM core UNION SELECT l.b, r.root FROM reach r JOIN linked l ON l.a = r.node),
  c AS (SELECT node, min(root) AS cluster FROM reach GROUP BY 1)"""


@query(
    "f19_density_clusters",
    f"""WITH RECURSIVE {DENSITY}
    SELECT n.event_id, n.neighbours, CASE WHEN n.neighbours >= 4 THEN 'core' WHEN count(c.cluster) > 0 THEN 'border' ELSE 'noise' END AS kind,
      coalesce(CASE WHEN n.neighbours >= 4 THEN min(o.cluster) ELSE min(c.cluster) END, -1) AS cluster
    FROM n LEFT JOIN near ON near.a = n.event_id LEFT JOIN c ON c.node = near.b LEFT JOIN c o ON o.node = n.event_id GROUP BY 1, 2""",
    E,
)
def _(spark, sf):
    found = density.density_clusters(fx.embedded(spark, sf), 0.35, 4)
    return found.select(F.col("id").alias("event_id"), "neighbours", "kind", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
