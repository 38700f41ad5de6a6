"""Filtered vector top-k, approximate candidates, reranking and grounding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.functions import vectors as vx
from lumenlog.operators.embedding import tokens
from lumenlog.plans.ranks import first_n_per_group
from lumenlog.session import materialize

# Query vectors of a block, which travels to every task: 2048 vectors of 512 doubles are 8 MB.
BLOCK_QUERIES = 2048
# Vectors scored at once: with a block of queries 32 MB of scores.
SCORED_ROWS = 2048
# Vectors of a tile: 65536 of 512 doubles are 256 MB.
BLOCK_ROWS = 65536
# Queries of a tile at most (a sixteenth of them, if fewer), scored BLOCK_QUERIES at once: every block sends all vectors once more.
TILE_QUERIES = 16384
SCORE_DIGITS = 12
# Standard deviations of a binomial number of differing bits that a search by signatures allows for.
SURE = 3.0

HITS = "queryId bigint, tier int, eventId bigint, score double"
HITS_ARROW = pa.schema([("queryId", pa.int64()), ("tier", pa.int32()), ("eventId", pa.int64()), ("score", pa.float64())])
_NEAR = pa.schema([("queryId", pa.int64()), ("eventId", pa.int64()), ("far", pa.int64())])
QUERIES_ARROW = pa.schema(
    [
        ("queryId", pa.int64()),
        ("embedding", pa.list_(pa.float64())),
        ("service", pa.string()),
        ("startTime", pa.int64()),
        ("endTime", pa.int64()),
    ]
)


def _best(key: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` smallest keys, ties by id."""
    if len(key) > 4 * k:
        cut = np.partition(key, k - 1)[k - 1]
        keep = np.flatnonzero(key <= cut)
        return keep[np.lexsort((ids[keep], key[keep]))[:k]]
    return np.lexsort((ids, key))[:k]


def _one(column):
    """A contiguous array of a table column."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _vectors(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths with -1 for null, start offsets, flat values) of a list column."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()[:-1]
    return lengths, offsets, column.values.to_numpy(zero_copy_only=False)


def _unit_rows(start: np.ndarray, dim: int, flat: np.ndarray) -> np.ndarray:
    """Normalised vectors of equal length as a matrix; zero vectors stay zero."""
    m = flat[start[:, None] + np.arange(dim)].astype("float64")
    size = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


class _Probe:
    """A bounded block of query vectors with their filters, ready to score batches."""

    def __init__(self, queries: pa.Table, tiers: int):
        self.ids = queries["queryId"].to_numpy()
        self.service = queries["service"].to_pylist()
        self.start = queries["startTime"].to_pylist()
        self.end = queries["endTime"].to_pylist()
        self.tiers = tiers
        lengths, offsets, flat = _vectors(_one(queries["embedding"]))
        self.groups = {}
        for dim in set(lengths[lengths > 0].tolist()):
            rows = np.flatnonzero(lengths == dim)
            self.groups[dim] = (rows, _unit_rows(offsets[rows], dim, flat))

    def top(self, batch: pa.Table | pa.RecordBatch, k: int, least: np.ndarray | None = None) -> pa.Table:
        """Best ``k`` rows of the batch per query and tier; of a query without filters, those that score ``least`` or more."""
        lengths, offsets, flat = _vectors(_one(batch["embedding"]))
        ids = _one(batch["eventId"]).to_numpy(zero_copy_only=False)
        at = _one(batch["timestamp"]).cast(pa.int64()).fill_null(-(2**62)).to_numpy(zero_copy_only=False)
        scores = np.zeros((len(self.ids), len(ids)))
        for dim, (rows, unit) in self.groups.items():
            cols = np.flatnonzero(lengths == dim)
            if len(cols):
                scores[np.ix_(rows, cols)] = unit @ _unit_rows(offsets[cols], dim, flat).T
        np.negative(np.round(scores, SCORE_DIGITS, out=scores), out=scores)
        names = _one(batch["service"])
        wanted = {s for s in self.service if s is not None}
        by_service = {s: pc.equal(names, s).fill_null(False).to_numpy(zero_copy_only=False) for s in wanted}
        found: list[tuple] = []
        free = np.array([f == (None, None, None) for f in zip(self.service, self.start, self.end, strict=True)], dtype=bool)
        if free.any() and (lengths >= 0).any():
            # no filter: one threshold per query leaves few rows to sort, ties included
            rows, cols = np.flatnonzero(free), np.flatnonzero(lengths >= 0)
            keys = scores[np.ix_(rows, cols)]
            bar = np.partition(keys, k - 1, axis=1)[:, k - 1] if keys.shape[1] > k else np.full(len(rows), np.inf)
            if least is not None:
                bar = np.minimum(bar, -least[rows])
            q, c = np.nonzero(keys <= bar[:, None])
            order = np.lexsort((ids[cols[c]], keys[q, c], q))
            q, c = q[order], c[order]
            first = np.searchsorted(q, q)
            kept = np.arange(len(q)) - first < k
            q, c = q[kept], c[kept]
            found.append((self.ids[rows[q]], np.zeros(len(q), "int32"), ids[cols[c]], -keys[q, c]))
        for q, qid in enumerate(self.ids):
            if free[q]:
                continue
            mask = lengths >= 0
            if self.start[q] is not None:
                mask = mask & (at >= self.start[q])
            if self.end[q] is not None:
                mask = mask & (at <= self.end[q])
            service = self.service[q]
            masks = [mask if service is None else mask & by_service[service]]
            if self.tiers == 2 and service is not None:
                masks.append(mask)
            for tier, m in enumerate(masks):
                idx = np.flatnonzero(m)
                best = idx[_best(scores[q, idx], ids[idx], k)]
                n = len(best)
                found.append((np.full(n, qid), np.full(n, tier, "int32"), ids[best], -scores[q, best]))
        if not found:
            return HITS_ARROW.empty_table()
        return pa.table([np.concatenate(c) for c in zip(*found)], schema=HITS_ARROW)


def _keep_best(parts: list[pa.Table], k: int) -> pa.Table:
    """Best ``k`` rows per query and tier of several partial results."""
    every = pa.concat_tables(parts).sort_by(
        [("queryId", "ascending"), ("tier", "ascending"), ("score", "descending"), ("eventId", "ascending")]
    )
    q, t = every["queryId"].to_numpy(), every["tier"].to_numpy()
    if not len(q):
        return every
    first = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (t[1:] != t[:-1])])
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return every.filter(pa.array(place < k))


def _query_frame(queries: DataFrame) -> DataFrame:
    have = set(queries.columns)

    def time(name):
        return (F.unix_micros(name) if name in have else F.lit(None).cast("bigint")).alias(name)

    return queries.select(
        F.col("queryId").cast("bigint"),
        F.col("embedding").cast("array<double>"),
        (F.col("service") if "service" in have else F.lit(None)).cast("string").alias("service"),
        time("startTime"),
        time("endTime"),
    )


def top_k(
    queries: DataFrame, vectors: DataFrame, k: int, relax_service: bool = False, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """Exact cosine top-k per query: ``queryId, eventId, score, rank``.

    ``queries``: queryId, embedding and optional service, startTime, endTime, which
    filter before ranking. ``vectors``: eventId, embedding, service, timestamp.
    With ``relax_service`` a query whose service filter leaves nothing is answered
    without it (its time range stays).

    Up to ``block_queries`` queries travel to the tasks: the vectors are read once, unshuffled, and each task returns
    k rows per query. More queries meet the vectors in tiles, a block of queries and a block of vectors in a group of
    their own, so neither the driver nor the plan grows with them. A query's answer does not depend on the way.
    The queries are counted when the plan is built; streams ask through ``foreachBatch``.
    """
    tiers = 2 if relax_service else 1
    slim = vectors.select("eventId", "embedding", "service", "timestamp")
    asked = _query_frame(queries)
    n = asked.count()
    if n <= block_queries:
        return _final(slim.mapInArrow(_scan(_shared(vectors, asked.collect()), tiers, k), HITS), k)

    def answer(block: pa.Table, rows: pa.Table) -> pa.Table:
        parts = [rows.slice(start, SCORED_ROWS).combine_chunks() for start in range(0, rows.num_rows, SCORED_ROWS)]
        found = [HITS_ARROW.empty_table()]
        for first in range(0, block.num_rows, BLOCK_QUERIES):
            probe, kept = _Probe(block.slice(first, BLOCK_QUERIES).combine_chunks(), tiers), HITS_ARROW.empty_table()
            for part in parts:
                kept = _keep_best([kept, probe.top(part, k, _least(kept, probe.ids, k))], k)
            found.append(kept)
        return pa.concat_tables(found)

    return _final(_tiles(asked, slim, n, max(block_queries, min(TILE_QUERIES, -(-n // 16)))).applyInArrow(answer, HITS), k)


def _least(kept: pa.Table, ids: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th score that each query has so far; without one, or where an id asks more than once, below all."""
    least = np.full(len(ids), -np.inf)
    names, at, times = np.unique(ids, return_index=True, return_counts=True)
    q = kept["queryId"].to_numpy()
    if len(q):
        place = np.arange(len(q)) - np.searchsorted(q, q)
        full = np.searchsorted(names, q[place == k - 1])
        least[at[full]] = np.where(times[full] == 1, kept["score"].to_numpy()[place == k - 1], -np.inf)
    return least


def _tiles(asked: DataFrame, rows: DataFrame, queries: int, block_queries: int):
    """Blocks of queries, by a hash of their id, cogrouped with blocks of about ``BLOCK_ROWS`` rows, by one of the event id."""
    own, other = -(-queries // block_queries), max(1, -(-rows.count() // BLOCK_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    left = asked.withColumn("_q", block("queryId", own)).withColumn("_v", every(other))
    right = rows.withColumn("_v", block("eventId", other)).withColumn("_q", every(own))
    return left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v"))


def _shared(vectors: DataFrame, block: list):
    local = pa.Table.from_pylist([r.asDict() for r in block], QUERIES_ARROW)
    return vectors.sparkSession.sparkContext.broadcast(local)


def _scan(shared, tiers: int, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not shared.value.num_rows:
            return
        probe = _Probe(shared.value, tiers)
        kept = HITS_ARROW.empty_table()
        for batch in batches:
            for start in range(0, batch.num_rows, SCORED_ROWS):
                kept = _keep_best([kept, probe.top(batch.slice(start, SCORED_ROWS), k)], k)
        yield from kept.to_batches()

    return scan


def _final(partial: DataFrame, k: int) -> DataFrame:
    best = first_n_per_group(partial, ["queryId", "tier"], [F.desc("score"), F.col("eventId")], k)
    chosen = best.withColumn("_tier", F.min("tier").over(Window.partitionBy("queryId")))
    return chosen.filter("tier = _tier").select("queryId", "eventId", "score", F.col("rank").cast("bigint").alias("rank"))


# --- approximate candidates -------------------------------------------------------


def hyperplanes(dim: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, bits))


def signatures(vectors: DataFrame, dim: int, bits: int = 256, seed: int = 7) -> DataFrame:
    """``vectors`` with ``signature``: one sign bit per random hyperplane.

    Stored beside the vectors it lets a search read ``bits / 8`` bytes a row
    instead of the embedding.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = hyperplanes(dim, bits, seed)
        width = -(-bits // 8)
        for batch in batches:
            lengths, offsets, flat = _vectors(batch["embedding"])
            rows = np.flatnonzero(lengths == dim)
            signs = np.full(batch.num_rows, None, dtype=object)
            if len(rows):
                packed = np.packbits(_unit_rows(offsets[rows], dim, flat) @ planes > 0, axis=1).tobytes()
                signs[rows] = [packed[i : i + width] for i in range(0, len(packed), width)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(signs, pa.binary())], names=[*batch.schema.names, "signature"]
            )

    source = vectors.drop("signature")
    return source.mapInArrow(sign, T.StructType([*source.schema.fields, T.StructField("signature", T.BinaryType())]))


def ann_top_k(
    queries: DataFrame,
    signed: DataFrame,
    k: int,
    dim: int,
    bits: int = 256,
    seed: int = 7,
    factor: int = 10,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """Approximate top-k: candidates by signature distance, then exact scores.

    A fixed number of candidates finds ever less as the table grows, so ``factor * k`` of them only tell how near a
    query's k-th nearest is at least. Whatever is as near differs in a binomial number of bits; all rows
    within ``SURE`` deviations of its mean are the candidates that count, and each of the true k is among them
    with probability 0.998 and more, however many rows or copies there are.

    Both passes read ids and signatures only; embeddings are fetched for the
    candidates. Queries beyond ``block_queries`` go in tiles as in :func:`top_k`. Vectors and queries that
    are null or of another length than ``dim`` take no part.
    """
    wanted = factor * k
    planes = hyperplanes(dim, bits, seed)
    asked = queries.filter(F.size("embedding") == dim).select("queryId", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = signed.filter(F.col("signature").isNotNull()).select("eventId", "signature")
    schema = "queryId bigint, eventId bigint, far bigint"

    def packed(embeddings: list) -> np.ndarray:
        return np.packbits(np.array(embeddings, dtype="float64").reshape(-1, dim) @ planes > 0, axis=1)

    n = asked.count()

    def compared(asked: DataFrame, find: Callable[..., Iterator[pa.RecordBatch]]) -> DataFrame:
        """What ``find`` of (ids, signatures, limits, batches) gives for all queries (queryId, embedding, limit) and rows."""
        if n <= block_queries:
            block = asked.collect()
            ids, limits = (np.array([r[name] for r in block], dtype="int64") for name in ("queryId", "limit"))
            shared = signed.sparkSession.sparkContext.broadcast((ids, packed([r["embedding"] for r in block]), limits))
            return rows.mapInArrow(lambda batches: find(*shared.value, batches), schema)

        def answer(block: pa.Table, part: pa.Table) -> pa.Table:
            ids, limits = (block[name].to_numpy().astype("int64") for name in ("queryId", "limit"))
            found = list(find(ids, packed(block["embedding"].to_pylist()), limits, part.to_batches()))
            return pa.Table.from_batches(found) if found else _NEAR.empty_table()

        return _tiles(asked, rows, n, block_queries).applyInArrow(answer, schema)

    def best(candidates: DataFrame) -> DataFrame:
        scored = (
            candidates.select("queryId", "eventId")
            .join(signed.select("eventId", "embedding"), "eventId")
            .join(asked.select("queryId", F.col("embedding").alias("_q")), "queryId")
            .select("queryId", "eventId", F.round(vx.cosine(F.col("_q"), F.col("embedding")), SCORE_DIGITS).alias("score"))
        )
        return first_n_per_group(scored, ["queryId"], [F.desc("score"), F.col("eventId")], k)

    every = asked.withColumn("limit", F.lit(bits).cast("bigint"))
    near = compared(every, lambda ids, signs, _, batches: _nearest(ids, signs, batches, wanted))
    first = best(first_n_per_group(near, ["queryId"], [F.col("far"), F.col("eventId")], wanted))
    reached = first.groupBy("queryId").agg(F.count("*").alias("_n"), F.min("score").alias("_least"))
    share = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_least")))) / F.lit(np.pi)
    within = F.ceil(bits * share + SURE * F.sqrt(bits * share * (1 - share)))
    # fewer than k rows to choose from: nothing is left out
    reached = reached.select("queryId", F.when(F.col("_n") < k, F.lit(bits)).otherwise(within).cast("bigint").alias("limit"))
    return best(compared(materialize(asked.join(reached, "queryId"), "ann-limits"), _within)).withColumn("rank", F.col("rank").cast("bigint"))


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(event ids, signatures as bytes) of slices of the batches."""
    for whole in batches:
        for start in range(0, whole.num_rows, SCORED_ROWS):
            batch = whole.slice(start, SCORED_ROWS)
            bits = pa.concat_arrays([batch["signature"]])
            first, last = bits.offset, bits.offset + len(bits)
            ends = np.frombuffer(bits.buffers()[1], dtype="int32")[first : last + 1]
            rows = np.frombuffer(bits.buffers()[2], dtype="uint8")[ends[0] : ends[-1]].reshape(len(bits), -1)
            yield batch["eventId"].to_numpy(zero_copy_only=False), rows


def _within(qids: np.ndarray, qsigs: np.ndarray, limits: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every signature of the batches within the limit of a query, distances of 32 queries at once."""
    for event, rows in _signature_rows(batches):
        for q in range(0, len(qids), 32):
            far = np.bitwise_count(qsigs[q : q + 32, None] ^ rows).sum(axis=2, dtype="int64")
            who, at = np.nonzero(far <= limits[q : q + 32, None])
            yield pa.RecordBatch.from_arrays([pa.array(qids[q + who]), pa.array(event[at]), pa.array(far[who, at])], schema=_NEAR)


def _nearest(qids: np.ndarray, qsigs: np.ndarray, batches: Iterator[pa.RecordBatch], wanted: int) -> Iterator[pa.RecordBatch]:
    """The ``wanted`` signatures of the batches nearest to each query, distances of 32 queries at once."""
    best = [(np.zeros(0, "int64"), np.zeros(0, "int64")) for _ in qids]
    for event, rows in _signature_rows(batches):
        for q in range(0, len(qids), 32):
            far = np.bitwise_count(qsigs[q : q + 32, None] ^ rows).sum(axis=2, dtype="int64")
            for i, d in enumerate(far, q):
                d, ids = np.concatenate([best[i][0], d]), np.concatenate([best[i][1], event])
                keep = _best(d, ids, wanted)
                best[i] = (d[keep], ids[keep])
    for qid, (far, found) in zip(qids, best):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), qid)), pa.array(found), pa.array(far)], schema=_NEAR)


# --- rerank and grounding -----------------------------------------------------------

Scorer = Callable[[Column, Column], Column]


def token_overlap(query: Column, document: Column) -> Column:
    """Share of the query's distinct words found in the document; 0 for an empty query."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(document))) / F.size(q)).otherwise(0.0)


def rerank(hits: DataFrame, query_text: str, document: str, n: int = 5, scorer: Scorer = token_overlap) -> DataFrame:
    """Reorder hits by relevance, ties by their first rank, keep ``n`` per query.

    ``scorer`` maps (query text, document) columns to a score; a pandas UDF fits.
    """
    scored = hits.withColumn("relevance", scorer(F.col(query_text), F.col(document))).withColumnRenamed("rank", "firstRank")
    ranked = first_n_per_group(scored, ["queryId"], [F.desc("relevance"), F.col("firstRank")], n)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


def ground(hits: DataFrame, events: DataFrame) -> DataFrame:
    """Full events of the hits, rank order kept.

    Hits are at most n rows per query: adaptive execution broadcasts them when they
    turn out small, else both sides shuffle on the unique event id.
    """
    return hits.select("queryId", "eventId", "rank").join(events, "eventId")


def sources(grounded: DataFrame) -> DataFrame:
    """Cited request ids per query in rank order, nulls left out."""
    cited = F.filter(F.sort_array(F.collect_list(F.struct("rank", "requestId"))), lambda s: s["requestId"].isNotNull())
    return grounded.groupBy("queryId").agg(F.transform(cited, lambda s: s["requestId"]).alias("sources"))
