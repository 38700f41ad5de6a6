"""A stored index for approximate vector search: bands of sign bits, probed in several places.

Every vector has a key in each of ``BANDS`` bands: the signs of its products with random hyperplanes.
Vectors of one key lie together, so a query reads the keys it probes and nothing else: in every band its
own key, then those that differ from it in the signs it is least sure of. Keys get longer as the table
grows, so that a key keeps about ``KEY_ROWS`` vectors, and what a query reads grows more slowly than the
table. How many keys are probed, and how many of what they hold is scored, is measured while the index is built:
as many as a bounded sample of vectors needs to find the wanted share of its own exact neighbours.

The index is a Parquet table by slots of keys, so that a few queries read few slots. A key of more than
``HOT_ROWS`` vectors (copies, or a dense place) is split over parts and probed in each.

A query of a large table reads thousands of entries, so the entries that many queries read are never rows of a table:
beyond ``FEW_QUERIES`` a block of queries meets a block of events in a group of its own, with the keys and
signatures of the events, which the index also holds by event. There the keys are probed, and
candidates picked and scored; only the best of each block are handed on.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog.functions import vectors as vx
from lumenlog.operators.retrieval import BLOCK_ROWS, SCORE_DIGITS, TILE_QUERIES, _best, _one, _unit_rows, _vectors, top_k
from lumenlog.plans.ranks import first_n_per_group
from lumenlog.session import materialize

BANDS = 16
KEY_ROWS = 4
KEY_BITS = (3, 40)
SIGN_WORDS = 4  # 64-bit words of the signature that ranks candidates
HOT_ROWS = 50_000
SLOTS = 16  # of a band
MAX_PROBES = 2048  # keys of a band
SAMPLED = 64  # vectors whose neighbours the probes are measured on
MEASURED = 10  # of them, nearest
FEW_QUERIES = 256  # whose probed entries may be rows of a table
TILES = 16  # of many queries and events, at least
TABLE_BITS = 20  # of a key, up to which a tile finds keys by a table of all
ASKED = 32  # queries of a tile whose probes are chosen at once
_SIGNS = ", ".join(f"s{i} long" for i in range(SIGN_WORDS))
ENTRY = f"slot int, band int, key long, eventId long, {_SIGNS}"
EVENT = f"eventId long, keys array<long>, {_SIGNS}"
PROBE = "queryId long, slot int, band int, key long, " + ", ".join(f"q{i} long" for i in range(SIGN_WORDS))
SCORED = "queryId long, eventId long, score double"


@dataclass(frozen=True)
class IndexPlan:
    """What a stored index was built with; ``recall`` is that of the sample."""

    path: str
    dim: int
    bits: int
    probes: int
    recall: float
    rows: int
    seed: int
    candidates: int = 0  # by signature, of a query, that hold what the sample's probes found of its ten nearest

    def planes(self) -> np.ndarray:
        """Hyperplanes of the bands, then those of the signature."""
        return np.random.default_rng(self.seed).standard_normal((self.dim, BANDS * self.bits + 64 * SIGN_WORDS))


def key_bits(rows: int) -> int:
    return min(KEY_BITS[1], max(KEY_BITS[0], round(math.log2(max(1, rows) / KEY_ROWS))))


def _keys(products: np.ndarray, bits: int) -> np.ndarray:
    signs = (products[:, : BANDS * bits] > 0).reshape(len(products), BANDS, bits)
    return signs @ (1 << np.arange(bits, dtype="int64"))


def _signature(products: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits(products[:, BANDS * bits :] > 0, axis=1).view("int64")


def _slot(band: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    return (band * SLOTS + (key >> max(0, bits - int(math.log2(SLOTS))))).astype("int32")


def flips(margins: np.ndarray, n: int) -> list[int]:
    """The ``n`` sets of bits, as masks, whose flipping costs least; a bit costs its squared margin. The empty set is first."""
    order = np.argsort(margins, kind="stable")
    cost = (margins[order] ** 2).tolist()
    bit = [1 << int(i) for i in order]
    out, heap = [0], [(cost[0], 0, bit[0])] if cost else []
    while heap and len(out) < n:
        total, last, mask = heapq.heappop(heap)
        out.append(mask)
        if last + 1 < len(cost):
            heapq.heappush(heap, (total + cost[last + 1], last + 1, mask | bit[last + 1]))
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], last + 1, mask ^ bit[last] | bit[last + 1]))
    return out


@lru_cache(maxsize=8)
def _places(bits: int, n: int) -> np.ndarray:
    """The sets of places, one per row, that can be among the ``n`` cheapest where places ascend by cost.

    A set costs no less than every set whose places, from the last on, are no greater; one with ``n`` such before it is out.
    """

    def below(places: list[int]) -> int:
        # sets of which the i-th greatest place is at most the i-th greatest of these, itself included
        ways, total = [1] * (places[-1] + 1), 1  # ways[p]: sets of so many places whose last is p
        for i, most in enumerate(reversed(places)):
            if i:
                after = [0] * (most + 1)
                run = 0
                for p in range(len(ways) - 1, -1, -1):
                    if p <= most:
                        after[p] = run
                    run += ways[p]
                ways = after
            total += sum(ways)
        return total

    found, todo = [[]], [[0]] if bits else []
    while todo:
        places = todo.pop()
        if below(places) <= n:
            found.append(places)
            if places[-1] + 1 < bits:
                todo += [[*places, places[-1] + 1], [*places[:-1], places[-1] + 1]]
    out = np.zeros((len(found), bits))
    for i, places in enumerate(found):
        out[i, places] = 1
    return out


def cheapest(margins: np.ndarray, n: int) -> np.ndarray:
    """:func:`flips` of every row, in no order."""
    sets = _places(margins.shape[1], n)
    order = np.argsort(margins, axis=1, kind="stable")
    masks = np.ldexp(1.0, order) @ sets.T  # whole numbers below 2^40
    if len(sets) > n:
        cost = np.take_along_axis(margins, order, axis=1) ** 2 @ sets.T
        masks = np.take_along_axis(masks, np.argpartition(cost, n - 1, axis=1)[:, :n], axis=1)
    return masks.astype("int64")


def _measured(vectors: DataFrame, plan: IndexPlan, recall: float, k: int = MEASURED) -> tuple[int, float, int]:
    """(probes, recall, candidates) on the sample: as few keys of each band as find the share of the exact ``k`` nearest others.

    ``candidates`` is the place by signature, among all that these keys hold, up to which all but 1 % of what they find lies.
    """
    sample = materialize(vectors.orderBy(F.xxhash64("eventId"), "eventId").limit(SAMPLED).select("eventId", "embedding"), "index-sample")
    near = top_k(sample.select(F.col("eventId").alias("queryId"), "embedding"), vectors, k + 1)
    near = materialize(near.where("queryId <> eventId").select("queryId", "eventId"), "index-near")
    pairs = near.join(vectors.select("eventId", F.col("embedding").alias("v")), "eventId").join(
        sample.select(F.col("eventId").alias("queryId"), F.col("embedding").alias("q")), "queryId"
    )
    found = pairs.select("queryId", "q", "v").collect()  # at most k + 1 rows for each of the sample
    if not found:
        return 1, 1.0, 0
    planes, needed, probed = plan.planes(), [], {}
    for row in found:
        if row["queryId"] not in probed:
            product = np.array([row["q"]], dtype=float) @ planes
            own = _keys(product, plan.bits)[0]
            margins = np.abs(product[0, : BANDS * plan.bits]).reshape(BANDS, plan.bits)
            probed[row["queryId"]] = own, [{m: i for i, m in enumerate(flips(margins[b], MAX_PROBES))} for b in range(BANDS)]
        own, places = probed[row["queryId"]]
        other = _keys(np.array([row["v"]], dtype=float) @ planes, plan.bits)[0]
        needed.append(min(places[b].get(int(own[b] ^ other[b]), MAX_PROBES) for b in range(BANDS)))
    needed.sort()
    wanted = needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)] + 1
    probes = min(MAX_PROBES, wanted)
    asked = sample.select(F.col("eventId").alias("queryId"), "embedding")
    held = probed_entries(asked, replace(plan, probes=probes)).distinct()
    order = Window.partitionBy("queryId").orderBy("far", "eventId")
    places = held.withColumn("_no", F.row_number().over(order)).join(near, ["queryId", "eventId"]).agg(F.percentile("_no", 0.99)).first()[0]
    return probes, sum(n < probes for n in needed) / len(needed), math.ceil(places or 0)


def build_index(vectors: DataFrame, path: str, dim: int, recall: float = 0.95, seed: int = 7) -> IndexPlan:
    """Write the index of (eventId, embedding, service, timestamp) below ``path``; null and zero vectors, and those of another length, stay out."""
    spark = vectors.sparkSession
    used = vectors.where((F.size("embedding") == dim) & F.col("eventId").isNotNull() & F.exists("embedding", lambda x: x != 0))
    rows = used.count()
    plan = IndexPlan(path, dim, key_bits(rows), 1, 1.0, rows, seed)

    def placed_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = plan.planes()
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                lengths, offsets, flat = _vectors(batch["embedding"])
                if not len(lengths):
                    continue
                product = _unit_rows(offsets, dim, flat) @ planes
                keys, sign = pa.array(_keys(product, plan.bits).ravel()), _signature(product, plan.bits)
                keys = pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, BANDS, dtype="int32"), keys)
                columns = [batch["eventId"], keys, *(pa.array(np.ascontiguousarray(c)) for c in sign.T)]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in EVENT.split(", ")])

    source = used.select(F.col("eventId").cast("long").alias("eventId"), F.col("embedding").cast("array<double>").alias("embedding"))
    source.mapInArrow(placed_events, EVENT).write.mode("overwrite").parquet(f"{path}/events")
    events = spark.read.schema(EVENT).parquet(f"{path}/events")
    placed = events.select(F.posexplode("keys").alias("band", "key"), *[c for c in events.columns if c != "keys"])
    slot = F.col("band") * SLOTS + F.shiftright("key", max(0, plan.bits - int(math.log2(SLOTS)))).cast("int")
    placed = placed.withColumn("slot", slot).select(*[f.split()[0] for f in ENTRY.split(", ")])
    hot = placed.groupBy("band", "key").agg(F.ceil(F.count("*") / HOT_ROWS).cast("int").alias("parts")).where("parts > 1")
    hot.write.mode("overwrite").parquet(f"{path}/hot")
    parts = spark.read.schema("band int, key long, parts int").parquet(f"{path}/hot")
    split = placed.join(parts, ["band", "key"], "left")
    split = split.withColumn("part", F.pmod(F.xxhash64("eventId"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    split = split.repartitionByRange("slot", "key", "part").sortWithinPartitions("slot", "key", "part")
    split.write.mode("overwrite").partitionBy("slot").parquet(f"{path}/entries")
    probes, found, candidates = _measured(used, plan, recall)
    plan = IndexPlan(path, dim, plan.bits, probes, found, rows, seed, candidates)
    spark.createDataFrame([(json.dumps(asdict(plan)),)], "plan string").coalesce(1).write.mode("overwrite").text(f"{path}/plan")
    return plan


def read_plan(spark: SparkSession, path: str) -> IndexPlan:
    return IndexPlan(**json.loads(spark.read.text(f"{path}/plan").first()[0]))


def probed_entries(queries: DataFrame, plan: IndexPlan) -> DataFrame:
    """(queryId, eventId, far) of every index row that a query (queryId, embedding) reads; ``far`` compares signatures."""
    spark = queries.sparkSession

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = plan.planes()
        for batch in batches:
            lengths, offsets, flat = _vectors(batch["embedding"])
            ids = batch["queryId"].to_numpy()
            for i in range(batch.num_rows):
                product = _unit_rows(offsets[i : i + 1], plan.dim, flat) @ planes
                own, sign = _keys(product, plan.bits)[0], _signature(product, plan.bits)[0]
                margins = np.abs(product[0, : BANDS * plan.bits]).reshape(BANDS, plan.bits)
                masks = [np.array(flips(margins[b], plan.probes), dtype="int64") for b in range(BANDS)]
                band = np.repeat(np.arange(BANDS, dtype="int32"), [len(m) for m in masks])
                key = own[band] ^ np.concatenate(masks)
                columns = [np.full(len(key), ids[i]), _slot(band, key, plan.bits), band, key, *(np.full(len(key), w) for w in sign)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in PROBE.split(", ")])

    asked = queries.where((F.size("embedding") == plan.dim) & F.exists("embedding", lambda x: x != 0))
    asked = asked.select(F.col("queryId").cast("long").alias("queryId"), F.col("embedding").cast("array<double>").alias("embedding"))
    hot = spark.read.schema("band int, key long, parts int").parquet(f"{plan.path}/hot")
    keys = asked.mapInArrow(probes, PROBE).join(hot, ["band", "key"], "left")
    keys = keys.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    entries = spark.read.schema(f"{ENTRY}, part int").parquet(f"{plan.path}/entries")
    far = sum((F.bit_count(F.col(f"q{i}").bitwiseXOR(F.col(f"s{i}"))) for i in range(1, SIGN_WORDS)), F.bit_count(F.col("q0").bitwiseXOR(F.col("s0"))))
    return entries.join(keys, ["slot", "band", "key", "part"]).select("queryId", "eventId", far.alias("far"))


def indexed_top_k(queries: DataFrame, vectors: DataFrame, plan: IndexPlan, k: int, factor: int = 20) -> DataFrame:
    """Approximate cosine top-k: queryId, eventId, score (exact), rank.

    ``factor * k`` candidates of a query, nearest by signature, or as many as the index was measured to need, are
    fetched from ``vectors`` and scored. Queries that are null, zero or of another length get no answer; their ids are expected to be unique.
    """
    wanted = max(factor * k, plan.candidates * -(-k // MEASURED))
    usable = queries.where((F.size("embedding") == plan.dim) & F.exists("embedding", lambda x: x != 0) & F.col("queryId").isNotNull())
    asked = usable.select(F.col("queryId").cast("long").alias("queryId"), F.col("embedding").cast("array<double>").alias("_q"))
    n = asked.count()
    if n > FEW_QUERIES:
        scored = _scored_in_tiles(asked, n, vectors, plan, k, wanted)
    else:
        # an event comes from at most BANDS bands, so so many rows hold the wanted number of events
        near = first_n_per_group(probed_entries(queries, plan), ["queryId"], [F.col("far"), F.col("eventId")], wanted * BANDS, "_no")
        near = first_n_per_group(near.select("queryId", "eventId", "far").distinct(), ["queryId"], [F.col("far"), F.col("eventId")], wanted, "_no")
        scored = (
            near.select("queryId", "eventId")
            .join(vectors.select("eventId", F.col("embedding").cast("array<double>").alias("_v")), "eventId")
            .join(asked, "queryId")
            .select("queryId", "eventId", F.round(vx.cosine(F.col("_q"), F.col("_v")), SCORE_DIGITS).alias("score"))
        )
    best = first_n_per_group(scored, ["queryId"], [F.desc("score"), F.col("eventId")], k)
    return best.withColumn("rank", F.col("rank").cast("bigint"))


def _scored_in_tiles(asked: DataFrame, n: int, vectors: DataFrame, plan: IndexPlan, k: int, wanted: int) -> DataFrame:
    """(queryId, eventId, score): the ``k`` best of each of the ``n`` queries (queryId, _q) in every block of events, of the ``wanted`` nearest there."""
    rows = vectors.sparkSession.read.schema(EVENT).parquet(f"{plan.path}/events").withColumn("embedding", F.lit(None).cast(vectors.schema["embedding"].dataType))
    fetched = vectors.where(F.col("eventId").isNotNull()).select(F.col("eventId").cast("long").alias("eventId"), "embedding")
    rows = rows.unionByName(fetched.withColumn("_vector", F.lit(True)), allowMissingColumns=True)
    events = max(1, -(-plan.rows // BLOCK_ROWS))
    blocks = max(-(-n // TILE_QUERIES), -(-TILES // events))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    left = asked.withColumn("_a", block("queryId", blocks)).withColumn("_e", every(events))
    right = rows.withColumn("_e", block("eventId", events)).withColumn("_a", every(blocks))

    def answer(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))]
        if asked.num_rows and rows.num_rows:
            tile = _Tile(rows, plan)
            for start in range(0, asked.num_rows, ASKED):
                out += tile.best(asked.slice(start, ASKED), k, wanted)
        columns = [np.concatenate(c) for c in zip(*out)]
        score = pa.array(columns[2], mask=np.isnan(columns[2]))  # a vector with a null has no score
        return pa.table([pa.array(columns[0]), pa.array(columns[1]), score], [f.split()[0] for f in SCORED.split(", ")])

    partitions = 2 * blocks * events
    left, right = (side.repartition(partitions, "_a", "_e").groupBy("_a", "_e") for side in (left, right))
    return left.cogroup(right).applyInArrow(answer, SCORED)


class _Tile:
    """The index rows of a block of events, by band and key, and their vectors."""

    def __init__(self, rows: pa.Table, plan: IndexPlan):
        self.plan, self.planes = plan, plan.planes()
        is_vector = rows["_vector"].fill_null(False)
        vectors, index = rows.filter(is_vector), rows.filter(pc.invert(is_vector))
        vectors, index = (t.take(pa.array(np.argsort(t["eventId"].to_numpy(), kind="stable"))) for t in (vectors, index))
        self.ids = vectors["eventId"].to_numpy()
        lengths, offsets, flat = _vectors(_one(vectors["embedding"]))
        self.unit = np.zeros((len(self.ids), plan.dim))
        fits = np.flatnonzero(lengths == plan.dim)
        self.unit[fits] = _unit_rows(offsets[fits], plan.dim, flat)

        events = index["eventId"].to_numpy()
        keys = _one(index["keys"]).flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
        signs = np.ascontiguousarray(np.column_stack([index[f"s{i}"].to_numpy() for i in range(SIGN_WORDS)]))
        if (events[1:] == events[:-1]).any():
            whole = np.unique(np.column_stack([events, keys, signs]), axis=0)  # in the order of the events
            events, keys, signs = whole[:, 0], whole[:, 1 : BANDS + 1], np.ascontiguousarray(whole[:, BANDS + 1 :])
        self.signs, self.seen = signs.view("uint64"), np.zeros(len(events), bool)
        self.first, self.end = np.searchsorted(self.ids, events), np.searchsorted(self.ids, events, "right")
        order = np.argsort(keys, axis=0, kind="stable")
        self.order = order.T.ravel()  # index rows, band after band, by key
        self.keys = np.take_along_axis(keys, order, axis=0).T
        self.table = None
        if plan.bits <= TABLE_BITS:
            every = np.arange((1 << plan.bits) + 1)
            self.table = np.vstack([np.searchsorted(band, every) for band in self.keys]) + np.arange(BANDS)[:, None] * len(events)

    def _found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the keys (a row per band) begin and end in ``order``."""
        if self.table is not None:
            return np.take_along_axis(self.table, keys, axis=1).ravel(), np.take_along_axis(self.table, keys + 1, axis=1).ravel()
        sides = [
            np.concatenate([np.searchsorted(band, k, side) + b * len(band) for b, (band, k) in enumerate(zip(self.keys, keys, strict=True))])
            for side in ("left", "right")
        ]
        return sides[0], sides[1]

    def best(self, asked: pa.Table, k: int, wanted: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        plan, qids = self.plan, asked["queryId"].to_numpy()
        _, offsets, flat = _vectors(_one(asked["_q"]))
        unit = _unit_rows(offsets, plan.dim, flat)
        product = unit @ self.planes
        own, signs = _keys(product, plan.bits), _signature(product, plan.bits).view("uint64")
        masks = cheapest(np.abs(product[:, : BANDS * plan.bits]).reshape(-1, plan.bits), plan.probes).reshape(len(own), BANDS, -1)
        out = []
        for q, qid in enumerate(qids):
            start, end = self._found(own[q][:, None] ^ masks[q])
            size = end - start
            held = size.nonzero()[0]
            start, size = start[held], size[held]
            at = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
            self.seen[self.order[at]] = True
            rows = np.flatnonzero(self.seen)
            self.seen[rows] = False
            if len(rows) > wanted:
                far = np.bitwise_count(self.signs[rows] ^ signs[q]).sum(axis=1, dtype="int64")
                upto = np.cumsum(np.bincount(far))
                cut = int(np.searchsorted(upto, wanted))
                tied = np.flatnonzero(far == cut)[: wanted - (upto[cut - 1] if cut else 0)]  # rows ascend by event
                rows = rows[np.sort(np.r_[np.flatnonzero(far < cut), tied])]
            first, times = self.first[rows], self.end[rows] - self.first[rows]
            if (times != 1).any():
                first = np.unique(np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum()))
            score = np.round(self.unit[first] @ unit[q], SCORE_DIGITS)
            ids = self.ids[first]
            best = _best(np.where(np.isnan(score), np.inf, -score), ids, k)
            out.append((np.full(len(best), qid), ids[best], score[best]))
        return out
