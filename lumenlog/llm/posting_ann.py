"""Approximate nearest neighbours by balanced posting lists.

Centroids are learned on a bounded sample by balanced splitting: a cell is halved at the median of its
widest direction, then all centroids are moved by a few k-means steps. Every vector of the table is then
indexed: it joins the list of its nearest centroid, and, near a boundary, those of others within a
distance ratio. Lists are cut into parts of bounded size, all of
which are searched. A query finds its centroids by beam search in a neighbour graph held in memory and
searches the lists whose centroids are within a distance ratio of the nearest.

Largest inner product is nearest distance once every vector, divided by the largest norm, carries
``sqrt(1 - |x|^2)`` as one more component and every query, brought to length 1, carries 0. A query's length
changes no order, so it must not weigh in which lists are near either. Equal vectors are indexed once, with
their k + 1 smallest ids, so a vector held by a third of all rows is one entry.

How far a query must search differs from table to table. So the lists are asked once by a sample of the
queries, against every vector: ratio and number of lists are raised to what finds the wanted share of their
true neighbours, up to all lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.llm.common import stored

RESULT = "query_id long, vec_id long, score double"


class CentroidGraph:
    """Centroids with links to their nearest ones; beam search finds the nearest to each of many points at once."""

    def __init__(self, centroids: np.ndarray, degree: int = 24):
        self.centroids = centroids.astype(np.float64)
        self.square = (self.centroids**2).sum(1)
        n = len(centroids)
        degree = min(degree, n - 1)
        self.links = np.empty((n, degree), dtype=np.int32)
        for start in range(0, n, 1024):
            d = self.square - 2 * self.centroids[start : start + 1024] @ self.centroids.T
            d[np.arange(len(d)), np.arange(start, start + len(d))] = np.inf
            self.links[start : start + 1024] = np.argpartition(d, max(0, degree - 1), axis=1)[:, :degree] if degree else 0
        # entry points spread over all centroids
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 48)).astype(int))

    def nearest(self, points: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of about the ``k`` nearest centroids of each point, nearest first."""
        n, beam = len(self.centroids), max(beam, k)
        base = (points**2).sum(1)[:, None]
        if n <= beam:
            d = self.square - 2 * points @ self.centroids.T + base
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            return order, np.take_along_axis(d, order, 1)
        rows = np.arange(len(points))[:, None]
        seen = np.zeros((len(points), n), dtype=bool)
        dist = np.full((len(points), n), np.inf, dtype=np.float64)
        seen[:, self.entries] = False
        dist[:, self.entries] = self.square[self.entries] - 2 * points @ self.centroids[self.entries].T + base
        top = self.entries[np.argsort(dist[:, self.entries], axis=1)[:, :beam]]
        while True:
            open_ = np.where(np.take_along_axis(seen, top, 1), np.inf, np.take_along_axis(dist, top, 1))
            pick = np.take_along_axis(top, np.argsort(open_, axis=1)[:, :4], 1)
            fresh = ~np.take_along_axis(seen, pick, 1)
            if not fresh.any():
                break
            np.put_along_axis(seen, pick, True, 1)
            near = self.links[pick].reshape(len(points), -1)
            new = self.square[near] - 2 * np.einsum("pd,pkd->pk", points, self.centroids[near]) + base
            dist[rows, near] = new
            both = np.concatenate([top, near], axis=1)
            both.sort(axis=1)
            value = np.take_along_axis(dist, both, 1)
            value[:, 1:][both[:, 1:] == both[:, :-1]] = np.inf
            top = np.take_along_axis(both, np.argsort(value, axis=1, kind="stable")[:, : min(beam, n)], 1)
        top = top[:, :k]
        return top, np.take_along_axis(dist, top, 1)


def balanced_centroids(sample: np.ndarray, lists: int, steps: int = 4) -> np.ndarray:
    """``lists`` centroids of cells of equal size, then moved by k-means with the cells' sizes held within twice the mean."""
    cells = [np.arange(len(sample))]
    while len(cells) < min(lists, len(sample)):
        at = max(range(len(cells)), key=lambda i: len(cells[i]))
        own = cells.pop(at)
        part = sample[own] - sample[own].mean(0)
        _, _, axes = np.linalg.svd(part[: 4 * part.shape[1]], full_matrices=False)
        order = np.argsort(part @ axes[0], kind="stable")
        cells += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    centroids = np.stack([sample[c].mean(0) for c in cells])
    limit = 2 * max(1, len(sample) // len(centroids))
    for _ in range(steps):
        near = np.concatenate([((centroids**2).sum(1) - 2 * sample[i : i + 2048] @ centroids.T).argmin(1) for i in range(0, len(sample), 2048)])
        size = np.bincount(near, minlength=len(centroids))
        if size.max() > limit:  # an overfull cell keeps its centroid's place instead of drawing more in
            near[np.isin(near, np.flatnonzero(size > limit))] = -1
        for c in np.unique(near[near >= 0]):
            centroids[c] = sample[near == c].mean(0)
    return centroids


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, whatever their scale."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows with an id and a vector of finite numbers that isn't zero."""
    v = F.col(vec_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))


def nearest_neighbours(
    vectors: DataFrame,
    k: int = 20,
    query_every: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    list_size: int = 128,
    sample_rows: int = 20_000,
    max_lists: int = 4096,
    probe_share: float = 0.32,
    search_ratio: float = 1.6,
    replicas: int = 3,
    replica_ratio: float = 1.1,
    part_rows: int = 16_384,
    asked_rows: int = 65_536,
    recall: float = 0.97,
    sample_queries: int = 256,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` largest inner products of every row whose id ``query_every`` divides.

    Null, zero and non-finite vectors, and rows without an id, take no part; vectors of another length than the
    commonest meet only their own length's (other lengths have no product): they are searched exhaustively among
    themselves. Fewer candidates than ``k`` give fewer rows. Ties go to the smaller id. A repeated id counts once,
    with its best vector; each of its vectors asks.
    Bounds: centroids are learned on about ``sample_rows`` distinct vectors and number at most ``max_lists``;
    they are all that is sent to every task. A group of lists holds about ``part_rows`` vectors and meets about
    ``asked_rows`` queries; further queries meet a copy of it in a group of their own.
    Lists within ``search_ratio`` are searched, the share ``probe_share`` of all at most; either is raised where
    ``sample_queries`` of the queries, by a hash, need more to find the share ``recall`` of their true neighbours.
    """
    spark = vectors.sparkSession
    ids = F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1)
    # k + 1 smallest ids of equal vectors: ranked before the shuffle, so a hot vector is not gathered
    ranked = _usable(vectors, id_col, vec_col).dropDuplicates(["vec_id", "v"])
    order = Window.partitionBy("v").orderBy("vec_id")
    members = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    index = stored(members.groupBy("v").agg(ids.alias("ids")).withColumn("width", F.size("v")), "ann-vectors")
    peak = F.array_max(F.transform("v", F.abs))
    norm = peak * F.sqrt(F.aggregate(F.transform("v", lambda x: x / peak), F.lit(0.0), lambda a, x: a + x * x))
    widths = index.groupBy("width").agg(F.count("*").alias("n"), F.max(norm).alias("norm")).collect()
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = ranked.where(F.col("vec_id") % query_every == 0).select(F.col("vec_id").alias("query_id"), "v")
    # counted over the ids alone, so at least as many as ask
    blocks = max(1, -(-vectors.where(F.col(id_col).cast("long") % query_every == 0).count() // asked_rows))
    found = None
    for w in widths:  # one kind of vector has one length; others are rare
        own = _search(
            index.where(F.col("width") == w["width"]), queries.where(F.size("v") == w["width"]), w["width"], w["n"], float(w["norm"]), k,
            list_size, sample_rows, max_lists, probe_share, search_ratio, replicas, replica_ratio, part_rows, blocks, recall, sample_queries,
        )
        found = own if found is None else found.unionAll(own)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # a replicated vector comes from several lists with the same score; of a repeated id the best vector counts
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _searched(asked: list, postings: DataFrame, graph: CentroidGraph, sizes: np.ndarray, width: int, k: int, replicas: int, recall: float) -> tuple[int, float]:
    """(lists, ratio) within which the queries ``asked`` find the share ``recall`` of their true neighbours.

    Every task keeps the best rows of the vectors it reads; the best of all are a few for each of the queries.
    """
    if not asked:
        return 1, 0.0
    lengths = _unit(np.array([r["v"] for r in asked], dtype=np.float64).reshape(-1, width))
    shared = postings.sparkSession.sparkContext.broadcast(lengths)
    kept = replicas * (k + 1)  # the query's own vector and k others, each in as many lists as it may have

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        score, lists, ids = np.zeros((len(q), 0)), np.zeros((len(q), 0), dtype=np.int32), np.zeros((len(q), 0), dtype=object)
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                s = q @ _matrix(batch.column("v"), width).T
                top = np.argpartition(-s, min(kept, s.shape[1]) - 1, axis=1)[:, :kept]
                named = np.empty(batch.num_rows, dtype=object)
                used = np.unique(top)
                for i, one in zip(used, batch.column("ids").take(pa.array(used)).to_pylist(), strict=True):
                    named[i] = one
                score = np.concatenate([score, np.take_along_axis(s, top, 1)], axis=1)
                lists = np.concatenate([lists, batch.column("list").to_numpy()[top]], axis=1)
                ids = np.concatenate([ids, named[top]], axis=1)
                order = np.argsort(-score, axis=1, kind="stable")[:, :kept]
                score, lists, ids = (np.take_along_axis(a, order, 1) for a in (score, lists, ids))
        if score.size:
            who = np.repeat(np.arange(len(q), dtype=np.int32), score.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(who), pa.array(lists.ravel()), pa.array(score.ravel()), pa.array(ids.ravel().tolist(), pa.list_(pa.int64()))], names=["who", "list", "score", "ids"]
            )

    found = postings.mapInArrow(best, "who int, list int, score double, ids array<long>")
    found = found.withColumn("no", F.row_number().over(Window.partitionBy("who").orderBy(F.desc("score"), "ids"))).where(F.col("no") <= kept)
    near, d = graph.nearest(np.c_[lengths, np.zeros(len(lengths))], len(graph.centroids), len(graph.centroids))
    place, free = np.argsort(near, axis=1), np.cumsum(sizes[near], axis=1) - sizes[near] < 32 * k
    ratio = np.where(free, 0.0, np.sqrt(np.maximum(0.0, d) / np.maximum(d[:, :1], 1e-12)))
    needed: list[tuple[int, float]] = []
    left, vectors = dict.fromkeys(range(len(asked)), k), {}
    for r in found.orderBy("who", "no").collect():
        vectors.setdefault((r["who"], tuple(r["ids"])), []).append(place[r["who"], r["list"]])
    for (who, ids), places in vectors.items():  # best first; a vector counts as often as it has ids in the answer
        times = min(left[who], sum(i != asked[who]["query_id"] for i in ids))
        left[who] -= times
        needed += [(min(places) + 1, ratio[who, min(places)])] * times
    if not needed:
        return 1, 0.0
    at = min(len(needed) - 1, int(np.ceil((1 + recall) / 2 * len(needed))) - 1)  # either loses half of what may be lost
    lists, ratios = (np.sort(np.array(c)) for c in zip(*needed, strict=True))
    return int(lists[at]), float(ratios[at])


def _search(index, queries, width, total, norm, k, list_size, sample_rows, max_lists, probe_share, search_ratio, replicas, replica_ratio, part_rows, blocks, recall, sample_queries) -> DataFrame:
    spark = index.sparkSession
    share = min(1.0, sample_rows / max(1, total))
    picked = index.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < F.lit(max(1, int(share * (1 << 20)))))
    # the extra component makes largest product and nearest distance the same; only its bound comes from all rows
    sample = np.array([r["v"] for r in picked.select("v").limit(4 * sample_rows).collect()], dtype=np.float64).reshape(-1, width)
    if not len(sample):
        sample = np.array([r["v"] for r in index.select("v").limit(1).collect()], dtype=np.float64)
    lift = lambda x: np.c_[x / norm, np.sqrt(np.maximum(0.0, 1 - ((x / norm) ** 2).sum(1)))]
    lists = int(min(max_lists, max(1, total // list_size)))
    graph = CentroidGraph(balanced_centroids(lift(sample), lists))
    shared = spark.sparkContext.broadcast(graph)
    n_lists = len(graph.centroids)
    # lists are searched in groups of about part_rows vectors, each of which gives k rows a query; a list of more is cut
    groups = int(max(16, -(-total * replicas // part_rows)))
    parts = int(max(1, -(-total * replicas // (n_lists * part_rows))))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                x = lift(_matrix(batch.column("v"), width))
                near, d = g.nearest(x, replicas, 64)
                keep = np.zeros(near.shape, dtype=bool)
                keep[:, 0] = True
                limit = replica_ratio**2 * np.maximum(d[:, 0], 1e-12)
                keep[:, 1:replicas] = d[:, 1:replicas] <= limit[:, None]
                row, col = np.nonzero(keep)
                taken = batch.take(pa.array(row))
                part = (pd.util.hash_array(np.array([i[0] for i in batch.column("ids").to_pylist()], dtype=np.int64)) % parts).astype(np.int32)[row]
                place = near[row, col].astype(np.int64)
                group = ((place * parts + part) % groups).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(place.astype(np.int32)), taken.column("v"), taken.column("ids")], names=["grp", "list", "v", "ids"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                x = np.c_[_unit(_matrix(batch.column("v"), width)), np.zeros(batch.num_rows)]
                near, d = g.nearest(x, probes, 2 * probes)
                # a query on a centroid makes every ratio large: the first lists that hold enough are searched anyhow
                held = np.cumsum(sizes.value[near], axis=1) - sizes.value[near]
                row, col = np.nonzero((d <= ratio**2 * np.maximum(d[:, :1], 1e-12)) | (held < 32 * k))
                place = near[row, col].astype(np.int64)
                # every part of a list is searched; a query goes to a group once, with the lists it asks there
                group = ((np.repeat(place, parts) * parts + np.tile(np.arange(parts), len(place))) % groups).astype(np.int64)
                key, own = np.repeat(row, parts) * groups + group, np.repeat(place, parts)
                order = np.lexsort((own, key))
                key, own = key[order], own[order]
                fresh = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])]
                key, own = key[fresh], own[fresh]
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                lists_of = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(key)].astype(np.int32)), pa.array(own.astype(np.int32)))
                asking = batch.take(pa.array(key[starts] // groups))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((key[starts] % groups).astype(np.int32)), lists_of, asking.column("query_id"), asking.column("v")], names=["grp", "lists", "query_id", "v"]
                )

    postings = stored(index.select("v", "ids").mapInArrow(post, "grp int, list int, v array<double>, ids array<long>"), "ann-postings")
    counted = np.zeros(len(graph.centroids), dtype=np.int64)
    for r in postings.groupBy("list").count().collect():  # max_lists rows at most
        counted[r["list"]] = r["count"]
    sizes = spark.sparkContext.broadcast(counted)
    asking = queries.orderBy(F.xxhash64("query_id", "v")).limit(sample_queries).collect()
    needed, ratio = _searched(asking, postings, graph, counted, width, k, replicas, recall)
    probes, ratio = min(n_lists, max(128, int(np.ceil(probe_share * n_lists)), needed)), max(search_ratio, ratio * (1 + 1e-9))
    asked = queries.mapInArrow(route, "grp int, lists array<int>, query_id long, v array<double>")
    # both sides of a group are bounded: queries part by a hash into blocks, each of which meets a copy of the lists
    # of one type on both sides: cogroup does not cast, and equal numbers of different types hash to different partitions
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "v"), F.lit(blocks)).cast("int"))
    copies = postings.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        held = held.sort_values("list", kind="stable")
        x, listed, ids = np.stack(held["v"].to_numpy()), held["list"].to_numpy(), held["ids"].to_numpy()
        out = []
        for first in range(0, len(asked), 1024):
            block = asked.iloc[first : first + 1024]
            q, names = np.stack(block["v"].to_numpy()), block["query_id"].to_numpy()
            wanted = np.concatenate(block["lists"].to_numpy())
            asker = np.repeat(np.arange(len(block)), [len(w) for w in block["lists"]])
            found = []
            for one in np.unique(wanted):
                start, end = np.searchsorted(listed, [one, one + 1])
                rows = asker[wanted == one]
                if end > start:
                    s = q[rows] @ x[start:end].T
                    n = min(k + 1, s.shape[1])
                    bar = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
                    # all that could tie with the last one stay: the product is then computed in one fixed order
                    slack = 1e-12 * np.linalg.norm(q[rows], axis=1) * np.linalg.norm(x[start:end], axis=1).max()
                    row, col = np.nonzero(s >= (bar - slack)[:, None])
                    row, col = rows[row], col + start
                    found.append((row, col, (q[row] * x[col]).sum(1)))
            if found:
                row, col, exact = (np.concatenate(f) for f in zip(*found, strict=True))
                size = np.fromiter(map(len, ids[col]), dtype=np.int64, count=len(col))
                got = pd.DataFrame({"query_id": np.repeat(names[row], size), "vec_id": np.concatenate(ids[col]), "score": np.repeat(exact, size)})
                got = got[got["query_id"] != got["vec_id"]].drop_duplicates(["query_id", "vec_id", "score"])
                got = got.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                out.append(got.groupby("query_id").head(k))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return asked.groupBy("grp", "block").cogroup(copies.groupBy("grp", "block")).applyInPandas(search, RESULT)
