"""Near-duplicate documents by a chosen-path similarity join.

A document is the set of its five-word shingles; equal sets are one class, so exact copies never meet
in a join. Classes descend independent trees: a node's key picks one minwise token (now and then a
second one, 1 / threshold on average) and a class moves to the child that its value of that token names.
Pairs at the threshold then survive a level in expectation once, less similar ones die out. A node of
few classes is compared exhaustively, as is a larger one in pairs of blocks; still larger ones branch
again, as long as that makes the blocks fewer. Branching loses pairs, so classes of nodes that branched
get further trees, until a pair at the threshold is missed with probability ``MISS`` at most.

Two rounds keep what is shipped small. First, signatures of one byte a token descend the trees, and
pairs whose estimated similarity is within some four deviations of the threshold are joined to clusters.
Then each cluster's texts are sent out once and all links among them are counted exactly, on full
sets; a cluster too large for one task descends trees of its own. Nodes and clusters hand on links as
stars, one row per member, so a group of n near copies costs n rows, not n squared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import slices, stored
from lumenlog.plans.graph import components

WORDS = 5
TOKENS = 128  # minwise tokens of a signature
MISS = 3e-7  # of a pair at the threshold: the probability that all trees part it, at the depth they reach
NODE = 1024  # classes compared exhaustively
NODE_SHINGLES = 3_000_000
FEW = 16  # classes compared exhaustively whatever their shingles
WHOLE = 16  # blocks up to which a node is compared in pairs of blocks at once
MAX_DEPTH = 40
BLOCK = 512

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STREAM = _mixed(np.arange(1, 2 * TOKENS + 64, dtype=np.uint64) * _MIX)
_FACTORS, _OFFSETS, _PLACES = _STREAM[:TOKENS] | np.uint64(1), _STREAM[TOKENS : 2 * TOKENS], _STREAM[2 * TOKENS :] | np.uint64(1)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: A-Z lower-cased, words parted by ASCII white space."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(["" if t is None else t for t in texts], pa.large_string())))
    flat = words.flatten()
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
    full = pc.greater(pc.binary_length(flat), 0)
    doc = doc[full.to_numpy(zero_copy_only=False)]
    coded = flat.filter(full).dictionary_encode()
    if not len(coded):
        return [np.zeros(0, dtype=np.uint64)] * len(texts)
    names = _mixed(pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False))
    word = names[coded.indices.to_numpy(zero_copy_only=False)]
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    size = np.diff(bounds)
    with np.errstate(over="ignore"):
        n = max(0, len(word) - WORDS + 1)
        rolled = np.zeros(n, dtype=np.uint64)
        for j in range(WORDS):
            rolled += word[j : j + n] * _PLACES[j]
        rolled = _mixed(rolled)
        out = []
        for start, k in zip(bounds[:-1], size, strict=True):
            if k >= WORDS:
                out.append(np.unique(rolled[start : start + k - WORDS + 1]))
            elif k:  # the whole sequence is one shingle, unlike any of five words
                own = word[start : start + k]
                out.append(_mixed(np.array([(own * _PLACES[8 + np.arange(k)]).sum() + np.uint64(k)], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set, as 64-bit values."""
    best = np.full(TOKENS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(shingles), 512):
            part = shingles[start : start + 512, None] * _FACTORS
            part ^= _OFFSETS
            np.minimum(best, part.min(0), out=best)
        return _mixed(best)


def survival(threshold: float, depth: int) -> float:
    """The probability that some leaf ``depth`` levels below a node of both has a pair at the threshold."""
    alive = 1.0
    for _ in range(depth):
        hit = threshold * alive
        alive = hit + (1 / threshold - 1) * hit * (1 - hit)  # one token, or two by the coin
    return alive


def trees_for(threshold: float, depth: int = 0) -> int:
    """Trees of two tokens at once and ``depth`` levels that a pair at the threshold misses with probability ``MISS`` at most.

    Without further levels 12 at 0.85 and 15 at 0.8.
    """
    return ceil(log(MISS) / log1p(-(threshold**2) * survival(threshold, depth)))


def _roots(tokens: np.ndarray, trees: int) -> np.ndarray:
    """Keys of the nodes two levels down each tree: a passage that many documents share seldom gives both tokens."""
    with np.errstate(over="ignore"):
        tree = np.arange(trees, dtype=np.uint64) * _MIX
        return _mixed(_mixed(tokens[: 2 * trees : 2] + tree) + tokens[1 : 2 * trees : 2]).view(np.int64)


def signatures(docs: DataFrame, trees: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, cls (digest of the set), sig (a byte per token), roots (keys of the trees' first nodes).

    Without words cls, sig and roots are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            sets = shingle_sets(batch.column("text").to_pylist())
            tokens = [minwise(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("th"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if t is None else (t & np.uint64(255)).astype(np.uint8).tobytes() for t in tokens], pa.binary()),
                    pa.array([None if t is None else _roots(t, trees) for t in tokens], pa.list_(pa.int64())),
                ],
                names=["doc_id", "th", "n_shingles", "cls", "sig", "roots"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return source.mapInArrow(run, "doc_id long, th long, n_shingles long, cls binary, sig binary, roots array<long>")


def _sized(nodes: DataFrame) -> DataFrame:
    """Members of nodes with two classes and more, with the node's size.

    Sizes are summed before their shuffle and stored: the join then has plain shuffles on both sides, whose hot
    partitions Spark can split.
    """
    sizes = nodes.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("total")).where("members > 1")
    return nodes.join(stored(sizes, "node-sizes"), "key")


def _blocks(by_shingles: bool) -> Column:
    """Blocks of a node, each pair of which one task can compare; 1: the node as a whole."""
    members = F.col("members")
    if not by_shingles:
        return F.when(members <= NODE, 1).otherwise(F.ceil(members / BLOCK)).cast("int")
    whole = (members <= FEW) | ((members <= NODE) & (F.col("total") <= NODE_SHINGLES))
    # a pair of blocks holds about NODE_SHINGLES, or FEW classes
    heavy = F.least(F.ceil(F.col("total") * 2 / NODE_SHINGLES), F.ceil(members * 2 / FEW))
    return F.when(whole, 1).otherwise(F.greatest(F.ceil(members / BLOCK), heavy)).cast("int")


def _in_blocks(nodes: DataFrame) -> DataFrame:
    """Leaves (key, cls): nodes of one block as they are, of the others each pair of blocks."""
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    paired = (
        nodes.where("blocks > 1")
        .withColumn("own", own)
        .select("key", "cls", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "cls")
    )
    return nodes.where("blocks = 1").select("key", "cls").unionAll(paired)


def descend(nodes: DataFrame, classes: DataFrame, threshold: float, by_shingles: bool) -> tuple[DataFrame, int, DataFrame | None]:
    """Leaves (key, cls) of the trees whose present nodes are ``nodes`` (key, cls, n), the depth of the deepest, and
    the classes (cls) of the nodes that branched. Single classes drop out.

    A node of at most ``WHOLE`` blocks is compared in pairs of blocks. Larger ones branch while their children make
    fewer rows of blocks than they do: classes that no token tells apart would only multiply. ``by_shingles`` bounds
    the shingles of a leaf too; signatures are of one size.
    """

    def sized(level: DataFrame) -> DataFrame:
        return stored(_sized(level).withColumn("blocks", _blocks(by_shingles)), "nodes")

    def rows(level: DataFrame) -> int:
        return level.agg(F.sum("blocks")).first()[0] or 0

    open_ = sized(nodes)
    leaves = _in_blocks(open_.where(F.col("blocks") <= WHOLE))
    large, branched = open_.where(F.col("blocks") > WHOLE), None
    cost = rows(large)
    for depth in range(MAX_DEPTH):
        if not cost:
            return leaves, depth, branched
        coin = F.pmod(F.xxhash64("key", F.lit("coin")), F.lit(1 << 20)) < F.lit(int((1 / threshold - 1) * (1 << 20)))
        first = F.pmod(F.xxhash64("key", F.lit(depth)), F.lit(TOKENS)).cast("int")
        second = F.pmod(first + 1 + F.pmod(F.xxhash64("key", F.lit("second")), F.lit(TOKENS - 1)).cast("int"), F.lit(TOKENS))
        picked = F.array_compact(F.array(first, F.when(coin, second)))
        children = (
            large.select("key", "cls", "n", F.explode(picked).alias("token"))
            .join(classes.select("cls", "sig"), "cls")
            .select(F.xxhash64("key", "token", F.substring("sig", F.col("token") + 1, F.lit(1))).alias("key"), "cls", "n")
        )
        below = sized(children)
        if rows(below) >= cost:
            return leaves.unionAll(_in_blocks(large)), depth, branched
        if branched is None:
            branched = large.select("cls").distinct()
        leaves = leaves.unionAll(_in_blocks(below.where(F.col("blocks") <= WHOLE)))
        large = below.where(F.col("blocks") > WHOLE)
        cost = rows(large)
    return leaves.unionAll(_in_blocks(large)), MAX_DEPTH, branched


def _planted(members: DataFrame, classes: DataFrame, start: int, end: int) -> DataFrame:
    """First nodes (key, cls, n) of the trees from ``start`` to ``end`` within each group of ``members`` (key, cls, n), two tokens of the signature down."""
    first = F.pmod(F.xxhash64("tree", F.lit("first")), F.lit(TOKENS)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("tree", F.lit("second")), F.lit(TOKENS - 1)).cast("int"), F.lit(TOKENS))
    token = [F.substring("sig", at + 1, F.lit(1)) for at in (first, second)]
    trees = F.explode(F.sequence(F.lit(start), F.lit(end - 1))).alias("tree")
    started = members.join(classes.select("cls", "sig"), "cls").select("key", "cls", "n", "sig", trees)
    return started.select(F.xxhash64("key", "tree", *token).alias("key"), "cls", "n")


def covering_leaves(roots: DataFrame, members: DataFrame, classes: DataFrame, threshold: float, by_shingles: bool) -> DataFrame:
    """Leaves of the trees with the first nodes ``roots``, and of as many further ones as the depth reached asks for.

    Classes whose nodes all were leaves need none: only those of nodes that branched are planted again, within their
    group of ``members``.
    """
    drawn = trees_for(threshold)
    leaves, depth, branched = descend(roots, classes, threshold, by_shingles)
    while branched is not None and (needed := trees_for(threshold, depth)) > drawn:
        again = members.join(branched, "cls", "left_semi")
        more, deeper, _ = descend(_planted(again, classes, drawn, needed), classes, threshold, by_shingles)
        leaves, depth, drawn = leaves.unionAll(more), max(depth, deeper), needed
    return leaves


class _Sets:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def star(self) -> list[tuple[int, int]]:
        return [(r, i) for i in range(len(self.parent)) if (r := self.find(i)) != i]


EDGES = "a binary, b binary"


def _edge_batch(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(r) for r in rows], pa.binary()), pa.array([max(r) for r in rows], pa.binary())], names=["a", "b"])


def candidate_edges(leaves: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Stars (a, b) over the classes of each leaf that estimated similarity joins."""
    bar = threshold - 4.2 * (threshold * (1 - threshold) / TOKENS) ** 0.5
    least = int(np.floor(TOKENS * (bar + (1 - bar) / 256)))
    rows = leaves.join(classes.select("cls", "sig"), "cls").repartition("key").sortWithinPartitions("key", "cls")

    def group_edges(names: list[bytes], sig: np.ndarray) -> list[tuple[bytes, bytes]]:
        sets = _Sets(len(names))
        for i in range(len(names) - 1):
            for j in np.flatnonzero((sig[i + 1 :] == sig[i]).sum(1) >= least):
                sets.join(i, i + 1 + int(j))
        return [(names[a], names[b]) for a, b in sets.star()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None

        def work(table: pa.Table) -> pa.RecordBatch:
            key = table.column("key").to_numpy()
            names = table.column("cls").to_pylist()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, TOKENS)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[starts, len(key)])
            size_of = np.repeat(size, size)
            edges = []
            for d in range(1, 8):  # small leaves of the whole batch at once
                i = np.flatnonzero((key[d:] == key[:-d]) & (size_of[d:] <= 8))
                hit = i[(sig[i] == sig[i + d]).sum(1) >= least] if len(i) else i
                edges += [(names[x], names[x + d]) for x in hit.tolist()]
            for s, n in zip(starts.tolist(), size.tolist(), strict=True):
                if n > 8:
                    edges += group_edges(names[s : s + n], sig[s : s + n])
            return _edge_batch(edges)

        for batch in batches:  # a leaf may go over batches: its last rows wait
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table])
            key = table.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            kept = table.slice(last)
            if last:
                yield work(table.slice(0, last).combine_chunks())
        if kept is not None and kept.num_rows:
            yield work(kept.combine_chunks())

    return rows.select("key", "cls", "sig").mapInArrow(run, EDGES).distinct()


def exact_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """All pairs with 100 * intersection >= percent * union, as stars over what they connect."""
    size = np.array([len(s) for s in sets])
    joined, n = _Sets(len(sets)), len(sets)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    doc = np.repeat(np.arange(n), size)
    order = np.argsort(ids, kind="stable")
    holders, ends = doc[order], np.cumsum(np.bincount(ids))
    starts = ends - np.bincount(ids)
    at = np.r_[0, np.cumsum(size)]
    for i in range(n - 1):
        own = ids[at[i] : at[i + 1]]
        length = ends[own] - starts[own]
        shift = np.repeat(starts[own] - np.r_[0, np.cumsum(length)[:-1]], length)
        both = np.bincount(holders[shift + np.arange(len(shift))], minlength=n)
        for j in np.flatnonzero(100 * both >= percent * (size[i] + size - both)):
            if j > i:
                joined.join(i, int(j))
    return joined.star()


def verified_edges(groups: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Stars over the exact links within each group (key, cls); a class's text is sent to each of its groups."""
    wanted = groups.join(classes.select("cls", "doc_id"), "cls")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # only the documents that stand for a class of some group are shuffled with their texts
    held = texts.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    rows = wanted.join(held, "doc_id").select("key", "cls", "text")

    def check(group: pd.DataFrame) -> pd.DataFrame:
        sets = shingle_sets(group["text"].tolist())
        names = group["cls"].tolist()
        # a repeated id may bring a text of another class
        own = [i for i, s in enumerate(sets) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == bytes(names[i])]
        pairs = exact_links([sets[i] for i in own], percent) if len(own) > 1 else []
        found = [sorted((bytes(names[own[a]]), bytes(names[own[b]]))) for a, b in pairs]
        return pd.DataFrame(found, columns=["a", "b"])

    return rows.groupBy("key").applyInPandas(lambda key, group: check(group), EDGES).distinct()


def find_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and th (hash of the text), of every row of ``docs`` (doc_id, text).

    Links: 100 * intersection >= ``percent`` * union of the shingle sets, confirmed on full sets. A component's id is
    the smallest doc_id in it. A null or wordless text has no shingle and no link. A null id is no component's name:
    such a row has the component of its text's other rows, or none, and is kept when it has none. Repeated rows are copies.
    """
    threshold = percent / 100
    sigs = stored(signatures(docs, trees_for(threshold)), "signatures")
    classes = stored(
        sigs.where(F.col("cls").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("cls")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("roots").alias("roots")),
        "classes",
    )
    # a union of six shingles and fewer reaches the threshold only as equal sets, which are one class
    used = classes.where(F.col("n") * 100 >= percent)
    roots = used.select(F.explode("roots").alias("key"), "cls", "n")
    all_ = used.select(F.lit(0).cast("long").alias("key"), "cls", "n")
    clusters = components(candidate_edges(covering_leaves(roots, all_, classes, threshold, False), classes, threshold))
    member = clusters.join(classes.select(F.col("cls").alias("node"), "n"), "node").select(
        F.xxhash64("root").alias("key"), F.col("node").alias("cls"), "n"
    )
    sized = stored(_sized(member).withColumn("blocks", _blocks(True)), "clusters")
    groups = _in_blocks(sized.where(F.col("blocks") <= WHOLE))
    large = sized.where(F.col("blocks") > WHOLE).select("key", "cls", "n")
    if not large.isEmpty():
        planted = _planted(large, classes, 0, trees_for(threshold))
        groups = groups.unionAll(covering_leaves(planted, large, classes, threshold, True))
    linked = components(verified_edges(groups, docs, classes, percent))
    named = (
        classes.select("cls", "doc_id")
        .join(linked.select(F.col("node").alias("cls"), "root"), "cls", "left")
        .select("cls", "doc_id", F.coalesce("root", "cls").alias("root"))
    )
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = stored(named.join(stored(least, "least-ids"), "root").select("cls", "component_id"), "components")
    component = F.coalesce("component_id", "doc_id")
    return (
        sigs.select("doc_id", "th", "n_shingles", "cls")
        .join(of_class, "cls", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "th")
    )


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: of the smallest id. Rows without words all stay."""
    marked = stored(find_near_duplicates(docs.select("doc_id", "text"), percent), "near-dups")
    gone = marked.where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("th").alias("__key")).distinct()
    keyed = docs.withColumn("__th", F.xxhash64("text"))
    left = keyed.join(gone, keyed["__th"].eqNullSafe(gone["__key"]) & keyed["doc_id"].eqNullSafe(gone["__id"]), "left_anti")
    twice = stored(marked.where("kept AND n_shingles > 0").groupBy("doc_id", "th").count().where("count > 1"), "repeated-rows")
    if not twice.isEmpty():
        twice = twice.select(F.col("doc_id").alias("__id"), F.col("th").alias("__key"))
        same = left["__th"].eqNullSafe(twice["__key"]) & left["doc_id"].eqNullSafe(twice["__id"])
        left = left.join(twice, same, "left_anti").unionAll(left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "__th"]))
    return left.select(*docs.columns)
