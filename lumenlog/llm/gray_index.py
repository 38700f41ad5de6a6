"""SimHash near-duplicates by a hierarchical index in Gray order.

A document's fingerprint has a bit where over half of its word shingles' hashes have it; fingerprints of
at most ``BITS_APART`` differing bits are linked, and documents that links connect are one component. Only
distinct fingerprints take part, so copies never meet in a join.

An upper node holds the fingerprints that share a pattern under a mask. As one of five parts of the
free bits is equal wherever at most four bits differ, a fingerprint belongs to five nodes, one per part;
a node of more than ``LEAF`` fingerprints is factored again by its free bits, and so on: every linked pair
meets in some node, and no task holds a larger one. Within a node the fingerprints are sorted by Gray
rank, so that neighbours share most bits, and runs of 16, 256 and 4 096 of them form the lower levels: each
level's nodes keep only the shared bits that the level above has not got, a search adds the differences
up on its way down, and whole groups are left as soon as the sum is above the limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import slices, stored, texts_of
from lumenlog.plans.graph import components

WORDS = 4
SEED = 42
BITS_APART = 4
LEAF = 1024  # distinct fingerprints of a node that is searched at once
LEVELS = (4096, 256, 16, 1)  # fingerprints under a node of each level; under the top one all of its node
PAIRS = 1 << 21  # (fingerprint, node) pairs in memory
HASHES = 1 << 16  # shingle hashes whose bits are in memory
HOT = 1000  # a fingerprint of more than one in so many rows is joined by broadcast, at most as many
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
NODES = "node long, code long, free long"
LINKS = "a long, b long"


def shingle_hashes(text: str) -> np.ndarray:
    """Hashes of all runs of four words, repeats included; of the whole sequence where there are fewer."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    last = max(0, len(words) - WORDS)
    pairs = zip(starts[: last + 1].tolist(), ends[len(words) - 1 - last :].tolist(), strict=True)
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(joined[a:b], SEED) for a, b in pairs], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; none without any."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), HASHES):
        part = hashes[at : at + HASHES].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, code) of every row: the fingerprint as a signed 64-bit number, 0 for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            codes = np.array([majority(shingle_hashes(t)) for t in texts_of(batch)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes.view(np.int64))], names=["doc_id", "code"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, code long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Places of codes in the Gray sequence, in which each differs from the next by one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """The lower levels over nodes of distinct codes: ``codes`` sorted by node, then Gray rank; ``firsts`` are the nodes' first places."""

    def __init__(self, codes: np.ndarray, firsts: np.ndarray):
        self.codes = codes
        sizes = np.diff(np.r_[firsts, len(codes)])
        self.of_code = np.repeat(np.arange(len(firsts)), sizes)
        self.size_of_code = sizes[self.of_code]
        within = np.arange(len(codes)) - firsts[self.of_code]
        self.levels = []  # per level: pattern, residual mask, first and last + 1 children, last place
        above_shared, above_starts = None, None
        for span in LEVELS:
            starts = firsts if above_starts is None else np.flatnonzero(within % span == 0)  # a node has one top
            every = np.bitwise_and.reduceat(codes, starts)
            shared = ~(every ^ np.bitwise_or.reduceat(codes, starts))
            residual = shared
            if above_starts is not None:
                own = np.searchsorted(above_starts, starts, side="right") - 1
                residual = shared & ~above_shared[own]
                self.levels[-1]["children"] = np.searchsorted(starts, np.r_[above_starts, len(codes)])
            self.levels.append({"pattern": every & shared, "residual": residual, "end": np.r_[starts[1:], len(codes)]})
            above_shared, above_starts = shared, starts

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j), i before j, of all pairs of one node within ``BITS_APART`` bits."""
        work = np.cumsum(self.size_of_code)
        at, n = 0, len(self.codes)
        while at < n:
            end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + PAIRS, side="right")))
            asked = np.arange(at, end)
            node, apart = self.of_code[at:end], np.zeros(end - at, dtype=np.int64)
            for upper, level in zip(self.levels, self.levels[1:], strict=False):
                first = upper["children"][node]
                count = upper["children"][node + 1] - first
                asked, apart = np.repeat(asked, count), np.repeat(apart, count)
                node = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(len(asked))
                apart = apart + np.bitwise_count((self.codes[asked] ^ level["pattern"][node]) & level["residual"][node])
                keep = (apart <= BITS_APART) & (level["end"][node] > asked + 1)
                asked, node, apart = asked[keep], node[keep], apart[keep]
            yield asked, node
            at = end


def joined(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The first place that links connect each of ``n`` places to."""
    root = np.arange(n)
    for a, b in links:
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def parts_of(free: int) -> list[int]:
    """The free bits dealt to one part more than bits may differ."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    return [sum(bits[p :: BITS_APART + 1]) for p in range(BITS_APART + 1)]


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def factored(nodes: DataFrame) -> DataFrame:
    """Every code of (node, code, free) in the five nodes below its own. Nodes are named by hashes: a clash only joins two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, code, free = (batch.column(c).to_numpy().view(np.uint64) for c in ("node", "code", "free"))
            for mask in np.unique(free).tolist():
                own = free == np.uint64(mask)
                for part in parts_of(mask):
                    pattern = _scrambled(code[own] & np.uint64(part)) + np.uint64(part)
                    below = _scrambled(node[own] ^ _scrambled(pattern))
                    rest = np.full(len(below), mask & ~part, dtype=np.uint64)
                    columns = [pa.array(c.view(np.int64)) for c in (below, code[own], rest)]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "code", "free"])

    return nodes.select("node", "code", "free").mapInArrow(run, NODES)


def node_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) of codes that connect what lies within ``BITS_APART`` bits in one node: at most one row per member."""

    def work(table: pa.Table) -> pa.RecordBatch:
        node = table.column("node").to_numpy()
        codes = table.column("code").to_numpy().view(np.uint64)
        order = np.lexsort((gray_rank(codes), node))
        node, codes = node[order], codes[order]
        firsts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        root = joined(len(codes), GrayIndex(codes, firsts).links())
        linked = np.flatnonzero(root != np.arange(len(codes)))
        ends = [pa.array(codes[places].view(np.int64)) for places in (root[linked], linked)]
        return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the last node of a batch may go on in the next
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table])
            node = table.column("node").to_numpy()
            last = int(np.searchsorted(node, node[-1])) if len(node) else 0
            kept = table.slice(last)
            if last:
                yield work(table.slice(0, last))
        if kept is not None and kept.num_rows:
            yield work(kept)

    return nodes.select("node", "code").repartition("node").sortWithinPartitions("node").mapInArrow(run, LINKS).distinct()


def code_links(codes: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Links that connect the distinct codes of (code) within ``BITS_APART`` bits."""
    top = codes.select(F.lit(0).cast("long").alias("node"), "code", F.lit(-1).cast("long").alias("free"))
    nodes, found = stored(factored(top), "gray-nodes"), []
    while True:
        large = stored(nodes.groupBy("node").count().where(F.col("count") > leaf).select("node"), "gray-large")
        if large.isEmpty():
            found.append(node_links(nodes))
            return reduce(DataFrame.unionAll, found)
        found.append(stored(node_links(nodes.join(large, "node", "left_anti")), "gray-links"))
        nodes = stored(factored(nodes.join(large, "node", "left_semi")), "gray-nodes")


def find_similar(docs: DataFrame, leaf: int = LEAF) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs`` (doc_id, text).

    A component's id is the smallest doc_id in it. Null and wordless texts have fingerprint zero, linked like any other;
    repeated rows are copies. A null id is no component's name: its row has the component of what it is linked with, null
    if there is no id in it. Texts count whole; other columns are not read.
    """
    prints = stored(fingerprints(docs), "fingerprints")
    codes = stored(prints.groupBy("code").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "codes")
    linked = components(code_links(codes.select("code"), leaf))
    named = codes.join(linked.withColumnRenamed("node", "code"), "code", "left").withColumn("root", F.coalesce("root", "code"))
    named = stored(named, "gray-named")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_code = stored(named.join(least, "root").select("code", "component_id", "n"), "gray-components")
    rows = of_code.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * HOT > rows
    hot = of_code.where(often).select("code", "component_id", F.lit(True).alias("hot"))
    marked = prints.join(F.broadcast(hot), "code", "left")
    rare = marked.where(F.col("hot").isNull()).select("doc_id", "code").join(of_code.where(~often).select("code", "component_id"), "code")
    whole = marked.where(F.col("hot")).select("doc_id", "code", "component_id").unionAll(rare.select("doc_id", "code", "component_id"))
    return whole.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
