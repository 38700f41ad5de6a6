"""Density clusters of vectors by cosine similarity.

A vector is a core when at least ``min_points`` vectors, itself included, are at least
``min_similarity`` similar to it. Cores that are similar share a cluster; another vector joins
the smallest-numbered cluster of the cores similar to it, or is noise.

Pairs are found exactly without comparing all: unit vectors lie at Euclidean distance
``sqrt(2 - 2 cos)``, each is at home in the cell of its nearest pivot, and by the triangle inequality
every similar vector of its own is within twice the radius of being as near to that pivot. So a
cell gets those as guests and each vector sees all its neighbours in its own cell.

A cell is compared in tiles: its own vectors and its guests are cut into blocks of about ``block_rows``,
and every own block meets every guest block in a group of its own. So no group holds more than two
blocks, whatever the threshold, the number of guests or the share of the table in one cell. Where the
cells leave too little out, one cell holds all, and every two blocks meet once, for both sides.

All are compared once. A tile hands on counts, which are summed, every pair of a vector that has fewer than
``min_points`` neighbours in it, and of any other the first (in a block against itself also the last). So the
pairs of all that are no cores are known, and nearly all of the links between cores: components of
those are clusters, or parts of clusters. Then only what lies in different parts is compared again,
the largest part against itself not at all; these tiles hand on pairs of parts.

Similarities are products of single floats; those closer to the threshold than such a product can be off are
taken again in double.

What is sent grows with the blocks that a vector meets, so a block holds an eighth of the table, up to
``BLOCK_ROWS``: a vector is sent some eight times in one cell, sixteen in cells, until the table has more than eight of
the largest blocks. Where the cells leave too little out, many cells send more than one that holds all; the cheaper of both is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.plans.graph import components
from lumenlog.session import materialize

MAX_PIVOTS = 1024
CELL_ROWS = 2048  # own vectors of a cell, while there are few enough cells
BLOCK_ROWS = 65536  # own vectors, and guests, of a tile: 32 MB of 64 doubles on either side
PAIRS = 1 << 23  # pairs held at once, a byte each
ROWS, COLUMNS = 128, 4096  # similarities computed at once: 2 MB
BATCH_ROWS = 2048  # vectors placed at once
MAX_PARTITIONS = 1024
_SLACK = 1e-6
LAST = (1 << 63) - 1  # comes last among labels
TILE = "cell int, own_block int, guest_block int, own boolean, id long, label long, v array<double>"
FOUND = "id long, other long, neighbours long"


class Cells:
    """Pivots and reach: where a unit vector is at home and where it is a guest."""

    def __init__(self, pivots: np.ndarray, min_similarity: float):
        self.pivots = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)
        self.reach = 2 * np.sqrt(max(0.0, 2 - 2 * min_similarity)) + _SLACK

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home cell of each row, rows and cells of all guests); a vector is a guest at home too."""
        far = np.sqrt(np.maximum(0, 2 - 2 * x @ self.pivots.T))
        row, cell = np.nonzero(far <= far.min(1, keepdims=True) + self.reach)
        return far.argmin(1), row, cell


def _unit(batch: pa.RecordBatch) -> np.ndarray:
    x = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(start, BATCH_ROWS)


def cell_sizes(vectors: DataFrame, cells) -> DataFrame:
    """(cell, own, guests): one row per cell; ``cells`` is a broadcast :class:`Cells`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(cells.value.pivots)
        own, guests = np.zeros(n, "int64"), np.zeros(n, "int64")
        for batch in _slices(batches):
            home, _, cell = cells.value.place(_unit(batch))
            own += np.bincount(home, minlength=n)
            guests += np.bincount(cell, minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype="int32")), pa.array(own), pa.array(guests)], ["cell", "own", "guests"])

    counted = vectors.select("id", "v").mapInArrow(run, "cell int, own long, guests long")
    return counted.groupBy("cell").agg(F.sum("own").alias("own"), F.sum("guests").alias("guests"))


def tiles(
    vectors: DataFrame, cells, sizes: dict[int, tuple[int, int]], block_rows: int, once: bool = False, largest: int | None = None
) -> DataFrame:
    """The rows of all tiles of (id, v, label if there is one): an own row once per guest block of its cell, a guest once per own block.

    With ``once`` (one cell, own rows and guests are the same) two blocks meet once: own block and guest block ascend, and a block that
    meets itself is sent as own rows only. Rows of the label ``largest`` are guests only.
    """
    blocks = _blocks(sizes, block_rows)
    labelled = "label" in vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(cells.value.pivots)
        own_blocks, guest_blocks = np.ones(n, "int64"), np.ones(n, "int64")
        for c, (o, g) in blocks.items():
            own_blocks[c], guest_blocks[c] = o, g
        held = np.array([c in blocks for c in range(n)])
        for batch in _slices(batches):
            x = _unit(batch)
            ids, labels = batch["id"].to_numpy(), batch["label"].to_numpy()
            mix = (ids.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            home, row, cell = cells.value.place(x)
            wanted = held[cell]
            row, cell = row[wanted], cell[wanted]
            owner = np.arange(len(x)) if largest is None else np.flatnonzero(labels != largest)
            parts = []
            for own, r, c, times, mine in (
                (True, owner, home[owner], guest_blocks, own_blocks),
                (False, row, cell, own_blocks, guest_blocks),
            ):
                if not len(r):
                    continue
                block, copies, first = (mix[r] % mine[c].astype("uint64")).astype("int64"), times[c], 0
                if once:  # own: blocks from its own on; guest: those before
                    first, copies = (block, copies - block) if own else (0, block)
                other = np.concatenate([np.arange(k) for k in copies]) + np.repeat(np.broadcast_to(first, len(r)), copies)
                r, c, block = np.repeat(r, copies), np.repeat(c, copies), np.repeat(block, copies)
                parts.append((r, c, block, other, own) if own else (r, c, other, block, own))
            for r, c, own_block, guest_block, own in parts:
                for at in range(0, len(r), 4 * BATCH_ROWS):
                    s = slice(at, at + 4 * BATCH_ROWS)
                    v = pa.FixedSizeListArray.from_arrays(pa.array(x[r[s]].ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                    columns = [pa.array(a[s].astype("int32")) for a in (c, own_block, guest_block)]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array(np.full(len(r[s]), own)), pa.array(ids[r[s]]), pa.array(labels[r[s]]), v],
                        [f.split()[0] for f in TILE.split(", ")],
                    )

    return vectors.select("id", "label" if labelled else F.col("id").alias("label"), "v").mapInArrow(run, TILE)


def _blocks(sizes: dict[int, tuple[int, int]], block_rows: int) -> dict[int, tuple[int, int]]:
    """Own blocks and guest blocks of each cell that has own rows."""
    return {c: (-(-own // block_rows), max(1, -(-guests // block_rows))) for c, (own, guests) in sizes.items() if own}


def _dealt(dealt: DataFrame, sizes: dict[int, tuple[int, int]], block_rows: int):
    """Groups of one tile each, over so many partitions that few hold two."""
    n = sum(own * guests for own, guests in _blocks(sizes, block_rows).values())
    key = ["cell", "own_block", "guest_block"]
    return dealt.repartition(min(MAX_PARTITIONS, max(1, 2 * n)), *key).groupBy(*key)


class _Near:
    """Which of two sets of unit vectors are similar."""

    def __init__(self, mine: np.ndarray, guests: np.ndarray, min_similarity: float):
        self.mine, self.guests, self.least = mine, guests, min_similarity
        self.singles = mine.astype("float32"), guests.astype("float32")
        # a product of n single floats is off by less than n + 4 units of 2^-24, what is rounded to 12 digits by half of the last
        off = (mine.shape[1] + 8) * 2.0**-24 + 1e-12
        self.sure, self.maybe = np.float32(min_similarity + off), np.float32(min_similarity - off)

    def hits(self, first: int, last: int, since: int = 0) -> np.ndarray:
        """Own rows from ``first`` to ``last`` against the guests from ``since`` on."""
        a, b = self.singles
        out = np.empty((last - first, len(b) - since), bool)
        for i in range(first, last, ROWS):
            i_end = min(i + ROWS, last)
            for j in range(since, len(b), COLUMNS):
                s = a[i:i_end] @ b[j : j + COLUMNS].T
                hit, near = s >= self.sure, s >= self.maybe
                n = np.count_nonzero(near) - np.count_nonzero(hit)
                if n > near.size // 64:
                    s = self.mine[i:i_end] @ self.guests[j : j + COLUMNS].T
                    hit = np.round(s, 12, out=s) >= self.least
                elif n:
                    r, c = np.nonzero(near ^ hit)
                    exact = np.einsum("ij,ij->i", self.mine[i + r], self.guests[j + c])
                    hit[r, c] = np.round(exact, 12) >= self.least
                out[i - first : i_end - first, j - since : j - since + s.shape[1]] = hit
        return out


def _sides(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of the own side and the guests of a tile, either in the order of the labels."""
    own, label = table["own"].to_numpy(zero_copy_only=False), table["label"].to_numpy()
    out = []
    for rows in (np.flatnonzero(own), np.flatnonzero(~own)):
        rows = rows[np.argsort(label[rows], kind="stable")]
        part = table.take(pa.array(rows)).combine_chunks()
        flat = part["v"].combine_chunks().flatten() if part.num_rows else pa.array([], pa.float64())
        x = flat.to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) if part.num_rows else np.zeros((0, 1))
        out.append((part["id"].to_numpy(), label[rows], x))
    return out


def _places(ids: np.ndarray, guests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, guest) of the own rows that are guests too."""
    order = np.argsort(guests)
    at = np.minimum(np.searchsorted(guests, ids, sorter=order), len(guests) - 1)
    rows = np.flatnonzero(guests[order[at]] == ids)
    return rows, order[at[rows]]


def _count(table: pa.Table, min_similarity: float, min_points: int, once: bool) -> pa.Table:
    """Rows (id, null, neighbours in this tile), and pairs (id, other, 0): see the module."""
    (ids, _, x), (guest_ids, _, guests) = _sides(table)
    itself = once and table["own_block"][0] == table["guest_block"][0]
    if itself:
        guest_ids, guests = ids, x
    if not len(ids) or not len(guests):
        return pa.table({name: pa.array([], pa.int64()) for name in ("id", "other", "neighbours")})
    both, few = once and not itself, min_points - 1
    near, own, theirs = _Near(x, guests, min_similarity), np.zeros(len(ids), "int64"), np.zeros(len(guests), "int64")
    self_row, self_guest = _places(ids, guest_ids)
    pairs, held = [], [np.zeros((2, 0), "int64")]
    step = max(1, min(255, PAIRS // len(guests)))
    for start in range(0, len(ids), step):
        hit = near.hits(start, min(start + step, len(ids)))
        n = own[start : start + len(hit)] = _row_sums(hit)
        if both:
            wanted = np.flatnonzero(theirs <= few)
            r, c = np.nonzero(hit[:, wanted])
            theirs += np.add.reduce(hit.view("uint8"), axis=0, dtype="uint8")
            rest = np.hstack([*held, np.vstack([start + r, wanted[c]])])
            held = [rest[:, theirs[rest[1]] <= few]]
        at = slice(*np.searchsorted(self_row, [start, start + len(hit)]))
        hit[self_row[at] - start, self_guest[at]] = False
        rows = np.flatnonzero(n <= few)
        r, c = np.nonzero(hit[rows])
        pairs.append((start + rows[r], c))
        first = hit.argmax(1)
        rows = np.flatnonzero((n > few) & hit[np.arange(len(hit)), first])
        pairs.append((start + rows, first[rows]))
        if not both:
            pairs.append((start + rows, len(guests) - 1 - hit[rows, ::-1].argmax(1)))
    r, c = (np.concatenate(part) for part in zip(*pairs, *held))
    counts = [(ids, own), (guest_ids, theirs)] if both else [(ids, own)]
    a = np.concatenate([ids[r], *[i for i, _ in counts]])
    n = np.concatenate([np.zeros(len(r), "int64"), *[k for _, k in counts]])
    other = np.concatenate([guest_ids[c], np.zeros(len(a) - len(r), "int64")])
    return pa.table({"id": pa.array(a, pa.int64()), "other": pa.array(other, pa.int64(), mask=np.arange(len(a)) >= len(r)), "neighbours": pa.array(n)})


def _row_sums(hit: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.packbits(hit, axis=1)).sum(1, dtype="int64")


def _link(table: pa.Table, min_similarity: float) -> pa.Table:
    """Pairs of labels, the smaller first, of which two vectors are similar."""
    (_, mine, x), (_, theirs, guests) = _sides(table)
    out = np.zeros((0, 2), "int64")
    if len(mine) and len(guests):
        near, step = _Near(x, guests, min_similarity), max(1, min(255, PAIRS // len(guests)))
        for start in range(0, len(mine), step):
            end = min(start + step, len(mine))
            # either side is in the order of the labels, and pairs of the other order are met from the other side
            since = int(np.searchsorted(theirs, mine[start], "right"))
            if since < len(theirs):
                r, c = np.nonzero(near.hits(start, end, since))
                met = np.column_stack([mine[start + r], theirs[since + c]])
                out = np.unique(np.vstack([out, met[met[:, 0] < met[:, 1]]]), axis=0)
    return pa.table({"a": pa.array(out[:, 0]), "b": pa.array(out[:, 1])})


def _sent(sizes: dict[int, tuple[int, int]], block_rows: int) -> int:
    """Rows that all tiles hold."""
    return sum(own * -(-guests // block_rows) + guests * -(-own // block_rows) for own, guests in sizes.values() if own)


def density_clusters(
    vectors: DataFrame, min_similarity: float, min_points: int, id_col: str = "eventId", block_rows: int | None = None
) -> DataFrame:
    """(id, neighbours, kind, cluster) of every vector; kind is core, border or noise, cluster the smallest core id.

    Null and zero vectors, and those of another length than the commonest, have no neighbours and are noise.
    Ids are expected to be unique. At most ``MAX_PIVOTS`` pivots are sent to the tasks, one per ``CELL_ROWS`` vectors; a
    tile holds about ``block_rows`` vectors on either side (default: an eighth of the table, from ``CELL_ROWS`` to ``BLOCK_ROWS``). Where the threshold lets no cell be left out, this
    compares all pairs, in equal tiles.
    """
    spark = vectors.sparkSession
    source = materialize(vectors.select(F.col(id_col).cast("long").alias("id"), "embedding"), "density-vectors")
    source = source.select("id", F.col("embedding").cast("array<double>").alias("v"))
    usable = F.coalesce(F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)), F.lit(False))
    width = source.where(usable).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    none = F.lit(None).cast("long")
    if width is None:
        return source.select("id", F.lit(0).cast("long").alias("neighbours"), F.lit("noise").alias("kind"), none.alias("cluster"))
    fits = source.where(usable & (F.size("v") == width["n"]) & F.col("id").isNotNull())
    pivots = min(MAX_PIVOTS, max(1, width["count"] // min(CELL_ROWS, block_rows or CELL_ROWS)))
    block_rows = block_rows or min(BLOCK_ROWS, max(CELL_ROWS, -(-width["count"] // 8)))
    picked = np.array([r["v"] for r in fits.orderBy(F.xxhash64("id")).limit(pivots).collect()], dtype=float)
    cells = spark.sparkContext.broadcast(Cells(picked, min_similarity))
    held = lambda sizes: {r["cell"]: (r["own"], r["guests"]) for r in sizes.collect()}  # noqa: E731  a row per pivot
    sizes = held(cell_sizes(fits, cells))
    whole = {0: (width["count"], width["count"])}
    if once := _sent(whole, block_rows) < 2 * _sent(sizes, block_rows):
        cells, sizes = spark.sparkContext.broadcast(Cells(picked[:1], -1.0)), whole

    dealt = _dealt(tiles(fits, cells, sizes, block_rows, once), sizes, block_rows)
    found = materialize(dealt.applyInArrow(lambda t: _count(t, min_similarity, min_points, once), FOUND), "density-pairs")
    counts = found.groupBy("id").agg(F.sum("neighbours").alias("neighbours")).withColumn("core", F.col("neighbours") >= min_points)
    counts = materialize(counts, "density-counts")
    core = counts.where("core").select("id")
    pairs = found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))
    known = pairs.join(counts.select(F.col("id").alias("a"), F.col("core").alias("core_a")), "a").join(
        counts.select(F.col("id").alias("b"), F.col("core").alias("core_b")), "b"
    )
    roots = components(known.where("core_a AND core_b").select("a", "b"))
    alone = core.join(roots.select(F.col("node").alias("id")), "id", "left_anti").select(F.col("id").alias("node"), F.col("id").alias("root"))
    labels = materialize(roots.unionByName(alone), "density-parts")

    # of parts of clusters, all but the largest look for similar vectors of other parts; it comes last in their order
    parts = labels.groupBy("root").count().orderBy(F.desc(F.col("root") == LAST), F.desc("count"), "root").first()
    if parts is not None:
        label = F.when(F.col("root") == parts["root"], F.lit(LAST)).otherwise(F.col("root"))
        cores = fits.join(labels.select(F.col("node").alias("id"), label.alias("label")), "id")
        sizes = {c: (own, sizes[c][1]) for c, (own, _) in held(cell_sizes(cores.where(F.col("label") != LAST), cells)).items()}
        dealt = _dealt(tiles(cores, cells, sizes, block_rows, False, LAST), sizes, block_rows)
        met = dealt.applyInArrow(lambda t: _link(t, min_similarity), "a long, b long").distinct()
        met = components(met.withColumn("b", F.when(F.col("b") == LAST, F.lit(parts["root"])).otherwise(F.col("b"))))
        joined = labels.join(met.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
        labels = joined.select("node", F.coalesce("to", "root").alias("root"))
    touched = known.where("core_a <> core_b").select(
        F.when(F.col("core_a"), F.col("a")).otherwise(F.col("b")).alias("node"), F.when(F.col("core_a"), F.col("b")).otherwise(F.col("a")).alias("other")
    )
    edge = touched.join(labels, "node").groupBy(F.col("other").alias("node")).agg(F.min("root").alias("root"))
    named = labels.withColumn("kind", F.lit("core")).unionByName(edge.withColumn("kind", F.lit("border")))
    return (
        source.select("id")
        .join(counts.drop("core"), "id", "left")
        .join(named.select(F.col("node").alias("id"), "kind", F.col("root").alias("cluster")), "id", "left")
        .select("id", F.coalesce("neighbours", F.lit(0).cast("long")).alias("neighbours"), F.coalesce("kind", F.lit("noise")).alias("kind"), "cluster")
    )
