"""Benchmark decontamination by pigeonhole edit matching.

A test item of length m may differ from a passage by ``k = floor(m * error_rate)`` edits. Cut into
k + 1 pieces, at least one piece must stand in the passage unchanged. All pieces go into one
Aho-Corasick automaton; a hit fixes where the item could lie, and Myers' bit-parallel distance, on
Python's integers as bit vectors of any length, decides. Both sides are lower-cased and runs of white
space count as one space.

The pieces are the leaves of a tree: a part with k edits is cut in two that may have a and b, with
a + b + 1 = k, so one of them keeps within its share. A hit climbs from its piece as long as the
part above lies within its own edits around the hit; the whole item is searched only where all parts
above a piece held. A match has such a path for each of its ends, so nothing is lost on the way up.

Items are processed in blocks of bounded text size, so what is sent to the tasks never grows with
the benchmark: each block is one scan of the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import slices, texts_of

KNOWN = 20_000  # answers a block remembers, for passages and phrases that come again and again: some 10 MB
SCHEMA = "doc_id long, item_id long, distance int, start int, end int"


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


class Part:
    """A part of an item: its place, the edits it may have, and the part it was cut from."""

    __slots__ = ("start", "end", "errors", "above", "masks")

    def __init__(self, start: int, end: int, errors: int, above: Part | None):
        self.start, self.end, self.errors, self.above = start, end, errors, above
        self.masks: dict[str, int] | None = None

    def halves(self) -> tuple[Part, Part]:
        left = (self.errors - 1) // 2
        right = self.errors - 1 - left
        cut = self.start + (self.end - self.start) * (left + 1) // (self.errors + 1)
        return Part(self.start, cut, left, self), Part(cut, self.end, right, self)

    def window(self, text: str, start: int) -> str:
        """Where this part of an item that starts at about ``start`` could lie."""
        return text[max(0, start + self.start - self.errors) : start + self.end + self.errors]

    def holds(self, item: str, window: str) -> bool:
        if self.masks is None:
            self.masks = pattern_masks(item[self.start : self.end])
        return myers_search(self.masks, self.end - self.start, window, self.errors, first=True) is not None


def pieces(item: str, errors: int) -> list[tuple[Part, str]]:
    """The ``errors`` + 1 parts without edits into which the tree of halves cuts ``item``."""
    parts, leaves = [Part(0, len(item), errors, None)], []
    while parts:
        part = parts.pop()
        if part.errors:
            parts += part.halves()
        else:
            leaves.append((part, item[part.start : part.end]))
    return leaves


def pattern_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers_search(masks: dict[str, int], m: int, text: str, errors: int, first: bool = False) -> tuple[int, int] | None:
    """(distance, end) of the best match of the pattern anywhere in ``text`` within ``errors``; the first on ties.

    With ``first``, of the first match within ``errors``.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full  # a match may start anywhere, so no carry comes in
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= errors and (best is None or score < best[0]):
            best = (score, at + 1)
            if first or not score:
                break
    return best


class ItemBlock:
    """The automaton of a block of items: normalised text -> ids."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, min_piece: int = 1):
        import ahocorasick

        self.known: dict[tuple[Part, str], bool] = {}
        self.by_text: dict[str, list[int]] = {}
        for item_id, text in items:
            if clean := normalise(text):
                self.by_text.setdefault(clean, []).append(item_id)
        self.texts = sorted(self.by_text)
        self.masks = [pattern_masks(t) for t in self.texts]
        self.reversed_masks = [pattern_masks(t[::-1]) for t in self.texts]
        # the slack keeps a product like 0.29 * 100 from falling below its whole number
        self.errors = [min(int(len(t) * error_rate + 1e-9), max(0, len(t) // min_piece - 1)) for t in self.texts]
        places: dict[str, list[tuple[int, Part]]] = {}
        for i, (t, k) in enumerate(zip(self.texts, self.errors, strict=True)):
            for part, piece in pieces(t, k):
                places.setdefault(piece, []).append((i, part))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of the best match of each item; places in the normalised text."""
        clean = normalise(text)
        if not clean or not self.texts:
            return []
        spots: dict[int, set[int]] = {}
        for last, (size, where) in self.automaton.iter(clean):
            for i, piece in where:
                start = last + 1 - size - piece.start
                if start not in spots.get(i, ()) and self._climbs(i, piece, clean, start):
                    spots.setdefault(i, set()).add(start)
        out = []
        for i, starts in spots.items():
            item, k = self.texts[i], self.errors[i]
            m, best = len(item), None
            if k == 0:  # every hit is the item: the first that stands alone
                alone = _first_alone(clean, item, starts)
                if alone is not None:
                    out += [(item_id, 0, alone, alone + m) for item_id in self.by_text[item]]
                continue
            windows: list[list[int]] = []  # where the item could lie, overlapping windows joined
            for s in sorted(starts):
                lo, hi = max(0, s - k), min(len(clean), s + m + k)
                if windows and lo <= windows[-1][1]:
                    windows[-1][1] = max(hi, windows[-1][1])
                else:
                    windows.append([lo, hi])
            for lo, hi in windows:
                found = myers_search(self.masks[i], m, clean[lo:hi], k)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], lo, lo + found[1])
            if best:
                distance, lo, end = best
                # the start: the same search backwards from the end
                back = myers_search(self.reversed_masks[i], m, clean[lo:end][::-1], distance)
                start = end - (back[1] if back else m)
                out += [(item_id, distance, start, end) for item_id in self.by_text[item]]
        return out

    def _climbs(self, i: int, piece: Part, text: str, start: int) -> bool:
        """Whether every part above a piece, but for the item itself, holds around its hit."""
        part = piece.above
        while part is not None and part.above is not None:
            window = part.window(text, start)
            if (holds := self.known.get((part, window))) is None:
                if len(self.known) >= KNOWN:
                    self.known.clear()
                holds = self.known[part, window] = part.holds(self.texts[i], window)
            if not holds:
                return False
            part = part.above
        return True


def _first_alone(text: str, item: str, starts: set[int]) -> int | None:
    """The first of the item's ``starts`` where it is no part of a longer word."""
    if len(item) <= 2:  # an underscore beside so short an item is part of its word too
        whole = re.search(rf"(?<!\w){re.escape(item)}(?!\w)", text)
        return whole.start() if whole else None
    return next((s for s in sorted(starts) if _stands_alone(text, s, s + len(item))), None)


def _stands_alone(text: str, start: int, end: int) -> bool:
    """A match without room for errors is no part of a longer word."""
    inside = lambda i: 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()
    return not inside(start) and not inside(end)


def find_contamination(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.1, min_piece: int = 1, block_bytes: int = 1 << 20) -> DataFrame:
    """One row per document row and item that stands in it: doc_id, item_id, distance, start, end (exclusive).

    Places count in the normalised text. Null and empty texts and items match nothing; items of the same text are
    all reported; a repeated document row gives its rows again. An item may differ by ``floor(length * error_rate)``
    edits; items too short for one must stand unchanged and as whole words. A ``min_piece`` above 1 asks for less: as
    many edits only as leave pieces of that length. Texts are searched whole.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = []
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        found.append(_scan(source, [(r["item_id"], r["text"]) for r in part.collect()], error_rate, min_piece))
    return reduce(DataFrame.unionAll, found)


def _scan(docs: DataFrame, items: list[tuple[int, str]], error_rate: float, min_piece: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = ItemBlock(items, error_rate, min_piece)
        for batch in slices(batches, "text"):
            rows = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True) for hit in block.find(t)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "start", "end"]
            )

    return docs.mapInArrow(run, SCHEMA)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows in which an item stands; rows whose id is null are judged by their text alone."""
    keyed = docs.withColumn("__text_hash", F.xxhash64("text"))
    source = keyed.select(F.col("__text_hash").alias("doc_id"), "text")
    hits = find_contamination(source, benchmark, **how).select(F.col("doc_id").alias("__text_hash")).distinct()
    return keyed.join(hits, "__text_hash", "left_anti").select(*docs.columns)
