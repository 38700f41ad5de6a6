"""Token counts by rank-synchronous merging of ragged symbol arrays.

Pre-tokens of a batch are held as one flat symbol array with offsets. In every round each
sequence merges its lowest-rank pair (leftmost on ties), all sequences at once; a sequence
without a pair leaves the batch with its surviving symbols counted. That is the order in
which the library merges, so counts are equal, not close.

Pre-tokens start at a space marker that follows another character (checked on the vocabulary)
and are also cut where two characters stand together in no piece: no merge can cross such a cut.
Distinct pre-tokens are counted once per worker, in a cache of bounded size. A sequence of more
than ``LONG`` symbols would need as many rounds; it is merged with a heap in the same order.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenlog.llm import piece_model as pm
from lumenlog.llm.common import slices, texts_of

LONG = 192
BLOCK = 16384
CACHE_ENTRIES = 400_000
_NONE = np.int64(1) << 60


class RankMerger:
    """Counts pieces of BPE piece models without external normalisation tables."""

    def __init__(self, model: pm.PieceModel):
        if model.model_type != pm.BPE or not model.byte_fallback or model.charsmap:
            raise ValueError("needs a BPE piece model with byte fallback and no normalisation table")
        if any(kind in (pm.USER_DEFINED, pm.UNUSED) for _, _, kind in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.model = model
        normal = [(p, s) for p, s, kind in model.pieces if kind == pm.NORMAL]
        self.ids = {p: i for i, (p, _) in enumerate(normal)}
        for c in sorted({c for p, _ in normal for c in p} - self.ids.keys()):
            self.ids[c] = len(self.ids)
        self.n_pieces, self.width = len(normal), len(self.ids) + 1
        self.other = len(self.ids)  # every character that is in no piece
        levels = {s: r for r, s in enumerate(sorted({s for _, s in normal}, reverse=True))}
        pairs = {}
        for p, s in normal:
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = (levels[s], self.ids[p])
        self.pairs = pairs
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.keys = keys
        self.ranks = np.array([pairs[k][0] for k in keys.tolist()], dtype=np.int64)
        self.merged = np.array([pairs[k][1] for k in keys.tolist()], dtype=np.int64)
        chars = sorted({c for p, _ in normal for c in p})
        self.char_of = np.zeros(0x110000, dtype=np.int32)
        self.sym_of = np.full(0x110000, self.other, dtype=np.int32)
        for i, c in enumerate(chars):
            self.char_of[ord(c)], self.sym_of[ord(c)] = i + 1, self.ids[c]
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
        for p, _ in normal:
            for a, b in zip(p, p[1:], strict=False):
                self.joined[self.char_of[ord(a)], self.char_of[ord(b)]] = True
        self.split = re.compile(" *[^ ]+| +$" if model.marker_leads else r"(?s).+")
        self.cache: dict[str, int] = {}

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), at

    def _surviving(self, symbol: int, char_bytes: int) -> int:
        return 1 if symbol < self.n_pieces else char_bytes

    def _heap_count(self, text: str) -> int:
        """One long sequence, same order: lowest rank first, then leftmost."""
        sym = [self.ids.get(c, self.other) for c in text]
        n = len(sym)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def push(i: int, j: int) -> None:
            found = self.pairs.get(sym[i] * self.width + sym[j])
            if found:
                heapq.heappush(heap, (found[0], i, j, sym[i], sym[j], found[1]))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, j, a, b, new = heapq.heappop(heap)
            if not (alive[i] and alive[j] and nxt[i] == j and sym[i] == a and sym[j] == b):
                continue
            sym[i], alive[j], nxt[i] = new, False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
                push(i, nxt[j])
            if prv[i] >= 0:
                push(prv[i], i)
        return sum(self._surviving(s, len(text[i].encode())) for i, s in enumerate(sym) if alive[i])

    def count_all(self, tokens: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token."""
        total = np.zeros(len(tokens), dtype=np.int64)
        for start in range(0, len(tokens), BLOCK):
            total[start : start + BLOCK] = self._count_block(tokens[start : start + BLOCK])
        return total

    def _count_block(self, tokens: list[str]) -> np.ndarray:
        total = np.zeros(len(tokens), dtype=np.int64)
        chars = "".join(tokens)
        code = np.frombuffer(chars.encode("utf-32-le"), dtype=np.uint32)
        owner = np.repeat(np.arange(len(tokens)), np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)))
        sym = self.sym_of[code].astype(np.int64)
        in_pieces = self.char_of[code]
        cost = np.where(sym < self.n_pieces, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        # a sequence ends with its pre-token and where no piece has the two characters side by side
        starts = np.r_[True, (owner[1:] != owner[:-1]) | ~self.joined[in_pieces[:-1], in_pieces[1:]]]
        seq = np.cumsum(starts) - 1
        size = np.bincount(seq)
        first = np.flatnonzero(starts)
        for i in np.flatnonzero(size > LONG):
            total[owner[first[i]]] += self._heap_count(chars[first[i] : first[i] + size[i]])
        size_of = size[seq]
        np.add.at(total, owner[size_of == 1], cost[size_of == 1])
        some = (size_of > 1) & (size_of <= LONG)
        sym, cost, seq = sym[some], cost[some], seq[some]
        owner_of = owner[first]
        rank, at = np.full(len(sym), _NONE), np.zeros(len(sym), dtype=np.int64)
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inner], at[inner] = self._find(sym[inner], sym[inner + 1])
        while len(sym):
            head = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.r_[head, len(sym)]))
            over = best == _NONE
            if over.any():
                total += np.bincount(owner_of[seq[over]], cost[over], len(tokens)).astype(np.int64)
                keep = ~over
                sym, seq, cost, rank, at, best = sym[keep], seq[keep], cost[keep], rank[keep], at[keep], best[keep]
                if not len(sym):
                    break
            lowest = np.flatnonzero(rank == best)
            lowest = lowest[np.r_[True, seq[lowest[1:]] != seq[lowest[:-1]]]]
            sym[lowest] = self.merged[at[lowest]]
            cost[lowest] = 1
            keep = np.ones(len(sym), dtype=bool)
            keep[lowest + 1] = False
            spot = lowest - np.arange(len(lowest))  # one symbol went from every sequence before
            sym, seq, cost, rank, at = sym[keep], seq[keep], cost[keep], rank[keep], at[keep]
            touched = np.r_[spot, spot[spot > 0] - 1]
            rank[touched] = _NONE
            touched = touched[touched < len(sym) - 1]
            touched = touched[seq[touched] == seq[touched + 1]]
            rank[touched], at[touched] = self._find(sym[touched], sym[touched + 1])
        return total

    def normalise(self, text: str) -> str:
        text = text.replace(pm.SPACE, " ")
        if self.model.remove_extra_whitespaces:
            text = re.sub(" +", " ", text.strip(" "))
        return f" {text}" if text and self.model.add_dummy_prefix else text

    def count_texts(self, texts: list[str]) -> list[int]:
        counts = [Counter(self.split.findall(self.normalise(t))) for t in texts]
        cache = self.cache
        new = list({w for c in counts for w in c if w not in cache})
        if len(cache) + len(new) > CACHE_ENTRIES:
            cache = self.cache = {}
            new = list({w for c in counts for w in c})
        marked = [w.replace(" ", pm.SPACE) for w in new]
        cache.update(zip(new, self.count_all(marked).tolist(), strict=True))
        out = [sum(n * cache[w] for w, n in c.items()) for c in counts]
        if len(cache) > CACHE_ENTRIES:
            self.cache = {}
        return out


def count_tokens(docs: DataFrame, model_path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``.

    Null and empty texts have no bytes and no tokens. Repeated rows, null ids and extra columns
    change nothing: each input row gives one output row. Very long texts are counted whole.
    """
    path = model_path or pm.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = RankMerger(pm.load_model(path))
        for batch in slices(batches, "text", 4 << 20):
            texts = texts_of(batch)
            tokens = merger.count_texts(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
