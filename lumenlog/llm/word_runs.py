"""Periodic runs of words by an online sparse diagonal dynamic programme.

Two equal words q apart lie on diagonal q; a run of period q and length n is n - q matches in a row on
that diagonal. Words are taken in order: every earlier occurrence of a word lengthens the match of its
diagonal, and a diagonal that is not lengthened ends and, if it is long enough, gives its run.

What keeps it sparse: a run matches at least max(24 - q, 2 * q) words in a row, so an occurrence counts
only where the m words up to it agree too, with m = 16 for periods below 16 and else the power of two
with m / 2 <= q < m. Such words have names by prefix doubling, of a whole batch of texts at once. And of
the earlier occurrences of one scale only the nearest can lie on the diagonal of a run: one nearer by d
would give the run's end the period d too, and by the theorem of Fine and Wilf the run a period that
divides q. So a word lengthens at most one diagonal per scale, whatever the text: n words cost n log n.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import slices, texts_of

LEAST = 24  # words of a run
TIMES = 3  # periods of a run
FIRST = 16  # words that agree on the diagonal of any run
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def words_of(text: str) -> list[bytes]:
    """The words of a text, parted by ASCII white space."""
    return text.encode().split()


def repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the tail that the checksum of the id asks for; as they are without an id."""
    if doc_id is None or not words:
        return words
    mark = zlib.crc32(str(doc_id).encode())
    if mark % 10:
        return words
    mark //= 10
    n = len(words)
    at = mark % n
    period = 1 + (n - at) // (3 + mark % 8)
    unit = words[at : at + period]
    times = -(-(n - at) // period)
    return words[:at] + (unit * times)[: n - at]


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, bounds): equal words of one text have one number, words of different texts never."""
    numbers = np.empty(sum(map(len, texts)), dtype=np.int64)
    bounds, at, first = [0], 0, 0
    for words in texts:
        seen: dict[bytes, int] = {}
        numbers[at : at + len(words)] = [seen.setdefault(w, len(seen)) for w in words]
        numbers[at : at + len(words)] += first
        at += len(words)
        first += len(seen)
        bounds.append(at)
    return numbers, np.array(bounds)


def occurrences(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every scale m: (m, places, lags) of the words whose last m words stood before, nearest, at a lag of that scale.

    Names of m words come from names of m / 2; a name that stands once in its text has no later use and gets none.
    """
    total = len(numbers)
    names, size = numbers, 1
    while True:
        starts = np.flatnonzero(names >= 0) if size > 1 else np.arange(total)
        starts = starts[starts + size < total]
        starts = starts[names[starts + size] >= 0]
        if not len(starts):
            return
        key = names[starts] * (names.max() + 1) + names[starts + size]
        order = np.argsort(key, kind="stable")  # places of one name stay in their order
        key, places = key[order], starts[order]
        same = key[1:] == key[:-1]
        repeated = np.r_[False, same] | np.r_[same, False]
        names = np.full(total, -1, dtype=np.int64)
        rank = np.cumsum(np.r_[True, ~same]) - 1
        names[places[repeated]] = np.unique(rank[repeated], return_inverse=True)[1]
        size *= 2
        if size >= FIRST:
            later = np.flatnonzero(same) + 1
            lags = places[later] - places[later - 1]
            own = lags < size if size == FIRST else (lags < size) & (lags >= size // 2)
            ends, lags = places[later][own] + size - 1, lags[own]
            order = np.argsort(ends, kind="stable")
            yield size, ends[order], lags[order]


def find_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, by start, then period."""
    numbers, bounds = numbered(texts)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]

    def ended(at: int, lag: int, matched: int) -> None:
        length = matched + lag
        if length >= max(LEAST, TIMES * lag):
            start = at - length + 1
            text = int(np.searchsorted(bounds, start, side="right")) - 1
            runs[text].append((start - int(bounds[text]), length, lag))

    for size, places, lags in occurrences(numbers):
        # one word lengthens one diagonal of a scale, so a diagonal that the next word leaves has ended
        last, diagonal, matched = -2, 0, 0
        for at, lag in zip(places.tolist(), lags.tolist(), strict=True):
            if at == last + 1 and lag == diagonal:
                matched += 1
            else:
                if matched:
                    ended(last, diagonal, matched)
                diagonal, matched = lag, size
            last = at
        if matched:
            ended(last, diagonal, matched)
    for found in runs:
        found.sort(key=lambda r: (r[0], r[2]))
    return runs


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, exactly; then the smallest start, then period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def digest(runs: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()


def periodic_runs(docs: DataFrame, prepare=None) -> DataFrame:
    """One row per document row: doc_id, words (kept ones joined by a space) and runs (start, length, period).

    Null and empty texts have no words and no runs; null ids stay null; repeated rows give repeated rows; other columns
    are not read. ``prepare(words, doc_id)`` may change the words first. Every text is searched whole.
    """
    schema = "doc_id long, collapsed string, runs array<struct<start: long, length: long, period: long>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, found in _searched(batches, prepare):
            kept = [b" ".join(collapse(w, r)).decode() for w, r in zip(texts, found, strict=True)]
            rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kept), pa.array(rows, kind)], names=["doc_id", "collapsed", "runs"])

    return _source(docs).mapInArrow(run, schema)


def digest_runs(docs: DataFrame, prepare=repeated_tail) -> DataFrame:
    """Per document row: its number of runs, the strongest one, and digests of all runs and of the kept words.

    The runs are those of :func:`periodic_runs`. Without a run the four columns of the strongest one are null; the
    digests are then those of the empty text and of all words. A null or empty text has no words; a null id leaves the
    words as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, found in _searched(batches, prepare):
            best = [strongest(r) for r in found]
            column = lambda at: pa.array([None if b is None else b[at] for b in best], pa.int64())  # noqa: B023, E731
            milli = pa.array([None if b is None else 1000 * b[1] // b[2] for b in best], pa.int64())
            kept = [hashlib.sha256(b" ".join(collapse(w, r))).hexdigest() for w, r in zip(texts, found, strict=True)]
            columns = [pa.array(ids, pa.int64()), pa.array([len(r) for r in found], pa.int64()), column(0), column(1), column(2), milli]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([digest(r) for r in found], pa.string()), pa.array(kept, pa.string())],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )

    return _source(docs).mapInArrow(run, SCHEMA)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _searched(batches: Iterator[pa.RecordBatch], prepare) -> Iterator[tuple[list, list, list]]:
    """(ids, words, runs) of slices of about 1 MB of text."""
    for batch in slices(batches, "text", 1 << 20):
        ids = batch.column("doc_id").to_pylist()
        texts = [words_of(t) for t in texts_of(batch)]
        if prepare:
            texts = [prepare(w, i) for w, i in zip(texts, ids, strict=True)]
        yield ids, texts, find_runs(texts)


# Diagonals of all pairs of equal sixteen words, which every run has; a stretch belongs to its smallest period.
ORACLE = r"""WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, x:
      list_reduce(list_prepend(xor(c, x), range(8)), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384::BIGINT) ELSE d >> 1 END)), 4294967295::BIGINT) AS h FROM documents
), tail AS (
  SELECT doc_id, w, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a, 3 + (h // 10) % 8 AS d FROM doc
), placed AS (
  SELECT doc_id, CASE WHEN a = len(w) THEN w ELSE list_transform(range(0, len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (len(w) - a) // d) + 1] END) END AS w FROM tail
), gram AS (
  SELECT doc_id, i, array_to_string(w[i + 1:i + 16], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 15)) AS i FROM placed WHERE len(w) >= 24)
), near AS (
  SELECT b.doc_id, b.i, b.i - a.i AS q, b.i - row_number() OVER (PARTITION BY b.doc_id, b.i - a.i ORDER BY b.i) AS isle FROM gram a JOIN gram b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i
), stretch AS (
  SELECT doc_id, q, min(i) - q AS s, count(*) + 15 + q AS n FROM near GROUP BY doc_id, q, isle HAVING count(*) + 15 + q >= greatest(24, 3 * q)
), run AS (
  SELECT doc_id, s, n, min(q) AS q FROM stretch GROUP BY doc_id, s, n
), best AS (
  SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n::DOUBLE / q DESC, s, q) = 1
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS t, list({'b': s + q, 'e': s + n}) AS gone FROM run GROUP BY doc_id
)
SELECT p.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.s AS start, b.n AS length, b.q AS period, 1000 * b.n // b.q AS exponent_milli, sha256(coalesce(l.t, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN l.gone IS NULL THEN w ELSE list_transform(list_filter(range(0, len(w)), lambda i: NOT list_bool_or(list_transform(gone, lambda r: i >= r.b AND i < r.e))), lambda i: w[i + 1]) END, ' ')) AS collapsed_sha256
FROM placed p LEFT JOIN listed l ON l.doc_id = p.doc_id LEFT JOIN best b ON b.doc_id = p.doc_id"""
