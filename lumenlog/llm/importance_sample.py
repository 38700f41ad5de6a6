"""Importance resampling of documents towards a target set of texts.

Texts become bags of hashed features: words and pairs of neighbouring words. A bucket's gain says how
much more frequent it is in the target texts than in the documents; a document's weight is the mean gain
of its features, and documents are drawn without replacement by the greatest weight plus Gumbel noise
(the noise is a hash of the id, so that a rerun draws the same).

A batch's texts are joined with sentinels between them and one pass of a regular expression finds all
words. A binary search of the words' places in the offsets of the texts gives each word's text; pairs
whose words lie in different texts are masked, and the rest is counted per bucket at once.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.llm.common import slices, stored, texts_of

BUCKETS = 10_000
LEAST_WORDS = 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of UTF-8: every character from U+0080 on belongs to a word
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
WORD_BYTE = np.array([WORD.match(bytes([b])) is not None for b in range(256)])
SENTINEL = b"\x00"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
AT_ONCE = 1 << 20  # bytes whose words are in memory
SLICE = 2 << 20
LONG = 64  # bytes of a space and a word from which on a pair's checksum is computed by itself


def feature_buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(text, bucket, words) of all features of a batch, some bytes at a time; the first ``words`` of each are the words themselves."""
    coded = [t.encode().translate(LOWER) for t in texts]
    offsets = np.cumsum([0, *(len(c) + len(SENTINEL) for c in coded)])
    joined = SENTINEL.join(coded)
    is_word = WORD_BYTE[np.frombuffer(joined, dtype=np.uint8)]
    at, last, last_text = 0, [], np.zeros(0, dtype=np.int64)  # the word before, for the pair over the cut
    while at < len(joined):
        gap = GAP.search(joined, at + AT_ONCE)
        end = gap.end() if gap else len(joined)
        found = WORD.findall(joined, at, end)
        starts = at + np.flatnonzero(is_word[at:end] & ~np.r_[False, is_word[at : end - 1]])
        new, at = len(found), end
        if not new:
            continue
        text = np.r_[last_text, np.searchsorted(offsets, starts, side="right") - 1]
        names = pa.array(last + found, pa.binary()).dictionary_encode()
        last, last_text = found[-1:], text[-1:]
        words, ids = names.dictionary.to_pylist(), names.indices.to_numpy()
        sums = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
        same = text[1:] == text[:-1]
        of_pair = pair_checksums(words, sums, ids[:-1][same], ids[1:][same])
        yield np.r_[text[-new:], text[1:][same]], (np.r_[sums[ids[-new:]], of_pair] % BUCKETS).astype(np.int64), new


@lru_cache(1)
def shifts() -> np.ndarray:
    """What appending n bytes does to each byte of a checksum: a checksum is linear, so the four parts add up by xor."""
    zeros = [bytes(n) for n in range(LONG)]
    part = lambda z, at: [zlib.crc32(z, value << 8 * at) ^ zlib.crc32(z) for value in range(256)]
    return np.array([[part(z, at) for at in range(4)] for z in zeros], dtype=np.uint32)


def pair_checksums(words: list[bytes], sums: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Checksums of ``words[left] + b" " + words[right]`` from those of the parts."""
    spaced = np.array([zlib.crc32(b" " + w) for w in words], dtype=np.uint32)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    first, n = sums[left], np.minimum(size[right], LONG - 1)
    out, table = spaced[right], shifts()
    for at in range(4):
        out = out ^ table[n, at, (first >> np.uint32(8 * at)) & np.uint32(255)]
    for i in np.flatnonzero(size[right] >= LONG).tolist():  # long words one by one
        out[i] = zlib.crc32(b" " + words[right[i]], int(first[i]))
    return out


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) over all features of all rows: one row per bucket and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in slices(batches, "text", SLICE):
            for _, buckets, _ in feature_buckets(texts_of(batch)):
                counts += np.bincount(buckets, minlength=BUCKETS)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, targets: DataFrame) -> list[int]:
    """The gain of every bucket; at most ``BUCKETS`` rows of counts come to the driver from each side."""

    def counts(texts: DataFrame) -> list[int]:
        held = {r["bucket"]: r["n"] for r in bucket_counts(texts).collect()}
        return [held.get(b, 0) for b in range(BUCKETS)]

    own, wanted = counts(documents), counts(targets)
    all_own, all_wanted = float(sum(own) + BUCKETS), float(sum(wanted) + BUCKETS)
    return [math.floor(1000 * math.log((t + 1.0) * all_own / ((s + 1.0) * all_wanted))) for s, t in zip(own, wanted, strict=True)]


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, from the hash of the seed and the id (of the seed alone without an id)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gains: list[int], seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score and n_words of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.array(gains, dtype=np.int64)
        for batch in slices(batches, "text", SLICE):
            ids, n = batch.column("doc_id").to_pylist(), batch.num_rows
            total, features, words = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for text, buckets, new in feature_buckets(texts_of(batch)):
                np.add.at(total, text, gain[buckets])
                features += np.bincount(text, minlength=n)
                words += np.bincount(text[:new], minlength=n)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            score = weight + np.array([noise(i, seed) for i in ids], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(features), pa.array(weight), pa.array(score), pa.array(words)],
                names=["doc_id", "n_features", "weight", "score", "n_words"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, n_features long, weight long, score long, n_words long")


def resample(docs: DataFrame, targets: DataFrame, percent: int = 25, least_words: int = LEAST_WORDS, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs`` (doc_id, text); ``rank`` is null where it isn't drawn.

    Drawn are ``percent`` of the rows of at least ``least_words`` words (rounded down), by score, ties to the smaller
    doc_id. Null and empty texts have no features, weight 0 and no rank; a null id comes first among equal scores; every
    repeated row counts and may be drawn. Without documents or targets all gains come from the smoothing alone.

    Scores are whole thousandths of logarithms, so a table of any size has some 200 000 different ones at most: their
    counts are a small table, and a row's rank is the count of greater scores plus its place among equals. The noise
    spreads even equal weights, so that no score holds more than about one row in 2 700 of different ids.
    """
    scored = stored(score_documents(docs, bucket_gains(docs, targets), seed), "importance")
    able = scored.where(F.col("n_words") >= least_words)
    by_score = able.groupBy("score").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    ladder = stored(by_score.select("score", "n", F.coalesce(above, F.lit(0)).alias("above")), "importance-scores")
    wanted = percent * (ladder.agg(F.sum("n")).first()[0] or 0) // 100
    reached = ladder.where(F.col("above") < wanted).select("score", "above")
    place = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    columns = ["doc_id", "n_features", "weight", "score"]
    marked = scored.join(F.broadcast(reached), "score", "left").withColumn("above", F.when(F.col("n_words") >= least_words, F.col("above")))
    drawn = marked.where(F.col("above").isNotNull()).withColumn("rank", place.cast("long"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = marked.where(F.col("above").isNull()).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*columns, "rank").unionAll(rest.select(*columns, "rank"))


# The checksum of a feature is computed bit by bit; texts are UTF-8 in hex.
ORACLE = r"""WITH texts AS (
  SELECT 0 AS target, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark
), split AS (
  SELECT target, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), feature AS (
  SELECT target, doc_id, unnest(w) AS g FROM split
  UNION ALL SELECT target, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM split WHERE len(w) > 1
), coded AS (
  SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM feature)
), bytes AS (
  SELECT g, list_transform(range(0, len(h) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1) AS b FROM coded
), hashed AS (
  SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(b, lambda x: x::BIGINT)), lambda c, x:
    list_reduce(list_prepend(xor(c, x), range(8)), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384::BIGINT) ELSE d >> 1 END)), 4294967295::BIGINT) % 10000 AS bucket
  FROM bytes
), used AS (
  SELECT f.target, f.doc_id, h.bucket FROM feature f JOIN hashed h ON f.g = h.g
), counted AS (
  SELECT bucket, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t FROM used GROUP BY bucket
), total AS (
  SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM counted
), gain AS (
  SELECT bucket, floor(1000 * ln((c.t + 1.0::DOUBLE) * (total.s + 10000) / ((c.s + 1.0::DOUBLE) * (total.t + 10000))))::BIGINT AS gain FROM counted c, total
), weighed AS (
  SELECT u.doc_id, count(*) AS n_features, floor(sum(g.gain)::DOUBLE / count(*))::BIGINT AS weight FROM used u JOIN gain g ON g.bucket = u.bucket WHERE u.target = 0 GROUP BY u.doc_id
), noised AS (
  SELECT doc_id, len(w) AS n_words, floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise FROM split WHERE target = 0
), scored AS (
  SELECT n.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + noise AS score, n_words >= 20 AS able
  FROM noised n LEFT JOIN weighed w ON w.doc_id = n.doc_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, 25 * count(*) OVER (PARTITION BY able) // 100 AS wanted FROM scored
)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN able AND place <= wanted THEN place END AS rank FROM placed"""
