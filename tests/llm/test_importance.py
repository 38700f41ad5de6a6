"""Importance resampling against counting feature by feature."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from lumenlog.llm import importance_sample as I
from lumenlog.llm.common import table
from lumenlog.llm.queries import op11_importance_sample


def features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(docs, targets):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in docs]), (t, targets)):
        for x in texts:
            counts.update(bucket(f) for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for i, x in docs:
        w, fs = features(x)
        gains = [math.floor(1000 * math.log((t[b] + 1.0) * (S + 10_000) / ((s[b] + 1.0) * (T + 10_000)))) for b in map(bucket, fs)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for place, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = place
    return sorted([r[:5] for r in rows], key=str)


def test_features_of_a_batch(monkeypatch):
    """Word by word as one by one, whatever the number of bytes at a time."""
    rng = random.Random(5)
    texts = ["", "x", "\x00", "É é\x00B", "a\x00b", "\x7f\x80 `{", *(" ".join(rng.choice(["ab", "Cd", "ü", "1", "-", "e\nf", "w" * 62, "v" * 63, "u" * 64, "t" * 200]) for _ in range(rng.randint(0, 30))) for _ in range(60))]
    want = Counter((i, zlib.crc32(f.encode()) % 10_000) for i, t in enumerate(texts) for f in features(t)[1])
    for size in (0, 1, 2, 7, 100_000):
        monkeypatch.setattr(I, "AT_ONCE", size)
        parts = list(I.feature_buckets(texts))
        assert Counter((i, b) for text, bucket, _ in parts for i, b in zip(text.tolist(), bucket.tolist(), strict=True)) == want
        assert Counter(i for text, _, n in parts for i in text[:n].tolist()) == Counter({i: len(features(t)[0]) for i, t in enumerate(texts) if features(t)[0]})


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    targets = [r.text for r in table(spark, sf_dir, "benchmark").collect()]
    out = op11_importance_sample(spark, sf_dir).collect()
    assert sorted(([*r] for r in out), key=str) == brute(docs, targets)
    able = sum(len(features(t)[0]) >= 20 for _, t in docs)
    assert sorted(r.rank for r in out if r.rank) == list(range(1, able // 4 + 1))


def test_edges(spark, docs_of):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "x1"]) for _ in range(n))
    long = text(60_000)
    rows = [(1, None), (2, ""), (3, "?!"), (4, text(19)), (5, text(20)), (None, text(40)), (None, text(40)), (6, long), *[(7, text(25))] * 2, *((i, text(30)) for i in range(8, 40))]
    for targets in (["alpha beta alpha", None, ""], [None], []):
        frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(targets)], "item_id long, text string, score string")
        out = I.resample(docs_of(rows).withColumnRenamed("spans", "score"), frame).collect()
        assert sorted(([*r] for r in out), key=str) == brute(rows, targets)
        assert I.resample(docs_of([]), frame).collect() == []


def test_draw_moves_towards_the_target(spark, docs_of):
    near = " ".join(f"topic{i % 7}" for i in range(40))
    far = " ".join(f"other{i % 7}" for i in range(40))
    rows = [(i, near if i % 4 == 0 else far) for i in range(2000)]
    frame = spark.createDataFrame([(1, near)], "item_id long, text string")
    drawn = [r.doc_id for r in I.resample(docs_of(rows), frame).collect() if r.rank]
    assert len(drawn) == 500 and sum(i % 4 == 0 for i in drawn) >= 375  # 125 without weights
