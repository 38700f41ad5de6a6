"""Periodic runs against all periods of all stretches."""

import hashlib
import random
import re
import zlib

import pytest

from lumenlog.llm import word_runs as W
from lumenlog.llm.common import table
from lumenlog.llm.queries import op13_word_runs


def brute_runs(words):
    """Maximal stretches of every period; a stretch belongs to its smallest one."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(24, 3 * q):
                found.setdefault((start, length), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = None
    for r in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in sorted(runs, key=lambda r: (r[0], r[2])))
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *four, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def random_text(rng):
    letters = "ab" if rng.random() < 0.5 else "abcde"
    out = []
    while len(out) < rng.randint(1, 300):
        unit = [rng.choice(letters) for _ in range(rng.choice([1, 1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 24, 31, 33, 40]))]
        if rng.random() < 0.3:  # a unit of units
            unit = unit * rng.randint(2, 5) + [rng.choice(letters)]
        out += unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))]
        out += [rng.choice(letters + "xyz") for _ in range(rng.randint(0, 3))]
    return out


def test_runs_against_all_periods():
    rng = random.Random(11)
    texts = [random_text(rng) for _ in range(600)]
    texts += [[], ["a"], ["a"] * 23, ["a"] * 24, ["a", "b"] * 12, ["a", "b"] * 11 + ["a"], ["a"] * 5000, [str(i) for i in range(100)] * 3]
    as_bytes = [[w.encode() for w in t] for t in texts]
    want = [sorted(brute_runs(t), key=lambda r: (r[0], r[2])) for t in texts]
    assert W.find_runs(as_bytes) == want  # a batch of texts at once
    assert [W.find_runs([t])[0] for t in as_bytes] == want
    periods = {q for t in want for _, _, q in t}
    assert {1, 2, 7, 8, 9, 15, 16, 17, 31, 33} <= periods and len(periods) > 40


def test_long_periodic_text_is_not_quadratic():
    words = [b"a"] * 300_000 + [str(i).encode() for i in range(20_000)] * 4
    assert W.find_runs([words])[0] == [(0, 300_000, 1), (300_000, 80_000, 20_000)]
    assert max(len(p) for _, p, _ in W.occurrences(W.numbered([words])[0])) < len(words)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [r for r in table(spark, sf, "documents").collect() if not r.text or len(r.text) < 3000]
    out = {r.doc_id: tuple(r)[1:] for r in op13_word_runs(spark, sf).collect()}
    assert len(out) == table(spark, sf, "documents").count() and len(docs) > 700
    assert all(out[r.doc_id] == brute_row(r.doc_id, r.text) for r in docs)
    assert sum(out[r.doc_id][0] > 0 for r in docs) > 50


@pytest.mark.parametrize("words", [["a"] * 24, ["x", "y", "z"] * 9])
def test_edges(spark, docs_of, words):
    text = " ".join(words)
    rows = [(1, None), (2, ""), (3, " \t\r\n"), (None, text), (4, text), (4, text), (5, "  ".join(words)), (6, "w " * 30_000), (10, text)]
    out = W.digest_runs(docs_of(rows)).collect()
    assert sorted(tuple(r)[1:] for r in out) == sorted(brute_row(-1 if i is None else i, t) for i, t in rows) and len(out) == len(rows)
    assert W.digest_runs(docs_of([])).collect() == []
    whole = {r.doc_id: r for r in W.periodic_runs(docs_of(rows)).collect()}
    assert whole[4].collapsed == " ".join(dict.fromkeys(words)) and whole[4].runs[0].length == len(words) and whole[1].runs == []
