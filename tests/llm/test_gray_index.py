"""SimHash components against all pairs of fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash

from lumenlog.llm import gray_index as G
from lumenlog.llm.common import table
from lumenlog.llm.queries import op12_simhash_index


def print_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute(codes):
    """The smallest position that links connect each position to."""
    codes = np.array(codes, dtype=np.uint64)
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= 4).tolist():
            a, b = find(i), find(i + 1 + j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def clouds(rng, n):
    """Distinct codes: some far from all, some a few bits from another."""
    out = [rng.getrandbits(64) for _ in range(n // 4)] + [0, (1 << 64) - 1]
    while len(set(out)) < n:
        code = rng.choice(out)
        for b in rng.sample(range(64), rng.randint(1, 9)):
            code ^= 1 << b
        out.append(code)
    return sorted(set(out))


@pytest.mark.parametrize("leaf", [1024, 8])
def test_components_of_codes(spark, leaf):
    rng = random.Random(leaf)
    codes = clouds(rng, 1500)
    signed = np.array(codes, dtype=np.uint64).view(np.int64).tolist()
    links = [(r.a, r.b) for r in G.code_links(spark.createDataFrame([(c,) for c in signed], "code long"), leaf).collect()]
    assert all(((a ^ b) & (1 << 64) - 1) and a in set(signed) and b in set(signed) for a, b in links)
    place, root = {c: i for i, c in enumerate(signed)}, list(range(len(signed)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(place[a]), find(place[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(signed))] == brute(codes)


def test_index_gives_all_pairs_of_a_node(monkeypatch):
    """Nodes of any size, also above the widest level, and however few pairs are in memory."""
    rng = random.Random(9)
    nodes = [clouds(rng, n) for n in (8, 17, 300, 1100)] + [[5], [rng.getrandbits(64)]]
    nodes = [np.array(n, dtype=np.uint64) for n in nodes]
    nodes = [n[np.argsort(G.gray_rank(n))] for n in nodes]
    codes, firsts = np.concatenate(nodes), np.cumsum([0, *map(len, nodes)])[:-1]
    want = {(f + i, f + int(j)) for f, n in zip(firsts.tolist(), nodes, strict=True) for i in range(len(n)) for j in np.flatnonzero(np.bitwise_count(n ^ n[i]) <= 4) if j > i}
    for pairs in (1, 5000, 1 << 21):
        monkeypatch.setattr(G, "PAIRS", pairs)
        got = [(int(a), int(b)) for i, j in G.GrayIndex(codes, firsts).links() for a, b in zip(i, j, strict=True)]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def test_gray_order_and_parts():
    rank = G.gray_rank(np.array([i ^ i >> 1 for i in range(1000)], dtype=np.uint64))
    assert rank.tolist() == list(range(1000))
    for free in ((1 << 64) - 1, 0xF0F0F0F0F0F0F0F0, 0b1011, 0):
        parts = G.parts_of(free)
        assert len(parts) == 5 and sum(parts) == free and all(a & b == 0 for a in parts for b in parts if a is not b)


def check(out, rows):
    codes = [print_of(t) for _, t in rows]
    root = brute(codes)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = [(i, f"{c:016x}", least.get(r)) for (i, _), c, r in zip(rows, codes, root, strict=True)]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_query_against_brute_force(spark, sf_dir):
    for sf in (sf_dir, "/root/testdata/sf0.01"):
        out = op12_simhash_index(spark, sf).collect()
        rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
        if sf == sf_dir:
            check(out, rows)
        assert len(out) == len(rows)
        codes = [int(r.fingerprint, 16) for r in sorted(out, key=lambda r: r.doc_id)]
        ids = sorted(r.doc_id for r in out)
        assert [ids[i] for i in brute(codes)] == [r.component_id for r in sorted(out, key=lambda r: r.doc_id)]


def test_edges(spark, docs_of):
    long = " ".join(f"w{i % 997}" for i in range(150_000))
    text = "The quick brown fox jumps over the lazy dog"
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, text), (6, text), (None, text.upper()), (None, "nothing else like it"), (9, long), (7, long + " end"), (8, "a b c")]
    check(G.find_similar(docs_of(rows)).collect(), rows)
    assert G.find_similar(docs_of([])).collect() == []


def test_hot_copies_and_many_nodes(spark, docs_of):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(200)]
    rows = [(i, " ".join(base)) for i in range(300)]
    for i in range(300, 900):
        changed = list(base)
        for at in rng.sample(range(200), rng.randint(1, 20)):
            changed[at] = rng.choice(words)
        rows.append((i, " ".join(changed)))
    check(G.find_similar(docs_of(rows), leaf=16).collect(), rows)
