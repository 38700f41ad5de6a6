import itertools
import random
import re

import pytest

from lumenlog.llm import near_dups as N
from lumenlog.llm.common import table


def brute(rows):
    """(n_shingles, component) of each id, by all pairs."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_first = sorted(sets)
    for a, b in itertools.combinations(by_first, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= 85 * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= 85 * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def made(n=90, length=80, seed=1):
    """A family whose members are up to 12 changes from the base, and strangers; many pairs are near the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(length)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w) if i % 3 else " ".join(word() for _ in range(rng.randint(1, 60)))))
    rows += [(n, rows[1][1]), (n + 1, rows[1][1].upper()), (n + 2, None), (n + 3, ""), (n + 4, " \t\n"), (n + 5, "one two"), (n + 6, "ONE  two")]
    return rows


def check(out, rows):
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want and len(out) == len(rows)
    assert all(r.kept == (r.component_id == r.doc_id) for r in out)


def test_all_links(spark, docs_of):
    rows = made()
    check(N.find_near_duplicates(docs_of(rows)).collect(), rows)


def test_large_nodes_branch(spark, docs_of, monkeypatch):
    """With room for eight classes a node, the family has to descend; and with no depth left, to be compared in blocks."""
    rows = made(120, seed=2)
    monkeypatch.setattr(N, "NODE", 8)
    monkeypatch.setattr(N, "MAX_DEPTH", 3)
    monkeypatch.setattr(N, "BLOCK", 8)
    check(N.find_near_duplicates(docs_of(rows)).collect(), rows)


def test_query_against_sql(spark, sf_dir):
    from lumenlog.llm.queries import ORACLES, op3_near_dups
    from tools.check_oracles import compare, connect

    verdict = compare(op3_near_dups(spark, sf_dir), connect(sf_dir), ORACLES["op3_near_dups"])
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict


def test_query_on_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    check(N.find_near_duplicates(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_ids_and_copies(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, "alone " * 9), (7, text), (7, "other " + " ".join("abcdefghij")), (3, text + " x"), (9, text), (9, text), (4, None), (4, None), (5, "last one of all"), (5, "last one of all")]
    out = N.find_near_duplicates(docs_of(rows)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in out) == [(-1, -1), (-1, 3), (3, 3), (4, 4), (4, 4), (5, 5), (5, 5), (7, 3), (7, 7), (9, 3), (9, 3)]
    kept = N.keep_one(docs_of(rows))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 4, 4, 5, 7] and kept.columns == docs_of(rows).columns
    assert N.find_near_duplicates(docs_of([])).collect() == []


def test_components(spark):
    chain = [(f"{i:04d}".encode(), f"{i + 1:04d}".encode()) for i in range(200)]
    edges = spark.createDataFrame(chain + [(b"x", b"y"), (b"y", b"z"), (b"x", b"z")], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in N.components(edges).collect()}
    assert set(got.values()) == {b"0000", b"x"} and len(got) == 204


@pytest.mark.parametrize("n", [1, 4, 5, 600, 1300])
def test_minwise_estimates(n):
    import numpy as np

    x = N._mixed(np.arange(n, dtype=np.uint64))
    y = N._mixed(np.arange(n // 10, n + n // 10, dtype=np.uint64))
    want = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((N.minwise(x) == N.minwise(y)).mean() - want) < 0.17
