"""The near-copy stage of the pipeline takes pairs at a similarity of 0.8 and more."""

import itertools
import random
import re

import corpus_pipeline
from lumenlog.llm import near_dups as N


def survivors(rows, percent):
    """Ids of the documents that stay, by all pairs."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"\S+", t.lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i for i in sets if find(i) == i}


def pairs_between(low, high, n=60, seed=4):
    """Pairs of documents whose similarity is between the two percentages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    while len(rows) < 2 * n:
        a = [word() for _ in range(rng.randint(60, 160))]
        b = list(a)
        for at in rng.sample(range(len(b)), rng.randint(1, 4)):
            b[at] = word()
        x, y = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (a, b))
        if low <= 100 * len(x & y) / len(x | y) < high:
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    return rows


def test_stage_joins_from_eighty_percent(spark, docs_of, sf_dir):
    rows = pairs_between(80, 85) + [(1000 + i, t) for i, t in pairs_between(74, 80, seed=5)]
    out = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs_of(rows), sf_dir).collect()}
    assert out == survivors(rows, 80) and len(out) == 180


def test_trees_by_threshold():
    assert (N.trees_for(0.85), N.trees_for(0.8)) == (12, 15)
    assert all((1 - t * t) ** N.trees_for(t) <= N.MISS for t in (0.8, 0.85, 0.9))


def test_stage_on_documents(spark, sf_dir):
    from lumenlog.llm.common import table

    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["doc_id"])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    empty = {i for i, t in rows if not t.strip()}
    out = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()}
    assert out == survivors(rows, 80) | empty
