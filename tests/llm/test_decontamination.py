import random

from lumenlog.llm import decontamination as D
from lumenlog.llm.common import table
from lumenlog.llm.queries import op6_decontamination


def distance(pattern, text):
    """Least edit distance of the pattern to any substring, and its first end."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row), row.index(min(row))


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(400):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(1, 60)))
        want = distance(p, t)
        got = D.myers_search(D.pattern_masks(p), len(p), t, len(p) - 1)
        assert (got == want) if want[0] < len(p) else got is None


def test_every_passage_within_the_budget_is_found():
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    items = [(i, words(30)) for i in range(30)]
    block = D.ItemBlock(items, 0.1)
    for i, item in items:
        clean = D.normalise(item)
        k = len(clean) // 10
        assert k >= 9 and len(D.pieces(clean, k)) == k + 1
        changed = list(clean)
        for _ in range(k):
            at = rng.randrange(len(changed))
            changed[at : at + 1] = rng.choice([[], [rng.choice("xyz")], [changed[at], rng.choice("xyz")]])
        text = words(40) + "  " + "".join(changed).upper() + "\n" + words(40)
        hits = block.find(text)
        assert [h[0] for h in hits] == [i] and hits[0][1] <= k
        clean_text = D.normalise(text)
        assert distance(clean, clean_text[hits[0][2] : hits[0][3]])[0] == hits[0][1] == distance(clean, clean_text)[0]
    assert block.find(words(300)) == []


def test_places_of_all_edits():
    """Random items and edited copies in texts of few letters: the best distance of every item within its budget, and its first end."""
    rng = random.Random(3)
    found = 0
    for _ in range(150):
        letters = rng.choice(["ab", "abcd", "abcdefghijkl"])
        text = lambda n: "".join(rng.choice(letters) for _ in range(n))  # noqa: B023, E731
        rate = rng.choice([0.1, 0.2, 0.29])
        items = [(i, text(rng.randint(10, 70))) for i in range(4)]
        parts = []
        for _, item in items:
            out = list(item)
            for _ in range(rng.randint(0, int(len(item) * rate) + 2)):
                at = rng.randrange(len(out))
                out[at : at + 1] = rng.choice([[], [rng.choice(letters)], [out[at], rng.choice(letters)]])
            parts += [text(rng.randint(0, 30)), "".join(out)]
        doc = "".join(parts)
        hits = {h[0]: h[1:] for h in D.ItemBlock(items, rate).find(doc)}
        for i, item in items:
            k = int(len(item) * rate + 1e-9)
            best, end = distance(item, doc)
            if k and best <= k:
                assert hits[i][0] == best and hits[i][2] == end and distance(item, doc[hits[i][1] : end])[0] == best
                found += 1
            elif k:
                assert i not in hits
    assert found > 200


def test_query_against_brute_force(spark):
    """Every exact passage is found, at distance 0; every distance is that of the place it is given for."""
    sf = "/root/testdata/sf0.01"
    docs, items = table(spark, sf, "documents").collect(), table(spark, sf, "benchmark").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if d.text and D.normalise(i.text) in D.normalise(d.text)}
    out = op6_decontamination(spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in out if r.distance == 0} == want and len(want) > 10
    text = {d.doc_id: D.normalise(d.text) for d in docs}
    item = {i.item_id: D.normalise(i.text) for i in items}
    for r in out:
        assert distance(item[r.item_id], text[r.doc_id][r.start : r.end])[0] == r.distance


def test_blocks_and_edges(spark, docs_of):
    item = "What is the boiling point of water at sea level in degrees?"
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (5, "Yes"), (5, "Yes")], "item_id long, text string")
    rows = [(1, f"x {item.lower()}\n y"), (2, None), (3, ""), (None, item), (4, "yesterday eyes"), (5, "oh yes!"), (6, "water " * 20000 + item)]
    for block_bytes in (1 << 20, 40):
        out = D.find_contamination(docs_of(rows), bench, block_bytes=block_bytes).collect()
        assert sorted((r.doc_id or -1, r.item_id) for r in out) == [(-1, 1), (-1, 2), (1, 1), (1, 2), (5, 5), (6, 1), (6, 2)]
    assert D.find_contamination(docs_of(rows), bench.limit(0)).collect() == [] == D.find_contamination(docs_of([]), bench).collect()
    kept = D.remove_contaminated(docs_of(rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4] and kept.columns == docs_of(rows).columns
