"""The edit budget of op6 is the whole of floor(length * error rate)."""

import inspect
import random

from lumenlog.llm import decontamination as D


def edited(item, k, rng):
    """``item`` with k single edits, spread evenly, so that every piece but one is hit."""
    out = list(item)
    for at in sorted(rng.sample(range(0, len(item), 3), k), reverse=True):
        out[at : at + 1] = rng.choice([["#"], ["#", out[at]], []])
    return "".join(out)


def test_default_budget_is_the_error_rate(spark, docs_of):
    rng = random.Random(7)
    assert inspect.signature(D.find_contamination).parameters["error_rate"].default == 0.1
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)).replace(" ", "k")
    items = [(m, text(m)) for m in (12, 20, 23, 40, 81, 100, 113, 233, 394)]
    docs, edits = [], {}
    for m, item in items:
        edits[m] = m // 10
        docs.append((m, f"{text(60)} {edited(item, edits[m], rng)} {text(60)}"))
        docs.append((1000 + m, f"{text(60)} {text(m)} {text(60)}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {(r.doc_id, r.item_id): r.distance for r in D.find_contamination(docs_of(docs), bench).collect()}
    assert out.keys() == {(m, m) for m in edits} and all(out[m, m] <= edits[m] for m in edits)
    assert any(out[m, m] == edits[m] for m in (233, 394))
