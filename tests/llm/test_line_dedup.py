import random

from lumenlog.llm import line_dedup as L
from lumenlog.llm.queries import ORACLES, op9_line_dedup
from tools.check_oracles import compare, connect


def brute(rows, min_words):
    """Lines in a run of min_words and more that stands earlier in (doc_id, place) order: every run of every document."""
    cut = {i: [(k, x) for k, x in enumerate(t.split("\n")) if x.replace(" ", "")] for i, t in rows if t is not None}
    places = {}
    for i in sorted(cut):
        lines = [x for _, x in cut[i]]
        for a in range(len(lines)):
            words = 0
            for b in range(a, len(lines)):
                words += lines[b].count(" ") + 1
                if words >= min_words:
                    places.setdefault(tuple(lines[a : b + 1]), []).append((i, a, b))
    gone = {(i, cut[i][p][0]) for runs in places.values() for i, a, b in runs[1:] for p in range(a, b + 1)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_random_runs(spark, docs_of):
    rng = random.Random(4)
    pool = ["".join(rng.choice("ab") for _ in range(2)) + " w" * n for n in range(5) for _ in range(3)] + ["", "  "]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) if rng.random() < 0.7 else f"only {i} {k}" for k in range(rng.randint(0, 25))]
        rows.append((i, "\n".join(lines)))
    rows += [(60, rows[3][1]), (61, rows[3][1] + "\n" + rows[4][1]), (62, None), (63, ""), (64, "aa\n" * 40)]
    for min_words in (1, 6, 13):
        out = L.dedup_lines(docs_of(rows), min_words).collect()
        assert {r.doc_id: r.text for r in out} == brute(rows, min_words) and len(out) == len(rows)


def test_edges(spark, docs_of):
    long = " ".join(["word"] * 60)
    rows = [(None, long), (1, long + "\nown line"), (1, "another text of the same id"), (2, long), (2, long), (3, None), (4, "x\n" * 3000 + long)]
    frame = docs_of(rows).withColumnRenamed("spans", "n_removed")
    out = L.dedup_lines(frame).collect()
    got = sorted((r.doc_id or -1, r.text, r.n_removed) for r in out if r.text is not None)
    # the null id comes first and stays; both equal rows of document 2 are one document; "x" runs repeat within document 4
    assert got[0] == (-1, long, 0) and (1, "own line", 1) in got and (1, "another text of the same id", 0) in got
    assert [g for g in got if g[0] == 2] == [(2, "", 1)] * 2
    assert got[-1][1:] == ("x", 3000)
    assert [(r.n_lines, r.n_removed) for r in out if r.doc_id == 3] == [(0, 0)]
    assert set(out[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_removed"}
    assert L.dedup_lines(docs_of([])).collect() == []


def test_query_against_sql(spark, sf_dir):
    verdict = compare(op9_line_dedup(spark, sf_dir), connect(sf_dir), ORACLES["op9_line_dedup"])
    assert verdict.startswith("ok"), verdict


def test_no_python_in_the_plan(spark, sf_dir):
    plan = op9_line_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
