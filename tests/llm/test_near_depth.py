"""Trees whose first nodes are too large to be compared at once."""

import numpy as np

from lumenlog.llm import near_dups as N


def test_survival_against_simulation():
    rng = np.random.default_rng(1)
    for threshold in (0.8, 0.85):
        alive = np.ones(40_000, dtype=np.int64)
        for depth in range(1, 7):
            tokens = alive + rng.binomial(alive, 1 / threshold - 1)
            alive = rng.binomial(tokens, threshold)
            assert abs((alive > 0).mean() - N.survival(threshold, depth)) < 0.015
        assert N.trees_for(threshold, 9) > 2 * N.trees_for(threshold) and N.survival(threshold, 0) == 1


def test_large_texts_are_compared_in_blocks(spark, docs_of, monkeypatch):
    """Nodes of few members, or whose texts alone are too much for one task, do not branch."""
    from tests.llm.test_near_dups import check, made

    rows = made(40, seed=6)
    monkeypatch.setattr(N, "NODE_SHINGLES", 300)
    monkeypatch.setattr(N, "MAX_DEPTH", 0)
    check(N.find_near_duplicates(docs_of(rows)).collect(), rows)
