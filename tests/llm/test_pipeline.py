"""The corpus pipeline, each stage against what its decision means on its own input."""

import re

import corpus_pipeline
from lumenlog.llm import decontamination
from lumenlog.llm.common import stored, table
from tests.llm.test_near_stage import survivors

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), name)
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert after.keys() <= before.keys() and out.count() == len(after)
        kept[name] = (before, after)
        if name != "piece_encoding":
            assert out.columns == columns
        docs = out
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    before, after = kept["language_id"]
    assert all(labels[i].quality == 0 for i in before.keys() - after.keys() if i in labels)  # good documents stay
    before, after = kept["line_dedup"]
    for i, r in before.items():
        left = after[i].text.split("\n") if i in after else []
        lines = iter(r.text.split("\n"))
        assert all(x in lines for x in left)  # lines go, none is changed or moved
        assert i not in after or after[i].n_chars == len(after[i].text)
    assert {x for r in before.values() for x in r.text.split("\n") if x.strip()} == {x for r in after.values() for x in r.text.split("\n") if x.strip()}
    before, after = kept["near_dedup"]
    assert after.keys() == survivors([(i, r.text) for i, r in before.items()], 80) and all(after[i] == before[i] for i in after)
    before, after = kept["decontamination"]
    items = [decontamination.normalise(r.text) for r in table(spark, SF, "benchmark").collect()]
    exact = {i for i, r in before.items() if any(x in decontamination.normalise(r.text) for x in items)}
    assert before.keys() - after.keys() >= exact and len(before) - len(after) <= 1.2 * len(exact)
    before, after = kept["piece_encoding"]
    assert before.keys() == after.keys() and all(r.parity and r.round_trip for r in after.values())


def test_run_gives_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "token_ids", "parity", "round_trip"] and out.count() > 100


def test_empty_and_odd_tables(spark, tmp_path, sf_dir):
    schema = table(spark, sf_dir, "documents").schema
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (None, "some words of text that are here for no reason", "en", "s", 46), (3, "1 2 3", "en", "s", 5)]
    for part in (rows, []):
        path = str(tmp_path / f"t{len(part)}")
        spark.createDataFrame(part, schema).write.parquet(f"{path}/documents.parquet")
        table(spark, sf_dir, "benchmark").write.parquet(f"{path}/benchmark.parquet")
        assert corpus_pipeline.run(spark, path).count() == (1 if part else 0)
    assert re.fullmatch("[a-z_]+", corpus_pipeline.STAGES[0][0])
