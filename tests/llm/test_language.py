import zlib

from lumenlog.llm import language_id as L
from lumenlog.llm.common import table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = L.identify(docs).collect()
    assert len(out) == len(truth)
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.lang_pred in set(truth.values()) | {"und"} for r in out)


DICTIONARIES = {"en": b"the and of to in is was for with that this from " * 20, "de": b"der die und das ist nicht ein sich mit auch " * 20}


def test_edges(spark, docs_of):
    long = "the and of to in is was for with " * 9000
    rows = [(1, None), (2, ""), (3, "123 --- 456"), (4, "the and of with that this is from the and"), (4, "der die und das ist nicht ein sich mit"), (None, long), (5, "x")]
    docs = docs_of(rows).withColumnRenamed("spans", "score")  # a clashing column is replaced
    out = L.predict_language(docs, DICTIONARIES).collect()
    by = {(r.doc_id, r.text): r for r in out}
    assert len(out) == len(rows)
    for key in ((1, None), (2, ""), (3, "123 --- 456")):
        assert by[key].lang_pred == "und" and by[key].score == 0 and by[key].rejected
    assert by[(4, rows[3][1])].lang_pred == "en" and by[(4, rows[4][1])].lang_pred == "de" and by[(None, long)].lang_pred == "en"
    assert by[(5, "x")].lang_pred == "en" and not by[(5, "x")].rejected  # a tie: the first language; too short for a margin
    assert out[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score", "rejected"}


def test_narrow_margins_are_rejected(spark, docs_of):
    out = L.predict_language(docs_of([(1, "qx zv kj wq " * 60)]), {"aa": b"0123456789" * 30, "bb": b"9876543210" * 30}).collect()
    assert out[0].rejected and out[0].lang_pred == "aa"


def test_no_training_rows(spark, docs_of):
    assert L.learn_dictionaries(L.training_rows(docs_of([]))) == {}
    assert [(r.lang_pred, r.score) for r in L.identify(docs_of([(1, "words here")])).collect()] == [("und", 0.0)]


def test_chunks_are_whole():
    text = "word " * 1000 + "x" * 5000
    assert b"".join(L.chunks(text, 700)).decode() == text and max(map(len, L.chunks(text, 700))) <= 700


def test_signs_that_are_no_letters():
    model = L.CompressionClassifier(DICTIONARIES, 3, 1000)
    assert all(model.classify(t) == ("und", 0.0) for t in ("½", "²", "①", "Ⅷ", "٣", "_", "½ 12 ²\n")) and model.classify("ª")[0] != "und"


def test_copies_do_not_fill_a_dictionary(spark, docs_of, monkeypatch):
    rows = [(3 * i + 1, f"text number {i % 3 if i < 500 else i} of the language") for i in range(600)]
    docs = docs_of(rows).selectExpr("doc_id", "text", "CASE WHEN doc_id % 2 = 0 THEN 'aa' ELSE 'bb' END AS lang")
    out = L.learn_dictionaries(docs, sample_rows=20)
    assert {k: len(v.split(b"\n")) for k, v in out.items()} == {"aa": 20, "bb": 20}
    monkeypatch.setattr(L, "MAX_LANGUAGES", 1)
    assert list(L.learn_dictionaries(docs.where("lang = 'aa' OR doc_id < 600"))) == ["aa"]


def test_query_against_all_dictionaries_in_one_process(spark):
    """The same texts, learned and compressed here, give every prediction and score."""
    rows = table(spark, "/root/testdata/sf0.001", "documents").collect()
    taught = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang and r.text and any(map(str.isalpha, r.text))]
    model = L.CompressionClassifier(L.learn_dictionaries(L.training_rows(table(spark, "/root/testdata/sf0.001", "documents"))), 3, 1000)
    counts = {x: sum(r.lang == x for r in taught) for x in {r.lang for r in taught}}
    assert model.langs == sorted(counts, key=lambda x: (-counts[x], x))
    out = {r.doc_id: r for r in L.identify(table(spark, "/root/testdata/sf0.001", "documents")).collect()}
    for r in rows:
        text = (r.text or "").lower()
        if not any(map(str.isalpha, text)):
            assert (out[r.doc_id].lang_pred, out[r.doc_id].score) == ("und", 0.0)
            continue
        for compressors in (model.first, model.close):
            sizes = sorted((sum(len(c.compress(p)) - 8 for p in L.chunks(text, 1000)), i) for i, c in enumerate(compressors))
            lang, score = model.langs[sizes[0][1]], (sizes[1][0] - sizes[0][0]) / max(1, sizes[1][0])
            if score >= 0.03:
                break
        assert out[r.doc_id].lang_pred == lang and abs(out[r.doc_id].score - max(0.0, min(1.0, score))) < 1e-12
