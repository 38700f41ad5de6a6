"""Token counts and the piece codec against the sentencepiece library."""

import random
import struct

import pyarrow.parquet as pq
import pytest
import sentencepiece

from lumenlog.llm import piece_codec, token_counts
from lumenlog.llm import piece_model as pm

EDGES = [
    "", " ", "   ", "a", "hello  world", " a\n\nb\t c", "ﬁ Ⅷ é a\xa0b　c", "<s> x", "x</s>y", "▁a ▁b", "a   ", "\n", "\n\n ", "   \n  x",
    "日本語\U0001f600", "<0x0A>", "aaaa" * 300, "=-" * 900 + "the" * 500, "ab\r\ncd\x0b", "é" * 700, "\x00x",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pm.default_path())


@pytest.fixture(scope="module")
def model():
    return pm.load_model(pm.default_path())


@pytest.fixture(scope="module")
def texts(sf_dir):
    real = pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()
    rng = random.Random(5)
    noise = ["".join(rng.choice("ab the▁ \n<>=é本\t") for _ in range(rng.randint(1, 400))) for _ in range(150)]
    return EDGES + noise + [t or "" for t in real]


def test_counts_equal_the_library(library, model, texts):
    merger = token_counts.RankMerger(model)
    assert merger.count_texts(texts) == [len(x) for x in library.encode(texts)]
    assert merger.count_texts(texts[:40]) == [len(x) for x in library.encode(texts[:40])]  # now from the cache


def test_heap_and_rounds_agree(model):
    merger = token_counts.RankMerger(model)
    rng = random.Random(3)
    words = ["▁" + "".join(rng.choice("thein ra".replace(" ", "")) for _ in range(rng.randint(2, 150))) for _ in range(60)]
    assert merger.count_all(words).tolist() == [merger._heap_count(w) for w in words]


def test_count_rows(spark, docs_of, library):
    rows = [(1, None), (1, ""), (None, "a b"), (2, "x y"), (2, "x y"), (3, "word " * 5000)]
    out = token_counts.count_tokens(docs_of(rows)).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in out) == sorted(
        (i or -1, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows
    )
    assert [r.over_limit for r in out if r.doc_id == 3] == [True]
    assert token_counts.count_tokens(docs_of([])).collect() == []


def test_encoding_equals_the_library(spark, docs_of, library, texts):
    out = piece_codec.encode_documents(docs_of(list(enumerate(texts)))).collect()
    assert all(r.parity and r.round_trip for r in out)
    want = library.encode(texts)
    assert all(r.token_ids == want[r.doc_id] and r.n_tokens == len(want[r.doc_id]) for r in out) and len(out) == len(texts)


def test_runs_of_spaces_are_at_parity(library):
    """The rebuilt tokenizer itself, without the library's ids to fall back on."""
    codec = piece_codec.BatchCodec(pm.default_path(), 1)
    runs = [" " * n for n in [*range(1, 140), 500, 999, 3000]]
    texts = [t for r in runs for t in (r, "a" + r + "b", r + "x", "x" + r, "if y:\n" + r + "return  z\n" + r[1:] + "w")]
    ids, same, back = codec.encode(texts)
    assert same.all() and back.all() and ids.to_pylist() == library.encode(texts)
    assert all(codec.whole(texts)[1])


def test_encode_and_decode_rows(spark, docs_of):
    encoded = piece_codec.encode_documents(docs_of([(1, None), (2, "a  b\n"), (None, "é"), (2, "a  b\n")]))
    back = {(r.doc_id, r.text) for r in piece_codec.decode_documents(encoded).collect()}
    assert back == {(1, ""), (2, "a  b\n"), (None, "é")}
    assert piece_codec.encode_documents(docs_of([])).collect() == []


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
            continue
        if isinstance(value, int):
            tag, body = number << 3, b""
        else:
            tag, body, value = number << 3 | 2, value, len(value)
        for n in (tag, value):
            while n > 127:
                out += bytes([n & 127 | 128])
                n >>= 7
            out += bytes([n])
        out += body
    return out


def test_unigram_models_are_rebuilt(tmp_path):
    """A hand-written unigram model with byte fallback: same ids from both libraries."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    words = {"▁": -3.0, "a": -4.0, "b": -4.5, "▁a": -3.5, "ab": -2.5, "▁ab": -2.0, "ba": -2.7, "▁the": -1.0, "th": -3.1, "e": -3.3, "the": -1.9}
    pieces += [(p, s, 1) for p, s in words.items()]
    data = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    data += _message((2, _message((3, 1), (35, 1))), (3, _message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    path = tmp_path / "uni.model"
    path.write_bytes(data)
    texts = ["ab ba", "the ab abab", "theta é", "a  b", "bbbaa the", ""]
    codec = piece_codec.BatchCodec(str(path), 1)
    ids, same, back = codec.encode(texts)
    assert same.all() and back.all()
    assert ids.to_pylist() == sentencepiece.SentencePieceProcessor(model_file=str(path)).encode(texts)
