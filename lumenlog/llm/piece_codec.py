"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here; normaliser, space marker, merges or unigram scores and byte
fallback are rebuilt from it. Batches are encoded by the library's threads. Ids are held
against the sentencepiece library; where they differ the row says so and carries the library's
ids, so the result is right either way.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm import piece_model as pm
from lumenlog.llm.common import slices, texts_of

WORD = re.compile("\n| *[^ \n]+| +")
SCHEMA = "doc_id long, n_tokens long, token_ids array<int>, parity boolean, round_trip boolean"


def build_tokenizer(model: pm.PieceModel):
    """A tokenizers pipeline that encodes and decodes as the model file says."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.model_type == pm.BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        plain = {p for p, _, kind in model.pieces if kind == pm.NORMAL}
        merges = []
        for p, score, kind in model.pieces:
            if kind == pm.NORMAL:
                # of equal scores (runs of spaces share one) the library takes the leftmost pair: there the left part has grown longest
                merges += [(-score, -i, vocab[p], p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in plain and p[i:] in plain]
        merges.sort()
        core = models.BPE(
            vocab=vocab, merges=[m[3:] for m in merges], unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback
        )
    elif model.model_type == pm.UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE piece models are supported")
    tok = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(pm.SPACE))
    steps.append(normalizers.Replace(" ", pm.SPACE))
    tok.normalizer = normalizers.Sequence(steps)
    if model.marker_leads:  # words become cacheable; no piece crosses these cuts
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{pm.SPACE}+[^{pm.SPACE}]*"), "isolated")
    tok.decoder = decoders.Sequence(
        [decoders.Replace(pm.SPACE, " "), decoders.ByteFallback(), decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else [])
    )
    return tok


class BatchCodec:
    """Encodes batches of texts and holds the ids against the sentencepiece library.

    Words recur, so where no piece crosses a word start or a line feed (checked on the model) the
    distinct words of a batch are encoded once, packed into lines; every word's ids and decoded form
    are verified, and one document in ``whole_every`` is verified whole besides. Other models are
    encoded and verified document by document.
    """

    def __init__(self, path: str, threads: int, whole_every: int = 16):
        import sentencepiece

        self.model, self.threads, self.whole_every = pm.load_model(path), threads, whole_every
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.plain = not m.charsmap and not m.remove_extra_whitespaces and m.add_dummy_prefix
        feed = [i for i, (p, _, kind) in enumerate(m.pieces) if kind == pm.BYTE and p == "<0x0A>"]
        self.by_word = self.plain and m.marker_leads and bool(feed) and m.model_type == pm.BPE
        self.by_word &= not any("\n" in p for p, _, _ in m.pieces)
        self.feed = feed[0] if feed else None
        self.tok = build_tokenizer(m)
        if self.by_word:  # texts and words reach the model with their markers set here
            from tokenizers import decoders, normalizers, pre_tokenizers

            self.tok.normalizer = normalizers.Sequence([])
            self.tok.pre_tokenizer = pre_tokenizers.Sequence([])
            self.tok.decoder = decoders.Sequence([decoders.Replace(pm.SPACE, " "), decoders.ByteFallback(), decoders.Fuse()])

    def whole(self, texts: list[str]) -> tuple[list[list[int]], list[bool], list[bool]]:
        """ids (the library's), parity and round trip of whole texts."""
        ready = [pm.SPACE + t.replace(" ", pm.SPACE) for t in texts] if self.by_word else texts
        ids = [e.ids if t else [] for e, t in zip(self.tok.encode_batch_fast(ready, add_special_tokens=False), texts, strict=True)]
        wanted = self.library.encode(texts, num_threads=self.threads)
        back = self.tok.decode_batch(wanted, skip_special_tokens=False)
        if self.by_word:
            back = [b.removeprefix(" ") for b in back]
        plain = [t.replace(pm.SPACE, " ") if self.plain else self.library.decode(w) for t, w in zip(texts, wanted, strict=True)]
        return wanted, [a == b for a, b in zip(ids, wanted, strict=True)], [a == b for a, b in zip(back, plain, strict=True)]

    def _lines(self, words: list[str], encode) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and number of ids of each of ``words``, encoded as lines of some 256 words.

        Each line starts with a line feed, so a marker that the encoder puts in front stands alone and goes.
        """
        lines = ["\n" + "\n".join(words[i : i + 256]) + "\n" for i in range(0, len(words), 256)]
        arrays = [np.asarray(x, dtype=np.int32) for x in encode(lines)]
        flat = np.concatenate([np.zeros(0, dtype=np.int32), *(x[np.argmax(x == self.feed) + 1 :] for x in arrays)])
        ends = np.flatnonzero(flat == self.feed)
        assert len(ends) == len(words)
        return np.delete(flat, ends), np.diff(ends - np.arange(len(ends)), prepend=0)

    def encode(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        if not self.by_word:
            ids, same, back = self.whole(texts)
            return pa.array(ids, pa.list_(pa.int32())), np.array(same, dtype=bool), np.array(back, dtype=bool)
        split = [WORD.findall(" " + t) if t else [] for t in (x.replace(pm.SPACE, " ") for x in texts)]
        n_words = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        coded = pa.array([w for x in split for w in x], pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        packed = ["" if w == "\n" else w.replace(" ", pm.SPACE) for w in distinct]
        got, got_sizes = self._lines(packed, lambda x: [e.ids for e in self.tok.encode_batch_fast(x, add_special_tokens=False)])
        flat, sizes = self._lines(packed, lambda x: self.library.encode(x, num_threads=self.threads))
        ends = np.cumsum(sizes)
        ok = sizes == got_sizes
        if ok.all():
            ok[np.searchsorted(ends, np.flatnonzero(got != flat), side="right")] = False
        else:
            got_ends = np.cumsum(got_sizes)
            ok &= [np.array_equal(flat[e - n : e], got[f - n : f]) for e, f, n in zip(ends, got_ends, sizes, strict=True)]
        for i in np.flatnonzero([w == "\n" for w in distinct]):
            flat, sizes[i] = np.insert(flat, ends[i], self.feed), 1
        ends = np.cumsum(sizes)
        listed = flat.tolist()
        word_ids = [listed[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        decoded = self.tok.decode_batch(word_ids, skip_special_tokens=False)
        back = np.array([a == b for a, b in zip(decoded, distinct, strict=True)], dtype=bool)
        lengths = sizes
        table = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat, pa.int32()))
        index = coded.indices.to_numpy(zero_copy_only=False)
        flat = table.take(coded.indices).flatten()
        bounds = np.r_[0, np.cumsum(n_words)]
        token_ends = np.r_[0, np.cumsum(lengths[index])]
        ids = pa.ListArray.from_arrays(pa.array(token_ends[bounds], pa.int32()), flat)
        bad = lambda good: np.add.reduceat(np.r_[~good[index], 0], bounds[:-1]) * (n_words > 0) > 0 if len(index) else np.zeros(len(texts), bool)
        same, round_trip = ~bad(ok), ~bad(back)
        held = [i for i, t in enumerate(texts) if zlib.crc32(t.encode()) % self.whole_every == 0]
        if held:
            whole, _, back_whole = self.whole([texts[i] for i in held])
            for i, w, b in zip(held, whole, back_whole, strict=True):
                same[i] &= ids[i].as_py() == w
                round_trip[i] &= b
        if not same.all():  # the library's ids, whatever differed
            rows = ids.to_pylist()
            for i in np.flatnonzero(~same):
                rows[i] = self.library.encode(texts[i])
            ids = pa.array(rows, pa.list_(pa.int32()))
        return ids, same, round_trip


def encode_documents(docs: DataFrame, model_path: str | None = None, threads: int = 2) -> DataFrame:
    """doc_id, n_tokens, token_ids, parity (equal to the sentencepiece library), round_trip of every row.

    ``round_trip`` compares the decoded ids with the text as the model can give it back: the space
    marker itself reads back as a space, and whitespace that the model's normaliser removes is gone.
    Null and empty texts give no tokens. One output row per input row, whole texts.
    """
    path = model_path or pm.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        codec = BatchCodec(path, threads)
        for batch in slices(batches, "text", 4 << 20):
            ids, same, back = codec.encode(texts_of(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.list_value_length(ids).cast(pa.int64()), ids, pa.array(same, pa.bool_()), pa.array(back, pa.bool_())],
                names=["doc_id", "n_tokens", "token_ids", "parity", "round_trip"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def decode_documents(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id and text of ``encoded`` (doc_id, token_ids); null ids read as no text."""
    path = model_path or pm.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = build_tokenizer(pm.load_model(path))
        for batch in slices(batches, "token_ids", 4 << 20):
            ids = [i or [] for i in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tok.decode_batch(ids, skip_special_tokens=False), pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.col("token_ids").cast("array<int>").alias("token_ids")).mapInArrow(run, "doc_id long, text string")
