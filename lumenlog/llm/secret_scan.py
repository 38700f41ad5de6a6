"""Secrets by fixed patterns and a linear-chain conditional random field.

Each line is a sequence of whitespace-separated tokens, tagged outside, begin or inside of a secret. A
token's score is the sum of what its own shape and word, its neighbours' and the file's features weigh;
the best tags come from Viterbi. The model is trained here, on a bounded sample of documents whose
pattern matches serve as labels. The patterns' spans always stay; the tagger adds spans elsewhere.

Tokens of one shape share their scores, so a batch scores its distinct tokens only. A line in which no
token can gain from any tag but outside, whatever its neighbours' tags, has the all-outside path as its
best and needs no decoding; that bound is exact.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import slices, texts_of
from lumenlog.plans.ranks import first_n_per_group

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so this is the leftmost run of 32 and more
KINDS = ("assign", "access", "hex", "crf")
_KEYWORDS = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
_IMPOSSIBLE = -1e4
_TOKEN = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_NAME = re.compile(r"""[A-Za-z_-]+["']?[:=]["']?(?=.)""")
_WIDTH = 1 << 15
TRAINED_TOKENS = 400
_HASHES = 1 << 63


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind's place in the list, end, start of the value), in that order. Spans are whole matches."""
    spans = []
    if _KEYWORDS.search(text):
        spans += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(spans)


def shape(token: str) -> str:
    """Letters, digits and marks in runs: ``pass=ab12`` is ``x=x9``."""
    out = []
    for c in token[:64]:
        k = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def _plain(token: str) -> str | None:
    """The shape of a word in letters with at most one mark behind it, found fast."""
    body = token if token.isalpha() else token[:-1]
    if not body.isalpha() or len(token) - len(body) > 1:
        return None
    kind = "x" if body.islower() else "X" if body.isupper() else "Xx"
    return kind + token[len(body) :]


def own_features(token: str) -> list[str]:
    core = token.strip("\"'.,;()[]{}<>")
    value = core[m.end() :] if (m := _NAME.match(core)) else core
    n = len(value)
    freq = Counter(value)
    entropy = -sum(v / n * math.log2(v / n) for v in freq.values()) if n else 0.0
    digits = sum(c.isdigit() for c in value)
    return [
        f"w={token.lower()[:40]}", f"s={shape(token)[:12]}", f"n={min(n // 4, 12)}", f"e={int(entropy * 2)}", f"d={round(4 * digits / n) if n else 0}",
        f"hex={bool(n >= 16 and re.fullmatch('[0-9a-f]+', value))}", f"up={bool(n >= 16 and re.fullmatch('[A-Z0-9]+', value))}",
        f"mix={any(c.isupper() for c in value)}{any(c.islower() for c in value)}{digits > 0}",
        f"name={core[: m.end()].lower()[:24] if m else ''}", f"quoted={token[:1] in '\"' + chr(39)}", f"other={len(set(re.sub('[A-Za-z0-9]', '', value))) > 1}",
    ]


def near_features(token: str) -> list[str]:
    plain = _plain(token)
    return [f"w={token.lower()[:40]}", f"s={(plain or shape(token))[:8]}"]


def file_features(text: str) -> list[str]:
    n = max(1, len(text))
    lines = text.count("\n") + 1
    marks = sum(map(text.count, "={}[]();\"'"))
    return [f"f.lines={lines.bit_length()}", f"f.width={(n // lines).bit_length()}", f"f.marks={min(8, 200 * marks // n)}", f"f.long={n.bit_length()}"]


def _slots(space: str, features: list[str]) -> list[int]:
    return [zlib.crc32(f"{space}{f}".encode()) % _WIDTH for f in features]


class Tagger:
    """Weights of the features (hashed) and of tag transitions."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray, start: np.ndarray, words: set[str]):
        self.weights, self.transitions, self.start, self.words = weights, transitions, start, words
        # what a token that isn't outside can gain at most through the two transitions it touches
        self.gain = 2 * float(max((transitions - transitions[OUTSIDE, OUTSIDE]).max(), (start - start[OUTSIDE]).max(), 0.0))
        self.seen: dict[str, np.ndarray] = {}

    def _vectors(self, token: str) -> np.ndarray:
        """Scores of the token itself and as the neighbour before and behind: (3, 3)."""
        near = near_features(token)
        return np.stack([self.weights[_slots(s, f)].sum(0) for s, f in (("o", own_features(token)), ("p", near), ("n", near))])

    def table(self, tokens: list[str]) -> np.ndarray:
        """Scores of distinct tokens: (n, 3, 3). Words in letters the training has not seen share those of their shape and length."""
        out = np.empty((len(tokens), 3, 3), dtype=np.float32)
        seen = self.seen
        for i, token in enumerate(tokens):
            plain = None if token.lower() in self.words else _plain(token)
            key = f"{plain}\t{min(len(token), 24)}" if plain else token
            found = seen.get(key)
            if found is None:
                if len(seen) > 100_000:
                    seen.clear()
                found = seen[key] = self._vectors(unknown_word(plain, len(token)) if plain else token)
            out[i] = found
        return out

    def file(self, text: str) -> np.ndarray:
        return self.weights[_slots("f", file_features(text))].sum(0)

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        best = scores[0] + self.start
        back = np.zeros((len(scores), 3), dtype=np.int8)
        for t in range(1, len(scores)):
            step = best[:, None] + self.transitions
            back[t] = step.argmax(0)
            best = step.max(0) + scores[t]
        tags = np.zeros(len(scores), dtype=np.int8)
        tags[-1] = best.argmax()
        for t in range(len(scores) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags


def unknown_word(plain: str, length: int) -> str:
    """A stand-in of this shape and length that no lexicon holds."""
    mark = plain[-1] if not plain[-1].isalpha() else ""
    body = ("q" * max(1, min(length, 24) - len(mark)))
    return (body.upper() if plain.startswith("X") and "x" not in plain else body.capitalize() if plain.startswith("X") else body) + mark


def train(examples: list[tuple[list[str], list[int], list[str]]], epochs: int = 12, rate: float = 0.1, decay: float = 1e-4) -> Tagger | None:
    """Maximum likelihood by Adam on padded batches; (tokens, tags, file features) each. None without a positive example."""
    if not any(any(tags) for _, tags, _ in examples):
        return None
    words = {t.lower() for tokens, _, _ in examples for t in tokens if len(t) <= 40}
    common = Counter(t.lower() for tokens, tags, _ in examples if any(tags) for t in tokens)
    words = {w for w in words if common[w] >= 3}
    feats, tags, size = [], [], []
    for tokens, ys, doc in examples:
        shown = [t if t.lower() in words or _plain(t) is None else unknown_word(_plain(t), len(t)) for t in tokens]
        near = [near_features(t) for t in shown]
        own_doc = _slots("f", doc)
        for i, t in enumerate(shown):
            slots = _slots("o", own_features(t)) + own_doc
            slots += _slots("p", near[i - 1] if i else ["edge"]) + _slots("n", near[i + 1] if i + 1 < len(shown) else ["edge"])
            feats.append(slots)
        tags += ys
        size.append(len(tokens))
    width = max(map(len, feats))
    ids = np.array([f + [_WIDTH] * (width - len(f)) for f in feats])
    y, starts = np.array(tags), np.r_[0, np.cumsum(size)]
    weights, trans, start = np.zeros((_WIDTH + 1, 3)), np.zeros((3, 3)), np.zeros(3)
    trans[OUTSIDE, INSIDE] = start[INSIDE] = _IMPOSSIBLE
    state = [[np.zeros_like(a), np.zeros_like(a)] for a in (weights, trans, start)]
    order, step = np.argsort(size, kind="stable"), 0
    groups = [order[i : i + 256] for i in range(0, len(order), 256)]
    for epoch in range(epochs):
        for g in groups:
            step += 1
            n = np.array(size)[g]
            length = int(n.max())
            place = starts[g][:, None] + np.minimum(np.arange(length), n[:, None] - 1)
            mask = np.arange(length) < n[:, None]
            e = weights[ids[place]].sum(2)
            a = np.zeros_like(e)
            a[:, 0] = start + e[:, 0]
            for t in range(1, length):
                m = a[:, t - 1, :, None] + trans
                top = m.max(1)
                new = top + np.log(np.exp(m - top[:, None]).sum(1)) + e[:, t]
                a[:, t] = np.where(mask[:, t, None], new, a[:, t - 1])
            top = a[:, -1].max(1)
            z = top + np.log(np.exp(a[:, -1] - top[:, None]).sum(1))
            b = np.zeros_like(e)
            for t in range(length - 2, -1, -1):
                m = trans + (e[:, t + 1] + b[:, t + 1])[:, None]
                top = m.max(2)
                new = top + np.log(np.exp(m - top[..., None]).sum(2))
                b[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
            p = np.exp(a + b - z[:, None, None]) * mask[..., None]
            gold = y[place]
            d = p.copy()
            np.put_along_axis(d, gold[..., None], np.take_along_axis(d, gold[..., None], 2) - mask[..., None], 2)
            grad_w = np.zeros_like(weights)
            rows = ids[place][mask]
            for k in range(3):
                grad_w[:, k] = np.bincount(rows.ravel(), np.repeat(d[mask][:, k], width), _WIDTH + 1)
            pair = np.exp(a[:, :-1, :, None] + trans + (e[:, 1:] + b[:, 1:])[:, :, None] - z[:, None, None, None]) * mask[:, 1:, None, None]
            grad_t = pair.sum((0, 1))
            np.add.at(grad_t, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), -1)
            grad_s = d[:, 0].sum(0)
            grads = (grad_w / len(g) + decay * weights, grad_t / len(g), grad_s / len(g))
            for value, grad, (first, second) in zip((weights, trans, start), grads, state, strict=True):
                first += 0.1 * (grad - first)
                second += 0.01 * (grad * grad - second)
                value -= rate / (1 + epoch / 8) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
            weights[_WIDTH] = 0
            trans[OUTSIDE, INSIDE] = start[INSIDE] = _IMPOSSIBLE
    return Tagger(weights[:_WIDTH].astype(np.float32), trans.astype(np.float32), start.astype(np.float32), words)


def _examples(text: str) -> Iterator[tuple[list[str], list[int], list[str]]]:
    """Labelled lines: all with a match, half of those with long tokens that have digits, a few of the rest.

    A training line is its first ``TRAINED_TOKENS`` tokens; scanning takes lines whole.
    """
    spans, at, doc = base_spans(text), 0, None
    for line in text.split("\n"):
        here = [(s[3] - at, s[2] - at) for s in spans if at <= s[3] < at + len(line)]
        pick = zlib.crc32(line.encode())
        if here or (pick % 2 == 0 and re.search(r"\S*\d\S{7}", line)) or pick % 150 == 0:
            tokens, tags = [], []
            for m in list(_TOKEN.finditer(line))[:TRAINED_TOKENS]:
                hit = [k for k, (s, e) in enumerate(here) if s < m.end() and e > m.start()]
                begun = any(here[k][0] >= m.start() for k in hit)
                tokens.append(m.group())
                tags.append(OUTSIDE if not hit else BEGIN if begun or not tags or tags[-1] == OUTSIDE else INSIDE)
            doc = doc or file_features(text)
            if tokens:
                yield tokens, tags, doc
            if here:  # again without the words around, so that the shape alone counts too
                yield [t if tag else unknown_word("x", len(t)) for t, tag in zip(tokens, tags, strict=True)], tags, doc
        at += len(line) + 1


def sample_bound(total: int, sample_docs: int) -> int:
    """The hash below which about ``sample_docs`` of ``total`` documents lie, of hashes from 0 to 2^63 - 1; at least one hash."""
    return min(_HASHES - 1, max(1, _HASHES * sample_docs // max(1, total)))


def learn_tagger(docs: DataFrame, sample_docs: int = 20_000, max_examples: int = 3_000, total: int | None = None) -> Tagger | None:
    """Train on lines of about ``sample_docs`` documents, picked by a hash of their text out of ``total`` (counted if not given).

    Taken are distinct examples, at most half of ``max_examples`` with a secret and as many without, those of the
    smallest hashes: copies and a source full of secrets leave no class without examples. Null and empty texts give
    none; without an example of a secret there is no tagger (None).
    """
    bound = sample_bound(docs.count() if total is None else total, sample_docs)
    picked = docs.where(F.shiftrightunsigned(F.xxhash64("text"), 1) < F.lit(bound)).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [x for t in texts_of(batch) for x in _examples(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string())))],
                names=["tokens", "tags", "doc"],
            )

    found = picked.mapInArrow(run, "tokens array<string>, tags array<int>, doc array<string>")
    found = found.distinct().withColumn("secret", F.array_max("tags") > 0)
    best = first_n_per_group(found, ["secret"], [F.xxhash64("tokens", "doc"), F.col("tokens"), F.col("tags"), F.col("doc")], max_examples // 2)
    return train(sorted((list(r["tokens"]), list(r["tags"]), list(r["doc"])) for r in best.collect()))


def _tagged_lines(tagger: Tagger, texts: list[str]) -> dict[int, list[tuple[int, np.ndarray]]]:
    """Of each document with any, its lines (by number) that have other tags than outside."""
    column = pa.array(texts, pa.large_string())
    lines = pc.split_pattern(column, "\n")
    doc_of_line = np.repeat(np.arange(len(texts)), pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64))
    tokens = pc.ascii_split_whitespace(lines.flatten())
    line_of = np.repeat(np.arange(len(doc_of_line)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64))
    flat = tokens.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    line_of = line_of[full.to_numpy(zero_copy_only=False)]
    coded = flat.filter(full).dictionary_encode()
    if not len(coded):
        return {}
    word = coded.indices.to_numpy(zero_copy_only=False)
    table = tagger.table(coded.dictionary.to_pylist())
    edge = [tagger.weights[_slots(s, ["edge"])].sum(0) for s in "pn"]
    scores = table[word, 0]
    joined = line_of[1:] == line_of[:-1]
    before = np.where(joined[:, None], table[word[:-1], 1], edge[0])
    behind = np.where(joined[:, None], table[word[1:], 2], edge[1])
    scores[1:] += before
    scores[0] += edge[0]
    scores[:-1] += behind
    scores[-1] += edge[1]
    scores += np.stack([tagger.file(t) for t in texts])[doc_of_line[line_of]]
    worth = np.maximum(scores[:, BEGIN], scores[:, INSIDE]) - scores[:, OUTSIDE] + tagger.gain >= 0
    found: dict[int, list[tuple[int, np.ndarray]]] = {}
    first_line = np.searchsorted(doc_of_line, np.arange(len(texts)))
    for line in np.unique(line_of[worth]):
        start, end = np.searchsorted(line_of, [line, line + 1])
        tags = tagger.viterbi(scores[start:end])
        if tags.any():
            doc = int(doc_of_line[line])
            found.setdefault(doc, []).append((int(line - first_line[doc]), tags))
    return found


def added_spans(text: str, lines: list[tuple[int, np.ndarray]], base: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans of tagged tokens that meet no base span: without name, quotes and closing marks, eight characters at least."""
    wanted, out, at = dict(lines), [], 0
    for number, line in enumerate(text.split("\n")):
        if number in wanted:
            open_ = None
            places = [(m.start(), m.end()) for m in _TOKEN.finditer(line)]
            runs = []
            for tag, (s, e) in zip(wanted[number], places, strict=True):
                if tag == BEGIN:
                    runs.append([s, e])
                elif tag == INSIDE:
                    runs[-1][1] = e
            for s, e in runs:
                raw = line[s:e]
                s += len(raw) - len(raw.lstrip("\"'([{<"))
                e -= len(raw) - len(raw.rstrip("\"')]}>,;."))
                if open_ := _NAME.match(line[s:e]):
                    s += open_.end()
                if e - s >= 8 and not any(b[0] < at + e and at + s < b[2] for b in base):
                    out.append((at + s, 3, at + e, at + s))
        at += len(line) + 1
    return out


def scan_secrets(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """Spans of every row: doc_id, spans array<struct<kind,start,end>> by start, then kind as listed.

    Starts and ends are code points, ends exclusive. Null and empty texts have none; each row gives one row.
    """
    schema = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 6 << 20):
            texts = texts_of(batch)
            tagged = _tagged_lines(tagger, texts) if tagger else {}
            rows = []
            for i, text in enumerate(texts):
                spans = base_spans(text)
                if i in tagged:
                    spans = sorted(spans + added_spans(text, tagged[i], spans))
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e, _ in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digest_spans(found: DataFrame) -> DataFrame:
    """Counts and text forms of :func:`scan_secrets` rows; spans arrive sorted."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id",
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        number("crf").alias("n_crf"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
