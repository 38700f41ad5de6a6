"""Language identification by compression.

One zstandard raw-content dictionary per language is cut from a bounded sample of labelled rows.
A text is cut into chunks of some 1,000 characters at spaces; every chunk is compressed with every
dictionary, the sizes are summed, and the language with the smallest sum wins (ties: the one with
more training rows, then the smaller name). The relative gap to the runner-up is the score; a narrow gap is measured again at the strongest
level, and a text that then stays below ``min_margin`` is rejected. Case is folded.
Chunks keep the gap comparable: a long text would otherwise become its own dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenlog.llm.common import slices
from lumenlog.plans.ranks import first_n_per_group

UNDETERMINED = "und"
FRAME_BYTES = 8  # of a compressed chunk, whatever it holds
MAX_LANGUAGES = 512


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows whose crc32 of the id's decimal text is not 0 modulo 5, with text and language."""
    return docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learn_dictionaries(rows: DataFrame, dictionary_bytes: int = 110 << 10, sample_rows: int = 192, max_chars: int = 4000) -> dict[str, bytes]:
    """Raw-content dictionary per language, the language with most rows first.

    Bounded sample: of each language the ``sample_rows`` distinct texts of at most ``max_chars`` code points (of any
    length where a language has no shorter one) with the smallest text hash, cut to ``dictionary_bytes``. Of more
    than ``MAX_LANGUAGES`` languages those with the most rows are learned (ties: the smaller name), so the driver
    holds at most that many times ``sample_rows`` texts. No rows give no dictionary.
    """
    counted = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES)
    common = [r["lang"] for r in counted.collect()]
    if not common:
        return {}
    keyed = rows.where(F.col("lang").isin(common)).select(
        "lang", (F.length("text") > max_chars).alias("long"), F.xxhash64("text").alias("hash"), F.substring("text", 1, dictionary_bytes).alias("text")
    )
    # copies of one text must not fill a dictionary: distinct hashes are ranked, then their texts fetched
    ranked = first_n_per_group(keyed.select("lang", "long", "hash").distinct(), ["lang"], [F.col("long"), F.col("hash")], sample_rows)
    picked = keyed.join(F.broadcast(ranked), ["lang", "long", "hash"]).groupBy("lang", "rank").agg(F.min("text").alias("text"))
    found: dict[str, dict[str, None]] = {}
    for row in sorted(picked.toLocalIterator(), key=lambda r: (r["lang"], -r["rank"])):
        found.setdefault(row["lang"], {})[row["text"]] = None
    return {lang: "\n".join(found[lang]).lower().encode()[-dictionary_bytes:] for lang in common}


def chunks(text: str, size: int) -> list[bytes]:
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            space = text.rfind(" ", start + size // 2, end)
            end = space if space > 0 else end
        out.append(text[start:end].encode())
        start = end
    return out


class CompressionClassifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int, chunk: int, narrow: float = 0.03, close_level: int = 19):
        self.langs, self.chunk, self.narrow = list(dictionaries), chunk, narrow
        self.first, self.close = ([self._compressor(dictionaries[lang], n) for lang in self.langs] for n in (level, close_level))

    @staticmethod
    def _compressor(dictionary: bytes, level: int):
        import zstandard

        own = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)

    def _best(self, parts: list[bytes], compressors: list) -> tuple[str, float]:
        sizes = sorted((sum(len(c.compress(p)) for p in parts) - FRAME_BYTES * len(parts), i) for i, c in enumerate(compressors))
        lang = self.langs[sizes[0][1]]
        if len(sizes) == 1:
            return lang, 1.0
        return lang, max(0.0, min(1.0, (sizes[1][0] - sizes[0][0]) / max(1, sizes[1][0])))

    def classify(self, text: str | None) -> tuple[str, float]:
        """Language and score; ``und`` without a letter or without a learned language."""
        if not text or not any(map(str.isalpha, text)) or not self.langs:
            return UNDETERMINED, 0.0
        parts = chunks(text.lower(), self.chunk)
        lang, score = self._best(parts, self.first)
        return self._best(parts, self.close) if score < self.narrow else (lang, score)


def predict_language(docs: DataFrame, dictionaries: dict[str, bytes], level: int = 3, chunk: int = 1000, min_margin: float = 0.002, min_letters: int = 40) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; other columns stay (of the same names, the input's go).

    A null text, or one without a letter, is ``und`` with score 0 and rejected. A text whose score is below
    ``min_margin`` is rejected but keeps its best language, unless it has fewer than ``min_letters`` letters:
    such a text can't show a margin. Every row gives one row; texts are read whole.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    source = docs.select(*kept)
    schema = StructType(list(source.schema.fields)).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CompressionClassifier(dictionaries, level, chunk)
        for batch in slices(batches, "text", 8 << 20):
            texts = batch.column("text").to_pylist()
            found = [model.classify(t) for t in texts]
            rejected = [
                lang == UNDETERMINED or (score < min_margin and sum(map(str.isalpha, t)) >= min_letters) for (lang, score), t in zip(found, texts, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array(rejected, pa.bool_()),
                ],
                names=[*kept, "lang_pred", "score", "rejected"],
            )

    return source.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: learned on the rows not held out, predicted for every row."""
    dictionaries = learn_dictionaries(training_rows(docs))
    found = predict_language(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
