"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm import chat_windows, decontamination, gray_index, importance_sample, language_id, line_dedup, near_dups, page_text, piece_codec, posting_ann, secret_scan, token_counts, word_runs
from lumenlog.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.digest_spans(secret_scan.scan_secrets(docs, secret_scan.learn_tagger(docs)))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query
def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(table(spark, sf_dir, "documents"))


@query
def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dups.find_near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_main_text(table(spark, sf_dir, "pages"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_posting_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


@query
def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    return chat_windows.digest_windows(chat_windows.format_windows(turns))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


@query
def op11_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_importance_sample"] = importance_sample.ORACLE


@query
def op12_simhash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gray_index.find_similar(table(spark, sf_dir, "documents"))


@query
def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.digest_runs(table(spark, sf_dir, "documents"))


ORACLES["op13_word_runs"] = word_runs.ORACLE
ORACLES["op9_line_dedup"] = line_dedup.ORACLE.strip()


# All pairs that share a shingle, and everything they reach.
ORACLES["op3_near_dups"] = r"""WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM words
), size AS (
  SELECT w.doc_id, count(s.g) AS n FROM words w LEFT JOIN shingle s ON s.doc_id = w.doc_id GROUP BY 1
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM size UNION SELECT l.b, r.root FROM reach r JOIN link l ON l.a = r.node
)
SELECT r.node AS doc_id, s.n AS n_shingles, min(r.root) AS component_id, min(r.root) = r.node AS kept
FROM reach r JOIN size s ON s.doc_id = r.node GROUP BY r.node, s.n"""
