"""Removal of repeated runs of lines, in DataFrame operations only.

The corpus is a sequence of line ids per document. Prefix doubling names every run of 2^k lines from
the names of its halves (equal names, equal runs), k up to the logarithm of the longest run looked at;
names are 64-bit hashes, so a round is a local step within each document and needs no global ranking.
Two overlapping names of 2^k lines name a run of any length m between 2^k and 2^(k+1): suffixes that
share it form the suffix array's interval of longest common prefix m or more, which is a group here.

A run counts when its lines have ``min_words`` words or more. Of every line the shortest such run that
starts there and the shortest that ends there are looked up: a line lies in some counting run that
occurs earlier exactly when one of these does, so maximal runs are covered whole. The first occurrence
(by document id, then place) stays; the lines of later ones go. Occurrences may overlap: of one line repeated
many times in sequence, the first is left. No line's content is lost: the first
occurrence of a line is in no later copy.

Only lines that occur twice or more take part; a document is cut into segments at the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.llm.common import stored

_CHECK_BITS = (1 << 36) - 1


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line that isn't blank: document key, place among those, place among all, two hashes, words."""
    numbered = F.filter(
        F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(i.alias("i"), line.alias("line"))),
        lambda x: F.replace(x["line"], F.lit(" "), F.lit("")) != "",
    )
    line = F.col("x.line")
    return (
        docs.where(F.col("text").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(numbered).alias("p", "x"))
        .select(
            "doc_id",
            "th",
            "p",
            F.col("x.i").alias("i"),
            F.xxhash64(line).alias("h"),
            F.xxhash64(F.lit("check"), line).bitwiseAND(F.lit(_CHECK_BITS)).alias("c"),
            (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("long").alias("w"),
        )
    )


def _repeated(lines: DataFrame) -> DataFrame:
    """Lines that occur at least twice. Counts are summed before the shuffle; a hot line is one row of the counts.

    The counts are stored, so that both sides of the join are plain shuffles whose hot partitions Spark can split.
    """
    counts = stored(lines.groupBy("h", "c").agg(F.count("*").alias("n")).where("n > 1").select("h", "c"), "line-counts")
    # identical document rows have the same key and are one document here
    return lines.join(counts, ["h", "c"], "left_semi").dropDuplicates(["doc_id", "th", "p"])


def _runs(lines: DataFrame, min_words: int) -> DataFrame:
    """The shortest counting run that starts, and that ends, at each line: key columns, place, lines covered."""
    by_doc = Window.partitionBy("doc_id", "th").orderBy("p")
    segment = Window.partitionBy("doc_id", "th", "seg").orderBy("p")
    named = (
        lines.withColumn("seg", F.col("p") - F.row_number().over(by_doc))
        .withColumn("n0", F.col("h"))
        .withColumn("words", F.sum("w").over(segment))
        .withColumn("checks", F.sum("c").over(segment))
    )
    levels = max(1, (max(1, min_words)).bit_length())
    for k in range(1, levels):
        half = 1 << (k - 1)
        other = F.lead(f"n{k - 1}", half).over(segment)
        named = named.withColumn(f"n{k}", F.when(other.isNotNull(), F.xxhash64(f"n{k - 1}", other)))
    names = [f"n{k}" for k in range(levels)]
    cell = F.struct(
        "i", (F.col("words") - F.col("w")).alias("before"), "words", (F.col("checks") - F.col("c")).alias("checks_before"), "checks", *names
    )
    span = max(0, min_words - 1)  # a line has a word at least
    framed = named.withColumn("ahead", F.collect_list(cell).over(segment.rowsBetween(0, span))).withColumn(
        "behind", F.collect_list(cell).over(segment.rowsBetween(-span, 0))
    )
    starts = F.size(F.filter("ahead", lambda x: x["words"] < F.col("words") - F.col("w") + min_words)) + 1
    ends = F.size(F.filter("behind", lambda x: F.col("words") - x["before"] < min_words)) + 1

    def run(side: str, m: Column, first: Column) -> Column:
        """The run of ``m`` lines from the ``first`` cell (from 1), null where the segment is too short."""
        cells = F.col(side)
        last = F.try_element_at(cells, first + m - 1)
        name = F.coalesce(
            *(
                F.when(
                    (m >= 1 << k) & (m < 2 << k),
                    F.struct(
                        F.try_element_at(cells, first)[f"n{k}"].alias("a"), F.try_element_at(cells, first + m - (1 << k))[f"n{k}"].alias("b")
                    ),
                )
                for k in range(levels)
            )
        )
        return F.when(
            m <= F.size(cells),
            F.struct(
                F.lit(side).alias("side"),
                m.alias("m"),
                name["a"].alias("a"),
                name["b"].alias("b"),
                (last["checks"] - F.try_element_at(cells, first)["checks_before"]).alias("check"),
                F.transform(F.slice(cells, F.greatest(first, F.lit(1)), m), lambda x: x["i"]).alias("covers"),
            ),
        )

    both = framed.withColumns({"m1": starts, "m2": ends}).select(
        "doc_id",
        "th",
        "p",
        F.array_compact(F.array(run("ahead", F.col("m1"), F.lit(1)), run("behind", F.col("m2"), F.size("behind") - F.col("m2") + 1))).alias("runs"),
    )
    return both.select("doc_id", "th", "p", F.explode("runs").alias("r")).select("doc_id", "th", "p", "r.*")


def repeated_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, th (hash of the text), removed (sorted places of the lines to delete, from 0), documents with any only."""
    lines = stored(_lines(docs), "lines")
    runs = stored(_runs(_repeated(lines), min_words), "runs")
    key = ["side", "m", "a", "b", "check"]
    first = runs.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "p")).alias("first")).where("n > 1").drop("n")
    first = stored(first, "first-runs")
    later = runs.join(first, key).where(~F.struct("doc_id", "th", "p").eqNullSafe(F.col("first")))
    return (
        later.select("doc_id", "th", F.explode("covers").alias("i"))
        .groupBy("doc_id", "th")
        .agg(F.array_sort(F.collect_set("i")).alias("removed"))
    )


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` without the lines of later copies of repeated runs, plus ``n_lines`` and ``n_removed``.

    Lines are what line feeds part; words are parted by spaces. Blank lines are in no run and stay. A null text
    stays null with no lines; a text whose lines all go is empty. Rows of the same id and text are one document:
    each gets the same result, and neither is the other's later copy. Null ids order first. Other columns stay;
    input columns ``n_lines`` and ``n_removed`` are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(*kept, F.xxhash64("text").alias("__th"))
    found = repeated_lines(docs.select("doc_id", "text"), min_words).select(
        F.col("doc_id").alias("__id"), F.col("th").alias("__key"), F.col("removed").alias("__removed")
    )
    joined = keyed.join(found, keyed["__th"].eqNullSafe(found["__key"]) & keyed["doc_id"].eqNullSafe(found["__id"]), "left")
    parts = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__removed"))
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: parts[i]), "\n"))
    columns = [text.alias("text") if c == "text" else F.col(c) for c in kept]
    return joined.select(
        *columns,
        F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias("n_removed"),
    )


ORACLE = """
WITH cut AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), line AS (
  SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
  FROM cut WHERE replace(line, ' ', '') <> ''
), summed AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM line
), run AS (
  SELECT 'a' AS side, a.doc_id, a.p AS lo, min(b.p) AS hi FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.s - a.s + a.w >= 50 GROUP BY ALL
  UNION ALL
  SELECT 'b', b.doc_id, max(a.p), b.p FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.s - a.s + a.w >= 50 GROUP BY b.doc_id, b.p
), text_of AS (
  SELECT r.side, r.doc_id, r.lo, r.hi, string_agg(l.line, chr(10) ORDER BY l.p) AS body
  FROM run r JOIN line l ON l.doc_id = r.doc_id AND l.p BETWEEN r.lo AND r.hi GROUP BY ALL
), later AS (
  SELECT doc_id, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY side, body ORDER BY doc_id, lo) AS n FROM text_of) WHERE n > 1
), gone AS (
  SELECT DISTINCT l.doc_id, l.i FROM later r JOIN line l ON l.doc_id = r.doc_id AND l.p BETWEEN r.lo AND r.hi
), built AS (
  SELECT c.doc_id, coalesce(string_agg(c.line, chr(10) ORDER BY c.i) FILTER (WHERE g.i IS NULL), '') AS text, count(*) AS n_lines, count(g.i) AS n_removed
  FROM cut c LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.i = c.i GROUP BY c.doc_id
)
SELECT d.doc_id, b.text, coalesce(b.n_lines, 0) AS n_lines, coalesce(b.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN built b ON b.doc_id = d.doc_id
"""
