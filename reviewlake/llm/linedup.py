"""Line dedup by site-relative frequency (DataFrame functions only).

Within each host, a line's frequency is the number of pages that contain it over the number of pages of the host. Lines
above ``ratio`` are boilerplate and dropped from the host's pages. Blank lines are neither counted nor dropped.

Frequencies are counted so that they tell the same on small hosts and large ones, with no least number of pages:

* A page that is published again under another address is one page: equal texts of a host count once. A copied page is
  no frame around anything, and would else make each of its lines frequent.
* A page is no evidence for its own lines: n of N pages are n - 1 of the N - 1 others. A host of unlike pages has no
  frequent line, however few they are.
* A line goes where the frequency is above the ratio with the given ``confidence``: where M others of which x have the
  line would come about with a probability of at most 1 - confidence if its true frequency were the ratio, by the
  Chernoff bound exp(-M * KL(x / M, ratio)). With confidence 0 the frequency itself is compared.

How it scales: only hashes are shuffled, those of a text's lines together, and once for equal texts, which meet before
the shuffle; then lines as partial counts, so a line or host that holds a third of all rows is no burden to one task.
A host has at most (mean lines per page) / ratio boilerplate lines, whatever its size, so one row per host carries them
back to the pages; Spark broadcasts that staged table only where its size is below the session's threshold, and else
joins by host, splitting large hosts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BLANK = " \t\n\x0b\x0c\r"
RATIO, CONFIDENCE = 0.01, 0.995

def _key(host: Column) -> Column:
    """Never null: pages without a host are a host of their own."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))


def _word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(BLANK))) > 0


def _mark(line: Column) -> Column:
    """96 bits of two unlike hashes stand for a line."""
    return F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g"))


def _exceeds(n: Column, pages: Column, ratio: float, confidence: float) -> Column:
    """Whether n of a host's pages are surely more than the ratio, each page seen from the others."""
    x, m = (n - 1).cast("double"), F.greatest(pages - 1, F.lit(1)).cast("double")
    rest = F.when(x < m, (m - x) * F.ln((m - x) / (m * (1 - ratio)))).otherwise(0.0)
    return (n > 1) & (x > ratio * m) & (x * F.ln(x / (m * ratio)) + rest >= -math.log(1 - confidence))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per host that has boilerplate: _host and _lines, an array of line marks; staged."""
    if not (0 < ratio < 1 and 0 <= confidence < 1):
        raise ValueError("ratio is between 0 and 1, confidence at least 0 and below 1")
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), _word)
    pages = docs.select(_key(F.col(host)).alias("_host"), _mark(text).alias("_page"), F.array_distinct(F.transform(lines, _mark)).alias("_marks"))
    pages = pages.groupBy("_host", "_page").agg(F.first("_marks").alias("_marks"))
    totals = pages.groupBy("_host").agg(F.count("*").alias("_pages"))
    counts = pages.select("_host", F.explode("_marks").alias("_m")).groupBy("_host", "_m.h", "_m.g").agg(F.count("*").alias("_n"))
    frequent = counts.filter("_n > 1").join(totals, "_host").filter(_exceeds(F.col("_n"), F.col("_pages"), ratio, confidence))
    return common.staged(frequent.groupBy("_host").agg(F.collect_list(F.struct("h", "g")).alias("_lines")), "boilerplate")


def _cleaned(docs: DataFrame, host: str, ratio: float, confidence: float) -> DataFrame:
    """_row (the columns of ``docs`` as a struct, so that none can clash), _text (what stays), _n and _dropped."""
    found = boilerplate(docs, host, ratio, confidence)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    pages = docs.select(row.alias("_row"), F.col("text").alias("_old"), _key(F.col(host)).alias("_host")).join(found, "_host", "left")
    lines = F.split("_old", "\n")
    boiler = lambda x: _word(x) & F.array_contains(F.col("_lines"), _mark(x))
    kept = F.filter(lines, lambda x: ~boiler(x))
    n_kept = F.size(F.filter("_keep", _word))
    out = pages.withColumn("_n", F.coalesce(F.size(F.filter(lines, _word)), F.lit(0)))
    out = out.withColumn("_keep", F.when(F.col("_lines").isNotNull() & F.col("_old").isNotNull(), kept))
    out = out.withColumn("_some", F.col("_keep").isNotNull() & (n_kept < F.col("_n")))
    return out.select(
        "_row", "_n", F.when(F.col("_some"), F.array_join("_keep", "\n")).otherwise(F.col("_old")).alias("_text"),
        F.when(F.col("_some"), F.col("_n") - n_kept).otherwise(0).alias("_dropped"),
    )


def dedup_lines(docs: DataFrame, host: str = "source", ratio: float = RATIO, confidence: float = CONFIDENCE) -> DataFrame:
    """``docs`` with all its columns and rows, the boilerplate lines taken out of ``text``.

    Null text stays null, empty text empty; both count as one and the same empty page. A null host counts as one host.
    Repeated rows and other equal texts of a host count as one page and are all cleaned; a line that repeats within a
    page counts once. Frequencies equal to ``ratio`` are not above it. Texts of any length are cleaned whole. A page
    that has only boilerplate is left with its blank lines, or empty.
    """
    out = _cleaned(docs, host, ratio, confidence)
    return out.select(*[F.col("_text").alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with all columns and rows; lines above the ratio are out of the texts (see ``dedup_lines``)."""
    return dedup_lines(docs)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents by source, without the lines that more than 1 % of their source's documents share."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = _cleaned(docs, "source", RATIO, CONFIDENCE)
    return out.select(
        "_row.doc_id", "_row.source", F.col("_n").cast("long").alias("n_lines"), F.col("_dropped").cast("long").alias("n_dropped"),
        F.col("_text").alias("clean_text"),
    )


OP2_SQL = r"""
WITH pages AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
l AS (
  SELECT r, source, u.i, u.line, length(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))) > 0 AS word
  FROM (SELECT r, source, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i, 'line': x})) AS u FROM pages)
),
first AS (SELECT source, min(r) AS r FROM pages GROUP BY source, coalesce(text, '')),
f AS (
  SELECT source, line FROM (
    SELECT source, line, (n - 1)::DOUBLE AS x, (pages - 1)::DOUBLE AS m
    FROM (SELECT source, line, count(DISTINCT r) AS n FROM l WHERE word AND r IN (SELECT r FROM first) GROUP BY source, line)
    JOIN (SELECT source, count(*) AS pages FROM first GROUP BY source) USING (source)
    WHERE n > 1
  )
  WHERE x > 0.01::DOUBLE * m AND x * ln(x / (m * 0.01::DOUBLE)) + CASE WHEN x < m THEN (m - x) * ln((m - x) / (m * 0.99::DOUBLE)) ELSE 0 END >= -ln(1 - 0.995::DOUBLE)
),
m AS (SELECT l.*, f.line IS NOT NULL AND l.word AS boiler FROM l LEFT JOIN f ON l.source = f.source AND l.line = f.line),
c AS (
  SELECT r, count(*) FILTER (word) AS n_lines, count(*) FILTER (word AND NOT boiler) AS left_over,
         string_agg(line, chr(10) ORDER BY i) FILTER (NOT boiler) AS kept
  FROM m GROUP BY r
)
SELECT doc_id, source, coalesce(n_lines, 0)::BIGINT AS n_lines, CASE WHEN left_over < n_lines THEN n_lines - left_over ELSE 0 END::BIGINT AS n_dropped,
       CASE WHEN left_over < n_lines THEN coalesce(kept, '') ELSE text END AS clean_text
FROM pages LEFT JOIN c USING (r)
"""
