"""Patches as relations: hunks, lines, affected line numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T

HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def is_binary(patch: Column) -> Column:
    return F.rlike(patch, F.lit(r"(?md)^(?:GIT binary patch|Binary files .+ differ)\r?$"))


def header_numbers(header: Column) -> dict[str, Column]:
    """old_start, old_lines, new_start, new_lines; a missing count is 1, an unreadable header gives nulls."""
    part = lambda i: F.nullif(F.regexp_extract(header, HEADER, i), F.lit("")).cast("int")
    ok = F.rlike(header, F.lit(HEADER))
    return {
        "old_start": part(1), "old_lines": F.when(ok, F.coalesce(part(2), F.lit(1))),
        "new_start": part(3), "new_lines": F.when(ok, F.coalesce(part(4), F.lit(1))),
    }


def split_hunks(patches: DataFrame) -> DataFrame:
    """review_id, file_ord, path, hunk_ord, header, the four numbers, patch - from review_id, file_ord, path, patch.

    A hunk runs from a line that begins with "@@ " to the next; what comes before the first is no hunk. A header that
    cannot be read has nulls for numbers (``unreadable``). Done within the row, so nothing is shuffled.
    """
    p = patches.withColumn("_l", F.split("patch", "\n"))
    at = F.filter(F.transform("_l", lambda x, i: F.when(x.startswith("@@ "), i)), lambda i: i.isNotNull())
    p = p.withColumn("_at", at)
    ends = F.concat(F.slice("_at", F.lit(2), F.size("_at")), F.array(F.size("_l")))
    cut = F.transform(F.arrays_zip(F.col("_at").alias("a"), ends.alias("b")), lambda z: z)
    p = p.filter(F.size("_at") > 0).select("review_id", "file_ord", "path", "_l", F.posexplode(cut).alias("hunk_ord", "z"))
    lines = F.slice("_l", F.col("z.a") + 1, F.col("z.b") - F.col("z.a"))
    last = F.col("z.b") == F.size("_l")
    text = F.concat(F.array_join(lines, "\n"), F.when(last, "").otherwise("\n"))
    p = p.select("review_id", "file_ord", "path", "hunk_ord", F.regexp_replace(F.get(lines, F.lit(0)), r"[\r\n]+\z", "").alias("header"), text.alias("patch"))
    return p.withColumns(header_numbers(F.col("header")))


def unreadable(hunks: DataFrame) -> DataFrame:
    """Reviews with hunks whose headers cannot be read: review_id, header (the first in order of file and hunk)."""
    return hunks.filter("new_start is null").groupBy("review_id").agg(F.min_by("header", F.struct("file_ord", "hunk_ord")).alias("header"))


def new_side(hunks: DataFrame) -> DataFrame:
    """review_id, path, hunk_ord, i, mark (first character), line, new_line: every patch line after the header.

    new_line is the number the line has, or would have, on the new side. Empty patch lines and "\\" notes are left out.
    """
    rows = hunks.select("review_id", "path", "hunk_ord", F.coalesce("new_start", F.lit(0)).alias("s"), F.posexplode(F.split("patch", "\n")).alias("i", "raw"))
    rows = rows.filter((F.col("i") > 0) & (F.length("raw") > 0) & ~F.col("raw").startswith("\\"))
    before = W.partitionBy("review_id", "path", "hunk_ord").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    mark = F.substring("raw", 1, 1)
    passed = F.coalesce(F.sum(F.when(mark == "-", 0).otherwise(1)).over(before), F.lit(0))
    return rows.select("review_id", "path", "hunk_ord", "i", mark.alias("mark"), F.expr("substring(raw, 2)").alias("line"), (F.col("s") + passed).cast("int").alias("new_line"))


def affected_lines(hunks: DataFrame) -> DataFrame:
    """review_id, path, line: new-side lines that a change touches, the line before a deletion among them."""
    n = F.col("new_line")
    deleted = F.filter(F.array(F.when(n > 0, n), F.when(n > 1, n - 1)), lambda x: x.isNotNull())
    rows = new_side(hunks).filter(F.col("mark").isin("+", "-"))
    return rows.select("review_id", "path", F.explode(F.when(F.col("mark") == "+", F.array(n)).otherwise(deleted)).alias("line")).distinct()


def line_at(hunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (review_id, path, hunk_ord, new_line) with mark and line of the patch line that stands there."""
    rows = new_side(hunks).filter(F.col("mark") != "-").select("review_id", "path", "hunk_ord", "new_line", "mark", "line")
    return wanted.join(rows, ["review_id", "path", "hunk_ord", "new_line"], "left")


def collection_notes(decided: DataFrame, per_file: int = L.PATCH_BYTES, total: int = L.TOTAL_PATCH_BYTES) -> DataFrame:
    """review_id, file_ord, step, note about patches left out: review_id, file_ord, path, limit_reason, binary."""
    quoted = T.json_quoted(F.col("path"))
    text = F.when(F.col("limit_reason") == "file", F.concat(F.lit("Skipped patch hunks for "), quoted, F.lit(f" because its patch exceeds {per_file:,} bytes.")))
    text = text.when(F.col("binary"), F.concat(F.lit("Skipped patch hunks for binary file "), quoted, F.lit(".")))
    each = decided.select("review_id", "file_ord", F.lit(0).alias("step"), text.alias("note")).filter("note is not null")
    n = decided.filter("limit_reason = 'aggregate'").groupBy("review_id").agg(F.count("*").alias("n"))
    rest = F.concat(F.lit("Skipped patch hunks for "), F.format_number("n", 0), F.lit(f" files because buffered patch data exceeds {total:,} bytes."))
    return each.unionByName(n.select("review_id", F.lit(2_000_000_000).alias("file_ord"), F.lit(0).alias("step"), rest.alias("note")))
