"""Answers from a typed transcript: an empty line submits, an immediate one skips, the end submits what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse(transcripts: DataFrame, n_questions: int = 3) -> DataFrame:
    """review_id, question_ord (from 0), raw_text, skipped, from review_id and text.

    Lines end with a line feed, or a carriage return and one; only that ending is taken off. White space is content.
    At the end of the text a begun answer counts, and what has not begun is skipped.
    """
    lines = transcripts.select("review_id", F.posexplode(F.split("text", "\n")).alias("i", "line"), F.size(F.split("text", "\n")).alias("n"))
    lines = lines.filter(~((F.col("i") == F.col("n") - 1) & (F.col("line") == ""))).withColumn("line", F.regexp_replace("line", r"\r\z", ""))
    before = W.partitionBy("review_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    blank = (F.col("line") == "").cast("int")
    lines = lines.withColumn("question_ord", F.coalesce(F.sum(blank).over(before), F.lit(0)).cast("int"))
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("line") != "", F.struct("i", "line")))), lambda x: x["line"])
    typed = lines.groupBy("review_id", "question_ord").agg(body.alias("b"))
    asked = transcripts.select("review_id", F.explode(F.sequence(F.lit(0), F.lit(n_questions - 1))).alias("question_ord"))
    out = asked.join(typed, ["review_id", "question_ord"], "left")
    some = F.coalesce(F.size("b"), F.lit(0)) > 0
    return out.select("review_id", "question_ord", F.when(some, F.array_join("b", "\n")).otherwise("").alias("raw_text"), (~some).alias("skipped"))
