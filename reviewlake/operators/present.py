"""What a reader sees of a review, as text columns: one row per review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("  - "), x)), "\n")


def _section(title: str, items: Column) -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.concat(F.lit(f"{title}:\n"), _bullets(items)))


def _ordered(key: str, value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda x: x["v"])


def overview(reviews: DataFrame, files: DataFrame, filtered: DataFrame) -> DataFrame:
    """review_id, overview: where, what is compared, and how many files are analysed or filtered, by name."""
    name = F.concat(F.when(F.col("old_path").isNotNull(), F.concat(T.json_quoted(F.col("old_path")), F.lit(" -> "))).otherwise(""), T.json_quoted(F.col("path")))
    f = files.groupBy("review_id").agg(_ordered("file_ord", F.concat("status", F.lit(": "), name)).alias("f"))
    g = filtered.groupBy("review_id").agg(_ordered("file_ord", F.concat(T.json_quoted(F.col("path")), F.lit(": "), F.col("filter_reason"))).alias("g"))
    all_ = reviews.join(f, "review_id", "left").join(g, "review_id", "left")
    n, m = F.coalesce(F.size("f"), F.lit(0)), F.coalesce(F.size("g"), F.lit(0))
    counts = F.format_string("Changes: %d total, %d analyzed, %d filtered", n + m, n, m)
    lines = F.concat_ws(
        "\n", F.concat(F.lit("Repository: "), T.json_quoted(F.col("repo_root"))), F.concat(F.lit("Branch: "), "current_branch", F.lit(" -> "), "base_branch"),
        F.concat(F.lit("Merge base: "), F.substring("merge_base", 1, 12)), counts, _section("Changed files", F.col("f")), _section("Filtered files", F.col("g")),
    )
    return all_.select("review_id", lines.alias("overview"))


def summary(purposes: DataFrame, relevant: DataFrame, files: DataFrame, by_kind: DataFrame, notes: DataFrame) -> DataFrame:
    """review_id, summary: purpose, relevant files, at most five tests, effects with three paths each, three notes.

    The note on languages without symbol extraction goes first.
    """
    r = relevant.groupBy("review_id").agg(_ordered("place", T.json_quoted(F.col("path"))).alias("r"))
    t = files.filter("is_test").groupBy("review_id").agg(_ordered("file_ord", T.json_quoted(F.col("path"))).alias("t"))
    paths = F.slice(F.array_distinct(F.transform("evidence", lambda e: T.json_quoted(e["file_path"]))), 1, 3)
    e = by_kind.groupBy("review_id").agg(_ordered("first_ord", F.concat("kind", F.lit(": "), "description", F.lit(" Evidence: "), F.array_join(paths, ", "))).alias("e"))
    all_ = purposes.join(r, "review_id", "left").join(t, "review_id", "left").join(e, "review_id", "left").join(notes, "review_id", "left")
    first = lambda x: x.startswith("Symbol-level analysis was unavailable for ")
    ordered = F.concat(F.filter("notes", first), F.filter("notes", lambda x: ~first(x)))
    cut = lambda items, n, tail: F.when(F.size(items) > n, F.concat(F.slice(items, 1, n), F.array(F.concat(F.lit("and "), (F.size(items) - n).cast("string"), F.lit(tail))))).otherwise(items)
    lines = F.concat_ws(
        "\n", F.concat(F.lit("Purpose: "), F.col("purpose")), _section("Relevant files", F.col("r")), _section("Tests found", cut(F.col("t"), 5, " more")),
        _section("Likely side effects", F.col("e")), _section("Uncertainty", cut(ordered, 3, " more notes")),
    )
    return all_.select("review_id", lines.alias("summary"))


def answer_counts(answers: DataFrame) -> DataFrame:
    """review_id, answered, skipped."""
    return answers.groupBy("review_id").agg(F.count_if(~F.col("skipped")).alias("answered"), F.count_if("skipped").alias("skipped"))
