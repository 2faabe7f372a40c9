"""Which files of a review are kept, and which patches fit the budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import paths as P


def path_reason(path: Column, exclude: list[str] | Column | None = None) -> Column:
    """Why a path is of low value, by fixed precedence; null if it is not."""
    in_dirs = lambda dirs: F.arrays_overlap(P.parents(path), F.array(*map(F.lit, dirs)))
    low = F.lower(P.name(path))
    minified = low.endswith(L.MINIFIED_SUFFIXES[0])
    for s in L.MINIFIED_SUFFIXES[1:]:
        minified = minified | low.endswith(s)
    out = F.when(in_dirs(L.GENERATED_DIRS), L.GENERATED).when(in_dirs(L.VENDORED_DIRS), L.VENDORED)
    out = out.when(P.name(path).isin(L.LOCKFILES), L.LOCKFILE).when(minified, L.MINIFIED)
    return out if exclude is None else out.when(P.ignored(path, exclude), L.EXCLUDED)


def with_filter_reason(files: DataFrame, exclude: list[str] | None = None, settings: DataFrame | None = None) -> DataFrame:
    """``files`` with filter_reason. A rename is filtered only if both its paths are, for the new path's reason.

    settings (review_id, exclude array<string>, one row a review): exclusions of each review, in place of ``exclude``.
    """
    if settings is not None:
        files = files.join(exclusions(settings).filter("problem is null").select("review_id", "_regex"), "review_id", "left")
        exclude = F.col("_regex")
    new, old = path_reason(F.col("path"), exclude), path_reason(F.col("old_path"), exclude)
    return files.withColumn("filter_reason", F.when(F.col("old_path").isNull() | old.isNotNull(), new)).drop("_regex")


def exclusions(settings: DataFrame) -> DataFrame:
    """review_id, _regex, problem: the expression of each review's exclusions, or what is wrong with them.

    Each distinct set of patterns is translated once, however many reviews have it. No patterns, or null: both null.
    """
    sets = settings.select("exclude").filter(F.size("exclude") > 0).distinct()

    def translated(batches):
        for pdf in batches:
            rows = []
            for patterns in pdf["exclude"]:
                try:
                    if None in list(patterns):
                        raise ValueError("a pattern is null")
                    rows.append((list(patterns), P.ignore_set_regex(patterns), None))
                except ValueError as e:
                    rows.append((list(patterns), None, str(e)))
            yield pd.DataFrame(rows, columns=["exclude", "_regex", "problem"])

    made = sets.mapInPandas(translated, "exclude array<string>, _regex string, problem string")
    return settings.select("review_id", "exclude").join(made, "exclude", "left").select("review_id", "_regex", "problem")


def classified(files: DataFrame) -> DataFrame:
    """``files`` with language filled in and is_test and is_documentation widened by the path's own signs."""
    flag = lambda c, f: (F.coalesce(F.col(c), F.lit(False)) | f) if c in files.columns else f
    declared = F.col("language") if "language" in files.columns else F.lit(None).cast("string")
    return files.withColumns(
        {
            "language": P.language(F.col("path"), declared),
            "is_test": flag("is_test", P.is_test(F.col("path"))),
            "is_documentation": flag("is_documentation", P.is_documentation(F.col("path"))),
        }
    )


def filter_counts(files: DataFrame) -> DataFrame:
    """Files per review and reason ("kept" where there is none), with the first ordinal of each."""
    return files.groupBy("review_id", F.coalesce("filter_reason", F.lit("kept")).alias("reason")).agg(
        F.count("*").alias("n_files"), F.min("file_ord").alias("first_ord")
    )


def analyzable(files: DataFrame, evidence_paths: DataFrame) -> DataFrame:
    """Files worth asking about: not binary, not documentation, with hunks or any structured evidence."""
    marked = files.join(evidence_paths.select("review_id", "path").distinct().withColumn("_e", F.lit(True)), ["review_id", "path"], "left")
    ok = ~F.col("is_binary") & ~F.col("is_documentation") & (F.col("has_hunks") | F.col("_e").isNotNull())
    return marked.filter(ok).drop("_e").select(*files.columns)


def patch_budget(patches: DataFrame, per_file: int = L.PATCH_BYTES, total: int = L.TOTAL_PATCH_BYTES) -> DataFrame:
    """review_id, file_ord, n_bytes, limit_reason (null, "file" or "aggregate").

    The budget is greedy in file order: a patch that is left out takes nothing from it, so a later, smaller one may
    still fit. That depends on every decision before, hence one ordered fold per review (files per review are bounded
    by the raw-file limit); reviews are independent.
    """
    if per_file < 1 or total < 1:
        raise ValueError("limits must be positive")
    arr = F.array_sort(F.collect_list(F.struct("file_ord", "n_bytes")))
    state = "struct<used: bigint, out: array<struct<file_ord: bigint, n_bytes: bigint, limit_reason: string>>>"

    def step(acc: Column, x: Column) -> Column:
        room = F.lit(total).cast("long") - acc["used"]
        n = x["n_bytes"].cast("long")
        # whichever limit is lower is crossed first; where one fragment could cross both, the file limit counts
        why = F.when((n > per_file) & (room >= per_file), "file").when(n > room, "aggregate").when(n > per_file, "file")
        kept = F.when(why.isNull(), n).otherwise(F.lit(0).cast("long"))
        item = F.struct(x["file_ord"].cast("long").alias("file_ord"), n.alias("n_bytes"), why.alias("limit_reason"))
        return F.struct((acc["used"] + kept).alias("used"), F.concat(acc["out"], F.array(item)).alias("out")).cast(state)

    first = F.struct(F.lit(0).cast("long").alias("used"), F.array().alias("out")).cast(state)
    folded = patches.groupBy("review_id").agg(arr.alias("a"))
    return folded.select("review_id", F.explode(F.aggregate("a", first, step)["out"]).alias("x")).select("review_id", "x.*")


def over_limit(files: DataFrame, most: int = L.CHANGED_FILES) -> DataFrame:
    """Reviews with more files than ``most``: review_id, n_files. A caller raises or sets them aside."""
    return files.groupBy("review_id").agg(F.count("*").alias("n_files")).filter(F.col("n_files") > most)


def relevant_files(files: DataFrame, effect_paths: DataFrame, symbol_paths: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` most telling files of each review: with effects, then with symbols, then plain, then tests."""
    effect = effect_paths.select("review_id", "path").distinct().withColumn("_e", F.lit(True))
    symbol = symbol_paths.select("review_id", "path").distinct().withColumn("_s", F.lit(True))
    found = files.join(effect, ["review_id", "path"], "left").join(symbol, ["review_id", "path"], "left")
    category = F.when(F.col("_e"), 0).when(F.col("_s"), 1).when(~F.col("is_test"), 2).otherwise(3)
    order = W.partitionBy("review_id").orderBy("category", "file_ord")
    ranked = found.withColumn("category", category).withColumn("place", F.row_number().over(order))
    return ranked.filter(F.col("place") <= most).select("review_id", F.col("place").cast("long").alias("place"), "path", "category")
