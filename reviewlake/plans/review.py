"""All stages of a review over many reviews at once, keyed by review_id.

Stage results that several later stages read are written to the shared folder, so plans stay small and nothing is
computed twice. A review that cannot go on is a row of ``failures`` (review_id and the fields of errors.FAILURE) and is
in no other result; all others go on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import CollectionFailed, ConfigError, IdsDiffer
from ..functions import lexicon as L
from ..functions.staging import cut
from ..operators import effects, extract, filtering, grading, patches, questions, report, selection, summarize


FAILURE_FIELDS = ("error", "message", "recovery", "details")


@dataclass(frozen=True)
class Options:
    exclude: tuple[str, ...] = ()
    n_questions: int = 3
    follow_up: bool = True
    per_patch_bytes: int = L.PATCH_BYTES
    total_patch_bytes: int = L.TOTAL_PATCH_BYTES
    evidence_per_file: int = L.EVIDENCE_PER_FILE
    calls_scanned: int = L.CALLS_SCANNED
    effects_kept: int = L.EFFECTS
    changed_files: int = L.CHANGED_FILES


@dataclass(frozen=True)
class Feed:
    """reviews(review_id, current_branch, base_branch); files(review_id, file_ord, path, old_path, status, language);
    raw_patches(review_id, file_ord, patch string, and limit_reason where the patch budget has been applied already);
    sources(review_id, path, content, and a note where there is no content); settings, if any (review_id, exclude
    array<string>, n_questions, follow_up; one row a review, nulls for what Options say); failures, if any."""

    reviews: DataFrame
    files: DataFrame
    raw_patches: DataFrame
    sources: DataFrame
    settings: DataFrame | None = None
    failures: DataFrame | None = None


@dataclass(frozen=True)
class Bundle:
    files: DataFrame
    filtered: DataFrame
    hunks: DataFrame
    symbols: DataFrame
    imports: DataFrame
    calls: DataFrame
    effects: DataFrame
    by_kind: DataFrame
    purposes: DataFrame
    relevant: DataFrame
    notes: DataFrame
    questions: DataFrame
    status: DataFrame
    failures: DataFrame


def failed(rows: DataFrame, kind: type, message: Column, recovery: str, details: Column) -> DataFrame:
    """Failures of the reviews of some rows."""
    return rows.select("review_id", F.lit(kind.__name__).alias("error"), message.alias("message"), F.lit(recovery).alias("recovery"), details.alias("details"))


def over_file_limit(kept: DataFrame, most: int) -> DataFrame:
    n = F.format_number("n_files", 0)
    return failed(filtering.over_limit(kept, most), CollectionFailed, F.lit(f"More than {most:,} files are left to analyse."), "Review a smaller change or raise the limit.", F.concat(n, F.lit(" files")))


def unreadable_hunks(hunks: DataFrame) -> DataFrame:
    return failed(patches.unreadable(hunks), CollectionFailed, F.lit("A hunk header cannot be read."), "See the details.", F.col("header"))


def unsound_settings(settings: DataFrame, all_: Options) -> DataFrame:
    """Exclusions that are no patterns, and numbers of questions that cannot be asked."""
    wrong = filtering.exclusions(settings).filter("problem is not null")
    n = settings.filter(~F.coalesce("n_questions", F.lit(all_.n_questions)).between(1, 3)).select("review_id", F.lit("`questions` must be from 1 to 3").alias("problem"))
    problems = wrong.select("review_id", "problem").unionByName(n).groupBy("review_id").agg(F.min("problem").alias("problem"))
    return failed(problems, ConfigError, F.lit("The configuration is invalid."), "Correct it and try again.", F.col("problem"))


def unmatched_ids(questions: DataFrame, others: DataFrame, of: str) -> DataFrame:
    """Questions and what belongs to them must match one to one by id."""
    wrong = selection.id_problems(questions, others, of).groupBy("review_id").agg(F.min("problem").alias("problem"))
    return failed(wrong, IdsDiffer, F.concat(F.upper(F.substring("problem", 1, 1)), F.expr("substring(problem, 2)"), F.lit(".")), "Give each question exactly one answer, by its id.", F.lit(None).cast("string"))


def _without(df: DataFrame, failures: DataFrame) -> DataFrame:
    return df.join(failures.select("review_id"), "review_id", "left_anti")


def admitted(feed: Feed, options: Options = Options()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(failures, files with filter_reason, patches of kept files, hunks); all but failures without the failed reviews.

    A review has one failure, its first: in the feed, in its settings, by the number of files that are left, by a hunk
    header. Patches have limit_reason and binary.
    """
    spark, settings = feed.files.sparkSession, feed.settings
    failures = spark.createDataFrame([], "review_id long, " + ", ".join(f"{c} string" for c in FAILURE_FIELDS))
    if feed.failures is not None:
        failures = feed.failures.select(failures.columns)
    if settings is not None:
        failures = cut(failures.unionByName(_without(unsound_settings(settings, options), failures)))
    files = cut(_without(filtering.with_filter_reason(feed.files, list(options.exclude), settings), failures))
    kept = files.filter("filter_reason is null")
    failures = cut(failures.unionByName(over_file_limit(kept, options.changed_files)))
    p = _without(feed.raw_patches, failures).join(kept.select("review_id", "file_ord", "path"), ["review_id", "file_ord"])
    if "limit_reason" not in p.columns:
        budget = filtering.patch_budget(p.select("review_id", "file_ord", F.octet_length("patch").cast("long").alias("n_bytes")), options.per_patch_bytes, options.total_patch_bytes)
        p = p.join(budget.select("review_id", "file_ord", "limit_reason"), ["review_id", "file_ord"])
    p = cut(p.withColumn("binary", F.col("limit_reason").isNull() & patches.is_binary(F.col("patch"))))
    hunks = cut(patches.split_hunks(p.filter("limit_reason is null and not binary").select("review_id", "file_ord", "path", "patch")))
    failures = cut(failures.unionByName(unreadable_hunks(hunks)))
    return failures, *(_without(df, failures) for df in (files, p, hunks))


def model(feed: Feed, options: Options = Options()) -> Bundle:
    """From a change feed to summaries and questions, of all reviews that are ``admitted``."""
    settings = feed.settings
    failures, all_files, p, hunks = admitted(feed, options)
    kept = all_files.filter("filter_reason is null").drop("filter_reason")
    flags = p.select("review_id", "file_ord", F.col("binary").alias("is_binary"))
    has = hunks.select("review_id", "file_ord").distinct().withColumn("has_hunks", F.lit(True))
    files = cut(filtering.classified(kept.join(flags, ["review_id", "file_ord"], "left").join(has, ["review_id", "file_ord"], "left").fillna({"is_binary": False, "has_hunks": False})))
    rows, read_notes = extract.symbols_imports_calls(files, hunks, feed.sources, options.evidence_per_file)
    rows, read_notes = cut(rows), cut(read_notes)
    order = W.partitionBy("review_id").orderBy("file_ord", "ord", "name")
    pick = lambda kind, o: rows.filter(F.col("class") == kind).withColumn(o, F.row_number().over(order) - 1)
    symbols = cut(pick("symbol", "symbol_ord").select("review_id", "symbol_ord", "path", "name", "kind", "line_start", "origin"))
    calls = cut(extract.first_seen(pick("call", "call_ord"), ["review_id", "path", "name", "line_start"], "call_ord"))
    imports = pick("import", "ref_ord").select("review_id", "ref_ord", "path", "name", "line_start", "local_name")
    found, scan_notes = effects.detect(calls, imports, hunks, files, options.calls_scanned, options.effects_kept)
    found = cut(found)
    by_kind = summarize.effects_by_kind(found, files)
    cites = found.select("review_id", F.explode("evidence").alias("c")).select("review_id", F.col("c.file_path").alias("path"))
    evidence_paths = symbols.select("review_id", "path").union(imports.select("review_id", "path")).union(calls.select("review_id", "path")).union(cites).union(files.filter("is_test").select("review_id", "path"))
    usable = cut(filtering.analyzable(files, evidence_paths))
    # in this order: unsupported languages, patches, sources and extraction by file, limits of detection
    placed = lambda df, place, file, step: df.select("review_id", F.struct(F.lit(place).alias("place"), file.alias("file"), step.alias("step"), F.col("note").alias("note")).alias("x"))
    zero = F.lit(0)
    other = summarize.unsupported_labels(files).select("review_id", summarize.unsupported_note(F.col("labels")).alias("note"))
    notes = placed(other, 0, zero, zero).unionByName(placed(patches.collection_notes(p, options.per_patch_bytes, options.total_patch_bytes), 1, F.col("file_ord"), F.col("step")))
    notes = notes.unionByName(placed(read_notes, 2, F.col("file_ord"), F.col("step"))).unionByName(placed(scan_notes, 3, F.col("note_ord"), zero))
    notes = notes.groupBy("review_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["note"])).alias("notes"))
    return Bundle(
        files, all_files.filter("filter_reason is not null"), hunks, symbols, imports, calls, found, by_kind, summarize.purposes(files, symbols, by_kind),
        filtering.relevant_files(files, cites, symbols), notes, cut(questions.first_questions(questions.generate(files, usable, symbols, found), options.n_questions, settings)),
        questions.review_status(files, usable), failures,
    )


@dataclass(frozen=True)
class Graded:
    assessments: DataFrame
    follow_ups: DataFrame
    points: DataFrame
    reports: DataFrame
    markdown: DataFrame
    failures: DataFrame


def assess(feed: Feed, bundle: Bundle, answers: DataFrame, options: Options = Options(), generated_at=None, follow_up_answers: DataFrame | None = None) -> Graded:
    """From answers (review_id, question_id, raw_text, skipped) to assessments, follow-ups, talking points and reports.

    follow_up_answers: review_id, raw_text, skipped; they are reported, not graded. Reviews whose answers have not the
    ids of their questions, one each, are set aside.
    """
    b = bundle
    wrong = cut(unmatched_ids(b.questions, _without(answers, b.failures), "answer"))
    asked, answers = cut(_without(b.questions, wrong)), cut(_without(answers, wrong))
    a = cut(grading.grade(asked, answers, b.files, b.symbols, b.calls, b.effects))
    f = selection.follow_ups(asked, a, b.files)
    if not options.follow_up:
        f = f.limit(0)
    if feed.settings is not None:
        f = f.join(feed.settings.filter("not follow_up").select("review_id"), "review_id", "left_anti")
    f = cut(f)
    answered = f if follow_up_answers is None else f.join(follow_up_answers.select("review_id", "raw_text", "skipped"), "review_id", "left")
    points = cut(selection.talking_points(b.purposes, asked, a, b.by_kind))
    stamp = F.current_timestamp() if generated_at is None else F.lit(generated_at).cast("timestamp")
    reviews = _without(feed.reviews, b.failures.unionByName(wrong))
    payload = cut(report.payload(reviews, b.purposes, b.notes, asked, answers, a, answered, points, stamp))
    return Graded(a, f, points, payload, report.markdown(payload), b.failures.unionByName(wrong))


def feed_from_tables(spark: SparkSession, reviews: str, files: str, raw_patches: str, sources: str) -> Feed:
    """A feed that was written as Parquet tables before."""
    return Feed(*(spark.read.parquet(p) for p in (reviews, files, raw_patches, sources)))
