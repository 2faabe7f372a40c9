"""python -m reviewlake review | install-hook | init: one review at the terminal, over the same operators."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from . import __version__
from .errors import ReportWriteFailed, ReviewError, raised
from .sources import config, git, setup, transcript

CONFIG = git.CONFIG_FILE


def _typed() -> list[str]:
    """Lines up to an empty one, or the end."""
    out = []
    while line := sys.stdin.readline():
        out.append(line)
        if line in ("\n", "\r\n"):
            break
    return out


def stop_on_failure(failures) -> None:
    """The terminal has one review, so its failure ends the command."""
    row = failures.first()
    if row is not None:
        raise raised(row)


def _review(a: argparse.Namespace) -> None:
    from pyspark.sql import SparkSession

    from .operators import present
    from .plans import review

    here = Path.cwd()
    root, _ = git.detect(str(here))
    o = config.resolve(config.load(Path(root) / CONFIG), base=a.base, report_path=a.report, questions=a.questions, include_uncommitted=a.include_uncommitted, directory=here)
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    options = review.Options()
    feed = git.feed(spark, [git.Repo(1, root, o.base, o.include_uncommitted, o.questions, not a.no_follow_up)])
    b = review.model(feed, options)
    stop_on_failure(b.failures)
    print(present.overview(feed.reviews, b.files, b.filtered).first()["overview"], end="\n\n")
    shown = present.summary(b.purposes, b.relevant, b.files, b.by_kind, b.notes).first()
    status = b.status.first()
    if status is None or status["status"] != "ok":
        print("Review stopped: " + ("no meaningful changes." if status is None else status["status"].replace("_", " ") + "."))
        return
    print(shown["summary"], end="\n\n")
    asked = b.questions.orderBy("question_ord").collect()
    print("A blank line submits; press Enter immediately to skip.")
    typed: list[str] = []
    for i, q in enumerate(asked):
        print(f"\nQuestion {i + 1}/{len(asked)}: {q['prompt']}")
        typed += _typed()
    lines = spark.createDataFrame([(1, "".join(typed))], "review_id long, text string")
    ids = spark.createDataFrame([(q["question_ord"], q["id"]) for q in asked], "question_ord int, question_id string")
    answers = transcript.parse(lines, len(asked)).join(ids, "question_ord").drop("question_ord")
    graded = review.assess(feed, b, answers, options)
    stop_on_failure(graded.failures)
    more = graded.follow_ups.first()
    if more is not None:
        print(f"\nFollow-up: {more['prompt']}")
        said = transcript.parse(spark.createDataFrame([(1, "".join(_typed()))], "review_id long, text string"), 1)
        graded = review.assess(feed, b, answers, options, follow_up_answers=said)
    count = present.answer_counts(answers).first()
    print(f"\nAnswers: {count['answered']} answered, {count['skipped']} skipped")
    try:
        o.report_path.parent.mkdir(parents=True, exist_ok=True)
        o.report_path.write_text(graded.markdown.first()["markdown"], encoding="utf-8")
    except OSError as e:
        raise ReportWriteFailed(f"The report could not be written to {o.report_path}.", "Choose a writable --report path.", str(e)) from e
    print(f"Report written: {o.report_path}")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="reviewlake")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("review")
    r.add_argument("--base")
    r.add_argument("--report")
    r.add_argument("--questions", type=int, choices=(1, 2, 3))
    r.add_argument("--no-follow-up", action="store_true")
    r.add_argument("--include-uncommitted", action=argparse.BooleanOptionalAction)
    h = sub.add_parser("install-hook")
    h.add_argument("--base")
    h.add_argument("--force", action="store_true")
    i = sub.add_parser("init")
    i.add_argument("--path", default=CONFIG)
    a = p.parse_args(argv)
    try:
        if a.command == "review":
            _review(a)
        elif a.command == "install-hook":
            root, _ = git.detect(".")
            print(setup.install_hook(setup.hook_path(root), setup.hook_script(git.base_branch(root, a.base) if a.base else None), a.force))
        else:
            setup.write_starter(Path(a.path))
            print(f"Created {a.path}")
    except ReviewError as e:
        print(e.rendered(), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
