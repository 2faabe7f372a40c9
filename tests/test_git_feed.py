"""Git repositories as a feed: pinned, read once, selected while read; reviews that fail alone; options of each review."""

import itertools
import random
import subprocess
import tracemalloc

import pytest
from pyspark.sql import functions as F

from reviewlake.functions import lexicon as L
from reviewlake.functions import paths as P
from reviewlake.operators import extract, filtering, patches
from reviewlake.plans import review
from reviewlake.sources import config, git

FILES = "review_id long, file_ord int, path string, old_path string, status string, language string"


def run(d, *args):
    return subprocess.run(["git", "-C", str(d), *args], check=True, capture_output=True, text=True).stdout


def repository(d, before, after, branch="feature"):
    """A repository with two commits, the second on a branch of its own."""
    d.mkdir(parents=True, exist_ok=True)
    run(d, "init", "-q", "-b", "main")
    run(d, "config", "user.name", "t")
    run(d, "config", "user.email", "t@example.org")
    for files in (before, after):
        for p, text in files.items():
            (d / p).parent.mkdir(parents=True, exist_ok=True)
            (d / p).write_text(text)
        run(d, "add", "-A")
        run(d, "commit", "-qm", "c", "--allow-empty")
        if files is before:
            run(d, "checkout", "-q", "-b", branch)
    return d


@pytest.fixture
def small(tmp_path):
    return repository(tmp_path / "r", {"a.py": "a = 1\n"}, {"a.py": "a = 2\n", "b.py": "def b():\n    return 1\n", "dist/x.js": "x\n", "c.md": "c\n"})


def logging_git(tmp_path):
    """A Git that notes each of its calls."""
    log, path = tmp_path / "calls.log", tmp_path / "git-with-log"
    path.write_text(f'#!/bin/sh\nprintf "%s\\n" "$*" >> "{log}"\nexec git "$@"\n')
    path.chmod(0o755)
    return str(path), lambda: log.read_text().splitlines() if log.exists() else []


def test_a_commit_between_two_reads_changes_nothing(spark, small):
    feed = git.feed(spark, [git.Repo(1, str(small))])
    before = {r["file_ord"]: r["path"] for r in feed.files.collect()}
    (small / "a.py").unlink()
    (small / "0.py").write_text("z = 0\n")
    (small / "b.py").write_text("def other():\n    pass\n")
    run(small, "add", "-A")
    run(small, "commit", "-qm", "meanwhile")
    assert {r["file_ord"]: r["path"] for r in feed.files.collect()} == before
    found = {r["file_ord"]: r["patch"] for r in feed.raw_patches.collect()}
    assert {before[i] for i in found} == {"a.py", "b.py", "c.md"}  # dist/x.js is filtered
    assert all(p.startswith(f"diff --git a/{before[i]} b/{before[i]}\n") for i, p in found.items())
    assert {r["path"]: r["content"] for r in feed.sources.collect()} == {"a.py": "a = 2\n", "b.py": "def b():\n    return 1\n"}


def test_a_review_is_read_once(spark, small, tmp_path):
    """One diff and one reader of blobs, whatever is computed from them, and however often."""
    executable, calls = logging_git(tmp_path)
    feed = git.feed(spark, [git.Repo(1, str(small), executable=executable)])
    b = review.model(feed)
    assert b.files.count() == 3 and b.questions.count() == 3 and b.symbols.count() == 1
    b.notes.collect(), b.purposes.collect(), b.files.collect()
    made = calls()
    assert sum(" diff " in c for c in made) == 1 and sum("cat-file" in c for c in made) == 1
    assert sum("HEAD^{commit}" in c for c in made) == 1 and len(made) < 10


def test_submodules_and_settings_of_the_user(spark, tmp_path):
    dependency = repository(tmp_path / "dependency", {"v": "1\n"}, {"v": "2\n"})
    d = repository(tmp_path / "p", {"a.py": "a = 1\n", "z.py": "z = 1\n"}, {})
    run(d, "checkout", "-q", "main")
    run(d, "-c", "protocol.file.allow=always", "submodule", "add", "-q", str(dependency), "lib/dependency")
    run(d / "lib/dependency", "checkout", "-q", "main")
    run(d, "add", "-A")
    run(d, "commit", "-qm", "with a submodule")
    run(d, "checkout", "-q", "-B", "feature")
    run(d / "lib/dependency", "checkout", "-q", "feature")
    (d / "a.py").write_text("a = 2\n")
    (d / "z.py").write_text("z = 2\n")
    run(d, "add", "-A")
    run(d, "commit", "-qm", "moved")
    (tmp_path / "order").write_text("z.py\na.py\n")
    plain = sorted((r["path"], r["patch"]) for r in both(git.feed(spark, [git.Repo(1, str(d))])))
    assert [p for p, _ in plain] == ["a.py", "lib/dependency", "z.py"] and "+Subproject commit" in plain[1][1]
    for k, v in (("diff.submodule", "log"), ("diff.noprefix", "true"), ("diff.mnemonicPrefix", "true"), ("diff.orderFile", str(tmp_path / "order")), ("diff.context", "0"), ("color.ui", "always"), ("diff.renames", "false"), ("core.abbrev", "4")):
        run(d, "config", k, v)
    feed = git.feed(spark, [git.Repo(1, str(d))])
    assert feed.failures.count() == 0
    assert sorted((r["path"], r["patch"]) for r in both(feed)) == plain


def both(feed):
    return feed.files.join(feed.raw_patches, ["review_id", "file_ord"]).select("path", "patch").collect()


def test_working_tree(spark, small):
    (small / "b.py").write_text("def working():\n    return 2\n")
    feed = git.feed(spark, [git.Repo(1, str(small), include_uncommitted=True)])
    assert {r["path"]: r["content"] for r in feed.sources.collect()}["b.py"] == "def working():\n    return 2\n"
    assert feed.reviews.first()["includes_uncommitted"] and "+def working():" in {r["path"]: r["patch"] for r in both(feed)}["b.py"]


# --- selection and budget while reading


def patch(i, n):
    return b"diff --git a/%d b/%d\n" % (i, i) + b"+" + b"x" * n + b"\n"


def by_fold(sizes, per_file, total):
    out, used = [], 0
    for n in sizes:
        room = total - used
        why = "file" if n > per_file and room >= per_file else "aggregate" if n > room else "file" if n > per_file else None
        used += n if why is None else 0
        out.append(why)
    return out


def test_budget_while_reading_is_that_of_tables(spark):
    rows = [[3, 50, 7, 90, 20, 1, 30], [10] * 9, [200, 5, 5], [100, 60], [60, 100, 41, 40, 1]]
    for r, sizes in enumerate(rows):
        made = [patch(i, n) for i, n in enumerate(sizes)]
        data = b"".join(made)
        for per_file, total, size in itertools.product((40, 100, 1000), (60, 150, 1000), (7, 64, 10_000)):
            got = list(git.read_patches([data[i : i + size] for i in range(0, len(data), size)], per_file=per_file, total=total))
            want = by_fold([len(m) for m in made], per_file, total)
            assert [why for _, why in got] == want
            assert [p for p, _ in got] == [m if why is None else None for m, why in zip(made, want, strict=True)]
        table = spark.createDataFrame([(r, i, len(m)) for i, m in enumerate(made)], "review_id long, file_ord int, n_bytes long")
        folded = filtering.patch_budget(table, 100, 150).orderBy("file_ord").collect()
        assert [x["limit_reason"] for x in folded] == by_fold([len(m) for m in made], 100, 150)


def test_no_more_is_held_than_the_limits():
    def chunks():  # 64 MB of patches that are not wanted, too large, or beyond what is left
        for i in range(4):
            yield b"diff --git a b\n"
            for _ in range(256):
                yield b"+" + b"x" * 65_534 + b"\n"

    tracemalloc.start()
    got = list(git.read_patches(chunks(), lambda i: i != 0, per_file=1_000_000, total=1_500_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(None, None)] + [(None, "file")] * 3 and peak < 2_500_000


def test_limits_of_a_feed(spark, tmp_path):
    d = repository(tmp_path / "r", {"a": "a\n"}, {"big.py": "x = 1\n" * 500, "dist/huge.js": "y\n" * 5000, "one.py": "p = 1\n" * 50, "two.py": "q = 1\n" * 50})
    feed = git.feed(spark, [git.Repo(1, str(d))], per_file=1000, total=700)
    got = {r["path"]: (r["patch"] is None, r["limit_reason"]) for r in feed.files.join(feed.raw_patches, ["review_id", "file_ord"]).collect()}
    assert got == {"big.py": (True, "aggregate"), "one.py": (False, None), "two.py": (True, "aggregate")}
    _, _, p, _ = review.admitted(feed)
    assert [r["note"] for r in patches.collection_notes(p, 1000, 700).collect()] == ["Skipped patch hunks for 2 files because buffered patch data exceeds 700 bytes."]


def test_the_reader_filters_as_the_operator_does(spark):
    names = ["a.py", "package-lock.json", "x.min.js", "X.MIN.CSS", "dist", "note.md", "é.ts", "a.log", "yarn.lock", "vendor"]
    dirs = ["", "dist/", "src/", "a/node_modules/", "vendor/b/", "generated/", "Dist/", "src/gen/deep/", "build/"]
    all_ = [d + n for d in dirs for n in names]
    exclude = ["*.log", "src/gen/**", "/a.py", "note.md"]
    rows = [(1, i, p, all_[(i * 7) % len(all_)] if i % 3 == 0 else None, "modified", None) for i, p in enumerate(all_)]
    got = {r["file_ord"]: r["filter_reason"] for r in filtering.with_filter_reason(spark.createDataFrame(rows, FILES), exclude).collect()}
    low = P.Filter(exclude)
    assert got == {i: low.reason(p, old) for _, i, p, old, *_ in rows}
    assert {L.GENERATED, L.VENDORED, L.LOCKFILE, L.MINIFIED, L.EXCLUDED, None} == set(got.values())


# --- many repositories


def test_sources_of_a_large_repository_are_dealt_over_tasks(spark, tmp_path):
    d = repository(tmp_path / "r", {"a": "a\n"}, {f"m/f{i}.py": f"v = {i}\n" for i in range(600)} | {"m/link.py": "v = 0\n"})
    (d / "m/link.py").unlink()
    (d / "m/link.py").symlink_to("f1.py")
    (d / "m/f3.py").write_bytes(b"\xff\xfe")
    run(d, "add", "-A")
    run(d, "commit", "-qm", "more")
    executable, calls = logging_git(tmp_path)
    pins = git.pinned(spark, [git.Repo(5, str(d), executable=executable)])
    files = git.read_changes(pins).filter("relation = 'file'").select("review_id", "file_ord", "path", "mode", "blob").filter("path like '%.py'")
    got = git.read_sources(files, pins, blobs_a_task=100)
    rows = {r["path"]: (r["content"], r["note"]) for r in got.collect()}
    assert len(rows) == 601 and all(rows[f"m/f{i}.py"] == (f"v = {i}\n", None) for i in range(600) if i != 3)
    assert "not a regular file" in rows["m/link.py"][1] and "not UTF-8" in rows["m/f3.py"][1]
    readers = sum("cat-file" in c for c in calls())
    assert 4 <= readers <= 7 and sum(" diff " in c for c in calls()) == 1


def test_repositories_fail_alone(spark, small, tmp_path):
    detached = tmp_path / "detached"
    run(tmp_path, "clone", "-q", str(small), str(detached))
    run(detached, "checkout", "-q", "--detach")
    bad = repository(tmp_path / "bad", {"a.py": "a = 1\n"}, {"a.py": "a = 2\n", git.CONFIG_FILE: "questions: 9\n"})
    broken = repository(tmp_path / "broken", {"a.py": "a = 1\n"}, {"a.py": "a = 2\n"})
    blob = run(broken, "rev-parse", "HEAD:a.py").strip()
    (broken / ".git/objects" / blob[:2] / blob[2:]).unlink()
    (tmp_path / "no").mkdir()
    repos = [git.Repo(1, str(small)), git.Repo(2, str(tmp_path / "no")), git.Repo(3, str(detached)), git.Repo(4, str(small), base="nope"), git.Repo(5, str(bad)), git.Repo(6, str(broken)), git.Repo(7, str(small), questions=1)]
    feed = git.feed(spark, repos)
    failures, files, raw, _ = review.admitted(feed)
    found = {r["review_id"]: r["error"] for r in failures.collect()}
    assert found == {2: "NotARepository", 3: "DetachedHead", 4: "BaseNotFound", 5: "ConfigError", 6: "GitFailed"}
    assert {r["review_id"] for r in feed.reviews.collect()} == {1, 7}
    assert {r["review_id"] for r in files.collect()} == {r["review_id"] for r in raw.collect()} == {1, 7}
    assert {r["review_id"]: r["n_questions"] for r in feed.settings.collect()} == {1: 3, 7: 1}


def test_no_repositories(spark):
    feed = git.feed(spark, [])
    assert feed.files.count() == feed.failures.count() == feed.sources.count() == 0


def test_options_of_two_repositories(spark, tmp_path):
    """Each with exclusions, a number of questions and a follow-up of its own, in one job."""
    code = {"src/a.py": "def alpha():\n    return 2\n", "gen/b.py": "def b():\n    return 2\n", "src/c.py": "def c():\n    return 2\n"}
    one = repository(tmp_path / "one", {"x": "x\n"}, code | {git.CONFIG_FILE: "exclude: [gen/**]\nquestions: 1\n"})
    two = repository(tmp_path / "two", {"x": "x\n"}, code | {git.CONFIG_FILE: "exclude: ['src/c.*', '*.yml']\n"})
    feed = git.feed(spark, [git.Repo(1, str(one), follow_up=False), git.Repo(2, str(two))])
    b = review.model(feed)
    assert sorted((r["review_id"], r["path"]) for r in b.filtered.collect()) == [(1, "gen/b.py"), (2, git.CONFIG_FILE), (2, "src/c.py")]
    assert {r["path"] for r in feed.sources.filter("review_id = 1").collect()} == {"src/a.py", "src/c.py"}
    assert {r["review_id"]: r["n"] for r in b.questions.groupBy("review_id").agg(F.count("*").alias("n")).collect()} == {1: 1, 2: 3}
    answers = b.questions.select("review_id", F.col("id").alias("question_id"), F.lit("The function alpha changed.").alias("raw_text"), F.lit(False).alias("skipped"))
    g = review.assess(feed, b, answers)
    assert {r["review_id"] for r in g.follow_ups.collect()} == {2} and {r["review_id"] for r in g.markdown.collect()} == {1, 2}


def test_three_of_a_hundred_reviews_fail(spark):
    """Too many files, a header that cannot be read, exclusions that are no patterns: each is set aside with its reason."""
    ids = spark.range(100).withColumnRenamed("id", "review_id")
    n = F.when(F.col("review_id") == 10, 5).otherwise(2)
    files = ids.select("review_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("file_ord")).select("review_id", "file_ord", F.concat(F.lit("src/f"), "file_ord", F.lit(".py")).alias("path"), *[F.lit(None).cast("string").alias(c) for c in ("old_path", "language")], F.lit("modified").alias("status"))
    head = F.when((F.col("review_id") == 20) & (F.col("file_ord") == 1), "@@ what @@").otherwise("@@ -1 +1 @@")
    raw = files.select("review_id", "file_ord", F.concat(F.lit("diff --git a b\n"), head, F.lit("\n-x = 1\n+x = 2\n")).alias("patch"))
    sources = files.select("review_id", "path", F.lit("def f():\n    x = 2\n").alias("content"), F.lit(None).cast("string").alias("note"))
    reviews = ids.select("review_id", F.lit("f").alias("current_branch"), F.lit("m").alias("base_branch"))
    settings = ids.select("review_id", F.when(F.col("review_id") == 30, F.array(F.lit("[a"))).alias("exclude"), F.lit(None).cast("int").alias("n_questions"), F.lit(None).cast("boolean").alias("follow_up"))
    feed = review.Feed(reviews, files, raw, sources, settings)
    b = review.model(feed, review.Options(changed_files=4))
    found = {r["review_id"]: (r["error"], r["message"], r["details"]) for r in b.failures.collect()}
    assert found == {
        10: ("CollectionFailed", "More than 4 files are left to analyse.", "5 files"), 20: ("CollectionFailed", "A hunk header cannot be read.", "@@ what @@"),
        30: ("ConfigError", "The configuration is invalid.", "unclosed class in '[a'"),
    }
    assert b.questions.select("review_id").distinct().count() == b.purposes.count() == 97
    answers = b.questions.select("review_id", F.col("id").alias("question_id"), F.lit("f returns 2").alias("raw_text"), F.lit(False).alias("skipped"))
    g = review.assess(feed, b, answers.filter("review_id <> 40 or question_id <> 'failure'"))
    assert {r["review_id"]: r["error"] for r in g.failures.collect()} == {10: "CollectionFailed", 20: "CollectionFailed", 30: "ConfigError", 40: "IdsDiffer"}
    assert g.markdown.count() == 96 and g.assessments.count() == 3 * 96


def test_configurations_are_parsed_once_each(spark):
    rows = [(1, "base: x\n"), (2, "base: x\n"), (3, None), (4, "questions: 5\n"), (5, ""), (6, "exclude: ['a b/']\nquestions: 2\n")]
    got = {r["review_id"]: r for r in config.read_texts(spark.createDataFrame(rows, "review_id long, text string")).collect()}
    assert got[1]["base"] == got[2]["base"] == "x" and got[3]["problem"] is None and "questions" in got[4]["problem"]
    assert got[5]["exclude"] == [] and (got[6]["exclude"], got[6]["n_questions"]) == (["a b/"], 2)
    said = spark.createDataFrame([(1, "y", None, None, True), (9, None, "r.md", 1, None)], "review_id long, base string, report_path string, n_questions int, include_uncommitted boolean")
    e = {r["review_id"]: tuple(r)[1:5] for r in config.effective(said, config.read_texts(spark.createDataFrame(rows, "review_id long, text string"))).collect()}
    assert e[1] == ("y", "review-report.md", 3, True) and e[2] == ("x", "review-report.md", 3, False) and e[6][2] == 2 and e[9] == (None, "r.md", 1, False)


# --- extraction


def test_each_distinct_source_is_parsed_once(spark, tmp_path):
    rows = [(i, f"src/{i % 3}.py", f"def f{i % 4}():\n    return 1\n") for i in range(40)]
    src = spark.createDataFrame(rows, "review_id long, path string, content string")
    affected = src.select("review_id", "path", F.lit(2).alias("line"))
    seen = spark.sparkContext.accumulator(0)
    parse = extract.python_nodes

    def counted(sources):
        n = parse(sources)
        seen.add(sources.count())
        return n

    try:
        extract.python_nodes = counted
        got = extract.python_rows(src, affected).collect()
    finally:
        extract.python_nodes = parse
    assert seen.value == 4 and sorted((r["review_id"], r["name"]) for r in got) == sorted((i, f"f{i % 4}") for i, _, _ in rows)


def test_touched_intervals(spark):
    """Against every line by every interval, with ends, nested and equal intervals, and files without lines."""
    rng = random.Random(5)
    spans = [(r, p, a, a + rng.choice([0, 0, 1, 3, 30]), f"n{i}") for i, (r, p, a) in enumerate((rng.randrange(3), rng.choice("ab"), rng.randrange(40)) for _ in range(150))]
    lines = sorted({(rng.randrange(2), rng.choice("ab"), rng.randrange(60)) for _ in range(25)})
    got = extract.touched(spark.createDataFrame(spans, "review_id int, path string, line_start int, line_end int, name string"), spark.createDataFrame(lines, "review_id int, path string, line int"))
    assert sorted(map(tuple, got.collect())) == sorted(s for s in spans if any(x[:2] == s[:2] and s[2] <= x[2] <= s[3] for x in lines))
