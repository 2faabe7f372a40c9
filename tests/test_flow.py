"""Whole reviews: a repository with a shop's order flow, graded answers, reports; and the parts around them."""

import subprocess
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reviewlake.errors import BaseNotFound, CollectionFailed, ConfigError, DetachedHead, GitFailed, IdsDiffer, NotARepository, raised
from reviewlake.operators import grading, questions, report, selection, summarize
from reviewlake.operators.effects import CITATION, citation
from reviewlake.plans import review
from reviewlake.sources import config, git, transcript
from reviewlake.streaming import feed as stream

BEFORE = {
    "src/order_handler.ts": "export async function placeOrder(req: Order) {\n  return req;\n}\n",
    "src/stock_service.ts": "export async function reserveStock(item: Item) {\n  return item;\n}\n",
    "tests/order_handler.test.ts": "it('places', () => {\n  expect(1).toBe(1);\n});\n",
}
AFTER = {
    "src/order_handler.ts": 'import { orders } from "./orders";\n\nexport async function placeOrder(req: Order) {\n  const known = await orders.findByToken(req.token);\n  if (known) {\n    return known;\n  }\n  return reserveStock(req);\n}\n',
    "src/stock_service.ts": 'import { database } from "./database";\n\nexport async function reserveStock(item: Item) {\n  return database.transaction(async () => {\n    const bill = await stripe.charge(item.price);\n    await database.stock.insert({ bill });\n    return bill;\n  });\n}\n',
    "tests/order_handler.test.ts": 'it("returns a known order", async () => {\n  const r = await placeOrder({ token: "t" });\n  expect(r.token).toBe("t");\n});\n',
    "dist/app.js": "x\n",
}


def run(d, *args):
    subprocess.run(["git", "-C", str(d), *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    d = tmp_path_factory.mktemp("shop")
    run(d, "init", "-q")
    run(d, "checkout", "-q", "-b", "main")
    run(d, "config", "user.name", "t")
    run(d, "config", "user.email", "t@example.org")
    for files, message in ((BEFORE, "one"), (AFTER, "two")):
        if message == "two":
            run(d, "checkout", "-q", "-b", "feature")
        for p, text in files.items():
            (d / p).parent.mkdir(exist_ok=True)
            (d / p).write_text(text)
        run(d, "add", "-A")
        run(d, "commit", "-qm", message)
    return d


@pytest.fixture(scope="module")
def shop(spark, repo):
    feed = git.feed(spark, [git.Repo(1, str(repo))])
    return feed, review.model(feed)


def answers(spark, failure):
    rows = [
        (1, "behavior", "placeOrder calls orders.findByToken and returns the known order before reserveStock.", False),
        (1, "failure", failure, False),
        (1, "evidence", "tests/order_handler.test.ts checks placeOrder returns the known order. It does not cover a stock failure.", False),
    ]
    return spark.createDataFrame(rows, "review_id long, question_id string, raw_text string, skipped boolean")


def test_model(shop):
    _, b = shop
    assert [r["path"] for r in b.filtered.collect()] == ["dist/app.js"]
    assert [(r["name"], r["kind"]) for r in b.symbols.orderBy("symbol_ord").collect()] == [("placeOrder", "async function"), ("reserveStock", "async function")]
    assert [r["kind"] for r in b.effects.orderBy("effect_ord").collect()] == ["transaction boundary", "network call", "database write"]
    assert b.purposes.first()["purpose"] == "Likely updates `placeOrder` and `reserveStock` across 3 meaningful files, with transaction boundary and network call and other side-effect signals."
    assert [r["path"] for r in b.relevant.orderBy("place").collect()] == ["src/stock_service.ts", "src/order_handler.ts", "tests/order_handler.test.ts"]
    q = {r["id"]: r for r in b.questions.collect()}
    assert "`placeOrder`" in q["behavior"]["prompt"] and "partial success" in q["failure"]["rationale"]
    assert "`stripe.charge`" in q["failure"]["prompt"] and "`database.transaction`" in q["failure"]["prompt"]
    assert '"tests/order_handler.test.ts"' in q["evidence"]["prompt"]
    assert b.status.first()["status"] == "ok"


def test_graded_with_a_gap(spark, shop):
    feed, b = shop
    said = spark.createDataFrame([(1, "We reconcile pending charges.", False)], "review_id long, raw_text string, skipped boolean")
    g = review.assess(feed, b, answers(spark, "database.transaction rollback undoes stripe.charge, so retry is safe."), generated_at="2026-07-18 12:30:45", follow_up_answers=said)
    assert [r["label"] for r in g.assessments.orderBy("question_ord").collect()] == ["Strong", "Gap found", "Strong"]
    f = g.follow_ups.collect()
    assert [(r["id"], [c["symbol"] for c in r["references"]]) for r in f] == [("failure-follow-up", ["stripe.charge", "database.transaction"])]
    text = g.markdown.first()["markdown"]
    assert text.startswith("# Change Review Report\n\nBranch: feature\nBase branch: main\nModel mode: local heuristic\nGenerated: 2026-07-18T12:30:45+00:00\n")
    assert "- Prepare to discuss: Revisit the rollback claim" in text and text.endswith("- Evidence to cite: `tests/order_handler.test.ts`.\n")
    assert "## Follow-Up\n\n**Question**\n\n> To prepare for review" in text and "> We reconcile pending charges." in text


def test_all_strong_has_no_follow_up(spark, shop):
    feed, b = shop
    a = answers(spark, "stripe.charge can succeed before database.transaction rolls back. A retry could charge again, so reconciliation is needed.")
    g = review.assess(feed, b, a)
    assert {r["label"] for r in g.assessments.collect()} == {"Strong"}
    assert g.follow_ups.count() == 0


FAILURES = [
    ("The charge may need retry recovery.", "Strong"), ("The recharged request may need retry recovery.", "Uncertain"), ("src retry", "Uncertain"),
]
ROLLBACKS = [
    ("database.transaction rollback undoes processor.charge, so retry is safe.", True), ("The rollback never fails and undoes processor.charge; retry is needed.", True),
    ("The rollback does not undo processor.charge.", False), ("The rollback cannot automatically reverse the processor.charge", False), ("processor.charge is reverted by the rollback", True),
    ("processor.charge can succeed before the rollback", False),
]


def test_rollback_conflict(spark):
    from reviewlake.functions import text as T

    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ROLLBACKS)], "i int, t string")
    got = df.select("i", grading.rollback_conflict(T.normalize(F.col("t")), F.array(F.lit("processor charge"), F.lit("charge"))).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == [c for _, c in ROLLBACKS]


def small(spark, answers_, category="failure", symbol="charge", kind="network call", path="src/pay.py", skipped=False):
    n = len(answers_)
    ids = spark.range(n).select(F.col("id").alias("review_id"))
    files = ids.select("review_id", F.lit(0).alias("file_ord"), F.lit("src/pay.py").alias("path"), F.lit(False).alias("is_test"))
    c = citation("call", F.lit(path), F.lit(symbol), F.lit("@@"), F.lit(1), F.lit(1))
    found = ids.select("review_id", F.lit(0).alias("effect_ord"), F.lit(kind).alias("kind"), F.array(c).alias("evidence"))
    none = spark.createDataFrame([], "review_id long, symbol_ord int, path string, name string, line_start int")
    calls = spark.createDataFrame([], "review_id long, call_ord int, path string, name string, line_start int")
    q = ids.select("review_id", F.lit(0).alias("question_ord"), F.lit("q").alias("id"), F.lit(category).alias("category"), F.array(c).alias("references"))
    a = spark.createDataFrame([(i, "q", t, skipped) for i, t in enumerate(answers_)], "review_id long, question_id string, raw_text string, skipped boolean")
    return grading.grade(q, a, files, none, calls, found).orderBy("review_id").collect()


def test_failure_answers(spark):
    assert [r["label"] for r in small(spark, [t for t, _ in FAILURES])] == [x for _, x in FAILURES]


def test_review_of_many_concepts(spark):
    """20,000 calls: those that the answer names are matched in order, what the question cites first, each source once."""
    n, said = 20_000, [3, 17_000, 19_999]
    files = spark.createDataFrame([(1, 0, "src/pay.py", False)], "review_id long, file_ord int, path string, is_test boolean")
    none = spark.createDataFrame([], "review_id long, symbol_ord int, path string, name string, line_start int")
    calls = spark.range(n).select(F.lit(1).cast("long").alias("review_id"), F.col("id").cast("int").alias("call_ord"), F.lit("src/pay.py").alias("path"), F.format_string("send.unit%05d", "id").alias("name"), F.lit(1).alias("line_start"))
    c = lambda name: citation("call", F.lit("src/pay.py"), F.lit(name), F.lit("@@"), F.lit(1), F.lit(1))
    found = spark.range(1).select(F.lit(1).cast("long").alias("review_id"), F.lit(0).alias("effect_ord"), F.lit("network call").alias("kind"), F.array(c("send.unit00003")).alias("evidence"))
    q = spark.range(1).select(F.lit(1).cast("long").alias("review_id"), F.lit(0).alias("question_ord"), F.lit("q").alias("id"), F.lit("behavior").alias("category"), F.array(c("send.unit17000"), c("send.unit17000")).alias("references"))
    a = spark.createDataFrame([(1, "q", " and ".join(f"send.unit{i:05d}" for i in said), False)], "review_id long, question_id string, raw_text string, skipped boolean")
    got = grading.grade(q, a, files, none, calls, found).collect()
    assert [x["symbol"] for x in got[0]["matched_evidence"]] == ["send.unit17000", "send.unit00003", "send.unit19999"]
    assert [x["symbol"] for x in got[0]["evidence"]] == ["send.unit17000", "send.unit00003", "send.unit19999"] and got[0]["label"] == "Strong"


def test_claims_name_phrases_that_overlap(spark):
    """Phrases that hold words of the claim, or stand in it more than once, are found as whole words only."""
    from reviewlake.functions import text as T

    said = [("rollback undoes the rollback handler", "rollback handler", True), ("rollback cancels run run run", "run run", True), ("rollback reverts the external effect", "external effect", True),
            ("rollback reverts recharge", "charge", False), ("rollback never reverts charge but rollback reverts charge", "charge", False), ("charge two is reverted by the rollback", "charge", True),
            ("rollback " + "x" * 61 + " reverts charge", "charge", False), ("discharge is reverted by the rollback", "charge", False)]
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(said)], "i int, t string, p string")
    got = df.select("i", grading.rollback_conflict(T.normalize(F.col("t")), F.array("p")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == [c for _, _, c in said]


def test_uncertain_answers(spark):
    skipped = small(spark, ["charge retry", None], skipped=True)
    assert {(r["label"], r["confidence"]) for r in skipped} == {("Uncertain", "low")} and "skipped" in skipped[0]["uncertainty_notes"][0]
    outside = small(spark, ["charge retry"], path="other.py")
    assert outside[0]["label"] == "Uncertain" and "no citations" in outside[0]["uncertainty_notes"][0] and outside[0]["evidence"] == []
    assert small(spark, ["charge retry"], category="follow_up")[0]["gaps"] == ["Connect the response explicitly to each cited changed-file detail."]


def test_follow_up_ranking(spark):
    ref = "array(named_struct('kind','call','file_path','a','symbol','s','hunk_header',null,'line_start',1,'line_end',1,'note',null))"
    rows = [("e", "evidence", "Gap found"), ("b", "behavior", "Gap found"), ("f1", "failure", "Partial"), ("f2", "failure", "Gap found"), ("f3", "failure", "Gap found")]
    df = spark.createDataFrame([(1, i, *r, [" gap "]) for i, r in enumerate(rows)], "review_id long, question_ord int, id string, category string, label string, gaps array<string>")
    a = df.select("review_id", F.col("id").alias("question_id"), "label", "gaps", F.expr(ref).alias("evidence"))
    files = spark.createDataFrame([(1, "a")], "review_id long, path string")
    got = selection.follow_ups(df.select("review_id", "question_ord", "id", "category"), a, files).collect()
    assert [r["id"] for r in got] == ["f2-follow-up"] and "this gap: gap What retry" in got[0]["prompt"]
    assert selection.follow_ups(df.select("review_id", "question_ord", "id", "category"), a, files.filter("path = 'z'")).count() == 0


def test_empty_report(spark):
    empty = f"struct<category: string, prompt: string, references: array<{CITATION}>, raw_text: string, skipped: boolean>"
    df = spark.createDataFrame([(1, {"branch": "b"}, "P.")], "review_id long, metadata map<string,string>, purpose string").select(
        "*", F.lit(None).cast("array<string>").alias("notes"), F.lit(None).cast("array<string>").alias("points"),
        F.lit(None).cast(f"array<{empty.replace('skipped: boolean', f'skipped: boolean, assessment: struct<label: string, summary: string, confidence: string, strengths: array<string>, gaps: array<string>, evidence: array<{CITATION}>, uncertainty_notes: array<string>>')}>").alias("rounds"),
        F.lit(None).cast(f"struct<prompt: string, references: array<{CITATION}>, raw_text: string, skipped: boolean>").alias("follow_up"),
    )
    want = "# Change Review Report\n\nBranch: b\nBase branch: \nModel mode: \nGenerated: \n\n## Change Summary\n\nP.\n\n## Questions and Answers\n\n## Review Talking Points\n\n- No review talking points generated.\n"
    assert report.markdown(df).first()["markdown"] == want


def test_report_files(spark, tmp_path):
    def written(rows):
        report.write(spark.createDataFrame(rows, "review_id long, markdown string"), str(tmp_path / "r"))
        return {f.parent.name: f.read_text() for f in (tmp_path / "r").glob("review_id=*/*.txt")}

    assert written([(1, "# A\n\nb\n"), (2, "two\n")]) == {"review_id=1": "# A\n\nb\n", "review_id=2": "two\n"}
    # a later batch replaces its own reviews and leaves the others
    assert written([(2, "two again\n"), (3, "three\n")]) == {"review_id=1": "# A\n\nb\n", "review_id=2": "two again\n", "review_id=3": "three\n"}


def test_documentation_only(spark):
    files = spark.createDataFrame([(1, True), (2, False)], "review_id long, is_documentation boolean")
    usable = spark.createDataFrame([], "review_id long")
    assert {(r["review_id"], r["status"]) for r in questions.review_status(files, usable).collect()} == {(1, "documentation_only"), (2, "no_evidence")}
    with pytest.raises(ValueError):
        questions.first_questions(usable, 4)


def test_effect_groups_keep_the_first_description(spark):
    c = lambda p, s: f"named_struct('kind','call','file_path','{p}','symbol','{s}','hunk_header',null,'line_start',1,'line_end',1,'note',null)"
    e = spark.range(1).selectExpr("1L review_id", f"explode(array(struct(0 effect_ord, 'k' kind, 'first' description, array({c('a', 'x')}, {c('z', 'x')}) evidence), struct(1 effect_ord, 'k' kind, 'second' description, array({c('a', 'x')}, {c('a', 'y')}) evidence))) x").select("review_id", "x.*")
    got = summarize.effects_by_kind(e, spark.createDataFrame([(1, "a")], "review_id long, path string")).collect()
    assert len(got) == 1 and got[0]["description"] == "first" and [c["symbol"] for c in got[0]["evidence"]] == ["x", "y"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("first line\r\nsecond\rline\n\n", [("first line\nsecond\rline", False), ("", True), ("", True)]),
        ("\n", [("", True)] * 3),
        ("  \n\t\n\n", [("  \n\t", False), ("", True), ("", True)]),
        ("partial\nstill partial", [("partial\nstill partial", False), ("", True), ("", True)]),
        ("a\n\n\nb\n\n", [("a", False), ("", True), ("b", False)]),
        ("", [("", True)] * 3),
    ],
)
def test_transcripts(spark, text, want):
    got = transcript.parse(spark.createDataFrame([(1, text)], "review_id long, text string")).orderBy("question_ord").collect()
    assert [(r["raw_text"], r["skipped"]) for r in got] == want


BAD = [
    "base: 1", "base: ''", "report_path: []", "questions: 0", "questions: 4", "questions: true", "questions: '2'", "include_uncommitted: 1", "exclude: x", "exclude: ['']",
    "exclude: ['!x']", "exclude: ['a/../b']", "exclude: ['# c']", "nope: 1", "- a", "a: [", "exclude: ['[a']",
]


@pytest.mark.parametrize("text", BAD)
def test_bad_config(text):
    with pytest.raises(ConfigError):
        config.parse(text)


def test_config(tmp_path):
    assert config.load(tmp_path / "none.yml") == config.Config()
    assert config.parse("") == config.Config()
    c = config.parse("base: dev\nquestions: 2\nreport_path: out/r.md\nexclude: ['*.log']\n", Path("/p"))
    assert (c.base, c.questions, c.report_path, c.exclude) == ("dev", 2, "/p/out/r.md", ("*.log",))
    e = config.resolve(c, base="x", directory=Path("/w"))
    assert (e.base, e.questions, e.report_path, e.include_uncommitted) == ("x", 2, Path("/p/out/r.md"), False)
    assert config.resolve(config.Config(), report_path="r.md", directory=Path("/w")).report_path == Path("/w/r.md")


def test_git_errors(repo, tmp_path):
    with pytest.raises(NotARepository):
        git.detect(str(tmp_path))
    with pytest.raises(BaseNotFound):
        git.base_branch(str(repo), "nope")
    with pytest.raises(BaseNotFound):
        git.base_branch(str(repo), " ")
    with pytest.raises(CollectionFailed):
        git.parse_metadata(b":100644 100644 a b X\0p")
    with pytest.raises(CollectionFailed):
        git.parse_metadata(b":1 1 a b M\0p\0:1 1 a b M\0q", most=1)
    with pytest.raises(CollectionFailed):
        git.split_output(b"abc")
    clone = tmp_path / "c"
    run(tmp_path, "clone", "-q", str(repo), str(clone))
    run(clone, "checkout", "-q", "--detach")
    with pytest.raises(DetachedHead):
        git.detect(str(clone))


def test_git_parsing():
    meta, found = git.split_output(b":1 1 a b R100\0old\0new\0:1 1 a b T\0t\0\0diff --git a\n+x\ndiff --git b\n+diff --git c\n")
    assert git.parse_metadata(meta) == [git.Changed("new", "old", "renamed", "1", "b"), git.Changed("t", None, "modified", "1", "b")]
    assert found == [b"diff --git a\n+x\n", b"diff --git b\n+diff --git c\n"]
    assert git.split_output(b"") == (b"", [])


def test_git_sources(repo, tmp_path):
    head = subprocess.run(["git", "-C", str(repo), "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    assert git.read_source(str(repo), head, "dist/app.js", False) == ("x\n", None)
    assert "exceeds 1 bytes" in git.read_source(str(repo), head, "dist/app.js", False, most=1)[1]
    assert "unavailable" in git.read_source(str(repo), head, "nope", False)[1]
    (repo / "link").symlink_to("dist/app.js")
    assert "not a regular file" in git.read_source(str(repo), head, "link", True)[1]
    (repo / "link").unlink()


def test_stream(spark, tmp_path):
    rows = [(1, 0, "dist/a.js", None, "modified", None), (1, 1, "src/a.py", None, "modified", None)]
    schema = "review_id long, file_ord long, path string, old_path string, status string, language string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = stream.run_batches(stream.read_files(spark, str(tmp_path / "in")), stream.filtered, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = {r["path"]: r["filter_reason"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"dist/a.js": "generated directory", "src/a.py": None}


def test_notes_in_order(spark):
    files = spark.createDataFrame([(1, 0, "a.go", None, "modified", None), (1, 1, "b.py", None, "modified", None), (1, 2, "c.bin", None, "modified", None), (1, 3, "d.ts", None, "modified", None), (1, 4, "e.js", None, "added", None)], "review_id long, file_ord int, path string, old_path string, status string, language string")
    hunk = "diff --git a b\n@@ -1 +1,2 @@\n+x(1)\n+y(2)\n"
    raw = spark.createDataFrame([(1, 0, hunk), (1, 1, hunk), (1, 2, "diff --git\nBinary files a and b differ\n"), (1, 3, hunk + "+" + "z" * 300 + "\n"), (1, 4, hunk)], "review_id long, file_ord int, patch string")
    sources = spark.createDataFrame([(1, "b.py", "def (", None), (1, "d.ts", "x(1)\ny(2)\n", None), (1, "e.js", None, "No source.")], "review_id long, path string, content string, note string")
    feed = review.Feed(spark.createDataFrame([(1, "f", "m")], "review_id long, current_branch string, base_branch string"), files, raw, sources)
    b = review.model(feed, review.Options(per_patch_bytes=200))
    assert b.notes.first()["notes"] == [
        "Symbol-level analysis was unavailable for Go (.go); any symbols inferred from hunk context are heuristic.", 'Skipped patch hunks for binary file "c.bin".',
        'Skipped patch hunks for "d.ts" because its patch exceeds 200 bytes.', 'Could not parse "b.py" as Python; symbol extraction may be incomplete.', "No source.",
        'JavaScript/TypeScript symbol extraction is heuristic for: "d.ts".',
    ]


def test_presented(spark, shop):
    from reviewlake.operators import present

    feed, b = shop
    text = present.overview(feed.reviews, b.files, b.filtered).first()["overview"]
    assert "Branch: feature -> main" in text and "Changes: 4 total, 3 analyzed, 1 filtered" in text and '  - "dist/app.js": generated directory' in text
    text = present.summary(b.purposes, b.relevant, b.files, b.by_kind, b.notes).first()["summary"]
    assert text.startswith("Purpose: Likely updates") and '  - network call: ' in text and "heuristic for" in text


def test_hook_and_starter(repo, tmp_path):
    from reviewlake.sources import setup

    path = tmp_path / "hooks" / "pre-push"
    script = setup.hook_script("a b")
    assert "--base 'a b'" in script and subprocess.run(["sh", "-n", "-c", script], check=False).returncode == 0
    assert [setup.install_hook(path, script), setup.install_hook(path, script), setup.install_hook(path, setup.hook_script())] == ["installed", "already-current", "updated"]
    path.write_text("#!/bin/sh\n")
    with pytest.raises(Exception, match="not managed"):
        setup.install_hook(path, script)
    assert setup.install_hook(path, script, force=True) == "updated"
    assert setup.hook_path(str(repo)).name == "pre-push"
    setup.write_starter(tmp_path / "c.yml")
    assert config.load(tmp_path / "c.yml") == config.Config()
    with pytest.raises(ConfigError):
        setup.write_starter(tmp_path / "c.yml")


def test_answers_must_match_questions_by_id(spark, shop):
    """A review whose answers do not match is set aside, with nothing graded or reported; others go on."""
    feed, b = shop
    sound = answers(spark, "x")
    for rows, why in ((sound.filter("question_id <> 'failure'"), "must match"), (sound.unionByName(sound.limit(1)), "Answer IDs must be unique"), (sound.withColumn("review_id", F.lit(2).cast("long")), "must match")):
        g = review.assess(feed, b, rows)
        found = {r["review_id"]: r for r in g.failures.collect()}
        assert found[1]["error"] == "IdsDiffer" and why in found[1]["message"]
        assert g.assessments.count() == g.markdown.filter("review_id = 1").count() == 0
        assert isinstance(raised(found[1]), IdsDiffer)


def test_output_is_split_alike_however_it_comes():
    meta, patches = b":1 1 a b M\0p\0:1 1 a b M\0q", [b"diff --git a\n+x\n", b"diff --git b\n+\n+diff --git no\n", b"diff --git c\n"]
    data = meta + b"\0\0" + b"".join(patches)
    for size in range(1, len(data) + 1):
        chunks = iter([data[i : i + size] for i in range(0, len(data), size)])
        found, rest = git.read_metadata(chunks)
        assert (found, list(git.read_patches([rest, *chunks]))) == (meta, [(p, None) for p in patches])
    assert list(git.read_patches([data[len(meta) + 2 :]], lambda i: i == 1)) == [(None, None), (patches[1], None), (None, None)]


def test_metadata_limit_holds_while_reading():
    def endless():
        while True:
            yield b":1 1 a b M\0p\0"

    with pytest.raises(CollectionFailed, match="too large"):
        git.read_metadata(endless(), most=10_000)


def test_failures_of_git_are_told(repo):
    with pytest.raises(GitFailed, match="diff"):
        list(git.streamed(str(repo), "diff", "nosuchref", "--"))
    assert next(git.streamed(str(repo), "log", size=3))  # and a reader may stop early
