"""Rules on small cases: paths, filters, patches, extraction, effects."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlake.functions import paths as P
from reviewlake.functions import text as T
from reviewlake.operators import effects, extract, filtering, patches

FILTERED = [
    ("dist/app.js", None, "generated directory"), ("frontend/build/index.html", None, "generated directory"), ("web/.next/server/app.js", None, "generated directory"),
    ("node_modules/package/index.js", None, "vendored dependency"), ("src/vendor/library/module.py", None, "vendored dependency"), ("workspace/uv.lock", None, "lockfile"),
    ("static/app.MIN.js", None, "minified asset"), ("static/config.min.cjs", None, "minified asset"), ("src/build.py", None, None), ("src/vendor_tools.py", None, None),
    ("Dist/app.js", None, None), ("dist/app.js", "src/app.js", None), ("src/app.js", "vendor/app.js", None), ("dist/app.js", "build/app.js", "generated directory"),
    ("packages/web/generated/client/api.py", None, "configured exclusion"), ("archive/old.py", "src/current.py", None), ("archive/new.py", "archive/old.py", "configured exclusion"),
]


def test_file_filter(spark):
    df = spark.createDataFrame([(1, i, p, o) for i, (p, o, _) in enumerate(FILTERED)], "review_id long, file_ord int, path string, old_path string")
    got = filtering.with_filter_reason(df, ["packages/*/generated/**", "archive/**"]).orderBy("file_ord").collect()
    assert [r["filter_reason"] for r in got] == [x[2] for x in FILTERED]


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("*.log", ["a.log", "x/y.log", "d.log/z"], ["a.logs"]),
        ("/top", ["top", "top/x"], ["a/top"]),
        ("doc/", ["doc/x", "a/doc/y"], ["doc"]),
        ("a/**/b", ["a/b", "a/x/b", "a/x/y/b/c"], ["x/a/b"]),
        ("**/foo", ["foo", "x/foo", "x/y/foo/z"], ["foox"]),
        ("f?.[ch]", ["f1.c", "x/f2.h"], ["f10.c", "f1.d"]),
        ("f[!a].py", ["fb.py"], ["fa.py"]),
        ("abc/**", ["abc/x", "abc/x/y"], ["abc", "x/abc/y"]),
    ],
)
def test_ignore_patterns(pattern, yes, no):
    import re

    r = re.compile(P.ignore_regex(pattern))
    assert all(r.search(p) for p in yes)
    assert not any(r.search(p) for p in no)


def test_ignore_pattern_refusals():
    assert P.ignore_regex("# note") is None
    assert P.ignore_regex("  ") is None
    with pytest.raises(ValueError):
        P.ignore_regex("!x")


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_documentation_and_tests(spark):
    yes = ["docs/guide.txt", "packages/DoCs/setup.yaml", "README.MD", "notes/design.MarkDown", "PLAN", "release-plan.txt", "IMPLEMENTATION_PLAN.yaml"]
    assert column(spark, [*yes, "src/explain.py", "src/planner.py"], P.is_documentation) == [True] * len(yes) + [False] * 2
    names = ["Tests/x.go", "a/test_x.py", "a/x_test.py", "a/x.test.ts", "a/x.spec.js", "a/testing.py", "tests"]
    assert column(spark, names, P.is_test) == [True] * 5 + [False] * 2


def test_suffix_and_stem(spark):
    names = ["a/.gitignore", "x.test.ts", "Makefile", "a.b/c"]
    assert column(spark, names, P.suffix) == ["", ".ts", "", ""]
    assert column(spark, names, P.stem) == [".gitignore", "x.test", "Makefile", "c"]


def test_normalize(spark):
    got = column(spark, ["It doesn't; can't", "HTTPServer handleRequest2", "  A--b  ", ""], T.normalize)
    assert got == ["it does not can t", "httpserver handle request2", "a b", ""]


def test_phrases(spark):
    values = ["checkout.py", "src/checkout.py", "api.getUserBy", "charge", "post", "payments.findByKeyName", "main"]
    got = column(spark, values, T.phrases)
    assert got == [["checkout py"], ["src checkout py", "checkout py", "checkout"], ["api get user by", "get user by", "user by"], ["charge"], [], ["payments find by key name", "find by key name", "key name"], []]


def test_quoting(spark):
    import json

    values = ["plain", 'q"\\', "é\n\t", "漢😀", "\x7f\x01", ""]
    assert column(spark, values, T.json_quoted) == [json.dumps(v, ensure_ascii=True) for v in values]
    assert column(spark, ["a", "`a", "a``b"], T.inline_code) == ["`a`", "`` `a ``", "```a``b```"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=12), min_size=1, max_size=20))
def test_json_quoting_like_python(spark, values):
    import json

    values = [v.encode("utf-8", "ignore").decode() for v in values]
    assert column(spark, values, T.json_quoted) == [json.dumps(v, ensure_ascii=True) for v in values]


def test_lists(spark):
    assert column(spark, [["a"], ["a", "b"], ["a", "b", "c"], []], T.listed, "array<string>") == ["a", "a and b", "a, b, and c", ""]
    assert column(spark, [["a", "b", "c", "d", "e", "f", "g"]], T.path_summary, "array<string>") == ['"a", "b", "c", "d", "e", and 2 more']


def test_budget_is_greedy(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([500, 500, 200, 100])], "review_id long, file_ord int, n_bytes long")
    got = filtering.patch_budget(df, 900, 800).orderBy("file_ord").collect()
    assert [r["limit_reason"] for r in got] == [None, "aggregate", None, None]
    over = spark.createDataFrame([(1, 0, 3000), (1, 1, 10)], "review_id long, file_ord int, n_bytes long")
    assert [r["limit_reason"] for r in filtering.patch_budget(over, 2000, 5000).orderBy("file_ord").collect()] == ["file", None]
    with pytest.raises(ValueError):
        filtering.patch_budget(df, 0, 1)


def hunks_of(spark, patch, path="a.py"):
    return patches.split_hunks(spark.createDataFrame([(1, 0, path, patch)], "review_id long, file_ord int, path string, patch string"))


def brute_affected(text):
    new, out = None, set()
    for line in text.split("\n"):
        if line.startswith("@@ "):
            new = int(line.split("+")[1].split(" ")[0].split(",")[0])
        elif new is not None and line:
            if line[0] == "+":
                out.add(new)
                new += 1
            elif line[0] == "-":
                out |= {n for n in (new, new - 1) if n > 0}
            elif line[0] != "\\":
                new += 1
    return out


def test_hunks_and_affected_lines(spark):
    text = "diff --git a b\n@@ -1,2 +1 @@ def f():\n-x\n y\n+z\n\\ No newline\n@@ -9 +10,3 @@\n+a\n\n-b\u2028c\n d\n"
    h = hunks_of(spark, text).orderBy("hunk_ord").collect()
    assert [(r["old_start"], r["old_lines"], r["new_start"], r["new_lines"]) for r in h] == [(1, 2, 1, 1), (9, 1, 10, 3)]
    assert h[0]["header"] == "@@ -1,2 +1 @@ def f():"
    assert "".join(r["patch"] for r in h) == text[text.index("@@") :]
    got = {r["line"] for r in patches.affected_lines(hunks_of(spark, text)).collect()}
    assert got == brute_affected(text)


def test_bad_hunk_header(spark):
    h = hunks_of(spark, "@@ -1 +1 @@\n+a\n@@ nonsense @@\n+a\n@@ more @@\n")
    assert [r["new_start"] for r in h.orderBy("hunk_ord").collect()] == [1, None, None]
    assert [tuple(r) for r in patches.unreadable(h).collect()] == [(1, "@@ nonsense @@")]


def test_binary(spark):
    assert column(spark, ["GIT binary patch\nx", "a\nBinary files x and y differ\r\n", "+Binary files", "a\u2028GIT binary patch"], patches.is_binary) == [True, True, False, False]


DECLARED = [
    ("Future<void> refreshStatus() async {", ("refreshStatus", "function")), ("func (service *Service) Refresh(ctx context.Context) error {", ("Refresh", "function")),
    ("pub fn reconcile_order(order: &Order) -> Result<()> {", ("reconcile_order", "function")), ("const char *format_status(int value) {", ("format_status", "function")),
    ("export default async function* streamTasks() {", ("streamTasks", "function")), ("public override string FormatStatus(int value) {", ("FormatStatus", "function")),
    ("extension StatusText on String {", ("StatusText", "extension")), ("record PaymentResult(String id) {}", ("PaymentResult", "record")), ("type Server struct {", ("Server", "struct")),
    ("if (ready) {", None), ("refreshStatus();", None), ("result = refreshStatus();", None), ("def incomplete(", None), ("class CheckoutService is described here", None),
    ("Future<void> Service.refreshStatus() {", None), ("async def f(a, b):", ("f", "function")), ("", None),
]


def test_hunk_declarations(spark):
    got = column(spark, [f"@@ -1 +1 @@ {d}" for d, _ in DECLARED], extract.hunk_declaration)
    assert [None if g is None else (g["name"], g["kind"]) for g in got] == [want for _, want in DECLARED]


def test_hunk_symbols_once_a_file(spark):
    text = "@@ -1 +5 @@ def f():\n+a\n@@ -9 +10 @@ def f():\n+a\n@@ -9 +30 @@ class F:\n+b\n"
    got = extract.hunk_symbols(hunks_of(spark, text)).orderBy("hunk_ord").collect()
    assert [(r["name"], r["line_start"]) for r in got] == [("f", 5), ("F", 30)]


def test_python_rows(spark):
    source = "import json\nimport requests\nfrom payments.gateway import charge\nfrom . import x as y\n\n\nasync def create_payment(a):\n    charge(a)\n    requests.post(a)\n    return a().b()\n"
    src = spark.createDataFrame([(1, "a.py", source), (1, "b.py", "def (")], "review_id long, path string, content string")
    affected = spark.createDataFrame([(1, "a.py", 8), (1, "a.py", 9)], "review_id long, path string, line int")
    rows = extract.python_rows(src, affected).orderBy("path", "ord").collect()
    assert [(r["class"], r["name"], r["kind"], r["line_start"], r["local_name"]) for r in rows if r["path"] == "a.py"] == [
        ("import", "json", "import", 1, "json"), ("import", "requests", "import", 2, "requests"), ("import", "payments.gateway.charge", "import", 3, "charge"),
        ("import", ".x", "import", 4, "y"), ("symbol", "create_payment", "async function", 7, None), ("call", "charge", "call", 8, None), ("call", "requests.post", "call", 9, None),
    ]
    assert [r["class"] for r in rows if r["path"] == "b.py"] == ["error"]


def test_js_calls(spark):
    lines = ["if (a) { go(); }", "function run(x) { return x.y(1) }", "new class Foo (", "foo(async () => {", "expect(x).toBe(y)", "catch (e) {", "this.#p.q()"]
    df = spark.createDataFrame([(1, "a.ts", i + 1, x) for i, x in enumerate(lines)], "review_id long, path string, line_no int, line string")
    affected = df.select("review_id", "path", F.col("line_no").alias("line"))
    got: dict = {}
    for r in extract.js_calls(df, affected).orderBy("line_no", "k").collect():
        got.setdefault(r["line_no"], []).append(r["name"])
    assert got[1] == ["go"] and got[2] == ["x.y"] and got[4] == ["foo", "async"] and got[5] == ["expect", "toBe"] and 3 not in got and 6 not in got


def brute_end(lines, d):
    depth, seen = 0, False
    for i in range(d, len(lines) + 1):
        seen |= "{" in lines[i - 1]
        if seen:
            depth += lines[i - 1].count("{") - lines[i - 1].count("}")
            if depth <= 0:
                return i
    return d


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("{}x", max_size=4), min_size=1, max_size=15))
def test_block_ends(spark, lines):
    df = spark.createDataFrame([(1, "a.ts", i + 1, x) for i, x in enumerate(lines)], "review_id long, path string, line_no int, line string")
    got = extract.block_ends(df, df.select("review_id", "path", "line_no")).orderBy("line_no").collect()
    assert [r["end_line"] for r in got] == [brute_end(lines, i + 1) for i in range(len(lines))]


KINDS = [
    ("session.save", "database write"), ("transaction.atomic", "transaction boundary"), ("requests.post", "network call"), ("path.write_text", "file write"),
    ("queue.enqueue", "message publish"), ("session.add", "database write"), ("cursor.execute", "database write"), ("api.get", "network call"), ("client.post", "network call"),
    ("config.update", None), ("response.write", None), ("git.commit", None), ("items.insert", None), ("database_update_message", None), ("republishStatus", None), ("fetching", None),
    ("db.commit", "transaction boundary"), ("...", None),
]


def test_side_effects(spark):
    none = F.lit(None).cast("string")
    assert column(spark, [k for k, _ in KINDS], lambda c: effects.side_effect(c, none, F.lit(False))) == [k for _, k in KINDS]


def test_aliases(spark):
    calls = spark.createDataFrame([(1, 0, "a.py", "r.post", 1), (1, 1, "a.py", "post", 1), (1, 2, "a.py", "transport.get", 1), (1, 3, "b.py", "remote.post", 1)], "review_id long, call_ord int, path string, name string, line_start int")
    imports = spark.createDataFrame(
        [(1, 0, "a.py", "requests", "r"), (1, 1, "a.py", "requests.post", "post"), (1, 2, "a.py", "httpx", "transport"), (1, 3, "a.py", "requests", "remote")],
        "review_id long, ref_ord int, path string, name string, local_name string",
    )
    got = effects.with_alias(calls, imports).withColumn("k", effects.side_effect(F.col("name"), F.col("target"), F.lit(False))).orderBy("call_ord").collect()
    assert [r["k"] for r in got] == ["network call"] * 3 + [None]


@pytest.mark.parametrize(
    ("lines", "writes"),
    [(['open("a", "w")'], True), (["open(", '    "a",', '    mode="a",', ")"], True), (['open("a", "r")'], False), (['open("a")'], False), (["open("], False), (['x = open(p, m)'], False), (['io.open("a", "r+")'], True)],
)
def test_open_modes(lines, writes):
    assert effects.opens_to_write(lines) is writes


def test_dedupe_and_cap(spark):
    rows = spark.createDataFrame([(1, 0, "k", "a", "X", "h"), (1, 1, "k", "a", "x", "h"), (1, 2, "k", "a", "y", None)], "review_id long, call_ord int, kind string, path string, name string, hunk_header string")
    kept, omitted = effects.deduped(rows, most=1)
    assert [r["call_ord"] for r in kept.collect()] == [0] and omitted.first()["omitted"] == 1
    again, none = effects.deduped(rows, existing=kept, most=1)
    assert again.count() == 0 and none.first()["omitted"] == 1
