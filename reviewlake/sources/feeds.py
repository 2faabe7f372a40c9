"""Change feeds derived from the given tables.

Those tables hold no patches or source code, so queries start from stand-in rows: deterministic projections of a table,
written once in SQL that Spark and DuckDB both read. The operators applied to them are the real ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def pick(expr: str, values: list[str]) -> str:
    """SQL for the value at ``expr`` modulo the number of values."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE ({expr}) % {len(values)} {whens} END)"


DIRS = ["src/", "dist/", "lib/api/", "node_modules/x/", "docs/", "tests/", "web/.next/", "", "pkg/vendor/", "Src/__Tests__/", "generated/a/", "app/Docs/", "src/build/"]
SUFFIXES = [".py", ".ts", ".md", ".min.js", ".go", ".JSX", ".test.ts", ".unknown", "", ".yaml", "_test.py"]
_NAME = "'f' || CAST(event_id % 97 AS STRING) || " + pick("event_id", SUFFIXES)
_DIR, _OLD_DIR = pick("event_id", DIRS), pick("event_id + 3", DIRS)

#: One row per event: a changed file of the review that is its user.
FILES = f"""
SELECT CAST(user_id AS BIGINT) AS review_id, CAST(event_id AS BIGINT) AS file_ord, {_DIR} || {_NAME} AS path,
       CASE WHEN event_type = 'purchase' THEN {_OLD_DIR} || {_NAME} END AS old_path,
       CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'renamed' ELSE 'modified' END AS status,
       event_id % 17 = 0 AS is_binary, CASE WHEN event_id % 29 = 0 THEN 'python' END AS language, event_id % 5 <> 0 AS has_hunks
FROM {{events}}
"""

CODE_PATHS = ["src/pay.py", "src/api.ts", "lib/db.py", "tests/test_pay.py"]
CALL_NAMES = [
    "session.save", "transaction.atomic", "requests.post", "path.write_text", "queue.enqueue", "cursor.execute", "r.post", "post",
    "api.get", "config.update", "response.write", "git.commit", "items.insert", "db.commit", "fetch", "axios.get", "Model.objects.create",
    "upsert", "stream.write", "handler.run", "job.delay", "client.patch", "conn.rollback", "plain",
]

#: One row per event: a call in one of four files of the review.
CALLS = f"""
SELECT CAST(user_id AS BIGINT) AS review_id, CAST(event_id AS BIGINT) AS call_ord, {pick("event_id", CODE_PATHS)} AS path,
       {pick("CAST(floor(event_id / 3) AS BIGINT)", CALL_NAMES)} AS name, CAST(event_id % 120 + 1 AS INT) AS line_start
FROM {{events}}
"""

#: One row per signup: an import.
IMPORTS = f"""
SELECT CAST(user_id AS BIGINT) AS review_id, CAST(event_id AS BIGINT) AS ref_ord, {pick("event_id", CODE_PATHS)} AS path,
       {pick("CAST(floor(event_id / 2) AS BIGINT)", ["requests", "requests.post", "json", "httpx.Client", "os.path"])} AS name, CAST(1 AS INT) AS line_start,
       {pick("CAST(floor(event_id / 5) AS BIGINT)", ["r", "post", "R", "plain"])} AS local_name
FROM {{events}} WHERE event_type = 'signup'
"""

#: Three hunks for every file of CALLS.
HUNKS = f"""
SELECT f.review_id, f.path, CAST(h.hunk_ord AS INT) AS hunk_ord, CAST(h.hunk_ord * 40 + 1 + f.review_id % 7 AS INT) AS new_start, CAST(25 + h.hunk_ord * 10 AS INT) AS new_lines,
       '@@ -1,3 +' || CAST(h.hunk_ord * 40 + 1 + f.review_id % 7 AS STRING) || ',' || CAST(25 + h.hunk_ord * 10 AS STRING) || ' @@' AS header
FROM (SELECT DISTINCT CAST(user_id AS BIGINT) AS review_id, {pick("event_id", CODE_PATHS)} AS path FROM {{events}}) f
CROSS JOIN (SELECT 0 AS hunk_ord UNION ALL SELECT 1 UNION ALL SELECT 2) h
"""

_K = "CAST(event_id % 40 AS STRING)"
LINES = [
    "export async function fn# (a) {", "  const x# = await api.get#(v);", "}", "class C# extends B {", '  import m from "m#";', "const h# = (x) => {",
    '  const q = require("lib#"); run#(q);', "}", "export const k# = 5;", "  async load#(a) {", "}", "  if (ready#) { go.on#(1); }", '@import "n#";',
]


def _line() -> str:
    out = []
    for i, text in enumerate(LINES):
        joined = f" || {_K} || ".join(f"'{p}'" for p in text.split("#"))
        out.append(f"WHEN {i} THEN {joined}")
    return f"(CASE event_id % {len(LINES)} {' '.join(out)} END)"


#: One row per event: a line of a script of the review; a file has some 40 lines.
SCRIPT = f"""
SELECT review_id, path, CAST(row_number() OVER (PARTITION BY review_id, path ORDER BY event_id) AS INT) AS line_no, line
FROM (SELECT CAST(user_id AS BIGINT) AS review_id, {pick("CAST(floor(event_id / 13) AS BIGINT)", ["src/a.ts", "src/b.js", "web/c.mjs"])} AS path, event_id, {_line()} AS line FROM {{events}}) s
"""

#: Symbols: one row per click.
SYMBOLS = f"""
SELECT CAST(user_id AS BIGINT) AS review_id, CAST(event_id AS BIGINT) AS symbol_ord, {_DIR} || {_NAME} AS path, 'handle' || CAST(event_id % 11 AS STRING) AS name,
       'function' AS kind, CAST(event_id % 50 AS INT) AS line_start,
       CASE WHEN event_id % 3 = 0 THEN 'hunk context fallback' ELSE 'language extractor' END AS origin
FROM {{events}} WHERE event_type = 'click'
"""

#: Side effects: one row per error or signup, of one citation.
EFFECTS = f"""
SELECT CAST(user_id AS BIGINT) AS review_id, CAST(event_id AS BIGINT) AS effect_ord,
       {pick("event_id", ["database write", "transaction boundary", "network call", "file write", "message publish", "transaction boundary"])} AS kind,
       'about ' || CAST(event_id % 7 AS STRING) AS description, {_DIR} || {_NAME} AS path, 'call.n' || CAST(event_id % 9 AS STRING) AS symbol,
       CASE WHEN event_id % 4 <> 0 THEN '@@ -1,3 +' || CAST(event_id % 2 AS STRING) || ',9 @@' END AS hunk_header, CAST(event_id % 50 AS INT) AS line_start
FROM {{events}} WHERE event_type IN ('error', 'signup', 'purchase')
"""

ANSWERS = [
    "database.transaction rollback undoes processor.charge, so retry is safe.", "The rollback does not undo the call.n3 at all; we reconcile later.",
    "call.n1 is reverted by the rollback", "handle3 doesn''t cover the missing path", "I don''t know", "tests check handle5 and call.n2; it isn''t covered",
    "A retry of call.n4 could duplicate the network call", "database write and HTTPServer handleRequest2",
]

#: Questions and answers of the conversations: each user turn with the assistant turn after it.
QA = """
SELECT u.conv_id AS review_id, u.turn, u.text AS question, a.text AS answer
FROM {conversations} u JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
"""

#: One answer per event, from a short list of telling ones.
REPLIES = f"""
SELECT CAST(user_id AS BIGINT) AS review_id, CAST(event_id AS BIGINT) AS reply_ord, {pick("event_id", ANSWERS)} AS raw_text, event_id % 10 = 0 AS skipped
FROM {{events}}
"""

#: Assessments: one row per label, of a review of ten documents; gaps and evidence by residue.
ASSESSMENTS = """
SELECT CAST(floor(doc_id / 10) AS BIGINT) AS review_id, CAST(doc_id AS INT) AS question_ord, 'q' || CAST(doc_id AS STRING) AS id,
       CASE doc_id % 3 WHEN 0 THEN 'behavior' WHEN 1 THEN 'failure' ELSE 'evidence' END AS category,
       CASE WHEN toxic = 1 THEN 'Gap found' WHEN quality = 0 THEN 'Uncertain' WHEN doc_id % 2 = 0 THEN 'Partial' ELSE 'Strong' END AS label,
       CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'gap ' || CAST(doc_id % 7 AS STRING) END AS gap, 'src/f' || CAST(doc_id % 4 AS STRING) || '.py' AS path,
       CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'symbol' END AS kind, CASE WHEN doc_id % 4 <> 0 THEN 'sym' || CAST(doc_id % 6 AS STRING) END AS symbol
FROM {labels}
"""

#: Patches of documents: every seventh line is a hunk header, the others are added, removed or kept lines.
_SIGN = "CASE i % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END"
_HEAD = "'@@ -' || CAST(i + 1 AS STRING) || ',3 +' || CAST(i + 2 AS STRING) || ' @@ def f' || CAST(i AS STRING) || '(x):'"
PATCHES_SPARK = f"""
SELECT doc_id AS review_id, 0 AS file_ord, 'src/d.py' AS path,
       'diff --git a b' || chr(10) || array_join(transform(split(text, chr(10)), (x, i) -> CASE WHEN i % 7 = 0 THEN {_HEAD} ELSE {_SIGN} || x END), chr(10)) AS patch
FROM {{documents}} WHERE text IS NOT NULL
"""
PATCHES_DUCK = f"""
SELECT doc_id AS review_id, 0 AS file_ord, 'src/d.py' AS path,
       'diff --git a b' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x, j: CASE WHEN (j - 1) % 7 = 0
         THEN {_HEAD.replace("(i ", "((j - 1) ").replace("CAST(i AS", "CAST(j - 1 AS")} ELSE {_SIGN.replace("i %", "(j - 1) %")} || x END), chr(10)) AS patch
FROM documents WHERE text IS NOT NULL
"""


def feed(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the feeds above, over the tables of a data folder."""
    names = [n for n in ("events", "conversations", "labels", "documents", "pages") if "{" + n + "}" in sql]
    sql = sql.replace("{", "{{").replace("}", "}}")
    for n in names:
        sql = sql.replace("{{" + n + "}}", "{" + n + "}")
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def duck(sql: str) -> str:
    """The same feed for DuckDB, where the tables are views."""
    for n in ("events", "conversations", "labels", "documents", "pages"):
        sql = sql.replace("{" + n + "}", n)
    return sql
