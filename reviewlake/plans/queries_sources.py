"""Queries over what sources read and what readers see, with their SQL oracles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import extract, filtering, present, summarize
from ..sources import config, feeds, git
from ..sources.feeds import duck, feed
from . import review
from .queries_files import F_CTE, REASON, TEST, effects_with_evidence, reason_sql
from .queries_files import ORACLES as FILE_ORACLES

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


CODE = {"added": "A", "deleted": "D", "modified": "M", "renamed": "R087"}


def _git_output(spark, sf):
    """review_id, output: what Git would print for the files of each review, each with a patch of two lines."""
    f = feed(spark, sf, feeds.FILES).withColumn("old", F.coalesce("old_path", F.lit("none")))
    code = F.coalesce(*[F.when(F.col("status") == k, v) for k, v in CODE.items()])
    names = F.when(F.col("status") == "renamed", F.concat("old", F.lit("\0"), "path")).otherwise(F.col("path"))
    record = F.concat(F.lit(":100644 100644 0123 4567 "), code, F.lit("\0"), names)
    patch = F.concat(F.lit("diff --git a/"), "path", F.lit(" b\n+diff --git "), F.col("file_ord").cast("string"), F.lit("\n"))
    one = f.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("file_ord", record.alias("r"), patch.alias("p")))).alias("x"))
    part = lambda k, sep: F.array_join(F.transform("x", lambda v: v[k]), sep)
    return one.select("review_id", F.concat(part("r", "\0"), F.lit("\0\0"), part("p", "")).alias("output"))


ORD = "(row_number() OVER (PARTITION BY review_id ORDER BY file_ord) - 1)::INT AS ord"


@query(f"{F_CTE} SELECT review_id, {ORD}, path, CASE WHEN status = 'renamed' THEN coalesce(old_path, 'none') END AS old_path, status FROM f")
def raw_metadata_parse(spark, sf):
    """Files of the raw records that Git lists, read in small chunks."""

    def read(batches):
        for pdf in batches:
            rows = []
            for review, output in zip(pdf["review_id"], pdf["output"], strict=True):
                data = output.encode()
                meta, _ = git.read_metadata(data[i : i + 1000] for i in range(0, len(data), 1000))
                rows += [(review, i, x.path, x.old_path, x.status) for i, x in enumerate(git.parse_metadata(meta))]
            yield pd.DataFrame(rows, columns=["review_id", "ord", "path", "old_path", "status"])

    return _git_output(spark, sf).mapInPandas(read, "review_id long, ord int, path string, old_path string, status string")


@query(f"{F_CTE}, o AS (SELECT review_id, {ORD}, path, file_ord FROM f) SELECT review_id, ord, path, md5('diff --git a/' || path || ' b' || chr(10) || '+diff --git ' || file_ord || chr(10)) AS patch_md5 FROM o WHERE ord % 3 <> 1")
def patch_framing(spark, sf):
    """Patches of the wanted files (two of three of each review), paired with the files that Git lists by place."""

    def read(batches):
        for pdf in batches:
            rows = []
            for review, output in zip(pdf["review_id"], pdf["output"], strict=True):
                data = output.encode()
                chunks = iter([data[i : i + 777] for i in range(0, len(data), 777)])
                meta, rest = git.read_metadata(chunks)
                found = git.read_patches([rest, *chunks], lambda i: i % 3 != 1)
                rows += [(review, i, file.path, patch.decode()) for i, (file, (patch, _)) in enumerate(zip(git.parse_metadata(meta), found, strict=True)) if patch is not None]
            yield pd.DataFrame(rows, columns=["review_id", "ord", "path", "patch"])

    rows = _git_output(spark, sf).mapInPandas(read, "review_id long, ord int, path string, patch string")
    return rows.select("review_id", "ord", "path", F.md5("patch").alias("patch_md5"))


CONFIGS = """
SELECT review_id, CASE review_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'base: b' || CAST(review_id AS STRING) WHEN 2 THEN 'questions: ' || CAST(review_id % 5 AS STRING)
  WHEN 3 THEN 'surprise: 1' WHEN 4 THEN 'exclude: [gen/**, "!x"]' WHEN 5 THEN 'include_uncommitted: true' || chr(10) || 'exclude: [a/**, "*.md"]' ELSE 'base: [' END AS text
FROM (SELECT DISTINCT CAST(user_id AS BIGINT) AS review_id FROM {events}) u
"""


@query(
    f"WITH c AS ({duck(CONFIGS)}), v AS (SELECT review_id, review_id % 7 AS k, review_id % 5 AS q FROM c) SELECT review_id, NOT (k IN (3, 4, 6) OR (k = 2 AND q NOT BETWEEN 1 AND 3)) AS valid, CASE WHEN k = 1 THEN 'b' || review_id END AS base, "
    "CASE WHEN k = 2 AND q BETWEEN 1 AND 3 THEN q END::INT AS questions, CASE WHEN k = 5 THEN true END AS include_uncommitted, CASE WHEN k = 5 THEN 'a/**|*.md' ELSE '' END AS exclude FROM v"
)
def config_parse(spark, sf):
    """Configuration texts, sound and unsound."""
    c = config.read_texts(feed(spark, sf, CONFIGS))
    exclude = F.coalesce(F.array_join("exclude", "|"), F.lit(""))
    return c.select("review_id", F.col("problem").isNull().alias("valid"), "base", F.col("n_questions").alias("questions"), "include_uncommitted", exclude.alias("exclude"))


@query("SELECT DISTINCT user_id::BIGINT AS review_id, CASE WHEN user_id % 3 = 0 THEN 'cli' WHEN user_id % 2 = 0 THEN 'cfg' END AS base, coalesce(CASE WHEN user_id % 5 = 0 THEN 1 END, CASE WHEN user_id % 2 = 0 THEN 2 END, 3)::INT AS questions FROM events")
def option_resolution(spark, sf):
    """What commands say over what configurations say over defaults."""
    ids = feed(spark, sf, "SELECT DISTINCT CAST(user_id AS BIGINT) AS review_id FROM {events}")
    text = F.when(F.col("review_id") % 2 == 0, F.lit("base: cfg\nquestions: 2\n"))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    said = ids.select("review_id", F.when(F.col("review_id") % 3 == 0, "cli").alias("base"), none("report_path", "string"), F.when(F.col("review_id") % 5 == 0, 1).alias("n_questions"), none("include_uncommitted", "boolean"))
    return config.effective(said, config.read_texts(ids.withColumn("text", text))).select("review_id", "base", F.col("n_questions").alias("questions"))


#: Exclusions of one review in three each, a third set that is no pattern, and reviews without a configuration.
EXCLUDING = """
SELECT review_id, CASE review_id % 5 WHEN 0 THEN 'exclude: ["*.go", tests/]' WHEN 1 THEN 'exclude: [src/**]' || chr(10) || 'questions: 2' WHEN 2 THEN 'exclude: ["[a"]' WHEN 3 THEN 'questions: 1' END AS text
FROM (SELECT DISTINCT CAST(user_id AS BIGINT) AS review_id FROM {events}) u
"""


OWN_SET = "CASE review_id % 5 WHEN 0 THEN '^(?:.*/)?[^/]*\\.go(?:/.*)?$|^(?:.*/)?tests/.+$' WHEN 1 THEN '^src/.+$' END"
OWN = f"WHEN regexp_matches({{p}}, e) THEN '{L.EXCLUDED}'"
OWN_REASON = f"CASE WHEN old_path IS NULL OR {reason_sql('old_path', OWN.format(p='old_path'))} IS NOT NULL THEN {reason_sql('path', OWN.format(p='path'))} END"


@query(
    f"{F_CTE}, x AS (SELECT *, {OWN_SET} AS e FROM f WHERE review_id % 5 <> 2) SELECT review_id, file_ord, coalesce({OWN_REASON}, 'kept') AS reason FROM x"
)
def exclusions_by_review(spark, sf):
    """Why files are left out where each review has exclusions of its own; reviews whose exclusions are no patterns have no rows."""
    settings = config.read_texts(feed(spark, sf, EXCLUDING))
    files = feed(spark, sf, feeds.FILES).join(settings.filter("problem is null").select("review_id"), "review_id", "left_semi")
    return filtering.with_filter_reason(files, settings=settings).select("review_id", "file_ord", F.coalesce("filter_reason", F.lit("kept")).alias("reason"))


MOST_KEPT = 30


def _failing_feed(spark, sf):
    """Reviews of which some have exclusions that are no patterns, too many questions, too many files, or a hunk header that cannot be read."""
    settings = config.read_texts(feed(spark, sf, EXCLUDING)).withColumn("n_questions", F.when(F.col("review_id") % 11 == 0, 7).otherwise(F.col("n_questions")))
    settings = settings.withColumn("exclude", F.when(F.col("problem").isNotNull(), F.array(F.lit("[a"))).otherwise(F.col("exclude"))).withColumn("follow_up", F.lit(True))
    files = feed(spark, sf, feeds.FILES)
    header = F.when((F.col("review_id") % 4 == 0) & (F.col("file_ord") % 3 == 0), F.concat(F.lit("@@ of "), F.col("path"), F.lit(" @@"))).otherwise(F.lit("@@ -1 +1 @@"))
    raw = files.select("review_id", "file_ord", F.concat(F.lit("diff --git a b\n"), header, F.lit("\n+x\n")).alias("patch"))
    return review.Feed(files.select("review_id").distinct(), files, raw, files.limit(0), settings)


@query(
    f"{F_CTE}, x AS (SELECT *, {OWN_SET} AS e FROM f), k AS (SELECT * FROM (SELECT *, {OWN_REASON} AS r FROM x) WHERE r IS NULL), "
    "c AS (SELECT review_id, count(*) AS n FROM k GROUP BY review_id), h AS (SELECT review_id, arg_min(path, file_ord) AS path FROM k WHERE review_id % 4 = 0 AND file_ord % 3 = 0 GROUP BY review_id), "
    "u AS (SELECT DISTINCT review_id FROM f) SELECT review_id, CASE WHEN cfg THEN 'ConfigError' ELSE 'CollectionFailed' END AS error, "
    f"CASE WHEN cfg THEN 'The configuration is invalid.' WHEN n > {MOST_KEPT} THEN 'More than {MOST_KEPT} files are left to analyse.' ELSE 'A hunk header cannot be read.' END AS message, "
    "CASE WHEN review_id % 11 = 0 THEN '`questions` must be from 1 to 3' WHEN review_id % 5 = 2 THEN 'unclosed class in ' || chr(39) || '[a' || chr(39) "
    f"WHEN n > {MOST_KEPT} THEN n || ' files' ELSE '@@ of ' || path || ' @@' END AS details "
    f"FROM (SELECT *, review_id % 5 = 2 OR review_id % 11 = 0 AS cfg FROM u) LEFT JOIN c USING (review_id) LEFT JOIN h USING (review_id) WHERE cfg OR n > {MOST_KEPT} OR path IS NOT NULL"
)
def failed_reviews(spark, sf):
    """What stops single reviews among many, each with its first reason; all others go on."""
    failures, *_ = review.admitted(_failing_feed(spark, sf), review.Options(changed_files=MOST_KEPT))
    return failures.select("review_id", "error", "message", "details")


#: Python sources, and what a change of lines 2, 4 and 7 of them touches: class, name, kind, line, local name.
SOURCES = [
    ("import requests as r\ndef f(x):\n    return r.post(x)\n", [("import", "requests", "import", 1, "r"), ("symbol", "f", "function", 2, None)]),
    ("@decorated(1)\ndef f():\n    pass\n    g()\n", [("symbol", "f", "function", 2, None), ("call", "g", "call", 4, None)]),
    ("class A:\n    def m(self):\n        return self.a.b()\n\n    async def n(self):\n        await x()\n        y.z(w())\n", [("symbol", "A", "class", 1, None), ("symbol", "m", "function", 2, None), ("symbol", "n", "async function", 5, None), ("call", "y.z", "call", 7, None), ("call", "w", "call", 7, None)]),
    ("from . import a, b as c\nfrom ..d import e\nfrom .f.g import h as i\nimport j.k\n", [("import", ".a", "import", 1, "a"), ("import", ".b", "import", 1, "c"), ("import", "..d.e", "import", 2, "e"), ("import", ".f.g.h", "import", 3, "i"), ("import", "j.k", "import", 4, "j")]),
    ("def broken(:\n    pass\n", [("error", None, None, None, None)]),
    ("", []),
    ("def outer():\n    def inner():\n        return 1\n    return inner()\n\ndef other():\n    pass\n", [("symbol", "outer", "function", 1, None), ("symbol", "inner", "function", 2, None), ("call", "inner", "call", 4, None), ("symbol", "other", "function", 6, None)]),
    ("x = [\n    f(y) for y in z()\n]\nw = (lambda v: v)(1)\n", [("call", "f", "call", 2, None), ("call", "z", "call", 2, None)]),
    ("def a(): pass\nasync def b(): await c.d.e()\nclass F(G): pass\n", [("symbol", "b", "async function", 2, None), ("call", "c.d.e", "call", 2, None)]),
    ("if True:\n    import lazy\nelse:\n    from typing import *\nf()()\n", [("import", "lazy", "import", 2, "lazy"), ("import", "typing.*", "import", 4, "*")]),
    ("# nothing\n'''text\nf()\n'''\ndef late():\n    return 0\n", []),
    ("class Ü:\n    ä = ö(1)\n    @property\n    def ß(self):\n        return 1\n", [("symbol", "Ü", "class", 1, None), ("call", "ö", "call", 2, None), ("symbol", "ß", "function", 4, None)]),
]


def _source_sql(value: str) -> str:
    """A text as SQL of both engines."""
    return " || chr(10) || ".join("'" + line.replace("'", "' || chr(39) || '") + "'" for line in value.split("\n"))


_ROWS = " UNION ALL ".join(
    f"SELECT {k} AS k, '{c}' AS class, {i} AS ord, " + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in rest)
    for k, (_, rows) in enumerate(SOURCES) for i, (c, *rest) in enumerate(rows)
)


@query(
    f"WITH w(k, class, ord, name, kind, line_start, local_name) AS ({_ROWS}) SELECT e.event_id::BIGINT AS review_id, 'src/m.py' AS path, class, ord::INT AS ord, name, kind, line_start::INT AS line_start, local_name "
    f"FROM events e JOIN w ON w.k = e.event_id % {len(SOURCES)}"
)
def python_symbols(spark, sf):
    """Symbols, imports and calls of twelve unlike Python sources that events change; each source is parsed once."""
    text = " ".join(f"WHEN {k} THEN {_source_sql(t)}" for k, (t, _) in enumerate(SOURCES))
    src = feed(spark, sf, f"SELECT CAST(event_id AS BIGINT) AS review_id, 'src/m.py' AS path, CASE event_id % {len(SOURCES)} {text} END AS content FROM {{events}}")
    affected = src.select("review_id", "path", F.explode(F.array(*map(F.lit, (2, 4, 7)))).alias("line"))
    return extract.python_rows(src, affected)


LIST = "coalesce(chr(10) || '{title}:' || chr(10) || {items}, '')"


@query(
    f"{F_CTE}, x AS (SELECT *, {REASON} AS reason FROM f), a AS (SELECT review_id, count(*) FILTER (reason IS NULL) AS n, count(*) FILTER (reason IS NOT NULL) AS m, "
    "string_agg('  - ' || status || ': ' || CASE WHEN old_path IS NOT NULL THEN '\"' || old_path || '\" -> ' ELSE '' END || '\"' || path || '\"', chr(10) ORDER BY file_ord) FILTER (reason IS NULL) AS kept, "
    "string_agg('  - \"' || path || '\": ' || reason, chr(10) ORDER BY file_ord) FILTER (reason IS NOT NULL) AS gone FROM x GROUP BY review_id) "
    "SELECT review_id, 'Repository: \"/r\"' || chr(10) || 'Branch: feature -> main' || chr(10) || 'Merge base: 0123456789ab' || chr(10) || 'Changes: ' || (n + m) || ' total, ' || n || ' analyzed, ' || m || ' filtered' || "
    f"{LIST.format(title='Changed files', items='kept')} || {LIST.format(title='Filtered files', items='gone')} AS overview FROM a"
)
def review_overview(spark, sf):
    """What the terminal shows first of each review."""
    all_ = filtering.with_filter_reason(feed(spark, sf, feeds.FILES))
    at = [F.lit(v).alias(k) for k, v in (("repo_root", "/r"), ("current_branch", "feature"), ("base_branch", "main"), ("merge_base", "0123456789abcdef"))]
    return present.overview(all_.select("review_id").distinct().select("review_id", *at), all_.filter("filter_reason is null"), all_.filter("filter_reason is not null"))


@query(f"WITH r AS ({duck(feeds.REPLIES)}) SELECT review_id, count(*) FILTER (NOT skipped) AS answered, count(*) FILTER (skipped) AS skipped FROM r GROUP BY review_id")
def answer_counts(spark, sf):
    return present.answer_counts(feed(spark, sf, feeds.REPLIES))


OTHER = "Symbol-level analysis was unavailable for Go; any symbols inferred from hunk context are heuristic."
SHOWN = "string_agg('  - ' || {x}, chr(10) ORDER BY {o})"


@query(
    f"{F_CTE}, e AS ({duck(feeds.EFFECTS)}), v AS (SELECT * FROM e WHERE EXISTS (SELECT 1 FROM f WHERE f.review_id = e.review_id AND f.path = e.path)), "
    "vp AS (SELECT *, row_number() OVER (PARTITION BY review_id, kind ORDER BY o) AS r FROM (SELECT review_id, kind, path, min(effect_ord) AS o FROM v GROUP BY ALL)), "
    "ps AS (SELECT review_id, kind, string_agg('\"' || path || '\"', ', ' ORDER BY o) AS paths FROM vp WHERE r <= 3 GROUP BY ALL), "
    "ks AS (SELECT review_id, kind, min(effect_ord) AS o, arg_min(description, effect_ord) AS d FROM v GROUP BY ALL), "
    f"es AS (SELECT review_id, {SHOWN.format(x="kind || ': ' || d || ' Evidence: ' || paths", o='o')} AS t FROM ks JOIN ps USING (review_id, kind) GROUP BY review_id), "
    f"rs AS (SELECT review_id, {SHOWN.format(x="'\"' || path || '\"'", o='place')} AS t FROM ({FILE_ORACLES['relevant_files_top5']}) GROUP BY review_id), "
    f"tf AS (SELECT review_id, path, row_number() OVER (PARTITION BY review_id ORDER BY file_ord) AS r, count(*) OVER (PARTITION BY review_id) AS n FROM f WHERE {TEST}), "
    f"ts AS (SELECT review_id, {SHOWN.format(x="'\"' || path || '\"'", o='r')} FILTER (r <= 5) || CASE WHEN max(n) > 5 THEN chr(10) || '  - and ' || (max(n) - 5) || ' more' ELSE '' END AS t FROM tf GROUP BY review_id) "
    "SELECT review_id, 'Purpose: Likely updates code.' || "
    + " || ".join(LIST.format(title=title, items=f"{t}.t") for title, t in (("Relevant files", "rs"), ("Tests found", "ts"), ("Likely side effects", "es")))
    + f" || chr(10) || 'Uncertainty:' || chr(10) || '  - {OTHER}' || chr(10) || '  - A note.' AS summary "
    "FROM (SELECT DISTINCT review_id FROM f) LEFT JOIN rs USING (review_id) LEFT JOIN ts USING (review_id) LEFT JOIN es USING (review_id)"
)
def review_summary(spark, sf):
    """What the terminal shows of each review before the questions."""
    files = filtering.classified(feed(spark, sf, feeds.FILES))
    relevant = filtering.relevant_files(files, feed(spark, sf, feeds.EFFECTS), feed(spark, sf, feeds.SYMBOLS))
    by_kind = summarize.effects_by_kind(effects_with_evidence(spark, sf), files)
    ids = files.select("review_id").distinct()
    notes = ids.select("review_id", F.array(F.lit("A note."), F.lit(OTHER)).alias("notes"))
    return present.summary(ids.select("review_id", F.lit("Likely updates code.").alias("purpose")), relevant, files, by_kind, notes)
