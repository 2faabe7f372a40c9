"""Queries over changed files and patches, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import paths as P
from ..functions import text as T
from ..operators import extract, filtering, patches, summarize
from ..sources import feeds
from ..sources.feeds import duck, feed

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def sql_list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


F_CTE = f"WITH f AS ({duck(feeds.FILES)})"
NAME = "regexp_extract({p}, '[^/]*$', 0)"
SUFFIX = "regexp_extract(regexp_extract({p}, '[^/]*$', 0), '^.+(\\.[^.]+)$', 1)"
STEM = "CASE WHEN regexp_matches(regexp_extract({p}, '[^/]*$', 0), '^.+\\.[^.]+$') THEN regexp_extract(regexp_extract({p}, '[^/]*$', 0), '^(.+)\\.[^.]+$', 1) ELSE regexp_extract({p}, '[^/]*$', 0) END"
PARENTS = "string_split({p}, '/')[1:-2]"
LANG = "coalesce(language, CASE lower(" + SUFFIX + ") " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.LANGUAGE_OF_SUFFIX.items()) + " END)"
IN_DIR = "len(list_filter(" + PARENTS + ", lambda x: {low} IN {dirs})) > 0"


def q(template: str, p: str = "path", **more) -> str:
    return template.replace("{p}", p).replace("{low}", more.get("low", "x")).replace("{dirs}", more.get("dirs", "('')"))


TEST = (
    "(" + q(IN_DIR, low="lower(x)", dirs=sql_list(L.TEST_DIRS)) + f" OR CASE WHEN lower({q(SUFFIX)}) = '.py' THEN lower({q(STEM)}) LIKE 'test\\_%' ESCAPE '\\' OR lower({q(STEM)}) LIKE '%\\_test' ESCAPE '\\'"
    f" ELSE contains(lower({q(NAME)}), '.test.') OR contains(lower({q(NAME)}), '.spec.') END)"
)
DOC = "(" + q(IN_DIR, low="lower(x)", dirs=sql_list(L.DOC_DIRS)) + f" OR lower({q(SUFFIX)}) IN ('.md', '.markdown') OR regexp_matches({q(NAME)}, '(?i)(^|[^a-z0-9])plan([^a-z0-9]|$)'))"


def reason_sql(p: str, extra: str = "") -> str:
    mins = " OR ".join(f"lower({q(NAME, p)}) LIKE '%{s}'" for s in L.MINIFIED_SUFFIXES)
    return (
        f"CASE WHEN {q(IN_DIR, p, dirs=sql_list(L.GENERATED_DIRS))} THEN '{L.GENERATED}' WHEN {q(IN_DIR, p, dirs=sql_list(L.VENDORED_DIRS))} THEN '{L.VENDORED}' "
        f"WHEN {q(NAME, p)} IN {sql_list(L.LOCKFILES)} THEN '{L.LOCKFILE}' WHEN {mins} THEN '{L.MINIFIED}' {extra} END"
    )


REASON = f"CASE WHEN old_path IS NULL OR {reason_sql('old_path')} IS NOT NULL THEN {reason_sql('path')} END"
LANGUAGE = q(LANG)


@query(f"{F_CTE} SELECT review_id, file_ord, {q(NAME)} AS name, {q(SUFFIX)} AS suffix, {q(STEM)} AS stem, len({q(PARENTS)})::BIGINT AS depth FROM f")
def path_parts(spark, sf):
    p = F.col("path")
    return feed(spark, sf, feeds.FILES).select("review_id", "file_ord", P.name(p).alias("name"), P.suffix(p).alias("suffix"), P.stem(p).alias("stem"), F.size(P.parents(p)).cast("long").alias("depth"))


@query(f"{F_CTE} SELECT review_id, file_ord, {LANGUAGE} AS language, coalesce({LANGUAGE} IN {sql_list(L.EXTRACTOR_LANGUAGES)}, false) AS has_extractor FROM f")
def language_detect(spark, sf):
    p, d = F.col("path"), F.col("language")
    return feed(spark, sf, feeds.FILES).select("review_id", "file_ord", P.language(p, d).alias("language"), P.has_extractor(p, d).alias("has_extractor"))


@query(f"{F_CTE} SELECT review_id, file_ord, {TEST} AS is_test FROM f")
def test_path_flag(spark, sf):
    return feed(spark, sf, feeds.FILES).select("review_id", "file_ord", P.is_test(F.col("path")).alias("is_test"))


@query(f"{F_CTE} SELECT review_id, file_ord, {DOC} AS is_documentation FROM f")
def doc_path_flag(spark, sf):
    return feed(spark, sf, feeds.FILES).select("review_id", "file_ord", P.is_documentation(F.col("path")).alias("is_documentation"))


@query(f"{F_CTE} SELECT review_id, file_ord, path, {REASON} AS filter_reason FROM f")
def file_filter_reason(spark, sf):
    return filtering.with_filter_reason(feed(spark, sf, feeds.FILES)).select("review_id", "file_ord", "path", "filter_reason")


@query(f"{F_CTE} SELECT review_id, file_ord, {reason_sql('path')} AS new_reason, {reason_sql('old_path')} AS old_reason, {REASON} AS filter_reason FROM f WHERE old_path IS NOT NULL")
def rename_boundary_filter(spark, sf):
    rows = feed(spark, sf, feeds.FILES).filter("old_path is not null")
    return filtering.with_filter_reason(rows).select(
        "review_id", "file_ord", filtering.path_reason(F.col("path")).alias("new_reason"), filtering.path_reason(F.col("old_path")).alias("old_reason"), "filter_reason"
    )


EXCLUDED = ["generated/**", "*.go", "/lib/*/f1?.py", "Docs/"]


@query(
    f"{F_CTE} SELECT review_id, file_ord, path LIKE 'generated/%' OR regexp_matches(path, '(^|/)[^/]*[.]go(/|$)') OR regexp_matches(path, '^lib/[^/]*/f1[^/][.]py(/|$)')"
    " OR regexp_matches(path, '(^|/)Docs/.') AS excluded FROM f"
)
def configured_exclusion_match(spark, sf):
    return feed(spark, sf, feeds.FILES).select("review_id", "file_ord", P.ignored(F.col("path"), EXCLUDED).alias("excluded"))


@query(f"{F_CTE} SELECT review_id, coalesce({REASON}, 'kept') AS reason, count(*) AS n_files, min(file_ord) AS first_ord FROM f GROUP BY ALL")
def filter_counts(spark, sf):
    return filtering.filter_counts(filtering.with_filter_reason(feed(spark, sf, feeds.FILES)))


@query(f"{F_CTE} SELECT review_id, count(*) AS n_files FROM f GROUP BY review_id HAVING count(*) > 60")
def file_limit(spark, sf):
    return filtering.over_limit(feed(spark, sf, feeds.FILES), 60)


@query(
    f"{F_CTE}, s AS ({duck(feeds.SYMBOLS)}) SELECT review_id, file_ord, path FROM f WHERE NOT is_binary AND NOT {DOC} AND "
    "(has_hunks OR EXISTS (SELECT 1 FROM s WHERE s.review_id = f.review_id AND s.path = f.path))"
)
def analyzable_files(spark, sf):
    files = filtering.classified(feed(spark, sf, feeds.FILES))
    return filtering.analyzable(files, feed(spark, sf, feeds.SYMBOLS)).select("review_id", "file_ord", "path")


@query(
    f"{F_CTE}, s AS (SELECT DISTINCT review_id, path, 1 AS s FROM ({duck(feeds.SYMBOLS)})), e AS (SELECT DISTINCT review_id, path, 1 AS e FROM ({duck(feeds.EFFECTS)})), "
    f"r AS (SELECT f.review_id, file_ord, path, CASE WHEN e = 1 THEN 0 WHEN s = 1 THEN 1 WHEN NOT {TEST} THEN 2 ELSE 3 END AS category FROM f LEFT JOIN s USING (review_id, path) LEFT JOIN e USING (review_id, path)) "
    "SELECT review_id, place, path, category FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY category, file_ord) AS place FROM r) WHERE place <= 5"
)
def relevant_files_top5(spark, sf):
    files = filtering.classified(feed(spark, sf, feeds.FILES))
    return filtering.relevant_files(files, feed(spark, sf, feeds.EFFECTS), feed(spark, sf, feeds.SYMBOLS))


ACTION = "CASE WHEN count(DISTINCT status) = 1 THEN CASE min(status) WHEN 'added' THEN 'adds' WHEN 'deleted' THEN 'removes' WHEN 'renamed' THEN 'reorganizes' ELSE 'updates' END ELSE 'updates' END"


@query(f"{F_CTE} SELECT review_id, status_group, {ACTION} AS action FROM (SELECT *, file_ord % 40 AS status_group FROM f) GROUP BY ALL")
def status_action(spark, sf):
    rows = feed(spark, sf, feeds.FILES).withColumn("status_group", F.col("file_ord") % 40)
    return rows.groupBy("review_id", "status_group").agg(F.collect_set("status").alias("s")).select("review_id", "status_group", summarize.status_action(F.col("s")).alias("action"))


_SHOWN = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.LANGUAGE_NAMES.items()) + " END"
LABELS = (
    f"u0 AS (SELECT review_id, file_ord, lower({q(SUFFIX)}) AS suf, {LANGUAGE} AS lang FROM f WHERE NOT is_binary AND NOT coalesce({LANGUAGE} IN {sql_list(L.EXTRACTOR_LANGUAGES)}, false)), "
    "u1 AS (SELECT review_id, coalesce(lang, nullif(suf, ''), 'unrecognized') AS k, arg_min(CASE WHEN " + _SHOWN + " IS NOT NULL AND suf <> '' THEN " + _SHOWN + " || ' (' || suf || ')' "
    "WHEN " + _SHOWN + " IS NOT NULL THEN " + _SHOWN + " WHEN suf <> '' THEN suf ELSE 'unrecognized' END, file_ord) AS label, min(file_ord) AS o FROM u0 GROUP BY ALL), "
    "u AS (SELECT review_id, list(label ORDER BY o) AS labels FROM u1 GROUP BY review_id)"
)
LISTED = "CASE WHEN len({x}) <= 2 THEN array_to_string({x}, ' and ') ELSE array_to_string({x}[1:-2], ', ') || ', and ' || {x}[-1] END"


@query(f"{F_CTE}, {LABELS} SELECT review_id, array_to_string(labels, '|') AS labels, 'Symbol-level analysis was unavailable for ' || {LISTED.replace('{x}', 'labels')} || '; any symbols inferred from hunk context are heuristic.' AS note FROM u")
def unsupported_languages(spark, sf):
    rows = summarize.unsupported_labels(feed(spark, sf, feeds.FILES))
    return rows.select("review_id", F.array_join("labels", "|").alias("labels"), summarize.unsupported_note(F.col("labels")).alias("note"))


EFFECT_KINDS = f"k AS (SELECT review_id, list(kind ORDER BY o) AS kinds FROM (SELECT e.review_id, kind, min(effect_ord) AS o FROM ({duck(feeds.EFFECTS)}) e WHERE EXISTS (SELECT 1 FROM f WHERE f.review_id = e.review_id AND f.path = e.path) GROUP BY ALL) GROUP BY review_id)"
PURPOSE = (
    f"{F_CTE}, {LABELS}, {EFFECT_KINDS}, n AS (SELECT review_id, list('`' || name || '`' ORDER BY o)[1:2] AS names FROM (SELECT s.review_id, name, min(symbol_ord) AS o FROM ({duck(feeds.SYMBOLS)}) s WHERE origin = '{L.EXTRACTED}' "
    "AND EXISTS (SELECT 1 FROM f WHERE f.review_id = s.review_id AND f.path = s.path) GROUP BY ALL) GROUP BY review_id), "
    f"g AS (SELECT review_id, count(*) AS n, {ACTION} AS act, count(*) FILTER (NOT is_binary) AS m, coalesce(bool_or(NOT is_binary AND coalesce({LANGUAGE} IN {sql_list(L.EXTRACTOR_LANGUAGES)}, false)), false) AS ex FROM f GROUP BY review_id), "
    f"c AS (SELECT review_id, {ACTION} AS code_act FROM f WHERE NOT is_binary GROUP BY review_id) "
    "SELECT review_id, CASE WHEN m > 0 AND labels IS NOT NULL AND NOT ex THEN 'Likely ' || code_act || ' ' || m || CASE WHEN m = 1 THEN ' meaningful file' ELSE ' meaningful files' END || ' across ' || "
    + LISTED.replace("{x}", "labels")
    + " || '; a symbol-level purpose could not be inferred.' ELSE CASE WHEN names IS NOT NULL THEN 'Likely updates ' || array_to_string(names, ' and ') || ' across ' || n ELSE 'Likely ' || act || ' code in ' || n END "
    "|| CASE WHEN n = 1 THEN ' meaningful file' ELSE ' meaningful files' END || CASE WHEN kinds IS NULL THEN '' WHEN len(kinds) = 1 THEN ', with a ' || kinds[1] || ' signal' "
    "ELSE ', with ' || array_to_string(kinds[1:2], ' and ') || CASE WHEN len(kinds) > 2 THEN ' and other side-effect' ELSE '' END || ' signals' END || '.' END AS purpose "
    "FROM g LEFT JOIN c USING (review_id) LEFT JOIN u USING (review_id) LEFT JOIN k USING (review_id) LEFT JOIN n USING (review_id)"
)


def effects_with_evidence(spark, sf):
    from ..operators.effects import citation

    e = feed(spark, sf, feeds.EFFECTS)
    c = citation("call", F.col("path"), F.col("symbol"), F.col("hunk_header"), F.col("line_start"), F.col("line_start"), F.lit("n"))
    return e.select("review_id", "effect_ord", "kind", "description", F.array(c).alias("evidence"))


@query(PURPOSE)
def purpose_sentence(spark, sf):
    files = feed(spark, sf, feeds.FILES)
    by_kind = summarize.effects_by_kind(effects_with_evidence(spark, sf), files)
    return summarize.purposes(files, feed(spark, sf, feeds.SYMBOLS), by_kind)


BUDGET = (
    "WITH RECURSIVE p AS (SELECT CAST(user_id AS BIGINT) AS review_id, CAST(event_id AS BIGINT) AS file_ord, CAST(event_id * 7919 % 1000 AS BIGINT) AS n, "
    "row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), "
    "w(review_id, i, file_ord, n, why, used) AS (SELECT review_id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, 0::BIGINT FROM p WHERE i = 1 UNION ALL "
    "SELECT p.review_id, p.i, p.file_ord, p.n, CASE WHEN p.n > 900 AND 5000 - used >= 900 THEN 'file' WHEN p.n > 5000 - used THEN 'aggregate' WHEN p.n > 900 THEN 'file' END, "
    "used + CASE WHEN p.n > 900 OR p.n > 5000 - used THEN 0 ELSE p.n END FROM w JOIN p ON p.review_id = w.review_id AND p.i = w.i + 1) "
    "SELECT review_id, file_ord, n AS n_bytes, why AS limit_reason FROM w WHERE i > 0"
)


@query(BUDGET)
def patch_budget_greedy(spark, sf):
    rows = feed(spark, sf, "SELECT CAST(user_id AS BIGINT) AS review_id, CAST(event_id AS BIGINT) AS file_ord, CAST(event_id * 7919 % 1000 AS BIGINT) AS n_bytes FROM {events}")
    return filtering.patch_budget(rows, 900, 5000)


P_CTE = f"p AS ({feeds.PATCHES_DUCK}), pl AS (SELECT review_id, path, u.i AS i, u.x AS x FROM (SELECT review_id, path, unnest(list_transform(string_split(patch, chr(10)), lambda x, j: {{'i': j - 1, 'x': x}})) AS u FROM p)), "
P_CTE += "h0 AS (SELECT *, sum(CASE WHEN x LIKE '@@ %' THEN 1 ELSE 0 END) OVER (PARTITION BY review_id ORDER BY i) - 1 AS hunk_ord FROM pl), "
P_CTE += "hl AS (SELECT * FROM h0 WHERE hunk_ord >= 0), hh AS (SELECT review_id, path, hunk_ord, x AS header, i AS first_i FROM hl WHERE x LIKE '@@ %')"
NUM = "regexp_extract(header, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@', {g})"


@query(
    f"WITH {P_CTE}, t AS (SELECT review_id, hunk_ord, count(*) AS n_lines, string_agg(x, chr(10) ORDER BY i) AS body, max(i) AS last FROM hl GROUP BY ALL), z AS (SELECT review_id, max(i) AS m FROM pl GROUP BY ALL) "
    "SELECT hh.review_id, hh.hunk_ord::BIGINT AS hunk_ord, header, md5(body || CASE WHEN last = m THEN '' ELSE chr(10) END) AS patch_md5 FROM hh JOIN t USING (review_id, hunk_ord) JOIN z USING (review_id)"
)
def hunk_split(spark, sf):
    rows = patches.split_hunks(feed(spark, sf, feeds.PATCHES_SPARK))
    return rows.select("review_id", F.col("hunk_ord").cast("long").alias("hunk_ord"), "header", F.md5("patch").alias("patch_md5"))


@query(
    f"WITH {P_CTE} SELECT review_id, hunk_ord::BIGINT AS hunk_ord, {NUM.replace('{g}', '1')}::INT AS old_start, coalesce(nullif({NUM.replace('{g}', '2')}, ''), '1')::INT AS old_lines, "
    f"{NUM.replace('{g}', '3')}::INT AS new_start, coalesce(nullif({NUM.replace('{g}', '4')}, ''), '1')::INT AS new_lines FROM hh"
)
def hunk_header_parse(spark, sf):
    rows = patches.split_hunks(feed(spark, sf, feeds.PATCHES_SPARK))
    return rows.select("review_id", F.col("hunk_ord").cast("long").alias("hunk_ord"), "old_start", "old_lines", "new_start", "new_lines")


@query("WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x' || chr(10) || 'Binary files a and b differ' WHEN doc_id % 3 = 1 THEN 'GIT binary patch' || chr(10) ELSE text END AS patch FROM documents) "
       "SELECT doc_id, regexp_matches(patch, '(?m)^(GIT binary patch|Binary files .+ differ)\\r?$') AS is_binary FROM p")
def binary_patch_flag(spark, sf):
    sql = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x' || chr(10) || 'Binary files a and b differ' WHEN doc_id % 3 = 1 THEN 'GIT binary patch' || chr(10) ELSE text END AS patch FROM {documents}"
    return feed(spark, sf, sql).select("doc_id", patches.is_binary(F.col("patch")).alias("is_binary"))


NEW_SIDE = (
    f"{P_CTE}, ns AS (SELECT hl.review_id, hl.path, hl.hunk_ord, hl.i, left(x, 1) AS mark, substr(x, 2) AS line, {NUM.replace('{g}', '3')}::INT + coalesce(sum(CASE WHEN left(x, 1) = '-' THEN 0 ELSE 1 END) "
    "OVER (PARTITION BY hl.review_id, hl.hunk_ord ORDER BY hl.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new_line "
    "FROM hl JOIN hh USING (review_id, hunk_ord) WHERE hl.i > first_i AND x <> '' AND left(x, 1) <> chr(92))"
)


@query(
    f"WITH {NEW_SIDE} SELECT DISTINCT review_id, line::INT AS line FROM (SELECT review_id, new_line AS line FROM ns WHERE mark = '+' UNION ALL SELECT review_id, new_line FROM ns WHERE mark = '-' AND new_line > 0 "
    "UNION ALL SELECT review_id, new_line - 1 FROM ns WHERE mark = '-' AND new_line > 1)"
)
def affected_lines(spark, sf):
    return patches.affected_lines(patches.split_hunks(feed(spark, sf, feeds.PATCHES_SPARK))).select("review_id", "line")


@query(f"WITH {NEW_SIDE} SELECT review_id, hunk_ord::BIGINT AS hunk_ord, new_line::INT AS new_line, mark, md5(line) AS line_md5 FROM ns WHERE mark <> '-'")
def patch_line_lookup(spark, sf):
    hunks = patches.split_hunks(feed(spark, sf, feeds.PATCHES_SPARK))
    wanted = patches.new_side(hunks).select("review_id", "path", "hunk_ord", "new_line").distinct()
    found = patches.line_at(hunks, wanted).filter("mark is not null")
    return found.select("review_id", F.col("hunk_ord").cast("long").alias("hunk_ord"), "new_line", "mark", F.md5("line").alias("line_md5"))


@query(f"WITH {P_CTE} SELECT review_id, name, 'function' AS kind, arg_min({NUM.replace('{g}', '3')}::INT, hunk_ord) AS line_start FROM (SELECT *, regexp_extract(header, 'def (f\\d+)', 1) AS name FROM hh) GROUP BY review_id, name")
def hunk_context_symbols(spark, sf):
    return extract.hunk_symbols(patches.split_hunks(feed(spark, sf, feeds.PATCHES_SPARK))).select("review_id", "name", "kind", "line_start")


S_CTE = f"WITH s AS ({duck(feeds.SCRIPT)})"
DECL = (
    "d AS (SELECT review_id, path, line_no, line, CASE WHEN line LIKE '%function %' THEN regexp_extract(line, 'function ([A-Za-z0-9_]+)', 1) WHEN line LIKE 'class %' THEN regexp_extract(line, 'class ([A-Za-z0-9_]+)', 1) "
    "WHEN line LIKE '%=>%' THEN regexp_extract(line, 'const ([A-Za-z0-9_]+)', 1) WHEN line LIKE 'export const%' THEN regexp_extract(line, 'const ([A-Za-z0-9_]+)', 1) WHEN line LIKE '  async load%' THEN regexp_extract(line, 'async ([A-Za-z0-9_]+)', 1) END AS name, "
    "CASE WHEN line LIKE '%async function %' THEN 'async function' WHEN line LIKE 'class %' THEN 'class' WHEN line LIKE '%=>%' THEN 'function' WHEN line LIKE 'export const%' THEN 'export' WHEN line LIKE '  async load%' THEN 'async method' END AS kind FROM s)"
)


@query(f"{S_CTE}, {DECL} SELECT review_id, path, line_no, name, kind FROM d WHERE name IS NOT NULL")
def js_declarations(spark, sf):
    return extract.js_declarations(feed(spark, sf, feeds.SCRIPT))


@query(
    f"{S_CTE} SELECT review_id, path, line_no, k::INT AS k, name FROM (SELECT review_id, path, line_no, 0 AS k, regexp_extract(line, '\"([^\"]+)\"', 1) AS name FROM s WHERE line LIKE '  import m from%' "
    "UNION ALL SELECT review_id, path, line_no, 0, regexp_extract(line, '\"([^\"]+)\"', 1) FROM s WHERE line LIKE '%require(%')"
)
def js_imports(spark, sf):
    return extract.js_imports(feed(spark, sf, feeds.SCRIPT))


@query(
    f"{S_CTE}, c AS (SELECT review_id, path, line_no, unnest(CASE WHEN line LIKE '%await api%' THEN [regexp_extract(line, 'api[.]get[0-9]+', 0)] WHEN line LIKE '%require(%' THEN ['require', regexp_extract(line, 'run[0-9]+', 0)] "
    "WHEN line LIKE '  if (%' THEN [regexp_extract(line, 'go[.]on[0-9]+', 0)] ELSE [] END) AS name FROM s WHERE line_no % 3 <> 1) SELECT review_id, path, line_no, name FROM c"
)
def js_calls(spark, sf):
    lines = feed(spark, sf, feeds.SCRIPT)
    affected = lines.filter("line_no % 3 <> 1").select("review_id", "path", F.col("line_no").alias("line"))
    return extract.js_calls(lines, affected).select("review_id", "path", "line_no", "name")


@query(
    f"{S_CTE}, {DECL}, b AS (SELECT review_id, path, line_no, length(line) - length(replace(line, '{{', '')) AS o, length(line) - length(replace(line, '{{', '')) - length(line) + length(replace(line, '}}', '')) AS net FROM s), "
    "c AS (SELECT *, sum(net) OVER (PARTITION BY review_id, path ORDER BY line_no) AS depth FROM b), x AS (SELECT d.review_id, d.path, d.line_no, (SELECT min(c.line_no) FROM c WHERE c.review_id = d.review_id AND c.path = d.path AND c.line_no >= d.line_no AND c.o > 0) AS st FROM d WHERE name IS NOT NULL), "
    "y AS (SELECT x.*, c.depth - c.net AS base FROM x LEFT JOIN c ON c.review_id = x.review_id AND c.path = x.path AND c.line_no = x.st) "
    "SELECT y.review_id, y.path, y.line_no, coalesce((SELECT min(c.line_no) FROM c WHERE c.review_id = y.review_id AND c.path = y.path AND c.line_no >= y.st AND c.depth <= y.base), y.line_no)::INT AS end_line FROM y"
)
def brace_block_end(spark, sf):
    lines = feed(spark, sf, feeds.SCRIPT)
    return extract.block_ends(lines, extract.js_declarations(lines)).select("review_id", "path", "line_no", F.col("end_line").cast("int").alias("end_line"))


ITEMS = "SELECT CAST(user_id AS BIGINT) AS review_id, " + feeds.pick("event_id", feeds.CODE_PATHS) + " AS path, " + feeds.pick("event_id * 3", ["symbol", "import", "call", "import"]) + " AS class, CAST(event_id AS BIGINT) AS ord FROM {events}"


@query(
    f"WITH i AS ({duck(ITEMS)}), r AS (SELECT *, row_number() OVER (PARTITION BY review_id, path ORDER BY CASE class WHEN 'symbol' THEN 0 WHEN 'call' THEN 1 ELSE 2 END, ord) AS p, count(*) OVER (PARTITION BY review_id, path) AS n FROM i) "
    "SELECT review_id, path, class, ord, greatest(n - 12, 0) AS omitted FROM r WHERE p <= 12"
)
def evidence_cap(spark, sf):
    kept, omitted = extract.evidence_cap(feed(spark, sf, ITEMS), 12)
    return kept.join(omitted, ["review_id", "path"], "left").select("review_id", "path", "class", "ord", F.coalesce("omitted", F.lit(0)).cast("long").alias("omitted"))


@query(f"WITH c AS ({duck(feeds.CALLS)}) SELECT review_id, path, name, min(call_ord) AS call_ord FROM c GROUP BY ALL")
def first_seen_distinct(spark, sf):
    return extract.first_seen(feed(spark, sf, feeds.CALLS), ["review_id", "path", "name"], "call_ord")


@query(
    "WITH t AS (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN ' `a` ``b' WHEN 1 THEN '`' ELSE ' \"q\" ' || chr(92) END AS v FROM pages), "
    "r AS (SELECT *, coalesce(list_max(list_transform(regexp_extract_all(v, '`+'), lambda x: length(x))), 0) + 1 AS n FROM t) "
    "SELECT page_id, repeat('`', n) || CASE WHEN v LIKE '`%' OR v LIKE '%`' THEN ' ' ELSE '' END || v || CASE WHEN v LIKE '`%' OR v LIKE '%`' THEN ' ' ELSE '' END || repeat('`', n) AS code, "
    "'\"' || replace(replace(v, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || '\"' AS quoted FROM r"
)
def safe_quoting(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    tail = F.when(F.col("page_id") % 3 == 0, " `a` ``b").when(F.col("page_id") % 3 == 1, "`").otherwise(' "q" \\')
    v = F.concat("url", tail)
    return rows.select("page_id", T.inline_code(v).alias("code"), T.json_quoted(v).alias("quoted"))
