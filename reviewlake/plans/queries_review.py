"""Queries over effects, questions, answers and reports, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions import wording as W
from ..functions.staging import cut
from ..operators import effects, extract, filtering, grading, questions, report, selection, summarize
from ..operators.effects import citation
from ..sources import feeds, transcript
from ..sources.feeds import duck, feed
from .queries_files import DOC, F_CTE, TEST, effects_with_evidence, sql_list

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


C_CTE = f"WITH c AS ({duck(feeds.CALLS)}), i AS ({duck(feeds.IMPORTS)}), h AS ({duck(feeds.HUNKS)})"
HIT = ", ch AS (SELECT c.*, m.hunk_ord, m.header AS hunk_header FROM c LEFT JOIN (SELECT c.review_id, call_ord, min(hunk_ord) AS hunk_ord, arg_min(header, hunk_ord) AS header FROM c JOIN h USING (review_id, path) WHERE line_start BETWEEN new_start AND new_start + new_lines - 1 GROUP BY ALL) m USING (review_id, call_ord))"
PARTS = "list_filter(string_split(lower(name), '.'), lambda x: x <> '')"
ROOTS = sql_list(L.NETWORK_ROOTS)
ALIAS = f", al AS (SELECT review_id, path, lower(local_name) AS alias, arg_max(lower(name), ref_ord) AS target FROM i WHERE len(list_filter({PARTS}, lambda x: x IN {ROOTS})) > 0 GROUP BY ALL), ca AS (SELECT ch.*, {PARTS} AS p, target FROM ch LEFT JOIN al ON al.review_id = ch.review_id AND al.path = ch.path AND al.alias = ({PARTS.replace('name', 'ch.name')})[1])"
OWN = "len(list_filter(p[1:-2], lambda x: x IN {s})) > 0"
KIND = (
    f", k AS (SELECT *, CASE WHEN p[-1] IN {sql_list(L.TRANSACTION_CALLS)} OR (p[-1] IN {sql_list(L.OWNED_TRANSACTION_CALLS)} AND {OWN.replace('{s}', sql_list(L.TRANSACTION_OWNERS))}) THEN '{L.TRANSACTION}' "
    f"WHEN p[-1] IN {sql_list(L.NETWORK_CALLS)} OR len(list_filter(p, lambda x: x IN {ROOTS})) > 0 OR (len(p) > 1 AND p[1] IN {sql_list(L.NETWORK_OWNERS)} AND p[-1] IN {sql_list(L.NETWORK_METHODS)}) "
    f"OR (target IS NOT NULL AND CASE WHEN len(p) > 1 THEN p[-1] IN {sql_list(L.NETWORK_METHODS)} ELSE string_split(target, '.')[-1] IN {sql_list(L.NETWORK_METHODS)} END) THEN '{L.NETWORK}' "
    f"WHEN p[-1] IN {sql_list(L.MESSAGE_CALLS)} THEN '{L.MESSAGE}' WHEN p[-1] IN {sql_list(L.FILE_CALLS)} OR (p[-1] = 'write' AND {OWN.replace('{s}', sql_list(L.FILE_OWNERS))}) THEN '{L.FILE_WRITE}' "
    f"WHEN p[-1] IN {sql_list(L.DATABASE_CALLS)} OR (p[-1] IN {sql_list(L.OWNED_DATABASE_CALLS)} AND {OWN.replace('{s}', sql_list(L.DATABASE_OWNERS))}) THEN '{L.DATABASE}' END AS kind FROM ca)"
)


@query(f"{C_CTE}{HIT} SELECT review_id, call_ord, hunk_ord, hunk_header FROM ch")
def call_hunk_range_join(spark, sf):
    return effects.with_hunk(feed(spark, sf, feeds.CALLS), feed(spark, sf, feeds.HUNKS)).select("review_id", "call_ord", "hunk_ord", "hunk_header")


@query(f"{C_CTE}{HIT}{ALIAS} SELECT review_id, call_ord, target FROM ca")
def import_alias_join(spark, sf):
    return effects.with_alias(feed(spark, sf, feeds.CALLS), feed(spark, sf, feeds.IMPORTS)).select("review_id", "call_ord", "target")


def classified_calls(spark, sf):
    c = effects.with_hunk(feed(spark, sf, feeds.CALLS), feed(spark, sf, feeds.HUNKS))
    c = effects.with_alias(c, feed(spark, sf, feeds.IMPORTS))
    return c.withColumn("kind", effects.side_effect(F.col("name"), F.col("target"), F.lit(False)))


@query(f"{C_CTE}{HIT}{ALIAS}{KIND} SELECT review_id, call_ord, name, kind FROM k")
def side_effect_classify(spark, sf):
    return classified_calls(spark, sf).select("review_id", "call_ord", "name", "kind")


DEDUPED = f"{C_CTE}{HIT}{ALIAS}{KIND}, d AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY call_ord) AS place FROM (SELECT review_id, kind, path, lower(name) AS n, hunk_header, min(call_ord) AS call_ord FROM k WHERE kind IS NOT NULL GROUP BY ALL))"


@query(f"{DEDUPED} SELECT review_id, call_ord, kind, path FROM d WHERE place <= 10")
def side_effect_dedupe_cap(spark, sf):
    kept, _ = effects.deduped(classified_calls(spark, sf).filter("kind is not null"), most=10)
    return kept.select("review_id", "call_ord", "kind", "path")


@query(f"{DEDUPED}, n AS (SELECT review_id, count(*) - 10 AS x FROM d GROUP BY review_id) SELECT review_id, 'Omitted ' || x || CASE WHEN x = 1 THEN ' likely side-effect signal' ELSE ' likely side-effect signals' END || ' because the output limit is 10.' AS note FROM n WHERE x > 0")
def omission_notes(spark, sf):
    _, omitted = effects.deduped(classified_calls(spark, sf).filter("kind is not null"), most=10)
    return omitted.select("review_id", effects.cap_note(F.col("omitted"), 10).alias("note"))


@query(
    f"{C_CTE}{HIT}{ALIAS}{KIND}, u AS (SELECT review_id, count(*) AS used FROM k WHERE kind = '{L.TRANSACTION}' GROUP BY review_id), d AS (SELECT review_id, kind, path, lower(name) AS n, hunk_header, min(call_ord) AS call_ord FROM k WHERE kind IS NOT NULL GROUP BY ALL), "
    f"p AS (SELECT d.*, row_number() OVER (PARTITION BY review_id ORDER BY call_ord) + coalesce(used, 0) AS place FROM d LEFT JOIN u USING (review_id) WHERE kind <> '{L.TRANSACTION}') SELECT review_id, call_ord, kind, path FROM p WHERE place <= 20"
)
def effects_appended(spark, sf):
    """Signals added to those that are known already: here all transactions are, and take from the limit of 20."""
    found = classified_calls(spark, sf).filter("kind is not null")
    kept, _ = effects.deduped(found, existing=found.filter(F.col("kind") == L.TRANSACTION), most=20)
    return kept.select("review_id", "call_ord", "kind", "path")


E_SQL = f"e AS ({duck(feeds.EFFECTS)})"


@query(f"{F_CTE}, {E_SQL} SELECT e.review_id, kind, min(effect_ord) AS first_ord, arg_min(description, effect_ord) AS description, count(DISTINCT (path, symbol, hunk_header, line_start))::BIGINT AS n_evidence FROM e WHERE EXISTS (SELECT 1 FROM f WHERE f.review_id = e.review_id AND f.path = e.path) GROUP BY ALL")
def side_effects_by_kind(spark, sf):
    rows = summarize.effects_by_kind(effects_with_evidence(spark, sf), feed(spark, sf, feeds.FILES))
    return rows.select("review_id", "kind", "first_ord", "description", F.size("evidence").cast("long").alias("n_evidence"))


S_SQL = f"s AS ({duck(feeds.SYMBOLS)})"
U_SQL = f"ev AS (SELECT review_id, path FROM s UNION SELECT review_id, path FROM e), u AS (SELECT f.*, {TEST} AS is_test FROM f WHERE NOT is_binary AND NOT {DOC} AND (has_hunks OR EXISTS (SELECT 1 FROM ev WHERE ev.review_id = f.review_id AND ev.path = f.path)))"
PRIM = (
    "ps AS (SELECT s.review_id, arg_min({'path': s.path, 'name': name, 'line': s.line_start}, row(ut.is_test, origin = 'hunk context fallback', symbol_ord)) AS x FROM s JOIN (SELECT DISTINCT review_id, path, is_test FROM u) ut USING (review_id, path) GROUP BY s.review_id), "
    "pf AS (SELECT review_id, arg_min(path, row(is_test, file_ord)) AS fp FROM u GROUP BY review_id), "
    "pp AS (SELECT review_id, coalesce(x.path, fp) AS path, x.name AS name, x.line AS line FROM pf LEFT JOIN ps USING (review_id)), "
    "pr AS (SELECT pp.*, (SELECT arg_min(status, file_ord) FROM u WHERE u.review_id = pp.review_id AND u.path = pp.path) AS status, CASE WHEN name IS NULL THEN '' ELSE '`' || name || '` in ' END || '\"' || path || '\"' AS area FROM pp)"
)
BASE = f"{F_CTE}, {S_SQL}, {E_SQL}, {U_SQL}, {PRIM}"


def context(spark, sf):
    files = filtering.classified(feed(spark, sf, feeds.FILES))
    symbols, found = feed(spark, sf, feeds.SYMBOLS), effects_with_evidence(spark, sf)
    paths = symbols.select("review_id", "path").union(feed(spark, sf, feeds.EFFECTS).select("review_id", "path"))
    files, symbols, found = cut(files), cut(symbols), cut(found)
    return files, cut(filtering.analyzable(files, paths)), symbols, found


@query(f"{BASE} SELECT review_id, x.path AS path, x.name AS name, x.line AS line_start FROM ps")
def primary_symbol(spark, sf):
    _, usable, symbols, _ = context(spark, sf)
    return questions.primary_symbols(symbols, usable)


VALID = ", v AS (SELECT e.*, 0 AS c FROM e WHERE EXISTS (SELECT 1 FROM u WHERE u.review_id = e.review_id AND u.path = e.path))"
PAIR = (
    f", pa AS (SELECT a.review_id, a.kind AS ext_kind, a.path, a.symbol AS ext_symbol, b.symbol AS txn_symbol, row_number() OVER (PARTITION BY a.review_id ORDER BY CASE a.kind WHEN '{L.NETWORK}' THEN 0 WHEN '{L.MESSAGE}' THEN 1 ELSE 2 END, a.effect_ord, b.effect_ord) AS r "
    f"FROM v a JOIN v b ON a.review_id = b.review_id AND a.path = b.path AND a.hunk_header = b.hunk_header WHERE b.kind = '{L.TRANSACTION}' AND a.kind IN {sql_list(L.EXTERNAL)})"
)


IN_CODE = feeds.EFFECTS.replace(feeds._DIR + " || " + feeds._NAME + " AS path", feeds.pick("CAST(floor(event_id / 5) AS BIGINT)", feeds.CODE_PATHS) + " AS path")


@query(f"WITH v AS ({duck(IN_CODE)}){PAIR} SELECT review_id, ext_kind, path, ext_symbol, txn_symbol FROM pa WHERE r = 1")
def partial_success_pair(spark, sf):
    """Over effects in four files of each review, so that pairs occur."""
    e = feed(spark, sf, IN_CODE)
    c = citation("call", F.col("path"), F.col("symbol"), F.col("hunk_header"), F.col("line_start"), F.col("line_start"), F.lit("n"))
    found = e.select("review_id", "effect_ord", "kind", "description", F.array(c).alias("evidence"))
    rows = questions.partial_success(questions.valid_effects(found, e.select("review_id", "path")))
    return rows.select("review_id", "ext_kind", F.col("ext.file_path").alias("path"), F.col("ext.symbol").alias("ext_symbol"), F.col("txn.symbol").alias("txn_symbol"))


def asked(spark, sf, category):
    rows = questions.generate(*context(spark, sf)).filter(F.col("category") == category)
    return rows.select("review_id", "prompt", "rationale", F.size("references").cast("long").alias("n_references"))


@query(
    f"{BASE} SELECT review_id, CASE status WHEN 'deleted' THEN 'What behavior does removing ' || area || ' eliminate, and how does that affect the surrounding flow?' WHEN 'added' THEN 'What behavior does ' || area || ' introduce, and how does it affect the surrounding flow?' "
    "WHEN 'renamed' THEN 'What behavior, if any, changes when ' || area || ' is renamed, and how does the move affect the surrounding flow?' ELSE 'What behavior does ' || area || ' modify, and how does it affect the surrounding flow?' END AS prompt, "
    "'The branch ' || CASE status WHEN 'deleted' THEN 'removes ' WHEN 'added' THEN 'adds ' WHEN 'renamed' THEN 'renames ' ELSE 'modifies ' END || area || '.' AS rationale, 1::BIGINT AS n_references FROM pr"
)
def behavior_question(spark, sf):
    return asked(spark, sf, "behavior")


@query(
    f"{BASE}{VALID}{PAIR}, one AS (SELECT review_id, arg_min({{'kind': kind, 'area': '`' || symbol || '` in \"' || path || '\"'}}, effect_ord) AS o FROM v GROUP BY review_id), x AS (SELECT pr.review_id, area, o, pa.*, '\"' || pa.path || '\"' AS q FROM pr LEFT JOIN pa ON pa.review_id = pr.review_id AND r = 1 LEFT JOIN one ON one.review_id = pr.review_id) "
    f"SELECT review_id, CASE WHEN ext_kind IS NOT NULL THEN 'If the likely ' || ext_kind || ' at `' || ext_symbol || '` in ' || q || ' succeeds but the {L.TRANSACTION} at `' || txn_symbol || '` in ' || q || ' does not complete, what state can remain, and how does ' || area || ' handle retry or recovery?' "
    "WHEN o IS NOT NULL THEN 'The branch contains a likely ' || o.kind || ' at ' || o.area || '. What failure mode matters most, and how should the changed flow account for it?' ELSE 'What failure mode is most important for ' || area || ', and how does the changed code handle it?' END AS prompt, "
    f"CASE WHEN ext_kind IS NOT NULL THEN 'The branch has both ' || ext_kind || ' and {L.TRANSACTION} signals, so partial success may cross a rollback boundary.' WHEN o IS NOT NULL THEN 'The changed code contains a repository-backed ' || o.kind || ' signal.' "
    "ELSE 'Reasoning about failure behavior is necessary for the change in ' || area || '.' END AS rationale, CASE WHEN ext_kind IS NOT NULL THEN 2 ELSE 1 END::BIGINT AS n_references FROM x"
)
def failure_question(spark, sf):
    return asked(spark, sf, "failure")


@query(
    f"{BASE}, t AS (SELECT review_id, '\"' || arg_min(path, file_ord) || '\"' AS test FROM u WHERE is_test GROUP BY review_id) SELECT review_id, CASE WHEN test IS NOT NULL THEN 'What evidence, if any, does ' || test || ' provide for the behavior of ' || area || ', and which important path remains unverified?' "
    "ELSE 'Which test, invariant, or code path provides the strongest evidence that ' || area || ' behaves as intended?' END AS prompt, CASE WHEN test IS NOT NULL THEN 'The branch changes both ' || area || ' and ' || test || '; their relationship should be established from repository evidence.' "
    "ELSE 'The intended behavior of ' || area || ' should be supported by repository evidence.' END AS rationale, CASE WHEN test IS NULL THEN 1 ELSE 2 END::BIGINT AS n_references FROM pr LEFT JOIN t USING (review_id)"
)
def evidence_question(spark, sf):
    return asked(spark, sf, "evidence")


@query(f"{F_CTE}, {S_SQL}, {E_SQL}, {U_SQL}, us AS (SELECT DISTINCT review_id, 1 AS x FROM u) SELECT review_id, CASE WHEN bool_and({DOC}) THEN 'documentation_only' WHEN max(x) IS NULL THEN 'no_evidence' ELSE 'ok' END AS status FROM f LEFT JOIN us USING (review_id) GROUP BY review_id")
def review_status(spark, sf):
    files, usable, _, _ = context(spark, sf)
    return questions.review_status(files, usable)


def norm(x: str) -> str:
    x = f"regexp_replace({x}, '\\b(does|do|did|is|are|was|were|can|will)n[''’]?t\\b', '\\1 not', 'g')"
    x = f"regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


QA = f"qa AS ({duck(feeds.QA)})"


@query(f"WITH {QA} SELECT review_id, turn, {norm('answer')} AS normalized, {norm('question || answer')} AS both_normalized FROM qa")
def normalize_text(spark, sf):
    return feed(spark, sf, feeds.QA).select("review_id", "turn", T.normalize(F.col("answer")).alias("normalized"), T.normalize(F.concat("question", "answer")).alias("both_normalized"))


NAMES = "SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'api.getUserBy' || CAST(page_id AS STRING) ELSE 'handlePaymentNow' || CAST(page_id % 5 AS STRING) END AS v FROM {pages}"
PHRASES = (
    f"n AS ({duck(NAMES)}), n1 AS (SELECT *, {norm('v')} AS a, string_split(v, '/')[-1] AS nm, {norm('string_split(v, chr(46))[-1]')} AS l FROM n), "
    f"n2 AS (SELECT *, regexp_replace(regexp_replace(l, '^((?:{T.words_in(L.LEADING_WORDS)})( |$))+', ''), '^by( |$)', '') AS lead FROM n1), "
    f"n3 AS (SELECT page_id, v, CASE WHEN contains(v, '/') THEN [a, {norm('nm')}, {norm(chr(99) + 'ase when regexp_matches(nm, ' + chr(39) + '^.+[.][^.]+$' + chr(39) + ') then regexp_extract(nm, ' + chr(39) + '^(.+)[.][^.]+$' + chr(39) + ', 1) else nm end')}] ELSE [a, l, CASE WHEN contains(lead, ' ') THEN lead ELSE '' END] END AS ps FROM n2), "
    f"ph AS (SELECT page_id, v, p, min(i) AS i FROM (SELECT page_id, v, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM n3) WHERE contains(p, ' ') OR (length(p) >= 5 AND p NOT IN {sql_list(L.GENERIC_WORDS)}) GROUP BY ALL)"
)


@query(f"WITH {PHRASES} SELECT page_id, n.v, coalesce(string_agg(p, '|' ORDER BY i), '') AS phrases FROM n LEFT JOIN ph USING (page_id) GROUP BY page_id, n.v")
def concept_phrases(spark, sf):
    return feed(spark, sf, NAMES).select("page_id", "v", F.array_join(T.phrases(F.col("v")), "|").alias("phrases"))


R_SQL = f"r AS ({duck(feeds.REPLIES)})"
SYMBOL_NAMES = "sn AS (SELECT DISTINCT review_id, name FROM s)"


@query(
    f"WITH {R_SQL}, {S_SQL}, {SYMBOL_NAMES}, t AS (SELECT *, ' ' || {norm('raw_text')} || ' ' AS t FROM r) SELECT t.review_id, reply_ord, name, contains(t, ' ' || {norm('name')} || ' ') AS matched FROM t JOIN sn USING (review_id)"
)
def concept_match(spark, sf):
    names, replies = named_and_said(spark, sf)
    return replies.join(names, "review_id").select("review_id", "reply_ord", "name", T.mentions(F.col("spaced"), F.col("phrases")).alias("matched"))


def named_and_said(spark, sf):
    """Symbol names with their phrases, and replies as normalised text: each is worked out once, before they meet."""
    names = feed(spark, sf, feeds.SYMBOLS).select("review_id", "name").distinct()
    replies = feed(spark, sf, feeds.REPLIES).select("review_id", "reply_ord", T.padded(T.normalize(F.col("raw_text"))).alias("spaced"))
    return names.withColumn("phrases", T.phrases(F.col("name"))), replies


@query(
    f"WITH {R_SQL}, {S_SQL}, {SYMBOL_NAMES}, t AS (SELECT *, ' ' || {norm('raw_text')} || ' ' AS t FROM r) SELECT t.review_id, reply_ord, count(*) FILTER (NOT contains(t, ' ' || {norm('name')} || ' ')) AS n_missing FROM t JOIN sn USING (review_id) GROUP BY ALL"
)
def missing_citations_anti(spark, sf):
    names, replies = named_and_said(spark, sf)
    rows = replies.join(names.groupBy("review_id").agg(F.collect_list("phrases").alias("names")), "review_id")
    return rows.select("review_id", "reply_ord", F.size(F.filter("names", lambda n: ~T.mentions(F.col("spaced"), n))).cast("long").alias("n_missing"))


CLAIM = "'call n3', 'processor charge', 'call n1', 'network call', 'external effect'"
ACTIVE = "regexp_extract(t, '(\\b(?:rollback|roll back|rolls back|rolled back)\\b.{0,60}\\b(?:undo(?:es|ne)?|revert(?:s|ed)?|reverse[ds]?|cancel(?:s|led)?)\\b\\s+(?:(?:a|an|cited|external|likely|the|this|that)\\s+)*\\b' || p || '\\b)', 1)"


PASSIVE_SQL = "regexp_matches(t, '\\b' || p || '\\b.{0,30}\\b(is|gets|got|was|will be|would be)\\s+(undone|reverted|reversed|cancell?ed)\\b.{0,30}\\b(rollback|roll back|rolls back|rolled back)\\b')"
NEGATED_SQL = (
    "regexp_matches(regexp_extract(rel, '^(.*?)\\b(?:undo(?:es|ne)?|revert(?:s|ed)?|reverse[ds]?|cancel(?:s|led)?)\\b', 1), "
    "'\\b(cannot|cant|never|wont|not)(\\s+(actually|automatically|completely|directly|fully|itself|necessarily|possibly|reliably|able\\s+to|guaranteed\\s+to))?\\s*$')"
)


@query(
    f"WITH {R_SQL}, t AS (SELECT review_id, reply_ord, {norm('raw_text')} AS t, unnest([{CLAIM}]) AS p FROM r), x AS (SELECT *, {ACTIVE} AS rel FROM t) "
    f"SELECT review_id, reply_ord, bool_or({PASSIVE_SQL} OR (rel <> '' AND NOT {NEGATED_SQL})) AS conflict FROM x GROUP BY ALL"
)
def rollback_conflict(spark, sf):
    claims = F.array(*[F.lit(c.strip(" '")) for c in CLAIM.split(",")])
    return feed(spark, sf, feeds.REPLIES).select("review_id", "reply_ord", grading.rollback_conflict(T.normalize(F.col("raw_text")), claims).alias("conflict"))


def graded(spark, sf, category=None):
    """Small stand-in reviews: one question of each kind (or of one kind) about fixed symbols, answered by the replies.
    Assessments that several results are made of are staged."""
    replies = feed(spark, sf, feeds.REPLIES)
    ids = replies.select(F.col("reply_ord").alias("review_id"))
    one = lambda *items: F.explode(F.array(*items)).alias("x")
    files = ids.select("review_id", one(*[F.struct(F.lit(i).alias("file_ord"), F.lit(p).alias("path"), F.lit(t).alias("is_test")) for i, (p, t) in enumerate((("src/pay.py", False), ("tests/test_pay.py", True)))])).select("review_id", "x.*")
    symbols = ids.select("review_id", one(*[F.struct(F.lit(i).alias("symbol_ord"), F.lit("src/pay.py").alias("path"), F.lit(n).alias("name"), F.lit(i).alias("line_start")) for i, n in enumerate(("handle3", "handle5"))])).select("review_id", "x.*")
    calls = ids.select("review_id", F.lit(0).alias("call_ord"), F.lit("src/pay.py").alias("path"), F.lit("call.n2").alias("name"), F.lit(9).alias("line_start"))
    c = lambda name: citation("call", F.lit("src/pay.py"), F.lit(name), F.lit("@@"), F.lit(1), F.lit(1))
    found = ids.select("review_id", one(*[F.struct(F.lit(i).alias("effect_ord"), F.lit(k).alias("kind"), F.array(c(n)).alias("evidence")) for i, (k, n) in enumerate(((L.TRANSACTION, "database.transaction"), (L.NETWORK, "processor.charge"), (L.NETWORK, "call.n3")))])).select("review_id", "x.*")
    sym = citation("symbol", F.lit("src/pay.py"), F.lit("handle3"), line=F.lit(0))
    q = [
        ("behavior", F.array(sym)), ("failure", F.array(c("call.n3"), c("database.transaction"), c("processor.charge"))),
        ("evidence", F.array(citation("symbol", F.lit("src/pay.py"), F.lit("handle5"), line=F.lit(1)), citation("test", F.lit("tests/test_pay.py")))),
    ]
    asked_ = ids.select("review_id", one(*[F.struct(F.lit(i).alias("question_ord"), F.lit(n).alias("id"), F.lit(n).alias("category"), r.alias("references")) for i, (n, r) in enumerate(q) if category in (None, n)])).select("review_id", "x.*")
    answers = replies.select(F.col("reply_ord").alias("review_id"), F.explode(F.array(*[F.lit(n) for n, _ in q if category in (None, n)])).alias("question_id"), "raw_text", "skipped")
    a = grading.grade(asked_, answers, files, symbols, calls, found)
    return asked_, a if category else cut(a), files


GRADED = (
    f"WITH {R_SQL}, t AS (SELECT reply_ord AS review_id, skipped, ' ' || {norm('raw_text')} || ' ' AS t FROM r), m AS (SELECT *, contains(t, ' handle3 ') AS h3, contains(t, ' handle5 ') AS h5, contains(t, ' call n2 ') AS c2, contains(t, ' call n3 ') AS c3, "
    "contains(t, ' network call ') OR contains(t, ' external effect ') OR contains(t, ' external operation ') AS ext, contains(t, ' database transaction ') OR contains(t, ' transaction boundary ') AS txn, contains(t, ' processor charge ') OR contains(t, ' charge ') AS ch, "
    "contains(t, ' transaction ') AS tx1, contains(t, 'retry') OR contains(t, 'recover') OR contains(t, 'reconcile') OR contains(t, 'duplicate') AS rec, regexp_matches(t, '\\b(assert|check|cover|demonstrate|evidence|ensure|prove|return|support|verify)') AS sup, "
    "regexp_matches(t, '\\b((does|do|did|is|are|was|were) not (cover|test|verify|exercise)|not (covered|tested|verified)|(missing|uncovered|unverified) (case|path|scenario|test|coverage))\\b') AS unc FROM t), "
    "g AS (SELECT *, h3 OR h5 OR c2 OR c3 OR ext OR txn OR tx1 OR ch AS anyhit FROM m) "
)


@query(GRADED + "SELECT review_id, CASE WHEN skipped OR NOT anyhit THEN 'Uncertain' WHEN h3 AND (h5 OR c2 OR c3 OR ext OR txn OR tx1 OR ch) THEN 'Strong' ELSE 'Partial' END AS label FROM g")
def grade_behavior(spark, sf):
    return graded(spark, sf, "behavior")[1].select("review_id", "label")


@query(
    GRADED + "SELECT review_id, CASE WHEN skipped OR NOT anyhit THEN 'Uncertain' WHEN regexp_matches(t, 'rollback undoes processor charge') OR regexp_matches(t, 'call n1 is reverted by the rollback') AND false THEN 'Gap found' "
    "WHEN (c3 OR ext) AND (txn OR tx1) AND (ch OR ext) AND rec THEN 'Strong' ELSE 'Partial' END AS label FROM g"
)
def grade_failure(spark, sf):
    return graded(spark, sf, "failure")[1].select("review_id", "label")


@query(GRADED + "SELECT review_id, CASE WHEN skipped OR NOT anyhit THEN 'Uncertain' WHEN h5 AND contains(t, ' tests test pay py ') AND sup AND unc THEN 'Strong' ELSE 'Partial' END AS label FROM g")
def grade_evidence(spark, sf):
    return graded(spark, sf, "evidence")[1].select("review_id", "label")


def _graded_sql() -> str:
    """Common tables up to ga: whole assessments of the stand-in reviews, lists as lines. What a question cites goes first, then all else in the order of the
    concepts: effects, symbols, calls, tests, files."""
    all_ = [
        ("database.transaction", "src/pay.py", "txn OR tx1"), ("processor.charge", "src/pay.py", "ch OR ext"), ("call.n3", "src/pay.py", "c3 OR ext"), ("handle3", "src/pay.py", "h3"),
        ("handle5", "src/pay.py", "h5"), ("call.n2", "src/pay.py", "c2"), ("tests/test_pay.py", "tests/test_pay.py", "tp"), ("src/pay.py", "src/pay.py", "sp"),
    ]
    cited = {"behavior": ["handle3"], "failure": ["call.n3", "database.transaction", "processor.charge"], "evidence": ["handle5", "tests/test_pay.py"]}
    lines = {"behavior": W.BEHAVIOR_MISSING, "failure": W.FAILURE_MISSING, "evidence": W.EVIDENCE_MISSING}
    strong = {"behavior": "h3 AND (txn OR tx1 OR ch OR ext OR c3 OR h5 OR c2)", "failure": "(c3 OR ext) AND (txn OR tx1) AND (ch OR ext) AND rec", "evidence": "h5 AND tp AND sup AND unc"}
    more = {
        "behavior": f"CASE WHEN NOT (txn OR tx1 OR ch OR ext OR c3 OR h5 OR c2) THEN '{W.BEHAVIOR_SECOND}' END", "failure": f"CASE WHEN NOT rec THEN '{W.FAILURE_RECOVERY}' END",
        "evidence": f"CASE WHEN NOT sup THEN '{W.EVIDENCE_SUPPORT}' END, CASE WHEN NOT unc THEN '{W.EVIDENCE_UNCOVERED}' END",
    }
    named = lambda n, p: f"`{n}` in `{p}`"
    joined = lambda items: "array_to_string(list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL), '|')"
    parts = []
    for category, own in cited.items():
        of = {n: (p, hit) for n, p, hit in all_}
        order = own + [n for n, _, _ in all_ if n not in own]
        strengths = joined([f"CASE WHEN {of[n][1]} THEN '{W.STRENGTH.format(named=named(n, of[n][0]))}' END" for n in order])
        gaps = joined([f"CASE WHEN NOT ({of[n][1]}) THEN '{lines[category].format(named=named(n, of[n][0]))}' END" for n in own] + [more[category]])
        matched = joined([f"CASE WHEN {of[n][1]} THEN '{n}' END" for n in order])
        evidence = joined([f"'{n}'" for n in own] + [f"CASE WHEN ({of[n][1]}) AND NOT unsure THEN '{n}' END" for n in order if n not in own])
        gap = f"WHEN conflict THEN '{L.GAP}' " if category == "failure" else ""
        parts.append(
            f"SELECT review_id, '{category}' AS question_id, CASE WHEN unsure THEN '{L.UNCERTAIN}' {gap}WHEN {strong[category]} THEN '{L.STRONG}' ELSE '{L.PARTIAL}' END AS label, skipped, "
            f"{strengths} AS s, {gaps} AS g, {evidence} AS evidence, {matched} AS matched FROM z"
        )
    summary = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.SUMMARIES.items())
    claims = "'call n3', 'processor charge', 'charge', 'network call', 'external effect', 'external operation'"
    return (
        GRADED + f", p AS (SELECT review_id, trim(t) AS t, unnest([{claims}]) AS p FROM g), x AS (SELECT review_id, t, p, {ACTIVE} AS rel FROM p), "
        f"cf AS (SELECT review_id, bool_or({PASSIVE_SQL} OR (rel <> '' AND NOT {NEGATED_SQL})) AS conflict FROM x GROUP BY ALL), "
        "w AS (SELECT g.*, conflict, contains(t, ' tests test pay py ') OR contains(t, ' test pay py ') OR contains(t, ' test pay ') AS tp, contains(t, ' src pay py ') OR contains(t, ' pay py ') AS sp FROM g JOIN cf USING (review_id)), "
        "z AS (SELECT *, skipped OR NOT (anyhit OR tp OR sp) AS unsure FROM w), "
        f"a AS ({' UNION ALL '.join(parts)}), "
        f"ga AS (SELECT review_id, question_id, label, CASE label {summary} END AS summary, CASE label WHEN '{L.UNCERTAIN}' THEN 'low' ELSE 'medium' END AS confidence, CASE label WHEN '{L.UNCERTAIN}' THEN '' ELSE s END AS strengths, "
        f"CASE label WHEN '{L.UNCERTAIN}' THEN '' WHEN '{L.STRONG}' THEN '' WHEN '{L.GAP}' THEN '{W.REVISIT_ROLLBACK}' ELSE g END AS gaps, "
        f"CASE WHEN label <> '{L.UNCERTAIN}' THEN '' WHEN skipped THEN '{W.SKIPPED}' "
        f"ELSE '{W.NO_MATCH}' END AS uncertainty_notes, evidence, matched FROM a) "
    )


@query(_graded_sql() + "SELECT * EXCLUDE (matched) FROM ga")
def graded_assessments(spark, sf):
    """Whole assessments with their texts; lists as lines."""
    a = graded(spark, sf)[1]
    joined = lambda c: F.array_join(c, "|").alias(c)
    cited = F.array_join(F.transform("evidence", lambda e: F.coalesce(e["symbol"], e["file_path"])), "|").alias("evidence")
    return a.select("review_id", "question_id", "label", "summary", "confidence", joined("strengths"), joined("gaps"), joined("uncertainty_notes"), cited)


A_SQL = f"a AS ({duck(feeds.ASSESSMENTS)})"


def assessment_feed(spark, sf):
    a = feed(spark, sf, feeds.ASSESSMENTS)
    ref = citation(F.col("kind"), F.col("path"), F.col("symbol"))
    q = a.select("review_id", "question_ord", "id", "category")
    out = a.select("review_id", "question_ord", F.col("id").alias("question_id"), "label", F.array("gap").alias("gaps"), F.array(ref).alias("evidence"), F.array(ref).alias("matched_evidence"))
    return q, out, a.select("review_id", F.col("question_ord").alias("file_ord"), "path").filter("path <> 'src/f3.py'")


RANK = "ra AS (SELECT *, CASE label WHEN 'Gap found' THEN 0 WHEN 'Partial' THEN 1 END AS lr, CASE WHEN category = 'failure' THEN 0 ELSE 1 END AS cr FROM a)"


@query(
    f"WITH {A_SQL}, {RANK}, ok AS (SELECT DISTINCT review_id, path FROM a WHERE path <> 'src/f3.py'), c AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY lr, cr, question_ord) AS r FROM ra WHERE lr IS NOT NULL AND trim(gap) <> '' AND (review_id, path) IN (SELECT (review_id, path) FROM ok)) "
    "SELECT review_id, id || '-follow-up' AS id, 'To prepare for review, consider this gap: ' || trim(gap) || ' ' || CASE category WHEN 'failure' THEN 'What retry or reconciliation behavior addresses this risk' WHEN 'evidence' THEN 'How would you explain what the evidence supports and what remains open' "
    "ELSE 'How would you explain the affected behavior' END || ' using `' || coalesce(symbol, path) || '`?' AS prompt FROM c WHERE r = 1"
)
def follow_up_select(spark, sf):
    return selection.follow_ups(*assessment_feed(spark, sf)).select("review_id", "id", "prompt")


@query(
    f"WITH {A_SQL}, {RANK}, c AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY lr, cr, question_ord) AS r FROM ra WHERE lr IS NOT NULL) SELECT review_id, 'Prepare to discuss: ' || trim(gap) AS point FROM c WHERE r = 1"
)
def preparation_point(spark, sf):
    q, a, _ = assessment_feed(spark, sf)
    none = spark.createDataFrame([], "review_id long, first_ord long, description string, evidence array<" + effects.CITATION + ">")
    return selection.preparation_points(q, a, none)


CITE = "'Evidence to cite: `' || path || '`' || CASE WHEN symbol IS NULL THEN '' ELSE '; symbol `' || symbol || '`' END || '.'"


@query(
    f"WITH {A_SQL}, e AS (SELECT *, CASE label WHEN 'Strong' THEN 0 WHEN 'Partial' THEN 2 END + CASE WHEN category = 'evidence' THEN 0 ELSE 1 END AS rk FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY rk, question_ord) AS r FROM e WHERE rk IS NOT NULL) "
    f"SELECT review_id, {CITE} AS point FROM c WHERE r = 1"
)
def evidence_point(spark, sf):
    q, a, _ = assessment_feed(spark, sf)
    return selection.evidence_points(q, a)


@query(
    f"WITH {A_SQL}, {RANK}, c AS (SELECT review_id, arg_min('Prepare to discuss: ' || trim(gap), row(lr, cr, question_ord)) AS pp FROM ra WHERE lr IS NOT NULL GROUP BY review_id), "
    f"e AS (SELECT review_id, arg_min({CITE}, row(CASE label WHEN 'Strong' THEN 0 ELSE 2 END + CASE WHEN category = 'evidence' THEN 0 ELSE 1 END, question_ord)) AS ep FROM a WHERE label IN ('Strong', 'Partial') GROUP BY review_id) "
    "SELECT review_id, 'Explain the change: Likely updates ' || review_id || '.' || coalesce('|' || pp, '') || coalesce('|' || ep, '') AS points FROM (SELECT DISTINCT review_id FROM a) LEFT JOIN c USING (review_id) LEFT JOIN e USING (review_id)"
)
def talking_points(spark, sf):
    q, a, _ = assessment_feed(spark, sf)
    none = spark.createDataFrame([], "review_id long, first_ord long, description string, evidence array<" + effects.CITATION + ">")
    purposes = q.select("review_id").distinct().select("review_id", F.concat(F.lit("Likely  updates "), F.col("review_id").cast("string"), F.lit(".")).alias("purpose"))
    return selection.talking_points(purposes, q, a, none).select("review_id", F.array_join("points", "|").alias("points"))


@query(
    f"WITH {A_SQL}, q AS (SELECT review_id, id FROM a UNION ALL SELECT review_id, id FROM a WHERE question_ord % 50 = 1), s AS (SELECT review_id, id FROM a WHERE question_ord % 70 <> 2), x AS (SELECT review_id, id, count(*) AS n FROM q GROUP BY ALL), y AS (SELECT review_id, id, count(*) AS m FROM s GROUP BY ALL) "
    "SELECT DISTINCT review_id, CASE WHEN n > 1 THEN 'question IDs must be unique' WHEN m > 1 THEN 'assessment IDs must be unique' ELSE 'question and assessment IDs must match' END AS problem FROM x FULL JOIN y USING (review_id, id) WHERE n > 1 OR m > 1 OR n IS NULL OR m IS NULL"
)
def id_constraint_check(spark, sf):
    q, a, _ = assessment_feed(spark, sf)
    q = q.select("review_id", "id", "question_ord")
    return selection.id_problems(q.unionByName(q.filter("question_ord % 50 = 1")), a.filter("question_ord % 70 <> 2"))


TRANSCRIPTS = "SELECT conv_id * 100 + turn AS review_id, replace(text, '. ', chr(10) || CASE WHEN turn % 2 = 0 THEN chr(10) ELSE '' END) || CASE WHEN turn % 3 = 0 THEN chr(10) ELSE '' END AS text FROM {conversations} WHERE text IS NOT NULL"


@query(
    f"WITH t AS ({duck(TRANSCRIPTS)}), l AS (SELECT review_id, u.i, u.x, n FROM (SELECT review_id, len(string_split(text, chr(10))) AS n, unnest(list_transform(string_split(text, chr(10)), lambda x, j: {{'i': j, 'x': regexp_replace(x, '\\r$', '')}})) AS u FROM t)), "
    "m AS (SELECT *, coalesce(sum((x = '')::INT) OVER (PARTITION BY review_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q FROM l WHERE NOT (i = n AND x = '')), "
    "g AS (SELECT review_id, q, string_agg(x, chr(10) ORDER BY i) FILTER (x <> '') AS body FROM m GROUP BY ALL) SELECT t.review_id, k.q::INT AS question_ord, coalesce(body, '') AS raw_text, body IS NULL AS skipped FROM t CROSS JOIN (SELECT unnest([0, 1, 2]) AS q) k LEFT JOIN g ON g.review_id = t.review_id AND g.q = k.q"
)
def answer_transcript_parse(spark, sf):
    return transcript.parse(feed(spark, sf, TRANSCRIPTS))


@query(f"WITH {QA} SELECT review_id, turn, array_to_string(list_transform(string_split(question, chr(10)), lambda x: CASE WHEN x = '' THEN '>' ELSE '> ' || x END), chr(10)) AS quoted FROM qa")
def quote_lines(spark, sf):
    return feed(spark, sf, feeds.QA).select("review_id", "turn", report.quote(F.col("question")).alias("quoted"))


def _markdown_sql() -> str:
    """The report, section by section, over ga; what is cited is named in evidence and matched."""
    effect = lambda n: f"`src/pay.py`; symbol `{n}`; line 1; hunk `@@`"
    shown = {n: effect(n) for n in ("database.transaction", "processor.charge", "call.n3")} | {
        "handle3": "`src/pay.py`; symbol `handle3`; line 0", "handle5": "`src/pay.py`; symbol `handle5`; line 1", "call.n2": "`src/pay.py`; symbol `call.n2`; line 9",
        "tests/test_pay.py": "`tests/test_pay.py`", "src/pay.py": "`src/pay.py`",
    }
    case = lambda x: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in shown.items()) + " END"
    nl = "chr(10)"
    items = lambda c, empty: f"CASE WHEN {c} = '' THEN '- {empty}' ELSE '- ' || replace({c}, '|', {nl} || '- ') END"
    cites = lambda c: f"array_to_string(list_transform(string_split({c}, '|'), lambda x: '- ' || {case('x')}), {nl})"
    asked_ = {"behavior": "handle3", "failure": "call.n3|database.transaction|processor.charge", "evidence": "handle5|tests/test_pay.py"}
    references = "CASE question_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in asked_.items()) + " END"
    gap = f"{nl} || {nl}"
    para = lambda *parts: f" || {gap} || ".join(parts)
    one = para(
        "'### ' || o || '. ' || upper(question_id[1]) || question_id[2:]", "'**Question**'", "'> What about ' || question_id || '?'", "'**Answer**'",
        f"CASE WHEN label = '{L.UNCERTAIN}' THEN '> **Skipped.**' ELSE '> an answer' END", "'**Question Citations**'", cites(references), "'**Assessment:** ' || label",
        "'**Confidence:** ' || confidence", "'**Summary**'", "'> ' || summary", "'**Strengths**'", items("strengths", "No strengths identified."), "'**Gaps**'", items("gaps", "No gaps identified."),
        "'**Uncertainty Notes**'", items("uncertainty_notes", "No uncertainty notes."), "'**Evidence**'", cites("evidence"),
    )
    request = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in W.FOLLOW_UP_REQUEST.items())
    prompt = (
        f"'To prepare for review, consider this gap: ' || string_split(f.gaps, '|')[1] || ' ' || CASE f.question_id {request} ELSE '{W.FOLLOW_UP_REQUEST_ELSE}' END || ' using ' || "
        "array_to_string(list_transform(string_split(f.evidence, '|'), lambda x: '`' || x || '`'), ', ') || '?'"
    )
    head = f"'{report.TITLE}' || {gap} || 'Branch: feature' || {nl} || 'Base branch: main' || {nl} || 'Model mode: local heuristic' || {nl} || 'Generated: 2026-07-18T12:30:45+00:00'"
    purpose = "Likely updates `handle3` across 2 meaningful files."
    follow = para("'## Follow-Up'", "'**Question**'", f"'> ' || {prompt}", "'**Answer**'", "'> **Skipped.**'", "'**Citations**'", cites("f.evidence"))
    points = f"'## Review Talking Points' || {gap} || '- Explain the change: {purpose}' || coalesce({nl} || '- Prepare to discuss: ' || string_split(f.gaps, '|')[1], '') || coalesce({nl} || '- Evidence to cite: ' || e.c || '.', '')"
    best = "list_sort(list_transform(string_split(matched, '|'), lambda x, i: {'k': CASE WHEN x = 'tests/test_pay.py' THEN 0 WHEN x = 'src/pay.py' THEN 3 ELSE 1 END, 'i': i, 'x': x}))[1].x"
    return (
        _graded_sql().rstrip() + ", oa AS (SELECT *, CASE question_id WHEN 'behavior' THEN 1 WHEN 'failure' THEN 2 ELSE 3 END AS o FROM ga), "
        f"rounds AS (SELECT review_id, string_agg({one}, {gap} ORDER BY o) AS text FROM oa GROUP BY review_id), "
        f"f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY CASE label WHEN '{L.GAP}' THEN 0 ELSE 1 END, CASE question_id WHEN 'failure' THEN 0 ELSE 1 END, o) AS place FROM oa WHERE label IN ('{L.GAP}', '{L.PARTIAL}') AND gaps <> '') WHERE place = 1), "
        f"e AS (SELECT review_id, {case('x')} AS c FROM (SELECT review_id, {best} AS x, row_number() OVER (PARTITION BY review_id ORDER BY CASE label WHEN '{L.STRONG}' THEN 0 ELSE 2 END + CASE question_id WHEN 'evidence' THEN 0 ELSE 1 END, o) AS place FROM oa WHERE label IN ('{L.STRONG}', '{L.PARTIAL}') AND matched <> '') WHERE place = 1) "
        f"SELECT r.review_id, {para(head, repr('## Change Summary'), repr(purpose), repr('**Uncertainty**'), repr('- A note.'), repr('## Questions and Answers'), 'r.text')} || "
        f"CASE WHEN f.review_id IS NULL THEN '' ELSE {gap} || {follow} END || {gap} || {points} || {nl} AS markdown FROM rounds r LEFT JOIN f USING (review_id) LEFT JOIN e USING (review_id)"
    )


@query(_markdown_sql())
def markdown_report(spark, sf):
    """The Markdown of the graded stand-in reviews."""
    q, a, files = graded(spark, sf)
    q = q.withColumn("prompt", F.concat(F.lit("What about "), F.col("id"), F.lit("?")))
    ids = q.select("review_id").distinct()
    answers = a.select("review_id", "question_id", F.lit("an answer").alias("raw_text"), (F.col("label") == L.UNCERTAIN).alias("skipped"))
    reviews = ids.select("review_id", F.lit("feature").alias("current_branch"), F.lit("main").alias("base_branch"))
    purposes = ids.select("review_id", F.lit("Likely updates `handle3` across 2 meaningful files.").alias("purpose"))
    notes = ids.select("review_id", F.array(F.lit("A note.")).alias("notes"))
    f = cut(selection.follow_ups(q, a, files))
    points = selection.talking_points(purposes, q, a, spark.createDataFrame([], "review_id long, first_ord long, description string, evidence array<" + effects.CITATION + ">"))
    payload = report.payload(reviews, purposes, notes, q, answers, a, f, cut(points), F.lit("2026-07-18 12:30:45").cast("timestamp"))
    return report.markdown(payload)
