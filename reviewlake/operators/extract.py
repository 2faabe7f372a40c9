"""Symbols, imports and calls of changed files."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions.staging import cut

_group = lambda c, pattern, i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


def source_lines(sources: DataFrame) -> DataFrame:
    """review_id, path, line_no (from 1), line."""
    return sources.select("review_id", "path", F.posexplode(F.split("content", "\n")).alias("i", "line")).select(
        "review_id", "path", (F.col("i") + 1).alias("line_no"), "line"
    )


def js_declaration(line: Column) -> Column:
    """struct(name, kind) of the declaration a line begins, by the first form that fits; null if none does."""
    made = lambda name, kind: F.struct(name.alias("name"), kind.alias("kind"))
    sort = lambda pattern, i: F.when(_group(line, pattern, i).isNotNull(), "async function").otherwise("function")
    method = _group(line, L.JS_METHOD, 2)
    kind = F.when(F.rlike(F.regexp_extract(line, L.JS_METHOD, 1), F.lit(r"\basync\b")), "async method").otherwise("method")
    return (
        F.when(F.rlike(line, F.lit(L.JS_FUNCTION)), made(_group(line, L.JS_FUNCTION, 2), sort(L.JS_FUNCTION, 1)))
        .when(F.rlike(line, F.lit(L.JS_CLASS)), made(_group(line, L.JS_CLASS, 1), F.lit("class")))
        .when(F.rlike(line, F.lit(L.JS_ARROW)), made(_group(line, L.JS_ARROW, 1), sort(L.JS_ARROW, 2)))
        .when(F.rlike(line, F.lit(L.JS_EXPORT)), made(_group(line, L.JS_EXPORT, 1), F.lit("export")))
        .when(method.isNotNull() & ~method.isin(L.NOT_CALLS), made(method, kind))
    )


def js_declarations(lines: DataFrame) -> DataFrame:
    return lines.withColumn("d", js_declaration(F.col("line"))).filter("d is not null").select("review_id", "path", "line_no", "d.name", "d.kind")


def block_ends(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """starts (review_id, path, line_no, ...) with end_line: where the braces opened from that line on are closed.

    Counting begins at the first line with an opening brace, at or after the start; without a close, the start itself.
    A line that lowers the depth closes every level between; the next close of a block's level ends it, so each file is
    passed over in order, forwards for the depth and backwards for what comes next, and no line meets all others.
    """
    count = lambda ch: F.length("line") - F.length(F.replace(F.col("line"), F.lit(ch), F.lit("")))
    forwards = W.partitionBy("review_id", "path").orderBy("line_no")
    backwards = W.partitionBy("review_id", "path").orderBy(F.desc("line_no"))
    m = lines.withColumn("opens", count("{")).withColumn("net", count("{") - count("}"))
    m = m.withColumn("depth", F.sum("net").over(forwards))
    opening = F.when(F.col("opens") > 0, F.struct(F.col("line_no").alias("at"), (F.col("depth") - F.col("net")).alias("base"), "depth"))
    m = m.withColumn("open", F.last(opening, ignorenulls=True).over(backwards))
    keys = ["review_id", "path", "line_no"]
    s = starts.join(m.select(*keys, "open"), keys)
    closes = m.filter("net < 0").select("review_id", "path", F.explode(F.sequence("depth", F.col("depth") - F.col("net") - 1)).alias("level"), F.col("line_no").alias("at"), F.col("line_no").alias("close"))
    asked = s.filter("open.depth > open.base").select("review_id", "path", F.col("open.base").alias("level"), F.col("open.at").alias("at")).distinct()
    both = asked.withColumn("close", F.lit(None).cast(dict(closes.dtypes)["close"])).unionByName(closes)
    later = W.partitionBy("review_id", "path", "level").orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, -1)
    ends = both.withColumn("end", F.last("close", ignorenulls=True).over(later)).filter("close is null and end is not null")
    ends = ends.select("review_id", "path", F.col("at").alias("open_at"), "end")
    s = s.withColumn("open_at", F.col("open.at")).join(ends, ["review_id", "path", "open_at"], "left")
    at_once = F.when(F.col("open.depth") <= F.col("open.base"), F.col("open_at"))
    return s.withColumn("end_line", F.coalesce(at_once, "end", "line_no")).select(*starts.columns, "end_line")


def js_imports(lines: DataFrame) -> DataFrame:
    """review_id, path, line_no, k, name: the module of an import line, then those of its require calls."""
    first = F.coalesce(_group(F.col("line"), L.JS_IMPORT, 1), _group(F.col("line"), L.JS_IMPORT_ONLY, 1))
    found = F.concat(F.when(first.isNotNull(), F.array(first)).otherwise(F.array().cast("array<string>")), F.regexp_extract_all("line", F.lit(L.JS_REQUIRE), 1))
    return lines.select("review_id", "path", "line_no", F.posexplode(found).alias("k", "name"))


def js_calls(lines: DataFrame, affected: DataFrame) -> DataFrame:
    """review_id, path, line_no, k, name of calls on affected lines, less what the line itself declares."""
    words = "|".join(L.NOT_CALLS)
    pattern = rf"(?<!(?:^|\s)(?:{words})\s{{1,40}})(?<![\w$]\.)\b(?!(?:{words})\s*\()({L.NAME}(?:\.{L.NAME})*)\s*\("
    on = lines.join(affected.select("review_id", "path", F.col("line").alias("line_no")), ["review_id", "path", "line_no"], "left_semi")
    calls = on.select("review_id", "path", "line_no", js_declaration(F.col("line"))["name"].alias("own"), F.posexplode(F.regexp_extract_all("line", F.lit(pattern), 1)).alias("k", "name"))
    return calls.filter(F.col("own").isNull() | (F.col("name") != F.col("own"))).drop("own")


def hunk_declaration(header: Column) -> Column:
    """struct(name, kind) declared in the text after a hunk's second @@, by the first pattern that fits."""
    after = F.trim(F.regexp_extract(header, r"^[^@]*@@(?:(?!@@).)*@@(.*)$", 1))
    found = []
    for kind, pattern in L.HUNK_DECLARATIONS:
        one, two = _group(after, pattern, 1), _group(after, pattern, 2) if kind in (None, "go type") else None
        name, sort = (two, one) if kind is None else (one, two) if kind == "go type" else (one, F.lit(kind))
        found.append(F.struct(F.element_at(F.split(name, "::"), -1).alias("name"), sort.alias("kind")))
    return F.get(F.filter(F.array(*found), lambda d: d["name"].isNotNull()), F.lit(0))


def hunk_symbols(hunks: DataFrame) -> DataFrame:
    """review_id, path, hunk_ord, name, kind, line_start, origin; a (name, kind) counts once a file, at its first hunk."""
    found = hunks.withColumn("d", hunk_declaration(F.col("header"))).filter("d is not null")
    found = found.groupBy("review_id", "path", "d.name", "d.kind").agg(F.min(F.struct("hunk_ord", "new_start")).alias("f"))
    return found.select("review_id", "path", "f.hunk_ord", "name", "kind", F.col("f.new_start").alias("line_start"), F.lit(L.FALLBACK).alias("origin"))


def _python_nodes(source: str) -> list[tuple]:
    """(class, ord, name, kind, line, last line, local name) of all declarations, imports and calls in source order."""
    nodes = sorted(ast.walk(ast.parse(source)), key=lambda n: (getattr(n, "lineno", 0), getattr(n, "col_offset", 0)))
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "async function", ast.ClassDef: "class"}

    def dotted(n) -> str | None:
        if isinstance(n, ast.Name):
            return n.id
        if isinstance(n, ast.Attribute):
            owner = dotted(n.value)
            return f"{owner}.{n.attr}" if owner else n.attr
        return None

    rows: list[tuple] = []
    for n in nodes:
        if type(n) in kinds:
            rows.append(("symbol", n.name, kinds[type(n)], n.lineno, n.end_lineno or n.lineno, None))
        elif isinstance(n, ast.Import):
            rows += [("import", a.name, "import", n.lineno, n.lineno, a.asname or a.name.split(".")[0]) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            module = "." * n.level + (n.module or "")
            module += "." if module and not module.endswith(".") else ""
            rows += [("import", module + a.name, "import", n.lineno, n.lineno, a.asname or a.name) for a in n.names]
        elif isinstance(n, ast.Call) and (name := dotted(n.func)):
            rows.append(("call", name, "call", n.lineno, n.lineno, None))
    return [(c, i, *r) for i, (c, *r) in enumerate(rows)]


NODES = "digest string, class string, ord int, name string, kind string, line_start int, line_end int, local_name string"


def python_nodes(sources: DataFrame) -> DataFrame:
    """NODES of distinct sources (digest, content), one row each; a source that cannot be parsed has one of class "error".

    Syntax trees have no form in Spark's functions, so sources go through Python in Arrow batches, each by itself.
    """

    def read(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    got = _python_nodes(r.content or "")
                except (SyntaxError, ValueError, RecursionError):
                    got = [("error", 0, None, None, None, None, None)]
                out += [(r.digest, *g) for g in got]
            names = [c.split()[0] for c in NODES.split(", ")]
            yield pd.DataFrame(out, columns=names).astype({"line_start": "Int32", "line_end": "Int32"})

    return sources.select("digest", "content").mapInPandas(read, NODES)


def python_rows(sources: DataFrame, affected: DataFrame) -> DataFrame:
    """review_id, path, class, ord, name, kind, line_start, local_name of Python files; class "error" if unreadable.

    Each distinct source is parsed once, by its digest, into a table of nodes with their lines; which of them a change
    touches is found by joins: declarations that an affected line lies in, calls on affected lines, and all imports.
    """
    src = sources.select("review_id", "path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"))
    distinct = sources.select(F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"), F.coalesce("content", F.lit("")).alias("content")).dropDuplicates(["digest"])
    nodes = cut(python_nodes(distinct))
    rows = src.join(nodes, "digest").drop("digest")
    on = affected.select("review_id", "path", F.col("line").alias("line_start"))
    calls = rows.filter("class = 'call'").join(on, ["review_id", "path", "line_start"], "left_semi")
    out = touched(rows.filter("class = 'symbol'"), affected).unionByName(calls).unionByName(rows.filter("class in ('import', 'error')"))
    place = F.row_number().over(W.partitionBy("review_id", "path").orderBy("ord")) - 1
    return out.select("review_id", "path", "class", place.cast("int").alias("ord"), "name", "kind", "line_start", "local_name")


def touched(intervals: DataFrame, affected: DataFrame) -> DataFrame:
    """The rows of intervals (review_id, path, line_start, line_end, ...) in which an affected line lies.

    Starts and lines are put in order, and one pass from the last to the first tells each start the next line from it
    on: no interval meets all lines of its file.
    """
    columns = intervals.columns
    row = F.struct(*columns)
    starts = intervals.select("review_id", "path", F.col("line_start").alias("at"), F.lit(None).cast("int").alias("line"), row.alias("row"))
    lines = affected.select("review_id", "path", F.col("line").cast("int").alias("at"), F.col("line").cast("int").alias("line"))
    both = starts.unionByName(lines, allowMissingColumns=True)
    later = W.partitionBy("review_id", "path").orderBy(F.desc("at"), F.desc_nulls_last("line")).rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("next", F.last("line", ignorenulls=True).over(later))
    return both.filter("row is not null and next <= row.line_end").select("row.*").select(*columns)


def evidence_cap(items: DataFrame, most: int = L.EVIDENCE_PER_FILE) -> tuple[DataFrame, DataFrame]:
    """(kept, omitted per file). items: review_id, path, class, ord; symbols go before calls, calls before imports."""
    if most < 1:
        raise ValueError("the limit must be positive")
    rank = F.when(F.col("class") == "symbol", 0).when(F.col("class") == "call", 1).otherwise(2)
    order = W.partitionBy("review_id", "path").orderBy("_rank", "ord")
    ranked = items.withColumn("_rank", rank).withColumn("_place", F.row_number().over(order))
    omitted = items.groupBy("review_id", "path").agg((F.count("*") - most).alias("omitted")).filter("omitted > 0")
    return ranked.filter(F.col("_place") <= most).drop("_rank", "_place"), omitted


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distinct rows by ``keys`` with the least ``order`` of each."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def symbols_imports_calls(files: DataFrame, hunks: DataFrame, sources: DataFrame, most: int = L.EVIDENCE_PER_FILE) -> tuple[DataFrame, DataFrame]:
    """(rows, notes). rows: review_id, file_ord, path, class, ord, name, kind, line_start, local_name, origin of all
    changed files. notes: review_id, file_ord, step, note; what could not be read, parsed or kept.

    files: classified changed files. Python goes through syntax trees, JavaScript and TypeScript through line patterns,
    all else, and files that yield no symbol or cannot be read, through the text after hunk headers.
    """
    from . import patches

    live = files.filter("not is_binary").select("review_id", "path", "file_ord", "language")
    affected = cut(patches.affected_lines(hunks))
    src = sources.filter("content is not null").select("review_id", "path", "content").join(live, ["review_id", "path"])
    py = cut(python_rows(src.filter("language = 'python'").select("review_id", "path", "content"), affected))
    lines = source_lines(src.filter("language in ('javascript', 'typescript')"))
    decl = cut(js_declarations(lines))
    js_symbols = touched(block_ends(lines, decl).withColumnsRenamed({"line_no": "line_start", "end_line": "line_end"}), affected)
    js_symbols = cut(js_symbols.select("review_id", "path", F.lit("symbol").alias("class"), (F.col("line_start") * 1000).alias("ord"), "name", "kind", "line_start"))
    ref = lambda df, kind: df.select("review_id", "path", F.lit(kind).alias("class"), (F.col("line_no") * 1000 + F.col("k")).alias("ord"), "name", F.lit(kind).alias("kind"), F.col("line_no").alias("line_start"))
    js = js_symbols.unionByName(ref(js_imports(lines), "import")).unionByName(ref(js_calls(lines, affected), "call"))
    found = py.filter("class <> 'error'").unionByName(js.withColumn("local_name", F.lit(None).cast("string"))).withColumn("origin", F.lit(L.EXTRACTED))
    # fallback: other languages and unread or unreadable files, and scripts without a symbol
    broken = py.filter("class = 'error'").select("review_id", "path")
    done = src.filter("language = 'python'").select("review_id", "path").join(broken, ["review_id", "path"], "left_anti").unionByName(js_symbols.select("review_id", "path").distinct())
    fallback = hunk_symbols(hunks.join(done, ["review_id", "path"], "left_anti")).select(
        "review_id", "path", F.lit("symbol").alias("class"), F.col("hunk_ord").alias("ord"), "name", "kind", "line_start", F.lit(None).cast("string").alias("local_name"), "origin"
    )
    kept, omitted = evidence_cap(cut(found.unionByName(fallback)), most)
    quoted = T.json_quoted(F.col("path"))
    note = lambda df, step, text: df.join(live.select("review_id", "path", "file_ord"), ["review_id", "path"]).select("review_id", "file_ord", F.lit(step).alias("step"), text.alias("note"))
    notes = note(broken, 2, F.concat(F.lit("Could not parse "), quoted, F.lit(" as Python; symbol extraction may be incomplete.")))
    left_out = F.concat(F.lit("Omitted "), T.counted(F.col("omitted"), "evidence item", "evidence items"), F.lit(" for "), quoted, F.lit(f" because the per-file limit is {most:,}."))
    notes = notes.unionByName(note(omitted, 3, left_out))
    if "note" in sources.columns:
        unread = sources.filter("note is not null").join(live.filter(F.col("language").isin(L.EXTRACTOR_LANGUAGES)).select("review_id", "path"), ["review_id", "path"], "left_semi")
        notes = notes.unionByName(note(unread.select("review_id", "path", F.col("note").alias("_n")), 1, F.col("_n")))
    scripts = src.filter("language in ('javascript', 'typescript')").groupBy("review_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "path"))), lambda x: x["path"]).alias("p"))
    heuristic = F.concat(F.lit("JavaScript/TypeScript symbol extraction is heuristic for: "), T.path_summary(F.col("p")), F.lit("."))
    notes = notes.unionByName(scripts.select("review_id", F.lit(2_000_000_000).alias("file_ord"), F.lit(9).alias("step"), heuristic.alias("note")))
    return live.select("review_id", "path", "file_ord").join(kept, ["review_id", "path"]), notes
