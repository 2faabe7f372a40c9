"""Likely side effects of calls: which hunk a call stands in, what it does, and which signals are kept."""

from __future__ import annotations

import ast
import io
import tokenize

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import paths as P


def parts_of(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), r"\."), lambda p: p != "")


def with_hunk(calls: DataFrame, hunks: DataFrame) -> DataFrame:
    """``calls`` with hunk_ord and hunk_header of the first hunk of the file whose new side holds the line, if any.

    An equi join on the file with the range as a residual test, then the least ordinal per call.
    """
    h = hunks.filter("new_lines > 0").select("review_id", "path", "hunk_ord", "header", "new_start", (F.col("new_start") + F.col("new_lines") - 1).alias("new_end"))
    hit = calls.select("review_id", "path", "call_ord", "line_start").join(h, ["review_id", "path"]).filter("line_start between new_start and new_end")
    first = hit.groupBy("review_id", "call_ord").agg(F.min(F.struct("hunk_ord", "header")).alias("h"))
    return calls.join(first, ["review_id", "call_ord"], "left").select(*calls.columns, F.col("h.hunk_ord").alias("hunk_ord"), F.col("h.header").alias("hunk_header"))


def network_aliases(imports: DataFrame) -> DataFrame:
    """review_id, path, alias, target: local names of network modules; the last import of a name counts."""
    found = imports.filter(F.col("local_name").isNotNull() & F.arrays_overlap(parts_of(F.col("name")), F.array(*map(F.lit, L.NETWORK_ROOTS))))
    return found.groupBy("review_id", "path", F.lower("local_name").alias("alias")).agg(F.max_by(F.lower("name"), "ref_ord").alias("target"))


def with_alias(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """``calls`` with target: what the first part of the name stands for, if that is a network module."""
    named = calls.withColumn("alias", F.get(parts_of(F.col("name")), F.lit(0)))
    return named.join(network_aliases(imports), ["review_id", "path", "alias"], "left").drop("alias")


def side_effect(name: Column, target: Column, opens_for_writing: Column) -> Column:
    """The kind of side effect that a call's name suggests; null if none."""
    parts = parts_of(name)
    terminal = F.get(parts, F.size(parts) - 1)
    owners = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    owned = lambda names: F.exists(owners, lambda o: o.isin(names))
    end = F.element_at(F.split(target, r"\."), -1)
    network = (
        terminal.isin(L.NETWORK_CALLS)
        | F.exists(parts, lambda p: p.isin(L.NETWORK_ROOTS))
        | ((F.size(parts) > 1) & F.get(parts, F.lit(0)).isin(L.NETWORK_OWNERS) & terminal.isin(L.NETWORK_METHODS))
        | (target.isNotNull() & F.when(F.size(parts) > 1, terminal.isin(L.NETWORK_METHODS)).otherwise(end.isin(L.NETWORK_METHODS)))
    )
    return (
        F.when(F.size(parts) == 0, None)
        .when(terminal.isin(L.TRANSACTION_CALLS) | (terminal.isin(L.OWNED_TRANSACTION_CALLS) & owned(L.TRANSACTION_OWNERS)), L.TRANSACTION)
        .when(network, L.NETWORK)
        .when(terminal.isin(L.MESSAGE_CALLS), L.MESSAGE)
        .when(terminal.isin(L.FILE_CALLS) | ((terminal == "write") & owned(L.FILE_OWNERS)), L.FILE_WRITE)
        .when((terminal == "open") & F.coalesce(opens_for_writing, F.lit(False)), L.FILE_WRITE)
        .when(terminal.isin(L.DATABASE_CALLS) | (terminal.isin(L.OWNED_DATABASE_CALLS) & owned(L.DATABASE_OWNERS)), L.DATABASE)
    )


def _open_call(source: str) -> str | None:
    """The text of the first balanced open(...) call, if it is complete."""
    start, depth = None, 0
    lines = source.split("\n")
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if start is None:
                start = t.start if t.type == tokenize.NAME and t.string == "open" else None
            elif t.type == tokenize.OP and t.string in "()":
                depth += 1 if t.string == "(" else -(depth > 0)
                if t.string == ")" and depth == 0:
                    (r0, c0), (r1, c1) = start, t.end
                    picked = lines[r0 - 1 : r1]
                    picked[-1] = picked[-1][:c1]
                    picked[0] = picked[0][c0:]
                    return "\n".join(picked)
    except (IndentationError, tokenize.TokenError):
        return None
    return None


def opens_to_write(lines: list[str]) -> bool:
    """Whether the open call that begins in these new-side lines has a mode that writes.

    At most OPEN_LINES lines and OPEN_CHARS characters are looked at.
    """
    held, size = [], 0
    for line in lines:
        more = len(line) + bool(held)
        if len(held) >= L.OPEN_LINES or size + more > L.OPEN_CHARS:
            return False
        held.append(line)
        size += more
        call = _open_call("\n".join(held))
        if call is not None:
            try:
                tree = ast.parse(call, mode="eval").body
            except (SyntaxError, ValueError):
                return False
            if not isinstance(tree, ast.Call):
                return False
            mode = next((k.value for k in tree.keywords if k.arg == "mode"), tree.args[1] if len(tree.args) > 1 else None)
            return isinstance(mode, ast.Constant) and isinstance(mode.value, str) and any(c in mode.value for c in "wax+")
    return False


def with_open_mode(calls: DataFrame, hunks: DataFrame, files: DataFrame) -> DataFrame:
    """``calls`` (with hunk_ord) with writes: true for Python open calls in a writing mode."""
    from . import patches

    python = files.filter(P.language(F.col("path"), F.col("language")) == "python").select("review_id", "path").distinct()
    opens = calls.filter((F.element_at(F.split(F.lower("name"), r"\."), -1) == "open") & F.col("hunk_ord").isNotNull()).join(python, ["review_id", "path"], "left_semi")
    rows = patches.new_side(hunks).filter("mark <> '-'").select("review_id", "path", "hunk_ord", "new_line", "line")
    near = opens.select("review_id", "path", "hunk_ord", "call_ord", "line_start").join(rows, ["review_id", "path", "hunk_ord"])
    near = near.filter(F.col("new_line").between(F.col("line_start"), F.col("line_start") + L.OPEN_LINES))
    text = near.groupBy("review_id", "call_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("new_line", "line"))), lambda x: x["line"]).alias("lines"))

    @F.pandas_udf("boolean")
    def writes(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: opens_to_write(list(x)))

    return calls.join(text.select("review_id", "call_ord", writes("lines").alias("writes")), ["review_id", "call_ord"], "left")


def deduped(effects: DataFrame, existing: DataFrame | None = None, most: int = L.EFFECTS) -> tuple[DataFrame, DataFrame]:
    """(kept, omitted per review): one signal per kind, path, name and hunk, the first ``most`` of each review.

    effects: review_id, call_ord, kind, path, name, hunk_header. Signals in ``existing`` (the same columns) are not
    repeated, and take from the limit.
    """
    if most < 1:
        raise ValueError("the limit must be positive")
    key = ["review_id", "kind", "path", "_name", "hunk_header"]
    one = W.partitionBy(*key).orderBy("call_ord")
    rows = effects.withColumn("_name", F.lower("name")).withColumn("_k", F.row_number().over(one)).filter("_k = 1").drop("_k")
    used = F.lit(0).cast("long")
    if existing is not None:
        old = existing.select("review_id", "kind", "path", F.lower(F.coalesce("name", F.lit(""))).alias("_name"), "hunk_header").distinct()
        o = old.select(*[F.col(c).alias(f"o_{c}") for c in key])
        same = (F.col("review_id") == F.col("o_review_id")) & (F.col("kind") == F.col("o_kind")) & (F.col("path") == F.col("o_path")) & (F.col("_name") == F.col("o__name")) & F.col("hunk_header").eqNullSafe(F.col("o_hunk_header"))
        rows = rows.join(o, same, "left_anti").join(existing.groupBy("review_id").agg(F.count("*").alias("_used")), "review_id", "left")
        used = F.coalesce("_used", F.lit(0).cast("long"))
    rows = rows.withColumn("_place", F.row_number().over(W.partitionBy("review_id").orderBy("call_ord")) + used)
    omitted = rows.groupBy("review_id").agg(F.sum((F.col("_place") > most).cast("long")).alias("omitted")).filter("omitted > 0")
    return rows.filter(F.col("_place") <= most).drop("_name", "_place", "_used"), omitted


def evidence_note(mark: Column, hunk_ord: Column) -> Column:
    return (
        F.when(hunk_ord.isNull(), "Call-shaped signal observed in bounded change evidence.")
        .when(mark == "+", "Call-shaped signal observed on an added line.")
        .otherwise("Call-shaped signal observed in nearby context; inference is lower confidence.")
    )


CITATION = "struct<kind: string, file_path: string, symbol: string, hunk_header: string, line_start: int, line_end: int, note: string>"


def citation(kind, path, symbol=None, header=None, line=None, end=None, note=None) -> Column:
    c = lambda x, t: (F.lit(None) if x is None else x).cast(t)
    return F.struct(
        c(kind if isinstance(kind, Column) else F.lit(kind), "string").alias("kind"), c(path, "string").alias("file_path"), c(symbol, "string").alias("symbol"),
        c(header, "string").alias("hunk_header"), c(line, "int").alias("line_start"), c(end, "int").alias("line_end"), c(note, "string").alias("note"),
    )


def detect(calls: DataFrame, imports: DataFrame, hunks: DataFrame, files: DataFrame, scan: int = L.CALLS_SCANNED, most: int = L.EFFECTS) -> tuple[DataFrame, DataFrame]:
    """(effects, notes). effects: review_id, effect_ord, kind, description, evidence. notes: review_id, note_ord, note.

    The first ``scan`` calls of a review are looked at, in order.
    """
    from . import patches

    if scan < 1:
        raise ValueError("the limit must be positive")
    ranked = calls.withColumn("_place", F.row_number().over(W.partitionBy("review_id").orderBy("call_ord")))
    unseen = ranked.filter(F.col("_place") > scan).groupBy("review_id").agg(F.count("*").alias("n"))
    found = with_alias(with_hunk(ranked.filter(F.col("_place") <= scan).drop("_place"), hunks), imports)
    found = with_open_mode(found, hunks, files)
    found = found.withColumn("kind", side_effect(F.col("name"), F.col("target"), F.col("writes"))).filter("kind is not null")
    kept, omitted = deduped(found, most=most)
    kept = patches.line_at(hunks, kept.withColumn("new_line", F.col("line_start")))
    note = evidence_note(F.col("mark"), F.col("hunk_ord"))
    evidence = F.array(citation("call", F.col("path"), F.col("name"), F.col("hunk_header"), F.col("line_start"), F.col("line_start"), note))
    described = F.element_at(F.create_map(*[F.lit(x) for kv in L.DESCRIPTIONS.items() for x in kv]), F.col("kind"))
    effects = kept.select("review_id", F.col("call_ord").alias("effect_ord"), "kind", described.alias("description"), evidence.alias("evidence"))
    return effects, unseen.select("review_id", F.lit(100).alias("note_ord"), scan_note(F.col("n"), scan).alias("note")).unionByName(
        omitted.select("review_id", F.lit(101).alias("note_ord"), cap_note(F.col("omitted"), most).alias("note"))
    )


def scan_note(n: Column, scan: int) -> Column:
    noun = F.when(n == 1, "reference").otherwise("references")
    return F.concat(F.lit("Omitted "), F.format_number(n, 0), F.lit(" call "), noun, F.lit(f" from side-effect detection because the scan limit is {scan:,}."))


def cap_note(n: Column, most: int) -> Column:
    noun = F.when(n == 1, "signal").otherwise("signals")
    return F.concat(F.lit("Omitted "), F.format_number(n, 0), F.lit(" likely side-effect "), noun, F.lit(f" because the output limit is {most:,}."))
