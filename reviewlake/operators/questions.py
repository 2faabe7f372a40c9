"""The three questions of a review: behavior, failure, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions import wording as W
from .effects import citation


def review_status(files: DataFrame, usable: DataFrame) -> DataFrame:
    """review_id, status: ok, documentation_only or no_evidence. A review without files has no row."""
    f = files.groupBy("review_id").agg(F.bool_and("is_documentation").alias("docs"))
    u = usable.select("review_id").distinct().withColumn("_u", F.lit(True))
    status = F.when(F.col("docs"), "documentation_only").when(F.col("_u").isNull(), "no_evidence").otherwise("ok")
    return f.join(u, "review_id", "left").select("review_id", status.alias("status"))


def primary_symbols(symbols: DataFrame, usable: DataFrame) -> DataFrame:
    """review_id and the symbol (path, name, line_start) that a review is about: outside tests first, then extracted
    ones, then in order."""
    s = symbols.join(usable.select("review_id", "path", "is_test").distinct(), ["review_id", "path"])
    best = F.min(F.struct("is_test", (F.col("origin") == L.FALLBACK).alias("fallback"), "symbol_ord", "path", "name", "line_start"))
    return s.groupBy("review_id").agg(best.alias("b")).select("review_id", "b.path", "b.name", "b.line_start")


def primaries(usable: DataFrame, symbols: DataFrame) -> DataFrame:
    """review_id, path, status, area, ref: the primary place of each review that can be asked about."""
    sym = primary_symbols(symbols, usable).select("review_id", F.col("path").alias("s_path"), F.col("name").alias("s_name"), F.col("line_start").alias("s_line"))
    first = usable.groupBy("review_id").agg(F.min(F.struct("is_test", "file_ord", "path")).alias("f")).select("review_id", F.col("f.path").alias("f_path"))
    p = first.join(sym, "review_id", "left").withColumn("path", F.coalesce("s_path", "f_path"))
    status = usable.groupBy("review_id", "path").agg(F.min_by("status", "file_ord").alias("status"))
    p = p.join(status, ["review_id", "path"])
    area = F.concat(F.when(F.col("s_name").isNotNull(), F.concat(F.lit("`"), F.col("s_name"), F.lit("` in "))).otherwise(""), T.json_quoted(F.col("path")))
    ref = F.when(F.col("s_name").isNotNull(), citation("symbol", F.col("path"), F.col("s_name"), line=F.col("s_line"))).otherwise(citation("file", F.col("path")))
    return p.select("review_id", "path", "status", area.alias("area"), ref.alias("ref"))


def citation_area(c: Column) -> Column:
    return F.concat(F.when(c["symbol"].isNotNull(), F.concat(F.lit("`"), c["symbol"], F.lit("` in "))).otherwise(""), T.json_quoted(c["file_path"]))


def valid_effects(effects: DataFrame, usable: DataFrame) -> DataFrame:
    """review_id, effect_ord, kind, cite_ord, c: distinct citations of usable files, in order."""
    rows = effects.select("review_id", "effect_ord", "kind", F.posexplode(F.array_distinct("evidence")).alias("cite_ord", "c"))
    return rows.withColumn("path", F.col("c.file_path")).join(usable.select("review_id", "path").distinct(), ["review_id", "path"], "left_semi")


def partial_success(valid: DataFrame) -> DataFrame:
    """review_id, ext_kind, ext, txn: an external effect and a transaction in one hunk; the first by kind of effect,
    effect, transaction, and then citations."""
    v = valid.filter(F.col("c.hunk_header").isNotNull()).withColumn("hunk", F.col("c.hunk_header"))
    priority = F.when(F.col("kind") == L.NETWORK, 0).when(F.col("kind") == L.MESSAGE, 1).otherwise(2)
    e = v.filter(F.col("kind").isin(L.EXTERNAL)).select("review_id", "path", "hunk", priority.alias("p"), F.col("effect_ord").alias("eo"), F.col("cite_ord").alias("ec"), F.col("kind").alias("ext_kind"), F.col("c").alias("ext"))
    t = v.filter(F.col("kind") == L.TRANSACTION).select("review_id", "path", "hunk", F.col("effect_ord").alias("to"), F.col("cite_ord").alias("tc"), F.col("c").alias("txn"))
    # the least transaction of a hunk decides before the citations of the effect do, so one per hunk is enough
    t = t.groupBy("review_id", "path", "hunk").agg(F.min(F.struct("to", "tc", "txn")).alias("t"))
    pairs = e.join(t, ["review_id", "path", "hunk"]).select("review_id", "p", "eo", F.col("t.to").alias("to"), "ec", F.col("t.tc").alias("tc"), "ext_kind", "ext", F.col("t.txn").alias("txn"))
    first = pairs.groupBy("review_id").agg(F.min(F.struct("p", "eo", "to", "ec", "tc", "ext_kind", "ext", "txn")).alias("x"))
    return first.select("review_id", "x.ext_kind", "x.ext", "x.txn")


def behavior_prompt(status: Column, area: Column) -> tuple[Column, Column]:
    prompt = T.chosen(status, {k: T.filled(v, area=area) for k, v in W.BEHAVIOR.items()}, T.filled(W.BEHAVIOR_ELSE, area=area))
    verb = T.chosen(status, {k: F.lit(v) for k, v in W.VERBS.items()}, F.lit(W.VERB_ELSE))
    return prompt, T.filled(W.BEHAVIOR_WHY, verb=verb, area=area)


def _rows(df: DataFrame, i: int, name: str, prompt: Column, rationale: Column, refs: Column) -> DataFrame:
    return df.select("review_id", F.lit(i).alias("question_ord"), F.lit(name).alias("id"), F.lit(name).alias("category"), prompt.alias("prompt"), rationale.alias("rationale"), refs.alias("references"))


def generate(files: DataFrame, usable: DataFrame, symbols: DataFrame, effects: DataFrame) -> DataFrame:
    """Three questions for every review with status ok: review_id, question_ord, id, category, prompt, rationale,
    references."""
    ok = review_status(files, usable).filter("status = 'ok'")
    usable = usable.join(ok, "review_id", "left_semi")
    p = primaries(usable, symbols)
    valid = valid_effects(effects, usable)
    area = F.col("area")
    prompt, why = behavior_prompt(F.col("status"), area)
    behavior = _rows(p, 0, "behavior", prompt, why, F.array("ref"))
    first = valid.groupBy("review_id").agg(F.min(F.struct("effect_ord", "cite_ord", "kind", "c")).alias("f")).select("review_id", F.col("f.kind").alias("kind"), F.col("f.c").alias("c"))
    f = p.join(partial_success(valid), "review_id", "left").join(first, "review_id", "left")
    kind = {"kind": F.col("ext_kind"), "effect": citation_area(F.col("ext")), "transaction": citation_area(F.col("txn")), "area": area}
    pair, pair_why = T.filled(W.FAILURE_PAIR, **kind), T.filled(W.FAILURE_PAIR_WHY, **kind)
    one, one_why = T.filled(W.FAILURE_ONE, kind=F.col("kind"), effect=citation_area(F.col("c"))), T.filled(W.FAILURE_ONE_WHY, kind=F.col("kind"))
    none, none_why = T.filled(W.FAILURE_NONE, area=area), T.filled(W.FAILURE_NONE_WHY, area=area)
    refs = F.when(F.col("ext_kind").isNotNull(), F.array("ext", "txn")).when(F.col("kind").isNotNull(), F.array("c")).otherwise(F.array("ref"))
    failure = _rows(f, 1, "failure", F.coalesce(pair, one, none), F.coalesce(pair_why, one_why, none_why), refs)
    test = usable.filter("is_test").groupBy("review_id").agg(F.min_by("path", "file_ord").alias("test"))
    e = p.join(test, "review_id", "left")
    quoted = T.json_quoted(F.col("test"))
    with_test, with_why = (T.filled(t, test=quoted, area=area) for t in (W.EVIDENCE_TEST, W.EVIDENCE_TEST_WHY))
    without, without_why = (T.filled(t, area=area) for t in (W.EVIDENCE_NONE, W.EVIDENCE_NONE_WHY))
    refs = F.when(F.col("test").isNotNull(), F.array("ref", citation("test", F.col("test")))).otherwise(F.array("ref"))
    evidence = _rows(e, 2, "evidence", F.coalesce(with_test, without), F.when(F.col("test").isNotNull(), with_why).otherwise(without_why), refs)
    return behavior.unionByName(failure).unionByName(evidence)


def first_questions(questions: DataFrame, n: int = 3, settings: DataFrame | None = None) -> DataFrame:
    """The first n questions of every review; of those that settings (review_id, n_questions) name, so many."""
    if not 1 <= n <= 3:
        raise ValueError("one to three questions can be asked")
    order = Window.partitionBy("review_id").orderBy("question_ord")
    placed = questions.withColumn("_p", F.row_number().over(order))
    if settings is None:
        return placed.filter(F.col("_p") <= n).drop("_p")
    asked = placed.join(settings.select("review_id", "n_questions"), "review_id", "left").filter(F.col("_p") <= F.coalesce("n_questions", F.lit(n)))
    return asked.select(*questions.columns)
