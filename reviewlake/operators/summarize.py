"""The summary of a review: what it likely does, which files matter, which effects it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import paths as P
from ..functions import text as T


def status_action(statuses: Column) -> Column:
    """The verb for a set of statuses."""
    only = lambda s: (F.size(statuses) == 1) & F.array_contains(statuses, s)
    return F.when(only("added"), "adds").when(only("deleted"), "removes").when(only("renamed"), "reorganizes").otherwise("updates")


def effects_by_kind(effects: DataFrame, files: DataFrame) -> DataFrame:
    """review_id, kind, first_ord, description, evidence: one row per kind, citations of changed files only, first seen
    first. Kinds without such a citation are left out."""
    c = effects.select("review_id", "effect_ord", "kind", "description", F.posexplode("evidence").alias("i", "c"))
    changed = files.select("review_id", F.col("path").alias("_p")).distinct()
    c = c.withColumn("_p", F.col("c.file_path")).join(changed, ["review_id", "_p"], "left_semi")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("effect_ord", "i", "c"))), lambda x: x["c"])
    return c.groupBy("review_id", "kind").agg(
        F.min("effect_ord").alias("first_ord"), F.min_by("description", "effect_ord").alias("description"), F.array_distinct(ordered).alias("evidence")
    )


def unsupported_labels(files: DataFrame) -> DataFrame:
    """review_id, labels: the file types without symbol extraction, one label each, in order of their first file."""
    suffix, lang = F.lower(P.suffix(F.col("path"))), P.language(F.col("path"), F.col("language"))
    shown = F.try_element_at(F.create_map(*[F.lit(x) for kv in L.LANGUAGE_NAMES.items() for x in kv]), lang)
    inner = T.json_quoted(suffix)
    escaped = F.substring(inner, F.lit(2), F.length(inner) - 2)
    label = (
        F.when(shown.isNotNull() & (suffix != ""), F.concat(shown, F.lit(" ("), escaped, F.lit(")")))
        .when(shown.isNotNull(), shown).when(suffix != "", escaped).otherwise("unrecognized")
    )
    key = F.coalesce(lang, F.nullif(suffix, F.lit("")), F.lit("unrecognized"))
    rows = files.filter(~F.col("is_binary") & ~P.has_extractor(F.col("path"), F.col("language")))
    one = rows.select("review_id", "file_ord", key.alias("type_key"), label.alias("label")).groupBy("review_id", "type_key").agg(F.min(F.struct("file_ord", "label")).alias("f"))
    return one.groupBy("review_id").agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["label"]).alias("labels"))


def unsupported_note(labels: Column) -> Column:
    return F.concat(F.lit("Symbol-level analysis was unavailable for "), T.listed(labels), F.lit("; any symbols inferred from hunk context are heuristic."))


def effect_phrase(kinds: Column) -> Column:
    first = F.get(kinds, F.lit(0))
    two = F.concat(F.array_join(F.slice(kinds, 1, 2), " and "), F.when(F.size(kinds) > 2, " and other side-effect").otherwise(""), F.lit(" signals"))
    return F.when(F.size(kinds) == 1, F.concat(F.lit("a "), first, F.lit(" signal"))).otherwise(two)


def purposes(files: DataFrame, symbols: DataFrame, by_kind: DataFrame) -> DataFrame:
    """review_id, purpose. files may be all of a review's; symbols and by_kind may lack reviews."""
    code = ~F.col("is_binary")
    extractor = P.has_extractor(F.col("path"), F.col("language"))
    f = files.groupBy("review_id").agg(
        F.count("*").alias("n"), F.count_if(code).alias("n_code"), F.coalesce(F.bool_or(code & extractor), F.lit(False)).alias("any_extractor"),
        F.collect_set("status").alias("statuses"), F.collect_set(F.when(code, F.col("status"))).alias("code_statuses"),
    )
    s = symbols.filter(F.col("origin") == L.EXTRACTED).join(files.select("review_id", "path").distinct(), ["review_id", "path"], "left_semi")
    s = s.groupBy("review_id", "name").agg(F.min("symbol_ord").alias("o")).groupBy("review_id").agg(
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("o", "name"))), 1, 2), lambda x: F.concat(F.lit("`"), x["name"], F.lit("`"))).alias("names")
    )
    k = by_kind.groupBy("review_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first_ord", "kind"))), lambda x: x["kind"]).alias("kinds"))
    u = unsupported_labels(files)
    all_ = f.join(s, "review_id", "left").join(k, "review_id", "left").join(u, "review_id", "left")
    label = lambda n: F.when(n == 1, "meaningful file").otherwise("meaningful files")
    n, m = F.col("n").cast("string"), F.col("n_code").cast("string")
    bare = F.concat(
        F.lit("Likely "), status_action(F.col("code_statuses")), F.lit(" "), m, F.lit(" "), label(F.col("n_code")), F.lit(" across "), T.listed(F.col("labels")),
        F.lit("; a symbol-level purpose could not be inferred."),
    )
    named = F.concat(F.lit("Likely updates "), F.array_join("names", " and "), F.lit(" across "), n, F.lit(" "), label(F.col("n")))
    plain = F.concat(F.lit("Likely "), status_action(F.col("statuses")), F.lit(" code in "), n, F.lit(" "), label(F.col("n")))
    full = F.concat(F.when(F.col("names").isNotNull(), named).otherwise(plain), F.when(F.col("kinds").isNotNull(), F.concat(F.lit(", with "), effect_phrase(F.col("kinds")))).otherwise(""), F.lit("."))
    only_other = (F.col("n_code") > 0) & F.col("labels").isNotNull() & ~F.col("any_extractor")
    return all_.select("review_id", F.when(only_other, bare).otherwise(full).alias("purpose"))
