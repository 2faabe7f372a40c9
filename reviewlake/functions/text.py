"""Column functions on text: normalisation, phrases, safe quoting, lists in words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


def words_in(values: list[str]) -> str:
    return "|".join(values)


def normalize(c: Column) -> Column:
    """Contractions written out, camel case split, lower case, runs of anything else as one space."""
    c = F.regexp_replace(c, L.CONTRACTION, "$1 not")
    c = F.lower(F.regexp_replace(c, "(?<=[a-z0-9])(?=[A-Z])", " "))
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def phrases(value: Column) -> Column:
    """The phrases by which an answer can name a symbol or path: one word of five letters that says something, or more
    words. Empty for null and empty values."""
    name = F.element_at(F.split(value, "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    last = normalize(F.element_at(F.split(value, r"\."), -1))

    def lead(words: Column) -> Column:
        """Without leading words; empty unless more than one word is left."""
        for start in (rf"(?:(?:{words_in(L.LEADING_WORDS)})(?: |$))+", "by(?: |$)", "[^ ]*$"):
            words = F.regexp_replace(words, "^" + start, "")
        return words

    # the one-element array binds the last part, so that it is normalised once
    parts = F.get(F.transform(F.array(last), lambda x: F.array(x, lead(x))), F.lit(0))
    found = F.when(value.contains("/"), F.array(normalize(value), normalize(name), normalize(stem))).otherwise(F.concat(F.array(normalize(value)), parts))
    says = lambda p: p.contains(" ") | ((F.length(p) >= 5) & ~p.isin(L.GENERIC_WORDS))
    return F.coalesce(F.array_distinct(F.filter(found, says)), F.array().cast("array<string>"))


def padded(c: Column) -> Column:
    """Normalised text or a phrase between blanks: one holds another as whole words if it contains it so."""
    return F.concat(F.lit(" "), c, F.lit(" "))


def mentions(spaced: Column, found: Column) -> Column:
    """Whether normalised text (``padded``, so that it is made once and not for each phrase) has one of the phrases."""
    return F.exists(found, lambda p: spaced.contains(padded(p)))


def filled(template: str, **values: Column) -> Column:
    """A sentence with columns in place of its {names}; null if one of them is."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if x])


def chosen(key: Column, texts: dict[str, Column], other: Column) -> Column:
    """The text of a key, or the other one."""
    out = None
    for k, v in texts.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(other)


def json_quoted(c: Column) -> Column:
    """A JSON string with everything but printable ASCII escaped."""
    plain = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    unit = lambda n: F.format_string("\\u%04x", n)

    def escaped(ch: Column) -> Column:
        n = F.ascii(ch)
        pair = F.concat(unit(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), unit(F.lit(0xDC00) + F.pmod(n - 0x10000, F.lit(0x400))))
        out = F.when(ch == '"', '\\"').when(ch == "\\", "\\\\")
        for c, e in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
            out = out.when(ch == c, e)
        return out.when(n.between(32, 126), ch).when(n > 0xFFFF, pair).otherwise(unit(n))

    odd = F.concat(F.lit('"'), F.array_join(F.transform(F.split(c, ""), escaped), ""), F.lit('"'))
    return F.when(F.rlike(c, F.lit(r"^[\x20-\x7e]*$")), plain).otherwise(odd)


def inline_code(c: Column) -> Column:
    """A Markdown code span, fenced by more back-ticks than the text has in a row."""
    runs = F.transform(F.regexp_extract_all(c, F.lit("(`+)"), 1), F.length)
    fence = F.call_function("repeat", F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    pad = F.when(c.startswith("`") | c.endswith("`"), " ").otherwise("")
    return F.when(c.contains("`"), F.concat(fence, pad, c, pad, fence)).otherwise(F.concat(F.lit("`"), c, F.lit("`")))


def squeezed(c: Column) -> Column:
    """One line: runs of white space as single spaces."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def lines_joined(c: Column) -> Column:
    """One line: line breaks as spaces, a last one dropped."""
    return F.regexp_replace(F.regexp_replace(c, r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ])\z", ""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", " ")


def listed(items: Column) -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(items)
    many = F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(items, -1))
    return F.when(n == 0, "").when(n <= 2, F.array_join(items, " and ")).otherwise(many)


def counted(n: Column, one: str, more: str) -> Column:
    """A number with thousands separators and its noun."""
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, one).otherwise(more))


def path_summary(paths: Column, shown: int = 5) -> Column:
    """The first quoted paths, and how many more there are."""
    rest = F.size(paths) - shown
    first = F.array_join(F.transform(F.slice(paths, 1, shown), json_quoted), ", ")
    return F.concat(first, F.when(rest > 0, F.concat(F.lit(", and "), F.format_number(rest, 0), F.lit(" more"))).otherwise(""))
