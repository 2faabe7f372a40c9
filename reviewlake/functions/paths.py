"""Column functions on POSIX paths, and ignore patterns as regular expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parents(path: Column) -> Column:
    """The directories of a path, outermost first."""
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def suffix(path: Column) -> Column:
    """The last dot and what follows; empty for dot files and without a dot."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]+$", "")


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def language(path: Column, declared: Column) -> Column:
    """The declared language, or that of the suffix; null if neither tells."""
    return F.coalesce(F.nullif(declared, F.lit("")), _lookup(L.LANGUAGE_OF_SUFFIX, F.lower(suffix(path))))


def has_extractor(path: Column, declared: Column) -> Column:
    return F.coalesce(language(path, declared).isin(L.EXTRACTOR_LANGUAGES), F.lit(False))


def is_test(path: Column) -> Column:
    in_dir = F.exists(parents(path), lambda d: F.lower(d).isin(L.TEST_DIRS))
    n, s = F.lower(name(path)), F.lower(stem(path))
    python = s.startswith("test_") | s.endswith("_test")
    return in_dir | F.when(F.lower(suffix(path)) == ".py", python).otherwise(n.contains(".test.") | n.contains(".spec."))


def is_documentation(path: Column) -> Column:
    in_dir = F.exists(parents(path), lambda d: F.lower(d).isin(L.DOC_DIRS))
    return in_dir | F.lower(suffix(path)).isin(".md", ".markdown") | F.rlike(name(path), F.lit(r"(?i)(?:^|[^a-z0-9])plan(?:[^a-z0-9]|$)"))


def ignore_regex(pattern: str) -> str | None:
    """A positive ignore pattern as a regular expression over whole POSIX paths; None for blank lines and comments.

    A pattern with a slash before its end holds from the root, any other at every depth. It covers what it names and
    all below; with a slash at its end only directories, so only what is below.
    """
    p = re.sub(r"(?<!\\)[ \t]+$", "", pattern)
    if not p or p.startswith("#"):
        return None
    if p.startswith("!"):
        raise ValueError("only positive patterns are supported")
    if p[:2] in ("\\#", "\\!"):
        p = p[1:]
    only_dirs = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    parts = [x for x in p.split("/") if x]
    if not parts:
        return None
    out, open_end = "", False
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            if last:
                out, open_end = out + ".+", True
            else:
                out += "(?:[^/]+/)*"
            continue
        out += _segment(part) + ("" if last else "/")
    lead = "^" if anchored else "^(?:.*/)?"
    return lead + out + ("$" if open_end else "/.+$" if only_dirs else "(?:/.*)?$")


def _segment(part: str) -> str:
    out, i = "", 0
    while i < len(part):
        c = part[i]
        i += 1
        if c == "*":
            out += "" if out.endswith("[^/]*") else "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            j = part.find("]", i + 1 + (part[i : i + 1] in ("!", "^")))
            if j < 0:
                raise ValueError(f"unclosed class in {part!r}")
            body = part[i:j]
            negated = body[:1] in ("!", "^")
            body = (body[1:] if negated else body).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += ("[^/" if negated else "[") + body + "]"
            i = j + 1
        elif c == "\\" and i < len(part):
            out += re.escape(part[i])
            i += 1
        else:
            out += re.escape(c)
    return out


def ignore_set_regex(patterns) -> str | None:
    """One regular expression for a set of patterns; None if it covers nothing."""
    found = [r for p in patterns if (r := ignore_regex(p))]
    return "|".join(f"(?:{r})" for r in found) or None


def ignored(path: Column, patterns: list[str] | Column) -> Column:
    """Whether one of the patterns covers the path; or, given a column, whether its expression (of ``ignore_set_regex``) does."""
    if isinstance(patterns, Column):
        return F.coalesce(F.rlike(path, patterns), F.lit(False))
    found = ignore_set_regex(patterns)
    return F.rlike(path, F.lit(found)) if found else F.lit(False)


class Filter:
    """Why a file is of low value, for a reader that has to know it while it reads; ``filtering`` says the same of columns."""

    def __init__(self, exclude: Iterable[str] = ()):
        found = ignore_set_regex(exclude)
        self.excluded = re.compile(found).search if found else lambda path: None

    def path_reason(self, path: str) -> str | None:
        *dirs, last = path.split("/")
        if not set(L.GENERATED_DIRS).isdisjoint(dirs):
            return L.GENERATED
        if not set(L.VENDORED_DIRS).isdisjoint(dirs):
            return L.VENDORED
        if last in L.LOCKFILES:
            return L.LOCKFILE
        if last.lower().endswith(tuple(L.MINIFIED_SUFFIXES)):
            return L.MINIFIED
        return L.EXCLUDED if self.excluded(path) else None

    def reason(self, path: str, old_path: str | None) -> str | None:
        """A rename is filtered only if both its paths are."""
        return self.path_reason(path) if old_path is None or self.path_reason(old_path) else None
