"""Project configuration: a small YAML file, and how it yields to the command and overrides defaults."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.paths import ignore_regex

KEYS = ("base", "report_path", "questions", "include_uncommitted", "exclude")


@dataclass(frozen=True)
class Config:
    base: str | None = None
    report_path: str | None = None
    questions: int | None = None
    include_uncommitted: bool | None = None
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Effective:
    base: str | None
    report_path: Path
    questions: int = 3
    include_uncommitted: bool = False
    exclude: tuple[str, ...] = field(default_factory=tuple)


def parse(text: str, directory: Path = Path(".")) -> Config:
    """Checks every key; an empty text is all defaults."""
    fail = lambda why: ConfigError(f"Invalid configuration: {why}", "Correct the file and try again.")
    try:
        doc = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError("The configuration is not valid YAML.", "Correct the file and try again.", str(e)) from e
    if doc is None:
        return Config()
    if not isinstance(doc, dict):
        raise fail("the document must be a mapping")
    unknown = sorted(str(k) for k in doc if k not in KEYS)
    if unknown:
        raise fail("unknown keys " + ", ".join(f"`{k}`" for k in unknown))
    for k in ("base", "report_path"):
        if k in doc and (not isinstance(doc[k], str) or not doc[k].strip()):
            raise fail(f"`{k}` must be a non-empty string")
    n = doc.get("questions")
    if "questions" in doc and (isinstance(n, bool) or not isinstance(n, int) or not 1 <= n <= 3):
        raise fail("`questions` must be an integer from 1 to 3")
    if "include_uncommitted" in doc and not isinstance(doc["include_uncommitted"], bool):
        raise fail("`include_uncommitted` must be true or false")
    patterns = doc.get("exclude", [])
    if not isinstance(patterns, list):
        raise fail("`exclude` must be a list of non-empty patterns")
    for i, p in enumerate(patterns):
        at = f"`exclude[{i}]`"
        if not isinstance(p, str) or not p.strip():
            raise fail(f"{at} must be a non-empty string")
        if p.startswith("!"):
            raise fail(f"{at} is negated; exclusions must be positive patterns")
        if ".." in p.split("/"):
            raise fail(f"{at} contains a traversal (`..`) path segment")
        try:
            if ignore_regex(p) is None:
                raise fail(f"{at} must be a positive pattern")
        except ValueError as e:
            raise fail(f"{at} is not a valid pattern: {e}") from e
    report = doc.get("report_path")
    return Config(doc.get("base"), None if report is None else str(anchored(Path(report), directory)), n, doc.get("include_uncommitted"), tuple(patterns))


def load(path: Path) -> Config:
    """The file's configuration; defaults where there is no file."""
    try:
        text = path.read_text(encoding="utf-8")
    except FileNotFoundError:
        return Config()
    except (OSError, UnicodeDecodeError) as e:
        raise ConfigError("The configuration could not be read.", "Check the file.", str(e)) from e
    return parse(text, path.parent)


def anchored(path: Path, directory: Path) -> Path:
    return path if path.is_absolute() else directory / path


def resolve(config: Config, *, base=None, report_path=None, questions=None, include_uncommitted=None, directory: Path = Path(".")) -> Effective:
    """What the command says, else the configuration, else the default."""
    first = lambda *values: next((v for v in values if v is not None), None)
    report = anchored(Path(report_path), directory) if report_path is not None else Path(config.report_path) if config.report_path else directory / "review-report.md"
    return Effective(first(base, config.base), report, first(questions, config.questions, 3), first(include_uncommitted, config.include_uncommitted, False), config.exclude)


SETTINGS = "base string, report_path string, n_questions int, include_uncommitted boolean, exclude array<string>, problem string"


def read_texts(texts: DataFrame) -> DataFrame:
    """review_id and SETTINGS of configuration texts (review_id, text); problem tells what is wrong, and all else is null
    then. Each distinct text is parsed once, however many reviews have it. A null text is no configuration."""

    def parsed(batches):
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                try:
                    c = parse(text)
                    rows.append((text, c.base, c.report_path, c.questions, c.include_uncommitted, list(c.exclude), None))
                except ConfigError as e:
                    rows.append((text, None, None, None, None, None, e.details or e.message))
            out = pd.DataFrame(rows, columns=["text", "base", "report_path", "n_questions", "include_uncommitted", "exclude", "problem"])
            yield out.astype({"n_questions": "Int32", "include_uncommitted": "boolean"})

    found = texts.filter("text is not null").select("text").distinct().mapInPandas(parsed, f"text string, {SETTINGS}")
    return texts.select("review_id", "text").join(found, "text", "left").drop("text")


def effective(said: DataFrame, written: DataFrame) -> DataFrame:
    """The options of each review: what the command says (review_id, base, report_path, n_questions, include_uncommitted,
    any of them null), else what is written (SETTINGS), else the default. Every review that either names has a row."""
    both = said.alias("s").join(written.alias("w"), "review_id", "full_outer")
    first = lambda c, default=None: F.coalesce(f"s.{c}", f"w.{c}", F.lit(default)).alias(c)
    return both.select(
        "review_id", first("base"), first("report_path", "review-report.md"), first("n_questions", 3).cast("int").alias("n_questions"), first("include_uncommitted", False),
        F.coalesce("w.exclude", F.array().cast("array<string>")).alias("exclude"), F.col("w.problem").alias("problem"),
    )
