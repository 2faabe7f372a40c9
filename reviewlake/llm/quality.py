"""Quality rules: statistics of every text, two hard rules, and an isolation forest for the rest.

The statistics of all documents are computed once and staged. The forest grows on the driver from the good rows of a
bounded sample of labelled rows (``most_fit``, ``tree_rows`` and ``n_trees`` are its bounds): each tree splits a random
feature at a random place until rows stand alone, and a row that few splits isolate is anomalous. The threshold is
calibrated on all labelled rows but those that may have grown the forest: it is the score with the largest share of bad
rows rejected, less ``penalty`` times the share of good rows rejected, which stays sound when some labels are wrong.
What the driver sees of these rows is how many of each label have a score, in ``BINS`` steps. All documents are held to
the threshold.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = re.compile(common.WORD).findall
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
FEATURES = ("word_len", "symbols", "symbol_words", "dup_lines", "repeats", "upper", "bangs", "pipes", "sameness", "run")
BINS = 10_000
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(ids: np.ndarray, n_distinct: int, window: int = 8) -> int:
    """Words that lie in a window of ``window`` words found at two or more places of the text.

    Windows of 2, 4 and 8 words get numbers from the pairs of their halves' numbers, so equality is exact.
    """
    n = len(ids)
    if n <= window or n_distinct == n:
        return 0
    size, now, k = 1, ids, n_distinct
    while size < window:
        pair = now[: len(now) - size] * k + now[size:]
        _, now = np.unique(pair, return_inverse=True)
        k = int(now.max()) + 1
        if k == len(now):
            return 0
        size *= 2
    twice = np.bincount(now)[now] > 1
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str) -> tuple:
    """The five counts and the features of one text."""
    words = WORDS(text)
    n = len(words)
    seen: dict[str, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines, dup, full = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(BLANK):
            full += 1
            dup += line in lines
            lines.add(line)
    repeats = repeated_words(ids, len(seen))
    if not n:
        return (0, 0, symbols, dup, 0, *([0.0] * len(FEATURES)))
    change = np.flatnonzero(np.diff(ids)) if n > 1 else np.array([], dtype=np.int64)
    run = int(np.diff(np.concatenate([[-1], change, [n - 1]])).max())
    return (
        n, chars, symbols, dup, repeats,
        abs(np.log(chars / n / 5)), symbols / n, sum(w[-1] in SYMBOLS for w in words) / n if symbols else 0.0, dup / full,
        repeats / n, sum(map(str.isupper, words)) / n, text.count("!") / n, text.count("|") / n,
        1 - np.log1p(len(seen)) / np.log1p(n), np.log(run),
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and the features (array x) of every row; null text counts as empty."""

    @F.pandas_udf(COUNTS + ", x array<double>")
    def measured(text: pd.Series) -> pd.DataFrame:
        rows = [statistics(t) for t in text]
        return pd.DataFrame([(*r[:5], list(map(float, r[5:]))) for r in rows], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "x"])

    out = common.documents(docs).select("doc_id", measured(F.coalesce("text", F.lit(""))).alias("m")).select("doc_id", "m.*")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


class Forest:
    """An isolation forest; each tree is arrays of feature, place, left child and, at leaves, path length."""

    def __init__(self, x: np.ndarray, n_trees: int = 100, tree_rows: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees = []
        size = min(tree_rows, len(x))
        self.unit = max(self.expected(size), 1e-9)
        deepest = int(np.ceil(np.log2(max(size, 2)))) + 2
        for _ in range(n_trees if size else 0):
            self.trees.append(self._tree(x[rng.choice(len(x), size, replace=False)], deepest, rng))

    @staticmethod
    def expected(n: int) -> float:
        """Mean path length of a search among n rows."""
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def _tree(self, x: np.ndarray, deepest: int, rng) -> tuple[np.ndarray, ...]:
        feature, place, left, length = [], [], [], []
        todo = [(x, 0)]
        while len(feature) < len(todo):
            rows, depth = todo[len(feature)]
            lo, hi = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
            can = np.flatnonzero(hi > lo)
            if depth >= deepest or len(rows) < 2 or not len(can):
                # rows all alike are as isolated as one: a value outside them is caught by the range test above it
                feature.append(-1), place.append(0.0), left.append(0), length.append(depth + self.expected(len(rows)))
                continue
            f = int(rng.choice(can))
            at = rng.uniform(lo[f], hi[f])
            # a row beyond the range seen here is one step from being alone
            feature.append(f), place.append(at), left.append(len(todo)), length.append(0.0)
            todo += [(rows[rows[:, f] < at], depth + 1), (rows[rows[:, f] >= at], depth + 1)]
        return np.array(feature), np.array(place), np.array(left), np.array(length)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher for rows that few splits isolate."""
        total = np.zeros(len(x))
        for feature, place, left, length in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while len(live := np.flatnonzero(feature[at] >= 0)):
                i = at[live]
                at[live] = left[i] + (x[live, feature[i]] >= place[i])
            total += length[at]
        return 2.0 ** -(total / max(1, len(self.trees)) / self.unit)


class Judge:
    """The forest with the scaling of its features; its threshold is set by ``calibrate``."""

    def __init__(self, good: np.ndarray):
        # features are ratios that pile up at one value; a jitter as wide as their usual spread lets splits fall
        # outside the pile, so that rows far from it are isolated early
        self.mid = np.median(good, axis=0) if len(good) else np.zeros(len(FEATURES))
        spread = (np.percentile(good, 99, axis=0) - np.percentile(good, 1, axis=0)) if len(good) else np.ones(len(FEATURES))
        self.scale = np.maximum(spread, [0.2, 0.02, 0.02, 0.05, 0.02, 0.02, 0.02, 0.02, 0.1, 0.7])
        wide = np.random.default_rng(11).uniform(-1, 1, good.shape) if len(good) else good
        self.forest = Forest(self._scaled(good) + wide)
        self.threshold = 1.0

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        """Spreads above the median of good rows; what lies below it is as good as the median."""
        return np.clip((x - self.mid) / self.scale, 0, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.forest.score(self._scaled(x)) if len(x) else np.zeros(0)

    def calibrate(self, bins: np.ndarray, bad: np.ndarray, fine: np.ndarray, penalty: float) -> None:
        """Sets the threshold from the rows of either label in each bin of scores; a bin stands for its upper end."""
        if not bad.sum() or not fine.sum():
            return
        order = np.argsort(bins)
        caught, wrong = 1 - np.cumsum(bad[order]) / bad.sum(), 1 - np.cumsum(fine[order]) / fine.sum()
        self.threshold = float((bins[order][np.argmax(caught - penalty * wrong)] + 1) / BINS)


def known(labels: DataFrame) -> DataFrame:
    """doc_id and quality of every label, once: bad if any row says so."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    return rows.groupBy("doc_id").agg(F.min("quality").alias("quality"))


def anomaly_of(model: Judge):
    """Scores of an array of features."""

    @F.pandas_udf("double")
    def anomaly(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(x.tolist(), dtype=float).reshape(-1, len(FEATURES))))

    return anomaly


def fit(measured: DataFrame, labels: DataFrame, most_fit: int = 10_000, penalty: float = 12.0) -> Judge:
    """Grows on some ``most_fit`` good rows, those below a cut of a hash of doc_id, half of the good rows at most; all
    other labelled rows calibrate. Rows with one doc_id grow as one, and twice ``most_fit`` reach the driver at most."""
    rows = measured.filter("not base_failed").join(known(labels), "doc_id").withColumn("_h", F.xxhash64("doc_id"))
    may_grow = (F.col("quality") == 1) & (F.pmod("_h", F.lit(2)) == 0)
    rows = common.staged(rows.select("doc_id", "x", "quality", "_h", may_grow.alias("may_grow")), "labelled")
    n = rows.filter("may_grow").select("doc_id").distinct().count()
    chosen = F.col("may_grow") if n <= most_fit else F.col("may_grow") & (F.col("_h") < -(2**63) + 2**64 * most_fit // n)
    grow = rows.filter(chosen).groupBy("doc_id").agg(F.min("x").alias("x")).limit(2 * most_fit).toPandas().sort_values("doc_id")
    model = Judge(np.array(grow["x"].tolist(), dtype=float).reshape(-1, len(FEATURES)))
    rest = rows.filter(~chosen)
    at = F.least(F.floor(anomaly_of(model)("x") * BINS), F.lit(BINS - 1)).alias("bin")
    counts = rest.select(at, "quality").groupBy("bin").agg(F.sum((F.col("quality") == 0).cast("long")).alias("bad"), F.sum((F.col("quality") == 1).cast("long")).alias("fine")).toPandas()
    common.drop(rows)
    model.calibrate(*(counts[c].to_numpy(dtype=float) for c in ("bin", "bad", "fine")), penalty)
    return model


def judge(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """doc_id, the counts, base_failed, anomaly and kept of every row.

    Null or empty text: no words, so base_failed. Repeated rows come back repeated. Without usable labels the
    threshold is 1 and only the hard rules reject. The statistics are staged, so texts are read once, and whole.
    Scores equal to the threshold are kept. Further columns are not looked at.
    """
    measured = common.staged(measure(docs), "quality")
    model = fit(measured, labels, **bounds)
    return (
        measured.withColumn("anomaly", anomaly_of(model)("x"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(model.threshold)))
        .drop("x")
    )


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Quality statistics and verdicts of all documents."""
    out = judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
