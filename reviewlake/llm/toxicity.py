"""Toxicity by weak supervision: many noisy voters, a generative label model, a linear classifier.

Voters say toxic (1), clean (-1) or nothing (0) of a text: short seed lexicons, ``N_DRAWN`` random parts of a lexicon
drawn from the labelled training rows, and patterns. The label model explains the votes by a hidden class:
expectation-maximisation finds how often each voter is right; voters whose votes go together within a class
(correlation above ``tie``) are joined into one voter over their joint votes, up to ``largest`` of them, so that the
same evidence counts less often than it is voted for, and the model is fitted again. Its posteriors are the labels on
which a logistic regression over lexicon and pattern features is trained; its scale is set on the labelled rows. Scores
come from that classifier alone.

Clusters of any size, or drawn words parted by how telling they are, gave worse results on training rows held back from
training (the README has the figures), so neither is done.

Bounds: everything is learned from at most ``most_fit`` labelled training rows (the first by a hash of doc_id), and at
most ``most_words`` words are drawn. Every document is scored on its whole text. Rows with crc32(doc_id as text) mod
3 = 1 are never learned from.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOKENS = re.compile(r"[^\W\d_]+").findall
BANGS = re.compile(r"!{2,}")

#: Seed lexicons: each is one voter.
SEEDS = {
    "insult": "idiot idiots moron morons stupid fool fools dumb imbecile cretin loser losers jerk dimwit",
    "contempt": "pathetic worthless disgusting useless vile repulsive revolting despicable contemptible",
    "dehumanise": "scum trash vermin filth garbage clown clowns parasite parasites rat pig pigs",
    "hostile": "hate shut kill despise destroy smash beat choke drown hang",
    "de": "dumm blöd trottel versager abschaum arschloch dreck schwachkopf ekelhaft",
    "fr": "débile imbécile crétin connard ordure minable dégoûtant salaud abruti",
    "es": "idiota estúpido imbécil basura asqueroso inútil payaso patético escoria",
}
N_DRAWN = 4
STEM, STEM_LETTERS = "^", 4


def terms(words: list[str]) -> set[str]:
    """The distinct words in lower case, and the stems (first letters) of those that are longer."""
    low = {w.lower() for w in set(words)}
    return low | {STEM + w[:STEM_LETTERS] for w in low if len(w) > STEM_LETTERS}


class Voters:
    """The lexicons, and what they and the patterns make of a text."""

    def __init__(self, drawn: list[str]):
        self.groups = [*SEEDS, *(f"drawn{i}" for i in range(N_DRAWN))]
        seeds = {w: i for i, k in enumerate(SEEDS) for w in SEEDS[k].split()}
        self.of = {w: (i,) for w, i in seeds.items()}
        for w in drawn:
            self.of[w] = (*self.of.get(w, ()), len(SEEDS) + zlib.crc32(w.encode()) % N_DRAWN)
        self.n_groups = len(self.groups)

    def features(self, text: str) -> list[float]:
        words = TOKENS(text)
        of = self.of
        kinds = [k for k in terms(words) if k in of]
        hits = [0] * self.n_groups
        for k in kinds:
            for g in of[k]:
                hits[g] += 1
        n = max(1, len(words))
        n_hit = sum(1 for w in words if (v := w.lower()) in of or STEM + v[:STEM_LETTERS] in of) if kinds else 0
        upper = sum(map(str.isupper, words)) / n
        return [*(min(h, 3) for h in hits), min(n_hit, 5), 1.0 * (not kinds), np.log1p(100 * n_hit / n), upper, min(3, len(BANGS.findall(text)))]

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Votes of all voters on rows of features."""
        g = self.n_groups
        out = [np.where(x[:, i] > 0, 1, 0) for i in range(g)]
        out.append(np.where(x[:, g] >= 2, 1, 0))  # said more than once
        out.append(np.where(x[:, g + 1] > 0, -1, 0))  # no word of any lexicon
        out.append(np.where(x[:, g + 2] > np.log1p(0.2), 1, np.where(x[:, g + 2] == 0, -1, 0)))  # density
        out.append(np.where((x[:, g + 3] > 0.5) & (x[:, g + 4] >= 3), 1, 0))  # shouting
        return np.stack(out, axis=1).astype(int) if len(x) else np.zeros((0, g + 4), dtype=int)


class LabelModel:
    """A hidden class that explains the votes; voters tied within a class count as one."""

    def __init__(self, votes: np.ndarray, tie: float = 0.35, largest: int = 3, rounds: int = 40):
        n, m = votes.shape
        self.clusters = [(i,) for i in range(m)]
        start = np.clip(0.5 + 0.25 * votes.sum(1), 0.02, 0.98)
        self._fit(votes, start, rounds)
        post = self.posterior(votes)
        self.correlation = np.zeros((m, m))
        for cls in (post, 1 - post):
            if cls.sum() > 1:
                d = votes - (cls[:, None] * votes).sum(0) / cls.sum()
                cov = (cls[:, None] * d).T @ d / cls.sum()
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                self.correlation = np.maximum(self.correlation, np.where(np.minimum.outer(sd, sd) > 0.05, np.abs(cov / np.outer(sd, sd)), 0))
        pairs = sorted(combinations(range(m), 2), key=lambda p: -self.correlation[p])
        of = {i: (i,) for i in range(m)}
        for a, b in pairs:
            if self.correlation[a, b] > tie and of[a] != of[b] and len(of[a]) + len(of[b]) <= largest:
                both = tuple(sorted(of[a] + of[b]))
                of |= dict.fromkeys(both, both)
        self.clusters = sorted(set(of.values()))
        self._fit(votes, post, rounds)
        post = self.posterior(votes)
        right = lambda i: (post * (votes[:, i] == 1) + (1 - post) * (votes[:, i] == -1)).sum() / max(1, (votes[:, i] != 0).sum())
        self.accuracy = np.array([right(i) for i in range(m)])

    def _codes(self, votes: np.ndarray) -> list[np.ndarray]:
        return [sum((votes[:, i] + 1) * 3**k for k, i in enumerate(c)) for c in self.clusters]

    def _fit(self, votes: np.ndarray, post: np.ndarray, rounds: int) -> None:
        codes = self._codes(votes)
        for _ in range(rounds):
            self.prior = float(np.clip(post.mean() if len(post) else 0.1, 0.001, 0.999))
            self.tables = []
            for c, k in zip(self.clusters, codes, strict=True):
                size = 3 ** len(c)
                t = np.stack([np.bincount(k, 1 - post, size), np.bincount(k, post, size)]) + 0.5
                self.tables.append(np.log(t / t.sum(1, keepdims=True)))
            post = self.posterior(votes)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = np.full(len(votes), np.log(self.prior) - np.log(1 - self.prior))
        for t, k in zip(self.tables, self._codes(votes), strict=True):
            z += t[1, k] - t[0, k]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the intercept) for soft labels, by Newton's steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], l2)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        w = w + np.linalg.solve(h, x.T @ (y - p) - keep * w)
    return w


class Classifier:
    """Voters, label model, and the linear classifier trained on its posteriors."""

    def __init__(self, voters: Voters, x: np.ndarray, y: np.ndarray):
        self.voters = voters
        if not len(x):
            self.w, self.scale = np.zeros(voters.n_groups + 6), (1.0, -3.0)
            return
        votes = voters.votes(x)
        self.labels = LabelModel(votes)
        post = self.labels.posterior(votes)
        self.w = logistic(x, post)
        z = np.clip(self._margin(x), -12, 12)
        # the class that the label model calls 1 must be the toxic one; rows labelled so tell which it is
        a, b = logistic(z[:, None], y.astype(float), l2=0.1) if 0 < y.sum() < len(y) else (1.0, 0.0)
        self.scale = (float(a), float(b))

    def _margin(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.ones((len(x), 1))]) @ self.w

    def score(self, texts) -> np.ndarray:
        x = np.array([self.voters.features(t) for t in texts], dtype=float).reshape(len(texts), -1)
        if not len(x):
            return np.zeros(0)
        z = self.scale[0] * np.clip(self._margin(x), -12, 12) + self.scale[1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, most_fit: int) -> DataFrame:
    """doc_id, text, toxic of at most ``most_fit`` labelled rows that may be learned from."""
    first = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .dropna()
        .filter(~common.held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_fit)
    )
    return common.documents(docs).filter("text is not null").join(F.broadcast(first), "doc_id")


def drawn_words(rows: DataFrame, most_words: int = 200) -> list[str]:
    """Words and stems that mark toxic training rows: in 1 % of them at least, and 20 times as often as in clean ones.

    At most ``most_words``, the most frequent ones. Near copies share their smallest word hash; one row of each such
    family and label counts. Unlike rows that share it are passed over with them, so the lexicon may miss words of few
    rows; grouping by shingles instead found more such words and no better results (see the README).
    """

    @F.pandas_udf("long")
    def family(text: pd.Series) -> pd.Series:
        return text.map(lambda t: min(map(zlib.crc32, (w.encode() for w in set(TOKENS(t.lower())))), default=-1)).astype("int64")

    one = rows.withColumn("family", family("text")).groupBy("family", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id")

    def counted(batches):
        for pdf in batches:
            n: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for t, y in zip(pdf["text"], pdf["toxic"], strict=True):
                n[y].update(w for w in terms(TOKENS(t)) if len(w) <= 40)
                n[y][""] += 1
            words = list(n[0].keys() | n[1].keys())
            yield pd.DataFrame({"word": words, "clean": [n[0][w] for w in words], "toxic": [n[1][w] for w in words]})

    counts = (
        rows.join(one, "doc_id", "left_semi").select("text", "toxic").filter("toxic in (0, 1)")
        .mapInPandas(counted, "word string, clean long, toxic long")
        .groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    total = counts.filter("word = ''").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    n_clean, n_toxic = (total["clean"] or 0), (total["toxic"] or 0)
    if not n_clean or not n_toxic:
        return []
    lift = (F.col("toxic") / n_toxic) / ((F.col("clean") + 0.5) / n_clean)
    best = (
        counts.filter((F.col("word") != "") & (F.col("toxic") >= max(3, 0.01 * n_toxic)) & (lift >= 20))
        .orderBy(F.desc("toxic"), "word")
        .limit(most_words)
    )
    return sorted(r["word"] for r in best.collect())


def train(docs: DataFrame, labels: DataFrame, most_fit: int = 20_000) -> Classifier:
    rows = common.staged(training_rows(docs, labels, most_fit), "toxic-rows")
    voters = Voters(drawn_words(rows))

    def measured(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "x": [[float(v) for v in voters.features(t)] for t in pdf["text"]]})

    got = rows.select("doc_id", "text", "toxic").mapInPandas(measured, "doc_id long, toxic int, x array<double>").toPandas()
    common.drop(rows)
    got = got.drop_duplicates("doc_id").sort_values("doc_id")
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), voters.n_groups + 5)
    return Classifier(voters, x, got["toxic"].to_numpy(dtype=int))


def score(docs: DataFrame, labels: DataFrame, most_fit: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. No shuffle beyond the bounded training rows.

    Null or empty text: the score of a text in which no voter finds anything. Null doc_id: held_out is null.
    Repeated rows come back repeated. Without labelled rows every score is the same, below the threshold. Very long texts
    are scored whole; further columns are not looked at. Scores equal to the threshold are predicted toxic.
    """
    model = train(docs, labels, most_fit)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(text.tolist()))

    return (
        common.documents(docs)
        .select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), scored(F.coalesce("text", F.lit(""))).alias("score"))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )


def stage(spark, docs: DataFrame, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """Documents that are not predicted toxic, with all their columns. A null text is scored as an empty one; repeated rows
    stay or go together. Scores equal to the threshold are toxic."""
    model = train(docs, common.table(spark, sf_dir, "labels"))

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(text.tolist()))

    return docs.filter(scored(F.coalesce("text", F.lit(""))) < threshold)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
