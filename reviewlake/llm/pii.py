"""Personal data: fixed patterns, and spans that a linear-chain conditional random field adds.

The field is trained on the driver from the few dozen rows of ``pii_examples``: the score of a tag is a sum of
weights for the word shapes of the token and of two tokens on either side, plus one for the step from the tag before.
It runs over every line of every text, from end to end, but for lines without a digit or an @ sign: no span of any
kind is without one, so nothing could come of them. Lines of a batch are decoded together: Viterbi's steps are numpy
operations over all of them.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, pii_examples

KINDS = ("email", "ip", "card", "phone")
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
REACH = 2

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIALLED = re.compile(r"\+?\(?[0-9][\x20().0-9-]*[0-9]")
DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
#: Words whose presence nearby says something; every other word is only a shape.
CUES = frozenset(
    "call phone tel fax mobile cell ring number reach contact mail email write card visa credit ip host server login "
    "version page pages order invoice no isbn id section chapter room license copyright ext dollars euros".split()
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def valid(kind: str, s: str) -> bool:
    """What a match of a kind must also meet."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(d := digits_of(s)) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(digits_of(s)) <= 15
    return True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of the four patterns that do not overlap within a kind, less those that are not valid.

    The patterns are walked so that time is linear in the text: an address is sought from its @ backwards, and a
    number never from within its own digits.
    """
    out = []
    at, p = 0, text.find("@")
    while p >= 0:
        start = p
        while start > at and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, p + 1) if start < p else None
        if m:
            out.append(("email", start, m.end()))
            at = m.end()
            p = text.find("@", at)
        else:
            p = text.find("@", p + 1)
    if DIGIT.search(text):
        for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
            if kind == "phone" and "+" not in text:
                continue
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return out


@functools.lru_cache(maxsize=1 << 16)
def _common_shape(token: str, spaced: bool) -> str:
    return shape(token, spaced)


def shape(token: str, spaced: bool) -> str:
    """The class of a token: cue word, letters by case and length, digits by number and range, or the sign itself."""
    c = token[0]
    if "0" <= c <= "9":
        s = f"d{min(len(token), 20)}" + ("s" if len(token) <= 3 and int(token) <= 255 else "")
    elif c.isalpha():
        low = token.lower()
        if low in CUES:
            s = "=" + low
        else:
            n = len(token)
            s = ("U" if token.isupper() else "C" if c.isupper() else "w") + str(n if n <= 3 else 4 if n <= 6 else 7)
    else:
        s = token if c.isascii() else "other"
    return s + ("_" if spaced else "")


def tokens(text: str, lo: int = 0, hi: int | None = None) -> tuple[list[str], list[tuple[int, int]]]:
    found = [m.span() for m in TOKEN.finditer(text, lo, len(text) if hi is None else hi)]
    shapes, last = [], lo
    for a, b in found:
        shapes.append((_common_shape if b - a <= 24 else shape)(text[a:b], a > last))
        last = b
    return shapes, found


def _padded(rows: list[list[int]], pad: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in rows])
    x = np.full((len(rows), n.max() + 2 * REACH), pad, dtype=np.int32)
    for i, r in enumerate(rows):
        x[i, REACH : REACH + len(r)] = r
    return x, n


class Field:
    """A linear-chain conditional random field over token shapes."""

    def __init__(self, rounds: int = 250, l2: float = 0.02, rate: float = 0.15):
        rows, tags = [], []
        for text, spans in pii_examples.parse():
            shapes, at = tokens(text)
            y = []
            for a, b in at:
                k = next((s for s in spans if s[1] <= a and b <= s[2]), None)
                y.append(0 if k is None else TAGS.index(("B-" if a == k[1] else "I-") + k[0]))
            rows.append(shapes)
            tags.append(y)
        self.ids = {s: i for i, s in enumerate(sorted({s for r in rows for s in r}))}
        self.unknown, self.pad = len(self.ids), len(self.ids) + 1
        n_tags = len(TAGS)
        self.w = np.zeros((2 * REACH + 1, len(self.ids) + 2, n_tags))
        self.step = np.zeros((n_tags + 1, n_tags))  # the last row: from the start
        self.allowed = np.zeros((n_tags + 1, n_tags))
        for j, t in enumerate(TAGS):
            if t[0] == "I":
                for i in range(n_tags + 1):
                    if i == n_tags or TAGS[i][2:] != t[2:]:
                        self.allowed[i, j] = -1e9
        self._fit(*_padded([[self.ids[s] for s in r] for r in rows], self.pad), tags, rounds, l2, rate)

    def _emit(self, x: np.ndarray) -> np.ndarray:
        t = x.shape[1] - 2 * REACH
        return sum(self.w[o][x[:, o : o + t]] for o in range(2 * REACH + 1))

    def _fit(self, x, n, tags, rounds, l2, rate) -> None:
        b, t = x.shape[0], x.shape[1] - 2 * REACH
        n_tags, mask = len(TAGS), np.arange(t)[None] < n[:, None]
        y = np.zeros((b, t), dtype=int)
        for i, r in enumerate(tags):
            y[i, : len(r)] = r
        logsum = lambda a, axis: (m := a.max(axis=axis)) + np.log(np.exp(a - np.expand_dims(m, axis)).sum(axis=axis))
        moment = [np.zeros_like(self.w), np.zeros_like(self.step)]
        square = [np.zeros_like(self.w), np.zeros_like(self.step)]
        for r in range(1, rounds + 1):
            e, step = self._emit(x), self.step + self.allowed
            alpha, beta = np.zeros((b, t, n_tags)), np.zeros((b, t, n_tags))
            alpha[:, 0] = e[:, 0] + step[n_tags]
            for k in range(1, t):
                new = logsum(alpha[:, k - 1, :, None] + step[None, :n_tags], 1) + e[:, k]
                alpha[:, k] = np.where(mask[:, k, None], new, alpha[:, k - 1])
            for k in range(t - 2, -1, -1):
                new = logsum(step[None, :n_tags] + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
                beta[:, k] = np.where(mask[:, k + 1, None], new, 0)
            z = logsum(alpha[:, -1], 1)
            p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
            g_emit = -p
            np.add.at(g_emit, (np.arange(b)[:, None], np.arange(t)[None], y), mask.astype(float))
            g_w, g_step = np.zeros_like(self.w), np.zeros_like(self.step)
            for o in range(2 * REACH + 1):
                np.add.at(g_w[o], x[:, o : o + t], g_emit)
            g_step[n_tags] = g_emit[:, 0].sum(0)
            for k in range(1, t):
                pair = np.exp(alpha[:, k - 1, :, None] + step[None, :n_tags] + (e[:, k] + beta[:, k])[:, None, :] - z[:, None, None])
                g_step[:n_tags] -= (pair * mask[:, k, None, None]).sum(0)
                np.add.at(g_step, (y[:, k - 1], y[:, k]), mask[:, k].astype(float))
            for i, (v, g) in enumerate(((self.w, g_w), (self.step, g_step))):
                g -= l2 * v
                moment[i] = 0.9 * moment[i] + 0.1 * g
                square[i] = 0.99 * square[i] + 0.01 * g * g
                v += rate * (moment[i] / (1 - 0.9**r)) / (np.sqrt(square[i] / (1 - 0.99**r)) + 1e-8)
        self.w[:, self.unknown] = 0

    def viterbi(self, rows: list[list[str]]) -> list[np.ndarray]:
        """The best tags of every row; rows go through together by similar length."""
        out: list = [None] * len(rows)
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        ids = [[self.ids.get(s, self.unknown) for s in r] for r in rows]
        step, n_tags = self.step + self.allowed, len(TAGS)
        while order:
            # longest last: as many rows as keep the padded batch below 100,000 tokens
            longest = max(1, len(rows[order[-1]]))
            order, now = order[: -max(1, 100_000 // longest)], order[-max(1, 100_000 // longest) :]
            x, n = _padded([ids[i] for i in now], self.pad)
            e = self._emit(x)
            t = e.shape[1]
            back = np.zeros((len(now), t, n_tags), dtype=np.int8)
            best = e[:, 0] + step[n_tags] if t else np.zeros((len(now), n_tags))
            for k in range(1, t):
                s = best[:, :, None] + step[None, :n_tags]
                back[:, k] = s.argmax(1)
                live = (k < n)[:, None]
                best = np.where(live, s.max(1) + e[:, k], best)
                back[:, k] = np.where(live, back[:, k], np.arange(n_tags))
            tag = best.argmax(1)
            path = np.zeros((len(now), t), dtype=np.int8)
            for k in range(t - 1, -1, -1):
                path[:, k] = tag
                tag = back[np.arange(len(now)), k, tag]
            for i, row in enumerate(now):
                out[row] = path[i, : n[i]]
        return out


def lines(text: str) -> list[tuple[int, int]]:
    """Where the field is run: the lines with a digit or an @ sign."""
    out, at = [], 0
    while m := TRIGGER.search(text, at):
        lo, hi = text.rfind("\n", at, m.start()) + 1, text.find("\n", m.end())
        at = len(text) if hi < 0 else hi
        out.append((lo, at))
    return out


def added(kind: str, s: str) -> bool:
    """Whether a span from the field can be of its kind at all."""
    if kind == "phone":
        return bool(DIALLED.fullmatch(s)) and 7 <= len(digits_of(s)) <= 15
    if kind == "ip":
        return bool(IP.fullmatch(s)) and valid("ip", s)
    if kind == "email":
        return "@" in s and bool(re.search(r"\w@\w", s))
    return valid(kind, s)


def tag(field: Field, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, added spans) of every text. An added span overlaps no base span."""
    base = [base_spans(t) for t in texts]
    rows, owner = [], []
    for i, t in enumerate(texts):
        for lo, hi in lines(t):
            shapes, at = tokens(t, lo, hi)
            rows.append(shapes)
            owner.append((i, at))
    more: list[list] = [[] for _ in texts]
    for (i, at), path in zip(owner, field.viterbi(rows), strict=True):
        k = 0
        while k < len(path):
            name, j = TAGS[path[k]], k + 1
            while name != "O" and j < len(path) and TAGS[path[j]] == "I-" + name[2:]:
                j += 1
            if name != "O":
                a, b = at[k][0], at[j - 1][1]
                if added(name[2:], texts[i][a:b]) and all(b <= s or e <= a for _, s, e in base[i]):
                    more[i].append((name[2:], a, b))
            k = j
    return list(zip(base, more, strict=True))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and all spans, for every row. No shuffle.

    Null or empty text: no spans. Repeated rows come back repeated; a null doc_id stays null. Very long texts are read
    whole. Further columns are not looked at. Of equally good tag sequences the one of lower tags counts.
    """
    field = field or Field()

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    def spans(text: pd.Series) -> pd.DataFrame:
        rows = []
        for base, more in tag(field, text.tolist()):
            n = [sum(s[0] == k for s in base) for k in KINDS]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return common.documents(docs).select("doc_id", spans(F.coalesce("text", F.lit(""))).alias("x")).select("doc_id", "x.*")


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id and text with every span replaced by its kind in angle brackets; overlapping spans count as one."""
    field = field or Field()

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        out = []
        for t, (base, more) in zip(text, tag(field, text.tolist()), strict=True):
            parts, at = [], 0
            for k, a, b in sorted(base + more, key=lambda s: (s[1], s[2])):
                if a >= at:
                    parts += [t[at:a], f"<{k}>"]
                at = max(at, b)
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    return common.documents(docs).select("doc_id", clean(F.coalesce("text", F.lit(""))).alias("text"))


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in the whole text of all documents."""
    return find(common.table(spark, sf_dir, "documents"))
