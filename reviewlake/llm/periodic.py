"""Periodic runs of words: Lyndon roots by nearest smaller suffixes, whose common extensions are reused.

A run is a maximal stretch of words with a smallest period q. Over any total order of words and over its reverse, the
Lyndon words that begin at each place (they end before the next smaller suffix) hold the root of every run: for the
right one of both orders, the first root of a run begins in its first q words (the runs theorem). So it is enough to
look at each place l, its next smaller suffix r, and how far the texts at l and r agree to the right and to the left.

The nearest smaller suffixes come from one pass from left to right with a stack of the places whose next smaller suffix
is not known yet. A new place r is compared with the top of the stack, and then with the one below it. How far two
suffixes agree is mostly known already:

* for one r, what agreed with the top of the stack tells how far r agrees with the next below, or at least a
  beginning of it; comparing goes on from there and never begins anew;
* while r lies in a stretch that was found equal to an earlier one, what holds between the two earlier places holds
  here, and only what lies beyond the stretch is compared.

So words are compared by equality and order alone, mostly once: there is no suffix array or tree, and no hash of a
stretch of words. Comparing goes in steps that double, by slices of lists.

Only repetitive places are looked at. In a run of q and at least four periods, every word after the first period stood
at most q words before. ``places`` finds, for each power of two, the stretches of words of which that is true, for all
texts of a batch at once; a run lies in such a stretch with one period before it. Runs that a stretch's ends cut are
told by the words next to them, and are whole in another stretch.

How it scales: every text is worked on in its own task, nothing is shuffled, and words and runs leave no task but as
results. Batches are bounded by rows and bytes; a text is held whole by one task, as it is by a row.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _agree(a: list, i: int, j: int, known: int, n: int) -> int:
    """How many words from i on equal those from j > i on; ``known`` of them are known to."""
    k, step = known, 4
    while j + k < n and a[i + k] == a[j + k]:
        k += 1
        while j + k + step <= n and a[i + k : i + k + step] == a[j + k : j + k + step]:
            k += step
            step *= 2
        if step > 4:
            step //= 2
            while step > 4 and (j + k + step > n or a[i + k : i + k + step] != a[j + k : j + k + step]):
                step //= 2
    return k


def _agree_before(a: list, i: int, j: int, most: int) -> int:
    """How many words before i equal those before j, up to ``most``."""
    most = min(most, i)
    k, step = 0, 1
    while k < most:
        step = min(step, most - k)
        if a[i - k - step : i - k] == a[j - k - step : j - k]:
            k += step
            step *= 2
        elif step == 1:
            break
        else:
            step = max(1, step // 4)
    return k


def next_smaller(a: list) -> tuple[list[int], list[int]]:
    """For each place its next smaller suffix (len(a) if there is none; an end is smaller than any word), and how many
    words the two agree in."""
    n = len(a)
    nss, agree = [n] * n, [0] * n
    before = [-1] * n  # the place below on the stack: the nearest smaller suffix before
    shared = [0] * n  # words that a place and the one below it agree in
    left = right = reach = 0  # a[left:...] equals a[right:reach]; reach is the farthest so far
    for r in range(1, n):
        x, top = r - 1, -1
        while x >= 0:
            z = 0 if top < 0 else shared[top]  # r - 1 is always on top
            if top >= 0 and k != z:
                k = min(k, z)  # one of the two leaves the other earlier, and so the third
            else:
                k = z
                if right <= x and r < reach:
                    # the same two places of the earlier stretch have been compared: one ended at the other, or stands below it
                    s = r - (right - left)
                    y = s - r + x
                    k = max(k, min(agree[y] if nss[y] == s else shared[s] if before[s] == y else 0, reach - r))
                if r + k < n and a[x + k] == a[r + k]:
                    k = _agree(a, x, r, k, n)
            if r + k > reach:
                left, right, reach = x, r, r + k
            if r + k < n and a[x + k] < a[r + k]:
                break
            nss[x], agree[x] = r, k
            top, x = x, before[x]
        before[r] = x
        if x >= 0:
            shared[r] = k
    return nss, agree


def runs(words: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs with at least ``least`` words and ``times`` (2 or more) periods, in order.

    Words are anything with an order. Linear but for comparing words.
    """
    rank = {w: i for i, w in enumerate(sorted(set(words)))}
    up = [rank[w] for w in words]
    n, found = len(up), set()
    for a in (up, [-x for x in up]):
        for i, (j, k) in enumerate(zip(*next_smaller(a), strict=True)):
            p = j - i
            if k + 2 * p > times * p - 1 and k + 2 * p > least - 1:  # less than a period stands before the first root
                h = _agree_before(a, i, j, p)
                if h < p and h + p + k >= max(least, times * p):
                    found.add((i - h, h + p + k, p))
    return sorted(found)


def places(texts: list[list], least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(text, from, to) of the stretches that hold all runs, with the words next to them."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    n, longest = int(sizes.sum()), int(sizes.max(initial=0))
    if longest < least:
        return []
    gaps = array("q")  # how many words before each it stood last
    for t in texts:
        last: dict = {}
        seen = last.get
        for i, w in enumerate(t):
            gaps.append(i - seen(w, -n))
            last[w] = i
    gap = np.frombuffer(gaps, dtype=np.int64)
    ends = np.cumsum(sizes)
    found, q = [], 1
    while times * (q // 2 + 1) <= longest:
        low = q // 2 + 1  # periods from low to q
        edge = np.diff(np.concatenate(([0], (gap <= q).view(np.int8), [0])))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # none goes on into the next text: a text's first word stood nowhere before
        wide = hi - lo >= max((times - 1) * low, least - q)
        lo, hi = lo[wide], hi[wide]
        t = np.searchsorted(ends, lo, side="right")
        found += zip(t.tolist(), np.maximum(lo - q - 1, ends[t] - sizes[t]).tolist(), np.minimum(hi + 1, ends[t]).tolist(), strict=True)
        q *= 2
    out: list[tuple[int, int, int]] = []
    for t, x, y in sorted(found):
        x, y = x - int(ends[t] - sizes[t]), y - int(ends[t] - sizes[t])
        if out and out[-1][0] == t and x < out[-1][2]:
            out[-1] = (t, out[-1][1], max(y, out[-1][2]))
        else:
            out.append((t, x, y))
    return out


def runs_of_texts(texts: list[list], least: int = 6, times: int = 4) -> list[list[tuple[int, int, int]]]:
    """The runs of each of some texts, given as words."""
    out: list[set[tuple[int, int, int]]] = [set() for _ in texts]
    for t, x, y in places(texts, least, times):
        w = texts[t]
        for s, length, p in runs(w[x:y], least, times):
            s += x
            if (s == 0 or w[s - 1] != w[s - 1 + p]) and (s + length == len(w) or w[s + length] != w[s + length - p]):
                out[t].add((s, length, p))
    return [sorted(r) for r in out]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: a run's first period stays, unless another run takes it."""
    if not found:
        return words
    gone = np.zeros(len(words), dtype=bool)
    for s, length, p in found:
        gone[s + p : s + length] = True
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def periodic_runs(docs: DataFrame, repeated=None, least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, n_runs, runs (start, length, period by start, then period) and collapsed (the words left, joined by one
    space) of every row, in its own task.

    Null, empty or blank texts have no words, no runs, and an empty collapsed text. Texts of any length are taken
    whole. Repeated rows come back repeated; a null doc_id stays null; columns besides doc_id and text are not looked
    at. A run of exactly ``least`` words and ``times`` periods counts. ``repeated(doc_id, words)`` may change the words
    first; a null doc_id is given as None.
    """

    def found(batches):
        for pdf in batches:
            ids = [None if pd.isna(i) else int(i) for i in pdf["doc_id"]]
            texts = [(t or "").encode().split() for t in pdf["text"]]
            if repeated:
                texts = [repeated(i, w) for i, w in zip(ids, texts, strict=True)]
            got = runs_of_texts(texts, least, times)
            left = [b" ".join(collapsed(w, r)).decode() for w, r in zip(texts, got, strict=True)]
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in got]
            yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "n_runs": [len(r) for r in got], "runs": rows, "collapsed": left})

    schema = "doc_id long, n_runs long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return common.documents(docs).mapInPandas(found, schema)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """In a tenth of the documents the words from some place on repeat with some period; a null doc_id is none of them."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[: n - a]


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The runs of words of all documents, a tenth of which are made to repeat; the longest run, and digests of all."""
    found = periodic_runs(common.table(spark, sf_dir, "documents"), planted)
    # greatest length, then smallest start, then smallest period
    best = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    lines = F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n")))
    return found.withColumn("b", best).select(
        "doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"),
        F.expr("1000 * b.length div -b.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
