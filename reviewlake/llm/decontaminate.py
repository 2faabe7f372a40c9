"""Benchmark decontamination with SimHash over item-sized windows (DataFrame functions only).

Texts are lower-cased and parted by ASCII white space; features are shingles of five words (all words of an item that
has fewer), weighted by how often they occur. For an item of n words the windows are runs of n words of a document.
Every such window counts, wherever the item's shingles stand in it: the similarity is one of multisets, without order.

Fingerprints of every window for every item size would cost more than all else together (see the README), so windows
that cannot reach the threshold are told by counting first, without loss: a window alike to 0.8 shows item shingles at
eight of nine places. Only every ``step``-th place of a text is hashed at first. The documents in which enough of these
lie within a window's length are then hashed at every place, and the windows with as many places of item shingles as
the threshold takes are formed. Then:

1. equal windows are one; each has a SimHash of 128 bits over its weighted shingles;
2. the fingerprint is cut into ``N_BLOCKS`` blocks: fingerprints within ``radius`` bits of each other differ in
   radius // N_BLOCKS bits at most in one of them, so a join of the windows' blocks with the items' blocks, in which
   as many bits are flipped in every way, on (length, block, value) finds all of them; the whole distance then decides;
3. the weighted Jaccard similarity of the full shingle multisets, sum of minima over sum of maxima, verifies.

Windows alike to 0.8 differ in 19 of 128 bits on average, and in more than 38 about once in 100,000 times.

How it scales: documents are scanned three times, but only those that may hold an item are hashed and cut whole. What
is shuffled is one row per shared shingle and item size; no text moves while the documents found, and the windows, are
a million or fewer, for their rows, of fixed width, are then broadcast. Beyond that, and for items beyond
``most_broadcast`` shingles or index rows, joins are by hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BLANK = " \t\n\x0b\x0c\r"
BITS, N_BLOCKS = 64, 13  # bits of each of a fingerprint's two halves, blocks of the whole


def words(text: Column) -> Column:
    """The lower-cased words; an empty array without any, null for null."""
    t = F.btrim(F.lower(text), F.lit(BLANK))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, r"[ \t\n\x0B\f\r]+"))


def shingle_hashes(w: Column, k: int, step: int = 1) -> Column:
    """64-bit hashes of the runs of k words, in their order; empty with fewer words. Those at multiples of ``step``."""
    n = F.size(w)
    each = F.transform(F.sequence(F.lit(1), n - (k - 1), F.lit(step)), lambda i: F.xxhash64(F.slice(w, i, k)))
    return F.when(n >= k, each).otherwise(F.array().cast("array<bigint>"))


def _majority(features: Column) -> Column:
    """64 bits: bit b is set if more features (with repeats) have it than not. Bits b and b + 32 are counted at once,
    in the halves of a long."""
    long = lambda x: F.lit(x).cast("long")
    shift = lambda name, x, by: F.call_function(name, x, by)
    both = lambda b: F.aggregate(features, long(0), lambda acc, x: acc + shift("shiftrightunsigned", x, b).bitwiseAND(long(0x1_0000_0001)))
    bit = lambda ones, b: F.when(2 * ones > F.size(features), shift("shiftleft", long(1), b)).otherwise(long(0))
    two = lambda c, b: bit(c.bitwiseAND(long(0xFFFF_FFFF)), b).bitwiseOR(bit(F.shiftrightunsigned(c, 32), b + 32))
    counts = F.transform(F.sequence(F.lit(0), F.lit(BITS // 2 - 1)), both)
    return F.aggregate(F.transform(counts, two), long(0), lambda acc, x: acc.bitwiseOR(x))


def simhash(features: Column) -> Column:
    """struct(a, b) of 64 bits each: the majority of the features' bits, and of those of their hashes."""
    return F.struct(_majority(features).alias("a"), _majority(F.transform(features, lambda x: F.xxhash64(x))).alias("b"))


def blocks(n: int = N_BLOCKS) -> list[tuple[int, int]]:
    """(first bit, bits) of n blocks that share the bits of both halves out."""
    at = [2 * BITS * i // n for i in range(n + 1)]
    return [(x, y - x) for x, y in zip(at, at[1:])]


def block_values(fp: Column, n: int = N_BLOCKS) -> list[Column]:
    def value(first: int, width: int) -> Column:
        if first >= BITS:
            bits = F.shiftrightunsigned(fp["b"], first - BITS)
        elif first + width <= BITS:
            bits = F.shiftrightunsigned(fp["a"], first)
        else:
            bits = F.shiftrightunsigned(fp["a"], first).bitwiseOR(F.shiftleft(fp["b"], BITS - first))
        return bits.bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    return [value(*x) for x in blocks(n)]


def flips(width: int, most: int) -> Column:
    """All values of ``width`` bits of which ``most`` or fewer are set."""
    single = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    out = F.array(F.lit(0).cast("long"))
    for _ in range(most):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, lambda x: F.transform(single, lambda y: x.bitwiseOR(y))))))
    return out


def in_blocks(prints: DataFrame, fp: str, flipped: int = 0, n: int = N_BLOCKS) -> DataFrame:
    """``prints`` with a row for each block and each value within ``flipped`` bits of the block's own."""
    out = prints.select("*", F.posexplode(F.array(*block_values(F.col(fp), n))).alias("block", "value"))
    if not flipped:
        return out
    widths = F.array(*[F.lit(w) for _, w in blocks(n)])
    masks = F.array().cast("array<bigint>")
    for w in {w for _, w in blocks(n)}:
        masks = F.when(F.get(widths, F.col("block")) == w, flips(w, flipped)).otherwise(masks)
    return out.withColumn("mask", F.explode(masks)).withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")


def near_prints(left: DataFrame, right: DataFrame, radius: int, broadcast=lambda df: df, n: int = N_BLOCKS) -> DataFrame:
    """Each pair of a row of left (n, fp, ...) and one of right (n, item_fp, ...) of one n whose fingerprints are
    ``radius`` bits apart or fewer, once."""
    flipped = radius // n
    near = in_blocks(left, "fp", 0, n).join(broadcast(in_blocks(right, "item_fp", flipped, n)), ["n", "block", "value"])
    apart = F.struct(*[F.col(f"fp.{h}").bitwiseXOR(F.col(f"item_fp.{h}")).alias(h) for h in "ab"])
    close = F.array(*[F.bit_count(v) <= flipped for v in block_values(apart, n)])
    near = near.filter((F.bit_count(apart["a"]) + F.bit_count(apart["b"]) <= radius) & (F.array_position(close, True) - 1 == F.col("block")))
    return near.drop("block", "value", "fp", "item_fp")


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two multisets: sum of minima over sum of maxima."""
    count = lambda xs, v: F.size(F.filter(xs, lambda y: y == v))
    each = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, v: acc + F.least(count(a, v), count(b, v)))
    single = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    both = F.when(single, F.size(F.array_intersect(a, b))).otherwise(each)
    return both / (F.size(a) + F.size(b) - both)


def _least(t, u, threshold: float):
    """Shared shingles that a window of t and an item of u need: m / (t + u - m) reaches the threshold."""
    return F.ceil(F.lit(threshold) * (t + u) / F.lit(1 + threshold) - F.lit(1e-9)).cast("int")


def step_of(sizes: list[tuple[int, int]], threshold: float, most: int = 8) -> int:
    """The largest step at which every window that reaches the threshold, for items of (n words, shingles of k), still
    shows one item shingle at a multiple of the step, as it misses so few places."""

    def holds(step: int, u: int) -> bool:
        for t in range(1, u + 1):
            least = math.ceil(threshold * (t + u) / (1 + threshold) - 1e-9)
            if least <= t and t // step <= t - least:
                return False
        return True

    return max(s for s in range(1, most + 1) if s == 1 or all(holds(s, n - k + 1) for n, k in sizes))


def window_starts(places: Column, length: Column, n: Column, k: Column, threshold: float, step: int = 1) -> Column:
    """The starts of all windows of n words with enough of the places (sorted, distinct) for the threshold.

    m shared shingles out of t in the window and u in the item are similar to m / (t + u - m), and m is at most the
    number of places. Each run of as many places as are needed gives the starts of the windows that hold it, without
    those of the run before, which hold it too. Where only multiples of ``step`` were looked at, as many of them as
    are in any window, less the places that it may miss, are needed.
    """
    t = F.least(length, n) - k + 1
    least = _least(t, n - k + 1, threshold)
    least = F.when(least <= t, F.floor(t / F.lit(step)).cast("int") - t + least).otherwise(F.lit(0))
    last = F.greatest(F.lit(0), length - n)

    def starts(i):
        before = F.when(i > 1, F.element_at(places, F.greatest(F.lit(1), i - 1))).otherwise(F.lit(-1))
        low = F.greatest(F.lit(0), F.element_at(places, i + least - 1) - t + 1, before + 1)
        high = F.least(F.element_at(places, i), last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(places) - least + 1), starts))
    return F.when((least > 0) & (F.size(places) >= least), runs).otherwise(F.array().cast("array<int>"))


def items_of(benchmark: DataFrame, k: int) -> DataFrame:
    """item_id, n, k, features, fp of every item that has words; staged. Items of fewer than k words have one feature."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w"))
    b = b.filter("item_id is not null and size(w) > 0").withColumn("n", F.size("w"))
    few = F.array(F.xxhash64("w"))
    b = b.select("item_id", "n", F.least("n", F.lit(k)).alias("k"), F.when(F.col("n") < k, few).otherwise(shingle_hashes(F.col("w"), k)).alias("features"))
    return common.staged(b.withColumn("fp", simhash(F.col("features"))), "items")


def shared_places(text: DataFrame, shown: DataFrame, k: int, step: int = 1) -> DataFrame:
    """doc_id, len, n, places: where a document (doc_id, w) shows shingles of items of n words; multiples of ``step``."""
    hashes = text.select("doc_id", F.size("w").alias("len"), F.posexplode(shingle_hashes(F.col("w"), k, step)).alias("i", "h"))
    found = hashes.join(shown, "h").select("doc_id", "len", "n", (F.col("i") * step).alias("pos"))
    return found.groupBy("doc_id", "len", "n").agg(F.sort_array(F.collect_set("pos")).alias("places"))


def candidate_windows(docs: DataFrame, items: DataFrame, threshold: float, broadcast) -> DataFrame:
    """doc_id, k, n, start of every window that may be as similar as the threshold to an item of n words; staged.

    What is gathered for a document are places of its own text.
    """
    sizes = sorted((r["n"], r["k"]) for r in items.select("n", "k").distinct().collect())  # one row for each length
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    step = step_of(sizes, threshold)
    shown = {k: broadcast(items.filter(F.col("k") == k).select("n", F.explode("features").alias("h")).distinct()) for _, k in sizes}

    def windows(of: DataFrame, step: int) -> DataFrame:
        out = None
        split = of.select("doc_id", words(F.col("text")).alias("w"))
        for k, s in shown.items():
            at = window_starts(F.col("places"), F.col("len"), F.col("n"), F.lit(k), threshold, step)
            found = shared_places(split, s, k, step).select("doc_id", F.lit(k).alias("k"), "n", at.alias("at")).filter(F.size("at") > 0)
            out = found if out is None else out.unionByName(found)
        return out

    if step > 1:
        hit = common.staged(windows(text, step).select("doc_id").distinct(), "hit")
        text = text.join(common.few(hit), "doc_id", "left_semi")
    return common.staged(windows(text, 1).select("doc_id", "k", "n", F.explode("at").alias("start")).distinct(), "places")


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    k: int = 5,
    threshold: float = 0.8,
    radius: int = 38,
    most_broadcast: int = 2_000_000,
) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): the best window of each document for each item it contains.

    start is the number of the window's first word, from 0; of equally similar windows the first counts. Null, empty
    and word-free texts and items match nothing, a null doc_id or item_id is passed over. Documents shorter than an
    item are one window. Rows with one doc_id are one document; repeated rows change nothing. Very long texts are
    searched whole. Similarity equal to the threshold matches. Further columns are not looked at.
    """
    spark = docs.sparkSession
    items = items_of(benchmark, k)
    total = items.agg(F.sum(F.size("features")).alias("t")).first()["t"]
    if not total:
        return spark.createDataFrame([], "doc_id long, item_id long, similarity double, start int, n_words int")
    small = (lambda df: F.broadcast(df)) if total <= most_broadcast else (lambda df: df)
    places = candidate_windows(docs, items, threshold, small)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    text = text.join(common.few(common.staged(places.select("doc_id").distinct(), "ids")), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w"))
    cut = text.join(common.few(places), "doc_id").select("doc_id", "k", "n", "start", F.slice("w", F.col("start") + 1, F.col("n")).alias("run"))
    features = F.lit(None).cast("array<bigint>")
    for size in sorted(r["k"] for r in items.select("k").distinct().collect()):  # k values at most
        features = F.when(F.col("k") == size, shingle_hashes(F.col("run"), size)).otherwise(features)
    cut = common.staged(cut.select("doc_id", "n", "start", features.alias("features")).withColumn("mark", F.xxhash64("features")), "windows")
    content = cut.groupBy("n", "mark").agg(F.first("features").alias("features"))
    content = common.staged(content.withColumn("fp", simhash(F.col("features"))), "content")
    index_rows = items.count() * sum(math.comb(w, f) for _, w in blocks() for f in range(radius // N_BLOCKS + 1))
    small_index = small if index_rows <= most_broadcast else (lambda df: df)
    near = near_prints(content.select("n", "mark", "fp"), items.select("item_id", "n", F.col("fp").alias("item_fp")), radius, small_index)
    near = near.join(items.select("item_id", F.col("features").alias("item_features")), "item_id").join(content.select("n", "mark", "features"), ["n", "mark"])
    near = near.withColumn("similarity", weighted_jaccard(F.col("features"), F.col("item_features"))).filter(F.col("similarity") >= threshold)
    near = common.staged(near.select("n", "mark", "item_id", "similarity"), "near")
    found = cut.select("doc_id", "n", "start", "mark").join(common.few(near), ["n", "mark"])
    best = F.max_by(F.struct("similarity", "start", "n"), F.struct("similarity", (-F.col("start")).alias("s")))
    out = found.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return out.select("doc_id", "item_id", "b.similarity", "b.start", F.col("b.n").alias("n_words"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, with all their columns; those with a null doc_id or text stay."""
    found = common.staged(matches(docs, common.table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "matched")
    return docs.join(common.few(found), "doc_id", "left_anti").select(*docs.columns)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """The benchmark items that each document contains, alike to 0.8 by shingles of five words."""
    out = matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
),
b AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM benchmark
),
i AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k FROM b WHERE len(w) > 0),
si AS (SELECT item_id, n, k, u - 1 AS o, array_to_string(w[u:u + k - 1], ' ') AS s
       FROM (SELECT *, unnest(range(1, n - k + 2)) AS u FROM i)),
sd AS (SELECT doc_id, len, k, u - 1 AS p, array_to_string(w[u:u + k - 1], ' ') AS s
       FROM (SELECT doc_id, w, len(w) AS len, k, unnest(range(1, len(w) - k + 2)) AS u FROM d, (SELECT DISTINCT k FROM i))),
hit AS (SELECT DISTINCT doc_id, len, p, si.n, si.k FROM sd JOIN si USING (k, s)),
win AS (SELECT DISTINCT doc_id, n, k, unnest(range(greatest(0, p + k - n), least(p, greatest(0, len - n)) + 1)) AS start FROM hit),
cw AS (SELECT win.doc_id, win.n, win.k, start, s, count(*) AS c FROM win JOIN sd ON sd.doc_id = win.doc_id AND sd.k = win.k
       AND p >= start AND p + win.k <= start + win.n GROUP BY ALL),
tw AS (SELECT doc_id, n, k, start, sum(c) AS t FROM cw GROUP BY ALL),
ci AS (SELECT item_id, n, k, s, count(*) AS c FROM si GROUP BY ALL),
ti AS (SELECT item_id, n, sum(c) AS t FROM ci GROUP BY ALL),
shared AS (SELECT doc_id, item_id, cw.n, start, sum(least(cw.c, ci.c)) AS m FROM cw JOIN ci USING (n, k, s) GROUP BY ALL),
sim AS (SELECT doc_id, item_id, shared.n, start, m / (tw.t + ti.t - m) AS similarity
        FROM shared JOIN tw USING (doc_id, n, start) JOIN ti USING (item_id, n)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM sim WHERE similarity >= 0.8)
SELECT doc_id, item_id, round(similarity, 6) AS similarity, start::BIGINT AS start, n::BIGINT AS n_words FROM best WHERE r = 1
"""
