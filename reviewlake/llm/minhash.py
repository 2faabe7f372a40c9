"""MinHash near-dedup with an LSH forest: sorted signature orders, neighbours by longest common prefix.

A text's set is that of its word shingles (64-bit hashes). One pass over the texts stages, per document, the size and
digest of its set and its signature: ``TREES`` keys of ``HEAD`` minima of 32 bits, and a sketch of ``SKETCH`` minima of
8 bits. Equal sets are one class and go on as its smallest doc_id.

Every tree is a sorted order of the classes by its key. Neighbours that share ``BASE`` minima at least form a region:

* in a region of up to ``SMALL`` rows all are candidates of each other;
* a larger one is crowded. Its rows are sorted again by the key and, below it, by bytes of the sketch. Their region is
  then as deep as it takes to have ``WIDE`` rows at most, or a window of as many neighbours where even the full depth
  leaves more. Within it sketches are compared, and the pairs that may be similar enough are thinned to a forest of the
  likeliest ones.

Pairs of the small regions whose sketches rule them out are left out, and the rest is verified on the full sets;
verified links are joined into components by contraction. Crowded rows then go through once more, in these orders and
in ``TREES`` further ones by the sketch: this time every pair of a region that lies in two components, and that
sketches don't rule out, is verified. No pairs are made within a component, so a group of thousands of copies costs a
few links for each copy, whatever its size.

How sure: a pair at the threshold of 0.8 shares 3 minima in half the trees; 16 trees miss it once in 100,000 times. In
a crowd of n texts alike to s that are no copies of each other, a region is as deep as d = log(n / WIDE) / log(1 / s)
minima; a pair at 0.8 shares d minima in 0.8 ** d of the trees, so the 32 trees of a crowded row miss it with
(1 - 0.8 ** d) ** 32: once in 300,000 times at d = 5, in 1,900 at 7, in 38 at 10, and every second time at 17. No
exact way is cheaper than comparing all with all there, as all share most of what they hold; a link is only lost if no
others join its two texts. The README has measured recalls. What is found is verified exactly in any case.

A key that many share is split over sorted partitions, so no task grows with a group. A region that a partition's border
cuts is searched as two, which takes one tree from the few pairs across it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TREES, HEAD, BASE, DEEP, SKETCH = 16, 4, 3, 12, 512
SMALL, WIDE = 8, 256
ROWS_A_TASK = 60_000
PIECE, FLUSH_BYTES = 4096, 8 << 20

_MUL, _MIX, _32 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
_rng = np.random.default_rng(20)
_N = TREES * HEAD + SKETCH
_A = _rng.integers(0, 2**31, _N, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, _N, dtype=np.uint32)
KEY = 4 * HEAD + DEEP  # bytes of a crowded row's key; those of all trees of the last round fit in a sketch


class _Words(dict):
    """Word to 64-bit hash, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _32)) * _MIX
    return x ^ (x >> _32)


def shingles(text: str | None, k: int, store: _Words | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole where there are fewer words; none without.

    Only A-Z are lower-cased; words are parted by ASCII white space.
    """
    words = (text or "").encode().lower().split()
    store = _Words() if store is None else store
    h = np.fromiter(map(store.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(h)
    if not n:
        return h
    k = min(k, n)
    s = _mixed(h[: n - k + 1] + np.uint64(k))
    for j in range(1, k):
        s = _mixed(s * _MUL + h[j : n - k + 1 + j])
    return np.unique(s)


def minima(s: np.ndarray) -> np.ndarray:
    """The signature: the least value of the set under each of the hash functions."""
    out = np.full(_N, 0xFFFFFFFF, dtype=np.uint32)
    x, y = (s >> _32).astype(np.uint32), s.astype(np.uint32)
    for i in range(0, len(s), 256):
        v = x[i : i + 256, None] * _A
        v ^= y[i : i + 256, None] + _B
        v *= np.uint32(0x85EBCA6B)
        v ^= v >> np.uint32(15)
        np.minimum(out, v.min(0), out=out)
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits for a set, as two signed longs."""
    return tuple(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64).tolist())


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (d1, d2), head (the keys) and sketch of every row; these null if empty."""

    def signed(batches):
        store = _Words()  # for this task; a worker holds nothing between tasks
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                s = shingles(text, k, store)
                if not len(s):
                    rows.append((doc_id, 0, None, None, None, None))
                    continue
                m, d = minima(s), _digest(s)
                head = m[: TREES * HEAD].astype(">u4").tobytes()
                rows.append((doc_id, len(s), *d, head, (m[TREES * HEAD :] >> np.uint32(8)).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "d1", "d2", "head", "sketch"]).astype({c: "Int64" for c in ("doc_id", "d1", "d2")})

    return common.documents(docs).mapInPandas(signed, "doc_id long, n_shingles long, d1 long, d2 long, head binary, sketch binary")


def _gathered(batches, widths: dict[str, tuple[int, type]], plain: list[str]) -> list[np.ndarray] | None:
    """The columns of a sorted partition as arrays, freed batch by batch; binary ones as rows of numbers."""
    got: dict[str, list] = {c: [] for c in [*widths, *plain]}
    for pdf in batches:
        for c, (width, kind) in widths.items():
            got[c].append(np.frombuffer(b"".join(pdf[c]), dtype=kind).reshape(-1, width))
        for c in plain:
            got[c].append(pdf[c].to_numpy())
    if not sum(map(len, got[plain[0]])):
        return None
    return [np.concatenate(got.pop(c)) for c in [*widths, *plain]]


def _may_match(n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])


def _runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of rows; same[i] tells that row i goes with row i - 1."""
    starts = np.flatnonzero(~same)
    return starts, np.diff(np.append(starts, len(same)))


def _sorted_by_tree(rows: DataFrame, n_rows: int, columns: list[str]) -> DataFrame:
    """Rows in the sorted orders of all trees, dealt by range; equal keys part by doc_id."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // ROWS_A_TASK))
    return rows.repartitionByRange(parts, "tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id").select("tree", "key", "doc_id", *columns)


def _light_pairs(percent: int):
    def pairs(batches):
        got = _gathered(batches, {"key": (HEAD, np.uint32)}, ["tree", "doc_id", "n"])
        if got is None:
            return
        keys, tree, ids, n = got
        same = np.append(False, (keys[1:, :BASE] == keys[:-1, :BASE]).all(1) & (tree[1:] == tree[:-1]))
        starts, sizes = _runs(same)
        size = np.repeat(sizes, sizes)
        out_a, out_b = [], []
        for o in range(1, SMALL):
            i = np.flatnonzero((size[:-o] > o) & (size[:-o] <= SMALL)) if len(size) > o else np.array([], dtype=int)
            run = np.cumsum(~same)
            i = i[run[i] == run[i + o]]
            i = i[_may_match(n, i, i + o, percent) & (ids[i] != ids[i + o])]
            out_a.append(np.minimum(ids[i], ids[i + o]))
            out_b.append(np.maximum(ids[i], ids[i + o]))
        crowd = np.unique(ids[size > SMALL])
        a = np.concatenate([*out_a, crowd])
        b = np.concatenate([*out_b, np.full(len(crowd), -1)])
        mark = np.concatenate([np.zeros(len(a) - len(crowd), dtype=bool), np.ones(len(crowd), dtype=bool)])
        yield pd.DataFrame({"a": a, "b": b, "crowded": mark}).drop_duplicates()

    return pairs


def _deep_regions(tree: np.ndarray, keys: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the regions of the sorted rows, each only as deep as it must be to hold WIDE rows at most."""
    out = []
    lcp = np.zeros(len(tree), dtype=int)  # of a row with the one before
    if len(tree) > 1:
        eq = keys[1:] == keys[:-1]
        lcp[1:] = np.where(eq.all(1), keys.shape[1], eq.argmin(1)) * (tree[1:] == tree[:-1])
    whole = [4 * BASE, *range(4 * BASE + 4, 4 * HEAD, 4), *range(4 * HEAD, keys.shape[1] + 1)]  # minima of 4 bytes, then of one
    short = list(range(BASE, keys.shape[1] + 1))  # minima of one byte each
    border = int(np.searchsorted(tree, TREES))
    todo = [(lo, hi, levels, 0) for lo, hi, levels in ((0, border, whole), (border, len(tree), short)) if hi > lo]
    while todo:
        lo, hi, levels, level = todo.pop()
        starts, sizes = _runs(np.append(False, lcp[lo + 1 : hi] >= levels[level]))
        for s, z in zip(starts + lo, sizes, strict=True):
            if z < 2:
                continue
            if z <= WIDE:
                out.append((s, s + z))
            elif level + 1 < len(levels):
                todo.append((s, s + z, levels, level + 1))
            else:
                out += [(p, min(p + WIDE, s + z)) for p in range(s, s + z - WIDE // 2, WIDE // 2)]
    return out


def _crowd_pairs(percent: int, last: bool):
    """Pairs of crowded rows in other components that may be similar: a forest of the likeliest, or in the last round
    all that sketches don't rule out (by four standard deviations)."""
    sigma = np.sqrt(percent / 100 * (1 - percent / 100) / SKETCH)
    least = percent / 100 - (4 if last else 2.5) * sigma

    def pairs(batches):
        got = _gathered(batches, {"key": (KEY, np.uint8), "sketch": (SKETCH, np.uint8)}, ["tree", "doc_id", "n", "comp"])
        if got is None:
            return
        keys, sketch, tree, ids, n, comp = got
        found = set()
        made, n_made = [], 0
        for lo, hi in _deep_regions(tree, keys):
            i, j = np.triu_indices(hi - lo, 1)
            i, j = i + lo, j + lo
            ok = (comp[i] != comp[j]) & (ids[i] != ids[j]) & _may_match(n, i, j, percent)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            ok = (sketch[i, :64] == sketch[j, :64]).sum(1) >= 64 * (percent / 100 - 0.25)
            i, j = i[ok], j[ok]
            est = np.concatenate([(sketch[i[p : p + 4096]] == sketch[j[p : p + 4096]]).mean(1) for p in range(0, len(i), 4096)] or [np.array([])])
            if last:
                ok = est >= least
                a, b = ids[i[ok]], ids[j[ok]]
                made.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}))
                n_made += len(a)
                if n_made > 200_000:  # what a task holds is bounded; repeats go in ``verified``
                    yield pd.concat(made).drop_duplicates()
                    made, n_made = [], 0
                continue
            order = np.argsort(-est, kind="stable")
            root = {}

            def top(x, root=root):
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for p in order:
                if est[p] < least:
                    break
                a, b = int(ids[i[p]]), int(ids[j[p]])
                x, y = top(a), top(b)
                if x == y:
                    continue
                root[x] = y
                found.add((min(a, b), max(a, b)))
        if made:
            yield pd.concat(made).drop_duplicates()
        yield pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    return pairs


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs whose sketches don't rule them out (by four standard deviations); staged.

    It spares moving the sets of pairs that only share a frame: a sketch is an eighth of a set or less.
    """
    pairs = common.staged(pairs.distinct(), "pairs")
    ids = common.staged(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    sketches = reps.join(common.few(ids), "doc_id", "left_semi").select("doc_id", "sketch")
    least = percent / 100 - 4 * np.sqrt(percent / 100 * (1 - percent / 100) / SKETCH)

    def near(batches):
        for pdf in batches:
            x = np.frombuffer(b"".join(pdf["x"]), dtype=np.uint8).reshape(-1, SKETCH)
            y = np.frombuffer(b"".join(pdf["y"]), dtype=np.uint8).reshape(-1, SKETCH)
            yield pdf.loc[(x == y).mean(1) >= least, ["a", "b"]]

    joined = pairs.join(sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("x")), "a")
    joined = joined.join(sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("y")), "b")
    out = common.staged(joined.mapInPandas(near, "a long, b long"), "likely")
    common.drop(pairs, ids)
    return out


def pieces(s: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """A sorted set cut by its values' first bits: (bits, piece, values); as few bits as give pieces of PIECE on average."""
    bits = max(0, int(len(s) - 1).bit_length() - (PIECE - 1).bit_length()) if len(s) else 0
    if not bits:
        return [(0, 0, s)]
    cuts = np.searchsorted(s, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    return [(bits, i, x) for i, x in enumerate(np.split(s, cuts))]


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough, staged. Only the sets of texts in pairs are made and moved.

    Sets move in pieces by ranges of values, so what a row and a task hold is bounded however long the texts; what two
    sets share is summed over the ranges.
    """
    pairs = common.staged(pairs.distinct(), "pairs")

    def sets(batches):
        seen, store = set(), _Words()  # rows that repeat within a task go no further
        rows, held = [], 0
        frame = lambda rows: pd.DataFrame(rows, columns=["doc_id", "d", "n", "bits", "piece", "s"])
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"], strict=True):
                x = shingles(text, k, store)
                if (doc_id, d := _digest(x)[0]) in seen:
                    continue
                seen.add((doc_id, d))
                rows += [(doc_id, d, len(x), bits, i, v.tobytes()) for bits, i, v in pieces(x)]
                held += 8 * len(x)
                if held > FLUSH_BYTES:
                    yield frame(rows)
                    rows, held = [], 0
        if rows:
            yield frame(rows)

    def shared(batches):
        for pdf in batches:
            both = [len(np.intersect1d(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), assume_unique=True)) for x, y in zip(pdf["sa"], pdf["sb"], strict=True)]
            yield pdf[["a", "b", "da", "db", "na", "nb"]].assign(both=both)

    ids = common.staged(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    made = common.documents(docs).join(common.few(ids), "doc_id", "left_semi").mapInPandas(sets, "doc_id long, d long, n long, bits int, piece int, s binary")
    made = common.staged(made, "sets")
    side = lambda x: made.select(*[F.col(c).alias(o) for c, o in (("doc_id", x), ("d", f"d{x}"), ("n", f"n{x}"), ("bits", f"bits{x}"), ("piece", f"piece{x}"), ("s", f"s{x}"))])
    one, two = pairs.join(side("a"), "a").alias("one"), side("b").alias("two")
    coarser = lambda x, y: F.call_function("shiftright", F.col(f"piece{x}"), F.greatest(F.lit(0), F.col(f"bits{x}") - F.col(f"bits{y}")))
    alike = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (coarser("a", "b") == coarser("b", "a"))
    joined = one.join(two, (F.col("one.b") == F.col("two.b")) & alike).select("a", F.col("one.b").alias("b"), "da", "db", "na", "nb", "sa", "sb")
    counted = joined.mapInPandas(shared, "a long, b long, da long, db long, na long, nb long, both long")
    keys = ["a", "b", "da", "db", "na", "nb"]
    linked = counted.groupBy(*keys).agg(F.sum("both").alias("both")).filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both")))
    out = common.staged(linked.select("a", "b").distinct(), "links")
    common.drop(pairs, ids, made)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node in links (a, b): comp is the least node it is connected with; staged.

    Each partition first joins its own links to stars. Then, until no link is left, every node takes the least of
    itself and its neighbours (and that one's choice), and the links are rewritten between the chosen ones.
    """

    def stars(batches):
        root: dict[int, int] = {}

        def top(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for pdf in batches:
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
        rows = [(top(x), x) for x in list(root) if top(x) != x]
        yield pd.DataFrame(rows, columns=["a", "b"], dtype="int64")

    edges = common.staged(links.mapInPandas(stars, "a long, b long").distinct(), "edges")
    labels, steps = None, []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("p"))
        next_ = least.select(F.col("u").alias("p"), F.col("p").alias("q"))
        step = common.staged(least.join(next_, "p").select("u", F.col("q").alias("p")), "step")
        steps.append(step)
        x = edges.join(step.select(F.col("u").alias("a"), F.col("p").alias("x")), "a")
        x = x.join(step.select(F.col("u").alias("b"), F.col("p").alias("y")), "b").filter("x <> y")
        fewer = common.staged(x.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        common.drop(edges)
        edges = fewer
    common.drop(edges)
    for step in steps:  # every node follows what was chosen for it, round by round
        if labels is None:
            labels = step.select(F.col("u").alias("node"), F.col("p").alias("comp"))
        else:
            labels = labels.join(step, labels["comp"] == step["u"], "left").select("node", F.coalesce("p", "comp").alias("comp"))
    if labels is None:
        return links.sparkSession.createDataFrame([], "node long, comp long")
    labels = common.staged(labels, "labels")
    common.drop(*steps)
    return labels


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Texts are linked if 100 * |A and B| >= percent * |A or B|; component_id is the least doc_id reachable. Null and
    empty texts and those without words have no shingles and no links. Rows with one doc_id are one document, linked
    by each of its texts that has words. A null doc_id is linked with nothing: its component_id is null and it is
    kept. Repeated rows come back repeated.
    """
    made = common.staged(signatures(docs, k), "signatures")
    full = made.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "d1", "d2")
    classes = common.staged(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")), "classes")
    # only sets that several rows have need a look-up; any other row is its own class
    shared = common.staged(classes.filter("c > 1").select("d1", "d2", "rep"), "shared")
    shared = common.few(shared)
    copies = full.join(shared, ["d1", "d2"]).filter("doc_id <> rep").select("doc_id", "d1", "d2").distinct()
    copies = common.staged(copies, "copies")
    reps = made.filter("n_shingles > 0 and doc_id is not null").withColumnRenamed("n_shingles", "n")
    reps = reps.join(common.few(copies), ["doc_id", "d1", "d2"], "left_anti")
    if not full.groupBy("doc_id", "d1", "d2").agg(F.count("*").alias("c")).filter("c > 1").isEmpty():
        reps = reps.dropDuplicates(["doc_id", "d1", "d2"])
    n_reps = classes.count()
    common.drop(classes)
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    key = F.substring(F.col("head"), F.col("tree") * 4 * HEAD + 1, F.lit(4 * HEAD))
    light = reps.select("doc_id", "n", "head", trees).select("tree", key.alias("key"), "doc_id", "n")
    found = common.staged(_sorted_by_tree(light, TREES * n_reps, ["n"]).mapInPandas(_light_pairs(percent), "a long, b long, crowded boolean"), "light")
    crowd_ids = common.staged(found.filter("crowded").select(F.col("a").alias("doc_id")).distinct(), "crowd-ids")
    crowd = common.staged(reps.join(common.few(crowd_ids), "doc_id", "left_semi"), "crowd")
    n_crowd = crowd.count()

    def crowded(comps: DataFrame | None, last: bool) -> DataFrame:
        rows = crowd.withColumn("comp", F.col("doc_id")) if comps is None else crowd.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
        # the bytes of a sketch are minima of hash functions of their own, so each tree takes a stretch of them
        of = lambda c, start, n: F.substring(F.col(c), start + 1, n)
        keys = [F.concat(of("head", t * 4 * HEAD, 4 * HEAD), of("sketch", SKETCH - DEEP * (t + 1), DEEP)) for t in range(TREES)]
        if last:
            keys += [of("sketch", t * KEY, KEY) for t in range(TREES)]
        rows = rows.select("doc_id", "n", "comp", "sketch", F.posexplode(F.array(*keys)).alias("tree", "key"))
        return _sorted_by_tree(rows, len(keys) * n_crowd, ["n", "comp", "sketch"]).mapInPandas(_crowd_pairs(percent, last), "a long, b long")

    first = likely(found.filter("not crowded").select("a", "b"), reps, percent)
    # a doc_id with unlike texts is one document: what its texts are linked with belongs together
    unlike = full.groupBy("doc_id").agg(F.min("d1").alias("x"), F.max("d1").alias("y")).filter("x <> y").select("doc_id")
    twice = full.join(unlike, "doc_id").join(shared, ["d1", "d2"]).filter("doc_id <> rep")
    twice = twice.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = verified(docs, first.unionByName(crowded(None, False)) if n_crowd else first, k, percent)
    comps = components(links.unionByName(twice))
    if n_crowd:
        more = verified(docs, crowded(comps, True), k, percent)
        old = comps
        comps = components(old.filter("node <> comp").select(F.col("comp").alias("a"), F.col("node").alias("b")).unionByName(more))
        common.drop(old, more)
    common.drop(found, crowd, crowd_ids, links, copies)
    out = made.select("doc_id", "n_shingles", "d1", "d2").join(shared, ["d1", "d2"], "left").withColumn("node", F.coalesce("rep", "doc_id"))
    out = out.join(common.few(comps), "node", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "node")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id, with all its columns and repeated
    rows. Documents without words, or with a null doc_id, stay."""
    found = common.staged(near_duplicates(docs).filter("not kept").select("doc_id").distinct(), "not-kept")
    return docs.join(common.few(found), "doc_id", "left_anti").select(*docs.columns)


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, by sets of 4-word shingles that are alike to 80 %."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), k=4, percent=80)


OP1_SQL = r"""
WITH RECURSIVE
w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)
),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS d FROM s GROUP BY doc_id),
classes AS (SELECT d, n, min(doc_id) AS rep FROM sets GROUP BY d, n),
rs AS (SELECT rep, n, s FROM classes JOIN s ON s.doc_id = rep),
shared AS (SELECT x.rep AS a, y.rep AS b, x.n AS na, y.n AS nb, count(*) AS m FROM rs x JOIN rs y ON x.s = y.s AND x.rep < y.rep GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * m >= 80 * (na + nb - m)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
comps AS (SELECT a AS rep, min(b) AS comp FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(sets.n, 0)::BIGINT AS n_shingles, coalesce(comp, w.doc_id) AS component_id, coalesce(comp, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN sets USING (doc_id) LEFT JOIN classes USING (d, n) LEFT JOIN comps USING (rep)
"""
