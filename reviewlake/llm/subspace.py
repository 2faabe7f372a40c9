"""Near copies among embeddings: a pigeonhole join over low-dimensional blocks of rotated vectors.

Vectors are compared where their labels are equal and their lengths too. Cosine c of unit vectors is a squared distance
of 2 - 2c, which a rotation leaves as it is. The rotated vectors are split into blocks of ``block_dims`` dimensions, and
each block gets its share of the greatest squared distance by its dimensions. Two vectors that are near enough must
keep to the share in one block at least, or their distances would sum to more. So the union of the pairs that each
block finds within its share holds every pair that is sought, and the cosine of whole vectors then decides.

A block's range join deals the vectors into cells of its first dimensions, whose side is twice the block's radius. A
vector is at home in one cell and visits those that its radius reaches. A small label has a few wide blocks and no
cells, since a wide block tells most and costs least; a large one has narrow blocks, whose radius is small against the
spread of a coordinate, and the more dimensions are cut the larger it is (``shape``). A cell of more than ``CHUNK``
vectors is compared in pieces of about ``CHUNK`` by ``CHUNK`` vectors, each a group of its own, so a hot label, or a
group of near copies with a third of all vectors, is spread, and a task holds two pieces. In a group, matrix products
find the pairs within the share, strip by strip, and those are verified.

How it grows: vectors spread evenly over all directions are the worst case. Then a label of n vectors sends each of
them to some 16 (n / CHUNK) ** 0.6 groups. A group of n near copies that are no copies sends each to n / CHUNK groups,
since the number of links of each has to be counted.

No pair leaves its group. A pair that several blocks find counts in the first of them, as its two vectors tell, so each
group gives the number of links of its vectors, and joins what it found linked to stars; sums of the numbers, and the
components of the stars, are the result. Equal vectors are one class with a count, so copies are not compared at all.

How sure: completely. Nothing is sampled and no partner is left out; a margin of a billionth keeps rounding from losing
pairs to a share, and cosines within a billionth of the threshold are found again in an order that is the same for both
vectors and every group.
"""

from __future__ import annotations

from itertools import pairwise, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, minhash

CHUNK, STRIP = 8192, 256
WIDE, NARROW = 16, 4
SLACK = 1e-9


def rotation(dims: int, seed: int = 13) -> np.ndarray:
    """A random rotation (rows are the new axes): it spreads distances evenly over the blocks, whatever the vectors."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((dims, dims)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T)


def blocks(dims: int, block_dims: int) -> list[tuple[int, int]]:
    """(from, to) of blocks of nearly equal width."""
    n = max(1, dims // block_dims)
    return list(pairwise(round(dims * i / n) for i in range(n + 1)))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows as doubles, divided by powers of two so that no square over- or underflows; no digit is lost."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotated(x: np.ndarray) -> np.ndarray:
    """Unit rows along the new axes. Row by row in one order, so a vector has the same coordinates in every group."""
    return np.stack([(x * axis).sum(1) for axis in rotation(x.shape[1])], axis=1)


def cells(y: np.ndarray, radius: float, cut: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, at home) of the cells that each row of ``y`` reaches; of the first ``cut`` dimensions."""
    side, n = 2 * radius, len(y)
    home = np.floor(y[:, :cut] / side).astype(np.int64)
    inside = y[:, :cut] - home * side
    rows, found, at_home = [], [], []
    for step in product((-1, 0, 1), repeat=cut):
        s = np.array(step, dtype=np.int64)
        gap = np.where(s < 0, inside, np.where(s > 0, side - inside, 0.0)) if cut else np.zeros((n, 0))
        ok = np.flatnonzero((gap * gap).sum(1) <= radius * radius * (1 + SLACK) + 10 * SLACK)
        rows.append(ok)
        found.append(home[ok] + s)
        at_home.append(np.full(len(ok), not s.any()))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(at_home)


def shape(n_rows: int) -> tuple[int, int]:
    """(dimensions of a block, how many of them are cut) for a label of so many vectors; a cut leaves a third of the pairs."""
    if n_rows <= 4 * CHUNK:
        return WIDE, 0
    cut = 1
    while cut < NARROW and 3**cut * CHUNK < n_rows:
        cut += 1
    return NARROW, cut


def linked_pairs(x: np.ndarray, home: np.ndarray, visits: np.ndarray, block: int, spans: list[tuple[int, int]], least: float):
    """(i, j, first), strip by strip: rows at home and visiting rows of ``x`` (as ``scaled`` gives them) that are linked
    and that this block finds; first: no earlier block does."""
    share = [(2 - 2 * least) * (b - a) / x.shape[1] * (1 + SLACK) + SLACK for a, b in spans]
    u, length = unit(x), (x * x).sum(1)
    y = rotated(u)
    a, b = spans[block]
    z = y[:, a:b]
    norm = (z * z).sum(1)
    for s in range(0, len(home), STRIP):
        h = home[s : s + STRIP]
        near = norm[h, None] + norm[None, visits] - 2 * (z[h] @ z[visits].T) <= share[block] + 1e-7
        if near.mean() > 0.05:  # most are copies of each other: all cosines by one product
            near &= u[h] @ u[visits].T >= least - SLACK
        i, j = np.nonzero(near)
        for t in range(0, len(i), 16_384):
            p, q = h[i[t : t + 16_384]], visits[j[t : t + 16_384]]
            ok = (p != q) & ((x[p] * x[q]).sum(1) / np.sqrt(length[p] * length[q]) >= least)
            p, q = p[ok], q[ok]
            # squares and sums are the same in every group, so all blocks agree on which of them is the first
            d = (y[p] - y[q]) ** 2
            within = [d[:, lo:hi].sum(1) <= most for (lo, hi), most in zip(spans[: block + 1], share, strict=False)]
            first = ~np.logical_or.reduce([np.zeros(len(p), dtype=bool), *within[:block]])
            yield p[within[block]], q[within[block]], first[within[block]]


def join_stars(top: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``top``, the least node that each node is connected with so far, after further links i - j."""
    while len(i):
        a, b = top[i], top[j]
        if (a == b).all():
            break
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))  # of two tops the greater takes the lesser
        while (top != top[top]).any():
            top = top[top]
    return top


def near_links(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label).

    Rows are linked if their labels are equal and not null, their embeddings have one length, and their cosine in
    double precision is at least ``least`` (above 0). Null embeddings, those that are empty or zero, and those that
    hold null, infinite or NaN components are linked with nothing. n_links is the number of other rows linked with a
    row; repeated rows are vectors of their own, linked with each other. component_id is the least vec_id reachable by
    links, where rows with one vec_id are one. A null vec_id is linked with nothing: its component_id is null, and it
    is kept. Further columns are not looked at. No rows: none.
    """
    common.bounded_batches(vectors.sparkSession)
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"
    e = F.col("embedding")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast(f"array<{kind}>").alias("embedding"), F.col("label").cast("string").alias("label"))
    finite = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists(e, lambda c: c != 0), F.lit(False))
    v = v.select("vec_id", "label", F.when(sound, e).alias("embedding"), F.monotonically_increasing_id().alias("rid"))
    # 128 bits of two unlike hashes stand for a vector
    v = common.staged(v.withColumns({"dims": F.size("embedding"), "h": F.xxhash64("embedding"), "g": F.xxhash64(F.lit(1), "embedding")}), "vectors")
    full = v.filter("embedding is not null")
    same = ["label", "dims", "h", "g"]
    classes = full.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("rid").alias("class"), F.first("embedding").alias("embedding"))
    classes = common.staged(classes, "classes")
    sizes = common.staged(classes.groupBy("label", "dims").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    dealt = classes.join(common.few(sizes), ["label", "dims"]).select("label", "dims", "n", "class", "rep", "copies", "embedding")

    def placed(batches):
        for pdf in batches:
            shapes = [shape(int(n)) for n in pdf["n"]]
            for (dims, (width, cut)), g in pdf.drop(columns="n").groupby([pdf["dims"], pd.Series(shapes, index=pdf.index)], sort=False):
                y = rotated(unit(scaled(np.stack(g["embedding"].to_list()))))
                for k, (a, b) in enumerate(blocks(dims, width)):
                    rows, cell, home = cells(y[:, a:b], float(np.sqrt((2 - 2 * least) * (b - a) / dims)), min(cut, b - a))
                    names = [",".join(map(str, x)) for x in cell.tolist()]
                    yield g.iloc[rows].assign(width=width, block=k, cell=names, home=home)

    key = ["label", "dims", "width", "block", "cell"]
    columns = f"label string, dims int, class long, rep long, copies long, embedding array<{kind}>, width int, block int, cell string, home boolean"
    visits = common.staged(dealt.mapInPandas(placed, columns), "cells")
    crowded = visits.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK).select(*key, F.ceil(F.col("n") / CHUNK).alias("pieces"))
    crowded = common.staged(crowded, "crowded")
    dealt = visits.join(common.few(crowded), key, "left").withColumn("pieces", F.coalesce("pieces", F.lit(1).cast("long")))
    mine = F.pmod(F.xxhash64("class"), F.col("pieces"))
    place = lambda i, j, at_home, visits: F.struct(i.alias("i"), j.alias("j"), at_home.alias("at_home"), visits.alias("visits"))
    each = F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)
    at_home = F.when(F.col("home"), F.transform(each, lambda p: place(mine, p, F.lit(True), p == mine))).otherwise(F.array())
    visiting = F.transform(F.filter(each, lambda p: (p != mine) | ~F.col("home")), lambda p: place(p, mine, F.lit(False), F.lit(True)))
    dealt = dealt.withColumn("p", F.explode(F.concat(at_home, visiting))).select(*key, "p.*", "class", "rep", "copies", "embedding")

    def compared(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        home, visit = np.flatnonzero(pdf["at_home"]), np.flatnonzero(pdf["visits"])
        if not len(home) or len(pdf) < 2:
            return pd.DataFrame({"class": [], "n": [], "rep": [], "top": []}, dtype="int64")
        pdf = pdf.reset_index(drop=True)
        ids, copies = pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
        order = np.argsort(ids, kind="stable")  # so that the first node is the one with the least id
        turned = np.empty_like(order)
        turned[order] = np.arange(len(order))
        n, top = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        _, dims, width, block, _ = key[:5]
        for i, j, first in linked_pairs(scaled(np.stack(pdf["embedding"].to_list())), home, visit, int(block), blocks(int(dims), int(width)), least):
            np.add.at(n, i[first], copies[j[first]])
            top = join_stars(top, turned[i], turned[j])
        top = ids[order][top][turned]
        some = np.flatnonzero((n > 0) | (top != ids))
        return pd.DataFrame({"class": pdf["class"].to_numpy()[some], "n": n[some], "rep": ids[some], "top": top[some]})

    found = common.staged(dealt.groupBy(*key, "i", "j").applyInPandas(compared, "class long, n long, rep long, top long"), "found")
    many = common.staged(classes.filter("copies > 1").select(*same, "rep", "class", "copies"), "many")
    members = full.select("rid", "vec_id", *same).join(common.few(many), same).select("rid", "vec_id", "rep", "class", "copies")
    members = common.staged(members, "members")
    links = found.filter("top <> rep").select(F.col("top").alias("a"), F.col("rep").alias("b"))
    links = links.unionByName(members.filter("rep <> vec_id").select(F.col("rep").alias("a"), F.col("vec_id").alias("b")))
    comps = minhash.components(links.distinct())
    counts = common.staged(found.groupBy("class").agg(F.sum("n").alias("n")), "counts")
    common.drop(visits, crowded, found)
    out = v.select("rid", "vec_id").join(members.select("rid", "class", "copies"), "rid", "left").withColumn("class", F.coalesce("class", "rid"))
    out = out.join(common.few(counts), "class", "left").withColumnRenamed("vec_id", "node").join(common.few(comps), "node", "left")
    zero = F.lit(0).cast("long")
    out = out.select(F.col("node").alias("vec_id"), (F.coalesce("n", zero) + F.coalesce(F.col("copies") - 1, zero)).alias("n_links"), F.coalesce("comp", "node").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op13_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """All embeddings, linked within their labels at a cosine of 0.98."""
    return near_links(common.table(spark, sf_dir, "embeddings"))


OP13_SQL = r"""
WITH RECURSIVE
v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
),
l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_inner_product(x.e, y.e) / sqrt(list_inner_product(x.e, x.e) * list_inner_product(y.e, y.e)) >= 0.98
),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN n ON a = vec_id
"""
