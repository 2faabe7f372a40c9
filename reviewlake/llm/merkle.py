"""A Merkle manifest of a dataset: a tree of digests for each source, and one over the sources' roots.

Leaves are digests of rows. In each source they stand in order, and every ``ARITY`` neighbours become one digest, level
by level, until one is left; the sources' roots, in order, become one root in the same way. As the number of leaves of
a tree is known, so is that of every level, and with it which nodes are the children of one (the last run of a level
may have fewer).

The nodes of all trees are a sparse forest: ``Forest`` holds nodes that have not become a parent yet, by tree, level
and index. Two forests are merged by uniting them and then, wherever all children of a node are there, putting the node
in their place; the last node of a source's tree goes into the tree of the sources. It does not matter in which order
or grouping forests are merged, so they form a monoid, and partitions can be reduced as a tree:

1. rows are sorted and dealt into partitions of some ten thousand rows by ranges of (source, order, leaf), so a hot
   source, or even a hot row, is spread; each partition tells where it lies from the counts of all partitions;
2. each partition makes the forest of its rows: a few nodes a level, however many rows it has, since what lies inside
   of it has become parents;
3. the forests of ``FAN`` neighbouring partitions at a time are merged by one task, and so on until one is left, whose
   only node is the root;
4. on the way back each group hands its members the nodes that stand beside their ways up, a few a level;
5. with them each partition has all that it needs to prove each of its rows, and does so.

How it scales: digests alone are shuffled, not texts. The driver sees one row a partition (its first and last source as
digests, and counts), never nodes. A task holds the digests of one partition, or the forests of ``FAN`` of them. All
stages read tables in the shared folder, so lost executors cost their tasks only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ARITY, FAN = 3, 64
ROWS_A_TASK = 40_000
TOP = -1  # the tree of the sources; that of a source has its place among them as its number


def joined(parts) -> str:
    """The digest of some digests, as hex."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(n: int) -> list[int]:
    """The sizes of the levels above n leaves, n first."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


@dataclass
class Forest:
    """Nodes without a parent yet, {(tree, level, index): digest}; sizes: the number of leaves of their trees.

    ``made`` has all nodes that were ever there, for the proofs, where it is wanted.
    """

    nodes: dict[tuple[int, int, int], str] = field(default_factory=dict)
    sizes: dict[int, int] = field(default_factory=dict)
    made: dict[tuple[int, int, int], str] | None = None

    def merge(self, other: Forest) -> Forest:
        """This and another; neither is changed."""
        made = None if self.made is None else self.made | (other.made if other.made is not None else other.nodes)
        out = Forest(self.nodes | other.nodes, self.sizes | other.sizes, made)
        small = min(self.nodes, other.nodes, key=len)
        out.settle(list(small))
        return out

    def settle(self, new: list[tuple[int, int, int]]) -> None:
        """Puts parents in the place of complete children; ``new`` has at least one child of each such parent."""
        while new:
            tree, level, index = new.pop()
            if (tree, level, index) not in self.nodes:
                continue
            size = levels(self.sizes[tree])
            if len(size) == level + 1:  # the last of its tree
                if tree == TOP:
                    continue
                up = (TOP, 0, tree)
                digest = self.nodes.pop((tree, level, index))
                del self.sizes[tree]
            else:
                first = index - index % ARITY
                children = [(tree, level, i) for i in range(first, min(first + ARITY, size[level]))]
                if any(c not in self.nodes for c in children):
                    continue
                up = (tree, level + 1, index // ARITY)
                digest = joined(self.nodes.pop(c) for c in children)
            self.nodes[up] = digest
            if self.made is not None:
                self.made[up] = digest
            new.append(up)


@dataclass
class Stretch:
    """Neighbouring nodes of one level of one tree, as a partition has them: indexes from ``at`` on."""

    at: int
    digests: list[str]

    def above(self, size: int) -> Stretch:
        """The parents all of whose children are in the stretch."""
        lo, hi = -(-self.at // ARITY), -(-(self.at + len(self.digests)) // ARITY)
        if self.at + len(self.digests) < min(hi * ARITY, size):
            hi -= 1
        first = lo * ARITY - self.at
        return Stretch(lo, [joined(self.digests[first + ARITY * i : first + ARITY * i + ARITY]) for i in range(max(0, hi - lo))])


def whole(at: int, digests: list[str], n: int) -> list[Stretch]:
    """All levels of a stretch of a tree's n leaves, as far as they follow from it."""
    out = [Stretch(at, digests)]
    for size in levels(n)[:-1]:
        out.append(out[-1].above(size))
    return out


def loose(tree: int, stretches: list[Stretch], sizes: list[int]) -> dict[tuple[int, int, int], str]:
    """The nodes of stretches whose parents do not follow from them."""
    out = {}
    for level, (s, size) in enumerate(zip(stretches, sizes, strict=True)):
        end = s.at + len(s.digests)
        if level + 1 == len(sizes):
            keep = range(s.at, end)
        else:
            up = stretches[level + 1]
            a, b = up.at * ARITY, min((up.at + len(up.digests)) * ARITY, size)
            keep = [*range(s.at, min(a, end)), *range(max(b, s.at), end)] if up.digests else range(s.at, end)
        for i in keep:
            out[(tree, level, i)] = s.digests[i - s.at]
    return out


def partition_trees(sources: list, leaves: list[str], rank: int, start: int, n_first: int, n_last: int) -> list[tuple[int, int, int, list[str]]]:
    """(tree, place of the first leaf, leaves of the whole tree, digests) of the sources in a partition's sorted rows.

    ``rank`` is the first source's place among all, ``start`` that of the first row in it; only the first and the last
    source can go on in other partitions.
    """
    cuts = [0, *(i for i in range(1, len(sources)) if sources[i] != sources[i - 1]), len(sources)]
    out = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        n = n_first if k == 0 else n_last if k == len(cuts) - 2 else b - a
        out.append((rank + k, start if k == 0 else 0, n, leaves[a:b]))
    return out


def partition_forest(trees: list[tuple[int, int, int, list[str]]], n_sources: int) -> Forest:
    """The forest of a partition."""
    out = Forest(sizes={TOP: n_sources})
    roots: list[tuple[int, str]] = []
    for tree, at, n, digests in trees:
        made = whole(at, digests, n)
        if made[-1].digests:  # the whole tree is here
            roots.append((tree, made[-1].digests[0]))
            continue
        out.sizes[tree] = n
        out.nodes |= loose(tree, made, levels(n))
    if roots:
        out.nodes |= loose(TOP, whole(roots[0][0], [r for _, r in roots], n_sources), levels(n_sources))
    return out


def beside(nodes: dict[tuple[int, int, int], str], spans: dict[int, tuple[int, int]]) -> dict[tuple[int, int, int], str]:
    """Of the nodes those that are on the ways up of some leaves, or next to them; spans: from and to of the leaves, by tree."""
    out = {}
    for (tree, level, index), digest in nodes.items():
        if tree in spans:
            lo, hi = spans[tree]
            width = ARITY ** (level + 1)
            first = index // ARITY * width
            if first < hi and first + width > lo:
                out[(tree, level, index)] = digest
    return out


def proofs(changed: list[str], trees: list[tuple[int, int, int, list[str]]], context: dict[tuple[int, int, int], str], n_sources: int) -> list[tuple[str, str, str, str]]:
    """For each row (subroot, root, digest of its siblings, root as it follows from the changed leaf and the siblings)."""
    known = dict(context)
    roots = []
    for tree, at, n, digests in trees:
        made = whole(at, digests, n)
        for level, s in enumerate(made):
            for i, d in enumerate(s.digests):
                known[(tree, level, s.at + i)] = d
        if made[-1].digests:
            roots.append((tree, made[-1].digests[0]))
    if roots:
        for level, s in enumerate(whole(roots[0][0], [r for _, r in roots], n_sources)):
            for i, d in enumerate(s.digests):
                known[(TOP, level, s.at + i)] = d

    def node(key) -> str:
        """A node, by its children where it is on a way up and not known."""
        if key not in known:
            tree, level, index = key
            if tree == TOP and level == 0:
                known[key] = node((index, len(levels(of[index])) - 1, 0))
            else:
                size = levels(n_sources if tree == TOP else of[tree])[level - 1]
                known[key] = joined(node((tree, level - 1, i)) for i in range(ARITY * index, min(ARITY * index + ARITY, size)))
        return known[key]

    of = {tree: n for tree, _, n, _ in trees}
    top = levels(n_sources)
    out, row = [], 0
    near: dict[tuple[int, int, int], tuple[str, str]] = {}

    def pair(tree: int, level: int, index: int, size: int) -> tuple[str, str]:
        """Siblings before and after, joined."""
        key = (tree, level, index)
        if key not in near:
            first = index - index % ARITY
            near[key] = ("".join(node((tree, level, i)) for i in range(first, index)), "".join(node((tree, level, i)) for i in range(index + 1, min(first + ARITY, size))))
        return near[key]

    root = node((TOP, len(top) - 1, 0))
    for tree, at, n, digests in trees:
        subroot = node((TOP, 0, tree))
        sizes = levels(n)[:-1]
        up = [pair(TOP, level, tree // ARITY**level, size) for level, size in enumerate(top[:-1])]
        for i in range(at, at + len(digests)):
            way = [pair(tree, level, i // ARITY**level, size) for level, size in enumerate(sizes)] + up
            d = changed[row]
            for x, y in way:
                d = hashlib.sha256((x + d + y).encode()).hexdigest()
            out.append((subroot, root, hashlib.sha256("".join(x + y for x, y in way).encode()).hexdigest(), d))
            row += 1
    return out


NODES = "array<struct<tree: long, level: int, index: long, digest: string>>"
#: A forest as a row; spans: which leaves it comes from, of trees that are not whole in it.
FOREST = f"id long, nodes {NODES}, sizes array<struct<tree: long, n: long>>, spans array<struct<tree: long, lo: long, hi: long>>"


def _listed(nodes: dict[tuple[int, int, int], str]) -> list[dict]:
    return [{"tree": t, "level": v, "index": i, "digest": d} for (t, v, i), d in sorted(nodes.items())]


def _packed(f: Forest, spans: dict[int, tuple[int, int]]) -> dict:
    return {"nodes": _listed(f.nodes), "sizes": [{"tree": t, "n": n} for t, n in sorted(f.sizes.items())], "spans": [{"tree": t, "lo": a, "hi": b} for t, (a, b) in sorted(spans.items())]}


def _nodes(listed) -> dict[tuple[int, int, int], str]:
    return {(int(x["tree"]), int(x["level"]), int(x["index"])): x["digest"] for x in listed}


def _spans(listed) -> dict[int, tuple[int, int]]:
    return {int(x["tree"]): (int(x["lo"]), int(x["hi"])) for x in listed}


def field_text(c: Column) -> Column:
    """A value as it goes into a leaf: its UTF-8 bytes' count, ":" and it; "-" for a null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """The digest of a row, as hex."""
    return F.sha2(F.concat(*map(field_text, columns)), 256)


def _placed(rows: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Sorted rows with their partition (part) and place (at); where each partition lies; how many partitions and sources."""
    spark = rows.sparkSession
    rows = common.staged(rows.withColumn("rid", F.monotonically_increasing_id()), "leaves")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_A_TASK))
    by = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf", "rid"]  # rid parts rows that are alike
    placed = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("rid").withColumn("at", F.monotonically_increasing_id())
    placed = common.staged(placed.withColumn("part", F.shiftright("at", 33)), "sorted")
    common.drop(rows)
    runs = placed.groupBy("part", F.sha2(field_text(F.col("source")), 256).alias("s")).agg(F.count("*").alias("n"), F.min("at").alias("at"))
    one = F.struct("at", "s", "n")
    ends = runs.groupBy("part").agg(F.min(one).alias("first"), F.max(one).alias("last"), F.count("*").alias("k")).orderBy("part").collect()
    rank, before, total, seen = -1, None, {}, []
    for r in ends:
        rank += r["first"]["s"] != before
        first, start = rank, total.get(rank, 0)
        total[rank] = start + r["first"]["n"]
        rank += r["k"] - 1
        if r["k"] > 1:
            total[rank] = r["last"]["n"]
        before = r["last"]["s"]
        seen.append((r["part"], first, start, rank))
    where = [(part, first, start, total[first], total[last]) for part, first, start, last in seen]
    return placed, spark.createDataFrame(where, "part long, rank long, start long, n_first long, n_last long"), parts, rank + 1


def manifest(rows: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root of rows (source string, doc_id long, leaf, changed: digests as hex).

    Leaves ascend by (source, doc_id, leaf), nulls first and strings by their bytes. proof_sha256 is the digest of the
    row's siblings, level by level, from left to right; folded_root the root that follows from ``changed`` and these
    siblings. A null source is a source of its own. Repeated rows are leaves of their own, one beside the other. No
    rows: none.
    """
    rows, where, parts, n_sources = _placed(rows.select("source", "doc_id", "leaf", "changed"))

    def trees_of(pdf: pd.DataFrame, w):
        sources = [s if isinstance(s, str) else None for s in pdf["source"]]
        return partition_trees(sources, list(pdf["leaf"]), int(w["rank"]), int(w["start"]), int(w["n_first"]), int(w["n_last"]))

    def forest(key: tuple, pdf: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        trees = trees_of(pdf.sort_values("at"), w.iloc[0])
        spans = {tree: (at, at + len(d)) for tree, at, n, d in trees if len(d) < n} | {TOP: (trees[0][0], trees[-1][0] + 1)}
        return pd.DataFrame([{"id": key[0], **_packed(partition_forest(trees, n_sources), spans)}])

    def merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, spans = Forest(sizes={TOP: n_sources}, made={}), {}
        for x in pdf.itertuples():
            nodes = _nodes(x.nodes)
            out = out.merge(Forest(nodes, {int(y["tree"]): int(y["n"]) for y in x.sizes}, nodes))
            for tree, (lo, hi) in _spans(x.spans).items():
                a, b = spans.get(tree, (lo, hi))
                spans[tree] = (min(a, lo), max(b, hi))
        spans = {tree: s for tree, s in spans.items() if tree in out.sizes}  # trees that are whole now need nothing more
        return pd.DataFrame([{"id": key[0], **_packed(out, spans), "made": _listed(out.made)}])

    def handed_down(key: tuple, members: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        nodes = _nodes(group["made"].iloc[0]) | _nodes(group["handed"].iloc[0])
        return pd.DataFrame([{"id": x.id, "handed": _listed(beside(nodes, _spans(x.spans)))} for x in members.itertuples()])

    def proved(key: tuple, pdf: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        pdf, x = pdf.sort_values("at"), w.iloc[0]
        found = proofs(list(pdf["changed"]), trees_of(pdf, x), _nodes(x["handed"]), n_sources)
        out = pd.DataFrame(found, columns=["subroot", "root", "proof_sha256", "folded_root"], index=pdf.index)
        return pd.concat([pdf[["doc_id", "leaf"]], out], axis=1)

    forests = rows.select("part", "at", "source", "leaf").groupBy("part").cogroup(where.groupBy("part")).applyInPandas(forest, FOREST)
    tiers = [common.staged(forests, "forests")]
    group = F.floor(F.col("id") / FAN).alias("group")
    n = parts
    while len(tiers) == 1 or n > 1:  # log(partitions) / log(FAN) times
        tiers.append(common.staged(tiers[-1].groupBy(group).applyInPandas(merged, f"{FOREST}, made {NODES}"), "forests"))
        n = -(-n // FAN)
    handed = tiers[-1].select("id", F.array().cast(NODES).alias("handed"))
    for members, groups in zip(tiers[-2::-1], tiers[:0:-1], strict=True):
        groups = groups.select("id", "made").join(handed, "id")
        handed = members.select("id", "spans").groupBy(group).cogroup(groups.groupBy(F.col("id").alias("group"))).applyInPandas(handed_down, f"id long, handed {NODES}")
        handed = common.staged(handed, "handed")
    given = where.join(handed.withColumnRenamed("id", "part"), "part")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return rows.groupBy("part").cogroup(given.groupBy("part")).applyInPandas(proved, schema)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents by source, and whether rows, half of which lose their line breaks, still prove it."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    of = lambda text: leaf(*map(F.col, ("doc_id", "source", "lang", "n_chars")), text)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)) & F.contains("text", F.lit("\n"))
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), of(F.col("text")).alias("leaf"),
                       F.when(tampered, of(F.translate("text", "\n", ""))).alias("changed"))
    rows = rows.withColumn("changed", F.coalesce("changed", "leaf"))
    return manifest(rows).withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = r"""
WITH RECURSIVE
d AS (
  SELECT doc_id, source, text,
         CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
           || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
           || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
           || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head,
         list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))) AS crc
  FROM documents
),
e AS (SELECT doc_id, source, head, text, CASE WHEN (4294967295 - crc) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM d),
leaves AS (
  SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         sha256(head || CASE WHEN changed IS NULL THEN '-' ELSE strlen(changed) || ':' || changed END) AS changed,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM e
),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
up AS (
  SELECT tree, 0 AS level, pos AS i, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, level + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY tree, level, i // 3
),
subroots AS (SELECT tree, h AS subroot FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, tree AS i, (SELECT count(*) FROM subroots) AS n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 3
),
nodes AS (SELECT tree, level, i, n, h FROM up WHERE n > 1 UNION ALL SELECT -1, level, i, n, h FROM top WHERE n > 1),
steps AS (
  SELECT tree, level, i, coalesce((SELECT string_agg(m.h, '' ORDER BY m.i) FROM nodes m WHERE m.tree = o.tree AND m.level = o.level AND m.i // 3 = o.i // 3 AND m.i < o.i), '') AS before,
         coalesce((SELECT string_agg(m.h, '' ORDER BY m.i) FROM nodes m WHERE m.tree = o.tree AND m.level = o.level AND m.i // 3 = o.i // 3 AND m.i > o.i), '') AS after
  FROM nodes o
),
walk AS (
  SELECT p.tree, p.pos, p.changed AS h, '' AS proof, p.tree AS t, 0 AS level, p.pos AS i, false AS done FROM placed p
  UNION ALL
  SELECT w.tree, w.pos, CASE WHEN s.tree IS NULL THEN w.h ELSE sha256(s.before || w.h || s.after) END, w.proof || coalesce(s.before, '') || coalesce(s.after, ''),
         CASE WHEN s.tree IS NULL THEN -1 ELSE w.t END, CASE WHEN s.tree IS NULL THEN 0 ELSE w.level + 1 END, CASE WHEN s.tree IS NULL THEN w.tree ELSE w.i // 3 END, s.tree IS NULL AND w.t = -1
  FROM walk w LEFT JOIN steps s ON s.tree = w.t AND s.level = w.level AND s.i = w.i WHERE NOT w.done
)
SELECT p.doc_id, p.leaf, r.subroot, top.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = top.h AS verified
FROM placed p JOIN subroots r USING (tree) JOIN (SELECT * FROM walk WHERE done) w ON w.tree = p.tree AND w.pos = p.pos JOIN top ON top.n = 1
"""
