"""Merkle manifests, periodic runs and links of embeddings, each held against another way to the same rows."""

import collections
import hashlib
import itertools
import random
import time
import zlib

import numpy as np
import pytest

from reviewlake.llm import common, merkle, periodic, queries, subspace

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


# --- manifests


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_digest(doc_id, source, lang, n_chars, text):
    of = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return digest(map(of, (doc_id, source, lang, n_chars, text)))


def proved(leaves):
    """(root, for each leaf the runs on its way up as (before, after) lists)."""
    ways, level, place = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for w, i in zip(ways, place, strict=True):
            a = i - i % 3
            w.append((level[a:i], level[i + 1 : a + 3]))
        level = [digest(level[a : a + 3]) for a in range(0, len(level), 3)]
        place = [i // 3 for i in place]
    return level[0], ways


def brute_manifest(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    trees = []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        rs = sorted(by[source], key=lambda r: (r[0] is not None, r[0] or 0, row_digest(*r)))
        leaves = [row_digest(*r) for r in rs]
        trees.append((rs, leaves, *proved(leaves)))
    root, tops = proved([t[2] for t in trees]) if trees else (None, [])
    out = []
    for (rs, leaves, subroot, ways), top in zip(trees, tops, strict=True):
        for r, leaf, way in zip(rs, leaves, ways, strict=True):
            d = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                d = row_digest(*r[:4], r[4].replace("\n", ""))
            for x, y in way + top:
                d = digest([*x, d, *y])
            out.append((r[0], leaf, subroot, root, digest(s for x, y in way + top for s in (*x, *y)), d, d == root))
    return sorted(out, key=repr)


def manifest_of(spark, tmp_path, rows, schema=DOCS):
    path = str(tmp_path / f"d{time.monotonic_ns()}")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    return queries.QUERIES["op11_merkle_manifest"](spark, path)


def test_op11_of_the_whole_table(spark):
    rows = [tuple(r) for r in common.table(spark, SF, "documents").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op11_merkle_manifest"](spark, SF).collect()), key=repr) == brute_manifest(rows)


@pytest.mark.parametrize(("a_task", "fan"), [(40_000, 64), (6, 3)])
def test_op11_however_rows_are_dealt(spark, tmp_path, monkeypatch, a_task, fan):
    """A hot source, many small ones, one row alike many times, nulls, and long texts; over a few partitions, and over twenty in three tiers."""
    monkeypatch.setattr(merkle, "ROWS_A_TASK", a_task)
    monkeypatch.setattr(merkle, "FAN", fan)
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else f"s{rng.randrange(12)}", "en", i, f"a\n{i}" if i % 2 else "b") for i in range(70)]
    rows += [(None, None, None, None, None), (5, None, None, 3, ""), (-7, "", "x", 0, "\n"), (200, "é", "y", 9, "ü\n" * 50_000)]
    rows += [(9, "hot", "en", 9, "same")] * 9 + [(9, "hot", "en", 9, "other")] * 2 + [(1000 + i, f"one{i}", "en", 1, "x") for i in range(10)]
    assert sorted(map(tuple, manifest_of(spark, tmp_path, rows).collect()), key=repr) == brute_manifest(rows)


def test_op11_of_few_rows(spark, tmp_path):
    assert manifest_of(spark, tmp_path, []).count() == 0
    for n in (1, 4):
        rows = [(i, "s", "en", 1, f"{i}\n") for i in range(n)]
        assert sorted(map(tuple, manifest_of(spark, tmp_path, rows).collect()), key=repr) == brute_manifest(rows)
    more = manifest_of(spark, tmp_path, [(1, "s", "en", 1, "x", "r", 7)], DOCS + ", root string, part int")
    assert tuple(more.first()) == brute_manifest([(1, "s", "en", 1, "x")])[0]


def test_forests_are_a_monoid():
    """Any order and grouping of merging gives the same forest."""
    rng, leaves = random.Random(1), {}
    sizes = {merkle.TOP: 3, 0: 14, 1: 1, 2: 9}
    for t in (0, 1, 2):
        leaves |= {(t, 0, i): digest([f"{t}/{i}"]) for i in range(sizes[t])}
    tops = [proved([leaves[(t, 0, i)] for i in range(sizes[t])])[0] for t in (0, 1, 2)]
    for _ in range(50):
        parts = []
        for key in rng.sample(sorted(leaves), len(leaves)):
            f = merkle.Forest(sizes=dict(sizes)).merge(merkle.Forest({key: leaves[key]}, dict(sizes)))
            parts.append(f)
        while len(parts) > 1:
            a = parts.pop(rng.randrange(len(parts)))
            b = parts.pop(rng.randrange(len(parts)))
            before = dict(a.nodes)
            parts.append(a.merge(b))
            assert a.nodes == before
        assert parts[0].nodes == {(merkle.TOP, 1, 0): digest(tops)}


# --- runs


def brute_runs(a, least=6, times=4):
    out = set()
    for p in range(1, len(a) // times + 1):
        i = 0
        while i < len(a) - p:
            j = i
            while j < len(a) - p and a[j] == a[j + p]:
                j += 1
            n = j - i + p
            if j > i and n >= max(least, times * p) and not any(a[i : i + n - q] == a[i + q : i + n] for q in range(1, p)):
                out.add((i, n, p))
            i = j + 1
    return sorted(out)


def repetitive(rng):
    a = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randint(0, 50))]
    while a and rng.random() < 0.7:
        i, p, m = rng.randrange(len(a)), rng.randint(1, 9), rng.randint(1, 40)
        a = (a[:i] + (a[i : i + p] * 40)[:m] + a[i:])[:150]
    return a


def test_next_smaller_suffixes():
    rng = random.Random(3)
    for _ in range(500):
        a = repetitive(rng)
        nss, agree = periodic.next_smaller(a)
        n = len(a)
        assert nss == [next((j for j in range(i + 1, n) if a[j:] < a[i:]), n) for i in range(n)]
        assert agree == [next((k for k in range(n) if j + k == n or a[i + k] != a[j + k]), 0) for i, j in enumerate(nss)]


def test_runs_against_all_periods():
    rng = random.Random(4)
    texts = [repetitive(rng) for _ in range(600)]
    for a in texts:
        for least, times in ((6, 4), (2, 2), (9, 3)):
            assert periodic.runs(a, least, times) == brute_runs(a, least, times)
    # many texts at once, of which only repetitive places are looked at
    assert periodic.runs_of_texts(texts) == [brute_runs(a) for a in texts]
    assert periodic.runs_of_texts(texts, 9, 3) == [brute_runs(a, 9, 3) for a in texts]
    assert periodic.runs_of_texts([]) == [] and periodic.runs_of_texts([[], []]) == [[], []]


def test_runs_at_the_limits():
    """Exactly four periods and one word less; exactly six words; runs that end with the text; long ones."""
    a = list("abcabcabcabc")
    assert periodic.runs(a) == [(0, 12, 3)] and periodic.runs(a[:-1]) == [] and periodic.runs(["x", *a, "a", "x"]) == [(1, 13, 3)]
    assert periodic.runs(["a"] * 6) == [(0, 6, 1)] and periodic.runs(["a"] * 5) == []
    assert periodic.runs(["a", "b"] * 4) == [(0, 8, 2)] and periodic.runs(["a", "b"] * 3 + ["a"]) == []
    root = [f"w{i}" for i in range(9000)]
    assert periodic.runs_of_texts([["a", *root * 4, "b"], root * 3]) == [[(1, 36_000, 9000)], []]


def compares(a):
    """Words that are looked at to find the next smaller suffixes."""
    seen = 0

    class Word(int):
        def __eq__(self, other):
            nonlocal seen
            seen += 1
            return int(self) == int(other)

        def __lt__(self, other):
            nonlocal seen
            seen += 1
            return int(self) < int(other)

        __hash__ = int.__hash__

    periodic.next_smaller([Word(x) for x in a])
    return seen


def test_comparing_is_linear():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 4000:
        fib.append(fib[-1] + fib[-2])
    rng = random.Random(7)
    kinds = [[0] * 4000, [0, 1] * 2000, [1, 0] * 2000, ([0] * 40 + [1]) * 97, fib[-1][:4000], [bin(i).count("1") % 2 for i in range(4000)], [rng.randrange(9) for _ in range(570)] * 7, [1] * 2000 + [0] * 2000]
    for a in kinds:
        for b in (a, [-x for x in a]):
            assert compares(b) < 20 * len(b)


def brute_op12(rows):
    out = []
    for doc_id, text in rows:
        w = (text or "").encode().split()
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = brute_runs(w)
        gone = {i for s, m, p in runs for i in range(s + p, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        out.append((doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=repr)


def test_op12_against_all_periods(spark):
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, SF, "documents").collect() if len((r["text"] or "").split()) < 1500]
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == common.table(spark, SF, "documents").count()
    assert sorted((got[i] for i, _ in rows), key=repr) == brute_op12(rows)
    assert sum(r[1] > 0 for r in got.values()) > 20


def test_op12_of_odd_texts(spark, tmp_path):
    rows = [(None, "a " * 9), (1, None), (2, ""), (3, " \n\t\x0b\x0c\r"), (4, "é é é é é é é é é é é é"), (4, "x y " * 5), (4, "x y " * 5), (6, "b " * 300_000)]
    rows += [(i, " ".join(f"w{j % 7}" for j in range(i % 60))) for i in range(10, 200)]
    spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_runs int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()), key=repr)
    short = [r for r in rows if r[0] != 6]
    assert [r for r in got if r[0] != 6] == brute_op12(short)
    assert [r[1:5] for r in got if r[0] == 6] == [(1, 0, 300_000, 1)]
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- links


def brute_links(rows, least=0.98):
    ok = lambda e: e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)
    n, root = [0] * len(rows), {r[0]: r[0] for r in rows if r[0] is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(enumerate(rows), 2):
        if a[0] is None or b[0] is None or a[2] is None or a[2] != b[2] or not (ok(a[1]) and ok(b[1])) or len(a[1]) != len(b[1]):
            continue
        x, y = (np.ldexp(np.array(v, dtype=float), -np.frexp(np.abs(v).max())[1]) for v in (a[1], b[1]))
        if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
            n[i] += 1
            n[j] += 1
            p, q = top(a[0]), top(b[0])
            root[max(p, q)] = min(p, q)
    return sorted(((r[0], n[i], None if r[0] is None else top(r[0]), r[0] is None or top(r[0]) == r[0]) for i, r in enumerate(rows)), key=repr)


VECTORS = "vec_id long, embedding array<{}>, label int"


def links_of(spark, rows, kind="float", **options):
    return sorted(map(tuple, subspace.near_links(spark.createDataFrame(rows, VECTORS.format(kind)).repartition(3), **options).collect()), key=repr)


def clustered(rng, n, dims, noise, labels=3):
    centres = rng.standard_normal((max(1, n // 9), dims))
    x = centres[rng.integers(0, len(centres), n)] + noise * rng.standard_normal((n, dims)) * rng.random((n, 1))
    return [(int(i), [float(np.float32(c)) for c in v], int(rng.integers(0, labels))) for i, v in zip(rng.permutation(n) * 3, x, strict=True)]


@pytest.mark.parametrize(("dims", "noise", "chunk"), [(64, 0.25, 8192), (16, 0.3, 8), (5, 0.2, 3)])
def test_links_against_all_pairs(spark, monkeypatch, dims, noise, chunk):
    """Groups around the threshold; with small chunks cells are cut in many dimensions and crowded ones in pieces."""
    monkeypatch.setattr(subspace, "CHUNK", chunk)
    rows = clustered(np.random.default_rng(dims + chunk), 250, dims, noise)
    got = links_of(spark, rows)
    assert got == brute_links(rows) and sum(r[1] for r in got) > 20


def test_links_of_odd_vectors(spark):
    one, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [(1, one, 0), (2, one, 0), (2, one, 0), (3, one, None), (4, one, 1), (None, one, 0), (5, None, 0), (6, [], 0), (7, [0.0, 0.0, 0.0], 0), (8, [1.0, None, 3.0], 0), (9, [1.0, nan, 3.0], 0), (10, [1.0, inf, 3.0], 0)]
    rows += [(11, [-1.0, -2.0, -3.0], 0), (12, [1e-30, 2e-30, 3e-30], 0), (13, [1e30, 2e30, 3e30], 0), (14, [1.0, 2.0], 0), (15, [1.0, 2.0], 0), (16, [0.0, 0.0, 1.0], 5), (16, [0.0, 1.0, 0.0], 5), (17, [0.0, 1.0, 0.0], 5), (18, [0.0, 0.0, 1.0], 5), (19, [-0.0, 1.0, 0.0], 5)]
    assert links_of(spark, rows, "double") == brute_links(rows)
    huge = [(1, [1e200, 1e200], 0), (2, [1e-200, 1e-200], 0), (3, [1e200, -1e200], 0)]
    assert links_of(spark, huge, "double") == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert subspace.near_links(spark.createDataFrame([], VECTORS.format("float"))).count() == 0
    more = spark.createDataFrame([(1, one, 0, 5, "x"), (2, one, 0, 6, "y")], VECTORS.format("float") + ", n_links int, cell string")
    assert sorted(map(tuple, subspace.near_links(more).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_links_at_the_threshold(spark):
    """Pairs that are exactly as near as it takes, and chains of them."""
    rows = [(1, [1.0, 0.0, 0.0], 0), (2, [0.6, 0.8, 0.0], 0), (3, [0.6, 0.0, 0.8], 0), (4, [3.0, 4.0, 0.0], 0)]
    got = links_of(spark, rows, "double", least=0.6)
    assert got == [(1, 3, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 2, 1, False)] == brute_links(rows, 0.6)


def test_a_crowd_of_near_copies_makes_no_rows_by_pairs(spark):
    """Six hundred near copies have 179,700 pairs; what leaves the groups is a few rows a vector."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal(64)
    rows = [(i, [float(c) for c in base + 0.05 * rng.standard_normal(64)], 0) for i in range(600)]
    got = links_of(spark, rows)
    assert got == sorted(((i, 599, 0, i == 0) for i in range(600)), key=repr)
    x = subspace.scaled(np.array([r[1] for r in rows]))
    spans = subspace.blocks(64, 16)
    firsts = [sum(f.sum() for _, _, f in subspace.linked_pairs(x, np.arange(600), np.arange(600), k, spans, 0.98)) for k in range(4)]
    assert sum(firsts) == 600 * 599


def test_op13_of_the_whole_table(spark):
    rows = [tuple(r) for r in common.table(spark, "/root/testdata/sf0.01", "embeddings").select("vec_id", "embedding", "label").collect()]
    twin = rows + [(10_000 + i, e if i % 2 else [x * 1.5 for x in e], label) for i, e, label in rows if i % 5 == 0]
    assert links_of(spark, twin) == brute_links(twin)
    assert sorted(map(tuple, queries.QUERIES["op13_embedding_dedup"](spark, "/root/testdata/sf0.01").collect()), key=repr) == brute_links(rows)


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_embedding_dedup"])
def test_sql_gives_the_same(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    frame = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    assert sorted(c[0] for c in want.description) == sorted(frame.columns)
    columns = ", ".join(frame.columns)
    want = con.execute(f"SELECT {columns} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted(want, key=repr)


def test_components_of_stars():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m = int(rng.integers(1, 30)), int(rng.integers(0, 40))
        i, j = rng.integers(0, n, m), rng.integers(0, n, m)
        root = list(range(n))
        for _ in range(n):
            for a, b in zip(i, j, strict=True):
                root[a] = root[b] = min(root[a], root[b])
        top = subspace.join_stars(np.arange(n), i[: m // 2], j[: m // 2])
        assert subspace.join_stars(top, i[m // 2 :], j[m // 2 :]).tolist() == root


def test_columns_of_the_contract(spark):
    types = {n: dict(queries.QUERIES[n](spark, SF).dtypes) for n in ("op11_merkle_manifest", "op12_periodic_runs", "op13_embedding_dedup")}
    assert types["op12_periodic_runs"] == {"doc_id": "bigint", **dict.fromkeys(("n_runs", "start", "length", "period", "exponent_milli"), "bigint"), "runs_sha256": "string", "collapsed_sha256": "string"}
    assert types["op13_embedding_dedup"] == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert types["op11_merkle_manifest"] == {"doc_id": "bigint", **dict.fromkeys(("leaf", "subroot", "root", "proof_sha256", "folded_root"), "string"), "verified": "boolean"}
