"""Operators over whole tables: near copies, lines, shards, archives, decontamination, and the pipeline."""

import collections
import glob
import hashlib
import math
import os
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import common, decontaminate, linedup, minhash, queries, sharding, warc

SF = "/root/testdata/sf0.001"


def brute_components(rows, k, percent=80):
    """{doc_id: least reachable doc_id} over all pairs; rows: (doc_id, text)."""
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        if i is not None:
            s = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
            sets[i].append(s)
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def varied(rng, base, edits):
    w = list(base)
    for j in rng.choice(len(w), edits, replace=False):
        w[j] = f"e{rng.integers(1 << 40)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies():
    """Groups of near copies of all sizes around the threshold, a crowd, exact copies and strangers."""
    rng = np.random.default_rng(5)
    rows, word = [], lambda: f"w{rng.integers(1 << 40)}"
    for g in range(40):
        base = [word() for _ in range(int(rng.integers(30, 90)))]
        for _ in range(int(rng.integers(1, 5))):
            rows.append(varied(rng, base, int(rng.integers(0, 4))))
    base = [word() for _ in range(120)]
    rows += [varied(rng, base, int(rng.integers(0, 5))) for _ in range(150)]
    rows += ["exact copy of one text"] * 30 + ["A b C", "a B c", "a", "A", "", None, "  \n", "a b c d e", "x " * 4000]
    order = rng.permutation(len(rows))
    return [(int(i), rows[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_like_all_pairs(spark, copies, k):
    df = spark.createDataFrame(copies, "doc_id long, text string")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, k).collect()}
    want = brute_components(copies, k)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_odd_tables(spark):
    rows = [(7, "a b c d e f", "s"), (7, "a b c d e f", "s"), (7, "q r s t u v", "s"), (2, "q r s t u v", "s"), (None, "a b c d e f", "s"), (5, None, "s"), (6, "", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(df, 4).collect())
    assert got == [("2", 3, "2", True), ("5", 0, "5", True), ("6", 0, "6", True), ("7", 3, "2", False), ("7", 3, "2", False), ("7", 3, "2", False), ("None", 3, "None", True)]
    assert minhash.near_duplicates(df.limit(0), 4).count() == 0
    assert minhash.stage(spark, df, SF).columns == df.columns
    assert sorted(str(r["doc_id"]) for r in minhash.stage(spark, df, SF).collect()) == ["2", "5", "6", "None"]


def test_near_duplicates_of_very_long_texts(spark):
    """Sets that move in pieces, also where two texts are cut into different numbers of them."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(33_000)]
    texts = [" ".join(words), " ".join(words[:28_000]), varied(rng, words, 100), " ".join(words[:21_000]), varied(rng, words, 4000), " ".join(words[::-1]), "short one here now"]
    rows = list(enumerate(texts))
    sizes = [len(minhash.pieces(minhash.shingles(t, 4))) for t in texts]
    assert sizes[0] == 16 and sizes[1] == 8 and sizes[-1] == 1
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == brute_components(rows, 4) and got[1] == 0 and got[3] == 3


def test_pieces_hold_a_set_once():
    s = np.unique(np.random.default_rng(1).integers(0, 2**64, 50_000, dtype=np.uint64))
    cut = minhash.pieces(s)
    assert (np.concatenate([x for _, _, x in cut]) == s).all() and all((x >> np.uint64(64 - b) == i).all() for b, i, x in cut)
    assert max(len(x) for _, _, x in cut) < 2 * minhash.PIECE and minhash.pieces(s[:0])[0][:2] == (0, 0)


def test_last_round_leaves_no_pair_of_a_crowded_region():
    """All pairs of two components go to verification, down to four standard deviations below the threshold."""
    rng = np.random.default_rng(3)
    n, base = 40, rng.integers(0, 256, minhash.SKETCH, dtype=np.uint8)
    sketch = np.tile(base, (n, 1))
    for r in range(n):  # alike to some 0.75 by twos
        at = rng.choice(np.arange(64, minhash.SKETCH), 68, replace=False)
        sketch[r, at] = rng.integers(0, 256, len(at))
    least = 0.8 - 4 * np.sqrt(0.16 / minhash.SKETCH)
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if a // 2 != b // 2 and (sketch[a] == sketch[b]).mean() >= least}
    key = bytes(4 * minhash.HEAD + minhash.DEEP)
    rows = pd.DataFrame({"tree": 0, "key": [key] * n, "doc_id": range(n), "n": 100, "comp": [i // 2 for i in range(n)], "sketch": [x.tobytes() for x in sketch]})
    got = pd.concat(minhash._crowd_pairs(80, True)(iter([rows])))
    assert len(want) > 100 and set(map(tuple, got[["a", "b"]].to_numpy().tolist())) == want


def test_components_of_long_chains(spark):
    n = 300
    links = spark.createDataFrame([((i * 37) % n, (i + 1) * 37 % n) for i in range(n - 1)] + [(1000, 1001)], "a long, b long").repartition(9)
    got = {r["node"]: r["comp"] for r in minhash.components(links).collect()}
    assert {got[i] for i in range(n)} == {0} and got[1001] == 1000


def test_shingles_part_words_as_stated():
    assert len(minhash.shingles("a b c", 4)) == 1 and len(minhash.shingles("É é", 1)) == 2 and len(minhash.shingles("A a", 1)) == 1


def brute_lines(rows, ratio, confidence):
    first = {(h, t or "") for _, h, t in rows}
    pages = collections.Counter(h for h, _ in first)
    n = collections.Counter((h, x) for h, t in first for x in set(t.split("\n")) if x.strip(" \t\n\x0b\x0c\r"))

    def frequent(h, line):
        x, m = n[h, line] - 1, pages[h] - 1
        if not x or x <= ratio * m:
            return False
        kl = x * math.log(x / (m * ratio)) + ((m - x) * math.log((m - x) / (m * (1 - ratio))) if x < m else 0)
        return math.exp(-kl) <= 1 - confidence

    out = []
    for i, h, t in rows:
        drop = {x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r") and frequent(h, x)}
        out.append((i, t if t is None or not drop else "\n".join(x for x in t.split("\n") if x not in drop)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    rows = [(i, "a" if i % 3 else None, f"menu\nbody {i}\n\n  \nfoot {i % 2}\nmenu") for i in range(40)] + [(90, "b", "menu\nx"), (91, "a", "menu\nmenu"), (92, "a", None), (93, "a", ""), (91, "a", "menu\nmenu")]
    rows += [(200 + i, "c", f"a passage\nof two lines {i // 300}") for i in range(600)] + [(800 + i, "c", f"note {i}\nshared {i // 4}") for i in range(60)]
    rows.append((94, "long", "\n".join(f"line {i % 2000}" for i in range(50_000))))
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("_n", F.lit(1)).withColumn("_host", F.lit("h")).withColumn("a.b", F.lit("clash"))
    gone = 0
    for ratio, confidence in ((0.3, 0.995), (0.6, 0), (0.99, 0.5), (0.01, 0), (0.01, 0.995), (0.05, 0.6)):
        got = linedup.dedup_lines(df, ratio=ratio, confidence=confidence)
        assert got.columns == df.columns
        got = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
        assert got == brute_lines(rows, ratio, confidence)
        gone += sum(len(a or "") < len(b or "") for (_, a), (_, b) in zip(got, sorted(((i, t) for i, _, t in rows), key=repr)))
    assert gone
    assert linedup.dedup_lines(df.limit(0)).count() == 0
    for wrong in ({"ratio": 0}, {"confidence": 1}):
        with pytest.raises(ValueError):
            linedup.dedup_lines(df, **wrong)


def test_line_dedup_leaves_small_hosts_and_copies(spark):
    """Hosts of 1 to 99 unlike pages, and of any number of copies of a few pages, lose nothing; a menu goes from all."""
    unlike = [(h * 1000 + i, f"u{h}", f"head {h} {i}\nbody {i}") for h in (1, 2, 3, 50, 99) for i in range(h)]
    copied = [(10**6 + h * 1000 + i, f"k{h}", f"one\npage {i % 2}") for h in (2, 40, 700) for i in range(h)]
    menu = [(2 * 10**6 + h * 1000 + i, f"m{h}", f"menu\nbody {i}") for h in (3, 20, 300) for i in range(h)]
    df = spark.createDataFrame(unlike + copied + menu, "doc_id long, source string, text string")
    got = {r["doc_id"]: r["text"] for r in linedup.dedup_lines(df).collect()}
    assert all(got[i] == t for i, _, t in unlike + copied)
    assert all(got[i] == t.split("\n")[1] for i, _, t in menu)


def check_shards(rows, n, shards=16):
    assert len(rows) == n
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_shards(spark):
    rows = [(i, "t" * (i % 7)) for i in range(500)] + [(42, "hot")] * 300 + [(None, None), (1, None), (9, "é" * 3_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = sharding.shard(df, block_rows=50).collect()
    check_shards(got, len(rows))
    assert {r["size"] for r in got if r["text_crc32"] is None} == {1} and max(r["size"] for r in got) == 6_000_001
    assert sharding.shard(df.limit(0)).count() == 0
    check_shards(sharding.shard(df.limit(5)).collect(), 5)
    again = sharding.shard(df.repartition(5), block_rows=50).collect()
    place = lambda x: collections.Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in x if r["doc_id"] != 42)
    assert place(got) == place(again)


def test_shards_do_not_depend_on_partitions(spark):
    """Many full cells, a hot key and a hot row: equal shards and slots under any partitioning."""
    rows = [(i, f"t{i % 9}") for i in range(3000)] + [(7, f"x{i}") for i in range(400)] + [(8, "same")] * 500 + [(None, None)] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    for parts in (1, 3, 8):
        got = sharding.shard(df.repartition(parts, F.rand(parts)), cells=4, block_rows=50).collect()
        check_shards(got, len(rows))
        seen.append(sorted((repr((r["doc_id"], r["size"], r["text_crc32"])), r["shard"], r["slot"]) for r in got))
    assert seen[0] == seen[1] == seen[2]


def test_ring_plan_like_one_key_at_a_time():
    """Keys one by one, in rounds of one step clockwise, fill the same stretches."""
    nodes = sharding.ring(5, 8, 64)
    counts = {c: (c * 7) % 11 for c in range(64)}
    total = sum(counts.values())
    bounds = [total // 5 + (s < total % 5) for s in range(5)]
    got = collections.defaultdict(dict)
    for cell, lo, hi, shard, base in sharding.plan(counts, bounds, nodes):
        for r in range(lo, hi):
            got[cell][r] = (shard, base + r - lo)
    first = lambda c: next((i for i, (p, _) in enumerate(nodes) if p >= c), 0)
    room, used, want = list(bounds), [0] * 5, collections.defaultdict(dict)
    for step in range(len(nodes)):
        for c in range(64):
            for r in range(counts[c]):
                s = nodes[(first(c) + step) % len(nodes)][1]
                if r not in want[c] and room[s]:
                    room[s] -= 1
                    want[c][r] = (s, used[s])
                    used[s] += 1
    assert got == {c: v for c, v in want.items() if v}


def test_few_keys_move_when_a_shard_is_added(spark):
    df = spark.range(4000).selectExpr("id doc_id", "'x' text")
    one = {r["doc_id"]: r["shard"] for r in sharding.shard(df, 8, epsilon=0.25).collect()}
    two = {r["doc_id"]: r["shard"] for r in sharding.shard(df, 9, epsilon=0.25).collect()}
    assert max(collections.Counter(one.values()).values()) <= 625
    assert sum(one[i] != two[i] for i in one) < 0.4 * len(one)


PAGES = [(3, "http://a/3", "x" * 150), (1, "http://a/1", "x" * 150), (2, None, "short"), (4, "http://a/\r\n4%0A", "short"), (5, "u", None), (6, "u", ""), (None, "u", "x" * 150), (8, "é", "é\r\n\r\nWARC/1.1\r\n" * 30)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("first", F.lit("clash")).repartition(3)
    path = common.new_path(spark, "test-warc")
    warc.write(df, path)
    got = {r["page_id"]: r for r in warc.read(spark, path, "bytes").collect()}
    assert len(got) == len(PAGES)
    for i, url, html in PAGES:
        payload = (html or "").encode()
        r = got[i]
        assert r["target_uri"] == url and r["payload_bytes"] == len(payload) and r["payload_digest"] == hashlib.sha256(payload).hexdigest()
        revisit = i in (3, None)
        assert r["record_type"] == ("revisit" if revisit else "response") and r["refers_to"] == (1 if revisit else None)
        assert bytes(r["payload"]) == (b"" if revisit else payload)
    assert [r["page_id"] for r in warc.read(spark, path, "none").filter("record_type = 'revisit' and page_id > 1").collect()] == [3]
    assert warc.read(spark, path).filter("target_uri like 'http://a/%' and payload_bytes > 100").count() == 2


def test_warc_pushes_header_predicates_down(spark):
    """A damaged payload is an error for whoever reads it, and for nobody else."""
    import pathlib

    path = common.new_path(spark, "test-warc")
    warc.write(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(1), path)
    folder = pathlib.Path(path.removeprefix("file:"))
    (archive,) = folder.glob("part-*")
    data = bytearray(archive.read_bytes())
    at = 0
    while at < len(data):  # each record has two members; the second holds the content
        head = zlib.decompressobj(31)
        text = head.decompress(bytes(data[at:]))
        content = len(data) - len(head.unused_data)
        length = int.from_bytes(data[at + 16 : at + 24], "little")
        if b"WARC-Type: response" in text:
            data[content + 12] ^= 0xFF
        at = content + length
    archive.write_bytes(bytes(data))
    read = warc.read(spark, path)
    assert read.filter("record_type = 'revisit'").count() == 2
    assert read.filter("page_id in (3) and target_uri like 'http%'").count() == 1
    with pytest.raises(Exception, match="is damaged"):
        read.filter("payload_bytes >= 0").collect()


def test_warc_reads_what_others_wrote(tmp_path, spark):
    import base64
    import gzip

    def rec(name, uri, body, digest):
        block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: {name}\r\nWARC-Target-URI: {uri}\r\nWARC-Payload-Digest: {digest}\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    data = rec("<urn:uuid:1>", "http://a/x%20y%0Az", b"one", sha1(b"one")) + rec("<urn:x-page:abc>", "http://b/%25", b"two", sha1(b"other")) + rec("<urn:x-page:7>", "u", b"", "blake3:zz")
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data))
    uri = f"file://{tmp_path}"
    got = warc.read(spark, uri).collect()
    assert sorted((str(r["page_id"]), r["target_uri"], r["payload_bytes"], r["payload_digest"]) for r in got) == sorted(
        [("None", "http://a/x%20y%0Az", 3, hashlib.sha256(b"one").hexdigest()), ("None", "http://b/%25", 3, hashlib.sha256(b"two").hexdigest()), ("7", "u", 0, hashlib.sha256(b"").hexdigest())] * 2
    )
    stated = warc.read(spark, uri, "none").filter("target_uri = 'u' or target_uri like 'http://a%'").collect()
    assert {(r["payload_bytes"], r["payload_digest"]) for r in stated} == {(None, sha1(b"one")), (None, "blake3:zz")}
    with pytest.raises(Exception, match="does not match"):
        spark.read.format("warc").option("verify", "all").load(uri).collect()


def test_warc_large_archives_are_read_in_parts(spark):
    """Every record once, whatever the parts; leftovers of lost tasks are not read."""
    import pathlib

    path = common.new_path(spark, "test-warc")
    df = spark.range(400).selectExpr("id page_id", "'u' url", "repeat(uuid(), 20) html")
    warc.register(spark)
    warc.planned(df.repartition(1)).write.format("warc").mode("append").option("splitBytes", 2000).save(path)
    read = spark.read.format("warc").option("partitionBytes", 9000).load(path)
    assert read.rdd.getNumPartitions() > 10 and sorted(r["page_id"] for r in read.collect()) == list(range(400))
    folder = pathlib.Path(path.removeprefix("file:"))
    (archive,) = folder.glob("part-*")
    (folder / f"part-{'0' * 32}.warc.gz").write_bytes(archive.read_bytes())
    assert read.count() == 400
    warc.write(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 400 + len(PAGES)


def test_warc_long_and_repeated_pages(spark):
    """A page of megabytes goes whole; rows that repeat have a record each, all responses of their page_id."""
    long = "".join(f"<p>{i}</p>" for i in range(400_000))
    rows = [(1, "u", long), (2, "u", long), (5, "v", "y" * 200), (5, "v", "y" * 200), (6, "w", "y" * 200)]
    path = common.new_path(spark, "test-warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(spark, path).collect())
    assert got == [(1, len(long), "response", None), (2, len(long), "revisit", 1), (5, 200, "response", None), (5, 200, "response", None), (6, 200, "revisit", 5)]


def test_warc_empty(spark):
    path = common.new_path(spark, "test-warc")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


def test_warc_skips_payloads_and_reads_plain_archives(tmp_path):
    import gzip

    rec = warc.record(1, "u", b"p" * 100, "response", None, 100, hashlib.sha256(b"p" * 100).hexdigest(), "2000-01-01T00:00:00Z")
    plain = gzip.decompress(rec)
    broken = bytearray(rec * 2)
    for data in (bytes(broken), plain * 2, gzip.compress(plain) * 2):
        (tmp_path / "a").write_bytes(data)
        with open(tmp_path / "a", "rb") as f:
            assert [(v["page_id"], b) for v, _, b in warc.records(f, lambda v: True, True)] == [(1, b"p" * 100)] * 2
        with open(tmp_path / "a", "rb") as f:
            assert list(warc.records(f, lambda v: False, True)) == []
    head = len(rec) - int.from_bytes(rec[16:24], "little")
    broken[head + 12] ^= 0xFF  # the first payload is damaged: only who reads it notices
    (tmp_path / "a").write_bytes(bytes(broken))
    with open(tmp_path / "a", "rb") as f:
        assert len(list(warc.records(f, lambda v: True, False))) == 2


def test_decontamination_small(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, f"intro {item} outro"), (2, item.upper()), (3, "one two three four five and other words"), (4, item.replace("twelve", "zzz")), (5, None), (6, ""), (None, item), (7, "Tiny Item"), (8, "tiny"), (2, "again"), (9, "a b " * 200)]
    bench = [(10, item), (11, "tiny item"), (12, None), (13, ""), (None, item), (14, "a b a b a b a b")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 3), r["start"]) for r in decontaminate.matches(d, b).collect()}
    # document 4 shares 7 of 9 shingles, which is less than 0.8
    assert got == {(1, 10): (1.0, 1), (2, 10): (1.0, 0), (7, 11): (1.0, 0), (9, 14): (1.0, 0)}
    assert sorted(r["doc_id"] or -1 for r in d.join(decontaminate.matches(d, b).select("doc_id").distinct(), "doc_id", "left_anti").collect()) == [-1, 3, 4, 5, 6, 8]
    assert decontaminate.matches(d, b.limit(0)).count() == 0 and decontaminate.matches(d.limit(0), b).count() == 0
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(d, b, most_broadcast=0).collect()} == set(got)


def test_decontamination_ties_repeats_and_long_texts(spark):
    item, other = " ".join(f"i{j}" for j in range(40)), " ".join(f"o{j}" for j in range(40))
    fill = " ".join(f"w{j % 9000}" for j in range(60_000))
    docs = [(1, f"{item} x {item}"), (1, f"{item} x {item}"), (2, f"{fill} {item} {fill}"), (3, f"{other} y {item}"), (4, f"{item[:-3]} z {item}")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("start", F.lit(-1))
    b = spark.createDataFrame([(10, item), (11, item), (12, other)], "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = sorted((r["doc_id"], r["item_id"], r["similarity"], r["start"]) for r in decontaminate.matches(d, b).collect())
    assert got == [(1, 10, 1.0, 0), (1, 11, 1.0, 0), (2, 10, 1.0, 60_000), (2, 11, 1.0, 60_000), (3, 10, 1.0, 41), (3, 11, 1.0, 41), (3, 12, 1.0, 0), (4, 10, 1.0, 40), (4, 11, 1.0, 40)]


def test_decontamination_like_all_windows(spark):
    """Every window of every document, also where the parts of an item come in another order."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    items = {i: word(n) for i, n in enumerate((40, 50, 59, 12, 40, 5))}
    items[6] = ["a", "b"] * 15 + word(10)
    docs = []
    for w in items.values():
        h = len(w) // 2
        for x in (w, w[h:] + w[:h], w[1:], w[:-1], w[:-1] + word(1), w[3:] + w[:3], w[:h] + word(1) + w[h:]):
            docs += [x, x + word(30), word(30) + x, word(1) + x + word(20), word(25) + x + word(25) + w]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    bags = lambda w, k: collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    want = {}
    for i, w in enumerate(docs):
        for j, v in items.items():
            k, alike = min(5, len(v)), {}
            for start in range(max(0, len(w) - len(v)) + 1):
                x, y = bags(w[start : start + len(v)], k), bags(v, k)
                alike[start] = (x & y).total() / (x | y).total()
            if (best := max(alike.values())) >= 0.8:
                want[i, j] = round(best, 6), {s for s in alike if alike[s] == best}
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 6), r["start"]) for r in decontaminate.matches(d, b).collect()}
    assert {p: s for p, (s, _) in got.items()} == {p: s for p, (s, _) in want.items()}
    assert all(start in want[p][1] for p, (_, start) in got.items())
    assert all((35 * i + 7, i) in got for i in range(3))  # the halves swapped


def test_simhash_blocks_find_all_within_the_radius(spark):
    """Against all pairs; every pair within the radius once, and few of the others ever meet."""
    rng = np.random.default_rng(1)
    bits = lambda: rng.integers(0, 2, 128)
    long = lambda x: int(np.packbits(x, bitorder="little").view(np.int64)[0])
    base = [bits() for _ in range(60)]
    left = []
    for i in range(240):
        x = base[i % 60].copy()
        x[rng.choice(128, i % 60, replace=False)] ^= 1
        left.append(x)
    rows = lambda xs: [(40, i, (long(x[:64]), long(x[64:]))) for i, x in enumerate(xs)]
    a = spark.createDataFrame(rows(left), "n int, i long, fp struct<a: long, b: long>")
    b = spark.createDataFrame(rows(base), "n int, item_id long, item_fp struct<a: long, b: long>")
    for n, radius in ((13, 38), (4, 3), (13, 25)):
        assert sum(w for _, w in decontaminate.blocks(n)) == 128
        got = collections.Counter((r["i"], r["item_id"]) for r in decontaminate.near_prints(a, b, radius, n=n).collect())
        want = {(i, j) for i, x in enumerate(left) for j, y in enumerate(base) if (x != y).sum() <= radius}
        assert set(got) == want and set(got.values()) == {1}
    meet = decontaminate.in_blocks(a, "fp").join(decontaminate.in_blocks(b, "item_fp", 2), ["n", "block", "value"])
    assert meet.filter("i % 60 <> item_id").count() < 1.1 * 240 * 59
    fs = [[3, 5, 5], [-1], [1 << 62, 7, -9]]
    got = [r["s"] for r in spark.createDataFrame([(f,) for f in fs], "f array<bigint>").select(decontaminate.simhash(F.col("f"))["a"].alias("s")).collect()]
    bit = lambda v, b: (v >> b) & 1
    for f, s in zip(fs, got, strict=True):
        assert [bit(s, b) for b in range(64)] == [int(2 * sum(bit(v, b) for v in f) > len(f)) for b in range(64)]


def test_steps_show_every_window_that_reaches_the_threshold():
    """At each step, each phase of the window and each choice of the places it misses, if these are hit first."""
    for n, k in [(5, 5), (9, 5), (14, 5), (23, 5), (59, 5), (3, 3)]:
        step = decontaminate.step_of([(n, k)], 0.8)
        u = n - k + 1
        for t in range(1, u + 1):
            least = next((m for m in range(t + 1) if m / (t + u - m) >= 0.8 - 1e-9), None)
            if least is not None:
                assert min(len(range(-p % step, t, step)) for p in range(step)) > t - least
    assert decontaminate.step_of([(14, 5), (59, 5)], 0.8) > 3


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, con, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).fetchdf()
    rows = lambda f: sorted(repr(tuple(None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v for v in r)) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_op1_like_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: r["component_id"] for r in minhash.op1_near_dedup(spark, SF).collect()}
    assert got == brute_components(rows, 4)


def test_op3(spark):
    got = sharding.op3_shards(spark, SF).collect()
    check_shards(got, spark.read.parquet(f"{SF}/documents.parquet").count())
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_op3_like_a_ring_walked_key_by_key(spark):
    """Size, checksum, shard and slot of every row of the table, from a ring on which one key after the other is put."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.xxhash64(F.lit(0), F.col("doc_id").cast("long")).alias("h")).collect()
    got = {r["doc_id"]: (r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.op3_shards(spark, SF).collect()}
    assert len(got) == len(docs)
    cells, shards, n = 4096, 16, len(docs)
    bound = [n // shards + (s < n % shards) for s in range(shards)]
    nodes = sorted(
        (int.from_bytes(hashlib.blake2b(f"0:{s}:{v}".encode(), digest_size=8).digest(), "big") % cells, int.from_bytes(hashlib.blake2b(f"0:{s}:{v}".encode(), digest_size=8).digest(), "big"), s)
        for s in range(shards) for v in range(64)
    )
    used, want = [0] * shards, {}
    # rows at one position go on together: those that a node has no room for are next at the following node
    waiting = collections.defaultdict(list)
    for r in sorted(docs, key=lambda r: (r["h"] % cells, r["h"], r["doc_id"])):
        waiting[r["h"] % cells].append(r)
    for step in range(len(nodes)):
        for cell in sorted(waiting):
            first = next((i for i, (p, _, _) in enumerate(nodes) if p >= cell), 0)
            s = nodes[(first + step) % len(nodes)][2]
            while waiting[cell] and used[s] < bound[s]:
                r = waiting[cell].pop(0)
                data = None if r["text"] is None else r["text"].encode()
                want[r["doc_id"]] = (len(data or b"") + 1, None if data is None else zlib.crc32(data), s, used[s])
                used[s] += 1
    assert got == want


def test_pipeline(spark):
    """Each stage against its brute-force counterpart on its own input; the last row by row with the library."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = common.staged(function(spark, docs, SF), "t")
        assert out.columns == columns
        seen[name] = (docs.collect(), out.collect())
        docs = out
    before, after = seen["toxicity"]
    kept = {r["doc_id"] for r in after}
    bad = "loser idiot pathetic scum worthless moron trash clown disgusting stupid".split()
    said = lambda t: set(t.lower().replace(",", " ").replace(".", " ").split()) & set(bad)
    clean = [r for r in before if not said(r["text"])]
    assert all(r["doc_id"] not in kept for r in before if len(said(r["text"])) >= 2) and sum(r["doc_id"] in kept for r in clean) > 0.9 * len(clean)
    before, after = seen["line_dedup"]
    assert sorted(((r["doc_id"], r["text"]) for r in after), key=repr) == brute_lines([(r["doc_id"], r["source"], r["text"]) for r in before], 0.01, 5)
    before, after = seen["near_dedup"]
    want = brute_components([(r["doc_id"], r["text"]) for r in before], 5)
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, c in want.items() if i == c)
    before, after = seen["decontamination"]
    items = [r["text"].lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = lambda t: any(f" {' '.join(i)} " in f" {' '.join(t.lower().split())} " for i in items)
    left = {r["doc_id"] for r in after}
    assert all(r["doc_id"] not in left for r in before if whole(r["text"]))
    shown = {" ".join(i[j : j + 5]) for i in items for j in range(len(i) - 4)}
    touched = lambda t: any(" ".join(w[j : j + 5]) in shown for w in [t.lower().split()] for j in range(len(w) - 4))
    assert all(r["doc_id"] in left for r in before if not touched(r["text"]))
    u = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r["token_ids"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {r["doc_id"]: u.encode(r["text"], add_special_tokens=False).ids for r in after}


def test_planned_sizes_of_archives(monkeypatch, tmp_path):
    """Splits of an archive that stand together are one stretch, and count once in what a partition holds."""
    mb = 1 << 20
    monkeypatch.setattr(warc, "committed", lambda *_: [("a", 160 * mb, [16 * mb * i for i in range(1, 10)]), ("b", 100 * mb, []), ("c", 5 * mb, [])])
    reader = warc.WarcReader({"path": str(tmp_path), "partitionBytes": str(64 * mb)}, None)
    planned = [[(p, a // mb, b // mb) for p, a, b in x.parts] for x in reader.partitions()]
    assert planned == [[("a", 0, 64)], [("a", 64, 128)], [("a", 128, 160)], [("b", 0, 100)], [("c", 0, 5)]]
