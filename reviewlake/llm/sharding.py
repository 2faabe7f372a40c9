"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

The ring has ``cells`` equal positions. Every shard owns ``vnodes`` positions; a key starts at the first virtual
node at or after its own position. A shard takes no more than its bound; what overflows goes on clockwise, virtual
node by virtual node, to the first shard with room. With ``epsilon=0`` the bounds are n // shards, and one more for
the first n % shards shards, so row counts are at most one apart. With ``epsilon > 0`` the bound is
ceil((1 + epsilon) * n / shards), which moves fewer keys when shards or keys come and go.

How it scales: the driver sees only one count per ring position (``cells`` is a parameter, whatever the input);
it plans which stretch of each position's rows goes to which shard. Rows are numbered in blocks of at most about
``block_rows``, by a hash of their values, so that neither a hot key nor a large shard meets in one task; of rows that
are alike in all values, where there are more of them than that, each block takes any, since they are interchangeable.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common


def ring(n_shards: int, vnodes: int, cells: int, seed: int = 0) -> list[int]:
    """For each of the virtual nodes in ring order, (position, shard); ties in position by hash."""
    at = []
    for shard in range(n_shards):
        for v in range(vnodes):
            h = int.from_bytes(hashlib.blake2b(f"{seed}:{shard}:{v}".encode(), digest_size=8).digest(), "big")
            at.append((h % cells, h, shard))
    return [(position, shard) for position, _, shard in sorted(at)]


def plan(counts: dict[int, int], bounds: list[int], nodes: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Stretches (cell, lo, hi, shard, slot of lo): rows lo <= rank < hi of a cell go to the shard."""
    room, used = list(bounds), [0] * len(bounds)
    positions = [p for p, _ in nodes]
    first, i = {}, 0
    for cell in sorted(counts):
        while i < len(positions) and positions[i] < cell:
            i += 1
        first[cell] = i % len(nodes)
    left = {cell: (0, n) for cell, n in sorted(counts.items()) if n}
    out = []
    for step in range(len(nodes)):
        if not left:
            break
        rest = {}
        for cell, (lo, n) in left.items():
            shard = nodes[(first[cell] + step) % len(nodes)][1]
            take = min(n, room[shard])
            if take:
                out.append((cell, lo, lo + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
            if n > take:
                rest[cell] = (lo + take, n - take)
        left = rest
    return out


def shard(
    docs: DataFrame,
    n_shards: int = 16,
    vnodes: int = 64,
    cells: int = 4096,
    epsilon: float = 0.0,
    block_rows: int = 50_000,
    seed: int = 0,
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; nothing is dropped, repeated rows each have a slot.

    Null text: size 1, text_crc32 null. Null doc_id: a key like any other. Empty table: no rows. Slots of a shard
    run from 0 without gaps. Rows alike in doc_id, size and text_crc32 are interchangeable; all else is decided by the
    rows, however they are dealt over partitions. Very long texts only count by their bytes. Further columns are not
    looked at.
    """
    spark = docs.sparkSession
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")) + 1).alias("size"),
        F.crc32("text").alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")).alias("h"),
        F.monotonically_increasing_id().alias("rid"),
    ).withColumn("cell", F.pmod(F.col("h"), F.lit(cells)).cast("int"))
    keyed = common.staged(keyed, "ring")
    counts = {r["cell"]: r["n"] for r in keyed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if epsilon:
        bounds = [math.ceil((1 + epsilon) * total / n_shards)] * n_shards
    else:
        bounds = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    stretches = plan(counts, bounds, ring(n_shards, vnodes, cells, seed))
    # at most cells * n_shards rows, by the parameters alone
    stretches = spark.createDataFrame(stretches, "cell int, lo long, hi long, shard int, base long")
    blocks = in_blocks(keyed, {c: -(-n // block_rows) for c, n in counts.items()}, block_rows)
    starts = blocks.groupBy("cell", "block", "salt").agg(F.count("*").alias("n"))
    before = W.partitionBy("cell").orderBy("block", "salt").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select("cell", "block", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("cell", "block", "salt").orderBy("h", "doc_id", "text_crc32", "size", "rid")
    ranked = (
        blocks.withColumn("local", F.row_number().over(within).cast("long") - 1)
        .join(starts, ["cell", "block", "salt"])
        .withColumn("rank", F.col("start") + F.col("local"))
    )
    found = ranked.join(F.broadcast(stretches), "cell").filter("rank >= lo and rank < hi")
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))


def in_blocks(keyed: DataFrame, parts: dict[int, int], block_rows: int) -> DataFrame:
    """``keyed`` with block and salt: its place among the blocks of its cell, by its values; ``parts`` blocks a cell.

    Rows alike in all values, where more than ``block_rows``, follow the other blocks of their cell and have one of
    their own, in which the salt deals them by rid.
    """
    zero = F.lit(0).cast("long")
    cut = [c for c, n in parts.items() if n > 1]
    if not cut:
        return keyed.withColumn("block", zero).withColumn("salt", zero)
    mark = F.xxhash64("doc_id", "text_crc32", "size")
    sizes = keyed.sparkSession.createDataFrame(list(parts.items()), "cell int, parts long")  # at most one row a cell
    marked = keyed.join(F.broadcast(sizes), "cell").withColumn("mark", mark)
    alike = marked.filter("parts > 1").groupBy("cell", "parts", "mark").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows)
    alike = alike.withColumn("own", F.row_number().over(W.partitionBy("cell").orderBy("mark")).cast("long"))
    alike = common.staged(alike.select("cell", "mark", (F.col("parts") + F.col("own")).alias("own"), F.ceil(F.col("n") / F.lit(block_rows)).alias("salts")), "alike")
    dealt = marked.join(common.few(alike), ["cell", "mark"], "left")
    return dealt.withColumn("block", F.coalesce("own", F.pmod("mark", "parts"))).withColumn("salt", F.coalesce(F.pmod(F.xxhash64("rid"), F.col("salts")), zero))


def op3_shards(spark, sf_dir: str) -> DataFrame:
    """All documents into 16 shards whose row counts are at most one apart."""
    out = shard(common.table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
