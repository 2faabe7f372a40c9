"""Queries over whole tables, held against rows that are found in another way than by their SQL."""

import glob
import hashlib
import os

import duckdb
import pytest

from reviewlake import catalog
from reviewlake.operators import patches
from reviewlake.sources import feeds
from reviewlake.sources.feeds import feed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def test_missing_citations_of_every_reply(spark, con):
    sql = f"SELECT review_id, reply_ord, count(*) FILTER (NOT matched) AS n FROM ({catalog.ORACLES['concept_match']}) GROUP BY ALL"
    got = sorted(tuple(r) for r in catalog.QUERIES["missing_citations_anti"](spark, SF).select("review_id", "reply_ord", "n_missing").collect())
    assert got == sorted(con.execute(sql).fetchall())
    assert {r[1] % 5 for r in got} == {0, 1, 2, 3, 4}


def test_patch_lines_of_every_number(spark):
    want = []
    for h in patches.split_hunks(feed(spark, SF, feeds.PATCHES_SPARK)).select("review_id", "hunk_ord", "new_start", "patch").collect():
        at = h["new_start"] or 0
        for line in h["patch"].split("\n")[1:]:
            if not line or line[0] == "\\":
                continue
            if line[0] != "-":
                want.append((h["review_id"], h["hunk_ord"], at, line[0], hashlib.md5(line[1:].encode()).hexdigest()))
                at += 1
    got = [tuple(r) for r in catalog.QUERIES["patch_line_lookup"](spark, SF).select("review_id", "hunk_ord", "new_line", "mark", "line_md5").collect()]
    assert sorted(got) == sorted(want)
    assert {r[2] % 2 for r in got} == {0, 1}
