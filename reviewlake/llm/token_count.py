"""Token counts by byte-pair merging with a heap over a linked list; no identifiers are made.

A word starts as its bytes. The heap holds adjacent pairs by (rank, place); popping the lowest merges the pair in
the linked list and pushes the two new neighbours. Every merge takes one symbol away, so the count of a word is its
bytes less its merges, and that of a text the sum over its words, plus one for each special string in it.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed value: how byte-level tokenizers split text into words before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, rest = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(rest)
            rest += 1
    return out


class HeapCounter(dict):
    """Word to its number of tokens, counted when first asked for; forgotten when there are too many words.

    ``most_words`` and ``longest_kept`` bound the memory of this store, not what is counted.
    """

    def __init__(self, path: str, most_words: int = 300_000, longest_kept: int = 64):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.symbols = byte_symbols()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(SPLIT).findall
        self.most_words, self.longest_kept = most_words, longest_kept

    def __missing__(self, word: str) -> int:
        n = self.merged(word)
        if len(word) <= self.longest_kept:
            if len(self) >= self.most_words:
                self.clear()
            self[word] = n
        return n

    def merged(self, word: str) -> int:
        """Symbols that are left of one word."""
        part = [self.symbols[b] for b in word.encode()]
        n = len(part)
        rank = self.rank
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j < 0 or part[j] != b:
                continue  # one of the two has been merged since
            part[i], part[j] = a + b, ""
            after[i] = k = after[j]
            left -= 1
            if k >= 0:
                before[k] = i
                if (r := rank.get((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[k]))
            if (h := before[i]) >= 0 and (r := rank.get((part[h], part[i]))) is not None:
                heapq.heappush(heap, (r, h, part[h], part[i]))
        return left

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.split_special is None or not any(s in text for s in self.special):
            return sum(map(self.__getitem__, self.words(text)))
        parts = self.split_special.split(text)
        return len(parts) - 1 + sum(map(self.__getitem__, (w for p in parts for w in self.words(p))))


_counters: dict[str, HeapCounter] = {}


@contextmanager
def counter(path: str):
    """The counter of a Python worker and file: its tables are kept for later tasks, its words only for one."""
    if path not in _counters:
        _counters[path] = HeapCounter(path)
    try:
        yield _counters[path]
    finally:
        _counters[path].clear()


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row, in its own task: there is no shuffle.

    Null or empty text: 0 bytes, 0 tokens. Repeated rows come back repeated; a null doc_id stays null. Very long texts
    and words are counted whole. Further columns are not looked at. A count equal to the limit is not over it.
    """

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with counter(path) as c:
            for text in texts:
                yield text.map(c.count).astype("int64")

    return (
        common.documents(docs)
        .select(
            "doc_id",
            F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"),
            tokens(F.coalesce("text", F.lit(""))).alias("n_tokens"),
        )
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents with the byte-level vocabulary of 50k."""
    import public_tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
