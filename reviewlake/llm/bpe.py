"""BPE encoding and decoding with a contiguous rank array.

A word is held as the boundaries of its parts and, beside each, the rank of the pair that begins there. The lowest
rank is found by a scan; its right boundary is deleted and the two neighbouring ranks are looked up anew. For words,
which are short, this beats any tree. Very long runs of letters take the same rule with a heap of boundaries.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_count import byte_symbols

#: Fixed value: the words of this vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NEVER = 1 << 60


class RankArrayCodec(dict):
    """Word to its ids, found when first asked for; the store is bounded by ``most_words`` and ``longest_kept``."""

    def __init__(self, path: str, most_words: int = 120_000, longest_kept: int = 64, short: int = 256):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        own = {t: t for t in self.vocab}.get  # one string object for each symbol, whichever pairs it is in
        self.rank = {(own(a, a), own(b, b)): i for i, (a, b) in enumerate(pairs)}
        del spec["model"], model  # only what is looked up stays
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words = regex.compile(SPLIT).findall
        self.symbols = byte_symbols()
        self.most_words, self.longest_kept, self.short = most_words, longest_kept, short
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.merged(word)
        if len(word) <= self.longest_kept:
            if len(self) >= self.most_words:
                self.clear()
            self[word] = ids
        return ids

    def merged(self, word: str) -> tuple[int, ...]:
        symbols = self.symbols
        parts = [symbols[b] for b in word.encode()]
        parts[-1] += self.suffix
        if len(parts) > self.short:
            parts = self._long(parts)
        else:
            self._scan(parts)
        # a symbol that the vocabulary lacks is left out, as it has no unknown token
        vocab = self.vocab
        return tuple([vocab[p] for p in parts if p in vocab])

    def _scan(self, parts: list[str]) -> None:
        """Merges in place: parts are what lies between the boundaries, ranks[k] is that of parts k and k + 1."""
        get = self.rank.get
        ranks = [get(pair, NEVER) for pair in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) != NEVER:
            k = ranks.index(low)
            parts[k] += parts[k + 1]
            del parts[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = get((parts[k], parts[k + 1]), NEVER)
            if k:
                ranks[k - 1] = get((parts[k - 1], parts[k]), NEVER)

    def _long(self, parts: list[str]) -> list[str]:
        """The same rule for runs too long to be scanned for each merge: boundaries in a heap, lowest rank first."""
        n, get = len(parts), self.rank.get
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i] = a + b
            alive[j] = False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (i, before[i]):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (r := get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p, ok in zip(parts, alive, strict=True) if ok]

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # letter by letter, without final forms

    def encode(self, text: str | None) -> array:
        if not text:
            return array("I")
        if "<|" not in text:
            return array("I", chain.from_iterable(map(self.__getitem__, self.words(self.normal(text)))))
        out = array("I")
        for p in self.split_special.split(text):
            if p in self.special:
                out.append(self.special[p])
            elif p:
                out.extend(chain.from_iterable(map(self.__getitem__, self.words(self.normal(p)))))
        return out

    def decode(self, ids) -> bytes:
        """The names of the tokens with spaces between, in UTF-8: the file states no other decoder."""
        return b" ".join(map(self.names.__getitem__, ids))


_codecs: dict[str, RankArrayCodec] = {}


@contextmanager
def codec(path: str):
    """The codec of a Python worker and file: its tables are kept for later tasks, its words only for one."""
    if path not in _codecs:
        _codecs[path] = RankArrayCodec(path)
    try:
        yield _codecs[path]
    finally:
        _codecs[path].clear()


def _ints(ids: array) -> np.ndarray:
    """Ids as Arrow takes them without a Python object for each."""
    return np.frombuffer(ids, dtype=np.uint32).astype(np.int32)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and token_ids (array of int) of every row; null or empty text has none. No shuffle."""

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with codec(path) as c:
            for text in texts:
                yield pd.Series([_ints(c.encode(t)) for t in text])

    return common.documents(docs).select("doc_id", ids(F.coalesce("text", F.lit(""))).alias("token_ids"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text (``decoded``) of its token_ids; null or no ids give an empty text."""

    @F.pandas_udf("string")
    def text(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with codec(path) as c:
            for ids in rows:
                yield pd.Series([c.decode([] if x is None else x).decode() for x in ids], dtype=object)

    return encoded.select("doc_id", text("token_ids").alias("decoded"))


def digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, encoded and decoded in one pass over each row.

    Null or empty text: no ids, and the digests of nothing. Repeated rows come back repeated; a null doc_id stays null.
    Very long texts and words are encoded whole. Further columns are not looked at.
    """
    more = ", token_ids array<int>" if with_ids else ""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" + more)
    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with codec(path) as c:
            for text in texts:
                rows = []
                for t in text:
                    ids = c.encode(t)
                    row = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest())
                    rows.append((*row, _ints(ids)) if with_ids else row)
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * with_ids)

    return common.documents(docs).select("doc_id", both(F.coalesce("text", F.lit(""))).alias("x")).select("doc_id", "x.*")


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents encoded with the lower-case word vocabulary of 49k and decoded again."""
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
