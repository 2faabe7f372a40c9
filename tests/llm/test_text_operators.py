"""Operators that work row by row: token counts, BPE, personal data, quality, toxicity."""

import functools
import hashlib
import random
import re
from array import array

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewlake.llm import bpe, common, pii, quality, token_count, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, n_words long, score double, x string, spans string, kept boolean, n_tokens int"
ODD = [None, "", "   \n\t", "a", "Z" * 5000, "wórd " * 3000, "tab\tand\x0bvt\x0c", "<|endoftext|>a<|startoftext|>", "ΑΣ Σ. İ", " x y　z", "😀‍👨", "a@b.co 10.0.0.1 card 4111 1111 1111 1111 or +1 (212) 555-0100"]


def table(spark, texts, ids=None):
    rows = [(i, t, 1, 0.5, "x", "s", True, 3) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, CLASH)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, [*ODD, "same", "same"], [*range(len(ODD)), 99, 99])


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(120).collect()]


def test_token_counts_like_the_library(spark, texts):
    t = Tokenizer.from_file(BYTE)
    c = token_count.HeapCounter(BYTE)
    for s in texts + [x or "" for x in ODD]:
        assert c.count(s) == len(t.encode(s, add_special_tokens=False).ids)


@functools.cache
def own_tokenizers():
    return token_count.HeapCounter(BYTE), bpe.RankArrayCodec(WORD)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab zT'sre<|endoftxstar>\n\t\x85 éΣİß漢😀́!#1½"), max_size=40))
def test_tokenizers_on_odd_texts(s):
    counter, codec = own_tokenizers()
    byte, word = Tokenizer.from_file(BYTE) if not hasattr(test_tokenizers_on_odd_texts, "b") else test_tokenizers_on_odd_texts.b, None
    test_tokenizers_on_odd_texts.b = byte
    word = getattr(test_tokenizers_on_odd_texts, "w", None) or Tokenizer.from_file(WORD)
    test_tokenizers_on_odd_texts.w = word
    assert counter.count(s) == len(byte.encode(s, add_special_tokens=False).ids)
    ids = word.encode(s, add_special_tokens=False).ids
    assert list(codec.encode(s)) == ids
    assert codec.decode(ids).decode() == word.decode(ids, skip_special_tokens=False)


def test_small_stores_change_nothing():
    s = " ".join(f"word{i % 50} other{i}" for i in range(400))
    assert token_count.HeapCounter(BYTE, most_words=7).count(s) == token_count.HeapCounter(BYTE).count(s)
    assert bpe.RankArrayCodec(WORD, most_words=7, short=4).encode(s) == bpe.RankArrayCodec(WORD).encode(s)


def test_count_tokens(spark, odd):
    got = token_count.count_tokens(odd, BYTE, limit=1).orderBy("doc_id").collect()
    assert len(got) == len(ODD) + 2 and (got[0]["n_bytes"], got[0]["n_tokens"], got[0]["over_limit"]) == (0, 0, False)
    assert got[5]["n_bytes"] == len(ODD[5].encode())
    assert token_count.count_tokens(odd.limit(0), BYTE).count() == 0


def test_bpe_round_trip(spark, odd, texts):
    u = Tokenizer.from_file(WORD)
    got = bpe.digests(odd, WORD).orderBy("doc_id").collect()
    for r, t in zip(got, [*ODD, "same", "same"], strict=True):
        ids = u.encode(t or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(u.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode(table(spark, texts), WORD)
    decoded = bpe.decode(encoded, WORD).orderBy("doc_id").collect()
    assert [r["decoded"] for r in decoded] == [u.decode(u.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for t in texts]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    ok = {
        "email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda s: 13 <= len(re.sub(r"\D", "", s)) <= 19 and pii.luhn(re.sub(r"\D", "", s)), "phone": lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if ok[k](m.group())]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab@.-+%_ 0123456789()"), max_size=60))
def test_base_spans_like_plain_patterns(s):
    assert pii.base_spans(s) == brute_spans(s)


def test_linear_on_long_runs():
    import time

    began = time.time()
    for s in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "+1(" * 50_000, "1." * 100_000):
        pii.base_spans(s)
    assert time.time() - began < 5


@pytest.fixture(scope="module")
def field():
    return pii.Field()


def test_field_learns_its_rows(field):
    wrong = 0
    for text, spans in pii.pii_examples.parse():
        base, more = pii.tag(field, [text])[0]
        wrong += sorted(spans) != sorted(set(base + more))
    assert wrong <= 2


def test_field_on_rows_it_has_not_seen(field):
    found = lambda t: [(k, t[a:b]) for base, more in pii.tag(field, [t]) for k, a, b in base + more]
    assert found("please call (415) 555-0137 today") == [("phone", "(415) 555-0137")]
    assert found("In 2019 there were 345 of 1200 pages") == []
    assert found("ring 212-555-0188 or 212.555.0188 soon") == [("phone", "212-555-0188"), ("phone", "212.555.0188")]


def test_batches_decode_like_single_rows(field):
    texts = [t for t, _ in pii.pii_examples.parse()] + ["", "x" * 3000 + " 1 " + "y 2 " * 500]
    assert pii.tag(field, texts) == [pii.tag(field, [t])[0] for t in texts]


def test_pii_table(spark, odd, field):
    got = pii.find(odd, field).orderBy("doc_id").collect()
    assert len(got) == len(ODD) + 2
    last = got[len(ODD) - 1]
    assert (last["n_email"], last["n_ip"], last["n_card"], last["n_phone"]) == (1, 1, 1, 1)
    assert got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[0]["spans"] == ""
    base = pii.joined(brute_spans(ODD[-1]))
    assert last["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) <= set(last["spans"].split(","))
    clean = pii.redact(odd, field).filter(f"doc_id = {len(ODD) - 1}").first()["text"]
    assert clean == "<email> <ip> card <card> or <phone>"
    assert pii.find(odd.limit(0), field).count() == 0


def test_lines_without_triggers_give_nothing(spark, field):
    """Whole texts, every line decoded alone, give what the query gives."""
    every = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    every += [planted_text(np.random.default_rng(i))[0] for i in range(60)]
    for text, (base, more) in zip(every, pii.tag(field, every), strict=True):
        want, start = [], 0
        for line in text.split("\n"):
            shapes, at = pii.tokens(line)
            path = field.viterbi([shapes])[0] if shapes else []
            k = 0
            while k < len(path):
                name, j = pii.TAGS[path[k]], k + 1
                while name != "O" and j < len(path) and pii.TAGS[path[j]] == "I-" + name[2:]:
                    j += 1
                a, b = at[k][0], at[j - 1][1]
                if name != "O" and pii.added(name[2:], line[a:b]) and all(start + b <= s or e <= start + a for _, s, e in base):
                    want.append((name[2:], start + a, start + b))
                k = j
            start += len(line) + 1
        assert more == want


def test_viterbi_like_trying_all_tags(field):
    """The best sequence scores as high as the best of all sequences of four tokens."""
    from itertools import product

    step, n = field.step + field.allowed, len(pii.TAGS)
    for text in ("call (212) 5", "a@b.c", "+49 30 x", "10.0.0.1", "4111 1111 -"):
        shapes = pii.tokens(text)[0][:4]
        x, _ = pii._padded([[field.ids.get(s, field.unknown) for s in shapes]], field.pad)
        e = field._emit(x)[0]
        score = lambda y, e=e: step[n, y[0]] + sum(e[i, t] for i, t in enumerate(y)) + sum(step[a, b] for a, b in zip(y, y[1:]))
        best = max(map(score, product(range(n), repeat=len(shapes))))
        assert abs(score([int(t) for t in field.viterbi([shapes])[0]]) - best) < 1e-9


WORDY = "the river was low and nobody came before winter so they left early with what little there was".split()


def planted_text(rng):
    """A text with phones in shapes that no fixed pattern has, and numbers that are none: (text, [(start, end)])."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    yes = [lambda: f"({rng.integers(2, 10)}{d(2)}) {d(3)}-{d(4)}", lambda: f"{rng.integers(2, 10)}{d(2)}-{d(3)}-{d(4)}", lambda: f"{rng.integers(2, 10)}{d(2)}.{d(3)}.{d(4)}"]
    no = [
        lambda: f"{rng.integers(1900, 2030)}", lambda: f"{rng.integers(1, 400)} of {rng.integers(400, 900)}", lambda: f"{rng.integers(1990, 2030)}-0{rng.integers(1, 10)}-1{d(1)}",
        lambda: f"version {rng.integers(1, 9)}.{rng.integers(0, 20)}", lambda: f"pages {rng.integers(1, 99)}-{rng.integers(100, 300)}", lambda: f"{d(1)},{d(3)}.{d(2)}",
        lambda: f"order {rng.integers(1, 9)}{d(5)}", lambda: f"{rng.integers(10, 23)}:{rng.integers(10, 59)}",
    ]
    parts, at, spans = [], 0, []
    for i in range(12):
        words = " ".join(rng.choice(WORDY, int(rng.integers(2, 9))))
        kind = rng.choice(4)
        thing = rng.choice(yes)() if kind == 0 else rng.choice(no)() if kind < 3 else str(rng.choice(WORDY))
        piece = words + " " + thing + ("\n" if rng.random() < 0.2 else " ")
        if kind == 0:
            spans.append((at + len(words) + 1, at + len(words) + 1 + len(thing)))
        parts.append(piece)
        at += len(piece)
    return "".join(parts), spans


def test_added_spans_on_planted_shapes(field):
    """Recall and precision of what the field adds, on contexts and numbers that it has not been trained on."""
    rng = np.random.default_rng(17)
    made = [planted_text(rng) for _ in range(400)]
    hit = n_want = n_got = 0
    for (_, want), (_, more) in zip(made, pii.tag(field, [t for t, _ in made]), strict=True):
        got = {(a, b) for k, a, b in more if k == "phone"}
        hit, n_want, n_got = hit + len(got & set(want)), n_want + len(want), n_got + len(more)
    print(f"recall {hit / n_want:.3f} precision {hit / n_got:.3f} of {n_want}")
    assert n_want > 1000 and hit / n_want > 0.9 and hit / n_got > 0.9


def brute_repeats(words, w=8):
    seen = {}
    for i in range(len(words) - w + 1):
        seen.setdefault(tuple(words[i : i + w]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + w)})


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_repeated_words(words):
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    assert quality.repeated_words(np.array([ids[w] for w in words], dtype=np.int64), len(ids)) == brute_repeats(words)


def test_statistics():
    n, chars, symbols, dup, repeats = quality.statistics("a# b\n\na# b\n \n \nc\x0bd")[:5]
    assert (n, chars, symbols, dup, repeats) == (6, 8, 2, 1, 0)
    assert quality.statistics("")[:5] == (0, 0, 0, 0, 0)


def test_quality_table(spark, odd):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5)] + [(None, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(odd, labels).orderBy("doc_id").collect()
    assert len(got) == len(ODD) + 2 and got[0]["base_failed"] and not got[0]["kept"] and got[5]["base_failed"]
    assert quality.judge(odd.limit(0), labels).count() == 0
    assert quality.judge(odd, labels.limit(0)).count() == len(ODD) + 2


def test_forest_isolates_what_is_odd():
    rng = np.random.default_rng(1)
    f = quality.Forest(rng.normal(size=(400, 3)))
    assert f.score(np.array([[8.0, 8.0, 8.0]]))[0] > f.score(np.zeros((1, 3)))[0] + 0.1


def test_quality_on_labelled_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    got = quality.judge(docs.filter("doc_id < 4000"), labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert got[got.quality == 0].kept.mean() < 0.1
    assert got[(got.quality == 1) & ~got.base_failed].kept.mean() > 0.95


def test_label_model_finds_the_better_voters():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    vote = lambda acc: np.where(rng.random(4000) < acc, np.where(y, 1, -1), np.where(y, -1, 1))
    good, weak = vote(0.95), vote(0.6)
    votes = np.stack([good, weak, weak, vote(0.8), vote(0.85)], axis=1)
    m = toxicity.LabelModel(votes)
    assert m.accuracy[0] > m.accuracy[1] and (1, 2) in m.clusters
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.93


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    got = toxicity.score(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert held[held.toxic == 1].predicted.mean() > 0.8 and held[held.toxic == 0].predicted.mean() < 0.04
    assert got.score.between(0, 1).all() and set(got.columns) >= {"doc_id", "held_out", "score", "predicted"}


def test_toxicity_learns_only_from_training_rows(spark):
    import zlib

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.training_rows(docs, labels, 50).collect()
    assert 0 < len(rows) <= 50 and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 for r in rows)


def test_toxicity_table(spark, odd):
    labels = spark.createDataFrame([(1, 1, 1), (3, 1, 0), (3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(odd, labels).orderBy("doc_id").collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(odd.limit(0), labels).count() == 0
    assert {r["predicted"] for r in toxicity.score(odd, labels.limit(0)).collect()} == {0}
    null_id = table(spark, ["a"], [None])
    assert toxicity.score(null_id, labels).first()["held_out"] is None


def test_results_do_not_depend_on_batches(spark, texts):
    random.seed(2)
    df = table(spark, texts)
    one = token_count.count_tokens(df.repartition(1), BYTE).toPandas().sort_values("doc_id").reset_index(drop=True)
    many = token_count.count_tokens(df.repartition(7), BYTE).toPandas().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(one, many)


def everything(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op4_row_by_row(spark):
    got, texts = pii.op4_pii(spark, SF).collect(), everything(spark)
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        base = brute_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in base) for k in PATTERNS]
        assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert {tuple(map(str, s)) for s in base} <= set(map(tuple, spans)) and len(spans) == len(base) + r["n_added"]


def test_op6_row_by_row(spark):
    got, texts = quality.op6_quality(spark, SF).collect(), everything(spark)
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    space = " \t\n\x0b\x0c\r"
    for r in got:
        t = texts[r["doc_id"]]
        words = [w for w in re.split(f"[{space}]+", t) if w]
        lines = [x for x in t.split("\n") if x.strip(space)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), brute_repeats(words))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 20 or 100 * want[4] > 30 * len(words)) and not (r["base_failed"] and r["kept"])
    fine = [r for r in got if not r["base_failed"]]
    assert max(r["anomaly"] for r in fine if r["kept"]) < min([r["anomaly"] for r in fine if not r["kept"]] or [2])


def test_op7_row_by_row(spark):
    t = Tokenizer.from_file(BYTE)
    got, texts = token_count.op7_token_counts(spark, SF).collect(), everything(spark)
    want = {i: (len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in texts.items()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want and len(got) == len(want)
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)


def test_op9_row_by_row(spark):
    t = Tokenizer.from_file(WORD)
    got, texts = bpe.op9_bpe(spark, SF).collect(), everything(spark)
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        ids = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op10_row_by_row(spark):
    """Every row scored; neither held-out labels nor any column but the text is an input of a score."""
    import zlib

    got, texts = toxicity.op10_toxicity(spark, SF).collect(), everything(spark)
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    held = common.held_out(labels["doc_id"])
    turned = labels.withColumn("toxic", F.when(held, 1 - labels["toxic"]).otherwise(labels["toxic"]))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(1))
    assert {r["doc_id"]: round(r["score"], 9) for r in toxicity.score(other, turned).collect()} == {r["doc_id"]: round(r["score"], 9) for r in got}


def test_very_long_texts(spark, field):
    long = "\n".join(f"word{i % 700} call (212) 555-01{i % 90 + 10} in {i}" for i in range(20_000))
    df = table(spark, [long, "x"])
    t, u = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    assert token_count.count_tokens(df, BYTE).orderBy("doc_id").first()["n_tokens"] == len(t.encode(long, add_special_tokens=False).ids)
    assert bpe.digests(df, WORD).orderBy("doc_id").first()["n_tokens"] == len(u.encode(long, add_special_tokens=False).ids)
    assert pii.find(df, field).orderBy("doc_id").first()["n_added"] == 20_000
    assert quality.measure(df).orderBy("doc_id").first()["n_words"] == 120_000
