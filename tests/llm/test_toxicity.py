from collections import defaultdict
from math import log

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import toxicity as T
from lexmill.llm.queries import fold


def grams(text):
    """[(h, x, h' x)] of a text, written plainly."""
    s, far = [0], [False]
    for letter in text + " ":
        raw = letter.encode()
        if raw[0] >= 0xC6:
            spelling = [1 + raw[0] % 16] + [c for b in raw[1:] for c in (28 + b // 16 % 4, 1 + b % 16)]
        else:
            spelling = [int(T._SYMBOL[b]) for b in raw if T._SYMBOL[b] != 255]
        for c in spelling:
            if c or s[-1]:
                s.append(c)
                far.append(raw[0] >= 0xC6)
    out = []
    for i in range(1, len(s)):
        begin = max(max(k for k in range(i) if s[k] == 0), i - (24 if far[i] or far[i - 1] else 8))
        h = tuple(s[begin:i])
        out.append((h, s[i], ((0, 0, 0) + h)[-3:] + (s[i],)))
    return out


def brute_ratio(train, probe):
    """Mean log ratio of probe under models of [(text, label)]."""
    n = [defaultdict(int), defaultdict(int)]
    for t, y in train:
        for h, x, _ in grams(t):
            n[y][h, x] += 1
    low = {(h, x): g for t, _ in train for h, x, g in grams(t)}
    left = {k: defaultdict(int) for k in (4, 3, 2, 1)}
    for g in low.values():
        left[4][g] += 1
    for k in (3, 2, 1):
        for g in left[k + 1]:
            left[k][g[1:]] += 1

    def shared(g):
        if not g:
            return 1 / 32
        own = [left[len(g)].get(g[:-1] + (x,), 0) for x in range(32)]
        total, met = sum(own), sum(v > 0 for v in own)
        return shared(g[1:]) if not total else max(own[g[-1]] - 0.75, 0) / total + 0.75 * met / total * shared(g[1:])

    def p(c, h, x, g):
        own = [n[c].get((h, k), 0) for k in range(32)]
        total, met = sum(own), sum(v > 0 for v in own)
        return shared(g) if not total else max(own[x] - 0.75, 0) / total + 0.75 * met / total * shared(g)

    gs = grams(probe)
    return sum(log(p(1, *g)) - log(p(0, *g)) for g in gs) / max(len(gs), 1)


def test_ratios_follow_the_formula():
    train = [("the cat sat on the mat", 0), ("a dog, the cat", 0), ("you vile cat scum", 1), ("vile vile  mattresses", 1), ("кот и кошка", 0), ("мерзкий 猫", 1)]
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in train]), pa.array([y for _, y in train])], ["text", "label"])
    names = ["keys", "lows", "counts"]
    keys, lows, n = T._unpacked([sum((r.column(c).to_pylist() for r in T._count(T.BUCKET_BITS)(iter([batch]))), []) for c in names])
    shared = T.shared_model(np.bincount(lows, minlength=1 << 20))
    heads, h, x, value = T.entry_ratios(keys, lows, n[:, :2], shared)
    ratio = T.Ratios(np.concatenate([T.rest_keys(heads), T.pair_keys(h, x)]), value)
    for probe in ("the vile scum", "the cat", "zzz é 9", "x", "mattresses, vilest", "", "кот", "кот собака", "это мерзкий кот", "猫が好き", "дом 猫 the😀"):
        got = T.features(pa.array([probe]), ratio)[0, 0]
        assert abs(got - brute_ratio(train, probe)) < 0.5 / T.SCALE + 1e-9, probe


@pytest.mark.parametrize("letters, joint, least", [("абвгдежзийклмнопрстуфхцчшщъыьэюя", " ", 0.95), ("αβγδεζηθικλμνξοπρστυφχψω", " ", 0.95), ("".join(chr(c) for c in range(0x4E00, 0x4E00 + 400)), "", 0.75)])
def test_other_scripts_are_told_apart(spark, letters, joint, least):
    """Toxic texts hold a few words of their own among common ones, of the same letters; held-out texts are ranked. Without
    spaces histories run across words, so few of them recur in 300 texts."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list(letters), 4 if joint else 2)) for _ in range(220)]
    bad, good = words[:20], words[20:]
    rows = []
    for i in range(400):
        toxic = i % 3 == 0
        own = [*rng.choice(good, 12), *(rng.choice(bad, 4) if toxic else rng.choice(good, 4))]
        rng.shuffle(own)
        rows.append((i, joint.join(own) if joint else " ".join("".join(own[k : k + 4]) for k in range(0, 16, 4)), int(toxic)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 300], "doc_id long, toxic int")
    got = {r.doc_id: r.log_ratio for r in T.toxicity(docs, labels, F.col("doc_id") % 4 == 1).collect()}
    held = [(got[i], y) for i, _, y in rows[300:]]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held for b, y in held if x and not y]
    assert np.mean(pairs) >= least


def test_letters_of_a_script_are_distinct():
    for letters in ("".join(map(chr, range(0x400, 0x460))), "".join(map(chr, range(0x4E00, 0x9FA5))), "".join(map(chr, range(0x900, 0x980)))):
        assert len({tuple(T.spelt(np.frombuffer(c.encode(), np.uint8), np.array([0, len(c.encode())]))[0].tolist()) for c in letters}) == len(letters)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = T.toxicity(docs, labels.where(fold("doc_id", 4) != 2), fold("doc_id", 4) == 1).join(labels.where(fold("doc_id", 4) == 2), "doc_id")
    rows = [(r.toxic, r.score >= 0.3) for r in got.collect()]
    tp = sum(a and b for a, b in rows)
    assert tp >= 0.9 * sum(a for a, _ in rows) and tp >= 0.9 * sum(b for _, b in rows)
    assert sum(a == b for a, b in rows) >= 0.97 * len(rows) > 50


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, "good text here", 5), (2, "vile scum", 5), (3, None, 5), (4, "", 5), (4, "", 5), (None, "scum " * 50_000, 5), (5, "日本 !!", 5)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    got = T.toxicity(docs, labels, F.lit(False)).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[2] > by[1] and by[3] == by[4]
    assert {r.score for r in T.toxicity(docs, labels.limit(0), F.lit(False)).collect()} == {0.0}
    assert T.toxicity(docs.limit(0), labels, F.lit(False)).count() == 0


def test_words_that_begin_alike_keep_their_own_ratios(spark):
    rng = np.random.default_rng(4)
    words = ["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (6000, 7))]
    other, w = words[0][:3] + words[1][3:], words[0]  # words that begin alike
    train = [(other, 1), (w, 0), (w, 0)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(train)] + [(8, w[:6] + "z"), (9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(train)], "doc_id long, toxic int")
    for most in (T.MAX_BROADCAST_ENTRIES, 0):  # broadcast, and joined
        got = {r.doc_id: r.log_ratio for r in T.toxicity(docs, labels, F.lit(False), most=most).collect()}
        assert len(got) == 5
        for i, t in ((0, other), (1, w), (8, w[:6] + "z")):
            assert abs(got[i] - brute_ratio(train, t)) < 0.5 / T.SCALE + 1e-9, (most, t)


def test_joined_model_scores_as_the_broadcast_one(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    one, other = (sorted(map(tuple, T.toxicity(docs, labels, fold("doc_id", 4) == 1, most=m).collect())) for m in (T.MAX_BROADCAST_ENTRIES, 0))
    assert len(one) == docs.count()
    assert [r[0] for r in one] == [r[0] for r in other] and np.allclose([r[1:] for r in one], [r[1:] for r in other], atol=1e-6)
