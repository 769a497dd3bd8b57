import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexmill.llm import phrases
from lexmill.llm.phrases import collocations, merge_paths, pack_trie, unpack_trie

SCHEMA = "doc_id long, text string, lang string, phrase string, N int, word int"


def plain(rows, least=30, most=2000, covered=80):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        told = []
        for p, a in cands.items():
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            longer = [b for q, b in cands.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if all(100 * b < covered * a for b in longer):
                told.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(told)[:most])]
    return sorted(out)


def check(spark, rows, **options):
    df = spark.createDataFrame([(k, t, lang, "x", 1, 2) for k, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations(df, **options).collect())
    assert got == plain(rows, **options)
    return got


def sentence(rng, words, n):
    marks = np.array([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "-", " "])
    return "".join(w + m for w, m in zip(rng.choice(words, n), rng.choice(marks, n), strict=True))


@pytest.mark.parametrize("seed", range(2))
def test_matches_plain(spark, seed):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "of", "a", "é", "ÉA", "new", "york", "1", "\U0001f600", "don't"]
    rows = [(sentence(rng, words, int(rng.integers(0, 60))), ["en", "de", None][k % 3]) for k in range(150)]
    rows += [("In the city of New York the end", "en")] * 40 + [("so a a a a a", "de")] * 30
    got = check(spark, rows, least=12)
    assert {len(r[2].split(" ")) for r in got} == {2, 3, 4} and {"en", "de", "und"} == {r[0] for r in got}
    check(spark, rows, least=12, most=5, covered=50)


def test_edge_rows(spark):
    assert check(spark, [(None, "en"), ("", "en"), (" \t\n", None), ("one", "en")]) == []
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [("a b" * 40, "x"), ("b a, " * 35, "x"), ("q" * 200_000 + " z " * 50, "x")] + [("same row here", "y")] * 30)


def test_shards_parts_and_long_texts_lose_no_phrase(spark, monkeypatch):
    """One text without a mark, cut into many parts and shards: phrases across their borders count."""
    monkeypatch.setattr(phrases, "BLOCK", 64)
    monkeypatch.setattr(phrases, "FLUSH", 150)
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["x", "yy", "zzz", "long" * 40], 4000)), sentence(rng, ["x", "yy", "a"], 900)]
    df = [(t, "en") for t in texts]
    bits = np.full(1 << 24, 255, np.uint8)
    batch = phrases.pa.RecordBatch.from_arrays([phrases.pa.array(texts), phrases.pa.array(["en", "en"])], ["text", "lang"])

    class Held:
        value = bits

    blocks = [b for b in phrases._shard_tries(64, Held)(iter([batch]))]
    assert sum(b.num_rows for b in blocks) > 64
    table = phrases.pa.Table.from_batches(blocks)
    nodes = [r for rng_ in sorted(set(table["range"].to_pylist())) for r in phrases._merge_range(1)(table.filter(phrases.pa.compute.equal(table["range"], rng_))).to_pylist()]
    want = Counter()
    for t, _ in df:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update(k for k in range(1, 5) for _ in range(max(0, len(w) - k + 1)))
            want[0] += len(w)
    got = Counter()
    for n in nodes:
        got[n["len"]] += n["a"]
    assert got == want


def test_trie_round_trip():
    rng = np.random.default_rng(1)
    paths = np.zeros(500, phrases._PATH)
    depth = rng.integers(2, 5, 500)
    for k in range(4):
        paths[f"h{k + 1}"] = np.where(depth > k, rng.integers(1, 4, 500), 0)
    paths["n"] = rng.integers(1, 9, 500)
    merged = merge_paths(paths)
    assert merged["n"].sum() == paths["n"].sum() and len(merged) < 500
    assert (merge_paths(unpack_trie(pack_trie(merged))) == merged).all()


def test_words_of_one_hash_are_an_error():
    rows = phrases.pa.table({"range": [0, 0], "lang": ["x", "x"], "total": [1, 1], "trie": phrases.pa.array([None, None], phrases.pa.binary()), "hash": [[7], [7]], "n": [[1], [1]], "word": [["a"], ["b"]]})
    with pytest.raises(ValueError, match="one hash"):
        phrases._merge_range(1)(rows)
