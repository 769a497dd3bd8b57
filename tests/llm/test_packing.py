import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexmill.llm.packing import pack, plan_cuts

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length int, OFFSET string"


def round_trip(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA).repartition(2)
    got = pack(df, PATH, **options).collect()
    tok = Tokenizer.from_file(PATH)
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == want.keys()
    for i, rs in by_doc.items():
        rs.sort(key=lambda r: r.start)
        assert [x for r in rs for x in r.ids] == want[i]
        assert [r.start for r in rs] == list(np.cumsum([0] + [r.length for r in rs])[:-1])
        assert {r.doc_tokens for r in rs} == {len(want[i])}
    size = options.get("size", 2048)
    pad = 0
    for rs in by_seq.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == list(np.cumsum([0] + [r.length for r in rs])[:-1])
        total = sum(r.length for r in rs)
        assert total <= size
        pad += size - total
    return pad, sum(map(len, want.values())), len(by_seq)


def test_round_trip_and_padding(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    pad, total, n = round_trip(spark, rows, block=20_000)
    assert pad <= 0.02 * total + 2 * 2048


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "x" * 50_000), (5, "word " * 9000), (6, "A. B! C?\nD"), (7, "naïve Éa ß <|startoftext|> a<|endoftext|>b"), (8, "a b ć ́d")]
    round_trip(spark, rows, size=64, block=500)
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@pytest.mark.parametrize("text", ["word " * 1100, "word " * 2100, "这是一个句子。我们测试它。" * 90, "यह एक वाक्य है। हम आए।" * 60, 'He said "go." Then he left (now.) ' * 200, "long sentence of many words " * 700])
def test_little_padding_without_ends_in_ascii(spark, text):
    rows = spark.createDataFrame([(k, text) for k in range(60)], "doc_id long, text string").coalesce(1)
    got = pack(rows, PATH, keep_ids=False).groupBy("sequence_id").sum("length").collect()
    last = max(got, key=lambda r: r[0])
    assert sum(2048 - r[1] for r in got) - (2048 - last[1]) <= 0.03 * 2048 * len(got)


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_cheapest(seed):
    rng = np.random.default_rng(seed)
    size = 16
    ends = np.cumsum(rng.integers(1, 9, 30))
    pen = np.where(rng.random(30) < 0.4, 0.0, 5.0)
    pos = [0, *ends.tolist()]
    best = [0.0] + [float("inf")] * 30

    for j in range(1, 31):
        for i in range(j):
            n = pos[j] - pos[i]
            if n <= size:
                best[j] = min(best[j], best[i] + size - n + pen[j - 1])
    cuts = plan_cuts(ends, pen, size)
    at, cost = 0, 0.0
    for c in cuts:
        n = int(ends[c]) - at
        assert n <= size
        cost += size - n + pen[c]
        at = int(ends[c])
    assert at == ends[-1] and cost <= best[-1] + 1e-9
