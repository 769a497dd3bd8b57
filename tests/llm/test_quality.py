import numpy as np
import pyarrow as pa

from lexmill.llm import quality as Q
from lexmill.llm.queries import QUERIES


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    n, k = 20_000, len(Q.LABELLERS)
    y = rng.random(n) < 0.85
    right = np.linspace(0.75, 0.95, k)
    vote = np.where(rng.random((n, k)) < right, np.where(y, 1, -1)[:, None], np.where(y, -1, 1)[:, None])
    vote[rng.random((n, k)) < 0.3] = 0
    u, c = np.unique(vote, axis=0, return_counts=True)
    m = Q.WeakLabels(u, c.astype(float))
    assert abs(m.good - 0.85) < 0.02
    assert np.allclose(list(m.accuracies().values()), right, atol=0.03)
    assert ((m.posterior(vote) > 0.5) == y).mean() > 0.97


def test_statistics():
    (s, h, rows, _), = Q.statistics(pa.array(["Aa bb bb!!", "", None, "| x"]))
    by = [dict(zip(Q.STATS, r, strict=True)) for r in s]
    assert [b["n_words"] for b in by] == [3, 0, 0, 2]
    assert by[0]["repeats"] == 0 and by[0]["stops"] == 1 / 3 and by[0]["doubled"] == 1 / 3 and by[3]["single"] == 0.5
    assert by[0]["alpha"] == 6 / 8 and by[0]["upper"] == 1 / 6
    (t, *_), = Q.statistics(pa.array(["x x x y"]))
    assert dict(zip(Q.STATS, t[0], strict=True))["repeats"] == 0.5


def plain_votes(text):
    """The labellers, written plainly."""
    raw = text.encode()
    words = raw.translate(bytes(range(256))).split()
    n, shown = len(words), max(sum(b not in b" \t\n\x0b\x0c\r" for b in raw), 1)
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    odd = lambda b: not letter(b) and not 48 <= b <= 57
    letters = sum(map(letter, raw))
    low = [w.lower() for w in words]
    d = max(n, 1)
    s = {
        "n_words": n, "alpha": letters / shown, "marks": sum(b in b"#$%&*<>@[]\\^_`{|}~!=+" for b in raw) / shown, "upper": sum(65 <= b <= 90 for b in raw) / max(letters, 1),
        "distinct": len(set(low)) / max(10 * np.sqrt(n) if n > 100 else n, 1), "repeats": sum(a == b for a, b in zip(low, low[1:])) / d, "word_len": sum(b not in b" \t\n\x0b\x0c\r" for b in raw) / d,
        "stops": sum(w[-1] in b".!?" for w in words) / d, "single": sum(len(w) == 1 and odd(w[0]) for w in words) / d, "doubled": sum(len(w) > 2 and w[-1] == w[-2] and odd(w[-1]) for w in words) / d,
    }
    out = []
    for _, name, low_, high, good_low, good_high in Q.LABELLERS:
        x = s[name]
        bad = n > 0 and ((low_ is not None and x < low_) or (high is not None and x > high))
        good = (good_low is not None or good_high is not None) and (good_low is None or x >= good_low) and (good_high is None or x <= good_high)
        out.append(-1 if bad else int(good))
    return out


def test_query_equals_plain_version(spark, sf):
    """op5: votes and EM over all texts, then each text's posterior; its score from sums over features one by one."""
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    pattern = {i: tuple(plain_votes(t)) for i, t in docs}
    kinds = sorted(set(pattern.values()), key=lambda v: sum((x + 1) * 3**k for k, x in enumerate(v)))
    counts = np.array([sum(p == k for p in pattern.values()) for k in kinds], float)
    weak = Q.WeakLabels(np.array(kinds), counts)
    got = {r.doc_id: r for r in QUERIES["op5_quality"](spark, sf).collect()}
    for i, t in docs:
        want = weak.posterior(np.array([pattern[i]]))[0] if t.split() else 0.0
        assert abs(got[i].posterior - want) < 1e-9, i


def test_sparse_rows_equal_sums():
    column = pa.array(["one two two three", "", "a a a b", None, "x"])
    (batch,) = Q._sparse(iter([pa.RecordBatch.from_arrays([column], ["text"])]))
    ((slot, weight, rows, stats),) = Q.hashed(column)
    for r in range(len(column)):
        want = {}
        for s, v in zip(slot[rows == r].tolist(), weight[rows == r].tolist()):
            want[s] = want.get(s, 0) + v
        found = dict(zip(np.frombuffer(batch.column(1)[r].as_py(), "<i4").tolist(), np.frombuffer(batch.column(2)[r].as_py(), "<f4").tolist()))
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-6 for k in want)


def test_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op5_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").collect()
    bad, good = [r for r in got if not r.quality], [r for r in got if r.quality]
    assert sum(not r.keep for r in bad) >= 0.95 * len(bad) and sum(r.keep for r in good) >= 0.98 * len(good)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "fine words here, and more of them."), (4, "fine words here, and more of them."), (None, "x"), (5, "word " * 50_000)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, SCORE double")
    got = Q.quality(df).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (1, 2, 3)} == {0.0}
    assert Q.quality(df.limit(0)).count() == 0
