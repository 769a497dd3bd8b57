import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm.language_id import Automaton, identify_languages, learn, phrases, training_sample

TRAIN = [("a", "abba cab abacus"), ("b", "xyzzy zyx yx")] * 3


def brute_phrases(text, source):
    """Greedy longest substrings of source."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in source:
            j += 1
        n, i = n + 1, j
    return n


@pytest.mark.parametrize("seed", range(6))
def test_phrases_are_longest_matches(seed):
    rng = np.random.default_rng(seed)
    source = "".join(rng.choice(list("abc"), 200)) if seed < 4 else "abc" * 60 + "".join(rng.choice(list("abc"), 20))
    alphabet, _, (go,) = learn([("x", source)])
    texts = ["".join(rng.choice(list("abcd"), n)) for n in (0, 1, 5, 60, 0, 300, 2000)] + ["abc" * 200, "bca" * 50 + "d" + "abc" * 99, "d" * 70]
    s = alphabet.symbols(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32))
    row = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for stretch in (4, 16, 256, 10_000):
        assert phrases(s, row, go, stretch).tolist() == [brute_phrases(t, source) for t in texts]


def test_sparse_edges_equal_a_table():
    rng = np.random.default_rng(8)
    source, text = rng.integers(0, 90, 400), rng.integers(0, 100, 3000)
    wide, narrow = Automaton(source, 100), Automaton(source, 100, dense=3)
    assert len(narrow.edges) and phrases(text, np.array([0, 3000]), wide).tolist() == phrases(text, np.array([0, 3000]), narrow).tolist()


PASSAGES = {
    "zh": "今天天气很好，我们一起去公园散步。孩子们在草地上玩耍，老人坐在树下聊天。河边的柳树随风摇动。",
    "ja": "今日は天気がとても良いので、みんなで公園へ散歩に行きました。子供たちは芝生で遊んでいます。",
    "ko": "오늘은 날씨가 매우 좋아서 우리는 함께 공원으로 산책을 갔습니다. 아이들은 잔디밭에서 놀고 있습니다.",
    "ru": "сегодня очень хорошая погода, и мы вместе пошли гулять в парк. дети играют на траве у реки.",
    "uk": "сьогодні дуже гарна погода, і ми разом пішли гуляти в парк. діти грають на траві біля річки.",
    "el": "σήμερα ο καιρός είναι πολύ καλός και πήγαμε όλοι μαζί βόλτα στο πάρκο δίπλα στο ποτάμι.",
    "ar": "الطقس جميل جدا اليوم وذهبنا معا للتنزه في الحديقة حيث يلعب الأطفال على العشب بجانب النهر.",
    "th": "วันนี้อากาศดีมาก พวกเราจึงไปเดินเล่นที่สวนสาธารณะด้วยกัน เด็กๆ กำลังเล่นอยู่บนสนามหญ้า",
}
HELD = {"zh": "我们今天去公园玩耍。", "ja": "子供たちは公園で遊んでいました。", "ko": "우리는 오늘 공원에서 놀았습니다.", "ru": "мы сегодня гуляли у реки, погода хорошая", "uk": "ми сьогодні гуляли біля річки, погода гарна", "el": "πήγαμε στο ποτάμι σήμερα", "ar": "ذهبنا اليوم إلى النهر", "th": "เราไปเล่นที่สวนวันนี้"}


def test_scripts_are_told_apart(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(PASSAGES.items())] + [(100 + i, t, None) for i, t in enumerate(HELD.values())]
    got = {r.doc_id: r.lang_pred for r in identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[100 + i] for i in range(len(HELD))] == list(HELD)


def test_query_equals_brute_force(spark, sf):
    """op10 over a small table: each prediction is that of plain parses of the whole text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000").limit(40)
    train = F.col("doc_id") % 3 > 0
    samples = training_sample(docs, "doc_id", "text", "lang", train, 8, 200)
    kept = lambda t: re.sub(r"[\W\d_]+", " ", (t or "").lower())
    sources = {}
    for lang, text in samples:
        sources.setdefault(lang, []).append(text)
    sources = {k: kept("\n".join(v)) for k, v in sources.items()}
    got = {r.doc_id: r.lang_pred for r in identify_languages(docs, train=train, rows=8, chars=200, stretch=32).collect()}
    for r in docs.collect():
        t = kept(r.text)
        want = min(sorted(sources), key=lambda k: brute_phrases(t, sources[k])) if t.strip() else "und"
        assert got[r.doc_id] == want


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = identify_languages(docs, train=~held).join(docs.where(held), "doc_id")
    n, right = got.count(), got.where("lang = lang_pred").count()
    assert n > 20 and right >= 0.97 * n
    assert got.where("score < 0 or score > 1").count() == 0


def test_edge_rows(spark):
    rows = [(i, t, lang, "z", 1.0) for i, (lang, t) in enumerate(TRAIN)]
    rows += [(100, None, "a", "z", 1.0), (101, "", None, "z", 1.0), (102, "12 !? \n", "b", "z", 1.0), (103, "abba " * 40_000, None, "z", 1.0), (104, "XYZZY", None, "z", 1.0), (104, "XYZZY", None, "z", 1.0), (105, "日本", None, "z", 1.0), (None, "cab", "a", "z", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, LANG_PRED string, score double")
    got = {}
    for r in identify_languages(df).collect():
        got.setdefault(r.doc_id, []).append(r.lang_pred)
    assert got[100] == got[101] == got[102] == ["und"]
    assert got[103] == ["a"] and got[104] == ["b", "b"] and got[105] != ["und"] and len(got[None]) == 1
    assert identify_languages(df.limit(0)).count() == 0
    assert {r.lang_pred for r in identify_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
