from pyspark.sql import functions as F

from lexmill.operators import hybrid

DOCS = "id long, grp string, text string"


def test_vectors_are_signed_counts(spark):
    df = spark.createDataFrame([(1, "a", "bus bus tram"), (2, "a", "tram BUS bus"), (3, None, ""), (4, "a", None)], DOCS)
    got = {r.id: r.vector for r in hybrid.hashed_vectors(df, "id", "text", 8).collect()}
    assert got[1] == got[2] and len(got[1]) == 8 and got[3] is None and got[4] is None
    assert sum(abs(x) for x in got[1]) in (1, 3)  # both words in one slot with opposite signs, or not


def test_states_by_group(spark):
    docs = spark.createDataFrame([(1, "ok", "a b"), (2, "ok", None), (3, "new", "x"), (4, "old", "y"), (5, None, "z"), (6, "thin", "t"), (7, "more", "u")], DOCS)
    index = hybrid.build_index(docs.where("grp is null or grp not in ('new', 'thin')"), "grp", "id", "text")
    index = index.withColumn("digest", F.when(F.col("id") == 4, "other").otherwise(F.col("digest")))
    index = index.unionByName(hybrid.build_index(docs.where("grp = 'thin'"), "grp", "id", "text", 16))
    extra = hybrid.build_index(spark.createDataFrame([(9, "more", "gone")], DOCS), "grp", "id", "text")
    got = {r.grp: r.state for r in hybrid.index_states(docs, index.unionByName(extra), "grp", "id", "text").collect()}
    assert got == {"ok": "ok", "new": "missing", "old": "stale", None: "ok", "thin": "dimension", "more": "stale"}


def test_search_falls_back_to_words(spark):
    docs = spark.createDataFrame([(1, "ok", "bus rapid transit"), (2, "lost", "bus rapid transit lines"), (3, None, "tram")], DOCS)
    index = hybrid.build_index(docs.where("grp is null or grp = 'ok'"), "grp", "id", "text")
    queries = spark.createDataFrame([(10, "rapid bus"), (11, ""), (12, None)], "q long, words string")
    got = {r.id: (r.state, r.method, r.rank_vectors is None) for r in hybrid.hybrid_search(docs, index, queries, "grp", "id", "text", "q", "words").collect()}
    assert got[2] == ("missing", "words", True) and got[1] == ("ok", "hybrid", False) and got[3] == ("ok", "hybrid", False)
