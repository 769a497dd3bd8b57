"""Search of one corpus by words and by vectors: a hashed embedding, its index, and what holds when the index does not."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import retrieval

DIMS = 64


def _slot(term: str, dims: int) -> tuple[int, int]:
    """Slot and sign of a term, by the first digits of its md5: any engine gives the same."""
    digest = hashlib.md5(term.encode(), usedforsecurity=False).hexdigest()
    return int(digest[:6], 16) % dims, 1 if int(digest[6], 16) % 2 == 0 else -1


def _summed(tokens: pa.Array, dims: int) -> pa.Array:
    """A vector for each list of tokens, null for an empty or null one; each term of the batch is hashed once."""
    coded = tokens.flatten().dictionary_encode()
    placed = np.array([_slot(t, dims) for t in coded.dictionary.to_pylist()], np.int64).reshape(-1, 2)
    many = pc.fill_null(tokens.value_lengths(), 0).to_numpy()
    at = placed[coded.indices.to_numpy()]
    sums = np.bincount(np.repeat(np.arange(len(tokens)), many) * dims + at[:, 0], at[:, 1], len(tokens) * dims)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(sums) + 1, dims), pa.int32()), pa.array(sums, pa.float64()), mask=pa.array(many == 0))


def hashed_vectors(df: DataFrame, id_col: str, text_col: str, dims: int = DIMS) -> DataFrame:
    """id and vector (array<double> of dims whole numbers): signed counts of the words that fall in each slot. Texts
    without a word, null ones too, have a null vector. Row by row, nothing is shuffled."""

    @F.arrow_udf("array<double>")
    def vector(tokens: pa.Array) -> pa.Array:
        return _summed(tokens, dims)

    return df.select(F.col(id_col).alias("id"), vector(T.bm25_tokens(F.col(text_col))).alias("vector"))


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def build_index(corpus: DataFrame, group: str, id_col: str, text_col: str, dims: int = DIMS) -> DataFrame:
    """An index of a corpus: grp, id, digest of the text, dims and vector."""
    kept = corpus.select(F.col(group).alias("grp"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = hashed_vectors(kept.withColumn("row", F.struct("grp", "id", text_digest(F.col("text")).alias("digest"))), "row", "text", dims)
    return made.select("id.grp", "id.id", "id.digest", F.lit(dims).alias("dims"), "vector")


def index_states(corpus: DataFrame, index: DataFrame, group: str, id_col: str, text_col: str, dims: int = DIMS) -> DataFrame:
    """grp, state and how many texts are new, changed and gone: `missing` where a group has no row in the index,
    `dimension` where a vector is of another size, `stale` where a text is new, changed or gone, else `ok`.

    Groups are those of the corpus; null groups are one group. One outer join of ids and digests, no text is shuffled.
    """
    own = corpus.select(F.col(group).alias("grp"), F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"))
    held = index.select(F.col("grp").alias("h_grp"), F.col("id").alias("h_id"), F.col("digest").alias("h_digest"), "dims", F.size("vector").alias("n"))
    both = own.join(held, own.grp.eqNullSafe(held.h_grp) & (own.id == held.h_id), "full")
    mine, theirs = F.col("id").isNotNull(), F.col("h_id").isNotNull()
    told = both.groupBy(F.when(mine, F.col("grp")).otherwise(F.col("h_grp")).alias("grp")).agg(
        F.count_if(mine).alias("texts"), F.count_if(theirs).alias("held"), F.count_if(mine & ~theirs).alias("new"), F.count_if(theirs & ~mine).alias("gone"),
        F.count_if(mine & theirs & (F.col("digest") != F.col("h_digest"))).alias("changed"),
        F.count_if(theirs & ((F.col("dims") != dims) | ((F.col("n") != dims) & (F.col("n") >= 0)))).alias("other"),
    )
    state = F.when(F.col("held") == 0, "missing").when(F.col("other") > 0, "dimension").when(F.col("new") + F.col("gone") + F.col("changed") > 0, "stale").otherwise("ok")
    return told.where("texts > 0").select("grp", state.alias("state"), "new", "changed", "gone")


def ranked_by_words(corpus: DataFrame, queries: DataFrame, k: int, id_col: str, text_col: str, query_col: str, query_text: str) -> DataFrame:
    """query_id, id, score, rank by BM25; scores to six places, ties to the smaller id."""
    return retrieval.bm25_topk(corpus, queries, k, id_col, text_col, query_col, query_text)


def ranked_by_vectors(vectors: DataFrame, queries: DataFrame, k: int, query_col: str, query_text: str, dims: int = DIMS) -> DataFrame:
    """query_id, id, score, rank by the cosine of hashed vectors; vectors: id, vector."""
    asked = hashed_vectors(queries, query_col, query_text, dims)
    return retrieval.dense_topk(vectors, asked, k, "id", "vector", "id", "vector")


def hybrid_search(corpus: DataFrame, index: DataFrame, queries: DataFrame, group: str, id_col: str, text_col: str, query_col: str, query_text: str, k: int = 8, candidates: int = 20, dims: int = DIMS) -> DataFrame:
    """query_id, id, rank, rank_words, rank_vectors, grp, state and method of the k best by fused reciprocal ranks.

    Only groups whose index is `ok` are searched by vectors (method hybrid); texts of the others are found by words alone
    (method words), and state says why, so an index that is lost, old or of another size costs recall but never gives a
    wrong vector. Word statistics are those of the whole corpus.
    """
    states = index_states(corpus, index, group, id_col, text_col, dims)
    sound = states.where("state = 'ok'").select(F.col("grp").alias("s_grp"))
    fit = index.join(sound, index.grp.eqNullSafe(sound.s_grp), "left_semi")
    words = ranked_by_words(corpus, queries, candidates, id_col, text_col, query_col, query_text)
    near = ranked_by_vectors(fit.select("id", "vector"), queries, candidates, query_col, query_text, dims)
    fused = retrieval.rrf(words, near, k, candidates=candidates)
    where = corpus.select(F.col(id_col).alias("id"), F.col(group).alias("grp"))
    told = fused.join(where, "id").join(states.select(F.col("grp").alias("s_grp"), "state"), F.col("grp").eqNullSafe(F.col("s_grp")))
    method = F.when(F.col("state") == "ok", "hybrid").otherwise("words")
    return told.select("query_id", "id", F.col("rrf_rank").alias("rank"), F.col("rank_a").alias("rank_words"), F.col("rank_b").alias("rank_vectors"), "grp", "state", method.alias("method"))
