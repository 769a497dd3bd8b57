"""Nearest neighbours by an inverted file of coarse centroids and product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample; every usable vector is then assigned to the list of its nearest
centroid, with its residual's codes and the vector itself. A query visits the lists whose centroids have the largest
inner products, bounds each row of a list by asymmetric distance tables (the exact query against quantised residuals, give
or take the row's own quantisation error), and reranks every row that may be among the k best by exact inner products in
double precision. Within the lists visited nothing is lost; lists are dealt out in blocks by their own number of rows; a query goes to every
block of a list that it visits, and the blocks' results meet per query at the end. Of equal vectors those with the k + 1
smallest ids are indexed, as no other can be among the k nearest of any query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """At most k centroids (fewer where x has fewer rows), by Lloyd's rounds from distinct rows."""
    x = np.unique(x, axis=0) if len(x) <= k else x
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Model:
    """Coarse centroids, and a codebook for each of `parts` sub-spaces of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, codes: int, rounds: int = 8, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.coarse = kmeans(sample, lists, rounds, rng)
        rest = sample - self.coarse[self.nearest(sample)]
        self.cuts = np.linspace(0, sample.shape[1], parts + 1).astype(int)
        self.books = [kmeans(rest[:, a:b], codes, rounds, rng) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.coarse.T - 0.5 * (self.coarse**2).sum(axis=1), axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = self.nearest(x)
        rest = x - self.coarse[near]
        codes = [np.argmax(rest[:, a:b] @ m.T - 0.5 * (m * m).sum(axis=1), axis=1) for a, b, m in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)]
        return near, np.stack(codes, axis=1).astype(np.uint8)

    def approximate(self, q: np.ndarray, near: int, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products, queries x rows of a list, by table look-up."""
        out = np.repeat((q @ self.coarse[near])[:, None], len(codes), axis=1)
        for p, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            out += (q[:, a:b] @ self.books[p].T)[:, codes[:, p]]
        return out

    def errors(self, x: np.ndarray, near: int, codes: np.ndarray) -> np.ndarray:
        """Length of what quantisation leaves of each row of a list."""
        rest = x - self.coarse[near]
        for p, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            rest[:, a:b] -= self.books[p][codes[:, p]]
        return np.sqrt((rest * rest).sum(axis=1))


def lists_to_visit(model: Model, sample: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """How many lists, by inner product of query and centroid, hold `recall` of the k nearest in the sample of its own
    first rows. In all rows the k nearest lie nearer to the query than in a sample, so this is rather too many."""
    n = min(queries, len(sample))
    score = sample[:n] @ sample.T
    score[np.arange(n), np.arange(n)] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(model.coarse)
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(sample[:n] @ model.coarse.T), axis=1, kind="stable"), axis=1)
    ranks = np.sort(np.take_along_axis(place, model.nearest(sample)[near], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _assign(model_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            near, codes = model_b.value.encode(x)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(["r"] * len(x)), batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "kind", "id", "vector", "codes"])

    return run


def _probe(model_b, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse = model_b.value.coarse
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(1))
            take = np.argsort(-(q @ coarse.T), axis=1, kind="stable")[:, :probes]
            ids, raw = batch.column(0).to_pylist(), [v.tobytes() for v in q]
            n, lists = len(ids), take.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(take.ravel(), pa.int32()), pa.array(["q"] * (n * lists)), pa.array([i for i in ids for _ in range(lists)], pa.int64()), pa.array([v for v in raw for _ in range(lists)], pa.binary()), pa.array([b""] * (n * lists), pa.binary())], ["list", "kind", "id", "vector", "codes"])

    return run


def _search(model_b, k: int, rerank: int):
    def run(table: pa.Table) -> pa.Table:
        kind = np.array(table.column("kind").to_pylist())
        ids = table.column("id").to_numpy()
        vectors = [np.frombuffer(v, np.float64) for v in table.column("vector").to_pylist()]
        rows, asks = np.flatnonzero(kind == "r"), np.flatnonzero(kind == "q")
        out_q, out_v, out_s = [], [], []
        if len(rows) and len(asks):
            x = np.stack([vectors[i] for i in rows])
            codes = table.column("codes").to_pylist()
            code = np.stack([np.frombuffer(codes[i], np.uint8) for i in rows])
            near, x_ids = table.column("list")[0].as_py(), ids[rows]
            error, longest = model_b.value.errors(x, near, code), np.sqrt((x * x).sum(axis=1).max())
            for lo in range(0, len(asks), 128):
                part = asks[lo : lo + 128]
                q = np.stack([vectors[i] for i in part])
                guess = model_b.value.approximate(q, near, code)
                for r, a in enumerate(part):
                    take = np.flatnonzero(x_ids != ids[a])
                    if len(take) > rerank >= k:
                        size = np.sqrt(q[r] @ q[r])
                        slack = 1e-9 * size * longest  # far above rounding
                        low, high = (guess[r] - size * error)[take], (guess[r] + size * error)[take]
                        take = take[high >= np.partition(low, -k)[-k] - slack]
                        close = (x @ q[r])[take] if 2 * len(take) > len(rows) else x[take] @ q[r]
                        take = take[close >= np.partition(close, -k)[-k] - slack]
                    score = (x[take] * q[r]).sum(axis=1)
                    best = np.lexsort((x_ids[take], -score))[:k]
                    out_q += [int(ids[a])] * len(best)
                    out_v += x_ids[take[best]].tolist()
                    out_s += score[best].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return run


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, probes: int | None = None, recall: float = 0.95, parts: int = 16, codes: int = 128, rerank: int = 64, sample: int = 16_384, block_rows: int = 2_000) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k nearest found by inner product, nearest first, ties
    to the smaller id; the query's own id is no candidate.

    queries has the same columns as vectors. Vectors that are null, zero, hold null or non-finite components or have
    another length than most of the sample's take no part; nor do null ids. Rows that repeat an id count once, with
    the greatest vector. The model is fitted on about `sample` rows chosen by hash of the id; all rows are indexed, but for
    copies of a vector after its k + 1 smallest ids. Lists: sqrt(rows) / 4, from 64 to 1024. Each query visits as many as
    hold `recall` of the k nearest within the sample: few where vectors lie in clusters, most where they lie anywhere. A list is dealt out in blocks of about `block_rows` of its rows. A
    block of more than `rerank` rows leaves out those that its quantised products show not to be among the k best.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("vector")
        good = v.isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("vector", lambda e: e != 0)
        own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        return own.where(F.col("id").isNotNull() & good).groupBy("id").agg(F.max("vector").alias("vector"))

    rows, asks = saved(usable(vectors)), saved(usable(queries))
    total = rows.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not total:
        return empty
    share = min(1.0, sample / total)
    drawn = [r.vector for r in rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < F.lit(max(1, int(share * (1 << 20))))).orderBy("id").limit(2 * sample).collect()]
    drawn = drawn or [rows.orderBy("id").first().vector]
    width = int(np.bincount([len(v) for v in drawn]).argmax())
    held = np.array([v for v in drawn if len(v) == width])
    held = held[np.random.default_rng(3).permutation(len(held))]
    fitted = Model(held, lists or min(1024, max(64, round(total**0.5 / 4))), min(parts, width), codes)
    probes = probes or lists_to_visit(fitted, held, k, recall)
    model = spark.sparkContext.broadcast(fitted)
    schema = "list int, kind string, id long, vector binary, codes binary"
    right = F.size("vector") == width
    copies = Window.partitionBy("vector").orderBy("id")
    kept = rows.where(right).withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("id", "vector")
    index = saved(kept.mapInArrow(_assign(model), schema))
    blocks = saved(index.groupBy("list").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")))  # a row a list
    index = index.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).drop("blocks")
    asked = asks.where(right).mapInArrow(_probe(model, probes), schema).join(F.broadcast(blocks), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    found = index.unionAll(asked).groupBy("list", "block").applyInArrow(_search(model, k, rerank), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
