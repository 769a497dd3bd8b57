"""N-gram Jaccard join by token-combination prefixes.

Shingles are ordered by class of document frequency (one, some, frequent), by hash within a class. Those of one document
fill the prefix first and need no index, so what documents merely share, such as a passage, seldom is in it. Two sets with Jaccard >= t share at
least k tokens in prefixes of length n - ceil(t n) + k. With k = 2, a rare token of the prefix is indexed alone and
frequent ones in combinations of two, so that either a shared rare token or a shared combination brings a pair together.
Sets of over `combo_size` shingles would need too many combinations; they index each token of their ordinary (k = 1)
prefix alone, and sets near that size do both, so no pair falls between the two.

No pair is emitted from a bucket. Each bucket names a pivot, its member with the fewest rare shingles; a member either
links with its pivot, or is checked against all other members of that pivot, block by block, inside tasks. Two members
that both link with the pivot are connected already. That keeps the components exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import mix, saved, shingle_sets, small_batches, tidy

CLASS_BITS = 40  # of a shingle's hash, for its frequency class alone
SEEN_BITS = 27  # of the map of shingles that occur twice: 16 MB at every size
MAX_FREQUENT = 1 << 18  # the frequent class is broadcast: 2 MB at most
MAX_BROADCAST = 200_000  # rows of documents to compare, of about 50 bytes
FREQUENT = 16  # least document frequency of the frequent class


def _packed_counts(width: int, buckets: int, flush: int = 1 << 20):
    rest = CLASS_BITS - buckets.bit_length() + 1

    def pack(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = np.sort(np.concatenate(parts))
        part = (x >> np.uint64(rest)).astype(np.int64)
        ids, at = np.unique(part, return_index=True)
        low = x & np.uint64((1 << rest) - 1)
        keys, out = [], []
        for b, v in zip(ids, np.split(low, at[1:]), strict=True):
            d = np.diff(v, prepend=np.uint64(0))
            keys.append(int(b))
            out.append(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], ["bucket", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for s in shingle_sets(batch.column(0), width):
                parts.append(s >> np.uint64(64 - CLASS_BITS))
                n += len(s)
                if n >= flush:
                    yield from pack(parts)
                    parts, n = [], 0
        if n:
            yield from pack(parts)

    return run


def _merge_counts(buckets: int):
    rest = CLASS_BITS - buckets.bit_length() + 1
    slots = 1 << max(3, SEEN_BITS - buckets.bit_length() + 1)

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = []
        for p in table.column("packed").to_pylist():
            b = np.frombuffer(p, np.uint8)
            parts.append(np.cumsum(np.ascontiguousarray(b.reshape(8, -1).T).view(np.uint64).ravel()))
        u, c = np.unique(np.concatenate(parts), return_counts=True)
        twice = np.zeros(slots, bool)
        twice[(u[c > 1] >> np.uint64(max(0, rest - slots.bit_length() + 1))).astype(np.int64) % slots] = True
        often = c >= FREQUENT
        full = u[often] | np.uint64(bucket << rest)
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "seen": pa.array([np.packbits(twice).tobytes()], pa.binary()), "token": pa.array([full.view(np.int64).tolist()], pa.list_(pa.int64())), "df": pa.array([c[often].tolist()], pa.list_(pa.int64()))})

    return run


def _classes(docs: DataFrame, text_col: str, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Buckets, the bitmap of shingles in two documents or more, and the frequent class; counted over all documents."""
    rows = docs.count()
    buckets = 1 << min(24, max(6, math.ceil(math.log2(max(rows, 1) / 1000 + 1))))
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(_packed_counts(width, buckets)), "bucket long, packed binary")
    merged = saved(counted.groupBy("bucket").applyInArrow(_merge_counts(buckets), "bucket long, seen binary, token array<long>, df array<long>"))
    tokens = merged.select(F.explode(F.arrays_zip("token", "df")).alias("z")).select("z.token", "z.df")
    # The least power of two, FREQUENT at least, above which at most MAX_FREQUENT tokens lie.
    histogram = {int(r[0]): r[1] for r in tokens.groupBy(F.floor(F.log2("df")).cast("int")).count().collect()}
    low = int(math.log2(FREQUENT))
    while sum(n for k, n in histogram.items() if k >= low) > MAX_FREQUENT:
        low += 1
    frequent = np.sort(np.array([r[0] for r in tokens.where(F.col("df") >= 1 << low).select("token").collect()], np.int64).view(np.uint64))
    width_bits = max(3, SEEN_BITS - buckets.bit_length() + 1)
    seen = np.zeros((buckets << width_bits) // 8, np.uint8)
    step = (1 << width_bits) // 8
    for r in merged.select("bucket", "seen").toLocalIterator():
        seen[r[0] * step : (r[0] + 1) * step] = np.frombuffer(r[1], np.uint8)
    return buckets, seen, frequent


def _index_keys(width: int, percent: int, combo_size: int, buckets: int, seen_b, frequent_b):
    rest = CLASS_BITS - buckets.bit_length() + 1
    bits = max(3, SEEN_BITS - buckets.bit_length() + 1)
    solo_from = -(-combo_size * percent // 100)

    def keys_of(s: np.ndarray, seen: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
        n, short = len(s), s >> np.uint64(64 - CLASS_BITS)
        if not n:
            return s, 0
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, short), len(frequent) - 1)
            often = frequent[at] == short
        else:
            often = np.zeros(n, bool)
        bucket = (short >> np.uint64(rest)).astype(np.int64)
        low = short & np.uint64((1 << rest) - 1)
        slot = (low >> np.uint64(max(0, rest - bits))).astype(np.int64) % (1 << bits)
        slot += bucket << bits
        again = (seen[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
        once, some = s[~again & ~often], s[again & ~often]
        rare_n = n - int(often.sum())
        order = np.concatenate([once, some, s[often]])
        need = -(-percent * n // 100)
        combos, solo = n <= combo_size, n >= solo_from
        one, two = n - need + 1, min(n, n - need + 2)
        out = [order[len(once) : min(rare_n, two if combos else one)]]
        if solo and one > rare_n:
            out.append(mix(order[rare_n:one] ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        if combos and two - rare_n >= 2:
            f = order[rare_n:two]
            i, j = np.triu_indices(len(f), 1)
            out.append(mix(f[i] * np.uint64(0x9E3779B97F4A7C15) + f[j]))
        return np.unique(np.concatenate(out)), rare_n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, frequent = seen_b.value, frequent_b.value
        for batch in batches:
            ns, fps, rares, keys = [], [], [], []
            for s in shingle_sets(batch.column(1), width):
                k, r = keys_of(s, seen, frequent)
                ns.append(len(s))
                rares.append(r)
                fps.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(k.view(np.int64))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            offs = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(rares, pa.int64()), pa.array(fps, pa.binary()), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], ["doc_id", "n", "rare", "fp", "keys"])

    return run


def _with_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            ids = batch.column("doc").to_pylist()
            same = pc.equal(texts.slice(1), texts.slice(0, max(len(ids) - 1, 0))).to_pylist()
            new = [i for i, d in enumerate(ids) if i == 0 or d != ids[i - 1] or not same[i - 1]]
            made = zip(new, shingle_sets(texts.take(pa.array(new, pa.int64())), width), strict=True)
            ahead, at, held, sets, size = next(made, None), 0, b"", [], 0
            for i in range(len(ids)):
                if ahead and ahead[0] == i:
                    held, ahead = ahead[1].tobytes(), next(made, None)
                sets.append(held)
                size += len(held)
                if size >= 1 << 22 or i == len(ids) - 1:
                    part = batch.slice(at, len(sets))
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc", "pivot", "block", "blocks", "role")] + [pa.array(sets, pa.binary())], ["doc", "pivot", "block", "blocks", "role", "tokens"])
                    at, sets, size = i + 1, [], 0

    return run


def _overlaps(x: np.ndarray, tokens: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Shared tokens of x with each of n sets that lie together, sorted, in tokens."""
    lo, hi = np.searchsorted(tokens, x, "left"), np.searchsorted(tokens, x, "right")
    size = hi - lo
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return np.bincount(owner[at], minlength=n)


def _verify(percent: int):
    """Links of one block as a forest (kind 0), and the members that don't link with the pivot (kind 1)."""

    def run(table: pa.Table) -> pa.Table:
        docs, roles = table.column("doc").to_pylist(), table.column("role").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        pivot, blocks = table.column("pivot")[0].as_py(), table.column("blocks")[0].as_py()
        sizes = np.array([len(s) for s in sets])
        members = [i for i, r in enumerate(roles) if r == "m"]
        asked = [i for i, r in enumerate(roles) if r == "o"]  # of other blocks
        above = list(range(len(docs)))
        out_a, out_b, out_kind = [], [], []

        def root(i: int) -> int:
            while above[i] != i:
                above[i] = above[above[i]]
                i = above[i]
            return i

        def link(i: int, j: int) -> None:
            a, b = root(i), root(j)
            if a != b:
                above[a] = b
                out_a.append(docs[i])
                out_b.append(docs[j])
                out_kind.append(0)

        where = np.concatenate([np.full(len(sets[i]), k) for k, i in enumerate(members)]) if members else np.zeros(0, np.int64)
        flat = np.concatenate([sets[i] for i in members]) if members else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        flat, where = flat[order], where[order]
        m_sizes = sizes[members] if members else np.zeros(0, np.int64)

        def linked(i: int) -> np.ndarray:
            both = _overlaps(sets[i], flat, where, len(members))
            return np.flatnonzero(100 * both >= percent * (m_sizes + sizes[i] - both))

        first = [i for i, r in enumerate(roles) if r == "p"][:1]
        if first:
            near = set(linked(first[0]).tolist())
            for k in near:
                link(first[0], members[k])
            asked = [i for k, i in enumerate(members) if k not in near]
            if blocks > 1:
                out_a += [docs[i] for i in asked]
                out_b += [pivot] * len(asked)
                out_kind += [1] * len(asked)
        for i in asked:
            for k in linked(i):
                if members[k] != i and docs[members[k]] != docs[i]:
                    link(i, members[k])
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64()), "kind": pa.array(out_kind, pa.int32())})

    return run


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, combo_size: int = 250, block_tokens: int = 400_000, block_rows: int = 256) -> tuple[DataFrame, DataFrame]:
    """(documents, links): documents has doc_id, n_shingles, component_id; links a forest of verified pairs (a, b).

    Links are decided on the sets of 64-bit hashes of the shingles. Blocks of a pivot's members have about block_tokens
    shingles and block_rows rows at most. Null and empty texts have no shingle and link with nothing. Repeated rows of an id count as one document each, and
    link with each other by equal text. Rows with a null id come back with a null component. Ties of pivots go to the
    smaller id. Extra columns of docs play no part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets, seen, frequent = _classes(docs, "text", width)
    seen_b, frequent_b = spark.sparkContext.broadcast(seen), spark.sparkContext.broadcast(frequent)
    run = _index_keys(width, percent, combo_size, buckets, seen_b, frequent_b)
    indexed = saved(docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n long, rare long, fp binary, keys array<long>"))
    seen_b.destroy()
    frequent_b.destroy()
    # One representative of each set; copies share their keys and so need no comparison.
    classes = saved(indexed.where("n > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("keys").alias("keys")))
    index = classes.select("rep", "n", "rare", F.explode("keys").alias("key"))
    pivots = saved(index.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("rare", "n", "rep")).alias("p")).where("members > 1").select("key", F.col("p.rep").alias("pivot")))
    roles = saved(index.join(pivots, "key").where("rep <> pivot").groupBy("pivot", "rep").agg(F.first("n").alias("n")))
    weight = saved(roles.groupBy("pivot").agg(F.ceil(F.greatest(F.sum("n") / F.lit(block_tokens), F.count("*") / F.lit(block_rows))).cast("int").alias("blocks")))
    member = roles.join(weight, "pivot").select(F.col("rep").alias("doc"), "pivot", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"), "blocks", F.lit("m").alias("role"))
    pivot = weight.select(F.col("pivot").alias("doc"), "pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "blocks", F.lit("p").alias("role"))
    wanted = saved(member.unionAll(pivot))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("doc"), "text")

    def verified(rows: DataFrame) -> DataFrame:
        few = rows.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST  # then the texts stay where they are
        sets = texts.join(F.broadcast(rows) if few else rows, "doc").select("doc", "pivot", "block", "blocks", "role", "text")
        sets = sets.mapInArrow(tidy(_with_sets(width)), "doc long, pivot long, block int, blocks int, role string, tokens binary")
        return saved(sets.groupBy("pivot", "block").applyInArrow(_verify(percent), "a long, b long, kind int"))

    first = verified(wanted)
    # Members of pivots with several blocks that don't link with their pivot go to its other blocks.
    far = first.where("kind = 1").select(F.col("a").alias("doc"), F.col("b").alias("pivot")).distinct()
    wide = wanted.where("blocks > 1 and role = 'm'")
    asked = wide.join(far, ["doc", "pivot"]).select("doc", "pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "blocks", "block").where("other <> block").select("doc", "pivot", F.col("other").alias("block"), "blocks", F.lit("o").alias("role"))
    edges = first.where("kind = 0").select("a", "b")
    if far.limit(1).count():
        edges = edges.unionAll(verified(saved(wide.unionAll(asked))).where("kind = 0").select("a", "b"))
    edges = saved(edges.distinct())
    found = connected_components(edges)
    label = saved(classes.select("fp", "rep").join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id")))
    alone, grouped = indexed.where("n = 0 or doc_id is null"), indexed.where("n > 0 and doc_id is not null")
    out = grouped.join(label, "fp").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionAll(alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out, edges
