"""Toxicity by class-conditional Kneser-Ney models of words, spelt symbol by symbol.

P_c(x | h) = max(n_c(h x) - d, 0) / n_c(h) + d * N_c(h .) / n_c(h) * P(x | h')

for the toxic and the ordinary class c, where h is the word so far (its last eight symbols, the separator before it
included), x the next symbol or the word's end, h' the last three symbols, and P the Kneser-Ney model of lower order from
continuation counts that both classes share: an expression rare in one class leans on those. A text's features are its
log-likelihood ratio per symbol, those of its most toxic words, and its length; a logistic curve fitted on labelled texts
outside the counts turns them into a score.

Counts are over all labelled texts given, and every (h, x) counted keeps its own log ratio under its 64-bit key: the model
grows with the input. Up to MAX_BROADCAST_ENTRIES entries are broadcast; a larger model stays a table, and each chunk of
texts is joined with the entries that its own histories ask for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import _power, byte_view, chunks, mix, saved, small_batches

CONTEXT, BITS, LOW = 8, 5, 4  # symbols of h at most, bits of a symbol, order of the shared model
WIDE_CONTEXT = 24  # symbols of h at most where letters take several
BUCKET_BITS = 7
DISCOUNT = 0.75
SCALE = 16.0  # steps of a stored log ratio
ABSENT = -128
MAX_CALIBRATION = 20_000  # labelled texts for the logistic curve
MAX_BROADCAST_LABELS = 2_000_000
MAX_BROADCAST_ENTRIES = 1 << 23  # of nine bytes
CHUNK_BYTES = 16_000_000  # of texts scored together where the model is joined

# Symbols: 0 separators, 1-26 letters, 27 digits, 28-31 other Latin letters by their last byte. 255: bytes without a symbol.
# Letters from WIDE on, of other scripts, are spelt by all their bytes: one symbol for the first, two for each that follows.
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[65:91] = _SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[48:58] = 27
_SYMBOL[128:192] = 28 + np.arange(64) % 4
_SYMBOL[192:] = 255
_WIDE = 0xC6  # first byte of U+0180 and above
_SALT = np.random.default_rng(9).integers(1, 2**63, 33, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_REST = 32  # salt of a history's slot for symbols that it lacks


def spelt(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Symbols of UTF-8 bytes, which of them spell wide letters (None: none), and the rows' offsets among symbols."""
    s = _SYMBOL[raw]
    first = raw >= _WIDE
    if not first.any():
        keep = s != 255
        return s[keep], None, np.concatenate([[0], np.cumsum(keep)])[offs]
    wide = first.copy()
    for k, least in ((1, _WIDE), (2, 0xE0), (3, 0xF0)):
        wide[k:] |= raw[:-k] >= least
    times = np.where(wide, np.where(first, 1, 2), (s != 255).astype(np.int64))
    at = np.repeat(np.arange(len(raw)), times)
    again = np.concatenate([[False], at[1:] == at[:-1]])
    b, out, wide = raw[at], s[at], wide[at]
    high = wide & ~first[at] & ~again
    out[wide] = 1 + (b[wide] & 15)
    out[high] = 28 + ((b[high] >> 4) & 3)
    return out, wide, np.concatenate([[0], np.cumsum(times)])[offs]


def grams(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some rows together: hash of h, x, id of h' x, and the first position of each row with the end last. Runs of
    separators count as one; each text starts after a separator and ends with one."""
    data, offs = byte_view(column)
    for i, j in chunks(offs, size):
        o = offs[i : j + 1] - offs[i]
        s, wide, row = spelt(data[offs[i] : offs[j]], o)
        n = np.diff(row)
        x = np.zeros(len(s) + 2 * (j - i), np.int64)  # with a separator before and after each row
        place = np.arange(len(s)) + np.repeat(2 * np.arange(j - i) + 1, n)
        x[place] = s
        owner = np.repeat(np.arange(j - i), n + 2)
        fresh = np.ones(len(x), bool)
        fresh[1:] = (x[1:] != 0) | (x[:-1] != 0) | (owner[1:] != owner[:-1])
        context = np.full(len(x), CONTEXT)
        if wide is not None:
            context[place[wide]] = context[place[wide] + 1] = WIDE_CONTEXT
        x, owner, context = x[fresh], owner[fresh], context[fresh]
        at = np.arange(len(x))
        word = np.maximum.accumulate(np.where(x == 0, at, 0))
        first = np.zeros(len(x), bool)
        first[0] = True
        first[1:] = owner[1:] != owner[:-1]
        begin = np.zeros(len(x), np.int64)
        begin[1:] = np.maximum(word[:-1], at[1:] - context[1:])
        up, down = _power(len(x) + 1)
        run = np.concatenate([[np.uint64(0)], np.cumsum(_SALT[x] * up[: len(x)])])
        h = mix((run[:-1] - run[begin]) * down[begin] + (at - begin).astype(np.uint64))
        low = x.copy()
        for k in range(1, LOW):
            back = np.concatenate([np.zeros(k, np.int64), x[:-k]]) if len(x) > k else np.zeros(len(x), np.int64)
            low |= np.where(at - k >= begin, back, 0) << (BITS * k)
        take = ~first
        yield h[take], x[take], low[take], np.concatenate([[0], np.cumsum(np.bincount(owner[take], minlength=j - i))])


def bucket_bits(labelled: int) -> int:
    """Bits of the number of buckets: more for more labelled texts, so that what one task sums up does not grow."""
    return min(16, BUCKET_BITS + max(0, (labelled // 200_000).bit_length()))


def _count(bits: int):
    return lambda batches: _counted(batches, bits)


def _counted(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Counts of a partition, by bucket of h: distinct (h, x) with their h' x, and counts by kind. In: text, kind of text
    (1: toxic, 2: for calibration)."""
    held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, 4), np.int32)]
    mask, waiting = ~np.uint64(31), 0
    for batch in batches:
        kind, at = batch.column(1).to_numpy(zero_copy_only=False), 0
        for h, x, low, row in grams(batch.column(0)):
            y = np.repeat(kind[at : at + len(row) - 1], np.diff(row)).astype(np.int64)
            at += len(row) - 1
            own = np.zeros((len(x), 4), np.int32)
            own[np.arange(len(x)), y] = 1
            for parts, new in zip(held, ((h & mask) | x.astype(np.uint64), low, own), strict=True):
                parts.append(new)
            waiting += len(x)
            if waiting >= 1 << 19:
                got, waiting = _merged(*map(np.concatenate, held)), 0
                held = tuple([g] for g in got)
                if len(got[0]) > 700_000:
                    yield from _packed(*got, bits)
                    held = tuple([g[:0]] for g in got)
    yield from _packed(*_merged(*map(np.concatenate, held)), bits)


def _merged(keys: np.ndarray, lows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], lows[order][at], np.add.reduceat(counts[order], at, axis=0) if len(at) else counts


def _packed(keys: np.ndarray, lows: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    for b in np.unique(bucket):
        lo, hi = np.searchsorted(bucket, [b, b + 1])
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([keys[lo:hi].tobytes()], pa.binary()), pa.array([lows[lo:hi].astype("<u4").tobytes()], pa.binary()), pa.array([np.ascontiguousarray(counts[lo:hi].T).astype("<i4").tobytes()], pa.binary())], ["bucket", "keys", "lows", "counts"])


_COUNTS = "bucket int, keys binary, lows binary, counts binary"


def _unpacked(columns: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = [np.frombuffer(k, "<u8") for k in columns[0]]
    return np.concatenate(keys), np.concatenate([np.frombuffer(x, "<u4") for x in columns[1]]).astype(np.int64), np.concatenate([np.frombuffer(c, "<i4").reshape(4, -1).T for c in columns[2]])


def _sum(bits: int):
    def run(table: pa.Table) -> pa.Table:
        got = _merged(*_unpacked([table.column(c).to_pylist() for c in ("keys", "lows", "counts")]))
        return pa.Table.from_batches(list(_packed(*got, bits)))

    return run


def _continuations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many distinct h precede each h' x, as sparse pairs of a partition."""
    total = np.zeros(1 << (BITS * LOW), np.int64)
    for batch in batches:
        for x in batch.column(0).to_pylist():
            total += np.bincount(np.frombuffer(x, "<u4"), minlength=len(total))
    where = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(total[where], pa.int64())], ["low", "n"])


def shared_model(continuations: np.ndarray) -> np.ndarray:
    """P(x | h') for every id of h' x, from its distinct left extensions; orders below count distinct extensions too."""
    base = 1 << BITS
    levels = [continuations.astype(np.float64)]
    for _ in range(LOW - 1):
        levels.append((levels[-1] > 0).reshape(base, -1).sum(axis=0).astype(np.float64))
    lower = np.full((1, base), 1.0 / base)
    for cont in levels[::-1]:
        cont = cont.reshape(-1, base)
        total, kinds = cont.sum(axis=1, keepdims=True), (cont > 0).sum(axis=1, keepdims=True)
        weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        lower = np.maximum(cont - DISCOUNT, 0) / np.maximum(total, 1) + weight * np.tile(lower, (len(cont) // len(lower), 1))
    return lower.ravel()


def entry_ratios(keys: np.ndarray, lows: np.ndarray, n: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Histories h, those of the pairs (h, x), their x, and stored log ratios, toxic over ordinary, of what each history
    lacks and then of each pair; n: (ordinary, toxic)."""
    met = n.sum(axis=1) > 0
    keys, lows, n = keys[met], lows[met], n[met]
    h, x = keys & ~np.uint64(31), (keys & np.uint64(31)).astype(np.int64)
    heads, of = np.unique(h, return_inverse=True)
    logs, rest = [], []
    for c in (0, 1):
        total = np.bincount(of, weights=n[:, c], minlength=len(heads))
        kinds = np.bincount(of, weights=n[:, c] > 0, minlength=len(heads))
        weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        logs.append(np.log(np.maximum(n[:, c] - DISCOUNT, 0) / np.maximum(total, 1)[of] + weight[of] * shared[lows]))
        rest.append(np.log(weight))
    both = np.concatenate([rest[1] - rest[0], logs[1] - logs[0]])
    return heads, h, x, np.clip(np.rint(both * SCALE), -127, 127).astype(np.int8)


def pair_keys(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    return h | x.astype(np.uint64)


def rest_keys(h: np.ndarray) -> np.ndarray:
    """Keys of what histories lack."""
    return mix(h ^ _SALT[_REST])


class Ratios:
    """Log ratios by key; keys that are absent are known to be."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def find(self, wanted: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(wanted), ABSENT, np.int8)
        each, back = np.unique(wanted, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, each), len(self.keys) - 1)
        return np.where(self.keys[at] == each, self.values[at], np.int8(ABSENT))[back]

    def __call__(self, h: np.ndarray, x: np.ndarray) -> np.ndarray:
        v = self.find(pair_keys(h, x))
        if len(gone := np.flatnonzero(v == ABSENT)):
            v[gone] = self.find(rest_keys(h[gone]))
            v[v == ABSENT] = 0
        return v


_ENTRIES = "keys binary, early binary, full binary"


def _ratios(shared_b):
    """For each bucket its keys and two log ratios each: from counts without calibration texts, and from all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in zip(*(batch.column(c).to_pylist() for c in ("keys", "lows", "counts")), strict=True):
                keys, lows, n = _unpacked([[r] for r in raw])
                heads, h, x, full = entry_ratios(keys, lows, n[:, :2] + n[:, 2:], shared_b.value)
                names = np.concatenate([rest_keys(heads), pair_keys(h, x)])
                heads, h, x, value = entry_ratios(keys, lows, n[:, :2], shared_b.value)
                order = np.argsort(names)
                early = np.full(len(names), ABSENT, np.int8)
                early[order[np.searchsorted(names, np.concatenate([rest_keys(heads), pair_keys(h, x)]), sorter=order)]] = value
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (names, early, full)], ["keys", "early", "full"])

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each entry that has a ratio. In: keys, ratios."""
    for batch in batches:
        for keys, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            k, v = np.frombuffer(keys, np.int64), np.frombuffer(values, np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(k[v != ABSENT]), pa.array(v[v != ABSENT])], ["key", "ratio"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct keys that the texts of a chunk may read. In: text, chunk."""
    chunk, held = None, []

    def out() -> pa.RecordBatch:
        keys = np.unique(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk)), pa.array(keys.view(np.int64))], ["chunk", "key"])

    for batch in batches:
        of = batch.column(1).to_numpy()
        for c in np.unique(of):
            if held and c != chunk:
                yield out()
                held = []
            chunk = c
            for h, x, _, _ in grams(batch.column(0).filter(pa.array(of == c))):
                h = h & ~np.uint64(31)
                held.append(np.unique(np.concatenate([pair_keys(h, x), rest_keys(np.unique(h))])))
                if len(held) > 16:
                    held = [np.unique(np.concatenate(held))]
    if held:
        yield out()


def _with_ratios(docs: DataFrame, entries: DataFrame, value: str, run: Callable[[pa.RecordBatch, Ratios], pa.RecordBatch], schema: str, few: bool) -> DataFrame:
    """run over docs, whose first column is text, with the model's log ratios: all of them, or those its chunk asks for."""
    if few:
        keys, values = [np.zeros(0, np.uint64)], [np.zeros(0, np.int8)]
        for r in entries.select("keys", value).toLocalIterator():
            v = np.frombuffer(r[1], np.int8)
            keys.append(np.frombuffer(r[0], np.uint64)[v != ABSENT])
            values.append(v[v != ABSENT])
        model = docs.sparkSession.sparkContext.broadcast(Ratios(np.concatenate(keys), np.concatenate(values)))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield run(batch, model.value)

        return docs.mapInArrow(each, schema)
    size = docs.agg(F.avg(F.octet_length("text"))).first()[0] or 1.0
    rows, at = max(1, int(CHUNK_BYTES / max(size, 1.0))), F.monotonically_increasing_id()
    cut = saved(docs.withColumn("chunk", at).withColumn("chunk", F.col("chunk") - F.col("chunk").bitwiseAND((1 << 33) - 1) % rows))
    found = cut.select("text", "chunk").mapInArrow(_asked, "chunk long, key long").join(entries.select("keys", value).mapInArrow(_rows, "key long, ratio byte"), "key").select("chunk", "key", "ratio")

    def both(texts: pa.Table, own: pa.Table) -> pa.Table:
        ratios = Ratios(own.column("key").to_numpy().view(np.uint64), own.column("ratio").to_numpy())
        return pa.Table.from_batches([run(b, ratios) for b in texts.drop_columns(["chunk"]).to_batches(max_chunksize=500)])

    return cut.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(both, schema)


def features(column: pa.Array, ratio: Ratios | np.ndarray) -> np.ndarray:
    """One row each: log ratio per symbol, the largest of a word and the mean of the three largest, log length. Empty
    texts: zeros."""
    out = []
    for h, x, _, row in grams(column):
        h = h & ~np.uint64(31)
        v = ratio(h, x).astype(np.float64) / SCALE
        run = np.concatenate([[0.0], np.cumsum(v)])
        n = np.diff(row)
        made = np.zeros((len(n), 4))
        made[:, 0] = (run[row[1:]] - run[row[:-1]]) / np.maximum(n, 1)
        made[:, 3] = np.log1p(n)
        ends = np.flatnonzero(x == 0)  # each text ends with a separator, so no word spans two
        if len(ends):
            word = np.diff(run[ends + 1], prepend=0.0)
            owner = np.searchsorted(row, ends, "right") - 1
            order = np.lexsort((-word, owner))
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            many = np.diff(np.append(first, len(owner)))
            top = np.zeros((len(first), 3))
            for k in range(3):
                has = many > k
                top[has, k] = word[order[first[has] + k]]
            made[owner[first], 1], made[owner[first], 2] = top[:, 0], top.mean(axis=1)
        out.append(made)
    return np.concatenate(out) if out else np.zeros((0, 4))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, spread and weights (bias last) by Newton's method."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, w


def _features(batch: pa.RecordBatch, ratios: Ratios) -> pa.RecordBatch:
    x = features(batch.column(0), ratios)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2]), pa.array(x[:, 3]), batch.column(1)], ["mean", "top", "three", "size", "label"])


def _score(curve):
    mean, spread, w = curve

    def run(batch: pa.RecordBatch, ratios: Ratios) -> pa.RecordBatch:
        x = features(batch.column(0), ratios)
        p = 1 / (1 + np.exp(-np.clip(((x - mean) / spread) @ w[:-1] + w[-1], -30, 30)))
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(p), pa.array(x[:, 0]), pa.array(x[:, 1])], ["doc_id", "score", "log_ratio", "word_log_ratio"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, calibrate: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_BROADCAST_ENTRIES) -> DataFrame:
    """doc_id, score, log_ratio, word_log_ratio of every row of docs, repeated rows included.

    labels: (id, 0/1). All labelled texts give the counts. The curve is fitted on features that texts where `calibrate`
    (over the id) holds get from the counts of the others: at most about MAX_CALIBRATION of them, chosen by hash. Null labels and ids are left out; an id with several
    labels counts as toxic if one is. Null and empty texts score as a text of length 0. With no labelled text, or labels
    of one class only, every score is 0. A model of more than `most` entries is joined instead of broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    marks = marks.select("doc_id", "label", calibrate.alias("later"))
    totals = marks.agg(F.count("*"), F.count_if("later"), F.countDistinct("label")).first()
    if totals[2] < 2:
        return own.select("doc_id", F.lit(0.0).alias("score"), F.lit(0.0).alias("log_ratio"), F.lit(0.0).alias("word_log_ratio"))
    few, bits = totals[0] <= MAX_BROADCAST_LABELS, bucket_bits(totals[0])
    known = own.join(F.broadcast(marks) if few else marks, "doc_id")
    counted = known.select("text", (F.col("label") + 2 * F.col("later").cast("int")).alias("kind")).mapInArrow(_count(bits), _COUNTS)
    counts = saved(counted.groupBy("bucket").applyInArrow(_sum(bits), _COUNTS))
    send = spark.sparkContext.broadcast
    low = np.zeros(1 << (BITS * LOW), np.int64)
    for r in counts.select("lows").mapInArrow(_continuations, "low int, n long").groupBy("low").agg(F.sum("n").alias("n")).collect():
        low[r.low] = r.n
    entries = saved(counts.mapInArrow(_ratios(send(shared_model(low))), _ENTRIES))
    held = (entries.agg(F.sum(F.octet_length("early"))).first()[0] or 0) <= most
    share = min(1.0, MAX_CALIBRATION / max(totals[1], 1))
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    fit = known.where(F.col("later") & drawn).select("text", "label")
    fit = _with_ratios(fit, entries, "early", _features, "mean double, top double, three double, size double, label int", held).collect()
    x, y = np.array([r[:4] for r in fit]).reshape(-1, 4), np.array([r[4] for r in fit], float)
    if len(y) and 0 < y.sum() < len(y):
        curve = fit_logistic(x, y)
    else:  # too few labels to calibrate: the sign of the mean log ratio
        curve = np.zeros(4), np.ones(4), np.array([8.0, 0.0, 0.0, 0.0, 0.0])
    kind = dict(own.dtypes)["doc_id"]
    return _with_ratios(own.select("text", "doc_id"), entries, "full", _score(curve), f"doc_id {kind}, score double, log_ratio double, word_log_ratio double", held)
