"""Quality by weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer.

Labellers vote good, bad or abstain. Texts with the same votes are alike to the model, so only the counts of vote patterns,
at most 3**len(LABELLERS) rows over all documents, reach the driver, where EM estimates each labeller's accuracy and the
share of good texts. The posterior of its pattern labels each text; a logistic model on hashed words and letter triples,
fitted on a bounded sample with those soft labels, scores all texts, also where every labeller abstains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, SPACE, byte_view, chunks, mix, small_batches, span_hashes, tidy, word_spans

HASH_BITS = 16
MAX_SAMPLE = 8_000  # texts that the scorer is fitted on
ABSTAIN = 0

_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "#$%&*<>@[]\\^_`{|}~!=+"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True

#: Name, statistic, bad below, bad above, good from, good to. Statistics are shares unless the name says otherwise.
#: Most labellers know a kind of junk only and abstain elsewhere; each kind is known to two or more.
LABELLERS = [
    ("words", "n_words", None, None, 40, None),
    ("letters", "alpha", 0.75, None, None, None),
    ("marks", "marks", None, 0.03, None, None),
    ("capitals", "upper", None, 0.6, None, None),
    ("distinct", "distinct", 0.45, None, None, None),
    ("repeats", "repeats", None, 0.15, None, None),
    ("single signs", "single", None, 0.15, None, None),
    ("doubled signs", "doubled", None, 0.2, None, None),
    ("word length", "word_len", 2.5, 12.0, None, None),
    ("sentences", "stops", None, None, 0.03, 0.3),
]
STATS = ["n_words", "alpha", "marks", "upper", "distinct", "repeats", "word_len", "stops", "single", "doubled"]


def _per_row(mask: np.ndarray, o: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(mask)])
    return run[o[1:]] - run[o[:-1]]


def statistics(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some rows together: statistics (rows x STATS), word hashes, and letter-triple hashes with each word's row."""
    data, offs = byte_view(column)
    for i, j in chunks(offs):
        o = offs[i : j + 1] - offs[i]
        part = data[offs[i] : offs[j]]
        starts, ends, rows = word_spans(data, offs[i : j + 1])
        h = span_hashes(data, starts, ends)
        n = np.bincount(rows, minlength=j - i)
        seen = _per_row(~SPACE[part], o)
        shown = np.maximum(seen, 1)
        letters = _per_row(_ALPHA[part], o)
        out = np.zeros((j - i, len(STATS)))
        out[:, 0] = n
        out[:, 1] = letters / shown
        out[:, 2] = _per_row(_MARK[part], o) / shown
        out[:, 3] = _per_row(_UPPER[part], o) / np.maximum(letters, 1)
        order = np.lexsort((h, rows))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (rows[order][1:] != rows[order][:-1])
        # Long texts repeat words by nature: types are compared with the number expected to be new, its root law.
        types = np.bincount(rows[order][new], minlength=j - i)
        out[:, 4] = types / np.maximum(np.where(n > 100, 10 * np.sqrt(n), n), 1)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
        out[:, 5] = np.bincount(rows[same], minlength=j - i) / np.maximum(n, 1)
        out[:, 6] = seen / np.maximum(n, 1)
        out[:, 7] = np.bincount(rows[_STOP[data[ends - 1]]] if len(ends) else rows, minlength=j - i) / np.maximum(n, 1)
        if len(ends):
            last, size = data[ends - 1], ends - starts
            out[:, 8] = np.bincount(rows[(size == 1) & ~_ALPHA[last] & ~_DIGIT[last]], minlength=j - i) / np.maximum(n, 1)
            twice = (size > 2) & (last == data[ends - 2]) & ~_ALPHA[last] & ~_DIGIT[last]
            out[:, 9] = np.bincount(rows[twice], minlength=j - i) / np.maximum(n, 1)
        yield out, h, rows, o


def votes(stats: np.ndarray) -> np.ndarray:
    """1 good, -1 bad, 0 abstain; rows x LABELLERS."""
    out = np.zeros((len(stats), len(LABELLERS)), np.int8)
    for k, (_, name, low, high, good_low, good_high) in enumerate(LABELLERS):
        x = stats[:, STATS.index(name)]
        good = np.full(len(x), good_low is not None or good_high is not None)
        good &= (x >= (good_low if good_low is not None else -np.inf)) & (x <= (good_high if good_high is not None else np.inf))
        # Shares of a text of no word say nothing.
        bad = (stats[:, 0] > 0) & ((x < (low if low is not None else -np.inf)) | (x > (high if high is not None else np.inf)))
        out[:, k] = np.where(bad, -1, np.where(good, 1, 0))
    return out


class WeakLabels:
    """Two-class model of votes, each labeller independent given the class, with a share of each vote in each class."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> None:
        k = patterns.shape[1]
        self.good = 0.8
        # Start: in either class a labeller's vote is for that class rather than against it.
        self.share = np.empty((2, k, 3))
        self.share[0] = 0.35, 0.5, 0.15
        self.share[1] = 0.02, 0.48, 0.5
        total = counts.sum()
        for _ in range(rounds if total else 0):
            p = self.posterior(patterns)
            w = np.stack([counts * (1 - p), counts * p])
            before = self.good
            self.good = float(np.clip(w[1].sum() / total, 0.01, 0.99))
            for v in (-1, 0, 1):
                met = (patterns == v).astype(float)
                # A prior of pseudo-counts keeps the start's meaning: class 1 is the one that good votes mark.
                prior = np.stack([np.full(k, 3.0 if v == -1 else 1.0), np.full(k, 3.0 if v == 1 else 1.0)])
                self.share[:, :, v + 1] = (w @ met + prior) / (w.sum(axis=1, keepdims=True) + 5.0)
            if abs(self.good - before) < 1e-9:
                break

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes is good."""
        at = patterns.astype(int) + 1
        cols = np.arange(patterns.shape[1])
        log = [np.log(self.share[c][cols, at]).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log((1 - self.good) / self.good), -50, 50)))

    def accuracies(self) -> dict[str, float]:
        """Share of right votes among a labeller's votes."""
        right = self.share[1, :, 2] * self.good + self.share[0, :, 0] * (1 - self.good)
        wrong = self.share[1, :, 0] * self.good + self.share[0, :, 2] * (1 - self.good)
        return {name[0]: float(r / (r + w)) for name, r, w in zip(LABELLERS, right, wrong, strict=True)}


def hashed(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some rows together: feature slot and weight of each occurrence, its row, and the rows' statistics. Features are words,
    byte triples and coarse bins of the statistics; weights make each text's words, and its triples, sum to one."""
    data_all, offs_all = byte_view(column)
    row0 = 0
    mask = np.uint64((1 << HASH_BITS) - 1)
    for stats, h, rows, o in statistics(column):
        m = len(stats)
        part = LOWER[data_all[offs_all[row0] : offs_all[row0 + m]]].astype(np.uint64)
        tri = (part[:-2] << np.uint64(16) | part[1:-1] << np.uint64(8) | part[2:]) if len(part) > 2 else part[:0]
        owner = np.repeat(np.arange(m), np.diff(o))
        inside = owner[2:] == owner[:-2] if len(part) > 2 else np.zeros(0, bool)
        t_row = owner[2:][inside] if len(part) > 2 else owner[:0]
        t_slot = mix(tri[inside] + np.uint64(1 << 40)) & mask
        bins = np.stack([np.searchsorted(q, stats[:, k]) for k, q in enumerate(_BINS)], axis=1)
        s_slot = mix((bins + 100 * np.arange(len(STATS)) + (1 << 50)).astype(np.uint64).ravel()) & mask
        s_row = np.repeat(np.arange(m), len(STATS))
        n, nt = np.bincount(rows, minlength=m), np.bincount(t_row, minlength=m)
        slot = np.concatenate([(h & mask), t_slot, s_slot]).astype(np.int64)
        weight = np.concatenate([1 / np.sqrt(np.maximum(n, 1))[rows] / 4, 1 / np.sqrt(np.maximum(nt, 1))[t_row] / 4, np.full(len(s_row), 0.5)])
        yield slot, weight, np.concatenate([rows, t_row, s_row]), stats
        row0 += m


_BINS = [np.array(b) for b in ([4, 8, 16, 40, 100, 400, 2000], [0.5, 0.7, 0.8, 0.9, 0.95], [0.002, 0.005, 0.02, 0.04, 0.1], [0.05, 0.12, 0.25, 0.4, 0.7], [0.1, 0.2, 0.3, 0.4, 0.6], [0.01, 0.02, 0.05, 0.2, 0.5], [2, 3, 5, 7, 9, 14], [0.004, 0.02, 0.05, 0.1, 0.2, 0.35], [0.02, 0.05, 0.15, 0.3], [0.02, 0.1, 0.2, 0.5])]


def fit_linear(examples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 12, rate: float = 0.5, ridge: float = 1e-4, batch: int = 16) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model on sparse rows with soft labels, by adaptive gradient steps of a few rows."""
    w, g2, bias, b2 = np.zeros(1 << HASH_BITS), np.full(1 << HASH_BITS, 1e-2), 0.0, 1e-2
    order = np.random.default_rng(6).permutation(len(y))
    steps = []
    for lo in range(0, len(order), batch):
        rows = order[lo : lo + batch]
        slot, at = np.unique(np.concatenate([examples[i][0] for i in rows]), return_inverse=True)
        steps.append((rows, slot, at, np.concatenate([examples[i][1] for i in rows]), np.repeat(np.arange(len(rows)), [len(examples[i][0]) for i in rows])))
    for _ in range(rounds):
        for rows, slot, at, weight, owner in steps:
            p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[slot][at] * weight, len(rows)) + bias, -30, 30)))
            off = p - y[rows]
            g = np.bincount(at, off[owner] * weight, len(slot)) + ridge * w[slot]
            g2[slot] += g * g
            w[slot] -= rate * g / np.sqrt(g2[slot])
            b2 += off.sum() ** 2
            bias -= rate * off.sum() / np.sqrt(b2)
    return w, bias


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Code (base 3) and count of the vote patterns of each batch."""
    powers = 3 ** np.arange(len(LABELLERS))
    for batch in batches:
        code = [(votes(s) + 1) @ powers for s, *_ in statistics(batch.column(0))]
        u, n = np.unique(np.concatenate(code) if code else np.zeros(0, np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int32()), pa.array(n, pa.int64())], ["code", "n"])


def decode(code: np.ndarray) -> np.ndarray:
    return (code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = 3 ** np.arange(len(LABELLERS))
    for batch in batches:
        code, slots, weights = [], [], []
        for slot, weight, rows, stats in hashed(batch.column(0)):
            code.append((votes(stats) + 1) @ powers)
            key, at = np.unique(rows << HASH_BITS | slot, return_inverse=True)  # by row, then slot
            total = np.bincount(at, weight, len(key)).astype("<f4")
            cuts = np.searchsorted(key, np.arange(1, len(stats)) << HASH_BITS)
            slots += [s.tobytes() for s in np.split((key & ((1 << HASH_BITS) - 1)).astype("<i4"), cuts)]
            weights += [t.tobytes() for t in np.split(total, cuts)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(code) if code else [], pa.int32()), pa.array(slots, pa.binary()), pa.array(weights, pa.binary())], ["code", "slot", "weight"])


def _score(model_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weak, w, bias = model_b.value
        for batch in batches:
            score, posterior = [np.zeros(0)], [np.zeros(0)]
            for slot, weight, rows, stats in hashed(batch.column(1)):
                some = stats[:, 0] > 0
                p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[slot] * weight, len(stats)) + bias, -30, 30)))
                score.append(np.where(some, p, 0.0))
                posterior.append(np.where(some, weak.posterior(votes(stats)), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(score)), pa.array(np.concatenate(posterior))], ["doc_id", "score", "posterior"])

    return run


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, posterior (both 0 to 1, higher: better) of every row of docs, repeated rows included.

    posterior is the weak-label model's, score the hashed linear scorer's. Null texts and texts without a word score 0.
    The scorer is fitted on at most about MAX_SAMPLE texts chosen by hash of the text; votes are counted over all texts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = own.select("text").mapInArrow(_patterns, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    counts = np.array([r.n for r in found], float)
    weak = WeakLabels(decode(np.array([r.code for r in found], np.int64)).reshape(-1, len(LABELLERS)), counts)
    share = min(1.0, MAX_SAMPLE / max(counts.sum(), 1))
    size = 1 << 20
    drawn = own.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text", F.lit(23)), F.lit(size)) < F.lit(int(share * size))))
    rows = sorted(drawn.select("text").mapInArrow(_sparse, "code int, slot binary, weight binary").distinct().collect(), key=lambda r: bytes(r.slot))
    y = weak.posterior(decode(np.array([r.code for r in rows], np.int64)).reshape(-1, len(LABELLERS)))
    w, bias = fit_linear([(np.frombuffer(r.slot, "<i4"), np.frombuffer(r.weight, "<f4").astype(float)) for r in rows], y)
    kind = dict(own.dtypes)["doc_id"]
    return own.mapInArrow(tidy(_score(spark.sparkContext.broadcast((weak, w, bias)))), f"doc_id {kind}, score double, posterior double")
