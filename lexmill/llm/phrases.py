"""Phrase collocations from depth-limited count tries.

A first pass counts words and pairs of words by 40 bits of their hashes and keeps a bitmap of those that can be frequent:
a phrase is no more frequent than its words and pairs, so what the bitmap lacks is no part of any candidate, and what it
has too much costs work alone. The second pass builds a trie of up to four words over each shard's runs of such pairs.
Tries are laid out sorted by a hash of language and first two words, cut into ranges of it, and each range is merged from
all shards; the walk from a phrase up to its pair gives the counts of its left parts. Suffix links, joins of a phrase with
the phrase less its first word, give those of its right parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_view, mix, places, saved, small_batches, span_hashes, tidy

FLUSH = 1 << 20  # words of a shard's trie; ids of its words have 21 bits
KEY_BITS = 40  # of a hash, where pairs are only weeded out
FILTER_BITS = 27  # of the bitmap: 16 MB at every size
RANGE_BYTES = 12 << 20  # of text, for each range of tries
BLOCK = 1 << 20  # bytes of text in work at once

#: Fixed values of op13's contract: bytes that end a piece, and those that part words.
_MARKS = b".,;:!?\x0a\x0b\x0c\x0d"
_SPACES = b" \t"

_CUTS, _GAPS = np.zeros(256, bool), np.zeros(256, bool)
_CUTS[list(_MARKS)] = True
_GAPS[list(_MARKS + _SPACES)] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PATH = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("h3", "<u8"), ("h4", "<u8"), ("n", "<i8")])


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def _word_keys(h: np.ndarray, seed: np.uint64) -> np.ndarray:
    return mix(h ^ seed)


def _pair_keys(h: np.ndarray, seed: np.uint64) -> np.ndarray:
    return mix(mix(h[:-1] * _STEP + h[1:]) ^ seed)


def _parts(data: np.ndarray, offs: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of about `size` that end at a row's end or behind a gap between words, longer where a word is."""
    lo, end = int(offs[0]), int(offs[-1])
    while lo < end:
        hi = min(lo + size, end)
        if hi < end:
            row = int(offs[np.searchsorted(offs, hi, "right") - 1])
            if row > lo:
                hi = row
            else:
                gaps = np.flatnonzero(_GAPS[data[lo:hi]])
                stop = int(offs[np.searchsorted(offs, lo, "right")])
                ahead = np.flatnonzero(_GAPS[data[hi:stop]][: size * 64]) if not len(gaps) else gaps
                hi = lo + int(gaps[-1]) + 1 if len(gaps) else hi + int(ahead[0]) + 1 if len(ahead) else stop
        yield lo, hi
        lo = hi


class _Reader:
    """Words of texts as hashes, with the number of the piece that each lies in."""

    def __init__(self) -> None:
        self.pieces = 0

    def words(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """data, starts, ends, hashes, pieces and rows of words, for parts of the column in turn."""
        data, offs = byte_view(column)
        for lo, hi in _parts(data, offs, BLOCK):
            part = data[lo:hi]
            border = np.zeros(hi - lo + 1, bool)
            begin = offs[(offs >= lo) & (offs < hi)] - lo
            border[begin] = True
            word = ~_GAPS[part]
            before, after = np.ones(hi - lo, bool), np.ones(hi - lo, bool)
            before[1:] = ~word[:-1]
            after[:-1] = ~word[1:]
            starts = np.flatnonzero(word & (before | border[:-1]))
            ends = np.flatnonzero(word & (after | border[1:])) + 1
            piece = np.cumsum(border[:-1] | _CUTS[part])
            if len(starts):
                h = span_hashes(data, starts + lo, ends + lo)
                h[h == 0] = 1  # 0 stands for no word
                yield data, starts + lo, ends + lo, h, piece[starts] + self.pieces, np.searchsorted(offs, starts + lo, "right") - 1
            self.pieces += int(piece[-1])


def _by_lang(langs: list[str], rows: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[str, list[np.ndarray]]]:
    """columns split by the language of their rows, in order."""
    names, code = np.unique(np.array(langs, object).astype(str), return_inverse=True)
    of = code[rows]
    order = np.argsort(of, kind="stable")
    at = np.searchsorted(of[order], np.arange(len(names) + 1))
    for k, name in enumerate(names.tolist()):
        if at[k] < at[k + 1]:
            yield name, [c[order[at[k] : at[k + 1]]] for c in columns]


def _shards(batches: Iterator[pa.RecordBatch], texts: dict[int, str] | None = None, wanted=None) -> Iterator[dict[str, tuple[np.ndarray, np.ndarray, int]]]:
    """Hashes and pieces of about FLUSH words by language, and from how many of them phrases start: those of the last
    three words may go on, so they come again with the next shard. texts gets the words that wanted(lang, hashes) marks."""
    reader, held, size = _Reader(), {}, 0

    def shard(last: bool) -> Iterator[dict[str, tuple[np.ndarray, np.ndarray, int]]]:
        nonlocal held, size
        full = {k: [np.concatenate(c) for c in zip(*v, strict=True)] for k, v in held.items()}
        yield {k: (h, p, len(h) if last else max(0, len(h) - 3)) for k, (h, p) in full.items()}
        held = {} if last else {k: [(h[-3:].copy(), p[-3:].copy())] for k, (h, p) in full.items()}
        size = 0
        if texts is not None and len(texts) > 4 * FLUSH:
            stay = {x for v in held.values() for x in v[0][0].tolist()}
            for x in [x for x in texts if x not in stay]:
                del texts[x]

    for batch in batches:
        langs = batch.column(1).to_pylist()
        for data, starts, ends, h, piece, rows in reader.words(batch.column(0)):
            for lang, (x, p, s, e) in _by_lang(langs, rows, h, piece, starts, ends):
                held.setdefault(lang, []).append((x, p))
                size += len(x)
                if texts is not None:
                    u, at = np.unique(x, return_index=True)
                    for k in np.flatnonzero(wanted(lang, u)).tolist():
                        if int(u[k]) not in texts:
                            i = at[k]
                            texts[int(u[k])] = _lowered(data[s[i] : e[i]])
            if size >= FLUSH - BLOCK // 2:
                yield from shard(False)
    if held:
        yield from shard(True)


def _lowered(word: np.ndarray) -> str:
    return word.tobytes().translate(_LOWER).decode()


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _planes(x: np.ndarray) -> bytes:
    """Numbers by byte planes: those of small ones and of small steps are mostly zeros, which a shuffle compresses."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _count_keys(buckets: int):
    """Counts of words and of pairs within pieces by the first bits of their hashes, sorted, in buckets of their range."""
    rest = KEY_BITS - buckets.bit_length() + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            keys = []
            for lang, (h, piece, starts) in shard.items():
                seed = _seed(lang)
                keys.append(_word_keys(h[:starts], seed))
                if len(h) > 1:
                    keys.append(_pair_keys(h, seed)[(piece[:-1] == piece[1:]) & (np.arange(len(h) - 1) < starts)])
            key, n = np.unique(np.concatenate(keys) >> np.uint64(64 - KEY_BITS), return_counts=True)
            bucket = (key >> np.uint64(rest)).astype(np.int64)
            ids, at = np.unique(bucket, return_index=True)
            out = [(int(b), _planes(np.diff(k, prepend=np.uint64(0))), _planes(c.astype("<u4"))) for b, k, c in zip(ids, np.split(key, at[1:]), np.split(n, at[1:]), strict=True)]
            for i in range(0, len(out), 64):
                b, k, c = zip(*out[i : i + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], ["bucket", "key", "n"])

    return run


def _frequent_keys(buckets: int, least: int):
    """The bucket's share of the bitmap, from the merged counts of all shards."""
    slots = max(8, (1 << FILTER_BITS) // buckets)

    def run(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(_numbers(k, "<u8")) for k in table.column("key").to_pylist()])
        n = np.concatenate([_numbers(c, "<u4") for c in table.column("n").to_pylist()]).astype(np.int64)
        order = np.argsort(keys, kind="stable")  # runs that are sorted already: a merge
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1)) != 0)
        often = keys[first][np.add.reduceat(n, first) >= least]
        bits = np.zeros(slots, bool)
        bits[((often >> np.uint64(KEY_BITS - FILTER_BITS)) % np.uint64(slots)).astype(np.int64)] = True
        return pa.table({"bucket": table.column("bucket")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    return run


def _bitmap(docs: DataFrame, buckets: int, least: int) -> np.ndarray:
    """16 MB, of which the driver joins the buckets' shares."""
    counted = docs.mapInArrow(tidy(_count_keys(buckets)), "bucket long, key binary, n binary")
    shares = saved(counted.groupBy("bucket").applyInArrow(_frequent_keys(buckets, least), "bucket long, bits binary"))
    step = max(8, (1 << FILTER_BITS) // buckets) // 8
    out = np.zeros(buckets * step, np.uint8)
    for r in shares.toLocalIterator():
        out[r[0] * step : (r[0] + 1) * step] = np.frombuffer(r[1], np.uint8)
    return out


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys >> np.uint64(64 - FILTER_BITS)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8)) & 1 == 1


def pack_trie(paths: np.ndarray) -> bytes:
    """Sorted distinct paths (_PATH; two words at least, 0 for none; n: how often exactly this path) as a trie in level
    order: of each level the labels, how often a path ends there, and the number of children. Labels are places in a list
    of the trie's words."""
    pair = (paths["h1"][1:] != paths["h1"][:-1]) | (paths["h2"][1:] != paths["h2"][:-1])
    new2 = np.concatenate([[True], pair])
    new3 = (paths["h3"] != 0) & (new2 | np.concatenate([[True], paths["h3"][1:] != paths["h3"][:-1]]))
    new4 = paths["h4"] != 0
    at2, at3, at4 = np.flatnonzero(new2), np.flatnonzero(new3), np.flatnonzero(new4)
    end2 = np.where(paths["h3"][at2] == 0, paths["n"][at2], 0)
    end3 = np.where(paths["h4"][at3] == 0, paths["n"][at3], 0)
    kids3 = np.bincount(np.searchsorted(at2, at3, "right") - 1, minlength=len(at2)) if len(at3) else np.zeros(len(at2), np.int64)
    kids4 = np.bincount(np.searchsorted(at3, at4, "right") - 1, minlength=len(at3)) if len(at4) else np.zeros(len(at3), np.int64)
    words, label = np.unique(np.concatenate([paths["h1"][at2], paths["h2"][at2], paths["h3"][at3], paths["h4"][at4]]), return_inverse=True)
    sizes = np.array([len(words), len(at2), len(at3), len(at4)], "<i8")
    levels = [end2, kids3, end3, kids4, paths["n"][at4]]
    return sizes.tobytes() + _planes(np.diff(words, prepend=np.uint64(0))) + _planes(label.astype("<u4")) + b"".join(_planes(x.astype("<u8")) for x in levels)


def unpack_trie(raw: bytes) -> np.ndarray:
    """The paths of pack_trie, in another order."""
    n1, n2, n3, n4 = np.frombuffer(raw, "<i8", 4).tolist()
    at, parts = 32, []
    for n, kind in ((n1, "<u8"), (2 * n2 + n3 + n4, "<u4"), (n2, "<u8"), (n2, "<u8"), (n3, "<u8"), (n3, "<u8"), (n4, "<u8")):
        width = np.dtype(kind).itemsize
        parts.append(_numbers(raw[at : at + width * n], kind))
        at += width * n
    steps, label, end2, kids3, end3, kids4, end4 = parts
    h1, h2, h3, h4 = np.split(np.cumsum(steps)[label], np.cumsum([n2, n2, n3]))
    up3 = np.repeat(np.arange(n2), kids3.astype(np.int64))
    up4 = np.repeat(np.arange(n3), kids4.astype(np.int64))
    out = np.zeros(n2 + n3 + n4, _PATH)
    out["h1"], out["h2"] = np.concatenate([h1, h1[up3], h1[up3][up4]]), np.concatenate([h2, h2[up3], h2[up3][up4]])
    out["h3"], out["h4"] = np.concatenate([np.zeros(n2, np.uint64), h3, h3[up4]]), np.concatenate([np.zeros(n2 + n3, np.uint64), h4])
    out["n"] = np.concatenate([end2, end3, end4])
    return out[out["n"] > 0]


def merge_paths(paths: np.ndarray) -> np.ndarray:
    """Paths in order, equal ones as one with their counts added."""
    order = np.lexsort((paths["h4"], paths["h3"], paths["h2"], paths["h1"]))
    paths = paths[order]
    new = np.ones(len(paths), bool)
    new[1:] = np.any([paths[c][1:] != paths[c][:-1] for c in ("h1", "h2", "h3", "h4")], axis=0)
    first = np.flatnonzero(new)
    out = paths[first]
    out["n"] = np.add.reduceat(paths["n"], first) if len(first) else out["n"]
    return out


def _shard_tries(ranges: int, bits_b):
    bits_of = ranges.bit_length() - 1

    def part_of(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - bits_of)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, texts = bits_b.value, {}
        seeds: dict[str, np.uint64] = {}

        def wanted(lang: str, h: np.ndarray) -> np.ndarray:
            return _has(bits, _word_keys(h, seeds.setdefault(lang, _seed(lang))))

        for shard in _shards(batches, texts, wanted):
            rows = []
            for lang, (h, piece, starts) in shard.items():
                seed = _seed(lang)
                one = _has(bits, _word_keys(h, seed))
                depth = np.zeros(len(h) + 3, np.int64)
                depth[: len(h)] = one
                pairs = _pair_keys(h, seed)
                two = np.zeros(len(h) + 2, bool)
                near = np.flatnonzero((piece[:-1] == piece[1:]) & one[:-1] & one[1:])
                two[near] = _has(bits, pairs[near])
                three = two[:-1] & two[1:]
                depth[: len(h)] += two[: len(h)]
                depth[: len(h)] += three[: len(h)]
                depth[: len(h)] += (three[:-1] & three[1:])[: len(h)]
                depth = depth[:starts]
                word, n = np.unique(h[:starts][depth > 0], return_counts=True)
                own = part_of(_word_keys(word, seed))
                at = np.flatnonzero(depth > 1)
                paths = np.zeros(len(at), _PATH)
                padded = np.concatenate([h, np.zeros(3, np.uint64)])
                for k in range(4):
                    paths[f"h{k + 1}"] = np.where(depth[at] > k, padded[at + k], np.uint64(0))
                paths["n"] = 1
                paths = merge_paths(paths)
                of = part_of(mix(mix(paths["h1"] * _STEP + paths["h2"]) ^ seed))
                order = np.argsort(of, kind="stable")  # paths of a pair stay together and sorted
                paths, of = paths[order], of[order]
                by_word = np.argsort(own, kind="stable")
                word, n, own = word[by_word], n[by_word], own[by_word]
                rows.append((int(part_of(_word_keys(np.zeros(1, np.uint64), seed))[0]), lang, starts, None, [], [], []))
                for r in np.union1d(of, own).tolist():
                    a, b = np.searchsorted(of, [r, r + 1])
                    c, d = np.searchsorted(own, [r, r + 1])
                    names = word[c:d].tolist()
                    rows.append((r, lang, 0, pack_trie(paths[a:b]) if a < b else None, word[c:d].view(np.int64).tolist(), n[c:d].tolist(), [texts[w] for w in names]))
            for i in range(0, len(rows), 256):
                cols = list(zip(*rows[i : i + 256], strict=True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["range", "lang", "total", "trie", "hash", "n", "word"])

    return run


_NODES = "lang string, len int, h1 long, h2 long, h3 long, h4 long, word string, a long, l2 long, l3 long"


def _merge_range(least: int):
    """Frequent nodes of one range, from the tries of all shards, with the counts on the way up to their pair."""

    def nodes(lang: str, blocks: pa.Table) -> list[tuple]:
        out = [(lang, 0, 0, 0, 0, 0, None, sum(blocks.column("total").to_pylist()), None, None)]
        counts: dict[int, int] = {}
        names: dict[int, str] = {}
        for hs, ns, ws in zip(*(blocks.column(c).to_pylist() for c in ("hash", "n", "word")), strict=True):
            for h, n, w in zip(hs, ns, ws, strict=True):
                counts[h] = counts.get(h, 0) + n
                if names.setdefault(h, w) != w:
                    raise ValueError(f"two words of one hash: {w!r} and {names[h]!r}")
        out += [(lang, 1, h, 0, 0, 0, names[h], n, None, None) for h, n in counts.items() if n >= least]
        tries = [unpack_trie(t) for t in blocks.column("trie").to_pylist() if t is not None]
        if tries:
            paths = merge_paths(np.concatenate(tries))
            h = np.stack([paths[f"h{k}"] for k in (1, 2, 3, 4)], 1)
            new2 = np.concatenate([[True], (h[1:, :2] != h[:-1, :2]).any(1)])
            new3 = new2 | np.concatenate([[True], h[1:, 2] != h[:-1, 2]])
            two, three = np.cumsum(new2) - 1, np.cumsum(new3) - 1
            f2, f3 = np.add.reduceat(paths["n"], np.flatnonzero(new2)), np.add.reduceat(paths["n"], np.flatnonzero(new3))
            h = h.view(np.int64)
            for k, mark, f in ((2, new2, f2[two]), (3, new3 & (h[:, 2] != 0), f3[three]), (4, h[:, 3] != 0, paths["n"])):
                at = np.flatnonzero(mark & (f >= least))
                label = h[at].copy()
                label[:, k:] = 0
                l2, l3 = f2[two[at]].tolist() if k > 2 else [None] * len(at), f3[three[at]].tolist() if k > 3 else [None] * len(at)
                out += [(lang, k, *hs, None, a, x, y) for hs, a, x, y in zip(label.tolist(), f[at].tolist(), l2, l3, strict=True)]
        return out

    def run(table: pa.Table) -> pa.Table:
        rows = []
        for lang in sorted(set(table.column("lang").to_pylist())):
            rows += nodes(lang, table.filter(pa.compute.equal(table.column("lang"), lang)))
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 4, pa.string(), *[pa.int64()] * 3]
        names = [c.split()[0] for c in _NODES.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def phrase_nodes(docs: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row (a language and a range) of len 0 with its count of words in a, and a row for each word and each phrase of
    two to four words that occurs at least `least` times: lang, len, h1 to h4 (hashes of its words), word (len 1), a, and
    the counts l2 and l3 of its first two and three words, where longer."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << min(20, max(6, math.ceil(math.log2(size / RANGE_BYTES + 1))))
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(docs, ranges, least))
    shards = docs.mapInArrow(tidy(_shard_tries(ranges, bits)), "range long, lang string, total long, trie binary, hash array<long>, n array<long>, word array<string>")
    out = saved(shards.groupBy("range").applyInArrow(_merge_range(least), _NODES))
    bits.destroy()
    return out


def collocations(docs: DataFrame, least: int = 30, most: int = 2000, covered: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first `most` phrases of two to four words of each language by score: lang, rank, phrase, a, l, r, n, score.

    A-Z count as a-z. Phrases lie within pieces, which end at .,;:!? and line ends; words are parted by spaces and tabs.
    a: occurrences, overlaps included, at least `least`; l and r: those of the parts at the cut with the lowest
    floor(2000000 a / (l + r)), the first of equal ones; n: words of the language. A phrase inside a longer one that has
    at least `covered` per cent of its occurrences goes. Counts are exact: words go by 64-bit hashes, and two words of
    one hash are an error. Null texts are empty, null languages `und`. Repeated rows count as often as they occur. Texts
    of any length are read in parts. Without candidates there is no row; extra columns play no part.
    """
    nodes = phrase_nodes(docs, least, text_col, lang_col)
    words = nodes.where("len = 1").select("lang", "h1", "word", F.col("a").alias("f1"))
    total = nodes.where("len = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    none = F.lit(0).cast("long")
    grown, tail = [], words.select("lang", F.col("h1").alias("h2"), none.alias("h3"), none.alias("h4"), F.col("word").alias("rest"), F.array("f1").alias("right"))
    for k in (2, 3, 4):
        told = nodes.where(F.col("len") == k).drop("word", "len").join(tail, ["lang", "h2", "h3", "h4"]).join(words, ["lang", "h1"])
        left = F.array(*["f1", "l2", "l3"][: k - 1])
        told = saved(told.select("lang", "h1", "h2", "h3", "h4", "a", F.concat_ws(" ", "word", "rest").alias("phrase"), left.alias("left"), "right"))
        grown.append(told)
        tail = told.select("lang", F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("h3").alias("h4"), F.col("phrase").alias("rest"), F.concat(F.array("a"), "right").alias("right"))
    two, three, four = grown
    inner = [(three, "h1", "h2", none), (three, "h2", "h3", none), (four, "h1", "h2", "h3"), (four, "h2", "h3", "h4"), (four, "h1", "h2", none), (four, "h2", "h3", none), (four, "h3", "h4", none)]
    parts = [t.select("lang", F.col(x).alias("h1"), F.col(y).alias("h2"), (F.col(z) if isinstance(z, str) else z).alias("h3"), F.col("a").alias("longer")) for t, x, y, z in inner]
    above = reduce(DataFrame.unionAll, parts).groupBy("lang", "h1", "h2", "h3").agg(F.max("longer").alias("longer"))
    short = two.unionAll(three).join(above, ["lang", "h1", "h2", "h3"], "left").where(F.expr(f"longer is null or 100 * longer < {covered} * a"))
    kept = reduce(DataFrame.unionAll, [t.select("lang", "phrase", "a", "left", "right") for t in (short, four)])
    score = "cast(cast(2000000 as decimal(38, 0)) * a div (cast(l as decimal(20, 0)) + r) as bigint)"
    cuts = kept.select("lang", "phrase", "a", F.posexplode(F.arrays_zip("left", "right")).alias("k", "cut")).select("lang", "phrase", "a", "k", F.col("cut.left").alias("l"), F.col("cut.right").alias("r"))
    cut = F.min(F.struct(F.expr(score).alias("score"), "k", "l", "r")).alias("cut")
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), cut).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    placed = places(best.select(F.col("lang").alias("grp"), (-F.col("score")).alias("score_down"), (-F.col("a")).alias("a_down"), "phrase", "l", "r"), ["score_down", "a_down", "phrase"])
    first = placed.where(F.col("idx") < most).select(F.col("grp").alias("lang"), (F.col("idx") + 1).alias("rank"), "phrase", (-F.col("a_down")).alias("a"), "l", "r", (-F.col("score_down")).alias("score"))
    return first.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
