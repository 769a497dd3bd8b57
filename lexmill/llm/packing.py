"""Order-preserving packing by dynamic programming.

Token positions that end a document (free) or a sentence (penalty `inside`) are the allowed cuts; a sentence longer than
1/32 of a window can be cut at each such part too (penalty `broken`), so text without sentence ends fills windows as well.
f(j) = min over i with S(j) - S(i) <= size of f(i) + (size - S(j) + S(i)) + penalty(j); as S(i) + f(i) is all that
depends on i, a monotone queue over the sliding window finds each minimum in constant amortised time.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_view, chunks, small_batches, tidy

END_OF_TEXT = 1
CHUNK = 4 << 20  # bytes of text tokenised together
GRID = 32  # parts of a window: sentences longer than one can be cut between them
ENDING = r"[.!?。！？।؟…][\"'”’»)\]]*$|\n"  # of a word that ends a sentence
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def plan_cuts(ends: np.ndarray, penalty: np.ndarray, size: int, open_end: bool = False) -> list[int]:
    """Indexes into ends (ascending token positions, the last closes the block) of the cheapest cuts.

    Gaps between neighbours must be at most size. With open_end the last window's padding is free: more will follow.
    """
    pos = [0, *ends.tolist()]
    pen = [0.0, *penalty.tolist()]
    n = len(pos)
    key, back = [0.0] * n, [0] * n  # key: S(i) + f(i)
    queue, head = [0], 0
    for j in range(1, n):
        low = pos[j] - size
        while pos[queue[head]] < low:
            head += 1
        i = queue[head]
        if open_end and j == n - 1:
            i = min((k for k in range(j) if pos[k] >= low), key=lambda k: key[k] - pos[k])
        back[j] = i
        key[j] = k = key[i] + size + pen[j]
        while len(queue) > head and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    out, j = [], n - 1
    while j:
        out.append(j - 1)
        j = back[j]
    return out[::-1]


class _Words:
    """Token ids of space-delimited words, kept for words met before. Encoding word by word equals encoding the text:
    the tokenizer drops white space, never joins across it, and parts letters from punctuation."""

    def __init__(self, path: str, most: int = 500_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self._reset()

    def _reset(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.size, self.begin = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in store, and where each of the distinct words begins there and how many ids it has."""
        at = pc.index_in(words, self.known)
        if at.null_count:
            if len(self.known) and len(self.known) + at.null_count > self.most:
                self._reset()
                at = pc.index_in(words, self.known)
            new = words.filter(at.is_null())
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(new.to_pylist(), add_special_tokens=False)]
            size = np.fromiter(map(len, coded), np.int64, len(coded))
            self.known = pa.concat_arrays([self.known, new])
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(coded), np.uint32, int(size.sum()))])
            fresh = at.is_null().to_numpy(zero_copy_only=False)
            at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).copy()
            at[fresh] = len(self.known) - len(new) + np.arange(len(new))
        else:
            at = at.to_numpy(zero_copy_only=False)
        return self.ids, self.begin[at], self.size[at]


def merged(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts of batches together, up to about `most` bytes: looking words up in the store has a cost a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        ids += batch.column(0).to_pylist()
        texts.append(batch.column(1))
        size += batch.column(1).nbytes
        if size >= most:
            yield ids, pa.concat_arrays(texts)
            ids, texts, size = [], [], 0
    if ids:
        yield ids, pa.concat_arrays(texts)


def tokenize(column: pa.Array, words: _Words, most: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row its ids, END_OF_TEXT last, and the positions after which a sentence ends. Null counts as empty. About
    `most` bytes of text, one row at least, are in work at once."""
    for lo, hi in chunks(byte_view(column)[1], most):
        part = pc.fill_null(column.take(pa.array(np.arange(lo, hi))).cast(pa.string()), "")  # a copy without an offset
        # Case is dropped anyway, and a mark behind a letter is a word of its own: so words recur more often.
        part = pc.replace_substring(pc.ascii_lower(part), "\n", " \n ")
        part = pc.replace_substring_regex(part, r"([a-z0-9])([.,!?;:])( |$)", r"\1 \2\3")
        split = pc.split_pattern(part, " ")
        coded = split.flatten().dictionary_encode()
        ids, begin, size = words.encode(coded.dictionary)
        closing = pc.match_substring_regex(coded.dictionary, ENDING).to_numpy(zero_copy_only=False)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        offs = split.offsets.to_numpy().astype(np.int64)
        offs = offs - offs[0]
        n = size[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = ids[np.arange(ends[-1]) + np.repeat(begin[code] - ends[:-1], n)]
        stop = closing[code]
        for r in range(len(part)):
            a, b = int(offs[r]), int(offs[r + 1])
            first, total = ends[a], int(ends[b] - ends[a])
            out = np.empty(total + 1, np.uint32)
            out[:-1] = flat[first : first + total]
            out[-1] = END_OF_TEXT
            stops = ends[a + 1 : b + 1][stop[a:b]] - first
            stops = stops[(stops > 0) & (stops < total)]  # ascending; equal where a mark adds no id
            yield out, stops[np.concatenate([[True], stops[1:] != stops[:-1]])] if len(stops) else stops


def _packer(path: str, size: int, inside: float, broken: float, block: int, keep_ids: bool, text_bytes: int, words_kept: int):
    def emit(shard: int, serial: int, docs: list, cuts: np.ndarray, total: int) -> tuple[list, list, int]:
        """Pieces up to position total; docs: [id, ids, start in the document, its tokens]. Returns also what is left."""
        rows, edges, k, at = [], [0, *cuts.tolist()], 0, 0
        left = []
        for doc, ids, start, n in docs:
            done = 0
            while done < len(ids) and at < total:
                while edges[k + 1] <= at:
                    k += 1
                take = min(edges[k + 1] - at, len(ids) - done)
                piece = ids[done : done + take]
                rows.append((doc, start + done, take, zlib.crc32(piece.astype("<u4").tobytes()), n, (shard << 40) | (serial + k), at - edges[k], piece.astype(np.int32) if keep_ids else None))
                done += take
                at += take
            if done < len(ids):
                left.append([doc, ids[done:], start + done, n])
        return rows, left, serial + len(cuts)

    step = max(1, size // GRID)

    def cut(docs: list, stops: list, last: bool) -> tuple[np.ndarray, int]:
        """Cut positions of the block; all but the last window are final, unless the block is the last."""
        length = np.array([len(d[1]) for d in docs])
        end = np.cumsum(length)
        begin = end - length
        soft = [s + b for s, b in zip(stops, begin, strict=True)]
        inner = np.concatenate(soft) if soft else np.zeros(0, np.int64)
        pos = np.union1d(inner, end)
        gaps = np.diff(pos, prepend=0)
        pen = np.where(np.isin(pos, end), 0.0, inside)
        if (wide := gaps > step).any():  # no boundary near: a cut every `step` tokens
            extra = np.concatenate([np.arange(p - g + step, p, step) for p, g in zip(pos[wide], gaps[wide], strict=True)])
            pos, pen = np.concatenate([pos, extra]), np.concatenate([pen, np.full(len(extra), broken)])
            order = np.argsort(pos)
            pos, pen = pos[order], pen[order]
        cuts = pos[plan_cuts(pos, pen, size, open_end=not last)]
        if not last:
            cuts = cuts[:-1]
        return cuts, int(cuts[-1]) if len(cuts) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, serial, words = TaskContext.get().partitionId(), 0, _Words(path, words_kept)
        docs, stops, held = [], [], 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal docs, stops, held, serial
            cuts, total = cut(docs, stops, last)
            rows, left, serial = emit(shard, serial, docs, cuts, total)
            kept = len(docs) - len(left)
            if left:
                gone = len(docs[kept][1]) - len(left[0][1])
                stops = stops[kept:]
                stops[0] = stops[0][stops[0] > gone] - gone
            else:
                stops = []
            docs, held = left, sum(len(d[1]) for d in left)
            for lo in range(0, len(rows), 4000):
                cols = list(zip(*rows[lo : lo + 4000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.list_(pa.int32()))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for names, texts in merged(batches, text_bytes):
            for doc, (ids, stop) in zip(names, tokenize(texts, words, text_bytes), strict=True):
                docs.append([doc, ids, 0, len(ids)])
                stops.append(stop)
                held += len(ids)
                if held >= block:
                    yield from flush(False)
        if docs:
            yield from flush(True)

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, inside: float = 8.0, broken: float = 24.0, block: int = 200_000, keep_ids: bool = True, text_bytes: int = CHUNK, words_kept: int = 500_000) -> DataFrame:
    """Pieces of documents placed in sequences of at most `size` tokens, in the order of the table's partitions.

    Each partition packs its own rows in blocks of `block` tokens, and the last window of a block moves on to the next,
    so memory is bounded and only a partition's last sequence can be short. One row a piece: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id (partition and serial), offset, ids (null unless keep_ids). Null and empty texts
    are their end token alone. Repeated rows are packed as often as given; null ids stay null. text_bytes (of text
    tokenised together) and words_kept (in a task's store of words) trade memory for time; the rows are the same.
    """
    small_batches(docs.sparkSession, 2_000)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(_packer(tokenizer_path, size, inside, broken, block, keep_ids, text_bytes, words_kept)), SCHEMA)
