"""Shared folder, table materialisation and vectorised word hashing for the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


BATCH_BYTES = 2 << 20  # of an Arrow batch: whole texts can be long, and a batch is in memory twice
_written: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all tasks run in this
    process (master local, as in tests) a local one is set; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lexmill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage of df: write it as a table in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}.parquet"
    for paths in _written:
        paths.append(path)
    df.write.option("parquet.block.size", 16 << 20).parquet(path)  # writers hold a row group in memory
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def tables_written() -> Iterator[list[str]]:
    """Paths of the tables that saved() writes within."""
    paths: list[str] = []
    _written.append(paths)
    try:
        yield paths
    finally:
        _written.remove(paths)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder whose readers have ended."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        at = hadoop.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def places(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (with `grp`) and idx, each row's place from 0 in its group by order, and `width`, the rows of the group.

    Rows are dealt by range of (grp, order); a row's place is its place in its partition and the rows of its group ahead
    of it, so a group may be of any size. rows must not have columns part, first and ahead.
    """
    spread = saved(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("part", F.monotonically_increasing_id()))
    at, part = F.col("part"), F.shiftright("part", 33)
    runs = spread.groupBy("grp", part.alias("part")).agg(F.min(at).alias("first"), F.count("*").alias("ahead"))
    by_grp = Window.partitionBy("grp")
    runs = runs.select("grp", "part", "first", (F.sum("ahead").over(by_grp.orderBy("part")) - F.col("ahead")).alias("ahead"), F.sum("ahead").over(by_grp).alias("width"))
    told = spread.withColumn("idx", at).withColumn("part", part).join(runs, ["grp", "part"])
    return told.withColumn("idx", F.col("idx") - F.col("first") + F.col("ahead")).drop("part", "first", "ahead")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound the bytes and rows of an Arrow batch in this session; smaller bounds that it has stay."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", rows)):
        held = spark.conf.get(key, None)
        if not held or not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, most)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving freed memory back to the system at a task's end: Python workers outlive their tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
        if trim:
            trim(0)

    return tidied


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for inner use that clash with none of df's, without regard to case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE[LOWER]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    a = column.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    offs = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    raw = a.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)), offs


def chunks(offs: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes, one row at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each white-space delimited word (contract: [^\\x20\\x09-\\x0D]+), and its row."""
    lo, hi = int(offs[0]), int(offs[-1])
    part = data[lo:hi]
    if not len(part):
        z = np.zeros(0, np.int64)
        return z, z, z
    sp = SPACE[part]
    first = np.zeros(len(part), bool)
    begin = offs[:-1] - lo
    first[begin[begin < len(part)]] = True
    first[0] = True
    before = first.copy()
    before[1:] |= sp[:-1]
    after = np.ones(len(part), bool)
    after[:-1] = sp[1:] | first[1:]
    starts = np.flatnonzero(~sp & before)
    ends = np.flatnonzero(~sp & after) + 1
    rows = np.searchsorted(offs - lo, starts, "right") - 1
    return starts + lo, ends + lo, rows


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, block: int = 1 << 16) -> np.ndarray:
    """64-bit hash of each byte span (ascending, disjoint), by differences of a running polynomial."""
    table = _BYTE_LOWER if lower else _BYTE
    out = np.empty(len(starts), np.uint64)
    for b in range(0, len(starts), block):
        s, e = starts[b : b + block], ends[b : b + block]
        lo, hi = int(s[0]), int(e[-1])
        up, down = _power(hi - lo + 1)
        run = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * up[: hi - lo], out=run[1:])
        out[b : b + block] = (run[e - lo] - run[s - lo]) * down[s - lo]
    return mix(out + (ends - starts).astype(np.uint64))


_SHINGLE = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles of `width` words; see op7's contract for short rows."""
    data, offs = byte_view(column)
    for i, j in chunks(offs):
        o = offs[i : j + 1]
        starts, ends, rows = word_spans(data, o)
        h = span_hashes(data, starts, ends)
        counts = np.bincount(rows, minlength=j - i)
        at = np.concatenate([[0], np.cumsum(counts)])
        full = h[: max(len(h) - width + 1, 0)].copy()
        for k in range(1, width):
            full = full * _SHINGLE + h[k : k + len(full)]
        full = mix(full)
        for r in range(j - i):
            a, n = int(at[r]), int(counts[r])
            if n >= width:
                s = np.sort(full[a : a + n - width + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s
            elif n:
                x = np.uint64(n)
                for w in h[a : a + n]:
                    x = mix(np.array([x], np.uint64) * _SHINGLE + w)[0]
                yield np.array([x], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
