"""Helpers that the operators share: shared storage, sizing, and vectorised text hashing for use inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators.shipping import ship_package
from textquarry.operators.storage import clear_stored, discard, scratch, shared_dir, stored, stored_dir  # noqa: F401

U64 = np.uint64


# ---------------------------------------------------------------- session


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a stored table; its Python workers get the package first, wherever the caller's frames come from."""
    ship_package(df.sparkSession)
    return stored(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of all texts; an aggregate of one row."""
    return int(docs.agg(F.sum(F.octet_length(F.col(col)))).first()[0] or 0)


# ---------------------------------------------------------------- memory of tasks


def checked_broadcast(df: DataFrame, rows: int, size: str | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """``df`` marked for broadcast only if it is counted to be within ``rows``, and the column ``size`` adds up to ``most_bytes`` at most."""
    few = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(size if size else F.lit(0)).alias("size")).first()
    return F.broadcast(df) if few["n"] <= rows and (few["size"] or 0) <= most_bytes else df


def _give_back() -> None:
    """Hand freed memory back to the system: a Python worker stays for later tasks, beside whatever runs then."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(fn):
    """``fn`` of mapInArrow (an iterator of batches) that gives freed memory back when it ends."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            _give_back()

    return run


def tidy_group(fn):
    """The same for a function of applyInArrow on a group."""

    def run(t: pa.Table) -> pa.Table:
        try:
            return fn(t)
        finally:
            _give_back()

    return run


def tidy_groups(fn):
    """The same for a function of applyInArrow on two groups."""

    def run(t: pa.Table, u: pa.Table) -> pa.Table:
        try:
            return fn(t, u)
        finally:
            _give_back()

    return run


# ---------------------------------------------------------------- text in tasks


def string_buffers(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes uint8, offsets int64 of n+1) of a string or binary column; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset: arr.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]: off[-1]], off - off[0]


def runs_of_docs(offsets: np.ndarray, limit: int, most: int = 1 << 62):
    """Slices (i, j) of at most ``most`` documents whose texts add up to about ``limit`` bytes; a longer document is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, i + most, max(j, i + 1))
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on a fresh or owned array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def splitmix(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(U64(seed) + np.arange(1, n + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))


_CHUNK = [U64(int(x) | 1) for x in splitmix(0x5EED, 3)]
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first k bytes of a word


def words8(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on, zeros behind the end, as little-endian words; a view, not a copy a position."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def chunks_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans in pieces of 8 bytes: (place of each piece, its number in the span, its mask, first piece of each span)."""
    n = np.maximum(1, (ends - starts + 7) >> 3)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    if len(n) == n.sum():
        return starts, np.zeros(len(n), np.int64), _TAIL[ends - starts], first
    number = np.arange(int(n.sum())) - np.repeat(first, n)
    at = np.repeat(starts, n) + 8 * number
    return at, number, _TAIL[np.minimum(8, np.repeat(ends, n) - at)], first


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of ``buf``; equal spans have equal hashes wherever they stand.

    Each piece of 8 bytes is mixed with its number before the pieces add up, so no pattern of bytes collides by construction.
    """
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    at, number, mask, first = chunks_of(starts, ends)
    x = (words8(buf)[at] & mask) * _CHUNK[0]
    x ^= number.astype(np.uint64) * _CHUNK[1]
    x = mix64(x)
    if len(x) > len(starts):
        x = np.add.reduceat(x, first)
    return mix64(x + (ends - starts).astype(np.uint64) * _CHUNK[2])


# bytes of words: ASCII letters and digits, and every byte of a character outside ASCII
WORD_BYTE = np.zeros(256, bool)
for _lo, _hi in ((48, 57), (65, 90), (97, 122), (128, 255)):
    WORD_BYTE[_lo: _hi + 1] = True


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all documents: (start, end, first word of each document with the total as last entry)."""
    w = WORD_BYTE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[1:-1] = w[1:] != w[:-1]
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    if len(cut) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    starts, ends = cut[:-1], cut[1:]
    keep = w[starts]
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets, side="left")


_SHINGLE = [U64(int(x) | 1) for x in splitmix(0xC0FFEE, 16)]


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word n-grams per document; a document of fewer words (but any) has one, of all its words.

    Returns (hashes, offsets per document); repeats are kept, in text order.
    """
    counts = np.diff(first)
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        h[: n - k] += words[k:] * _SHINGLE[k]
    mix = mix64(h)
    per = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_off = np.concatenate([[0], np.cumsum(per)])
    idx = np.arange(out_off[-1]) - np.repeat(out_off[:-1] - first[:-1], per)
    out = mix[idx]
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        a = np.zeros(1, np.uint64)
        for k in range(int(counts[d])):
            a += words[first[d] + k: first[d] + k + 1] * _SHINGLE[k]
        out[out_off[d]] = mix64(a + U64(0xABCD) * U64(int(counts[d])))[0]
    return out, out_off


def replacing(docs: DataFrame, **new: str) -> tuple[DataFrame, "StructType"]:
    """(docs without columns of the new names, its schema with them appended): added columns replace clashing ones."""
    from pyspark.sql.types import StructType

    ship_package(docs.sparkSession)
    rest = docs.drop(*[c for c in docs.columns if c.lower() in {n.lower() for n in new}])
    return rest, StructType(list(rest.schema.fields) + StructType.fromDDL(", ".join(f"{k} {v}" for k, v in new.items())).fields)
