"""Document fingerprints: one-permutation MinHash with optimal densification, stored as packed low-order bits.

A shingle is five consecutive words (runs of letters and digits, ASCII case folded; a text of fewer words, but any, has one
shingle of them all). Every shingle is hashed once: the top bits say its bin, the rest is its value, each bin keeps its
least. An empty bin takes the value of the first filled bin in its own fixed random order of bins. The low ``bits`` bits of
each bin's value, mixed with the bin's number, are packed to a hex string; two fingerprints' share m of equal bins estimates the likeness as
(m - 2^-bits) / (1 - 2^-bits), which takes out the equalities by chance.

Defined cases
    A null text counts as empty. A text without words has the empty fingerprint, which is like another empty one (1) and
    unlike any other (0). Equal texts have equal fingerprints. Rows with the same doc_id follow one another by their texts, each with its
    own row; a null doc_id comes first. A very long text is a block of its own. The one document of a table is its own next one;
    an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import (U64, mix64, replacing, runs_of_docs, shingle_hashes, span_hashes, splitmix, string_buffers, table, tidy,
                                   text_bytes, word_spans)
from textquarry.llm.token_output import with_parts

DEFAULTS = {"bins": 512, "bits": 4, "width": 5, "block_bytes": 1 << 20, "part_bytes": 8 << 20, "max_parts": 20_000, "block_rows": 2048}

#: texts of this many filled bins, or fewer, look up their empty bins' sources instead of probing for them
FEW_BINS = 64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@functools.lru_cache(4)
def _ranks(bins: int) -> np.ndarray:
    """The place of each bin (column) in each bin's order."""
    out = np.empty((bins, bins), np.int16 if bins < 1 << 15 else np.int32)
    np.put_along_axis(out, _probes(bins), np.arange(bins, dtype=out.dtype)[None, :], axis=1)
    return out


@functools.lru_cache(4)
def _probes(bins: int) -> np.ndarray:
    """For each bin its own random order of all bins."""
    return np.argsort(splitmix(0xD0C5, bins * bins).reshape(bins, bins), axis=1).astype(np.int32)


def text_shingles(buf: np.ndarray, off: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    low = _FOLD[buf]
    starts, ends, first = word_spans(low, off)
    return shingle_hashes(span_hashes(low, starts, ends), first, width)


def codes(buf: np.ndarray, off: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """(uint8 matrix of low bits, documents x bins; which documents have words)."""
    k, n_docs = p["bins"], len(off) - 1
    h, o = text_shingles(buf, off, p["width"])
    some = np.diff(o) > 0
    with_words = np.flatnonzero(some)  # the others have no cells
    n = len(with_words)
    out = np.zeros((n_docs, k), np.uint8)
    if not n:
        return out, some
    shift = U64(64 - (k - 1).bit_length())
    none = U64(0xFFFFFFFFFFFFFFFF)
    least = np.full(n * k, none)
    cell = np.repeat(np.arange(n, dtype=np.int64) * k, np.diff(o)[with_words]) + (h >> shift).astype(np.int64)
    np.minimum.at(least, cell, h & U64((1 << int(shift)) - 1))
    filled = least != none
    # with few filled bins most probes would miss: the one of least rank is taken
    by_doc, n_filled = filled.reshape(n, k), filled.reshape(n, k).sum(axis=1)
    one = np.flatnonzero(n_filled == 1)
    least.reshape(n, k)[one] = least.reshape(n, k)[one, by_doc[one].argmax(axis=1)][:, None]
    ranks = _ranks(k)
    for d in np.flatnonzero((n_filled > 1) & (n_filled <= FEW_BINS)):
        own = np.flatnonzero(by_doc[d])
        values = least[d * k + own]
        least[d * k: (d + 1) * k] = values[ranks[:, own].argmin(axis=1)]  # a filled bin comes first in its own order, or is set again
        least[d * k + own] = values
    empty = np.flatnonzero(~(by_doc | (n_filled <= FEW_BINS)[:, None]).ravel())
    row, col = empty - empty % k, empty % k
    probes = _probes(k)
    for t in range(k):
        if not len(empty):
            break
        at = row + probes[col, t]
        hit = filled[at]
        least[empty[hit]] = least[at[hit]]
        empty, row, col = empty[~hit], row[~hit], col[~hit]
    # mixed with the bin, so that a value that fills several bins meets another one by chance in each of them independently
    least = mix64(least.reshape(n, k) + splitmix(0xB17, k))
    out[with_words] = (least & U64((1 << p["bits"]) - 1)).astype(np.uint8)
    return out, some


def pack(code: np.ndarray, some: np.ndarray, bits: int) -> list[str]:
    """Hex strings of the bins' low bits."""
    b = np.unpackbits(code[:, :, None], axis=2)[:, :, 8 - bits:].reshape(len(code), -1)
    raw = np.packbits(b, axis=1)
    return [r.tobytes().hex() if s else "" for r, s in zip(raw, some)]


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray, bits: int) -> np.ndarray:
    c = 2.0 ** -bits
    est = np.clip(((a == b).mean(axis=1) - c) / (1 - c), 0.0, 1.0) if len(a) else np.zeros(0)
    return np.where(some_a & some_b, est, (some_a == some_b).astype(float))


def fingerprint(docs: DataFrame, col: str = "text", **params) -> DataFrame:
    """``docs`` with a column fingerprint; no shuffle."""
    p = DEFAULTS | params
    docs, schema = replacing(docs, fingerprint="string")

    def run(batches):
        for b in batches:
            buf, off = string_buffers(b.column(b.schema.get_field_index(col)))
            out: list[str] = []
            for i, j in runs_of_docs(off, p["block_bytes"], p["block_rows"]):
                out += pack(*codes(buf[off[i]: off[j]], off[i: j + 1] - off[i], p), p["bits"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "fingerprint"])

    return docs.mapInArrow(tidy(run), schema)


def with_next(docs: DataFrame, n_parts: int) -> DataFrame:
    """Rows dealt to ranges of doc_id (column part), each range with a copy (tail = 1) of the document that follows it.

    The last range gets a copy of the first document. The ranges' first ids are at most n_parts numbers on the driver.
    """
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = with_parts(docs, n_parts, n_parts).withColumn("ord", order)
    firsts = sorted((r["m"], r["part"]) for r in rows.groupBy("part").agg(F.min("ord").alias("m")).collect())
    before = [(m, firsts[i - 1][1]) for i, (m, _) in enumerate(firsts)]
    link = docs.sparkSession.createDataFrame(before or [(0, 0)], "ord long, before int")
    linked = rows.join(F.broadcast(link), "ord", "left")
    deal = F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("tail")), F.struct(F.col("before").alias("part"), F.lit(1).alias("tail")))
    return linked.withColumn("deal", F.explode(F.filter(deal, lambda x: x["part"].isNotNull()))).select(
        "doc_id", "text", "ord", "deal.part", "deal.tail")


def edited_likeness(docs: DataFrame, **params) -> DataFrame:
    """Fingerprints of documents (doc_id, text), of their edited texts, and likenesses to both the edited and the next one.

    One shuffle of the texts, by ranges of doc_id; within a range they stream in order.
    """
    p = DEFAULTS | params
    docs = docs.select("doc_id", "text")
    n_parts = min(p["max_parts"], max(1, -(-text_bytes(docs) // p["part_bytes"])))
    dealt = with_next(docs, n_parts).repartition("part").sortWithinPartitions("part", "tail", "ord", "text")

    def block(rows):
        """rows: (doc_id, part, tail, text) in order; pairs are neighbours of one part, the first of them no copy."""
        texts = [r[3] for r in rows]
        buf, off = string_buffers(pa.array(texts, pa.large_string()))
        code, some = codes(buf, off, p)
        pick = [i for i in range(len(rows) - 1) if not rows[i][2] and rows[i][1] == rows[i + 1][1]]
        edited = []
        for i in pick:
            half = len(texts[i]) // 2
            edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
        buf, off = string_buffers(pa.array(edited, pa.large_string()))
        code_e, some_e = codes(buf, off, p)
        at = np.array(pick, np.int64)
        name, name_e = pack(code[at], some[at], p["bits"]), pack(code_e, some_e, p["bits"])
        return pa.RecordBatch.from_arrays([
            pa.array([rows[i][0] for i in pick], pa.int64()), pa.array([len(texts[i]) for i in pick], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()), pa.array(name, pa.string()), pa.array(name_e, pa.string()),
            pa.array(likeness(code[at], some[at], code_e, some_e, p["bits"])),
            pa.array(likeness(code[at], some[at], code[at + 1], some[at + 1], p["bits"]))],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "part", "tail", "text")]
            for i, j in runs_of_docs(string_buffers(cols[3])[1], p["block_bytes"], p["block_rows"]):
                for r in zip(*(c.slice(i, j - i).to_pylist() for c in cols)):
                    held.append((r[0], r[1], r[2], r[3] or ""))
                    size += len(held[-1][3])
                    if (size >= p["block_bytes"] or len(held) > p["block_rows"]) and len(held) > 1:
                        yield block(held)
                        held, size = held[-1:], len(held[-1][3])
        if len(held) > 1:
            yield block(held)

    return dealt.mapInArrow(tidy(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


QUERIES = {"op6_fingerprint": op6_fingerprint}
