"""Static range asymmetric numeral system over many interleaved lanes, in numpy.

A block is laid out row by row: token t belongs to lane ``t % lanes``, and all lanes of a row are coded together. States
are 64 bits wide, renormalised by 32-bit words; frequencies add up to 2^``PROB_BITS``, or more for a vocabulary of a million
ids and beyond. Decoding runs forwards. Every
``CHECK_ROWS`` rows a checkpoint keeps all lanes' states and the place in the words, so that parts of a block can be decoded on
their own; each such part has a crc32 of its ids.

Block, little-endian: magic "TQR1", u32 lanes, u64 tokens, u32 checkpoints, then for each checkpoint u64 word position,
u32 crc32 of the part's ids (as unsigned 16- or 32-bit, as stored in u8 ``width``), and the lanes' u64 states; then u64 word
count and the words. A crc32 of all of it ends the block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U64 = np.uint64
MAGIC = b"TQR1"
PROB_BITS = 20
CHECK_ROWS = 256
MAX_LANES = 2048
LOW = 1 << 32
_HEAD = struct.Struct("<4sIQIB")


def normalise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to a power of two, at least 1 for every symbol, near the counts' proportions."""
    n = len(counts)
    total = 1 << max(PROB_BITS, n.bit_length() + 2)
    c = counts.astype(np.float64)
    spare = total - n
    f = 1 + np.floor(c / max(c.sum(), 1.0) * spare).astype(np.int64)
    left = total - int(f.sum())
    f[int(np.argmax(c))] += left
    return f.astype(np.uint64)


class Table:
    """The shared frequency table: frequencies, starts, and the symbol of each slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.bits = int(self.freq.sum()).bit_length() - 1
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), self.freq.astype(np.int64))
        self.limit = self.freq << U64(64 - self.bits - (0 if self.freq.max() < (1 << self.bits) else 1))


def lanes_for(n: int) -> int:
    """A power of two up to MAX_LANES, such that every lane has some 128 tokens."""
    return 1 << max(0, min(MAX_LANES, n // 128).bit_length() - 1) if n >= 256 else 1


def encode(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = lanes_for(n)
    rows = -(-n // lanes)
    wide = 2 if len(table.freq) <= 1 << 16 else 4
    kept = ids.astype("<u2" if wide == 2 else "<u4")
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, bytes]] = []  # words still to come after this row boundary, crc, states
    written = 0
    for r in range(rows - 1, -1, -1):
        s = ids[r * lanes: min(n, (r + 1) * lanes)]
        m = len(s)
        f = table.freq[s]
        x = state[:m]
        full = x >= table.limit[s]
        if full.any():
            out = (x[full] & U64(0xFFFFFFFF)).astype("<u4")
            words.append(out)
            written += len(out)
            x = np.where(full, x >> U64(32), x)
        q = x // f
        state[:m] = (q << U64(table.bits)) + (x - q * f) + table.start[s]
        if r % CHECK_ROWS == 0:
            crc = zlib.crc32(kept[r * lanes: min(n, (r + CHECK_ROWS) * lanes)].tobytes())
            marks.append((written, crc, state.astype("<u8").tobytes()))
    marks.reverse()
    words.reverse()
    body = b"".join(w.tobytes() for w in words)
    parts = [_HEAD.pack(MAGIC, lanes, n, len(marks), wide)]
    for after, crc, st in marks:
        parts += [struct.pack("<QI", written - after, crc), st]
    parts += [struct.pack("<Q", written), body]
    blob = b"".join(parts)
    return blob + struct.pack("<I", zlib.crc32(blob))


def decode(blob: bytes, table: Table, part: int | None = None) -> np.ndarray:
    """All ids of a block, or those of one checkpoint's part."""
    if zlib.crc32(memoryview(blob)[:-4]) != struct.unpack("<I", blob[-4:])[0]:
        raise ValueError("block checksum differs")
    magic, lanes, n, checks, wide = _HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    at, marks = _HEAD.size, []
    for _ in range(checks):
        pos, crc = struct.unpack_from("<QI", blob, at)
        marks.append((pos, crc, at + 12))
        at += 12 + 8 * lanes
    (n_words,) = struct.unpack_from("<Q", blob, at)
    words = np.frombuffer(blob, "<u4", n_words, at + 8)
    rows = -(-n // lanes)
    outs = []
    for k in range(checks) if part is None else [part]:
        pos, crc, st = marks[k]
        state = np.frombuffer(blob, "<u8", lanes, st).astype(np.uint64)
        first, last = k * CHECK_ROWS, min(rows, (k + 1) * CHECK_ROWS)
        out = np.empty(min(n, last * lanes) - first * lanes, "<u2" if wide == 2 else "<u4")
        for r in range(first, last):
            m = min(n, (r + 1) * lanes) - r * lanes
            x = state[:m]
            slot = x & U64((1 << table.bits) - 1)
            s = table.symbol[slot]
            out[(r - first) * lanes: (r - first) * lanes + m] = s
            x = table.freq[s] * (x >> U64(table.bits)) + slot - table.start[s]
            low = x < U64(LOW)
            k_low = int(np.count_nonzero(low))
            if k_low:
                x[low] = (x[low] << U64(32)) | words[pos: pos + k_low]
                pos += k_low
            state[:m] = x
        if zlib.crc32(out.tobytes()) != crc:
            raise ValueError(f"checksum of part {k} differs")
        outs.append(out)
    return np.concatenate(outs).astype(np.uint32) if outs else np.zeros(0, np.uint32)
