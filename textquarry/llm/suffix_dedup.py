"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

A byte goes if it lies in a ``depth``-byte string (50) that also starts in a document with a smaller doc_id. Suffixes are
ordered only to that depth, most significant digit first, and leave as soon as their group is settled:

1. Suffixes start at anchors: of the 24-byte heads in every 50-byte window the least hash is its anchor, so each window has
   exactly one, and equal windows have it at the same place. A window run is all windows of one anchor in a row.
2. First digit: the 24-byte head. Suffixes are dealt to buckets by it and sorted there. A head that is in one document only is
   done. A run whose whole content is also in an earlier document is removed as a whole.
3. Last digit: for heads with several different runs in several documents, the rest of the 50 bytes: their windows are dealt
   and sorted as before, and equal groups are the repeated strings.

The digits are keyed hashes of their bytes, so that they spread evenly over buckets whatever the texts; their order is not that of the
bytes, which the result doesn't need. A window's digit has 72 bits besides those of its bucket: over 30 GB (2 billion entries,
4,000 buckets) any two different windows fall together with a probability of about 1e-7, over 100 TB of about 1e-2. Bytes of
other units aren't compared, since that would move each repeated passage to each of its copies.

Documents are dealt once to units of about ``unit_bytes``, row by row, so that rows that share a doc_id don't meet in one. By default it
grows with the square root of all bytes (8 MB up to 0.6 TB, 107 MB at 100 TB, at most ``most_unit_bytes``), which keeps some eight
entries in a row that a unit sends to a bucket. A unit works in numpy, block by block. What a unit sends to a
bucket is one packed row, combined first: each distinct (head, run) or window once, with the unit's least doc_id that has it.
So a text or passage that a third of all documents share is one entry of each unit. A head with over ``many_runs``
different runs in a unit is sent as one mark, and its runs go straight to the last digit. A bucket answers with flags in the
order of what it got. All steps are one plan, in which the units' shuffle of texts is used three times.

Defined cases
    A null text is empty; a text of fewer than 50 bytes keeps all. Rows with the same doc_id never remove from each other,
    and each gets its row. A null doc_id counts as smaller than all others. A text longer than a unit is a unit's only large one, read
    in overlapping pieces. An empty table gives no rows. Other columns are not read. Rows must be in the same places of their partitions when
    a lost task reads them again, as those of files are; store the result of a shuffle first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import U64, mix64, runs_of_docs, splitmix, string_buffers, table, text_bytes, tidy_group, tidy_groups

DEFAULTS = {"depth": 50, "head": 24, "unit_bytes": None, "least_unit_bytes": 8 << 20, "most_unit_bytes": 256 << 20, "block_bytes": 1_000_000, "many_runs": 64}

_K = splitmix(0x5F1C, 64) | U64(1)
_POS_BITS = 22
NO_ID = -(1 << 63)
NONE, FULL, MAYBE = 0, 1, 2


def word_mixes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit mix of the 8 bytes at every position (zeros behind the end)."""
    b = np.zeros(len(buf) + 8, np.uint64)
    b[: len(buf)] = buf
    b[:-1] |= b[1:] << U64(8)
    b[:-2] |= b[2:] << U64(16)
    b[:-4] |= b[4:] << U64(32)
    return mix64(b[: len(buf)] * _K[0] + _K[1])


def span_hash(m: np.ndarray, at: np.ndarray | slice, length: int, salt: int) -> np.ndarray:
    """Hash of the ``length`` bytes at each position in ``at`` (a slice: at all of these positions)."""
    offs = [*range(0, length - 7, 8)]
    if offs[-1] + 8 < length:
        offs.append(length - 8)
    out = None
    for j, o in enumerate(offs):
        v = m[at.start + o: at.stop + o] if isinstance(at, slice) else m[at + o]
        out = v * _K[salt + j] if out is None else out + v * _K[salt + j]
    out ^= out >> U64(29)
    out *= _K[salt + 9]
    out ^= out >> U64(32)
    return out


def block_runs(buf: np.ndarray, off: np.ndarray, p: dict):
    """Window runs of concatenated texts: (head hash, run hash, document, first window, last window)."""
    depth, head = p["depth"], p["head"]
    span = depth - head + 1
    n = len(buf) - depth + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z, z
    m = word_mixes(buf)
    h = span_hash(m, slice(0, len(buf) - head + 1), head, 2)
    mask = U64((1 << _POS_BITS) - 1)
    key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: n], key[span - width: span - width + n])
    anchor = (key[:n] & mask).astype(np.int64)
    valid = np.zeros(n + 1, bool)  # windows within one document
    mark = np.zeros(n + 1, np.int32)
    sizes = np.diff(off)
    long_ = np.flatnonzero(sizes >= depth)
    np.add.at(mark, off[long_], 1)
    np.add.at(mark, off[long_ + 1] - depth + 1, -1)
    valid = np.cumsum(mark)[:n] > 0
    new = valid.copy()
    new[1:] &= ~(valid[:-1] & (anchor[1:] == anchor[:-1]))
    starts = off[long_]
    new[starts] = True
    lo = np.flatnonzero(new)
    last = valid.copy()
    last[:-1] &= ~(valid[1:] & ~new[1:])
    hi = np.flatnonzero(last)
    a = anchor[lo]
    first, end = span_hash(m, lo, depth, 20), span_hash(m, hi, depth, 20)
    run = mix64(first * _K[40] + end * _K[41] + (hi - lo).astype(np.uint64) * _K[42] + (a - lo).astype(np.uint64) * _K[43])
    return mix64(h[a] + U64(1)), run, np.searchsorted(off, lo, side="right") - 1, lo, hi


def window_keys(m: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    return mix64(span_hash(m, at, depth, 20)), (mix64(span_hash(m, at, depth, 44)) >> U64(32)).astype(np.uint32)


def spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges lo..hi, one range after another."""
    n = hi - lo + 1
    return np.arange(int(n.sum())) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(lo) else np.zeros(0, np.int64)


def _squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _open(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def pack_ids(ids: np.ndarray) -> bytes:
    """doc_ids of a blob: the distinct ones as differences, and each entry's index among them."""
    uniq, at = np.unique(ids, return_inverse=True)
    small = len(uniq) <= 1 << 16
    step = np.diff(uniq, prepend=np.int64(0)).astype("<i8")
    body = _squeeze(step)
    return len(body).to_bytes(4, "little") + (b"\2" if small else b"\4") + body + _squeeze(at.astype("<u2" if small else "<u4"))


def open_ids(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    uniq = np.cumsum(_open(b[5: 5 + n], "<i8"))
    return uniq[_open(b[5 + n:], "<u2" if b[4] == 2 else "<u4")]


def low_bytes(h: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def open_low_bytes(b: bytes, n: int) -> np.ndarray:
    raw = np.zeros((len(b) // n, 8), np.uint8)
    raw[:, :n] = np.frombuffer(b, np.uint8).reshape(-1, n)
    return raw.reshape(-1).view("<u8").astype(np.uint64)


# bytes sent of the hashes; the bucket adds its own bits of heads and windows, and runs are compared within a head only
HEAD_BYTES, RUN_BYTES, WINDOW_BYTES = 5, 6, 5


class Unit:
    """The documents of a unit and its distinct (head, run) groups, in an order that all three passes share."""

    def __init__(self, t: pa.Table, buckets: int, p: dict):
        self.p, self.buckets = p, buckets
        ids = t["doc_id"].fill_null(NO_ID).combine_chunks().to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0, np.int64)
        self.row = np.argsort(ids, kind="stable")
        self.ids = ids[self.row]
        self.buf, self.off = string_buffers(t["text"].take(pa.array(self.row)))
        parts = [[], [], [], [], []]
        self.blocks = list(runs_of_docs(self.off, min(p["block_bytes"], 1 << 21)))
        self.blocks = [b for b in self.blocks if b[1] > b[0]]
        for i, j in self.blocks:
            for k, got in enumerate(self._runs(i, j)):
                parts[k].append(got)
        head, run, doc, lo, hi = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in parts)
        del parts
        head, run = head.astype(np.uint64), run.astype(np.uint64)
        bucket = (head >> U64(44)) % U64(buckets)
        # by bucket, then head, run, document: the bucket leads the head
        order = np.lexsort((doc, run, head, bucket))
        self.head, self.run, self.doc, self.lo, self.hi = head[order], run[order], doc[order], lo[order], hi[order]
        n = len(order)
        first_head = np.ones(n, bool)
        first_head[1:] = self.head[1:] != self.head[:-1]
        first_run = first_head.copy()
        first_run[1:] |= self.run[1:] != self.run[:-1]
        self.group = np.cumsum(first_run) - 1  # of each run
        lead = np.flatnonzero(first_run)
        self.lead = lead  # the group's run in its least document
        self.later = self.ids[self.doc] > self.ids[self.doc[lead]][self.group] if n else np.zeros(0, bool)
        head_no = (np.cumsum(first_head) - 1)[lead]
        runs_of_head = np.bincount(head_no)
        self.crowded = runs_of_head[head_no] > p["many_runs"] if len(lead) else np.zeros(0, bool)  # groups of a crowded head
        # entries to send: every group of a head that isn't crowded, one mark for a crowded one
        first_group = np.ones(len(lead), bool)
        first_group[1:] = head_no[1:] != head_no[:-1]
        self.sent = np.flatnonzero(~self.crowded | first_group)
        self.sent_bucket = bucket[order][lead[self.sent]].astype(np.int64)

    def _runs(self, i: int, j: int):
        off = self.off
        if off[j] - off[i] < 1 << _POS_BITS:
            h, r, d, lo, hi = block_runs(self.buf[off[i]: off[j]], off[i: j + 1] - off[i], self.p)
            return h, r, d + i, lo + off[i], hi + off[i]
        # one very long document: overlapping pieces; windows are each in one piece only, so a run may be cut in two
        depth, out = self.p["depth"], []
        step = 1 << 20
        for s in range(int(off[i]), int(off[j]) - depth + 1, step):
            e = min(int(off[j]), s + step + depth - 1)
            h, r, d, lo, hi = block_runs(self.buf[s:e], np.array([0, e - s]), self.p)
            out.append((h, r, d + i, lo + s, hi + s))
        return tuple(np.concatenate(x) for x in zip(*out))

    def least(self, groups: np.ndarray) -> np.ndarray:
        return self.ids[self.doc[self.lead[groups]]]

    def send_groups(self):
        """(bucket, heads, runs, doc_ids) blobs."""
        cut = np.flatnonzero(np.diff(self.sent_bucket, prepend=-1, append=-1))
        for a, b in zip(cut[:-1], cut[1:]):
            g = self.sent[a:b]
            run = np.where(self.crowded[g], U64(0), self.run[self.lead[g]] | U64(1))
            yield int(self.sent_bucket[a]), low_bytes(self.head[self.lead[g]], HEAD_BYTES), low_bytes(run, RUN_BYTES), pack_ids(self.least(g))

    def take_flags(self, flags: dict[int, bytes]) -> np.ndarray:
        """The state of each group, from the buckets' answers."""
        state = np.full(len(self.lead), NONE, np.uint8)
        if len(self.sent):
            got = np.concatenate([_open(flags[b], np.uint8) for b in np.unique(self.sent_bucket).tolist()])
            state[self.sent] = got
        state[self.crowded] = MAYBE
        return state

    def open_windows(self, state: np.ndarray):
        """Windows of the undecided groups, in their least documents: (key, key2, position) ordered by bucket and key, with
        the first entry of each distinct key, and which entries are of a later document than that one."""
        runs = np.flatnonzero((state == MAYBE)[self.group] & ~self.later) if len(self.group) else self.lead
        lo, hi = self.lo[runs], self.hi[runs]
        order = np.argsort(lo)
        lo, hi = lo[order], hi[order]
        keys, keys2, places = [], [], []
        for i, j in self.blocks:
            s, e = int(self.off[i]), int(self.off[j])
            a, b = np.searchsorted(lo, [s, e])
            if a == b:
                continue
            at = spread(lo[a:b], hi[a:b])
            step = 1 << 20
            for q in range(s, e, step):
                x, y = np.searchsorted(at, [q, q + step])
                if x == y:
                    continue
                m = word_mixes(self.buf[q: min(e, q + step + self.p["depth"])])
                k, k2 = window_keys(m, at[x:y] - q, self.p["depth"])
                keys.append(k)
                keys2.append(k2)
                places.append(at[x:y])
        if not keys:
            z = np.zeros(0, np.int64)
            return z.astype(np.uint64), z.astype(np.uint32), z, z, z.astype(bool), z
        k, k2, at = np.concatenate(keys), np.concatenate(keys2), np.concatenate(places)
        doc = np.searchsorted(self.off, at, side="right") - 1
        bucket = ((k >> U64(44)) % U64(self.buckets)).astype(np.int64)
        order = np.lexsort((doc, k2, k, bucket))
        k, k2, at, doc, bucket = k[order], k2[order], at[order], doc[order], bucket[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        return k, k2, at, first, self.ids[doc] > self.ids[doc[first]][group], bucket

    def send_windows(self, state: np.ndarray):
        k, k2, at, first, _, bucket = self.open_windows(state)
        doc = np.searchsorted(self.off, at[first], side="right") - 1
        cut = np.flatnonzero(np.diff(bucket[first], prepend=-1, append=-1)) if len(first) else []
        for a, b in zip(cut[:-1], cut[1:]):
            f = first[a:b]
            yield int(bucket[f[0]]), low_bytes(k[f], WINDOW_BYTES), k2[f].astype("<u4").tobytes(), pack_ids(self.ids[doc[a:b]])

    def removed(self, state: np.ndarray, flags: dict[int, bytes]) -> np.ndarray:
        """Which bytes of the unit go."""
        delta = np.zeros(len(self.buf) + 1, np.int32)
        whole = self.later | (state == FULL)[self.group] if len(self.group) else np.zeros(0, bool)
        np.add.at(delta, self.lo[whole], 1)
        np.add.at(delta, self.hi[whole] + self.p["depth"], -1)
        k, _, at, first, later, bucket = self.open_windows(state)
        if len(first):
            got = np.concatenate([_open(flags[b], np.uint8) for b in np.unique(bucket[first]).tolist()])
            new = np.zeros(len(k), np.int64)
            new[first] = 1
            gone = at[later | (got[np.cumsum(new) - 1] > 0)]
            np.add.at(delta, gone, 1)
            np.add.at(delta, gone + self.p["depth"], -1)
        return np.cumsum(delta[:-1]) > 0


def judge_groups(t: pa.Table) -> tuple[list[int], list[bytes]]:
    """Flags for the entries of each unit that sent to this bucket."""
    units, heads, runs, ids, sizes = [], [], [], [], []
    for r in t.sort_by("unit").to_pylist():
        units.append(r["unit"])
        heads.append(open_low_bytes(r["k1"], HEAD_BYTES))
        runs.append(open_low_bytes(r["k2"], RUN_BYTES))
        ids.append(open_ids(r["ids"]))
        sizes.append(len(runs[-1]))
    head, run, doc = np.concatenate(heads), np.concatenate(runs), np.concatenate(ids)
    order = np.lexsort((doc, run, head))
    h, r, d = head[order], run[order], doc[order]
    new_head = np.ones(len(h), bool)
    new_head[1:] = h[1:] != h[:-1]
    new_run = new_head.copy()
    new_run[1:] |= r[1:] != r[:-1]
    head_no, run_no = np.cumsum(new_head) - 1, np.cumsum(new_run) - 1
    starts = np.flatnonzero(new_head)
    least, most = np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts)
    n_runs = np.add.reduceat(new_run.astype(np.int64), starts)
    marked = np.maximum.reduceat((r == 0).astype(np.int64), starts) > 0
    open_ = ((n_runs > 1) & (least < most)) | (marked & (np.diff(starts, append=len(h)) > 1))
    full = (d > d[np.flatnonzero(new_run)][run_no]) & (r != 0)
    state = np.where(full, FULL, np.where(open_[head_no], MAYBE, NONE)).astype(np.uint8)
    out = np.empty_like(state)
    out[order] = state
    cuts = np.cumsum([0, *sizes])
    return units, [_squeeze(out[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def judge_windows(t: pa.Table) -> tuple[list[int], list[bytes]]:
    units, k1, k2, ids = [], [], [], []
    for r in t.sort_by("unit").to_pylist():
        units.append(r["unit"])
        k1.append(open_low_bytes(r["k1"], WINDOW_BYTES))
        k2.append(np.frombuffer(r["k2"], "<u4"))
        ids.append(open_ids(r["ids"]))
    a, b, d = np.concatenate(k1), np.concatenate(k2), np.concatenate(ids)
    order = np.lexsort((d, b, a))
    x, y, z = a[order], b[order], d[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    out = np.empty(len(x), np.uint8)
    out[order] = z > z[np.flatnonzero(new)][np.cumsum(new) - 1]
    cuts = np.cumsum([0, *map(len, k1)])
    return units, [_squeeze(out[i:j]) for i, j in zip(cuts[:-1], cuts[1:])]


SENT = "bucket int, unit int, k1 binary, k2 binary, ids binary"
TOLD = "unit int, kind int, bucket int, flags binary"


def _told(units, kind, bucket, flags) -> pa.Table:
    n = len(units)
    return pa.table({"unit": pa.array(units, pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()),
                     "flags": pa.array(flags, pa.binary())})


def _sent(rows, unit) -> pa.Table:
    cols = list(zip(*rows)) or [(), (), (), ()]
    return pa.table({"bucket": pa.array(cols[0], pa.int32()), "unit": pa.array([unit] * len(cols[0]), pa.int32()),
                     "k1": pa.array(cols[1], pa.binary()), "k2": pa.array(cols[2], pa.binary()), "ids": pa.array(cols[3], pa.binary())})


def _flags(t: pa.Table, kind: int) -> dict[int, bytes]:
    t = t.filter(pa.compute.equal(t["kind"], kind)) if t.num_rows else t
    return dict(zip(t["bucket"].to_pylist(), t["flags"].to_pylist())) if t.num_rows else {}


def unit_size(total: int, p: dict) -> int:
    """Bytes of a unit. Units have an entry for some 14 bytes and there are as many buckets as units, so that a row from a unit to a
    bucket has size^2 / (14 total) entries: eight or more by this rule."""
    return int(min(p["most_unit_bytes"], max(p["least_unit_bytes"], (8 * 14 * total) ** 0.5)))


def mark_repeats(docs: DataFrame, digest: bool = True, **params) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, and kept_sha256 (``digest``) or kept (the remaining bytes) of every row."""
    import pyarrow.compute  # noqa: F401

    p = DEFAULTS | params
    total = text_bytes(docs)
    units = max(1, -(-total // (p["unit_bytes"] or unit_size(total, p))))
    # a row's place in the table: neither a doc_id nor equal rows gather in one unit
    place = F.monotonically_increasing_id()
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", place), F.lit(units)).cast("int").alias("unit"))

    def heads(t: pa.Table) -> pa.Table:
        return _sent(Unit(t, units, p).send_groups(), t["unit"][0].as_py())

    sent = dealt.groupBy("unit").applyInArrow(tidy_group(heads), SENT)
    told = sent.groupBy("bucket").applyInArrow(lambda t: _told(*(lambda u, f: (u, 1, t["bucket"][0].as_py(), f))(*judge_groups(t))), TOLD)

    def windows(t: pa.Table, f: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _sent([], 0)
        unit, u = t["unit"][0].as_py(), Unit(t, units, p)
        state = u.take_flags(_flags(f, 1))
        # the groups' states travel on with the windows, in a row of their own
        rows = [(-1 - unit, state_bytes, b"", b"") for state_bytes in [_squeeze(state)]]
        return _sent(rows + list(u.send_windows(state)), unit)

    asked = dealt.groupBy("unit").cogroup(told.groupBy("unit")).applyInArrow(tidy_groups(windows), SENT)

    def answer(t: pa.Table) -> pa.Table:
        bucket = t["bucket"][0].as_py()
        if bucket < 0:
            return _told(t["unit"].to_pylist(), 3, 0, t["k1"].to_pylist())
        units_, flags = judge_windows(t)
        return _told(units_, 2, bucket, flags)

    answers = asked.groupBy("bucket").applyInArrow(answer, TOLD)
    last = "kept_sha256" if digest else "kept"

    def finish(t: pa.Table, f: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", last]
        if not t.num_rows:
            return pa.table({n: pa.array([], pa.int64() if i < 4 else pa.string() if digest else pa.binary()) for i, n in enumerate(names)})
        u = Unit(t, units, p)
        state = _open(_flags(f, 3)[0], np.uint8)
        gone = u.removed(state, _flags(f, 2))
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        first = u.off[:-1][u.off[:-1] < len(gone)]
        edge[first] = gone[first]
        removed, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(edge)])
        kept = []
        for a, b in zip(u.off[:-1].tolist(), u.off[1:].tolist()):
            rest = u.buf[a:b][~gone[a:b]].tobytes() if removed[b] > removed[a] else u.buf[a:b].tobytes()
            kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
        return pa.table({
            "doc_id": pa.array(u.ids, mask=u.ids == NO_ID), "n_bytes": np.diff(u.off), "n_removed": removed[u.off[1:]] - removed[u.off[:-1]],
            "n_spans": spans[u.off[1:]] - spans[u.off[:-1]], last: pa.array(kept, pa.string() if digest else pa.binary())})

    return dealt.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(
        tidy_groups(finish), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last} {'string' if digest else 'binary'}")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
