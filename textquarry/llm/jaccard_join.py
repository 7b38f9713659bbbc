"""N-gram Jaccard self-join with Bayesian candidate pruning over MinHash values.

A document is the set of its word n-grams (five consecutive words, ASCII case folded; a text of fewer words, but any, has
one of them all). Documents of the same words are one class, told by a 128-bit digest of these words; classes, not
documents, are compared. Classes that agree in one of ``bands`` bands of MinHash values are candidates; at ``rows`` = 5 and
``bands`` = 28 a pair of similarity 0.8 is missed with probability 1.5e-5. A candidate's MinHash values are compared some at a
time: after n of them with m equal, the posterior (uniform prior) that its similarity reaches the threshold is
P(Bin(n + 1, t) <= m); below ``tolerance`` the pair is dropped. The others are verified exactly on their n-grams, by 64-bit
hashes; among near copies of one member, whose Jaccard distances to it are known, many pairs follow from the triangle rule.

Pairs are never rows. A bucket's members are compared inside a task, a pair only in the first band that it shares, and what
comes out is each member's number of links and a spanning forest. Buckets of the same members are compared once. A bucket
is dealt to pairs of blocks of about ``block`` members and at most ``block_bytes`` of n-grams each, so no task grows with the
data; a bucket of many different near copies costs the square of its members in time, spread over such tasks, since each
of its links counts. Components of the forests, found by joins, are the classes of near duplicates.

Defined cases
    A null text has no words. Rows without words are alone. Rows with a null, shared or repeated doc_id are rows like others: each has
    the class of its own words. class_id is the least doc_id of the component, null if no row of it has one; rep likewise of
    the rows of the same words. ``drop_near_duplicates`` keeps one row of each component: that of class_id (of different texts with that
    doc_id, the one with the least hash; of equal rows, any one; a row without doc_id only if there is no other). Rows without
    words all stay. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import (U64, WORD_BYTE, materialize, mix64, runs_of_docs, shingle_hashes, span_hashes, splitmix, string_buffers,
                                   table, tidy, tidy_group, word_spans)
from textquarry.llm.components import components
from textquarry.llm.fingerprint import _FOLD

DEFAULTS = {"threshold": 0.8, "width": 5, "rows": 5, "bands": 28, "tolerance": 1e-9, "step": 20, "block": 256, "most_blocks": 64,
            "block_bytes": 8 << 20, "broadcast_rows": 400_000, "read_bytes": 1 << 20}


def _words(buf, off):
    low = _FOLD[buf]
    starts, ends, first = word_spans(low, off)
    return span_hashes(low, starts, ends), first


def word_digests(buf: np.ndarray, off: np.ndarray) -> list[bytes | None]:
    """128-bit digest of each document's words, joined by one space; None without words."""
    low = _FOLD[buf]
    word = WORD_BYTE[low]
    word_before = np.zeros(len(buf), bool)
    word_before[1:] = word[:-1]
    word_before[off[:-1][off[:-1] < len(buf)]] = False
    low[~word] = 32
    keep = word | word_before
    kept, cut = low[keep].tobytes(), np.concatenate([[0], np.cumsum(keep)])[off].tolist()
    out = []
    for a, b in zip(cut[:-1], cut[1:]):
        text = kept[a:b].rstrip(b" ")
        out.append(hashlib.blake2b(text, digest_size=16).digest() if text else None)
    return out


def minhash(h: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """uint32 matrix of n MinHash values per document of hashed n-grams; documents without any have the largest value."""
    docs = len(off) - 1
    out = np.full((docs, n), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(off) > 0)
    if len(some):
        x = (h >> U64(32)).astype(np.uint32)
        mul = (splitmix(0xA11CE, n) >> U64(32)).astype(np.uint32) | np.uint32(1)
        add = (splitmix(0xB0B, n) >> U64(32)).astype(np.uint32)
        v = np.empty_like(x)
        for k in range(n):
            np.multiply(x, mul[k], out=v)
            v += add[k]
            out[some, k] = np.minimum.reduceat(v, off[some])
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """uint64 matrix of band keys: documents x bands."""
    v = sig.reshape(len(sig), -1, rows).astype(np.uint64)
    acc = np.zeros(v.shape[:2], np.uint64)
    for r in range(rows):
        acc = mix64(acc * U64(0x9E3779B97F4A7C15) + v[:, :, r] + U64(r + 1))
    return acc


@functools.lru_cache(8)
def least_equal(threshold: float, tolerance: float, n: int) -> int:
    """The least number of equal values among n with which a pair's posterior is not under the tolerance."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def features(docs: DataFrame, p: dict) -> DataFrame:
    """Of every row: doc_id, text_key (hash of the text), cls (digest of its words), n_grams, keys (packed band keys); the last three null
    without words."""

    def run(batches):
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731,B023
            ids, text_key, (buf, off) = col("doc_id"), col("text_key"), string_buffers(col("text"))
            for i, j in runs_of_docs(off, p["read_bytes"], 4096):
                part, o = buf[off[i]: off[j]], off[i: j + 1] - off[i]
                cls = word_digests(part, o)
                words, first = _words(part, o)
                h, o = shingle_hashes(words, first, p["width"])
                keys = band_keys(minhash(h, o, p["rows"] * p["bands"]), p["rows"]).astype("<u8")
                none = np.array([c is None for c in cls], bool)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), text_key.slice(i, j - i), pa.array(cls, pa.binary()), pa.array(np.diff(o), mask=none),
                     pa.array([None if c is None else k.tobytes() for c, k in zip(cls, keys)], pa.binary())],
                    names=["doc_id", "text_key", "cls", "n_grams", "keys"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(
        tidy(run), "doc_id long, text_key long, cls binary, n_grams long, keys binary")


def unpack_keys(classes: DataFrame, p: dict) -> DataFrame:
    """One row per class and band: cls, n_grams, band, key."""

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                c = b.slice(s, 2000)
                n = c.num_rows
                raw, _ = string_buffers(c.column(c.schema.get_field_index("keys")))
                keys = np.frombuffer(raw.tobytes(), "<i8").reshape(n, -1)
                again = pa.array(np.repeat(np.arange(n), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([
                    *(c.column(c.schema.get_field_index(x)).take(again) for x in ("cls", "n_grams")),
                    pa.array(np.tile(np.arange(keys.shape[1], dtype=np.int32), n)), pa.array(keys.reshape(-1))],
                    names=["cls", "n_grams", "band", "key"])

    return classes.select("cls", "n_grams", "keys").mapInArrow(tidy(run), "cls binary, n_grams long, band int, key long")


def profiles(docs: DataFrame, p: dict) -> DataFrame:
    """cls, sig (packed MinHash values), grams (packed distinct n-gram hashes, ascending) of rows (cls, text)."""

    def run(batches):
        for b in batches:
            ids, (buf, off) = b.column(b.schema.get_field_index("cls")), string_buffers(b.column(b.schema.get_field_index("text")))
            for i, j in runs_of_docs(off, p["read_bytes"], 4096):
                h, o = shingle_hashes(*_words(buf[off[i]: off[j]], off[i: j + 1] - off[i]), p["width"])
                sig = minhash(h, o, p["rows"] * p["bands"]).astype("<u4")
                grams = [np.unique(h[o[d]: o[d + 1]]).astype("<u8").tobytes() for d in range(j - i)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(grams, pa.binary())],
                                                 names=["cls", "sig", "grams"])

    return docs.select("cls", "text").mapInArrow(tidy(run), "cls binary, sig binary, grams binary")


PAIRS = 1 << 17  # pairs that are looked at together


def compare_bucket(sig: np.ndarray, grams: list[np.ndarray], band: int, left: np.ndarray, right: np.ndarray, p: dict):
    """The verified links among members of a bucket, some at a time: index arrays (a, b).

    ``left`` and ``right``: member indices of the two blocks (the same array for pairs within a block).
    """
    keys = band_keys(sig, p["rows"])[:, :band]
    size = np.array([len(g) for g in grams])
    step = max(1, PAIRS // max(1, len(right)))
    for s in range(0, len(left), step):
        own = left[s: s + step]
        fresh = np.ones((len(own), len(right)), bool)
        if left is right:
            fresh &= own[:, None] < right[None, :]
        for k in range(band):
            fresh &= keys[own, k][:, None] != keys[right, k][None, :]
        a, b = np.nonzero(fresh)
        a, b = own[a], right[b]
        fits = np.minimum(size[a], size[b]) >= p["threshold"] * np.maximum(size[a], size[b]) - 1e-9  # else the similarity can't reach it
        a, b = likely(sig, a[fits], b[fits], p)
        if len(a):
            yield verified(grams, size, a, b, p["threshold"])


def likely(sig: np.ndarray, a: np.ndarray, b: np.ndarray, p: dict):
    """The pairs that the posterior doesn't rule out, by MinHash values compared some at a time."""
    equal, total = np.zeros(len(a), np.int32), sig.shape[1]
    for k in range(0, total, p["step"]):
        if not len(a):
            break
        to = min(total, k + p["step"])
        for c in range(k, to):
            equal += sig[a, c] == sig[b, c]
        keep = equal >= least_equal(p["threshold"], p["tolerance"], to)
        a, b, equal = a[keep], b[keep], equal[keep]
    return a, b


def verified(grams: list[np.ndarray], size: np.ndarray, a: np.ndarray, b: np.ndarray, t: float):
    """The pairs whose similarity reaches ``t``. Distances of all to one member decide the pairs that the triangle rule can."""
    used = np.unique(np.concatenate([a, b]))
    place = np.zeros(len(grams), np.int64)
    place[used] = np.arange(len(used))
    n = size[used]
    off = np.concatenate([[0], np.cumsum(n)])
    dense = np.unique(np.concatenate([grams[k] for k in used]), return_inverse=True)[1].astype(np.int32)
    flag = np.zeros(int(dense.max()) + 1, bool)
    x, y = place[a], place[b]

    def similar(one: int, others: np.ndarray) -> np.ndarray:
        mine = dense[off[one]: off[one + 1]]
        flag[mine] = True
        out = np.empty(len(others))
        for s in range(0, len(others), 256):
            some = others[s: s + 256]
            m = n[some]
            begin = np.concatenate([[0], np.cumsum(m)[:-1]])
            at = np.arange(int(m.sum())) + np.repeat(off[some] - begin, m)
            both = np.add.reduceat(flag[dense[at]].astype(np.int64), begin)
            out[s: s + 256] = both / (n[one] + m - both)
        flag[mine] = False
        return out

    good = np.zeros(len(x), bool)
    open_ = np.ones(len(x), bool)
    if len(x) > 4 * len(used):
        pivot = int(np.bincount(np.concatenate([x, y])).argmax())
        far = 1 - similar(pivot, np.arange(len(used)))
        good = far[x] + far[y] <= 1 - t - 1e-9
        open_ = ~good & (np.abs(far[x] - far[y]) <= 1 - t + 1e-9)
    rest = np.flatnonzero(open_)
    rest = rest[np.argsort(x[rest], kind="stable")]
    cuts = np.flatnonzero(np.diff(x[rest], prepend=-1, append=len(used)))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        some = rest[lo:hi]
        good[some] = similar(int(x[some[0]]), y[some]) >= t - 1e-9
    return a[good], b[good]


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (least member of a component) after the links (a, b)."""
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        for side in (label[a], label[b], a, b):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _told(docs: DataFrame, p: dict) -> tuple[DataFrame, DataFrame]:
    """(features; of each class with copies or links: cls, rep, n_links, class_id, the component's first row as (first_id, first_key))."""
    feats = materialize(features(docs, p), "features")
    classes = materialize(feats.where("cls is not null").groupBy("cls").agg(
        F.min(F.struct(*[F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "n_grams", "keys"])).alias("m"), F.count(F.lit(1)).alias("copies")).select(
        "cls", F.struct("m.no_id", "m.doc_id", "m.text_key").alias("first"), "m.n_grams", "m.keys", "copies"), "classes")
    bands = unpack_keys(classes, p)
    # buckets of two or more; of those with the same members the first stays
    mark = F.xxhash64("cls")
    buckets = bands.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("grams"), F.sum(F.pmod(mark, F.lit(1 << 40))).alias("s"), F.bit_xor(mark).alias("x")).where("n > 1")
    blocks = F.greatest(F.least(F.ceil(F.col("n") / p["block"]), F.lit(p["most_blocks"])), F.ceil(F.col("grams") * 8 / p["block_bytes"]))
    first = buckets.groupBy("n", "s", "x").agg(F.min(F.struct("band", "key", "grams")).alias("at")).select(
        "at.band", "at.key", "n", "at.grams").select("band", "key", F.least("n", blocks).cast("int").alias("nb"))
    members = materialize(bands.join(first, ["band", "key"]).select("band", "key", "nb", "cls"), "buckets")
    ids = members.select("cls").distinct()
    n_ids = ids.limit(p["broadcast_rows"] + 1).count()
    small = n_ids <= p["broadcast_rows"]
    # rows of 40 bytes, counted
    chosen = classes.join(F.broadcast(ids) if small else ids, "cls").select("cls", F.col("first.doc_id").alias("at_id"), F.col("first.text_key").alias("at_key"))
    texts = docs.select("doc_id", "text").join(
        F.broadcast(chosen) if small else chosen, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.xxhash64("text") == F.col("at_key")))
    # repeated rows give the same profile
    prof = profiles(texts, p).groupBy("cls").agg(F.min(F.struct("grams", "sig")).alias("m")).select("cls", "m.grams", "m.sig")
    dealt = (
        members.withColumn("own", F.pmod(F.xxhash64("cls", F.lit(5)), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")))
    grouped = dealt.select("band", "key", "lo", "hi", "own", "cls").join(prof, "cls").groupBy("band", "key", "lo", "hi")

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("cls")
        own, lo, hi, band = t["own"].to_numpy(), t["lo"][0].as_py(), t["hi"][0].as_py(), t["band"][0].as_py()
        n = len(own)
        sig = np.frombuffer(string_buffers(t["sig"])[0].tobytes(), "<u4").reshape(n, -1)
        raw, off = string_buffers(t["grams"])
        grams = [np.frombuffer(raw[x:y].tobytes(), "<u8") for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
        left = np.flatnonzero(own == lo)
        right = left if lo == hi else np.flatnonzero(own == hi)
        count, label = np.zeros(n, np.int64), np.arange(n)
        for a, b in compare_bucket(sig, grams, band, left, right, p):
            count += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            label = join_labels(label, a, b)
        hit, moved = np.flatnonzero(count), np.flatnonzero(label != np.arange(n))
        cls = t["cls"].combine_chunks()
        return pa.table({
            "a": pa.concat_arrays([cls.take(pa.array(hit)), cls.take(pa.array(moved))]), "b": pa.concat_arrays([cls.take(pa.array(hit)), cls.take(pa.array(label[moved]))]),
            "links": pa.array(np.concatenate([count[hit], np.zeros(len(moved), np.int64)]))})

    found = materialize(grouped.applyInArrow(tidy_group(compare), "a binary, b binary, links long"), "links")
    links = found.where("links > 0").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("n_links"))
    roots = components(found.where("links = 0").select("a", "b")).select(F.col("node").alias("cls"), "root")
    told = classes.select("cls", "first", "copies").join(links, "cls", "left").join(roots, "cls", "left").where("copies > 1 or n_links > 0")
    told = materialize(told.select("cls", "first", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "root"), "told")
    best = told.where("root is not null").groupBy("root").agg(F.min("first").alias("best"))
    told = told.join(best, "root", "left").withColumn("best", F.coalesce("best", "first")).select(
        "cls", F.col("first.doc_id").alias("rep"), "n_links", F.col("best.doc_id").alias("class_id"), F.col("best.text_key").alias("first_key"))
    return feats, told


def near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, rep (least doc_id of the same words), n_links (other classes of
    words with similarity of the threshold or more), class_id (least doc_id of the linked component)."""
    feats, told = _told(docs, DEFAULTS | params)
    # classes of one document without a link have no row there
    known = F.col("n_links").isNotNull()
    return feats.select("doc_id", "cls").join(told, "cls", "left").select(
        "doc_id", F.when(known, F.col("rep")).otherwise(F.col("doc_id")).alias("rep"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(known, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def drop_near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one row of each component, that of class_id; rows without words all stay."""
    p = DEFAULTS | params
    feats, told = _told(docs, p)
    several = F.col("n_links").isNotNull()
    rows = feats.select("doc_id", "text_key", "cls").join(told, "cls", "left").select(
        "doc_id", "text_key", several.alias("several"), (several & ~(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("first_key")))).alias("goes"))
    rows = materialize(rows, "decisions")
    ids = materialize(rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("goes").alias("n_gone"), F.max("several").alias("several")).where("several"), "ids")
    shared = F.col("doc_id").isNull() | (F.col("n") > 1)
    gone = ids.where((F.col("n_gone") == F.col("n")) & ~shared).select(F.col("doc_id").alias("gone_id"))
    odd = ids.where(shared).select(F.col("doc_id").alias("odd_id"))

    def checked(df):  # rows of 8 bytes, counted
        return F.broadcast(df) if df.limit(p["broadcast_rows"] + 1).count() <= p["broadcast_rows"] else df

    kept = docs.join(checked(gone), docs["doc_id"] == F.col("gone_id"), "left_anti")
    if not odd.limit(1).count():
        return kept
    # rows whose doc_id is null or not theirs alone: told apart by their texts
    odd = checked(odd)
    plain = kept.join(odd, kept["doc_id"].eqNullSafe(F.col("odd_id")), "left_anti")
    at = rows.where("not goes").join(odd, F.col("doc_id").eqNullSafe(F.col("odd_id")), "left_semi").select(
        F.col("doc_id").alias("at_id"), F.col("text_key").alias("at_key"), "several").distinct()
    packed = kept.join(odd, kept["doc_id"].eqNullSafe(F.col("odd_id")), "left_semi").select(
        F.struct(*[kept[c] for c in docs.columns]).alias("row"), kept["doc_id"].alias("own_id"), F.xxhash64(kept["text"]).alias("own_key"))
    packed = packed.join(at, F.col("own_id").eqNullSafe(F.col("at_id")) & (F.col("own_key") == F.col("at_key")))
    one = packed.where("several").groupBy("own_id", "own_key").agg(F.first("row").alias("row")).select("row.*")
    return plain.unionByName(packed.where("not several").select("row.*")).unionByName(one)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "rep", "n_links")


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
