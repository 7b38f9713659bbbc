"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are maximal runs of letters and digits, or of one kind of other printable characters; case is kept. A word equal to
one of the two before it counts as a mark of repetition in its place. Features are unigrams and bigrams, hashed to
``n_features`` weights. A text is the vector of its feature counts divided by its number of words, times ``scale``; its
score is a sparse dot product with the weights.

Training reads a bounded sample: at most about ``max_train`` labelled rows with at most about ``max_train_bytes`` of text, picked
by a hash of doc_id, so that it needs one task of fixed size whatever the corpus. Scoring reads all documents in Arrow batches, the weights are broadcast
(8 bytes times ``n_features``, a fixed size).

Defined cases
    A null text counts as empty; an empty text has only the bias and gets its score. Rows with a null label or a null
    text teach nothing or the empty text. Repeated rows count as often as they occur. With no labelled row at all every
    score is 0.5. A null doc_id has no label, so the query says that it is held out. A very long text is scored whole, as a block of its
    own. An empty table gives no rows. A column quality_score of the input is replaced, others stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import (U64, materialize, mix64, replacing, runs_of_docs, span_hashes, string_buffers, table, tidy)

# kinds of bytes: 0 white space and controls, 1 letters, digits and everything outside ASCII, others by the character
_KIND = np.zeros(256, np.uint8)
for _c in range(33, 127):
    _KIND[_c] = _c
for _lo, _hi in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _KIND[_lo: _hi + 1] = 1

DEFAULTS = {"n_features": 1 << 20, "scale": 20.0, "max_train": 16_000, "max_train_bytes": 64 << 20, "epochs": 2, "alpha": 0.3, "beta": 1.0, "l1": 0.02, "l2": 0.1,
            "block_bytes": 1 << 20}


def text_features(buf: np.ndarray, off: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature ids, offsets per document, words per document) of concatenated texts; ids repeat as often as they occur."""
    n_docs = len(off) - 1
    if len(buf) == 0:
        return np.zeros(0, np.int64), np.zeros(n_docs + 1, np.int64), np.zeros(n_docs, np.int64)
    kind = _KIND[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[off] = True
    cut = np.flatnonzero(edge)
    starts, ends = cut[:-1], cut[1:]
    keep = kind[starts] != 0
    starts, ends = starts[keep], ends[keep]
    first = np.searchsorted(starts, off, side="left")
    words = span_hashes(buf, starts, ends)
    n = np.diff(first)
    doc = np.repeat(np.arange(n_docs), n)
    seen = words.copy()
    for back, mark in ((2, 0xBEEF), (1, 0xF00D)):
        same = np.zeros(len(words), bool)
        same[back:] = (words[back:] == words[:-back]) & (doc[back:] == doc[:-back])
        seen[same] = U64(mark)
    mask = U64(n_features - 1)
    uni = (mix64(seen) & mask).astype(np.int64)
    pair = mix64(seen[:-1] * U64(0x9E3779B97F4A7C15) + seen[1:])
    inside = doc[1:] == doc[:-1]
    bi = (pair[inside] & mask).astype(np.int64)
    n_bi = np.maximum(n - 1, 0)
    out_off = np.concatenate([[0], np.cumsum(n + n_bi)])
    ids = np.empty(out_off[-1], np.int64)
    ids[np.arange(len(uni)) + np.repeat(out_off[:-1] - first[:-1], n)] = uni
    first_bi = np.concatenate([[0], np.cumsum(n_bi)])[:-1]
    ids[np.arange(len(bi)) + np.repeat(out_off[:-1] + n - first_bi, n_bi)] = bi
    return ids, out_off, n


def train_ftrl(parts: list[tuple[pa.Array, np.ndarray]], p: dict) -> np.ndarray:
    """Weights, the bias last; per-coordinate FTRL-proximal, one example after another in the order of ``parts`` (texts, labels)."""
    size = p["n_features"] + 1
    z, s = np.zeros(size), np.zeros(size)

    def weights(idx):
        zi = z[idx]
        return np.where(np.abs(zi) <= p["l1"], 0.0, -(zi - np.sign(zi) * p["l1"]) / ((p["beta"] + np.sqrt(s[idx])) / p["alpha"] + p["l2"]))

    blocks = [(buf, off, labels, i, j) for (buf, off), labels in ((string_buffers(t), y) for t, y in parts) for i, j in runs_of_docs(off, p["block_bytes"])]
    for _ in range(p["epochs"]):
        for buf, off, labels, i, j in blocks:
            ids, o, n = text_features(buf[off[i]: off[j]], off[i: j + 1] - off[i], p["n_features"])
            for d in range(j - i):
                idx, cnt = np.unique(ids[o[d]: o[d + 1]], return_counts=True)
                idx = np.append(idx, size - 1)
                x = np.append(cnt * (p["scale"] / max(1, n[d])), 1.0)
                w = weights(idx)
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - labels[i + d]) * x
                sigma = (np.sqrt(s[idx] + g * g) - np.sqrt(s[idx])) / p["alpha"]
                z[idx] += g - sigma * w
                s[idx] += g * g
    return weights(np.arange(size))


SHARES = 1 << 40


def _share(total: int, most: int) -> int:
    """The part of SHARES to take of ``total`` rows so that about ``most`` remain."""
    return SHARES if total <= most else int(0.97 * most / total * SHARES)


def fit(labelled: DataFrame, **params) -> bytes:
    """Weights (float64 little-endian) from a DataFrame of doc_id, text, label; the sample is bounded by ``max_train`` rows and
    ``max_train_bytes`` of text (but for the length of its last one).

    The sampled rows are stored, and put in the order of a hash of doc_id in one task, which is as small on any corpus.
    """
    p = DEFAULTS | params
    order = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(SHARES))
    rows = labelled.where(F.col("label").isNotNull()).select("doc_id", "text", F.col("label").cast("double").alias("label"), order.alias("k"))
    total = rows.select("label").count()
    sample = materialize(rows.where(F.col("k") < F.lit(_share(total, p["max_train"]))), "training")
    size = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > p["max_train_bytes"]:
        at = sample.agg(F.max("k")).first()[0]
        sample = sample.where(F.col("k") <= F.lit(int(at * p["max_train_bytes"] / size)))

    def learn(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            w = train_ftrl([(b.column(b.schema.get_field_index("text")), b.column(b.schema.get_field_index("label")).to_numpy()) for b in got], p)
            hot = np.flatnonzero(w)
            yield pa.RecordBatch.from_pydict({"idx": [hot.astype("<i4").tobytes()], "w": [w[hot].astype("<f8").tobytes()]})

    # the shuffle moves the sample only
    found = sample.repartition(1).sortWithinPartitions("k", "doc_id", "text").mapInArrow(tidy(learn), "idx binary, w binary").collect()
    out = np.zeros(p["n_features"] + 1)
    for r in found:
        out[np.frombuffer(r["idx"], "<i4")] = np.frombuffer(r["w"], "<f8")
    return out.tobytes()


def score_quality(docs: DataFrame, weights: bytes, col: str = "text", **params) -> DataFrame:
    """``docs`` with a column quality_score in 0..1; no shuffle."""
    p = DEFAULTS | params
    model = docs.sparkSession.sparkContext.broadcast(weights)
    docs, schema = replacing(docs, quality_score="double")

    def score(batches):
        w = np.frombuffer(model.value, "<f8")
        for b in batches:
            buf, off = string_buffers(b.column(b.schema.get_field_index(col)))
            out = np.zeros(b.num_rows)
            for i, j in runs_of_docs(off, p["block_bytes"]):
                ids, o, n = text_features(buf[off[i]: off[j]], off[i: j + 1] - off[i], p["n_features"])
                acc = np.concatenate([[0.0], np.cumsum(w[ids])])
                out[i:j] = (acc[o[1:]] - acc[o[:-1]]) * (p["scale"] / np.maximum(1, n))
            out = 1 / (1 + np.exp(-np.clip(out + w[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "quality_score"])

    return docs.mapInArrow(tidy(score), schema)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, label of the labelled rows that may be learned from: crc32(doc_id) mod 5 is not 0."""
    keep = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    known = labels.where(keep).select("doc_id", F.col("quality").alias("label"))
    return docs.select("doc_id", "text").join(known, "doc_id")


def sampled_training(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """As ``training_rows``, but labels are sampled before the join, so that few texts move."""
    keep = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    known = labels.where(keep & F.col("quality").isNotNull()).select("doc_id", F.col("quality").alias("label"))
    known = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(SHARES)) < F.lit(_share(known.count(), max_train)))
    # the sample of labels is bounded by max_train rows of 16 bytes
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


THRESHOLD = 0.3


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = fit(sampled_training(docs, labels, DEFAULTS["max_train"]))
    scored = score_quality(docs.select("doc_id", "text"), weights)
    return scored.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)).alias("held_out"),
        F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op5_quality_classifier": op5_quality_classifier}
