r"""Importance resampling towards a target distribution of hashed word features, in two passes over Arrow batches.

Words are the runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z are lower-cased; features are all runs of 1 to ``order`` words,
joined by one space; a feature's bucket is the crc32 of its bytes modulo ``n_buckets``.

1. Every task counts the buckets of its own texts with np.bincount into one vector (80 KB), and ``treeReduce`` merges the vectors of
   all tasks, as many steps deep as needed for at most some ``fan_in`` vectors in one task or the driver. This is done for the corpus and the target.
2. Each bucket's gain, floor(1000 ln of the ratio of smoothed shares), is broadcast (80 KB); batches gather the gains of their
   features and sum them per document with np.bincount's weights. Noise of the Gumbel distribution, from a hash of the doc_id, makes
   the highest scores a sample without replacement in proportion to the weights.

The documents with the highest scores are drawn exactly: rows without text are dealt by ranges of (eligible, score, doc_id) and numbered
part by part, so the ranks of any number of documents are found without gathering them.

Both passes read the texts; nothing of them is shuffled or stored.

Defined cases
    A null or empty text has no features and weight 0. A null doc_id hashes as if it were empty, and comes after all other ids among equal
    scores. Rows that share a doc_id are documents of their own, with the same noise; equal rows get adjoining ranks. A very long text is
    hashed whole, as a block of its own. With an empty target or corpus the smoothed shares stand. An empty table gives no rows.
    ``weigh`` replaces columns n_words, n_features and weight of its input and keeps the others; ``resample`` reads doc_id and text only.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import replacing, runs_of_docs, ship_package, string_buffers, table, tidy, word_spans
from textquarry.operators.scan import running, with_row_ids

DEFAULTS = {"n_buckets": 10_000, "order": 1, "block_bytes": 4 << 20, "fan_in": 64, "least_words": 20, "percent": 10, "seed": 2024}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z
_SHORT = 48  # bytes; longer features are hashed one by one


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def crc32s(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each byte span: one step for the n-th bytes of all spans that are that long."""
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    order = order[int(np.searchsorted(-size[order], -_SHORT, side="left")):]
    lens, at, crc = size[order], starts[order], out[order]
    for k in range(int(lens[0]) if len(lens) else 0):
        m = int(np.searchsorted(-lens, -k, side="left"))  # spans of more than k bytes
        crc[:m] = _CRC[(crc[:m] ^ buf[at[:m] + k]) & 0xFF] ^ (crc[:m] >> np.uint32(8))
    out[order] = ~crc
    for i in np.flatnonzero(size > _SHORT):
        out[i] = zlib.crc32(buf[starts[i]: ends[i]].tobytes())
    return out


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words with one space behind each, and where each begins (the end of all as last entry)."""
    size = ends - starts + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(begin[-1]), 32, np.uint8)
    inside = np.arange(int(begin[-1])) - np.repeat(begin[:-1], size)
    word = inside < np.repeat(size - 1, size)
    out[word] = buf[(np.repeat(starts, size) + inside)[word]]
    return out, begin


def features(buf: np.ndarray, offsets: np.ndarray, n_buckets: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document) of every feature of the documents that ``offsets`` cut from ``buf``, and the documents' numbers of words."""
    low = _LOWER[buf]
    starts, ends, first = word_spans(low, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if order == 1:
        return (crc32s(low, starts, ends) % np.uint32(n_buckets)).astype(np.int64), doc, np.diff(first)
    text, begin = _joined(low, starts, ends)
    buckets, docs = [], []
    for n in range(1, order + 1):
        k = np.arange(max(0, len(starts) - n + 1))
        k = k[doc[k] == doc[k + n - 1]]
        buckets.append((crc32s(text, begin[k], begin[k + n] - 1) % np.uint32(n_buckets)).astype(np.int64))
        docs.append(doc[k])
    return np.concatenate(buckets), np.concatenate(docs), np.diff(first)


def _blocks(column: pa.Array, p: dict):
    """(first document, number of documents, buckets, documents from 0, words per document) of runs of a batch's texts."""
    buf, off = string_buffers(column)
    for i, j in runs_of_docs(off, p["block_bytes"]):
        yield i, j - i, *features(buf[off[i]: off[j]], off[i: j + 1] - off[i], p["n_buckets"], p["order"])


def bucket_counts(docs: DataFrame, col: str = "text", **params) -> np.ndarray:
    """Features in each bucket, over all of ``docs``."""
    p = DEFAULTS | params
    ship_package(docs.sparkSession)

    def count(batches):
        total = np.zeros(p["n_buckets"], np.int64)
        for b in batches:
            for _, _, bucket, _, _ in _blocks(b.column(0), p):
                total += np.bincount(bucket, minlength=p["n_buckets"])
        yield pa.RecordBatch.from_pydict({"counts": [total.tobytes()]})

    vectors = docs.select(col).mapInArrow(tidy(count), "counts binary").rdd.map(lambda r: np.frombuffer(r["counts"], np.int64))
    n = vectors.getNumPartitions()
    if not n:
        return np.zeros(p["n_buckets"], np.int64)
    return vectors.treeReduce(np.add, depth=max(2, math.ceil(math.log(n, p["fan_in"]))))


def gains(counts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of (t+1)(S+n) / ((s+1)(T+n))) per bucket, in doubles."""
    n = len(counts)
    s, t, all_s, all_t = counts.astype(np.float64), target.astype(np.float64), float(counts.sum()), float(target.sum())
    return np.floor(1000 * np.log((t + 1) * (all_s + n) / ((s + 1) * (all_t + n))))


def weigh(docs: DataFrame, gain: np.ndarray, col: str = "text", **params) -> DataFrame:
    """``docs`` with n_words, n_features and weight (the sum of its features' gains); no shuffle."""
    p = DEFAULTS | params
    model = docs.sparkSession.sparkContext.broadcast(gain)  # n_buckets numbers
    docs, schema = replacing(docs, n_words="bigint", n_features="bigint", weight="bigint")

    def score(batches):
        for b in batches:
            words, n, weight = np.zeros((3, b.num_rows), np.int64)
            for i, k, bucket, doc, own in _blocks(b.column(b.schema.get_field_index(col)), p):
                words[i: i + k] = own
                n[i: i + k] = np.bincount(doc, minlength=k)
                weight[i: i + k] = np.bincount(doc, weights=model.value[bucket], minlength=k).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(words), pa.array(n), pa.array(weight)], names=schema.names)

    return docs.mapInArrow(tidy(score), schema)


def resample(docs: DataFrame, target: DataFrame, **params) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of all ``docs`` (doc_id, text), drawn towards the texts of ``target``."""
    p = DEFAULTS | params
    gain = gains(bucket_counts(docs, **params), bucket_counts(target, **params))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{p['seed']}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weigh(docs.select("doc_id", "text"), gain, **params).select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))
    scored = with_row_ids(scored, "_row")
    short = F.col("n_words") < p["least_words"]
    drawn = p["percent"] * scored.where(~short).count() // 100
    keys = scored.select("*", short.alias("_short"), (-F.col("score")).alias("_down"), F.col("doc_id").isNull().alias("_without_id"))
    numbered = running(keys, [], ["_short", "_down", "_without_id", "doc_id", "_row"], {"_rank": ("sum", F.lit(1).cast("long"))},
                       keep=["doc_id", "n_features", "weight", "score"])
    # rows of too few words come after all others, so none of them is within the draw
    return numbered.select("doc_id", "n_features", "weight", "score", F.when(F.col("_rank") <= drawn, F.col("_rank")).alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_importance_resampling": op13_importance_resampling}

ORACLE_SQL = {"op13_importance_resampling": r"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS tab FROM range(256) r(i)
), d AS (
  SELECT doc_id, row_number() OVER () AS k, WORDS AS w FROM documents
), dw AS (
  SELECT k, unnest(w) AS word FROM d
), tw AS (
  SELECT unnest(WORDS) AS word FROM benchmark
), v AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM tw)
), vb AS (
  SELECT word, list_prepend(4294967295, list_transform(range(length(h) // 2),
    lambda i: 16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)) AS bytes FROM v
), b AS (
  SELECT word, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM vb, crc
), g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM tw) + 10000)::DOUBLE))) AS gain
  FROM (SELECT bucket, count(*) AS s FROM dw JOIN b USING (word) GROUP BY bucket)
  FULL JOIN (SELECT bucket, count(*) AS t FROM tw JOIN b USING (word) GROUP BY bucket) USING (bucket)
), w AS (
  SELECT k, count(*) AS n, sum(gain) AS weight FROM dw JOIN b USING (word) JOIN g USING (bucket) GROUP BY k
), x AS (
  SELECT doc_id, k, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    list_reduce(list_prepend(0::BIGINT, list_transform(range(8), lambda i: (instr('0123456789abcdef', sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[i + 1]) - 1)::BIGINT)), lambda a, c: 16 * a + c) AS h
  FROM d LEFT JOIN w USING (k)
), y AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score, n_features >= 20 AS enough FROM x
), z AS (
  SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id NULLS LAST, k) AS place, sum(enough::INT) OVER () AS n FROM y
)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= (10 * n) // 100 THEN place END AS rank FROM z
""".replace("WORDS", r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")}
