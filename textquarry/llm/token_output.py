"""Token-ID output: documents become ids, entropy-coded with one shared static table, in independent blocks.

Tokenising runs where the texts are read, once; the ids (2 or 4 bytes each) are stored in the shared folder. A pass over them
counts each id: that is the one frequency table, bounded by the vocabulary, which is broadcast. Then the ids are shuffled,
once, to parts that are ranges of doc_id, and each part encodes its documents in ascending doc_id order as blocks of the
format in ``rans``: interleaved lanes, checkpoints, checksums. Blocks hold whole documents and don't depend on each other.

File format
    A Parquet folder written by Spark's committer, one row per block: part, block, part_offset (ids of the part before
    the block), n_tokens, doc_ids and lengths (little-endian int64, zlib), payload (the coded block), and on a part's
    first block freq (the shared table, little-endian uint32, zlib). Its folder _starts has the ids before each part. Ascending (part, block) is ascending doc_id.

Defined cases
    A null or empty text is the end id alone. The text of an added token, as ``<|endoftext|>``, is that token, wherever it stands, as in the
    library's own call. Documents with the same doc_id (or a null one, which sorts first) are kept, one
    after another in the order of their ids (in no fixed order where one doc_id fills several parts). An empty table writes no block. A very long text is a block of its own. doc_ids of 2^53
    and more keep their order (ranges are cut on doubles, which keep it too). Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import rans
from textquarry.llm.common import checked_broadcast, discard, materialize, runs_of_docs, scratch, stored_dir, string_buffers, table, tidy, tidy_group
from textquarry.operators.scan import running

DEFAULTS = {"end_id": 0, "part_bytes": 8 << 20, "max_ranges": 20_000, "block_tokens": 1 << 20, "read_block": 1_000_000}

MAX_BROADCAST_PARTS = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


LEAST = -1.7976931348623157e308  # the place of a null doc_id among doubles


def with_parts(docs: DataFrame, n_parts: int, max_ranges: int = 20_000, size: str | None = None) -> DataFrame:
    """``docs`` with ``part``: ranges of doc_id of about equal counts, or sums of the column ``size``, ascending, nulls first.

    Up to ``max_ranges`` bounds are quantiles on the driver; for more parts each such range is cut at its own quantiles. With ``size``, a
    doc_id (null, too) that holds more than two parts, and one in ``max_ranges`` of all, is a range of its own, its rows dealt to pieces; ``docs``
    must then be stored, since rows are dealt by their places.
    """
    from pyspark.ml.feature import Bucketizer

    key = F.coalesce(F.col("doc_id").cast("double"), F.lit(LEAST))
    docs = docs.withColumn("part_key", key)
    ranges = min(n_parts, max_ranges)
    if ranges < 2:
        return docs.withColumn("part", F.lit(0)).drop("part_key")
    known, heavy = docs.select("part_key"), []
    if size:
        total = docs.agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n")).first()
        one = docs.groupBy("part_key").agg(F.sum(size).alias("b"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        # at most half as many as ranges; from 2^53 on, several ids may be one double
        heavy = [(r["part_key"], min(1 << 20, -(-r["b"] * n_parts // total["b"]))) for r in one.where(
            (F.col("b") > F.lit(2 * total["b"] / ranges)) & F.col("low").eqNullSafe(F.col("high"))).collect()] if total["b"] else []
        # a row of twice the mean size counts twice
        known = docs.select("part_key", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(10_000), F.floor(F.col(size) * F.lit(total["n"] / max(1, total["b"] or 0))) + 1).cast("int")))).select("part_key")
    at = [i / ranges for i in range(ranges + 1)]
    bounds = known.where(F.col("part_key") > LEAST).approxQuantile("part_key", at, 0.2 / ranges)
    edges = {x for k, _ in heavy for x in (k, float(np.nextafter(k, np.inf)))}
    inner = sorted(({*bounds[1:-1]} | edges) - {LEAST, min(bounds, default=LEAST)})
    if not inner:
        return docs.withColumn("part", F.lit(0)).drop("part_key")
    cut = Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol="part_key", outputCol="part", handleInvalid="keep")
    out = cut.transform(docs).withColumn("part", F.col("part").cast("int"))
    pieces = -(-n_parts // ranges)
    if not heavy and pieces == 1:
        return out.drop("part_key")
    most = max([pieces, *(n for _, n in heavy)])
    place = F.lit(0)
    if pieces > 1:
        within = out.groupBy(F.col("part").alias("_range")).agg(F.percentile_approx("part_key", [i / pieces for i in range(1, pieces)], 10 * pieces).alias("_cuts"))
        out = out.join(checked_broadcast(within, max_ranges * 2), F.col("part") == F.col("_range")).drop("_range")  # one row per range
        place = F.size(F.filter("_cuts", lambda x: x < F.col("part_key")))
    dealt = F.lit(1)
    for k, n in heavy[:100]:
        dealt = F.when(F.col("part_key") == k, F.lit(n)).otherwise(dealt)
    if len(heavy) > 100:
        table = docs.sparkSession.createDataFrame(heavy[100:], "_heavy double, _n int")
        out = out.join(F.broadcast(table), F.col("part_key") == F.col("_heavy"), "left")  # fewer than ranges
        dealt = F.coalesce("_n", dealt)
    place = F.when(dealt > 1, F.pmod(F.xxhash64(F.monotonically_increasing_id()), dealt)).otherwise(place)
    return out.withColumn("part", F.col("part").cast("long") * most + place).drop("part_key", "_cuts", "_heavy", "_n")


def tokenize(docs: DataFrame, path: str, col: str = "text", **params) -> DataFrame:
    """doc_id, ids (packed little-endian uint16 or uint32, end id included); no shuffle."""
    p = DEFAULTS | params

    def run(batches):
        from textquarry.llm.pretokens import tokenizer

        tok = tokenizer(path)
        kind = "<u2" if tok.n_ids <= 1 << 16 else "<u4"
        for b in batches:
            buf, off = string_buffers(b.column(b.schema.get_field_index(col)))
            doc = b.column(b.schema.get_field_index("doc_id"))
            for i, j in runs_of_docs(off, p["read_block"]):
                ids, o = tok.encode(buf[off[i]: off[j]], off[i: j + 1] - off[i])
                n = np.diff(o) + 1
                done = np.concatenate([[0], np.cumsum(n)])
                out = np.full(done[-1], p["end_id"], kind)
                out[np.arange(len(ids)) + np.repeat(np.arange(j - i), np.diff(o))] = ids
                size = out.dtype.itemsize
                packed = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((done * size).astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays([doc.slice(i, j - i), packed.cast(pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", col).mapInArrow(tidy(run), "doc_id long, ids binary")


def frequencies(tokens: DataFrame, n_ids: int) -> np.ndarray:
    """How often each id occurs in all of ``tokens``: at most n_ids rows come to the driver."""
    kind = "<u2" if n_ids <= 1 << 16 else "<u4"

    def count(batches):
        total = np.zeros(n_ids, np.int64)
        for b in batches:
            raw, off = string_buffers(b.column(0))
            for i, j in runs_of_docs(off, 4 << 20):
                total += np.bincount(np.frombuffer(raw[off[i]: off[j]].tobytes(), kind), minlength=n_ids)
        hot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hot, pa.int32()), pa.array(total[hot], pa.int64())], names=["id", "n"])

    out = np.zeros(n_ids, np.int64)
    for r in tokens.select("ids").mapInArrow(tidy(count), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, n_ids: int, **params) -> None:
    """Write ``docs`` (doc_id, text) in the file format to the folder ``path``."""
    p = DEFAULTS | params
    kind = "<u2" if n_ids <= 1 << 16 else "<u4"
    size = np.dtype(kind).itemsize
    tokens = materialize(tokenize(docs.select("doc_id", "text"), tokenizer, **p), "token-ids")
    freq = docs.sparkSession.sparkContext.broadcast(rans.normalise(frequencies(tokens, n_ids)).astype("<u4").tobytes())
    n_bytes = tokens.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    dealt = with_parts(tokens.withColumn("n_bytes", F.octet_length("ids")), max(1, -(-n_bytes // p["part_bytes"])), p["max_ranges"], "n_bytes").drop("n_bytes")

    def encode(t: pa.Table) -> pa.Table:
        out = {k: [] for k in ("part", "block", "part_offset", "n_tokens", "doc_ids", "lengths", "payload", "freq")}
        coder = rans.Table(np.frombuffer(freq.value, "<u4"))
        part = t["part"][0].as_py()
        ids = t["doc_id"].combine_chunks()
        t = t.select(["doc_id", "ids"])
        # nulls first; equal ids by their tokens
        if t.num_rows > 1:
            t = pa.concat_tables([t.filter(ids.is_null()), t.filter(ids.is_valid())])
            key = t["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy()
            order = np.argsort(key, kind="stable")
            key = key[order]
            same = np.flatnonzero(np.diff(np.concatenate([[False], key[1:] == key[:-1], [False]]).astype(np.int8)))
            col = t["ids"]
            for a, b in zip(same[::2], same[1::2]):
                order[a: b + 1] = sorted(order[a: b + 1], key=lambda k: col[int(k)].as_py())
            t = t.take(pa.array(order))
        raw, off = string_buffers(t["ids"])
        docs_ = np.array(t["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy(), "<i8")
        done = 0
        for k, (i, j) in enumerate(runs_of_docs(off, p["block_tokens"] * size)):
            block = np.frombuffer(raw[off[i]: off[j]].tobytes(), kind)
            lens = (np.diff(off[i: j + 1]) // size).astype("<i8")
            out["part"].append(part)
            out["block"].append(k)
            out["part_offset"].append(done)
            out["n_tokens"].append(len(block))
            out["doc_ids"].append(zlib.compress(docs_[i:j].tobytes(), 1))
            out["lengths"].append(zlib.compress(lens.tobytes(), 1))
            out["payload"].append(rans.encode(block, coder))
            out["freq"].append(zlib.compress(freq.value, 6) if k == 0 else None)
            done += len(block)
        types = {"part": pa.int64(), "block": pa.int32(), "part_offset": pa.int64(), "n_tokens": pa.int64()}
        return pa.table({k: pa.array(v, types.get(k, pa.binary())) for k, v in out.items()})

    blocks = dealt.groupBy("part").applyInArrow(
        tidy_group(encode), "part long, block int, part_offset long, n_tokens long, doc_ids binary, lengths binary, payload binary, freq binary")
    blocks.write.option("compression", "none").parquet(path)
    discard(tokens)
    spark = docs.sparkSession
    with scratch():  # ids before each part, any number of parts
        totals = materialize(spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")), "part-sizes")
        starts = running(totals, [], ["part"], {"upto": ("sum", F.col("n"))}).select("part", (F.col("upto") - F.col("n")).alias("part_start"))
        starts.write.parquet(f"{path}/_starts")


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Documents of a folder written by ``write_tokens``: doc_id, start, n_tokens and ids, or their crc32 (``digest``)."""
    blocks = spark.read.parquet(path)
    table_row = blocks.where(F.col("freq").isNotNull()).select("freq").limit(1).collect()
    freq = spark.sparkContext.broadcast(table_row[0]["freq"] if table_row else b"")  # bounded by the vocabulary
    begin = spark.read.schema("part long, part_start long").parquet(f"{path}/_starts")
    # a row of 16 bytes per part
    few = begin.count() <= MAX_BROADCAST_PARTS

    def decode(batches):
        coder = None
        for b in batches:
            for r in b.to_pylist():
                coder = coder or rans.Table(np.frombuffer(zlib.decompress(freq.value), "<u4"))
                ids = rans.decode(r["payload"], coder).astype("<u4")
                docs_ = np.frombuffer(zlib.decompress(r["doc_ids"]), "<i8")
                lens = np.frombuffer(zlib.decompress(r["lengths"]), "<i8")
                off = np.concatenate([[0], np.cumsum(lens)])
                raw = memoryview(ids.tobytes())
                spans = [raw[4 * x: 4 * y] for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
                last = pa.array([zlib.crc32(s) for s in spans], pa.int64()) if digest else pa.array([bytes(s) for s in spans], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs_, mask=docs_ == np.iinfo(np.int64).min), pa.array(r["part_start"] + r["part_offset"] + off[:-1]), pa.array(lens), last],
                    names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    kind = "ids_crc32 long" if digest else "ids binary"
    placed = blocks.join(F.broadcast(begin) if few else begin, "part")
    return placed.select("part_start", "part_offset", "doc_ids", "lengths", "payload").mapInArrow(tidy(decode), f"doc_id long, start long, n_tokens long, {kind}")


def token_id_output(docs: DataFrame, tokenizer: str | None = None, path: str | None = None, **params) -> DataFrame:
    """Write ``docs`` (doc_id, text) to ``path`` (default: the shared folder) and read the digest of each back."""
    spark = docs.sparkSession
    name = tokenizer or default_tokenizer()
    target = path or f"{stored_dir(spark)}/tokens-{uuid.uuid4().hex}"
    from tokenizers import Tokenizer

    write_tokens(docs, target, name, Tokenizer.from_file(name).get_vocab_size(), **params)
    return read_tokens(spark, target, digest=True)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_id_output(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op2_token_output": op2_token_output}
