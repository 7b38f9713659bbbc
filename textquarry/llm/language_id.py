"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are code points, lower-cased; every run of other characters than letters counts as one space, and a text is
taken with a space on either side (the closing one alone is no feature). Features are the n-grams of 1 to 3 of these characters, hashed to ``n_buckets``.
Counts per (language, bucket) are summed over all learned documents: each task sums its own into dense rows and hands on only
their non-zero cells, and each language's row of log probabilities is made and stored in a task of its own. Scoring broadcasts the
matrix in blocks of ``block_languages`` rows, of a size that depends on nothing else, gathers the cells of a batch's n-grams in
numpy and sums them per document; with more languages than that, one pass after another carries the best one so far.

Defined cases
    A null text, or one without letters, is ``und`` with score 0. Rows with null lang teach nothing; any number of languages is
    learned. Ties go to the language that sorts first. With nothing to learn from every text is ``und``. Repeated rows count as often
    as they occur. A null doc_id is never learned from by the query, and held_out there. A very long text is scored whole, as a block
    of its own. An empty table gives no rows. Columns lang_pred and lang_score of the input are replaced, others stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import U64, materialize, mix64, replacing, string_buffers, table, tidy, tidy_group

DEFAULTS = {"n_buckets": 1 << 16, "orders": (1, 2, 3), "alpha": 0.05, "block_languages": 64, "block_chars": 1 << 20}

_TABLES: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0; one entry for all beyond the basic plane's letters."""
    if "lower" not in _TABLES:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low[0]) if low[0].isalpha() else c
        _TABLES["lower"] = out
    return _TABLES["lower"]


def char_grams(texts: list[str], orders, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket ids, offsets per document, letters per document)."""
    joined = " " + " ".join(texts) + " "
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(lens + 1)])  # of each text's leading space; the last is the closing one
    low = _letters()[cp]
    blank = low == 0
    edge = np.zeros(len(cp), bool)
    edge[begin] = True
    keep = ~blank
    keep |= blank & edge
    keep[1:] |= blank[1:] & ~blank[:-1]
    # a space before a text that starts with other characters than letters would come twice
    keep[1:] &= ~(blank[1:] & blank[:-1] & ~edge[1:])
    # nor may one come before the space that ends a text
    letter = np.maximum.accumulate(np.where(blank, -1, np.arange(len(cp))))
    tail = letter[begin[1:] - 1] + 1
    keep[tail[(tail < begin[1:]) & ~edge[tail]]] = False
    where = np.flatnonzero(keep)
    c = low[where].astype(np.uint64)
    lead = np.searchsorted(where, begin)
    n_letters = np.add.reduceat(np.concatenate([(~blank).astype(np.int64), [0]]), begin[:-1]) if len(texts) else np.zeros(0, np.int64)
    mask = U64(n_buckets - 1)
    parts, where_parts = [], []
    code = np.zeros(len(c), np.uint64)
    pos = np.arange(len(c))
    nxt = lead[1:][np.clip(np.searchsorted(lead, pos, side="right") - 1, 0, len(lead) - 2)]
    for k in range(max(orders)):
        code = code[: len(c) - k] * U64(0x100000001B3) + c[k:] + U64(1)
        if k + 1 in orders:
            p = pos[: len(c) - k]
            inside = p + k <= nxt[: len(p)]
            inside &= p < lead[-1]
            parts.append((mix64(code[inside] + U64(k)) & mask).astype(np.int64))
            where_parts.append(p[inside])
    ids = np.concatenate(parts)
    at = np.concatenate(where_parts)
    order = np.argsort(at, kind="stable")
    ids, at = ids[order], at[order]
    return ids, np.searchsorted(at, lead), n_letters


def _texts(b: pa.RecordBatch, col: str) -> list[str]:
    return [t or "" for t in b.column(b.schema.get_field_index(col)).to_pylist()]


def _blocks(texts: list[str], limit: int):
    i, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield i, k + 1
            i, size = k + 1, 0
    if i < len(texts):
        yield i, len(texts)


def fit(docs: DataFrame, **params) -> DataFrame:
    """The model, stored: one row per language, lang and logs (packed float32 log probabilities of its buckets), from columns
    text and lang of all rows."""
    p = DEFAULTS | params
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def cells(total):
        for lang, n in total.items():
            hot = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hot), pa.string()), pa.array(hot.astype(np.int32)), pa.array(n[hot])],
                                             names=["lang", "bucket", "n"])

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = _texts(b, "text"), np.array(b.column(b.schema.get_field_index("lang")).to_pylist(), object)
            for i, j in _blocks(texts, p["block_chars"]):
                ids, off, _ = char_grams(texts[i:j], p["orders"], p["n_buckets"])
                per = np.diff(off)
                for lang in set(langs[i:j]):
                    sel = np.repeat(langs[i:j] == lang, per)
                    got = np.bincount(ids[sel], minlength=p["n_buckets"])
                    total[lang] = total[lang] + got if lang in total else got
                    if len(total) >= p["block_languages"]:  # a task holds so many rows at most
                        yield from cells(total)
                        total = {}
        yield from cells(total)

    def row(t: pa.Table) -> pa.Table:
        n = np.zeros(p["n_buckets"])
        n[t["bucket"].to_numpy()] = t["n"].to_numpy()
        logs = np.log(n + p["alpha"]) - np.log(n.sum() + p["alpha"] * p["n_buckets"])
        return pa.table({"lang": t["lang"][:1].combine_chunks(), "logs": pa.array([logs.astype("<f4").tobytes()], pa.binary())})

    summed = rows.mapInArrow(tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return materialize(summed.groupBy("lang").applyInArrow(tidy_group(row), "lang string, logs binary"), "languages")


def predict(docs: DataFrame, model: DataFrame, col: str = "text", **params) -> DataFrame:
    """``docs`` with lang_pred and lang_score (posterior of the predicted language, prior uniform); no shuffle."""
    p = DEFAULTS | params
    names = sorted(r["lang"] for r in model.select("lang").collect())
    docs, _ = replacing(docs, lang_pred="string", lang_score="double")
    if not names:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("lang_score", F.lit(0.0))
    for k in range(0, len(names), p["block_languages"]):
        docs = _score_block(docs, model, names[k: k + p["block_languages"]], k == 0, col, p)
    found = F.col("_mass").isNotNull()
    return docs.withColumn("lang_pred", F.when(found, F.col("lang_pred")).otherwise("und")).withColumn(
        "lang_score", F.when(found, 1 / F.col("_mass")).otherwise(0.0)).drop("_mass")


def _score_block(docs: DataFrame, model: DataFrame, names: list[str], first: bool, col: str, p: dict) -> DataFrame:
    """lang_pred, lang_score (its log likelihood) and _mass (all likelihoods as multiples of it) after these languages, too."""
    got = {r["lang"]: r["logs"] for r in model.where(F.col("lang").isin(names)).collect()}
    cells = np.stack([np.frombuffer(got[n], "<f4") for n in names], 1)  # at most block_languages x n_buckets
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(cells).tobytes())
    rest, schema = replacing(docs, lang_pred="string", lang_score="double", _mass="double")
    keep = rest.columns

    def score(batches):
        by_bucket = np.frombuffer(shared.value, "<f4").reshape(-1, len(names))
        for b in batches:
            texts = _texts(b, col)
            said, top, mass = np.full(len(texts), None, object), np.full(len(texts), np.nan), np.full(len(texts), np.nan)
            for i, j in _blocks(texts, p["block_chars"]):
                ids, off, letters = char_grams(texts[i:j], p["orders"], p["n_buckets"])
                sums = np.empty((j - i, len(names)))
                for k in range(len(names)):
                    acc = np.concatenate([[0.0], np.cumsum(by_bucket[ids, k], dtype=np.float64)])
                    sums[:, k] = acc[off[1:]] - acc[off[:-1]]
                some = np.flatnonzero(letters > 0)
                best = sums[some].argmax(1)
                top[i + some] = sums[some, best]
                mass[i + some] = np.exp(sums[some] - sums[some, best][:, None]).sum(1)
                said[i + some] = np.array(names, object)[best]
            if not first:
                was, was_top, was_mass = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("lang_pred", "lang_score", "_mass"))
                more = top > was_top  # a language of an earlier block wins ties
                with np.errstate(over="ignore"):
                    mass = np.where(more, mass + was_mass * np.exp(was_top - top), was_mass + mass * np.exp(top - was_top))
                said, top = np.where(more, said, was), np.where(more, top, was_top)
            none = np.isnan(top)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(said.tolist(), pa.string()), pa.array(top, mask=none), pa.array(mass, mask=none)],
                names=[*keep, "lang_pred", "lang_score", "_mass"])

    return docs.mapInArrow(tidy(score), schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    return predict(docs.select("doc_id", "text"), fit(docs.where(~held).select("text", "lang"))).select(
        "doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op7_language_id": op7_language_id}
