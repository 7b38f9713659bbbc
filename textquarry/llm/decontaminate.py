r"""Benchmark decontamination by spaced-seed hashing, as DataFrame expressions only.

Words are runs of letters, digits and characters outside ASCII, lower-cased. At every word of a text two seeds are hashed:
fixed masks that read four of six words or five and ignore the others. Seeds equal to a benchmark item's give an alignment (the
difference of positions); each distinct alignment is then verified word by word. An overlap counts if some window of 13
aligned words (the whole item, if it is shorter) lies inside both and has at most 3 unequal words (2 for windows of 10 to 12
words, 1 for 7 to 9). The two masks are lossless for this: every such window contains at least one seed without a
difference, so the result is exactly that of comparing all alignments.

An item of fewer than 7 words, too short for the masks, is looked for as an exact copy of all its words.

Documents are read twice: once for seeds, then those with an alignment for its check. Seeds stream through one generated
stage into the join, none is shuffled while the benchmark's seeds are counted to be under ``broadcast_rows``; beyond that the join
shuffles. Likewise for the ids of the documents to check, and for the items' words, which are counted in bytes as well. Alignments
that share fewer words than a window are dropped before they are stored; of a document only the aligned words go beyond its own join.
Short items cost one more read, only where the benchmark has some.

Defined cases
    A null text has no words. An item of one word is found wherever that word stands. Rows that share a doc_id count as one
    document: it overlaps if one of them does. A null doc_id or item_id is an id like others. Repeated items give their
    item_id once. Empty tables overlap with nothing. Very long texts are compared whole. Other columns are not read, whatever
    their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import checked_broadcast, materialize, table

MASKS = ((0, 3, 4, 5), (0, 1, 2, 4))
SPAN = 6
LEAST = 7
WINDOW = 13
DEFAULTS = {"broadcast_rows": 1_000_000}


def words(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")


def allowed(window: Column) -> Column:
    """Unequal words that a window of this many words may have."""
    return F.when(window >= 13, 3).when(window >= 10, 2).otherwise(1)


def seeds(df: DataFrame, *keep: str) -> DataFrame:
    """One row per seed: the ``keep`` columns, pos, and the hash of the masked words of column w."""
    at = df.where(F.size("w") >= SPAN).select(*keep, "w", F.explode(F.sequence(F.lit(0), F.size("w") - SPAN)).alias("pos"))
    hashes = [F.xxhash64(F.lit(k), *[F.col("w")[F.col("pos") + x] for x in m]) for k, m in enumerate(MASKS)]
    return at.select(*keep, "pos", F.explode(F.array(*hashes)).alias("seed"))


def short_overlaps(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame | None:
    """The same as ``overlaps`` for items of fewer than 7 words: exact copies of all their words. None if there are no such items."""
    p = DEFAULTS | params
    items = benchmark.select("item_id", words(F.col("text")).alias("b")).where(F.size("b").between(1, LEAST - 1)).distinct()
    sizes = sorted(r["n"] for r in items.select(F.size("b").alias("n")).distinct().collect())  # six at most
    if not sizes:
        return None
    texts = docs.select("doc_id", words(F.col("text")).alias("w"))
    at = texts.select("doc_id", "w", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("n")).where(F.size("w") >= F.col("n"))
    grams = at.select("doc_id", "w", "n", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))).alias("pos")).select(
        "doc_id", "pos", F.slice("w", F.col("pos") + 1, F.col("n")).alias("b"))
    return grams.join(checked_broadcast(items, p["broadcast_rows"]), "b").groupBy("doc_id", "item_id").agg(
        F.min("pos").cast("long").alias("doc_word"), F.max(F.size("b")).cast("long").alias("n_equal"))


def overlaps(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """(doc_id, item_id, doc_word, n_equal): overlapping pairs, with the first word of the first such window in the document
    and the greatest number of equal words on one alignment that has such a window."""
    p = DEFAULTS | params
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") >= LEAST).distinct().withColumn("m", F.size("w"))
    item_seeds = seeds(items, "item_id", "m").select("item_id", "m", F.col("pos").alias("item_pos"), "seed").distinct()
    texts = docs.select("doc_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    # the aligned words are those from lo to hi of the item, from lo + shift of the document
    lo = F.greatest(F.lit(0), -F.col("shift"))
    hi = F.least(F.col("m"), F.col("n") - F.col("shift"))
    size = F.least(F.lit(WINDOW), F.col("m"))
    hits = seeds(texts, "doc_id", "n").join(checked_broadcast(item_seeds, p["broadcast_rows"]), "seed").select(
        "doc_id", "n", "item_id", "m", (F.col("pos") - F.col("item_pos")).alias("shift")).where(hi - lo >= size).distinct()
    hits = materialize(hits, "alignments")
    ids = hits.select(F.col("doc_id").alias("hit_id")).distinct()
    check = texts.join(checked_broadcast(ids, p["broadcast_rows"]), F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_semi")
    h = hits.select(F.col("doc_id").alias("hit_id"), F.col("n").alias("hit_n"), F.col("item_id").alias("hit_item"), F.col("m").alias("hit_m"), "shift", lo.alias("lo"), (hi - lo).alias("len"), size.alias("size"))
    # of a document only the aligned words go on
    parts = check.join(h, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("n") == F.col("hit_n"))).select(
        "doc_id", "hit_item", "hit_m", "shift", "lo", "len", "size", F.slice("w", F.col("lo") + F.col("shift") + 1, F.col("len")).alias("part"))
    pairs = parts.join(
        checked_broadcast(items.select("item_id", "m", F.col("w").alias("b"), F.octet_length(F.concat_ws(" ", "w")).alias("n_bytes")), p["broadcast_rows"], "n_bytes"),
        F.col("item_id").eqNullSafe(F.col("hit_item")) & (F.col("m") == F.col("hit_m")))
    equal = pairs.select("doc_id", "item_id", "shift", "lo", "size", F.zip_with("part", F.slice("b", F.col("lo") + 1, F.col("len")), lambda x, y: (x == y).cast("int")).alias("eq"))
    starts = F.filter(F.sequence(F.lit(0), F.size("eq") - F.col("size")), lambda s: F.aggregate(
        F.slice("eq", s + 1, F.col("size")), F.lit(0), lambda a, x: a + x) >= F.col("size") - allowed(F.col("size")))
    good = equal.select(
        "doc_id", "item_id", starts.alias("s"), (F.col("lo") + F.col("shift")).alias("from"),
        F.aggregate("eq", F.lit(0), lambda a, x: a + x).alias("n")).where(F.size("s") > 0)
    found = good.groupBy("doc_id", "item_id").agg(
        F.min(F.col("from") + F.array_min("s")).cast("long").alias("doc_word"), F.max("n").cast("long").alias("n_equal"))
    short = short_overlaps(docs, benchmark, **params)
    if short is None:
        return found
    # an item_id may have texts of either kind
    return found.unionByName(short).groupBy("doc_id", "item_id").agg(
        F.min("doc_word").alias("doc_word"), F.max("n_equal").alias("n_equal"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """``docs`` without the documents that overlap a benchmark item."""
    p = DEFAULTS | params
    bad = materialize(overlaps(docs, benchmark, **params).select(F.col("doc_id").alias("bad_id")).distinct(), "contaminated")
    bad = checked_broadcast(bad, p["broadcast_rows"])
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontamination": op4_decontamination}

ORACLE_SQL = {"op4_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark
), dw AS (
  SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d
), bw AS (
  SELECT item_id, len(w) AS m, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS q FROM b WHERE len(w) >= 7
), e AS (
  SELECT doc_id, item_id, p - q AS shift, q, n, m FROM dw JOIN bw USING (word)
), g AS (
  SELECT doc_id, item_id, shift, count(*) AS c, greatest(0, -shift) AS lo, least(any_value(m), any_value(n) - shift) AS hi,
    least(13, any_value(m)) AS size, list(q) AS qs
  FROM e GROUP BY doc_id, item_id, shift HAVING count(*) >= 6
), k AS (
  SELECT *, CASE WHEN size >= 13 THEN 3 WHEN size >= 10 THEN 2 ELSE 1 END AS allowed FROM g WHERE hi - lo >= size
), s AS (
  SELECT *, unnest(range(lo, hi - size + 1)) AS st FROM k
), ok AS (
  SELECT *, len(list_filter(qs, lambda x: x >= st AND x < st + size)) AS eq FROM s
), t AS (
  SELECT item_id, w, len(w) AS m FROM b WHERE len(w) BETWEEN 1 AND 6
), f AS (
  SELECT doc_id, item_id, p, w, m FROM (SELECT doc_id, word, p FROM dw) JOIN t ON word = t.w[1]
), x AS (
  SELECT f.doc_id, f.item_id, f.p, f.m FROM f JOIN d ON f.doc_id IS NOT DISTINCT FROM d.doc_id WHERE d.w[f.p + 1: f.p + f.m] = f.w
), every AS (
  SELECT doc_id, item_id, st + shift AS place, c FROM ok WHERE eq >= size - allowed UNION ALL SELECT doc_id, item_id, p, m FROM x
)
SELECT doc_id, item_id, min(place)::BIGINT AS doc_word, max(c)::BIGINT AS n_equal FROM every GROUP BY doc_id, item_id
"""}
