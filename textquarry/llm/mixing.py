r"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target divided by its size is a rate between 0 and 2. Each of its documents is taken floor(rate) times for
certain, and once more with the rate's fraction as its inclusion probability. The cube method turns these probabilities
into 0 or 1: a flight moves them through the null-space of the constraints (words and documents of the source keep their
expected totals) until two documents of a block, and ``hold`` that it leaves aside, are undecided. Blocks are salted parts
of a source, each flown in one task; the undecided of all blocks of a source fly again together, round after round. The last
few land one by one, large ones first, each by its own probability, and those after it make up for the words: the error is
about the smallest one's size. Random choices come from a generator seeded by a hash of doc_id, so reruns agree.

Up to ``max_sources`` sources are told their targets from the driver. Beyond that the targets are columns of a table of sources,
the shares come from sums over it, and it is joined by a shuffle, except for the few sources with a large part of the rows.

The words of every text are counted once; (doc_id, source, size, hash of the text) is stored, and only that moves, never a text, until a
caller joins the decisions to its documents.

Defined cases
    A null text has size 0; a document of size 0 adds no words and is still taken or not. Null sources are one source,
    last in order. Rows that share a doc_id (null, too) are documents of their own. Equal rows (same doc_id, source and text) are decided
    together, since they can't be told apart: of their copies some get one more than others, none more than any document may. A text
    of any length is one document. An empty table gives an empty mix. Other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import materialize, mix64, table
from textquarry.operators.scan import running, with_row_ids

WEIGHTS = (3.0, 1.0, 2.0)
DEFAULTS = {"weights": WEIGHTS, "share": 1.5, "most": 2.0, "block_rows": 2_000, "hold": 64, "seed": 41, "max_sources": 100_000}


def word_count(text):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], p: dict) -> dict[str | None, float]:
    """Target words by source: shares by weight, none above ``most`` times its size, the excess reshared by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: p["weights"][i % len(p["weights"])] for i, s in enumerate(names)}
    total = p["share"] * sum(sizes.values())
    out, open_ = {}, list(names)
    while open_:
        per = (total - sum(out.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if per * weight[s] > p["most"] * sizes[s]]
        if not full:
            out |= {s: per * weight[s] for s in open_}
            break
        out |= {s: p["most"] * sizes[s] for s in full}
        open_ = [s for s in open_ if s not in full]
    return out


PLAN = "source string, no_source boolean, source_size long, target double, blocks int"


def _by_table(per_source: DataFrame, p: dict) -> DataFrame:
    """``targets`` for any number of sources: the columns of PLAN and n, from rows (source, size, n); nothing a source is collected.

    A share per weight at which sources fill up gives the next, greater one, until no other fills: one sum over the table each.
    """
    spark = per_source.sparkSession
    part = materialize(
        per_source.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "sources")
    counts, before = [], 0
    for r in part.groupBy("range").agg(F.count(F.lit(1)).alias("k")).orderBy("range").collect():
        counts.append((r["range"], before))
        before += r["k"]
    # one row per range
    rows = part.join(F.broadcast(spark.createDataFrame(counts or [(0, 0)], "range int, before long")), "range")
    weights = F.array(*[F.lit(float(w)) for w in p["weights"]])
    rows = rows.withColumn("weight", F.get(weights, F.pmod(F.col("before") + F.col("at"), F.lit(len(p["weights"]))).cast("int"))).withColumn(
        "top", F.lit(float(p["most"])) * F.col("size"))
    total, per, was = p["share"] * (rows.agg(F.sum("size")).first()[0] or 0), None, -1
    while True:
        full = F.lit(False) if per is None else F.lit(per) * F.col("weight") > F.col("top")
        r = rows.agg(F.sum(full.cast("long")).alias("k"), F.coalesce(F.sum(F.when(full, F.col("top"))), F.lit(0.0)).alias("used"),
                     F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open")).first()
        if not r["open"] or r["k"] == was:
            break
        was, per = r["k"], (total - r["used"]) / r["open"]
    target = F.when(full, F.col("top")).otherwise(F.lit(per or 0.0) * F.col("weight"))
    return rows.select(
        "source", F.col("source").isNull().alias("no_source"), F.col("size").alias("source_size"), target.alias("target"),
        F.greatest(F.lit(1), F.ceil(F.col("n") / p["block_rows"])).cast("int").alias("blocks"), "n")


EPS = 1e-9


def _move(p: list[float], x: list[float], at: list[int], d: tuple[float, ...], rng: np.random.Generator) -> list[int]:
    """Move the entries ``at`` along ``d`` to the first bound on a side picked so that all keep their expectation; who is left."""
    up = min(((1 - p[k]) / v if v > 0 else p[k] / -v) for k, v in zip(at, d) if v)
    down = min((p[k] / v if v > 0 else (1 - p[k]) / -v) for k, v in zip(at, d) if v)
    step = up if rng.random() * (up + down) < down else -down
    for k, v in zip(at, d):
        p[k] += step * v
    left = [k for k in at if EPS < p[k] < 1 - EPS]
    if len(left) == len(at):  # rounding kept all inside; settle the one nearest to an end
        left.remove(min(left, key=lambda k: min(p[k], 1 - p[k])))
    for k in at:
        if k not in left:
            p[k] = float(round(p[k]))
    return left


def flight(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator, hold: int = 0) -> np.ndarray:
    """Fly until at most two entries, and the last ``hold`` undecided ones, are strictly between 0 and 1.

    Three undecided entries at a time move along the null-space of the constraints (1, size), as far as the first bound on
    either side, so sums of prob and of size*prob stay as they are and each move settles at least one entry.
    """
    p, x = [0.0 if v <= EPS else 1.0 if v >= 1 - EPS else float(v) for v in prob], [float(v) for v in size]
    todo = [k for k, v in enumerate(p) if 0 < v < 1]
    live: list[int] = []
    for k in todo[: max(0, len(todo) - hold)]:
        live.append(k)
        if len(live) == 3:
            a, b, c = live
            d = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
            live = _move(p, x, live, d if any(d) else (1.0, -1.0, 0.0), rng)
    return np.array(p)


def land(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator, hold: int = 0) -> np.ndarray:
    """Decide all entries: a flight, then the few left are settled one by one, large ones first, each by its own probability.

    What a settled one takes too much or too little of the words is spread over the probabilities of those after it. Where
    they can't make up for it, decisions are turned that bring the words nearer, large ones first, and a larger one for
    several small ones. The error of the whole is about the smallest one's size.
    """
    p, x = flight(prob, size, rng, max(hold, len(prob) // 4)), np.asarray(size, float)
    open_ = np.flatnonzero((prob > EPS) & (prob < 1 - EPS))
    rest = np.flatnonzero((p > 0) & (p < 1))
    rest = rest[np.argsort(-x[rest], kind="stable")]
    while len(rest):
        k, rest = rest[0], rest[1:]
        room = {v: ((p[rest] if v else 1 - p[rest]) * (x[rest] > 0)) for v in (0.0, 1.0)}
        short = {v: max(0.0, abs(p[k] - v) * x[k] - float((room[v] * x[rest]).sum())) for v in (0.0, 1.0)}
        v = float(rng.random() < p[k])
        v = v if short[v] <= short[1 - v] else 1 - v  # the others can't make up for it: the nearer end
        error, can = (p[k] - v) * x[k], float((room[v] * x[rest]).sum())
        if error and can > 0:
            p[rest] = np.clip(p[rest] + np.sign(error) * min(1.0, abs(error) / can) * room[v], 0, 1)
        p[k] = v
    p = np.round(p)
    error = float((prob * x).sum() - (p * x).sum())
    p, error = _turned(p, x, open_, error)
    sizes = np.sort(x[open_][x[open_] > 0])
    if len(sizes) and abs(error) > sizes[0]:
        # one is turned the other way, and the others make up for it: of some small ones the best
        start, best = p, (abs(error), p)
        for k in open_[np.argsort(x[open_], kind="stable")]:
            gain = x[k] if start[k] == 0 else -x[k]
            if gain * error > 0:
                q = start.copy()
                q[k] = 1 - q[k]
                q, left = _turned(q, x, open_[open_ != k], error - gain)
                best = min(best, (abs(left), q), key=lambda b: b[0])
                if best[0] <= sizes[0]:
                    break
        p = best[1]
    return p


def _turned(p: np.ndarray, x: np.ndarray, at: np.ndarray, error: float) -> tuple[np.ndarray, float]:
    """Decisions turned, large ones first, wherever that brings the words nearer; and what is still lacking."""
    p = p.copy()
    for k in at[np.argsort(-x[at], kind="stable")]:
        gain = x[k] if p[k] == 0 else -x[k]
        if abs(error - gain) < abs(error):
            p[k], error = 1 - p[k], error - gain
    return p, error


KEY = ["doc_id", "source", "text_hash"]


def class_decisions(docs: DataFrame, **params) -> DataFrame:
    """One row per distinct (doc_id, source, text), as its hash: size, n_rows of them, source_size, target, and the copies of all of them."""
    p = DEFAULTS | params
    sizes = materialize(docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("text_hash")), "sizes")
    units = sizes.groupBy(*KEY).agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n_rows"))
    sources = sizes.groupBy("source").agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    units = units.withColumn("no_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    spark, on = docs.sparkSession, ["source", "no_source"]
    got = sources.limit(p["max_sources"] + 1).collect()
    if len(got) <= p["max_sources"]:
        goal = targets({r["source"]: r["size"] for r in got}, p)
        plan = spark.createDataFrame(
            [(r["source"] or "", r["source"] is None, int(r["size"]), float(goal[r["source"]]), max(1, -(-r["n"] // p["block_rows"]))) for r in got], PLAN)
        most = max([r["n"] for r in got], default=0)
        # one row per source: the sources were counted above
        told = units.join(F.broadcast(plan), on)
    else:
        plan = _by_table(sources, p).withColumn("source", F.coalesce("source", F.lit("")))
        plan = materialize(plan, "targets")
        r = plan.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
        most = r["most"]
        # less than max_sources sources can have more than this part of all rows
        large = plan.where(F.col("n") * F.lit(p["max_sources"]) > r["all"]).drop("n")
        told = units.join(F.broadcast(large), on).unionByName(
            units.join(F.broadcast(large.select(*on)), on, "left_anti").join(plan.drop("n"), on))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # the copies of all equal rows together
    told = told.withColumn("rate", rate * F.col("n_rows")).withColumn("base", F.floor("rate")).withColumn(
        "prob", F.col("rate") - F.col("base")).withColumn("unit", F.xxhash64(*KEY, "no_source"))
    cell = F.struct("source", "no_source", F.pmod(F.xxhash64("unit", F.lit(p["seed"])), F.col("blocks")).alias("block"))
    rows = told.withColumn("cell", cell)
    fields = "unit long, doc_id long, source string, text_hash long, no_source boolean, size long, n_rows long, source_size long, target double, base long, prob double"
    names = [f.split()[0] for f in fields.split(", ")]

    def flown(last: bool):
        def fly(t: pa.Table) -> pa.Table:
            t = t.select(names)
            ids = t["unit"].to_numpy()
            key = mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(p["seed"] * 7919))
            order = np.lexsort((ids, key))
            prob, size = t["prob"].to_numpy()[order], t["size"].to_numpy()[order]
            out = np.empty(len(ids))
            out[order] = (land if last else flight)(prob, size, np.random.default_rng(int(key[order[0]])), p["hold"])
            return t.set_column(names.index("prob"), "prob", pa.array(out))

        return fly

    first = materialize(rows.select("cell", *names).groupBy("cell").applyInArrow(flown(False), fields), "flown")
    first = first.withColumn("undecided", (F.col("prob") > 0) & (F.col("prob") < 1))
    # undecided: at most hold + 2 rows of a block; they are dealt to blocks again until a source's are one block
    open_ = first.where("undecided").drop("undecided")
    decided = [first.where(~F.col("undecided")).drop("undecided")]
    while (most := -(-most // p["block_rows"]) * (p["hold"] + 2)) > p["block_rows"]:
        groups = -(-most // p["block_rows"])
        again = open_.withColumn("cell", F.struct("source", "no_source", F.pmod(F.xxhash64("unit", F.lit(most)), F.lit(groups)).alias("block")))
        flown_again = materialize(again.select("cell", *names).groupBy("cell").applyInArrow(flown(False), fields), "mixing")
        inside = (F.col("prob") > 0) & (F.col("prob") < 1)
        decided.append(flown_again.where(~inside))
        open_ = flown_again.where(inside)
    landed = open_.withColumn("cell", F.struct("source", "no_source")).select("cell", *names).groupBy("cell").applyInArrow(flown(True), fields)
    return functools.reduce(DataFrame.unionByName, [*decided, landed]).select(
        "doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "text_hash", "size", "n_rows", "source_size", "target",
        (F.col("base") + F.round("prob").cast("long")).alias("copies"))


def _times(df: DataFrame, n: str, step: int = 1 << 16) -> DataFrame:
    """Each row ``n`` times, however often that is: in steps of bounded arrays."""
    steps = df.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / step))))
    here = F.least(F.lit(step).cast("long"), F.col(n) - F.col("_step") * step)
    return steps.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), here))).drop("_step", "_each")


def mix_decisions(docs: DataFrame, **params) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (0, 1 or 2)."""
    told = class_decisions(docs, **params)
    least, more = F.floor(F.col("copies") / F.col("n_rows")), F.col("copies") % F.col("n_rows")
    some = F.array(F.struct((F.col("n_rows") - more).alias("n"), least.alias("of_each")), F.struct(more.alias("n"), (least + 1).alias("of_each")))
    shares = told.select("doc_id", "source", "size", "source_size", "target", F.inline(F.filter(some, lambda x: x["n"] > 0)))
    return _times(shares, "n").select("doc_id", "source", "size", "source_size", "target", F.col("of_each").cast("int").alias("copies"))


def mix(docs: DataFrame, **params) -> DataFrame:
    """The mixed documents: each row of ``docs`` as many times as it is taken."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.xxhash64("text").alias("_h"))
    told = materialize(class_decisions(docs, **params).where("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash"), F.col("n_rows").alias("_rows"), F.col("copies").alias("_copies")), "taken")

    def joined(told: DataFrame) -> DataFrame:
        on = F.col("_d").eqNullSafe(F.col("_id")) & F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_h") == F.col("_hash"))
        return packed.join(told, on).select("row", "_id", "_source", "_hash", "_rows", "_copies")

    even = joined(told.where("_copies % _rows = 0")).withColumn("_n", F.floor(F.col("_copies") / F.col("_rows")))
    once = lambda df: df.where("_n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("row.*")
    if not told.where("_copies % _rows <> 0").limit(1).count():
        return once(even)
    # equal rows of which only some get one more are numbered
    odd = with_row_ids(joined(told.where("_copies % _rows <> 0")), "_row")
    odd = running(odd, ["_id", "_source", "_hash"], ["_row"], {"_place": ("sum", F.lit(1).cast("long"))}, keep=["row", "_rows", "_copies"])
    odd = odd.withColumn("_n", F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_place") <= F.col("_copies") % F.col("_rows")).cast("long"))
    return once(even.select("row", "_n").unionByName(odd.select("row", "_n")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_decisions(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op3_mixing": op3_mixing}
