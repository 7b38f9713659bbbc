"""Prefix trie of conversations: which turns many conversations begin with, and how many tokens sharing them saves.

A node of depth d is a distinct sequence of the first d turns. Its key is its depth and four sums over its turns of 32-bit hashes of
(position, turn): sums of d - 1 and of one more turn give the next, so they are running sums, and 128 bits tell sequences apart.

1. Turns are numbered and their hashes summed along each conversation by a two-level scan (operators.scan), so that a
   conversation that holds most of the rows lies in many tasks.
2. Every task combines its rows into a partial trie: a table of nodes with members, least conv_id and turns' lengths. Partial tries
   merge by key (``merge_tries``): first within ``fan`` groups of conversations, then of those; a node that all conversations share
   comes once from each task. Tries of different days merge the same way.
3. The members that end at a node are sorted by ranges of (node, conv_id), written as pieces of text task by task, and each node's
   pieces stream through SHA-256 in order; no node's list is in memory as a whole. Such a digest is sequential by nature, so a node's
   pieces (of ``piece`` ids) are read by one task.
4. Rollup, bottom-up. The least members cut the trie into chains: a node's parent has the same least conv_id or a smaller one, so the
   nodes of one least conv_id are one path. Chains hang on chains; their totals are summed by pointer doubling (in a number of
   rounds that is the logarithm of their nesting), then each node's subtree is a running sum along its chain from below.

Defined cases
    A null role or text is empty, a null turn comes first; turns of one number are ordered by role, then text, and repeated rows are
    turns of their own. Rows with null conv_id are one conversation, greater than all others, that keeps its own turns and is
    written ``null`` in lists; a node of it alone has conv_id null. c%100 has the sign of c. A turn whose text is very long is hashed
    and then forgotten. An empty table gives no nodes, not even a root. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import materialize, table, tidy
from textquarry.operators.scan import running, with_row_ids

DEFAULTS = {"fan": 16, "piece": 512, "heads": 6, "group": 100}
KEY = ["depth", "k0", "k1", "k2", "k3"]
_LANES = KEY[1:]


def _lanes(position: Column) -> list[Column]:
    """Four 32-bit hashes of a turn (columns a, b) at a position."""
    low = F.lit((1 << 32) - 1).cast("long")
    both = [F.xxhash64(F.lit(k), position.cast("long"), F.col("a"), F.col("b")) for k in range(2)]
    return [x for h in both for x in (h.bitwiseAND(low), F.shiftrightunsigned(h, 32))]


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, two hashes of (role, text) and the text's code points, stored with a number per row."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return with_row_ids(conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.xxhash64(F.lit(11), role, text).alias("a"), F.xxhash64(F.lit(12), role, text).alias("b"), F.length(text).cast("long").alias("chars")), "_row")


def head_size(conv_id: Column, heads: int) -> Column:
    return F.coalesce(F.crc32(conv_id.cast("string").cast("binary")) % heads, F.lit(0)).cast("long")


def rebuilt(turns: DataFrame, **params) -> tuple[DataFrame, DataFrame]:
    """(turns of the rebuilt conversations: conv_id, depth, a, b, chars, is_end; all conversations: conv_id, length).

    Each begins with the first turns of the conversation at the head of its group, then goes on with its own after as many.
    """
    p = DEFAULTS | params
    sizes = materialize(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    h = head_size(F.col("conv_id"), p["heads"])
    first = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % p["group"]).join(first, "base", "left").select(
        "conv_id", "base", "n", h.alias("h"), F.least(h, F.coalesce("base_n", F.lit(0))).alias("given"))
    convs = materialize(convs, "conversations")
    # the size of the head comes before the turns of each conversation, and goes along with them
    told = turns.withColumn("_kind", F.lit(1)).unionByName(convs.select("conv_id", "given", "n", F.lit(0).alias("_kind")), allowMissingColumns=True)
    placed = running(told, ["conv_id"], ["_kind", "turn", "role", "text", "_row"],
                     {"place": ("sum", F.col("_kind").cast("long")), "_given": ("last", F.col("given")), "_n": ("last", F.col("n"))},
                     keep=["conv_id", "_kind", "a", "b", "chars"]).where(F.col("_kind") == 1)
    placed = materialize(placed, "placed")
    own = placed.where(F.col("place") > h).select(
        "conv_id", (F.col("place") - h + F.col("_given")).alias("depth"), "a", "b", "chars", (F.col("place") == F.col("_n")).alias("is_end"))
    head = placed.where((F.col("conv_id") % p["group"] == 0) & (F.col("place") < p["heads"])).select(
        F.col("conv_id").alias("base"), F.col("place").alias("depth"), "a", "b", "chars")
    head = convs.join(head, "base").where(F.col("depth") <= F.col("given")).select(
        "conv_id", "depth", "a", "b", "chars", ((F.col("depth") == F.col("given")) & (F.col("n") <= F.col("h"))).alias("is_end"))
    return own.unionByName(head), convs.select("conv_id", (F.col("given") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length"))


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conversation and prefix of it: the key of its node, that of the parent (p0..p3), conv_id, chars and is_end."""
    own = turns.select("conv_id", "depth", "chars", "is_end", *[x.alias(f"own{k}") for k, x in enumerate(_lanes(F.col("depth")))])
    summed = running(own, ["conv_id"], ["depth"], {k: ("sum", F.col(f"own{i}")) for i, k in enumerate(_LANES)})
    below = summed.select(*KEY, *[(F.col(k) - F.col(f"own{i}")).alias(f"p{i}") for i, k in enumerate(_LANES)], "conv_id", "chars", "is_end")
    zero = F.lit(0).cast("long")
    roots = convs.select(*[zero.alias(k) for k in KEY], *[zero.alias(f"p{i}") for i in range(4)], "conv_id", zero.alias("chars"), (F.col("length") == 0).alias("is_end"))
    return below.unionByName(roots)


def merge_tries(nodes: DataFrame, *within: str) -> DataFrame:
    """The node table of all tries in ``nodes`` together (of those of each group of columns ``within``)."""
    return nodes.groupBy(*KEY, *within).agg(
        *[F.first(f"p{i}").alias(f"p{i}") for i in range(4)], F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("chars").alias("chars"))


def trie_nodes(rows: DataFrame, fan: int = DEFAULTS["fan"]) -> DataFrame:
    """The nodes of ``paths``: key, parent's key, least conv_id, members, code points of the last text."""
    single = rows.select(*KEY, *[f"p{i}" for i in range(4)], "conv_id", F.lit(1).cast("long").alias("n_convs"), "chars", F.pmod(F.xxhash64("conv_id"), F.lit(fan)).alias("_branch"))
    return merge_tries(merge_tries(single, "_branch"))


def end_digests(rows: DataFrame, piece: int = DEFAULTS["piece"]) -> DataFrame:
    """Key and ends_sha256 of the nodes at which conversations end."""
    ends = rows.where("is_end").select(*KEY, "conv_id", F.col("conv_id").isNull().alias("_without_id"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    by = [*KEY, "_without_id", "conv_id"]
    dealt = materialize(ends.repartitionByRange(n, *by).sortWithinPartitions(*by).select(
        *KEY, F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("id"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ends")
    pieces = dealt.groupBy(*KEY, "_part", F.floor(F.col("_at") / piece).alias("_piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "id"))), lambda x: x["id"]), ",").alias("ids"))
    lined = pieces.repartition(n, *KEY).sortWithinPartitions(*KEY, "_part", "_piece").select(*KEY, "ids")

    def digest(batches):
        at, sha = None, None
        for b in batches:
            done = []
            keys = list(zip(*[b.column(k).to_pylist() for k in range(len(KEY))]))
            for key, ids in zip(keys, b.column(len(KEY))):
                if key == at:
                    sha.update(b",")
                else:
                    if at is not None:
                        done.append((*at, sha.hexdigest()))
                    at, sha = key, hashlib.sha256()
                sha.update(ids.as_buffer())
            if done:
                yield batch(done)
        if at is not None:
            yield batch([(*at, sha.hexdigest())])

    def batch(done):
        columns = list(zip(*done))
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:-1]], pa.array(columns[-1], pa.string())], names=[*KEY, "ends_sha256"])

    return lined.mapInArrow(tidy(digest), ", ".join(f"{k} bigint" for k in KEY) + ", ends_sha256 string")


def chain_totals(chains: DataFrame, values: list[str]) -> DataFrame:
    """``chains`` (conv_id, up: the chain it hangs on or null, values) with each value summed over the chain and all that hang on it.

    Pointer doubling: after k rounds a chain has the sum of those within 2^k steps below it, and points 2^k steps up.
    """
    now = materialize(chains.select("conv_id", "up", *values), "chains")
    while now.where(F.col("up").isNotNull()).limit(1).count():
        gained = now.where(F.col("up").isNotNull()).groupBy("up").agg(*[F.sum(v).alias(f"_{v}") for v in values]).withColumnRenamed("up", "_to")
        # a chain on which a third of all hang is split by adaptive execution
        above = now.select(F.col("conv_id").alias("_of"), F.col("up").alias("_next")).where(F.col("_next").isNotNull())
        moved = now.join(above, F.col("up") == F.col("_of"), "left").join(gained, F.col("conv_id") == F.col("_to"), "left")
        now = materialize(moved.select("conv_id", F.col("_next").alias("up"), *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]), "chains")
    return now.drop("up")


def rollup(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and the key of each of ``nodes``."""
    # every child gets its parent's least conv_id along the sorted keys, since a parent may have any number of children
    as_parent = nodes.select(*[F.col(k).alias(f"g{i}") for i, k in enumerate(KEY)], F.lit(0).alias("_kind"), F.struct("conv_id").alias("_told"), F.col("k0").alias("_by"))
    as_child = nodes.select(
        (F.col("depth") - 1).alias("g0"), *[F.col(f"p{i}").alias(f"g{i + 1}") for i in range(4)], F.lit(1).alias("_kind"), F.col("k0").alias("_by"), *KEY, "conv_id", "n_convs", "chars")
    kin = running(as_child.unionByName(as_parent, allowMissingColumns=True), [f"g{i}" for i in range(5)], ["_kind", "_by"], {"_parent": ("last", F.col("_told"))},
                  keep=["_kind", *KEY, "conv_id", "n_convs", "chars"])
    kin = kin.where(F.col("_kind") == 1).select(*KEY, "conv_id", "n_convs", "chars", F.col("_parent.conv_id").alias("parent_conv_id"), F.col("_parent").isNull().alias("is_root"))
    kin = materialize(kin, "kin")
    children = kin.where(~F.col("is_root")).groupBy(F.col("parent_conv_id").alias("_c"), (F.col("depth") - 1).alias("_d")).agg(F.count(F.lit(1)).alias("n_children"))

    def at(df: DataFrame, other: DataFrame) -> DataFrame:
        return df.join(other, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("depth") == F.col("_d")), "left").drop("_c", "_d")

    whole = at(kin, children).withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumn(
        "leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
    whole = materialize(whole, "whole")
    top = F.col("is_root") | ~F.col("conv_id").eqNullSafe(F.col("parent_conv_id"))
    tops = whole.where(top & ~F.col("is_root")).select(F.col("conv_id").alias("_c"), F.col("parent_conv_id").alias("up"), (F.col("depth") - 1).alias("up_depth"))
    tops = materialize(tops, "tops")
    chains = whole.groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    chains = chains.join(tops, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    totals = chain_totals(chains, ["leaf", "saved"])
    hung = tops.join(totals, F.col("_c").eqNullSafe(F.col("conv_id"))).groupBy(F.col("up").alias("_c"), F.col("up_depth").alias("_d")).agg(
        F.sum("leaf").alias("_leaf"), F.sum("saved").alias("_saved"))
    both = at(whole, hung).select(
        "*", (F.col("leaf") + F.coalesce("_leaf", F.lit(0))).alias("leaf_here"), (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved_here"), (-F.col("depth")).alias("_up"))
    return running(both, ["conv_id"], ["_up"], {"n_leaves": ("sum", F.col("leaf_here")), "saved_tokens": ("sum", F.col("saved_here"))},
                   keep=[*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children"])


def prefix_trie(conversations: DataFrame, **params) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    p = DEFAULTS | params
    turns, convs = rebuilt(hashed_turns(conversations), **params)
    rows = materialize(paths(turns, convs), "paths")
    nodes = materialize(trie_nodes(rows, p["fan"]), "nodes")
    tree = rollup(nodes).alias("t").join(end_digests(rows, p["piece"]).alias("e"), KEY, "left")
    return tree.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                       F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}

ORACLE_SQL = {"op12_prefix_trie": r"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS tab FROM range(256) r(i)
), t AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations GROUP BY conv_id
), h AS (
  SELECT conv_id, turns, coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(range(length(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT)),
    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 6, 0) AS h
  FROM t, crc
), b AS (
  SELECT h.conv_id, list_concat(coalesce(t.turns, [])[1: h], h.turns[h + 1:]) AS s FROM h LEFT JOIN t ON t.conv_id = h.conv_id - h.conv_id % 100
), p AS (
  SELECT conv_id, unnest(range(len(s) + 1)) AS depth, s FROM b
), m AS (
  SELECT conv_id, depth, md5(s[1: depth]::VARCHAR || chr(0) || list_transform(s[1: depth], lambda x: len(x.r) || '/' || len(x.x))::VARCHAR) AS k,
    md5(s[1: depth - 1]::VARCHAR || chr(0) || list_transform(s[1: depth - 1], lambda x: len(x.r) || '/' || len(x.x))::VARCHAR) AS up,
    coalesce(len(s[depth].x), 0) AS chars, depth = len(s) AS is_end FROM p
), n AS (
  SELECT depth, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved,
    sha256(coalesce(string_agg(coalesce(conv_id::VARCHAR, 'null'), ',' ORDER BY conv_id NULLS LAST) FILTER (is_end), '')) AS ends_sha256
  FROM m GROUP BY depth, k
), c AS (
  SELECT n.*, a.conv_id AS parent_conv_id, (SELECT count(*) FROM n AS x WHERE x.depth = n.depth + 1 AND x.up = n.k) AS n_children
  FROM n LEFT JOIN n AS a ON a.depth = n.depth - 1 AND a.k = n.up AND n.depth > 0
), u AS (
  SELECT DISTINCT above.k AS top, below.depth, below.k FROM m AS above JOIN m AS below ON above.conv_id IS NOT DISTINCT FROM below.conv_id AND below.depth >= above.depth
), r AS (
  SELECT u.top, sum((c.n_children = 0)::INT) AS n_leaves, sum(c.saved) AS saved_tokens FROM u JOIN c ON u.k = c.k AND u.depth = c.depth GROUP BY u.top
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM c JOIN r ON r.top = c.k
"""}
