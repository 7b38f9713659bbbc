import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textquarry.llm.prefix_trie import KEY, ORACLE_SQL, merge_tries, op12_prefix_trie, prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs[c].append((r or "", x or ""))
    size = {c: 0 if c is None else zlib.crc32(str(c).encode()) % 6 for c in convs}
    base = {c: None if c is None else abs(c) // 100 * 100 * (-1 if c < 0 else 1) for c in convs}
    built = {c: ([] if c is None else convs.get(base[c], [])[: size[c]]) + ts[size[c]:] for c, ts in convs.items()}
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    order = lambda c: (c is None, c or 0)
    least = {k: min(m, key=order) for k, m in members.items()}
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) if children[k] else 1
        saved[k] = sum(saved[x] for x in children[k]) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
    out = []
    for k, m in members.items():
        ends = ",".join("null" if c is None else str(c) for c in sorted(m, key=order) if len(built[c]) == len(k))
        out.append((least[k], len(k), least[k[:-1]] if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, **params):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.select("*", *[F.lit(f"clash {c}").alias(c) for c in ("depth", "k0", "n", "given", "place", "a", "b", "chars", "is_end", "base", "h")])
    got = prefix_trie(df.repartition(3), **params)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_random_conversations(spark):
    rnd = random.Random(1)
    rows = []
    for c in [*range(0, 40), *range(95, 130), *range(200, 215), *range(301, 306), 1000, -5, -103, -100]:
        for t in range(rnd.choice([0, 1, 2, 3, 5, 8, 9])):
            rows.append((c, rnd.choice([t, t, t, None]), rnd.choice(["user", "assistant", None, ""]), rnd.choice(["a", "bb", "🙂é", "", None, "long " * 20])))
    rows += [(None, k, "user", "a") for k in range(3)]
    check(spark, rows, piece=3, fan=2)


def test_copies_long_conversations_and_nested_chains(spark):
    """A third of all rows in one conversation, a third of the conversations alike, and conversations that hang on each other."""
    rows = [(0, k, "user", f"t{k}") for k in range(300)]
    rows += [(c, k, "user", "same") for c in range(100, 190) for k in range(2)]
    for c in range(400, 440):  # each shares one turn more with the one before than that with its own
        rows += [(c, k, "user", f"d{k}" if k < c - 394 else f"own {c}") for k in range(c - 392)]
    check(spark, rows, piece=8)


def test_repeated_rows_and_tied_turns(spark):
    check(spark, [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, "user", "z"), (1, 1, "assistant", "z")] * 2 + [(2, 0, "ab", "c"), (3, 0, "a", "bc")] * 9)


def test_only_turnless_conversations(spark):
    """Conversations whose own turns all lie in their head, without a conversation to give one."""
    rows = [(c, 0, "user", "x") for c in range(101, 160) if zlib.crc32(str(c).encode()) % 6]
    check(spark, rows)


def test_no_conversations(spark):
    check(spark, [])


def test_partial_tries_merge(spark):
    from textquarry.llm.prefix_trie import hashed_turns, paths, rebuilt, trie_nodes

    df = spark.createDataFrame([(c, k, "user", f"t{c % (k + 2)}") for c in range(60) for k in range(4)], "conv_id long, turn long, role string, text string")
    rows = paths(*rebuilt(hashed_turns(df)))
    whole = sorted(map(tuple, trie_nodes(rows).select(*KEY, "conv_id", "n_convs", "chars").collect()))
    halves = trie_nodes(rows.where("conv_id < 31")).unionByName(trie_nodes(rows.where("conv_id >= 31")))
    assert sorted(map(tuple, merge_tries(halves).select(*KEY, "conv_id", "n_convs", "chars").collect())) == whole


@pytest.mark.parametrize("folder", ["small", "medium"])
def test_as_sql(request, same_as_sql, folder):
    same_as_sql(op12_prefix_trie, ORACLE_SQL["op12_prefix_trie"], request.getfixturevalue(folder))
