import random

from pyspark.sql import functions as F

from textquarry.operators.scan import running, with_row_ids


def brute(rows):
    """rows: (group, order, value or None); running sum, max and last by group."""
    out, state = [], {}
    for g, o, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        s, m, last = state.get(g, (None, None, None))
        if v is not None:
            s, m, last = (s or 0) + v, v if m is None else max(m, v), v
        state[g] = s, m, last
        out.append((g, o, v, s, m, last))
    return sorted(out, key=repr)


def check(spark, rows):
    df = spark.createDataFrame(rows, "g long, o long, v long")
    got = running(df, ["g"], ["o"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "last": ("last", F.col("v"))})
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_groups_of_all_sizes(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, 0, 0, 0, 1, 2, rnd.randint(3, 200)]), k if k else None, rnd.choice([None, rnd.randint(-9, 9)])) for k in range(3000)]
    check(spark, rows)


def test_one_group_lies_in_many_parts(spark):
    rows = [(7, k, k % 5 if k % 3 else None) for k in range(2000)]
    check(spark, rows)
    df = spark.createDataFrame(rows, "g long, o long, v long")
    parts = running(df, ["g"], ["o"], {"n": ("sum", F.lit(1))}).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1


def test_few_rows_and_none(spark):
    check(spark, [(1, 1, None)])
    check(spark, [])
    check(spark, [(None, None, 3), (1, 0, None), (2, 5, 1)])


def test_all_rows_are_one_group_and_columns_are_kept(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("o"), F.lit("x").alias("text"), F.lit(2).alias("v"))
    got = running(df, [], ["o"], {"n": ("sum", F.lit(1))}, keep=["o"])
    assert got.columns == ["o", "n"]
    assert all(r["n"] == r["o"] + 1 for r in got.collect())


def test_row_ids_stay(spark):
    df = with_row_ids(spark.range(100).repartition(7), "k")
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, df.collect())) and df.select("k").distinct().count() == 100
