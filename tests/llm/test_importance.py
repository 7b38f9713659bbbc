import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from textquarry.llm.importance import ORACLE_SQL, bucket_counts, crc32s, gains, op13_importance_resampling, resample, weigh

TEXTS = [None, "", "!!", "one", "One oNE two", "é à1 b", "ÀB aB", "x " * 30, "long" * 5000 + " tail", "the cat sat on the mat " * 6, "a\x00b\nc\td", "日本語のテキスト " * 25, "word" * 12 + " " + "w" * 48 + " " + "w" * 49]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def grams(text, order):
    w = words(text)
    return [" ".join(w[i: i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def bucket(feature, n):
    return zlib.crc32(feature.encode()) % n


def brute(docs, target, order=1, n=10_000):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(bucket(f, n) for f in grams(x, order))
    for x in target:
        t.update(bucket(f, n) for f in grams(x, order))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + n) / ((s[b] + 1) * (all_t + n))))
    rows = []
    for d, x in docs:
        fs = grams(x, order)
        weight = sum(gain(bucket(f, n)) for f in fs)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(able[: 10 * len(able) // 100], 1)}
    return [(*r[:4], rank.get(id(r))) for r in rows]


@pytest.mark.parametrize("order", [1, 3])
def test_as_brute_force(spark, docs_of, order):
    rnd = random.Random(2)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = TEXTS + [" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 60))) for _ in range(300)]
    docs = [(k, x) for k, x in enumerate(texts)] + [(7, "seven again " * 12), (None, "no id " * 15), (None, "no id " * 15)]
    target = spark.createDataFrame([(1, "the cat w1 w2 w3"), (2, None)], "item_id long, text string")
    got = resample(docs_of(docs).repartition(5), target, order=order, block_bytes=2000)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(docs, ["the cat w1 w2 w3"], order), key=repr)


def test_crc32_of_spans():
    rnd = random.Random(4)
    buf = np.frombuffer(bytes(rnd.randrange(256) for _ in range(5000)), np.uint8)
    starts = np.array([rnd.randrange(4000) for _ in range(500)])
    ends = starts + np.array([rnd.choice([0, 1, 2, 5, 47, 48, 49, 300]) for _ in range(500)])
    assert crc32s(buf, starts, ends).tolist() == [zlib.crc32(buf[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert len(crc32s(buf, starts[:0], ends[:0])) == 0


def test_counts_merge_over_many_partitions(spark, docs_of):
    docs = docs_of([(k, f"a b{k % 7}") for k in range(500)]).repartition(60)
    got = bucket_counts(docs, fan_in=4)
    want = np.zeros(10_000, np.int64)
    for k in range(500):
        want[bucket("a", 10_000)] += 1
        want[bucket(f"b{k % 7}", 10_000)] += 1
    assert (got == want).all()


def test_likely_texts_are_drawn(spark, docs_of):
    rnd = random.Random(5)
    docs = [(k, " ".join(rnd.choices([f"in{i}" for i in range(50)] if k % 10 == 0 else [f"out{i}" for i in range(50)], k=40))) for k in range(400)]
    target = spark.createDataFrame([(k, " ".join(f"in{i}" for i in range(50))) for k in range(5)], "item_id long, text string")
    drawn = [r["doc_id"] for r in resample(docs_of(docs), target).where("rank is not null").orderBy("rank").collect()]
    assert len(drawn) == 40 and all(d % 10 == 0 for d in drawn)


def test_other_columns_stay(docs_of):
    got = weigh(docs_of([(1, "a b")]), gains(np.zeros(10_000), np.zeros(10_000)))
    assert got.columns[-3:] == ["n_words", "n_features", "weight"] and "lang" in got.columns and got.first()["n_features"] == 2


def test_empty_tables(spark, empty_docs, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample(empty_docs, none).collect() == []
    rows = [(1, "a " * 20), (2, None)]
    assert sorted(map(tuple, resample(docs_of(rows), none).collect())) == sorted(brute(rows, []))


def test_as_sql(same_as_sql, medium):
    same_as_sql(op13_importance_resampling, ORACLE_SQL["op13_importance_resampling"], medium)
