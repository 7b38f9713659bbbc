import math
import random
from collections import Counter

import numpy as np

from textquarry.llm.language_id import char_grams, fit, op7_language_id, predict


def grams(text, orders=(1, 2, 3)):
    """The characters of a text as the operator sees them, and its n-grams."""
    cs, blank = [" "], True
    for ch in text:
        low = ch.lower()
        c = (low[0] if low[0].isalpha() else ch) if ch.isalpha() else " "
        if c == " " and blank:
            continue
        cs.append(c)
        blank = c == " "
    if cs[-1] != " ":
        cs.append(" ")
    return Counter("".join(cs[i: i + n]) for n in orders for i in range(len(cs) - max(n, 2) + 1))  # the closing space alone is none


def test_grams_as_written_out():
    texts = ["Hello, World!", "", "a", "...", " ähm  ok", "x1y2", "ÉTÉ", "İstanbul ß"]
    ids, off, letters = char_grams(texts, (1, 2, 3), 1 << 20)
    assert letters.tolist() == [sum(c.isalpha() for c in t) for t in texts]
    for k, t in enumerate(texts):
        if any(c.isalpha() for c in t):
            want = grams(t)
            assert off[k + 1] - off[k] == sum(want.values()), t
            assert len(set(ids[off[k]: off[k + 1]].tolist())) == len(want)


def test_as_exact_naive_bayes(docs_of):
    """Against unhashed counts: the posterior of the same multinomial model."""
    rnd = random.Random(1)
    words = {"xx": ["alpha", "beta", "gamma", "delta"], "yy": ["eins", "zwei", "drei", "vier"], "zz": ["uno", "dos", "tres", "quatro"]}
    rows = [(i, " ".join(rnd.choice(words[g]) for _ in range(rnd.randint(1, 12))), "s", g) for i, g in enumerate(rnd.choices(list(words), k=90))]
    model = fit(docs_of(rows), n_buckets=1 << 20)
    langs = ["xx", "yy", "zz"]
    assert sorted(r["lang"] for r in model.select("lang").collect()) == langs
    totals = {g: Counter() for g in langs}
    for _, t, _, g in rows:
        totals[g].update(grams(t))
    # three languages at once, and one after another
    for many in (64, 1):
        got = {r["doc_id"]: r for r in predict(docs_of(rows), model, n_buckets=1 << 20, block_languages=many).collect()}
        for i, t, _, _ in rows:
            sums = [sum(n * (math.log(totals[g][x] + 0.05) - math.log(sum(totals[g].values()) + 0.05 * (1 << 20))) for x, n in grams(t).items()) for g in langs]
            best = int(np.argmax(sums))
            assert got[i]["lang_pred"] == langs[best]
            assert abs(got[i]["lang_score"] - 1 / sum(math.exp(s - sums[best]) for s in sums)) < 1e-3


def test_more_languages_than_a_block(docs_of):
    rows = [(i, f"word{chr(97 + i // 26)}{chr(97 + i % 26)} " * 5, "s", f"l{i:03d}") for i in range(150)]
    model = fit(docs_of(rows), block_languages=40)
    assert model.count() == 150
    got = predict(docs_of(rows + [(900, "12"), (901, None)]), model, block_languages=40).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {i: g for i, _, _, g in rows} | {900: "und", 901: "und"}
    assert all(0 <= r["lang_score"] <= 1 for r in got)


def test_repeated_rows_and_clashing_columns(docs_of):
    rows = [(1, "alpha beta", "s", "a"), (1, "alpha beta", "s", "a"), (2, "gamma delta", "s", "b"), (None, "alpha", "s", None)]
    df = docs_of(rows)
    once = {r["text"]: r["lang_score"] for r in predict(df, fit(docs_of(rows[1:]))).collect()}
    got = predict(df, fit(df))
    assert got.columns == [c for c in df.columns if c not in ("lang_pred", "lang_score")] + ["lang_pred", "lang_score"]
    twice = {r["text"]: r["lang_score"] for r in got.collect()}
    assert got.count() == 4 and got.first()["part"] == "clash part" and once != twice


def test_held_out_accuracy(spark, medium):
    got = op7_language_id(spark, medium).join(spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert len(got) > 200 and (got.lang_pred == got.lang).mean() > 0.97


def test_no_letters_is_und(docs_of):
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "abc abc"), (5, "abc " * 400_000), (None, "xyz xyz"), (4, "abc abc")]
    learn = docs_of([(1, "abc abc", "s", "l1"), (2, "xyz xyz", "s", "l2"), (3, "lost", "s", None), (4, None, "s", "l1")])
    got = predict(docs_of(rows), fit(learn)).collect()
    assert len(got) == 7
    by = {r["text"]: (r["lang_pred"], r["lang_score"]) for r in got}
    assert by[None] == by[""] == by["12 34 !?"] == ("und", 0.0)
    assert by["abc abc"][0] == "l1" and by["xyz xyz"][0] == "l2" and by["abc " * 400_000][0] == "l1"


def test_nothing_to_learn(docs_of, empty_docs):
    model = fit(empty_docs)
    assert model.count() == 0
    assert [(r["lang_pred"], r["lang_score"]) for r in predict(docs_of([(1, "abc")]), model).collect()] == [("und", 0.0)]
    assert predict(empty_docs, fit(docs_of([(1, "abc", "s", "l1")]))).collect() == []


def test_null_ids_are_held_out(spark, docs_of, tmp_path):
    docs_of([(1, "abc abc", "s", "l1"), (None, "xyz", "s", "l2"), (2, "xyz xyz", "s", "l3")], clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op7_language_id(spark, str(tmp_path)).collect()}
    assert got[None]["held_out"] is True and got[None]["lang_pred"] != "l2" and len(got) == 3
