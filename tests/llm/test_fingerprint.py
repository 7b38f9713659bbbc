import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from textquarry.llm.common import string_buffers
from textquarry.llm.fingerprint import DEFAULTS, codes, edited_likeness, fingerprint, likeness, op6_fingerprint, text_shingles


def brute_edits(rows):
    rows = sorted(rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out[i] = (len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest())
    return out


def shingles(t):
    w = re.findall(r"[A-Za-z0-9\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def pairs(seed=1):
    rnd = random.Random(seed)
    for n in (1, 3, 6, 20, 80, 400, 3000):
        for share in (0.0, 0.02, 0.1, 0.5, 1.0):
            a = [rnd.choice("abcdefghij") * rnd.randint(1, 9) + str(rnd.randint(0, 99)) for _ in range(n)]
            b = [w if rnd.random() >= share else f"new{rnd.randint(0, 9999)}" for w in a]
            yield " ".join(a), " ".join(b)


def estimate(a, b, p=DEFAULTS):
    (ca, sa), (cb, sb) = (codes(*string_buffers(pa.array([t], pa.large_string())), p) for t in (a, b))
    return likeness(ca, sa, cb, sb, p["bits"])[0]


def test_estimates_are_near_the_exact_similarity():
    errors = []
    for a, b in pairs():
        x, y = shingles(a), shingles(b)
        errors.append(estimate(a, b) - len(x & y) / len(x | y))
        assert abs(errors[-1]) < 3.5 * (0.25 / min(len(x | y), DEFAULTS["bins"])) ** 0.5 + 0.03
    assert abs(np.mean(errors)) < 0.03


def test_bias_of_chance_equalities_is_taken_out():
    rnd = random.Random(2)
    text = lambda: " ".join(f"q{rnd.randint(0, 10**9)}" for _ in range(500))
    one_bit = DEFAULTS | {"bits": 1}
    got = []
    for _ in range(30):
        t, u = text(), text()
        (ca, sa), (cb, sb) = (codes(*string_buffers(pa.array([x], pa.large_string())), one_bit) for x in (t, u))
        got.append(likeness(ca, sa, cb, sb, 1)[0])
    assert np.mean(got) < 0.04


def test_shingles_in_batches_are_those_of_each_text():
    texts = ["One two, three four five six", "", "a", "ünï code words are here too", "x y", "One two three four five six"]
    h, o = text_shingles(*string_buffers(pa.array(texts, pa.large_string())))
    assert [len(set(h[o[k]: o[k + 1]].tolist())) for k in range(6)] == [len(shingles(t)) for t in texts]
    assert h[o[0]: o[1]].tolist() == h[o[5]: o[6]].tolist()


def check(df, rows, **params):
    got = {r["doc_id"]: r for r in edited_likeness(df, **params).collect()}
    assert {i: (r["n_chars"], r["edited_sha256"]) for i, r in got.items()} == brute_edits(rows)
    ordered = sorted(rows)
    for k, (i, t) in enumerate(ordered):
        nxt = ordered[(k + 1) % len(ordered)][1] or ""
        assert got[i]["near_next"] == pytest.approx(estimate(t or "", nxt), abs=1e-12)
        half = len(t or "") // 2
        assert got[i]["near_edited"] == pytest.approx(estimate(t or "", (t or "")[: len(t or "") - half] + nxt[:half]), abs=1e-12)
    names = {}
    for i, t in rows:
        names.setdefault(t or "", set()).add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in names.values())


def test_contract_on_small_ranges(docs_of):
    rnd = random.Random(4)
    rows = [(i * 5, " ".join(rnd.choice(["ä", "b", "cc", "🙂d", "e"]) * rnd.randint(1, 3) for _ in range(rnd.randint(0, 60)))) for i in range(90)]
    rows += [(1, None), (2, ""), (3, "odd"), (1001, rows[4][1]), (1002, rows[4][1]), (-7, "negative id first")]
    check(docs_of(rows), rows, part_bytes=900, block_bytes=700)
    check(docs_of(rows), rows)


def test_one_document_and_none(docs_of, empty_docs):
    check(docs_of([(5, "alone in the table")]), [(5, "alone in the table")])
    assert edited_likeness(empty_docs).collect() == []


def test_column_is_added_and_replaces_a_clashing_one(docs_of):
    got = fingerprint(docs_of([(1, "same text"), (2, "same text"), (3, None), (4, "word " * 300_000)])).collect()
    by = {r["doc_id"]: r["fingerprint"] for r in got}
    assert by[1] == by[2] and by[3] == "" and len(by[4]) == DEFAULTS["bins"] * DEFAULTS["bits"] // 4


def test_query_on_tables(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = op6_fingerprint(spark, small).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == brute_edits(rows)


def test_patterned_words_differ():
    """Words of a Thue-Morse pattern and their complements, alone and inside the same text."""
    for n in (256, 1024, 4096):
        one = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
        two = one.translate({97: 98, 98: 97})
        assert estimate(one, one) == 1.0 and estimate(one, two) < 0.2
        assert estimate(f"x y z {one}", f"x y z {two}") < 0.2


def test_many_texts_without_words_need_no_cells():
    """Empty and one-letter texts never fill a block of bytes: no cells for the first, few rows at a time for the others."""
    import tracemalloc

    n = 100_000
    tracemalloc.start()
    code, some = codes(*string_buffers(pa.array([""] * n, pa.large_string())), DEFAULTS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert code.shape == (n, DEFAULTS["bins"]) and not some.any() and peak < 1.5 * n * DEFAULTS["bins"]


def test_rows_with_one_id_and_without(docs_of):
    rows = [(None, "null one"), (3, "b text"), (3, "a text"), (9, ""), (10, "the last of them")]
    got = sorted(map(tuple, edited_likeness(docs_of(rows)).select("doc_id", "n_chars", "edited_sha256").collect()), key=repr)
    order = [(None, "null one"), (3, "a text"), (3, "b text"), (9, ""), (10, "the last of them")]
    want = []
    for k, (i, t) in enumerate(order):
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + order[(k + 1) % 5][1][:half]).encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_texts_of_few_words_take_the_same_values(monkeypatch):
    """Looked up by rank or probed for: the same codes, and much less time."""
    import time

    import numpy as np

    from textquarry.llm import fingerprint as fp

    rnd = random.Random(9)
    texts = [" ".join(rnd.choice("abcdefghij") + str(rnd.randint(0, 9)) for _ in range(n)) for n in [1, 2, 3, 5, 6, 7, 12, 30, 69, 70, 200, 900] * 3 + [0]]
    buf, off = string_buffers(pa.array(texts))
    quick = fp.codes(buf, off, fp.DEFAULTS)
    monkeypatch.setattr(fp, "FEW_BINS", 0)
    slow = fp.codes(buf, off, fp.DEFAULTS)
    assert (quick[0] == slow[0]).all() and (quick[1] == slow[1]).all()
    monkeypatch.setattr(fp, "FEW_BINS", 64)
    buf, off = string_buffers(pa.array([f"two w{k}" for k in range(2048)]))
    start = time.process_time()
    fp.codes(buf, off, fp.DEFAULTS)
    assert time.process_time() - start < 1.5
