import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textquarry.llm import rans
from textquarry.llm.common import shared_dir, string_buffers
from textquarry.llm.pretokens import BatchTokenizer
from textquarry.llm.token_output import default_tokenizer, op2_token_output, read_tokens, token_id_output, with_parts, write_tokens

ODD = ["", None, " ", "\n\n\n", "it's we'll they're I'D don't 'til 've'sx", "  two  spaces \t tabs\n new", "<|endoftext|> is a token", "x<|endoftext|>", "a<|endoftext|>b", " <|endoftext|><|endoftext|> ", "<|endoftext|>", "<|endof", "text|> x", "'s<|endoftext|>'s", "<|<|endoftext|>text|>", "\n <|endoftext|>\n", "naïve café 東京  nbsp 　wide",
       "a" * 5000, "1234567890 12 ½ ²", "'s at start", "x 's 't", " line sep", "🙂🙂 emoji👨‍👩‍👧", "tail space ", " \n mixed \r\n end", "don''t '' 'll 'l", "é's è're", "\x00\x01"]


def library():
    """The tokenizer as it comes from its file."""
    return Tokenizer.from_file(default_tokenizer())


def brute(rows):
    tok, out, start = library(), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_as_the_library(docs_of):
    rows = list(enumerate(ODD))
    assert sorted(map(tuple, token_id_output(docs_of(rows)).collect())) == brute(rows)


def test_many_parts_and_blocks(docs_of):
    rnd = random.Random(1)
    rows = [(i * 3 - 50, " ".join(rnd.choice(["one", "two's", "drei", "\n", "vier 4"]) for _ in range(rnd.randint(0, 300)))) for i in range(120)]
    rnd.shuffle(rows)
    got = token_id_output(docs_of(rows), part_bytes=3000, block_tokens=500).collect()
    assert sorted(map(tuple, got)) == brute(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=30), max_size=6))
def test_tokenizer_on_any_text(texts):
    import pyarrow as pa

    tok = tokenizer_once()
    ids, off = tok.encode(*string_buffers(pa.array(texts, pa.string())))
    lib = library_once()
    for t, a, b in zip(texts, off[:-1], off[1:]):
        assert ids[a:b].tolist() == lib.encode(t, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|endo", "ftext|>", "<|", "|>", " ", "a", "'s", "\n", "é", "12"]), max_size=8).map("".join), max_size=8))
def test_added_tokens_anywhere(texts):
    test_tokenizer_on_any_text.hypothesis.inner_test(texts)


def test_several_added_tokens(tmp_path):
    """One that begins like another, and one that is a part of it."""
    import pyarrow as pa
    from tokenizers import AddedToken

    lib = library()
    lib.add_tokens([AddedToken("<|end|>", normalized=False), AddedToken("<|end|>of", normalized=False), AddedToken("end", normalized=False), AddedToken("é é", normalized=False)])
    lib.save(str(tmp_path / "more.json"))
    tok, texts = BatchTokenizer(str(tmp_path / "more.json")), ["a <|end|>of the end", "<|end", "|> end", "é", " é é é", "", "bend<|end|>"]
    ids, off = tok.encode(*string_buffers(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


_once = {}


def tokenizer_once():
    return _once.setdefault("own", BatchTokenizer(default_tokenizer()) if "own" not in _once else None) or _once["own"]


def library_once():
    if "lib" not in _once:
        _once["lib"] = library()
    return _once["lib"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 299), max_size=3000), st.lists(st.integers(0, 50), min_size=300, max_size=300))
def test_coder_round_trip(ids, counts):
    table = rans.Table(rans.normalise(np.array(counts)))
    blob = rans.encode(np.array(ids, np.int64), table)
    assert rans.decode(blob, table).tolist() == ids


def test_parts_decode_alone_and_damage_shows():
    ids = np.random.default_rng(0).zipf(1.4, 400_000) % 5000
    table = rans.Table(rans.normalise(np.bincount(ids, minlength=5000)))
    blob = rans.encode(ids, table)
    lanes = rans.lanes_for(len(ids))
    assert rans.decode(blob, table, part=0).tolist() == ids[: rans.CHECK_ROWS * lanes].tolist()
    p = np.bincount(ids, minlength=5000) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() / 8 * len(ids)
    assert len(blob) < 1.15 * entropy
    with pytest.raises(ValueError):
        rans.decode(blob[:5000] + bytes([blob[5000] ^ 1]) + blob[5001:], table)


def test_one_symbol_only():
    table = rans.Table(rans.normalise(np.array([0, 9])))
    ids = np.ones(1000, np.int64)
    assert rans.decode(rans.encode(ids, table), table).tolist() == ids.tolist()


def test_more_parts_than_ranges(docs_of):
    rnd = random.Random(2)
    rows = [(i * i - 400, "words " * rnd.randint(0, 90)) for i in range(150)]
    got = token_id_output(docs_of(rows), part_bytes=700, max_ranges=4).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_one_part_more_than_many_ranges(docs_of):
    """41 parts of 40 ranges: each range is cut in two, so parts are numbered far beyond 41 and all need the table."""
    rows = [(i, "some words " * 5) for i in range(328)]
    docs = docs_of(rows)
    n_bytes = sum(len(t) for _, t in rows)
    size = -(-n_bytes // 41)
    assert -(-n_bytes // size) == 41
    assert max(r["part"] for r in with_parts(docs.select("doc_id", "text"), 41, 40).select("part").collect()) > 60
    for part_bytes in (150, 170, 190):  # 40 to 50 parts of ids
        assert sorted(map(tuple, token_id_output(docs, part_bytes=part_bytes, max_ranges=40).collect())) == brute(rows)
    got = token_id_output(docs, part_bytes=size, max_ranges=40).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_repeated_and_null_ids(docs_of):
    rows = [(None, "null id"), (5, "b"), (5, "a"), (2, None)]
    got = sorted(token_id_output(docs_of(rows)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 2, 5, 5]
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(4)]


def test_ids_come_back(spark, docs_of):
    path = f"{shared_dir(spark)}/round-trip"
    tok = library()
    write_tokens(docs_of([(1, "one two"), (2, "three")]), path, default_tokenizer(), tok.get_vocab_size())
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in read_tokens(spark, path).collect()}
    assert got == {1: [*tok.encode("one two", add_special_tokens=False).ids, 0], 2: [*tok.encode("three", add_special_tokens=False).ids, 0]}


def test_large_negative_and_null_ids_in_nine_parts_of_four_ranges(docs_of):
    rnd = random.Random(3)
    base = (1 << 53) + 1
    ids = [base + k for k in range(120)] + [-base - k for k in range(40)] + [(1 << 63) - 1, -(1 << 62), None, 0]
    rows = [(i, f"text {i} " * rnd.randint(1, 9)) for i in ids] + [(base, f"text {base} again")]
    rnd.shuffle(rows)
    want = brute([r for r in rows if r[0] != base])
    total = sum(len(t or "") for _, t in rows)
    for part_bytes in (total, total // 9, total // 20):
        got = sorted(map(tuple, token_id_output(docs_of(rows), part_bytes=part_bytes, max_ranges=4).collect()), key=lambda r: r[1])
        assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
        assert {(r[0], r[2], r[3]) for r in want} == {(r[0], r[2], r[3]) for r in got if r[0] != base}
        assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]


def test_patterned_words_and_colliding_hashes(docs_of, monkeypatch):
    """Words of a Thue-Morse pattern, and a table whose hashes say only the length: bytes decide."""
    from textquarry.llm import pretokens

    one = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    two = one.translate({97: 98, 98: 97})
    rows = [(1, one), (2, two), (3, f"{one} {two}"), (4, f"{two} {one} {two}")]
    assert sorted(map(tuple, token_id_output(docs_of(rows)).collect())) == brute(rows)
    monkeypatch.setattr(pretokens, "span_hashes", lambda b, s, e: (e - s).astype(np.uint64))
    tok, lib = BatchTokenizer(default_tokenizer()), library()
    texts = [one, two, "the cat sat on a mat and the dog too", "", "cat dog eat the the"]
    import pyarrow as pa

    for _ in range(2):
        ids, off = tok.encode(*string_buffers(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_full_table_of_pretokens_starts_anew():
    import pyarrow as pa

    tok, lib = BatchTokenizer(default_tokenizer()), library()
    tok.KEPT_BYTES = 1
    for text in ("one two three", "three two one zero", "one"):
        assert tok.encode(*string_buffers(pa.array([text])))[0].tolist() == lib.encode(text, add_special_tokens=False).ids


def test_a_vocabulary_of_millions():
    n = 1_500_000
    table = rans.Table(rans.normalise(np.bincount([0, 5, 5, n - 1], minlength=n)))
    ids = np.array([0, 5, n - 1, 77, 5] * 100)
    assert rans.decode(rans.encode(ids, table), table).tolist() == ids.tolist()


def test_empty_table(empty_docs):
    assert token_id_output(empty_docs).collect() == []


def test_query_on_tables(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(map(tuple, op2_token_output(spark, small).collect())) == brute(rows)


def parts_of(docs, n_parts, max_ranges):
    from pyspark.sql import functions as F

    from textquarry.llm.common import materialize

    stored = materialize(docs.select("doc_id", F.length("text").alias("size")), "sized")
    return [tuple(r) for r in with_parts(stored, n_parts, max_ranges, "size").select("doc_id", "size", "part").collect()]


@pytest.mark.parametrize("max_ranges", [1000, 16])
def test_parts_stay_even(docs_of, max_ranges):
    """A third of null ids, one id that many rows share, outlying ids, and a few long texts."""
    rnd = random.Random(8)
    ids = [None] * 2000 + [77] * 1000 + [rnd.randint(1000, 9000) for _ in range(3000)] + [10 ** 15 + k for k in range(10)] + [-(10 ** 15)]
    docs = docs_of([(i, "x" * (20 if rnd.random() < 0.99 else 400)) for i in ids])
    rows = parts_of(docs, 40, max_ranges)
    assert len(rows) == len(ids)
    load, span = {}, {}
    for i, n, part in rows:
        load[part] = load.get(part, 0) + n
        span.setdefault(part, []).append(-(1 << 62) if i is None else i)
    middle = sorted(load.values())[len(load) // 2]
    assert max(load.values()) <= 3 * max(middle, sum(load.values()) // 40) and len(load) >= 25
    at = [(min(x), max(x)) for _, x in sorted(span.items())]
    assert all(a[1] <= b[0] for a, b in zip(at, at[1:]))


def test_heavy_ids_come_back_whole(docs_of):
    rows = [(None, f"null {k}") for k in range(60)] + [(5, f"five {k}") for k in range(60)] + [(k, f"own {k}") for k in range(6, 66)]
    got = sorted(token_id_output(docs_of(rows), part_bytes=60, max_ranges=30).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 60 + [5] * 60 + list(range(6, 66))
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(len(got))]
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((n, c) for _, _, n, c in brute(rows))
