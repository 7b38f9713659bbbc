import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textquarry.llm.token_counts import Counter, count_tokens, default_model, load_vocabulary, op8_token_counts

M = "▁"


def every_path(s, pieces, unk, byte_fallback):
    """Best (score, count) over all cuts of s, forward; ties keep the path found first by ascending start."""
    n = len(s)
    best = {0: (0.0, 0, False)}
    for b in range(n):
        if b not in best:
            continue
        score, count, was = best[b]
        single = False
        for e in range(b + 1, n + 1):
            if s[b:e] in pieces:
                single |= e == b + 1
                got = (score + pieces[s[b:e]], count + 1, False)
                if e not in best or got[0] > best[e][0]:
                    best[e] = got
        if not single:
            add = len(s[b].encode()) if byte_fallback else (0 if was else 1)
            got = (score + unk, count + add, True)
            if b + 1 not in best or got[0] > best[b + 1][0]:
                best[b + 1] = got
    return best[n][1], best[n][0]


def vocabulary(seed):
    rnd = random.Random(seed)
    words = {M, M + "a", "a", "b", "ab", "ba", "aab", M + "ab", "c", "é", M + "cab", "abc"}
    return {w: -float(rnd.choice([1, 2, 3, 3, 4])) for w in words}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcé xz\n🙂", max_size=25), st.integers(0, 20), st.booleans())
def test_as_every_path(text, seed, bytes_):
    pieces = vocabulary(seed)
    c = Counter(pieces.items(), bytes_)
    want = every_path((M + text.replace(" ", M)) if text else "", pieces, min(pieces.values()) - 10, bytes_)
    got = c.count(text)
    assert got[0] == want[0] and got[1] == pytest.approx(want[1])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcé xz", min_size=1, max_size=25), st.integers(0, 20))
def test_as_the_unigram_tokenizer(text, seed):
    from tokenizers import Tokenizer, models

    pieces = vocabulary(seed)
    vocab = [("<unk>", 0.0), *sorted(pieces.items())]
    tok = Tokenizer(models.Unigram(vocab, 0, False))
    low = min(0.0, *pieces.values())
    c = Counter(pieces.items(), False)
    assert c.unk == low - 10
    assert c.count(text)[0] == len(tok.encode(M + text.replace(" ", M), add_special_tokens=False).ids)


def test_query_as_every_path(spark, small):
    pieces, bytes_ = load_vocabulary(default_model())
    pieces = dict(pieces)
    unk = min(0.0, *pieces.values()) - 10
    longest = max(map(len, pieces))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op8_token_counts(spark, small).collect()}
    assert set(got) == set(texts)
    for i in sorted(texts)[:25]:
        s = M + texts[i].replace(" ", M) if texts[i] else ""
        best = [(0.0, 0)] + [None] * len(s)
        for e in range(1, len(s) + 1):  # only pieces of the vocabulary's lengths
            for b in range(max(0, e - longest), e):
                if s[b:e] in pieces and (best[e] is None or best[b][0] + pieces[s[b:e]] > best[e][0]):
                    best[e] = (best[b][0] + pieces[s[b:e]], best[b][1] + 1)
            if s[e - 1] not in pieces and (best[e] is None or best[e - 1][0] + unk > best[e][0]):
                best[e] = (best[e - 1][0] + unk, best[e - 1][1] + (len(s[e - 1].encode()) if bytes_ else 1))
        assert (got[i]["n_tokens"], got[i]["n_chars"]) == (best[-1][1], len(texts[i] or ""))
        assert got[i]["viterbi_score"] == pytest.approx(best[-1][0])


def library(path):
    """The tokenizers library's unigram tokenizer with the vocabulary and scores of a sentencepiece file, bytes for characters without a piece."""
    import sentencepiece
    from tokenizers import Tokenizer, models

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    vocab = []
    for i in range(sp.get_piece_size()):
        piece, score = sp.id_to_piece(i), float(sp.get_score(i))
        if sp.is_control(i):
            piece = f"\x00control {i}"  # in no text
        vocab.append((piece, 0.0 if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) else score))
    return Tokenizer(models.Unigram(vocab, 0, True))


def test_query_as_the_library(spark, small):
    tok = library(default_model())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in op8_token_counts(spark, small).collect():
        text = texts[r["doc_id"]]
        assert r["n_tokens"] == (len(tok.encode(M + text.replace(" ", M), add_special_tokens=False).ids) if text else 0)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs", "Cc")), min_size=1, max_size=40))
def test_any_text_as_the_library(text):
    if "lib" not in _made:
        _made["lib"], _made["own"] = library(default_model()), Counter(*load_vocabulary(default_model()))
    assert _made["own"].count(text)[0] == len(_made["lib"].encode(M + text.replace(" ", M), add_special_tokens=False).ids)


_made = {}


def test_odd_rows(docs_of, empty_docs):
    df = docs_of([(1, None), (2, ""), (3, "same words"), (3, "same words"), (None, "x"), (5, "word " * 300_000)])
    got = count_tokens(df)
    rows = got.collect()
    assert len(rows) == 6
    by = {r["text"]: (r["n_tokens"], r["viterbi_score"]) for r in rows}
    assert by[None] == by[""] == (0, 0.0) and by["same words"][0] >= 2
    assert count_tokens(empty_docs).collect() == []


def test_a_long_text_without_cuts_and_a_full_table(monkeypatch):
    from textquarry.llm import token_counts

    pieces = vocabulary(3)
    c = Counter(pieces.items(), True)
    text = "abcab" * 60_000
    one, two = c.count(text), c.count(text[:20])
    want = every_path(M + text[:20], pieces, min(pieces.values()) - 10, True)
    assert two == (want[0], pytest.approx(want[1])) and one[0] > 60_000 and not c.kept.get(" " + text)
    monkeypatch.setattr(token_counts, "KEPT_BYTES", 500)
    small = Counter(pieces.items(), True)
    for text in ("a b c ab", "cab abc a", "b a c ab cab", "a b c ab"):
        assert small.count(text) == c.count(text)
        assert small.kept_bytes <= 500
