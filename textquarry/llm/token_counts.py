"""Token counts without tokens: count-only Viterbi over a unigram vocabulary.

The text is split where no vocabulary piece can span (before each run of word-start marks that follows another
character), so a document's count is the sum over its segments. A segment's best path comes from one pass of an
Aho-Corasick automaton, which enumerates the vocabulary matches by their end, and a dynamic programme that carries only
the best score and the number of pieces on it, for as many places back as the longest piece has characters, so even a text
without any cut needs no more memory than itself. Short segments repeat, so each worker keeps those it has solved, up to
``KEPT_BYTES``.

Tie rules are the tokenizer's: matches of one end are tried in the order of their start, and only a strictly better score
replaces the best path, so the earliest start (the longest last piece) wins a tie; characters without a piece cost the
lowest score of the vocabulary less 10, count as their UTF-8 bytes where the vocabulary has byte pieces, and otherwise a
run of them counts as one token.

Defined cases
    A null or empty text has 0 tokens and score 0. Repeated rows count each by itself. An empty table gives no rows. Very long texts,
    with or without spaces, are counted whole. Columns n_tokens and viterbi_score of the input are replaced, others stay. The
    text is taken as it is, with a word-start mark before it and in place of each space (U+0020).
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import replacing, table, tidy

MARK = "▁"
UNK_PENALTY = 10.0
KEPT_BYTES = 96 << 20  # of solved segments that a Python worker keeps
LONGEST_KEPT = 64  # characters of a segment that is worth keeping
ENTRY_BYTES = 220  # of a kept segment besides its characters


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(2)
def load_vocabulary(path: str) -> tuple[tuple[tuple[str, float], ...], bool]:
    """((piece, score) ..., whether all byte pieces exist) of a sentencepiece model, control and byte pieces left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = tuple((sp.id_to_piece(i), float(sp.get_score(i))) for i in range(n)
                   if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)))
    return pieces, sum(sp.is_byte(i) for i in range(n)) == 256


class Counter:
    """Counts tokens of texts under one vocabulary."""

    def __init__(self, pieces, byte_fallback: bool = True):
        import ahocorasick

        self.byte_fallback = byte_fallback
        self.auto = ahocorasick.Automaton()
        worst = 0.0
        for piece, score in pieces:
            self.auto.add_word(piece, (len(piece), score))
            worst = min(worst, score)
        self.auto.make_automaton()
        self.unk = worst - UNK_PENALTY
        inner = {c for p, _ in pieces for c in p}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in pieces):
            raise ValueError("a piece has a word-start mark behind another character")
        # characters in no piece always stand alone, so a text can be cut around them too
        self.alone = [c for c in "\n\t\r" if c not in inner]
        cut = "".join(map(re.escape, self.alone))
        self.split = re.compile(f" *[^ {cut}]+|[{cut}]| +" if cut else " *[^ ]+| +").findall
        self.longest = max((len(p) for p, _ in pieces), default=1)
        self.kept: dict[str, tuple[int, float]] = {}
        self.kept_bytes = 0

    def solve(self, segment: str) -> tuple[int, float]:
        """(pieces, score) of the best path; segments have spaces for word-start marks."""
        s = segment.replace(" ", MARK)
        n, ring = len(s), self.longest + 1
        best, count = [0.0] * ring, [0] * ring  # of the places e, e - 1, ... at e % ring
        was_unknown = False
        hits = self.auto.iter(s)
        hit = next(hits, None)
        for e in range(1, n + 1):
            single, unknown = False, False
            top, c = None, 0
            while hit is not None and hit[0] == e - 1:
                length, score = hit[1]
                b = (e - length) % ring
                single |= length == 1
                if top is None or best[b] + score > top:
                    top, c = best[b] + score, count[b] + 1
                hit = next(hits, None)
            if not single:
                b = (e - 1) % ring
                got = best[b] + self.unk
                if top is None or got > top:
                    unknown = True
                    top = got
                    if self.byte_fallback:
                        c = count[b] + len(s[e - 1].encode("utf-8", "surrogatepass"))
                    else:
                        c = count[b] + (0 if was_unknown else 1)
            best[e % ring], count[e % ring], was_unknown = top, c, unknown
        return count[n % ring], best[n % ring]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        if not self.byte_fallback:  # neighbouring unknown characters are one token, so no cut may part them
            return self.solve(" " + text)
        segments = self.split(" " + text)
        try:
            n, score = zip(*map(self.kept.__getitem__, segments))
        except KeyError:
            n, score = zip(*map(self._keep, segments))
        return sum(n), float(sum(score))

    def _keep(self, segment: str) -> tuple[int, float]:
        got = self.kept.get(segment)
        if got is None:
            got = self.solve(segment)
            if len(segment) <= LONGEST_KEPT:
                size = ENTRY_BYTES + 4 * len(segment)
                if self.kept_bytes + size > KEPT_BYTES:
                    self.kept.clear()
                    self.kept_bytes = 0
                self.kept[segment] = got
                self.kept_bytes += size
        return got


@functools.lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(*load_vocabulary(path))


def count_tokens(docs: DataFrame, col: str = "text", model: str | None = None) -> DataFrame:
    """``docs`` with n_tokens and viterbi_score; no shuffle. ``model``: path of a sentencepiece model on every executor."""
    path = model or default_model()
    docs, schema = replacing(docs, n_tokens="long", viterbi_score="double")

    def run(batches):
        c = counter(path)
        for b in batches:
            got = [c.count(t) for t in b.column(b.schema.get_field_index(col)).to_pylist()]
            n = np.array([x[0] for x in got], np.int64)
            s = np.array([x[1] for x in got], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n), pa.array(s)], names=[*b.schema.names, "n_tokens", "viterbi_score"])

    return docs.mapInArrow(tidy(run), schema)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
                                     "n_tokens", "viterbi_score")


QUERIES = {"op8_token_counts": op8_token_counts}
