"""Batch tokenising with a byte-level BPE of the tokenizers library: each distinct pre-token is encoded once per worker.

The pre-tokeniser cuts a text without looking at the vocabulary, and BPE never joins across a cut, so a text's ids are its
pre-tokens' ids in order. ``cut`` finds the cuts of a whole batch in numpy on UTF-8 bytes, by the byte-level pattern
(contractions; letters, numbers or other characters with at most one space before them; white space, less its last
character where something follows). Pre-tokens are looked up by a 64-bit hash, and a hit counts only if its bytes are the same;
the unseen ones go to the library. What is kept is bounded in bytes.

Added tokens (as ``<|endoftext|>``) are ids of their own wherever their text stands, as the library has it: texts are cut at them first,
the longest of those that begin at the same place, and what lies between them is cut as if it were texts of their own.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

from textquarry.llm.common import U64, chunks_of, span_hashes, words8

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
APOSTROPHE = ord("'")


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a + 1 == len(m[0]):
                out[a: b + 1] = cls
            else:  # a run over the surrogates' gap
                out[[ord(c) for c in m[0]]] = cls
    return out


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to; ``buf`` is valid UTF-8."""
    table = _classes()
    ascii_part = np.full(256, OTHER, np.uint8)
    ascii_part[:128] = table[:128]
    cls = ascii_part[buf]
    b = np.concatenate([buf, np.zeros(3, np.uint8)])
    for lo, hi, n, mask in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0xF8, 4, 0x07)):
        at = np.flatnonzero((buf >= lo) & (buf < hi))
        if not len(at):
            continue
        cp = (b[at] & mask).astype(np.int64)
        for k in range(1, n):
            cp = (cp << 6) | (b[at + k] & 0x3F)
        c = table[cp]
        for k in range(n):
            cls[at + k] = c
    return cls


def cut(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of all pre-tokens of the concatenated texts; each ends where the next one starts."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64)
    cls = byte_classes(buf)
    first = np.zeros(n + 1, bool)  # of a text
    first[off] = True
    head = (buf & 0xC0) != 0x80  # first bytes of characters
    space = cls == SPACE
    same = np.zeros(n, bool)
    same[1:] = cls[1:] == cls[:-1]
    same &= ~first[:n]
    after_blank = np.zeros(n, bool)  # behind a U+0020 of the same text
    after_blank[1:] = buf[:-1] == 32
    after_blank &= ~first[:n]
    start = ~same & (space | ~after_blank)
    # the last character of white space starts a pre-token if something follows in the text
    ends_run = np.zeros(n, bool)
    ends_run[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    at = np.flatnonzero(ends_run)
    while len(at):
        whole = head[at]
        start[at[whole]] = True
        at = at[~whole] - 1
    quote = np.flatnonzero(buf == APOSTROPHE)
    if len(quote):
        quote = quote[start[quote]]
        b = np.concatenate([buf, np.zeros(2, np.uint8)])
        end = off[np.searchsorted(off, quote, side="right")]
        x, y = b[quote + 1], b[quote + 2]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8)) & (quote + 2 <= end)
        two = (((y == ord("e")) & ((x == ord("r")) | (x == ord("v")))) | ((x == ord("l")) & (y == ord("l")))) & (quote + 3 <= end)
        for hit, length in ((one, 2), (two & ~one, 3)):
            q = quote[hit]
            start[q + 1] = False
            nxt = q + length
            nxt = nxt[nxt < n]
            # what follows starts anew, unless white space or another text already says where
            start[nxt[cls[nxt] == LETTER]] = True
    return np.flatnonzero(start & head)


class Kept:
    """An open-addressing table from 64-bit hashes to small numbers, looked up for whole arrays."""

    def __init__(self, bits: int = 16):
        self.key, self.value, self.used = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The value of each hash, -1 where it is absent; hashes aren't 0."""
        mask = len(self.key) - 1
        slot = (h & U64(mask)).astype(np.int64)
        k = self.key[slot]
        out = np.where(k == h, self.value[slot], np.int32(-1))
        todo = np.flatnonzero((k != h) & (k != 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & mask
            k = self.key[slot]
            hit = k == h[todo]
            out[todo[hit]] = self.value[slot[hit]]
            go = ~hit & (k != 0)
            todo, slot = todo[go], slot[go]
        return out

    def add(self, h: np.ndarray, v: np.ndarray) -> None:
        """Distinct hashes that are absent."""
        while self.used + len(h) > len(self.key) // 2:
            old_k, old_v = self.key, self.value
            self.__init__(len(old_k).bit_length())
            live = old_k != 0
            self._place(old_k[live], old_v[live])
        self._place(h, v)

    def _place(self, h, v):
        mask = len(self.key) - 1
        slot = (h & U64(mask)).astype(np.int64)
        self.used += len(h)
        while len(h):
            free = self.key[slot] == 0
            f = np.flatnonzero(free)
            _, one = np.unique(slot[f], return_index=True)
            f = f[one]
            self.key[slot[f]], self.value[slot[f]] = h[f], v[f]
            left = np.ones(len(h), bool)
            left[f] = False
            h, v, slot = h[left], v[left], (slot[left] + 1) & mask


class _Pool:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.a, self.n = np.zeros(1 << 14, kind), 0

    def add(self, x: np.ndarray) -> int:
        """The place where ``x`` was put."""
        at = self.n
        if at + len(x) > len(self.a):
            self.a = np.concatenate([self.a, np.zeros(max(len(self.a) // 2, len(x)), self.a.dtype)])
        self.a[at: at + len(x)] = x
        self.n = at + len(x)
        return at


class BatchTokenizer:
    KEPT_BYTES = 64 << 20

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder()
        if self.tok.normalizer is not None or any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("a tokenizer that changes texts, or whose added tokens take in what is around them, is not supported")
        self.added = {t.content.encode(): k for k, t in added.items()}
        self.added_at = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.tok.encode_special_tokens = True  # they are found here
        self.n_ids = self.tok.get_vocab_size()
        self.forget()

    def forget(self):
        self.kept = Kept()
        # of each kept pre-token: its ids, its length in bytes, its bytes as words of 8
        self.begin, self.length, self.pool = _Pool(np.int64), _Pool(np.int64), _Pool(np.uint32)
        self.n_bytes, self.word_at, self.words = _Pool(np.int64), _Pool(np.int64), _Pool(np.uint64)

    def kept_bytes(self) -> int:
        return 12 * len(self.kept.key) + sum(p.a.nbytes for p in (self.begin, self.length, self.pool, self.n_bytes, self.word_at, self.words))

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(ids, number of ids of each, the words' places in that order)."""
        plain = [k for k, w in enumerate(words) if w[0] == " " and w[1:].isalpha()]
        known = set(plain)
        rest = [k for k in range(len(words)) if k not in known]
        got_ids, got_len, order = [], [], []
        for i in range(0, len(plain), 512):  # spaces keep them apart, so many are encoded as one text
            part = plain[i: i + 512]
            e = self.tok.encode("".join([words[k] for k in part]), add_special_tokens=False)
            lens = np.bincount(np.array(e.word_ids, np.int64), minlength=len(part))
            if len(lens) != len(part):
                raise AssertionError("pre-tokens were cut elsewhere than the library cuts them")
            got_ids.append(np.array(e.ids, np.uint32))
            got_len.append(lens)
            order += part
        for i in range(0, len(rest), 512):
            part = rest[i: i + 512]
            for e in self.tok.encode_batch_fast([words[k] for k in part], add_special_tokens=False):
                got_ids.append(np.array(e.ids, np.uint32))
                got_len.append(np.array([len(e.ids)]))
            order += part
        return np.concatenate(got_ids), np.concatenate(got_len), order

    def _learn(self, hashes: np.ndarray | None, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The numbers under which distinct pre-tokens are kept; without hashes they aren't found again."""
        raw = buf.tobytes()
        ids, lens, order = self._library([raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist())])
        start, end = start[order], end[order]
        first = self.pool.add(ids)
        number = self.begin.add(first + np.concatenate([[0], np.cumsum(lens)[:-1]])) + np.arange(len(lens))
        self.length.add(lens)
        at, _, mask, lead = chunks_of(start, end)
        first = self.words.add(words8(buf)[at] & mask)
        self.word_at.add(first + lead)
        self.n_bytes.add(end - start)
        if hashes is not None:
            self.kept.add(hashes[order], number.astype(np.int32))
        out = np.empty(len(order), np.int64)
        out[order] = number
        return out

    def _added_spans(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, id) of the added tokens in concatenated texts, in order; none reaches over two texts."""
        if self.added_at is None:
            return []
        raw = buf.tobytes()
        if len(self.added) < 8 and not any(x in raw for x in self.added):
            return []
        seen = [m.span() for m in self.added_at.finditer(raw)]
        if not seen:
            return []
        # the texts that these touch are searched one by one: one over a seam would hide another
        a, b = np.array(seen).T
        touched = np.unique(np.concatenate([np.searchsorted(off, a, side="right") - 1, np.searchsorted(off, b - 1, side="right") - 1]))
        return [(m.start(), m.end(), self.added[m[0]]) for t in touched.tolist() for m in self.added_at.finditer(raw, int(off[t]), int(off[t + 1]))]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids uint32, offsets per text) of concatenated UTF-8 texts."""
        spans = self._added_spans(buf, off)
        if not spans:
            return self._encode(buf, off)
        begin, end, own = np.array(spans, np.int64).T
        pieces = np.unique(np.concatenate([off, begin, end]))
        ids, at = self._encode(buf, pieces)
        special = np.searchsorted(pieces, begin)
        lens = np.diff(at)
        # an added token's piece is its one id
        first = np.zeros(len(ids) + 1, bool)
        first[at[special]] = True
        inside = np.repeat(np.isin(np.arange(len(lens)), special), lens)
        ids[at[special]] = own
        keep = ~inside | first[:-1]
        lens[special] = 1
        done = np.concatenate([[0], np.cumsum(lens)])
        return ids[keep], done[np.searchsorted(pieces, off)]

    def _encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = cut(buf, off)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        end = np.append(start[1:], len(buf))
        h = span_hashes(buf, start, end)
        h[h == 0] = 1
        if self.kept_bytes() > self.KEPT_BYTES:
            self.forget()
        at = self.kept.find(h).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            _, one = np.unique(h[new], return_index=True)
            pick = new[one]
            self._learn(h[pick], buf, start[pick], end[pick])
            at[new] = self.kept.find(h[new])
        # a hit has the same length and the same bytes
        place, number, mask, _ = chunks_of(start, end)
        n = np.maximum(1, (end - start + 7) >> 3)
        differ = self.n_bytes.a[at] != end - start
        other = np.repeat(differ, n)
        look = np.flatnonzero(~other)
        span = np.repeat(np.arange(len(at)), n)[look]
        look = (words8(buf)[place[look]] & mask[look]) != self.words.a[self.word_at.a[at[span]] + number[look]]
        differ[span[look]] = True
        odd = np.flatnonzero(differ)
        if len(odd):
            at[odd] = self._learn(None, buf, start[odd], end[odd])
        lens = self.length.a[at]
        done = np.concatenate([[0], np.cumsum(lens)])
        ids = self.pool.a[np.arange(done[-1]) + np.repeat(self.begin.a[at] - done[:-1], lens)]
        return ids, done[np.searchsorted(start, off)]


@functools.lru_cache(2)
def tokenizer(path: str) -> BatchTokenizer:
    return BatchTokenizer(path)
