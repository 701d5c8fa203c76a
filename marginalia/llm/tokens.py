"""Token ids of whole texts by a public vocabulary, piece by piece.

The vocabulary's pre-tokeniser never joins characters across ASCII white space, so the ids of a text
are those of its words (``[^\\x20\\x09-\\x0D]+``). A word of ASCII and Latin-1 letters, digits and marks
(no apostrophe) splits further, into runs of letters, single digits and runs of marks, as the
pre-tokeniser does; such pieces go lower-cased to the model itself. Any other word goes through the
whole tokenizer. Each piece of a batch is encoded once; a worker keeps the ids of pieces it has met,
up to a bound.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import raw
from .words import split

#: Pieces that a worker remembers at most.
KEEP = 250_000

_OTHER, _LETTER, _DIGIT, _MARK, _ODD = 0, 1, 2, 3, 4
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[39] = _ODD
_CLASS[[9, 10, 11, 12, 13, 32]] = _OTHER
_LEAD = 0xC3
_PLAIN = re.compile(rb"(?:[!-&(-~]|\xc3[\xa0-\xb6\xb8-\xbf])+")


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """What byte-level vocabularies write for each byte: itself where it prints, else 256 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def default_vocabulary() -> str:
    """Where the public word-level BPE vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of texts by a tokenizers file with lower case, byte letters and word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[bytes, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.known.clear()
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.where = np.zeros((1 << 18, 2), np.int32)

    def _learn(self, some: list[bytes]) -> None:
        """Encode pieces that aren't known."""
        said, tokenize, encode = byte_letters(), self.model.tokenize, self.tokenizer.encode
        found: list[int] = []
        counts = np.zeros(len(some), np.int64)
        for k, piece in enumerate(some):
            before = len(found)
            if piece.isalpha():
                found += [t.id for t in tokenize(piece.decode("ascii"))]
            elif _PLAIN.fullmatch(piece) and b"<|" not in piece:
                found += [t.id for t in tokenize("".join([said[b] for b in piece]))]
            else:
                found += encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids
            counts[k] = len(found) - before
        ids, n = np.array(found, np.uint32), len(self.known)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(some) > len(self.where):
            self.where = np.concatenate([self.where, np.zeros_like(self.where)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.where[n : n + len(some), 0], self.where[n : n + len(some), 1] = self.used + np.cumsum(counts) - counts, counts
        self.known.update(zip(some, range(n, n + len(some)), strict=True))
        self.used += len(ids)

    @staticmethod
    def _pieces(body: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Pieces of all texts as a binary array, and the first piece of each text."""
        words = split(body, offsets)
        kind = _CLASS[body]
        lead = body == _LEAD
        after_lead = np.zeros(len(body), bool)
        after_lead[1:] = lead[:-1]
        second = after_lead & (body >= 0x80) & (body <= 0xBF) & (body != 0x97) & (body != 0xB7)
        kind[second] = _LETTER
        kind[:-1][second[1:]] = _LETTER
        lower = body.copy()
        lower[(body >= 65) & (body <= 90) | second & (body < 0x9F)] += 32
        kind[:-1][(body[:-1] == 60) & (body[1:] == 124)] = _ODD  # <|, as in the names of special tokens
        odd = np.concatenate([[0], np.cumsum(kind == _ODD, dtype=np.int64)])
        odd_word = np.flatnonzero(odd[words.end] > odd[words.start])
        for w in odd_word.tolist():  # words of other letters stay whole and unchanged
            a, b = words.start[w], words.end[w]
            kind[a:b] = _ODD
            lower[a:b] = body[a:b]
        begins = np.zeros(len(body) + 1, bool)
        begins[words.start] = True
        inside = kind != _OTHER
        fresh = begins[:-1]
        fresh[1:] |= inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        starts = np.flatnonzero(fresh)
        place = np.cumsum(inside, dtype=np.int32)
        bounds = np.concatenate([place[starts] - 1, place[-1:]]).astype(np.int64)
        array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(lower[inside])])
        return array, np.searchsorted(starts, offsets)

    def encode(self, column: pa.Array, close: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each text's end among them; ``close`` follows each text."""
        body, offsets = raw(column)
        ids, ends = np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        array, first = self._pieces(body, offsets) if len(body) else ([], None)
        if len(array):
            coded = pc.dictionary_encode(array)
            distinct, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            if len(self.known) + len(distinct) > KEEP:
                self._reset()
            self._learn([w for w in distinct if w not in self.known])
            at = np.fromiter(map(self.known.__getitem__, distinct), np.int32, len(distinct))[index]
            begin, count = self.where[at].T
            total = np.zeros(len(at) + 1, np.int64)
            np.cumsum(count, out=total[1:])
            if not count.all():
                begin, count = begin[count > 0], count[count > 0]
            runs = np.zeros(len(count) + 1, np.int64)
            np.cumsum(count, out=runs[1:])
            step = np.ones(total[-1], np.int32)  # from one id's place to the next's
            step[runs[:-1]] = begin
            step[runs[1:-1]] -= begin[:-1] + count[:-1] - 1
            ids = self.ids[np.cumsum(step, dtype=np.int32)]
            ends = total[first[1:]]
        if close is not None:
            ids = np.insert(ids, ends, np.uint32(close))
            ends = ends + np.arange(1, len(ends) + 1)
        return ids, ends


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker and file."""
    return WordTokenizer(path)
