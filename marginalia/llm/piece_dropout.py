"""Operator 8: SentencePiece merge-type encoding with seeded merge-dropout, and lossless decoding.

Units (a run of spaces and what follows up to the next one) go through their agendas together. A state is
a unit's pieces so far with its agenda, the possible merges from the best on. A candidate merge is skipped
for good when a keyed hash of (seed, document, number of the unit in it, unit, place, piece) says so: an
occurrence does the first merge of its state's agenda that its own draws leave, and so comes to the next
state. Every occurrence of a word thus has draws of its own, and the same ones again in a recomputed task,
while the agendas are made once for all occurrences that come to a state. Long units have a heap each.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import over_batches, raw, texts
from .words import mix

DROPOUT, SEED = 0.1, 42
#: Occurrences of units encoded at once, and entries of agendas that are remembered for the next ones.
BLOCK, REMEMBERED = 250_000, 3_000_000
#: A unit of more symbols has a heap of its own.
LONG = 64
SPACE = "▁"


def salts(units: list[bytes]) -> np.ndarray:
    """What tells units apart in their draws."""
    return np.fromiter((zlib.crc32(u) for u in units), np.uint64, len(units)) << np.uint64(20)


def limit_of(dropout: float) -> np.uint64:
    """Hashes below this skip a merge."""
    return np.uint64(min(int(dropout * 2**64), 2**64 - 1))


def default_model() -> str:
    """Where the public SentencePiece model lies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one after the other."""
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


class PieceModel:
    """Pieces of a SentencePiece BPE model with byte fallback, and its merges as sorted tables."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.bytes = np.zeros(256, np.int64)
        self.of_byte: dict[int, int] = {}
        for i, x in enumerate(self.pieces):
            if sp.is_byte(i):
                self.bytes[int(x[3:5], 16)], self.of_byte[i] = i, int(x[3:5], 16)
        normal = {x: i for i, x in enumerate(self.pieces) if not special[i] and i not in self.of_byte}
        if any("\n" in x and len(x) > 1 or SPACE in x.lstrip(SPACE) for x in normal):
            raise ValueError("a piece that crosses units: a space after another character, or a line feed among others")
        self.letters = {x: i for x, i in normal.items() if len(x) == 1}
        self.size = n
        # A merge joins neighbours whose text is a piece; the higher score goes first, then the left one.
        pairs = [(normal[x[:k]] * n + normal[x[k:]], i) for x, i in normal.items() if len(x) > 1 for k in range(1, len(x)) if x[:k] in normal and x[k:] in normal]
        pairs.sort()
        self.pair = np.array([a for a, _ in pairs], np.int64)
        self.merged = np.array([b for _, b in pairs], np.int64)
        score = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.empty(n, np.int64)
        self.rank[np.argsort(-score, kind="stable")] = np.arange(n)
        # A pair's place in the table by its slot; of pairs that share a slot, all but the last are in no slot.
        self.slots = np.full(1 << 21, -1, np.int32)
        slot = self._slot(self.pair)
        self.slots[slot] = np.arange(len(self.pair))
        self.crowded = np.zeros(1 << 21, bool)
        self.crowded[slot[self.slots[slot] != np.arange(len(self.pair))]] = True
        self.letter = np.full(0x110000, -1, np.int32)
        for x, i in self.letters.items():
            self.letter[ord(x)] = i
        self.letter[32], self.letter[ord(SPACE)] = self.letters.get(SPACE, -1), -1  # a written U+2581 is bytes
        self._merges: dict[int, int] | None = None
        self.decoded = [x.replace(SPACE, " ").encode() for x in self.pieces]
        for i, b in self.of_byte.items():
            self.decoded[i] = bytes([b])

    @staticmethod
    def _slot(pair: np.ndarray) -> np.ndarray:
        return (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)

    def keys(self, salt: np.ndarray, variant: np.ndarray, seed: int) -> np.ndarray:
        """The keys of units' draws."""
        return mix(mix(salt ^ variant.astype(np.uint64)) ^ np.uint64(seed))

    def symbols(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units' characters, one unit after the other, and how many each has; what isn't a letter of the model is bytes."""
        body = b"".join(units)
        char = np.frombuffer(body.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
        width = 1 + (char >= 0x80) + (char >= 0x800).astype(np.int64) + (char >= 0x10000)
        width[(char >= 0xDC80) & (char <= 0xDCFF)] = 1  # a byte that isn't UTF-8
        begin = np.cumsum(width) - width
        known = self.letter[char]
        other = known < 0
        count = np.where(other, width, 1)
        ids = np.repeat(known, count).astype(np.int64)
        if other.any():
            ids[ids < 0] = self.bytes[np.frombuffer(body, np.uint8)[_ranges(begin[other], width[other])]]
        ends = np.cumsum(np.fromiter((len(u) for u in units), np.int64, len(units)))
        return ids, np.diff(np.concatenate([[0], np.cumsum(count)])[np.searchsorted(begin, ends)], prepend=0)

    def found(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``pair`` (left * size + right) can merge, and into what."""
        slot = self._slot(pair)
        at = self.slots[slot]
        some = np.flatnonzero(at >= 0)
        at, slot, pair = at[some], slot[some], pair[some]
        hit = self.pair[at] == pair
        again = np.flatnonzero(~hit & self.crowded[slot])
        if len(again):
            at[again] = np.minimum(np.searchsorted(self.pair, pair[again]), len(self.pair) - 1)
            hit[again] = self.pair[at[again]] == pair[again]
        return some[hit], self.merged[at[hit]]

    def merges(self) -> dict[int, int]:
        """Pairs and what they merge into, for long units."""
        if self._merges is None:
            self._merges = dict(zip(self.pair.tolist(), self.merged.tolist(), strict=True))
        return self._merges

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: spaces for U+2581, bytes joined, the prefix dropped."""
        text = b"".join([self.decoded[i] for i in ids]).decode("utf-8", "surrogateescape")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One model for each worker and file."""
    return PieceModel(path)


class _Column:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.data, self.n = np.empty(1 << 12, kind), 0

    def add(self, more: np.ndarray) -> None:
        need = self.n + len(more)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.empty(max(need, 2 * len(self.data)) - self.n, self.data.dtype)])
        self.data[self.n : need] = more
        self.n = need


class Agendas:
    """The states that units have come to, each with its symbols and its merges from the best on."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        """Forget all states."""
        self.first: dict[bytes, int] = {}
        self.symbol, self.place = _Column(np.int32), _Column(np.int32)
        self.code, self.left, self.onward = _Column(np.int64), _Column(np.int32), _Column(np.int32)
        self.symbol_at, self.symbols, self.merge_at, self.merges = (_Column(np.int64) for _ in range(4))

    def _add(self, ids: np.ndarray, place: np.ndarray, size: np.ndarray) -> int:
        """States of ``size`` symbols each; returns the first one's number."""
        n, model = self.symbol_at.n, self.model
        begin = np.cumsum(size) - size
        state = np.repeat(np.arange(len(size)), size)
        pairs = np.flatnonzero(state[1:] == state[:-1])
        hit, new = model.found(ids[pairs] * model.size + ids[pairs + 1])
        at = pairs[hit]
        order = np.argsort(state[at] * model.size + model.rank[new], kind="stable")  # the best piece first, then the left one
        at, new = at[order], new[order]
        count = np.bincount(state[at], minlength=len(size))
        self.symbol_at.add(self.symbol.n + begin)
        self.symbols.add(size)
        self.merge_at.add(self.code.n + np.cumsum(count) - count)
        self.merges.add(count)
        self.symbol.add(ids)
        self.place.add(place)
        self.code.add(place[at] * model.size + new)
        self.left.add(at - begin[state[at]])
        self.onward.add(np.full(len(at), -1))
        return n

    def start(self, units: list[bytes], long: np.ndarray) -> np.ndarray:
        """The first state of each unit; -1 and a mark in ``long`` for one of more than LONG symbols."""
        out = np.array([self.first.get(u, -1) for u in units], np.int64)
        new = np.flatnonzero(out < 0)
        if len(new):
            ids, size = self.model.symbols([units[i] for i in new.tolist()])
            short = size <= LONG
            long[new[~short]] = True
            at = (np.cumsum(size) - size)[short]
            new, size = new[short], size[short]
            n = self._add(ids[_ranges(at, size)], _ranges(np.zeros(len(size), np.int64), size), size)
            out[new] = np.arange(n, n + len(new))
            self.first.update((units[i], n + k) for k, i in enumerate(new.tolist()))
        return out

    def _follow(self, merge: np.ndarray, state: np.ndarray) -> None:
        """Make the states that ``merge`` (places in the agendas, of ``state``) lead to."""
        size, at = self.symbols.data[state], self.symbol_at.data[state]
        take = _ranges(at, size)
        ids, place = self.symbol.data[take].astype(np.int64), self.place.data[take].astype(np.int64)
        left = np.cumsum(size) - size + self.left.data[merge]
        ids[left] = self.code.data[merge] % self.model.size
        keep = np.ones(len(ids), bool)
        keep[left + 1] = False
        n = self._add(ids[keep], place[keep], size - 1)
        self.onward.data[merge] = np.arange(n, n + len(merge))

    def walk(self, state: np.ndarray, key: np.ndarray, limit: np.uint64) -> np.ndarray:
        """The state in which each occurrence ends, from its first one on, with its key for the draws."""
        last = state.copy()
        who = np.flatnonzero(self.merges.data[state] > 0)
        now, key, at = state[who], key[who], self.merge_at.data[state[who]]
        end = at + self.merges.data[now]
        while len(who):
            go = np.flatnonzero(mix(key ^ self.code.data[at].view(np.uint64)) >= limit)
            merge = at[go]
            unknown = self.onward.data[merge] < 0
            if unknown.any():
                slots, some = np.unique(merge[unknown], return_index=True)
                self._follow(slots, now[go[np.flatnonzero(unknown)[some]]])
            new = self.onward.data[merge]
            at += 1
            now[go] = new
            at[go] = self.merge_at.data[new]
            end[go] = at[go] + self.merges.data[new]
            rest = at < end
            if not rest.all():
                over = ~rest
                last[who[over]] = now[over]
                who, now, key, at, end = who[rest], now[rest], key[rest], at[rest], end[rest]
        return last

    def ids(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of states one after the other, and how many each has."""
        count = self.symbols.data[state]
        return self.symbol.data[_ranges(self.symbol_at.data[state], count)], count

    def heap(self, unit: bytes, key: np.uint64, limit: np.uint64) -> list[int]:
        """The ids of one unit by an agenda in a heap."""
        model, size = self.model, self.model.size
        flat, _ = model.symbols([unit])
        ids = flat.tolist()
        at, new = model.found(flat[:-1] * size + flat[1:])
        left = mix(key ^ (at * size + new).view(np.uint64)) >= limit
        # An entry is stale where one of its two symbols is no longer what it was.
        agenda = [(int(model.rank[n]), i, n, ids[i], ids[i + 1]) for i, n in zip(at[left].tolist(), new[left].tolist(), strict=True)]
        heapq.heapify(agenda)
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        merges, key_, limit_ = model.merges(), int(key), int(limit)
        while agenda:
            _, i, n, a, b = heapq.heappop(agenda)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = n, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < len(ids):
                    joined = merges.get(ids[p] * size + ids[q])
                    if joined is not None and _mix(key_ ^ (p * size + joined)) >= limit_:
                        heapq.heappush(agenda, (int(model.rank[joined]), p, joined, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def encode(self, distinct: list[bytes], index: np.ndarray, drawn: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all occurrences (units ``distinct[index]``, draws by ``drawn``), and how many each has."""
        limit, salt = limit_of(dropout), salts(distinct)
        begun, long = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), bool)
        parts, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(index), BLOCK):
            if self.symbol.n + self.code.n > REMEMBERED:
                self.clear()
                begun[:] = -1
            which = index[lo : lo + BLOCK]
            met = np.unique(which)
            new = met[(begun[met] < 0) & ~long[met]]
            if len(new):
                mark = np.zeros(len(new), bool)
                begun[new] = self.start([distinct[i] for i in new.tolist()], mark)
                long[new] = mark
            key = self.model.keys(salt[which], drawn[lo : lo + BLOCK], seed)
            short = np.flatnonzero(~long[which])
            if len(short) == len(which):
                ids, count = self.ids(self.walk(begun[which], key, limit))
            else:
                some, n = self.ids(self.walk(begun[which[short]], key[short], limit))
                others = np.flatnonzero(long[which])
                made = [np.array(self.heap(distinct[which[i]], key[i], limit), np.int32) for i in others.tolist()]
                count, at = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
                count[short], at[short] = n, np.cumsum(n) - n
                count[others] = [len(x) for x in made]
                at[others] = len(some) + np.cumsum(count[others]) - count[others]
                ids = np.concatenate([some, *made])[_ranges(at, count)]
            parts.append(ids)
            counts.append(count)
        return np.concatenate(parts), np.concatenate(counts)


def _mix(h: int) -> int:
    """``mix`` of one number."""
    low = 2**64 - 1
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & low
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & low
    return h ^ h >> 31


@lru_cache(maxsize=2)
def agendas(model: PieceModel) -> Agendas:
    """A worker's agendas of a model."""
    return Agendas(model)


def encode(model: PieceModel, column: pa.Array, doc_ids: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and each text's end among them; an empty text has none."""
    body, offsets = raw(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    shift = np.cumsum(size > 0)  # a space goes before each text that isn't empty
    flat = np.full(len(body) + int(shift[-1]) if n else 0, 32, np.uint8)
    flat[np.arange(len(body)) + np.repeat(shift, size)] = body
    ends = offsets[1:] + shift
    starts = np.concatenate([[0], ends[:-1]])
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    space, line = flat == 32, flat == 10  # no piece has a space after another character, or a line feed
    fresh = np.zeros(len(flat), bool)
    fresh[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    fresh[starts[size > 0]] = True
    at = np.flatnonzero(fresh)
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(flat)).astype(np.int64)), pa.py_buffer(flat)])
    coded = pc.dictionary_encode(units)
    distinct, index = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    first = np.searchsorted(at, np.append(starts, len(flat)))
    doc = np.repeat(np.arange(n), np.diff(first))
    number = np.arange(len(at)) - first[doc]
    drawn = mix(mix(doc_ids[doc].astype(np.int64).view(np.uint64) ^ np.uint64(seed)) + number.astype(np.uint64))
    if dropout > 0:
        ids, count = agendas(model).encode(distinct, index, drawn, dropout, seed)
        return ids, np.concatenate([[0], np.cumsum(count)])[first[1:]]
    ids, count = agendas(model).encode(distinct, np.arange(len(distinct)), np.zeros(len(distinct), np.uint64), 0.0, seed)
    begin = np.cumsum(count) - count
    return ids[_ranges(begin[index], count[index])], np.concatenate([[0], np.cumsum(count[index])])[first[1:]]


SCHEMA = "doc_id long, n_pieces long, ids_sha256 string, lossless boolean, ids array<int>"


def piece_dropout(docs: DataFrame, model: str | None = None, dropout: float = DROPOUT, seed: int = SEED, with_ids: bool = True) -> DataFrame:
    """Every text as ids of a SentencePiece merge model, with merges dropped, decoded again as a check.

    Takes doc_id and text; other columns are ignored. A null or empty text has no ids; a null doc_id draws
    as -1. ``dropout`` 0 gives the model's own segmentation. Every occurrence of a unit has draws of its
    own, by (seed, doc_id, number of the unit). Returns n_pieces, the SHA-256 of the ids as
    little-endian 32-bit numbers, ``lossless`` (decoding gave the text), and ``ids`` (null without
    ``with_ids``). Repeated rows have equal results.
    """
    path = model or default_model()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        coder = piece_model(path)
        doc_ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
        ids, ends = encode(coder, batch.column(1), doc_ids, dropout, seed)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        sha, same = [], []
        for a, b, text in zip(begins.tolist(), ends.tolist(), batch.column(1).to_pylist(), strict=True):
            sha.append(hashlib.sha256(ids[a:b].astype("<i4").tobytes()).hexdigest())
            same.append(coder.decode(ids[a:b].tolist()) == text)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))) if with_ids else pa.nulls(len(sha), pa.list_(pa.int32()))
        cols = [batch.column(0), pa.array(ends - begins, pa.int64()), pa.array(sha), pa.array(same), lists]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_pieces", "ids_sha256", "lossless", "ids"])

    return over_batches(texts(docs), run, SCHEMA)
