"""Operator 7: passages that repeat across documents, found by difference-cover anchors.

Short windows are hashed at the word positions of a cover modulo a period only. As every two positions
have a common shift into the cover, a passage of ``window`` words and its copy share an anchor at the
same place in both. Shared anchors are then extended: just the whole windows around them are hashed and
compared, and of each window's occurrences all but the first are removed.

Both comparisons work on buckets of hashes. Rows of a bucket are compressed blobs, one from each batch,
in which a batch's own repeats have already been put together: a passage that a third of all documents
hold costs a bucket one entry a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import over_batches, pack_ints, partitions_for, raw, repeats_ids, unpack_ints
from .words import Words, hashes, mix, split, windows

#: A perfect difference cover: each residue modulo PERIOD but 0 is the difference of one pair.
PERIOD, COVER = 13, (0, 1, 3, 9)
WINDOW = 20
#: Buckets for each partition of a shuffle.
BUCKETS = 4

#: Bits of a hash that only choose its bucket; the others are kept.
BUCKET_BITS = 24

#: Answers that a task gathers before it hands them on.
ANSWERED = 2_000_000

#: A bucket's hashes to compare (``more``: further bits of each; ``many``: met more than once in its batch), or, with bucket -1, a batch's own answers.
ROWS = "bucket int, hash binary, more binary, many binary, docs binary, kinds binary, places binary"
#: Answers by part of the documents, then by document.
PARTS, ANSWERS = "part int, docs binary, kinds binary, places binary", "doc_id long, kind long, places binary"
_NAMES = [x.split()[0] for x in ROWS.split(", ")]
_TYPES = [pa.int32(), *[pa.binary()] * 6]


def _planes(key: np.ndarray) -> np.ndarray:
    """Bytes of 64-bit numbers, the lowest of all first."""
    return np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8).T)


def _from_planes(blob: bytes) -> np.ndarray:
    kept = np.frombuffer(blob, np.uint8).reshape(8 - BUCKET_BITS // 8, -1)
    whole = np.zeros((8, kept.shape[1]), np.uint8)
    whole[BUCKET_BITS // 8 :] = kept
    return np.ascontiguousarray(whole.T).view(np.uint64).ravel()


class Places(NamedTuple):
    """Places of words in documents; ``kind`` tells texts of one doc_id apart."""

    doc: np.ndarray
    kind: np.ndarray
    place: np.ndarray

    def take(self, at: np.ndarray) -> Places:
        """The places at ``at``."""
        return Places(self.doc[at], self.kind[at], self.place[at])

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """Each column as bytes."""
        return pack_ints(self.doc), pack_ints(self.kind), pack_ints(self.place)

    def changes(self) -> np.ndarray:
        """Whether a place is of another text than the one before."""
        return np.flatnonzero((np.diff(self.doc) != 0) | (np.diff(self.kind) != 0)) + 1


def _unpacked(row: dict) -> Places:
    return Places(*(unpack_ints(row[x]) for x in ("docs", "kinds", "places")))


def _joined(parts: list[Places]) -> Places:
    return Places(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _sorted(key: np.ndarray, more: np.ndarray, at: Places) -> tuple[np.ndarray, np.ndarray]:
    """The order of entries by hash, then document and place, each place once; and whether one is the first of its hash."""
    order = np.lexsort((at.place, at.kind, at.doc, more, key))
    key, more, at = key[order], more[order], at.take(order)
    first, new = np.ones(len(key), bool), np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (more[1:] != more[:-1])
    new[1:] = first[1:] | (at.doc[1:] != at.doc[:-1]) | (at.kind[1:] != at.kind[:-1]) | (at.place[1:] != at.place[:-1])
    return order[new], first[new]


def _to_buckets(key: np.ndarray, more: np.ndarray, at: Places, buckets: int, answer_first: bool) -> Iterator[pa.RecordBatch]:
    """A batch's hashes by bucket, each once with its first occurrence; answers for what repeats within.

    Of ``key`` the low BUCKET_BITS give the bucket and the others are compared, with ``more``.
    ``answer_first``: a hash met twice is an answer for its first occurrence too.
    """
    if not len(key):
        return
    low = key & np.uint64((1 << BUCKET_BITS) - 1)
    key = (key ^ low) | low % np.uint64(buckets)
    order, first = _sorted(key, more, at)
    key, more, at = key[order], more[order], at.take(order)
    run = np.flatnonzero(first)
    many = np.diff(np.concatenate([run, [len(key)]])) > 1
    known = ~first
    if answer_first:
        known[run[many]] = True
    rows = [(-1, None, None, None, *at.take(known).packed())] if known.any() else []
    key, more, at = key[run], more[run], at.take(run)
    bucket = (key & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)
    order = np.lexsort((at.place, at.kind, at.doc, bucket))
    key, more, at, bucket, many = key[order], more[order], at.take(order), bucket[order], many[order]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if b > a:
            rows.append((k, _planes(key[a:b])[BUCKET_BITS // 8 :].tobytes(), more[a:b].tobytes(), np.packbits(many[a:b]).tobytes(), *at.take(slice(a, b)).packed()))
    for i in range(0, len(rows), 2000):
        some = list(zip(*rows[i : i + 2000], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(some, _TYPES, strict=True)], names=_NAMES)


def _compare(rows: DataFrame, more_kind: type, first_stays: bool, n: int, keys: list[str]) -> DataFrame:
    """(``keys``, places), one row a text: where hashes stand that also stand elsewhere.

    ``first_stays``: not the first occurrence of all (by doc_id, kind, place); else every occurrence. A
    task holds one bucket at a time. Its answers go by parts of the documents, so that their rows don't
    multiply by tasks.
    """

    def repeats(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, Places]]) -> Places:
        key, more, many = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:3])
        at = _joined([p[3] for p in parts])
        order, first = _sorted(key, more, at)
        # Those met twice in their batch have had their answers.
        known = ~first if first_stays else ~(first & np.append(first[1:], True)) & ~many[order]
        return at.take(order[known])

    def by_part(given: list[Places]) -> Iterator[pa.RecordBatch]:
        at = _joined(given)
        part = (mix(at.doc.view(np.uint64) ^ mix(at.kind.view(np.uint64))) % np.uint64(n)).astype(np.int32)
        order = np.lexsort((at.place, at.kind, at.doc, part))
        part, at = part[order], at.take(order)
        cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        found = [(int(part[a]), *at.take(slice(a, b)).packed()) for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True)]
        types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=["part", "docs", "kinds", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, Places]] = []
        given: list[Places] = []
        waiting, bucket = 0, -1

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            if waiting:
                yield from by_part(given)
            given.clear()
            waiting = 0

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    if parts:
                        given.append(repeats(parts))
                        waiting += len(given[-1].doc)
                        parts.clear()
                    bucket = row["bucket"]
                if bucket < 0:
                    given.append(_unpacked(row))
                    waiting += len(given[-1].doc)
                else:
                    key = _from_planes(row["hash"]) | np.uint64(bucket)
                    many = np.unpackbits(np.frombuffer(row["many"], np.uint8), count=len(key)).astype(bool)
                    parts.append((key, np.frombuffer(row["more"], more_kind), many, _unpacked(row)))
                if waiting > ANSWERED:
                    yield from flush()
        if parts:
            given.append(repeats(parts))
            waiting += len(given[-1].doc)
        yield from flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unpacked(row) for batch in batches for row in batch.to_pylist()]
        if not parts:
            return
        at = _joined(parts)
        at = at.take(np.lexsort((at.place, at.kind, at.doc)))
        cuts = [0, *at.changes().tolist(), len(at.doc)]
        for i in range(0, len(cuts) - 1, 5000):
            some = cuts[i : i + 5001]
            blobs = [pack_ints(at.place[a:b]) for a, b in zip(some[:-1], some[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at.doc[some[:-1]]), pa.array(at.kind[some[:-1]]), pa.array(blobs, pa.binary())], names=["doc_id", "kind", "places"])

    spread = F.when(F.col("bucket") < 0, F.hash("docs")).otherwise(F.col("bucket"))
    answers = rows.repartition(n, spread).sortWithinPartitions("bucket").mapInArrow(run, PARTS)
    return answers.repartition(n, "part").mapInArrow(gather, ANSWERS).select(*keys, "places").hint("shuffle_hash")


def _cover_positions(words: Words, size: int, least: int) -> np.ndarray:
    """Word numbers of all anchors of ``size`` words in texts of at least ``least`` words."""
    n = np.diff(words.first)
    place = np.arange(len(words.start)) - words.first[words.doc]
    take = np.isin(place % PERIOD, COVER) & (place + size <= n[words.doc]) & (n[words.doc] >= least)
    return np.flatnonzero(take)


def _told(docs: DataFrame, window: int, rest: Column | None = None) -> DataFrame:
    """doc_id, text, places, and ``rest``, of every row of ``docs``."""
    if window <= PERIOD:
        raise ValueError(f"a window has more than {PERIOD} words")
    size, n = window - PERIOD + 1, partitions_for(docs)
    buckets = n * BUCKETS
    # Texts of one doc_id are told apart by a hash, if there are any.
    keys = ["doc_id", "kind"] if repeats_ids(docs) else ["doc_id"]
    kind = F.xxhash64(F.coalesce("text", F.lit(""))) if len(keys) > 1 else F.lit(0).cast("long")
    more = ["rest"] if rest is not None else []
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), kind.alias("kind"), *([rest.alias("rest")] if more else []))
    whole = rows.where("doc_id is not null")  # said once, so that both joins below share one exchange
    nameless = rows.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("binary").alias("places"), *more)

    def hashed(batch: pa.RecordBatch, at: np.ndarray, words: Words) -> Places:
        doc = words.doc[at]
        ids, kinds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        return Places(ids[doc], kinds[doc], at - words.first[doc])

    def anchors(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        body, offsets = raw(batch.column(1))
        words = split(body, offsets)
        at = _cover_positions(words, size, window)
        if len(at):
            key = windows(hashes(body, words), size)[at]
            yield from _to_buckets(key, np.zeros(len(at), np.uint8), hashed(batch, at, words), buckets, True)

    def around(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        body, offsets = raw(batch.column(1))
        words = split(body, offsets)
        count = np.diff(words.first)
        change = np.zeros(len(words.start) + 2, np.int32)
        for i, blob in enumerate(batch.column(3).to_pylist()):
            if blob:
                p = unpack_ints(blob)
                np.add.at(change, words.first[i] + np.maximum(p - (PERIOD - 1), 0), 1)
                np.add.at(change, words.first[i] + np.minimum(p, count[i] - window) + 1, -1)
        at = np.flatnonzero(np.cumsum(change)[: len(words.start)] > 0)
        if len(at):
            one, two = (windows(hashes(body, words, seed=s), window, seed=s)[at] for s in (1, 2))
            yield from _to_buckets(one, (mix(two) >> np.uint64(32)).astype(np.uint32), hashed(batch, at, words), buckets, False)

    dealt = whole.repartition(n, *keys)
    shared = _compare(over_batches(whole.select("doc_id", "text", "kind"), anchors, ROWS), np.uint8, False, n, keys)
    candidates = dealt.join(shared, keys).select("doc_id", "text", kind.alias("kind") if len(keys) == 1 else "kind", "places")
    twice = _compare(over_batches(candidates, around, ROWS), np.uint32, True, n, keys)
    return dealt.join(twice, keys, "left").select("doc_id", "text", "places", *more).union(nameless)


def repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row with the places of its words that repeat earlier ones.

    Takes doc_id and text; other columns are ignored. A null text has no words, and documents of fewer
    than ``window`` words (at least PERIOD + 1) keep all. Returns doc_id, text and ``places``: packed
    starts of windows whose words also start earlier, in a smaller doc_id or in the same document before.
    Rows that repeat doc_id and text are one document, and each gets its places; texts that share a doc_id
    are documents of their own, in the order of a hash. Rows without doc_id keep all their words, and
    nobody else's repeat them. Hashes have 40 bits besides those of the bucket for anchors, whose false
    matches extend to nothing, and 72 for windows. A task holds a bucket of hashes; there are BUCKETS
    for each partition, and partitions follow the input's size.
    """
    return _told(docs, window)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _left(words: list[bytes], blob: bytes | None, window: int) -> list[bytes]:
    """``words`` without those that the windows at the packed places cover."""
    if not blob:
        return words
    p = unpack_ints(blob)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, p, 1)
    np.add.at(change, p + window, -1)
    return [w for w, c in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if c == 0]


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """What ``repeated`` leaves of every row: counts, and the SHA-256 of the kept words joined by a space.

    ``kept_text`` is that, or the text as it was where nothing is removed; null if ``with_text`` is false.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, removed, sha, kept = [], [], [], []
        for text, blob in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = text.split()
            n.append(len(words))
            words = _left(words, blob, window)
            removed.append(n[-1] - len(words))
            left = b" ".join(words)
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode("utf-8") if with_text and n[-1] > len(words) else text.decode("utf-8") if with_text else None)
        cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in RESULT.split(", ")])

    return over_batches(repeated(docs, window), run, RESULT)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages removed from their texts (n_chars follows); all rows and columns stay.

    A row's other columns go with it, whatever their names; see ``repeated`` for odd rows.
    """
    told = _told(docs, window, F.struct(*(F.col(f"`{c}`") for c in docs.columns)))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kept = []
        for text, blob in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            kept.append(b" ".join(_left(text.split(), blob, window)).decode("utf-8") if blob else None)
        yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(kept, pa.string())], names=["rest", "kept"])

    schema = StructType([told.schema["rest"], StructField("kept", StringType())])
    rows, changed = over_batches(told, run, schema), F.col("kept").isNotNull()
    new = {"text": F.coalesce("kept", F.col("rest.text")), "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("rest.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select([new[c].alias(c) if c in new else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
