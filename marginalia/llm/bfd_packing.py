"""Operator 2: best-fit-decreasing packing of documents into id matrices.

Within each buffer of a bounded number of tokens, pieces are placed from long to short into the row
with the least room that still holds them; a segment tree over capacities finds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, texts
from .tokens import default_vocabulary, tokenizer

WINDOW, END_ID, PAD_ID = 2048, 2, 0
#: Tokens that are packed together.
BUFFER_TOKENS = 4 << 20

SCHEMA = (
    "lead_doc_id long, lead_start long, n_tokens int, ids binary, position_ids binary, cu_seqlens array<int>, "
    "doc_ids array<long>, starts array<long>"
)


class CapacityTree:
    """How many rows have each capacity, in a segment tree: the least capacity of at least ``x`` by one descent."""

    def __init__(self, most: int):
        self.leaves = 1 << max(1, most).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, change: int) -> None:
        """Count ``change`` more rows with ``capacity``."""
        node = self.leaves + capacity
        while node:
            self.count[node] += change
            node >>= 1

    def least(self, x: int) -> int:
        """The least capacity of at least ``x`` that some row has; -1 if none."""
        node = self.leaves + x
        if self.count[node]:
            return x
        while node > 1:
            if not node & 1 and self.count[node | 1]:
                node |= 1
                break
            node >>= 1
        else:
            return -1
        while node < self.leaves:
            node <<= 1
            if not self.count[node]:
                node |= 1
        return node - self.leaves


def best_fit(sizes: list[int], window: int) -> list[list[int]]:
    """Rows of indices into ``sizes``: longest first, each into the fullest row that holds it; ties by index."""
    tree, having, rows = CapacityTree(window), {}, []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[i]
        room = tree.least(size)
        if room < 0:
            rows.append([i])
            row = len(rows) - 1
            room = window
        else:
            tree.add(room, -1)
            row = having[room].pop()
            rows[row].append(i)
        if room > size:
            tree.add(room - size, 1)
            having.setdefault(room - size, []).append(row)
    return rows


def bfd_pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, pad_id: int = PAD_ID, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """Every document's ids in rows of ``window``: one output row for each row of the id matrix.

    Takes doc_id and text; other columns are ignored. A null or empty text is the end id alone. Longer
    documents are cut at whole windows. ``ids`` are ``window`` little-endian unsigned 16-bit ids
    (32-bit where the vocabulary needs it), padded by ``pad_id`` after ``n_tokens``; ``cu_seqlens`` the
    segments' ends, from 0; ``position_ids`` unsigned 32-bit positions that go on from a segment's
    ``starts`` within its document, so a document begins again at 0; padding has 0. (lead_doc_id,
    lead_start) names a row; a null doc_id stays null. Packing works on runs of a partition's rows in the
    order of doc_id and text, without a shuffle, so a lost task makes the same rows again in whatever order
    its input comes. Repeated rows are packed each, an empty table gives none.
    """
    path = vocabulary or default_vocabulary()

    def emit(doc: np.ndarray, ids: np.ndarray, ends: np.ndarray, wide: bool) -> Iterator[pa.RecordBatch]:
        begins = np.concatenate([[0], ends[:-1]])
        counts = -(-(ends - begins) // window)
        of = np.repeat(np.arange(len(ends)), counts)
        start = (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)) * window
        size = np.minimum(window, (ends - begins)[of] - start)
        at = begins[of] + start
        rows = best_fit(size.tolist(), window)
        for lo in range(0, len(rows), 512):
            some = rows[lo : lo + 512]
            matrix = np.full((len(some), window), pad_id, "<u4" if wide else "<u2")
            places = np.zeros((len(some), window), "<u4")
            cuts = []
            for k, row in enumerate(some):
                fill, ends_here = 0, [0]
                for i in row:
                    n = int(size[i])
                    matrix[k, fill : fill + n] = ids[at[i] : at[i] + n]
                    places[k, fill : fill + n] = np.arange(start[i], start[i] + n)
                    fill += n
                    ends_here.append(fill)
                cuts.append(ends_here)
            cols = [
                pa.array([doc[of[r[0]]] for r in some], pa.int64()), pa.array([start[r[0]] for r in some], pa.int64()), pa.array([c[-1] for c in cuts], pa.int32()),
                pa.array([m.tobytes() for m in matrix], pa.binary()), pa.array([p.tobytes() for p in places], pa.binary()), pa.array(cuts, pa.list_(pa.int32())),
                pa.array([doc[of[r]].tolist() for r in some], pa.list_(pa.int64())), pa.array([start[r].tolist() for r in some], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        wide = max(coder.tokenizer.get_vocab_size(), end_id, pad_id) > 65536
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            shift = np.cumsum([0, *(len(h[1]) for h in held)])
            yield from emit(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] + s for h, s in zip(held, shift, strict=False)]), wide)
            held.clear()

        for batch in batches:
            for part in slices(batch):
                ids, ends = coder.encode(part.column(1), end_id)
                held.append((np.array(part.column(0).to_pylist(), object), ids, ends))
                tokens += len(ids)
                if tokens >= buffer_tokens:
                    yield from flush()
                    tokens = 0
        if held:
            yield from flush()

    return texts(docs).sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(run, SCHEMA)
