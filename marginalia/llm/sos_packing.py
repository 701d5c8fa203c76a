"""Operator 5: sum-of-squares online packing of documents into token windows.

Documents longer than a window are cut at whole windows; what is left of each arrives in doc_id order
and goes to the fill level that makes the sum of squared counts of partially filled windows least. The
counts stand in an array indexed by level.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import over_batches, texts
from .tokens import default_vocabulary, tokenizer

WINDOW, END_ID = 4096, 2
#: Documents that one packer places, about; a packer's state is its level array and open windows.
SHARD_DOCS = 3_000
#: A packer's sequence ids begin at its number times this.
SHARD_IDS = 1 << 40

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class SumOfSquares:
    """Windows of one packer. ``place`` returns a window's number and the offset in it."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.level = np.zeros(window + 1, np.int64)  # how many open windows have this fill
        self.open: dict[int, list[int]] = {}
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` tokens where the sum of squared counts grows least; ties take the fullest level.

        Moving one window from level h to h + size changes the sum by 2 - 2 N[h] + 2 N[h + size], or by
        1 - 2 N[h] if that fills it; a new window at level ``size`` adds 1 + 2 N[size] (nothing if full).
        """
        w, n = self.window, self.level
        if size == w:
            self.made += 1
            return self.made - 1, 0
        cost = 2 - 2 * n[1 : w - size + 1] + 2 * n[size + 1 : w + 1]
        cost[-1] -= 1  # n[w] stays 0: full windows aren't counted
        cost = np.where(n[1 : w - size + 1] > 0, cost, np.iinfo(np.int64).max)
        best = len(cost) - int(np.argmin(cost[::-1]))
        if n[best] and cost[best - 1] <= 1 + 2 * n[size]:
            n[best] -= 1
            number = self.open[best].pop()
            at = best
        else:
            number, at = self.made, 0
            self.made += 1
        if at + size < w:
            n[at + size] += 1
            self.open.setdefault(at + size, []).append(number)
        return number, at


def pieces(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Documents as token pieces of ``window`` ids and a rest, each with the CRC-32 of its ids."""
    path = vocabulary or default_vocabulary()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, ends = tokenizer(path).encode(batch.column(1), end_id)
        blob = memoryview(ids.astype("<u4").tobytes())
        begins = np.concatenate([[0], ends[:-1]])
        counts = -(-(ends - begins) // window)
        doc = np.repeat(np.arange(len(ends)), counts)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * window
        total = (ends - begins)[doc]
        length = np.minimum(window, total - start)
        at = begins[doc] + start
        crc = [zlib.crc32(blob[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
        cols = [batch.column(0).take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return over_batches(texts(docs), run, PIECES)


def sos_pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Pack every document into windows of ``window`` tokens; one row for each piece.

    Takes doc_id and text; other columns are ignored. A null or empty text is the end id alone. Pieces
    are laid without gaps from offset 0 of their sequence; each id of a document lies in one piece.
    Pieces are dealt to packers by a hash of doc_id, start and CRC-32, so that a packer's rows and state
    stay bounded, whatever a document's length or its doc_id, and the result doesn't depend on partitions
    or their order. Repeated doc_ids, or none, are packed each; an empty table gives no rows.
    """
    n = docs.count()
    shards = max(1, -(-n // shard_docs))
    rows = pieces(docs, vocabulary, window, end_id).withColumn("shard", F.pmod(F.xxhash64(F.lit(5), "doc_id", "start", "ids_crc32"), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        packer = SumOfSquares(window)
        placed = [packer.place(int(x)) for x in pdf["length"]]
        pdf["sequence_id"] = np.array([p[0] for p in placed], np.int64) + pdf["shard"].to_numpy(np.int64) * SHARD_IDS
        pdf["offset"] = np.array([p[1] for p in placed], np.int64)
        return pdf.drop(columns="shard")

    return rows.groupBy("shard").applyInPandas(run, PIECES + ", sequence_id long, offset long")
