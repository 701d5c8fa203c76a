"""What the operators of this subpackage share: inputs, Arrow batches, codecs; scratch tables come from the library."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..inputs import ship, spread
from ..scratch import clear_scratch, materialize, scratch_dir, scratch_of  # noqa: F401  the operators' own

#: Bytes of text handled at once inside a Python worker.
SLICE_BYTES = 4 << 20
#: Bytes of input for each partition of a shuffle, at most about.
PARTITION_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark's readers need to reach; small documents are spread over all cores."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def partitions(spark: SparkSession) -> int:
    """Partitions of the operators' own shuffles: the session's setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def partitions_for(docs: DataFrame) -> int:
    """Partitions of a shuffle of ``docs``: the session's setting, or more where Spark's estimate of their size asks for it."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 56 else 0  # tables of unknown size have an estimate beyond any real one
    return max(partitions(docs.sparkSession), known // PARTITION_BYTES)


def repeats_ids(docs: DataFrame) -> bool:
    """Whether rows of ``docs`` share a doc_id; reads that column alone."""
    return not docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def free(name: str, columns: list[str]) -> str:
    """``name``, with underscores behind it until none of ``columns`` is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) of ``docs``, and the columns named."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def over_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``fn`` over Arrow batches cut to about SLICE_BYTES of the column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield from fn(part)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about SLICE_BYTES of text, one row at least."""
    if batch.num_rows == 0:
        return
    _, offsets = raw(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield batch.slice(at, end - at)
        at = end


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets, from 0; nulls are empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    base, end = int(offsets[0]), int(offsets[-1])
    body = np.frombuffer(data, np.uint8, end - base, base) if end > base else np.zeros(0, np.uint8)
    return body, offsets - base


def pack_ints(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes of their differences."""
    v = np.asarray(values, np.int64)
    d = np.diff(v, prepend=np.int64(0))
    z = ((d << 1) ^ (d >> 63)).view(np.uint8).reshape(-1, 8).T
    return zlib.compress(np.ascontiguousarray(z).tobytes(), 1)


def unpack_ints(blob: bytes) -> np.ndarray:
    """What ``pack_ints`` has packed."""
    z = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1)
    u = np.ascontiguousarray(z.T).view(np.uint64).reshape(-1)
    return np.cumsum((u >> np.uint64(1)).astype(np.int64) ^ -(u & np.uint64(1)).astype(np.int64))
