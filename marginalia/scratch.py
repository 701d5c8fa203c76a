"""Scratch tables in the shared folder, where lineage ends between rounds."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[tuple[SparkSession, str, str]] = []
_OWNER = [""]


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a local one where that is unset and all tasks are local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        base = tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/marginalia-{uuid.uuid4().hex}"


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with a writer's ``options``, and read it back, so that lineage ends there."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.options(**options).parquet(path)
    _SCRATCH.append((spark, path, _OWNER[-1]))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_of(owner: str) -> Iterator[None]:
    """Name whose the tables are that ``materialize`` writes meanwhile."""
    _OWNER.append(owner)
    try:
        yield
    finally:
        _OWNER.pop()


def clear_scratch(owner: str | None = None) -> None:
    """Delete the tables that ``materialize`` wrote for ``owner``, or all; there must be no more use for them."""
    for found in [x for x in _SCRATCH if owner in (None, x[2])]:
        _SCRATCH.remove(found)
        spark, path, _ = found
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may have ended
            continue


atexit.register(clear_scratch)
