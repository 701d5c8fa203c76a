"""Sinks: index tables, Markdown mirrors, JSON lines, single files (SNK-*)."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.retrieval import Index

FORMAT = 1


def write_index(index: Index, path: str) -> None:
    """The tables of an index with a format version (SNK-02)."""
    for name in ("chunks", "postings", "vocab"):
        getattr(index, name).withColumn("format_version", F.lit(FORMAT)).write.mode("overwrite").parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str) -> Index:
    """An index as written (SRC-18); ValueError for another format."""
    parts = []
    for name in ("chunks", "postings", "vocab"):
        df = spark.read.parquet(f"{path}/{name}")
        if df.where(F.col("format_version") != FORMAT).limit(1).count():
            raise ValueError(f"{name} has another format")
        parts.append(df.drop("format_version"))
    return Index(*parts)


def write_atomic(path: str | Path, text: str) -> None:
    """One file, whole or not at all (SNK-01)."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    with os.fdopen(handle, "w") as f:
        f.write(text)
    os.replace(name, path)


def write_mirrors(pages: DataFrame, path: str, files_at_once: int | None = None) -> None:
    """(path, markdown) as Parquet, dealt by path (SNK-03); mirrors of huge corpora aren't single files."""
    (pages.repartition(files_at_once, "path") if files_at_once else pages).write.mode("overwrite").parquet(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """One text line for each row's only column (SNK-11)."""
    rows.write.mode("overwrite").text(path)


def write_if_changed(new: DataFrame, path: str) -> bool:
    """Write a table unless it holds the same rows already (SNK-10); whether it was written."""
    spark = new.sparkSession
    try:
        old = spark.read.parquet(path)
        if old.schema.simpleString() == new.schema.simpleString() and old.exceptAll(new).isEmpty() and new.exceptAll(old).isEmpty():
            return False
    except Exception as error:  # no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    new.write.mode("overwrite").parquet(path)
    return True
