"""Connected components of a table of links by alternating stars; a small table is joined on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize, partitions

#: Links up to which the driver joins them (4 MB); rounds of small tables cost their tasks and little else.
FEW = 1 << 18


def join_by_parts(rows: DataFrame, facts: DataFrame, keys: list[str], spread: str, n: int) -> DataFrame:
    """``rows`` with the one row of ``facts`` that has their ``keys``; others go.

    A key's rows are dealt over ``n`` parts by a hash of ``spread``, and each part meets the fact once, so
    that a key of many rows isn't one task's.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(spread), F.lit(n)))
    told = dealt.select(*keys, "part").distinct().join(facts, keys)
    return dealt.join(told, [*keys, "part"]).drop("part")


def with_least(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """``rows`` with ``m``, the least ``value`` of their ``key``, joined by parts."""
    return join_by_parts(rows, rows.groupBy(key).agg(F.min(value).alias("m")), [key], value, n)


def _is_stars(links: DataFrame) -> bool:
    """Whether each vertex hangs on at most one smaller vertex that hangs on none."""
    twice = links.groupBy("big").agg(F.count("*").alias("n")).where("n > 1")
    chained = links.select(F.col("small").alias("big")).distinct().join(links.select("big"), "big", "left_semi")
    return twice.isEmpty() and chained.isEmpty()


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of links (a, b), and the least id that each reaches."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    up = np.arange(len(ids))
    while True:
        ru, rv = up[u], up[v]
        apart = ru != rv
        if not apart.any():
            return ids, ids[up]
        np.minimum.at(up, np.maximum(ru, rv)[apart], np.minimum(ru, rv)[apart])
        while (up != up[up]).any():
            up = up[up]


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every vertex of ``links`` (a, b): component is the least id it reaches.

    Each round moves links to the least neighbour, first for larger neighbours, then for smaller ones.
    Least neighbours are partial sums by vertex and part, and a hub's links meet its least neighbour part
    by part. Loops and repeated links are allowed; no links give no rows. FEW distinct links at most are
    joined on the driver, with the same result.
    """
    n = partitions(links.sparkSession)
    now = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct())
    if now.count() <= FEW:
        told = now.toArrow()
        ids, least = joined(*(told.column(c).to_numpy() for c in ("big", "small")))
        return materialize(links.sparkSession.createDataFrame(pa.table({"id": ids, "component": least})))
    while not _is_stars(now):
        both = now.select(F.col("big").alias("u"), F.col("small").alias("v")).union(now.select(F.col("small").alias("u"), F.col("big").alias("v")))
        large = with_least(both, "u", "v", n).where("v > u").select(F.col("v").alias("big"), F.least("u", "m").alias("small"))
        rooted = with_least(large, "big", "small", n)
        moved = rooted.select(F.when(F.col("small") == F.col("m"), F.col("big")).otherwise(F.col("small")).alias("big"), F.col("m").alias("small"))
        now = materialize(moved.distinct())
    roots = now.select(F.col("small").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("big").alias("id"), F.col("small").alias("component")).union(roots)
