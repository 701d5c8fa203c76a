"""Stateful and incremental operators: fixed windows by client, expiring results, changed files (WIN-09, LNT-13, MDX-28)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..inputs import ship

OUT = "client long, event_id long, ts_ms long, allowed boolean, remaining long, reset_at long"


def _decide(rows: list[tuple[int, int]], state: tuple[int, int], limit: int, window_ms: int) -> tuple[list[tuple], tuple[int, int]]:
    """Decisions for (event_id, ts_ms) in time order from (count, reset_at); a window begins at its first request."""
    count, reset = state
    out = []
    for event, at in rows:
        if reset <= at:
            count, reset = 1, at + window_ms
            out.append((event, at, True, max(0, limit - 1), reset))
        elif count >= limit:
            out.append((event, at, False, 0, reset))
        else:
            count += 1
            out.append((event, at, True, limit - count, reset))
    return out, (count, reset)


def rate_limit(requests: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """Each request of (client, event_id, ts_ms) allowed or not, by windows that begin at a client's first request (WIN-09).

    Requests are sorted within partitions by client; a client's state is two numbers, so that one with any
    number of requests is read as a stream.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, state = None, (0, -(2**62))
        for pdf in batches:
            out = []
            for who, event, at in zip(pdf["client"].tolist(), pdf["event_id"].tolist(), pdf["ts_ms"].tolist(), strict=True):
                if who != client:
                    client, state = who, (0, -(2**62))
                rows, state = _decide([(event, at)], state, limit, window_ms)
                out.append((who, *rows[0]))
            yield pd.DataFrame(out, columns=["client", "event_id", "ts_ms", "allowed", "remaining", "reset_at"])

    ship(requests.sparkSession)
    return requests.select("client", "event_id", "ts_ms").repartition("client").sortWithinPartitions("client", "ts_ms", "event_id").mapInPandas(run, OUT)


def rate_limit_stream(requests: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """The same over a stream; a batch's requests of a client are taken in time order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = sorted((int(t), int(e)) for pdf in batches for e, t in zip(pdf["event_id"], pdf["ts_ms"], strict=True))
        out, now = _decide([(e, t) for t, e in rows], state.get if state.exists else (0, -(2**62)), limit, window_ms)
        state.update(now)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["client", "event_id", "ts_ms", "allowed", "remaining", "reset_at"])

    ship(requests.sparkSession)
    return requests.groupBy("client").applyInPandasWithState(run, OUT, "count long, reset_at long", "append", GroupStateTimeout.NoTimeout)


def fresh(cache: DataFrame, wanted: DataFrame, now: str, days: int = 7) -> DataFrame:
    """(url, verdict): verdicts that are younger than ``days``; null for those to probe again (LNT-13, SET-03)."""
    valid = cache.where(F.col("checked_at") > F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))).groupBy("url").agg(F.max_by("verdict", "checked_at").alias("verdict"))
    return wanted.select("url").distinct().join(valid, "url", "left")


def verdict(status: Column | str) -> Column:
    """What an HTTP status says of a link (LNT-14): ok, gated, dead or unknown."""
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s.between(200, 399), "ok").when(s.isin(401, 403, 429, 999), "gated").when(s.isin(404, 410), "dead").otherwise("unknown")


def upsert_batch(target: str):
    """A foreachBatch function that merges (path, source_hash) rows into a table of files, the newest version last."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(target)

    return run


def latest(table: DataFrame) -> DataFrame:
    """The newest row of each path of a table that ``upsert_batch`` writes."""
    return table.groupBy("path").agg(F.max_by("source_hash", "epoch").alias("source_hash"), F.max("epoch").alias("epoch"))
