"""Comparing two states of a corpus: moves, redirects, pruning, reuse, history (JOI-15 to JOI-21, RED-01, SET-02, WIN-01)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..scratch import materialize

MOVED, GONE = 308, 410
# Authors that are bots, besides names with [bot] or a bot suffix.
BOTS = ["claude", "claude code", "codex", "dependabot", "github-actions", "github actions", "netlify", "openai codex", "renovate", "vercel"]


def moves(before: DataFrame, now: DataFrame) -> DataFrame:
    """(from, to) of (path, hash) tables: pages whose hash left one path and came up at one other (JOI-15)."""
    left = before.join(now.select("path"), "path", "left_anti")
    come = now.join(before.select("path"), "path", "left_anti")
    one = lambda df, name: df.groupBy("hash").agg(F.count("*").alias("n"), F.min("path").alias(name)).where("n = 1").drop("n")
    return one(left, "from").join(one(come, "to"), "hash").select("from", "to")


def resolve_chains(links: DataFrame, targets: DataFrame) -> DataFrame:
    """(from, to) with ``to`` followed through ``targets`` (from, to); null where it loops (JOI-16).

    Each round doubles the hops that are followed, until no target goes on; after as many hops as there
    are targets, only loops do. ``targets`` has each from once.
    """
    jump = materialize(targets.where("to is not null").select(F.col("from").alias("at"), F.col("to").alias("next")))
    now, start = links.select("from", "to"), jump
    for _ in range(jump.count().bit_length()):
        now = materialize(now.join(jump, F.col("to") == F.col("at"), "left").select("from", F.coalesce("next", "to").alias("to")))
        if now.join(start, F.col("to") == F.col("at"), "left_semi").isEmpty():
            return now
        far = jump.select(F.col("at").alias("at_"), F.col("next").alias("next_"))
        jump = materialize(jump.join(far, F.col("next") == F.col("at_"), "left").select("at", F.coalesce("next_", "next").alias("next")))
    loops = start.select("at", F.lit(True).alias("loops"))
    return now.join(loops, F.col("to") == F.col("at"), "left").select("from", F.when(F.col("loops").isNull(), F.col("to")).alias("to"))


def redirects(before: DataFrame, now: DataFrame, claims: DataFrame, removed: DataFrame, history: DataFrame) -> DataFrame:
    """(from, to, status): every redirect after a run (RED-01).

    ``before`` and ``now`` have path and hash, ``claims`` from and to, ``removed`` path, ``history`` from
    and to (null: gone). Claims win over moves, both over removals, those over history. History drops
    where its path is live again; its targets are followed, and are gone if they loop or were removed.
    """
    target = claims.withColumn("p", F.lit(1)).unionByName(moves(before, now).withColumn("p", F.lit(2)))
    target = target.groupBy("from").agg(F.min_by("to", F.struct("p", "to")).alias("to"))
    live = now.select(F.col("path").alias("from"))
    gone = removed.select(F.col("path").alias("from")).join(live, "from", "left_anti").join(target.select("from"), "from", "left_anti").distinct()
    fresh = target.withColumn("status", F.lit(MOVED)).unionByName(gone.select("from", F.lit(None).cast("string").alias("to"), F.lit(GONE).alias("status")))
    old = history.join(live, "from", "left_anti").join(fresh.select("from"), "from", "left_anti")
    moved = resolve_chains(old.where(F.col("to").isNotNull()), target).join(gone.select(F.col("from").alias("to"), F.lit(True).alias("dead")), "to", "left")
    end = F.when(F.col("dead").isNull(), F.col("to"))
    carried = moved.select("from", end.alias("to"), F.when(end.isNull(), GONE).otherwise(MOVED).alias("status"))
    ended = old.where(F.col("to").isNull()).select("from", "to", F.lit(GONE).alias("status"))
    return fresh.unionByName(carried).unionByName(ended)


def unmatched(before: DataFrame, now: DataFrame, found: DataFrame) -> DataFrame:
    """Paths that went and have no redirect."""
    return before.select("path").join(now.select("path"), "path", "left_anti").join(found.select(F.col("from").alias("path")), "path", "left_anti")


def resolve_requests(requests: DataFrame, found: DataFrame) -> DataFrame:
    """(path, to, status) for requested paths (JOI-17): the redirect itself, or for .md that of the page, to its mirror."""
    asked = requests.select("path", T.redirect_path("path").alias("norm")).withColumn("base", F.when(F.col("norm").endswith(".md"), F.regexp_replace("norm", r"\.md$", "")))
    direct = found.select(F.col("from").alias("norm"), F.col("to").alias("to1"), F.col("status").alias("s1"))
    by_base = found.select(F.col("from").alias("base"), F.col("to").alias("to2"), F.col("status").alias("s2"))
    both = asked.join(direct, "norm", "left").join(by_base, "base", "left")
    mirrored = F.when(F.col("to2") == "/", F.lit("/index.md")).otherwise(F.concat("to2", F.lit(".md")))
    return both.select("path", F.when(F.col("s1").isNotNull(), F.col("to1")).otherwise(mirrored).alias("to"), F.coalesce("s1", "s2").alias("status")).where("status is not null")


def orphans(expected: DataFrame, existing: DataFrame, keep: str | None = None) -> DataFrame:
    """Paths that exist and are expected no more (SNK-16, SNK-19, SNK-20, SET-02); those matching ``keep`` stay."""
    extra = existing.select("path").join(expected.select("path"), "path", "left_anti")
    return extra.where(~F.col("path").rlike(keep)) if keep else extra


def reusable(cache: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, reuse): whether a cached output still holds (JOI-20, JOI-21).

    ``cache`` has path, source_hash and deps (map of path to hash); ``sources`` path and hash. The source
    and every dependency must be as they were.
    """
    now = sources.select("path", "hash")
    stale = (
        cache.select("path", F.explode("deps").alias("dep", "was")).join(now.select(F.col("path").alias("dep"), F.col("hash").alias("is")), "dep", "left")
        .where(~F.col("was").eqNullSafe(F.col("is"))).select("path").distinct().withColumn("stale", F.lit(True))
    )
    same = F.col("source_hash").eqNullSafe(F.col("hash")) & F.col("hash").isNotNull()
    return now.join(cache.select("path", "source_hash"), "path", "left").join(stale, "path", "left").select("path", (same & F.col("stale").isNull()).alias("reuse"))


def is_bot(author: Column | str, ignored: Iterable[str] = ()) -> Column:
    """Whether an author is a bot, or one of the ``ignored`` names, whatever their case (STR-41)."""
    name = F.lower(F.trim(T.col(author)))
    return name.isin([*BOTS, *(x.strip().lower() for x in ignored if x.strip())]) | name.contains("[bot]") | name.rlike("[ _-]bot$")


def last_changes(commits: DataFrame, window: int = 50, ignored: Iterable[str] = ()) -> DataFrame:
    """(path, last_modified, last_author) of path, ts, author, seq: the newest commit, and the newest author who isn't a bot or ``ignored`` within the newest ``window`` (WIN-01, JOI-19)."""
    w = Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("seq"))
    recent = commits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= window)
    human = F.min_by("author", F.when(~is_bot("author", ignored), F.col("r")))
    return recent.groupBy("path").agg(F.max("ts").alias("last_modified"), human.alias("last_author"))


def with_history(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """Pages with the date and author of their last change where they have none themselves (MDX-29)."""
    told = changes.select("path", F.col("last_modified").alias("changed_"), F.col("last_author").alias("by_"))
    both = pages.join(told, "path", "left")
    return both.withColumns({"last_modified": F.coalesce("last_modified", "changed_"), "author": F.coalesce("author", "by_")}).drop("changed_", "by_")
