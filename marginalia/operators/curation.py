"""Curated navigation, configuration links, sources and page lookups (NAV-*, LNT-15, SET-04 to SET-07, WIN-07, JOI-24 to JOI-29)."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..scratch import materialize
from .artifacts import ARTIFACTS
from ..sources.readers import glob_pattern

_SLUG = re.compile(r"^[a-z0-9]+(?:-[a-z0-9]+)*$")


def nav_path(base: str, path: str) -> str:
    """A path of the navigation joined to its group's base, without . and .. (STR-42)."""
    return posixpath.normpath(posixpath.join("/", base, path)).strip("/")


def groups(tree: list[dict], parent: str = "") -> Iterator[tuple[str, str | None, int, str]]:
    """(path, parent, ord, title) of a tree of groups; ValueError for bad or repeated slugs (NAV-01, NAV-03)."""
    seen: set[str] = set()
    for k, g in enumerate(tree):
        slug = g["slug"]
        if not _SLUG.match(slug):
            raise ValueError(f"{slug!r} isn't a slug")
        if slug in seen:
            raise ValueError(f"{slug!r} stands twice below {parent or 'the root'}")
        seen.add(slug)
        path = f"{parent}/{slug}" if parent else slug
        yield path, parent or None, k, g.get("title") or slug.replace("-", " ").title()
        yield from groups(g.get("groups", []), path)


def curated(spark: SparkSession, tree: list[dict], base: str = "", parent: str = "") -> DataFrame:
    """(grp, pos, ref) of a curated tree: page references and globs with inherited bases (NAV-02, NAV-11)."""

    def walk(nodes: list[dict], base: str, parent: str) -> Iterator[tuple[str, int, str]]:
        for n in nodes:
            here = nav_path(base, n.get("base", ""))
            name = f"{parent}/{n['slug']}" if parent else n["slug"]
            yield from ((name, k, nav_path(here, p)) for k, p in enumerate(n.get("pages", [])))
            yield from walk(n.get("groups", []), here, name)

    return spark.createDataFrame(list(walk(tree, base, parent)), "grp string, pos int, ref string")


def resolve_refs(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """(grp, path, pos) of curated references that are paths, each page once a group (NAV-04, NAV-05, JOI-11).

    A reference finds a page by its path without extension or closing index.
    """
    alias = pages.select("path", T.without_extension("path").alias("ref"))
    rows = refs.withColumn("ref", T.without_extension("ref")).join(alias, "ref")
    return rows.groupBy("grp", "path").agg(F.min("pos").alias("pos"))


def matching(pages: DataFrame, include: list[str], exclude: list[str] | None = None) -> DataFrame:
    """Pages that match an include glob and no exclude glob (FIL-05)."""
    hit = lambda some: F.greatest(*[F.col("path").rlike(glob_pattern(g)) for g in some], F.lit(False))
    return pages.where(hit(include) & ~hit(exclude or ["\x00"]))


def unreferenced(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """Pages that no group refers to (SET-05)."""
    return pages.join(resolved.select("path"), "path", "left_anti")


def missing_refs(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """References without a page, which are errors."""
    return refs.withColumn("key", T.without_extension("ref")).join(pages.select(T.without_extension("path").alias("key")), "key", "left_anti").select("grp", "ref")


def merge_groups(parts: list[DataFrame]) -> DataFrame:
    """Groups of several collections; ValueError if a slug stands twice, whatever its case (SET-06)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    double = out.groupBy(F.lower("slug").alias("key")).count().where("count > 1").limit(5).collect()  # at most five, for the message
    if double:
        raise ValueError("groups that stand twice: " + ", ".join(r.key for r in double))
    return out


def remote_sources(sources: DataFrame) -> DataFrame:
    """(repo, ref, dir, keys), one for each checkout (SET-04); ``conflict`` where sources want different folders."""
    g = sources.groupBy("repo", "ref").agg(F.min("dir").alias("dir"), F.array_sort(F.collect_set("key")).alias("keys"), F.countDistinct("dir").alias("dirs"))
    return g.select("repo", "ref", "dir", "keys", (F.col("dirs") > 1).alias("conflict"))


def in_repositories(sources: DataFrame, part: str) -> tuple[DataFrame, DataFrame]:
    """Sources whose repository has ``part`` in its name, and the others (FIL-11)."""
    hit = F.contains(F.lower("repo"), F.lit(part.lower()))
    return sources.where(hit), sources.where(~hit)


def watched(events: DataFrame, ignore: list[str]) -> DataFrame:
    """File events outside ignored folders (FIL-12)."""
    return events.where(~F.greatest(*[(F.col("path") == p) | F.col("path").startswith(p.rstrip("/") + "/") for p in ignore], F.lit(False)))


def distinct_paths(rows: DataFrame) -> DataFrame:
    """Paths that differ from each other whatever their case: repeats get -2, -3 and so on (WIN-07).

    A suffix that meets a path that is there goes on to the next free number, in rounds until none meet.
    """
    w = Window.partitionBy(F.lower("path")).orderBy("id")
    out = rows.withColumn("n", F.row_number().over(w)).withColumn("base", F.col("path"))
    while True:
        out = out.withColumn("path", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string"))))
        clash = Window.partitionBy(F.lower("path")).orderBy(F.col("n"), "id")
        out = materialize(out.withColumn("r", F.row_number().over(clash)))
        if out.where("r > 1").isEmpty():
            return out.drop("n", "base", "r")
        out = out.withColumn("n", F.when(F.col("r") > 1, F.col("n") + 1).otherwise(F.col("n"))).drop("r")


def find(pages: DataFrame, what: str) -> DataFrame:
    """Pages by HTML route, mirror route or id (NAV-10, SEA-13, SEA-24, JOI-24)."""
    route = T.redirect_path(F.lit(what))
    base = F.regexp_replace(route, r"(/index)?\.md$", "")
    return pages.where((F.col("url") == route) | (F.col("url") == base) | (F.col("page_id").cast("string") == what))


def config_links(links: DataFrame, routes: DataFrame, removed: DataFrame, feeds: DataFrame) -> DataFrame:
    """(kind, target) of configured links that hold no more (LNT-15, JOI-25, JOI-26).

    Links without a route; removed paths that are live again; feed prefixes below which no route lies.
    Prefixes meet the distinct paths that routes lie on, each cut behind one of its segments.
    """
    live = routes.select(F.col("route").alias("target"))
    a = links.select("target").join(live, "target", "left_anti").select(F.lit("nav").alias("kind"), "target")
    b = removed.select(F.col("path").alias("target")).join(live, "target", "left_semi").select(F.lit("removed").alias("kind"), "target")
    parts = F.split("route", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    full = routes.select(F.explode(above).alias("prefix")).distinct()
    c = feeds.select("prefix").join(full, "prefix", "left_anti").select(F.lit("feed").alias("kind"), F.col("prefix").alias("target"))
    return a.union(b).union(c)


def dead_links(links: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Links whose URL is dead (JOI-29); verdicts are of distinct URLs."""
    return links.join(verdicts.where("verdict = 'dead'").select("url").distinct(), "url", "left_semi")


def client(headers: Column) -> Column:
    """Who asks (STR-33): the first forwarded address, else the real one, else anonymous; ``headers`` is a map."""
    first = F.trim(F.split_part(headers["x-forwarded-for"], F.lit(","), F.lit(1)))
    return F.coalesce(F.nullif(F.trim(headers["cf-connecting-ip"]), F.lit("")), F.nullif(first, F.lit("")), F.nullif(F.trim(headers["x-real-ip"]), F.lit("")), F.lit("anonymous"))


def modified(*dates: Column) -> Column:
    """The first date there is, in ISO form (STR-27)."""
    return F.coalesce(*[T.iso_date(d) for d in dates])


def artifact(path: Column | str) -> Column:
    """Whether a path is one of the corpus's own artifacts (FIL-06)."""
    return T.col(path).isin(*ARTIFACTS)


def rebase(url: Column | str, old: str, new: str) -> Column:
    """A URL at another origin (NAV-22)."""
    return F.when(T.within(url, old), F.concat(F.lit(new), F.substring(T.col(url), len(old) + 1, 1 << 30))).otherwise(T.col(url))


def head_metadata(pages: DataFrame, base: str) -> DataFrame:
    """(page_id, json) of title, description, canonical and mirror links (NAV-20, NAV-21)."""
    link = F.struct(F.concat(F.lit(base), "url").alias("canonical"), F.concat(F.lit(base), "url", F.lit(".md")).alias("markdown"))
    return pages.select("page_id", F.to_json(F.struct("title", F.coalesce("description", F.lit("")).alias("description"), link.alias("links"))).alias("json"))


def slug_name(name: Column | str) -> Column:
    """Names of skills and servers as slugs (STR-44), and camelCase as kebab-case (STR-45)."""
    return T.slug(F.regexp_replace(T.col(name), "([a-z0-9])([A-Z])", "$1-$2"))
