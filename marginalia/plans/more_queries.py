"""Queries over locales, curated navigation and content checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import content_checks as K, curation as U, locales as G
from . import views as V
from .views import query

_LOCALES = G.Locales(("en", "fr", "de"), "en")


@query(f"SELECT page_id, CASE WHEN lang IN ('fr', 'de') THEN '/docs/' || lang || '/g/' || page_id ELSE '/docs/g/' || page_id END AS localised, CASE WHEN lang IN ('en', 'fr', 'de') THEN lang ELSE 'en' END AS locale, CASE WHEN lang IN ('en', 'fr', 'de') THEN relative_path[length(lang) + 2:] ELSE relative_path END AS logical, CASE WHEN lang IN ('fr', 'de', 'en') THEN '/docs/' || page_id ELSE url END AS plain FROM {V.PAGES} p")
def locale_urls(spark: SparkSession, d: str) -> DataFrame:
    """STR-23 to STR-25: locales of paths and URLs."""
    p = V.pages(spark, d)
    locale, logical = G.split_path("relative_path", _LOCALES)
    to = F.when(F.col("lang").isin("fr", "de"), F.col("lang")).otherwise("en")
    return p.select("page_id", G.localise(F.concat(F.lit("/docs/g/"), F.col("page_id").cast("string")), to, _LOCALES).alias("localised"), locale.alias("locale"), logical.alias("logical"), G.without_locale("url", _LOCALES).alias("plain"))


@query("SELECT 'nav' AS kind, '/c/' || (n_nationkey * 9) AS target FROM nation WHERE n_nationkey * 9 NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'removed', '/c/' || c_custkey FROM customer WHERE c_custkey % 50 = 0 UNION ALL SELECT 'feed', '/x/' || r_regionkey FROM region")
def config_links(spark: SparkSession, d: str) -> DataFrame:
    """LNT-15, JOI-25, JOI-26: configured links that hold no more."""
    at = lambda c, k: F.concat(F.lit(k), F.col(c).cast("string"))
    routes = V.read(spark, d, "customer").select(at("c_custkey", "/c/").alias("route"))
    links = V.read(spark, d, "nation").select(F.concat(F.lit("/c/"), (F.col("n_nationkey") * 9).cast("string")).alias("target"))
    removed = V.read(spark, d, "customer").where("c_custkey % 50 = 0").select(at("c_custkey", "/c/").alias("path"))
    feeds = V.read(spark, d, "region").select(at("r_regionkey", "/x/").alias("prefix")).union(spark.createDataFrame([("/c",)], "prefix string"))
    return U.config_links(links, routes, removed, feeds)


@query("WITH v AS (SELECT url, CASE page_id % 3 WHEN 0 THEN 'dead' ELSE 'ok' END AS verdict FROM pages) SELECT page_id FROM pages WHERE url IN (SELECT url FROM v WHERE verdict = 'dead')")
def dead_links(spark: SparkSession, d: str) -> DataFrame:
    """JOI-29, SET-03: pages whose URL is dead."""
    p = V.read(spark, d, "pages")
    verdicts = p.select("url", F.when(F.col("page_id") % 3 == 0, "dead").otherwise("ok").alias("verdict"))
    return U.dead_links(p.select("page_id", "url"), verdicts).select("page_id")


@query("SELECT p_partkey AS id, CASE WHEN r = 1 THEN path ELSE path || '-' || r END AS path FROM (SELECT p_partkey, '/' || replace(p_brand, '#', '') AS path, row_number() OVER (PARTITION BY lower(replace(p_brand, '#', '')) ORDER BY p_partkey) AS r FROM part)")
def distinct_paths(spark: SparkSession, d: str) -> DataFrame:
    """WIN-07: paths that differ."""
    p = V.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("path"))
    return U.distinct_paths(p)


@query("SELECT s_nationkey AS repo, s_suppkey % 3 AS ref, min(s_suppkey % 4) AS dir, count(*) AS keys, count(DISTINCT s_suppkey % 4) > 1 AS conflict FROM supplier GROUP BY ALL")
def remote_sources(spark: SparkSession, d: str) -> DataFrame:
    """SET-04: checkouts that sources share."""
    s = V.read(spark, d, "supplier").select(F.col("s_nationkey").alias("repo"), (F.col("s_suppkey") % 3).alias("ref"), (F.col("s_suppkey") % 4).alias("dir"), F.col("s_suppkey").alias("key"))
    return U.remote_sources(s).withColumn("keys", F.size("keys").cast("long"))


@query(f"WITH {V.LINES}, k AS (SELECT page_id, sum(CAST(marker AND NOT fenced AS INT)) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block, marker, line FROM l WHERE fenced OR marker) SELECT page_id, CAST(block AS BIGINT) AS block, CAST(coalesce(sum(length(line)) FILTER (WHERE NOT marker), 0) AS BIGINT) AS chars FROM k GROUP BY ALL")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    """LNT-12: fenced blocks."""
    return K.snippets(V.markdown(spark, d)).select("page_id", F.col("block").cast("long").alias("block"), F.length("code").cast("long").alias("chars"))


@query("SELECT event_id FROM events WHERE event_id % 7 = 0")
def json_ld_problems(spark: SparkSession, d: str) -> DataFrame:
    """LNT-08, ARR-18: JSON-LD that isn't valid."""
    good = F.concat(F.lit('{"@type":"TechArticle","dateModified":"2024-01-01","props":'), "props", F.lit("}"))
    bad = F.element_at(F.array(F.lit("{"), F.lit('{"a":1}'), F.lit('{"@type":"X","dateModified":"soon"}')), (1 + F.col("event_id") % 3).cast("int"))
    rows = V.read(spark, d, "events").select(F.col("event_id").alias("page_id"), F.when(F.col("event_id") % 7 == 0, bad).otherwise(good).alias("json"))
    return K.json_ld_problems(rows).select(F.col("page_id").alias("event_id"))


@query("SELECT doc_id AS path, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def file_digests(spark: SparkSession, d: str) -> DataFrame:
    """SNK-12: a manifest with digests."""
    return K.digests(V.read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")))
