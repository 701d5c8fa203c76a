"""Queries over sources, histories, snippets, metadata and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import content_checks as K, curation as U, experiments as X, locales as G, navigation as N, retrieval as R, snapshots as P
from ..sources import readers
from . import views as V
from .views import query


def _customer(spark: SparkSession, d: str, **columns: object) -> DataFrame:
    return V.read(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), *[c.alias(name) for name, c in columns.items()])


@query("SELECT c_custkey AS page_id FROM customer WHERE CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false ELSE c_nationkey % 3 <> 1 END")
def searchable_pages(spark: SparkSession, d: str) -> DataFrame:
    """SEA-01: pages to index, by their setting or their folder."""
    k, n = F.col("c_custkey") % 5, F.col("c_nationkey") % 3
    path = F.when(n == 1, "guide/_shared/a.md").when(n == 2, "guide/shared-things/a.md").otherwise("guide/a.md")
    return R.searchable(_customer(spark, d, relative_path=path, search=F.when(k == 0, True).when(k == 1, False))).select("page_id")


@query("SELECT lang AS locale, count(*) AS pages, count(*) FILTER (doc_id % 3 = 0) AS fallbacks FROM documents GROUP BY 1")
def locale_manifest(spark: SparkSession, d: str) -> DataFrame:
    """I18-02, SNK-17: pages and fallbacks by locale."""
    return G.manifest(V.read(spark, d, "documents").select(F.col("lang").alias("locale"), (F.col("doc_id") % 3 == 0).alias("is_fallback")))


@query("SELECT c_custkey AS page_id, 'canonical' AS field, 'https://x.org/' || c_mktsegment AS url FROM customer UNION ALL SELECT c_custkey, 'links', u FROM (SELECT c_custkey, unnest(['/docs/n' || c_nationkey, 'http://y.org/a?b=' || c_custkey]) AS u FROM customer)")
def frontmatter_urls(spark: SparkSession, d: str) -> DataFrame:
    """ARR-15: URLs anywhere in a page's metadata."""
    links = F.concat(F.lit('{"a":["/docs/n'), F.col("c_nationkey").cast("string"), F.lit('", {"b":"http://y.org/a?b='), F.col("c_custkey").cast("string"), F.lit('"}], "c":"docs/none"}'))
    values = F.create_map(F.lit("canonical"), F.concat(F.lit("see https://x.org/"), "c_mktsegment"), F.lit("links"), links, F.lit("title"), F.lit("no url"))
    return K.urls_in(_customer(spark, d, frontmatter=values))


@query("SELECT c_custkey AS page_id, unnest(CASE WHEN c_custkey % 4 = 0 THEN ['Gadget' || c_nationkey, 'Odd'] ELSE ['Gadget' || c_nationkey] END) AS name FROM customer")
def unknown_components(spark: SparkSession, d: str) -> DataFrame:
    """LNT-07: components that no handler knows, outside fences."""
    gadget = F.concat(F.lit("<Gadget"), F.col("c_nationkey").cast("string"), F.lit(" x='1'>"))
    text = F.concat(F.lit("# T\n<Callout>a</Callout> "), gadget, F.lit("\n```\n<Hidden/>\n```\n"), F.when(F.col("c_custkey") % 4 == 0, "a <Odd/> and <Odd/>").otherwise("a <b>"), F.lit("\n"), gadget)
    return K.leaking_components(_customer(spark, d, content=text))


@query("SELECT c_custkey AS page_id, CAST(1 AS BIGINT) AS block, 'json' AS lang FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 2, 'jsonc' FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 3, 'yaml' FROM customer WHERE c_custkey % 4 = 0")
def snippets_that_fail(spark: SparkSession, d: str) -> DataFrame:
    """LNT-09, LNT-10: snippets that don't parse, with comments and trailing commas where they may stand."""
    k, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    text = F.concat(
        F.lit('# T\n```json\n{"a": '), key, F.when(k % 3 == 0, ",}").otherwise("}"), F.lit('\n```\ntext\n```jsonc\n{"b": ['), key, F.lit(", 2,], // c\n"),
        F.when(k % 5 == 0, '"c"').otherwise("/* d */"), F.lit("}\n```\n```yaml\na: ["), key, F.when(k % 4 == 0, "").otherwise("]"), F.lit("\n```"),
    )
    return K.broken_snippets(_customer(spark, d, content=text)).withColumn("block", F.col("block").cast("long"))


@query("SELECT event_id, event_id % 6 IN (0, 2, 3) AS transient FROM events")
def transient_errors(spark: SparkSession, d: str) -> DataFrame:
    """FIL-09: errors that may pass by themselves."""
    said = F.element_at(F.array(*map(F.lit, ["429: rate limit", "no such file", "model Overloaded", "request timed out", "bad key", None])), (F.col("event_id") % 6 + 1).cast("int"))
    return V.read(spark, d, "events").select("event_id", X.transient(said).alias("transient"))


@query(f"SELECT page_id FROM {V.PAGES} p WHERE NOT (starts_with(relative_path, 'en/') OR starts_with(relative_path, 'fr/web/') OR relative_path = 'de/forum')")
def watched_files(spark: SparkSession, d: str) -> DataFrame:
    """FIL-12: events of files outside ignored folders."""
    return U.watched(V.pages(spark, d).withColumnRenamed("relative_path", "path"), ["en/", "fr/web", "de/forum"]).select("page_id")


@query("""WITH c AS (SELECT o_custkey AS path, max(o_orderdate) AS ts FROM orders GROUP BY 1)
  SELECT c_custkey AS page_id, CASE WHEN c_custkey % 4 = 0 THEN 'own' WHEN ts IS NOT NULL THEN strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d') END AS last_modified, CASE WHEN c_custkey % 3 = 0 THEN 'me' WHEN ts IS NOT NULL THEN 'them' END AS author FROM customer LEFT JOIN c ON c_custkey = path""")
def page_history(spark: SparkSession, d: str) -> DataFrame:
    """MDX-29: date and author of the last change where a page has none itself."""
    k = F.col("c_custkey")
    pages = _customer(spark, d, path=k, last_modified=F.when(k % 4 == 0, "own"), author=F.when(k % 3 == 0, "me"))
    changes = V.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_modified"), F.lit("them").alias("last_author"))
    return P.with_history(pages, changes).select("page_id", "last_modified", "author")


@query(f"SELECT page_id, title FROM {V.PAGES} p WHERE url = '/docs/en/12' OR page_id = 7 OR url = '/docs/fr/40'")
def found_pages(spark: SparkSession, d: str) -> DataFrame:
    """NAV-10, SEA-13, JOI-24: pages by route, mirror or id."""
    p = V.pages(spark, d)
    return U.find(p, "/docs/en/12/").union(U.find(p, "7")).union(U.find(p, "docs/fr/40.md")).select("page_id", "title")


@query("SELECT slug, count(*) AS pages FROM (SELECT DISTINCT doc_id, unnest([lower(source), lang]) AS slug FROM documents) t GROUP BY 1")
def inferred_groups(spark: SparkSession, d: str) -> DataFrame:
    """AGG-16: the groups that pages name, whatever their case."""
    named = F.array(F.upper("source"), F.concat(F.lit(" "), "lang"), F.col("source"), F.lit(" "))
    return N.inferred(V.read(spark, d, "documents").select(F.col("doc_id").alias("page_id"), named.alias("groups")))


@query("SELECT 'api/s' || s_suppkey AS relative_path, s_name AS title FROM supplier UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation")
def merged_sources(spark: SparkSession, d: str) -> DataFrame:
    """SRC-16, SRC-17, SET-01: sources in one, below their mounts."""
    at = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string")).alias("relative_path")
    remote = V.read(spark, d, "supplier").select(at("s", "s_suppkey"), F.col("s_name").alias("title"))
    return readers.union_sources({"api": remote, "": V.read(spark, d, "nation").select(at("n", "n_nationkey"), F.col("n_name").alias("title"))})


@query("""SELECT c_custkey AS page_id, '{"title":"' || c_name || '","description":"' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END || '","links":{"canonical":"https://x.org/docs/' || c_custkey || '","markdown":"https://x.org/docs/' || c_custkey || '.md"}}' AS json FROM customer""")
def head_links(spark: SparkSession, d: str) -> DataFrame:
    """NAV-20, NAV-21: metadata of a page's head, with canonical and mirror links."""
    url = F.concat(F.lit("/docs/"), F.col("c_custkey").cast("string"))
    return U.head_metadata(_customer(spark, d, title=F.col("c_name"), description=F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), url=url), "https://x.org")


@query("""SELECT CASE WHEN c_custkey % 2 = 0 THEN '::error file=f' || c_custkey || '::[links] gone' ELSE '::warning file=f' || c_custkey || '::[geo] gone' END AS line FROM customer
  UNION ALL SELECT 'f' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ': error links url: gone' ELSE ': warn geo: gone' END FROM customer""")
def finding_lines(spark: SparkSession, d: str) -> DataFrame:
    """SNK-18: findings as lines, for people and for a workflow."""
    even = F.col("c_custkey") % 2 == 0
    found = _customer(spark, d, file=F.concat(F.lit("f"), F.col("c_custkey").cast("string")), rule=F.when(even, "links").otherwise("geo"), severity=F.when(even, "error").otherwise("warn"), field=F.when(even, "url"), message=F.lit("gone")).drop("page_id")
    return K.report(found, "github").union(K.report(found))


@query("""SELECT c_custkey AS page_id, CASE WHEN c_custkey % 3 = 0 THEN 'own' ELSE '/u/' || c_custkey END AS url, CASE WHEN c_custkey % 2 = 0 THEN 'n' || c_nationkey || ',z' END AS aliases, c_name AS title FROM customer""")
def enriched_metadata(spark: SparkSession, d: str) -> DataFrame:
    """STR-40: metadata with url and aliases, unless a page has them."""
    k = F.col("c_custkey")
    own = F.when(k % 3 == 0, F.create_map(F.lit("title"), "c_name", F.lit("url"), F.lit("own"))).otherwise(F.create_map(F.lit("title"), "c_name"))
    other = F.when(k % 2 == 0, F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.lit("z"))).otherwise(F.array().cast("array<string>"))
    rows = _customer(spark, d, own=own, url=F.concat(F.lit("/u/"), k.cast("string")), other=other)
    rows = rows.select("page_id", T.enriched("own", F.col("url"), F.col("other")).alias("m"))
    return rows.select("page_id", F.col("m")["url"].alias("url"), F.col("m")["aliases"].alias("aliases"), F.col("m")["title"].alias("title"))
