"""Queries over navigation, snapshots, feeds, lint, experiments and artifacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import artifacts as A, checks as C, experiments as X, linter as M, mdx, navigation as N, openapi as O, snapshots as Z, structure as S
from ..streaming import limits as L
from . import views as V
from .views import query

# ---- groups, navigation, locales ----


@query(f"""WITH g AS (SELECT r_name AS slug FROM region UNION ALL SELECT 'SRC' || n_nationkey FROM nation WHERE n_nationkey < 8)
SELECT page_id, coalesce(slug, grp) AS slug, CASE WHEN slug IS NULL THEN 'unknown' ELSE 'member' END AS status FROM {V.PAGES} p LEFT JOIN g ON lower(slug) = lower(grp)
UNION ALL SELECT page_id, NULL, 'ungrouped' FROM {V.PAGES} p WHERE lower(grp) NOT IN (SELECT lower(slug) FROM g)""")
def group_membership(spark: SparkSession, d: str) -> DataFrame:
    """JOI-09, JOI-10, ARR-06: pages by configured groups, without case."""
    g = V.read(spark, d, "region").select(F.col("r_name").alias("slug")).union(V.read(spark, d, "nation").where("n_nationkey < 8").select(F.concat(F.lit("SRC"), F.col("n_nationkey").cast("string"))))
    return N.memberships(V.pages(spark, d), g)


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    region = V.read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.col("r_regionkey").cast("long").alias("ord"), F.col("r_name").alias("title"))
    nation = V.read(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long"), F.col("n_regionkey").cast("long"), F.length("n_name").cast("long"), F.col("n_name"))
    supplier = V.read(spark, d, "supplier").select((F.col("s_suppkey") + 1000).cast("long"), (F.col("s_nationkey") + 100).cast("long"), (F.col("s_suppkey") % 7).cast("long"), F.col("s_name"))
    return region.union(nation).union(supplier)


_TREE = """n AS (SELECT CAST(r_regionkey AS BIGINT) AS node, CAST(NULL AS BIGINT) AS parent, CAST(r_regionkey AS BIGINT) AS ord, r_name AS title FROM region
  UNION ALL SELECT n_nationkey + 100, n_regionkey, length(n_name), n_name FROM nation UNION ALL SELECT s_suppkey + 1000, s_nationkey + 100, s_suppkey % 7, s_name FROM supplier),
t AS (SELECT node, node AS root, CAST(0 AS BIGINT) AS level, [{'ord': ord, 'node': node}] AS path, title AS trail FROM n WHERE parent IS NULL
  UNION ALL SELECT n.node, t.root, t.level + 1, list_append(t.path, {'ord': n.ord, 'node': n.node}), t.trail || ' > ' || n.title FROM n JOIN t ON n.parent = t.node)"""


@query(f"WITH RECURSIVE {_TREE} SELECT node, root, level, trail, row_number() OVER (ORDER BY path) AS pos FROM t")
def nav_dfs(spark: SparkSession, d: str) -> DataFrame:
    """ARR-07, ARR-16, NAV-09: the tree in depth-first order with breadcrumbs; positions by roots, then within them."""
    from pyspark.sql import Window

    t = N.tree(_nodes(spark, d))
    size = t.groupBy("root").agg(F.count("*").alias("size"))
    first = size.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("root").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each root
    pos = F.row_number().over(Window.partitionBy("root").orderBy("sort_path"))
    placed = t.withColumn("pos", pos).join(F.broadcast(first.select("root", "before")), "root")
    return placed.select("node", "root", F.col("level").cast("long").alias("level"), F.array_join("trail", " > ").alias("trail"), (F.col("pos") + F.col("before")).cast("long").alias("pos"))


@query(f"WITH RECURSIVE {_TREE} SELECT node, root, lag(node) OVER w AS previous, lead(node) OVER w AS next FROM t WINDOW w AS (PARTITION BY root ORDER BY path)")
def adjacent_pages(spark: SparkSession, d: str) -> DataFrame:
    """WIN-02: previous and next pages."""
    return N.neighbours(N.tree(_nodes(spark, d)))


@query(f"WITH RECURSIVE {_TREE} SELECT root, coalesce(arg_min(node, path) FILTER (WHERE level > 0), root) AS first FROM t GROUP BY root")
def header_tabs(spark: SparkSession, d: str) -> DataFrame:
    """NAV-08: the first page of each root group."""
    return N.tabs(N.tree(_nodes(spark, d)))


@query(f"WITH RECURSIVE {_TREE} SELECT node, level FROM t WHERE len(list_filter(path, lambda x: x.node = 103)) > 0")
def sidebar(spark: SparkSession, d: str) -> DataFrame:
    """NAV-07, SET-07: pages below a group."""
    return N.below(N.tree(_nodes(spark, d)), 103).select("node", F.col("level").cast("long").alias("level"))


_LOC = "(SELECT doc_id AS page_id, lang AS locale, CAST(doc_id // 4 AS VARCHAR) AS logical_path FROM documents QUALIFY row_number() OVER (PARTITION BY lang, doc_id // 4 ORDER BY doc_id) = 1)"


def _locales(spark: SparkSession, d: str) -> DataFrame:
    p = V.read(spark, d, "documents").select("doc_id", F.col("lang").alias("locale"), F.floor(F.col("doc_id") / 4).cast("string").alias("logical_path"))
    return p.groupBy("locale", "logical_path").agg(F.min("doc_id").alias("page_id"))


@query(f"""WITH p AS {_LOC}, e AS (SELECT DISTINCT logical_path, unnest(['en', 'fr', 'de']) AS locale FROM p), b AS (SELECT e.*, o.page_id AS own, d.page_id AS base FROM e LEFT JOIN p o USING (logical_path, locale) LEFT JOIN p d ON d.logical_path = e.logical_path AND d.locale = 'en')
SELECT logical_path, locale, CASE WHEN own IS NULL THEN 'en' ELSE locale END AS source_locale, own IS NULL AS is_fallback, coalesce(own, base) AS page_id FROM b WHERE coalesce(own, base) IS NOT NULL""")
def locale_fallback(spark: SparkSession, d: str) -> DataFrame:
    """JOI-07, JOI-08: pages in every locale, or the default's."""
    return N.localised(_locales(spark, d), "en", ["en", "fr", "de"])


@query(f"WITH p AS {_LOC} SELECT a.page_id, b.locale, b.page_id AS alternate FROM p a JOIN p b USING (logical_path) WHERE a.page_id <> b.page_id")
def locale_alternates(spark: SparkSession, d: str) -> DataFrame:
    """JOI-27: the same page in other locales."""
    return N.alternates(_locales(spark, d))


@query(f"SELECT grp, page_id, row_number() OVER (PARTITION BY grp ORDER BY ord NULLS LAST, relative_path) AS pos FROM {V.PAGES} p")
def nav_order(spark: SparkSession, d: str) -> DataFrame:
    """SOR-01, SOR-02, SOR-05: pages of groups in navigation order."""
    p = V.pages(spark, d).withColumn("path", F.col("relative_path"))
    return p.select("grp", "page_id", F.row_number().over(N.in_order("grp")).cast("long").alias("pos"))


# ---- feeds, sitemaps, negotiation ----


def _feed(spark: SparkSession, d: str) -> DataFrame:
    o = V.read(spark, d, "orders")
    return o.select(F.col("o_orderpriority").alias("feed_id"), F.col("o_orderdate").cast("timestamp").alias("published_at"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("url"), (F.col("o_orderstatus") == "P").alias("draft"), F.col("o_orderkey"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.lit(None).cast("timestamp").alias("updated_at"))


@query("SELECT o_orderpriority AS feed_id, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, lpad(CAST(o_orderkey AS VARCHAR), 10, '0')) AS rank FROM orders WHERE o_orderstatus <> 'P' QUALIFY rank <= 20")
def feed_topk(spark: SparkSession, d: str) -> DataFrame:
    """SOR-03, FIL-04: the newest entries of each feed."""
    return N.newest(_feed(spark, d)).select("feed_id", "o_orderkey", F.col("rank").cast("long").alias("rank"))


_RANKED = "(SELECT o_orderpriority AS feed_id, o_orderdate, o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS url, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, lpad(CAST(o_orderkey AS VARCHAR), 10, '0')) AS rank FROM orders WHERE o_orderstatus <> 'P' QUALIFY rank <= 20)"


@query(f"SELECT feed_id, '<rss version=\"2.0\"><channel><title>' || feed_id || '</title>' || string_agg('<item><title>Order ' || o_orderkey || '</title><link>' || url || '</link><guid>' || url || '</guid><pubDate>' || strftime(CAST(o_orderdate AS TIMESTAMP), '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate></item>', '' ORDER BY rank) || '</channel></rss>' AS xml FROM {_RANKED} r GROUP BY feed_id")
def rss(spark: SparkSession, d: str) -> DataFrame:
    """FEE-01, SNK-09: RSS documents."""
    return N.rss(N.newest(_feed(spark, d)))


@query(f"SELECT feed_id, strftime(CAST(max(o_orderdate) AS TIMESTAMP), '%Y-%m-%d') AS updated, count(*) AS entries FROM {_RANKED} r GROUP BY feed_id")
def atom(spark: SparkSession, d: str) -> DataFrame:
    """FEE-02: Atom feeds are as new as their newest entry."""
    a = N.atom(N.newest(_feed(spark, d)))
    return a.select("feed_id", F.date_format("updated", "yyyy-MM-dd").alias("updated"), F.size(F.regexp_extract_all("xml", F.lit("<entry>"), F.lit(0))).cast("long").alias("entries"))


@query("SELECT count(*) AS urls, CAST(sum(length(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')) + 22) AS BIGINT) AS chars FROM pages")
def sitemap(spark: SparkSession, d: str) -> DataFrame:
    """NAV-16: sitemaps hold every URL once."""
    p = V.read(spark, d, "pages").select(T.bare_url("url").alias("absolute_url"), F.lit(None).cast("timestamp").alias("last_modified"))
    s = N.sitemap(p, 100)
    return s.agg(F.sum("n").alias("urls"), F.sum(F.length("xml") - 17).cast("long").alias("chars"))


@query("SELECT e.event_id AS request_id, CASE WHEN p.doc_id IS NOT NULL THEN 200 WHEN g.doc_id IS NOT NULL THEN 308 ELSE 404 END AS status, CASE WHEN p.doc_id IS NOT NULL THEN '/docs/' || (user_id % 500) || CASE WHEN e.event_id % 3 = 1 THEN '.md' ELSE '' END WHEN g.doc_id IS NOT NULL THEN '/docs/0' END AS target FROM events e LEFT JOIN documents p ON p.doc_id = user_id % 500 AND p.doc_id % 5 <> 0 LEFT JOIN documents g ON g.doc_id = user_id % 500 AND g.doc_id % 5 = 0 AND g.doc_id % 10 <> 0")
def negotiation(spark: SparkSession, d: str) -> DataFrame:
    """NAV-19, STR-34, STR-35: how requests for pages are answered."""
    url = F.concat(F.lit("/docs/"), F.col("doc_id").cast("string"))
    docs = V.read(spark, d, "documents").select("doc_id", url.alias("url_path"))
    moved = docs.where("doc_id % 5 = 0 and doc_id % 10 <> 0").select(F.col("url_path").alias("from"), F.lit("/docs/0").alias("to"), F.lit(308).alias("status"))
    accept = F.when(F.col("event_id") % 3 == 1, "text/markdown").otherwise("text/html,*/*")
    asked = V.read(spark, d, "events").select(F.col("event_id").alias("request_id"), F.concat(F.lit("/docs/"), (F.col("user_id") % 500).cast("string"), F.lit("/")).alias("path"), accept.alias("accept"), F.lit("Mozilla/5.0").alias("user_agent"))
    return N.negotiate(asked, docs.where("doc_id % 5 <> 0"), moved)


# ---- snapshots ----

_SNAP = """b AS (SELECT '/d/' || doc_id AS path, left(sha256(trim(text)), 16) AS hash FROM documents WHERE doc_id % 10 <> 0),
n AS (SELECT CASE WHEN doc_id % 17 = 0 THEN '/n/' || doc_id ELSE '/d/' || doc_id END AS path, left(sha256(trim(text)), 16) AS hash FROM documents WHERE doc_id % 23 <> 0),
lf AS (SELECT * FROM b WHERE path NOT IN (SELECT path FROM n)), cm AS (SELECT * FROM n WHERE path NOT IN (SELECT path FROM b)),
mv AS (SELECT x.path AS "from", y.path AS "to" FROM (SELECT hash, min(path) AS path FROM lf GROUP BY hash HAVING count(*) = 1) x JOIN (SELECT hash, min(path) AS path FROM cm GROUP BY hash HAVING count(*) = 1) y USING (hash))"""


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = V.read(spark, d, "documents").select("doc_id", T.content_hash("text").alias("hash"))
    path = F.concat(F.when(F.col("doc_id") % 17 == 0, F.lit("/n/")).otherwise(F.lit("/d/")), F.col("doc_id").cast("string"))
    before = docs.where("doc_id % 10 <> 0").select(F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("path"), "hash")
    return before, docs.where("doc_id % 23 <> 0").select(path.alias("path"), "hash")


@query(f"WITH {_SNAP} SELECT * FROM mv")
def redirect_moves(spark: SparkSession, d: str) -> DataFrame:
    """JOI-15: unambiguous moves."""
    return Z.moves(*_snapshots(spark, d))


@query("WITH RECURSIVE t AS (SELECT ps AS f, min(nx) AS t FROM (SELECT n_nationkey AS ps, n_nationkey // 2 AS nx FROM nation WHERE n_nationkey % 6 <> 1) GROUP BY ps), c AS (SELECT f, f AS cur, 0 AS k FROM t UNION ALL SELECT c.f, t.t, k + 1 FROM c JOIN t ON t.f = c.cur WHERE k < 20 AND c.f <> 0) SELECT CAST(f AS VARCHAR) AS \"from\", CASE WHEN max(k) >= 20 OR f = 0 THEN NULL ELSE CAST(arg_max(cur, k) AS VARCHAR) END AS \"to\" FROM c GROUP BY f")
def redirect_chain(spark: SparkSession, d: str) -> DataFrame:
    """JOI-16: chains followed to their ends; loops have none."""
    t = V.read(spark, d, "nation").where("n_nationkey % 6 <> 1").select(F.col("n_nationkey").cast("string").alias("from"), F.floor(F.col("n_nationkey") / 2).cast("string").alias("to"))
    return Z.resolve_chains(t, t)


@query(f"""WITH {_SNAP}, cl AS (SELECT '/old/' || doc_id AS "from", '/d/' || doc_id AS "to" FROM documents WHERE doc_id % 29 = 1 AND doc_id % 17 <> 0 AND doc_id % 23 <> 0),
tg AS (SELECT * FROM cl UNION ALL SELECT * FROM mv WHERE "from" NOT IN (SELECT "from" FROM cl)),
gone AS (SELECT DISTINCT path FROM lf WHERE path NOT IN (SELECT "from" FROM tg) AND length(hash) > 0 AND hash < '8'),
hs AS (SELECT '/h/' || doc_id AS "from", '/d/' || doc_id AS "to" FROM documents WHERE doc_id % 7 = 3)
SELECT "from", "to", 308 AS status FROM tg UNION ALL SELECT path, NULL, 410 FROM gone
UNION ALL SELECT "from", CASE WHEN t2 IN (SELECT path FROM gone) THEN NULL ELSE t2 END, CASE WHEN t2 IN (SELECT path FROM gone) THEN 410 ELSE 308 END FROM (SELECT hs."from", coalesce(tg."to", hs."to") AS t2 FROM hs LEFT JOIN tg ON tg."from" = hs."to")""")
def redirect_full(spark: SparkSession, d: str) -> DataFrame:
    """RED-01: moves, claims, removals and history in one."""
    before, now = _snapshots(spark, d)
    docs = V.read(spark, d, "documents")
    at = lambda prefix: F.concat(F.lit(prefix), F.col("doc_id").cast("string"))
    claims = docs.where("doc_id % 29 = 1 and doc_id % 17 <> 0 and doc_id % 23 <> 0").select(at("/old/").alias("from"), at("/d/").alias("to"))
    removed = before.where("hash < '8'").join(now.select("path"), "path", "left_anti").select("path")
    history = docs.where("doc_id % 7 = 3").select(at("/h/").alias("from"), at("/d/").alias("to"))
    return Z.redirects(before, now, claims, removed, history)


@query(f"WITH {_SNAP} SELECT path FROM b WHERE path NOT IN (SELECT path FROM n)")
def prune_orphans(spark: SparkSession, d: str) -> DataFrame:
    """SNK-16, SNK-19, SNK-20, SET-02: outputs that nothing makes any more."""
    before, now = _snapshots(spark, d)
    return Z.orphans(now, before)


@query("SELECT doc_id, doc_id % 10 <> 0 AND doc_id % 11 <> 0 AND NOT (doc_id % 4 = 0 AND (doc_id // 4) % 11 = 0) AS reuse FROM documents")
def cache_reuse(spark: SparkSession, d: str) -> DataFrame:
    """JOI-20, JOI-21, MDX-28: outputs that can be used again."""
    docs = V.read(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), T.content_hash("text").alias("hash"))
    now = docs.withColumn("hash", F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("new"), F.col("hash"))).otherwise(F.col("hash")))
    dep = docs.select((F.col("doc_id") * 4).alias("doc_id"), F.col("path").alias("dep"), F.col("hash").alias("was"))
    cache = docs.where("doc_id % 10 <> 0").join(dep, "doc_id", "left").select("path", F.col("hash").alias("source_hash"), F.when(F.col("dep").isNotNull(), F.create_map("dep", "was")).otherwise(F.create_map().cast("map<string,string>")).alias("deps"))
    return Z.reusable(cache, now).select(F.col("path").cast("long").alias("doc_id"), "reuse")


@query("""WITH c AS (SELECT l_suppkey AS path, CAST(l_shipdate AS TIMESTAMP) AS ts, l_returnflag || l_linestatus || CASE WHEN l_returnflag = 'R' THEN '-bot' ELSE '' END AS author, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC) AS r FROM lineitem)
SELECT path, strftime(max(ts), '%Y-%m-%d') AS last_modified, arg_min(author, r) FILTER (WHERE author NOT LIKE '%-bot') AS last_author FROM c WHERE r <= 50 GROUP BY path""")
def git_latest(spark: SparkSession, d: str) -> DataFrame:
    """WIN-01, JOI-19, STR-41: newest changes and human authors."""
    author = F.concat("l_returnflag", "l_linestatus", F.when(F.col("l_returnflag") == "R", F.lit("-bot")).otherwise(F.lit("")))
    c = V.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("path"), F.col("l_shipdate").cast("timestamp").alias("ts"), author.alias("author"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return Z.last_changes(c).select("path", F.date_format("last_modified", "yyyy-MM-dd").alias("last_modified"), "last_author")


# ---- lint, score ----


def _lint_links(spark: SparkSession, d: str) -> DataFrame:
    docs = V.read(spark, d, "documents").select("doc_id", "lang")
    url = (
        F.when(F.col("doc_id") % 8 == 0, F.lit("/docs/{framework}/x")).when(F.col("doc_id") % 8 == 1, F.lit("../../../../x"))
        .when(F.col("doc_id") % 8 == 2, F.concat(F.lit("/docs/en/"), (F.col("doc_id") + 5).cast("string"), F.lit("/"))).when(F.col("doc_id") % 8 == 3, F.concat(F.lit("./"), (F.col("doc_id") + 1).cast("string"), F.lit("#top")))
        .when(F.col("doc_id") % 8 == 4, F.lit("./pic.png")).when(F.col("doc_id") % 8 == 5, F.lit("https://example.com/a")).when(F.col("doc_id") % 8 == 6, F.lit("#none")).otherwise(F.lit("/docs/frameworks/vue/a"))
    )
    path = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"))
    links = docs.select(path.alias("file"), F.concat(path, F.lit(".md")).alias("source_path"), F.when(F.col("doc_id") % 8 == 7, F.lit("/docs/frameworks/react/z")).otherwise(F.concat(F.lit("/docs/"), path)).alias("current_route"), F.lit(None).cast("string").alias("field"), url.alias("url"))
    routes = docs.select(F.concat(F.lit("/docs/"), path).alias("route"))
    anchors = docs.where("doc_id % 2 = 0").select(F.concat(F.lit("/docs/"), path).alias("route"), F.lit("top").alias("anchor"))
    moved = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("/docs/en/"), F.col("doc_id").cast("string")).alias("from"), F.lit("/docs/en/0").alias("to"))
    return C.link_violations(links, routes, anchors, moved, ["/docs"])


_LINT = """r AS (SELECT '/docs/' || lang || '/' || doc_id AS route, doc_id FROM documents),
v AS (SELECT lang || '/' || doc_id AS file, CASE doc_id % 8 WHEN 0 THEN 'unresolved-placeholder' WHEN 1 THEN 'invalid-link' WHEN 2 THEN CASE WHEN '/docs/en/' || (doc_id + 5) NOT IN (SELECT route FROM r) THEN 'invalid-link' END
  WHEN 3 THEN CASE WHEN '/docs/' || lang || '/' || (doc_id + 1) NOT IN (SELECT route FROM r) THEN 'invalid-link' END WHEN 6 THEN 'invalid-anchor' WHEN 7 THEN 'cross-framework-link' END AS rule,
  CASE WHEN doc_id % 8 = 2 AND (doc_id + 5) % 3 = 0 AND doc_id + 5 IN (SELECT doc_id FROM documents) THEN true WHEN doc_id % 8 = 3 AND lang = 'en' AND (doc_id + 1) % 3 = 0 AND doc_id + 1 IN (SELECT doc_id FROM documents) THEN true ELSE false END AS hinted FROM documents)"""


@query(f"WITH {_LINT} SELECT file, rule, hinted FROM v WHERE rule IS NOT NULL")
def lint_links(spark: SparkSession, d: str) -> DataFrame:
    """LNT-03, JOI-12 to JOI-14: the first rule that applies to each link."""
    return _lint_links(spark, d).select("file", "rule", F.contains("message", F.lit(" moved to ")).alias("hinted"))


@query(f"WITH {_LINT}, o AS (SELECT file, rule, CASE rule WHEN 'invalid-anchor' THEN 'warn' WHEN 'cross-framework-link' THEN 'off' ELSE 'error' END AS severity FROM v WHERE rule IS NOT NULL) SELECT (SELECT count(*) FROM documents) AS files, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warn') AS warnings, count(*) FILTER (WHERE severity = 'error') > 0 AS failed FROM o")
def lint_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG-05, AGG-06: findings after overrides, in sum."""
    rules = spark.createDataFrame([("invalid-anchor", "warn"), ("cross-framework-link", "off")], "rule string, to string")
    files = V.read(spark, d, "documents").select(F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("file"))
    return C.summary(C.override(_lint_links(spark, d), rules), files)


@query("SELECT CAST(c_custkey AS VARCHAR) AS file, 'c_mktsegment' AS field FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'c_phone' FROM customer WHERE c_custkey % 9 = 0")
def lint_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    """LNT-02, LNT-17: fields that are missing, and values that aren't allowed."""
    p = V.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("file"), F.when(F.col("c_custkey") % 9 != 0, F.lit("x")).alias("c_phone"), "c_mktsegment")
    return C.frontmatter_violations(p, ["c_phone"], {"c_mktsegment": ["BUILDING", "MACHINERY"]}).select("file", "field")


@query("SELECT dimension, CAST(points AS BIGINT) AS points, CAST(most AS BIGINT) AS most, CAST(floor(100 * points / most + 0.5) AS BIGINT) AS score FROM (SELECT coalesce(l_returnflag, 'total') AS dimension, sum(l_linenumber) AS points, sum(7) AS most FROM lineitem GROUP BY ROLLUP (l_returnflag))")
def readiness_score(spark: SparkSession, d: str) -> DataFrame:
    """AGG-07, AGG-08, SCO-01: points by dimension, and in all."""
    s = V.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("dimension"), F.col("l_linenumber").cast("long").alias("points"), F.lit(7).alias("max"))
    return C.readiness(s)


@query(f"SELECT round(avg(CASE WHEN trim(description) <> '' THEN 1.0 ELSE 0.0 END), 6) AS described, bool_and(trim(title) <> '' AND trim(description) <> '') AS complete FROM {V.PAGES} p")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """AGG-09: pages with descriptions."""
    return C.coverage(V.pages(spark, d).withColumn("last_modified", F.lit("2024-01-01"))).withColumn("described", F.round("described", 6))


@query("SELECT event_id, CASE WHEN s BETWEEN 200 AND 399 THEN 'ok' WHEN s IN (401, 403, 429, 999) THEN 'gated' WHEN s IN (404, 410) THEN 'dead' ELSE 'unknown' END AS verdict FROM (SELECT event_id, [200, 301, 401, 404, 410, 429, 500, 999][1 + event_id % 8] AS s FROM events)")
def link_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """LNT-14: what statuses say of external links."""
    status = F.element_at(F.array(*map(F.lit, (200, 301, 401, 404, 410, 429, 500, 999))), (1 + F.col("event_id") % 8).cast("int"))
    return V.read(spark, d, "events").select("event_id", L.verdict(status).alias("verdict"))


@query("WITH c AS (SELECT user_id AS url, arg_max(event_type, ts) AS verdict FROM events WHERE ts > (SELECT CAST('2024-01-08' AS TIMESTAMP)) - INTERVAL 7 DAY GROUP BY 1) SELECT DISTINCT e.user_id AS url, verdict FROM events e LEFT JOIN c ON c.url = e.user_id")
def ttl_cache(spark: SparkSession, d: str) -> DataFrame:
    """LNT-13, SET-03: verdicts that are still fresh."""
    e = V.read(spark, d, "events")
    return L.fresh(e.select(F.col("user_id").alias("url"), F.col("event_type").alias("verdict"), F.col("ts").alias("checked_at")), e.select(F.col("user_id").alias("url")), "2024-01-08")


# ---- experiments ----

_RUNS = "r AS (SELECT source AS fixture, lang AS model, CASE doc_id % 4 WHEN 0 THEN 'bare' WHEN 1 THEN 'control' WHEN 2 THEN 'treatment' ELSE 'pointer' END AS mode, quality = 1 AS passed, CASE WHEN toxic = 1 THEN 'confident_wrong' ELSE 'none' END AS failure_mode, n_chars AS tokens FROM labels JOIN documents USING (doc_id))"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    both = V.read(spark, d, "labels").join(V.read(spark, d, "documents"), "doc_id")
    mode = F.element_at(F.array(*map(F.lit, ("bare", "control", "treatment", "pointer"))), (1 + F.col("doc_id") % 4).cast("int"))
    return both.select(F.col("source").alias("fixture"), F.col("lang").alias("model"), mode.alias("mode"), (F.col("quality") == 1).alias("passed"), F.when(F.col("toxic") == 1, "confident_wrong").otherwise("none").alias("failure_mode"), F.col("n_chars").alias("tokens"))


@query(f"""WITH {_RUNS}, g AS (SELECT model, mode, count(*) AS n, count(*) FILTER (WHERE passed) AS passes, count(*) FILTER (WHERE failure_mode = 'confident_wrong') AS wrong FROM r GROUP BY ALL), p AS (SELECT *, passes / n AS rate FROM g)
SELECT model, mode, n, passes, round(rate, 6) AS rate, round(greatest(0, (rate + 3.8416 / (2 * n) - 1.96 * sqrt((rate * (1 - rate) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)), 6) AS low,
round(least(1, (rate + 3.8416 / (2 * n) + 1.96 * sqrt((rate * (1 - rate) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)), 6) AS high, round(wrong / n, 6) AS confident_wrong FROM p""")
def pass_rate_wilson(spark: SparkSession, d: str) -> DataFrame:
    """AGG-10, AGG-11, AGG-13: pass rates with intervals."""
    r = X.rates(_runs(spark, d), "model", "mode")
    return r.select("model", "mode", "n", "passes", *(F.round(c, 6).alias(c) for c in ("rate", "low", "high", "confident_wrong")))


@query(f"WITH {_RUNS} SELECT fixture, model, mode, count(*) AS n, count(*) FILTER (WHERE passed) AS passes, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS rate FROM r GROUP BY GROUPING SETS ((fixture, model, mode), (model, mode), (fixture, mode))")
def experiment_cells(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13: cells and pooled cells."""
    return X.cells(_runs(spark, d)).withColumn("rate", F.round("rate", 6))


@query(f"WITH {_RUNS}, c AS (SELECT fixture, model, mode, avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) AS rate FROM r GROUP BY ALL) SELECT a.fixture, a.model, a.mode AS arm, round(a.rate, 6) AS arm_rate, round(b.rate, 6) AS control_rate, round(a.rate - b.rate, 6) AS delta FROM c a JOIN c b ON a.fixture = b.fixture AND a.model = b.model AND b.mode = 'control' WHERE a.mode <> 'control'")
def arm_delta(spark: SparkSession, d: str) -> DataFrame:
    """JOI-28: arms against their controls."""
    x = X.deltas(_runs(spark, d))
    return x.select("fixture", "model", "arm", *(F.round(c, 6).alias(c) for c in ("arm_rate", "control_rate", "delta")))


@query(f"WITH {_RUNS} SELECT model, " + ", ".join(f"round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) FILTER (WHERE mode = '{m}'), 6) AS {m}" for m in ("bare", "control", "treatment", "pointer")) + " FROM r GROUP BY model")
def arm_pivot(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13: a model's arms side by side."""
    modes = ["bare", "control", "treatment", "pointer"]
    return X.arms(_runs(spark, d), modes).select("model", *(F.round(m, 6).alias(m) for m in modes))


@query(f"WITH {_RUNS}, c AS (SELECT model, mode, avg(tokens) AS tokens FROM r GROUP BY ALL) SELECT a.model, a.mode AS arm, round(a.tokens, 4) AS tokens, round(b.tokens, 4) AS control_tokens, round((a.tokens - b.tokens) / b.tokens, 6) AS change FROM c a JOIN c b ON a.model = b.model AND b.mode = 'control' WHERE a.mode <> 'control'")
def efficiency_delta(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12, AGG-13: mean tokens against the control's."""
    x = X.efficiency(_runs(spark, d))
    return x.select("model", "arm", F.round("tokens", 4).alias("tokens"), F.round("control_tokens", 4).alias("control_tokens"), F.round("change", 6).alias("change"))


@query("SELECT event_type, list_sort(list(value))[CAST(least(floor(count(*) * 0.95), count(*) - 1) AS BIGINT) + 1] AS value FROM events GROUP BY event_type")
def floor_percentile(spark: SparkSession, d: str) -> DataFrame:
    """AGG-14: percentiles by floor index."""
    return X.floor_percentile(V.read(spark, d, "events").select("event_type", "value"), 0.95, "event_type")


@query("SELECT event_type, round(median(value), 2) AS middle FROM events GROUP BY event_type")
def rounded_median(spark: SparkSession, d: str) -> DataFrame:
    """AGG-15: medians, rounded."""
    return V.read(spark, d, "events").groupBy("event_type").agg(F.round(F.median("value"), 2).alias("middle"))


#: Conversations as tool calls: some fail, paths come in several spellings, and runs have layouts in turn.
_PATHS = ("./llms.txt", "/llms-full.txt", "docs/authoring/llms.txt", "docs\\llms-full\\build.txt", "docs/quickstart.md", "docs/llms-full/authoring.txt", "docs/authoring/a.md", "llms.txt")
_VARIANTS = ("page-links", "explicit-bundles", "monolith", "router", "section-indexes", "other")
_CALLS = f"""c AS (SELECT conv_id AS run_id, turn, CASE role WHEN 'system' THEN 'grep' ELSE 'read' END AS tool, [{", ".join(f"'{x}'" for x in _PATHS)}][1 + (conv_id + turn * 3) % 8] AS path,
  turn % 5 = 4 AS is_error, CASE WHEN turn % 7 = 6 THEN 'error: ENOENT' ELSE text END AS result FROM conversations),
g AS (SELECT run_id, regexp_replace(regexp_replace(replace(path, chr(92), '/'), '^\\./', ''), '^/+', '') AS path FROM c WHERE tool = 'read' AND NOT is_error AND NOT coalesce(starts_with(result, 'error:'), false)),
s AS (SELECT r.run_id, count(path) AS reads, coalesce(bool_or(path = 'llms.txt'), false) AS read_index, coalesce(bool_or(path = 'llms-full.txt'), false) AS read_full,
  coalesce(list(DISTINCT split_part(path, '/', 2)) FILTER (WHERE path LIKE 'docs/%/llms.txt'), []) AS sections, coalesce(list(DISTINCT path) FILTER (WHERE path LIKE 'docs/%.md'), []) AS pages,
  coalesce(list(DISTINCT replace(split_part(path, '/', 3), '.txt', '')) FILTER (WHERE path LIKE 'docs/llms-full/%.txt'), []) AS groups
  FROM (SELECT DISTINCT run_id FROM c) r LEFT JOIN g USING (run_id) GROUP BY r.run_id)"""


def _calls(spark: SparkSession, d: str) -> DataFrame:
    path = F.get(F.array(*(F.lit(x) for x in _PATHS)), ((F.col("conv_id") + F.col("turn") * 3) % 8).cast("int"))
    c = V.read(spark, d, "conversations")
    return c.select(
        F.col("conv_id").alias("run_id"), F.when(F.col("role") == "system", "grep").otherwise("read").alias("tool"), path.alias("path"),
        (F.col("turn") % 5 == 4).alias("is_error"), F.when(F.col("turn") % 7 == 6, "error: ENOENT").otherwise(F.col("text")).alias("result"),
    )


@query(f"WITH {_CALLS} SELECT run_id, reads, read_index, read_full, array_to_string(list_sort(sections), ',') AS sections, array_to_string(list_sort(pages), ',') AS pages, array_to_string(list_sort(groups), ',') AS groups FROM s")
def read_summary(spark: SparkSession, d: str) -> DataFrame:
    """FIL-08, AGG-17, AGG-18: what runs have read."""
    r = X.read_summary(_calls(spark, d))
    return r.select("run_id", "reads", "read_index", "read_full", *(F.array_join(c, ",").alias(c) for c in ("sections", "pages", "groups")))


@query(f"""WITH {_CALLS}, e AS (SELECT *, [{", ".join(f"'{v}'" for v in _VARIANTS)}][1 + run_id % 6] AS variant, CASE WHEN run_id % 4 = 0 THEN ['authoring'] ELSE [] END AS eg, CASE run_id % 3 WHEN 0 THEN ['docs/quickstart.md'] WHEN 1 THEN ['docs/authoring/a.md'] ELSE [] END AS ep FROM s),
m AS (SELECT *, len(list_filter(eg, lambda x: NOT list_contains(groups, x))) = 0 AS g_ok, len(list_filter(eg, lambda x: NOT list_contains(sections, x))) = 0 AS s_ok, len(list_filter(ep, lambda x: NOT list_contains(pages, x))) = 0 AS p_ok,
  len(list_filter(ep, lambda x: NOT list_contains(pages, x) AND NOT (starts_with(x, 'docs/authoring/') AND list_contains(groups, 'authoring')))) = 0 AS b_ok, len(list_filter(groups, lambda x: NOT list_contains(eg, x))) AS wrong FROM e)
SELECT run_id, wrong, read_index AND wrong = 0 AND CASE variant WHEN 'page-links' THEN p_ok WHEN 'explicit-bundles' THEN g_ok WHEN 'monolith' THEN read_full WHEN 'router' THEN read_full AND g_ok WHEN 'section-indexes' THEN s_ok AND b_ok ELSE false END AS matched FROM m""")
def context_match(spark: SparkSession, d: str) -> DataFrame:
    """AGG-19: whether runs have read what their layouts ask for."""
    reads, none = X.read_summary(_calls(spark, d)), F.array().cast("array<string>")
    run = F.col("run_id")
    expected = reads.select(
        "run_id", F.get(F.array(*map(F.lit, _VARIANTS)), (run % 6).cast("int")).alias("variant"), F.when(run % 4 == 0, F.array(F.lit("authoring"))).otherwise(none).alias("expected_groups"),
        F.when(run % 3 == 0, F.array(F.lit("docs/quickstart.md"))).when(run % 3 == 1, F.array(F.lit("docs/authoring/a.md"))).otherwise(none).alias("expected_pages"),
    )
    return X.context_matched(reads, expected).select("run_id", F.size("wrong_groups").cast("long").alias("wrong"), "matched")


# ---- artifacts, MDX, OpenAPI, stateful ----


@query(f"SELECT grp, '## ' || grp || chr(10) || chr(10) || string_agg('- [' || title || '](' || url || ')' || CASE WHEN description <> '' THEN ': ' || description ELSE '' END, chr(10) ORDER BY ord NULLS FIRST, page_id) AS body FROM {V.PAGES} p GROUP BY grp")
def llms_txt(spark: SparkSession, d: str) -> DataFrame:
    """SNK-04, NAV-12, NAV-13: each group's section of llms.txt."""
    return A.llms_txt(V.pages(spark, d), "Docs", "All pages").select("grp", "body")


@query(f"SELECT page_id, md5('# ' || title || chr(10) || chr(10) || 'URL: ' || url || chr(10) || chr(10) || trim(content)) AS digest FROM {V.PAGES} p")
def llms_full(spark: SparkSession, d: str) -> DataFrame:
    """SNK-05, NAV-14: the full context by page."""
    return A.llms_full(V.pages(spark, d)).select("page_id", F.md5(F.col("body").cast("binary")).alias("digest"))


@query(f"SELECT page_id, url AS url_path, url || '.md' AS mirror, grp AS first_group FROM {V.PAGES} p")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    """SNK-06, NAV-15: manifest entries, read back from their JSON."""
    m = A.manifest(V.pages(spark, d))
    return m.select("page_id", *(F.get_json_object("json", p).alias(n) for n, p in (("url_path", "$.urlPath"), ("mirror", "$.markdownUrlPath"), ("first_group", "$.groups[0]"))))


@query(f"SELECT page_id, 'TechArticle' AS kind, 'https://example.com' || url AS url FROM {V.PAGES} p")
def jsonl_feed(spark: SparkSession, d: str) -> DataFrame:
    """SNK-11, ARR-17: schema.org lines, read back."""
    j = A.json_ld(V.pages(spark, d), "https://example.com")
    return j.select("page_id", F.get_json_object("json", "$['@type']").alias("kind"), F.get_json_object("json", "$.url").alias("url"))


@query(f"SELECT count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS chars FROM (SELECT content FROM {V.PAGES} p UNION ALL SELECT string_agg(title, chr(10) ORDER BY page_id) FROM {V.PAGES} p GROUP BY grp)")
def virtual_files(spark: SparkSession, d: str) -> DataFrame:
    """SEA-27: the corpus as files."""
    return A.virtual_files(V.pages(spark, d)).agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("chars"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '> 💡 **Tip:** **N' || doc_id || '**' || chr(10) || '> Body ' || doc_id WHEN 1 THEN '> ⚠️ **Warning:**' || chr(10) || '> Body ' || doc_id
  WHEN 2 THEN '| Package manager | Command |' || chr(10) || '| :--- | :--- |' || chr(10) || '| npm | `npx p' || doc_id || '` |' || chr(10) || '| pnpm | `pnpm dlx p' || doc_id || '` |' || chr(10) || '| yarn | `yarn dlx p' || doc_id || '` |' || chr(10) || '| bun | `bunx p' || doc_id || '` |'
  ELSE '### About ' || doc_id || chr(10) || chr(10) || 'Body ' || doc_id END || chr(10) || chr(10) || '- [Next](/docs/' || (doc_id + 1) || '): More' || chr(10) AS markdown FROM documents""")
def flatten_components(spark: SparkSession, d: str) -> DataFrame:
    """MDX-01 to MDX-03, MDX-07, MDX-10, MDX-13 to MDX-15: components as Markdown."""
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    tip = F.concat(F.lit('<Callout variant="tip" title={"N'), i, F.lit('"}>\nBody  '), i, F.lit("\n</Callout>"))
    first = (
        F.when(k == 0, tip).when(k == 1, F.concat(F.lit('<Callout type="warn">Body '), i, F.lit("</Callout>"))).when(k == 2, F.concat(F.lit('<CommandTabs command="p'), i, F.lit('" />')))
        .otherwise(F.concat(F.lit("<details>\n<summary>About "), i, F.lit("</summary>\n\nBody "), i, F.lit("\n</details>")))
    )
    source = F.concat(F.lit('import { X } from "x"\n\n'), first, F.lit('\n\n<Cards>\n<Card title="Next" href="/docs/'), (F.col("doc_id") + 1).cast("string"), F.lit('">\nMore\n</Card>\n</Cards>\n'))
    done = mdx.convert(V.read(spark, d, "documents").select(i.alias("path"), source.alias("source")))
    return done.select(F.col("path").cast("long").alias("doc_id"), "markdown")


_LINKS = "'- [' || title || '](' || {url} || ')' || CASE WHEN description <> '' THEN ': ' || description ELSE '' END"
_PARTED = f"(SELECT *, CASE WHEN page_id % 11 = 0 THEN 2 WHEN grp IN ('src1', 'src2') THEN {{third}} ELSE 1 END AS part FROM {V.PAGES} p)"


def _outline(head: list[str], url: str, third: int, note: str) -> str:
    """SQL of an outline's lines."""
    said = lambda x: "'" + x.replace("'", "''") + "'"
    heads = " UNION ALL ".join(f"SELECT 0, '', 0, {k}, NULL, {said(x)}" for k, x in enumerate(head))
    above = f"CASE part WHEN 1 THEN ['', '## ' || grp, ''] WHEN 2 THEN ['', '## Other', ''] ELSE ['', '## Optional', '', {said(note)}, ''] END"
    return f"""WITH p AS (SELECT part, CASE WHEN part = 1 THEN grp ELSE '' END AS grp, ord, page_id, {_LINKS.format(url=url)} AS line FROM {_PARTED.format(third=third)} q), t AS (SELECT DISTINCT part, grp FROM p)
SELECT part, grp, 2 AS at, ord, page_id, line FROM p UNION ALL SELECT part, grp, 1, unnest(generate_series(0, len({above}) - 1)), NULL, unnest({above}) FROM t UNION ALL {heads}"""


def _parted(spark: SparkSession, d: str) -> DataFrame:
    return V.pages(spark, d).withColumn("grp", F.when(F.col("page_id") % 11 != 0, F.col("grp")))


@query(_outline(["# Docs Documentation", "", "> Curated documentation map for developers and coding agents working with Docs.", "", "## How To Use This File", "", "Read the summary links first. If the page links are not enough, use `/llms-full.txt` as the broad full-context fallback."], "url", 3, "Lower-priority pages — safe to skip for a shorter context."))
def docs_map(spark: SparkSession, d: str) -> DataFrame:
    """SNK-04, NAV-13: the docs map's lines, with other and optional pages at its end."""
    return A.docs_map(_parted(spark, d), "Docs", ["src1", "src2"])


@query(_outline(["# Docs", "", "> All pages", "", "These docs ship inside the package so coding agents can read them offline. Open the topic file you need from the list below — paths are relative to this file.", "", "## Product Summary", "", "- One"], "'./docs/' || relative_path", 1, ""))
def agents_md(spark: SparkSession, d: str) -> DataFrame:
    """SNK-08: the lines of AGENTS.md."""
    return A.agents_md(_parted(spark, d), "Docs", "All pages", ["One"])


@query(_outline(["# Sitemap", "", "Structured documentation sitemap for Docs."], "url", 1, ""))
def sitemap_md(spark: SparkSession, d: str) -> DataFrame:
    """NAV-17: the lines of sitemap.md."""
    return A.sitemap_md(_parted(spark, d), "Docs")


@query("WITH n AS (SELECT count(*) AS n, count(DISTINCT source) AS g FROM documents) SELECT unnest(['/llms.txt', '/llms-full.txt', '/AGENTS.md', '/sitemap.md', '/docs/agent-readability.json', '/feeds/schema.jsonl']) AS path, unnest([n + 3 * g + 7, n, n + 3 * g + 5, n + 3 * g + 3, n, n]) AS n FROM n")
def all_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """SNK-07: the size of every artifact that pages give; the sitemap's files are compared elsewhere."""
    made = A.everything(V.pages(spark, d), "Docs", "All pages", "https://example.com")
    counts = [df.agg(F.lit(path).alias("path"), F.count("*").alias("n")) for path, df in made.items() if path != "/sitemap.xml"]
    return reduce(DataFrame.union, counts)


@query(f"""WITH l AS (SELECT '/docs/' || lang || '/' || (doc_id + 1) AS url, CASE WHEN doc_id % 3 = 0 THEN 'Own ' || doc_id END AS title, CASE WHEN doc_id % 5 = 0 THEN 'said' END AS description FROM documents),
j AS (SELECT l.url, coalesce(l.title, CASE WHEN lower(p.title) NOT IN ('home', 'index', 'readme') THEN p.title END, split_part(l.url, '/', 4)) AS title, l.description AS own, p.description AS theirs FROM l LEFT JOIN {V.PAGES} p ON p.url = l.url)
SELECT url, title, coalesce(nullif(own, ''), nullif({V.squeeze_sql('theirs')}, ''), 'Entry point for ' || title || ' documentation.') AS description FROM j""")
def curated_links(spark: SparkSession, d: str) -> DataFrame:
    """JOI-18: curated links with defaults by their pages."""
    docs = V.read(spark, d, "documents")
    links = docs.select(
        F.concat(F.lit("/docs/"), "lang", F.lit("/"), (F.col("doc_id") + 1).cast("string")).alias("url"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Own "), F.col("doc_id").cast("string"))).alias("title"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("said")).alias("description"),
    )
    return A.curated_links(links, V.pages(spark, d))


@query("""WITH f AS (SELECT c_custkey AS k, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '""' WHEN 2 THEN '7' ELSE '"T"' END AS title, CASE k % 3 WHEN 0 THEN '"new"' WHEN 1 THEN '"old"' END AS status, CASE k % 5 WHEN 0 THEN '["a", "b"]' WHEN 1 THEN '["a", 1]' WHEN 2 THEN '"a"' END AS tags, CASE k % 7 WHEN 0 THEN '1.5' WHEN 1 THEN '10' END AS ord, k % 6 = 0 AS extra FROM customer)
SELECT CAST(k AS VARCHAR) AS file, 'schema' AS rule, 'title' AS field, 'error' AS severity FROM f WHERE title IS NULL OR k % 4 IN (1, 2) UNION ALL SELECT CAST(k AS VARCHAR), 'schema', 'status', 'error' FROM f WHERE k % 3 = 1
UNION ALL SELECT CAST(k AS VARCHAR), 'schema', 'tags', 'error' FROM f WHERE k % 5 IN (1, 2) UNION ALL SELECT CAST(k AS VARCHAR), 'schema', 'order', 'error' FROM f WHERE k % 7 = 0 UNION ALL SELECT CAST(k AS VARCHAR), 'unknown-field', 'lastModified', 'warn' FROM f WHERE extra""")
def lint_schema(spark: SparkSession, d: str) -> DataFrame:
    """LNT-02, LNT-17: frontmatter against the default schema: missing, of another kind, unknown."""
    k = F.col("c_custkey")
    pick = lambda m, *said: F.get(F.array(*(F.lit(x).cast("string") for x in said)), (k % m).cast("int"))
    fields = {"title": pick(4, None, '""', "7", '"T"'), "status": pick(3, '"new"', '"old"', None), "tags": pick(5, '["a", "b"]', '["a", 1]', '"a"', None, None), "order": pick(7, "1.5", "10"), "lastModified": pick(6, '"x"')}
    files = V.read(spark, d, "customer").select(k.cast("string").alias("file"), F.map_filter(F.create_map(*(x for n, v in fields.items() for x in (F.lit(n), v))), lambda _, v: v.isNotNull()).alias("fields"))
    return M.schema_violations(files, M.PAGE).select("file", "rule", "field", "severity")


@query(f"""WITH {V.LINES}, s AS (SELECT page_id, pos, level, lag(level, 1, 1) OVER (PARTITION BY page_id ORDER BY pos) AS before FROM h)
SELECT page_id, 'geo:heading-skip' AS rule, CAST(pos AS VARCHAR) AS field FROM s WHERE level > before + 1 UNION ALL SELECT page_id, 'geo:code-language', CAST(pos AS VARCHAR) FROM l WHERE marker AND NOT fenced AND regexp_matches(trim(line), '^`{{3,}}\\s*$')""")
def lint_structure(spark: SparkSession, d: str) -> DataFrame:
    """LNT-06: skipped levels and fences without a language; images without text are in the tests."""
    m = V.markdown(spark, d).withColumn("file", F.col("page_id").cast("string"))
    return M.structure_findings(m).select(F.col("file").cast("long").alias("page_id"), "rule", "field")


@query("""WITH f AS (SELECT count(*) FILTER (WHERE trim(split_part(text, chr(10), 2)) <> '') / count(*) AS described FROM documents)
SELECT dimension, CAST(sum(points) AS BIGINT) AS points, CAST(sum(most) AS BIGINT) AS most FROM (SELECT 'identity' AS dimension, 2 + 0 + 0 + 2 + 1 + 2 + 0 + CAST(floor(described * 2 + 0.5) AS INT) + 0 AS points, 15 AS most FROM f UNION ALL SELECT 'integration', 2 + 0 + 1, 5) GROUP BY 1""")
def readiness_signals(spark: SparkSession, d: str) -> DataFrame:
    """AGG-08, SCO-01: the twelve signals of a corpus, in sum."""
    files = spark.createDataFrame([(x,) for x in ("llms.txt", "docs/search-index.json", "docs/agent-readability.json", "docs/a/b.md")], "path string")
    robots = spark.createDataFrame([("User-agent: *",)], "line string")
    findings = spark.createDataFrame([("geo:image-alt",)], "rule string")
    pages = V.pages(spark, d).withColumn("last_modified", F.lit(None).cast("string"))
    s = M.signals(files, pages, robots, findings)
    return s.groupBy("dimension").agg(F.sum("points").alias("points"), F.sum("max").alias("most"))


@query(r"""SELECT DISTINCT '/docs/' || lang || '/' || source || '/' || doc_id AS route FROM documents WHERE doc_id % 9 <> 0""")
def route_set(spark: SparkSession, d: str) -> DataFrame:
    """LNT-16: routes of a tree's pages; shared folders have none."""
    p = V.pages(spark, d).select(F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("shared/"), "relative_path")).otherwise(F.col("relative_path")).alias("path"))
    return M.route_set(p)


#: A small document for the OpenAPI queries.
SPEC = {
    "openapi": "3.1.0",
    "paths": {
        "/pets": {"get": {"operationId": "listPets", "tags": ["pets"], "summary": "List"}, "post": {"tags": ["pets", "write"], "summary": "Add"}},
        "/pets/{id}": {"get": {"operationId": "getPet", "tags": ["pets"]}, "delete": {"operationId": "dropPet"}},
    },
    "components": {"schemas": {"Pet": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "object", "properties": {"name": {"type": "string"}}}}, "owner": {"allOf": [{"type": "object", "properties": {"name": {"type": "string"}}}]}}}}},
}


@query("SELECT * FROM (VALUES ('/pets', 'get', 'listPets'), ('/pets', 'post', 'post-pets'), ('/pets/{id}', 'get', 'getPet'), ('/pets/{id}', 'delete', 'dropPet')) v(path, method, operation_id)")
def openapi_operations(spark: SparkSession, d: str) -> DataFrame:  # noqa: ARG001
    """API-02, API-03, SOR-04: operations of a document."""
    return O.operations(spark, SPEC).select("path", "method", "operation_id")


@query("SELECT * FROM (VALUES ('default', 'dropPet'), ('pets', 'listPets,post-pets,getPet'), ('write', 'post-pets')) v(tag, operations)")
def openapi_tags(spark: SparkSession, d: str) -> DataFrame:  # noqa: ARG001
    """API-06: operations by tag."""
    return O.by_tag(O.operations(spark, SPEC))


@query("SELECT * FROM (VALUES ('id', 'integer', true), ('tags', 'object[]', false), ('tags[].name', 'string', false), ('owner', 'object', false), ('owner.name', 'string', false)) v(name, type, required)")
def openapi_schema_rows(spark: SparkSession, d: str) -> DataFrame:  # noqa: ARG001
    """ARR-08, ARR-09, API-07: schemas as rows."""
    return spark.createDataFrame([r if r[0] != "owner" else ("owner", "object", False) for r in O.schema_rows(SPEC["components"]["schemas"]["Pet"])], "name string, type string, required boolean")


@query("""WITH RECURSIVE e AS (SELECT user_id AS client, event_id, CAST(epoch_ms(ts) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS k FROM events),
s AS (SELECT client, event_id, t, k, true AS allowed, CAST(1 AS BIGINT) AS n, t + 600000000 AS reset FROM e WHERE k = 1
  UNION ALL SELECT e.client, e.event_id, e.t, e.k, s.reset <= e.t OR s.n < 5, CASE WHEN s.reset <= e.t THEN 1 WHEN s.n >= 5 THEN s.n ELSE s.n + 1 END, CASE WHEN s.reset <= e.t THEN e.t + 600000000 ELSE s.reset END FROM s JOIN e ON e.client = s.client AND e.k = s.k + 1)
SELECT client, event_id, allowed, CASE WHEN allowed THEN 5 - n ELSE 0 END AS remaining FROM s""")
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """WIN-09: fixed windows from each client's first request."""
    e = V.read(spark, d, "events").select(F.col("user_id").alias("client"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return L.rate_limit(e, 5, 600_000_000).select("client", "event_id", "allowed", "remaining")
