"""Queries over expressions of headings, paths, links, placeholders, dates and headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import curation as U, locales as G, navigation as N, snapshots as P
from . import views as V
from .views import query


def _s(c: str) -> Column:
    return F.col(c).cast("string")


@query(f"SELECT page_id, {V.clean_sql("'link ' || title")} AS heading FROM {V.PAGES} p WHERE NOT regexp_matches(title, '[<>#]')")
def heading_labels(spark: SparkSession, d: str) -> DataFrame:
    """STR-07, STR-10: headings with tags, links and closing marks as plain labels."""
    p = V.pages(spark, d).where(~F.col("title").rlike("[<>#]"))
    return p.select("page_id", T.clean_heading(F.concat(F.lit('[link](/x?y#z)  <b class="c">'), "title", F.lit("</b>  ## "))).alias("heading"))


_BODY = r"regexp_replace(text, '^\n+', '')"


@query(f"SELECT doc_id, sha256({_BODY}) AS body, strlen({_BODY}) AS bytes FROM documents")
def page_bodies(spark: SparkSession, d: str) -> DataFrame:
    """STR-08, STR-09: pages without frontmatter and first-level heading."""
    p = V.read(spark, d, "documents").select("doc_id", F.concat(F.lit("---\ntitle: "), _s("doc_id"), F.lit("\nlang: en\n---\n# Page "), _s("doc_id"), F.lit("\n\n"), "text").alias("content"))
    p = p.select("doc_id", T.without_title(T.without_frontmatter("content")).alias("body"))
    return p.select("doc_id", F.sha2(F.col("body").cast("binary"), 256).alias("body"), F.octet_length("body").cast("long").alias("bytes"))


@query(f"""WITH m AS (SELECT page_id, content FROM {V.MARKDOWN} x), b AS (SELECT page_id, content,
  list_filter(string_split_regex(trim(content), '\\n\\s*\\n'), lambda v: trim(v) <> '' AND NOT regexp_matches(trim(v), '^(#|```|~~~|<|[-*+] |\\d+\\. |\\||>)'))[1] AS prose FROM m)
  SELECT page_id, nullif({V.clean_sql("regexp_extract(content, '(?m)^#{1,6}\\s+(.+)$', 1)")}, '') AS heading, nullif(left({V.clean_sql('prose')}, 200), '') AS paragraph FROM b""")
def inferred_metadata(spark: SparkSession, d: str) -> DataFrame:
    """STR-38: a page's title by its first heading, its description by its first paragraph."""
    return V.markdown(spark, d).select("page_id", T.first_heading("content").alias("heading"), T.first_paragraph("content").alias("paragraph"))


@query("""WITH p AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'guide/' || lower(replace(c_name, '#', '_')) || '.md' WHEN 1 THEN 'docs/' || lower(c_mktsegment) || '-n_' || c_custkey || '/index.mdx'
    WHEN 2 THEN 'README.md' ELSE lower(c_mktsegment) || '/a--b_' || c_custkey || '.mdx' END AS path FROM customer),
  q AS (SELECT id, path, string_split(regexp_replace(path, '\\.mdx?$', ''), '/') AS parts FROM p),
  r AS (SELECT id, path, CASE WHEN lower(parts[-1]) IN ('home', 'index', 'readme') THEN coalesce(nullif(parts[-2], ''), 'documentation') ELSE parts[-1] END AS name FROM q)
  SELECT id, array_to_string(list_transform(list_filter(string_split_regex(name, '[-_]'), lambda v: v <> ''), lambda v: upper(left(v, 1)) || substr(v, 2)), ' ') AS title,
    regexp_replace(path, '\\.mdx?$', '.md') AS output FROM r""")
def path_titles(spark: SparkSession, d: str) -> DataFrame:
    """STR-12, MDX-30: titles by paths, and where pages are written."""
    k, segment = F.col("c_custkey") % 4, F.lower("c_mktsegment")
    path = (
        F.when(k == 0, F.concat(F.lit("guide/"), F.lower(F.replace("c_name", F.lit("#"), F.lit("_"))), F.lit(".md")))
        .when(k == 1, F.concat(F.lit("docs/"), segment, F.lit("-n_"), _s("c_custkey"), F.lit("/index.mdx")))
        .when(k == 2, F.lit("README.md")).otherwise(F.concat(segment, F.lit("/a--b_"), _s("c_custkey"), F.lit(".mdx")))
    )
    p = V.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), path.alias("path"))
    return p.select("id", T.title_from_path("path").alias("title"), T.output_path("path").alias("output"))


@query("""SELECT id, CASE id % 5 WHEN 0 THEN 'n' || nation || '/x' || id || '.md' WHEN 1 THEN 'n' || nation || '/s/y/z.md' WHEN 2 THEN 'q' || id WHEN 4 THEN 'n' || nation || '/s/w/v' || id || '.md' END AS target,
  nation = 1 AS inside FROM (SELECT c_custkey AS id, c_nationkey AS nation FROM customer)""")
def relative_links(spark: SparkSession, d: str) -> DataFrame:
    """STR-18, STR-19, FIL-01: relative links against their page, and URLs below a prefix."""
    i, source = F.col("c_custkey"), F.concat(F.lit("n"), _s("c_nationkey"), F.lit("/s/p.md"))
    link = (
        F.when(i % 5 == 0, F.concat(F.lit("../x"), _s("c_custkey"), F.lit(".md"))).when(i % 5 == 1, F.lit("./y//z.md"))
        .when(i % 5 == 2, F.concat(F.lit("../../q"), _s("c_custkey"))).when(i % 5 == 3, F.lit("../../../gone.md"))
        .otherwise(F.concat(F.lit("w/./u/../v"), _s("c_custkey"), F.lit(".md")))
    )
    c = V.read(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), T.resolve_link(source, link).alias("target"), T.within(F.concat(F.lit("/n"), _s("c_nationkey"), F.lit("/s")), "/n1").alias("inside"))


_INCLUDE, _EXCLUDE = ["en/**/*1.md", "fr/web/?.md", "de/*/2*.md"], ["**/*11.md"]


@query(f"SELECT page_id FROM {V.PAGES} p WHERE (regexp_matches(relative_path, '^en/(.*/)?[^/]*1\\.md$') OR regexp_matches(relative_path, '^fr/web/[^/]\\.md$') OR regexp_matches(relative_path, '^de/[^/]*/2[^/]*\\.md$')) AND NOT regexp_matches(relative_path, '(^|/)[^/]*11\\.md$')")
def glob_matches(spark: SparkSession, d: str) -> DataFrame:
    """STR-20, FIL-05: pages that globs include and exclude."""
    return U.matching(V.pages(spark, d).withColumnRenamed("relative_path", "path"), _INCLUDE, _EXCLUDE).select("page_id")


_FILLED = "CASE c_custkey % 3 WHEN 0 THEN 'for Ann in ' || c_mktsegment WHEN 1 THEN 'by core, none: ' || c_mktsegment ELSE 'open {{team}} ' || c_mktsegment END".replace("{{", "{").replace("}}", "}")


@query(f"SELECT c_custkey AS id, {_FILLED} AS filled, c_custkey % 3 = 2 AS open FROM customer")
def placeholders(spark: SparkSession, d: str) -> DataFrame:
    """STR-21, ARR-14, FIL-10: placeholders filled by values and fallbacks, and those left."""
    i, m = F.col("c_custkey") % 3, F.col("c_mktsegment")
    text = F.when(i == 0, F.concat(F.lit("for {name:you} in "), m)).when(i == 1, F.concat(F.lit("by {team:core}, {site.url:none}: "), m)).otherwise(F.concat(F.lit("open {team} "), m))
    values = T.fill_values(F.create_map(F.lit("t"), text), {"name": "Ann"})
    c = V.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), values["t"].alias("filled"))
    return c.select("id", "filled", T.has_placeholder("filled").alias("open"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 3 = 1 THEN 'f' || c_nationkey END AS framework FROM customer")
def frameworks(spark: SparkSession, d: str) -> DataFrame:
    """STR-22: the framework of a docs URL."""
    i = F.col("c_custkey") % 3
    url = F.when(i == 0, F.concat(F.lit("https://x.org/docs/frameworks/"), F.lower("c_mktsegment"), F.lit("#top"))).when(i == 1, F.concat(F.lit("/docs/frameworks/f"), _s("c_nationkey"), F.lit("/start"))).otherwise(F.lit("/docs/guide"))
    return V.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.framework(url).alias("framework"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT00:00:00.000Z') END AS modified FROM orders")
def modified_dates(spark: SparkSession, d: str) -> DataFrame:
    """STR-27: the first date there is of a page's fields."""
    i, day = F.col("o_orderkey") % 3, F.date_format("o_orderdate", "yyyy-MM-dd")
    first, second = F.when(i == 0, day).otherwise(F.lit("soon")), F.when(i == 1, day)
    return V.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), U.modified(first, second).alias("modified"))


@query("SELECT page_id, sha256(replace(replace(replace(html, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')) AS escaped FROM pages")
def script_json(spark: SparkSession, d: str) -> DataFrame:
    """STR-30: text that can stand in a script element."""
    return V.read(spark, d, "pages").select("page_id", F.sha2(T.json_in_html("html").cast("binary"), 256).alias("escaped"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'c' || user_id WHEN 1 THEN 'f' || user_id WHEN 2 THEN 'r' || user_id ELSE 'anonymous' END AS client,
  event_id % 5 IN (0, 3) AS agent FROM events""")
def clients(spark: SparkSession, d: str) -> DataFrame:
    """STR-33, STR-36: who asks, and whether that is a known agent."""
    i, none = F.col("event_id") % 4, F.lit(None).cast("string")
    user = _s("user_id")
    headers = F.create_map(
        F.lit("cf-connecting-ip"), F.when(i == 0, F.concat(F.lit(" c"), user)).when(i == 1, F.lit(" ")).otherwise(none),
        F.lit("x-forwarded-for"), F.when(i <= 1, F.concat(F.lit("f"), user, F.lit(", 10.0.0.1"))).when(i == 2, F.lit(" , 10.0.0.1")).otherwise(none),
        F.lit("x-real-ip"), F.when(i <= 2, F.concat(F.lit("r"), user)).otherwise(none),
    )
    said = F.element_at(F.array(*map(F.lit, ["Mozilla/5.0 (compatible; GPTBot/1.1)", "Mozilla/5.0 (X11; Linux)", "curl/8.0", "claudebot", "NotGPTBotty/1"])), (F.col("event_id") % 5 + 1).cast("int"))
    return V.read(spark, d, "events").select("event_id", U.client(headers).alias("client"), N.agent(said).alias("agent"))


@query(f"SELECT page_id, {V.slug_sql('title')} || CASE WHEN {V.slug_sql('title')} = '' THEN '' ELSE '-' END || 'my-tool-name-v2' AS name FROM {V.PAGES} p WHERE NOT regexp_matches(title, '[a-z0-9][A-Z]')")
def skill_names(spark: SparkSession, d: str) -> DataFrame:
    """STR-44, STR-45: names as slugs, camelCase parted."""
    p = V.pages(spark, d).where(~F.col("title").rlike("[a-z0-9][A-Z]"))
    return p.select("page_id", U.slug_name(F.concat("title", F.lit(" myToolName_v2"))).alias("name"))


_LOW = V.fold_sql("text")
_AT = f"CASE WHEN strpos({_LOW}, 'zzqx') > 0 THEN strpos({_LOW}, 'zzqx') ELSE strpos({_LOW}, 'server') END"


@query(f"""WITH t AS (SELECT doc_id, text, length(text) AS n, {_AT} AS place FROM documents), c AS (SELECT *, greatest(0, place - 81) AS a, least(n, place + 159) AS b FROM t)
  SELECT doc_id, CASE WHEN place = 0 THEN trim(left(text, 220), ' ') ELSE CASE WHEN a > 0 THEN '...' ELSE '' END || trim(substr(text, a + 1, b - a), ' ') || CASE WHEN b < n THEN '...' ELSE '' END END AS excerpt FROM c""")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """STR-43: what stands around the first term that occurs."""
    return V.read(spark, d, "documents").select("doc_id", T.excerpt("text", F.array(F.lit("zzqx"), F.lit("server"))).alias("excerpt"))


@query("SELECT CAST(page_id AS BIGINT) AS page_id, CASE WHEN page_id % 2 = 0 THEN 'https://new.org/p/' || page_id ELSE 'https://old.organic/p/' || page_id END AS url FROM pages")
def rebased_urls(spark: SparkSession, d: str) -> DataFrame:
    """NAV-22: URLs at another origin."""
    host = F.when(F.col("page_id") % 2 == 0, F.lit("https://old.org/p/")).otherwise(F.lit("https://old.organic/p/"))
    p = V.read(spark, d, "pages").select(F.col("page_id").cast("long").alias("page_id"), F.concat(host, _s("page_id")).alias("url"))
    return p.select("page_id", U.rebase("url", "https://old.org", "https://new.org").alias("url"))


@query("SELECT lang AS locale, source AS logical_path, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL HAVING count(*) > 1")
def ambiguous_pages(spark: SparkSession, d: str) -> DataFrame:
    """I18-03: logical paths that a locale holds more than once."""
    return G.ambiguous(V.read(spark, d, "documents").select(F.col("lang").alias("locale"), F.col("source").alias("logical_path"), F.col("doc_id").alias("page_id")))


@query("SELECT c_mktsegment AS feed_id, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1")
def undated_entries(spark: SparkSession, d: str) -> DataFrame:
    """FEE-03: entries of a feed that have no date."""
    return N.undated(V.read(spark, d, "customer").select(F.col("c_mktsegment").alias("feed_id"), F.when(F.col("c_custkey") % 3 != 0, F.current_timestamp()).alias("published_at")))


@query("""WITH f AS (SELECT '/n/' || n_nationkey AS "from", '/r/' || n_regionkey AS "to", 308 AS status FROM nation), q AS (SELECT c_custkey AS id, '/n/' || c_nationkey || CASE c_custkey % 3 WHEN 0 THEN '.md' WHEN 1 THEN '/' ELSE '/gone' END AS path FROM customer)
  SELECT path, CASE WHEN path LIKE '%.md' THEN "to" || '.md' ELSE "to" END AS "to", status FROM q JOIN f ON regexp_replace(path, '(\\.md|/)$', '') = "from" """)
def redirect_requests(spark: SparkSession, d: str) -> DataFrame:
    """JOI-17: requested paths, also of Markdown mirrors, by redirects."""
    found = V.read(spark, d, "nation").select(F.concat(F.lit("/n/"), _s("n_nationkey")).alias("from"), F.concat(F.lit("/r/"), _s("n_regionkey")).alias("to"), F.lit(308).alias("status"))
    end = F.when(F.col("c_custkey") % 3 == 0, ".md").when(F.col("c_custkey") % 3 == 1, "/").otherwise("/gone")
    return P.resolve_requests(V.read(spark, d, "customer").select(F.concat(F.lit("/n/"), _s("c_nationkey"), end).alias("path")), found)


@query("""WITH refs AS (SELECT p_brand AS grp, p_size AS pos, 's/' || (p_partkey % 97) AS ref FROM part), pages AS (SELECT 's/' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.md' ELSE '/index.mdx' END AS path, 's/' || s_suppkey AS key FROM supplier)
  SELECT grp, path, min(pos) AS pos FROM refs JOIN pages ON ref = key GROUP BY ALL UNION ALL SELECT NULL, path, NULL FROM pages WHERE key NOT IN (SELECT ref FROM refs)""")
def curated_refs(spark: SparkSession, d: str) -> DataFrame:
    """JOI-11, NAV-04, SET-05: curated references to pages, and pages (without a group) that none refers to."""
    refs = V.read(spark, d, "part").select(F.col("p_brand").alias("grp"), F.col("p_size").alias("pos"), F.concat(F.lit("s/"), (F.col("p_partkey") % 97).cast("string")).alias("ref"))
    pages = V.read(spark, d, "supplier").select(F.concat(F.lit("s/"), _s("s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, ".md").otherwise("/index.mdx")).alias("path"))
    found = U.resolve_refs(refs, pages)
    return found.unionByName(U.unreferenced(pages, found), allowMissingColumns=True)


@query("SELECT s_suppkey AS id, s_suppkey % 4 = 1 AS hit FROM supplier")
def own_repositories(spark: SparkSession, d: str) -> DataFrame:
    """FIL-11: sources of repositories by a part of their name."""
    repo = F.element_at(F.array(*map(F.lit, ["acme/site", "Acme/DOCS-one", "acme/doc", "x/do-cs"])), (F.col("s_suppkey") % 4 + 1).cast("int"))
    ours, others = U.in_repositories(V.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), repo.alias("repo")), "docs")
    return ours.select("id", F.lit(True).alias("hit")).union(others.select("id", F.lit(False)))
