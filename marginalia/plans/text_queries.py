"""Queries over texts, paths, URLs and Markdown structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import structure as S
from . import views as V
from .views import query


@query("SELECT lang, source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest, count(DISTINCT text) AS texts FROM documents GROUP BY ALL")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """Documents, characters and distinct texts by language and source."""
    g = V.read(spark, d, "documents").groupBy("lang", "source")
    return g.agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"), F.countDistinct("text").alias("texts"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, array_to_string(t[1:5], ' ') AS head FROM (SELECT doc_id, {V.tokens_sql('text')} AS t FROM documents)")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    """STR-01, STR-02: tokens of every document."""
    t = V.read(spark, d, "documents").select("doc_id", T.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_join(F.slice("t", 1, 5), " ").alias("head"))


@query(f"WITH t AS (SELECT unnest({V.tokens_sql('text')}) AS term, doc_id FROM documents), v AS (SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM t GROUP BY term) SELECT {V.stem_sql('term')} AS stem, count(*) AS terms, CAST(sum(n) AS BIGINT) AS occurrences, max(df) AS df FROM v GROUP BY 1")
def stem_classes(spark: SparkSession, d: str) -> DataFrame:
    """STR-03, AGG-03, ARR-05: the vocabulary by stems."""
    t = V.read(spark, d, "documents").select("doc_id", F.explode(T.tokens("text")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    v = t.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))
    return v.groupBy(T.stem("term").alias("stem")).agg(F.count("*").alias("terms"), F.sum("n").alias("occurrences"), F.max("df").alias("df"))


@query(f"SELECT page_id, {V.slug_sql('title')} AS slug, {V.clean_sql('description')} AS plain FROM {V.PAGES} p")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    """STR-05, STR-06: heading slugs and plain text."""
    return V.pages(spark, d).select("page_id", T.slug("title").alias("slug"), T.clean_markdown("description").alias("plain"))


@query(f"SELECT page_id, CASE WHEN lang = 'en' THEN '/guide/' || regexp_replace(relative_path[4:], '\\.md$', '') ELSE '/docs/' || regexp_replace(relative_path, '\\.md$', '') END AS mounted, '/docs/' || regexp_replace(relative_path, '\\.md$', '') AS route, '/docs/' || relative_path AS mirror, 'https://example.com/docs/' || regexp_replace(relative_path, '\\.md$', '') AS absolute FROM {V.PAGES} p")
def route_map(spark: SparkSession, d: str) -> DataFrame:
    """STR-13 to STR-16: routes with and without mounts, mirrors, absolute URLs."""
    p = V.pages(spark, d)
    return p.select("page_id", T.route("relative_path", {"en": "/guide"}).alias("mounted"), T.route("relative_path").alias("route"), T.mirror("relative_path").alias("mirror"), T.absolute(T.route("relative_path"), "https://example.com/").alias("absolute"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS bare, coalesce(regexp_extract(url, '\?([^#]*)', 1), '') AS query, coalesce(regexp_extract(url, '#(.*)$', 1), '') AS fragment FROM pages")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    """STR-17: URLs in parts."""
    u = F.col("url")
    return V.read(spark, d, "pages").select("page_id", F.try_parse_url(u, F.lit("HOST")).alias("host"), T.bare_url("url").alias("bare"), F.coalesce(F.regexp_extract(u, r"\?([^#]*)", 1), F.lit("")).alias("query"), F.coalesce(F.regexp_extract(u, "#(.*)$", 1), F.lit("")).alias("fragment"))


@query(r"SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id, regexp_replace('/' || regexp_replace(trim(url), '^https?://[^/]*/?', ''), '/+$', '') AS p FROM pages)")
def redirect_path_norm(spark: SparkSession, d: str) -> DataFrame:
    """STR-32: redirect paths."""
    return V.read(spark, d, "pages").select("page_id", T.redirect_path(F.regexp_replace(F.trim("url"), "^https?://[^/]*/?", "")).alias("path"))


_ACCEPT = "CASE event_id % 5 WHEN 0 THEN 'text/html,text/markdown;q=0.9' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'text/html;q=0.2, text/plain;q=0.7' WHEN 3 THEN '*/*' ELSE 'TEXT/HTML; q = 0.5,text/markdown;q=0.5' END"


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0.9 WHEN 1 THEN 1.0 WHEN 2 THEN 0.7 WHEN 3 THEN 0.0 ELSE 0.5 END::DOUBLE AS md, CASE event_id % 5 WHEN 0 THEN 1.0 WHEN 2 THEN 0.2 WHEN 4 THEN 0.5 ELSE 0.0 END::DOUBLE AS html, event_id % 5 IN (1, 2) AS prefers FROM events")
def accept_negotiation(spark: SparkSession, d: str) -> DataFrame:
    """STR-34, STR-35: Accept headers."""
    e = V.read(spark, d, "events").select("event_id", F.expr(_ACCEPT).alias("accept"))
    return e.select("event_id", T.accept_quality("accept", "text/(markdown|plain)").alias("md"), T.accept_quality("accept", "text/html").alias("html"), T.prefers_markdown("accept").alias("prefers"))


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&apos;') AS xml, '"' || regexp_replace(t, '(["\\])', '\\\1', 'g') || '"' AS yaml
FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)""")
def escaped_titles(spark: SparkSession, d: str) -> DataFrame:
    """STR-28, STR-29: titles for XML and YAML."""
    p = V.read(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t"))
    return p.select("page_id", T.xml_escape("t").alias("xml"), T.quoted("t").alias("yaml"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(replace(p_type, ' ', '-'), '-'), lambda x: upper(left(x, 1)) || x[2:]), ' ') AS title FROM part")
def titleise_types(spark: SparkSession, d: str) -> DataFrame:
    """STR-11: titles from slugs."""
    return V.read(spark, d, "part").select("p_partkey", T.titleise(F.replace("p_type", F.lit(" "), F.lit("-"))).alias("title"))


@query("SELECT doc_id, left(sha256(trim(text)), 16) AS hash FROM documents")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """STR-37: content hashes."""
    return V.read(spark, d, "documents").select("doc_id", T.content_hash("text").alias("hash"))


@query(rf"""SELECT query_id, k, CASE WHEN k = 1 OR k = 4 THEN 400 WHEN length(regexp_replace(trim(query), '\s+', ' ', 'g')) * CASE k WHEN 2 THEN 3 ELSE 1 END + CASE k WHEN 2 THEN 2 ELSE 0 END > 400 THEN 413 ELSE 200 END AS status
FROM {V.QUERY} q, (SELECT unnest([0, 1, 2, 3, 4]) AS k)""")
def query_validation(spark: SparkSession, d: str) -> DataFrame:
    """STR-31: the status of whole queries: as they are, a lone tab, thrice in one, with wide gaps, with a control character."""
    q, k = F.col("query"), F.col("k")
    forms = F.when(k == 0, q).when(k == 1, F.lit("\t")).when(k == 2, F.concat_ws(" ", q, q, q)).when(k == 3, F.regexp_replace(q, " ", " \t\u00a0\n ")).otherwise(F.concat(F.left(q, F.lit(9)), F.lit("\x07")))
    return V.queries(spark, d).withColumn("k", F.explode(F.array(*map(F.lit, range(5))))).select("query_id", "k", T.query_status(forms).alias("status"))


@query(r"SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS iso FROM orders")
def iso_dates(spark: SparkSession, d: str) -> DataFrame:
    """STR-26: dates in ISO form."""
    return V.read(spark, d, "orders").select("o_orderkey", T.iso_date(F.col("o_orderdate").cast("string")).alias("iso"))


@query(f"WITH {V.LINES} SELECT page_id, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (WHERE fenced OR marker) AS BIGINT) AS code_lines, CAST((SELECT count(*) FROM h WHERE h.page_id = l.page_id) AS BIGINT) AS headings FROM l GROUP BY page_id")
def fence_parity(spark: SparkSession, d: str) -> DataFrame:
    """WIN-06: lines in fences, and headings outside."""
    m = V.markdown(spark, d)
    a = S.lines(m).groupBy("page_id").agg(F.count("*").alias("lines"), F.count_if(F.col("fenced") | F.col("marker")).alias("code_lines"))
    b = S.headings(m).groupBy("page_id").agg(F.count("*").alias("headings"))
    return a.join(b, "page_id", "left").select("page_id", "lines", "code_lines", F.coalesce("headings", F.lit(0)).cast("long").alias("headings"))


@query(f"""WITH {V.LINES}, t AS (SELECT page_id, pos, level, {V.clean_sql('title')} AS title FROM h WHERE level BETWEEN 2 AND 4), s AS (SELECT *, {V.slug_sql('title')} AS slug FROM t WHERE title <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id, slug ORDER BY pos) - 1 AS k FROM s)
SELECT page_id, pos, CASE WHEN k = 0 THEN slug ELSE slug || '-' || k END AS id, title, CAST(level AS INT) AS level,
(SELECT max(b.pos) FROM s b WHERE b.page_id = n.page_id AND b.pos < n.pos AND b.level < n.level) AS parent_pos FROM n""")
def toc(spark: SparkSession, d: str) -> DataFrame:
    """ARR-04, WIN-03, NAV-06: tables of contents."""
    t = S.toc(V.markdown(spark, d), 2, 4)
    return t.select("page_id", F.col("pos").cast("long").alias("pos"), "id", "title", "level", F.col("parent_pos").cast("long").alias("parent_pos"))


@query(f"WITH {V.LINES}, w AS (SELECT page_id, pos, level, lag(level, 1, 1) OVER (PARTITION BY page_id ORDER BY pos) AS before FROM h) SELECT page_id, CAST(pos AS BIGINT) AS pos, CAST(level AS BIGINT) AS level, CAST(before AS BIGINT) AS before FROM w WHERE level > before + 1")
def heading_skip(spark: SparkSession, d: str) -> DataFrame:
    """WIN-05, LNT-06: skipped heading levels."""
    s = S.heading_skips(V.markdown(spark, d))
    return s.select("page_id", *(F.col(c).cast("long").alias(c) for c in ("pos", "level", "before")))


@query(f"""WITH {V.LINES}, k AS (SELECT l.page_id, l.pos, l.line, l.fenced OR l.marker AS code, count(h.pos) OVER (PARTITION BY l.page_id ORDER BY l.pos ROWS UNBOUNDED PRECEDING) AS section, h.pos AS head
  FROM l LEFT JOIN h ON l.page_id = h.page_id AND l.pos = h.pos),
g AS (SELECT page_id, section, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT code), '') AS t, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE code), '') AS c FROM k WHERE head IS NULL GROUP BY ALL)
SELECT page_id, CAST(section AS BIGINT) AS section, {V.clean_sql('t')} AS text, {V.squeeze_sql('c')} AS code FROM g WHERE {V.clean_sql('t')} <> '' OR {V.squeeze_sql('c')} <> ''""")
def sections(spark: SparkSession, d: str) -> DataFrame:
    """ARR-01: sections with their text and code."""
    return S.sections(V.markdown(spark, d)).select("page_id", F.col("section").cast("long").alias("section"), "text", "code")


@query("""WITH RECURSIVE t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents),
c AS (SELECT doc_id, t, 0 AS start, 0 AS stop, CAST(-1 AS BIGINT) AS part FROM t WHERE t <> ''
  UNION ALL
  SELECT doc_id, t, b, CASE WHEN b + 1200 >= n THEN n WHEN sent > b + 720 THEN sent + 1 WHEN gap > b THEN gap ELSE b + 1200 END, part + 1 FROM (
    SELECT *, CASE WHEN sp = 0 THEN -1 ELSE r + 1 - sp END AS gap, CASE WHEN se = 0 THEN -1 ELSE r + 1 - se END AS sent FROM (
      SELECT *, length(t) AS n, least(b + 1200, length(t)) AS r, instr(reverse(t[b + 1 : b + 1201]), ' ') AS sp,
        instr(reverse(t[b + 1 : b + 1202]), ' .') AS se0, CASE WHEN instr(reverse(t[b + 1 : b + 1202]), ' .') = 0 THEN 0 ELSE instr(reverse(t[b + 1 : b + 1202]), ' .') END AS se
      FROM (SELECT *, CASE WHEN part < 0 THEN 0 ELSE greatest(stop - 160, start + 1) END AS b FROM c WHERE part < 0 OR stop < length(t)))))
SELECT doc_id AS id, part, CAST(length(trim(t[start + 1 : stop])) AS BIGINT) AS chars, md5(trim(t[start + 1 : stop])) AS digest FROM c WHERE part >= 0""")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    """ARR-02: overlapping parts of every document."""
    c = S.chunks(V.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), as_sql=True)
    return c.select("id", "part", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(r"""SELECT page_id, u AS url, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href=["'']([^"'']*)["'']', 1)) AS u FROM pages) GROUP BY ALL""")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    """LNT-04: link targets of pages."""
    return S.links(V.read(spark, d, "pages")).groupBy("page_id", "url").agg(F.count("*").alias("n"))
