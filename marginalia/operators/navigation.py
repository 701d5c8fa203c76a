"""Groups, navigation trees, locales, feeds and request decisions (JOI-07 to JOI-11, NAV-*, SOR-*, FEE-*, I18-*)."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..scratch import materialize

# Crawlers that fetch for answers, those that gather training data, and names in user agents.
RETRIEVAL = (
    "OAI-SearchBot ChatGPT-User PerplexityBot Perplexity-User ClaudeBot Claude-SearchBot Claude-User Claude-Web Gemini-Deep-Research "
    "DeepSeekBot Meta-ExternalFetcher AmazonBot Amazonbot Bingbot MistralBot AppleBot YouBot"
).split()
TRAINING = "GPTBot Google-Extended CCBot ByteSpider Bytespider anthropic-ai MetaExternalAgent Applebot-Extended".split()
AGENTS = (
    "amazonbot anthropic-ai applebot bingbot bytespider ccbot chatgpt-user claude-searchbot claude-user claude-web claudebot deepseekbot "
    "gemini-deep-research google-extended gptbot meta-externalagent meta-externalfetcher metaexternalagent mistralbot oai-searchbot "
    "perplexity-user perplexitybot youbot"
).split()
ALLOWED = ("/", "/docs/", "/llms.txt", "/docs/llms.txt", "/sitemap.xml", "/sitemap.md")
FEED_LIMIT = 20


def memberships(pages: DataFrame, groups: DataFrame) -> DataFrame:
    """(page_id, slug, status) for each group that a page names (JOI-09, JOI-10, ARR-06).

    Slugs compare without case. A page without any known group is ``ungrouped`` besides; one that names
    unknown groups has a row of status ``unknown`` for each.
    """
    named = pages.select("page_id", F.explode_outer(F.filter(F.transform("groups", lambda g: F.trim(g)), lambda g: g != "")).alias("named"))
    known = groups.select("slug", F.lower("slug").alias("key"))
    both = named.withColumn("key", F.lower("named")).join(known, "key", "left")
    status = F.when(F.col("slug").isNotNull(), "member").when(F.col("named").isNotNull(), "unknown")
    rows = both.select("page_id", F.coalesce("slug", "named").alias("slug"), status.alias("status")).where("status is not null").distinct()
    none = pages.select("page_id").join(rows.where("status = 'member'").select("page_id"), "page_id", "left_anti")
    return rows.union(none.select("page_id", F.lit(None).cast("string"), F.lit("ungrouped")))


def in_order(*keys: str) -> Window:
    """Window of navigation order (SOR-01): order with nulls last, then the keys."""
    return Window.partitionBy(*keys).orderBy(F.asc_nulls_last("ord"), "path")


def tree(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, root, level, sort_path, trail) of (node, parent, ord, title): each node's place in depth-first order (ARR-07, ARR-16, NAV-09).

    Levels are joined one by one, from the roots (null parent) down, until none is left or ``depth`` are placed.
    """
    key = lambda: F.struct(F.col("ord").alias("ord"), F.col("node").alias("node"))
    level = nodes.where("parent is null").select("node", F.col("node").alias("root"), F.lit(0).alias("level"), F.array(key()).alias("sort_path"), F.array("title").alias("trail"))
    level = out = materialize(level)
    for k in itertools.count(1):
        if k == depth:
            break
        child = nodes.where("parent is not null").alias("c").join(level.alias("p"), F.col("c.parent") == F.col("p.node"))
        place = F.concat("p.sort_path", F.array(F.struct(F.col("c.ord").alias("ord"), F.col("c.node").alias("node"))))
        level = materialize(child.select("c.node", "p.root", F.lit(k).alias("level"), place.alias("sort_path"), F.concat("p.trail", F.array("c.title")).alias("trail")))
        if level.isEmpty():
            break
        out = out.union(level)
    return out


def neighbours(placed: DataFrame, scope: str = "root") -> DataFrame:
    """(node, previous, next) in reading order within ``scope`` (WIN-02)."""
    w = Window.partitionBy(scope).orderBy("sort_path")
    return placed.select("node", scope, F.lag("node").over(w).alias("previous"), F.lead("node").over(w).alias("next"))


def tabs(placed: DataFrame) -> DataFrame:
    """(root, first): the first node below each root, or the root (NAV-08)."""
    return placed.groupBy("root").agg(F.min_by("node", F.struct((F.col("level") == 0).cast("int"), "sort_path")).alias("first"))


def below(placed: DataFrame, node: Column | int) -> DataFrame:
    """Nodes at or below ``node`` in reading order (SET-07, NAV-07)."""
    return placed.where(F.exists("sort_path", lambda x: x["node"] == node))


def localised(pages: DataFrame, default: str, wanted: list[str]) -> DataFrame:
    """(logical_path, locale, source_locale, is_fallback, page_id): each page in each locale, by the default's where it has none (JOI-07, JOI-08)."""
    locales = F.explode(F.array(*map(F.lit, wanted)))
    every = pages.select("logical_path").distinct().select("logical_path", locales.alias("locale"))
    own = pages.select("logical_path", "locale", F.col("page_id").alias("own"))
    base = pages.where(F.col("locale") == default).select("logical_path", F.col("page_id").alias("base"))
    both = every.join(own, ["logical_path", "locale"], "left").join(base, "logical_path", "left")
    fallback = F.col("own").isNull()
    return both.where("own is not null or base is not null").select("logical_path", "locale", F.when(fallback, F.lit(default)).otherwise(F.col("locale")).alias("source_locale"), fallback.alias("is_fallback"), F.coalesce("own", "base").alias("page_id"))


def alternates(pages: DataFrame) -> DataFrame:
    """(page_id, locale, alternate) of the same logical path (JOI-27)."""
    a, b = pages.alias("a"), pages.alias("b")
    return a.join(b, F.col("a.logical_path") == F.col("b.logical_path")).where("a.page_id <> b.page_id").select("a.page_id", F.col("b.locale").alias("locale"), F.col("b.page_id").alias("alternate"))


def newest(entries: DataFrame, limit: int = FEED_LIMIT) -> DataFrame:
    """The newest entries of each feed, drafts left out (SOR-03, FIL-04)."""
    w = Window.partitionBy("feed_id").orderBy(F.desc("published_at"), "url")
    return entries.where(~F.coalesce("draft", F.lit(False))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def rss(entries: DataFrame) -> DataFrame:
    """(feed_id, xml): an RSS document for each feed of ranked entries (FEE-01, SNK-09)."""
    date = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    item = F.concat(F.lit("<item><title>"), T.xml_escape("title"), F.lit("</title><link>"), T.xml_escape("url"), F.lit("</link><guid>"), T.xml_escape("url"), F.lit("</guid><pubDate>"), date, F.lit("</pubDate></item>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))), lambda x: x["item"]), "")
    return entries.groupBy("feed_id").agg(F.concat(F.lit('<rss version="2.0"><channel><title>'), T.xml_escape("feed_id"), F.lit("</title>"), body, F.lit("</channel></rss>")).alias("xml"))


def atom(entries: DataFrame) -> DataFrame:
    """(feed_id, updated, xml): an Atom document for each feed; it was updated when its newest entry was (FEE-02)."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    item = F.concat(F.lit("<entry><title>"), T.xml_escape("title"), F.lit("</title><id>"), T.xml_escape("url"), F.lit("</id><updated>"), stamp(F.coalesce("updated_at", "published_at")), F.lit("</updated></entry>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))), lambda x: x["item"]), "")
    updated = F.max(F.coalesce("updated_at", "published_at"))
    return entries.groupBy("feed_id").agg(updated.alias("updated"), F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><updated>'), stamp(updated), F.lit("</updated>"), body, F.lit("</feed>")).alias("xml"))


def undated(entries: DataFrame) -> DataFrame:
    """Feeds with entries that have no date, which are errors (FEE-03)."""
    return entries.where("published_at is null").groupBy("feed_id").agg(F.count("*").alias("n"))


def robots(policies: DataFrame, base: str) -> DataFrame:
    """(policy, robots): robots.txt for each policy: balanced, block-training, block-ai, open (NAV-18)."""
    allow = "".join(f"Allow: {p}\n" for p in ALLOWED)

    def blocks(names: list[str], shut: bool) -> str:
        return "".join(f"User-agent: {n}\n" + ("Disallow: /\n" if shut else allow) + "\n" for n in names)

    head = f"User-agent: *\n{allow}\n"
    shut_all, shut_training = F.col("policy") == "block-ai", F.col("policy").isin("block-ai", "block-training")
    retrieval = F.when(shut_all, blocks(RETRIEVAL, True)).otherwise(blocks(RETRIEVAL, False))
    training = F.when(shut_training, blocks(TRAINING, True)).otherwise(blocks(TRAINING, False))
    return policies.select("policy", F.concat(F.lit(head), retrieval, training, F.lit(f"Sitemap: {base}/sitemap.xml\n")).alias("robots"))


def agent(user_agent: Column | str) -> Column:
    """Whether a user agent is a known crawler or assistant (STR-36)."""
    return F.coalesce(T.col(user_agent).rlike("(?i)\\b(" + "|".join(AGENTS) + ")\\b"), F.lit(False))


def negotiate(requests: DataFrame, pages: DataFrame, found: DataFrame) -> DataFrame:
    """(request_id, status, target): how each request for a page is answered (NAV-19).

    ``requests`` has request_id, path, accept, user_agent; ``pages`` url_path. Live pages are served as
    Markdown to those who prefer it, else as HTML; other paths follow redirects; the rest is missing.
    """
    asked = requests.withColumn("norm", T.redirect_path("path"))
    live = pages.select(F.col("url_path").alias("norm"), F.lit(True).alias("live"))
    went = found.select(F.col("from").alias("norm"), "to", F.col("status").alias("moved"))
    both = asked.join(live, "norm", "left").join(went, "norm", "left")
    md = T.prefers_markdown("accept") | agent("user_agent")
    target = F.when(F.col("live") & md, F.concat("norm", F.lit(".md"))).when(F.col("live"), F.col("norm")).otherwise(F.col("to"))
    return both.select("request_id", F.when(F.col("live"), 200).otherwise(F.coalesce("moved", F.lit(404))).alias("status"), target.alias("target"))


def sitemap(pages: DataFrame, per_file: int = 50_000) -> DataFrame:
    """(file, n, xml): sitemaps of ``per_file`` URLs at most, by URL (NAV-16)."""
    url = F.concat(F.lit("<url><loc>"), T.xml_escape("absolute_url"), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), F.date_format("last_modified", "yyyy-MM-dd"), F.lit("</lastmod>")), F.lit("")), F.lit("</url>"))
    # URLs are dealt to files by hash, so that no task ranks all of them.
    n = pages.agg(F.greatest(F.ceil(F.count("*") / per_file), F.lit(1)).alias("files"))
    dealt = pages.crossJoin(F.broadcast(n)).select(F.pmod(F.crc32(F.col("absolute_url").cast("binary")), F.col("files")).alias("file"), "absolute_url", url.alias("u"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("absolute_url", "u"))), lambda x: x["u"]), "")
    return dealt.groupBy("file").agg(F.count("*").alias("n"), F.concat(F.lit("<urlset>"), body, F.lit("</urlset>")).alias("xml"))


def inferred(pages: DataFrame) -> DataFrame:
    """(slug, pages): the groups that pages name, by slug without case (AGG-16)."""
    each = pages.select("page_id", F.explode(F.array_distinct(F.transform("groups", lambda g: F.lower(F.trim(g))))).alias("slug"))
    return each.where("slug <> ''").groupBy("slug").agg(F.count("*").alias("pages")).orderBy("slug")
