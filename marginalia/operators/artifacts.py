"""Text artifacts of a corpus: llms.txt, docs map, AGENTS.md, sitemap.md, full context, manifests, JSON lines (SNK-04 to SNK-08, SNK-11, NAV-12 to NAV-15, NAV-17, ARR-17, SEA-27, JOI-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

#: Paths of what the writers produce, from the site's root.
ARTIFACTS = (
    "/llms.txt", "/llms-full.txt", "/robots.txt", "/sitemap.md", "/sitemap.xml",
    "/docs/agent-readability.json", "/docs/llms.txt", "/docs/robots.txt", "/docs/search-content.json", "/docs/search-index.json", "/docs/sitemap.md", "/docs/sitemap.xml",
    "/.well-known/api-catalog", "/.well-known/llms.txt", "/.well-known/llms-full.txt", "/.well-known/mcp", "/.well-known/mcp.json", "/.well-known/mcp/server-card.json",
)
#: File names that say nothing as titles.
GENERIC = ("home", "index", "readme")


def _ordered(keys: list[str], line: Column, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, line.alias("line_")))), lambda x: x["line_"]), between)


def llms_txt(pages: DataFrame, product: str, summary: str) -> DataFrame:
    """(grp, body): each group's section of llms.txt, links by title and description in page order (SNK-04, NAV-13).

    One row a group, so that no task holds more than one; ``sinks.write_text`` joins them in order.
    """
    link = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(")"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), F.col("description"))).otherwise(F.lit("")))
    head = F.lit(f"# {product}\n\n> {summary}\n\n")
    body = _ordered(["ord", "page_id"], link, "\n")
    return pages.groupBy("grp").agg(F.concat(F.lit("## "), F.col("grp"), F.lit("\n\n"), body).alias("body")).withColumn("head", head)


def outline(pages: DataFrame, head: list[str], link: Column, optional: list[str] | None = None, note: str = "") -> DataFrame:
    """(part, grp, at, ord, page_id, line): a document's lines, one row each, in this order (NAV-13).

    ``head`` comes first; then a section for each group, whose level follows the slashes in its name, with
    its pages' ``link`` by ord and page_id; pages without a group under Other; those of ``optional``
    groups, each URL once, under Optional after ``note``. Sorting by the columns before ``line`` is a range
    sort, so that a group of any size is never one row or one task's.
    """
    kind = F.when(F.col("grp").isNull(), 2).when(F.col("grp").isin(optional or []), 3).otherwise(1)
    rows = pages.select(kind.alias("part"), F.when(kind == 1, F.col("grp")).otherwise("").alias("grp"), "ord", "page_id", "url", link.alias("line"))
    once = rows.where("part = 3").groupBy("url").agg(F.min(F.struct("part", "grp", "ord", "page_id", "url", "line")).alias("r")).select("r.*")
    links = rows.where("part < 3").union(once).select("part", "grp", F.lit(2).alias("at"), "ord", "page_id", "line")
    title = F.when(F.col("part") == 1, F.concat(F.repeat(F.lit("#"), F.size(F.split("grp", "/")) + 1), F.lit(" "), F.element_at(F.split("grp", "/"), -1))).when(F.col("part") == 2, F.lit("## Other")).otherwise(F.lit("## Optional"))
    above = F.when((F.col("part") == 3) & F.lit(note != ""), F.array(F.lit(""), title, F.lit(""), F.lit(note), F.lit(""))).otherwise(F.array(F.lit(""), title, F.lit("")))
    titles = rows.select("part", "grp").distinct().select("part", "grp", F.lit(1).alias("at"), F.posexplode(above).alias("n", "line"))
    ids = dict(pages.dtypes)
    titles = titles.select("part", "grp", "at", F.col("n").cast(ids["ord"]).alias("ord"), F.lit(None).cast(ids["page_id"]).alias("page_id"), "line")
    first = pages.sparkSession.createDataFrame(list(enumerate(head)), "n int, line string")
    first = first.select(F.lit(0).alias("part"), F.lit("").alias("grp"), F.lit(0).alias("at"), F.col("n").cast(ids["ord"]).alias("ord"), F.lit(None).cast(ids["page_id"]).alias("page_id"), "line")
    return first.union(titles).union(links).orderBy("part", "grp", "at", "ord", "page_id")


def page_link(url: Column) -> Column:
    """A list item that links a page by its title, with its description."""
    said = F.coalesce("description", F.lit(""))
    return F.concat(F.lit("- ["), F.col("title"), F.lit("]("), url, F.lit(")"), F.when(said != "", F.concat(F.lit(": "), said)).otherwise(F.lit("")))


def docs_map(pages: DataFrame, product: str, optional: list[str] | None = None) -> DataFrame:
    """Lines of the curated docs map (SNK-04, NAV-13)."""
    head = [
        f"# {product} Documentation", "", f"> Curated documentation map for developers and coding agents working with {product}.", "", "## How To Use This File", "",
        "Read the summary links first. If the page links are not enough, use `/llms-full.txt` as the broad full-context fallback.",
    ]
    return outline(pages, head, page_link(F.col("url")), optional, "Lower-priority pages — safe to skip for a shorter context.")


def agents_md(pages: DataFrame, product: str, summary: str, bullets: list[str] | None = None, folder: str = "docs") -> DataFrame:
    """Lines of AGENTS.md: pages by paths relative to that file (SNK-08). ``pages`` has relative_path, too."""
    head = [f"# {product}", "", f"> {summary}", "", "These docs ship inside the package so coding agents can read them offline. Open the topic file you need from the list below — paths are relative to this file."]
    head += ["", "## Product Summary", "", *(f"- {b}" for b in bullets)] if bullets else []
    return outline(pages, head, page_link(F.concat(F.lit(f"./{folder}/"), F.regexp_replace("relative_path", r"\.mdx?$", ""), F.lit(".md"))))


def sitemap_md(pages: DataFrame, product: str) -> DataFrame:
    """Lines of sitemap.md (NAV-17)."""
    return outline(pages, ["# Sitemap", "", f"Structured documentation sitemap for {product}."], page_link(F.col("url")))


def everything(pages: DataFrame, product: str, summary: str, base: str) -> dict[str, DataFrame]:
    """All artifacts of pages in memory, by path (SNK-07): tables of lines, parts or entries, in the order of their first columns."""
    from . import navigation

    dated = pages.withColumn("absolute_url", F.concat(F.lit(base), "url"))
    dated = dated if "last_modified" in pages.columns else dated.withColumn("last_modified", F.lit(None).cast("date"))
    return {
        "/llms.txt": docs_map(pages, product), "/llms-full.txt": llms_full(pages), "/AGENTS.md": agents_md(pages, product, summary), "/sitemap.md": sitemap_md(pages, product),
        "/sitemap.xml": navigation.sitemap(dated), "/docs/agent-readability.json": manifest(pages), "/feeds/schema.jsonl": json_ld(pages, base),
    }


def curated_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, title, description) of curated links, with defaults by their pages (JOI-18).

    A title comes from the link, from the page unless it is generic, or from the URL's last part; a
    description from the link, from the page, or says that this is an entry point.
    """
    own = pages.select("url", F.col("title").alias("page_title"), F.col("description").alias("page_description"))
    last = F.element_at(F.filter(F.split(F.concat(F.lit("Documentation/"), "url"), "/"), lambda x: x != ""), -1)
    title = F.coalesce("title", F.when(~F.lower("page_title").isin(*GENERIC), F.col("page_title")), T.titleise(last))
    said = F.coalesce(F.nullif(F.col("description"), F.lit("")), F.nullif(T.squeeze(F.col("page_description")), F.lit("")), F.concat(F.lit("Entry point for "), title, F.lit(" documentation.")))
    return links.join(own, "url", "left").select("url", title.alias("title"), said.alias("description"))


def llms_full(pages: DataFrame) -> DataFrame:
    """(page_id, body): each page's part of the full context (SNK-05, NAV-14)."""
    return pages.select("page_id", F.concat(F.lit("# "), F.col("title"), F.lit("\n\nURL: "), F.col("url"), F.lit("\n\n"), F.trim("content")).alias("body"))


def manifest(pages: DataFrame) -> DataFrame:
    """(page_id, json): each page's manifest entry (SNK-06, NAV-15)."""
    return pages.select("page_id", F.to_json(F.struct("title", F.coalesce("description", F.lit("")).alias("description"), F.col("url").alias("urlPath"), F.concat("url", F.lit(".md")).alias("markdownUrlPath"), "groups")).alias("json"))


def json_ld(pages: DataFrame, base: str) -> DataFrame:
    """(page_id, json): each page as schema.org JSON-LD (ARR-17, SNK-11)."""
    return pages.select("page_id", F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("TechArticle").alias("@type"), F.col("title").alias("headline"), F.coalesce("description", F.lit("")).alias("description"), F.concat(F.lit(base), F.col("url")).alias("url"))).alias("json"))


def virtual_files(pages: DataFrame) -> DataFrame:
    """(path, content): the corpus as files (SEA-27): an index and one file for each page."""
    page = pages.select(F.concat(F.lit("/docs/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), F.col("content"))
    index = pages.groupBy("grp").agg(F.concat(F.lit("/index/"), F.col("grp"), F.lit(".txt")).alias("path"), _ordered(["page_id"], F.col("title"), "\n").alias("content")).select("path", "content")
    return page.union(index)
