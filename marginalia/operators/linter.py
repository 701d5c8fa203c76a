"""The lint run over a corpus: schemas of frontmatter, structure, links, overrides (LNT-01, LNT-02, LNT-06, LNT-16, LNT-17, AGG-08, SCO-01)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from . import checks, structure
from .checks import violation

# The fields of pages, changelog entries and sidebar files. A type with ! is required.
PAGE = {
    "title": "text!", "description": "string", "icon": "string", "status": "new|updated|experimental", "deprecated": "text", "tags": "strings", "group": "string|strings", "search": "boolean",
    "redirectFrom": "strings", "date": "date", "variants": "list", "related": "list", "order": "integer", "full": "boolean",
}
CHANGELOG = {
    "title": "text!", "description": "string", "icon": "string", "version": "semver!", "date": "date!", "type": "release|improvement|retired|deprecation", "tags": "strings", "canary": "boolean",
    "authors": "string|strings", "draft": "boolean",
}
META = {"title": "text", "pages": "strings!", "root": "boolean", "icon": "string", "defaultOpen": "boolean", "nav": "object"}

#: What a value's JSON looks like; other names are one of several fixed strings.
_JSON = {
    "string": r'^".*"$', "text": r'^"(?!")[\s\S]+"$', "boolean": r"^(true|false)$", "integer": r"^-?\d+$", "list": r"^\[[\s\S]*\]$", "object": r"^\{[\s\S]*\}$",
    "strings": r'^\[\s*("([^"\\]|\\.)*"\s*(,\s*"([^"\\]|\\.)*"\s*)*)?\]$', "date": r'^"\d{4}-\d{2}-\d{2}([T ][^"]*)?"$', "semver": r'^"\d+\.\d+\.\d+[^"\s]*"$',
}


def fits(value: Column, kind: str) -> Column:
    """Whether a value (JSON) is of a kind: a named one, alternatives of these, or one of several strings."""
    names = kind.rstrip("!").split("|")
    if all(n in _JSON for n in names):
        return reduce(lambda a, b: a | b, [value.rlike(_JSON[n]) for n in names])
    return value.isin(*(f'"{n}"' for n in names))


def schema_violations(files: DataFrame, schema: dict[str, str], unknown: str = "warn") -> DataFrame:
    """Findings for fields that are missing, of another kind or not in ``schema`` (LNT-02, LNT-17). ``files`` has file and fields, a map of JSON values."""
    found = []
    for name, kind in schema.items():
        value = F.col("fields")[name]
        bad = F.when(value.isNull(), F.lit(f"{name}: missing") if kind.endswith("!") else F.lit(None).cast("string")).when(~fits(value, kind), F.lit(f"{name}: not {kind.rstrip('!')}"))
        found.append(F.when(bad.isNotNull(), F.struct(*violation(F.col("file"), "schema", "error", F.lit(name), bad))))
    extra = F.transform(F.filter(F.map_keys("fields"), lambda k: ~k.isin(*schema)), lambda k: F.struct(*violation(F.col("file"), "unknown-field", unknown, k, F.concat(F.lit("unknown field "), k))))
    each = F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()), extra)
    return files.select(F.explode(each).alias("v")).select("v.*")


def route_set(paths: DataFrame, mounts: dict[str, str] | None = None) -> DataFrame:
    """(route): the distinct routes of a tree's pages (path), shared folders left out (LNT-16)."""
    return paths.where(~F.col("path").rlike(r"(^|/)(_shared|shared|node_modules)/")).select(T.route("path", mounts).alias("route")).distinct()


def structure_findings(pages: DataFrame) -> DataFrame:
    """Warnings for skipped levels, fences without a language, images without text (LNT-06); ``pages`` has page_id, content and file."""
    skips = structure.heading_skips(pages).select("page_id", "pos", F.lit("geo:heading-skip").alias("rule"), F.concat(F.lit("level "), F.col("level").cast("string"), F.lit(" after "), F.col("before").cast("string")).alias("said"))
    fences = structure.bare_fences(pages).select("page_id", "pos", F.lit("geo:code-language").alias("rule"), F.lit("no language").alias("said"))
    images = structure.silent_images(pages).select("page_id", "pos", F.lit("geo:image-alt").alias("rule"), F.lit("no alternative text").alias("said"))
    rows = skips.union(fences).union(images).join(pages.select("page_id", "file"), "page_id")
    return rows.select(*violation(F.col("file"), F.col("rule"), "warn", F.col("pos").cast("string"), F.col("said")))


def lint(pages: DataFrame, moved: DataFrame, rules: DataFrame, prefixes: list[str], schema: dict[str, str] | None = None, mounts: dict[str, str] | None = None) -> DataFrame:
    """All findings over pages, in two phases: routes and anchors of all pages, then each page against them (LNT-01).

    ``pages`` has page_id, path, content and fields (frontmatter as a map of JSON values); ``rules`` (rule,
    to) changes severities.
    """
    named = pages.withColumn("file", F.col("path"))
    route = T.route("path", mounts)
    routes = route_set(pages, mounts)
    anchors = structure.toc(named, 1, 6).join(named.select("page_id", route.alias("route")), "page_id").select("route", F.col("id").alias("anchor"))
    links = structure.page_urls(named).join(named.select("page_id", "file", "path", route.alias("current_route")), "page_id")
    links = links.select("file", F.col("path").alias("source_path"), "current_route", F.lit(None).cast("string").alias("field"), "url")
    found = checks.link_violations(links, routes, anchors, moved, prefixes)
    found = found.unionByName(schema_violations(named, PAGE if schema is None else schema)).unionByName(structure_findings(named))
    return checks.override(found, rules)


def signals(files: DataFrame, pages: DataFrame, robots: DataFrame, findings: DataFrame) -> DataFrame:
    """(dimension, id, points, max) of the readiness score (AGG-08, SCO-01).

    ``files`` has the paths that were written, from the output folder; ``pages`` (title, description,
    last_modified) is the readability manifest, empty without one; ``robots`` has the lines of robots.txt;
    ``findings`` are the lint run's.
    """
    has = lambda name: F.coalesce(F.bool_or(F.col("path") == name), F.lit(False))
    paths = files.agg(
        has("llms.txt").alias("llms"), has("llms-full.txt").alias("full"), has(".well-known/llms.txt").alias("known"), has("docs/search-index.json").alias("indexed"),
        has("docs/agent-readability.json").alias("listed"), has("sitemap.xml").alias("mapped"), has(".well-known/agent-skills/index.json").alias("skilled"),
        F.coalesce(F.bool_or((F.col("path") == "AGENTS.md") | (F.col("path").startswith("docs/") & F.col("path").endswith(".md"))), F.lit(False)).alias("offline"),
    )
    told = robots.agg(F.coalesce(F.bool_or(F.contains("line", F.lit("Content-Signal:"))), F.lit(False)).alias("signalled"))
    clean = findings.agg((F.count_if(F.col("rule").startswith("geo:")) == 0).alias("clean"))
    one = paths.crossJoin(told).crossJoin(clean).crossJoin(checks.coverage(pages))  # one row each
    yes = lambda name, ok, most, kind="identity": (kind, name, F.when(ok, most).otherwise(0), most)
    c = F.col
    rows = [
        yes("llms-txt", c("llms"), 2), yes("llms-full", c("full"), 1), yes("well-known", c("known"), 1), yes("search-manifest", c("indexed") & c("listed"), 2), yes("sitemap", c("mapped") | c("listed"), 1),
        yes("robots", c("signalled") | c("listed"), 2), yes("jsonld", c("complete"), 2), ("identity", "descriptions", F.floor(c("described") * 2 + 0.5).cast("int"), 2), yes("geo-structure", c("clean"), 2),
        yes("mcp-ready", c("indexed") & c("listed"), 2, "integration"), yes("skills", c("skilled"), 2, "integration"), yes("offline-docs", c("offline"), 1, "integration"),
    ]
    return one.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(i).alias("id"), p.cast("int").alias("points"), F.lit(m).alias("max")) for d, i, p, m in rows))).alias("s")).select("s.*")
