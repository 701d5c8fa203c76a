"""Curated navigation, locales and content checks on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marginalia.operators import content_checks as K
from marginalia.operators import curation as U
from marginalia.functions import text as T
from marginalia.operators import locales as G
from marginalia.operators import mdx, navigation, openapi, snapshots


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_groups():
    tree = [{"slug": "start", "groups": [{"slug": "install"}]}, {"slug": "api", "title": "API"}]
    assert list(U.groups(tree)) == [("start", None, 0, "Start"), ("start/install", "start", 0, "Install"), ("api", None, 1, "API")]
    with pytest.raises(ValueError, match="twice"):
        list(U.groups([{"slug": "a"}, {"slug": "a"}]))
    with pytest.raises(ValueError, match="slug"):
        list(U.groups([{"slug": "A b"}]))


def test_curated_navigation(spark):
    refs = U.curated(spark, [{"slug": "g", "base": "guide", "pages": ["index", "a.md", "../b", "a"], "groups": [{"slug": "h", "pages": ["none"]}]}])
    pages = spark.createDataFrame([("guide/index.mdx",), ("guide/a.md",), ("b.md",), ("c.md",)], "path string")
    found = U.resolve_refs(refs, pages)
    assert rows(found) == [("g", "b.md", 2), ("g", "guide/a.md", 1), ("g", "guide/index.mdx", 0)]
    assert rows(U.unreferenced(pages, found)) == [("c.md",)]
    assert rows(U.missing_refs(refs, pages)) == [("g/h", "guide/none")]
    assert rows(U.matching(pages, ["guide/**"], ["**/a.md"])) == [("guide/index.mdx",)]


def test_distinct_paths_goes_on_past_taken_names(spark):
    df = spark.createDataFrame([(1, "/a"), (2, "/A"), (3, "/a-2"), (4, "/a")], "id int, path string")
    got = [r.path.lower() for r in U.distinct_paths(df).collect()]
    assert len(set(got)) == 4 and "/a" in got and "/a-2" in got


def test_locales(spark):
    with pytest.raises(ValueError, match="default"):
        G.Locales(("fr",), "en")
    some = G.Locales(("en", "fr"), "en")
    df = spark.createDataFrame([("/docs/fr/a", "fr/a.md"), ("/docs/a", "a.md")], "url string, path string")
    locale, logical = G.split_path("path", some)
    assert rows(df.select(locale, logical, G.locale_of("url", some), G.without_locale("url", some), G.localise(F.lit("/docs/a"), F.lit("fr"), some))) == [("en", "a.md", "en", "/docs/a", "/docs/fr/a"), ("fr", "a.md", "fr", "/docs/a", "/docs/fr/a")]


def test_snippets_and_components(spark):
    text = '# A\n<Unknown /> <Callout>x</Callout>\n```json\n{"a": 1,}\n```\n```jsonc\n{"a": 1, // c\n}\n```\n```yaml\na: [1\n```\n```yaml\na: 1\n```\n```ts\n<InFence/>\n```'
    pages = spark.createDataFrame([(1, text)], "page_id int, content string")
    assert rows(K.leaking_components(pages)) == [(1, "Unknown")]
    assert [(r.block, r.lang) for r in K.broken_snippets(pages).orderBy("block").collect()] == [(1, "json"), (3, "yaml")]


def test_small_expressions(spark):
    df = spark.createDataFrame([({"x-forwarded-for": "1.1.1.1, 2.2.2.2"},), ({"x-real-ip": "3.3.3.3"},), ({"y": ""},)], "h map<string,string>")
    assert [r.c for r in df.select(U.client(F.col("h")).alias("c")).collect()] == ["1.1.1.1", "3.3.3.3", "anonymous"]
    one = spark.range(1)
    assert one.select(U.artifact(F.lit("/docs/sitemap.xml")), U.artifact(F.lit("/docs/a")), U.slug_name(F.lit("getPetById"))).first()[0:3] == (True, False, "get-pet-by-id")
    assert one.select(U.rebase(F.lit("https://a.b/c"), "https://a.b", "https://x.y")).first()[0] == "https://x.y/c"
    found = spark.createDataFrame([("f", "r", "error", None, "m")], "file string, rule string, severity string, field string, message string")
    assert [K.report(found, s).first().line for s in ("pretty", "github")] == ["f: error r: m", "::error file=f::[r] m"]


def test_page_metadata(spark):
    body = "<Tag />\n\n## A *title* #\n\n- item\n\nSome [prose](x)\nhere.\n\nMore"
    one = spark.createDataFrame([(body, {"url": "/mine", "a": "x {k:f}"})], "b string, f map<string,string>")
    got = one.select(T.first_heading("b"), T.first_paragraph("b"), T.enriched("f", F.lit("/u"), F.array(F.lit("/old"))), T.fill_values("f", {"k": "K"}), T.output_path(F.lit("a/b.mdx"))).first()
    assert got[0:2] == ("A title", "Some prose here.")
    assert got[2] == {"url": "/mine", "a": "x {k:f}", "aliases": "/old"} and got[3]["a"] == "x K" and got[4] == "a/b.md"
    pages = spark.createDataFrame([("a", None, "me"), ("b", "2020", None)], "path string, last_modified string, author string")
    changes = spark.createDataFrame([("a", "2024", "x"), ("b", "2024", "y")], "path string, last_modified string, last_author string")
    assert rows(snapshots.with_history(pages, changes)) == [("a", "2024", "me"), ("b", "2020", "y")]
    groups = spark.createDataFrame([(1, ["A", "a ", "b"]), (2, ["B", ""])], "page_id int, groups array<string>")
    assert [tuple(r) for r in navigation.inferred(groups).collect()] == [("a", 1), ("b", 2)]


def test_api_pages(spark):
    spec = {"openapi": "3.0.0", "paths": {"/a/{id}": {"get": {"summary": "Get {id}", "responses": {"200": {"description": "ok", "content": {"application/json": {}}}, "404": {}}}}}}
    ops = openapi.operations(spark, spec)
    assert rows(openapi.responses(ops)) == [("/a/{id}", "get", "200", "ok", "application/json"), ("/a/{id}", "get", "404", "", "")]
    assert openapi.mdx_safe("a {b} `{c}` <d> <https://e.f>") == "a \\{b\\} `{c}` \\<d> <https://e.f>"
    page = openapi.pages(ops).first()
    assert page.path == "api/get-a-{id}.mdx" and "Get \\{id\\}" in page.source and 'title: "get-a-{id}"' in page.source
    assert "`GET /a/{id}`" in mdx.to_markdown(page.source)
    assert mdx.to_markdown('<ApiParameters rows={[{ name: "id", required: true }]} />') == "| name | required |\n| --- | --- |\n| id | true |\n"
    assert openapi.overridden({"a": 1}, {"b": 2}) == {"a": 1, "b": 2} and openapi.overridden({"a": 1}, lambda g: None) == {"a": 1}
