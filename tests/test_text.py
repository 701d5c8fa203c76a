"""Text expressions on single rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as T


def one(spark, column, **values):
    names = list(values) or ["x"]
    row = spark.createDataFrame([tuple(values.values()) or (1,)], names)
    return row.select(column.alias("out")).first().out


@pytest.mark.parametrize(("token", "want"), [("queries", "query"), ("running", "runn"), ("sing", "sing"), ("parsed", "pars"), ("boxes", "boxe"), ("docs", "docs"), ("matches", "match"), ("plans", "plan"), ("abc", "abc")])
def test_stem(spark, token, want):
    assert one(spark, T.stem("x"), x=token) == want


def test_fold_and_tokens(spark):
    assert one(spark, T.fold("x"), x="Crème BRÛLÉE") == "creme brulee"
    assert one(spark, T.fold_any("x"), x="ﬁne Ａ é") == "fine a e"
    assert one(spark, T.tokens("x"), x="How to use the API, v2 a") == ["api", "v2"]


@pytest.mark.parametrize(("path", "want"), [("guide/index.md", "/docs/guide"), ("index.md", "/docs"), ("a/b.mdx", "/docs/a/b"), ("api/x.md", "/reference/x"), ("api/index.md", "/reference")])
def test_routes(spark, path, want):
    assert one(spark, T.route("x", {"api": "/reference"}), x=path) == want


@pytest.mark.parametrize(("path", "want"), [("guide/index.md", "/docs/guide/index.md"), ("index.md", "/docs/index.md"), ("a/b.mdx", "/docs/a/b.md")])
def test_mirrors(spark, path, want):
    assert one(spark, T.mirror("x"), x=path) == want


@pytest.mark.parametrize(("source", "link", "want"), [("a/b/c.md", "../d", "a/d"), ("a/b.md", "./c/./d", "a/c/d"), ("a.md", "../x", None), ("a/b.md", "../../x", None)])
def test_relative_links(spark, source, link, want):
    assert one(spark, T.resolve_link("s", "k"), s=source, k=link) == want


@pytest.mark.parametrize(("accept", "want"), [("text/markdown", True), ("text/html,text/markdown", False), ("text/html;q=0.5, text/markdown", True), ("*/*", False), ("", False)])
def test_markdown_preferred(spark, accept, want):
    assert one(spark, T.prefers_markdown("x"), x=accept) is want


def test_small_ones(spark):
    assert one(spark, T.slug("x"), x="  Hello, Wörld! ") == "hello-world"
    assert one(spark, T.titleise("x"), x="getting-started_now") == "Getting Started Now"
    assert one(spark, T.title_from_path("x"), x="my-guide/index.mdx") == "My Guide"
    assert one(spark, T.title_from_path("x"), x="index.mdx") == "Documentation"
    assert one(spark, T.redirect_path("x"), x=" old/ ") == "/old"
    assert one(spark, T.redirect_path("x"), x="/") == "/"
    assert one(spark, T.xml_escape("x"), x="a<b>&'\"\x01") == "a&lt;b&gt;&amp;&apos;&quot;"
    assert one(spark, T.bare_url("x"), x="https://a.b/c/?d#e") == "https://a.b/c"
    assert one(spark, T.fill_placeholders("x", {"name": "N"}), x="{name} {name:f} {other:g}") == "N N g"
    assert one(spark, T.has_placeholder("x"), x="/docs/{framework}/a") is True
    assert one(spark, T.framework("x"), x="/docs/frameworks/vue/a") == "vue"
    assert one(spark, T.iso_date("x"), x="2024-02-03") == "2024-02-03T00:00:00.000Z"
    assert one(spark, T.iso_date("x"), x="soon") is None
    assert one(spark, T.json_in_html("x"), x="</script>") == "\\u003c/script\\u003e"
    assert one(spark, T.query_status("x"), x="a\x00b") == 400


def test_excerpt(spark):
    text = "x" * 100 + " needle " + "y" * 300
    got = one(spark, T.excerpt("x", F.array(F.lit("none"), F.lit("needle"))), x=text)
    assert got == "..." + text[21:261].strip() + "..."
    assert one(spark, T.excerpt("x", F.array(F.lit("none"))), x=text) == text[:220].strip()
