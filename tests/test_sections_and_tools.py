"""Chunks of sections, late boosts, phrases, tools, reads by layout, components, includes, the lint run."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import artifacts, experiments, library, linter, mdx, openapi, retrieval, structure


def rows(df, *names):
    return sorted(tuple(r) for r in (df.select(*names) if names else df).collect())


PAGE = "page_id long, url string, title string, description string, content string"
GUIDE = "# Guide\nIntro with [a link](x).\n\n## Set up\nRun it.\n```sh\nnpm install pkg\n```\n#### Deep `one`\nMore words.\n\n## Empty\n\n## Long\n" + "Sentence of several words here. " * 60


def test_chunks_of_sections(spark):
    pages = spark.createDataFrame([(3, "/g", "The Guide", "About", GUIDE), (4, "/e", "Empty", "", ""), (5, "/p", "Plain", None, "just text")], PAGE)
    got = {(r.page_id, r.chunk_pos & 0xFFFFFFFF): r for r in retrieval.chunk_rows(pages).collect()}
    parts = list(structure.split_overlapping(" ".join(("Sentence of several words here. " * 60).split())))
    assert len(parts) > 1 and len(got) == 3 + len(parts) + 1
    assert got[3, 0].text == "The Guide\n\nAbout\n\nGuide\n\nIntro with a link." and got[3, 0].anchor == "guide" and got[3, 0].chunk_pos == 3 << 32
    assert got[3, 1].text == "The Guide\n\nAbout\n\nGuide\n\nSet up\n\nRun it.\n\n" + got[3, 1].code and "npm install pkg" in got[3, 1].code
    assert got[3, 2].heading == "Guide Set up Deep one" and got[3, 2].anchor == "deep-one" and got[3, 2].code == ""
    assert [got[3, 3 + k].text.split("\n\n")[-1] for k in range(len(parts))] == parts
    assert got[5, 0].text == "Plain\n\njust text" and got[5, 0].anchor == ""
    index = retrieval.build(retrieval.chunk_rows(pages))
    tf = {r.term: tuple(r)[2:6] for r in index.postings.where(f"chunk_pos = {(3 << 32) + 1}").collect()}
    assert tf["guide"] == (1, 1, 2, 0) and tf["npm"] == (0, 0, 1, 1) and tf["set"] == (0, 1, 1, 0) and tf["about"] == (0, 0, 2, 0)
    index.release()
    assert not index.kept and not index.postings.is_cached


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    vocabulary = [f"{c}{k}x" for c in "abcdefgh" for k in range(12)]
    texts = [" ".join(rng.choices(vocabulary[: rng.choice([20, 96])], k=rng.randrange(5, 60))) for _ in range(150)]
    data = [(i, f"/{i % 40}", f"t{i}", "", "", t, "") for i, t in enumerate(texts)]
    queries = [(k, " ".join(texts[rng.randrange(150)].split()[: rng.choice([2, 3, 5])])) for k in range(12)] + [(90, "a1x zzz9 b2x"), (91, "1x a")]
    index = retrieval.build(spark.createDataFrame(data, "chunk_pos long, url string, title string, description string, heading string, text string, code string"))
    return index, spark.createDataFrame(queries, "query_id int, query string"), texts, dict(queries)


def test_late_boosts_lose_nothing(corpus):
    index, queries, _, _ = corpus
    asked = queries.select("query_id", T.tokens("query").alias("asked"))
    every = retrieval.score(retrieval.expand(queries, index), index).join(index.chunks.select("chunk_pos", "url", "tokens"), "chunk_pos").join(asked, "query_id")
    every = every.withColumn("score", F.round(F.col("score") + retrieval.boost(F.col("tokens"), F.col("asked")), 9)).select("query_id", "score", "url", "chunk_pos").collect()
    want = []
    for q in {r.query_id for r in every}:
        best = sorted((r for r in every if r.query_id == q), key=lambda r: (-r.score, r.url, r.chunk_pos))[:8]
        want += [(q, k + 1, r.chunk_pos, r.score) for k, r in enumerate(best)]
    got = rows(retrieval.search(queries, index), "query_id", "rank", "chunk_pos", "score")
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and all(abs(g[3] - w[3]) < 1e-8 for g, w in zip(got, sorted(want)))


def test_phrases(corpus):
    index, queries, texts, asked = corpus
    want = [(q, i) for q, said in asked.items() if len(said.split()) > 1 for i, t in enumerate(texts) if " ".join(x for x in said.split() if len(x) > 1) in t and len([x for x in said.split() if len(x) > 1]) > 1]
    assert rows(retrieval.phrase_hits(queries, index)) == sorted(want)


def test_tools(spark, corpus):
    index, queries, texts, _ = corpus
    session = library.Session(index, "example.com", "Docs")
    hits = session.ask(queries, 500).collect()
    assert len({(h.query_id, h.url) for h in hits}) == len(hits) and max(h.place for h in hits) <= 50 and hits[0].site == "example.com"
    assert {r.query_id: 0 for r in session.search(queries, 0).collect()}.keys() == {h.query_id for h in hits}
    assert all(r["rank"] == 1 for r in session.search(queries, 0).collect())
    assert [library.clamped(x, 10) for x in (None, float("nan"), 0, 7.9, 99)] == [10, 10, 1, 7, 50]
    whole = {r.url: r for r in session.files().collect()}
    assert whole["/0"].text == "\n\n".join(texts[i] for i in range(0, 150, 40)) and whole["/0"].chunks == 4 and session.documents().count() == 40
    bare, content = library.detach(index)
    back = library.attach(bare, content.where("chunk_pos <> 3"))
    assert rows(library.read_chunks(back, spark.createDataFrame([(2,), (3,), (999,)], "chunk_pos long")), "chunk_pos", "text", "title") == [(2, texts[2], "t0" if False else whole["/2"].title), (3, "", whole["/3"].title)]
    pages = spark.createDataFrame([(1, "/docs/a"), (2, "/")], "page_id int, url string")
    asked = spark.createDataFrame([(" docs/a.md ",), ("/docs/a/",), ("/index",), ("",)], "asked string")
    assert rows(library.get_pages(asked, pages), "asked", "page_id") == [("", 2), (" docs/a.md ", 1), ("/docs/a/", 1)]
    commands = ["cat a | grep b", "rm a", "echo x >y", "cat <a", "sed --in-place x", "grep rmdir a", "sed -n 1p a", "(curl x)"]
    got = spark.createDataFrame([(c,) for c in commands], "c string").select(library.unsafe("c").alias("u")).collect()
    assert [r.u for r in got] == [False, True, True, False, True, False, False, True]


def test_query_status(spark):
    said = ["a", "\t", "   ", "a" * 401, "a" + " " * 500 + "b", "a\x07", None, ("ab " * 200).strip()]
    got = spark.createDataFrame([(x,) for x in said], "q string").select(T.query_status("q").alias("s")).collect()
    assert [r.s for r in got] == [200, 400, 400, 413, 200, 400, 400, 413]


CALL = "run_id int, tool string, path string, result string, is_error boolean"


def test_reads(spark):
    calls = spark.createDataFrame([
        (1, "read", "./llms.txt", "x", None), (1, "read", "docs\\authoring\\llms.txt", None, None), (1, "read", "/docs/llms-full/build.txt", "", False), (1, "read", "docs/build/a.md", "error: ENOENT", None),
        (1, "fetch", "llms-full.txt", "x", None), (1, "read", "docs/authoring/b.md", "x", True), (2, "grep", "llms.txt", "x", None),
    ], CALL)
    got = {r.run_id: tuple(r)[1:] for r in experiments.read_summary(calls).collect()}
    assert got == {1: (3, True, False, ["authoring"], [], ["build"]), 2: (0, False, False, [], [], [])}
    cases = [
        ("page-links", [], ["docs/build/a.md"], False), ("page-links", ["build"], [], True), ("explicit-bundles", ["build"], [], True), ("explicit-bundles", ["authoring", "build"], [], False), ("monolith", ["build"], [], False),
        ("router", ["build"], [], False), ("section-indexes", ["build"], ["docs/build/a.md"], False), ("section-indexes", ["authoring"], [], False), ("other", ["build"], [], False),
    ]
    reads = experiments.read_summary(calls)
    for variant, groups, pages, want in cases:
        expected = spark.createDataFrame([(1, variant, groups, pages)], "run_id int, variant string, expected_groups array<string>, expected_pages array<string>")
        row = experiments.context_matched(reads, expected).first()
        assert row.matched == want, variant
    assert row.wrong_groups == [] and row.missing == ["variant"]


def test_components():
    assert mdx.to_markdown('<Callout type="warn">Be careful.</Callout>') == "> ⚠️ **Warning:**\n> Be careful.\n"
    assert mdx.to_markdown('<Callout variant={"warning"} title={"Heads up"}>\nA **b** and `c`\n[d](e).\n</Callout>') == "> ⚠️ **Warning:** **Heads up**\n> A b and c d.\n"
    assert mdx.to_markdown("<Callout />") == "> ℹ️ **Info:**\n"
    got = mdx.to_markdown('<CommandTabs command="leadtool" />')
    assert "`npx leadtool`" in got and "`bunx leadtool`" in got
    assert "`yarn create app`" in mdx.to_markdown('<CommandTabs command="app" mode="create" />') and mdx.to_markdown("<CommandTabs />") == "\n"
    assert mdx.to_markdown("<details>\n  <summary>`State`</summary>\n\n  More here.\n</details>") == "### State\n\nMore here.\n"
    assert mdx.to_markdown("<Details>\n  Body alone.\n</Details>") == "### Details\n\nBody alone.\n"
    assert mdx.to_markdown("[a](/docs/frameworks/{framework}/x) {framework} ![i](/{none:y}/z)", path="docs/frameworks/react/a.mdx") == "[a](/docs/frameworks/react/x) {framework} ![i](/y/z)\n"


def test_includes(spark):
    files = {f"p/{k}.md": f"{k} <include>{k + 1}.md</include>" for k in range(12)} | {"p/12.md": "end <include>3.md</include>", "root.md": "r"}
    want = " ".join(map(str, range(12))) + " end"
    assert mdx.to_markdown("<include>0.md</include>", files, "p/a.mdx").split() == want.split()
    pages = spark.createDataFrame([("p/a.mdx", "<include>0.md</include>"), ("q/b.mdx", "<include>root.md</include> <include>no.md</include>"), ("c.mdx", "none")], "path string, source string")
    table = spark.createDataFrame(list(files.items()), "path string, source string")
    assert {p: m.split() for p, m in rows(mdx.convert(pages, table))} == {"p/a.mdx": want.split(), "q/b.mdx": ["r"], "c.mdx": ["none"]}
    assert len(rows(mdx.included(pages, table))) == 14


def test_lint_run(spark):
    text = "# One\n\nsee [b](./b.mdx#part) and [c](/docs/gone) and [d](/docs/old) and [ref][1] ![](x.png)\n\n[1]: /docs/b#none\n\n#### Deep\n\n```\ncode\n```\n"
    pages = spark.createDataFrame([
        (1, "a.mdx", text, {"title": '"A"', "order": "1.5", "odd": "1"}), (2, "b.mdx", "# B\n\n## Part\n\n```ts\n[x](/docs/nowhere)\n```\n", {"description": '"d"'}),
    ], "page_id long, path string, content string, fields map<string,string>")
    moved = spark.createDataFrame([("/docs/old", "/docs/b")], "from string, to string")
    rules = spark.createDataFrame([("geo:image-alt", "off"), ("unknown-field", "error")], "rule string, to string")
    found = linter.lint(pages, moved, rules, ["/docs"])
    assert rows(found, "file", "rule", "severity") == sorted([
        ("a.mdx", "invalid-link", "error"), ("a.mdx", "invalid-link", "error"), ("a.mdx", "invalid-anchor", "error"), ("a.mdx", "schema", "error"), ("a.mdx", "unknown-field", "error"),
        ("a.mdx", "geo:heading-skip", "warn"), ("a.mdx", "geo:code-language", "warn"), ("b.mdx", "schema", "error"),
    ])
    assert found.where("message like '%moved to /docs/b'").count() == 1
    assert structure.silent_images(pages).count() == 1 and rows(linter.route_set(pages)) == [("/docs/a",), ("/docs/b",)]


def test_security(spark):
    spec = {
        "security": [{"key": []}], "components": {"securitySchemes": {"key": {"type": "apiKey"}, "oauth": {"type": "oauth2"}}},
        "paths": {"/a": {"get": {}, "post": {"security": [{"oauth": ["w"], "key": []}, {"none": []}]}, "put": {"security": []}}},
    }
    assert rows(openapi.security(spark, spec)) == [("/a", "get", 0, "key", "apiKey", []), ("/a", "post", 0, "key", "apiKey", []), ("/a", "post", 0, "oauth", "oauth2", ["w"])]


def test_outline_of_optional_pages(spark):
    pages = spark.createDataFrame([(1, "x", 1, "/a", "A", ""), (2, "x/y", None, "/b", "B", "d"), (3, "o", None, "/c", "C", ""), (4, "o", None, "/c", "C", ""), (5, None, None, "/d", "D", None)], "page_id long, grp string, ord int, url string, title string, description string")
    lines = [r.line for r in artifacts.docs_map(pages, "P", ["o"]).collect()]
    assert lines[7:] == ["", "## x", "", "- [A](/a)", "", "### y", "", "- [B](/b): d", "", "## Other", "", "- [D](/d)", "", "## Optional", "", "Lower-priority pages — safe to skip for a shorter context.", "", "- [C](/c)"]
    assert rows(artifacts.curated_links(spark.createDataFrame([("/a", None, None), ("/z/get-it", None, ""), ("/d", "Own", "said")], "url string, title string, description string"), pages)) == [
        ("/a", "A", "Entry point for A documentation."), ("/d", "Own", "said"), ("/z/get-it", "Get It", "Entry point for Get It documentation."),
    ]


def test_search_writes_and_shuffles_no_whole_postings(spark, corpus):
    index, queries, _, _ = corpus
    assert index.held.count() == 150  # a row for each chunk, with its terms
    plan = retrieval._near_best(retrieval.expand(queries, index), index, 8)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan
    got = rows(retrieval.search(queries, index))
    loose = retrieval.Index(index.chunks, index.postings, index.vocab)  # as read from files
    assert [g[:5] for g in got] == [x[:5] for x in rows(retrieval.search(queries, loose))]
    pages = spark.createDataFrame([(3, "/g", "The Guide", "About", GUIDE), (5, "/p", "Plain", None, "just text")], PAGE)
    made = retrieval.build(retrieval.chunk_parts(pages), retrieval.with_texts)
    want = retrieval.build(retrieval.chunk_rows(pages).drop("body"))
    assert rows(made.postings) == rows(want.postings) and rows(made.vocab) == rows(want.vocab)
    assert rows(made.chunks, "chunk_pos", "text", "length", "tokens") == rows(want.chunks, "chunk_pos", "text", "length", "tokens")


def test_repeated_chunk_numbers_count_once(spark):
    data = [(1, "/a", "One", "", "", "alpha beta", ""), (1, "/b", "Two", "", "", "alpha gamma gamma", "")]
    index = retrieval.build(spark.createDataFrame(data, "chunk_pos long, url string, title string, description string, heading string, text string, code string"))
    assert {r.term: r.df for r in index.vocab.collect()} == dict.fromkeys(("one", "two", "alpha", "beta", "gamma"), 1)
    assert {tuple(r) for r in index.postings.where("term = 'alpha'").select("tf_title", "tf_body").collect()} == {(0, 2)}


def test_chunks_follow_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from marginalia.plans import text_queries, views as V

    rng = random.Random(3)
    words = lambda n: "".join(rng.choice(["ab ", "cde. ", "f", "\u00e9 ", "gh. "]) for _ in range(n)).strip()
    texts = [("Some words. " * 200)[:k].strip(" ") + "x" * k for k in (0, 1)] + [words(2000)[:n - 1] + "x" for n in (1200, 1201, 1202, 2241, 3281)]
    texts += [("A late sentence is here. " * 48)[: n - 1] + "z" for n in range(1199, 1205)] + ["\u00a0a\u00a0\u00a0b \x0b c\x1d\u2003", "", None, " \n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert rows(text_queries.chunks(spark, str(tmp_path))) == sorted(con.execute(V.SQL["chunks"]).fetchall())
