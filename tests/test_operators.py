"""Operators on small tables."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import checks, experiments, mdx, navigation, openapi, retrieval, snapshots, structure
from marginalia.sources import readers, sinks
from marginalia.streaming import limits


def rows(df, *names):
    return sorted(tuple(r) for r in (df.select(*names) if names else df).collect())


CHUNK = "chunk_pos long, url string, title string, description string, heading string, text string, code string"


@pytest.fixture(scope="module")
def index(spark):
    data = [
        (0, "/a", "Install guide", "", "", "Install guide\n\nRun the command to install packages", "npm install"),
        (1, "/b", "Search", "", "", "Search\n\nSearching pages with queries and more command text here run", ""),
        (2, "/c", "Config", "", "", "Config\n\nConfiguration options of the config file", ""),
    ]
    return retrieval.build(spark.createDataFrame(data, CHUNK))


def test_expansion(spark, index):
    q = spark.createDataFrame([(1, "install"), (2, "search"), (3, "confg"), (4, "setup"), (5, "conf"), (6, "the")], "query_id int, query string")
    got = {(r.query_id, r.term): r.weight for r in retrieval.expand(q, index).collect()}
    assert got[(1, "install")] == 1.0
    assert got[(2, "searching")] == 0.82 and got[(2, "search")] == 1.0
    assert got[(3, "config")] == 0.45
    assert got[(4, "install")] == 0.72
    assert got[(5, "config")] == 0.55 and got[(5, "configuration")] == 0.55
    assert not any(k[0] == 6 for k in got)


def test_search_against_scores_by_hand(spark, index):
    q = spark.createDataFrame([(1, "install packages")], "query_id int, query string")
    hit = retrieval.search(q, index).collect()
    assert [h.url for h in hit] == ["/a"]
    n, avg = 3, index.stats().first().avg_length
    length = index.chunks.where("chunk_pos = 0").first().length
    idf = math.log(1 + (n - 1 + 0.5) / 1.5)
    part = lambda tf: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))
    # install: once in the title, twice in the body, once in the code; the phrase stands in the text.
    assert hit[0].score == pytest.approx(part(4 + 2 + 0.35) + part(1) + 1.4, abs=1e-6)


def test_proximity(spark):
    df = spark.createDataFrame([("run the very big command", "run command"), ("command run", "run command"), ("run a1 a2 a3 a4 a5 a6 a7 a8 command", "run command"), ("run", "run")], "t string, q string")
    assert [r.b for r in df.select(retrieval.boost(F.split("t", " "), F.split("q", " ")).alias("b")).collect()] == [0.8, 0.0, 0.0, 0.0]


def test_answer_context_keeps_slivers(spark):
    h = spark.createDataFrame([(1, 1, 10, "abcd efgh"), (1, 2, 11, "xyz")], "query_id int, rank int, chunk_pos long, text string")
    got = retrieval.answer_context(h, most=5).orderBy("citation").collect()
    assert [(r.citation, r.context) for r in got] == [(1, "abcd"), (2, "x")]


def test_index_round_trip(index, spark, tmp_path):
    sinks.write_index(index, str(tmp_path / "i"))
    back = sinks.read_index(spark, str(tmp_path / "i"))
    assert rows(back.postings) == rows(index.postings)


def test_sections_and_toc(spark):
    text = "---\ntitle: x\n---\nintro\n# One\ntext\n```ts\n# no\n```\n### Three\nmore\n## One\n## One\nend"
    pages = spark.createDataFrame([(1, text)], "page_id int, content string")
    got = structure.sections(pages).orderBy("section").collect()
    assert [(r.heading_path, r.text, r.code) for r in got] == [([], "intro", ""), (["One"], "text", "```ts # no ```"), (["One", None, "Three"], "more", ""), (["One", "One"], "end", "")]
    assert [(r.id, r.level) for r in structure.toc(pages, 1, 3).orderBy("pos").collect()] == [("one", 1), ("three", 3), ("one-1", 2), ("one-2", 2)]
    assert [(r.level, r.before) for r in structure.heading_skips(pages).collect()] == [(3, 1)]


def test_splitter():
    text = "First sentence here. " + "word " * 60
    parts = list(structure.split_overlapping(text, 100, 20))
    assert all(len(p) <= 100 for p in parts) and parts[0].startswith("First sentence")
    assert list(structure.split_overlapping("  ", 10, 2)) == []
    assert list(structure.split_overlapping("a" * 25, 10, 3)) == ["a" * 10, "a" * 10, "a" * 10, "a" * 4]


def test_redirects(spark):
    t = lambda data, schema: spark.createDataFrame(data, schema)
    before = t([("/a", "h1"), ("/b", "h2"), ("/c", "h3"), ("/d", "h3"), ("/live", "h9")], "path string, hash string")
    now = t([("/a2", "h1"), ("/c2", "h3"), ("/live", "h9"), ("/t", "h7")], "path string, hash string")
    claims = t([("/x", "/t")], "from string, to string")
    removed = t([("/b",), ("/live",)], "path string")
    history = t([("/older", "/a"), ("/gone", None), ("/dead", "/b"), ("/live", "/t")], "from string, to string")
    got = rows(snapshots.redirects(before, now, claims, removed, history), "from", "to", "status")
    assert got == [("/a", "/a2", 308), ("/b", None, 410), ("/dead", None, 410), ("/gone", None, 410), ("/older", "/a2", 308), ("/x", "/t", 308)]
    found = snapshots.redirects(before, now, claims, removed, history)
    assert rows(snapshots.unmatched(before, now, found)) == [("/c",), ("/d",)]
    asked = t([("/a.md",), ("/b/",), ("/none",)], "path string")
    assert rows(snapshots.resolve_requests(asked, found)) == [("/a.md", "/a2.md", 308), ("/b/", None, 410)]


def test_chain_loops(spark):
    t = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("d", "e")], "from string, to string")
    assert rows(snapshots.resolve_chains(t, t).where("from in ('c', 'd')")) == [("c", "e"), ("d", "e")]
    assert snapshots.resolve_chains(t, t).where("from = 'a'").first().to is None


def test_long_chains_and_deep_trees(spark):
    steps = [(f"p{k}", f"p{k + 1}") for k in range(40)] + [(f"l{k}", f"l{(k + 1) % 21}") for k in range(21)] + [("in", "l3"), ("s", "s"), ("g", None)]
    t = spark.createDataFrame(steps, "from string, to string")
    got = {r["from"]: r.to for r in snapshots.resolve_chains(t, t).collect()}
    assert len(got) == len(steps) and all(got[f"p{k}"] == "p40" for k in range(40))
    assert all(v is None for k, v in got.items() if k[0] != "p")
    n = spark.createDataFrame([(k, k - 1 if k else None, 1, f"n{k}") for k in range(12)], "node int, parent int, ord int, title string")
    assert [r.node for r in navigation.tree(n).orderBy("sort_path").collect()] == [*range(12)]
    assert navigation.tree(n, 4).count() == 4


def test_bots(spark):
    df = spark.createDataFrame([("Renovate",), ("x[bot]",), ("my-bot",), ("Bob",), ("abbot",)], "a string").select(snapshots.is_bot("a").alias("b"))
    assert [r.b for r in df.collect()] == [True, True, True, False, False]
    df = spark.createDataFrame([("p", 3, "Release Robot", 0), ("p", 2, "Bob", 0), ("q", 1, " release robot ", 0), ("r", 1, "", 0)], "path string, ts int, author string, seq int")
    got = snapshots.last_changes(df, ignored=[" Release robot", ""]).collect()
    assert {r.path: (r.last_modified, r.last_author) for r in got} == {"p": (3, "Bob"), "q": (1, None), "r": (1, "")}


def test_tree(spark):
    n = spark.createDataFrame([(1, None, 1, "R"), (2, 1, 2, "B"), (3, 1, 1, "A"), (4, 3, 1, "C")], "node int, parent int, ord int, title string")
    t = navigation.tree(n)
    assert [r.node for r in t.orderBy("sort_path").collect()] == [1, 3, 4, 2]
    assert rows(navigation.neighbours(t), "node", "previous", "next")[3] == (4, 3, 2)
    assert rows(navigation.tabs(t)) == [(1, 3)]


def test_robots(spark):
    got = dict(rows(navigation.robots(spark.createDataFrame([("balanced",), ("block-ai",), ("block-training",)], "policy string"), "https://x")))
    assert got["balanced"].count("Disallow") == 0 and got["block-ai"].count("Disallow") == 25 and got["block-training"].count("Disallow") == 8


def test_wilson(spark):
    df = spark.createDataFrame([(60, 52), (60, 42), (60, 60), (0, 0)], "n int, p int")
    low, high = experiments.wilson(F.col("n").cast("double"), F.col("p").cast("double"))
    got = [(round(100 * r.a), round(100 * r.b)) for r in df.select(F.try_divide(low, F.lit(1)).alias("a"), high.alias("b")).where("n > 0").collect()]
    assert got == [(76, 93), (57, 80), (94, 100)]


def test_lint_cascade(spark):
    links = [("p", "a/p.md", "/docs/a/p", None, u) for u in ("/docs/{x}/a", "../../z", "./q#no", "./q#yes", "./pic.png", "/docs/old", "https://e.com", "/docs/gen/x")]
    got = checks.link_violations(
        spark.createDataFrame(links, "file string, source_path string, current_route string, field string, url string"),
        spark.createDataFrame([("/docs/a/p",), ("/docs/a/q",)], "route string"), spark.createDataFrame([("/docs/a/q", "yes")], "route string, anchor string"),
        spark.createDataFrame([("/docs/old", "/docs/new")], "from string, to string"), ["/docs"], ["/docs/gen"],
    )
    assert sorted((r.rule, "moved to" in r.message) for r in got.collect()) == [("invalid-anchor", False), ("invalid-link", False), ("invalid-link", True), ("unresolved-placeholder", False)]


def test_mdx():
    source = 'import A from "a"\n# T\n\n<Steps>\n<Step title="One">\nDo\n</Step>\n<Step>\nThen\n</Step>\n</Steps>\n\n<Tabs items={["b", "a"]}>\n<Tab value="a">AA</Tab>\n<Tab value="b">BB</Tab>\n</Tabs>\n\n```jsx\nimport x from "x"\n<Callout>raw</Callout>\n```\n<Audience target="human">hidden</Audience>\n<FileTree><Folder name="src"><File name="a.ts" /></Folder></FileTree>\n<Unclosed>\n'
    got = mdx.to_markdown(source)
    assert "1. **One**" in got and "2. Then" in got and got.index("#### b") < got.index("#### a")
    assert "<Callout>raw</Callout>" in got and 'import x from "x"' in got and "import A" not in got
    assert "hidden" not in got and "└── src/\n    └── a.ts" in got and "<Unclosed>" in got
    assert mdx.literal("{ a: 'x', b: [1, 2,], }") == {"a": "x", "b": [1, 2]}
    assert mdx.to_markdown("<include>part.md#s</include>", {"docs/part.md": '<section id="s">\nHi\n</section>'}, "docs/a.mdx") == "Hi\n"
    assert mdx.to_markdown('<TypeTable type={{ id: { type: "string", required: true } }} />').endswith("| id | `string` |  | yes |\n")
    assert mdx.to_markdown('<Mine x="1">b</Mine>', handlers={"Mine": lambda n, b: f"[{n.text('x')}:{b}]"}) == "[1:b]\n"
    with pytest.raises(RuntimeError, match="h failed in s"):
        mdx.run_hooks(1, [("h", lambda v: 1 / 0)], "s")


def test_openapi():
    spec = {"openapi": "3.0.0", "a": {"$ref": "#/b"}, "b": {"x": {"$ref": "#/b"}}}
    assert openapi.dereference(spec, spec["a"]) == {"x": {"$ref": "#/b"}}
    assert openapi.label({"type": "array", "items": {"enum": ["a", 1]}}) == '"a" | 1[]'
    assert openapi.example({"type": "object", "properties": {"a": {"type": "array", "items": {"type": "integer"}}}}) == {"a": [0]}
    with pytest.raises(ValueError, match="3.x"):
        openapi.load('{"swagger": "2.0"}')


def test_pages_source(spark, tmp_path):
    (tmp_path / "guide").mkdir()
    (tmp_path / "guide" / "index.mdx").write_text("---\ntitle: Guide\ngroup: start\norder: 2\nlastModified: 2024-01-02\n---\nBody")
    (tmp_path / "a.md").write_text("# Heading A\n\ntext")
    got = {r.url_path: r for r in readers.pages(spark, str(tmp_path)).collect()}
    assert got["/docs/guide"].title == "Guide" and got["/docs/guide"].groups == ["start"] and got["/docs/guide"].ord == 2
    assert got["/docs/guide"].last_modified == "2024-01-02T00:00:00.000Z" and got["/docs/a"].title == "Heading A"
    (tmp_path / "guide.md").write_text("double")
    with pytest.raises(ValueError, match="/docs/guide"):
        readers.pages(spark, str(tmp_path))


def test_rate_limit_stream_agrees_with_batch(spark, tmp_path):
    rng = random.Random(3)
    data = [(c, 100 * c + k, t) for c in (1, 2) for k, t in enumerate(sorted(rng.randrange(10_000) for _ in range(40)))]
    df = spark.createDataFrame(data, "client long, event_id long, ts_ms long")
    batch = rows(limits.rate_limit(df, 3, 1000))
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = limits.rate_limit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 3, 1000)
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("limited")) == batch
    allowed = [r for r in batch if r[3]]
    assert len(allowed) < len(batch)


def test_write_if_changed(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert sinks.write_if_changed(df, str(tmp_path / "t")) is True
    assert sinks.write_if_changed(df, str(tmp_path / "t")) is False


def test_glob():
    import re

    assert re.match(readers.glob_pattern("**/*.md"), "a/b.md") and re.match(readers.glob_pattern("**/*.md"), "b.md")
    assert not re.match(readers.glob_pattern("*.md"), "a/b.md")
