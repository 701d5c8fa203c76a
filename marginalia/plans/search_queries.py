"""Queries of the retrieval engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import library as B, retrieval as R
from . import views as V
from .views import query

#: Postings, vocabulary and statistics of CHUNKS in DuckDB.
_INDEX = f"""c AS MATERIALIZED (SELECT chunk_pos, url, title, description, text, {V.tokens_sql('text')} AS toks FROM {V.CHUNKS} x),
f AS (SELECT chunk_pos, 0 AS field, unnest({V.tokens_sql('title')}) AS term, generate_subscripts({V.tokens_sql('title')}, 1) AS place FROM c
  UNION ALL SELECT chunk_pos, 2, unnest({V.tokens_sql("description || ' ' || text")}), generate_subscripts({V.tokens_sql("description || ' ' || text")}, 1) FROM c),
p AS MATERIALIZED (SELECT term, chunk_pos, count(*) FILTER (WHERE field = 0) AS tf_title, count(*) FILTER (WHERE field = 2) AS tf_body, min(field * 1000000 + place) AS seen FROM f GROUP BY ALL),
v AS MATERIALIZED (SELECT term, {V.stem_sql('term')} AS stem, count(*) AS df, min(chunk_pos * 10000000 + seen) AS seen FROM p GROUP BY term),
st AS (SELECT count(*) AS n, greatest(avg(len(toks)), 1) AS avg_length FROM c)"""
_QT = f"q AS (SELECT query_id, query, {V.tokens_sql('query')} AS toks FROM {V.QUERY} b), qt AS (SELECT DISTINCT query_id, unnest(toks) AS token FROM q)"
_SCORE = "ln(1 + (n - df + 0.5) / (df + 0.5)) * (4.0 * tf_title + tf_body) * 2.2 / (4.0 * tf_title + tf_body + 1.2 * (0.25 + 0.75 * len(c.toks) / avg_length))"


_LAST: dict[tuple[str, str], R.Index] = {}


def _index(spark: SparkSession, d: str) -> R.Index:
    """The index of a folder's documents; a session keeps the last one that its queries built."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _LAST:
        for other in list(_LAST):
            if other[0] == key[0]:
                _LAST[other].release()
            del _LAST[other]
        _LAST[key] = R.build(V.chunk_rows(spark, d))
    return _LAST[key]


@query(f"""WITH {_INDEX}, {_QT}, s AS (SELECT query_id, chunk_pos, round(sum({_SCORE}), 6) AS score FROM qt JOIN p ON p.term = qt.token JOIN v ON v.term = qt.token JOIN c USING (chunk_pos), st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_pos) AS rank FROM s) SELECT query_id, rank, chunk_pos, score FROM r WHERE rank <= 8""")
def bm25_exact_topk(spark: SparkSession, d: str) -> DataFrame:
    """SEA-07, SEA-10, JOI-01, AGG-02 to AGG-04: the best eight chunks by exact terms."""
    from pyspark.sql import Window

    index = _index(spark, d)
    exact = R.query_tokens(V.queries(spark, d)).select("query_id", F.col("token").alias("term")).distinct().withColumn("weight", F.lit(1.0))
    scored = R.score(exact, index).withColumn("score", F.round("score", 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_pos"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= R.LIMIT).select("query_id", "rank", "chunk_pos", "score")


@query(f"WITH {_INDEX} SELECT term, count(*) AS df, CAST(sum(tf_title) AS BIGINT) AS title, CAST(sum(tf_body) AS BIGINT) AS body FROM p GROUP BY term")
def postings(spark: SparkSession, d: str) -> DataFrame:
    """SEA-02, SEA-03, AGG-01: the inverted index by term."""
    return _index(spark, d).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf_title").alias("title"), F.sum("tf_body").alias("body"))


_RANK = "(CASE WHEN regexp_matches(term, '^(0|[1-9][0-9]{0,9})$') THEN 0 ELSE 1 END), (CASE WHEN regexp_matches(term, '^(0|[1-9][0-9]{0,9})$') THEN CAST(term AS BIGINT) ELSE 0 END), seen"
_EXPAND = f"""e AS (SELECT query_id, token AS term, 1.0 AS weight FROM qt SEMI JOIN v ON v.term = qt.token
  UNION ALL SELECT query_id, term, 0.82 FROM qt JOIN v ON v.stem = {V.stem_sql('token')} WHERE length({V.stem_sql('token')}) >= 4 AND term <> token
  UNION ALL SELECT query_id, v.term, 0.72 FROM qt JOIN (VALUES {', '.join(f"('{k}', '{t}')" for k, ts in T.SYNONYMS.items() for t in ts)}) y(tok, syn) ON tok = token JOIN v ON v.term = syn
  UNION ALL SELECT query_id, term, 0.55 FROM (SELECT query_id, token, term, row_number() OVER (PARTITION BY query_id, token ORDER BY {_RANK}) AS r FROM qt JOIN v ON starts_with(term, token) WHERE length(token) >= 4 AND term <> token) WHERE r <= 24
  UNION ALL SELECT query_id, term, 0.45 FROM (SELECT query_id, token, term, row_number() OVER (PARTITION BY query_id, token ORDER BY {_RANK}) AS r FROM (SELECT * FROM qt ANTI JOIN v ON v.term = qt.token) u JOIN v ON left(term, 1) = left(token, 1) AND abs(length(term) - length(token)) <= 2
    WHERE length(token) >= 4 AND levenshtein(replace(term, 'ß', '?'), replace(token, 'ß', '?')) <= CASE WHEN length(token) >= 7 THEN 2 ELSE 1 END) WHERE r <= 16),
x AS MATERIALIZED (SELECT query_id, term, max(weight) AS weight FROM e GROUP BY ALL)"""


@query(f"WITH {_INDEX}, {_QT}, {_EXPAND} SELECT query_id, term, CAST(weight AS DOUBLE) AS weight FROM x")
def expand_terms(spark: SparkSession, d: str) -> DataFrame:
    """SEA-04 to SEA-06, JOI-03 to JOI-06: weighted terms of queries, with the caps in dictionary order."""
    return R.expand(V.queries(spark, d), _index(spark, d))


@query(f"""WITH {_INDEX}, {_QT}, {_EXPAND}, s AS (SELECT query_id, chunk_pos, sum({_SCORE} * weight) AS score FROM x JOIN p USING (term) JOIN v USING (term) JOIN c USING (chunk_pos), st GROUP BY ALL)
SELECT query_id, count(*) AS hits, round(max(score), 4) AS best, round(sum(score), 3) AS total FROM s GROUP BY query_id""")
def score_totals(spark: SparkSession, d: str) -> DataFrame:
    """SEA-07 with all expansions: hits and scores of every query."""
    index = _index(spark, d)
    s = R.score(R.expand(V.queries(spark, d), index), index)
    return s.groupBy("query_id").agg(F.count("*").alias("hits"), F.round(F.max("score"), 4).alias("best"), F.round(F.sum("score"), 3).alias("total"))


@query()
def search_full(spark: SparkSession, d: str) -> DataFrame:
    """SEA-08 to SEA-11: ranked hits with phrase and proximity boosts and excerpts; tests hold it against brute force."""
    return R.search(V.queries(spark, d), _index(spark, d))


@query(f"""WITH {_QT}, t AS (SELECT chunk_pos, array_to_string({V.tokens_sql('text')}, ' ') AS t FROM {V.CHUNKS} x), j AS (SELECT query_id, array_to_string(toks, ' ') AS p FROM q WHERE len(toks) >= 2)
SELECT query_id, count(*) AS phrases FROM j JOIN t ON contains(t.t, j.p) GROUP BY query_id""")
def phrase_hits(spark: SparkSession, d: str) -> DataFrame:
    """SEA-08: chunks that hold a query as a phrase; the rarest inner token finds them."""
    return R.phrase_hits(V.queries(spark, d), _index(spark, d)).groupBy("query_id").agg(F.count("*").alias("phrases"))


@query("""WITH RECURSIVE h AS (SELECT conv_id AS query_id, turn + 1 AS rank, text FROM conversations WHERE turn < 6),
s AS (SELECT query_id, CAST(0 AS BIGINT) AS rank, CAST(900 AS BIGINT) AS rest, CAST(0 AS BIGINT) AS got FROM (SELECT DISTINCT query_id FROM h)
  UNION ALL SELECT s.query_id, s.rank + 1, s.rest - coalesce(length(trim(left(h.text, s.rest))), 0), CASE WHEN s.rest > 0 AND coalesce(length(trim(left(h.text, s.rest))), 0) > 0 THEN 1 ELSE 0 END
  FROM s LEFT JOIN h ON h.query_id = s.query_id AND h.rank = s.rank + 1 WHERE s.rank < 6)
SELECT query_id, CAST(sum(got) AS BIGINT) AS sources, CAST(max(rank) FILTER (WHERE got = 1) AS BIGINT) AS last FROM s GROUP BY query_id HAVING sum(got) > 0""")
def answer_budget(spark: SparkSession, d: str) -> DataFrame:
    """SEA-18, WIN-04: sources of answers within a budget of characters."""
    h = V.read(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).cast("int").alias("rank"), F.col("turn").alias("chunk_pos"), "text")
    a = R.answer_context(h, 900, 6)
    return a.groupBy("query_id").agg(F.count("*").alias("sources"), F.max("citation").cast("long").alias("last"))


@query("SELECT query_id, url, rank FROM (SELECT conv_id AS query_id, role AS url, turn AS rank, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations) WHERE r = 1")
def page_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """SEA-19, WIN-08: the first hit of each page."""
    h = V.read(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("role").alias("url"), F.col("turn").alias("rank"))
    return R.first_per_page(h)


@query(f"WITH {_INDEX} SELECT (SELECT count(*) FROM c) AS chunks, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM c) AS content_bytes, (SELECT count(*) FROM v) AS terms, (SELECT count(*) FROM p) AS postings, (SELECT count(*) FROM c) > 10000 AS too_many_chunks, (SELECT sum(strlen(text)) FROM c) > 10485760 AS too_large")
def index_size(spark: SparkSession, d: str) -> DataFrame:
    """SEA-30: the index's size and limits."""
    return R.size_report(_index(spark, d)).select("chunks", F.col("content_bytes").cast("long").alias("content_bytes"), "terms", "postings", "too_many_chunks", "too_large")


@query("SELECT doc_id AS path, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS lines, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    """SEA-28: lines, words and bytes of files."""
    return R.word_count(V.read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")))


@query(r"SELECT path, count(*) AS n FROM (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[Ll]icen[sc]e|password') GROUP BY path")
def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    """SEA-28: lines that match a pattern."""
    lines = V.read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return R.grep(lines, "[Ll]icen[sc]e|password").groupBy("path").agg(F.count("*").alias("n"))


_PARTED: dict[tuple[str, str], R.Index] = {}


def _sectioned(spark: SparkSession, d: str) -> R.Index:
    """The index of a folder's documents as Markdown, by sections and parts; a session keeps the last one."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _PARTED:
        for other in list(_PARTED):
            if other[0] == key[0]:
                _PARTED[other].release()
            del _PARTED[other]
        p = V.pages(spark, d).select("page_id", "url", "title", "description", V.as_markdown("content").alias("content"))
        _PARTED[key] = R.build(R.chunk_parts(p), R.with_texts)
    return _PARTED[key]


@query()
def section_index(spark: SparkSession, d: str) -> DataFrame:
    """SEA-02, ARR-01 to ARR-03: chunks of sections with their four fields; tests hold it against plain Python."""
    c = _sectioned(spark, d).chunks
    return c.select("chunk_pos", "page_id", "anchor", "heading", F.length("text").alias("chars"), F.length("code").alias("code_chars"), "length")


@query()
def section_search(spark: SparkSession, d: str) -> DataFrame:
    """SEA-07 to SEA-11 over sections: title, heading, body and code count."""
    return R.search(V.queries(spark, d), _sectioned(spark, d))


@query(f"SELECT chunk_pos, url, title, description, md5(text) AS digest FROM {V.CHUNKS} c")
def chunk_lookup(spark: SparkSession, d: str) -> DataFrame:
    """SEA-12, SEA-14, SEA-17, JOI-02: every chunk by its id, with its document and text."""
    index = _index(spark, d)
    bare, content = B.detach(index)
    ids = V.read(spark, d, "documents").select(F.col("doc_id").alias("chunk_pos"))
    return B.read_chunks(B.attach(bare, content), ids).select("chunk_pos", "url", "title", "description", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"SELECT url, count(*) AS chunks, md5(string_agg(text, chr(10) || chr(10) ORDER BY chunk_pos)) AS digest FROM {V.CHUNKS} c GROUP BY url")
def content_files(spark: SparkSession, d: str) -> DataFrame:
    """SEA-15, SEA-16: each document's chunks as one text."""
    return B.files(_index(spark, d)).select("url", "chunks", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"SELECT page_id, title, url, [grp] AS groups FROM {V.PAGES} p")
def list_pages(spark: SparkSession, d: str) -> DataFrame:
    """SEA-16, SEA-23: title, URL and groups of all pages."""
    return B.list_pages(V.pages(spark, d))


@query(f"SELECT asked, page_id FROM (SELECT CASE page_id % 4 WHEN 0 THEN url || '.md' WHEN 1 THEN url || '/' WHEN 2 THEN ltrim(url, '/') ELSE url || '/none' END AS asked, page_id % 4 = 3 AS none, page_id FROM {V.PAGES} p) WHERE NOT none")
def get_page(spark: SparkSession, d: str) -> DataFrame:
    """SEA-22, SEA-24, SEA-25: pages by the paths asked for, mirrors and loose slashes included; unknown ones have none."""
    p = V.pages(spark, d)
    k = F.col("page_id") % 4
    asked = F.when(k == 0, F.concat("url", F.lit(".md"))).when(k == 1, F.concat("url", F.lit("/"))).when(k == 2, F.ltrim(F.col("url"), F.lit("/"))).otherwise(F.concat("url", F.lit("/none")))
    return B.get_pages(p.select(asked.alias("asked")), p).select("asked", "page_id")


@query(f"""WITH {_INDEX}, {_QT}, {_EXPAND}
SELECT DISTINCT query_id, 0 AS over FROM x JOIN p USING (term)""")
def ask(spark: SparkSession, d: str) -> DataFrame:
    """SEA-20, SEA-21, SEA-26: a session's answers to every query, ten pages at most; queries with answers are compared."""
    answers = B.Session(_index(spark, d), site="example.com", product="Docs").ask(V.queries(spark, d))
    return answers.groupBy("query_id").agg(F.sum((F.col("place") > 10).cast("int")).cast("int").alias("over"))


@query("SELECT conv_id, turn, regexp_matches(c, '(^|[\\s;&|()])(rm|curl)\\b') OR c LIKE '%>%' OR c LIKE 'sed -i%' AS unsafe FROM (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'grep -n a docs' WHEN 1 THEN 'ls; rm -r docs' WHEN 2 THEN 'cat a > b' WHEN 3 THEN 'sed -i s/a/b/ x' WHEN 4 THEN 'sed s/rmx/b/ x' ELSE 'curl http://x' END AS c FROM conversations)")
def unsafe_commands(spark: SparkSession, d: str) -> DataFrame:
    """SEA-29: commands that would write or reach the network."""
    said = ("grep -n a docs", "ls; rm -r docs", "cat a > b", "sed -i s/a/b/ x", "sed s/rmx/b/ x", "curl http://x")
    c = V.read(spark, d, "conversations").select("conv_id", "turn", F.get(F.array(*map(F.lit, said)), (F.col("turn") % 6).cast("int")).alias("c"))
    return c.select("conv_id", "turn", B.unsafe("c").alias("unsafe"))
