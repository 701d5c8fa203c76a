"""Views of the driver's tables as the entities of a documentation corpus, in Spark and as DuckDB expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..inputs import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query by its function's name, with the SQL that gives the same rows."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of the driver's; small documents are spread over all cores."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df) if name == "documents" else df


def first_line(text: str = "text") -> Column:
    """The first line of a text."""
    return F.split_part(F.col(text), F.lit("\n"), F.lit(1))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """documents as pages: title of six words, the second line as description."""
    t = F.array_join(F.slice(F.split(first_line(), " "), 1, 6), " ")
    return read(spark, d, "documents").select(
        F.col("doc_id").alias("page_id"), F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("relative_path"), t.alias("title"),
        F.split_part("text", F.lit("\n"), F.lit(2)).alias("description"), F.array("source").alias("groups"), F.col("source").alias("grp"), "lang",
        F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") % 100).alias("ord"), F.concat(F.lit("/docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("content"),
    )


PAGES = r"""(SELECT doc_id AS page_id, lang || '/' || source || '/' || doc_id || '.md' AS relative_path,
  array_to_string(string_split(split_part(text, chr(10), 1), ' ')[1:6], ' ') AS title, split_part(text, chr(10), 2) AS description, source AS grp, lang,
  CASE WHEN doc_id % 7 = 0 THEN doc_id % 100 END AS ord, '/docs/' || lang || '/' || doc_id AS url, text AS content FROM documents)"""


def as_markdown(text: str = "text") -> Column:
    """A text as Markdown: some lines are headings, some stand in fences."""
    head = lambda marks, x: F.concat(F.lit(marks + " "), x)
    line = lambda x, i: (
        F.when(i == 0, head("#", x)).when(i % 5 == 3, head("##", x)).when(i % 7 == 5, head("####", x))
        .when(i % 11 == 10, F.concat(F.lit("```\n"), x, F.lit("\n```"))).otherwise(x)
    )
    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def markdown(spark: SparkSession, d: str) -> DataFrame:
    """documents as Markdown."""
    return read(spark, d, "documents").select(F.col("doc_id").alias("page_id"), as_markdown().alias("content"))


MARKDOWN = r"""(SELECT doc_id AS page_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
  CASE WHEN i = 1 THEN '# ' || x WHEN (i - 1) % 5 = 3 THEN '## ' || x WHEN (i - 1) % 7 = 5 THEN '#### ' || x
  WHEN (i - 1) % 11 = 10 THEN '```' || chr(10) || x || chr(10) || '```' ELSE x END), chr(10)) AS content FROM documents)"""

#: Lines of MARKDOWN with fence parity, and headings outside fences.
LINES = rf"""l0 AS (SELECT page_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS pos FROM {MARKDOWN} m),
l AS (SELECT page_id, pos, line, starts_with(trim(line), '```') AS marker, coalesce(sum(CAST(starts_with(trim(line), '```') AS INT)) OVER
  (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS fenced FROM l0),
h AS (SELECT page_id, pos, length(regexp_extract(trim(line), '^(#{{1,6}})\s+(.+)$', 1)) AS level, regexp_extract(trim(line), '^(#{{1,6}})\s+(.+)$', 2) AS title
  FROM l WHERE NOT fenced AND NOT marker AND regexp_matches(trim(line), '^(#{{1,6}})\s+(.+)$'))"""


def queries(spark: SparkSession, d: str) -> DataFrame:
    """benchmark as search queries, whole."""
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


QUERY = "(SELECT item_id AS query_id, text AS query FROM benchmark)"


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """Pages as chunks, one each, with title and description in the text."""
    p = pages(spark, d)
    text = F.concat_ws("\n\n", "title", F.nullif("description", F.lit("")), "content")
    return p.select(F.col("page_id").alias("chunk_pos"), "url", "title", "description", F.lit("").alias("heading"), text.alias("text"), F.lit("").alias("code"))


CHUNKS = f"""(SELECT page_id AS chunk_pos, url, title, description, title || chr(10) || chr(10) ||
  CASE WHEN description = '' THEN '' ELSE description || chr(10) || chr(10) END || content AS text FROM {PAGES} p)"""


def fold_sql(x: str) -> str:
    """Folding in DuckDB."""
    return f"strip_accents(lower({x}))"


def tokens_sql(x: str) -> str:
    """Search tokens in DuckDB."""
    stop = ", ".join(f"'{w}'" for w in T.STOPWORDS)
    return rf"list_filter(regexp_extract_all({fold_sql(x)}, '[\p{{L}}\p{{N}}]+'), lambda t: length(t) > 1 AND NOT list_contains([{stop}], t))"


def stem_sql(t: str) -> str:
    """Stemming in DuckDB."""
    return (
        f"CASE WHEN length({t}) < 4 THEN {t} WHEN ends_with({t}, 'ies') AND length({t}) > 5 THEN left({t}, length({t}) - 3) || 'y' "
        f"WHEN ends_with({t}, 'ing') AND length({t}) > 6 THEN left({t}, length({t}) - 3) "
        f"WHEN (ends_with({t}, 'ed') OR ends_with({t}, 'es')) AND length({t}) > 5 THEN left({t}, length({t}) - 2) "
        f"WHEN ends_with({t}, 's') AND length({t}) > 4 THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


def squeeze_sql(x: str) -> str:
    """White space squeezed in DuckDB."""
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def clean_sql(x: str) -> str:
    """Markdown cleaned in DuckDB."""
    inner = rf"regexp_replace(regexp_replace({x}, '\[([^\]]+)\]\(([^)]+)\)', '\1', 'g'), '[`*_~>#:\[\](){{}}|]', ' ', 'g')"
    return squeeze_sql(inner)


def slug_sql(x: str) -> str:
    """Heading slugs in DuckDB."""
    return rf"regexp_replace(regexp_replace({fold_sql(x)}, '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')"
