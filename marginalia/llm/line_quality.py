"""Operator 3: quality rules by the frequency of lines across documents, in DataFrame functions only.

Normalised lines are hashed; for each host, the distinct documents that hold a line are counted, where
documents with the same set of lines count as one. Lines above the limit are boilerplate and are removed,
alone or in blocks; a document that loses most of its words is depleted and is rejected. Copies of a
whole document share their set of lines, so a group of copies isn't boilerplate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import free, materialize

#: ASCII white space, which parts words.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: A line is boilerplate in more documents of its host, copies counted once, than these.
MAX_DOCS = 20
#: A document keeps at least this percentage of its words, or is depleted.
LEAST_LEFT = 30
LEAST_WORDS, MAX_REPEATED = 50, 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of ``text`` (no nulls) as an array."""
    return let(F.btrim(text, F.lit(BLANKS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+")))


def lines(text: Column) -> Column:
    """The lines of ``text`` that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))


def normalised(line: Column) -> Column:
    """A line with A-Z lower-cased, white space squeezed and trimmed."""
    return F.translate(F.regexp_replace(F.btrim(line, F.lit(BLANKS)), r"\s+", " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeated_words(w: Column) -> Column:
    """Words in windows of three that the array ``w`` has twice or more, each word once."""

    def covered(h: Column) -> Column:
        def starts(s: Column) -> Column:
            other = lambda i: F.get(s, i)["h"]
            return F.sort_array(F.filter(F.transform(s, lambda x, i: F.when((other(i - 1) == x["h"]) | (other(i + 1) == x["h"]), x["i"])), lambda p: p.isNotNull()))

        def total(p: Column) -> Column:
            none = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
            return F.aggregate(p, none, lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, lambda s: let(starts(s), total)))

    threes = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(threes, covered)).cast("long")


def measures(docs: DataFrame, host: Column) -> DataFrame:
    """One row a document: base counts, and the hash and words of each line that has a word."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(host.cast("string"), F.lit("")).alias("host"), text.alias("text"))
    rows = rows.select("doc_id", "host", "text", F.xxhash64("text").alias("said"), words(F.col("text")).alias("w"), lines(F.col("text")).alias("l"))
    return rows.select(
        "doc_id", "host", "said", F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.transform("l", lambda x: F.xxhash64(normalised(x))).alias("line"),
        F.transform("l", lambda x: F.size(F.split(F.btrim(x, F.lit(BLANKS)), r"\s+"))).alias("line_words"),
    )


def boilerplate(rows: DataFrame, max_docs: int) -> DataFrame:
    """(host, line) of lines in more than ``max_docs`` distinct sets of lines of the host."""
    held = rows.select("host", F.array_sort(F.array_distinct("line")).alias("line"))
    apart = held.withColumn("copy", F.xxhash64("line")).dropDuplicates(["host", "copy"])
    return apart.select("host", F.explode("line").alias("line")).groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs).select("host", "line")


def fails(n_words: Column, n_repeat_words: Column) -> Column:
    """Whether a document fails by its own words."""
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MAX_REPEATED * n_words)


def line_quality(docs: DataFrame, host: Column | None = None, max_docs: int = MAX_DOCS, least_left: int = LEAST_LEFT) -> DataFrame:
    """The rules' measures and verdict for every document.

    Takes doc_id, text and what ``host`` (by default source) needs. A null text has no words, a null host
    is a host of its own. Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_removed_words, and ``bad_lines``, the hashes of lines to remove (null: none).
    A document of fewer than LEAST_WORDS words, or with more than MAX_REPEATED percent in repeated
    windows, fails; so does one of which less than ``least_left`` percent of the words would stay. Rows
    that repeat a doc_id are judged each by their own text, with the lines found for any of them; those
    without a doc_id keep all lines. An empty table gives no rows.
    """
    return _judged(docs, host, max_docs, least_left).drop("said")


def _judged(docs: DataFrame, host: Column | None = None, max_docs: int = MAX_DOCS, least_left: int = LEAST_LEFT) -> DataFrame:
    """``line_quality`` with a hash of each row's text in ``said``."""
    rows = materialize(measures(docs, F.col("source") if host is None else host))
    bad = boilerplate(rows, max_docs)
    hit = rows.select("doc_id", "host", F.explode(F.array_distinct("line")).alias("line")).join(bad, ["host", "line"])
    hit = hit.groupBy("doc_id").agg(F.collect_set("line").alias("bad_lines"))
    gone = F.aggregate(F.zip_with("line", "line_words", lambda x, n: F.when(F.array_contains("bad_lines", x), n).otherwise(0)), F.lit(0), lambda a, n: a + n)
    removed = F.when(F.col("bad_lines").isNull(), F.lit(0)).otherwise(gone).cast("long")
    failed = fails(F.col("n_words"), F.col("n_repeat_words"))
    out = rows.join(hit, "doc_id", "left").withColumn("n_removed_words", removed).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (100 * (F.col("n_words") - F.col("n_removed_words")) >= least_left * F.col("n_words"))
    return out.select("doc_id", "said", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_removed_words", "bad_lines")


def without_boilerplate(docs: DataFrame, **limits: int) -> DataFrame:
    """``docs`` without rejected documents and, in those that stay, without boilerplate lines; all rows of these and all columns stay.

    A row finds its verdict by doc_id and text, so that rows which repeat a doc_id, or have none, are
    judged as ``line_quality`` says; columns may have any names.
    """
    of, said, bad = (free(x, docs.columns) for x in ("of_", "said_", "bad_"))
    told = _judged(docs, **limits).where("kept").select(F.col("doc_id").alias(of), F.col("said").alias(said), F.col("bad_lines").alias(bad)).dropDuplicates([of, said])
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(bad, F.xxhash64(normalised(x)))), "\n")
    changed = F.col(bad).isNotNull()
    new = {"text": F.when(changed, left).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(new["text"]).cast("long")).otherwise(F.col("n_chars"))
    joined = docs.join(told, F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(said)))
    return joined.select([new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS pos FROM d),
t AS (SELECT doc_id, pos, word, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, word, w1, w2) AS n FROM t WHERE w2 IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY doc_id),
l0 AS (SELECT doc_id, host, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line,
       generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')), 1) AS pos FROM d),
l AS (SELECT doc_id, host, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS line_words,
      translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM l0),
held AS (SELECT DISTINCT host, lines FROM (SELECT host, doc_id, list_sort(list(DISTINCT norm)) AS lines FROM l GROUP BY host, doc_id)),
bad AS (SELECT host, norm FROM (SELECT host, unnest(lines) AS norm FROM held) GROUP BY host, norm HAVING count(*) > 20),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id),
gone AS (SELECT doc_id, sum(line_words) AS n FROM l JOIN bad USING (host, norm) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN n USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * (n_words - n_removed_words) >= 30 * n_words AS kept, n_removed_words
FROM f
"""
