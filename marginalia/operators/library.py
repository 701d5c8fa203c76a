"""Readers and tools over an index: chunks, files, page lists, answers, guards (SEA-12, SEA-14 to SEA-17, SEA-20 to SEA-26, SEA-29, JOI-02)."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from . import retrieval as R

#: Results: /ask by default, tools by default, and at most.
ASK_LIMIT, TOOL_LIMIT, MOST = 10, 5, 50
# Commands that a read-only shell refuses.
WRITERS = "rm mv cp touch mkdir chmod curl wget python python3 node js-exec tee".split()


def detach(index: R.Index) -> tuple[R.Index, DataFrame]:
    """An index without texts, and (chunk_pos, text): how an index and its content are stored apart."""
    return replace(index, chunks=index.chunks.drop("text"), kept=[]), index.chunks.select("chunk_pos", "text")


def attach(index: R.Index, content: DataFrame) -> R.Index:
    """An index with the texts of ``content`` (SEA-17); a chunk without one keeps an empty text."""
    chunks = index.chunks.drop("text").join(content.select("chunk_pos", "text"), "chunk_pos", "left")
    return replace(index, chunks=chunks.withColumn("text", F.coalesce("text", F.lit(""))), kept=[])


def documents(index: R.Index) -> DataFrame:
    """(url, title, description): the documents of an index (SEA-16)."""
    return index.chunks.groupBy("url").agg(F.min("title").alias("title"), F.min("description").alias("description"))


def read_chunks(index: R.Index, ids: DataFrame) -> DataFrame:
    """The chunks named in ``ids`` (chunk_pos), with their documents' fields (SEA-12, SEA-14, JOI-02); unknown ids have none."""
    return ids.select("chunk_pos").distinct().join(index.chunks.drop("title", "description", "tokens"), "chunk_pos").join(documents(index), "url")


def files(index: R.Index) -> DataFrame:
    """(url, title, description, chunks, text): each document's chunks in order, as one text (SEA-15). A row holds one document."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_pos", "text"))), lambda x: x["text"]), "\n\n")
    return index.chunks.groupBy("url").agg(F.min("title").alias("title"), F.min("description").alias("description"), F.count("*").alias("chunks"), text.alias("text"))


def list_pages(pages: DataFrame) -> DataFrame:
    """(page_id, title, url, groups) of all pages (SEA-23)."""
    return pages.select("page_id", "title", "url", "groups")


def page_path(path: Column | str) -> Column:
    """A page's path as it is compared: trimmed, without extension and closing slashes, with a leading one."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(T.col(path)), r"(?i)\.mdx?$", ""), "/+$", "")
    return F.when(bare == "", F.lit("/")).when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))


def get_pages(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """The page of each path in ``asked`` (asked), by its route or its mirror's (SEA-22, SEA-24); unknown paths have none (SEA-25)."""
    return asked.withColumn("path_", page_path("asked")).join(pages.withColumn("path_", page_path("url")), "path_").drop("path_")


def clamped(limit: float | None, default: int, most: int = MOST) -> int:
    """A limit between 1 and ``most``; the default where there is none (SEA-20)."""
    return default if limit is None or not math.isfinite(limit) else min(max(math.floor(limit), 1), most)


def unsafe(command: Column | str) -> Column:
    """Whether a shell command may write or reach the network (SEA-29): a refused command, sed in place, or a redirection into a file."""
    c = T.col(command)
    refused = c.rlike(r"(^|[\s;&|()])(" + "|".join(WRITERS) + r")\b")
    in_place = c.rlike(r"\bsed\b") & c.rlike(r"(^|[\s;&|])(-[A-Za-z]*i[A-Za-z]*|--in-place)(=|\s|$)")
    return F.coalesce(refused | in_place | c.rlike(r"(^|[^<])>"), F.lit(False))


@dataclass
class Session:
    """An open index and what is asked of it (SEA-26)."""

    index: R.Index
    site: str = ""
    product: str = "Documentation"

    def search(self, queries: DataFrame, limit: float | None = None) -> DataFrame:
        """Hits as the search tools give them: title, url, snippet (SEA-21, SEA-25)."""
        hits = R.search(queries, self.index, clamped(limit, TOOL_LIMIT))
        return hits.join(documents(self.index).select("url", "title"), "url").select("query_id", "rank", "title", "url", F.col("excerpt").alias("snippet"), "score")

    def ask(self, queries: DataFrame, limit: float | None = None) -> DataFrame:
        """(query_id, place, url, name, site, score, description, schema_object): the best chunk of each page among the best ``limit`` (SEA-19, SEA-20)."""
        hits = R.first_per_page(R.search(queries, self.index, clamped(limit, ASK_LIMIT)))
        both = hits.join(documents(self.index), "url").withColumn("description", F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("excerpt")))
        part = F.struct(F.lit("WebSite").alias("@type"), F.lit(self.product).alias("name")).alias("isPartOf")
        thing = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("TechArticle").alias("@type"), "url", F.col("title").alias("name"), "description", part)
        return both.select("query_id", F.col("rank").alias("place"), "url", F.col("title").alias("name"), F.lit(self.site).alias("site"), "score", "description", F.to_json(thing).alias("schema_object"))

    def documents(self) -> DataFrame:
        """The documents of the index."""
        return documents(self.index)

    def files(self) -> DataFrame:
        """The documents' texts."""
        return files(self.index)
