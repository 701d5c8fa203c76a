"""Sources: page trees, in-memory pages, run records, sidebar metadata, commit logs (SRC-*)."""

from __future__ import annotations

import json
import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..inputs import ship

RUN = (
    "benchmark string, fixture string, model string, runIndex int, mode string, variant string, passed boolean, score double, judgeModel string, "
    "failureMode string, usedBundle boolean, toolCalls int, inputTokens long, outputTokens long, durationMs long, errors array<string>"
)


def glob_pattern(pattern: str) -> str:
    """A glob as a regular expression: **/ any folders, ** anything, * within a name (STR-20)."""
    out = re.escape(pattern).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{out}$"


def files(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(relative_path, content) of text files below ``root`` that match globs (SRC-01, SRC-02)."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("p"), F.col("value").alias("content"))
    rows = rows.select(F.regexp_replace("p", "^.*?" + re.escape(root.rstrip("/").removeprefix("file://")) + "/", "").alias("relative_path"), "content")
    match = lambda some: F.greatest(*[F.col("relative_path").rlike(glob_pattern(g)) for g in some], F.lit(False))
    rows = rows.where(match(include)) if include else rows
    return rows.where(~match(exclude)) if exclude else rows


def frontmatter(rows: DataFrame) -> DataFrame:
    """``rows`` with frontmatter as a map of text, by a YAML parser (SRC-09); text that isn't YAML gives an empty one."""

    def parse(text: str | None) -> dict[str, str]:
        import yaml

        m = re.match(r"^---\s*\n([\s\S]*?)\n---\s*\n?", text or "")
        try:
            data = yaml.safe_load(m[1]) if m else {}
        except yaml.YAMLError:
            data = {}
        return {str(k): v if isinstance(v, str) else v.isoformat() if hasattr(v, "isoformat") else json.dumps(v, default=str) for k, v in (data if isinstance(data, dict) else {}).items()}

    def run(s):  # noqa: ANN001, ANN202
        return s.map(parse)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    ship(rows.sparkSession)
    return rows.withColumn("frontmatter", F.pandas_udf(run, "map<string,string>")("content"))


def pages(spark: SparkSession, root: str, mounts: dict[str, str] | None = None) -> DataFrame:
    """Pages of a tree with route, title, description, groups and body (SRC-03 to SRC-08); ValueError if two share a route."""
    rows = frontmatter(files(spark, root, ["**/*.md", "**/*.mdx"]))
    fm = F.col("frontmatter")
    first = lambda name: F.nullif(F.trim(fm[name]), F.lit(""))
    body = T.without_frontmatter("content")
    heading = F.nullif(F.trim(F.regexp_extract(body, r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    raw = F.coalesce(first("groups"), first("group"))
    groups = F.coalesce(F.from_json(raw, "array<string>"), F.when(raw.isNotNull(), F.array(raw)), F.array().cast("array<string>"))
    out = rows.select(
        "relative_path", T.route("relative_path", mounts).alias("url_path"), F.coalesce(first("title"), heading, T.title_from_path("relative_path")).alias("title"),
        first("description").alias("description"), groups.alias("groups"), F.expr("try_cast(frontmatter['order'] as int)").alias("ord"),
        F.expr("try_cast(frontmatter['search'] as boolean)").alias("search"), T.iso_date(F.coalesce(first("lastModified"), first("date"))).alias("last_modified"), body.alias("content"),
    )
    double = out.groupBy("url_path").count().where("count > 1").limit(5).collect()  # at most five, for the message
    if double:
        raise ValueError("routes of more than one page: " + ", ".join(r.url_path for r in double))
    return out


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Pages given in memory (SRC-11)."""
    schema = "relative_path string, url_path string, title string, description string, groups array<string>, ord int, search boolean, content string"
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records, one JSON file each (SRC-22)."""
    r = spark.read.schema(RUN).json(path, multiLine=True, recursiveFileLookup=True)
    return r.select("fixture", "model", "mode", "passed", F.col("failureMode").alias("failure_mode"), F.coalesce(F.col("inputTokens") + F.col("outputTokens"), F.lit(0)).alias("tokens"), F.col("durationMs").alias("duration_ms"))


def sidebar(spark: SparkSession, root: str) -> DataFrame:
    """meta.json files of a tree: title and page order (SRC-23)."""
    r = spark.read.schema("title string, pages array<string>").json(root, multiLine=True, recursiveFileLookup=True, pathGlobFilter="meta.json")
    return r.select(F.col("_metadata.file_path").alias("path"), "title", F.posexplode_outer("pages").alias("pos", "page"))


def commits(spark: SparkSession, repository: str) -> DataFrame:
    """(path, ts, author, seq) of a repository, by one pass over its log (SRC-13, SRC-14)."""
    log = subprocess.run(["git", "-C", repository, "log", "--name-only", "--format=%x01%ct%x02%an"], capture_output=True, text=True, check=True).stdout

    def rows() -> Iterator[tuple[str, int, str, int]]:
        for n, entry in enumerate(log.split("\x01")[1:]):
            head, _, names = entry.partition("\n")
            when, who = head.split("\x02")
            yield from ((p, int(when), who, -n) for p in names.split("\n") if p)

    return spark.createDataFrame(list(rows()), "path string, ts long, author string, seq int").withColumn("ts", F.timestamp_seconds("ts"))


def checkout_mode(has_checkout: bool, manifest_matches: bool, mode: str) -> str:
    """What a remote collection needs (SRC-15): use, clone, update, or fail."""
    if mode == "offline":
        return "use" if has_checkout else "fail"
    if not has_checkout:
        return "clone"
    return "use" if mode == "cached" and manifest_matches else "update"


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """Sources in one, with mount paths (SRC-16, SRC-17, SET-01); ValueError if two give the same path."""
    out = None
    for mount, rows in parts.items():
        rows = rows.withColumn("relative_path", F.concat(F.lit(mount + "/" if mount else ""), F.col("relative_path")))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    double = out.groupBy("relative_path").count().where("count > 1").limit(5).collect()  # at most five, for the message
    if double:
        raise ValueError("paths from more than one source: " + ", ".join(r.relative_path for r in double))
    return out
