"""Checks of components, JSON-LD and code snippets, and reports of findings (LNT-07 to LNT-10, LNT-12, ARR-15, ARR-18, SNK-12, SNK-18)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..inputs import ship
from . import mdx, structure
from .checks import violation


def leaking_components(pages: DataFrame) -> DataFrame:
    """Components outside fences that no handler knows (LNT-07)."""
    free = structure.lines(pages).where(~F.col("fenced") & ~F.col("marker"))
    used = free.select("page_id", F.explode(F.regexp_extract_all("line", F.lit("<([A-Z][A-Za-z0-9]*)"), F.lit(1))).alias("name")).distinct()
    return used.where(~F.col("name").isin(sorted(mdx.HANDLERS)))


def json_ld_problems(rows: DataFrame) -> DataFrame:
    """(page_id, problem) of JSON-LD texts (LNT-08, ARR-18): not JSON, no type, or a date that is none."""
    j = lambda p: F.get_json_object("json", p)
    parsed = F.try_parse_json("json").isNotNull()
    date = j("$.dateModified")
    problem = F.when(~parsed, "not JSON").when(j("$['@type']").isNull(), "no type").when(date.isNotNull() & F.try_to_timestamp(date).isNull(), "bad date")
    return rows.select("page_id", problem.alias("problem")).where("problem is not null")


def snippets(pages: DataFrame) -> DataFrame:
    """(page_id, block, lang, code) of fenced blocks (LNT-12)."""
    from pyspark.sql import Window

    rows = structure.lines(pages).where(F.col("fenced") | F.col("marker"))
    opens = F.col("marker") & ~F.col("fenced")
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("block", F.sum(opens.cast("int")).over(w)).withColumn("lang", F.when(opens, F.lower(F.regexp_extract(F.trim("line"), r"^`+\s*([A-Za-z0-9+-]*)", 1))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("marker"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return rows.groupBy("page_id", "block").agg(F.max("lang").alias("lang"), body.alias("code"))


def relaxed_json(code: Column | str) -> Column:
    """JSON without comments and trailing commas (LNT-10)."""
    code = F.col(code) if isinstance(code, str) else code
    bare = F.regexp_replace(F.regexp_replace(code, r"/\*[\s\S]*?\*/", ""), r"(?m)(^|[\s,{\[])//[^\n]*$", "$1")
    return F.regexp_replace(bare, r",(\s*[}\]])", "$1")


def broken_snippets(pages: DataFrame) -> DataFrame:
    """(page_id, block, lang) of JSON, JSONC and YAML snippets that don't parse (LNT-09)."""
    rows = snippets(pages)
    plain = F.when(F.col("lang") == "json", F.try_parse_json("code").isNull()).when(F.col("lang").isin("jsonc", "json5"), F.try_parse_json(relaxed_json("code")).isNull())
    bad = rows.where(plain).select("page_id", "block", "lang")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        def fails(code: str) -> bool:
            try:
                list(yaml.safe_load_all(code))
            except yaml.YAMLError:
                return True
            return False

        for pdf in batches:
            yield pdf[[fails(c) for c in pdf["code"]]][["page_id", "block", "lang"]]

    some = rows.where(F.col("lang").isin("yaml", "yml"))
    kinds = dict(rows.dtypes)
    ship(rows.sparkSession)
    return bad.union(some.mapInPandas(run, f"page_id {kinds['page_id']}, block {kinds['block']}, lang string"))


def urls_in(values: DataFrame) -> DataFrame:
    """(page_id, field, url) of URLs anywhere in a map of JSON or text values (ARR-15)."""
    each = values.select("page_id", F.explode("frontmatter").alias("field", "value"))
    return each.select("page_id", "field", F.explode(F.regexp_extract_all("value", F.lit(r"""((?:https?://|/docs/)[^\s"'\],}]+)"""), F.lit(1))).alias("url"))


def snippet_findings(bad: DataFrame) -> DataFrame:
    """Findings for snippets that don't parse."""
    return bad.select(*violation(F.col("page_id").cast("string"), "snippet:parse", "error", F.col("lang"), F.concat(F.lit("block "), F.col("block").cast("string"))))


def report(found: DataFrame, style: str = "pretty") -> DataFrame:
    """(line) of findings: pretty, json or github (SNK-18)."""
    field = F.coalesce(F.concat(F.lit(" "), F.col("field")), F.lit(""))
    if style == "json":
        return found.select(F.to_json(F.struct(*found.columns)).alias("line"))
    if style == "github":
        kind = F.when(F.col("severity") == "error", "error").otherwise("warning")
        return found.select(F.concat(F.lit("::"), kind, F.lit(" file="), "file", F.lit("::["), "rule", F.lit("] "), "message").alias("line"))
    return found.select(F.concat("file", F.lit(": "), "severity", F.lit(" "), "rule", field, F.lit(": "), "message").alias("line"))


def digests(files: DataFrame) -> DataFrame:
    """(path, sha256, bytes) of (path, content): a manifest with digests (SNK-12)."""
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))
