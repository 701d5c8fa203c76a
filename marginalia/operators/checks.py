"""Lint rules, their summary, and the readiness score (LNT-*, JOI-12 to JOI-14, AGG-05 to AGG-09, FIL-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

NON_DOC = r"(?i)\.(png|jpe?g|gif|svg|webp|ico|pdf|zip|tar|gz|mp4|webm|css|js|json|xml|txt|ya?ml)$"
SEVERITIES = ("error", "warn", "off")


def violation(file: Column, rule: Column | str, severity: Column | str, field: Column, message: Column) -> list[Column]:
    """Columns of a finding."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return [file.alias("file"), lit(rule).alias("rule"), lit(severity).alias("severity"), field.alias("field"), message.alias("message")]


def link_violations(links: DataFrame, routes: DataFrame, anchors: DataFrame, moved: DataFrame, prefixes: list[str], assume: list[str] | None = None) -> DataFrame:
    """(file, rule, severity, field, message): at most one finding for each link (JOI-12, JOI-13, JOI-14, FIL-01, FIL-02).

    ``links`` has file, source_path, current_route, field and url; ``routes`` route; ``anchors`` route and
    anchor; ``moved`` from and to. The first rule that applies holds: placeholders; outside the tree;
    another framework; no such route, with a hint where it moved; no such anchor on a known page.
    """
    inside = lambda url, some: F.coalesce(F.greatest(*[T.within(url, p) for p in some], F.lit(False)), F.lit(False))
    path = F.regexp_replace("url", "#.*$", "")
    anchor = F.nullif(F.regexp_extract("url", "#(.*)$", 1), F.lit(""))
    relative = F.col("path").startswith("./") | F.col("path").startswith("../")
    resolved = T.resolve_link("source_path", "path")
    rows = links.withColumns({"path": path, "anchor": anchor}).withColumns({"relative": relative, "resolved": resolved})
    target = F.when(F.col("path") == "", F.col("current_route")).when(inside(F.col("path"), prefixes), T.bare_url("path")).when(F.col("relative") & F.col("resolved").isNotNull(), T.route("resolved"))
    skip = F.col("relative") & F.col("path").rlike(NON_DOC)
    rows = rows.withColumn("target", F.when(~skip, target)).withColumn("escapes", F.col("relative") & ~skip & F.col("resolved").isNull())
    rows = rows.where(T.has_placeholder("url") | F.col("escapes") | F.col("target").isNotNull())
    if assume:
        rows = rows.where(T.has_placeholder("url") | F.col("escapes") | ~inside(F.col("target"), assume))
    known = routes.select(F.col("route").alias("target"), F.lit(True).alias("live")).distinct()
    spots = anchors.select(F.col("route").alias("target"), "anchor", F.lit(True).alias("found")).distinct()
    paged = anchors.select(F.col("route").alias("target"), F.lit(True).alias("scanned")).distinct()
    hints = moved.select(F.col("from").alias("target"), F.col("to").alias("hint")).dropDuplicates(["target"])
    rows = rows.join(known, "target", "left").join(hints, "target", "left").join(paged, "target", "left").join(spots, ["target", "anchor"], "left")
    mine, theirs = T.framework("current_route"), T.framework("target")
    rule = (
        F.when(T.has_placeholder("url"), "unresolved-placeholder").when(F.col("escapes"), "invalid-link")
        .when(mine.isNotNull() & theirs.isNotNull() & (mine != theirs), "cross-framework-link")
        .when(F.col("live").isNull(), "invalid-link").when(F.col("anchor").isNotNull() & F.col("scanned") & F.col("found").isNull(), "invalid-anchor")
    )
    said = (
        F.when(T.has_placeholder("url"), F.concat(F.lit("unresolved placeholder in "), F.col("url")))
        .when(F.col("escapes"), F.concat(F.col("url"), F.lit(" leaves the docs tree")))
        .when(rule == "cross-framework-link", F.concat(F.col("target"), F.lit(" belongs to "), theirs))
        .when((rule == "invalid-link") & F.col("hint").isNotNull(), F.concat(F.col("target"), F.lit(" moved to "), F.col("hint")))
        .when(rule == "invalid-link", F.concat(F.lit("no route "), F.col("target"))).otherwise(F.concat(F.lit("no anchor "), F.col("target"), F.lit("#"), F.col("anchor")))
    )
    return rows.select(*violation(F.col("file"), rule, "error", F.col("field"), said)).where("rule is not null")


def frontmatter_violations(pages: DataFrame, required: list[str], allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """Missing fields are errors, values that aren't allowed are as well (LNT frontmatter rules); ``pages`` has file and the fields."""
    found = []
    for name in required:
        empty = F.col(name).isNull() | (F.trim(F.col(name).cast("string")) == "")
        found.append(F.when(empty, F.struct(*violation(F.col("file"), "frontmatter", "error", F.lit(name), F.lit(f"{name} is missing")))))
    for name, values in (allowed or {}).items():
        found.append(F.when(~F.col(name).isin(values), F.struct(*violation(F.col("file"), "frontmatter", "error", F.lit(name), F.concat(F.lit(f"{name} can't be "), F.col(name))))))
    return pages.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("v")).select("v.*")


def structure_violations(skips: DataFrame, empty: DataFrame) -> DataFrame:
    """Warnings for skipped heading levels and pages without a heading (LNT-05, LNT-06)."""
    a = skips.select(*violation(F.col("page_id").cast("string"), "geo:heading-skip", "warn", F.col("title"), F.concat(F.lit("level "), F.col("level").cast("string"), F.lit(" after "), F.col("before").cast("string"))))
    b = empty.select(*violation(F.col("page_id").cast("string"), "geo:no-heading", "warn", F.lit(None).cast("string"), F.lit("no heading")))
    return a.union(b)


def override(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with their rules' severities changed by (rule, to); ``off`` drops them (AGG-06)."""
    both = found.join(rules, "rule", "left").withColumn("severity", F.coalesce("to", "severity")).drop("to")
    return both.where("severity <> 'off'").select("file", "rule", "severity", "field", "message")


def summary(found: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, errors, warnings, and whether the run fails (AGG-05)."""
    counts = found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))
    return files.agg(F.countDistinct("file").alias("files")).crossJoin(counts).withColumn("failed", F.col("errors") > 0)


def readiness(signals: DataFrame) -> DataFrame:
    """(dimension, points, most, score) of (dimension, id, points, max), with a total (AGG-07, AGG-08)."""
    s = signals.rollup("dimension").agg(F.sum("points").alias("points"), F.sum("max").alias("most"))
    return s.select(F.coalesce("dimension", F.lit("total")).alias("dimension"), "points", "most", F.when(F.col("most") > 0, F.floor(100 * F.col("points") / F.col("most") + 0.5)).otherwise(0).cast("long").alias("score"))


def coverage(pages: DataFrame) -> DataFrame:
    """One row: share of pages with a description, and whether all have title, description and date (AGG-09)."""
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    full = has(F.col("title")) & has(F.col("description")) & F.col("last_modified").isNotNull()
    return pages.agg(F.coalesce(F.avg(has(F.col("description")).cast("double")), F.lit(0.0)).alias("described"), F.coalesce(F.bool_and(full), F.lit(False)).alias("complete"))
