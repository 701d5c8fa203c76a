"""Pass rates, intervals, arm differences and costs over run records (AGG-10 to AGG-19, JOI-28)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

Z = 1.96
CONTROL = "control"


def wilson(n: Column, passes: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % Wilson interval; 0 and 0 without runs (AGG-10)."""
    p, z2 = passes / n, Z * Z
    middle, half = p + z2 / (2 * n), Z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)
    bound = lambda x, least: F.when(n > 0, F.least(F.greatest(x / (1 + z2 / n), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return bound(middle - half, 0), bound(middle + half, 1)


def rates(runs: DataFrame, *keys: str) -> DataFrame:
    """keys, n, passes, rate, low, high, confident_wrong (AGG-10, AGG-11, AGG-13)."""
    g = runs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("passed").alias("passes"), F.count_if(F.col("failure_mode") == "confident_wrong").alias("wrong"))
    low, high = wilson(F.col("n"), F.col("passes"))
    return g.select(*keys, "n", "passes", (F.col("passes") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"), (F.col("wrong") / F.col("n")).alias("confident_wrong"))


def cells(runs: DataFrame) -> DataFrame:
    """Rates by fixture, model and arm, pooled over fixtures, and pooled over models, in one pass (AGG-13)."""
    g = runs.groupingSets([["fixture", "model", "mode"], ["model", "mode"], ["fixture", "mode"]], "fixture", "model", "mode")
    return g.agg(F.count("*").alias("n"), F.count_if("passed").alias("passes"), F.avg(F.col("passed").cast("double")).alias("rate"))


def deltas(runs: DataFrame, control: str = CONTROL) -> DataFrame:
    """(fixture, model, arm, arm_rate, control_rate, delta) against the control of the same fixture and model (JOI-28)."""
    cell = runs.groupBy("fixture", "model", "mode").agg(F.avg(F.col("passed").cast("double")).alias("rate"))
    base = cell.where(F.col("mode") == control).select("fixture", "model", F.col("rate").alias("control_rate"))
    other = cell.where(F.col("mode") != control).select("fixture", "model", F.col("mode").alias("arm"), F.col("rate").alias("arm_rate"))
    return other.join(base, ["fixture", "model"]).withColumn("delta", F.col("arm_rate") - F.col("control_rate"))


def arms(runs: DataFrame, modes: list[str]) -> DataFrame:
    """A row for each model with the rate of every arm (AGG-13)."""
    return runs.groupBy("model").pivot("mode", modes).agg(F.avg(F.col("passed").cast("double")))


def efficiency(runs: DataFrame, control: str = CONTROL) -> DataFrame:
    """(model, arm, tokens, control_tokens, change): mean tokens and their relative change (AGG-12, AGG-13)."""
    cell = runs.groupBy("model", "mode").agg(F.avg("tokens").alias("tokens"))
    base = cell.where(F.col("mode") == control).select("model", F.col("tokens").alias("control_tokens"))
    both = cell.where(F.col("mode") != control).join(base, "model")
    return both.select("model", F.col("mode").alias("arm"), "tokens", "control_tokens", F.try_divide(F.col("tokens") - F.col("control_tokens"), F.col("control_tokens")).alias("change"))


def floor_percentile(values: DataFrame, p: float, *keys: str) -> DataFrame:
    """keys, value: the element at floor(p n) of the sorted values, not interpolated (AGG-14).

    Values are counted first and ranked by running counts, so that no group's values are collected.
    """
    from pyspark.sql import Window

    counted = values.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    ranked = counted.withColumn("upto", F.sum("n").over(w.orderBy("value"))).withColumn("total", F.sum("n").over(w))
    at = F.least(F.floor(F.col("total") * p), F.col("total") - 1)
    return ranked.where(F.col("upto") > at).groupBy(*keys).agg(F.min("value").alias("value"))


def successful_reads(calls: DataFrame) -> DataFrame:
    """Calls of the tool ``read`` that returned a file (FIL-08): neither flagged nor with a result that begins with "error:"."""
    failed = F.coalesce("is_error", F.lit(False)) | F.coalesce(F.col("result").startswith("error:"), F.lit(False))
    return calls.where((F.col("tool") == "read") & ~failed)


def read_path(path: Column | str) -> Column:
    """A path as it is compared: slashes, no leading ./ or /."""
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", ""), "^/+", "")


def read_summary(calls: DataFrame) -> DataFrame:
    """(run_id, reads, read_index, read_full, sections, pages, groups): what each run has read (AGG-17, AGG-18).

    ``calls`` has run_id, tool, path, result, is_error. ``sections`` are groups whose own index was read,
    ``groups`` those whose full bundle was, ``pages`` Markdown pages below docs/. Runs that read nothing
    have a row, too.
    """
    good = successful_reads(calls).where("path is not null").select("run_id", read_path("path").alias("path"))
    name = lambda pattern: F.nullif(F.regexp_extract("path", pattern, 1), F.lit(""))
    page = F.when(F.col("path").startswith("docs/") & F.col("path").endswith(".md") & ~F.col("path").startswith("docs/llms-full/"), F.col("path"))
    some = good.groupBy("run_id").agg(
        F.count("*").alias("reads"), F.bool_or(F.col("path") == "llms.txt").alias("read_index"), F.bool_or(F.col("path") == "llms-full.txt").alias("read_full"),
        F.array_sort(F.collect_set(name(r"^docs/([^/]+)/llms\.txt$"))).alias("sections"), F.array_sort(F.collect_set(page)).alias("pages"),
        F.array_sort(F.collect_set(name(r"^docs/llms-full/([^/]+)\.txt$"))).alias("groups"),
    )
    none = {"reads": F.lit(0), "read_index": F.lit(False), "read_full": F.lit(False)} | {c: F.array().cast("array<string>") for c in ("sections", "pages", "groups")}
    return calls.select("run_id").distinct().join(some, "run_id", "left").withColumns({c: F.coalesce(c, v) for c, v in none.items()})


# Groups of pages by the beginning of their paths.
HOMES = {"docs/authoring/": "authoring", "docs/build/": "build", "docs/reference/": "reference", "docs/quickstart.md": "get-started", "docs/how-it-works.md": "get-started"}


def home(page: Column, homes: dict[str, str] | None = None) -> Column:
    """The group that a page belongs to, null if none: by folder, or by its whole path."""
    out = F.lit(None).cast("string")
    for start, group in (HOMES if homes is None else homes).items():
        out = F.when(page.startswith(start) if start.endswith("/") else page == start, group).otherwise(out)
    return out


def context_matched(reads: DataFrame, expected: DataFrame, homes: dict[str, str] | None = None) -> DataFrame:
    """(run_id, matched, missing, wrong_groups): whether each run's reads fit its layout (AGG-19).

    ``expected`` has run_id, variant, expected_groups and expected_pages. Every run reads the index.
    page-links: all expected pages; explicit-bundles: the groups' bundles; monolith: the full file; router:
    the full file and the bundles; section-indexes: the groups' indexes, and each page or its group's
    bundle; another variant fits nothing. A bundle of another group spoils a match.
    """
    both = expected.join(reads, "run_id", "left")
    have = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    lack = lambda what, c: F.transform(F.array_except(what, have(c)), lambda x: F.concat(F.lit(f"{c}:"), x))
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit(c)))
    bundled = F.filter("expected_pages", lambda p: ~F.array_contains(have("groups"), F.coalesce(home(p, homes), F.lit(""))))
    groups, pages = lack("expected_groups", "groups"), lack("expected_pages", "pages")
    rules = {
        "page-links": pages, "explicit-bundles": groups, "monolith": flag("read_full"), "router": F.concat(flag("read_full"), groups),
        "section-indexes": F.concat(lack("expected_groups", "sections"), lack(bundled, "pages")),
    }
    more = F.array(F.lit("variant"))
    for variant, rule in rules.items():
        more = F.when(F.col("variant") == variant, rule).otherwise(more)
    wrong = F.array_except(have("groups"), "expected_groups")
    out = both.select("run_id", F.concat(flag("read_index"), more).alias("missing"), wrong.alias("wrong_groups"))
    return out.select("run_id", ((F.size("missing") == 0) & (F.size("wrong_groups") == 0)).alias("matched"), "missing", "wrong_groups")


def transient(message: Column | str) -> Column:
    """Whether an error may pass by itself (FIL-09)."""
    message = F.col(message) if isinstance(message, str) else message
    return F.coalesce(message.rlike("(?i)rate.?limit|overloaded|timed? ?out|ECONNRESET|50[0-9]|529"), F.lit(False))
