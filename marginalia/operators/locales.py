"""Locales in paths and URLs, and checks of their configuration (STR-23 to STR-25, I18-01 to I18-03, SNK-17)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Locales:
    """The configured locales; the default one has no segment in URLs (I18-01)."""

    names: tuple[str, ...]
    default: str

    def __post_init__(self) -> None:
        if len(set(self.names)) != len(self.names):
            raise ValueError("a locale stands twice")
        if self.default not in self.names:
            raise ValueError(f"the default locale {self.default} isn't configured")


def split_path(path: Column | str, locales: Locales) -> tuple[Column, Column]:
    """(locale, logical path) of a path whose first folder may be a locale (STR-23)."""
    parts = F.split(T.col(path), "/")
    head = F.get(parts, F.lit(0))
    named = head.isin(list(locales.names)) & (F.size(parts) > 1)
    return F.when(named, head).otherwise(F.lit(locales.default)), F.when(named, F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "/")).otherwise(T.col(path))


def localise(url: Column | str, locale: Column | str, locales: Locales, prefix: str = "/docs") -> Column:
    """A URL in a locale: its segment follows the prefix, but for the default (STR-24)."""
    rest = F.substring(T.col(url), len(prefix) + 1, 1 << 30)
    inside = T.within(url, prefix) & (T.col(locale) != locales.default)
    return F.when(inside, F.concat(F.lit(prefix + "/"), T.col(locale), rest)).otherwise(T.col(url))


def locale_of(url: Column | str, locales: Locales, prefix: str = "/docs") -> Column:
    """The locale of a URL (STR-25)."""
    head = F.regexp_extract(T.col(url), f"^{prefix}/([^/?#]+)", 1)
    return F.when(head.isin(list(locales.names)), head).otherwise(F.lit(locales.default))


def without_locale(url: Column | str, locales: Locales, prefix: str = "/docs") -> Column:
    """A URL without its locale's segment (STR-25)."""
    names = "|".join(locales.names)
    return F.regexp_replace(T.col(url), f"^{prefix}/({names})(?=/|$|[?#])", prefix)


def ambiguous(pages: DataFrame) -> DataFrame:
    """Logical paths that a locale holds more than once, which are errors (I18-03)."""
    return pages.groupBy("locale", "logical_path").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1")


def manifest(pages: DataFrame) -> DataFrame:
    """(locale, pages, fallbacks) of localised pages (I18-02, SNK-17)."""
    return pages.groupBy("locale").agg(F.count("*").alias("pages"), F.count_if("is_fallback").alias("fallbacks"))
