"""Text, path, URL and header expressions. Every function maps columns to a column and stays in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Words that carry no meaning in a query.
STOPWORDS = "a an and are as at be by can for from how in is it of on or the to use what when where with".split()
# Built-in synonyms of query tokens.
SYNONYMS = {
    "ai": ["agent", "llm"], "agents": ["ai", "llm"], "api": ["reference", "sdk"], "auth": ["authentication", "login", "signin"],
    "cli": ["command", "terminal"], "config": ["configure", "configuration", "settings", "options"], "docs": ["documentation", "guide", "guides"],
    "error": ["fail", "failure", "broken"], "find": ["search", "lookup"], "install": ["setup", "add"], "llm": ["agent", "ai"],
    "publish": ["deploy", "release"], "search": ["find", "lookup"], "setup": ["install", "configure"], "ts": ["typescript"], "typescript": ["ts"],
}


def col(x: Column | str) -> Column:
    """A column by name, or as it is."""
    return F.col(x) if isinstance(x, str) else x


@lru_cache(maxsize=1)
def folding() -> tuple[str, str]:
    """Latin letters with marks and their bases, for ``translate``: U+00C0 to U+024F that decompose to one letter."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not "̀" <= c <= "ͯ")
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code).lower(), base.lower()))
    pairs = [p for p in dict(pairs).items() if len(p[0]) == 1]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def fold(text: Column | str) -> Column:
    """Lower case without marks, for Latin text (STR-01); combining marks are removed."""
    source, target = folding()
    c = col(text)
    marked = F.regexp_replace(F.translate(F.lower(c), source, target), "[̀-ͯ]", "")
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(marked)  # ASCII alone has no marks


def fold_any(text: Column | str) -> Column:
    """Full compatibility folding (STR-01) by an Arrow UDF, for text beyond Latin letters."""
    import pandas as pd

    def run(s):  # noqa: ANN001, ANN202
        return s.str.normalize("NFKD").str.replace("[\u0300-\u036f]", "", regex=True).str.lower()

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(col(text))


def words(text: Column | str) -> Column:
    """Runs of letters and digits of folded text."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def tokens(text: Column | str) -> Column:
    """Search tokens (STR-02): two characters or more, no stop words, in order."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(words(text), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def stem(token: Column | str) -> Column:
    """Light suffix stemming (STR-03); the first rule that fits holds."""
    t = col(token)
    n = F.length(t)
    cut = lambda k: F.left(t, n - k)
    return (
        F.when(n < 4, t)
        .when(t.endswith("ies") & (n > 5), F.concat(cut(F.lit(3)), F.lit("y")))
        .when(t.endswith("ing") & (n > 6), cut(F.lit(3)))
        .when((t.endswith("ed") | t.endswith("es")) & (n > 5), cut(F.lit(2)))
        .when(t.endswith("s") & (n > 4), cut(F.lit(1)))
        .otherwise(t)
    )


def squeeze(text: Column | str) -> Column:
    """White space to single spaces, trimmed (STR-10)."""
    return F.trim(F.regexp_replace(col(text), r"(?U)\s+", " "))


def slug(heading: Column | str) -> Column:
    """Anchor of a heading (STR-05)."""
    return F.regexp_replace(F.regexp_replace(fold(heading), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def clean_markdown(text: Column | str) -> Column:
    """Markdown as plain text (STR-06): links by their labels, marks as spaces."""
    return squeeze(F.regexp_replace(F.regexp_replace(col(text), r"\[([^\]]+)\]\(([^)]+)\)", "$1"), r"[`*_~>#:\[\](){}|]", " "))


def clean_heading(text: Column | str) -> Column:
    """A heading for a table of contents (STR-07): closing marks and HTML tags go too."""
    bare = F.regexp_replace(F.regexp_replace(col(text), r"\s+#+\s*$", ""), r"<[^>]+>", "")
    return clean_markdown(bare)


def without_frontmatter(text: Column | str) -> Column:
    """Text without a leading frontmatter block (STR-08)."""
    return F.regexp_replace(col(text), r"^---\s*\n[\s\S]*?\n---\s*\n?", "")


def without_title(text: Column | str) -> Column:
    """Text without a leading first-level heading (STR-09)."""
    return F.regexp_replace(col(text), r"^\s*# [^\n]*\n*", "")


def titleise(text: Column | str) -> Column:
    """Words split at - and _, each with a capital first letter (STR-11)."""
    part = F.filter(F.split(col(text), "[-_]"), lambda x: x != "")
    return F.array_join(F.transform(part, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substr(x, F.lit(2)))), " ")


def title_from_path(path: Column | str) -> Column:
    """A page's title by its path (STR-12); index and readme take the folder's name."""
    parts = F.split(F.regexp_replace(col(path), r"\.mdx?$", ""), "/")
    name, folder = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    return titleise(F.when(F.lower(name).isin("home", "index", "readme"), F.coalesce(F.nullif(folder, F.lit("")), F.lit("documentation"))).otherwise(name))


def without_extension(path: Column | str) -> Column:
    """A path without .md or .mdx, and without a closing index segment."""
    return F.regexp_replace(F.regexp_replace(col(path), r"\.mdx?$", ""), r"(^|/)index$", "")


def route(path: Column | str, mounts: dict[str, str] | None = None) -> Column:
    """URL path of a relative path (STR-13, STR-14): the longest mount that holds it gives the prefix, else /docs."""
    out = None
    for source, prefix in [*sorted((mounts or {}).items(), key=lambda m: -len(m[0])), ("", "/docs")]:
        inside = (col(path) == source) | col(path).startswith(source + "/") if source else F.lit(True)
        rest = without_extension(F.regexp_replace(col(path), f"^{source}/?", "") if source else path)
        url = F.when(rest == "", F.lit(prefix)).otherwise(F.concat(F.lit("/" if prefix == "/" else prefix + "/"), rest))
        out = F.when(inside, url) if out is None else out.when(inside, url)
    return out


def mirror(path: Column | str, mounts: dict[str, str] | None = None) -> Column:
    """URL of a page's Markdown mirror (STR-15)."""
    url = route(path, mounts)
    rest = without_extension(F.element_at(F.split(col(path), "/"), -1))
    return F.when((rest != "") & (url != "/"), F.concat(url, F.lit(".md"))).when(url == "/", F.lit("/index.md")).otherwise(F.concat(url, F.lit("/index.md")))


def absolute(url: Column | str, base: str) -> Column:
    """A full URL (STR-16)."""
    return F.when(col(url).rlike("^https?://"), col(url)).otherwise(F.concat(F.lit(base.rstrip("/")), F.when(col(url).startswith("/"), col(url)).otherwise(F.concat(F.lit("/"), col(url)))))


def bare_url(url: Column | str) -> Column:
    """A URL without query, fragment and closing slashes (STR-17)."""
    cut = F.regexp_replace(col(url), r"[?#].*$", "")
    return F.when(cut.rlike("^/+$"), F.lit("/")).otherwise(F.regexp_replace(cut, "/+$", ""))


def within(url: Column | str, prefix: Column | str) -> Column:
    """Whether a URL is ``prefix`` or lies below it (STR-18, FIL-01)."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (col(url) == prefix) | col(url).startswith(F.concat(prefix, F.lit("/")))


def redirect_path(path: Column | str) -> Column:
    """A redirect's path: a leading slash, no closing ones (STR-32)."""
    t = F.trim(col(path))
    cut = F.regexp_replace(F.when(t.startswith("/"), t).otherwise(F.concat(F.lit("/"), t)), "/+$", "")
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def resolve_link(source: Column | str, link: Column | str) -> Column:
    """A relative link against its page's path (STR-19); null where it leaves the tree."""
    folder = F.slice(F.split(col(source), "/"), F.lit(1), F.size(F.split(col(source), "/")) - 1)
    step = lambda a, x: (
        F.when(a.isNull() | (x == "") | (x == "."), a)
        .when(x == "..", F.when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1)))
        .otherwise(F.concat(a, F.array(x)))
    )
    return F.array_join(F.aggregate(F.split(col(link), "/"), folder, step), "/")


def iso_date(text: Column | str) -> Column:
    """A date in ISO form, null where there is none (STR-26)."""
    return F.date_format(F.try_to_timestamp(col(text)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def xml_escape(text: Column | str) -> Column:
    """Text for XML (STR-28); control characters that XML doesn't allow go."""
    out = F.regexp_replace(col(text), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def quoted(text: Column | str) -> Column:
    """A YAML scalar in double quotes (STR-29)."""
    return F.concat(F.lit('"'), F.regexp_replace(col(text), r'(["\\])', r"\\$1"), F.lit('"'))


def json_in_html(text: Column | str) -> Column:
    """JSON that can stand in a script element (STR-30)."""
    out = col(text)
    for mark, name in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), (" ", "\\u2028"), (" ", "\\u2029")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


#: White space as JavaScript's patterns have it.
WHITE = r"[\s\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def query_text(query: Column | str) -> Column:
    """A query with white space squeezed and trimmed."""
    return F.trim(F.regexp_replace(col(query), WHITE, " "))


def query_status(query: Column | str, most: int = 400) -> Column:
    """HTTP status of a search query (STR-31): 400 empty or control characters, 413 too long once squeezed, else 200."""
    q = query_text(query)
    return F.when(col(query).isNull() | (q == ""), 400).when(F.length(q) > most, 413).when(q.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), 400).otherwise(200)


def fill_placeholders(text: Column | str, values: dict[str, str]) -> Column:
    """{key} and {key:fallback} by values, and by the fallback where a key is unknown (STR-21)."""
    out = col(text)
    for key, value in values.items():
        out = F.regexp_replace(out, r"\{" + key + r"(:[^{}]*)?\}", value)
    return F.regexp_replace(out, r"\{[A-Za-z_][A-Za-z0-9_.]*:([^{}]*)\}", "$1")


def has_placeholder(text: Column | str) -> Column:
    """Whether a placeholder is left (FIL-10)."""
    return col(text).rlike(r"\{[A-Za-z_][A-Za-z0-9_.]*(:[^{}]*)?\}")


def framework(url: Column | str) -> Column:
    """The framework of a docs URL (STR-22); null if none."""
    return F.nullif(F.regexp_extract(col(url), "/docs/frameworks/([^/?#]+)", 1), F.lit(""))


def accept_quality(accept: Column | str, kinds: str) -> Column:
    """The highest q of the media types in an Accept header that match ``kinds`` (STR-34)."""
    part = F.filter(F.transform(F.split(col(accept), ","), lambda s: F.trim(s)), lambda s: s.rlike("(?i)" + kinds))
    q = lambda s: F.least(F.coalesce(F.nullif(F.regexp_extract(s, r"(?i);\s*q\s*=\s*(\d(?:\.\d+)?)", 1), F.lit("")).cast("double"), F.lit(1.0)), F.lit(1.0))
    return F.coalesce(F.array_max(F.transform(part, q)), F.lit(0.0))


def prefers_markdown(accept: Column | str) -> Column:
    """Whether Markdown beats HTML in an Accept header (STR-35)."""
    md, html = accept_quality(accept, "text/(markdown|plain)"), accept_quality(accept, "text/html")
    return F.coalesce((md > 0) & ((html <= 0) | (md > html)), F.lit(False))


def content_hash(text: Column | str, digits: int = 16) -> Column:
    """The first hex digits of SHA-256 of trimmed text (STR-37)."""
    return F.left(F.sha2(F.trim(col(text)).cast("binary"), 256), F.lit(digits))


def excerpt(text: Column | str, terms: Column) -> Column:
    """What stands around the first of ``terms`` that occurs (STR-43): 80 before to 160 after, or the first 220."""
    t = col(text)

    def cut(at: Column) -> Column:
        start, end = F.greatest(F.lit(0), at - 81), F.least(F.length(t), at + 159)
        middle = F.trim(F.substring(t, start + 1, end - start))
        around = F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), middle, F.when(end < F.length(t), F.lit("...")).otherwise(F.lit("")))
        return F.when(at == 0, F.trim(F.left(t, F.lit(220)))).otherwise(around)

    hit = F.transform(F.array(fold(t)), lambda low: _first_hit(low, terms))  # arrays of one, so that each is computed once
    return F.element_at(F.transform(hit, cut), 1)


def _first_hit(low: Column, terms: Column) -> Column:
    """1-based place of the first of ``terms`` that occurs in ``low``; 0 if none does."""
    return F.aggregate(terms, F.lit(0), lambda a, x: F.when(a > 0, a).otherwise(F.position(x, low)))


def first_heading(body: Column | str) -> Column:
    """A page's title by its first heading, null if it has none (STR-38)."""
    return F.nullif(clean_heading(F.regexp_extract(col(body), r"(?m)^#{1,6}\s+(.+)$", 1)), F.lit(""))


def first_paragraph(body: Column | str, most: int = 200) -> Column:
    """A page's description by its first paragraph of prose (STR-38): no heading, list, table, quote, fence or tag."""
    prose = F.filter(F.split(F.trim(col(body)), r"\n\s*\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^(#|```|~~~|<|[-*+] |\d+\. |\||>)"))
    return F.nullif(F.left(clean_markdown(F.get(prose, F.lit(0))), F.lit(most)), F.lit(""))


def enriched(frontmatter: Column | str, url: Column, aliases: Column) -> Column:
    """A frontmatter map with url and aliases, which it may have itself (STR-40)."""
    more = F.map_from_arrays(F.array(F.lit("url"), F.lit("aliases")), F.array(url, F.array_join(aliases, ",")))
    kept = F.map_filter(more, lambda k, v: ~F.map_contains_key(col(frontmatter), k) & v.isNotNull() & (v != ""))
    return F.map_concat(col(frontmatter), kept)


def fill_values(values: Column | str, known: dict[str, str]) -> Column:
    """A map of text or JSON with placeholders filled in every value, however deep (ARR-14)."""
    return F.transform_values(col(values), lambda k, v: fill_placeholders(v, known))  # noqa: ARG005


def output_path(path: Column | str) -> Column:
    """Where a page's Markdown goes (MDX-30)."""
    return F.regexp_replace(col(path), r"\.mdx?$", ".md")
