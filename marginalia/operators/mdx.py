"""MDX to Markdown: a tolerant scanner, a registry of component handlers, and the conversion of a corpus (MDX-*, UDF-*)."""

from __future__ import annotations

import json
import re
import textwrap
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..inputs import ship
from ..scratch import materialize

#: Components, and the HTML elements that are treated as such.
_NAME = r"(?:[A-Z][A-Za-z0-9]*|details|summary)"
_OPEN = re.compile(rf"<({_NAME})" + r"((?:\s+[A-Za-z_:][\w:.-]*(?:=(?:\"[^\"]*\"|'[^']*'|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}))?)*)\s*(/?)>")
_ATTR = re.compile(r"([A-Za-z_:][\w:.-]*)(?:=(?:\"([^\"]*)\"|'([^']*)'|\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}))?")
_FENCE = re.compile(r"^\s*(```+|~~~+)")
# Marks and labels of callouts; what package managers are told in each mode.
_CALLOUTS = {
    "info": "ℹ️ Info", "note": "📝 Note", "tip": "💡 Tip", "warn": "⚠️ Warning", "warning": "⚠️ Warning", "success": "✅ Success", "error": "❌ Error",
    "canary": "🐤 Canary", "deprecated": "🚫 Deprecated", "experimental": "🧪 Experimental",
}
_MANAGERS = {
    "run": {"npm": "npx", "pnpm": "pnpm dlx", "yarn": "yarn dlx", "bun": "bunx"},
    "install": {"npm": "npm install", "pnpm": "pnpm add", "yarn": "yarn add", "bun": "bun add"},
    "create": {"npm": "npm create", "pnpm": "pnpm create", "yarn": "yarn create", "bun": "bun create"},
}


@dataclass
class Node:
    """A component: its name, properties, and children (text or nodes)."""

    name: str
    props: dict[str, object] = field(default_factory=dict)
    children: list[object] = field(default_factory=list)

    def text(self, key: str, default: str = "") -> str:
        """A property as text."""
        value = self.props.get(key, default)
        return value if isinstance(value, str) else json.dumps(value) if value is not None else default


def literal(source: str) -> object:
    """A JavaScript literal with unquoted keys, single quotes and trailing commas; the source itself if it isn't one."""
    loose = re.sub(r"'((?:[^'\\]|\\.)*)'", lambda m: json.dumps(m[1].replace("\\'", "'")), source.strip())
    loose = re.sub(r"([{,]\s*)([A-Za-z_$][\w$-]*)\s*:", r'\1"\2":', loose)
    loose = re.sub(r",(\s*[}\]])", r"\1", loose)
    try:
        return json.loads(loose)
    except ValueError:
        return source.strip()


def properties(source: str) -> dict[str, object]:
    """Properties of an opening tag; those without a value are true (ARR-13, UDF-06)."""
    out: dict[str, object] = {}
    for m in _ATTR.finditer(source):
        name, double, single, braced = m.groups()
        out[name] = double if double is not None else single if single is not None else literal(braced) if braced is not None else True
    return out


def parse(source: str) -> list[object]:
    """Text and components of MDX outside fences; a tag that never closes stays text."""
    parts: list[object] = []
    fence = None
    plain: list[str] = []
    blocks: list[tuple[bool, str]] = []
    for line in source.split("\n"):
        m = _FENCE.match(line)
        if m and fence is None:
            blocks.append((False, "\n".join(plain)))
            plain, fence = [line], m[1][:3]
        elif m and fence == m[1][:3]:
            plain.append(line)
            blocks.append((True, "\n".join(plain)))
            plain, fence = [], None
        else:
            plain.append(line)
    blocks.append((fence is not None, "\n".join(plain)))
    stack: list[tuple[Node | None, list[object], str]] = [(None, parts, "")]

    def add(x: object) -> None:
        if x != "":
            stack[-1][1].append(x)

    for k, (fenced, body) in enumerate(blocks):
        if k:
            add("\n")
        if fenced:
            add(body)
            continue
        at = 0
        for m in re.finditer(rf"</({_NAME})\s*>|" + _OPEN.pattern, body):
            add(body[at : m.start()])
            at = m.end()
            if m[1]:
                if stack[-1][0] is not None and stack[-1][0].name == m[1]:
                    stack.pop()
                else:
                    add(m[0])
            else:
                node = Node(m[2], properties(m[3] or ""))
                add(node)
                if not m[4]:
                    stack.append((node, node.children, m[0]))
        add(body[at:])
    while len(stack) > 1:  # what never closed becomes text again
        node, children, tag = stack.pop()
        home = stack[-1][1]
        home[home.index(node) :] = [tag, *children]
    return parts


Handler = Callable[[Node, str], str]
HANDLERS: dict[str, Handler] = {}


def flattener(*names: str) -> Callable[[Handler], Handler]:
    """Register a handler: it gets a node and its flattened body, and returns Markdown (MDX-27, UDF-05)."""

    def register(fn: Handler) -> Handler:
        for name in names:
            HANDLERS[name] = fn
        return fn

    return register


def plain(text: str) -> str:
    """Inline Markdown as text: labels of links and images, no marks and tags, white space squeezed."""
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"</?[A-Za-z][^<>]*>", "", text)
    text = re.sub(r"(\*\*|__|`)(?=\S)(.+?)(?<=\S)\1", r"\2", text)
    text = re.sub(r"(?<![\w*])([*_])(?=\S)(.+?)(?<=\S)\1(?![\w*])", r"\2", text)
    return " ".join(text.split())


def _quoted(text: str) -> str:
    return "\n".join(f"> {x}".rstrip() for x in text.strip().split("\n"))


@flattener("Callout")
def _callout(node: Node, body: str) -> str:
    """A quotation of one paragraph: mark, label and title, then the body's plain text on a line."""
    mark, label = _CALLOUTS.get((node.text("variant") or node.text("type")).lower(), _CALLOUTS["info"]).split(" ")
    title, said = node.text("title").strip(), plain(body)
    return _quoted(f"{mark} **{label}:**" + (f" **{title}**" if title else "") + (f"\n{said}" if said else ""))


@flattener("Steps")
def _steps(node: Node, body: str) -> str:
    steps = [c for c in node.children if isinstance(c, Node) and c.name == "Step"]
    if not steps:
        return body
    rows = []
    for k, s in enumerate(steps, 1):
        title, inner = s.text("title"), render(s.children).strip()
        said = f"**{title}**\n\n{inner}" if title else inner
        rows.append(f"{k}. " + said.replace("\n", "\n   "))
    return "\n".join(rows)


@flattener("Tabs")
def _tabs(node: Node, body: str) -> str:  # noqa: ARG001
    tabs = [c for c in node.children if isinstance(c, Node) and c.name == "Tab"]
    items = node.props.get("items")
    order = {x: i for i, x in enumerate(items)} if isinstance(items, list) else {}
    name = lambda t: t.text("value", t.text("title"))
    tabs.sort(key=lambda t: order.get(name(t), len(order)))
    return "\n\n".join(f"#### {name(t)}\n\n{render(t.children).strip()}" for t in tabs)


@flattener("CommandTabs")
def _commands(node: Node, body: str) -> str:  # noqa: ARG001
    what, mode = node.text("command").strip(), node.text("mode", "run").strip()
    if not what:
        return ""
    told = _MANAGERS.get(mode, _MANAGERS["run"])
    return "\n".join(["| Package manager | Command |", "| :--- | :--- |", *(f"| {k} | `{v} {what}` |" for k, v in told.items())])


@flattener("Cards", "TopicSwitcher")
def _cards(node: Node, body: str) -> str:
    cards = [c for c in node.children if isinstance(c, Node) and c.name == "Card"]
    return "\n".join(_card(c, render(c.children)) for c in cards) if cards else body


@flattener("Card")
def _card(node: Node, body: str) -> str:
    title, href = node.text("title"), node.text("href")
    said = node.text("description") or " ".join(body.split())
    return f"- [{title}]({href})" + (f": {said}" if said else "") if href else f"- {title}" + (f": {said}" if said else "")


@flattener("Details", "details")
def _details(node: Node, body: str) -> str:  # noqa: ARG001
    """A heading by the last summary that has text, then what else there is."""
    said, rest = "", []
    for child in node.children:
        text = plain(render(child.children)) if isinstance(child, Node) and child.name == "summary" else ""
        if text:
            said = text
        else:
            rest.append(child)
    inner = textwrap.dedent(render(rest)).strip()
    return f"### {said or 'Details'}\n\n{inner}".strip() if said or inner else ""


@flattener("AccordionItem")
def _item(node: Node, body: str) -> str:
    return f"**{node.text('title')}**\n\n{body.strip()}"


@flattener("Accordion", "Section", "Step", "Tab", "Example", "Folder", "summary")
def _unwrap(node: Node, body: str) -> str:  # noqa: ARG001
    return body.strip()


@flattener("Audience")
def _audience(node: Node, body: str) -> str:
    return "" if node.text("target") == "human" else body.strip()


@flattener("Mermaid")
def _mermaid(node: Node, body: str) -> str:
    return f"```mermaid\n{node.text('chart', body).strip()}\n```"


@flattener("Prompt")
def _prompt(node: Node, body: str) -> str:
    return f"```prompt\n{node.text('text', body).strip()}\n```"


def _files(nodes: list[object], lead: str = "") -> list[str]:
    rows = [n for n in nodes if isinstance(n, Node) and n.name in ("File", "Folder")]
    out = []
    for k, n in enumerate(rows):
        last = k == len(rows) - 1
        out.append(f"{lead}{'└── ' if last else '├── '}{n.text('name')}{'/' if n.name == 'Folder' else ''}")
        out += _files(n.children, lead + ("    " if last else "│   "))
    return out


@flattener("FileTree")
def _tree(node: Node, body: str) -> str:  # noqa: ARG001
    return "```text\n" + "\n".join(_files(node.children)) + "\n```"


@flattener("TypeTable")
def _types(node: Node, body: str) -> str:  # noqa: ARG001
    rows = node.props.get("type")
    if not isinstance(rows, dict):
        return ""
    cell = lambda x: str(x if x is not None else "").replace("|", "\\|")
    out = ["| Property | Type | Description | Required |", "| :--- | :--- | :--- | :--- |"]
    for name, v in rows.items():
        v = v if isinstance(v, dict) else {"type": v}
        out.append(f"| {cell(name)} | `{cell(v.get('type'))}` | {cell(v.get('description', ''))} | {'yes' if v.get('required') else 'no'} |")
    return "\n".join(out)


@flattener("ApiEndpoint")
def _endpoint(node: Node, body: str) -> str:
    said = body.strip()
    return f"`{node.text('method').upper()} {node.text('path')}`" + (f"\n\n{said}" if said else "")


@flattener("ApiParameters", "ApiRequestBody", "ApiResponses", "ApiAuth", "ApiCodeSamples")
def _api_rows(node: Node, body: str) -> str:
    """A table of the rows that the component was given (MDX-25); one without rows keeps its children."""
    rows = next((v for v in node.props.values() if isinstance(v, list) and v and all(isinstance(r, dict) for r in v)), [])
    if not rows:
        return body.strip()
    names = list(dict.fromkeys(k for r in rows for k in r))
    cell = lambda v: ("" if v is None else v if isinstance(v, str) else json.dumps(v)).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |", *("| " + " | ".join(cell(r.get(k)) for k in names) + " |" for r in rows)])


@flattener("ApiTryIt")
def _try_it(node: Node, body: str) -> str:  # noqa: ARG001
    return ""


def render(nodes: list[object], handlers: dict[str, Handler] | None = None) -> str:
    """Markdown of nodes, children first; components without a handler keep their children (MDX-03)."""
    known = HANDLERS if handlers is None else handlers
    return "".join(x if isinstance(x, str) else known.get(x.name, _unwrap)(x, render(x.children, known)) for x in nodes)


def strip_module_code(source: str) -> str:
    """MDX without imports, exports, JSX comments and snippet directives outside fences (MDX-07, MDX-08)."""
    out, fence, cut = [], None, False
    for line in source.split("\n"):
        m = _FENCE.match(line)
        if m:
            fence = None if fence else m[1]
            cut = False
        if fence is None and re.match(r"(import\s.+from\s|import\s+['\"]|export\s)", line):
            continue
        if fence is not None and re.match(r"\s*(//|#)\s*---cut---", line):
            cut = True
            continue
        if fence is not None and re.match(r"\s*//\s*@(noErrors|errors|filename|ts-)", line):
            continue
        if not cut or fence is None:
            out.append(line)
    return re.sub(r"\{/\*[\s\S]*?\*/\}", "", "\n".join(out))


_INCLUDE = r"<include>([^<]+)</include>"


def fill_urls(text: str, values: dict[str, str]) -> str:
    """Placeholders filled in the targets of links, images, definitions and in properties that hold URLs (MDX-09).

    {key} without a value stays, {key:fallback} takes the fallback.
    """
    fill = lambda url: re.sub(r"\{([A-Za-z_][A-Za-z0-9_.]*)(?::([^{}]*))?\}", lambda m: values.get(m[1], m[2] if m[2] is not None else m[0]), url)
    text = re.sub(r"(\]\()([^)\s]+)", lambda m: m[1] + fill(m[2]), text)
    text = re.sub(r"(?m)^(\s*\[[^\]]+\]:\s*)(\S+)", lambda m: m[1] + fill(m[2]), text)
    return re.sub(r"""(\b(?:href|src|url)=["'])([^"']*)""", lambda m: m[1] + fill(m[2]), text)


def context(path: str) -> dict[str, str]:
    """What a page's path says of placeholders: its framework."""
    found = re.search(r"(?:^|/)frameworks/([^/]+)/", path)
    return {"framework": found[1]} if found else {}


def expand_includes(text: str, files: dict[str, str], path: str = "", within: frozenset[str] = frozenset()) -> str:
    """Text with <include>path#section</include> replaced by files, sections cut out (MDX-04 to MDX-06).

    Includes may nest however deep; a file that would include itself is left out there.
    """

    def put(m: re.Match) -> str:
        target, _, part = m[1].strip().partition("#")
        folder = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
        for name in (folder + target, target):
            if name in files:
                body = files[name]
                if part:
                    found = re.search(rf'<section id="{re.escape(part)}">([\s\S]*?)</section>', body)
                    body = found[1].strip() if found else ""
                return "" if m[1].strip() + name in within else expand_includes(body, files, name, within | {m[1].strip() + name})
        return ""

    return re.sub(_INCLUDE, put, text)


def compact_tables(text: str) -> str:
    """Table cells without padding, outside fences (STR-39)."""
    out, fence = [], False
    for line in text.split("\n"):
        fence ^= bool(_FENCE.match(line))
        if not fence and re.match(r"^\s*\|.*\|\s*$", line):
            cells = [re.sub(r"^(:?)-+(:?)$", r"\1---\2", c.strip()) for c in line.strip()[1:-1].split("|")]
            line = "| " + " | ".join(cells) + " |"
        out.append(line)
    return "\n".join(out)


def to_markdown(source: str, files: dict[str, str] | None = None, path: str = "", handlers: dict[str, Handler] | None = None) -> str:
    """One page's MDX as Markdown (MDX-02): includes, module code, placeholders in URLs, components, blank lines."""
    text = fill_urls(expand_includes(source, files or {}, path), context(path))
    text = render(parse(strip_module_code(text)), handlers)
    return compact_tables(re.sub(r"\n{3,}", "\n\n", text)).strip() + "\n"


def _targets(rows: DataFrame) -> DataFrame:
    """(owner, target): paths that each of (path, source) may include: beside it, and from the root."""
    each = rows.select(F.col("path").alias("owner"), F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(_INCLUDE), F.lit(1)))).alias("raw"))
    name = F.split_part(F.trim("raw"), F.lit("#"), F.lit(1))
    beside = F.concat(F.regexp_replace("owner", "[^/]*$", ""), name)
    return each.select("owner", F.explode(F.array_distinct(F.array(beside, name))).alias("target"))


def included(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target): every file that a page includes, directly or by other files.

    Links of files to files are followed round by round until no page reaches a new one, so that loops end.
    """
    known = files.select(F.col("path").alias("target")).distinct()
    links = materialize(_targets(files).join(known, "target").select("owner", "target"))
    reached = fresh = materialize(_targets(pages).join(known, "target").select(F.col("owner").alias("path"), "target").distinct())
    while not fresh.isEmpty():
        onward = fresh.select("path", F.col("target").alias("owner")).join(links, "owner").select("path", "target").distinct()
        fresh = materialize(onward.join(reached, ["path", "target"], "left_anti"))
        reached = reached.union(fresh)
    return reached


def convert(pages: DataFrame, files: DataFrame | None = None, handlers: dict[str, Handler] | None = None) -> DataFrame:
    """(path, markdown) of (path, source): a corpus in Markdown (MDX-01).

    ``files`` (path, source) is what pages may include; each page is joined with just the files it needs.
    """
    known = dict(HANDLERS if handlers is None else handlers)
    rows = pages.select("path", "source")
    if files is None:
        rows = rows.withColumn("files", F.lit(None).cast("map<string,string>"))
    else:
        body = files.select(F.col("path").alias("target"), F.col("source").alias("body"))
        needed = included(rows, files).join(body, "target").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("target", "body"))).alias("files"))
        rows = rows.join(needed, "path", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [to_markdown(s or "", dict(f) if f is not None else {}, p or "", known) for p, s, f in zip(pdf["path"], pdf["source"], pdf["files"], strict=True)]
            yield pd.DataFrame({"path": pdf["path"], "markdown": done})

    ship(pages.sparkSession)
    return rows.select("path", "source", "files").mapInPandas(run, "path string, markdown string")


def run_hooks(value: object, hooks: list[tuple[str, Callable[[object], object]]], stage: str) -> object:
    """A value through named callables in order; None keeps it, errors name the hook and stage (UDF-01, UDF-02)."""
    for name, hook in hooks:
        try:
            new = hook(value)
        except Exception as error:
            raise RuntimeError(f"{name} failed in {stage}: {error}") from error
        value = value if new is None else new
    return value
