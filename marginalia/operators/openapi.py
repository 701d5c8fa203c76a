"""OpenAPI documents as tables of operations, parameters and schema rows (API-*, ARR-08 to ARR-12, JOI-22, JOI-23)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

METHODS = ("get", "post", "put", "patch", "delete", "head", "options", "trace")
DEPTH = 6


def load(text: str) -> dict:
    """A document, version 3 only (API-01, SRC-12)."""
    try:
        spec = json.loads(text)
    except ValueError:
        import yaml

        spec = yaml.safe_load(text)
    if not isinstance(spec, dict) or not str(spec.get("openapi", "")).startswith("3."):
        raise ValueError("only OpenAPI 3.x documents are supported")
    return spec


def pointer(document: object, path: str) -> object:
    """What a JSON pointer names; None if nothing (ARR-11)."""
    for part in [p.replace("~1", "/").replace("~0", "~") for p in path.lstrip("#").split("/")[1:]]:
        document = document[int(part)] if isinstance(document, list) and part.isdigit() and int(part) < len(document) else document.get(part) if isinstance(document, dict) else None
    return document


def dereference(spec: dict, node: object, seen: tuple[str, ...] = ()) -> object:
    """A node with references followed; one that comes back to itself stays a reference (ARR-10)."""
    if isinstance(node, dict):
        ref = node.get("$ref")
        if isinstance(ref, str):
            if ref in seen or not ref.startswith("#"):
                return {"$ref": ref}
            return dereference(spec, pointer(spec, ref), (*seen, ref))
        return {k: dereference(spec, v, seen) for k, v in node.items()}
    return [dereference(spec, x, seen) for x in node] if isinstance(node, list) else node


def merged(schema: dict) -> dict:
    """A schema with its allOf parts in one: properties and required names together (ARR-09)."""
    parts = schema.get("allOf")
    if not isinstance(parts, list):
        return schema
    out = {k: v for k, v in schema.items() if k != "allOf"}
    for part in map(merged, [p for p in parts if isinstance(p, dict)]):
        for k, v in part.items():
            if k == "properties":
                out["properties"] = {**out.get("properties", {}), **v}
            elif k == "required":
                out["required"] = sorted({*out.get("required", []), *v})
            else:
                out.setdefault(k, v)
    return out


def label(schema: object) -> str:
    """A schema's type in words (API-07)."""
    if not isinstance(schema, dict):
        return "unknown"
    if isinstance(schema.get("$ref"), str):
        return schema["$ref"].rsplit("/", 1)[-1]
    for key, mark, name in (("enum", " | ", json.dumps), ("oneOf", " | ", label), ("anyOf", " | ", label), ("allOf", " & ", label)):
        if isinstance(schema.get(key), list) and schema[key]:
            return mark.join(name(x) for x in schema[key])
    kind = schema.get("type")
    if isinstance(kind, list):
        return " | ".join(x for x in kind if isinstance(x, str))
    if kind == "array":
        return label(schema.get("items")) + "[]"
    if kind == "object" or isinstance(schema.get("properties"), dict):
        return "object"
    return kind if isinstance(kind, str) else "unknown"


def example(schema: object, depth: int = 0) -> object:
    """A value that fits a schema (ARR-12)."""
    if not isinstance(schema, dict) or depth > DEPTH:
        return None
    for key in ("example", "default"):
        if key in schema:
            return schema[key]
    if schema.get("enum"):
        return schema["enum"][0]
    schema = merged(schema)
    for key in ("oneOf", "anyOf"):
        if schema.get(key):
            return example(schema[key][0], depth + 1)
    kind = label(schema)
    if kind == "object":
        return {k: example(v, depth + 1) for k, v in schema.get("properties", {}).items()}
    if kind.endswith("[]"):
        return [example(schema.get("items"), depth + 1)]
    return {"string": "string", "integer": 0, "number": 0, "boolean": True}.get(kind)


def schema_rows(schema: object, lead: str = "", depth: int = 0) -> list[tuple[str, str, bool]]:
    """(name, type, required) of a schema's properties, nested ones as a.b and a[].b (ARR-08)."""
    if not isinstance(schema, dict) or depth > DEPTH:
        return []
    schema = merged(schema)
    if "properties" not in schema and isinstance(schema.get("items"), dict) and not lead:
        return schema_rows(schema["items"], "[].", depth)
    rows = []
    for name, part in schema.get("properties", {}).items():
        rows.append((lead + name, label(part), name in schema.get("required", [])))
        part = merged(part) if isinstance(part, dict) else {}
        if part.get("properties"):
            rows += schema_rows(part, f"{lead}{name}.", depth + 1)
        if isinstance(part.get("items"), dict) and merged(part["items"]).get("properties"):
            rows += schema_rows(part["items"], f"{lead}{name}[].", depth + 1)
    return rows


def operations(spark: SparkSession, spec: dict) -> DataFrame:
    """(path, method, method_rank, operation_id, summary, tags, body) for each operation, by path and method (API-02, API-03, SOR-04)."""
    rows = [
        (path, m, METHODS.index(m), op.get("operationId") or f"{m}-{path.strip('/').replace('/', '-')}", op.get("summary") or "", op.get("tags") or [], json.dumps(dereference(spec, op)))
        for path, item in spec.get("paths", {}).items() for m, op in item.items() if m in METHODS
    ]
    return spark.createDataFrame(rows, "path string, method string, method_rank int, operation_id string, summary string, tags array<string>, body string")


def selected(ops: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Operations with an included tag and no excluded one (FIL-03)."""
    if include:
        ops = ops.where(F.arrays_overlap("tags", F.array(*map(F.lit, include))))
    return ops.where(~F.arrays_overlap("tags", F.array(*map(F.lit, exclude)))) if exclude else ops


def parameters(shared: DataFrame, own: DataFrame) -> DataFrame:
    """Parameters of operations: the operation's own beat those of its path, by place and name (JOI-23)."""
    both = shared.withColumn("p", F.lit(1)).unionByName(own.withColumn("p", F.lit(0)))
    w = Window.partitionBy("path", "method", "place", "name").orderBy("p")
    return both.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "p")


def samples(ops: DataFrame, base: str) -> DataFrame:
    """(path, method, curl, fetch): code for each operation (API-04)."""
    verb, url = F.upper("method"), F.concat(F.lit(base), F.col("path"))
    return ops.select("path", "method", F.concat(F.lit("curl -X "), verb, F.lit(' "'), url, F.lit('"')).alias("curl"), F.concat(F.lit('fetch("'), url, F.lit('", { method: "'), verb, F.lit('" })')).alias("fetch"))


def by_tag(ops: DataFrame) -> DataFrame:
    """(tag, operations): operation ids of each tag in order (API-06)."""
    rows = ops.select(F.explode_outer(F.when(F.size("tags") > 0, F.col("tags"))).alias("tag"), F.struct("path", "method_rank", "operation_id").alias("op"))
    return rows.groupBy(F.coalesce("tag", F.lit("default")).alias("tag")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("op")), lambda x: x["operation_id"]), ",").alias("operations"))


def security(spark: SparkSession, spec: dict) -> DataFrame:
    """(path, method, choice, scheme, type, scopes): schemes that each operation's requirements name (JOI-22).

    An operation's own requirements replace the document's; choices are alternatives, a choice's schemes
    hold together. Names without a scheme are left out; operations without requirements are public.
    """
    needs = [
        (path, m, k, name, list(scopes or []))
        for path, item in spec.get("paths", {}).items() for m, op in item.items() if m in METHODS
        for k, choice in enumerate(op.get("security", spec.get("security")) or []) for name, scopes in choice.items()
    ]
    known = [(name, str(s.get("type", ""))) for name, s in (spec.get("components", {}).get("securitySchemes") or {}).items()]
    rows = spark.createDataFrame(needs, "path string, method string, choice int, scheme string, scopes array<string>")
    return rows.join(spark.createDataFrame(known, "scheme string, type string"), "scheme").select("path", "method", "choice", "scheme", "type", "scopes")


def responses(ops: DataFrame) -> DataFrame:
    """(path, method, status, description, media) of every response of operations (API-05)."""
    parsed = F.from_json(F.get_json_object("body", "$.responses"), "map<string, struct<description: string, content: map<string, string>>>")
    each = ops.select("path", "method", F.explode(parsed).alias("status", "r"))
    return each.select("path", "method", "status", F.coalesce("r.description", F.lit("")).alias("description"), F.array_join(F.array_sort(F.coalesce(F.map_keys("r.content"), F.array().cast("array<string>"))), ",").alias("media"))


def mdx_safe(text: str) -> str:
    """Prose of a document for MDX (STR-46): braces and angle brackets escaped, but in fences, code spans and autolinks."""
    out = []
    for part in re.split(r"(```[\s\S]*?```|`[^`\n]*`|<https?://[^>\s]+>)", text):
        whole = part.startswith("`") or re.fullmatch(r"<https?://[^>\s]+>", part)
        out.append(part if whole else re.sub(r"([{}<])", r"\\\1", part))
    return "".join(out)


def pages(ops: DataFrame, prefix: str = "api") -> DataFrame:
    """(path, source) of a page for each operation, as MDX (SNK-13); summaries are escaped."""
    head = F.concat(F.lit("---\ntitle: "), F.to_json(F.struct(F.col("operation_id").alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("operation_id").alias("t")))) - 6), F.lit("\n---\n\n"))
    safe = F.regexp_replace("summary", r"([{}<])", r"\\$1")
    return ops.select(F.concat(F.lit(prefix + "/"), "operation_id", F.lit(".mdx")).alias("path"), F.concat(head, F.lit("<ApiEndpoint method=\""), F.upper("method"), F.lit('" path="'), F.col("path"), F.lit('" />\n\n'), safe, F.lit("\n")).alias("source"))


def overridden(graph: dict, override: dict | Callable[[dict], dict | None] | None) -> dict:
    """JSON-LD with overrides: a dictionary is merged, a function's result replaces it unless it is None (UDF-08)."""
    if callable(override):
        new = override(graph)
        return graph if new is None else new
    return {**graph, **(override or {})}
