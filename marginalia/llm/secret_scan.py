"""Operator 6: secrets in texts, told apart by who owns their copies across the corpus.

Every candidate's value is hashed; a hash is aggregated by distinct repositories and owners. A value
that many owners hold, or many repositories of more than one, is a copied example; what is left and looks
like a random string is live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import free, materialize, over_batches, texts

KINDS = ("assign", "access", "hex")
#: Kinds beyond the base ones, in the order in which equal starts are listed.
MORE = ("url", "block")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run is taken whole from its start, so this drops just the short ones
# A longer scheme just makes the span begin later.
_URL = re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]*+:([^\s:/@]{4,}+)@")
# Header lines (also where line feeds have become spaces) go before the base64.
_BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?!-----END)\s*+(?:[A-Za-z][A-Za-z0-9-]*+:(?:(?:(?!-----)[^\n])*+\n|\x20*+\S++)\s*+)*+[A-Za-z0-9+/=\s]*+-----END")

#: Owners of a value from which it is an example; repositories, where there are two owners at least.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 8
#: Bits a character and characters that a live-looking value has at least.
LIVE_BITS, LIVE_LENGTH = 2.5, 12

SCAN = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
    "found array<struct<kind:int,start:int,end:int,value_hash:string,looks_live:boolean>>"
)


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of all candidates, by start and kind; kind counts KINDS + MORE."""
    out = [(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    if "://" in text:
        out += [(3, m.start(), m.end(), m[1]) for m in _URL.finditer(text)]
    if "-----BEGIN" in text:
        out += [(4, m.start(), m.end(), m[0]) for m in _BLOCK.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def looks_live(value: str) -> bool:
    """A value as random as keys are: long enough, not few characters over and over, no placeholder."""
    if len(value) < LIVE_LENGTH or re.search(r"(?i)example|sample|dummy|changeme|placeholder|x{4}|1234567", value):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= LIVE_BITS


def spans(found: list[tuple[int, int, int, str]], kinds: int = 5) -> str:
    """kind:start:end of candidates, joined by commas."""
    return ",".join(f"{(KINDS + MORE)[k]}:{a}:{b}" for k, a, b, _ in found if k < kinds)


def scan(docs: DataFrame, *keep: str) -> DataFrame:
    """One row a document: counts and digest of the base kinds, and every candidate with its value's hash."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [candidates(t or "") for t in batch.column(1).to_pylist()]
        counts = [[sum(x[0] == k for x in f) for f in found] for k in range(3)]
        rows = [[{"kind": k, "start": a, "end": b, "value_hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32], "looks_live": looks_live(v)} for k, a, b, v in f] for f in found]
        item = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value_hash", pa.string()), ("looks_live", pa.bool_())])
        cols = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(spans(f, 3).encode()).hexdigest() for f in found], pa.string()), pa.array(rows, pa.list_(item))]
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "found"]
        yield pa.RecordBatch.from_arrays([*cols, *(batch.column(2 + i) for i in range(len(keep)))], names=[*names, *keep])

    kinds = dict(docs.dtypes)
    return over_batches(texts(docs, *keep), run, SCAN + "".join(f", {k} {kinds[k]}" for k in keep))


def row_key() -> Column:
    """What tells texts of one doc_id, or of none, apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def secrets(docs: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """Secrets of every document, each judged by how widely its value is copied.

    Takes doc_id, text and what ``owner`` (by default source) and ``repository`` (by default source and
    lang) need; other columns stay out. Null or empty text has no secrets; a null owner counts as one of
    its own, unknown one. One row for each input row: base counts and digest, ``found`` (all candidates),
    and ``judged``, the candidates as (kind, start, end, owners, repositories, verdict), in order:
    "example" if COPIED_OWNERS or more owners hold the value, or COPIED_REPOSITORIES or more repositories
    of two owners; else "live" if it looks random; else "weak". Rows that repeat doc_id and text get the
    same judgements; texts that share a doc_id, or have none, are judged each. A value that many documents
    hold is counted by partial sums and joined by a join that splits skewed keys. An empty table gives no rows.
    """
    return _secrets(docs, owner, repository).drop("row_")


def _secrets(docs: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """``secrets`` with the rows' keys in row_."""
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    docs = docs.select("doc_id", "text", F.coalesce(owner.cast("string"), F.lit("?")).alias("owner_"), F.coalesce(repository.cast("string"), F.lit("?")).alias("repo_"), row_key().alias("row_"))
    scanned = materialize(scan(docs, "owner_", "repo_", "row_"))
    each = scanned.select("doc_id", "row_", "owner_", "repo_", F.explode("found").alias("f")).select("doc_id", "row_", "owner_", "repo_", "f.*")
    held = (
        each.groupBy("value_hash", "owner_", "repo_").agg(F.lit(1).alias("one"))
        .groupBy("value_hash", "owner_").agg(F.count("*").alias("repos"))
        .groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repositories"))
    )
    copied = (F.col("owners") >= COPIED_OWNERS) | ((F.col("owners") > 1) & (F.col("repositories") >= COPIED_REPOSITORIES))
    verdict = F.when(copied, "example").when(F.col("looks_live"), "live").otherwise("weak")
    judged = (
        each.join(held, "value_hash")
        .groupBy(F.col("doc_id").alias("doc_id_"), F.col("row_").alias("row__"))
        .agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end", "owners", "repositories", verdict.alias("verdict")))).alias("judged"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("row_") == F.col("row__"))
    return scanned.join(judged, same, "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "found", "judged", "row_")


def span_text(found: str = "found") -> Column:
    """The column ``found`` as kind:start:end, joined by commas."""
    name = F.array(*map(F.lit, KINDS + MORE))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every live secret's span replaced by ``mask`` (n_chars follows); all columns stay.

    Spans that overlap are masked as one. A document without live secrets keeps its row as it is. A row
    finds its spans by doc_id and text, so that repeated and missing doc_ids do no harm; columns may have
    any names.
    """
    of, said, live, cut = (free(x, docs.columns) for x in ("of_", "said_", "live_", "cut_"))
    told = _secrets(docs).select(F.col("doc_id").alias(of), F.col("row_").alias(said), F.expr("filter(judged, x -> x.verdict = 'live')").alias(live)).where(F.size(live) > 0).dropDuplicates([of, said])
    cuts = F.aggregate(
        live,
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda a, x: F.when(x["end"] <= a["at"], a).otherwise(
            F.struct(
                F.when(x["start"] < a["at"], a["done"]).otherwise(F.concat(a["done"], F.substring(F.col("text"), a["at"] + 1, x["start"] - a["at"]), F.lit(mask))).alias("done"),
                x["end"].alias("at"),
            )
        ),
    )
    joined = docs.join(told, F.col("doc_id").eqNullSafe(F.col(of)) & (row_key() == F.col(said)), "left").withColumn(cut, F.when(F.size(live) > 0, cuts))
    changed = F.col(cut).isNotNull()
    new = {"text": F.when(changed, F.concat(F.col(f"{cut}.done"), F.substring(F.col("text"), F.col(f"{cut}.at") + 1, F.length("text")))).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(new["text"]).cast("long")).otherwise(F.col("n_chars"))
    return joined.select([new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
