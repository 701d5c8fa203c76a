"""Inverted index and ranked retrieval over tables of chunks and queries (SEA-01 to SEA-11, SEA-18, SEA-19, SEA-28, SEA-30)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..inputs import ship
from ..scratch import clear_scratch, materialize, scratch_of

# Fixed values of the ranking.
K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"title": 4.0, "heading": 2.0, "body": 1.0, "code": 0.35}
EXACT, STEM, SYNONYM, PREFIX, TYPO = 1.0, 0.82, 0.72, 0.55, 0.45
PREFIX_CAP, TYPO_CAP = 24, 16
PHRASE_BOOST, NEAR_BOOST, NEAR_WINDOW = 1.4, 0.8, 8
LIMIT, SOURCES, CONTEXT_CHARS = 8, 6, 12_000


#: Numbers that a task holds at once while it counts or scores: tokens, shares, or chunks times queries.
AT_ONCE = 2 << 20


@dataclass
class Index:
    """chunks: chunk_pos, url, text, length, and the fields; postings: term, chunk_pos, tf_*, impact; vocab: term, stem, df, term_rank.

    held: a row for each chunk with its terms, as ``build`` stores them; size: the number of chunks and their average length.
    """

    chunks: DataFrame
    postings: DataFrame
    vocab: DataFrame
    kept: list[str] = field(default_factory=list)
    held: DataFrame | None = None
    size: tuple[int, float] = (0, 1.0)

    def release(self) -> None:
        """Delete the tables that ``build`` has written; there must be no more use for the index."""
        for owner in self.kept:
            clear_scratch(owner)
        self.kept.clear()

    def stats(self) -> DataFrame:
        """One row: the number of chunks and their average length, at least 1 (AGG-02)."""
        return self.chunks.agg(F.count("*").alias("n"), F.greatest(F.avg("length"), F.lit(1.0)).alias("avg_length"))


def searchable(pages: DataFrame) -> DataFrame:
    """Pages to index (SEA-01): ``search`` decides where it is set; else pages in shared folders are left out."""
    shared = F.arrays_overlap(F.split("relative_path", "/"), F.array(F.lit("shared"), F.lit("_shared")))
    return pages.where(F.coalesce(F.col("search"), ~shared))


def chunk_text(title: Column, description: Column, headings: Column, text: Column) -> Column:
    """A chunk's text (ARR-03): what isn't empty, parted by blank lines."""
    return F.array_join(F.filter(F.concat(F.array(title, description), headings, F.array(text)), lambda x: x.isNotNull() & (x != "")), "\n\n")


HIT = "term string, tf_title long, tf_heading long, tf_body long, tf_code long, field int, place int"
HELD = f"chunk_pos long, length long, hits array<struct<{', '.join(x.replace(' ', ':') for x in HIT.split(', '))}>>"
#: Columns of tokens with the number of the field that they count for, and whether they make the chunk's text.
_FIELDS = [("title", 0, False), ("heading", 1, False), ("description", 2, False), ("text", 2, True), ("code", 3, False)]
#: The same for chunks with ``body``, whose text is made of the others: each is tokenised once.
_PIECES = [("title", 0, False), ("heading", 1, False), ("description", 2, False), *((c, 2, True) for c in ("title", "description", "heading", "body", "code")), ("code", 3, False)]
#: How tables of an index are written: terms repeat.
_PACKED = {"compression": "zstd", "parquet.dictionary.page.size": str(8 << 20)}


def _weighed(tf: dict) -> Column | np.ndarray:
    return sum((tf[f"tf_{name}"] * weight for name, weight in FIELD_WEIGHTS.items()), 0.0)


def _saturated(weighed, length, average):  # noqa: ANN001, ANN202
    """What a chunk's weighed count of a term is worth before the term's rarity; of columns or arrays."""
    return weighed * (K1 + 1) / (weighed + K1 * (1 - B + B * length / average))


def _rarity(n: int, df: Column | str) -> Column:
    return F.log(1 + (F.lit(float(n)) - F.col(df) + 0.5) / (F.col(df) + 0.5))


def _lists(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, and how many each row has; null is empty."""
    return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _cut(cost: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that cost ``most`` together, one row at least."""
    total, at = np.concatenate([[0], np.cumsum(cost)]), 0
    while at < len(cost):
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield at, end
        at = end


def _counted(batch: pa.RecordBatch, fields: list[tuple[str, int, bool]]) -> pa.RecordBatch:
    """HELD of chunk_pos and columns of tokens: a chunk's terms in the order of their first occurrence."""
    n = batch.num_rows
    columns = {name: _lists(batch.column(batch.schema.get_field_index(name))) for name, _, _ in fields}
    found, rows, numbers, places = [], [], [], []
    before, length = np.zeros((len(FIELD_WEIGHTS), n), np.int64), np.zeros(n, np.int64)
    for name, number, in_text in fields:
        values, size = columns[name]
        row = np.repeat(np.arange(n), size)
        found.append(values)
        rows.append(row)
        numbers.append(np.full(len(row), number))
        places.append(np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + before[number][row])
        before[number] += size
        length += size * in_text
    known = pa.concat_arrays(found).dictionary_encode()
    code, row, of, place = known.indices.to_numpy().astype(np.int64), *map(np.concatenate, (rows, numbers, places))
    key = row * max(1, len(known.dictionary)) + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    tf = [np.add.reduceat((of[order] == k).astype(np.int64), new) if len(new) else new for k in range(len(FIELD_WEIGHTS))]
    first = order[new]
    by_place = np.lexsort((place[first], of[first], row[first]))
    tf, first = [x[by_place] for x in tf], first[by_place]
    hit = [known.dictionary.take(pa.array(code[first])), *map(pa.array, tf), pa.array(of[first], pa.int32()), pa.array(place[first], pa.int32())]
    hits = pa.StructArray.from_arrays(hit, names=[x.split()[0] for x in HIT.split(", ")])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[first], np.arange(n + 1)), pa.int32()), hits)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(length, pa.int64()), lists], names=["chunk_pos", "length", "hits"])


def build(chunks: DataFrame, derive: Callable[[DataFrame], DataFrame] | None = None) -> Index:
    """An index of ``chunks``: chunk_pos, url, title, description, heading, text, code (SEA-02, SEA-03, AGG-01, AGG-03).

    ``text`` is the chunk's whole text. The body field counts description and text. A term's rank is
    that of its first occurrence, canonical numbers first, by value. A posting has its term's whole share
    of a chunk's score (``impact``). Texts are tokenised once, and a chunk's terms are counted where its
    row is, without a shuffle. Chunks, their terms and the vocabulary are written to the shared folder, as
    each is read several times by a search; ``Index.release`` deletes them. ``derive`` adds what needn't be
    written, as it is made of other columns.
    """
    owner = f"index {uuid.uuid4().hex}"
    ship(chunks.sparkSession)
    with scratch_of(owner):
        stored = materialize(chunks, **_PACKED)
        stored = derive(stored) if derive else stored
        fields = _PIECES if "body" in stored.columns else _FIELDS
        names = list(dict.fromkeys(name for name, _, _ in fields))
        said = [T.tokens(F.coalesce(F.col(name), F.lit(""))).alias(name) for name in names]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cost = sum((_lists(batch.column(k + 1))[1] for k in range(len(names))), np.zeros(batch.num_rows, np.int64))
                for at, end in _cut(cost, AT_ONCE):
                    yield _counted(batch.slice(at, end - at), fields)

        held = materialize(stored.select(F.col("chunk_pos").cast("long").alias("chunk_pos"), *said).mapInArrow(run, HELD), **_PACKED)
        n, average = held.agg(F.count("*"), F.greatest(F.avg("length"), F.lit(1.0))).first()
        tfs = [f"tf_{name}" for name in FIELD_WEIGHTS]
        counted = held.select("chunk_pos", "length", F.inline("hits"))
        seen = (F.col("field").cast("long") * (1 << 32) + F.col("place")).alias("seen")
        counted = counted.select("term", "chunk_pos", *tfs, seen, "length")
        repeated = not held.groupBy("chunk_pos").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
        if repeated:  # rows that share a chunk_pos count as one chunk
            sums = [F.sum(x).alias(x) for x in tfs]
            counted = counted.groupBy("term", "chunk_pos").agg(*sums, F.min("seen").alias("seen")).join(held.select("chunk_pos", "length"), "chunk_pos")
            each = counted.drop("length").distinct()
        else:
            each = counted
        number = F.col("term").rlike("^(0|[1-9][0-9]{0,9})$") & (F.try_to_number("term", F.lit("9999999999")) < 4294967295)
        vocab = each.groupBy("term").agg(F.count("*").alias("df"), F.min("chunk_pos").alias("at"), F.min_by("seen", "chunk_pos").alias("seen"))  # sums of fixed width need no sort
        place = F.struct(F.col("at").alias("chunk_pos"), F.struct(F.shiftright("seen", 32).cast("int").alias("field"), F.col("seen").bitwiseAND(0xFFFFFFFF).cast("int").alias("place")).alias("seen"))
        rank = F.struct(F.when(number, 0).otherwise(1), F.when(number, F.try_to_number("term", F.lit("9999999999")).cast("long")).otherwise(0), place.alias("seen"))
        vocab = materialize(vocab.select("term", T.stem("term").alias("stem"), "df", rank.alias("term_rank")))
    impact = _rarity(n, "df") * _saturated(_weighed({x: F.col(x) for x in tfs}), F.col("length"), F.lit(average))
    postings = counted.join(vocab.select("term", "df"), "term").select("term", "chunk_pos", *tfs, impact.alias("impact"))
    rows = stored.withColumn("tokens", T.tokens("text")).withColumn("length", F.size("tokens").cast("long"))
    return Index(rows, postings, vocab, [owner], None if repeated else held, (n, average))


def chunk_parts(pages: DataFrame, most: int = 1200, overlap: int = 160) -> DataFrame:
    """What ``chunk_rows`` makes its rows of: chunk_pos, page_id, url, title, description, heading_path, body (a part's text), code."""
    from . import structure as S

    parts = S.page_parts(pages.select("page_id", "url", "title", F.coalesce("description", F.lit("")).alias("description"), "content"), most, overlap)
    path = F.coalesce(F.filter("heading_path", lambda x: x.isNotNull()), F.array().cast("array<string>"))
    anchor = T.slug(F.coalesce(F.try_element_at("heading_path", F.lit(-1)), F.lit("")))
    place = F.shiftleft(F.col("page_id").cast("long"), 32) + F.col("n")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return parts.select(place.alias("chunk_pos"), "page_id", "url", "title", "description", path.alias("heading_path"), anchor.alias("anchor"), empty("text").alias("body"), empty("code"))


def with_texts(parts: DataFrame) -> DataFrame:
    """``chunk_parts`` with heading and text."""
    body = F.array_join(F.filter(F.array("body", "code"), lambda x: x != ""), "\n\n")
    text = chunk_text(F.col("title"), F.col("description"), F.col("heading_path"), body)
    return parts.select("chunk_pos", "page_id", "url", "title", "description", F.array_join("heading_path", " ").alias("heading"), "heading_path", "anchor", text.alias("text"), "body", "code")


def chunk_rows(pages: DataFrame, most: int = 1200, overlap: int = 160) -> DataFrame:
    """Pages as the chunks that ``build`` takes: a section's text and code in overlapping parts (SEA-02, ARR-01 to ARR-03).

    ``pages`` has page_id (a number, the pages' order), url, title, description and content. The k-th parts
    of a section's text and code make one chunk, whose text begins with title, description and the path of
    headings. ``chunk_pos`` is the page's number and, in its low 32 bits, the chunk's number within.
    """
    return with_texts(chunk_parts(pages, most, overlap))


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, token, place) of query_id, query; each token of a query, repeats included."""
    return queries.select("query_id", F.posexplode(T.tokens("query")).alias("place", "token"))


def synonyms(spark: SparkSession, more: dict[str, list[str]] | None = None) -> DataFrame:
    """(token, term): built-in synonyms and ``more`` (SEA-06)."""
    rows = [(k, v) for known in (T.SYNONYMS, more or {}) for k, many in known.items() for v in many]
    return spark.createDataFrame(rows, "token string, phrase string").select("token", F.explode(T.tokens("phrase")).alias("term")).distinct()


def expand(queries: DataFrame, index: Index, more: dict[str, list[str]] | None = None) -> DataFrame:
    """(query_id, term, weight): weighted terms of every query (SEA-04, SEA-05; JOI-03 to JOI-06).

    Each token finds itself, terms of its stem, synonyms, terms that begin with it (PREFIX_CAP at most)
    and, if it isn't a term, terms a typo away (TYPO_CAP at most), the caps in the vocabulary's order. A
    term keeps its highest weight. Prefix and typo joins meet on a blocking key: the first four
    characters, or the first one and the length.
    """
    vocab = index.vocab
    token = query_tokens(queries).select("query_id", "token").distinct()
    exact = token.join(vocab.select(F.col("term").alias("token")), "token").select("query_id", F.col("token").alias("term"), F.lit(EXACT).alias("weight"))
    stems = token.withColumn("stem", T.stem("token")).where(F.length("stem") >= 4)
    stemmed = stems.join(vocab.select("stem", "term"), "stem").where("term <> token").select("query_id", "term", F.lit(STEM).alias("weight"))
    syn = token.join(synonyms(queries.sparkSession, more), "token").join(vocab.select("term"), "term").select("query_id", "term", F.lit(SYNONYM).alias("weight"))
    long = token.where(F.length("token") >= 4)
    head = long.withColumn("head", F.left("token", F.lit(4))).join(vocab.select(F.left("term", F.lit(4)).alias("head"), "term", "term_rank"), "head")
    in_order = Window.partitionBy("query_id", "token").orderBy("term_rank")
    prefix = head.where((F.col("term") != F.col("token")) & F.col("term").startswith(F.col("token"))).withColumn("r", F.row_number().over(in_order)).where(F.col("r") <= PREFIX_CAP)
    unknown = long.join(vocab.select(F.col("term").alias("token")), "token", "left_anti").withColumn("most", F.when(F.length("token") >= 7, 2).otherwise(1))
    sized = unknown.withColumn("size", F.explode(F.sequence(F.length("token") - F.col("most"), F.length("token") + F.col("most")))).withColumn("initial", F.left("token", F.lit(1)))
    near = sized.join(vocab.select(F.left("term", F.lit(1)).alias("initial"), F.length("term").alias("size"), "term", "term_rank"), ["initial", "size"])
    typo = near.where(F.levenshtein("token", "term") <= F.col("most")).withColumn("r", F.row_number().over(in_order)).where(F.col("r") <= TYPO_CAP)
    found = exact.union(stemmed).union(syn)
    found = found.union(prefix.select("query_id", "term", F.lit(PREFIX))).union(typo.select("query_id", "term", F.lit(TYPO)))
    return found.groupBy("query_id", "term").agg(F.max("weight").alias("weight"))


def score(expanded: DataFrame, index: Index) -> DataFrame:
    """(query_id, chunk_pos, score): field-weighted BM25 summed over a query's terms (SEA-07, JOI-01, AGG-04).

    Expanded queries meet the postings alone; Spark broadcasts the former where they are small when it runs.
    """
    hits = expanded.join(index.postings.select("term", "chunk_pos", "impact"), "term")
    return hits.groupBy("query_id", "chunk_pos").agg(F.sum(F.col("impact") * F.col("weight")).alias("score"))


def _near(t: Column, q: Column) -> Column:
    """Whether the tokens ``q`` stand in order in ``t``, each within NEAR_WINDOW of the one before (SEA-09)."""

    def follows(start: Column) -> Column:
        def step(at: Column, x: Column) -> Column:
            place = F.array_position(F.slice(t, at + 1, F.lit(NEAR_WINDOW)), x).cast("int")
            return F.when((at < 0) | (place == 0), F.lit(-1)).otherwise(at + place)

        return F.aggregate(F.slice(q, F.lit(2), F.greatest(F.size(q) - 1, F.lit(0))), start + 1, step) >= 0

    starts = F.filter(F.transform(t, lambda x, i: F.when(x == F.element_at(q, 1), i)), lambda i: i.isNotNull())
    return F.exists(starts, follows)


def boost(t: Column, q: Column) -> Column:
    """What a chunk gains where a query's tokens ``q`` stand together in its tokens ``t`` (SEA-08): a phrase, or in order and near."""
    phrase = F.contains(F.array_join(t, " "), F.array_join(q, " "))
    return F.when(F.size(q) < 2, 0.0).when(phrase, PHRASE_BOOST).when(_near(t, q), NEAR_BOOST).otherwise(0.0)


def _near_best(expanded: DataFrame, index: Index, limit: int) -> DataFrame:
    """(query_id, chunk_pos, score): what a boost may lift among a query's best, and more; nothing else can be.

    A chunk's terms stand in one row, so all its scores are summed where that row is; the queries' weighted
    terms go to every task. A task keeps each query's ``limit``-th best score so far and passes on what comes
    as near to it as a boost can bring: the best of all chunks is no less.
    """
    if index.held is None:
        held = index.postings.groupBy("chunk_pos").agg(F.collect_list(F.struct("term", "impact")).alias("hits"))
        held, shares = held.select("chunk_pos", F.lit(0).cast("long").alias("length"), F.col("hits.term").alias("terms"), F.col("hits.impact").alias("impact")), expanded.withColumn("share", F.col("weight"))
    else:
        held = index.held.select("chunk_pos", "length", F.col("hits.term").alias("terms"), *(F.col(f"hits.tf_{name}").alias(f"tf_{name}") for name in FIELD_WEIGHTS))
        shares = expanded.join(index.vocab.select("term", "df"), "term").withColumn("share", F.col("weight") * _rarity(index.size[0], "df"))
    told, average, kind = shares.where("query_id is not null").select("query_id", "term", "share").toArrow().combine_chunks(), index.size[1] if index.held is not None else None, dict(expanded.dtypes)["query_id"]
    by_query, by_term = (told.column(c).combine_chunks().dictionary_encode() for c in ("query_id", "term"))
    by_query, by_term = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (by_query, by_term))
    order = np.lexsort((by_query.indices.to_numpy(), by_term.indices.to_numpy()))
    asked, terms, count = by_query.dictionary, by_term.dictionary, len(by_query.dictionary)
    whose, share = by_query.indices.to_numpy()[order].astype(np.int64), told.column("share").to_numpy()[order]
    starts = np.searchsorted(by_term.indices.to_numpy()[order], np.arange(len(terms) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((limit, count), -np.inf)
        for batch in batches:
            values, size = _lists(batch.column(2))
            code = pc.index_in(values, value_set=terms)
            here = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
            code, row = code.take(pa.array(here)).to_numpy().astype(np.int64), np.repeat(np.arange(batch.num_rows), size)[here]
            told = {name: batch.column(k).flatten().to_numpy()[here] for k, name in enumerate(batch.schema.names) if k > 2}
            worth = told["impact"] if average is None else _saturated(_weighed(told), batch.column(1).to_numpy()[row], average)
            many = starts[code + 1] - starts[code]
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for at, end in _cut(np.bincount(row, many, batch.num_rows).astype(np.int64) + count, AT_ONCE):
                part = slice(first[at], first[end])
                n = many[part]
                entry = np.repeat(starts[code[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                key = np.repeat((row[part] - at) * count, n) + whose[entry]
                score = np.bincount(key, np.repeat(worth[part], n) * share[entry], (end - at) * count).reshape(end - at, count)
                best = np.partition(np.concatenate([best, np.where(score > 0, score, -np.inf)]), -limit, axis=0)[-limit:]
                chunk, query = np.nonzero((score > 0) & (score >= best.min(0) - PHRASE_BOOST - 1e-6))
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(query)), batch.column(0).take(pa.array(chunk + at)), pa.array(score[chunk, query])], names=["query_id", "chunk_pos", "score"])

    ship(expanded.sparkSession)
    known = f"query_id {kind}, chunk_pos {dict(held.dtypes)['chunk_pos']}, score double"
    if not count:
        return expanded.sparkSession.createDataFrame([], known)
    return held.mapInArrow(run, known)


def search(queries: DataFrame, index: Index, limit: int = LIMIT, more: dict[str, list[str]] | None = None) -> DataFrame:
    """(query_id, rank, chunk_pos, url, excerpt, score): the best chunks of every query (SEA-10, SEA-11).

    Scores are rounded to 9 places before they are ranked; ties go to the URL, then the chunk. A boost adds
    PHRASE_BOOST at most, so only chunks whose own score comes that near to a query's ``limit``-th best are
    looked at for it: the others can't be among the best. Excerpts are made for what is left only. Small
    tables between are written to the shared folder, so that their sizes are known; they go with the index.
    """
    with scratch_of(index.kept[0] if index.kept else ""):
        expanded = materialize(expand(queries, index, more))
        asked = queries.select("query_id", T.tokens("query").alias("asked"))
        scored = materialize(_near_best(expanded, index, limit))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        least = scored.withColumn("r", place).where(F.col("r") <= limit).groupBy("query_id").agg(F.min("score").alias("least"))
        near = materialize(scored.join(least, "query_id").where(F.col("score") >= F.col("least") - PHRASE_BOOST - 1e-6).drop("least"))
        boosted = near.join(index.chunks.select("chunk_pos", "url", "tokens"), "chunk_pos").join(asked, "query_id")
        boosted = boosted.withColumn("score", F.round(F.col("score") + boost(F.col("tokens"), F.col("asked")), 9)).drop("tokens")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "url", "chunk_pos")
        top = materialize(boosted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit))
    terms = expanded.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    cut = T.excerpt("text", F.concat("asked", "terms"))
    return top.join(terms, "query_id").join(index.chunks.select("chunk_pos", "text"), "chunk_pos").select("query_id", "rank", "chunk_pos", "url", cut.alias("excerpt"), "score")


def phrase_hits(queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, chunk_pos): chunks whose tokens hold those of a query, two or more, as a phrase (SEA-08).

    A phrase may begin and end inside a token, so only its tokens but the first and last stand whole in a
    chunk: the rarest of them finds the chunks. Two tokens meet terms that begin with the second one.
    """
    q = queries.select("query_id", T.tokens("query").alias("q")).where(F.size("q") >= 2)
    middle = q.where(F.size("q") > 2).select("query_id", F.explode(F.array_distinct(F.slice("q", F.lit(2), F.size("q") - 2))).alias("term"))
    known = middle.join(index.vocab.select("term", "df"), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = known.groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    pairs = q.where(F.size("q") == 2).select("query_id", F.get("q", F.lit(1)).alias("last")).withColumn("head", F.left("last", F.lit(2)))
    begun = pairs.join(index.vocab.select("term", F.left("term", F.lit(2)).alias("head")), "head").where(F.col("term").startswith(F.col("last"))).select("query_id", "term")
    found = rarest.union(begun).join(index.postings.select("term", "chunk_pos"), "term").select("query_id", "chunk_pos").distinct()
    both = found.join(q, "query_id").join(index.chunks.select("chunk_pos", "tokens"), "chunk_pos")
    return both.where(F.contains(F.array_join("tokens", " "), F.array_join("q", " "))).select("query_id", "chunk_pos")


def first_per_page(hits: DataFrame) -> DataFrame:
    """The best chunk of each page of a query (SEA-19, WIN-08)."""
    w = Window.partitionBy("query_id", "url").orderBy("rank")
    return hits.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def answer_context(hits: DataFrame, most: int = CONTEXT_CHARS, sources: int = SOURCES) -> DataFrame:
    """(query_id, citation, chunk_pos, context): hits with their text until ``most`` characters are used (SEA-18, WIN-04).

    ``hits`` has query_id, rank, chunk_pos and text. A source's context is trimmed after it is cut, so that
    white space at a cut stays for the next.
    """
    ranked = hits.where(F.col("rank") <= sources).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_pos", "text"))).alias("hits"))  # ``sources`` at most

    def step(a: Column, x: Column) -> Column:
        cut = F.trim(F.substring(x["text"], F.lit(1), F.greatest(a["left"], F.lit(0))))
        row = F.struct(x["rank"].alias("citation"), x["chunk_pos"].alias("chunk_pos"), cut.alias("context"))
        return F.when(cut == "", a).otherwise(F.struct((a["left"] - F.length(cut)).alias("left"), F.concat(a["out"], F.array(row)).alias("out")))

    start = F.struct(F.lit(most).alias("left"), F.array().cast("array<struct<citation:int,chunk_pos:bigint,context:string>>").alias("out"))
    folded = F.aggregate("hits", start, step)
    return ranked.select("query_id", F.explode(folded["out"]).alias("s")).select("query_id", "s.*")


def size_report(index: Index) -> DataFrame:
    """One row: sizes and whether they exceed the warning limits (SEA-30)."""
    chunks = index.chunks.agg(F.count("*").alias("chunks"), F.sum(F.octet_length("text")).alias("content_bytes"))
    terms = index.vocab.agg(F.count("*").alias("terms"), F.sum("df").alias("postings"))
    return chunks.crossJoin(terms).withColumn("too_many_chunks", F.col("chunks") > 10_000).withColumn("too_large", F.col("content_bytes") > 10 << 20)


def grep(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines (path, line_no, line) that match (SEA-28)."""
    return lines.where(F.col("line").rlike(pattern))


def word_count(files: DataFrame) -> DataFrame:
    """Lines, words and bytes of (path, content) (SEA-28)."""
    body = F.col("content")
    return files.select("path", (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))).cast("long").alias("lines"), F.size(F.filter(F.split(body, r"\s+"), lambda x: x != "")).cast("long").alias("words"), F.octet_length(body).cast("long").alias("bytes"))
