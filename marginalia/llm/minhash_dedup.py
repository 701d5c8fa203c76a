"""Operator 9: near duplicates by fast similarity sketching, banding and exact verification.

A sketch has BINS coordinates. In each round every shingle is hashed into one bin; a bin keeps the least
hash of the first round that reached it; after BINS rounds, round i fills bin i - BINS by all shingles, so
that no coordinate stays empty. Documents that agree in all coordinates of a band are candidates.

Identical sets become one class first. Candidates with a plausible estimate form clusters; a cluster's
texts meet in tasks of bounded size, where links are confirmed on full sets. What a large cluster's tasks
can't link through its hubs is compared with all of the cluster, block by block: sketches first, then the
texts of those that have a plausible partner in the other block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SLICE_BYTES, materialize, over_batches, partitions_for, raw, repeats_ids, texts
from .components import components, join_by_parts
from .words import hashes, mix, split, windows

#: 32 bands of 4: a pair of similarity 0.8 shares none with probability 5e-8.
BINS, BAND = 128, 4
#: Standard deviations by which an estimate may fall short of the threshold.
SLACK = 5.2
#: Members of a bucket that are compared with each other; of a larger one, all join its first member.
BUCKET = 512
#: Members of a cluster in one task, about, and hubs that every task of a larger cluster gets.
TASK, HUBS = 128, 8
#: Members of a cluster in one block of what is compared after that, about.
BLOCK = 256

SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary"


def shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the first of each; A-Z are lower-cased."""
    body, offsets = raw(column)
    words = split(body, offsets)
    h = hashes(body, words, lower=True)
    count = np.diff(words.first)
    place = np.arange(len(h)) - words.first[words.doc]
    whole = windows(h, k)
    at = np.flatnonzero(place + k <= count[words.doc])
    value, doc = whole[at], words.doc[at]
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        alone = [int(windows(h[words.first[i] : words.first[i + 1]], int(count[i]), seed=int(count[i]))[0]) for i in few]
        value, doc = np.concatenate([value, np.array(alone, np.uint64)]), np.concatenate([doc, few])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(offsets)))


def sketches(value: np.ndarray, first: np.ndarray, bins: int = BINS) -> np.ndarray:
    """A row of ``bins`` 64-bit coordinates for each set; zeros for an empty one."""
    n = len(first) - 1
    size = np.diff(first)
    none = np.uint64(2**64 - 1)
    out = np.full(n * bins, none)
    doc = np.repeat(np.arange(n), size)
    for i in range(2 * bins):
        if not len(value):
            break
        x = mix(value + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        bin_ = doc * bins + ((x & np.uint64(bins - 1)).astype(np.int64) if i < bins else i - bins)
        free = out[bin_] == none
        if free.any():
            fill = np.full(n * bins, none) if i == 0 else None
            if fill is None:
                spots, back = np.unique(bin_[free], return_inverse=True)
                least = np.full(len(spots), none)
                np.minimum.at(least, back, x[free])
                out[spots] = least
            else:
                np.minimum.at(out, bin_, x)
        short = (out.reshape(n, bins) == none).any(1)
        keep = short[doc]
        if not keep.all():
            value, doc = value[keep], doc[keep]
    out[out == none] = 0
    return out.reshape(n, bins)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """One row a document: the size and 128-bit hash of its shingle set, band hashes, and a byte of each coordinate."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        value, first = shingles(batch.column(1), k)
        n = batch.num_rows
        size = np.diff(first)
        sums = []
        for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(salt)))])
            sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
        rows = sketches(value, first)
        band = rows.reshape(n, BINS // BAND, BAND)
        key = np.full((n, BINS // BAND), np.uint64(0)) + np.arange(BINS // BAND, dtype=np.uint64)
        for j in range(BAND):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + band[:, :, j])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * (BINS // BAND) + 1, BINS // BAND), pa.int32()), pa.array(key.view(np.int64).ravel()))
        tiny = mix(rows).astype(np.uint8)
        cols = [batch.column(0), pa.array(size, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), lists, pa.array([x.tobytes() for x in tiny], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SKETCH.split(", ")])

    return over_batches(texts(docs), run, SKETCH)


def _floor(threshold: int) -> int:
    """Equal coordinates that a pair at the threshold has at least, but for a chance of about 1e-7."""
    p = threshold / 100
    return int(BINS * (p - SLACK * (p * (1 - p) / BINS) ** 0.5))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of sorted batches cut where the first ``keys`` columns change; equal keys stay together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = tuple(c[0] for c in cols) != last
        cuts = np.flatnonzero(change)
        last = tuple(c[-1] for c in cols)
        if not len(cuts):
            held.append(batch)
            continue
        if cuts[0] > 0:
            held.append(batch.slice(0, int(cuts[0])))
        if held:
            yield pa.Table.from_batches(held)
        tail = int(cuts[-1])
        if tail > cuts[0]:
            yield pa.Table.from_batches([batch.slice(int(cuts[0]), tail - int(cuts[0]))])
        held = [batch.slice(tail)]
    if held:
        yield pa.Table.from_batches(held)


def _bucket_links(batches: Iterator[pa.RecordBatch], floor: int) -> Iterator[pa.RecordBatch]:
    """(a, b): a spanning forest of each bucket's members by plausible estimates. Columns: key, doc_id, sketch."""
    for table in _runs(batches, 1):
        key = table.column(0).to_numpy()
        ids = table.column(1).to_numpy()
        s = np.frombuffer(b"".join(table.column(2).to_pylist()), np.uint8).reshape(len(ids), BINS)
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([cuts, [len(key)]]))
        pair = cuts[size == 2]
        a, b = [ids[pair]], [ids[pair + 1]]
        near = (s[pair] == s[pair + 1]).sum(1) >= floor
        a[0], b[0] = a[0][near], b[0][near]
        for c, n in zip(cuts[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            rows, some = s[c : c + n], ids[c : c + n]
            left = np.arange(n)
            while len(left) > 1:
                seed, left = int(left[0]), left[1:]
                front = [seed]
                while front and len(left):
                    near = (rows[left] == rows[front.pop()]).sum(1) >= floor
                    if near.any():
                        a.append(some[left[near]])
                        b.append(np.full(int(near.sum()), some[seed]))
                        front += left[near].tolist()
                        left = left[~near]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether 100 * intersection >= threshold * union, of sorted distinct hashes."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < threshold * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= threshold * (len(x) + len(y) - both)


class _Forest:
    """Components of a task's documents."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _groups(table: pa.Table) -> Iterator[pa.Table]:
    """Whole groups (of the first two columns) of ``table``, each time about SLICE_BYTES of the column text, one group at least."""
    keys = [table.column(i).to_numpy() for i in (0, 1)]
    cuts = np.flatnonzero(np.concatenate([[True], (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]), [True]]))
    size = np.concatenate([[0], np.cumsum(pc.binary_length(table.column("text")).to_numpy())])
    at = 0
    while at < len(cuts) - 1:
        end = max(at + 1, int(np.searchsorted(size[cuts], size[cuts[at]] + SLICE_BYTES, side="right")) - 1)
        yield table.slice(int(cuts[at]), int(cuts[end] - cuts[at]))
        at = end


def _confirm(batches: Iterator[pa.RecordBatch], k: int, threshold: int, floor: int, blocks: bool) -> Iterator[pa.RecordBatch]:
    """(a, b): confirmed links that join the components of a task's documents.

    Columns: cluster, chunk, guest, label, doc_id, sketch, text; sorted by the first three. Members (guest
    0) of a chunk are compared with each other where their labels differ; each guest with all members.
    ``blocks``: chunks are pairs of blocks; members are compared with each other only where both are the same.
    """
    for table in (part for run in _runs(batches, 2) for part in _groups(run)):
        keys = np.stack([table.column(0).to_numpy(), table.column(1).to_numpy()])
        cuts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
        value, first = shingles(table.column("text").combine_chunks(), k)
        sets = [value[p:q] for p, q in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        guest, label, ids = (table.column(i).to_numpy() for i in (2, 3, 4))
        s = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint8).reshape(len(ids), BINS)
        out: list[tuple[int, int]] = []
        for c, d in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)], strict=True):
            members = int((guest[c:d] == 0).sum())
            forest = _Forest(d - c)
            seen: dict[int, int] = {}
            for i in range(d - c):  # what earlier rounds have linked
                forest.join(seen.setdefault(int(label[c + i]), i), i)
            chunk = int(keys[1, c])
            for i in range(members if blocks and chunk >> 31 != chunk & 0x7FFFFFFF else 1, d - c):
                until = min(i, members)
                same = (s[c : c + until] == s[c + i]).sum(1)
                for j in np.argsort(-same, kind="stable")[: int((same >= floor).sum())].tolist():
                    if forest.root(i) != forest.root(j) and _similar(sets[c + i], sets[c + j], threshold):
                        forest.join(i, j)
                        out.append((int(ids[c + i]), int(ids[c + j])))
        a, b = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


PACKED = "cluster long, block int, blocks int, has_apart boolean, ids binary, labels binary, sketches binary, apart binary"
NEEDED = "cluster long, chunk long, doc_id long, guest int"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block. Columns: cluster, block, blocks, doc_id, label, sketch, apart; sorted by the first two."""
    for table in _runs(batches, 2):
        cluster, block, blocks, ids, label = (table.column(i).to_numpy() for i in range(5))
        sketch, apart = table.column(5).to_pylist(), table.column(6).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], (cluster[1:] != cluster[:-1]) | (block[1:] != block[:-1]), [True]])).tolist()
        rows = [
            (int(cluster[a]), int(block[a]), int(blocks[a]), bool(apart[a:b].any()), ids[a:b].tobytes(), label[a:b].tobytes(), b"".join(sketch[a:b]), apart[a:b].tobytes())
            for a, b in zip(cuts[:-1], cuts[1:], strict=True)
        ]
        types = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in PACKED.split(", ")])


def _block(row: dict, mark: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(row[mark + x], np.int64) for x in ("ids", "labels"))
    return ids, labels, np.frombuffer(row[mark + "sketches"], np.uint8).reshape(len(ids), BINS), np.frombuffer(row[mark + "apart"], bool)


def _needed(batches: Iterator[pa.RecordBatch], floor: int) -> Iterator[pa.RecordBatch]:
    """Of pairs of blocks, the documents with a plausible partner of another label: guests (those apart of the
    first block), and members of the second one. A pair of documents that are both apart is met in one order of the blocks."""
    for batch in batches:
        rows: list[tuple[np.ndarray, ...]] = []
        for row in batch.to_pylist():
            ids, labels, sketch, apart = _block(row, "g_")
            ids, labels, sketch = ids[apart], labels[apart], sketch[apart]
            others, other_labels, other_sketch, other_apart = _block(row, "")
            own, block = row["g_block"], row["block"]
            if own < block:
                others, other_labels, other_sketch = others[~other_apart], other_labels[~other_apart], other_sketch[~other_apart]
            met, wanted = np.zeros(len(others), bool), np.zeros(len(ids), bool)
            for i in range(len(ids)):
                near = ((other_sketch == sketch[i]).sum(1) >= floor) & (other_labels != labels[i])
                wanted[i] = near.any()
                met |= near
            members, guests = others[met], ids[wanted]
            if own == block:
                members, guests = np.unique(np.concatenate([members, guests])), guests[:0]
            n = len(members) + len(guests)
            rows.append((np.full(n, row["cluster"]), np.full(n, (block << 31) + own), np.concatenate([members, guests]), np.repeat([0, 1], [len(members), len(guests)])))
        if rows:
            cluster, chunk, ids, guest = (np.concatenate(x) for x in zip(*rows, strict=True))
            cols = [pa.array(cluster, pa.int64()), pa.array(chunk, pa.int64()), pa.array(ids, pa.int64()), pa.array(guest, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in NEEDED.split(", ")])


def _components(docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of ``docs``, whose doc_ids are unique and not null."""
    n, floor = partitions_for(docs), _floor(threshold)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("part")
    rows = materialize(sketch(docs, k))
    some = rows.where("n_shingles > 0")
    # Copies of a set are counted, and find their class, by parts, so that a large class isn't one task's.
    alike = ["set_a", "set_b", "n_shingles"]
    counted = some.groupBy(*alike, part).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = counted.groupBy(*alike).agg(F.min("rep").alias("rep"), F.sum("copies").alias("copies"))
    reps = classes.select(F.col("rep").alias("doc_id")).join(some, "doc_id").select("doc_id", "bands", "sketch")

    member = reps.select("doc_id", F.explode("bands").alias("key"))
    bucket = member.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1")
    shared = materialize(member.join(bucket, "key"))
    small = shared.where(F.col("n") <= BUCKET).select("doc_id", "key").join(reps.select("doc_id", "sketch"), "doc_id")
    near = small.select("key", "doc_id", "sketch").repartition(n, "key").sortWithinPartitions("key", "doc_id").mapInArrow(lambda it: _bucket_links(it, floor), "a long, b long")
    large = shared.where((F.col("n") > BUCKET) & (F.col("doc_id") != F.col("least"))).select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    cluster = components(near.union(large)).withColumnRenamed("component", "cluster")

    size = cluster.groupBy("cluster").agg(F.count("*").alias("members"))
    parts = F.ceil(F.col("members") / TASK).cast("int")
    placed = materialize(
        join_by_parts(cluster, size, ["cluster"], "id", n).select(F.col("id").alias("doc_id"), "cluster", "members", parts.alias("parts"), F.pmod(F.xxhash64("id"), parts).cast("long").alias("chunk"))
    )
    whole = texts(docs).repartition(n, "doc_id").join(placed.hint("shuffle_hash"), "doc_id").join(some.select("doc_id", "sketch").hint("shuffle_hash"), "doc_id")
    whole = materialize(whole.select("cluster", "chunk", "members", "parts", "doc_id", "sketch", "text"))
    columns = ["cluster", "chunk", "guest", "label", "doc_id", "sketch", "text"]

    def confirm(rows: DataFrame, blocks: bool) -> DataFrame:
        dealt = rows.select(columns).repartition(n, "cluster", "chunk").sortWithinPartitions("cluster", "chunk", "guest", "doc_id")
        return dealt.mapInArrow(lambda it: _confirm(it, k, threshold, floor, blocks), "a long, b long")

    meet = whole.withColumn("guest", F.lit(0)).withColumn("label", F.col("doc_id"))
    large = placed.where("parts > 1")
    split_any = not large.isEmpty()
    if split_any:
        degree = large.select("doc_id", "cluster").join(shared.select("doc_id", "n"), "doc_id").groupBy("cluster", "doc_id").agg(F.sum("n").alias("degree"))
        order = Window.partitionBy("cluster").orderBy(F.desc("degree"), "doc_id")
        top = degree.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= HUBS).select("doc_id")
        hubs = materialize(whole.where("parts > 1").join(top, "doc_id").withColumnRenamed("chunk", "own"))
        hubs = hubs.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).where("chunk <> own").withColumn("guest", F.lit(1)).withColumn("label", F.col("doc_id"))
        meet = meet.select(columns).union(hubs.select(columns))
    links = materialize(confirm(meet, False))
    found = components(links)
    if split_any:
        labelled = whole.where("parts > 1").join(found.select(F.col("id").alias("doc_id"), F.col("component")), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id"))
        labelled = materialize(labelled.select("cluster", "members", "doc_id", "sketch", "text", "label"))
        most = labelled.groupBy("cluster", "label").agg(F.count("*").alias("held")).groupBy("cluster").agg(F.max_by("label", F.struct("held", -F.col("label"))).alias("main"))
        blocks = F.ceil(F.col("members") / BLOCK).cast("int")
        grouped = join_by_parts(labelled.drop("text"), most, ["cluster"], "doc_id", n).select("cluster", F.pmod(F.xxhash64("doc_id"), blocks).cast("int").alias("block"), blocks.alias("blocks"), "doc_id", "label", "sketch", (F.col("label") != F.col("main")).alias("apart"))
        packed = materialize(grouped.repartition(n, "cluster", "block").sortWithinPartitions("cluster", "block").mapInArrow(_pack, PACKED))
        own = packed.where("has_apart").select("cluster", F.col("block").alias("g_block"), *(F.col(x).alias("g_" + x) for x in ("ids", "labels", "sketches", "apart")), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        pairs = own.join(packed.drop("blocks", "has_apart"), ["cluster", "block"])
        needed = materialize(pairs.mapInArrow(lambda it: _needed(it, floor), NEEDED))
        more = confirm(needed.join(labelled.select("doc_id", "label", "sketch", "text"), "doc_id"), True)
        found = components(links.union(more))

    again = counted.drop("rep", "copies").join(classes.where("copies > 1").drop("copies"), alike)
    of = some.select("doc_id", *alike, part).join(again, [*alike, "part"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    named = of.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return named.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _judged(docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, stays) of rows with a doc_id; ``row`` is what tells them apart, ``stays`` true for one of a component."""
    docs = docs.where("doc_id is not null")
    if not repeats_ids(docs):
        return _components(docs, k, threshold).select(F.col("doc_id").alias("row"), "doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("stays"))
    keyed = docs.select(row_of(), "doc_id", "text")
    found = _components(keyed.dropDuplicates(["row"]).select(F.col("row").alias("doc_id"), "text"), k, threshold).withColumnRenamed("doc_id", "row")
    named = keyed.select("row", "doc_id").join(found, "row")
    least = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("least"))
    return named.join(least, "component_id").select("row", "doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("stays"))


def row_of() -> Column:
    """A hash that tells rows of different doc_id or text apart."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """Every row with the component of its near duplicates.

    Takes doc_id and text; other columns are ignored. A document's set holds its distinct shingles of ``k`` words,
    A-Z lower-cased; with fewer words, the whole sequence; without any (null or empty text), none, and it
    is linked with nothing. Documents are linked where 100 * intersection >= threshold * union. Returns
    doc_id, n_shingles, component_id (the least doc_id that links reach) and kept (doc_id is that).
    Rows that share a doc_id are documents of their own, linked by their texts like any others; a row
    without doc_id is linked with nothing and kept, its component_id null. An empty table gives no rows.
    Identical sets are one class by a 128-bit hash. A link is missed where no band of 4 coordinates
    agrees, or an estimate is SLACK deviations low: each about 1e-7 at the threshold. There is no cap on
    partners: what the tasks of a large cluster leave apart is compared with all of that cluster, in
    blocks of about BLOCK, of which a task holds two at a time.
    """
    alone = sketch(docs.where("doc_id is null"), k).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    found = _judged(docs, k, threshold).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return found.union(alone)


def without_near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that with the least doc_id (of several, that with the least hash of its text); all columns stay, and rows without doc_id.

    Of rows that repeat doc_id and text, the one whose columns come first as JSON stays.
    """
    told = _judged(docs, k, threshold)
    if not repeats_ids(docs):
        return docs.join(told.where("not stays").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.where("doc_id is not null").select(row_of(), F.struct(*columns).alias("whole"))
    one = rows.join(told.where("stays").select("row"), "row", "left_semi").groupBy("row").agg(F.min_by("whole", F.to_json("whole")).alias("whole"))
    return one.select([F.col(f"whole.`{c}`").alias(c) for c in docs.columns]).union(docs.where("doc_id is null"))
