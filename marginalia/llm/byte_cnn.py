"""Operator 10: a byte-level convolutional network in numpy that scores quality.

Filters over bytes are tables: a filter of width w adds one entry for each byte it sees. Their outputs are
max-pooled over overlapping chunks that cover the whole text; mean, maximum and minimum of the pooled
chunks go through one hidden layer to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import over_batches, raw, texts

WIDTH, FILTERS, HIDDEN = 5, 16, 16
#: A chunk has STRIDE places of a filter; chunks overlap by WIDTH - 1 bytes.
STRIDE = 256
#: The labelled sample: documents of each label at most, and characters of all together, about.
SAMPLE, SAMPLE_CHARS = 1200, 48_000_000
EPOCHS, BATCH, RATE, SEED = 14, 32, 0.01, 7
PREDICT = 0.3


@dataclass
class Network:
    """table: (WIDTH, 256, FILTERS); the rest: biases, hidden layer and output. A constant one has a prior alone."""

    table: np.ndarray
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float | None = None


def chunked(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of STRIDE + WIDTH - 1 bytes, one chunk a row, and each text's first chunk.

    Each text has a chunk at least; what lies beyond its end is 0.
    """
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // STRIDE))
    first = np.concatenate([[0], np.cumsum(count)])
    flat = np.zeros((int(first[-1]) + 1) * STRIDE, np.uint8)
    flat[np.repeat(first[:-1] * STRIDE - offsets[:-1], size) + np.arange(len(body))] = body
    ends = np.zeros(int(first[-1]), bool)
    ends[first[1:] - 1] = True
    rows = np.zeros((int(first[-1]), STRIDE + WIDTH - 1), np.uint8)
    rows[:, :STRIDE] = flat[:-STRIDE].reshape(-1, STRIDE)
    rows[:, STRIDE:] = np.where(ends[:, None], 0, flat.reshape(-1, STRIDE)[1:, : WIDTH - 1])
    return rows, first


def convolve(net: Network, rows: np.ndarray) -> np.ndarray:
    """(chunks, STRIDE, FILTERS): every filter at every place."""
    out = net.table[0][rows[:, :STRIDE]]
    for k in range(1, WIDTH):
        out += net.table[k][rows[:, k : k + STRIDE]]
    return out


def _pool(net: Network, rows: np.ndarray, at_once: int = 512) -> np.ndarray:
    out = np.empty((len(rows), FILTERS), np.float32)
    for i in range(0, len(rows), at_once):
        out[i : i + at_once] = convolve(net, rows[i : i + at_once]).max(1)
    return np.maximum(out + net.bias, 0)


def _peaks(net: Network, rows: np.ndarray, at_once: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, FILTERS): each filter's largest output, without bias, and its place."""
    out, where = np.empty((len(rows), FILTERS), np.float32), np.empty((len(rows), FILTERS), np.int64)
    for i in range(0, len(rows), at_once):
        conv = convolve(net, rows[i : i + at_once])
        where[i : i + at_once] = conv.argmax(1)
        out[i : i + at_once] = np.take_along_axis(conv, where[i : i + at_once, None], 1)[:, 0]
    return out, where


def _gather(pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
    at = first[:-1]
    mean = np.add.reduceat(pooled, at, axis=0) / np.diff(first)[:, None]
    return np.concatenate([mean, np.maximum.reduceat(pooled, at, axis=0), np.minimum.reduceat(pooled, at, axis=0)], 1)


def score(net: Network, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The probability of label 1 for each text."""
    if net.prior is not None:
        return np.full(len(offsets) - 1, net.prior)
    rows, first = chunked(body, offsets)
    x = _gather(_pool(net, rows), first)
    hidden = np.maximum(x @ net.w1 + net.b1, 0)
    return 1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -30, 30).astype(np.float64)))


def gradients(net: Network, rows: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The weighted mean log loss of documents (chunks ``rows``, see ``chunked``) and its derivatives by the network's parameters."""
    peaks, where = _peaks(net, rows)
    pre = peaks + net.bias
    pooled = np.maximum(pre, 0)
    x = _gather(pooled, first)
    h0 = x @ net.w1 + net.b1
    h = np.maximum(h0, 0)
    out = 1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -30, 30)))
    loss = -float((weight * np.where(y == 1, np.log(out), np.log1p(-out))).mean())
    d = (out - y) * weight / len(y)
    g = {"w2": h.T @ d, "b2": np.array([d.sum()], np.float32)}
    dh = np.outer(d, net.w2) * (h0 > 0)
    g["w1"], g["b1"] = x.T @ dh, dh.sum(0)
    dx = dh @ net.w1.T
    count = np.diff(first)
    doc = np.repeat(np.arange(len(y)), count)
    dp = (dx[:, :FILTERS] / count[:, None])[doc]
    for k in (1, 2):  # the gradient of a maximum or minimum goes to the chunks that have it
        same = (pooled == x[doc, k * FILTERS : (k + 1) * FILTERS]).astype(np.float32)
        dp += dx[doc, k * FILTERS : (k + 1) * FILTERS] * same / np.maximum(np.add.reduceat(same, first[:-1], axis=0), 1)[doc]
    dp *= pre > 0
    g["bias"] = dp.sum(0)
    g["table"] = np.zeros_like(net.table)
    column, chunk = np.broadcast_to(np.arange(FILTERS), where.shape), np.arange(len(rows))[:, None]
    for k in range(WIDTH):
        np.add.at(g["table"][k], (rows[chunk, where + k], column), dp)
    return loss, g


def fit(sample: list[tuple[str, int]], epochs: int = EPOCHS) -> Network:
    """Train on (text, label) pairs by Adam on the log loss; labels weigh the same in sum.

    With fewer than two labels in the sample, every score is its mean label (0.5 if empty).
    """
    y = np.array([q for _, q in sample], np.float32)
    rng = np.random.default_rng(SEED)
    none = np.zeros(0, np.float32)
    if len(set(y.tolist())) < 2:
        return Network(none, none, none, none, none, 0.0, float(y.mean()) if len(y) else 0.5)
    p = {
        "table": (rng.normal(0, 0.3, (WIDTH, 256, FILTERS))).astype(np.float32), "bias": np.zeros(FILTERS, np.float32),
        "w1": rng.normal(0, 0.25, (3 * FILTERS, HIDDEN)).astype(np.float32), "b1": np.zeros(HIDDEN, np.float32),
        "w2": rng.normal(0, 0.3, HIDDEN).astype(np.float32), "b2": np.zeros(1, np.float32),
    }
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    data = [np.frombuffer(text.encode("utf-8", "replace"), np.uint8) for text, _ in sample]
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        rate = RATE * (0.5 if epoch >= epochs * 2 // 3 else 1)
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            rows, first = chunked(np.concatenate([data[i] for i in some]), np.concatenate([[0], np.cumsum([len(data[i]) for i in some])]))
            _, g = gradients(Network(p["table"], p["bias"], p["w1"], p["b1"], p["w2"], float(p["b2"][0])), rows, first, y[some], weight[some])
            t += 1
            for k, x in p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                x -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-6)).astype(np.float32)
    return Network(p["table"], p["bias"], p["w1"], p["b1"], p["w2"], float(p["b2"][0]))


def fold(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of a doc_id's text, modulo 5; 0 is held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def sample(docs: DataFrame, labels: DataFrame, each: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """Labelled documents, whole, none held out: at most ``each`` of each label, those with the least hashes of doc_id.

    They are taken in the order of these hashes until they have ``chars`` characters together, one at least of each label.
    Of texts that share a doc_id, the least one counts.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max("quality").alias("q"))
    marked = marked.withColumn("h", F.xxhash64("doc_id"))
    few = marked.where("q = 0").orderBy("h", "doc_id").limit(each).union(marked.where("q = 1").orderBy("h", "doc_id").limit(each))
    rows = texts(docs).join(F.broadcast(few), "doc_id").groupBy("doc_id", "q", "h").agg(F.min("text").alias("text"))  # ``each`` bounds ``few``
    total, taken, seen = 0, [], set()
    for _, i, q, n in sorted(rows.select("h", "doc_id", "q", F.length("text")).collect()):
        if total < chars or q not in seen:
            taken.append(i)
            seen.add(q)
            total += n
    found = rows.where(F.col("doc_id").isin(taken)).select("doc_id", "text", "q").collect()
    return [(text, q) for _, text, q in sorted(found)]


def classify(docs: DataFrame, labels: DataFrame, threshold: float = PREDICT) -> DataFrame:
    """Score every document's whole text by a network trained on a bounded sample of the labelled ones.

    Takes doc_id and text, and of ``labels`` doc_id and quality (other values than 0 and 1 are ignored).
    Returns doc_id, held_out, score and predicted for each input row; a null text is an empty one. Equal
    texts have equal scores, as these are rounded to 9 places: sums in another order differ by less. Rows
    without doc_id are scored too; labels of held-out rows are never read. An empty table gives no rows.
    """
    net = fit(sample(docs, labels))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = np.round(score(net, *raw(batch.column(1))), 9)
        cols = [batch.column(0), batch.column(2), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted"])

    rows = texts(docs).withColumn("held_out", F.coalesce(fold() == 0, F.lit(False)))
    return over_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def accuracy(scored: pd.DataFrame, labels: pd.DataFrame) -> float:
    """Held-out accuracy of ``predicted``."""
    both = scored[scored.held_out].merge(labels, on="doc_id")
    return float((both.predicted == both.quality).mean())
