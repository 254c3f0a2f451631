"""Quality probability of a document by a byte-level convolutional network written in numpy.

Bytes are embedded; learned filters look at chunks of ``WIDTH`` bytes that start every ``STRIDE`` bytes, so chunks
overlap and cover the whole document; each filter's largest response over all chunks feeds one logistic unit.
The network is fitted on the driver on at most ``train_docs`` labelled documents of at most ``train_bytes`` bytes in all (a
bounded sample of whole texts, half of either label, by the order of a hash of their ids; one that would go beyond the
bytes is passed over); scoring reads every byte of every document.

Defined cases: a null, empty or blank text has probability 0; without labels of both kinds nothing can be learned
and every other text has probability 1; a document with several labels counts with its least one, one with several
texts with the least; labels without a document, with null ids or null values are left out; other columns of ``docs`` pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, bounded_batches, column, fresh, spans, text_parts

WIDTH, STRIDE = 16, 4
EMBED, FILTERS = 8, 32
TRAIN_DOCS = 1200
TRAIN_BYTES = 64 << 20
EPOCHS = 6
BATCH = 32
STEPS = 300
#: Chosen on one part of the labels that weren't learned from; on another 0.04 % of good documents fall below it and 92 % of bad ones.
ACCEPT = 0.2
SLICE = 1 << 16

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Network:
    """``embed``: (256, EMBED); ``filters``: (WIDTH * EMBED, FILTERS); the rest: biases and output weights."""

    embed: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    bias: float


def _blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes laid out in blocks of STRIDE, each row padded so that its last chunk is whole; first and past-last chunk of each row."""
    lengths = np.diff(offsets)
    real = np.maximum(1, -(-lengths // STRIDE))
    total = real + WIDTH // STRIDE - 1
    begin = np.cumsum(total) - total
    laid = np.zeros(int(total.sum()) * STRIDE, np.uint8)
    laid[np.arange(len(data)) + np.repeat(begin * STRIDE - offsets[:-1], lengths)] = data
    return laid, begin, begin + real


def _responses(net: Network, laid: np.ndarray) -> np.ndarray:
    """Response of every filter to every chunk; those of chunks that cross rows are to be left out."""
    steps = WIDTH // STRIDE
    x = np.take(net.embed, laid, axis=0).reshape(-1, STRIDE * EMBED)
    parts = net.filters.reshape(steps, STRIDE * EMBED, FILTERS)
    n = len(x) - steps + 1
    y = x[:n] @ parts[0]
    for k in range(1, steps):
        y += x[k : k + n] @ parts[k]
    return y


def probabilities(net: Network | None, texts: pa.Array) -> np.ndarray:
    data, offsets = text_parts(texts)
    out = np.zeros(len(offsets) - 1)
    for low, high in spans(offsets, SLICE):
        part = offsets[low : high + 1]
        own, at = data[part[0] : part[-1]], part - part[0]
        filled = np.concatenate([[0], np.cumsum(~_BLANK[own])])
        filled = filled[at[1:]] > filled[at[:-1]]
        if net is None:
            out[low:high] = filled
            continue
        best = np.full((high - low, FILTERS), -np.inf, np.float32)
        laid, first, past = _blocks(own, at)
        per = SLICE // STRIDE  # a very long row is worked off in pieces; the largest response is that of all
        if high - low > 1 or len(laid) <= 2 * SLICE:
            y = _responses(net, laid)
            edges = np.stack([first, past], axis=1).reshape(-1)
            if edges[-1] == len(y):
                edges = edges[:-1]
            best = np.maximum.reduceat(y, edges, axis=0)[::2]
        else:
            for k in range(0, int(past[0]), per):
                y = _responses(net, laid[k * STRIDE : (min(k + per, int(past[0])) + WIDTH // STRIDE - 1) * STRIDE])
                best[0] = np.maximum(best[0], y.max(axis=0))
        hidden = np.maximum(best + net.shift, 0)
        out[low:high] = np.where(filled, 1 / (1 + np.exp(-(hidden @ net.weights + net.bias).astype(np.float64))), 0)
    return out


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network | None:
    """Fit the network by Adam on the logistic loss, in ``STEPS`` steps at least; None if one of the labels is missing."""
    labels = np.asarray(labels, np.float32)
    if not len(texts) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "filters": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        "shift": np.zeros(FILTERS, np.float32),
        "weights": rng.normal(0, 0.2, FILTERS).astype(np.float32),
        "bias": np.zeros(1, np.float32),
    }
    p["embed"][0] = 0
    share = labels.mean()
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    tick, epochs = 0, max(epochs, -(-STEPS // -(-len(texts) // BATCH)))
    for epoch in range(epochs):
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = rng.permutation(len(texts))
        for low in range(0, len(order), BATCH):
            own = order[low : low + BATCH]
            data = np.frombuffer(b"".join(texts[i] for i in own), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in own])])
            laid, begin, past = _blocks(data, offsets)
            net = Network(p["embed"], p["filters"], p["shift"], p["weights"], float(p["bias"][0]))
            y = _responses(net, laid)
            place = np.stack([b + y[b:e].argmax(axis=0) for b, e in zip(begin, past)])
            top = y[place, np.arange(FILTERS)]
            raw = top + p["shift"]
            hidden = np.maximum(raw, 0)
            prob = 1 / (1 + np.exp(-np.clip(hidden @ p["weights"] + p["bias"][0], -30, 30)))
            delta = ((prob - labels[own]) * weight[own] / len(own)).astype(np.float32)
            back = delta[:, None] * p["weights"][None, :] * (raw > 0)
            window = laid[(place * STRIDE)[:, :, None] + np.arange(WIDTH)]  # (docs, filters, WIDTH)
            seen = p["embed"][window].reshape(len(own), FILTERS, WIDTH * EMBED)
            g = {
                "weights": hidden.T @ delta + 1e-4 * p["weights"],
                "bias": delta.sum(keepdims=True),
                "shift": back.sum(axis=0),
                "filters": np.einsum("df,dfk->kf", back, seen) + 1e-4 * p["filters"],
                "embed": np.zeros_like(p["embed"]),
            }
            spread = back[:, :, None] * p["filters"].T[None, :, :]
            np.add.at(g["embed"], window.reshape(-1), spread.reshape(-1, EMBED))
            g["embed"][0] = 0  # padding
            tick += 1
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                p[k] = (p[k] - rate * (first[k] / (1 - 0.9**tick)) / (np.sqrt(second[k] / (1 - 0.99**tick)) + 1e-6)).astype(np.float32)
    return Network(p["embed"], p["filters"], p["shift"], p["weights"], float(p["bias"][0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES, epochs: int = EPOCHS) -> Network | None:
    """Network fitted on a sample of at most ``train_docs`` labelled documents of ``train_bytes`` in all, half of either label where there are enough."""
    known = labels.select(column(id_col).cast("bigint").alias("id"), column(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = [r for want in (0, 1) for r in known.where(F.col("label") == want).orderBy(*order).limit(train_docs // 2).collect()]
    if not chosen:
        return None
    sample = docs.sparkSession.createDataFrame([(r.id, r.label) for r in chosen], "id bigint, label int")
    text = docs.select(column(id_col).cast("bigint").alias("id"), column(text_col).cast("string").alias("text")).where("text is not null")
    # bounded by train_docs, whatever the table's size and however often a row occurs; texts stay with the executors until chosen
    scratch = Scratch()
    rows = scratch.keep(text.join(F.broadcast(sample), "id").groupBy("id").agg(F.min("label").alias("label"), F.min("text").alias("text")), "labelled")
    size = {r.id: r.n for r in rows.select("id", F.octet_length("text").alias("n")).collect()}
    left, taken = {0: train_bytes // 2, 1: train_bytes // 2}, []
    for r in chosen:
        if size.get(r.id, train_bytes + 1) <= left[r.label]:
            left[r.label] -= size[r.id]
            taken.append(r.id)
    got = rows.where(F.col("id").isin(taken)).collect()
    scratch.drop()
    got.sort(key=lambda r: (r.id, r.text))
    return train([r.text.encode() for r in got], np.array([r.label for r in got]), epochs)


def probability(net: Network | None) -> callable:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(probabilities(net, texts))

    scored = F.arrow_udf(run, "double").asNondeterministic()  # else a filter on it would evaluate it again

    def of(text: Column) -> Column:
        return scored(text)

    return of


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """(doc_id, probability, accepted) of every row."""
    bounded_batches(docs.sparkSession)
    out = docs.select(column(id_col).alias("doc_id"), probability(net)(column(text_col)).alias("probability"))
    return out.withColumn("accepted", F.col("probability") >= accept)


def accept(docs: DataFrame, net: Network | None, text_col: str = "text", least: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` whose probability is at least ``least``."""
    bounded_batches(docs.sparkSession)
    name = fresh(docs.columns, "quality_probability")
    return docs.withColumn(name, probability(net)(column(text_col))).where(F.col(name) >= least).drop(name)
