"""Quality by a byte-level convolutional network.

Learned filters slide over a document's bytes. Their outputs are max-pooled in overlapping chunks that cover
the whole document, the chunks' maxima are averaged, and a logistic unit makes one probability of them.
The network is trained in numpy on the driver, from all chunks of at most TRAIN_ROWS whole labelled texts of at most
TRAIN_BYTES together, taken by a hash; a text that the rest has no room for is passed over, and shorter ones after it are
taken. Scores are computed in the tasks. Both read every byte.

An empty table gives an empty result. A null or empty text is one chunk of zero bytes and gets the probability of that. Repeated rows each get
their score. Without rows of both labels every score is the share of label 1 (1 without any label).
Columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cratewise.llm.common import labelled, texts

FILTERS = 8
WIDTH = 5
#: A chunk is two neighbouring hops, so each byte lies in two chunks.
HOP = 128
TRAIN_ROWS = 4_000
TRAIN_BYTES = 24 << 20
#: Gradient steps, however few rows there are.
STEPS = 600
RATE = 0.01
BATCH = 32
#: Texts that are decoded at once.
SLICE = 500
#: Bytes convolved at once.
BLOCK = 512 * HOP


@dataclass
class Network:
    """table[j, b]: what byte b adds to each filter at its place j."""

    table: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    constant: float

    def convolve(self, data: np.ndarray) -> np.ndarray:
        """(..., places, filters) for (..., bytes)."""
        n = data.shape[-1] - WIDTH + 1
        y = self.table[0][data[..., :n]]
        for j in range(1, WIDTH):
            y += self.table[j][data[..., j : j + n]]
        return y

    def probability(self, text: bytes) -> float:
        """Of one whole document."""
        hops = max(2, -(-len(text) // HOP))
        data = np.zeros(hops * HOP + WIDTH - 1, np.uint8)
        data[: len(text)] = np.frombuffer(text, np.uint8)
        tops = [self.convolve(data[a : min(a + BLOCK, hops * HOP) + WIDTH - 1]).reshape(-1, HOP, FILTERS).max(axis=1) for a in range(0, hops * HOP, BLOCK)]
        top = np.concatenate(tops)
        chunks = np.maximum(np.maximum(top[:-1], top[1:]) + self.bias, 0)
        return float(1 / (1 + np.exp(-np.clip(chunks.mean(axis=0) @ self.out + self.constant, -30, 30))))


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other, each in whole hops and a hop of zero bytes; the first hop of each chunk; and each text's number of chunks."""
    hops = np.array([max(2, -(-t.size // HOP)) for t in texts])
    at = np.concatenate(([0], np.cumsum(hops + 1)))
    flat = np.zeros(at[-1] * HOP + WIDTH - 1, np.uint8)
    for a, t in zip(at.tolist(), texts, strict=False):
        flat[a * HOP : a * HOP + t.size] = t
    return flat, np.concatenate([np.arange(a, a + h - 1) for a, h in zip(at.tolist(), hops.tolist(), strict=False)]), hops - 1


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Network:
    """Adam over the bytes of whole texts and 0/1 labels. Gradients reach only the bytes under each chunk's maximum."""
    draw = np.random.default_rng(seed)
    net = Network(draw.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), draw.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)
    values = [net.table, net.bias, net.out, np.zeros(1, np.float32)]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    batches = max(1, len(labels) // BATCH)
    filters = np.arange(FILTERS)
    for _ in range(-(-STEPS // batches)):
        for rows in np.array_split(draw.permutation(len(labels)), batches):
            flat, left, chunks = laid_out([texts[r] for r in rows])
            y = net.convolve(flat).reshape(-1, HOP, FILTERS)
            at = y.argmax(axis=1)
            top = np.take_along_axis(y, at[:, None, :], 1)[:, 0, :]
            hop = left[:, None] + (top[left + 1] > top[left])
            value = top[hop, filters] + net.bias
            doc = np.repeat(np.arange(chunks.size), chunks)
            pooled = np.add.reduceat(np.maximum(value, 0), np.cumsum(chunks) - chunks) / chunks[:, None]
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + values[3][0], -30, 30)))
            error = (p - labels[rows]) * weight[rows] / len(rows)
            back = ((error / chunks)[doc, None] * net.out * (value > 0)).astype(np.float32)
            grads = [np.zeros_like(net.table), back.sum(axis=0), pooled.T @ error, np.array([error.sum()])]
            place = hop * HOP + at[hop, filters]
            for j in range(WIDTH):
                np.add.at(grads[0][j], (flat[place + j], filters), back)
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                values[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.constant = float(values[3][0])
    return net


def fitting(sizes: list[Row]) -> list[Row]:
    """In order, each that the rest of TRAIN_BYTES has room for."""
    left, taken = TRAIN_BYTES, []
    for r in sizes:
        if r["n"] <= left:
            left -= r["n"]
            taken.append(r)
    return taken


def fit(docs: DataFrame, labels: DataFrame, training: Column) -> Network:
    """A network from at most TRAIN_ROWS labelled rows, and TRAIN_BYTES, of those that ``training`` (over doc_id) admits, by a hash of the id."""
    chosen = labelled(labels, "quality").where(training).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    sample = texts(docs).join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "text", "label")
    sizes = sample.select("h", F.octet_length("text").alias("n")).orderBy("h", "n").limit(TRAIN_ROWS).collect()
    chosen_sizes = fitting(sizes)
    # from Arrow, as a list of rows would go through Python workers of its own, which stay
    taken = sample.sparkSession.createDataFrame(pa.table({"h": pa.array([r["h"] for r in chosen_sizes], pa.int64()), "n": pa.array([r["n"] for r in chosen_sizes], pa.int32())}))
    keys = sample.withColumn("n", F.octet_length("text")).join(F.broadcast(taken.distinct()), ["h", "n"])
    rows = keys.orderBy("h", "text").limit(TRAIN_ROWS).collect()
    y = np.array([r["label"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if y.size else 1.0
        return Network(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), 30.0 if share == 1 else -30.0)
    return train([np.frombuffer(r["text"].encode(), np.uint8) for r in rows], y)


def score(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` with a column score (0 to 1, higher: likelier good); replaces one of that name."""
    return scored(docs.drop("score"), network, "score")


def keep(docs: DataFrame, network: Network, at: float) -> DataFrame:
    """The rows of ``docs`` that score ``at`` or more; all columns stay, whatever their names."""
    name = "score"
    while name in map(str.lower, docs.columns):
        name += "_"
    return scored(docs, network, name).where(F.col(name) >= at).drop(name)


def scored(kept: DataFrame, network: Network, name: str) -> DataFrame:
    """Only the texts go to the workers and only scores come back, so neither side holds whole rows twice; a worker takes SLICE texts of a batch at once."""
    held = kept.sparkSession.sparkContext.broadcast(network)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            own = np.empty(len(batch))
            for at in range(0, len(batch), SLICE):
                own[at : at + SLICE] = [held.value.probability((t or "").encode()) for t in batch.slice(at, SLICE).to_pylist()]
            yield pa.array(own, pa.float64())

    # marked so that no later filter or projection has texts scored twice
    return kept.select("*", run.asNondeterministic()("text").alias(name))
