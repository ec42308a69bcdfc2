"""Operator 4: a convolutional network over bytes, trained and applied with numpy.

Filters of ``WIDTH`` bytes, learned from labels, slide over the whole text. The text is cut
into overlapping chunks; within each, every filter keeps its largest answer. The mean and
the maximum of these over all chunks are combined into one probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import drawn_by_hash, map_rows

WIDTH, FILTERS = 5, 10
#: A chunk in filter positions, and how many positions lie between the starts of two chunks.
CHUNK, HOP = 256, 128
#: Labelled rows that training reads at most, about, and bytes of all their texts; longer texts mean fewer rows, never parts of texts.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 64 << 20
EPOCHS, BATCH, RATE = 6, 48, 0.02
#: Steps that training takes at least: few texts are gone over more often.
STEPS = SAMPLE_ROWS // BATCH * EPOCHS


@dataclass
class ByteNet:
    """taps[k, b]: what byte b at place k of a window adds to each filter."""

    taps: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    @classmethod
    def fresh(cls, seed: int) -> ByteNet:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)

    def answers(self, data: np.ndarray) -> np.ndarray:
        """Filter answers (positions x filters) over a text of at least WIDTH bytes."""
        n = len(data) - WIDTH + 1
        total = self.taps[0][data[:n]]
        for k in range(1, WIDTH):
            total += self.taps[k][data[k : k + n]]
        return total

    def chunk_peaks(self, data: np.ndarray) -> np.ndarray:
        """Largest rectified answer of each filter in each chunk, in pieces of bounded size."""
        data = padded(data)
        last = len(data) - WIDTH + 1
        out = []
        for at in range(0, max(1, last - HOP), 64 * HOP):  # a rest of HOP positions is in the chunk before
            stop = min(last, at + 64 * HOP + CHUNK - HOP)
            halves = np.maximum.reduceat(self.answers(data[at : stop - 1 + WIDTH]), np.arange(0, stop - at, HOP))
            out.append(np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves)
        return np.maximum(np.concatenate(out) + self.bias, 0)

    def probability(self, text: str | None) -> float:
        """How likely a text is of label 1."""
        peaks = self.chunk_peaks(as_bytes(text))
        z = float(np.concatenate([peaks.mean(0), peaks.max(0)]) @ self.weights + self.offset)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def padded(data: np.ndarray) -> np.ndarray:
    """At least one window; the byte 0 stands for the end of a text."""
    return np.concatenate([data, np.zeros(WIDTH - len(data), np.uint8)]) if len(data) < WIDTH else data


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> ByteNet:
    """Trains by gradient descent (Adam); gradients flow through the window that answered most."""
    net, rng = ByteNet.fresh(seed), np.random.default_rng(seed)
    if not len(labels):
        return net
    params = [net.taps, net.bias, net.weights, np.zeros(1, np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    data = [padded(as_bytes(t)) for t in texts]
    rate = (labels.sum() + 1) / (len(labels) + 2)
    params[3][0] = np.log(rate / (1 - rate))
    batches = max(1, len(data) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // batches))
    for epoch in range(epochs):
        speed = RATE * 0.6 ** (epoch * EPOCHS / epochs)
        for batch in np.array_split(rng.permutation(len(data)), batches):
            grads = [np.zeros_like(p) for p in params]
            for d in batch:
                answers = net.answers(data[d])
                starts = np.arange(0, max(1, len(answers) - CHUNK + HOP), HOP)
                where = np.stack([s + answers[s : s + CHUNK].argmax(0) for s in starts])
                raw = np.take_along_axis(answers, where, 0) + net.bias
                peaks = np.maximum(raw, 0)
                top = peaks.argmax(0)
                x = np.concatenate([peaks.mean(0), peaks.max(0)])
                error = 1 / (1 + np.exp(-np.clip(x @ net.weights + params[3][0], -40, 40))) - labels[d]
                grads[2] += error * x
                grads[3] += error
                back = np.repeat((error * net.weights[:FILTERS] / len(starts))[None], len(starts), 0)
                back[top, np.arange(FILTERS)] += error * net.weights[FILTERS:]
                back *= raw > 0
                grads[1] += back.sum(0)
                for k in range(WIDTH):
                    np.add.at(grads[0][k], (data[d][where + k], np.arange(FILTERS)[None]), back)
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g /= len(batch)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)
    net.offset = float(params[3][0])
    return net


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> ByteNet:
    """Fits on about ``rows`` labelled documents, chosen by a hash of their id, where ``learn`` holds.

    The sample is the only thing the driver gets: whole texts, and fewer rows if these hold more than ``SAMPLE_BYTES``.
    """
    usable = labels.where(learn & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("__label"))
    n = usable.count()
    if not n:
        return ByteNet.fresh(7)
    part = rows / n

    def drawn() -> DataFrame:
        texts = docs.select(id_col, text_col).where(F.col(text_col).isNotNull() & drawn_by_hash(F.col(id_col), part)).join(usable.where(drawn_by_hash(F.col(id_col), part)), id_col)
        # of an id with several texts the least counts, so the sample is as bounded as the labels drawn
        return texts.groupBy(F.col(id_col).alias("i")).agg(F.min(text_col).alias("t"), F.max("__label").alias("y"))

    size = drawn().agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    if size > SAMPLE_BYTES:
        part = min(part, 1.0) * SAMPLE_BYTES / size
    sample = drawn().collect()
    sample.sort(key=lambda row: (row.i, row.t))
    return fit([row.t for row in sample], np.array([float(row.y) for row in sample]))


def score(docs: DataFrame, net: ByteNet, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) for every whole text.

    A null text counts as empty; an empty text gets the score of a window of end bytes. Repeated rows
    give one row each; only ``id_col`` and ``keep`` are carried along; an empty table gives an empty one.
    """
    names = list(dict.fromkeys([id_col, *(keep or [])]))
    at = names.index(text_col) if text_col in names else len(names)
    schema = ", ".join([*(f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in names), "score double, predicted int"])
    shared = docs.sparkSession.sparkContext.broadcast((net.taps, net.bias, net.weights, net.offset))

    def make():
        own = ByteNet(*shared.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = [own.probability(t) for t in batch.column(at).to_pylist()]
            columns = [batch.column(k) for k in range(len(names))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], [*names, "score", "predicted"])

        return each

    return map_rows(docs.select(*names, *([F.col(text_col).alias("__text")] if at == len(names) else [])), make, schema)
