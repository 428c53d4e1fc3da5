"""Quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  Learned byte vectors go through
learned filters; the largest response of each filter in a chunk describes the chunk; the mean and the
largest of the chunks' values describe the text and give one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from counterpoise.llm.labelled import calibrate, remainder, training_sample

CHUNK = 512
OVERLAP = 64
WIDTH = 8
STRIDE = 4
DEPTH = 4               # numbers per byte
FILTERS = 16
CUTOFF = 0.3
_BATCH = 512            # chunks at once


def chunks_of(text: str | None) -> np.ndarray:
    """Rows of CHUNK bytes that cover the text, OVERLAP bytes shared by neighbours, zeros behind the end."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    step = CHUNK - OVERLAP
    count = max(1, -(-(len(data) - OVERLAP) // step))
    padded = np.zeros((count - 1) * step + CHUNK, dtype=np.uint8)
    padded[:len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def _windows(bytes_: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(chunks, positions, WIDTH * DEPTH) inputs of the filters."""
    deep = vectors[bytes_]
    view = np.lib.stride_tricks.sliding_window_view(deep, WIDTH, axis=1)[:, ::STRIDE]       # c, p, DEPTH, WIDTH
    return view.transpose(0, 1, 3, 2).reshape(len(bytes_), view.shape[1], WIDTH * DEPTH)


class Network:
    def __init__(self, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.vectors = draw.normal(0, 0.5, (256, DEPTH)).astype(np.float32)
        self.filters = draw.normal(0, (WIDTH * DEPTH) ** -0.5, (WIDTH * DEPTH, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = draw.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)
        self.curve = (1.0, 0.0)

    def weights(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.bias, self.out, self.offset]

    def pooled(self, bytes_: np.ndarray) -> np.ndarray:
        """(chunks, FILTERS): each filter's largest response, at least 0."""
        out = np.empty((len(bytes_), FILTERS), np.float32)
        for at in range(0, len(bytes_), _BATCH):
            x = _windows(bytes_[at:at + _BATCH], self.vectors)
            y = x.reshape(-1, x.shape[2]) @ self.filters
            out[at:at + _BATCH] = np.maximum(0, y.reshape(x.shape[0], x.shape[1], FILTERS).max(axis=1) + self.bias)
        return out

    def described(self, texts: list[str | None]) -> np.ndarray:
        """(texts, 2 * FILTERS): mean and largest of each text's chunks, in bounded pieces."""
        mean, most = np.zeros((len(texts), FILTERS)), np.zeros((len(texts), FILTERS), np.float32)
        held, owner, size = [], [], 0
        counts = np.zeros(len(texts))

        def flush():
            nonlocal held, owner, size
            if held:
                values, own = self.pooled(np.concatenate(held)), np.concatenate(owner)
                np.add.at(mean, own, values)
                np.maximum.at(most, own, values)
            held, owner, size = [], [], 0

        for i, text in enumerate(texts):
            parts = chunks_of(text)
            counts[i] = len(parts)
            for at in range(0, len(parts), _BATCH):
                held.append(parts[at:at + _BATCH])
                owner.append(np.full(len(held[-1]), i))
                size += len(held[-1])
                if size >= _BATCH:
                    flush()
        flush()
        return np.column_stack([mean / counts[:, None], most])

    def margins(self, texts: list[str | None]) -> np.ndarray:
        return self.described(texts) @ self.out + self.offset[0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * self.margins(texts) + self.curve[1], -30, 30)))

    def gradients(self, texts: list[str], label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        parts = [chunks_of(t) for t in texts]
        counts = np.array([len(p) for p in parts])
        owner = np.repeat(np.arange(len(texts)), counts)
        starts = np.cumsum(counts) - counts
        bytes_ = np.concatenate(parts)
        x = _windows(bytes_, self.vectors)
        y = x.reshape(-1, x.shape[2]) @ self.filters
        y = y.reshape(x.shape[0], x.shape[1], FILTERS)
        where = y.argmax(axis=1)                                           # chunks, FILTERS
        top = np.take_along_axis(y, where[:, None, :], axis=1)[:, 0] + self.bias
        value = np.maximum(0, top)
        mean = np.add.reduceat(value, starts, axis=0) / counts[:, None]
        most = np.maximum.reduceat(value, starts, axis=0)
        text_features = np.column_stack([mean, most])
        p = 1 / (1 + np.exp(-np.clip(text_features @ self.out + self.offset[0], -30, 30)))
        error = weight * (p - label) / weight.sum()
        d_mean, d_most = error[:, None] * self.out[:FILTERS], error[:, None] * self.out[FILTERS:]
        is_most = value == most[owner]
        ties = np.add.reduceat(is_most.astype(np.float64), starts, axis=0)
        d_value = d_mean[owner] / counts[owner, None] + d_most[owner] * is_most / ties[owner]
        d_top = d_value * (top > 0)
        rows = np.arange(len(bytes_))
        g_filters = np.zeros_like(self.filters)
        g_vectors = np.zeros((256, DEPTH))
        for f in range(FILTERS):
            inputs = x[rows, where[:, f]]
            g_filters[:, f] = inputs.T @ d_top[:, f]
            back = (d_top[:, f, None] * self.filters[None, :, f]).reshape(-1, WIDTH, DEPTH)
            at = where[:, f, None] * STRIDE + np.arange(WIDTH)
            seen = bytes_[rows[:, None], at]
            for d in range(DEPTH):
                g_vectors[:, d] += np.bincount(seen.ravel(), back[:, :, d].ravel(), 256)
        return [g_vectors, g_filters, d_top.sum(axis=0), text_features.T @ error, np.array([error.sum()])]


def fit(texts: list[str], label: np.ndarray, share: float, epochs: int = 8, batch: int = 64, rate: float = 0.01,
        seed: int = 1) -> Network:
    """Trained by Adam on the sample, either label weighing the same; without both labels every text gets
    ``share`` as its score."""
    net, draw = Network(seed), np.random.default_rng(seed)
    rest = min(max(share, 1e-6), 1 - 1e-6)
    if label.sum() in (0, len(label)):
        net.curve = (0.0, float(np.log(rest / (1 - rest))))
        return net
    weight = np.where(label == 1, 0.5 / label.sum(), 0.5 / (1 - label).sum())
    first = [np.zeros(w.shape) for w in net.weights()]
    second = [np.zeros(w.shape) for w in net.weights()]
    step = 0
    for epoch in range(epochs):
        order = draw.permutation(len(texts))
        for at in range(0, len(order), batch):
            rows = order[at:at + batch]
            step += 1
            grads = net.gradients([texts[i] for i in rows], label[rows], weight[rows])
            now = rate * (1 - epoch / epochs)
            for w, g, m, v in zip(net.weights(), grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= (now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    net.curve = calibrate(net.margins(texts), label, share)
    return net


def learned(docs: DataFrame, labels: DataFrame) -> Network:
    """The network from labels of documents whose crc32(doc_id) mod 5 is not 0."""
    sample, share = training_sample(docs, labels, "quality", remainder("doc_id", 5) != 0)
    return fit(sample["text"].tolist(), sample["label"].to_numpy(), share)


def score_of(net: Network, text="text"):
    """The score of whole texts as a column; null counts as empty, and an empty text is one chunk of zeros."""

    @pandas_udf("double")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.tolist()
            yield pd.Series(np.concatenate([net.scores(texts[i:i + 256]) for i in range(0, len(texts), 256)]
                                           or [np.zeros(0)]))

    return told(text)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document whether it is held out of learning (a null doc_id is not), its score, and the prediction."""
    net = learned(docs, labels)
    return docs.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
                       score_of(net).alias("score")).withColumn(
        "predicted", (F.col("score") >= CUTOFF).cast("int"))
