"""Quality as a probability: a byte-level convolutional network in numpy over overlapping chunks of the whole text.

Learned filters run over the bytes; each chunk pools their activations (largest and mean), a hidden layer reads the
pooled values, its units are max-pooled over all chunks of the text, and these give one probability. Chunks overlap by
half, so each half chunk is pooled once and shared by two chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder, labelled_sample, python_batches, table

#: Labelled rows, and bytes of all their texts, that the fit reads at most; the driver holds them.
MOST_LABELLED, MOST_BYTES = 4000, 24 << 20
WIDTH, FILTERS, HIDDEN = 5, 16, 16
#: Bytes from one chunk to the next, half a chunk.
HOP = 128
#: Bytes that a task convolves at once.
BLOCK = HOP * 1024
EPOCHS, BATCH, RATE, DECAY = 6, 32, 0.01, 1e-4
#: A small sample is read again until there have been so many batches.
LEAST_STEPS = 500
KEEP = 0.3
MOD, HELD_OUT = 5, 0
SEED = 17


@dataclass
class Net:
    """filters[j, byte, f]: what byte `byte` at place j of a window adds to filter f."""

    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def fresh(seed: int = SEED) -> Net:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    zeros = lambda n: np.zeros(n, np.float32)
    return Net(draw(WIDTH, 256, FILTERS, scale=0.3), zeros(FILTERS), draw(2 * FILTERS, HIDDEN, scale=0.25), zeros(HIDDEN), draw(HIDDEN, scale=0.3), zeros(1))


def as_bytes(text: str | None) -> np.ndarray:
    """The text's UTF-8, filled with zero bytes to whole half chunks, one at least."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return np.frombuffer(raw.ljust(max(1, -(-len(raw) // HOP)) * HOP, b"\0"), np.uint8)


def activations(net: Net, data: np.ndarray) -> np.ndarray:
    """Of each filter at each byte; data has WIDTH - 1 bytes more than there are places."""
    n = len(data) - WIDTH + 1
    z = np.take(net.filters[0], data[:n], axis=0)
    for j in range(1, WIDTH):
        z += np.take(net.filters[j], data[j : j + n], axis=0)
    z += net.bias
    return np.maximum(z, 0, out=z)


def halves(net: Net, data: np.ndarray) -> np.ndarray:
    """(half chunks, 2 * FILTERS): largest and mean activation, block by block."""
    padded, parts = np.concatenate([data, np.zeros(WIDTH - 1, np.uint8)]), []
    for i in range(0, len(data), BLOCK):
        a = activations(net, padded[i : min(i + BLOCK, len(data)) + WIDTH - 1]).reshape(-1, HOP, FILTERS)
        parts.append(np.concatenate([a.max(1), a.mean(1)], 1))
    return np.concatenate(parts)


def chunks(h: np.ndarray) -> np.ndarray:
    """Half chunks joined to overlapping chunks; a text of one half chunk is one chunk."""
    if len(h) == 1:
        return h
    return np.concatenate([np.maximum(h[:-1, :FILTERS], h[1:, :FILTERS]), (h[:-1, FILTERS:] + h[1:, FILTERS:]) / 2], 1)


def squash(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def probability(net: Net, text: str | None) -> float:
    hidden = np.maximum(chunks(halves(net, as_bytes(text))) @ net.hidden + net.hidden_bias, 0)
    return squash(hidden.max(0) @ net.out + net.out_bias[0])


def gradients(net: Net, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of the weighted cross entropy of texts (as_bytes), summed, by the chain rule through the poolings; and the probabilities.

    Pools are found block by block; activations are made anew for the few half chunks that a pool has chosen.
    """
    padded = [np.concatenate([t, np.zeros(WIDTH - 1, np.uint8)]) for t in texts]
    h = np.concatenate([halves(net, t) for t in texts])
    ends = np.cumsum([len(t) // HOP for t in texts])
    spans = [(e - len(t) // HOP, e) for e, t in zip(ends.tolist(), texts, strict=True)]
    left = np.concatenate([np.arange(b, max(e - 1, b + 1)) for b, e in spans])
    right = np.concatenate([np.minimum(np.arange(b, max(e - 1, b + 1)) + 1, e - 1) for b, e in spans])
    c = np.concatenate([np.maximum(h[left, :FILTERS], h[right, :FILTERS]), (h[left, FILTERS:] + h[right, FILTERS:]) / 2], 1)
    hidden = np.maximum(c @ net.hidden + net.hidden_bias, 0)
    ends = np.cumsum([max(e - b - 1, 1) for b, e in spans]).tolist()
    top = np.stack([b + hidden[b:e].argmax(0) for b, e in zip([0, *ends[:-1]], ends, strict=True)])
    best = hidden[top, np.arange(HIDDEN)]
    p = 1 / (1 + np.exp(-np.clip(best @ net.out + net.out_bias[0], -30, 30)))
    d = ((p - y) * weight).astype(np.float32)
    d_best = d[:, None] * net.out * (best > 0)
    d_c, d_h = np.zeros_like(c), np.zeros_like(h)
    np.add.at(d_c, top.ravel(), (d_best[:, :, None] * net.hidden.T).reshape(-1, 2 * FILTERS))
    # A chunk's largest value came from the half that had it; its mean from both.
    won = h[left, :FILTERS] >= h[right, :FILTERS]
    d_h[left, :FILTERS] += d_c[:, :FILTERS] * won
    d_h[right, :FILTERS] += d_c[:, :FILTERS] * ~won
    d_h[left, FILTERS:] += d_c[:, FILTERS:] / 2
    d_h[right, FILTERS:] += d_c[:, FILTERS:] / 2
    d_filters, d_bias = np.zeros_like(net.filters), np.zeros_like(net.bias)
    used = np.flatnonzero(np.abs(d_h).sum(1))
    for i in range(0, len(used), BLOCK // HOP):
        part = used[i : i + BLOCK // HOP]
        taps = _taps(padded, spans, part)
        a = np.take(net.filters[0], taps[0], axis=0)
        for j in range(1, WIDTH):
            a += np.take(net.filters[j], taps[j], axis=0)
        a = np.maximum(a + net.bias, 0).reshape(-1, HOP, FILTERS)
        at = a.argmax(1)[:, None, :]
        d_a = np.repeat(d_h[part, None, FILTERS:] / HOP, HOP, 1)
        np.put_along_axis(d_a, at, np.take_along_axis(d_a, at, 1) + d_h[part, None, :FILTERS], 1)
        d_a = np.ascontiguousarray((d_a * (a > 0)).reshape(-1, FILTERS).T)
        d_bias += d_a.sum(1)
        for j in range(WIDTH):
            for f in range(FILTERS):
                d_filters[j, :, f] += np.bincount(taps[j], d_a[f], 256).astype(np.float32)
    d_hidden = np.einsum("bhf,bh->fh", c[top], d_best)
    return [d_filters, d_bias, d_hidden, d_best.sum(0), d @ best, np.array([d.sum()], np.float32)], p


def _taps(padded: list[np.ndarray], spans: list[tuple[int, int]], wanted: np.ndarray) -> list[np.ndarray]:
    """For each place j of a window, the bytes that the windows of the wanted half chunks (numbered through all texts) have there."""
    bounds, parts = np.searchsorted(wanted, [b for b, _ in spans] + [spans[-1][1]]), []
    for (b, _), text, lo, hi in zip(spans, padded, bounds, bounds[1:], strict=False):
        if lo < hi:
            parts.append(text[((wanted[lo:hi] - b)[:, None] * HOP + np.arange(HOP + WIDTH - 1))])
    every = np.concatenate(parts)
    return [every[:, j : j + HOP].ravel() for j in range(WIDTH)]


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Net:
    """Adam on shuffled batches with a falling rate; the rarer label weighs more, so that both count alike."""
    net, rng, step = fresh(seed), np.random.default_rng(seed), 0
    data, share = [as_bytes(t) for t in texts], float(np.clip(labels.mean(), 0.01, 0.99))
    weights = np.where(labels > 0.5, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    first, second = ([np.zeros_like(p) for p in net.params()] for _ in range(2))
    each = -(-len(texts) // BATCH)
    epochs = max(epochs, -(-LEAST_STEPS // each))
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            batch, step = order[i : i + BATCH], step + 1
            total, _ = gradients(net, [data[k] for k in batch], labels[batch], weights[batch])
            rate = RATE * (1 - step / (epochs * each + 1))
            for p, g, m, v in zip(net.params(), total, first, second, strict=True):
                g = g / len(batch) + DECAY * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def learn(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, most_bytes: int = MOST_BYTES) -> Net:
    """Fit on at most most_labelled labelled rows and most_bytes bytes of whole texts outside the held-out fold.

    Without any such row the network answers one half for every text.
    """
    rows = labelled_sample(docs, labels, "quality", MOD, HELD_OUT, most_labelled, most_bytes).toPandas().sort_values(["id", "text"])
    rows = rows.drop_duplicates("text")
    net = fresh() if rows.empty else train(rows["text"].tolist(), rows["y"].to_numpy(np.float32))
    if rows.empty:
        net.out[:] = 0
    return net


def score(docs: DataFrame, net: Net, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1); no row goes and no shuffle happens.

    Null texts count as empty, texts of any length are read whole in blocks, equal texts get equal scores, an empty table
    gives none; a column score is replaced, all others pass through whatever their names.
    """
    python_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([probability(net, t) for t in texts], dtype="float64")

    return docs.withColumn("score", scored(F.col(text_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document's quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = learn(docs, table(spark, sf_dir, "labels"))
    held = (id_remainder(F.col("doc_id"), MOD) == HELD_OUT).alias("held_out")
    return score(docs, net).select("doc_id", held, "score", F.when(F.col("score") >= KEEP, 1).otherwise(0).alias("predicted"))
