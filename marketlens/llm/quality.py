"""Quality classifier: supervised subword embeddings, averaged and linear.

The features of a text are its white-space separated words, its pairs of
neighbouring words (all pairs of equal words are one feature) and the byte
n-grams (3 to 5) inside words, hashed into 2**bits rows of an embedding table. A document is the mean of the vectors of all its features; a softmax
over (bad, good) follows. Table and output layer are learned together by
stochastic gradient descent in numpy, on a bounded sample of labelled
documents (``sample``: the labels with the smallest hash of their id, whatever
the size of the corpus). Scoring runs over all whole texts: as the model is
linear after the table, each bucket carries one number (its share of the
log-odds) and a text's score needs one pass of array operations over its bytes.

Defined cases: null and empty texts have no feature and get the sigmoid of the
bias; labels that are null or for ids not in the table are not used; a document
labelled twice counts as bad if any label says so; without any usable label
(or with one class only) every score is the smoothed share of good labels;
repeated rows each get their row; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm._shared import _PLACES, mix64

GRAMS = (3, 4, 5)


def _hash_to(h: np.ndarray, bits: int) -> np.ndarray:
    return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int32)


def features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every feature of every text, in no special order."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    owner_ends = np.cumsum(sizes)
    space = (joined == 32) | ((joined >= 9) & (joined <= 13))
    after = np.cumsum(space, dtype=np.int32)  # equal at two places: no space between
    wide = joined.astype(np.uint64)
    prime = np.uint64(0x100000001B3)
    buckets, at = [], []
    for n in GRAMS:
        if len(joined) <= n:
            continue
        h = np.full(len(joined) - n, n, np.uint64)
        for i in range(n):
            h = h * prime + wide[i : i + len(h)]
        ok = np.flatnonzero(~space[: len(h)] & (after[n - 1 : n - 1 + len(h)] == after[: len(h)]))
        buckets.append(_hash_to(h[ok], bits))
        at.append(ok)
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if len(starts):
        # A word's hash: the sum of its bytes, each multiplied by its place.
        begin = np.zeros(len(joined), np.int64)
        begin[starts] = starts
        place = np.arange(len(joined)) - np.maximum.accumulate(begin)
        mixed = (wide + np.uint64(1)) * _PLACES[place & 4095]
        mixed[space] = 0
        word = mix64(np.add.reduceat(mixed, starts))
        buckets.append(_hash_to(word, bits))
        at.append(starts)
        text = np.searchsorted(owner_ends, starts, side="right")
        pairs = np.flatnonzero(text[1:] == text[:-1])
        pair = word[pairs] * prime + word[pairs + 1]
        pair[word[pairs] == word[pairs + 1]] = 1  # a word said twice, whichever it is
        buckets.append(_hash_to(mix64(pair), bits))
        at.append(starts[pairs])
    if not at:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    return np.concatenate(buckets), np.searchsorted(owner_ends, np.concatenate(at), side="right")


@dataclass
class QualityModel:
    log_odds: np.ndarray  # per bucket, float32
    bias: float
    bits: int

    def score(self, texts: list[str | None], group_bytes: int = 1 << 19) -> np.ndarray:
        """Probability of good, per text; whole texts, grouped by bytes."""
        data = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        out = np.empty(len(data))
        lo = 0
        while lo < len(data):
            hi, total = lo, 0
            while hi < len(data) and (hi == lo or total + len(data[hi]) <= group_bytes):
                total += len(data[hi])
                hi += 1
            bucket, owner = features(data[lo:hi], self.bits)
            n = np.bincount(owner, minlength=hi - lo)
            s = np.bincount(owner, weights=self.log_odds[bucket], minlength=hi - lo)
            out[lo:hi] = s / np.maximum(n, 1)
            lo = hi
        return 1 / (1 + np.exp(-(out + self.bias)))


def train(
    texts: list[str | None],
    labels: list[int],
    bits: int = 17,
    dim: int = 8,
    epochs: int = 5,
    rate: float = 0.5,
    boost: float = 50.0,
    seed: int = 7,
) -> QualityModel:
    """SGD, one document a step; the rate falls linearly to zero."""
    good = np.array(labels, np.int64)
    prior = float(np.log((good.sum() + 1) / (len(good) - good.sum() + 1)))
    if len(set(labels)) < 2:
        return QualityModel(np.zeros(1 << bits, np.float32), prior, bits)
    rng = np.random.default_rng(seed)
    rows = []
    for t in texts:
        b, _ = features([t.encode("utf-8", "surrogatepass") if t else b""], bits)
        u, c = np.unique(b, return_counts=True)
        rows.append((u, (c / max(len(b), 1)).astype(np.float32)))
    table = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out = np.zeros((dim, 2), np.float32)
    bias = np.array([-prior / 2, prior / 2], np.float32)
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            now = rate * (1 - step / steps)
            step += 1
            u, w = rows[i]
            hidden = w @ table[u]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[good[i]] -= 1
            back = out @ p
            out -= now * np.outer(hidden, p)
            bias -= now * 0.1 * p
            # The mean makes a document's gradient small per feature; the
            # features of a document are distinct, so this adds up nothing twice.
            table[u] -= (now * boost) * w[:, None] * back
    difference = out[:, 1] - out[:, 0]
    return QualityModel(table @ difference, float(bias[1] - bias[0]), bits)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    sample: int = 2000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> QualityModel:
    """A model from at most ``sample`` labelled documents for which ``usable``
    (an expression over the id column) holds."""
    chosen = (
        labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col(id_col).isNotNull() & usable)
        .groupBy(id_col)
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(sample)
    )
    # At most ``sample`` small rows: their size is bounded by the parameter. Of
    # the texts of a repeated id the one with the smallest hash counts.
    rows = (
        docs.select(F.col(id_col), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), id_col)
        .groupBy(id_col, "label")
        .agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
        .select(id_col, "label", F.col("least.text").alias("text"))
        .orderBy(id_col)
        .collect()
    )
    return train([r.text for r in rows], [r.label for r in rows])


def score(docs: DataFrame, model: QualityModel, out_col: str, text_col: str = "text") -> DataFrame:
    """``docs`` and ``out_col``, the probability that a document is good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits float32: 512 kB
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = shared.value.score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, out_col]
            )

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields]).add(out_col, T.DoubleType()))
