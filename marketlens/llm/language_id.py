"""Language identification: a bidirectional gated recurrent network over bytes.

Two GRUs read every segment of ``segment`` bytes of a text, one from each end.
At every byte their states give logits over the languages; the softmax
probabilities of all positions of a document are averaged (pooled) and the
largest is the prediction. Gates and candidate use the soft-sign x / (1 + |x|),
which needs no exponentials. The network is trained in numpy by
backpropagation through time (Adam) on a bounded sample: up to ``per_lang``
labelled documents of each language, chosen by a hash of their id,
and up to ``per_doc`` segments of each. Prediction runs over all whole texts in
Arrow batches, grouped by bytes, and looks at the text only.

Defined cases: a null text or one without a letter is ``und`` with score 0.0;
rows without a label are not trained on but predicted; without any label every
text is ``und``; ties go to the language first in alphabetical order; repeated
rows each get their row; an empty table gives no rows; columns other than those
named are kept as they are (``identify``) or ignored (``fit``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm._shared import free_name

UND = "und"


def segments(data: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes by place and segment, bytes in each segment, text of each segment)."""
    counts = np.array([-(-len(d) // size) for d in data])
    n = int(counts.sum())
    flat = np.zeros(n * size, np.uint8)
    lengths = np.full(n, size)
    at = 0
    for d, c in zip(data, counts, strict=True):
        if c:
            flat[at * size : at * size + len(d)] = np.frombuffer(d, np.uint8)
            lengths[at + c - 1] = len(d) - (c - 1) * size
            at += c
    return flat.reshape(n, size).T.copy(), lengths, np.repeat(np.arange(len(data)), counts)


@dataclass
class GRU:
    """Rows of ``inputs`` are what each byte adds to the three gates; ``hidden``
    is what the state adds; columns of all arrays are segments."""

    inputs: np.ndarray  # (3 * units, 256)
    hidden: np.ndarray  # (3 * units, units)
    out: np.ndarray  # (languages, units)

    def steps(self, seq: np.ndarray, inside: np.ndarray | None, order: range, keep: bool) -> Iterator[tuple]:
        units = self.hidden.shape[1]
        h = np.zeros((units, seq.shape[1]), np.float32)
        for t in order:
            a = np.take(self.inputs, seq[t], axis=1, mode="clip")
            u = self.hidden @ h
            a[: 2 * units] += u[: 2 * units]
            gates = _soft(a[: 2 * units])
            gates *= 0.5
            gates += 0.5
            z, r = gates[:units], gates[units:]
            c = u[2 * units :] * r
            c += a[2 * units :]
            c = _soft(c)
            new = h - c
            new *= z
            new += c
            if inside is not None:
                new *= inside[t]  # a state that has only seen padding is 0
            yield (t, new, (h, z, r, c, u[2 * units :])) if keep else (t, new, None)
            h = new


def _soft(x: np.ndarray) -> np.ndarray:
    d = np.abs(x)
    d += 1
    return np.divide(x, d, out=d)


@dataclass
class LanguageModel:
    languages: list[str]
    forward: GRU | None
    backward: GRU | None
    bias: np.ndarray
    segment: int

    def positions(self, seq: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probabilities (place, language, segment) of every byte."""
        size, n = seq.shape
        logits = np.empty((size, len(self.languages), n), np.float32)
        inside = np.arange(size)[:, None] < lengths if lengths.min() < size else None
        mask = None if inside is None else inside[:, None, :].astype(np.float32)
        for t, h, _ in self.forward.steps(seq, None, range(size), False):
            np.matmul(self.forward.out, h, out=logits[t])
        for t, h, _ in self.backward.steps(seq, mask, range(size - 1, -1, -1), False):
            logits[t] += self.backward.out @ h
        logits += self.bias[None, :, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        if mask is not None:
            logits *= mask
        return logits

    def predict(self, texts: list[str | None], group_bytes: int = 1 << 18) -> tuple[list[str], np.ndarray]:
        best, score = [UND] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return best, score
        rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        data = [texts[i].encode("utf-8", "surrogatepass") for i in rows]
        lo = 0
        while lo < len(data):
            hi, total = lo, 0
            while hi < len(data) and (hi == lo or total + len(data[hi]) <= group_bytes):
                total += len(data[hi])
                hi += 1
            seq, lengths, text = segments(data[lo:hi], self.segment)
            sums = np.zeros((hi - lo, len(self.languages)))
            for k in range(0, seq.shape[1], 4096):  # a very long text is read in parts
                own = slice(k, k + 4096)
                np.add.at(sums, text[own], self.positions(seq[:, own], lengths[own]).sum(axis=0, dtype=np.float64).T)
            p = sums / sums.sum(axis=1, keepdims=True)
            top = p.argmax(axis=1)
            for j, i in enumerate(rows[lo:hi]):
                best[i], score[i] = self.languages[top[j]], min(1.0, float(p[j, top[j]]))
            lo = hi
        return best, score


def _back(gru: GRU, seen: list, seq: np.ndarray, inside, deltas: np.ndarray):
    """Gradients of one GRU, given those of the logits at every place."""
    units = gru.hidden.shape[1]
    n = seq.shape[1]
    g_out, g_hidden = np.zeros_like(gru.out), np.zeros_like(gru.hidden)
    places, gates = [], []
    after = np.zeros((units, n), np.float32)
    for t, new, (h, z, r, c, uc) in reversed(seen):
        g_out += deltas[t] @ new.T
        dh = gru.out.T @ deltas[t] + after
        if inside is not None:
            dh *= inside[t]
        dc = dh * (1 - z) * (1 - np.abs(c)) ** 2
        dz = dh * (h - c) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        dr = dc * uc * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        du = np.concatenate([dz, dr, dc * r])
        g_hidden += du @ h.T
        after = dh * z + gru.hidden.T @ du
        places.append(seq[t])
        gates.append(np.concatenate([dz, dr, dc]))
    flat, grads = np.concatenate(places), np.concatenate(gates, axis=1)
    g_inputs = np.stack([np.bincount(flat, weights=g, minlength=256) for g in grads]).astype(np.float32)
    return g_inputs, g_hidden, g_out


def train(
    texts: list[str],
    langs: list[str],
    units: int = 8,
    segment: int = 128,
    train_segment: int = 64,
    per_doc: int = 6,
    epochs: int = 4,
    batch: int = 256,
    rate: float = 0.02,
    seed: int = 3,
) -> LanguageModel:
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    if not names:
        return LanguageModel([], None, None, np.zeros(0, np.float32), segment)
    data, target = [], []
    for t, lang in zip(texts, langs, strict=True):
        raw = (t or "").encode("utf-8", "surrogatepass")
        pieces = [raw[i : i + train_segment] for i in range(0, len(raw), train_segment)]
        for i in rng.permutation(len(pieces))[:per_doc]:
            data.append(pieces[i])
            target.append(names.index(lang))
    target = np.array(target, np.int64)

    def start() -> GRU:
        return GRU(
            rng.normal(0, 0.3, (3 * units, 256)).astype(np.float32),
            rng.normal(0, 0.4, (3 * units, units)).astype(np.float32),
            rng.normal(0, 0.3, (len(names), units)).astype(np.float32),
        )

    model = LanguageModel(names, start(), start(), np.zeros(len(names), np.float32), segment)
    if not data:
        return model
    share = np.bincount(target, minlength=len(names)) / len(target)
    weight = (1 / np.maximum(share, 1e-9) / len(names)).astype(np.float32)
    seq_all, len_all, _ = segments(data, train_segment)
    params = [model.forward.inputs, model.forward.hidden, model.forward.out]
    params += [model.backward.inputs, model.backward.hidden, model.backward.out, model.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    steps, step = epochs * -(-len(data) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            seq, inside = seq_all[:, own], np.arange(train_segment)[:, None, None] < len_all[own]
            inside = inside.astype(np.float32)
            fw = list(model.forward.steps(seq, inside, range(train_segment), True))
            bw = list(model.backward.steps(seq, inside, range(train_segment - 1, -1, -1), True))
            deltas = np.empty((train_segment, len(names), len(own)), np.float32)
            for t, h, _ in fw:
                deltas[t] = model.forward.out @ h + model.bias[:, None]
            for t, h, _ in bw:
                deltas[t] += model.backward.out @ h
            deltas -= deltas.max(axis=1, keepdims=True)
            np.exp(deltas, out=deltas)
            deltas /= deltas.sum(axis=1, keepdims=True)
            deltas[:, target[own], np.arange(len(own))] -= 1
            deltas *= inside * weight[target[own]] / inside.sum()
            grads = [*_back(model.forward, fw, seq, inside, deltas), *_back(model.backward, bw, seq, inside, deltas)]
            grads.append(deltas.sum(axis=(0, 2)))
            step += 1
            now = rate * (1 - step / (steps + 1))
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def fit(
    docs: DataFrame,
    usable: Column,
    per_lang: int = 500,
    max_langs: int = 200,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    **options,
) -> LanguageModel:
    """A model from a bounded sample: ``per_lang`` documents of each of the
    (at most ``max_langs``, the most frequent) languages for which ``usable``
    holds, chosen by a hash of the id. Only ids are ranked, not texts. Languages
    beyond ``max_langs`` are not learned: raise it where there are more."""
    known = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    langs = known.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(max_langs)
    # Of a language's hashes only the lowest share is ranked, some four times
    # the rows wanted, so a frequent language is no larger a group than a rare one.
    lowest = F.least(F.lit(1.0), (4.0 * per_lang + 64) / F.col("count"))
    by_hash = Window.partitionBy(lang_col).orderBy("h", id_col)
    chosen = (
        known.select(id_col, lang_col, F.xxhash64(id_col).alias("h"))
        .join(F.broadcast(langs.select(lang_col, lowest.alias("lowest"))), lang_col)
        .where(F.pmod("h", F.lit(1 << 30)) < F.col("lowest") * (1 << 30))
        .withColumn("k", F.row_number().over(by_hash))
        .where(F.col("k") <= per_lang)
        .select(id_col)
        .distinct()
    )
    rows = (
        known.select(id_col, F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
        .join(F.broadcast(chosen), id_col, "left_semi")
        .orderBy(id_col, "lang", "text")
        .limit(per_lang * max_langs)
        .collect()
    )
    return train([r.text for r in rows], [r.lang for r in rows], **options)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with two columns at the end, ``lang_pred`` and ``score`` (with
    underscores added where the input has such columns)."""
    names = [free_name(docs, name) for name in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = shared.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())],
                names=[*batch.schema.names, *names],
            )

    schema = T.StructType([*docs.schema.fields])
    return docs.mapInArrow(run, schema.add(names[0], T.StringType()).add(names[1], T.DoubleType()))
