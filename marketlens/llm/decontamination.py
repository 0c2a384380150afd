"""Benchmark decontamination: SimHash of item-sized windows, multi-index
Hamming search, exact weighted-shingle similarity.

Texts are word sequences (lower-cased). A shingle is a run of ``ngram`` words;
its weight is the number of the bytes of its words.

* Every benchmark item belongs to the class of the largest window length L of a
  fixed ladder (factor 1.5) with L + stride(L) - 1 <= its clean run: the words
  in a row that must be unchanged in a passage that reaches the threshold, from
  the weights of the item's own lightest shingles.
  All its windows of L words get a 64-bit SimHash of their weighted shingles.
* Every document is cut into windows of each class's length at the class's
  stride, over the whole text, so an occurrence of an item always holds a
  window that is aligned with one of the item's. SimHashes of all windows come
  from running sums of the weighted bits.
* Multi-index: fingerprints are split into 4 blocks of 16 bits. Two
  fingerprints within ``radius`` bits have a block within radius // 4 bits, so
  a table of every block value within that distance finds *all* item windows
  within the radius. Nothing is sampled and no bucket is capped.
* A candidate says where the item would begin; words inserted or deleted move
  that by as many words as the threshold allows, so all these places count.
  The item and the words there are compared exactly: weight of common shingles
  over weight of all shingles (multisets), a hit at ``threshold`` or more.

The benchmark is shipped to the tasks in parts of about ``part_words`` words
(dealt by a hash and counted first). A benchmark of one part is looked up in
one pass that adds a column. Of several parts one is in memory at a time: a
pass per part writes the hits of the texts that have some, by a digest of the
text, and ends before the next index is made; the documents then meet these
few rows in a join. Documents are passed once per part, and only their texts.

Defined cases: null or empty texts have no hits; items with fewer than
``ngram`` words (null and empty ones included) identify nothing and are
ignored; equal items each report their id; repeated documents are each
marked; an empty benchmark marks nothing; empty tables give no rows; all
columns of the documents are kept, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm._shared import free_name, shingle_hashes, word_table, written

BLOCKS, BLOCK_BITS = 4, 16
HIT = pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("similarity", pa.float64())])
HITS_TYPE = T.ArrayType(
    T.StructType()
    .add("item_id", T.LongType())
    .add("start", T.IntegerType())
    .add("stop", T.IntegerType())
    .add("similarity", T.DoubleType())
)


def _stride(length: int) -> int:
    return max(1, length // 6)


def clean_run(sizes: np.ndarray, ngram: int, threshold: float) -> int:
    """Words in a row that an occurrence of an item with words of these sizes has
    unchanged: the longest run that no changes within the threshold can break.

    Similarity is at least t if the lost weight and t times the new weight are
    within 1 - t of the item's weight. A change inside the item takes all
    shingles across it, and those across it on the other side are new; a word
    lost besides takes the lightest shingle at least."""
    weights = _weights(sizes, ngram)
    budget, lightest = (1 - threshold) * int(weights.sum()) + 1e-6, int(weights.min())
    n, beside = len(sizes), np.arange(ngram - 1, 0, -1)
    most, least = 0, 0.0
    if n >= 2 * ngram - 1:
        # The words before and after a place; the nearest one counts most.
        left = np.convolve(sizes, beside, "valid")
        right = np.convolve(sizes, beside[::-1], "valid")
        total = np.concatenate([[0], np.cumsum(sizes)])
        least = np.inf
        for removed in range(ngram + 1):
            at = np.arange(ngram - 1, n - ngram + 2 - removed)
            if len(at):
                cost = (1 + threshold) * (left[at - ngram + 1] + right[at + removed])
                least = min(least, float((cost + ngram * (total[at + removed] - total[at])).min()))
        most = int(budget / least)
    return min((n - c - int((budget - c * least) / lightest)) // (c + 1) for c in range(most + 1))


def most_shift(weights: np.ndarray, threshold: float) -> int:
    """Words by which insertions or deletions can move a part of an item within
    the threshold: a move by s words takes s shingles at least."""
    return int(np.searchsorted(np.cumsum(np.sort(weights)), (1 - threshold) * int(weights.sum()) + 1e-6, "right"))


def window_length(sizes: np.ndarray, ngram: int, threshold: float = 0.8) -> int:
    """The class of an item with words of these sizes: its clean run up to 11
    (at every place of a text), then the ladder."""
    if len(sizes) < ngram:
        return 0
    n = clean_run(sizes, ngram, threshold)
    if n <= 12:
        return max(min(n, 11), ngram)
    best, length = 12, 12
    while length + _stride(length) - 1 <= n:
        best, length = length, length * 3 // 2
    return best


def _votes(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Running sums (64, n + 1), per bit: +weight of a shingle that has it set,
    -weight of one that has not."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((64, len(shingles) + 1), np.int32)
    np.multiply(bits.T, 2 * weights, out=out[:, 1:], casting="unsafe")
    out[:, 1:] -= weights
    np.cumsum(out, axis=1, out=out)
    return out


def _fingerprints(votes: np.ndarray, span: int, step: int) -> np.ndarray:
    """SimHash of every ``span`` shingles from every ``step``-th place: a bit is
    set if more than half of the weight has it set."""
    majority = votes[:, span::step] > votes[:, : votes.shape[1] - span : step]
    out = np.zeros(majority.shape[1], np.uint64)
    for byte in range(8):
        part = np.zeros(majority.shape[1], np.uint8)
        for bit in range(8):
            part |= majority[8 * byte + bit].view(np.uint8) << np.uint8(bit)
        out |= part.astype(np.uint64) << np.uint64(8 * byte)
    return out


def _weights(sizes: np.ndarray, n: int) -> np.ndarray:
    """Bytes of the words of every run of n words."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    return (total[n:] - total[:-n]).astype(np.int32)


class MultiIndex:
    """All stored fingerprints within a Hamming radius of given ones."""

    def __init__(self, fingerprints: np.ndarray, radius: int):
        self.fingerprints, self.radius = fingerprints, radius
        spread = [np.uint32(0)]  # all changes of up to radius // BLOCKS bits
        for _ in range(radius // BLOCKS):
            spread = list({a ^ np.uint32(1 << b) for a in spread for b in range(BLOCK_BITS)} | set(spread))
        spread = np.array(spread, np.uint32)
        self.tables = []
        for k in range(BLOCKS):
            near = (self._block(fingerprints, k)[:, None] ^ spread[None, :]).ravel()
            order = np.argsort(near, kind="stable")
            bounds = np.searchsorted(near[order], np.arange((1 << BLOCK_BITS) + 1)).astype(np.int32)
            self.tables.append((bounds, (order // len(spread)).astype(np.int32)))

    @staticmethod
    def _block(fingerprints: np.ndarray, k: int) -> np.ndarray:
        return ((fingerprints >> np.uint64(BLOCK_BITS * k)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint32)

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of query, row of fingerprint), some pairs more than once."""
        qs, fs = [], []
        for k, (bounds, stored) in enumerate(self.tables):
            block = self._block(queries, k)
            lo, count = bounds[block], bounds[block + 1] - bounds[block]
            q = np.repeat(np.arange(len(queries)), count)
            if not len(q):
                continue
            inner = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
            f = stored[lo[q] + inner]
            ok = np.bitwise_count(self.fingerprints[f] ^ queries[q]) <= self.radius
            qs.append(q[ok])
            fs.append(f[ok])
        return (np.concatenate(qs), np.concatenate(fs)) if qs else (np.empty(0, int), np.empty(0, int))


def _bag(shingles: np.ndarray, weights: np.ndarray) -> Counter:
    out: Counter = Counter()
    for s, w in zip(shingles.tolist(), weights.tolist(), strict=True):
        out[s] += w
    return out


def similarity(a: Counter, b: Counter) -> float:
    """Weight of the common shingles over the weight of all, as multisets."""
    common = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


def best_place(
    bag: Counter, shingles: np.ndarray, weights: np.ndarray, ngram: int, size: int, begins: range, first: int, end: int
) -> tuple[float, int]:
    """(similarity, begin) of the ``size`` words most similar to the item of
    ``bag`` that begin in ``begins``, cut to the text from ``first`` to ``end``."""
    have: Counter = Counter()
    of_item, here, common = sum(bag.values()), 0, 0
    left = right = max(first, begins[0])
    best = (-1.0, 0)
    for begin in begins:
        lo, hi = max(first, begin), min(begin + size, end)
        while right < hi - ngram + 1:
            s, w = int(shingles[right]), int(weights[right])
            common += min(bag[s], have[s] + w) - min(bag[s], have[s])
            have[s] += w
            here, right = here + w, right + 1
        while left < min(lo, right):
            s, w = int(shingles[left]), int(weights[left])
            common -= min(bag[s], have[s]) - min(bag[s], have[s] - w)
            have[s] -= w
            here, left = here - w, left + 1
        best = max(best, (common / (of_item + here - common), -begin))
    return best[0], -best[1]


class ItemIndex:
    """The classes, fingerprints and shingles of one part of the benchmark."""

    def __init__(self, items: list[tuple[int | None, str | None]], ngram: int, radius: int, threshold: float = 0.8):
        self.ngram, self.items, classes = ngram, [], {}
        table = word_table([text for _, text in items])
        for i, (item_id, _) in enumerate(items):
            own = slice(table.starts[i], table.starts[i + 1])
            n = own.stop - own.start
            length = window_length(table.sizes[own], ngram, threshold)
            if not length:
                continue
            shingles, weights = shingle_hashes(table.hashes[own], ngram), _weights(table.sizes[own], ngram)
            prints = _fingerprints(_votes(shingles, weights), length - ngram + 1, 1)
            classes.setdefault(length, []).append((len(self.items), prints))
            self.items.append((item_id, n, _bag(shingles, weights), most_shift(weights, threshold)))
        self.classes = {}
        for length, parts in classes.items():
            of = np.concatenate([np.full(len(p), i) for i, p in parts])
            offset = np.concatenate([np.arange(len(p)) for _, p in parts])
            self.classes[length] = (MultiIndex(np.concatenate([p for _, p in parts]), radius), of, offset)

    def hits(self, texts: list[str | None], threshold: float) -> list[list[dict]]:
        """Per text its hits: item, start and stop (words), similarity."""
        out: list[list[dict]] = [[] for _ in texts]
        n = self.ngram
        table = word_table(texts)
        if not self.classes or len(table.hashes) < n:
            return out
        # Shingles and windows over all texts in a row; those that cross from
        # one text into the next are left out below.
        shingles, weights = shingle_hashes(table.hashes, n), _weights(table.sizes, n)
        votes = _votes(shingles, weights)
        text_of = np.repeat(np.arange(len(texts)), np.diff(table.starts))
        for length, (index, of, offset) in self.classes.items():
            step = _stride(length)
            if len(text_of) < length:
                continue
            starts = np.arange(0, len(text_of) - length + 1, step)
            inside = text_of[starts] == text_of[starts + length - 1]
            prints = _fingerprints(votes, length - n + 1, step)
            starts, prints = starts[inside], prints[inside]
            q, f = index.search(prints)
            seen = set()
            for p, item, o in zip(starts[q].tolist(), of[f].tolist(), offset[f].tolist(), strict=True):
                text, begin = int(text_of[p]), p - o
                if (text, item, begin) in seen:
                    continue
                seen.add((text, item, begin))
                item_id, size, bag, shift = self.items[item]
                first, end = int(table.starts[text]), int(table.starts[text + 1])
                lo, hi = max(first, begin), min(begin + size, end)
                here = slice(lo, max(lo, hi - n + 1))
                value = similarity(bag, _bag(shingles[here], weights[here]))
                # Moved by up to ``shift`` words it has no more than these shingles besides.
                both = int(weights[here].sum()) + sum(bag.values())
                before, after = slice(max(first, begin - shift), lo), slice(here.stop, max(here.stop, min(hi + shift, end) - n + 1))
                most = value / (1 + value) * both + max(int(weights[before].sum()), int(weights[after].sum()))
                if value < 1 and most >= threshold * sum(bag.values()) - 1e-6:
                    places = range(max(begin - shift, first - size + n), min(begin + shift, end - n) + 1)
                    moved, at = best_place(bag, shingles, weights, n, size, places, first, end) if len(places) else (0.0, 0)
                    if moved > value:
                        value, lo, hi = moved, max(first, at), min(at + size, end)
                if value >= threshold:
                    out[text].append(
                        {"item_id": item_id, "start": lo - first, "stop": hi - first, "similarity": value}
                    )
        return [_best(h) for h in out]


def _best(hits: list[dict]) -> list[dict]:
    """Of overlapping hits of one item the most similar (ties: the first)."""
    kept: list[dict] = []
    for h in sorted(hits, key=lambda h: (-h["similarity"], h["start"])):
        if not any(h["item_id"] == k["item_id"] and h["start"] < k["stop"] and k["start"] < h["stop"] for k in kept):
            kept.append(h)
    return sorted(kept, key=lambda h: (h["start"], h["item_id"] is None, h["item_id"] or 0))


def _mark(index, threshold: float, text_at: int, out_col: str, group_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at)
            sizes = np.array(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // group_bytes)) + 1
            hits = []
            for lo, hi in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
                hits += index.value.hits(texts[lo:hi].to_pylist(), threshold)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(hits, pa.list_(HIT))], names=[*batch.schema.names, out_col]
            )

    return run


def mark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    out_col: str,
    ngram: int = 5,
    threshold: float = 0.8,
    radius: int = 11,
    part_words: int = 100_000,
    group_bytes: int = 1 << 18,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``docs`` and the column ``out_col``: an array of (item_id, start, stop,
    similarity) of the benchmark items found in the text, in word positions."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text"))
    total = items.agg(F.sum(F.regexp_count("text", F.lit(r"\w+")))).first()[0] or 0
    parts = max(1, -(-total // part_words))

    def part_index(part: int):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)  # about part_words words
        return spark.sparkContext.broadcast(ItemIndex([(r.id, r.text) for r in own.collect()], ngram, radius, threshold))

    def marked(rows: DataFrame, part: int, name: str):
        index = part_index(part)
        schema = T.StructType([*rows.schema.fields]).add(name, HITS_TYPE)
        return rows.mapInArrow(_mark(index, threshold, rows.columns.index(text_col), name, group_bytes), schema), index

    if parts == 1:
        return marked(docs, 0, out_col)[0]
    found: DataFrame | None = None
    for part in range(parts):
        rows, index = marked(docs.select(text_col), part, "hits_")
        own = rows.where(F.size("hits_") > 0).select(F.md5(F.col(text_col).cast("binary")).alias("digest_"), "hits_")
        own = written(own.dropDuplicates(["digest_"]), "hits")  # equal texts have equal hits
        index.destroy()
        found = own if found is None else found.union(own)
    # A text has few hits; texts without any have no row here.
    by_text = written(found.groupBy("digest_").agg(F.flatten(F.collect_list("hits_")).alias("hits_")), "hits-by-text")
    digest, hits = free_name(docs, "digest_"), free_name(docs, "hits_")
    by_text = by_text.select(F.col("digest_").alias(digest), F.col("hits_").alias(hits))
    keyed = docs.withColumn(digest, F.md5(F.col(text_col).cast("binary")))
    order = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("at"), F.coalesce(h["item_id"], F.lit(0)), h.alias("hit"))))
    listed = F.coalesce(F.transform(order, lambda o: o["hit"]), F.array().cast(HITS_TYPE))
    return keyed.join(by_text, digest, "left").select(*docs.columns, listed.alias(out_col))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a benchmark passage, all columns as they were."""
    name = free_name(docs, "hits")
    return mark_hits(docs, benchmark, name, **options).where(F.size(name) == 0).drop(name)
