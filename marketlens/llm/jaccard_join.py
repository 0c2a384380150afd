"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

``choose_bands`` picks the numbers of bands and rows for a target recall at
the threshold. ``jaccard_join`` then works in these steps:

1. One pass over the texts: the set of word n-grams (64-bit hashes) and its
   MinHash bands. Texts with equal sets form a *class*, named by a 64-bit
   digest of the set; one row per class goes on, so a group of copies, however
   large, costs one row per task (combined before the shuffle).
2. Shuffle on (band, band hash). A bucket links its classes to its smallest
   class: a star, never all pairs. Connected components of the stars are
   *cells*: classes that collide in no band chain are in different cells, so
   every colliding pair lies in one cell.
3. Each class in a cell sends one text into its cell, as its full set. Cells above
   ``cell_shingles`` set elements are dealt into blocks by a hash, and every
   pair of blocks becomes one task's group, so a giant cell is split evenly.
   Within a group the pairs that collide in at least one band are verified
   exactly; per class the group returns the number of classes and documents
   linked, and a spanning forest of the links. Pairs are never emitted, and
   none is left out.
4. Connected components of the forests give the class ids.

Result: one row per document: id, ``class_id`` (smallest id linked to it,
directly or through others; its own if none) and ``n_links`` (other documents
whose set has a similarity of ``threshold`` or more with its own, copies
included).

Defined cases: texts without a word (null, empty, punctuation) have an empty
set and take no part: class_id is their own id, n_links 0; texts shorter than
n words have one n-gram, all their words; repeated rows are copies of one
another, also under one id (they add to n_links); a null id gets class_id
null unless linked to a row with an id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm._components import components
from marketlens.llm._shared import mix64, shingle_hashes, word_table, written


def choose_bands(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows, hence the fewest chance collisions, whose
    bands find a pair at the threshold with probability ``recall`` or more and
    need at most ``max_hashes`` hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= max_hashes:
            best = (max(bands, 1), rows)
    if best is None:
        raise ValueError("max_hashes is too small for this threshold and recall")
    return best


def min_hashes(sets: list[np.ndarray], k: int, seed: int = 1) -> np.ndarray:
    """k MinHashes (32 bits) of non-empty sets of 64-bit hashes, one row per set."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(sets), k), np.uint32)
    lo = 0
    while lo < len(sets):  # about a quarter million set elements at a time
        hi, total = lo, 0
        while hi < len(sets) and (hi == lo or total + len(sets[hi]) <= 1 << 18):
            total += len(sets[hi])
            hi += 1
        flat = np.concatenate(sets[lo:hi])
        starts = np.cumsum([0, *(len(s) for s in sets[lo : hi - 1])])
        for j in range(k):
            out[lo:hi, j] = np.minimum.reduceat(((flat * mul[j]) >> np.uint64(32)).astype(np.uint32), starts)
        lo = hi
    return out


def band_hashes(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band; bands have different hashes for equal minima."""
    out = np.empty((len(minima), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(minima), b + 1, np.uint64)
        for r in range(rows):
            h = mix64(h * np.uint64(0x100000001B3) + minima[:, b * rows + r])
        out[:, b] = h
    return out.view(np.int64)


def _digest(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(ngram: int, bands: int, rows: int, with_grams: bool):
    """(key columns, text) -> (key columns, cls, n_grams, bands[, grams])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                table = word_table(texts)
                sets = [np.unique(shingle_hashes(table.of(i), ngram)) for i in range(len(texts))]
                kept = [s for s in sets if len(s)]
                bh = iter(band_hashes(min_hashes(kept, bands * rows), bands, rows) if kept else ())
                arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
                arrays += [
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([next(bh) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ]
                names = batch.schema.names[:-1] + ["cls", "n_grams", "bands"]
                if with_grams:
                    arrays.append(pa.array([s.tobytes() for s in sets], pa.binary()))
                    names.append("grams")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def verified_links(
    grams: list[np.ndarray], bands: np.ndarray, threshold: float, first: int | None = None
) -> Iterator[tuple[int, np.ndarray]]:
    """(i, later rows j) that share a band hash with i and whose sets have a
    Jaccard of ``threshold`` or more. With ``first``, only pairs of a row
    before ``first`` and one from it on. Memory is linear in the input."""
    n = len(grams)
    if n < 2:
        return
    sizes = np.array([len(g) for g in grams])
    ids = np.unique(np.concatenate(grams), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(ids), bool)
    by = np.argsort(bands, axis=0, kind="stable")
    place = np.empty_like(by)
    np.put_along_axis(place, by, np.arange(n)[:, None].repeat(bands.shape[1], 1), axis=0)
    ends = np.empty_like(by)  # end of the bucket of each place
    for b in range(bands.shape[1]):
        cuts = np.concatenate([np.flatnonzero(np.diff(bands[by[:, b], b])) + 1, [n]])
        ends[:, b] = cuts[np.searchsorted(cuts, np.arange(n), side="right")]
    met = np.zeros(n, bool)
    for i in range(n if first is None else first):
        for b in range(bands.shape[1]):
            at = place[i, b]
            if ends[at, b] > at + 1:
                met[by[at + 1 : ends[at, b], b]] = True  # stable: later places are later rows
        js = np.flatnonzero(met)
        met[js] = False
        if first is not None:
            js = js[js >= first]
        small, large = np.minimum(sizes[js], sizes[i]), np.maximum(sizes[js], sizes[i])
        js = js[small >= threshold * large - 1e-9]
        if not len(js):
            continue
        own = ids[starts[i] : starts[i + 1]]
        mark[own] = True
        spans = np.concatenate([ids[starts[j] : starts[j + 1]] for j in js])
        common = np.add.reduceat(mark[spans].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[js])[:-1]]))
        mark[own] = False
        hits = js[common >= threshold * (sizes[js] + sizes[i] - common) - 1e-9]
        if len(hits):
            yield i, hits


def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("cls", "ascending")])
        cls, docs = table.column("cls").to_numpy(), table.column("docs").to_numpy()
        grams = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        first = None if bi == bj else int(np.searchsorted(table.column("block").to_numpy(), bi, side="right"))
        root = list(range(len(cls)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        linked = np.zeros(len(cls), np.int64)
        near: dict[int, list[int]] = {}  # a spanning forest of the links
        for i, hits in verified_links(grams, bands, threshold, first):
            linked[i] += docs[hits].sum()
            linked[hits] += docs[i]
            for j in hits.tolist():
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    near.setdefault(j, []).append(int(cls[i]))
        keep = np.flatnonzero(linked)
        return pa.table(
            {
                "cls": pa.array(cls[keep]),
                "links": pa.array(linked[keep]),
                "near": pa.array([near.get(int(k), []) for k in keep], pa.list_(pa.int64())),
            }
        )

    return run


def text_groups(
    docs: DataFrame,
    ngram: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9999,
    max_hashes: int = 128,
    cell_shingles: int = 200_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, key, group, class_id, n_links) of every document; see the module.

    ``key`` is the xxhash64 of its text, ``group`` tells the groups of linked
    texts apart whatever the ids are (null: a text without a word), and
    ``class_id`` is the smallest id of the group.
    """
    bands, rows = choose_bands(threshold, recall, max_hashes)
    narrow = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(F.col(text_col)).alias("key"),
        F.col(text_col).alias("text"),
    )
    sketched = written(
        narrow.mapInArrow(
            _sketch(ngram, bands, rows, False), "id long, key long, cls long, n_grams long, bands array<long>"
        ),
        "sketches",
    )
    classes = written(
        sketched.where("cls is not null")
        .groupBy("cls")
        .agg(
            F.count("*").alias("docs"),
            F.min("id").alias("least"),
            F.min("key").alias("key"),
            F.max("n_grams").alias("n_grams"),
            F.first("bands").alias("bands"),  # equal within a class
        ),
        "classes",
    )

    banded = classes.select("cls", F.posexplode("bands").alias("band", "h"))
    buckets = banded.groupBy("band", "h").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi")
    stars = banded.join(buckets, ["band", "h"]).select(F.col("cls").alias("a"), F.col("lo").alias("b"))
    cells = components(stars).select(F.col("node").alias("cls"), F.col("component").alias("cell"))
    placed = written(classes.join(cells, "cls").select("cls", "cell", "docs", "key", "n_grams"), "cells")
    blocks = placed.groupBy("cell").agg(F.ceil(F.sum("n_grams") / cell_shingles).cast("int").alias("n_blocks"))

    # One text per class in a cell; equal texts are combined before the shuffle.
    texts = narrow.where("text is not null").groupBy("key").agg(F.first("text").alias("text"))
    full = (
        texts.join(placed.join(blocks, "cell"), "key")
        .select("cell", "docs", "n_blocks", "text")
        .mapInArrow(
            _sketch(ngram, bands, rows, True),
            "cell long, docs long, n_blocks int, cls long, n_grams long, bands array<long>, grams binary",
        )
    )
    paired = (
        full.withColumn("block", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("n_blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .withColumn("bi", F.least("block", "other"))
        .withColumn("bj", F.greatest("block", "other"))
        .select("cell", "bi", "bj", "block", "cls", "docs", "bands", "grams")
    )
    found = written(
        paired.groupBy("cell", "bi", "bj").applyInArrow(_verify(threshold), "cls long, links long, near array<long>"),
        "links",
    )
    forest = found.select(F.col("cls").alias("a"), F.explode("near").alias("b"))
    grouped = components(forest).select(F.col("node").alias("cls"), F.col("component").alias("comp"))
    linked = found.groupBy("cls").agg(F.sum("links").alias("others"))
    by_class = (
        classes.select("cls", "docs", "least")
        .join(grouped, "cls", "left")
        .join(linked, "cls", "left")
        .select(
            "cls",
            "least",
            F.coalesce("comp", "cls").alias("comp"),
            (F.col("docs") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        )
    )
    named = by_class.groupBy("comp").agg(F.min("least").alias("class_id"))
    by_class = by_class.join(named, "comp").select("cls", "comp", "class_id", "n_links")
    return (
        sketched.select("id", "key", "cls")
        .join(by_class, "cls", "left")
        .select(
            "id",
            "key",
            F.col("comp").alias("group"),
            F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        )
    )


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """(id, class_id, n_links) of every document; ``settings`` as in ``text_groups``."""
    groups = text_groups(docs, id_col=id_col, **settings)
    return groups.select(F.col("id").alias(id_col), "class_id", "n_links")


def representatives(groups: DataFrame) -> DataFrame:
    """(id, key) of one document per group of ``text_groups``: the smallest id
    (none last), then the smallest key; and of every document in no group."""
    order = F.struct(F.col("id").isNull(), "id", "key")
    one = groups.where(F.col("group").isNotNull()).groupBy("group").agg(F.min_by(F.struct("id", "key"), order).alias("r"))
    return one.select("r.id", "r.key").union(groups.where(F.col("group").isNull()).select("id", "key").distinct())
