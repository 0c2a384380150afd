"""Spelling variants: words one edit apart, found by dense prefix-suffix tiles.

``word_counts`` counts the words of all texts with SQL functions. ``near_words``
finds every pair of words that differ by exactly one inserted, deleted or
replaced code point:

* If b is the longer length, the common prefix and the common suffix of such a
  pair add up to b - 1 at least, so one of them has b // 2 code points or more.
  Every word is filed under its prefix and its suffix of that length, for b its
  own length and for b one more: four rows per word, and every near pair meets
  under one of its keys. A pair counts under its prefix key if it shares that,
  else under its suffix key: no pair is found twice.
* Rows are shuffled by key and sorted, and a task walks through its keys in
  tiles: the words of a tile are a matrix of code points, one row per word,
  padded to the longest; comparing two tiles column by column gives the common
  prefix of all pairs at once, comparing the right-aligned matrices the common
  suffix. Pairs without a common key are masked out; only near pairs leave.
* Keys with more than ``block`` words (counted before) are cut into blocks by a
  hash of the word, and every pair of blocks is a shuffle key of its own, so
  one frequent prefix is spread over tasks. Nothing is left out.

``variant_forms`` picks the form of each word and follows forms to the root by
pointer doubling: a form is ``ratio`` times as frequent as its word, so chains
are shorter than the logarithm of the largest count.

Defined cases: null and empty texts have no words; a null id is the empty id;
ties of counts go to the word that is smaller in code-point order; repeated
rows count each; an empty table gives no words; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm._shared import written

# The letters of a word, and the capitals that are lower-cased.
LETTERS = "[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(word: Column) -> Column:
    """A-Z lower-cased and nothing else (``lower`` would change À to à too)."""
    ascii_only = F.octet_length(word) == F.length(word)
    return F.when(ascii_only, F.lower(word)).otherwise(F.translate(word, CAPITALS, SMALL))


def runs_of_letters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run): every run of letters of every text, lower-cased."""
    found = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LETTERS), F.lit(0))).alias("run"),
    )
    return found.select("id", ascii_lower(F.col("run")).alias("run"))


def word_counts(words: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of words of ``shortest`` code points that occur ``least`` times."""
    return (
        words.where(F.length("word") >= shortest)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least)
    )


def _matrices(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points padded on the right, the same reversed, and the lengths."""
    sizes = np.array([len(w) for w in words], np.int32)
    width = int(sizes.max())
    ahead = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
    back = np.frombuffer(b"".join(w[::-1].ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
    return ahead, back, sizes


def _common(a: np.ndarray, b: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Length of the common beginning of the rows of ``a`` and ``b``, where ``pairs``."""
    running = pairs.copy()
    out = np.zeros(pairs.shape, np.int32)
    for c in range(min(a.shape[1], b.shape[1])):
        running &= a[:, c, None] == b[None, :, c]
        if not running.any():
            break
        out += running
    return out


def _near_in_tiles(words: list[bytes], group: np.ndarray, kind: np.ndarray, longer: np.ndarray, block: np.ndarray, tile: int):
    """(i, j) of the near pairs of rows that share a group.

    ``kind`` 0: a prefix key, 1: a suffix key; ``longer``: the longer length of
    a pair of the group; ``block``: 0 if the row is of the first block of its
    pair of blocks, 1 if of the second, 2 if the group is one block.
    """
    for lo in range(0, len(words), tile):
        a = slice(lo, lo + tile)
        ahead_a, back_a, sizes_a = _matrices(words[a])
        for low in range(lo, len(words), tile):
            b = slice(low, low + tile)
            if group[b][0] > group[a][-1]:  # groups ascend
                break
            ahead_b, back_b, sizes_b = _matrices(words[b])
            most, least = np.maximum(sizes_a[:, None], sizes_b), np.minimum(sizes_a[:, None], sizes_b)
            pairs = (group[a][:, None] == group[b]) & (most == longer[a][:, None]) & (most - least <= 1)
            pairs &= (block[a][:, None] != block[b]) | (block[a][:, None] == 2)
            if lo == low:
                pairs &= np.tri(len(sizes_a), len(sizes_b), -1, bool)
            if not pairs.any():
                continue
            ahead = np.minimum(_common(ahead_a, ahead_b, pairs), least)
            pairs &= (kind[a][:, None] == 0) | (ahead < most // 2)  # a shared prefix: found there
            back = np.minimum(_common(back_a, back_b, pairs), least)
            i, j = np.nonzero(pairs & (ahead + back >= most - 1))
            yield i + lo, j + low


NEAR = "word string, n long, near string, near_n long"


def _tile_task(tile: int):
    names = [f.split()[0] for f in NEAR.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole groups, in order

        def compared(rows: list[tuple]):
            group = np.cumsum([0] + [x[:5] != y[:5] for x, y in zip(rows, rows[1:], strict=False)])
            kind, longer, block = (np.array([r[k] for r in rows], np.int32) for k in (0, 1, 5))
            words = [r[6].encode("latin-1") for r in rows]
            for i, j in _near_in_tiles(words, group, kind, longer, block, tile):
                if len(i):
                    one, other = [rows[k] for k in i.tolist()], [rows[k] for k in j.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r[6] for r in one + other], pa.string()),
                            pa.array([r[7] for r in one + other], pa.int64()),
                            pa.array([r[6] for r in other + one], pa.string()),
                            pa.array([r[7] for r in other + one], pa.int64()),
                        ],
                        names=names,
                    )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:5] != held[-1][:5]:
                    # Long words get tiles of few rows: a matrix is as wide as its longest.
                    if len(held) >= 2 and held[-1][:5] != held[-2][:5]:
                        held.pop()  # a word alone under its key
                    if len(held) * max(1, row[1] // 64) >= tile:
                        yield from compared(held)
                        held = []
                held.append(row)
        if held:
            yield from compared(held)

    return run


def near_words(words: DataFrame, tile: int = 512, block: int = 4096, task_rows: int = 40_000) -> DataFrame:
    """(word, n, near, near_n): every near pair of ``words`` (word, n), both ways.

    ``words`` is read several times: give a written table. Code points up to 255.
    """
    size = F.length("word")
    keys = [
        F.struct(
            F.lit(kind).alias("kind"),
            longer.alias("longer"),
            (F.substring(F.col("word"), F.lit(1), half) if kind == 0 else F.right(F.col("word"), half)).alias("part"),
        )
        for longer in (size, size + 1)
        for half in (F.floor(longer / 2).cast("int"),)
        for kind in (0, 1)
    ]
    filed = words.select("word", "n", F.explode(F.array(*keys)).alias("k")).select("k.*", "word", "n")
    key = ["kind", "longer", "part"]
    large = (
        filed.groupBy(*key)
        .agg(F.count("*").alias("members"))
        .where(F.col("members") > block)
        .select(*key, F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    )
    mine = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    place = (
        filed.join(large, key, "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            *key,
            F.least("mine", "other").alias("first"),
            F.greatest("mine", "other").alias("second"),
            F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
            "word",
            "n",
        )
    )
    tasks = max(1, -(-4 * words.count() // task_rows))
    order = [*key, "first", "second"]
    dealt = place.repartition(tasks, *order).sortWithinPartitions("longer", *order, "word")
    return dealt.mapInArrow(_tile_task(tile), NEAR)


def variant_forms(words: DataFrame, ratio: int = 2, **limits) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n)."""
    words = written(words, "spelling-words")
    near = (
        near_words(words, **limits)
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    )
    best_n, chosen = -F.col("best.less"), -F.col("best.less") >= ratio * F.col("n")
    forms = written(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(chosen, F.col("best.near")).alias("form"),
            F.when(chosen, best_n).alias("form_n"),
        ),
        "spelling-forms",
    )
    # Pointer doubling; only words that have a form take part.
    links = forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = written(
            links.join(further, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "spelling-roots",
        )
        if links.where("moved").isEmpty():
            break
        links = links.select("word", "root")
    return forms.join(links.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
