"""Best-fit packing: hierarchical residual packing into sequences of tokens.

1. ``token_pieces``: every document becomes its token ids plus an end id.
   Documents longer than the capacity are cut into full pieces and one
   remainder, which is the *first* piece.
2. Each partition packs its own pieces best-fit (largest first), window by
   window, so memory is bounded. Bins filled to ``nearly_full`` or more are
   final. The result is written to the shared folder once, because later
   steps read it again and must see the same bins.
3. Underfull bins become items (their fill is their size) of the next round:
   they are dealt by a hash to ``fan_in`` times fewer tasks and packed best-fit
   again, until one task remains; each task gets ``round_items`` items or
   fewer. Only (bin, fill) pairs travel, never documents. When all items no
   longer fit into one task's share, rounds go on as long as they merge bins.
4. The bin of a piece is looked up in the composed moves (bin -> final bin and
   shift), a join on the bin number with one row per underfull bin.

Defined cases: null text is an empty text; an empty document is its end id
alone (length 1); repeated rows are packed as many times as they occur; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm._shared import written

# White space longer than this in one run is left to the tokenizer's own file:
# the pattern of the ranks looks ahead over the whole run on the stack.
_LONG_BLANK = 10_000
_blank = re.compile(rf"\s{{{_LONG_BLANK}}}")


@cache
def _tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@cache
def _ranks(name: str):
    """The byte-level vocabulary of ``name`` as merge ranks."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _special_strings(name: str) -> tuple[str, ...]:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f)["added_tokens"])


class TokenIds:
    """Ids of whole texts as little-endian uint32 bytes.

    The ids are those of the file ``tokenizer`` with added special tokens off.
    ``ranks`` names the same vocabulary as merge ranks, which give the same ids
    in a third of the time and keep no table of words; texts with one of the
    file's special strings, or with a very long run of white space, go to the
    file itself. Without ``ranks`` all texts do.
    """

    def __init__(self, tokenizer: str, ranks: str | None = None):
        self.tokenizer, self.ranks = tokenizer, ranks
        self.special = _special_strings(tokenizer)

    def _by_ranks(self, text: str) -> bool:
        if self.ranks is None or any(s in text for s in self.special):
            return False
        return len(text) < _LONG_BLANK or not _blank.search(text)

    def __call__(self, text: str) -> bytes:
        if self._by_ranks(text):
            ids = _ranks(self.ranks).encode_ordinary(text)
        else:
            ids = _tokenizer(self.tokenizer).encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin of item, offset of item, fill of bin).

    Ties go to the earlier item and, among equally full bins, to the older.
    """
    bins = np.empty(len(sizes), np.int64)
    offsets = np.empty(len(sizes), np.int64)
    fills: list[int] = []
    room: list[int] = []  # distinct residual sizes in use, ascending
    by_room: dict[int, list[int]] = {}
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        k = bisect_left(room, size)
        if k < len(room):
            left = room[k]
            at = by_room[left].pop()
            if not by_room[left]:
                del by_room[left], room[k]
        else:
            at, left = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = at, fills[at]
        fills[at] += size
        left -= size
        if left > 0:
            if left not in by_room:
                by_room[left] = []
                insort(room, left)
            by_room[left].append(at)
    return bins, offsets, np.array(fills, np.int64)


PIECE = "doc long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def _pack_partition(tokenizer: str, ranks: str | None, end_id: int, capacity: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = TokenIds(tokenizer, ranks)
        end = np.array([end_id], "<u4").tobytes()
        next_bin = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def packed():
            nonlocal next_bin
            if not rows:
                return
            cols = list(zip(*rows, strict=True))
            bins, offsets, fills = best_fit(np.array(cols[3], np.int64), capacity)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            arrays += [pa.array(bins + next_bin), pa.array(offsets), pa.array(fills[bins])]
            next_bin += len(fills)
            rows.clear()
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in PIECE.split(", ")])

        for batch in batches:
            texts = batch.column(1)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                got = ids(texts[i].as_py() or "") + end
                n, start = len(got) // 4, 0
                size = n % capacity or min(n, capacity)  # the first piece takes the remainder
                piece = 0
                while start < n:
                    rows.append((doc, piece, start, size, zlib.crc32(got[4 * start : 4 * (start + size)])))
                    start, piece, size = start + size, piece + 1, capacity
            if len(rows) >= window:
                yield from packed()
        yield from packed()

    return run


def _pack_round(capacity: int, round_no: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        ids, sizes = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(ids, kind="stable")
        ids, sizes = ids[order], sizes[order]
        bins, offsets, fills = best_fit(sizes, capacity)
        first = np.full(len(fills), np.iinfo(np.int64).max)
        np.minimum.at(first, bins, ids)  # a merged bin keeps the number of its smallest member
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(first[bins]), pa.array(offsets), pa.array(fills[bins])],
            names=["bin", "target", "shift", "fill"],
        )

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    ranks: str | None = "byte_bpe_50k.tiktoken",
    end_id: int = 0,
    capacity: int = 2048,
    nearly_full: float = 0.995,
    window: int = 50_000,
    fan_in: int = 8,
    round_items: int = 100_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    full = int(capacity * nearly_full)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    pieces = written(narrow.mapInArrow(_pack_partition(tokenizer, ranks, end_id, capacity, window), PIECE), "pieces")

    # One row per underfull bin: that of its piece at offset 0.
    open_bins = pieces.where((F.col("offset") == 0) & (F.col("fill") < full)).select("bin", "fill")
    n = open_bins.count()
    moves, tasks, round_no = None, -(-n // round_items) * fan_in, 0
    while n > 1:
        tasks = max(-(-n // round_items), tasks // fan_in, 1)
        dealt = open_bins.repartition(tasks, F.xxhash64(F.col("bin"), F.lit(round_no)))
        step = written(
            dealt.mapInArrow(_pack_round(capacity, round_no), "bin long, target long, shift long, fill long"), "round"
        )
        joined = step.select(F.col("bin").alias("target"), F.col("target").alias("to"), F.col("shift").alias("by"))
        if moves is None:
            moves = step.select("bin", "target", "shift")
        else:
            moves = written(
                moves.join(joined, "target", "left").select(
                    "bin",
                    F.coalesce("to", "target").alias("target"),
                    (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift"),
                ),
                "moves",
            )
        open_bins = step.where((F.col("bin") == F.col("target")) & (F.col("fill") < full)).select("bin", "fill")
        left, round_no = open_bins.count(), round_no + 1
        if tasks == 1 or left == n:
            break
        n = left

    out = pieces.select("doc", "piece", "start", "length", "ids_crc32", "bin", "offset")
    if moves is None:
        out = out.select("*", F.col("bin").alias("target"), F.lit(0).cast("long").alias("shift"))
    else:
        out = out.join(moves, "bin", "left")
    return out.select(
        F.col("doc").alias(id_col),
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("target", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
