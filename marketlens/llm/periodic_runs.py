"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with smallest period q, at least
``max(shortest, repeats * q)`` words long, that no neighbouring word extends
keeping the period. ``mark_runs`` finds every run of every whole text:

1. Splitting. A word of a run occurs ``repeats`` times in it at least, so a
   word that occurs less often within the segment it stands in is in no run
   there. Such words split the segment; the parts are counted again on their
   own and split again, until no segment changes. All segments of a group of
   texts are counted at once, and settled ones leave the count.
2. Lag scan of the segments that are left. A run of period q is matched by
   words q apart over ``(repeats - 1) * q`` places in a row, so that many
   multiples of q in a row match. ``_hits`` looks at multiples only, for all
   lags together (L log L comparisons for L words). A hit is extended word by
   word to the whole stretch. Lags go up, and a stretch has a smaller period
   only if that divides q and the stretch is that run (it is four periods
   long), so such hits are dropped by the runs already found.

Texts go through Arrow in groups of about ``group_bytes``; a text is never
cut, so the memory of a task is that of its longest text or of one group.

Defined cases: null text has no words, no run and an empty collapsed text; an
empty text likewise; words are compared exactly (no case folding); runs that
overlap are all listed, ties in length do not matter; repeated rows each get
their row; an empty table gives no rows; the columns of the input stay, and
underscores are added to a result name that the input already has.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm._shared import free_name

WORD = "[^\\x20\\x09-\\x0D]+"
_word = re.compile(WORD)
RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def surviving(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray, repeats: int, shortest: int):
    """(begins, ends) of the segments in which every word occurs ``repeats`` times."""
    settled: list[tuple[np.ndarray, np.ndarray]] = []
    n_words = int(ids.max()) + 1 if len(ids) else 1
    while True:
        long = ends - begins >= shortest
        begins, ends = begins[long], ends[long]
        if not len(begins):
            break
        sizes = ends - begins
        segment = np.repeat(np.arange(len(begins)), sizes)
        at = np.arange(len(segment)) + np.repeat(begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        _, place, counts = np.unique(segment * n_words + ids[at], return_inverse=True, return_counts=True)
        rare = counts[place] < repeats
        split = np.bincount(segment, rare, len(begins)) > 0
        settled.append((begins[~split], ends[~split]))
        # What is left of the split segments: stretches without a rare word.
        kept = ~rare & split[segment]
        first = kept & ~(np.concatenate([[False], kept[:-1]]) & np.concatenate([[False], segment[1:] == segment[:-1]]))
        last = kept & ~(np.concatenate([kept[1:], [False]]) & np.concatenate([segment[1:] == segment[:-1], [False]]))
        begins, ends = at[first], at[last] + 1
    if not settled:
        return begins, ends
    begins, ends = (np.concatenate(x) for x in zip(*settled, strict=True))
    order = np.argsort(begins)
    return begins[order], ends[order]


def _hits(x: np.ndarray, repeats: int) -> Iterator[tuple[int, np.ndarray]]:
    """(lag, starts) by rising lag: multiples of the lag from which the words
    at ``repeats`` multiples in a row are equal."""
    n = len(x)
    most = n // repeats
    small = min(isqrt(n), most)
    for q in range(1, small + 1):  # few lags with many multiples
        y = x[::q]
        same = y[1:] == y[:-1]
        row = same[: len(same) - repeats + 2].copy()
        for i in range(1, repeats - 1):
            row &= same[i : len(same) - repeats + 2 + i]
        k = np.flatnonzero(row)
        if len(k):
            yield q, k * q
    # Many lags with few multiples: one comparison per multiple for all lags.
    lags, starts = [], []
    matched: list[np.ndarray] = []  # matched[i][q - small - 1]: words at multiples k+i and k+i+1 of q
    k = 0
    while (k + repeats - 1) * (small + 1) < n and small < most:
        while len(matched) < repeats - 1:
            m = k + len(matched)
            top = min(most, (n - 1) // (m + 1))
            left = x[m * (small + 1) : m * top + 1 : m] if m else np.full(top - small, x[0])
            matched.append(left == x[(m + 1) * (small + 1) : (m + 1) * top + 1 : m + 1])
        width = len(matched[-1])
        row = matched[0][:width].copy()
        for more in matched[1:]:
            row &= more[:width]
        q = np.flatnonzero(row) + small + 1
        if len(q):
            lags.append(q)
            starts.append(q * k)
        del matched[0]
        k += 1
    if lags:
        lag, start = np.concatenate(lags), np.concatenate(starts)
        order = np.lexsort((start, lag))
        lag, start = lag[order], start[order]
        cuts = np.flatnonzero(np.diff(lag)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(lag)], strict=True):
            yield int(lag[lo]), start[lo:hi]


def _stretch(x: np.ndarray, q: int, at: int) -> tuple[int, int]:
    """[begin, end) of the places around ``at`` whose word equals that q later."""
    last = len(x) - q
    end, step = at, 64
    while end < last:
        differs = np.flatnonzero(x[end : min(end + step, last)] != x[end + q : min(end + step, last) + q])
        if len(differs):
            end += int(differs[0])
            break
        end, step = min(end + step, last), step * 2
    begin, step = at, 64
    while begin > 0:
        low = max(begin - step, 0)
        differs = np.flatnonzero(x[low:begin] != x[low + q : begin + q])
        if len(differs):
            begin = low + int(differs[-1]) + 1
            break
        begin, step = low, step * 2
    return begin, end


def lag_scan(x: np.ndarray, repeats: int, shortest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the word numbers ``x``."""
    runs: list[tuple[int, int, int]] = []
    known: dict[int, list[tuple[int, int]]] = defaultdict(list)  # lag -> runs whose period divides it
    for q, starts in _hits(x, repeats):
        shorter = known.pop(q, ())
        for begin, end in shorter:
            starts = starts[(starts < begin) | (starts + (repeats - 1) * q >= end)]
        i = 0
        while i < len(starts):
            begin, end = _stretch(x, q, int(starts[i]))
            length = end - begin + q
            if length >= max(shortest, repeats * q) and (begin, begin + length) not in shorter:
                runs.append((begin, length, q))
                for multiple in range(2 * q, length // repeats + 1, q):
                    known[multiple].append((begin, begin + length))
            i = int(np.searchsorted(starts, max(end, int(starts[i]) + 1)))
    return runs


def _numbers(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, equal words equal, and the bounds of the texts."""
    seen: dict[str, int] = defaultdict()
    seen.default_factory = seen.__len__
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return np.fromiter(map(seen.__getitem__, chain.from_iterable(words)), np.int64, bounds[-1]), bounds


def runs_of_texts(texts: list[str | None], repeats: int = 4, shortest: int = 6):
    """Per text: its runs by start, then period, and the text without repeats."""
    words = [_word.findall(t) if t else [] for t in texts]
    ids, bounds = _numbers(words)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    begins, ends = surviving(ids, bounds[:-1], bounds[1:], repeats, shortest)
    owner = np.searchsorted(bounds, begins, "right") - 1
    for doc, begin, end in zip(owner.tolist(), begins.tolist(), ends.tolist(), strict=True):
        base = begin - int(bounds[doc])
        runs[doc] += [(base + s, n, q) for s, n, q in lag_scan(ids[begin:end], repeats, shortest)]
    out = []
    for own, found in zip(words, runs, strict=True):
        found.sort(key=lambda r: (r[0], r[2]))
        if found:
            depth = np.zeros(len(own) + 1, np.int64)
            for s, n, q in found:  # all but the first period of each run goes
                depth[s + q] += 1
                depth[s + n] -= 1
            own = [own[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
        out.append((found, " ".join(own)))
    return out


def mark_runs(
    docs: DataFrame,
    text_col: str = "text",
    repeats: int = 4,
    shortest: int = 6,
    group_bytes: int = 4 << 20,
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its runs (array of start, length, period in words, by start,
    then period) and its collapsed text (one space between words, without the
    words that a run holds after its first period), and the two columns' names."""
    if repeats < 4 or shortest < repeats:
        # Below four periods a stretch may have a smaller period that ends elsewhere.
        raise ValueError("repeats must be 4 at least, shortest no less than repeats")
    names = {"runs": free_name(docs, "runs"), "collapsed": free_name(docs, "collapsed")}
    schema = T.StructType(
        [*docs.schema.fields, T.StructField(names["runs"], T.ArrayType(RUN, False)), T.StructField(names["collapsed"], T.StringType())]
    )
    place = docs.columns.index(text_col)
    run_kind = pa.list_(pa.struct([pa.field(n, pa.int64(), False) for n in RUN.names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(pc.fill_null(pc.binary_length(batch.column(place)), 0), dtype=np.int64)
            group = np.cumsum(sizes) // group_bytes
            cuts = np.flatnonzero(np.diff(group)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                found = runs_of_texts(part.column(place).to_pylist(), repeats, shortest)
                listed = [[dict(zip(RUN.names, r, strict=True)) for r in runs] for runs, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(listed, run_kind), pa.array([c for _, c in found], pa.string())],
                    names=schema.names,
                )

    return docs.mapInArrow(run, schema), names


def strongest(runs: Column) -> Column:
    """The run of greatest exact length / period; ties: the first of the array."""
    none = F.lit(None).cast(RUN)
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))
