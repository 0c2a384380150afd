"""Positional numbering and zipping of tables.

``ROW_NUMBER() OVER ()`` over a whole table normally means one task sees
every row. ``number_rows`` gives each row its place in a total order without
that and without running anything: the number of a row is

    rows in earlier slices of the order + row number within its slice.

A slice holds the rows that agree on all sort keys but the last, and on the
first characters of the last one if that is text (cutting text at a fixed
length keeps its order). Slices are counted by a partial aggregation; running
counts over the slices of one first key, and over the first keys, give the
rows before a slice. Those windows see one row per slice and per first key,
never the rows, and the rows' own window sees one slice at a time: a tie of
a million names is spread over its prefixes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX = 2  # characters of a last text key that tell slices apart: few slices, each a small share of a tie


def _slice_columns(df: DataFrame, keys: Sequence[str]) -> list:
    """Expressions that ascend with the keys; equal ones make a slice."""
    *first, last = keys
    cols = [F.col(k) for k in first]
    if isinstance(df.schema[last].dataType, T.StringType):
        cols.append(F.substring(last, 1, PREFIX))
    return cols


def _ascending(names: Sequence[str]) -> list:
    return [F.col(n).asc_nulls_last() for n in names]


def _same(left: Sequence[str], right: Sequence[str]):
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)])


def number_rows(df: DataFrame, keys: Sequence[str], name: str = "rn") -> DataFrame:
    """``df`` with its rows numbered 1..n by ``keys`` (ascending, NULLs last).

    Rows that agree on all keys are numbered in any order. ``df`` is read
    twice; it should end in an aggregate, whose shuffle both readings share.
    """
    cols = _slice_columns(df, keys)
    if not cols:  # a single key that is no text: one slice per value
        cols = [F.col(keys[0])]
    names = [f"_s{i}" for i in range(len(cols))]
    sliced = df.select("*", *[c.alias(n) for c, n in zip(cols, names, strict=True)])
    sizes = sliced.groupBy(*names).agg(F.count(F.lit(1)).alias("_size"))
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # Slices before this one: under the same first key, and under earlier ones.
    top, rest = names[0], names[1:]
    heads = sizes.groupBy(F.col(top).alias("_top")).agg(F.sum("_size").alias("_n"))
    heads = heads.select("_top", F.coalesce(F.sum("_n").over(until(Window.orderBy(*_ascending(["_top"])))), F.lit(0)).alias("_heads"))
    if rest:
        inner = until(Window.partitionBy(top).orderBy(*_ascending(rest)))
        sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    else:
        sizes = sizes.withColumn("_before", F.lit(0).cast("long"))
    offsets = sizes.join(heads, _same([top], ["_top"])).select(
        *[F.col(n).alias(f"_o{n}") for n in names], (F.col("_heads") + F.col("_before")).alias("_offset")
    )
    within = F.row_number().over(Window.partitionBy(*names).orderBy(*_ascending(keys)))
    numbered = sliced.withColumn("_within", within).join(offsets, _same(names, [f"_o{n}" for n in names]))
    return numbered.select((F.col("_offset") + F.col("_within")).cast("long").alias(name), *df.columns)


def zip_by_position(
    parts: Sequence[tuple[DataFrame, Sequence[str]]], name: str = "rn"
) -> DataFrame:
    """Number each input in its order and inner-join them on the number.

    The result is as long as the shortest input. Column names other than
    ``name`` must be distinct across inputs.
    """
    numbered = [number_rows(df, keys, name) for df, keys in parts]
    out = numbered[0]
    for nxt in numbered[1:]:
        out = out.join(nxt, name, "inner")
    return out
