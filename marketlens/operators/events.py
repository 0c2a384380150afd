"""Per-entity event operators: first event, next row, gaps between consecutive events."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import days_between
from marketlens.sources.sinks import materialize


def first_event(df: DataFrame, entity: str, date: str, name: str | None = None) -> DataFrame:
    """Earliest ``date`` per ``entity`` (NULL entity is one group).

    An aggregate, not a per-entity sort: it combines map-side, so a hot
    entity costs one row per task.
    """
    return df.groupBy(entity).agg(F.min(date).alias(name or date))


def successor_gap_parts(
    df: DataFrame, entity: str, date: str, weight: str | None = None
) -> DataFrame:
    """Sum and count of ``|next_date - date - 1|`` over each entity's sorted dates.

    For every entity, sort its event dates (repeats kept) and pair each
    event with the next one; ``tau = |next - date - 1|`` is attributed to the
    earlier event's date. Returns one row per (entity, date) with
    ``tau_sum`` and ``tau_n``; summing those by any function of ``date``
    gives exact averages of tau.

    Instead of a window over every event (one task per entity, a hot entity
    in one sort), events are first counted per (entity, date) -- combined
    map-side -- so the window sees at most one row per distinct date of an
    entity, a bound set by the calendar, not by the data volume.
    A date repeated m times yields m-1 pairs with gap 0 (tau 1 each); the
    last repeat pairs with the next distinct date (tau = gap - 1 >= 0).
    NULL dates pair with nothing. ``weight`` (default 1 per row) says how
    many events a row stands for.
    """
    events = F.count(F.lit(1)) if weight is None else F.sum(weight)
    # NULL dates go after counting, by a condition on the count: a condition on
    # the date alone would be pushed into the source of ``df``, which report
    # parts share only as long as it is the same for all of them.
    per_day = (
        df.groupBy(entity, date)
        .agg(events.alias("_m"))
        .filter(F.when(F.col(date).isNotNull(), F.col("_m")) > 0)
    )
    nxt = F.lead(F.col(date)).over(Window.partitionBy(entity).orderBy(date))
    per_day = per_day.withColumn("_next", nxt)
    repeats = F.col("_m") - 1
    gap_tau = days_between("_next", date) - 1
    return per_day.select(
        entity,
        date,
        (repeats + F.coalesce(gap_tau, F.lit(0))).alias("tau_sum"),
        (repeats + F.when(F.col("_next").isNotNull(), 1).otherwise(0)).alias("tau_n"),
    )


def successor(
    df: DataFrame,
    entity: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str] | None = None,
    name: str = "next",
    slices: int | None = None,
) -> DataFrame:
    """``df`` with the next row of the same entity as struct ``name`` (LEAD per row).

    Rows of an entity (NULL is one entity) follow each other by ``order``
    (ascending, NULLs first); rows that tie there follow each other in any
    order. ``columns`` says what the struct holds (default: all columns); it
    is NULL on the last row of an entity.

    A window partitioned by the entity would sort a hot entity in one task.
    Here the rows are cut into slices of about the same size along (entity,
    order), wherever an entity begins or ends: a range partitioning, written
    once to the shared folder because its borders are sampled. Inside a slice
    the window runs over the rows of an entity in that slice. Only the last row
    of a slice misses its successor: that is the first row of the following
    slice, which is carried back through a table of one row per slice.
    """
    spark = df.sparkSession
    columns = list(columns or df.columns)
    keys = [*entity, *order]
    # The row's place in the input parts equal keys, so that many rows of one
    # entity and moment can be cut too.
    tagged = df.withColumn("_tie", F.monotonically_increasing_id())
    parts = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = (
        tagged.repartitionByRange(parts, *[F.col(c) for c in (*keys, "_tie")])
        .withColumn("_slice", F.spark_partition_id())
    )
    placed, _ = materialize(spark, cut, "successor")
    place = F.struct(*keys, "_tie")
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    here = F.struct(*[F.col(c).alias(f"e{i}") for i, c in enumerate(entity)])
    firsts = placed.groupBy("_slice").agg(F.min_by(F.struct(row.alias("r"), here.alias("e")), place).alias("_first"))
    carried = firsts.select("_slice", F.lead("_first").over(Window.orderBy("_slice")).alias("_following"))
    in_slice = Window.partitionBy("_slice", *entity).orderBy(*order, "_tie")
    led = placed.withColumn("_led", F.lead(row).over(in_slice)).join(carried, "_slice")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_following.e.e{i}")) for i, c in enumerate(entity)])
    found = F.coalesce(F.col("_led"), F.when(same, F.col("_following.r")))
    named = F.struct(*[found[f"c{i}"].alias(c) for i, c in enumerate(columns)])
    return led.select(*df.columns, F.when(found.isNotNull(), named).alias(name))
