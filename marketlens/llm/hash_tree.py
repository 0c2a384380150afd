"""Sharding by a hierarchical weighted hash tree.

A tree has regions, regions have racks, racks have numbered shards with a
weight; a node weighs what its shards weigh. A row descends the three levels:
at each, every child draws ``-ln(u) / weight`` with u hashed from the row's key
and the child's name, and the smallest draw wins, so that a child wins in
proportion to its weight. Draws belong to names: when the weight of a shard
changes, only its own draw and those of its rack and region change, so a row
moves only into or out of that region, and rows that stay in the region move
only into or out of that rack. ``place`` is a column expression: no shuffle, no
state, the same key gives the same shard in every table.

``grown`` adds a shard as a region of its own. All other draws stay as they
were, so rows move into the new shard only (the heavier region that a shard
added to an old rack would make also draws rows for its other shards).

``shard_rows`` lists the rows of every shard with slots counted from 0, without
a task that holds a shard: equal rows are counted first (a row that is repeated
any number of times travels once), spread by a digest into buckets of about
``bucket_rows`` rows, and a bucket's first slot is the sum of those before it
(one row per shard and bucket). Counted rows are unfolded last, in chunks that
are dealt to tasks anew.

Defined cases: a null key is the empty key; a null text has size 16 and the
checksum of no bytes; repeated rows have one shard and a slot each; rows are
ordered in a shard by their digest, equal rows stand side by side; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm._shared import free_name, written


@dataclass(frozen=True)
class Tree:
    """regions[r][k] is rack k of region r: ((shard number, weight), ...)."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    def __post_init__(self):
        shards = self.shards()
        if len(set(shards)) != len(shards):
            raise ValueError("a shard stands twice in the tree")
        if not any(w > 0 for region in self.regions for rack in region for _, w in rack):
            raise ValueError("no shard has a weight")
        if any(w < 0 for region in self.regions for rack in region for _, w in rack):
            raise ValueError("a weight is negative")

    def shards(self) -> list[int]:
        return [shard for region in self.regions for rack in region for shard, _ in rack]

    def grown(self, weight: float = 1.0) -> Tree:
        """This tree with one more shard, numbered next, as a region of its own."""
        return Tree((*self.regions, (((max(self.shards()) + 1, weight),),)))


def even_tree(shards: int, racks: int = 2, rack_shards: int = 4) -> Tree:
    """Shards 0 to ``shards`` - 1 of weight 1, filled rack by rack, region by region."""
    numbers = range(shards)
    full = [tuple((n, 1.0) for n in numbers[i : i + rack_shards]) for i in range(0, shards, rack_shards)]
    return Tree(tuple(tuple(full[i : i + racks]) for i in range(0, len(full), racks)))


def _draw(key: Column, name: Column, weight: float) -> Column:
    """-ln(u) / weight; u from 52 bits of the hash of key and name, inside (0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat(key, name).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(weight)


def _winner(key: Column, path: str, weights: list[float]) -> Column:
    """Number of the child with the smallest draw; a child without weight has none."""
    draws = [
        F.struct(_draw(key, F.lit(f"{path}/{i}"), w).alias("draw"), F.lit(i).alias("child"))
        for i, w in enumerate(weights)
        if w > 0
    ]
    return draws[0]["child"] if len(draws) == 1 else F.array_min(F.array(*draws))["child"]


def _cases(cases: list[tuple[Column, Column]]) -> Column:
    out = F.when(*cases[0])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out


def place(df: DataFrame, tree: Tree, key: Column, name: str) -> DataFrame:
    """``df`` with the shard of every row as column ``name``."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    weight = lambda rack: float(sum(w for _, w in rack))
    region, rack = free_name(df, "region_of_row"), free_name(df, "rack_of_row")
    at_region, at_rack = F.col(region), F.col(rack)
    living = [(r, racks) for r, racks in enumerate(tree.regions) if sum(map(weight, racks)) > 0]
    df = df.withColumn(region, _winner(key, "", [sum(map(weight, racks)) for racks in tree.regions]))
    df = df.withColumn(
        rack, _cases([(at_region == r, _winner(key, f"/{r}", [weight(k) for k in racks])) for r, racks in living])
    )
    shards = []
    for r, racks in living:
        for k, own in enumerate(racks):
            if weight(own) > 0:
                child = _winner(key, f"/{r}/{k}", [w for _, w in own])
                number = F.element_at(F.array(*[F.lit(s) for s, _ in own]), child + 1)
                shards.append(((at_region == r) & (at_rack == k), number))
    return df.withColumn(name, _cases(shards)).drop(region, rack)


def shard_rows(rows: DataFrame, shard: str, slot: str = "slot", bucket_rows: int = 100_000, chunk: int = 10_000) -> DataFrame:
    """The rows of every shard, numbered gapless from 0 as ``slot``.

    Rows are ordered by the digest of all columns but ``shard``. ``rows``
    should be narrow (ids and checksums); every column stays.
    """
    columns = rows.columns
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns if c != shard]
    counted = rows.groupBy(*columns).agg(F.count("*").alias("_n"))
    counted = written(counted.withColumn("_digest", F.md5(F.concat_ws(":", *said).cast("binary"))), "shard-rows")
    total = counted.agg(F.sum("_n")).first()[0] or 0
    buckets = -(-total // bucket_rows) or 1
    head = F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long")
    spread = counted.withColumn("_bucket", F.shiftright(head * F.lit(buckets), 32))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        spread.groupBy(shard, "_bucket")
        .agg(F.sum("_n").alias("_own"))
        .select(shard, "_bucket", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_first"))
    )
    within = Window.partitionBy(shard, "_bucket").orderBy("_digest", *columns).rowsBetween(Window.unboundedPreceding, -1)
    numbered = spread.join(firsts, [shard, "_bucket"]).withColumn(
        "_first", F.col("_first") + F.coalesce(F.sum("_n").over(within), F.lit(0))
    )
    last = F.col("_n") - 1
    few = numbered.where(F.col("_n") <= chunk).withColumn("_from", F.lit(0).cast("long"))
    many = numbered.where(F.col("_n") > chunk).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(chunk).cast("long"))))
    many = many.repartition("_digest", "_from")
    return (
        few.union(many)
        .withColumn("_i", F.explode(F.sequence("_from", F.least(last, F.col("_from") + (chunk - 1)))))
        .select(*columns, (F.col("_first") + F.col("_i")).alias(slot))
    )
