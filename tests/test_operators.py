"""Operators against brute-force Python on random inputs."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.operators import (
    distinct_counts,
    modal_row,
    mode_value,
    number_rows,
    pivot_count,
    share_of_total,
    successor,
    successor_gap_parts,
    top_k_per_group,
    top_n_threshold,
)


def test_successor_gaps_match_sorted_pairs(spark):
    rnd = random.Random(7)
    base = dt.date(2017, 1, 1)
    rows = []
    for _ in range(400):
        cust = rnd.choice(["a", "b", "c", None, "d"])
        d = None if rnd.random() < 0.05 else base + dt.timedelta(days=rnd.randint(0, 900))
        rows.append((cust, d))
    df = spark.createDataFrame(rows, "cust string, d date")
    parts = successor_gap_parts(df, "cust", "d")
    got = parts.groupBy(F.year("d").alias("y")).agg(
        F.sum("tau_sum").alias("s"), F.sum("tau_n").alias("n")
    )
    got = {r.y: (r.s, r.n) for r in got.collect() if r.n}

    want = defaultdict(lambda: [0, 0])
    by_cust = defaultdict(list)
    for c, d in rows:
        if d is not None:
            by_cust[c].append(d)
    for dates in by_cust.values():
        dates.sort()
        for a, b in zip(dates, dates[1:]):
            want[a.year][0] += abs((b - a).days - 1)
            want[a.year][1] += 1
    assert got == {y: tuple(v) for y, v in want.items()}


def test_within_top_n_equals_rank(spark):
    rnd = random.Random(3)
    vals = [(i, rnd.choice([1, 2, 3, 5, 5, 8, 8, 8, 13, 21])) for i in range(300)]
    df = spark.createDataFrame(vals, "id int, v int")
    for n in (1, 3, 5, 7):
        ours = {r.id for r in df.filter(F.col("v") >= top_n_threshold(df, "v", n)).collect()}
        ranked = df.withColumn("rk", F.rank().over(Window.orderBy(F.col("v").desc())))
        ref = {r.id for r in ranked.filter(F.col("rk") <= n).collect()}
        assert ours == ref


def test_top_k_keeps_ties(spark):
    df = spark.createDataFrame(
        [(1, "a", 5), (1, "b", 5), (1, "c", 4), (1, "d", 3), (2, "e", 1)],
        "g int, name string, m int",
    )
    got = top_k_per_group(df, ["g"], "m", 2)
    assert sorted((r.name, r.yearly_rank) for r in got.collect()) == [
        ("a", 1),
        ("b", 1),
        ("e", 1),
    ]


def test_modal_row_random(spark):
    rnd = random.Random(11)
    rows = [
        (rnd.choice("pq"), rnd.choice([1, 2, None]), rnd.choice(["x", "y", None]))
        for _ in range(200)
    ]
    df = spark.createDataFrame(rows, "k string, a int, b string")
    got = {r.k: (r.a, r.b) for r in modal_row(df, "k", ["a", "b"]).collect()}

    def key(t):  # NULL first, then value
        return tuple((0, 0) if v is None else (1, v) for v in t)

    for k in "pq":
        counts = Counter((a, b) for kk, a, b in rows if kk == k)
        best = max(counts.values())
        want = min((t for t, c in counts.items() if c == best), key=key)
        assert got[k] == want


def test_modal_row_ties_by_chosen_columns(spark):
    df = spark.createDataFrame([("k", 1, "z"), ("k", 2, "a")], "k string, a int, b string")
    assert tuple(modal_row(df, "k", ["a", "b"]).first()) == ("k", 1, "z")
    assert tuple(modal_row(df, "k", ["a", "b"], tie_cols=["b"]).first()) == ("k", 2, "a")


def test_mode_value_smallest_on_tie(spark):
    df = spark.createDataFrame([(1, 3), (1, 3), (1, 2), (1, 2), (1, 9)], "g int, v int")
    assert mode_value(df, "g", "v", "m").first().m == 2


def test_pivot_count_nulls_and_totals(spark):
    df = spark.createDataFrame(
        [("a", 2016), ("a", 2016), ("a", 2020), ("b", 2017), ("b", None)], "t string, y int"
    )
    got = {r.t: r.asDict() for r in pivot_count(df, "t", "y", [2016, 2017], "total").collect()}
    assert got["a"] == {"t": "a", "total": 3, "2016": 2, "2017": None}
    assert got["b"] == {"t": "b", "total": 2, "2016": None, "2017": 1}


def test_share_of_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    got = {r.k: r.percentage for r in share_of_total(df, "n", 1).collect()}
    assert got == {"a": 33.3, "b": 66.7}


def test_number_rows_many_partitions(spark):
    rnd = random.Random(5)
    vals = [(rnd.randint(0, 50), rnd.random()) for _ in range(2000)]
    a = spark.createDataFrame(vals, "g int, x double").repartition(13)
    b = spark.range(777).select((F.col("id") * 7 % 1000).alias("v"))
    na, nb = number_rows(a, ["g", "x"]), number_rows(b, ["v"])
    got_a = [(r.g, r.x) for r in na.orderBy("rn").collect()]
    assert got_a == sorted(vals)
    rn_a = sorted(r.rn for r in na.collect())
    assert rn_a == list(range(1, 2001))
    got_b = [r.v for r in nb.orderBy("rn").collect()]
    assert got_b == sorted(i * 7 % 1000 for i in range(777))


def test_share_topn_others_matches_global_rank(spark):
    from marketlens.operators import share_topn_others

    rnd = random.Random(17)
    for trial in range(4):
        # many labels with close counts, so rounding creates ties at rank 5
        counts = {f"L{i}": rnd.choice([1, 2, 3, 50, 51, 52, 400, 401]) for i in range(60)}
        counts["others"] = 3  # a real label equal to the pooled name merges by value
        ents = [(f"{k}-{j}", k, "s") for k, c in counts.items() for j in range(c)]
        df = spark.createDataFrame(ents, "id string, city string, state string")
        dp = trial % 2 + 1
        got = {
            r.top_5: (r.total_percentage, r.n)
            for r in share_topn_others(df, ["id", "city", "state"], "city", dp, "n").collect()
        }
        total = sum(counts.values())
        scale = 10**dp
        pct = {k: (2 * c * 100 * scale + total) // (2 * total) for k, c in counts.items()}
        want: dict[str, list[int]] = {}
        for k, p in pct.items():
            rank = 1 + sum(1 for q in pct.values() if q > p)
            label = k if rank <= 5 else "others"
            acc = want.setdefault(label, [0, 0])
            acc[0] += p
            acc[1] += 1
        assert got == {k: (v[0] / scale, v[1]) for k, v in want.items()}


def _plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_top_k_equals_rank_on_random_rows(spark):
    rnd = random.Random(23)
    rows = [
        (rnd.choice([2016, 2017, None]), rnd.choice([None, 1, 1, 2, 3, 5, 8]), i) for i in range(400)
    ]
    df = spark.createDataFrame(rows, "y int, m int, id int")
    w = Window.partitionBy("y").orderBy(F.col("m").desc_nulls_first())
    for k in (1, 2, 3, 70, 1000):
        want = df.withColumn("rk", F.rank().over(w)).filter(F.col("rk") <= k)
        got = top_k_per_group(df, ["y"], "m", k, "rk")
        assert Counter(map(tuple, got.collect())) == Counter((r.y, r.m, r.id, r.rk) for r in want.collect())


def test_tied_rows_are_never_sorted(spark):
    """A million rows tied at the top of one year: the only window runs over
    the values, at most k of them per year and task."""
    n = 1_000_000
    df = spark.range(n, numPartitions=8).select((F.col("id") % 1 + 2017).alias("y"), "id", (F.col("id") % 1 + 7).alias("m"))
    got = top_k_per_group(df, ["y"], "m", 3)
    assert got.count() == n
    plan = _plan(got.agg(F.count("id"), F.max("yearly_rank")))
    windows = plan.count("Window [")
    assert windows and "WindowGroupLimit" in plan
    # The window's rows come out of the aggregate by (year, value).
    below = plan[plan.index("Window [") :].split("HashAggregate(keys=[")[1]
    assert below.startswith("y#") and "m#" in below.split("]")[0]


def test_number_rows_is_lazy_and_total(spark):
    rnd = random.Random(29)
    names = [None, "a", "ab", "abc", "abd", "b", "ba", "élan", "zz"]
    rows = [(rnd.choice([None, 2016, 2017, 2018]), rnd.choice([1, 2, 3]), rnd.choice(names), i) for i in range(500)]
    df = spark.createDataFrame(rows, "y int, rk int, name string, id int").repartition(7)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("numbering", "no job while building")
    numbered = number_rows(df, ["y", "rk", "name"])
    assert not tracker.getJobIdsForGroup("numbering")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    def place(r):
        return tuple((v is None, v if v is not None else 0) for v in (r[0], r[1])) + ((r[2] is None, r[2] or ""),)

    got = sorted(numbered.collect(), key=lambda r: r.rn)
    assert [r.rn for r in got] == list(range(1, 501))
    assert [place((r.y, r.rk, r.name)) for r in got] == sorted(map(place, rows))


def test_distinct_counts_equal_sql_without_expand(spark):
    rnd = random.Random(31)
    rows = [
        (rnd.choice(["a", None]), rnd.choice([1, 2, 3, None]), rnd.choice(["x", "y", None]), rnd.choice([None, 4, 5]))
        for _ in range(300)
    ]
    df = spark.createDataFrame(rows, "g string, k int, s string, v int")
    got = distinct_counts(df, ["g"], {"ks": "k", "ss": "s"}, {"total": F.col("v")})
    want = df.groupBy("g").agg(F.countDistinct("k"), F.countDistinct("s"), F.sum("v"))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert "Expand" in _plan(want) and "Expand" not in _plan(got)
    one = distinct_counts(df, ["g"], {"ks": "k"}, {"total": F.col("v")})
    assert Counter(map(tuple, one.collect())) == Counter((r[0], r[1], r[3]) for r in want.collect())


def test_successor_equals_the_window(spark):
    rnd = random.Random(37)
    rows = [
        (rnd.choice([None, None, "a", "b", "c", f"u{i % 40}"]), rnd.choice([None, *range(30)]), i) for i in range(900)
    ]
    df = spark.createDataFrame(rows, "who string, day int, id int").repartition(6)
    w = Window.partitionBy("who").orderBy("day", "id")
    want = df.withColumn("next", F.lead(F.struct("day", "id")).over(w))
    for slices in (1, 4, 23):
        got = successor(df, ["who"], ["day", "id"], ["day", "id"], slices=slices)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert successor(df.filter("1 = 0"), ["who"], ["day"]).count() == 0


def test_successor_spreads_a_hot_entity(spark):
    """A NULL customer with a third of all rows, most of them on one day."""
    df = spark.range(9000, numPartitions=6).select(
        F.when(F.col("id") % 3 != 0, F.col("id")).alias("who"), (F.col("id") % 2).alias("day"), "id"
    )
    got = successor(df, ["who"], ["day"], ["day"], slices=12)
    rows = got.filter("who IS NULL").groupBy("day", F.col("next.day").alias("next_day")).count().collect()
    assert {(r.day, r.next_day): r["count"] for r in rows} == {(0, 0): 1499, (0, 1): 1, (1, 1): 1499, (1, None): 1}
    # The largest slice of the written table holds far less than the third.
    files = [f for f in got.inputFiles()]
    sizes = [spark.read.parquet(f).count() for f in files]
    assert max(sizes) < 1800 and sum(sizes) == 9000
