"""Exact half-up ratios against Python's Fraction."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketlens.functions import percent_half_up, ratio_half_up


def _half_up(num: int, den: int, dp: int) -> float:
    """Reference: round the exact fraction half-up with Decimal, then display."""
    scaled = Fraction(num, den) * 10**dp
    q = (Decimal(scaled.numerator) / Decimal(scaled.denominator)).quantize(
        Decimal(1), ROUND_HALF_UP
    )
    return int(q) / 10**dp


def test_f6_half_rounds_up(spark):
    got = spark.range(1).select(ratio_half_up(F.lit(201), F.lit(200), 2).alias("r")).first().r
    assert got == 1.01
    # the floating value 1.005 is below the half; the exact ratio is not
    assert Decimal(201) / Decimal(200) == Decimal("1.005")
    assert Decimal("1.005").quantize(Decimal("0.01"), ROUND_HALF_UP) == Decimal("1.01")


def test_zero_and_null_denominators_give_null(spark):
    row = spark.range(1).select(
        ratio_half_up(F.lit(3), F.lit(0), 2).alias("a"),
        ratio_half_up(F.lit(3), F.lit(None).cast("long"), 2).alias("b"),
    ).first()
    assert row.a is None and row.b is None


@settings(max_examples=25, deadline=None)
@given(
    st.lists(
        st.tuples(st.integers(0, 10**9), st.integers(1, 10**6), st.integers(0, 3)),
        min_size=1,
        max_size=40,
    )
)
def test_matches_fraction(spark, cases):
    df = spark.createDataFrame(cases, "n long, d long, dp int")
    exprs = [ratio_half_up("n", "d", dp).alias(f"r{dp}") for dp in range(4)]
    exprs += [percent_half_up("n", "d", dp).alias(f"p{dp}") for dp in range(4)]
    for r, (n, d, _) in zip(df.select("n", "d", *exprs).collect(), cases):
        for dp in range(4):
            assert r[f"r{dp}"] == _half_up(n, d, dp)
            assert r[f"p{dp}"] == _half_up(100 * n, d, dp)
