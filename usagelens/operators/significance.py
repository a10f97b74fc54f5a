"""Rank test between two groups of values, and the comparison of two distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pct_change
from ..functions.stats import direction, effect_label, normal_cdf_five_term
from .distribution import LOW_CONFIDENCE_N, PERCENTILES
from .ranks import percentile_aggregates, running_counts, value_at, value_counts

MIN_N = 10
BASELINE, COMPARE = "baseline", "compare"


def _running_sides(df: DataFrame, value: str, side: str, sides: tuple[str, str], by: Sequence[str]) -> DataFrame:
    """Distinct values with the counts of both sides (`n_1`, `n_2`, `n`) and the counts below."""
    return _running_counts_of_sides(value_counts(df, value, [*by, side]), value, side, sides, by)


def _running_counts_of_sides(counts: DataFrame, value: str, side: str, sides: tuple[str, str], by: Sequence[str]) -> DataFrame:
    """The same from values that are counted already: `(by..., side, value, n)`."""
    of = lambda name: F.coalesce(F.sum(F.when(F.col(side) == name, F.col("n"))), F.lit(0))
    used = counts.filter(F.col(side).isin(*sides)).groupBy(*by, value).agg(of(sides[0]).alias("n_1"), of(sides[1]).alias("n_2"))
    return running_counts(used.withColumn("n", F.col("n_1") + F.col("n_2")), value, by, ("n", "n_1", "n_2"))


def _rank_sums(value: str) -> list[Column]:
    """Aggregates behind the test: sizes, rank sum of the first side, tie sum and both lower medians."""
    average_rank = F.col("below_n") + (F.col("n") + 1) / 2
    n = F.col("n").cast("double")
    lower = lambda m: value_at(F.floor((F.col(f"total_{m}") - 1) / 2), value, m)
    return [
        F.coalesce(F.sum("n_1"), F.lit(0)).alias("n1"),
        F.coalesce(F.sum("n_2"), F.lit(0)).alias("n2"),
        F.sum(F.col("n_1") * average_rank).alias("_rank_sum"),
        F.sum(n * n * n - n).alias("_ties"),
        lower("n_1").alias("_median_1"),
        lower("n_2").alias("_median_2"),
    ]


def _test_columns(min_n: int) -> list[Column]:
    """The test from the rank sums; test columns are null when a side has fewer than `min_n` values."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    total = n1 + n2
    u1 = F.col("_rank_sum") - n1 * (n1 + 1) / 2
    u2 = n1 * n2 - u1
    correction = F.coalesce(F.try_divide(F.col("_ties"), total * (total - 1)), F.col("_ties"))
    sigma = F.sqrt(F.greatest(n1 * n2 / 12 * (total + 1 - correction), F.lit(0.0)))
    gap = F.least(u1, u2) - n1 * n2 / 2
    z = F.when(sigma > 0, F.try_divide(gap + F.when(gap < 0, 0.5).otherwise(-0.5), sigma)).otherwise(F.lit(0.0))
    p_value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * normal_cdf_five_term(-F.abs(z))))
    effect = F.lit(1.0) - F.try_divide(F.lit(2.0) * u1, n1 * n2)
    skipped = (F.col("n1") < min_n) | (F.col("n2") < min_n)
    tested = lambda c: F.when(~skipped, c)
    return [
        skipped.alias("skipped"),
        tested(u1).alias("u1"),
        tested(u2).alias("u2"),
        tested(z).alias("z"),
        tested(p_value).alias("p_value"),
        tested(effect).alias("rank_biserial"),
        tested(effect_label(effect)).alias("effect_size"),
        F.coalesce(direction("_median_1", "_median_2"), F.lit("flat")).alias("direction"),
    ]


def mann_whitney(
    df: DataFrame,
    value: str = "value",
    side: str = "side",
    sides: tuple[str, str] = (BASELINE, COMPARE),
    by: Sequence[str] = (),
    min_n: int = MIN_N,
) -> DataFrame:
    """Two-sided Mann-Whitney U with tie correction and continuity correction, one row per group.

    Runs on all values: ties share one row after counting, the average rank of a value is the count below it
    plus half its own count, and one aggregate gives the rank sum, the tie sum and both lower medians.
    """
    sums = _running_sides(df, value, side, sides, by).groupBy(*by).agg(*_rank_sums(value))
    skipped, *rest = _test_columns(min_n)
    return sums.select(*by, skipped, "n1", "n2", *rest)


def sided(summary: DataFrame, columns: Sequence[str], by: Sequence[str], side: str = "side",
          sides: tuple[str, str] = (BASELINE, COMPARE)) -> DataFrame:
    """Two rows per group (one per side) to one row with `base_*` and `comp_*` columns, in one shuffle."""
    picks = [
        F.max(F.when(F.col(side) == value, F.col(c))).alias(f"{prefix}_{c}")
        for prefix, value in zip(("base", "comp"), sides)
        for c in columns
    ]
    return summary.groupBy(*by).agg(*picks)


def compare_distributions(
    df: DataFrame,
    value: str = "value",
    side: str = "side",
    by: Sequence[str] = ("metric",),
    min_n: int = MIN_N,
) -> DataFrame:
    """Percentiles of both sides, their changes, the rank test and a verdict class, from one rank pass.

    Verdict: `no-activity`, `directional` (too few values to test), `significant` or `not-significant`.
    """
    return compare_counts(value_counts(df, value, [*by, side]), value, side, by, min_n)


def compare_counts(
    counts: DataFrame,
    value: str = "value",
    side: str = "side",
    by: Sequence[str] = ("metric",),
    min_n: int = MIN_N,
) -> DataFrame:
    """The same comparison from counted values `(by..., side, value, n)`: stored distributions are enough."""
    running = _running_counts_of_sides(counts, value, side, (BASELINE, COMPARE), by)
    aggregates, results = [], []
    for prefix, measure in (("base", "n_1"), ("comp", "n_2")):
        some, named = percentile_aggregates({f"{prefix}_{p}": q for p, q in PERCENTILES.items()}, value, measure)
        aggregates += some
        results += named
    sums = running.groupBy(*by).agg(*_rank_sums(value), *aggregates)
    joined = sums.select(*by, "n1", "n2", *results, *_test_columns(min_n))
    return joined.select(
        *by,
        F.col("n1").alias("base_n"),
        F.col("n2").alias("comp_n"),
        *[F.col(f"{s}_{p}") for p in PERCENTILES for s in ("base", "comp")],
        *[pct_change(f"base_{p}", f"comp_{p}").alias(f"{p}_pct_change") for p in PERCENTILES],
        ((F.col("n1") < LOW_CONFIDENCE_N) | (F.col("n2") < LOW_CONFIDENCE_N)).alias("low_confidence"),
        "skipped", "u1", "u2", "z", "p_value", "rank_biserial", "effect_size", "direction",
        F.when(F.col("n2") == 0, "no-activity")
        .when(F.col("skipped"), "directional")
        .when(F.col("p_value") < 0.05, "significant")
        .otherwise("not-significant").alias("verdict"),
    )
