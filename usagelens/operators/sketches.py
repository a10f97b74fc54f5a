"""Compact, mergeable summaries for stored reports: quantiles and distinct counts of a size that does not grow.

The exact tables of a report (distinct values with counts, lists of names) stay the default. These columns stand beside
them where a report has to stay small: a KLL sketch per group for percentiles, with a stated rank error, and a theta
sketch for distinct counts across reports that overlap, exact up to its nominal entries. Both merge in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: KLL parameter; the rank error of a single query is under 2.3 / k**0.9 (about 0.14 per cent here) with 99 per cent confidence.
QUANTILE_K = 3_200
#: log2 of the entries a theta sketch keeps; up to three quarters of them a count is exact, beyond the error is about 0.4 per cent.
DISTINCT_LOG = 16


def rank_error(k: int = QUANTILE_K) -> float:
    """Bound of the rank error of a percentile, as a share."""
    return 2.3 / k**0.9


def quantile_sketches(rows: DataFrame, value: str = "value", by: Sequence[str] = (), k: int = QUANTILE_K) -> DataFrame:
    """`(by..., n, sketch, least, most)`: one row per group; null and NaN values are left out."""
    v = F.col(value).cast("double")
    clean = rows.where(v.isNotNull() & ~F.isnan(v)).withColumn("_v", v)
    return clean.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"), F.min("_v").alias("least"), F.max("_v").alias("most"))


def merge_quantiles(sketches: DataFrame, by: Sequence[str] = (), k: int = QUANTILE_K) -> DataFrame:
    """The same columns over several reports."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.min("least").alias("least"), F.max("most").alias("most"))


def percentiles_of(sketches: DataFrame, percentiles: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """`(by..., n, percentiles..., rank_error)`: values whose rank lies within `rank_error` of the percentile."""
    values = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in percentiles.items()]
    return sketches.select(*by, "n", *values, F.lit(rank_error()).alias("rank_error"))


def distinct_sketch(column: str | Column, log_entries: int = DISTINCT_LOG) -> Column:
    """Aggregate: a sketch of the distinct non-null values."""
    return F.theta_sketch_agg(column, F.lit(log_entries))


def merge_distinct(rows: DataFrame, sketches: Sequence[str], by: Sequence[str] = (), log_entries: int = DISTINCT_LOG) -> DataFrame:
    """United sketches of several reports: a value on two machines counts once."""
    return rows.groupBy(*by).agg(*[F.theta_union_agg(s, F.lit(log_entries)).alias(s) for s in sketches])


def distinct_count(sketch: str | Column) -> Column:
    return F.theta_sketch_estimate(sketch)
