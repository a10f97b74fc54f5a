"""Distribution summaries, intervals, samples and histograms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .ranks import (
    null_safe_join,
    percentile_aggregates,
    running_counts,
    value_counts,
    values_at_positions,
)

PERCENTILES = {"p50": 0.5, "p75": 0.75, "p85": 0.85, "p95": 0.95}
LOW_CONFIDENCE_N = 20
SAMPLE_SIZE = 5000
#: Parts that a group is ranked in before its best rows meet.
RANK_PARTS = 64
RESAMPLES = 1500
CI_LEVEL = 0.9


def distribution_summary(
    df: DataFrame,
    value: str = "value",
    by: Sequence[str] = (),
    percentiles: dict[str, float] = PERCENTILES,
) -> DataFrame:
    """n, sum, mean, sample deviation, exact percentiles, min and max per group.

    The deviation is the two-pass one (around the group mean, which travels with the running counts); it is
    null below two values. Without groups an empty input still gives one row with n 0 and sum 0.
    """
    return summarize_counts(value_counts(df, value, by), value, by, percentiles)


def summarize_counts(
    counts: DataFrame,
    value: str = "value",
    by: Sequence[str] = (),
    percentiles: dict[str, float] = PERCENTILES,
) -> DataFrame:
    """The same summary from distinct values and how often each occurs (`n`), as saved reports hold them."""
    running = running_counts(counts, value, by)
    aggregates, results = percentile_aggregates(percentiles, value)
    v, n = F.col(value), F.col("n")
    mean = F.col("group_sum") / F.col("total_n")
    summary = running.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("count"),
        F.coalesce(F.sum(v * n), F.lit(0.0)).alias("sum"),
        F.sum(n * (v - mean) * (v - mean)).alias("_squares"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        *aggregates,
    )
    size = F.col("count")
    return summary.select(
        *by,
        size.alias("n"),
        "sum",
        F.try_divide(F.col("sum"), size).alias("mean"),
        F.when(size >= 2, F.sqrt(F.try_divide(F.col("_squares"), size - 1))).alias("stdev"),
        *results,
        "min",
        "max",
        (size < LOW_CONFIDENCE_N).alias("low_confidence"),
    )


# ---------------------------------------------------------------------------
# seeded hashing (same value in any SQL engine with md5)


def hash_uniform(*parts: Column) -> Column:
    """A uniform number in [0, 1) from the first 32 bits of an md5."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def hashed_sample(
    df: DataFrame, identity: Sequence[str], k: int = SAMPLE_SIZE, by: Sequence[str] = (), seed: int = 0
) -> DataFrame:
    """A uniform sample of at most `k` rows per group: the `k` smallest seeded hashes of the row identity.

    Deterministic, and mergeable: the sample of a union is the sample of the samples, and so a group is ranked in
    RANK_PARTS parts first and then among the `k` best of each: no task has a whole group, however few groups there are.
    Parts are by the content of a row, so that a repeated task deals its rows as before. Without groups it is a top-k.
    """
    hashed = df.withColumn(
        "_hash", F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in identity], F.lit(str(seed))))
    )
    order = ["_hash", *identity]
    if not by:
        return hashed.orderBy(*order).limit(k).drop("_hash")
    plain = [f.name for f in df.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(RANK_PARTS))
    for keys in ([*by, "_rank_part"], by):
        ranked = hashed.withColumn("_rank_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        hashed = ranked.filter(F.col("_rank") <= k).drop("_rank", "_rank_part")
    return hashed.drop("_hash")


# ---------------------------------------------------------------------------
# percentile bootstrap


def bootstrap_by_resampling(
    df: DataFrame,
    value: str = "value",
    by: Sequence[str] = (),
    percentiles: dict[str, float] | None = None,
    resamples: int = RESAMPLES,
    level: float = CI_LEVEL,
    seed: int = 0,
) -> DataFrame:
    """Percentile bootstrap interval by explicit resampling with replacement; `resamples` x n rows.

    Draw j of resample b is the value at sorted position `floor(u * n)` with a seeded hash `u`, so the
    result is reproducible. Only for few, small groups: `bootstrap_ci` does not use it.
    """
    percentiles = percentiles or {"p50": 0.5, "p85": 0.85}
    by = list(by)
    running = cut_lineage(running_counts(value_counts(df, value, by), value, by), "ranks")  # read twice
    indexed = running.select(
        *by, value, "total_n",
        F.explode(F.sequence(F.col("below_n"), F.col("below_n") + F.col("n") - 1)).alias("position"),
    )
    draws = indexed.select(
        *by, "total_n", F.col("position").alias("_draw"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_b")
    ).select(
        *by, "_b",
        F.floor(hash_uniform(F.col("_b"), F.col("_draw"), F.lit(seed)) * F.col("total_n")).alias("position"),
    )
    # repeats of one position in one resample become a frequency before the values are fetched
    drawn = draws.groupBy(*by, "_b", "position").agg(F.count(F.lit(1)).alias("_times"))
    source = indexed.select(*by, "position", value)
    resampled = null_safe_join(drawn, source, [*by, "position"])
    probabilities = F.array(*[F.lit(float(p)) for p in percentiles.values()])
    statistics = resampled.groupBy(*by, "_b").agg(F.percentile(value, probabilities, F.col("_times")).alias("_stats"))
    named = statistics.select(
        *by, F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in percentiles]), "_stats")).alias("statistic", "value")
    )
    return _interval(named, by, resamples, level)


def _gamma(shape: Column, normal: Column) -> Column:
    """A gamma variate from a normal one (Wilson-Hilferty); zero for shape zero."""
    root = 1 - 1 / (9 * shape) + normal / (3 * F.sqrt(shape))
    return F.when(shape > 0, shape * F.greatest(root, F.lit(0.0)) * F.greatest(root, F.lit(0.0)) * F.greatest(root, F.lit(0.0))).otherwise(F.lit(0.0))


def _order_statistic_positions(n: Column, p: Column, b: Column, seed: int) -> tuple[Column, Column, Column]:
    """Sorted positions of the two resample order statistics around percentile p, and the fraction between.

    A resample of size n with replacement is n uniform positions; its k-th and next order statistics are the
    shares A / (A + E + C) and (A + E) / (A + E + C) of a gamma(k), an exponential and a gamma(n - k) variate. They
    come from seeded hashes by column functions that any SQL engine has.
    """
    spot = p * (n - 1)
    k = F.floor(spot) + 1
    uniform = lambda i: (F.conv(F.substring(F.md5(F.concat_ws(":", *[x.cast("string") for x in (b, F.round(p * 1000000).cast("bigint"), n, F.lit(seed), F.lit(i))])), 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**32))
    radius, angle = F.sqrt(-2 * F.ln(uniform(1))), F.lit(2 * math.pi) * uniform(2)
    below, above = _gamma(k.cast("double"), radius * F.cos(angle)), _gamma((n - k).cast("double"), radius * F.sin(angle))
    step = F.when(k < n, -F.ln(uniform(3))).otherwise(F.lit(0.0))
    # the largest of n uniforms has one gap above it
    total = below + step + F.when(k < n, above).otherwise(-F.ln(uniform(3)))
    at = lambda x: F.least(F.floor(x / total * n), n - 1).cast("bigint")
    return at(below), at(below + step), spot - F.floor(spot)


def bootstrap_by_order_statistics(
    df: DataFrame,
    value: str = "value",
    by: Sequence[str] = (),
    percentiles: dict[str, float] | None = None,
    resamples: int = RESAMPLES,
    level: float = CI_LEVEL,
    seed: int = 0,
) -> DataFrame:
    """The same interval with `2 x resamples` draws per percentile whatever n is.

    The bootstrap distribution of a percentile depends on the data only through its sorted values, so the
    two order statistics of a resample are drawn directly and looked up. Same law as explicit resampling,
    and the work on the data is one rank pass: billions of values cost no more draws than thousands.
    """
    return bootstrap_of_counts(value_counts(df, value, by), value, by, percentiles, resamples, level, seed)


def bootstrap_of_counts(
    counts: DataFrame,
    value: str = "value",
    by: Sequence[str] = (),
    percentiles: dict[str, float] | None = None,
    resamples: int = RESAMPLES,
    level: float = CI_LEVEL,
    seed: int = 0,
) -> DataFrame:
    """The interval from distinct values and how often each occurs (`n`)."""
    percentiles = percentiles or {"p50": 0.5, "p85": 0.85}
    by = list(by)
    running = cut_lineage(running_counts(counts, value, by), "ranks")  # read three times
    sizes = running.groupBy(*by).agg(F.max("total_n").alias("_n")).filter(F.col("_n") > 0)
    names = F.map_from_arrays(F.array(*[F.lit(k) for k in percentiles]),
                              F.array(*[F.lit(float(p)) for p in percentiles.values()]))
    plan = sizes.select(*by, "_n", F.explode(names).alias("statistic", "_p")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_b")
    )
    lo, hi, fraction = _order_statistic_positions(F.col("_n"), F.col("_p"), F.col("_b"), seed)
    drawn = plan.select(*by, "statistic", "_b", lo.alias("_lo"), hi.alias("_hi"), fraction.alias("fraction"))
    sides = drawn.select(
        *by, "statistic", "_b", "fraction",
        F.explode(F.map_from_arrays(F.array(F.lit("lo"), F.lit("hi")), F.array("_lo", "_hi"))).alias("_side", "position"),
    )
    found = values_at_positions(running, sides, "position", value, by)
    stats = found.groupBy(*by, "statistic", "_b").agg(
        F.max(F.when(F.col("_side") == "lo", F.col(value))).alias("_lo"),
        F.max(F.when(F.col("_side") == "hi", F.col(value))).alias("_hi"),
        F.max("fraction").alias("_fraction"),
    ).select(*by, "statistic", (F.col("_lo") + F.col("_fraction") * (F.col("_hi") - F.col("_lo"))).alias("value"))
    return _interval(stats, by, resamples, level)


def _interval(stats: DataFrame, by: list[str], resamples: int, level: float) -> DataFrame:
    """Outer percentiles of the `resamples` statistics (that many rows per group, a parameter)."""
    alpha = (1 - level) / 2
    bounds = F.percentile("value", F.array(F.lit(alpha), F.lit(1 - alpha)))
    return stats.groupBy(*by, "statistic").agg(bounds.alias("_bounds")).select(
        *by, "statistic",
        F.col("_bounds")[0].alias("ci_low"),
        F.col("_bounds")[1].alias("ci_high"),
        F.lit(level).alias("level"),
        F.lit(resamples).alias("resamples"),
    )


def bootstrap_ci(
    df: DataFrame,
    value: str = "value",
    by: Sequence[str] = ("metric",),
    percentiles: dict[str, float] | None = None,
    resamples: int = RESAMPLES,
    level: float = CI_LEVEL,
    seed: int = 0,
) -> DataFrame:
    """Bootstrap interval per group, by the law of order statistics whatever the size of the group."""
    return bootstrap_by_order_statistics(df, value, by, percentiles, resamples, level, seed)


# ---------------------------------------------------------------------------
# merging summaries


def merge_quotas(sources: DataFrame, source: str = "source", n: str = "n", by: Sequence[str] = (),
                 target: int = SAMPLE_SIZE) -> DataFrame:
    """Sample slots per source, proportional to n, rounded by largest remainder so they sum to the target.

    The target is at most the total n. Ties between remainders go to the lower source name.
    """
    group = Window.partitionBy(*by)
    by_remainder = Window.partitionBy(*by).orderBy(F.col("_fraction").desc(), F.col(source))
    shares = (
        sources.filter(F.col(n) > 0)
        .withColumn("_total", F.sum(n).over(group))
        .withColumn("_target", F.least(F.lit(target), F.col("_total")))
        .withColumn("_raw", F.col(n) / F.col("_total") * F.col("_target"))
        .withColumn("_floor", F.floor("_raw"))
        .withColumn("_fraction", F.col("_raw") - F.col("_floor"))
        .withColumn("_left", F.col("_target") - F.sum("_floor").over(group))
        .withColumn("_turn", F.row_number().over(by_remainder))
    )
    return shares.select(
        *by, source, n, (F.col("_floor") + F.when(F.col("_turn") <= F.col("_left"), 1).otherwise(0)).alias("quota")
    )


def weighted_merge_sample(
    summaries: DataFrame,
    samples: DataFrame,
    identity: Sequence[str],
    source: str = "source",
    by: Sequence[str] = ("metric",),
    target: int = SAMPLE_SIZE,
    seed: int = 0,
) -> DataFrame:
    """Draw from every stored sample in proportion to the population behind it.

    `summaries(by..., source, n)` carries the true sizes, `samples(by..., source, identity..., value)` the
    stored rows; a source gives at most what it stored.
    """
    keys = [*by, source]
    quotas = merge_quotas(summaries, source, "n", by, target).select(*keys, "quota")
    order = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in identity], F.lit(str(seed))))
    window = Window.partitionBy(*keys).orderBy("_hash", *identity)
    ranked = samples.withColumn("_hash", order).withColumn("_turn", F.row_number().over(window))
    # a stored sample has `target` rows at most, and so has a task
    capped = ranked.filter(F.col("_turn") <= target)
    return capped.join(quotas, keys).filter(F.col("_turn") <= F.col("quota")).drop("_hash", "_turn", "quota")


def merge_summaries(
    summaries: DataFrame,
    samples: DataFrame,
    identity: Sequence[str],
    source: str = "source",
    by: Sequence[str] = ("metric",),
    target: int = SAMPLE_SIZE,
    seed: int = 0,
) -> DataFrame:
    """One summary per group from several: n, sum, mean, min and max exact, the rest from the merged sample."""
    drawn = weighted_merge_sample(summaries, samples, identity, source, by, target, seed)
    exact = summaries.filter(F.col("n") > 0).groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.bool_or("sampled").alias("_any_sampled"),
    )
    estimated = distribution_summary(drawn, "value", by).select(
        *by, F.col("n").alias("sample_n"), "stdev", *PERCENTILES
    )
    n, drawn_n = F.col("n"), F.coalesce(F.col("sample_n"), F.lit(0))
    return null_safe_join(exact, estimated, list(by), "left").select(
        *by, "n", "sum", F.try_divide(F.col("sum"), n).alias("mean"), "stdev", *PERCENTILES, "min", "max",
        drawn_n.alias("sample_n"),
        (F.col("_any_sampled") | (drawn_n < n)).alias("sampled"),
        ((n < LOW_CONFIDENCE_N) | (drawn_n < LOW_CONFIDENCE_N)).alias("low_confidence"),
    )


# ---------------------------------------------------------------------------
# histogram


def clipped_histogram(
    df: DataFrame, value: str = "value", series: str = "series", bins: int = 44, clip: float = 0.98
) -> DataFrame:
    """Comparative histogram from 0 to the largest of the series' clip percentiles.

    Rows `(series, bin, bin_start, n, share, clipped, p50, p95, series_n)`; every bin of every series is
    present. Shares are of the full series, so the clipped tail shows as missing mass. Series with fewer
    than two values are left out.
    """
    counts = value_counts(df, value, [series])
    running = cut_lineage(running_counts(counts, value, [series]).filter(F.col("total_n") >= 2), "ranks")
    aggregates, results = percentile_aggregates({"p50": 0.5, "p95": 0.95, "_clip": clip}, value)
    markers = running.groupBy(series).agg(*aggregates, F.max("total_n").alias("series_n")).select(
        series, "series_n", *results
    )
    x_max = markers.agg(F.max("_clip")).scalar()
    limited = running.select(series, value, "n").withColumn("_max", x_max)
    width = F.col("_max") / bins
    slot = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.try_divide(F.col(value), width)))).cast("int")
    binned = limited.withColumn("bin", F.when(F.col(value) <= F.col("_max"), slot).otherwise(F.lit(-1)))
    filled = binned.groupBy(series, "bin").agg(F.sum("n").alias("n"))
    clipped = filled.filter(F.col("bin") == -1).select(series, F.col("n").alias("clipped"))
    spine = (
        markers.withColumn("_max", x_max)
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    )
    n = F.coalesce(F.col("n"), F.lit(0))
    return (
        spine.join(filled, [series, "bin"], "left").join(clipped, series, "left")
        .select(
            series, "bin", (F.col("bin") * F.col("_max") / bins).alias("bin_start"), n.alias("n"),
            F.try_divide(n.cast("double"), F.col("series_n")).alias("share"),
            F.coalesce("clipped", F.lit(0)).alias("clipped"), "p50", "p95", "series_n",
        )
    )
