"""Rule tables: findings, KPIs and verdicts as rows.

A comparison is first reduced to `(fact, value)` rows; the rules read the facts as one wide row. Facts come
from one-row tables, so nothing here grows with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pct_change, ratio
from .comparing import (
    decompose_cost_change,
    mix_adjusted_cost,
    overall_failure_rate,
    per_request_profile,
    workload_overlap,
)

PROFILE_FACTS = (
    "requests", "cost_per_request", "tokens_per_request", "context_per_request", "output_per_request", "cache_hit_rate",
)
FACTS = (
    *[f"{s}_{f}" for f in PROFILE_FACTS for s in ("base", "comp")],
    "baseline_weighted", "adjusted_weighted",
    "output_length", "overlap_pct",
    "base_compactions", "comp_compactions",
    "base_tool_bytes", "comp_tool_bytes",
    "failure_rate_1", "failure_rate_2", "failure_tested", "failure_significant", "failure_up", "failure_down",
)


def as_facts(row: DataFrame, columns: dict[str, Column | str]) -> DataFrame:
    """A one-row table as `(fact, value)` rows."""
    pairs = F.array(*[
        F.struct(F.lit(name).alias("fact"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("value"))
        for name, c in columns.items()
    ])
    return row.select(F.inline(pairs))


def comparison_facts(
    priced: DataFrame,
    models: DataFrame,
    agents: DataFrame,
    tools: DataFrame,
    compactions: DataFrame,
    side: str = "side",
) -> DataFrame:
    """All facts of one comparison as one wide row.

    `priced`, `tools` and `compactions(side, compactions)` carry a side; `models` and `agents` have one row
    per key with both sides.
    """
    def two_sides(df: DataFrame, names: dict[str, str]) -> DataFrame:
        per_row = F.array(*[
            F.struct(
                F.concat(F.when(F.col(side) == "baseline", "base_").otherwise("comp_"), F.lit(fact)).alias("fact"),
                F.col(c).cast("double").alias("value"),
            )
            for fact, c in names.items()
        ])
        return df.select(F.inline(per_row))

    failure = overall_failure_rate(tools, side)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    parts = [
        two_sides(per_request_profile(priced, [side]), {f: f for f in PROFILE_FACTS}),
        as_facts(mix_adjusted_cost(models), {c: c for c in ("baseline_weighted", "adjusted_weighted")}),
        as_facts(decompose_cost_change(models), {"output_length": "output_length"}),
        as_facts(workload_overlap(agents), {"overlap_pct": "overlap_pct"}),
        two_sides(compactions, {"compactions": "compactions"}),
        two_sides(tools.groupBy(side).agg(F.sum("total_bytes").alias("_bytes")), {"tool_bytes": "_bytes"}),
        as_facts(failure, {
            "failure_rate_1": "rate_1",
            "failure_rate_2": "rate_2",
            "failure_tested": flag(~F.col("skipped")),
            "failure_significant": flag(F.col("significant")),
            "failure_up": flag(F.col("direction") == "up"),
            "failure_down": flag(F.col("direction") == "down"),
        }),
    ]
    tidy = reduce(DataFrame.unionByName, parts)
    return tidy.agg(*[F.max(F.when(F.col("fact") == f, F.col("value"))).alias(f) for f in FACTS])


def _delta(name: str) -> Column:
    return pct_change(f"base_{name}", f"comp_{name}")


def _cache_points() -> Column:
    return (F.col("comp_cache_hit_rate") - F.col("base_cache_hit_rate")) * 100


def _failure(direction: str) -> Column:
    return (F.col("failure_tested") == 1) & (F.col("failure_significant") == 1) & (F.col(f"failure_{direction}") == 1)


def _not_comparable() -> Column:
    return F.coalesce(F.col("overlap_pct") < 60, F.lit(False))


def findings(facts: DataFrame, models: DataFrame, model: str = "model") -> DataFrame:
    """Findings that apply, as `(finding, subject, status, value, baseline, compare)`."""
    cost, context, output = _delta("cost_per_request"), _delta("context_per_request"), _delta("output_per_request")
    cache = _cache_points()
    adjusted = pct_change("baseline_weighted", "adjusted_weighted")
    mix_part = cost - adjusted
    moved = lambda d: F.when(F.abs(d) < 2, "neutral").when(d < 0, "good").otherwise("bad")
    like = F.col("output_length")
    contradicts = F.coalesce(((like > 0) == (output < 0)) & (F.abs(like) > 1e-6), F.lit(False))
    per_1000 = lambda s: ratio(F.coalesce(f"{s}_compactions", F.lit(0.0)), F.col(f"{s}_requests") / 1000)
    compaction = pct_change(per_1000("base"), per_1000("comp"))
    compactions = F.coalesce("base_compactions", F.lit(0.0)) + F.coalesce("comp_compactions", F.lit(0.0))
    per_request = lambda s: ratio(f"{s}_tool_bytes", f"{s}_requests")
    tool_bytes = pct_change(per_request("base"), per_request("comp"))
    has_tools = (per_request("base") > 0) & (per_request("comp") > 0)

    def rule(code: str, applies: Column, status: Column | str, value: Column, before: Column, after: Column) -> Column:
        status = F.lit(status) if isinstance(status, str) else status
        return F.when(applies, F.struct(
            F.lit(code).alias("finding"), status.alias("status"), value.cast("double").alias("value"),
            before.cast("double").alias("baseline"), after.cast("double").alias("compare"),
        ))

    pair = lambda name: (F.col(f"base_{name}"), F.col(f"comp_{name}"))
    rules = F.array(
        rule("low-overlap", _not_comparable(), "warn", F.col("overlap_pct"), F.lit(None), F.lit(None)),
        rule("cost", cost.isNotNull(), moved(cost), cost, *pair("cost_per_request")),
        rule("mix-or-efficiency", mix_part.isNotNull(),
             F.when(F.abs(mix_part) >= 2, "warn").otherwise("good"), mix_part,
             F.col("baseline_weighted"), F.col("adjusted_weighted")),
        rule("context", context.isNotNull(), moved(context), context, *pair("context_per_request")),
        rule("output", F.abs(output) >= 3,
             F.when(contradicts, "warn").when(output < 0, "good").otherwise("warn"), output, *pair("output_per_request")),
        rule("cache-hit-rate", F.abs(cache) >= 0.5, F.when(cache > 0, "good").otherwise("warn"), cache,
             *pair("cache_hit_rate")),
        rule("compactions", (compactions >= 5) & (F.abs(compaction) >= 15),
             F.when(compaction < 0, "good").otherwise("warn"), compaction, per_1000("base"), per_1000("comp")),
        rule("tool-output", has_tools & (F.abs(tool_bytes) >= 10),
             F.when(tool_bytes < 0, "good").otherwise("warn"), tool_bytes, per_request("base"), per_request("comp")),
        rule("failures-up", _failure("up"), "bad", (F.col("failure_rate_2") - F.col("failure_rate_1")) * 100,
             F.col("failure_rate_1"), F.col("failure_rate_2")),
        rule("failures-down", _failure("down"), "good", (F.col("failure_rate_2") - F.col("failure_rate_1")) * 100,
             F.col("failure_rate_1"), F.col("failure_rate_2")),
    )
    from_facts = facts.select(F.inline(F.filter(rules, lambda r: r.isNotNull()))).select(
        "finding", F.lit("").alias("subject"), "status", "value", "baseline", "compare"
    )
    dearer = pct_change("base_cost_per_request", "comp_cost_per_request")
    regressions = models.filter(
        (F.col("base_requests") >= 30) & (F.col("comp_requests") >= 30) & (dearer > 10)
    ).select(
        F.lit("model-regression").alias("finding"), F.col(model).alias("subject"), F.lit("warn").alias("status"),
        dearer.alias("value"), F.col("base_cost_per_request").alias("baseline"), F.col("comp_cost_per_request").alias("compare"),
    )
    return from_facts.unionByName(regressions)


def kpi_status(pct: Column, lower_is_better: Column) -> Column:
    improved = F.when(lower_is_better, pct < 0).otherwise(pct > 0)
    return F.when(pct.isNull() | (F.abs(pct) < 2), "neutral").when(improved, "good").otherwise("bad")


def kpis(facts: DataFrame) -> DataFrame:
    """Six KPIs: baseline, compare, percent change, direction and status.

    An output per request that fell only because work moved to another model is a warning, not a gain.
    """
    def entry(name: str, before: Column, after: Column, lower: bool) -> Column:
        return F.struct(F.lit(name).alias("kpi"), before.cast("double").alias("baseline"),
                        after.cast("double").alias("compare"), F.lit(lower).alias("lower_is_better"))

    pair = lambda name: (F.col(f"base_{name}"), F.col(f"comp_{name}"))
    rows = F.array(
        entry("cost_per_request", *pair("cost_per_request"), True),
        entry("context_per_request", *pair("context_per_request"), True),
        entry("output_per_request", *pair("output_per_request"), True),
        entry("cache_hit_rate", F.col("base_cache_hit_rate") * 100, F.col("comp_cache_hit_rate") * 100, False),
        entry("tool_failure_rate", F.col("failure_rate_1") * 100, F.col("failure_rate_2") * 100, True),
        entry("tokens_per_request", *pair("tokens_per_request"), True),
    )
    listed = facts.select("output_length", F.inline(rows)).withColumn("pct_change", pct_change("baseline", "compare"))
    artefact = (F.col("kpi") == "output_per_request") & (F.col("output_length") > 1e-6) & (F.col("pct_change") < 0)
    return listed.select(
        "kpi", "baseline", "compare", "pct_change", "lower_is_better",
        F.when(artefact, "warn").otherwise(kpi_status(F.col("pct_change"), F.col("lower_is_better"))).alias("status"),
    )


def quality_guardrail(facts: DataFrame, tool_comparison: DataFrame, tool: str = "tool") -> DataFrame:
    """Rows when tool failures rose significantly: the overall rates, then every tool that got worse.

    Severity is 'cheaper-but-worse' when the cost per request fell at the same time, else 'worse'.
    """
    severity = F.when(_delta("cost_per_request") < 0, "cheaper-but-worse").otherwise("worse")
    overall = facts.filter(_failure("up")).select(
        severity.alias("severity"), F.lit("(all tools)").alias("subject"),
        F.col("failure_rate_1").alias("baseline_rate"), F.col("failure_rate_2").alias("compare_rate"),
    )
    active = overall.agg(F.max("severity")).scalar()
    worst = tool_comparison.filter("regressed").select(
        active.alias("severity"), F.col(tool).alias("subject"),
        F.col("rate_1").alias("baseline_rate"), F.col("rate_2").alias("compare_rate"),
    ).filter(F.col("severity").isNotNull())
    return overall.unionByName(worst)


def verdict(facts: DataFrame) -> DataFrame:
    """Direction of the headline, downgraded when failures rose or the work differs."""
    cost = _delta("cost_per_request")
    raw = F.when(cost.isNull() | (F.abs(cost) < 2), "neutral").when(cost < 0, "good").otherwise("bad")
    caveat = _failure("up") | _not_comparable()
    return facts.select(
        cost.alias("cost_change_pct"),
        F.when((raw == "good") & F.coalesce(caveat, F.lit(False)), "warn").otherwise(raw).alias("direction"),
        F.when(cost.isNull(), "not-enough-data")
        .when(cost < -2, F.when(F.coalesce(_failure("up"), F.lit(False)), "cheaper-not-better")
              .when(_not_comparable(), "cheaper-different-work").otherwise("cheaper"))
        .when(cost > 2, "dearer").otherwise("unchanged").alias("answer"),
    )


def significance_class(comparison: DataFrame) -> DataFrame:
    """`compare_distributions` rows with a significance class and, where real, its strength."""
    r = F.abs("rank_biserial")
    return comparison.select(
        "metric", "base_n", "comp_n", "p_value", "rank_biserial",
        F.when(F.col("skipped"), "not-enough-data").when(F.col("p_value") < 0.05, "real-change")
        .otherwise("normal-variation").alias("significance"),
        F.when(~F.col("skipped") & (F.col("p_value") < 0.05),
               F.when(r >= 0.5, "large").when(r >= 0.3, "moderate").otherwise("small")).alias("strength"),
        F.when(~F.col("skipped") & (F.col("p_value") < 0.05), "good").otherwise("warn").alias("status"),
    )


def percentile_shift(comparison: DataFrame) -> DataFrame:
    """Which part of the distribution moved down by more than two per cent."""
    typical = F.coalesce(F.col("p50_pct_change") < -2, F.lit(False))
    tail = F.coalesce(F.col("p95_pct_change") < -2, F.lit(False))
    return comparison.select(
        "metric", "p50_pct_change", "p95_pct_change",
        F.when(typical & tail, "both").when(typical, "typical-only").when(tail, "tail-only").otherwise("none").alias("shift"),
    )


def mix_warning(distance: DataFrame, points: float = 15.0) -> DataFrame:
    return distance.select("tvd_points", F.when(F.col("tvd_points") >= points, "mix-moved").otherwise("comparable").alias("mix_status"))


def standing(profile: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Where a window stands, as `(metric, value)` rows."""
    metrics = {
        "spend": "cost", "cost_per_request": "cost_per_request", "context_per_request": "context_per_request",
        "output_per_request": "output_per_request", "cache_hit_rate_pct": F.col("cache_hit_rate") * 100,
        "requests": "requests",
    }
    rows = F.array(*[
        F.struct(F.lit(name).alias("metric"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("value"))
        for name, c in metrics.items()
    ])
    return profile.select(*(by or []), F.inline(rows))


def scoreboard(parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Dashboard totals: `{metric: (one-row table, column)}` as rows; absent sources are simply not passed."""
    rows = [df.select(F.lit(name).alias("metric"), F.col(c).cast("double").alias("value")) for name, (df, c) in parts.items()]
    return reduce(DataFrame.unionByName, rows).filter(F.col("value").isNotNull())
