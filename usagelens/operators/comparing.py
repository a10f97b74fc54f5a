"""Baseline against compare window: profiles, model mix, cost decomposition, workload and failures.

Inputs are small totals with a `side` column (`baseline` / `compare`). Two sides meet by conditional
aggregation, so a key present on one side only stays in the result and no join of the sides is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import pct, pct_change, ratio
from ..functions.stats import two_proportion_test
from ..functions.tokens import TOKENS, TokenColumns, cache_hit_rate, context_tokens
from .pricing import RATES, RateCard, class_rates, cost_totals
from .requests import token_sums
from .significance import sided

COMPARABLE_PCT = 60.0
MIN_AGENT_REQUESTS = 20


def per_request_profile(
    priced: DataFrame, by: Sequence[str] = ("side",), tokens: TokenColumns = TOKENS
) -> DataFrame:
    """Cost, tokens, context, output and each class per request, and the cache hit rate."""
    by = list(by)
    costs = cost_totals(priced, by).drop("requests", "unpriced_models")
    sums = priced.groupBy(*by).agg(F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"), *token_sums(tokens))
    joined = sums.join(costs, by) if by else priced.agg(
        F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"), *token_sums(tokens),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.coalesce(F.sum(F.when(~F.col("priced"), F.col("requests"))), F.lit(0)).alias("unpriced_requests"),
        F.max("ttl_mode").alias("ttl_mode"),
    )
    n = F.col("requests")
    return joined.select(
        *by, "requests", "cost", "unpriced_requests", "ttl_mode",
        ratio("cost", n).alias("cost_per_request"),
        ratio("total_tokens", n).alias("tokens_per_request"),
        ratio(context_tokens(tokens), n).alias("context_per_request"),
        ratio(tokens.output, n).alias("output_per_request"),
        cache_hit_rate(tokens).alias("cache_hit_rate"),
        ratio(tokens.input, n).alias("input_per_request"),
        ratio(tokens.cache_write, n).alias("cache_write_per_request"),
        ratio(tokens.cache_read, n).alias("cache_read_per_request"),
    )


def models_by_side(priced: DataFrame, model: str = "model", side: str = "side",
                   tokens: TokenColumns = TOKENS) -> DataFrame:
    """One row per model with `base_*` and `comp_*` totals, costs and rates; absent sides are null."""
    columns = ["requests", *tokens.all, "total_tokens", "cost", "cost_per_request",
               "input_rate", "output_rate", "cache_read_multiplier"]
    both = sided(priced, columns, [model], side)
    mode = priced.agg(F.max("ttl_mode")).scalar()
    return both.withColumn("ttl_mode", mode)


def _total(df: DataFrame, column: str) -> Column:
    return df.agg(F.sum(column)).scalar()


def model_mix_shift(models: DataFrame, model: str = "model") -> DataFrame:
    """Share of requests per model on each side and the shift in points; an absent side counts as 0.

    Empty when a side has no requests at all.
    """
    shares = models.select(
        model,
        F.coalesce(ratio("base_requests", _total(models, "base_requests")), F.lit(0.0)).alias("baseline_share"),
        F.coalesce(ratio("comp_requests", _total(models, "comp_requests")), F.lit(0.0)).alias("compare_share"),
        (F.coalesce(_total(models, "base_requests"), F.lit(0)) > 0).alias("_b"),
        (F.coalesce(_total(models, "comp_requests"), F.lit(0)) > 0).alias("_c"),
    )
    return shares.filter(F.col("_b") & F.col("_c")).select(
        model, "baseline_share", "compare_share",
        ((F.col("compare_share") - F.col("baseline_share")) * 100).alias("delta_points"),
    )


def mix_distance(mix: DataFrame) -> DataFrame:
    """Total variation distance of the two model mixes, in points."""
    return mix.agg((F.sum(F.abs(F.col("compare_share") - F.col("baseline_share"))) / 2 * 100).alias("tvd_points"))


def mix_adjusted_cost(models: DataFrame) -> DataFrame:
    """Cost per request at the baseline's model split, with each side's own rates.

    Models without a compare side keep their baseline cost, models without a baseline cost are left out.
    """
    weighted = models.filter(F.col("base_cost_per_request").isNotNull()).withColumn(
        "_share", ratio("base_requests", _total(models, "base_requests"))
    )
    return weighted.agg(
        F.sum(F.col("_share") * F.col("base_cost_per_request")).alias("baseline_weighted"),
        F.sum(F.col("_share") * F.coalesce("comp_cost_per_request", "base_cost_per_request")).alias("adjusted_weighted"),
    )


def decompose_cost_change(models: DataFrame, tokens: TokenColumns = TOKENS, card: RateCard = RATES) -> DataFrame:
    """Shift-share decomposition of the change in cost per request, one row.

    Efficiency is summed by token class over models seen on both sides: baseline share x change in tokens
    per request x that model's own rate. The rest of the change is mix and interaction. Both come from one
    rate source, so the steps add up to the change.
    """
    m = models.withColumns({
        "input_rate": F.coalesce("base_input_rate", "comp_input_rate"),
        "output_rate": F.coalesce("base_output_rate", "comp_output_rate"),
        "cache_read_multiplier": F.coalesce("base_cache_read_multiplier", "comp_cache_read_multiplier"),
    })
    rates = class_rates(card)
    share = ratio("base_requests", _total(models, "base_requests"))
    both = (F.coalesce("base_requests", F.lit(0)) > 0) & (F.coalesce("comp_requests", F.lit(0)) > 0)
    exact = F.col("ttl_mode") == "exact"

    def term(column: str, rate: Column) -> Column:
        before = ratio(F.coalesce(f"base_{column}", F.lit(0)), "base_requests")
        after = ratio(F.coalesce(f"comp_{column}", F.lit(0)), "comp_requests")
        return F.when(both, share * (after - before) * rate)

    write_split = term(tokens.cache_write_5m, rates["cache_write_5m"]) + term(tokens.cache_write_1h, rates["cache_write_1h"])
    terms = m.select(
        term(tokens.cache_read, rates["cache_read"]).alias("_read"),
        F.when(exact, write_split).otherwise(term(tokens.cache_write, rates["cache_write"])).alias("_write"),
        term(tokens.input, rates["input"]).alias("_input"),
        term(tokens.output, rates["output"]).alias("_output"),
        "base_requests", "comp_requests", "base_cost", "comp_cost",
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    sums = terms.agg(
        zero("_read").alias("context_reread"),
        (zero("_write") + zero("_input")).alias("fresh_context"),
        zero("_output").alias("output_length"),
        ratio(F.sum("base_cost"), F.sum("base_requests")).alias("start"),
        ratio(F.sum("comp_cost"), F.sum("comp_requests")).alias("end"),
    )
    efficiency = F.col("context_reread") + F.col("fresh_context") + F.col("output_length")
    change = F.col("end") - F.col("start")
    return sums.filter(F.col("start").isNotNull() & F.col("end").isNotNull()).select(
        "start", "end", change.alias("change"), "context_reread", "fresh_context", "output_length",
        efficiency.alias("efficiency"), (change - efficiency).alias("model_mix"),
    )


DECOMPOSITION_STEPS = ("context_reread", "fresh_context", "output_length", "model_mix")


def waterfall(decomposition: DataFrame) -> DataFrame:
    """The four steps as rows with the running level before and after each, from start to end."""
    pairs = ", ".join(f"{i}, '{name}', {name}" for i, name in enumerate(DECOMPOSITION_STEPS, 1))
    steps = decomposition.selectExpr(
        "start", "end", "change", f"stack({len(DECOMPOSITION_STEPS)}, {pairs}) as (step_no, step, value)"
    )
    running = Window.orderBy("step_no").rowsBetween(Window.unboundedPreceding, 0)  # four rows
    after = F.col("start") + F.sum("value").over(running)
    share = F.try_divide(F.col("value"), F.col("change")) * 100
    status = (
        F.when(F.abs("value") < F.abs("change") * 0.02, "neutral").when(F.col("value") < 0, "good").otherwise("bad")
    )
    return steps.select(
        "step_no", "step", "value", (after - F.col("value")).alias("level_from"), after.alias("level_to"),
        share.alias("share_of_change"), status.alias("status"),
    )


def workload_overlap(agents: DataFrame, comparable_pct: float = COMPARABLE_PCT) -> DataFrame:
    """How much of the new work is of a type the baseline had; no row without new requests.

    `agents` has one row per agent type with `base_requests` and `comp_requests` (null when absent).
    """
    in_base, in_comp = F.col("base_requests").isNotNull(), F.col("comp_requests").isNotNull()
    counted = agents.agg(
        F.count_if(in_base).alias("base_types"),
        F.count_if(in_comp).alias("comp_types"),
        F.count_if(in_base & in_comp).alias("shared_types"),
        F.coalesce(F.sum("comp_requests"), F.lit(0)).alias("comp_requests"),
        F.coalesce(F.sum(F.when(in_base, F.col("comp_requests"))), F.lit(0)).alias("shared_requests"),
    )
    overlap = pct("shared_requests", "comp_requests")
    return counted.filter(F.col("comp_requests") > 0).withColumn("overlap_pct", overlap).withColumn(
        "comparable", F.col("overlap_pct") >= comparable_pct
    )


def agent_type_comparison(agents: DataFrame, agent_type: str = "agent_type",
                          min_requests: int = MIN_AGENT_REQUESTS, tokens: TokenColumns = TOKENS) -> DataFrame:
    """Tokens and output per request before and after, for types on both sides with enough new requests."""
    kept = agents.filter((F.col("base_requests") > 0) & (F.col("comp_requests") >= min_requests))
    base, comp = ratio("base_total_tokens", "base_requests"), ratio("comp_total_tokens", "comp_requests")
    return kept.select(
        agent_type, "base_requests", "comp_requests",
        base.alias("base_tokens_per_request"), comp.alias("comp_tokens_per_request"),
        pct_change(base, comp).alias("pct_change"),
        ratio(f"base_{tokens.output}", "base_requests").alias("base_output_per_request"),
        ratio(f"comp_{tokens.output}", "comp_requests").alias("comp_output_per_request"),
    )


def agents_by_side(agent_totals: DataFrame, agent_type: str = "agent_type", side: str = "side",
                   tokens: TokenColumns = TOKENS) -> DataFrame:
    return sided(agent_totals, ["requests", "total_tokens", tokens.output], [agent_type], side)


def tool_failure_comparison(tools: DataFrame, tool: str = "tool", side: str = "side", min_count: int = 30) -> DataFrame:
    """Two-proportion test of the error rate for each tool on both sides.

    `regressed` marks significant rises; order by it, then by new calls, for the report.
    """
    both = sided(tools, ["calls", "errors", "total_bytes"], [tool], side)
    both = both.filter(F.col("base_calls").isNotNull() & F.col("comp_calls").isNotNull())
    return with_test(both.select(tool, "base_errors", "base_calls", "comp_errors", "comp_calls"), min_count)


def overall_failure_rate(tools: DataFrame, side: str = "side", min_count: int = 30) -> DataFrame:
    """The same test over the calls of all tools, one row."""
    pick = lambda s, c: F.coalesce(F.sum(F.when(F.col(side) == s, F.col(c))), F.lit(0))
    sums = tools.agg(
        pick("baseline", "errors").alias("base_errors"), pick("baseline", "calls").alias("base_calls"),
        pick("compare", "errors").alias("comp_errors"), pick("compare", "calls").alias("comp_calls"),
    )
    return with_test(sums, min_count)


def with_test(df: DataFrame, min_count: int) -> DataFrame:
    test = two_proportion_test("base_errors", "base_calls", "comp_errors", "comp_calls", min_count)
    regressed = F.coalesce(test["significant"] & (test["direction"] == "up"), F.lit(False))
    return df.select("*", *[c.alias(name) for name, c in test.items()], regressed.alias("regressed"))


def model_cost_comparison(models: DataFrame, model: str = "model") -> DataFrame:
    """Cost per request of every model before and after with a status, absent sides null."""
    change = F.when(F.col("base_cost_per_request") != 0, F.try_divide(
        F.col("comp_cost_per_request") - F.col("base_cost_per_request"), F.col("base_cost_per_request")) * 100)
    return models.select(
        model, "base_requests", "comp_requests", "base_cost_per_request", "comp_cost_per_request",
        change.alias("pct_change"),
        F.when(change.isNull() | (F.abs(change) < 2), "neutral").when(change < 0, "good").otherwise("bad").alias("status"),
    )
