"""Pricing of token bundles from a rate table supplied by the caller."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..functions.tokens import TOKENS, TokenColumns, has_ttl_split, normalize_model


@dataclass(frozen=True)
class RateCard:
    """Multipliers of the model's input rate, and the price of models missing from the table.

    Rates are per million tokens. Unmapped models take the fallback price, so a gap shows up as spend
    and can be disclosed instead of vanishing.
    """

    cache_write_5m: float = 1.25
    cache_write_1h: float = 2.0
    cache_write_flat: float = 1.25
    cache_read: float = 0.1
    fallback_input: float = 5.0
    fallback_output: float = 25.0


RATES = RateCard()


def with_prices(df: DataFrame, prices: DataFrame, model: str = "model", card: RateCard = RATES) -> DataFrame:
    """Add `input_rate`, `output_rate`, `cache_read_multiplier` and `priced`.

    `prices(model, input_rate, output_rate, cache_read_multiplier)` has one row per normalised model id.
    No broadcast hint: Catalyst broadcasts the table when its measured size is below the threshold. Use it
    on totals per model where possible, so a model holding a third of all rows crosses as one row.
    """
    rates = prices.select(
        F.col("model").alias("_price_key"),
        F.col("input_rate").alias("_in"),
        F.col("output_rate").alias("_out"),
        F.col("cache_read_multiplier").alias("_read"),
    )
    joined = df.withColumn("_key", normalize_model(model)).join(rates, F.col("_key") == F.col("_price_key"), "left")
    return joined.select(
        *df.columns,
        F.coalesce("_in", F.lit(card.fallback_input)).alias("input_rate"),
        F.coalesce("_out", F.lit(card.fallback_output)).alias("output_rate"),
        F.coalesce("_read", F.lit(card.cache_read)).alias("cache_read_multiplier"),
        F.col("_price_key").isNotNull().alias("priced"),
    )


def class_rates(card: RateCard = RATES) -> dict[str, Column]:
    """Price of one token of each class, for rows that went through `with_prices`."""
    per_token = F.col("input_rate") / 1e6
    return {
        "input": per_token,
        "output": F.col("output_rate") / 1e6,
        "cache_write": per_token * card.cache_write_flat,
        "cache_write_5m": per_token * card.cache_write_5m,
        "cache_write_1h": per_token * card.cache_write_1h,
        "cache_read": per_token * F.col("cache_read_multiplier"),
    }


def bundle_cost(exact: Column, tokens: TokenColumns = TOKENS, card: RateCard = RATES) -> Column:
    """Cost of a token bundle; cache writes by their split when `exact` and the split is present."""
    r = class_rates(card)
    split = F.col(tokens.cache_write_5m) * r["cache_write_5m"] + F.col(tokens.cache_write_1h) * r["cache_write_1h"]
    flat = F.col(tokens.cache_write) * r["cache_write"]
    return (
        F.col(tokens.input) * r["input"]
        + F.col(tokens.output) * r["output"]
        + F.when(exact & has_ttl_split(tokens), split).otherwise(flat)
        + F.col(tokens.cache_read) * r["cache_read"]
    )


def ttl_mode(model_totals: DataFrame, tokens: TokenColumns = TOKENS, side: str | None = None,
             sides: Sequence[str] = ()) -> DataFrame:
    """One row `ttl_mode`: 'exact' when every row has the split and there is a row (with `sides`: one of each).

    Pricing one side exactly and the other flat would report a change in metering as a change in cost.
    """
    exact = F.coalesce(F.bool_and(has_ttl_split(tokens)), F.lit(False))
    for name in sides:
        exact = exact & F.coalesce(F.bool_or(F.col(side) == name), F.lit(False))
    return model_totals.agg(F.when(exact, "exact").otherwise("flat").alias("ttl_mode"))


def price_models(
    model_totals: DataFrame,
    prices: DataFrame,
    model: str = "model",
    tokens: TokenColumns = TOKENS,
    card: RateCard = RATES,
    exact: bool = True,
    side: str | None = None,
    sides: Sequence[str] = (),
) -> DataFrame:
    """Cost, cost per request and tokens per request of every row of `model_totals(model, requests, ...)`.

    With `exact` the mode is still negotiated over all rows of `model_totals` (each of `sides` must have some,
    when they are named), through a scalar subquery. The totals are therefore read twice: hand in a stored
    table (`session.cut_lineage`) when there are raw rows behind them.
    """
    mode = ttl_mode(model_totals, tokens, side, sides).scalar() if exact else F.lit("flat")
    priced = with_prices(model_totals, prices, model, card).withColumn("ttl_mode", mode)
    return (
        priced.withColumn("cost", bundle_cost(F.col("ttl_mode") == "exact", tokens, card))
        .withColumn("cost_per_request", ratio("cost", "requests"))
        .withColumn("tokens_per_request", ratio("total_tokens", "requests"))
    )


def cost_totals(priced: DataFrame, by: Sequence[str] = (), model: str = "model") -> DataFrame:
    """Totals of priced rows, and how much of them rests on the fallback price."""
    unpriced = ~F.col("priced")
    return priced.groupBy(*by).agg(
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"),
        F.coalesce(F.sum(F.when(unpriced, F.col("requests"))), F.lit(0)).alias("unpriced_requests"),
        F.coalesce(F.sum(F.when(unpriced, F.col("total_tokens"))), F.lit(0)).alias("unpriced_tokens"),
        F.coalesce(F.sum(F.when(unpriced, F.col("cost"))), F.lit(0.0)).alias("unpriced_cost"),
        F.countDistinct(F.when(unpriced, F.col(model))).alias("unpriced_models"),
        F.max("ttl_mode").alias("ttl_mode"),
    )
