"""Baseline and compare reports as sets of tidy tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import TOKENS, TokenColumns, total_tokens
from ..operators import comparing, distribution, findings, merging, pricing, requests, significance, tools
from ..operators.ranks import value_counts
from ..session import cut_lineage
from ..sources import reports, sidecars


def usage_tables(
    rows: DataFrame,
    tool_payload: DataFrame | None = None,
    compactions: DataFrame | None = None,
    attachments: DataFrame | None = None,
    tokens: TokenColumns = TOKENS,
    resamples: int = distribution.RESAMPLES,
    sample_size: int = distribution.SAMPLE_SIZE,
    prices: DataFrame | None = None,
    lines: DataFrame | None = None,
    definitions: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The tables of one window of deduplicated requests.

    With `prices` also what they cost, the profile of a request and where the window stands; with the parsed `lines`
    the counters of the scan; with workflow `definitions` these and their totals.

    The deduplicated rows and the metric values are written once: every table below reads one of them, and
    none of them repeats the deduplication shuffle. `counts` holds every distinct value of a distribution with
    its number: merges and tests of saved reports are exact by it; `samples` is the compact alternative. The attachment table is kept whole; top lists are cut
    when they are shown, so merges stay exact.
    """
    rows = cut_lineage(rows, "requests")
    metrics = cut_lineage(requests.request_metrics(rows, tokens=tokens), "metrics")
    cube, counted = cut_lineage(requests.usage_cube(rows, tokens=tokens), "cube"), F.col("requests")
    counts = cut_lineage(value_counts(metrics, "value", ["metric"]), "counts")
    summary = distribution.summarize_counts(counts, "value", ["metric"])
    samples = distribution.hashed_sample(metrics, ["row_key"], sample_size, ["metric"])
    tables = {
        "totals": requests.request_totals(cube, tokens=tokens, requests=counted),
        "models": requests.totals_by_key(cube, "model", "model", tokens=tokens, requests=counted),
        "agents": requests.totals_by_agent_type(cube, tokens=tokens, requests=counted),
        "tiers": requests.totals_by_tier(cube, tokens=tokens, requests=counted),
        "distributions": summary.withColumn("sampled", F.col("n") > sample_size),
        "intervals": distribution.bootstrap_of_counts(counts, by=["metric"], resamples=resamples),
        "counts": counts,
        "samples": samples,
    }
    if tool_payload is not None:
        tables["tool_payload"] = tool_payload
    if compactions is not None:
        tables["compactions"] = tools.compaction_summary(compactions)
    if attachments is not None:
        by_kind = attachments.groupBy("attachment", F.coalesce("key", F.lit("unknown")).alias("key")).agg(
            F.count(F.lit(1)).alias("count"), F.sum("bytes").alias("total_bytes")
        )
        tables["attachments"] = by_kind
    tables["shares"] = merging.merge_totals(cube, tokens=tokens)
    if prices is not None:
        tables |= _priced(cut_lineage(tables["models"], "models"), prices, [], tokens)
    if lines is not None:
        tables["scan"] = requests.scan_quality(lines)
    if definitions is not None:
        tables |= {"definitions": definitions, "workflows": sidecars.workflow_totals(definitions)}
    return tables


def _priced(models: DataFrame, prices: DataFrame, by: list[str], tokens: TokenColumns = TOKENS) -> dict[str, DataFrame]:
    """What model totals cost, the profile of a request, and where the window stands; all derived, so a merge derives them again."""
    # whether the split of cache writes is exact is decided for all reports of the totals together
    priced = pricing.price_models(models, prices, tokens=tokens)
    profile = comparing.per_request_profile(priced, by, tokens)
    return {"priced": priced, "cost": pricing.cost_totals(priced, by), "profile": profile, "standing": findings.standing(profile, by or None)}


def split_windows(rows: DataFrame, cut: Column, ts: str = "ts", side: str = "side") -> DataFrame:
    """Dated rows labelled `baseline` up to the cut and `compare` after it.

    Before deduplication: an id with snapshots on both sides counts in both windows.
    """
    return rows.filter(F.col(ts).isNotNull()).withColumn(
        side, F.when(F.col(ts) > cut, significance.COMPARE).otherwise(significance.BASELINE)
    )


def compare_tables(
    sided_rows: DataFrame,
    prices: DataFrame,
    tool_payload: DataFrame,
    compactions: DataFrame,
    tokens: TokenColumns = TOKENS,
    min_n: int = significance.MIN_N,
) -> dict[str, DataFrame]:
    """Everything a comparison reports, from requests deduplicated per side.

    `tool_payload(side, tool, calls, errors, total_bytes)` and `compactions(side, compactions)` are totals.
    The rows are written once and read for the totals and for the distributions; all the rest works on totals.
    """
    sided_rows = cut_lineage(sided_rows, "requests")
    cube, counted = cut_lineage(requests.usage_cube(sided_rows, ["side"], tokens=tokens), "cube"), F.col("requests")
    model_totals = requests.totals_by_key(cube, "model", "model", ["side"], tokens, counted)
    agent_totals = requests.totals_by_agent_type(cube, by=["side"], tokens=tokens, requests=counted)
    metrics = requests.request_metrics(sided_rows, ["side"], tokens=tokens)
    distributions = significance.compare_distributions(metrics, "value", "side", ["metric"], min_n)
    return {**compare_totals(model_totals, agent_totals, prices, tool_payload, compactions, tokens),
            "distributions": distributions,
            "significance": findings.significance_class(distributions),
            "percentile_shift": findings.percentile_shift(distributions)}


def compare_totals(
    model_totals: DataFrame,
    agent_totals: DataFrame,
    prices: DataFrame,
    tool_payload: DataFrame,
    compactions: DataFrame,
    tokens: TokenColumns = TOKENS,
) -> dict[str, DataFrame]:
    """The part of a comparison that only needs totals with a `side`: saved reports are enough.

    The totals are written once, because every table below reads them: the raw rows behind them must not be
    read again for each.
    """
    model_totals, agent_totals = cut_lineage(model_totals, "model-totals"), cut_lineage(agent_totals, "agent-totals")
    tool_payload, compactions = cut_lineage(tool_payload, "tool-payload"), cut_lineage(compactions, "compactions")
    priced = pricing.price_models(model_totals, prices, tokens=tokens)
    models = comparing.models_by_side(priced, tokens=tokens)
    agents = comparing.agents_by_side(agent_totals, tokens=tokens)
    tool_rows = comparing.tool_failure_comparison(tool_payload)
    facts = findings.comparison_facts(priced, models, agents, tool_payload, compactions)
    decomposition = comparing.decompose_cost_change(models, tokens)
    mix = comparing.model_mix_shift(models)
    return {
        "profile": comparing.per_request_profile(priced, ["side"], tokens),
        "models": comparing.model_cost_comparison(models),
        "mix": mix,
        "mix_status": findings.mix_warning(comparing.mix_distance(mix)),
        "decomposition": decomposition,
        "waterfall": comparing.waterfall(decomposition),
        "overlap": comparing.workload_overlap(agents),
        "agents": comparing.agent_type_comparison(agents, tokens=tokens),
        "tools": tool_rows,
        "findings": findings.findings(facts, models),
        "kpis": findings.kpis(facts),
        "guardrail": findings.quality_guardrail(facts, tool_rows),
        "verdict": findings.verdict(facts),
    }


def merge_usage_tables(tables: dict[str, DataFrame], by: Sequence[str] = (), prices: DataFrame | None = None) -> dict[str, DataFrame]:
    """Saved tables of several reports (with `report_id`) merged into one window, or one per `by` group.

    Counters are summed, shares and averages derived again, with `prices` also cost, profile and standing; workflow
    definitions are listed together, equal ones once. Distributions are exact where the reports hold
    their counts, with intervals; without them they are merged by weighted sample.
    """
    by = list(by)
    merged = {
        "models": merging.merge_keyed_totals(tables["models"], "model", by),
        "agents": merging.merge_keyed_totals(tables["agents"], "agent_type", by),
    }
    if "totals" in tables:
        merged["totals"] = merging.merge_totals(tables["totals"], by)
    if "tiers" in tables:
        merged["tiers"] = merging.merge_keyed_totals(tables["tiers"], "tier", by)
    if "attachments" in tables:
        merged["attachments"] = merging.merge_counters(tables["attachments"], ["count", "total_bytes"], [*by, "attachment", "key"])
    if "counts" in tables:
        merged["counts"] = cut_lineage(merging.merge_counters(tables["counts"], ["n"], [*by, "metric", "value"]), "merged-counts")
        merged["distributions"] = distribution.summarize_counts(merged["counts"], "value", [*by, "metric"])
        merged["intervals"] = distribution.bootstrap_of_counts(merged["counts"], "value", [*by, "metric"])
    elif "distributions" in tables:
        merged["distributions"] = distribution.merge_summaries(
            tables["distributions"], tables["samples"], ["row_key"], "report_id", [*by, "metric"]
        )
    if "compactions" in tables:
        merged["compactions"] = merging.merge_compactions(tables["compactions"], by)
    if "tool_payload" in tables:
        merged["tool_payload"] = merging.merge_tool_payload(tables["tool_payload"], by=by)
    if "totals" in tables:
        merged["shares"] = merged["totals"]
    if prices is not None:
        merged |= _priced(cut_lineage(merged["models"], "merged-models"), prices, by)
    if "scan" in tables:
        counters = [c for c, kind in tables["scan"].dtypes if kind == "bigint" and c not in (*by, "report_id")]
        merged["scan"] = merging.merge_counters(tables["scan"], counters, by)
    if "definitions" in tables:
        merged["definitions"] = tables["definitions"].drop("report_id").distinct()
        merged["workflows"] = sidecars.workflow_totals(merged["definitions"])
    return merged


def merge_and_compare(tables: dict[str, DataFrame], prices: DataFrame) -> dict[str, DataFrame]:
    """Saved reports of both modes (`side` column from their mode) merged per side and compared.

    The distributions of both sides are tested where the reports hold their counts.
    """
    merged = merge_usage_tables({k: v for k, v in tables.items() if k not in ("distributions", "samples")}, ["side"])
    compared = compare_totals(merged["models"], merged["agents"], prices, merged["tool_payload"], merged["compactions"])
    if "counts" in merged:
        compared |= _tested(merged["counts"])
    return compared


def _tested(counts: DataFrame, min_n: int = significance.MIN_N) -> dict[str, DataFrame]:
    distributions = cut_lineage(significance.compare_counts(counts, min_n=min_n), "distributions")
    return {"distributions": distributions, "significance": findings.significance_class(distributions),
            "percentile_shift": findings.percentile_shift(distributions)}


def compare_with_baseline(
    spark: SparkSession,
    root: str,
    rows: DataFrame,
    prices: DataFrame,
    tool_payload: DataFrame,
    compactions: DataFrame,
    tokens: TokenColumns = TOKENS,
    order: Sequence[str] = ("file_path", "line_no"),
) -> dict[str, DataFrame]:
    """The window after the latest saved baseline, compared with that baseline's stored tables.

    `rows` are request rows of any time; those after the baseline was made are deduplicated and totalled.
    `tool_payload` and `compactions` are the window's own totals, without a side. Nothing older than the window is read
    again: the rank test of the distributions runs on stored counts.
    """
    baseline = reports.latest_baseline(spark, root)
    made = reports.load_table(spark, root, "reports", [baseline]).select(F.col("generated_at").cast("timestamp_ntz")).first()[0]
    window = rows.filter(F.col("ts") > F.lit(made))
    window = cut_lineage(requests.keep_largest(window, ["message_id"], total_tokens(tokens), order), "window")
    cube, counted = cut_lineage(requests.usage_cube(window, tokens=tokens), "cube"), F.col("requests")
    now = {
        "models": requests.totals_by_key(cube, "model", "model", tokens=tokens, requests=counted),
        "agents": requests.totals_by_agent_type(cube, tokens=tokens, requests=counted),
        "counts": value_counts(requests.request_metrics(window, tokens=tokens), "value", ["metric"]),
        "tool_payload": tool_payload,
        "compactions": compactions,
    }

    def both(name: str) -> DataFrame:
        stored = reports.load_table(spark, root, name, [baseline]).drop("report_id")
        sides = (stored.withColumn("side", F.lit(significance.BASELINE)), now[name].withColumn("side", F.lit(significance.COMPARE)))
        return sides[0].unionByName(sides[1], allowMissingColumns=True)

    compared = compare_totals(both("models"), both("agents"), prices, both("tool_payload"), both("compactions"), tokens)
    return compared | _tested(both("counts"))


def dedup_per_side(rows: DataFrame, order: Sequence[str] = ("file_path", "line_no"), tokens: TokenColumns = TOKENS) -> DataFrame:
    return requests.keep_largest(rows, ["side", "message_id"], total_tokens(tokens), order)
