"""Distributions, intervals, samples, histograms and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import distribution, findings, merging, ranks, requests, significance, tools
from ..plans import usage
from ..session import shared_path
from ..sources import reports
from .core import register
from .sql_views import two_proportion
from .views import CUT, DEDUP_ORDER, Views

P = "p50, p75, p85, p95".split(", ")
SUMMARY = """count(*) AS n, coalesce(sum(value), 0)::DOUBLE AS sum, avg(value) AS mean, stddev_samp(value) AS stdev,
  quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.85) AS p85,
  quantile_cont(value, 0.95) AS p95, min(value) AS min, max(value) AS max, count(*) < 20 AS low_confidence"""
SUMMARY_DOUBLES = ["sum", "mean", "stdev", *P, "min", "max"]


@register("ag08_distribution_summary", f"SELECT metric, {SUMMARY} FROM v_metrics GROUP BY metric", ["v_metrics"], doubles=SUMMARY_DOUBLES)
def _(v: Views) -> DataFrame:
    return distribution.distribution_summary(v.metrics, "value", ["metric"])


@register("ag08_distribution_by_user", f"SELECT user_id, {SUMMARY} FROM (SELECT user_id, floor(value * 100 + 0.5) AS value FROM events) GROUP BY user_id", doubles=SUMMARY_DOUBLES)
def _(v: Views) -> DataFrame:
    return distribution.distribution_summary(v.table("events").withColumn("value", F.floor(F.col("value") * 100 + 0.5)), "value", ["user_id"])


@register("ag08_balances_with_negatives", f"SELECT {SUMMARY} FROM (SELECT c_acctbal AS value FROM customer)", doubles=SUMMARY_DOUBLES)
def _(v: Views) -> DataFrame:
    return distribution.distribution_summary(v.table("customer").select(F.col("c_acctbal").alias("value")))


_UNIFORM = "(concat('0x', substr(md5(concat({parts})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@register("ag09_bootstrap_ci_active_hours", f"""
  SELECT statistic, quantile_cont(value, 0.05) AS ci_low, quantile_cont(value, 0.95) AS ci_high, 0.9 AS level, 1500 AS resamples FROM (
    SELECT b, 'p50' AS statistic, quantile_cont(value, 0.5) AS value FROM _draws GROUP BY b
    UNION ALL SELECT b, 'p85', quantile_cont(value, 0.85) FROM _draws GROUP BY b) GROUP BY statistic""".replace("_draws", f"""(
      SELECT d.b, s.value FROM (
        SELECT b, floor({_UNIFORM.format(parts="b, ':', j, ':', 0")} * n)::BIGINT AS position
        FROM (SELECT b, j, (SELECT count(*) FROM v_metrics WHERE metric = 'tokens per active hour') AS n
              FROM range(1500) r1(b), range((SELECT count(*) FROM v_metrics WHERE metric = 'tokens per active hour')) r2(j))) d
      JOIN (SELECT row_number() OVER (ORDER BY value) - 1 AS position, value FROM v_metrics WHERE metric = 'tokens per active hour') s USING (position))"""),
          ["v_metrics"], doubles=["ci_low", "ci_high", "level"], ints=["resamples"])
def _(v: Views) -> DataFrame:
    return distribution.bootstrap_by_resampling(requests.tokens_per_active_hour(v.dedup), resamples=1500)


_METRIC = "SELECT value FROM v_metrics WHERE metric = 'tokens per request'"
_GAMMA = "CASE WHEN {a} > 0 THEN {a} * greatest({r}, 0) * greatest({r}, 0) * greatest({r}, 0) ELSE 0 END"
_ROOT = "(1 - 1 / (9 * {a}::DOUBLE) + {z} / (3 * sqrt({a}::DOUBLE)))"
_DRAW = "((concat('0x', substr(md5(concat_ws(':', b, round(p * 1000000)::BIGINT, n, 0, {i})), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


@register("ag09_bootstrap_ci_requests", f"""
  SELECT d.statistic, quantile_cont(l.value + d.fraction * (h.value - l.value), 0.05) AS ci_low,
    quantile_cont(l.value + d.fraction * (h.value - l.value), 0.95) AS ci_high, 0.9 AS level, 1500 AS resamples
  FROM (SELECT statistic, spot - floor(spot) AS fraction, least(floor(below / total * n), n - 1)::BIGINT AS lo,
          least(floor((below + step) / total * n), n - 1)::BIGINT AS hi
        FROM (SELECT *, below + step + CASE WHEN k < n THEN above ELSE -ln(u3) END AS total
              FROM (SELECT *, {_GAMMA.format(a="k", r=_ROOT.format(a="k", z="sqrt(-2 * ln(u1)) * cos(2 * pi() * u2)"))} AS below,
                      {_GAMMA.format(a="(n - k)", r=_ROOT.format(a="(n - k)", z="sqrt(-2 * ln(u1)) * sin(2 * pi() * u2)"))} AS above,
                      CASE WHEN k < n THEN -ln(u3) ELSE 0 END AS step
                    FROM (SELECT *, p * (n - 1) AS spot, floor(p * (n - 1))::BIGINT + 1 AS k, {", ".join(f"{_DRAW.format(i=i)} AS u{i}" for i in (1, 2, 3))}
                          FROM (SELECT count(*) AS n FROM ({_METRIC})), (VALUES ('p50', 0.5::DOUBLE), ('p85', 0.85::DOUBLE)) t(statistic, p), range(1500) r(b))))) d
  JOIN (SELECT row_number() OVER (ORDER BY value) - 1 AS position, value FROM ({_METRIC})) l ON l.position = d.lo
  JOIN (SELECT row_number() OVER (ORDER BY value) - 1 AS position, value FROM ({_METRIC})) h ON h.position = d.hi
  GROUP BY d.statistic""", ["v_metrics"], doubles=["ci_low", "ci_high", "level"], ints=["resamples"])
def _(v: Views) -> DataFrame:
    """All request values by order statistics: 1500 resamples whatever their number."""
    return distribution.bootstrap_by_order_statistics(requests.tokens_per_request(v.dedup))


@register("ag08_values_in_a_narrow_range", f"SELECT {SUMMARY} FROM (SELECT floor(o_totalprice) + 1e9::DOUBLE AS value FROM orders)", doubles=SUMMARY_DOUBLES)
def _(v: Views) -> DataFrame:
    """Prices far above zero: one coarse bucket, cut again by its own range."""
    return distribution.distribution_summary(v.table("orders").select((F.floor("o_totalprice") + 1e9).alias("value")))


@register("ag08_order_times", f"SELECT {SUMMARY} FROM (SELECT epoch(o_orderdate)::DOUBLE AS value FROM orders)", doubles=SUMMARY_DOUBLES)
def _(v: Views) -> DataFrame:
    """Order dates as seconds."""
    return distribution.distribution_summary(v.table("orders").select(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("value")))


@register("ag10_hashed_sample", """
  SELECT metric, row_key, value FROM (
    SELECT *, row_number() OVER (PARTITION BY metric ORDER BY md5(concat(row_key, ':', '0')), row_key) AS rn FROM v_metrics)
  WHERE rn <= 5000""", ["v_metrics"], doubles=["value"])
def _(v: Views) -> DataFrame:
    return distribution.hashed_sample(v.metrics, ["row_key"], 5000, ["metric"])


@register("ag13_clipped_histogram", """
  SELECT g.side AS series, b.bin, b.bin * x.x_max / 44 AS bin_start, coalesce(c.n, 0) AS n, coalesce(c.n, 0)::DOUBLE / g.series_n AS share,
    g.clipped, g.p50, g.p95, g.series_n
  FROM (SELECT side, count(*) AS series_n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95,
          count(*) FILTER (WHERE value > (SELECT max(p) FROM (SELECT quantile_cont(value, 0.98) AS p FROM _v GROUP BY side))) AS clipped
        FROM _v GROUP BY side) g
  CROSS JOIN range(44) b(bin)
  CROSS JOIN (SELECT max(p) AS x_max FROM (SELECT quantile_cont(value, 0.98) AS p FROM _v GROUP BY side)) x
  LEFT JOIN (SELECT side, least(43, floor(value / (x_max / 44)))::BIGINT AS bin, count(*) AS n FROM _v
             CROSS JOIN (SELECT max(p) AS x_max FROM (SELECT quantile_cont(value, 0.98) AS p FROM _v GROUP BY side))
             WHERE value <= x_max GROUP BY ALL) c ON c.side = g.side AND c.bin = b.bin""".replace(
    "_v ", "(SELECT side, value FROM v_sided_metrics WHERE metric = 'tokens per request') ").replace(
    "_v\n", "(SELECT side, value FROM v_sided_metrics WHERE metric = 'tokens per request')\n"),
          ["v_sided_metrics"], doubles=["bin_start", "share", "p50", "p95"], ints=["bin"])
def _(v: Views) -> DataFrame:
    return distribution.clipped_histogram(requests.tokens_per_request(v.sided, ["side"]), "value", "side").withColumnRenamed("side", "series")


@register("ag14_mann_whitney", "SELECT * FROM v_rank_test", ["v_rank_test"], doubles=["u1", "u2", "z", "p_value", "rank_biserial"])
def _(v: Views) -> DataFrame:
    return significance.mann_whitney(v.sided_metrics, by=["metric"])


@register("ag14_mann_whitney_small_groups", """
  SELECT user_id, n1 < 10 OR n2 < 10 AS skipped, n1, n2,
    CASE WHEN NOT (n1 < 10 OR n2 < 10) THEN rank_sum - n1::DOUBLE * (n1 + 1) / 2 END AS u1,
    CASE WHEN median_2 > median_1 THEN 'up' WHEN median_2 < median_1 THEN 'down' ELSE 'flat' END AS direction
  FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n1, count(*) FILTER (WHERE event_type = 'view') AS n2,
      sum(rk) FILTER (WHERE event_type = 'click') AS rank_sum,
      quantile_disc(value, 0.5) FILTER (WHERE event_type = 'click') AS median_1, quantile_disc(value, 0.5) FILTER (WHERE event_type = 'view') AS median_2
    FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0::DOUBLE AS rk
          FROM events WHERE event_type IN ('click', 'view')) GROUP BY user_id)""", doubles=["u1"])
def _(v: Views) -> DataFrame:
    test = significance.mann_whitney(v.table("events"), "value", "event_type", ("click", "view"), ["user_id"])
    return test.select("user_id", "skipped", "n1", "n2", "u1", "direction")


@register("wn02_average_ranks", """
  SELECT value, count(*) AS n, min(rk) + (count(*) - 1) / 2.0 AS average_rank FROM (
    SELECT total_tokens::DOUBLE AS value, rank() OVER (ORDER BY total_tokens) AS rk FROM v_requests) GROUP BY value""",
          ["v_requests"], doubles=["value", "average_rank"])
def _(v: Views) -> DataFrame:
    running = ranks.running_counts(ranks.value_counts(requests.tokens_per_request(v.requests)))
    return running.select("value", "n", (F.col("below_n") + (F.col("n") + 1) / 2).alias("average_rank"))


@register("ag15_two_proportion_by_model", f"""
  {two_proportion("_counts", "model")}""".replace("_counts", """(
    SELECT model, count(*) FILTER (WHERE side = 'baseline' AND cache_creation_tokens = 0) AS base_errors, count(*) FILTER (WHERE side = 'baseline') AS base_calls,
      count(*) FILTER (WHERE side = 'compare' AND cache_creation_tokens = 0) AS comp_errors, count(*) FILTER (WHERE side = 'compare') AS comp_calls
    FROM v_sided GROUP BY model)"""), ["v_sided"], doubles=["rate_1", "rate_2", "z", "p_value", "ci_low", "ci_high"])
def _(v: Views) -> DataFrame:
    from ..operators.comparing import with_test

    of = lambda side, c: F.count_if((F.col("side") == side) & c)
    failed = F.col("cache_creation_tokens") == 0
    counts = v.sided.groupBy("model").agg(
        of("baseline", failed).alias("base_errors"), of("baseline", F.lit(True)).alias("base_calls"),
        of("compare", failed).alias("comp_errors"), of("compare", F.lit(True)).alias("comp_calls"),
    )
    return with_test(counts, 30)


@register("ag16_wilson_interval", """
  SELECT user_id, successes, total,
    CASE WHEN total > 0 THEN greatest(0.0, (p + 3.8416 / (2 * total)) / (1 + 3.8416 / total) - half) END AS low,
    CASE WHEN total > 0 THEN least(1.0, (p + 3.8416 / (2 * total)) / (1 + 3.8416 / total) + half) END AS high
  FROM (SELECT *, 1.96 * sqrt(p * (1 - p) / total + 3.8416 / (4.0 * total * total)) / (1 + 3.8416 / total) AS half
    FROM (SELECT user_id, successes, total, successes::DOUBLE / total AS p FROM (
      SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS successes, count(*) AS total FROM events GROUP BY user_id)))""",
          doubles=["low", "high"])
def _(v: Views) -> DataFrame:
    counts = v.table("events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("successes"), F.count(F.lit(1)).alias("total")
    )
    low, high = stats.wilson_bounds("successes", "total")
    return counts.select("user_id", "successes", "total", low.alias("low"), high.alias("high"))


@register("sc01_03_normal_cdf_and_labels", """
  SELECT x, CASE WHEN x > 0 THEN 1.0 - upper ELSE upper END AS cdf_five_term,
    CASE WHEN abs(x) < 0.1 THEN 'negligible' WHEN abs(x) < 0.3 THEN 'small' WHEN abs(x) < 0.5 THEN 'medium' ELSE 'large' END AS effect
  FROM (SELECT x, 0.3989423 * exp(-x * x / 2) * t * (0.3193815 + t * (-0.3565638 + t * (1.781478 + t * (-1.821256 + t * 1.330274)))) AS upper
    FROM (SELECT x, 1.0 / (1.0 + 0.2316419 * abs(x)) AS t FROM (SELECT DISTINCT c_acctbal / 1000 AS x FROM customer)))""",
          doubles=["x", "cdf_five_term"])
def _(v: Views) -> DataFrame:
    x = v.table("customer").select((F.col("c_acctbal") / 1000).alias("x")).distinct()
    return x.select("x", stats.normal_cdf_five_term("x").alias("cdf_five_term"), stats.effect_label("x").alias("effect"))


COMPARE_SQL = """
  SELECT s.metric, s.base_n, s.comp_n, s.base_p50, s.comp_p50, s.base_p75, s.comp_p75, s.base_p85, s.comp_p85, s.base_p95, s.comp_p95,
    (comp_p50 - base_p50) / abs(base_p50) * 100 AS p50_pct_change, (comp_p75 - base_p75) / abs(base_p75) * 100 AS p75_pct_change,
    (comp_p85 - base_p85) / abs(base_p85) * 100 AS p85_pct_change, (comp_p95 - base_p95) / abs(base_p95) * 100 AS p95_pct_change,
    s.base_n < 20 OR s.comp_n < 20 AS low_confidence, t.skipped, t.u1, t.u2, t.z, t.p_value, t.rank_biserial, t.effect_size, t.direction,
    CASE WHEN s.comp_n = 0 THEN 'no-activity' WHEN t.skipped THEN 'directional' WHEN t.p_value < 0.05 THEN 'significant' ELSE 'not-significant' END AS verdict
  FROM (SELECT metric, max(n) FILTER (WHERE side = 'baseline') AS base_n, max(n) FILTER (WHERE side = 'compare') AS comp_n,
      max(p50) FILTER (WHERE side = 'baseline') AS base_p50, max(p50) FILTER (WHERE side = 'compare') AS comp_p50,
      max(p75) FILTER (WHERE side = 'baseline') AS base_p75, max(p75) FILTER (WHERE side = 'compare') AS comp_p75,
      max(p85) FILTER (WHERE side = 'baseline') AS base_p85, max(p85) FILTER (WHERE side = 'compare') AS comp_p85,
      max(p95) FILTER (WHERE side = 'baseline') AS base_p95, max(p95) FILTER (WHERE side = 'compare') AS comp_p95
    FROM v_summary_sided GROUP BY metric) s JOIN v_rank_test t USING (metric)"""
COMPARE_DOUBLES = [*[f"{s}_{p}" for s in ("base", "comp") for p in P], *[f"{p}_pct_change" for p in P], "u1", "u2", "z", "p_value", "rank_biserial"]


def _comparison(v: Views) -> DataFrame:
    return significance.compare_distributions(v.sided_metrics)


@register("ag17_compare_distributions", COMPARE_SQL, ["v_summary_sided", "v_rank_test"], doubles=COMPARE_DOUBLES)
def _(v: Views) -> DataFrame:
    return _comparison(v)


@register("rl05_significance_class", f"""
  SELECT metric, base_n, comp_n, p_value, rank_biserial,
    CASE WHEN skipped THEN 'not-enough-data' WHEN p_value < 0.05 THEN 'real-change' ELSE 'normal-variation' END AS significance,
    CASE WHEN NOT skipped AND p_value < 0.05 THEN CASE WHEN abs(rank_biserial) >= 0.5 THEN 'large' WHEN abs(rank_biserial) >= 0.3 THEN 'moderate' ELSE 'small' END END AS strength,
    CASE WHEN NOT skipped AND p_value < 0.05 THEN 'good' ELSE 'warn' END AS status FROM ({COMPARE_SQL})""",
          ["v_summary_sided", "v_rank_test"], doubles=["p_value", "rank_biserial"])
def _(v: Views) -> DataFrame:
    return findings.significance_class(_comparison(v))


@register("rl06_percentile_shift", f"""
  SELECT metric, p50_pct_change, p95_pct_change, CASE WHEN p50_pct_change < -2 AND p95_pct_change < -2 THEN 'both'
    WHEN p50_pct_change < -2 THEN 'typical-only' WHEN p95_pct_change < -2 THEN 'tail-only' ELSE 'none' END AS shift FROM ({COMPARE_SQL})""",
          ["v_summary_sided", "v_rank_test"], doubles=["p50_pct_change", "p95_pct_change"])
def _(v: Views) -> DataFrame:
    return findings.percentile_shift(_comparison(v))


@register("snk02_compare_with_stored_baseline", COMPARE_SQL, ["v_summary_sided", "v_rank_test"], doubles=COMPARE_DOUBLES)
def _(v: Views) -> DataFrame:
    """A baseline saved at the cut, loaded again, and the window after it tested against its stored counts."""
    root = shared_path(v.spark, "baseline")
    older = v.sided.filter(F.col("side") == "baseline")
    payload, compactions = tools.tool_payload_table(v.paired_turns), tools.compaction_summary(v.compaction_events)
    reports.save_report({**usage.usage_tables(older), "tool_payload": payload, "compactions": compactions}, root, "baseline-1", "baseline", f"{CUT}T00:00:00Z", sources=["test"])
    return usage.compare_with_baseline(v.spark, root, v.requests, v.prices, payload, compactions, order=DEDUP_ORDER)["distributions"]


@register("mg06_merged_distributions", COMPARE_SQL, ["v_summary_sided", "v_rank_test"], doubles=COMPARE_DOUBLES)
def _(v: Views) -> DataFrame:
    """Counts of three machines per window, merged and tested: the same as on all rows."""
    sided = v.sided_metrics.withColumn("report_id", F.pmod(F.xxhash64("row_key"), F.lit(3)))
    counts = ranks.value_counts(sided, "value", ["report_id", "side", "metric"])
    merged = merging.merge_counters(counts, ["n"], ["side", "metric", "value"])
    return significance.compare_counts(merged)


@register("mg05_merged_summaries_by_counts", f"SELECT metric, {SUMMARY} FROM v_metrics GROUP BY metric", ["v_metrics"], doubles=SUMMARY_DOUBLES)
def _(v: Views) -> DataFrame:
    """Summaries of three machines merged from their counts: exact."""
    counts = ranks.value_counts(v.metrics.withColumn("report_id", F.pmod(F.xxhash64("row_key"), F.lit(3))), "value", ["report_id", "metric"])
    return distribution.summarize_counts(merging.merge_counters(counts, ["n"], ["metric", "value"]), "value", ["metric"])
