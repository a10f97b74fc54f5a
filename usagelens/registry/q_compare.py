"""Baseline against compare window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import comparing, findings
from .core import register
from .sql_views import both_sides, pct_change, two_proportion
from .views import Views

PROFILE_SQL = """
  SELECT side, sum(requests)::BIGINT AS requests, sum(cost) AS cost,
    coalesce(sum(requests) FILTER (WHERE NOT priced), 0)::BIGINT AS unpriced_requests, max(ttl_mode) AS ttl_mode,
    sum(cost) / sum(requests)::DOUBLE AS cost_per_request, sum(total_tokens)::DOUBLE / sum(requests) AS tokens_per_request,
    sum(input_tokens + cache_creation_tokens + cache_read_tokens)::DOUBLE / sum(requests) AS context_per_request,
    sum(output_tokens)::DOUBLE / sum(requests) AS output_per_request,
    sum(cache_read_tokens)::DOUBLE / sum(input_tokens + cache_creation_tokens + cache_read_tokens) AS cache_hit_rate,
    sum(input_tokens)::DOUBLE / sum(requests) AS input_per_request, sum(cache_creation_tokens)::DOUBLE / sum(requests) AS cache_write_per_request,
    sum(cache_read_tokens)::DOUBLE / sum(requests) AS cache_read_per_request
  FROM v_sided_priced GROUP BY side"""
PROFILE_DOUBLES = ["cost", "cost_per_request", "tokens_per_request", "context_per_request", "output_per_request", "cache_hit_rate",
                   "input_per_request", "cache_write_per_request", "cache_read_per_request"]


def _models(v: Views) -> DataFrame:
    return comparing.models_by_side(v.sided_priced)


def _agents(v: Views) -> DataFrame:
    return comparing.agents_by_side(v.sided_agents)


@register("ag31_per_request_profile", PROFILE_SQL, ["v_sided_priced"], doubles=PROFILE_DOUBLES)
def _(v: Views) -> DataFrame:
    return comparing.per_request_profile(v.sided_priced, ["side"])


MIX_SQL = """
  SELECT model, baseline_share, compare_share, (compare_share - baseline_share) * 100 AS delta_points FROM (
    SELECT model, coalesce(base_requests::DOUBLE / (SELECT sum(base_requests) FROM v_models), 0.0) AS baseline_share,
      coalesce(comp_requests::DOUBLE / (SELECT sum(comp_requests) FROM v_models), 0.0) AS compare_share FROM v_models)"""


@register("jn04_model_mix", MIX_SQL, ["v_models"], doubles=["baseline_share", "compare_share", "delta_points"])
def _(v: Views) -> DataFrame:
    return comparing.model_mix_shift(_models(v))


@register("ag33_mix_distance", f"""
  SELECT tvd_points, CASE WHEN tvd_points >= 15 THEN 'mix-moved' ELSE 'comparable' END AS mix_status FROM (
    SELECT sum(abs(compare_share - baseline_share)) / 2 * 100 AS tvd_points FROM ({MIX_SQL}))""", ["v_models"], doubles=["tvd_points"])
def _(v: Views) -> DataFrame:
    return findings.mix_warning(comparing.mix_distance(comparing.model_mix_shift(_models(v))))


ADJUSTED_SQL = """
  SELECT sum(share * base_cost_per_request) AS baseline_weighted, sum(share * coalesce(comp_cost_per_request, base_cost_per_request)) AS adjusted_weighted
  FROM (SELECT *, base_requests::DOUBLE / (SELECT sum(base_requests) FROM v_models) AS share FROM v_models WHERE base_cost_per_request IS NOT NULL)"""


@register("jn05_mix_adjusted_cost", ADJUSTED_SQL, ["v_models"], doubles=["baseline_weighted", "adjusted_weighted"])
def _(v: Views) -> DataFrame:
    return comparing.mix_adjusted_cost(_models(v))


def _term(column: str, rate: str) -> str:
    return (f"coalesce(sum((base_requests::DOUBLE / (SELECT sum(base_requests) FROM v_models)) * (comp_{column}::DOUBLE / comp_requests"
            f" - base_{column}::DOUBLE / base_requests) * ({rate})) FILTER (WHERE base_requests > 0 AND comp_requests > 0), 0.0)")


DECOMPOSITION_SQL = f"""
  SELECT *, "end" - start AS change, context_reread + fresh_context + output_length AS efficiency,
    "end" - start - (context_reread + fresh_context + output_length) AS model_mix
  FROM (SELECT {_term('cache_read_tokens', 'base_input_rate / 1e6 * base_cache_read_multiplier')} AS context_reread,
    {_term('cache_creation_tokens', 'base_input_rate / 1e6 * 1.25::DOUBLE')} + {_term('input_tokens', 'base_input_rate / 1e6')} AS fresh_context,
    {_term('output_tokens', 'base_output_rate / 1e6')} AS output_length,
    sum(base_cost) / sum(base_requests) AS start, sum(comp_cost) / sum(comp_requests) AS "end" FROM v_models)"""


@register("ag32_cost_decomposition", DECOMPOSITION_SQL, ["v_models"],
          doubles=["context_reread", "fresh_context", "output_length", "start", '"end"', "change", "efficiency", "model_mix"])
def _(v: Views) -> DataFrame:
    return comparing.decompose_cost_change(_models(v))


@register("wn03_waterfall", f"""
  SELECT step_no, step, value, start + coalesce(sum(value) OVER (ORDER BY step_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level_from,
    start + sum(value) OVER (ORDER BY step_no) AS level_to, value / change * 100 AS share_of_change,
    CASE WHEN abs(value) < abs(change) * 0.02 THEN 'neutral' WHEN value < 0 THEN 'good' ELSE 'bad' END AS status
  FROM (SELECT start, change, unnest([1, 2, 3, 4]) AS step_no, unnest(['context_reread', 'fresh_context', 'output_length', 'model_mix']) AS step,
    unnest([context_reread, fresh_context, output_length, model_mix]) AS value FROM ({DECOMPOSITION_SQL}))""", ["v_models"],
          doubles=["value", "level_from", "level_to", "share_of_change"], ints=["step_no"])
def _(v: Views) -> DataFrame:
    return comparing.waterfall(comparing.decompose_cost_change(_models(v)))


OVERLAP_SQL = """
  SELECT *, shared_requests::DOUBLE / comp_requests * 100 AS overlap_pct, shared_requests::DOUBLE / comp_requests * 100 >= 60 AS comparable FROM (
    SELECT count(base_requests) AS base_types, count(comp_requests) AS comp_types,
      count(*) FILTER (WHERE base_requests IS NOT NULL AND comp_requests IS NOT NULL) AS shared_types,
      coalesce(sum(comp_requests), 0)::BIGINT AS comp_requests,
      coalesce(sum(comp_requests) FILTER (WHERE base_requests IS NOT NULL), 0)::BIGINT AS shared_requests FROM v_agents)"""


@register("jn07_workload_overlap", OVERLAP_SQL, ["v_agents"], doubles=["overlap_pct"])
def _(v: Views) -> DataFrame:
    return comparing.workload_overlap(_agents(v))


@register("jn07_overlap_of_partial_types", """
  SELECT *, shared_requests::DOUBLE / comp_requests * 100 AS overlap_pct, shared_requests::DOUBLE / comp_requests * 100 >= 60 AS comparable FROM (
    SELECT count(b) AS base_types, count(c) AS comp_types, count(*) FILTER (WHERE b IS NOT NULL AND c IS NOT NULL) AS shared_types,
      sum(c)::BIGINT AS comp_requests, coalesce(sum(c) FILTER (WHERE b IS NOT NULL), 0)::BIGINT AS shared_requests
    FROM (SELECT user_id, nullif(count(*) FILTER (WHERE day < '2024-01-02'), 0) AS b, nullif(count(*) FILTER (WHERE day >= '2024-01-02'), 0) AS c
      FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events) GROUP BY user_id))""", doubles=["overlap_pct"])
def _(v: Views) -> DataFrame:
    first = F.to_date("ts") < F.lit("2024-01-02").cast("date")
    n = lambda c: F.nullif(F.count_if(c), F.lit(0))
    return comparing.workload_overlap(
        v.table("events").groupBy("user_id").agg(n(first).alias("base_requests"), n(~first).alias("comp_requests"))
    )


@register("jn08_agent_type_comparison", f"""
  SELECT agent_type, base_requests, comp_requests, bt AS base_tokens_per_request, ct AS comp_tokens_per_request, {pct_change('bt', 'ct')} AS pct_change,
    base_output_tokens::DOUBLE / base_requests AS base_output_per_request, comp_output_tokens::DOUBLE / comp_requests AS comp_output_per_request
  FROM (SELECT *, base_total_tokens::DOUBLE / base_requests AS bt, comp_total_tokens::DOUBLE / comp_requests AS ct FROM v_agents
    WHERE base_requests > 0 AND comp_requests >= 20)""", ["v_agents"],
          doubles=["base_tokens_per_request", "comp_tokens_per_request", "pct_change", "base_output_per_request", "comp_output_per_request"])
def _(v: Views) -> DataFrame:
    return comparing.agent_type_comparison(_agents(v))


TOOL_SIDES = f"""
  SELECT tool, {both_sides(('calls', 'errors'))} FROM v_tool_payload GROUP BY tool
  HAVING count(*) FILTER (WHERE side = 'baseline') > 0 AND count(*) FILTER (WHERE side = 'compare') > 0"""
TEST_DOUBLES = ["rate_1", "rate_2", "z", "p_value", "ci_low", "ci_high"]


@register("jn09_tool_failure_comparison", two_proportion(f"({TOOL_SIDES})", "tool"), ["v_tool_payload"], doubles=TEST_DOUBLES)
def _(v: Views) -> DataFrame:
    return comparing.tool_failure_comparison(v.tool_payload)


OVERALL_SQL = two_proportion("""(SELECT coalesce(sum(errors) FILTER (WHERE side = 'baseline'), 0)::BIGINT AS base_errors,
  coalesce(sum(calls) FILTER (WHERE side = 'baseline'), 0)::BIGINT AS base_calls,
  coalesce(sum(errors) FILTER (WHERE side = 'compare'), 0)::BIGINT AS comp_errors,
  coalesce(sum(calls) FILTER (WHERE side = 'compare'), 0)::BIGINT AS comp_calls FROM v_tool_payload)""")


@register("ag34_overall_failure_rate", OVERALL_SQL, ["v_tool_payload"], doubles=TEST_DOUBLES)
def _(v: Views) -> DataFrame:
    return comparing.overall_failure_rate(v.tool_payload)


@register("jn04_model_cost_comparison", """
  SELECT *, CASE WHEN pct_change IS NULL OR abs(pct_change) < 2 THEN 'neutral' WHEN pct_change < 0 THEN 'good' ELSE 'bad' END AS status FROM (
    SELECT model, base_requests, comp_requests, base_cost_per_request, comp_cost_per_request,
      (comp_cost_per_request - base_cost_per_request) / nullif(base_cost_per_request, 0) * 100 AS pct_change FROM v_models)""", ["v_models"],
          doubles=["base_cost_per_request", "comp_cost_per_request", "pct_change"])
def _(v: Views) -> DataFrame:
    return comparing.model_cost_comparison(_models(v))


# -- rule tables ----------------------------------------------------------------------

_profile = lambda name, side: f"(SELECT {name} FROM _profile WHERE side = '{side}')"

FACTS = f"""
  SELECT {', '.join(f"{_profile(n, s)} AS {p}_{n}" for n in ("requests", "cost_per_request", "tokens_per_request", "context_per_request", "output_per_request", "cache_hit_rate") for p, s in (("base", "baseline"), ("comp", "compare")))},
    (SELECT baseline_weighted FROM ({ADJUSTED_SQL})) AS baseline_weighted, (SELECT adjusted_weighted FROM ({ADJUSTED_SQL})) AS adjusted_weighted,
    (SELECT output_length FROM ({DECOMPOSITION_SQL})) AS output_length, (SELECT overlap_pct FROM ({OVERLAP_SQL})) AS overlap_pct,
    (SELECT count(*) FROM v_compactions WHERE user_id % 3 <> 0)::DOUBLE AS base_compactions, (SELECT count(*) FROM v_compactions WHERE user_id % 3 = 0)::DOUBLE AS comp_compactions,
    (SELECT sum(total_bytes) FROM v_tool_payload WHERE side = 'baseline')::DOUBLE AS base_tool_bytes, (SELECT sum(total_bytes) FROM v_tool_payload WHERE side = 'compare')::DOUBLE AS comp_tool_bytes,
    f.* FROM ({OVERALL_SQL}) f""".replace("_profile ", f"({PROFILE_SQL}) ")
FACT_VIEWS = ["v_sided_priced", "v_models", "v_agents", "v_tool_payload", "v_compactions"]


def _facts(v: Views) -> DataFrame:
    return findings.comparison_facts(v.sided_priced, _models(v), _agents(v), v.tool_payload, v.compactions_by_side)


def _moved(delta: str) -> str:
    return f"CASE WHEN abs({delta}) < 2 THEN 'neutral' WHEN {delta} < 0 THEN 'good' ELSE 'bad' END"


_change = lambda n: pct_change(f"base_{n}", f"comp_{n}")
COST, CONTEXT, OUTPUT = _change("cost_per_request"), _change("context_per_request"), _change("output_per_request")
CACHE = "((comp_cache_hit_rate - base_cache_hit_rate) * 100)"
ADJUSTED = pct_change("baseline_weighted", "adjusted_weighted")
BASE_RATE, COMP_RATE = "(base_compactions / (base_requests / 1000.0))", "(comp_compactions / (comp_requests / 1000.0))"
BASE_BYTES, COMP_BYTES = "(base_tool_bytes / base_requests)", "(comp_tool_bytes / comp_requests)"
CONTRADICTS = f"((output_length > 0) = ({OUTPUT} < 0) AND abs(output_length) > 1e-6)"


@register("rl01_findings", f"""
  WITH facts AS ({FACTS})
  SELECT 'low-overlap' AS finding, '' AS subject, 'warn' AS status, overlap_pct AS value, NULL::DOUBLE AS baseline, NULL::DOUBLE AS compare FROM facts WHERE overlap_pct < 60
  UNION ALL SELECT 'cost', '', {_moved(COST)}, {COST}, base_cost_per_request, comp_cost_per_request FROM facts WHERE {COST} IS NOT NULL
  UNION ALL SELECT 'mix-or-efficiency', '', CASE WHEN abs({COST} - {ADJUSTED}) >= 2 THEN 'warn' ELSE 'good' END, {COST} - {ADJUSTED}, baseline_weighted, adjusted_weighted FROM facts
  UNION ALL SELECT 'context', '', {_moved(CONTEXT)}, {CONTEXT}, base_context_per_request, comp_context_per_request FROM facts
  UNION ALL SELECT 'output', '', CASE WHEN {CONTRADICTS} THEN 'warn' WHEN {OUTPUT} < 0 THEN 'good' ELSE 'warn' END, {OUTPUT}, base_output_per_request, comp_output_per_request FROM facts WHERE abs({OUTPUT}) >= 3
  UNION ALL SELECT 'cache-hit-rate', '', CASE WHEN {CACHE} > 0 THEN 'good' ELSE 'warn' END, {CACHE}, base_cache_hit_rate, comp_cache_hit_rate FROM facts WHERE abs({CACHE}) >= 0.5
  UNION ALL SELECT 'compactions', '', CASE WHEN {pct_change(BASE_RATE, COMP_RATE)} < 0 THEN 'good' ELSE 'warn' END, {pct_change(BASE_RATE, COMP_RATE)}, {BASE_RATE}, {COMP_RATE}
    FROM facts WHERE base_compactions + comp_compactions >= 5 AND abs({pct_change(BASE_RATE, COMP_RATE)}) >= 15
  UNION ALL SELECT 'tool-output', '', CASE WHEN {pct_change(BASE_BYTES, COMP_BYTES)} < 0 THEN 'good' ELSE 'warn' END, {pct_change(BASE_BYTES, COMP_BYTES)}, {BASE_BYTES}, {COMP_BYTES}
    FROM facts WHERE abs({pct_change(BASE_BYTES, COMP_BYTES)}) >= 10
  UNION ALL SELECT 'failures-up', '', 'bad', (rate_2 - rate_1) * 100, rate_1, rate_2 FROM facts WHERE NOT skipped AND significant AND direction = 'up'
  UNION ALL SELECT 'failures-down', '', 'good', (rate_2 - rate_1) * 100, rate_1, rate_2 FROM facts WHERE NOT skipped AND significant AND direction = 'down'
  UNION ALL SELECT 'model-regression', model, 'warn', {pct_change('base_cost_per_request', 'comp_cost_per_request')}, base_cost_per_request, comp_cost_per_request
    FROM v_models WHERE base_requests >= 30 AND comp_requests >= 30 AND {pct_change('base_cost_per_request', 'comp_cost_per_request')} > 10""",
          FACT_VIEWS, doubles=["value", "baseline", "compare"])
def _(v: Views) -> DataFrame:
    return findings.findings(_facts(v), _models(v))


@register("rl02_kpis", f"""
  WITH facts AS ({FACTS}), listed AS (
    SELECT 'cost_per_request' AS kpi, base_cost_per_request AS baseline, comp_cost_per_request AS compare, true AS lower_is_better, output_length FROM facts
    UNION ALL SELECT 'context_per_request', base_context_per_request, comp_context_per_request, true, output_length FROM facts
    UNION ALL SELECT 'output_per_request', base_output_per_request, comp_output_per_request, true, output_length FROM facts
    UNION ALL SELECT 'cache_hit_rate', base_cache_hit_rate * 100, comp_cache_hit_rate * 100, false, output_length FROM facts
    UNION ALL SELECT 'tool_failure_rate', rate_1 * 100, rate_2 * 100, true, output_length FROM facts
    UNION ALL SELECT 'tokens_per_request', base_tokens_per_request, comp_tokens_per_request, true, output_length FROM facts)
  SELECT kpi, baseline, compare, pct_change, lower_is_better,
    CASE WHEN kpi = 'output_per_request' AND output_length > 1e-6 AND pct_change < 0 THEN 'warn'
      WHEN pct_change IS NULL OR abs(pct_change) < 2 THEN 'neutral' WHEN (lower_is_better AND pct_change < 0) OR (NOT lower_is_better AND pct_change > 0) THEN 'good' ELSE 'bad' END AS status
  FROM (SELECT *, {pct_change('baseline', 'compare')} AS pct_change FROM listed)""", FACT_VIEWS, doubles=["baseline", "compare", "pct_change"])
def _(v: Views) -> DataFrame:
    return findings.kpis(_facts(v))


@register("rl03_quality_guardrail", f"""
  WITH facts AS ({FACTS}), active AS (
    SELECT CASE WHEN {COST} < 0 THEN 'cheaper-but-worse' ELSE 'worse' END AS severity, '(all tools)' AS subject, rate_1 AS baseline_rate, rate_2 AS compare_rate
    FROM facts WHERE NOT skipped AND significant AND direction = 'up')
  SELECT * FROM active UNION ALL SELECT severity, tool, t.rate_1, t.rate_2 FROM active, ({two_proportion(f"({TOOL_SIDES})", "tool")}) t WHERE t.regressed""",
          FACT_VIEWS, doubles=["baseline_rate", "compare_rate"])
def _(v: Views) -> DataFrame:
    return findings.quality_guardrail(_facts(v), comparing.tool_failure_comparison(v.tool_payload))


@register("rl04_verdict", f"""
  WITH facts AS ({FACTS}), d AS (SELECT *, {COST} AS c, coalesce(NOT skipped AND significant AND direction = 'up', false) AS up, coalesce(overlap_pct < 60, false) AS other FROM facts)
  SELECT c AS cost_change_pct, CASE WHEN c IS NULL OR abs(c) < 2 THEN 'neutral' WHEN c < 0 THEN CASE WHEN up OR other THEN 'warn' ELSE 'good' END ELSE 'bad' END AS direction,
    CASE WHEN c IS NULL THEN 'not-enough-data' WHEN c < -2 THEN CASE WHEN up THEN 'cheaper-not-better' WHEN other THEN 'cheaper-different-work' ELSE 'cheaper' END
      WHEN c > 2 THEN 'dearer' ELSE 'unchanged' END AS answer FROM d""", FACT_VIEWS, doubles=["cost_change_pct"])
def _(v: Views) -> DataFrame:
    return findings.verdict(_facts(v))


@register("rl09_standing", f"""
  SELECT side, unnest(['spend', 'cost_per_request', 'context_per_request', 'output_per_request', 'cache_hit_rate_pct', 'requests']) AS metric,
    unnest([cost, cost_per_request, context_per_request, output_per_request, cache_hit_rate * 100, requests::DOUBLE]) AS value FROM ({PROFILE_SQL})""",
          ["v_sided_priced"], doubles=["value"])
def _(v: Views) -> DataFrame:
    return findings.standing(comparing.per_request_profile(v.sided_priced, ["side"]), ["side"])
