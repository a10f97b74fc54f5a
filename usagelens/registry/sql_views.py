"""The same views in SQL: name -> (views it needs, body)."""

TOKEN_COLUMNS = (
    "input_tokens", "output_tokens", "cache_creation_tokens",
    "cache_creation_5m_tokens", "cache_creation_1h_tokens", "cache_read_tokens",
)

TOKEN_SUMS = """
  coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens,
  coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens,
  coalesce(sum(cache_creation_tokens), 0)::BIGINT AS cache_creation_tokens,
  coalesce(sum(cache_read_tokens), 0)::BIGINT AS cache_read_tokens,
  CASE WHEN count(*) = count(cache_creation_5m_tokens) AND count(*) = count(cache_creation_1h_tokens)
       THEN sum(cache_creation_5m_tokens)::BIGINT END AS cache_creation_5m_tokens,
  CASE WHEN count(*) = count(cache_creation_5m_tokens) AND count(*) = count(cache_creation_1h_tokens)
       THEN sum(cache_creation_1h_tokens)::BIGINT END AS cache_creation_1h_tokens,
  coalesce(sum(total_tokens), 0)::BIGINT AS total_tokens
"""


def _requests(split_condition: str) -> str:
    return f"""
  SELECT *, input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens AS total_tokens FROM (
    SELECT concat(l_orderkey, '-', l_linenumber) AS message_id, l_shipdate AS ts, o_custkey AS session_id,
      CASE l_returnflag WHEN 'N' THEN 'main' WHEN 'R' THEN 'subagent' ELSE 'workflow-agent' END AS tier,
      CASE WHEN l_returnflag <> 'N' THEN o_orderpriority END AS agent_type,
      p_brand AS model,
      l_quantity::BIGINT AS input_tokens,
      round(l_tax * 100)::BIGINT * 7 AS output_tokens,
      round(l_discount * 100)::BIGINT * 50 AS cache_creation_tokens,
      CASE WHEN {split_condition} THEN round(l_discount * 100)::BIGINT * 40 END AS cache_creation_5m_tokens,
      CASE WHEN {split_condition} THEN round(l_discount * 100)::BIGINT * 10 END AS cache_creation_1h_tokens,
      floor(l_extendedprice)::BIGINT AS cache_read_tokens,
      l_partkey AS part_key, l_suppkey AS supp_key
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def _best(source: str, keys: str) -> str:
    return f"""
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY total_tokens DESC, ts, part_key, supp_key) AS rn
    FROM {source}) WHERE rn = 1"""


def cost(mode: str = "ttl_mode = 'exact'") -> str:
    return f"""(input_tokens * (input_rate / 1e6) + output_tokens * (output_rate / 1e6)
      + CASE WHEN {mode} AND cache_creation_5m_tokens IS NOT NULL AND cache_creation_1h_tokens IS NOT NULL
          THEN cache_creation_5m_tokens * (input_rate / 1e6 * 1.25::DOUBLE) + cache_creation_1h_tokens * (input_rate / 1e6 * 2.0::DOUBLE)
          ELSE cache_creation_tokens * (input_rate / 1e6 * 1.25::DOUBLE) END
      + cache_read_tokens * (input_rate / 1e6 * cache_read_multiplier))"""


def priced(totals: str) -> str:
    """Rows of model totals with rates, cost and the negotiated mode."""
    return f"""
  SELECT *, cost / nullif(requests, 0)::DOUBLE AS cost_per_request,
         total_tokens::DOUBLE / nullif(requests, 0) AS tokens_per_request
  FROM (SELECT *, {cost()} AS cost FROM (
    SELECT t.*, coalesce(p.input_rate, 5.0::DOUBLE) AS input_rate, coalesce(p.output_rate, 25.0::DOUBLE) AS output_rate,
      coalesce(p.cache_read_multiplier, 0.1::DOUBLE) AS cache_read_multiplier, p.model IS NOT NULL AS priced,
      (SELECT CASE WHEN count(*) > 0 AND count(*) = count(cache_creation_5m_tokens) AND count(*) = count(cache_creation_1h_tokens)
              THEN 'exact' ELSE 'flat' END FROM {totals}) AS ttl_mode
    FROM {totals} t LEFT JOIN v_prices p ON regexp_replace(t.model, '-[0-9]{{8}}$', '') = p.model))"""


def _model_totals(source: str, by: str = "") -> str:
    return f"SELECT {by} coalesce(model, 'unknown') AS model, count(*) AS requests, {TOKEN_SUMS} FROM {source} GROUP BY ALL"


def _pick(side: str, prefix: str, columns: tuple[str, ...]) -> str:
    return ", ".join(f"max({c}) FILTER (WHERE side = '{side}') AS {prefix}_{c}" for c in columns)


def both_sides(columns: tuple[str, ...]) -> str:
    return _pick("baseline", "base", columns) + ", " + _pick("compare", "comp", columns)


def pct_change(before: str, after: str) -> str:
    return f"(CASE WHEN {before} = 0 THEN CASE WHEN {after} = 0 THEN 0.0 END ELSE ({after} - {before})::DOUBLE / abs({before}) * 100 END)"


ERF = """(sign({x}) * (1.0 - (1.0/(1.0+0.3275911*abs({x}))) * (0.254829592 + (1.0/(1.0+0.3275911*abs({x}))) * (-0.284496736
  + (1.0/(1.0+0.3275911*abs({x}))) * (1.421413741 + (1.0/(1.0+0.3275911*abs({x}))) * (-1.453152027
  + (1.0/(1.0+0.3275911*abs({x}))) * 1.061405429)))) * exp(-({x}) * ({x}))))"""


def two_proportion(source: str, keys: str = "") -> str:
    """Pooled test of base/comp errors and calls; `keys` are carried through."""
    lead = f"{keys}, " if keys else ""
    return f"""
  SELECT {lead} base_errors, base_calls, comp_errors, comp_calls, skipped, rate_1, rate_2,
    CASE WHEN NOT skipped THEN z END AS z, CASE WHEN NOT skipped THEN p_value END AS p_value,
    CASE WHEN NOT skipped THEN p_value < 0.05 END AS significant,
    CASE WHEN NOT skipped THEN CASE WHEN se > 0 AND rate_2 > rate_1 THEN 'up' WHEN se > 0 AND rate_2 < rate_1 THEN 'down' ELSE 'flat' END END AS direction,
    CASE WHEN NOT skipped THEN greatest(0.0, centre - half) END AS ci_low,
    CASE WHEN NOT skipped THEN least(1.0, centre + half) END AS ci_high,
    coalesce(NOT skipped AND p_value < 0.05 AND se > 0 AND rate_2 > rate_1, false) AS regressed
  FROM (SELECT *, CASE WHEN se > 0 THEN 2.0 * (1.0 - 0.5 * (1.0 + {ERF.format(x="(abs(z) / sqrt(2.0))")})) ELSE 1.0 END AS p_value,
      (rate_2 + 3.8416 / (2 * comp_calls)) / (1 + 3.8416 / comp_calls) AS centre,
      1.96 * sqrt(rate_2 * (1 - rate_2) / comp_calls + 3.8416 / (4.0 * comp_calls * comp_calls)) / (1 + 3.8416 / comp_calls) AS half
    FROM (SELECT *, CASE WHEN se > 0 THEN (rate_2 - rate_1) / se ELSE 0.0 END AS z
      FROM (SELECT *, base_errors::DOUBLE / nullif(base_calls, 0) AS rate_1, comp_errors::DOUBLE / nullif(comp_calls, 0) AS rate_2,
          coalesce(base_calls, 0) < 30 OR coalesce(comp_calls, 0) < 30 AS skipped,
          sqrt(((base_errors + comp_errors)::DOUBLE / nullif(base_calls + comp_calls, 0))
             * (1 - (base_errors + comp_errors)::DOUBLE / nullif(base_calls + comp_calls, 0))
             * (1.0::DOUBLE / nullif(base_calls, 0) + 1.0::DOUBLE / nullif(comp_calls, 0))) AS se
        FROM {source})))"""


MODEL_COLUMNS = ("requests", *TOKEN_COLUMNS, "total_tokens", "cost", "cost_per_request", "tokens_per_request",
                 "input_rate", "output_rate", "cache_read_multiplier")

SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_requests": ((), _requests("l_linestatus = 'F'")),
    "v_requests_split": ((), _requests("true")),
    "v_dedup": (("v_requests",), _best("v_requests", "message_id")),
    "v_dedup_split": (("v_requests_split",), _best("v_requests_split", "message_id")),
    "v_labelled": (("v_requests",), """
  SELECT *, CASE WHEN ts > TIMESTAMP '1998-06-30' THEN 'compare' ELSE 'baseline' END AS side FROM v_requests WHERE ts IS NOT NULL"""),
    "v_sided": (("v_labelled",), _best("v_labelled", "side, message_id")),
    "v_prices": ((), """
  SELECT concat('Brand#', i) AS model, (1 + i % 7)::DOUBLE AS input_rate, (1 + i % 7)::DOUBLE * 5 AS output_rate,
    CASE WHEN i <= 2 THEN 0.025::DOUBLE END AS cache_read_multiplier FROM range(1, 21) r(i)"""),
    "v_model_totals": (("v_dedup",), _model_totals("v_dedup")),
    "v_model_totals_split": (("v_dedup_split",), _model_totals("v_dedup_split")),
    "v_priced": (("v_model_totals", "v_prices"), priced("v_model_totals")),
    "v_priced_split": (("v_model_totals_split", "v_prices"), priced("v_model_totals_split")),
    "v_sided_models": (("v_sided",), _model_totals("v_sided", "side,")),
    "v_sided_priced": (("v_sided_models", "v_prices"), priced("v_sided_models")),
    "v_models": (("v_sided_priced",), f"SELECT model, {both_sides(MODEL_COLUMNS)}, max(ttl_mode) AS ttl_mode FROM v_sided_priced GROUP BY model"),
    "v_sided_agents": (("v_sided",), f"""
  SELECT side, coalesce(agent_type, tier) AS agent_type, count(*) AS requests, {TOKEN_SUMS}
  FROM v_sided WHERE tier <> 'main' GROUP BY ALL"""),
    "v_agents": (("v_sided_agents",), f"SELECT agent_type, {both_sides(('requests', 'total_tokens', 'output_tokens'))} FROM v_sided_agents GROUP BY agent_type"),
    "v_metrics": (("v_dedup",), """
  SELECT 'tokens per request' AS metric, message_id AS row_key, total_tokens::DOUBLE AS value FROM v_dedup
  UNION ALL SELECT 'tokens per session', session_id::VARCHAR, sum(total_tokens)::DOUBLE FROM v_dedup GROUP BY session_id
  UNION ALL SELECT 'tokens per active hour', strftime(date_trunc('hour', ts), '%Y-%m-%d %H'), sum(total_tokens)::DOUBLE FROM v_dedup GROUP BY 2"""),
    "v_sided_metrics": (("v_sided",), """
  SELECT side, 'tokens per request' AS metric, message_id AS row_key, total_tokens::DOUBLE AS value FROM v_sided
  UNION ALL SELECT side, 'tokens per session', session_id::VARCHAR, sum(total_tokens)::DOUBLE FROM v_sided GROUP BY side, session_id
  UNION ALL SELECT side, 'tokens per active hour', strftime(date_trunc('hour', ts), '%Y-%m-%d %H'), sum(total_tokens)::DOUBLE FROM v_sided GROUP BY side, 3"""),
    "v_rank_test": (("v_sided_metrics",), """
  SELECT metric, n1 < 10 OR n2 < 10 AS skipped, n1, n2, u1, u2, z,
    least(1.0, greatest(0.0, 2.0 * (0.3989423 * exp(-z * z / 2) * t * (0.3193815 + t * (-0.3565638 + t * (1.781478 + t * (-1.821256 + t * 1.330274))))))) AS p_value,
    effect AS rank_biserial,
    CASE WHEN abs(effect) < 0.1 THEN 'negligible' WHEN abs(effect) < 0.3 THEN 'small' WHEN abs(effect) < 0.5 THEN 'medium' ELSE 'large' END AS effect_size,
    CASE WHEN median_2 > median_1 THEN 'up' WHEN median_2 < median_1 THEN 'down' ELSE 'flat' END AS direction
  FROM (SELECT *, 1.0 / (1.0 + 0.2316419 * abs(z)) AS t FROM (
    SELECT *, CASE WHEN sigma > 0 THEN (gap + CASE WHEN gap < 0 THEN 0.5 ELSE -0.5 END) / sigma ELSE 0.0 END AS z FROM (
    SELECT *, least(u1, u2) - n1 * n2 / 2.0 AS gap, 1 - 2 * u1 / (n1::DOUBLE * n2) AS effect,
      sqrt(greatest(n1::DOUBLE * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2)::DOUBLE * (n1 + n2 - 1))), 0)) AS sigma FROM (
    SELECT s.*, rank_sum - n1::DOUBLE * (n1 + 1) / 2 AS u1, n1::DOUBLE * n2 - (rank_sum - n1::DOUBLE * (n1 + 1) / 2) AS u2, ties FROM (
      SELECT metric, count(*) FILTER (WHERE side = 'baseline') AS n1, count(*) FILTER (WHERE side = 'compare') AS n2,
        sum(rk) FILTER (WHERE side = 'baseline') AS rank_sum,
        quantile_disc(value, 0.5) FILTER (WHERE side = 'baseline') AS median_1,
        quantile_disc(value, 0.5) FILTER (WHERE side = 'compare') AS median_2
      FROM (SELECT *, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0::DOUBLE AS rk FROM v_sided_metrics)
      GROUP BY metric) s
    JOIN (SELECT metric, sum(c::DOUBLE * c * c - c) AS ties FROM (SELECT metric, value, count(*) AS c FROM v_sided_metrics GROUP BY ALL) GROUP BY metric) USING (metric)))))"""),
    "v_summary_sided": (("v_sided_metrics",), """
  SELECT metric, side, count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75,
    quantile_cont(value, 0.85) AS p85, quantile_cont(value, 0.95) AS p95 FROM v_sided_metrics GROUP BY ALL"""),
    # events
    "v_events": ((), "SELECT *, (props->>'$.k')::BIGINT AS k FROM events"),
    "v_lines": (("v_events",), """
  SELECT *, event_id AS line_no, CASE user_id % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'subagent' ELSE 'workflow-agent' END AS tier,
    concat('p', user_id % 10) AS project, concat('s', user_id) AS session_id,
    CASE WHEN k % 20 <> 19 THEN ts END AS line_ts,
    CASE WHEN event_type = 'error' THEN 'corrupt'
         WHEN event_type IN ('purchase', 'signup') THEN 'other'
         WHEN event_type = 'click' AND k % 10 = 1 THEN 'other'
         WHEN event_type = 'view' AND k % 10 = 0 THEN 'synthetic'
         WHEN event_type = 'click' AND k % 10 = 2 THEN 'other'
         ELSE 'record' END AS kind,
    CASE WHEN k % 20 = 19 THEN NULL
         WHEN event_type IN ('click', 'view', 'purchase') THEN 'working'
         WHEN event_type = 'signup' AND user_id % 3 = 0 AND NOT (CASE WHEN k % 10 = 5 THEN true WHEN k >= 40 AND k < 60 THEN false ELSE k >= 50 END)
           THEN 'prompt' END AS series
  FROM v_events"""),
    "v_series": (("v_events",), "SELECT ts, event_id, user_id AS session_id, CASE WHEN event_type = 'signup' THEN 'prompt' ELSE 'working' END AS series FROM v_events"),
    "v_calls": ((), """
  SELECT u.conv_id, concat('tool-', length(u.text) % 4) AS tool, length(a.text)::BIGINT AS bytes, length(a.text) % 5 = 0 AS is_error,
    u.turn AS call_line_no, a.turn AS result_line_no, u.turn % 4 AS tool_use_id
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND u.role = 'user' AND a.role = 'assistant' AND (a.turn - 1) % 4 = u.turn % 4
    AND a.turn > u.turn
    AND NOT EXISTS (SELECT 1 FROM conversations m WHERE m.conv_id = u.conv_id AND m.turn > u.turn AND m.turn < a.turn
      AND ((m.role = 'user' AND m.turn % 4 = u.turn % 4) OR (m.role = 'assistant' AND (m.turn - 1) % 4 = u.turn % 4)))"""),
    "v_tool_payload": (("v_calls",), """
  SELECT CASE WHEN conv_id % 2 = 0 THEN 'baseline' ELSE 'compare' END AS side, tool, count(*) AS calls, sum(bytes)::BIGINT AS total_bytes,
    max(bytes) AS max_bytes, count(*) FILTER (WHERE is_error) AS errors FROM v_calls GROUP BY ALL"""),
    "v_compactions": (("v_events",), """
  SELECT ts, user_id, CASE k % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'auto' END AS trigger, k * 10 AS pre_tokens, k AS post_tokens,
    k * 9 AS dropped_tokens, CASE WHEN k % 7 <> 0 THEN k * 100 END AS duration_ms FROM v_events WHERE event_type = 'error'"""),
    "v_prompts": (("v_events",), """
  SELECT ts, user_id, CASE WHEN k % 4 = 0 THEN '/clear' ELSE 'text' END AS display, user_id::VARCHAR AS session_id,
    concat('p', user_id % 10) AS project FROM v_events WHERE event_type = 'signup'"""),
    # commits
    "v_commits": ((), """
  SELECT *, is_marked AND o_orderstatus <> 'P' AS counted, is_marked AND o_orderstatus = 'P' AS counted_merge FROM (
    SELECT o_custkey % 40 AS repo, o_orderkey AS hash, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+02:00') AS author_date,
      o_orderstatus, o_orderpriority[1] IN ('1', '2') AS is_marked FROM orders WHERE o_custkey % 10 < 3)"""),
    "v_commit_stats": (("v_commits",), """
  SELECT c.*, coalesce(f.insertions, 0) AS insertions, coalesce(f.deletions, 0) AS deletions,
    coalesce(f.files_changed, 0) AS files_changed, coalesce(f.binary_files, 0) AS binary_files
  FROM v_commits c LEFT JOIN (
    SELECT l_orderkey AS hash, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS insertions,
      sum(CASE WHEN l_returnflag <> 'R' THEN l_linenumber ELSE 0 END)::BIGINT AS deletions,
      count(*) AS files_changed, count(*) FILTER (WHERE l_returnflag = 'R') AS binary_files
    FROM lineitem GROUP BY l_orderkey) f ON c.hash = f.hash AND c.counted"""),
    "v_commit_rollup": (("v_commit_stats",), """
  SELECT repo, count(*) FILTER (WHERE counted) AS attributed_commits, count(*) FILTER (WHERE o_orderstatus <> 'P') AS authored_commits,
    count(*) FILTER (WHERE counted_merge) AS attributed_merges,
    coalesce(sum(insertions) FILTER (WHERE counted), 0)::BIGINT AS insertions, coalesce(sum(deletions) FILTER (WHERE counted), 0)::BIGINT AS deletions,
    coalesce(sum(files_changed) FILTER (WHERE counted), 0)::BIGINT AS files_changed, coalesce(sum(binary_files) FILTER (WHERE counted), 0)::BIGINT AS binary_files,
    min(author_date) FILTER (WHERE counted) AS first_commit_at, max(author_date) FILTER (WHERE counted) AS last_commit_at
  FROM v_commit_stats GROUP BY repo"""),
}
