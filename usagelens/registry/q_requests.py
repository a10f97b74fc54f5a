"""Requests, totals, pricing and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, tokens
from ..operators import pricing, requests
from ..operators.merging import share_of_total
from ..session import cut_lineage
from .core import register
from .sql_views import TOKEN_COLUMNS, TOKEN_SUMS
from .views import CUT, DEDUP_ORDER, Views

ROW = ("message_id", "ts", "session_id", "tier", "model", "total_tokens")


@register("ag01_max_wins_dedup", """
  SELECT message_id, ts, session_id, tier, agent_type, model, input_tokens, output_tokens, cache_creation_tokens,
    cache_creation_5m_tokens, cache_creation_1h_tokens, cache_read_tokens, part_key, supp_key FROM v_dedup""",
          ["v_dedup"], texts=["ts"])
def _(v: Views) -> DataFrame:
    return v.dedup


@register("ag02_token_totals", f"SELECT count(*) AS requests, {TOKEN_SUMS} FROM v_dedup", ["v_dedup"])
def _(v: Views) -> DataFrame:
    return requests.request_totals(v.dedup)


@register("ag02_token_totals_complete_split", f"SELECT tier, count(*) AS requests, {TOKEN_SUMS} FROM v_dedup_split GROUP BY tier",
          ["v_dedup_split"])
def _(v: Views) -> DataFrame:
    rows = requests.keep_largest(v.request_columns(full_split=True), order=DEDUP_ORDER)
    return requests.request_totals(rows, ["tier"])


@register("ag03_totals_by_model", "SELECT * FROM v_model_totals", ["v_model_totals"])
def _(v: Views) -> DataFrame:
    return requests.totals_by_key(v.dedup, "model", "model")


@register("tk03_models_ranked", """
  SELECT model, total_tokens, row_number() OVER (ORDER BY total_tokens DESC, model) AS place FROM v_model_totals""",
          ["v_model_totals"])
def _(v: Views) -> DataFrame:
    from pyspark.sql.window import Window

    order = Window.orderBy(F.col("total_tokens").desc(), "model")  # one row per model
    return v.model_totals.select("model", "total_tokens", F.row_number().over(order).alias("place"))


@register("ag04_totals_by_agent_type", f"""
  SELECT coalesce(agent_type, tier) AS agent_type, count(*) AS requests, {TOKEN_SUMS} FROM v_dedup WHERE tier <> 'main' GROUP BY 1""",
          ["v_dedup"])
def _(v: Views) -> DataFrame:
    return requests.totals_by_agent_type(v.dedup)


@register("tk02_top_models_by_cost", """
  SELECT model, cost FROM v_priced ORDER BY cost DESC, model LIMIT 10""", ["v_priced"], doubles=["cost"])
def _(v: Views) -> DataFrame:
    priced = pricing.price_models(v.model_totals, v.prices)
    return priced.select("model", "cost").orderBy(F.col("cost").desc(), "model").limit(10)


@register("ag05_totals_by_tier", f"""
  SELECT t.tier, coalesce(g.requests, 0) AS requests, g.* EXCLUDE (tier, requests)
  FROM (VALUES ('main'), ('subagent'), ('workflow-agent')) t(tier)
  LEFT JOIN (SELECT tier, count(*) AS requests, {TOKEN_SUMS} FROM v_dedup GROUP BY tier) g ON g.tier = t.tier""", ["v_dedup"])
def _(v: Views) -> DataFrame:
    return requests.totals_by_tier(v.dedup)


@register("wn04_tier_share", """
  SELECT tier, total_tokens, total_tokens::DOUBLE / sum(total_tokens) OVER () * 100 AS share_pct
  FROM (SELECT tier, sum(total_tokens)::BIGINT AS total_tokens FROM v_dedup GROUP BY tier)""", ["v_dedup"], doubles=["share_pct"])
def _(v: Views) -> DataFrame:
    return share_of_total(requests.totals_by_tier(v.dedup).select("tier", "total_tokens"), "total_tokens", "share_pct")


@register("ag06_tokens_per_session", "SELECT row_key, value::BIGINT AS value FROM v_metrics WHERE metric = 'tokens per session'", ["v_metrics"])
def _(v: Views) -> DataFrame:
    return requests.tokens_per_session(v.dedup)


@register("ag07_tokens_per_active_hour", "SELECT row_key, value::BIGINT AS value FROM v_metrics WHERE metric = 'tokens per active hour'", ["v_metrics"])
def _(v: Views) -> DataFrame:
    return requests.tokens_per_active_hour(v.dedup)


@register("ag07_event_active_hours", """
  SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS row_key, sum(k)::BIGINT AS value FROM v_events GROUP BY 1""", ["v_events"])
def _(v: Views) -> DataFrame:
    rows = v.events.select("ts", F.col("k").alias("input_tokens"), *[
        F.lit(0).cast("bigint").alias(c) for c in TOKEN_COLUMNS if c != "input_tokens"
    ])
    return requests.tokens_per_active_hour(rows)


# -- projections --------------------------------------------------------------------


@register("prj02_05_token_measures", """
  SELECT message_id, total_tokens, input_tokens + cache_creation_tokens + cache_read_tokens AS context_tokens,
    cache_read_tokens::DOUBLE / nullif(input_tokens + cache_creation_tokens + cache_read_tokens, 0) AS cache_hit_rate,
    output_tokens::DOUBLE / greatest(total_tokens, 1) * 100 AS output_pct,
    cache_read_tokens::DOUBLE / greatest(total_tokens, 1) * 100 AS cache_read_pct,
    cache_creation_5m_tokens IS NOT NULL AND cache_creation_1h_tokens IS NOT NULL AS has_split
  FROM v_dedup""", ["v_dedup"], doubles=["cache_hit_rate", "output_pct", "cache_read_pct"])
def _(v: Views) -> DataFrame:
    total = tokens.total_tokens()
    return v.dedup.select(
        "message_id", total.alias("total_tokens"), tokens.context_tokens().alias("context_tokens"),
        tokens.cache_hit_rate().alias("cache_hit_rate"),
        tokens.token_share("output_tokens", total).alias("output_pct"),
        tokens.token_share("cache_read_tokens", total).alias("cache_read_pct"),
        tokens.has_ttl_split().alias("has_split"),
    )


@register("prj06_normalize_model", """
  SELECT DISTINCT model, dated, regexp_replace(dated, '-[0-9]{8}$', '') AS normalized
  FROM (SELECT p_brand AS model, concat(p_brand, '-2025', lpad((p_size % 12 + 1)::VARCHAR, 2, '0'), '15') AS dated FROM part)""")
def _(v: Views) -> DataFrame:
    part = v.table("part")
    month = F.lpad((F.col("p_size") % 12 + 1).cast("string"), 2, "0")
    dated = F.concat(F.col("p_brand"), F.lit("-2025"), month, F.lit("15"))
    return part.select(F.col("p_brand").alias("model"), dated.alias("dated"), tokens.normalize_model(dated).alias("normalized")).distinct()


@register("prj09_percent_change", """
  SELECT tier, base, comp, CASE WHEN base = 0 THEN CASE WHEN comp = 0 THEN 0.0 END ELSE (comp - base)::DOUBLE / abs(base) * 100 END AS change_pct
  FROM (SELECT tier, sum(output_tokens) FILTER (WHERE side = 'baseline')::BIGINT AS base,
          sum(output_tokens) FILTER (WHERE side = 'compare')::BIGINT AS comp FROM v_sided GROUP BY tier)""", ["v_sided"], doubles=["change_pct"])
def _(v: Views) -> DataFrame:
    of = lambda side: F.sum(F.when(F.col("side") == side, F.col("output_tokens")))
    return v.sided.groupBy("tier").agg(of("baseline").alias("base"), of("compare").alias("comp")).withColumn(
        "change_pct", numeric.pct_change("base", "comp")
    )


# -- pricing -------------------------------------------------------------------------

PRICED = "model, requests, total_tokens, cost, cost_per_request, tokens_per_request, priced, ttl_mode"
PRICED_DOUBLES = ["cost", "cost_per_request", "tokens_per_request"]


@register("ag29_cost_by_model", f"SELECT {PRICED} FROM v_priced", ["v_priced"], doubles=PRICED_DOUBLES)
def _(v: Views) -> DataFrame:
    return pricing.price_models(v.model_totals, v.prices).select(*PRICED.split(", "))


@register("prj07_cost_exact_split", f"SELECT {PRICED} FROM v_priced_split", ["v_priced_split"], doubles=PRICED_DOUBLES)
def _(v: Views) -> DataFrame:
    rows = requests.keep_largest(v.request_columns(full_split=True), order=DEDUP_ORDER)
    totals = cut_lineage(requests.totals_by_key(rows, "model", "model"), "model-totals")
    return pricing.price_models(totals, v.prices).select(*PRICED.split(", "))


@register("ag29_cost_totals", """
  SELECT sum(cost) AS cost, sum(requests)::BIGINT AS requests, coalesce(sum(requests) FILTER (WHERE NOT priced), 0)::BIGINT AS unpriced_requests,
    coalesce(sum(total_tokens) FILTER (WHERE NOT priced), 0)::BIGINT AS unpriced_tokens,
    coalesce(sum(cost) FILTER (WHERE NOT priced), 0.0) AS unpriced_cost,
    count(DISTINCT model) FILTER (WHERE NOT priced) AS unpriced_models, max(ttl_mode) AS ttl_mode
  FROM v_priced""", ["v_priced"], doubles=["cost", "unpriced_cost"])
def _(v: Views) -> DataFrame:
    return pricing.cost_totals(pricing.price_models(v.model_totals, v.prices))


@register("jn01_price_lookup", """
  SELECT r.model, coalesce(p.input_rate, 5.0) AS input_rate, coalesce(p.output_rate, 25.0) AS output_rate,
    coalesce(p.cache_read_multiplier, 0.1) AS cache_read_multiplier, p.model IS NOT NULL AS priced
  FROM (SELECT DISTINCT p_brand AS model FROM part) r LEFT JOIN v_prices p ON p.model = r.model""", ["v_prices"],
          doubles=["input_rate", "output_rate", "cache_read_multiplier"])
def _(v: Views) -> DataFrame:
    return pricing.with_prices(v.table("part").select(F.col("p_brand").alias("model")).distinct(), v.prices)


@register("flt06_ttl_mode", """
  SELECT side, CASE WHEN count(*) > 0 AND count(*) = count(cache_creation_5m_tokens) AND count(*) = count(cache_creation_1h_tokens)
    THEN 'exact' ELSE 'flat' END AS ttl_mode FROM (
      SELECT 'partial split' AS side, * FROM v_model_totals UNION ALL SELECT 'full split', * FROM v_model_totals_split) GROUP BY side""",
          ["v_model_totals", "v_model_totals_split"])
def _(v: Views) -> DataFrame:
    full = requests.keep_largest(v.request_columns(full_split=True), order=DEDUP_ORDER)
    modes = [
        pricing.ttl_mode(totals).select(F.lit(name).alias("side"), "ttl_mode")
        for name, totals in (("partial split", v.model_totals), ("full split", requests.totals_by_key(full, "model", "model")))
    ]
    return modes[0].unionByName(modes[1])


@register("flt06_ttl_mode_two_sides", """
  SELECT pair, CASE WHEN count(*) = count(cache_creation_5m_tokens) AND count(*) = count(cache_creation_1h_tokens)
    AND count(*) FILTER (WHERE side = 'baseline') > 0 AND count(*) FILTER (WHERE side = 'compare') > 0 THEN 'exact' ELSE 'flat' END AS ttl_mode
  FROM (SELECT 'both full' AS pair, 'baseline' AS side, * FROM v_model_totals_split UNION ALL SELECT 'both full', 'compare', * FROM v_model_totals_split
    UNION ALL SELECT 'one partial', 'baseline', * FROM v_model_totals_split UNION ALL SELECT 'one partial', 'compare', * FROM v_model_totals
    UNION ALL SELECT 'one empty', 'baseline', * FROM v_model_totals_split) GROUP BY pair""", ["v_model_totals", "v_model_totals_split"])
def _(v: Views) -> DataFrame:
    """Both sides full, one partial, one empty."""
    full = requests.totals_by_key(requests.keep_largest(v.request_columns(full_split=True), order=DEDUP_ORDER), "model", "model")
    pairs = (("both full", full, full), ("one partial", full, v.model_totals), ("one empty", full, full.limit(0)))
    modes = [
        pricing.ttl_mode(a.withColumn("side", F.lit("baseline")).unionByName(b.withColumn("side", F.lit("compare"))), side="side", sides=("baseline", "compare"))
        .select(F.lit(name).alias("pair"), "ttl_mode")
        for name, a, b in pairs
    ]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


# -- windows -------------------------------------------------------------------------


@register("flt01_content_window", f"""
  SELECT count(*) AS rows_in_window, count(DISTINCT message_id) AS ids, min(ts) AS first_ts, max(ts) AS last_ts
  FROM v_requests WHERE ts > TIMESTAMP '{CUT}'""", ["v_requests"], texts=["first_ts", "last_ts"])
def _(v: Views) -> DataFrame:
    return requests.in_window(v.requests, "ts", v.cut).agg(
        F.count(F.lit(1)).alias("rows_in_window"), F.countDistinct("message_id").alias("ids"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


@register("jn03_exclude_attributed", f"""
  SELECT message_id, ts, total_tokens FROM v_sided WHERE side = 'compare' AND message_id NOT IN (
    SELECT message_id FROM v_requests WHERE ts <= TIMESTAMP '{CUT}')""", ["v_sided", "v_requests"], texts=["ts"])
def _(v: Views) -> DataFrame:
    earlier = requests.in_window(v.requests, "ts", until=v.cut)
    later = v.sided.filter(F.col("side") == "compare")
    return v.totals(requests.exclude_attributed(later, earlier)).select("message_id", "ts", "total_tokens")


@register("jn03_boundary_reconciliations", f"""
  SELECT count(*) AS reconciled_rows, count(DISTINCT message_id) AS reconciled_ids FROM v_requests
  WHERE ts > TIMESTAMP '{CUT}' AND message_id IN (SELECT message_id FROM v_requests WHERE ts <= TIMESTAMP '{CUT}')""", ["v_requests"])
def _(v: Views) -> DataFrame:
    earlier = requests.in_window(v.requests, "ts", until=v.cut)
    return requests.boundary_reconciliations(requests.in_window(v.requests, "ts", v.cut), earlier)


@register("wn05_recent_ids", """
  SELECT part_key, ts, supp_key, message_id, total_tokens, recency FROM (
    SELECT *, row_number() OVER (PARTITION BY part_key ORDER BY order_key DESC) AS recency FROM (
      SELECT *, concat(strftime(ts, '%Y-%m-%d'), '/', message_id, '/', lpad(supp_key::VARCHAR, 6, '0'), '/', lpad(total_tokens::VARCHAR, 12, '0')) AS order_key FROM v_requests))
  WHERE recency <= 20""", ["v_requests"], texts=["ts"])
def _(v: Views) -> DataFrame:
    order = F.concat_ws("/", F.date_format("ts", "yyyy-MM-dd"), "message_id", F.lpad(F.col("supp_key").cast("string"), 6, "0"),
                        F.lpad(tokens.total_tokens().cast("string"), 12, "0"))
    rows = v.requests.withColumn("order_key", order).withColumn("message_id", F.struct("message_id", "ts", "supp_key"))
    recent = requests.recent_ids(rows, "part_key", "order_key", keep=20)
    return recent.select("part_key", "message_id.ts", "message_id.supp_key", F.col("message_id.message_id").alias("message_id"),
                         "total_tokens", "recency")
