"""Invariants of the comparison, edge cases of the profiles, identity, merges and streams."""

import json
import random
from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from usagelens.functions import calendar, text
from usagelens.operators import activity, comparing, findings, identity, merging, pricing, requests, tools
from usagelens.registry.views import Views
from usagelens.streaming import jobs

BUNDLE = "input_tokens bigint, output_tokens bigint, cache_creation_tokens bigint, cache_creation_5m_tokens bigint, cache_creation_1h_tokens bigint, cache_read_tokens bigint"


@pytest.fixture(scope="module")
def prices(spark):
    return spark.createDataFrame([("a", 3.0, 15.0, None), ("b", 1.0, 5.0, 0.025)], "model string, input_rate double, output_rate double, cache_read_multiplier double")


def totals(spark, data):
    df = spark.createDataFrame(data, f"side string, model string, requests bigint, {BUNDLE}")
    return df.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens"))


def test_split_is_all_or_nothing(spark):
    df = spark.createDataFrame([("x", 1, 1, 5, 3, 2, 1), ("x", 1, 1, 5, None, None, 1), ("y", 0, 0, 5, 5, 0, 0)], f"model string, {BUNDLE}")
    out = {r["model"]: r for r in rows(requests.totals_by_key(df, "model", "model"))}
    assert out["x"]["cache_creation_5m_tokens"] is None and out["x"]["cache_creation_tokens"] == 10
    assert (out["y"]["cache_creation_5m_tokens"], out["y"]["cache_creation_1h_tokens"]) == (5, 0)
    (empty,) = rows(requests.request_totals(df.limit(0)))
    assert empty["requests"] == 0 and empty["total_tokens"] == 0 and empty["cache_creation_5m_tokens"] is None


def test_prices_exact_flat_and_fallback(spark, prices):
    exact = totals(spark, [("s", "a-20250101", 2, 1_000_000, 0, 1_000_000, 0, 1_000_000, 0)])
    (r,) = rows(pricing.price_models(exact, prices))
    assert r["ttl_mode"] == "exact" and r["cost"] == pytest.approx(3 + 6) and r["priced"]
    (r,) = rows(pricing.price_models(exact, prices, exact=False))
    assert r["cost"] == pytest.approx(3 + 3.75)
    (r,) = rows(pricing.price_models(totals(spark, [("s", "zzz", 1, 0, 1_000_000, 0, None, None, 1_000_000)]), prices))
    assert not r["priced"] and r["cost"] == pytest.approx(25 + 0.5) and r["ttl_mode"] == "flat"


@pytest.mark.parametrize("seed", range(3))
def test_decomposition_adds_up(spark, prices, seed):
    rng = random.Random(seed)
    n = lambda hi: rng.randint(0, hi)
    data = [(side, m, rng.randint(1, 50), n(999), n(999), 7, 3, 4, n(9999)) for side in ("baseline", "compare") for m in "abcd" if rng.random() < 0.8]
    data += [("baseline", "a2", 5, 10, 10, 7, 3, 4, 10), ("compare", "a2", 5, 10, 20, 7, 3, 4, 30)]
    priced = pricing.price_models(totals(spark, data), prices)
    models = comparing.models_by_side(priced)
    (d,) = rows(comparing.decompose_cost_change(models))
    assert d["context_reread"] + d["fresh_context"] + d["output_length"] + d["model_mix"] == pytest.approx(d["change"], abs=1e-12)
    steps = rows(comparing.waterfall(comparing.decompose_cost_change(models)), "step_no")
    assert steps[0]["level_from"] == pytest.approx(d["start"]) and steps[-1]["level_to"] == pytest.approx(d["end"])
    (adjusted,) = rows(comparing.mix_adjusted_cost(models))
    assert adjusted["adjusted_weighted"] - adjusted["baseline_weighted"] == pytest.approx(d["efficiency"], abs=1e-12)
    mix = rows(comparing.model_mix_shift(models))
    assert sum(r["delta_points"] for r in mix) == pytest.approx(0, abs=1e-9)


def test_empty_compare_side(spark, prices):
    priced = pricing.price_models(totals(spark, [("baseline", "a", 5, 1, 1, 1, None, None, 1)]), prices)
    models = comparing.models_by_side(priced)
    assert comparing.decompose_cost_change(models).count() == 0 and comparing.model_mix_shift(models).count() == 0
    agents = spark.createDataFrame([("x", 4, None)], "agent_type string, base_requests bigint, comp_requests bigint")
    assert comparing.workload_overlap(agents).count() == 0


def facts_row(spark, **values):
    schema = ", ".join(f"{f} double" for f in findings.FACTS)
    return spark.createDataFrame([tuple(float(values[f]) if f in values else None for f in findings.FACTS)], schema)


def test_verdict_is_downgraded(spark):
    cheaper = dict(base_cost_per_request=1.0, comp_cost_per_request=0.8, overlap_pct=90)
    worse = dict(failure_tested=1, failure_significant=1, failure_up=1, failure_down=0, failure_rate_1=0.1, failure_rate_2=0.2)
    for extra, want in (({}, ("good", "cheaper")), (worse, ("warn", "cheaper-not-better")), ({"overlap_pct": 30}, ("warn", "cheaper-different-work"))):
        (v,) = rows(findings.verdict(facts_row(spark, **{**cheaper, **extra})))
        assert (v["direction"], v["answer"]) == want
    (v,) = rows(findings.verdict(facts_row(spark)))
    assert (v["direction"], v["answer"]) == ("neutral", "not-enough-data")


def test_output_gain_by_mix_is_a_warning(spark):
    facts = facts_row(spark, base_output_per_request=100, comp_output_per_request=80, output_length=0.001)
    kpi = {r["kpi"]: r["status"] for r in rows(findings.kpis(facts))}
    assert kpi["output_per_request"] == "warn" and kpi["cache_hit_rate"] == "neutral"
    models = spark.createDataFrame([("m", 40, 40, 1.0, 1.2)], "model string, base_requests bigint, comp_requests bigint, base_cost_per_request double, comp_cost_per_request double")
    got = {r["finding"]: r["status"] for r in rows(findings.findings(facts, models))}
    assert got == {"output": "warn", "model-regression": "warn"}


def test_hours_follow_daylight_saving(spark):
    df = spark.createDataFrame([("2024-03-10 06:30:00",), ("2024-03-10 07:30:00",), ("2024-11-03 05:30:00",), ("2024-11-03 06:30:00",)], "s string")
    hours = df.select(calendar.local_hour(F.col("s").cast("timestamp_ntz"), "America/New_York").alias("h"))
    assert [r["h"] for r in hours.collect()] == [1, 3, 1, 1]


def test_late_night_band_wraps(spark):
    late = [r["id"] for r in spark.range(24).filter(calendar.is_late_night("id")).collect()]
    assert sorted(late) == [0, 1, 2, 3, 4, 5, 22, 23]


def test_weekday_occurrences(spark):
    spans = spark.createDataFrame([("one", "2024-03-06", "2024-03-06"), ("week", "2024-03-06", "2024-03-12"), ("more", "2024-02-28", "2024-03-15"), ("bad", "2024-03-02", "2024-03-01"), ("long", "1900-01-01", "2024-03-01")], "series string, a string, b string")
    df = spans.select("series", F.to_date("a").alias("first_date"), F.to_date("b").alias("last_date"))
    got = {}
    for r in rows(activity.weekday_occurrences(df)):
        got.setdefault(r["series"], {})[r["slot"]] = r["occurrences"]
    assert set(got) == {"one", "week", "more", "long"}
    assert sum(got["long"].values()) == (date(2024, 3, 1) - date(1900, 1, 1)).days + 1 and max(got["long"].values()) - min(got["long"].values()) <= 1
    assert got["one"] == {0: 0, 1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0}
    assert set(got["week"].values()) == {1}
    days = [r["d"] for r in spark.sql("SELECT dayofweek(x) - 1 AS d FROM (SELECT explode(sequence(DATE'2024-02-28', DATE'2024-03-15')) AS x)").collect()]
    assert got["more"] == {k: days.count(k) for k in range(7)}


def test_weekend_split_ties(spark):
    counts = spark.createDataFrame([("working", d, 5) for d in range(7)], "series string, slot int, n bigint")
    spans = spark.createDataFrame([("working", "2024-03-03", "2024-03-09")], "series string, a string, b string").select(
        "series", F.to_date("a").alias("first_date"), F.to_date("b").alias("last_date"))
    split = {r["series"]: r for r in rows(activity.weekday_split(activity.weekday_profile(counts, spans)))}
    w, p = split["working"], split["prompt"]
    assert (w["busiest_day"], w["quietest_day"], w["weekend_intensity_pct"], w["weekend"]) == (0, 6, 100.0, "no-weekend")
    assert p["total"] == 0 and p["weekend_pct"] is None and p["weekend_intensity_pct"] is None


def test_hour_and_weekday_totals_agree(spark, sf):
    v = Views(spark, sf)
    counted = v.activity.filter(F.col("series").isNotNull())
    total = lambda df: {r["series"]: r["n"] for r in rows(df.groupBy("series").agg(F.sum("n").alias("n")))}
    assert total(activity.hour_counts(counted, tz="Asia/Kolkata")) == total(activity.weekday_counts(counted, tz="Asia/Kolkata"))


def test_coverage_edges(spark):
    def cover(*days):
        return rows(activity.calendar_coverage(spark.createDataFrame([(d,) for d in days], "s string").select(F.to_date("s").alias("date"))))

    assert cover() == []
    (one,) = cover("2024-01-05", "2024-01-05")
    assert (one["calendar_days"], one["active_days"], one["longest_streak"], one["longest_gap"], one["coverage_pct"]) == (1, 1, 1, 0, 100.0)
    (r,) = cover("2024-01-01", "2024-01-02", "2024-01-05", "2024-01-06", "2024-01-07", "2024-02-01")
    assert (r["longest_streak"], r["longest_gap"], r["active_days"], r["calendar_days"]) == (3, 24, 6, 32)


def test_cached_days_count_once(spark):
    daily = spark.createDataFrame([("2024-01-01", "m", 5, 0, 0, 0), ("2024-01-02", "m", 7, 0, 0, 0)], "d string, model string, input_tokens bigint, output_tokens bigint, cache_creation_tokens bigint, cache_read_tokens bigint").withColumn("date", F.to_date("d"))
    last = spark.sql("SELECT DATE'2024-01-01' AS last_computed_date")
    none = spark.sql("SELECT CAST(NULL AS DATE) AS last_computed_date")
    cached = daily.filter("d = '2024-01-01'").drop("date", "d")
    total = lambda c, l: [r for r in rows(activity.all_time_model_totals(c, daily, l)) if r["is_total"]][0]  # noqa: E731, E741
    assert total(cached, last)["input_tokens"] == 12 and total(cached, last)["live_tokens"] == 7
    assert total(cached.limit(0), none)["input_tokens"] == 12


def test_remote_addresses(spark):
    data = ["git@host.example:team/repo.git", "https://user:tok@Host.example:8443/team/repo.git", "ssh://git@host.example/a/b/c", "user@plain.git", "", None]
    df = spark.createDataFrame([(x,) for x in data], "u string")
    got = [r[0] for r in df.select(text.sanitize_remote("u")).collect()]
    assert got == ["host.example/team/repo", "host.example:8443/team/repo", "host.example/a/b/c", "plain", None, None]
    names = [r[0] for r in df.select(text.owner_repo(text.sanitize_remote("u"))).collect()]
    assert names == ["team/repo", "team/repo", "b/c", None, None, None]


def components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return find


def test_components_of_chain_star_and_random(spark):
    rng = random.Random(4)
    chain = [(i, f"c{i}") for i in range(120)] + [(i + 1, f"c{i}") for i in range(119)]
    star = [(1000 + i, "hub") for i in range(300)]
    noise = [(2000 + rng.randint(0, 150), f"n{rng.randint(0, 90)}") for _ in range(200)]
    keyed = chain + star + noise
    by_key = {}
    for e, k in keyed:
        by_key.setdefault(k, []).append(e)
    find = components([(es[0], e) for es in by_key.values() for e in es])
    lowest = {}
    for e, _ in keyed:
        lowest[find(e)] = min(lowest.get(find(e), e), e)
    got = {r["entry"]: r["component"] for r in rows(identity.shared_key_components(spark.createDataFrame(keyed, "entry bigint, key string")))}
    assert got == {e: lowest[find(e)] for e, _ in keyed}


def test_copies_of_a_repo_do_not_add_up(spark):
    schema = "entry string, remote string, root_commits array<string>, root_key string, path string, attributed_commits bigint, authored_commits bigint, attributed_merges bigint, insertions bigint, deletions bigint, files_changed bigint, binary_files bigint, first_commit_at string, last_commit_at string"
    repo = lambda e, remote, roots, path, n: (e, remote, roots, None, path, n, 2 * n, 0, n, 0, n, 0, "2024-01-01", "2024-02-01")
    data = [repo("1", "h/a", ["r1"], "/x", 5), repo("2", None, ["r1", "r2"], "/y", 9), repo("3", None, ["r2"], "/z", 1), repo("4", None, None, "/x", 3)]
    df = spark.createDataFrame(data, schema)
    folded = {r["component"]: r for r in rows(merging.fold_repos(merging.label_repos(df, identity.repo_keys(df))))}
    assert folded["1"]["attributed_commits"] == 9 and folded["1"]["entries"] == 3 and folded["4"]["attributed_commits"] == 3


def test_sum_or_null(spark):
    df = spark.createDataFrame([(None, None, 5), (None, 2, 6)], "a bigint, b bigint, c bigint")
    (r,) = rows(merging.merge_scalars(df, sums=["a"], sums_or_null=["b", "c"]))
    assert (r["a"], r["b"], r["c"]) == (0, 2, 11)
    (r,) = rows(merging.merge_scalars(df.select("a"), sums_or_null=["a"]))
    assert r["a"] is None


def test_hot_key_is_deduplicated(spark):
    """One id holds a third of all rows."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("message_id"), F.lit("f").alias("file_path"),
        F.col("id").alias("line_no"), (F.col("id") % 1000).alias("input_tokens"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("output_tokens", "cache_creation_tokens", "cache_read_tokens")])
    hot = rows(requests.keep_largest(df).filter("message_id = 'hot'"))
    assert len(hot) == 1 and hot[0]["input_tokens"] == 999 and hot[0]["line_no"] == 999


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    folder = tmp_path / "in" / "projects" / "p"
    folder.mkdir(parents=True)
    line = lambda m, n: json.dumps({"type": "assistant", "timestamp": "2024-01-01T00:00:00Z", "message": {"id": m, "model": "x", "usage": {"input_tokens": n}}}) + "\n"
    from usagelens.sources import transcripts

    def run():
        stream = jobs.stream_lines(spark, str(tmp_path / "in"), 1)
        parsed = transcripts.parse_lines(stream).select("file_path", "line_no", "h", "ts", "kind", "tier", "project", "file_session_id", "file_agent_id", "meta_path")
        jobs.run_available(transcripts.request_rows(parsed), jobs.batch_writer(str(tmp_path / "log")), str(tmp_path / "state"))
        return {r["message_id"]: r["input_tokens"] for r in rows(jobs.current_requests(jobs.read_batches(spark, str(tmp_path / "log"))))}

    (folder / "s.0001.jsonl").write_text(line("a", 1) + line("b", 5))
    (folder / "s.0002.jsonl").write_text(line("a", 4) + "{bad\n")
    assert run() == {"a": 4, "b": 5}
    assert run() == {"a": 4, "b": 5}  # nothing new
    (folder / "s.0003.jsonl").write_text(line("a", 9) + line("b", 2) + line("c", 1))
    assert run() == {"a": 9, "b": 5, "c": 1}


def test_merged_dashboard(spark):
    """Two machines, one with a cache: coverage has gaps, cached days count, weekdays and counters are summed."""
    from usagelens.plans import activity as plan

    make = lambda rows_, schema: spark.createDataFrame(rows_, schema)
    day = date
    models = make([(r, "x", 1, 10, 5, 0, None, None, 1, 16) for r in ("a", "b")],
                  "report_id string, model string, requests bigint, input_tokens bigint, output_tokens bigint, cache_creation_tokens bigint, cache_creation_5m_tokens bigint, cache_creation_1h_tokens bigint, cache_read_tokens bigint, total_tokens bigint")
    tables = {
        "hours": make([("a", 9, 2, 1), ("b", 9, 3, 0)], "report_id string, hour int, working bigint, prompt bigint"),
        "live_daily": make([("a", day(2024, 1, 10), 4, 1, 1), ("b", day(2024, 1, 10), 2, 1, 1), ("b", day(2024, 1, 12), 1, 0, 1)],
                           "report_id string, date date, working_events bigint, human_prompts bigint, sessions_started bigint"),
        "cached_daily": make([("a", day(2024, 1, 1), 5, 1, 2), ("a", day(2024, 1, 2), 5, 1, 2)],
                             "report_id string, date date, message_count bigint, session_count bigint, tool_call_count bigint"),
        "weekday_counts": make([("a", "working", 3, 4), ("b", "working", 3, 2)], "report_id string, series string, slot int, n bigint"),
        "spans": make([("a", "working", day(2024, 1, 3), day(2024, 1, 10)), ("b", "working", day(2024, 1, 8), day(2024, 1, 17))],
                      "report_id string, series string, first_date date, last_date date"),
        "tools": make([("a", "Read", 2), ("b", "Read", 5)], "report_id string, tool string, calls bigint"),
        "corpus": make([("a", 1, 2), ("b", 2, 3)], "report_id string, projects bigint, skills_injected bigint"),
        "projects": make([("a", "p1"), ("b", "p1"), ("b", "p2")], "report_id string, project string"),
        "prompt_hours": make([("a", 9, 2), ("b", 9, 1), ("b", 23, 1)], "report_id string, hour int, prompts bigint"),
        "prompt_source": make([("a", "history"), ("b", "transcripts")], "report_id string, prompt_source string"),
        "models": models,
    }
    merged = plan.merge_activity_tables(tables)
    cover = rows(merged["coverage"])[0]
    assert (str(cover["first_date"]), str(cover["last_date"]), cover["calendar_days"], cover["active_days"]) == ("2024-01-01", "2024-01-12", 12, 4)
    assert cover["longest_streak"] == 2 and cover["longest_gap"] > 0
    assert rows(merged["tools"]) == [{"tool": "Read", "calls": 7}] and rows(merged["corpus"]) == [{"projects": 2, "skills_injected": 5}]
    assert {r["project"] for r in rows(merged["projects"])} == {"p1", "p2"} and rows(merged["prompt_source"]) == [{"prompt_source": "transcripts"}]
    assert [(r["hour"], r["prompts"]) for r in rows(merged["prompt_hours"]) if r["prompts"]] == [(9, 3), (23, 1)]
    assert rows(merged["prompt_summary"])[0]["peak_hour"] == 9
    wednesday = next(r for r in rows(merged["weekdays"]) if r["day"] == 3)
    assert wednesday["working"] == 6 and wednesday["working_days"] == 3  # 3, 10 and 17 January
