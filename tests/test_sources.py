"""Readers on a small hand-made corpus, with the awkward lines a real one has."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from usagelens.operators import requests, tools
from usagelens.plans import activity as activity_plan
from usagelens.plans import usage
from usagelens.sources import reports, sidecars, transcripts


def assistant(mid="m1", ts="2024-03-01T10:00:00.000Z", content="hi", model="model-a", usage=None, **extra):
    usage = {"input_tokens": 10, "output_tokens": 5} if usage is None else usage
    return {"type": "assistant", "timestamp": ts, "message": {"id": mid, "model": model, "content": content, "usage": usage}, **extra}


def call(tool_id, name="Read", **fields):
    return {"type": "tool_use", "id": tool_id, "name": name, "input": fields}


def result(tool_id, content, **extra):
    return {"type": "tool_result", "tool_use_id": tool_id, "content": content, **extra}


def user(content, ts="2024-03-01T10:01:00Z", **extra):
    return {"type": "user", "timestamp": ts, "message": {"content": content}, **extra}


MAIN = [
    assistant("m1", usage={"input_tokens": 1}),
    assistant("m1", usage={"input_tokens": 9, "output_tokens": 9, "cache_creation_input_tokens": 4,
                           "cache_creation": {"ephemeral_5m_input_tokens": 4, "ephemeral_1h_input_tokens": 0}}),
    assistant("m1", usage={"input_tokens": 18}),  # ties do not replace the first
    "{broken",
    "null",
    "",
    assistant("m2", model="<synthetic>", content=[call("s1")]),
    assistant(None),
    {"type": "assistant", "timestamp": "2024-03-01T10:00:00Z", "message": {"id": "m3", "model": "x"}},
    assistant("m4", ts=None),
    assistant("m5", ts="not a time"),
    assistant("m6", content=[call("t1", "Bash", command="git commit -m x && git push"), call("t2", "Write", content="a\nb\n")], sessionId="other", isSidechain=True),
    user([result("t1", "ok 😀")]),
    user([result("t1", "late, ignored")]),
    user([result("t2", [{"text": "abc"}, {"text": "de"}, {"image": 1}], is_error=True), result("t9", "no call")]),
    user("typed by hand"),
    user("  <system-reminder> injected"),
    user("<command-name>x", promptSource="typed"),
    user("loop", promptSource="system"),
    user("meta", isMeta=True),
    {"type": "system", "subtype": "compact_boundary", "timestamp": "2024-03-01T11:00:00Z", "compactMetadata": {"trigger": "auto", "preTokens": 100, "postTokens": 10}},
    {"type": "system", "subtype": "compact_boundary", "timestamp": "2024-03-01T11:00:00Z"},
    {"type": "x", "timestamp": "2024-03-01T11:00:00Z", "attachment": {"type": "invoked_skills", "skills": [{"name": "s", "content": "12345"}, {"content": 5}]}},
    {"type": "x", "timestamp": "2024-03-01T11:00:00Z", "attachment": {"type": "nested_memory", "content": {"path": "/p", "content": "é😀"}}},
]


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    session = root / "projects" / "proj-a" / "sess-1" / "subagents"
    flow = session / "workflows" / "wf_7"
    flow.mkdir(parents=True)
    (root / "projects" / "proj-b--claude-worktrees-blue").mkdir()
    dump = lambda lines: "".join((x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)) + "\n" for x in lines)
    (root / "projects" / "proj-a" / "sess-1.jsonl").write_text(dump(MAIN) + json.dumps(assistant("open-tail")), encoding="utf-8")
    (session / "agent-a1.jsonl").write_text(dump([assistant("m7", model=None), user("task text")]), encoding="utf-8")
    (session / "agent-a1.meta.json").write_text(json.dumps({"agentType": "explorer", "model": "model-side"}))
    (flow / "agent-w1.jsonl").write_text(dump([assistant("m8")]))
    (flow / "agent-w1.meta.json").write_text("{corrupt")
    (flow / "journal.jsonl").write_text(dump([assistant("not counted")]))
    (root / "projects" / "proj-b--claude-worktrees-blue" / "sess-2.jsonl").write_text(dump([assistant("m1", usage={"input_tokens": 500}), assistant("m9")]))
    (root / "wf_7.json").write_text(json.dumps({"name": "w", "script": "é" * 300}))
    return root


@pytest.fixture(scope="module")
def parsed(spark, corpus):
    return transcripts.parse_lines(transcripts.read_lines(spark, str(corpus)))


def test_lines_and_paths(spark, corpus):
    lines = transcripts.read_lines(spark, str(corpus))
    per_file = {r["file_path"].rsplit("/", 1)[1]: r for r in rows(lines.groupBy("file_path", "tier", "project", "run_id", "file_agent_id").count())}
    assert set(per_file) == {"sess-1.jsonl", "agent-a1.jsonl", "agent-w1.jsonl", "sess-2.jsonl"}
    assert per_file["sess-1.jsonl"]["count"] == len(MAIN) - 1  # the empty line and the open tail are not lines
    assert per_file["agent-w1.jsonl"]["tier"] == "workflow-agent" and per_file["agent-w1.jsonl"]["run_id"] == "wf_7"
    assert per_file["agent-a1.jsonl"]["file_agent_id"] == "a1"
    order = [r["line"] for r in lines.filter(F.col("file_path").endswith("sess-1.jsonl")).orderBy("line_no").collect()]
    assert order == [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in MAIN if x != ""]


def test_lines_of_a_split_file_keep_their_order(spark, tmp_path):
    folder = tmp_path / "projects" / "p"
    folder.mkdir(parents=True)
    text = [json.dumps({"n": i, "pad": "x" * 900}) for i in range(14_000)]  # about 13 MB, several splits
    (folder / "big.jsonl").write_text("\n".join(text) + "\n")
    (folder / "small.jsonl").write_text('{"n": -1}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(4 << 20))
    try:
        lines = transcripts.read_lines(spark, str(tmp_path))
        assert lines.filter(F.col("file_path").endswith("big.jsonl")).count() == len(text)
        got = [r[0] for r in lines.filter(F.col("file_path").endswith("big.jsonl")).orderBy("line_no")
               .select(F.get_json_object("line", "$.n").cast("int")).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(range(len(text)))


def test_kinds_and_quality(parsed):
    kinds = {r["kind"]: r["count"] for r in rows(parsed.filter(F.col("file_path").endswith("sess-1.jsonl")).groupBy("kind").count())}
    assert kinds["corrupt"] == 2 and kinds["synthetic"] == 1 and kinds["record"] == 6
    (q,) = rows(requests.scan_quality(parsed, since=F.lit("2024-03-01T10:30:00Z").cast("timestamp")))
    assert (q["files_scanned"], q["corrupt_lines"], q["undated_lines"]) == (4, 2, 2)


def test_requests_and_dedup(spark, parsed, corpus):
    table = transcripts.request_rows(parsed, sidecars.read_agent_meta(spark, str(corpus)))
    kept = {r["message_id"]: r for r in rows(requests.keep_largest(table))}
    assert set(kept) == {"m1", "m4", "m5", "m6", "m7", "m8", "m9"}
    assert kept["m1"]["input_tokens"] == 500 and kept["m1"]["cache_creation_5m_tokens"] is None
    in_file = {r["message_id"]: r for r in rows(requests.keep_largest(table, ["message_id", "file_path"])) if r["file_path"].endswith("sess-1.jsonl")}
    assert in_file["m1"]["output_tokens"] == 9 and in_file["m1"]["cache_creation_1h_tokens"] == 0
    assert kept["m4"]["ts"] is None and kept["m5"]["ts"] is None
    assert kept["m6"]["session_id"] == "other" and kept["m6"]["is_sidechain"]
    assert kept["m7"]["agent_type"] == "explorer" and kept["m7"]["model"] == "model-side" and kept["m7"]["is_sidechain"]
    assert kept["m8"]["agent_type"] is None and kept["m8"]["tier"] == "workflow-agent"


def test_pairs_sizes_and_counters(parsed):
    blocks = transcripts.block_rows(parsed)
    paired = tools.pair_calls(transcripts.tool_calls(blocks), transcripts.tool_results(blocks))
    table = {r["tool"]: r for r in rows(tools.tool_payload_table(paired))}
    assert table["Bash"]["calls"] == 1 and table["Bash"]["total_bytes"] == 5  # an emoji is two units
    assert (table["Write"]["total_bytes"], table["Write"]["errors"]) == (5, 1)
    (c,) = rows(tools.tool_use_counters(transcripts.tool_calls(transcripts.block_rows(parsed, synthetic=True), None)))
    assert (c["git_commit"], c["git_push"], c["lines_written"]) == (1, 1, 3)


def test_repeated_calls_and_early_results(spark):
    calls = spark.createDataFrame([("f", "a", 1, "one"), ("f", "a", 5, "two"), ("f", "a", 6, "three"), ("f", "b", 9, "x")], "file_path string, tool_use_id string, line_no bigint, tool string")
    results = spark.createDataFrame([("f", "a", 0), ("f", "a", 3), ("f", "a", 4), ("f", "a", 8), ("f", "b", 9)], "file_path string, tool_use_id string, line_no bigint")
    want = [("a", 1, 3, "one"), ("a", 6, 8, "three"), ("b", 9, 9, "x")]
    for chunk in (1, 2, 3, 100):
        got = rows(tools.pair_calls(calls, results, chunk=chunk), "tool_use_id", "call_line_no")
        assert [(r["tool_use_id"], r["call_line_no"], r["result_line_no"], r["tool"]) for r in got] == want


def test_prompts_and_work(parsed):
    lines = transcripts.activity_rows(parsed)
    main = lines.filter(F.col("file_path").endswith("sess-1.jsonl"))
    counts = {r["series"]: r["count"] for r in rows(main.groupBy("series").count())}
    assert counts["prompt"] == 2  # typed by hand, and the one whose source says typed
    assert rows(lines.filter(F.col("tier") == "subagent").groupBy("series").count(), "series")[0]["series"] is None


def test_attachments_and_compactions(parsed):
    got = {(r["attachment"], r["key"]): r["bytes"] for r in rows(transcripts.attachment_rows(parsed))}
    assert got == {("skill", "s"): 5, ("skill", None): 0, ("memory", "/p"): 3}
    top = {r["key"]: r for r in rows(tools.top_by_bytes(transcripts.attachment_rows(parsed), "key"))}
    assert top["unknown"]["count"] == 1
    (c,) = rows(tools.compaction_summary(transcripts.compaction_rows(parsed)))
    assert (c["compactions"], c["auto"], c["other"], c["avg_pre_tokens"], c["avg_duration_ms"]) == (2, 1, 1, 50.0, None)


def test_workflow_definition(spark, corpus):
    (d,) = rows(sidecars.read_workflow_definitions(spark, str(corpus)))
    assert d["script_bytes"] == 600 and d["script_preview"] == "é" * 200 and json.loads(d["fields"]) == {"name": "w"}


def test_prompt_log_and_cache(spark, tmp_path):
    log = [{"display": "/clear", "timestamp": 1709287200000, "project": "p", "sessionId": "s"}, {"display": "x", "timestamp": "1709287200000"}, {"display": "y"}]
    (tmp_path / "history.jsonl").write_text("".join(json.dumps(x) + "\n" for x in log) + "{bad\n")
    got = rows(sidecars.read_prompt_log(spark, str(tmp_path / "history.jsonl")))
    assert sorted(str(r["ts"]) for r in got) == ["2024-03-01 10:00:00", "None", "None", "None"]
    (tmp_path / "cache.json").write_text(json.dumps({"lastComputedDate": "2024-02-01", "dailyActivity": [{"date": "2024-01-31", "messageCount": 3}], "modelUsage": {"a": {"inputTokens": 7}}}))
    cache = sidecars.read_usage_cache(spark, str(tmp_path / "cache.json"))
    assert rows(sidecars.cached_daily(cache))[0]["message_count"] == 3
    assert rows(sidecars.cached_model_usage(cache))[0]["input_tokens"] == 7
    (tmp_path / "broken.json").write_text("[1]")
    assert sidecars.read_usage_cache(spark, str(tmp_path / "broken.json")).count() == 0


def test_numstat_log(spark):
    raw = "\x1eabc\x1f2024-01-02T23:30:00-05:00\x1fMe@X.example\n\n3\t1\ta.py\n-\t-\tlogo.png\n\x1edef\x1f2024-01-03T01:00:00+02:00\x1fyou@x.example\n"
    commits, files = sidecars.parse_numstat_log(spark.createDataFrame([("r", raw)], "repo string, value string"))
    assert [(r["hash"], r["email"]) for r in rows(commits, "hash")] == [("abc", "me@x.example"), ("def", "you@x.example")]
    assert files.count() == 2


def test_reports_round_trip(spark, tmp_path, parsed):
    root = str(tmp_path / "reports")
    with pytest.raises(reports.NoBaselineError):
        reports.latest_baseline(spark, root)
    kept = requests.keep_largest(transcripts.request_rows(parsed))
    for report, mode, at in (("b1", "baseline", "2024-01-01T00:00:00Z"), ("b2", "baseline", "2024-01-02T00:00:00Z"), ("c1", "compare", "2024-01-03T00:00:00Z"), ("a1", "activity", "2024-01-04T00:00:00Z")):
        reports.save_report({"models": requests.totals_by_key(kept, "model", "model")}, root, report, mode, at)
    assert reports.latest_baseline(spark, root) == "b2"
    assert reports.check_mergeable(spark, root, ["b1", "c1"]) == "usage"
    for bad in (["b1"], ["b1", "a1"], ["b1", "nothing"]):
        with pytest.raises(reports.MergeInputError):
            reports.check_mergeable(spark, root, bad)
    one, two = (reports.load_table(spark, root, "models", ids).agg(F.sum("requests")).first()[0] for ids in (["b1"], ["b1", "c1"]))
    assert two == 2 * one


def test_plans_end_to_end(spark, parsed):
    prices = spark.createDataFrame([("model-a", 3.0, 15.0, None)], "model string, input_rate double, output_rate double, cache_read_multiplier double")
    tables = activity_plan.activity_tables(parsed, prices, tz="Asia/Tokyo")
    hours = {r["hour"]: r for r in rows(tables["hours"])}
    assert hours[19]["prompt"] == 2 and sum(r["prompt"] for r in hours.values()) == 2
    assert rows(tables["coverage"])[0]["active_days"] == 1
    saved = {k: tables[k].withColumn("report_id", F.lit("r1")).unionByName(tables[k].withColumn("report_id", F.lit("r2"))) for k in ("hours", "daily", "tools", "models")}
    merged = activity_plan.merge_activity_tables(saved)
    assert sum(r["working"] for r in rows(merged["hours"])) == 2 * sum(r["working"] for r in hours.values())
    kept = requests.keep_largest(transcripts.request_rows(parsed))
    definitions = spark.createDataFrame([("w1", "{}", 5, "x"), ("w2", "{}", 7, "y")], "file_path string, fields string, script_bytes bigint, script_preview string")
    report = usage.usage_tables(kept, resamples=20, prices=prices, lines=parsed, definitions=definitions)
    assert rows(report["totals"])[0]["requests"] == 7 and report["intervals"].count() == 6
    cost, shares = rows(report["cost"])[0], rows(report["shares"])[0]
    assert cost["requests"] == 7 and cost["cost"] > 0 and abs(sum(shares[c] for c in ("input_pct", "output_pct", "cache_write_pct", "cache_read_pct")) - 100) < 1e-9
    assert {r["metric"] for r in rows(report["standing"])} >= {"spend", "requests"} and rows(report["workflows"])[0]["script_bytes"] == 12
    saved = {k: report[k].withColumn("report_id", F.explode(F.array(F.lit("a"), F.lit("b")))) for k in ("totals", "models", "agents", "scan", "definitions")}
    merged = usage.merge_usage_tables(saved, prices=prices)
    assert abs(rows(merged["cost"])[0]["cost"] - 2 * cost["cost"]) < 1e-12 and rows(merged["profile"])[0]["cost_per_request"] == rows(report["profile"])[0]["cost_per_request"]
    assert rows(merged["scan"])[0]["lines_read"] == 2 * rows(report["scan"])[0]["lines_read"] and rows(merged["workflows"])[0]["definitions"] == 2


def test_long_strings_and_repeated_keys(spark):
    long = '{"type":"user","message":{"content":"' + "x" * 25_000_000 + '"}}'
    twice = '{"type":"user","type":"assistant"}'
    df = spark.createDataFrame([(long,), (twice,), ("[1]",), ("{broken",), ("7",)], "line string")
    got = [(r["kind"], r["line_type"]) for r in transcripts.parse_lines(df).select("kind", "line_type").collect()]
    assert got == [("other", "user"), ("other", "assistant"), ("corrupt", None), ("corrupt", None), ("corrupt", None)]


def test_named_folders_and_open_tails(spark, tmp_path):
    folder = tmp_path / "logs" / "projects" / "my proj+é 100%"
    folder.mkdir(parents=True)
    (folder / "closed.jsonl").write_bytes(b'{"a":1}\n\n{"a":2}\n')
    (folder / "open.jsonl").write_bytes(b'{"a":3}\n{"a":4')
    lines = transcripts.read_lines(spark, str(tmp_path / "logs"))
    got = sorted((r["project"], r["file_session_id"], r["line"]) for r in lines.collect())
    assert got == [("my proj+é 100%", "closed", '{"a":1}'), ("my proj+é 100%", "closed", '{"a":2}'), ("my proj+é 100%", "open", '{"a":3}')]
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_numbers_that_are_no_time(spark):
    df = spark.createDataFrame([('{"display":"a","timestamp":1e300}',), ('{"display":"b","timestamp":1000}',)], "line string")
    got = {r["display"]: r["ts"] for r in sidecars.parse_prompt_log(df).collect()}
    assert got["a"] is None and got["b"] is not None


def test_commit_log_from_a_file(spark, tmp_path):
    (tmp_path / "log.txt").write_bytes(b"\x1eh1\x1f2024-01-01\x1fA@B.c\n1\t2\tx.py\n\x1eh2\x1f2024-01-02\x1f\n-\t-\tpic\n")
    commits, files = sidecars.read_numstat_log(spark, str(tmp_path / "log.txt"), "r")
    assert sorted((r["hash"], r["email"]) for r in commits.collect()) == [("h1", "a@b.c"), ("h2", "")]
    assert sorted((r["hash"], r["added"], r["path"]) for r in files.collect()) == [("h1", "1", "x.py"), ("h2", "-", "pic")]
