"""Calls and results, payloads, attachments, compactions and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import activity, tools
from ..sources import transcripts
from .core import register
from .views import Views


@register("jn02_call_result_pairs", """
  SELECT conv_id, tool_use_id, call_line_no, result_line_no, tool, bytes, is_error FROM v_calls""", ["v_calls"])
def _(v: Views) -> DataFrame:
    return v.paired_turns


@register("jn02_pairs_across_chunks", """
  SELECT event_type = 'purchase' AS dummy, user_id, k, call_event, event_id AS result_event FROM (
    SELECT *, user_id % 10 AS g, lag(event_type) OVER w AS before, lag(event_id) OVER w AS call_event FROM v_events
    WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id % 10, k % 3 ORDER BY event_id))
  WHERE event_type = 'purchase' AND before = 'click'""", ["v_events"])
def _(v: Views) -> DataFrame:
    """Small chunks, so that most pairs of these few busy keys cross chunk edges."""
    rows = v.events.select((F.col("user_id") % 10).alias("g"), (F.col("k") % 3).alias("h"), "event_id", "event_type", "user_id", "k")
    calls = rows.filter(F.col("event_type") == "click").select("g", "h", "event_id")
    results = rows.filter(F.col("event_type") == "purchase").select("g", "h", "event_id", "user_id", "k")
    paired = tools.pair_calls(calls, results, ["g", "h"], "event_id", chunk=50)
    return paired.select(F.lit(True).alias("dummy"), "user_id", "k", F.col("call_event_id").alias("call_event"),
                         F.col("result_event_id").alias("result_event"))


@register("ag19_tool_payload", """
  SELECT tool, count(*) AS calls, sum(bytes)::BIGINT AS total_bytes, avg(bytes) AS mean_bytes, max(bytes) AS max_bytes,
    count(*) FILTER (WHERE is_error) AS errors FROM v_calls GROUP BY tool""", ["v_calls"], doubles=["mean_bytes"])
def _(v: Views) -> DataFrame:
    return tools.tool_payload_table(v.paired_turns)


@register("tk02_top_tools_by_bytes", """
  SELECT tool, total_bytes FROM (SELECT tool, sum(bytes)::BIGINT AS total_bytes FROM v_calls GROUP BY tool)
  ORDER BY total_bytes DESC, tool LIMIT 8""", ["v_calls"])
def _(v: Views) -> DataFrame:
    table = tools.tool_payload_table(v.paired_turns).select("tool", "total_bytes")
    return table.orderBy(F.col("total_bytes").desc(), "tool").limit(8)


@register("flt05_tracked_tools", """
  SELECT tool, count(*) AS calls FROM (
    SELECT CASE k % 4 WHEN 0 THEN 'Read' WHEN 1 THEN 'Bash' WHEN 2 THEN 'Edit' ELSE 'Write' END AS tool FROM v_lines
    WHERE event_type = 'click') WHERE tool IN ('Read', 'Edit') GROUP BY tool""", ["v_lines"])
def _(v: Views) -> DataFrame:
    calls = transcripts.tool_calls(transcripts.block_rows(v.parsed), ("Read", "Edit"))
    return tools.tool_use_counts(calls)


@register("ag35_tool_use_counts", """
  SELECT CASE k % 4 WHEN 0 THEN 'Read' WHEN 1 THEN 'Bash' WHEN 2 THEN 'Edit' ELSE 'Write' END AS tool, count(*) AS calls
  FROM v_lines WHERE event_type = 'click' GROUP BY 1""", ["v_lines"])
def _(v: Views) -> DataFrame:
    return tools.tool_use_counts(transcripts.tool_calls(transcripts.block_rows(v.parsed, synthetic=True), None))


@register("ag35_tool_use_counters", """
  SELECT tier, count(*) FILTER (WHERE k % 4 = 1 AND k % 3 = 0) AS git_commit, count(*) FILTER (WHERE k % 4 = 1 AND k % 3 = 1) AS git_push,
    0::BIGINT AS git_worktree_add, 0::BIGINT AS git_worktree_remove,
    coalesce(sum(CASE WHEN k % 5 > 0 THEN k % 5 + 1 ELSE 0 END) FILTER (WHERE k % 4 = 3), 0)::BIGINT AS lines_written,
    (2 * count(*) FILTER (WHERE k % 4 = 2))::BIGINT AS edit_lines_added, count(*) FILTER (WHERE k % 4 = 2) AS edit_lines_removed,
    0::BIGINT AS worktrees_created, 0::BIGINT AS worktrees_entered, 0::BIGINT AS worktree_names
  FROM v_lines WHERE event_type = 'click' GROUP BY tier""", ["v_lines"])
def _(v: Views) -> DataFrame:
    return tools.tool_use_counters(transcripts.tool_calls(transcripts.block_rows(v.parsed, synthetic=True), None), ["tier"])


@register("ag35_corpus_counters", """
  SELECT count(DISTINCT project) AS projects, 0::BIGINT AS worktree_labels,
    count(DISTINCT user_id % 4) FILTER (WHERE tier = 'workflow-agent') AS workflow_runs,
    count(DISTINCT user_id) FILTER (WHERE tier = 'subagent') AS subagent_files,
    count(DISTINCT user_id) FILTER (WHERE tier = 'workflow-agent') AS workflow_agent_files FROM v_lines""", ["v_lines"])
def _(v: Views) -> DataFrame:
    return activity.corpus_counters(transcripts.transcript_files(v.lines))


def _attachment_lines(v: Views) -> DataFrame:
    """Documents as lines that inject: two skills for each third, a memory file for the others."""
    d, skill = v.table("documents"), lambda name, path: F.struct(F.col(name).alias("name"), F.col(path).alias("path"), F.col("lang").alias("content"))
    skills = F.struct(F.lit("invoked_skills").alias("type"), F.array(skill("source", "lang"), skill("lang", "source")).alias("skills"))
    memory = F.struct(F.lit("nested_memory").alias("type"), F.col("source").alias("path"), F.struct(F.lit("x").alias("path"), F.col("lang").alias("content")).alias("content"))
    line = lambda attachment: F.to_json(F.struct(F.lit("attachment").alias("type"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), attachment.alias("attachment")))
    lines = d.select(F.concat(F.lit("/logs/projects/p"), F.col("source"), F.lit("-claude-worktrees-w"), F.col("lang"), F.lit("/s.jsonl")).alias("file_path"), F.col("doc_id").alias("line_no"),
                     F.when(F.col("doc_id") % 3 == 0, line(skills)).otherwise(line(memory)).alias("line"))
    return transcripts.describe_path(lines)


_ATTACHED = """(SELECT 'skill' AS attachment, doc_id, source AS key, lang AS path, length(lang) AS bytes FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT 'skill', doc_id, lang, source, length(lang) FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT 'memory', doc_id, source, source, length(lang) FROM documents WHERE doc_id % 3 <> 0)"""


@register("ag39_attachment_rows", f"SELECT attachment, doc_id AS line_no, key, path, bytes FROM {_ATTACHED}")
def _(v: Views) -> DataFrame:
    return transcripts.attachment_rows(transcripts.parse_lines(_attachment_lines(v))).select("attachment", "line_no", "key", "path", "bytes")


@register("ag35_injected_skills", f"""
  SELECT count(*) FILTER (WHERE attachment = 'skill') AS skills_injected, (SELECT count(DISTINCT lang) FROM documents) AS worktree_labels FROM {_ATTACHED}""")
def _(v: Views) -> DataFrame:
    """Injected skills, beside the working-copy labels of their folders."""
    lines = _attachment_lines(v)
    labels = activity.corpus_counters(transcripts.transcript_files(lines)).select("worktree_labels").scalar()
    return transcripts.injected_skills(transcripts.attachment_rows(transcripts.parse_lines(lines))).withColumn("worktree_labels", labels)


@register("ag18_compaction_summary", """
  SELECT count(*) AS compactions, count(*) FILTER (WHERE trigger = 'manual') AS manual, count(*) FILTER (WHERE trigger = 'auto') AS auto,
    count(*) FILTER (WHERE trigger IS NULL) AS other, sum(dropped_tokens)::BIGINT AS dropped_tokens, sum(pre_tokens)::BIGINT AS pre_sum,
    sum(post_tokens)::BIGINT AS post_sum, sum(duration_ms)::BIGINT AS duration_sum, count(duration_ms) AS duration_count,
    sum(pre_tokens)::DOUBLE / count(*) AS avg_pre_tokens, sum(post_tokens)::DOUBLE / count(*) AS avg_post_tokens, avg(duration_ms) AS avg_duration_ms
  FROM v_compactions""", ["v_compactions"], doubles=["avg_pre_tokens", "avg_post_tokens", "avg_duration_ms"])
def _(v: Views) -> DataFrame:
    return tools.compaction_summary(v.compaction_events)


@register("ag39_tk01_top_attachments", """
  SELECT coalesce(source, 'unknown') AS key, count(*) AS count, sum(n_chars)::BIGINT AS total_bytes FROM documents
  GROUP BY 1 ORDER BY total_bytes DESC, key LIMIT 15""")
def _(v: Views) -> DataFrame:
    return tools.top_by_bytes(v.table("documents"), "source", "n_chars")


@register("sc05_06_text_measures", r"""
  SELECT doc_id, (length(text) + length(regexp_replace(text, '[\x{0}-\x{FFFF}]', '', 'g')))::BIGINT AS utf16_units, strlen(text)::BIGINT AS utf8_bytes,
    CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS lines FROM documents""", ints=["lines"])
def _(v: Views) -> DataFrame:
    return v.table("documents").select(
        "doc_id", text.utf16_length("text").alias("utf16_units"), text.utf8_length("text").alias("utf8_bytes"),
        text.line_count("text").alias("lines"),
    )


@register("sc07_identity_hash", """
  SELECT c_custkey, substr(sha256(lower(trim(concat('  ', c_name, '@Mail.example ')))), 1, 16) AS identity FROM customer""")
def _(v: Views) -> DataFrame:
    address = F.concat(F.lit("  "), F.col("c_name"), F.lit("@Mail.example "))
    return v.table("customer").select("c_custkey", text.identity_hash(address).alias("identity"))


@register("sc08_09_remote_addresses", """
  SELECT page_id, concat(host, path) AS remote, array_to_string(string_split(trim(concat(host, regexp_replace(path, '/+', '/', 'g')), '/'), '/')[-2:], '/') AS owner_repo,
    concat(host, '/', 'team/', page_id) AS scp_remote
  FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host,
      regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '[.]git$', '') AS path FROM pages)""")
def _(v: Views) -> DataFrame:
    pages = v.table("pages")
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    with_login = F.regexp_replace("url", "^([a-z]+://)", "$1user:token@")
    scp = F.concat(F.lit("git@"), host, F.lit(":team/"), F.col("page_id").cast("string"), F.lit(".git"))
    remote = text.sanitize_remote(with_login)
    return pages.select("page_id", remote.alias("remote"), text.owner_repo(remote).alias("owner_repo"),
                        text.sanitize_remote(scp).alias("scp_remote"))


@register("sc11_worktree_label", """
  SELECT c_custkey, nullif(regexp_extract(project, '-claude-worktrees-([^/]+)$', 1), '') AS label
  FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat('home-x--claude-worktrees-', c_name) ELSE c_name END AS project FROM customer)""")
def _(v: Views) -> DataFrame:
    project = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("home-x--claude-worktrees-"), F.col("c_name"))).otherwise(F.col("c_name"))
    return v.table("customer").select("c_custkey", text.worktree_label(project).alias("label"))
