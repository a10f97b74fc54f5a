"""JSON-lines transcripts: files to lines, lines to typed rows.

A line is parsed once into a Variant; typed columns are taken from it with `try_variant_get`, so a field
that is missing or of another type is null and never fails the job. Everything after `request_rows` works on
explicit schemas.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_variant, utf16_length
from ..operators.activity import PROMPT, WORKING
from ..operators.tools import TRACKED_TOOLS
from ..session import cut_lineage

# Openings of user-side lines that no person typed.
SYNTHETIC_PREFIXES = (
    "<task-notification",
    "<teammate-message",
    "Another Claude session sent a message",
    "<system-reminder",
    "<local-command-caveat",
    "<local-command-stdout",
    "<command-name",
    "<command-message",
    "This session is being continued from a previous conversation",
)
SYNTHETIC_MODEL = "<synthetic>"

# The three levels of the folder layout.
_MAIN = r"/projects/([^/]+)/([^/]+)\.jsonl$"
_SUBAGENT = r"/projects/([^/]+)/([^/]+)/subagents/agent-([^/]*)\.jsonl$"
_WORKFLOW = r"/projects/([^/]+)/([^/]+)/subagents/workflows/(wf_[^/]*)/agent-([^/]*)\.jsonl$"


def describe_path(df: DataFrame, path: str = "file_path") -> DataFrame:
    """Tier, project, session, agent, run and side-file path of a transcript path; other files are dropped."""
    p = F.col(path)
    tier = (
        F.when(F.rlike(p, F.lit(_WORKFLOW)), "workflow-agent")
        .when(F.rlike(p, F.lit(_SUBAGENT)), "subagent")
        .when(F.rlike(p, F.lit(_MAIN)), "main")
    )
    part = lambda main, sub, wf: (
        F.when(F.col("tier") == "main", F.regexp_extract(p, _MAIN, main) if main else F.lit(None))
        .when(F.col("tier") == "subagent", F.regexp_extract(p, _SUBAGENT, sub) if sub else F.lit(None))
        .when(F.col("tier") == "workflow-agent", F.regexp_extract(p, _WORKFLOW, wf) if wf else F.lit(None))
    )
    return df.withColumn("tier", tier).filter(F.col("tier").isNotNull()).withColumns({
        "project": part(1, 1, 1),
        "file_session_id": part(2, 2, 2),
        "file_agent_id": part(None, 3, 4),
        "run_id": part(None, None, 3),
    }).withColumn(
        "meta_path",
        F.when(F.col("tier") != "main", F.regexp_replace(p, r"\.jsonl$", ".meta.json")),
    )


def decoded_path(path: Column) -> Column:
    """A file's path as it is named: `_metadata.file_path` comes percent-encoded (a `+` is a `+` there)."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


# Splits of one file start at least this far apart (the file-open cost Spark packs by is 4 MiB).
_SPLIT_GRAIN = 1 << 20
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in the low 33 bits


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """Complete, non-empty lines of every transcript below `root`, with path columns and an order.

    The text source splits large files, so a file of any size is read by many tasks. `line_no` is not the
    line's number but orders the lines of a file: the split's offset first, then the row inside the split.
    Only a newline ends a line, and an unterminated tail (a line still being written) is left out.
    """
    row_in_split = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    split_no = F.floor(F.col("_metadata.file_block_start") / _SPLIT_GRAIN)
    raw = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
        .option("lineSep", "\n").text(root)
        .select(
            decoded_path(F.col("_metadata.file_path")).alias("file_path"),
            F.col("_metadata.file_size").alias("_size"),
            (F.shiftleft(split_no.cast("bigint"), _ROW_BITS) + row_in_split).alias("line_no"),
            F.col("value").alias("line"),
        )
    )
    return describe_path(drop_open_tails(raw).filter(F.col("line") != ""))


def drop_open_tails(lines: DataFrame, file: str = "file_path", order: str = "line_no", line: str = "line",
                    size: str = "_size") -> DataFrame:
    """Leave out the last line of files that do not end in a newline.

    Such a file holds one byte less than its lines with a newline each. The sizes are summed first, without the
    text, and written: what is joined back is one row per open file, of a size the optimizer sees, so the text
    of closed files does not move. The last line is told by its place among all bytes of its file.
    """
    sizes = lines.select(file, order, size, F.octet_length(line).alias("_n"))
    open_files = sizes.groupBy(file).agg(
        F.sum(F.col("_n") + 1).alias("_bytes"), F.max(size).alias("_file_bytes"), F.max(order).alias("_last")
    ).filter(F.col("_bytes") > F.col("_file_bytes"))
    open_files = cut_lineage(open_files.select(F.col(file).alias("_open"), "_last"), "open-files")
    tail = (F.col(file) == F.col("_open")) & (F.col(order) == F.col("_last"))
    return lines.join(open_files, tail, "left_anti").drop(size)


def split_lines(texts: DataFrame, content: str = "content") -> DataFrame:
    """The same rule for texts that already sit in a column: complete, non-empty lines with their number."""
    parts = F.split(F.col(content), "\n")
    complete = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    keep = [c for c in texts.columns if c != content]
    return texts.select(*keep, F.posexplode(complete).alias("line_no", "line")).filter(F.col("line") != "").withColumn(
        "line_no", F.col("line_no").cast("bigint")
    )


def transcript_files(lines: DataFrame) -> DataFrame:
    """One row per file with its path columns."""
    return lines.select("file_path", "tier", "project", "file_session_id", "file_agent_id", "run_id").distinct()


# ---------------------------------------------------------------------------
# parsing

# The fields of a line that any operator reads. Taken from the variant in one step: a missing field, or one
# of another type, is null without affecting its neighbours. Text-or-array fields stay variants.
LINE_TYPE = """struct<
  type:string, subtype:string, timestamp:string, requestId:string, sessionId:string, agentId:string, effort:string,
  isSidechain:boolean, isMeta:boolean, promptSource:string, version:string, cwd:string,
  message:struct<id:string, model:string, content:variant, usage:struct<
    input_tokens:bigint, output_tokens:bigint, cache_creation_input_tokens:bigint, cache_read_input_tokens:bigint,
    cache_creation:struct<ephemeral_5m_input_tokens:bigint, ephemeral_1h_input_tokens:bigint>,
    service_tier:string, speed:string, inference_geo:string>>,
  attachment:struct<type:string, path:string, skills:array<struct<name:string, path:string, content:variant>>,
    content:struct<path:string, content:variant>>,
  compactMetadata:struct<trigger:string, preTokens:bigint, postTokens:bigint, cumulativeDroppedTokens:bigint, durationMs:bigint>
>"""
BLOCK_TYPE = """array<struct<
  type:string, id:string, name:string, tool_use_id:string, is_error:boolean, content:variant,
  input:struct<command:string, content:string, new_string:string, old_string:string, name:string, path:string>
>>"""
PARTS_TYPE = "array<struct<text:variant>>"


def _computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column through a generator, which filters and projections are not pushed through.

    Parsing is far dearer than anything after it; without this the optimizer would copy the parse into every
    filter on a parsed field.
    """
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Replace the text by its typed fields `h`, and add `ts`, `line_type` and `kind`: corrupt, other,
    synthetic or record. Text that is not a JSON object counts as corrupt (`h` is null)."""
    parsed = _computed_once(lines, "h", F.try_variant_get(json_variant(line), "$", LINE_TYPE)).drop(line)
    kind = (
        F.when(F.col("h").isNull(), "corrupt")
        .when(~F.coalesce(F.col("h.type") == "assistant", F.lit(False)) | F.col("h.message.usage").isNull(), "other")
        .when(F.col("h.message.model") == SYNTHETIC_MODEL, "synthetic")
        .when(F.coalesce(F.col("h.message.id"), F.lit("")) == "", "other")
        .otherwise("record")
    )
    return parsed.withColumns({
        "kind": kind, "ts": F.try_to_timestamp(F.col("h.timestamp")), "line_type": F.col("h.type"),
    })


def request_rows(parsed: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Request rows of the `record` lines, in the explicit schema used by all request operators.

    `meta(meta_path, agent_type, model)` fills agent type and a missing model. Missing counts are 0; the
    cache-write split stays null when it was not reported.
    """
    records = parsed.filter(F.col("kind") == "record")
    if meta is not None:
        side = meta.select("meta_path", F.col("agent_type").alias("_agent_type"), F.col("model").alias("_model"))
        # the main tier has no side file: its rows all have a null key and stay where they are
        agents = records.filter(F.col("meta_path").isNotNull()).join(side, "meta_path", "left")
        records = records.filter(F.col("meta_path").isNull()).unionByName(agents, allowMissingColumns=True)
    else:
        none = F.lit(None).cast("string")
        records = records.withColumns({"_agent_type": none, "_model": none})
    usage = "h.message.usage"
    count = lambda name: F.coalesce(F.col(f"{usage}.{name}"), F.lit(0))
    return records.select(
        F.col("h.message.id").alias("message_id"),
        "ts",
        F.col("h.requestId").alias("request_id"),
        F.coalesce("h.sessionId", "file_session_id").alias("session_id"),
        "project",
        "tier",
        F.coalesce("h.agentId", "file_agent_id").alias("agent_id"),
        F.col("_agent_type").alias("agent_type"),
        F.coalesce("h.message.model", "_model").alias("model"),
        F.col("h.effort").alias("effort"),
        F.coalesce("h.isSidechain", F.col("tier") != "main").alias("is_sidechain"),
        F.col("h.version").alias("version"),
        count("input_tokens").alias("input_tokens"),
        count("output_tokens").alias("output_tokens"),
        count("cache_creation_input_tokens").alias("cache_creation_tokens"),
        F.col(f"{usage}.cache_creation.ephemeral_5m_input_tokens").alias("cache_creation_5m_tokens"),
        F.col(f"{usage}.cache_creation.ephemeral_1h_input_tokens").alias("cache_creation_1h_tokens"),
        count("cache_read_input_tokens").alias("cache_read_tokens"),
        F.col(f"{usage}.service_tier").alias("service_tier"),
        F.col(f"{usage}.speed").alias("speed"),
        F.col(f"{usage}.inference_geo").alias("inference_geo"),
        "file_path",
        "line_no",
    )


def _is_text(variant: Column) -> Column:
    return F.coalesce(F.schema_of_variant(variant) == "STRING", F.lit(False))


def _text(variant: Column) -> Column:
    return F.when(_is_text(variant), F.try_variant_get(variant, "$", "string"))


def is_synthetic_user(prefixes: Sequence[str] = SYNTHETIC_PREFIXES) -> Column:
    """Whether a user-side line was injected rather than typed.

    In order: the meta flag, a system or sdk source, any other stated source, then the opening of the text.
    """
    source = F.col("h.promptSource")
    text = F.ltrim(_text(F.col("h.message.content")))
    opening = reduce(or_, [F.startswith(text, F.lit(p)) for p in prefixes])
    return (
        F.when(F.col("h.isMeta"), True)
        .when(source.isin("system", "sdk"), True)
        .when(source.isNotNull(), False)
        .otherwise(F.coalesce(opening, F.lit(False)))
    )


def _with_blocks(parsed: DataFrame) -> DataFrame:
    """Add the content blocks of a line; null when the content is text or missing."""
    return _computed_once(parsed, "blocks", F.try_variant_get("h.message.content", "$", BLOCK_TYPE))


def activity_rows(parsed: DataFrame, prefixes: Sequence[str] = SYNTHETIC_PREFIXES) -> DataFrame:
    """Readable lines with `series` ('working', 'prompt' or null) and the number of tool calls.

    Assistant lines and tool results count as work in every tier; a user line counts as a prompt only in the
    main tier and when a person typed it.
    """
    has_result = F.coalesce(F.exists("blocks", lambda b: b["type"] == "tool_result"), F.lit(False))
    calls = F.size(F.filter("blocks", lambda b: (b["type"] == "tool_use") & (b["name"] != "")))
    series = (
        F.when(F.col("line_type") == "assistant", WORKING)
        .when((F.col("line_type") == "user") & has_result, WORKING)
        .when((F.col("line_type") == "user") & (F.col("tier") == "main") & ~is_synthetic_user(prefixes), PROMPT)
    )
    return _with_blocks(parsed.filter(F.col("kind") != "corrupt")).select(
        "file_path", "line_no", "project", "tier", "run_id", F.col("file_session_id").alias("session_id"), "file_agent_id", "ts",
        F.when(F.col("ts").isNotNull(), series).alias("series"),
        F.when(calls > 0, calls).otherwise(F.lit(0)).cast("bigint").alias("tool_calls"),
        F.col("h.cwd").alias("cwd"),
    )


# ---------------------------------------------------------------------------
# blocks, attachments, compactions


def _signal_lines(parsed: DataFrame) -> DataFrame:
    """Lines secondary signals are read from: neither corrupt nor of the synthetic model."""
    return parsed.filter(~F.col("kind").isin("corrupt", "synthetic"))


def block_rows(parsed: DataFrame, synthetic: bool = False) -> DataFrame:
    """One row per content block. Payload and attachment reports leave synthetic-model lines out; the
    activity counters keep them (`synthetic=True`)."""
    lines = parsed.filter(F.col("kind") != "corrupt") if synthetic else _signal_lines(parsed)
    return lines.select(
        "file_path", "project", "tier", F.col("file_session_id").alias("session_id"), "line_no", "line_type", "ts",
        F.posexplode(F.try_variant_get("h.message.content", "$", BLOCK_TYPE)).alias("block_no", "block"),
    )


def tool_calls(blocks: DataFrame, tracked: Sequence[str] | None = TRACKED_TOOLS) -> DataFrame:
    """Tool calls with the input fields that counters need; `tracked=None` keeps every tool."""
    calls = blocks.filter((F.col("block.type") == "tool_use") & (F.col("block.name") != "")).select(
        "file_path", "line_no", "ts", "session_id", "tier",
        F.col("block.id").alias("tool_use_id"),
        F.col("block.name").alias("tool"),
        F.col("block.input.command").alias("command"),
        F.col("block.input.content").alias("content"),
        F.col("block.input.new_string").alias("new_text"),
        F.col("block.input.old_string").alias("old_text"),
        F.col("block.input.name").alias("worktree_name"),
        F.col("block.input.path").alias("worktree_path"),
    )
    return calls if tracked is None else calls.filter(F.col("tool").isin(*tracked))


def tool_results(blocks: DataFrame) -> DataFrame:
    """Tool results of user lines with their size: the text, or the sum over text parts."""
    payload = F.col("block.content")
    zero = F.lit(0).cast("bigint")
    parts = F.aggregate(
        F.try_variant_get(payload, "$", PARTS_TYPE), zero,
        lambda size, part: size + F.coalesce(utf16_length(_text(part["text"])), zero),
    )
    return blocks.filter((F.col("block.type") == "tool_result") & (F.col("line_type") == "user")).select(
        "file_path", "line_no",
        F.col("block.tool_use_id").alias("tool_use_id"),
        F.col("ts").alias("result_ts"),
        F.coalesce(utf16_length(_text(payload)), parts, zero).alias("bytes"),
        F.coalesce("block.is_error", F.lit(False)).alias("is_error"),
    )


def attachment_rows(parsed: DataFrame) -> DataFrame:
    """Injected skills (one row each) and nested memory files: `(attachment, key, path, bytes)`."""
    size = lambda variant: F.coalesce(utf16_length(_text(variant)), F.lit(0).cast("bigint")).alias("bytes")
    base = ["file_path", "line_no", "ts", "project", F.col("file_session_id").alias("session_id")]
    lines = _signal_lines(parsed)
    skills = lines.filter(F.col("h.attachment.type") == "invoked_skills").select(
        *base, F.explode("h.attachment.skills").alias("s")
    ).select(
        "file_path", "line_no", "ts", "project", "session_id", F.lit("skill").alias("attachment"),
        F.col("s.name").alias("key"), F.col("s.path").alias("path"), size(F.col("s.content")),
    )
    path = F.coalesce("h.attachment.path", "h.attachment.content.path")
    memory = lines.filter(F.col("h.attachment.type") == "nested_memory").select(
        *base, F.lit("memory").alias("attachment"), path.alias("key"), path.alias("path"),
        size(F.col("h.attachment.content.content")),
    )
    return skills.unionByName(memory)


def injected_skills(attachments: DataFrame) -> DataFrame:
    """One row: how many skills were injected."""
    return attachments.agg(F.count_if(F.col("attachment") == "skill").alias("skills_injected"))


def compaction_rows(parsed: DataFrame) -> DataFrame:
    meta = "h.compactMetadata"
    events = _signal_lines(parsed).filter((F.col("line_type") == "system") & (F.col("h.subtype") == "compact_boundary"))
    return events.select(
        "file_path", "line_no", "ts", "project", F.col("file_session_id").alias("session_id"),
        F.coalesce(f"{meta}.trigger", F.lit("unknown")).alias("trigger"),
        F.col(f"{meta}.preTokens").alias("pre_tokens"), F.col(f"{meta}.postTokens").alias("post_tokens"),
        F.col(f"{meta}.cumulativeDroppedTokens").alias("dropped_tokens"), F.col(f"{meta}.durationMs").alias("duration_ms"),
    )
