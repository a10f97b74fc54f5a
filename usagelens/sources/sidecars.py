"""Small files beside the transcripts, the prompt log and commit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_variant, utf8_length
from .transcripts import decoded_path

PREVIEW_CHARS = 200
RECORD_SEPARATOR, FIELD_SEPARATOR = "\x1e", "\x1f"
# Milliseconds from 1970 that a time value of the log's own format can hold, either way (fixed value).
MAX_MILLIS = 8.64e15


def read_texts(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Small files as `(file_path, content)`, one row per file."""
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("wholetext", "true")
        .text(root).select(decoded_path(F.col("_metadata.file_path")).alias("file_path"), F.col("value").alias("content"))
    )


def _documents(texts: DataFrame, content: str) -> DataFrame:
    """Parsed JSON objects `v`; texts that do not parse to an object are left out."""
    parsed = texts.withColumn("v", json_variant(content))
    return parsed.filter(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("v"), path, kind)


def parse_agent_meta(texts: DataFrame, content: str = "content", path: str = "file_path") -> DataFrame:
    """`(meta_path, agent_type, model)` of agent side files."""
    return _documents(texts, content).select(
        F.col(path).alias("meta_path"), _get("$.agentType").alias("agent_type"), _get("$.model").alias("model")
    )


def read_agent_meta(spark: SparkSession, root: str) -> DataFrame:
    return parse_agent_meta(read_texts(spark, root, "agent-*.meta.json"))


def parse_workflow_definitions(texts: DataFrame, content: str = "content", path: str = "file_path") -> DataFrame:
    """Definitions with all their fields but the script, its byte length and a short preview."""
    script = _get("$.script")
    is_text = F.coalesce(F.schema_of_variant(_get("$.script", "variant")) == "STRING", F.lit(False))
    fields = F.map_filter(_get("$", "map<string,variant>"), lambda key, _: key != "script")
    return _documents(texts, content).select(
        path,
        F.to_json(fields).alias("fields"),
        F.when(is_text, utf8_length(script)).otherwise(F.lit(0).cast("bigint")).alias("script_bytes"),
        F.when(is_text, F.substring(script, 1, PREVIEW_CHARS)).alias("script_preview"),
    )


def read_workflow_definitions(spark: SparkSession, root: str) -> DataFrame:
    return parse_workflow_definitions(read_texts(spark, root, "wf_*.json"))


def workflow_totals(definitions: DataFrame) -> DataFrame:
    return definitions.agg(
        F.count(F.lit(1)).alias("definitions"), F.coalesce(F.sum("script_bytes"), F.lit(0)).alias("script_bytes")
    )


def read_usage_cache(spark: SparkSession, path: str) -> DataFrame:
    """The usage cache file; no row when it is corrupt. A missing file is an empty table for the caller."""
    texts = spark.read.option("wholetext", "true").text(path).withColumnRenamed("value", "content")
    return parse_usage_cache(texts)


def parse_usage_cache(texts: DataFrame, content: str = "content") -> DataFrame:
    """The all-time usage cache as one typed row per document."""
    daily = "array<struct<date:string,messageCount:bigint,sessionCount:bigint,toolCallCount:bigint>>"
    usage = "map<string,struct<inputTokens:bigint,outputTokens:bigint,cacheReadInputTokens:bigint,cacheCreationInputTokens:bigint>>"
    longest = "struct<sessionId:string,duration:bigint,messageCount:bigint,timestamp:string>"
    return _documents(texts, content).select(
        F.to_date(_get("$.lastComputedDate")).alias("last_computed_date"),
        _get("$.dailyActivity", daily).alias("daily"),
        _get("$.modelUsage", usage).alias("model_usage"),
        _get("$.totalSessions", "bigint").alias("total_sessions"),
        _get("$.totalMessages", "bigint").alias("total_messages"),
        _get("$.firstSessionDate").alias("first_session_date"),
        _get("$.longestSession", longest).alias("longest_session"),
    )


def cached_daily(cache: DataFrame) -> DataFrame:
    return cache.select(F.inline("daily")).select(
        F.to_date("date").alias("date"), F.col("messageCount").alias("message_count"),
        F.col("sessionCount").alias("session_count"), F.col("toolCallCount").alias("tool_call_count"),
    )


def cached_model_usage(cache: DataFrame) -> DataFrame:
    counts = {
        "input_tokens": "inputTokens", "output_tokens": "outputTokens",
        "cache_creation_tokens": "cacheCreationInputTokens", "cache_read_tokens": "cacheReadInputTokens",
    }
    return cache.select(F.explode("model_usage").alias("model", "usage")).select(
        "model", *[F.coalesce(F.col(f"usage.{src}"), F.lit(0)).alias(name) for name, src in counts.items()]
    )


def parse_prompt_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Typed prompts; `ts` is null on malformed lines (no JSON, or no numeric timestamp)."""
    parsed = lines.select(json_variant(line).alias("v"))
    stamp = F.try_variant_get(F.col("v"), "$.timestamp", "variant")
    numeric = F.schema_of_variant(stamp).isin("BIGINT", "DOUBLE") | F.startswith(F.schema_of_variant(stamp), F.lit("DECIMAL"))
    number = F.when(numeric, _get("$.timestamp", "double"))
    millis = F.when(F.abs(number) <= MAX_MILLIS, number.try_cast("bigint"))  # others are no time: malformed
    return parsed.select(
        F.timestamp_millis(millis).alias("ts"),
        _get("$.display").alias("display"),
        _get("$.project").alias("project"),
        _get("$.sessionId").alias("session_id"),
        F.startswith(_get("$.display"), F.lit("/")).alias("slash_command"),
    )


def read_prompt_log(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path).filter(F.col("value") != "")
    return parse_prompt_log(lines, "value")


def read_numstat_log(spark: SparkSession, path: str, repo: str) -> tuple[DataFrame, DataFrame]:
    """Commit and file rows of a stored log. A record is a row from the start, so a log of any size is split."""
    records = spark.read.option("lineSep", RECORD_SEPARATOR).text(path)
    return parse_numstat_log(records.select(F.lit(repo).alias("repo"), "value"))


def parse_numstat_log(logs: DataFrame, text: str = "value", repo: str = "repo") -> tuple[DataFrame, DataFrame]:
    """Commit and file rows of `log --numstat` output: record separator, then hash, author date and address
    divided by the field separator, then `added<TAB>removed<TAB>path` lines."""
    records = logs.select(repo, F.explode(F.split(text, RECORD_SEPARATOR)).alias("record")).filter(F.trim("record") != "")
    lines = records.select(repo, F.split("record", "\n").alias("lines"))
    head = F.split(F.col("lines")[0], FIELD_SEPARATOR)
    commits = lines.select(
        repo, head[0].alias("hash"), F.get(head, F.lit(1)).alias("author_date"),
        F.lower(F.coalesce(F.get(head, F.lit(2)), F.lit(""))).alias("email"), "lines",
    ).filter(F.col("hash") != "")
    fields = F.split("line", "\t")
    files = commits.select(repo, "hash", F.explode("lines").alias("line")).filter(F.size(fields) >= 3).select(
        repo, "hash", fields[0].alias("added"), fields[1].alias("removed"), fields[2].alias("path")
    )
    return commits.drop("lines"), files
