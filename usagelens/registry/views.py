"""The test tables seen as usage logs: requests, transcript lines, calls, prompts, commits and so on."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import TOKENS, total_tokens
from ..operators import pricing, requests, tools
from ..plans import usage
from ..session import cut_lineage
from ..sources import transcripts

CUT = "1998-06-30"
DEDUP_ORDER = ("ts", "part_key", "supp_key")
CACHE_END = "2024-01-10"


class Views:
    """Lazy views over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- requests -----------------------------------------------------------

    def request_columns(self, full_split: bool = False) -> DataFrame:
        """Line items as usage snapshots; orders and parts give session, agent type and model."""
        cents = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("bigint")
        discount = cents("l_discount")
        reported = F.lit(True) if full_split else F.col("l_linestatus") == "F"
        tier = F.when(F.col("l_returnflag") == "N", "main").when(F.col("l_returnflag") == "R", "subagent").otherwise("workflow-agent")
        joined = (
            self.table("lineitem")
            .join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        )
        return joined.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("message_id"),
            F.col("l_shipdate").alias("ts"),
            F.col("o_custkey").alias("session_id"),
            tier.alias("tier"),
            F.when(F.col("l_returnflag") != "N", F.col("o_orderpriority")).alias("agent_type"),
            F.col("p_brand").alias("model"),
            F.col("l_quantity").cast("bigint").alias("input_tokens"),
            (cents("l_tax") * 7).alias("output_tokens"),
            (discount * 50).alias("cache_creation_tokens"),
            F.when(reported, discount * 40).alias("cache_creation_5m_tokens"),
            F.when(reported, discount * 10).alias("cache_creation_1h_tokens"),
            F.floor("l_extendedprice").cast("bigint").alias("cache_read_tokens"),
            F.col("l_partkey").alias("part_key"),
            F.col("l_suppkey").alias("supp_key"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        return self.request_columns()

    @cached_property
    def dedup(self) -> DataFrame:
        return requests.keep_largest(self.requests, "message_id", order=DEDUP_ORDER)

    @property
    def cut(self) -> Column:
        return F.lit(CUT).cast("timestamp_ntz")

    @cached_property
    def sided(self) -> DataFrame:
        """Requests labelled by window, deduplicated inside each window."""
        return usage.dedup_per_side(usage.split_windows(self.requests, self.cut), DEDUP_ORDER)

    @cached_property
    def prices(self) -> DataFrame:
        """A rate table for 20 of the 25 models; two of them read cache at their own multiplier."""
        i = F.col("id")
        rate = (F.lit(1) + i % 7).cast("double")
        return self.spark.range(1, 21).select(
            F.concat(F.lit("Brand#"), i.cast("string")).alias("model"),
            rate.alias("input_rate"),
            (rate * 5).alias("output_rate"),
            F.when(i <= 2, 0.025).alias("cache_read_multiplier"),
        )

    @cached_property
    def model_totals(self) -> DataFrame:
        return cut_lineage(requests.totals_by_key(self.dedup, "model", "model"), "model-totals")

    @cached_property
    def sided_cube(self) -> DataFrame:
        """One pass over the requests of both windows; all totals of the comparison come from it."""
        return cut_lineage(requests.usage_cube(self.sided, ["side"]), "cube")

    @cached_property
    def sided_models(self) -> DataFrame:
        return cut_lineage(requests.totals_by_key(self.sided_cube, "model", "model", ["side"], requests=F.col("requests")), "models")

    @cached_property
    def sided_priced(self) -> DataFrame:
        return pricing.price_models(self.sided_models, self.prices)

    @cached_property
    def sided_agents(self) -> DataFrame:
        return requests.totals_by_agent_type(self.sided_cube, by=["side"], requests=F.col("requests"))

    def _metrics(self, rows: DataFrame, by: list[str]) -> DataFrame:
        """The three distributions; the few columns they need are written once, after deduplication."""
        narrow = cut_lineage(rows.select(*by, "message_id", "session_id", "ts", *TOKENS.counts), "requests")
        return requests.request_metrics(narrow, by)

    @cached_property
    def metrics(self) -> DataFrame:
        return self._metrics(self.dedup, [])

    @cached_property
    def sided_metrics(self) -> DataFrame:
        return self._metrics(self.sided, ["side"])

    @cached_property
    def request_sources(self) -> DataFrame:
        """Deduplicated requests with the machine that holds them; stands for saved summaries of three."""
        return self.dedup.withColumn("source", F.col("supp_key") % 3)

    # -- transcript lines ------------------------------------------------------

    @cached_property
    def events(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.table("events").withColumn("k", k)

    @cached_property
    def lines(self) -> DataFrame:
        """Events as transcript lines of every kind, corrupt ones included, with path and position."""
        k, e, u = F.col("k"), F.col("event_id"), F.col("user_id")
        kind = F.col("event_type")
        stamp = F.when(k % 20 != 19, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        model = F.when((kind == "view") & (k % 10 == 0), "<synthetic>").otherwise(F.concat(F.lit("model-"), (k % 5).cast("string")))
        usage_block = F.when(
            ~((kind == "click") & (k % 10 == 1)),
            F.struct(
                k.alias("input_tokens"), (e % 100).alias("output_tokens"),
                F.when(k % 4 != 3, k * 10).alias("cache_read_input_tokens"),
            ),
        )
        message_id = F.when(~((kind == "click") & (k % 10 == 2)), F.concat(F.lit("m"), F.floor(e / 3).cast("string")))
        tool = F.element_at(F.array(*[F.lit(t) for t in ("Read", "Bash", "Edit", "Write")]), (k % 4 + 1).cast("int"))
        tool_input = F.struct(
            F.when(k % 4 == 1, F.when(k % 3 == 0, "git --no-pager commit -m y").when(k % 3 == 1, "git push").otherwise("ls"))
            .alias("command"),
            F.when(k % 4 == 3, F.repeat(F.lit("row\n"), (k % 5).cast("int"))).alias("content"),
            F.when(k % 4 == 2, "a\nb").alias("new_string"),
            F.when(k % 4 == 2, "a").alias("old_string"),
        )
        blocks = F.array(F.struct(
            F.lit("tool_use").alias("type"), F.concat(F.lit("t"), e.cast("string")).alias("id"), tool.alias("name"),
            tool_input.alias("input"),
        ))
        assistant = lambda content: F.to_json(F.struct(
            F.lit("assistant").alias("type"), stamp.alias("timestamp"),
            F.struct(message_id.alias("id"), model.alias("model"), content.alias("content"), usage_block.alias("usage")).alias("message"),
        ))
        results = F.array(F.struct(
            F.lit("tool_result").alias("type"), F.concat(F.lit("t"), e.cast("string")).alias("tool_use_id"),
            F.repeat(F.lit("é"), k.cast("int")).alias("content"), (k % 7 == 0).alias("is_error"),
        ))
        result_line = F.to_json(F.struct(
            F.lit("user").alias("type"), stamp.alias("timestamp"), F.struct(results.alias("content")).alias("message"),
        ))
        prompt_line = F.to_json(F.struct(
            F.lit("user").alias("type"), stamp.alias("timestamp"),
            F.when(k % 10 == 5, True).alias("isMeta"),
            F.when((k >= 40) & (k < 60), "typed").alias("promptSource"),
            F.struct(F.when(k >= 50, "  <system-reminder> x").otherwise("do it").alias("content")).alias("message"),
        ))
        line = (
            F.when(kind == "click", assistant(blocks))
            .when(kind == "view", assistant(F.lit("text")))
            .when(kind == "purchase", result_line)
            .when(kind == "signup", prompt_line)
            .when(k % 2 == 0, "null")
            .otherwise(F.concat(F.lit('{"type": '), e.cast("string")))
        )
        base = F.concat(F.lit("/logs/projects/p"), (u % 10).cast("string"), F.lit("/s"), u.cast("string"))
        path = (
            F.when(u % 3 == 0, F.concat(base, F.lit(".jsonl")))
            .when(u % 3 == 1, F.concat(base, F.lit("/subagents/agent-a"), u.cast("string"), F.lit(".jsonl")))
            .otherwise(F.concat(base, F.lit("/subagents/workflows/wf_"), (u % 4).cast("string"), F.lit("/agent-a"),
                                u.cast("string"), F.lit(".jsonl")))
        )
        raw = self.events.select(path.alias("file_path"), e.alias("line_no"), F.inline(F.array(F.struct(line.alias("line")))))
        return transcripts.describe_path(raw)

    @cached_property
    def parsed(self) -> DataFrame:
        return transcripts.parse_lines(self.lines)

    @cached_property
    def activity(self) -> DataFrame:
        return transcripts.activity_rows(self.parsed)

    @cached_property
    def event_series(self) -> DataFrame:
        """Events as the two activity series, sessions by user."""
        series = F.when(F.col("event_type") == "signup", "prompt").otherwise("working")
        return self.events.select("ts", series.alias("series"), F.col("user_id").alias("session_id"), "event_id")

    # -- calls ---------------------------------------------------------------------

    @cached_property
    def turn_calls(self) -> DataFrame:
        """User turns as calls keyed by conversation and tool slot."""
        c = self.table("conversations")
        return c.filter(F.col("role") == "user").select(
            "conv_id", (F.col("turn") % 4).alias("tool_use_id"), F.col("turn").alias("line_no"),
            F.concat(F.lit("tool-"), (F.length("text") % 4).cast("string")).alias("tool"),
        )

    @cached_property
    def turn_results(self) -> DataFrame:
        """Assistant turns as results of the turn before; the size is the length of the text."""
        c = self.table("conversations")
        return c.filter(F.col("role") == "assistant").select(
            "conv_id", ((F.col("turn") - 1) % 4).alias("tool_use_id"), F.col("turn").alias("line_no"),
            F.length("text").cast("bigint").alias("bytes"), (F.length("text") % 5 == 0).alias("is_error"),
        )

    @cached_property
    def paired_turns(self) -> DataFrame:
        return tools.pair_calls(self.turn_calls, self.turn_results, ["conv_id", "tool_use_id"])

    @cached_property
    def tool_payload(self) -> DataFrame:
        """Payload totals per window: even conversations are the baseline, odd ones the compare window."""
        side = F.when(F.col("conv_id") % 2 == 0, "baseline").otherwise("compare")
        return cut_lineage(tools.tool_payload_table(self.paired_turns.withColumn("side", side), ["side"]), "tool-payload")

    @cached_property
    def compaction_events(self) -> DataFrame:
        """Error events as compactions."""
        k = F.col("k")
        errors = self.events.filter(F.col("event_type") == "error")
        return errors.select(
            "ts", "user_id",
            F.when(k % 3 == 0, "manual").when(k % 3 == 1, "auto").alias("trigger"),
            (k * 10).alias("pre_tokens"), k.alias("post_tokens"), (k * 9).alias("dropped_tokens"),
            F.when(k % 7 != 0, k * 100).alias("duration_ms"),
        )

    @cached_property
    def compactions_by_side(self) -> DataFrame:
        side = F.when(F.col("user_id") % 3 == 0, "compare").otherwise("baseline")
        return self.compaction_events.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("compactions"))

    # -- prompts, cache -----------------------------------------------------------

    @cached_property
    def prompts(self) -> DataFrame:
        """Sign-ups as typed prompts."""
        k = F.col("k")
        return self.events.filter(F.col("event_type") == "signup").select(
            "ts", "user_id",
            F.when(k % 4 == 0, "/clear").otherwise("text").alias("display"),
            F.col("user_id").cast("string").alias("session_id"),
            F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("project"),
        )

    @cached_property
    def event_daily(self) -> DataFrame:
        """Live daily series from events."""
        return self.event_series.groupBy(F.to_date("ts").alias("date")).agg(
            F.count_if(F.col("series") == "working").alias("working_events"),
            F.count_if(F.col("series") == "prompt").alias("human_prompts"),
        )

    @cached_property
    def cached_daily(self) -> DataFrame:
        """Events up to the end of the cache as cached days."""
        return self.events.filter(F.to_date("ts") <= F.lit(CACHE_END).cast("date")).groupBy(
            F.to_date("ts").alias("date")
        ).agg(
            F.count(F.lit(1)).alias("message_count"), F.countDistinct("user_id").alias("session_count"),
            F.count_if(F.col("event_type") == "click").alias("tool_call_count"),
        )

    @cached_property
    def event_model_daily(self) -> DataFrame:
        """Tokens per date and model from events, whole lifetime."""
        e = self.events
        return e.groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("model")).agg(
            F.sum("k").alias("input_tokens"), F.sum(F.col("event_id") % 50).alias("output_tokens"),
            F.sum(F.col("user_id") % 7).alias("cache_creation_tokens"), F.sum(F.col("k") * 20).alias("cache_read_tokens"),
        )

    # -- commits --------------------------------------------------------------------

    @cached_property
    def commits(self) -> DataFrame:
        """Orders as commits."""
        o = self.table("orders")
        return o.select(
            (F.col("o_custkey") % 40).alias("repo"),
            F.col("o_orderkey").alias("hash"),
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+02:00'").alias("author_date"),
            F.concat(F.lit("User"), (F.col("o_custkey") % 10).cast("string"), F.lit("@Mail.example")).alias("email"),
            F.when(F.col("o_orderstatus") == "P", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("parents"),
            F.concat(F.lit("Fix\n\nPriority: "), F.col("o_orderpriority")).alias("message"),
        )

    @cached_property
    def commit_files(self) -> DataFrame:
        """Line items as changed files; a '-' count marks a binary one."""
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        binary = F.col("l_returnflag") == "R"
        return self.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            (F.col("o_custkey") % 40).alias("repo"), F.col("l_orderkey").alias("hash"),
            F.when(binary, "-").otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("added"),
            F.when(binary, "-").otherwise(F.col("l_linenumber").cast("string")).alias("removed"),
            F.col("l_partkey").alias("path"),
        )

    @cached_property
    def identities(self) -> DataFrame:
        """Three of the ten author addresses, in another spelling."""
        return self.spark.range(3).select(F.concat(F.lit(" user"), F.col("id").cast("string"), F.lit("@mail.EXAMPLE")).alias("email"))

    @cached_property
    def classified(self) -> DataFrame:
        from ..operators import commits

        return commits.with_numstat(
            commits.classify_commits(self.commits, self.identities, ["PRIORITY: 1-", "priority: 2-"]), self.commit_files
        )

    @cached_property
    def repo_keys(self) -> DataFrame:
        """Customers as repository entries with two overlapping keys."""
        c = F.col("c_custkey")
        keys = F.array_compact(F.array(
            F.concat(F.lit("a:"), F.floor(c / 3).cast("string")),
            F.when(c % 5 < 2, F.concat(F.lit("b:"), F.floor(c / 5).cast("string"))),
        ))
        return self.table("customer").select(c.alias("entry"), F.explode(keys).alias("key"))

    def totals(self, df: DataFrame) -> DataFrame:
        return df.withColumn("total_tokens", total_tokens())
