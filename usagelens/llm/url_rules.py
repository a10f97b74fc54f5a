"""URL filters: rules indexed by their rarest literal token; regular expressions run on fetched candidates only.

A rule is a host and path prefix (`example.net/en/`; it fits the host and all its subdomains) or a pattern with `*`
for any run of characters, matched anywhere. Every rule becomes a regular expression over host + path and
has literal tokens: runs of a-z0-9 that are whole tokens of any URL the rule fits. The rule is filed under that token
which is rarest among the URLs at hand. A URL's tokens fetch the rules filed under them, and only those are
tried. A rule without literal token is filed under the empty token, which every URL has.

Of the host rules that fit, the longest wins and gives rule and verdict. Where none fits, the longest pattern that
fits gives the verdict, and where none does, the default. Each distinct URL is judged once.

Nulls: a null URL, or one without `://`, has empty host and path, fits nothing, and gets the default. Repeated rows
get equal verdicts; an empty table gives no rows; of equal rules, `block` wins. Extra columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

Rule = tuple[str, str, str]  # verdict, kind (host or pattern), text

#: The host rules of the query, and patterns for addresses that are no documents.
RULES: tuple[Rule, ...] = (
    ("block", "host", "net/"), ("allow", "host", "example.net/en/"), ("block", "host", "example.com/de/"), ("allow", "host", "org/fr/"),
    ("block", "pattern", "/login/"), ("block", "pattern", "/ads/"), ("block", "pattern", "/cart/"), ("block", "pattern", "/wp-admin/"), ("block", "pattern", "/tag/*/feed/"),
)
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "[^a-z0-9]+"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(address: Column) -> Column:
    return F.array_distinct(F.split(F.translate(address, UPPER, LOWER), SEPARATORS))


def compiled(kind: str, text: str) -> str:
    """Regular expression over host + path."""
    quoted = ".*".join("".join(c if c.isalnum() or c == "/" else "\\" + c for c in part) for part in text.split("*"))
    return rf"(?s)\A(?:[^/]*\.)?{quoted}" if kind == "host" else f"(?s){quoted}"


def literal_tokens(kind: str, text: str) -> list[str]:
    """Tokens that stand whole in every address the rule fits: between separators of the rule, or at a host's start."""
    found = []
    low = text.translate(str.maketrans(UPPER, LOWER))
    for m in re.finditer(r"[a-z0-9]+", low):
        left = low[m.start() - 1] if m.start() else ("." if kind == "host" else "*")
        right = low[m.end()] if m.end() < len(low) else "*"
        if left != "*" and right != "*":
            found.append(m.group())
    return found


def index(spark: SparkSession, addresses: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(token, rule, kind, verdict, pattern): each rule under its rarest token. `addresses` has a column tokens."""
    listed = [(i, v, k, t, compiled(k, t), literal_tokens(k, t) or [""]) for i, (v, k, t) in enumerate(rules)]
    given = spark.createDataFrame(listed, "i int, verdict string, kind string, rule string, pattern string, tokens array<string>")
    each = given.select("i", F.explode("tokens").alias("token"))
    wanted = each.select("token").distinct()
    seen = addresses.select(F.explode("tokens").alias("token")).join(wanted, "token").groupBy("token").count()
    rarest = each.join(seen, "token", "left").groupBy("i").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), -F.length("token"), "token")).alias("token"))
    return cut_lineage(given.drop("tokens").join(rarest, "i").drop("i"), "url-index")


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = DEFAULT, url: str = "url") -> DataFrame:
    """All columns of `pages`, and host, path, rule, pattern and verdict (these replace columns so named)."""
    spark = pages.sparkSession
    distinct = pages.select(F.col(url).alias("u")).where("u is not null").distinct()
    addresses = distinct.select("u", F.concat(host_of(F.col("u")), path_of(F.col("u"))).alias("address")).where("address <> ''")
    addresses = cut_lineage(addresses.withColumn("tokens", F.array_union(tokens_of(F.col("address")), F.array(F.lit("")))), "url-tokens")
    filed = index(spark, addresses, rules)
    tried = addresses.select("u", "address", F.explode("tokens").alias("token")).join(filed, "token")
    fits = tried.where(F.regexp_like("address", F.col("pattern")))
    order = F.struct(F.length("rule"), (F.col("verdict") == "block").cast("int"), "rule")
    best = fits.groupBy("u").agg(
        F.max_by(F.when(F.col("kind") == "host", F.struct("rule", "verdict")), F.when(F.col("kind") == "host", order)).alias("h"),
        F.max_by(F.when(F.col("kind") == "pattern", F.struct("rule", "verdict")), F.when(F.col("kind") == "pattern", order)).alias("p"),
    )
    own = [F.col("page")[c].alias(c) for c in pages.columns if c not in ("host", "path", "rule", "pattern", "verdict")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), F.col(url).alias("v"))
    joined = rows.join(cut_lineage(best, "url-verdicts"), F.col("v") == F.col("u"), "left")
    return joined.select(
        *own, host_of(F.col("v")).alias("host"), path_of(F.col("v")).alias("path"), F.col("h.rule").alias("rule"), F.when(F.col("h").isNull(), F.col("p.rule")).alias("pattern"),
        F.coalesce("h.verdict", "p.verdict", F.lit(default)).alias("verdict"),
    )
