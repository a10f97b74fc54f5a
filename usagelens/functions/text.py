"""Text measures and identity strings."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .numeric import ColumnOrName, col

# Fixed value: the trace a working copy leaves in a sanitised project folder name.
WORKTREE_PROJECT_PATTERN = r"-claude-worktrees-([^/]+)$"


#: Longest JSON string that is read: the longest that a row can hold.
MAX_JSON_STRING = 2_000_000_000
_REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


def json_variant(text: ColumnOrName) -> Column:
    """JSON text as a variant, null if it is none. Strings of any length; of repeated keys the last counts.

    The setting for repeated keys belongs to the session, so it is made here too: sources work in sessions
    that others have built.
    """
    SparkSession.active().conf.set(_REPEATED_KEYS, "true")
    return F.from_json(col(text), "variant", {"maxStringLen": str(MAX_JSON_STRING)})


def utf16_length(text: ColumnOrName) -> Column:
    """Length in UTF-16 code units (`length` counts code points and differs beyond the BMP)."""
    return (F.octet_length(F.encode(col(text), "UTF-16BE")) / 2).cast("bigint")


def utf8_length(text: ColumnOrName) -> Column:
    return F.octet_length(col(text)).cast("bigint")


def line_count(text: ColumnOrName) -> Column:
    """Newlines plus one; zero for null or empty text."""
    text = col(text)
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(newlines + 1).cast("bigint")


def identity_hash(email: ColumnOrName) -> Column:
    """First 16 hex digits of the SHA-256 of the trimmed, lower-cased address."""
    return F.substring(F.sha2(F.lower(F.trim(col(email))), 256), 1, 16)


def sanitize_remote(url: ColumnOrName) -> Column:
    """`host/path` of a repository address, without credentials and `.git`."""
    url = col(url)
    scp = r"^(?:[^@/]+@)?([^:/]+):(.+)$"
    without_git = lambda c: F.regexp_replace(c, r"\.git$", "")
    has_scheme = F.contains(url, F.lit("://"))
    host = F.try_parse_url(url, F.lit("HOST"))
    authority = F.regexp_replace(F.try_parse_url(url, F.lit("AUTHORITY")), r"^[^@]*@", "")
    from_url = F.concat(F.lower(authority), without_git(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))))
    return (
        F.when(url.isNull() | (url == ""), F.lit(None).cast("string"))
        .when(~has_scheme & F.rlike(url, F.lit(scp)), F.concat(
            F.regexp_extract(url, scp, 1), F.lit("/"), without_git(F.regexp_extract(url, scp, 2))))
        .when(has_scheme & host.isNotNull(), from_url)
        .otherwise(without_git(F.regexp_replace(url, r"^[^@]*@", "")))
    )


def owner_repo(remote: ColumnOrName) -> Column:
    """The last two path parts of a sanitised address, null with fewer."""
    parts = F.filter(F.split(col(remote), "/"), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), "/"))


def worktree_label(project: ColumnOrName, pattern: str = WORKTREE_PROJECT_PATTERN) -> Column:
    """Working-copy label inside a project name, null when there is none."""
    return F.nullif(F.regexp_extract(col(project), pattern, 1), F.lit(""))
