"""Token bundles: the columns that make one up, and what is derived from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import ColumnOrName, col, ratio


@dataclass(frozen=True)
class TokenColumns:
    """Names of the columns of a token bundle.

    The 5-minute / 1-hour split of cache writes is optional data: null means "not reported", which is
    different from zero and is never coalesced.
    """

    input: str = "input_tokens"
    output: str = "output_tokens"
    cache_write: str = "cache_creation_tokens"
    cache_write_5m: str = "cache_creation_5m_tokens"
    cache_write_1h: str = "cache_creation_1h_tokens"
    cache_read: str = "cache_read_tokens"

    @property
    def counts(self) -> tuple[str, str, str, str]:
        return (self.input, self.output, self.cache_write, self.cache_read)

    @property
    def split(self) -> tuple[str, str]:
        return (self.cache_write_5m, self.cache_write_1h)

    @property
    def all(self) -> tuple[str, ...]:
        return self.counts + self.split

    def prefixed(self, prefix: str) -> "TokenColumns":
        return TokenColumns(
            *(prefix + name for name in (
                self.input, self.output, self.cache_write,
                self.cache_write_5m, self.cache_write_1h, self.cache_read,
            ))
        )


TOKENS = TokenColumns()


def _count(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def total_tokens(t: TokenColumns = TOKENS) -> Column:
    """All four token classes, each counted once."""
    return _count(t.input) + _count(t.output) + _count(t.cache_write) + _count(t.cache_read)


def context_tokens(t: TokenColumns = TOKENS) -> Column:
    """What had to be read to answer, however it was billed."""
    return _count(t.input) + _count(t.cache_write) + _count(t.cache_read)


def cache_hit_rate(t: TokenColumns = TOKENS) -> Column:
    """Share of the context served from cache; null without context."""
    return ratio(_count(t.cache_read), context_tokens(t))


def token_share(part: ColumnOrName, total: ColumnOrName) -> Column:
    """Token-class share in percent; a total of zero counts as one, so the share is 0."""
    return col(part).cast("double") / F.greatest(col(total), F.lit(1)).cast("double") * 100


def has_ttl_split(t: TokenColumns = TOKENS) -> Column:
    return F.col(t.cache_write_5m).isNotNull() & F.col(t.cache_write_1h).isNotNull()


def normalize_model(model: ColumnOrName) -> Column:
    """Drop a trailing `-YYYYMMDD` from a model id."""
    return F.regexp_replace(col(model), r"-\d{8}$", "")
