"""Reads of decisions: the latest of visitors, recent ones of a source, and across sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT, MAX_LIMIT = 100, 1000
RECENT = 131_072


def read_limit(asked: int | None) -> int:
    """A request's limit: 100 if it has none; anything but 1 to 1000 is an error."""
    if asked is None:
        return DEFAULT_LIMIT
    if not 0 < asked <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    return asked


def latest_for_visitor(decisions: DataFrame, source_id: str, visitor_id: str) -> DataFrame:
    own = decisions.where((F.col("source_id") == source_id) & (F.col("visitor_id") == visitor_id))
    return own.orderBy(F.desc("decided_at"), F.desc("decision_id")).limit(1)


def latest_per_visitor(decisions: DataFrame) -> DataFrame:
    """The latest decision of every visitor; a partial aggregate, so a busy visitor is no hot group."""
    latest = F.max_by(F.struct(*decisions.columns), F.struct("decided_at", "decision_id"))
    return decisions.groupBy("source_id", "visitor_id").agg(latest.alias("d")).select("d.*")


def recent_for_source(decisions: DataFrame, source_id: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The newest decisions of a source; the limit is held between 1 and 1000."""
    return decisions.where(F.col("source_id") == source_id).orderBy(F.desc("decided_at"), F.desc("decision_id")).limit(max(1, min(limit, MAX_LIMIT)))


ARRIVAL = ("timestamp", "partition", "offset")


def recent_by_arrival(records: DataFrame, limit: int = RECENT) -> DataFrame:
    """The newest stream records across sources, newest first."""
    return records.orderBy(*map(F.desc, ARRIVAL)).limit(limit)


def backfill(records: DataFrame, limit: int, source_id: str = "") -> DataFrame:
    """The last records of a source (blank: of all), oldest first; none for a limit of zero or less."""
    own = records.where(F.col("source_id") == source_id) if source_id.strip() else records
    return own.orderBy(*map(F.desc, ARRIVAL)).limit(max(0, limit)).orderBy(*ARRIVAL)
