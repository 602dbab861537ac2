"""Dashboard queries over the exported daily table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.marts import DAY
from tidegauge.schemas import ACTIONS, RISK_LEVELS


def filter_options(mart: DataFrame) -> DataFrame:
    """Each source with its first and last day. An empty table is an error."""
    if mart.limit(1).count() == 0:
        raise LookupError("the artifact has no rows")
    return mart.groupBy("source_id").agg(F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))


def daily_summaries(mart: DataFrame, source_id: str | None, first: str, last: str) -> DataFrame:
    """The days of a source (None: of all) in a range, with is_partial_day: the first and last day of the source's data."""
    of = Window.partitionBy("source_id")
    edge = (F.col("event_date") == F.min("event_date").over(of)) | (F.col("event_date") == F.max("event_date").over(of))
    own = mart if source_id is None else mart.where(F.col("source_id") == source_id)
    return own.withColumn("is_partial_day", edge).where(F.col("event_date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).orderBy(*DAY)


def usage_rows(mart: DataFrame) -> DataFrame:
    """The segments of each day as rows, in order."""
    return mart.select(*DAY, F.inline("baseline_usage_segments")).orderBy(*DAY, "segment_number")


def kpi_totals(mart: DataFrame) -> DataFrame:
    names = {"requests": "request_count", "evaluated": "evaluated_window_count", "scored": "scored_window_count", "challenges": "challenge_action_count", "blocked": "block_action_count"}
    return mart.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in names.items()))


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent, 0 if whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole) * 100, F.lit(0.0))


def evaluation_rate(mart: DataFrame) -> DataFrame:
    return mart.select(*DAY, "request_count", "evaluated_window_count", percent(F.col("evaluated_window_count"), F.col("request_count")).alias("evaluation_rate"))


def risk_composition(mart: DataFrame) -> DataFrame:
    """Windows of each risk level by source and day and their percentage of the scored ones."""
    cells = F.array(*[F.struct(F.lit(r).alias("risk_level"), F.col(f"{r}_risk_count").alias("n")) for r in RISK_LEVELS])
    rows = mart.select(*DAY, "scored_window_count", F.explode(cells).alias("c"))
    return rows.select(*DAY, "c.risk_level", F.col("c.n").alias("window_count"), percent(F.col("c.n"), F.col("scored_window_count")).alias("share_of_scored"))


def score_trend(mart: DataFrame) -> DataFrame:
    """Days on which average, p90 and p99 are all known."""
    names = ("average_normalized_score", "p90_normalized_score", "p99_normalized_score")
    return mart.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])).select(*DAY, *names)


def action_distribution(mart: DataFrame) -> DataFrame:
    """Totals of the recommended actions and their percentage of all."""
    sums = mart.agg(*(F.coalesce(F.sum(f"{a}_action_count"), F.lit(0)).alias(a) for a in ACTIONS))
    total = reduce(lambda a, b: a + b, [F.col(a) for a in ACTIONS])
    cells = F.array(*[F.struct(F.lit(a).alias("action"), F.col(a).cast("long").alias("window_count"), percent(F.col(a), total).alias("share")) for a in ACTIONS])
    return sums.select(F.explode(cells).alias("c")).select("c.*")


def daily_requests(mart: DataFrame) -> DataFrame:
    return mart.select(*DAY, "request_count")
