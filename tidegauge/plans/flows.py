"""The batch flow over the driver's tables: events, fit before a split, decisions after it, marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import baseline, marts, quality, scoring
from tidegauge.operators.features import gated_features, window_features
from tidegauge.operators.materialize import cut, store
from tidegauge.operators.windows import VISITOR, bucket_micros, mark_late, serve_samples
from tidegauge.schemas import FitSpec, WindowSpec
from tidegauge.sources.tables import http_events

#: The tables' visitors send some two events a day, so windows are longer than in production and gates lower.
WINDOWS = WindowSpec(length_seconds=86_400, cadence_seconds=21_600, min_events=3)
FIT = FitSpec(horizon_days=None, min_windows=50, min_visitors=5)
SPLIT = "2024-01-21 00:00:00"


def split_micros() -> F.Column:
    return F.unix_micros(F.lit(SPLIT).cast("timestamp"))


def fit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = http_events(spark, sf_dir)
    return baseline.history(events.where(F.col("t") < split_micros()), WINDOWS, FIT)


#: What sampling needs of an event; gates and their tables carry no other column.
SAMPLED = (*VISITOR, "event_id", "event_time", "t", "arrival")
#: What features need beside it.
MEASURED = ("endpoint", "http_method", "resource_type", "status_code", "referrer_present")


def training_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.horizon_samples(fit_history(spark, sf_dir).select(*SAMPLED, "horizon_t"), WINDOWS)


def training(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gate counts and features of the training windows, materialised: a fit reads both several times."""
    events = fit_history(spark, sf_dir)
    features = cut(gated_features(events, WINDOWS, F.col("horizon_t").isNull() | (F.col("t") >= F.col("horizon_t"))))
    return cut(baseline.gate_counts(events, features, FIT)), features


def training_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_features(training_samples(spark, sf_dir), fit_history(spark, sf_dir), WINDOWS)


def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.gate_counts(fit_history(spark, sf_dir), training_samples(spark, sf_dir), FIT)


def passing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training features of the sources that pass the gates."""
    counts, features = training(spark, sf_dir)
    return features.join(counts.where("passes").select("source_id"), "source_id", "left_semi")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, features = training(spark, sf_dir)
    return cut(baseline.fit_baselines(features, counts, WINDOWS, FIT, F.lit(SPLIT).cast("timestamp")))


def serve_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that windows after the split may hold: those of one window length before it, and all later ones.

    Older events decide nothing there: no such window holds them, and an event is late only by a newer one.
    """
    return http_events(spark, sf_dir).where(F.col("t") >= split_micros() - WINDOWS.length_micros)


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluated windows after the split; windows may reach back over it, the gate starts fresh."""
    return serve_samples(serve_history(spark, sf_dir).select(*SAMPLED), WINDOWS, F.col("t") >= split_micros())


def decisions(spark: SparkSession, sf_dir: str, fitted: DataFrame | None = None) -> DataFrame:
    """Decisions on the served windows under the runs fitted before the split."""
    events = serve_history(spark, sf_dir).select(*SAMPLED, *MEASURED)
    marked = store(mark_late(events, bucket=bucket_micros(WINDOWS)))
    rows = gated_features(marked, WINDOWS, F.col("t") >= split_micros(), eligible_only=False)
    rows = rows.withColumn("event_time", F.timestamp_micros("t")).withColumn("eligible", F.col("window_count") >= WINDOWS.min_events)
    models = scoring.loaded_models(runs(spark, sf_dir) if fitted is None else fitted, WINDOWS)
    return scoring.decide(rows, models, F.col("event_time"))


def dated_decisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Decisions with their days and the staged runs, both materialised."""
    fitted = runs(spark, sf_dir)
    # Decisions are on windows after the split, so no earlier event is one of theirs.
    events = marts.staged_events(http_events(spark, sf_dir).where(F.col("t") >= split_micros()))
    return cut(marts.decisions_with_event_date(decisions(spark, sf_dir, fitted), events)), marts.staged_runs(fitted)


def mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily table alone, materialised."""
    dated, fitted = dated_decisions(spark, sf_dir)
    traffic = marts.daily_traffic(marts.staged_events(http_events(spark, sf_dir)))
    return cut(marts.risk_mart(traffic, marts.daily_outcomes(dated), marts.usage_segments(dated, fitted)))


def tables(spark: SparkSession, sf_dir: str) -> quality.Tables:
    """All tables that the marts and checks read; decisions, with and without their days, and runs are materialised once."""
    events = marts.staged_events(http_events(spark, sf_dir))
    fitted = runs(spark, sf_dir)
    decided = cut(decisions(spark, sf_dir, fitted))
    fitted = marts.staged_runs(fitted)
    dated = cut(marts.decisions_with_event_date(decided, events))
    traffic, outcomes = marts.daily_traffic(events), marts.daily_outcomes(dated)
    segments = marts.usage_segments(dated, fitted)
    mart = cut(marts.risk_mart(traffic, outcomes, segments))
    return quality.Tables(events, decided, fitted, dated, traffic, outcomes, segments, mart, mart.select(*marts.EXPORT))
