"""Scoring sampled windows: active baselines, policies and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.features import REGISTRY, registry_hash
from tidegauge.operators.baseline import cost_tables, normalised, table_score, valid_histogram, valid_quantiles
from tidegauge.operators.materialize import broadcast_if_small, cut
from tidegauge.schemas import POLICY_V1, WindowSpec
from tidegauge.sources.tables import latest_succeeded


def compatible(spec: WindowSpec) -> Column:
    """Whether a succeeded run's model may score windows of this spec; the horizon doesn't matter."""
    b = F.col("baseline")
    w = b["window_spec"]
    same = (b["registry_hash"] == registry_hash()) & (w["length_seconds"] == spec.length_seconds) & (w["cadence_seconds"] == spec.cadence_seconds) & (w["min_events"] == spec.min_events)
    return F.coalesce((b["source_id"] == F.col("source_id")) & (F.col("id") > 0) & same & (F.size(b["histograms"]) == len(REGISTRY)) & F.forall(b["histograms"], valid_histogram) & valid_quantiles(b["score_quantiles"]), F.lit(False))


def loaded_models(runs: DataFrame, spec: WindowSpec) -> DataFrame:
    """source_id, baseline_run_id, histograms and score_quantiles of each source's latest succeeded run, if that run is
    compatible; an older one never takes its place."""
    return latest_succeeded(runs).where(compatible(spec)).select("source_id", F.col("id").alias("baseline_run_id"), F.col("baseline.histograms").alias("histograms"), F.col("baseline.score_quantiles").alias("score_quantiles"))


def refreshed_models(current: DataFrame, runs: DataFrame, spec: WindowSpec) -> DataFrame:
    """The active models after a refresh: a source's latest run if it is compatible, else the model it has."""
    new = loaded_models(runs, spec)
    return new.unionByName(current.join(new.select("source_id"), "source_id", "left_anti"))


def policy_row(policy: dict = POLICY_V1) -> tuple[Column, Column, Column]:
    """version, bands and fallback_actions of a policy as literals."""
    bands = F.array(*[F.struct(F.lit(b["risk_level"]).alias("risk_level"), F.lit(b["max_score"]).cast("double").alias("max_score"), F.lit(b["action"]).alias("action")) for b in policy["bands"]])
    fallback = F.create_map(*[F.lit(x) for pair in policy["fallback_actions"].items() for x in pair])
    return F.lit(policy["version"]), bands, fallback


def band(bands: Column, score: Column) -> Column:
    """The first band whose bound is above the score; a null bound is open. The score is taken once, not for each band."""
    first = lambda s: F.get(F.filter(bands, lambda b: b["max_score"].isNull() | (s < b["max_score"])), F.lit(0))
    return F.get(F.transform(F.array(score), first), F.lit(0))


def decide(features: DataFrame, models: DataFrame, decided_at: Column, policy: dict = POLICY_V1) -> DataFrame:
    """Decisions on evaluated windows (features with eligible and event_time): no model, then too few events, then a score.

    models has one row a source; it is broadcast if its counted rows allow it.
    """
    version, bands, fallback = policy_row(policy)
    tabled = cut(models.withColumn("tables", cost_tables(F.col("histograms"))).drop("histograms"))
    rows = features.join(broadcast_if_small(tabled, 2_000), "source_id", "left")
    status = F.when(F.col("baseline_run_id").isNull(), "no_baseline").when(~F.col("eligible"), "insufficient_history").otherwise("scored")
    rows = rows.withColumn("status", status).withColumn("score_raw", F.when(F.col("status") == "scored", table_score(F.col("tables"))))
    rows = rows.withColumn("score_normalized", normalised(F.col("score_raw"), F.col("score_quantiles")))
    rows = rows.withColumn("score_normalized", F.when(F.col("status") == "scored", F.col("score_normalized"))).withColumn("band", F.when(F.col("status") == "scored", band(bands, F.col("score_normalized"))))
    return rows.select(
        F.concat(F.lit("d-"), "event_id").alias("decision_id"),
        "event_id",
        "source_id",
        "visitor_id",
        decided_at.alias("decided_at"),
        "status",
        "score_raw",
        "score_normalized",
        F.col("band.risk_level").alias("risk_level"),
        F.coalesce("band.action", F.try_element_at(fallback, F.col("status"))).alias("action"),
        version.alias("policy_version"),
        "baseline_run_id",
    )
