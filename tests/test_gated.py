"""The gate and the features in one walk, and scores from cost tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidegauge.functions.features import NAMES
from tidegauge.operators import baseline, features, windows
from tidegauge.plans import flows
from tidegauge.schemas import FitSpec, WindowSpec
from tidegauge.sources.tables import http_events

SPEC = WindowSpec(length_seconds=7_200, cadence_seconds=1_800, min_events=3)
OUT = ("source_id", "visitor_id", "event_id", "t", "window_count", *NAMES)


def dense(spark):
    """Few visitors, one with a third of all events, of which every ninth comes late."""
    events = http_events(spark, "/root/testdata/sf0.01")
    visitor = F.when(F.col("arrival") % 3 == 0, "hot").otherwise((F.col("arrival") % 40).cast("string"))
    late = F.col("arrival") + F.when(F.col("arrival") % 9 == 0, 700).otherwise(0)
    return events.withColumns({"visitor_id": visitor, "source_id": F.lit("s"), "arrival": late * 100_000 + F.col("arrival")})


@pytest.mark.parametrize("chunk", [64, 1 << 16])
def test_gated_features_are_those_of_the_samples(spark, chunk, monkeypatch):
    monkeypatch.setattr(features, "CHUNK_ROWS", chunk)
    events = dense(spark)
    samples = windows.fit_samples(events, SPEC)
    want = features.window_features(samples, events, SPEC, ("window_count",)).select(*OUT)
    got = features.gated_features(events, SPEC).select(*OUT)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 500
    since = F.col("t") >= flows.split_micros()
    samples = windows.serve_samples(events, SPEC, since)
    want = features.window_features(samples, events, SPEC, ("window_count",)).select(*OUT)
    got = features.gated_features(windows.mark_late(events), SPEC, since, eligible_only=False).select(*OUT)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 500


def test_training_sorts_events_twice_without_windows(spark):
    """Before, the windows of each event were counted for two branches and the samples joined the events again."""
    plan = features.gated_features(flows.fit_history(spark, "/root/testdata/sf0.001"), flows.WINDOWS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and "Window [" not in plan


def test_no_events_no_windows(spark):
    assert features.gated_features(dense(spark).limit(0), SPEC).count() == 0


def test_tables_give_the_score_of_the_histograms(spark):
    names = [F.when(F.col("id") % 7 != i % 7, (F.col("id") * (i + 3) % 31).cast("double")).alias(n) for i, n in enumerate(NAMES[:-2])]
    rows = spark.range(2_000).select(F.lit("s").alias("source_id"), "id", *names, F.lit(2.0).alias(NAMES[-2]), F.lit(None).cast("double").alias(NAMES[-1]))
    models = baseline.histogram_arrays(baseline.histograms(rows.where("id < 900"), FitSpec(horizon_days=None)))
    odd = F.when(F.col("id") % 11 == 0, 99.0).when(F.col("id") % 13 == 0, float("nan")).when(F.col("id") % 17 == 0, float("inf"))
    probe = rows.withColumns({n: F.coalesce(odd, F.col(n)) for n in NAMES}).unionByName(rows).join(models, "source_id")
    scores = probe.select(baseline.raw_score(F.col("histograms")).alias("a"), baseline.table_score(baseline.cost_tables(F.col("histograms"))).alias("b"))
    assert scores.where("not a <=> b").count() == 0 and scores.select("a").distinct().count() > 50
    assert spark.range(1).select(*(F.lit(1.0).alias(n) for n in NAMES), baseline.table_score(F.lit(None).cast("array<struct<low:double,high:double,width:double,last:bigint,costs:array<double>>>")).alias("s")).first()["s"] is None
