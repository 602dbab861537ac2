"""Plans that must stay small or prune their scans."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from tidegauge.operators import baseline, scoring
from tidegauge.plans import flows
from tidegauge.plans.registry import QUERIES
from tidegauge.schemas import HISTOGRAM_DDL, POLICY_V1, FitSpec
from tidegauge.sources.tables import http_events


def test_horizon_prunes_partitions_and_row_groups(spark, tmp_path):
    path = str(tmp_path / "events")
    http_events(spark, "/root/testdata/sf0.001").withColumn("event_date", F.to_date("event_time")).write.partitionBy("event_date").parquet(path)
    events = spark.read.parquet(path)
    spec, fit = flows.WINDOWS, FitSpec(horizon_days=7)
    rows = baseline.history(events, spec, fit)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "event_date" in line)
    assert "event_date" in scan.split("PartitionFilters: ")[1].split("]")[0] and "GreaterThanOrEqual(event_time" in scan
    newest = events.groupBy("source_id").agg(F.max("t").alias("top"))
    want = events.join(newest, "source_id").where(F.col("t") >= F.col("top") - 7 * 86_400_000_000 - spec.length_micros)
    assert sorted(r["event_id"] for r in rows.select("event_id").collect()) == sorted(r["event_id"] for r in want.select("event_id").collect())
    assert rows.count() < events.count()
    assert baseline.history(events.limit(0), spec, fit).count() == 0


def test_constraints_over_decisions_end_in_time(spark):
    began = time.monotonic()
    found = QUERIES["decision_constraint_violations"](spark, "/root/testdata/sf0.01")
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert found.count() > 0 and time.monotonic() - began < 120


def test_filters_on_decoded_records_stay_above_decoding(spark):
    for name in ("event_envelopes", "event_dead_letters"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 30_000 and plan.count("from_json(") == 1, name


def test_a_score_is_computed_once_not_for_each_quantile(spark):
    quantiles = F.array(*map(F.lit, (0.25, 0.5, 0.5, 0.75)))
    rows = spark.range(5).select(baseline.normalised(F.log1p("id") - F.lit(0.2), F.when(F.col("id") >= 0, quantiles)).alias("n"))
    before, *steps = rows._jdf.queryExecution().optimizedPlan().toString().split("lambdafunction(")
    assert steps and "LOG1P" in before and not any("LOG1P" in s for s in steps)
    assert [r["n"] for r in rows.collect()] == [0.0, 0.25, 1.0, 1.0, 1.0]


def test_a_band_takes_its_score_once(spark):
    bands = scoring.policy_row()[1]
    rows = spark.range(3).select(scoring.band(bands, F.log1p("id") - F.lit(0.5))["action"].alias("action"))
    before, *steps = rows._jdf.queryExecution().optimizedPlan().toString().split("lambdafunction(")
    assert steps and "LOG1P" in before and not any("LOG1P" in s for s in steps)
    assert [r["action"] for r in rows.collect()][0] == POLICY_V1["bands"][0]["action"]


def test_a_score_is_one_expression_for_all_features(spark):
    rows = spark.range(1).select(baseline.raw_score(F.from_json(F.lit("[]"), f"array<{HISTOGRAM_DDL}>"), [F.col("id")] * 9).alias("s"))
    assert rows._jdf.queryExecution().analyzed().toString().count("bin_min") < 10
