"""Row, uniqueness and reference constraints fire on planted rows and on nothing else; horizons and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.test_core import events_of, random_rows
from tidegauge.operators import baseline, marts, validation
from tidegauge.schemas import FitSpec, WindowSpec

DECISION = dict(id="'1'", event_id="'e'", source_id="'s'", visitor_id="'v'", decided_at="timestamp'2024-01-01'", status="'scored'", score_raw="1D", score_normalized="0.5D", risk_level="'low'", action="'allow'", policy_version="'v1'", baseline_run_id="1L")


def row(spark, fields, **changes):
    return spark.sql("select " + ", ".join(f"{v} as {k}" for k, v in (fields | changes).items()))


def said(spark, fields, constraints, **changes):
    found = validation.violating(row(spark, fields, **changes), constraints).collect()
    return found[0]["violations"] if found else []


def test_decisions(spark):
    check = lambda **k: said(spark, DECISION, validation.decision_constraints(), **k)
    none = dict(score_raw="cast(null as double)", score_normalized="cast(null as double)", risk_level="cast(null as string)")
    assert check() == []
    assert check(status="'insufficient_history'", **none) == []
    assert check(status="'no_baseline'", baseline_run_id="cast(null as bigint)", **none) == []
    assert check(status="'no_baseline'", **none) == ["status and nulls disagree"]
    assert check(**none) == ["status and nulls disagree"]
    assert check(score_raw="-0.1D") == ["score_raw is negative"] and check(score_raw="0D") == []
    assert check(score_normalized="1.5D") == ["score_normalized out of range"]
    assert check(action="'odd'") == ["action"] and check(visitor_id="repeat('x', 129)") == ["visitor_id length"]
    assert check(event_id="cast(null as string)") == ["event_id is null"]


def test_other_tables(spark):
    event = dict(id="'1'", event_time="now()", ingested_at="1L", payload="'{}'", features="'{\"a\": 1}'", source_id="'s'", visitor_id="'v'")
    assert said(spark, event, validation.event_constraints()) == []
    assert said(spark, event, validation.event_constraints(), source_id="''", visitor_id="''") == []
    assert said(spark, event, validation.event_constraints(), source_id="repeat('x', 65)", payload="'[]'") == ["source_id length", "payload is no object"]
    assert said(spark, event, validation.event_constraints(), payload="'{garbage'", features="cast(null as string)") == ["payload is no object", "features is no object"]
    run = dict(source_id="'s'", fit_at="now()", features_fit="array('f')", window_count="1", distinct_visitors="1", event_count="1", registry_hash="repeat('a', 64)", status="'succeeded'", baseline="'m'")
    assert said(spark, run, validation.run_constraints()) == []
    assert said(spark, run, validation.run_constraints(), window_count="-1", status="'failed'") == ["window_count is negative", "model present iff succeeded"]
    assert said(spark, run, validation.run_constraints(), source_id="repeat('x', 65)", fit_at="cast(null as timestamp)", features_fit="cast(null as array<string>)") == ["source_id length", "fit_at is null", "features_fit is null"]
    policy = dict(version="'v1'", active="true", policy="'{}'")
    assert said(spark, policy, validation.policy_row_constraints()) == []
    assert said(spark, policy, validation.policy_row_constraints(), version="repeat('v', 65)", policy="'[1]'") == ["version length", "policy is no object"]
    label = dict(decision_id="'1'", label="'true_positive'")
    for known in ("'false_positive'", "'false_negative'"):
        assert said(spark, label, validation.label_constraints(), label=known) == []
    assert said(spark, label, validation.label_constraints()) == [] and said(spark, label, validation.label_constraints(), label="'odd'") == ["label"]


def test_uniqueness_and_references(spark):
    rows = spark.createDataFrame([("1", "p"), ("1", None), ("2", "q")], "id string, parent string")
    assert [r["id"] for r in validation.repeated(rows, "id").collect()] == ["1"]
    parents = spark.createDataFrame([("p",)], "id string")
    assert [r["parent"] for r in validation.orphans(rows, parents, "parent").collect()] == ["q"]
    assert validation.too_many_active(spark.sql("select * from values (true),(true) t(active)")).count() == 1
    assert validation.too_many_active(spark.sql("select * from values (true),(false) t(active)")).count() == 0


def test_horizon(spark):
    events = events_of(spark, random_rows(300))
    spec = WindowSpec(length_seconds=300, cadence_seconds=60, min_events=3)
    day = 86_400
    later = events.withColumn("event_time", F.when(F.col("arrival") % 2 == 0, F.timestamp_add("DAY", F.lit(9), F.col("event_time"))).otherwise(F.col("event_time"))).withColumn("t", F.unix_micros("event_time"))
    kept = baseline.history(later, spec, FitSpec(horizon_days=7))
    edge = later.agg(F.max("t")).first()[0] - 7 * day * 1_000_000
    assert kept.count() == later.where(F.col("t") >= edge - spec.length_micros).count() < 300
    assert baseline.horizon_samples(kept, spec).where(F.col("t") < edge).count() == 0
    counts = baseline.gate_counts(kept, baseline.horizon_samples(kept, spec), FitSpec(min_windows=1, min_visitors=1)).first()
    assert counts["event_count"] == kept.where(F.col("t") >= F.col("horizon_t")).count() and counts["passes"]


def test_materialise(spark):
    marts.materialise({"staged_x": spark.range(2)}, {"mart_x": spark.range(3)})
    assert spark.table("staged_x").count() == 2 and spark.table("mart_x").count() == 3
    spark.sql("drop table mart_x")
