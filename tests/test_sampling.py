"""Sampling and decisions at size: what the steps carry, and many buckets' walks at once against walks one by one."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import TESTDATA
from tests.tasks import most_rows_read
from tidegauge.operators import baseline, marts, windows
from tidegauge.operators.features import window_features
from tidegauge.operators.windows import serve_samples
from tidegauge.plans import flows
from tidegauge.sources.tables import http_events

SF = str(TESTDATA / "sf0.001")


def test_samples_are_narrow(spark):
    """Gates carry no URIs, agents or endpoints; the samples are those of all events."""
    for samples in (flows.served(spark, SF), flows.training_samples(spark, SF)):
        assert not {"uri", "endpoint", "user_agent", "resource_type"} & set(samples.columns)
    names = ("event_id", "t", "arrival", "window_count", "eligible")
    whole = serve_samples(http_events(spark, SF), flows.WINDOWS, F.col("t") >= flows.split_micros()).select(*names).collect()
    assert whole and sorted(flows.served(spark, SF).select(*names).collect()) == sorted(whole)


def test_carried_columns(spark):
    """Features bring the samples' own columns along, so nothing is joined back; whole events give the same ones."""
    samples, events = flows.served(spark, SF), http_events(spark, SF)
    joined = window_features(samples, events, flows.WINDOWS).join(samples.select("event_id", "event_time", "eligible"), "event_id")
    carried = window_features(samples, flows.serve_history(spark, SF), flows.WINDOWS, ("event_time", "eligible"))
    assert carried.count() and sorted(map(str, carried.select(*joined.columns).collect())) == sorted(map(str, joined.collect()))


def test_states_stay_apart(spark):
    """The walk over bucket states isn't joined into one task, though its rows are few."""
    rows = spark.range(40_000).select(F.lit("s").alias("source_id"), (F.col("id") % 2000).cast("string").alias("visitor_id"), (F.col("id") * 7).alias("t"), F.col("id").alias("arrival"))
    candidates = rows.withColumn("bucket", F.floor(F.col("t") / 5_000))
    steps = windows._bucket_steps(candidates, 60, 5_000).localCheckpoint()
    assert most_rows_read(spark, lambda: windows._entry_states(steps, 60).collect()) < steps.count() / 2


def test_openings_and_steps():
    rng = random.Random(8)
    for _ in range(200):
        cadence, sizes = rng.choice([1, 7, 60]), [rng.choice([0, 1, 2, 30]) for _ in range(rng.randrange(1, 9))]
        t, first, end, last, want, left, steps = [], [], [], [], [], [], []
        for size in sizes:
            t.append(-5)  # a state's row
            start = rng.randrange(1000)
            own = sorted(start + rng.choice([0, 1, 8, 59, 60, 61, 200]) * rng.randrange(3) for _ in range(size))
            now = rng.choice([windows.NEVER, start - cadence, start - 1])
            first.append(len(t))
            last.append(now)
            steps.append((own, start))
            for x in own:
                t.append(x)
                if x >= now + cadence:
                    now = x
                    want.append(len(t) - 1)
            end.append(len(t))
            left.append(now)
        kept, after = windows.openings(*map(np.array, (t, first, end, last)), cadence)
        assert kept.tolist() == want and after.tolist() == left
        at = np.append(0, np.cumsum(sizes))
        offsets, entries, exits = windows.many_gate_steps(np.array([x for own, _ in steps for x in own], np.int64), at, np.array([s for _, s in steps]), cadence)
        for k, (own, start) in enumerate(steps):
            e, x = entries[offsets[k] : offsets[k + 1]], exits[offsets[k] : offsets[k + 1]]
            for at_least in range(start, start + cadence):
                found = None
                for y in own:
                    if y >= at_least if found is None else y - found >= cadence:
                        found = y
                i = int(np.searchsorted(e, at_least))
                assert (int(x[i]) if i < len(x) else None) == found


def test_search_steps(spark):
    """As many steps as the quantiles need find the share below a score, whatever their number."""
    for n in (1, 2, 3, 7, 8, 9, 1000, 1001, 1024):
        q = [float(i // 2) for i in range(n)]
        for score in (-1.0, 0.0, q[-1] / 2, q[-1] - 0.5, q[-1], q[-1] + 1):
            got = spark.range(1).select(baseline.normalised(F.lit(score), F.array(*map(F.lit, q))).alias("x")).first()["x"] if n < 10 else spark.createDataFrame([(q, score)], "q array<double>, s double").select(baseline.normalised(F.col("s"), F.col("q")).alias("x")).first()["x"]
            assert got == sum(x <= score for x in q) / n


def test_outcomes_without_the_mart(spark, monkeypatch):
    """The outcomes and the segments are had without the daily table."""
    from tidegauge.plans import registry

    def refuse(*_):
        raise AssertionError("built the whole table")

    monkeypatch.setattr(marts, "risk_mart", refuse)
    for name in ("daily_outcomes", "baseline_usage_segments"):
        assert registry.QUERIES[name](spark, SF).count() >= 0
