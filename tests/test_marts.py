"""Daily tables over a busy source-day, against plain Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from itertools import groupby

import numpy as np
from pyspark.sql import functions as F

from tests.tasks import many_partitions, most_rows_read
from tidegauge.operators import marts

DAY0 = datetime(2024, 1, 5)
DATED = "source_id string, event_date date, event_time timestamp, decided_at timestamp, decision_id string, baseline_run_id long, status string, risk_level string, action string, score_normalized double"


def decisions(n=4000, seed=2):
    """Half of all decisions are of one source on one day; some have no event, some no run, some no score."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 2
        day = DAY0 if hot else DAY0 + timedelta(days=rng.randrange(6))
        at = day + timedelta(seconds=rng.randrange(86_400))
        run = rng.choice([1, 1, 1, 1, 2, None]) if hot else rng.choice([3, 4])
        status = rng.choice(["scored", "scored", "insufficient_history"]) if run else "no_baseline"
        score = rng.randrange(30) / 29 if status == "scored" else None
        lost = rng.random() < 0.02
        rows.append(("hot" if hot else f"s{i % 5}", None if lost else day.date(), None if lost else at, at + timedelta(seconds=rng.choice([0, 0, 5])), f"d{i}", run, status, "low" if score is not None else None, rng.choice(["allow", "log"]), score))
    return rows


def test_segments_of_a_hot_source_day(spark):
    rows = decisions()
    runs = spark.createDataFrame([(i, s, "succeeded", 1) for i in range(1, 5) for s in ("hot", "s0", "s2", "s4")], "baseline_run_id long, source_id string, status string, event_count int")
    runs = runs.withColumns({"fit_at": F.lit(DAY0), "window_count": F.lit(1), "distinct_visitors": F.lit(1), "registry_hash": F.lit("h"), "features_fit": F.array(F.lit("a"))})
    want = []
    low = datetime.min
    backed = sorted((r for r in rows if r[5] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or low.date(), r[2] or low, r[3], r[4]))
    for key, day in groupby(backed, key=lambda r: r[:2]):
        for k, (run, members) in enumerate(groupby(day, key=lambda r: r[5]), 1):
            m = list(members)
            want.append((*key, k, run, len(m), sum(r[6] == "scored" for r in m), m[0][3] if m[0][2] is None else m[0][2]))
    got = []
    with many_partitions(spark):
        dated = spark.createDataFrame(rows, DATED).repartition(16).cache()
        dated.count()
        most = most_rows_read(spark, lambda: got.extend(marts.usage_segments(dated, runs).collect()))
    strip = lambda x: x if x is None else x.replace(tzinfo=None)
    found = [(r["source_id"], r["event_date"], r["segment_number"], r["baseline_run_id"], r["baseline_usage_window_count"], r["scored_window_count"], r["first_event_time"]) for r in got]
    assert sorted((f[:6] for f in found), key=str) == sorted((w[:6] for w in want), key=str)
    assert {strip(f[6]) for f in found if f[1]} == {w[6] for w in want if w[1]}
    assert most < len(rows) / 10
    assert marts.usage_segments(dated.limit(0), runs).count() == 0


def test_outcomes(spark):
    rows = decisions(700)
    got = {(r["source_id"], r["event_date"]): r for r in marts.daily_outcomes(spark.createDataFrame(rows, DATED).repartition(3)).collect()}
    days = {}
    for r in rows:
        days.setdefault(r[:2], []).append(r)
    assert got.keys() == days.keys()
    for key, own in days.items():
        scores = [r[9] for r in own if r[6] == "scored"]
        g = got[key]
        assert (g["evaluated_window_count"], g["scored_window_count"], g["low_risk_count"], g["log_action_count"]) == (len(own), len(scores), len(scores), sum(r[8] == "log" for r in own))
        values = [g[c] for c in marts.SCORES]
        if scores:
            assert np.allclose(values, [np.mean(scores), np.quantile(scores, 0.9), np.quantile(scores, 0.99), max(scores)], rtol=1e-12)
        else:
            assert values == [None] * 4
