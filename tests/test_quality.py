"""The checks find nothing in our own tables, and each finds a violation planted for it."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import dashboard, quality
from tidegauge.operators.marts import export_mart
from tidegauge.operators.materialize import cut
from tidegauge.plans import flows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    t = flows.tables(spark, SF)
    return quality.Tables(*(cut(getattr(t, f)) for f in ("events", "decisions", "runs", "dated", "traffic", "outcomes", "segments", "mart", "export")))


def one_more(df, **changes):
    """df with another copy of its first row, changed."""
    row = df.orderBy(*[c for c, t in df.dtypes if not t.startswith(("array", "struct"))]).limit(1)
    return df.unionByName(row.withColumns({k: (v if hasattr(v, "_jc") else F.lit(v)).cast(dict(df.dtypes)[k]) for k, v in changes.items()}))


def shifted(df, column, by=1):
    return df.withColumn(column, F.col(column) + by)


PLANTED = {
    "Q0": ("decisions", lambda d: one_more(d, decision_id="x", event_id="y", status="odd")),
    "Q0b": ("traffic", lambda d: one_more(d, source_id=None)),
    "Q1": ("decisions", lambda d: d.withColumn("visitor_id", F.lit("nobody"))),
    "Q2": ("dated", lambda d: one_more(d, event_time=None)),
    "Q3": ("dated", lambda d: one_more(d)),
    "Q4": ("traffic", lambda d: shifted(d, "request_count")),
    "Q5": ("traffic", lambda d: one_more(d)),
    "Q6": ("traffic", lambda d: shifted(d, "http_4xx_rate", 2)),
    "Q7": ("outcomes", lambda d: shifted(d, "low_risk_count")),
    "Q8": ("outcomes", lambda d: shifted(d, "evaluated_window_count")),
    "Q9": ("outcomes", lambda d: one_more(d)),
    "Q10": ("outcomes", lambda d: d.withColumn("maximum_normalized_score", F.lit(2.0))),
    "Q11": ("segments", lambda d: one_more(d, segment_number=F.col("segment_number") + 1)),
    "Q12": ("segments", lambda d: shifted(d, "scored_window_count")),
    "Q13": ("segments", lambda d: shifted(d, "baseline_usage_window_count")),
    "Q14": ("segments", lambda d: d.withColumn("baseline_status", F.lit(None).cast("string"))),
    "Q15": ("segments", lambda d: one_more(d)),
    "Q16": ("segments", lambda d: d.withColumn("event_date", F.date_add("event_date", 1))),
    "Q17": ("mart", lambda d: d.withColumn("request_count", F.lit(0).cast("long"))),
    "Q18": ("mart", lambda d: shifted(d, "evaluated_window_count")),
    "Q19": ("mart", lambda d: shifted(d, "distinct_uri_count")),
    "Q20": ("mart", lambda d: one_more(d)),
    "Q21": ("mart", lambda d: d.withColumn("baseline_usage_segments", F.slice("baseline_usage_segments", 1, 0))),
    "Q22": ("mart", lambda d: d.withColumn("p90_normalized_score", F.lit(3.0))),
    "Q23": ("export", lambda d: shifted(d, "request_count")),
    "Q24": ("export", lambda d: one_more(d)),
}


def test_every_check_has_a_planted_case():
    assert set(PLANTED) == set(quality.CHECKS)


@pytest.mark.parametrize("name", PLANTED)
def test_check_fires(tables, name):
    assert quality.CHECKS[name](tables).limit(1).count() == 0
    table, breaks = PLANTED[name]
    broken = replace(tables, **{table: breaks(getattr(tables, table))})
    assert quality.CHECKS[name](broken).limit(1).count() == 1


def test_report_counts_what_the_checks_find(tables):
    """In our own tables, and where several tables are broken at once."""
    own = {r["check_name"]: r["violations"] for r in quality.quality_report(tables).collect()}
    assert own == dict.fromkeys(quality.CHECKS, 0)
    for names in (("Q0", "Q4", "Q8", "Q10", "Q14", "Q23"), ("Q1", "Q0b", "Q3", "Q7", "Q11", "Q19", "Q24"), ("Q2", "Q6", "Q15", "Q17", "Q22"), ("Q5", "Q9", "Q12", "Q20"), ("Q13", "Q16", "Q18", "Q21")):
        broken = tables
        for name in names:
            table, breaks = PLANTED[name]
            broken = replace(broken, **{table: breaks(getattr(broken, table))})
        want = {name: check(broken).count() for name, check in quality.CHECKS.items()}
        assert all(want[n] for n in names)
        assert {r["check_name"]: r["violations"] for r in quality.quality_report(broken).collect()} == want


def test_export_and_dashboard(spark, tables, tmp_path):
    path = str(tmp_path / "export")
    export_mart(tables.mart, path)
    assert quality.CHECKS["Q23"](replace(tables, export=spark.read.parquet(path))).count() == 0
    assert dashboard.filter_options(tables.mart).count() == 3
    with pytest.raises(LookupError):
        dashboard.filter_options(tables.mart.limit(0))
    assert dashboard.usage_rows(tables.mart).count() == tables.segments.count()
