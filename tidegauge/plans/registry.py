"""Registered queries over the driver's tables. Doubles are rounded to six decimals, for sums may differ in the last bits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.features import NAMES
from tidegauge.operators import baseline, dashboard, marts, quality, reads, validation
from tidegauge.operators.materialize import cut
from tidegauge.operators.validation import event_errors
from tidegauge.operators.windows import mark_late, with_window_counts
from tidegauge.plans import flows, wire
from tidegauge.plans.oracles import ORACLES  # noqa: F401  (part of the registry)
from tidegauge.schemas import LABELS
from tidegauge.sources.tables import http_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Doubles rounded, timestamps without zone, as the other engine has them."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(f: Query) -> Query:
    """Registers a query by its name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(f(spark, sf_dir))

    QUERIES[f.__name__] = run
    return run


EVENT = "event_id source_id visitor_id event_time http_method uri status_code referrer_present user_agent bytes resource_type endpoint".split()


@query
def http_events_query(spark, sf_dir):
    return http_events(spark, sf_dir).select(*EVENT)


QUERIES["http_events"] = QUERIES.pop("http_events_query")


@query
def event_validation(spark, sf_dir):
    """Errors of the events after every third lost its method and every seventh its status range."""
    broken = http_events(spark, sf_dir).withColumns({
        "http_method": F.when(F.col("arrival") % 3 == 0, "").otherwise(F.col("http_method")),
        "status_code": F.when(F.col("arrival") % 7 == 0, F.col("status_code") + 1000).otherwise(F.col("status_code")),
        "bytes": F.when(F.col("arrival") % 5 == 0, -1 - F.col("bytes")).otherwise(F.col("bytes")),
    })
    return broken.select("event_id", F.array_join(event_errors(), "; ").alias("errors"))


def listed(rows: DataFrame, constraints, *columns: str) -> DataFrame:
    """The rows that break a constraint, with what they break."""
    return validation.violating(rows, constraints).select(*columns, F.array_join("violations", "; ").alias("violations"))


def nth(n: int, broken, column: str):
    """column, but broken on every n-th event."""
    return F.when(F.col("event_id").cast("long") % n == 0, broken).otherwise(F.col(column))


@query
def event_constraint_violations(spark, sf_dir):
    """Stored events of which every few break a row constraint."""
    rows = http_events(spark, sf_dir).select("event_id", F.col("event_id").alias("id"), "event_time", F.col("arrival").alias("ingested_at"), "source_id", "visitor_id", F.to_json(F.struct("uri")).alias("payload"), F.lit("{}").alias("features"))
    broken = {
        "source_id": nth(11, F.repeat(F.lit("s"), F.lit(65)), "source_id"),
        "visitor_id": nth(13, F.repeat(F.lit("v"), F.lit(128)), "visitor_id"),
        "payload": nth(17, F.lit("{garbage"), "payload"),
        "features": nth(19, F.lit("[]"), "features"),
        "event_time": nth(23, F.lit(None), "event_time"),
    }
    return listed(rows.withColumns(broken), validation.event_constraints(), "event_id")


@query
def decision_constraint_violations(spark, sf_dir):
    """Decisions of which every few break a row constraint."""
    rows = cut(flows.decisions(spark, sf_dir)).withColumnRenamed("decision_id", "id")
    broken = {
        "score_raw": nth(5, F.lit(-0.5), "score_raw"),
        "score_normalized": nth(7, F.lit(1.5), "score_normalized"),
        "action": nth(11, F.lit("odd"), "action"),
        "risk_level": nth(13, F.lit(None), "risk_level"),
        "source_id": nth(17, F.repeat(F.lit("s"), F.lit(65)), "source_id"),
    }
    return listed(rows.withColumns(broken), validation.decision_constraints(), "event_id")


@query
def label_constraint_violations(spark, sf_dir):
    """Analyst labels on events, of which every fifth is no known one."""
    names = F.array(*(F.lit(x) for x in (*LABELS, "benign", None)))
    rows = http_events(spark, sf_dir).select("event_id", F.col("event_id").alias("decision_id"), F.get(names, (F.col("arrival") % 5).cast("int")).alias("label"))
    return listed(rows, validation.label_constraints(), "event_id", "label")


@query
def run_constraint_violations(spark, sf_dir):
    """Fitted runs with counts below zero, a hash of wrong length and a model where there must be none."""
    rows = flows.runs(spark, sf_dir).withColumns({"window_count": F.col("window_count") - 100, "registry_hash": F.when(F.col("source_id") == "src-0", "short").otherwise(F.col("registry_hash")), "baseline": F.lit("{}")})
    return listed(rows, validation.run_constraints(), "source_id")


@query
def policy_row_violations(spark, sf_dir):
    """Policy rows named after nations, of which some are too long, no object or without active."""
    key = F.col("n_nationkey")
    texts = F.array(F.lit('{"bands": []}'), F.lit("[1]"), F.lit("{bad"), F.lit("{}"))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.repeat("n_name", (key % 12).cast("int")).alias("version"), F.get(texts, (key % 4).cast("int")).alias("policy"), F.when(key % 7 > 0, key % 5 == 0).alias("active"), "n_name")
    return listed(rows, validation.policy_row_constraints(), "n_name")


@query
def resource_mix(spark, sf_dir):
    return http_events(spark, sf_dir).groupBy("source_id", "resource_type").agg(F.count("*").alias("n"), F.sum("bytes").alias("total_bytes"))


@query
def daily_traffic(spark, sf_dir):
    return marts.daily_traffic(marts.staged_events(http_events(spark, sf_dir)))


@query
def trailing_window_counts(spark, sf_dir):
    return with_window_counts(http_events(spark, sf_dir), flows.WINDOWS).select("event_id", "window_count", "eligible")


SAMPLE = ("source_id", "visitor_id", "event_id", "event_time")


@query
def fit_samples(spark, sf_dir):
    return flows.training_samples(spark, sf_dir).select(*SAMPLE, "window_count")


@query
def window_features(spark, sf_dir):
    return flows.training_features(spark, sf_dir).select("source_id", "visitor_id", "event_id", *NAMES)


@query
def fit_gate_counts(spark, sf_dir):
    return flows.gate_counts(spark, sf_dir)


@query
def feature_histogram_bins(spark, sf_dir):
    features = flows.passing_features(spark, sf_dir)
    stats = cut(baseline.feature_stats(features, flows.FIT))
    return baseline.bin_counts(features, stats, flows.FIT).join(stats.select("source_id", "ord", "name"), ["source_id", "ord"]).select("source_id", "name", "bin", F.col("n").alias("bin_count"))


@query
def baseline_histograms(spark, sf_dir):
    rows = baseline.histograms(flows.passing_features(spark, sf_dir), flows.FIT)
    mass = F.aggregate("bin_masses", F.lit(0.0), lambda a, x: a + x)
    return rows.select("source_id", "name", "transform", "p_undefined", "defined_count", "bin_min", "bin_width", F.size("bin_masses").alias("n_bins"), mass.alias("total_mass"), F.array_max("bin_masses").alias("top_mass"), "out_of_range_mass")


@query
def baseline_quantiles(spark, sf_dir):
    features = cut(flows.passing_features(spark, sf_dir))
    models = cut(baseline.histogram_arrays(baseline.histograms(features, flows.FIT)))
    return baseline.score_grid(baseline.training_scores(features, models))


@query
def baseline_runs(spark, sf_dir):
    return flows.runs(spark, sf_dir).select("id", "source_id", "status", "fit_at", "window_count", "distinct_visitors", "event_count", F.size("features_fit").alias("n_features"))


def late_arrivals(spark, sf_dir):
    """The events in an order in which every tenth comes 500 later."""
    events = http_events(spark, sf_dir)
    moved = F.col("arrival") + F.when(F.col("arrival") % 10 == 0, 500).otherwise(0)
    return events.withColumn("arrival", moved * 1_000_000_000 + F.col("arrival"))


@query
def late_events(spark, sf_dir):
    return mark_late(late_arrivals(spark, sf_dir)).groupBy("source_id").agg(F.count("*").alias("n"), F.count_if("late").alias("n_late"))


@query
def serve_gate(spark, sf_dir):
    return flows.served(spark, sf_dir).select(*SAMPLE, "window_count", "eligible")


@query
def decisions(spark, sf_dir):
    return flows.decisions(spark, sf_dir).withColumn("baseline_run_id", F.col("baseline_run_id").cast("string"))


@query
def decisions_with_event_date(spark, sf_dir):
    dated = marts.decisions_with_event_date(flows.decisions(spark, sf_dir), marts.staged_events(http_events(spark, sf_dir)))
    return dated.select("decision_id", "event_id", "source_id", "event_time", "event_date", "status", "risk_level", "action")


@query
def daily_outcomes(spark, sf_dir):
    return marts.daily_outcomes(flows.dated_decisions(spark, sf_dir)[0])


@query
def baseline_usage_segments(spark, sf_dir):
    return marts.usage_segments(*flows.dated_decisions(spark, sf_dir)).drop("baseline_features_fit", "baseline_registry_hash")


@query
def daily_risk_mart(spark, sf_dir):
    return flows.mart(spark, sf_dir).drop("baseline_usage_segments")


@query
def risk_mart_segments_unnested(spark, sf_dir):
    return dashboard.usage_rows(flows.mart(spark, sf_dir))


@query
def latest_decision_per_visitor(spark, sf_dir):
    return reads.latest_per_visitor(flows.decisions(spark, sf_dir)).select("source_id", "visitor_id", "decision_id", "decided_at", "status", "score_normalized", "action")


@query
def recent_decisions_by_source(spark, sf_dir):
    """The newest hundred of one source: the limit is the feature."""
    return reads.recent_for_source(flows.decisions(spark, sf_dir), "src-0").select("decision_id", "decided_at", "status", "action")


@query
def filter_options(spark, sf_dir):
    return dashboard.filter_options(flows.mart(spark, sf_dir))


@query
def daily_summaries_partial_day(spark, sf_dir):
    return dashboard.daily_summaries(flows.mart(spark, sf_dir), None, "2024-01-01", "2024-01-25").select("source_id", "event_date", "is_partial_day", "request_count", "scored_window_count")


@query
def kpi_totals(spark, sf_dir):
    return dashboard.kpi_totals(flows.mart(spark, sf_dir))


@query
def evaluation_rate(spark, sf_dir):
    return dashboard.evaluation_rate(flows.mart(spark, sf_dir))


@query
def risk_composition(spark, sf_dir):
    return dashboard.risk_composition(flows.mart(spark, sf_dir))


@query
def action_distribution(spark, sf_dir):
    return dashboard.action_distribution(flows.mart(spark, sf_dir))


@query
def score_trend(spark, sf_dir):
    return dashboard.score_trend(flows.mart(spark, sf_dir))


@query
def daily_requests(spark, sf_dir):
    return dashboard.daily_requests(flows.mart(spark, sf_dir))


@query
def quality_report(spark, sf_dir):
    return quality.quality_report(flows.tables(spark, sf_dir))


for _f in wire.QUERIES:
    query(_f)
