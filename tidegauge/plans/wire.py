"""Registered queries over sources, sinks, envelopes, policies and views; inputs are the driver's tables in the wire's forms."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import baseline, marts, reads, validation
from tidegauge.operators.materialize import checkpoint_dir, cut
from tidegauge.plans import flows
from tidegauge.schemas import EVENT_ENVELOPE, FitSpec
from tidegauge.sources import streams, tables
from tidegauge.streaming import sinks

HORIZON = FitSpec(horizon_days=7, min_windows=50, min_visitors=5)
WIRE_EVENT = ["event_id", "source_id", "visitor_id", "event_time", "http_method", "uri", "status_code", "referrer_present", "user_agent", "bytes"]
BANDS = '"fallback_actions": {"no_baseline": "log", "insufficient_history": "log"}'
#: Policies by the remainder of a nation's key: right, without bands, with bounds that fall, with unknown names and no open end.
POLICIES = (
    '{"bands": [{"risk_level": "low", "max_score": 0.7, "action": "allow"}, {"risk_level": "high", "action": "block"}], ' + BANDS + "}",
    '{"bands": [], ' + BANDS + "}",
    '{"bands": [{"risk_level": "low", "max_score": 0.7, "action": "allow"}, {"risk_level": "high", "max_score": 0.5, "action": "log"}, {"risk_level": "critical", "action": "block"}], ' + BANDS + "}",
    '{"bands": [{"risk_level": "odd", "max_score": 2.0, "action": "allow"}, {"risk_level": "odd", "max_score": 3.0, "action": "ban"}], "fallback_actions": {"no_baseline": "log"}}',
)


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def number() -> Column:
    return F.col("event_id").cast("long")


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of a topic; every thirteenth has lost its end, every seventeenth its payload."""
    made = streams.enveloped_events(tables.http_events(spark, sf_dir).select(*WIRE_EVENT))
    text = F.col("value").cast("string")
    offset = F.get_json_object(text, "$.event_id").cast("long")
    value = F.when(offset % 13 == 0, F.substring(text, 1, 40)).when(offset % 17 == 0, F.concat(F.lit('{"event_id":"'), offset.cast("string"), F.lit('"}'))).otherwise(text)
    return made.select("key", value.cast("binary").alias("value"), F.lit(streams.TOPIC_EVENTS).alias("topic"), (offset % 3).cast("int").alias("partition"), offset.alias("offset"), F.timestamp_seconds(offset).alias("timestamp"))


def event_envelopes(spark, sf_dir):
    return streams.events_of(event_records(spark, sf_dir)).select("partition", "offset", *WIRE_EVENT, "resource_type")


def event_dead_letters(spark, sf_dir):
    return streams.dead_letters(event_records(spark, sf_dir), EVENT_ENVELOPE).select("original_topic", "original_partition", "original_offset", "reason")


def decision_envelopes(spark, sf_dir):
    """Served windows as decision messages, of which every seventh is malformed and skipped."""
    made = cut(flows.served(spark, sf_dir)).select(F.concat(F.lit("d-"), "event_id").alias("decision_id"), "event_id", "source_id", "visitor_id", F.col("event_time").alias("decided_at"), F.lit(None).cast("double").alias("score_raw"), (F.col("window_count") / 1000).alias("score_normalized"), F.lit("low").alias("risk_level"), F.lit("log").alias("action"), F.lit("scored").alias("status"), F.lit("v1").alias("policy_version"), F.lit(1).cast("long").alias("baseline_run_id"))
    messages = streams.enveloped_decisions(made).withColumn("text", F.col("value").cast("string"))
    offset = F.get_json_object("text", "$.event_id").cast("long")
    records = messages.select(F.when(offset % 7 == 0, F.lit("{broken")).otherwise(F.col("text")).cast("binary").alias("value"), F.lit(0).alias("partition"), offset.alias("offset"), F.timestamp_seconds(offset).alias("timestamp"))
    return streams.decisions_of(records).select("offset", "decision_id", "event_id", "source_id", "visitor_id", "decided_at", "score_raw", "score_normalized", "risk_level", "action", "status", "policy_version", "baseline_run_id")


def operational_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored events: typed keys beside a JSON payload whose own source is another one."""
    payload = F.to_json(F.struct(F.lit("other").alias("source_id"), "uri", "http_method", "status_code", "resource_type", "referrer_present", F.when(number() % 5 == 0, "").otherwise(F.col("user_agent")).alias("user_agent"), F.when(number() % 4 == 0, 0).otherwise(F.col("bytes")).alias("bytes")))
    return tables.http_events(spark, sf_dir).select(F.col("event_id").alias("id"), "source_id", "visitor_id", "event_time", F.col("event_time").alias("ingested_at"), payload.alias("payload"))


def snapshot_of_events(spark, sf_dir):
    return tables.snapshot_events(operational_events(spark, sf_dir)).drop("ingested_at")


def rehydrated_events(spark, sf_dir):
    return tables.rehydrated(operational_events(spark, sf_dir), "source_id string, uri string, status_code int, bytes bigint")


def strict_decoding(spark, sf_dir):
    """Request bodies: every fifth has a field too many, every seventh is cut short, every eleventh is too large."""
    body = F.to_json(F.struct("source_id", "visitor_id", "uri", "status_code"))
    broken = (
        F.when(number() % 11 == 0, F.concat(F.lit('{"uri":"'), F.repeat(F.lit("x"), F.lit(33_000)), F.lit('"}')))
        .when(number() % 7 == 0, F.substring(body, 1, 20))
        .when(number() % 5 == 0, F.concat(F.lit('{"extra":1,'), F.substring(body, 2, 10_000)))
        .otherwise(body)
    )
    decoded = validation.strict_decode(tables.http_events(spark, sf_dir).select("event_id", broken.alias("body")))
    return decoded.select("event_id", "decode_error", F.col("event.uri").alias("uri"), F.col("event.status_code").alias("status_code"))


def access_log_events(spark, sf_dir):
    """Events written as an access log in CSV and read back: ticks, visitors without user, blank values, rows that don't parse."""
    ticks = ((F.col("t") + F.lit(tables.EPOCH_MICROS)) * 10).cast("string")
    rows = tables.http_events(spark, sf_dir).select(
        F.concat(F.lit("ip-"), "visitor_id").alias("IpId"),
        F.when(number() % 4 == 0, " - ").otherwise(F.concat(F.lit(" "), "visitor_id", F.lit(" "))).alias("UserId"),
        F.when(number() % 11 == 0, "soon").otherwise(ticks).alias("TimeStamp"),
        F.lower("http_method").alias("HttpMethod"),
        F.col("uri").alias("Uri"),
        F.col("status_code").cast("string").alias("ResponseCode"),
        F.when(F.col("referrer_present"), "/from").otherwise("-").alias("Referrer"),
        F.when(number() % 6 == 0, " ").otherwise(F.col("user_agent")).alias("UserAgent"),
        F.when(number() % 19 == 0, "").otherwise(F.col("bytes").cast("string")).alias("Bytes"),
    )
    path = scratch(spark, "access-log")
    rows.write.csv(path, header=True)
    return tables.access_log(spark, path, "web")[0]


def orphan_labels(spark, sf_dir):
    """Labels of decisions that were never made: every event is labelled, only served windows are decided."""
    labelled = tables.http_events(spark, sf_dir).select("event_id", F.concat(F.lit("d-"), "event_id").alias("decision_id"))
    decided = flows.served(spark, sf_dir).select(F.concat(F.lit("d-"), "event_id").alias("id"))
    return validation.orphans(labelled, decided, "decision_id").select("event_id", "decision_id")


def policy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("version"), (key == 4).alias("active"), F.get(F.array(*map(F.lit, POLICIES)), (key % 4).cast("int")).alias("policy"))


def policy_rule_errors(spark, sf_dir):
    decoded = policy_rows(spark, sf_dir).select("version", F.from_json("policy", tables.POLICY_DDL).alias("p")).select("version", "p.bands", "p.fallback_actions")
    return validation.policy_errors(decoded)


def active_policy_bands(spark, sf_dir):
    """The bands of the one active policy."""
    return tables.active_policy(policy_rows(spark, sf_dir)).select("version", F.posexplode("bands").alias("place", "b")).select("version", F.col("place").cast("long").alias("place"), "b.risk_level", "b.max_score", "b.action")


def baseline_update_signals(spark, sf_dir):
    """Signals of the succeeded runs, and one without source, as a reader takes them."""
    sent = baseline.baseline_signals(flows.runs(spark, sf_dir)).select(F.col("value").cast("binary").alias("value"))
    odd = sent.limit(1).select(F.lit('{"source_id":"","baseline_run_id":9}').cast("binary").alias("value"))
    return streams.valid_signals(sent.unionByName(odd))


def fit_samples_within_horizon(spark, sf_dir):
    """Training windows of the last seven days of each source's events before the split."""
    events = tables.http_events(spark, sf_dir).where(F.col("event_time") < F.lit(flows.SPLIT).cast("timestamp"))
    return baseline.horizon_samples(baseline.history(events, flows.WINDOWS, HORIZON), flows.WINDOWS).select("source_id", "visitor_id", "event_id", "event_time", "window_count")


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decision records: the offset within one of four partitions, arriving some at a time."""
    return tables.http_events(spark, sf_dir).select(F.concat(F.lit("d-"), "event_id").alias("decision_id"), "source_id", "visitor_id", F.col("event_time").alias("decided_at"), F.timestamp_seconds(F.floor(number() / 50)).alias("timestamp"), (number() % 4).cast("int").alias("partition"), number().alias("offset"))


def recent_arrivals(spark, sf_dir):
    """The newest 200 records across sources: the limit is the feature."""
    return reads.recent_by_arrival(arrivals(spark, sf_dir), 200).select("decision_id", "timestamp")


def backfilled_arrivals(spark, sf_dir):
    """The last 50 records of one source: the limit is the feature."""
    return reads.backfill(arrivals(spark, sf_dir), 50, "src-1").select("decision_id", "source_id")


def latest_view_after_batches(spark, sf_dir):
    """The view of each visitor's latest arrival after three batches."""
    rows, view, now = arrivals(spark, sf_dir), None, F.timestamp_seconds(F.lit(1_700_000_000))
    for k in range(3):
        view = sinks.latest_view(view, rows.where(F.col("offset") % 3 == k), now)
    return sinks.alive(view, now).select("source_id", "visitor_id", "decision_id")


def latest_of_one_visitor(spark, sf_dir):
    return reads.latest_for_visitor(arrivals(spark, sf_dir), "src-1", "7").select("source_id", "visitor_id", "decision_id", "decided_at")


def stored_once(spark, sf_dir):
    """Events sent in two overlapping batches, of which every eleventh breaks a rule: what the sink's table has."""
    path, dead = scratch(spark, "sink"), scratch(spark, "dead")
    rows = tables.http_events(spark, sf_dir).select("event_id", "source_id", F.when(number() % 11 == 0, -1).otherwise(F.col("bytes")).alias("bytes"))
    rule = F.filter(F.array(F.when(F.col("bytes") < 0, F.lit("bytes must be non-negative"))), lambda m: m.isNotNull())
    for batch in (rows.where(number() % 3 != 0), rows, rows.where(number() % 2 == 0)):
        sinks.append_once(batch, path, sinks.Projection("event_id", rule), dead)
    stored = spark.read.parquet(path).select("event_id", "source_id", "bytes")
    letters = spark.read.parquet(dead).select(F.col("id").alias("event_id"), F.col("reason").alias("source_id"), F.lit(None).cast("long").alias("bytes"))
    return stored.unionByName(letters.distinct())


def published_traffic(spark, sf_dir):
    """Daily traffic published as the second version of a folder and read by its marker."""
    folder = scratch(spark, "published")
    traffic = marts.daily_traffic(marts.staged_events(tables.http_events(spark, sf_dir)))
    sinks.publish_snapshots({"traffic": traffic.limit(0)}, folder)
    sinks.publish_snapshots({"traffic": traffic}, folder)
    return tables.snapshot(spark, folder, "traffic").select("source_id", "event_date", "request_count", "distinct_visitor_count")


QUERIES = (
    event_envelopes, event_dead_letters, decision_envelopes, snapshot_of_events, rehydrated_events, strict_decoding, access_log_events, orphan_labels,
    policy_rule_errors, active_policy_bands, baseline_update_signals, fit_samples_within_horizon, recent_arrivals, backfilled_arrivals,
    latest_view_after_batches, latest_of_one_visitor, stored_once, published_traffic,
)
