"""Stream sources: records with the columns of a broker, and the decoding of envelopes.

Topic, field and option names are those of the wire and of the broker, which other programs read and write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.uri import resource_type
from tidegauge.operators.materialize import settled
from tidegauge.schemas import DECISION_ENVELOPE, EVENT_ENVELOPE, STREAM_RECORD

TOPIC_EVENTS, TOPIC_DECISIONS, TOPIC_DEAD_LETTERS, TOPIC_SIGNALS = "raw_events", "decisions", "dead_letter_events", "baseline_signals"


#: Records after which a sink's batch is full, and the reader's setting for it. A sink with much traffic raises it.
SINK_RECORDS = 200


def broker_options(servers: str, topic: str, records: int | None = None) -> dict[str, str]:
    """The reader's options; records bounds a micro-batch, None takes all there is."""
    limit = {} if records is None else {"maxOffsetsPerTrigger": str(records)}
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"} | limit


def broker_stream(spark: SparkSession, servers: str, topic: str, records: int | None = None, **options: str) -> DataFrame:
    """Records of a broker topic, at most so many for each micro-batch; the position is in the query's checkpoint."""
    return spark.readStream.format("kafka").options(**broker_options(servers, topic, records) | options).load()


def file_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The same columns from Parquet files that arrive in a folder."""
    return spark.readStream.schema(STREAM_RECORD).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def decoded(records: DataFrame, envelope: T.StructType) -> DataFrame:
    """records with e (the envelope) and decode_error; malformed JSON and envelopes without id have an error."""
    text = F.col("value").cast("string")
    e = F.from_json(text, envelope, {"mode": "PERMISSIVE"})
    rows = records.withColumn("e", e)
    bad = F.when(F.json_object_keys(text).isNull(), "malformed JSON").when(F.col("e.event_id").isNull() | F.col("e.payload").isNull(), "incomplete envelope")
    return settled(rows.withColumn("decode_error", bad))


def events_of(records: DataFrame) -> DataFrame:
    """Decoded events, flat, with their place in the topic."""
    good = decoded(records, EVENT_ENVELOPE).where("decode_error is null")
    return good.select("topic", "partition", "offset", "timestamp", "e.event_id", "e.ingested_at", "e.source_id", "e.visitor_id", *(F.col(f"e.payload.{c}").alias(c) for c in EVENT_ENVELOPE["payload"].dataType.names if c not in ("source_id", "visitor_id")))


def decisions_of(records: DataFrame) -> DataFrame:
    """Decoded decisions, flat; malformed ones are skipped."""
    good = decoded(records, DECISION_ENVELOPE).where("decode_error is null")
    return good.select("partition", "offset", "timestamp", "e.decision_id", "e.event_id", "e.source_id", "e.visitor_id", *(F.col(f"e.payload.{c}").alias(c) for c in DECISION_ENVELOPE["payload"].dataType.names))


def dead_letters(records: DataFrame, envelope: T.StructType, at: Column | None = None) -> DataFrame:
    """Records that don't decode, as dead letters; a batch shares one time."""
    bad = decoded(records, envelope).where("decode_error is not null")
    return bad.select(
        F.col("topic").alias("original_topic"), F.col("partition").alias("original_partition"), F.col("offset").alias("original_offset"),
        F.col("decode_error").alias("reason"), (F.unix_millis(F.current_timestamp()) if at is None else at).alias("at"), F.col("value").alias("payload"),
    )


def valid_signals(records: DataFrame) -> DataFrame:
    """Baseline signals with a source and a positive run id; others are skipped."""
    s = F.from_json(F.col("value").cast("string"), "source_id string, baseline_run_id bigint")
    return records.select(s.alias("s")).select("s.*").where("source_id <> '' and baseline_run_id > 0")


def record_key() -> Column:
    return F.concat_ws(":", "source_id", "visitor_id").cast("binary")


def uuid_v7(millis: Column) -> Column:
    """A new UUID of version 7: the time in milliseconds in its first 48 bits, so that ids sort by time, and random bits."""
    random = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    time = F.lpad(F.lower(F.hex(millis)), 12, "0")
    # Of a random UUID's digits, number 13 is the version, number 17 the variant with two random bits.
    parts = (F.substring(time, 1, 8), F.substring(time, 9, 4), F.concat(F.lit("7"), F.substring(random, 14, 3)), F.substring(random, 17, 4), F.substring(random, 21, 12))
    return F.concat_ws("-", *parts)


def enveloped_events(inputs: DataFrame) -> DataFrame:
    """key and value of accepted events: an id, the ingest time and the resource class are added."""
    payload = F.struct("source_id", "visitor_id", "event_time", "http_method", "uri", "status_code", "referrer_present", F.nullif("user_agent", F.lit("")).alias("user_agent"), F.when(F.col("bytes") != 0, F.col("bytes")).alias("bytes"), resource_type(F.col("uri")).alias("resource_type"))
    now = F.unix_millis(F.current_timestamp())
    own = F.col("event_id") if "event_id" in inputs.columns else uuid_v7(now)
    envelope = F.struct(own.alias("event_id"), now.alias("ingested_at"), F.lit("v1").alias("schema_version"), "source_id", "visitor_id", payload.alias("payload"))
    return inputs.select(record_key().alias("key"), F.to_json(envelope, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).cast("binary").alias("value"))


def enveloped_decisions(decisions: DataFrame) -> DataFrame:
    """key and value of decisions as they are published."""
    payload = F.struct("decided_at", "score_raw", "score_normalized", "risk_level", "action", "status", "policy_version", "baseline_run_id")
    envelope = F.struct("decision_id", F.lit("v1").alias("schema_version"), "source_id", "visitor_id", "event_id", payload.alias("payload"))
    return decisions.select(record_key().alias("key"), F.to_json(envelope, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).cast("binary").alias("value"))
