"""Table schemas, closed vocabularies and parameters of the HTTP behaviour engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Fixed values of the data model.
RESOURCE_TYPES = ("html", "api", "script", "style", "image", "font", "media", "document", "archive", "other")
STATUSES = ("scored", "no_baseline", "insufficient_history")
RISK_LEVELS = ("low", "medium", "high", "critical")
ACTIONS = ("allow", "log", "challenge", "block")
LABELS = ("true_positive", "false_positive", "false_negative")
RUN_STATUSES = ("succeeded", "insufficient_history", "failed")
SCHEMA_VERSION = "v1"
MAX_BODY_BYTES = 32 * 1024
MAX_SOURCE_ID = 64
MAX_VISITOR_ID = 128
HISTOGRAM_BINS = 50
SMOOTHING_ALPHA = 0.1
SCORE_QUANTILES = 1001

RAW_EVENT_FIELDS = (
    "source_id string, visitor_id string, event_time timestamp, http_method string, uri string, "
    "status_code int, referrer_present boolean, user_agent string, bytes bigint"
)
RAW_EVENT_DDL = RAW_EVENT_FIELDS + ", resource_type string"
DECISION_PAYLOAD = (
    "decided_at timestamp, score_raw double, score_normalized double, risk_level string, action string, "
    "status string, policy_version string, baseline_run_id bigint"
)
HISTOGRAM_DDL = (
    "struct<name:string,transform:string,p_undefined:double,defined_count:int,bin_min:double,bin_width:double,"
    "bin_masses:array<double>,out_of_range_mass:double>"
)
SIGNAL_DDL = "source_id string, baseline_run_id bigint"
DEAD_LETTER_DDL = "original_topic string, original_partition int, original_offset bigint, reason string, at bigint, payload binary"


SIMPLE_TYPES = {
    "string": T.StringType, "int": T.IntegerType, "bigint": T.LongType, "double": T.DoubleType,
    "boolean": T.BooleanType, "timestamp": T.TimestampType, "binary": T.BinaryType,
}


def struct(ddl: str) -> T.StructType:
    """The StructType of a list of fields of simple types; it needs no session."""
    pairs = [field.split() for field in ddl.split(",")]
    return T.StructType([T.StructField(name, SIMPLE_TYPES[kind]()) for name, kind in pairs])


RAW_EVENT = struct(RAW_EVENT_DDL)
EVENT_ENVELOPE = T.StructType(
    [*struct("event_id string, ingested_at bigint, schema_version string, source_id string, visitor_id string").fields, T.StructField("payload", RAW_EVENT)]
)
DECISION_ENVELOPE = T.StructType(
    [*struct("decision_id string, schema_version string, source_id string, visitor_id string, event_id string").fields, T.StructField("payload", struct(DECISION_PAYLOAD))]
)
STREAM_RECORD = struct("key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp")


@dataclass(frozen=True)
class WindowSpec:
    """Trailing windows: their length, the least time between samples, and the least number of events."""

    length_seconds: int = 300
    cadence_seconds: int = 60
    min_events: int = 3

    @property
    def length_micros(self) -> int:
        return self.length_seconds * 1_000_000

    @property
    def cadence_micros(self) -> int:
        return self.cadence_seconds * 1_000_000


@dataclass(frozen=True)
class FitSpec:
    """The fit horizon (None: all history) and the gates a source must pass."""

    horizon_days: int | None = 30
    min_windows: int = 3000
    min_visitors: int = 100
    bins: int = HISTOGRAM_BINS
    alpha: float = SMOOTHING_ALPHA


#: A decision policy in the documented shape: upper bounds are exclusive, the last band is open.
POLICY_V1 = {
    "version": "v1",
    "bands": [
        {"risk_level": "low", "max_score": 0.70, "action": "allow"},
        {"risk_level": "medium", "max_score": 0.90, "action": "log"},
        {"risk_level": "high", "max_score": 0.98, "action": "challenge"},
        {"risk_level": "critical", "max_score": None, "action": "block"},
    ],
    "fallback_actions": {"no_baseline": "log", "insufficient_history": "log"},
}
POLICY_DDL = "bands array<struct<risk_level:string,max_score:double,action:string>>, fallback_actions map<string,string>"
