"""Event validation and row, uniqueness and reference constraints. Each gives violations, none means valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.schemas import ACTIONS, LABELS, MAX_BODY_BYTES, MAX_SOURCE_ID, MAX_VISITOR_ID, RAW_EVENT, RISK_LEVELS, RUN_STATUSES, STATUSES


def violations(*checks: tuple[Column, str | Column]) -> Column:
    """The messages of the checks that are not true, in order; an unknown outcome is a failure."""
    said = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(m) if isinstance(m, str) else m) for ok, m in checks]
    return F.filter(F.array(*said), lambda m: m.isNotNull())


def event_errors() -> Column:
    """All validation errors of an event, as array<string>."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return violations(
        (filled("source_id"), "source_id required"),
        (filled("visitor_id"), "visitor_id required"),
        (F.col("event_time").isNotNull(), "event_time required"),
        (filled("http_method"), "http_method required"),
        (filled("uri"), "uri required"),
        (F.coalesce("status_code", F.lit(0)).between(100, 599), F.concat(F.lit("status_code out of range: "), F.coalesce("status_code", F.lit(0)).cast("string"))),
        (F.coalesce("bytes", F.lit(0)) >= 0, "bytes must be non-negative"),
    )


def strict_decode(bodies: DataFrame, column: str = "body") -> DataFrame:
    """bodies with event (struct, null if it doesn't decode) and decode_error: size, syntax, unknown fields."""
    known = [f.name for f in RAW_EVENT.fields if f.name != "resource_type"]
    body = F.col(column)
    keys = F.json_object_keys(body)
    unknown = F.array_except(keys, F.array(*map(F.lit, known)))
    error = (
        F.when(F.octet_length(body) > MAX_BODY_BYTES, "body too large")
        .when(keys.isNull(), "malformed JSON")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown field: "), F.array_join(unknown, ", ")))
    )
    event = F.from_json(body, RAW_EVENT, {"mode": "PERMISSIVE"})
    return bodies.withColumn("decode_error", error).withColumn("event", F.when(F.col("decode_error").isNull(), event))


def _length(column: str, most: int) -> Column:
    """At most so many characters; empty ones are allowed."""
    return F.length(column) <= most


def _object(column: str) -> Column:
    """Whether a JSON text is an object."""
    return F.json_object_keys(F.col(column)).isNotNull()


def event_constraints() -> Column:
    names = ("id", "event_time", "ingested_at")
    return violations(
        *((F.col(c).isNotNull(), f"{c} is null") for c in names),
        (_length("source_id", MAX_SOURCE_ID), "source_id length"),
        (_length("visitor_id", MAX_VISITOR_ID), "visitor_id length"),
        (_object("payload"), "payload is no object"),
        (_object("features"), "features is no object"),
    )


def decision_constraints() -> Column:
    null, there = (lambda *c: F.lit(True) if not c else _all([F.col(x).isNull() for x in c])), (lambda *c: _all([F.col(x).isNotNull() for x in c]))
    scored = (F.col("status") == "scored") & there("score_raw", "score_normalized", "risk_level", "baseline_run_id")
    short = (F.col("status") == "insufficient_history") & null("score_raw", "score_normalized", "risk_level") & there("baseline_run_id")
    none = (F.col("status") == "no_baseline") & null("score_raw", "score_normalized", "risk_level", "baseline_run_id")
    return violations(
        *((F.col(c).isNotNull(), f"{c} is null") for c in ("id", "event_id", "decided_at", "action", "policy_version")),
        (_length("source_id", MAX_SOURCE_ID), "source_id length"),
        (_length("visitor_id", MAX_VISITOR_ID), "visitor_id length"),
        (F.col("score_raw").isNull() | (F.col("score_raw") >= 0), "score_raw is negative"),
        (F.col("score_normalized").isNull() | F.col("score_normalized").between(0, 1), "score_normalized out of range"),
        (F.col("status").isin(*STATUSES), "status"),
        (F.col("risk_level").isNull() | F.col("risk_level").isin(*RISK_LEVELS), "risk_level"),
        (F.col("action").isin(*ACTIONS), "action"),
        (scored | short | none, "status and nulls disagree"),
    )


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def run_constraints() -> Column:
    counts = ("window_count", "distinct_visitors", "event_count")
    return violations(
        (_length("source_id", MAX_SOURCE_ID), "source_id length"),
        *((F.col(c).isNotNull(), f"{c} is null") for c in ("fit_at", "features_fit")),
        *((F.col(c) >= 0, f"{c} is negative") for c in counts),
        (F.length("registry_hash") == 64, "registry_hash length"),
        (F.col("status").isin(*RUN_STATUSES), "status"),
        ((F.col("status") == "succeeded") == F.col("baseline").isNotNull(), "model present iff succeeded"),
    )


def policy_row_constraints() -> Column:
    return violations((_length("version", 64), "version length"), (F.col("active").isNotNull(), "active is null"), (_object("policy"), "policy is no object"))


def label_constraints() -> Column:
    return violations((F.col("decision_id").isNotNull(), "decision_id is null"), (F.col("label").isin(*LABELS), "label"))


def violating(rows: DataFrame, constraints: Column) -> DataFrame:
    """The rows with violations, and these.

    Constraints name a column several times, so columns that are still uncut expressions would be written out as often: cut
    computed rows first.
    """
    return rows.withColumn("violations", constraints).where(F.size("violations") > 0)


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*key).count().where("count > 1")


def too_many_active(policies: DataFrame) -> DataFrame:
    return policies.where("active").groupBy().count().where("count > 1")


def orphans(rows: DataFrame, parents: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Rows whose reference is not null and names no parent."""
    return rows.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)), column, "left_anti")


def policy_errors(policies: DataFrame) -> DataFrame:
    """(version, error) for each rule that a decoded policy (version, bands, fallback_actions) breaks."""
    bands = F.col("bands")
    labels, scores = F.transform(bands, lambda b: b["risk_level"]), F.transform(bands, lambda b: b["max_score"])
    n = F.size(bands)
    closed = F.slice(scores, 1, F.greatest(n - 1, F.lit(0)))
    rising = F.forall(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: (i >= n - 1) | (F.get(scores, i) > F.get(scores, i - 1)))
    found = violations(
        (n > 0, "no bands"),
        (F.forall(labels, lambda x: x.isin(*RISK_LEVELS)), "unknown risk level"),
        (F.size(F.array_distinct(labels)) == n, "repeated risk level"),
        (F.forall(bands, lambda b: b["action"].isin(*ACTIONS)), "unknown action"),
        (F.forall(closed, lambda s: s.isNotNull() & (s > 0) & (s <= 1)), "max_score out of range"),
        (rising, "max_score not increasing"),
        (F.try_element_at(scores, F.lit(-1)).isNull(), "last band not open"),
        (F.forall(F.array(*map(F.lit, STATUSES[1:])), lambda s: F.try_element_at("fallback_actions", s).isin(*ACTIONS)), "fallback missing"),
    )
    return policies.select("version", F.explode(found).alias("error"))
