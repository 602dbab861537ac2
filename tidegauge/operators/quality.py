"""Data-quality checks of the daily tables. Each gives the violating rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.marts import DAY, EXPORT, OUTCOME_COUNTS, SCORES, daily_outcomes, segment_lists
from tidegauge.schemas import ACTIONS, RISK_LEVELS, RUN_STATUSES, STATUSES


@dataclass(frozen=True)
class Tables:
    """What the checks read."""

    events: DataFrame  # staged
    decisions: DataFrame
    runs: DataFrame  # staged
    dated: DataFrame
    traffic: DataFrame
    outcomes: DataFrame
    segments: DataFrame
    mart: DataFrame
    export: DataFrame


def repeats(table: DataFrame, *grain: str) -> DataFrame:
    """Values of the grain that more than one row has."""
    return table.groupBy(*grain).agg(F.count("*").alias("n")).where("n > 1")


def failing(table: DataFrame, ok: Column) -> DataFrame:
    """Rows for which the condition is not true."""
    return table.where(~F.coalesce(ok, F.lit(False)))


def missing_values(table: DataFrame, *columns: str) -> DataFrame:
    return table.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def unaccepted(table: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    return table.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def counts_differ(left: DataFrame, right: DataFrame) -> DataFrame:
    """The two one-row counts, if they aren't equal."""
    return left.crossJoin(F.broadcast(right)).where("left_count <> right_count")


def _preserves(rows: DataFrame, sums: DataFrame, column: str) -> DataFrame:
    return counts_differ(rows.agg(F.count("*").alias("left_count")), sums.agg(F.coalesce(F.sum(column), F.lit(0)).alias("right_count")))


def _sum(names: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(n) for n in names])


def consistent_outcomes() -> Column:
    """Statuses add up to the evaluated windows, risks to the scored ones, actions to the evaluated ones."""
    by_status = [f"{s}_window_count" for s in STATUSES]
    return (
        (F.col("evaluated_window_count") == _sum(by_status))
        & (F.col("scored_window_count") == _sum([f"{r}_risk_count" for r in RISK_LEVELS]))
        & (F.col("evaluated_window_count") == _sum([f"{a}_action_count" for a in ACTIONS]))
        & (F.least(*OUTCOME_COUNTS) >= 0)
    )


def consistent_mart() -> Column:
    return consistent_outcomes() & (F.col("evaluated_window_count") <= F.col("request_count"))


def valid_scores() -> Column:
    """All null if nothing was scored; else within 0 and 1 and in order."""
    average, p90, p99, most = (F.col(c) for c in SCORES)
    none = average.isNull() & p90.isNull() & p99.isNull() & most.isNull()
    order = average.between(0, 1) & (p90 >= 0) & (p90 <= p99) & (p99 <= most) & (average <= most) & (most <= 1)
    return F.when(F.col("scored_window_count") == 0, none).otherwise(F.coalesce(order, F.lit(False)))


def valid_traffic() -> Column:
    n = F.col("request_count")
    parts = [F.col(c).between(0, n) for c in ("http_4xx_count", "referrer_present_count")] + [F.col(c).between(1, n) for c in ("distinct_visitor_count", "distinct_uri_count")]
    rates = [F.col(c).between(0, 1) for c in ("http_4xx_rate", "referrer_present_rate")]
    return reduce(lambda a, b: a & b, [n > 0, *parts, *rates])


def differing(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Days of which one side has none or another value: missing, unexpected or changed."""
    joined = left.select(*DAY, F.struct(*columns).alias("a")).join(right.select(*DAY, F.struct(*columns).alias("b")), [*DAY], "full_outer")
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return joined.select(*DAY, kind.alias("kind")).where("kind is not null")


def _identity(t: Tables) -> DataFrame:
    both = t.decisions.alias("d").join(t.events.alias("e"), "event_id")
    return both.where(~F.col("d.source_id").eqNullSafe(F.col("e.source_id")) | ~F.col("d.visitor_id").eqNullSafe(F.col("e.visitor_id"))).select("event_id")


def _adjacent(t: Tables) -> DataFrame:
    order = Window.partitionBy(*DAY).orderBy("segment_number")
    return t.segments.withColumn("previous", F.lag("baseline_run_id").over(order)).where("previous = baseline_run_id")


def _segment_spans(t: Tables) -> DataFrame:
    return failing(t.segments, valid_spans())


def _matching_counts(t: Tables) -> DataFrame:
    recomputed = daily_outcomes(t.dated).select(*DAY, *OUTCOME_COUNTS)
    days = t.mart.where("evaluated_window_count > 0").select(*DAY, *OUTCOME_COUNTS)
    return differing(recomputed, days, list(OUTCOME_COUNTS))


def _segment_list(t: Tables) -> DataFrame:
    return differing(segment_lists(t.segments), t.mart.where("baseline_usage_segments is not null"), ["baseline_usage_segments"])


def _export(t: Tables) -> DataFrame:
    a, b = t.mart.select(*EXPORT), t.export.select(*EXPORT)
    return a.exceptAll(b).withColumn("side", F.lit("mart")).unionByName(b.exceptAll(a).withColumn("side", F.lit("export")))


EVENT_VALUES = ("event_id", "source_id", "visitor_id", "event_time", "event_date", "uri", "http_method", "status_code", "resource_type", "referrer_present")
DECISION_VALUES = ("decision_id", "event_id", "source_id", "visitor_id", "decided_at", "status", "action", "policy_version")
RUN_VALUES = ("baseline_run_id", "source_id", "status", "fit_at", "registry_hash")
DATED_VALUES = ("decision_id", "event_id", "source_id", "status", "action")
SEGMENT_VALUES = (*DAY, "segment_number", "baseline_run_id", "first_event_time", "last_event_time")


def _generic(t: Tables) -> DataFrame:
    """not_null, unique and accepted_values of the staged columns, as labelled rows."""
    checks = {
        "events null": missing_values(t.events, *EVENT_VALUES),
        "events unique": repeats(t.events, "event_id"),
        "decisions null": missing_values(t.decisions, *DECISION_VALUES),
        "decisions unique": repeats(t.decisions, "decision_id"),
        "decision events unique": repeats(t.decisions, "event_id"),
        "status": unaccepted(t.decisions, "status", STATUSES),
        "risk_level": unaccepted(t.decisions, "risk_level", RISK_LEVELS),
        "action": unaccepted(t.decisions, "action", ACTIONS),
        "runs null": missing_values(t.runs, *RUN_VALUES),
        "runs unique": repeats(t.runs, "baseline_run_id"),
        "run status": unaccepted(t.runs, "status", RUN_STATUSES),
    }
    return reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("label")) for k, d in checks.items()])


def _generic_marts(t: Tables) -> DataFrame:
    checks = {
        "dated null": missing_values(t.dated, *DATED_VALUES),
        "traffic null": missing_values(t.traffic, *t.traffic.columns),
        "outcomes null": missing_values(t.outcomes, *DAY, *OUTCOME_COUNTS),
        "segments null": missing_values(t.segments, *SEGMENT_VALUES),
        "mart null": missing_values(t.mart, *DAY, "request_count", *OUTCOME_COUNTS),
        "export null": missing_values(t.export, *DAY, "request_count"),
    }
    return reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("label")) for k, d in checks.items()])


def same_usage() -> Column:
    return F.col("baseline_usage_window_count") == F.col("scored_window_count") + F.col("insufficient_history_window_count")


def valid_spans() -> Column:
    """A segment's times are in order, after its baseline's fit, and on its day."""
    ordered = (F.col("first_event_time") <= F.col("last_event_time")) & (F.col("first_decided_at") <= F.col("last_decided_at")) & (F.col("baseline_fit_at") <= F.col("first_decided_at"))
    return ordered & (F.to_date("first_event_time") == F.col("event_date")) & (F.to_date("last_event_time") == F.col("event_date"))


CHECKS: dict[str, Callable[[Tables], DataFrame]] = {
    "Q0": _generic,
    "Q0b": _generic_marts,
    "Q1": _identity,
    "Q2": lambda t: t.dated.where("event_time is null"),
    "Q3": lambda t: counts_differ(t.decisions.agg(F.count("*").alias("left_count")), t.dated.agg(F.count("*").alias("right_count"))),
    "Q4": lambda t: _preserves(t.events, t.traffic, "request_count"),
    "Q5": lambda t: repeats(t.traffic, *DAY),
    "Q6": lambda t: failing(t.traffic, valid_traffic()),
    "Q7": lambda t: failing(t.outcomes, consistent_outcomes()),
    "Q8": lambda t: _preserves(t.dated, t.outcomes, "evaluated_window_count"),
    "Q9": lambda t: repeats(t.outcomes, *DAY),
    "Q10": lambda t: failing(t.outcomes, valid_scores()),
    "Q11": _adjacent,
    "Q12": lambda t: failing(t.segments, same_usage()),
    "Q13": lambda t: _preserves(t.dated.where("baseline_run_id is not null"), t.segments, "baseline_usage_window_count"),
    "Q14": lambda t: failing(t.segments, F.col("baseline_status") == "succeeded"),
    "Q15": lambda t: repeats(t.segments, *DAY, "segment_number"),
    "Q16": _segment_spans,
    "Q17": lambda t: failing(t.mart, consistent_mart()),
    "Q18": _matching_counts,
    "Q19": lambda t: differing(t.traffic, t.mart, [c for c in t.traffic.columns if c not in DAY]),
    "Q20": lambda t: repeats(t.mart, *DAY),
    "Q21": _segment_list,
    "Q22": lambda t: failing(t.mart, valid_scores()),
    "Q23": _export,
    "Q24": lambda t: repeats(t.export, *DAY),
}


def _filled(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def _accepted(column: str, values: tuple[str, ...]) -> Column:
    return F.col(column).isNull() | F.col(column).isin(*values)


def measures(table: DataFrame, grain: tuple[str, ...], unique: tuple[str, ...] = (), rules: tuple[tuple[str, Column], ...] = (), balances: tuple[tuple[str, int, Column], ...] = ()) -> DataFrame:
    """(check_name, violations, balance) of all checks that one table decides by itself, in one pass over it.

    Rows are counted by the grain: groups of more than one row violate `unique`, rows for which a rule isn't true violate
    its check, and what a balance adds up enters its check with a sign. Everything is counted partly before the shuffle.
    """
    counted = table.groupBy(*grain).agg(
        F.count("*").alias("n"),
        *(F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"rule_{i}") for i, (_, ok) in enumerate(rules)),
        *(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(f"sum_{i}") for i, (_, _, value) in enumerate(balances)),
    )
    found = [(check, F.count_if(F.col("n") > 1), F.lit(0)) for check in unique]
    found += [(check, F.coalesce(F.sum(f"rule_{i}"), F.lit(0)), F.lit(0)) for i, (check, _) in enumerate(rules)]
    found += [(check, F.lit(0), sign * F.coalesce(F.sum(f"sum_{i}"), F.lit(0))) for i, (check, sign, _) in enumerate(balances)]
    cells = F.array(*[F.struct(F.lit(check).alias("check_name"), v.cast("long").alias("violations"), b.cast("long").alias("balance")) for check, v, b in found])
    return counted.agg(cells.alias("cells")).select(F.inline("cells"))


def quality_report(t: Tables) -> DataFrame:
    """(check_name, violations) for every check; the same numbers as the rows of CHECKS.

    Each table is read once for all that it decides by itself, and once more for each other key that must be unique and each
    comparison of two tables.
    """
    one, backed = F.lit(1), F.col("baseline_run_id").isNotNull().cast("long")
    parts = [
        measures(t.events, ("event_id",), ("Q0",), (("Q0", _filled(*EVENT_VALUES)),), (("Q4", 1, one),)),
        measures(
            t.decisions,
            ("decision_id",),
            ("Q0",),
            (("Q0", _filled(*DECISION_VALUES)), ("Q0", _accepted("status", STATUSES)), ("Q0", _accepted("risk_level", RISK_LEVELS)), ("Q0", _accepted("action", ACTIONS))),
            (("Q3", 1, one),),
        ),
        measures(t.decisions, ("event_id",), ("Q0",)),
        measures(t.runs, ("baseline_run_id",), ("Q0",), (("Q0", _filled(*RUN_VALUES)), ("Q0", _accepted("status", RUN_STATUSES)))),
        measures(t.dated, (), (), (("Q0b", _filled(*DATED_VALUES)), ("Q2", F.col("event_time").isNotNull())), (("Q3", -1, one), ("Q8", 1, one), ("Q13", 1, backed))),
        measures(t.traffic, DAY, ("Q5",), (("Q0b", _filled(*t.traffic.columns)), ("Q6", valid_traffic())), (("Q4", -1, F.col("request_count")),)),
        measures(t.outcomes, DAY, ("Q9",), (("Q0b", _filled(*DAY, *OUTCOME_COUNTS)), ("Q7", consistent_outcomes()), ("Q10", valid_scores())), (("Q8", -1, F.col("evaluated_window_count")),)),
        measures(
            t.segments,
            (*DAY, "segment_number"),
            ("Q15",),
            (("Q0b", _filled(*SEGMENT_VALUES)), ("Q12", same_usage()), ("Q14", F.col("baseline_status") == "succeeded"), ("Q16", valid_spans())),
            (("Q13", -1, F.col("baseline_usage_window_count")),),
        ),
        measures(t.mart, DAY, ("Q20",), (("Q0b", _filled(*DAY, "request_count", *OUTCOME_COUNTS)), ("Q17", consistent_mart()), ("Q22", valid_scores()))),
        measures(t.export, DAY, ("Q24",), (("Q0b", _filled(*DAY, "request_count")),)),
    ]
    between = [CHECKS[name](t).agg(F.lit(name).alias("check_name"), F.count("*").alias("violations"), F.lit(0).cast("long").alias("balance")) for name in ("Q1", "Q11", "Q18", "Q19", "Q21", "Q23")]
    added = reduce(DataFrame.unionByName, [*parts, *between]).groupBy("check_name").agg(F.sum("violations").alias("v"), F.sum("balance").alias("b"))
    return added.select("check_name", (F.col("v") + (F.col("b") != 0).cast("long")).alias("violations"))
