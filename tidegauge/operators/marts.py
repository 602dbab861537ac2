"""Daily tables over events, decisions and baseline runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.schemas import ACTIONS, RISK_LEVELS

DAY = ("source_id", "event_date")
OUTCOME_COUNTS = (
    "evaluated_window_count",
    "scored_window_count",
    "no_baseline_window_count",
    "insufficient_history_window_count",
    *(f"{r}_risk_count" for r in RISK_LEVELS),
    *(f"{a}_action_count" for a in ACTIONS),
)
SCORES = ("average_normalized_score", "p90_normalized_score", "p99_normalized_score", "maximum_normalized_score")
SEGMENT_FIELDS = (
    "segment_number",
    "baseline_run_id",
    "first_event_time",
    "last_event_time",
    "baseline_usage_window_count",
    "scored_window_count",
    "insufficient_history_window_count",
    "baseline_fit_at",
)


def staged_events(events: DataFrame) -> DataFrame:
    """Events with the day in UTC and is_4xx."""
    return events.withColumn("event_date", F.to_date("event_time")).withColumn("is_4xx", F.col("status_code").between(400, 499))


def staged_decisions(snapshot: DataFrame) -> DataFrame:
    return snapshot.withColumnRenamed("id", "decision_id")


def staged_runs(snapshot: DataFrame) -> DataFrame:
    return snapshot.withColumnRenamed("id", "baseline_run_id")


def daily_traffic(staged: DataFrame) -> DataFrame:
    """Requests, distinct visitors and URIs, 4xx and referrer counts and rates by source and day."""
    counted = staged.groupBy(*DAY).agg(
        F.count("*").alias("request_count"),
        F.count_distinct("visitor_id").alias("distinct_visitor_count"),
        F.count_distinct("uri").alias("distinct_uri_count"),
        F.count_if("is_4xx").alias("http_4xx_count"),
        F.count_if("referrer_present").alias("referrer_present_count"),
    )
    return counted.withColumns({f"{n}_rate": F.col(f"{n}_count").cast("double") / F.col("request_count") for n in ("http_4xx", "referrer_present")})


def decisions_with_event_date(decisions: DataFrame, staged: DataFrame) -> DataFrame:
    """Every decision with its event's time and day, null if there is no such event."""
    return decisions.join(staged.select("event_id", "event_time", "event_date"), "event_id", "left")


def daily_outcomes(dated: DataFrame) -> DataFrame:
    """Counts by status, risk and action, and average, exact quantiles and maximum of the scores, by source and day.

    Decisions are first counted by day and score, of which there are no more than the baseline has quantiles, partly before
    the shuffle; running counts over the distinct scores then give the quantiles. No buffer holds a day's scores.
    """
    scored, score = F.col("status") == "scored", F.col("score_normalized")
    counts = {
        "evaluated_window_count": F.count("*"),
        **{f"{s}_window_count": F.count_if(F.col("status") == s) for s in ("scored", "no_baseline", "insufficient_history")},
        **{f"{r}_risk_count": F.count_if(F.col("risk_level") == r) for r in RISK_LEVELS},
        **{f"{a}_action_count": F.count_if(F.col("action") == a) for a in ACTIONS},
    }
    by_score = dated.groupBy(*DAY, F.when(scored, score).alias("value")).agg(*(c.alias(n) for n, c in counts.items()))
    rows = F.when(F.col("value").isNotNull(), F.col("evaluated_window_count")).otherwise(0)
    day = Window.partitionBy(*DAY)
    placed = by_score.withColumn("n", rows).withColumn("upto", F.sum("n").over(day.orderBy("value"))).withColumn("all", F.sum("n").over(day))
    at = lambda k: F.max(F.when((F.col("upto") - F.col("n") <= k) & (k < F.col("upto")), F.col("value")))

    def quantile(p: float) -> Column:
        """Linear between the two nearest places of p (n - 1)."""
        place = F.lit(p) * (F.col("all") - 1)
        low, high, share = F.floor(place), F.ceil(place), place - F.floor(place)
        return at(low) + F.max(share) * (at(high) - at(low))

    return placed.groupBy(*DAY).agg(
        *(F.sum(n).alias(n) for n in counts),
        F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum("n")).alias("average_normalized_score"),
        quantile(0.90).alias("p90_normalized_score"),
        quantile(0.99).alias("p99_normalized_score"),
        F.max("value").alias("maximum_normalized_score"),
    )


#: The part of a day in which decisions are numbered together.
SEGMENT_MICROS = 600_000_000


def usage_segments(dated: DataFrame, runs: DataFrame, length: int = SEGMENT_MICROS) -> DataFrame:
    """Runs of consecutive decisions of a source and day under one baseline, with that baseline's context.

    Decisions are numbered inside short spans of the day; one row a span has its first and last run id and the changes
    inside, and over these rows the number of the span's first segment is carried on. A busy day is many groups. Decisions
    without event have no day and are in order of their own time.
    """
    span = F.floor(F.unix_micros(F.coalesce("event_time", "decided_at")) / F.lit(length)).cast("long")
    place = F.struct("event_time", "decided_at", "decision_id")
    backed = dated.where("baseline_run_id is not null").withColumns({"span": span, "source": F.coalesce("source_id", F.lit("")), "day": F.coalesce("event_date", F.lit("0001-01-01").cast("date"))})
    key = ("source", "day", "span")
    inside = Window.partitionBy(*key).orderBy("event_time", "decided_at", "decision_id")
    marked = backed.withColumn("change", F.coalesce(F.col("baseline_run_id") != F.lag("baseline_run_id").over(inside), F.lit(False)).cast("long"))
    changed = marked.withColumn("changes", F.sum("change").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = changed.groupBy(*key).agg(F.min_by("baseline_run_id", place).alias("first"), F.max_by("baseline_run_id", place).alias("last"), F.max("changes").alias("inner"))
    in_order = Window.partitionBy("source", "day").orderBy("span")
    opens = F.when(F.col("first").eqNullSafe(F.lag("last").over(in_order)), 0).otherwise(1)
    opened = spans.withColumn("opens", opens)
    before = F.sum(F.col("opens") + F.col("inner")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("inner")
    numbered = changed.join(opened.select(*key, before.alias("first_number")), list(key)).withColumn("segment_number", (F.col("first_number") + F.col("changes")).cast("long"))
    segments = numbered.groupBy(*DAY, "segment_number", "baseline_run_id").agg(
        F.count("*").alias("baseline_usage_window_count"),
        F.count_if(F.col("status") == "scored").alias("scored_window_count"),
        F.count_if(F.col("status") == "insufficient_history").alias("insufficient_history_window_count"),
        F.min("event_time").alias("first_event_time"),
        F.max("event_time").alias("last_event_time"),
        F.min("decided_at").alias("first_decided_at"),
        F.max("decided_at").alias("last_decided_at"),
    )
    context = runs.select(
        "baseline_run_id",
        "source_id",
        F.col("status").alias("baseline_status"),
        F.col("fit_at").alias("baseline_fit_at"),
        F.col("event_count").alias("baseline_event_count"),
        F.col("window_count").alias("baseline_window_count"),
        F.col("distinct_visitors").alias("baseline_distinct_visitor_count"),
        F.col("registry_hash").alias("baseline_registry_hash"),
        F.col("features_fit").alias("baseline_features_fit"),
    )
    return segments.join(context, ["baseline_run_id", "source_id"], "left")


def segment_lists(segments: DataFrame) -> DataFrame:
    """The segments of each source and day as an ordered list."""
    return segments.groupBy(*DAY).agg(F.array_sort(F.collect_list(F.struct(*SEGMENT_FIELDS))).alias("baseline_usage_segments"))


def risk_mart(traffic: DataFrame, outcomes: DataFrame, segments: DataFrame) -> DataFrame:
    """One row for each source and day with traffic; days without decisions have zero counts and null scores."""
    joined = traffic.join(outcomes, [*DAY], "left").join(segment_lists(segments), [*DAY], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in OUTCOME_COUNTS})


def build_mart(events: DataFrame, decisions: DataFrame, runs: DataFrame) -> DataFrame:
    staged = staged_events(events)
    dated = decisions_with_event_date(decisions, staged)
    return risk_mart(daily_traffic(staged), daily_outcomes(dated), usage_segments(dated, staged_runs(runs)))


EXPORT = (
    *DAY,
    *("request_count distinct_visitor_count distinct_uri_count http_4xx_count http_4xx_rate referrer_present_count referrer_present_rate".split()),
    *OUTCOME_COUNTS,
    *SCORES,
    "baseline_usage_segments",
)


def export_mart(mart: DataFrame, path: str) -> None:
    """Writes the mart's public columns as Parquet, in the order of source and day across and inside the files."""
    mart.select(*EXPORT).repartitionByRange(*DAY).sortWithinPartitions(*DAY).write.mode("overwrite").option("compression", "zstd").parquet(path)


def materialise(views: dict[str, DataFrame], tables: dict[str, DataFrame]) -> None:
    """Registers staging and intermediate tables as temporary views and saves marts as tables."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    for name, df in tables.items():
        df.write.mode("overwrite").saveAsTable(name)
