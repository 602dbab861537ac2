"""Fitting one histogram baseline for each source, for all sources in one job."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.features import NAMES, REGISTRY, registry_hash, transformed
from tidegauge.operators.materialize import broadcast_if_small, cut
from tidegauge.operators.ranking import quantile_grid, value_ranks
from tidegauge.operators.windows import DAY_MICROS, fit_samples
from tidegauge.schemas import SCORE_QUANTILES, FitSpec, WindowSpec


def history(events: DataFrame, spec: WindowSpec, fit: FitSpec) -> DataFrame:
    """events with horizon_t, the start of the source's horizon in microseconds, from one window before it on.

    The anchors, one row a source, are counted before they are broadcast. The earliest of all horizons, one number, is also a
    plain condition on event_time, and on event_date where the table has it, which reaches the scan: row groups and
    partitions before it are not read.
    """
    if fit.horizon_days is None:
        return events.withColumn("horizon_t", F.lit(None).cast("long"))
    anchors = cut(events.groupBy("source_id").agg((F.max("t") - fit.horizon_days * DAY_MICROS).alias("horizon_t")))
    earliest = anchors.agg(F.min("horizon_t")).first()[0]
    if earliest is not None:
        since = datetime.fromtimestamp((earliest - spec.length_micros) // 1_000_000, timezone.utc)
        events = events.where(F.col("event_time") >= F.lit(since))
        if "event_date" in events.columns:
            events = events.where(F.col("event_date") >= F.lit(since.date()))
    return events.join(broadcast_if_small(anchors), "source_id").where(F.col("t") >= F.col("horizon_t") - spec.length_micros)


def horizon_samples(events: DataFrame, spec: WindowSpec) -> DataFrame:
    """The sampled windows of history() that end at or after the horizon."""
    return fit_samples(events, spec, F.col("horizon_t").isNull() | (F.col("t") >= F.col("horizon_t")))


def gate_counts(events: DataFrame, samples: DataFrame, fit: FitSpec) -> DataFrame:
    """source_id, event_count, window_count, distinct_visitors (with a sample) and passes of every source with events."""
    seen = events.where("horizon_t is null or t >= horizon_t").groupBy("source_id").agg(F.count("*").alias("event_count"))
    fitted = samples.groupBy("source_id").agg(F.count("*").alias("window_count"), F.count_distinct("visitor_id").alias("distinct_visitors"))
    zero = F.lit(0).cast("long")
    counts = seen.join(fitted, "source_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("window_count", "distinct_visitors")})
    return counts.withColumn("passes", (F.col("window_count") >= fit.min_windows) & (F.col("distinct_visitors") >= fit.min_visitors))


def unpivoted(features: DataFrame) -> DataFrame:
    """source_id, ord, name, transform and v (the transformed value, null where undefined), a row for each feature."""
    cells = [F.struct(F.lit(i).alias("ord"), F.lit(f.name).alias("name"), F.lit(f.transform).alias("transform"), transformed(F.col(f.name), f.transform).alias("v")) for i, f in enumerate(REGISTRY)]
    return features.select("source_id", F.explode(F.array(*cells)).alias("c")).select("source_id", "c.*")


def bin_index(v: Column, low: Column, width: Column, bins: int) -> Column:
    return F.least(F.greatest(F.floor(F.try_divide(v - low, width)), F.lit(0)), F.lit(bins - 1)).cast("int")


def feature_stats(features: DataFrame, fit: FitSpec) -> DataFrame:
    """source_id, ord, name, transform, total, defined, low, high and width of every source and feature."""
    stats = unpivoted(features).groupBy("source_id", "ord", "name", "transform").agg(F.count("*").alias("total"), F.count("v").alias("defined"), F.min("v").alias("low"), F.max("v").alias("high"))
    return stats.withColumn("width", (F.col("high") - F.col("low")) / fit.bins)


def bin_counts(features: DataFrame, stats: DataFrame, fit: FitSpec) -> DataFrame:
    """source_id, ord, bin and its count; a constant feature has one bin, an undefined one none.

    stats: checkpointed feature_stats, nine rows a source.
    """
    joined = unpivoted(features).where("v is not null").join(broadcast_if_small(stats.select("source_id", "ord", "low", "width")), ["source_id", "ord"])
    index = F.when(F.col("width") == 0, F.lit(0)).otherwise(bin_index(F.col("v"), F.col("low"), F.col("width"), fit.bins))
    return joined.withColumn("bin", index).groupBy("source_id", "ord", "bin").agg(F.count("*").alias("n"))


def histograms(features: DataFrame, fit: FitSpec) -> DataFrame:
    """One row for each source and feature: ord, name, transform, p_undefined, defined_count, bin_min, bin_width, bin_masses
    and out_of_range_mass. Counts are smoothed by alpha over all bins, the empty ones too."""
    a, bins = fit.alpha, fit.bins
    stats = cut(feature_stats(features, fit))
    maps = bin_counts(features, stats, fit).groupBy("source_id", "ord").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("counts"))
    rows = stats.join(maps, ["source_id", "ord"], "left")
    defined = F.col("defined")
    none, constant = defined == 0, F.col("width") == 0
    smooth = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: (F.coalesce(F.try_element_at("counts", b), F.lit(0)) + a) / (defined + bins * a))
    return rows.select(
        "source_id",
        "ord",
        "name",
        "transform",
        ((F.col("total") - defined + a) / (F.col("total") + 2 * a)).alias("p_undefined"),
        defined.cast("int").alias("defined_count"),
        F.coalesce("low", F.lit(0.0)).alias("bin_min"),
        F.coalesce("width", F.lit(0.0)).alias("bin_width"),
        F.when(none, F.array().cast("array<double>")).when(constant, F.array(F.lit(1.0))).otherwise(smooth).alias("bin_masses"),
        F.when(none, F.lit(1.0)).otherwise(a / (defined + bins * a)).alias("out_of_range_mass"),
    )


HISTOGRAM = ("name", "transform", "p_undefined", "defined_count", "bin_min", "bin_width", "bin_masses", "out_of_range_mass")


def histogram_arrays(rows: DataFrame) -> DataFrame:
    """source_id and its histograms in registry order."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", F.struct(*HISTOGRAM).alias("h"))))
    return rows.groupBy("source_id").agg(F.transform(ordered, lambda x: x["h"]).alias("histograms"))


def valid_histogram(h: Column) -> Column:
    masses, width = h["bin_masses"], h["bin_width"]
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    shape = F.when(h["defined_count"] == 0, (F.size(masses) == 0) & (width == 0)).when(width == 0, F.size(masses) == 1).otherwise(F.size(masses) > 1)
    return (h["p_undefined"] > 0) & (h["p_undefined"] < 1) & F.forall(masses, lambda m: finite(m) & (m > 0)) & (width >= 0) & finite(h["bin_min"]) & finite(h["out_of_range_mass"]) & (h["out_of_range_mass"] > 0) & shape


def valid_quantiles(q: Column) -> Column:
    return (F.size(q) > 0) & F.forall(q, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.array_sort(q) == q)


def score_terms(histograms_: Column, values: list[Column]) -> Column:
    """The contribution of each feature, as an array: -ln of the probability that the histogram gives its value.

    One expression for all features: written out for each, they are more than the compiler of the JVM takes.
    """

    def term(h: Column, v: Column) -> Column:
        low, width, masses = h["bin_min"], h["bin_width"], h["bin_masses"]
        n = F.size(masses)
        binned = F.get(masses, F.least(F.greatest(F.floor(F.try_divide(v - low, width)), F.lit(0)), n - 1).cast("int"))
        mass = (
            F.when(n == 0, h["out_of_range_mass"])
            .when(width == 0, F.when(v == low, F.get(masses, F.lit(0))).otherwise(h["out_of_range_mass"]))
            .when((v >= low) & (v <= low + width * n), binned)
            .otherwise(h["out_of_range_mass"])
        )
        return F.when(v.isNull(), -F.ln(h["p_undefined"])).otherwise(-F.ln((1 - h["p_undefined"]) * mass))

    return F.zip_with(histograms_, F.array(*(transformed(raw, f.transform) for f, raw in zip(REGISTRY, values))), term)


def raw_score(histograms_: Column, values: list[Column] | None = None) -> Column:
    """The contributions, summed in registry order; null without a model. A model of another width than the values is an error."""
    values = values or [F.col(n) for n in NAMES]
    total = F.aggregate(score_terms(histograms_, values), F.lit(0.0), lambda a, x: a + x)
    wide = F.concat(F.lit("a model of "), F.size(histograms_).cast("string"), F.lit(f" histograms can't score {len(values)} features"))
    return F.when(histograms_.isNull(), None).when(F.size(histograms_) == len(values), total).otherwise(F.raise_error(wide).cast("double"))


def cost_tables(histograms_: Column) -> Column:
    """What a score takes of each histogram: the bounds and width of its bins, the last bin, and the contributions of an
    undefined value, of one outside and of each bin. Computed once a model, they leave no logarithm to a row's score."""

    def table(h: Column) -> Column:
        low, width, masses, seen = h["bin_min"], h["bin_width"], h["bin_masses"], 1 - h["p_undefined"]
        none, constant, n = F.size(masses) == 0, width == 0, F.size(masses)
        return F.struct(
            F.when(none, F.lit(float("inf"))).otherwise(low).alias("low"),
            F.when(none, F.lit(float("-inf"))).when(constant, low).otherwise(low + width * n).alias("high"),
            F.when(constant, F.lit(1.0)).otherwise(width).alias("width"),
            F.when(constant, F.lit(0)).otherwise(n - 1).cast("long").alias("last"),
            F.concat(F.array(-F.ln(h["p_undefined"]), -F.ln(seen * h["out_of_range_mass"])), F.transform(masses, lambda m: -F.ln(seen * m))).alias("costs"),
        )

    return F.transform(histograms_, table)


def table_score(tables: Column) -> Column:
    """raw_score from cost_tables: its look-ups are interpreted for every row and feature, so they are few."""

    def cost(table: Column, v: Column) -> Column:
        at = F.least(F.floor((v - table["low"]) / table["width"]), table["last"]).cast("int")
        return F.get(table["costs"], F.when(v.isNull(), 0).when((v >= table["low"]) & (v <= table["high"]), at + 2).otherwise(1))

    total = F.aggregate(F.zip_with(tables, F.array(*(transformed(F.col(f.name), f.transform) for f in REGISTRY)), cost), F.lit(0.0), lambda a, x: a + x)
    wide = F.concat(F.lit("a model of "), F.size(tables).cast("string"), F.lit(f" histograms can't score {len(REGISTRY)} features"))
    return F.when(tables.isNull(), None).when(F.size(tables) == len(REGISTRY), total).otherwise(F.raise_error(wide).cast("double"))


#: Decimals at which scores and quantiles are compared, so that equal windows tie whatever the last bits of a sum are.
TIE_DECIMALS = 9


def normalised(raw: Column, quantiles: Column) -> Column:
    """The share of the quantiles, which are in order, that are not above the score.

    A binary search: n quantiles are known to be not above, ever shorter steps go on from there. The score is the search's
    beginning, not a part of its steps, so that the optimizer can't write it out into what runs once a quantile. There are as
    many steps as the number of quantiles has binary digits.
    """
    steps = F.slice(F.array(*(F.lit(1 << k) for k in range(30, -1, -1))), -F.length(F.bin(F.size(quantiles))), F.length(F.bin(F.size(quantiles))))
    start = F.struct(F.lit(0).alias("n"), F.round(raw, TIE_DECIMALS).alias("score"))

    def step(found: Column, width: Column) -> Column:
        passes = F.coalesce(F.round(F.get(quantiles, found["n"] + width - 1), TIE_DECIMALS) <= found["score"], F.lit(False))
        return F.struct((found["n"] + F.when(passes, width).otherwise(0)).alias("n"), found["score"].alias("score"))

    return F.aggregate(steps, start, step, lambda found: found["n"]) / F.size(quantiles)


def training_scores(features: DataFrame, models: DataFrame) -> DataFrame:
    """source_id and score of every training window under its own source's histograms."""
    tables = cut(models.select("source_id", cost_tables(F.col("histograms")).alias("tables")))
    rows = features.select("source_id", *NAMES).join(broadcast_if_small(tables, 2_000), "source_id")
    return rows.select("source_id", F.round(table_score(F.col("tables")), TIE_DECIMALS).alias("score"))


def quantile_arrays(grid: DataFrame) -> DataFrame:
    """source_id and its quantiles in order."""
    return grid.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("score_quantiles"))


def score_grid(scores: DataFrame, points: int = SCORE_QUANTILES) -> DataFrame:
    return quantile_grid(value_ranks(scores, "source_id", "score"), "source_id", "score", points)


def fit_baselines(features: DataFrame, counts: DataFrame, spec: WindowSpec, fit: FitSpec, fit_at: Column, first_id: int = 1) -> DataFrame:
    """baseline_runs: one row for each source of counts, with the model where the fit succeeded.

    A source that fails the gates is insufficient_history, one whose model isn't valid is failed; neither has a model, and
    others go on. Run ids follow first_id in the order of source_id; a window numbers the sources, of which there are few.
    """
    counts = cut(counts)
    fitted = features.join(broadcast_if_small(counts.where("passes").select("source_id")), "source_id")
    models = cut(histogram_arrays(histograms(fitted, fit)))
    quantiles = quantile_arrays(score_grid(training_scores(fitted, models)))
    rows = counts.join(models, "source_id", "left").join(quantiles, "source_id", "left")
    rows = rows.withColumn("id", F.row_number().over(Window.orderBy("source_id")).cast("long") + first_id - 1).withColumn("fit_at", fit_at)
    ok = (F.size("histograms") == len(REGISTRY)) & F.forall("histograms", valid_histogram) & valid_quantiles(F.col("score_quantiles"))
    status = F.when(~F.col("passes"), "insufficient_history").when(F.coalesce(ok, F.lit(False)), "succeeded").otherwise("failed")
    window = F.struct(F.lit(spec.length_seconds).alias("length_seconds"), F.lit(spec.cadence_seconds).alias("cadence_seconds"), F.lit(spec.min_events).alias("min_events"), F.lit(fit.horizon_days).cast("int").alias("horizon_days"))
    model = F.struct(
        F.col("id").alias("baseline_run_id"),
        "source_id",
        "fit_at",
        F.col("window_count").cast("int").alias("window_count"),
        F.col("distinct_visitors").cast("int").alias("distinct_visitors"),
        F.lit(fit.bins).alias("histogram_bins"),
        F.lit(fit.alpha).alias("smoothing_alpha"),
        window.alias("window_spec"),
        "histograms",
        "score_quantiles",
        F.lit(registry_hash()).alias("registry_hash"),
    )
    return rows.withColumn("status", status).select(
        "id",
        "source_id",
        "status",
        "fit_at",
        F.col("window_count").cast("int").alias("window_count"),
        F.col("distinct_visitors").cast("int").alias("distinct_visitors"),
        F.col("event_count").cast("int").alias("event_count"),
        F.lit(registry_hash()).alias("registry_hash"),
        F.when(F.col("status") == "succeeded", F.array(*map(F.lit, NAMES))).otherwise(F.array().cast("array<string>")).alias("features_fit"),
        F.when(F.col("status") == "succeeded", model).alias("baseline"),
    )


def baseline_signals(runs: DataFrame) -> DataFrame:
    """key and value of the update messages: one for each succeeded run."""
    return runs.where("status = 'succeeded'").select(F.col("source_id").alias("key"), F.to_json(F.struct("source_id", F.col("id").alias("baseline_run_id"))).alias("value"))
