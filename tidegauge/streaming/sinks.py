"""Micro-batch sinks: idempotent appends, dead letters, and views of the latest and recent decisions."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.materialize import cut, remove_folder
from tidegauge.operators.reads import ARRIVAL, RECENT
from tidegauge.sources.tables import MARKERS, VERSIONS

#: Seconds before each attempt of a write.
RETRY_DELAYS = (0.0, 0.05, 0.2)
#: Keys without a time of their own are dealt to so many spans.
HASH_SPANS = 64
#: Spans of one batch that are read by name; a batch with more reads the table's key column.
NAMED_SPANS = 5_000


class PermanentError(Exception):
    """A write that no repetition mends: the whole batch goes to the dead letters."""


@dataclass(frozen=True)
class Reference:
    """A column whose values, if not null, must be keys of a table that append_once writes at path."""

    column: str
    path: str
    key: str = "id"


@dataclass(frozen=True)
class Projection:
    """What a sink stores: the key that makes a row unique, its constraints as array<string> of violations, its references."""

    key: str
    constraints: Column | None = None
    references: tuple[Reference, ...] = ()


@dataclass(frozen=True)
class Written:
    inserted: int
    skipped: int
    rejected: int


def key_span(key: Column) -> Column:
    """The part of a table that a key belongs to: the hour in a time-ordered UUID (version 7), else a negative hash.

    It depends on the key alone, so a redelivered row is looked for where it was stored, and nowhere else.
    """
    plain = F.lower(F.replace(key.cast("string"), F.lit("-"), F.lit("")))
    timed = plain.rlike("^[0-9a-f]{12}7[0-9a-f]{3}[89ab][0-9a-f]{15}$")
    hour = F.floor(F.conv(F.substring(plain, 1, 12), 16, 10).cast("long") / 3_600_000)
    return F.when(timed, hour).otherwise(-1 - F.pmod(F.xxhash64(key.cast("string")), F.lit(HASH_SPANS))).cast("long")


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _there(spark: SparkSession, path: str) -> bool:
    folder, files = _files(spark, path)
    return files.exists(folder)


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at path, None before its first write."""
    return spark.read.parquet(path) if _there(spark, path) else None


def stored_keys(rows: DataFrame, column: str, path: str, key: str) -> DataFrame | None:
    """The keys of the table at path in the spans of the rows' values in column; None if there are none.

    Only the folders of these spans are listed and read, so it doesn't matter how large the table is.
    """
    spark = rows.sparkSession
    spans = [r["key_span"] for r in rows.where(F.col(column).isNotNull()).select(key_span(F.col(column)).alias("key_span")).distinct().limit(NAMED_SPANS + 1).collect()]
    if len(spans) > NAMED_SPANS:
        stored = table_or_none(spark, path)
        return None if stored is None else stored.select(F.col(key).alias(column))
    folders = [f for s in sorted(spans) if _there(spark, f := f"{path}/key_span={s}")]
    return spark.read.option("basePath", path).parquet(*folders).select(F.col(key).alias(column)) if folders else None


def with_violations(batch: DataFrame, projection: Projection) -> DataFrame:
    """batch with violations: broken constraints, a missing key and references to rows that aren't there."""
    rows = batch.withColumn("violations", F.array().cast("array<string>") if projection.constraints is None else projection.constraints)
    missing = F.when(F.col(projection.key).isNull(), F.array(F.lit(f"{projection.key} is null"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("violations", F.array_union("violations", missing))
    for ref in projection.references:
        parents = stored_keys(batch, ref.column, ref.path, ref.key)
        found = F.lit(False)
        if parents is not None:
            rows = rows.join(parents.distinct().withColumn("_found", F.lit(True)), ref.column, "left")
            found = F.coalesce("_found", F.lit(False))
        orphan = F.when(F.col(ref.column).isNotNull() & ~found, F.array(F.lit(f"{ref.column} names no stored row"))).otherwise(F.array().cast("array<string>"))
        rows = rows.withColumn("violations", F.concat("violations", orphan)).select(*batch.columns, "violations")
    return rows


def dead_letters_once(bad: DataFrame, key: str, dead_path: str) -> None:
    """Writes rows with their violations as dead letters, in a folder that the rows themselves name: their number and the sum of
    their hashes. A replayed batch has the same rows, so it writes the same folder again instead of more letters."""
    columns = [c for c in bad.columns if c != "violations"]
    letters = bad.select(F.col(key).cast("string").alias("id"), F.array_join("violations", "; ").alias("reason"), F.unix_millis(F.current_timestamp()).alias("at"), F.to_json(F.struct(*columns)).cast("binary").alias("payload"))
    own = letters.agg(F.count("*").alias("n"), F.sum(F.xxhash64("id", "reason", "payload").cast("decimal(38,0)")).alias("h")).first()
    letters.write.mode("overwrite").parquet(f"{dead_path}/batch=n{own['n']}_h{own['h']}")


def retried(write: Callable[[], Written], delays: tuple[float, ...] = RETRY_DELAYS) -> Written:
    """The result of a write that is tried a bounded number of times; a permanent error ends the attempts at once."""
    for i, delay in enumerate(delays):
        time.sleep(delay)
        try:
            return write()
        except (PermanentError, AnalysisException):
            raise
        except Exception:
            if i == len(delays) - 1:
                raise


def _append(rows: DataFrame, path: str, projection: Projection) -> int:
    """Appends the rows whose key the table lacks and returns their number."""
    new = rows.dropDuplicates([projection.key])
    stored = stored_keys(new, projection.key, path, projection.key)
    if stored is not None:
        new = new.join(stored, projection.key, "left_anti").select(rows.columns)
    new = cut(new)
    inserted = new.count()
    if inserted:
        new.withColumn("key_span", key_span(F.col(projection.key))).repartition("key_span").write.mode("append").partitionBy("key_span").parquet(path)
    return inserted


def append_once(batch: DataFrame, path: str, projection: Projection, dead_path: str | None = None) -> Written:
    """Appends the rows whose key the table lacks; the table is partitioned by the spans of its keys.

    Rows that break a constraint, have no key or refer to rows that aren't stored are permanent failures: they go to the dead
    letters and the rest is written. The write is tried three times; if it fails for good (a schema that doesn't fit) the
    batch goes to the dead letters, any other failure is raised, so that the stream replays the batch. A replay changes
    neither the table nor the dead letters. Bytes read depend on the spans of the batch's keys, not on the table.
    """
    rows = cut(with_violations(batch, projection))
    good, bad = rows.where(F.size("violations") == 0).drop("violations"), rows.where(F.size("violations") > 0)
    total, rejected = rows.agg(F.count("*"), F.count_if(F.size("violations") > 0)).first()
    if rejected and dead_path:
        dead_letters_once(bad, projection.key, dead_path)
    try:
        inserted = retried(lambda: _append(good, path, projection)) if total > rejected else 0
    except (PermanentError, AnalysisException) as e:
        if not dead_path:
            raise
        reason = F.array(F.lit(f"not writable: {str(e).splitlines()[0][:200]}"))
        dead_letters_once(good.withColumn("violations", reason), projection.key, dead_path)
        return Written(0, 0, total)
    return Written(inserted, total - rejected - inserted, rejected)


def start_append(stream: DataFrame, path: str, projection: Projection, checkpoint: str, dead_path: str | None = None, interval: str = "500 milliseconds", on_batch: Callable[[Written], None] | None = None):
    """A query that appends a stream once; the interval and the source's limit per trigger set the size of a batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        written = append_once(batch, path, projection, dead_path)
        if on_batch:
            on_batch(written)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


TTL_SECONDS = 30 * 60


def latest_view(view: DataFrame | None, batch: DataFrame, now: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """The latest decision of each visitor after a batch of arrivals; a visitor's row expires after its last write."""
    fresh = batch.withColumn("expires_at", now + F.make_dt_interval(secs=F.lit(ttl_seconds)))
    rows = fresh if view is None else view.where(F.col("expires_at") > now).unionByName(fresh)
    newest = F.max_by(F.struct(*fresh.columns), F.struct(*ARRIVAL))
    return rows.groupBy("source_id", "visitor_id").agg(newest.alias("d")).select("d.*")


def alive(view: DataFrame, now: Column) -> DataFrame:
    return view.where(F.col("expires_at") > now)


def recent_view(view: DataFrame | None, batch: DataFrame, size: int = RECENT) -> DataFrame:
    """The newest decisions by arrival after a batch."""
    rows = batch if view is None else view.unionByName(batch)
    return rows.orderBy(*map(F.desc, ARRIVAL)).limit(size)


def live_feed(decisions: DataFrame, source_id: str = "") -> DataFrame:
    """The decision stream of one source, or of all."""
    return decisions.where(F.col("source_id") == source_id) if source_id.strip() else decisions


def publish_snapshots(tables: dict[str, DataFrame], folder: str, keep: int = 2) -> str:
    """Publishes tables as the next version of folder and returns its place; readers find it by sources.tables.published.

    All tables are written into a new version's folder. One marker file, renamed into place, then makes the version count, so
    readers see all tables of one version, the last that was complete; a crash before leaves a folder that no marker names
    and the next run removes. The newest versions, `keep` of them, stay for readers that are under way.
    """
    spark = next(iter(tables.values())).sparkSession
    markers, files = _files(spark, f"{folder}/{MARKERS}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files.mkdirs(markers)
    numbers = sorted(int(n) for f in files.listStatus(markers) if (n := f.getPath().getName()).isdigit())
    number = numbers[-1] + 1 if numbers else 1
    place = f"{folder}/{VERSIONS}/{number}"
    remove_folder(spark, place)
    for name, table in tables.items():
        table.write.option("compression", "zstd").parquet(f"{place}/{name}.parquet")
    made = path(f"{folder}/{MARKERS}/_{number}")
    files.create(made, True).close()
    if not files.rename(made, path(f"{folder}/{MARKERS}/{number}")):
        raise OSError(f"can't publish version {number} of {folder}")
    for old in [*numbers, number][:-keep]:
        files.delete(path(f"{folder}/{MARKERS}/{old}"), False)
        remove_folder(spark, f"{folder}/{VERSIONS}/{old}")
    return place
