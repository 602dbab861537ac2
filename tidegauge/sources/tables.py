"""Table sources: the events adapter, snapshots, the access-log file and published artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.uri import endpoint_path, endpoint_resource_type
from tidegauge.schemas import POLICY_DDL

SNAPSHOTS = ("events", "decisions", "baseline_runs")

EVENT_COLUMNS = "id source_id visitor_id event_time ingested_at uri http_method status_code resource_type referrer_present user_agent bytes".split()
DECISION_COLUMNS = "id event_id source_id visitor_id decided_at status score_raw score_normalized risk_level action policy_version baseline_run_id".split()
RUN_COLUMNS = "id source_id status fit_at window_count distinct_visitors event_count registry_hash features_fit".split()


def utc(spark: SparkSession) -> SparkSession:
    """The session, with its time zone set to UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def http_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events table as classified HTTP events: a page view, script, order or sign-up for each event type."""
    raw = utc(spark).read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("k")
    kind = F.col("event_type")
    uri = (
        F.when(kind == "view", F.concat(F.lit("/p/"), k.cast("string"), F.lit("?ref="), (F.col("event_id") % 5).cast("string")))
        .when(kind == "click", F.concat(F.lit("/static/app"), (k % 7).cast("string"), F.lit(".js")))
        .when(kind == "purchase", F.lit("/api/orders"))
        .when(kind == "signup", F.lit("/signup.html"))
        .otherwise(F.concat(F.lit("/missing/"), k.cast("string")))
    )
    rows = raw.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("event_id").cast("long").alias("arrival"),
        F.when(F.col("user_id") < 3, F.lit("src-small")).otherwise(F.concat(F.lit("src-"), (F.col("user_id") % 2).cast("string"))).alias("source_id"),
        F.col("user_id").cast("string").alias("visitor_id"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.when(kind.isin("purchase", "signup"), F.lit("POST")).otherwise(F.lit("GET")).alias("http_method"),
        uri.alias("uri"),
        F.when(kind == "error", F.when(k % 2 == 0, F.lit(404)).otherwise(F.lit(500))).otherwise(F.lit(200)).alias("status_code"),
        (k % 3 != 0).alias("referrer_present"),
        F.concat(F.lit("ua-"), (F.col("user_id") % 11).cast("string")).alias("user_agent"),
        F.floor(F.col("value") * 100).cast("long").alias("bytes"),
    )
    return classified(rows)


def classified(events: DataFrame) -> DataFrame:
    """Events with resource_type, endpoint and t, the event time in microseconds."""
    pathed = events.withColumn("endpoint", endpoint_path(F.col("uri")))
    return pathed.select(*events.columns, endpoint_resource_type(F.col("endpoint")).alias("resource_type"), "endpoint", F.unix_micros("event_time").alias("t"))


def snapshot_events(operational: DataFrame) -> DataFrame:
    """The events snapshot from an operational table with a JSON payload; an empty agent and zero bytes are null."""
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    return operational.select(
        "id", "source_id", "visitor_id", "event_time", "ingested_at",
        field("uri").alias("uri"),
        field("http_method").alias("http_method"),
        field("status_code").cast("int").alias("status_code"),
        field("resource_type").alias("resource_type"),
        field("referrer_present").cast("boolean").alias("referrer_present"),
        F.nullif(field("user_agent"), F.lit("")).alias("user_agent"),
        F.nullif(field("bytes").cast("bigint"), F.lit(0).cast("bigint")).alias("bytes"),
    )


def snapshot_decisions(operational: DataFrame) -> DataFrame:
    return operational.select(*DECISION_COLUMNS)


def snapshot_runs(operational: DataFrame) -> DataFrame:
    """The baseline_runs snapshot, without the model."""
    return operational.select(*RUN_COLUMNS)


def rehydrated(stored: DataFrame, schema: str) -> DataFrame:
    """Payload fields of stored events; the typed key columns win over the payload's own."""
    keys = ("source_id", "visitor_id", "event_time")
    parsed = F.from_json("payload", schema)
    rows = stored.withColumn("_p", parsed)
    names = [f.name for f in rows.schema["_p"].dataType.fields if f.name not in keys]
    return rows.select("id", *keys, *(F.col(f"_p.{n}").alias(n) for n in names))


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """An operational table over JDBC; partitionColumn and bounds go in options."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


#: A published folder has its versions, and markers whose names are numbers; the highest names the version that counts.
VERSIONS, MARKERS = "versions", "published"


def published(spark: SparkSession, folder: str) -> str | None:
    """The place of the version that a published folder's highest marker names; None if nothing was published there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{MARKERS}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    numbers = [int(n) for f in files.listStatus(path) if (n := f.getPath().getName()).isdigit()]
    return f"{folder}/{VERSIONS}/{max(numbers)}" if numbers else None


def read_published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the version that counts now; later versions don't change what was read."""
    return utc(spark).read.parquet(f"{published(spark, folder) or folder}/{name}.parquet")


def snapshot(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet snapshot by table name, of a published folder or a plain one."""
    return read_published(spark, folder, name)


def inspect_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(snapshot, path, row_count, column, type) of the three snapshots; a missing one is an error that names it."""
    out, place = None, published(spark, folder) or folder
    for name in SNAPSHOTS:
        path = f"{place}/{name}.parquet"
        try:
            table = spark.read.parquet(path)
        except Exception as e:
            raise FileNotFoundError(f"snapshot {name} can't be read at {path}") from e
        kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type")) for c, t in table.dtypes]))
        rows = table.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("snapshot"), F.lit(path).alias("path"), "row_count", kinds.alias("c")).select("snapshot", "path", "row_count", "c.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def publish_view(spark: SparkSession, path: str, view: str) -> DataFrame:
    """A published Parquet artifact as a temporary view."""
    table = spark.read.parquet(path)
    table.createOrReplaceTempView(view)
    return table


ACCESS_LOG = "IpId string, UserId string, TimeStamp string, HttpMethod string, Uri string, ResponseCode string, Referrer string, UserAgent string, Bytes string, _corrupt string"
#: Microseconds from year 1 to 1970; ticks are tenths of a microsecond.
EPOCH_MICROS = 62_135_596_800_000_000


def ticks_to_timestamp(ticks: Column) -> Column:
    """A timestamp from tenths of a microsecond since year 1."""
    micros = (ticks.cast("decimal(20,0)") / 10).cast("long")
    return F.timestamp_micros(micros - F.lit(EPOCH_MICROS))


def blank_to_null(value: Column) -> Column:
    """A trimmed value, null for an empty one or a dash."""
    v = F.trim(value)
    return F.when((v != "") & (v != "-"), v)


def access_log(spark: SparkSession, path: str, source_id: str) -> tuple[DataFrame, DataFrame]:
    """Raw events of an access-log CSV, and the rows that don't parse."""
    rows = utc(spark).read.csv(path, header=True, schema=ACCESS_LOG, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    ticks, status, size = (F.col(c).try_cast("long") for c in ("TimeStamp", "ResponseCode", "Bytes"))
    parsed = rows.select(
        F.lit(source_id).alias("source_id"),
        F.coalesce(blank_to_null(F.col("UserId")), F.trim("IpId")).alias("visitor_id"),
        ticks_to_timestamp(ticks).alias("event_time"),
        F.upper(F.trim("HttpMethod")).alias("http_method"),
        F.col("Uri").alias("uri"),
        status.cast("int").alias("status_code"),
        blank_to_null(F.col("Referrer")).isNotNull().alias("referrer_present"),
        F.nullif(F.trim("UserAgent"), F.lit("")).alias("user_agent"),
        size.alias("bytes"),
        F.col("_corrupt"),
    )
    good = F.col("_corrupt").isNull() & F.col("event_time").isNotNull() & F.col("status_code").isNotNull() & F.col("bytes").isNotNull()
    return parsed.where(good).drop("_corrupt"), parsed.where(~good)


def latest_succeeded(runs: DataFrame, source_id: str | None = None) -> DataFrame:
    """The succeeded run with the highest id of each source, or of one source."""
    done = runs.where("status = 'succeeded'")
    if source_id is not None:
        done = done.where(F.col("source_id") == source_id)
    return done.groupBy("source_id").agg(F.max_by(F.struct(*[F.col(c) for c in runs.columns]), "id").alias("r")).select("r.*")


def active_policy(policies: DataFrame) -> DataFrame:
    """The one active row of policy_versions(version, active, policy JSON), decoded; any other number is an error."""
    active = policies.where("active")
    found = active.limit(2).count()
    if found != 1:
        raise LookupError(f"{found} active policies; there must be one")
    return active.select("version", F.from_json("policy", POLICY_DDL).alias("p")).select("version", "p.bands", "p.fallback_actions")

