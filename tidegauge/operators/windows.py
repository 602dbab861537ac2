"""Trailing windows per visitor, late events and cadence gates.

Everything here works on time buckets of a visitor, never on the visitor as a whole: a bucket holds the events of a span of
time, summaries of one row a bucket carry what later or earlier buckets must know. So a visitor with a third of all events
is as many groups as it has busy buckets.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.schemas import WindowSpec

VISITOR = ("source_id", "visitor_id")
BUCKET = (*VISITOR, "bucket")
#: The order of buckets in a task. The visitor comes first: a sort compares a prefix of its first column, and sources are few.
IN_ORDER = ("visitor_id", "source_id", "bucket")
DAY_MICROS = 86_400_000_000


def bucket_micros(spec: WindowSpec) -> int:
    """The length of the time buckets for windows of this spec: a window lies in one bucket or in it and the end of the one before."""
    return 2 * spec.length_micros


def in_bucket(t: Column, length: int) -> Column:
    return F.floor(t / F.lit(length)).cast("long")


def with_guests(events: DataFrame, spec: WindowSpec, guest_columns: tuple[str, ...] = ("t",)) -> DataFrame:
    """events with bucket and guest: each event in its own bucket, and again, as a guest with only guest_columns, in the next
    one if a window that ends there may hold it. A bucket with its guests holds all windows that end in it."""
    length = bucket_micros(spec)
    own = in_bucket(F.col("t"), length)
    reach = F.when(F.col("t") >= (own + 1) * length - spec.length_micros, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = events.withColumn("_ahead", F.explode(reach))
    kept = {*VISITOR, *guest_columns}
    columns = [F.col(c) if c in kept else F.when(F.col("_ahead") == 0, F.col(c)).alias(c) for c in events.columns]
    return spread.select(*columns, (own + F.col("_ahead")).alias("bucket"), (F.col("_ahead") == 1).alias("guest"))


def mark_late(events: DataFrame, arrival: str = "arrival", bucket: int = DAY_MICROS) -> DataFrame:
    """events with late: the event is older than one of the same visitor that arrived before; equal times are not late.

    Turned round, an event is late if the first arrival among the visitor's newer events comes before its own: in its bucket
    by a running minimum from the newest event on, over newer buckets by one carried row for each bucket.
    """
    dealt = events.withColumn("bucket", in_bucket(F.col("t"), bucket))
    place = F.struct(F.col(arrival).alias("a"), F.col("event_id").alias("e"))
    firsts = dealt.groupBy(*BUCKET).agg(F.min(place).alias("first"))
    newer_buckets = Window.partitionBy(*VISITOR).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = firsts.select(*BUCKET, F.min("first").over(newer_buckets).alias("carried"))
    newer = Window.partitionBy(*BUCKET).orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("_newer", F.min(place).over(newer)).join(carried, list(BUCKET))
    late = F.coalesce(F.least("_newer", "carried") < place, F.lit(False))
    return inside.withColumn("late", late).select(*events.columns, "late")


def with_window_counts(events: DataFrame, spec: WindowSpec) -> DataFrame:
    """events with window_count, the visitor's events in [t - length, t] up to this one in (t, arrival) order, eligible and bucket.

    A RANGE frame would also count later events of the same instant; the row number minus what has left the window doesn't.
    """
    place = F.row_number().over(Window.partitionBy(*BUCKET).orderBy("t", "arrival"))
    gone = F.count("*").over(Window.partitionBy(*BUCKET).orderBy("t").rangeBetween(Window.unboundedPreceding, -spec.length_micros - 1))
    counted = with_guests(events, spec).withColumn("window_count", (place - gone).cast("long")).where("not guest").drop("guest")
    return counted.withColumn("eligible", F.col("window_count") >= spec.min_events)


def _edges(batch: pa.RecordBatch, keys: tuple[str, ...]) -> list[int]:
    """Where the key of a row differs from that of the row before, 0 and the end included."""
    first = np.zeros(batch.num_rows, bool)
    first[:1] = True
    for c in keys:
        a = batch.column(c).to_numpy(zero_copy_only=False)
        first[1:] |= a[1:] != a[:-1]
    return [*np.flatnonzero(first).tolist(), batch.num_rows]


def _key(batch: pa.RecordBatch, keys: tuple[str, ...], i: int) -> tuple:
    return tuple(batch.column(c)[i].as_py() for c in keys)


def gate_steps(times: np.ndarray, start: int, cadence: int) -> tuple[np.ndarray, np.ndarray]:
    """What a bucket does to the gate, as a step function.

    times: the bucket's sorted candidates. If the gate may open from time x on, and x is at most entries[k] but above
    entries[k - 1], then exits[k] is the last opening in the bucket; above all entries the bucket has none. x is below start
    + cadence, so only the candidates up to the first one from there on can be the first opening.
    """
    return many_gate_steps(times, np.array([0, len(times)]), np.array([start]), cadence)[1:]


def many_gate_steps(times: np.ndarray, at: np.ndarray, starts: np.ndarray, cadence: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gate_steps of many buckets: where each one's steps begin (and the end of all), entries and exits.

    times[at[k]:at[k + 1]] are those of bucket k. All walks go on together; a step is a cadence or more, so there are few.
    """
    n, of = len(starts), np.repeat(np.arange(len(starts)), np.diff(at))
    if not len(times):
        return np.zeros(n + 1, np.int64), times, times
    inside = times - starts[of]
    low = min(0, int(inside.min()))
    # (bucket, time) is one increasing number, and a cadence after a bucket's last candidate comes before the next bucket.
    stride = max(0, int(inside.max())) - low + cadence + 1
    line = of * stride + inside - low
    begins = np.flatnonzero(np.arange(len(times)) <= np.searchsorted(line, np.arange(n) * stride + cadence - low)[of])
    following, place, open_ = np.searchsorted(line, line + cadence), begins.copy(), np.arange(len(begins))
    while len(open_):
        to = following[place[open_]]
        goes_on = to < at[1:][of[begins[open_]]]
        open_ = open_[goes_on]
        place[open_] = to[goes_on]
    exits, own = times[place], of[begins]
    last = np.append((exits[1:] != exits[:-1]) | (own[1:] != own[:-1]), True)
    return np.append(0, np.cumsum(np.bincount(own[last], minlength=n))), times[begins][last], exits[last]


def _bucket_steps(candidates: DataFrame, cadence: int, length: int) -> DataFrame:
    """(visitor, bucket, entries, exits): gate_steps of every bucket. Collected are the times of one visitor's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times, buckets = batch.column("times"), batch.column("bucket").to_numpy()
            at = np.append(0, np.cumsum(times.value_lengths().to_numpy()))
            offsets, *steps = many_gate_steps(times.flatten().to_numpy(), at, buckets * length, cadence)
            columns = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(s, pa.int64())) for s in steps]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in BUCKET), *columns], names=[*BUCKET, "entries", "exits"])

    grouped = candidates.groupBy(*BUCKET).agg(F.sort_array(F.collect_list("t")).alias("times"))
    return grouped.mapInArrow(run, f"{_ddl(candidates, BUCKET)}, entries array<long>, exits array<long>")


def _ddl(df: DataFrame, columns: tuple[str, ...]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def _entry_states(steps: DataFrame, cadence: int) -> DataFrame:
    """(visitor, bucket, t): the last opening before each bucket, null before the first one. A row a bucket, in order.

    The number of partitions is given, else they are joined into one task where these rows are few beside the candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor, last = None, None
        for batch in batches:
            edges = set(_edges(batch, VISITOR))
            if batch.num_rows:
                if _key(batch, VISITOR, 0) == visitor:
                    edges.discard(0)
                visitor = _key(batch, VISITOR, batch.num_rows - 1)
            before: list[int | None] = []
            for i, (entries, exits) in enumerate(zip(batch.column("entries").to_pylist(), batch.column("exits").to_pylist())):
                if i in edges:
                    last = None
                before.append(last)
                k = 0 if last is None else bisect_left(entries, last + cadence)
                if k < len(exits):
                    last = exits[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in BUCKET), pa.array(before, pa.int64())], names=[*BUCKET, "t"])

    parts = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return steps.repartition(parts, *VISITOR).sortWithinPartitions(*IN_ORDER).mapInArrow(run, f"{_ddl(steps, BUCKET)}, t long")


#: Before every opening.
NEVER = -(1 << 62)


def openings(t: np.ndarray, first: np.ndarray, end: np.ndarray, last: np.ndarray, cadence: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that open the gate, in order, and the last opening of each bucket after them.

    Bucket k's sorted candidates are t[first[k]:end[k]], and its last opening before them is last[k]; buckets lie in order,
    and rows between them are of no account. The walks of all buckets go on together.
    """
    last, busy = last.copy(), np.flatnonzero(first < end)
    if not len(busy):
        return busy, last
    size = (end - first)[busy]
    of = np.repeat(np.arange(len(busy)), size)
    begins = np.cumsum(size) - size
    rows = np.arange(len(of)) - begins[of] + first[busy][of]
    origin = t[first[busy]]
    inside = t[rows] - origin[of]
    stride = int(inside.max()) + cadence + 1
    line = of * stride + inside
    following = np.searchsorted(line, line + cadence)
    place = np.searchsorted(line, np.arange(len(busy)) * stride + np.clip(last[busy] + cadence - origin, 0, stride - 1))
    open_, kept = np.flatnonzero(place < begins + size), []
    while len(open_):
        at = place[open_]
        kept.append(at)
        last[busy[open_]] = t[rows[at]]
        place[open_] = following[at]
        open_ = open_[place[open_] < (begins + size)[open_]]
    return rows[np.sort(np.concatenate(kept))] if kept else busy[:0], last


def cadence_gate(candidates: DataFrame, cadence_micros: int, length: int | None = None) -> DataFrame:
    """The candidates that open the gate: a visitor's first, then each that is cadence or more after the last one opened.

    The gate is sequential, yet a bucket's part in it is a step function from the last opening before the bucket to the last
    one inside (gate_steps). The functions, a few numbers a bucket, are applied one after another for each visitor; then
    every bucket knows its own beginning and is walked by itself. candidates may have their bucket, of the given length.
    """
    if length is None:
        length = 16 * cadence_micros
        candidates = candidates.withColumn("bucket", in_bucket(F.col("t"), length))
    states = _entry_states(_bucket_steps(candidates, cadence_micros, length), cadence_micros)
    # A bucket's state is a row ahead of its candidates, so they need no join.
    rows = candidates.withColumn("_state", F.lit(1)).unionByName(states.withColumn("_state", F.lit(0)), allowMissingColumns=True)
    dealt = rows.repartition(*BUCKET).sortWithinPartitions(*IN_ORDER, "_state", "t", "arrival")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = NEVER
        for batch in batches:
            if not batch.num_rows:
                continue
            t, begins = batch.column("t").fill_null(NEVER).to_numpy(), batch.column("_state").to_numpy() == 0
            edges = np.array(_edges(batch, BUCKET))
            # A bucket begins with its state; one without it goes on from the batch before.
            stated = begins[edges[:-1]]
            kept, last = openings(t, edges[:-1] + stated, edges[1:], np.where(stated, t[edges[:-1]], carried), cadence_micros)
            carried = last[-1]
            yield batch.take(pa.array(kept, pa.int64()))

    return dealt.mapInArrow(run, dealt.schema).drop("_state", "bucket")


def fit_samples(events: DataFrame, spec: WindowSpec, since: Column | None = None) -> DataFrame:
    """The windows that a fit samples: eligible ones, from since on, that open the gate. Others leave the gate as it is."""
    counted = with_window_counts(events, spec).where("eligible")
    return cadence_gate(counted.where(since) if since is not None else counted, spec.cadence_micros, bucket_micros(spec))


def serve_samples(events: DataFrame, spec: WindowSpec, since: Column | None = None) -> DataFrame:
    """The windows that the detector evaluates: all events that aren't late pass the gate, eligible or not."""
    counted = with_window_counts(mark_late(events, bucket=bucket_micros(spec)).where("not late"), spec)
    return cadence_gate(counted.where(since) if since is not None else counted, spec.cadence_micros, bucket_micros(spec))
