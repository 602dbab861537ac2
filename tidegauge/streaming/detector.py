"""The detector as a stream: per-visitor window state, then stateless scoring of each micro-batch."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tidegauge.functions.features import NAMES
from tidegauge.functions.uri import endpoint_path
from tidegauge.operators.features import entropy as method_entropy
from tidegauge.operators.scoring import decide, loaded_models, refreshed_models
from tidegauge.schemas import POLICY_V1, WindowSpec, struct
from tidegauge.sources.tables import latest_succeeded, published, read_published
from tidegauge.streaming.sinks import publish_snapshots

#: What the state keeps of an event.
RING = ("event_id", "t", "http_method", "endpoint", "status_code", "referrer_present", "resource_type")
SPAN = T.StructType([T.StructField("span", T.LongType())])
SPAN_EVENTS = T.StructType([T.StructField(name, T.ArrayType(kind)) for name, kind in zip(RING, (T.StringType(), T.LongType(), T.StringType(), T.StringType(), T.IntegerType(), T.BooleanType(), T.StringType()))])
CLOCKS = struct("newest bigint, evaluated bigint")
EVALUATED = T.StructType([
    *struct("source_id string, visitor_id string, event_id string, event_time timestamp, eligible boolean").fields,
    *(T.StructField(n, T.DoubleType()) for n in NAMES),
])


def features_of(window: list[tuple]) -> list[float | None]:
    """The nine features of a window's rows (RING columns), in order of time; None where undefined.

    The same arithmetic as operators.features has, so a window gives the same bits in a stream and in a batch: a value at the
    edge of a histogram's bin must not fall on two sides of it.
    """
    n = len(window)
    pages = [w[1] for w in window if w[6] == "html"]
    gaps = [b - a for a, b in zip(pages, pages[1:])]
    total, squares = sum(gaps), sum(g * g for g in gaps)
    return [
        float(n),
        (window[-1][1] - window[0][1]) / 1e6,
        total / len(gaps) / 1000 if gaps else None,
        max(0, len(gaps) * squares - total * total) ** 0.5 / total if len(gaps) > 1 and total else None,
        float(len({w[3] for w in window})),
        len(pages) / n,
        sum(400 <= w[4] <= 499 for w in window) / n,
        float(method_entropy(np.array([list(Counter(w[2] for w in window).values())]), np.array([n]))[0]),
        sum(bool(w[5]) for w in window) / n,
    ]


class VisitorWindows(StatefulProcessor):
    """A visitor's trailing window: its events by spans of a cadence, the newest event time, and the time of the last evaluation.

    A micro-batch's events are taken in (partition, offset) order. One older than the newest is dropped, so a redelivery can
    only be one at the newest time itself, whose span has its id; any other event joins the window and, if the cadence has
    passed since the last evaluation, is evaluated, whether or not the window has enough events. A batch reads one span, and
    the whole window only if it evaluates; it writes the spans of its own events and drops those that left the window. So work
    grows with the events, not with events times window. State and output are committed together. With idle_ms, a span and
    the times expire so long after their last write, which is a window and a cadence at least; so live traffic in order gives
    the same results, for the cadence is not longer than the window.
    """

    def __init__(self, spec: WindowSpec, idle_ms: int | None = None):
        if idle_ms is not None and idle_ms * 1000 < spec.length_micros + spec.cadence_micros:
            raise ValueError("state must outlive a window and a cadence")
        self.spec, self.idle_ms = spec, idle_ms

    def init(self, handle) -> None:
        self.spans = handle.getMapState("spans", SPAN, SPAN_EVENTS, ttlDurationMs=self.idle_ms)
        self.clocks = handle.getValueState("clocks", CLOCKS, ttlDurationMs=self.idle_ms)

    def _span(self, t: int) -> int:
        return t // self.spec.cadence_micros

    def _stored(self, span: int) -> list[tuple]:
        return list(zip(*self.spans.getValue((span,)))) if self.spans.containsKey((span,)) else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows), ignore_index=True).sort_values(["partition", "offset"], kind="stable")
        newest, evaluated = tuple(self.clocks.get()) if self.clocks.exists() else (None, None)
        before = newest
        last = [] if newest is None else self._stored(self._span(newest))
        ids = {w[0] for w in last if w[1] == newest}
        fresh: list[tuple] = []
        due: list[tuple[int, object]] = []
        for r in arrived.itertuples(index=False):
            t = int(r.t)
            if newest is not None and (t < newest or (t == newest and r.event_id in ids)):
                continue
            if t != newest:
                newest, ids = t, set()
            ids.add(r.event_id)
            fresh.append((r.event_id, t, r.http_method, r.endpoint, int(r.status_code), bool(r.referrer_present), r.resource_type))
            if evaluated is None or t - evaluated >= self.spec.cadence_micros:
                evaluated = t
                due.append((len(fresh), r.event_time))
        out = []
        if due:
            first = fresh[due[0][0] - 1][1] - self.spec.length_micros
            held = [w for s in range(self._span(first), self._span(before)) for w in self._stored(s)] + last if before is not None else []
            window = held + fresh
            times = [w[1] for w in window]
            for n, event_time in due:
                end = len(held) + n
                own = window[bisect_left(times, times[end - 1] - self.spec.length_micros, 0, end) : end]
                out.append((*key, own[-1][0], event_time, len(own) >= self.spec.min_events, *features_of(own)))
        if fresh:
            self._keep(last, fresh, before, newest, evaluated)
        yield pd.DataFrame(out, columns=EVALUATED.names)

    def _keep(self, last: list[tuple], fresh: list[tuple], before: int | None, newest: int, evaluated: int) -> None:
        for span, events in groupby(fresh, key=lambda w: self._span(w[1])):
            own = (last if before is not None and span == self._span(before) else []) + list(events)
            self.spans.updateValue((span,), tuple(map(list, zip(*own))))
        if before is not None and self._span(before) != self._span(newest):
            oldest = self._span(newest - self.spec.length_micros)
            for (span,) in [tuple(k) for k in self.spans.keys()]:
                if span < oldest:
                    self.spans.removeKey((span,))
        self.clocks.update((newest, evaluated))

    def close(self) -> None:
        pass


def evaluated_windows(events: DataFrame, spec: WindowSpec, idle_ms: int | None = None) -> DataFrame:
    """The windows that the detector evaluates, from a stream of decoded events with their place in the topic.

    The session must keep state in RocksDB. idle_ms sets the expiry of idle visitors in processing time; it goes with a
    processing-time trigger, for such a query has timer batches without end and so no last one.
    """
    rows = events.select(
        "source_id", "visitor_id", "partition", "offset", "event_id", "event_time", F.unix_micros("event_time").alias("t"),
        "http_method", endpoint_path(F.col("uri")).alias("endpoint"), "status_code", "referrer_present", "resource_type",
    )
    return rows.groupBy("source_id", "visitor_id").transformWithStateInPandas(VisitorWindows(spec, idle_ms), EVALUATED, "append", "none" if idle_ms is None else "processingTime")


class ActiveModels:
    """The models that score a micro-batch, kept as published versions of one table.

    refresh() is called at the start of each batch. It looks at the ids of the latest succeeded runs; if a source has one that
    wasn't judged before, compatible ones take their source's place and a source whose latest run isn't compatible keeps the
    model it has. The new set is published and judged ids with it, so a restart goes on with the last valid models.
    """

    def __init__(self, read_runs: Callable[[], DataFrame], spec: WindowSpec, folder: str):
        self.read_runs, self.spec, self.folder = read_runs, spec, folder

    def refresh(self) -> DataFrame:
        runs = self.read_runs()
        spark = runs.sparkSession
        latest = latest_succeeded(runs.select("source_id", "status", "id")).select("source_id", F.col("id").alias("judged_id"))
        if published(spark, self.folder) is None:
            publish_snapshots({"models": loaded_models(runs, self.spec), "judged": latest}, self.folder)
        else:
            unseen = latest.join(read_published(spark, self.folder, "judged"), ["source_id", "judged_id"], "left_anti")
            if not unseen.isEmpty():
                current = read_published(spark, self.folder, "models")
                publish_snapshots({"models": refreshed_models(current, runs, self.spec), "judged": latest}, self.folder)
        return read_published(spark, self.folder, "models")


def decide_batches(read_models: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], policy: dict = POLICY_V1) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each micro-batch of evaluated windows is scored under the models of that moment and written.

    A baseline signal needs no handling of its own: read_models, such as ActiveModels.refresh, is called for every micro-batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        write(decide(batch, read_models(), F.col("event_time"), policy), batch_id)

    return run
