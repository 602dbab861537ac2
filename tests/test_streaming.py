"""The stream gives what the batch operators give; sinks are idempotent."""

from __future__ import annotations

import json
import random
import time
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.tasks import bytes_read

from tidegauge.operators import scoring
from tidegauge.operators.features import window_features
from tidegauge.operators.materialize import cut
from tidegauge.operators.windows import serve_samples
from tidegauge.plans import flows
from tidegauge.schemas import EVENT_ENVELOPE, STREAM_RECORD, WindowSpec
from tidegauge.sources.streams import SINK_RECORDS, broker_options, dead_letters, enveloped_decisions, enveloped_events, events_of, file_stream, uuid_v7, valid_signals
from tidegauge.sources.tables import http_events, published, snapshot
from tidegauge.streaming import sinks
from tidegauge.streaming.detector import ActiveModels, VisitorWindows, decide_batches, evaluated_windows, features_of
from tidegauge.streaming.sinks import Projection, Reference, alive, append_once, key_span, latest_view, live_feed, publish_snapshots, recent_view, table_or_none

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def records(spark, events):
    made = enveloped_events(events.select("event_id", "source_id", "visitor_id", "event_time", "http_method", "uri", "status_code", "referrer_present", "user_agent", "bytes", "arrival"))
    place = F.get_json_object(F.col("value").cast("string"), "$.event_id").cast("long")
    return made.select("key", "value", F.lit("raw_events").alias("topic"), F.lit(0).alias("partition"), place.alias("offset"), F.timestamp_seconds(place).alias("timestamp"))


def test_stream_equals_batch(rocksdb, tmp_path):
    spark = rocksdb
    events = http_events(spark, SF)
    rows = records(spark, events)
    folder = str(tmp_path / "in")
    for low in (0, 150, 400, 1000):
        high = {0: 150, 150: 400, 400: 1000, 1000: 10**9}[low]
        part = rows.where((F.col("offset") >= low) & (F.col("offset") < high)).repartition(1)
        part.write.mode("append").parquet(folder)
    models = flows.runs(spark, SF)
    loaded = scoring.loaded_models(models, flows.WINDOWS)
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    write = decide_batches(lambda: loaded, lambda df, _: append_once(df, target, Projection("event_id")))

    def run():
        windows = evaluated_windows(events_of(file_stream(spark, folder, 2)), flows.WINDOWS)
        q = windows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None

    run()
    samples = serve_samples(events, flows.WINDOWS)
    features = window_features(samples, events, flows.WINDOWS).join(samples.select("event_id", "event_time", "eligible"), "event_id")
    columns = ["event_id", "status", "risk_level", "action", F.round("score_normalized", 6).alias("s")]
    want = sorted(map(str, scoring.decide(features, loaded, F.col("event_time")).select(*columns).collect()))
    assert sorted(map(str, spark.read.parquet(target).select(*columns).collect())) == want
    rows.where("offset < 150").repartition(1).write.mode("append").parquet(folder)  # redelivered after a restart
    run()
    assert spark.read.parquet(target).count() == len(want)


def test_append_once_and_dead_letters(spark, tmp_path):
    path, dead = str(tmp_path / "t"), str(tmp_path / "dead")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "")], "id long, name string")
    p = Projection("id", F.filter(F.array(F.when(F.col("name") == "", F.lit("no name"))), lambda x: x.isNotNull()))
    w = append_once(rows, path, p, dead)
    assert (w.inserted, w.skipped, w.rejected) == (1, 1, 1)
    assert (append_once(rows, path, p).inserted, table_or_none(spark, path).count(), spark.read.parquet(dead).count()) == (0, 1, 1)
    assert table_or_none(spark, str(tmp_path / "none")) is None


def test_decode(spark):
    good = {"event_id": "1", "ingested_at": 1, "schema_version": "v1", "source_id": "s", "visitor_id": "v", "payload": {"event_time": "2024-01-01T00:00:00Z", "uri": "/", "http_method": "GET", "status_code": 200, "referrer_present": True}}
    values = [json.dumps(good), "{broken", json.dumps({"source_id": "s"}), ""]
    rows = spark.createDataFrame([(None, bytearray(v.encode()), "t", 0, i, None) for i, v in enumerate(values)], STREAM_RECORD)
    assert [r["event_id"] for r in events_of(rows).collect()] == ["1"]
    assert sorted(r["original_offset"] for r in dead_letters(rows, EVENT_ENVELOPE).collect()) == [1, 2, 3]
    signals = spark.createDataFrame([(None, bytearray(json.dumps(s).encode()), "t", 0, 0, None) for s in ({"source_id": "a", "baseline_run_id": 3}, {"source_id": "", "baseline_run_id": 3}, {"source_id": "b", "baseline_run_id": 0})], STREAM_RECORD)
    assert [r["source_id"] for r in valid_signals(signals).collect()] == ["a"]


def test_views(spark):
    rows = spark.createDataFrame([("s", "v", 1, 0, "d1"), ("s", "v", 2, 0, "d2"), ("t", "w", 1, 1, "d3")], "source_id string, visitor_id string, offset long, partition int, decision_id string").withColumn("timestamp", F.timestamp_seconds("offset"))
    now = F.timestamp_seconds(F.lit(1000))
    view = latest_view(None, rows, now)
    assert sorted(r["decision_id"] for r in view.collect()) == ["d2", "d3"]
    later = F.timestamp_seconds(F.lit(1000 + 1801))
    assert alive(view, later).count() == 0
    assert [r["decision_id"] for r in recent_view(rows.limit(0), rows, 1).collect()] == ["d2"]
    assert live_feed(rows, "t").count() == 1 and live_feed(rows).count() == 3


def test_publish_and_envelopes(spark, tmp_path):
    folder = str(tmp_path / "snap")
    assert published(spark, folder) is None
    for n in (3, 5, 7, 9):
        publish_snapshots({"events": spark.range(n)}, folder)
        assert snapshot(spark, folder, "events").count() == n
    assert sorted(p.name for p in (tmp_path / "snap" / "versions").iterdir() if not p.name.startswith(".")) == ["3", "4"]
    d = spark.sql("select 'd' decision_id, 'e' event_id, 's' source_id, 'v' visitor_id, timestamp'2024-01-01' decided_at, 1D score_raw, 0.5D score_normalized, 'low' risk_level, 'allow' action, 'scored' status, 'v1' policy_version, 1L baseline_run_id")
    r = enveloped_decisions(d).first()
    assert bytes(r["key"]) == b"s:v" and json.loads(r["value"])["payload"]["action"] == "allow"


@pytest.mark.parametrize("step", ["write", "second table", "marker", "rename", "clean"])
def test_a_crash_while_publishing_leaves_a_readable_set(spark, tmp_path, monkeypatch, step):
    folder = str(tmp_path / "snap")
    for n in (1, 2, 3):
        publish_snapshots({"a": spark.range(n), "b": spark.range(n)}, folder)
    broken = spark.range(9).select(F.raise_error(F.lit("crash")).alias("id"))
    tables = {"a": broken if step == "write" else spark.range(9), "b": broken if step == "second table" else spark.range(9)}
    real = sinks._files

    class Broken:
        def __init__(self, files):
            self.files = files

        def __getattr__(self, name):
            if name == {"marker": "create", "rename": "rename", "clean": "delete"}.get(step):
                raise OSError("crash")
            return getattr(self.files, name)

    monkeypatch.setattr(sinks, "_files", lambda s, p: (real(s, p)[0], Broken(real(s, p)[1])))
    with pytest.raises(Exception, match="crash"):
        publish_snapshots(tables, folder)
    monkeypatch.undo()
    seen = [snapshot(spark, folder, t).count() for t in ("a", "b")]
    assert seen == ([9, 9] if step == "clean" else [3, 3])
    publish_snapshots({"a": spark.range(4), "b": spark.range(4)}, folder)
    assert [snapshot(spark, folder, t).count() for t in ("a", "b")] == [4, 4]


def v7(millis, n):
    return f"{millis:012x}"[:8] + "-" + f"{millis:012x}"[8:] + f"-7{n % 4096:03x}-8{n // 4096 % 4096:03x}-{n:012x}"


def test_ids_sort_by_time(spark):
    rows = spark.range(300).select(F.col("id"), uuid_v7(F.lit(1_700_000_000_000) + F.col("id")).alias("u"), key_span(uuid_v7(F.lit(3_600_000 * 7) + F.col("id"))).alias("span")).orderBy("u").collect()
    assert [r["id"] for r in rows] == list(range(300)) and {r["span"] for r in rows} == {7}
    assert all(uuid.UUID(r["u"]).version == 7 and uuid.UUID(r["u"]).variant == uuid.RFC_4122 for r in rows)
    assert broker_options("h:1", "t", SINK_RECORDS)["maxOffsetsPerTrigger"] == "200" and "maxOffsetsPerTrigger" not in broker_options("h:1", "t")


def test_bytes_read_do_not_grow_with_the_table(spark, tmp_path):
    """A hundred batches, each of another hour with some redelivered rows of the hour before."""
    path, hour = str(tmp_path / "t"), 3_600_000
    p = Projection("id", F.filter(F.array(F.when(F.col("v") < 0, F.lit("negative"))), lambda x: x.isNotNull()))
    read = []
    for b in range(100):
        rows = [(v7(b * hour + i, b * 50 + i), i) for i in range(50)] + ([(v7((b - 1) * hour + i, (b - 1) * 50 + i), i) for i in range(5)] if b else [])
        done = []
        n = bytes_read(spark, lambda: done.append(append_once(spark.createDataFrame(rows, "id string, v int"), path, p)))
        assert (done[0].inserted, done[0].skipped, done[0].rejected) == (50, 5 if b else 0, 0)
        read.append(n)
    assert spark.read.parquet(path).count() == 5000
    assert max(read[50:]) <= 1.2 * max(read[1:10])


def test_failures_of_a_sink(spark, tmp_path):
    """Null keys, broken constraints, orphans, a schema that doesn't fit; and a replay of each."""
    parents, path, dead = (str(tmp_path / x) for x in ("parents", "t", "dead"))
    append_once(spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"), parents, Projection("id"))
    p = Projection("id", F.filter(F.array(F.when(F.col("n") < 0, F.lit("n is negative"))), lambda x: x.isNotNull()), (Reference("parent", parents),))
    rows = spark.createDataFrame([("x", 1, 1), ("y", 9, 1), (None, 1, 1), ("z", 2, -1), ("w", None, 0), ("v", 9, -5), ("x", 1, 1)], "id string, parent long, n int")
    for replay in (False, True):
        w = append_once(rows, path, p, dead)
        assert (w.inserted, w.skipped, w.rejected) == ((0, 3, 4) if replay else (2, 1, 4))
        assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == ["w", "x"]
        letters = {r["id"]: r["reason"] for r in spark.read.parquet(dead).collect()}
        assert spark.read.parquet(dead).count() == 4
        assert letters == {"y": "parent names no stored row", None: "id is null", "z": "n is negative", "v": "n is negative; parent names no stored row"}
    w = append_once(rows.where("parent = 9"), path, p, dead)  # another batch adds its own letters
    assert w.rejected == 2 and spark.read.parquet(dead).count() == 6
    unfit = spark.createDataFrame([("q", 1, 1)], "id string, parent long, n int").withColumn("m", F.make_interval(F.lit(1)))
    wrong = append_once(unfit, path, p, dead)
    assert wrong.rejected == 1 and spark.read.parquet(path).count() == 2


def test_writes_are_tried_three_times():
    calls = []

    def write(errors):
        def run():
            calls.append(time.monotonic())
            if len(calls) <= len(errors):
                raise errors[len(calls) - 1]
            return "written"

        return run

    for errors, outcome, n in (([], "written", 1), ([OSError(), OSError()], "written", 3), ([OSError()] * 3, OSError, 3), ([sinks.PermanentError()], sinks.PermanentError, 1), ([OSError(), sinks.PermanentError()], sinks.PermanentError, 2)):
        calls.clear()
        if isinstance(outcome, str):
            assert sinks.retried(write(errors)) == outcome
        else:
            with pytest.raises(outcome):
                sinks.retried(write(errors))
        assert len(calls) == n
    assert calls[1] - calls[0] >= 0.05


class Stored:
    """State of one visitor in memory; counts the events that it is asked for and given."""

    def __init__(self):
        self.map, self.clock, self.read, self.written = {}, None, 0, 0

    def containsKey(self, key):
        return key in self.map

    def getValue(self, key):
        self.read += len(self.map[key][0])
        return self.map[key]

    def updateValue(self, key, value):
        self.written += len(value[0])
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]

    def keys(self):
        return iter(list(self.map))

    def exists(self):
        return self.clock is not None

    def get(self):
        return self.clock

    def update(self, value):
        self.clock = value


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_state_of_a_busy_visitor_is_linear(size):
    """Windows as by force, and state reads and writes in proportion to the events, however they are cut into batches."""
    spec = WindowSpec(length_seconds=300, cadence_seconds=60, min_events=3)
    rng = random.Random(size)
    t, rows = 0, []
    for i in range(1500):
        t += rng.choice([0, 1, 1, 2, 3]) * 1_000_000
        at = t - rng.choice([0] * 9 + [4_000_000])
        rows.append((f"e{i}", at, rng.choice(["/a", "/b"]), rng.choice(["html", "api"])))
        if rng.random() < 0.05:
            rows.append(rows[-1])
    processor, state = VisitorWindows(spec), Stored()
    processor.spans = processor.clocks = state
    got = []
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        frame = pd.DataFrame({"partition": 0, "offset": range(i, i + len(part)), "event_id": [r[0] for r in part], "event_time": [r[1] for r in part], "t": [r[1] for r in part], "http_method": "GET", "endpoint": [r[2] for r in part], "status_code": 200, "referrer_present": True, "resource_type": [r[3] for r in part]})
        for out in processor.handleInputRows(("s", "v"), iter([frame]), None):
            got += out.itertuples(index=False, name=None)
    want, window, newest, evaluated, seen = [], [], None, None, set()
    for event_id, at, endpoint, kind in rows:
        if newest is not None and at < newest or event_id in seen:
            continue
        newest = at
        seen.add(event_id)
        window = [w for w in window if w[1] >= at - spec.length_micros] + [(event_id, at, "GET", endpoint, 200, True, kind)]
        if evaluated is None or at - evaluated >= spec.cadence_micros:
            evaluated = at
            want.append(("s", "v", event_id, at, len(window) >= 3, *features_of(window)))
    plain = [tuple(None if x != x else x for x in r) for r in got]
    assert plain == want
    spans = spec.length_seconds // spec.cadence_seconds + 2
    assert len(state.map) <= spans
    per_span = max(len(v[0]) for v in state.map.values())
    assert state.written <= len(rows) * (per_span if size == 1 else 12)
    assert state.read <= len(rows) * (per_span + spans if size == 1 else 12 + spans)


def test_a_bad_run_between_two_batches_leaves_the_old_model(spark, tmp_path):
    fitted = cut(flows.runs(spark, SF))
    events = http_events(spark, SF)
    samples = serve_samples(events, flows.WINDOWS)
    batch = cut(window_features(samples, events, flows.WINDOWS).join(samples.select("event_id", "event_time", "eligible"), "event_id"))
    bad = fitted.where("status = 'succeeded'").withColumns({"id": F.col("id") + 100, "baseline": F.col("baseline").withField("registry_hash", F.lit("other"))})
    good = fitted.where("status = 'succeeded'").withColumn("id", F.col("id") + 200)
    tables = [fitted]
    folder, out = str(tmp_path / "models"), []
    models = ActiveModels(lambda: tables[0], flows.WINDOWS, folder)
    run = decide_batches(models.refresh, lambda df, i: out.append({r["event_id"]: (r["status"], r["baseline_run_id"], round(r["score_normalized"] or 0, 9)) for r in df.collect()}))
    run(batch, 0)
    first = published(spark, folder)
    run(batch, 1)
    assert published(spark, folder) == first  # nothing new, nothing published
    tables[0] = fitted.unionByName(bad)
    run(batch, 2)
    restarted = ActiveModels(lambda: tables[0], flows.WINDOWS, folder)
    decide_batches(restarted.refresh, lambda df, i: out.append({r["event_id"]: (r["status"], r["baseline_run_id"], round(r["score_normalized"] or 0, 9)) for r in df.collect()}))(batch, 3)
    assert out[0] == out[1] == out[2] == out[3] and any(s == "scored" for s, _, _ in out[0].values())
    tables[0] = fitted.unionByName(bad).unionByName(good)
    run(batch, 4)
    ids = {k: v[1] for k, v in out[0].items() if v[1]}
    assert {k: v[1] for k, v in out[4].items() if v[1]} == {k: i + 200 for k, i in ids.items()}
