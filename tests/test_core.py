"""Edge rows of the HTTP behaviour operators, against plain Python."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.tasks import many_partitions, most_rows_read
from tidegauge.functions.features import NAMES, REGISTRY, registry_hash, transformed
from tidegauge.functions.uri import endpoint_path, extension, media_class, resource_type
from tidegauge.operators import baseline, features, reads, scoring, validation
from tidegauge.operators.features import window_features
from tidegauge.operators.ranking import quantile_grid, value_ranks
from tidegauge.operators.windows import cadence_gate, fit_samples, gate_steps, mark_late, serve_samples, with_window_counts
from tidegauge.schemas import POLICY_V1, FitSpec, WindowSpec
from tidegauge.sources.tables import access_log, active_policy, classified, inspect_snapshots, latest_succeeded, publish_view, rehydrated, snapshot_events
from tidegauge.streaming.detector import features_of

SPEC = WindowSpec(length_seconds=300, cadence_seconds=60, min_events=3)
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def events_of(spark, rows):
    """rows: (visitor, seconds, uri, method, status, referrer) in order of arrival."""
    data = [(str(i), i, "s", v, START + timedelta(seconds=s), m, u, st, r, None, None) for i, (v, s, u, m, st, r) in enumerate(rows)]
    return classified(spark.createDataFrame(data, "event_id string, arrival long, source_id string, visitor_id string, event_time timestamp, http_method string, uri string, status_code int, referrer_present boolean, user_agent string, bytes long"))


def random_rows(n=400, seed=3):
    rng = random.Random(seed)
    at, rows = {}, []
    for _ in range(n):
        v = rng.choice("abc")
        at[v] = at.get(v, 0) + rng.choice([0, 0.5, 7, 30, 59, 60, 61, 150, 300, 301])
        rows.append((v, at[v] - rng.choice([0, 0, 0, 0, 40]), rng.choice(["/p/1", "/p/2?x", "/a.js", "/api/x", "/i.png"]), rng.choice(["GET", "POST", "put"]), rng.choice([200, 404, 500]), rng.random() < 0.5))
    return rows


def test_uris(spark):
    cases = {
        "/p/1?ref=a": "/p/1", "/p/1#x": "/p/1#x", "/a%20b": "/a b", "/a+b%2B": "/a+b+", "/a%zz?x": "/a%zz", "http://h/p?q": "/p", "http://h": "http://h",
        "rel/x?y": "rel/x", "": "", "  /t  ": "/t", "a#b?c": "a",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", endpoint_path(F.col("u")).alias("p"))
    assert {r["u"]: r["p"] for r in df.collect()} == cases
    kinds = {
        "/API/x.png": "api", "/apix": "html", "/x.TAR": "archive", "/dir.v1/file": "html", "/a.": "other", "": "other", "/x.xhtml": "document", "/graphql": "api",
        "/f.woff2?v=1": "font", "/x.unknown": "other", "/d.json": "api", "/x.flac": "media",
    }
    df = spark.createDataFrame([(u,) for u in kinds], "u string").select("u", resource_type(F.col("u")).alias("k"))
    assert {r["u"]: r["k"] for r in df.collect()} == kinds
    assert spark.range(1).select(extension(F.lit("/a.b/c.TXT"))).first()[0] == ".txt"
    assert media_class("application/octet-stream") is None and media_class("application/gzip") == "archive"


def test_validation_and_decode(spark):
    row = spark.sql("select '' source_id, 'v' visitor_id, cast(null as timestamp) event_time, 'GET' http_method, '/' uri, 99 status_code, -1L bytes")
    assert row.select(validation.event_errors()).first()[0] == ["source_id required", "event_time required", "status_code out of range: 99", "bytes must be non-negative"]
    bodies = ['{"source_id":"s","uri":"/"}', "{broken", '{"source_id":"s","extra":1}', '{"uri":"' + "x" * 33_000 + '"}']
    out = validation.strict_decode(spark.createDataFrame([(b,) for b in bodies], "body string")).select("decode_error", "event.source_id").collect()
    assert [r["decode_error"] for r in out] == [None, "malformed JSON", "unknown field: extra", "body too large"] and out[0]["source_id"] == "s"


def replay(rows, spec):
    """Brute-force windows: (arrival, members) of fit and serve samples."""
    by, fit, serve = {}, [], []
    for i, r in enumerate(rows):
        by.setdefault(r[0], []).append((r[1], i))
    for events in by.values():
        last, newest, kept, last_serve = None, None, [], None
        for s, i in sorted(events):
            inside = [j for t, j in sorted(events) if s - spec.length_seconds <= t and (t, j) <= (s, i)]
            if len(inside) >= spec.min_events and (last is None or s - last >= spec.cadence_seconds):
                last = s
                fit.append((i, inside))
        for s, i in events:
            if newest is not None and s < newest:
                continue
            newest = s
            kept.append((s, i))
            if last_serve is None or s - last_serve >= spec.cadence_seconds:
                last_serve = s
                serve.append((i, [j for t, j in kept if t >= s - spec.length_seconds]))
    return dict(fit), dict(serve)


def test_windows_and_features(spark):
    rows = random_rows()
    events = events_of(spark, rows)
    fit, serve = replay(rows, SPEC)
    samples = fit_samples(events, SPEC)
    assert {int(r["event_id"]): r["window_count"] for r in samples.collect()} == {i: len(m) for i, m in fit.items()}
    served = serve_samples(events, SPEC)
    assert {int(r["event_id"]): (r["window_count"], r["eligible"]) for r in served.collect()} == {i: (len(m), len(m) >= 3) for i, m in serve.items()}
    got = {int(r["event_id"]): r for r in window_features(samples, events, SPEC).collect()}
    ring = {int(r["event_id"]): (r["event_id"], r["t"], r["http_method"], r["endpoint"], r["status_code"], r["referrer_present"], r["resource_type"]) for r in events.collect()}
    for i, members in fit.items():
        want = features_of([ring[j] for j in members])
        for name, w in zip(NAMES, want):
            g = got[i][name]
            assert (g is None) == (w is None) and (w is None or math.isclose(g, w, rel_tol=1e-9, abs_tol=1e-9)), (i, name, g, w)


def test_hot_visitor(spark, monkeypatch):
    """One visitor has half of all events: results as by force, and no task reads a tenth of the rows."""
    monkeypatch.setattr(features, "CHUNK_ROWS", 40)
    monkeypatch.setattr(features, "CELLS", 100)
    rng = random.Random(11)
    at, rows = {}, []
    for i in range(6000):
        v = "hot" if i % 2 else f"v{rng.randrange(40)}"
        at[v] = at.get(v, 0) + rng.choice([1, 2, 5, 20] if v == "hot" else [3, 50, 400])
        rows.append((v, at[v] - rng.choice([0, 0, 0, 0, 9]), rng.choice(["/p/1", "/p/2?x", "/a.js", "/api/x", "/i.png"]), rng.choice(["GET", "POST", "put"]), rng.choice([200, 404, 500]), rng.random() < 0.5))
    fit, serve = replay(rows, SPEC)
    with many_partitions(spark):
        events = events_of(spark, rows).repartition(16).cache()
        events.count()
        got = {}
        most = most_rows_read(spark, lambda: got.update(fit=fit_samples(events, SPEC).collect(), serve=serve_samples(events, SPEC).collect(), late=mark_late(events, bucket=600_000_000).where("late").count(), f=window_features(serve_samples(events, SPEC), events, SPEC).collect()))
    assert {int(r["event_id"]): r["window_count"] for r in got["fit"]} == {i: len(m) for i, m in fit.items()}
    assert {int(r["event_id"]): r["window_count"] for r in got["serve"]} == {i: len(m) for i, m in serve.items()}
    ring = {int(r["event_id"]): (r["event_id"], r["t"], r["http_method"], r["endpoint"], r["status_code"], r["referrer_present"], r["resource_type"]) for r in events.collect()}
    order = sorted(ring, key=lambda i: (ring[i][1], i))
    by_visitor = {}
    for i in order:
        by_visitor.setdefault(rows[i][0], []).append(i)
    for r in got["f"]:
        i = int(r["event_id"])
        members = [j for j in by_visitor[rows[i][0]] if ring[i][1] - SPEC.length_micros <= ring[j][1] and (ring[j][1], j) <= (ring[i][1], i)]
        for name, w in zip(NAMES, features_of([ring[j] for j in members])):
            assert (r[name] is None) == (w is None) and (w is None or math.isclose(r[name], w, rel_tol=1e-9, abs_tol=1e-9)), (i, name, r[name], w)
    assert got["late"] > 0 and len(got["f"]) == len(serve) and most < len(rows) / 10


def test_gate_of_buckets(spark):
    """Any bucket length gives the gate of a walk, and a bucket's steps are those of walks from every time."""
    rng = random.Random(5)
    t, rows = 0, []
    for i in range(900):
        t += rng.choice([0, 1, 3, 10, 59, 60, 61, 400])
        rows.append(("s", "v", t, i))
    df = spark.createDataFrame(rows, "source_id string, visitor_id string, t long, arrival long")
    last, want = None, []
    for _, _, t, i in rows:
        if last is None or t - last >= 60:
            last = t
            want.append(i)
    for length in (None, 60, 61, 1000, 10_000_000):
        candidates = df if length is None else df.withColumn("bucket", F.floor(F.col("t") / length))
        assert sorted(r["arrival"] for r in cadence_gate(candidates, 60, length).collect()) == want
    times = np.array(sorted(rng.randrange(1000) for _ in range(200)))
    entries, exits = gate_steps(times, 0, 60)
    for x in range(60):
        last = None
        for t in times.tolist():
            if t >= (x if last is None else last + 60):
                last = t
        assert exits[np.searchsorted(entries, x)] == last


def test_window_edges(spark):
    rows = [("a", 0, "/", "GET", 200, True), ("a", 300, "/", "GET", 200, True), ("a", 300, "/", "GET", 200, True), ("a", 600.000001, "/", "GET", 200, True)]
    counts = [r["window_count"] for r in with_window_counts(events_of(spark, rows), SPEC).orderBy("arrival").collect()]
    assert counts == [1, 2, 3, 1]
    late = [r["late"] for r in mark_late(events_of(spark, [("a", 5, "/", "GET", 200, True), ("a", 4, "/", "GET", 200, True), ("a", 5, "/", "GET", 200, True)])).orderBy("arrival").collect()]
    assert late == [False, True, False]


def test_registry(spark):
    assert len(REGISTRY) == 9 and len(registry_hash()) == 64
    assert registry_hash(REGISTRY[:8]) != registry_hash()
    with pytest.raises(ValueError):
        transformed(F.lit(1.0), "sqrt")


@pytest.mark.parametrize("running", [16, 0])
def test_method_entropy(monkeypatch, running):
    """By running sums and by the windows' own events, in portions."""
    monkeypatch.setattr(features, "RUNNING_METHODS", running)
    monkeypatch.setattr(features, "CELLS", 3)
    codes = np.array([0, 0, 0, 1, 1, 2, 0, 1])
    got = features._method_entropy(codes, 3, np.array([0, 1, 1, 0]), np.array([2, 5, 6, 8]))
    assert np.allclose(got, [0, 1, -(0.8 * math.log2(0.4) + 0.2 * math.log2(0.2)), -(0.5 * math.log2(0.5) + 0.375 * math.log2(0.375) + 0.125 * math.log2(0.125))])
    assert features._method_entropy(codes[:0], 0, np.zeros(0, int), np.zeros(0, int)).tolist() == []


@pytest.mark.parametrize("values", [[5.0], [1.0, 1.0], [3.0, 1.0, 2.0], [float(i % 7) for i in range(50)], [random.Random(1).random() for _ in range(731)]])
def test_quantiles(spark, values):
    df = spark.createDataFrame([("s", v) for v in values], "source_id string, score double").repartition(3)
    got = {r["i"]: r["q"] for r in quantile_grid(value_ranks(df, "source_id", "score"), "source_id", "score", 1001).collect()}
    x, n, top = sorted(values), len(values), -math.inf
    for i in range(1001):
        f = i / 1000.0 * n
        k = max(math.ceil(f) - 1, 0)
        q = x[0] if k == 0 else (k + 1 - f) * x[k - 1] + (1 - (k + 1 - f)) * x[k]
        top = max(top, q)
        assert math.isclose(got[i], top, rel_tol=1e-12), (i, got[i], top)


def feature_rows(spark, values):
    """Feature rows of one source: the fourth feature varies, the third is undefined, the others are constant."""
    data = [("s", *[float(v) if j == 3 else None if j == 2 else 1.0 for j in range(9)]) for v in values]
    return spark.createDataFrame(data, "source_id string, " + ", ".join(f"{n} double" for n in NAMES))


def test_histograms_and_scores(spark):
    fit = FitSpec(bins=50, alpha=0.1)
    h = {r["name"]: r for r in baseline.histograms(feature_rows(spark, range(101)), fit).collect()}
    first, undefined, constant = h[NAMES[3]], h[NAMES[2]], h[NAMES[5]]
    assert len(first["bin_masses"]) == 50 and math.isclose(sum(first["bin_masses"]), 1) and math.isclose(first["out_of_range_mass"], 0.1 / 106)
    assert (undefined["bin_masses"], undefined["out_of_range_mass"], undefined["bin_width"]) == ([], 1.0, 0.0) and math.isclose(undefined["p_undefined"], 101.1 / 101.2)
    assert constant["bin_masses"] == [1.0] and constant["bin_width"] == 0
    models = baseline.histogram_arrays(baseline.histograms(feature_rows(spark, range(101)), fit))
    assert models.select(F.forall("histograms", baseline.valid_histogram)).first()[0]
    probe = feature_rows(spark, [100, 1, 1000]).join(models, "source_id").select(NAMES[3], baseline.raw_score(F.col("histograms")).alias("s")).collect()
    by = {r[0]: r["s"] for r in probe}
    p = 0.1 / 101.2
    rest = -math.log(101.1 / 101.2) - 7 * math.log(1 - p)
    assert math.isclose(by[100.0], -math.log((1 - p) * first["bin_masses"][49]) + rest)
    assert math.isclose(by[1000.0], -math.log((1 - p) * first["out_of_range_mass"]) + rest)
    n = spark.range(1).select(*(baseline.normalised(F.lit(x), F.array(*map(F.lit, (1.0, 2.0, 2.0, 3.0)))) for x in (0.5, 2.0, 9.0))).first()
    assert list(n) == [0.0, 0.75, 1.0]


def test_policy(spark):
    _, bands, _ = scoring.policy_row()
    levels = spark.range(1).select(*(scoring.band(bands, F.lit(s))["risk_level"].alias(f"x{i}") for i, s in enumerate((0.0, 0.6999, 0.70, 0.90, 0.98, 1.0)))).first()
    assert list(levels) == ["low", "low", "medium", "high", "critical", "critical"]

    def errors(policy):
        v, b, f = scoring.policy_row(policy)
        return [r["error"] for r in validation.policy_errors(spark.range(1).select(v.alias("version"), b.alias("bands"), f.alias("fallback_actions"))).collect()]

    assert errors(POLICY_V1) == []
    change = lambda i, **k: POLICY_V1 | {"bands": [b | (k if j == i else {}) for j, b in enumerate(POLICY_V1["bands"])]}
    assert errors(change(0, max_score=0.95)) == ["max_score not increasing"]
    assert errors(change(3, max_score=1.0)) == ["last band not open"]
    assert errors(change(1, risk_level="low")) == ["repeated risk level"]
    assert errors(change(1, risk_level="odd")) == ["unknown risk level"]
    assert errors(change(1, action="odd")) == ["unknown action"]
    assert errors(change(1, max_score=None)) == ["max_score out of range", "max_score not increasing"]
    assert errors(POLICY_V1 | {"fallback_actions": {"no_baseline": "log"}}) == ["fallback missing"]


def test_runs_and_models(spark):
    runs = spark.sql("select * from values (1L,'a','succeeded'),(3L,'a','failed'),(2L,'a','succeeded'),(4L,'b','failed') t(id, source_id, status)")
    assert [(r["id"], r["source_id"]) for r in latest_succeeded(runs).collect()] == [(2, "a")]
    assert latest_succeeded(runs, "b").count() == 0
    policies = spark.sql("""select 'v1' version, true active, '{"bands":[{"risk_level":"low","max_score":null,"action":"allow"}],"fallback_actions":{"no_baseline":"log"}}' policy""")
    assert active_policy(policies).first()["bands"][0]["action"] == "allow"
    with pytest.raises(LookupError):
        active_policy(policies.unionAll(policies))


def test_baseline_runs_and_refresh(spark):
    features = feature_rows(spark, range(101)).withColumn("visitor_id", F.lit("v"))
    counts = spark.sql("select 's' source_id, 100L event_count, 100L window_count, 5L distinct_visitors, true passes union all select 't', 9L, 1L, 1L, false")
    spec = WindowSpec()
    runs = baseline.fit_baselines(features, counts, spec, FitSpec(min_windows=1, min_visitors=1), F.lit("2024-01-01").cast("timestamp"), first_id=7)
    assert [(r["id"], r["source_id"], r["status"], r["baseline"] is None) for r in runs.orderBy("id").collect()] == [(7, "s", "succeeded", False), (8, "t", "insufficient_history", True)]
    assert runs.where(F.size(validation.run_constraints()) > 0).count() == 0
    assert scoring.loaded_models(runs, spec).count() == 1
    assert scoring.loaded_models(runs, WindowSpec(length_seconds=1)).count() == 0
    current = scoring.loaded_models(runs, spec)
    kept = scoring.refreshed_models(current, runs, WindowSpec(length_seconds=1))
    assert [r["baseline_run_id"] for r in kept.collect()] == [7]
    assert baseline.baseline_signals(runs).count() == 1


def test_sources(spark, tmp_path):
    log = tmp_path / "log.csv"
    log.write_text("IpId,UserId,TimeStamp,HttpMethod,Uri,ResponseCode,Referrer,UserAgent,Bytes\n7, - ,637150752000000000,get,/x,200,-,,10\n8,u1,637150752000000009,POST,/y,404,http://r,ua,5\n9,u,bad,GET,/,200,-,-,1\n")
    good, bad = access_log(spark, str(log), "src")
    rows = good.orderBy("visitor_id").collect()
    assert [(r["visitor_id"], r["http_method"], r["referrer_present"], r["user_agent"]) for r in rows] == [("7", "GET", False, None), ("u1", "POST", True, "ua")]
    assert good.select(F.min("event_time").cast("string")).first()[0] == "2020-01-20 00:00:00" and bad.count() == 1
    stored = spark.sql("""select '1' id, 's' source_id, 'v' visitor_id, timestamp'2024-01-01' event_time, 1L ingested_at, '{"uri":"/","http_method":"GET","status_code":200,"resource_type":"html","referrer_present":true,"user_agent":"","bytes":0,"source_id":"other"}' payload""")
    r = snapshot_events(stored).first()
    assert (r["user_agent"], r["bytes"], r["status_code"]) == (None, None, 200)
    assert rehydrated(stored, "source_id string, uri string").first()["source_id"] == "s"
    folder = str(tmp_path / "snap")
    with pytest.raises(FileNotFoundError):
        inspect_snapshots(spark, folder)
    for name in ("events", "decisions", "baseline_runs"):
        spark.range(3).write.parquet(f"{folder}/{name}.parquet")
    assert {(r["snapshot"], r["row_count"], r["column"], r["type"]) for r in inspect_snapshots(spark, folder).collect()} == {(n, 3, "id", "bigint") for n in ("events", "decisions", "baseline_runs")}
    publish_view(spark, f"{folder}/events.parquet", "published")
    assert spark.table("published").count() == 3


def test_reads(spark):
    rows = spark.createDataFrame([("s", "v", i, f"d{i}") for i in range(5)], "source_id string, visitor_id string, decided_at long, decision_id string")
    assert reads.latest_for_visitor(rows, "s", "v").first()["decision_id"] == "d4"
    assert [r["decision_id"] for r in reads.recent_for_source(rows, "s", 2).collect()] == ["d4", "d3"]
    assert (reads.read_limit(None), reads.read_limit(1000)) == (100, 1000)
    for bad in (0, -1, 1001):
        with pytest.raises(ValueError):
            reads.read_limit(bad)
    stream = rows.selectExpr("*", "decided_at as timestamp", "0 as partition", "decided_at as offset")
    assert [r["offset"] for r in reads.backfill(stream, 2, "s").collect()] == [3, 4]
    assert reads.backfill(stream, 0).count() == 0 and reads.recent_by_arrival(stream, 1).first()["offset"] == 4
