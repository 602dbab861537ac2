"""The registered queries as DuckDB SQL, built from the same steps as common table expressions."""

from __future__ import annotations

from tidegauge.functions.features import NAMES, REGISTRY
from tidegauge.operators.quality import CHECKS
from tidegauge.schemas import ACTIONS, RISK_LEVELS

LENGTH, CADENCE, LEAST = 86_400_000_000, 21_600_000_000, 3
SPLIT = "TIMESTAMP '2024-01-21 00:00:00'"


def rounded(names: list[str]) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


STEPS: dict[str, str] = {}

STEPS["ev"] = """
SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS arrival,
  CASE WHEN user_id < 3 THEN 'src-small' ELSE 'src-' || (user_id % 2) END AS source_id, CAST(user_id AS VARCHAR) AS visitor_id,
  ts AS event_time, epoch_us(ts) AS t,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS http_method,
  CASE event_type WHEN 'view' THEN '/p/' || k || '?ref=' || (event_id % 5) WHEN 'click' THEN '/static/app' || (k % 7) || '.js'
    WHEN 'purchase' THEN '/api/orders' WHEN 'signup' THEN '/signup.html' ELSE '/missing/' || k END AS uri,
  CASE event_type WHEN 'view' THEN '/p/' || k WHEN 'click' THEN '/static/app' || (k % 7) || '.js'
    WHEN 'purchase' THEN '/api/orders' WHEN 'signup' THEN '/signup.html' ELSE '/missing/' || k END AS endpoint,
  CAST(CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 404 ELSE 500 END ELSE 200 END AS INTEGER) AS status_code,
  k % 3 <> 0 AS referrer_present, 'ua-' || (user_id % 11) AS user_agent, CAST(floor(value * 100) AS BIGINT) AS bytes,
  CASE event_type WHEN 'click' THEN 'script' WHEN 'purchase' THEN 'api' ELSE 'html' END AS resource_type
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""

STEPS["counted"] = f"""
SELECT *, row_number() OVER (PARTITION BY source_id, visitor_id ORDER BY t, arrival)
  - count(*) OVER (PARTITION BY source_id, visitor_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND {LENGTH + 1} PRECEDING) AS window_count
FROM ev"""

# History before the split: its windows hold the same events, for all earlier ones are in it.
STEPS["fit_cand"] = f"""
SELECT *, row_number() OVER (PARTITION BY source_id, visitor_id ORDER BY t, arrival) AS i FROM counted
WHERE event_time < {SPLIT} AND window_count >= {LEAST}"""
STEPS["serve_cand"] = f"""
SELECT *, window_count >= {LEAST} AS eligible, row_number() OVER (PARTITION BY source_id, visitor_id ORDER BY t, arrival) AS i FROM counted
WHERE event_time >= {SPLIT}"""


def _gate(cand: str) -> str:
    """The greedy gate as a walk from each candidate to the first one that is far enough."""
    return f"""
SELECT c.* FROM {cand} c JOIN (
  WITH RECURSIVE hop AS MATERIALIZED (
    SELECT a.source_id, a.visitor_id, a.i, min(b.i) AS j FROM {cand} a
    JOIN {cand} b ON a.source_id = b.source_id AND a.visitor_id = b.visitor_id AND b.t >= a.t + {CADENCE} GROUP BY ALL),
  walk AS (
    SELECT source_id, visitor_id, i FROM {cand} WHERE i = 1
    UNION ALL
    SELECT w.source_id, w.visitor_id, h.j FROM walk w JOIN hop h ON w.source_id = h.source_id AND w.visitor_id = h.visitor_id AND w.i = h.i)
  SELECT * FROM walk) w ON c.source_id = w.source_id AND c.visitor_id = w.visitor_id AND c.i = w.i"""


STEPS["fit_s"] = _gate("fit_cand")
STEPS["serve_s"] = _gate("serve_cand")

STEPS["hz_cand"] = f"""
SELECT c.*, row_number() OVER (PARTITION BY c.source_id, c.visitor_id ORDER BY t, arrival) AS i FROM counted c
JOIN (SELECT source_id, max(t) - 7 * {LENGTH} AS h FROM ev WHERE event_time < {SPLIT} GROUP BY source_id) a ON a.source_id = c.source_id
WHERE event_time < {SPLIT} AND window_count >= {LEAST} AND t >= h"""
STEPS["hz_s"] = _gate("hz_cand")

STEPS["gaps"] = """
SELECT *, CASE WHEN resource_type = 'html' THEN max(CASE WHEN resource_type = 'html' THEN t END)
  OVER (PARTITION BY source_id, visitor_id ORDER BY t, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS page_t FROM ev"""


def _features(samples: str) -> str:
    return f"""
SELECT b.*, coalesce(-(CASE WHEN g = 0 THEN 0 ELSE g / n * log2(g / n) END) - (CASE WHEN n - g = 0 THEN 0 ELSE (n - g) / n * log2((n - g) / n) END), 0.0) AS method_entropy
FROM (
  SELECT s.source_id, s.visitor_id, s.event_id, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (e.http_method = 'GET') AS DOUBLE) AS g,
    CAST(count(*) AS DOUBLE) AS window_request_count, (max(e.t) - min(e.t)) / 1e6 AS window_span_seconds,
    avg(gap) AS mean_inter_request_gap_ms, CASE WHEN count(gap) >= 2 AND avg(gap) <> 0 THEN stddev_pop(gap) / avg(gap) END AS inter_request_gap_cv,
    CAST(count(DISTINCT e.endpoint) AS DOUBLE) AS distinct_endpoints_hit,
    count(*) FILTER (e.resource_type = 'html') / count(*) AS html_to_asset_ratio,
    count(*) FILTER (e.status_code BETWEEN 400 AND 499) / count(*) AS error_4xx_rate,
    count(*) FILTER (e.referrer_present) / count(*) AS has_referrer_ratio
  FROM {samples} s JOIN (SELECT * FROM gaps) e ON s.source_id = e.source_id AND s.visitor_id = e.visitor_id
    AND e.t BETWEEN s.t - {LENGTH} AND s.t AND (e.t < s.t OR e.arrival <= s.arrival)
  CROSS JOIN LATERAL (SELECT CASE WHEN e.page_t >= s.t - {LENGTH} THEN (e.t - e.page_t) / 1000 END AS gap)
  GROUP BY s.source_id, s.visitor_id, s.event_id) b"""


STEPS["fit_f"] = _features("fit_s")
STEPS["serve_f"] = _features("serve_s")

STEPS["gate"] = f"""
SELECT e.source_id, e.event_count, coalesce(s.window_count, 0) AS window_count, coalesce(s.distinct_visitors, 0) AS distinct_visitors,
  coalesce(s.window_count, 0) >= 50 AND coalesce(s.distinct_visitors, 0) >= 5 AS passes
FROM (SELECT source_id, count(*) AS event_count FROM ev WHERE event_time < {SPLIT} GROUP BY source_id) e
LEFT JOIN (SELECT source_id, count(*) AS window_count, count(DISTINCT visitor_id) AS distinct_visitors FROM fit_s GROUP BY source_id) s ON e.source_id = s.source_id"""


def _long(features: str) -> str:
    cells = []
    for i, f in enumerate(REGISTRY):
        v = f"ln(1 + {f.name})" if f.transform == "log1p" else f.name
        cells.append(f"SELECT source_id, event_id, {i} AS ord, '{f.name}' AS name, '{f.transform}' AS transform, {v} AS v FROM {features}")
    return "\nUNION ALL ".join(cells)


STEPS["fit_ok"] = "SELECT f.* FROM fit_f f JOIN gate g ON f.source_id = g.source_id WHERE g.passes"
STEPS["fit_l"] = _long("fit_ok")
STEPS["serve_l"] = _long("serve_f")
STEPS["stats"] = """
SELECT source_id, ord, name, transform, count(*) AS total, count(v) AS defined, min(v) AS low, max(v) AS high, (max(v) - min(v)) / 50 AS width
FROM fit_l GROUP BY ALL"""
STEPS["bins"] = """
SELECT l.source_id, l.ord, l.name, CASE WHEN s.width = 0 THEN 0 ELSE CAST(least(greatest(floor((l.v - s.low) / nullif(s.width, 0)), 0), 49) AS INTEGER) END AS bin, count(*) AS bin_count
FROM fit_l l JOIN stats s ON l.source_id = s.source_id AND l.ord = s.ord WHERE l.v IS NOT NULL GROUP BY ALL"""


def _scores(long: str) -> str:
    """Raw scores: minus the log of the probability of each feature's value, summed."""
    return f"""
SELECT source_id, event_id, round(sum(term), 9) AS score FROM (
  SELECT l.source_id, l.event_id, CASE
    WHEN l.v IS NULL THEN -ln((s.total - s.defined + 0.1) / (s.total + 0.2))
    ELSE -ln((1 - (s.total - s.defined + 0.1) / (s.total + 0.2)) * CASE
      WHEN s.defined = 0 THEN 1.0
      WHEN s.width = 0 THEN CASE WHEN l.v = s.low THEN 1.0 ELSE 0.1 / (s.defined + 5.0) END
      WHEN l.v >= s.low AND l.v <= s.low + s.width * 50 THEN (coalesce(b.bin_count, 0) + 0.1) / (s.defined + 5.0)
      ELSE 0.1 / (s.defined + 5.0) END) END AS term
  FROM {long} l JOIN stats s ON l.source_id = s.source_id AND l.ord = s.ord
  LEFT JOIN bins b ON b.source_id = l.source_id AND b.ord = l.ord
    AND b.bin = CAST(least(greatest(floor((l.v - s.low) / nullif(s.width, 0)), 0), 49) AS INTEGER))
GROUP BY source_id, event_id"""


STEPS["fit_sc"] = _scores("fit_l")
STEPS["serve_sc"] = _scores("serve_l")
STEPS["quant"] = """
SELECT source_id, i, max(q) OVER (PARTITION BY source_id ORDER BY i) AS q FROM (
  SELECT g.source_id, CAST(g.i AS INTEGER) AS i,
    CASE WHEN g.k = 0 THEN x1.score ELSE (g.k + 1 - g.f) * x0.score + (1 - (g.k + 1 - g.f)) * x1.score END AS q
  FROM (SELECT source_id, i, i / 1000.0::DOUBLE * n AS f, greatest(ceil(i / 1000.0::DOUBLE * n) - 1, 0) AS k
        FROM (SELECT source_id, CAST(count(*) AS DOUBLE) AS n FROM fit_sc GROUP BY source_id), (SELECT unnest(range(1001)) AS i)) g
  JOIN ranked x1 ON x1.source_id = g.source_id AND x1.r = g.k
  LEFT JOIN ranked x0 ON x0.source_id = g.source_id AND x0.r = g.k - 1)"""
STEPS["ranked"] = "SELECT source_id, score, row_number() OVER (PARTITION BY source_id ORDER BY score) - 1 AS r FROM fit_sc"
STEPS["runs"] = f"""
SELECT row_number() OVER (ORDER BY source_id) AS id, source_id, CASE WHEN passes THEN 'succeeded' ELSE 'insufficient_history' END AS status,
  {SPLIT} AS fit_at, CAST(window_count AS INTEGER) AS window_count, CAST(distinct_visitors AS INTEGER) AS distinct_visitors,
  CAST(event_count AS INTEGER) AS event_count, CAST(CASE WHEN passes THEN {len(REGISTRY)} ELSE 0 END AS INTEGER) AS n_features FROM gate"""
STEPS["dec"] = """
SELECT 'd-' || event_id AS decision_id, event_id, source_id, visitor_id, decided_at, status, score_raw, score_normalized,
  CASE WHEN score_normalized IS NULL THEN NULL WHEN score_normalized < 0.70 THEN 'low' WHEN score_normalized < 0.90 THEN 'medium' WHEN score_normalized < 0.98 THEN 'high' ELSE 'critical' END AS risk_level,
  CASE WHEN score_normalized IS NULL THEN 'log' WHEN score_normalized < 0.70 THEN 'allow' WHEN score_normalized < 0.90 THEN 'log' WHEN score_normalized < 0.98 THEN 'challenge' ELSE 'block' END AS action,
  'v1' AS policy_version, baseline_run_id
FROM (
  SELECT s.event_id, s.source_id, s.visitor_id, s.event_time AS decided_at, r.id AS baseline_run_id,
    CASE WHEN r.id IS NULL THEN 'no_baseline' WHEN NOT s.eligible THEN 'insufficient_history' ELSE 'scored' END AS status,
    CASE WHEN r.id IS NOT NULL AND s.eligible THEN c.score END AS score_raw,
    CASE WHEN r.id IS NOT NULL AND s.eligible THEN (SELECT count(*) FROM quant q WHERE q.source_id = s.source_id AND round(q.q, 9) <= c.score) / 1001 END AS score_normalized
  FROM serve_s s LEFT JOIN (SELECT * FROM runs WHERE status = 'succeeded') r ON r.source_id = s.source_id
  LEFT JOIN serve_sc c ON c.source_id = s.source_id AND c.event_id = s.event_id)"""
STEPS["dated"] = "SELECT d.*, e.event_time, CAST(e.event_time AS DATE) AS event_date FROM dec d LEFT JOIN ev e ON d.event_id = e.event_id"
STEPS["traffic"] = """
SELECT source_id, CAST(event_time AS DATE) AS event_date, count(*) AS request_count, count(DISTINCT visitor_id) AS distinct_visitor_count,
  count(DISTINCT uri) AS distinct_uri_count, count(*) FILTER (status_code BETWEEN 400 AND 499) AS http_4xx_count, count(*) FILTER (referrer_present) AS referrer_present_count,
  CAST(count(*) FILTER (status_code BETWEEN 400 AND 499) AS DOUBLE) / count(*) AS http_4xx_rate, CAST(count(*) FILTER (referrer_present) AS DOUBLE) / count(*) AS referrer_present_rate
FROM ev GROUP BY ALL"""
_COUNTS = [
    "count(*) AS evaluated_window_count",
    *(f"count(*) FILTER (status = '{s}') AS {s}_window_count" for s in ("scored", "no_baseline", "insufficient_history")),
    *(f"count(*) FILTER (risk_level = '{r}') AS {r}_risk_count" for r in RISK_LEVELS),
    *(f"count(*) FILTER (action = '{a}') AS {a}_action_count" for a in ACTIONS),
]
COUNT_NAMES = [c.rsplit(" ", 1)[1] for c in _COUNTS]
SCORE_NAMES = ["average_normalized_score", "p90_normalized_score", "p99_normalized_score", "maximum_normalized_score"]
STEPS["outcomes"] = f"""
SELECT source_id, event_date, {", ".join(_COUNTS)}, avg(score_normalized) AS average_normalized_score, quantile_cont(score_normalized, 0.9) AS p90_normalized_score,
  quantile_cont(score_normalized, 0.99) AS p99_normalized_score, max(score_normalized) AS maximum_normalized_score FROM dated GROUP BY source_id, event_date"""
STEPS["segments"] = """
SELECT g.*, r.status AS baseline_status, r.fit_at AS baseline_fit_at, r.event_count AS baseline_event_count, r.window_count AS baseline_window_count, r.distinct_visitors AS baseline_distinct_visitor_count
FROM (
  SELECT source_id, event_date, segment_number, baseline_run_id, count(*) AS baseline_usage_window_count, count(*) FILTER (status = 'scored') AS scored_window_count,
    count(*) FILTER (status = 'insufficient_history') AS insufficient_history_window_count, min(event_time) AS first_event_time, max(event_time) AS last_event_time,
    min(decided_at) AS first_decided_at, max(decided_at) AS last_decided_at
  FROM (SELECT *, CAST(sum(starts) OVER (PARTITION BY source_id, event_date ORDER BY event_time, decided_at, decision_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_number
    FROM (SELECT *, CASE WHEN baseline_run_id IS DISTINCT FROM lag(baseline_run_id) OVER (PARTITION BY source_id, event_date ORDER BY event_time, decided_at, decision_id) THEN 1 ELSE 0 END AS starts
      FROM dated WHERE baseline_run_id IS NOT NULL))
  GROUP BY source_id, event_date, segment_number, baseline_run_id) g
LEFT JOIN runs r ON r.id = g.baseline_run_id AND r.source_id = g.source_id"""
STEPS["mart"] = f"""
SELECT t.*, {", ".join(f"coalesce(o.{c}, 0) AS {c}" for c in COUNT_NAMES)}, {", ".join(f"o.{c}" for c in SCORE_NAMES)}
FROM traffic t LEFT JOIN outcomes o ON t.source_id = o.source_id AND t.event_date = o.event_date"""

NEEDS = {
    "counted": ["ev"], "fit_cand": ["counted"], "serve_cand": ["counted"], "fit_s": ["fit_cand"], "serve_s": ["serve_cand"], "hz_cand": ["counted"], "hz_s": ["hz_cand"], "gaps": ["ev"],
    "fit_f": ["fit_s", "gaps"], "serve_f": ["serve_s", "gaps"], "gate": ["ev", "fit_s"], "fit_ok": ["fit_f", "gate"], "fit_l": ["fit_ok"], "serve_l": ["serve_f"],
    "stats": ["fit_l"], "bins": ["fit_l", "stats"], "fit_sc": ["fit_l", "stats", "bins"], "serve_sc": ["serve_l", "stats", "bins"], "ranked": ["fit_sc"],
    "quant": ["ranked", "fit_sc"], "runs": ["gate"], "dec": ["serve_s", "runs", "quant", "serve_sc"], "dated": ["dec", "ev"], "traffic": ["ev"],
    "outcomes": ["dated"], "segments": ["dated", "runs"], "mart": ["traffic", "outcomes"],
}


def sql(last: str, body: str) -> str:
    """body over the step named last and all that it needs."""
    order: list[str] = []

    def visit(step: str) -> None:
        for n in NEEDS.get(step, []):
            visit(n)
        if step not in order:
            order.append(step)

    for step in last.split():
        visit(step)
    return "WITH " + ",\n".join(f"{s} AS MATERIALIZED ({STEPS[s]})" for s in order) + "\n" + body


DECISION = "decision_id, event_id, source_id, visitor_id, decided_at, status, round(score_raw, 6) AS score_raw, round(score_normalized, 6) AS score_normalized, risk_level, action, policy_version, CAST(baseline_run_id AS VARCHAR) AS baseline_run_id"
MART = f"source_id, event_date, request_count, distinct_visitor_count, distinct_uri_count, http_4xx_count, referrer_present_count, {rounded(['http_4xx_rate', 'referrer_present_rate'])}"
ERRORS = "CASE WHEN arrival % 3 = 0 THEN 'http_method required' END, CASE WHEN arrival % 7 = 0 THEN 'status_code out of range: ' || (status_code + 1000) END, CASE WHEN arrival % 5 = 0 THEN 'bytes must be non-negative' END"
PERCENT = "coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0) * 100, 0.0)"
_ALL_ACTIONS = " + ".join(f"sum({a}_action_count)" for a in ACTIONS)



def _nth(n: int, broken: str, column: str) -> str:
    return f"CASE WHEN CAST(event_id AS BIGINT) % {n} = 0 THEN {broken} ELSE {column} END AS {column}"


def _listed(rows: str, columns: str, *checks: tuple[str, str]) -> str:
    """The rows that break a check, with what they break; an unknown outcome is a failure."""
    said = ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{message}' END" for ok, message in checks)
    return f"SELECT * FROM (SELECT {columns}, concat_ws('; ', {said}) AS violations FROM ({rows})) WHERE violations <> ''"


_OBJECT = "CASE WHEN json_valid({0}) THEN json_type({0}) END = 'OBJECT'"
_NULLS = "score_raw IS {0} NULL AND score_normalized IS {0} NULL AND risk_level IS {0} NULL"
_LABEL_ROWS = "SELECT event_id, CASE arrival % 5 WHEN 0 THEN 'true_positive' WHEN 1 THEN 'false_positive' WHEN 2 THEN 'false_negative' WHEN 3 THEN 'benign' END AS label FROM ev"
_EVENT_ROWS = (
    f"SELECT event_id, {_nth(11, 'repeat(chr(115), 65)', 'source_id')}, {_nth(13, 'repeat(chr(118), 128)', 'visitor_id')}, {_nth(23, 'NULL', 'event_time')}, "
    f"{_nth(17, chr(39) + '{garbage' + chr(39), 'payload')}, {_nth(19, chr(39) + '[]' + chr(39), 'features')} "
    "FROM (SELECT *, CAST(to_json({'uri': uri}) AS VARCHAR) AS payload, '{}' AS features FROM ev)"
)
_DECISION_ROWS = f"SELECT * REPLACE ({', '.join((_nth(5, '-0.5', 'score_raw'), _nth(7, '1.5', 'score_normalized'), _nth(11, chr(39) + 'odd' + chr(39), 'action'), _nth(13, 'NULL', 'risk_level'), _nth(17, 'repeat(chr(115), 65)', 'source_id')))}) FROM dec"
_POLICY_ROWS = """SELECT n_name, repeat(n_name, CAST(n_nationkey % 12 AS BIGINT)) AS version, CASE n_nationkey % 4 WHEN 0 THEN '{"bands": []}' WHEN 1 THEN '[1]' WHEN 2 THEN '{bad' ELSE '{}' END AS policy,
  CASE WHEN n_nationkey % 7 > 0 THEN n_nationkey % 5 = 0 END AS active FROM nation"""

ORACLES: dict[str, str] = {
    "event_constraint_violations": sql(
        "ev", _listed(_EVENT_ROWS, "event_id", ("event_time IS NOT NULL", "event_time is null"), ("length(source_id) <= 64", "source_id length"), ("length(visitor_id) <= 128", "visitor_id length"), (_OBJECT.format("payload"), "payload is no object"), (_OBJECT.format("features"), "features is no object"))
    ),
    "decision_constraint_violations": sql(
        "dec",
        _listed(
            _DECISION_ROWS,
            "event_id",
            ("length(source_id) <= 64", "source_id length"),
            ("score_raw IS NULL OR score_raw >= 0", "score_raw is negative"),
            ("score_normalized IS NULL OR score_normalized BETWEEN 0 AND 1", "score_normalized out of range"),
            (f"action IN {ACTIONS}", "action"),
            (
                f"(status = 'scored' AND {_NULLS.format('NOT')} AND baseline_run_id IS NOT NULL) OR (status = 'insufficient_history' AND {_NULLS.format('')} AND baseline_run_id IS NOT NULL) "
                f"OR (status = 'no_baseline' AND {_NULLS.format('')} AND baseline_run_id IS NULL)",
                "status and nulls disagree",
            ),
        ),
    ),
    "label_constraint_violations": sql("ev", _listed(_LABEL_ROWS, "event_id, label", ("label IN ('true_positive', 'false_positive', 'false_negative')", "label"))),
    "run_constraint_violations": sql("runs", _listed("SELECT source_id, status, window_count - 100 AS window_count FROM runs", "source_id", ("window_count >= 0", "window_count is negative"), ("source_id <> 'src-0'", "registry_hash length"), ("status = 'succeeded'", "model present iff succeeded"))),
    "policy_row_violations": _listed(_POLICY_ROWS, "n_name", ("length(version) <= 64", "version length"), ("active IS NOT NULL", "active is null"), (_OBJECT.format("policy"), "policy is no object")),
    "http_events": sql("ev", "SELECT event_id, source_id, visitor_id, event_time, http_method, uri, status_code, referrer_present, user_agent, bytes, resource_type, endpoint FROM ev"),
    "event_validation": sql("ev", f"SELECT event_id, concat_ws('; ', {ERRORS}) AS errors FROM ev"),
    "resource_mix": sql("ev", "SELECT source_id, resource_type, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM ev GROUP BY ALL"),
    "daily_traffic": sql("traffic", f"SELECT {MART} FROM traffic"),
    "trailing_window_counts": sql("counted", f"SELECT event_id, window_count, window_count >= {LEAST} AS eligible FROM counted"),
    "fit_samples": sql("fit_s", "SELECT source_id, visitor_id, event_id, event_time, window_count FROM fit_s"),
    "window_features": sql("fit_f", f"SELECT source_id, visitor_id, event_id, {rounded(list(NAMES))} FROM fit_f"),
    "fit_gate_counts": sql("gate", "SELECT source_id, event_count, window_count, distinct_visitors, passes FROM gate"),
    "feature_histogram_bins": sql("bins", "SELECT source_id, name, bin, bin_count FROM bins"),
    "baseline_histograms": sql(
        "stats bins",
        """SELECT s.source_id, s.name, s.transform, round((s.total - s.defined + 0.1) / (s.total + 0.2), 6) AS p_undefined, CAST(s.defined AS INTEGER) AS defined_count,
  round(coalesce(s.low, 0.0), 6) AS bin_min, round(coalesce(s.width, 0.0), 6) AS bin_width, CAST(CASE WHEN s.defined = 0 THEN 0 WHEN s.width = 0 THEN 1 ELSE 50 END AS INTEGER) AS n_bins,
  round(CASE WHEN s.defined = 0 THEN 0.0 ELSE 1.0 END, 6) AS total_mass,
  round(CASE WHEN s.defined = 0 THEN NULL WHEN s.width = 0 THEN 1.0 ELSE (max(b.bin_count) + 0.1) / (s.defined + 5.0) END, 6) AS top_mass,
  round(CASE WHEN s.defined = 0 THEN 1.0 ELSE 0.1 / (s.defined + 5.0) END, 6) AS out_of_range_mass
FROM stats s LEFT JOIN bins b ON s.source_id = b.source_id AND s.ord = b.ord GROUP BY s.source_id, s.ord, s.name, s.transform, s.total, s.defined, s.low, s.width""",
    ),
    "baseline_quantiles": sql("quant", "SELECT source_id, i, round(q, 6) AS q FROM quant"),
    "baseline_runs": sql("runs", "SELECT * FROM runs"),
    "late_events": sql(
        "ev",
        """SELECT source_id, count(*) AS n, count(*) FILTER (t < before) AS n_late FROM (
  SELECT *, max(t) OVER (PARTITION BY source_id, visitor_id ORDER BY arrival + CASE WHEN arrival % 10 = 0 THEN 500 ELSE 0 END, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ev) GROUP BY source_id""",
    ),
    "serve_gate": sql("serve_s", "SELECT source_id, visitor_id, event_id, event_time, window_count, eligible FROM serve_s"),
    "decisions": sql("dec", f"SELECT {DECISION} FROM dec"),
    "decisions_with_event_date": sql("dated", "SELECT decision_id, event_id, source_id, event_time, event_date, status, risk_level, action FROM dated"),
    "daily_outcomes": sql("outcomes", f"SELECT source_id, event_date, {', '.join(COUNT_NAMES)}, {rounded(SCORE_NAMES)} FROM outcomes"),
    "baseline_usage_segments": sql("segments", "SELECT * FROM segments"),
    "daily_risk_mart": sql("mart", f"SELECT {MART}, {', '.join(COUNT_NAMES)}, {rounded(SCORE_NAMES)} FROM mart"),
    "risk_mart_segments_unnested": sql("segments", "SELECT source_id, event_date, segment_number, baseline_run_id, first_event_time, last_event_time, baseline_usage_window_count, scored_window_count, insufficient_history_window_count, baseline_fit_at FROM segments"),
    "latest_decision_per_visitor": sql(
        "dec",
        """SELECT source_id, visitor_id, decision_id, decided_at, status, round(score_normalized, 6) AS score_normalized, action
FROM (SELECT *, row_number() OVER (PARTITION BY source_id, visitor_id ORDER BY decided_at DESC, decision_id DESC) AS r FROM dec) WHERE r = 1""",
    ),
    "recent_decisions_by_source": sql("dec", "SELECT decision_id, decided_at, status, action FROM dec WHERE source_id = 'src-0' ORDER BY decided_at DESC, decision_id DESC LIMIT 100"),
    "filter_options": sql("traffic", "SELECT source_id, min(event_date) AS first_date, max(event_date) AS last_date FROM traffic GROUP BY source_id"),
    "daily_summaries_partial_day": sql(
        "mart",
        """SELECT source_id, event_date, is_partial_day, request_count, scored_window_count FROM (
  SELECT *, event_date = min(event_date) OVER (PARTITION BY source_id) OR event_date = max(event_date) OVER (PARTITION BY source_id) AS is_partial_day FROM mart)
WHERE event_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-25'""",
    ),
    "kpi_totals": sql(
        "mart",
        "SELECT CAST(sum(request_count) AS BIGINT) AS requests, CAST(sum(evaluated_window_count) AS BIGINT) AS evaluated, CAST(sum(scored_window_count) AS BIGINT) AS scored, "
        "CAST(sum(challenge_action_count) AS BIGINT) AS challenges, CAST(sum(block_action_count) AS BIGINT) AS blocked FROM mart",
    ),
    "evaluation_rate": sql("mart", f"SELECT source_id, event_date, request_count, evaluated_window_count, round({PERCENT.format(a='evaluated_window_count', b='request_count')}, 6) AS evaluation_rate FROM mart"),
    "risk_composition": sql("mart", " UNION ALL ".join(f"SELECT source_id, event_date, '{r}' AS risk_level, {r}_risk_count AS window_count, round({PERCENT.format(a=f'{r}_risk_count', b='scored_window_count')}, 6) AS share_of_scored FROM mart" for r in RISK_LEVELS)),
    "action_distribution": sql("mart", " UNION ALL ".join(f"SELECT '{a}' AS action, CAST(sum({a}_action_count) AS BIGINT) AS window_count, round({PERCENT.format(a=f'sum({a}_action_count)', b=f'({_ALL_ACTIONS})')}, 6) AS share FROM mart" for a in ACTIONS)),
    "score_trend": sql("mart", f"SELECT source_id, event_date, {rounded(SCORE_NAMES[:3])} FROM mart WHERE average_normalized_score IS NOT NULL AND p90_normalized_score IS NOT NULL AND p99_normalized_score IS NOT NULL"),
    "daily_requests": sql("traffic", "SELECT source_id, event_date, request_count FROM traffic"),
    "quality_report": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', CAST(0 AS BIGINT))" for c in CHECKS) + ") AS t(check_name, violations)",
}

_N = "CAST(event_id AS BIGINT)"
ORACLES |= {
    "event_envelopes": sql(
        "ev",
        f"""SELECT CAST({_N} % 3 AS INTEGER) AS "partition", {_N} AS "offset", event_id, source_id, visitor_id, event_time, http_method, uri, status_code, referrer_present, user_agent,
  nullif(bytes, 0) AS bytes, resource_type FROM ev WHERE {_N} % 13 <> 0 AND {_N} % 17 <> 0""",
    ),
    "event_dead_letters": sql(
        "ev",
        f"""SELECT 'raw_events' AS original_topic, CAST({_N} % 3 AS INTEGER) AS original_partition, {_N} AS original_offset, CASE WHEN {_N} % 13 = 0 THEN 'malformed JSON' ELSE 'incomplete envelope' END AS reason
FROM ev WHERE {_N} % 13 = 0 OR {_N} % 17 = 0""",
    ),
    "decision_envelopes": sql(
        "serve_s",
        f"""SELECT {_N} AS "offset", 'd-' || event_id AS decision_id, event_id, source_id, visitor_id, event_time AS decided_at, CAST(NULL AS DOUBLE) AS score_raw, round(window_count / 1000, 6) AS score_normalized,
  'low' AS risk_level, 'log' AS action, 'scored' AS status, 'v1' AS policy_version, CAST(1 AS BIGINT) AS baseline_run_id FROM serve_s WHERE {_N} % 7 <> 0""",
    ),
    "snapshot_of_events": sql(
        "ev",
        f"""SELECT event_id AS id, source_id, visitor_id, event_time, uri, http_method, status_code, resource_type, referrer_present,
  CASE WHEN {_N} % 5 <> 0 THEN user_agent END AS user_agent, CASE WHEN {_N} % 4 <> 0 THEN nullif(bytes, 0) END AS bytes FROM ev""",
    ),
    "rehydrated_events": sql("ev", f"SELECT event_id AS id, source_id, visitor_id, event_time, uri, status_code, CASE WHEN {_N} % 4 = 0 THEN 0 ELSE bytes END AS bytes FROM ev"),
    "strict_decoding": sql(
        "ev",
        f"""SELECT event_id, e AS decode_error, CASE WHEN e IS NULL THEN uri END AS uri, CASE WHEN e IS NULL THEN status_code END AS status_code
FROM (SELECT *, CASE WHEN {_N} % 11 = 0 THEN 'body too large' WHEN {_N} % 7 = 0 THEN 'malformed JSON' WHEN {_N} % 5 = 0 THEN 'unknown field: extra' END AS e FROM ev)""",
    ),
    "access_log_events": sql(
        "ev",
        f"""SELECT 'web' AS source_id, CASE WHEN {_N} % 4 = 0 THEN 'ip-' || visitor_id ELSE visitor_id END AS visitor_id, event_time, http_method, uri, status_code, referrer_present,
  CASE WHEN {_N} % 6 <> 0 THEN user_agent END AS user_agent, bytes FROM ev WHERE {_N} % 11 <> 0 AND {_N} % 19 <> 0""",
    ),
    "orphan_labels": sql("ev serve_s", "SELECT event_id, 'd-' || event_id AS decision_id FROM ev WHERE event_id NOT IN (SELECT event_id FROM serve_s)"),
    "policy_rule_errors": """SELECT n_name AS version, unnest(CASE n_nationkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['no bands'] WHEN 2 THEN ['max_score not increasing']
  ELSE ['unknown risk level', 'repeated risk level', 'unknown action', 'max_score out of range', 'last band not open', 'fallback missing'] END) AS error FROM nation""",
    "active_policy_bands": """SELECT n_name AS version, CAST(place AS BIGINT) AS place, CASE place WHEN 0 THEN 'low' ELSE 'high' END AS risk_level, CASE place WHEN 0 THEN CAST(0.7 AS DOUBLE) END AS max_score,
  CASE place WHEN 0 THEN 'allow' ELSE 'block' END AS action FROM nation, (SELECT unnest([0, 1]) AS place) WHERE n_nationkey = 4""",
    "baseline_update_signals": sql("runs", "SELECT source_id, id AS baseline_run_id FROM runs WHERE status = 'succeeded'"),
    "fit_samples_within_horizon": sql("hz_s", "SELECT source_id, visitor_id, event_id, event_time, window_count FROM hz_s"),
    "recent_arrivals": sql("ev", f"SELECT 'd-' || event_id AS decision_id, make_timestamp({_N} // 50 * 1000000) AS timestamp FROM ev ORDER BY {_N} // 50 DESC, {_N} % 4 DESC, {_N} DESC LIMIT 200"),
    "backfilled_arrivals": sql("ev", f"SELECT 'd-' || event_id AS decision_id, source_id FROM ev WHERE source_id = 'src-1' ORDER BY {_N} // 50 DESC, {_N} % 4 DESC, {_N} DESC LIMIT 50"),
    "latest_view_after_batches": sql(
        "ev",
        f"""SELECT source_id, visitor_id, 'd-' || event_id AS decision_id FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id, visitor_id ORDER BY {_N} // 50 DESC, {_N} % 4 DESC, {_N} DESC) AS r FROM ev) WHERE r = 1""",
    ),
    "latest_of_one_visitor": sql("ev", "SELECT source_id, visitor_id, 'd-' || event_id AS decision_id, event_time AS decided_at FROM ev WHERE source_id = 'src-1' AND visitor_id = '7' ORDER BY event_time DESC, 'd-' || event_id DESC LIMIT 1"),
    "stored_once": sql("ev", f"SELECT event_id, CASE WHEN {_N} % 11 = 0 THEN 'bytes must be non-negative' ELSE source_id END AS source_id, CASE WHEN {_N} % 11 <> 0 THEN bytes END AS bytes FROM ev"),
    "published_traffic": sql("traffic", "SELECT source_id, event_date, request_count, distinct_visitor_count FROM traffic"),
}
