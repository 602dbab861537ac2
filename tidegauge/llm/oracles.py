"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force in tests/llm."""

from __future__ import annotations

from tidegauge.llm import compression
from tidegauge.llm.mixing import Mix
from tidegauge.llm.repetition import MAX_COVERED, MAX_LONGEST, MIN_REPEAT_WORDS
from tidegauge.llm.resampling import POLYNOMIAL, Resample
from tidegauge.llm.unit_dedup import MIN_WORDS, PASSAGE_WORDS, RUN_WORDS, UNSPACED
from tidegauge.llm.vectors import LEAST_COSINE

WORD = r"[^\x20\x09-\x0D]+"


def _covered(name: str, k: int, where: str = "") -> str:
    """Words of each document in windows of k words that it has twice or more."""
    return f"""
{name} AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest(range(i, i + {k})) AS p FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
      SELECT doc_id, i, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM words {where})))
  WHERE c > 1) GROUP BY doc_id)"""


OP1 = f"""
WITH words AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
{_covered("short", 3)},
{_covered("long", MIN_REPEAT_WORDS)},
{_covered("longest", MAX_LONGEST + 1, f"WHERE doc_id IN (SELECT doc_id FROM long WHERE n > {MAX_LONGEST})")},
counted AS (
  SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(d.n, 0) AS n_dup_lines,
    coalesce(s.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS covered_words, coalesce(x.n, 0) > 0 AS too_long
  FROM words w LEFT JOIN dups d ON w.doc_id = d.doc_id LEFT JOIN short s ON w.doc_id = s.doc_id LEFT JOIN long l ON w.doc_id = l.doc_id LEFT JOIN longest x ON w.doc_id = x.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND covered_words <= {MAX_COVERED} * n_words AND NOT too_long AS kept, covered_words
FROM counted"""

OP4 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {LEAST_COSINE}),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
links AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(l.y, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(l.y, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN links n ON n.x = e.vec_id LEFT JOIN low l ON l.x = e.vec_id"""

_MIX = Mix()


def _weight(column: str, weights) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {float(v)}::DOUBLE" for k, v in weights.items()) + " ELSE 1.0::DOUBLE END"


def _share(source: str, parents: str, name: str) -> str:
    of = f"PARTITION BY {parents}" if parents else ""
    up = f"{of} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""
SELECT *, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE greatest(0.0, (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({of})) * weight
  / sum(CASE WHEN is_full THEN 0.0::DOUBLE ELSE weight END) OVER ({of})) END AS given
FROM (SELECT *, (budget - (sum(cap) OVER ({up}) - cap)) / (sum(weight) OVER ({of}) - (sum(weight) OVER ({up}) - weight)) * weight >= cap AS is_full FROM ({source}))"""


_LEAF = "domain, lang, source"
OP5 = f"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, coalesce('d' || floor(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INTEGER) / 5)::INTEGER, 'd') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS tokens FROM documents),
leaves AS (SELECT {_LEAF}, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {_MIX.max_epochs} AS cap FROM docs GROUP BY {_LEAF}),
whole AS (SELECT least(floor(sum(cap) / {_MIX.max_epochs} * {_MIX.budget}::DOUBLE), sum(cap)) AS budget FROM leaves),
top AS ({_share(f"SELECT domain, sum(cap)::BIGINT AS cap, {_weight('domain', _MIX.domain)} AS weight, (SELECT budget FROM whole)::DOUBLE AS budget FROM leaves GROUP BY domain", "", "domain")}),
mid AS ({_share(f"SELECT l.domain, l.lang, sum(l.cap)::BIGINT AS cap, {_weight('l.lang', _MIX.lang)} AS weight, any_value(t.given) AS budget FROM leaves l JOIN top t ON l.domain = t.domain GROUP BY l.domain, l.lang", "domain", "lang")}),
low AS ({_share(f"SELECT l.domain, l.lang, l.source, l.tokens, l.cap, {_weight('l.source', _MIX.source)} AS weight, m.given AS budget FROM leaves l JOIN mid m ON l.domain = m.domain AND l.lang = m.lang", "domain, lang", "source")}),
plan AS (SELECT {_LEAF}, tokens AS total, CAST(floor(given + 1e-6) AS BIGINT) AS given, coalesce(CAST(floor(given + 1e-6) AS BIGINT) // nullif(tokens, 0), 0) AS epochs FROM low),
placed AS (SELECT d.*, p.epochs, p.given - p.epochs * p.total AS rest, md5('{_MIX.seed}:' || p.epochs || ':' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')) AS place
  FROM docs d JOIN plan p ON d.domain = p.domain AND d.lang = p.lang AND d.source = p.source),
ranked AS (SELECT *, sum(tokens) OVER (PARTITION BY {_LEAF} ORDER BY place) <= rest AS taken FROM placed)
SELECT doc_id, {_LEAF}, tokens, CAST(unnest(range(epochs + CASE WHEN taken THEN 1 ELSE 0 END)) AS BIGINT) AS epoch FROM ranked"""

OP8 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
parts AS (SELECT doc_id, k, string_split(regexp_replace(line, '([.!?]+[ \\t]+|[。！？]+[ \\t]*)', '\\1' || chr(10), 'g'), chr(10)) AS p FROM lines),
tiles AS (SELECT doc_id, k, unnest(p) AS tile, generate_subscripts(p, 1) AS j FROM parts),
placed AS MATERIALIZED (
  SELECT *, coalesce(sum(length(tile)) OVER (PARTITION BY doc_id ORDER BY k, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + k - 1 AS lo,
    trim(regexp_replace(regexp_replace(lower(tile), '([{UNSPACED}])', ' \\1 ', 'g'), '[^\\pL\\pN]+', ' ', 'g')) AS plain FROM tiles),
sized AS MATERIALIZED (
  SELECT *, CASE WHEN plain = '' THEN 0 ELSE len(string_split(plain, ' ')) END AS words FROM placed),
cuts AS (
  SELECT doc_id, k, lo, lo + length(tile) AS hi, plain, words FROM sized WHERE words >= {RUN_WORDS}
  UNION ALL SELECT doc_id, k, min(lo), max(lo + length(tile)), string_agg(plain, ' ' ORDER BY j) FILTER (WHERE plain <> ''), sum(words)::BIGINT
  FROM sized GROUP BY doc_id, k HAVING max(words) < {RUN_WORDS} AND sum(words) >= {MIN_WORDS}),
units AS MATERIALIZED (
  SELECT doc_id, lo, hi, plain, words, row_number() OVER (PARTITION BY doc_id ORDER BY lo) AS u, words >= {RUN_WORDS} AS is_long,
    count(*) FILTER (WHERE words >= {RUN_WORDS}) OVER (PARTITION BY doc_id ORDER BY lo) AS place FROM cuts),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY plain ORDER BY doc_id, u) > 1 AS later, count(*) OVER (PARTITION BY plain) AS copies,
    min(doc_id) OVER (PARTITION BY plain) AS source, max(doc_id) OVER (PARTITION BY plain) AS latest FROM units),
repeated AS (SELECT *, CASE WHEN source <> latest THEN words ELSE 0 END AS shared, place - count(*) FILTER (WHERE is_long) OVER (PARTITION BY doc_id ORDER BY u) AS run FROM ranked WHERE copies > 1),
runs AS MATERIALIZED (SELECT *, sum(CASE WHEN is_long THEN shared ELSE 0 END) OVER (PARTITION BY doc_id, run) AS run_shared FROM repeated),
lost AS (
  SELECT doc_id, count(*) AS n, sum(words)::BIGINT AS words, sum(hi - lo)::BIGINT AS chars, string_agg(lo || ':' || hi, ',' ORDER BY lo) AS spans,
    list_sort(list_distinct(list(source))) AS sources FROM runs WHERE later GROUP BY doc_id),
passages AS (SELECT doc_id, sum(shared)::BIGINT AS repeated_words, max(run_shared)::BIGINT AS passage_words FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(u.n, 0) AS n_units, coalesce(l.n, 0) AS n_removed, coalesce(l.words, 0) AS removed_words, coalesce(l.chars, 0) AS removed_chars,
  coalesce(l.spans, '') AS spans, coalesce(l.sources, CAST([] AS BIGINT[])) AS sources,
  coalesce(p.repeated_words, 0) AS repeated_words, coalesce(p.passage_words, 0) AS passage_words, coalesce(p.passage_words, 0) >= {PASSAGE_WORDS} AS has_passage
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM units GROUP BY doc_id) u ON u.doc_id = d.doc_id LEFT JOIN lost l ON l.doc_id = d.doc_id
LEFT JOIN passages p ON p.doc_id = d.doc_id"""



def _op12() -> str:
    """The rounds as plain rescans: every part against every entry, each time."""
    parts, scale, rounds = compression.PARTS, compression.SCALE, compression.ROUNDS
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT p.vec_id, p.m, min_by(b.k, [p.xx - 2 * list_inner_product(p.x, b.x) + b.xx, b.k]) AS k, min(p.xx - 2 * list_inner_product(p.x, b.x) + b.xx) AS d
  FROM p JOIN b{r} b ON b.m = p.m GROUP BY p.vec_id, p.m)""")
        if r < rounds:
            steps.append(f"""
u{r} AS (SELECT m, k, list(v ORDER BY i) AS x FROM (
  SELECT a.m, a.k, i, floor(sum(p.x[i]) / count(*)) AS v FROM a{r} a JOIN p ON p.vec_id = a.vec_id AND p.m = a.m, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i) GROUP BY a.m, a.k, i) GROUP BY m, k),
b{r + 1} AS MATERIALIZED (SELECT m, k, x, list_inner_product(x, x) AS xx FROM (SELECT b.m, b.k, coalesce(u.x, b.x) AS x FROM b{r} b LEFT JOIN u{r} u ON u.m = b.m AND u.k = b.k))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor({scale} * CAST(c AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS MATERIALIZED (SELECT vec_id, m, x, list_inner_product(x, x) AS xx FROM (
  SELECT vec_id, m, e[m * (len(e) // {parts}) + 1:(m + 1) * (len(e) // {parts})] AS x FROM (SELECT vec_id, e, unnest(range({parts})) AS m FROM kept))),
b0 AS MATERIALIZED (
  SELECT p.m, s.k, p.x, p.xx FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept QUALIFY k < {compression.ENTRIES}) s JOIN p ON p.vec_id = s.vec_id),
{",".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY m) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda c: CAST(c AS BIGINT)), ','), ',' ORDER BY m, k)) AS h FROM b{rounds})
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY t.label) AS BIGINT) AS label_error, (SELECT h FROM book) AS codebooks_sha256
FROM coded c JOIN kept t ON t.vec_id = c.vec_id"""


def _op13() -> str:
    """Checksums byte by byte, once for each distinct word; a word of other tables than these counts alike."""
    s = Resample()
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), '{up}', '{low}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    byte_step = f"CASE WHEN t & 1 = 1 THEN xor(t >> 1, {POLYNOMIAL}) ELSE t >> 1 END"
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM documents),
mine AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM docs) GROUP BY r, w),
goal AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest({words("text")}) AS w FROM benchmark) GROUP BY w),
tbl AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda t, i: {byte_step}, b)) AS t),
sums AS MATERIALIZED (
  SELECT w, xor(4294967295, list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) % {s.buckets} AS bucket
  FROM (SELECT w, list_transform(range(len(hex(w)) // 2), lambda i: CAST('0x' || hex(w)[2 * i + 1:2 * i + 2] AS BIGINT)) AS bytes FROM (SELECT w FROM mine UNION SELECT w FROM goal)), tbl),
source AS (SELECT bucket, sum(n) AS s FROM mine JOIN sums USING (w) GROUP BY bucket),
target AS (SELECT bucket, sum(n) AS t FROM goal JOIN sums USING (w) GROUP BY bucket),
gains AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM source) + {s.buckets})::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM target) + {s.buckets})::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM sums) b LEFT JOIN source USING (bucket) LEFT JOIN target USING (bucket)),
weights AS (SELECT r, sum(n * gain) AS weight FROM mine JOIN sums USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS MATERIALIZED (
  SELECT d.r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{s.seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM docs d LEFT JOIN weights v ON v.r = d.r),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) OVER () AS n FROM scored WHERE n_features >= {s.least_words})
SELECT doc_id, n_features, weight, score, CASE WHEN k <= {s.percent} * n // 100 THEN k END AS rank FROM scored s LEFT JOIN ranked k ON k.r = s.r"""


OP12 = _op12()
OP13 = _op13()

ORACLES: dict[str, str] = {
    "op1_repetition_quality": OP1,
    "op4_vector_near_dedup": OP4,
    "op5_mix_to_weights": OP5,
    "op8_line_hash_dedup": OP8,
    "op12_vector_codes": OP12,
    "op13_importance_resampling": OP13,
}
