"""Operators 11 to 13 against brute force, on odd rows, ties, repeated rows and empty tables."""

from __future__ import annotations

import base64
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm.odd import PROSE, odd_docs
from tests.oracle import connect, differences
from tidegauge.llm import byte_bpe, compression, queries, resampling
from tidegauge.llm.oracles import ORACLES

SMALL = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def odd(spark):
    return odd_docs(spark).cache()


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


# 11: byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as f:
        return byte_bpe.Ranks(f.read())


def test_byte_bpe(spark, odd, small, library):
    for docs in (odd, small):
        rows = byte_bpe.encode_bytes(docs, RANKS, public_tokenizers.PATTERN, full=True).collect()
        want = []
        for r in docs.collect():
            ids = library.encode_ordinary(r["text"] or "")
            want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r["text"] or "").encode()), ids, (r["text"] or "").encode()))
        got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], list(r["ids"]), bytes(r["decoded"])) for r in rows]
        assert sorted(got, key=str) == sorted(want, key=str)
    empty = byte_bpe.encode_bytes(odd.limit(0), RANKS, public_tokenizers.PATTERN)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_chunks_change_nothing(ranks, library):
    random.seed(5)
    letters = list("abcdeABC  \n\t'strelvm0123.,!?-_　\xa0\x85\x1c\x1f​中文\U0001f600é́")
    by_chunk = byte_bpe.Encoder(ranks, byte_bpe.Splitter(public_tokenizers.PATTERN), {})
    whole = byte_bpe.Encoder(ranks, byte_bpe.Splitter(public_tokenizers.PATTERN, None), {}, memo=10)
    texts = ["".join(random.choices(letters, k=random.randrange(60))) for _ in range(3000)] + ["x" * 50_000, " " * 9_000 + "a", "\n" * 999, "  a", "a  "]
    got = by_chunk(texts)
    assert [x for i in range(0, len(texts), 100) for x in whole(texts[i : i + 100])] == got
    assert [[int(x) for x in ids.split()] for _, ids, _ in got] == [library.encode_ordinary(t) for t in texts]
    assert [d.decode() for _, _, d in got] == texts


@pytest.mark.parametrize("together", [1, 24])
def test_replay_is_the_definition_also_where_a_merge_makes_a_lower_rank(monkeypatch, together):
    monkeypatch.setattr(byte_bpe, "TOGETHER", together)
    random.seed(7)
    for trial in range(60):
        tokens = {"".join(random.choices("abc", k=random.randrange(2, 6))).encode() for _ in range(random.randrange(3, 40))}
        names = [*(bytes([b]) for b in range(256)), *random.sample(sorted(tokens), len(tokens))]
        own = byte_bpe.Ranks(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(names)))
        words = ["".join(random.choices("abc", k=random.randrange(0, 30))).encode() for _ in range(200)] + [b"a" * 60, b"ab" * 40]
        for w, ids in zip(words, own.replay(words)):
            assert ids == ([own.rank[w]] if w in own.rank else own.encode_alone(w)), (trial, w)
            assert own.decode(ids) == w


def test_shared_words_keep_their_bound(spark, small, ranks):
    docs = small.select(small.text.cast("binary").alias("text")).repartition(6)
    data = byte_bpe.ship(spark, RANKS)
    every = byte_bpe.shared_words(docs, data, public_tokenizers.PATTERN, byte_bpe.CHUNKS)
    assert every and all(ids == ranks.replay([w.encode()])[0] for w, ids in every.items())
    some = byte_bpe.shared_words(docs, data, public_tokenizers.PATTERN, byte_bpe.CHUNKS, most=len(every) - 1)
    assert len(some) < len(every) and some.items() <= every.items()
    assert byte_bpe.shared_words(docs, data, public_tokenizers.PATTERN, byte_bpe.CHUNKS, most=0) == {}


# 12: vector codes


def codes_by_force(rows, parts=16, entries=64, rounds=2):
    kept = [(i, lab, [math.floor(256 * float(c)) for c in v]) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept or not kept[0][2] or len(kept[0][2]) % parts:
        return []
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    w = len(kept[0][2]) // parts
    cut = [[r[2][m * w : m * w + w] for m in range(parts)] for r in kept]
    book = [[list(c[m]) for c in cut[:entries]] for m in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for again in range(rounds + 1):
        codes = [[min((far(c[m], e), k) for k, e in enumerate(book[m])) for m in range(parts)] for c in cut]
        if again < rounds:
            for m in range(parts):
                for k in range(len(book[m])):
                    own = [c[m] for c, code in zip(cut, codes) if code[m][1] == k]
                    if own:
                        book[m][k] = [sum(x) // len(own) for x in zip(*own)]
    digest = sha(",".join(str(x) for m in book for e in m for x in e).encode())
    errors = [sum(d for d, _ in code) for code in codes]
    of = Counter()
    for (_, lab, _), e in zip(kept, errors):
        of[lab] += e
    return [(i, "".join(f"{k:02x}" for _, k in code), e, of[lab], digest) for (i, lab, _), code, e in zip(kept, codes, errors)]


VECTORS = "vec_id long, embedding array<float>, label int, code string, x string, dist string"


def coded(df):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()), key=str)


def test_vector_codes(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 32)) / 4
    rows = [(i, [float(x) for x in np.float32(centres[i % 9] + rng.normal(size=32) / (3 if i % 5 else 40))], None if i % 7 == 0 else i % 3) for i in range(300)]
    rows += [(i, rows[0][1], 1) for i in range(300, 420)]  # copies
    rows += [(5, rows[9][1], 2), (5, rows[9][1], 2), (None, rows[3][1], 0)]
    rows += [(500, None, 1), (501, [None] * 32, 1), (502, [float("nan")] * 32, 1), (503, [float("inf")] + [0.0] * 31, 1), (504, [], 1), (505, [1.0] * 16, 1), (506, [0.0] * 32, 1), (507, [-0.001] * 32, None)]
    rows += [(508 + i, [float(v)] * 32, 1) for i, v in enumerate((0.125, -0.125, 3.0, -3.0))]  # ties
    random.seed(2)
    random.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], VECTORS).repartition(5)
    assert coded(compression.compress_vectors(df)) == sorted(codes_by_force(rows), key=str)
    few = [r for r in rows if r[0] is not None and r[0] < 20]
    assert coded(compression.compress_vectors(spark.createDataFrame(few, "vec_id long, embedding array<float>, label int"))) == sorted(codes_by_force(few), key=str)
    assert coded(compression.compress_vectors(df, parts=8, entries=5, rounds=6)) == sorted(codes_by_force(rows, 8, 5, 6), key=str)
    for nothing in ([], [(1, [1.0] * 15, 1)], [(1, None, 1)]):
        assert compression.compress_vectors(spark.createDataFrame(nothing, "vec_id long, embedding array<float>, label int")).count() == 0
    huge = [(i, [3e38 * (-1) ** i] * 16, 1) for i in range(70)]
    assert compression.compress_vectors(spark.createDataFrame(huge, "vec_id long, embedding array<float>, label int")).count() == 70


def test_only_active_entries_are_compared(monkeypatch):
    """A part whose entry stayed meets moved entries alone and ends where a whole rescan ends, ties included."""
    rng = np.random.default_rng(8)
    x = rng.integers(-3, 4, (500, 2))
    before = rng.integers(-3, 4, (12, 2))
    code, dist = compression.nearest(x, before, np.arange(12))
    after = before.copy()
    after[[2, 7]] += [[1, 0], [0, -1]]
    moved = (after != before).any(axis=1)
    seen = []
    plain = compression.nearest
    monkeypatch.setattr(compression, "nearest", lambda x, b, e: seen.append((len(x), e.tolist())) or plain(x, b, e))
    got = compression.reassign(x, after, moved, code, dist)
    want = plain(x, after, np.arange(12))
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    lost = int(np.isin(code, [2, 7]).sum())
    assert seen == [(500 - lost, [2, 7]), (lost, list(range(12)))]


# 13: importance resampling

WORD13 = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features_by_force(text, n_max):
    w = WORD13.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, n_max + 1) for i in range(len(w) - n + 1)]


def drawn_by_force(docs, goal, spec):
    bucket = lambda f: zlib.crc32(f.encode()) % spec.buckets
    found = [(d, *features_by_force(t, spec.words)) for d, t in docs]
    s = Counter(bucket(f) for _, _, fs in found for f in fs)
    t = Counter(bucket(f) for x in goal for f in features_by_force(x, spec.words)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + spec.buckets) / ((s[b] + 1) * (n_t + spec.buckets))))
    rows = []
    for d, n, fs in found:
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(sha(f"{spec.seed}:{'null' if d is None else d}".encode())[:8], 16)
        rows.append([d, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= spec.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], -r[2]))
    place = {id(r): k for k, r in enumerate(able[: spec.percent * len(able) // 100], 1)}
    return sorted(((r[0], *r[2:], place.get(id(r))) for r in rows), key=str)


def test_position_crc():
    random.seed(3)
    for depth in (1, 3, 64):
        crc = resampling.PositionCrc(depth)
        spans = [random.randbytes(n) for n in (*range(1, 200), 64, 65, 128, 4096, 10_001, 1)]
        text = np.frombuffer(b" ".join(spans), np.uint8)
        size = np.array([len(s) for s in spans])
        start = np.cumsum(size + 1) - size - 1
        assert crc(text, start, size).tolist() == [zlib.crc32(s) for s in spans]
        over = np.array([0, 5, 2, 0]), np.array([len(text), 40, 1, 3])  # spans may overlap
        assert crc(text, *over).tolist() == [zlib.crc32(text[a : a + n].tobytes()) for a, n in zip(*over)]


def test_resampling(spark, odd, small, monkeypatch):
    monkeypatch.setattr(resampling, "SPAN_BYTES", 1000)
    goal = spark.createDataFrame([(PROSE,), (None,), ("The Wise OWLS é中 7",), ("",)], "text string")
    for docs in (odd, small):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        for spec in (resampling.Resample(), resampling.Resample(words=3, buckets=50, percent=40, least_words=2, seed=7)):
            got = resampling.resample_documents(docs, goal, spec)
            assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
            assert sorted((tuple(r) for r in got.collect()), key=str) == drawn_by_force(rows, [r["text"] for r in goal.collect()], spec)
    assert resampling.resample_documents(odd.limit(0), goal).count() == 0
    none = resampling.resample_documents(small, goal.limit(0))
    assert sorted((tuple(r) for r in none.collect()), key=str) == drawn_by_force([(r["doc_id"], r["text"]) for r in small.collect()], [], resampling.Resample())
    some = resampling.drawn_documents(odd, goal, resampling.Resample(percent=50))
    assert some.columns == odd.columns and 0 < some.count() < odd.count()


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_importance_resampling"])
def test_new_oracles(spark, name):
    assert differences(queries.QUERIES[name](spark, SMALL).toPandas(), connect(SMALL).execute(ORACLES[name]).fetchdf()) == ""


# 4: vectors of many dimensions


def test_vectors_without_replicas(spark, monkeypatch):
    """Nearly orthogonal vectors had a replica in most of a label's cells, all of which were stored."""
    from urllib.parse import urlparse

    from tidegauge.llm import vectors
    from tidegauge.llm.common import checkpoint_dir

    monkeypatch.setattr(vectors, "CELL_ROWS", 100)
    monkeypatch.setattr(vectors, "CHUNK_ROWS", 100)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    x[1000:1300] = x[7] + rng.normal(size=(300, 64)) * rng.uniform(0.02, 0.3, (300, 1))  # one large group, and pairs around the limit
    x[1300:1700] = x[:400] + rng.normal(size=(400, 64)) * rng.uniform(0.1, 0.3, (400, 1))
    x[1700:1710] = -x[7]
    x = x.astype(np.float32)
    label = np.where(np.arange(3000) % 5, 1, 2)
    df = spark.createDataFrame([(k, v, int(c)) for k, (v, c) in enumerate(zip(x.tolist(), label))], "vec_id long, embedding array<float>, label int")
    folder = urlparse(checkpoint_dir(spark)).path
    held = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(folder) for f in names)
    before = held()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.vector_components(df).collect()}
    assert held() - before < 3 * x.nbytes
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = (u @ u.T >= 0.98) & (label[:, None] == label)
    low = np.arange(3000)
    while not np.array_equal(low, new := np.where(near, low[None, :], 3000).min(axis=1)):
        low = new
    assert got == {k: (int(near[k].sum()) - 1, int(low[k])) for k in range(3000)}
    assert 200 < (near.sum(axis=1) > 1).sum() < 2000
