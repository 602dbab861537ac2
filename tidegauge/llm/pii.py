"""Personal data by patterns and a skip-chain conditional random field (operator 9)."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import slices, utf8

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: The field is fitted on some FIT_DOCS documents, chosen by a seeded hash, and on at most FIT_TOKENS of their tokens, the
#: first in the order of a seeded hash. What reaches the driver doesn't grow with the corpus.
FIT_DOCS = 50_000
FIT_TOKENS = 20_000
SEED = 17
#: A token is added to the spans if its label has at least this marginal.
LEAST_MARGINAL = 0.9
SWEEPS = 12

# Each pattern is tried where a leftmost match can begin: a run of digits that fails from its start fails from within.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_ANY = re.compile(r"[0-9@+]")
_EDGES = "\"'`()[]{}<>,;:.!?$%#&*|"

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done = last = 0
    at = text.find("@")
    while at >= 0:
        head = text[max(done, last) : at]
        start = at - (len(head) - len(head.rstrip(_LOCAL)))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, 0, m.end()
            done = m.end()
        last = at + 1
        at = text.find("@", last)


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base matches, by start, then kind."""
    found = list(_emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


FEATURES = (
    "bias", "at", "at_dot", "dots_0", "dots_1_2", "dots_3", "dots_4+", "dash", "slash", "letters", "letters_many", "upper", "plus", "paren",
    "digits_0", "digits_1_2", "digits_3", "digits_4_6", "digits_7_8", "digits_9_11", "digits_12_15", "digits_16_19", "digits_20+",
    "luhn", "octets", "before_plus", "before_paren", "after_paren", "before_digits", "after_digits", "equals",
)
_AT = {f: i for i, f in enumerate(FEATURES)}


def _shape(token: str, before: str, after: str) -> list[int]:
    """The places of the features that a token has."""
    digits = _digits(token)
    n, dots = len(digits), token.count(".")
    letters = sum(c.isalpha() for c in token)
    size = next(name for most, name in ((0, "0"), (2, "1_2"), (3, "3"), (6, "4_6"), (8, "7_8"), (11, "9_11"), (15, "12_15"), (19, "16_19"), (1 << 60, "20+")) if n <= most)
    on = ["bias", f"digits_{size}", "dots_0" if not dots else "dots_1_2" if dots < 3 else "dots_3" if dots == 3 else "dots_4+"]
    on += [name for name, yes in (
        ("at", "@" in token), ("at_dot", "." in token.partition("@")[2]), ("dash", "-" in token), ("slash", "/" in token),
        ("letters", letters > 0), ("letters_many", letters > 3), ("upper", token.isupper()), ("plus", token[:1] == "+"), ("paren", "(" in token),
        ("luhn", 12 <= n <= 19 and letters == 0 and luhn(digits)),
        ("octets", dots == 3 and all(p.isdecimal() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in token.split("."))),
        ("before_plus", before[:1] == "+"), ("before_paren", before[:1] == "("), ("after_paren", after[:1] == "("),
        ("before_digits", bool(_digits(before))), ("after_digits", bool(_digits(after))), ("equals", "=" in token),
    ) if yes]
    return [_AT[f] for f in on]


@dataclass
class Graph:
    """Candidate tokens of many texts: their spans, features, base labels, and the pairs that share a potential."""

    text: list[int]
    span: list[tuple[int, int]]
    features: list[list[int]]
    label: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def _key(token: str) -> list[str]:
    """What similar tokens have in common: the letters and digits in lower case; for long numbers also the last digits."""
    plain = "".join([c for c in token.lower() if c.isalnum()])
    digits = _digits(token)
    return [plain] + [f"#{digits[-7:]}"] * (len(digits) >= 7 and len(digits) == len(plain))


def build_graph(texts: list[str], spans: list[list[Span]]) -> Graph:
    """Nodes are the tokens with a digit or an at sign. Neighbours in the text share a chain potential, and each token
    shares a skip potential with the previous token that repeats or resembles it, however far; links grow with the tokens."""
    g = Graph([], [], [], [], [], [])
    for t, (text, base) in enumerate(zip(texts, spans)):
        if not _ANY.search(text):
            continue
        tokens = [(m.start(), m.group()) for m in _TOKEN.finditer(text)]
        seen: dict[str, int] = {}
        last, at = -9, 0
        for k, (start, token) in enumerate(tokens):
            bare = token.strip(_EDGES.replace("(", "") if "(" in token and ")" in token else _EDGES)
            if not bare or not any("0" <= c <= "9" or c == "@" for c in bare):
                continue
            low = start + token.index(bare)
            high = low + len(bare)
            node = len(g.text)
            while at < len(base) and base[at][2] <= low:
                at += 1
            hit = next((s for s in base[at : at + 4] if s[0] < high and low < s[2]), None)
            g.text.append(t)
            g.span.append((low, high))
            g.features.append(_shape(bare, tokens[k - 1][1] if k else "", tokens[k + 1][1] if k + 1 < len(tokens) else ""))
            g.label.append(1 + hit[1] if hit else 0)
            if k - last == 1:
                g.chain.append((node - 1, node))
            last = k
            for key in _key(bare):
                if (other := seen.get(key)) is not None and other != node:
                    g.skip.append((other, node))
                seen[key] = node
    return g


@dataclass
class Field:
    """Log potentials: features x labels, chain pairs, skip pairs."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def fit_field(features: list[list[int]], labels: list[int], before: list[int], similar: list[int], steps: int = 300, rate: float = 1.0) -> Field:
    """Node weights by a softmax regression, pair potentials by smoothed log odds of the label pairs.

    before: the label of the chain neighbour before each token, similar: of its skip neighbour; -1 for none.
    """
    n, k = len(labels), len(LABELS)
    x = np.zeros((n, len(FEATURES)))
    for i, f in enumerate(features):
        x[i, f] = 1
    y = np.eye(k)[labels] if n else np.zeros((0, k))
    w = np.zeros((len(FEATURES), k))
    speed = np.zeros_like(w)
    for _ in range(steps if n else 0):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed + x.T @ (y - p) / n - 1e-4 * w
        w += rate * speed

    def odds(other: list[int], prior: float) -> np.ndarray:
        c = np.full((k, k), 0.5) + prior * np.eye(k)
        pairs = [(a, b) for a, b in zip(other, labels) if a >= 0]
        for a, b in pairs:
            c[a, b] += 1
            c[b, a] += 1
        joint = c / c.sum()
        return np.log(joint) - np.log(joint.sum(1, keepdims=True)) - np.log(joint.sum(0, keepdims=True))

    return Field(w, np.clip(odds(before, 0.5), -3, 3), np.clip(odds(similar, 20.0), -6, 6))


def marginals(g: Graph, field: Field, sweeps: int = SWEEPS) -> np.ndarray:
    """Label probabilities of every token by damped loopy message passing; base matches are held at their label."""
    n, k = len(g.text), len(LABELS)
    unary = np.stack([field.node[f].sum(axis=0) for f in g.features]) if n else np.zeros((0, k))
    held = np.array(g.label, np.int64)
    unary[held > 0] = -12.0
    unary[held > 0, held[held > 0]] = 0.0
    unary -= unary.max(axis=1, keepdims=True) if n else 0
    pairs = np.array([*g.chain, *g.skip], np.int64).reshape(-1, 2)
    m = len(pairs)
    potential = np.concatenate([np.broadcast_to(field.chain, (len(g.chain), k, k)), np.broadcast_to(field.skip, (len(g.skip), k, k))])
    source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    message = np.zeros((2 * m, k))
    belief = unary
    for _ in range(sweeps if m else 0):
        into = belief[source] - message[back]
        new = np.logaddexp.reduce(potential + into[:, :, None], axis=1)
        new -= new.max(axis=1, keepdims=True)
        message = 0.5 * message + 0.5 * new
        belief = unary.copy()
        np.add.at(belief, target, message)
    p = np.exp(belief - belief.max(axis=1, keepdims=True)) if n else belief
    return p / p.sum(axis=1, keepdims=True) if n else p


def fit_on(docs: DataFrame, sample_docs: int = FIT_DOCS, most: int = FIT_TOKENS, seed: int = SEED) -> Field:
    """The field, fitted on at most `most` candidate tokens of some sample_docs documents, labelled by the base patterns.

    Both samples follow seeded hashes of doc_id and of the token's place, so they don't depend on partitions.
    """
    grain = 1_000_000_000
    share = min(grain, math.ceil(grain * sample_docs / max(1, docs.count())))
    chosen = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), F.lit(grain)) < share

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [t.decode("utf-8", "replace") for t in part.column("text").to_pylist()]
            g = build_graph(texts, [base_spans(t) for t in texts])
            before, similar = [-1] * len(g.text), [-1] * len(g.text)
            for a, b in g.chain:
                before[b] = g.label[a]
            for a, b in g.skip:
                similar[b] = g.label[a]
            ids = part.column("doc_id").to_pylist()
            columns = [pa.array([ids[t] for t in g.text], pa.int64()), pa.array([s for s, _ in g.span], pa.int64()), pa.array(g.features, pa.list_(pa.int32()))]
            columns += [pa.array(c, pa.int32()) for c in (g.label, before, similar)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "features", "label", "before", "similar"])

    rows = docs.where(chosen & F.col("text").rlike("[0-9@]")).select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    found = rows.mapInArrow(tokens, "doc_id long, start long, features array<int>, label int, before int, similar int")
    sample = found.orderBy(F.xxhash64(F.lit(seed), "doc_id", "start"), "doc_id", "start", F.col("features").cast("string")).limit(most).collect()
    return fit_field([r["features"] for r in sample], *([r[c] for r in sample] for c in ("label", "before", "similar")))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k] if k < len(KINDS) else 'crf_' + KINDS[k - len(KINDS)]}:{s}:{e}" for s, k, e in spans)


def added_spans(g: Graph, p: np.ndarray, base: list[list[Span]], least: float) -> list[list[Span]]:
    """Per text, the tokens that the field labels with confidence and no base span overlaps, as kinds crf_*."""
    out: list[list[Span]] = [[] for _ in base]
    best = p.argmax(axis=1) if len(p) else np.zeros(0, np.int64)
    for i in np.flatnonzero((best > 0) & (np.array(g.label) == 0)) if len(p) else ():
        if p[i, best[i]] >= least:
            out[g.text[i]].append((g.span[i][0], len(KINDS) + int(best[i]) - 1, g.span[i][1]))
    return out


def find_personal_data(docs: DataFrame, field: Field | None = None, least: float = LEAST_MARGINAL) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added of every row.

    Base spans come from the patterns. The field then labels the tokens with digits or at signs of each document: base
    matches are held, distant tokens that repeat or resemble each other share potentials, and confident labels outside base
    spans are added as kinds crf_email, crf_ip, crf_card and crf_phone. Without a field, one is fitted on docs.

    Null and empty texts have no spans (base_sha256 of the empty string). Repeated rows are scanned each; a null doc_id stays
    null; other columns are ignored; an empty table gives an empty result. Documents are independent: there is no shuffle.
    """
    field = field or fit_on(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [t.decode("utf-8", "replace") for t in part.column("text").to_pylist()]
            base = [base_spans(t) if _ANY.search(t) else [] for t in texts]
            g = build_graph(texts, base)
            added = added_spans(g, marginals(g, field), base, least)
            counts = [[sum(s[1] == k for s in b) for b in base] for k in range(len(KINDS))]
            sha = [hashlib.sha256(_said(b).encode()).hexdigest() for b in base]
            spans = [_said(sorted(b + a)) for b, a in zip(base, added)]
            columns = [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(list(map(len, added)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(run, SCHEMA)
