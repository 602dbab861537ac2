"""Quality rules from suffix-array repetition (operator 1)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import slices, utf8

#: A repeat of fewer words is chance or idiom.
MIN_REPEAT_WORDS = 10
#: Largest share of the words that maximal repeats may cover.
MAX_COVERED = 0.30
#: Longest repeat, in words, of a document that is kept.
MAX_LONGEST = 200

#: Bytes of text that share one suffix array; its ranks take some fifty times as much.
SLICE_BYTES = 2 << 20

SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_maximal_repeats long, covered_words long, longest_repeat long"
)


def suffix_array(tokens: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of many token sequences at once and the LCP of each suffix with the one before it.

    tokens: ids, doc: the sequence of each token, not descending. Suffixes are grouped by sequence and end with it, so no
    LCP crosses sequences. Prefix doubling; after the first sort only suffixes that still share their prefix are sorted.
    """
    n = len(tokens)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = doc.astype(np.int64) * (int(tokens.max()) + 1) + tokens
    order = np.argsort(first, kind="stable")
    head = np.flatnonzero(np.diff(first[order], prepend=first[order[0]] - 1))
    sizes = np.diff(head, append=n)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(head, sizes)
    rank[n] = -1
    ends = np.flatnonzero(np.diff(doc, append=doc[-1] + 1)) + 1
    end = np.repeat(ends, np.diff(ends, prepend=0))
    levels, step = [(1, rank.copy())], 1
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while len(slots):
        at = order[slots]
        to = at + step
        key = rank[at] * (n + 2) + np.where(to < end[at], rank[np.minimum(to, n)], -1) + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        new = np.diff(key, prepend=key[0] - 1) != 0
        starts = np.flatnonzero(new)
        group = np.diff(starts, append=len(at))
        rank[at] = np.repeat(slots[starts], group)
        step *= 2
        levels.append((step, rank.copy()))
        slots = slots[np.repeat(group > 1, group)]
    lcp = np.zeros(n, np.int64)
    near = np.flatnonzero(levels[0][1][order[1:]] == levels[0][1][order[:-1]]) + 1
    i, j, got = order[near], order[near - 1], np.zeros(len(near), np.int64)
    for step, ranks in reversed(levels):
        same = (ranks[i] == ranks[j]) & (i < n) & (j < n)
        got += step * same
        i, j = i + step * same, j + step * same
    lcp[near] = got
    return order, lcp


def lcp_intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First suffix, last suffix and length of each LCP interval of at least that length, whose suffixes share exactly that
    many tokens, and for each place of lcp the number of the interval whose length it is (-1 below the least)."""
    first: list[int] = []
    last: list[int] = []
    length: list[int] = []
    own = np.full(len(lcp), -1, np.int64)
    long = np.flatnonzero(lcp >= least)
    for run in np.split(long, np.flatnonzero(np.diff(long) > 1) + 1) if len(long) else ():
        stack: list[int] = []
        inside = []
        for r, n in zip(run.tolist(), lcp[run].tolist()):
            start = r - 1
            while stack and length[stack[-1]] > n:
                k = stack.pop()
                last[k], start = r - 1, first[k]
            if not stack or length[stack[-1]] < n:
                stack.append(len(first))
                first.append(start)
                last.append(r)
                length.append(n)
            inside.append(stack[-1])
        for k in stack:
            last[k] = int(run[-1])
        own[run] = inside
    return np.array(first, np.int64), np.array(last, np.int64), np.array(length, np.int64), own


def maximal_repeats(order: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First suffix and length of each maximal repeat of least tokens or more, and (place, length) spans with the same
    union as all of their occurrences.

    A repeat is an LCP interval, which no word lengthens to the right; it is maximal if the tokens before its occurrences
    (before, by suffix) differ, so that none lengthens it to the left. A suffix gives the span of the innermost interval
    alone: the others are shorter. If that one isn't maximal, the repeat that has a word more before it covers the span.
    """
    first, last, length, own = lcp_intervals(lcp, least)
    turns = np.cumsum(np.append(0, before[1:] != before[:-1])) if len(before) else before
    maximal = turns[last] > turns[first]
    after = np.append(lcp[1:], 0)
    inner = np.where(lcp >= after, own, np.append(own[1:], -1))
    at = np.flatnonzero(inner >= 0)
    at = at[maximal[inner[at]]]
    return first[maximal], length[maximal], order[at], length[inner[at]]


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[bytes], min_repeat: int = MIN_REPEAT_WORDS) -> dict[str, np.ndarray]:
    """The counts of each text; all texts share one suffix array."""
    words = [t.split() for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    total = int(n_words.sum())
    ids: defaultdict[bytes, int] = defaultdict(count().__next__)
    tokens = np.fromiter((ids[w] for w in chain.from_iterable(words)), np.int64, total)
    doc = np.repeat(np.arange(len(texts)), n_words)
    order, lcp = suffix_array(tokens, doc)
    deepest = np.zeros(total, np.int64)
    deepest[order] = np.maximum(lcp, np.append(lcp[1:], 0)) if total else lcp

    def by_doc(flags: np.ndarray) -> np.ndarray:
        return np.bincount(doc, flags, len(texts)).astype(np.int64)

    windows = np.flatnonzero(deepest >= 3)
    # The start of a text differs from all words.
    before = np.where(np.diff(doc, prepend=-1) != 0, -1 - np.arange(total), np.append(-1, tokens)[:total])[order]
    first, lengths, at, span = maximal_repeats(order, lcp, before, min_repeat)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc[order[first]], lengths)
    return {
        "n_words": n_words,
        "word_chars": np.array([sum(map(len, w)) - _continuations(t) for t, w in zip(texts, words)], np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([_dup_lines(t) for t in texts], np.int64),
        "n_repeat_words": by_doc(covered(windows, np.full(len(windows), 3), total)),
        "n_maximal_repeats": np.bincount(doc[order[first]], minlength=len(texts)),
        "covered_words": by_doc(covered(at, span, total)),
        "longest_repeat": longest,
    }


_CONTINUATION = bytes(range(0x80, 0xC0))


def _continuations(text: bytes) -> int:
    return len(text) - len(text.translate(None, _CONTINUATION))


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\f\r")]
    return len(lines) - len(set(lines))


def base_failed(n_words, n_repeat_words):
    """Whether counts (columns or arrays) fail the base rules: too few words, or too many in repeated windows."""
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def within_limits(n_words, covered_words, longest_repeat, max_covered: float, max_longest: int):
    """Whether counts (columns or arrays) keep to the limits of maximal repeats."""
    return (covered_words <= max_covered * n_words) & (longest_repeat <= max_longest)


def repetition_quality(
    docs: DataFrame,
    min_repeat: int = MIN_REPEAT_WORDS,
    max_covered: float = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """Counts of every document, base_failed, covered_fraction and kept.

    Per document a suffix array over its words and the LCP intervals give the maximal repeated word sequences of
    min_repeat words or more; the union of their occurrences is covered_words. A document is kept if it isn't
    base_failed, at most max_covered of its words are covered and its longest repeat has at most max_longest words.

    A null or empty text has no words: all counts 0, base_failed, not kept. Repeated rows are measured each; a null doc_id
    stays null; other columns are ignored; an empty table gives an empty result. A long text is a slice of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_bytes=SLICE_BYTES):
            counts = measure(part.column("text").to_pylist(), min_repeat)
            yield pa.RecordBatch.from_arrays([pc.cast(part.column("doc_id"), pa.int64()), *map(pa.array, counts.values())], names=["doc_id", *counts])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(run, SCHEMA)
    return (
        rows.withColumn("covered_fraction", F.coalesce(F.try_divide("covered_words", "n_words"), F.lit(0.0)))
        .withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
        .withColumn("kept", ~F.col("base_failed") & within_limits(F.col("n_words"), F.col("covered_words"), F.col("longest_repeat"), max_covered, max_longest))
    )


def keep_quality(docs: DataFrame, min_repeat: int = MIN_REPEAT_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The documents that repetition_quality keeps, with all their columns.

    The text stays with its row: the verdict is computed beside it and no shuffle follows.
    """
    fields = docs.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            binary = pa.RecordBatch.from_arrays([pc.fill_null(batch.column("text").cast(pa.binary()), b"")], names=["text"])
            kept = []
            for part in slices(iter([binary]), max_bytes=SLICE_BYTES):
                c = measure(part.column("text").to_pylist(), min_repeat)
                base = base_failed(c["n_words"], c["n_repeat_words"])
                kept.append(~base & within_limits(c["n_words"], c["covered_words"], c["longest_repeat"], max_covered, max_longest))
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept))).select(fields)

    return docs.mapInArrow(run, docs.schema)
