"""Target-distribution importance resampling over hashed features (operator 13)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, slices, utf8

#: The reflected polynomial of CRC-32, and the longest distance from a feature's end in the position table.
POLYNOMIAL = 0xEDB88320
DEPTH = 64
#: Bytes of features whose contributions are held at a time.
SPAN_BYTES = 1 << 20


@dataclass(frozen=True)
class Resample:
    """Features are runs of 1 to `words` consecutive words; `percent` of the documents of least_words or more are drawn."""

    words: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: int = 2024


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


class PositionCrc:
    """CRC-32 of many byte spans at once.

    CRC-32 is linear: the checksum of a span is the XOR of a contribution for each byte, which depends on the byte and its
    distance from the span's end, and of a constant for the length. `table[d, b]` is the contribution of byte b at distance
    d, `zeros[n]` the register after n zero bytes. A span longer than the table is folded block by block: a step
    moves the register over a whole block of zeros (four lookups) and XORs the block's contributions.
    """

    def __init__(self, depth: int = DEPTH):
        byte = _byte_table()
        self.depth = depth
        table, zeros = [byte], [np.uint32(0xFFFFFFFF)]
        for _ in range(depth - 1):
            table.append((table[-1] >> 8) ^ byte[table[-1] & 255])
        for _ in range(depth):
            zeros.append((zeros[-1] >> np.uint32(8)) ^ byte[zeros[-1] & 255])
        self.table, self.zeros = np.concatenate(table), np.array(zeros, np.uint32)
        moved = [np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)]
        for _ in range(depth):
            moved = [(m >> np.uint32(8)) ^ byte[m & 255] for m in moved]
        self.over = moved

    def _contributions(self, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The XOR of the contributions of text[start : start + size], each at most depth bytes and none empty."""
        ends = np.cumsum(size)
        first = ends - size
        at = np.arange(ends[-1])
        place = at + np.repeat(start - first, size)
        distance = np.repeat(ends - 1, size) - at
        return np.bitwise_xor.reduceat(self.table[(distance << 8) | text[place]], first)

    def _over_block(self, register: np.ndarray) -> np.ndarray:
        a, b, c, d = self.over
        return a[register & 255] ^ b[(register >> 8) & 255] ^ c[(register >> 16) & 255] ^ d[register >> 24]

    def __call__(self, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The unsigned checksums of the spans of a byte array; none is empty."""
        register = np.empty(len(start), np.uint32)
        # The first block of a span has what is left over, one byte at least; all that follow are whole.
        head = (size - 1) % self.depth + 1
        cuts = np.flatnonzero(np.diff(np.cumsum(head) // SPAN_BYTES, prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(start)]):
            register[lo:hi] = self._contributions(text, start[lo:hi], head[lo:hi]) ^ self.zeros[head[lo:hi]]
        done, open_ = head.copy(), np.flatnonzero(size > head)
        while len(open_):
            block = self._contributions(text, (start + done)[open_], np.full(len(open_), self.depth))
            register[open_] = self._over_block(register[open_]) ^ block
            done[open_] += self.depth
            open_ = open_[done[open_] < size[open_]]
        return register ^ np.uint32(0xFFFFFFFF)


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Bytes after A-Z became a-z, and which bytes belong to words: digits, letters and all of characters beyond ASCII."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[128:] = True
    return lower, word


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts, lower-cased in A-Z, in a byte array where one blank follows each; their starts, sizes and texts."""
    lower, is_word = _byte_classes()
    sizes = np.asarray(pc.binary_length(texts), np.int64)
    body = b"\n".join([*texts.to_pylist(), b""])
    raw = lower[np.frombuffer(body, np.uint8)]
    inside = is_word[raw]
    begins = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    ends = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
    size = ends - begins
    row = np.searchsorted(np.cumsum(sizes + 1), begins, side="right")
    # What separates words, of any length, becomes the one byte behind each word.
    keep = inside.copy()
    keep[ends] = True
    raw[ends] = 32
    start = np.cumsum(size + 1) - size - 1
    return raw[keep], start, size, row


def feature_buckets(texts: pa.Array, crc: PositionCrc, words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket and text of every feature of the texts, and the number of words of every text."""
    text, start, size, row = word_spans(texts)
    n_words = np.bincount(row, minlength=len(texts))
    found, rows = [], []
    for n in range(1, words + 1):
        first = np.arange(max(0, len(start) - n + 1))
        last = first + n - 1
        same = row[first] == row[last]
        first, last = first[same], last[same]
        if len(first):
            found.append(crc(text, start[first], start[last] + size[last] - start[first]) % np.uint32(buckets))
            rows.append(row[first])
    return np.concatenate(found or [np.zeros(0, np.uint32)]).astype(np.int64), np.concatenate(rows or [np.zeros(0, np.int64)]), n_words


def bucket_counts(texts: DataFrame, spec: Resample = Resample()) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task gives its sums; one number a bucket is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, total = PositionCrc(), np.zeros(spec.buckets, np.int64)
        for part in slices(batches, max_bytes=1 << 20):
            total += np.bincount(feature_buckets(part.column("text"), crc, spec.words, spec.buckets)[0], minlength=spec.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counted = texts.select(utf8().alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(spec.buckets, np.int64)
    for r in counted.collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of each bucket, counted in both corpora."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh_documents(docs: DataFrame, gains: np.ndarray, spec: Resample = Resample()) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of the gains of its features, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = PositionCrc()
        for part in slices(batches, max_bytes=1 << 20):
            bucket, row, n_words = feature_buckets(part.column("text"), crc, spec.words, spec.buckets)
            # Sums of integers in doubles: exact below 2**53.
            weight = np.bincount(row, gains[bucket], part.num_rows).astype(np.int64)
            columns = [part.column("doc_id"), pa.array(n_words), pa.array(np.bincount(row, minlength=part.num_rows)), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def with_scores(weighed: DataFrame, seed: int) -> DataFrame:
    """The rows with score: weight and a Gumbel term of the doc_id's hash, in thousandths."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def draw(scored: DataFrame, spec: Resample = Resample()) -> DataFrame:
    """scored with rank: 1, 2, 3... for the drawn rows, by falling score and rising doc_id, null for the others.

    Candidates are dealt out by range of that order, so the k-th range holds what comes before the next; places inside a
    range and the sizes of the ranges before it give the ranks. No task holds more than a range. scored must be
    materialised, for it is read three times.
    """
    able = F.col("n_words") >= spec.least_words
    wanted = scored.where(able).count() * spec.percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    dealt = cut(scored.where(able).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    place = (F.col("_before") + inside).cast("long")
    ranked = dealt.join(before, "_part").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.drop("_part", "_before").unionByName(rest)


def resample_documents(docs: DataFrame, target: DataFrame, spec: Resample = Resample()) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs(doc_id, text), for the target's distribution of features.

    A word is a run of digits, letters and characters beyond ASCII, with A-Z in lower case. Features are counted over all
    rows of docs and of target(text); a bucket's gain is the log ratio of its smoothed shares, in thousandths.

    Null and empty texts have no features and weight 0. Rows of one doc_id have one random term and are weighed each; a
    null doc_id has the term of `null` and comes last among ties; rows that agree in all columns are interchangeable.
    Other columns are ignored. An empty docs table gives an empty result, an empty target one count for each bucket.
    """
    gains = bucket_gains(bucket_counts(docs, spec), bucket_counts(target, spec))
    scored = cut(with_scores(weigh_documents(docs, gains, spec), spec.seed))
    return draw(scored, spec).select("doc_id", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, spec: Resample = Resample()) -> DataFrame:
    """The rows of docs whose doc_id is drawn, with their own columns; rows without doc_id stay out."""
    ids = resample_documents(docs, target, spec).where("rank is not null and doc_id is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col("doc_id").cast("long") == F.col("_drawn"), "left_semi")
