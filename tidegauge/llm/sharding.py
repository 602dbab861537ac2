"""Sharding by a Feistel permutation of global row numbers (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import cut

SHARDS = 24
SEED = 20240601
ROUNDS = 6
#: Hash buckets in which rows are numbered; their offsets are a table of at most so many rows.
BUCKETS = 8192

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0..n-1 at the given numbers.

    A Feistel network over the least even number of bits that holds n - 1 is a permutation of that domain; a number that
    leaves 0..n-1 walks along its cycle until it is back inside, so the result is one of 0..n-1. The domain has under 4 n
    numbers, so walks are short on average; each takes as many steps as it needs.
    """
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        keys = _mix((np.uint64(seed) + np.arange(1, rounds + 1, dtype=np.uint64) * _ODD))
        while len(todo):
            left, right = out[todo] >> half, out[todo] & low
            for key in keys:
                left, right = right, left ^ (_mix(right * _ODD + key) & low)
            out[todo] = (left << half) | right
            todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def number_rows(rows: DataFrame, order: list[str], buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """rows with a global row_number from 0, and their count.

    The number depends on the values of the order columns alone, not on files or partitions: rows fall into hash buckets,
    a bucket's offset is the count of the buckets before it, and a window numbers the rows inside each bucket. rows must be
    checkpointed, for they are read twice.
    """
    hashed = rows.withColumn("_h", F.xxhash64(*order)).withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
    sizes = cut(hashed.groupBy("_bucket").agg(F.count("*").alias("_n")))
    offsets = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", *order)) - 1
    numbered = hashed.withColumn("_inside", inside).join(F.broadcast(offsets), "_bucket")
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return numbered.withColumn("row_number", F.col("_offset") + F.col("_inside")).drop("_h", "_bucket", "_offset", "_inside"), total


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row, under the law `rows`.

    The permuted row number p gives shard p % shards and slot p div shards: shards differ by one row at most, slots have no
    gap, and both follow from the row number without the table. Row numbers follow from doc_id, checksum and size, so a run
    over the same rows in other files gives the same shards; rows that agree in all three are interchangeable.

    A null text has no bytes and the checksum of none. Null doc_ids are numbered like others. Other columns are ignored; an
    empty table gives an empty result. grown_shard is null: the law `rows` moves rows when shards are added.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    numbered, n = number_rows(rows, ["doc_id", "text_crc32", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = permute(batch.column("row_number").to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "size", "text_crc32", "row_number")), pa.array((p % shards).astype(np.int32)), pa.array(p // shards)],
                names=["doc_id", "size", "text_crc32", "row_number", "shard", "slot"],
            )

    schema = "doc_id long, size long, text_crc32 long, row_number long, shard int, slot long"
    placed = numbered.select("doc_id", "size", "text_crc32", F.col("row_number").cast("long").alias("row_number")).mapInArrow(run, schema)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
