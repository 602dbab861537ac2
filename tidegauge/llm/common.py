"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.materialize import broadcast_if_small, checkpoint_dir, cut, remove_folder, store  # noqa: F401  (used by the operators)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str = "text") -> Column:
    """A text column as bytes, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the texts of a slice stay near max_bytes; a longer text is a slice of its own."""
    for batch in batches:
        lengths = np.asarray(pc.binary_length(batch.column(text)).fill_null(0), dtype=np.int64)
        part = np.cumsum(lengths) // max_bytes
        starts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else []
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def store_at(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a Parquet table in the checkpoint folder, and its path for remove_folder."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def numpy_components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0..n-1 the smallest node that the links u-v reach."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
