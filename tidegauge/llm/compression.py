"""Vector code compression: a codebook for each part of the vectors, trained by active-entry Lloyd rounds (operator 12)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import broadcast_if_small, cut, remove_folder, store_at

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Integer components saturate here, so that squared distances of a whole vector stay below 2**63.
LARGEST = 1 << 26
#: Distances that are held at a time, as 64-bit integers.
CELLS = 1 << 21

STATE = "vec_id long, label string, x array<int>, code binary, dist array<long>"


def _finite(column: str):
    v = F.col(column)
    return v.isNotNull() & F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label (as text) and x, the components as floor(scale * component), of the rows without null or non-finite ones."""
    whole = F.transform("embedding", lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(c.cast("double") * scale))).cast("int"))
    return vectors.where(_finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), whole.alias("x"))


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """(part, entry, position): the parts of the vectors with the smallest vec_ids; `entries` rows are collected.

    The first of them sets the length. Equal vec_ids go by their components, null ones come last. Without rows, or if the
    length isn't a multiple of the parts, there are no entries.
    """
    seeds = [r["x"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()]
    seeds = [s for s in seeds if seeds[0] and len(s) == len(seeds[0]) and len(s) % parts == 0]
    if not seeds:
        return np.zeros((parts, 0, 0), np.int64)
    return np.array(seeds, np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2)


def nearest(x: np.ndarray, book: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the nearest of the listed entries of a codebook and its squared distance; ties go to the first."""
    code, dist = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    step = max(1, CELLS // max(1, len(entries) * x.shape[1]))
    for i in range(0, len(x), step):
        d = x[i : i + step, None, :] - book[None, entries, :]
        d = np.einsum("nep,nep->ne", d, d)
        at = d.argmin(axis=1)
        code[i : i + step], dist[i : i + step] = entries[at], d[np.arange(len(at)), at]
    return code, dist


def reassign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances of one part position after some entries of its codebook moved.

    Where the assigned entry stayed, its stored distance is exact and no other fixed entry can be nearer, or as near at a
    lower index; only moved entries are compared. Where it moved, all entries are compared.
    """
    code, dist = code.copy(), dist.copy()
    active = np.flatnonzero(moved)
    lost = moved[code]
    if len(active):
        kept = np.flatnonzero(~lost)
        to, d = nearest(x[kept], book, active)
        better = (d < dist[kept]) | ((d == dist[kept]) & (to < code[kept]))
        code[kept[better]], dist[kept[better]] = to[better], d[better]
    rows = np.flatnonzero(lost)
    code[rows], dist[rows] = nearest(x[rows], book, np.arange(len(book)))
    return code, dist


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)


def _parts(column: pa.Array, parts: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), parts, -1)


def assign_first(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows with the code and squared distance of every part. Vectors of another length than the codebooks' are left out."""
    parts, _, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(books.shape[1])
        for batch in _filled(batches):
            x = _parts(batch.column("x"), parts)
            yield _state(batch, *zip(*(nearest(x[:, m], books[m], every) for m in range(parts))))

    return rows.where(F.size("x") == parts * size).where(F.size("x") > 0).mapInArrow(run, STATE)


def assign_again(state: DataFrame, books: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The state under new codebooks, of which the marked entries moved."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _filled(batches):
            x, code, dist = _parts(batch.column("x"), parts), _codes(batch, parts), _parts(batch.column("dist"), parts)[:, :, 0]
            yield _state(batch, *zip(*(reassign(x[:, m], books[m], moved[m], code[:, m], dist[:, m]) for m in range(parts))))

    return state.mapInArrow(run, STATE)


def _codes(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, parts).astype(np.int64)


def _state(batch: pa.RecordBatch, codes, dists) -> pa.RecordBatch:
    code, dist = np.stack(codes, axis=1), np.stack(dists, axis=1)
    width = dist.shape[1]
    listed = pa.ListArray.from_arrays(np.arange(len(dist) + 1, dtype=np.int32) * width, pa.array(dist.ravel()))
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "x")), pa.array([r.tobytes() for r in code.astype(np.uint8)], pa.binary()), listed], names=["vec_id", "label", "x", "code", "dist"])


def moved_entries(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codebooks after every used entry is replaced by the componentwise floor of its parts' mean, and which entries moved.

    A task adds up its own rows and gives at most one row for each part and entry; sums of tasks are added by key. Collected
    is one row for each part and entry, whatever the number of vectors.
    """
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, size), np.int64)
        for batch in _filled(batches):
            slot = (_codes(batch, parts) + np.arange(parts) * entries).ravel()
            x = _parts(batch.column("x"), parts).reshape(len(slot), size)
            order = np.argsort(slot, kind="stable")
            at = np.flatnonzero(np.diff(slot[order], prepend=-1))
            total[slot[order][at]] += np.add.reduceat(x[order], at, axis=0)
            count += np.bincount(slot, minlength=parts * entries)
        used = np.flatnonzero(count)
        for lo in range(0, len(used), 4096):
            u = used[lo : lo + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(count[u]), pa.array(total[u].tolist(), pa.list_(pa.int64()))], names=["slot", "n", "total"])

    sums = state.select("x", "code").mapInArrow(run, "slot long, n long, total array<long>")
    added = sums.groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(size)))
    after = books.copy()
    for r in added.collect():
        after[r["slot"] // entries, r["slot"] % entries] = [r[f"s{i}"] // r["n"] for i in range(size)]
    return after, (after != books).any(axis=2)


def train_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The final state (vec_id, label, x, code, dist) and the codebooks, after so many rounds and a last assignment.

    The state of a round is a table in the shared checkpoint folder; the one before it is removed once the next is written.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part")
    spark = rows.sparkSession
    books = first_codebooks(rows, parts, entries)
    state, path = store_at(assign_first(rows, books))
    for _ in range(rounds):
        books, moved = moved_entries(state, books)
        before = path
        state, path = store_at(assign_again(state, books, moved))
        remove_folder(spark, before)
    return state, books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of the rows of vectors(vec_id, embedding, label).

    code has two hex digits for the entry of each part, error is the sum of the parts' squared distances in integers,
    label_error the sum of errors over equal labels, nulls together.

    Rows whose vector is null or holds null or non-finite components are left out, as are those of another length than the
    vector with the smallest vec_id and all rows if that length isn't a multiple of the parts. Components beyond
    LARGEST / scale saturate. With fewer vectors than entries every vector is an entry; repeated vectors make equal entries
    of which the lowest is used. Equal and repeated vec_ids are rows of their own, a null vec_id seeds last. Other columns
    are ignored; an empty table gives an empty result.
    """
    state, books = train_codes(integer_vectors(vectors, scale), parts, entries, rounds)
    coded = state.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), F.aggregate("dist", F.lit(0).cast("long"), lambda a, d: a + d).alias("error"))
    of_label = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    joined = coded.join(broadcast_if_small(of_label), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
