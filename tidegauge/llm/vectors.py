"""Embedding near-dedup by an exact metric range join (operator 4)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import broadcast_if_small, cut, store
from tidegauge.llm.components import connected_components
from tidegauge.llm.simhash import CHUNK_ROWS, forest, groups

LEAST_COSINE = 0.98
#: Vectors of a label are cut into parts of CHUNK_ROWS, but into no more than MOST_PARTS (LINKED_PARTS of vectors with whole
#: components) as long as a part has no more than CELL_ROWS: each part meets each other, so parts are what is shuffled.
CELL_ROWS, MOST_PARTS, LINKED_PARTS = 1 << 17, 8, 2
#: A code has so many projections of the unit vector, each a byte in steps of 1 / STEPS; beyond half of the unit it is cut off.
CODE, STEPS = 24, 254
#: Rows of a tile by rows of the other side that are compared at once, and pairs whose cosines are.
TILE, TILE_OTHER, COSINES = 512, 4096, 1 << 14
#: Added to distances that prune, for rounding; pairs are decided by their cosine alone.
SLACK = 1e-3


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    return (x @ y.T) / np.sqrt(xx)[:, None] / np.sqrt(yy)[None, :]


def _pair_cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1)) / np.sqrt((y * y).sum(axis=1))


def codes_of(units: np.ndarray) -> np.ndarray:
    """CODE bytes of each unit row: its projections on fixed orthonormal directions, cut off and rounded, as multiples of 1 / STEPS.

    Projecting and cutting off bring no two rows apart, and rounding moves a code by half a step at most in each direction.
    """
    dim = units.shape[1]
    if dim > CODE:
        units = units @ np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, CODE)))[0]
    out = np.zeros((len(units), CODE), np.int8)
    out[:, : units.shape[1]] = np.clip(np.rint(np.nan_to_num(units) * STEPS), -127, 127)
    return out


def coded_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, class, ok, dim and c0 to c2 (the code's bytes) of each row; a class is a hash of label and vector, and ok
    tells that the row can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("vector")
            dims = pc.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
            ok, codes = np.zeros(len(dims), bool), np.zeros((len(dims), CODE), np.int8)
            named = batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims[named & (dims > 0)]).tolist():
                rows = np.flatnonzero(named & (dims == dim))
                x = values.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                rows, x = rows[good], x[good]
                ok[rows] = True
                with np.errstate(all="ignore"):
                    codes[rows] = codes_of(x / np.sqrt((x * x).sum(axis=1, keepdims=True)))
            more = [pa.array(ok), pa.array(dims), *map(pa.array, codes.view(np.int64).T.copy())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "class")), *more], names=["vec_id", "label", "class", "ok", "dim", "c0", "c1", "c2"])

    fields = [T.StructField("ok", T.BooleanType()), T.StructField("dim", T.IntegerType()), *(T.StructField(f"c{k}", T.LongType()) for k in range(3))]
    own = vectors.select("vec_id", "label", "class", "vector")
    return own.mapInArrow(run, T.StructType([*own.schema.fields[:-1], *fields]))


def in_parts(rows: DataFrame, most_parts: int) -> DataFrame:
    """rows with the number of parts that their label and dim are cut into, and their own part, by their class."""
    n = rows.groupBy("label", "dim").agg(F.count("*").alias("n"))
    parts = F.greatest(F.lit(1), F.least(F.lit(most_parts), F.ceil(F.col("n") / CHUNK_ROWS)), F.ceil(F.col("n") / CELL_ROWS))
    counted = rows.join(broadcast_if_small(cut(n.select("label", "dim", parts.cast("int").alias("parts")))), ["label", "dim"])
    return counted.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "class"), F.col("parts")).cast("int"))


def meeting(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """label, dim, part, other and columns, a binary of many rows each, dealt out by g: each pair of parts of a label and dim has a
    group. Each part goes to as many groups as there are parts.

    columns: longs, and vectors of doubles or floats.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column("label").dictionary_encode().indices.to_numpy(), *(batch.column(c).to_numpy() for c in ("dim", "part"))]
            order = np.lexsort(keys[::-1])
            fresh = np.append(True, np.any([np.diff(k[order]) != 0 for k in keys], axis=0))
            first = np.append(np.flatnonzero(fresh), len(order))
            heads = batch.take(pa.array(order[first[:-1]]))
            packed = []
            for c in columns:
                spans = [batch.column(c).take(pa.array(order[a:b])) for a, b in zip(first[:-1], first[1:])]
                flat = [x.flatten() if pa.types.is_list(x.type) else x for x in spans]
                packed.append(pa.array([x.to_numpy(zero_copy_only=False).tobytes() for x in flat], pa.binary()))
            yield pa.RecordBatch.from_arrays([*(heads.column(c) for c in ("label", "dim", "part", "parts")), *packed], names=["label", "dim", "part", "parts", *columns])

    own = rows.select("label", "dim", "part", "parts", *columns)
    packed = own.mapInArrow(pack, T.StructType([*own.schema.fields[:4], *(T.StructField(c, T.BinaryType()) for c in columns)]))
    dealt = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("g", F.xxhash64("label", "dim", F.least("part", "other"), F.greatest("part", "other")))
    # So many partitions at least: a few bytes of rows are much work.
    dealt = dealt.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g")
    return dealt.sortWithinPartitions("g", "label", "dim", "part").select("g", "label", "dim", "part", "other", *columns)


def pairs_of_parts(part: pa.RecordBatch, columns: dict[str, type]) -> Iterator[tuple[int, list[dict[str, np.ndarray]]]]:
    """dim and the columns of one part, or of two different ones, that are to be compared, for each label and dim of a batch of
    whole groups. A part without its other one is left out."""
    keys = [part.column("g").to_numpy(), part.column("label").dictionary_encode().indices.to_numpy(), part.column("dim").to_numpy()]
    numbers, others = part.column("part").to_numpy(), part.column("other").to_numpy()
    # A group of one part has others equal to it; groups whose hashes are equal stay apart.
    keys += [np.minimum(numbers, others), np.maximum(numbers, others)]
    order = np.lexsort([numbers, *keys[::-1]])
    fresh = np.append(True, np.any([np.diff(k[order]) != 0 for k in keys], axis=0))
    first = np.append(np.flatnonzero(fresh), len(order))
    for a, b in zip(first[:-1], first[1:]):
        rows = order[a:b]
        sides = [rows[numbers[rows] == n] for n in np.unique(numbers[rows])]
        if len(sides) == 1 and numbers[rows[0]] != others[rows[0]]:
            continue
        yield int(keys[2][rows[0]]), [{c: np.frombuffer(b"".join(part.column(c).take(pa.array(side)).to_pylist()), kind) for c, kind in columns.items()} for side in sides]


def close_tiles(mine: np.ndarray, theirs: np.ndarray, radius: float, same: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(i, j, whether the pairs of rows from i and j on may be within radius) of the tiles that have such a pair. Codes stand in
    order of their first byte; same: both sides are one, whose pairs come once and without a row and itself."""
    limit = radius * STEPS + math.sqrt(CODE) + SLACK
    most = np.float32(min(limit * limit, 1e9))
    x, y = (np.ascontiguousarray(c, np.float32) for c in (mine, theirs))
    # Whole numbers below 2 ** 24, so products and sums are exact.
    x = np.concatenate([x, (x * x).sum(axis=1, keepdims=True), np.ones((len(x), 1), np.float32)], axis=1)
    y = np.concatenate([-2 * y, np.ones((len(y), 1), np.float32), (y * y).sum(axis=1, keepdims=True)], axis=1).T
    edge = theirs[:, 0].astype(np.int64)
    for i in range(0, len(mine), TILE):
        span = mine[i : i + TILE, 0].astype(np.int64)
        low, high = np.searchsorted(edge, [span[0] - limit, span[-1] + limit])
        for j in range(max(low, i) if same else low, high, TILE_OTHER):
            near = x[i : i + TILE] @ y[:, j : min(j + TILE_OTHER, high)] <= most
            if same and j < i + TILE:
                near &= np.arange(j, j + near.shape[1]) > np.arange(i, i + near.shape[0])[:, None]
            if near.any():
                yield i, j, near


def _in_order(side: dict[str, np.ndarray], codes: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """One row of each class, in the order of the first byte of the codes."""
    kept = np.unique(side["class"], return_index=True)[1]
    kept = kept[np.argsort(codes[kept, 0], kind="stable")]
    return {c: v[kept] for c, v in side.items()}, codes[kept]


def near_classes(classes: DataFrame, radius: float) -> DataFrame:
    """The classes whose codes are near enough to another's of their label and dim for a distance of at most radius, and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = {c: np.int64 for c in ("class", "c0", "c1", "c2")}
        for part in groups(batches):
            for _, sides in pairs_of_parts(part, columns):
                sides = [_in_order(x, np.stack([x[c] for c in ("c0", "c1", "c2")], axis=1).view(np.int8)) for x in sides]
                found = [np.zeros(len(codes), bool) for _, codes in sides]
                for i, j, near in close_tiles(sides[0][1], sides[-1][1], radius, len(sides) == 1):
                    found[0][i : i + near.shape[0]] |= near.any(axis=1)
                    found[-1][j : j + near.shape[1]] |= near.any(axis=0)
                ids = np.concatenate([x["class"][has] for (x, _), has in zip(sides, found)])
                yield pa.RecordBatch.from_arrays([pa.array(ids)], names=["class"])

    return meeting(in_parts(classes, MOST_PARTS), ("class", "c0", "c1", "c2")).mapInArrow(run, "class long").distinct()


def vector_links(classes: DataFrame, vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(a, b, n): for every class a with links the number n of vectors in other classes that it links with, in parts to be
    summed, and b, a class that it is connected to.

    classes: class, label, dim, copies, low (the least vec_id) and the code. vectors: vec_id, label, class and vector of all rows.
    Codes are compared first, in parts of a label; only the vectors of classes with a near code move, and each pair of them
    with near codes is decided by its cosine.
    """
    radius = math.sqrt(max(0.0, 2 - 2 * least))
    near = cut(near_classes(classes, radius))
    wanted = in_parts(cut(classes.join(broadcast_if_small(near), "class").select("class", "label", "dim", "copies", "low")), LINKED_PARTS)
    rows = vectors.join(broadcast_if_small(cut(wanted)), (vectors["class"] == wanted["class"]) & (vectors["label"] == wanted["label"]) & vectors["vec_id"].eqNullSafe(wanted["low"]))
    rows = rows.select(wanted["class"], wanted["label"], "dim", "copies", "part", "parts", F.col("vector").cast("array<double>" if dict(vectors.dtypes)["vector"] != "array<float>" else "array<float>").alias("vector"))
    kind = np.float32 if dict(vectors.dtypes)["vector"] == "array<float>" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches):
            for dim, sides in pairs_of_parts(part, {"class": np.int64, "copies": np.int64, "vector": kind}):
                sides = [_with_vectors(x, dim) for x in sides]
                yield _links(sides[0], sides[-1], len(sides) == 1, radius, least)

    return meeting(rows, ("class", "copies", "vector")).mapInArrow(run, "a long, b long, n long")


def _with_vectors(side: dict[str, np.ndarray], dim: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    side["vector"] = side["vector"].reshape(-1, dim).astype(np.float64)
    with np.errstate(all="ignore"):
        return _in_order(side, codes_of(side["vector"] / np.sqrt((side["vector"] ** 2).sum(axis=1, keepdims=True))))


def _links(mine: tuple, theirs: tuple, same: bool, radius: float, least: float) -> pa.RecordBatch:
    (one, codes), (other, other_codes) = mine, theirs
    x, y = one["vector"], other["vector"]
    ids, copies = (one[c] if same else np.concatenate([one[c], other[c]]) for c in ("class", "copies"))
    offset, n_links = 0 if same else len(x), np.zeros(len(ids), np.int64)

    def pairs():
        for i, j, near in close_tiles(codes, other_codes, radius, same):
            if 8 * np.count_nonzero(near) > near.size:
                p, q = np.nonzero(near & (_cosines(x[i : i + near.shape[0]], y[j : j + near.shape[1]]) >= least))
                p, q = p + i, q + j
            else:
                p, q = np.nonzero(near)
                p, q = p + i, q + j
                ok = [_pair_cosines(x[p[k : k + COSINES]], y[q[k : k + COSINES]]) >= least for k in range(0, len(p), COSINES)]
                p, q = p[np.concatenate(ok)], q[np.concatenate(ok)]
            q += offset
            np.add.at(n_links, p, copies[q])
            np.add.at(n_links, q, copies[p])
            yield p, q

    label = forest(pairs(), len(ids))
    has = np.flatnonzero(n_links)
    return pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(ids[label[has]]), pa.array(n_links[has])], names=["a", "b", "n"])


def vector_components(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors(vec_id, embedding, label).

    Vectors of equal label link if their cosine, in double precision, is at least `least`; n_links counts the other rows
    that a row links with, component_id is the smallest vec_id that links reach, kept marks the row that has it.

    Rows that are equal in label and vector are one class, so copies make no pairs. Null labels, null or zero vectors and
    vectors with null or non-finite components link with nothing: n_links 0, component_id the own vec_id. Vectors of
    different length don't link. A null vec_id gives component_id null unless a link reaches one. An empty table gives an
    empty result; other columns are ignored.
    """
    # A class is named by a hash of what makes it one; vec_id names components only at the end.
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("vector")).withColumn("class", F.xxhash64("label", "vector"))
    rows = store(coded_vectors(whole))
    good, rest = rows.where("ok"), rows.where("not ok")
    classes = cut(good.groupBy("label", "dim", "class").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"), *(F.min(c).alias(c) for c in ("c0", "c1", "c2"))))
    links = cut(vector_links(classes, whole, least))
    parts = connected_components(links.select("a", "b"))
    counted = links.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "class")
    rooted = classes.select("class", "label", "copies", "low").join(parts.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    lowest = rooted.groupBy("component").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "component").join(counted, "class", "left").select("class", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    linked = good.select("vec_id", "class").join(named, "class").select("vec_id", "n_links", "component_id")
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
