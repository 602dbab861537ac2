"""SimHash near-dedup with pivot distance tables (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, numpy_components, slices, utf8
from tidegauge.llm.components import connected_components
from tidegauge.llm.unit_dedup import row_key

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
#: Reference fingerprints of the distance table.
PIVOTS = 16
#: A bucket of more rows is cut into chunks, and pairs of chunks are compared apart.
CHUNK_ROWS = 4096
#: Compared pairs per fingerprint up to which a coarser bucket scheme is taken.
PAIRS_PER_ROW = 400
#: (blocks, blocks in a key): fingerprints that differ in RADIUS bits agree on blocks - RADIUS blocks at least.
SCHEMES = ((4, 1), (5, 2), (6, 3), (8, 5))


def simhash(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Fingerprint of one text: a bit is 1 if over half of the hashes of its word shingles have it."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    k = min(words, len(tokens))
    first = np.concatenate([[0], ends[: len(tokens) - k] + 1]).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], seed) for a, b in zip(first, ends[k - 1 :].tolist())), np.uint64, len(first))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the 64-bit hashes have; long input is counted in pieces."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[i : i + (1 << 15)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, row_key, fp): the fingerprint as a signed long of every row; null and empty texts have 0. row_key is a hash of
    doc_id and text that tells apart rows of one doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fp = np.fromiter((simhash(t, words, seed) for t in part.column("text").to_pylist()), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(fp.view(np.int64))], names=["doc_id", "row_key", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), utf8().alias("text")).mapInArrow(run, "doc_id long, row_key long, fp long")


def pivot_table(n: int = PIVOTS, seed: int = SEED) -> np.ndarray:
    """n reference fingerprints from a seed."""
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)


def masks(blocks: int, chosen: int) -> list[int]:
    """The bits of each choice of blocks, as signed longs."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    bits = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    return [int(np.uint64(sum(c)).astype(np.int64)) for c in combinations(bits, chosen)]


def keyed(fps: DataFrame, scheme: tuple[int, int], carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each bucket of each fingerprint. A clash of two keys adds compared pairs and loses none."""
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(masks(*scheme))]
    return fps.select("fp", *carry, F.explode(F.array(*keys)).alias("key"))


def spread(rows: DataFrame, counts: DataFrame, by: str, chunk: int = CHUNK_ROWS, mark: str | None = None) -> DataFrame:
    """Cuts buckets of over chunk rows into a grid: a row goes to each pair of chunks that holds its own chunk.

    counts: (key, n) of every bucket. A pair of rows of one bucket meets in one group at least; a group has some two
    chunks of rows however large its bucket is. mark names a column for a hash of the row's chunk in groups of two different
    chunks, null in others: rows of one chunk meet in the chunk's own group, too.
    """
    hot = cut(counts.where(F.col("n") > chunk))
    if hot.isEmpty():
        return (rows.withColumn(mark, F.lit(None).cast("long")) if mark else rows).withColumnRenamed("key", "g")
    parts = F.ceil(F.col("n") / chunk).cast("long")
    own = F.pmod(F.xxhash64(F.lit(7), F.col(by)), F.col("parts"))
    joined = rows.join(hot.select("key", parts.alias("parts")), "key", "left").withColumn("own", own)
    others = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = joined.withColumn("other", others)
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    if mark:
        dealt = dealt.withColumn(mark, F.when((F.col("other") >= 0) & (F.col("other") != F.col("own")), F.xxhash64(F.lit(11), "key", "own")))
    return dealt.withColumn("g", F.when(F.col("other") < 0, F.col("key")).otherwise(pair)).drop("key", "parts", "own", "other")


def groups(batches: Iterator[pa.RecordBatch], key: str = "g") -> Iterator[pa.RecordBatch]:
    """Arrow batches of a partition that is sorted by key, cut anew so that no group spans two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys != keys[-1], False, side="left")) if keys[0] == keys[-1] else batch.num_rows - int(np.argmax(keys[::-1] != keys[-1]))
        if held and held[0].column(key)[0].as_py() == keys[0] and last == 0:
            held.append(batch)
            continue
        if last:
            yield pa.concat_batches([*held, batch.slice(0, last)])
            held = []
        elif held:
            yield pa.concat_batches(held)
            held = []
        held = [batch.slice(last)]
    if held:
        yield pa.concat_batches(held)


def close_pairs(fp: np.ndarray, first: np.ndarray, end: np.ndarray, pivots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within radius bits, within the groups. Rows of a group stand in order of their distance to pivot 0.

    end: for each row the end of its group. The table holds the distance of each row to each pivot; a pair goes as soon as
    one coordinate differs by over radius, and only survivors are compared by all bits.
    """
    table = [np.bitwise_count(fp ^ p).astype(np.int8) for p in pivots]
    low = np.arange(len(fp))
    step = 1
    while len(low := low[low + step < end[low]]):
        low = low[table[0][low + step] - table[0][low] <= radius]
        i = low
        for column in table[1:]:
            if not len(i):
                break
            i = i[np.abs(column[i] - column[i + step]) <= radius]
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= radius]
        if len(i):
            yield i, i + step
        step += 1


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int, most: int = 1 << 20) -> np.ndarray:
    """For each of n rows the first row that the pairs connect it to; links are merged whenever most are held."""
    label, held, size = np.arange(n), [], 0
    for u, v in pairs:
        held.append((u, v))
        size += len(u)
        if size >= most:
            label, held, size = _merge(label, held, n), [], 0
    return _merge(label, held, n) if held else label


def _merge(label: np.ndarray, held: list, n: int) -> np.ndarray:
    tied = np.flatnonzero(label != np.arange(n))
    return numpy_components(np.concatenate([tied, *(u for u, _ in held)]), np.concatenate([label[tied], *(v for _, v in held)]), n)


def group_ends(keys: np.ndarray) -> np.ndarray:
    """For each row the end of its run of equal keys."""
    ends = np.flatnonzero(np.diff(keys)) + 1
    ends = np.append(ends, len(keys))
    return np.repeat(ends, np.diff(ends, prepend=0))


def choose_scheme(fps: DataFrame, radius: int = RADIUS) -> tuple[tuple[int, int], DataFrame]:
    """The coarsest scheme whose buckets hold no more than PAIRS_PER_ROW pairs a fingerprint, and its bucket sizes.

    Any scheme finds all pairs within RADIUS bits; finer ones make more rows and fewer pairs. The last is taken if none is
    below. Raises for a radius that some scheme doesn't cover.
    """
    if any(blocks - radius < chosen for blocks, chosen in SCHEMES):
        raise ValueError(f"the bucket schemes {SCHEMES} don't find all pairs within {radius} bits")
    for scheme in SCHEMES:
        counts = cut(keyed(fps, scheme).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
        if scheme == SCHEMES[-1]:
            break
        pairs = counts.agg(F.coalesce(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0]
        if pairs <= PAIRS_PER_ROW * fps.count():
            break
    return scheme, counts


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links between distinct fingerprints whose components are those of all pairs within radius bits.

    fps: distinct fp. In each bucket the pivot distance table discards pairs, the rest is compared, and of the pairs found
    only a spanning forest leaves the task, so a group of g near copies makes g - 1 rows, not g * g / 2.
    """
    scheme, counts = choose_scheme(fps, radius)
    pivots = pivot_table()
    d0 = F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(pivots[:1].view(np.int64)[0])).cast("long"))).cast("byte")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches):
            fp = part.column("fp").to_numpy().view(np.uint64)
            end = group_ends(part.column("g").to_numpy())
            label = forest(close_pairs(fp, np.arange(len(fp)), end, pivots, radius), len(fp))
            tied = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[tied].view(np.int64)), pa.array(fp[label[tied]].view(np.int64))], names=["a", "b"])

    rows = spread(keyed(fps, scheme), counts, "fp").withColumn("d0", d0)
    return rows.repartition("g").sortWithinPartitions("g", "d0").select("g", "fp").mapInArrow(run, "a long, b long")


def _components(docs: DataFrame, radius: int) -> DataFrame:
    """doc_id, row_key, fp and component_id of every row."""
    fps = cut(fingerprints(docs))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    parts = connected_components(fingerprint_links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = classes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = rooted.groupBy("component").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "row_key", "fp", "component_id")


def simhash_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Documents link if their fingerprints differ in radius bits or fewer; component_id is the smallest doc_id that links
    reach, the own one included. Equal fingerprints are one node, so copies make no pairs. Null and empty texts have the
    fingerprint zero and link like any other. Repeated rows are returned each. A null doc_id isn't a smallest one; a group
    with no other gives null. Other columns are ignored; an empty table gives an empty result.
    """
    return _components(docs, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents of which each group of near copies keeps the one with the smallest doc_id; all columns stay.

    A row goes by its doc_id and text, so another text of the same doc_id is judged apart. Rows that repeat the kept doc_id
    within its group stay; rows with a null doc_id stay, for they can't be told apart. Null and empty texts are one group.
    An empty table gives an empty result.
    """
    gone = _components(docs, radius).where("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_row")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").cast("long").alias("_own"), row_key().alias("_key"))
    return whole.join(gone, (F.col("_own") == F.col("_id")) & (F.col("_key") == F.col("_row")), "left_anti").select(*(F.col(f"_doc.`{c}`").alias(c) for c in docs.columns))
