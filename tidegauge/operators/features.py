"""Feature vectors of sampled windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.features import NAMES, PREDICATES
from tidegauge.operators.windows import BUCKET, IN_ORDER, NEVER, VISITOR, _ddl, _entry_states, bucket_micros, in_bucket, many_gate_steps, openings, with_guests
from tidegauge.schemas import WindowSpec

#: Rows that are looked at together; a window that is larger is held whole.
CHUNK_ROWS = 1 << 16
#: (window, event) cells that are counted together.
CELLS = 1 << 21
#: Up to so many methods are counted by running sums, more by the windows' own events.
RUNNING_METHODS = 16
FLAGS = tuple(PREDICATES)


def _blocks(batches: Iterator[pa.RecordBatch], spec: WindowSpec) -> Iterator[tuple[pa.Table, int]]:
    """Tables of sorted rows, and how many of each were in the table before: what the windows that end later may still hold.

    A table has at least as many new rows as old ones, so every row is looked at a bounded number of times.
    """
    old: pa.Table | None = None
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < max(CHUNK_ROWS, old.num_rows if old else 0):
            continue
        yield (block := _joined(old, held)), old.num_rows if old else 0
        old, held = _tail(block, spec), []
    if held:
        yield _joined(old, held), old.num_rows if old else 0


def _joined(old: pa.Table | None, held: list[pa.RecordBatch]) -> pa.Table:
    new = pa.Table.from_batches(held)
    return (pa.concat_tables([old, new]) if old else new).combine_chunks()


def _tail(block: pa.Table, spec: WindowSpec) -> pa.Table:
    """The last group's rows that a window which ends at the last row or later may hold."""
    groups, t = _groups(block), block.column("t").to_numpy()
    first = int(np.searchsorted(groups, groups[-1]))
    return block.slice(first + int(np.searchsorted(t[first:], t[-1] - spec.length_micros)))


def _groups(block: pa.Table) -> np.ndarray:
    """The number of each row's bucket in the block."""
    first = np.zeros(block.num_rows, np.int64)
    for c in BUCKET:
        a = block.column(c).combine_chunks()
        a = a.dictionary_encode().indices.fill_null(-1).to_numpy() if pa.types.is_string(a.type) else a.to_numpy()
        first[1:] |= a[1:] != a[:-1]
    return np.cumsum(first)


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    """A number for each value and how many values there are; nulls are a value."""
    encoded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return encoded.indices.to_numpy().astype(np.int64), len(encoded.dictionary)


def _earlier(codes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """For each row the row before it in its bucket that has the same code, -1 if there is none."""
    order = np.lexsort((np.arange(len(codes)), codes, groups))
    out = np.full(len(codes), -1)
    same = (codes[order][1:] == codes[order][:-1]) & (groups[order][1:] == groups[order][:-1])
    out[order[1:][same]] = order[:-1][same]
    return out


def _running(x: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(x))


def _cells(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Windows in portions of some CELLS events: their slice, the rows of their events, and where each window's rows begin."""
    size = high - low
    ends = np.cumsum(size)
    cuts = [0, *(np.flatnonzero(np.diff(ends // CELLS)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            at = np.append(0, np.cumsum(size[a:b]))
            yield slice(a, b), np.arange(at[-1]) + np.repeat(low[a:b] - at[:-1], size[a:b]), at


def entropy(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Shannon entropy in bits of each row of counts, summed from the smallest count on, so that the sum has one value."""
    p = np.sort(counts, axis=1) / total[:, None]
    terms = p * np.log2(np.where(p > 0, p, 1))
    out = np.zeros(len(counts))
    for column in terms.T:
        out -= column
    return out + 0.0


def _method_entropy(codes: np.ndarray, n_codes: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros(len(low))
    if len(low) and n_codes <= RUNNING_METHODS:
        counts = np.stack([(r := _running(codes == m))[high] - r[low] for m in range(n_codes)], axis=1)
        return entropy(counts, high - low)
    for part, rows, at in _cells(low, high):
        of = np.repeat(np.arange(part.stop - part.start), np.diff(at))
        cell, n = np.unique(of * n_codes + codes[rows], return_counts=True)
        order = np.lexsort((n, cell // n_codes))
        window, n = (cell // n_codes)[order], n[order]
        p = n / np.diff(at)[window]
        out[part] = -np.bincount(window, p * np.log2(p), part.stop - part.start) + 0.0
    return out


def _spreads(gap: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The coefficient of variation of each run of gaps, nan below two gaps or for a mean of zero; sums are exact integers."""
    high, low = gap >> 20, gap & 0xFFFFF
    squares = [_running(x) for x in (high * high, high * low, low * low)]
    sums = _running(gap)
    out = np.full(len(first), np.nan)
    some = np.flatnonzero(last - first >= 2)
    a, b = first[some], last[some]
    for i, n, total, hh, hl, ll in zip(some.tolist(), (b - a).tolist(), (sums[b] - sums[a]).tolist(), *((s[b] - s[a]).tolist() for s in squares)):
        if total:
            out[i] = max(0, n * ((hh << 40) + (hl << 21) + ll) - total * total) ** 0.5 / total
    return out


def window_values(block: pa.Table, old: int, spec: WindowSpec) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sample rows of a block beyond the old ones, and the nine features of their windows; nan where undefined.

    Rows are sorted by bucket and time, an event before the sample that it is; a window is a run of events, so most features
    are differences of running sums. An endpoint is new in a window if its earlier event lies before the window.
    """
    t, sample, groups = block.column("t").to_numpy(), block.column("sample").to_numpy(), _groups(block)
    events = np.flatnonzero(sample == 0)
    ends = np.flatnonzero(sample == 1)
    ends = ends[ends >= old]
    te, ge = t[events], groups[events]
    # Times of one bucket, guests included, span less than two bucket lengths: (bucket, time) is one increasing number.
    stride = 2 * bucket_micros(spec)
    base = np.zeros(groups[-1] + 1, np.int64)
    begins = np.flatnonzero(np.diff(groups, prepend=-1))
    base[groups[begins]] = t[begins]
    line = ge * stride + te - base[ge]
    low = np.searchsorted(line, groups[ends] * stride + np.maximum(t[ends] - spec.length_micros - base[groups[ends]], 0))
    high = np.searchsorted(events, ends)
    return ends, _measures(block, events, te, ge, low, high)


def _measures(block: pa.Table, events: np.ndarray, te: np.ndarray, ge: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """The nine features of the windows low to high of the events, which are rows of the block with these times and buckets."""
    n = high - low
    flag = {c: _running(block.column(c).to_numpy(zero_copy_only=False)[events].astype(bool)) for c in FLAGS}
    share = {c: (flag[c][high] - flag[c][low]) / n for c in FLAGS}
    pages = np.flatnonzero(np.diff(flag["is_html"]))
    tp = te[pages]
    # Gap k is between pages k and k + 1; inside a window both pages are of its bucket.
    first, last = np.searchsorted(pages, low), np.searchsorted(pages, high) - 1
    gaps = np.maximum(last - first, 0)
    mean = np.full(len(low), np.nan)
    some = gaps > 0
    mean[some] = (tp[last[some]] - tp[first[some]]) / gaps[some] / 1000
    gap = np.where(np.diff(ge[pages]) == 0, np.diff(tp), 0)
    earlier = _earlier(_codes(block.column("endpoint").take(pa.array(events)))[0], ge)
    distinct = np.zeros(len(low), np.int64)
    for part, rows, at in _cells(low, high):
        distinct[part] = np.add.reduceat((earlier[rows] < np.repeat(low[part], np.diff(at))).astype(np.int64), at[:-1])
    codes, n_codes = _codes(block.column("http_method").take(pa.array(events)))
    return [
        n.astype(float),
        (te[high - 1] - te[low]) / 1e6,
        mean,
        _spreads(gap, first, first + gaps),
        distinct.astype(float),
        share["is_html"],
        share["is_4xx_response"],
        _method_entropy(codes, n_codes, low, high),
        share["has_referrer"],
    ]


def _flags() -> list[Column]:
    return [F.coalesce(predicate(), F.lit(False)).alias(name) for name, predicate in PREDICATES.items()]


def window_features(samples: DataFrame, events: DataFrame, spec: WindowSpec, carried: tuple[str, ...] = ()) -> DataFrame:
    """source_id, visitor_id, event_id, t, arrival, the carried columns of samples and the nine features of each sample;
    undefined ones are null.

    events: the history that windows may hold, the samples among them. Events go to their time bucket and, if a window of the
    next bucket may hold them, to that one too; samples go to theirs. So every window lies in one group, events are shuffled
    twice at most, however many windows hold them, and sorted rows stream through running sums; a gap counts if both of its
    pages are in the window. A task holds the events of a window and a chunk of rows.
    """
    members = events.select(*VISITOR, "t", "arrival", "endpoint", "http_method", *_flags())
    spread = with_guests(members, spec, ("t", "arrival", "endpoint", "http_method", *FLAGS)).drop("guest").withColumn("sample", F.lit(0))
    ends = samples.select(*VISITOR, "t", "arrival", "event_id", *carried, in_bucket(F.col("t"), bucket_micros(spec)).alias("bucket"), F.lit(1).alias("sample"))
    rows = spread.unionByName(ends, allowMissingColumns=True).repartition(*BUCKET).sortWithinPartitions(*IN_ORDER, "t", "arrival", "sample")
    out = (*VISITOR, "event_id", "t", "arrival", *carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, old in _blocks(batches, spec):
            at, values = window_values(block, old, spec)
            own = block.select(out).take(pa.array(at)).combine_chunks()
            columns = [own.column(c).chunk(0) if len(at) else pa.array([], own.schema.field(c).type) for c in out]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, mask=np.isnan(v)) for v in values)], names=[*out, *NAMES])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in out)
    return rows.mapInArrow(run, f"{kinds}, {', '.join(f'{n} double' for n in NAMES)}")


def _windows(block: pa.Table, spec: WindowSpec) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's bucket in the block, and the first row of the window that ends at the row."""
    t, groups = block.column("t").to_numpy(), _groups(block)
    base, stride = t[np.flatnonzero(np.diff(groups, prepend=-1))][groups], 2 * bucket_micros(spec)
    return groups, np.searchsorted(groups * stride + t - base, groups * stride + np.maximum(t - spec.length_micros - base, 0))


def _candidates(block: pa.Table, old: int, low: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows beyond the old ones that the gate looks at, and each row's window count."""
    counted, due = _running(block.column("counts").to_numpy().astype(np.int64)), block.column("due").to_numpy().astype(bool)
    count = counted[1:] - counted[low]
    due &= count >= least
    due[:old] = False
    return np.flatnonzero(due), count


def _gate_table(found: pa.Table, spec: WindowSpec) -> Iterator[pa.RecordBatch]:
    """gate_steps of each bucket of a table of candidates."""
    if found.num_rows:
        begins = np.flatnonzero(np.diff(_groups(found), prepend=-1))
        keys, at = found.select(BUCKET).take(pa.array(begins)), np.append(begins, found.num_rows)
        offsets, *steps = many_gate_steps(found.column("t").to_numpy(), at, keys.column("bucket").to_numpy() * bucket_micros(spec), spec.cadence_micros)
        columns = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(s, pa.int64())) for s in steps]
        yield pa.RecordBatch.from_arrays([*(keys.column(c).combine_chunks() for c in BUCKET), *columns], names=[*BUCKET, "entries", "exits"])


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that aren't states, with entry: the state of their bucket, which stands before them."""
    carried = NEVER
    for batch in batches:
        if batch.num_rows:
            state, t = batch.column("state").to_numpy() == 0, batch.column("t").fill_null(NEVER).to_numpy()
            at = np.maximum.accumulate(np.where(state, np.arange(len(t)), -1))
            entry = np.where(at >= 0, t[at], carried)
            carried = int(entry[-1])
            yield batch.append_column("entry", pa.array(entry, pa.int64())).filter(pa.array(~state))


def gated_features(events: DataFrame, spec: WindowSpec, since: Column | None = None, eligible_only: bool = True) -> DataFrame:
    """source_id, visitor_id, event_id, t, arrival, window_count and the nine features of the windows that open the gate.

    These are window_features of fit_samples or, without eligible_only and with late in events, of serve_samples: late events
    open nothing and aren't counted, but are in the windows. A visitor's (t, arrival) are unique. Events are sorted by their
    bucket twice: their times alone give each bucket's step function of the gate (cadence_gate), and with the bucket's
    state before them all columns give counts, openings and features in one walk. A task holds the events of a window and a
    chunk of rows, and the times of one visitor's bucket.
    """
    counts = ~F.col("late") if "late" in events.columns else F.lit(True)
    marked = events.withColumn("counts", counts).withColumn("due", F.col("counts") & (F.lit(True) if since is None else F.coalesce(since, F.lit(False))))
    least = spec.min_events if eligible_only else 0
    order = (*IN_ORDER, "t", "arrival")

    def spread(columns: tuple, guests: tuple[str, ...]) -> DataFrame:
        rows = with_guests(marked.select(*VISITOR, "t", "arrival", "counts", "due", *columns), spec, ("t", "arrival", "counts", *guests))
        return rows.withColumn("due", F.coalesce("due", F.lit(False))).drop("guest")

    times = spread((), ())

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for block, old in _blocks(batches, spec):
            found = block.select([*BUCKET, "t"]).take(pa.array(_candidates(block, old, _windows(block, spec)[1], least)[0]))
            found = (pa.concat_tables([held, found]) if held else found).combine_chunks()
            if found.num_rows:
                # The last bucket may go on in the next block.
                last = int(np.flatnonzero(np.diff(_groups(found), prepend=-1))[-1])
                yield from _gate_table(found.slice(0, last), spec)
                held = found.slice(last)
        if held:
            yield from _gate_table(held, spec)

    stepped = times.repartition(*BUCKET).sortWithinPartitions(*order).mapInArrow(steps, f"{_ddl(times, BUCKET)}, entries array<long>, exits array<long>")
    states = _entry_states(stepped, spec.cadence_micros).withColumn("state", F.lit(0))
    members = spread(("event_id", "endpoint", "http_method", *_flags()), ("endpoint", "http_method", *FLAGS)).withColumn("state", F.lit(1))
    rows = members.unionByName(states, allowMissingColumns=True).repartition(*BUCKET).sortWithinPartitions(*IN_ORDER, "state", "t", "arrival")
    out = (*VISITOR, "event_id", "t", "arrival")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = NEVER
        for block, old in _blocks(_entered(batches), spec):
            (groups, low), t = _windows(block, spec), block.column("t").to_numpy()
            due, count = _candidates(block, old, low, least)
            begins = np.flatnonzero(np.diff(groups, prepend=-1))
            before = block.column("entry").to_numpy()[begins]
            if old:
                before[0] = carried
            edges = np.searchsorted(due, np.append(begins, len(groups)))
            kept, last = openings(t[due], edges[:-1], edges[1:], before, spec.cadence_micros)
            carried, at = int(last[-1]), due[kept]
            values = _measures(block, np.arange(len(t)), t, groups, low[at], at + 1)
            own = block.select(list(out)).take(pa.array(at, pa.int64())).combine_chunks()
            columns = [own.column(c).chunk(0) if len(at) else pa.array([], own.schema.field(c).type) for c in out]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count[at], pa.int64()), *(pa.array(v, mask=np.isnan(v)) for v in values)], names=[*out, "window_count", *NAMES])

    return rows.mapInArrow(run, f"{_ddl(rows, out)}, window_count long, {', '.join(f'{n} double' for n in NAMES)}")
