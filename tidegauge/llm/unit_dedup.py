"""Substring dedup by hashes of lines and their sentences (operator 8)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, slices, utf8

#: Words of the shortest line that is a unit.
MIN_WORDS = 1
#: Words of the shortest sentence that is a unit beside others in its line, and of the shortest unit of a passage. Shorter
#: ones repeat by chance: they neither end nor lengthen a run.
RUN_WORDS = 5
#: Words of a run of adjacent units, each in another document too, from which it is reported as a passage.
PASSAGE_WORDS = 25
#: Ends of units: lines and sentences, or lines alone, or paragraphs. A unit keeps its full stops and the blanks after them.
SENTENCES = r"\n|[.!?]+[ \t]+|[。！？]+[ \t]*"
LINES = r"\n"
PARAGRAPHS = r"\n\n"
#: Characters of scripts without blanks, each of which is a word: kana and Han.
UNSPACED = "ぁ-ゖァ-ヺ㐀-䶿一-鿿"

UNITS = "doc_id long, row_key long, unit int, place int, start int, end int, n_words int, digest binary"

_WORDS = re.compile(rf"[{UNSPACED}]|[^\W_{UNSPACED}]+")


def normalise(unit: str) -> list[str]:
    """The words of a unit in lower case: runs of letters and digits, and each character of a script without blanks."""
    return _WORDS.findall(unit.lower())


def tiles(text: str, ends: re.Pattern) -> Iterator[list[tuple[int, int]]]:
    """Start and end of the sentences of each line of text, in order; line ends lie between lines."""
    at, line = 0, []
    for m in ends.finditer(text):
        if "\n" in m[0]:
            yield [*line, (at, m.start())]
            line = []
        else:
            line.append((at, m.end()))
        at = m.end()
    yield [*line, (at, len(text))]


def line_units(text: str, line: list[tuple[int, int]], min_words: int, run_words: int) -> list[tuple[int, int, list[str]]]:
    """Start, end and words of the units of a line: its sentences of run_words words or more, or else the line as a whole
    if it has min_words."""
    found = [(a, b, normalise(text[a:b])) for a, b in line]
    if long := [x for x in found if len(x[2]) >= run_words]:
        return long
    words = [w for _, _, own in found for w in own]
    return [(line[0][0], line[-1][1], words)] if len(words) >= min_words else []


def units(docs: DataFrame, ends: str = SENTENCES, min_words: int = MIN_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, row_key, number (from 0) of the unit in its row, its place (from 0) among those of run_words words or more
    (null for shorter ones), start and end (code points of the original text), words and digest of each unit. row_key tells
    apart rows that share a doc_id."""
    pattern = re.compile(ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_bytes=1 << 20):
            columns: list[list] = [[] for _ in range(8)]
            docs_, rows, numbers, places, starts, stops, sizes, digests = columns
            for doc, row, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "row_key", "text"))):
                whole, k, place = text.decode("utf-8", "replace"), 0, 0
                for line in tiles(whole, pattern):
                    for a, b, words in line_units(whole, line, min_words, run_words):
                        docs_.append(doc)
                        rows.append(row)
                        numbers.append(k)
                        places.append(place if len(words) >= run_words else None)
                        starts.append(a)
                        stops.append(b)
                        sizes.append(len(words))
                        digests.append(blake2b(" ".join(words).encode(), digest_size=16).digest())
                        k += 1
                        place += len(words) >= run_words
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "row_key", "unit", "place", "start", "end", "n_words", "digest"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), utf8().alias("text")).mapInArrow(run, UNITS)


def row_key():
    """A hash of the row's doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def repeated_units(found: DataFrame) -> DataFrame:
    """The units of found whose digest is in another place too, with later (an earlier one stays), across (it is in another
    row too) and first_doc_id. Rank: doc_id (null last), row_key, number.

    The first and the last of a digest are partial aggregates and the join back repeats a digest once for each of its
    units, so a line that a third of all documents hold is dealt out as any skewed join side.
    """
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "unit")
    ends = found.groupBy("digest").agg(F.min(own).alias("first"), F.max(own).alias("last")).where(~F.col("first").eqNullSafe(F.col("last")))
    across = ~F.struct("first.doc_id", "first.row_key").eqNullSafe(F.struct("last.doc_id", "last.row_key"))
    firsts = ends.select("digest", "first", across.alias("across"))
    return found.join(firsts, "digest").select("doc_id", "row_key", "unit", "place", "start", "end", "n_words", (own > F.col("first")).alias("later"), "across", F.col("first.doc_id").alias("first_doc_id"))


def unit_dedup(docs: DataFrame, ends: str = SENTENCES, min_words: int = MIN_WORDS, run_words: int = RUN_WORDS, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """For every row: doc_id, n_units, n_removed, removed_words, removed_chars, spans (start:end of the removed units in
    the original text, code points, comma-joined), sources (the distinct doc_ids that keep them, ascending), repeated_words,
    passage_words and has_passage.

    Units are the sentences of run_words words or more of a line; a line without any is a unit as a whole if it has
    min_words. Units that are equal after normalisation are copies, of which all go but the earliest ranked. repeated_words counts the words of units that another row has too,
    the earliest one included. Repeated units of run_words words or more that follow each other (shorter ones between them
    don't count) form a run; passage_words are those of the run with most words of units that another row has, and
    has_passage tells whether that is passage_words or more.

    Null and empty texts, and units without letters or digits, have no digest. Rows that are equal in doc_id and text are
    one document and give one row. A null doc_id ranks last. Other columns are ignored; an empty table gives an empty result.
    """
    found = cut(units(docs, ends, min_words, run_words))
    every = found.groupBy("doc_id", "row_key").agg((F.max("unit") + 1).cast("long").alias("n_units"))
    of = Window.partitionBy("doc_id", "row_key")
    # A row that occurs twice has each of its units twice; they count once.
    runs = repeated_units(found).repartition("doc_id", "row_key").dropDuplicates(["doc_id", "row_key", "unit"])
    # count skips the short units, so they stand in no run's way; a run of their own (null) is no passage.
    runs = runs.withColumn("run", F.col("place") - F.count("place").over(of.orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)))
    words = F.when(F.col("across"), F.col("n_words")).otherwise(0)
    runs = runs.withColumn("run_across", F.when(F.col("place").isNotNull(), F.sum(words).over(Window.partitionBy("doc_id", "row_key", "run"))))
    gone = F.col("later")
    lost = runs.groupBy("doc_id", "row_key").agg(
        F.array_sort(F.collect_list(F.when(gone, F.struct("start", "end", "n_words")))).alias("cuts"),
        F.array_sort(F.collect_set(F.when(gone, F.col("first_doc_id")))).alias("sources"),
        F.sum(words).alias("repeated_words"),
        F.max("run_across").alias("passage_words"),
    )
    zero = F.lit(0).cast("long")
    lost = lost.withColumns({
        "n_removed": F.size("cuts").cast("long"),
        "removed_words": F.aggregate("cuts", zero, lambda a, s: a + s["n_words"]),
        "removed_chars": F.aggregate("cuts", zero, lambda a, s: a + s["end"] - s["start"]),
    })
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key")).distinct()

    def same(a: str, b: str):
        return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.row_key") == F.col(f"{b}.row_key"))

    joined = rows.alias("r").join(every.alias("e"), same("r", "e"), "left").join(lost.alias("l"), same("r", "l"), "left")
    return joined.select(
        F.col("r.doc_id").alias("doc_id"),
        F.col("r.row_key").alias("row_key"),
        *(F.coalesce(F.col(c), zero).alias(c) for c in ("n_units", "n_removed", "removed_words", "removed_chars")),
        F.concat_ws(",", F.transform("cuts", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))).alias("spans"),
        F.coalesce("sources", F.array().cast("array<long>")).alias("sources"),
        *(F.coalesce(F.col(c), zero).alias(c) for c in ("repeated_words", "passage_words")),
        (F.coalesce("passage_words", zero) >= passage_words).alias("has_passage"),
    )


def remove_spans(text: str, cuts: list[tuple[int, int]]) -> str:
    """text without the given units. A line of which nothing but blanks stays goes with its line end."""
    out, line_start = [], 0
    cuts = sorted(cuts)
    k = 0
    for line in text.split("\n"):
        line_end, at, kept, touched = line_start + len(line), line_start, [], False
        while k < len(cuts) and cuts[k][0] <= line_end:
            start, end = cuts[k]
            kept.append(text[at:start])
            at, touched = min(end, line_end), True
            if end > line_end:
                cuts[k] = (line_end + 1, end)
                break
            k += 1
        kept.append(text[at:line_end])
        rest = "".join(kept)
        if not touched or rest.strip():
            out.append(rest)
        line_start = line_end + 1
    return "\n".join(out)


def dedup_documents(docs: DataFrame, ends: str = SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with repeated units removed from text, all columns kept, and removed_spans: their original offsets.

    removed_spans is null for a row that keeps its whole text. Raises if the documents have a column of that name.
    """
    if "removed_spans" in docs.columns:
        raise ValueError("the documents have a column named removed_spans")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(whole.alias("_doc"), F.col("doc_id").cast("long").alias("_id"), row_key().alias("_row"))
    spans = unit_dedup(docs, ends, min_words).where("n_removed > 0").select(F.col("doc_id").alias("_same"), F.col("row_key").alias("_key"), F.col("spans").alias("removed_spans"))

    @F.pandas_udf("string")
    def without(text, removed):
        import pandas as pd

        return pd.Series([t if r is None or t is None else remove_spans(t, [tuple(map(int, x.split(":"))) for x in r.split(",")]) for t, r in zip(text, removed)], dtype=object)

    text = without("_doc.text", "removed_spans")
    columns = [text.alias(c) if c == "text" else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns]
    return keyed.join(spans, F.col("_id").eqNullSafe(F.col("_same")) & (F.col("_row") == F.col("_key")), "left").select(*columns, "removed_spans")
