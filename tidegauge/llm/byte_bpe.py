"""Byte-level BPE encoding and decoding by a replay of all merges over the corpus's distinct words (operator 11)."""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, slices, utf8

#: Words that are replayed once for the whole corpus: those of at most so many characters that most slices have, up to a number.
SHARED_CHARS = 32
SHARED_WORDS = 100_000
#: Bytes of text whose words are looked at together, and bytes of words that are replayed together.
SLICE_BYTES = 4 << 20
REPLAY_BYTES = 8 << 20
#: From so many places on, a rank's merges are one step over arrays.
TOGETHER = 8
#: Characters of the chunks that a worker remembers, in each of two memories; longer chunks are encoded where they occur.
MEMO_CHUNK = 48
MEMO_CHARS = 4 << 20

#: White space by Unicode, and the cuts made before the pattern sees the text: before white space that follows another
#: character, and before the last white space of a run that another character follows. Byte-level patterns cut there too.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNKS = f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]"

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Ranks:
    """Byte strings by rank; the rank is the id."""

    def __init__(self, data: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.shown = {r: t for t, r in self.rank.items()}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("every single byte needs a rank")
        self.shift = max(self.shown).bit_length()
        #: The rank of what two neighbouring symbols make, by both ids in one number; the same by two bytes as a table.
        self.pair = {(x << self.shift) | y: r for t, r in self.rank.items() for k in range(1, len(t)) if (x := self.rank.get(t[:k])) is not None and (y := self.rank.get(t[k:])) is not None}
        self.keys = np.array(sorted(self.pair))
        self.made = np.array([self.pair[k] for k in self.keys.tolist()])
        #: Ranks whose symbol may take part in a pair of lower rank; none in most trained tables.
        self.early = {x for k, r in self.pair.items() for x in (k >> self.shift, k & ((1 << self.shift) - 1)) if r < x}
        self.single = np.array([self.rank[bytes([b])] for b in range(256)])
        self.double = np.full((256, 256), -1)
        for t, r in self.rank.items():
            if len(t) == 2:
                self.double[t[0], t[1]] = r

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word: all merges in the order of their ranks, each at all its places in all words at once.

        The words lie in one array of symbols. An inverted index has the places of every pair by the rank of what the pair
        makes; a heap has the ranks that occur. A rank's places are merged from left to right, and only the pairs with the
        new symbol's two neighbours enter the index. A place whose pair is gone or has changed is passed over. A word that
        is a token itself needs no merges.

        A merge may make a pair of lower rank than its own, which in its word comes before the rank's other places. Such a
        word, rare or none with trained ranks, is encoded alone.
        """
        out: list = [None if (r := self.rank.get(w)) is None else [r] for w in words]
        todo = [i for i, ids in enumerate(out) if ids is None and words[i]]
        if not todo:
            return [ids or [] for ids in out]
        # A word's symbols are ids, -1 where one has been merged away and in the place behind each word.
        sizes = np.array([len(words[i]) for i in todo])
        first = np.append(0, np.cumsum(sizes + 1))
        flat = np.frombuffer(b"\0".join([*(words[i] for i in todo), b""]), np.uint8)
        start, inside = self.single[flat], np.ones(len(flat), bool)
        inside[first[1:] - 1] = False
        start[~inside] = -1
        now_at = np.full(len(flat), -1)
        now_at[:-1] = np.where(inside[:-1] & inside[1:], self.double[flat[:-1], flat[1:]], -1)
        places = np.argsort(now_at, kind="stable")[int((now_at < 0).sum()) :]
        cuts = np.flatnonzero(np.diff(now_at[places], prepend=-1)).tolist()
        index: dict[int, list[int]] = defaultdict(list)
        for a, b in zip(cuts, [*cuts[1:], len(places)]):
            index[int(now_at[places[a]])] = places[a:b].tolist()
        heap = list(index)  # ascending, so a heap
        links = np.arange(-1, len(flat) - 1), np.arange(1, len(flat) + 1)
        # The same memory for loops over few places and for steps over many.
        symbols, makes, before, after = (memoryview(x) for x in (start, now_at, *links))
        pair, shift, odd = self.pair.get, self.shift, []
        while heap:
            now = heappop(heap)
            places = index.pop(now, ())
            if len(places) >= TOGETHER and now not in self.early and self._merge_together(now, places, start, now_at, *links, index, heap):
                continue
            for left in sorted(places):
                if makes[left] != now:
                    continue
                right = after[left]
                follow = after[left] = after[right]
                symbols[left], symbols[right], makes[right], before[follow] = now, -1, -1, left
                r = -1 if (c := symbols[follow]) < 0 else pair(now << shift | c, -1)
                makes[left] = r
                if r >= 0:
                    if r not in index:
                        heappush(heap, r)
                    index[r].append(left)
                    if r < now:
                        odd.append(left)
                lead = before[left]
                if lead >= 0 and (c := symbols[lead]) >= 0:
                    makes[lead] = r = pair(c << shift | now, -1)
                    if r >= 0:
                        if r not in index:
                            heappush(heap, r)
                        index[r].append(lead)
                        if r < now:
                            odd.append(left)
        alive = start >= 0
        ids, upto = start[alive].tolist(), np.append(0, np.cumsum(alive))[first].tolist()
        for i, a, b in zip(todo, upto, upto[1:]):
            out[i] = ids[a:b]
        for k in set((np.searchsorted(first, odd, side="right") - 1).tolist()) if odd else ():
            out[todo[k]] = self.encode_alone(words[todo[k]])
        return [x or [] for x in out]

    def _makes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What neighbouring symbols make, -1 for nothing."""
        key = (a << self.shift) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.made[at], -1)

    def _merge_together(self, now: int, places: list[int], symbols, makes, before, after, index: dict[int, list[int]], heap: list[int]) -> bool:
        """One rank's merges at many places in one step; False, with nothing done, where places overlap (aaa)."""
        left = np.unique(places)
        left = left[makes[left] == now]
        right = after[left]
        if (right[:-1] == left[1:]).any():
            return False
        follow = after[right]
        after[left] = follow
        before[follow] = left
        symbols[left], symbols[right], makes[right] = now, -1, -1
        makes[left] = self._makes(symbols[left], symbols[follow])
        lead = before[left]
        lead = lead[(lead >= 0) & (symbols[lead] >= 0)]
        makes[lead] = self._makes(symbols[lead], np.full(len(lead), now))
        touched = np.concatenate([left, lead])
        made = makes[touched]
        order = np.argsort(made, kind="stable")[int((made < 0).sum()) :]
        cuts = np.flatnonzero(np.diff(made[order], prepend=-1)).tolist()
        ranks, sorted_places = made[order][cuts].tolist(), touched[order].tolist()
        for r, a, b in zip(ranks, cuts, [*cuts[1:], len(order)]):
            if r not in index:
                heappush(heap, r)
            index[r] += sorted_places[a:b]
        return True

    def encode_alone(self, word: bytes) -> list[int]:
        """One word by the definition: the lowest rank, leftmost, again and again."""
        parts = [bytes((b,)) for b in word]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, len(self.rank)) for a, b in zip(parts, parts[1:])]
            i = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[i] == len(self.rank):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.shown[i] for i in ids])


class Splitter:
    """Cuts a text into chunks, and chunks into the words that are encoded separately: the matches of a pattern."""

    def __init__(self, pattern: str, chunks: str | None = CHUNKS):
        import regex

        self.words = regex.compile(pattern).findall
        self.chunks = re.compile(chunks).findall if chunks else lambda text: [text]


class Encoder:
    """Encodes texts through their distinct chunks; words that are new to the worker are replayed together."""

    def __init__(self, ranks: Ranks, splitter: Splitter, shared: dict[str, list[int]], memo: int = MEMO_CHARS):
        self.ranks, self.splitter, self.shared, self.size = ranks, splitter, shared, memo
        self.decimal = {i: b"%d" % i for i in ranks.shown}
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def word_ids(self, words: list[str]) -> list[list[int]]:
        """The ids of distinct words: of the shared table, or by a replay of at most REPLAY_BYTES (or one word) at a time."""
        out = [self.shared.get(w) for w in words]
        new: list[int] = []
        size = 0
        for i in [i for i, ids in enumerate(out) if ids is None] + [-1]:
            if new and (i < 0 or size >= REPLAY_BYTES):
                for k, ids in zip(new, self.ranks.replay([words[k].encode() for k in new])):
                    out[k] = ids
                new, size = [], 0
            if i >= 0:
                new.append(i)
                size += 4 * len(words[i])
        return out

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids in decimal of the chunks that aren't remembered; the long ones are only returned.

        The ids of every word are decoded here, and must give the word again.
        """
        found = {c: x for c in chunks if (x := self.old.get(c)) is not None} if self.old else {}
        new = [c for c in chunks if c not in found]
        split = list(map(self.splitter.words, new))
        words = list(set().union(*split))
        ids = self.word_ids(words)
        if self.ranks.decode(chain.from_iterable(ids)) != "".join(words).encode():
            raise ValueError("ids don't decode to their words")
        of = self.decimal.__getitem__
        decimal = {w: b" ".join(map(of, x)) for w, x in zip(words, ids)}.__getitem__
        for c, ws in zip(new, split):
            found[c] = decimal(ws[0]) if len(ws) == 1 else b" ".join(map(decimal, ws))
        short = {c: x for c, x in found.items() if len(c) <= MEMO_CHUNK}
        self.memo.update(short)
        self.held += sum(map(len, short))
        return {c: x for c, x in found.items() if len(c) > MEMO_CHUNK}

    def __call__(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """For each text the number of ids, the ids as decimals joined by blanks, and the decoded bytes.

        A chunk's words make up the chunk, so what a text's ids decode to is its chunks.
        """
        # A slice makes many small lists and no cycles; the cycle collector would walk them again and again.
        gc.disable()
        try:
            return self._encoded(texts)
        finally:
            gc.enable()

    def _encoded(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        if self.held > self.size:
            self.memo, self.old, self.held = {}, self.memo, 0
        chunks = [self.splitter.chunks(t) for t in texts]
        distinct = set().union(*chunks)
        long = self.learn({c for c in distinct if c not in self.memo})
        find = ({c: self.memo[c] for c in distinct if c not in long} | long if long else self.memo).__getitem__
        out = []
        for cs in chunks:
            ids = b" ".join(map(find, cs))
            out.append((ids.count(b" ") + 1 if ids else 0, ids, "".join(cs).encode()))
        return out


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t.decode("utf-8", "replace") for t in batch.column("text").to_pylist()]


def shared_words(docs: DataFrame, data: Broadcast, pattern: str, chunks: str | None, most: int = SHARED_WORDS) -> dict[str, list[int]]:
    """The words that most slices of the corpus have, with their ids; at most `most`, each of at most SHARED_CHARS.

    Words are counted once for each slice of text that has a chunk with them twice, and the counts added by key. The least count is that at which no more
    than `most` words are left, by the numbers of words between powers of two; so the collected table has a fixed bound.
    Each word is replayed in the task that has its hash. All other words are left to the slices.
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(pattern, chunks)
        for part in slices(batches, max_bytes=SLICE_BYTES):
            times = Counter(chain.from_iterable(map(split.chunks, _texts(part))))
            found = set().union(*(split.words(c) for c, n in times.items() if n > 1))
            short = [w for w in found if len(w) <= SHARED_CHARS]
            yield pa.RecordBatch.from_arrays([pa.array(short, pa.string())], names=["word"])

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(data.value)
        for batch in batches:
            ids = ranks.replay([w.encode() for w in batch.column("word").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    counted = cut(docs.mapInArrow(distinct, "word string").groupBy("word").agg(F.count("*").alias("n")).where("n > 1"))
    levels = counted.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("words")).collect()
    least, room = None, most
    for r in sorted(levels, key=lambda r: -r["level"]):
        if (room := room - r["words"]) < 0:
            break
        least = 2 ** r["level"]
    if least is None:
        return {}
    kept = counted.where(F.col("n") >= least).select("word").mapInArrow(replayed, "word string, ids array<int>")
    return {r["word"]: list(r["ids"]) for r in kept.collect()}


def ship(spark: SparkSession, path: str) -> Broadcast:
    """The bytes of a rank file, one size for all data, as a broadcast."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


#: The encoder of the last call that this worker took part in.
_LAST: dict[str, Encoder] = {}


def _encoder(call: str, data: Broadcast, pattern: str, chunks: str | None, shared: Broadcast) -> Encoder:
    if call not in _LAST:
        _LAST.clear()
        _LAST[call] = Encoder(Ranks(data.value), Splitter(pattern, chunks), shared.value)
    return _LAST[call]


def encode_bytes(docs: DataFrame, ranks_path: str, pattern: str, chunks: str | None = CHUNKS, full: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; full adds ids (array of int) and decoded (binary).

    Each match of the pattern is encoded separately by the ranks, without special tokens. The words that many slices share
    are replayed once for the corpus and go to the workers as a table of bounded size; all others are replayed in the slice
    that has them, together with the slice's other new words. chunks, a pattern that cuts a text only where `pattern` cuts it
    too, saves work; None does without. It must not lose a character.

    Null and empty texts have no ids and decode to nothing. Repeated rows are encoded each, other columns are ignored, an
    empty table gives an empty result. A long text is a slice of its own.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    data, call = ship(spark, ranks_path), uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(shared_words(rows.select("text"), data, pattern, chunks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(call, data, pattern, chunks, shared)
        for part in slices(batches, max_bytes=SLICE_BYTES):
            got = encode(_texts(part))
            sha = lambda x: hashlib.sha256(x).hexdigest()
            columns = [part.column("doc_id"), pa.array([n for n, _, _ in got], pa.int64()), pa.array([sha(i) for _, i, _ in got], pa.string()), pa.array([sha(d) for _, _, d in got], pa.string())]
            if full:
                columns += [pa.array([np.array(i.split(), np.int32) for _, i, _ in got], pa.list_(pa.int32())), pa.array([d for _, _, d in got], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * full]
    return rows.mapInArrow(run, SCHEMA + ", ids array<int>, decoded binary" * full)
