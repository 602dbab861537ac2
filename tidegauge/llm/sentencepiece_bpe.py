"""SentencePiece encoding and decoding for merge-type vocabularies (operator 6)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import slices, utf8

SPACE = "▁"
#: Distinct chunks of text in one of a worker's two memories; when the newer is full, it replaces the older.
MEMO = 200_000
#: The rank of a pair that makes no piece.
NEVER = np.iinfo(np.int32).max

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """Pieces, scores and byte ids of a model file whose type is BPE."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        proto = ModelProto.FromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with identity normalisation and leading space marks")
        if any(p.type not in (1, 2, 3, 6) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        if spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models that keep white space and add a leading one")
        self.library = SentencePieceProcessor(model_proto=model)
        self.pieces = [p.piece for p in proto.pieces]
        self.normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.normal):
            raise ValueError("a piece has a space mark after other characters")
        order = {s: r for r, s in enumerate(sorted({-p.score for p in proto.pieces}))}
        self.rank = {p.piece: order[-p.score] for p in proto.pieces if p.type == 1}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == 3}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.shown = [p.piece.replace(SPACE, " ") if p.type == 1 else None for p in proto.pieces]
        self.decimal = [str(i).encode() for i in range(len(proto.pieces))]
        self.eos = self.library.eos_id()
        self._index_pairs()
        # No longer piece has a newline, so merges never cross one; space marks only lead, so merges never cross the place
        # before them either. The text is cut at both, and merges of different chunks keep their own order.
        if any("\n" in p for p in self.normal if len(p) > 1):
            raise ValueError("a piece has a newline among other characters")
        self.chunks = re.compile(" *[^ \n]+| +|\n").findall

    def encode_chunk(self, chunk: str) -> list[int]:
        """Merges adjacent symbols in the order of an agenda: best score first, then the leftmost.

        An entry of the agenda is one number, the rank of the score and the place of the left symbol. One that no longer
        names a pair of that rank is out of date.
        """
        symbols: list[str | None] = list(chunk.replace(" ", SPACE))
        n, rank = len(symbols), self.rank
        if n > 1:
            shift = n.bit_length()
            place = (1 << shift) - 1
            before, after = list(range(-1, n - 1)), list(range(1, n + 1))
            agenda = [(r << shift) | i for i in range(n - 1) if (r := rank.get(symbols[i] + symbols[i + 1])) is not None]
            heapify(agenda)
            while agenda:
                entry = heappop(agenda)
                left = entry & place
                right = after[left]
                if right == n or (a := symbols[left]) is None:
                    continue
                pair = a + symbols[right]
                if rank.get(pair) != entry >> shift:
                    continue
                symbols[left], symbols[right] = pair, None
                follow = after[left] = after[right]
                if follow < n:
                    before[follow] = left
                    if (r := rank.get(pair + symbols[follow])) is not None:
                        heappush(agenda, (r << shift) | left)
                if (lead := before[left]) >= 0 and (r := rank.get(symbols[lead] + pair)) is not None:
                    heappush(agenda, (r << shift) | lead)
        ids = []
        for s in symbols:
            if s is None:
                continue
            if (found := self.normal.get(s)) is not None:
                ids.append(found)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in s.encode()]
            else:
                ids.append(self.unknown)
        return ids

    def _index_pairs(self) -> None:
        """A hash table over all pairs of symbols that merge: key, rank of the score, id of the merged piece."""
        self.symbol = {p: i for p, i in self.normal.items() if len(p) == 1}
        found = {}
        for p, i in self.normal.items():
            for k in range(1, len(p)):
                if (a := self.normal.get(p[:k])) is not None and (b := self.normal.get(p[k:])) is not None:
                    found[(a << 32) | b] = (self.rank[p], i)
        self.bits = max(8, (4 * len(found)).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks, self.merged = np.full(size, -1, np.int64), np.full(size, NEVER, np.int32), np.zeros(size, np.int32)
        for key, (r, i) in found.items():
            at = int(self._slot(np.array([key], np.int64))[0])
            while self.keys[at] != -1:
                at = (at + 1) % size
            self.keys[at], self.ranks[at], self.merged[at] = key, r, i

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair of symbols; NEVER where the pair makes no piece."""
        key = (a.astype(np.int64) << 32) | b
        at = self._slot(key)
        rank, to = np.full(len(key), NEVER, np.int32), np.zeros(len(key), np.int32)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        while len(open_):
            held = self.keys[at[open_]]
            hit = held == key[open_]
            rank[open_[hit]], to[open_[hit]] = self.ranks[at[open_[hit]]], self.merged[at[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return rank, to

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """encode_chunk for many chunks at once.

        A row of a matrix is the agenda of a chunk: the rank of the pair that begins at each place. A round takes the best
        and leftmost pair of every chunk, merges it and looks up the two pairs that change. Long chunks, and those with
        characters that are no piece, go one by one.
        """
        out: list[list[int]] = [[]] * len(chunks)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        for low, high in ((0, 8), (8, 14), (14, 24)):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            if not len(rows):
                continue
            n, size = len(rows), lengths[rows]
            flat = "".join([chunks[i] for i in rows]).replace(" ", SPACE)
            codes = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
            distinct, where = np.unique(codes, return_inverse=True)
            ids = np.array([self.symbol.get(chr(c), -1) for c in distinct], np.int32)[where]
            inside = np.arange(high + 1) < size[:, None]
            s = np.full((n, high + 1), -1, np.int32)
            s[inside] = ids
            plain = ~((s == -1) & inside).any(axis=1)
            rank, to = (x.reshape(n, high) for x in self._pair(s[:, :-1].ravel(), s[:, 1:].ravel()))
            after = np.tile(np.arange(1, high + 2), (n, 1))
            before = np.tile(np.arange(-1, high), (n, 1))
            busy = np.arange(n)
            while len(busy):
                left = rank[busy].argmin(axis=1)
                more = rank[busy, left] != NEVER
                busy, left = busy[more], left[more]
                right = after[busy, left]
                follow = after[busy, right]
                s[busy, left], s[busy, right] = to[busy, left], -2
                rank[busy[right < high], right[right < high]] = NEVER
                after[busy, left] = follow
                ok = follow <= high
                before[busy[ok], follow[ok]] = left[ok]
                beyond = np.where(ok, s[busy, np.minimum(follow, high)], -1)
                rank[busy, left], to[busy, left] = self._pair(s[busy, left], beyond)
                lead = before[busy, left]
                b, le = busy[lead >= 0], lead[lead >= 0]
                rank[b, le], to[b, le] = self._pair(s[b, le], s[b, left[lead >= 0]])
            alive = inside & (s != -2)
            kept, cuts = s[alive].tolist(), np.cumsum(alive.sum(axis=1)).tolist()
            start = 0
            for i, end, good in zip(rows.tolist(), cuts, plain.tolist()):
                out[i] = kept[start:end] if good else self.encode_chunk(chunks[i])
                start = end
        for i in np.flatnonzero(lengths > 24):
            out[i] = self.encode_chunk(chunks[i])
        return out

    def decode_chunk(self, ids: list[int]) -> str:
        """The text of ids; runs of byte pieces are read as UTF-8, with U+FFFD for each byte that isn't."""
        try:
            return "".join([self.shown[i] for i in ids])
        except TypeError:  # a piece that isn't plain text
            pass
        out, run = "", bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            out += _utf8(run)
            run = bytearray()
            out += " ⁇ " if i == self.unknown else "" if i in self.control else self.shown[i]
        return out + _utf8(run)

    def check(self, chunks: list[str], ids: list[list[int]], shown: list[str]) -> None:
        """Raises if the library encodes or decodes one of the chunks in another way.

        The chunks go to the library in one text, each behind a newline, which keeps them apart.
        """
        mark = self.encode_chunk("\n")
        want = [*self.encode_chunk(" "), *chain.from_iterable(chain(mark, i) for i in ids)]
        if self.library.encode("\n" + "\n".join(chunks)) != want or self.library.decode(want) != "\n" + "\n".join(shown):
            for c, i, s in zip(chunks, ids, shown):
                said = self.library.encode("\n" + c)[1 + len(mark) :]
                if said != i or self.library.decode([*mark, *i]) != "\n" + s:
                    raise ValueError(f"the library reads {c!r} as {said}; the agenda gives {i} and {s!r}")
            raise ValueError("the library reads a batch of chunks in another way")


def _utf8(run: bytearray) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = "", 0
        while i < len(run):
            for k in (1, 2, 3, 4):
                try:
                    out += run[i : i + k].decode()
                except UnicodeDecodeError:
                    continue
                i += k
                break
            else:
                out += "\N{REPLACEMENT CHARACTER}"
                i += 1
        return out


class Encoder:
    """Encodes texts chunk by chunk and remembers chunks; each new one is checked against the library."""

    def __init__(self, vocabulary: Vocabulary, memo: int = MEMO):
        self.v, self.size = vocabulary, memo
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}  # chunks that don't decode to themselves

    def _learn(self, chunks: list[str]) -> None:
        seen = [c for c in chunks if c in self.old]
        self.memo.update((c, self.old[c]) for c in seen)
        new = [c for c in chunks if c not in self.memo]
        if new:
            ids = self.v.encode_chunks(new)
            shown = [self.v.decode_chunk(i) for i in ids]
            self.v.check(new, ids, shown)
            decimal = self.v.decimal
            self.memo.update((c, b" ".join([decimal[x] for x in i])) for c, i in zip(new, ids))
            self.odd.update((c, s) for c, s in zip(new, shown) if c != s)

    def __call__(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """For each text the number of ids, the ids as decimals joined by spaces, and the decoded text."""
        chunks = [self.v.chunks(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        distinct = set().union(*chunks)
        if len(self.memo) > self.size:
            self.memo, self.old = {}, self.memo
            self.odd = {c: x for c, x in self.odd.items() if c in self.old}
        self._learn([c for c in distinct if c not in self.memo])
        find, eos = self.memo.__getitem__, str(self.v.eos).encode()
        odd = self.odd.keys() & distinct
        out = []
        for cs in chunks:
            ids = b" ".join([*map(find, cs), eos])
            text = "".join([self.odd.get(c, c) for c in cs] if odd else cs)
            out.append((ids.count(b" ") + 1, ids, text.removeprefix(" ").encode()))
        return out


def ship_model(spark: SparkSession, path: str) -> tuple[str, Broadcast]:
    """The digest of the model file and its bytes (some 500 KB, for all data alike) as a broadcast; the digest names the model."""
    with open(path, "rb") as f:
        data = f.read()
    return hashlib.blake2b(data, digest_size=16).hexdigest(), spark.sparkContext.broadcast(data)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(name: str, data: Broadcast) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(Vocabulary(data.value))
    return _ENCODERS[name]


def encode_documents(docs: DataFrame, model_path: str, full: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; full adds ids (array of int) and decoded (string).

    The text is cut where no merge can cross; each distinct chunk goes through the agenda once per worker and is checked
    against the library in the Arrow batch that first has it. Only an end id is added. Null and empty texts have the end
    id alone and decode to the empty text. Repeated rows are encoded each, other columns are ignored, an empty table gives
    an empty result. A long text is a slice of its own.
    """
    name, data = ship_model(docs.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(name, data)
        for part in slices(batches, max_bytes=4 << 20):
            got = encode([t.decode("utf-8", "replace") for t in part.column("text").to_pylist()])
            sha = lambda x: hashlib.sha256(x).hexdigest()
            columns = [part.column("doc_id"), pa.array([n for n, _, _ in got], pa.int64()), pa.array([sha(i) for _, i, _ in got]), pa.array([sha(d) for _, _, d in got])]
            if full:
                ids = [np.array(i.split(), np.int32) for _, i, _ in got]
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array([d.decode() for _, _, d in got])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * full]
    schema = SCHEMA + ", ids array<int>, decoded string" * full
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(run, schema)
