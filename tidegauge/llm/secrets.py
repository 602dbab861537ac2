"""Secret scans by patterns and sliding-window entropy (operator 3). DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base patterns. Shorter matches of access and hex can't begin or end elsewhere in their run, so the lengths are in them.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

#: Entropy kinds: name, alphabet of the class, least entropy in bits of some window. A window of WINDOW characters has at
#: most log2(min(WINDOW, size of the alphabet)) bits.
WINDOW = 20
HEX_CHARS = "0123456789abcdef"
TOKEN_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
HEX_BITS = 3.0
TOKEN_BITS = 3.7

#: A candidate that has one of these is no secret: placeholders near its start (elsewhere a long random run has them by chance),
#: hashes that say so, numbers.
ALLOWED = (
    r"(?i)^.{0,40}(?:example|placeholder|changeme|dummy|redacted|xxxx|lorem)"
    r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    r"|(?i)^(?:sha(?:1|224|256|384|512)|md5)[-_]"
    r"|^[0-9_/+-]+$"
)
#: Paths and identifiers: letters and signs whose case turns upwards no more than once in so many characters.
NAMES = r"^[A-Za-z_/-]+$"
NAME_CHARS = 4

#: Windows that begin in one piece of a candidate, and matches whose offsets are summed together. Neither changes a result:
#: they keep a step's cost the same however long a candidate or a text is.
PIECE = 256


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches; offsets are code points.

    split() gives what lies between the matches that regexp_extract_all() gives, so their lengths give the offsets. They are
    summed within blocks of matches, and the totals of the blocks over the text.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), values.alias("value"))
    nothing = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def add(acc: Column, pair: Column) -> Column:
        at = acc["at"] + F.length(pair["gap"])
        end = at + F.length(pair["value"])
        return F.struct(end.alias("at"), F.array_append(acc["found"], F.struct(at.alias("start"), end.alias("end"), pair["value"].alias("value"))).alias("found"))

    def block(some: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), nothing.alias("found"))
        return F.aggregate(some, start, lambda a, p: F.when(p["value"].isNull(), a).otherwise(add(a, p)))

    def shift(acc: Column, some: Column) -> Column:
        moved = F.transform(some["found"], lambda m: F.struct((m["start"] + acc["at"]).alias("start"), (m["end"] + acc["at"]).alias("end"), m["value"].alias("value")))
        return F.struct((acc["at"] + some["at"]).alias("at"), F.array_append(acc["parts"], moved).alias("parts"))

    # transform over a one-element array binds the pairs once.
    bound = F.transform(F.array(pairs), lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / PIECE).cast("int")), lambda b: block(F.slice(all_, b * PIECE + 1, PIECE))))
    whole = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,value:string>>>").alias("parts"))
    return F.aggregate(F.get(bound, F.lit(0)), whole, shift, lambda a: F.flatten(a["parts"]))


def _count(counts: Column, place: Column) -> Column:
    """The count at a place (from 1) of counts, which has a character from "@" (0) on for each place."""
    return F.ascii(F.substr(counts, place, F.lit(1))) - ord("@")


def _with_count(counts: Column, place: Column, count: Column) -> Column:
    return F.overlay(counts, F.char(count + ord("@")), place, F.lit(1))


def window_entropy(value: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of the windows of value; characters outside the alphabet count as one class.

    The count of each character in the window and the sum of n * log2(n) over the counts n are kept: a step raises the
    count of the character that enters, lowers that of the one that leaves, and adjusts the sum by these two alone. The
    counts of a window of 60 characters at most fit a string of one character for each count. Values shorter than a window
    are one window. Long values are cut into pieces that overlap by a window, so a step reads a short string.
    """
    if window > 60:
        raise ValueError(f"windows of {window} characters: counts hold 60 at most")
    logs = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])
    others = "[^" + "".join(c if c.isalnum() else "\\" + c for c in alphabet) + "]"
    plain = F.regexp_replace(value, others, " ")
    pieces = F.regexp_extract_all(plain, F.lit(f"(?s)(?=(.{{1,{PIECE + window - 1}}})).{{1,{PIECE}}}"), F.lit(1))

    def change(times: Column, by: int) -> Column:
        return F.get(logs, times + by) - F.get(logs, times)

    def place(piece: Column, i: Column) -> Column:
        return F.position(F.substr(piece, i, F.lit(1)), F.lit(alphabet)) + 1

    def bind(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def least(piece: Column, width: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            def enter(at: Column) -> Column:
                return bind(_count(acc["counts"], at), lambda n: F.struct((acc["sum"] + change(n, 1)).alias("sum"), _with_count(acc["counts"], at, n + 1).alias("counts")))

            def leave(now: Column, at: Column) -> Column:
                return bind(_count(now["counts"], at), lambda n: F.struct((now["sum"] + change(n, -1)).alias("sum"), _with_count(now["counts"], at, n - 1).alias("counts")))

            entered = bind(place(piece, i), enter)
            moved = bind(entered, lambda now: F.when(i <= width, now).otherwise(bind(place(piece, i - width), lambda at: leave(now, at))))
            best = lambda s: F.when(i >= width, F.least(acc["least"], s["sum"])).otherwise(acc["least"])
            return bind(moved, lambda s: F.struct(s["sum"].alias("sum"), best(s).alias("least"), s["counts"].alias("counts")))

        start = F.struct(F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"), F.lit("@" * (len(alphabet) + 1)).alias("counts"))
        return F.aggregate(F.sequence(F.lit(1), F.length(piece)), start, step, lambda a: a["least"])

    # transform over a one-element array binds the width once: a long value isn't measured anew at every step.
    widths = F.array(F.least(F.length(value), F.lit(window)))
    best = F.transform(widths, lambda w: F.log2(w.cast("double")) - F.array_min(F.transform(pieces, lambda p: least(p, w))) / w)
    return F.when(F.length(value) > 0, F.get(best, F.lit(0))).otherwise(0.0)


def reads_as_name(value: Column) -> Column:
    """Whether value is a path or an identifier by its characters and the turns of its case."""
    turns = F.length(value) - F.length(F.regexp_replace(value, "(?<=[a-z])[A-Z]", ""))
    return value.rlike(NAMES) & (turns * NAME_CHARS <= F.length(value))


def _spans(found: Column, kind: str, order: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, window: int = WINDOW, hex_bits: float = HEX_BITS, token_bits: float = TOKEN_BITS, allowed: str = ALLOWED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy_hex and n_entropy_token of every row.

    Base spans come from the patterns. An entropy span is a run of window characters or more of one class (hex digits or
    token characters) of which some window has at least that many bits, which is neither in the allow list nor a path or an
    identifier, and which no base span and no earlier entropy kind overlaps. spans has all, by start, then kind.

    Null and empty texts have no spans (base_sha256 of the empty string). Repeated rows are scanned each; a null doc_id stays
    null; other columns are ignored; an empty table gives an empty result. Rows are independent: there is no shuffle, and a
    long text is one row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def found(pattern: str, hint: str) -> Column:
        return F.when(F.col("text").rlike(hint), matches(F.col("text"), pattern)).otherwise(none)

    token = f"[A-Za-z0-9+/_-]{{{window},}}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select(
        "doc_id",
        F.filter(found(ASSIGN, ASSIGN_HINT), lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= ASSIGN_LEAST).alias("assign"),
        found(ACCESS, "AKIA[A-Z0-9]{16}").alias("access"),
        found(HEX, "[0-9a-f]{24}").alias("hex"),
        found(f"[0-9a-f]{{{window},}}", f"[0-9a-f]{{{window}}}").alias("hex_runs"),
        found(token, f"[A-Za-z0-9+/_-]{{{window}}}").alias("token_runs"),
    )
    base = F.concat(_spans(F.col("assign"), "assign", 0), _spans(F.col("access"), "access", 1), _spans(F.col("hex"), "hex", 2))

    def strange(runs: str, taken: Column, alphabet: str, bits: float) -> Column:
        apart = F.filter(runs, lambda m: ~F.exists(taken, lambda t: (t["start"] < m["end"]) & (m["start"] < t["end"])))
        named = F.filter(apart, lambda m: ~m["value"].rlike(allowed) & ~reads_as_name(m["value"]))
        return F.filter(named, lambda m: window_entropy(m["value"], alphabet, window) >= bits)

    rows = rows.withColumn("base", base)
    rows = rows.withColumn("entropy_hex", _spans(strange("hex_runs", F.col("base"), HEX_CHARS, hex_bits), "entropy_hex", 3))
    rows = rows.withColumn("entropy_token", _spans(strange("token_runs", F.concat("base", "entropy_hex"), TOKEN_CHARS, token_bits), "entropy_token", 4))
    return rows.select(
        "doc_id",
        *(F.size(c).cast("long").alias(f"n_{c}") for c in ("assign", "access", "hex")),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "entropy_hex", "entropy_token")).alias("spans"),
        *(F.size(c).cast("long").alias(f"n_{c}") for c in ("entropy_hex", "entropy_token")),
    )
