"""Rows that every operator on documents must take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, g string, key string, tokens string, domain string, digest string, _row string, `end` string"
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree beside the river"


def odd_docs(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    texts = [None, "", " ", "\n\n\n", "a", PROSE, PROSE, PROSE.upper(), f"{PROSE}\n{PROSE}\n{PROSE}", long, "é中😀\x00▁ \t\r\x0b\x0c end", "x" * 20_000, "1" * 5_000 + "@" * 300 + "+" * 300]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(5, PROSE, "en", None, len(PROSE)), (None, PROSE, None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, *["clash"] * 8) for r in rows], SCHEMA)
