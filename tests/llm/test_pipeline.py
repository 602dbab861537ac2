"""The pipeline by stages and as a whole."""

from __future__ import annotations

from pathlib import Path

import pytest

from tests.llm.test_ops import SMALL, groups_by_force, repeats_by_force
from tidegauge.llm import queries

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, SMALL).write.parquet(out)
        seen[name], docs = docs, spark.read.parquet(out)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert sorted(docs.columns) == sorted(columns)
    before = [(r["doc_id"], r["text"]) for r in seen["quality"].collect()]
    kept = {r["doc_id"] for r in seen["line_dedup"].collect()}
    for d, t in before:
        n, _, _, _, r3, r10, longest = repeats_by_force(t)
        assert (d in kept) == (n >= 50 and 100 * r3 <= 50 * n and r10 <= 0.3 * n and longest <= 200)
    rows = [(r["doc_id"], r["text"]) for r in seen["near_dedup"].collect()]
    assert {r["doc_id"] for r in seen["mix"].collect()} == {c for _, _, c in groups_by_force(rows)}
    assert seen["tokenize"].count() == docs.count() == corpus_pipeline.run(spark, SMALL).count()


def test_queries_are_whole(spark):
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert not (Path(queries.__file__).parent / "data").exists()
