"""Empty tables and tables whose rows all go, through operators and stages that other tests don't give them."""

from __future__ import annotations

import pytest

from tests.llm.odd import PROSE, SCHEMA
from tidegauge.llm import fuzzy_lines, repetition, secrets


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_operators_on_an_empty_table(none):
    assert repetition.repetition_quality(none).count() == 0
    assert secrets.scan_secrets(none).count() == 0
    assert fuzzy_lines.fuzzy_line_dedup(none, whole=True).count() == 0
    assert fuzzy_lines.fuzzy_line_dedup(none).count() == 0


def test_stages_on_an_empty_table(spark, none):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name, stage in pipeline.STAGES:
        got = stage(spark, none, "")
        assert got.count() == 0, name
        if name != pipeline.STAGES[-1][0]:
            assert sorted(got.columns) == sorted(none.columns), name


def test_a_corpus_of_which_nothing_is_kept(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, None, "en", "src0", None), (2, "", "en", "src0", 0), (3, PROSE, None, None, len(PROSE))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
