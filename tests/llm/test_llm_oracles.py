"""The queries against their SQL on the smallest tables; those without SQL keep to their contract's columns."""
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import compare, connect  # noqa: E402

from tramline.llm.queries import ORACLES, QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op3_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op4_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op5_lm_scoring": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op9_substring_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "has_repeat"},
}


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert compare(con, spark, DATA, QUERIES[name], ORACLES[name]) is None
        return
    out = QUERIES[name](spark, DATA)
    assert COLUMNS[name] <= set(out.columns)
    assert out.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
