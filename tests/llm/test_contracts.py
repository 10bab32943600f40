"""The queries of the trained operators and of extraction over the smallest tables: rows, columns, types, folds."""

import os

import pytest

from quarry.llm.queries import QUERIES
from quarry.session import table
from tests.llm.helpers import crc

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")

COLUMNS = {
    "op1_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op5_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op8_ngram_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op9_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
}
FOLDS = {"op1_language_id": (3, 1), "op2_lm_scoring": (10, 0), "op5_quality_classifier": (5, 0), "op6_toxicity": (5, 0)}


@pytest.mark.parametrize("name", COLUMNS)
def test_contract(spark, name):
    found = QUERIES[name](spark, SF)
    types = dict(found.dtypes)
    for column in COLUMNS[name].split(", "):
        column, kind = column.split()
        assert types[column] == kind
    rows = found.collect()
    key = "page_id" if "op7" in name else "doc_id"
    source = table(spark, SF, "pages" if "op7" in name else "documents")
    assert sorted(r[key] for r in rows) == sorted(r[0] for r in source.select(key).collect())
    if name in FOLDS:
        fold, remainder = FOLDS[name]
        assert all(r["held_out"] == (crc(r["doc_id"], fold) == remainder) for r in rows)
    if "predicted" in types:
        cut = 0.3 if "op5" in name else 0.5
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in rows)
    if "op1" in name:
        langs = {r[0] for r in source.select("lang").distinct().collect()}
        assert all(0 <= r["score"] <= 1 and r["lang_pred"] in langs | {"und"} for r in rows)
    if "op2" in name:
        assert len({r["train_tokens"] for r in rows}) == 1 and all(0 <= r["n_known"] <= r["n_tokens"] and r["score"] < 0 for r in rows)
    if "op7" in name:
        assert all(len(r["text"]) == r["n_chars"] for r in rows)
