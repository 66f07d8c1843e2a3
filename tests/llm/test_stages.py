"""Each stage by itself on awkward rows and on nothing."""

import pytest

from ledgerloom.llm import stages
from tests.conftest import SMALL

COLUMNS = list(stages.DOCUMENT_COLUMNS)
STAGES = [stages.keep_known_language, stages.keep_one_of_each_group, stages.drop_contaminated, stages.redact_private_data, stages.encode_tokens]


@pytest.fixture(scope="module")
def rows(awkward):
    return awkward.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) n_chars", "ids", "kept", "decoded")


@pytest.mark.parametrize("stage", STAGES)
def test_nothing(spark, rows, stage):
    out = stage(spark, rows.where("false"), SMALL)
    assert out.columns[:5] == COLUMNS and out.count() == 0


def test_awkward_rows(spark, rows):
    told = stages.keep_known_language(spark, rows, SMALL)
    assert told.columns == COLUMNS and all((r["text"] or "").strip() for r in told.collect())
    one = stages.keep_one_of_each_group(spark, rows, SMALL)
    assert sorted(str(r["doc_id"]) for r in one.collect()) == sorted(["1", "3", "4", "5", "6", "7", "8", "None", "None"])
    assert stages.drop_contaminated(spark, rows, SMALL).count() == 12
    clean = stages.redact_private_data(spark, rows, SMALL).collect()
    assert len(clean) == 12 and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in clean) and sum(r["text"] is None for r in clean) == 2
    out = stages.encode_tokens(spark, rows, SMALL).collect()
    assert len(out) == 12 and all(r["round_trip"] for r in out) and all(r["n_tokens"] == 0 for r in out if not r["text"])
