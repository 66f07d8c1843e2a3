import pytest

LONG = "lorem ipsum dolor " * 4000
PASSAGE = " ".join(f"w{i}" for i in range(60))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with the operators' own names."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a"), (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a"), (2, "The QUICK brown fox jumps over the lazy dog and runs away", None, None),
        (None, "no id here but some words", "en", None), (3, None, "en", "a"), (4, "", None, "b"), (5, " \n\t ", "de", "b"), (6, LONG, "en", "b"), (7, "one two", "en", "b"), (8, f"x y z {PASSAGE} end", "en", "c"), (9, f"{PASSAGE} tail é ß 😀", "en", "c"), (None, None, None, None),
    ]
    extra = "ids string, spans string, component_id string, kept string, matches string, n_words string, lang_pred string, shard string, h string, decoded string"
    return spark.createDataFrame([(*r, *["?"] * 10) for r in rows], f"doc_id long, text string, lang string, source string, {extra}")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")
