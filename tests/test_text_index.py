"""Stems by published pairs, and the stored index against one built at once."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.stemming import index_term, porter
from ledgerloom.operators import search
from ledgerloom.sources import text_index

# The examples of the published algorithm (word and stem after all steps).
PAIRS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss
fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal
electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust
dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
generalizations gener oscillators oscil""".split()


@pytest.mark.parametrize("word, stem", list(zip(PAIRS[::2], PAIRS[1::2], strict=True)))
def test_published_pairs(word, stem):
    assert porter(word) == stem


def test_terms():
    assert (index_term("Éé".lower()), index_term("by"), index_term("x1s"), index_term("naïvely"), index_term("日本")) == ("ee", "by", "x1s", "naiv", "日本")


def docs(spark, *rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


ROWS = [(1, "Running runners ran"), (2, "the cat runs, the dog sleeps"), (3, None), (4, "a catalogue of cats and Éclairs"), (5, "dogs run after cats; after dogs run cats"), (6, "")]
QUERIES = ["run", "cats", "cat OR dog", '"dogs run"', "cat*", "eclair", "running dog", "c*", "absent", "", '"after dogs"']


def test_batches_replacements_and_deletes_equal_one_index(spark, tmp_path):
    once = text_index.TextIndex(spark, str(tmp_path / "once"))
    once.add(docs(spark, *ROWS))
    grown = text_index.TextIndex(spark, str(tmp_path / "grown"))
    grown.add(docs(spark, (1, "other words run"), (2, "x"), (7, "run run cats dogs"), (None, "run"), (6, "was here")))
    grown.add(docs(spark, *ROWS[:3], *ROWS[:3], (8, "cats")))
    grown.delete(docs(spark, (7, ""), (8, ""), (99, "")).select("doc_id"))
    state = grown.add(docs(spark, *ROWS[3:]))
    whole = once.commits.latest()[1]
    assert (state["documents"], state["words"]) == (whole["documents"], whole["words"]) == (6, 23)
    found = lambda index, q: [(r["doc_id"], round(r["score"], 12)) for r in index.search(q).collect()]
    want = {q: found(once, q) for q in QUERIES}
    assert {i for i, _ in want["run"]} == {1, 2, 5} and {i for i, _ in want['"dogs run"']} == {5} and {i for i, _ in want["cat*"]} == {2, 4, 5} and want["eclair"][0][0] == 4 and want["absent"] == want[""] == []
    assert {q: found(grown, q) for q in QUERIES} == want
    merged = grown.merge()
    assert len(merged["segments"]) == 1 and {q: found(grown, q) for q in QUERIES} == want
    grown.add(docs(spark, (9, "run")))
    assert {i for i, _ in found(grown, "run")} == {1, 2, 5, 9}
    before = found(grown, "cat*")
    assert grown.vacuum() == 0 and found(grown, "cat*") == before
    empty = text_index.TextIndex(spark, str(tmp_path / "empty"))
    assert empty.search("run").count() == 0


def test_a_query_reads_its_terms_only(spark, tmp_path):
    index = text_index.TextIndex(spark, str(tmp_path / "i"))
    index.add(spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("common"), F.concat(F.lit("w"), "id")).alias("text")))
    plan = index.postings(index.commits.latest()[1], ["common"])._jdf.queryExecution().toString()
    assert "EqualTo(term,common)" in plan and "bucket" in plan[plan.index("PartitionFilters") : plan.index("PartitionFilters") + 300]


def test_rank_of_the_old_index_is_unchanged(spark):
    postings, lengths = search.build_index(docs(spark, *ROWS))
    assert [r["doc_id"] for r in search.search(postings, lengths, "run OR dog").collect()] and search.search(postings, lengths, "").count() == 0


def test_postings_are_made_within_documents(spark, tmp_path, monkeypatch):
    """No row a word leaves a task: neither words are exploded nor is anything but documents dealt anew; slices of any size give the same."""
    seen = {}
    monkeypatch.setattr(text_index.TextIndex, "_write", lambda self, part, table, rows, write=text_index.TextIndex._write: (seen.__setitem__(table, rows), write(self, part, table, rows))[1])
    index = text_index.TextIndex(spark, str(tmp_path / "i"))
    index.add(docs(spark, *ROWS, (9, "x" * 3000 + " é É e"), (10, " ".join(["b", "a"] * 40))))
    plan = seen["postings"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 1 and index.search("run").count() == 3
    words = spark.createDataFrame([(i, (t or "").lower().replace(",", "").replace(";", "").split()) for i, t in ROWS] + [(10, ["b", "a"] * 40)], "doc_id long, words array<string>").collect()
    want = sorted((index_term(w), r["doc_id"], len(at), at, len(r["words"])) for r in words for w in {*map(index_term, r["words"])} for at in [[i for i, x in enumerate(r["words"]) if index_term(x) == w]])
    batch = text_index.pa.RecordBatch.from_pylist([r.asDict() for r in words], schema=text_index.pa.schema([("doc_id", "int64"), ("words", text_index.pa.list_(text_index.pa.string()))]))
    for size in (1, 7, 500):
        monkeypatch.setattr(text_index, "AT_ONCE", size)
        assert sorted(tuple(r.values()) for b in text_index._postings(iter([batch])) for r in b.to_pylist()) == want
