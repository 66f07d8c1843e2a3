"""The pipeline against its stages' rules, stated plainly."""

from tests.conftest import SMALL
from tests.llm import brute


def test_pipeline(spark):
    import corpus_pipeline
    from ledgerloom.llm import pii

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(out) <= set(docs) and all(r["round_trip"] for r in out.values())
    groups = {}
    for i, (_, c) in brute.components([(i, r["text"]) for i, r in docs.items()]).items():
        groups.setdefault(c, []).append(i)
    assert all(sum(i in out for i in g) <= 1 for g in groups.values())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaks = {i for i, r in docs.items() if any(t in r["text"] for _, t in items)}
    assert not leaks & set(out)
    clean = [g for g in groups.values() if not leaks & set(g)]
    assert sum(any(i in out for i in g) for g in clean) >= 0.98 * len(clean)
    for i, r in out.items():
        assert r["text"] == pii.redact(docs[i]["text"], pii.find(docs[i]["text"])[1]) and r["n_chars"] == len(r["text"])


def test_stage_names():
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
