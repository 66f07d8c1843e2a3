"""Conversation repair, word BPE and hard negatives against brute force or the library, and on awkward rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import conversation_repair, hard_negatives, queries, word_bpe
from ledgerloom.llm.oracles import ORACLES
from tests.conftest import SMALL, SMALL_LEDGER
from tests.llm import brute
from tests.llm.conftest import LONG

P = pytest.importorskip("public_tokenizers")
WORDS = P.path("word_bpe_49k.json")
CHATS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def _repairs(chats):
    return {r[0]: (*tuple(r)[1:8], hashlib.sha256(r["repaired"].encode()).hexdigest()) for r in conversation_repair.repair(conversation_repair.damage(chats)).collect()}


def test_repair_of_the_table(spark, duck):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL_LEDGER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_conversation_repair(spark, SMALL_LEDGER)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute.repairs(rows)
    want = duck(SMALL_LEDGER).sql(ORACLES["op11_conversation_repair"])
    assert want.columns == got.columns and {tuple(r) for r in want.fetchall()} == {tuple(r) for r in got.collect()}


def test_repair_of_awkward_conversations(spark):
    """Nulls everywhere, unknown roles, repeated turns, rows of one turn number, conversations that lose every row."""
    r = random.Random(5)
    rows = [(r.choice([None, *range(400)]), r.choice([None, *range(9)]), r.choice(["user", "assistant", "system", "tool", None, "User", "summary"]), r.choice(["a.", "a", "b?", "", None, " \n", "c! ", "d\x0b", "é。"])) for _ in range(3000)]
    rows += [(1000 + i, 0, "user", "only") for i in range(60)] + [(2000, i, "user" if i % 3 else "assistant", f"turn {i} " + "x" * (i % 50)) for i in range(700)]
    want = brute.repairs(rows)
    assert any(v[6] == "" for v in want.values())
    assert _repairs(spark.createDataFrame(rows, CHATS).withColumn("fault", F.lit("?")).withColumn("n", F.lit(1)).withColumn("live", F.lit(None).cast("string"))) == want
    assert _repairs(spark.createDataFrame([], CHATS)) == {}
    long = [(1, 0, "user", LONG + "."), (1, 1, "assistant", LONG), (1, 1, "assistant", LONG)]
    assert _repairs(spark.createDataFrame(long, CHATS)) == brute.repairs(long)


def test_repair_takes_the_least_of_equal_audits():
    cost, audit = brute.repaired([(1, 0, "user", "a."), (1, 1, "assistant", "b."), (1, 2, "assistant", "c")])[5:7]
    assert (cost, audit) == (3, "KKD")  # inserting a user and keeping the truncated row costs 3 too


def test_word_bpe_equals_the_library(spark, library):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, t in docs:
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r[0]: tuple(r)[1:] for r in queries.op12_word_bpe(spark, SMALL).collect()} == want


def test_word_bpe_on_odd_texts(library):
    r, bpe = random.Random(1), word_bpe.WordBpe(WORDS)
    parts = ["a", "b", "e\u0301", "É", "é", "ß", "İ", "Σ", "ς", " ", "\x1c", "\x85", "\u2003", "'s", "'S", "'ll", "1", "²", "Ⅷ", "😀", "中", "\u0301", "\n", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "-", "!", "\x00", "\x7f", "ǅ", "ﬁ", "\u1100\u1161", "th", "ing", "aaaa", "''", "\u200b", "\xd7", "\xf7"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (255, 256, 257, 5000, 60000)] + ["a" * n for n in (257, 9999)]
    texts += ["-" * 5001 + "=" * 400, "é" * 3000, *("".join(r.choice(["na", "ana", "banana", "in", "ing", "tion", "aa"]) for _ in range(n)) for n in (90, 900, 9000))]
    for t, got, ref in zip(texts, bpe.encode_all(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == ref.ids and bpe.decode(got).decode() == library.decode(ref.ids, skip_special_tokens=False), t[:80]
    assert bpe.decode([]) == b"" and bpe.decode([-1, 10**7]) == b""


def test_word_bpe_merges_long_words_by_windows(library, monkeypatch):
    monkeypatch.setattr(word_bpe, "LONG", 3)
    monkeypatch.setattr(word_bpe, "FLAT", 4000)
    monkeypatch.setattr(word_bpe, "SEGMENT", 50)
    r, bpe = random.Random(2), word_bpe.WordBpe(WORDS)
    texts = ["".join(r.choice(["a", "b", "th", "e", "in", "g", "aa", "ss", "-", "tion", " "]) for _ in range(r.randint(1, 60))) for _ in range(2000)]
    assert [x.tolist() for x in bpe.encode_all(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_word_bpe_refuses_other_models(tmp_path):
    import json
    from pathlib import Path

    told = json.loads(Path(P.path("word_bpe_49k.json")).read_text())
    told["model"]["merges"] = told["model"]["merges"][::-1]
    (tmp_path / "turned.json").write_text(json.dumps(told))
    with pytest.raises(ValueError):
        word_bpe.WordBpe(str(tmp_path / "turned.json"))
    told["model"]["byte_fallback"] = True
    (tmp_path / "other.json").write_text(json.dumps(told))
    with pytest.raises(ValueError):
        word_bpe.WordBpe(str(tmp_path / "other.json"))


def test_word_bpe_on_awkward_rows(spark, awkward, nothing, library):
    out = word_bpe.decode_documents(word_bpe.encode_documents(awkward, WORDS), WORDS).collect()
    assert len(out) == 12 and all(r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids for r in out)
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in out)
    assert word_bpe.round_trip(nothing, WORDS).count() == 0


def _damaged_labels(rows):
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def test_hard_negatives_of_the_table(spark, duck):
    got = queries.op13_hard_negatives(spark, SMALL_LEDGER)
    want = duck(SMALL_LEDGER).sql(ORACLES["op13_hard_negatives"])
    assert want.columns == got.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_hard_negatives_in_many_nodes(spark, monkeypatch):
    """Nulls, infinities, ties, equal vectors, vectors of two lengths; small nodes, so that whole regions, blocks and leaves are left out."""
    for name, value in (("REGION_ROWS", 60), ("BLOCK", 7), ("PACK", 50), ("LEAF", 8)):
        monkeypatch.setattr(hard_negatives, name, value)
    r = random.Random(2)

    def vector(i):
        if r.random() < 0.03:
            return None
        base = [(0.9, 0.0, 0.1), (0.0, 0.9, 0.0), (-0.5, 0.2, 0.8)][i % 3]
        v = [b + r.choice([-0.25, 0.0, 0.0, 0.125, 0.01]) for b in base] + [0.5] * (r.random() < 0.3)
        if r.random() < 0.03:
            v[0] = r.choice([None, float("nan"), float("inf"), float("-inf")])
        return v

    rows = [(r.choice([None, i, i, i]), r.choice([None, 0, 1, 2, 3]), vector(i)) for i in range(0, 3000, 2)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("key", F.lit("?")).withColumn("v", F.lit("?"))
    got = hard_negatives.hard_negatives(_damaged_labels(hard_negatives.integer_rows(df, "vec_id", "label", "embedding", 256))).collect()
    changed = [(i, None if y is None or i is None else (y + 1) % 10 if i % 7 == 0 else y, v) for i, y, v in rows]
    assert sorted(map(tuple, got)) == brute.hard_negatives(changed) and len(got) > 500
    empty = hard_negatives.integer_rows(df.where("false"), "vec_id", "label", "embedding", 256)
    assert hard_negatives.hard_negatives(empty).count() == 0
    alone = hard_negatives.integer_rows(df.where("vec_id = 200 or vec_id % 100 <> 0"), "vec_id", "label", "embedding", 256)
    assert {r["anchor_id"] for r in hard_negatives.hard_negatives(alone.where("vec_id % 100 <> 0")).collect()} == set()


def test_hard_negatives_leave_out_far_nodes():
    """Balls far from every window are left out before any of their rows is scored."""
    import numpy as np

    near, far = np.full((200, 4), 100, np.int32), np.full((200, 4), -100, np.int32)
    lists = hard_negatives.Lists(np.zeros(3, np.int64), np.arange(3), near[:3], np.full((3, 1), 1000), np.full((3, 1), 10**6), 5, False)
    calls = []
    lists._take = lambda *a: calls.append(a)
    lists.search(np.ones(200, np.int64), np.arange(200), far)
    assert not calls
    lists.search(np.ones(200, np.int64), np.arange(200), near)
    assert calls
