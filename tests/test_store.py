"""The ledger's tables: appends, upserts, stamps, rebuild and reset."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import store


@pytest.fixture()
def ledger(spark, tmp_path):
    return store.Ledger(spark, str(tmp_path / "ledger"))


def test_append_skips_keys_and_content(spark, ledger):
    rows = lambda *r: spark.createDataFrame(r, "source string, session_id string, message_id string, project string, project_key string, fp string")
    assert ledger.append("turns", rows(("c", "s", "1", "p", "k", "x"), ("c", "s", "1", "p", "k", "x"), ("c", "s", "2", "p", "k", "y")), "fp") == 2
    assert ledger.append("turns", rows(("c", "s", "2", "p", "k", "z"), ("c", "t", "3", "q", "k", "y"), ("c", "t", "4", "q", None, "w")), "fp") == 1
    assert sorted(r["message_id"] for r in ledger.table("turns").collect()) == ["1", "2", "4"] and ledger.counts() == {"turns": 3}
    only = spark.createDataFrame([("t",), ("t",)], "session_id string")
    assert [r["message_id"] for r in ledger.turns_of(only).collect()] == ["4"] and ledger.sessions_with("turns").count() == 2
    calls = spark.createDataFrame([("c", "s", "i", "2024-01-01"), ("c", "t", "j", "2024-01-02")], "source string, session_id string, inference_id string, start_ts string")
    ledger.upsert("inferences", calls)
    ledger.upsert("inferences", calls.where("session_id = 't'").withColumn("start_ts", F.lit("2024-01-05")))
    assert sorted(r["start_ts"] for r in ledger.table("inferences").collect()) == ["2024-01-01", "2024-01-05"]
    assert [r["session_id"] for r in ledger.inferences(project="q").collect()] == ["t"] and ledger.inferences(since="2024-01-02", until="2024-01-05").count() == 1


def test_stamps_make_edges_that_a_rebuild_replays(spark, ledger):
    stamp = spark.createDataFrame([("1", "s", {"parentAgentId": "boss", "agentId": "a"}), ("2", "t", {"team": "x"})], "stamp_id string, session_id string, tags map<string,string>")
    ledger.write_stamp(stamp)
    assert [tuple(r) for r in ledger.table("relationships").select("session_id", "related_session_id", "agent_id").collect()] == [("s", "boss", "a")]
    ledger.rebuild({"compactions": spark.createDataFrame([("c", "s", "2024")], "source string, session_id string, ts string")})
    assert ledger.counts() == {"compactions": 1, "relationships": 1, "stamps": 2}
    assert ledger.reset(dry_run=True) == {"compactions": 1, "relationships": 1, "stamps": 2} and ledger.counts()
    ledger.reset()
    assert ledger.counts() == {} and ledger.table("stamps") is None


def test_content_and_queries(spark, ledger):
    rows = lambda s: spark.createDataFrame([("c", s, "m", "assistant", "text", 0, None), ("c", s, "m", "assistant", "text", 1, "2024-01-03")], "source string, session_id string, message_id string, role string, kind string, position int, ts string")
    with pytest.raises(ValueError):
        ledger.append("content", rows("../x"))
    assert ledger.append("content", rows("s1")) == 2 and ledger.content("s1", until="2024-01-01").count() == 1 and ledger.content(source="z").count() == 0
    assert store.merge_tags("w", {"a": "b"}) == {"a": "b", "workflowId": "w"} and store.merge_tags(None, {}) == {}
    for bad in (("w", {"workflowId": "v"}), (None, {" ": "x"})):
        with pytest.raises(ValueError):
            store.merge_tags(*bad)
    df = spark.createDataFrame([(1, "b", 3), (2, "a", 1), (1, "c", 2)], "k int, v string, at int")
    assert [(r["k"], r["v"]) for r in store.first_seen(df, ["k"], "at").collect()] == [(2, "a"), (1, "c")]


def _batch(spark, k):
    turns = spark.createDataFrame([("c", f"s{k}", "m1"), ("c", "s0", f"m{k}")], "source string, session_id string, message_id string")
    events = spark.createDataFrame([("c", f"s{k}", "t", 0)], "source string, session_id string, tool_use_id string, event_index int")
    calls = spark.createDataFrame([("c", "s0", "i", k)], "source string, session_id string, inference_id string, n int")
    return {"turns": turns, "tool_result_events": events}, {"inferences": calls}


def _all(ledger):
    return {k: sorted(map(str, ledger.table(k).collect())) for k in store.KEYS if ledger.table(k) is not None}


def test_a_batch_killed_anywhere_and_tried_again_equals_a_clean_run(spark, tmp_path, monkeypatch):
    """Every table of a batch is written, and the manifest renamed, one after the other; a stop before each of these, then a retry."""
    clean = store.Ledger(spark, str(tmp_path / "clean"))
    reports = [clean.append_batch("logs", k, *_batch(spark, k)) for k in range(2)]
    assert reports == [{"turns": 2, "tool_result_events": 1}, {"turns": 1, "tool_result_events": 1}] and store.merge_reports(*reports) == {"turns": 3, "tool_result_events": 2}  # one turn of the second is stored
    for stop in range(4):
        ledger = store.Ledger(spark, str(tmp_path / f"killed{stop}"))
        ledger.append_batch("logs", 0, *_batch(spark, 0))
        before, left, write, rename = _all(ledger), [stop], ledger._write, ledger.commits.commit

        def step(f, *a, left=left):
            if left[0] == 0:
                raise KeyboardInterrupt
            left[0] -= 1
            return f(*a)

        with monkeypatch.context() as m:
            m.setattr(ledger, "_write", lambda *a, f=write: step(f, *a))  # noqa: B023
            m.setattr(ledger.commits, "commit", lambda *a, f=rename: step(f, *a))  # noqa: B023
            with pytest.raises(KeyboardInterrupt):
                ledger.append_batch("logs", 1, *_batch(spark, 1))
        assert _all(ledger) == before
        assert ledger.append_batch("logs", 1, *_batch(spark, 1)) == reports[1] and _all(ledger) == _all(clean)
        assert ledger.append_batch("logs", 1, *_batch(spark, 1)) == {} and _all(ledger) == _all(clean)
        assert ledger.vacuum() == stop and _all(ledger) == _all(clean)


def test_rows_without_a_fingerprint_stay(spark, ledger):
    rows = spark.createDataFrame([("c", "s", str(i), None) for i in range(3)], "source string, session_id string, message_id string, fp string")
    assert ledger.append("turns", rows, "fp") == 3 and ledger.append("turns", rows, "fp") == 0 and ledger.table("turns").count() == 3


def test_two_writers_and_many_folders(spark, ledger, monkeypatch):
    from ledgerloom.sources.commits import Conflict

    monkeypatch.setattr(store, "FOLDERS", 3)
    rows = lambda i: spark.createDataFrame([("c", f"s{i}", str(i))], "source string, session_id string, ts string")
    assert [ledger.append("compactions", rows(i)) for i in range(5)] == [1] * 5 and ledger.append("compactions", rows(2)) == 0
    version, state = ledger.commits.latest()
    assert ledger.table("compactions").count() == 5 and len(state["tables"]["compactions"]) <= 3
    wider = rows(9).withColumn("tokens", F.lit(7))
    assert ledger.append("compactions", wider) == 1 and sorted(str(r["tokens"]) for r in ledger.table("compactions").collect()) == ["7"] + ["None"] * 5
    with pytest.raises(Conflict):
        ledger.commits.commit(version, state)
    for _ in range(12):
        ledger.commits.commit(*ledger.commits.latest())
    assert len(ledger.commits._versions()) == 9
