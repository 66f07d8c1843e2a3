"""Payload scalars, and results brought to calls and turns, on small rows."""

from pyspark.sql import functions as F

from ledgerloom.functions import payload
from ledgerloom.operators import results


def test_payloads(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]
    for given, want in (("plain text", "plain text"), ('"quoted"', "quoted"), (None, ""), ("null", ""), ('[{"type":"text","text":"a"},"b",5,{"k":1},[2]]', 'a\nb\n{"k":1}\n[2]'), ('{"k":1}', '{"k":1}')):
        assert one(payload.result_text, given) == want
    assert one(payload.content_bytes, '"é"') == 2 and one(payload.content_bytes, '[1]') == 3
    m = one(payload.replacement_meta, '{"content":[{"x":1},{"_meta":{"replaces":["Read",""],"collapsedCalls":3.7}}]}')
    assert (m["replaced"], m["collapsed"]) == (["Read"], 3) and one(payload.replacement_meta, '{"_meta":{"collapsedCalls":0}}') is None
    p = one(payload.edit_preview, '{"old_string":"a","content":"c"}')
    assert (p["old"], p["new"]) == ("a", "c") and one(payload.edit_preview, "{}") is None
    assert one(payload.boilerplate, "  <Environment_Context>") and one(payload.boilerplate, "# agents.MD x") and not one(payload.boilerplate, "hello <permissions")
    assert payload.round_digits(0.125, 2) == 0.12 and payload.usd(0.00005) == "$0.0001" and payload.commas(1234567) == "1,234,567"


def test_results_meet_calls(spark):
    frame = spark.createDataFrame
    calls = frame([("c", "s", 0, 0, "t1", "Bash", "h1", "ls"), ("c", "s", 1, 0, "t2", "Task", "h2", "plan"), ("c", "s", 1, 1, "t3", "skill", "h3", None)], "source string, session_id string, turn_index long, call_index int, tool_use_id string, tool_name string, args_hash string, target string").withColumn("skill_name", F.when(F.col("tool_name") == "skill", "fmt"))
    turns = frame([("c", "s", "m0", 0, 10, "x"), ("c", "s", "m1", 1, 20, "y")], "source string, session_id string, message_id string, turn_index long, ts long, model string")
    events = frame([("c", "s", "t1", 0, None, None, "tool_result", "m0", 11), ("c", "s", "t1", 1, 9, True, "progress_event", "m9", 12), ("c", "s", "t9", 0, 5, None, "subagent_notification", None, 25)], "source string, session_id string, tool_use_id string, event_index int, content_length long, truncated boolean, event_source string, message_id string, ts long")
    blocks = frame([("c", "s", "t1", 7, 0), ("c", "s", "t1", 8, 1)], "source string, session_id string, tool_use_id string, approx_tokens long, position int")
    content = frame([("s", "t1", '"zzzz"', 0), ("s", "t2", '"aé😀bc"', 0)], "session_id string, tool_use_id string, content string, position int")
    by_id = lambda df, *c: {r["tool_use_id"]: tuple(r[x] for x in c) for r in df.collect()}
    assert by_id(results.result_bytes(calls, events), "output_bytes", "output_truncated") == {"t1": (9, True), "t2": (None, None), "t3": (None, None)}
    assert by_id(results.result_sizes(calls, blocks, content), "size") == {"t1": (8,), "t2": (2,), "t3": (None,)}
    assert sorted((r["event_index"], r["tool_name"], r["turn_index"]) for r in results.events_with_calls(events, calls).where("tool_use_id = 't1'").collect()) == [(0, "Bash", 0), (1, "Bash", 0)]
    assert sorted(str((r["event_index"], r["tokens"])) for r in results.event_tokens(events, blocks).collect()) == ["(0, 2)", "(0, 8)", "(1, 3)"]
    assert sorted(r["model"] for r in results.event_models(events, turns).collect()) == ["x", "x", "x"]
    marks = frame([("s", 10, "u1"), ("s", 20, "u2")], "session_id string, ts long, message_id string")
    rows = frame([("s", 10), ("s", 15), ("s", 25), ("s", 5)], "session_id string, ts long")
    assert {r["ts"]: (r["user_before"], r["assistant_before"]) for r in results.around(rows, marks, marks).collect()} == {5: (None, None), 10: ("u1", None), 15: ("u1", "u1"), 25: ("u2", "u2")}
    sidecars = frame([("s", "a", "t2", 11), ("s", "b", "gone", 12)], "session_id string, agent_id string, tool_use_id string, ts long")
    assert {r["agent_id"]: r["turn_index"] for r in results.sidecar_turns(sidecars, calls, turns).collect()} == {"a": 1, "b": 0}
    assert sorted(r["name"] for r in results.observed_names(calls).collect()) == ["Bash", "Task", "fmt", "plan", "skill"]
    texts = frame([("c", "/go now and /x/y <command-name>/fmt</command-name>")], "source string, text string")
    assert sorted(r["name"] for r in results.mined_names(texts).collect()) == ["fmt", "go"]
    bridge = frame([("s", "m0", "m1")], "session_id string, preceding_message_id string, following_message_id string")
    assert [(r["before"], r["after"]) for r in results.bridged(turns, bridge).collect()] == [(0, 1)]
