"""Readers, classifiers and ingest over logs written here."""

import json

from pyspark.sql import functions as F

from ledgerloom.functions import activity, shell
from ledgerloom.sources import files, readers
from ledgerloom.streaming import ingest


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def transcript(session="s1"):
    usage = lambda o: {"input_tokens": 10, "output_tokens": o, "cache_read_input_tokens": 5, "cache_creation_input_tokens": 7}
    row = lambda **x: {"sessionId": session, "timestamp": "2024-01-01T00:00:00Z", **x}
    return [
        row(type="user", uuid="u1", parentUuid=None, message={"role": "user", "content": 'fix the "bug"'}),
        row(type="assistant", uuid="a1", parentUuid="u1", requestId="r1", message={"id": "m1", "model": "claude-sonnet-4-6", "usage": usage(1), "content": [{"type": "text", "text": "ok"}]}),
        row(type="assistant", uuid="a2", parentUuid="a1", requestId="r2", message={"id": "m1", "model": "claude-sonnet-4-6", "stop_reason": "tool_use", "usage": usage(9), "content": [{"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls -l"}}]}),
        row(type="user", uuid="u2", parentUuid="a2", message={"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "é", "is_error": True}]}),
        row(type="assistant", uuid="a3", parentUuid="u2", message={"id": "m2", "model": "claude-sonnet-4-6", "content": []}),
        "not json", row(type="system", uuid="c1", subtype="compact_boundary"),
    ]


def test_transcript(spark, tmp_path):
    rows = readers.transcript_rows(spark, write(tmp_path / "s1.jsonl", transcript()))
    turns = {r["message_id"]: r for r in readers.transcript_turns(rows).collect()}
    m1 = turns["m1"]
    assert (m1["output_tokens"], m1["cache_create_5m"], m1["stop_reason"], m1["request_id"], m1["turn_index"]) == (9, 7, "tool_use", "r1", 0)
    assert [(c["name"], c["command"]) for c in m1["calls"]] == [("Bash", "ls -l")] and turns["m2"]["output_tokens"] == 0
    assert [r["message_id"] for r in readers.transcript_turns(rows, complete_only=True).collect()] == ["m1"]
    e = readers.transcript_tool_results(rows).first()
    assert (e["tool_use_id"], e["status"], e["chars"], e["bytes"]) == ("t1", "errored", 1, 2)
    assert readers.transcript_compactions(rows).count() == 1
    assert readers.transcript_user_turns(rows).where("user_uuid = 'u1'").first()["text"] == 'fix the "bug"'
    assert {r["node"]: r["prompt"] for r in readers.user_ancestors(rows).collect()}["a3"] == "u2"


def test_prompt_at_the_end_of_a_long_chain(spark):
    """However long the chain is; a cycle and a broken chain have no prompt."""
    rows = [("u", "user", None), ("a0", "assistant", "u"), *[(f"a{i}", "assistant", f"a{i - 1}") for i in range(1, 101)], ("x", "assistant", "y"), ("y", "assistant", "x"), ("z", "assistant", "gone")]
    got = {r["node"]: r["prompt"] for r in readers.user_ancestors(spark.createDataFrame(rows, "uuid string, type string, parent string")).collect()}
    assert got == {f"a{i}": "u" for i in range(101)}


def test_rollout_usage_is_the_growth_of_totals(spark, tmp_path):
    total = lambda i, c, o: {"timestamp": "2024-01-01T00:00:01Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": 1}}}}
    event = lambda kind, turn: {"timestamp": "2024-01-01T00:00:00Z", "type": "event_msg", "payload": {"type": kind, "turn_id": turn}}
    rows = [{"timestamp": "2024-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": "sess", "cwd": "/w"}}, {"type": "turn_context", "payload": {"turn_id": "t1", "model": "gpt-5.5", "cwd": "/w"}}, event("task_started", "t1"), {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": '{"command": "ls"}', "call_id": "c"}}, total(100, 40, 5), event("task_complete", "t1"), event("task_started", "t2"), total(180, 60, 9), event("task_complete", "t2"), event("task_started", "t3"), total(200, 60, 9)]
    got = [tuple(r) for r in readers.rollout_turns(spark, write(tmp_path / "r.jsonl", rows)).orderBy("turn_index").select("session_id", "message_id", "model", "input_tokens", "cache_read", "output_tokens", F.size("calls")).collect()]
    assert got == [("sess", "t1", "gpt-5.5", 60, 40, 5, 1), ("sess", "t2", "gpt-5.5", 60, 20, 4, 0)]


def test_storage_tree(spark, tmp_path):
    write(tmp_path / "message/ses/m.json", [{"id": "m", "sessionID": "ses", "role": "assistant", "time": {"created": 1000}, "providerID": "anthropic", "modelID": "x", "tokens": {"input": 3, "output": 4, "reasoning": 0, "cache": {"read": 1, "write": 2}}}])
    write(tmp_path / "part/m/p1.json", [{"id": "p1", "type": "tool", "callID": "c", "tool": "read", "state": {"status": "completed", "input": {"path": "/a"}}}])
    write(tmp_path / "part/m/p2.json", [{"id": "p2", "type": "step-finish", "reason": "end_turn"}])
    r = readers.storage_turns(spark, str(tmp_path)).first()
    assert (r["model"], r["cache_create_5m"], r["stop_reason"], r["calls"][0]["name"], r["calls"][0]["target"]) == ("anthropic/x", 2, "end_turn", "Read", "/a")


def test_shell():
    assert shell.parse("cd x && FOO=1 sudo -E git commit -m 'a; b'")["normalized"] == "git commit"
    assert shell.parse('bash -lc "npm run build"')["normalized"] == "npm run build"
    assert shell.parse("timeout 5 pytest -q")["binary"] == "pytest" and shell.parse("")["binary"] is None
    assert shell.reads_file("cat a.txt") and not shell.reads_file("cat a > b") and not shell.reads_file("cat") and not shell.reads_file("cat a | wc")


def test_verbs_and_activity(spark):
    assert {r["command"]: r["verb"]["normalized"] for r in shell.with_verbs(spark.createDataFrame([("git push",), ("ls",), (None,)], "command string")).where("command is not null").collect()} == {"git push": "git push", "ls": "ls"}
    call = "array<struct<name: string, target: string, command: string>>"
    rows = [
        ([("Edit", "a.md", None)], "x", "docs"), ([("Edit", "a.py", None)], "rename it", "refactoring"), ([("apply_patch", "a.py", None)], "hm", "coding"), ([("Bash", None, "CI=1 cargo test")], "", "testing"), ([("Bash", None, "black . --check")], "", "verification"),
        ([("Bash", None, "black .")], "", "format"), ([("spawn_agent", None, None)], "", "delegation"), ([("update_plan", None, None)], "", "planning"), ([], "a roadmap please", "planning"), ([], "what if not", "brainstorming"), ([("Read", "a", None)], None, "exploration"), ([], None, "conversation"),
        ([("Edit", "a", None), ("Bash", None, "x"), ("Edit", "a", None), ("Bash", None, "x"), ("Edit", "a", None)], "", "debugging"),
    ]
    df = spark.createDataFrame(rows, f"calls {call}, request string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", activity.activity(F.col("calls"), F.col("request"))).collect())


def test_files(spark, tmp_path):
    md = "pre\n# T\n```\n## no\n```\n## A\naa\n## B\nb\n"
    assert [(t, n) for t, n, _ in files.sections(md)] == [("(preamble)", 0), ("A", 2), ("B", 2)] and sum(b for *_, b in files.sections(md)) == len(md)
    assert "-## A" in files.without_section(md, "A") and "-## B" not in files.without_section(md, "A")
    rates = {r["model"]: r for r in files.pricing(spark, {"reseller": {"models": {"m": {"cost": {"input": 9, "output": 9}}, "n": {"cost": {"input": 1}}}}, "openai": {"models": {"m": {"cost": {"input": 1, "output": 2}}}}, "other": {"models": {"m": {"cost": {"input": 7, "output": 7}}}}}).collect()}
    assert set(rates) == {"m"} and (rates["m"]["input"], rates["m"]["cache_write"]) == (1.0, 1.0)
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    files.export_ledger({"turn": df, "stamp": df}, str(tmp_path / "x"))
    back = files.import_ledger(spark, str(tmp_path / "x"), {"turn": "id int, v string"})
    assert [tuple(r) for r in back["turn"].collect()] == [(1, "a")]
    assert files.settings(str(tmp_path / "none.json")) == {}


def test_stream_equals_batch(spark, tmp_path):
    write(tmp_path / "in/s1.jsonl", transcript())
    write(tmp_path / "in/again.jsonl", transcript())
    run = lambda: ingest.stream_turns(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    run()
    write(tmp_path / "in/s2.jsonl", transcript("s2"))
    run()
    assert sorted(tuple(r) for r in ingest.table(spark, str(tmp_path / "out")).select("session_id", "message_id").collect()) == [("s1", "m1"), ("s2", "m1")]


def test_records_of_transcripts(spark, tmp_path):
    from ledgerloom.sources import records

    row = lambda **x: {"sessionId": "s1", "timestamp": "2024-01-01T00:00:00Z", **x}
    lines = [
        row(type="user", uuid="u1", message={"role": "user", "content": "/resume old-1"}),
        row(type="assistant", uuid="a1", parentUuid="u1", message={"id": "m1", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}, {"type": "tool_use", "id": "t1", "name": "Edit", "input": {"file_path": "/f", "old_string": "a", "new_string": "b"}}, {"type": "tool_use", "id": "t2", "name": "Write", "input": {"file_path": "/g", "content": "b"}}]}),
        row(type="user", uuid="u2", parentUuid="a1", message={"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": [{"type": "text", "text": "no"}, {"type": "text", "text": "way"}]}]}),
    ]
    rows = readers.transcript_rows(spark, write(tmp_path / "s1.jsonl", lines))
    told = [(r["message_id"], r["role"], r["kind"], r["position"], r["tool_use_id"], r["text"]) for r in records.transcript_content(rows).orderBy("ts", "message_id", "position").collect()]
    assert ("m1", "assistant", "thinking", 0, None, "hm") in told and ("u2", "user", "tool_result", 0, "t1", "no\nway") in told and len(told) == 6
    assert [tuple(r) for r in records.transcript_errors(rows).select("tool_use_id").collect()] == [("t1",)]
    edits = {r["tool_use_id"]: r for r in records.transcript_edits(rows).collect()}
    assert edits["t1"]["post"] == edits["t2"]["post"] and edits["t2"]["pre"] is None and edits["t1"]["pre"] != edits["t1"]["post"]
    session = rows.first()["session_id"]
    assert {(r["kind"], r["related_session_id"]) for r in records.transcript_edges(rows).where(F.col("session_id") == session).collect()} >= {("root", None), ("continuation", "old-1")}


def test_records_of_rollouts_and_storage(spark, tmp_path):
    from ledgerloom.sources import records

    line = lambda kind, **p: json.dumps({"timestamp": "2024-01-01T00:00:00Z", "type": "response_item" if kind in ("function_call", "function_call_output", "message") else "event_msg" if kind.endswith("end") else kind, "payload": {"type": kind, **p}})
    path = tmp_path / "rollout-x.jsonl"
    path.write_text("\n".join([
        line("session_meta", id="s9"), line("turn_context", turn_id="1", model="m"), line("message", role="user", content=[{"type": "input_text", "text": "<environment_context>"}, {"type": "input_text", "text": "do it"}]),
        line("function_call", call_id="c1", name="spawn_agent", arguments="{}"), line("function_call_output", call_id="c1", output=json.dumps({"agent_id": "kid"})), line("exec_command_end", call_id="c2", exit_code=2, aggregated_output="boom"),
    ]))
    got = {r["tool_use_id"]: (r["status"], r["content_length"]) for r in records.rollout_results(spark, str(path)).collect()}
    assert got["c2"] == ("errored", 4) and got["c1"][0] == "completed"
    assert [(r["role"], r["text"]) for r in records.rollout_content(spark, str(path)).collect()] == [("user", "do it")]
    assert {(r["kind"], r["agent_id"]) for r in records.rollout_edges(spark, str(path)).collect()} == {("root", None), ("subagent", "kid")}
    for where, what in (("message/s/m.json", {"id": "m", "sessionID": "s", "role": "assistant", "time": {"created": 1}}), ("part/m/p1.json", {"id": "p1", "type": "tool", "callID": "c", "tool": "bash", "state": {"status": "completed", "output": "out", "metadata": {"exit": 1}}}), ("part/m/p2.json", {"id": "p2", "type": "text", "text": "hello"})):
        (tmp_path / where).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / where).write_text(json.dumps(what))
    r = records.storage_results(spark, str(tmp_path)).first()
    assert (r["tool_use_id"], r["status"], r["content_length"]) == ("c", "errored", 3)
    assert [(r["kind"], r["text"]) for r in records.storage_content(spark, str(tmp_path)).orderBy("position").collect()] == [("tool_result", "out"), ("text", "hello")]
