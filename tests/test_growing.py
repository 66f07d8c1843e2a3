"""Logs that grow: the byte-offset source, and rollout logs and transcripts read in pieces against one read of the whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import readers, rollouts
from ledgerloom.sources.growing import GrowingLogs, _before_unfinished
from ledgerloom.streaming import ingest
from ledgerloom.streaming import rollouts as resumed

TURN = ["file", "session_id", "message_id", "turn_index", "ts", "model", "cwd", "input_tokens", "cache_read", "output_tokens", "reasoning_tokens", "calls"]
RESULT = ["file", "session_id", "message_id", "tool_use_id", "call_index", "event_index", "ts", "status", "event_source", "bytes", "agent_id"]


@pytest.fixture
def states(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, resumed.STATE_STORE)
    yield
    spark.conf.unset(key)


def log(r, n, session):
    """A log of any order of events, broken lines among them."""
    out, totals, turn = [], [0, 0, 0, 0], 0
    for i in range(n):
        ts, k, call = f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z", r.random(), f"c{r.randint(0, 9)}"
        line = lambda kind, **p: out.append(json.dumps({"timestamp": ts, "type": kind, "payload": p}))  # noqa: B023, E731
        if i == 0 or k < 0.03:
            line("session_meta", id=session, **r.choice([{"cwd": "/a"}, {"cwd": "/b"}, {"cwd": None}]))
        elif k < 0.12:
            line("turn_context", turn_id=f"t{turn + r.choice([0, 0, 1])}", model=r.choice(["m1", "m2", None]), cwd=r.choice(["/c", None]))
        elif k < 0.25:
            turn += 1
            line("event_msg", type="task_started", turn_id=f"t{turn}")
        elif k < 0.4:
            line("event_msg", type="task_complete", turn_id=f"t{turn - (r.random() < 0.1)}")
        elif k < 0.55:
            totals = [t + r.randint(-3, 60) for t in totals]
            names = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")
            line("event_msg", type="token_count", info=None if r.random() < 0.1 else {"total_token_usage": dict(zip(names, totals, strict=True))})
        elif k < 0.65:
            line("response_item", type="function_call", name=r.choice(["shell", "spawn_agent"]), arguments='{"command": "ls"}', call_id=call)
        elif k < 0.78:
            line("response_item", type=r.choice(["function_call_output", "custom_tool_call_output"]), call_id=call, output=r.choice(["xé" * r.randint(0, 9), {"a": [1, 2]}]))
        elif k < 0.84:
            line("event_msg", type="exec_command_end", call_id=call, turn_id=f"t{turn}", exit_code=r.choice([0, 1]))
        elif k < 0.88:
            line("event_msg", type="subagent_run_done", call_id=call, agent_id="kid", **r.choice([{}, {"success": False}, {"status": "cancelled"}]))
        elif k < 0.94:
            line("response_item", type="message", role="user", content=[{"type": "input_text", "text": r.choice(["hi", "do é it", ""])}])
        elif k < 0.97:
            line("compacted")
        else:
            out.append(r.choice(["broken {", '{"type": 1}', "[]"]))
    return out


def told(rows):
    return sorted(str(tuple(r)) for r in rows.collect())


def test_rollouts_cut_anywhere_equal_one_read(spark, tmp_path, states):
    """Each file is cut at any byte, the stream stops after every piece and starts again; all four kinds of records equal those of the whole files."""
    r, logs = random.Random(4), tmp_path / "logs"
    logs.mkdir()
    texts = {f"f{i}.jsonl": ("\n".join(log(r, r.randint(5, 160), f"s{i}")) + "\n").encode() for i in range(6)}
    at = dict.fromkeys(texts, 0)
    for piece in range(3):
        for name, text in texts.items():
            to = len(text) if piece == 2 else r.randint(at[name], len(text))
            with open(logs / name, "ab") as f:
                f.write(text[at[name] : to])
            at[name] = to
        resumed.stream_rollouts(spark, str(logs), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    own = F.regexp_extract("file", r"([^/]+\.jsonl)", 1)
    got = spark.read.parquet(str(tmp_path / "out")).withColumn("file", own)
    lines = rollouts.read_lines(spark, str(logs)).withColumn("file", own)
    records = lambda kind, columns: told(got.where(F.col("record") == kind).select(*columns))
    turns = told(rollouts.turns(lines).select(*TURN))
    assert records("turn", TURN) == turns and len(turns) > 20
    assert records("user_turn", ["file", "session_id", "ts", "preceding", "following", "blocks"]) == told(rollouts.user_turns(lines).select("file", "session_id", "ts", "preceding", "following", "blocks"))
    assert records("result", RESULT) == told(rollouts.results(lines).select(*RESULT))
    assert records("compaction", ["file", "session_id", "ts", "preceding", "cache_read"]) == told(rollouts.compactions(lines).select("file", "session_id", "ts", "preceding", "tokens_before"))


def test_rules_of_rollouts(spark, tmp_path):
    event = lambda kind, **p: {"timestamp": "2024-01-01T00:00:00Z", "type": "event_msg", "payload": {"type": kind, **p}}
    item = lambda kind, **p: {"timestamp": "2024-01-01T00:00:05Z", "type": "response_item", "payload": {"type": kind, **p}}
    rows = [
        {"type": "session_meta", "payload": {"id": "s"}}, item("message", role="user", content=[{"text": "hello"}]), event("task_started", turn_id="a"), item("function_call_output", call_id="c", output="12345"), event("exec_command_end", call_id="c", turn_id="a", exit_code=3),
        event("task_complete", turn_id="a"), {"type": "compacted", "payload": {}}, event("task_started", turn_id="b"), item("function_call_output", call_id="d", output="x"), event("task_started", turn_id="c"), event("subagent_x_done", call_id="c", agent_id="kid"), event("task_complete", turn_id="c"),
        event("task_started", turn_id="waits"), item("function_call_output", call_id="z", output="x"),
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    lines = rollouts.read_lines(spark, str(tmp_path / "r.jsonl"))
    assert [r["message_id"] for r in rollouts.turns(lines).orderBy("turn_index").collect()] == ["a", "b", "c"]
    said = {r["user_uuid"]: [(b["kind"], b["tokens"], b["is_error"]) for b in r["blocks"]] for r in rollouts.user_turns(lines).collect()}
    assert said == {"s:start->a": [("text", 2, False)], "s:a->b": [("tool_result", 2, True)], "s:start->c": [("tool_result", 1, False)]}
    got = [(r["tool_use_id"], r["message_id"], r["status"], r["event_source"], r["call_index"], r["agent_id"]) for r in rollouts.results(lines).orderBy("event_index").collect()]
    assert got == [("c", "a", "errored", "function_call_output", 0, None), ("c", "c", "completed", "subagent_notification", 1, "kid")]
    assert [(r["preceding"], r["tokens_before"]) for r in rollouts.compactions(lines).collect()] == [("a", 0)]
    (tmp_path / "none.jsonl").write_text("")
    nothing = rollouts.read_lines(spark, str(tmp_path / "none.jsonl"))
    assert all(f(nothing).count() == 0 for f in (rollouts.turns, rollouts.user_turns, rollouts.results, rollouts.compactions))


def test_a_line_is_parsed_once(spark):
    """Neither filters nor columns parse a line again, however often they mention what it says."""
    plan = rollouts.typed_lines(spark.createDataFrame([("f", 1, "{}")], "file string, line long, value string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("value#") and plan.count("StructField(payload") == 1


def test_lines_are_gone_through_once(spark):
    """Turns, results and compactions come from one pass over the lines each, not from joins of several."""
    lines = rollouts.typed_lines(spark.createDataFrame([("f", 1, "{}")], "file string, line long, value string"))
    for f in (rollouts.turns, rollouts.results, rollouts.compactions):
        plan = f(lines)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("StructField(payload") == 1 and "Join" not in plan, f.__name__


def test_user_turns_go_through_lines_once(spark):
    lines = rollouts.typed_lines(spark.createDataFrame([("f", 1, "{}")], "file string, line long, value string"))
    plan = rollouts.user_turns(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructField(payload") == 1 and "Join" not in plan


def test_state_in_pages_equals_one_read(spark, tmp_path, states, monkeypatch):
    """Pages that split, in each of many short pieces, keep every context and counter; a log cut back to its beginning starts with none."""
    monkeypatch.setattr(resumed, "PAGE", 2)
    r = random.Random(9)
    rows = [(f"f{i}", n, v) for i in range(3) for n, v in enumerate(log(r, 150, f"s{i}"))]
    for piece in range(3):
        part = [x for x in rows if piece * 50 <= x[1] < piece * 50 + 50]
        spark.createDataFrame(part, "file string, line long, value string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = resumed.rollout_records(spark.readStream.schema("file string, line long, value string").parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    lines = rollouts.typed_lines(spark.createDataFrame(rows, "file string, line long, value string"))
    assert told(got.where("record = 'turn'").select(*TURN)) == told(rollouts.turns(lines).select(*TURN))
    assert told(got.where("record = 'result'").select(*RESULT)) == told(rollouts.results(lines).select(*RESULT))


class Handle:
    """States kept in memory, with the number of calls made."""

    def __init__(self):
        self.kept, self.calls = {}, 0

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, key, value):
        return self

    def get(self):
        self.calls += 1
        return self.kept.get("value")

    def update(self, value):
        self.calls += 1
        self.kept["value"] = value

    def getValue(self, key):
        self.calls += 1
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.kept[key] = value

    def clear(self):
        self.kept = {}


def test_calls_to_the_state_do_not_grow_with_lines():
    """A batch of a file asks the state for its value and its pages, not for every turn and call; ends of a log cut back start anew."""
    handle, p = Handle(), resumed.RolloutProcessor()
    p.init(handle)
    turn = lambda n, at: [
        {"line": at, "kind": "turn_context", "turn": f"t{n}", "model": f"m{n}"}, {"line": at + 1, "kind": "task_started", "turn": f"t{n}"}, {"line": at + 2, "kind": "result", "call_id": "c", "result_bytes": 3}, {"line": at + 3, "kind": "task_complete", "turn": f"t{n}"}
    ]
    run = lambda lines: [r for row in p.handleInputRows(("f",), iter([("f", json.dumps(lines))]), None) for r in json.loads(row["records"])]
    first = run([x for n in range(300) for x in turn(n, 4 * n)])
    assert handle.calls <= 4 and [r["model"] for r in first if r["record"] == "turn"] == [f"m{n}" for n in range(300)]
    again = run(turn(5, 1200))
    assert handle.calls <= 8 and [(r["call_index"], r["event_index"]) for r in again if r["record"] == "result"] == [(300, 300)]
    anew = run(turn(0, 0))
    assert [(r["call_index"], r["event_index"]) for r in anew if r["record"] == "result"] == [(0, 0)] and [r["turn_index"] for r in anew if r["record"] == "turn"] == [0]


def _drain(spark, tmp_path, **options):
    spark.dataSource.register(GrowingLogs)
    stream = spark.readStream.format("growing_logs").option("path", str(tmp_path / "logs")).options(**options).load()
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    return sorted((r["file"].rsplit("/", 1)[1], r["start"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_files_that_grow_shrink_and_are_replaced(spark, tmp_path):
    logs = tmp_path / "logs/sub"
    logs.mkdir(parents=True)
    (logs / "a.jsonl").write_text("one\ntwo\nthr")
    (logs / "b.jsonl").write_text("no end yet")
    (logs / "c.txt").write_text("another kind\n")
    assert _drain(spark, tmp_path, part_bytes=3) == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two")]
    with open(logs / "a.jsonl", "a") as f:
        f.write("ee\n\n")
    (logs / "b.jsonl").write_text("é" * 40000 + "\ny\n")
    grown = [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two"), ("a.jsonl", 8, "three"), ("b.jsonl", 0, "é" * 40000), ("b.jsonl", 80001, "y")]
    assert _drain(spark, tmp_path, part_bytes=1000) == grown
    assert _drain(spark, tmp_path) == grown
    (logs / "a.jsonl").write_text("new\nand longer than before\n")
    (logs / "b.jsonl").write_text("short\n")
    replaced = [("a.jsonl", 0, "new"), ("a.jsonl", 4, "and longer than before"), ("b.jsonl", 0, "short")]
    assert _drain(spark, tmp_path) == sorted(grown + replaced)
    (logs / "b.jsonl").unlink()
    assert _drain(spark, tmp_path) == sorted(grown + replaced)


def _assistant(message, stop=None, **more):
    return json.dumps({"type": "assistant", "sessionId": "s1", "timestamp": "2024-01-01T00:00:00Z", "uuid": f"u-{message}", "message": {"id": message, "model": "m", "content": [], **({"stop_reason": stop} if stop else {}), **more}}).encode() + b"\n"


def test_unfinished_messages_wait():
    done, begun, user = _assistant("m1", "end_turn"), _assistant("m2"), b'{"type": "user"}\n'
    assert _before_unfinished(done + user, True) == len(done + user)
    assert _before_unfinished(done + begun + user + begun, True) == len(done)
    assert _before_unfinished(begun, True) == 0 and _before_unfinished(begun, False) is None
    assert _before_unfinished(b"junk\n", True) == 5 and _before_unfinished(begun + _assistant("m2", "tool_use"), True) == len(begun + _assistant("m2", "tool_use"))


def test_transcripts_followed_in_pieces_equal_one_read(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    usage = {"usage": {"input_tokens": 3, "output_tokens": 4}}
    whole = b"".join([_assistant("m1"), _assistant("m1", "tool_use", **usage), b'{"type": "user", "sessionId": "s1", "uuid": "x", "message": {"content": "hi"}}\n', _assistant("m2"), _assistant("m2", "end_turn", **usage), _assistant("m3")])
    cuts = [0, 40, len(_assistant("m1")) + 5, len(whole) - len(_assistant("m3")) - 90, len(whole)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        with open(logs / "s1.jsonl", "ab") as f:
            f.write(whole[a:b])
        ingest.follow_turns(spark, str(logs), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination(120)
    columns = ["session_id", "message_id", "turn_index", "input_tokens", "output_tokens", "stop_reason"]
    want = readers.transcript_turns(readers.transcript_rows(spark, str(logs / "s1.jsonl")), complete_only=True)
    assert told(ingest.table(spark, str(tmp_path / "t")).select(*columns)) == told(want.select(*columns))


def test_all_tables_of_a_ledger_in_pieces(spark, tmp_path, monkeypatch):
    """Pieces cut anywhere, with a crash before one commit, give the tables of one piece."""
    from ledgerloom.sources import store

    usage = {"usage": {"input_tokens": 3, "output_tokens": 4, "cache_read_input_tokens": 5}}
    user = lambda u, content: json.dumps({"type": "user", "sessionId": "s1", "uuid": u, "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": content}}).encode() + b"\n"
    call = {"content": [{"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}, {"type": "text", "text": "on it"}]}
    whole = b"".join([
        user("u1", "/resume old"), _assistant("m1", None, **call), _assistant("m1", "tool_use", **usage), user("u2", [{"type": "tool_result", "tool_use_id": "t1", "content": "out", "is_error": True}]),
        b'{"type": "system", "subtype": "compact_boundary", "uuid": "c1", "sessionId": "s1", "timestamp": "2024-01-01T00:00:00Z"}\n', _assistant("m2", "end_turn", **usage), user("u3", "thanks"),
    ])
    made = {}
    for name, cuts in (("once", [0, len(whole)]), ("pieces", [0, 90, len(whole) // 2, len(whole) - 30, len(whole)])):
        logs, ledger, reports = tmp_path / name / "logs", store.Ledger(spark, str(tmp_path / name / "ledger")), []
        logs.mkdir(parents=True)
        run = lambda: ingest.follow_ledger(spark, str(logs), ledger, str(tmp_path / name / "cp"), reports=reports).awaitTermination(180)  # noqa: B023, E731
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            with open(logs / "s1.jsonl", "ab") as f:
                f.write(whole[a:b])
            if i == 2:
                with monkeypatch.context() as m:
                    m.setattr(ledger.commits, "commit", lambda *a: 1 / 0)
                    with pytest.raises(Exception, match="division"):
                        run()
            run()
        made[name] = {k: sorted(str(sorted(r.asDict(recursive=True).items(), key=str)) for r in ledger.table(k).collect()) for k in store.KEYS if ledger.table(k) is not None}
        assert store.merge_reports(*reports) == {k: len(v) for k, v in made[name].items() if k != "inferences"}
    assert made["pieces"] == made["once"]
    assert {k: len(v) for k, v in made["once"].items()} == {"turns": 2, "tool_result_events": 1, "user_turns": 3, "content": 5, "compactions": 1, "relationships": 2, "inferences": 2}
