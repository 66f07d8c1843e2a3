"""Records beside turns that logs hold: content, tool results, edit states and relationship edges, from each of the three log formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import payload, text
from ledgerloom.sources.readers import _ROLLOUT, json_lines

CONTENT = ["source", "session_id", "message_id", "role", "kind", "position", "ts", "tool_use_id", "text"]
RESULT = ["source", "session_id", "tool_use_id", "event_index", "event_source", "ts", "status", "content_length", "hash", "truncated"]


def transcript_content(rows: DataFrame) -> DataFrame:
    """Blocks of messages in order: an assistant's text, thinking and calls (arguments as JSON), a user's text and results."""
    flat = rows.where("type in ('user', 'assistant')").select("session_id", "line", "ts", F.col("type").alias("role"), F.coalesce("message.id", "uuid").alias("message_id"), F.posexplode("blocks").alias("at", "b"))
    kind = F.col("b.type")
    wanted = flat.where(((F.col("role") == "assistant") & kind.isin("text", "thinking", "tool_use")) | ((F.col("role") == "user") & kind.isin("text", "tool_result")))
    body = F.when(kind == "thinking", F.col("b.thinking")).when(kind == "tool_use", F.col("b.input")).when(kind == "tool_result", payload.result_text(F.col("b.content"))).otherwise(F.col("b.text"))
    order = Window.partitionBy("session_id", "message_id").orderBy("line", "at")
    return wanted.select(F.lit("claude-code").alias("source"), "session_id", "message_id", "role", kind.alias("kind"), (F.row_number().over(order) - 1).alias("position"), "ts", F.coalesce("b.tool_use_id", F.when(kind == "tool_use", F.col("b.id"))).alias("tool_use_id"), body.alias("text")).select(*CONTENT)


def transcript_errors(rows: DataFrame) -> DataFrame:
    """(session_id, tool_use_id) of failed calls."""
    flat = rows.where("type = 'user'").select("session_id", F.explode("blocks").alias("b"))
    return flat.where("b.type = 'tool_result' and b.is_error").select("session_id", F.col("b.tool_use_id").alias("tool_use_id")).distinct()


def transcript_edits(rows: DataFrame) -> DataFrame:
    """Edits with hashes of the states before and after: (session_id, message_id, tool_use_id, target, pre, post); a write has only the latter."""
    flat = rows.where("type = 'assistant'").select("session_id", F.coalesce("message.id", "uuid").alias("message_id"), F.explode("blocks").alias("b")).where("b.type = 'tool_use' and b.name in ('Edit', 'NotebookEdit', 'Write')")
    arg = lambda *keys: F.coalesce(*[F.get_json_object("b.input", f"$.{k}") for k in keys])
    pre = F.when(F.col("b.name") != "Write", text.short_hash(arg("old_string", "old_source")))
    return flat.select("session_id", "message_id", F.col("b.id").alias("tool_use_id"), arg("file_path", "notebook_path").alias("target"), pre.alias("pre"), text.short_hash(arg("new_string", "new_source", "content")).alias("post"))


def transcript_edges(rows: DataFrame) -> DataFrame:
    """Edges (session_id, related_session_id, kind, agent_id): a root a session; a continuation where a user resumes a session by name (not itself);
    a continuation of the first session that a file names and that isn't its own; a subagent for a session whose rows are all sidechains."""
    own = rows.select("session_id").distinct()
    none = F.lit(None).cast("string")
    roots = own.select("session_id", none.alias("related_session_id"), F.lit("root").alias("kind"), none.alias("agent_id"))
    said = F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    resumed = rows.where("type = 'user'").select("session_id", text.resume_target(said).alias("other")).where("other != '' and other != session_id").distinct()
    file_session = F.regexp_extract("file", r"([^/]+)\.jsonl?$", 1)
    foreign = rows.groupBy("file").agg(F.min_by("session_id", "line").alias("first")).where(F.col("first") != file_session).select(file_session.alias("session_id"), F.col("first").alias("other"))
    both = resumed.union(foreign).distinct().select("session_id", F.col("other").alias("related_session_id"), F.lit("continuation").alias("kind"), none.alias("agent_id"))
    native = rows.groupBy("session_id").agg(F.min("sidechain").alias("all")).where("all").select("session_id", F.col("session_id").alias("related_session_id"), F.lit("subagent").alias("kind"), F.col("session_id").alias("agent_id"))
    return roots.unionByName(both).unionByName(native)


def _rollout(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, ts, kind, payload, session_id, turn) of rollout lines."""
    r = json_lines(spark, path, _ROLLOUT).select("file", "line", F.col("row.type").alias("type"), F.try_to_timestamp("row.timestamp").alias("ts"), F.col("row.payload").alias("payload"))
    get = lambda p: F.get_json_object("payload", f"$.{p}")
    line = Window.partitionBy("file").orderBy("line")
    whole, so_far = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumn("kind", F.when(F.col("type").isin("event_msg", "response_item"), get("type")).otherwise(F.col("type")))
    session = F.first(F.when(F.col("kind") == "session_meta", get("id")), ignorenulls=True).over(whole)
    return r.withColumns({"session_id": F.coalesce(session, F.regexp_extract("file", r"([0-9a-fA-F]{8}-[0-9a-fA-F-]{27})\.jsonl$", 1)), "turn": F.last(F.when(F.col("kind").isin("turn_context", "task_started"), get("turn_id")), ignorenulls=True).over(so_far)})


def rollout_results(spark: SparkSession, path: str) -> DataFrame:
    """Outputs of calls: function outputs, commands' ends (failed by exit code) and patches' ends (failed unless successful)."""
    get = lambda p: F.get_json_object("payload", f"$.{p}")
    r = _rollout(spark, path).where("kind in ('function_call_output', 'custom_tool_call_output', 'exec_command_end', 'patch_apply_end')")
    body = F.coalesce(F.get_json_object(get("output"), "$.output"), get("output"), get("aggregated_output"), get("stdout"), F.lit(""))
    code = F.coalesce(get("exit_code"), F.get_json_object(get("output"), "$.metadata.exit_code")).try_cast("int")
    status = F.when(F.coalesce(code != 0, F.lit(False)) | F.coalesce(get("success") == "false", F.lit(False)), "errored").otherwise("completed")
    order = Window.partitionBy("session_id", "call").orderBy("line")
    out = r.select(F.lit("codex").alias("source"), "session_id", get("call_id").alias("call"), "line", "ts", status.alias("status"), text.payload_measure(body).alias("m")).where("call is not null")
    return out.select("source", "session_id", F.col("call").alias("tool_use_id"), (F.row_number().over(order) - 1).alias("event_index"), F.lit("function_call_output").alias("event_source"), "ts", "status", F.col("m.bytes").alias("content_length"), "m.hash", "m.truncated").select(*RESULT)


def rollout_content(spark: SparkSession, path: str) -> DataFrame:
    """Messages and reasoning summaries; what the harness itself says as the user is left out."""
    get = lambda p: F.get_json_object("payload", f"$.{p}")
    r = _rollout(spark, path).where("kind in ('message', 'reasoning')")
    parts = F.from_json(F.when(F.col("kind") == "message", get("content")).otherwise(get("summary")), "array<struct<type: string, text: string>>")
    role = F.when(F.col("kind") == "message", get("role")).otherwise("assistant")
    own = F.filter(parts, lambda p: p["text"].isNotNull() & ~((role == "user") & payload.boilerplate(p["text"])))
    order = Window.partitionBy("session_id", "turn").orderBy("line")
    out = r.withColumns({"text": F.array_join(F.transform(own, lambda p: p["text"]), "\n"), "role": role}).where("text != ''")
    return out.select(F.lit("codex").alias("source"), "session_id", F.col("turn").alias("message_id"), "role", F.when(F.col("kind") == "message", "text").otherwise("thinking").alias("kind"), (F.row_number().over(order) - 1).alias("position"), "ts", F.lit(None).cast("string").alias("tool_use_id"), "text").select(*CONTENT)


def rollout_edges(spark: SparkSession, path: str) -> DataFrame:
    """A root for each session, and a subagent edge for each agent that a call spawned (its output names the agent)."""
    get = lambda p: F.get_json_object("payload", f"$.{p}")
    r, none = _rollout(spark, path), F.lit(None).cast("string")
    roots = r.where("kind = 'session_meta'").select("session_id", get("forked_from_id").alias("related_session_id"), F.when(get("forked_from_id").isNotNull(), "fork").otherwise("root").alias("kind"), none.alias("agent_id"))
    calls = r.where("kind = 'function_call'").select("session_id", get("call_id").alias("call"), get("name").alias("name")).where("name = 'spawn_agent'")
    told = r.where("kind = 'function_call_output'").select("session_id", get("call_id").alias("call"), F.coalesce(*[F.get_json_object(get("output"), f"$.{k}") for k in ("agent_id", "agentId", "id")]).alias("agent_id"))
    spawned = calls.join(told, ["session_id", "call"]).where("agent_id is not null").select("session_id", F.col("session_id").alias("related_session_id"), F.lit("subagent").alias("kind"), "agent_id")
    return roots.unionByName(spawned)


def _storage(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    message = spark.read.schema("id string, sessionID string, role string, time struct<created: bigint>, tokens struct<input: bigint, output: bigint>").json(f"{root}/message/*/*.json", multiLine=True)
    part = spark.read.schema("id string, type string, text string, callID string, tool string, state struct<status: string, output: string, input: string, metadata: struct<exit: bigint>>").json(f"{root}/part/*/*.json", multiLine=True)
    part = part.withColumn("message_id", F.regexp_extract(F.input_file_name(), r"/part/([^/]+)/", 1))
    return message.select(F.col("id").alias("message_id"), F.col("sessionID").alias("session_id"), "role", F.timestamp_millis("time.created").alias("ts")), part


def storage_results(spark: SparkSession, root: str) -> DataFrame:
    """Results of tools: failed where the status says so or a command's exit code isn't 0."""
    message, part = _storage(spark, root)
    tools = part.where("type = 'tool'").join(message, "message_id")
    failed = (F.col("state.status") == "error") | F.coalesce(F.col("state.metadata.exit") != 0, F.lit(False))
    measured = text.payload_measure(F.coalesce("state.output", F.lit("")))
    order = Window.partitionBy("session_id", "callID").orderBy("ts", "id")
    out = tools.select("session_id", "callID", "id", "ts", F.when(failed, "errored").otherwise(text.status(F.col("state.status"))).alias("status"), measured.alias("m"), (F.row_number().over(order) - 1).alias("event_index"))
    return out.select(F.lit("opencode").alias("source"), "session_id", F.col("callID").alias("tool_use_id"), "event_index", F.lit("tool_result").alias("event_source"), "ts", "status", F.col("m.bytes").alias("content_length"), "m.hash", "m.truncated").select(*RESULT)


def storage_content(spark: SparkSession, root: str) -> DataFrame:
    """Texts and reasoning of messages, and outputs of tools."""
    message, part = _storage(spark, root)
    rows = part.where("type in ('text', 'reasoning', 'tool')").join(message, "message_id")
    kind = F.when(F.col("type") == "tool", "tool_result").when(F.col("type") == "reasoning", "thinking").otherwise("text")
    order = Window.partitionBy("session_id", "message_id").orderBy("id")
    out = rows.select(F.lit("opencode").alias("source"), "session_id", "message_id", "role", kind.alias("kind"), (F.row_number().over(order) - 1).alias("position"), "ts", F.col("callID").alias("tool_use_id"), F.coalesce("text", "state.output").alias("text"))
    return out.where("text is not null").select(*CONTENT)
