"""Readers of harness logs: JSON lines and JSON trees to the typed columns of turns, user turns and tool events.

Every reader is one scan with an explicit schema; a line that is no JSON object is skipped. Values without a fixed shape are
kept as JSON text. Rows of one message are merged per (session, message): last usage and stop reason, first request id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import text

_USAGE = "input_tokens bigint, output_tokens bigint, cache_read_input_tokens bigint, cache_creation_input_tokens bigint, cache_creation struct<ephemeral_5m_input_tokens: bigint, ephemeral_1h_input_tokens: bigint>"
_BLOCK = "type string, text string, thinking string, id string, name string, input string, tool_use_id string, content string, is_error boolean"
TURN = ["source", "session_id", "message_id", "turn_index", "ts", "model", "input_tokens", "output_tokens", "reasoning_tokens", "cache_read", "cache_create_5m", "cache_create_1h", "stop_reason", "request_id", "sidechain", "cwd", "calls"]


def _struct(fields: str) -> str:
    """``a bigint, b string`` as the inside of struct<>."""
    depth, out, word = 0, [], ""
    for c in fields + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = word.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            word = ""
        else:
            word += c
    return ", ".join(out)


TRANSCRIPT = f"type string, subtype string, uuid string, parentUuid string, sessionId string, session_id string, timestamp string, ts string, isSidechain boolean, cwd string, requestId string, request_id string, message struct<id: string, model: string, stop_reason: string, role: string, usage: struct<{_struct(_USAGE)}>, content: string>"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, row) of every line that holds an object, lines numbered within their file by place."""
    raw = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
    parsed = raw.withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    return parsed.where(F.ltrim("value").startswith("{") & F.col("row").isNotNull())


def _file_session(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/]+)\.jsonl?$", 1)


def _blocks(content: Column) -> Column:
    """Blocks of a message's content; a plain string is one text block."""
    listed = F.from_json(content, f"array<struct<{_struct(_BLOCK)}>>")
    alone = F.from_json(F.concat(F.lit('[{"type":"text","text":'), F.to_json(F.struct(content.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(content.alias("v")))) - 6), F.lit("}]")), f"array<struct<{_struct(_BLOCK)}>>")
    return F.when(content.startswith("["), listed).otherwise(alone)


def transcript_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row a log line: session, ids, time, role and blocks."""
    return rows_from(json_lines(spark, path, TRANSCRIPT))


def rows_from(r: DataFrame) -> DataFrame:
    """The same from parsed lines (file, line, row)."""
    at = F.coalesce("row.timestamp", "row.ts")
    return r.select(
        "file", "line", F.coalesce("row.sessionId", "row.session_id", _file_session(F.col("file"))).alias("session_id"), F.col("row.type").alias("type"), F.col("row.subtype").alias("subtype"), F.col("row.uuid").alias("uuid"), F.col("row.parentUuid").alias("parent"),
        F.try_to_timestamp(at).alias("ts"), F.coalesce("row.isSidechain", F.lit(False)).alias("sidechain"), F.col("row.cwd").alias("cwd"), F.coalesce("row.requestId", "row.request_id").alias("request_id"), F.col("row.message").alias("message"), _blocks(F.col("row.message.content")).alias("blocks"),
    )


def _target(name: Column, arguments: Column) -> Column:
    pick = [F.get_json_object(arguments, f"$.{k}") for k in ("file_path", "notebook_path", "path", "pattern", "url", "query", "description", "subagent_type")]
    return F.when(name == "Bash", F.get_json_object(arguments, "$.command")).otherwise(F.coalesce(*pick))


def _call(b: Column) -> Column:
    name = text.tool_name(b["name"])
    return F.struct(b["id"].alias("id"), name.alias("name"), _target(name, b["input"]).alias("target"), F.get_json_object(b["input"], "$.command").alias("command"), text.short_hash(F.coalesce(b["input"], F.lit(""))).alias("args_hash"))


def transcript_turns(rows: DataFrame, complete_only: bool = False) -> DataFrame:
    """Assistant messages: rows with one message id merged in line order. ``complete_only`` leaves out messages that have
    no stop reason yet."""
    a = rows.where("type = 'assistant'").withColumn("message_id", F.coalesce("message.id", "uuid"))
    u = "message.usage"
    merged = a.groupBy("session_id", "message_id").agg(
        F.min("ts").alias("ts"), F.max_by("message.model", F.when(F.col("message.model").isNotNull(), F.col("line"))).alias("model"), F.max_by(u, F.when(F.col(u).isNotNull(), F.col("line"))).alias("usage"),
        F.max_by("message.stop_reason", F.when(F.col("message.stop_reason").isNotNull(), F.col("line"))).alias("stop"), F.min_by("request_id", F.when(F.col("request_id").isNotNull(), F.col("line"))).alias("request_id"),
        F.max("sidechain").alias("sidechain"), F.first("cwd", ignorenulls=True).alias("cwd"), F.min("line").alias("line"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line", "blocks"))), lambda x: x["blocks"])).alias("blocks"),
    )
    split = F.col("usage.cache_creation").isNotNull()
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    order = Window.partitionBy("session_id").orderBy("line")
    out = merged.withColumns({
        "source": F.lit("claude-code"), "turn_index": (F.row_number().over(order) - 1).cast("long"), "input_tokens": n("usage.input_tokens"), "output_tokens": n("usage.output_tokens"), "reasoning_tokens": F.lit(0).cast("long"), "cache_read": n("usage.cache_read_input_tokens"),
        "cache_create_5m": F.when(split, n("usage.cache_creation.ephemeral_5m_input_tokens")).otherwise(n("usage.cache_creation_input_tokens")), "cache_create_1h": n("usage.cache_creation.ephemeral_1h_input_tokens"),
        "stop_reason": text.stop_reason(F.col("stop")), "calls": F.transform(F.filter("blocks", lambda b: b["type"] == "tool_use"), _call),
    })
    return (out.where("stop is not null") if complete_only else out).select(*TURN)


def transcript_tool_results(rows: DataFrame) -> DataFrame:
    """Tool results: (session_id, tool_use_id, ts, status, chars, bytes, hash, truncated, event_index)."""
    flat = rows.where("type = 'user'").select("session_id", "ts", "line", F.posexplode("blocks").alias("at", "b")).where("b.type = 'tool_result'")
    body = F.coalesce("b.content", F.lit(""))
    order = Window.partitionBy("session_id").orderBy("line", "at")
    out = flat.select("session_id", F.col("b.tool_use_id").alias("tool_use_id"), "ts", F.when(F.coalesce("b.is_error", F.lit(False)), "errored").otherwise("completed").alias("status"), text.payload_measure(body).alias("m"), (F.row_number().over(order) - 1).cast("long").alias("event_index"))
    return out.select("session_id", "tool_use_id", "ts", "status", "m.*", "event_index")


def transcript_compactions(rows: DataFrame) -> DataFrame:
    return rows.where("type = 'system' and subtype = 'compact_boundary'").select("session_id", "ts", F.col("uuid").alias("compaction_id"))


def transcript_user_turns(rows: DataFrame) -> DataFrame:
    """User messages with their plain text and estimated tokens."""
    said = F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    return rows.where("type = 'user'").select("session_id", F.col("uuid").alias("user_uuid"), "parent", "ts", said.alias("text"), text.approximate_tokens(F.octet_length(said)).alias("tokens"))


def user_ancestors(rows: DataFrame) -> DataFrame:
    """For every row its nearest user prompt up the parent chain (node, prompt), however long; cycles and broken chains have none.

    A pointer stops at a prompt; until then it doubles each round, so rounds grow with the logarithm of the longest chain.
    """
    from ledgerloom.sources.scratch import cut

    users = rows.where("type = 'user'").select(F.col("uuid").alias("at"), F.lit(True).alias("prompt"))
    step = rows.where("parent is not null").groupBy(F.col("uuid").alias("node")).agg(F.min("parent").alias("at"))
    open_ends = cut(step.join(users, "at", "left").select("node", "at", F.coalesce("prompt", F.lit(False)).alias("done")))
    for _ in range(rows.count().bit_length() + 1):
        here = open_ends.where("not done")
        if here.isEmpty():
            break
        far = open_ends.select(F.col("node").alias("at"), F.col("at").alias("far"), F.col("done").alias("far_done"))
        open_ends = cut(here.join(far, "at").select("node", F.col("far").alias("at"), F.col("far_done").alias("done")).union(open_ends.where("done")))
    return open_ends.where("done").select("node", F.col("at").alias("prompt"))


_ROLLOUT = "timestamp string, type string, payload string"


def rollout_turns(spark: SparkSession, path: str) -> DataFrame:
    """Turns of rollout logs up to the last complete one; usage is the growth of the running totals."""
    from ledgerloom.sources import rollouts

    return rollouts.as_turns(rollouts.turns(rollouts.read_lines(spark, path)))


def storage_turns(spark: SparkSession, root: str) -> DataFrame:
    """Turns of a storage tree (message/<session>/<id>.json and part/<message>/<id>.json)."""
    message = spark.read.schema("id string, sessionID string, role string, time struct<created: bigint>, providerID string, modelID string, path struct<cwd: string>, tokens struct<input: bigint, output: bigint, reasoning: bigint, cache: struct<read: bigint, write: bigint>>").json(f"{root}/message/*/*.json", multiLine=True)
    part = spark.read.schema("id string, type string, callID string, tool string, reason string, state struct<status: string, input: string>").option("pathGlobFilter", "*.json").json(f"{root}/part/*/*.json", multiLine=True).withColumn("message_id", F.regexp_extract(F.input_file_name(), r"/part/([^/]+)/", 1))
    name = text.tool_name(F.col("tool"))
    call = F.when(F.col("type") == "tool", F.struct(F.col("callID").alias("id"), name.alias("name"), _target(name, F.col("state.input")).alias("target"), F.get_json_object("state.input", "$.command").alias("command"), text.short_hash(F.coalesce("state.input", F.lit(""))).alias("args_hash")))
    parts = part.groupBy("message_id").agg(F.transform(F.array_sort(F.collect_list(F.when(call.isNotNull(), F.struct("id", call.alias("c"))))), lambda x: x["c"]).alias("calls"), F.max_by("reason", F.when(F.col("type") == "step-finish", F.col("id"))).alias("stop"))
    a = message.where("role = 'assistant'").withColumnRenamed("id", "message_id").join(parts, "message_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    order = Window.partitionBy("sessionID").orderBy("time.created", "message_id")
    return a.withColumns({
        "source": F.lit("opencode"), "session_id": F.col("sessionID"), "turn_index": (F.row_number().over(order) - 1).cast("long"), "ts": F.timestamp_millis("time.created"), "model": F.when(F.col("providerID").isNull(), F.col("modelID")).otherwise(F.concat_ws("/", "providerID", "modelID")),
        "input_tokens": n("tokens.input"), "output_tokens": n("tokens.output"), "reasoning_tokens": n("tokens.reasoning"), "cache_read": n("tokens.cache.read"), "cache_create_5m": n("tokens.cache.write"), "cache_create_1h": F.lit(0).cast("long"), "stop_reason": text.stop_reason(F.col("stop")),
        "request_id": F.lit(None).cast("string"), "sidechain": F.lit(False), "cwd": F.col("path.cwd"),
    }).select(*TURN)


READERS = {"transcript": lambda spark, path: transcript_turns(transcript_rows(spark, path)), "rollout": rollout_turns, "storage": storage_turns}
