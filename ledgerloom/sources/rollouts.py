"""Rollout logs in full: turns, what came between them, results of calls, and compactions.

A turn runs from a task_started to the task_complete of the same turn, or up to the next task_started. Its usage is what the running totals
grew by. All that a log says counts once a later (or its own) turn is complete; what follows the last complete turn waits for more of the log.

``typed_lines`` gives every line typed columns; the functions after it see a whole log through windows by file. ``streaming.rollouts`` holds the same rules as
keyed state, for logs that grow; a test holds both to equal results on logs cut anywhere.

Results for special input: a line that is no JSON object is passed over; a turn without a context of its own has the model that was told last before it; totals that shrink count as no growth;
a task_complete of a turn that isn't open does nothing; a repeated call id within a turn counts once; an empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import payload, text

_HEADS = ("type", "turn_id", "id", "model", "cwd", "role", "content", "call_id", "name", "arguments", "input", "output", "success", "status", "exit_code", "agent_id", "subagent_id", "session_id")
_LINE = f"timestamp string, type string, payload struct<{', '.join(f'{c}: string' for c in _HEADS)}, info: struct<total_token_usage: string>>"
_TOLD = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")
CALL = "struct<id: string, name: string, target: string, command: string, args_hash: string>"
TOTALS = ("input", "cached", "output", "reasoning")
#: The columns of ``typed_lines`` after file and line.
FIELDS = (
    "ts timestamp, kind string, turn string, session string, model string, cwd string, input long, cached long, output long, reasoning long, "
    f"call_id string, call {CALL}, failed boolean, said long, result_bytes long, status string, agent string"
)


def _row(parsed: Column, *names: str) -> Column:
    """A struct's fields as columns of their own, by a generator of one row: what is built on them can't be pushed below and parse the text again for each mention."""
    return F.inline(F.array(parsed)).alias(*names)


def typed_lines(lines: DataFrame) -> DataFrame:
    """(file, line, ts, kind, ...) of (file, line, value); kinds that nothing here uses are left out. A line is parsed once; what only one kind has is looked at there only."""
    r = lines.where(F.ltrim("value").startswith("{")).select("file", "line", _row(F.from_json("value", _LINE), "timestamp", "outer", "body")).where("body is not null").select("file", "line", "timestamp", "outer", "body.*")
    outer, inner = F.col("outer"), F.col("type")
    ended = inner.rlike("^subagent_.*_(complete|done|finished|terminated)$")
    kind = (
        F.when(outer.isin("session_meta", "turn_context", "compacted"), outer)
        .when((outer == "event_msg") & inner.isin("token_count", "task_started", "task_complete"), inner)
        .when((outer == "event_msg") & inner.isin("exec_command_end", "patch_apply_end"), "end")
        .when((outer == "event_msg") & ended, "notification")
        .when((outer == "response_item") & inner.isin("function_call", "custom_tool_call"), "call")
        .when((outer == "response_item") & inner.isin("function_call_output", "custom_tool_call_output"), "result")
        .when((outer == "response_item") & (inner == "message") & (F.col("role") == "user"), "said")
    )
    is_a = lambda k: F.col("kind") == k
    parts = F.filter(F.from_json("content", "array<struct<type: string, text: string>>"), lambda p: p["text"].isNotNull() & ~payload.boilerplate(p["text"]))
    said = F.when(is_a("said"), F.octet_length(F.array_join(F.transform(parts, lambda p: p["text"]), "\n"))).cast("long")
    known = r.withColumn("kind", kind).where("kind is not null and not (kind = 'task_started' and turn_id is null) and not (kind in ('call', 'result', 'end', 'notification') and coalesce(call_id, '') = '')")
    known = known.withColumn("totals", F.col("info.total_token_usage")).where("not (kind = 'token_count' and totals is null)").withColumn("said", said).where("not (kind = 'said' and coalesce(said, 0) = 0)")
    arg = lambda k: F.get_json_object("arguments", f"$.{k}")
    total = lambda c: F.get_json_object("totals", f"$.{c}").try_cast("long")
    call = F.struct(F.col("call_id").alias("id"), text.tool_name(F.col("name")).alias("name"), F.coalesce(arg("path"), arg("command"), "input").alias("target"), arg("command").alias("command"), text.short_hash(F.coalesce("arguments", "input", F.lit(""))).alias("args_hash"))
    success, told = F.col("success"), F.lower("status")
    status = (
        F.when(success == "true", "completed").when(success == "false", "errored").when(told.isin("errored", "failed", "error"), "errored").when(told.isin("cancelled", "canceled"), "cancelled").otherwise("completed")
    )
    agent = F.coalesce("agent_id", "subagent_id", "session_id", *[F.get_json_object("output", f"$.{k}") for k in ("agent_id", "agentId", "id")])
    return known.select(
        "file", "line", F.try_to_timestamp("timestamp").alias("ts"), "kind", F.col("turn_id").alias("turn"), F.when(is_a("session_meta"), F.col("id")).alias("session"), "model", "cwd",
        *[F.when(is_a("token_count"), F.coalesce(total(told), F.lit(0))).alias(c) for c, told in zip(TOTALS, _TOLD, strict=True)],
        "call_id", F.when(is_a("call"), call).alias("call"), (is_a("end") & (F.coalesce(F.col("exit_code").try_cast("int") != 0, F.lit(False)) | F.coalesce(success == "false", F.lit(False)))).alias("failed"),
        "said", F.when(is_a("result"), F.coalesce(F.octet_length("output"), F.lit(0))).cast("long").alias("result_bytes"), F.when(is_a("notification"), status).alias("status"), F.when(is_a("notification"), agent).alias("agent"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return typed_lines(spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), "value"))


def placed(lines: DataFrame) -> DataFrame:
    """Typed lines with their turn's number within the file (0 before the first), the turn that was started last, whether it is
    open at the line, the line of its end, and the last line that counts."""
    by_file = Window.partitionBy("file").orderBy("line")
    so_far, whole = by_file.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("file")
    started = F.col("kind") == "task_started"
    r = lines.withColumn("n", F.count_if(started).over(so_far)).withColumn("current", F.last(F.when(started, F.col("turn")), ignorenulls=True).over(so_far))
    own = Window.partitionBy("file", "n")
    r = r.withColumn("end", F.min(F.when((F.col("kind") == "task_complete") & (F.col("turn") == F.col("current")), F.col("line"))).over(own))
    session = F.coalesce(F.last("session", ignorenulls=True).over(whole.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.regexp_extract("file", r"([0-9a-fA-F]{8}-[0-9a-fA-F-]{27})\.jsonl$", 1))
    return r.withColumns({"last": F.max("end").over(whole), "open": (F.col("n") > 0) & (F.col("end").isNull() | (F.col("line") <= F.col("end"))), "session_id": session, "told_so_far": F.last(F.when(F.col("kind") == "turn_context", F.col("model")), ignorenulls=True).over(so_far), **{f"so_far_{c}": F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.lit(0)) for c in TOTALS}})


def _islands(lines: DataFrame) -> DataFrame:
    """All that follows one task_started up to the next, and what lies before the first (n 0), a row each: a turn's usage, calls and contexts, and the compactions in it. The lines are gone through once."""
    so_far = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start, context = F.col("kind") == "task_started", F.col("kind") == "turn_context"
    p = placed(lines).withColumn("folder_so_far", F.last(F.when(F.col("kind") == "session_meta", F.col("cwd")), ignorenulls=True).over(so_far))
    p = p.withColumn("told_before", F.last(F.when(context, F.struct("model", "cwd")), ignorenulls=True).over(Window.partitionBy("file", "turn").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = lambda c: F.max(F.when(start, F.col(f"so_far_{c}")))
    final = lambda c: F.max_by(f"so_far_{c}", F.when(F.col("open") | F.col("end").isNull(), F.col("line")))
    grown = {c: F.greatest(final(c) - at(c), F.lit(0)) for c in TOTALS}
    fresh = F.greatest((final("input") - final("cached")) - (at("input") - at("cached")), F.lit(0))
    p = p.withColumn("own_call", F.when((F.col("kind") == "call") & F.col("open"), F.col("call_id"))).withColumn("fresh_call", F.row_number().over(Window.partitionBy("file", "n", "own_call").orderBy("line")) == 1)
    calls = F.transform(F.array_sort(F.collect_list(F.when(F.col("own_call").isNotNull() & F.col("fresh_call"), F.struct("line", "call")))), lambda x: x["call"])
    late = context & F.col("open") & (F.col("turn") == F.col("current"))
    folder = F.col("open") & F.col("cwd").isNotNull() & ((F.col("kind") == "session_meta") | late)
    return p.groupBy("file", "n", "session_id", "current", "last", "end").agg(
        F.min(F.when(start, F.col("ts"))).alias("ts"), F.min("line").alias("start"), fresh.alias("input_tokens"), grown["cached"].alias("cache_read"), grown["output"].alias("output_tokens"), grown["reasoning"].alias("reasoning_tokens"), calls.alias("calls"),
        F.max(F.when(start, F.col("told_so_far"))).alias("told_last"), F.max(F.when(start, F.col("folder_so_far"))).alias("session_cwd"), F.max(F.when(start, F.col("told_before"))).alias("before"),
        F.min_by("model", F.when(late & F.col("model").isNotNull(), F.col("line"))).alias("model_within"), F.min_by("cwd", F.when(folder, F.col("line"))).alias("cwd_within"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "compacted", F.struct("line", "ts")))).alias("compacted"),
    )


def turns(lines: DataFrame) -> DataFrame:
    """Turns up to the last complete one: (file, session_id, message_id, turn_index, ts, model, cwd, usage, calls, start, end)."""
    # the context told last before the start counts, else the first one while the turn is open; else the session's folder
    full, order = _islands(lines).where("n > 0 and start <= last"), Window.partitionBy("file").orderBy("start")
    return full.select(
        "file", "n", "session_id", F.col("current").alias("message_id"), (F.row_number().over(order) - 1).cast("long").alias("turn_index"), "ts", F.coalesce("before.model", "model_within", "told_last").alias("model"),
        F.coalesce("before.cwd", "session_cwd", "cwd_within").alias("cwd"), "input_tokens", "cache_read", "output_tokens", "reasoning_tokens", "calls", "start", "end",
    )


def user_turns(lines: DataFrame) -> DataFrame:
    """What lay between a turn's start and the next one's: texts of the user and results, with sizes; (file, session_id, user_uuid, ts, preceding, following, blocks).

    An island of lines is all that follows one task_started; it is the user turn before the next.
    """
    p = placed(lines)
    block = F.struct(
        F.when(F.col("kind") == "said", "text").otherwise("tool_result").alias("kind"), F.when(F.col("kind") == "result", F.col("call_id")).alias("tool_use_id"), F.coalesce("said", "result_bytes").alias("bytes"),
        text.approximate_tokens(F.coalesce("said", "result_bytes")).alias("tokens"), F.lit(False).alias("is_error"),
    )
    has = F.col("kind").isin("said", "result")
    failed = F.collect_set(F.when((F.col("kind") == "end") & F.col("failed") & F.col("open") & F.col("end").isNotNull() & (F.col("turn") == F.col("current")), F.col("call_id")))
    island = p.groupBy("file", "session_id", "n", "last").agg(
        F.array_sort(F.collect_list(F.when(has, F.struct("line", block.alias("b"))))).alias("blocks"), F.min_by("ts", F.when(has & F.col("ts").isNotNull(), F.col("line"))).alias("ts"), F.max(F.when(F.col("end").isNotNull(), F.col("current"))).alias("preceding"),
        F.max("end").alias("end"), failed.alias("failed"), F.max(F.when(F.col("kind") == "task_started", F.struct(F.col("turn").alias("following"), F.col("ts").alias("next_ts"), F.col("line").alias("next_line")))).alias("started"),
    )
    # every number but the first has a start, so the next island's is the next one
    out = island.withColumn("next", F.lead("started").over(Window.partitionBy("file").orderBy("n"))).select("*", "next.*").where("size(blocks) > 0 and next_line <= last")
    # a result that came before its turn's end is marked by the ends of commands within the turn
    marked = F.transform("blocks", lambda x: F.struct(*[x["b"][f].alias(f) for f in ("kind", "tool_use_id", "bytes", "tokens")], ((x["line"] <= F.coalesce("end", F.lit(-1))) & x["b"]["tool_use_id"].isNotNull() & F.array_contains("failed", x["b"]["tool_use_id"])).alias("is_error")))
    uuid = F.concat(F.col("session_id"), F.lit(":"), F.coalesce("preceding", F.lit("start")), F.lit("->"), F.col("following"))
    return out.select("file", "session_id", uuid.alias("user_uuid"), F.coalesce("ts", "next_ts").alias("ts"), "preceding", "following", F.transform(marked, lambda b: b.withField("is_error", F.coalesce(b["is_error"], F.lit(False)))).alias("blocks"))


def results(lines: DataFrame) -> DataFrame:
    """Outputs of calls and ends of subagents: (file, session_id, message_id, tool_use_id, call_index, event_index, ts, status, event_source, bytes, agent_id).

    A result outside a turn has no message; those of a turn that was broken off are left out.
    """
    p = placed(lines)
    ended = (F.col("kind") == "end") & F.col("failed") & F.col("open") & F.col("end").isNotNull() & (F.col("turn") == F.col("current"))
    p = p.where("kind in ('result', 'notification', 'end')").withColumn("bad", F.max(ended).over(Window.partitionBy("file", "n", "call_id")))
    events = p.where("kind in ('result', 'notification')")
    order = lambda *c: Window.partitionBy("file", *c).orderBy("line")
    events = events.withColumns({"call_index": (F.row_number().over(order("call_id")) - 1).cast("long"), "event_index": (F.row_number().over(order()) - 1).cast("long")}).where("line <= last and not (open and end is null)")
    status = F.when(F.col("open") & F.col("bad"), "errored").when(F.col("kind") == "notification", F.col("status")).when(F.col("open"), "completed").otherwise("unknown")
    return events.select(
        "file", "session_id", F.when(F.col("open"), F.col("current")).alias("message_id"), F.col("call_id").alias("tool_use_id"), "call_index", "event_index", "ts", status.alias("status"),
        F.when(F.col("kind") == "result", "function_call_output").otherwise("subagent_notification").alias("event_source"), F.col("result_bytes").alias("bytes"), F.when(F.col("kind") == "notification", F.col("agent")).alias("agent_id"),
    )


def compactions(lines: DataFrame) -> DataFrame:
    """(file, session_id, ts, preceding, tokens_before): compactions with the last complete turn before them and its cache read."""
    done = F.when(F.col("end").isNotNull(), F.struct(F.col("current").alias("message_id"), "cache_read"))
    earlier = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    found = _islands(lines).withColumn("own", done).withColumn("earlier", F.last("own", ignorenulls=True).over(earlier))
    each = found.select("file", "session_id", "last", "end", "own", "earlier", F.explode("compacted").alias("c")).where("c.line <= last")
    told = F.when(F.col("c.line") >= F.col("end"), F.col("own")).otherwise(F.col("earlier"))
    return each.select("file", "session_id", "c.ts", told["message_id"].alias("preceding"), told["cache_read"].alias("tokens_before"))


def as_turns(found: DataFrame) -> DataFrame:
    """The shared columns of turns of all log formats."""
    from ledgerloom.sources.readers import TURN

    nothing = {"source": F.lit("codex"), "cache_create_5m": F.lit(0).cast("long"), "cache_create_1h": F.lit(0).cast("long"), "stop_reason": F.lit(None).cast("string"), "request_id": F.lit(None).cast("string"), "sidechain": F.lit(False)}
    return found.withColumns(nothing).select(*TURN)


def usage_known(usage_observed: Column) -> Column:
    """Coverage of a turn by its own log: token counts only if the log told totals within it; never cache writes."""
    seen = F.coalesce(usage_observed, F.lit(False))
    yes, no = F.lit(True), F.lit(False)
    return F.struct(*[seen.alias(f"has_{c}_tokens") for c in ("input", "output", "reasoning", "cache_read")], no.alias("has_cache_create_tokens"), *[yes.alias(c) for c in ("has_tool_calls", "has_tool_results", "has_relationships", "has_content")])
