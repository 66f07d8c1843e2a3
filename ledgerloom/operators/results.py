"""Tool results brought to their calls and turns: sizes, texts, events, sidecars and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.payload import is_carrier, result_text
from ledgerloom.functions.text import tool_name

_SESSION = ["source", "session_id"]


def result_bytes(calls: DataFrame, events: DataFrame) -> DataFrame:
    """Calls with ``output_bytes`` and ``output_truncated``: the first event of the call that has a length (content_length, truncated, event_index)."""
    first = events.where("content_length is not null").groupBy("session_id", "tool_use_id").agg(F.min_by(F.struct("content_length", "truncated"), "event_index").alias("e"))
    told = first.select("session_id", "tool_use_id", F.col("e.content_length").alias("output_bytes"), F.coalesce("e.truncated", F.lit(False)).alias("output_truncated"))
    return calls.join(told, ["session_id", "tool_use_id"], "left")


def result_sizes(calls: DataFrame, blocks: DataFrame, content: DataFrame | None = None) -> DataFrame:
    """Calls with ``size`` in tokens: the last user-turn block (tool_use_id, approx_tokens, position) of the call, else a quarter of the UTF-16 length of
    its content (tool_use_id, content as JSON, position), rounded up; null if neither is there."""
    stated = blocks.where("tool_use_id is not null").groupBy("session_id", "tool_use_id").agg(F.max_by("approx_tokens", "position").alias("stated"))
    out = calls.drop("size").join(stated, ["session_id", "tool_use_id"], "left")
    if content is None:
        return out.withColumnRenamed("stated", "size")
    text = result_text(F.col("content"))
    units = F.char_length(text) + F.char_length(F.regexp_replace(text, r"[\x{0}-\x{FFFF}]", ""))
    seen = content.groupBy("session_id", "tool_use_id").agg(F.max_by(F.ceil(units / 4).cast("long"), "position").alias("measured"))
    return out.join(seen, ["session_id", "tool_use_id"], "left").withColumn("size", F.coalesce("stated", "measured")).drop("stated", "measured")


def bridged(turns: DataFrame, user_turns: DataFrame) -> DataFrame:
    """User turns with the indexes of the turns before and after them, by message ids."""
    t = turns.select("session_id", "message_id", "turn_index")
    before = t.select("session_id", F.col("message_id").alias("preceding_message_id"), F.col("turn_index").alias("before"))
    after = t.select("session_id", F.col("message_id").alias("following_message_id"), F.col("turn_index").alias("after"))
    return user_turns.join(before, ["session_id", "preceding_message_id"], "left").join(after, ["session_id", "following_message_id"], "left")


def events_with_calls(events: DataFrame, calls: DataFrame) -> DataFrame:
    """Events with the tool, arguments hash and turn of their call, null where there is none. A call id counts once, the first of its session."""
    first = calls.groupBy("session_id", "tool_use_id").agg(F.min_by(F.struct("tool_name", "args_hash", "turn_index"), F.struct("turn_index", "call_index")).alias("c"))
    return events.join(first, ["session_id", "tool_use_id"], "left").select(*events.columns, "c.tool_name", "c.args_hash", F.col("c.turn_index").alias("turn_index"))


def event_tokens(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """Events with ``tokens``: of a carrier what the user turn says of its call, else a quarter of its length in bytes, rounded up; null without one."""
    stated = blocks.where("tool_use_id is not null").groupBy(*_SESSION, "tool_use_id").agg(F.max_by("approx_tokens", "position").alias("stated"))
    length = F.when(F.col("content_length") > 0, F.ceil(F.col("content_length") / 4).cast("long"))
    out = events.join(stated, [*_SESSION, "tool_use_id"], "left")
    return out.withColumn("tokens", F.coalesce(F.when(is_carrier(F.col("event_source")), F.col("stated")), length)).drop("stated")


def event_models(events: DataFrame, turns: DataFrame) -> DataFrame:
    """Events with the model of their turn, else the first model of their session."""
    own = turns.select(*_SESSION, "message_id", F.col("model").alias("own_model")).dropDuplicates([*_SESSION, "message_id"])
    first = turns.groupBy(*_SESSION).agg(F.min_by("model", "turn_index").alias("first_model"))
    return events.join(own, [*_SESSION, "message_id"], "left").join(first, _SESSION, "left").withColumn("model", F.coalesce("own_model", "first_model")).drop("own_model", "first_model")


def asof(rows: DataFrame, marks: DataFrame, value: str, inclusive: bool, name: str) -> DataFrame:
    """Rows (session_id, ts) with ``name``: ``value`` of the last mark (session_id, ts, value) at or before their time, or before it. One sort a
    session of both, no pairs."""
    side = F.lit(0 if inclusive else 2)
    a = marks.select("session_id", "ts", side.alias("side"), F.col(value).alias("v"), F.lit(None).cast("long").alias("row"))
    keyed = rows.withColumn("row", F.xxhash64(*[F.col(c).cast("string") for c in rows.columns]))
    b = keyed.select("session_id", "ts", F.lit(1).alias("side"), F.lit(None).cast(marks.schema[value].dataType).alias("v"), "row")
    line = Window.partitionBy("session_id").orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = a.unionByName(b).withColumn(name, F.last("v", ignorenulls=True).over(line)).where("side = 1").select("row", name).dropDuplicates(["row"])
    return keyed.join(found, "row", "left").drop("row")


def around(rows: DataFrame, users: DataFrame, assistants: DataFrame) -> DataFrame:
    """Rows with the last user prompt at or before them and the last assistant message before them."""
    return asof(asof(rows, users, "message_id", True, "user_before"), assistants, "message_id", False, "assistant_before")


def sidecar_turns(sidecars: DataFrame, calls: DataFrame, turns: DataFrame) -> DataFrame:
    """Sidecars (session_id, agent_id, tool_use_id, ts) with the turn that sent them: of their call, else the last turn at or before their time."""
    sent = calls.select("session_id", "tool_use_id", F.col("turn_index").alias("by_call")).dropDuplicates(["session_id", "tool_use_id"])
    out = asof(sidecars.join(sent, ["session_id", "tool_use_id"], "left"), turns.select("session_id", "ts", "turn_index"), "turn_index", True, "by_time")
    return out.withColumn("turn_index", F.coalesce("by_call", "by_time")).drop("by_call", "by_time")


def spawned(events: DataFrame, agents: DataFrame) -> DataFrame:
    """Events with the agent (agent_id, parent_tool_use_id) that their call started."""
    by_call = agents.select("session_id", F.col("parent_tool_use_id").alias("tool_use_id"), "agent_id").dropDuplicates(["session_id", "tool_use_id"])
    return events.join(by_call, ["session_id", "tool_use_id"], "left")


def of_sessions(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of the sessions that ``kept`` has any row of."""
    keys = [c for c in _SESSION if c in rows.columns and c in kept.columns]
    return rows.join(kept.select(*keys).distinct(), keys, "left_semi")


def observed_names(calls: DataFrame) -> DataFrame:
    """(source, name) of all that sessions used: tools, skills and kinds of subagents."""
    kinds = F.when(tool_name(F.col("tool_name")).isin("Agent", "Task"), F.col("target"))
    return calls.select("source", F.explode(F.array("tool_name", "skill_name", kinds)).alias("name")).where("name is not null").distinct()


def mined_names(texts: DataFrame) -> DataFrame:
    """(source, name) of slash commands in user texts (source, text): ``<command-name>`` marks, and ``/stem`` between blanks or at the edges."""
    marked = F.regexp_extract_all("text", F.lit(r"<command-name>/?([A-Za-z0-9_:-]+)</command-name>"), F.lit(1))
    plain = F.regexp_extract_all("text", F.lit(r"(?:^|(?<=\s))/([A-Za-z0-9_:-]+)(?=\s|$)"), F.lit(1))
    return texts.select("source", F.explode(F.array_union(marked, plain)).alias("name")).distinct()


def coverage(turns: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """Per ``key`` and coverage flag how many turns are known and missing; no flag at all counts as known."""
    known = [F.count_if(F.coalesce(f, F.lit(True))).alias(f"{f}_known") for f in flags]
    return turns.groupBy(key).agg(F.count("*").alias("turns"), *known, *[F.count_if(~F.coalesce(f, F.lit(True))).alias(f"{f}_missing") for f in flags])


def tag_totals(turns: DataFrame, tag: str) -> DataFrame:
    """Turns and cost by the value of a tag, and those without it."""
    value = F.coalesce(F.try_element_at("enrichment", F.lit(tag)), F.lit("(untagged)"))
    return turns.groupBy(value.alias("value")).agg(F.count("*").alias("turns"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"))


def dominant_method(spots: DataFrame) -> DataFrame:
    """Per tool the attribution method of most of its cost (of equals the one that sorts first)."""
    each = spots.groupBy("tool_name", "method").agg(F.sum("total_cost").alias("c"), F.count("*").alias("n"))
    return each.groupBy("tool_name").agg(F.min_by("method", F.struct(-F.round("c", 9), -F.col("n"), "method")).alias("method"))


def representative_rate(turns: DataFrame) -> DataFrame:
    """One row: base cache-read price of the model that most turns name and that has one (of equals the first by name)."""
    counted = turns.where("cache_read_rate is not null").groupBy("model").agg(F.count("*").alias("n"), F.first("cache_read_rate").alias("r"))
    return counted.agg(F.max_by("r", F.struct("n", "model")).alias("cache_read_rate"))


def sessions_by_source(turns: DataFrame) -> DataFrame:
    return turns.groupBy("source").agg(F.countDistinct("session_id").alias("sessions"))


def pattern_summary(findings: DataFrame) -> DataFrame:
    """Per session how many findings of each kind, the worst severity, and their cost."""
    rank = F.array_position(F.array(*[F.lit(s) for s in ("info", "warn", "high", "unpriced")]), F.col("severity"))
    each = findings.where("session_id is not null").groupBy("session_id", "kind").agg(F.count("*").alias("n"), F.sum("usd").alias("c"), F.max_by("severity", rank).alias("s"), F.max(rank).alias("r"))
    kinds = F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n"))))
    return each.groupBy("session_id").agg(kinds.alias("kinds"), F.sum("n").alias("findings"), F.sum("c").alias("usd"), F.max_by("s", "r").alias("worst"))


def span_total(spans: DataFrame, column: str, by: Column | str = "session_id") -> DataFrame:
    """Sum of an attribute over the spans of each tree."""
    return spans.groupBy(by).agg(F.sum(F.coalesce(column, F.lit(0))).alias(column))
