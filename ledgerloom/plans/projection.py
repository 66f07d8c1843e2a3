"""The driver's event table seen as a ledger of turns: the same columns that the log readers make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _pick(number: Column, values: list[str | None]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(number, F.lit(len(values))).cast("int"))


# How event numbers and types map to a turn's descriptive columns.
SOURCES = ["claude-code", "codex", "opencode"]
MODELS = ["claude-sonnet-4-6", "claude-haiku-4-5", "claude-opus-4-8", "gpt-5.5", "hf:acme/claude-sonnet-4-6", "mystery-model"]
STOPS = ["end_turn", "tool_use", "max_tokens", None, "refusal", "odd", "end_turn"]
TOOLS = {"view": "Read", "signup": "Edit", "purchase": "Task"}
ACTIVITIES = {"view": "review", "signup": "coding", "purchase": "delegation", "error": "debugging"}


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    e = e.withColumn("k", k).withColumn("turn_index", (F.row_number().over(order) - 1).cast("long"))
    n = F.col("event_id")
    tool = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TOOLS.items() for x in kv]), F.col("event_type")), F.lit("Bash"))
    activity = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ACTIVITIES.items() for x in kv]), F.col("event_type")), F.lit("testing"))
    return e.select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.concat(F.lit("m"), n.cast("string")).alias("message_id"), "event_id", "turn_index", F.col("ts").cast("timestamp").alias("ts"),
        _pick(n, SOURCES).alias("source"), _pick(n, MODELS).alias("model"), ((F.col("k") + 1) * 40).alias("input_tokens"), F.floor(F.col("value") * 10).cast("long").alias("output_tokens"),
        F.when(n % 4 == 0, F.col("k") * 3).otherwise(0).cast("long").alias("reasoning_tokens"), (F.col("turn_index") * 150 + F.col("k") * 10).cast("long").alias("cache_read"),
        F.when(n % 2 == 0, F.col("k") * 5).otherwise(0).cast("long").alias("cache_create_5m"), F.when(n % 10 == 0, F.col("k")).otherwise(0).cast("long").alias("cache_create_1h"),
        tool.alias("tool_name"), (F.col("event_type") == "error").cast("int").alias("is_error"), F.concat(F.lit("/src/f"), (F.col("k") % 20).cast("string"), F.lit(".ts")).alias("target"),
        _pick(n, STOPS).alias("stop_reason"), activity.alias("activity"), (F.col("k") * 7).alias("result_tokens"), F.col("k"),
    )


#: The same columns as DuckDB SQL: ``with {TURNS_SQL} select ... from turns``.
TURNS_SQL = """
e as (select event_id, ts, user_id, event_type, value, cast(json_extract_string(props, '$.k') as bigint) k,
  cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) turn_index from events),
turns as (select concat('s', cast(user_id as varchar)) session_id, concat('m', cast(event_id as varchar)) message_id, event_id, turn_index, ts,
  case event_id % 3 when 0 then 'claude-code' when 1 then 'codex' else 'opencode' end source,
  case event_id % 6 when 0 then 'claude-sonnet-4-6' when 1 then 'claude-haiku-4-5' when 2 then 'claude-opus-4-8' when 3 then 'gpt-5.5' when 4 then 'hf:acme/claude-sonnet-4-6' else 'mystery-model' end model,
  (k + 1) * 40 input_tokens, cast(floor(value * 10) as bigint) output_tokens, case when event_id % 4 = 0 then k * 3 else 0 end reasoning_tokens,
  turn_index * 150 + k * 10 cache_read, case when event_id % 2 = 0 then k * 5 else 0 end cache_create_5m, case when event_id % 10 = 0 then k else 0 end cache_create_1h,
  case event_type when 'view' then 'Read' when 'signup' then 'Edit' when 'purchase' then 'Task' else 'Bash' end tool_name,
  case when event_type = 'error' then 1 else 0 end is_error, concat('/src/f', cast(k % 20 as varchar), '.ts') target,
  case event_id % 7 when 0 then 'end_turn' when 1 then 'tool_use' when 2 then 'max_tokens' when 3 then null when 4 then 'refusal' when 5 then 'odd' else 'end_turn' end stop_reason,
  case event_type when 'view' then 'review' when 'signup' then 'coding' when 'purchase' then 'delegation' when 'error' then 'debugging' else 'testing' end activity,
  k * 7 result_tokens, k from e),
rates(priced_as, r_in, r_out, r_read, r_write, mode) as (values ('claude-sonnet-4-6', 3.0::double, 15.0::double, 0.3::double, 3.75::double, 'same'), ('claude-haiku-4-5', 1, 5, 0.1, 1.0, 'same'),
  ('claude-opus-4-8', 5, 25, 0.5, 6.25, 'same'), ('gpt-5.5', 5, 30, 0.5, 5.0, 'included')),
costed as (select t.*, r_in is not null priced, r_in, r_out, r_read, r_write,
  input_tokens / 1e6 * r_in cost_input, output_tokens / 1e6 * r_out cost_output,
  case when r_in is null then null when source = 'codex' or mode = 'included' then 0.0 else reasoning_tokens / 1e6 * r_out end cost_reasoning,
  cache_read / 1e6 * r_read cost_cache_read, (cache_create_5m + cache_create_1h) / 1e6 * r_write cost_cache_create
  from turns t left join rates on priced_as = case when model like 'hf:%' then regexp_extract(model, '^hf:(?:[^/]+/)?(.+)$', 1) else model end),
priced as (select *, cost_input + cost_output + cost_reasoning + cost_cache_read + cost_cache_create cost from costed)
"""


# The calls of a turn by its number's remainder, the commands of Bash calls and the kinds of spawned agents.
CALLS = [["Glob", "Grep", "Read"], ["Edit"], ["Bash", "Bash"], ["Task"], ["skill"], [], ["Edit", "Read"]]
COMMANDS = ["git status", "pytest -q", "gh pr view 7", "cd /x && git diff", "npm run build"]
AGENTS = ["Explore", "Plan", None]


def calls(turns: DataFrame) -> DataFrame:
    """Tool calls of the turns, one row each with the columns of its turn: every twelve turns, four in a row repeat one failing command and three
    others fail; sessions with a number divisible by 5 know no sizes."""
    k, at = F.col("k"), F.pmod("turn_index", F.lit(12))
    names = F.when(at.between(6, 9), F.array(F.lit("Bash"))).otherwise(F.get(F.array(*[F.array(*map(F.lit, c)) if c else F.array().cast("array<string>") for c in CALLS]), F.pmod(k, F.lit(7)).cast("int")))
    rows = turns.drop("tool_name", "target", "is_error").select("*", F.posexplode(names).alias("call_index", "tool_name"))
    i = F.col("call_index")
    file = F.concat(F.lit("/src/f"), F.pmod(F.floor(F.col("turn_index") / 4), F.lit(3)).cast("string"), F.lit(".ts"))
    command = F.when(at.between(6, 9), "pytest -q").otherwise(_pick(k + i, COMMANDS))
    target = F.when(F.col("tool_name").isin("Edit", "Read"), file).when(F.col("tool_name") == "Bash", command).when(F.col("tool_name") == "Task", _pick(k, AGENTS)).when(F.col("tool_name") == "skill", F.when(k % 2 == 0, "fmt").otherwise("lint")).otherwise("*.ts")
    known = F.substring("session_id", 2, 20).cast("long") % 5 != 0
    return rows.withColumns({"tool_use_id": F.concat_ws(":", "message_id", i), "target": target, "is_error": (at.between(2, 4) | at.between(6, 9)).cast("int"), "size": F.when(known, k * 7 + i * 10)}).withColumns({
        "args_hash": F.concat_ws("|", "tool_name", "target"), "skill_name": F.when(F.col("tool_name") == "skill", F.col("target")),
    })


#: The same as DuckDB SQL, after TURNS_SQL: tables ``cl`` and, with verbs of commands, ``cv``.
CALLS_SQL = """
c0 as (select * exclude (tool_name, target, is_error), unnest(range(1, len(names) + 1)) - 1 call_index, unnest(names) tool_name from (select *,
  case when turn_index % 12 between 6 and 9 then ['Bash'] else case k % 7 when 0 then ['Glob', 'Grep', 'Read'] when 1 then ['Edit'] when 2 then ['Bash', 'Bash'] when 3 then ['Task'] when 4 then ['skill'] when 6 then ['Edit', 'Read'] else [] end end names from priced) z),
c1 as (select *, case when tool_name in ('Edit', 'Read') then concat('/src/f', cast(turn_index // 4 % 3 as varchar), '.ts') when tool_name = 'Bash' then case when turn_index % 12 between 6 and 9 then 'pytest -q'
  else ['git status', 'pytest -q', 'gh pr view 7', 'cd /x && git diff', 'npm run build'][(k + call_index) % 5 + 1] end when tool_name = 'Task' then case k % 3 when 0 then 'Explore' when 1 then 'Plan' end when tool_name = 'skill' then case when k % 2 = 0 then 'fmt' else 'lint' end else '*.ts' end target from c0),
cl as (select *, concat(message_id, ':', cast(call_index as varchar)) tool_use_id, concat_ws('|', tool_name, target) args_hash, case when turn_index % 12 between 2 and 4 or turn_index % 12 between 6 and 9 then 1 else 0 end is_error,
  case when cast(substr(session_id, 2) as bigint) % 5 != 0 then k * 7 + call_index * 10 end size from c1),
cv as (select *, case target when 'git status' then 'git status' when 'pytest -q' then 'pytest' when 'gh pr view 7' then 'gh pr' when 'cd /x && git diff' then 'git diff' when 'npm run build' then 'npm run build' end verb from cl where tool_name = 'Bash')
"""
