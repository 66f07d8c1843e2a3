"""Growth of the context from one inference of a rail to its next, with what came between: results, prompts, reminders and compactions.

Inferences and steps of a rail are brought into one order; a running count of inferences numbers the gaps, so every step falls into its gap in one sorted pass. Whether a
session was compacted within a gap is the question whether its last compaction up to the gap's end is not before the gap's begin, which one sorted pass per session answers too.
No step is paired with an inference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of a result that count as one token here, and growth below which a gap isn't told.
BYTES_PER_TOKEN, LEAST = 4, 1000
STEP = "struct<kind: string, name: string, tool_use_id: string, tokens: long, truncated: boolean>"
_KEY = ["session_id", "rail"]


def result_steps(results: DataFrame) -> DataFrame:
    """Steps of tool results (session_id, rail, place, tool_use_id, tool_name, bytes, truncated); ``place`` orders them among a rail's inferences, ``at`` those of one place."""
    step = F.struct(F.lit("tool-result").alias("kind"), F.col("tool_name").alias("name"), "tool_use_id", F.expr(f"bytes div {BYTES_PER_TOKEN}").alias("tokens"), F.coalesce("truncated", F.lit(False)).alias("truncated"))
    return results.select(*_KEY, "place", F.lit(0).alias("at"), step.cast(STEP).alias("step"))


def prompt_steps(prompts: DataFrame) -> DataFrame:
    """Steps of user prompts (session_id, rail, place, text): a prompt, and a reminder of the harness for each one in it."""
    reminders = F.regexp_extract_all("text", F.lit("(?s)<system-reminder>(.*?)</system-reminder>"), F.lit(1))
    own = F.octet_length(F.regexp_replace("text", "(?s)<system-reminder>.*?</system-reminder>", ""))
    none, tokens = F.lit(None).cast("string"), lambda size: F.ceil(size / BYTES_PER_TOKEN).cast("long")
    struct = lambda kind, name, size: F.struct(F.lit(kind).alias("kind"), name.alias("name"), none.alias("tool_use_id"), tokens(size).alias("tokens"), F.lit(False).alias("truncated")).cast(STEP)
    prompt = struct("user-prompt", F.when(F.size(reminders) > 0, "with reminder"), own)
    steps = F.concat(F.array(prompt), F.transform(reminders, lambda r: struct("system-reminder", none, F.octet_length(r))))
    return prompts.select(*_KEY, "place", F.posexplode(steps).alias("at", "step"))


def driver(step: Column) -> Column:
    """A step's name in reports."""
    return F.when(step["kind"] == "tool-result", F.concat(step["name"], F.lit(" result"))).when(step["kind"] == "compaction", F.concat(F.lit("compaction -"), step["tokens"].cast("string"), F.lit(" tok"))).otherwise(F.translate(step["kind"], "-", " "))


def rail_growth(inferences: DataFrame, steps: DataFrame, compactions: DataFrame, least: int = LEAST, top: int | None = 20, rail: str = "all") -> DataFrame:
    """(session_id, rail, turn_id, inference_idx, prior, current, delta, steps, usd): gaps in which the context grew by ``least`` tokens or more, and those of compactions.

    ``inferences`` are (session_id, rail, place, turn_id, start_ts, end_ts, context, cache_read_rate), ``compactions`` (session_id, ts); ``rail`` is all, main or subagent (rails but
    ``main``). A shrinking context with a compaction between counts as growth of 0 and gets a step of the tokens freed; one without is left out unless ``least`` allows it. Steps are in order, the
    compaction last. Growth costs the base cache-read rate, none without a rate. The first ``top`` by growth are kept (None: all).
    """
    if rail != "all":
        inferences = inferences.where((F.col("rail") == "main") == (rail == "main"))
    order = Window.partitionBy(*_KEY).orderBy("place", "is_step")
    marks = inferences.select(*_KEY, "place", F.lit(0).alias("is_step"), F.lit(0).alias("at"), F.struct("turn_id", "start_ts", "end_ts", "context", "cache_read_rate").alias("i"), F.lit(None).cast(STEP).alias("step"))
    both = marks.unionByName(steps.select(*_KEY, "place", F.lit(1).alias("is_step"), "at", F.lit(None).cast(marks.schema["i"].dataType).alias("i"), "step"))
    numbered = both.withColumn("n", F.count_if(F.col("is_step") == 0).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    alone = Window.partitionBy(*_KEY).orderBy("n")
    held = numbered.where("is_step = 1 and n > 0").groupBy(*_KEY, (F.col("n") + 1).alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "at", "step"))), lambda x: x["step"]).alias("steps"))
    gaps = numbered.where("is_step = 0").select(*_KEY, "n", "i.*", F.lag("i.context").over(alone).alias("prior"), F.lag("i.end_ts").over(alone).alias("prev_end")).where("prior is not null")
    gaps = gaps.join(held, [*_KEY, "n"], "left").withColumn("raw", F.col("context") - F.col("prior"))
    # the last compaction up to a gap's end: one pass over a session's compactions and shrinking gaps by time
    shrunk = gaps.where("raw < 0").select("session_id", F.col("start_ts").alias("ts"), F.lit(1).alias("gap"), "rail", "n", "prev_end")
    cuts = compactions.select("session_id", "ts", F.lit(0).alias("gap"), F.lit(None).cast("string").alias("rail"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("timestamp").alias("prev_end"))
    last = F.last(F.when(F.col("gap") == 0, F.col("ts")), ignorenulls=True).over(Window.partitionBy("session_id").orderBy("ts", "gap").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    compacted = shrunk.unionByName(cuts).withColumn("last", last).where("gap = 1 and last >= prev_end").select(*_KEY, "n", F.lit(True).alias("compacted"))
    gaps = gaps.join(compacted, [*_KEY, "n"], "left").withColumn("compacted", F.coalesce("compacted", F.lit(False)))
    freed = F.struct(F.lit("compaction").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("tool_use_id"), (-F.col("raw")).alias("tokens"), F.lit(False).alias("truncated")).cast(STEP)
    all_steps = F.coalesce("steps", F.array().cast(f"array<{STEP}>"))
    out = gaps.select(
        *_KEY, "turn_id", F.col("n").alias("inference_idx"), "prior", F.col("context").alias("current"), F.when(F.col("compacted"), 0).otherwise(F.col("raw")).alias("delta"),
        F.when(F.col("compacted"), F.concat(all_steps, F.array(freed))).otherwise(all_steps).alias("steps"), "compacted", "cache_read_rate",
    ).where((F.col("delta") >= least) | F.col("compacted"))
    out = out.withColumn("usd", F.coalesce(F.greatest("delta", F.lit(0)) / 1e6 * F.col("cache_read_rate"), F.lit(0.0))).drop("cache_read_rate", "compacted")
    by = [F.desc("delta"), F.asc("turn_id"), F.asc("inference_idx"), F.asc(F.col("rail") != "main"), F.asc("rail"), F.asc("session_id")]
    return out if top is None else out.orderBy(*by).limit(top)
