"""Queries over logs that the driver's events are written as, by name, with the DuckDB SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.plans.projection import TURNS_SQL, turns
from ledgerloom.plans.registry import ORACLES, QUERIES
from ledgerloom.sources import rollouts
from ledgerloom.sources.scratch import folder


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"with {TURNS_SQL}{sql}"
        return f

    return add


def rollout_lines(spark, d) -> DataFrame:
    """(file, line, value): every turn as seven lines of a rollout log, a file a session. Turns whose event number is divisible by 5 are broken off; every ninth
    call fails; before every fourth turn the context was compacted."""
    t = turns(spark, d)
    so_far = Window.partitionBy("session_id").orderBy("turn_index")
    total = lambda c: F.sum(c).over(so_far)
    cached, n = F.col("k") * 10, F.col("event_id")
    t = t.withColumn("grow", F.greatest("output_tokens", F.lit(0))).withColumns({"t_in": total(F.col("input_tokens") + cached), "t_cached": total(cached), "t_out": total("grow")})
    t = t.withColumn("told", F.coalesce(F.concat(F.lit('"timestamp":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('",')), F.lit("")))
    call = F.concat(F.lit("c"), n.cast("string"))

    def line(kind: str, **fields):
        body = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
        return F.concat(F.lit("{"), F.col("told"), F.lit(f'"type":"{kind}","payload":'), body, F.lit("}"))

    turn = F.col("message_id")
    usage = F.struct(F.struct(F.col("t_in").alias("input_tokens"), F.col("t_cached").alias("cached_input_tokens"), F.col("t_out").alias("output_tokens"), F.lit(0).alias("reasoning_output_tokens")).alias("total_token_usage"))
    parts = [
        (line("session_meta", id=F.col("session_id"), cwd=F.lit("/w")), F.col("turn_index") == 0),
        (line("compacted", at=n), F.col("turn_index") % 4 == 3),
        (line("turn_context", turn_id=turn, model=F.col("model")), F.lit(True)),
        (line("event_msg", type=F.lit("task_started"), turn_id=turn), F.lit(True)),
        (line("response_item", type=F.lit("message"), role=F.lit("user"), content=F.array(F.struct(F.lit("input_text").alias("type"), F.repeat(F.lit("ab"), (F.col("k") + 1).cast("int")).alias("text")))), F.lit(True)),
        (line("response_item", type=F.lit("function_call"), name=F.lit("shell"), arguments=F.lit('{"command":"ls"}'), call_id=call), F.lit(True)),
        (line("response_item", type=F.lit("function_call_output"), call_id=call, output=F.repeat(F.lit("x"), F.col("k").cast("int"))), F.lit(True)),
        (line("event_msg", type=F.lit("exec_command_end"), call_id=call, turn_id=turn, exit_code=(n % 9 == 0).cast("int")), F.lit(True)),
        (line("event_msg", type=F.lit("token_count"), info=usage), F.lit(True)),
        (line("event_msg", type=F.lit("task_complete"), turn_id=turn), n % 5 != 0),
    ]
    texts = F.array(*[F.when(when, value) for value, when in parts])
    rows = t.select(F.col("session_id").alias("file"), "turn_index", F.posexplode(texts).alias("at", "value")).where("value is not null")
    return rows.select("file", (F.col("turn_index") * len(parts) + F.col("at")).alias("line"), "value")


# what counts: the turns up to the last complete one of a session, and the results of complete ones
_DONE = """, dn as (select session_id s, max(turn_index) filter (event_id % 5 <> 0) last from turns group by 1), rt as (select * from turns join dn on s = session_id where turn_index <= last)"""
_TURNS = _DONE + """ select session_id, count(*) turns, cast(sum(input_tokens) as bigint) input_tokens, cast(sum(k * 10) as bigint) cache_read, cast(sum(greatest(output_tokens, 0)) as bigint) output_tokens,
  count(*) filter (event_id % 5 <> 0) results, count(*) filter (event_id % 5 <> 0 and event_id % 9 = 0) failed, count(*) filter (turn_index % 4 = 3) compactions, count(*) filter (turn_index > 0) user_turns from rt group by 1"""


@_query(_TURNS)
def rollout_batch(spark, d):
    """The logs read whole."""
    lines = rollouts.typed_lines(rollout_lines(spark, d))
    own = rollouts.turns(lines).groupBy("session_id").agg(F.count("*").alias("turns"), *[F.sum(c).alias(c) for c in ("input_tokens", "cache_read", "output_tokens")])
    results = rollouts.results(lines).groupBy("session_id").agg(F.count("*").alias("results"), F.count_if(F.col("status") == "errored").alias("failed"))
    lost = rollouts.compactions(lines).groupBy("session_id").agg(F.count("*").alias("compactions"))
    said = rollouts.user_turns(lines).groupBy("session_id").agg(F.count("*").alias("user_turns"))
    out = own
    for other in (results, lost, said):
        out = out.join(other, "session_id", "left")
    return out.na.fill(0, ["results", "failed", "compactions", "user_turns"])


@_query(_TURNS)
def rollout_resume(spark, d):
    """The same logs as they grow: cut in two at a place of each file's own, read by a stream that is stopped after the first piece and started again."""
    from ledgerloom.streaming.rollouts import STATE_STORE, rollout_records

    at, key = folder(spark), "spark.sql.streaming.stateStore.providerClass"
    lines = rollout_lines(spark, d)
    cut = F.pmod(F.xxhash64("file"), F.lit(97)) * 3 + 5
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)
    try:
        for first in (True, False):
            lines.where((F.col("line") < cut) == first).write.mode("append").parquet(f"{at}/in")
            stream = rollout_records(spark.readStream.schema(lines.schema).parquet(f"{at}/in"))
            stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    count = lambda *which: F.count_if(F.col("record") == which[0] if len(which) == 1 else (F.col("record") == which[0]) & (F.col("status") == which[1]))
    total = lambda c: F.sum(F.when(F.col("record") == "turn", F.col(c))).alias(c)
    out = spark.read.parquet(f"{at}/out").groupBy("session_id").agg(count("turn").alias("turns"), *map(total, ("input_tokens", "cache_read", "output_tokens")), count("result").alias("results"), count("result", "errored").alias("failed"), count("compaction").alias("compactions"), count("user_turn").alias("user_turns"))
    return out


@_query(_DONE + """, bl as (select session_id, turn_index, event_id, (k + 1) * 2 said, k result from rt), nx as (select *, lead(turn_index) over (partition by session_id order by turn_index) nx from bl)
  select session_id, count(*) user_turns, cast(sum(ceil(said / 4.0) + ceil(result / 4.0)) as bigint) tokens, count(*) filter (event_id % 9 = 0 and event_id % 5 <> 0) failed, count(*) filter (event_id % 5 = 0) broken from nx where nx is not null group by 1""")
def rollout_user_turns(spark, d):
    """User turns with the sizes of what they hold."""
    u = rollouts.user_turns(rollouts.typed_lines(rollout_lines(spark, d)))
    size = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + b["tokens"])
    return u.groupBy("session_id").agg(F.count("*").alias("user_turns"), F.sum(size).alias("tokens"), F.count_if(F.exists("blocks", lambda b: b["is_error"])).alias("failed"), F.count_if(F.col("preceding").isNull()).alias("broken"))


@_query(""", q as (select conv_id, turn, list_transform(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x != ''), lambda x: strip_accents(x)) w from conversations where (conv_id + turn) % 7 != 3), n as (select count(*) n, avg(len(w)) m from q),
  h as (select conv_id, turn, len(w) l, len(list_filter(w, lambda x: x in ('the', 'thes', 'theing'))) tf from q), df as (select count(*) d from h where tf > 0)
  select conv_id, turn, round(ln(1 + (n - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m)), 10) score from h, n, df where tf > 0 order by score desc, conv_id * 1000 + turn limit 25""")
def search_stored(spark, d):
    """All conversations through a stored index: in two batches, the first half of whose turns had another text before, and then a seventh of all deleted. The words
    that stem to ``the`` are those that the SQL names."""
    from ledgerloom.sources.text_index import TextIndex

    c = spark.read.parquet(f"{d}/conversations.parquet").withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn"))
    index = TextIndex(spark, folder(spark))
    index.add(c.where("turn < 2").withColumn("text", F.concat(F.lit("the former the "), "text")))
    index.add(c)
    index.delete(c.where((F.col("conv_id") + F.col("turn")) % 7 == 3).select("doc_id"))
    found = index.search("thes")
    return found.select(F.expr("doc_id div 1000").alias("conv_id"), F.pmod("doc_id", F.lit(1000)).alias("turn"), F.round("score", 10).alias("score"))
