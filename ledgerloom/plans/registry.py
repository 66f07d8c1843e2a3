"""All queries over the ledger, by name, with the DuckDB SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import cost, provider, text
from ledgerloom.operators import attribution, filters, joins, rollups, search, sequences, series, sidecars, trees
from ledgerloom.plans.projection import TURNS_SQL, turns
from ledgerloom.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if sql.startswith("with recursive") else f"with {TURNS_SQL}{sql}"
        return f

    return add


def priced_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.with_cost(turns(spark, sf_dir), cost.default_rates(spark))


def _rounded(df: DataFrame, *columns: str, digits: int = 10) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_SUMS = """count(*) turns, cast(sum(input_tokens) as bigint) input_tokens, cast(sum(output_tokens) as bigint) output_tokens, cast(sum(reasoning_tokens) as bigint) reasoning_tokens,
  cast(sum(cache_read) as bigint) cache_read, cast(sum(cache_create_5m) as bigint) cache_create_5m, cast(sum(cache_create_1h) as bigint) cache_create_1h,
  round(sum(coalesce(cost_input, 0)), 10) cost_input, round(sum(coalesce(cost_output, 0)), 10) cost_output, round(sum(coalesce(cost_reasoning, 0)), 10) cost_reasoning,
  round(sum(coalesce(cost_cache_read, 0)), 10) cost_cache_read, round(sum(coalesce(cost_cache_create, 0)), 10) cost_cache_create, round(sum(coalesce(cost, 0)), 10) cost, count(*) filter (not priced) unpriced_turns"""
_COSTS = (*rollups.COSTS, "cost")


@_query(f"select model, {_SUMS} from priced group by model")
def summary_by_model(spark, d):
    return _rounded(rollups.by_model(priced_turns(spark, d)), *_COSTS)


@_query(f"""select case when model like 'hf:%' then 'synthetic' when source = 'claude-code' then 'anthropic' when source = 'codex' then 'openai' else 'opencode' end provider, {_SUMS} from priced group by 1""")
def summary_by_provider(spark, d):
    return _rounded(rollups.by_provider(priced_turns(spark, d)), *_COSTS)


@_query("select tool_name, count(*) calls, round(sum(coalesce(cost, 0)), 10) cost from priced group by 1")
def summary_slim_by_tool(spark, d):
    return _rounded(rollups.slim_by_tool(priced_turns(spark, d)), "cost")


@_query("""select count(*) filter (stop_reason = 'end_turn') end_turn, count(*) filter (stop_reason = 'max_tokens') max_tokens, 0::bigint stop_sequence, count(*) filter (stop_reason = 'tool_use') tool_use, 0::bigint pause_turn,
  count(*) filter (stop_reason = 'refusal') refusal, count(*) filter (stop_reason = 'odd') silent, count(*) filter (stop_reason is null) "none" from turns""")
def stop_reason_counts(spark, d):
    return rollups.stop_reasons(turns(spark, d))


@_query("""select session_id, min(ts) first_seen, max(ts) last_seen, count(*) turns, round(sum(coalesce(cost, 0)), 10) cost,
  cast(sum(input_tokens + output_tokens + reasoning_tokens + cache_read + cache_create_5m + cache_create_1h) as bigint) tokens, string_agg(distinct model, ',' order by model) models from priced group by 1""")
def session_costs(spark, d):
    return _rounded(rollups.sessions(priced_turns(spark, d)), "cost")


@_query(""", s as (select session_id, max(ts) last_seen, count(*) turns, round(sum(coalesce(cost, 0)), 10) cost from priced group by 1), r as (select *, row_number() over (order by last_seen desc, session_id) "rank", count(*) over () > 20 truncated from s)
  select session_id, last_seen, turns, cost, "rank", truncated from r where "rank" <= 20""")
def sessions_list(spark, d):
    return _rounded(rollups.latest_sessions(priced_turns(spark, d)), "cost").select("session_id", "last_seen", "turns", "cost", "rank", "truncated")


@_query("select concat_ws(':', cast(count(*) as varchar), cast(epoch_ms(max(ts)) // 1000 as varchar), cast(sum(strlen(target)) as varchar)) fingerprint from turns")
def ledger_fingerprint(spark, d):
    return rollups.fingerprint(turns(spark, d), F.col("target"))


@_query("""select session_id, count(*) turns, cast(sum(input_tokens + output_tokens + case when source = 'codex' then 0 else reasoning_tokens end + cache_read + cache_create_5m + cache_create_1h) as bigint) tokens
  from priced where not priced group by 1""")
def unpriced_usage(spark, d):
    return rollups.unpriced_usage(priced_turns(spark, d))


@_query("""select distinct model, source from priced where not priced""")
def unpriced_models(spark, d):
    t = turns(spark, d).select("model", "source").distinct()
    return t.join(provider.resolve_models(t.select("model").distinct(), cost.default_rates(spark)), "model", "left_anti")


@_query(""", c as (select session_id, model, count(*) n, min(turn_index) a from turns group by 1, 2), r as (select *, row_number() over (partition by session_id order by n desc, a) k from c)
  select session_id, model, n turns from r where k = 1""")
def dominant_models(spark, d):
    return rollups.dominant_model(turns(spark, d))


@_query(""", s as (select activity, session_id, count(*) n, sum(coalesce(cost, 0)) c from priced group by 1, 2)
  select activity, count(*) invocations, cast(sum(n) as bigint) turns, round(sum(c), 10) total, round(quantile_disc(c, 0.5), 10) p50, round(quantile_disc(c, 0.95), 10) p95, round(avg(c), 10) mean from s group by 1""")
def subagent_statistics(spark, d):
    return _rounded(rollups.subagent_statistics(priced_turns(spark, d)), "total", "p50", "p95", "mean")


@_query("""select tool_name, count(*) calls, cast(sum(round((case when k % 2 = 0 then (1000 + 800) / 2.0 else 1000.0 end) * (k % 4))) as bigint) saved_tokens from turns group by 1""")
def replacement_savings(spark, d):
    replaced = F.when(F.col("k") % 2 == 0, F.array(F.lit("Read"), F.lit("Other"))).otherwise(F.array(F.lit("Read")))
    return rollups.replacement_savings(turns(spark, d).withColumn("replaced", replaced), F.col("replaced"), F.col("k") % 4, {"Read": 1000})


@_query("""select coalesce(case when event_id % 5 = 0 then concat('w', cast(k % 4 as varchar)) end, '(untagged)') tag, count(*) turns, round(sum(coalesce(cost, 0)), 10) cost from priced group by 1""")
def summary_by_tag(spark, d):
    tagged = F.when(F.col("event_id") % 5 == 0, F.create_map(F.lit("workflow"), F.concat(F.lit("w"), (F.col("k") % 4).cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    return _rounded(rollups.by_tag(priced_turns(spark, d).withColumn("enrichment", tagged), "workflow"), "cost").select("tag", "turns", "cost")


_STAMPS = [("s1", None, None, None, 1, 1, {"team": "a", "run": "1"}), ("s1", None, None, "2024-01-15 00:00:00", 3, 1, {"run": "2"}), (None, "m7", None, None, 2, 1, {"team": "x"}), (None, None, "2024-01-10 00:00:00", "2024-01-11 00:00:00", 0, 1, {"team": "night", "day": "10"})]


@_query(""", stamps(sid, mid, a, b, o, team, run, "day") as (values ('s1', null, null, null, 1, 'a', '1', null), ('s1', null, null, timestamp '2024-01-15', 3, null, '2', null), (null, 'm7', null, null, 2, 'x', null, null), (null, null, timestamp '2024-01-10', timestamp '2024-01-11', 0, 'night', null, '10'))
  select t.session_id, t.message_id, max_by(team, o) filter (team is not null) team, max_by(run, o) filter (run is not null) run, max_by("day", o) filter ("day" is not null) "day" from turns t join stamps s
  on (sid is null or sid = session_id) and (mid is null or mid = message_id) and (a is null or ts >= a) and (b is null or ts <= b) group by 1, 2""")
def stamp_fold(spark, d):
    stamps = spark.createDataFrame([(s, m, a, b, o, w, t) for s, m, a, b, o, w, t in _STAMPS], "session_id string, message_id string, a string, b string, ts int, written_at int, tags map<string,string>")
    stamps = stamps.select("session_id", "message_id", F.to_timestamp("a").alias("from_ts"), F.to_timestamp("b").alias("to_ts"), "ts", "written_at", "tags")
    out = joins.fold_stamps(turns(spark, d), stamps).where(F.size("enrichment") > 0)
    return out.select("session_id", "message_id", *[F.try_element_at("enrichment", F.lit(k)).alias(k) for k in ("team", "run", "day")])


_EVENTS_SQL = """, ev as (select event_id, session_id, case when event_id % 3 = 0 then message_id else concat('x', cast(event_id as varchar)) end message_id, case when event_id % 11 = 0 then null else ts + to_microseconds(cast(1000000 * (k - 50) * 3600 as bigint)) end ts from turns)"""


@_query(_EVENTS_SQL + """, ex as (select ev.event_id, t.message_id own from ev left join turns t using (session_id, message_id)),
  ao as (select ev.event_id, (select t.message_id from turns t where t.session_id = ev.session_id and t.ts <= ev.ts order by t.ts desc, t.message_id desc limit 1) a, (select t.message_id from turns t where t.session_id = ev.session_id order by t.ts, t.message_id limit 1) f, ev.ts from ev)
  select ex.event_id, coalesce(own, case when ts is null then null else coalesce(a, f) end) turn_id from ex join ao using (event_id)""")
def event_to_turn(spark, d):
    t = turns(spark, d)
    shifted = F.timestamp_micros(F.unix_micros("ts") + 1000000 * (F.col("k") - 50) * 3600)
    ev = t.select("event_id", "session_id", F.when(F.col("event_id") % 3 == 0, F.col("message_id")).otherwise(F.concat(F.lit("x"), F.col("event_id").cast("string"))).alias("message_id"), F.when(F.col("event_id") % 11 != 0, shifted).alias("ts"))
    return joins.events_to_turns(ev, t).select("event_id", "turn_id")


@_query(""", c as (select session_id, event_id compaction_id, ts, lag(ts) over (partition by session_id order by ts, event_id) previous, cache_read lost_tokens, cache_read / 1e6 * r_read lost_cost from priced where turn_index % 10 = 9)
  select c.session_id, c.compaction_id, any_value(c.lost_tokens) lost_tokens, round(any_value(c.lost_cost), 9) lost_cost, count(t.message_id) turns, count(*) filter (t.tool_name = 'Edit') edits, count(*) filter (t.tool_name = 'Bash') bashes
  from c left join turns t on t.session_id = c.session_id and t.ts <= c.ts and (c.previous is null or t.ts > c.previous) group by 1, 2""")
def compaction_losses(spark, d):
    t = priced_turns(spark, d)
    c = t.where("turn_index % 10 = 9").select("session_id", F.col("event_id").alias("compaction_id"), "ts", F.col("message_id").alias("preceding"))
    return _rounded(joins.compaction_losses(c, t), "lost_cost", digits=9)


_REL_SQL = """, rt as (select session_id, message_id, case when event_id % 4 = 1 then concat('a', cast(k % 3 as varchar)) end agent_id, event_id % 4 in (1, 2) sidechain, cost from priced),
  ed as (select distinct concat(session_id, '-', kind) edge_id, kind, session_id, case when kind = 'subagent' then 'a1' end agent_id from turns, (values ('root'), ('subagent'), ('fork')) x(kind) where turn_index = 0),
  ma as (select edge_id, kind, message_id, cost, case when kind = 'root' then case when not sidechain then 1 end when kind = 'fork' then 1 when ed.agent_id = rt.agent_id then 1 when sidechain then 2 end rk from ed join rt on ed.session_id = rt.session_id),
  be as (select *, min(rk) over (partition by edge_id) m from ma where rk is not null), ea as (select kind, edge_id, count(*) n, sum(coalesce(cost, 0)) c from be where rk = m group by 1, 2)
  select kind, count(*) edges, cast(sum(n) as bigint) turns, round(sum(c), 10) cost from ea group by 1"""


@_query(_REL_SQL)
def relationship_statistics(spark, d):
    t = priced_turns(spark, d).withColumn("agent_id", F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("a"), (F.col("k") % 3).cast("string")))).withColumn("sidechain", (F.col("event_id") % 4).isin(1, 2))
    e = t.where("turn_index = 0").select("session_id", F.explode(F.array(*map(F.lit, ("root", "subagent", "fork")))).alias("kind"))
    e = e.select(F.concat_ws("-", "session_id", "kind").alias("edge_id"), "kind", "session_id", F.when(F.col("kind") == "subagent", "a1").alias("agent_id"))
    return _rounded(joins.relationship_statistics(e, t), "cost")


_FILES_SQL = ", f as (select concat('m', cast(event_id as varchar)) uuid, concat('m', cast(event_id // 3 as varchar)) parent, concat('f', cast(user_id % 40 as varchar)) file, case when event_id % 50 = 0 then concat('g', cast(event_id % 7 as varchar)) else concat('f', cast(user_id % 40 as varchar)) end session_id from events)"


@_query(_FILES_SQL + """, c as (select distinct a.file, b.file other, 'continuation' kind from f a join f b on a.parent = b.uuid where a.file != b.file), s as (select session_id from f where session_id != file group by 1 having count(distinct file) >= 2)
  select * from c union all select distinct f.file, f.session_id other, 'fork' kind from f join s using (session_id) where f.session_id != f.file and f.file not in (select file from c)""")
def cross_file_reconciliation(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    file = F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string"))
    name = lambda n: F.concat(F.lit("m"), n.cast("string"))
    rows = e.select(name(F.col("event_id")).alias("uuid"), name(F.expr("event_id div 3")).alias("parent"), file.alias("file"), F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("g"), (F.col("event_id") % 7).cast("string"))).otherwise(file).alias("session_id"))
    return joins.foreign_sessions(rows)


@_query(""", st as (select *, row_number() over (partition by session_id order by turn_index) > 30 late from turns) select count(*) filter (late) appended, count(distinct message_id) filter (late) keys from st""")
def append_new_turns(spark, d):
    """Every turn, twice, against a store of each session's first thirty."""
    t, keys = turns(spark, d), ["source", "session_id", "message_id"]
    return joins.new_rows(t.union(t), t.where("turn_index < 30"), keys).agg(F.count("*").alias("appended"), F.countDistinct("message_id").alias("keys"))


@_query(""", u as (select message_id, 0 v from turns union all select message_id, 1 from turns where turn_index >= 20), r as (select *, row_number() over (partition by message_id order by v desc) rk from u) select v, count(*) n from r where rk = 1 group by 1""")
def turn_upsert(spark, d):
    """Every turn, and newer versions of those from the twentieth of a session on."""
    t = turns(spark, d)
    both = joins.upsert(t.withColumn("v", F.lit(0)), t.where("turn_index >= 20").withColumn("v", F.lit(1)), ["message_id"], "v")
    return both.groupBy("v").agg(F.count("*").alias("n"))


@_query(""", l as (select *, lag(tool_name) over (partition by session_id order by turn_index) p from priced) select coalesce(p, '(unattributed)') tool_name, count(*) turns, round(sum(coalesce(cost, 0)), 10) cost from l group by 1""")
def by_tool_attribution(spark, d):
    return _rounded(attribution.by_tool(priced_turns(spark, d)), "cost")


@_query(""", ev as (select *, k % 13 tool_use_id, event_id event_index, case when k % 7 = 0 then 'running' else 'completed' end status from turns), r as (select *, row_number() over (partition by session_id, tool_use_id order by event_index desc, ts desc, event_id desc) rk from ev)
  select session_id, tool_use_id, message_id from r where rk = 1 and status != 'running'""")
def terminal_events(spark, d):
    t = turns(spark, d).withColumns({"tool_use_id": F.col("k") % 13, "event_index": F.col("event_id"), "status": F.when(F.col("k") % 7 == 0, "running").otherwise("completed")})
    return sequences.terminal_events(t).select("session_id", "tool_use_id", "message_id")


@_query(""", c as (select *, input_tokens + cache_read + cache_create_5m + cache_create_1h context from turns), g as (select *, context - lag(context) over (partition by session_id order by turn_index) delta from c)
  select session_id, message_id, turn_index, context, delta from g where delta is not null order by delta desc, session_id, turn_index limit 20""")
def context_deltas(spark, d):
    return sequences.context_deltas(turns(spark, d))


@_query("""select session_id, message_id, greatest(input_tokens - coalesce(lag(input_tokens) over (partition by session_id order by turn_index), 0), 0) used from turns""")
def cumulative_to_turn_usage(spark, d):
    return sequences.per_turn_usage(turns(spark, d), "input_tokens").select("session_id", "message_id", "used")


_EDGES = "select distinct user_id node, case when user_id > 0 then user_id // 2 end parent from events"


@_query(f"""with recursive ed as ({_EDGES}), nd as (select node from ed union select parent from ed where parent is not null), cl(node, ancestor, distance) as (select node, node, 0 from nd union all select c.node, ed.parent, c.distance + 1 from cl c join ed on ed.node = c.ancestor where ed.parent is not null and ed.parent != ed.node),
  co as (select user_id node, sum(round(value * 100)) / 100 cost from events group by 1), be as (select ancestor node, round(sum(coalesce(cost, 0)), 2) cumulative, count(*) nodes from cl left join co on co.node = cl.node group by 1), de as (select node, max(distance) depth from cl group by 1)
  select be.node, round(coalesce(cost, 0), 2) own, cumulative, depth, nodes from be left join co using (node) join de using (node)""")
def subagent_forest(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    edges = e.select(F.col("user_id").alias("node"), F.when(F.col("user_id") > 0, F.expr("user_id div 2")).alias("parent")).distinct()
    costs = e.groupBy(F.col("user_id").alias("node")).agg((F.sum(F.round(F.col("value") * 100)) / 100).alias("cost"))
    return _rounded(trees.forest_costs(edges, costs), "own", "cumulative", digits=2)


@_query("""with recursive ed as (select distinct concat('u', cast(user_id as varchar)) a, concat('k', cast(user_id % 37 as varchar)) b from events), bo as (select a, b from ed union select b, a from ed), re(node) as (select 'u1' union select bo.b from re join bo on bo.a = re.node) select node from re""")
def connected_sessions(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return trees.connected(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("a"), F.concat(F.lit("k"), (F.col("user_id") % 37).cast("string")).alias("b")).distinct(), "u1")


@_query(f"with recursive ed as ({_EDGES}), re(node, depth) as (select 1::bigint, 0 union all select ed.node, depth + 1 from re join ed on ed.parent = re.node where ed.node != ed.parent) select node, depth from re")
def agent_session_tree(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    edges = e.select(F.col("user_id").alias("node"), F.when(F.col("user_id") > 0, F.expr("user_id div 2")).alias("parent")).distinct()
    return trees.descendants(edges.select(F.col("node").cast("string").alias("node"), F.col("parent").cast("string").alias("parent")), "1").select(F.col("node").cast("long").alias("node"), "depth")


@_query("""select session_id, case when k % 3 = 0 then concat('r', cast(k as varchar)) else message_id end inference_id, min(ts) started, max(ts) ended, cast(sum(input_tokens) as bigint) input_tokens, cast(sum(output_tokens) as bigint) output_tokens, count(distinct tool_name) tools, max_by(activity, event_id) kind from turns group by 1, 2""")
def inference_rollup(spark, d):
    rows = turns(spark, d).withColumns({"request_id": F.when(F.col("k") % 3 == 0, F.concat(F.lit("r"), F.col("k").cast("string"))), "row_id": F.col("event_id"), "kind": F.col("activity")})
    return trees.inferences(rows)


@_query(""", s as (select session_id, 'turn' kind, case when stop_reason = 'refusal' then 'error' when stop_reason = 'max_tokens' then 'truncated' when is_error = 1 then 'error' else 'ok' end status, cost from priced
  union all select session_id, x, case when is_error = 1 then 'error' else 'ok' end, 0.0 from priced, (values ('inference'), ('tool_use')) v(x)) select session_id, kind, status, count(*) spans, round(sum(coalesce(cost, 0)), 10) cost from s group by 1, 2, 3""")
def span_tree_rollup(spark, d):
    s = trees.spans(priced_turns(spark, d)).groupBy("session_id", "kind", "status").agg(F.count("*").alias("spans"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"))
    return _rounded(s, "cost")


@_query("""select concat(message_id, ':', cast(r as varchar)) node, case when r = 0 then 'inference' else tool_name end label, turn_index * 96 x, r * 32 y from turns, (values (0), (1)) v(r)""")
def flow_graph_nodes(spark, d):
    return trees.flow_graph(turns(spark, d))[0].select("node", "label", "x", "y")


_SPINE = ", b as (select min(ts) a, max(ts) z from turns), sp as (select cast(i as bigint) bucket, a + to_microseconds(cast(i as bigint) * 21600000000) from_ts from b, range(0, cast((epoch_us(z) - epoch_us(a)) // 21600000000 + 1 as bigint)) r(i)), pt as (select p.*, cast((epoch_us(ts) - epoch_us(a)) // 21600000000 as bigint) bucket from priced p, b)"


@_query(_SPINE + ", g as (select bucket, model, count(*) n, sum(coalesce(cost, 0)) c from pt group by 1, 2) select sp.bucket, from_ts, model, coalesce(n, 0) turns, round(coalesce(c, 0), 10) cost from sp left join g using (bucket)")
def summary_timeseries(spark, d):
    return _rounded(series.summary_series(priced_turns(spark, d), 6 * 3600), "cost")


@_query(_SPINE + " select bucket, model, activity, count(*) turns, round(sum(coalesce(cost, 0)), 10) cost from pt group by 1, 2, 3")
def compare_timeseries(spark, d):
    return _rounded(series.compare_series(priced_turns(spark, d), 6 * 3600), "cost")


@_query(""", ms(model) as (values ('claude-sonnet-4-6'), ('gpt-5.5'), ('absent-model')), ac as (select distinct activity from turns), ce as (select model, activity, count(*) n, sum(coalesce(cost, 0)) / nullif(count(*) filter (priced), 0) c, sum(cache_read) / nullif(sum(cache_read) + sum(input_tokens) + sum(cache_create_5m + cache_create_1h), 0) h, median(output_tokens) m from priced group by 1, 2)
  select ms.model, ac.activity, coalesce(n, 0) turns, round(c, 10) cost_per_turn, round(h, 4) cache_hit, cast(m as double) median_output, coalesce(n, 0) = 0 no_data, coalesce(n, 0) between 1 and 4 insufficient from ms cross join ac left join ce on ce.model = ms.model and ce.activity = ac.activity""")
def compare_models(spark, d):
    out = series.compare(priced_turns(spark, d), ["claude-sonnet-4-6", "gpt-5.5", "absent-model"])
    return _rounded(_rounded(out, "cost_per_turn"), "cache_hit", digits=4)


_INSTRUCTIONS = [("CLAUDE.md", 500), ("AGENTS.md", 2500)]
_SECTIONS = [("CLAUDE.md", "intro", 0, 200), ("CLAUDE.md", "style", 2, 600), ("CLAUDE.md", "tests", 2, 1200), ("AGENTS.md", "rules", 1, 10000)]
_OVER_SQL = ", fi(file, tokens) as (values ('CLAUDE.md', 500), ('AGENTS.md', 2500)), oc as (select file, session_id, count(*) riding_turns, sum(tokens / 1e6 * coalesce(r_read, 0)) c from priced join fi on cache_read >= tokens group by 1, 2)"


@_query(_OVER_SQL + " select file, session_id, riding_turns, round(c, 10) cost from oc")
def overhead_by_file(spark, d):
    return _rounded(series.overhead(priced_turns(spark, d), spark.createDataFrame(_INSTRUCTIONS, "file string, tokens long")), "cost")


@_query(_OVER_SQL + """, se(file, section, bytes) as (values ('CLAUDE.md', 'intro', 200), ('CLAUDE.md', 'style', 600), ('CLAUDE.md', 'tests', 1200), ('AGENTS.md', 'rules', 10000)), sh as (select *, bytes / sum(bytes) over (partition by file) s from se), ow as (select file, section, c * s o from oc join sh using (file))
  select file, section, round(sum(o), 10) cost, round(avg(o), 10) average, round(quantile_disc(o, 0.95), 10) p95 from ow group by 1, 2""")
def overhead_by_section(spark, d):
    costs = series.overhead(priced_turns(spark, d), spark.createDataFrame(_INSTRUCTIONS, "file string, tokens long"))
    sections = spark.createDataFrame(_SECTIONS, "file string, section string, level int, bytes long")
    return _rounded(series.overhead_by_section(costs, sections), "cost", "average", "p95")


@_query(""", s as (select session_id, message_id, substr(sha256(concat_ws('|', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), model, cast(input_tokens + output_tokens as varchar), cast(cache_read as varchar), cast(cache_create_5m + cache_create_1h as varchar), target)), 1, 16) fp from turns) select count(*) turns, count(distinct fp) distinct_turns, min(fp) least from s""")
def turn_fingerprints(spark, d):
    fp = turns(spark, d).withColumn("fp", text.turn_fingerprint())
    return fp.agg(F.count("*").alias("turns"), F.countDistinct("fp").alias("distinct_turns"), F.min("fp").alias("least"))


@_query("""select conv_id, turn, cast(length(text) as bigint) chars, cast(strlen(text) as bigint) bytes, substr(sha256(text), 1, 16) hash, regexp_matches(lower(text), '<system-truncated>|\\[truncated\\]|output truncated|result truncated|response truncated|truncated to ') truncated, cast(ceil(strlen(text) / 4) as bigint) tokens, left(trim(split_part(trim(text, chr(10)), chr(10), 1)), 240) signature from conversations where text is not null""")
def payload_measures(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").where("text is not null").withColumn("m", text.payload_measure(F.col("text")))
    return c.select("conv_id", "turn", "m.*", text.approximate_tokens(F.octet_length("text")).alias("tokens"), text.error_signature(F.col("text")).alias("signature"))


@_query("""select event_id % 17 shard, cast(sum(((k * 10 + 3) // (k % 4 + 1)) + case when event_id % (k % 4 + 1) = 0 then (k * 10 + 3) % (k % 4 + 1) else 0 end) as bigint) tokens from turns group by 1""")
def even_split(spark, d):
    t = turns(spark, d)
    share = cost.even_split(F.col("k") * 10 + 3, F.col("k") % 4 + 1, F.col("event_id") % (F.col("k") % 4 + 1))
    return t.groupBy((F.col("event_id") % 17).alias("shard")).agg(F.sum(share).alias("tokens"))


@_query("""select case when event_id % 5 = 0 then 'cost-only' when event_id % 7 = 0 then 'aggregate-only' when k % 2 = 0 and k % 3 = 0 then 'full' when k % 2 = 0 then 'usage-only' else 'partial' end class, count(*) turns, count(*) filter (not priced) unpriced from priced group by 1""")
def fidelity_classes(spark, d):
    t = priced_turns(spark, d)
    granularity = F.when(F.col("event_id") % 5 == 0, "cost-only").when(F.col("event_id") % 7 == 0, "per-session-aggregate").otherwise("per-turn")
    even, third = F.col("k") % 2 == 0, F.col("k") % 3 == 0
    flags = {"input": even, "output": even, "cache_read": third, "tool_calls": third, "tool_results": third, "relationships": third}
    return t.groupBy(cost.fidelity_class(granularity, flags).alias("class")).agg(F.count("*").alias("turns"), F.count_if(~F.col("priced")).alias("unpriced"))


@_query("""select c_mktsegment, count(*) n, quantile_disc(c_acctbal, 0.5) p50, quantile_disc(c_acctbal, 0.95) p95 from customer group by 1""")
def nearest_rank_percentiles(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("n"), rollups.nearest_rank("c_acctbal", 0.5).alias("p50"), rollups.nearest_rank("c_acctbal", 0.95).alias("p95"))


@_query("""select 'events' name, count(*) n from events union all select 'conversations', count(*) from conversations union all select 'lineitem', count(*) from lineitem""")
def table_counts(spark, d):
    parts = [spark.read.parquet(f"{d}/{t}.parquet").agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("events", "conversations", "lineitem")]
    return parts[0].union(parts[1]).union(parts[2])


@_query(""", q as (select conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x != '') w from conversations), n as (select count(*) n, avg(len(w)) m from q), h as (select conv_id, turn, len(w) l, len(list_filter(w, lambda x: x = 'the')) tf from q), df as (select count(*) d from h where tf > 0)
  select conv_id, turn, round(ln(1 + (n - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m)), 10) score from h, n, df where tf > 0 order by score desc, conv_id * 1000 + turn limit 25""")
def search_content(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn"))
    found = search.search(*search.build_index(c), "the")
    return _rounded(found.select(F.expr("doc_id div 1000").alias("conv_id"), F.pmod("doc_id", F.lit(1000)).alias("turn"), "score"), "score")


@_query("""select concat(message_id, ':0') source, concat(message_id, ':1') target from turns""")
def flow_graph_edges(spark, d):
    return trees.flow_graph(turns(spark, d))[1].select("source", "target")


@_query(""", c as (select session_id, ts + to_microseconds(cast(1000000 as bigint)) ts from turns where turn_index % 10 = 4), l as (select session_id, message_id, ts, lag(ts) over (partition by session_id order by turn_index) p from turns)
  select session_id, message_id from l where p is not null and exists (select 1 from c where c.session_id = l.session_id and c.ts between p and l.ts)""")
def turns_after_compaction(spark, d):
    t = turns(spark, d)
    c = t.where("turn_index % 10 = 4").select("session_id", F.timestamp_micros(F.unix_micros("ts") + 1000000).alias("ts"))
    return sidecars.compacted_between(t, c).select("session_id", "message_id")


@_query(""", r as (select session_id, case when event_id % 4 = 0 then concat('a', cast(k as varchar)) else session_id end agent_id, event_id % 2 = 0 sidechain from turns) select count(*) filter (not sidechain or agent_id = session_id) main, count(*) filter (not (not sidechain or agent_id = session_id)) subagent from r""")
def rails(spark, d):
    t = turns(spark, d).withColumn("agent_id", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("a"), F.col("k").cast("string"))).otherwise(F.col("session_id"))).withColumn("sidechain", F.col("event_id") % 2 == 0)
    n = lambda which: filters.rail(t, which).agg(F.count("*").alias(which))
    return n("main").crossJoin(n("subagent"))  # one row each


@_query(""", f as (select source, case event_id % 4 when 0 then 'cost-only' when 1 then 'partial' when 2 then 'full' end fidelity from turns) select source, count(*) turns, string_agg(distinct fidelity, ',' order by fidelity) classes from f where fidelity in ('cost-only', 'partial') group by 1""")
def excluded_turns(spark, d):
    m = F.col("event_id") % 4
    t = turns(spark, d).withColumn("fidelity", F.when(m == 0, "cost-only").when(m == 1, "partial").when(m == 2, "full"))
    return filters.excluded(t, "usage-only")


@_query("""select m.model, count(t.model) turns from (values ('gpt-5.5'), ('absent-model')) m(model) left join turns t using (model) group by 1""")
def requested_models(spark, d):
    return filters.models(turns(spark, d), ["gpt-5.5", "absent-model"])


@_query(""", c as (select user_id % 7 project, case event_id % 3 when 0 then concat('git@GitHub.com:org/p', cast(user_id % 7 as varchar), '.git') when 1 then concat('https://github.com/org/p', cast(user_id % 7 as varchar)) else concat('ssh://git@github.com/org/p', cast(user_id % 7 as varchar), '.git/') end url from events)
  select concat('github.com/org/p', cast(project as varchar)) project_key, count(*) n from c group by 1""")
def project_keys(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    name = F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string"))
    m = F.col("event_id") % 3
    url = F.when(m == 0, F.concat(F.lit("git@GitHub.com:org/"), name, F.lit(".git"))).when(m == 1, F.concat(F.lit("https://github.com/org/"), name)).otherwise(F.concat(F.lit("ssh://git@github.com/org/"), name, F.lit(".git/")))
    return e.groupBy(text.git_project_key(url).alias("project_key")).agg(F.count("*").alias("n"))


@_query("""select count(*) filter (conv_id % 3 != 0) "rows", cast(coalesce(sum(strlen(text)) filter (conv_id % 3 != 0), 0) as bigint) bytes from conversations""")
def content_prune(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").withColumn("created_at", F.when(F.col("conv_id") % 3 == 0, F.lit("2024-06-01")).otherwise("2023-01-01").cast("timestamp"))
    return files.prune(c, datetime(2024, 1, 1))[1]


from ledgerloom.plans import calls, logs  # noqa: E402, F401  register the queries over tool calls and over logs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

