"""Queries over tool calls, by name, with the DuckDB SQL that states the same result."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ledgerloom.functions import activity, text
from ledgerloom.functions.cost import rate
from ledgerloom.operators import agents, attribution, filters, findings, growth, patterns, quality, sequences, spans
from ledgerloom.plans.projection import CALLS_SQL, TURNS_SQL, calls, turns
from ledgerloom.plans.registry import ORACLES, QUERIES, _rounded, priced_turns

_NOW, _NOW_SQL = datetime(2024, 1, 20, tzinfo=timezone.utc), "timestamp '2024-01-20'"


def _query(sql: str, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"with {'recursive ' if recursive else ''}{TURNS_SQL}, {CALLS_SQL}{sql}"
        return f

    return add


def _both(spark, d):
    t = priced_turns(spark, d)
    return t, calls(t)


_HOT = """, w0 as (select *, row_number() over (partition by session_id order by turn_index) rk, cache_create_5m + cache_create_1h created from priced),
  w1 as (select *, lead(priced) over w pays, lead(input_tokens) over w n_in, lead(created) over w n_cr, lead(r_in) over w p_in, lead(r_write) over w p_wr from w0 window w as (partition by session_id order by turn_index)),
  h0 as (select cl.session_id, cl.message_id, cl.turn_index, tool_use_id, tool_name, target, args_hash, coalesce(size, 0) size, max(size is not null) over (partition by cl.session_id) sized, sum(coalesce(size, 0)) over (partition by cl.session_id, cl.turn_index) sib, count(*) over (partition by cl.session_id, cl.turn_index) kk, pays, n_in, n_cr, n_in + n_cr fresh, p_in, p_wr, w1.rk
    from cl join (select session_id, turn_index, rk, pays, n_in, n_cr, p_in, p_wr from w1) w1 using (session_id, turn_index)),
  h1 as (select *, coalesce(case when pays and fresh > 0 then case when sized then case when sib > 0 then size::double / sib * least(sib, fresh) end else fresh::double / kk end end, 0) it from h0),
  ri as (select h.tool_use_id, h.size, t.cache_read cr, t.r_read rr, sum(h.size) over (partition by t.session_id, t.rk) act from h1 h join w0 t on h.session_id = t.session_id and t.rk > h.rk + 1 and h.sized and h.size > 0 and t.priced and t.cache_read >= h.size),
  rd as (select tool_use_id, sum(size / act * least(cr, act)) tk, sum(size / act * least(cr, act) / 1e6 * rr) co, count(*) n from ri group by 1),
  hs as (select h.*, it initial_tokens, coalesce(it / 1e6 * (n_in / fresh * p_in + (1 - n_in / fresh) * p_wr), 0) initial_cost, coalesce(tk, 0) riding_tokens, coalesce(co, 0) riding_cost, coalesce(n, 0) riding_turns, coalesce(it / 1e6 * (n_in / fresh * p_in + (1 - n_in / fresh) * p_wr), 0) + coalesce(co, 0) total_cost from h1 h left join rd using (tool_use_id))"""
_HOT_SUMS = "count(*) calls, round(sum(initial_tokens), 4) initial_tokens, round(sum(initial_cost), 9) initial_cost, round(sum(riding_tokens), 4) riding_tokens, round(sum(riding_cost), 9) riding_cost, round(sum(total_cost), 9) total_cost"


def _told(df):
    df = _rounded(_rounded(df, "initial_tokens", "riding_tokens", digits=4), "initial_cost", "riding_cost", "total_cost", digits=9)
    return _rounded(df, "average_ride", digits=9) if "average_ride" in df.columns else df


def _spots(spark, d):
    t, c = _both(spark, d)
    return attribution.hotspots(c.select("session_id", "turn_index", "tool_use_id", "tool_name", "target", "args_hash", "size"), t)


@_query(_HOT + f" select target, {_HOT_SUMS}, round(avg(riding_turns), 9) average_ride, min(struct_pack(s := session_id, t := turn_index)).s first_session, min(struct_pack(s := session_id, t := turn_index)).t first_turn from hs where tool_name in ('Read', 'Edit') group by 1")
def hotspots_by_file(spark, d):
    return _told(attribution.by_file(_spots(spark, d)))


@_query(_HOT + f" select args_hash, {_HOT_SUMS}, round(avg(riding_turns), 9) average_ride, min(target) command from hs where tool_name = 'Bash' group by 1")
def hotspots_by_command(spark, d):
    return _told(attribution.by_command(_spots(spark, d)))


@_query(_HOT + f""", hv as (select cv.verb, hs.* from hs join (select tool_use_id, verb from cv) cv using (tool_use_id)), ex as (select verb, target, sum(total_cost) c from hv group by 1, 2), rr as (select *, row_number() over (partition by verb order by round(c, 9) desc, target) r from ex)
  select verb, {_HOT_SUMS}, round(avg(riding_turns), 9) average_ride, any_value(n) distinct_commands, any_value(e) examples from hv join (select verb, count(*) n, string_agg(target, ',' order by r) filter (r <= 3) e from rr group by 1) using (verb) group by 1""")
def hotspots_by_verb(spark, d):
    return _told(attribution.by_verb(_spots(spark, d)))


@_query(_HOT + f" select coalesce(target, '(unknown)') subagent_type, {_HOT_SUMS}, round(avg(riding_turns), 9) average_ride from hs where tool_name = 'Task' group by 1")
def hotspots_by_subagent(spark, d):
    return _told(attribution.by_subagent(_spots(spark, d)))


@_query(_HOT + """, s as (select concat('srv', cast(turn_index % 3 as varchar)) server, tool_name tool, total_cost from hs), i as (select server, tool, count(*) n, sum(total_cost) c from s group by 1, 2), r as (select *, row_number() over (partition by server order by round(c, 9) desc, tool) k from i)
  select server, cast(sum(n) as bigint) calls, round(sum(c), 9) total_cost, string_agg(tool, ',' order by k) filter (k <= 3) tools from r group by 1""")
def mcp_servers(spark, d):
    named = _spots(spark, d).withColumn("tool_name", F.concat(F.lit("mcp__srv"), F.pmod("turn_index", F.lit(3)).cast("string"), F.lit("__"), F.col("tool_name")))
    return _rounded(attribution.by_server(named), "total_cost", digits=9)


@_query(_HOT + """, g as (select session_id, sum(coalesce(cost, 0)) g from priced group by 1), o as (select session_id, sum(total_cost) a, any_value(sized) sized from hs group by 1) select session_id, round(g, 9) grand, round(coalesce(a, 0), 9) attributed, round(g - coalesce(a, 0), 9) unattributed from g left join o using (session_id)""")
def hotspots_by_session(spark, d):
    t = priced_turns(spark, d)
    return _rounded(attribution.session_totals(_spots(spark, d), t), "grand", "attributed", "unattributed", digits=9)


@_query(_HOT + " select case when sized then 'sized' else 'even-split' end \"method\", tool_name, count(*) calls, round(sum(total_cost), 9) total_cost from hs group by 1, 2")
def hotspots_methods(spark, d):
    return _rounded(_spots(spark, d).groupBy("method", "tool_name").agg(F.count("*").alias("calls"), F.sum("total_cost").alias("total_cost")), "total_cost", digits=9)


def _runs(keys: str, where: str, having: str, table: str = "cl") -> str:
    changed = " or ".join(f"{k} is distinct from lag({k}) over w" for k in keys.split(", "))
    return f""", m as (select *, case when row_number() over w = 1 or {changed} then 1 else 0 end nw from {table} window w as (partition by session_id order by turn_index, call_index)), i as (select *, sum(nw) over (partition by session_id order by turn_index, call_index) isl from m),
  tu as (select session_id, isl, turn_index, count(*) n, any_value(cost) cost, list(distinct args_hash) a, min(tool_name) tool_name from i where {where} group by 1, 2, 3)
  select session_id, cast(sum(n) as bigint) length, min(turn_index) first_turn, max(turn_index) last_turn, cast(len(list_distinct(flatten(list(a)))) as bigint) distinct_calls, min(tool_name) tool_name, round(sum(coalesce(cost, 0)), 10) cost from tu group by session_id, isl having {having}"""


@_query(_runs("is_error, args_hash", "is_error = 1", "sum(n) >= 3"))
def retry_loops(spark, d):
    return _rounded(patterns.retry_loops(_both(spark, d)[1]), "cost")


@_query(_runs("is_error", "is_error = 1", "sum(n) >= 3 and len(list_distinct(flatten(list(a)))) >= 2"))
def failure_runs(spark, d):
    return _rounded(patterns.failure_runs(_both(spark, d)[1]), "cost")


@_query(", ca as (select *, case when k % 5 = 0 then 'cancelled' else 'completed' end status from cl)" + _runs("status", "status = 'cancelled'", "sum(n) >= 1", "ca"))
def cancellation_runs(spark, d):
    c = _both(spark, d)[1].withColumn("status", F.when(F.col("k") % 5 == 0, "cancelled").otherwise("completed"))
    return _rounded(patterns.cancellation_runs(c), "cost")


_RATE = ", mo as (select session_id, model, count(*) n, min(turn_index) a, any_value(r_in) r from priced group by 1, 2), sr as (select session_id, coalesce(arg_max_null(r, n * 100000 - a), 0) / 1e6 p from mo group by 1)"
_SEARCH = ", se as (select session_id, 'search-sequence' category, count(*) occurrences, count(*) * 2500 tokens, '' evidence from (select session_id, turn_index from cl group by 1, 2 having string_agg(tool_name, ',' order by call_index) like '%Glob%Grep%Read%') group by 1 having count(*) >= 3)"
_CLUSTER = ", ec as (select session_id, 'edit-cluster' category, max(n) occurrences, (max(n) - 1) * 400 tokens, target evidence from (select session_id, target, count(*) over (partition by session_id, target order by turn_index range between current row and 4 following) n from cl where tool_name = 'Edit') group by session_id, target having max(n) >= 3)"
_BASH = ", bp as (select session_id, category, count(*) occurrences, count(*) * case category when 'bash-git-state' then 800 when 'bash-test-run' then 1200 else 600 end tokens, string_agg(distinct verb, ',' order by verb) evidence from (select *, case when verb in ('git status', 'git diff') then 'bash-git-state' when verb = 'pytest' then 'bash-test-run' when verb = 'gh pr' then 'bash-gh-pr' end category from cv) where category is not null group by 1, 2)"
_PATTERNS = _RATE + _SEARCH + _CLUSTER + _BASH + ", tp as (select * from se union all select * from ec union all select * from bp), tq as (select tp.*, tokens * p usd from tp join sr using (session_id))"


@_query(_PATTERNS + " select session_id, category, occurrences, tokens, evidence, round(usd, 9) usd from tq")
def tool_call_patterns(spark, d):
    t, c = _both(spark, d)
    return _rounded(patterns.tool_call_patterns(c, t), "usd", digits=9)


@_query(_PATTERNS + " select session_id, occurrences, tokens from tq where category = 'search-sequence'")
def search_sequences(spark, d):
    t, c = _both(spark, d)
    return patterns.search_sequences(c, t).select("session_id", "occurrences", "tokens")


@_query(_PATTERNS + " select session_id, evidence target, occurrences edits from tq where category = 'edit-cluster'")
def edit_clusters(spark, d):
    t, c = _both(spark, d)
    return patterns.edit_clusters(c, t).select("session_id", F.col("evidence").alias("target"), F.col("occurrences").alias("edits"))


_HEAVY = ", eh as (select session_id, cast(sum(e) as bigint) edits, cast(sum(r) as bigint) reads, sum(case when e > 0 then coalesce(cost, 0) else 0 end) cost from (select session_id, turn_index, count(*) filter (tool_name = 'Edit') e, count(*) filter (tool_name = 'Read' {0}) r, any_value(cost) cost from cl group by 1, 2) group by 1 having sum(e) >= 5 and sum(e) > 4 * sum(r))"


@_query(_HEAVY.format("and k % 3 = 1") + " select session_id, edits, reads, round(cost, 10) cost from eh")
def edit_heavy(spark, d):
    """With two of three reads left out of the calls, so that some sessions are over the ratio."""
    c = _both(spark, d)[1].withColumn("tool_name", F.when((F.col("tool_name") == "Read") & (F.col("k") % 3 != 1), "Other").otherwise(F.col("tool_name")))
    return _rounded(patterns.edit_heavy(c), "cost")


_OPEN = ", oc as (select session_id from priced group by 1 having arg_min(source, turn_index) = 'opencode')"
_RECALL = ", rc as (select session_id, target skill_name, cast(sum(n) as bigint) calls, min(turn_index) first_turn, max(turn_index) last_turn, sum(coalesce(cost, 0)) cost from (select session_id, target, turn_index, count(*) n, any_value(cost) cost from cl where tool_name = 'skill' and session_id in (from oc) group by 1, 2, 3) group by 1, 2 having sum(n) >= 2)"
_RIDING = """, lt as (select session_id, turn_index, count(*) filter (cache_read > 0) over w riding_turns, max(turn_index) filter (cache_read > 0) over w last_cached_turn, coalesce(sum(coalesce(cost, 0)) filter (cache_read > 0) over w, 0) rc from priced window w as (partition by session_id order by turn_index rows between 1 following and unbounded following)),
  sk as (select cl.session_id, tool_use_id, target skill_name, cl.turn_index, riding_turns, last_cached_turn, coalesce(cost, 0) + rc cost from cl join lt using (session_id, turn_index) where tool_name = 'skill' and riding_turns > 0 and session_id in (from oc))"""
_TAX = """, fi as (select *, row_number() over (partition by session_id order by turn_index) = 1 first from priced), px as (select session_id, max(cache_create_5m + cache_create_1h) filter (first) created, count(*) filter (not first and cache_read > 0) riding_turns, coalesce(sum(coalesce(cost, 0)) filter (not first and cache_read > 0), 0) cost from fi group by 1),
  ut as (select session_id, cast(substr(session_id, 2) as bigint) % 40 + 1 tokens from priced group by 1), tx as (select session_id, created - tokens tax_tokens, riding_turns, cost from px join ut using (session_id) where session_id in (from oc) and created > tokens and riding_turns > 0)"""


@_query(_OPEN + _RECALL + " select session_id, skill_name, calls, first_turn, last_turn, round(cost, 10) cost from rc")
def skill_recalls(spark, d):
    t, c = _both(spark, d)
    return _rounded(patterns.skill_recalls(c, t), "cost")


@_query(_OPEN + _RIDING + " select session_id, tool_use_id, skill_name, turn_index, riding_turns, last_cached_turn, round(cost, 9) cost from sk")
def skill_riding(spark, d):
    t, c = _both(spark, d)
    return _rounded(patterns.skill_riding(c, t), "cost", digits=9)


def _user_tokens(t):
    return t.select("session_id").distinct().withColumn("tokens", F.substring("session_id", 2, 20).cast("long") % 40 + 1)


@_query(_OPEN + _TAX + " select session_id, tax_tokens, riding_turns, round(cost, 9) cost from tx")
def prompt_tax(spark, d):
    t = priced_turns(spark, d)
    return _rounded(patterns.prompt_tax(t, _user_tokens(t)), "cost", digits=9)


_BIG = ", bi as (select *, (select quantile_disc(size * {0}, 0.95) from cl where size > 0) q from (select * exclude (size), size * {0} size from cl) where size > 0), ob as (select source, tool_name, count(*) occurrences, max(size) most, cast(quantile_disc(size, 0.95) as bigint) p95, count(distinct session_id) sessions, sum(size / 1e6 * coalesce(r_in, 0)) cost from bi where size > greatest(15000, q) group by 1, 2)"


@_query(_BIG.format(30) + " select source, tool_name, occurrences, most, p95, sessions, round(cost, 10) cost from ob")
def observed_bloat(spark, d):
    """With results thirty times as large, so that some are over the limit."""
    return _rounded(patterns.observed_bloat(_both(spark, d)[1].withColumn("size", F.col("size") * 30)), "cost")


_SURFACES = [("claude-code", "agent", "/a/Explore.md", "explore", 300, False), ("claude-code", "agent", "/a/Reviewer.md", "Reviewer", 300, False), ("codex", "skill", "/s/fmt", "FMT", 10, False), ("codex", "skill", "/s/audit", "audit", 50, True), ("opencode", "rule", "/r/no-print", "no-print", 40, False)]
_GHOSTS = """, su(source, kind, path, stem, tokens, counted) as (values ('claude-code', 'agent', '/a/Explore.md', 'explore', 300, false), ('claude-code', 'agent', '/a/Reviewer.md', 'Reviewer', 300, false), ('codex', 'skill', '/s/fmt', 'FMT', 10, false), ('codex', 'skill', '/s/audit', 'audit', 50, true), ('opencode', 'rule', '/r/no-print', 'no-print', 40, false)),
  sn as (select source, count(distinct session_id) sessions from priced group by 1), gh as (select source, kind, path, tokens, coalesce(sessions, 0) sessions, case when counted then 0 else tokens * 3e-7 end cost_per_session, case when counted then 0 else tokens * 3e-7 end * coalesce(sessions, 0) cost from su left join sn using (source) where (source, lower(stem)) not in (select (source, lower(target)) from cl where target is not null))"""


def _ghosts(spark, t, c):
    surfaces = spark.createDataFrame(_SURFACES, "source string, kind string, path string, stem string, tokens int, counted boolean")
    seen = c.where("target is not null").select("source", F.col("target").alias("name"))
    return patterns.ghosts(surfaces, seen, t.groupBy("source").agg(F.countDistinct("session_id").alias("sessions")), 3e-7)


@_query(_GHOSTS + " select source, kind, path, sessions, round(cost, 9) cost from gh")
def ghost_surfaces(spark, d):
    return _rounded(_ghosts(spark, *_both(spark, d)).select("source", "kind", "path", "sessions", "cost"), "cost", digits=9)


_REVERTS = """, ed as (select session_id, target, turn_index, call_index, cast(k % 6 as varchar) pre, cast(k % 4 as varchar) post, row_number() over (partition by session_id, target order by turn_index, call_index) n from cl where tool_name = 'Edit'),
  fo(session_id, target, turn_index, n, seen, hit) as (select session_id, target, turn_index, n, [pre], false from ed where n = 1
  union all select e.session_id, e.target, e.turn_index, e.n, case when list_contains(f.seen, e.post) then [] else list_append(f.seen, e.pre) end, list_contains(f.seen, e.post) from fo f join ed e on e.session_id = f.session_id and e.target = f.target and e.n = f.n + 1)"""


def _edit_states(c):
    return c.where("tool_name = 'Edit'").withColumns({"pre": (F.col("k") % 6).cast("string"), "post": (F.col("k") % 4).cast("string")})


@_query(_REVERTS + " select session_id, target, turn_index from fo where hit", recursive=True)
def edit_reverts(spark, d):
    return sequences.edit_reverts(_edit_states(_both(spark, d)[1]))


@_query(_OPEN + _PATTERNS + _HEAVY.format("") + _RECALL + _RIDING + _TAX + _BIG.format(1) + _GHOSTS + _REVERTS + """, fx as (
  select 'edit-heavy' kind, session_id, 0 tokens, cost usd, concat_ws('/', edits, reads) detail from eh union all select 'skill-recall-dup', session_id, 0, cost, concat_ws(':', skill_name, calls) from rc
  union all select 'skill-pruning-protection', session_id, 0, cost, concat_ws(':', skill_name, turn_index) from sk union all select 'tool-call-pattern', session_id, tokens, usd, concat_ws(':', category, evidence) from tq
  union all select 'tool-output-bloat', null, most, cost, concat_ws(':', source, tool_name) from ob union all select 'system-prompt-tax', session_id, tax_tokens, cost, cast(riding_turns as varchar) from tx
  union all select concat('ghost-', kind), null, tokens, cost, path from gh union all select 'edit-revert', session_id, 0, coalesce(cost, 0), concat_ws(':', fo.target, fo.turn_index) from fo join (select session_id, turn_index, cost from priced) using (session_id, turn_index) where hit
  union all select 'compaction-loss', session_id, cache_read, coalesce(cache_read / 1e6 * r_read, 0), cast(event_id as varchar) from priced where turn_index % 10 = 9
  union all select 'tool-output-bloat', null, 20000, 0, '/settings.json'
  union all select 'unpriced-usage', session_id, sum(input_tokens + output_tokens + case when source = 'codex' then 0 else reasoning_tokens end + cache_read + cache_create_5m + cache_create_1h), 0, cast(count(*) as varchar) from priced where not priced group by 2),
  fr as (select *, round(usd, 9) u from fx), un as (select distinct session_id s from priced where not priced)
  select kind, session_id, cast(tokens as bigint) tokens, cast(u as double) usd, case when s is not null then 'unpriced' when u >= 0.5 then case when kind = 'edit-heavy' then 'warn' else 'high' end when u >= 0.05 then 'warn' else 'info' end severity, detail from fr left join un on s = session_id""", recursive=True)  # fmt: skip
def findings_by_sql(spark, d):
    """All findings but the three kinds of runs, which have queries of their own."""
    return _findings(spark, d).where("kind not in ('retry-loop', 'failure-run', 'cancellation-run')")


def _findings(spark, d):
    t, c = _both(spark, d)
    lost = t.where("turn_index % 10 = 9").select("session_id", F.col("event_id").alias("compaction_id"), F.col("cache_read").alias("lost_tokens"), (F.col("cache_read") / 1e6 * F.col("cache_read_rate")).alias("lost_cost"))
    settings = spark.createDataFrame([("/settings.json", 20_000), ("/other.json", 9_000)], "path string, tokens long")
    status = c.withColumn("status", F.when(F.col("k") % 5 == 0, "cancelled").otherwise("completed"))
    return findings.detect_all(t, status, lost, sequences.edit_reverts(_edit_states(c)), _user_tokens(t), _ghosts(spark, t, c), settings)


def every_finding(spark, d):
    """Findings of all kinds, runs included."""
    return _findings(spark, d)


QUERIES["findings"] = every_finding
QUERIES["bash_verbs_top_examples"], ORACLES["bash_verbs_top_examples"] = hotspots_by_verb, ORACLES["hotspots_by_verb"]


_QUALITY = f""", tl as (select session_id, turn_index, count(*) n, min(is_error) bad from cl group by 1, 2), tg as (select p.session_id, p.turn_index, n, sum(case when bad = 1 then 0 else 1 end) over (partition by p.session_id order by p.turn_index desc) good from priced p left join tl using (session_id, turn_index)),
  tf as (select session_id, cast(coalesce(sum(n) filter (good = 0), 0) as bigint) trailing_failures from tg group by 1), ls as (select session_id, count(*) turns, arg_max_null(stop_reason, turn_index) stop, max_by(ts, turn_index) ts, max_by(k % 3 = 0, turn_index) quits from priced group by 1),
  qu as (select *, case when stop is null then 'unknown' when stop = 'end_turn' then 'assistant' else 'user' end ending_role, {_NOW_SQL} - ts < interval 600 seconds is_recent from ls join tf using (session_id)),
  qr as (select *, case when turns <= 2 and ending_role = 'assistant' then 'completed:medium:single-exchange' when turns < 3 then 'unknown:low:too-short' when is_recent then 'unknown:low:recent' when ending_role = 'user' and turns >= 10 then 'abandoned:high:user-ended-long' when ending_role = 'user' then 'abandoned:medium:user-ended'
    when trailing_failures >= 3 then 'errored:medium:failure-streak' when ending_role = 'unknown' then 'completed:low:unknown-ending' when quits then 'completed:low:give-up' else 'completed:medium:assistant-ended' end o from qu)"""


@_query(_QUALITY + " select session_id, turns, trailing_failures, ending_role, split_part(o, ':', 1) outcome, split_part(o, ':', 2) confidence, is_recent, split_part(o, ':', 3) reason from qr")
def session_outcomes(spark, d):
    t, c = _both(spark, d)
    texts = t.groupBy("session_id").agg(F.max_by(F.when(F.col("k") % 3 == 0, "Sorry, I'm unable to do that").otherwise("done"), "turn_index").alias("text"))
    return quality.outcomes(t, c, _NOW, texts)


@_query(" , os as (select *, k % 2 = 0 has_edits, k % 3 retries, event_id % 4 = 1 sidechain from turns) select session_id, count(*) filter (has_edits and not sidechain) edit_turns, count(*) filter (has_edits and not sidechain and retries = 0) one_shot_turns, cast(coalesce(sum(retries) filter (has_edits and not sidechain), 0) as bigint) total_retries, round(count(*) filter (has_edits and not sidechain and retries = 0) / nullif(count(*) filter (has_edits and not sidechain), 0), 9) one_shot_rate from os group by 1")
def one_shot_metrics(spark, d):
    t = turns(spark, d).withColumns({"has_edits": F.col("k") % 2 == 0, "retries": F.col("k") % 3, "sidechain": F.col("event_id") % 4 == 1})
    return _rounded(quality.one_shot(t), "one_shot_rate", digits=9)


@_query(""", sq as (select session_id, turn_index, concat_ws('', case when k % 2 = 0 then 'E' else 'B' end, case when (k >> 1) % 2 = 0 then 'E' else 'B' end, case when (k >> 2) % 2 = 0 then 'E' else 'B' end, case when (k >> 3) % 2 = 0 then 'E' else 'B' end, case when (k >> 4) % 2 = 0 then 'E' else 'B' end, case when (k >> 5) % 2 = 0 then 'E' else 'B' end) s from turns)
  select session_id, turn_index, cast(len(regexp_extract_all(regexp_replace(s, '^B*', ''), 'B+E')) as integer) retries from sq""")
def retries_in_turn(spark, d):
    names = F.array(*[F.struct(F.when(F.shiftright("k", i) % 2 == 0, "Edit").otherwise("Bash").alias("name")) for i in range(6)])
    return turns(spark, d).select("session_id", "turn_index", activity.retries(names).alias("retries"))


_RE = {"debugging": activity.DEBUGGING, "review": activity.REVIEW, "refactoring": activity.REFACTORING, "feature": activity.FEATURE}
_WORDS = "case " + " ".join(f"when regexp_matches(text, '{p}') then '{n}'" for n, p in _RE.items()) + f" when regexp_matches(text, '{activity.BRAINSTORMING}') then 'brainstorming' when regexp_matches(text, '{activity.PLANNING}') then 'planning' when turn % 2 = 1 then 'reasoning' else 'conversation' end"


@_query(f" select conv_id, turn, {_WORDS} activity from (select conv_id, turn, coalesce(text, '') text from conversations)")
def request_activities(spark, d):
    none = F.array().cast("array<struct<name: string, target: string, command: string>>")
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.select("conv_id", "turn", activity.activity(none, F.col("text"), reasoning=F.col("turn") % 2).alias("activity"))


@_query(""", ta as (select session_id, turn_index, list(struct_pack(n := tool_name, t := target) order by call_index) c, max(is_error) bad from cl group by 1, 2), tb as (select *, list_transform(c, lambda x: x.n) names, list_transform(list_filter(c, lambda x: x.n = 'Bash'), lambda x: x.t) commands from ta)
  select case when list_contains(names, 'Task') then 'delegation' when bad = 1 then 'debugging' when list_contains(names, 'Edit') then 'coding' else coalesce(list_filter(list_transform(commands, lambda x: case when x = 'pytest -q' then 'testing' when x in ('git status', 'gh pr view 7', 'cd /x && git diff') then 'review' when x = 'npm run build' then 'build-deploy' end), lambda x: x is not null)[1], 'exploration') end activity, count(*) turns from tb group by 1""")
def turn_activities(spark, d):
    c = _both(spark, d)[1].groupBy("session_id", "turn_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("call_index", F.col("tool_name").alias("name"), "target", F.col("target").alias("command")))), lambda x: F.struct(x["name"].alias("name"), x["target"].alias("target"), x["command"].alias("command"))).alias("c"), (F.max("is_error") == 1).alias("bad"))
    return c.groupBy(activity.activity(F.col("c"), F.lit(""), F.col("bad")).alias("activity")).agg(F.count("*").alias("turns"))


@_query(" select case tool_name when 'Task' then 'Task' else tool_name end tool, case when k % 4 = 0 then 'completed' when k % 4 = 1 then 'errored' when k % 4 = 2 then 'running' else 'unknown' end status, count(*) n from cl group by 1, 2")
def tool_aliases(spark, d):
    raw = {"Edit": "apply_patch", "Bash": "exec_command", "Read": "view_image", "Task": "send_input", "Glob": "glob", "Grep": "grep"}
    c = _both(spark, d)[1]
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in raw.items() for x in kv]), F.col("tool_name")), F.col("tool_name"))
    said = F.get(F.array(*map(F.lit, ("Succeeded", "FAILED", "in-progress", "odd"))), (F.col("k") % 4).cast("int"))
    return c.groupBy(text.tool_name(name).alias("tool"), text.status(said).alias("status")).agg(F.count("*").alias("n"))


@_query(" select verb normalized, count(*) calls, count(distinct target) distinct_commands from cv group by 1")
def command_verbs(spark, d):
    from ledgerloom.functions.shell import with_verbs

    c = with_verbs(_both(spark, d)[1].where("tool_name = 'Bash'"), "target")
    return c.groupBy(F.col("verb.normalized").alias("normalized")).agg(F.count("*").alias("calls"), F.countDistinct("target").alias("distinct_commands"))


@_query(" select source, count(*) n, count(distinct session_id) sessions from turns where ts >= timestamp '2024-01-03' and ts <= timestamp '2024-01-09 12:00:00' and source = 'codex' group by 1")
def filtered_scan(spark, d):
    t = turns(spark, d).withColumns({"project": F.lit("p"), "project_key": F.lit("k")})
    kept = filters.scan(t, datetime(2024, 1, 3, tzinfo=timezone.utc), datetime(2024, 1, 9, 12, tzinfo=timezone.utc), source="codex", project="k")
    return kept.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))


_SPANS = """, rs as (select session_id, message_id, tool_use_id, is_error, case when k % 7 = 0 then null when k % 5 = 0 then 'cancelled' when is_error = 1 then 'error' else 'ok' end result from cl), rf as (select session_id, message_id, max(result = 'error') bad from rs group by 1, 2),
  rt as (select p.session_id, stop_reason, coalesce(bad, false) bad, cost from priced p left join rf using (session_id, message_id)),
  sp as (select session_id, 'turn' kind, case stop_reason when 'refusal' then 'error: refusal' when 'max_tokens' then 'error: max_tokens' else case when bad then 'error' else 'ok' end end status, cost from rt
  union all select session_id, 'inference', case when bad then 'error' else 'ok' end, 0 from rt union all select session_id, 'tool_use', case when result = 'error' then 'error' else 'ok' end, 0 from rs union all select session_id, 'tool_result', result, 0 from rs where result is not null)"""


@_query(_SPANS + " select session_id, kind, status, count(*) spans, round(sum(coalesce(cost, 0)), 10) cost from sp group by 1, 2, 3")
def span_status(spark, d):
    """Results of calls from events: one that still runs for every seventh, cancelled ones, and an earlier running one for all."""
    t, c = _both(spark, d)
    last = F.when(F.col("k") % 7 == 0, "running").when(F.col("k") % 5 == 0, "cancelled").when(F.col("is_error") == 1, "errored").otherwise("completed")
    events = c.select("session_id", "tool_use_id", F.posexplode(F.array(F.lit("running"), last)).alias("event_index", "status"))
    out = spans.spans(t, c, events).groupBy("session_id", "kind", "status").agg(F.count("*").alias("spans"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"))
    return _rounded(out, "cost")


_FLOW = """, fn as (select session_id, message_id, row_number() over (partition by session_id order by turn_index) - 1 number from priced qualify number < 50), fc as (select cl.*, number, row_number() over (partition by cl.session_id, cl.message_id order by call_index) ro from cl join fn using (session_id, message_id)),
  fs as (select *, row_number() over (partition by session_id order by number, ro) rail from fc where tool_name = 'Task')"""


@_query(_FLOW + """ select session_id, message_id || ':inf-0' node, 'inference' kind, 'inf #1' label, 0 rail, number * 96 x, 0 y from fn union all select session_id, message_id || ':tu-' || tool_use_id, case when tool_name = 'skill' then 'skill' else 'tool-use' end, tool_name, 0, number * 96, ro * 32 from fc
  union all select session_id, message_id || ':tu-' || tool_use_id || ':sub', 'subagent', coalesce(target, '(unknown)'), rail, number * 96, (ro + 1) * 32 from fs""")
def flow_nodes(spark, d):
    return spans.flow(*_both(spark, d))[0]


@_query(_FLOW + """ select session_id, coalesce(lag(message_id || ':tu-' || tool_use_id) over (partition by session_id, message_id order by call_index), message_id || ':inf-0') source, message_id || ':tu-' || tool_use_id target, 'default' kind from fc
  union all select session_id, message_id || ':tu-' || tool_use_id, message_id || ':tu-' || tool_use_id || ':sub', 'dispatch' from fs union all select fs.session_id, fs.message_id || ':tu-' || tool_use_id || ':sub', fn.message_id || ':inf-0', 'return' from fs join fn on fn.session_id = fs.session_id and fn.number = fs.number + 1""")
def flow_edges(spark, d):
    return spans.flow(*_both(spark, d))[1]


@_query(""", ra as (select *, case when event_id % 4 = 1 then 'a' || cast(k % 3 as varchar) else 'main' end rail, input_tokens + cache_read + cache_create_5m + cache_create_1h context from priced), de as (select *, context - lag(context) over (partition by session_id, rail order by turn_index) delta from ra)
  select session_id, rail, message_id, turn_index, context, delta, round(coalesce(greatest(delta, 0) / 1e6 * r_read, 0), 9) usd from de where delta is not null order by delta desc, context desc, session_id, turn_index, message_id limit 20""")
def rail_deltas(spark, d):
    t = priced_turns(spark, d).withColumn("agent_id", F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("a"), (F.col("k") % 3).cast("string"))))
    return _rounded(spans.context_deltas(t), "usd", digits=9)


def _family(spark, d):
    """Turns of which some belong to agents, and edges: every session is a root; all but the first also run as agents of the session with half
    their number. Sessions with an even number have turns of named agents."""
    n = F.substring("session_id", 2, 20).cast("long")
    m = F.col("event_id") % 4
    t = priced_turns(spark, d).withColumns({"agent_id": F.when((n % 2 == 0) & (m == 1), F.concat(F.lit("x"), "session_id", F.lit("-"), (F.col("k") % 3).cast("string"))), "sidechain": m.isin(1, 2)})
    t = t.withColumns({"parent_agent_id": F.lit(None).cast("string"), "subagent_type": F.when(F.col("k") % 3 == 0, "explore").when(F.col("k") % 3 == 1, "plan")})
    s = t.select("session_id", n.alias("n")).distinct()
    roots = s.select("session_id", F.lit(None).cast("string").alias("related_session_id"), F.lit("root").alias("kind"), F.lit(None).cast("string").alias("agent_id"), F.lit(None).cast("string").alias("subagent_type"), F.lit(0).alias("position"))
    subs = s.where("n > 0").select("session_id", F.concat(F.lit("s"), F.expr("n div 2").cast("string")).alias("related_session_id"), F.lit("subagent").alias("kind"), F.concat(F.lit("ag"), F.col("n").cast("string")).alias("agent_id"), F.when(F.col("n") % 3 == 0, "review").alias("subagent_type"), F.lit(1).alias("position"))
    return t, roots.unionByName(subs)


_TREE = """, tn as (select *, cast(substr(session_id, 2) as bigint) n, event_id % 4 in (1, 2) side, case when cast(substr(session_id, 2) as bigint) % 2 = 0 and event_id % 4 = 1 then concat('x', session_id, '-', cast(k % 3 as varchar)) end agent from priced),
  nv as (select distinct session_id from tn where agent is not null), ss as (select distinct session_id, n from tn),
  ag as (select session_id, n, case when session_id in (from nv) then concat('ag', cast(n as varchar)) else session_id end node, concat('s', cast(n // 2 as varchar)) parent from ss where n > 0),
  pa as (select node, parent from ag union select agent, session_id from tn where agent is not null union select concat(session_id, ':__unresolved'), session_id from tn where side and agent is null),
  nd as (select node from pa union select parent from pa union select session_id from tn), ow as (select case when side and agent is null then concat(session_id, ':__unresolved') else coalesce(agent, session_id) end node, count(*) turns, sum(coalesce(cost, 0)) cost from tn group by 1),
  lb as (select node, case when node like '%:__unresolved' then '(unresolved)' when node like 'x%' then coalesce((select min(case when k % 3 = 0 then 'explore' when k % 3 = 1 then 'plan' end) from tn where agent = nd.node), '(unknown)')
    when node in (select node from ag) then case when (select any_value(n) from ag where ag.node = nd.node) % 3 = 0 then 'review' else '(unknown)' end when node in (select session_id from tn) then 'main' else node end label from nd),
  an(node, up, depth) as (select node, node, 0 from nd union all select an.node, pa.parent, depth + 1 from an join pa on pa.node = an.up where pa.node != pa.parent),
  cu as (select up node, sum(coalesce(turns, 0)) cumulative_turns, sum(coalesce(cost, 0)) cumulative_cost, count(*) nodes from an left join ow on ow.node = an.node group by 1), dp as (select node, max(depth) depth from an group by 1)"""


@_query(_TREE + " select node, parent, label, coalesce(turns, 0) turns, round(coalesce(cost, 0), 9) cost, cast(cumulative_turns as bigint) cumulative_turns, round(cumulative_cost, 9) cumulative_cost, depth, nodes from nd left join pa using (node) join lb using (node) left join ow using (node) join cu using (node) join dp using (node)", recursive=True)
def subagent_tree(spark, d):
    return _rounded(agents.subagent_tree(*_family(spark, d)), "cost", "cumulative_cost", digits=9)


@_query(_TREE + " select label subagent_type, count(*) invocations, cast(sum(turns) as bigint) turns, round(sum(cost), 9) total, round(quantile_disc(cost, 0.5), 9) p50, round(quantile_disc(cost, 0.95), 9) p95, round(avg(cost), 9) mean from lb join ow using (node) where label not in ('main', '(unresolved)') group by 1", recursive=True)
def subagent_types(spark, d):
    return _rounded(agents.type_statistics(agents.subagent_tree(*_family(spark, d))), "total", "p50", "p95", "mean", digits=9)


_GROWTH = """, rl as (select *, case when event_id % 4 = 0 then concat('a', cast(k % 2 as varchar)) else 'main' end rail, input_tokens + cache_read + cache_create_5m + cache_create_1h ctx from priced),
  gp as (select *, row_number() over w inference_idx, lag(ctx) over w prior, lag(ts) over w p_ts, lag(message_id) over w p_id from rl window w as (partition by session_id, rail order by turn_index)),
  ga as (select *, ctx - prior raw, ctx < prior and exists (select 1 from rl c where c.session_id = gp.session_id and c.turn_index % 10 = 4 and c.ts between p_ts and gp.ts) compacted from gp where prior is not null),
  st as (select message_id m, count(*) n, sum(size * 4 // 4) tokens, string_agg(tool_name || ' result', ',' order by call_index) names from cl where size is not null group by 1)
  select session_id, rail, message_id turn_id, inference_idx, prior, ctx "current", case when compacted then 0 else raw end delta, round(case when compacted or r_read is null then 0 else greatest(raw, 0) / 1e6 * r_read end, 10) usd,
  coalesce(n, 0) + case when compacted then 1 else 0 end steps, cast(coalesce(tokens, 0) + case when compacted then -raw else 0 end as bigint) step_tokens, concat_ws(',', names, case when compacted then concat('compaction -', cast(-raw as varchar), ' tok') end) drivers
  from ga left join st on m = p_id where compacted or raw >= 1000"""


@_query(_GROWTH)
def context_growth(spark, d):
    """Every gap of the main rail and of agents, with the results between; a session is compacted at the time of every tenth turn."""
    t, c = _both(spark, d)
    rail = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("a"), (F.col("k") % 2).cast("string"))).otherwise("main")
    place = lambda i: F.struct("turn_index", F.lit(0).alias("inference"), i.cast("long").alias("call"))
    context = F.col("input_tokens") + F.col("cache_read") + F.col("cache_create_5m") + F.col("cache_create_1h")
    inferences = t.select("session_id", rail.alias("rail"), place(F.lit(-1)).alias("place"), F.col("message_id").alias("turn_id"), F.col("ts").alias("start_ts"), F.col("ts").alias("end_ts"), context.alias("context"), rate("cache_read_rate").alias("cache_read_rate"))
    results = c.where("size is not null").select("session_id", rail.alias("rail"), place(F.col("call_index")).alias("place"), "tool_use_id", "tool_name", (F.col("size") * 4).alias("bytes"), F.lit(False).alias("truncated"))
    out = growth.rail_growth(inferences, growth.result_steps(results), t.where("turn_index % 10 = 4").select("session_id", "ts"), top=None)
    tokens = F.aggregate("steps", F.lit(0).cast("long"), lambda a, s: a + s["tokens"])
    names = F.array_join(F.transform("steps", growth.driver), ",")
    return out.select("session_id", "rail", "turn_id", "inference_idx", "prior", "current", "delta", F.round("usd", 10).alias("usd"), F.size("steps").alias("steps"), tokens.alias("step_tokens"), names.alias("drivers"))
