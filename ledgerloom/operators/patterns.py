"""Wasteful patterns in the order of a session's tool calls. ``calls``: one row a call with the columns of its turn (``cost`` is the turn's)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import tool_name

# Tokens that a better call would save, least occurrences, span of turns of a cluster.
SEARCH_TOKENS, SEARCH_LEAST = 2500, 3
CLUSTER_TOKENS, CLUSTER_LEAST, CLUSTER_SPAN = 400, 3, 5
BASH_TOKENS = {"bash-git-state": 800, "bash-test-run": 1200, "bash-gh-pr": 600}
STREAK_LEAST = 3
HEAVY_LEAST, HEAVY_RATIO = 5, 4.0
EDITS, READS = ("Edit", "Write", "NotebookEdit"), ("Read", "NotebookRead")


def _calls_order():
    return Window.partitionBy("session_id").orderBy("turn_index", "call_index")


def islands(calls: DataFrame, *keys: Column) -> DataFrame:
    """``island``: number of the run of equal keys that a call of its session is in."""
    changed = F.lit(False)
    for k in keys:
        changed = changed | ~k.eqNullSafe(F.lag(k).over(_calls_order()))
    new = (changed | (F.row_number().over(_calls_order()) == 1)).cast("int")
    return calls.withColumn("new", new).withColumn("island", F.sum("new").over(_calls_order().rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("new")


def _runs(marked: DataFrame) -> DataFrame:
    """Runs of calls; a turn with several calls in a run costs once."""
    turn = marked.groupBy("session_id", "island", "turn_index").agg(F.count("*").alias("n"), F.first("cost").alias("cost"), F.collect_set("args_hash").alias("args"), F.min("tool_name").alias("tool_name"))
    runs = turn.groupBy("session_id", "island").agg(F.sum("n").alias("length"), F.min("turn_index").alias("first_turn"), F.max("turn_index").alias("last_turn"), F.size(F.array_distinct(F.flatten(F.collect_set("args")))).cast("long").alias("distinct_calls"), F.min("tool_name").alias("tool_name"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"))
    return runs.drop("island")


def retry_loops(calls: DataFrame, least: int = STREAK_LEAST) -> DataFrame:
    """``least`` or more failed calls in a row of one tool with the same arguments."""
    return _runs(islands(calls, F.col("is_error"), F.col("args_hash")).where("is_error = 1")).where(F.col("length") >= least)


def failure_runs(calls: DataFrame, least: int = STREAK_LEAST) -> DataFrame:
    """``least`` or more failed calls in a row, of two or more kinds."""
    return _runs(islands(calls, F.col("is_error")).where("is_error = 1")).where((F.col("length") >= least) & (F.col("distinct_calls") >= 2))


def cancellation_runs(calls: DataFrame) -> DataFrame:
    """Cancelled calls in a row (column ``status``), one or more."""
    return _runs(islands(calls, F.col("status")).where("status = 'cancelled'"))


def session_rates(turns: DataFrame) -> DataFrame:
    """(session_id, token_usd): input price of a session's most frequent model (the first seen of equals), 0 without a rate."""
    each = turns.groupBy("session_id", "model").agg(F.count("*").alias("n"), F.min("turn_index").alias("at"), F.first("input").alias("r"))
    best = each.groupBy("session_id").agg(F.max_by(F.struct("r"), F.struct("n", -F.col("at"))).alias("b"))
    return best.select("session_id", (F.coalesce("b.r", F.lit(0.0)) / 1e6).alias("token_usd"))


def _saved(found: DataFrame, turns: DataFrame) -> DataFrame:
    return found.join(session_rates(turns), "session_id", "left").withColumn("usd", F.col("tokens") * F.coalesce("token_usd", F.lit(0.0))).drop("token_usd")


def search_sequences(calls: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions with SEARCH_LEAST or more turns whose calls hold Glob, then Grep, then Read, others between them allowed."""
    steps = F.array(*map(F.lit, ("Glob", "Grep", "Read")))
    line = calls.groupBy("session_id", "turn_index").agg(F.array_sort(F.collect_list(F.struct("call_index", tool_name(F.col("tool_name")).alias("name")))).alias("line"))
    reached = F.aggregate("line", F.lit(0), lambda s, c: s + F.coalesce(F.get(steps, s) == c["name"], F.lit(False)).cast("int"))
    hits = line.where(reached == 3).groupBy("session_id").agg(F.count("*").alias("occurrences")).where(F.col("occurrences") >= SEARCH_LEAST)
    return _saved(hits.select("session_id", F.lit("search-sequence").alias("category"), "occurrences", (F.col("occurrences") * SEARCH_TOKENS).alias("tokens"), F.lit("").alias("evidence")), turns)


def edit_clusters(calls: DataFrame, turns: DataFrame) -> DataFrame:
    """Files with CLUSTER_LEAST or more edits within CLUSTER_SPAN turns; the most in any such window."""
    ahead = Window.partitionBy("session_id", "target").orderBy("turn_index").rangeBetween(0, CLUSTER_SPAN - 1)
    edits = calls.where(tool_name(F.col("tool_name")).isin(*EDITS) & F.col("target").isNotNull()).withColumn("n", F.count("*").over(ahead))
    best = edits.groupBy("session_id", "target").agg(F.max("n").alias("occurrences")).where(F.col("occurrences") >= CLUSTER_LEAST)
    return _saved(best.select("session_id", F.lit("edit-cluster").alias("category"), "occurrences", ((F.col("occurrences") - 1) * CLUSTER_TOKENS).alias("tokens"), F.col("target").alias("evidence")), turns)


def bash_patterns(calls: DataFrame, turns: DataFrame) -> DataFrame:
    """Bash calls that ask for the state of git, run tests or look at pull requests, by session."""
    from ledgerloom.functions.shell import with_verbs

    bash = with_verbs(calls.where(F.col("tool_name").isin("Bash", "bash", "exec_command", "shell") & F.col("target").isNotNull()), "target")
    binary, sub, verb = F.col("verb.binary"), F.coalesce("verb.subcommand", F.lit("")), F.col("verb.normalized")
    script = F.regexp_replace(sub, "^run ", "")
    tests = binary.isin("pytest", "jest", "vitest") | (binary.isin("cargo", "go") & (sub == "test")) | (binary.isin("pnpm", "npm", "yarn", "bun") & ((script == "test") | script.startswith("test:")))
    pulls = (binary == "gh") & ((sub == "api") | (sub == "pr") | sub.startswith("pr "))
    category = F.when((binary == "git") & sub.isin("status", "diff", "log"), "bash-git-state").when(tests, "bash-test-run").when(pulls, "bash-gh-pr")
    price = F.create_map(*[F.lit(x) for kv in BASH_TOKENS.items() for x in kv])
    hits = bash.withColumns({"category": category, "name": verb}).where("category is not null").groupBy("session_id", "category").agg(F.count("*").alias("occurrences"), F.array_join(F.sort_array(F.collect_set("name")), ",").alias("evidence"))
    return _saved(hits.select("session_id", "category", "occurrences", (F.col("occurrences") * price[F.col("category")]).alias("tokens"), "evidence"), turns)


def tool_call_patterns(calls: DataFrame, turns: DataFrame) -> DataFrame:
    return search_sequences(calls, turns).unionByName(edit_clusters(calls, turns)).unionByName(bash_patterns(calls, turns))


def edit_heavy(calls: DataFrame) -> DataFrame:
    """Sessions with HEAVY_LEAST or more edits and over HEAVY_RATIO times as many edits as reads (a Codex command that reads a file is a read:
    column ``reads_file``, where there is one); the cost is that of the turns with edits."""
    name = tool_name(F.col("tool_name"))
    read = name.isin(*READS) | (F.coalesce("reads_file", F.lit(False)) & (F.col("source") == "codex") if "reads_file" in calls.columns else F.lit(False))
    turn = calls.groupBy("session_id", "turn_index").agg(F.count_if(~read & name.isin(*EDITS)).alias("edits"), F.count_if(read).alias("reads"), F.first("cost").alias("cost"))
    n = turn.groupBy("session_id").agg(F.sum("edits").alias("edits"), F.sum("reads").alias("reads"), F.sum(F.when(F.col("edits") > 0, F.coalesce("cost", F.lit(0.0))).otherwise(0.0)).alias("cost"))
    return n.where((F.col("edits") >= HEAVY_LEAST) & (F.col("edits") > HEAVY_RATIO * F.col("reads")))


def _opencode(turns: DataFrame) -> DataFrame:
    """Sessions whose first turn is of that source."""
    return turns.groupBy("session_id").agg(F.min_by("source", "turn_index").alias("first_source")).where("first_source = 'opencode'").select("session_id")


def skill_recalls(calls: DataFrame, turns: DataFrame) -> DataFrame:
    """Skills that a session calls twice or more, with the cost of the turns that do."""
    own = calls.where("tool_name = 'skill' and skill_name is not null").join(_opencode(turns), "session_id", "left_semi")
    turn = own.groupBy("session_id", "skill_name", "turn_index").agg(F.count("*").alias("n"), F.first("cost").alias("cost"))
    return turn.groupBy("session_id", "skill_name").agg(F.sum("n").alias("calls"), F.min("turn_index").alias("first_turn"), F.max("turn_index").alias("last_turn"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost")).where("calls >= 2")


def skill_riding(calls: DataFrame, turns: DataFrame) -> DataFrame:
    """Skill calls whose text later turns read from the cache: how many, the last of them, and the cost of all."""
    later = Window.partitionBy("session_id").orderBy("turn_index").rowsBetween(1, Window.unboundedFollowing)
    cached = F.col("cache_read") > 0
    t = turns.select("session_id", "turn_index", F.count_if(cached).over(later).alias("riding_turns"), F.max(F.when(cached, F.col("turn_index"))).over(later).alias("last_cached_turn"), F.coalesce(F.sum(F.when(cached, F.coalesce("cost", F.lit(0.0)))).over(later), F.lit(0.0)).alias("riding_cost"))
    own = calls.where("tool_name = 'skill' and skill_name is not null").join(_opencode(turns), "session_id", "left_semi").join(t, ["session_id", "turn_index"]).where("riding_turns > 0")
    return own.select("session_id", "tool_use_id", "skill_name", "turn_index", "riding_turns", "last_cached_turn", (F.coalesce("cost", F.lit(0.0)) + F.col("riding_cost")).alias("cost"))


def prompt_tax(turns: DataFrame, user_tokens: DataFrame) -> DataFrame:
    """What a session's first turn writes to the cache beyond the first user message (session_id, tokens), and the turns that read it after."""
    order = Window.partitionBy("session_id").orderBy("turn_index")
    rows = turns.withColumn("first", F.row_number().over(order) == 1)
    cached = ~F.col("first") & (F.col("cache_read") > 0)
    s = rows.groupBy("session_id").agg(F.max(F.when(F.col("first"), F.col("cache_create_5m") + F.col("cache_create_1h"))).alias("created"), F.count_if(cached).alias("riding_turns"), F.sum(F.when(cached, F.coalesce("cost", F.lit(0.0))).otherwise(0.0)).alias("cost"))
    s = s.join(_opencode(turns), "session_id", "left_semi").join(user_tokens.select("session_id", F.col("tokens").alias("user_tokens")), "session_id")
    return s.where("created > 0 and user_tokens > 0 and created > user_tokens and riding_turns > 0").select("session_id", (F.col("created") - F.col("user_tokens")).alias("tax_tokens"), "riding_turns", "cost")


def observed_bloat(calls: DataFrame, limit: int = 15_000, enough: int = 20) -> DataFrame:
    """Results over the limit, or over the 95th percentile of all where there are ``enough`` and that is more, by source and tool."""
    sized = calls.where("size > 0")
    p95 = sized.agg(F.when(F.count("*") >= enough, F.expr("percentile_disc(0.95) within group (order by size)")).otherwise(0).alias("p95"))  # one row
    big = sized.join(F.broadcast(p95), F.col("size") > F.greatest(F.lit(limit), F.col("p95")))
    return big.groupBy("source", F.coalesce(tool_name(F.col("tool_name")), F.lit("<unknown>")).alias("tool_name")).agg(F.count("*").alias("occurrences"), F.max("size").alias("most"), F.expr("percentile_disc(0.95) within group (order by size)").cast("long").alias("p95"), F.countDistinct("session_id").alias("sessions"), F.sum(F.col("size") / 1e6 * F.coalesce("input", F.lit(0.0))).alias("cost"))


def configured_bloat(settings: DataFrame, limit: int = 15_000) -> DataFrame:
    """Settings (path, tokens) that allow a tool more output than the limit."""
    return settings.where(F.col("tokens") > limit)


def ghosts(surfaces: DataFrame, observed: DataFrame, sessions: DataFrame, token_usd: float) -> DataFrame:
    """Surfaces (source, kind, path, stem, tokens, counted) that no session of their source ever named (source, name), whatever the case,
    costliest first. A surface that a catalogue counts already costs nothing here. ``sessions``: (source, sessions)."""
    used = observed.select("source", F.lower("name").alias("used")).distinct()
    left = surfaces.join(used, (surfaces["source"] == used["source"]) & (F.lower("stem") == F.col("used")), "left_anti").join(sessions, "source", "left")
    each = F.when(F.coalesce("counted", F.lit(False)), 0.0).otherwise(F.col("tokens") * token_usd)
    out = left.withColumns({"cost_per_session": each, "sessions": F.coalesce("sessions", F.lit(0))}).withColumn("cost", F.col("cost_per_session") * F.col("sessions"))
    return out.orderBy(F.desc("cost"), F.desc("tokens"), F.asc("path"))
