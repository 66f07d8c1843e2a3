"""Joins between ledger tables: stamps, as-of lookups, intervals, relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fold_stamps(turns: DataFrame, stamps: DataFrame) -> DataFrame:
    """Turns with the map ``enrichment`` of all stamps that match, later (ts, written_at) values winning.

    A stamp (session_id, message_id, from_ts, to_ts, ts, written_at, tags) matches where each given part agrees; times
    are inclusive. Stamps with a session or a message join on it; only those with neither meet every turn.
    """
    t = turns.select("session_id", "message_id", "ts").alias("t")
    s = stamps.select("session_id", "message_id", "from_ts", "to_ts", F.col("ts").alias("stamped"), "written_at", "tags").alias("s")
    timed = (F.col("s.from_ts").isNull() | (F.col("t.ts") >= F.col("s.from_ts"))) & (F.col("s.to_ts").isNull() | (F.col("t.ts") <= F.col("s.to_ts")))
    cols = ["t.session_id", "t.message_id", "stamped", "written_at", "tags"]
    by_session = t.join(s.where("session_id is not null").alias("s"), (F.col("t.session_id") == F.col("s.session_id")) & (F.col("s.message_id").isNull() | (F.col("t.message_id") == F.col("s.message_id"))) & timed).select(*cols)
    by_message = t.join(s.where("session_id is null and message_id is not null").alias("s"), (F.col("t.message_id") == F.col("s.message_id")) & timed).select(*cols)
    by_time = t.join(s.where("session_id is null and message_id is null").alias("s"), timed).select(*cols)
    matched = by_session.unionByName(by_message).unionByName(by_time)
    line = matched.groupBy("session_id", "message_id").agg(F.array_sort(F.collect_list(F.struct("stamped", "written_at", F.map_entries("tags").alias("tags")))).alias("line"))
    pairs = F.flatten(F.transform("line", lambda x: x["tags"]))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"])
    folded = line.select("session_id", "message_id", F.map_from_arrays(keys, last).alias("enrichment"))
    return turns.join(folded, ["session_id", "message_id"], "left").withColumn("enrichment", F.coalesce("enrichment", F.create_map().cast("map<string,string>")))


def has_tags(tags: dict[str, str]):
    """All keys must have these values."""
    out = F.lit(True)
    for k, v in tags.items():
        out = out & F.coalesce(F.try_element_at("enrichment", F.lit(k)) == v, F.lit(False))
    return out


def events_to_turns(events: DataFrame, turns: DataFrame) -> DataFrame:
    """Each event with ``turn_id``: its own message if that is a turn, else the last turn at or before its time, else
    the session's first turn; an event without a time that names no turn has none."""
    exact = turns.select(F.col("session_id").alias("own_session"), F.col("message_id").alias("own"), F.lit(True).alias("hit"))
    marked = events.join(exact, (F.col("session_id") == F.col("own_session")) & (F.col("message_id") == F.col("own")), "left").drop("own_session", "own")
    a = turns.select("session_id", "ts", F.col("message_id").alias("turn"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("event_id"))
    b = marked.select("session_id", "ts", F.lit(None).cast("string").alias("turn"), F.lit(1).alias("side"), "event_id").where("ts is not null")
    line = Window.partitionBy("session_id").orderBy("ts", "side", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("session_id").orderBy("ts", "side", "turn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = a.unionByName(b).withColumn("asof", F.coalesce(F.last("turn", ignorenulls=True).over(line), F.first("turn", ignorenulls=True).over(whole))).where("side = 1")
    out = marked.join(found.select("event_id", "asof"), "event_id", "left")
    return out.withColumn("turn_id", F.when(F.col("hit"), F.col("message_id")).otherwise(F.col("asof"))).drop("hit", "asof")


def compaction_losses(compactions: DataFrame, turns: DataFrame) -> DataFrame:
    """Compactions with the cache that the turn before them held and its price, and the turns since the one before."""
    prior = turns.select("session_id", F.col("message_id").alias("preceding"), F.col("cache_read").alias("lost_tokens"), (F.col("cache_read") / 1e6 * F.col("cache_read_rate")).alias("lost_cost"))
    order = Window.partitionBy("session_id").orderBy("ts", "compaction_id")
    bounded = compactions.withColumn("previous", F.lag("ts").over(order))
    priced = bounded.join(prior, ["session_id", "preceding"], "left")
    inside = priced.alias("c").join(turns.alias("t"), (F.col("c.session_id") == F.col("t.session_id")) & (F.col("t.ts") <= F.col("c.ts")) & (F.col("c.previous").isNull() | (F.col("t.ts") > F.col("c.previous"))), "left")
    return inside.groupBy("c.session_id", "c.compaction_id").agg(F.first("lost_tokens").alias("lost_tokens"), F.first("lost_cost").alias("lost_cost"), F.count("t.message_id").alias("turns"), F.count_if(F.col("t.tool_name") == "Edit").alias("edits"), F.count_if(F.col("t.tool_name") == "Bash").alias("bashes"))


def relationship_turns(edges: DataFrame, turns: DataFrame) -> DataFrame:
    """Turns of each edge (edge_id, kind, session_id, agent_id) by the first of its kind's rules that finds any.

    Roots take turns of the main thread; subagents those of their agent, else sidechain turns; forks and
    continuations all turns of the session.
    """
    t = turns.select("session_id", "message_id", "agent_id", "sidechain", "cost").alias("t")
    e = edges.dropDuplicates(["edge_id"]).alias("e")
    same = F.col("e.session_id") == F.col("t.session_id")
    rules = [
        (1, (F.col("e.kind") == "root") & ~F.col("t.sidechain")),
        (1, (F.col("e.kind") == "subagent") & (F.col("e.agent_id") == F.col("t.agent_id"))),
        (2, (F.col("e.kind") == "subagent") & F.col("t.sidechain")),
        (1, F.col("e.kind").isin("fork", "continuation")),
    ]
    rank = F.lit(None).cast("int")
    for level, rule in reversed(rules):
        rank = F.when(rule, level).otherwise(rank)
    matched = e.join(t, same).withColumn("rank", rank).where("rank is not null")
    best = F.min("rank").over(Window.partitionBy("edge_id"))
    return matched.withColumn("best", best).where("rank = best").select("edge_id", "kind", "message_id", "cost")


def relationship_statistics(edges: DataFrame, turns: DataFrame) -> DataFrame:
    each = relationship_turns(edges, turns).groupBy("kind", "edge_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("c"))
    return each.groupBy("kind").agg(F.count("*").alias("edges"), F.sum("n").alias("turns"), F.sum("c").alias("cost"))


def foreign_sessions(rows: DataFrame) -> DataFrame:
    """Files whose rows hang on rows of other files: a parent in another file makes a continuation, a session named by
    two or more files a fork (rows: file, uuid, parent, session_id)."""
    a, b = rows.alias("a"), rows.select("uuid", "file").alias("b")
    continued = a.join(b, F.col("a.parent") == F.col("b.uuid")).where("a.file != b.file").select(F.col("a.file").alias("file"), F.col("b.file").alias("other"), F.lit("continuation").alias("kind")).distinct()
    shared = rows.where("session_id != file").groupBy("session_id").agg(F.collect_set("file").alias("files")).where(F.size("files") >= 2)
    forks = shared.select(F.explode("files").alias("file"), F.col("session_id").alias("other"), F.lit("fork").alias("kind"))
    return continued.unionByName(forks.join(continued, "file", "left_anti"))


def new_rows(batch: DataFrame, stored: DataFrame, keys: list[str], fingerprint: str | None = None) -> DataFrame:
    """Rows of ``batch`` to append: one a key, none that is stored, none whose content is stored under another key."""
    fresh = batch.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")
    if fingerprint:
        fresh = fresh.dropDuplicates([fingerprint]).join(stored.select(fingerprint), fingerprint, "left_anti")
    return fresh.select(*batch.columns)


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Both tables with one row a key, the one with the highest version."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(version))
    return stored.unionByName(batch).withColumn("r", F.row_number().over(newest)).where("r = 1").drop("r")
