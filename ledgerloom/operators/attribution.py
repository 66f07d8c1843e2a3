"""Who caused a turn's cost: tools of the turn before it, and the results that ride along in its context."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.cost import rate
from ledgerloom.functions.text import mcp_parts
from ledgerloom.operators import dominance
from ledgerloom.sources.scratch import cut

#: Turns of a block of a session: within a block every result is weighed against every turn, over blocks by dominance sums.
BLOCK = 512
FILE_TOOLS = ("Read", "Edit", "Write", "NotebookEdit")


def _order():
    return Window.partitionBy("session_id").orderBy("turn_index")


def by_tool(turns: DataFrame) -> DataFrame:
    """Cost of each turn charged to the tool of its predecessor; the first turn of a session has none.

    The predecessor is taken from the whole session: filter the result, not the input.
    """
    charged = turns.withColumn("charged", F.coalesce(F.lag("tool_name").over(_order()), F.lit("(unattributed)")))
    return charged.groupBy(F.col("charged").alias("tool_name")).agg(F.count("*").alias("turns"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"))


def attributable(turns: DataFrame) -> DataFrame:
    """Turns whose record covers both tool calls and their results (columns has_tool_calls, has_tool_results; null is covered)."""
    return turns.where(F.coalesce("has_tool_calls", F.lit(True)) & F.coalesce("has_tool_results", F.lit(True)))


_RIDES = "tool_use_id string, at long, tokens double, cost double, turns long, part double"
_RIDES_ARROW = pa.schema([("tool_use_id", pa.string()), ("at", pa.int64()), ("tokens", pa.float64()), ("cost", pa.float64()), ("turns", pa.int64()), ("part", pa.float64())])


def _ride(calls: pa.Table, turns: pa.Table) -> pa.Table:
    """One block of a session: what each of its results takes of the block's later turns' cache reads, and of how much of a result each turn has a part.

    A turn after the paying one whose cache read is at least a result's size has it in its context; the results that it has share ``min(cache read, their sizes)`` by size. Sizes of
    earlier blocks are in ``base``.
    """
    size, paying = np.array(calls.column("size"), np.float64), np.array(calls.column("paying"), np.int64)
    when, read, price, base = (np.array(turns.column(c), t) for c, t in (("at", np.int64), ("read", np.float64), ("price", np.float64), ("base", np.float64)))
    inside = (paying[None, :] < when[:, None]) & (size[None, :] <= read[:, None])
    active = inside @ size + base
    part = np.divide(np.minimum(read, active), active, out=np.zeros(len(when)), where=active > 0)
    n, m = len(size), len(when)
    none = lambda k, kind: pa.nulls(k, kind)
    results = [calls.column("tool_use_id").combine_chunks(), none(n, pa.int64()), pa.array(part @ inside), pa.array((part * price) @ inside), pa.array(inside.sum(axis=0).astype(np.int64)), none(n, pa.float64())]
    shares = [none(m, pa.string()), pa.array(when), none(m, pa.float64()), none(m, pa.float64()), none(m, pa.int64()), pa.array(part)]
    return pa.concat_tables(pa.Table.from_arrays(x, schema=_RIDES_ARROW) for x in (results, shares))


def rides(results: DataFrame, readers: DataFrame) -> DataFrame:
    """(tool_use_id, riding_tokens, riding_cost, riding_turns) of ``results`` (session_id, tool_use_id, rank, size) in ``readers`` (session_id, at, read, price), turns with a rate and a
    cache read.

    A session's time is cut into blocks of BLOCK turns, each one task's group. Over blocks, a turn first learns the sizes of the earlier results that fit into its cache read; with those in
    its block it knows what a result's part is; then each result learns the parts of the later turns that have it (``operators.dominance``).
    """
    number = lambda c: F.expr(f"{c} div {BLOCK}")
    last = readers.groupBy("session_id").agg(F.max(number("at")).alias("most")).withColumn("places", F.when(F.col("most") == 0, 0).otherwise(F.length(F.bin("most"))))
    owned = results.where("size > 0").withColumn("paying", F.col("rank") + 1).withColumn("block", number("paying")).join(last, "session_id").where("block <= most")
    turns = readers.withColumn("block", number("at")).join(last, "session_id")
    turns = turns.withColumn("turn", F.concat_ws("|", "session_id", "at"))
    points = owned.select("session_id", "block", "places", F.col("size").alias("y"), F.col("size").cast("double").alias("base"))
    earlier = dominance.sums(points, turns.select("session_id", "block", "places", F.col("read").alias("y"), "turn"), ["base"], "turn")
    known = turns.join(earlier, "turn", "left").select(F.col("session_id").alias("reader"), F.col("block").alias("in_block"), "at", "read", "price", F.coalesce("base", F.lit(0.0)).alias("base"))
    weighed = owned.select("session_id", "block", "tool_use_id", "paying", "size").groupBy("session_id", "block").cogroup(known.groupBy("reader", "in_block")).applyInArrow(_ride_of, f"session_id string, {_RIDES}")
    weighed = cut(weighed)  # two plans read it
    parts = weighed.where("at is not null").select("session_id", "at", "part")
    later = turns.where("places > 0").join(parts, ["session_id", "at"]).select("session_id", "block", "places", F.col("read").alias("y"), F.col("part").alias("tokens"), (F.col("part") * F.col("price")).alias("cost"), F.lit(1).cast("long").alias("turns"))
    asked = owned.select("session_id", "block", "places", F.col("size").alias("y"), "tool_use_id")
    far = dominance.sums(later, asked, ["tokens", "cost", "turns"], "tool_use_id", later=True)
    both = weighed.where("tool_use_id is not null").select("tool_use_id", "tokens", "cost", "turns").unionByName(far)
    total = both.groupBy("tool_use_id").agg(*[F.sum(c).alias(c) for c in ("tokens", "cost", "turns")]).join(owned.select("tool_use_id", "size"), "tool_use_id")
    return total.select("tool_use_id", (F.col("tokens") * F.col("size")).alias("riding_tokens"), (F.col("cost") * F.col("size") / 1e6).alias("riding_cost"), F.col("turns").alias("riding_turns"))


def _ride_of(key: tuple, calls: pa.Table, turns: pa.Table) -> pa.Table:
    out = _ride(calls, turns)
    return pa.Table.from_arrays([pa.array([key[0].as_py()] * out.num_rows, pa.string()), *(c.combine_chunks() for c in out.columns)], names=["session_id", *_RIDES_ARROW.names])


def hotspots(calls: DataFrame, turns: DataFrame) -> DataFrame:
    """Cost of each tool call's result: entering the context at the next turn, and riding in later ones.

    ``calls``: session_id, turn_index, tool_use_id, tool_name, target, args_hash, size (tokens of the result, null: unknown);
    ``turns``: session_id, turn_index, usage and rate columns, ``priced``. In a session with any known size (``method`` sized) the results of a
    turn enter at the next one with at most its new content, by size, at its mix of input and cache-write rates, and ride
    after that; in one without (even-split) the next turn's new content is split evenly and nothing rides. A turn without a rate
    charges neither tokens nor cost. No session is one task's work (``rides``).
    """
    created = F.col("cache_create_5m") + F.col("cache_create_1h")
    bound = turns.select("session_id", "turn_index", "cache_read", "priced", "input_tokens", created.alias("created"), rate("input").alias("p_in"), rate("cache_write").alias("p_write"), rate("cache_read_rate").alias("price"))
    lead = lambda c: F.lead(c).over(_order())
    bound = bound.withColumn("rank", F.row_number().over(_order()).cast("long"))
    paying = bound.select("session_id", "turn_index", "rank", lead("priced").alias("pays"), lead("input_tokens").alias("new_in"), lead("created").alias("new_created"), lead("p_in").alias("p_in"), lead("p_write").alias("p_write"))
    sized = F.max(F.col("size").isNotNull()).over(Window.partitionBy("session_id"))
    of_turn = Window.partitionBy("session_id", "turn_index")
    own = calls.withColumns({"sized": sized, "size": F.coalesce("size", F.lit(0)).cast("long")}).withColumns({"siblings": F.sum("size").over(of_turn), "k": F.count("*").over(of_turn)})
    c = own.join(paying, ["session_id", "turn_index"])
    fresh = F.col("new_in") + F.col("new_created")
    able = F.coalesce(F.col("pays") & (fresh > 0), F.lit(False))
    mixed = F.col("new_in") / fresh * F.col("p_in") + (1 - F.col("new_in") / fresh) * F.col("p_write")
    by_size = F.when(able & (F.col("siblings") > 0), F.col("size") / F.col("siblings") * F.least("siblings", fresh))
    tokens = F.coalesce(F.when(F.col("sized"), by_size).otherwise(F.when(able, fresh / F.col("k"))), F.lit(0.0))
    c = c.withColumns({"initial_tokens": tokens, "initial_cost": F.coalesce(tokens / 1e6 * mixed, F.lit(0.0))})
    results = c.where("sized").select("session_id", F.concat_ws("|", "session_id", "tool_use_id").alias("tool_use_id"), "rank", "size")
    readers = bound.where("priced and price is not null and cache_read > 0").select("session_id", F.col("rank").alias("at"), F.col("cache_read").alias("read"), "price")
    ridden = rides(results, readers).withColumnRenamed("tool_use_id", "own")
    out = c.withColumn("own", F.concat_ws("|", "session_id", "tool_use_id")).join(ridden, "own", "left")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return out.select(
        *[F.col(x) for x in c.columns if x in calls.columns and x != "size"], "size", F.when(F.col("sized"), "sized").otherwise("even-split").alias("method"), "initial_tokens", "initial_cost",
        zero("riding_tokens").alias("riding_tokens"), zero("riding_cost").alias("riding_cost"), F.coalesce("riding_turns", F.lit(0)).alias("riding_turns"), (F.col("initial_cost") + zero("riding_cost")).alias("total_cost"),
    )


_SUMMED = ("initial_tokens", "initial_cost", "riding_tokens", "riding_cost", "total_cost")


def _sums(spots: DataFrame) -> list[Column]:
    """Sums of a group of results; bytes, the largest and the truncated ones where the columns are there."""
    out = [F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in _SUMMED], F.avg("riding_turns").alias("average_ride")]
    if "output_bytes" in spots.columns:
        out += [F.sum("output_bytes").alias("output_bytes"), F.max("output_bytes").alias("max_output_bytes"), F.count_if("output_truncated").alias("truncated")]
    return out


def by_file(spots: DataFrame) -> DataFrame:
    """By target of the file tools, with the turn that first named it (smallest by session, then turn)."""
    files = spots.where(F.col("tool_name").isin(*FILE_TOOLS) & F.col("target").isNotNull())
    return files.groupBy("target").agg(*_sums(spots), F.min(F.struct("session_id", "turn_index")).alias("f")).withColumns({"first_session": F.col("f.session_id"), "first_turn": F.col("f.turn_index")}).drop("f")


def by_command(spots: DataFrame) -> DataFrame:
    """Bash calls by exact arguments, with the first command text of each."""
    bash = spots.where("tool_name = 'Bash'")
    return bash.groupBy("args_hash").agg(*_sums(spots), F.min_by("target", F.struct("session_id", "turn_index", "tool_use_id")).alias("command"))


def by_verb(spots: DataFrame, examples: int = 3) -> DataFrame:
    """Bash calls by the normalised verb of their command: distinct commands, average ride, and the costliest examples."""
    from ledgerloom.functions.shell import with_verbs

    bash = with_verbs(spots.where("tool_name = 'Bash'"), "target").withColumn("verb", F.col("verb.normalized")).where("verb is not null")
    each = bash.groupBy("verb", "target").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in _SUMMED], F.sum("riding_turns").alias("rides"))
    ranked = each.withColumn("r", F.row_number().over(Window.partitionBy("verb").orderBy(F.desc(F.round("total_cost", 9)), "target")))
    best = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= examples, F.struct("r", "target")))), lambda x: x["target"]), ",")
    return ranked.groupBy("verb").agg(F.sum("n").alias("calls"), F.count("*").alias("distinct_commands"), *[F.sum(c).alias(c) for c in _SUMMED], (F.sum("rides") / F.sum("n")).alias("average_ride"), best.alias("examples"))


def by_subagent(spots: DataFrame) -> DataFrame:
    """Spawning calls by the kind of agent they name."""
    return spots.where(F.col("tool_name").isin("Agent", "Task")).groupBy(F.coalesce("target", F.lit("(unknown)")).alias("subagent_type")).agg(*_sums(spots))


def by_server(spots: DataFrame, examples: int = 3) -> DataFrame:
    """Calls of ``mcp__server__tool`` by server, with its costliest tools."""
    calls = spots.withColumn("m", mcp_parts(F.col("tool_name"))).where("m is not null").withColumns({"server": F.col("m.server"), "tool": F.col("m.tool")})
    each = calls.groupBy("server", "tool").agg(F.count("*").alias("n"), F.sum("total_cost").alias("total_cost"))
    ranked = each.withColumn("r", F.row_number().over(Window.partitionBy("server").orderBy(F.desc(F.round("total_cost", 9)), "tool")))
    best = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= examples, F.struct("r", "tool")))), lambda x: x["tool"]), ",")
    return ranked.groupBy("server").agg(F.sum("n").alias("calls"), F.sum("total_cost").alias("total_cost"), best.alias("tools"))


def session_totals(spots: DataFrame, turns: DataFrame) -> DataFrame:
    """Per session the whole cost, what results account for, and the rest."""
    grand = turns.groupBy("session_id").agg(F.sum(F.coalesce("cost", F.lit(0.0))).alias("grand"))
    own = spots.groupBy("session_id").agg(F.sum("total_cost").alias("attributed"))
    return grand.join(own, "session_id", "left").select("session_id", "grand", F.coalesce("attributed", F.lit(0.0)).alias("attributed"), (F.col("grand") - F.coalesce("attributed", F.lit(0.0))).alias("unattributed"))
