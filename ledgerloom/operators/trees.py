"""Forests and graphs of sessions and agents over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.scratch import cut



def _rounds(node_count: int) -> int:
    """Doublings after which every chain without a cycle has ended."""
    return max(1, node_count).bit_length() + 1


def pointers(edges: DataFrame) -> DataFrame:
    """(node, parent) of every node, one parent each (the smallest), loops and the edge below a cycle's smallest node cut."""
    nodes = edges.select("node").union(edges.where("parent is not null").select(F.col("parent").alias("node"))).distinct()
    ups = edges.where("parent is not null and node != parent").groupBy("node").agg(F.min("parent").alias("parent"))
    all_up = cut(nodes.join(ups, "node", "left"))
    n = all_up.count()
    # the smallest node within reach and the pointer, both doubled; a pointer that is left after all rounds leads into a cycle
    jump, k = all_up.withColumns({"low": F.coalesce("parent", "node"), "up": F.col("parent")}).select("node", "low", "up"), 0
    while k < _rounds(n) and not jump.where("up is not null").isEmpty():
        far = jump.select(F.col("node").alias("up"), F.col("low").alias("far_low"), F.col("up").alias("far"))
        jump, k = cut(jump.join(far, "up", "left").select("node", F.least("low", "far_low").alias("low"), F.col("far").alias("up"))), k + 1
    heads = jump.where("up is not null and node = low").select("node", F.lit(True).alias("head"))
    return all_up.join(heads, "node", "left").select("node", F.when(F.col("head").isNull(), F.col("parent")).alias("parent"))


def _doubled(tree: DataFrame, start: dict, step) -> DataFrame:
    """Pointer doubling over (node, parent) without cycles: ``step(state, jump)`` gets the state and each node's pointer ``up`` of this round, and
    returns the new state; rows stay one a node, rounds grow with the logarithm of the depth."""
    jump = cut(tree.select("node", F.col("parent").alias("up")))
    state = cut(tree.select("node", *[v.alias(k) for k, v in start.items()]))
    while not jump.where("up is not null").isEmpty():
        state = cut(step(state, jump))
        far = jump.select(F.col("node").alias("up"), F.col("up").alias("far"))
        jump = cut(jump.join(far, "up", "left").select("node", F.col("far").alias("up")))
    return state


def forest_sums(edges: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """(node, own_<c>, cumulative_<c>, depth, nodes) over (node, parent) for the ``columns`` of ``values`` (node, ...): own values, sums over the
    subtree, depth and size of the subtree. No limit on depth; a cycle is cut below its smallest node."""
    tree = pointers(edges).join(values, "node", "left").withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})

    def step(state: DataFrame, jump: DataFrame) -> DataFrame:
        # descendants nearer than 2^k are summed already; those of nodes exactly 2^k below come on top
        more = [F.sum(f"cumulative_{c}").alias(f"more_{c}") for c in columns]
        moved = state.join(jump, "node").where("up is not null").groupBy(F.col("up").alias("node")).agg(*more, F.sum("nodes").alias("more_nodes"))
        above = jump.where("up is not null").join(state.select(F.col("node").alias("up"), F.col("depth").alias("rest")), "up").select("node", "rest")
        out = state.join(moved, "node", "left").join(above, "node", "left")
        sums = [(F.col(f"cumulative_{c}") + F.coalesce(f"more_{c}", F.lit(0.0))).alias(f"cumulative_{c}") for c in columns]
        return out.select("node", *[f"own_{c}" for c in columns], *sums, (F.col("nodes") + F.coalesce("more_nodes", F.lit(0))).alias("nodes"), (F.col("depth") + F.coalesce("rest", F.lit(0))).alias("depth"))

    start = {**{f"own_{c}": F.col(c) for c in columns}, **{f"cumulative_{c}": F.col(c) for c in columns}, "nodes": F.lit(1).cast("long"), "depth": F.col("parent").isNotNull().cast("int")}
    return _doubled(tree, start, step)


def forest_costs(edges: DataFrame, costs: DataFrame) -> DataFrame:
    """(node, own, cumulative, depth, nodes) for the column ``cost`` of ``costs``."""
    return forest_sums(edges, costs, ["cost"]).select("node", F.col("own_cost").alias("own"), F.col("cumulative_cost").alias("cumulative"), "depth", "nodes")


def descendants(edges: DataFrame, root: str) -> DataFrame:
    """The tree of sessions or agents under ``root``, with depth; a level a round, each node once."""
    down = edges.where("parent is not null and node != parent").select("node", "parent").distinct()
    found = level = cut(edges.sparkSession.createDataFrame([(root, 0)], "node string, depth int"))
    while not level.isEmpty():
        below = down.join(level.select(F.col("node").alias("parent"), "depth"), "parent").select("node", (F.col("depth") + 1).alias("depth")).distinct()
        level = cut(below.join(found, "node", "left_anti"))
        found = found.union(level)
    return found


def connected(edges: DataFrame, start: str) -> DataFrame:
    """All nodes that undirected edges (a, b) join to ``start``; a round looks only from the nodes that are new."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = news = cut(edges.sparkSession.createDataFrame([(start,)], "node string"))
    while not news.isEmpty():
        near = both.join(news.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node")).distinct()
        news = cut(near.join(seen, "node", "left_anti"))
        seen = seen.union(news)
    return seen


def inferences(rows: DataFrame) -> DataFrame:
    """API calls from log rows: by request, else message, else the row itself; usage summed, times spanned."""
    key = F.coalesce("request_id", "message_id", F.concat(F.lit("row:"), F.col("row_id").cast("string")))
    grouped = rows.groupBy("session_id", key.alias("inference_id"))
    return grouped.agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.countDistinct("tool_name").alias("tools"), F.max_by("kind", "row_id").alias("kind"))


def spans(turns: DataFrame) -> DataFrame:
    """Span rows of each turn: the turn, its inference, its tool call; an error below shows above."""
    name = lambda level: F.concat_ws("/", "message_id", F.lit(level)) if level else F.col("message_id")
    failed = F.col("is_error") == 1
    root = F.when(F.col("stop_reason") == "refusal", "error").when(F.col("stop_reason") == "max_tokens", "truncated").when(failed, "error").otherwise("ok")
    levels = [(None, None, "turn", root), ("i", None, "inference", F.when(failed, "error").otherwise("ok")), ("i/t", "i", "tool_use", F.when(failed, "error").otherwise("ok"))]
    parts = [turns.select("session_id", name(own).alias("span"), (name(up) if depth else F.lit(None).cast("string")).alias("parent"), F.lit(kind).alias("kind"), F.lit(depth).alias("depth"), state.alias("status"), F.when(F.lit(kind) == "turn", F.col("cost")).otherwise(0.0).alias("cost")) for depth, (own, up, kind, state) in enumerate(levels)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def flow_graph(turns: DataFrame, per_turn: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with places: a column a turn 96 apart, a row a node 32 apart; edges stay within a turn."""
    at = F.posexplode(F.array(F.lit("inference"), F.col("tool_name")))
    nodes = turns.select("session_id", "message_id", "turn_index", at.alias("row", "label"))
    nodes = nodes.select("session_id", F.concat_ws(":", "message_id", "row").alias("node"), "message_id", "row", "label", (F.col("turn_index") * 96).alias("x"), (F.col("row") * 32).alias("y"))
    edges = nodes.where("row > 0").select("session_id", F.concat_ws(":", "message_id", F.col("row") - 1).alias("source"), F.col("node").alias("target"))
    return nodes.drop("message_id", "row"), edges


def mermaid(nodes: list[tuple[str, str]], edges: list[tuple[str, str]]) -> str:
    """A flowchart of collected nodes (id, label) and edges."""
    name = {n: f"n{i}" for i, (n, _) in enumerate(nodes)}
    quote = lambda s: s.replace('"', "#quot;")
    return "\n".join(["flowchart LR", *[f'  {name[n]}["{quote(t)}"]' for n, t in nodes], *[f"  {name[a]} --> {name[b]}" for a, b in edges]]) + "\n"


def svg(nodes: list[tuple[str, str, int, int]], edges: list[tuple[str, str]]) -> str:
    """The same as a drawing of nodes (id, label, x, y)."""
    from xml.sax.saxutils import escape

    place = {n: (x, y) for n, _, x, y in nodes}
    w, h = max([x for _, _, x, _ in nodes], default=0) + 120, max([y for _, _, _, y in nodes], default=0) + 60
    lines = [f'<line x1="{place[a][0] + 40}" y1="{place[a][1] + 20}" x2="{place[b][0] + 40}" y2="{place[b][1] + 20}" stroke="black"/>' for a, b in edges]
    boxes = [f'<g><rect x="{x}" y="{y}" width="80" height="24" fill="none" stroke="black"/><text x="{x + 4}" y="{y + 16}">{escape(t)}</text></g>' for _, t, x, y in nodes]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}">' + "".join(lines + boxes) + "</svg>"
