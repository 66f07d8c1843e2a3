"""Chat formatting into prefix trees.

Conversations that begin with the same turns share them: a node is one turn after one exact history, a tree is all nodes
under one first turn. Trees are laid out depth-first, each node's tokens once. A node carries its tokens, their place in
the tree's sequence, their position ids (counted along the path from the first turn) and the intervals of the
sequence that its ancestors fill: with the tokens of the node up to itself, that is what a token attends to.

Template: ``<s>[INST] text [/INST]`` for a user, `` text </s>`` for an assistant, ``<<role>>\\ntext\\n<</>>`` for any other
role. A control string inside a text or role gets one backslash after its first character (one more if it has some), which
reading back removes. Tokens are those of the byte-level BPE, of the marks before a text, the text, and the marks after it each on their
own; so the loss mask (a span of a node's tokens) covers an assistant's text exactly, and decoding gives the formatted turn exactly.

Reading back uses nothing but the trees: a conversation is the tokens of the intervals that its last turn's node attends to, then
that node's own.

Depth-first order needs the order of whole conversations only: their distinct paths of node names, one row a conversation, are ordered by ranges, and a node belongs to the first path
that has it. A path's own nodes follow each other, so nodes are placed by running sums in that order, and a node's ancestors are what stands before it in its path. So all shuffled rows are
in proportion to the turns; only the intervals in the result, one for each ancestor as asked for, grow with the square of a conversation's length. They are made in the last step, some at a
time. Nodes are merged by partial aggregation, equal conversations too, so a first turn or a conversation that a third of all rows share costs no single task more than its
share. A conversation itself is one row.

Results for special input: a null text or role counts as empty; turns with equal numbers are ordered by role and text, null
turn numbers come first; repeated rows are repeated turns; a null conv_id is a conversation of its own; an empty table
gives no nodes; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.byte_bpe import tokenizer, vocabulary
from ledgerloom.llm.textkit import tidy, workspace, written

# The template's control strings, with the backslashes that escaping puts after their first character.
_CONTROLS = re.compile(r"(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\])|(<)(\\*)(<)|(>)(\\*)(>)")


def escape(text: str) -> str:
    """Reversible: no control string is left in the result."""
    return _sub(text, "\\")


def _sub(text: str, more: str) -> str:
    out, at = [], 0
    # the last character may begin the next control string, so scanning goes on at it
    while m := _CONTROLS.search(text, at):
        first, slashes, rest = (g for g in m.groups() if g is not None)
        inner = more + slashes if more else slashes[1:]
        out += [text[at : m.start()], first, inner, rest[:-1]]
        at = m.end() - 1
    return "".join([*out, text[at:]])


def unescape(text: str) -> str:
    """Inverse of ``escape``."""
    return _sub(text, "")


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the span of its text in it."""
    body = escape(text)
    head, tail = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")}.get(role, (f"<<{escape(role)}>>\n", "\n<</>>"))
    return head + body + tail, len(head), len(head) + len(body)


_MARKS = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]|<<(?P<role>.*?)>>\n(?P<other>.*?)\n<</>>| (?P<assistant>.*?) </s>", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _MARKS.match(formatted, at)
        if m is None:
            raise ValueError("not a formatted conversation")
        if m["user"] is not None:
            out.append(("user", unescape(m["user"])))
        elif m["assistant"] is not None:
            out.append(("assistant", unescape(m["assistant"])))
        else:
            out.append((unescape(m["role"]), unescape(m["other"])))
        at = m.end()
    return out


def _encode_nodes(path: str, pattern: str):
    def run(batches):
        for batch in batches:
            bpe = tokenizer(path, pattern)
            key, role, text = (batch.column(i).to_pylist() for i in (0, 1, 2))
            ids, spans = [], []
            for r, t in zip(role, text, strict=True):
                whole, start, end = format_turn(r, t)
                parts = [bpe.encode(x) for x in (whole[:start], whole[start:end], whole[end:])]
                ids.append(np.concatenate(parts))
                first = len(parts[0])
                spans.append({"start": first, "end": first + len(parts[1])} if r == "assistant" else None)
            offs = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offs[1:])
            lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            span = pa.array(spans, pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), batch.column(1), batch.column(3), batch.column(4), lists, pa.array(np.diff(offs).astype(np.int64)), span], names=["node", "role", "rank", "k", "ids", "n_tokens", "loss"])

    return run


def build_trees(df: DataFrame, tokenizer_path: str, pattern: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves). Nodes: (tree, node, depth, role, ids, seq_start, position_ids, attends, loss), the latter the span of a
    node's tokens that count for the loss (null: none); leaves: (conv_id, node), the node of each conversation's last turn."""
    spark = df.sparkSession
    folder = folder or workspace(spark)
    turns = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    placed = turns.withColumn("k", F.row_number().over(order))
    # a node is named by sums of hashes of (place, role, text) along its history
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashes = [F.xxhash64("k", "role", "text"), F.xxhash64("text", F.lit(7), "role", "k")]
    name = F.md5(F.concat_ws("/", *[F.sum(h.cast("decimal(20,0)")).over(so_far).cast("string") for h in hashes], F.col("k").cast("string")))
    named = written(placed.withColumn("node", name), folder, "turns")
    leaves = named.groupBy("conv_id").agg(F.max_by("node", "k").alias("node"))

    # distinct paths in order; a node belongs to the first path that has it
    path = F.transform(F.array_sort(F.collect_list(F.struct("k", "node"))), lambda x: x["node"])
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    paths = named.groupBy("conv_id").agg(path.alias("path")).select("path").distinct()
    paths = written(paths.repartitionByRange(parts, "path").sortWithinPartitions("path").withColumn("rank", F.monotonically_increasing_id()), folder, "paths")
    steps = paths.select("rank", F.posexplode("path").alias("k", "node"))
    owners = steps.groupBy("node").agg(F.min("rank").alias("rank"), F.first("k").alias("k"))
    merged = named.groupBy("node").agg(F.first("role").alias("role"), F.first("text").alias("text")).join(owners, "node")
    encoded = merged.select("node", "role", "text", "rank", "k").mapInArrow(tidy(_encode_nodes(tokenizer_path, pattern)), "node string, role string, rank long, k int, ids array<int>, n_tokens long, loss struct<start: int, end: int>")
    nodes = written(encoded, folder, "nodes")

    # a running sum in each range of paths, and over the ranges' totals
    ranged = nodes.select("node", "rank", "k", "n_tokens", F.shiftright("rank", 33).alias("part"))
    before = Window.partitionBy("part").orderBy("rank", "k").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    bases = bases.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # one row a range
    starts = ranged.withColumn("local", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).join(F.broadcast(bases), "part").select("node", (F.col("base") + F.col("local")).alias("start"))

    known = nodes.drop("k").withColumnRenamed("rank", "owner").join(starts, "node")
    own = F.col("owner") == F.col("rank")
    line = F.struct("k", "node", "start", "n_tokens", own.alias("own"), F.when(own, F.col("role")).alias("role"), F.when(own, F.col("ids")).alias("ids"), F.when(own, F.col("loss")).alias("loss"))
    lines = steps.join(known, "node").groupBy("rank").agg(F.array_sort(F.collect_list(line)).alias("line"))
    return written(lines.select("line").mapInArrow(tidy(_lay_out), TREE), folder, "trees"), leaves


TREE = "tree string, node string, depth int, role string, ids array<int>, seq_start long, position_ids array<long>, attends array<struct<start: long, end: long>>, loss struct<start: int, end: int>"
#: Intervals that are made at a time, about.
INTERVALS = 1 << 19


def _ranges(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each begin on, one list after the other, and where each list starts (lists + 1)."""
    offs = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=offs[1:])
    return np.arange(offs[-1]) + np.repeat(begin - offs[:-1], count), offs


def _lay_out(batches):
    """The own nodes of each path (a list of structs in order), with places, position ids and the intervals of their ancestors."""
    for batch in batches:
        lists = batch.column(0)
        sizes = np.array(lists.value_lengths(), np.int64)
        cost = np.cumsum(sizes * sizes)
        at = 0
        while at < len(sizes):
            to = max(int(np.searchsorted(cost, (cost[at - 1] if at else 0) + INTERVALS, "right")), at + 1)
            yield _placed(lists.slice(at, to - at).flatten(), sizes[at:to])
            at = to


def _placed(flat: pa.StructArray, sizes: np.ndarray) -> pa.RecordBatch:
    field = lambda name: flat.field(name)
    start, tokens, own = (field(n).to_numpy(zero_copy_only=False) for n in ("start", "n_tokens", "own"))
    head = np.repeat(np.cumsum(sizes) - sizes, sizes)  # of each turn the first one of its path
    so_far = np.concatenate(([0], np.cumsum(tokens)))
    mine = np.flatnonzero(own)
    first, depth = head[mine], mine - head[mine]
    above, cuts = _ranges(first, depth)
    origin = np.repeat(start[first], depth)
    spans = pa.StructArray.from_arrays([pa.array(start[above] - origin), pa.array(start[above] - origin + tokens[above])], names=["start", "end"])
    positions, ends = _ranges(so_far[mine] - so_far[first], tokens[mine])
    pick = pa.array(mine)
    columns = {
        "tree": field("node").take(pa.array(first)), "node": field("node").take(pick), "depth": pa.array(depth.astype(np.int32)), "role": field("role").take(pick), "ids": field("ids").take(pick), "seq_start": pa.array(start[mine] - start[first]),
        "position_ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(positions)), "attends": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), spans), "loss": field("loss").take(pick),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def read_back(nodes: DataFrame, leaves: DataFrame, tokenizer_path: str) -> DataFrame:
    """(conv_id, turns, formatted_chars, loss_text) of every conversation, from the trees' tokens: the turns (role, text) are
    parsed from the decoded whole, the loss text is what decodes from under the mask, unescaped."""
    last = leaves.join(nodes.select("node", "tree", "seq_start", "attends"), "node")
    starts = F.concat(F.transform("attends", lambda x: x["start"]), F.array("seq_start"))
    lines = last.select("conv_id", "tree", F.posexplode(starts).alias("k", "seq_start")).join(nodes.select("tree", "seq_start", "ids", "loss"), ["tree", "seq_start"])
    whole = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "ids", "loss"))).alias("nodes"))
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches):
        for batch in batches:
            words, texts, turns, losses = vocabulary(tokenizer_path), [], [], []
            for line in batch.column(1).to_pylist():
                texts.append(words.decode([i for n in line for i in n["ids"]]).decode())
                turns.append([{"role": r, "text": t} for r, t in parse(texts[-1])])
                losses.append("".join(unescape(words.decode(n["ids"][n["loss"]["start"] : n["loss"]["end"]]).decode()) for n in line if n["loss"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(turns, kind), pa.array([len(s) for s in texts], pa.int64()), pa.array(losses, pa.string())], names=["conv_id", "turns", "formatted_chars", "loss_text"])

    id_type = leaves.schema["conv_id"].dataType.simpleString()
    return whole.select("conv_id", "nodes").mapInArrow(tidy(run), f"conv_id {id_type}, turns array<struct<role: string, text: string>>, formatted_chars long, loss_text string")
