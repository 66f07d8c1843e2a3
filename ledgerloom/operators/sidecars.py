"""Logs of subagents beside a session's log, manifests of sessions about to start, and command triads."""

from __future__ import annotations

import json
import os
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MANIFEST_SECONDS = 24 * 3600


def pair_sidecars(sidecars: DataFrame, calls: DataFrame) -> DataFrame:
    """Sidecars (file, session_id, agent_id, meta_tool_use_id) with the tool call that started them: by the agent id in its
    result, else by the id in the sidecar's metadata if such a call exists. Calls: (session_id, tool_use_id, agent_id)."""
    by_agent = calls.where("agent_id is not null").groupBy("session_id", "agent_id").agg(F.min("tool_use_id").alias("by_agent"))
    by_meta = calls.select("session_id", F.col("tool_use_id").alias("meta_tool_use_id"), F.col("tool_use_id").alias("by_meta")).distinct()
    out = sidecars.join(by_agent, ["session_id", "agent_id"], "left").join(by_meta, ["session_id", "meta_tool_use_id"], "left")
    return out.withColumn("tool_use_id", F.coalesce("by_agent", "by_meta")).drop("by_agent", "by_meta")


def count_sidecars(paired: DataFrame) -> DataFrame:
    return paired.agg(F.count_if(F.col("tool_use_id").isNotNull()).alias("paired"), F.count_if(F.col("tool_use_id").isNull()).alias("orphans"))


def compacted_between(turns: DataFrame, compactions: DataFrame) -> DataFrame:
    """Turns before which, since the turn before them, the context was compacted."""
    order = Window.partitionBy("session_id").orderBy("turn_index")
    spans = turns.withColumn("previous", F.lag("ts").over(order)).where("previous is not null")
    c = compactions.select(F.col("session_id").alias("c_session"), F.col("ts").alias("c_ts"))
    return spans.join(c, (F.col("session_id") == F.col("c_session")) & F.col("c_ts").between(F.col("previous"), F.col("ts")), "left_semi").drop("previous")


def command_triads(rows: DataFrame) -> DataFrame:
    """Slash commands: a caveat row, the command under it, and its output under that, each later than its parent; of several
    children the first counts (rows: uuid, parent, line, kind)."""
    def children(kind: str, name: str) -> DataFrame:
        first = Window.partitionBy("parent").orderBy("line")
        own = rows.where(F.col("kind") == kind).withColumn("r", F.row_number().over(first)).where("r = 1")
        return own.select(F.col("parent").alias(f"{name}_parent"), F.col("uuid").alias(name), F.col("line").alias(f"{name}_line"))

    caveats = rows.where("kind = 'caveat'").select(F.col("uuid").alias("caveat"), F.col("line").alias("caveat_line"))
    out = caveats.join(children("command", "command"), (F.col("caveat") == F.col("command_parent")) & (F.col("command_line") > F.col("caveat_line")))
    out = out.join(children("stdout", "stdout"), (F.col("command") == F.col("stdout_parent")) & (F.col("stdout_line") > F.col("command_line")))
    return out.select("caveat", "command", "stdout")


def write_manifest(folder: str, harness: str, cwd: str, enrichment: dict[str, str], started: float | None = None) -> str:
    """A stamp for a session that is about to start, written whole or not at all."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    path = Path(folder, f"{uuid.uuid4().hex}.json")
    part = path.with_suffix(".tmp")
    part.write_text(json.dumps({"v": 1, "harness": harness, "cwd": os.path.realpath(cwd), "spawnStartTs": started or time.time(), "enrichment": enrichment}))
    part.rename(path)
    return str(path)


def claim_manifest(folder: str, harness: str, cwd: str, modified: float) -> dict | None:
    """The oldest manifest that fits a session file of ``harness`` in ``cwd`` changed at ``modified``; it is taken once."""
    found = sorted((json.loads(p.read_text())["spawnStartTs"], p) for p in Path(folder).glob("*.json"))
    for started, path in found:
        m = json.loads(path.read_text())
        if m["harness"] == harness and m["cwd"] == os.path.realpath(cwd) and modified >= started - 0.001:
            claimed = path.with_suffix(".claimed")
            try:
                path.rename(claimed)
            except OSError:
                continue
            return m
    return None


def drop_old_manifests(folder: str, now: float | None = None) -> int:
    old = [p for p in Path(folder).glob("*.json") if (now or time.time()) - p.stat().st_mtime > MANIFEST_SECONDS]
    for p in old:
        p.unlink()
    return len(old)
