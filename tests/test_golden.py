"""A ledger of seven turns whose reports are known to the digit."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import cost
from ledgerloom.operators import attribution, rollups, series, spans


@pytest.fixture(scope="module")
def ledger(spark):
    turns = [
        ("1", 0, "claude-code", "claude-sonnet-4-6", 1500, 220, 0, 5000, 0, "coding"), ("1", 1, "claude-code", "claude-sonnet-4-6", 1800, 350, 0, 6000, 200, "coding"), ("1", 2, "claude-code", "claude-sonnet-4-6", 1200, 180, 0, 7000, 0, "testing"),
        ("2", 0, "claude-code", "claude-haiku-4-5", 900, 120, 0, 2000, 0, "coding"), ("2", 1, "claude-code", "claude-haiku-4-5", 800, 100, 0, 2500, 0, "review"),
        ("3", 0, "codex", "gpt-5-codex", 2000, 400, 350, 0, 0, "coding"), ("4", 0, "opencode", "claude-sonnet-4-6", 600, 80, 0, 1500, 0, "delegation"),
    ]
    calls = [("1", 0, "a", "Read", "foo.ts", 1000), ("1", 1, "b", "Edit", "foo.ts", 200), ("1", 2, "c", "Bash", "npm test", None), ("2", 0, "d", "Edit", "bar.ts", None), ("2", 1, "e", "Read", "bar.ts", None), ("3", 0, "f", "Bash", "cargo build", None), ("4", 0, "g", "Task", "review the foo module", None)]
    t = spark.createDataFrame(turns, "session_id string, turn_index long, source string, model string, input_tokens long, output_tokens long, reasoning_tokens long, cache_read long, cache_create_5m long, activity string")
    t = t.withColumns({"cache_create_1h": F.lit(0).cast("long"), "message_id": F.concat_ws("-", "session_id", "turn_index"), "agent_id": F.lit(None).cast("string")})
    c = spark.createDataFrame(calls, "session_id string, turn_index long, tool_use_id string, tool_name string, target string, size long").withColumn("args_hash", F.concat_ws("|", "tool_name", "target"))
    return cost.with_cost(t, cost.default_rates(spark)), c.withColumns({"call_index": F.lit(0), "message_id": F.concat_ws("-", "session_id", "turn_index")})


def test_summary(ledger):
    got = {r["model"]: round(r["cost"], 9) for r in rollups.by_model(ledger[0]).collect()}
    assert got == {"claude-sonnet-4-6": 0.03435, "claude-haiku-4-5": 0.00325, "gpt-5-codex": 0.0}


def test_hotspots(ledger):
    t, c = ledger
    spots = attribution.hotspots(c, t).where("session_id != '3'")
    by_session = {r["session_id"]: (r["method"], round(r["c"], 9)) for r in spots.groupBy("session_id", "method").agg(F.sum("total_cost").alias("c")).collect()}
    assert by_session == {"1": ("sized", 0.003975), "2": ("even-split", 0.0008), "4": ("even-split", 0.0)}
    total = attribution.session_totals(spots, t.where("session_id != '3'")).agg(F.round(F.sum("attributed"), 9), F.round(F.sum("unattributed"), 9)).first()
    assert tuple(total) == (0.004775, 0.032825)
    files = {r["target"]: (round(r["initial_tokens"]), round(r["riding_tokens"])) for r in attribution.by_file(spots).collect()}
    assert files == {"foo.ts": (1200, 1000), "bar.ts": (800, 0)}


def test_hotspots_of_unpriced_turns_and_siblings(spark):
    """A turn without a rate charges neither tokens nor cost; results of one turn share what the next one takes in."""
    rows = [("s", 0, "claude-sonnet-4-6", 100, 0), ("s", 1, "mystery", 100, 5000), ("s", 2, "claude-sonnet-4-6", 90, 600), ("s", 3, "claude-sonnet-4-6", 10, 600)]
    t = spark.createDataFrame(rows, "session_id string, turn_index long, model string, input_tokens long, cache_read long").withColumns({"source": F.lit("claude-code"), **{x: F.lit(0).cast("long") for x in ("output_tokens", "reasoning_tokens", "cache_create_5m", "cache_create_1h")}})
    calls = [("s", 0, "a", 50), ("s", 1, "b", 100), ("s", 1, "c", 200), ("s", 1, "d", 900)]
    c = spark.createDataFrame(calls, "session_id string, turn_index long, tool_use_id string, size long").withColumns({"tool_name": F.lit("Read"), "target": F.lit("f"), "args_hash": F.lit("h")})
    got = {r["tool_use_id"]: (round(r["initial_tokens"], 6), round(r["riding_tokens"], 6), r["riding_turns"]) for r in attribution.hotspots(c, cost.with_cost(t, cost.default_rates(spark))).collect()}
    # a: its paying turn has no rate, then it rides twice; b, c, d share 90 tokens by size; d is larger than any cache read
    assert got == {"a": (0.0, 100.0, 2), "b": (7.5, 100.0, 1), "c": (15.0, 200.0, 1), "d": (67.5, 0.0, 0)}


def test_compare(ledger):
    got = {(r["model"], r["activity"]): r for r in series.compare(ledger[0], ["claude-sonnet-4-6", "claude-haiku-4-5"]).collect()}
    one = lambda m: (round(got[m, "coding"]["cost_per_turn"], 6), round(got[m, "coding"]["cache_hit"], 4))
    assert one("claude-sonnet-4-6") == (0.01125, 0.7586) and one("claude-haiku-4-5") == (0.0017, 0.6897)


def test_context_growth(ledger):
    got = [(r["delta"], round(r["usd"], 9)) for r in spans.context_deltas(ledger[0], 5).collect()]
    assert got == [(1500, 0.00045), (400, 0.00004), (200, 0.00006)]


def test_flow(ledger):
    t, c = (x.where("session_id = '1'") for x in ledger)
    nodes, edges = spans.flow(t, c)
    assert nodes.count() == 6 and edges.count() == 3
