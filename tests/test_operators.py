"""Small fixtures whose results are plain to see."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import cost, provider, text, times
from ledgerloom.operators import joins, search, sequences, series, trees


def test_cost_of_known_turns(spark):
    """Seven turns of a small ledger: 0.0376 in all, one of them unpriced."""
    rows = [
        ("claude-code", "claude-sonnet-4-6", 1500, 220, 0, 5000, 0), ("claude-code", "claude-sonnet-4-6", 1800, 350, 0, 6000, 200), ("claude-code", "claude-sonnet-4-6", 1200, 180, 0, 7000, 0),
        ("claude-code", "claude-haiku-4-5", 900, 120, 0, 2000, 0), ("claude-code", "claude-haiku-4-5", 800, 100, 0, 2500, 0), ("codex", "gpt-5-codex", 2000, 400, 350, 0, 0), ("opencode", "claude-sonnet-4-6", 600, 80, 0, 1500, 0),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "source string, model string, input_tokens long, output_tokens long, reasoning_tokens long, cache_read long, cache_create_5m long, cache_create_1h long")
    out = cost.with_cost(df, cost.default_rates(spark)).agg(F.round(F.sum("cost"), 9), F.round(F.sum("cost_input"), 9), F.round(F.sum("cost_cache_create"), 9), F.count_if(~F.col("priced"))).first()
    assert tuple(out) == (0.0376, 0.017, 0.00075, 1)


def test_tiers_take_the_highest_limit_passed(spark):
    tiers = [(100, 10.0, None, None, None, None), (1000, 20.0, None, None, None, None)]
    rates = spark.createDataFrame([("m", 1.0, 2.0, 0.0, 1.0, None, "same-as-output", tiers)], cost.RATE_SCHEMA)
    df = spark.createDataFrame([(100,), (101,), (5000,)], "input_tokens long").withColumns({"source": F.lit("x"), "model": F.lit("m"), **{c: F.lit(0) for c in cost.USAGE[1:]}})
    got = [round(r["cost_input"] * 1e6) for r in cost.with_cost(df, rates).orderBy("input_tokens").collect()]
    assert got == [100, 1010, 100000]


def test_providers_and_routes(spark):
    names = ["hf:acme/llama", "synthetic/x", "accounts/fireworks/models/y", "OpenRouter/z", "plain", "/odd"]
    df = spark.createDataFrame([(n, "codex") for n in names], "model string, source string")
    got = [tuple(r) for r in df.select(provider.provider(F.col("model"), F.col("source")), provider.routed_model(F.col("model"))).collect()]
    assert got == [("synthetic", "llama"), ("synthetic", "x"), ("synthetic", "y"), ("openrouter", None), ("openai", None), ("openai", None)]


def test_text_scalars(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]
    assert one(text.tool_name, "exec_command") == "Bash" and one(text.tool_name, "Own") == "Own"
    assert one(text.status, "FAILED") == "errored" and one(text.stop_reason, "new_kind") == "silent" and one(text.stop_reason, None) is None
    assert tuple(one(text.mcp_parts, "mcp__srv__do__it")) == ("srv", "do__it")
    assert one(text.error_signature, "\n  \n  boom \nrest") == "boom"
    assert one(text.stripped_assignments, "A=1 B=2 make all") == "make all"
    assert one(text.resume_target, "/resume abc-1") == "abc-1" and one(text.resume_target, "hi") is None
    for url in ("git@GitHub.com:a/b.git", "https://github.com/a/b", "ssh://git@github.com/a/b.git/"):
        assert one(text.git_project_key, url) == "github.com/a/b"


def test_times():
    now = datetime(2024, 3, 1, tzinfo=timezone.utc)
    assert times.since("2m", now) == datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert times.bucket_seconds("5m") == 300
    for bad in ("5x", "0m"):
        with pytest.raises(ValueError):
            times.bucket_seconds(bad)
    assert times.retention("forever") is None and times.retention(-1) is None and times.retention(90) == 90


def test_edit_revert_resets_history(spark):
    edits = spark.createDataFrame([("s", "f", 0, "a", "b"), ("s", "f", 1, "b", "a"), ("s", "f", 2, "x", "a"), ("s", "f", 3, "a", "x")], "session_id string, target string, turn_index long, pre string, post string")
    assert [r["turn_index"] for r in sequences.edit_reverts(edits).orderBy("turn_index").collect()] == [1, 3]


def test_forest_and_cycles(spark):
    edges = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "node string, parent string")
    costs = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 4.0)], "node string, cost double")
    got = {r["node"]: (r["own"], r["cumulative"], r["depth"]) for r in trees.forest_costs(edges, costs).collect()}
    assert got["a"] == (1.0, 7.0, 0) and got["b"] == (2.0, 6.0, 1) and got["c"] == (4.0, 4.0, 2)
    assert got["x"] == (0.0, 0.0, 0) and got["y"] == (0.0, 0.0, 1)  # the cycle is cut below its smallest node


def test_forest_has_no_depth_limit(spark):
    chain = spark.range(1, 151).select(F.col("id").alias("node"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"))
    got = {r["node"]: tuple(r)[1:] for r in trees.forest_costs(chain, chain.select("node", F.lit(1.0).alias("cost"))).collect()}
    assert got == {i: (1.0, 151.0 - i, i - 1, 151 - i) for i in range(1, 151)}


def test_buckets_keep_empty_ones_and_are_bounded(spark):
    t = spark.createDataFrame([("2024-01-01 00:00:00", "m", 1.0, True), ("2024-01-01 03:00:00", "m", 2.0, True)], "ts string, model string, cost double, priced boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    got = series.summary_series(t, 3600).orderBy("bucket").collect()
    assert [(r["bucket"], r["turns"]) for r in got] == [(0, 1), (1, 0), (2, 0), (3, 1)]
    with pytest.raises(ValueError):
        series.buckets(t, 1)


def test_append_drops_stored_and_repeated(spark):
    old = spark.createDataFrame([(1, "x")], "id int, fp string")
    new = spark.createDataFrame([(1, "z"), (2, "y"), (2, "y"), (3, "x")], "id int, fp string")
    assert [r["id"] for r in joins.new_rows(new, old, ["id"], "fp").collect()] == [2]


def test_search_syntax(spark):
    docs = spark.createDataFrame([(1, "red green blue"), (2, "green red"), (3, "blueish sky"), (4, "")], "doc_id int, text string")
    index = search.build_index(docs)
    find = lambda q: sorted(r["doc_id"] for r in search.search(*index, q).collect())
    assert find("red green") == [1, 2] and find('"red green"') == [1] and find("blue*") == [1, 3] and find("sky OR blue") == [1, 3] and find("...") == []
    assert search.snippet("a red house", "red") == "a <b>red</b> house"


def test_graph_sinks():
    assert "n0 --> n1" in trees.mermaid([("a", "A"), ("b", "B")], [("a", "b")])
    assert trees.svg([("a", "<A>", 0, 0), ("b", "B", 96, 32)], [("a", "b")]).count("<rect") == 2
