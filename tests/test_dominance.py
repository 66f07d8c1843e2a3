"""Dominance sums against all pairs, and riding results of a session of many blocks."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import attribution, dominance


@pytest.mark.parametrize("later", [False, True])
def test_sums_equal_all_pairs(spark, later):
    r = random.Random(3)
    blocks = {"a": 13, "b": 1, "c": 64, "d": 2}
    size = lambda: r.choice([0, 1, 5, 5, 7, 8, 9, 100, 1000, r.randint(0, 5000), 1 << 40])
    rows = [(k, r.randrange(n), size(), float(r.randint(1, 9)), f"{k}{i}") for k, n in blocks.items() for i in range(120)]
    df = spark.createDataFrame(rows, "session_id string, block long, y long, v double, id string")
    df = df.withColumn("places", F.expr("case session_id when 'a' then 4 when 'b' then 0 when 'c' then 6 else 1 end"))
    got = {x["id"]: x["v"] for x in dominance.sums(df, df, ["v"], "id", later=later).collect()}
    fits = lambda p, q: p[0] == q[0] and (p[1] > q[1] and p[2] >= q[2] if later else p[1] < q[1] and p[2] <= q[2])
    want = {q[4]: sum(p[3] for p in rows if fits(p, q)) for q in rows if any(fits(p, q) for p in rows)}
    assert {k: v for k, v in got.items() if v} == want


def test_rides_over_blocks_equal_all_pairs(spark, monkeypatch):
    """Blocks of 8 turns: a session of 200 turns lies in 26 groups, and its results ride as if it were one."""
    monkeypatch.setattr(attribution, "BLOCK", 8)
    r = random.Random(6)
    results, readers = [], []
    for s, n in (("long", 200), ("short", 5), ("edge", 9)):
        for t in range(1, n + 1):
            results += [(s, f"{s}:{t}:{k}", t, r.choice([0, 3, 50, r.randint(1, 400)])) for k in range(r.randint(0, 3))]
            if r.random() < 0.8:
                readers.append((s, t, r.choice([1, 40, r.randint(1, 900)]), r.choice([0.3, 1.5])))
    got = attribution.rides(spark.createDataFrame(results, "session_id string, tool_use_id string, rank long, size long"), spark.createDataFrame(readers, "session_id string, at long, read long, price double"))
    got = {x["tool_use_id"]: (x["riding_tokens"], x["riding_cost"], x["riding_turns"]) for x in got.collect()}
    want = {u: [0.0, 0.0, 0] for s, u, _, size in results if size}
    for s, t, read, price in readers:
        held = [(u, size) for own, u, rank, size in results if own == s and size and rank + 1 < t and size <= read]
        total = sum(size for _, size in held)
        for u, size in held:
            tokens = size * min(read, total) / total
            want[u] = [want[u][0] + tokens, want[u][1] + tokens * price / 1e6, want[u][2] + 1]
    assert {u for u, v in want.items() if v[2]} <= set(got)
    for u, v in want.items():
        assert got.get(u, (0.0, 0.0, 0)) == pytest.approx(tuple(v))
