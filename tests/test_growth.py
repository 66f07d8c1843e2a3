"""Growth of contexts: steps in their gaps, compactions, rails and thresholds on a small session."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import growth

AT = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)


@pytest.fixture(scope="module")
def session(spark):
    inferences = [("s", "main", 10, "t1", AT(0), AT(1), 5000, 0.3), ("s", "main", 20, "t1", AT(2), AT(3), 9000, 0.3), ("s", "kid", 15, "t1", AT(1), AT(2), 100, None), ("s", "kid", 16, "t1", AT(2), AT(2), 3100, None), ("s", "main", 30, "t2", AT(10), AT(11), 4000, 0.3), ("s", "main", 40, "t3", AT(12), AT(13), 3500, 0.3), ("s", "main", 50, "t4", AT(14), AT(15), 4400, 0.3)]
    results = [("s", "main", 11, "u1", "Read", 4001, True), ("s", "main", 12, "u2", "Bash", 80, None), ("s", "kid", 15, "u3", "Grep", 40, False), ("s", "main", 5, "early", "Read", 999, False)]
    prompts = [("s", "main", 25, "<system-reminder>abcd efgh</system-reminder>go on")]
    frame = lambda rows, kinds: spark.createDataFrame(rows, f"session_id string, rail string, place int, {kinds}")
    steps = growth.result_steps(frame(results, "tool_use_id string, tool_name string, bytes long, truncated boolean")).unionByName(growth.prompt_steps(frame(prompts, "text string")))
    cuts = spark.createDataFrame([("s", AT(7)), ("s", AT(30)), ("other", AT(12))], "session_id string, ts timestamp")
    return frame(inferences, "turn_id string, start_ts timestamp, end_ts timestamp, context long, cache_read_rate double"), steps, cuts


def told(df):
    return [(r["rail"], r["turn_id"], r["inference_idx"], r["delta"], [(s["kind"], s["name"], s["tokens"], s["truncated"]) for s in r["steps"]], round(r["usd"], 8)) for r in df.collect()]


def test_steps_and_compaction(session):
    got = told(growth.rail_growth(*session))
    assert got == [
        ("main", "t1", 2, 4000, [("tool-result", "Read", 1000, True), ("tool-result", "Bash", 20, False)], 0.0012),
        ("kid", "t1", 2, 3000, [("tool-result", "Grep", 10, False)], 0.0),
        ("main", "t2", 3, 0, [("user-prompt", "with reminder", 2, False), ("system-reminder", None, 3, False), ("compaction", None, 5000, False)], 0.0),
    ]


def test_rails_thresholds_and_top(session):
    assert [r[0] for r in told(growth.rail_growth(*session, rail="main"))] == ["main", "main"] and [r[0] for r in told(growth.rail_growth(*session, rail="subagent"))] == ["kid"]
    assert len(told(growth.rail_growth(*session, top=1))) == 1
    low = {(r[1], r[2]): r[3] for r in told(growth.rail_growth(*session, least=-10000, rail="main"))}
    assert low == {("t1", 2): 4000, ("t2", 3): 0, ("t3", 4): -500, ("t4", 5): 900}  # shrinking without a compaction stays as it is
    drivers = growth.rail_growth(*session).select(F.transform("steps", growth.driver).alias("d")).collect()
    assert drivers[0]["d"] == ["Read result", "Bash result"] and drivers[2]["d"] == ["user prompt", "system reminder", "compaction -5000 tok"]


def test_nothing(session):
    inferences, steps, cuts = session
    assert growth.rail_growth(inferences.where("false"), steps, cuts).count() == 0
