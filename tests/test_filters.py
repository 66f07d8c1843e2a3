from datetime import datetime

from pyspark.sql import functions as F

from ledgerloom.operators import filters, sidecars


def test_scan_and_reports(spark):
    t = spark.createDataFrame([("s1", "2024-01-01", "a", "p", None, "full"), ("s2", None, "b", None, "k", None), ("s3", "2024-03-01", "a", "P", "k", "partial")], "session_id string, ts string, source string, project string, project_key string, fidelity string").withColumn("ts", F.col("ts").cast("timestamp"))
    ids = lambda df: sorted(r["session_id"] for r in df.collect())
    assert ids(filters.scan(t, since=datetime(2024, 2, 1))) == ["s2", "s3"] and ids(filters.scan(t, until=datetime(2024, 1, 1), source="a")) == ["s1"]
    assert ids(filters.scan(t, project="k")) == ["s2", "s3"] and ids(filters.matching(t, "P")) == ["s1", "s3"] and ids(filters.scan(t, session="s1")) == ["s1"]
    assert ids(filters.eligible(t, "usage-only")) == ["s1", "s2"] and tuple(filters.excluded(t, "usage-only").first()) == ("a", 1, "partial")
    assert filters.refused(3, 0) and not filters.refused(0, 0)
    assert {r["model"]: r["turns"] for r in filters.models(t.withColumnRenamed("source", "model"), ["a", "z"]).collect()} == {"a": 2, "z": 0}


def test_sidecars_and_triads(spark, tmp_path):
    s = spark.createDataFrame([("f1", "s", "a1", None), ("f2", "s", "a9", "t2"), ("f3", "s", "a9", "gone")], "file string, session_id string, agent_id string, meta_tool_use_id string")
    c = spark.createDataFrame([("s", "t1", "a1"), ("s", "t2", None)], "session_id string, tool_use_id string, agent_id string")
    out = sidecars.pair_sidecars(s, c)
    assert {r["file"]: r["tool_use_id"] for r in out.collect()} == {"f1": "t1", "f2": "t2", "f3": None} and tuple(sidecars.count_sidecars(out).first()) == (2, 1)
    rows = spark.createDataFrame([("u1", None, 1, "caveat"), ("u2", "u1", 2, "command"), ("u3", "u2", 3, "stdout"), ("u4", "u2", 4, "stdout"), ("u5", None, 9, "caveat"), ("u6", "u5", 8, "command")], "uuid string, parent string, line int, kind string")
    assert [tuple(r) for r in sidecars.command_triads(rows).collect()] == [("u1", "u2", "u3")]
    turns = spark.createDataFrame([("s", 0, 10), ("s", 1, 20), ("s", 2, 30)], "session_id string, turn_index int, ts int")
    assert [r["turn_index"] for r in sidecars.compacted_between(turns, spark.createDataFrame([("s", 25)], "session_id string, ts int")).collect()] == [2]
    sidecars.write_manifest(str(tmp_path), "h", str(tmp_path), {"a": "b"}, started=100.0)
    assert sidecars.claim_manifest(str(tmp_path), "h", str(tmp_path), 50.0) is None
    assert sidecars.claim_manifest(str(tmp_path), "h", str(tmp_path), 100.0)["enrichment"] == {"a": "b"} and sidecars.claim_manifest(str(tmp_path), "h", str(tmp_path), 100.0) is None
