"""Content gaps over batches: flagged once, healed once, never flagged again."""

from ledgerloom.streaming import gaps
from ledgerloom.streaming.rollouts import STATE_STORE


def test_gap_same_gap_healed(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, STATE_STORE)
    schema, seen = "source string, session_id string, kind string", []

    def run(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = gaps.content_gaps(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))

        def take(batch, number):
            seen.append((sorted(map(tuple, batch.collect())), [r["warning"] for r in gaps.warnings(batch).collect()]))
            batch.write.mode("append").parquet(str(tmp_path / "out"))

        seen.clear()
        stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(x for e, _ in seen for x in e), [w for _, ws in seen for w in ws]

    try:
        call, result = ("c", "s", "tool_use"), ("c", "s", "tool_result")
        assert run(call, call, ("c", "fine", "tool_use"), ("c", "fine", "tool_result"), ("x", "s", "text")) == ([("c", "s", "gap", 2)], ["c: 2 tool calls of 1 sessions have no captured result"])
        assert run(call) == ([], [])
        assert [tuple(r) for r in gaps.affected(spark.read.parquet(str(tmp_path / "out"))).collect()] == [("c", "s", 2)]
        assert run(result, ("x", "t", "tool_use")) == ([("c", "s", "healed", 0), ("x", "t", "gap", 1)], ["x: 1 tool calls of 1 sessions have no captured result"])
        assert run(call, ("c", "fine", "tool_use")) == ([], [])
        assert [tuple(r) for r in gaps.affected(spark.read.parquet(str(tmp_path / "out"))).collect()] == [("x", "t", 1)]
    finally:
        spark.conf.unset(key)
