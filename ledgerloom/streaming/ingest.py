"""Incremental ingest of transcript logs: a stream of files, replays dropped by key, appended to Parquet tables.

The checkpoint holds what was read. ``stream_turns`` takes a file once, so writers move finished files into the folder; ``follow_turns`` reads on in files that grow, up to the
first line of a message that isn't finished. ``once`` drains what is there and stops; else the query keeps watching at an interval. A batch that is retried writes the same folder. Turns lie in
BUCKETS folders by their session's hash, so a batch looks for stored keys only where its own sessions are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ledgerloom.functions import payload
from ledgerloom.sources import readers, records
from ledgerloom.sources.store import Ledger

KEYS = ["source", "session_id", "message_id"]
BUCKETS = 256


def _stored(spark: SparkSession, table: str, schema) -> DataFrame:
    """The rows of a table's batches; none before the first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", table).parquet(f"{table}/batch=*")


def stream_turns(spark: SparkSession, folder: str, table: str, checkpoint: str, once: bool = True, interval: str = "30 seconds") -> StreamingQuery:
    """Transcript files of ``folder`` into the turns of ``table``, each message once."""
    lines = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(folder).withColumn("file", F.input_file_name())

    return _start(lines, table, checkpoint, once, interval)


def follow_turns(spark: SparkSession, folder: str, table: str, checkpoint: str, once: bool = True, interval: str = "30 seconds") -> StreamingQuery:
    """Growing transcripts of ``folder`` into the turns of ``table``, each message once, when it is finished."""
    from ledgerloom.sources.growing import GrowingLogs

    spark.dataSource.register(GrowingLogs)
    lines = spark.readStream.format("growing_logs").option("path", folder).option("unfinished", "transcript").load()
    return _start(lines.select("value", "file", F.col("start").alias("line")), table, checkpoint, once, interval)


def _start(lines: DataFrame, table: str, checkpoint: str, once: bool, interval: str) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        numbered = batch if "line" in batch.columns else batch.withColumn("line", F.monotonically_increasing_id())
        turns = readers.transcript_turns(rows_of(numbered), complete_only=True).dropDuplicates(KEYS)
        turns = turns.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int")).persist()
        touched = [r["bucket"] for r in turns.select("bucket").distinct().collect()]  # BUCKETS at most
        stored = _stored(batch.sparkSession, table, turns.schema.add("batch", "long"))
        before = stored.where(F.col("bucket").isin(touched) & (F.col("batch") < number)).select(*KEYS)
        turns.join(before, KEYS, "left_anti").select(*readers.TURN, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/batch={number}")
        turns.unpersist()

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def rows_of(lines: DataFrame) -> DataFrame:
    """Transcript rows of (value, file, line)."""
    r = lines.withColumn("row", F.from_json("value", readers.TRANSCRIPT)).where(F.ltrim("value").startswith("{") & F.col("row").isNotNull())
    return readers.rows_from(r)


def records_of(rows: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Every kind of record that a piece of transcripts holds: (tables to append, tables to put in the place of stored rows). Results and turns are numbered by their place in the
    file, so that no piece needs to know those before it."""
    source = F.lit("claude-code").alias("source")
    turns = readers.transcript_turns(rows, complete_only=True).drop("turn_index").join(rows.where("type = 'assistant'").groupBy("session_id", F.coalesce("message.id", "uuid").alias("message_id")).agg(F.min("line").alias("place")), ["session_id", "message_id"])
    flat = rows.where("type = 'user'").select("session_id", "ts", "line", F.posexplode("blocks").alias("at", "b")).where("b.type = 'tool_result'")
    body = payload.result_text(F.col("b.content"))
    events = flat.select(
        source, "session_id", F.col("b.tool_use_id").alias("tool_use_id"), (F.col("line") * 4096 + F.col("at")).alias("event_index"), "ts", F.when(F.coalesce("b.is_error", F.lit(False)), "errored").otherwise("completed").alias("status"),
        F.lit("tool_result").alias("event_source"), F.octet_length(body).cast("long").alias("bytes"),
    )
    users = readers.transcript_user_turns(rows)
    calls = turns.groupBy("source", "session_id", F.coalesce("request_id", "message_id").alias("inference_id")).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_create_5m", "cache_create_1h")])
    appended = {
        "turns": turns, "tool_result_events": events, "user_turns": users.select(source, *users.columns), "content": records.transcript_content(rows),
        "compactions": readers.transcript_compactions(rows).select(source, "session_id", "ts", "compaction_id"), "relationships": records.transcript_edges(rows).select(source, "session_id", "related_session_id", "kind", "agent_id"),
    }
    return appended, {"inferences": calls}


def follow_ledger(spark: SparkSession, folder: str, ledger: Ledger, checkpoint: str, once: bool = True, interval: str = "30 seconds", reports: list | None = None) -> StreamingQuery:
    """Growing transcripts of ``folder`` into all tables of a ledger: each batch is one commit, and one that is tried again after a crash counts once. ``reports`` gets the rows added by
    each batch."""
    from ledgerloom.sources.growing import GrowingLogs

    spark.dataSource.register(GrowingLogs)
    lines = spark.readStream.format("growing_logs").option("path", folder).option("unfinished", "transcript").load()

    def write(batch: DataFrame, number: int) -> None:
        rows = rows_of(batch.select("value", "file", F.col("start").alias("line"))).persist()
        appended, replaced = records_of(rows)
        report = ledger.append_batch(checkpoint, number, appended, replaced)
        if reports is not None:
            reports.append(report)
        rows.unpersist()

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def table(spark: SparkSession, path: str) -> DataFrame:
    """All turns ingested so far, numbered anew within their session."""
    order = Window.partitionBy("session_id").orderBy("ts", "message_id")
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch", "bucket").withColumn("turn_index", (F.row_number().over(order) - 1).cast("long"))


def windowed_usage(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tokens by event-time window of a stream of turns, rows later than ``late`` dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
