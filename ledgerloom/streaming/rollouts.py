"""Rollout logs that grow: keyed state per file takes up each new piece where the last one ended.

The state of a file holds the running totals, the folder told so far, the open task with its calls and results, and what waits for the next complete turn, all in one value; and in pages
by hash, each read and written once a batch, the contexts by turn and the counters of results by call. A page holds some PAGE entries: a log that grows has ever more pages, no larger ones.
A task_complete sends all that waits. The rules are those of ``sources.rollouts``; lines come in pieces cut anywhere.

Between Spark and the processor the lines of a file in a batch are one JSON text, as are up to SENT records; Spark makes and parses them. A state of an earlier layout can't be read: such a stream begins anew.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.sources.rollouts import CALL, TOTALS, typed_lines

_BLOCK = "struct<kind: string, tool_use_id: string, bytes: long, tokens: long, is_error: boolean>"
#: One row a record; ``record`` tells which columns it has.
RECORD = (
    "record string, session_id string, message_id string, turn_index long, ts timestamp, model string, cwd string, input_tokens long, cache_read long, output_tokens long, reasoning_tokens long, "
    f"calls array<{CALL}>, tool_use_id string, call_index long, event_index long, status string, event_source string, bytes long, agent_id string, preceding string, following string, blocks array<{_BLOCK}>"
)
OUT = f"file string, {RECORD}"
#: Entries of a page, and records in one text.
PAGE, SENT = 512, 1000
_LINE = ["kind", "turn", "session", "model", "cwd", *TOTALS, "call_id", "call", "failed", "said", "result_bytes", "status", "agent"]
_EMPTY = {"line": None, "turns": 0, "events": 0, "pages": 1, "entries": 0, "open": None, "now": [0] * len(TOTALS), "start": [0] * len(TOTALS)}


def _record(**known) -> dict:
    """The columns of a record that have a value."""
    return {c: v for c, v in known.items() if v is not None}


class RolloutProcessor(StatefulProcessor):
    """One file's log, piece by piece."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getValueState("log", "state string")
        self.pages = handle.getMapState("pages", "page int", "entries string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.log.get()
        at, held = json.loads(known[0]) if known else self._begin()
        self.read, self.stored, self.changed = {}, range(at["pages"] if known else 0), set()
        out: list[dict] = []
        lines = sorted((r for _, told in rows for r in json.loads(told)), key=lambda r: r["line"])
        if at["line"] is not None and lines[0]["line"] <= at["line"]:  # cut back to its own beginning: a new log
            at, held = self._begin()
            self.pages.clear()
            self.stored = ()
        at["line"] = lines[-1]["line"]
        for r in lines:
            getattr(self, f"_{r['kind']}")(at, held, r, out)
        self._put_pages(at)
        self.log.update((json.dumps([at, held]),))
        for i in range(0, len(out), SENT):
            yield Row(file=key[0], records=json.dumps(out[i : i + SENT]))

    @staticmethod
    def _begin() -> tuple[dict, dict]:
        return json.loads(json.dumps(_EMPTY)), {n: [] for n in ("calls", "blocks", "failed", "waiting", "within")}

    def _page(self, at: dict, entry: str) -> tuple[int, dict]:
        page = zlib.crc32(entry.encode("utf-8", "surrogatepass")) % at["pages"]
        if page not in self.read:
            found = self.pages.getValue((page,)) if page in self.stored else None
            self.read[page] = json.loads(found[0]) if found else {}
        return page, self.read[page]

    def _get(self, at: dict, entry: str):
        return self._page(at, entry)[1].get(entry)

    def _put(self, at: dict, entry: str, value) -> None:
        page, entries = self._page(at, entry)
        at["entries"] += entry not in entries
        entries[entry] = value
        self.changed.add(page)

    def _put_pages(self, at: dict) -> None:
        if at["entries"] > PAGE * at["pages"]:
            every = {}
            for page in range(at["pages"]):
                found = self.pages.getValue((page,)) if page in self.stored and page not in self.read else None
                every |= json.loads(found[0]) if found else self.read.get(page, {})
            while at["entries"] > PAGE * at["pages"]:
                at["pages"] *= 2
            self.read, self.stored, self.changed = {}, (), set(range(at["pages"]))
            for entry, value in every.items():
                self._page(at, entry)[1][entry] = value
        for page in self.changed:
            self.pages.updateValue((page,), (json.dumps(self.read.get(page, {})),))

    def _session_meta(self, at, held, r, out) -> None:
        at["session"], at["cwd"] = r.get("session") or at.get("session"), r.get("cwd") or at.get("cwd")
        if at["open"] is not None and at["folder"] is None:
            at["folder"] = r.get("cwd")

    def _turn_context(self, at, held, r, out) -> None:
        turn, model, cwd = r.get("turn"), r.get("model"), r.get("cwd")
        at["told"] = model or at.get("told")
        if turn is not None:
            self._put(at, f"turn {turn}", [model, cwd])
        if at["open"] is not None and at["open"] == turn:
            at["model"], at["folder"] = at["model"] or model, at["folder"] or cwd

    def _token_count(self, at, held, r, out) -> None:
        at["now"] = [r[c] for c in TOTALS]

    def _task_started(self, at, held, r, out) -> None:
        if at["open"] is not None:  # broken off: the turn counts, its results don't
            held["waiting"].append(self._turn(at, held))
        if held["blocks"]:
            held["waiting"].append(_record(record="user_turn", ts=at.get("slot_ts") or r.get("ts"), preceding=at.get("preceding"), following=r["turn"], blocks=held["blocks"]))
        told = self._get(at, f"turn {r['turn']}") or (None, None)
        at.update({"open": r["turn"], "ts": r.get("ts"), "model": told[0], "folder": told[1] or at.get("cwd"), "told_last": at.get("told"), "preceding": None, "slot_ts": None, "start": at["now"]})
        held.update(calls=[], blocks=[], failed=[], within=[])

    def _turn(self, at, held) -> dict:
        grown = {c: now - start for c, now, start in zip(TOTALS, at["now"], at["start"], strict=True)}
        at["turns"] += 1
        return _record(
            record="turn", message_id=at["open"], turn_index=at["turns"] - 1, ts=at["ts"], model=at["model"] or at["told_last"], cwd=at["folder"], input_tokens=max(grown["input"] - grown["cached"], 0), cache_read=max(grown["cached"], 0),
            output_tokens=max(grown["output"], 0), reasoning_tokens=max(grown["reasoning"], 0), calls=held["calls"],
        )

    def _task_complete(self, at, held, r, out) -> None:
        if at["open"] is None or r.get("turn") != at["open"]:
            return
        bad = set(held["failed"])
        for e in held["within"]:
            e["status"] = "errored" if e["tool_use_id"] in bad else "completed" if e["status"] == "unknown" else e["status"]
        held["blocks"] = [{**b, "is_error": b["is_error"] or b["tool_use_id"] in bad} for b in held["blocks"]]
        turn = self._turn(at, held)
        at.update(done=at["open"], done_read=turn["cache_read"], preceding=at["open"], open=None)
        out += [{**w, "session_id": at.get("session")} for w in (*held["waiting"], *held["within"], turn)]
        held.update(waiting=[], within=[], calls=[], failed=[])

    def _compacted(self, at, held, r, out) -> None:
        held["waiting"].append(_record(record="compaction", ts=r.get("ts"), preceding=at.get("done"), cache_read=at.get("done_read")))

    def _call(self, at, held, r, out) -> None:
        if at["open"] is not None and all(c["id"] != r["call_id"] for c in held["calls"]):
            held["calls"].append(r["call"])

    def _end(self, at, held, r, out) -> None:
        if at["open"] is not None and r.get("turn") == at["open"] and r["failed"]:
            held["failed"].append(r["call_id"])

    def _event(self, at, held, r, **more) -> None:
        n = self._get(at, f"call {r['call_id']}") or 0
        self._put(at, f"call {r['call_id']}", n + 1)
        e = _record(record="result", message_id=at["open"], tool_use_id=r["call_id"], call_index=n, event_index=at["events"], ts=r.get("ts"), **more)
        at["events"] += 1
        held["within" if at["open"] is not None else "waiting"].append(e)

    def _result(self, at, held, r, out) -> None:
        self._event(at, held, r, status="unknown", event_source="function_call_output", bytes=r["result_bytes"])
        self._said(at, held, r, out)

    def _notification(self, at, held, r, out) -> None:
        self._event(at, held, r, status=r["status"], event_source="subagent_notification", agent_id=r.get("agent"))

    def _said(self, at, held, r, out) -> None:
        size = r["said"] if r["kind"] == "said" else r["result_bytes"]
        held["blocks"].append({"kind": "text" if r["kind"] == "said" else "tool_result", "tool_use_id": None if r["kind"] == "said" else r["call_id"], "bytes": size, "tokens": -(-size // 4), "is_error": False})
        at["slot_ts"] = at.get("slot_ts") or r.get("ts")


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a file in a batch as one JSON list."""
    for b in batches:
        by_file = pa.table(b).group_by("file", use_threads=False).aggregate([("told", "list")]).combine_chunks()
        told = pc.binary_join_element_wise("[", pc.binary_join(by_file["told_list"], ","), "]", "")
        yield from pa.table({"file": by_file["file"], "told": told}).to_batches()


def rollout_records(lines: DataFrame) -> DataFrame:
    """Records (``OUT``) of a stream of (file, line, value), each as soon as its log has a complete turn after it.

    The session's state store must be RocksDB (``spark.sql.streaming.stateStore.providerClass`` = ``STATE_STORE``).
    """
    lines = typed_lines(lines).where("kind <> 'end' or failed")
    told = F.to_json(F.struct("line", *_LINE, F.unix_micros("ts").alias("ts")))
    packed = lines.select("file", told.alias("told")).mapInArrow(_packed, "file string, told string")
    sent = packed.groupBy("file").transformWithState(RolloutProcessor(), "file string, records string", "Append", "None")
    records = sent.select("file", F.inline(F.from_json("records", f"array<struct<{RECORD.replace('ts timestamp', 'ts long')}>>")))
    return records.withColumn("ts", F.timestamp_micros("ts"))


def stream_rollouts(spark, folder: str, table: str, checkpoint: str, once: bool = True, interval: str = "30 seconds"):
    """Growing rollout logs of ``folder`` into the records of ``table``; a restart goes on at the byte where the last batch ended.

    A replaced file is a log of its own: the key is the file with its identity.
    """
    from ledgerloom.sources.growing import GrowingLogs

    spark.dataSource.register(GrowingLogs)
    lines = spark.readStream.format("growing_logs").option("path", folder).load()
    keyed = lines.select(F.concat_ws("#", "file", "identity").alias("file"), F.col("start").alias("line"), "value")
    writer = rollout_records(keyed).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
