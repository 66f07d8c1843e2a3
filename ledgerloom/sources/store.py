"""The ledger's tables in a folder: appends that skip what is stored, upserts, stamps with their edges, rebuild, reset and reports.

A table is a list of Parquet folders that the ledger's manifest names (``sources.commits``). Every change, of one table or of several, writes new folders
and then counts by one rename: a job that dies at any point leaves the tables as they were, and none is ever half new. Rows lie in BUCKETS folders by their session's hash, so an
append looks for stored keys only where its own sessions are, and reads the key columns alone. A batch of a stream carries its number; a number that is committed
does nothing when it comes again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerloom.functions.text import valid_session_id
from ledgerloom.sources.commits import Commits

#: Identity of a row of each kind, and the kinds that can be derived from logs again.
KEYS = {
    "turns": ("source", "session_id", "message_id"), "compactions": ("source", "session_id", "ts"), "relationships": ("source", "session_id", "related_session_id", "kind", "agent_id"),
    "tool_result_events": ("source", "session_id", "tool_use_id", "event_index"), "user_turns": ("source", "session_id", "user_uuid"), "inferences": ("source", "session_id", "inference_id"),
    "content": ("source", "session_id", "message_id", "role", "kind", "position"), "stamps": ("stamp_id",),
}
BUCKETS = 64
#: Folders of a table after which an append rewrites it as one.
FOLDERS = 40
DERIVABLE = ("turns", "compactions", "relationships", "tool_result_events", "user_turns", "inferences", "content")


class Ledger:
    """Tables of one ledger folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.commits = spark, folder.rstrip("/"), Commits(spark, folder)

    def table(self, kind: str) -> DataFrame | None:
        """The stored rows, or None before the first."""
        return self._table(self.commits.latest()[1], kind)

    def _table(self, state: dict, kind: str, buckets: list[int] | None = None) -> DataFrame | None:
        """A table of a state, or only its rows in some buckets."""
        names = state.get("tables", {}).get(kind)
        if not names:
            return None
        own = T.StructType.fromDDL(state["schemas"][kind])
        rows = self.spark.read.schema(T.StructType([*own.fields, T.StructField("part", T.StringType()), T.StructField("_bucket", T.IntegerType())])).option("basePath", f"{self.folder}/{kind}").parquet(*[f"{self.folder}/{n}" for n in names])
        return (rows if buckets is None else rows.where(F.col("_bucket").isin(buckets))).select(*own.names)

    def _write(self, kind: str, rows: DataFrame) -> str:
        """A fresh folder with ``rows`` that no manifest names yet."""
        name = f"{kind}/part=p{uuid.uuid4().hex}"
        rows.withColumn("_bucket", _bucket(rows)).write.partitionBy("_bucket").parquet(f"{self.folder}/{name}")
        return name

    def _put(self, state: dict, kind: str, rows: DataFrame, more: bool) -> dict:
        """``state`` with ``rows`` as (or added to) a table; columns that only stored rows have are null."""
        old = state.get("tables", {}).get(kind, []) if more else []
        schema = _merged(state.get("schemas", {}).get(kind) if more else None, rows)
        tables, schemas = {**state.get("tables", {}), kind: [*old, self._write(kind, rows)]}, {**state.get("schemas", {}), kind: schema}
        return {**state, "tables": tables, "schemas": schemas}

    def _fresh(self, state: dict, kind: str, rows: DataFrame, fingerprint: str | None) -> DataFrame:
        """Rows whose key (and content fingerprint, where it isn't null) is neither stored nor twice among them."""
        keys = list(KEYS[kind])
        if kind == "content" and not rows.where(~F.coalesce(valid_session_id(F.col("session_id")), F.lit(False))).isEmpty():
            raise ValueError("content has a session id that is not valid")
        fresh = rows.dropDuplicates(keys)
        if fingerprint:
            known = F.col(fingerprint).isNotNull()
            fresh = fresh.where(known).dropDuplicates([fingerprint]).unionByName(fresh.where(~known))
        stored = self._table(state, kind)
        if stored is None:
            return fresh
        touched = [r[0] for r in fresh.select(_bucket(fresh)).distinct().collect()]  # BUCKETS at most
        near = self._table(state, kind, touched)
        right = near.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
        match = [fresh[k].eqNullSafe(right[f"_k{i}"]) for i, k in enumerate(keys)]
        fresh = fresh.join(right, match, "left_anti")
        if fingerprint:
            fresh = fresh.join(stored.select(fingerprint), fingerprint, "left_anti")
        return fresh

    def _added(self, state: dict, kind: str, rows: DataFrame, fingerprint: str | None = None) -> tuple[dict, int]:
        rows = self._fresh(state, kind, rows, fingerprint).select(*rows.columns)
        after = self._put(state, kind, rows, True)
        n = self._table({**after, "tables": {kind: after["tables"][kind][-1:]}}, kind).count()
        if len(after["tables"][kind]) > FOLDERS:
            after = self._put(after, kind, self._table(after, kind), False)
        return after, n

    def append(self, kind: str, rows: DataFrame, fingerprint: str | None = None) -> int:
        """Add the rows whose key (and content fingerprint, a column; a null one is no content) is new, one a key; returns how many."""
        version, state = self.commits.latest()
        state, n = self._added(state, kind, rows, fingerprint)
        self.commits.commit(version, state)
        return n

    def append_batch(self, stream: str, number: int, tables: dict[str, DataFrame], replaced: dict[str, DataFrame] | None = None) -> dict[str, int]:
        """All tables of one batch of a stream in one commit: ``tables`` are appended, ``replaced`` put in the place of stored rows. Returns rows added by
        kind; a batch that was committed before adds nothing."""
        version, state = self.commits.latest()
        if state.get("batches", {}).get(stream, -1) >= number:
            return {}
        report = {}
        for kind, rows in tables.items():
            state, report[kind] = self._added(state, kind, rows)
        for kind, rows in (replaced or {}).items():
            state = self._upserted(state, kind, rows)
        self.commits.commit(version, {**state, "batches": {**state.get("batches", {}), stream: number}})
        return report

    def upsert(self, kind: str, rows: DataFrame) -> None:
        """Put the rows in, each in the place of the stored one with its key."""
        version, state = self.commits.latest()
        self.commits.commit(version, self._upserted(state, kind, rows))

    def _upserted(self, state: dict, kind: str, rows: DataFrame) -> dict:
        keys, stored = list(KEYS[kind]), self._table(state, kind)
        rows = rows.dropDuplicates(keys)
        return self._put(state, kind, rows if stored is None else stored.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True), False)

    def vacuum(self) -> int:
        """Delete folders that no kept version names."""
        return self.commits.vacuum(lambda state: [n for names in state.get("tables", {}).values() for n in names])

    def write_stamp(self, stamp: DataFrame) -> None:
        """Append stamps (stamp_id, session_id, ..., tags). One whose tags name a parent agent also makes a subagent edge from its session."""
        version, state = self.commits.latest()
        state, _ = self._added(state, "stamps", stamp)
        self.commits.commit(version, self._with_edges(state, stamp))

    def _with_edges(self, state: dict, stamps: DataFrame) -> dict:
        parent = F.try_element_at("tags", F.lit("parentAgentId"))
        edges = stamps.where(parent.isNotNull() & F.col("session_id").isNotNull())
        edges = edges.select(F.lit("spawn-env").alias("source"), "session_id", parent.alias("related_session_id"), F.lit("subagent").alias("kind"), F.try_element_at("tags", F.lit("agentId")).alias("agent_id"))
        return state if edges.isEmpty() else self._added(state, "relationships", edges)[0]

    def counts(self) -> dict[str, int]:
        """Rows of every table there is: what a reset would remove."""
        return {k: t.count() for k in KEYS if (t := self.table(k)) is not None}

    def rebuild(self, parsed: dict[str, DataFrame]) -> None:
        """Drop what can be derived, put in what the logs give now, and replay the edges of the stamps."""
        version, state = self.commits.latest()
        after = {**state, "tables": {k: v for k, v in state.get("tables", {}).items() if k not in DERIVABLE}}
        for kind, rows in parsed.items():
            after, _ = self._added(after, kind, rows)
        if (stamps := self._table(after, "stamps")) is not None:
            after = self._with_edges(after, stamps)
        self.commits.commit(version, after)

    def reset(self, dry_run: bool = False) -> dict[str, int]:
        """Remove every table, stamps and cursors of streams too; with ``dry_run`` only tell what would go."""
        found = self.counts()
        if not dry_run:
            self.commits.commit(self.commits.latest()[0], {})
        return found

    def sessions_with(self, kind: str) -> DataFrame:
        """Distinct sessions of a table."""
        return self.table(kind).select("session_id").distinct()

    def turns_of(self, sessions: DataFrame) -> DataFrame:
        """Turns of a set of sessions (session_id)."""
        return self.table("turns").join(sessions.select("session_id").distinct(), "session_id", "left_semi")

    def inferences(self, since=None, until=None, project: str | None = None) -> DataFrame:
        """Inferences that start within inclusive times; of a project: those of sessions with a turn in it."""
        rows = self.table("inferences")
        if since is not None:
            rows = rows.where(F.col("start_ts") >= F.lit(since))
        if until is not None:
            rows = rows.where(F.col("start_ts") <= F.lit(until))
        if project is None:
            return rows
        turns = self.table("turns")
        own = turns.where((F.col("project") == project) | (F.col("project_key") == project)).select("source", "session_id").distinct()
        return rows.join(own, ["source", "session_id"], "left_semi")

    def content(self, session: str | None = None, source: str | None = None, since=None, until=None) -> DataFrame:
        """Content rows; a row without a time passes the time bounds."""
        rows = self.table("content")
        for column, value in (("session_id", session), ("source", source)):
            if value is not None:
                rows = rows.where(F.col(column) == value)
        for bound, late in ((since, False), (until, True)):
            if bound is not None:
                rows = rows.where(F.col("ts").isNull() | (F.col("ts") <= F.lit(bound) if late else F.col("ts") >= F.lit(bound)))
        return rows


def _bucket(rows: DataFrame):
    """A row's bucket by its session; rows of a kind without sessions lie in one."""
    return (F.pmod(F.xxhash64(F.col("session_id").cast("string")), F.lit(BUCKETS)) if "session_id" in rows.columns else F.lit(0)).cast("int")


def _merged(stored: str | None, rows: DataFrame) -> str:
    """The DDL of a table with the columns of its rows."""
    fields = {f.name: f.dataType.simpleString() for f in (T.StructType.fromDDL(stored).fields if stored else ())}
    fields |= {f.name: f.dataType.simpleString() for f in rows.schema.fields if f.name not in fields}
    return ", ".join(f"`{n}` {t}" for n, t in fields.items())


def merge_reports(*reports: dict[str, int]) -> dict[str, int]:
    """The sum of reports of appends, by kind."""
    out: dict[str, int] = {}
    for r in reports:
        for k, n in r.items():
            out[k] = out.get(k, 0) + n
    return out


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the first by ``order``, in that order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r").orderBy(order)


def merge_tags(workflow: str | None, tags: dict[str, str]) -> dict[str, str]:
    """Tags of a summary query, the workflow among them; a conflicting value is an error, an empty key too."""
    if any(not k.strip() for k in tags):
        raise ValueError("a tag needs a key")
    if workflow is not None and tags.get("workflowId", workflow) != workflow:
        raise ValueError("workflow and tags name different workflows")
    return tags if workflow is None else {**tags, "workflowId": workflow}


def report_json(rows: DataFrame, path: str) -> None:
    """A report's rows as JSON lines in their order, null fields left out."""
    rows.write.mode("overwrite").json(path)
