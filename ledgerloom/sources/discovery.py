"""What there is to read: log files and their changes, sidecars of subagents, a project's identity, and the configuration.

Listing files is a scan of the ``binaryFile`` source without its content column, so any file system that Spark reads will do.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import valid_session_id

DEFAULTS = {"content": "full", "retention_days": 90.0}


def log_files(spark: SparkSession, root: str, pattern: str = "*.jsonl", recursive: bool = True) -> DataFrame:
    """(path, length, modified) of the files under ``root``, or only of those right in it; empty files aren't listed."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(root)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def change_gate(files: DataFrame) -> str:
    """``count:bytes:hash`` of a listing; equal as long as no file came, went, grew or was touched."""
    r = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b"), F.coalesce(F.bit_xor(F.xxhash64("path", "length", "modified")), F.lit(0)).alias("h")).first()
    return f"{r['n']}:{r['b']}:{r['h'] & (1 << 64) - 1:016x}"


def changes(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """Files with what became of them since the cursors (path, length, modified): new, grown (read on from ``offset``), rotated (shorter, or an
    earlier time: read anew), same, or gone."""
    old = cursors.select("path", F.col("length").alias("old_length"), F.col("modified").alias("old_modified"))
    both = files.join(old, "path", "full")
    state = (
        F.when(F.col("old_length").isNull(), "new").when(F.col("length").isNull(), "gone").when((F.col("length") < F.col("old_length")) | (F.col("modified") < F.col("old_modified")), "rotated")
        .when(F.col("length") > F.col("old_length"), "grown").otherwise("same")
    )
    return both.withColumn("state", state).select("path", "state", F.when(state == "grown", F.col("old_length")).otherwise(0).alias("offset"), "length", "modified")


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(session_id, agent_id, path, meta) of subagents' own logs, ``<session>/subagents/agent-<id>.jsonl``, with the text of the ``.meta.json`` beside
    each; names that are no session ids are passed over."""
    pattern = r"([^/]+)/subagents/agent-([^/]+)\.jsonl$"
    logs = log_files(spark, root, "agent-*.jsonl").where(F.col("path").rlike(pattern)).select("path", F.regexp_extract("path", pattern, 1).alias("session_id"), F.regexp_extract("path", pattern, 2).alias("agent_id"))
    tail = F.regexp_extract(F.input_file_name(), r"([^/]+/subagents/agent-[^/]+)\.meta\.json$", 1)  # paths are spelled differently by the two sources
    meta = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "agent-*.meta.json").text(root, wholetext=True).select(tail.alias("stem"), F.col("value").alias("meta"))
    return logs.where(valid_session_id(F.col("session_id"))).withColumn("stem", F.regexp_extract("path", r"([^/]+/subagents/agent-[^/]+)\.jsonl$", 1)).join(meta, "stem", "left").select("session_id", "agent_id", "path", "meta")


def git_dir(start: str) -> Path | None:
    """The git folder of a working folder: its own or a parent's; of a worktree the common one that its file leads to."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        mark = folder / ".git"
        if mark.is_dir():
            return mark
        if mark.is_file() and (m := re.search(r"(?m)^gitdir:\s*(.+?)\s*$", mark.read_text(errors="replace"))):
            own = folder / m[1]
            common = own / "commondir"
            return own / common.read_text().strip() if common.is_file() and common.read_text().strip() else own
    return None


def remote_of(cwd: str) -> str | None:
    """URL of the origin remote (else the first remote) of a folder's repository."""
    folder = git_dir(cwd)
    if folder is None or not (folder / "config").is_file():
        return None
    urls, section = {}, None
    for line in (folder / "config").read_text(errors="replace").splitlines():
        line = line.strip()
        if m := re.fullmatch(r'\[\s*remote\s+"(.*)"\s*\]', line):
            section = m[1]
        elif line.startswith("["):
            section = None
        elif section is not None and (m := re.fullmatch(r"url\s*=\s*(.+)", line)):
            urls.setdefault(section, m[1].strip())
    return urls.get("origin") or next(iter(urls.values()), None)


def project_keys(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(project, project_key) of working folders, each looked up once: the key of its remote, else the folder itself."""
    from ledgerloom.functions.text import git_project_key

    found = spark.createDataFrame([(f, remote_of(f)) for f in sorted(set(folders))], "project string, url string")
    return found.select("project", F.coalesce(git_project_key(F.col("url")), F.col("project")).alias("project_key"))


def _retention(value) -> float | None:
    """Days, ``inf`` for always, None for what says nothing."""
    text = str(value).strip() if value is not None else ""
    if text.lower() == "forever":
        return float("inf")
    try:
        days = float(text)
    except ValueError:
        return None
    if days != days or days in (float("inf"), float("-inf")):
        return None
    return float("inf") if days < 0 else days


def config(path: str, environment: dict[str, str], prefix: str) -> dict:
    """Settings with precedence: environment variables with ``prefix``, the JSON file, defaults. Unreadable files and values count as absent."""
    try:
        stored = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        stored = {}
    stored = stored.get("content") if isinstance(stored, dict) and isinstance(stored.get("content"), dict) else {}
    kind = next((str(v) for v in (environment.get(f"{prefix}CONTENT_STORE"), stored.get("store")) if v in ("full", "hash-only", "off")), DEFAULTS["content"])
    days = next((d for d in map(_retention, (environment.get(f"{prefix}CONTENT_TTL_DAYS"), stored.get("retentionDays"))) if d is not None), DEFAULTS["retention_days"])
    return {"content": kind, "retention_days": days}
