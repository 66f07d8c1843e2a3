"""Pricing, instruction files, surfaces, settings, and the ledger's exports."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.cost import RATE_SCHEMA

# Providers whose own entry for a model wins over resellers', and instruction files by harness.
PRIMARY_PROVIDERS = ("anthropic", "openai", "google")
INSTRUCTIONS = {"CLAUDE.md": ["claude-code"], ".claude/CLAUDE.md": ["claude-code"], "AGENTS.md": ["codex", "opencode"]}


def pricing(spark: SparkSession, listing: dict) -> DataFrame:
    """Rates from {provider: {models: {id: {cost}}}}: models without an input or output price are skipped, a missing
    cache-write price is the input price, a missing cache-read price 0; primary vendors win, else the last."""
    rows: dict[str, tuple[int, tuple]] = {}
    for vendor, entry in listing.items():
        rank = int(vendor in PRIMARY_PROVIDERS)
        for name, model in (entry.get("models") or {}).items():
            c = model.get("cost") or {}
            if c.get("input") is None or c.get("output") is None or rank < rows.get(name, (0,))[0]:
                continue
            tiers = sorted((t["size"], *(_number(t.get(k)) for k in ("input", "output", "cache_read", "cache_write", "reasoning"))) for t in c.get("tiers", []) if t.get("type") == "context")
            rows[name] = (rank, (name, float(c["input"]), float(c["output"]), float(c.get("cache_read") or 0), float(c["cache_write"] if c.get("cache_write") is not None else c["input"]), _number(c.get("reasoning")), "separate" if c.get("reasoning") is not None else "same-as-output", tiers or None))
    return spark.createDataFrame([r for _, r in rows.values()], RATE_SCHEMA)


def _number(value) -> float | None:
    return None if value is None else float(value)


def sections(markdown: str) -> list[tuple[str, int, int]]:
    """(title, level, bytes) of a file's parts: split at level-2 headings, or at level 1 if there are none; text before the
    first is ``(preamble)``. Headings inside code fences don't count."""
    lines, heads, fence = markdown.splitlines(keepends=True), [], None
    for i, line in enumerate(lines):
        mark = re.match(r" {0,3}(`{3,}|~{3,})(.*)$", line.rstrip("\n"))
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip():
                fence = None
        elif mark:
            fence = mark[1]
        elif h := re.match(r" {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
            heads.append((i, len(h[1]), h[2]))
    level = 2 if any(n == 2 for _, n, _ in heads) else 1
    cuts = [(i, n, t) for i, n, t in heads if n == level]
    size = lambda a, b: len("".join(lines[a:b]).encode())
    first = cuts[0][0] if cuts else len(lines)
    out = [("(preamble)", 0, size(0, first))] if size(0, first) else []
    return out + [(t, n, size(i, j)) for (i, n, t), j in zip(cuts, [c[0] for c in cuts[1:]] + [len(lines)], strict=True)]


def instruction_sections(spark: SparkSession, project: str) -> DataFrame:
    """(file, section, level, bytes) of a project's instruction files."""
    rows = [(name, *s) for name in INSTRUCTIONS if (p := Path(project, name)).is_file() for s in sections(p.read_text(errors="replace"))]
    return spark.createDataFrame(rows, "file string, section string, level int, bytes long")


def without_section(markdown: str, title: str) -> str:
    """Unified diff that removes a section."""
    import difflib

    lines = markdown.splitlines(keepends=True)
    starts = [i for i, x in enumerate(lines) if re.match(rf" {{0,3}}#{{1,2}}\s+{re.escape(title)}\s*#*\s*$", x)]
    if not starts:
        return ""
    level = len(re.match(r"\s*(#+)", lines[starts[0]])[1])
    end = next((i for i in range(starts[0] + 1, len(lines)) if re.match(rf" {{0,3}}#{{1,{level}}}\s", lines[i])), len(lines))
    return "".join(difflib.unified_diff(lines, lines[: starts[0]] + lines[end:], "a", "b"))


def surfaces(spark: SparkSession, root: str) -> DataFrame:
    """(kind, stem, tokens) of agents, skills, commands, prompts, rules and memories under ``root``, and of a catalog file."""
    rows = []
    for kind in ("agents", "skills", "commands", "prompts", "rules", "memories"):
        for p in sorted(Path(root, kind).glob("*.md")):
            rows.append((kind.removesuffix("s") if kind != "memories" else "memory", p.stem, -(-p.stat().st_size // 4)))
    catalog = Path(root, "opencode.json")
    if catalog.is_file():
        listed = json.loads(catalog.read_text())
        rows += [("skill", k, 0) for k in listed.get("skills", {})] + [("command", k, -(-len(json.dumps(v)) // 4)) for k, v in listed.get("commands", {}).items()]
    return spark.createDataFrame(rows, "kind string, stem string, tokens int")


def settings(path: str) -> dict:
    """A settings file; none if it is missing or malformed."""
    try:
        found = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def export_ledger(tables: dict[str, DataFrame], path: str) -> None:
    """JSON lines {v, kind, record} of every table."""
    parts = [df.select(F.to_json(F.struct(F.lit(1).alias("v"), F.lit(kind).alias("kind"), F.struct(*df.columns).alias("record"))).alias("value")) for kind, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out.write.mode("overwrite").text(path)


def import_ledger(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of an export; the old kind ``transcript`` is read as tool results. Bad lines are skipped."""
    raw = spark.read.text(path)
    kind = F.get_json_object("value", "$.kind")
    kind = F.when(kind == "transcript", "tool_result_event").otherwise(kind)
    return {k: raw.where(kind == k).select(F.from_json(F.get_json_object("value", "$.record"), s).alias("r")).select("r.*") for k, s in schemas.items()}


def prune(content: DataFrame, cutoff) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with rows and bytes removed) of content older than ``cutoff``."""
    old = F.col("created_at") < F.lit(cutoff)
    return content.where(~old | F.col("created_at").isNull()), content.where(old).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))


def summary_csv(rollup: DataFrame, path: str) -> None:
    rollup.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
