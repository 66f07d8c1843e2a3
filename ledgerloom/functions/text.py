"""String, hash and payload scalars over log records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that harnesses give to the same tool, and to the same status of a result.
TOOL_ALIASES = {
    "apply_patch": "Edit", "exec_command": "Bash", "shell": "Bash", "read_file": "Read", "write_file": "Write", "update_plan": "ExitPlanMode", "spawn_agent": "Agent", "send_input": "Task", "wait_agent": "Task", "close_agent": "Task",
    "resume_agent": "Task", "view_image": "Read", "read_mcp_resource": "Read", "read": "Read", "write": "Write", "edit": "Edit", "bash": "Bash", "grep": "Grep", "glob": "Glob", "webfetch": "WebFetch", "task": "Task",
}
STATUS_NAMES = {
    "completed": "completed", "complete": "completed", "success": "completed", "succeeded": "completed", "done": "completed", "error": "errored", "errored": "errored", "failed": "errored", "failure": "errored",
    "running": "running", "in_progress": "running", "queued": "running", "pending": "running", "started": "running", "cancelled": "cancelled", "canceled": "cancelled", "aborted": "cancelled",
}
STOP_REASONS = ("end_turn", "max_tokens", "stop_sequence", "tool_use", "pause_turn", "refusal", "silent")
# Marks of a cut tool result, and phrases of an assistant that gives up.
TRUNCATION_MARKS = ("<system-truncated>", "[truncated]", "output truncated", "result truncated", "response truncated", "truncated to ")
GIVE_UP = ("i'm unable to", "i am unable to", "i can't proceed", "i cannot proceed", "i don't have access", "i cannot access", "unable to verify", "doesn't appear to exist")


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def tool_name(name: Column) -> Column:
    return F.coalesce(_lookup(TOOL_ALIASES, name), name)


def status(value: Column) -> Column:
    """Status by its name, hyphens and blanks counting as underscores; ``unknown`` for other names and for none."""
    return F.coalesce(_lookup(STATUS_NAMES, F.translate(F.lower(value), "- ", "__")), F.lit("unknown"))


def stop_reason(value: Column) -> Column:
    """A known reason as it is, an unknown one ``silent``, none stays null."""
    return F.when(value.isNull(), None).when(value.isin(*STOP_REASONS), value).otherwise("silent")


def mcp_parts(name: Column) -> Column:
    """(server, tool) of ``mcp__server__tool``; null for other tools."""
    pattern = "^mcp__(.+?)__(.+)$"
    return F.when(name.rlike(pattern), F.struct(F.regexp_extract(name, pattern, 1).alias("server"), F.regexp_extract(name, pattern, 2).alias("tool")))


def approximate_tokens(size: Column) -> Column:
    """A quarter of a byte count, rounded up."""
    return F.ceil(size / 4).cast("long")


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def turn_fingerprint() -> Column:
    """Content identity of a turn, across sessions."""
    fields = [F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.col("model"), (F.col("input_tokens") + F.col("output_tokens")).cast("string"), F.col("cache_read").cast("string"), (F.col("cache_create_5m") + F.col("cache_create_1h")).cast("string"), F.col("target")]
    return short_hash(F.concat_ws("|", *[F.coalesce(f, F.lit("")) for f in fields]))


def payload_measure(text: Column) -> Column:
    """(chars, bytes, hash, truncated) of a tool result."""
    return F.struct(F.char_length(text).cast("long").alias("chars"), F.octet_length(text).cast("long").alias("bytes"), short_hash(text).alias("hash"), is_truncated(text).alias("truncated"))


def is_truncated(text: Column) -> Column:
    out = F.lit(False)
    for mark in TRUNCATION_MARKS:
        out = out | F.contains(F.lower(text), F.lit(mark))
    return out


def error_signature(text: Column) -> Column:
    """First line that is not blank, trimmed, 240 characters at most."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.substring(F.get(lines, F.lit(0)), 1, 240)


def ellipsis(text: Column, limit: int) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def stripped_assignments(command: Column) -> Column:
    """A command without the variable assignments before it."""
    return F.regexp_replace(command, r"^(?:\s*[A-Z_][A-Z0-9_]*=\S+\s+)+", "")


def slash_command(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"<command-name>/?([A-Za-z0-9_:-]+)</command-name>", 1), F.lit(""))


def resume_target(text: Column) -> Column:
    """Session that ``/resume id`` or ``/continue id`` names; the empty string for a bare one, null for other text."""
    pattern = r"^\s*/(?:resume|continue)(?:\s+([A-Za-z0-9][A-Za-z0-9._-]*))?\s*$"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def valid_session_id(value: Column) -> Column:
    return (F.char_length(value) <= 128) & value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$")


def gives_up(text: Column) -> Column:
    """Whether a text has a phrase of giving up, whatever the case."""
    out = F.lit(False)
    for phrase in GIVE_UP:
        out = out | F.contains(F.lower(text), F.lit(phrase))
    return out


def git_project_key(url: Column) -> Column:
    """``host/owner/name`` of a git remote in any of its spellings, lower-case host."""
    plain = F.regexp_replace(F.trim(url), r"\.git/?$|/$", "")
    scp = F.regexp_replace(plain, r"^(?:[^@/]+@)?([^:/]+):(?!//)(.+)$", "$1/$2")
    bare = F.regexp_replace(F.regexp_replace(scp, r"^[a-z+]+://", ""), r"^[^@/]+@", "")
    return F.concat(F.lower(F.substring_index(bare, "/", 1)), F.regexp_replace(bare, r"^[^/]*", ""))
