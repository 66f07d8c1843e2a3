"""What a turn was about, from its tools, its commands and the words before it; and its retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import stripped_assignments, tool_name

# Words of requests by activity.
DEBUGGING = r"(?i)\b(bug|error|crash|traceback|stack\s*trace|failure|failing|broken|fix\s+the|not\s+working|throws?)\b"
REVIEW = r"(?i)\b(review|audit|inspect|look\s+over|code\s+review|pr\s+review)\b"
REFACTORING = r"(?i)\b(refactor|refactoring|cleanup|clean\s+up|rename|extract|restructure|move\s+this|reorganize)\b"
FEATURE = r"(?i)\b(add|create|implement|new\s+feature|build\s+the|introduce|support\s+for)\b"
BRAINSTORMING = r"(?i)\b(brainstorm|what\s+if|think\s+through|explore(?:\s+ideas)?|design|should\s+we|approach(?:es)?)\b"
PLANNING = r"(?i)\b(plan(?:ning)?|outline|roadmap|strategy)\b"

# Patterns of commands by activity, in order of precedence; a second pattern must not match.
COMMANDS = {
    "testing": [
        (r"\bpytest\b",), (r"\bpython\s+-m\s+pytest\b",), (r"\bvitest\b",), (r"\bbun\s+test\b",), (r"\bjest\b",), (r"\bmocha\b",), (r"\brspec\b",), (r"\bphpunit\b",), (r"\bgo\s+test\b",), (r"\bcargo\s+test\b",),
        (r"\b(?:npm|yarn|pnpm|bun)\s+(?:run\s+)?test\b",), (r"\bnode\s+--test\b",), (r"\bmake\s+test\b",), (r"\bctest\b",), (r"\bplaywright\b",), (r"\bcypress\b",), (r"\bpuppeteer\b",),
    ],
    "review": [(r"\bgit\s+status\b",), (r"\bgit\s+diff\b",), (r"\bgit\s+show\b",), (r"\bgit\s+log\b",), (r"\bgit\s+blame\b",), (r"\bgh\s+pr\s+(?:view|diff|checks)\b",), (r"\bgh\s+run\s+view\b",)],
    "git": [(r"\bgit\s+(?:push|pull|fetch|commit|merge|rebase|checkout|cherry-pick|reset|revert|switch|tag|stash)\b",)],
    "deps": [
        (r"\b(?:npm|yarn|pnpm|bun)\s+(?:install|add|remove|uninstall|update|upgrade|ci)\b",), (r"\bpip\s+(?:install|uninstall)\b",), (r"\bpip3\s+(?:install|uninstall)\b",), (r"\bpython\s+-m\s+pip\s+(?:install|uninstall)\b",),
        (r"\buv\s+(?:add|remove|sync|pip\s+install)\b",), (r"\bpoetry\s+(?:add|remove|install|update)\b",), (r"\bcargo\s+(?:add|remove|update)\b",), (r"\bgo\s+(?:get|mod\s+(?:tidy|download))\b",),
        (r"\bbundle\s+(?:install|update|add)\b",), (r"\bgem\s+(?:install|uninstall)\b",), (r"\bbrew\s+(?:install|uninstall|upgrade|update)\b",), (r"\bapt(?:-get)?\s+(?:install|remove)\b",),
    ],
    "format": [
        (r"\bprettier\b.*(?:--write|-w)(?:\s|$)",), (r"\beslint\b.*--fix\b",), (r"\bbiome\s+format\b",), (r"\bbiome\s+check\b.*--apply\b",), (r"\bblack\b", r"--check\b"), (r"\bruff\s+format\b",), (r"\bisort\b",),
        (r"\brustfmt\b",), (r"\bcargo\s+fmt\b", r"--check\b"), (r"\bgofmt\b",), (r"\bgoimports\b",), (r"\bdprint\s+fmt\b",),
    ],
    "verification": [
        (r"\b(?:npm|yarn|pnpm|bun)\s+(?:run\s+)?lint\b",), (r"\b(?:npm|yarn|pnpm|bun)\s+(?:run\s+)?typecheck\b",), (r"\bprettier\b.*--check\b",), (r"\beslint\b", r"--fix\b"), (r"\bbiome\s+check\b", r"--apply\b"),
        (r"\bblack\b.*--check\b",), (r"\bruff\s+check\b",), (r"\bflake8\b",), (r"\bmypy\b",), (r"\bpyright\b",), (r"\btsc\b", r"\btsc\s+--build\b"), (r"\bcargo\s+check\b",), (r"\bcargo\s+fmt\b.*--check\b",),
        (r"\bgolangci-lint\b",), (r"\bshellcheck\b",), (r"\bhadolint\b",), (r"\bterraform\s+validate\b",), (r"\bmake\s+(?:lint|check|typecheck|verify)\b",),
    ],
    "build-deploy": [
        (r"\bdocker\s+(?:build|compose\s+build|push)\b",), (r"\bcargo\s+build\b",), (r"\bgo\s+build\b",), (r"\bmake\s+(?:build|release|dist|package|deploy)\b",), (r"\b(?:npm|yarn|pnpm|bun)\s+(?:run\s+)?build\b",),
        (r"\b(?:webpack|vite|next|rollup|esbuild)\s+build\b",), (r"\btsc\s+--build\b",), (r"\bpm2\s+",), (r"\bkubectl\s+(?:apply|rollout|set)\b",), (r"\bhelm\s+(?:install|upgrade)\b",), (r"\bterraform\s+(?:apply|plan)\b",),
        (r"\bterraform\s+destroy\b",), (r"\bserverless\s+deploy\b",), (r"\b(?:vercel|netlify|flyctl|railway|sst)\s+(?:deploy|up)\b",),
    ],
}
# Files that are documents, tools that edit, tools that delegate.
DOCUMENTS = (r"(?i)\.md$", r"(?i)\.mdx$", r"(?i)\.rst$", r"(?i)\.adoc$", r"(?i)\.txt$", r"(?i)(?:^|/)README(?:\.[^/]*)?$", r"(?i)(?:^|/)CHANGELOG(?:\.[^/]*)?$", r"(?:^|/)docs/")
EDITS = ("Edit", "Write", "NotebookEdit", "MultiEdit")
DELEGATES = ("Agent", "Task")


def has_edits(calls: Column) -> Column:
    return F.exists(calls, lambda c: tool_name(c["name"]).isin(*EDITS))


def _any(value: Column, patterns) -> Column:
    """Whether any pattern matches of which the second, if there is one, doesn't."""
    plain = [p[0] for p in patterns if len(p) == 1]
    out = value.rlike("|".join(f"(?:{p})" for p in plain)) if plain else F.lit(False)
    for p in patterns:
        if len(p) == 2:
            out = out | (value.rlike(p[0]) & ~value.rlike(p[1]))
    return out


def command_activity(command: Column) -> Column:
    """Activity of one command, or null; assignments before it don't count."""
    bare = stripped_assignments(F.coalesce(command, F.lit("")))
    out = F.lit(None).cast("string")
    for name, patterns in reversed(COMMANDS.items()):
        out = F.when(_any(bare, patterns), name).otherwise(out)
    return out


def retries(calls: Column) -> Column:
    """Edits after a Bash call that itself came after an edit, over the calls of one turn in order."""
    start = F.struct(F.lit(0).alias("stage"), F.lit(0).alias("n"))

    def step(s: Column, c: Column) -> Column:
        name = tool_name(c["name"])
        edit, again = name.isin(*EDITS), name.isin(*EDITS) & (s["stage"] == 2)
        return F.struct(F.when(edit, 1).when((name == "Bash") & (s["stage"] == 1), 2).otherwise(s["stage"]).alias("stage"), (s["n"] + again.cast("int")).alias("n"))

    return F.aggregate(calls, start, step, lambda s: s["n"])


def activity(calls: Column, request: Column, failed: Column | None = None, reasoning: Column | None = None) -> Column:
    """Activity of a turn: ``calls`` (name, target, command) in order, the text of the request, whether a tool failed, reasoning tokens.

    Delegation, then plan mode, then edits (failed or retried twice: debugging; documents only; what the words say; else coding), then a
    failed tool, then the first command that tells, then the words, then exploration; without calls the words alone.
    """
    text, failed = F.coalesce(request, F.lit("")), F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
    reasoning = F.lit(0) if reasoning is None else F.coalesce(reasoning, F.lit(0))
    named = lambda test: F.exists(calls, lambda c: test(tool_name(c["name"])))
    edits = F.filter(calls, lambda c: tool_name(c["name"]).isin(*EDITS))
    documents = (F.size(edits) > 0) & F.forall(edits, lambda c: F.coalesce(c["target"].rlike("|".join(f"(?:{p})" for p in DOCUMENTS)), F.lit(False)))
    changed = F.when(text.rlike(DEBUGGING), "debugging").when(text.rlike(REFACTORING), "refactoring").when(text.rlike(FEATURE), "feature")
    asked = F.when(text.rlike(DEBUGGING), "debugging").when(text.rlike(REVIEW), "review").when(text.rlike(REFACTORING), "refactoring").when(text.rlike(FEATURE), "feature")
    ran = F.get(F.filter(F.transform(F.filter(calls, lambda c: tool_name(c["name"]) == "Bash"), lambda c: command_activity(c["command"])), lambda x: x.isNotNull()), F.lit(0))
    return (
        F.when(named(lambda n: n.isin(*DELEGATES)), "delegation")
        .when(named(lambda n: n == "ExitPlanMode"), "planning")
        .when(F.size(edits) > 0, F.when(failed | (retries(calls) >= 2), "debugging").when(documents, "docs").otherwise(F.coalesce(changed, F.lit("coding"))))
        .when(failed, "debugging")
        .when(F.size(calls) > 0, F.coalesce(ran, asked, F.lit("exploration")))
        .otherwise(F.coalesce(asked, F.when(text.rlike(BRAINSTORMING), "brainstorming").when(text.rlike(PLANNING), "planning").when(reasoning > 0, "reasoning"), F.lit("conversation")))
    )


def classify(calls: Column, request: Column, failed: Column, reasoning: Column) -> Column:
    """(activity, retries, has_edits) of a turn."""
    return F.struct(activity(calls, request, failed, reasoning).alias("activity"), retries(calls).cast("long").alias("retries"), has_edits(calls).alias("has_edits"))


def files_touched(calls: Column) -> Column:
    """Targets of file tools, each once, in the order first seen."""
    own = F.filter(calls, lambda c: c["name"].isin("Read", "Edit", "Write", "NotebookEdit") & c["target"].isNotNull())
    return F.array_distinct(F.transform(own, lambda c: c["target"]))
