"""Reading shell commands: which program runs, and whether it only reads files."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

# Programs that run another one, those with subcommands, and plain file readers.
WRAPPERS = {"sudo": 0, "env": 0, "time": 0, "nohup": 0, "nice": 0, "exec": 0, "command": 0, "timeout": 1, "xargs": 0}
SHELLS = ("bash", "sh", "zsh")
WITH_SUBCOMMAND = ("git", "gh", "npm", "pnpm", "yarn", "cargo", "go", "docker", "kubectl", "pip", "uv", "make", "poetry")
READERS = ("cat", "head", "tail", "less", "more", "bat", "nl")
DEEPEST = 5
_ASSIGNMENT = re.compile(r"^[A-Za-z_]\w*=")


def split(command: str) -> list[list[str]]:
    """Words of each simple command: quotes and backslashes are honoured, ``; & | newline`` separate."""
    out: list[list[str]] = [[]]
    word, quoted, some, i = "", "", False, 0
    while i < len(command):
        c = command[i]
        if quoted:
            if c == quoted:
                quoted = ""
            elif c == "\\" and quoted == '"' and i + 1 < len(command):
                i += 1
                word += command[i]
            else:
                word += c
        elif c in "'\"":
            quoted, some = c, True
        elif c == "\\" and i + 1 < len(command):
            i += 1
            word, some = word + command[i], True
        elif c in " \t\n;|&":
            if some or word:
                out[-1].append(word)
            word, some = "", False
            if c not in " \t" and out[-1]:
                out.append([])
        else:
            word += c
        i += 1
    if some or word:
        out[-1].append(word)
    return [w for w in out if w]


def parse(command: str, depth: int = 0) -> dict[str, str | None]:
    """The first program that does the work: (binary, subcommand, normalized). ``cd x &&``, assignments, wrappers and
    ``sh -c`` are looked through, to DEEPEST levels."""
    for words in split(command or ""):
        while words and _ASSIGNMENT.match(words[0]):
            words = words[1:]
        if not words or words[0] in ("cd", "export", "set", "source", "."):
            continue
        name = words[0].rsplit("/", 1)[-1]
        if name in WRAPPERS and depth < DEEPEST:
            rest = words[1:]
            while rest and (rest[0].startswith("-") or _ASSIGNMENT.match(rest[0])):
                rest = rest[1:]
            rest = rest[WRAPPERS[name] :]
            if rest:
                return parse(" ".join(f"'{w}'" if re.search(r"[\s;|&]", w) else w for w in rest), depth + 1)
        if name in SHELLS and depth < DEEPEST and len(words) > 2 and words[1].startswith("-") and "c" in words[1]:
            return parse(words[2], depth + 1)
        sub = next((w for w in words[1:] if not w.startswith("-")), None) if name in WITH_SUBCOMMAND else None
        if name in ("npm", "pnpm", "yarn") and sub == "run":
            script = next((w for w in words[words.index("run") + 1 :] if not w.startswith("-")), None)
            sub = f"run {script}" if script else sub
        return {"binary": name, "subcommand": sub, "normalized": f"{name} {sub}" if sub else name}
    return {"binary": None, "subcommand": None, "normalized": None}


def reads_file(command: str) -> bool:
    """Whether the command is a plain file reader with an operand and nothing else."""
    parts = split(command or "")
    return len(parts) == 1 and parts[0][0].rsplit("/", 1)[-1] in READERS and any(not w.startswith("-") for w in parts[0][1:]) and ">" not in command


def with_verbs(df, column: str = "command"):
    """``df`` with the struct ``verb`` of each command; distinct commands are parsed once, in Arrow batches."""
    @F.pandas_udf("binary string, subcommand string, normalized string")
    def verb(commands: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(c) for c in commands], columns=["binary", "subcommand", "normalized"])

    known = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("verb", verb(column))
    return df.join(known, column, "left")
