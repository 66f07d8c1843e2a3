"""Personal data: plain and disguised identifiers with exact positions in the source text.

Plain identifiers are found on the text itself. For disguised ones a chain of transducers rewrites the text, each
keeping for every character the stretch of source it came from: look-alike characters and invisible ones, then
spelled digits, then at/dot disguises. The same detectors run on the rewritten text; a finding whose source
holds a rewrite and that no plain finding of its kind covers is added, at its source position; a plain finding that is
only a fragment of it stays beside it. Shorter runs of spelled digits are read apart, with the dots, plus signs and digit groups
around them, and count only where a detector verifies an ip, card or phone in the run; one digit word after an identifier
that is whole without it ('+1 848 555 1373 un an') isn't part of it.

Not seen as a disguise: a spelled at between a plain word and a real domain ('john at example.com'), which ordinary prose
has too ('look at example.com'). With a local part that no word is (a dot, digit, underscore, percent or plus sign in it), or
with a set-off sign ('john @ example.com'), it is seen.

Results for special input: a null or empty text has no span; spans are code points, end exclusive; texts
without a trigger of any transducer skip the rewriting, which would be the identity.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm.textkit import annotate, strings

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Look-alike letters of other scripts, signs, and invisible characters (full-width forms and
# decimal digits of any script follow from rules).
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ѕ": "S", "Ј": "J",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ո": "n", "һ": "h", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "․": ".", " ": " ", " ": " ", " ": " ", " ": " ", "　": " ",
    "­": "", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "",
}
# Digit words, and words for @ and the dot, in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS, DOT_WORDS, PLUS_WORDS = ("at", "arobase", "arroba", "klammeraffe"), ("dot", "punkt", "point", "punto"), ("plus", "más")
#: Spelled digits count as a number by themselves from so many in a row; others only where a detector verifies their run.
SPELLED_LEAST = 4

_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_ITEMS = {*DIGIT_WORDS, *"0123456789"}
_GAP = r"(?:[ ,]{1,2}|-)"
_ITEM = rf"(?:{_WORD}|[0-9])"
_SPELLED = re.compile(rf"(?<![^\W_])(?:(?:{'|'.join(PLUS_WORDS)}){_GAP}|\+ ?)?{_ITEM}(?:{_GAP}{_ITEM}){{{SPELLED_LEAST - 1},}}(?![^\W_])", re.I)
_SPELLED_TOKEN = re.compile(rf"{_WORD}|[0-9]|{'|'.join(PLUS_WORDS)}|\+", re.I)
_AT, _DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_BRACKETED = re.compile(rf"[ \t]{{0,3}}[\[({{<][ \t]{{0,3}}(?:({_AT}|@)|({_DOT}|\.))[ \t]{{0,3}}[\])}}>][ \t]{{0,3}}", re.I)
_ATOM = r"[A-Za-z0-9_%+-]+"
_SEPARATED = rf"(?:[ \t]{{1,3}}(?:{_DOT})[ \t]{{1,3}}|[ \t]{{0,3}}\.[ \t]{{0,3}})"
_PLAIN_DOT = rf"[ \t]{{1,3}}(?:{_DOT})[ \t]{{1,3}}"
_PLAIN_AT = re.compile(rf"(?:[ \t]{{1,3}}(?:{_AT})[ \t]{{1,3}}|[ \t]{{0,3}}@[ \t]{{0,3}})(?={_ATOM}(?:{_PLAIN_DOT}|\.{_ATOM}{_PLAIN_DOT}))", re.I)
_DOT_AFTER = re.compile(rf"(?:{_PLAIN_DOT})(?={_ATOM})", re.I)
_ATOM_RUN = re.compile(_ATOM)
#: A spelled dot in reversed text, for the walk to the left.
_DOT_BEFORE = re.compile(rf"[ \t]{{1,3}}(?:{'|'.join(w[::-1] for w in DOT_WORDS)})[ \t]{{1,3}}(?=[A-Za-z0-9_%+-])", re.I)
# an at before a real domain: set-off signs, and words after a local part that is no plain word
_REAL = r"(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2})"
_SET_OFF = re.compile(rf"(?<=[A-Za-z0-9._%+-])(?:[ \t]{{1,3}}@[ \t]{{0,3}}|@[ \t]{{1,3}}){_REAL}")
_REAL_AT = re.compile(rf"(?<![A-Za-z0-9._%+-])({_ATOM}{_PLAIN_DOT})?([A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])([ \t]{{1,3}}(?:{_AT})[ \t]{{1,3}}){_REAL}", re.I)
#: What every match of the two has in it, found by far faster.
_AT_HINT = re.compile(rf"[ \t](?:{_AT})[ \t]{{1,3}}{_REAL}", re.I)
_NO_WORD = re.compile(r"(?=.*[A-Za-z])[^.]*(?:[0-9_%+]|[^.]\.[^.])")
# runs of digit words and digit groups with gaps and dots, for the detectors of ip, card and phone
_RUN_GAP = r"[ \t,()-]{1,3}"
_RUN_ITEM = rf"(?:(?:{_WORD})(?![^\W_])|[0-9]+(?![^\W_]))"
_RUN_DOT = rf"(?:[ \t]{{1,3}}(?:{_DOT})[ \t]{{1,3}}|\.)"
_RUN = re.compile(rf"(?:\+[ (]{{0,2}}|(?<![^\W_])(?:(?:{'|'.join(PLUS_WORDS)}){_RUN_GAP})?){_RUN_ITEM}(?:(?:{_RUN_DOT}|{_RUN_GAP}){_RUN_ITEM})*", re.I)
_RUN_TOKEN = re.compile(rf"(?P<sign>\+|(?:{'|'.join(PLUS_WORDS)})(?![^\W_]))|(?P<word>{_WORD})|(?P<group>[0-9]+)|(?P<dot>{_DOT}|\.)", re.I)
_TOKEN = re.compile(r"\w+")
_DIGIT_WORDS, _RUN_WORDS = frozenset(DIGIT_WORDS), frozenset((*DOT_WORDS, *PLUS_WORDS))
_NUMBER_DOT = re.compile(rf"(?<=[0-9])[ \t]{{1,3}}(?:{_DOT})[ \t]{{1,3}}(?=[0-9])", re.I)


def _folded() -> dict[str, str]:
    """Rewrites of single characters: the table, full-width forms, and decimal digits of any script."""
    table = dict(LOOKALIKES)
    table.update({chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)})
    for c in range(0x80, 0x1FBFA):
        digit = unicodedata.decimal(chr(c), None) if not 0xD800 <= c < 0xE000 else None
        if digit is not None:
            table[chr(c)] = str(digit)
    return table


FOLDED = _folded()
_FOLDABLE = re.compile("[" + "".join(re.escape(c) for c in sorted(FOLDED) if ord(c) < 1 << 16) + "]")
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def detect(text: str) -> list[tuple[str, int, int]]:
    """Plain identifiers by kind, then start: leftmost, non-overlapping within a kind; time linear in the text."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        # the run of local characters before this sign, not before the last finding
        before = text[last:at]
        begin = last + len(before.rstrip(_LOCAL))
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", begin, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", last)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


class Rewritten:
    """A text under rewriting; ``start`` and ``end`` give the source stretch of each character, ``changed`` the rewrites."""

    def __init__(self, text: str):
        self.text, self.start = text, np.arange(len(text))
        self.end, self.changed = self.start + 1, []

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the stretches (start, end, new), ascending and disjoint. A new character covers its whole stretch."""
        if not edits:
            return
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            lo, hi = int(self.start[a]), int(self.end[b - 1])
            starts += [self.start[at:a], np.full(len(new), lo)]
            ends += [self.end[at:a], np.full(len(new), hi)]
            self.changed.append((lo, hi))
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end = np.concatenate([*starts, self.start[at:]]), np.concatenate([*ends, self.end[at:]])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])


def _fold_characters(r: Rewritten) -> None:
    r.apply([(m.start(), m.end(), FOLDED[m[0]]) for m in _FOLDABLE.finditer(r.text)])
    r.apply([(m.start(), m.end(), FOLDED[m[0]]) for m in _ASTRAL.finditer(r.text) if m[0] in FOLDED])


def _read_digits(r: Rewritten) -> None:
    edits = []
    for m in _SPELLED.finditer(r.text):
        for t in _SPELLED_TOKEN.finditer(m[0]):
            word = t[0].lower()
            new = DIGIT_WORDS.get(word) or ("+" if word in PLUS_WORDS else word)
            # the gap before a token goes with it
            edits.append((m.start() + (edits_end if t.start() else 0), m.start() + t.end(), new))
            edits_end = t.end()
    r.apply([e for e in edits if r.text[e[0] : e[1]] != e[2]])


def _numbers(r: Rewritten) -> list[tuple[str, int, int]]:
    """Findings, at their source, of the detectors in runs with digit words of any number; each finding holds one."""
    out = []
    for run in _RUN.finditer(r.text):
        # what is read of the run; for each of its characters the stretch of the run, and whether it was a word
        read, begin, end, spoken, kind, at = [], [], [], [], None, 0
        for t in _RUN_TOKEN.finditer(run[0]):
            word, new = t[0].lower(), t.lastgroup
            gap = run[0][at : t.start()]
            # a gap stays between two groups of digits only; beside words it goes
            pieces = [(gap, at, False)] if gap and kind == new == "group" else []
            pieces.append({"sign": ("+", t.start(), word != "+"), "word": (DIGIT_WORDS.get(word), t.start(), True), "group": (word, t.start(), False), "dot": (".", t.start(), word != ".")}[new])
            for text, a, said in pieces:
                whole = said or text in "+."
                read.append(text)
                begin += [a] * len(text) if whole else range(a, a + len(text))
                end += [t.end()] * len(text) if whole else range(a + 1, a + len(text) + 1)
                spoken += [said] * len(text)
            kind, at = new, t.end()
        if not any(spoken):
            continue
        number = "".join(read)
        for kind, a, b in detect(number):
            # one digit word after what is whole without it is the next word of the sentence
            lone = sum(spoken[a:b]) == 1 and spoken[b - 1] and any(k == kind and x == a for k, x, _ in detect(number[: b - 1]))
            if any(spoken[a:b]) and not lone:
                out.append((kind, *r.source(run.start() + begin[a], run.start() + end[b - 1])))
    return out


def _real_ats(text: str) -> list[tuple[int, int, str]]:
    """Edits of the disguised signs between a local part and a real domain."""
    edits = [(m.start(), m.end(), "@") for m in _SET_OFF.finditer(text)] if "@" in text else []
    if _AT_HINT.search(text):
        edits += [(m.start(3), m.end(3), "@") for m in _REAL_AT.finditer(text) if m[1] or _NO_WORD.match(m[2])]
    return sorted(edits)


def _join_addresses(r: Rewritten) -> None:
    r.apply([(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETED.finditer(r.text)])
    r.apply([(m.start(), m.end(), ".") for m in _NUMBER_DOT.finditer(r.text)])
    r.apply([(m.start(), m.end(), "@") for m in _PLAIN_AT.finditer(r.text)])
    r.apply(_real_ats(r.text))
    # spelled dots of the domain, right of each sign
    edits: dict[int, tuple[int, int, str]] = {}
    at = r.text.find("@")
    while at >= 0:
        pos = at + 1
        while m := _ATOM_RUN.match(r.text, pos):
            pos = m.end()
            if d := _DOT_AFTER.match(r.text, pos):
                edits[d.start()] = (d.start(), d.end(), ".")
                pos = d.end()
            elif r.text.startswith(".", pos):
                pos += 1
            else:
                break
        at = r.text.find("@", at + 1)
    r.apply([edits[k] for k in sorted(edits)])
    # spelled dots of the local part, left of each sign; a sign ends the walk, so all walks together are linear
    found, last, at = [], 0, r.text.find("@")
    while at >= 0:
        back, pos, own = r.text[last:at][::-1], 0, []
        while m := _ATOM_RUN.match(back, pos):
            pos = m.end()
            if d := _DOT_BEFORE.match(back, pos):
                own.append((at - d.end(), at - d.start(), "."))
                pos = d.end()
            elif back.startswith(".", pos):
                pos += 1
            else:
                break
        found += reversed(own)
        last, at = at + 1, r.text.find("@", at + 1)
    r.apply(found)


def _triggers(text: str) -> tuple[bool, bool, bool, bool]:
    fold = not text.isascii() and (_FOLDABLE.search(text) is not None or any(m[0] in FOLDED for m in _ASTRAL.finditer(text)))
    low = text.lower()
    # a number of SPELLED_LEAST items shows as one item less in a row here, as its last may have a mark attached
    items = bytes(map(_ITEMS.__contains__, low.replace("-", " ").replace(",", " ").split()))
    spoken = any(w in low for w in DOT_WORDS) or _BRACKETED.search(text) is not None or bool(_real_ats(text))
    # an identifier with a digit word has it beside another item, a dot or a plus
    words = _TOKEN.findall(low.replace("_", " ").replace("+", " plus "))
    said = bytes(map(_DIGIT_WORDS.__contains__, words))
    read = b"\1" in said
    if read:
        beside = bytes(w in _DIGIT_WORDS or w in _RUN_WORDS or w.isdigit() for w in words)
        read = any(said[i] and b"\1" in beside[max(0, i - 1) : i] + beside[i + 1 : i + 2] for i in range(len(words)))
    return fold, b"\1" * (SPELLED_LEAST - 1) in items, spoken, read


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(plain spans, all spans), each by kind and start."""
    plain = detect(text)
    fold, spelled, spoken, read = _triggers(text)
    if not (fold or spelled or spoken or read):
        return plain, plain
    r = Rewritten(text)
    if fold:
        _fold_characters(r)
    told = _numbers(r) if read or fold else []
    if spelled or fold:
        _read_digits(r)
    if spoken or fold:
        _join_addresses(r)
    if not (r.changed or told):
        return plain, plain
    if r.changed:
        changed = sorted(set(r.changed))
        starts, most = [a for a, _ in changed], max(b - a for a, b in changed)
        for kind, a, b in detect(r.text):
            a, b = r.source(a, b)
            i = bisect_left(starts, a - most)
            hit = False
            while i < len(changed) and changed[i][0] < b:
                hit = hit or changed[i][1] > a
                i += 1
            if hit:
                told.append((kind, a, b))
    # a plain span counts in any case, another one where none before it covers it
    spans = set(plain)
    for kind in KINDS:
        reach = 0
        for own, a, b in sorted({*plain, *told}, key=lambda s: (s[1], -s[2])):
            if own == kind:
                if b > reach:
                    spans.add((kind, a, b))
                reach = max(reach, b)
    return plain, sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _spans_array(rows: list[list[tuple[str, int, int]]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in rows], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))


def find_spans(df: DataFrame, text_col: str = "text", plain_col: str = "plain_spans", spans_col: str = "spans") -> DataFrame:
    """``df`` with the plain spans and all spans of every whole text, as arrays of (kind, start, end)."""

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        found = [find(t) for t in strings(part, text_col)]
        return [_spans_array([p for p, _ in found]), _spans_array([s for _, s in found])]

    return annotate(df, compute, [T.StructField(plain_col, _SPAN), T.StructField(spans_col, _SPAN)], text_col)


def redact_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every finding in ``text_col`` replaced by its kind; a null text stays null."""
    fields = [f for f in df.schema.fields if f.name == text_col]

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
        return [pa.array([t and redact(t, find(t)[1]) for t in texts], pa.string())]

    return annotate(df, compute, fields, text_col).select(*df.columns)
