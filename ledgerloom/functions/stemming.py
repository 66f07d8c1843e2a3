"""Stems of English words by Porter's algorithm (1980, with the two endings that its author added), and folding of marks on letters."""

from __future__ import annotations

import re
import unicodedata

# The algorithm's endings and what takes their place, by step.
_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), "")
_ENDINGS = [re.compile(rf"(?:{'|'.join(sorted(s, key=len, reverse=True))})$") for s in (_STEP_2, _STEP_3, _STEP_4)]
_ASCII = re.compile("[a-z]{3,}").fullmatch


def _shape(word: str) -> str:
    """v for a vowel, c for a consonant; y is a vowel after a consonant."""
    out = ""
    for x in word:
        out += "v" if x in "aeiou" or (x == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c", _shape(word)))


def _vowel(word: str) -> bool:
    return "v" in _shape(word)


def _short_end(word: str) -> bool:
    """consonant, vowel, consonant other than w, x and y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def porter(word: str) -> str:
    """The stem of a word of small ASCII letters; other words and those of one or two letters stay."""
    if not _ASCII(word):
        return word
    w = word
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (m := re.search("(?:ed|ing)$", w)) and _vowel(w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")) or (_measure(w) == 1 and _short_end(w) and not _double(w)):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for endings, table, least in ((_ENDINGS[0], _STEP_2, 1), (_ENDINGS[1], _STEP_3, 1), (_ENDINGS[2], _STEP_4, 2)):
        m = endings.search(w)
        if m and _measure(w[: m.start()]) >= least and (m[0] != "ion" or w[: m.start()].endswith(("s", "t"))):
            w = w[: m.start()] + table[m[0]]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def index_term(word: str) -> str:
    """A lower-case word as the index has it: marks on letters left out, then stemmed."""
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    return porter(word)


_KNOWN: dict[str, str] = {}
_KNOWN_MOST = 200_000


def known_terms(words: list[str]) -> list[str]:
    """``index_term`` of each word, remembered between calls."""
    if len(_KNOWN) > _KNOWN_MOST:
        _KNOWN.clear()
    for w in words:
        if w not in _KNOWN:
            _KNOWN[w] = index_term(w)
    return [_KNOWN[w] for w in words]
