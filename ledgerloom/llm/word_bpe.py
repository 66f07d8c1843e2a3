"""BPE encoding and decoding for vocabularies with word ends, by batched merge rounds.

The symbols of many words lie in one flat array. In a round every word merges its lowest-ranked pair, at all its places:
ranks of neighbouring symbols come from a binary search over the sorted pair keys, the lowest one of each word from a segmented minimum.
Only pairs beside a merge are looked up again, and words without a pair left leave the array. Merging all places of one rank
in one round is exact where a merge that uses a token ranks after the merge that makes it, which is checked on load.

In a word of more than ``LONG`` symbols one pair a round would take as many rounds as it has ranks. There a pair is merged as soon as no
pair within the longest token's length on either side ranks before it: what happens farther off in lower ranks makes one token at most that reaches
into that stretch, and no token is so long that it comes to the pair. So long words take few rounds too.

Words recur, so their ids are kept in a table bounded in bytes (of ``byte_bpe``); the table only saves time. Texts are cut at ASCII white space,
over which neither the normaliser nor the pre-tokenizer of such a file reaches (compared on load with the known steps); of other files
whole texts go through the library's own steps, and the merging is the same. Words of ASCII and composed small Latin-1 letters are normalised and
cut here, all others by the library's normaliser and pre-tokenizer.

Results for special input: a null or empty text, or one of white space only, has no ids and decodes to the empty text; a control token's
string in a text is that token, as in the library; symbols outside the vocabulary are left out, as the library does without an unknown token;
ids outside the vocabulary are left out in decoding; a null id list decodes like an empty one; an empty table gives an empty table; other columns stay,
but one with the name of a new column is replaced. A file whose model isn't plain BPE raises ``ValueError``.
"""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm.byte_bpe import GenerationCache, _lists, _rows
from ledgerloom.llm.textkit import annotate, forget_between_tasks, strings

#: Words that are looked up and merged together, and characters of a text that are cut into words at a time.
BATCH, SEGMENT = 1 << 15, 1 << 18
#: Symbols from which a word is merged by windows, and symbols that one call of the merge rounds takes, about.
LONG, FLAT = 256, 1 << 20
CACHE_BYTES = 24 << 20
_NONE = np.iinfo(np.int32).max

# The normaliser and pre-tokenizer under which a text can be cut at white space.
STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
_LETTERS = rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+"
_PLAIN = re.compile(rb"(?:[\x00-\x7f]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|%b|[0-9]|(?:[^a-z0-9\xc3]|\xc3(?![\x9f-\xb6\xb8-\xbf]))+" % _LETTERS).findall
_BLANK = re.compile(r"[ \t\n\r\f\v]")


def byte_characters() -> str:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
    return "".join(chr(others.get(b, b)) for b in range(256))


class MergeTable:
    """Pairs of symbols and the ranks of their merges, and the merging of many words at once."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        ranks = np.arange(len(merges))
        first = np.full(max(vocab.values(), default=0) + 1, _NONE, np.int64)
        last = np.full(len(first), -1, np.int64)
        np.minimum.at(first, left, ranks)
        np.minimum.at(first, right, ranks)
        np.maximum.at(last, made, ranks)
        if (first <= last).any():
            raise ValueError("a merge uses a token that a later merge makes")
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        # of a pair that is listed twice the last merge counts, as in a map that is filled in order
        keep = np.append(np.diff(keys[order]) != 0, True) if len(keys) else np.zeros(0, bool)
        self.keys, self.ranks, self.made = keys[order][keep], ranks[order][keep].astype(np.int32), made
        self.reach = max((len(t) for t in vocab), default=1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, by binary search; ``_NONE`` where nothing merges it."""
        if not len(self.keys):
            return np.full(len(left), _NONE, np.int32)
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], np.int32(_NONE))

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids that the words' symbols end in, all in one flat array, and where each word starts (words + 1)."""
        sizes = np.diff(starts)
        long = sizes > LONG
        if not long.any() and len(symbols) <= FLAT:
            return self._rounds(symbols, sizes, False)
        parts, owners = [], []
        for own, near in ((np.flatnonzero(~long), False), (np.flatnonzero(long), True)):
            total, at = np.cumsum(sizes[own]), 0
            while at < len(own):
                to = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + FLAT, "right")), at + 1)
                some = own[at:to]
                ids, ends = self._rounds(np.concatenate([symbols[starts[w] : starts[w + 1]] for w in some]), sizes[some], near)
                parts.append(ids)
                owners.append(np.repeat(some, np.diff(ends)))
                at = to
        return _by_word(np.concatenate(owners), np.concatenate(parts), len(sizes))

    def _rounds(self, flat: np.ndarray, sizes: np.ndarray, near: bool) -> tuple[np.ndarray, np.ndarray]:
        flat, n = flat.astype(np.int64), len(sizes)
        word = np.repeat(np.arange(n), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        # ranks[i] is that of the pair (i, i + 1); none at the end of a word
        ranks = np.full(len(flat), _NONE, np.int32)
        inside = np.flatnonzero(word[:-1] == word[1:])
        ranks[inside] = self.rank(flat[inside], flat[inside + 1])
        while len(flat):
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(ranks, begin)
            over = lowest == _NONE
            if over.any():
                span = np.diff(np.append(begin, len(flat)))
                gone = np.repeat(over, span)
                done.append((word[gone], flat[gone]))
                flat, word, ranks, lowest, span = flat[~gone], word[~gone], ranks[~gone], lowest[~over], span[~over]
                if not len(flat):
                    break
            else:
                span = np.diff(np.append(begin, len(flat)))
            chosen = (ranks != _NONE) & (ranks == (self._lowest_near(ranks) if near else np.repeat(lowest, span)))
            at = self._apart(ranks, chosen)
            flat[at] = self.made[ranks[at]]
            stay = np.ones(len(flat), bool)
            stay[at + 1] = False
            ranks[at] = ranks[at + 1]  # the pair behind, looked up again below
            moved = np.cumsum(stay) - 1
            flat, word, ranks, at = flat[stay], word[stay], ranks[stay], moved[at]
            again = np.unique(np.concatenate((at, at[at > 0] - 1)))
            again = again[again < len(flat) - 1]
            same = word[again] == word[again + 1]
            ranks[again[~same]] = _NONE
            again = again[same]
            ranks[again] = self.rank(flat[again], flat[again + 1])
            ranks[-1] = _NONE
        if not done:
            return flat, np.zeros(n + 1, np.int64)
        return _by_word(np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done]), n)

    def _lowest_near(self, ranks: np.ndarray) -> np.ndarray:
        """The lowest rank within ``reach`` pairs on either side; over a word's end too, which only makes it stricter."""
        low, size = ranks, 1
        whole = 2 * self.reach + 1
        padded = np.concatenate((np.full(self.reach, _NONE, np.int32), ranks, np.full(self.reach, _NONE, np.int32)))
        low = padded
        while size * 2 <= whole:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        rest = whole - size
        return np.minimum(low[: len(ranks)], low[rest : rest + len(ranks)])

    def _apart(self, ranks: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Places of the chosen pairs that are merged: of pairs of one rank side by side every second one from the first, and all of such a run
        wait until all of it is chosen."""
        n = len(ranks)
        fresh = np.append(True, ranks[1:] != ranks[:-1])
        run = np.cumsum(fresh) - 1
        head = np.flatnonzero(fresh)
        whole = np.logical_and.reduceat(chosen, head)
        return np.flatnonzero(chosen & whole[run] & ((np.arange(n) - head[run]) % 2 == 0))


def _by_word(owner: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in the order of their words, and where each of the ``n`` words starts."""
    ends = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=n), out=ends[1:])
    return ids[np.argsort(owner, kind="stable")], ends


class WordBpe:
    """Exact encoder and decoder for a BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        told = json.loads(Path(path).read_text())
        model = told["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or told["post_processor"] or told["decoder"]:
            raise ValueError(f"{path} holds no plain BPE model")
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.by_words = (told["normalizer"], told["pre_tokenizer"]) == STEPS
        if "ByteLevel" not in json.dumps(told["pre_tokenizer"]):
            raise ValueError(f"{path} has no byte-level alphabet")
        vocab = model["vocab"]
        self.table = MergeTable(vocab, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        letters = byte_characters()
        self.back = {c: b for b, c in enumerate(letters)}
        #: symbol of each byte inside a word and at its end, -1 where the vocabulary has none
        self.inner, self.last = (np.array([vocab.get(c + end, -1) for c in letters], np.int64) for end in ("", model.get("end_of_word_suffix") or ""))
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"]):
            raise ValueError(f"{path} has added tokens that aren't matched as they are")
        self.special = special
        self.find_special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        texts = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in special.items()}}
        raw = [b"%b " % texts[i].encode() if i in texts else b"" for i in range(max(texts, default=-1) + 1)]
        self.sizes = np.array([len(t) for t in raw], np.int64)
        self.letters, self.places = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(self.sizes) - self.sizes
        self.cache = GenerationCache(CACHE_BYTES)

    # --- texts to words -------------------------------------------------------------------------------------------------------

    def _stretches(self, text: str):
        """Lists of words of one text: bytes without ASCII white space, or a control token behind a blank."""
        at = 0
        found = self.find_special.finditer(text) if self.find_special and any(s in text for s in self.special) else ()
        for m in found:
            yield from self._plain(text[at : m.start()])
            yield [b" " + m[0].encode()]
            at = m.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str):
        if not self.by_words:
            if text:
                yield [text.encode()]
            return
        at = 0
        while len(text) - at > SEGMENT and (m := _BLANK.search(text, at + SEGMENT)):
            yield text[at : m.start()].encode().lower().split()
            at = m.end()
        yield (text[at:] if at else text).encode().lower().split()

    # --- words to ids ---------------------------------------------------------------------------------------------------------

    def _pieces(self, word: bytes) -> list[bytes]:
        """The parts that the pre-tokenizer makes of one word."""
        if self.by_words and _PLAIN(word):
            return _PIECES(word)
        text = word.decode()
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        return [bytes(map(self.back.__getitem__, p)) for p, _ in self.pre_tokenizer.pre_tokenize_str(text)]

    def _merge_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each distinct word as bytes: one batch of merge rounds for all."""
        pieces, counts, controls = [], [], {}
        for w, word in enumerate(words):
            if word[:1] == b" ":
                controls[w] = np.array([self.special[word[1:].decode()]], np.int32).tobytes()
                counts.append(0)
            else:
                own = self._pieces(word)
                pieces += own
                counts.append(len(own))
        ends = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(list(map(len, pieces)), out=ends[1:])
        codes = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.inner[codes]
        symbols[ends[1:] - 1] = self.last[codes[ends[1:] - 1]]
        if len(symbols) and symbols.min() < 0:
            kept = np.append(0, np.cumsum(symbols >= 0))
            symbols, ends = symbols[symbols >= 0], kept[ends]
        ids, ends = self.table.merge(symbols, ends)
        raw, cuts = ids.astype(np.int32).tobytes(), (ends[np.append(0, np.cumsum(counts, dtype=np.int64))] * 4).tolist()
        out = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for w, ids in controls.items():
            out[w] = ids
        return out

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        cache = self.cache
        young, old, fresh = cache.young, cache.old, {}
        absent = []
        for w in set(words).difference(young):
            known = old.get(w)
            if known is None:
                absent.append(w)
            else:
                fresh[w] = known
        fresh.update(zip(absent, self._merge_words(absent), strict=True))
        found = [fresh[w] if w in fresh else young[w] for w in words]
        for w, ids in fresh.items():
            cache.add(w, ids)
        if cache.size > cache.limit:
            cache.young, cache.old, cache.size = {}, young, 0
        return found

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; the words of many texts are looked up and merged together."""
        found: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[bytes]]] = []
        size = 0

        def settle():
            ids, at = self._ids_of([w for _, ws in waiting for w in ws]), 0
            for text, ws in waiting:
                found[text].append(b"".join(ids[at : at + len(ws)]))
                at += len(ws)
            waiting.clear()

        for k, text in enumerate(texts):
            for words in self._stretches(text):
                if words:
                    waiting.append((k, words))
                    size += len(words)
                if size >= BATCH:
                    settle()
                    size = 0
        settle()
        return [np.frombuffer(b"".join(parts), np.int32) for parts in found]

    def decode(self, ids) -> bytes:
        """The tokens of all known ids, joined by blanks: what a file without a decoder decodes to, in UTF-8."""
        ids, out = np.asarray(ids, np.int64), []
        ids = ids[(ids >= 0) & (ids < len(self.sizes))]
        for at in range(0, len(ids), 1 << 17):
            part = ids[at : at + (1 << 17)]
            own = self.sizes[part]
            ends = np.cumsum(own)
            out.append(self.letters[np.arange(int(ends[-1])) + np.repeat(self.places[part] - ends + own, own)].tobytes())
        return b"".join(out)[:-1]


_LOADED: dict[str, WordBpe] = forget_between_tasks({})


def tokenizer(path: str) -> WordBpe:
    """The encoder of this process; its tables are bounded."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_documents(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the token ids of every whole text. One pass over the rows, no shuffle."""

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        return [_lists(tokenizer(path).encode_all(strings(part, text_col)))]

    return annotate(df, compute, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], text_col)


def decode_documents(df: DataFrame, path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``df`` with the text that every id list decodes to, control tokens included."""

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        bpe, lists = tokenizer(path), part.column(part.schema.get_field_index(ids_col))
        return [pa.array([bpe.decode(ids).decode() for ids in _rows(lists)], pa.string())]

    return annotate(df, compute, [T.StructField(decoded_col, T.StringType())], ids_col)


def round_trip(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", without: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the ids of every whole text and the text that those ids decode to, in one pass. Columns in ``without`` are left out."""

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        bpe = tokenizer(path)
        ids = bpe.encode_all(strings(part, text_col))
        return [_lists(ids), pa.array([bpe.decode(x).decode() for x in ids], pa.string())]

    return annotate(df, compute, [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(decoded_col, T.StringType())], text_col, without)
