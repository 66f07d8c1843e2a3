"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern and each match is encoded on its own. Bytes are mapped to
Latin-1 characters so that a pyahocorasick automaton over the vocabulary finds, in one pass, the longest
token at every byte. Encoding walks those longest matches and backtracks to shorter ones while two
neighbouring tokens are incompatible, i.e. while the merge rules would not leave them side by side.
Compatibility of a pair is memoised; together with a mark on byte positions known to be dead ends this
visits each (position, token) once, so time is linear in the length.

Units of text (a blank-led stretch without another blank) recur, so their ids are kept in a two-generation table
bounded in bytes, within a text too; the table only saves time and never alters a result. Long texts are cut into
units a segment at a time, and decoding holds a few hundred thousand ids' places at a time.

Results for special input: a null or empty text has no ids and decodes to the empty byte string;
ids outside the vocabulary raise ``ValueError``; a null id list decodes like an empty one.
"""

from __future__ import annotations

import base64
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm.textkit import annotate, forget_between_tasks, strings

#: Bytes of each of the two generations of the unit table, and of the pairs' memo in entries.
CACHE_BYTES, CACHE_PAIRS = 48 << 20, 120_000
#: Units that are looked up at a time, characters of text that are cut into units at a time, and ids decoded at a time.
STEP, SEGMENT, DECODED = 8192, 1 << 17, 1 << 17
#: What an entry of a table takes besides its characters, about.
ENTRY_BYTES = 170


class GenerationCache:
    """A map of at most about twice ``limit`` bytes that forgets entries not used for a while: when the younger half is full,
    the older one goes."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old, self.size = limit, {}, {}, 0

    def get(self, key):
        found = self.young.get(key)
        return self.old.get(key) if found is None else found

    def add(self, key, value) -> None:
        """Remember one more; what is too much for the map is not."""
        own = len(key) + len(value) + ENTRY_BYTES
        if self.size + own <= 2 * self.limit:
            self.young[key] = value
            self.size += own

    def fill(self, keys: list, make) -> list:
        """The values of ``keys``; ``make`` gets the distinct absent keys and returns their values."""
        if len(keys) > STEP:
            return [v for at in range(0, len(keys), STEP) for v in self.fill(keys[at : at + STEP], make)]
        absent, fresh = set(keys).difference(self.young), {}
        if absent:
            fresh = {k: v for k, v in zip(absent, map(self.old.get, absent), strict=True) if v is not None}
            absent.difference_update(fresh)
            fresh.update(zip(absent, make(list(absent)), strict=True))
        young = self.young
        found = [fresh[k] if k in fresh else young[k] for k in keys] if fresh else list(map(young.__getitem__, keys))
        for k, v in fresh.items():
            self.add(k, v)
        if self.size > self.limit:
            self.young, self.old, self.size = {}, young, 0
        return found


class Vocabulary:
    """The bytes of every id: all that decoding needs."""

    def __init__(self, ranks: dict[bytes, int]):
        bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            bytes_of[rank] = token
        self.sizes = np.array([len(t) for t in bytes_of], np.int64)
        self.table, self.starts = np.frombuffer(b"".join(bytes_of), np.uint8), np.cumsum(self.sizes) - self.sizes

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes)):
            raise ValueError("id outside the vocabulary")
        return self.sizes[ids]

    def decode(self, ids) -> bytes:
        """The bytes of all ids one after the other; the gather's index is built for some ids at a time."""
        out, ids = [], np.asarray(ids)
        for at in range(0, len(ids), DECODED):
            part = ids[at : at + DECODED]
            own = self.lengths(part)
            ends = np.cumsum(own)
            out.append(self.table[np.arange(int(ends[-1])) + np.repeat(self.starts[part] - ends + own, own)].tobytes())
        return b"".join(out)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file in tiktoken's format."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in lines}


class ByteBpe:
    """Exact encoder and decoder for ranks in tiktoken's file format."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.pattern = regex.compile(pattern)
        self.odd_blank = regex.compile(r" (?:\s|$)")
        self.lone_blank = regex.compile(r"(?<=\S) (?=\S)")
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        self.automaton.make_automaton()
        self.sizes = [len(t) for t in self.bytes_of]
        #: for each token the longest token that it properly begins with, or -1
        self.shorter = [next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ranks), -1) for t in self.bytes_of]
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.fits_memo: dict[int, bool] = {}
        self._learn_merges()
        self.cache = GenerationCache(CACHE_BYTES)

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        return cls(read_ranks(path), pattern)

    def _learn_merges(self) -> None:
        """For every token the two tokens whose merge makes it: the one cut that lower merges leave standing."""
        for rank, token in enumerate(self.bytes_of):
            if len(token) < 2:
                continue
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None and a < rank and b < rank and self._stand_side_by_side(a, b, rank):
                    self.parts[rank], self.merged[a, b] = (a, b), rank
                    break

    def _stand_side_by_side(self, left: int, right: int, bound: int) -> bool:
        """Whether merging the bytes of both under merges below ``bound`` ends in exactly these two tokens.

        Undo the later of the two tokens step by step; a merge across the border that comes earlier than
        the step just undone would have been applied before it.
        """
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < bound:
                return False
            if left > right:
                split = self.parts.get(left)
                if split is not None:
                    bound, left = left, split[1]
                    continue
                split = self.parts.get(right)
                if split is None:
                    return True
                bound, right = right + 1, split[0]
            else:
                split = self.parts.get(right)
                if split is not None:
                    bound, right = right + 1, split[0]
                    continue
                split = self.parts.get(left)
                if split is None:
                    return True
                bound, left = left, split[1]

    def fits(self, left: int, right: int) -> bool:
        if len(self.fits_memo) > CACHE_PAIRS:
            self.fits_memo.clear()
        known = self.fits_memo[left << 32 | right] = self._stand_side_by_side(left, right, len(self.bytes_of))
        return known

    def encode_piece(self, piece: bytes) -> array:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return array("i", [whole])
        n = len(piece)
        longest = array("i", [-1]) * n
        for end, (before, rank) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - before] = rank  # matches come by rising end: the last one of a start is its longest
        sizes, shorter, memo = self.sizes, self.shorter, self.fits_memo
        # dead marks the positions from which no path leads on
        dead = bytearray(n + 1)
        path = array("i")
        at, token, last = 0, longest[0], -1
        while True:
            while token >= 0:
                if not dead[at + sizes[token]]:
                    if last < 0:
                        break
                    fits = memo.get(last << 32 | token)
                    if fits is None:
                        fits = self.fits(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                path.append(token)
                at += sizes[token]
                if at == n:
                    return path
                token, last = longest[at], token
            else:
                if not path:
                    raise ValueError("bytes outside the vocabulary")
                dead[at] = 1
                token = path.pop()
                at -= sizes[token]
                token, last = shorter[token], path[-1] if path else -1

    def segments(self, text: str):
        """Stretches of about SEGMENT characters, cut before single blanks, where the pattern cuts in any case."""
        at = 0
        while len(text) - at > SEGMENT and (m := self.lone_blank.search(text, at + SEGMENT)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def units(self, text: str) -> list[str]:
        """Parts of a text at whose edges the pattern always cuts; joined, they are the text."""
        if not text:
            return []
        if self.odd_blank.search(text):
            return self.pattern.findall(text)
        parts = text.split(" ")
        out = [" " + p for p in parts]
        out[0] = parts[0]
        return out if parts[0] else out[1:]

    def _encode_units(self, units: list[str]) -> list[bytes]:
        out, cut, one, cache = [], self.pattern.finditer, self.encode_piece, self.cache
        for u in units:
            ids = []
            for m in cut(u):
                piece = m[0]
                if len(piece) == len(u):
                    ids.append(one(piece.encode()).tobytes())
                    break
                known = cache.get(piece)
                if known is None:
                    known = one(piece.encode()).tobytes()
                    cache.add(piece, known)
                ids.append(known)
            out.append(b"".join(ids))
        return out

    def encode(self, text: str) -> np.ndarray:
        made = [b"".join(self.cache.fill(self.units(part), self._encode_units)) for part in self.segments(text)]
        return np.frombuffer(made[0] if len(made) == 1 else b"".join(made), np.int32)


_LOADED: dict[tuple, ByteBpe | Vocabulary] = forget_between_tasks({})


def tokenizer(path: str, pattern: str) -> ByteBpe:
    """The encoder of this process; its tables are bounded."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe.load(path, pattern)
    return _LOADED[path, pattern]


def vocabulary(path: str) -> Vocabulary:
    if (path,) not in _LOADED:
        _LOADED[path,] = Vocabulary(read_ranks(path))
    return _LOADED[path,]


def _lists(made: list[np.ndarray]) -> pa.Array:
    offs = np.zeros(len(made) + 1, np.int32)
    np.cumsum([len(x) for x in made], out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(made) if made else np.zeros(0, np.int32)))


def encode_documents(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the token ids of every whole text. One pass over the rows, no shuffle."""

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        bpe = tokenizer(path, pattern)
        return [_lists([bpe.encode(t) for t in strings(part, text_col)])]

    return annotate(df, compute, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], text_col)


def decode_documents(df: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes that every id list stands for."""

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        words, lists = vocabulary(path), part.column(part.schema.get_field_index(ids_col))
        return [pa.array([words.decode(ids) for ids in _rows(lists)], pa.binary())]

    return annotate(df, compute, [T.StructField(bytes_col, T.BinaryType())], ids_col)


def _rows(lists: pa.Array):
    """The id arrays of a list column; null is empty."""
    flat, at = lists.flatten().to_numpy(zero_copy_only=False), 0
    for n in lists.value_lengths().fill_null(0).to_pylist():
        yield flat[at : at + n]
        at += n


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded", without: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the ids of every whole text and the bytes that those ids decode to, both made in one pass: one Python process a
    task instead of two. Columns in ``without`` are left out."""

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        bpe, words = tokenizer(path, pattern), vocabulary(path)
        ids = [bpe.encode(t) for t in strings(part, text_col)]
        return [_lists(ids), pa.array([words.decode(x) for x in ids], pa.binary())]

    return annotate(df, compute, [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(bytes_col, T.BinaryType())], text_col, without)
