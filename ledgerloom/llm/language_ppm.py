"""Language identification by prediction by partial matching.

For every language a variable-order byte context tree up to order ORDER is counted once on labelled text and
frozen. A symbol seen n times after a context that was followed N times by D different symbols costs
``-log2(n / (N + D))`` bits; an unseen one costs the escape ``-log2(D / (N + D))`` and is coded in the context one
byte shorter, down to a flat 8 bits. The language with the shortest exact code for the whole text wins.

Since statistics are frozen, the cost of a byte depends only on it and the ORDER bytes before: costs of all grams
that any language knows are tabulated for all languages together, and a gram that none knows escapes in all.

Fitted on a bounded sample: at most SAMPLE_DOCS whole labelled texts a language, in the order of a hash of their
identifier, and of those at most SAMPLE_BYTES bytes (the first text always counts). Prediction reads whole texts.

Results for special input: a null text or one without a letter gives ``und`` with score 0; without any labelled
row everything is ``und``; equal code lengths go to the language that sorts first; rows with a null label are
not learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerloom.llm.textkit import annotate, text_buffers

ORDER = 4
SAMPLE_DOCS, SAMPLE_BYTES = 300, 1 << 20
#: Bytes after which more text does not make the score more certain.
CERTAIN_BYTES = 64
_U = np.uint64


class Lookup:
    """Rows of numbers by 64-bit key: two hash tables, and a sorted list of what found no slot."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.keys, self.rows = keys, rows
        bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self.shift, rest, self.tables = _U(64 - bits), np.arange(len(keys), dtype=np.int32), []
        for mult in (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)):
            table = np.full(1 << bits, -1, np.int32)
            table[(keys[rest] * mult) >> self.shift] = rest
            rest = rest[table[(keys[rest] * mult) >> self.shift] != rest]
            self.tables.append((mult, table))
        order = np.argsort(keys[rest])
        self.rest, self.rest_keys = rest[order], keys[rest][order]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        mult, table = self.tables[0]
        out = table[(keys * mult) >> self.shift]
        bad = np.flatnonzero((self.keys[out] != keys) | (out < 0))
        mult, table = self.tables[1]
        left = keys[bad]
        second = table[(left * mult) >> self.shift]
        second[(self.keys[second] != left) | (second < 0)] = -1
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest_keys, left), len(self.rest) - 1)
            second = np.where((second < 0) & (self.rest_keys[at] == left), self.rest[at], second)
        out[bad] = second
        return out


def _grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For every byte, it and the ORDER bytes before it in its row (zero before the start), the byte itself lowest."""
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    at = np.arange(len(data)) + ORDER * (rows + 1)
    padded = np.zeros(len(data) + ORDER * len(offs), _U)
    padded[at] = data
    wide = padded.copy()
    for lag in range(1, ORDER + 1):
        wide[lag:] |= padded[:-lag] << _U(8 * lag)
    return wide[at]


class PpmModel:
    def __init__(self, languages: list[str], grams: list[Lookup], escapes: list[Lookup]):
        self.languages, self.grams, self.escapes = languages, grams, escapes

    @classmethod
    def fit(cls, texts: dict[str, list[str]]) -> PpmModel:
        languages = sorted(texts)
        seen = []
        for name in languages:
            raw = [t.encode() for t in texts[name]]
            offs = np.zeros(len(raw) + 1, np.int64)
            np.cumsum([len(x) for x in raw], out=offs[1:])
            seen.append(_grams(np.frombuffer(b"".join(raw), np.uint8), offs))
        model, n = cls(languages, [], []), len(languages)
        for order in range(ORDER + 1):
            counted = [np.unique(g & _U((1 << 8 * (order + 1)) - 1), return_counts=True) for g in seen]
            keys = np.unique(np.concatenate([k for k, _ in counted])) if n else np.zeros(0, _U)
            contexts = np.unique(keys >> _U(8))
            escape, cost = np.zeros((len(contexts), n), np.float32), model._lower(keys, order - 1)
            for i, (own, count) in enumerate(counted):
                at = np.searchsorted(contexts, own >> _U(8))
                total, kinds = np.bincount(at, count, len(contexts)), np.bincount(at, minlength=len(contexts))
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape[:, i] = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0)
                cost[:, i] += escape[np.searchsorted(contexts, keys >> _U(8)), i]
                cost[np.searchsorted(keys, own), i] = -np.log2(count / (total + kinds)[at])
            model.grams.append(Lookup(keys, cost))
            model.escapes.append(Lookup(contexts, escape))
        return model

    def _lower(self, grams: np.ndarray, order: int) -> np.ndarray:
        """Bits of each gram's last byte for every language, coded from ``order`` downwards."""
        n = len(self.languages)
        if order < 0:
            return np.full((len(grams), n), 8, np.float32)
        grams = grams & _U((1 << 8 * (order + 1)) - 1)
        at = self.grams[order].find(grams)
        out = self.grams[order].rows[at] if len(self.grams[order].keys) else np.zeros((len(grams), n), np.float32)
        new = np.flatnonzero(at < 0)
        if len(new):
            low = self._lower(grams[new], order - 1)
            ctx = self.escapes[order].find(grams[new] >> _U(8))
            known = ctx >= 0
            low[known] += self.escapes[order].rows[ctx[known]]
            out[new] = low
        return out

    def code_lengths(self, data: np.ndarray, offs: np.ndarray, block: int = 1 << 17) -> np.ndarray:
        """Bits of every row's text under every language; ``block`` bytes at a time, within a text too."""
        out = np.zeros((len(offs) - 1, len(self.languages)))
        for a in range(0, len(data), block):
            at = np.arange(a, min(a + block, len(data)))
            rows = np.searchsorted(offs, at, "right") - 1
            place, grams = at - offs[rows], data[at].astype(_U)
            for lag in range(1, ORDER + 1):
                grams |= np.where(place >= lag, data[at - lag], 0).astype(_U) << _U(8 * lag)
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            out[rows[first]] += np.add.reduceat(self._lower(grams, ORDER), first, axis=0, dtype=np.float64)
        return out


def fit_model(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> PpmModel:
    """Fit on the labelled rows of ``df`` (callers hold rows out by filtering)."""
    rows = df.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("l")).where("t is not null and l is not null")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    # a hash band a language that holds the sample for sure, so that ranking sorts few rows
    order, band = F.xxhash64("i", "t"), F.lit(False)
    for name, n in counts.items():
        share = min(1.0, 4 * SAMPLE_DOCS / n)
        band = band | ((F.col("l") == name) & (F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
    few = rows.where(band).withColumn("o", order).withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("o", "i")))
    few = few.where(F.col("k") <= SAMPLE_DOCS).withColumn("b", F.sum(F.octet_length("t")).over(Window.partitionBy("l").orderBy("k")))
    picked = few.where((F.col("b") <= SAMPLE_BYTES) | (F.col("k") == 1)).select("l", "t").collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r["l"], r["t"])):
        texts.setdefault(r["l"], []).append(r["t"])
    return PpmModel.fit(texts)


_MODELS: dict[int, PpmModel] = {}


def predict(df: DataFrame, model: PpmModel, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``df`` with the predicted language of every whole text and a score from 0 to 1: the language's share of the
    likelihood under equal priors, code lengths scaled to CERTAIN_BYTES bytes at most."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE_BYTES a language

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        import regex

        letter, m = regex.compile(r"\p{L}").search, shared.value
        column = part.column(part.schema.get_field_index(text_col))
        data, offs = text_buffers(column)
        if not m.languages:
            return [pa.array(["und"] * len(column)), pa.array([0.0] * len(column))]
        bits, size = m.code_lengths(data, offs), np.diff(offs)
        best = bits.argmin(axis=1)
        gap = (bits - bits.min(axis=1, keepdims=True)) * np.minimum(1, CERTAIN_BYTES / np.maximum(size, 1))[:, None]
        score = 1 / np.exp2(-gap).sum(axis=1)
        spoken = [bool(t) and letter(t) is not None for t in column.to_pylist()]
        return [pa.array([m.languages[b] if s else "und" for b, s in zip(best, spoken, strict=True)], pa.string()), pa.array(np.where(spoken, score, 0.0))]

    return annotate(df, compute, [T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())], text_col)
