"""Benchmark decontamination by SimHash of item-sized windows.

A document is contaminated by an item if a window of as many words as the item has a weighted Jaccard similarity of
SIMILARITY or more with it. Sets are multisets of 5-word shingles (A-Z as a-z); a shingle weighs the bytes of its words, so
that a run of long words tells more than one of function words.

1. Windows without any shingle of an item of their size have similarity 0 with all of them and are passed over; this loses nothing.
2. Every other window gets a SimHash of FINGERPRINT bits. Fingerprints are cut into BLOCKS blocks of 16 bits, and each block's
   table lists, under every 16-bit value within NEAR bits of an item's, that item. Two fingerprints within RADIUS bits agree in some
   block up to NEAR bits, so looking up a window's blocks gives all items within the radius; the exact distance drops the rest.
   Of unrelated fingerprints 16 % share such a block, and next to none is within the radius.
3. Exact weighted similarity verifies the candidates. A document reports each item once, at its best window.

At the threshold similarity the expected distance is 44 to 48 bits with a deviation of 6; RADIUS is 63.

The benchmark is broadcast in blocks of at most about ITEM_BLOCK items and ITEM_BYTES bytes. If it is one block, documents are
read once, in place. Else a bitmap of fixed size over all its shingles first picks the distinct texts that have one; these
are written, and only they are searched block by block, each broadcast being dropped before the next. Weights depend on a shingle
alone, so blocks don't change results.

Results for special input: null, empty or blank texts and items match nothing; a document shorter than an item is one
window; an item of fewer than 5 words is one shingle, found wherever its words stand in a row; equal rows report
alike; null identifiers are reported as null; empty tables give no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.textkit import annotate, forget_between_tasks, mix, text_buffers, tidy, window_hashes, word_hashes, word_spans, workspace, written

SHINGLE, SIMILARITY = 5, 0.75
FINGERPRINT, BLOCKS, NEAR = 256, 16, 3
#: Beyond this distance all blocks may differ by more than NEAR bits.
RADIUS = BLOCKS * (NEAR + 1) - 1
ITEM_BLOCK, ITEM_BYTES = 500, 4 << 20
_FILTER_BITS, _BITMAP_BITS, _SLOT_BITS = 22, 27, 19
_SALTS = (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D)
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
_MASKS = np.array([v for v in range(1 << 16) if v.bit_count() <= NEAR], np.uint32)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """One row of FINGERPRINT numbers +1 or -1 a shingle."""
    parts = [(mix(shingles ^ np.uint64(salt))[:, None] & _BIT) > 0 for salt in _SALTS]
    return np.concatenate(parts, axis=1).astype(np.float64) * 2 - 1


def _blocks(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of BLOCKS numbers of 16 bits."""
    return np.packbits(sums > 0, axis=1).reshape(len(sums), BLOCKS, 2).astype(np.uint32) @ np.array([256, 1], np.uint32)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _shingle_weights(data: np.ndarray) -> np.ndarray:
    """Bytes of the words of each window of SHINGLE words (of all words, if fewer) of one text."""
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    total = np.concatenate(([0], np.cumsum(ends - starts)))
    k = min(SHINGLE, len(starts))
    return (total[k:] - total[: len(total) - k]).astype(np.float64) if k else np.zeros(0)


class BenchmarkIndex:
    """Items of one block of the benchmark, their shingles and the multi-index of their fingerprints."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        kept = [(i, t.encode()) for i, t in items if (t or "").encode().split()]
        self.ids = [i for i, _ in kept]
        self.size, self.own, self.counts, self.total, sums = [], [], [], [], []
        for _, raw in kept:
            data = np.frombuffer(raw, np.uint8)
            words, _ = word_hashes(data, np.array([0, len(data)]), fold=True)
            own, weights = window_hashes(words, min(SHINGLE, len(words))), _shingle_weights(data)
            self.size.append(len(words))
            self.own.append(own)
            self.counts.append(dict(zip(*(x.tolist() for x in np.unique(own, return_counts=True)), strict=True)))
            self.total.append(float(weights.sum()))
            sums.append((_signs(own) * weights[:, None]).sum(axis=0))
        self.size = np.array(self.size, np.int64)
        self.prints = _blocks(np.stack(sums)) if kept else np.zeros((0, BLOCKS), np.uint32)
        flat = np.concatenate([np.unique(s) for s in self.own]) if kept else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(kept)), [len(np.unique(s)) for s in self.own])
        order = np.argsort(flat, kind="stable")
        self.known, self.begin, counts = np.unique(flat[order], return_index=True, return_counts=True)
        self.owner, self.end = owner[order], self.begin + counts
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.known >> np.uint64(64 - _FILTER_BITS)] = True
        #: for each block the values near an item's, ascending, under the item's size, and whose they are
        self.tables = []
        for b in range(BLOCKS):
            keys = (self._sized(self.size)[:, None] | (self.prints[:, b][:, None] ^ _MASKS[None, :])).reshape(-1)
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], (order // len(_MASKS)).astype(np.int32)))
        self.short = {int(n): {int(self.own[i][0]): i for i in reversed(np.flatnonzero(self.size == n).tolist())} for n in range(1, SHINGLE) if (self.size == n).any()}

    @staticmethod
    def _sized(size) -> np.ndarray:
        """The high half of a table's keys; sizes over 16 bits share one, and are told apart by the exact size."""
        return np.minimum(np.asarray(size), 65535).astype(np.uint32) << np.uint32(16)

    def near(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of items of this size within RADIUS bits: by the multi-index, then the exact distance."""
        pairs = []
        for b, (keys, items) in enumerate(self.tables):
            wanted = prints[:, b] | self._sized(size)
            lo, hi = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
            n = hi - lo
            rows = np.repeat(np.arange(len(prints)), n)
            places = np.arange(int(n.sum())) - (np.cumsum(n) - n)[rows] + lo[rows]
            pairs.append(rows << 32 | items[places])
        both = np.unique(np.concatenate(pairs))
        w, i = both >> 32, both & 0xFFFFFFFF
        ok = (self.size[i] == size) & (_distance(prints[w], self.prints[i]) <= RADIUS)
        return w[ok], i[ok]

    def similarity(self, item: int, shingles: np.ndarray, weights: np.ndarray) -> float:
        """Weighted Jaccard similarity of a window's shingles with an item's."""
        own, both, every = self.counts[item], 0.0, self.total[item]
        seen: dict[int, int] = {}
        for s, w in zip(shingles.tolist(), weights.tolist(), strict=True):
            k = seen[s] = seen.get(s, 0) + 1
            if k <= own.get(s, 0):
                both += w
            else:
                every += w
        return both / every if every else 0.0

    def search(self, data: np.ndarray, words: np.ndarray, shingles: np.ndarray, hits: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        """(item, similarity, start, words, distance) of one document; ``hits`` are its places with a benchmark shingle."""
        best: dict[int, tuple[float, int, int, int]] = {}
        at = np.searchsorted(self.known, shingles[hits])
        by_size: dict[int, list[int]] = {}
        for place, k in zip(hits.tolist(), at.tolist(), strict=True):
            for size in {int(self.size[item]) for item in self.owner[self.begin[k] : self.end[k]].tolist()}:
                by_size.setdefault(size, []).append(place)
        weighed = _shingle_weights(data) if by_size else None
        for size, places in by_size.items():
            if size < SHINGLE:
                continue
            size_here, places = min(size, len(words)), np.array(places)
            span = size_here - SHINGLE + 1
            edge = np.zeros(len(words) + 2, np.int64)
            np.add.at(edge, np.maximum(places - span + 1, 0), 1)
            np.add.at(edge, np.minimum(places, len(words) - size_here) + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            for a in range(0, len(starts), 2048):
                own = starts[a : a + 2048]
                # what lies between the windows of this step is left out of the sums
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(own) > span) + 1, [len(own)]))
                for c, d in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    self._search_windows(best, own[c:d], span, size, size_here, shingles, weighed)
        for size, table in self.short.items():
            for place, h in enumerate(window_hashes(words, size).tolist()):
                if h in table and table[h] not in best:
                    same = [i for i in np.flatnonzero(self.size == size).tolist() if int(self.own[i][0]) == h]
                    best.update({i: (1.0, place, size, 0) for i in same})
        return [(i, *best[i]) for i in sorted(best)]

    def _search_windows(self, best: dict, own: np.ndarray, span: int, size: int, size_here: int, shingles: np.ndarray, weighed: np.ndarray) -> None:
        base, top = int(own[0]), int(own[-1]) + span
        part, weights = shingles[base:top], weighed[base:top]
        sums = np.zeros((len(part) + 1, FINGERPRINT))
        np.cumsum(_signs(part) * weights[:, None], axis=0, out=sums[1:])
        prints = _blocks(sums[own - base + span] - sums[own - base])
        for w, item in zip(*(x.tolist() for x in self.near(prints, size)), strict=True):
            s = int(own[w])
            value = self.similarity(item, part[s - base : s - base + span], weights[s - base : s - base + span])
            if value >= SIMILARITY and value > best.get(item, (0.0,))[0]:
                best[item] = (value, s, size_here, int(_distance(prints[w : w + 1], self.prints[item : item + 1])[0]))

    def search_batch(self, column: pa.Array) -> list[list[tuple]]:
        data, offs = text_buffers(column)
        words, first = word_hashes(data, offs, fold=True)
        shingles, out = window_hashes(words, SHINGLE), [[] for _ in range(len(column))]
        if not self.ids:
            return out
        ends = first[1:]
        maybe = np.flatnonzero(self.filter[shingles >> np.uint64(64 - _FILTER_BITS)])
        at = np.minimum(np.searchsorted(self.known, shingles[maybe]), len(self.known) - 1)
        hits = maybe[self.known[at] == shingles[maybe]]
        row = np.searchsorted(ends, hits, "right")
        inside = hits + SHINGLE <= ends[np.minimum(row, len(ends) - 1)] if len(hits) else np.zeros(0, bool)
        hits, row = hits[inside], row[inside]
        rows = range(len(column)) if self.short else np.unique(row).tolist()
        for r in rows:
            a, b = int(first[r]), int(first[r + 1])
            if b > a:
                lo, hi = np.searchsorted(row, r), np.searchsorted(row, r, "right")
                out[r] = self.search(data[offs[r] : offs[r + 1]], words[a:b], shingles[a : max(a, b - SHINGLE + 1)], hits[lo:hi] - a)
        return out


_MATCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("words", T.LongType()), T.StructField("distance", T.LongType())])
_MATCH_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int64()), ("words", pa.int64()), ("distance", pa.int64())]))
_BUILT: dict[str, BenchmarkIndex] = forget_between_tasks({})


def _index(name: str, items: list) -> BenchmarkIndex:
    """The index of a broadcast block, built once a process; only the last one is kept."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = BenchmarkIndex(items)
    return _BUILT[name]


def _search(df: DataFrame, items: list, text_col: str, matches_col: str):
    """``df`` with its matches with one block of items, and the broadcast."""
    shared, name = df.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        index = _index(name, shared.value)
        found = index.search_batch(part.column(part.schema.get_field_index(text_col)))
        rows = [[{"item_id": index.ids[i], "similarity": s, "start": at, "words": n, "distance": d} for i, s, at, n, d in r] for r in found]
        return [pa.array(rows, _MATCH_ARROW)]

    return annotate(df, compute, [T.StructField(matches_col, T.ArrayType(_MATCH))], text_col), shared


def _bitmap_slots(batches):
    """Item texts to parts of a bitmap of their shingles."""
    bits = np.zeros(1 << _BITMAP_BITS - 3, np.uint8)
    for batch in batches:
        words, first = word_hashes(*text_buffers(batch.column(0)), fold=True)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b > a:
                at = window_hashes(words[a:b], min(SHINGLE, b - a)) >> np.uint64(64 - _BITMAP_BITS)
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    slots = bits.reshape(-1, 1 << _SLOT_BITS - 3)
    used = np.flatnonzero(slots.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([slots[i].tobytes() for i in used.tolist()], pa.binary())], names=["slot", "bits"])


def _united(table: pa.Table) -> pa.Table:
    bits = np.zeros(1 << _SLOT_BITS - 3, np.uint8)
    for raw in table.column("bits"):
        bits |= np.frombuffer(raw.as_py(), np.uint8)
    return pa.table({"slot": table.column("slot").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})


def _with_bitmap(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of (h, g, text) that have a shingle of some item, and some others."""
    slots = items.select("t").mapInArrow(tidy(_bitmap_slots), "slot int, bits binary").groupBy("slot").applyInArrow(tidy(_united), "slot int, bits binary")
    bits = np.zeros((1 << _BITMAP_BITS - _SLOT_BITS, 1 << _SLOT_BITS - 3), np.uint8)  # 16 MB, whatever the benchmark
    for r in slots.collect():
        bits[r["slot"]] = np.frombuffer(r["bits"], np.uint8)
    sizes = [n for n in range(1, SHINGLE) if not items.where(F.size(F.array_remove(F.split("t", "[ \\t-\\r]+"), "")) == n).isEmpty()]
    shared = docs.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    def pick(batches):
        for batch in batches:
            words, first = word_hashes(*text_buffers(batch.column(2)), fold=True)
            hit = np.zeros(len(words), bool)
            for n in [*sizes, SHINGLE]:
                at = window_hashes(words, n) >> np.uint64(64 - _BITMAP_BITS)
                hit[: len(at)] |= (shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            total = np.concatenate(([0], np.cumsum(hit)))
            yield batch.filter(pa.array(total[first[1:]] > total[first[:-1]]))

    return docs.mapInArrow(tidy(pick), docs.schema)


def with_matches(df: DataFrame, benchmark: DataFrame, id_col: str = "item_id", item_text_col: str = "text", text_col: str = "text", matches_col: str = "matches", folder: str | None = None) -> DataFrame:
    """``df`` with the array of its matches with the benchmark."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t"))
    count, volume = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    blocks = max(1, -(-count // ITEM_BLOCK), -(-volume // ITEM_BYTES))
    if blocks == 1:
        return _search(df, sorted(map(tuple, items.collect()), key=str), text_col, matches_col)[0]
    folder = folder or workspace(df.sparkSession)
    text = F.col(text_col).cast("string")
    named = {"h": F.xxhash64(text), "g": F.xxhash64(F.lit(1), text)}
    docs = _with_bitmap(df.select(*[v.alias(k) for k, v in named.items()], text.alias("text")), items)
    docs = written(docs.dropDuplicates(["h", "g"]), folder, "candidates")
    items = written(items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))).repartition("block"), folder, "items")
    found = None
    for b in range(blocks):
        told, shared = _search(docs, sorted(map(tuple, items.where(F.col("block") == b).select("i", "t").collect()), key=str), "text", "m")
        own = written(told.where(F.size("m") > 0).select("h", "g", "m"), folder, f"matches-{b}")
        shared.destroy()
        found = own if found is None else found.union(own)
    whole = found.groupBy(F.col("h").alias("_h"), F.col("g").alias("_g")).agg(F.flatten(F.collect_list("m")).alias(matches_col))
    keyed = df.drop(matches_col).withColumns({f"_own_{k}": v for k, v in named.items()})
    joined = keyed.join(whole, (F.col("_own_h") == F.col("_h")) & (F.col("_own_g") == F.col("_g")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != matches_col], F.coalesce(matches_col, F.array().cast(T.ArrayType(_MATCH))).alias(matches_col))


def matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document and item that it holds: (doc_id, item_id, similarity, start, words, distance)."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_matches(docs, benchmark).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def drop_matching(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that hold no item."""
    return with_matches(df, benchmark, text_col=text_col, matches_col="_matches").where(F.size("_matches") == 0).select(*df.columns)
