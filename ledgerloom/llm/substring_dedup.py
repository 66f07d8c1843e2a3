"""Removal of passages that occur elsewhere, by fixed-block anchors.

A window is WINDOW words of one document. With blocks of BLOCK words, WINDOW = 2 * BLOCK - 1, every window holds exactly
one block of its document's fixed, non-overlapping grid. So of two equal windows at different places, the grid block in
one is met, at the same offset, by a rolling window of BLOCK words in the other.

1. Anchors. All rolling BLOCK-word windows probe the index of grid blocks: both go, packed as arrays, to hash
   buckets. A hash with a grid block and a second occurrence is live, and every occurrence of it is a hit.
2. Extension. Only windows around a hit can occur twice. Their full hashes meet in buckets in the same way and those
   seen twice or more are repeats. Consecutive and overlapping repeats are merged: the maximal exact repeats.
3. Words covered by a repeat are removed.

A map task packs some thousand documents as a chunk and sends each distinct hash of it to the hash's bucket once; what the chunk
has several times is marked so, and the list of its places goes straight to where the chunk's replies meet. So a passage in a third of
all documents is one entry a chunk, and nothing is paired. Anchors compare by 37 or more bits (a false hit only adds windows to
step 2), windows by 63 bits and more.

Results for special input: a null or empty text has no words and keeps the empty text; a text with fewer words than a
window keeps all of them; equal rows are occurrences elsewhere, so both lose their windows; an empty table gives no rows;
other columns are ignored. Kept words are joined by one space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.textkit import mix, power_of_two, release, slices, text_buffers, text_volume, tidy, window_hashes, word_hashes, workspace, written

WINDOW, BLOCK = 35, 18
FLUSH_WINDOWS, FLUSH_DOCS, BUCKET_TEXT = 1_500_000, 100_000, 8 << 20

_PACKED = "bucket int, chunk long, kind int, hashes binary, gaps binary, docs binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("hashes", pa.binary()), ("gaps", pa.binary()), ("docs", pa.binary())])
#: Kinds of packed rows: a chunk's documents; entries of a bucket; places that are hits for sure; places that share an entry.
DOCUMENTS, ENTRIES, SURE, SHARED = range(4)
_PLACES_ARROW = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("places", pa.binary())])
_PLACES = "doc_id long, h long, places binary"


def _packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PACKED_ARROW.types, strict=True)], schema=_PACKED_ARROW)


def _gaps(at: np.ndarray) -> bytes:
    """Ascending places as gaps: a byte for their width, then the gaps."""
    gaps = np.diff(at, prepend=0)
    return b"\2" + gaps.astype(np.uint16).tobytes() if not len(gaps) or gaps.max() < 1 << 16 else b"\4" + gaps.astype(np.uint32).tobytes()


def _places(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint16 if raw[0] == 2 else np.uint32, offset=1), dtype=np.int64)


def _send(chunk_docs: np.ndarray, hashes: np.ndarray, grid: np.ndarray | None, buckets: int, place: int):
    """Rows of one chunk: its document table, and for every bucket its distinct hashes and the first place of each. An entry's lowest
    bit tells whether the chunk has it several times; for anchors, the next one whether one of them is a grid block. Places of
    a hash that is live within the chunk are sure hits; other places of one hash share its entry. A chunk is named by its content and
    its place in the input (partition, and number in it)."""
    bits, anchors = buckets.bit_length() - 1, grid is not None
    with np.errstate(over="ignore"):
        weights = np.arange(1, 2 * chunk_docs.size, 2, dtype=np.uint64)
        content = mix(chunk_docs.reshape(-1).view(np.uint64) * weights).sum(dtype=np.uint64)
        chunk = int(mix(np.array([content]) ^ mix(np.array([place], np.uint64)))[0].view(np.int64))
    own = buckets + chunk % buckets
    rows = [(own, chunk, DOCUMENTS, b"", b"", chunk_docs.tobytes())]
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    heads = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    counts = np.diff(np.append(heads, len(ranked)))
    several = counts > 1
    on_grid = np.add.reduceat(grid[order].astype(np.int64), heads) > 0 if anchors else np.ones(len(heads), bool)
    sure, shared = np.repeat(several & on_grid, counts), np.repeat(several & ~on_grid, counts)
    if sure.any():
        rows.append((own, chunk, SURE, b"", _gaps(np.sort(order[sure])), b""))
    if shared.any():
        rows.append((own, chunk, SHARED, counts[several & ~on_grid].astype(np.uint32).tobytes(), order[shared].astype(np.uint32).tobytes(), b""))
    first, h = order[heads], ranked[heads]
    entry = ((h & np.uint64(0x3FFFFFFF)) << np.uint64(2) | on_grid.astype(np.uint64) << np.uint64(1) | several).astype(np.uint32) if anchors else h & ~np.uint64(1) | several
    # distinct hashes in the order of their first places, which then ascend within each bucket
    by_place = np.argsort(first, kind="stable")
    first, h, entry = first[by_place], h[by_place], entry[by_place]
    bucket = (h >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    first, entry, at = first[order], entry[order], 0
    for b, to in enumerate(np.cumsum(np.bincount(bucket, minlength=buckets)).tolist()):
        if to > at:
            rows.append((b, chunk, ENTRIES, entry[at:to].tobytes(), _gaps(first[at:to]), b""))
        at = to
        if len(rows) >= 32:
            yield _packed_batch(rows)
            rows = []
    if rows:
        yield _packed_batch(rows)


def _send_anchors(buckets: int):
    """Step 1, map side, over (doc_id, h, text)."""

    def flush(held, place):
        docs, hashes, grid = (np.concatenate([h[i] for h in held]) for i in range(3))
        held.clear()
        yield from _send(docs, hashes, grid, buckets, place)

    def run(batches):
        held, size, docs, chunk = [], 0, 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words, first = word_hashes(*text_buffers(part.column(2)))
                counts = np.diff(first)
                own = np.flatnonzero(counts >= WINDOW)
                if not len(own):
                    continue
                hashes, n = window_hashes(words, BLOCK), counts[own] - BLOCK + 1
                rows = np.repeat(np.arange(len(own)), n)
                place = np.arange(int(n.sum())) - (np.cumsum(n) - n)[rows]
                hashes = hashes[first[own][rows] + place]
                ids, null = part.column(0).fill_null(0), np.array(part.column(0).is_null(), np.int64)
                table = np.stack([np.array(ids, np.int64)[own], np.array(part.column(1), np.int64)[own], n, null[own]], axis=1)
                held.append((table, hashes, place % BLOCK == 0))
                size, docs = size + len(hashes), docs + len(own)
                if size >= FLUSH_WINDOWS or docs >= FLUSH_DOCS:
                    yield from flush(held, chunk)
                    held, size, docs, chunk = [], 0, 0, chunk + 1
        if held:
            yield from flush(held, chunk)

    return run


def _send_windows(buckets: int):
    """Step 2, map side, over (doc_id, h, z, places): hashes of the windows that hold a hit."""
    import zstandard

    def flush(held, place):
        docs, hashes = (np.concatenate([h[i] for h in held]) for i in range(2))
        held.clear()
        yield from _send(docs, hashes, None, buckets, place)

    def run(batches):
        held, size, unpack, chunk = [], 0, zstandard.ZstdDecompressor(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, h, z, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = np.frombuffer(unpack.decompress(z), np.uint8)
                words, _ = word_hashes(data, np.array([0, len(data)]))
                n = len(words) - WINDOW + 1
                edge = np.zeros(n + 1, np.int64)
                hits = np.frombuffer(raw, np.uint32).astype(np.int64)
                np.add.at(edge, np.clip(hits - (WINDOW - BLOCK), 0, n), 1)
                np.add.at(edge, np.minimum(hits + 1, n), -1)
                starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                if not len(starts):
                    continue
                # one row of the table a run of starts: (id, h, first start, number, null id)
                new = np.flatnonzero(np.diff(starts, prepend=-2) > 1)
                runs = np.diff(np.append(new, len(starts)))
                key = np.array([[doc_id or 0, h, 0, 0, doc_id is None]], np.int64)
                table = np.repeat(key, len(new), axis=0)
                table[:, 2], table[:, 3] = starts[new], runs
                held.append((table, window_hashes(words, WINDOW)[starts]))
                size += len(starts)
                if size >= FLUSH_WINDOWS // 2:
                    yield from flush(held, chunk)
                    held, size, chunk = [], 0, chunk + 1
        if held:
            yield from flush(held, chunk)

    return run


def _live(buckets: int, anchors: bool):
    """A bucket: replies to each chunk with the first places of its hashes that are live (anchors) or occur twice."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket >= buckets:
            return table
        raws = table.column("hashes").to_pylist()
        hashes = [np.frombuffer(x, np.uint32 if anchors else np.uint64) for x in raws]
        flat = np.concatenate(hashes)
        drop = flat.dtype.type(2 if anchors else 1)
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        name = ranked >> drop
        heads = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        sizes, one = np.diff(np.append(heads, len(name))), flat.dtype.type(1)
        good = (sizes > 1) | (np.add.reduceat((ranked & one).astype(np.int64), heads) > 0)
        if anchors:
            good &= np.add.reduceat((ranked >> one & one).astype(np.int64), heads) > 0
        hit = np.empty(len(flat), bool)
        hit[order] = np.repeat(good, sizes)
        out, at = [], 0
        for chunk, own, raw in zip(table.column("chunk").to_pylist(), hashes, table.column("gaps").to_pylist(), strict=True):
            mine = np.flatnonzero(hit[at : at + len(own)])
            if len(mine):
                out.append((bucket, chunk, ENTRIES, b"", _gaps(_places(raw)[mine]), b""))
            at += len(own)
        cols = list(zip(*out, strict=True)) if out else [()] * len(_PACKED_ARROW)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, _PACKED_ARROW.types, strict=True)], schema=_PACKED_ARROW)

    return run


def _gather(anchors: bool):
    """The replies to a chunk as places in its documents: hit words (anchors), or (start, end) words of merged repeats."""

    def run(table: pa.Table) -> pa.Table:
        docs, places, shared = None, [], None
        for kind, hashes, gaps, raw in zip(*(table.column(c).to_pylist() for c in ("kind", "hashes", "gaps", "docs")), strict=True):
            if kind == DOCUMENTS:
                docs = np.frombuffer(raw, np.int64).reshape(-1, 4 if anchors else 5)
            elif kind == SHARED:
                shared = np.frombuffer(gaps, np.uint32).astype(np.int64), np.frombuffer(hashes, np.uint32).astype(np.int64)
            else:
                places.append(_places(gaps))
        if docs is None:
            raise RuntimeError("a chunk has no document table")
        at = np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)
        if shared is not None:
            held, counts = shared
            at = np.union1d(at, held[np.repeat(np.isin(held[np.cumsum(counts) - counts], at), counts)])
        size = docs[:, 2] if anchors else docs[:, 3]
        begin = np.cumsum(size) - size
        row = np.searchsorted(begin, at, "right") - 1
        word = at - begin[row] + (0 if anchors else docs[row, 2])
        rows = np.arange(len(docs))
        if not anchors:  # runs of one document stand together
            same = np.concatenate(([False], (docs[1:, [0, 1, 4]] == docs[:-1, [0, 1, 4]]).all(axis=1) & (docs[1:, 2] > docs[:-1, 2])))
            rows = np.cumsum(~same) - 1
        owner = rows[row] if len(row) else row
        cuts = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner)) if len(owner) else np.zeros(0, np.int64)
        out = ([], [], [])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            doc, own = docs[row[a]], word[a:b]
            if not anchors:
                new = np.flatnonzero(np.diff(own, prepend=-WINDOW - 1) > WINDOW)
                own = np.stack([own[new], np.append(own[new[1:] - 1], own[-1]) + WINDOW], axis=1).reshape(-1)
            out[0].append(None if doc[-1] else int(doc[0]))
            out[1].append(int(doc[1]))
            out[2].append(own.astype(np.uint32).tobytes())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, _PLACES_ARROW.types, strict=True)], schema=_PLACES_ARROW)

    return run


def _compressed(batches):
    """(doc_id, h, text) with the text as compressed bytes: the shuffles carry less than half."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        z = pa.array([pack.compress((t or "").encode()) for t in batch.column(2).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), z], names=["doc_id", "h", "z"])


def _cut(batches):
    """(doc_id, z, places) to (doc_id, n_words, n_removed, kept, repeats)."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows, size = ([], [], [], [], []), 0
        for doc_id, z, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = unpack.decompress(z).split()
            spans = np.frombuffer(raw, np.uint32).reshape(-1, 2).tolist() if raw else []
            kept, at = [], 0
            for a, b in spans:
                kept += words[at:a]
                at = b
            kept += words[at:]
            text = b" ".join(kept).decode()
            for c, v in zip(rows, (doc_id, len(words), len(words) - len(kept), text, [{"start": a, "end": b} for a, b in spans]), strict=True):
                c.append(v)
            size += len(text)
            if size > 4 << 20:
                yield _cut_batch(rows)
                rows, size = ([], [], [], [], []), 0
        if rows[0]:
            yield _cut_batch(rows)


_CUT = "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<start: int, end: int>>"


def _cut_batch(rows):
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["doc_id", "n_words", "n_removed", "kept", "repeats"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """One row a document: (doc_id, n_words, n_removed, kept, repeats), the latter the maximal repeats as word spans."""
    spark = df.sparkSession
    folder = folder or workspace(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))
    buckets = power_of_two(text_volume(docs, "text") / BUCKET_TEXT, 128, 1 << 20)
    same = lambda other: (F.col("d.doc_id").eqNullSafe(F.col(f"{other}.doc_id"))) & (F.col("d.h") == F.col(f"{other}.h"))

    def places(packed: DataFrame, anchors: bool, name: str) -> DataFrame:
        replies = packed.groupBy("bucket").applyInArrow(tidy(_live(buckets, anchors)), _PACKED)
        found = replies.groupBy("chunk").applyInArrow(tidy(_gather(anchors)), _PLACES)
        table = written(found, folder, name)
        return table.groupBy("doc_id", "h").agg(F.first("places").alias("places"))  # equal rows have equal places

    hits = places(docs.mapInArrow(tidy(_send_anchors(buckets)), _PACKED), True, "hits")
    release(spark)
    compact = docs.mapInArrow(tidy(_compressed), "doc_id long, h long, z binary")
    around = compact.alias("d").join(hits.alias("p"), same("p")).select("d.doc_id", "d.h", "z", "places")
    windows = around.sortWithinPartitions("doc_id", "h").mapInArrow(tidy(_send_windows(buckets)), _PACKED)
    repeats = places(windows, False, "repeats")
    release(spark)
    joined = compact.alias("d").join(repeats.alias("p"), same("p"), "left").select("d.doc_id", "z", "places")
    return joined.mapInArrow(tidy(_cut), _CUT)

