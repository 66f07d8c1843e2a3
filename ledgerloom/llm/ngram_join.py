"""N-gram Jaccard self join by grouped prefixes.

A document is its set of distinct word shingles; two documents link at Jaccard similarity THRESHOLD or more.

1. Document frequencies. A chunk is some thousand documents of one task. Of its distinct shingles, each goes to its hash
   bucket once, whoever holds it, packed as arrays: those of one document with that document, those of several with
   their count, while the list of holders goes straight to where the chunk is put together again. So a shingle in a third of all
   documents is one entry a chunk. A bucket sums the counts and replies with what two or more documents share; a shingle
   of one document can't be in any intersection. A document with too many such lone shingles can't reach the threshold.
2. The rest are collapsed to distinct sets and ordered globally by (frequency, hash), rare first. By the prefix
   principle linked sets share a shingle within their prefixes.
3. Sets with identical prefix and size are one group. All groups with a prefix shingle in common are candidates if sizes, places
   and bitmaps permit; group pairs are expanded to members, and members verified exactly. A bitmap has the parities of a set's
   shingles by hash: two sets differ in at least as many shingles as bits, and linked sets in a seventh of their sizes' sum at most. Of a
   group those bits count in which all its members agree.
4. Pairs inside one component decide nothing, so the order of comparing matters: first, in a few prefix shingles' groups,
   every component's member meets one pivot, another one each round, for as long as many of these pairs link. Then all group
   pairs that are still of different components are expanded and verified.
5. Links of both kinds give the connected components.

A family of a thousand near copies so costs about a thousand pairs a round, not their square. Shingles are compared by 47 or
more bits of a 64-bit hash, so a wrong intersection needs a collision within one pair of sets.

Results for special input: a null, empty or blank text has an empty set and links with nothing; with fewer words than
a shingle the whole sequence is the one shingle; equal rows link like any copies; a null identifier takes part but is
never a component's name (a component of null identifiers only is named null); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import connected_components
from ledgerloom.llm.textkit import discard, mix, power_of_two, release, slices, text_buffers, text_volume, tidy, window_hashes, word_hashes, workspace, written

SHINGLE = 5
#: Links need 100 * intersection >= 75 * union, i.e. 7 * intersection >= 3 * (size + size).
LOW_BITS = 40
#: Shingles that a map task gathers before it sends them off, documents likewise, and bytes of text behind a bucket.
FLUSH_ENTRIES, FLUSH_DOCS, BUCKET_TEXT = 1_000_000, 50_000, 8 << 20
#: Prefix shingles of a set with a pivot; rounds of pivots end after so many, or when less than this share of their pairs links.
PIVOTS, ROUNDS, WORTH = 3, 8, 0.05
#: Words of 64 bits of a set's bitmap.
BITMAP = 4
_LOW = np.uint64((1 << LOW_BITS) - 1)


def document_shingles(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending within it, and their counts a row."""
    words, first = word_hashes(data, offs, fold=True)
    counts = np.diff(first)
    hashes = window_hashes(words, k)
    short = {}
    for n in range(1, k):
        rows = np.flatnonzero(counts == n)
        if len(rows):
            short.update(zip(rows.tolist(), window_hashes(words, n)[first[rows]], strict=True))
    out, sizes = [], np.zeros(len(counts), np.int64)
    for i, n in enumerate(counts.tolist()):
        if n >= k:
            s = np.sort(hashes[first[i] : first[i + 1] - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif n:
            s = np.array([short[i]], np.uint64)
        else:
            continue
        out.append(s)
        sizes[i] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def signatures(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits (two columns) that are equal for equal sets."""
    sums = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(mix(tokens ^ np.uint64(salt)), dtype=np.uint64, out=total[1:])
        ends = np.cumsum(sizes)
        sums.append(mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)))
    return np.stack(sums, axis=1)


def _pack_low(tokens: np.ndarray) -> bytes:
    return tokens.view(np.uint8).reshape(-1, 8)[:, : LOW_BITS // 8].tobytes()


def _unpack_low(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // (LOW_BITS // 8), 8), np.uint8)
    wide[:, : LOW_BITS // 8] = np.frombuffer(raw, np.uint8).reshape(-1, LOW_BITS // 8)
    return wide.reshape(-1).view(np.uint64)


_PACKED = "bucket int, chunk long, kind int, low binary, docs binary, extra binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("low", pa.binary()), ("docs", pa.binary()), ("extra", pa.binary())])
#: Kinds of packed rows: a chunk's documents; shingles of one document each; shingles of several with counts; the holders of the latter.
DOCUMENTS, SINGLE, SEVERAL, HOLDERS = range(4)
_DOCUMENT_FIELDS = 6


def _table(rows: list[tuple], schema: pa.Schema):
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return [pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)]


def _send_shingles(buckets: int):
    """Map side of step 1 over (doc_id, h, text). A chunk is named by its content and its place in the input (partition, and
    number in it): a repeated attempt gives it the same name, and equal rows elsewhere give another one."""
    bits = buckets.bit_length() - 1

    def split(tokens, values):
        """(bucket, the tokens' low bits, values) of ascending buckets; within one the order stays."""
        bucket = (tokens >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        low, values, at = (tokens & _LOW)[order], values[order], 0
        for b, to in enumerate(np.cumsum(np.bincount(bucket, minlength=buckets)).tolist()):
            if to > at:
                yield b, _pack_low(low[at:to]), values[at:to]
            at = to

    def flush(held, place):
        ids, null, texts, sizes, tokens = (np.concatenate([h[i] for h in held]) for i in range(5))
        held.clear()
        sigs, docs = signatures(tokens, sizes), np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
        with np.errstate(over="ignore"):
            content = mix((sigs[:, 0] ^ mix(ids.view(np.uint64))) * np.arange(1, 2 * len(ids), 2, dtype=np.uint64)).sum(dtype=np.uint64)
            chunk = int(mix(np.array([content]) ^ mix(np.array([place], np.uint64)))[0].view(np.int64))
        table = np.concatenate([ids.view(np.uint64)[:, None], sigs, sizes.astype(np.uint64)[:, None], null.astype(np.uint64)[:, None], texts.view(np.uint64)[:, None]], axis=1)
        own = buckets + chunk % buckets
        rows = [(own, chunk, DOCUMENTS, b"", b"", table.tobytes())]
        order = np.argsort(tokens, kind="stable")
        ranked = tokens[order]
        heads = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
        counts = np.diff(np.append(heads, len(ranked)))
        several = np.repeat(counts > 1, counts)
        if several.any():
            rows.append((own, chunk, HOLDERS, b"", docs[order[several]].tobytes(), counts[counts > 1].astype(np.uint32).tobytes()))
            rows += [(b, chunk, SEVERAL, low, b"", n.astype(np.uint32).tobytes()) for b, low, n in split(ranked[heads[counts > 1]], counts[counts > 1])]
        single = np.sort(order[~several])
        yield rows
        rows = []
        for b, low, mine in split(tokens[single], docs[single]):
            held_by = np.bincount(mine, minlength=len(sizes)).astype(np.uint32).tobytes() if len(mine) > 2 * len(sizes) else b""
            rows.append((b, chunk, SINGLE, low, b"" if held_by else mine.tobytes(), held_by))
            if len(rows) >= 64:
                yield rows
                rows = []
        yield rows

    def run(batches):
        held, entries, docs, place = [], 0, 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                column = part.column(0)
                tokens, sizes = document_shingles(*text_buffers(part.column(2)))
                held.append((np.array(column.fill_null(0), np.int64), np.array(column.is_null(), bool), np.array(part.column(1), np.int64), sizes, tokens))
                entries, docs = entries + len(tokens), docs + len(sizes)
                # a part has CHUNK_ROWS rows at most, so documents are numbered by 16 bits
                if entries >= FLUSH_ENTRIES or docs >= FLUSH_DOCS:
                    yield from (pa.RecordBatch.from_arrays(_table(r, _PACKED_ARROW), schema=_PACKED_ARROW) for r in flush(held, place) if r)
                    held, entries, docs, place = [], 0, 0, place + 1
        if held:
            yield from (pa.RecordBatch.from_arrays(_table(r, _PACKED_ARROW), schema=_PACKED_ARROW) for r in flush(held, place) if r)

    return run


def _count_bucket(buckets: int):
    """A bucket of step 1: replies to each chunk with its shared shingles and their frequencies."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket >= buckets:
            return table
        chunks, kinds, lows, docs, extra = (table.column(c).to_pylist() for c in ("chunk", "kind", "low", "docs", "extra"))
        low = np.concatenate([_unpack_low(x) for x in lows])
        sizes = [len(x) // (LOW_BITS // 8) for x in lows]
        weight = np.concatenate([np.frombuffer(x, np.uint32) if k == SEVERAL else np.ones(n, np.uint32) for k, x, n in zip(kinds, extra, sizes, strict=True)]).astype(np.int64)
        order = np.argsort(low, kind="stable")
        ranked = low[order]
        heads = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        frequency = np.empty(len(low), np.int64)
        frequency[order] = np.repeat(np.add.reduceat(weight[order], heads), np.diff(np.append(heads, len(ranked))))
        told = np.minimum(frequency, 65535).astype(np.uint16)
        out, at = [], 0
        for chunk, kind, own, held_by, n in zip(chunks, kinds, docs, extra, sizes, strict=True):
            to = at + n
            if kind == SEVERAL:
                out.append((bucket, chunk, SEVERAL, _pack_low(low[at:to]), b"", told[at:to].tobytes()))
            else:
                shared = np.flatnonzero(frequency[at:to] > 1)
                if len(shared):
                    c = np.frombuffer(held_by, np.uint32)
                    mine = np.repeat(np.arange(len(c), dtype=np.uint16), c) if len(c) else np.frombuffer(own, np.uint16)
                    out.append((bucket, chunk, SINGLE, _pack_low(low[at:to][shared]), mine[shared].tobytes(), told[at:to][shared].tobytes()))
            at = to
        return pa.Table.from_arrays(_table(out, _PACKED_ARROW), schema=_PACKED_ARROW)

    return run


_SETS = "doc_id long, h long, sig binary, n long, tokens binary, frequencies binary"
_SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("sig", pa.binary()), ("n", pa.int64()), ("tokens", pa.binary()), ("frequencies", pa.binary())])


def _gather_chunk(table: pa.Table) -> pa.Table:
    """The documents of a chunk, with their shared shingles (ascending) where these suffice for a link."""
    parts, several, holders, docs = ([], [], []), [], None, None
    for bucket, kind, low, own, extra in zip(*(table.column(c).to_pylist() for c in ("bucket", "kind", "low", "docs", "extra")), strict=True):
        if kind == DOCUMENTS:
            docs = np.frombuffer(extra, np.uint64).reshape(-1, _DOCUMENT_FIELDS)
        elif kind == HOLDERS:
            holders = np.frombuffer(own, np.uint16), np.frombuffer(extra, np.uint32)
        else:
            token, count = _unpack_low(low) | np.uint64(bucket << LOW_BITS), np.frombuffer(extra, np.uint16)
            if kind == SEVERAL:
                several.append((bucket, (token, count)))
            else:
                for part, x in zip(parts, (token, count, np.frombuffer(own, np.uint16)), strict=True):
                    part.append(x)
    if docs is None:
        raise RuntimeError("a chunk has no document table")
    if holders is not None:
        # one reply a bucket, in the order sent: by bucket they stand as their shingles did
        told = [x for _, x in sorted(several, key=lambda x: x[0])]
        n = holders[1]
        parts[0].append(np.repeat(np.concatenate([t for t, _ in told]), n))
        parts[1].append(np.repeat(np.concatenate([c for _, c in told]), n))
        parts[2].append(holders[0])
    size, n = docs[:, 3].astype(np.int64), len(docs)
    tokens, frequencies = [None] * n, [None] * n
    if parts[0]:
        token, count, own = (np.concatenate(p) for p in parts)
        order = np.lexsort((token, own))
        own, token, count = own[order], token[order], count[order]
        ends = np.cumsum(np.bincount(own, minlength=n))
        starts = ends - np.bincount(own, minlength=n)
        for i in np.flatnonzero((size > 0) & (ends - starts >= -(-3 * size // 4))).tolist():
            tokens[i], frequencies[i] = token[starts[i] : ends[i]].tobytes(), count[starts[i] : ends[i]].tobytes()
    raw = np.ascontiguousarray(docs[:, 1:3]).tobytes()
    ids = pa.array(docs[:, 0].astype(np.uint64).view(np.int64), mask=docs[:, 4] > 0)
    sigs = pa.array([raw[16 * i : 16 * i + 16] if s else None for i, s in enumerate(size.tolist())], pa.binary())
    cols = [ids, pa.array(docs[:, 5].astype(np.uint64).view(np.int64)), sigs, pa.array(size), pa.array(tokens, pa.binary()), pa.array(frequencies, pa.binary())]
    return pa.Table.from_arrays(cols, schema=_SETS_ARROW)


def _verify(batches):
    """Pairs of sets with their tokens (last four columns) to links: exact intersection."""
    for batch in batches:
        own = batch.num_columns - 4
        keep = []
        for i, (ta, tb, na, nb) in enumerate(zip(*(batch.column(own + j).to_pylist() for j in range(4)), strict=True)):
            if 4 * min(na, nb) < 3 * max(na, nb):
                continue
            a, b = np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64)
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            if 7 * int((b[at] == a).sum()) >= 3 * (na + nb):
                keep.append(i)
        yield batch.select(list(range(own))).take(pa.array(keep, pa.int64()))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b, ...) those that link. A set in very many pairs is one row of a join that Spark can split."""
    left = sets.select(F.col("sig").alias("a"), F.col("tokens").alias("ta"), F.col("n").alias("na"))
    right = sets.select(F.col("sig").alias("b"), F.col("tokens").alias("tb"), F.col("n").alias("nb"))
    both = pairs.join(right, "b").join(left, "a").select(*pairs.columns, "ta", "tb", "na", "nb")
    return both.mapInArrow(tidy(_verify), pairs.schema)


def _bitmap(tokens: np.ndarray) -> np.ndarray:
    """For each bit the parity of the number of shingles that fall on it."""
    odd = np.bincount((mix(tokens) >> np.uint64(56)).astype(np.int64), minlength=64 * BITMAP)[: 64 * BITMAP] & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_MEMBERS = "sig binary, grp binary, n long, lone long, prefix binary, keys array<long>, " + ", ".join(f"bits{i} long" for i in range(BITMAP))


def _prefixes(batches):
    """For each set its group's name, its prefix (the shared shingles, in global order) with the place of the first, the
    prefix shingles that get pivots (the least in a few random orders), and its bitmap."""
    salts = [np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1) for i in range(PIVOTS)]
    for batch in batches:
        sizes, tokens, frequencies = (batch.column(i).to_pylist() for i in (1, 2, 3))
        names, raws, lone, keys, bits = [], [], [], [], []
        for n, t, f in zip(sizes, tokens, frequencies, strict=True):
            t, f = np.frombuffer(t, np.uint64), np.frombuffer(f, np.uint16)
            alone, length = n - len(t), n - -(-3 * n // 4) + 1
            own = t[np.lexsort((t, f))[: max(0, length - alone)]]
            head = np.concatenate([np.array([n, alone], np.uint64), own])
            names.append(signatures(head * np.arange(1, 2 * len(head), 2, dtype=np.uint64), np.array([len(head)])).tobytes())
            raws.append(own.tobytes())
            lone.append(alone)
            bits.append(_bitmap(t))
            keys.append(sorted({int(own[np.argmin(mix(own ^ s))].view(np.int64)) for s in salts}))
        cols = [batch.column(0), pa.array(names, pa.binary()), batch.column(1), pa.array(lone, pa.int64()), pa.array(raws, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        bits = np.stack(bits) if bits else np.zeros((0, BITMAP), np.int64)
        cols += [pa.array(np.ascontiguousarray(bits[:, i])) for i in range(BITMAP)]
        yield pa.RecordBatch.from_arrays(cols, names=["sig", "grp", "n", "lone", "prefix", "keys", *[f"bits{i}" for i in range(BITMAP)]])


_POSTINGS = "token long, place long, grp binary, root binary, n long, lone long, " + ", ".join(f"{k}{i} long" for k in ("all", "any") for i in range(BITMAP))


def _explode_prefixes(batches):
    for batch in batches:
        for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
            lists = [np.frombuffer(x, np.uint64) for x in part.column(4).to_pylist()]
            sizes = np.array([len(x) for x in lists], np.int64)
            rows = np.repeat(np.arange(len(lists)), sizes)
            begin = np.cumsum(sizes) - sizes
            place = np.arange(int(sizes.sum())) - begin[rows] + np.array(part.column(3), np.int64)[rows]
            flat = (np.concatenate(lists) if lists else np.zeros(0, np.uint64)).view(np.int64)
            take = pa.array(rows)
            rest = [part.column(i).take(take) for i in (0, 1, 2, 3, *range(5, 5 + 2 * BITMAP))]
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(place), *rest], names=[f.split(" ")[0] for f in _POSTINGS.split(", ")])


def _bucket_pairs(table: pa.Table) -> pa.Table:
    """Candidate group pairs of one bucket of prefix shingles: sizes and places permitting, and not all of one component."""
    token = np.array(table.column("token"), np.int64)
    n, place = np.array(table.column("n"), np.int64), np.array(table.column("place"), np.int64)
    grp, grp_of = np.unique(np.array(table.column("grp").to_pylist(), object), return_inverse=True)
    # a group whose members are of several components has none (null) and differs from all
    one = np.array(table.column("root").is_valid())
    root = np.unique(np.array([x or b"" for x in table.column("root").to_pylist()], object), return_inverse=True)[1]
    root = np.where(one, root, -1 - grp_of)
    lone, everywhere, anywhere = np.array(table.column("lone"), np.int64), *(np.stack([np.array(table.column(f"{k}{i}"), np.int64).view(np.uint64) for i in range(BITMAP)], axis=1) for k in ("all", "any"))
    order = np.lexsort((n, token))
    token, n, place, g, root, lone, bits, sure = (x[order] for x in (token, n, place, grp_of, root, lone, everywhere, ~(everywhere ^ anywhere)))

    def alike(x: int, ys: np.ndarray) -> np.ndarray:
        """Those of ``ys`` whose bitmaps and lone shingles leave room for a link with ``x``."""
        apart = np.bitwise_count((bits[x] ^ bits[ys]) & sure[x] & sure[ys]).sum(axis=1, dtype=np.int64) + lone[x] + lone[ys]
        return ys[7 * apart <= n[x] + n[ys]]

    ends = np.append(np.flatnonzero(token[1:] != token[:-1]) + 1, len(token))
    found, at = [], 0
    for to in ends.tolist():
        if to - at > 1 and (root[at:to] != root[at]).any():
            ns, ps, gs, rs = n[at:to], place[at:to], g[at:to], root[at:to]
            # x is the smaller set and must hold the token in its shorter indexing prefix
            index = np.flatnonzero(ps <= ns - -(-6 * ns // 7))
            reach = np.searchsorted(ns, 4 * ns[index] // 3, "right")
            for x, last in zip(index.tolist(), reach.tolist(), strict=True):
                y = slice(x + 1, last)
                room = 1 + np.minimum(ns[x] - ps[x] - 1, ns[y] - ps[y] - 1)
                ok = alike(at + x, np.flatnonzero((rs[y] != rs[x]) & (7 * room >= 3 * (ns[x] + ns[y]))) + x + 1 + at) - at
                # equal sizes come in any order: the other may be the one that is indexed
                if len(ok):
                    a, b = np.minimum(gs[x], gs[ok]), np.maximum(gs[x], gs[ok])
                    found.append(a.astype(np.int64) << 32 | b)
            # sets of equal size where only the later one has the token in its indexing prefix
            for y in index.tolist():
                x0 = int(np.searchsorted(ns, ns[y], "left"))
                x = slice(x0, y)
                room = 1 + np.minimum(ns[x] - ps[x] - 1, ns[y] - ps[y] - 1)
                ok = alike(at + y, np.flatnonzero((rs[x] != rs[y]) & (7 * room >= 3 * (ns[x] + ns[y]))) + x0 + at) - at
                if len(ok):
                    a, b = np.minimum(gs[y], gs[ok]), np.maximum(gs[y], gs[ok])
                    found.append(a.astype(np.int64) << 32 | b)
            if sum(map(len, found)) > 1 << 22:
                found = [np.unique(np.concatenate(found))]
        at = to
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pa.table({"ga": pa.array([grp[i] for i in (pairs >> 32).tolist()], pa.binary()), "gb": pa.array([grp[i] for i in (pairs & 0xFFFFFFFF).tolist()], pa.binary())})


def _pivot_rounds(members: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """(node, root) of the sets that links with pivots connect."""
    keys, roots = written(members.select(F.explode("keys").alias("key"), "sig"), folder, "keys"), None
    for k in range(ROUNDS):
        named = keys.withColumn("root", F.col("sig")) if roots is None else keys.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("key", "sig", F.coalesce("root", "sig").alias("root"))
        # of a component one member a shingle is compared, another one each round; the pivot is of the largest
        speakers = named.groupBy("key", "root").agg(F.min_by("sig", F.xxhash64("sig", "key", F.lit(k))).alias("sig"), F.count("*").alias("members"))
        pivots = speakers.groupBy("key").agg(F.max_by(F.struct("sig", "root"), F.struct("members", F.xxhash64("root", F.lit(k)))).alias("c"), F.count("*").alias("roots")).where("roots > 1")
        spokes = speakers.join(pivots.select("key", F.col("c.sig").alias("p"), F.col("c.root").alias("rp")), "key").where("root != rp")
        spokes = written(spokes.select(F.col("sig").alias("a"), F.col("p").alias("b"), F.col("root").alias("ra"), F.col("rp").alias("rb")).distinct(), folder, f"spokes-{k}")
        compared = spokes.count()
        found = written(_verified(spokes, sets), folder, f"links-to-pivots-{k}") if compared else None
        linked = found.count() if compared else 0
        if linked:
            joined = connected_components(found.select(F.col("ra").alias("a"), F.col("rb").alias("b")), f"{folder}/pivots-{k}")
            if roots is not None:
                up = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
                moved = roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
                joined = moved.union(joined.join(roots.select("node"), "node", "left_anti"))
            roots = written(joined, folder, f"roots-{k}")
        if linked <= WORTH * compared:
            break
    return roots if roots is not None else sets.select(F.col("sig").alias("node"), F.col("sig").alias("root")).limit(0)


def _labelled(df: DataFrame, id_col: str, text_col: str, folder: str) -> DataFrame:
    """One row a document: (doc_id, h, root, n_shingles, component_id); h is a hash of the text, root tells components apart."""
    spark = df.sparkSession
    text = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    buckets = power_of_two(text_volume(docs, "text") / BUCKET_TEXT, 128, 1 << 20)

    packed = docs.mapInArrow(tidy(_send_shingles(buckets)), _PACKED)
    replies = packed.groupBy("bucket").applyInArrow(tidy(_count_bucket(buckets)), _PACKED)
    documents = written(replies.groupBy("chunk").applyInArrow(tidy(_gather_chunk), _SETS), folder, "documents")
    del packed, replies
    release(spark)

    sets = documents.where("tokens is not null").groupBy("sig").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("frequencies").alias("frequencies"))
    sets = written(sets, folder, "sets")
    members = written(sets.select("sig", "n", "tokens", "frequencies").mapInArrow(tidy(_prefixes), _MEMBERS), folder, "members")
    roots = _pivot_rounds(members, sets, folder)

    bits = [f"bits{i}" for i in range(BITMAP)]
    rooted = members.drop("keys").join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    one = F.when(F.min("root") == F.max("root"), F.min("root")).alias("root")
    agreed = [f(x).alias(x.replace("bits", k)) for k, f in (("all", F.bit_and), ("any", F.bit_or)) for x in bits]
    groups = written(rooted.groupBy("grp").agg(one, F.first("n").alias("n"), F.first("lone").alias("lone"), F.first("prefix").alias("prefix"), *agreed), folder, "groups")
    postings = groups.mapInArrow(tidy(_explode_prefixes), _POSTINGS)
    spread = postings.withColumn("bucket", F.pmod(F.col("token"), F.lit(max(8, buckets // 4))))
    between = spread.groupBy("bucket").applyInArrow(tidy(_bucket_pairs), "ga binary, gb binary").distinct()
    within = groups.where("root is null").select(F.col("grp").alias("ga"), F.col("grp").alias("gb"))
    group_pairs = written(between.union(within), folder, "group-pairs")
    sides = [rooted.select(*[F.col(c).alias(f"{x}_{c}") for c in ("grp", "sig", "root", "n", "lone", *bits)]) for x in "ab"]
    apart = F.col("a_lone") + F.col("b_lone")
    for x in bits:
        apart = apart + F.bit_count(F.col(f"a_{x}").bitwiseXOR(F.col(f"b_{x}")))
    fit = (F.col("a_root") != F.col("b_root")) & (7 * apart <= F.col("a_n") + F.col("b_n"))
    pairs = group_pairs.join(sides[0], F.col("ga") == F.col("a_grp")).join(sides[1], (F.col("gb") == F.col("b_grp")) & fit)
    pairs = written(pairs.select(F.least("a_sig", "b_sig").alias("a"), F.greatest("a_sig", "b_sig").alias("b")).distinct(), folder, "pairs")
    later = written(_verified(pairs, sets), folder, "links-of-groups")

    tree = roots.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b")).union(later)
    final = connected_components(tree, f"{folder}/all")
    # one row a set: its smallest document, then the smallest of its component
    least = documents.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("first_id"))
    least = least.join(final.withColumnRenamed("node", "sig"), "sig", "left").select("sig", F.coalesce("root", "sig").alias("root"), "first_id")
    named = least.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = least.join(named, "root").select("sig", "root", "component_id")
    out = documents.select("doc_id", "h", "sig", "n").join(labels, "sig", "left")
    out = out.select("doc_id", "h", "root", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    told = written(out, folder, "labelled")
    discard(spark, *[f"{folder}/{x}" for x in ("documents", "sets", "members", "groups", "group-pairs", "pairs", "links-of-groups", "keys", "all")])
    discard(spark, *[f"{folder}/{x}-{k}" for k in range(ROUNDS) for x in ("spokes", "links-to-pivots", "pivots", "roots")])
    return told


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """One row a document: (doc_id, n_shingles, component_id); component_id is the smallest identifier reachable by links."""
    return _labelled(df, id_col, text_col, folder or workspace(df.sparkSession)).select("doc_id", "n_shingles", "component_id")


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every component one row, that with the smallest identifier (null last; of equal ones the smallest hash of text, then of
    the row); all rows without words stay. Rows of one identifier whose texts don't link are components of their own."""
    found = _labelled(df, id_col, text_col, workspace(df.sparkSession))
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("f"))
    # plain equality of three keys, which the grouping shares: the texts are shuffled once
    keys = ["_none", "_id", "_text"]
    first = first.select(F.col("f.none").alias("_none"), F.coalesce("f.doc_id", F.lit(0)).alias("_id"), F.col("f.h").alias("_text")).distinct()
    id_ = F.col(id_col).cast("long")
    own = df.withColumns({"_none": id_.isNull(), "_id": F.coalesce(id_, F.lit(0)), "_text": F.xxhash64(F.col(text_col).cast("string"))})
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    chosen = own.join(first, keys, "left_semi").groupBy(*keys)
    single = chosen.agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])).alias("_row")).select("_row.*")
    blank = df.where(F.coalesce(~F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    return single.union(blank.select(*df.columns))
