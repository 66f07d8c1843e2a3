"""Hard negatives by dual-tree search.

Rows are brought to integer vectors, so scores (inner products) are exact. Two trees of balls are laid over them. A top tree of at most ``REGIONS`` regions is
fitted on a bounded sample; which region a row goes to only steers the search, and each region's ball (centre, radius) is computed
over all its rows. Below a region, rows lie in packs, each with a tree of its own (halves along the widest coordinate, down to ``LEAF`` rows).
Anchors are dealt to blocks of whole neighbouring regions, and each task builds one tree over the anchors of its block.

For two nodes with centres a, b and radii r, s every inner product of their rows lies within a.b ± (|a| s + |b| r + r s). A pair of nodes is left out, with all
its anchors and rows, if that interval misses what the anchors of the node still look for: scores of at least the last place of their lists so far (or the lowest
allowed one) and at most the highest allowed one. Pairs of a block and a region are judged before rows are sent, pairs of nodes inside the tasks,
level by level; pairs of leaves are scored exactly. Packs come to a block in falling order of their region's upper bound, so that lists fill early.

Both searches are one exchange of packed rows: for the positives (the best of the anchor's own label), then for the negatives (for each positive the best of other
labels within its window of scores). A block's packs are dealt over ``shards`` tasks, which hold the block's anchors, their lists and one pack; lists of the
shards are merged by a ranked window with partial limits. No pair of rows leaves a task unless it is in a list.

Results for special input: rows with a null identifier, label or vector, or a null or non-finite component take no part; vectors of
different lengths are read as if followed by zeros; a row isn't positive or negative of an anchor with the same identifier; repeated rows count as often as they are there, and
a repeated anchor has its results as often; an anchor without positives or without rows in a window has none; an empty table gives an empty table; a component
beyond 32 bits after scaling raises an error; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.textkit import discard, tidy, workspace, written

#: Regions of the top tree, rows of the sample that it is fitted on (those with the smallest hashes), and rows for which a further region is made.
REGIONS, SAMPLE, REGION_ROWS = 64, 8192, 1024
#: Rows of a pack, rows of a leaf, anchors of a block.
PACK, LEAF, BLOCK = 4096, 64, 4096
#: Tasks over which the packs of all blocks are dealt, and rows that one task takes at most, about.
TASKS, TASK_ROWS = 24, 1 << 24
#: Beyond all scores and identifiers of places not taken; the negative of either is a number too.
_LOW, _HIGH = -(1 << 62), (1 << 63) - 1
_PACKED = "region int, n int, ids binary, labels binary, keys binary, vectors binary"


@dataclass
class Tree:
    """A tree of balls over ``order``: node k holds rows begin[k] to end[k] of it; its children are 2k + 1 and 2k + 2 where it has some."""

    order: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    leaf: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    norm: np.ndarray


def build_tree(x: np.ndarray, leaf: int = LEAF) -> Tree:
    """Halves along the widest coordinate, level by level, until a node has at most ``leaf`` rows."""
    n, depth = len(x), 0
    while n >> depth > leaf:
        depth += 1
    size = (2 << depth) - 1
    begin, end, order = np.zeros(size, np.int64), np.zeros(size, np.int64), np.arange(n)
    end[0] = n
    for k in range(size // 2):
        a, b = int(begin[k]), int(end[k])
        own = order[a:b]
        if b > a:
            widest = int(np.argmax(np.ptp(x[own], axis=0)))
            order[a:b] = own[np.argpartition(x[own, widest], (b - a) // 2)] if b - a > 1 else own
        begin[2 * k + 1], end[2 * k + 1], begin[2 * k + 2], end[2 * k + 2] = a, (a + b) // 2, (a + b) // 2, b
    own = x[order]
    total = np.concatenate((np.zeros((1, x.shape[1])), np.cumsum(own, axis=0, dtype=np.float64)))
    centre = (total[end] - total[begin]) / np.maximum(end - begin, 1)[:, None]
    radius = np.array([np.sqrt(np.max(np.sum(np.square(own[a:b] - c), axis=1), initial=0.0)) for a, b, c in zip(begin, end, centre, strict=True)])
    return Tree(order, begin, end, np.arange(size) >= size // 2, centre, radius, np.linalg.norm(centre, axis=1))


def interval(dot: np.ndarray, a_norm, a_radius, b_norm, b_radius) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all inner products of two balls, a little wider than exact arithmetic needs."""
    off = a_norm * b_radius + b_norm * a_radius + a_radius * b_radius
    slack = 1e-9 * (np.abs(dot) + off + a_norm * b_norm) + 1e-6
    return dot - off - slack, dot + off + slack


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, in the narrowest arithmetic that is exact for them."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most >= 1 << 62:
        raise ValueError("scores beyond 62 bits")
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


class Lists:
    """The best ``k`` rows of every slot of a block's anchors, and what each node of the anchors' tree still looks for."""

    def __init__(self, labels: np.ndarray, ids: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.tree = build_tree(vectors, LEAF // 2)
        order = self.tree.order
        self.rows, self.labels, self.ids, self.vectors = order, labels[order], ids[order], vectors[order]
        self.low, self.high, self.k, self.same = low[order].copy(), high[order], k, same
        n, slots = self.low.shape
        self.score, self.found = np.full((n * slots, k), _LOW, np.int64), np.full((n * slots, k), _HIGH, np.int64)
        #: labels of each node: equal bounds mean one label
        self.least, self.most = (self._by_node(f, self.labels, e) for f, e in ((np.minimum, _HIGH), (np.maximum, _LOW)))
        self.node_high = self._by_node(np.maximum, self.high.max(axis=1, initial=_LOW), _LOW)
        self.refresh()

    def _by_node(self, f, values: np.ndarray, empty: int) -> np.ndarray:
        t, out = self.tree, np.full(len(self.tree.begin), empty, np.int64)
        some = np.flatnonzero(t.leaf & (t.end > t.begin))
        if len(some):
            out[some] = f.reduceat(values, t.begin[some])
        for k in range(len(out) // 2 - 1, -1, -1):
            out[k] = f(out[2 * k + 1], out[2 * k + 2])
        return out

    def refresh(self) -> None:
        """The lowest score that any slot below each node still takes."""
        wanted = np.where(self.low <= self.high, self.low, _HIGH)
        self.node_low = self._by_node(np.minimum, wanted.min(axis=1, initial=_HIGH), _HIGH)

    def search(self, labels: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take one pack into account: descend both trees, leave out pairs of nodes that can't matter, score pairs of leaves."""
        mine, its = self.tree, build_tree(vectors)
        labels, ids, vectors = labels[its.order], ids[its.order], vectors[its.order]
        heads = [k for k in range(len(its.begin)) if its.end[k] > its.begin[k]]
        least, most = np.full(len(its.begin), _HIGH), np.full(len(its.begin), _LOW)
        for k in heads:
            own = labels[its.begin[k] : its.end[k]]
            least[k], most[k] = own.min(), own.max()
        a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        while len(a):
            down, up = interval(np.einsum("ij,ij->i", mine.centre[a], its.centre[b]), mine.norm[a], mine.radius[a], its.norm[b], its.radius[b])
            stay = (up >= self.node_low[a]) & (down <= self.node_high[a]) & (mine.end[a] > mine.begin[a]) & (its.end[b] > its.begin[b])
            if self.same:
                stay &= (self.least[a] <= most[b]) & (least[b] <= self.most[a])
            else:
                stay &= ~((self.least[a] == self.most[a]) & (least[b] == most[b]) & (self.least[a] == least[b]))
            a, b = a[stay], b[stay]
            over = mine.leaf[a] & its.leaf[b]
            ends.append((a[over], b[over]))
            a, b = a[~over], b[~over]
            # the wider node of a pair is split
            left = its.leaf[b] | (~mine.leaf[a] & (mine.radius[a] >= its.radius[b]))
            a, b = np.concatenate((2 * a[left] + 1, 2 * a[left] + 2, a[~left], a[~left])), np.concatenate((b[left], b[left], 2 * b[~left] + 1, 2 * b[~left] + 2))
        a, b = np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends])
        for node in np.unique(a).tolist():
            theirs = np.sort(b[a == node])
            rows = np.concatenate([np.arange(its.begin[t], its.end[t]) for t in theirs.tolist()])
            self._take(int(mine.begin[node]), int(mine.end[node]), labels[rows], ids[rows], vectors[rows])
        if len(a):
            self.refresh()

    def _take(self, begin: int, end: int, labels: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = _scores(self.vectors[begin:end], vectors)
        may = (self.labels[begin:end, None] == labels) == self.same
        may &= self.ids[begin:end, None] != ids
        slots = self.low.shape[1]
        for s in range(slots):
            hit = may & (scores >= self.low[begin:end, s, None]) & (scores <= self.high[begin:end, s, None])
            at, which = np.nonzero(hit)
            if not len(at):
                continue
            touched = np.unique(at)
            old = (begin + touched) * slots + s
            place = np.concatenate((at, np.repeat(touched, self.k)))
            score = np.concatenate((scores[at, which], self.score[old].ravel()))
            found = np.concatenate((ids[which], self.found[old].ravel()))
            order = np.lexsort((found, -score, place))
            place, score, found = place[order], score[order], found[order]
            rank = np.arange(len(place)) - np.searchsorted(place, place)
            best = rank < self.k
            self.score[old], self.found[old] = score[best].reshape(-1, self.k), found[best].reshape(-1, self.k)
            full = self.score[old, -1]
            self.low[begin + touched, s] = np.where(full > _LOW, full, self.low[begin + touched, s])

    def results(self):
        """(row of the block, slot, score, identifier) of all places taken."""
        slots = self.low.shape[1]
        slot, place = np.nonzero(self.score > _LOW)
        return self.rows[slot // slots], slot % slots, self.score[slot, place], self.found[slot, place]


# --- rows to packs ------------------------------------------------------------------------------------------------------------


def integer_rows(df: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; v is floor(scale * x) of each component."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.where(F.coalesce(sound, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("v"))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column, shorter ones followed by zeros."""
    flat, own = lists.flatten().to_numpy(zero_copy_only=False), np.array(lists.value_lengths(), np.int64)
    if len(own) and (own == dim).all():
        return flat.astype(np.int32).reshape(-1, dim)
    out, at = np.zeros((len(own), dim), np.int32), np.cumsum(own) - own
    for k in range(len(own)):
        out[k, : own[k]] = flat[at[k] : at[k] + own[k]]
    return out


def fit_regions(rows: DataFrame, n: int, dim: int) -> np.ndarray:
    """Centres of the top tree's leaves: halves along the widest coordinate of at most SAMPLE rows. Their number grows with the rows up to REGIONS."""
    most = max(1, min(REGIONS, n // REGION_ROWS))
    sample = rows.select("v", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    x = _matrix(sample, dim).astype(np.float64)
    return _centres(x, most)


def _centres(x: np.ndarray, most: int) -> np.ndarray:
    """Splits the region whose rows lie farthest off its centre, at the middle between two far rows, until there are ``most``."""
    parts = [np.arange(len(x))]
    spread = [float(np.square(x - x.mean(0)).sum())] if len(x) else [0.0]
    while len(parts) < most:
        k = int(np.argmax(spread))
        own = parts[k]
        if spread[k] <= 0 or len(own) < 2:
            break
        y = x[own]
        far = y[np.argmax(np.square(y - y.mean(0)).sum(1))]
        other = y[np.argmax(np.square(y - far).sum(1))]
        for _ in range(4):  # a few steps of two means
            side = np.square(y - far).sum(1) > np.square(y - other).sum(1)
            if side.all() or not side.any():
                break
            far, other = y[~side].mean(0), y[side].mean(0)
        side = np.square(y - far).sum(1) > np.square(y - other).sum(1)
        if side.all() or not side.any():
            spread[k] = 0.0
            continue
        parts[k : k + 1] = [own[~side], own[side]]
        spread[k : k + 1] = [float(np.square(x[p] - x[p].mean(0)).sum()) for p in (own[~side], own[side])]
    return np.stack([x[p].mean(0) if len(p) else np.zeros(x.shape[1]) for p in parts])


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and its distance."""
    d = np.square(centres).sum(1) - 2 * (x @ centres.T)
    at = np.argmin(d, axis=1)
    return at, np.sqrt(np.square(x - centres[at]).sum(1))


def pack(rows: DataFrame, centres: np.ndarray, dim: int) -> DataFrame:
    """Packs of rows of one region, made from the rows of a partition as they come, and each pack's distance from its region's centre."""

    def emit(region: int, got: list[tuple]) -> pa.RecordBatch:
        ids, labels, keys, x, far = (np.concatenate([g[i] for g in got]) for i in range(5))
        columns = [pa.array([region], pa.int32()), pa.array([len(ids)], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in (ids, labels, keys, x)), pa.array([float(far.max())])]
        return pa.RecordBatch.from_arrays(columns, names=[*(c.split()[0] for c in _PACKED.split(", ")), "radius"])

    def run(batches):
        waiting: dict[int, list[tuple]] = {}
        held: dict[int, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                ids, labels, keys = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2))
                x = _matrix(part.column(3), dim)
                region, far = _nearest(x.astype(np.float64), centres)
                for r in np.unique(region).tolist():
                    own = region == r
                    waiting.setdefault(r, []).append((ids[own], labels[own], keys[own], x[own], far[own]))
                    held[r] = held.get(r, 0) + int(own.sum())
                    if held[r] >= PACK:
                        yield emit(r, waiting.pop(r))
                        held.pop(r)
        for r, got in waiting.items():
            yield emit(r, got)

    return rows.select("vec_id", "label", "key", "v").mapInArrow(tidy(run), f"{_PACKED}, radius double")


def _read(raw: bytes, kind, columns: int = 0) -> np.ndarray:
    out = np.frombuffer(raw, kind)
    return out.reshape(-1, columns) if columns else out


# --- the search ---------------------------------------------------------------------------------------------------------------


def _search(anchors: DataFrame, packs: DataFrame, reach: DataFrame, shards: int, blocks: int, dim: int, k: int, slots: int, same: bool) -> DataFrame:
    """(key, slot, score, vec_id): the best ``k`` rows of each slot of each anchor, of one shard each.

    ``anchors`` are (block, n, ids, labels, keys, vectors, low, high) in packs; ``reach`` are the (block, region, upper) pairs that can matter.
    """
    empty = F.lit(None).cast("binary")
    columns = ["block", "shard", "kind", "upper", "ids", "labels", "keys", "vectors", "low", "high"]
    ask = anchors.select("block", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).alias("kind"), F.lit(0.0).alias("upper"), "ids", "labels", "keys", "vectors", "low", "high")
    offer = packs.join(reach, "region").select("block", F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("kind"), (-F.col("upper")).alias("upper"), "ids", "labels", empty.alias("keys"), "vectors", empty.alias("low"), empty.alias("high"))
    dealt = ask.select(*columns).unionByName(offer.select(*columns)).repartition(max(1, shards * blocks), "block", "shard").sortWithinPartitions("block", "shard", "kind", "upper")

    def run(batches):
        at, asked, lists = None, [], None

        def begin():
            ids, labels, keys, x, low, high = (np.concatenate([a[i] for a in asked]) for i in range(6))
            return keys, Lists(labels, ids, x, low, high, k, same)

        def over():
            if lists is not None:
                keys, done = lists
                row, slot, score, found = done.results()
                yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array(slot.astype(np.int32)), pa.array(score), pa.array(found)], names=["key", "slot", "score", "vec_id"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["block"], r["shard"]) != at:
                    yield from over()
                    at, asked, lists = (r["block"], r["shard"]), [], None
                ids, labels, x = _read(r["ids"], np.int64), _read(r["labels"], np.int64), _read(r["vectors"], np.int32, dim)
                if r["kind"] == 0:
                    asked.append((ids, labels, _read(r["keys"], np.int64), x, _read(r["low"], np.int64, slots), _read(r["high"], np.int64, slots)))
                elif asked:
                    lists = lists or begin()
                    lists[1].search(labels, ids, x)
        yield from over()

    found = dealt.mapInArrow(tidy(run), "key long, slot int, score long, vec_id long")
    place = F.row_number().over(Window.partitionBy("key", "slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _ask(rows: DataFrame, block, slots: int) -> DataFrame:
    """Anchors as packs: (block, ids, labels, keys, vectors, low, high) of a group of (block, part, vec_id, label, key, x, low, high)."""

    def run(table: pa.Table) -> pa.Table:
        col = lambda c, kind=np.int64: table.column(c).to_numpy().astype(kind)
        lists = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        raw = [col("vec_id").tobytes(), col("label").tobytes(), col("key").tobytes(), b"".join(table.column("x").to_pylist()), lists("low").tobytes(), lists("high").tobytes()]
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), **{n: pa.array([b], pa.binary()) for n, b in zip(("ids", "labels", "keys", "vectors", "low", "high"), raw, strict=True)}})

    return rows.groupBy("block", "part").applyInArrow(run, "block int, ids binary, labels binary, keys binary, vectors binary, low binary, high binary")


def _blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """First block and number of blocks of each region: neighbouring small regions share one, large ones have several."""
    first, number, at, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for r, n in enumerate(counts.tolist()):
        if held and held + n > BLOCK:
            at, held = at + 1, 0
        first[r], number[r] = at, max(1, -(-n // BLOCK))
        at, held = at + int(number[r]) - 1, held + n if number[r] == 1 else BLOCK
    return first, number, at + 1


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, v).

    Anchors are the rows whose vec_id is divisible by ``every``; positives the first ones of the same label; negatives, for each positive, the first ones of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark, folder = rows.sparkSession, workspace(rows.sparkSession)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    known = written(rows.withColumn("key", F.monotonically_increasing_id()), folder, "rows")
    n, dim = known.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or not dim:
        return spark.createDataFrame([], schema)
    centres = fit_regions(known, n, dim)
    packs = written(pack(known, centres, dim), folder, "packs")
    asking = written(pack(known.where(F.col("vec_id") % every == 0), centres, dim), folder, "asking")
    told = [{r["region"]: r for r in t.groupBy("region").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect()} for t in (asking, packs)]  # a row a region
    radius, count = (np.array([[t[r][c] if r in t else 0 for r in range(len(centres))] for t in told], np.float64) for c in ("radius", "n"))
    if not count[0].any():
        return spark.createDataFrame([], schema)
    first, number, blocks = _blocks(count[0].astype(np.int64))
    norm = np.linalg.norm(centres, axis=1)
    down, up = interval(centres @ centres.T, norm[:, None], radius[0][:, None], norm[None, :], radius[1][None, :])
    shards = max(1, -(-TASKS // blocks), -(-n // TASK_ROWS))
    some = [np.flatnonzero(c).tolist() for c in count]
    pairs = spark.createDataFrame([(a, b, float(down[a, b]), float(up[a, b])) for a in some[0] for b in some[1]], "asked int, region int, down double, up double")  # REGIONS squared at most
    dealt = spark.createDataFrame([(a, int(first[a]), int(number[a])) for a in some[0]], "asked int, first int, number int")

    def unpacked(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x = _read(r["vectors"], np.int32, dim)
                yield pa.RecordBatch.from_arrays([pa.array([r["region"]] * r["n"], pa.int32()), *(pa.array(_read(r[c], np.int64)) for c in ("ids", "labels", "keys")), pa.array([v.tobytes() for v in x], pa.binary())], names=["asked", "vec_id", "label", "key", "x"])

    anchors = asking.mapInArrow(tidy(unpacked), "asked int, vec_id long, label long, key long, x binary").join(F.broadcast(dealt), "asked")
    h = F.xxhash64("key")
    anchors = anchors.withColumn("block", (F.col("first") + F.pmod(h, F.col("number"))).cast("int")).withColumn("part", F.pmod(F.shiftright(h, 20), F.lit(16)))
    anchors = written(anchors.select("asked", "block", "part", "vec_id", "label", "key", "x"), folder, "anchors")

    def reach(wanted: DataFrame) -> DataFrame:
        """Pairs of blocks and regions that can matter, of (asked, block, low, high)."""
        return wanted.join(F.broadcast(pairs), "asked").where((F.col("up") >= F.col("low")) & (F.col("down") <= F.col("high"))).groupBy("block", "region").agg(F.max("up").alias("upper"))

    edge = lambda v, m: F.array(*(F.lit(int(v)).cast("long") for _ in range(m)))
    wanted = anchors.select("asked", "block").distinct().select("asked", "block", F.lit(int(_LOW)).alias("low"), F.lit(int(_HIGH)).alias("high"))
    ask = _ask(anchors.withColumn("low", edge(_LOW + 1, 1)).withColumn("high", edge(_HIGH, 1)), "block", 1)
    best = _search(ask, packs, reach(wanted), shards, blocks, dim, positives, 1, True).select("key", (F.col("place") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    best = written(best, folder, "positives")

    # 30 p <= 100 s <= 90 p in whole numbers
    floor = lambda x: F.expr(f"({x} - pmod({x}, 100)) div 100")
    least, most = -floor(f"(-{low} * positive_score)"), floor(f"({high} * positive_score)")
    windows = best.withColumn("low", least).withColumn("high", most).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("low", "high").alias("w")))).alias("w"))
    slot = lambda side, none: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda s: F.coalesce(F.col("w")[s][side], F.lit(int(none))))
    having = written(anchors.join(windows, "key").withColumn("low", slot("low", _HIGH)).withColumn("high", slot("high", _LOW)).drop("w"), folder, "windows")
    wanted = having.groupBy("asked", "block").agg(F.min(F.array_min("low")).alias("low"), F.max(F.array_max("high")).alias("high"))
    found = _search(_ask(having, "block", positives), packs, reach(wanted), shards, blocks, dim, negatives, positives, False)
    found = written(found.select("key", "slot", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), folder, "negatives")
    out = found.join(best, ["key", "slot"]).join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key")
    discard(spark, *(f"{folder}/{t}" for t in ("rows", "packs", "asking", "windows")))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
