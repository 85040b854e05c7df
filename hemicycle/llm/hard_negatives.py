"""Hard-negative mining over an STR-packed R-tree.

A row's score for an anchor is the integer inner product of their components
``floor(scale * x)``. An anchor's positives are its best rows of the same label;
negatives are the best rows of other labels whose score lies in a window set by
the positive's score.

1. **Packing** (sort, tile, recurse). Rows are ranked by (label, the coordinate
   of largest variance), cut into slabs, ranked in each slab by the second
   coordinate, and cut into tiles of ``TILE`` rows. Both ranks come from
   range-partitioned sorts, so that equal rows or one label holding most rows
   spread evenly. Inside a tile the same rule goes on over further coordinates
   down to leaves of ``LEAF`` rows. A tile is one stored row: its rows, the
   minimum bounding boxes of its leaves, and its own box; every row is indexed.
2. **Bounds.** For an anchor q a box ``[lo, hi]`` gives per coordinate the
   interval of ``q_i * x_i``; their sums bound every score in the box.
3. **Search.** Anchors go in blocks of ``BLOCK`` rows to all tasks; each task
   searches the tiles of its partition, ``GROUP`` at a time, with one best-first
   queue per anchor. A box is dropped when its interval misses the window, its
   labels rule it out, or its upper bound is *strictly* below the kth score so
   far (equal scores are kept: ties go to the smaller id). The best rows of the
   tasks meet in a ranked limit per anchor. One pass finds the positives of a
   block, the next the negatives of all their windows.

The search is exact. Where boxes do not prune, as for isotropic vectors in many
dimensions, it reads every leaf; the number of passes is the number of anchors
over ``BLOCK``.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component, take no part, nor do rows with a component of 2^26 or more
after scaling (their scores might not fit a long). Shorter vectors count as
padded with zeros; an empty vector scores zero. Of rows sharing an id the one
with the smallest (label, vector) takes part. An anchor without positives, or a
positive whose window is empty, gives no row. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hemicycle.llm.common import stored
from hemicycle.plans.ranking import global_rank

TILE, LEAF = 2048, 128
#: anchors sent to all tasks at once (4 bytes a component), and tiles searched at once by a task
BLOCK, GROUP = 8192, 16
#: components at or beyond this magnitude do not take part
LIMIT = 1 << 26

TILES = "tile long, ids binary, labels binary, vecs binary, leaf_lo binary, leaf_hi binary, leaf_label binary"


def prepared(rows: DataFrame, label: Column | None = None, scale: int = 256, vec_id: str = "vec_id",
             vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v): the rows that take part, with integer components."""
    v = F.col(f"`{vector}`")
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LIMIT))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    df = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
                     (F.col("label") if label is None else label).cast("long").alias("label"),
                     F.when(fits, ints).alias("v")).filter("vec_id is not null and label is not null and v is not null")
    return df.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _ints(blob: bytes, kind=np.int32) -> np.ndarray:
    return np.frombuffer(blob, kind)


def _leaves(order: np.ndarray, keys: list[np.ndarray], level: int) -> list[np.ndarray]:
    """The rows of ``order`` tiled over the coordinates from ``level`` on, into leaves of at most ``LEAF`` rows."""
    if len(order) <= LEAF:
        return [order]
    order = order[np.argsort(keys[level % len(keys)][order], kind="stable")]
    pages = -(-len(order) // LEAF)
    slab = LEAF * (-(-pages // 2) if pages > 2 else 1)
    return [leaf for at in range(0, len(order), slab) for leaf in _leaves(order[at:at + slab], keys, level + 1)]


def _pack(dims: int, by: list[int]):
    """Rows of one tile -> the tile with its leaves."""

    def tile(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        flat = rows.column("v").combine_chunks()
        sizes = np.diff(flat.offsets.to_numpy())
        vecs = np.zeros((len(rows), dims), np.int32)
        vecs[np.arange(dims)[None, :] < sizes[:, None]] = flat.flatten().to_numpy()
        labels = rows.column("label").to_numpy()
        leaves = _leaves(np.arange(len(rows)), [labels, *[vecs[:, i] for i in by[2:] or by]], 0)
        order = np.concatenate(leaves)
        at = np.concatenate([[0], np.cumsum([len(x) for x in leaves])[:-1]])
        vecs, labels = vecs[order], labels[order]
        ends = [np.minimum.reduceat(labels, at), np.maximum.reduceat(labels, at), at]
        blobs = [rows.column("vec_id").to_numpy()[order], labels, vecs, np.minimum.reduceat(vecs, at, axis=0),
                 np.maximum.reduceat(vecs, at, axis=0), np.stack(ends).astype(np.int64)]
        names = ["ids", "labels", "vecs", "leaf_lo", "leaf_hi", "leaf_label"]
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int64())}
                        | {n: pa.array([np.ascontiguousarray(b).tobytes()], pa.binary()) for n, b in zip(names, blobs)})

    return tile


class Index:
    """The packed tiles of all rows that take part, stored."""

    def __init__(self, rows: DataFrame):
        self.rows = stored(rows, "vectors")
        self.spark = rows.sparkSession
        sizes = self.rows.select(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.count(F.lit(1))).first()
        self.dims, self.peak, self.count = max(sizes[0] or 0, 1), sizes[1] or 0, sizes[2]
        spread = (self.rows.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.variance("x").alias("s"))
                  .orderBy(F.desc_nulls_last("s"), "at").collect())  # one row per coordinate
        by = [r["at"] for r in spread][:8] or [0]
        coordinate = [F.coalesce(F.get("v", F.lit(i)), F.lit(0)) for i in (by * 2)[:2]]
        tiles = -(-self.count // TILE)
        slab = TILE * max(int(np.ceil(np.sqrt(tiles))), 1)
        ranked = global_rank(self.rows, ["label", coordinate[0], "vec_id"], "r")
        ranked = ranked.withColumn("slab", F.floor((F.col("r") - 1) / slab))
        ranked = global_rank(ranked, ["slab", coordinate[1], "vec_id"], "r")
        tiled = ranked.select(F.floor((F.col("r") - 1) / TILE).alias("tile"), "vec_id", "label", "v")
        self.tiles = stored(tiled.groupBy("tile").applyInArrow(_pack(self.dims, by), TILES), "tiles")
        #: what holds every score exactly
        self.kind = np.float64 if self.dims * self.peak ** 2 < 1 << 53 else np.int64

    def blocks(self, anchors: Column) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, labels, vectors) of the anchor rows, ``BLOCK`` at a time, in the order of ids."""
        numbered = global_rank(self.rows.filter(anchors), ["vec_id"], "r")
        numbered = stored(numbered.select("vec_id", "label", "v", F.floor((F.col("r") - 1) / BLOCK).alias("block")), "anchors")
        for b in range((numbered.agg(F.max("block")).first()[0] or 0) + 1):
            part = numbered.filter(F.col("block") == b).orderBy("vec_id").collect()
            if part:
                vecs = np.zeros((len(part), self.dims), self.kind)
                for i, r in enumerate(part):
                    vecs[i, :len(r["v"])] = r["v"]
                yield np.array([r["vec_id"] for r in part]), np.array([r["label"] for r in part]), vecs


class _Tree:
    """Some tiles held by a task: boxes of tiles and leaves, and the rows."""

    def __init__(self, tiles: list[dict], dims: int, kind):
        self.ids = np.concatenate([_ints(t["ids"], np.int64) for t in tiles])
        self.labels = np.concatenate([_ints(t["labels"], np.int64) for t in tiles])
        self.vecs = np.concatenate([_ints(t["vecs"]).reshape(-1, dims) for t in tiles]).astype(kind)
        lo = [_ints(t["leaf_lo"]).reshape(-1, dims) for t in tiles]
        hi = [_ints(t["leaf_hi"]).reshape(-1, dims) for t in tiles]
        ends = [_ints(t["leaf_label"], np.int64).reshape(3, -1) for t in tiles]
        self.leaf_lo, self.leaf_hi = np.concatenate(lo).astype(kind), np.concatenate(hi).astype(kind)
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in lo])])
        base = np.concatenate([[0], np.cumsum([len(t["ids"]) // 8 for t in tiles])])
        self.row = np.concatenate([*[e[2] + b for e, b in zip(ends, base)], [base[-1]]])
        self.low_label, self.high_label = (np.concatenate([e[i] for e in ends]) for i in (0, 1))
        self.tile_lo = np.stack([x.min(axis=0) for x in lo]).astype(kind)
        self.tile_hi = np.stack([x.max(axis=0) for x in hi]).astype(kind)
        self.tile_low_label = np.array([e[0].min() for e in ends])
        self.tile_high_label = np.array([e[1].max() for e in ends])


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The first k by (score descending, id)."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= cut)
        return at[np.lexsort((ids[at], -score[at]))[:k]]
    return np.lexsort((ids, -score))[:k]


class _Wanted:
    """What one anchor looks for: the first k rows in each of some score windows, with or without its label."""

    def __init__(self, anchor: int, label: int, same: bool, windows: list[tuple[float, float]], k: int):
        self.anchor, self.label, self.same, self.k = anchor, label, same, k
        self.low = [w[0] for w in windows]  # raised to the kth score as rows come in
        self.high = [w[1] for w in windows]
        self.found = [(np.zeros(0), np.zeros(0, np.int64)) for _ in windows]
        self.floor, self.top = min(self.low, default=np.inf), max(self.high, default=-np.inf)

    def reaches(self, lower, upper) -> bool:
        """Whether a box with these bounds meets a window at or above its kth score."""
        return any(upper >= lo and lower <= hi for lo, hi in zip(self.low, self.high))

    def take(self, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        fits = (score >= self.floor) & (score <= self.top)
        if not fits.any():
            return
        fits &= ((labels == self.label) & (ids != self.anchor)) if self.same else labels != self.label
        score, ids = score[fits], ids[fits]
        if not len(score):
            return
        for w, (lo, hi) in enumerate(zip(self.low, self.high)):
            inside = (score >= lo) & (score <= hi)
            if inside.any():
                s, i = np.append(self.found[w][0], score[inside]), np.append(self.found[w][1], ids[inside])
                at = _best(s, i, self.k)
                self.found[w] = s[at], i[at]
                if len(at) == self.k:
                    self.low[w] = max(lo, s[at[-1]])
        self.floor = min(self.low)


def _bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the inner products of ``q`` with the rows of each box."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return lo @ up + hi @ down, hi @ up + lo @ down


def _search(tree: _Tree, q: np.ndarray, wanted: _Wanted) -> None:
    """Best-first over tiles, then leaves, by upper bound within the highest window."""

    def admits(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if wanted.same:
            return (low <= wanted.label) & (wanted.label <= high)
        return (low != wanted.label) | (high != wanted.label)

    queue: list[tuple] = []

    def push(kind: int, first: int, lower: np.ndarray, upper: np.ndarray, ok: np.ndarray) -> None:
        ok = np.flatnonzero(ok & (upper >= wanted.floor) & (lower <= wanted.top))
        for i, lo, hi in zip(ok.tolist(), lower[ok].tolist(), upper[ok].tolist()):
            heapq.heappush(queue, (-min(hi, wanted.top), kind, first + i, lo, hi))

    push(0, 0, *_bounds(q, tree.tile_lo, tree.tile_hi), admits(tree.tile_low_label, tree.tile_high_label))
    while queue:
        key, kind, box, lower, upper = heapq.heappop(queue)
        if -key < wanted.floor:
            return
        if not wanted.reaches(lower, upper):
            continue
        if kind == 0:
            a, b = tree.first[box], tree.first[box + 1]
            push(1, int(a), *_bounds(q, tree.leaf_lo[a:b], tree.leaf_hi[a:b]),
                 admits(tree.low_label[a:b], tree.high_label[a:b]))
        else:
            a, b = tree.row[box], tree.row[box + 1]
            wanted.take(tree.vecs[a:b] @ q, tree.ids[a:b], tree.labels[a:b])


FOUND = "anchor int, window int, vec_id long, score long"


def _pass(block, same: bool, k: int, dims: int, kind):
    """Search of all anchors of a block in the tiles of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vecs, windows = block.value
        wanted = [_Wanted(a, label, same, w, k) for a, label, w in zip(ids.tolist(), labels.tolist(), windows)]
        held: list[dict] = []

        def search() -> None:
            tree = _Tree(held, dims, kind)
            for q, want in zip(vecs, wanted):
                if want.low:
                    _search(tree, q, want)
            held.clear()

        for batch in batches:
            for i in range(len(batch)):
                held += batch.slice(i, 1).to_pylist()
                if len(held) == GROUP:
                    search()
        if held:
            search()
        rows = [(a, w, i, int(s)) for a, want in enumerate(wanted) for w, (score, found) in enumerate(want.found)
                for s, i in zip(score.tolist(), found.tolist())]
        schema = pa.schema([("anchor", pa.int32()), ("window", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
        for at in range(0, len(rows), 1 << 16):
            part = rows[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(index: Index, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor's positives.

    A negative's score is at least ``low`` and at most ``high`` hundredths of the positive's.
    """
    spark: SparkSession = index.spark
    out = None
    for ids, labels, vecs in index.blocks(anchors):
        every = [(-np.inf if index.kind is np.float64 else -(1 << 62), np.inf if index.kind is np.float64 else 1 << 62)]
        block = spark.sparkContext.broadcast((ids, labels, vecs, [every] * len(ids)))
        found = index.tiles.mapInArrow(_pass(block, True, positives, index.dims, index.kind), FOUND)
        found = _first(found, positives).orderBy("anchor", "rank").collect()  # at most ``positives`` rows an anchor
        windows: list[list[tuple[int, int]]] = [[] for _ in ids]
        pairs = []
        for r in found:
            p = r["score"]
            pairs.append((r["anchor"], len(windows[r["anchor"]]), int(ids[r["anchor"]]), r["vec_id"], p))
            windows[r["anchor"]].append((-(-low * p // 100), high * p // 100))
        block = spark.sparkContext.broadcast((ids, labels, vecs, windows))
        found = index.tiles.mapInArrow(_pass(block, False, negatives, index.dims, index.kind), FOUND)
        pairs = spark.createDataFrame(pairs, "anchor int, window int, anchor_id long, positive_id long, positive_score long")
        part = _first(found, negatives).join(pairs, ["anchor", "window"]).select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"))
        part = stored(part, "negatives")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], RESULT) if out is None else out


def report(embeddings: DataFrame) -> DataFrame:
    """The negatives of every anchor of the table, by the contract's labels, anchors and windows."""
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(Index(prepared(embeddings, relabelled)), F.col("vec_id") % 50 == 0)


SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""
