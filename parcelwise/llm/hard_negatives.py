"""Hard negatives by inner product, found in an R-tree packed by sort-tile-recursion.

1. Components become whole numbers, so all scores are exact.
2. Sort-tile-recursion: quantiles of the coordinate of largest variance cut the rows into
   slabs, quantiles of the second coordinate cut each slab into tiles of about TILE_ROWS
   rows; ties are broken by a hash of the id, so copies of one vector spread over tiles.
   Inside a tile a task sorts by label and goes on with the next coordinates down to leaves.
3. A box's lower and upper corner give, coordinate by coordinate, the interval of its inner
   products with an anchor. A best-first queue takes the box with the highest upper bound and
   drops boxes outside all score windows or strictly below the k-th best found so far.
   Anchors of a block walk a tile's tree together: one product scores a leaf for all that want it.
4. First search: the best rows of the anchor's label in every tile, merged to its positives.
   Second search: each positive's window of scores among rows of other labels, merged alike.

Every block of anchors meets every tile, one task each; a task holds a tile and a block.
Quantiles have one number a tile; they are joined by slab, nothing is gathered.

Defined results: a row with a null id, label or vector, or with a null or non-finite component,
takes no part. A shorter vector counts as filled up with zeros. Rows that repeat an id count
as one: the smallest label, then the smallest vector. Higher scores come first, ties by the
smaller id. No rows, or no anchors, give no rows. Components must fit in 31 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelwise.llm import tables

TILE_ROWS = 16384
LEAF_ROWS = 256
FAN = 8
#: Anchors that walk a tile together.
ANCHORS_A_BLOCK = 4096
#: Anchors scored against a leaf at once.
ANCHORS_AT_ONCE = 512
#: Coordinates that a tile is sorted by, one after the other.
SORTED_BY = 4
_NONE = np.iinfo(np.int64).min


# -- Whole numbers -----------------------------------------------------------
def _components(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and whole-number vectors of the usable rows, one pair for each length."""
    vectors = batch.column("vector").cast(pa.large_list(pa.float64()))
    usable = pc.and_(pc.is_valid(vectors), pc.and_(pc.is_valid(batch.column("id")), pc.is_valid(batch.column("label")))).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)  # a null component becomes NaN
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    for size in np.unique(sizes[usable]):
        rows = np.flatnonzero(usable & (sizes == size))
        values = flat[starts[rows][:, None] + np.arange(size)]
        rows, values = rows[np.isfinite(values).all(axis=1)], values[np.isfinite(values).all(axis=1)]
        whole = np.floor(scale * values)
        if whole.size and np.abs(whole).max() >= 1 << 31:
            raise ValueError("a component needs more than 31 bits")
        yield rows, whole.astype(np.int32)


def _spread(scale: float):
    """Per coordinate: rows, sum, sum of squares, largest magnitude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, q in _components(batch, scale):
                x = q.astype(np.float64)
                if x.size:
                    yield pa.RecordBatch.from_pydict({
                        "dim": np.arange(x.shape[1], dtype=np.int32), "n": np.full(x.shape[1], len(x)), "s": x.sum(axis=0), "ss": (x * x).sum(axis=0), "top": np.abs(x).max(axis=0),
                    })

    return run, "dim int, n bigint, s double, ss double, top double"


def _vectors(scale: float, width: int, dims: list[int]):
    """id, label, the whole-number vector, and two coordinates to tile by."""
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("c1", pa.float64()), ("c2", pa.float64()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, q in _components(batch, scale):
                full = np.zeros((len(rows), width), np.int32)
                full[:, : q.shape[1]] = q
                c1, c2 = (full[:, d].astype(np.float64) if d < width else np.zeros(len(rows)) for d in (*dims, width, width)[:2])
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("label").take(take), pa.array(c1), pa.array(c2), pa.array([v.tobytes() for v in full], pa.binary())], schema=schema)

    return run, "id bigint, label bigint, c1 double, c2 double, vector binary"


# -- Tiles -------------------------------------------------------------------
def _cuts(n: int) -> list[float]:
    return [k / n for k in range(1, n)]


def _place(bounds: Column, value: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b < value))


def tiled(rows: DataFrame, tile_rows: int) -> tuple[DataFrame, int]:
    """Give each row a tile, numbered from 0; the table is written, as its numbers must not change."""
    total = rows.count()
    tiles = max(1, -(-total // tile_rows))
    slabs = int(np.ceil(np.sqrt(tiles)))
    runs = -(-tiles // slabs)
    # The hash parts rows that share a coordinate, copies of one vector too.
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    keyed = rows.withColumns({"c1": F.col("c1") + part, "c2": F.col("c2") + part})
    if slabs == 1:
        keyed = keyed.withColumn("slab", F.lit(0))
    else:
        bounds = keyed.agg(F.percentile_approx("c1", _cuts(slabs), 10_000)).first()[0]
        keyed = keyed.withColumn("slab", _place(F.array(*map(F.lit, bounds)), F.col("c1")))
    if runs == 1:
        keyed = keyed.withColumn("run", F.lit(0))
    else:
        edges = keyed.groupBy("slab").agg(F.percentile_approx("c2", _cuts(runs), 10_000).alias("edges"))
        keyed = keyed.join(edges, "slab").withColumn("run", _place(F.col("edges"), F.col("c2")))
    return tables.written(keyed.select((F.col("slab") * runs + F.col("run")).alias("tile"), "id", "label", "vector"), "tiles"), slabs * runs


# -- The tree of a tile ------------------------------------------------------
def _packed_order(x: np.ndarray, rows: np.ndarray, dims: list[int]) -> list[np.ndarray]:
    """Sort-tile-recursion: `rows` in leaf order."""
    leaves = -(-len(rows) // LEAF_ROWS)
    if leaves <= 1 or not dims:
        return [rows]
    rows = rows[np.argsort(x[rows, dims[0]], kind="stable")]
    slabs = int(np.ceil(leaves ** (1 / len(dims))))
    size = -(-leaves // slabs) * LEAF_ROWS
    return [leaf for at in range(0, len(rows), size) for leaf in _packed_order(x, rows[at : at + size], dims[1:])]


class Tree:
    """Leaves of LEAF_ROWS rows; FAN nodes of a level share a parent. Level 0 holds the leaves."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        spread = np.argsort(-x.var(axis=0, dtype=np.float64), kind="stable")[:SORTED_BY].tolist() if len(x) else []
        by_label = [np.flatnonzero(labels == label) for label in np.unique(labels)]
        order = np.concatenate([leaf for rows in by_label for leaf in _packed_order(x, rows, spread)])
        self.starts = np.append(np.arange(0, len(order), LEAF_ROWS), len(order))
        # Inside a leaf by id: of equal scores the first is the smallest id.
        leaf_of = np.arange(len(order)) // LEAF_ROWS
        order = order[np.lexsort((ids[order], leaf_of))]
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        first = self.starts[:-1]
        at = lambda f, v: f.reduceat(v, first, axis=0)
        self.levels = [(at(np.minimum, self.x), at(np.maximum, self.x), at(np.minimum, self.labels), at(np.maximum, self.labels))]
        while len(self.levels[-1][0]) > 1:
            low, high, low_label, high_label = self.levels[-1]
            first = np.arange(0, len(low), FAN)
            self.levels.append((np.minimum.reduceat(low, first, axis=0), np.maximum.reduceat(high, first, axis=0), np.minimum.reduceat(low_label, first), np.maximum.reduceat(high_label, first)))


class Search:
    """The k best rows of a tree for each anchor and window of scores."""

    def __init__(self, tree: Tree, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same_label: bool) -> None:
        self.tree, self.ids, self.labels, self.low, self.high, self.k, self.same = tree, ids, labels, low, high, k, same_label
        self.x = x
        self.up, self.down = np.maximum(x, 0), np.minimum(x, 0)
        self.score = np.full((*low.shape, k), _NONE)
        self.found = np.full((*low.shape, k), np.iinfo(np.int64).max)
        self.leaves_scored = 0

    def _bounds(self, level: int, nodes: slice, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = (side[nodes].T for side in self.tree.levels[level][:2])
        up, down = self.up[who], self.down[who]
        return (up @ low + down @ high).astype(np.int64), (up @ high + down @ low).astype(np.int64)

    def _wanted(self, who: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Anchors for which the box's interval meets a window and is not strictly below its k-th best."""
        floor = np.maximum(self.low[who], self.score[who, :, -1])
        return ((most[:, None] >= floor) & (least[:, None] <= self.high[who])).any(axis=1)

    def run(self) -> None:
        top = len(self.tree.levels) - 1
        everyone = np.flatnonzero((self.low <= self.high).any(axis=1))
        queue, tie = [], 0

        def push(level: int, nodes: slice, who: np.ndarray) -> None:
            nonlocal tie
            least, most = self._bounds(level, nodes, who)
            low_label, high_label = (side[nodes] for side in self.tree.levels[level][2:])
            for j in range(least.shape[1]):
                own = self.labels[who]
                inside = (low_label[j] <= own) & (own <= high_label[j])
                fits = inside if self.same else ~(inside & (low_label[j] == high_label[j]))
                live = np.flatnonzero(fits)
                live = live[self._wanted(who[live], least[live, j], most[live, j])]
                if len(live):
                    tie += 1
                    heapq.heappush(queue, (-int(most[live, j].max()), tie, level, nodes.start + j, who[live], least[live, j], most[live, j]))

        if len(everyone):
            push(top, slice(0, 1), everyone)
        while queue:
            _, _, level, node, who, least, most = heapq.heappop(queue)
            who = who[self._wanted(who, least, most)]
            if not len(who):
                continue
            if level:
                push(level - 1, slice(node * FAN, min((node + 1) * FAN, len(self.tree.levels[level - 1][0]))), who)
            else:
                for at in range(0, len(who), ANCHORS_AT_ONCE):
                    self._leaf(node, who[at : at + ANCHORS_AT_ONCE])

    def _leaf(self, node: int, who: np.ndarray) -> None:
        rows = slice(self.tree.starts[node], self.tree.starts[node + 1])
        self.leaves_scored += 1
        ids, labels = self.tree.ids[rows], self.tree.labels[rows]
        score = (self.x[who] @ self.tree.x[rows].T).astype(np.int64)
        match = labels == self.labels[who][:, None]
        able = (match & (ids != self.ids[who][:, None])) if self.same else ~match
        size, k = len(ids), min(self.k, len(ids))
        # One number orders by score, then by the smaller id.
        rank = score * size + np.arange(size - 1, -1, -1)
        for w in range(self.low.shape[1]):
            floor = np.maximum(self.low[who, w], self.score[who, w, -1])
            good = able & (score >= floor[:, None]) & (score <= self.high[who, w][:, None])
            some = np.flatnonzero(good.any(axis=1))
            if not len(some):
                continue
            keyed = np.where(good[some], rank[some], _NONE)
            best = np.argpartition(keyed, size - k, axis=1)[:, size - k :]
            real = np.take_along_axis(good[some], best, axis=1)
            new = np.where(real, np.take_along_axis(score[some], best, axis=1), _NONE)
            new_ids = np.where(real, ids[best], np.iinfo(np.int64).max)
            at = who[some]
            scores, found = np.concatenate((self.score[at, w], new), axis=1), np.concatenate((self.found[at, w], new_ids), axis=1)
            order = np.lexsort((found, -np.maximum(scores, _NONE + 1)), axis=1)[:, : self.k]
            self.score[at, w], self.found[at, w] = np.take_along_axis(scores, order, axis=1), np.take_along_axis(found, order, axis=1)


def _array(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _matrix(table: pa.Table, kind: type) -> np.ndarray:
    vectors = table.column("vector").combine_chunks()
    return np.frombuffer(b"".join(vectors.to_pylist()), np.int32).reshape(len(vectors), -1).astype(kind)


_HITS = pa.schema([("anchor_id", pa.int64()), ("part", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])


def _searched(k: int, same_label: bool, kind: type):
    """Search of one tile for one block of anchors; `part` numbers the anchor's windows."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return _HITS.empty_table()
        tree = Tree(_array(rows, "id"), _array(rows, "label"), _matrix(rows, kind))
        low, high = (np.array(anchors.column(c).to_pylist(), np.int64).reshape(anchors.num_rows, -1) for c in ("low", "high"))
        ids = _array(anchors, "id")
        search = Search(tree, ids, _array(anchors, "label"), _matrix(anchors, kind), low, high, k, same_label)
        search.run()
        who, window, slot = np.nonzero(search.score > _NONE)
        return pa.Table.from_arrays([pa.array(ids[who]), pa.array(window.astype(np.int32)), pa.array(search.score[who, window, slot]), pa.array(search.found[who, window, slot])], schema=_HITS)

    return run


def _best(index: DataFrame, tiles: int, anchors: DataFrame, blocks: int, k: int, same_label: bool, kind: type) -> DataFrame:
    """anchor_id, part, score, id, rank: the k best over all tiles."""
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("block", every(blocks))
    right = anchors.withColumn("block", block).withColumn("tile", every(tiles))
    hits = left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInArrow(_searched(k, same_label, kind), "anchor_id bigint, part int, score bigint, id bigint")
    order = Window.partitionBy("anchor_id", "part").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchor: Column, scale: float = 256.0, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """Hard negatives for the rows where `anchor` (a condition on `id`) holds.

    `rows` has id, label and vector (array of numbers). For each anchor and each of its best rows of its label:
    the best rows of other labels whose score is `low` to `high` percent of the positive's.
    """
    rows = rows.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    run, schema = _spread(scale)
    spread = rows.mapInArrow(run, schema).groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.max("top").alias("top")).collect()  # one row a coordinate
    width = 1 + max((r.dim for r in spread), default=0)
    top = max((r.top for r in spread), default=0.0)
    # The narrowest numbers that hold every sum of products exactly; boxes have the same bound.
    reach = width * top * top
    kind = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64
    dims = [r.dim for r in sorted(spread, key=lambda r: (r.s * r.s / r.n - r.ss, r.dim))[:2]]
    run, schema = _vectors(scale, width, dims)
    # One row an id; the id's rows meet after a map-side minimum.
    whole = rows.mapInArrow(run, schema).groupBy("id").agg(F.min(F.struct("label", "vector", "c1", "c2")).alias("row")).select("id", "row.*")
    index, tiles = tiled(tables.written(whole, "vectors"), tile_rows)
    chosen = tables.written(index.where(anchor).select("id", "label", "vector"), "anchors")
    blocks = max(1, -(-chosen.count() // ANCHORS_A_BLOCK))
    free = lambda v: F.array(F.lit(v).cast("bigint"))
    first = _best(index, tiles, chosen.withColumns({"low": free(_NONE), "high": free(-_NONE - 1)}), blocks, positives, True, kind)
    first = tables.written(first.select("anchor_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # At most `positives` windows an anchor; a missing one is empty.
    score = F.col("positive_score")
    windows = first.groupBy(F.col("anchor_id").alias("id")).pivot("place", list(range(1, positives + 1))).agg(F.first(score))
    edge = lambda p, f, share: F.coalesce(f(F.col(str(p)).cast("decimal(20,0)") * share / F.lit(100)).cast("bigint"), F.lit(0))
    lows = F.array(*(F.when(F.col(str(p)).isNull(), F.lit(1)).otherwise(edge(p, F.ceil, low)).cast("bigint") for p in range(1, positives + 1)))
    highs = F.array(*(edge(p, F.floor, high) for p in range(1, positives + 1)))
    asked = chosen.join(windows.select("id", lows.alias("low"), highs.alias("high")), "id")
    second = _best(index, tiles, asked, blocks, negatives, False, kind)
    named = second.select("anchor_id", (F.col("part") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(first, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = tables.prepared(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")), F.col("id") % 100 == 0)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {
    "op12_hard_negatives": r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, list_dot_product(a.q, o.q)::BIGINT AS score
      FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10""",
}
