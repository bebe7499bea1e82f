"""Hard negatives by dual-tree search (op12): trees over anchors and over candidates, whose node pairs are pruned by inner-product intervals.

Vectors become integers (`floor(scale * x)`), so scores are exact. Candidates are dealt by label and nearest of `pivots` drawn rows, so that
like ones lie together, and cut into shards; the anchors likewise into blocks. In a shard or block each label has a ball tree: nodes with a
centre and a radius, halved along their widest component down to leaves of 32 candidates or 8 anchors. Two nodes with centres c, d and radii r, s have inner products within
c.d -+ (|c|s + |d|r + rs). A search goes down both trees at once, level by level; a pair of nodes is dropped, for all anchors below, if its
interval lies outside what any of them still looks for: above the scores they hold and inside their windows. Pairs of leaves are scored
exactly, best bounds first, so what is held rises soon.

It runs twice: for the positives (same label, no window), then for negatives (other labels, a window of scores for each positive). All
blocks meet all shards, as the anchors are asked against all rows; a task takes several shards and returns the best of them, at most k rows
an anchor and window, which are merged by Spark. Shards and blocks have a fixed number of rows, so a task's memory is bounded.

Rows with a null label or vector, or a component that is null or not finite, take no part. Vectors of different lengths count as filled up with zeros.
Ties go to the smaller key, null last. Rows that share a key are candidates each; an anchor's own key is none of its positives, and
anchor rows that share a key have rows of their own. Scores beyond 62 bits are held at that. An anchor without positives, or a positive with no row
in its window, gives no rows; neither does an empty table. Only the three columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.base import cut, table

LEAF, ANCHOR_LEAF = 32, 8
MOST = 1 << 62


def integral(rows: DataFrame, key: str, vector: str, label: str, scale: float) -> DataFrame:
    """(key, label, vector) of the rows that take part, with whole components."""
    fit = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    return rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & fit).select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), whole.alias("vector"))


def dense(col: pa.Array, width: int) -> np.ndarray:
    """Lists of doubles as a matrix, filled up with zeros."""
    at = col.offsets.to_numpy() - col.offsets[0].as_py()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(at)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(at[:-1], size)] = flat
    return out


@dataclass
class Tree:
    """Ball trees, one a label, over rows in the order of their leaves. nodes: label, first row, end, left and right child (-1: a leaf)."""

    rows: np.ndarray
    key: np.ndarray
    null: np.ndarray
    nodes: np.ndarray
    roots: np.ndarray
    centre: np.ndarray
    radius: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, label: np.ndarray, key: np.ndarray, null: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.lexsort((key, label))
        nodes, roots, todo = [], [], []
        edge = np.flatnonzero(np.append(True, np.diff(label[order]) != 0))
        for lo, hi in zip(edge.tolist(), np.append(edge[1:], len(order)).tolist(), strict=True):
            roots.append(len(nodes))
            nodes.append([int(label[order[lo]]), lo, hi, -1, -1])
            todo.append(roots[-1])
        while todo:
            node = nodes[todo.pop()]
            of, lo, hi = node[:3]
            if hi - lo <= leaf:
                continue
            part = rows[order[lo:hi]]
            widest = int(np.argmax(part.max(axis=0) - part.min(axis=0))) if part.shape[1] else 0
            mid = (hi - lo) // 2
            if part.shape[1]:
                order[lo:hi] = order[lo:hi][np.argpartition(part[:, widest], mid)]
            node[3:] = [len(nodes), len(nodes) + 1]
            nodes += [[of, lo, lo + mid, -1, -1], [of, lo + mid, hi, -1, -1]]
            todo += node[3:]
        rows, table_ = rows[order], np.array(nodes, np.int64).reshape(-1, 5)
        centre = np.array([rows[lo:hi].mean(axis=0) for lo, hi in table_[:, 1:3]]).reshape(len(table_), rows.shape[1])
        radius = np.array([np.sqrt(((rows[lo:hi] - c) ** 2).sum(axis=1).max()) for (lo, hi), c in zip(table_[:, 1:3], centre, strict=True)])
        return cls(rows, key[order], null[order], table_, np.array(roots, np.int64), centre, radius)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole components."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    exact = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    return np.array([[min(max(x, -MOST), MOST) for x in row] for row in exact], np.int64).reshape(len(a), len(b))


class Windows:
    """What the anchors of a block look for. anchor: the row each window belongs to, ascending; low, high: scores it takes."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.anchor, self.low, self.high, self.k = anchor, low, high, k
        self.least = low.copy()  # below this, nothing gets in
        self.of = self.score = self.key = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def take(self, of: np.ndarray, score: np.ndarray, key: np.ndarray, null: np.ndarray) -> None:
        seen = np.isin(self.of, np.unique(of))
        of, score, key, null = (np.concatenate([a[seen], b]) for a, b in ((self.of, of), (self.score, score), (self.key, key), (self.null, null)))
        order = np.lexsort((key, null, -score, of))
        of, score, key, null = of[order], score[order], key[order], null[order]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        size = np.diff(np.append(first, len(of)))
        keep = np.arange(len(of)) - np.repeat(first, size) < self.k
        full = first[size >= self.k]
        self.least[of[full]] = np.maximum(self.low[of[full]], score[full + self.k - 1])
        self.of, self.score, self.key, self.null = (np.concatenate([a[~seen], b[keep]]) for a, b in ((self.of, of), (self.score, score), (self.key, key), (self.null, null)))


def search(anchors: Tree, candidates: Tree, windows: Windows, same: bool) -> int:
    """Updates `windows` by the candidates of the same label, or of the others; returns how many pairs were scored."""
    w_from, w_to = np.searchsorted(windows.anchor, anchors.nodes[:, 1]), np.searchsorted(windows.anchor, anchors.nodes[:, 2])
    scored = 0

    def sought() -> tuple[np.ndarray, np.ndarray]:
        """Of each node of the anchors: the least and greatest score that any window below it takes."""
        low = [windows.least[a:b].min(initial=MOST) for a, b in zip(w_from, w_to, strict=True)]
        high = [windows.high[a:b].max(initial=-MOST) for a, b in zip(w_from, w_to, strict=True)]
        return np.array(low, float), np.array(high, float)

    def bounds(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mid, nq, nr = np.einsum("ij,ij->i", anchors.centre[q], candidates.centre[r]), a_norm[q], c_norm[r]
        off = nq * candidates.radius[r] + nr * anchors.radius[q] + anchors.radius[q] * candidates.radius[r]
        off = off + 1 + 1e-9 * (nq + anchors.radius[q]) * (nr + candidates.radius[r])  # rounding
        return mid - off, mid + off

    a_norm, c_norm = np.sqrt((anchors.centre**2).sum(axis=1)), np.sqrt((candidates.centre**2).sum(axis=1))
    low, high = sought()
    q, r = (x.ravel() for x in np.meshgrid(anchors.roots, candidates.roots, indexing="ij"))
    like = anchors.nodes[q, 0] == candidates.nodes[r, 0]
    q, r = (x[like if same else ~like] for x in (q, r))
    leaf_q, leaf_r, leaf_hi = [], [], []
    while len(q):
        at_least, at_most = bounds(q, r)
        on = (at_most >= low[q]) & (at_least <= high[q])
        q, r, at_most = q[on], r[on], at_most[on]
        lq, lr = anchors.nodes[q, 3] < 0, candidates.nodes[r, 3] < 0
        leaf_q.append(q[lq & lr])
        leaf_r.append(r[lq & lr])
        leaf_hi.append(at_most[lq & lr])
        split_q = ~lq & (lr | (anchors.radius[q] >= candidates.radius[r]))
        split_r = ~lr & ~split_q
        q, r = (
            np.concatenate([anchors.nodes[q[split_q], 3], anchors.nodes[q[split_q], 4], q[split_r], q[split_r]]),
            np.concatenate([r[split_q], r[split_q], candidates.nodes[r[split_r], 3], candidates.nodes[r[split_r], 4]]),
        )
    if not sum(map(len, leaf_q)):
        return 0
    q, r, hi = (np.concatenate(x) for x in (leaf_q, leaf_r, leaf_hi))
    order = np.lexsort((-hi, q))
    q, r, hi = q[order], r[order], hi[order]
    edge = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    for lo, upto in zip(edge.tolist(), np.append(edge[1:], len(q)).tolist(), strict=True):
        node = q[lo]
        a, b, (first, end) = w_from[node], w_to[node], anchors.nodes[node, 1:3]
        owner = windows.anchor[a:b] - first
        at, step = lo, 2
        while at < upto:
            if hi[at] < windows.least[a:b].min(initial=MOST):
                break
            rows = np.concatenate([np.arange(*candidates.nodes[x, 1:3]) for x in r[at : min(at + step, upto)]])
            at, step = at + step, min(step * 2, 32)
            score = products(anchors.rows[first:end], candidates.rows[rows])
            scored += score.size
            each = score[owner]
            hit = (each >= windows.least[a:b, None]) & (each <= windows.high[a:b, None])
            if same:
                hit &= (anchors.key[first:end][owner][:, None] != candidates.key[rows]) | candidates.null[rows]
            w, c = np.nonzero(hit)
            if len(w):
                windows.take(w + a, each[w, c], candidates.key[rows[c]], candidates.null[rows[c]])
    return scored


PACK = "pack long, label array<long>, key array<long>, null array<boolean>, cells array<double>"


def packs(rows: DataFrame, width: int, pack_rows: int, pivots: int) -> DataFrame:
    """Rows by label and nearest pivot, at most `pack_rows` in a row of the result, as flat arrays."""
    some = [x for (x,) in rows.select("vector").orderBy(F.xxhash64("key", "vector"), "key").limit(pivots).collect()]
    drawn = np.array([[*x, *[0.0] * (width - len(x))] for x in some]).reshape(len(some), width)
    half = (drawn**2).sum(axis=1) / 2

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                place = np.argmax(dense(b.column(2), width) @ drawn.T - half, axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int64())], names=[*b.schema.names, "pivot"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            cells = dense(t.column("vector").combine_chunks(), width).ravel()
            key = t.column("key").combine_chunks()
            cols = [pa.array([number])]
            for x in (t.column("label").combine_chunks(), key.fill_null(0), key.is_null(), pa.array(cells)):
                cols.append(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x))
            number, size = number + 1, 0
            return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in PACK.split(", ")])

        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, pack_rows - size)
                held.append(part)
                at, size = at + part.num_rows, size + part.num_rows
                if size == pack_rows:
                    yield flush()
        if size:
            yield flush()

    placed = rows.mapInArrow(near, "key long, label long, vector array<double>, pivot long")
    parts = max(1, -(-rows.count() // pack_rows))
    spread = placed.repartitionByRange(parts, "label", "pivot", F.xxhash64("key", "vector")).sortWithinPartitions("label", "pivot")
    return cut(spread.select("key", "label", "vector").coalesce(parts).mapInArrow(pack, PACK))  # full packs, however many partitions a session asks for


def unpacked(b: pa.RecordBatch, i: int, width: int, prefix: str = "") -> Tree:
    label, key, null, cells = (b.column(b.schema.get_field_index(prefix + c))[i].values.to_numpy(zero_copy_only=False) for c in ("label", "key", "null", "cells"))
    return Tree.of(cells.reshape(len(label), width), label, key, null, ANCHOR_LEAF if prefix else LEAF)


def met(shards: DataFrame, blocks: DataFrame, width: int, k: int, same: bool, together: int) -> DataFrame:
    """(pack, place, window, found, score): for each window of an anchor of a block (`pack`, at `place` of its tree) the k best of all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple[Tree, Windows, np.ndarray]] = {}
        shard, candidates = None, None  # a shard's rows follow one another
        for b in batches:
            for i in range(b.num_rows):
                if (own := b.column(b.schema.get_field_index("pack"))[i].as_py()) != shard:
                    shard, candidates = own, unpacked(b, i, width)
                pack = b.column(b.schema.get_field_index("a_pack"))[i].as_py()
                if pack not in state:
                    tree = unpacked(b, i, width, "a_")
                    if same:
                        anchor = window = np.arange(len(tree.key))
                        low, high = np.full(len(anchor), -MOST), np.full(len(anchor), MOST)
                    else:
                        anchor, window, low, high = (b.column(b.schema.get_field_index(c))[i].values.to_numpy() for c in ("w_place", "w_window", "w_low", "w_high"))
                    state[pack] = tree, Windows(anchor, low.copy(), high, k), window
                search(state[pack][0], candidates, state[pack][1], same)
        for pack, (tree, w, window) in state.items():
            place = w.anchor[w.of]
            cols = [np.full(len(w.of), pack), place, window[w.of], tree.key[place], pa.array(w.key, mask=w.null), w.score]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["pack", "place", "window", "anchor_id", "found", "score"])

    pairs = shards.coalesce(max(1, -(-shards.count() // together))).crossJoin(blocks.select(*(F.col(c).alias(c if c.startswith("w_") else f"a_{c}") for c in blocks.columns)))
    best = pairs.mapInArrow(run, "pack long, place long, window long, anchor_id long, found long, score long")
    order = W.partitionBy("pack", "place", "window").orderBy(F.col("score").desc(), F.col("found").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10,
    window: tuple[int, int] = (30, 90), scale: float = 256.0, shard_rows: int = 4096, block_rows: int = 1024, pivots: int = 64, together: int = 4,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row of `anchor` (a condition on the key, named
    `key`, and label) and each of its best `positives` of its label, the best `negatives` of other labels that score within `window` percent of the positive."""
    taken = cut(integral(rows, key, vector, label, scale))
    width = taken.agg(F.max(F.size("vector"))).first()[0] or 0
    shards, blocks = packs(taken, width, shard_rows, pivots), packs(taken.where(anchor), width, block_rows, pivots)
    like = cut(met(shards, blocks, width, positives, True, together).select("pack", "place", "rank", F.col("found").alias("positive_id"), F.col("score").alias("positive_score")))
    lo, hi = window
    low, high = F.expr(f"cast(ceil(cast({lo} as decimal(38, 0)) * positive_score / 100) as long)"), F.expr(f"cast(floor(cast({hi} as decimal(38, 0)) * positive_score / 100) as long)")
    asked = like.withColumns({"low": low, "high": high}).where(F.col("low") <= F.col("high"))
    lists = asked.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("place", F.col("rank").cast("long").alias("window"), "low", "high"))).alias("w"))  # a block's: few
    sought = blocks.join(lists.select("pack", *(F.col(f"w.{c}").alias(f"w_{c}") for c in ("place", "window", "low", "high"))), "pack")
    far = met(shards, cut(sought), width, negatives, False, together)
    named = far.join(like.withColumnRenamed("rank", "window"), ["pack", "place", "window"])
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id is divisible by 100 against all rows; every seventh row's label is another."""
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("key") % 100 == 0)


OP12_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM e a, e c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 10
"""
