"""Labels of a signed graph moved in turns, on blocks of nodes that lie as arrays.

Nodes are dealt by ranges of component and name to blocks of about as many edges each; a node's number is its block's first one and its place
there. A block's edges, which end at its nodes, are dealt to a task once and stay there. In a turn each block tells all others which of its nodes
move in which starts (some bits a node), and each task sums up what that changes for its own nodes. What blocks tell is shuffled, a copy for
each block; a component that reaches over blocks is summed up from a row or two of each block.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from spanloom.operators.written import cut

#: Edges of a block: for parallel work on few of them, and at most.
FEW_EDGES, BLOCK_EDGES, FEW_BLOCKS = 1 << 17, 1 << 22, 16
#: Edges in a row.
ROW_EDGES = 1 << 18

STATE = "block int, own binary, said binary, ends binary"
DEALT = "block int, nodes binary, dest binary, src binary, overlap binary, contact binary"


def hashed(h: np.ndarray, x: int) -> np.ndarray:
    """What `xxhash64(..., x)` makes of the hash of what comes before x, an int."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = h.view(np.uint64) + p5 + np.uint64(4)
    h ^= np.array([x & 0xFFFFFFFF], np.uint64) * p1
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def less(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (a[0] < b[0]) | ((a[0] == b[0]) & (a[1] < b[1]))


def packed(moves: np.ndarray, bits: int) -> bytes:
    """Moves (start, node) of `bits` bits, 0 where a node stays in all starts."""
    any_ = moves.any(axis=0)
    return pickle.dumps((np.packbits(any_), np.packbits((moves[:, any_, None] >> np.arange(bits, dtype=np.uint8)) & 1)))


def unpacked(data: bytes, starts: int, n: int, bits: int) -> np.ndarray:
    mask, held = pickle.loads(data)
    any_ = np.unpackbits(mask, count=n).astype(bool)
    m = int(any_.sum())
    out = np.zeros((starts, n), np.uint8)
    out[:, any_] = (np.unpackbits(held, count=starts * m * bits).reshape(starts, m, bits) << np.arange(bits, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
    return out


class Blocks:
    """The nodes (node, component) and their edges `near` (node, other, overlap, contact, both ways), dealt to blocks.

    index: node, component, block, place. dealt: a row with the nodes' hashes and components' numbers of each block, and rows with its edges.
    """

    def __init__(self, n: DataFrame, near: DataFrame):
        edges = near.count()
        few = max(edges // BLOCK_EDGES, min(FEW_BLOCKS, edges // FEW_EDGES), 1)
        zero = F.lit(0.0)
        alone = n.select("component", "node", F.lit(None).cast(near.schema["other"].dataType).alias("other"), zero.alias("overlap"), zero.alias("contact"))
        rows = alone.unionByName(near.join(n.select("node", "component"), "node").select("component", "node", "other", "overlap", "contact"))
        rows = rows.repartitionByRange(few, "component", "node").sortWithinPartitions("component", "node", F.col("other").asc_nulls_first())

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, at = TaskContext.get().partitionId(), -1
            for b in batches:
                place = at + np.cumsum(b.column(2).is_null().to_numpy(zero_copy_only=False))
                at = place[-1] if len(place) else at
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(place), block, np.int32)), pa.array(place.astype(np.int64))], names=[*b.schema.names, "block", "place"])

        laid = cut(rows.mapInArrow(placed, StructType([*rows.schema.fields, StructField("block", IntegerType()), StructField("place", LongType())])))
        self.index = laid.where("other is null").select("node", "component", "block", "place")
        found = self.index.groupBy("block").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).orderBy("block").collect()  # a row a block
        self.count = found[-1]["block"] + 1 if found else 0
        size = np.zeros(self.count, np.int64)
        # components by number, where a block begins and where it ends; one number where a component reaches over blocks
        self.ends: dict[int, tuple[int, int]] = {}
        number, last = -1, None
        for r in found:
            size[r["block"]] = r["size"]
            number += r["lo"] != last or number < 0
            lo, number = number, number + (r["lo"] != r["hi"])
            self.ends[r["block"]], last = (lo, number), r["hi"]
        first = self.first = np.append(0, np.cumsum(size))
        self.parts = 2 * max(self.count, 1)
        if not self.count:
            return

        def nodes(t: pa.Table) -> pa.Table:
            t = t.sort_by("place")
            h, c = t.column("h").to_numpy(), t.column("component").combine_chunks()
            new = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            of = np.append(0, np.cumsum(new)).astype(np.int32)
            return pa.table({"block": t.column("block").slice(0, 1), "nodes": pa.array([pickle.dumps((h, of))]), **{x: pa.nulls(1, pa.binary()) for x in ("dest", "src", "overlap", "contact")}})

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple]] = defaultdict(list)
            rows: dict[int, int] = defaultdict(int)

            def row(block: int) -> pa.RecordBatch:
                rows.pop(block)
                cols = [np.concatenate(x).tobytes() for x in zip(*held.pop(block), strict=True)]
                return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.nulls(1, pa.binary()), *(pa.array([x], pa.binary()) for x in cols)], names=[x.split()[0] for x in DEALT.split(", ")])

            for b in batches:
                block, place, other_block, other_place, overlap, contact = (x.to_numpy() for x in b.columns)
                for x in np.unique(block).tolist():
                    own = block == x
                    held[x].append((place[own].astype(np.int32), (first[other_block[own]] + other_place[own]).astype(np.int32), overlap[own], contact[own]))
                    rows[x] += int(own.sum())
                    if rows[x] >= ROW_EDGES:
                        yield row(x)
            for x in list(rows):
                yield row(x)

        there = self.index.select(F.col("node").alias("other"), F.col("block").alias("other_block"), F.col("place").alias("other_place"))
        near = laid.where("other is not null").join(there, "other").select("block", "place", "other_block", "other_place", "overlap", "contact")
        near = near.repartition(self.parts, "block").mapInArrow(ends, DEALT)
        own = self.index.withColumn("h", F.xxhash64("node")).groupBy("block").applyInArrow(nodes, DEALT)
        self.dealt = own.unionByName(near).repartition(self.parts, "block").sortWithinPartitions("block").persist()
        self.dealt.count()

    def met(self, state: DataFrame, f) -> DataFrame:
        """f of each block's own state, what all blocks said, and its nodes and edges; written. f gives a new state."""
        first, count = self.first, self.count

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            own, said = None, {}
            for block, sender, data in zip(*(left.column(c).to_pylist() for c in ("to", "block", "data")), strict=True):
                if sender is None:
                    own = pickle.loads(data)
                elif data is not None:
                    said[sender] = data
            nodes, edges = None, []
            for row, *cells in zip(*(right.column(c) for c in ("nodes", "dest", "src", "overlap", "contact")), strict=True):
                if row.is_valid:
                    nodes = pickle.loads(row.as_buffer())
                else:
                    edges.append(tuple(np.frombuffer(x.as_buffer(), t) for x, t in zip(cells, (np.int32, np.int32, np.float64, np.float64), strict=True)))
            return row_of(block, *f(block, own, said, nodes, edges))

        row = lambda to, data, block: F.struct(to.alias("to"), data.alias("data"), block.alias("block"))
        mine = F.array(row(F.col("block"), F.col("own"), F.lit(None).cast("int")))
        to = state.select(F.inline(F.concat(mine, F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda x: row(x, F.col("said"), F.col("block"))))))
        return cut(to.where("data is not null").groupBy("to").cogroup(self.dealt.groupBy("block")).applyInArrow(run, STATE))


def row_of(block: int, own: dict, said: bytes | None, ends: object = None) -> pa.Table:
    cells = [pa.array([x], pa.binary()) for x in (pickle.dumps(own), said, pickle.dumps(ends))]
    return pa.table([pa.array([block], pa.int32()), *cells], names=[x.split()[0] for x in STATE.split(", ")])


def improved(n: DataFrame, near: DataFrame, labels: DataFrame, k: int, starts: int, rounds: int, seed: int) -> DataFrame:
    """(node, component, label): the best of `starts` labellings, each moved until no node by itself gains, or for `rounds`.

    n: node, component; near: node, other, overlap, contact, both ways; labels: node, label, the first start's; the others are by hash.
    What a node's neighbours cost it by label is kept with it, and what the moves that are tried change of that.
    """
    blocks = Blocks(n, near)
    if not blocks.count:
        return n.join(labels, "node").select("node", "component", "label")
    first, known, bits = blocks.first, blocks.ends, ((k + 1) * k).bit_length()

    def priced(label: np.ndarray, sums: np.ndarray) -> tuple:
        """(overlap, minus contact) under the own label, the gain by the best other one, and that label, -1 if it gains nothing."""
        o, c = sums[0].reshape(*label.shape, k), -sums[1].reshape(*label.shape, k)
        at = lambda x: np.take_along_axis(x, label[..., None].astype(np.int64), 2)[..., 0]
        own, best, to = (at(o), at(c)), (np.full(label.shape, np.inf), np.full(label.shape, np.inf)), np.zeros(label.shape, np.int8)
        for p in range(k):
            better = (label != p) & less((o[..., p], c[..., p]), best)
            best = np.where(better, o[..., p], best[0]), np.where(better, c[..., p], best[1])
            to[better] = p
        gain = best[0] - own[0], best[1] - own[1]
        return own, gain, np.where(less(gain, (0.0, 0.0)), to, -1).astype(np.int8)

    def totals(label: np.ndarray, sums: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """A component's cost in each start, and how many nodes gain by themselves."""
        own, _, to = priced(label, sums)
        return [np.add.reduceat(x, at, axis=1) for x in (own[0] / 2, own[1] / 2, (to >= 0).astype(np.float64))]

    def judged(own: dict, of: np.ndarray) -> np.ndarray:
        """was, new: overlap, minus contact, nodes that gain; by start and component."""
        at = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        return np.stack(totals(own["label"], own["sums"], at) + totals(own["new"], own["sums"] + own["change"], at), axis=2)

    def ended(block: int, cost: np.ndarray) -> tuple:
        """What the driver gets of a block: its first and last components' costs, how many nodes gain in the others, and whether some of these had a move that was no gain."""
        (lo, hi), m = known[block], cost.shape[1]
        inner = cost[:, 1 : m - 1] if m > 1 else cost[:, :0]
        better = less((inner[..., 3], inner[..., 4]), (inner[..., 0], inner[..., 1]))
        gaining = np.where(better, inner[..., 5], inner[..., 2])
        return {lo: cost[:, 0]} | ({hi: cost[:, -1]} if m > 1 else {}), float(gaining.sum()), bool((gaining[~better] > 0).any())

    def summed(block: int, own: dict, said: dict, nodes: tuple, edges: list) -> tuple:
        """The moves that were said, summed up for the block's own nodes."""
        size, moves = len(nodes[0]), np.zeros((starts, first[-1]), np.uint8)
        for b, x in said.items():
            moves[:, first[b] : first[b + 1]] = unpacked(x, starts, first[b + 1] - first[b], bits)
        any_, change = moves.any(axis=0), np.zeros((2, starts, size * k))
        for dest, src, *weights in edges:
            some = np.flatnonzero(any_[src])
            dest, src, weights = dest[some].astype(np.int64) * k, src[some], [w[some] for w in weights]
            for s in range(starts):
                move = moves[s][src]
                here = np.flatnonzero(move)
                left, to = np.divmod(move[here].astype(np.int64) - 1, k)
                at, was = dest[here], left > 0
                for c, w in zip(change, weights, strict=True):
                    w = w[here]
                    c[s] += np.bincount(at + to, w, size * k)
                    if was.any():
                        c[s] -= np.bincount((at + left - 1)[was], w[was], size * k)
        if "sums" not in own:  # nothing is tried before the first turn
            own = {"label": own["label"], "sums": change, "new": own["label"], "change": np.zeros_like(change)}
        else:
            own["change"] = change
        cost = judged(own, nodes[1])
        return own | {"h": nodes[0], "of": nodes[1], "cost": cost}, None, ended(block, cost)

    def each(state: DataFrame, f, schema: str = STATE) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for block, own in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    yield from f(block, pickle.loads(own.as_buffer())).to_batches()

        return state.select("block", "own").mapInArrow(run, schema)

    def verdict(block: int, cost: np.ndarray, shared: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The costs, with those of components that reach over blocks, and where the moves made it less."""
        cost[:, 0], cost[:, -1] = shared[known[block][0]], shared[known[block][1]]
        return cost, less((cost[..., 3], cost[..., 4]), (cost[..., 0], cost[..., 1]))

    def tried(shared: dict[int, np.ndarray], turn: int, alone: bool):
        """The moves of a turn. With `alone`, those that have to be looked at with their neighbours' are said first."""

        def f(block: int, own: dict) -> pa.Table:
            _, better = verdict(block, own["cost"], shared)
            better = better[:, own["of"]]
            label = np.where(better, own["new"], own["label"]).astype(np.int8)
            sums = own["sums"] + np.where(np.repeat(better, k, axis=1), own["change"], 0.0)
            _, gain, to = priced(label, sums)
            careful = ~better & (turn > 0)
            # a half of those that gain; where that was no gain, those that gain more than all their neighbours, which always is one
            half = np.stack([hashed(hashed(hashed(own["h"], s), seed), turn) & 1 == 0 for s in range(starts)])
            go, may = (to >= 0) & half & ~careful, (to >= 0) & careful
            now = {"label": label, "sums": sums, "to": to, "go": go}
            if not alone:
                return row_of(block, *said(now))
            s, place = np.nonzero(may)
            return row_of(block, now | {"may": may}, pickle.dumps((s, place, gain[0][may], gain[1][may], own["h"][place])))

        return f

    def said(now: dict) -> tuple[dict, bytes]:
        label, to, go = now["label"], now["to"], now["go"]
        code = np.where(go, 1 + (label.astype(np.int64) + 1) * k + to, 0).astype(np.uint8)
        return {"label": label, "sums": now["sums"], "new": np.where(go, to, label).astype(np.int8)}, packed(code, bits)

    def strongest(block: int, own: dict, heard: dict, nodes: tuple, edges: list) -> tuple:
        """Of those that may move, those that gain more than all their neighbours that may."""
        at = [pickle.loads(x) for x in heard.values()]
        start, node = np.concatenate([x[0] for x in at]), np.concatenate([x[1] + first[b] for b, x in zip(heard, at, strict=True)])
        more, gain, h = (np.concatenate([x[i] for x in at]) for i in (2, 3, 4))
        rank = np.full((starts, first[-1]), len(node), np.int64)
        order = np.lexsort((node, h, gain, more))
        rank[start[order], node[order]] = np.arange(len(node))
        mine, met, may = rank[:, first[block] : first[block + 1]], np.zeros(own["may"].shape, bool), own["may"].any(axis=0)
        for dest, src, *_ in edges:
            some = np.flatnonzero(may[dest])
            dest, src = dest[some], src[some]
            for s in np.flatnonzero(own["may"].any(axis=1)):
                met[s, dest[rank[s][src] < mine[s][dest]]] = True
        own["go"] |= own["may"] & ~met
        return said(own)

    def begun(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        h = t.column("h").to_numpy()
        label = np.stack([t.column("label").to_numpy().astype(np.int8)] + [np.mod(hashed(hashed(h, s), seed), k).astype(np.int8) for s in range(1, starts)])
        return row_of(t.column("block")[0].as_py(), {"label": label}, packed((label + 1).astype(np.uint8), bits))

    def best(shared: dict[int, np.ndarray]):
        """Each component's labels of the start that costs least."""

        def f(block: int, own: dict) -> pa.Table:
            cost, better = verdict(block, own["cost"], shared)
            o, c = np.where(better, cost[..., 3], cost[..., 0]), np.where(better, cost[..., 4], cost[..., 1])
            take = np.zeros(o.shape[1], np.int64)
            for s in range(1, starts):
                at = np.arange(len(take))
                take = np.where(less((o[s], c[s]), (o[take, at], c[take, at])), s, take)
            label = np.where(better[:, own["of"]], own["new"], own["label"])[take[own["of"]], np.arange(len(own["of"]))]
            return pa.table({"block": pa.array(np.full(len(label), block, np.int32)), "place": pa.array(np.arange(len(label))), "label": pa.array(label.astype(np.int32))})

        return f

    try:
        begin = blocks.index.join(labels, "node").select("block", "place", "label", F.xxhash64("node").alias("h")).groupBy("block").applyInArrow(begun, STATE)
        state, turn = blocks.met(begin, summed), 0
        while True:
            shared: dict[int, np.ndarray] = {}
            gaining, failed = 0.0, False
            for r in state.select("ends").collect():  # a row a block
                ends, more, no = pickle.loads(r["ends"])
                for c, x in ends.items():
                    shared[c] = shared[c] + x if c in shared else x
                gaining, failed = gaining + more, failed or no
            for x in shared.values():
                better = less((x[:, 3], x[:, 4]), (x[:, 0], x[:, 1]))
                more = np.where(better, x[:, 5], x[:, 2])
                gaining, failed = gaining + float(more.sum()), failed or bool((more[~better] > 0).any())
            if turn == rounds or not gaining:
                out = cut(each(state, best(shared), "block int, place long, label int"))
                return blocks.index.join(out, ["block", "place"]).select("node", "component", "label")
            alone = failed and turn > 0
            moves = each(state, tried(shared, turn, alone))
            state = blocks.met(blocks.met(moves, strongest) if alone else moves, summed)
            turn += 1
    finally:
        blocks.dealt.unpersist()
