"""Break calling along a sequence: spans of contacts, spikes taken out, valleys between sound stretches."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.probability import poisson_lower


class RunningMedian:
    """Lower median of the values so far, by two heaps."""

    def __init__(self) -> None:
        self.low: list[float] = []  # negated
        self.high: list[float] = []

    def add(self, x: float) -> float:
        if self.low and x > -self.low[0]:
            heapq.heappush(self.high, x)
        else:
            heapq.heappush(self.low, -x)
        if len(self.low) > len(self.high) + 1:
            heapq.heappush(self.high, -heapq.heappop(self.low))
        elif len(self.high) > len(self.low):
            heapq.heappush(self.low, -heapq.heappop(self.high))
        return -self.low[0] if len(self.low) > len(self.high) else (self.high[0] - self.low[0]) / 2


def prefix_medians(x: np.ndarray) -> np.ndarray:
    m = RunningMedian()
    return np.array([m.add(float(v)) for v in x])


def without_spikes(x: np.ndarray, rise: float, limit: float, longest: int) -> np.ndarray:
    """x with peaks replaced by straight lines.

    A peak begins where a step exceeds the typical one (`rise`) by more than `limit`, and ends at the first place whose step is typical
    and whose height is back to what the base would have risen to. One that stays level for more than `longest` places is no peak.
    """
    x = x.astype(float).copy()
    step = np.diff(x, append=x[-1:]) - rise if len(x) else x
    i, n = 0, len(x)
    while i < n - 1:
        if step[i] <= limit:
            i += 1
            continue
        base, level, j = x[i], 0, i + 1
        while j < n - 1:
            flat = abs(step[j]) <= limit
            level = level + 1 if flat else 0
            if flat and x[j] <= base + limit * (j - i):
                x[i : j + 1] = np.linspace(base, x[j], j - i + 1)
                break
            if level > longest:
                break
            j += 1
        i = j
    return x


def valleys(x: np.ndarray, least: int, drop: float = 0.3, sound: float = 0.8) -> list[tuple[int, float, float, float, float]]:
    """(bin, median before, value, median after, p) of each break, in order.

    A bin's depth is its value over the lesser of the medians to its left and right. Stretches of `least` sound bins or more frame the
    valleys; a valley's deepest bin is a break if it is below `drop`. The pieces between breaks are searched in turn.
    """
    found: list[tuple[int, float, float, float, float]] = []
    todo = [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        part = x[lo:hi]
        n = len(part)
        if n <= 2 * least or n < 3:
            continue
        left, right = prefix_medians(part), prefix_medians(part[::-1])[::-1]
        around = np.concatenate([right[1:2], np.minimum(left[:-2], right[2:]), left[-2:-1]])
        depth = np.ones(n)
        np.divide(part, around, out=depth, where=around > 0)
        depth = np.minimum(depth, 1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], depth >= sound, [0]]).astype(np.int8)))
        stretches = [(b, e) for b, e in zip(edges[::2], edges[1::2], strict=True) if e - b >= least]
        cuts = []
        for (_, b), (e, _) in zip(stretches, stretches[1:], strict=False):
            if e > b:
                p = b + int(np.lexsort((np.arange(e - b), part[b:e], depth[b:e]))[0])
                if depth[p] < drop:
                    cuts.append(p)
                    found.append((lo + p, left[p - 1], float(part[p]), right[p + 1], poisson_lower(int(part[p]), min(left[p - 1], right[p + 1]))))
        if cuts:
            bounds = [0, *cuts, n]
            todo += [(lo + b, lo + e) for b, e in zip(bounds, bounds[1:], strict=False)]
    return sorted(found)


def call_breaks(spans: DataFrame, width: int, min_size: int, drop: float = 0.3, sound: float = 0.8, alpha: float = 0.01) -> DataFrame:
    """(seq, pos, before, at, after, p): breaks that survive the Benjamini-Hochberg procedure. spans: seq, bin, span on every bin.

    Steps' median and deviation are over all sequences; the search is one sequence's bins at a time, a bound that a sequence's length sets. Spans and
    calls are looked at several times, so they are written once.
    """
    from spanloom.operators.graph import cut
    from spanloom.operators.ranges import median, running, tasks_for
    from spanloom.operators.stats import significant

    least = max(1, -(-min_size // width))
    spans = cut(spans.select("seq", "bin", "span"))
    steps = cut(running(spans, ["seq"], "bin", last={"was": "span"}).select((F.col("span") - F.col("was")).cast("double").alias("step")).where("step is not null").groupBy("step").agg(F.count("*").alias("n")))
    med = median(steps, "step", "rise", times="n")
    mad = median(steps.crossJoin(F.broadcast(med)).select(F.abs(F.col("step") - F.col("rise")).alias("off"), "n"), "off", "mad", times="n")
    found = med.crossJoin(mad).first()
    rise, limit = float(found["rise"] or 0), float(found["mad"] or 0) * 3.5 / 0.6745
    kind = spans.schema["seq"].dataType.simpleString()

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for seq, x in _by_sequence(frames):
            rows += [(seq, b * width, *rest) for b, *rest in valleys(without_spikes(x, rise, limit, least), least, drop, sound)]
            if len(rows) >= BATCH:
                yield pd.DataFrame(rows, columns=CALL)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=CALL)

    # names as text, in which nulls stay what they are
    lines = spans.repartition(tasks_for(spans), "seq").sortWithinPartitions("seq", "bin").select(F.col("seq").cast("string").alias("seq"), "span")
    calls = cut(lines.mapInPandas(search, "seq string, pos long, before double, at double, after double, p double").withColumn("seq", F.col("seq").cast(kind)))
    return significant(calls, "p", F.lit(alpha))


#: Rows given at once.
BATCH = 10_000
CALL = ["seq", "pos", "before", "at", "after", "p"]


def _by_sequence(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[object, np.ndarray]]:
    """Each sequence with its spans; its rows lie together, and may go on in the next frames."""
    name, held = None, []
    for f in frames:
        if not len(f):
            continue
        seq, span = f["seq"].to_numpy(), f["span"].to_numpy()
        bounds = [0, *(np.flatnonzero(seq[1:] != seq[:-1]) + 1).tolist(), len(seq)]
        for b, e in zip(bounds, bounds[1:], strict=False):
            if held and seq[b] != name:
                yield name, np.concatenate(held)
                held = []
            name = seq[b]
            held.append(span[b:e])
    if held:
        yield name, np.concatenate(held)


def sessions(calls: DataFrame, gap: int, seq: str = "seq", pos: str = "pos") -> DataFrame:
    """calls with the number of their session: calls closer than `gap` to the one before them are in its session."""
    order = W.partitionBy(seq).orderBy(pos)
    new = F.when(F.col(pos) < F.lag(pos).over(order) + gap, 0).otherwise(1)
    return calls.withColumn("new", new).withColumn("session", F.sum("new").over(order.rangeBetween(W.unboundedPreceding, W.currentRow))).drop("new")


def merged_calls(calls: DataFrame, sequences: DataFrame, gap: int) -> DataFrame:
    """The best call of each session that keeps `gap` to the sequence's ends and to the call kept before it.

    Whether a call is kept depends on those before it in its sequence, so the kept ones are found by a fold over the sessions' best calls.
    """
    best = sessions(calls, gap).groupBy("seq", "session").agg(F.min_by(F.struct("pos", "p"), F.struct("p", "pos")).alias("b")).select("seq", "b.*")
    lists = best.join(sequences.select("seq", "len"), "seq").where((F.col("pos") >= gap) & (F.col("pos") + gap <= F.col("len"))).groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("pos", "p"))).alias("c"))
    none = F.array().cast("array<struct<pos:bigint,p:double>>")
    fits = lambda acc, x: (F.size(acc) == 0) | (x["pos"] >= F.element_at(acc, F.greatest(F.size(acc), F.lit(1)))["pos"] + gap)
    kept = F.aggregate("c", none, lambda acc, x: F.when(fits(acc, x), F.array_append(acc, F.struct(x["pos"].cast("long").alias("pos"), x["p"].cast("double").alias("p")))).otherwise(acc))
    return lists.select("seq", F.explode(kept).alias("k")).select("seq", "k.pos", "k.p")
