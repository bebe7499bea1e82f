"""Interval algebra: coverage, unions, measures and overlap joins of half-open intervals [beg, end).

Everything is an event table: +1 where an interval begins, -1 where it ends. Events are summed by position before they are put in order,
so a sequence with very many intervals costs its number of distinct positions. The order is that of ranges of positions (`ranges.running`):
no task has to take a whole sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.scale import zero
from spanloom.operators.ranges import running, tasks_for


def ends(ivals: DataFrame, seq: str = "seq", beg: str = "beg", end: str = "end", weight: Column | None = None) -> DataFrame:
    """(seq, pos, delta): a row for each interval's begin and end."""
    w = F.lit(1).cast("long") if weight is None else weight
    both = ivals.select(F.col(seq).alias("seq"), F.explode(F.array(F.struct(F.col(beg).alias("pos"), w.alias("delta")), F.struct(F.col(end).alias("pos"), (-w).alias("delta")))).alias("e"))
    return both.select("seq", "e.pos", "e.delta")


def events(ivals: DataFrame, seq: str = "seq", beg: str = "beg", end: str = "end", weight: Column | None = None) -> DataFrame:
    """(seq, pos, delta): each position once, with what the coverage changes by there."""
    return ends(ivals, seq, beg, end, weight).groupBy("seq", "pos").agg(F.sum("delta").alias("delta"))


def coverage(ivals: DataFrame, sequences: DataFrame | None = None, weight: Column | None = None, tasks: int | None = None) -> DataFrame:
    """(seq, beg, end, cov): the coverage step function. With sequences (seq, len), steps reach from 0 to len, covered or not.

    tasks: how many tasks the sweep is dealt to; if it is not given, the intervals are counted.
    """
    e = ends(ivals, weight=weight)
    if sequences is not None:
        e = e.unionByName(sequences.select("seq", F.explode(F.array(zero(), F.col("len"))).alias("pos"), zero().alias("delta")))
    steps = running(e, ["seq"], "pos", upto={"cov": "delta"}, following="end", tasks=tasks or tasks_for(ivals, 2), summed=["delta"])
    return steps.select("seq", F.col("pos").alias("beg"), "end", "cov").where(F.col("end").isNotNull())


def compressed_events(ivals: DataFrame) -> DataFrame:
    """Events without those that cancel out."""
    return events(ivals).where("delta <> 0")


def coalesced(steps: DataFrame) -> DataFrame:
    """Neighbouring steps of equal coverage as one."""
    s = running(steps, ["seq"], "beg", last={"was": "cov", "upto": "end"})
    s = s.withColumn("new", F.when((F.col("was") == F.col("cov")) & (F.col("upto") == F.col("beg")), F.lit(None)).otherwise(F.col("beg")))
    runs = running(s, ["seq"], "beg", top_upto={"run": "new"})
    return runs.groupBy("seq", "run").agg(F.min("beg").alias("beg"), F.max("end").alias("end"), F.max("cov").alias("cov")).drop("run")


def step_sum(a: DataFrame, b: DataFrame, shift: Column | None = None, mirror: Column | None = None, tasks: int | None = None) -> DataFrame:
    """The sum of two step functions; b is first mirrored at `mirror` and then shifted. tasks: as in `coverage`.

    Positions where the sum does not change go before the sweep, but for each sequence's first and last, so that neighbouring steps differ.
    """
    beg, end = F.col("beg"), F.col("end")
    if mirror is not None:
        beg, end = mirror - F.col("end"), mirror - F.col("beg")
    if shift is not None:
        beg, end = beg + shift, end + shift
    moved = b.select("seq", beg.alias("beg"), end.alias("end"), "cov")
    both = a.select("seq", "beg", "end", "cov").unionByName(moved)
    tasks = tasks or tasks_for(both, 2)
    e = running(ends(both, weight=F.col("cov")), ["seq"], "pos", last={"was": "pos"}, following="to", tasks=tasks, summed=["delta"])
    e = e.where("delta <> 0 or was is null or to is null").select("seq", "pos", "delta")
    steps = running(e, ["seq"], "pos", upto={"cov": "delta"}, following="end", tasks=tasks)
    return steps.select("seq", F.col("pos").alias("beg"), "end", "cov").where(F.col("end").isNotNull())


def coverage_change(before: DataFrame, added: DataFrame, cap: int) -> DataFrame:
    """(old, new, size): the length that moves from one capped coverage to another when intervals are added."""
    both = before.select("seq", "beg", "end", F.lit(1).cast("long").alias("x"), zero().alias("y")).unionByName(added.select("seq", "beg", "end", zero().alias("x"), F.lit(1).cast("long").alias("y")))
    e = both.select("seq", F.explode(F.array(F.struct(F.col("beg").alias("pos"), "x", "y"), F.struct(F.col("end").alias("pos"), (-F.col("x")).alias("x"), (-F.col("y")).alias("y")))).alias("e"))
    e = e.select("seq", "e.*").groupBy("seq", "pos").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    s = running(e, ["seq"], "pos", upto={"a": "x", "b": "y"}, following="to").select((F.col("to") - F.col("pos")).alias("size"), "a", "b").where("size is not null and b > 0")
    return s.groupBy(F.least("a", F.lit(cap)).alias("old"), F.least(F.col("a") + F.col("b"), F.lit(cap)).alias("new")).agg(F.sum("size").alias("size"))


def merge_ranges(ivals: DataFrame, slack: int = 0) -> DataFrame:
    """(seq, beg, end): the union of intervals; those that touch, or lie within `slack`, become one."""
    e = ivals.select("seq", "beg", "end").groupBy("seq", "beg").agg(F.max("end").alias("end"))
    reached = running(e, ["seq"], "beg", top={"reach": "end"})
    new = F.when(F.col("beg") <= F.col("reach") + slack, F.lit(None)).otherwise(F.col("beg"))
    runs = running(reached.withColumn("new", new), ["seq"], "beg", top_upto={"run": "new"})
    return runs.groupBy("seq", "run").agg(F.min("beg").alias("beg"), F.max("end").alias("end")).drop("run")


def measures(ivals: DataFrame) -> DataFrame:
    """(seq, total, union_size, once_size, excess) of each sequence's intervals, from one sweep."""
    steps = coverage(ivals).withColumn("size", F.col("end") - F.col("beg"))
    return steps.groupBy("seq").agg(
        F.sum(F.col("size") * F.col("cov")).alias("total"), F.sum(F.when(F.col("cov") > 0, F.col("size")).otherwise(zero())).alias("union_size"),
        F.sum(F.when(F.col("cov") == 1, F.col("size")).otherwise(zero())).alias("once_size"), F.sum(F.when(F.col("cov") > 0, F.col("size") * (F.col("cov") - 1)).otherwise(zero())).alias("excess"),
    )


def overlap_size(a: DataFrame, b: DataFrame) -> DataFrame:
    """(seq, size): the length that both unions cover, for sequences where it isn't 0; a sweep, without pairs."""
    one = merge_ranges(a).select("seq", "beg", "end", F.lit(1).cast("long").alias("w"))
    two = merge_ranges(b).select("seq", "beg", "end", F.lit(1).cast("long").alias("w"))
    return coverage(one.unionByName(two), weight=F.col("w")).where("cov = 2").groupBy("seq").agg(F.sum(F.col("end") - F.col("beg")).alias("size"))


#: Bits between two levels of interval sizes.
LEVEL = 6


def level_of(size: Column) -> Column:
    """The level of an interval's size, in bits: an interval of level k is about 2^k positions or less."""
    return F.least(F.ceil(F.log2(F.greatest(size, F.lit(1).cast("long")).cast("double")) / LEVEL) * LEVEL, F.lit(60).cast("long")).cast("int")


def overlap_join(a: DataFrame, b: DataFrame, a_on: tuple[str, str, str] = ("a_seq", "a_beg", "a_end"), b_on: tuple[str, str, str] = ("b_seq", "b_beg", "b_end")) -> DataFrame:
    """Rows of a and b (without common names) whose intervals overlap on a sequence. a_on, b_on: the columns of sequence, begin and end.

    The join is by sequence and bin, so a sequence with most of the rows is spread over its bins. Bins are as wide as the longer of two
    intervals' levels: short and long intervals meet in bins of the long one's size, short ones among themselves in small bins, and neither
    lies in more than two or three. Each row is dealt once for each level that the other side has (a table of ten levels at most, which is
    broadcast). A pair is found in the one bin where its overlap begins.
    """
    sides = []
    levels = [x.select(level_of(F.col(on[2]) - F.col(on[1])).alias(name)).distinct() for x, on, name in ((a, a_on, "__of_a"), (b, b_on, "__of_b"))]
    for x, (_, beg, end), own, other, met in ((a, a_on, "__of_a", "__of_b", levels[1]), (b, b_on, "__of_b", "__of_a", levels[0])):
        dealt = x.where(F.col(beg) < F.col(end)).withColumn(own, level_of(F.col(end) - F.col(beg))).crossJoin(F.broadcast(met))
        wide = F.greatest(own, other)
        bins = F.sequence(F.call_function("shiftright", F.col(beg), wide), F.call_function("shiftright", F.col(end) - 1, wide))
        side = "a" if own == "__of_a" else "b"
        sides.append(dealt.withColumn(f"__bin_{side}", F.explode(bins)).withColumnsRenamed({"__of_a": f"__a_{side}", "__of_b": f"__b_{side}"}))
    on = (F.col(a_on[0]) == F.col(b_on[0])) & (F.col("__a_a") == F.col("__a_b")) & (F.col("__b_a") == F.col("__b_b")) & (F.col("__bin_a") == F.col("__bin_b"))
    meet = (F.col(a_on[1]) < F.col(b_on[2])) & (F.col(b_on[1]) < F.col(a_on[2]))
    first = F.call_function("shiftright", F.greatest(F.col(a_on[1]), F.col(b_on[1])), F.greatest("__a_a", "__b_a")) == F.col("__bin_a")
    return sides[0].join(sides[1], on & meet & first).drop(*(f"__{c}_{s}" for c in ("a", "b", "bin") for s in "ab"))


#: Bits of the least bins in which points, or pairs, meet the slices that hold them.
FLOOR = 12
#: Bins that an interval may lie in on an average before those of its size get wider bins.
BINS_EACH = 8


def bin_widths(found: list[tuple[int, int, int]]) -> dict[int, int]:
    """The bits of the bins for each level of size. found: level, number of intervals, sum of their sizes. A level takes the bins of the one below unless that makes too many of them."""
    spare = BINS_EACH * sum(n for _, n, _ in found)
    out: dict[int, int] = {}
    own = None
    for level, n, size in sorted(found):
        need = (size >> own) + 2 * n if own is not None else 0
        if own is None or need > spare:
            own = max(level, FLOOR)
        else:
            spare -= need
        out[level] = own
    return out


def point_join(points: DataFrame, ivals: DataFrame, at: tuple[str, str], on: tuple[str, str, str]) -> DataFrame:
    """Rows of points and intervals (without common names) where the interval holds the point. at: the points' columns of sequence and position, on: the intervals' of sequence, begin and end.

    The join is by sequence and bin. A point is dealt once for each width of bins, which the sizes of the intervals (ten levels at most, counted
    on the driver) decide by `bin_widths`: mostly there is one, so that the points, which are many, are shuffled once.
    """
    seq, pos = at
    of, beg, end = on
    held = ivals.where(F.col(beg) < F.col(end)).withColumn("__level", level_of(F.col(end) - F.col(beg)))
    found = held.groupBy("__level").agg(F.count("*").alias("n"), F.sum(F.col(end) - F.col(beg)).alias("size")).collect()
    width = bin_widths([(r["__level"], r["n"], r["size"]) for r in found]) or {0: FLOOR}
    kinds = sorted(set(width.values()))
    shift = lambda c, by: F.call_function("shiftright", c, by)
    wide = F.coalesce(*(F.when(F.col("__level") == k, F.lit(v)) for k, v in width.items()))
    held = held.withColumn("__width", wide).drop("__level")
    held = held.withColumn("__bin_b", F.explode(F.sequence(shift(F.col(beg), F.col("__width")), shift(F.col(end) - 1, F.col("__width")))))
    meet = (F.col(seq) == F.col(of)) & (F.col("__bin_a") == F.col("__bin_b")) & (F.col(beg) <= F.col(pos)) & (F.col(pos) < F.col(end))
    if len(kinds) == 1:
        dealt = points.withColumn("__bin_a", shift(F.col(pos), F.lit(kinds[0])))
    else:
        dealt = points.withColumn("__width_a", F.explode(F.array(*map(F.lit, kinds)))).withColumn("__bin_a", shift(F.col(pos), F.col("__width_a")))
        meet = meet & (F.col("__width_a") == F.col("__width"))
    return dealt.join(held, meet).drop("__bin_a", "__bin_b", "__width", "__width_a")


def band_join(a: DataFrame, b: DataFrame, bin_size: int | None = None) -> DataFrame:
    """Rows of a and b, as a_* and b_*, whose intervals overlap on a sequence; in bins of one size if it is given, else by `overlap_join`."""
    if bin_size is None:
        return overlap_join(a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns]), b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns]))
    return binned_join(binned(a, bin_size), binned(b, bin_size), bin_size)


def binned(x: DataFrame, bin_size: int) -> DataFrame:
    """Intervals (seq, beg, end, ...) once for each `bin` that they lie in."""
    return x.withColumn("bin", F.explode(F.sequence(F.expr(f"beg div {bin_size}"), F.expr(f"greatest(beg, end - 1) div {bin_size}"))))


def binned_join(a: DataFrame, b: DataFrame, bin_size: int) -> DataFrame:
    """`band_join` of what `binned` gives."""
    x = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns])
    y = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    on = (F.col("a_seq") == F.col("b_seq")) & (F.col("a_beg") < F.col("b_end")) & (F.col("b_beg") < F.col("a_end"))
    first = F.expr(f"greatest(a_beg, b_beg) div {bin_size}")
    return x.join(y, on & (F.col("a_bin") == F.col("b_bin"))).where(F.col("a_bin") == first).drop("a_bin", "b_bin")


def longest_join(ivals: DataFrame, bin_size: int) -> DataFrame:
    """`band_join` of each start's longest interval with all intervals (seq, beg, end).

    The intervals are dealt once, by sequence and bin, for both sides: the longest one of a start lies in all bins that the others lie in, so it can be
    told in each bin by itself.
    """
    t = binned(ivals.select("seq", "beg", "end"), bin_size).repartition("seq", "bin")
    return binned_join(t.groupBy("seq", "bin", "beg").agg(F.max("end").alias("end")), t, bin_size)


def overlap_bases() -> Column:
    """Length of the overlap of a `band_join` row."""
    return F.least("a_end", "b_end") - F.greatest("a_beg", "b_beg")


def range_coverage(steps: DataFrame, queries: DataFrame, max_cov: int | None = None, bin_size: int | None = None) -> DataFrame:
    """(seq, beg, end, bases, low): covered bases within each query range, and the length at up to max_cov; divide bases by end - beg for the mean."""
    j = band_join(queries.select("seq", "beg", "end"), steps, bin_size)
    low = F.when(F.col("b_cov") <= max_cov, overlap_bases()).otherwise(zero()) if max_cov is not None else overlap_bases()
    return j.groupBy(F.col("a_seq").alias("seq"), F.col("a_beg").alias("beg"), F.col("a_end").alias("end")).agg(F.sum(overlap_bases() * F.col("b_cov")).alias("bases"), F.sum(low).alias("low"))


def window_coverage(steps: DataFrame, width: int) -> DataFrame:
    """(seq, win, bases, size): covered bases and length of each window of `width`."""
    s = steps.withColumn("win", F.explode(F.sequence(F.expr(f"beg div {width}"), F.expr(f"(end - 1) div {width}"))))
    lo, hi = F.greatest("beg", F.col("win") * width), F.least("end", (F.col("win") + 1) * width)
    return s.groupBy("seq", "win").agg(F.sum((hi - lo) * F.col("cov")).alias("bases"), F.sum(hi - lo).alias("size"))


def window_norms(steps: DataFrame, width: int, mean: Column) -> DataFrame:
    """(seq, win, norm): what a window's coverage is multiplied by to come down to the mean; 1 where it is below, or nothing."""
    return window_coverage(steps, width).select("seq", "win", F.when(F.col("bases") > 0, F.least(F.lit(1.0), mean * F.col("size") / F.col("bases"))).otherwise(F.lit(1.0)).alias("norm"))


def tiling_faults(slices: DataFrame, sequences: DataFrame) -> DataFrame:
    """(seq, faults) of sequences whose slices don't tile [0, len) exactly once, in order."""
    order = W.partitionBy("seq").orderBy("beg", "end")
    gap = F.when(F.coalesce(F.lag("end").over(order), zero()) != F.col("beg"), 1).otherwise(0)
    s = slices.withColumn("gap", gap).groupBy("seq").agg(F.sum("gap").alias("gaps"), F.max("end").alias("last"))
    j = sequences.join(s, "seq", "left")
    return j.select("seq", (F.coalesce("gaps", zero()) + F.when(F.coalesce("last", zero()) == F.col("len"), 0).otherwise(1)).alias("faults")).where("faults > 0")


def tiling_cover(ivals: DataFrame, group: str = "seq") -> DataFrame:
    """(group, beg, end): the fewest intervals that cover each group's union: always the one that reaches furthest from where the last ended.

    From an interval, the next one is that of the furthest end among those that begin by its end. As that is a running maximum over
    begins, it is one window; the walk from each group's first interval is a fold over the few running maxima.
    """
    e = ivals.groupBy(group, "beg").agg(F.max("end").alias("end"))
    order = W.partitionBy(group).orderBy("beg")
    rising = e.withColumn("top", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))).where("top is null or end > top").drop("top")
    steps = rising.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("beg", "end"))).alias("s"))
    one = "struct<beg:bigint,end:bigint>"
    start = F.struct(F.array().cast(f"array<{one}>").alias("out"), F.lit(None).cast(one).alias("best"))

    def walk(acc: Column, x: Column) -> Column:
        # best: the furthest interval seen that begins by the end of the last one taken
        last = F.element_at(acc["out"], -1)
        fits = F.size(acc["out"]).isNull() | (F.size(acc["out"]) == 0) | (x["beg"] <= last["end"])
        took = F.when(acc["best"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["best"]))
        return F.when((F.size(acc["out"]) > 0) & fits, F.struct(acc["out"].alias("out"), x.alias("best"))).otherwise(
            F.when(F.size(took) == 0, F.struct(F.array(x).alias("out"), F.lit(None).cast(one).alias("best")))
            .when(x["beg"] <= F.element_at(took, -1)["end"], F.struct(took.alias("out"), x.alias("best")))
            .otherwise(F.struct(F.array_append(took, x).alias("out"), F.lit(None).cast(one).alias("best")))
        )

    done = steps.select(group, F.aggregate("s", start, walk, lambda a: F.when(a["best"].isNull(), a["out"]).otherwise(F.array_append(a["out"], a["best"]))).alias("c"))
    return done.select(group, F.explode("c").alias("c")).select(group, "c.beg", "c.end")
