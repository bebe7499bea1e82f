"""Scaffold groups: repeats, backbones grown from overlaps, recruitment and merging of groups, candidate structural variants."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.overlap import EXTENDS, INTERNAL
from spanloom.functions.scale import COVERAGE_GAIN, LOW_COPY, log_linear, zero
from spanloom.operators import graph, intervals
from spanloom.operators.chaining import factor
from spanloom.operators.intervals import overlap_join
from spanloom.operators.ranges import running


def repeats(steps: DataFrame, sequences: DataFrame, ploidy: int) -> DataFrame:
    """(seq, low, repeat): the length covered by fewer than ploidy + 1 copies, and whether that is less than a sequence of its size should have."""
    low = F.sum(F.when(F.col("cov") < ploidy + 1, F.col("end") - F.col("beg")).otherwise(zero()))
    s = steps.groupBy("seq").agg(low.alias("low")).join(sequences.select("seq", "len"), "seq")
    return s.select("seq", "low", (F.col("low") < log_linear(F.col("len"), LOW_COPY) * F.col("len")).alias("repeat"))


def recruited(ovls: DataFrame, members: DataFrame, sequences: DataFrame, share: float = 0.8) -> DataFrame:
    """(seq, grp, size, rev): sequences outside all groups that overlaps with one group's members cover to `share` or more; the group that covers most, ties to the lesser one, and the way that most of the overlapped length lies.

    ovls: aread, bread, abpos, aepos, rev (seen from aread). members: grp, seq, rev.
    """
    m = members.select("grp", F.col("seq").alias("bread"), F.col("rev").alias("__rev"))
    o = ovls.join(members.select(F.col("seq").alias("aread")), "aread", "left_anti").join(m, "bread")
    key = F.struct("aread", "grp")
    o = o.select("aread", "grp", key.alias("seq"), F.col("abpos").alias("beg"), F.col("aepos").alias("end"), (F.col("rev") != F.col("__rev")).alias("way"))
    covered = intervals.measures(o.select("seq", "beg", "end")).select("seq", F.col("union_size").alias("size"))
    size = F.col("end") - F.col("beg")
    way = o.groupBy("seq").agg((F.sum(F.when(F.col("way"), size).otherwise(zero())) > F.sum(F.when(~F.col("way"), size).otherwise(zero()))).alias("rev"))
    c = covered.join(way, "seq").select(F.col("seq.aread").alias("seq"), F.col("seq.grp").alias("grp"), "size", "rev").join(sequences.select("seq", "len"), "seq").where(F.col("size") >= share * F.col("len"))
    return c.groupBy("seq").agg(F.max(F.struct("size", (-F.col("grp")).alias("g"), "rev")).alias("m")).select("seq", (-F.col("m.g")).alias("grp"), "m.size", "m.rev")


def before_growth(e: DataFrame, nodes: DataFrame, least: int, margin: float) -> DataFrame:
    """(seq, len, alone): whether a sequence comes, in its component, before the first from which a line grows. nodes: seq, len, component.

    As long as no line has grown, what is in a line is what came before. So whether a sequence would be the first is told by its overlaps with
    later ones alone. Sums may be off by their rounding, to the side of growth, which only leaves more to the tasks.
    """
    at = lambda c, x: nodes.select(F.col("seq").alias(c), F.col("len").alias(f"{x}len"))
    both = e.join(at("aread", "a"), "aread").join(at("bread", "b"), "bread").where("aread <> bread")
    ahead = (F.col("alen") > F.col("blen")) | ((F.col("alen") == F.col("blen")) & (F.col("aread") < F.col("bread")))
    pick = lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b))
    x0, x1, xlen, y0, y1, ylen = pick("abpos", "bbpos"), pick("aepos", "bepos"), pick("alen", "blen"), pick("bbpos", "abpos"), pick("bepos", "aepos"), pick("blen", "alen")
    on = F.when(F.col("rev"), y0).otherwise(ylen - y1) - (xlen - x1) >= least
    back = F.when(F.col("rev"), ylen - y1).otherwise(y0) - x0 >= least
    side = lambda c: [F.max(F.when(F.col(c), F.col("score"))).alias(f"top_{c}"), F.sum(F.when(F.col(c), F.col("score"))).alias(f"sum_{c}"), F.sum(F.when(F.col(c), F.abs("score"))).alias(f"abs_{c}")]
    sums = both.select(pick("aread", "bread").alias("seq"), on.alias("on"), back.alias("back"), "score").groupBy("seq").agg(*side("on"), *side("back"))
    grows = lambda c: F.coalesce(F.col(f"top_{c}") >= margin * F.col(f"sum_{c}") - 1e-9 * F.col(f"abs_{c}"), F.lit(False))
    place = F.struct((-F.col("len")).alias("l"), "seq")
    first = nodes.join(sums.where(grows("on") | grows("back")).select("seq"), "seq", "left_semi").groupBy("component").agg(F.min(place).alias("first"))
    return graph.cut(nodes.join(first, "component", "left").select("seq", "len", F.coalesce(place < F.col("first"), F.lit(True)).alias("alone")))


def backbones(ovls: DataFrame, sequences: DataFrame, least: int, margin: float = 0.7) -> DataFrame:
    """(grp, rank, seq, rev, beg): lines of sequences, one extending the next.

    From the longest sequence that is in no line, the line grows at either end by the sequence whose overlap extends it by `least` or more; of
    several, the best-scored one, if its share of the scores is `margin` or more. ovls: aread, bread, abpos, aepos, bbpos, bepos, rev,
    score, type. In each component, the sequences before the first from which a line grows are lines of their own (`before_growth`); the rest, with
    the overlaps among them, are a task for each component that is left.
    """
    e = ovls.where(F.col("type").bitwiseAND(F.lit(EXTENDS)) == EXTENDS).select("aread", "bread", "abpos", "aepos", "bbpos", "bepos", "rev", "score")
    comp = graph.components(e.select(F.col("aread").alias("a"), F.col("bread").alias("b")), sequences.select(F.col("seq").alias("node")))
    first = before_growth(e, graph.cut(sequences.select("seq", "len").join(comp.withColumnRenamed("node", "seq"), "seq")), least, margin)
    alone = first.where("alone").select(F.col("seq").cast("long").alias("grp"), zero().alias("rank"), F.col("seq").cast("long").alias("seq"), F.lit(False).alias("rev"), zero().alias("beg"))
    sequences = first.where("not alone").select("seq", "len")
    left = lambda c: sequences.select(F.col("seq").alias(c))
    e = graph.cut(e.join(left("aread"), "aread", "left_semi").join(left("bread"), "bread", "left_semi"))
    comp = graph.cut(graph.components(e.select(F.col("aread").alias("a"), F.col("bread").alias("b")), left("node")))
    n = sequences.join(comp.withColumnRenamed("node", "seq"), "seq")
    none = [F.lit(None).cast("long").alias(c) for c in ("bread", "abpos", "aepos", "bbpos", "bepos")]
    rows = n.select("component", F.col("seq").alias("aread"), F.col("len").alias("alen"), *none, F.lit(False).alias("rev"), F.lit(0.0).alias("score"))
    links = e.join(comp.withColumnRenamed("node", "aread"), "aread").select("component", "aread", F.lit(None).cast("long").alias("alen"), "bread", "abpos", "aepos", "bbpos", "bepos", "rev", "score")

    def grow(g: pd.DataFrame) -> pd.DataFrame:
        own = g[g["bread"].isna()]
        length = dict(zip(own["aread"].astype(int), own["alen"].astype(int), strict=True))
        near: dict[int, list[tuple]] = defaultdict(list)
        for r in g[g["bread"].notna()].itertuples():
            a, b = int(r.aread), int(r.bread)
            box = (int(r.abpos), int(r.aepos), int(r.bbpos), int(r.bepos), bool(r.rev), float(r.score))
            near[a].append((b, *box))
            near[b].append((a, box[2], box[3], box[0], box[1], box[4], box[5]))
        used: set[int] = set()

        def beyond(a: int, turned: bool) -> tuple[int, bool, int] | None:
            """The sequence past a's end as it lies (its begin, if turned), its way, and where it begins relative to a's begin."""
            found = []
            for b, a0, a1, b0, b1, rev, score in near[a]:
                if b in used:
                    continue
                way = turned != rev
                # in the line's direction: how far a's overlap ends from a's end, and b's from b's end
                left = (a0 if turned else length[a] - a1)
                right = (b0 if way else length[b] - b1)
                if right - left >= least:
                    start = (length[a] - a1 if turned else a0) - (length[b] - b1 if way else b0)
                    found.append((score, -b, b, way, start))
            if not found:
                return None
            found.sort(reverse=True)
            top = found[0]
            return top[2:] if top[0] >= margin * sum(f[0] for f in found) else None

        out = []
        for grp, seed in enumerate(sorted(length, key=lambda s: (-length[s], s))):
            if seed in used:
                continue
            used.add(seed)
            line = [(0, seed, False)]
            for side in (False, True):
                seq, way, at = seed, side, 0
                while (step := beyond(seq, way)) is not None:
                    nxt, nway, shift = step
                    at, seq, way = at + shift, nxt, nway
                    used.add(seq)
                    # seen from the seed's own direction
                    line.append((at if not side else length[seed] - at - length[seq], seq, way != side))
            low = min(x[0] for x in line)
            for rank, (pos, seq, way) in enumerate(sorted(line)):
                out.append((seed, rank, seq, way, pos - low))
        return pd.DataFrame(out, columns=["grp", "rank", "seq", "rev", "beg"])

    return rows.unionByName(links).groupBy("component").applyInPandas(grow, "grp long, rank long, seq long, rev boolean, beg long").unionByName(alone)


def mergeable(pairs: DataFrame, sizes: DataFrame, shape: tuple[float, float, float, float]) -> DataFrame:
    """(grp, component): groups that no order of merging puts together have different components. pairs: a, b, shared, each pair once.

    Where all that two sets of groups share is too little for the least group in them, no merged parts of them are ever merged. Sets that share
    enough become one, and are looked at again, until none do.
    """
    lo, hi, first, last = shape
    # size * factor is concave or rises between the shape's ends, and straight outside: from a size on, it is least there or at the shape's end
    need = lambda n: log_linear(n, shape) * n
    end = F.lit(10.0**hi)

    def least_of(n: Column) -> Column:
        n = F.greatest(n.cast("double"), F.lit(1.0))
        return F.least(need(n), F.when(n < end, need(end))) if last >= 0 else F.lit(float("-inf"))

    label = graph.cut(sizes.select("grp", F.col("grp").alias("component"), "size"))
    left = pairs.select("a", "b", F.greatest("shared", F.lit(0)).alias("shared"))
    while True:
        small = label.groupBy("component").agg(F.min("size").alias("small"))
        of = lambda c: small.select(F.col("component").alias(c), F.col("small").alias(f"small_{c}"))  # noqa: B023, E731
        enough = left.join(of("a"), "a").join(of("b"), "b").where(F.col("shared") >= least_of(F.least("small_a", "small_b")) * (1 - 1e-9))
        near = graph.cut(enough.select("a", "b"))
        if near.isEmpty():
            return label.select("grp", "component")
        to = graph.cut(graph.components(near).withColumnRenamed("component", "to"))
        label = graph.cut(label.join(to, F.col("component") == F.col("node"), "left").select("grp", F.coalesce("to", "component").alias("component"), "size"))
        went = lambda c: to.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}"))  # noqa: B023, E731
        moved = left.join(went("a"), "a", "left").join(went("b"), "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"), "shared")
        left = graph.cut(moved.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("shared").alias("shared")))


def merged_groups(pairs: DataFrame, sizes: DataFrame, shape: tuple[float, float, float, float] = COVERAGE_GAIN) -> DataFrame:
    """(grp, merged): groups put together while what two share is large enough for the smaller one.

    pairs: a, b, shared (length); sizes: grp, size. The pair of the largest shared^2 / size of the smaller goes first; shared lengths add up as
    groups merge. A task takes what may come together at all (`mergeable`), with the pairs inside; groups that can't are done without one.
    """
    e = graph.cut(pairs.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("shared").alias("shared")))
    comp = graph.cut(mergeable(e, sizes, shape))
    some = graph.cut(comp.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component"))
    inside = comp.join(some, "component", "left_semi")
    end = lambda c: inside.select(F.col("grp").alias(c), F.col("component").alias(f"of_{c}"))
    s = sizes.join(inside, "grp").select("component", F.col("grp").alias("a"), F.lit(None).cast("long").alias("b"), F.col("size").alias("n"))
    p = e.join(end("a"), "a").join(end("b"), "b").where("of_a = of_b").select(F.col("of_a").alias("component"), "a", "b", F.col("shared").alias("n"))
    alone = comp.join(some, "component", "left_anti").select(F.col("grp").cast("long").alias("grp"), F.col("grp").cast("long").alias("merged"))

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        size = {int(r.a): int(r.n) for r in g[g["b"].isna()].itertuples()}
        shared: dict[int, dict[int, int]] = {x: defaultdict(int) for x in size}
        for r in g[g["b"].notna()].itertuples():
            a, b = int(r.a), int(r.b)
            if a != b:
                shared[a][b] += int(r.n)
                shared[b][a] += int(r.n)
        root = {x: x for x in size}
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            small = max(1, min(size[a], size[b]))
            if shared[a][b] >= factor(small, shape) * small:
                heapq.heappush(heap, (-shared[a][b] ** 2 / small, min(a, b), max(a, b), shared[a][b]))

        for a in sorted(shared):
            for b in sorted(shared[a]):
                if a < b:
                    offer(a, b)
        while heap:
            _, a, b, n = heapq.heappop(heap)
            if a not in shared or b not in shared or shared[a].get(b) != n:
                continue  # merged or changed since
            for c, m in shared.pop(b).items():
                del shared[c][b]
                if c != a:
                    shared[a][c] += m
                    shared[c][a] += m
            size[a] += size.pop(b)
            root[b] = a
            for c in sorted(shared[a]):
                offer(a, c)

        def top(x: int) -> int:
            while root[x] != x:
                x = root[x]
            return x

        return pd.DataFrame([(x, top(x)) for x in sorted(root)], columns=["grp", "merged"])

    return s.unionByName(p).groupBy("component").applyInPandas(merge, "grp long, merged long").unionByName(alone)


def variant_candidates(ovls: DataFrame, low: DataFrame, sequences: DataFrame, least: int = 100_000, share: float = 0.1, low_share: float = 0.7, near: int = 100_000) -> DataFrame:
    """(seq, pos, support): inner ends of internal overlaps, clustered, where no other overlap runs across.

    An overlap counts if it is internal, `least` long and `share` of its sequence, on a sequence that is mostly of few copies (low: seq, low).
    Ends within `near` of one another are one candidate at the middle one; it stays if no overlap spans it by `near` on both sides.
    """
    size = F.col("aepos") - F.col("abpos")
    o = ovls.where(F.col("type").bitwiseAND(F.lit(INTERNAL)) == INTERNAL).join(sequences.select(F.col("seq").alias("aread"), "len"), "aread").join(low.select(F.col("seq").alias("aread"), "low"), "aread")
    o = o.where((size >= least) & (size >= share * F.col("len")) & (F.col("low") >= low_share * F.col("len")))
    ends = o.select(F.col("aread").alias("seq"), "len", F.explode(F.array("abpos", "aepos")).alias("pos")).where((F.col("pos") > near) & (F.col("pos") < F.col("len") - near))
    at = running(ends.groupBy("seq", "pos").agg(F.count("*").alias("n")), ["seq"], "pos", before={"ahead": "n"}, last={"was": "pos"})
    at = at.withColumn("new", F.when(F.col("pos") - F.col("was") <= near, F.lit(None)).otherwise(F.col("pos")))
    at = running(at, ["seq"], "pos", top_upto={"run": "new"})
    runs = at.groupBy("seq", "run").agg(F.sum("n").alias("support"), F.min("ahead").alias("first"))
    middle = F.expr("first + (support + 1) div 2")
    c = at.join(runs, ["seq", "run"]).where((F.col("ahead") < middle) & (middle <= F.col("ahead") + F.col("n"))).select("seq", "pos", "support")
    span = ovls.select(F.col("aread").alias("__on"), (F.col("abpos") + near).alias("__lo"), (F.col("aepos") - near).alias("__hi")).where("__lo < __hi")
    crossed = overlap_join(c.withColumn("__to", F.col("pos") + 1), span.withColumn("__end", F.col("__hi") + 1), ("seq", "pos", "__to"), ("__on", "__lo", "__end")).select("seq", "pos").distinct()
    return c.join(crossed, ["seq", "pos"], "left_anti")


def mutual_attention(edges: DataFrame, temperature: float = 0.2) -> DataFrame:
    """(a, b, w): raw weights of both directions scaled by each side's softmax share and confidence. edges: a, b, w, in both directions."""
    from spanloom.operators.stats import softmax_confidence

    s = softmax_confidence(edges, "a", "w", temperature)
    back = s.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("p").alias("q"), F.col("conf").alias("conf_b"))
    return s.join(back, ["a", "b"]).select("a", "b", (F.col("conf") * F.col("conf_b") * F.col("p") * F.col("q") * F.col("w")).alias("w"))

