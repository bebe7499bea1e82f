"""Contacts: mates paired into links, binned, counted, summarised, and tested for excess between sequence ends."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.probability import binomial_upper_p, poisson_upper_p
from spanloom.functions.scale import harmonic, link_density, midpoint, zero
from spanloom.operators.ranges import bin_of, running

#: (aseq, apos) and (bseq, bpos) of a pair
ENDS = ("aseq", "apos", "bseq", "bpos")


def pair_mates(reads: DataFrame, order: list[str], name: str = "name", tasks: int | None = None) -> DataFrame:
    """Records of one read name, in order, paired two by two; an odd last one goes. reads: name, seq, pos, q. Returns name, k, aseq, apos, bseq, bpos, q (the lower). tasks: how many tasks the names are dealt to, if that is not Spark's to choose."""
    reads = reads.repartition(tasks, name) if tasks else reads
    w = W.partitionBy(name).orderBy(*order)
    r = reads.withColumn("i", F.row_number().over(w) - 1)
    pair = r.groupBy(name, F.expr("i div 2").alias("k")).agg(F.min(F.struct("i", "seq", "pos")).alias("a"), F.max(F.struct("i", "seq", "pos")).alias("b"), F.min("q").alias("q"), F.count("*").alias("n"))
    return pair.where("n = 2").select(name, "k", F.col("a.seq").alias("aseq"), F.col("a.pos").alias("apos"), F.col("b.seq").alias("bseq"), F.col("b.pos").alias("bpos"), "q")


def pair_adjacent(reads: DataFrame, rank: str = "rank", name: str = "stem") -> DataFrame:
    """Neighbouring records of one stem, as a reader of a file that is sorted by name meets them: within each unbroken run of a stem, two by two.

    A run is told by the rank less the record's number within its stem, so there is no window over the whole file.
    """
    r = reads.withColumn("run", F.col(rank) - F.row_number().over(W.partitionBy(name).orderBy(rank)))
    r = r.withColumn("i", F.row_number().over(W.partitionBy(name, "run").orderBy(rank)) - 1)
    p = r.groupBy(name, "run", F.expr("i div 2").alias("k")).agg(F.min(F.struct("i", "seq", "beg", "end")).alias("a"), F.max(F.struct("i", "seq", "beg", "end")).alias("b"), F.min("q").alias("q"), F.count("*").alias("n")).where("n = 2")
    return p.select(F.col("a.seq").alias("aseq"), midpoint(F.col("a.beg"), F.col("a.end")).alias("apos"), F.col("b.seq").alias("bseq"), midpoint(F.col("b.beg"), F.col("b.end")).alias("bpos"), "q")


def clamped(pos: Column, length: Column) -> Column:
    return F.greatest(zero(), F.least(pos, length))


def canonical(pairs: DataFrame) -> DataFrame:
    """The lesser end, by sequence and position, first."""
    a, b = F.struct(F.col("aseq").alias("seq"), F.col("apos").alias("pos")), F.struct(F.col("bseq").alias("seq"), F.col("bpos").alias("pos"))
    p = pairs.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b))
    rest = [c for c in pairs.columns if c not in ENDS]
    return p.select(F.col("lo.seq").alias("aseq"), F.col("lo.pos").alias("apos"), F.col("hi.seq").alias("bseq"), F.col("hi.pos").alias("bpos"), *rest)


def of_kind(pairs: DataFrame, kind: str = "all", min_q: int = 0) -> DataFrame:
    """Pairs within a sequence, between sequences, or all, of a quality of min_q or more."""
    p = pairs.where(F.col("q") >= min_q) if min_q else pairs
    return p if kind == "all" else p.where(F.col("aseq") == F.col("bseq") if kind == "intra" else F.col("aseq") != F.col("bseq"))


def contact_matrix(pairs: DataFrame, width: int, tasks: int | None = None) -> DataFrame:
    """(aseq, abin, bseq, bbin, n): canonical pairs counted by bins; counting starts before the shuffle, or, if it is told how many tasks the bins are dealt to, after it."""
    c = canonical(pairs.select(*ENDS)).select("aseq", F.expr(f"apos div {width}").alias("abin"), "bseq", F.expr(f"bpos div {width}").alias("bbin"))
    c = c.repartition(tasks, *c.columns) if tasks else c
    return c.groupBy(*c.columns).agg(F.count("*").alias("n"))


def symmetric(matrix: DataFrame, between_only: bool = True) -> DataFrame:
    """The matrix with its mirror; rows within a sequence are not mirrored, nor, if asked, those on the diagonal."""
    other = matrix.where("aseq <> bseq") if between_only else matrix.where("not (aseq = bseq and abin = bbin)")
    return matrix.unionByName(other.select(F.col("bseq").alias("aseq"), F.col("bbin").alias("abin"), F.col("aseq").alias("bseq"), F.col("abin").alias("bbin"), "n"))


def merged_counts(*matrices: DataFrame, tasks: int | None = None) -> DataFrame:
    """Libraries as one, their counts added. tasks: how many tasks the bins are dealt to, if that is not Spark's to choose; no counts are added before that then."""
    m = matrices[0]
    for x in matrices[1:]:
        m = m.unionByName(x)
    m = m.repartition(tasks, "aseq", "abin", "bseq", "bbin") if tasks else m
    return m.groupBy("aseq", "abin", "bseq", "bbin").agg(F.sum("n").alias("n"))


def distance_counts(matrix: DataFrame) -> DataFrame:
    """(dist, n, upto): contacts within sequences by distance in bins, with the running total."""
    d = matrix.where("aseq = bseq").groupBy((F.col("bbin") - F.col("abin")).alias("dist")).agg(F.sum("n").alias("n"))
    return d.withColumn("upto", F.sum("n").over(W.orderBy("dist").rowsBetween(W.unboundedPreceding, 0)))


def span_limit(matrix: DataFrame, least: int) -> DataFrame:
    """(limit): the distance at which the last full tenth below 1 of contacts within sequences is reached, `least` at the lowest.

    The tenths count from the first one that distance 0 has not passed.
    """
    d = distance_counts(matrix).withColumn("total", F.sum("n").over(W.partitionBy())).withColumn("zero", F.sum(F.when(F.col("dist") == 0, F.col("n")).otherwise(zero())).over(W.partitionBy()))
    # the tenth that a distance is the first to reach; one distance moves on by one tenth only
    first = F.expr("greatest(0, zero - 1) * 10 div total") + 1
    tens = d.withColumn("first", first).withColumn("ten", F.explode(F.sequence(F.lit(1), F.lit(9)))).where("ten >= first and upto * 10 >= ten * total")
    reached = tens.groupBy("ten", "first").agg(F.min("dist").alias("dist"))
    # where one distance reaches several tenths at once, the later ones wait for the next distances
    ranked = reached.withColumn("wait", F.max(F.col("dist") - F.col("ten")).over(W.orderBy("ten").rowsBetween(W.unboundedPreceding, 0))).withColumn("at", F.col("wait") + F.col("ten"))
    return ranked.agg(F.greatest(F.coalesce(F.max("at"), F.lit(1)), F.lit(1), F.lit(least)).cast("long").alias("limit"))


def contact_stats(matrix: DataFrame) -> DataFrame:
    """One row: links within and between sequences, and the number of bins with either."""
    m = symmetric(matrix)
    intra, n = F.col("aseq") == F.col("bseq"), F.col("n")
    return m.agg(
        F.sum(F.when(intra, n).otherwise(zero())).alias("intra_links"), F.expr("sum(case when aseq <> bseq then n else 0 end) div 2").alias("inter_links"),
        F.countDistinct(F.when(intra, F.struct("aseq", "abin"))).alias("intra_bins"), F.countDistinct(F.when(~intra, F.struct("aseq", "abin"))).alias("inter_bins"),
    )


def end_counts(matrix: DataFrame, sequences: DataFrame, width: int, ends: int) -> DataFrame:
    """(seq, links, covered, head_links, tail_links, head_bins, tail_bins) of contacts with other sequences: in all, and in the first and last `ends` bins."""
    m = symmetric(matrix).where("aseq <> bseq").groupBy(F.col("aseq").alias("seq"), F.col("abin").alias("bin")).agg(F.sum("n").alias("n"))
    m = m.join(sequences.select("seq", F.expr(f"len div {width}").alias("bins")), "seq")
    head, tail = F.col("bin") < F.least("bins", F.lit(ends)), F.col("bin") >= F.greatest(F.col("bins") - ends, F.lit(0))
    n, one = F.col("n"), F.lit(1).cast("long")
    part = lambda c, x: F.sum(F.when(c, x).otherwise(zero()))
    return m.groupBy("seq").agg(F.sum("n").alias("links"), F.count("*").alias("covered"), part(head, n).alias("head_links"), part(tail, n).alias("tail_links"), part(head, one).alias("head_bins"), part(tail, one).alias("tail_bins"))


def linkages(matrix: DataFrame, sequences: DataFrame, overlaps: DataFrame, width: int, ends: int, least: int = 3, min_bins: int = 1, alpha: float = 0.01) -> DataFrame:
    """(a, b, size, density, p): pairs of sequences with more contacts between their ends than chance and their other copies explain.

    overlaps: aread, bread, abpos, aepos. For a pair that does not overlap, the contacts between each end of a and each end of b are
    counted, and the best of the four combinations by density is tested: against all contacts of the two ends (Poisson), and against the
    contacts that either has with the other's overlapping sequences (binomial). p is the largest of the three; the Benjamini-Hochberg
    procedure keeps the significant pairs. Sequences with few covered bins or an outlying density stay out.
    """
    from spanloom.operators.graph import cut
    from spanloom.operators.stats import mad_outliers, significant

    # what is looked at more than once is written: contacts, sequences' counts, overlapping pairs, contacts by ends, and the tested pairs
    matrix = cut(matrix.where("aseq <> bseq"))
    e = cut(end_counts(matrix, sequences, width, ends))
    total = e.agg(F.sum("links").cast("double").alias("s")).select((F.col("s") / 2).alias("all_links"))
    good = cut(mad_outliers(e.where((F.col("covered") >= min_bins) & (F.col("links") > 0)).withColumn("density", F.log2(F.col("links") / F.col("covered"))), "density").where("not outlier").select("seq", *(f"{s}_{x}" for s in ("head", "tail") for x in ("links", "bins"))))
    size = sequences.select("seq", F.expr(f"len div {width}").alias("bins"))
    side = lambda c, bins: F.filter(F.array(F.when(F.col(c) < F.least(F.col(bins), F.lit(ends)), F.lit("head")), F.when((F.col(c) >= F.greatest(F.col(bins) - ends, F.lit(0))) & (F.col(c) < F.col(bins)), F.lit("tail"))), lambda x: x.isNotNull())
    m = matrix.join(size.select(F.col("seq").alias("aseq"), F.col("bins").alias("abins")), "aseq").join(size.select(F.col("seq").alias("bseq"), F.col("bins").alias("bbins")), "bseq")
    m = m.withColumn("aend", F.explode(side("abin", "abins"))).withColumn("bend", F.explode(side("bbin", "bbins")))
    x, y = F.struct(F.col("aseq").alias("seq"), F.col("aend").alias("end")), F.struct(F.col("bseq").alias("seq"), F.col("bend").alias("end"))
    m = m.select(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"), "n").select(F.col("lo.seq").alias("aseq"), F.col("lo.end").alias("aend"), F.col("hi.seq").alias("bseq"), F.col("hi.end").alias("bend"), "n")
    once = cut(m.groupBy("aseq", "aend", "bseq", "bend").agg(F.sum("n").alias("n")))
    ends_ = once.unionByName(once.select(F.col("bseq").alias("aseq"), F.col("bend").alias("aend"), F.col("aseq").alias("bseq"), F.col("aend").alias("bend"), "n"))
    over = cut(overlaps.select("aread", "bread").distinct())
    # contacts of an end of a with the sequences that overlap b, b's own copies so to speak
    copies = over.select(F.col("aread").alias("b"), F.col("bread").alias("bseq"))
    by_end = [F.sum(F.when(F.col("aend") == s, F.col("n")).otherwise(zero())).alias(s) for s in ("head", "tail")]
    trans = cut(ends_.join(copies, "bseq").where("b <> aseq").groupBy("aseq", "b").agg(*by_end))
    of_end = lambda s, head, tail: F.when(F.col(f"{s}end") == "head", F.col(head)).otherwise(F.col(tail))
    c = once
    for s in "ab":
        c = c.join(good.select(F.col("seq").alias(f"{s}seq"), *(F.col(f"{k}_{x}").alias(f"{k}_{x}_{s}") for k in ("head", "tail") for x in ("links", "bins"))), f"{s}seq")
        c = c.withColumns({f"l{s}": of_end(s, f"head_links_{s}", f"tail_links_{s}"), f"w{s}": of_end(s, f"head_bins_{s}", f"tail_bins_{s}")})
    c = c.select("aseq", "bseq", "aend", "bend", "n", "la", "lb", "wa", "wb").where((F.col("n") >= least) & (F.col("wa") > 0) & (F.col("wb") > 0))
    c = c.join(over.select(F.col("aread").alias("aseq"), F.col("bread").alias("bseq")), ["aseq", "bseq"], "left_anti")
    c = c.withColumn("density", link_density(F.col("n"), F.col("wa"), F.col("wb"))).withColumn("size", harmonic(F.col("wa").cast("double"), F.col("wb").cast("double")))
    best = c.groupBy("aseq", "bseq").agg(F.max(F.struct("density", "n", "aend", "bend", "la", "lb", "wa", "wb", "size")).alias("m")).select("aseq", "bseq", "m.*")
    best = best.join(trans.select("aseq", F.col("b").alias("bseq"), F.col("head").alias("head_a"), F.col("tail").alias("tail_a")), ["aseq", "bseq"], "left")
    best = best.join(trans.select(F.col("b").alias("aseq"), F.col("aseq").alias("bseq"), F.col("head").alias("head_b"), F.col("tail").alias("tail_b")), ["aseq", "bseq"], "left").crossJoin(F.broadcast(total))
    best = best.withColumns({f"t{s}": of_end(s, f"head_{s}", f"tail_{s}") for s in "ab"})
    chance = poisson_upper_p(F.col("n"), F.col("la") * F.col("lb") / F.greatest("all_links", F.lit(1.0)))
    # where a pair has no more contacts than what stands against it, there is no excess to test for
    excess = lambda t: F.when(F.col("n") > F.col(t), binomial_upper_p(F.col("n"), F.col("n") + F.coalesce(F.col(t), zero()), F.lit(0.5))).otherwise(F.lit(1.0))
    against = lambda t: F.when(F.coalesce(F.col(t), zero()) > 0, excess(t)).otherwise(F.lit(0.0))
    tested = cut(best.select("aseq", "bseq", "size", "density", F.greatest(chance, against("ta"), against("tb")).alias("p")))
    kept = significant(tested, "p", F.lit(alpha)).select(F.col("aseq").alias("a"), F.col("bseq").alias("b"), "size", "density", "p")
    return kept.unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b"), "size", "density", "p"))


def juicer_links(pairs: DataFrame, segments: DataFrame, shift: int = 0, min_q: int = 0) -> DataFrame:
    """Pairs on objects, the end with the lesser object name first: aname, apos, bname, bpos (shifted down)."""
    from spanloom.operators.layout import lifted

    p = of_kind(pairs, "all", min_q)
    p = lifted(p, segments, "aseq", "apos", prefix="a_")
    p = lifted(p, segments, "bseq", "bpos", prefix="b_")
    a, b = F.struct(F.col("a_object").cast("string").alias("name"), F.col("a_object_pos").alias("pos")), F.struct(F.col("b_object").cast("string").alias("name"), F.col("b_object_pos").alias("pos"))
    swap = a["name"] > b["name"]
    x, y = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    at = lambda s: F.shiftright(s["pos"], shift)
    return p.select(x["name"].alias("aname"), at(x).alias("apos"), y["name"].alias("bname"), at(y).alias("bpos"))


def link_spans(matrix: DataFrame, sequences: DataFrame, width: int, limit: int) -> DataFrame:
    """(seq, bin, span): on every bin of every sequence the contacts within it that reach over the bin: of ends a and b, more than 2 and up to `limit` bins apart, those in a + 1 to b - 2."""
    m = matrix.where((F.col("aseq") == F.col("bseq")) & (F.col("bbin") - F.col("abin") > 2) & (F.col("bbin") - F.col("abin") <= limit))
    e = m.select(F.col("aseq").alias("seq"), F.explode(F.array(F.struct((F.col("abin") + 1).alias("bin"), F.col("n").alias("d")), F.struct((F.col("bbin") - 1).alias("bin"), (-F.col("n")).alias("d")))).alias("e")).select("seq", "e.*")
    grid = sequences.select("seq", F.explode(F.sequence(zero(), F.expr(f"(len - 1) div {width}"))).alias("bin"), zero().alias("d"))
    d = e.unionByName(grid).groupBy("seq", "bin").agg(F.sum("d").alias("d"))
    return running(d, ["seq"], "bin", upto={"span": "d"}).select("seq", "bin", "span")


def _fresh(length: np.ndarray, width: int, merge_below: int) -> tuple[np.ndarray, np.ndarray]:
    """By sequence of a range, and past the last: the pixels closed up to the range's end, and the length then held, if nothing is held before it."""
    m = len(length)
    upto = np.concatenate(([0], np.cumsum(length)))
    long = np.append(length >= merge_below, True)
    closed, held = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    after = np.flatnonzero(long)
    stop = after[np.searchsorted(after, np.arange(m + 1))]  # the next long one, or the end
    full = np.searchsorted(upto, upto + merge_below)  # how many have to be taken until a pixel is full
    for i in range(m - 1, -1, -1):
        if long[i]:
            closed[i], held[i] = max(1, -(-int(length[i]) // width)) + closed[i + 1], held[i + 1]
        elif full[i] <= stop[i]:
            closed[i], held[i] = 1 + closed[full[i]], held[full[i]]
        elif stop[i] == m:
            held[i] = upto[m] - upto[i]
        else:
            closed[i], held[i] = int(upto[stop[i]] > upto[i]) + closed[stop[i]], held[stop[i]]
    return closed, held


def _fold(length: np.ndarray, width: int, merge_below: int) -> list[tuple[int, int, int, int]]:
    """What a range does to what is held before it, as pieces (from, add, closed, held): if `from` or more is held, and less than the next piece's, so many pixels are closed and `held` (with add: and what was held) is held after it."""
    closed, held = _fresh(length, width, merge_below)
    m = len(length)
    upto = np.concatenate(([0], np.cumsum(length)))
    stop = int(np.append(np.flatnonzero(length >= merge_below), m)[0])
    # with nothing held it is _fresh; with more, the pixel is full after the first j sequences for which held + upto[j] is enough
    out = [(0, 0, int(closed[0]), int(held[0]))]
    short = merge_below - int(upto[stop])  # from so much on a pixel is full before the next long one
    if short > 1:
        out.append((1, 1, 0, int(upto[stop])) if stop == m else (1, 0, 1 + int(closed[stop]), int(held[stop])))
    for j in range(stop, 0, -1):
        low, high = max(1, merge_below - int(upto[j])), merge_below - int(upto[j - 1])
        if low < high:
            piece = (low, 0, 1 + int(closed[j]), int(held[j]))
            if out[-1][1:] != piece[1:]:
                out.append(piece)
    return out


def pixels(sequences: DataFrame, width: int, merge_below: int = 0, span: int = 1 << 16) -> DataFrame:
    """(seq, bin, pixel): bins of all sequences in order of `rank`; sequences shorter than merge_below share a pixel with their neighbours until that length is reached, and a long one closes it.

    What is held open before a sequence depends on those before it. Ranges of `span` ranks are summed up each as a function of the length held before
    it, these functions are applied in the order of the ranges, and each range is gone through with what it begins with. A function has as many pieces
    as there are sequences in the first merge_below of a range's length at most, and fewer where they end alike. Ranks are distinct whole numbers.
    """
    kind = sequences.schema["seq"].dataType.simpleString()
    placed = sequences.select("seq", F.col("rank").cast("long").alias("rank"), F.col("len").cast("long").alias("len")).withColumn("range", bin_of("rank", span))

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = _fold(pdf.sort_values("rank")["len"].to_numpy(np.int64), width, merge_below)
        return pd.DataFrame([(pdf["range"].iloc[0], *x) for x in pieces], columns=["range", "least", "add", "closed", "held"])

    def begun(pdf: pd.DataFrame) -> pd.DataFrame:
        out, pixel, held = [], 0, 0
        for number, pieces in pdf.sort_values(["range", "least"]).groupby("range"):
            out.append((number, pixel, held))
            x = pieces.iloc[int(np.searchsorted(pieces["least"].to_numpy(), held, side="right")) - 1]
            pixel, held = pixel + int(x["closed"]), int(x["held"]) + int(x["add"]) * held
        return pd.DataFrame(out, columns=["range", "pixel", "open"])

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pixel, held = int(pdf["pixel"].iloc[0]), int(pdf["open"].iloc[0])
        out = []
        for s in pdf.sort_values("rank").itertuples():
            if s.len < merge_below:
                out.append((s.seq, pixel, 0))
                held += int(s.len)
                if held >= merge_below:
                    pixel, held = pixel + 1, 0
                continue
            pixel, held = pixel + (held > 0), 0
            out.append((s.seq, pixel, 1))
            pixel += max(1, -(-int(s.len) // width))
        return pd.DataFrame(out, columns=["seq", "first", "own"])

    pieces = placed.groupBy("range").applyInPandas(summed, "range long, least long, add long, closed long, held long")
    starts = pieces.groupBy().applyInPandas(begun, "range long, pixel long, open long")
    f = placed.join(starts, "range").groupBy("range").applyInPandas(packed, f"seq {kind}, first long, own long").join(sequences.select("seq", "len"), "seq")
    bins = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("len") / width))
    return f.withColumn("bin", F.explode(F.sequence(zero(), bins - 1))).select("seq", "bin", (F.col("first") + F.col("own") * F.col("bin")).alias("pixel"))


def pixel_matrix(matrix: DataFrame, dots: DataFrame) -> DataFrame:
    """(x, y, n): the matrix in pixels; bins without a pixel go."""
    a = dots.select(F.col("seq").alias("aseq"), F.col("bin").alias("abin"), F.col("pixel").alias("x"))
    b = dots.select(F.col("seq").alias("bseq"), F.col("bin").alias("bbin"), F.col("pixel").alias("y"))
    return matrix.join(a, ["aseq", "abin"]).join(b, ["bseq", "bbin"]).groupBy("x", "y").agg(F.sum("n").alias("n"))
