"""Layouts: objects built of oriented component slices and gaps, and positions carried between the two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.scale import zero
from spanloom.operators.intervals import FLOOR, point_join
from spanloom.operators.ranges import running


def offsets(parts: DataFrame) -> DataFrame:
    """parts: object, part, kind ('W', or a gap kind), comp, x, y (slice start and length), rev, gap. Adds a and b: where a slice begins in its object without and with gaps; gaps go."""
    slices, gaps = F.when(F.col("kind") == "W", F.col("y")).otherwise(zero()), F.when(F.col("kind") == "W", zero()).otherwise(F.col("gap"))
    both = running(parts.withColumns({"__slice": slices, "__both": slices + gaps}), ["object"], "part", before={"a": "__slice", "b": "__both"})
    return both.where("kind = 'W'").select("object", "part", "comp", "x", "y", "rev", "a", "b")


def identity(sequences: DataFrame) -> DataFrame:
    """Every sequence as an object of one forward slice."""
    return sequences.select(F.col("seq").alias("object"), F.lit(1).cast("long").alias("part"), F.col("seq").alias("comp"), zero().alias("x"), F.col("len").alias("y"), F.lit(False).alias("rev"), zero().alias("a"), zero().alias("b"))


def _in_slices(points: DataFrame, segments: DataFrame, seq: str, pos: str, within: str, start: str) -> DataFrame:
    """points with the slice that holds each, found by `point_join`; within: the segments' column that names the sequence, start: where a slice begins on it."""
    s = segments.select(F.col(within).alias("__of"), F.col(start).alias("__lo"), (F.col(start) + F.col("y")).alias("__hi"), *(F.col(c).alias(f"__{c}") for c in ("object", "comp", "x", "y", "rev", "a", "b") if c in segments.columns))
    return point_join(points, s, (seq, pos), ("__of", "__lo", "__hi")).drop("__of", "__lo", "__hi")


_SLICE = ("__object", "__comp", "__x", "__y", "__rev", "__a", "__b")


def lifted(points: DataFrame, segments: DataFrame, seq: str = "seq", pos: str = "pos", start: str = "b", prefix: str = "") -> DataFrame:
    """points with object and object position: the slice of the component that holds the point, mirrored where it is reversed. Points in no slice go."""
    j = _in_slices(points, segments, seq, pos, "comp", "x")
    at = F.when(F.col("__rev"), F.col(f"__{start}") + F.col("__x") + F.col("__y") - 1 - F.col(pos)).otherwise(F.col(f"__{start}") + F.col(pos) - F.col("__x"))
    return j.withColumns({f"{prefix}object": F.col("__object"), f"{prefix}object_pos": at}).drop(*_SLICE)


def lowered(points: DataFrame, segments: DataFrame, object_: str = "object", pos: str = "object_pos", start: str = "b") -> DataFrame:
    """The inverse: points on objects with comp and comp_pos; points in gaps go."""
    j = _in_slices(points, segments, object_, pos, "object", start)
    into = F.col(pos) - F.col(f"__{start}")
    at = F.when(F.col("__rev"), F.col("__x") + F.col("__y") - 1 - into).otherwise(F.col("__x") + into)
    return j.withColumns({"comp": F.col("__comp"), "comp_pos": at}).drop(*_SLICE)


def interval_lifted(ivals: DataFrame, segments: DataFrame, seq: str = "seq", beg: str = "beg", end: str = "end", prefix: str = "") -> DataFrame:
    """Intervals that lie in one slice whole, with object, obj_beg, obj_end; those that cross slices go. An interval of no length is its begin."""
    j = _in_slices(ivals, segments, seq, beg, "comp", "x").where(F.col(end) <= F.col("__x") + F.col("__y"))
    stop, into = F.col("__b") + F.col("__x") + F.col("__y"), F.col("__b") - F.col("__x")
    size = F.greatest(F.col(end) - F.col(beg), zero())
    lo = F.when(~F.col("__rev"), into + F.col(beg)).when(size == 0, stop - F.col(beg) - 1).otherwise(stop - F.col(beg) - size)
    return j.withColumns({f"{prefix}object": F.col("__object"), f"{prefix}obj_beg": lo, f"{prefix}obj_end": lo + size}).drop(*_SLICE)


def pairs_lifted(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Pairs (aseq, abeg, aend, bseq, bbeg, bend, and others) carried to the objects of `segments`; a pair goes if either interval crosses slices or lies in none."""
    one = interval_lifted(pairs, segments, "aseq", "abeg", "aend", "__a_")
    both = interval_lifted(one, segments, "bseq", "bbeg", "bend", "__b_")
    moved = {f"{s}{new}": F.col(f"__{s}_{old}") for s in "ab" for new, old in (("seq", "object"), ("beg", "obj_beg"), ("end", "obj_end"))}
    return both.withColumns(moved).drop(*(f"__{s}_{c}" for s in "ab" for c in ("object", "obj_beg", "obj_end")))


def next_mark(points: DataFrame, marks: DataFrame, seq: str = "seq", pos: str = "pos") -> DataFrame:
    """(seq, pos, end): for each different point (columns seq and pos) the first of the marks (seq, end) on its sequence that lies beyond it; points without one go.

    An as-of join by a union: points and marks are put in order together, from the back, and each point takes the last mark met before it.
    """
    p = points.select(F.col(seq).alias("seq"), (-F.col(pos)).alias("at"), F.lit(None).cast("long").alias("mark"), F.lit(True).alias("point"))
    m = marks.select("seq", (-F.col("end")).alias("at"), (-F.col("end")).alias("mark"), F.lit(False).alias("point"))
    both = p.unionByName(m).groupBy("seq", "at").agg(F.max("mark").alias("mark"), F.max("point").alias("point"))
    found = running(both, ["seq"], "at", top={"met": "mark"}).where("point and met is not null")
    return found.select("seq", (-F.col("at")).alias("pos"), (-F.col("met")).alias("end"))


def on_backbone(pairs: DataFrame, sequences: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs (aseq, abeg, aend, bseq, bbeg, bend, and others) carried to backbones; both ends have to arrive.

    sequences: seq, len, rev (whether positions count from the end). marks: seq, end, target, size: up to `end` (from the mark before) a sequence lies on
    backbone `target`, whose last position is there. An interval goes if it reaches over the next mark, or lies before its backbone's begin.
    """
    out = pairs
    for s in "ab":
        own = sequences.select(F.col("seq").alias("__seq"), F.col("len").alias("__len"), F.col("rev").alias("__rev"))
        out = out.join(own, F.col(f"{s}seq") == F.col("__seq")).drop("__seq")
        lo = F.when(F.col("__rev"), F.col("__len") - F.col(f"{s}end")).otherwise(F.col(f"{s}beg"))
        hi = F.when(F.col("__rev"), F.col("__len") - F.col(f"{s}beg")).otherwise(F.col(f"{s}end"))
        out = out.withColumns({"__lo": lo, "__hi": hi}).drop("__len", "__rev")
        near = next_mark(out, marks, f"{s}seq", "__lo").join(marks, ["seq", "end"]).select(F.col("seq").alias("__seq"), F.col("pos").alias("__pos"), F.col("end").alias("__mark"), F.col("target").alias("__target"), F.col("size").alias("__size"))
        out = out.join(near, (F.col(f"{s}seq") == F.col("__seq")) & (F.col("__lo") == F.col("__pos"))).where("__mark >= __hi and __size >= __mark - __lo")
        at = lambda x: F.col("__size") - (F.col("__mark") - F.col(x))
        out = out.withColumns({f"{s}seq": F.col("__target"), f"{s}beg": at("__lo"), f"{s}end": at("__hi")}).drop("__seq", "__pos", "__mark", "__target", "__size", "__lo", "__hi")
    return out


def slices(breaks: DataFrame, sequences: DataFrame) -> DataFrame:
    """(seq, k, name, beg, end): sequences cut at breaks (seq, pos) into consecutive pieces named <seq>_ec_<k>."""
    cuts = breaks.select("seq", "pos").distinct().join(sequences.select("seq", "len"), "seq").where("pos > 0 and pos < len").select("seq", "pos")
    starts = sequences.select("seq", zero().alias("pos")).unionByName(cuts)
    order = W.partitionBy("seq").orderBy("pos")
    p = starts.withColumn("k", F.row_number().over(order).cast("long")).withColumn("end", F.lead("pos").over(order)).join(sequences.select("seq", "len"), "seq")
    return p.select("seq", "k", F.concat(F.col("seq").cast("string"), F.lit("_ec_"), F.col("k").cast("string")).alias("name"), F.col("pos").alias("beg"), F.coalesce("end", "len").alias("end"))


def _piece_bins(pieces: DataFrame, levels: list[int]) -> DataFrame:
    """(on, level, bin, held): for each level (bits) the pieces that reach into a bin or the next one, so that an interval no longer than a bin finds all of its own where it begins."""
    level = pieces.where("beg < end").select(F.col("seq").alias("on"), "beg", "end", "name", F.explode(F.array(*map(F.lit, levels))).alias("level"))
    at = lambda c: F.call_function("shiftright", c, F.col("level"))
    bins = level.withColumn("bin", F.explode(F.sequence(F.greatest(at(F.col("beg")) - 1, zero()), at(F.col("end") - 1))))
    return bins.groupBy("on", "level", "bin").agg(F.collect_list(F.struct("beg", "end", "name")).alias("held"))


def split_pairs(pairs: DataFrame, pieces: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Interval pairs cut wherever either side meets a piece's end.

    pairs: aread, abpos, aepos, bread, bbpos, bepos, rev, and what to `keep`. A cut on one side is carried to the other by linear interpolation with
    whole numbers. A fragment goes to the pieces that hold its midpoints, and is clipped to them. Returns what is kept, apiece, abeg, aend, bpiece,
    bbeg, bend, rev, in the sequences' coordinates.

    A pair meets the pieces near it, by sequence and bin, once for either side, and is cut within its row. Bins are of 4,096 positions, or of the
    pair's length up to a power of 4 if it is longer, so a row holds the pieces of some such lengths.
    """
    bits = lambda size: F.length(F.bin(F.greatest(size - 1, zero())))
    even = lambda n: n + n % 2
    last = pieces.agg(F.max("end")).first()[0] or 1
    levels = list(range(FLOOR, max(FLOOR, (last - 1).bit_length()) + 2, 2))
    table, f = _piece_bins(pieces, levels), pairs.select(*dict.fromkeys([*keep, "aread", "abpos", "aepos", "bread", "bbpos", "bepos", "rev"]))
    for s in "ab":
        level = F.least(F.lit(levels[-1]), even(F.greatest(F.lit(FLOOR), bits(F.col(f"{s}epos") - F.col(f"{s}bpos")))))
        f = f.withColumn("__level", level).withColumn("__bin", F.call_function("shiftright", F.greatest(f"{s}bpos", zero()), F.col("__level")))
        t = table.select(F.col("on").alias(f"{s}read"), F.col("level").alias("__level"), F.col("bin").alias("__bin"), F.col("held").alias(f"__{s}"))
        f = f.join(t, [f"{s}read", "__level", "__bin"]).drop("__level", "__bin")
    alen, blen = F.col("aepos") - F.col("abpos"), F.col("bepos") - F.col("bbpos")
    cuts = lambda s: F.transform(F.filter(f"__{s}", lambda p: (p["beg"] > 0) & (p["beg"] > F.col(f"{s}bpos")) & (p["beg"] < F.col(f"{s}epos"))), lambda p: p["beg"])
    along = lambda c: F.when(F.col("rev"), F.col("bepos") - c).otherwise(c - F.col("bbpos"))
    carried = F.transform(cuts("b"), lambda c: F.col("abpos") + F.floor((along(c) * alen) / F.greatest(blen, F.lit(1))).cast("long"))
    f = f.withColumn("__at", F.array_sort(F.array_distinct(F.concat(F.array("abpos"), cuts("a"), carried))))
    f = f.withColumn("__f", F.explode(F.transform("__at", lambda x, i: F.struct(x.alias("at"), F.coalesce(F.get("__at", i + 1), F.col("aepos")).alias("to")))))
    f = f.withColumns({"at": F.col("__f.at"), "to": F.col("__f.to")}).drop("__at", "__f").where("to > at")
    other = lambda x: F.floor(((x - F.col("abpos")) * blen) / alen).cast("long")
    lo, hi = other(F.col("at")), other(F.col("to"))
    f = f.withColumn("bbeg", F.when(F.col("rev"), F.col("bepos") - hi).otherwise(F.col("bbpos") + lo)).withColumn("bend", F.when(F.col("rev"), F.col("bepos") - lo).otherwise(F.col("bbpos") + hi))
    f = f.withColumn("amid", F.floor((F.col("at") + F.col("to")) / 2).cast("long")).withColumn("bmid", F.floor((F.col("bbeg") + F.col("bend")) / 2).cast("long"))
    for s in "ab":
        f = f.withColumn(f"__{s}", F.explode(F.filter(f"__{s}", lambda p: (p["beg"] <= F.col(f"{s}mid")) & (F.col(f"{s}mid") < p["end"]))))  # noqa: B023
    clip = lambda x, s: F.least(F.greatest(F.col(x), F.col(f"__{s}.beg")), F.col(f"__{s}.end"))
    return f.select(*keep, F.col("__a.name").alias("apiece"), clip("at", "a").alias("abeg"), clip("to", "a").alias("aend"), F.col("__b.name").alias("bpiece"), clip("bbeg", "b").alias("bbeg"), clip("bend", "b").alias("bend"), "rev")


def agp(segments: DataFrame, gap: int = 100, gap_kind: str = "scaffold", evidence: str = "proximity_ligation") -> DataFrame:
    """Rows of an AGP table: 1-based closed positions, with a gap row between consecutive slices. segments: object, part, comp, x, y, rev."""
    s = running(segments.withColumn("__one", F.lit(1).cast("long")), ["object"], "part", upto={"n": "__one"}, before={"beg": "y"})
    s = s.withColumn("beg", F.col("beg") + (F.col("n") - 1) * gap)
    w = s.select("object", (F.col("beg") + 1).alias("obj_beg"), (F.col("beg") + F.col("y")).alias("obj_end"), (2 * F.col("n") - 1).alias("part"), F.lit("W").alias("kind"), F.col("comp").cast("string").alias("c1"), (F.col("x") + 1).cast("string").alias("c2"), (F.col("x") + F.col("y")).cast("string").alias("c3"), F.when(F.col("rev"), "-").otherwise("+").alias("c4"))
    g = s.where("n > 1").select("object", (F.col("beg") - gap + 1).alias("obj_beg"), F.col("beg").alias("obj_end"), (2 * F.col("n") - 2).alias("part"), F.lit("N").alias("kind"), F.lit(str(gap)).alias("c1"), F.lit(gap_kind).alias("c2"), F.lit("yes").alias("c3"), F.lit(evidence).alias("c4"))
    return w.unionByName(g) if gap else w


def by_length(objects: DataFrame, prefix: str = "scaffold_") -> DataFrame:
    """objects (object, len) with a name by descending length."""
    return objects.withColumn("name", F.concat(F.lit(prefix), F.row_number().over(W.orderBy(F.col("len").desc(), "object")).cast("string")))


def built(segments: DataFrame, sequences: DataFrame, gap: int = 100) -> DataFrame:
    """(object, seq): objects' text from their slices (comp, x, y, rev, part) and sequences (seq, text), with N for gaps."""
    from spanloom.functions.sequence import reverse_complement

    t = segments.join(sequences.select(F.col("seq").alias("comp"), "text"), "comp")
    piece = F.substring("text", (F.col("x") + 1).cast("int"), F.col("y").cast("int"))
    t = t.withColumn("piece", F.when(F.col("rev"), reverse_complement(piece)).otherwise(piece))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("part", "piece"))), lambda p: p["piece"])
    return t.groupBy("object").agg(F.array_join(parts, "N" * gap).alias("seq"))


def haplotype_layout(order: DataFrame, members: DataFrame, gap: int = 100) -> DataFrame:
    """Layout of each haplotype along a scaffold of groups.

    order: scaffold, rank, grp, rev (consecutive repeats of a group count once). members: grp, hap, comp, len, pos, rev. A reversed group
    gives its members backwards and turned. Returns scaffold, hap, n, comp, rev, beg, end.
    """
    w = W.partitionBy("scaffold").orderBy("rank")
    o = order.withColumn("again", F.coalesce(F.lag("grp").over(w) == F.col("grp"), F.lit(False))).where("not again").select("scaffold", "rank", "grp", F.col("rev").alias("grev"))
    m = o.join(members, "grp").withColumn("key", F.when(F.col("grev"), -F.col("pos")).otherwise(F.col("pos")))
    line = W.partitionBy("scaffold", "hap").orderBy("rank", "key", "comp")
    m = m.withColumn("n", F.row_number().over(line).cast("long")).withColumn("beg", F.coalesce(F.sum("len").over(line.rowsBetween(W.unboundedPreceding, -1)), zero()) + (F.col("n") - 1) * gap)
    return m.select("scaffold", "hap", "n", "comp", (F.col("grev") != F.col("rev")).alias("rev"), "beg", (F.col("beg") + F.col("len")).alias("end"))


def assembly_lines(segments: DataFrame) -> DataFrame:
    """Annotation of an assembly: each slice with a number in object and part order, its offset along all objects, and its object's signed list of numbers."""
    o = segments.groupBy("object").agg(F.sum("y").alias("size"), F.count("*").alias("parts"))
    line = W.orderBy("object")
    o = o.withColumn("first", F.coalesce(F.sum("parts").over(line.rowsBetween(W.unboundedPreceding, -1)), zero())).withColumn("at", F.coalesce(F.sum("size").over(line.rowsBetween(W.unboundedPreceding, -1)), zero()))
    part = W.partitionBy("object").orderBy("part")
    s = segments.join(o.select("object", "first", "at"), "object").withColumn("id", F.col("first") + F.row_number().over(part)).withColumn("offset", F.col("at") + F.col("a"))
    signed = F.when(F.col("rev"), -F.col("id")).otherwise(F.col("id"))
    lists = s.groupBy("object").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", signed.alias("id")))), lambda x: x["id"].cast("string")), " ").alias("line"))
    return s.join(lists, "object").select("object", "part", "id", "offset", "line")


def from_signed(lines: DataFrame, fragments: DataFrame) -> DataFrame:
    """The layout that signed lists describe. lines: object, line; fragments: id, comp, x, y."""
    e = lines.select("object", F.posexplode(F.split("line", r"\s+")).alias("part", "token")).withColumn("id", F.abs(F.col("token").cast("long"))).withColumn("rev", F.col("token").startswith("-"))
    return e.join(fragments, "id").select("object", (F.col("part") + 1).cast("long").alias("part"), "comp", "x", "y", "rev")
