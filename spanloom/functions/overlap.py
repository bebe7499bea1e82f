"""Geometry of overlaps between two sequences: type, extension along the diagonal, second copies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type flags.
FIRST_INSIDE, SECOND_INSIDE, EXTENDS, INTERNAL, REPEAT = 0x01, 0x10, 0x22, 0x44, 0x08
# An end counts as overhanging beyond this share of its sequence, or this length.
OVERHANG_SHARE, OVERHANG_SIZE = 0.1, 100_000


def overhangs(size: Column, length: Column) -> Column:
    return (size > length * OVERHANG_SHARE) | (size > OVERHANG_SIZE)


def overlap_type(abeg: Column, aend: Column, alen: Column, bbeg: Column, bend: Column, blen: Column, rev: Column) -> Column:
    """Type flags from which of the four ends overhang; b's ends are taken as they lie along a."""
    a0, a1, b0, b1 = overhangs(abeg, alen), overhangs(alen - aend, alen), overhangs(bbeg, blen), overhangs(blen - bend, blen)
    near, far = F.when(rev, b1).otherwise(b0), F.when(rev, b0).otherwise(b1)
    extends = (a0 & ~a1 & ~near & far) | (~a0 & a1 & near & ~far)
    kind = F.when(extends, F.lit(EXTENDS)).otherwise(0).bitwiseOR(F.when(~a0 & ~a1, F.lit(FIRST_INSIDE)).otherwise(0)).bitwiseOR(F.when(~b0 & ~b1, F.lit(SECOND_INSIDE)).otherwise(0))
    return F.when(kind == 0, F.lit(INTERNAL)).otherwise(kind)


def extended(abeg: Column, aend: Column, alen: Column, bbeg: Column, bend: Column, blen: Column, rev: Column) -> Column:
    """struct<abeg, aend, bbeg, bend>: the box's diagonal carried on to the edges of the alen x blen rectangle.

    Along the diagonal a grows by 1 and b by the slope; how far it goes either way is the nearer of the two edges.
    """
    slope = (bend - bbeg) / (aend - abeg)
    amid, bmid = (abeg + aend) / 2.0, (bbeg + bend) / 2.0
    up, down = (blen - bmid) / slope, bmid / slope
    left = F.least(amid, F.when(rev, up).otherwise(down))
    right = F.least(alen - amid, F.when(rev, down).otherwise(up))
    low = F.when(rev, right).otherwise(left)
    high = F.when(rev, left).otherwise(right)
    box = F.struct((amid - left).alias("abeg"), (amid + right).alias("aend"), (bmid - low * slope).alias("bbeg"), (bmid + high * slope).alias("bend"))
    d = lambda x: x.cast("double")
    flat = F.struct(d(abeg).alias("abeg"), d(abeg).alias("aend"), F.lit(0.0).alias("bbeg"), d(blen).alias("bend"))
    still = F.struct(d(abeg).alias("abeg"), d(aend).alias("aend"), d(bbeg).alias("bbeg"), d(bend).alias("bend"))
    return F.when(aend == abeg, flat).when(bend == bbeg, still).otherwise(box)


def second_copies(p0: Column, p1: Column, q0: Column, q1: Column, s0: Column, s1: Column, t0: Column, t1: Column, rev: Column) -> Column:
    """array<struct<beg, end>>: where a second box (s, t) covers the first one's p-range [p0, p1) without lying on the first one's q-range [q0, q1)."""
    lo, hi = F.greatest(p0, s0), F.least(p1, s1)
    pace = (s1 - s0) / (t1 - t0)
    d0, d1 = F.when(rev, t1 - q1).otherwise(q0 - t0), F.when(rev, t1 - q0).otherwise(q1 - t0)
    on0 = F.when(t1 > t0, F.greatest(lo, F.floor(s0 + pace * d0))).when((t0 >= q0) & (t0 < q1), lo).otherwise(hi).cast("long")
    on1 = F.when(t1 > t0, F.least(hi, F.ceil(s0 + pace * d1))).when((t0 >= q0) & (t0 < q1), hi).otherwise(lo).cast("long")
    piece = lambda a, b: F.struct(a.cast("long").alias("beg"), b.cast("long").alias("end"))
    parts = F.when(on0 < on1, F.array(piece(lo, on0), piece(on1, hi))).otherwise(F.array(piece(lo, hi)))
    return F.filter(parts, lambda x: x["beg"] < x["end"])
