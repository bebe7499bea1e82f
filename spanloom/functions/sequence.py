"""Sequence text: complement, reverse complement, masking, slices, line wrapping, mate names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC letters whose complement differs, and their complements.
IUPAC = "ABCDGHKMRTUVYabcdghkmrtuvy"
COMPLEMENT = "TVGHCDMKYAABRtvghcdmkyaabr"


def complement(seq: Column) -> Column:
    return F.translate(seq, IUPAC, COMPLEMENT)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def masked(seq: Column) -> Column:
    """Upper case, with N for every sign but A, C, G and T in either case."""
    return F.regexp_replace(F.translate(seq, "acgt", "ACGT"), "[^ACGT]", "N")


def subsequence(seq: Column, beg: Column, end: Column) -> Column:
    """Half-open slice, clipped to the sequence."""
    lo = F.greatest(beg, F.lit(0))
    hi = F.least(end, F.length(seq))
    return F.substring(seq, (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))


def wrapped(seq: Column, width: int = 60) -> Column:
    """Lines of `width`, with breaks between them."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def mate_stem(name: Column) -> Column:
    """A read name without /1 or /2 and the like at its end."""
    return F.regexp_replace(name, "/[^/]$", "")


def are_mates(a: Column, b: Column) -> Column:
    """Equal names, or names that differ in the one character after a final slash only."""
    return (a == b) | ((F.length(a) == F.length(b)) & a.rlike("/[^/]$") & b.rlike("/[^/]$") & (mate_stem(a) == mate_stem(b)))
