"""Size-dependent factors, weights and integer helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# log10 of the sizes between which a factor falls, and the factor at either end.
CHAIN_SIZE = (4.0, 6.0, 0.95, 0.10)
CHAIN_FRAGMENT = (4.0, 6.0, 0.50, 0.10)
LOW_COPY = (4.7, 6.0, 0.7, 0.3)
BACKBONE_EXTENSION = (5.0, 6.0, 1.0, 0.1)
COVERAGE_GAIN = (4.0, 6.0, 0.5, 0.1)


def zero() -> Column:
    """0 as a long; a function, as columns can't be made before there is a session."""
    return F.lit(0).cast("long")


def log_linear(size: Column, shape: tuple[float, float, float, float]) -> Column:
    """A factor that is linear in log10(size) between two sizes, and constant outside."""
    lo, hi, first, last = shape
    x = F.log10(F.greatest(size.cast("double"), F.lit(1.0)))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo)))
    return F.lit(first) + share * (last - first)


def scaled_overlap(size: Column, neff: Column) -> Column:
    """An overlap's size by the effective number of its alignments."""
    return size * F.log2(neff + 1)


def link_density(links: Column, a: Column, b: Column) -> Column:
    return links / F.sqrt(a) / F.sqrt(b)


def harmonic(a: Column, b: Column) -> Column:
    return 2 * a * b / (a + b)


def shift_to_int(size: Column) -> Column:
    """The least number of halvings that bring a size to 2^31 - 1 or below."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(32)), lambda i: F.call_function("shiftright", size.cast("long"), i) > 2147483647))


def midpoint(a: Column, b: Column) -> Column:
    """(a + b) div 2 of longs that aren't negative, without overflow."""
    half = lambda x: F.shiftright(x, 1)
    return half(a) + half(b) + a.bitwiseAND(b).bitwiseAND(F.lit(1))


def windows_up(size: Column, width: int) -> Column:
    return F.when(size > 0, F.floor((size - 1) / width) + 1).otherwise(0).cast("long")


def windows_down(size: Column, width: int) -> Column:
    return F.floor(size / width).cast("long")


def turned_type(kind: Column) -> Column:
    """An overlap's type flags seen from its other sequence: the two halves of the byte change places."""
    return F.shiftleft(kind, 4).bitwiseOR(F.shiftright(kind, 4)).bitwiseAND(F.lit(0x77))
