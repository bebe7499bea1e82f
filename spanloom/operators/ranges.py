"""Running sums, running maxima, neighbours and ranks without a task that has to take a whole sequence, or the whole table, in order.

Two levels: rows are put into ranges of their order, each range is summed up, and what comes before (or after) a range is found among the
ranges' sums. Then a window inside each range is enough.

By position (`running`), a range is `width` positions wide. Where positions are distinct within a sequence, it has `width` rows at most, whatever
the data are like, so a sequence with all rows is many tasks' work. By value (`ranks`), the ranges' bounds come from a quantile sketch of
the distinct values; bounds and the ranges' sums are `ranges` numbers at most, which the driver holds.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions in a range.
WIDTH = 1 << 18
#: Rows that a task takes where tasks are told by the number of rows.
TASK_ROWS = 1 << 19


def tasks_for(rows: DataFrame, each: int = 1, task_rows: int | None = None) -> int:
    """How many tasks `rows`, each of which gives `each`, are dealt to, so that a task's memory does not grow with their number. Counts them."""
    return max(1, -(-rows.count() * each // (task_rows or TASK_ROWS)))


def bin_of(pos: str, width: int) -> Column:
    """The range of a position; whole-number division that rounds down, also below 0."""
    return F.expr(f"(`{pos}` - pmod(`{pos}`, {width})) div {width}")


def running(
    rows: DataFrame, by: list[str], pos: str, upto: dict[str, str] | None = None, before: dict[str, str] | None = None, top: dict[str, str] | None = None,
    top_upto: dict[str, str] | None = None, last: dict[str, str] | None = None, following: str | None = None, width: int | None = None,
    tasks: int | None = None, summed: list[str] | None = None,
) -> DataFrame:
    """`rows`, of distinct positions in each `by`, with new columns (new name: column) in the order of positions.

    upto: sums up to and with the row. before: sums of the rows before, 0 if there are none. top: maxima of the rows before; top_upto: with the row.
    last: the value in the row before. following: the name for the position of the next row. Those without a row to look at are null.
    tasks: how many tasks the ranges are dealt to, if that is not Spark's to choose. summed: positions may repeat; these columns are summed by position
    first, after the one shuffle by ranges, so that no task before it has to hold its positions.
    """
    width = width or WIDTH
    upto, before, top, top_upto, last = upto or {}, before or {}, top or {}, top_upto or {}, last or {}
    # one key for a range: as fields of it nulls are equal, so that the join below needs no other partitioning than the windows
    binned = rows.withColumn("__bin_of", F.struct(*by, bin_of(pos, width).alias("__bin")))
    if tasks:
        binned = binned.repartition(tasks, "__bin_of")
    if summed is not None:
        binned = binned.groupBy("__bin_of", pos).agg(*(F.sum(c).alias(c) for c in summed)).withColumns({c: F.col("__bin_of")[c] for c in by})
    sums, tops, lasts = sorted({*upto.values(), *before.values()}), sorted({*top.values(), *top_upto.values()}), sorted(set(last.values()))
    parts = [F.sum(c).alias(f"__sum_{c}") for c in sums] + [F.max(c).alias(f"__top_{c}") for c in tops] + [F.min(pos).alias("__first")]
    if lasts:
        parts.append(F.max(F.struct(F.col(pos).alias("__at"), *(F.col(c).alias(f"__last_{c}") for c in lasts))).alias("__end"))
    ranges = binned.groupBy("__bin_of").agg(*parts).withColumns({f"__by_{i}": F.col("__bin_of")[c] for i, c in enumerate(by)} | {"__bin": F.col("__bin_of")["__bin"]})
    order = W.partitionBy(*(f"__by_{i}" for i in range(len(by)))).orderBy("__bin")
    ahead = order.rowsBetween(W.unboundedPreceding, -1)
    carried = [F.sum(f"__sum_{c}").over(ahead).alias(f"__sum_{c}") for c in sums] + [F.max(f"__top_{c}").over(ahead).alias(f"__top_{c}") for c in tops] + [F.lead("__first").over(order).alias("__next")]
    if lasts:
        carried.append(F.lag("__end").over(order).alias("__end"))
    ranges = ranges.select(F.col("__bin_of").alias("__key"), *carried)
    inside = W.partitionBy("__bin_of").orderBy(pos)
    past, here = inside.rowsBetween(W.unboundedPreceding, -1), inside.rowsBetween(W.unboundedPreceding, 0)
    new = {f"__upto_{k}": F.sum(c).over(here) for k, c in upto.items()} | {f"__before_{k}": F.sum(c).over(past) for k, c in before.items()}
    new |= {f"__top_{k}": F.max(c).over(past) for k, c in top.items()} | {f"__tops_{k}": F.max(c).over(here) for k, c in top_upto.items()}
    new |= {f"__lag_{k}": F.lag(c).over(inside) for k, c in last.items()} | ({"__follow": F.lead(pos).over(inside)} if following else {}) | ({"__row": F.row_number().over(inside)} if lasts else {})
    done = binned.select("*", *(c.alias(k) for k, c in new.items()))
    joined = done.join(ranges, F.col("__bin_of") == F.col("__key"))
    nothing = lambda c: F.coalesce(c, F.lit(0))
    out = {k: nothing(F.col(f"__sum_{c}")) + F.col(f"__upto_{k}") for k, c in upto.items()} | {k: nothing(F.col(f"__sum_{c}")) + nothing(F.col(f"__before_{k}")) for k, c in before.items()}
    out |= {k: F.greatest(f"__top_{c}", f"__top_{k}") for k, c in top.items()} | {k: F.greatest(f"__top_{c}", f"__tops_{k}") for k, c in top_upto.items()}
    out |= {k: F.when(F.col("__row") == 1, F.col("__end")[f"__last_{c}"]).otherwise(F.col(f"__lag_{k}")) for k, c in last.items()}
    out |= {following: F.coalesce("__follow", "__next")} if following else {}
    kept = rows.columns if summed is None else [*by, pos, *summed]
    return joined.select(*(c for c in kept if c not in out), *(c.alias(k) for k, c in out.items()))


def splitters(values: DataFrame, value: str, ranges: int) -> list:
    """Up to `ranges` - 1 bounds of ranges that hold about as many of the values each."""
    shares = [i / ranges for i in range(1, ranges)]
    return sorted(set(values.agg(F.percentile_approx(value, F.array(*map(F.lit, shares)), F.lit(20 * ranges)).alias("q")).first()["q"] or [])) if shares else []


def range_of(value: Column, bounds: list, kind: str) -> Column:
    """How many bounds lie below the value, found in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    number = lambda xs: F.array(*(F.lit(x) for x in xs)).cast(f"array<{kind}>")
    ends = number([b[-1] for b in blocks])
    block = F.size(F.filter(ends, lambda b: b < value))
    inner = F.try_element_at(F.array(*(number(b) for b in blocks)), block + 1)
    return block * step + F.coalesce(F.size(F.filter(inner, lambda b: b < value)), F.lit(0))


def ranks(counts: DataFrame, value: str, sums: list[str], ranges: int = 256) -> DataFrame:
    """`counts`, a row a distinct number, with `upto_<c>` (the sum of c up to and with the row, in order of the value) and `all_<c>`; null values go."""
    rows = counts.where(F.col(value).isNotNull())
    kind = rows.schema[value].dataType.simpleString()
    bounds = splitters(rows, value, ranges)
    placed = rows.withColumn("__range", range_of(F.col(value), bounds, kind))
    found = {r["__range"]: r for r in placed.groupBy("__range").agg(*(F.sum(c).alias(c) for c in sums)).collect()}  # len(bounds) + 1 at most
    inside = W.partitionBy("__range").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    out = placed
    for c in sums:
        kind = rows.schema[c].dataType.simpleString()
        total = [(found[i][c] if i in found else 0) or 0 for i in range(len(bounds) + 1)]
        ahead = F.array(*(F.lit(x) for x in [0, *accumulate(total)][:-1])).cast(f"array<{kind}>")
        out = out.withColumns({f"upto_{c}": F.element_at(ahead, F.col("__range") + 1) + F.sum(c).over(inside), f"all_{c}": F.lit(sum(total)).cast(kind)})
    return out.drop("__range")


def counted(df: DataFrame, value: str, ranges: int = 256, times: str | None = None) -> DataFrame:
    """(v, n, upto_n, all_n) of the distinct values. times: the column that says how often a row counts, if not once."""
    return ranks(df.groupBy(F.col(value).alias("v")).agg((F.sum(times) if times else F.count("*")).alias("n")), "v", ["n"], ranges)


def element_at(ranked: DataFrame, places: dict[str, Column]) -> DataFrame:
    """One row: for each name the value at a place, from 0, in a table of `counted`."""
    return ranked.agg(*(F.min(F.when(F.col("upto_n") > place, F.col("v"))).alias(k) for k, place in places.items()))


def median(df: DataFrame, value: str, name: str, share: float = 0.5, times: str | None = None) -> DataFrame:
    """One row: the exact percentile of a column, between two values where it falls between them; null without values. times: as in `counted`."""
    at = (F.col("all_n") - 1) * F.lit(share)
    two = counted(df, value, times=times).withColumns({"__lo": F.floor(at), "__hi": F.ceil(at), "__at": at})
    pick = lambda place: F.min(F.when(F.col("upto_n") > F.col(place), F.col("v"))).cast("double")
    q = two.agg(pick("__lo").alias("lo"), pick("__hi").alias("hi"), F.max("__at").alias("at"))
    between = F.when(F.ceil("at") == F.floor("at"), F.col("lo")).otherwise((F.ceil("at") - F.col("at")) * F.col("lo") + (F.col("at") - F.floor("at")) * F.col("hi"))
    return q.select(between.alias(name))
