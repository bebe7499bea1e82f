"""Statistics over lengths, coverage and p-values. Ranks and percentiles come from `ranges`: no window or buffer takes all values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.scale import zero
from spanloom.operators.ranges import counted, median, ranks


def nl_stats(lengths: DataFrame, length: str = "len") -> DataFrame:
    """(decile, n, l): the largest length such that those as long or longer hold at least the decile of the total, and their number.

    Lengths are counted first, so the running sum is over distinct lengths.
    """
    c = lengths.groupBy((-F.col(length)).alias("less")).agg(F.count("*").alias("rows"), F.sum(F.col(length).cast("long")).alias("sum"))
    run = ranks(c, "less", ["rows", "sum"]).select((-F.col("less")).cast("long").alias("len"), F.col("rows").alias("n"), F.col("upto_sum").alias("upto"), F.col("upto_rows").alias("rows"), F.col("all_sum").alias("total"))
    tens = F.explode(F.sequence(F.lit(1), F.lit(10))).alias("i")
    need = run.select("*", tens).withColumn("need", F.col("total") * F.col("i"))
    hit = need.where(F.col("upto") * 10 >= F.col("need"))
    best = hit.groupBy("i").agg(F.max(F.struct("len", "upto", "n", "rows", "need")).alias("m"))
    # of the rows of this length, those beyond the need don't count
    extra = F.expr("(m.upto * 10 - m.need) div (m.len * 10)")
    return best.select((F.col("i") * 10).cast("long").alias("decile"), F.col("m.len").alias("n"), (F.col("m.rows") - F.when(F.col("m.len") > 0, extra).otherwise(0)).cast("long").alias("l"))


def coverage_histogram(steps: DataFrame, cap: int = 16) -> DataFrame:
    """(copies, bases): the length at each coverage, those above the cap together."""
    return steps.groupBy(F.least("cov", F.lit(cap).cast("long")).alias("copies")).agg(F.sum(F.col("end") - F.col("beg")).alias("bases"))


def copy_number(hist: DataFrame, cap: int = 16) -> DataFrame:
    """(ploidy): the elbow of the cumulative histogram between its 50% and 90% points, plus 1; a table of cap + 1 rows. No rows give 1."""
    grid = hist.sparkSession.range(cap + 1).select(F.col("id").alias("copies"))
    h = grid.join(F.broadcast(hist), "copies", "left").select("copies", F.coalesce("bases", zero()).alias("bases"))
    c = h.select("copies", F.sum("bases").over(W.orderBy("copies")).alias("upto"), F.sum("bases").over(W.partitionBy()).alias("total"))
    reach = lambda share: F.min(F.when(F.col("upto") >= F.floor(F.col("total") * share), F.col("copies"))).over(W.partitionBy())
    c = c.withColumn("low", reach(0.5)).withColumn("high", reach(0.9))
    c = c.withColumn("high", F.least(F.greatest("low", "high") + 1, F.lit(cap).cast("long")))
    top = F.max(F.when(F.col("copies") == F.col("high"), F.col("upto"))).over(W.partitionBy())
    c = c.withColumn("bend", (F.col("high") + 1) * F.col("upto") - (F.col("copies") + 1) * top)
    inside = (F.col("copies") >= F.col("low")) & (F.col("copies") < F.col("high")) & (F.col("total") > 0)
    return c.agg((F.coalesce(F.max_by("copies", F.when(inside, F.struct("bend", -F.col("copies")))), F.max(F.when(F.col("total") > 0, F.col("low"))), zero()) + 1).alias("ploidy"))


def mad_outliers(df: DataFrame, value: str, limit: float = 3.5) -> DataFrame:
    """`df` with the median, the median absolute deviation, and whether 0.6745 |x - median| exceeds `limit` deviations."""
    d = df.crossJoin(F.broadcast(median(df, value, "med"))).withColumn("dev", F.abs(F.col(value) - F.col("med")))
    return d.crossJoin(F.broadcast(median(d, "dev", "mad"))).withColumn("outlier", 0.6745 * F.col("dev") > limit * F.col("mad")).drop("dev")


def significant(df: DataFrame, p: str, alpha: Column) -> DataFrame:
    """Rows that survive the Benjamini-Hochberg procedure: p up to the largest p_i with p_i * n <= i * alpha.

    Ranks come from counts by distinct p, so equal p-values share the highest rank among them, which decides alike.
    """
    ranked = counted(df.select(F.col(p).alias("p")), "p")
    cut = ranked.where(F.col("v") * F.col("all_n") <= F.col("upto_n") * alpha).agg(F.max("v").alias("__cut"))
    return df.crossJoin(F.broadcast(cut)).where(F.col(p) <= F.col("__cut")).drop("__cut")


def element_at_share(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row with q0, q1, ...: the element at floor(n * share) of the sorted values (0-based), from counts by value."""
    at = lambda share: F.least(F.floor(F.col("all_n") * share), F.col("all_n") - 1)
    return counted(df, value).agg(*[F.min(F.when(F.col("upto_n") > at(s), F.col("v"))).alias(f"q{i}") for i, s in enumerate(shares)])


def spread_scaled(df: DataFrame, value: str, out: str = "scaled") -> DataFrame:
    """Values on the scale where the 10% element is 0.1 and the 90% element 0.9, from 0 up."""
    q = element_at_share(df, value, [0.1, 0.9])
    width = F.greatest(F.col("q1") - F.col("q0"), F.lit(1e-6))
    return df.crossJoin(F.broadcast(q)).withColumn(out, F.greatest(F.lit(0.0), 0.1 + 0.8 * (F.col(value) - F.col("q0")) / width)).drop("q0", "q1")


def trimmed_mean(hist: DataFrame, share: float = 0.1) -> DataFrame:
    """(bases, weighted, mean) of a coverage histogram (copies, bases) without `share` of the bases at either end."""
    c = ranks(hist, "copies", ["bases"]).select("copies", "bases", F.col("upto_bases").alias("upto"), F.col("all_bases").alias("total"))
    cut = F.floor(F.col("total") * share)
    kept = F.greatest(zero(), F.least("upto", F.col("total") - cut) - F.greatest(F.col("upto") - F.col("bases"), cut))
    return c.select("copies", kept.alias("kept")).agg(F.sum("kept").alias("bases"), F.sum(F.col("kept") * F.col("copies")).alias("weighted")).withColumn("mean", F.col("weighted") / F.col("bases"))


def effective_number(df: DataFrame, group: str, size: str) -> DataFrame:
    """(group, neff): (sum of sizes)^2 over the sum of squared sizes."""
    s = df.groupBy(group).agg(F.sum(size).alias("s1"), F.sum(F.col(size) * F.col(size)).alias("s2"))
    return s.select(group, (F.col("s1").cast("double") * F.col("s1") / F.col("s2")).alias("neff"))


def softmax_confidence(df: DataFrame, group: str, score: str, temperature: float = 0.2) -> DataFrame:
    """Adds p, the softmax of scores within a group, and conf, 1 less the normalised entropy (1 for a group of one)."""
    w = W.partitionBy(group)
    e = df.withColumn("__e", F.exp((F.col(score) - F.max(score).over(w)) / temperature)).withColumn("__n", F.count("*").over(w))
    e = e.withColumn("p", F.col("__e") / F.sum("__e").over(w))
    h = -F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0)).over(w)
    return e.withColumn("conf", F.when(F.col("__n") > 1, 1 - h / F.log(F.col("__n"))).otherwise(1.0)).drop("__e", "__n")


def matrix_scaled(df: DataFrame, value: str, how: str = "log1p", clip: float = 0.98) -> DataFrame:
    """Values clipped at a percentile of those that aren't 0, put through sqrt or log1p, and divided by the largest."""
    top = median(df.where(F.col(value) > 0), value, "__clip", clip)
    f = {"log1p": F.log1p, "sqrt": F.sqrt, "none": lambda x: x}[how]
    x = df.crossJoin(F.broadcast(top)).withColumn("scaled", f(F.least(F.col(value).cast("double"), F.col("__clip"))))
    return x.withColumn("scaled", F.col("scaled") / f(F.col("__clip"))).drop("__clip")
