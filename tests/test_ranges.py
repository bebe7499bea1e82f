"""Two-level windows and ranks against plain loops, with ranges so small that every table has many."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import intervals, layout, ranges, stats


def table(spark, n=400, seqs=3, seed=1):
    rng = random.Random(seed)
    at = rng.sample(range(-50, 5000), n)
    rows = [(0 if i < n * 0.8 else rng.randint(1, seqs), p, rng.randint(-9, 9), rng.randint(0, 99)) for i, p in enumerate(at)] + [(None, 5, 1, 2), (None, 900, 3, 4)]
    return rows, spark.createDataFrame(rows, "seq long, pos long, x long, y long").repartition(5)


@pytest.mark.parametrize("width", [7, 300, 1 << 18])
def test_running(spark, width):
    rows, df = table(spark)
    got = ranges.running(df, ["seq"], "pos", upto={"s": "x"}, before={"b": "x"}, top={"t": "y"}, top_upto={"u": "y"}, last={"was": "y"}, following="to", width=width)
    assert got.columns == ["seq", "pos", "x", "y", "s", "b", "t", "u", "was", "to"]
    want = []
    for seq in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == seq)
        for i, r in enumerate(own):
            xs, ys = [q[2] for q in own[:i]], [q[3] for q in own[:i]]
            want.append((*r, sum(xs) + r[2], sum(xs), max(ys, default=None), max([*ys, r[3]]), ys[-1] if ys else None, own[i + 1][1] if i + 1 < len(own) else None))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_one_sequence_is_many_groups(spark):
    df = spark.range(10_000).select((F.col("id") % 1).alias("seq"), F.col("id").alias("beg"), (F.col("id") + 3).alias("end"))
    plan = intervals.coverage(df)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and all("__bin" in x for x in windows)  # by range, or over the ranges' sums
    binned = df.withColumn("bin", ranges.bin_of("beg", 64))
    assert binned.groupBy("bin").count().agg(F.max("count")).first()[0] == 64


@pytest.mark.parametrize("width", [3, 50])
def test_interval_operators_do_not_depend_on_the_width(spark, monkeypatch, width):
    rng = random.Random(2)
    ivals = [(rng.choice([1, 1, 1, 2]), b, b + rng.randint(1, 40)) for b in (rng.randint(0, 600) for _ in range(150))]
    df = spark.createDataFrame(ivals, "seq long, beg long, end long")
    seqs = spark.createDataFrame([(1, 700), (2, 700), (3, 90)], "seq long, len long")
    both = lambda: [sorted(map(tuple, x.collect())) for x in (intervals.coverage(df, seqs), intervals.merge_ranges(df, 2), intervals.coalesced(intervals.coverage(df)), intervals.measures(df), intervals.coverage_change(df.where("beg % 2 = 0"), df.where("beg % 2 = 1"), 3), intervals.step_sum(intervals.coverage(df), intervals.coverage(df), F.lit(9), F.lit(2000)))]
    whole = both()
    monkeypatch.setattr(ranges, "WIDTH", width)
    assert both() == whole
    cover = np.zeros((3, 700), int)
    for s, b, e in ivals:
        cover[s, b : min(e, 700)] += 1
    for s, b, e, c in whole[0]:
        assert s == 3 or (cover[s, b : min(e, 700)] == c).all()
    parts = spark.createDataFrame([(o, p, k, p, 0, p % 9, False, 10) for o in (1, 2) for p in range(0, 300, 7) for k in ["W" if p % 3 else "N"]], "object long, part long, kind string, comp long, x long, y long, rev boolean, gap long")
    a, b = 0, 0
    want = {}
    for p in range(0, 300, 7):
        if p % 3:
            want[p] = (a, b)
            a, b = a + p % 9, b + p % 9
        else:
            b += 10
    got = layout.offsets(parts).collect()
    assert all((r.a, r.b) == want[r.part] for r in got) and len(got) == 2 * len(want)


@pytest.mark.parametrize("n", [1, 2, 5, 64])
def test_ranks(spark, n):
    rng = random.Random(n)
    values = [round(rng.gauss(0, 1), 1) for _ in range(900)] + [None] * 3
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    held = sorted(v for v in values if v is not None)
    for r in ranges.counted(df, "x", n).collect():
        assert (r.n, r.upto_n, r.all_n) == (held.count(r.v), sum(v <= r.v for v in held), 900)
    whole = df.agg(*(F.percentile("x", F.lit(q)).alias(f"q{i}") for i, q in enumerate((0.0, 0.123, 0.5, 0.98, 1.0)))).first()
    assert [ranges.median(df, "x", "m", q).first()[0] for q in (0.0, 0.123, 0.5, 0.98, 1.0)] == list(whole)


def test_ranks_of_nothing_and_of_one_value(spark):
    none = spark.createDataFrame([], "x double")
    assert ranges.counted(none, "x").count() == 0 and ranges.median(none, "x", "m").first()[0] is None
    assert stats.significant(none, "x", F.lit(0.1)).count() == 0
    same = spark.createDataFrame([(4.0,)] * 50, "x double")
    assert tuple(ranges.counted(same, "x").first()) == (4.0, 50, 50, 50)


def test_significant_by_loop(spark):
    rng = random.Random(9)
    p = [round(rng.random() ** 3, 4) for _ in range(500)]
    order = sorted(p)
    cut = max((v for i, v in enumerate(order, 1) if v * len(p) <= i * 0.05), default=-1)
    df = spark.createDataFrame([(v,) for v in p], "p double")
    assert sorted(r.p for r in stats.significant(df, "p", F.lit(0.05)).collect()) == [v for v in order if v <= cut]
