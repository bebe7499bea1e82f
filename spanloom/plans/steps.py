"""Resumable steps: each writes a table and is passed over where its table is complete and was made with the same parameters."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Step:
    name: str
    make: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    parameters: dict = field(default_factory=dict)
    applies: Callable[[], bool] = lambda: True


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def run_steps(spark: SparkSession, steps: list[Step], folder: str, force: bool = False, from_step: str | None = None) -> dict[str, DataFrame]:
    """The steps' tables by name. `from_step` makes that step and all after it again."""
    tables: dict[str, DataFrame] = {}
    known = {s.name for s in steps}
    for s in steps:
        if missing := set(s.needs) - known:
            raise ValueError(f"{s.name} needs unknown steps: {sorted(missing)}")
    again = force
    for s in steps:
        if not s.applies():
            continue
        again = again or s.name == from_step
        path, note = f"{folder}/{s.name}.parquet", f"{folder}/{s.name}.parameters"
        said = json.dumps(s.parameters, sort_keys=True)
        same = _exists(spark, f"{path}/_SUCCESS") and _exists(spark, note) and spark.read.text(note, wholetext=True).first().value.strip() == said
        if again or not same:
            s.make(spark, {n: tables[n] for n in s.needs}).write.mode("overwrite").parquet(path)
            spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(note)
            again = again or not same and any(s.name in t.needs for t in steps)
        tables[s.name] = spark.read.parquet(path)
    return tables


def copy_number_steps(alignments: Callable[[SparkSession], DataFrame], sequences: Callable[[SparkSession], DataFrame]) -> list[Step]:
    """Alignments to overlaps, coverage, histogram and copy number."""
    from pyspark.sql import functions as F

    from spanloom.operators import chaining, intervals, stats

    def overlaps(spark: SparkSession, _: dict) -> DataFrame:
        return chaining.symmetric(chaining.overlaps(alignments(spark), sequences(spark)))

    def steps(spark: SparkSession, t: dict) -> DataFrame:
        o = t["overlaps"].where("qual >= 0.7").select(F.col("aread").alias("seq"), F.col("abpos").alias("beg"), F.col("aepos").alias("end"))
        return intervals.coverage(o, sequences(spark))

    return [
        Step("overlaps", overlaps),
        Step("coverage", steps, ("overlaps",)),
        Step("histogram", lambda spark, t: stats.coverage_histogram(t["coverage"]), ("coverage",)),
        Step("ploidy", lambda spark, t: stats.copy_number(t["histogram"]), ("histogram",)),
    ]
