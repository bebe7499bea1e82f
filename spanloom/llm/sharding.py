"""Shards of near-equal bytes by sampled splitters (op5).

The key is one long: the text's hash above the row's hash, so equal texts lie side by side and a large group of them can still be cut.
Keys are drawn with a chance in proportion to their rows' sizes, the draws' quantiles bound key ranges, and every range is summed;
ranges that turn out overfull are divided by draws of their own until none is. Consecutive ranges make up a shard. The driver holds
the draws and a sum per range: `ranges` times `draws` longs at most, whatever the input's size. A range of rows that are all equal in key
and text cannot be divided by keys; its rows have one size and are divided by number.

Sizes are the text's UTF-8 bytes plus 1 (null: 1). Rows are numbered within a shard without gaps: an offset by range, and a row number in
the range, by key. Shards and slots depend on the rows alone, not on how the scan was split; rows that are equal in key and text are
interchangeable. Texts of any length are one row; an empty table gives no
rows; other columns are carried along as asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.base import cut, table


def range_key(text: Column, key: Column) -> Column:
    """36 bits of the text's hash, 28 of the key's."""
    high = F.shiftrightunsigned(F.xxhash64(text), 28)
    return F.shiftleft(high, 28).bitwiseOR(F.shiftrightunsigned(F.xxhash64(key, F.lit(7)), 36))


def drawn(keyed: DataFrame, bounds: np.ndarray, want: dict[int, tuple[int, int]]) -> dict[int, np.ndarray]:
    """Keys drawn from some ranges by size, sorted; want: by range the number of draws and the range's bytes."""
    odds = np.zeros(len(bounds) + 1)
    for r, (n, total) in want.items():
        odds[r] = n / max(total, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, size = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("range_key", "size"))
            r = np.searchsorted(bounds, key, "right")
            uniform = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) / (1 << 53)
            hit = uniform < size * odds[r]
            yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(r[hit], pa.int64())], names=["range_key", "range_id"])

    got = keyed.select("range_key", "size").mapInArrow(run, "range_key long, range_id long").toPandas()
    return {int(r): np.sort(x.to_numpy()) for r, x in got.groupby("range_id")["range_key"]}


def sums(keyed: DataFrame, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, rows and whether there are several keys, of each range."""
    found = ranged(keyed.select("range_key", "size"), bounds).groupBy("range_id").agg(F.sum("size").alias("size"), F.count("*").alias("n"), (F.min("range_key") < F.max("range_key")).alias("several")).toPandas()
    out = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, bool)
    for to, c in zip(out, ("size", "n", "several"), strict=True):
        to[found["range_id"]] = found[c]
    return out


def ranged(keyed: DataFrame, bounds: np.ndarray) -> DataFrame:
    @F.pandas_udf("int")
    def at(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), "right").astype(np.int32))

    return keyed.withColumn("range_id", at("range_key"))


def splitters(keyed: DataFrame, ranges: int = 1024, draws: int = 16, rounds: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of ranges that hold at most twice their share of the bytes (or one key), with the ranges' bytes and rows, and whether they have several keys."""
    bounds = np.zeros(0, np.int64)
    size, n, several = sums(keyed, bounds)
    share = max(1, int(size.sum()) // ranges)
    for _ in range(rounds):
        over = np.flatnonzero((size > 2 * share) & several)
        if not len(over):
            break
        want = {int(r): (draws * int(-(-size[r] // share)), int(size[r])) for r in over}
        new = [bounds]
        for r, keys in drawn(keyed, bounds, want).items():
            parts = want[r][0] // draws
            chosen = keys[np.arange(1, parts) * len(keys) // parts]
            new += [chosen, chosen[1:][chosen[1:] == chosen[:-1]] + 1]  # a key that is drawn for several bounds gets a range of its own
        bounds = np.unique(np.concatenate(new))
        size, n, several = sums(keyed, bounds)
    return bounds, size, n, several


def pieces(size: np.ndarray, n: np.ndarray, several: np.ndarray, n_shards: int, share: int) -> tuple[np.ndarray, np.ndarray]:
    """The first row (counted over all ranges) and the shard of each piece of the order: a whole range, or what one shard gets of a large range of equal rows."""
    before, rows, total = np.cumsum(size) - size, np.cumsum(n) - n, max(1, int(size.sum()))
    start, shard = [0], [0]
    for r in np.flatnonzero(n):
        if size[r] <= 2 * share or several[r]:
            start.append(int(rows[r]))
            shard.append(min(int(before[r] + size[r] // 2) * n_shards // total, n_shards - 1))
            continue
        each = int(size[r] // n[r])
        for s in range(n_shards):
            i = max(0, -(-(-(-s * total // n_shards) - int(before[r]) - each // 2) // each))
            if i < n[r]:
                start.append(int(rows[r]) + i)
                shard.append(s)
    start, shard = np.array(start), np.array(shard)
    last = np.append(start[1:] != start[:-1], True)  # of pieces that begin at one row
    return start[last], shard[last]


def shards(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, ranges: int = 1024) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row, and the columns to carry along."""

    @F.pandas_udf("long")
    def crc(t: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(x.encode()) for x in t], dtype="int64")

    whole = F.coalesce(F.col(text), F.lit(""))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(64)).cast("int")
    keyed = cut(docs.select(F.col(key), (F.octet_length(whole) + F.lit(1)).cast("long").alias("size"), crc(whole).alias("text_crc32"), range_key(whole, F.col(key)).alias("range_key"), salt.alias("salt"), *(carry or [])))
    bounds, size, n, several = splitters(keyed, ranges)
    rows, total = np.cumsum(n) - n, max(1, int(size.sum()))
    start, shard = pieces(size, n, several, n_shards, max(1, total // ranges))
    first = np.array([start[shard == s].min() if (shard == s).any() else 0 for s in range(n_shards)], np.int64)
    # ranges of equal rows are numbered in 64 parts, so that none is one task's work: parts of a range come one after the other
    large = np.flatnonzero((size > 2 * max(1, total // ranges)) & ~several)
    counts = ranged(keyed.select("range_key", "salt"), bounds).where(F.col("range_id").isin(large.tolist())).groupBy("range_id", "salt").agg(F.count("*").alias("n")).toPandas()
    part = np.zeros((len(n), 64), np.int64)
    part[counts["range_id"], counts["salt"]] = counts["n"]
    ahead = np.cumsum(part, axis=1) - part

    @F.pandas_udf("shard int, slot long")
    def placed(r: pd.Series, salt: pd.Series, row: pd.Series) -> pd.DataFrame:
        at = rows[r] + ahead[r, salt] + row.to_numpy()
        to = shard[np.searchsorted(start, at, "right") - 1]
        return pd.DataFrame({"shard": to.astype(np.int32), "slot": at - first[to]})

    numbered = ranged(keyed, bounds).withColumn("salt", F.when(F.col("range_id").isin(large.tolist()), F.col("salt")).otherwise(0))
    numbered = numbered.withColumn("row", F.row_number().over(W.partitionBy("range_id", "salt").orderBy("range_key", key)).cast("long") - 1)
    return numbered.withColumn("at", placed("range_id", "salt", "row")).select(key, "size", "text_crc32", "at.shard", "at.slot", *(carry or []))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards(table(spark, sf_dir, "documents"))
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
