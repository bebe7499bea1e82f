"""What the operators share: reading tables, checkpoints, Arrow columns."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters outside space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a checkpoint in the folder that the cluster names.

    Only on a local master (tests) a temporary folder is used where spark.checkpoint.dir is unset.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spanloom-checkpoint-"))
    return df.checkpoint()


def unused(df: DataFrame, name: str) -> str:
    """`name`, with as many signs before it as it takes to clash with no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    """Words of a text as a long, computed in the JVM; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def strings(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column of a batch, null as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col, "") if col.null_count else col


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the offsets of its values, without a copy."""
    wide = pa.types.is_large_string(col.type)
    raw = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)
    off = raw[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, name: str, limit: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch whose texts hold about `limit` bytes (one longer text is a slice of its own), each with its bytes and offsets."""
    if not batch.num_rows:
        return
    col = strings(batch, name)
    body, off = buffers(col)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, batch.num_rows)
        yield batch.slice(lo, hi - lo), body[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
    pa.default_memory_pool().release_unused()  # else a worker keeps what its largest batch took
