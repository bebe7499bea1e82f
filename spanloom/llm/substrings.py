"""Removal of long passages that an earlier document holds (op3), by a compacted de Bruijn graph.

The graph's edges are the passages' windows of `length` words. A window's anchor is its least k-mer by hash, so equal windows have equal
anchors, and neighbouring windows of one anchor are one run: the scan emits runs, some 4% as many as windows. Then:

1. Anchors found in one document only are dropped by a join; what is left, the repeated part of the graph, is checkpointed.
2. Equal runs are one node, with its least document, its number and its first place in the source. A join finds the nodes whose every
   occurrence follows the same node, which occurs as often: such nonbranching paths become one long span, in the source coordinates of the
   first occurrence, where a window over the first document numbers them. Runs are equal if 62 bits of a hash of their words modulo a prime
   and their anchors are.
3. Where one anchor has several runs, the runs' windows are read at their source coordinates and compared one by one, by 128 bits: this
   finds windows that runs with different edges share.
4. Every occurrence of a span in a later document marks its words there; the marks are joined to the texts, which are cut.

Joins are by anchor, run or text, whose hot keys Spark splits; sums by hot keys are formed before the shuffle. No list grows with
anything but one document. Windows are judged on the input. Rows that share doc_id are one document: they never remove each other's
words. A null doc_id is neither earlier nor later. Null and empty texts, and texts below `length` words, lose nothing. Texts of any length are
read whole, in slices of many texts or one long one. An empty table gives no rows. `dedup` gives the key, its counts and the carried columns;
`cut_repeats` gives all columns of its input, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.base import buffers, chunks, cut, strings, table
from spanloom.llm.words import P1, P2, P3, Words, covered, mix, prefix, span_hash, windows

_PLACE = np.uint64((1 << 28) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def runs(body: np.ndarray, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Of every run of windows with one anchor: text, first window (in the text), number of windows, anchor, hash, hash of the run that follows."""
    w = Words(body, off)
    none = np.zeros(0, np.int64)
    if len(w) < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64)
    h = w.hashes()
    sums = prefix(h, P2)
    at = np.arange(len(h) - k + 1)
    mer = span_hash(sums, at, at + k, P2)
    least = sliding_min((mer & ~_PLACE) | at.astype(np.uint64), length - k + 1)
    start, doc = windows(w.first, length)
    anchor = (least[start] & _PLACE).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(start)))
    lo, text = start[head], doc[head]
    content = span_hash(prefix(h, P3), lo, lo + n + length - 1, P3)
    after = np.zeros(len(head), np.uint64)
    after[:-1] = np.where(text[1:] == text[:-1], content[1:], 0)
    return text, lo - w.first[text], n, mer[anchor[head]], content, after


def run_table(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(doc_id, row, a, n, anchor, content, after) of every run of every text."""
    names = ["doc_id", "row", "a", "n", "anchor", "content", "after"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, body, off in chunks(b, "text"):
                text, a, n, *hashes = runs(body, off, length, k)
                pick = pa.array(text)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pick), part.column(1).take(pick), pa.array(a.astype(np.int32)), pa.array(n.astype(np.int32)), *[pa.array(x.view(np.int64)) for x in hashes]], names=names)

    return docs.mapInArrow(emit, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, a int, n int, anchor long, content long, after long")


def window_table(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(h1, h2, content, anchor, j, least) of each window of the wanted runs, read at their source coordinates. wanted: row, a, n, content, anchor, least."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("a", "n", "content", "anchor", "least")).alias("spans"))
    kind = wanted.schema["least"].dataType.simpleString()
    names = ["h1", "h2", "content", "anchor", "j", "least"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, body, off in chunks(b.select(["text", "spans"]), "text"):
                spans = part.column(1)
                w, flat = Words(body, off), spans.flatten()
                a, n = (flat.field(i).to_numpy() for i in (0, 1))
                text = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
                which = np.repeat(np.arange(len(a)), n)
                j = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                lo = w.first[text][which] + a[which] + j
                h = w.hashes()
                one, two = (span_hash(prefix(h, p), lo, lo + length, p) for p in (P1, P2))
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(mix(two).view(np.int64)), *[flat.field(i).take(pa.array(which)) for i in (2, 3)], pa.array(j.astype(np.int32)), flat.field(4).take(pa.array(which))], names=names)

    return docs.join(lists.hint("merge"), "row").select("row", "doc_id", "text", "spans").mapInArrow(emit, f"h1 long, h2 long, content long, anchor long, j int, least {kind}")


def repeated_spans(keyed: DataFrame, length: int = 50, k: int = 8) -> DataFrame:
    """(row, a, n): n windows of a text, from its word a on, that an earlier document holds. keyed: doc_id, row, text."""
    every = run_table(keyed, length, k)
    often = every.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min("content") < F.max("content")).alias("several")).where("lo < hi").select("anchor", "several")
    # as a table of its own, so that both sides of the join are plain exchanges and Spark can split a hot anchor
    found = cut(every.join(cut(often), "anchor"))
    nodes = found.groupBy("content", "anchor").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("times"), F.min(F.struct("doc_id", "row", "a")).alias("first"),
        F.first("n").alias("n"), F.min("after").alias("after"), F.max("after").alias("after2"), F.first("several").alias("several"),
    )
    nodes = cut(nodes.select("content", "anchor", "least", "most", "times", "n", "several", F.col("first.row").alias("row"), F.col("first.a").alias("a"), F.when(F.col("after") == F.col("after2"), F.col("after")).alias("after")))
    # nonbranching paths, in the source coordinates of their first occurrence: a join brings each run the one that it always follows
    shared = nodes.where("least < most")
    before = shared.where("after is not null").select(F.col("after").alias("content"), "row", "times", "least", (F.col("a") + F.col("n")).alias("a"), F.lit(0).alias("goes_on"))
    joined = shared.join(before.distinct(), ["content", "row", "times", "least", "a"], "left").withColumn("head", F.coalesce("goes_on", F.lit(1)))
    order = W.partitionBy("row").orderBy("a", "content").rowsBetween(W.unboundedPreceding, W.currentRow)
    paths = joined.withColumn("path", F.sum("head").over(order))
    spans = paths.groupBy("row", "path").agg(F.min(F.struct("a", "content", "anchor", "least")).alias("h"), F.sum("n").cast("int").alias("total"))
    spans = spans.select("h.content", "h.anchor", "h.least", "total")
    later = found.join(spans, ["content", "anchor"]).where("doc_id > least").select("row", "a", F.col("total").alias("n"))
    # windows that runs with one anchor and different edges share: they matter to the runs' first documents only
    wanted = nodes.where("several").select("row", "a", "n", "content", "anchor", "least")
    each = window_table(keyed, wanted, length)
    best = each.groupBy("h1", "h2").agg(F.min("least").alias("lo"), F.max("least").alias("hi")).where("lo < hi").select("h1", "h2", "lo")
    better = each.join(best, ["h1", "h2"]).where("least > lo").select("content", "anchor", "j", "least", "lo")
    edges = found.join(better, ["content", "anchor"]).where("doc_id = least").select("row", (F.col("a") + F.col("j")).alias("a"), F.lit(1).alias("n"))
    return later.unionByName(edges)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, k: int = 8, carry: list[str] | None = None, whole: bool = False) -> DataFrame:
    """(key, n_words, n_removed, kept, carried columns) of each row; kept: the words that are left, joined by one space (whole: the text itself if it loses nothing)."""
    more = carry or []
    keyed = docs.select(F.col(key).alias("doc_id"), F.xxhash64(key, text).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = repeated_spans(keyed, length, k)
    marks = spans.distinct().groupBy("row").agg(F.collect_list(F.struct("a", "n")).alias("spans"))
    if more:
        keyed = docs.select(F.col(key).alias("doc_id"), F.xxhash64(key, text).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"), *more)
    out = ["doc_id", "n_words", "n_removed", "kept", *more]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, body, off in chunks(b, "text"):
                w, spans = Words(body, off), part.column(part.schema.get_field_index("spans"))
                flat, size = spans.flatten(), np.diff(spans.offsets.to_numpy())
                size = np.where(spans.is_null().to_numpy(False), 0, size)
                which = np.repeat(np.arange(len(size)), size)
                a, n = (flat.field(i).to_numpy() for i in (0, 1))
                gone = covered(w.first[which] + a, n + length - 1, len(w))
                removed = np.bincount(w.doc()[gone], minlength=part.num_rows)
                kept = []
                for i, t in enumerate(strings(part, "text")):
                    if whole and not removed[i]:
                        kept.append(t.as_py().encode())
                        continue
                    parts = t.as_py().encode().split()
                    if removed[i]:
                        parts = compress(parts, ~gone[w.first[i] : w.first[i + 1]])
                    kept.append(b" ".join(parts))
                col = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w.counts), pa.array(removed), col, *[part.column(part.schema.get_field_index(c)) for c in more]], names=out)

    kinds = [f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string", *[f"`{c}` {keyed.schema[c].dataType.simpleString()}" for c in more]]
    joined = keyed.join(marks.hint("merge"), "row", "left").select("doc_id", "text", "spans", *more)
    return joined.mapInArrow(emit, ", ".join(kinds)).withColumnRenamed("doc_id", key)


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, k: int = 8) -> DataFrame:
    """The rows of `docs` with all their columns, and texts without what an earlier document holds; a text that loses nothing stays as it is."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (key, text)], F.lit(0).alias("_"))
    out = dedup(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), rest.alias("rest")), "key", "text", length, k, carry=["rest"], whole=True)
    return out.select(*[F.col("key").alias(c) if c == key else F.col("kept").alias(c) if c == text else F.col(f"rest.`{c}`") for c in docs.columns])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], length: int = 50) -> list[tuple[int, int, int, str]]:
    """What op3 returns, by a dictionary of all windows."""
    words = [(d, (t or "").encode().split()) for d, t in rows]
    least: dict[tuple, int] = {}
    for d, w in words:
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            least[key] = min(d, least.get(key, d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if least[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out
