"""Fingerprints of documents by invertible Bloom lookup sketches of their paragraphs (op13).

A paragraph is a line, or a part of one: lines are also cut where a rolling hash of 16 bytes says so (every 64 bytes or so, never within a
character), so that texts without line breaks have paragraphs too and an edit changes those it touches alone. Each has a digest of 64 bits, with
its occurrence in it, so that repeated paragraphs count. A sketch has cells in three parts; a digest is added to a cell of each part: a
count, sums of digests, of check sums and of lengths, all modulo powers of two. A fingerprint is a text's sketch of `cells` cells as base64.

Sketches of two versions are subtracted, which leaves the paragraphs that differ. A cell that holds one of them (its check sum says so) gives it
back; taken out of its other cells it frees more, until all cells are empty: the differing digests are recovered, with the side they
are from. If cells are left over, both versions are sketched again with four times as many cells
or more, as the counts suggest, until it succeeds. The likeness of two versions is
the share of their code points that lies in paragraphs of both: 1 - changed / (code points of both); of two empty texts it is 1.

Null texts count as empty and an empty table gives no rows. Equal texts have equal fingerprints, also of repeated rows. Texts may be of any length:
memory grows with one text's bytes and its paragraphs, some tens of bytes each. Any columns that are not named are carried along as they are.

The next document of each is found by ranges of keys (`with_next`): null keys come last, rows of one key by the hash of their text, and the last
document's next is the first. Ranges are bounded by draws weighted by size; the driver holds the draws and one row a range.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.base import table, unused

BITS = 6  # a cut every 2 ** BITS bytes
CELLS = 24
CELL = np.dtype([("count", "<i4"), ("sum", "<u8"), ("check", "<u8"), ("size", "<i8")])  # as written


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of each value and the seed, by multiplications and shifts."""
    x = (x + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = (mixed(np.arange(256, dtype=np.uint64), 1) >> np.uint64(32)).astype(np.uint32)


def ends(body: np.ndarray, at: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Where the paragraphs of UTF-8 texts end; at: where each text begins, and the last one's end. Begins are line breaks or 16 bytes from the text's at least."""
    found = []
    for lo in range(0, len(body), block):
        before = min(lo, 15)
        part = body[lo - before : lo + block]
        h = _BYTE[part]
        for step in (1, 2, 4, 8):
            more = h.copy()
            more[step:] += h[:-step] << np.uint32(step)
            h = more
        hit = (h >> np.uint32(32 - BITS) == 0) | (part == 10)
        follow = body[lo - before + 1 : lo + block + 1]
        hit[: len(follow)] &= (follow & 0xC0) != 0x80
        found.append(np.flatnonzero(hit[before:]) + lo + 1)
    out = np.concatenate(found) if found else np.zeros(0, np.int64)
    early = out - at[np.searchsorted(at, out, "left") - 1] < 16
    out = np.sort(np.concatenate([out[~early | (body[out - 1] == 10)], at[1:]]))
    return out[np.append(True, out[1:] != out[:-1]) & (out > 0)] if len(out) else out


def paragraphs(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Digests of each text's paragraphs, by occurrence, and their code points."""
    raw = [t.encode() for t in texts]
    at = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    whole = b"".join(raw)
    body = np.frombuffer(whole, np.uint8)
    end = ends(body, at)
    begin = np.append(0, end[:-1])[: len(end)]
    of = xxhash.xxh3_64_intdigest
    digest = np.array([of(whole[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.uint64)
    size = np.add.reduceat((body & 0xC0) != 0x80, begin, dtype=np.int64) if len(end) else begin
    text = np.searchsorted(at[1:], begin, "right")
    order = np.lexsort((digest, text))
    same = (digest[order][1:] == digest[order][:-1]) & (text[order][1:] == text[order][:-1])
    if same.any():
        first = np.flatnonzero(np.append(True, ~same))
        nth = np.empty(len(digest), np.uint64)
        nth[order] = (np.arange(len(digest)) - np.repeat(first, np.diff(np.append(first, len(digest))))).astype(np.uint64)
        digest = np.where(nth > 0, mixed(digest + nth, 2), digest)
    bound = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
    return [(digest[a:b], size[a:b]) for a, b in zip(bound[:-1], bound[1:], strict=True)]


def check_sum(digest: np.ndarray) -> np.ndarray:
    return mixed(digest, 5)


class Sketches:
    """Sketches of `cells` cells each of several texts, a row a text."""

    def __init__(self, rows: int, cells: int):
        self.cells = max(3, cells - cells % 3)
        self.rows = rows
        self.count, self.size = np.zeros(rows * self.cells, np.int64), np.zeros(rows * self.cells, np.int64)
        self.sum, self.check = np.zeros(rows * self.cells, np.uint64), np.zeros(rows * self.cells, np.uint64)

    def places(self, digest: np.ndarray) -> np.ndarray:
        part = self.cells // 3
        return np.stack([(mixed(digest, 3 + j + self.cells) % np.uint64(part)).astype(np.int64) + j * part for j in range(3)])

    def add(self, row: np.ndarray, digest: np.ndarray, size: np.ndarray, side: np.ndarray | None = None) -> None:
        to = (self.places(digest) + row * self.cells).ravel()
        count, check = np.ones(len(digest), np.int64), check_sum(digest)
        if side is not None:
            count, size, sign = side, size * side, side.astype(np.uint64)
            digest, check = digest * sign, check * sign
        for cells, value in ((self.count, count), (self.sum, digest), (self.check, check), (self.size, size)):
            np.add.at(cells, to, np.tile(value, 3))

    @classmethod
    def of(cls, texts: list[tuple[np.ndarray, np.ndarray]], cells: int) -> Sketches:
        out = cls(len(texts), cells)
        row = np.repeat(np.arange(len(texts)), [len(d) for d, _ in texts])
        if len(row):
            out.add(row, np.concatenate([d for d, _ in texts]), np.concatenate([s for _, s in texts]))
        return out

    def minus(self, other: Sketches) -> Sketches:
        """This less the other, in place."""
        self.count -= other.count
        self.sum -= other.sum
        self.check -= other.check
        self.size -= other.size
        return self

    def differ(self) -> np.ndarray:
        """About how many digests each row holds: a digest of either side adds 1 to the squared count of 3 cells, and others cancel out."""
        return (self.count.reshape(self.rows, -1) ** 2).sum(axis=1) / 3

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, digest, length and side (1 or -1) of each paragraph that comes out; and which rows are empty then. The cells are used up."""
        found = []
        live = np.flatnonzero(np.abs(self.count) == 1)
        while len(live):
            side = self.count[live]
            digest, check = self.sum[live] * side.astype(np.uint64), self.check[live] * side.astype(np.uint64)
            pure = check == check_sum(digest)
            live, digest, side = live[pure], digest[pure], side[pure]
            size, row = self.size[live] * side, live // self.cells
            right = (self.places(digest) + row * self.cells == live).any(axis=0)  # else it is in this cell by chance
            row, digest, size, side = row[right], digest[right], size[right], side[right]
            order = np.lexsort((digest, row))
            once = order[np.append(True, (np.diff(row[order]) != 0) | (digest[order][1:] != digest[order][:-1]))] if len(order) else order
            row, digest, size, side = row[once], digest[once], size[once], side[once]
            if not len(row):
                break
            found.append((row, digest, size, side))
            self.add(row, digest, size, -side)
            near = np.sort((self.places(digest) + row * self.cells).ravel())
            near = near[np.append(True, near[1:] != near[:-1])]
            live = near[np.abs(self.count[near]) == 1]
        full = (self.count != 0) | (self.sum != 0) | (self.check != 0)
        done = ~full.reshape(self.rows, -1).any(axis=1)
        if not found:
            none = np.zeros(0, np.int64)
            return none, none.astype(np.uint64), none, none, done
        return *(np.concatenate(x) for x in zip(*found, strict=True)), done

    def text(self, row: int) -> str:
        part = slice(row * self.cells, (row + 1) * self.cells)
        out = np.empty(self.cells, CELL)
        for name, cells in (("count", self.count), ("sum", self.sum), ("check", self.check), ("size", self.size)):
            out[name] = cells[part].astype(CELL[name], casting="unsafe")
        return base64.b64encode(out.tobytes()).decode()

    @classmethod
    def read(cls, text: str) -> Sketches:
        cells = np.frombuffer(base64.b64decode(text), CELL)
        out = cls(1, len(cells))
        out.count, out.sum, out.check, out.size = cells["count"].astype(np.int64), cells["sum"].astype(np.uint64), cells["check"].astype(np.uint64), cells["size"].astype(np.int64)
        return out


def differing(one: list[tuple[np.ndarray, np.ndarray]], other: list[tuple[np.ndarray, np.ndarray]], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of each pair of texts (their paragraphs): digests, lengths and sides of those that differ, and the cells it took."""
    out: list = [None] * len(one)
    todo = {cells: np.arange(len(one))}
    while todo:
        cells = min(todo)
        left = todo.pop(cells)
        diff = Sketches.of([one[i] for i in left], cells).minus(Sketches.of([other[i] for i in left], cells))
        about = diff.differ()
        row, digest, size, side, done = diff.peel()
        order = np.argsort(row, kind="stable")
        bound = np.searchsorted(row[order], np.arange(len(left) + 1))
        for k in np.flatnonzero(done).tolist():
            part = order[bound[k] : bound[k + 1]]
            out[left[k]] = digest[part], size[part], side[part], diff.cells
        for k in np.flatnonzero(~done).tolist():
            larger = cells * 4
            while larger < 1.5 * about[k]:
                larger *= 2
            todo.setdefault(larger, []).append(left[k])
    return out


def likeness(one: str, other: str, n_one: int, n_other: int) -> float | None:
    """The likeness of two texts of `n_one` and `n_other` code points by their fingerprints alone; None if they have too few cells for it."""
    diff = Sketches.read(one).minus(Sketches.read(other))
    _, _, size, _, done = diff.peel()
    return share(int(size.sum()), n_one + n_other) if done[0] else None


def share(changed: int, both: int) -> float:
    return 1 - changed / both if both else 1.0


def grouped(sizes: list[int], limit: int = 1 << 20) -> Iterator[slice]:
    """Slices of rows whose texts have about `limit` bytes."""
    lo = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield slice(lo, i)
            lo, held = i, 0
        held += n
    if sizes:
        yield slice(lo, len(sizes))


def compared(rows: DataFrame, text: str, others: dict[str, str], cells: int = CELLS, changes: bool = False) -> DataFrame:
    """`rows` with `fingerprint` and `n_chars` of `text`; and by `others` (name: column), `fingerprint_<name>`, `near_<name>` (the likeness to
    that column's text) and, if asked for, `changed_<name>`: the paragraphs that differ (digest as hex, side 1 if in `text` only, else -1, n_chars).

    A column that was there under one of these names is replaced.
    """
    made = {"fingerprint": "string", "n_chars": "long"}
    for name in others:
        made |= {f"fingerprint_{name}": "string", f"near_{name}": "double"}
        made |= {f"changed_{name}": "array<struct<digest:string,side:int,n_chars:long>>"} if changes else {}
    keep = [c for c in rows.columns if c.lower() not in made or c in (text, *others.values())]
    apart = [c for c in keep if c.lower() not in made]
    first = unused(rows, "text_0")
    names = {c: unused(rows, f"text_{i + 1}") for i, c in enumerate(others.values())}
    asked = rows.select(*apart, F.coalesce(F.col(text), F.lit("")).alias(first), *(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in names.items()))
    kinds = pa.list_(pa.struct([("digest", pa.string()), ("side", pa.int32()), ("n_chars", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(b.schema.get_field_index(first))
            rest = {n: b.column(b.schema.get_field_index(c)) for n, c in zip(others, names.values(), strict=True)}
            for part in grouped(pc.binary_length(own).to_pylist()):
                place: dict[str, int] = {}  # the next document's text comes again as its own
                placed = lambda x: [place.setdefault(t, len(place)) for t in x[part].to_pylist()]  # noqa: B023, E731
                own_at, rest_at = placed(own), {n: placed(x) for n, x in rest.items()}
                every = paragraphs(list(place))
                mine, theirs = [every[i] for i in own_at], {n: [every[i] for i in x] for n, x in rest_at.items()}
                sketch = Sketches.of(mine, cells)
                cols: list = [[sketch.text(i) for i in range(len(mine))], [int(s.sum()) for _, s in mine]]
                for n in rest:
                    sketch = Sketches.of(theirs[n], cells)
                    found = differing(mine, theirs[n], cells)
                    cols.append([sketch.text(i) for i in range(len(mine))])
                    cols.append([share(int(f[1].sum()), int(a[1].sum() + o[1].sum())) for f, a, o in zip(found, mine, theirs[n], strict=True)])
                    if not changes:
                        continue
                    flat = pa.StructArray.from_arrays([pa.array([f"{d:016x}" for f in found for d in f[0].tolist()], pa.string()), pa.array(np.concatenate([f[2] for f in found]).astype(np.int32)), pa.array(np.concatenate([f[1] for f in found]))], fields=list(kinds.value_type))
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(f[0]) for f in found])).astype(np.int32)), flat))
                kept = b.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in range(len(apart))), *(c if isinstance(c, pa.Array) else pa.array(c) for c in cols)], names=[*apart, *made])
                del place, every, mine, theirs
            pa.default_memory_pool().release_unused()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.select(*apart).schema), *(f"`{c}` {t}" for c, t in made.items())])
    return asked.mapInArrow(run, schema)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "next", range_bytes: int = 1 << 22, draws: int = 16) -> DataFrame:
    """(key, text, next): each document with the text of the one after it in the order of keys; the last with the first's."""
    named = docs.select(F.col(key).isNull().alias("k0"), F.col(key).alias("k1"), F.xxhash64(text).alias("k2"), F.col(text).alias("t"))
    order = ["k0", "k1", "k2"]
    size = F.coalesce(F.octet_length("t"), F.lit(0)) + F.lit(64)
    total = named.agg(F.sum(size)).first()[0] or 0
    ranges = int(min(max(1, -(-total // range_bytes)), 20_000))
    odds = F.pmod(F.xxhash64(*order, F.lit(11)), F.lit(1 << 30)) / float(1 << 30) < size * (float(ranges * draws) / max(total, 1))
    drawn = sorted(tuple(x) for x in named.where(odds).select(*order).collect()) if ranges > 1 else []
    null_last = lambda x: (x[0], 0 if x[0] else x[1], x[2])
    drawn = sorted(map(null_last, drawn))
    bounds = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []

    @F.arrow_udf("int")
    def at(k0: pa.Array, k1: pa.Array, k2: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds, null_last(x)) for x in zip(k0.to_pylist(), k1.to_pylist(), k2.to_pylist(), strict=True)], pa.int32())

    ranged = named.withColumn("at", at(*order))
    heads = ranged.groupBy("at").agg(F.min(F.struct(*order)).alias("head")).orderBy("at")  # a row a range
    edges = [(r["at"], *r["head"]) for r in heads.collect()]
    edges = [(*e, edges[i - 1][0]) for i, e in enumerate(edges)]  # the range before it, of those with rows
    kind = named.schema["k1"].dataType.simpleString()
    edge = docs.sparkSession.createDataFrame(edges, f"at int, h0 boolean, h1 {kind}, h2 long, before int")
    is_head = (F.col("k0") == F.col("h0")) & F.col("k1").eqNullSafe(F.col("h1")) & (F.col("k2") == F.col("h2"))
    own, copy = F.struct(F.col("at").alias("to"), F.lit(False).alias("copy")), F.struct(F.col("before").alias("to"), F.lit(True).alias("copy"))
    dealt = ranged.join(F.broadcast(edge), "at").select(*order, "t", F.inline(F.when(is_head, F.array(own, copy)).otherwise(F.array(own))))
    onward = F.lead("t").over(W.partitionBy("to").orderBy("copy", *order))
    return dealt.repartition(max(1, len(edges)), "to").withColumn("n", onward).where(~F.col("copy")).select(F.col("k1").alias(key), F.col("t").alias(text), F.col("n").alias(name))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against its edited text, whose last quarter is the beginning of the next document, and against that document."""
    docs = with_next(table(spark, sf_dir, "documents"))
    n, own, onward = F.length("text"), F.coalesce("text", F.lit("")), F.coalesce("next", F.lit(""))
    cut = F.coalesce(F.floor(n / 4), F.lit(0)).cast("int")
    edited = F.concat(F.substr(own, F.lit(1), F.length(own) - cut), F.substr(onward, F.lit(1), cut))
    found = compared(docs.withColumn("edited", edited), "text", {"edited": "edited", "next": "next"})
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", F.col("fingerprint_edited").alias("edited_fingerprint"), "near_edited", "near_next")
