"""Near duplicates by Order MinHash (op8).

Two texts are near duplicates if 1 - (edit distance in words) / (words of the longer one) is at least `similarity`; classes are closed
over such pairs.

1. Sketches are drawn in the scan, so texts are not shuffled for them. Equal texts are one document from there on, represented by the
   least row hash of the least key. A sketch samples the `size` least occurrence-labelled k-mers of words under one hash function and keeps
   them in text order, so it agrees for two texts as their k-mers and their order do. Each of the `number` sketches is a bucket key of
   its own, and one shared bucket makes a pair a candidate, however large the bucket is.
2. Each document takes along how many of its words fall into each of 64 bins, in 4 bits a bin (and, for what is left after step 3, into
   each of 512). The bins bound the edit distance from below, so a candidate that they rule out is surely none; this is what keeps a
   bucket of texts that share one passage cheap.
3. A bucket is dealt out in parts of about `part` documents. In each part a document is paired with the ones before it that the bins bring
   nearest, so a bucket of n like documents gives some n pairs. The pairs are verified on their words by banded alignment, and closed into
   classes by contraction through joins.
4. Buckets that have pairs left come again, with their parts crossed: only pairs of different classes are taken, each in the first bucket
   that its documents share, first some for each document and then all that are left. So every candidate is verified, or ruled out by its
   bins, or its documents are in one class by others that are verified.

The work on a bucket is linear in its documents where they are near duplicates of each other; for those that are not, it is a
comparison of bins for each pair, in blocks of `part` by `part`, spread over all tasks.

Null texts count as empty. Texts without words are in a class of their own each, whatever the key. Rows that share key and text are one
document, in one class. The class is named by its least key; a null key never names a class with other keys. Texts of any length are
read and aligned whole. An empty table gives no rows. Other columns are not read by `near_classes`; `keep_one` returns all columns of its
input, whatever their names, and of rows that share key and text the one whose columns have the least hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.base import chunks, cut, table, unused
from spanloom.llm.words import P1, P2, P3, Words, mix, prefix, span_hash

BINS, FINE = 64, 512  # bins in a bucket's rows, and for what is left of large buckets


def labelled(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the k-mers of all texts: hash, hash with the k-mer's number among its equals, text; and each text's first k-mer.

    A text with fewer than k words has one k-mer, all its words.
    """
    counts = w.counts
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(doc)) - first[doc] + w.first[doc]
    mer = span_hash(prefix(w.hashes(), P2), start, np.minimum(start + k, w.first[doc + 1]), P2)
    own = mix(mer ^ mix(doc.astype(np.uint64) + P3))
    order = np.argsort(own, kind="stable")
    new = np.ones(len(own), bool)
    new[1:] = own[order][1:] != own[order][:-1]
    at = np.arange(len(own))
    number = np.empty(len(own), np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return mer, mix(mer + number * P1), doc, first


def sketches(w: Words, k: int, size: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have words, and `number` sketches of each."""
    mer, label, doc, first = labelled(w, k)
    texts = np.flatnonzero(np.diff(first))
    heads = first[texts]
    group = np.repeat(np.arange(len(texts)), np.diff(first)[texts])
    out = np.zeros((len(texts), number), np.uint64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for i in range(number):
        value = mix(label ^ mix(np.full(1, i + 1, np.uint64) * P3)[0])
        places = np.full((len(texts), size), len(value), np.int64)
        for j in range(size):
            least = np.minimum.reduceat(value, heads) if len(heads) else value[:0]
            hit = np.flatnonzero((value == least[group]) & (value != top))
            places[group[hit[::-1]], j] = hit[::-1]
            value[places[:, j][places[:, j] < len(value)]] = top
        places.sort(axis=1)
        h = np.zeros(len(texts), np.uint64)
        padded = np.append(mer, np.uint64(0))
        for j in range(size):
            h = mix(h * P1 + padded[places[:, j]] + np.uint64(j + 1))
        out[:, i] = h
    return texts, out


def binned(w: Words, bins: int) -> np.ndarray:
    """How many words of each text fall into each bin, 15 at most, two bins a byte."""
    at = w.doc() * bins + (w.hashes(P3) % np.uint64(bins)).astype(np.int64)
    at, count = np.unique(at, return_counts=True)
    n = np.zeros(bins * (len(w.first) - 1), np.uint8)
    n[at] = np.minimum(count, 15)
    return (n[0::2] | (n[1::2] << 4)).reshape(-1, bins // 2)


def unbinned(packed: np.ndarray) -> np.ndarray:
    out = np.empty((len(packed), 2 * packed.shape[1]), np.uint8)
    out[:, 0::2], out[:, 1::2] = packed & 15, packed >> 4
    return out


def edit_distance(a: list, b: list, limit: int) -> int:
    """Edit distance of two sequences, or limit + 1 if it is above the limit.

    Only a band of the table around its diagonal is filled, a column at a time: the differences between neighbouring cells of a column
    are the bits of two numbers. A narrow band is tried first where the limit is high.
    """
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    n, m = len(a), len(b)
    if n - m > limit:
        return limit + 1
    lead = next((i for i in range(m) if a[i] != b[i]), m)
    tail = next((i for i in range(m - lead) if a[n - 1 - i] != b[m - 1 - i]), m - lead)
    a, b = a[lead : n - tail], b[lead : m - tail]
    n, m = len(a), len(b)
    left: dict = {}
    for w in a:
        left[w] = left.get(w, 0) + 1
    least = n  # words that a has more of: an edit each
    for w in b:
        if left.get(w, 0):
            left[w] -= 1
            least -= 1
    if least > limit:
        return limit + 1
    if not m:
        return n
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | (1 << i)
    for band in sorted({max(least, n - m, limit // 8), limit} if limit > 256 else {limit}):
        found = _banded(places, n, b, band)
        if found <= band:
            return found
    return limit + 1


def _banded(places: dict, n: int, b: list, k: int) -> int:
    """Edit distance of b and the sequence of n words whose places are bits, if it is at most k; else more than k."""
    mask = (1 << (2 * k + 1)) - 1  # bit t of a column j is row j - k + t
    up, down = mask >> k << k, 0
    distance = n - len(b)
    last = k + distance  # of the diagonal that ends in the last cell
    for j, w in enumerate(b):
        same = (places.get(w, 0) << k >> j) & mask
        zero = (((same & up) + up) ^ up) | same | down
        if not zero >> last & 1:
            distance += 1
            if distance > k:
                break
        right, less = down | (mask ^ ((zero | up) & mask)), zero & up
        zero = (zero & mask) >> 1
        up, down = (less | (mask ^ ((zero | right) & mask))) & mask, zero & right
    return distance


def allowed(longer: np.ndarray, similarity: float) -> np.ndarray:
    """The edits that texts may be apart, by the words of the longer one."""
    return np.floor((1 - similarity) * longer + 1e-9)


def alike(a: list, b: list, similarity: float) -> bool:
    """Whether two lists of words are near duplicates; the words themselves are compared."""
    limit = int(allowed(max(len(a), len(b)), similarity))
    return edit_distance(a, b, limit) <= limit


def least_edits(bins: np.ndarray, total: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A lower bound of the edit distance of documents i and j, by their bins (total: their sums) and numbers of words.

    Each word that a bin has more of in one text is an edit at least, and so is each word that a text is longer by.
    """
    common = np.minimum(bins[i], bins[j]).sum(axis=-1, dtype=np.int32)
    return np.maximum(np.maximum(total[i], total[j]) - common, np.abs(size[i] - size[j]))


class Cells:
    """The rows of some cells, sorted by cell, side and id. keys: of all sketches, where a pair is to be taken in its first shared bucket only; slot: the sketch of the row's bucket."""

    def __init__(self, t: pa.Table):
        self.cell, self.bucket, self.ids, self.label, self.side, self.size, self.slot = (t.column(c).to_numpy() for c in ("cell", "bucket", "id", "label", "side", "size", "slot"))
        self.bins = unbinned(np.frombuffer(b"".join(t.column("bins").to_pylist()), np.uint8).reshape(len(self.ids), -1))
        self.keys = np.concatenate([x.flatten().to_numpy() for x in t.column("keys").chunks]).reshape(len(self.ids), -1)
        self.total = self.bins.sum(axis=1, dtype=np.int32)
        self.starts = np.flatnonzero(np.append(True, self.cell[1:] != self.cell[:-1]))
        self.sizes = np.diff(np.append(self.starts, len(self.cell)))

    def possible(self, first: np.ndarray, n: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of cells of n rows that begin at `first`, the pairs of rows that the bins leave room for, and the least edits of each.

        Only rows of different labels and, in a cell of two sides, of different sides.
        """
        out = []
        step = max(8, (1 << 17) // n)  # rows at a time
        crossed = self.side[first] != self.side[first + n - 1]
        for top in range(0, n, step):
            j, i = (x.ravel() for x in np.meshgrid(np.arange(top, min(top + step, n)), np.arange(min(top + step, n)), indexing="ij"))
            j, i = j[i < j], i[i < j]
            u, v = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
            ok = self.label[u] != self.label[v]
            ok &= np.abs(self.size[u] - self.size[v]) <= allowed(np.maximum(self.size[u], self.size[v]), similarity)
            if crossed.any():
                ok &= (self.side[u] != self.side[v]) | ~np.repeat(crossed, len(i))
            u, v = u[ok], v[ok]
            least = least_edits(self.bins, self.total, self.size, u, v)
            ok = least <= allowed(np.maximum(self.size[u], self.size[v]), similarity)
            u, v, least = u[ok], v[ok], least[ok]
            if self.keys.shape[1]:
                ok = (self.keys[u] == self.keys[v]).argmax(axis=1) == self.slot[u]
                u, v, least = u[ok], v[ok], least[ok]
            out.append((u, v, least))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def chosen(self, n: int, allow: int | None, similarity: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of all cells of n rows: pairs of rows, and the rows that have more. A pair belongs to its row of the rarer label, the later one among equals; each row takes the `allow` pairs of the least edits."""
        starts, out = self.starts[self.sizes == n], []
        together = max(1, (1 << 14) // (n * n))  # cells at a time
        for lo in range(0, len(starts), together):
            first = starts[lo : lo + together]
            u, v, least = self.possible(first, n, similarity)
            more = u[:0]
            if allow is not None and n > allow + 1:
                rows = (first[:, None] + np.arange(n)).ravel()
                order = np.lexsort((self.label[rows], self.cell[rows]))
                x = np.stack([self.cell[rows][order], self.label[rows][order]])
                new = np.flatnonzero(np.append(True, (x[:, 1:] != x[:, :-1]).any(axis=0)))
                often = np.zeros(len(self.ids), np.int64)
                often[rows[order]] = np.repeat(np.diff(np.append(new, len(order))), np.diff(np.append(new, len(order))))
                own = np.where(often[v] <= often[u], v, u)
                order = np.lexsort((u + v - own, least, own))
                u, v, own = u[order], v[order], own[order]
                nth = np.arange(len(own)) - np.searchsorted(own, own)
                u, v, more = u[nth < allow], v[nth < allow], own[nth >= allow]
            out.append((u, v, more))
        return out


def bucket_pairs(batches: Iterator[pa.RecordBatch], allow: int | None, similarity: float) -> Iterator[pa.RecordBatch]:
    """(bucket, u, v) of the pairs to verify, from the rows of `Cells`.

    A row without u and v tells that its bucket has more pairs. A cell that reaches over batches is held until it ends.
    """
    held: pa.Table | None = None

    def pairs(t: pa.Table) -> pa.RecordBatch:
        c = Cells(t)
        none = np.zeros(0, np.int64)
        found = [(none, none, none), *(x for n in np.unique(c.sizes[c.sizes > 1]) for x in c.chosen(int(n), allow, similarity))]
        i, j, more = (np.concatenate(x) for x in zip(*found, strict=True))
        full = np.unique(c.bucket[more])
        of = np.concatenate([c.bucket[i], full])
        left, right = (pa.array(np.concatenate([x, full]), pa.int64(), mask=np.arange(len(of)) >= len(i)) for x in (np.minimum(c.ids[i], c.ids[j]), np.maximum(c.ids[i], c.ids[j])))
        return pa.RecordBatch.from_arrays([pa.array(of), left, right], names=["bucket", "u", "v"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        cell = t.column("cell").to_numpy()
        same = np.flatnonzero(cell != cell[-1]) if len(cell) else np.zeros(0, int)
        upto = int(same[-1]) + 1 if len(same) else 0
        if upto:
            yield pairs(t.slice(0, upto))
        held = t.slice(upto)
    if held is not None and held.num_rows:
        yield pairs(held)


def bucket_rows(drawn: DataFrame, part: int) -> DataFrame:
    """(bucket, id, part, parts, size, bins) of the documents that share a bucket with others. drawn: id, keys array<long>, size, bins."""
    level = drawn.select("id", F.posexplode("keys").alias("slot", "key")).select("id", "slot", F.xxhash64("slot", "key").alias("bucket"))
    # a table of its own, so that both sides of the join are plain exchanges and Spark can split a hot bucket
    many = cut(level.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / part).cast("int")
    shared = level.join(many, "bucket").select("bucket", "id", "slot", F.pmod(F.xxhash64("id", "bucket"), parts).cast("int").alias("part"), parts.alias("parts"))
    coarse = F.substring("bins", 1, BINS // 2)
    return cut(shared.join(drawn.select("id", "size", coarse.alias("bins")), "id"))


def cell_pairs(cells: DataFrame, allow: int | None, similarity: float) -> DataFrame:
    """`bucket_pairs` of cells, which are dealt out whole."""
    run = lambda batches: bucket_pairs(batches, allow, similarity)
    dealt = cells.select("cell", "bucket", "id", "label", "side", "size", "slot", "bins", "keys").repartition("cell").sortWithinPartitions("cell", "side", "id")
    return cut(dealt.mapInArrow(run, "bucket long, u long, v long"))


def crossed(rows: DataFrame) -> DataFrame:
    """Each part of a bucket with itself and each other part: rows of `bucket_rows` by cell and side."""
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    pair = rows.withColumn("other", other)
    return pair.withColumns({"cell": F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")), "side": F.col("part")})


def contracted(edges: DataFrame) -> DataFrame:
    """(id, label) of every node with an edge (u, v): one label for all that are connected.

    In each round every node goes over to the least of itself and its neighbours, and the links are carried to where their ends went;
    links within one node and repeated ones go, so large classes shrink at once. Ids are hashes, in whose random order a share of the
    nodes goes in every round, whatever the classes' shapes. Every round takes the larger end of each link away, so the rounds end.
    """
    edges = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    parts = edges.count() // 200_000 + 1  # few links are kept in few partitions
    few = lambda df: cut(df.coalesce(parts))
    edges = edges.coalesce(parts)
    label = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("label", F.col("id"))
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = few(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")))
        label = few(label.join(to, F.col("label") == F.col("u"), "left").select("id", F.coalesce("to", "label").alias("label")))
        there = to.select(F.col("u").alias("v"), F.col("to").alias("to_v"))
        moved = edges.join(to, "u").join(there, "v").where("to <> to_v")
        edges = few(moved.select(F.least("to", "to_v").alias("u"), F.greatest("to", "to_v").alias("v")).distinct())
        if edges.isEmpty():
            return label


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose texts are near duplicates. texts: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).cast(pa.binary()) for i in (2, 3))
            ok = [alike(x.as_py().split(), y.as_py().split(), similarity) for x, y in zip(a, b, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    one, two = (texts.select(F.col("id").alias(i), F.col("text").alias(t)) for i, t in (("u", "a"), ("v", "b")))
    return cut(pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long"))


def linked(drawn: DataFrame, texts: DataFrame, similarity: float, part: int = 2048, allow: int = 2) -> tuple[DataFrame, DataFrame | None]:
    """The verified pairs (u, v), and (id, label) of all documents that they link. drawn: id, keys, size, bins; texts: id, text."""
    rows, fine = bucket_rows(drawn, part), drawn.select("id", F.substring("bins", BINS // 2 + 1, FINE // 2).alias("bins"), "keys")
    first = rows.withColumns({"cell": F.xxhash64("bucket", "part", "part"), "side": F.col("part"), "label": F.col("id"), "keys": F.array().cast("array<long>")})
    got = cell_pairs(first, allow, similarity)
    # a table of its own, so that texts are shuffled once, and both sides of later joins are plain exchanges that Spark can split
    texts = cut(texts.join(rows.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]))
    tried = cut(got.where("u is not null").select("u", "v").distinct())
    links = verified(tried, texts, similarity)
    label = contracted(links)
    open_ = got.where("u is null").select("bucket").unionByName(rows.where("parts > 1").select("bucket")).distinct()
    for allow in (16 * allow, None):
        left = rows.join(open_, "bucket", "left_semi").join(label.withColumnRenamed("label", "to"), "id", "left").withColumn("label", F.coalesce("to", "id"))
        left = cut(left.select("bucket", "id", "slot", "part", "parts", "size", "label"))
        mixed = cut(left.groupBy("bucket").agg((F.min("label") < F.max("label")).alias("several")).where("several").select("bucket"))
        if mixed.isEmpty():
            return links, label
        got = cell_pairs(crossed(left.join(mixed, "bucket").join(fine, "id")), allow, similarity)
        new = cut(got.where("u is not null").select("u", "v").distinct().join(tried, ["u", "v"], "left_anti"))
        more = verified(new, texts, similarity)
        links, tried = links.unionByName(more), tried.unionByName(new)
        named = more.join(label.select(F.col("id").alias("u"), F.col("label").alias("x")), "u", "left").join(label.select(F.col("id").alias("v"), F.col("label").alias("y")), "v", "left")
        over = contracted(named.select(F.coalesce("x", "u").alias("u"), F.coalesce("y", "v").alias("v")))
        every = label.unionByName(more.select(F.explode(F.array("u", "v")).alias("id")).distinct().join(label, "id", "left_anti").withColumn("label", F.col("id")))
        label = cut(every.join(over.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label")))
        open_ = got.where("u is null").select("bucket").distinct()
    return links, label


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, size: int = 2, number: int = 40, similarity: float = 0.8) -> DataFrame:
    """(key, row, class_id, links, label) of each row: links is the number of verified pairs of the row's text; class_id the least key of its class; row and label the hashes of the row and of its class."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(key, text).alias("row"), whole.alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for given, body, off in chunks(b, "text"):
                w = Words(body, off)
                at, made = sketches(w, k, size, number)
                words = np.zeros(given.num_rows, bool)
                words[at] = True
                ends = np.concatenate([[0], np.cumsum(words * number)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(made.view(np.int64).ravel()))
                both = np.hstack([binned(w, BINS), binned(w, FINE)])
                bins = pa.FixedSizeBinaryArray.from_buffers(pa.binary(both.shape[1]), given.num_rows, [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*given.columns[:4], lists, bins, pa.array(w.counts, pa.int64()), pa.array(words)], names=["doc_id", "row", "same", "same2", "keys", "bins", "size", "words"])

    twice = rows.select("doc_id", "row", F.xxhash64("text").alias("same"), F.xxhash64(F.lit("2"), "text").alias("same2"), "text")
    drawn = cut(twice.mapInArrow(sketched, f"doc_id {kind}, row long, same long, same2 long, keys array<long>, bins binary, size long, words boolean").withColumn("place", F.monotonically_increasing_id()))
    members = drawn.select("doc_id", "row", "same", "same2", "words")
    # equal texts: a row of the least key stands for them
    reps = cut(drawn.groupBy("same", "same2").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "place")).alias("m")).select("same", "same2", F.col("m.row").alias("id"), "m.place"))
    texts = cut(drawn.where("words").select("place", "keys", "size", "bins").join(reps.select("place", "id"), "place").drop("place"))
    links, label = linked(texts, rows.select(F.col("row").alias("id"), "text"), similarity)
    degree = links.select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    found = members.join(reps.select("same", "same2", F.col("id").alias("rep")), ["same", "same2"]).join(label.withColumnRenamed("id", "rep"), "rep", "left").join(degree, "rep", "left")
    found = found.withColumn("label", F.coalesce("label", "rep")).select("doc_id", "row", "label", F.coalesce("links", F.lit(0)).alias("links"), (~F.col("words")).alias("none"))
    # a table of its own, so that both sides of the join are plain exchanges and Spark can split a hot class
    named = cut(found.where("not none").groupBy("label").agg(F.min("doc_id").alias("class_id")))
    out = found.join(named, "label", "left")
    class_id, label = (F.when(F.col("none"), F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("doc_id", "class_id"), ("row", "label")))
    return out.select(F.col("doc_id").alias(key), "row", class_id, "links", label)


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns that have one."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])


def distinct_rows(docs: DataFrame, by: list[str], chosen: DataFrame, name: str) -> DataFrame:
    """The rows of `docs` for which the hash of the columns `by` is in `chosen` (column `name`, and what else it has), one of each that repeats."""
    copy = unused(docs, "copy")
    joined = docs.withColumn(name, F.xxhash64(*[F.col(f"`{c}`") for c in by])).withColumn(copy, row_hash(docs)).join(chosen, name)
    return joined.withColumn(copy, F.row_number().over(W.partitionBy(name).orderBy(copy))).where(F.col(copy) == 1).drop(name, copy)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class: that of the least key."""
    found, name = near_classes(docs.select(key, text), key, text, **options), unused(docs, "row")
    least = found.groupBy("label").agg(F.min(F.struct(F.col(key).isNull(), key, "row"))["row"].alias(name)).select(name).distinct()
    return distinct_rows(docs, [key, text], least, name).select([F.col(f"`{c}`") for c in docs.columns])


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).drop("row", "label")
