"""Exact top-k search by BM25 (op1): inverted index with block-max WAND per shard, merged with global statistics.

Terms are runs of ASCII letters and digits and of signs beyond ASCII, with ASCII capitals lowered. A shard is up to `shard_rows`
documents of one partition, indexed as arrays: sorted terms, their postings (document and frequency), and for each term and block of 128
documents where its postings begin, their largest frequency and the least length of their documents. Documents, their lengths and the
terms' document frequencies are summed over all shards; a query takes them along, in blocks of queries.

Shards are searched in rounds, and a query takes its k-th score of the rounds before along. It reads the block maxima of its terms, which
bound what a document of a block can score. Blocks whose bounds are below the k-th score are skipped, and their postings are not read; a
query without a k-th score begins with its four blocks of the highest bounds. The postings of a shard's frequent terms are rows with a
place for each document, which a matrix product adds up for many queries at once; the others are lists. Where the maxima of a query's
frequent terms together stay below the k-th score (the pivot), they cannot bring a document in by themselves: documents come from the other
terms, and only where one of them may still reach the k-th score are the rows read. Whole texts are long queries, whose bounds hardly rule out
a block and cost as much as their scores: their lists are added up for all documents, and their rows in single precision, which tells who may
be among the k best; these are summed up again in whole numbers. So the shard's top k is exact, and the merge of the shards' lists is the exact top k.

Scores are sums of whole millionths, so they don't depend on the order of addition; ties go to the least document id, null last.

A query is a whole text: all its distinct terms. Null and empty texts have no terms; such a query has no results, and neither has any on
an empty table. Rows that share an id are ranked one by one; texts of any length are read whole; columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.base import chunks, cut, table
from spanloom.llm.words import Words

BETWEEN = np.ones(256, bool)  # bytes between terms
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK = 7  # bits of a block
#: A term is frequent in a shard where at least one document in so many has it; rows are kept for so many of them, the most frequent ones.
FREQUENT = 16
ROWS = 512
#: Queries whose postings are added up at once, and blocks that a query without a k-th score begins with; it doubles them until all are visited.
TOGETHER = 16
START = 4
#: Queries whose frequent terms are added up at once.
BATCH = 256
#: A query whose lists hold at least a posting for so many documents is added up whole: bounds of its blocks would cost as much as its scores.
LONG = 8

K1, B = 1.2, 0.75


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def millionths(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5)


def saturated(tf: np.ndarray, dl: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def postings(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Term, document, frequency and one place in the words of each posting, by term and document."""
    h, doc = w.hashes().view(np.int64), w.doc()
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], doc[at], np.diff(np.append(at, len(h))), order[at]


INDEX = "shard long, docs array<long>, lengths array<int>, terms array<long>, block_at array<int>, block array<int>, posting_at array<int>, most array<int>, least array<int>, posting_doc array<int>, posting_tf array<int>"


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_rows: int = 2048) -> DataFrame:
    """A row a shard; the scan's partitions are put together, without a shuffle, to one a shard."""

    def lists(*arrays: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a)) for a in arrays]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 20
        held: list[tuple] = []
        ids: list[pa.Array] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, rows
            h, doc, tf, dl = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(h, kind="stable")  # documents come in order
            h, doc, tf = h[order], doc[order], tf[order]
            del order
            new, apart = np.ones(len(h), bool), np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            apart[1:] = new[1:] | (doc[1:] >> BLOCK != doc[:-1] >> BLOCK)
            at, of = np.flatnonzero(new), np.flatnonzero(apart)  # each term's first posting, and each block's
            most, least = (np.maximum.reduceat(tf, of), np.minimum.reduceat(dl[doc], of)) if len(of) else (tf, tf)
            keys = pa.concat_arrays(ids)
            cols = lists(dl, h[at], np.append(np.searchsorted(of, at), len(of)).astype(np.int32), (doc[of] >> BLOCK).astype(np.int32), np.append(of, len(h)).astype(np.int32), most.astype(np.int32), least.astype(np.int32), doc, tf)
            out = pa.RecordBatch.from_arrays([pa.array([shard]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), *cols], names=[x.split()[0] for x in INDEX.split(", ")])
            ids.clear()
            shard, rows = shard + 1, 0
            return out

        for b in batches:
            for part, body, off in chunks(b, text):
                w = Words(LOWER[body], off, BETWEEN)
                h, doc, tf, _ = postings(w)
                held.append((h, (doc + rows).astype(np.int32), tf.astype(np.int32), w.counts.astype(np.int32)))
                ids.append(part.column(0).cast(pa.int64()))
                rows += part.num_rows
                if rows >= shard_rows:
                    yield flush()
        if held:
            yield flush()

    shards = max(1, -(-docs.count() // shard_rows))
    return docs.select(key, text).coalesce(shards).mapInArrow(run, INDEX)


def query_terms(queries: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, term) of each query, and how often it has the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, body, off in chunks(b, text):
                h, doc, tf, _ = postings(Words(LOWER[body], off, BETWEEN))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(h), pa.array(tf)], names=["query_id", "term", "tf"])

    return queries.select(key, text).mapInArrow(run, "query_id long, term long, tf long")


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All places of the ranges [lo, hi), one after the other."""
    n = hi - lo
    return np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)


class Shard:
    """One shard's index for queries of some terms. weights: the terms (sorted) and their idf. read: how many postings queries have read.

    The postings of frequent terms lie in rows too, a place for each document of the shard, so that adding one up is no walk along a list.
    """

    def __init__(self, docs: pa.Array, arrays: dict[str, np.ndarray], mean: float, terms: np.ndarray, weights: np.ndarray):
        self.docs, self.terms, self.block_at, self.block, self.posting_at = docs, arrays["terms"], arrays["block_at"], arrays["block"], arrays["posting_at"]
        self.doc, self.blocks, self.read = arrays["posting_doc"], (len(arrays["lengths"]) >> BLOCK) + 1, 0
        place = np.searchsorted(terms, self.terms)
        place[place == len(terms)] = 0
        idf_ = np.where(terms[place] == self.terms, weights[place], 0.0) if len(terms) else np.zeros(len(self.terms))
        of_block = np.repeat(idf_, np.diff(self.block_at))
        self.bound = np.zeros(len(self.block), np.int32)
        self.points = np.zeros(len(self.doc), np.int32)
        for lo in range(0, len(self.block), 1 << 16):  # some blocks at a time, for memory
            at = self.posting_at[lo : lo + (1 << 16) + 1]
            part, some = slice(at[0], at[-1]), slice(lo, lo + (1 << 16))
            self.bound[some] = millionths(of_block[some] * saturated(arrays["most"][some], arrays["least"][some], mean)) + 1
            self.points[part] = millionths(np.repeat(of_block[lo : lo + len(at) - 1], np.diff(at)) * saturated(arrays["posting_tf"][part], arrays["lengths"][self.doc[part]], mean))
        self.first = self.posting_at[self.block_at]  # each term's first posting, and the end
        self.maxima = np.maximum.reduceat(self.bound, self.block_at[:-1]) if len(self.terms) else self.bound
        n = np.diff(self.first)
        often = np.flatnonzero((n * FREQUENT >= len(arrays["lengths"])) & (idf_ > 0))
        often = often[np.argsort(-n[often], kind="stable")[:ROWS]]
        self.row = np.full(len(self.terms), -1)
        self.row[often] = np.arange(len(often))
        self.rows, self.row_most = np.zeros((len(often), self.blocks << BLOCK)), self.maxima[often].astype(np.float64)
        self.row_bound, self.row_read = (np.zeros((len(often), self.blocks)) for _ in range(2))
        for r, t in enumerate(often):
            held, of = slice(self.first[t], self.first[t + 1]), slice(self.block_at[t], self.block_at[t + 1])
            self.rows[r, self.doc[held]] = self.points[held]
            self.row_bound[r, self.block[of]] = self.bound[of]
            self.row_read[r, self.block[of]] = np.diff(self.posting_at[self.block_at[t] : self.block_at[t + 1] + 1])
        self.rough, self.row_count = self.rows.astype(np.float32), n[often]

    def top(self, terms: np.ndarray, k: int, order: np.ndarray, worst: float = 0) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents, without those below `worst`. terms: sorted and distinct; order: rank of each document by id, for ties."""
        place = np.searchsorted(self.terms, terms)
        place = place[place < len(self.terms)]
        place = np.unique(place[np.isin(self.terms[place], terms)])
        return self.top_of(place, np.zeros(len(place), np.int64), np.array([worst], np.float64), k, order)[0]

    def top_of(self, place: np.ndarray, of: np.ndarray, worst: np.ndarray, k: int, order: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """`top` of some queries at once, each with its `worst`: the places of their terms among the shard's, and (in order) which query each is of."""
        n, rare = len(worst), self.row[place] < 0
        long = np.bincount(of[rare], (self.first[1:] - self.first[:-1])[place[rare]], n) * LONG >= len(order)
        out: list = [None] * n
        for these, f in ((long, self.added), (~long, self.pruned)):
            at, number = these[of], np.cumsum(these) - 1
            for i, x in zip(np.flatnonzero(these).tolist(), f(place[at], number[of[at]], worst[these], k, order) if these.any() else (), strict=True):
                out[i] = x
        return out

    def added(self, place: np.ndarray, of: np.ndarray, worst: np.ndarray, k: int, order: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """`top_of` by adding up all documents: the rows in single precision, and where that may reach the k-th score, in whole numbers."""
        n, row, width = len(worst), self.row[place], self.rows.shape[1]
        asks = np.zeros((n, len(self.rows)), np.float32)
        asks[of[row >= 0], row[row >= 0]] = 1
        rough = asks @ self.rough
        under = 1 - (len(self.rows) + 8) * 2.0**-23  # single precision loses less of a score than this, as all points are above 0
        ends, out = np.searchsorted(of, np.arange(n + 1)), [(np.zeros(0, np.int64), np.zeros(0)) for _ in range(n)]
        for first in range(0, n, TOGETHER):
            some = slice(first, min(first + TOGETHER, n))
            part = slice(ends[some.start], ends[some.stop])
            rare = row[part] < 0
            lo, hi, q = self.first[place[part][rare]], self.first[place[part][rare] + 1], of[part][rare] - first
            at = ranges(lo, hi)
            self.read += len(at) + int(self.row_count[row[part][~rare]].sum())
            m = some.stop - first
            listed = np.bincount(np.repeat(q * width, hi - lo) + self.doc[at], self.points[at], m * width).reshape(m, width)
            about, floor = listed + rough[some], np.maximum(worst[some], 1)
            least, cold = floor.copy(), worst[some] < 1
            if cold.any() and width > k:
                least[cold] = np.maximum(least[cold], np.partition(about[cold], -k, axis=1)[:, -k] * under)
            q, d = np.nonzero(about >= (least * under)[:, None])
            bound = np.searchsorted(q, np.arange(m + 1))
            for i in np.flatnonzero(np.diff(bound)).tolist():
                doc, mine = d[bound[i] : bound[i + 1]], row[ends[first + i] : ends[first + i + 1]]
                s = listed[i, doc] + self.rows[mine[mine >= 0][:, None], doc].sum(axis=0)
                doc, s = doc[s >= floor[i]], s[s >= floor[i]]
                keep = np.lexsort((order[doc], -s))[:k]
                out[first + i] = doc[keep], s[keep]
        return out

    def pruned(self, place: np.ndarray, of: np.ndarray, worst: np.ndarray, k: int, order: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """`top_of` by bounds of blocks and the pivot."""
        n, row = len(worst), self.row[place]
        asks = np.zeros((n, len(self.rows)))
        asks[of[row >= 0], row[row >= 0]] = 1
        rare, of = place[row < 0], of[row < 0]
        lo, hi = self.block_at[rare], self.block_at[rare + 1]
        at, of = ranges(lo, hi), np.repeat(of, hi - lo)  # a rare term's postings in a block each
        block, of_rows, rows_most = self.block[at], asks @ self.row_bound, asks @ self.row_most
        bounds = of_rows + np.bincount(of * self.blocks + block, self.bound[at], n * self.blocks).reshape(n, -1)
        floor, best = worst.copy(), [(np.zeros(0, np.int64), np.zeros(0)) for _ in range(n)]

        def visit(these: np.ndarray) -> None:
            """Some blocks of each query."""
            # the pivot: if the frequent terms' maxima together stay below the k-th score, documents come from the others only
            cols, led = np.flatnonzero(these.any(axis=0)), np.flatnonzero(these.any(axis=1) & (rows_most >= floor))
            whole = len(cols) == self.blocks
            rows = self.rows if whole else self.rows.reshape(len(self.rows), self.blocks, -1)[:, cols].reshape(len(self.rows), -1)
            sums = asks[led] @ rows
            self.read += int((asks[led] @ self.row_read[:, cols]).sum())
            for first in range(0, n, TOGETHER):
                some = slice(first, min(first + TOGETHER, n))
                part = slice(*np.searchsorted(of, [some.start, some.stop]))
                here = these[of[part], block[part]]
                e, q = at[part][here], of[part][here] - first
                from_, to = self.posting_at[e], self.posting_at[e + 1]
                places = ranges(from_, to)
                self.read += len(places)
                m = some.stop - first
                score = np.bincount(np.repeat(q * (self.blocks << BLOCK), to - from_) + self.doc[places], self.points[places], m * self.blocks << BLOCK).astype(np.float64, copy=False).reshape(m, self.blocks, -1)
                for i in range(m):
                    if not these[first + i].any():
                        score[i] = 0
                        continue
                    at_led = int(np.searchsorted(led, first + i))
                    if at_led < len(led) and led[at_led] == first + i:
                        if whole:
                            score[i] += sums[at_led].reshape(self.blocks, -1)
                        else:
                            score[i, cols] += sums[at_led].reshape(len(cols), -1)
                    elif rows_most[first + i]:
                        flat = score[i].reshape(-1)
                        may = np.flatnonzero((score[i] > 0) & (score[i] + of_rows[first + i][:, None] >= floor[first + i]))
                        mine = np.flatnonzero(asks[first + i])
                        also = self.rows[mine[:, None], may]
                        self.read += np.count_nonzero(also)
                        flat[may] += also.sum(axis=0)
                    if not these[first + i].all():
                        score[i, ~these[first + i]] = 0
                score = score.reshape(m, -1)
                least = np.maximum(floor[some], 1)
                if (floor[some] < 1).any():
                    least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else 1)
                q, doc = np.nonzero(score >= least[:, None])
                bound = np.searchsorted(q, np.arange(m + 1))
                for i in np.flatnonzero(np.diff(bound)).tolist():
                    d = doc[bound[i] : bound[i + 1]]
                    d, s = np.concatenate([best[first + i][0], d]), np.concatenate([best[first + i][1], score[i, d]])
                    keep = np.lexsort((order[d], -s))[:k]
                    best[first + i] = d[keep], s[keep]
                    if len(keep) == k:
                        floor[first + i] = max(floor[first + i], s[keep[-1]])

        seen, cold, step = np.zeros(bounds.shape, bool), (floor < 1)[:, None], START
        while cold.any() and step < self.blocks:  # queries without a k-th score begin with their best blocks
            left = np.where(seen, 0, bounds)
            now = cold & ~seen & (bounds >= np.maximum(np.partition(left, -step, axis=1)[:, -step], np.maximum(floor, 1))[:, None])
            visit(now)
            seen, step = seen | now, 2 * step
        visit(~seen & (bounds >= np.maximum(floor, 1)[:, None]))
        return best


def frequencies(index: DataFrame) -> DataFrame:
    """(term, df) of each shard's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for terms, at, of in zip(*b.columns, strict=True):
                first = of.values.to_numpy()[at.values.to_numpy()]  # each term's first posting, and the end
                yield pa.RecordBatch.from_arrays([terms.values, pa.array(np.diff(first).astype(np.int64))], names=["term", "df"])

    return index.select("terms", "block_at", "posting_at").mapInArrow(run, "term long, df long")


def strides(shards: int) -> list[int]:
    """Steps between the numbers of the shards that are searched by the end of each round: each round has about three times as many as all before it, the last one the rest."""
    out = [1]
    while shards >= 8 * out[-1]:
        out.append(4 * out[-1])
    return out[::-1]


ASKED = "part long, ids array<long>, ends array<int>, every array<long>, weight array<double>, which array<int>"


def side_by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block of queries: their ids, where the terms of each begin, all their distinct terms with weights, and which of these each term is."""
    for b in batches:
        for part, queries in zip(*b.columns, strict=True):
            lists = queries.values.field(1)
            off, flat = lists.offsets.to_numpy(), lists.flatten()
            term, weight = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            every, first, which = np.unique(term, return_index=True, return_inverse=True)
            cols = queries.values.field(0), pa.array(off - off[0]), pa.array(every), pa.array(weight[first]), pa.array(which.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in cols)], names=[x.split()[0] for x in ASKED.split(", ")])


def search(index: DataFrame, terms: DataFrame, k: int = 10, block: int = 1 << 19, together: int = 1) -> DataFrame:
    """(query_id, rank, doc_id, score) of the k best documents of each query. index: a checkpointed `build_index`; terms: `query_terms`.

    Queries go in blocks of about `block` terms. A task takes `together` shards, one after the other, and gives the best of them all.
    Shards go in rounds: a query's k-th best of the rounds before goes along, and only what is better comes out of a shard. If shards are
    alike, a round gives some k rows a query, and the number of rounds grows with the logarithm of the shards; in the worst case it is k a shard.
    """
    number = F.col("shard").bitwiseAND(F.lit((1 << 20) - 1)), F.shiftright("shard", 20)  # within its partition, and the partition's
    stats = index.agg(F.count("*").alias("shards"), F.max(number[1]).alias("last"), F.sum(F.size("docs")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words")).first()
    n, mean = stats.n or 0, (stats.words or 0) / max(stats.n or 0, 1) or 1.0
    terms = cut(terms)
    df = frequencies(index).join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = terms.join(df, "term").select("query_id", F.struct("term", idf(F.lit(float(n)), F.col("df")).alias("idf")).alias("term"))
    asked = cut(weighed.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms")))
    blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block))
    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("part")
    packed = asked.groupBy(part).agg(F.collect_list(F.struct("query_id", F.col("terms").alias("asked"))).alias("queries"))
    packed = cut(packed.coalesce(blocks).mapInArrow(side_by_side, ASKED))
    names = [x.split()[0] for x in INDEX.split(", ")][2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}  # by query: minus the points, whether the id is null, the id
        floor: dict[int, tuple] = {}  # the same of the k-th best of the rounds before
        shard = None
        for b in batches:
            for r in range(b.num_rows):
                cell = lambda c: b.column(b.schema.get_field_index(c))[r].values  # noqa: B023, E731
                docs, floors = cell("docs"), cell("floors")
                if floors is not None and not floor:
                    floor = {x["query_id"]: (-x["points"], x["doc_id"] is None, x["doc_id"] or 0) for x in floors.to_pylist()}
                off, every, weight, which = (cell(c).to_numpy() for c in ("ends", "every", "weight", "which"))
                del shard  # before the next one is made
                shard = Shard(docs, {c: cell(c).to_numpy() for c in names}, mean, every, weight)
                nulls = docs.is_null().to_numpy(zero_copy_only=False)
                ids = docs.fill_null(0).to_numpy()
                order = np.empty(len(ids), np.int64)
                order[np.lexsort((ids, nulls))] = np.arange(len(ids))
                place = np.searchsorted(shard.terms, every)
                place[place == len(shard.terms)] = 0
                place = np.where(shard.terms[place] == every, place, -1) if len(shard.terms) else np.full(len(every), -1)
                names_ = cell("ids").to_pylist()
                for lo in range(0, len(names_), BATCH):
                    some = names_[lo : lo + BATCH]
                    at, of = place[which[off[lo] : off[lo + len(some)]]], np.repeat(np.arange(len(some)), np.diff(off[lo : lo + len(some) + 1]))
                    last = [h[-1] if len(h := held.get(q, ())) == k else None for q in some]
                    last = [min(x for x in (y, floor.get(q)) if x) if y or q in floor else None for q, y in zip(some, last, strict=True)]
                    worst = np.array([-x[0] if x else 0 for x in last], np.float64)
                    for q, x, (d, s) in zip(some, last, shard.top_of(at[at >= 0], of[at >= 0], worst, k, order), strict=True):
                        new = [y for y in zip((-s).tolist(), nulls[d].tolist(), ids[d].tolist(), strict=True) if not x or y < x] if len(d) else ()
                        if new:
                            held[q] = sorted([*held.get(q, ()), *new])[:k]
        rows = [(q, None if null else i, int(-s)) for q, found in held.items() for s, null, i in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["query_id", "doc_id", "points"])

    # the stated query set against all shards, a block of queries at a time
    steps = strides(stats.shards)
    order = W.partitionBy("query_id").orderBy(F.col("points").desc(), F.col("doc_id").asc_nulls_last())
    counted = number[0] * F.lit((stats.last or 0) + 1) + number[1]
    best, before = None, None
    for step in steps:
        now = index.where((F.pmod(counted, F.lit(step)) == 0) & (F.pmod(counted, F.lit(before)) != 0 if before else F.lit(True)))
        if best is None:
            asking = packed.withColumn("floors", F.lit(None).cast("array<struct<query_id:bigint,doc_id:bigint,points:bigint>>"))
        else:
            floors = best.where(F.col("rank") == k).groupBy(part).agg(F.collect_list(F.struct("query_id", "doc_id", "points")).alias("floors"))
            asking = cut(packed.join(floors, "part", "left").coalesce(blocks))
        met = now.coalesce(max(1, -(-stats.shards // together))).crossJoin(asking).mapInArrow(run, "query_id long, doc_id long, points long")
        met = met if best is None else best.drop("rank").unionByName(met)
        best, before = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), step
        if step > 1:
            best = cut(best)
    return best.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", (F.col("points") / 1e6).alias("score"))


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 50 against all documents."""
    docs = table(spark, sf_dir, "documents")
    return search(cut(build_index(docs)), query_terms(docs.where(F.col("doc_id") % 50 == 0)))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT count(*)::DOUBLE AS n, sum(len(ws)) / count(*)::DOUBLE AS mean FROM d),
p AS (SELECT doc_id, word, count(*)::DOUBLE AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(ws) AS word, len(ws) AS dl FROM d) GROUP BY doc_id, word),
f AS (SELECT word, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, s GROUP BY word, n),
q AS (SELECT doc_id AS query_id, word, idf FROM p JOIN f USING (word) WHERE doc_id % 50 = 0),
m AS (SELECT query_id, doc_id, sum(floor(idf * (tf * (1.2::DOUBLE + 1) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / mean))) * 1e6 + 0.5))::BIGINT AS points FROM q JOIN p USING (word), s GROUP BY query_id, doc_id)
SELECT query_id, rank, doc_id, points / 1e6::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, doc_id) AS rank FROM m) WHERE rank <= 10
"""
