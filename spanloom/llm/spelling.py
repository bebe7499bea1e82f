"""Spelling variants among a corpus' words (op11): Aho-Corasick automata of word halves, in shards.

Words are maximal runs of ASCII letters and U+00C0 to U+00FF, with A-Z lowered. A word of L signs has two segments, its first L // 2 signs
and the rest. One inserted, deleted or replaced sign leaves one segment of a word whole, and where it was: the first at the other
word's begin, the second at its end. A shard holds an automaton of the segments whose hash falls to it, with the words of each. All words
are scanned, each by the shards to which the beginnings and ends go that a segment of a near word can equal. A hit counts if the segment
lies at the begin or the end and if the two lengths differ by one at most; sets of letters (64 bits) rule out most of the rest, and what is
left is verified by its common beginning and end. A pair whose segments are both whole counts by the first alone, so no pair comes twice.

What a shard returns is a row for each word it scanned that is near another: how many, and the best of them. A segment that more than
`group_rows` words share is dealt over several shards, each of which scans the words that have it, so no group has to fit a task; the
table of such segments, which is broadcast, has at most 2 * words / group_rows rows.

Null texts have no words, an empty table gives no rows; texts and words may be of any length. Rows are counted one by one, repeated ones
too; a null key counts as an empty one where keys matter. Ties between near words go to the smaller in code-point order. Other columns of
the input are not read, and may have any names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.base import cut, strings, table
from spanloom.llm.search import ranges

RUN, NO_RUN = re.compile("[a-zÀ-ÿ]+"), re.compile("[^a-zÀ-ÿ]")
SLICE = 1 << 20  # signs of a text at a time


def runs(text: str) -> Iterator[Counter[str]]:
    """Counts of a text's runs, in slices that cut none."""
    low = text.encode().lower().decode()
    at = 0
    while at < len(low):
        gap = NO_RUN.search(low, at + SLICE)
        upto = gap.start() if gap else len(low)
        yield Counter(RUN.findall(low, at, upto))
        at = upto


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 6, fewest: int = 5, slip: int = 0, keep: int = 1 << 18) -> DataFrame:
    """(word, n) of the corpus' words of at least `shortest` signs and `fewest` occurrences.

    slip: if given, a run loses one sign where it divides the CRC-32 h of `<key>:<run>`, the one at place h % length. A task sums up to
    `keep` different words before it passes them on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            texts = strings(b, text)
            for i in range(b.num_rows):
                seed = zlib.crc32(f"{b.column(0)[i].as_py() or ''}:".encode())
                for found in runs(texts[i].as_py()):
                    for w, c in found.items():
                        if slip and not (h := zlib.crc32(w.encode(), seed)) % slip:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                        if len(w) >= shortest:
                            held[w] += c
                if len(held) > keep:
                    yield flush()
        if held:
            yield flush()

    # the key as a string, so that any kind of key will do
    pairs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias(text if text != "key" else "text_"))
    text = pairs.columns[1]
    return pairs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def key_of(side: int, length: str, segment: str) -> str:
    return f"named_struct('side', {side}, 'of', int({length}), 'segment', {segment})"


def routed(words: DataFrame, shard_rows: int, group_rows: int) -> tuple[DataFrame, int]:
    """(shard, kind, word, n): the words whose first (kind 0) or second segment (1) a shard holds, and those that it scans (2); and the number of shards."""
    size = words.count()
    count = max(1, -(-2 * size // shard_rows))
    sized = words.withColumn("len", F.length("word"))
    own = F.expr("array(" + ", ".join([key_of(0, "len", "left(word, len div 2)"), key_of(1, "len", "substring(word, len div 2 + 1)")]) + ")")
    segments = sized.select("word", "n", F.inline(F.array(*(F.struct(F.lit(s).alias("kind"), own[s].alias("key")) for s in (0, 1)))))
    met = [key_of(0, f"len + {d}", f"left(word, (len + {d}) div 2)") for d in (-1, 0, 1)] + [key_of(1, f"len + {d}", f"right(word, len + {d} - (len + {d}) div 2)") for d in (-1, 0, 1)]
    scans = sized.select("word", F.lit(0).cast("long").alias("n"), F.explode(F.expr(f"array({', '.join(met)})")).alias("key"))
    many = segments.groupBy("key").count().where(F.col("count") > group_rows).select("key", F.ceil(F.col("count") / group_rows).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    shard = F.pmod(F.xxhash64("key", "part"), F.lit(count)).cast("int").alias("shard")
    segments = segments.join(F.broadcast(many), "key", "left").withColumn("part", F.pmod(F.xxhash64("word"), parts).cast("int")).select(shard, "kind", "word", "n")
    scans = scans.join(F.broadcast(many), "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select(shard, F.lit(2).alias("kind"), "word", "n").distinct()
    return segments.unionByName(scans), count


class Texts:
    """Words as bytes (one a sign) with their lengths and sets of letters."""

    def __init__(self, words: list[str]):
        body = "".join(words).encode("latin-1")
        self.body = np.frombuffer(body or b"\0", np.uint8)
        self.len = np.fromiter(map(len, words), np.int64, len(words))
        self.at = np.cumsum(self.len) - self.len
        self.set = np.zeros(len(words), np.uint64)
        if body:
            bit = np.uint64(1) << (self.body & np.uint8(63)).astype(np.uint64)
            self.set = np.bitwise_or.reduceat(bit, self.at)


def common(v: Texts, i: np.ndarray, w: Texts, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the common beginning and end of words v[i] and w[j]."""
    short = np.minimum(v.len[i], w.len[j])
    step = np.arange(int(short.max(initial=0)))
    inside = step < short[:, None]
    last = (len(v.body) - 1, len(w.body) - 1)
    out = []
    for one, other in ((v.at[i][:, None] + step, w.at[j][:, None] + step), ((v.at + v.len)[i][:, None] - 1 - step, (w.at + w.len)[j][:, None] - 1 - step)):
        same = inside & (v.body[np.clip(one, 0, last[0])] == w.body[np.clip(other, 0, last[1])])
        out.append(np.where(same.all(axis=1), len(step), (~same).argmax(axis=1)) if len(step) else short)
    return out[0], out[1]


class HalfAutomaton:
    """One shard: words by their first and second segments."""

    def __init__(self, kinds: np.ndarray, words: list[str], n: np.ndarray):
        import ahocorasick

        self.texts, self.words, self.n = Texts(words), words, n
        self.half = self.texts.len // 2
        place: dict[tuple[int, str], int] = {}
        group = np.fromiter((place.setdefault((k, w[: len(w) // 2] if k == 0 else w[len(w) // 2 :]), len(place)) for k, w in zip(kinds.tolist(), words, strict=True)), np.int64, len(words))
        self.order = np.argsort(group, kind="stable")
        self.start = np.searchsorted(group[self.order], np.arange(len(place) + 1))
        self.sides = np.array([k for k, _ in place], np.int64)
        by_segment: dict[str, list[int]] = {}
        for (kind, segment), g in place.items():
            by_segment.setdefault(segment, [-1, -1])[kind] = g
        self.find = ahocorasick.Automaton()
        for segment, (first, second) in by_segment.items():
            self.find.add_word(segment, (len(segment), first, second))
        if by_segment:
            self.find.make_automaton()

    def near(self, words: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, int, int, str]]:
        """For each of `words` near others: its place, how many there are, and n and name of the best."""
        if not len(self.words):
            return
        scan, group = [], []
        for i, v in enumerate(words):
            last = len(v) - 1
            for end, (size, first, second) in self.find.iter(v):
                if first >= 0 and end == size - 1:
                    scan.append(i)
                    group.append(first)
                if second >= 0 and end == last:
                    scan.append(i)
                    group.append(second)
        v, scan, group = Texts(words), np.array(scan, np.int64), np.array(group, np.int64)
        upto = np.cumsum(self.start[group + 1] - self.start[group])
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        lo = 0
        while lo < len(scan):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + limit, "right")))
            of = group[lo:hi]
            j = self.order[ranges(self.start[of], self.start[of + 1])]
            size = self.start[of + 1] - self.start[of]
            i, side = np.repeat(scan[lo:hi], size), np.repeat(self.sides[of], size)
            may = (np.abs(v.len[i] - self.texts.len[j]) <= 1) & (np.bitwise_count(v.set[i] ^ self.texts.set[j]) <= 2)
            i, j, side = i[may], j[may], side[may]
            width = int(v.len[i].max(initial=1)) + 1
            for at in range(0, len(i), max(1, (4 << 20) // width)):
                part = slice(at, at + max(1, (4 << 20) // width))
                a, b, s = i[part], j[part], side[part]
                begin, end = common(v, a, self.texts, b)
                one, other = v.len[a], self.texts.len[b]
                hit = np.where(one == other, begin + end == one - 1, begin + end >= np.minimum(one, other)) & ((s == 0) | (begin < self.half[b]))
                pairs.append((a[hit], b[hit]))
            lo = hi
        if not sum(len(i) for i, _ in pairs):
            return
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        order = np.lexsort((-self.n[j], i))
        i, j = i[order], j[order]
        starts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        for lo, hi in zip(starts.tolist(), np.append(starts[1:], len(i)).tolist(), strict=True):
            most = self.n[j[lo]]
            ties = j[lo : lo + int(np.searchsorted(-self.n[j[lo:hi]], -most, "right"))]
            yield int(i[lo]), hi - lo, int(most), min(self.words[x] for x in ties.tolist())


def near_words(words: DataFrame, shard_rows: int = 1 << 14, group_rows: int = 1 << 16) -> DataFrame:
    """(word, n_near, best): of each word that has near ones among `words` (word, n), how many, and (minus n, word) of the best."""
    rows, shards = routed(words, shard_rows, group_rows)
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "kind", F.length("word"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for b in batches:
            shard, kind = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("shard", "kind"))
            edge = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | ((kind[1:] == 2) != (kind[:-1] == 2))))
            for lo, hi in zip(edge.tolist(), np.append(edge[1:], len(shard)).tolist(), strict=True):
                part = b.slice(lo, hi - lo)
                word, n = (part.column(b.schema.get_field_index(c)) for c in ("word", "n"))
                if shard[lo] != now:
                    now, held, index = shard[lo], [], None
                if kind[lo] < 2:
                    held.append((kind[lo:hi], word.to_pylist(), n.to_numpy()))
                    continue
                if index is None:
                    index = HalfAutomaton(np.concatenate([np.zeros(0, np.int32), *(x[0] for x in held)]), [w for x in held for w in x[1]], np.concatenate([np.zeros(0, np.int64), *(x[2] for x in held)]))
                    held = []
                names = word.to_pylist()
                if found := list(index.near(names)):
                    at, near, most, best = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in at]), pa.array(near, pa.int64()), pa.array(most, pa.int64()), pa.array(best)], names=["word", "near", "most", "best"])

    found = rows.mapInArrow(run, "word string, near long, most long, best string")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("most")).alias("less"), F.col("best").alias("word"))).alias("best"))


def with_roots(words: DataFrame) -> DataFrame:
    """`words` (word, form and others) with `root`, the end of the chain of forms, by pointer doubling; forms must not run in circles."""
    links = cut(words.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        onward = links.where(F.col("word") != F.col("root")).select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return words.join(links, "word")


def variants(words: DataFrame, times: int = 5, shard_rows: int = 1 << 14, group_rows: int = 1 << 16) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of `words` (word, n; one row a word): a word's form is its near word of largest n, if that is at least `times` the word's."""
    words = cut(words)
    near = words.join(near_words(words, shard_rows, group_rows), "word", "left")
    most = -F.col("best.less")
    holds = most >= times * F.col("n")
    out = near.select("word", F.when(holds, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, most).alias("form_n"))
    return with_roots(cut(out)).select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among all words of all documents, with a sign left out where 199 divides the run's hash."""
    return variants(word_counts(table(spark, sf_dir, "documents"), slip=199))
