"""Quality rules as a short-circuit cascade (op9).

Every rule's cost and selectivity is measured on a bounded sample of rows, chosen by the key's hash; the rules are then run in the
order of rejections per second, each on the rows that the ones before it have kept. The order changes the time and which rule is named
as the first to reject, never the verdict.

Words are runs of `[^\\x20\\x09-\\x0D]`. Null and empty texts have no words and fail the base rules. Repeated rows get one verdict each;
texts of any length are judged whole; an empty table gives no rows. Other columns pass through untouched; one whose name `judge` needs for
a column of its own comes back with `_` before its name.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.base import chunks, table
from spanloom.llm.words import P1, P2, SPACE, Words, covered, mix, prefix, span_hash, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
SIGN = LETTER.copy()
SIGN[128:] = True  # letters, and every sign beyond ASCII


class Texts:
    """Some texts, with what the rules count in them; each count is made when first asked for."""

    def __init__(self, body: np.ndarray, off: np.ndarray):
        self.body, self.off = body, off
        self._words: Words | None = None

    def __len__(self) -> int:
        return len(self.off) - 1

    def only(self, rows: np.ndarray) -> Texts:
        """The given texts alone."""
        n = np.diff(self.off)[rows]
        off = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(off[-1]) + np.repeat(self.off[:-1][rows] - off[:-1], n)
        return Texts(self.body[at], off)

    @property
    def words(self) -> Words:
        if self._words is None:
            self._words = Words(self.body, self.off)
        return self._words

    def total(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text have the flag."""
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[self.off[1:]] - sums[self.off[:-1]]

    def n_words(self) -> np.ndarray:
        return self.words.counts

    def word_chars(self) -> np.ndarray:
        return self.total(~SPACE[self.body] & ((self.body & 0xC0) != 0x80))

    def n_symbols(self) -> np.ndarray:
        return self.total(SYMBOLS[self.body])

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of every line that has a word."""
        if not len(self.body):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        cuts = np.flatnonzero(self.body == 10)
        inner = np.union1d(self.off[:-1], cuts + 1)
        lo = inner[inner < len(self.body)] if len(inner) else inner
        hi = np.append(lo[1:], len(self.body))
        hi = hi - ((hi > lo) & (self.body[np.maximum(hi - 1, 0)] == 10))
        word = np.concatenate([[0], np.cumsum(~SPACE[self.body])])
        has = word[hi] > word[lo]
        lo, hi = lo[has], hi[has]
        h = span_hash(prefix(self.body, P2), lo, hi, P2)
        return h, np.searchsorted(self.off, lo, "right") - 1

    def line_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those of them that equal an earlier one."""
        h, doc = self.lines()
        n = np.bincount(doc, minlength=len(self))
        one = np.unique(np.rec.fromarrays([doc, h])).f0 if len(h) else doc
        return n, n - np.bincount(one, minlength=len(self))

    def n_dup_lines(self) -> np.ndarray:
        return self.line_counts()[1]

    def n_repeat_words(self, k: int = 5) -> np.ndarray:
        """Words in windows of k words that are found twice or more in their text."""
        w = self.words
        start, doc = windows(w.first, k)
        sums = prefix(w.hashes(), P2)
        h = mix(span_hash(sums, start, start + k, P2) ^ mix(doc.astype(np.uint64) * P1 + P2))
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        flags = covered(start[twice], k, len(w))
        return np.bincount(w.doc()[flags], minlength=len(self))

    def stutters(self) -> np.ndarray:
        """Words that equal the word before them."""
        w = self.words
        h, doc = w.hashes(), w.doc()
        same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        return np.bincount(doc[1:][same], minlength=len(self))

    def letter_words(self) -> np.ndarray:
        """Words with a letter."""
        w = self.words
        sums = np.concatenate([[0], np.cumsum(SIGN[self.body])])
        return np.bincount(w.doc()[sums[w.ends] > sums[w.starts]], minlength=len(self))


#: A rule tells which texts it rejects.
Rule = Callable[[Texts], np.ndarray]

BASE: dict[str, Rule] = {
    "few_words": lambda t: t.n_words() < 10,
    "repeats": lambda t: 100 * t.n_repeat_words() > 20 * t.n_words(),
}
RULES: dict[str, Rule] = {
    "symbols": lambda t: 10 * t.n_symbols() > t.n_words(),
    "word_length": lambda t: (2 * t.word_chars() < 5 * t.n_words()) | (t.word_chars() > 12 * t.n_words()),
    "capitals": lambda t: 10 * t.total(UPPER[t.body]) > 3 * t.total(LETTER[t.body]),
    "no_letters": lambda t: 10 * t.letter_words() < 6 * t.n_words(),
    "dup_lines": lambda t: (lambda n, dup: 10 * dup > 4 * n)(*t.line_counts()),
    "stutter": lambda t: 5 * t.stutters() > t.n_words(),
}


def measured(docs: DataFrame, rules: dict[str, Rule], base: dict[str, Rule], key: str = "doc_id", text: str = "text", sample_rows: int = 2000) -> list[str]:
    """The rules' names by rejections per second on those of about `sample_rows` rows that the base rules keep; the texts stay with the executors."""
    n = docs.count()
    if not n:
        return list(rules)
    share = min(1.0, sample_rows / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = {name: [0.0, 0] for name in rules}
        for b in batches:
            for _, body, off in chunks(b, text):
                t = Texts(body, off)
                met = t.only(np.flatnonzero(cascade(t, base, list(base), np.ones(len(t), bool)) < 0))  # what the base rules leave
                for name, rule in rules.items():
                    began = time.perf_counter()
                    got[name][1] += int(rule(Texts(met.body, met.off)).sum())
                    got[name][0] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(list(got)), pa.array([x[0] for x in got.values()]), pa.array([x[1] for x in got.values()], pa.int64())], names=["rule", "s", "hits"])

    chosen = docs.select(text).where(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < int(1_000_003 * share) + 1)
    rows = chosen.mapInArrow(run, "rule string, s double, hits long").groupBy("rule").agg(F.sum("s").alias("s"), F.sum("hits").alias("hits")).collect()  # a row a rule
    worth = {r.rule: r.hits / max(r.s, 1e-9) for r in rows}
    return sorted(rules, key=lambda name: -worth.get(name, 0))


def cascade(t: Texts, rules: dict[str, Rule], order: list[str], alive: np.ndarray) -> np.ndarray:
    """For each text the place in `order` of the rule that rejects it first, or -1; only texts that are still alive meet a rule."""
    first = np.full(len(t), -1)
    rows = np.flatnonzero(alive)
    left = t.only(rows) if len(rows) < len(t) else t
    for i, name in enumerate(order):
        if not len(rows):
            break
        out = rules[name](left)
        first[rows[out]] = i
        rows = rows[~out]
        if out.any():
            left = left.only(np.flatnonzero(~out))
    return first


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def verdicts(body: np.ndarray, off: np.ndarray, rules: dict[str, Rule], base: dict[str, Rule], order: list[str]) -> tuple[Texts, np.ndarray, np.ndarray]:
    """The texts, and for each the place of the base rule and of the other rule that rejects it, or -1."""
    t = Texts(body, off)
    first = cascade(t, base, list(base), np.ones(len(t), bool))
    return t, first, cascade(t, rules, order, first < 0)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: dict[str, Rule] | None = None, base: dict[str, Rule] | None = None, sample_rows: int = 2000, stats: bool = True) -> DataFrame:
    """All columns of `docs` with base_failed, kept and rejected_by, and the base counts if asked for."""
    rules, base = RULES if rules is None else rules, BASE if base is None else base
    order = measured(docs, rules, base, key, text, sample_rows)
    counts = COUNTS * stats
    added = [*counts, "base_failed", "kept", "rejected_by"]
    names: list[str] = []
    for c in docs.columns:
        while c.lower() in {x.lower() for x in [*added, *names]}:
            c = f"_{c}"
        names.append(c)
    at = names[docs.columns.index(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, body, off in chunks(b, at):
                t, first, by = verdicts(body, off, rules, base, order)
                why = [list(base)[i] if i >= 0 else order[j] if j >= 0 else None for i, j in zip(first, by, strict=True)]
                made = {c: getattr(t, c)() for c in counts} | {"base_failed": first >= 0, "kept": (first < 0) & (by < 0)}
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x) for x in made.values()], pa.array(why, pa.string())], names=[*part.schema.names, *added])

    kinds = [f"`{c}` {f.dataType.simpleString()}" for c, f in zip(names, docs.schema.fields, strict=True)]
    return docs.toDF(*names).mapInArrow(run, ", ".join([*kinds, *[f"{c} long" for c in counts], "base_failed boolean, kept boolean, rejected_by string"]))


def passing(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: dict[str, Rule] | None = None, base: dict[str, Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """The rows of `docs` that no rule rejects, with all their columns, whatever their names."""
    rules, base = RULES if rules is None else rules, BASE if base is None else base
    order = measured(docs, rules, base, key, text, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, body, off in chunks(b, text):
                _, first, by = verdicts(body, off, rules, base, order)
                yield part.filter(pa.array((first < 0) & (by < 0)))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).drop("text", "rejected_by")


#: The words of each document, and the same rules as above.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM p WHERE i + 4 <= len(ws)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (SELECT unnest(range(0, 5)) AS j) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n FROM p WHERE i > 1 AND ws[i] = ws[i - 1] GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(ls) AS n_lines, coalesce(s.n, 0) AS stutters, len(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, len(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters,
  len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS lettered
  FROM w LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR 2 * word_chars < 5 * n_words OR word_chars > 12 * n_words OR 10 * upper > 3 * letters
    OR 10 * lettered < 6 * n_words OR 10 * n_dup_lines > 4 * n_lines OR 5 * stutters > n_words) AS kept
FROM f
"""
