"""Token counts by heap-and-linked-list byte-pair merging (op6).

A text becomes one symbol per character in a doubly linked list; a heap holds every adjacent pair that the vocabulary knows, and the
best-ranked pair (leftmost among equals) is popped and merged until none is left. The count is the initial symbols less the merges,
plus the extra bytes of symbols that the vocabulary lacks; no identifiers are made.

Merges never cross a pair of characters that stand side by side in no vocabulary piece, so a text is cut at such pairs without
changing its count: before each run of spaces, and between signs such as a letter and a comma. The parts' counts
are remembered, up to a bound, as words repeat; a part of any length is merged in O(n log n).

Null texts count as empty: 0 tokens. Ties, repeated rows and empty tables need nothing special; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.base import buffers, strings, table

SPACE = "▁"


class PairMerger:
    """Counts by the merges of a sentencepiece BPE model with byte fallback and no normalisation."""

    def __init__(self, model_file: str, keep: int = 250_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in range(len(sp)) if not special(i)}
        self.lead = sp.encode("a", out_type=str)[0].startswith(SPACE)  # whether a space is put before the text
        #: Two signs that stand side by side in no piece are never merged, so a part may end between them.
        self.pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.whole = not any(x[1] == SPACE != x[0] for x in self.pairs)
        self.words: dict[str, int] = {}
        self.keep = keep

    def merged(self, part: str) -> int:
        """The count of one part, with spaces as the model writes them."""
        rank = self.rank
        n = len(part)
        if n == 1 or part in rank and n == 2:
            return 1 if part in rank else len(part.encode())
        at = list(part)  # the symbol that starts here, "" once merged into another
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i, p) for i in range(n - 1) if (r := rank.get(p := part[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i] if at[i] else n
            if j >= n or len(at[i]) + len(at[j]) != len(p) or at[i] + at[j] != p:
                continue  # one of its symbols has gone into another since
            at[i], at[j] = p, ""
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(q := p + at[k])) is not None:
                    heapq.heappush(heap, (r, i, q))
            if (h := before[i]) >= 0 and (r := rank.get(q := at[h] + p)) is not None:
                heapq.heappush(heap, (r, h, q))
        return n - merges + sum(len(c.encode()) - 1 for c in at if len(c) == 1 and c not in rank)

    def word(self, part: str) -> int:
        """The count of a run of spaces and the run of other signs after it."""
        pairs, words, lo, total = self.pairs, self.words, 0, 0
        for hi in [i for i in range(1, len(part)) if part[i - 1 : i + 1] not in pairs] + [len(part)]:
            x = part[lo:hi]
            c = words.get(x)
            if c is None:
                c = self.merged(x)
                if hi - lo <= 40:
                    words[x] = c
            total += c
            lo = hi
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        words, keep, total = self.words, self.keep, 0
        text = text.replace(" ", SPACE)
        if self.lead:
            text = SPACE + text
        if not self.whole:  # pieces may span spaces
            return self.merged(text)
        parts = text.split(SPACE)
        if "" in parts[1:]:  # several spaces side by side belong to one part
            parts = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", text)
        else:
            parts = [*parts[:1], *map(SPACE.__add__, parts[1:])] if parts[0] else list(map(SPACE.__add__, parts[1:]))
        for p in parts:
            c = words.get(p)
            if c is None:
                c = self.word(p)
                if len(p) <= 40:
                    if len(words) >= keep:
                        words.clear()
                    words[p] = c
            total += c
        return total


_mergers: dict[str, PairMerger] = {}


def merger(model_file: str) -> PairMerger:
    """One merger a worker and model."""
    if model_file not in _mergers:
        _mergers[model_file] = PairMerger(model_file)
    return _mergers[model_file]


def token_counts(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row; the scan's partitions are kept, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = merger(model_file).count
        for b in batches:
            col = strings(b, text)
            n = np.array([count(t) for t in col.to_pylist()], np.int64)
            size = np.diff(buffers(col)[1]) if len(col) else n
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
