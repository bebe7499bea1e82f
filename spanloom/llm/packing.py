"""Packing documents into sequences by the sum-of-squares rule (op4).

Each document's tokens, with a separator, are cut into full windows and a remainder. A remainder goes whole to the fill level at which
the sum of the squared numbers of partly filled windows grows least; these numbers are an array by level, and a window is found by its
level. At the end of a partition the open windows are closed: the least filled are cut to fill the others exactly, and the one that is left
is cut into lengths that are powers of two, which need no padding. The rule keeps few windows open: about 19 times the square root of
the documents placed, if their lengths are evenly spread (413, 1804, 5980 and 10197 of 1000, 10000, 100000 and 300000).

Windows are packed within a partition of the scan, so nothing is shuffled, a lost task repeats its own work with the same result, and
padding does not grow with the number of partitions. Null texts count as empty: a document of the separator alone. Repeated rows are
packed once each. Other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.base import strings, table

Piece = tuple[int, int, int, bytes]  # document (index), start, the document's tokens, the identifiers' bytes


class Encoder:
    """Identifiers of a byte-level tokenizer as little-endian bytes.

    rank_file: the same vocabulary as ranks, with which texts are encoded several times as fast; texts with special tokens are left to
    the tokenizer itself.
    """

    def __init__(self, tokenizer_file: str, rank_file: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks = self.by_ranks(rank_file) if rank_file else None

    @staticmethod
    def by_ranks(rank_file: str):
        import public_tokenizers
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.ranks is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


class LevelPacker:
    """Packs remainders online; `close` empties what is open. A closed window is a list of pieces."""

    def __init__(self, size: int, max_open: int | None = None):
        self.size, self.max_open = size, max_open
        self.count = np.zeros(2 * size + 1, np.int64)  # windows open at each level; none at 0 and from `size` on
        self.windows: list[list[list[Piece]]] = [[] for _ in range(size)]
        self.open = 0

    def level(self, n: int) -> int:
        """The level at which placing n tokens raises the sum of squares least; the fullest among equals; 0 opens a window."""
        c, m = self.count, self.size
        if not self.open:
            return 0
        after = 2 * c[n : m + 1] + 1  # of the level that the window reaches, from levels 0 to m - n
        after[-1] = 0  # it is full then
        change = after - 2 * c[: m - n + 1] + 1
        change[0] = after[0]
        change[1:][c[1 : m - n + 1] == 0] = 1 << 60
        return m - n - int(np.argmin(change[::-1]))

    def place(self, piece: Piece) -> Iterator[list[Piece]]:
        n = len(piece[3]) // 4
        h = self.level(n)
        if h:
            window = self.windows[h].pop()
            self.count[h] -= 1
            window.append(piece)
        else:
            window, self.open = [piece], self.open + 1
        if h + n == self.size:
            self.open -= 1
            yield window
        else:
            self.windows[h + n].append(window)
            self.count[h + n] += 1
        if self.max_open and self.open > self.max_open:
            yield from self.close()

    def close(self) -> Iterator[list[Piece]]:
        """All open windows: filled with parts of the least filled ones, and the last one in powers of two."""
        todo = deque([(h, w) for h in range(self.size - 1, 0, -1) for w in self.windows[h]])
        self.windows = [[] for _ in range(self.size)]
        self.count[:] = 0
        self.open = 0
        spare: list[Piece] = []  # the pieces of the windows that are given up, taken from the end
        while todo or spare:
            h, window = todo.popleft() if todo else (0, [])
            while h < self.size and (spare or todo):
                if not spare:
                    spare = todo.pop()[1]
                doc, start, total, ids = spare.pop()
                room = 4 * (self.size - h)
                window.append((doc, start, total, ids[:room]))
                h += len(ids[:room]) // 4
                if ids[room:]:
                    spare.append((doc, start + room // 4, total, ids[room:]))
            yield from [window] if h == self.size else self.powers(window)

    @staticmethod
    def powers(window: list[Piece]) -> Iterator[list[Piece]]:
        left, todo = sum(len(p[3]) for p in window) // 4, window[::-1]
        while left:
            room = 1 << (left.bit_length() - 1)
            left, out = left - room, []
            while room:
                doc, start, total, ids = todo.pop()
                part, rest = ids[: 4 * room], ids[4 * room :]
                out.append((doc, start, total, part))
                room -= len(part) // 4
                if rest:
                    todo.append((doc, start + len(part) // 4, total, rest))
            yield out


_encoders: dict[tuple[str, str | None], Encoder] = {}


def encoder(*files: str | None) -> Encoder:
    """One encoder a worker and vocabulary."""
    if files not in _encoders:
        _encoders[files] = Encoder(*files)
    return _encoders[files]


def pack(docs: DataFrame, tokenizer_file: str, rank_file: str | None = None, key: str = "doc_id", text: str = "text", size: int = 1024, separator: int = 0, with_ids: bool = True) -> DataFrame:
    """The pieces of all sequences: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset), and the identifiers themselves if asked for."""
    end = np.array([separator], "<u4").tobytes()
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer_file, rank_file).encode, LevelPacker(size)
        sequence = TaskContext.get().partitionId() << 33
        held: dict[int, list] = {}  # keys of documents with pieces in open windows: value, pieces out of all tokens
        rows: list[tuple] = []
        number = 0

        def emit(window: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, total, ids in window:
                n = len(ids) // 4
                rows.append((held[doc][0], start, n, zlib.crc32(ids), total, sequence, offset, ids))
                offset += n
                held[doc][1] -= n
                if not held[doc][1]:
                    del held[doc]
            sequence += 1

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            types = [key_type] + [pa.int64()] * 6
            out = [pa.array(c, t) for c, t in zip(cols, types, strict=False)]
            if with_ids:
                out.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(out, names=names)

        key_type = None
        for b in batches:
            key_type = b.schema.field(0).type
            for value, t in zip(b.column(0).to_pylist(), strings(b, text), strict=True):
                ids = encode(t.as_py()) + end
                total = len(ids) // 4
                held[number] = [value, total]
                full = total // size * size
                for at in range(0, full, size):
                    emit([(number, at, total, ids[4 * at : 4 * (at + size)])])
                if full < total:
                    for window in packer.place((number, full, total, ids[4 * full :])):
                        emit(window)
                number += 1
                if len(rows) >= 4096:
                    yield batch()
        for window in packer.close():
            emit(window)
        if rows:
            yield batch()

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=False)
