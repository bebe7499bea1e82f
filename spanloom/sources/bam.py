"""BAM files read in splits: a block-compressed file is cut anywhere, and each split finds a block's and a record's begin by itself.

A block says in its header how long it is, so a begin is told by the header's fixed bytes and by another block, or the file's end, where it
says it ends. Records may lie across blocks: a split owns the records that begin in blocks that begin in it, reads on for the end of its last
one, and leaves the rest of the first block's open record to the split before. Where a record begins is told by its fields (known
reference, position within it, a printable name that ends where it says, lengths that add up), and by the records that would follow.

A file that isn't compressed in blocks (one long gzip stream) can't be cut and is one split.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spanloom.operators.contacts import pair_adjacent
from spanloom.sources.readers import ranked

# Flags of records that don't count (unmapped, secondary, failed, duplicate, supplementary), a block's first bytes, and the
# kinds of an alignment's operations that use up reference (M, D, N, =, X).
SKIPPED_FLAGS = 0xF04
BLOCK = b"\x1f\x8b\x08\x04"
ON_REFERENCE = 0b110001101
FOLLOWING = 8  # records that have to follow for a begin to count


def usable(flag: Column) -> Column:
    """Whether a record counts for coverage: none of the skipped flags."""
    return flag.bitwiseAND(F.lit(SKIPPED_FLAGS)) == 0


def pairable(flag: Column) -> Column:
    """Whether a record can be a mate: it counts, and has a flag at all."""
    return usable(flag) & (flag != 0)


def located(path: str):
    """The file system of a path or URI, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def opened(path: str):
    system, inner = located(path)
    return system.open_input_file(inner)


def files(path: str) -> list[str]:
    """A file itself, or the files of a folder by name."""
    from pyarrow import fs

    system, inner = located(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    root = path.rstrip("/")
    return [f"{root}/{x.base_name}" for x in sorted(system.get_file_info(fs.FileSelector(inner)), key=lambda x: x.base_name) if x.is_file and not x.base_name.startswith((".", "_"))]


def block_size(head: bytes) -> int:
    """Bytes of the block that begins with `head`, 0 if it is none."""
    if len(head) < 18 or head[:4] != BLOCK:
        return 0
    (extra,) = struct.unpack_from("<H", head, 10)
    at, end = 12, min(12 + extra, len(head))
    while at + 4 <= end:
        kind, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and size == 2 and at + 6 <= end:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return 0


def first_block(f, lo: int, size: int) -> int:
    """Where the first block at or after `lo` begins; `size` if none does."""
    f.seek(lo)
    data = f.read(min(1 << 18, size - lo))
    at = data.find(BLOCK)
    while at >= 0:
        n = block_size(data[at : at + 64])
        if n:
            nxt = lo + at + n
            if nxt == size:
                return lo + at
            f.seek(nxt)
            if block_size(f.read(64)):
                return lo + at
        at = data.find(BLOCK, at + 1)
    return size


def blocks(f, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(where it begins, its text) of each block from `at` on."""
    ahead, base = b"", at
    while at < size:
        if at - base + (1 << 16) > len(ahead) and base + len(ahead) < size:
            ahead, base = ahead[at - base :], at
            f.seek(base + len(ahead))
            ahead += f.read(1 << 22)
        n = block_size(ahead[at - base : at - base + 64])
        if not n:
            raise ValueError(f"no block at byte {at}")
        yield at, zlib.decompress(ahead[at - base : at - base + n], 31)
        at += n


def stream(f) -> Iterator[tuple[int, bytes]]:
    """The text of a file of gzip streams of any length, as if from blocks."""
    data, at = zlib.decompressobj(31), 0
    while True:
        more = f.read(1 << 20)
        if not more:
            return
        while more:
            yield at, data.decompress(more)
            at, more = at + 1, data.unused_data
            if data.eof:
                data = zlib.decompressobj(31)
            else:
                break


class Header:
    """Reference names and lengths, the header's text, and what is left of the blocks that hold it."""

    def __init__(self, parts: Iterator[tuple[int, bytes]]):
        held, self.blocks = bytearray(), []

        def take(n: int) -> bytes:
            while len(held) < n:
                got = next(parts, None)
                if got is None:
                    raise ValueError("a BAM header that ends early")
                self.blocks.append((got[0], len(got[1])))
                held.extend(got[1])
            out = bytes(held[:n])
            del held[:n]
            return out

        whole = lambda: struct.unpack("<i", take(4))[0]
        if take(4) != b"BAM\1":
            raise ValueError("not a BAM file")
        self.text = take(whole()).rstrip(b"\0").decode()
        self.names, self.lengths = [], []
        for _ in range(whole()):
            self.names.append(take(whole())[:-1].decode())
            self.lengths.append(whole())
        self.rest = bytes(held)

    @property
    def first(self) -> tuple[int, int]:
        """The block and the place in it where the first record begins."""
        at, size = self.blocks[-1]
        return at, size - len(self.rest)


def read_header(path: str) -> Header:
    with opened(path) as f:
        size = f.size()
        if block_size(f.read(64)):
            return Header(blocks(f, 0, size))
        f.seek(0)
        return Header(stream(f))


def fits(data, at: int, lengths: np.ndarray) -> int:
    """Where the record at `at` ends if there may be one; -1 if not; 0 if the data end before that can be told."""
    if at + 36 > len(data):
        return 0
    size, ref, pos, name, _, _, ops, _, letters, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if size < 32 + name + 4 * ops or letters < 0 or name < 1 or size < 32 + name + 4 * ops + (letters + 1) // 2 + letters or size > 1 << 28:
        return -1
    n = len(lengths)
    for r, p in ((ref, pos), (mate, mate_pos)):
        if not -1 <= r < n or p < -1 or (r >= 0 and p > lengths[r]):
            return -1
    if at + 36 + name > len(data):
        return 0
    text = bytes(data[at + 36 : at + 36 + name])
    if text[-1] or any(not 33 <= c <= 126 for c in text[:-1]):
        return -1
    return at + 4 + size


def first_record(data, lengths: np.ndarray, last: bool, upto: int) -> int:
    """The first place below `upto` from which records follow one another; -1 if there is none, -2 if more data are needed to tell."""
    for begin in range(min(upto, len(data))):
        at, seen = begin, 0
        while seen < FOLLOWING:
            nxt = fits(data, at, lengths)
            if nxt <= 0:
                break
            at, seen = nxt, seen + 1
            if at >= len(data):
                nxt = 0
                break
        if seen >= FOLLOWING or (last and nxt == 0 and at == len(data) and seen):
            return begin
        if nxt == 0 and not last:
            return -2
    return -1


class Split(InputPartition):
    def __init__(self, path: str, lo: int, hi: int):
        self.path, self.lo, self.hi = path, lo, hi


class BamRecords(DataSource):
    """Records of a BAM file, or of the files of a folder: rank, name, flag, seq, beg, end, q. Ranks grow in file order, within a file.

    Options: path, and bytesPerPartition (compressed; 32 MB).
    """

    @classmethod
    def name(cls) -> str:
        return "bam_records"

    def schema(self) -> str:
        return "rank long, name string, flag int, seq long, beg long, end long, q int"

    def reader(self, schema):
        return BamReader(self.options)


NAMES = ["rank", "name", "flag", "seq", "beg", "end", "q"]


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.per = options["path"], int(options.get("bytesPerPartition", 32 << 20))

    def partitions(self):
        out = []
        for path in files(self.path):
            with opened(path) as f:
                size = f.size()
                cut = block_size(f.read(64)) > 0
            step = max(1, self.per) if cut else size or 1
            out += [Split(path, lo, min(lo + step, size)) for lo in range(0, size, step)]
        return out or [Split(self.path, 0, 0)]

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        if part.lo == part.hi:
            return
        header = read_header(part.path)
        lengths = np.array(header.lengths, np.int64)
        with opened(part.path) as f:
            size = f.size()
            in_blocks = block_size(f.read(64)) > 0
            f.seek(0)
            if not in_blocks:
                yield from self._records(stream(f), lengths, header.first[0], header.first[1], 1 << 62, True)
                return
            begin = first_block(f, part.lo, size) if part.lo else 0
            if begin < part.hi:
                block, skip = header.first if begin <= header.first[0] else (begin, None)
                if block < part.hi:
                    yield from self._records(blocks(f, block, size), lengths, block, skip, part.hi, False)

    @staticmethod
    def _records(parts: Iterator[tuple[int, bytes]], lengths: np.ndarray, first: int, skip: int | None, hi: int, numbered: bool) -> Iterator[pa.RecordBatch]:
        """Batches of the records that begin in blocks below `hi`. skip: the place in block `first` where the first begins; None: to be found."""
        data, at = bytearray(), 0  # at: what of `data` is read
        known: list[tuple[int, int, int]] = []  # (place in data, block, bytes) of the blocks that `data` holds
        done = False  # no more blocks
        rank, found = 0, skip is not None

        def more() -> bool:
            nonlocal done
            got = next(parts, None)
            if got is None:
                done = True
                return False
            if got[0] >= first:
                known.append((len(data), got[0], len(got[1])))
                data.extend(got[1])
            return True

        more()
        while not known and not done:
            more()
        if found:
            at = skip
        while not found:
            own = sum(n for _, b, n in known if b < hi)
            where = first_record(data, lengths, done, own)
            if where >= 0:
                at, found = where, True
            elif where == -2 or (not done and known[-1][1] < hi):
                more()
            else:
                return
        while True:
            while not done and len(data) - at < 1 << 22 and known[-1][1] < hi:
                more()
            end = next((p for p, b, _ in known if b >= hi), len(data))  # records from here on are another split's
            starts = []
            while at < end:
                while len(data) < at + 4 and more():
                    pass
                if len(data) < at + 4:
                    break
                nxt = at + 4 + struct.unpack_from("<i", data, at)[0]
                if nxt > len(data) and starts and not done:
                    break
                while len(data) < nxt and more():
                    pass
                if len(data) < nxt:
                    raise ValueError("a BAM record that ends early")
                starts.append(at)
                at = nxt
            if starts:
                place, block = np.array([p for p, _, _ in known]), np.array([b for _, b, _ in known])
                s = np.array(starts)
                of = np.searchsorted(place, s, "right") - 1
                ranks = rank + np.arange(len(s)) if numbered else (block[of] << 16) + s - place[of]
                rank += len(s)
                yield batch(np.frombuffer(bytes(data), np.uint8), s, ranks)
            if at >= end and (done or known[-1][1] >= hi):
                return
            if not starts and not more():
                return
            gone = [k for k in known if k[0] + k[2] <= at]
            cut = gone[-1][0] + gone[-1][2] if gone else 0
            del data[:cut]
            at -= cut
            known[:] = [(p - cut, b, n) for p, b, n in known if p + n > cut] or [(0, known[-1][1], 0)]


def spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at `lo` and have `n` places."""
    return np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)


def batch(data: np.ndarray, at: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
    """The records at `at`, all at once."""
    head = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("name", "u1"), ("q", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("letters", "<i4"), ("rest", "V12")])
    h = data[at[:, None] + np.arange(36)].copy().view(head).ravel()
    n = h["name"].astype(np.int64) - 1
    names = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(0, np.cumsum(n)).astype(np.int32)), pa.py_buffer(data[spread(at + 36, n)].tobytes()))
    ops = h["ops"].astype(np.int64)
    words = data[spread(at + 37 + n, 4 * ops)].copy().view("<u4").astype(np.int64)
    used = np.where(ON_REFERENCE >> (words & 15) & 1, words >> 4, 0)
    upto = np.append(0, np.cumsum(used))
    last = np.cumsum(ops)
    beg = h["pos"].astype(np.int64)
    cols = [pa.array(rank.astype(np.int64)), names, pa.array(h["flag"].astype(np.int32)), pa.array(h["ref"].astype(np.int64), mask=h["ref"] < 0), pa.array(beg), pa.array(beg + upto[last] - upto[last - ops]), pa.array(h["q"].astype(np.int32))]
    return pa.RecordBatch.from_arrays(cols, names=NAMES)


def references(spark: SparkSession, path: str) -> DataFrame:
    """(seq, name, len) of a BAM file's references."""
    h = read_header(path)
    return spark.createDataFrame([(i, n, size) for i, (n, size) in enumerate(zip(h.names, h.lengths, strict=True))], "seq long, name string, len long")


def sorted_by_name(path: str) -> bool:
    """Whether the header says that records are in order of their names, as pairing needs it."""
    return any(line.startswith("@HD") and "\tSO:queryname" in line for line in read_header(path).text.splitlines())


def own_numbers(reads: DataFrame, refs: DataFrame, sequences: DataFrame) -> DataFrame:
    """Reads by the numbers of `sequences` (name, len, seq) in place of the file's; those on others go, and positions are held within lengths."""
    to = refs.select(F.col("seq").alias("__ref"), "name").join(sequences.select("name", F.col("seq").alias("__seq"), F.col("len").alias("__len")), "name").drop("name")
    held = lambda c: F.greatest(F.lit(0).cast("long"), F.least(F.col(c), F.col("__len")))
    r = reads.join(to, F.col("seq") == F.col("__ref"))
    return r.withColumns({"seq": F.col("__seq"), "beg": held("beg"), "end": held("end")}).drop("__ref", "__seq", "__len")


def coverage_reads(spark: SparkSession, path: str, sequences: DataFrame) -> DataFrame:
    """(seq, beg, end) of the records that count, for `intervals.coverage`."""
    reads = spark.read.format("bam_records").load(path).where(usable(F.col("flag")))
    return own_numbers(reads, references(spark, files(path)[0]), sequences).select("seq", "beg", "end")


def contact_pairs(spark: SparkSession, path: str, sequences: DataFrame) -> DataFrame:
    """(aseq, apos, bseq, bpos, q): neighbouring mates of a file that is sorted by name; a pair with an end on another sequence goes."""
    if not sorted_by_name(path):
        raise ValueError(f"{path} is not sorted by read name")
    reads = spark.read.format("bam_records").load(path).where(pairable(F.col("flag")))
    placed = ranked(reads.withColumn("place", F.monotonically_increasing_id()).drop("rank"))
    stem = placed.withColumn("stem", F.regexp_replace("name", "/[12]$", ""))
    pairs = pair_adjacent(stem.select("rank", "stem", F.col("seq").alias("seq"), "beg", "end", "q"))
    to = references(spark, path).select(F.col("seq").alias("__ref"), "name").join(sequences.select("name", F.col("seq").alias("__seq"), F.col("len").alias("__len")), "name").drop("name")
    for end in "ab":
        side = to.select(*(F.col(c).alias(f"{c}_{end}") for c in to.columns))
        pos = F.greatest(F.lit(0).cast("long"), F.least(F.col(f"{end}pos"), F.col(f"__len_{end}")))
        pairs = pairs.join(side, F.col(f"{end}seq") == F.col(f"__ref_{end}")).withColumns({f"{end}seq": F.col(f"__seq_{end}"), f"{end}pos": pos}).drop(f"__ref_{end}", f"__seq_{end}", f"__len_{end}")
    return pairs.select("aseq", "apos", "bseq", "bpos", "q")
