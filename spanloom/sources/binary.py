"""Binary and typed-line formats as Spark data sources: contact records, BAM (in `bam`), and typed-line alignment and mapping files.

Files are opened through pyarrow's file systems, so a URI of any store that pyarrow knows works on every executor. Register them with
`register(spark)`; then `spark.read.format("contact_records").load(path)` and so on.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from spanloom.sources.bam import BamRecords, files, located, opened

# Magic numbers of raw (25-byte) and compact (17-byte) contact files.
RAW, COMPACT = 0x414C4E4842494E56 | 0x1, 0x5941485342494E56 | 0x2
RAW_TYPE = np.dtype([("aseq", "<u4"), ("abeg", "<u4"), ("aend", "<u4"), ("bseq", "<u4"), ("bbeg", "<u4"), ("bend", "<u4"), ("q", "u1")])
COMPACT_TYPE = np.dtype([("aseq", "<u4"), ("apos", "<u4"), ("bseq", "<u4"), ("bpos", "<u4"), ("q", "u1")])


class Span(InputPartition):
    def __init__(self, path: str, beg: int, end: int):
        self.path, self.beg, self.end = path, beg, end


def contact_header(f) -> tuple[bool, list[str], list[int], int, int]:
    """Whether records are raw, the dictionary's names and lengths, the number of records, and where they begin."""
    magic, n = struct.unpack("<qI", f.read(12))
    if magic not in (RAW, COMPACT):
        raise ValueError("not a contact file")
    lengths = list(struct.unpack(f"<{n}I", f.read(4 * n)))
    (size,) = struct.unpack("<Q", f.read(8))
    names = f.read(size).decode().split(" ")[:n]
    (count,) = struct.unpack("<Q", f.read(8))
    return magic == RAW, names, lengths, count, 12 + 4 * n + 8 + size + 8


def contact_bytes(names: list[str], lengths: list[int], records: np.ndarray) -> bytes:
    """A contact file of records of RAW_TYPE or COMPACT_TYPE."""
    text = "".join(f"{x} " for x in names).encode()
    magic = RAW if records.dtype == RAW_TYPE else COMPACT
    return struct.pack("<qI", magic, len(names)) + struct.pack(f"<{len(names)}I", *lengths) + struct.pack("<Q", len(text)) + text + struct.pack("<Q", len(records)) + records.tobytes()


class ContactRecords(DataSource):
    """Records as (aseq, apos, bseq, bpos, q), raw ends as their middles; a file, or the files of a folder, split by ranges of records.

    Written, they are a folder of whole contact files, `recordsPerFile` records each at most. Options: path; `dictionary` (JSON of `names` and `lengths`);
    columns aseq, abeg, aend, bseq, bbeg, bend, q make raw files, aseq, apos, bseq, bpos, q compact ones. Tasks write below `_temporary`;
    once all are done the files are moved to their place and counted in `_SUCCESS`, and if one fails all of them are removed.
    """

    @classmethod
    def name(cls) -> str:
        return "contact_records"

    def schema(self) -> str:
        return "aseq long, apos long, bseq long, bpos long, q int"

    def reader(self, schema):
        return ContactReader(self.options)

    def writer(self, schema, overwrite: bool):
        return ContactWriter(self.options, [f.name for f in schema.fields], overwrite)


class ContactReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.per = options["path"], int(options.get("recordsPerPartition", 4_000_000))

    def partitions(self):
        out, known = [], None
        for path in files(self.path):
            with opened(path) as f:
                _, names, lengths, count, _ = contact_header(f)
            if known is not None and known != (names, lengths):
                raise ValueError(f"{path} has another dictionary than the files before it")
            known = names, lengths
            out += [Span(path, i, min(i + self.per, count)) for i in range(0, count, self.per)]
        return out or [Span(self.path, 0, 0)]

    def read(self, part: Span) -> Iterator[pa.RecordBatch]:
        if part.beg == part.end:
            return
        with opened(part.path) as f:
            raw, _, _, _, start = contact_header(f)
            kind = RAW_TYPE if raw else COMPACT_TYPE
            for at in range(part.beg, part.end, 1 << 18):
                n = min(1 << 18, part.end - at)
                f.seek(start + at * kind.itemsize)
                r = np.frombuffer(f.read(n * kind.itemsize), kind)
                mid = lambda s: (r[f"{s}beg"].astype(np.int64) + r[f"{s}end"]) // 2 if raw else r[f"{s}pos"].astype(np.int64)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r["aseq"].astype(np.int64), mid("a"), r["bseq"].astype(np.int64), mid("b"), r["q"].astype(np.int32))], names=["aseq", "apos", "bseq", "bpos", "q"])


@dataclass
class Written(WriterCommitMessage):
    """The files of a task, with their records."""

    files: list[tuple[str, int]]


class ContactWriter(DataSourceArrowWriter):
    def __init__(self, options, columns: list[str], overwrite: bool):
        self.path, self.per, self.overwrite = options["path"].rstrip("/"), int(options.get("recordsPerFile", 4_000_000)), overwrite
        self.names, self.lengths = (json.loads(options["dictionary"])[k] for k in ("names", "lengths"))
        kinds = [k for k in (RAW_TYPE, COMPACT_TYPE) if set(k.names) == set(columns)]
        if not kinds:
            raise ValueError(f"a contact file has the columns {RAW_TYPE.names} or {COMPACT_TYPE.names}")
        self.raw, self.job = kinds[0] is RAW_TYPE, uuid.uuid4().hex

    @property
    def temporary(self) -> str:
        return f"{self.path}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task, kind = TaskContext.get(), RAW_TYPE if self.raw else COMPACT_TYPE
        system, inner = located(self.temporary)
        system.create_dir(inner, recursive=True)
        done: list[tuple[str, int]] = []
        held: list[np.ndarray] = []

        def flush() -> None:
            records = np.concatenate(held)
            held.clear()
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):03d}.bin"
            with system.open_output_stream(f"{inner}/{name}") as out:
                out.write(contact_bytes(self.names, self.lengths, records))
            done.append((name, len(records)))

        for b in iterator:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, self.per - sum(map(len, held)))
                records = np.empty(part.num_rows, kind)
                for c in kind.names:
                    value = part.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                    most = len(self.names) - 1 if c.endswith("seq") else np.iinfo(kind[c]).max
                    if len(value) and not (value.min() >= 0 and value.max() <= most):
                        raise ValueError(f"{c} has values outside 0 to {most}, or none")
                    records[c] = value
                held.append(records)
                at += part.num_rows
                if sum(map(len, held)) == self.per:
                    flush()
        if held:
            flush()
        return Written(done)

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, inner = located(self.path)
        there = [x for x in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if x.is_file]
        if there and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.path} isn't empty")
        for x in there:
            system.delete_file(x.path)
        parts = [x for m in messages if m is not None for x in m.files]
        _, temporary = located(self.temporary)
        for name, _ in parts:
            system.move(f"{temporary}/{name}", f"{inner}/{name}")
        self._clear()
        with system.open_output_stream(f"{inner}/_SUCCESS") as out:
            out.write(json.dumps({"files": len(parts), "records": sum(n for _, n in parts)}).encode())

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        """Removes what this job has below `_temporary`, and that folder if no other job uses it."""
        from pyarrow import fs

        system, inner = located(f"{self.path}/_temporary")
        _, own = located(self.temporary)
        if system.get_file_info(own).type == fs.FileType.Directory:
            system.delete_dir(own)
        if system.get_file_info(inner).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(inner)):
            system.delete_dir(inner)


class TypedAlignments(DataSource):
    """Alignments of a typed-line text file: aread, abpos, aepos, bread, bbpos, bepos, rev, alen, blen, diffs, mlen.

    An object line 'A' has a, its range, b and its range; the lines after it add lengths (L), reversal (R: b's range is on the other
    strand, and is turned back if b's length is known) and differences (D). Matches are half of the two ranges' length less the differences.
    """

    @classmethod
    def name(cls) -> str:
        return "typed_alignments"

    def schema(self) -> str:
        return "aread long, abpos long, aepos long, bread long, bbpos long, bepos long, rev boolean, alen long, blen long, diffs long, mlen long"

    def reader(self, schema):
        return TypedAlignmentReader(self.options)


class TypedAlignmentReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        return [Span(self.path, 0, 0)]

    def read(self, part: Span) -> Iterator[tuple]:
        def made(r: dict) -> tuple:
            a, ab, ae, b, bb, be = r["A"]
            alen, blen = r.get("L", (None, None))
            if r.get("R") and blen is not None:
                bb, be = blen - be, blen - bb
            diffs = r.get("D", (0,))[0]
            return a, ab, ae, b, bb, be, bool(r.get("R")), alen, blen, diffs, (ae - ab + be - bb - diffs) // 2

        with opened(part.path) as f:
            r: dict = {}
            for line in f.read().decode().splitlines():
                kind, *rest = line.split()[:7] or [""]
                if kind == "A":
                    if r:
                        yield made(r)
                    r = {"A": tuple(map(int, rest))}
                elif r and kind == "R":
                    r["R"] = True
                elif r and kind in ("L", "D"):
                    r[kind] = tuple(map(int, rest))
            if r:
                yield made(r)


class TypedMappings(DataSource):
    """Unique mappings of a typed-line text file: read, seq, pos (negative offsets are reversed reads). Mates are an odd read and the next one."""

    @classmethod
    def name(cls) -> str:
        return "typed_mappings"

    def schema(self) -> str:
        return "read long, len long, seq long, pos long, rev boolean"

    def reader(self, schema):
        return TypedMappingReader(self.options)


class TypedMappingReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        return [Span(self.path, 0, 0)]

    def read(self, part: Span) -> Iterator[tuple]:
        with opened(part.path) as f:
            read = length = None
            for line in f.read().decode().splitlines():
                kind, *rest = line.split() or [""]
                if kind == "S":
                    read, length = int(rest[0]), int(rest[1])
                elif kind == "U" and read is not None:
                    at = int(rest[2])
                    yield read, length, int(rest[1]), abs(at), at < 0


def register(spark: SparkSession) -> None:
    for kind in (ContactRecords, BamRecords, TypedAlignments, TypedMappings):
        spark.dataSource.register(kind)
