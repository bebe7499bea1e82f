"""BAM files in splits: any cut gives the records of one read."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from spanloom.operators import intervals
from spanloom.sources import bam, binary

EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def record(name, flag, ref, pos, ops, letters=0):
    seq = bytes((letters + 1) // 2) + b"\xff" * letters
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(ops), flag, letters, -1, -1, 0) + name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + seq
    return struct.pack("<i", len(body)) + body


def block(data):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def header(refs, order="queryname"):
    text = f"@HD\tVN:1.6\tSO:{order}\n".encode()
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in refs)


def compressed(data, size):
    return b"".join(block(data[i : i + size]) for i in range(0, len(data), size)) + EOF


REFS = [("c1", 5000), ("c2", 900)]


@pytest.fixture(scope="module")
def some():
    rng = random.Random(4)
    out = []
    for i in range(700):
        for mate in "12":
            ref = rng.choice([0, 0, 1])
            ops = [(rng.randint(1, 60), rng.choice([0, 1, 2, 3, 4, 7, 8])) for _ in range(rng.randint(0, 4))]
            out.append((f"r{i}/{mate}", rng.choice([65, 129, 0, 4, 0x100, 0x441]), ref, rng.randint(0, REFS[ref][1] - 1), ops, rng.choice([0, 30, 151])))
    out.insert(300, ("long", 65, 0, 7, [(10, 0)], 9000))
    return out


def expected(some):
    return [(n, f, ref, pos, pos + sum(k for k, o in ops if o in (0, 2, 3, 7, 8)), 60) for n, f, ref, pos, ops, _ in some]


@pytest.mark.parametrize("block_bytes", [800, 4096, 60_000])
def test_any_cut_gives_the_same_records(tmp_path, some, block_bytes):
    raw = compressed(header(REFS) + b"".join(record(*r) for r in some), block_bytes)
    (tmp_path / "a.bam").write_bytes(raw)
    for per in (1 << 30, 20_000, 5000, 1500, 333):
        reader = bam.BamReader({"path": str(tmp_path / "a.bam"), "bytesPerPartition": str(per)})
        got = [[tuple(r.values()) for b in reader.read(p) for r in b.to_pylist()] for p in reader.partitions()]
        flat = [r for part in got for r in part]
        assert [r[1:] for r in flat] == expected(some)
        assert [r[0] for r in flat] == sorted({r[0] for r in flat})
        assert per > 20_000 or sum(map(bool, got)) > 1


def test_records_that_begin_with_blocks_and_a_header_of_several(tmp_path, some):
    refs = [*REFS, *((f"scaffold_number_{i}", 100 + i) for i in range(400))]
    raw = compressed(header(refs), 700)[: -len(EOF)] + b"".join(block(record(*r)) for r in some) + EOF
    (tmp_path / "a.bam").write_bytes(raw)
    reader = bam.BamReader({"path": str(tmp_path / "a.bam"), "bytesPerPartition": "900"})
    assert [tuple(r.values())[1:] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == expected(some)


def test_empty_files_and_folders(spark, tmp_path, some):
    binary.register(spark)
    (tmp_path / "none").mkdir()
    assert spark.read.format("bam_records").load(str(tmp_path / "none")).count() == 0
    (tmp_path / "two").mkdir()
    for name, part in (("a.bam", some[:600]), ("b.bam", some[600:]), ("c.bam", [])):
        (tmp_path / "two" / name).write_bytes(compressed(header(REFS) + b"".join(record(*r) for r in part), 4096))
    df = spark.read.format("bam_records").option("bytesPerPartition", 9000).load(str(tmp_path / "two"))
    assert df.rdd.getNumPartitions() > 3
    assert sorted(tuple(r)[1:] for r in df.collect()) == sorted(expected(some))
    with pytest.raises(ValueError):
        bam.Header(iter([(0, b"BAX\1")]))


def test_coverage_and_contacts_of_reads(spark, tmp_path, some):
    binary.register(spark)
    path = str(tmp_path / "a.bam")
    (tmp_path / "a.bam").write_bytes(compressed(header(REFS) + b"".join(record(*r) for r in some), 4096))
    sequences = spark.createDataFrame([("c2", 900, 5)], "name string, len long, seq long")
    kept = [(ref, beg, min(end, 900)) for _, f, ref, beg, end, _ in expected(some) if not f & 0xF04]
    steps = intervals.coverage(bam.coverage_reads(spark, path, sequences))
    assert steps.agg(F.sum(F.expr("(end - beg) * cov"))).first()[0] == sum(e - b for ref, b, e in kept if ref == 1)
    both = spark.createDataFrame([("c2", 900, 5), ("c1", 5000, 2)], "name string, len long, seq long")
    seqs, lens, want, held = {0: 2, 1: 5}, {0: 5000, 1: 900}, [], None
    for n, f, ref, beg, end, q in expected(some):
        if f & 0xF04 or not f:
            continue
        one = (n.split("/")[0], seqs[ref], min((beg + end) // 2, lens[ref]), q)
        if held and held[0] == one[0]:
            want.append((held[1], held[2], one[1], one[2], q))
            held = None
        else:
            held = one
    assert want and sorted(map(tuple, bam.contact_pairs(spark, path, both).collect())) == sorted(want)
    (tmp_path / "b.bam").write_bytes(compressed(header(REFS, "coordinate"), 4096))
    with pytest.raises(ValueError):
        bam.contact_pairs(spark, str(tmp_path / "b.bam"), both)
