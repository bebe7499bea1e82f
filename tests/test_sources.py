"""Readers, data sources and writers on small files."""

import gzip
import struct
import zlib

import numpy as np

from spanloom.operators import contacts, layout
from spanloom.sources import binary, readers, writers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_index_and_fasta(spark, tmp_path):
    i = readers.index(spark, put(tmp_path, "a.idx", "c1\t100\textra\n\nc2 5\nc3\t50\nc1\t7\n"), 10)
    assert rows(i.select("name", "len", "seq")) == [("c1", 100, 0), ("c3", 50, 1)]
    f = readers.fasta(spark, put(tmp_path, "a.fa", ">c1 note\nACG\r\nTT\n>c2\nA\n"))
    assert rows(f.select("name", "len", "seq", "text")) == [("c1", 5, 0, "ACGTT"), ("c2", 1, 1, "A")]
    f = readers.fasta(spark, put(tmp_path, "b.fa", ">s1 from a>b note\r\nAC\r\nG\r\n>s2\n\n>s3>x y\nTT"))
    assert rows(f.select("name", "len", "text")) == [("s1", 3, "ACG"), ("s2", 0, ""), ("s3>x", 2, "TT")]
    q = readers.fastq(spark, put(tmp_path, "a.fq", "@r1 x\nACGT\n+\nIIII\n@r2\nA\n+\nI\n"))
    assert rows(q.select("name", "text", "quality")) == [("r1", "ACGT", "IIII"), ("r2", "A", "I")]
    g = readers.gfa(spark, put(tmp_path, "a.gfa", "H\tx\nS\ts1\t*\tLN:i:40\nS\ts2\tACG\n"))
    assert rows(g.select("name", "len")) == [("s1", 40), ("s2", 3)]


def test_agp_round_trip(spark, tmp_path):
    text = "# c\no1\t1\t10\t1\tW\tc1\t1\t10\t+\no1\t11\t110\t2\tN\t100\tscaffold\tyes\tproximity_ligation\no1\t111\t115\t3\tW\tc2\t3\t7\t-\no2\t1\t4\t1\tW\tc3\t1\t4\t?\n"
    p = readers.agp(spark, put(tmp_path, "a.agp", text))
    o = layout.offsets(p)
    assert rows(o.select("object", "comp", "x", "y", "rev", "a", "b")) == [("o1", "c1", 0, 10, False, 0, 0), ("o1", "c2", 2, 5, True, 10, 110)]
    writers.agp(layout.agp(o), str(tmp_path / "out"))
    again = layout.offsets(readers.agp(spark, str(tmp_path / "out")))
    assert rows(again.select("object", "comp", "x", "y", "rev", "b")) == rows(o.select("object", "comp", "x", "y", "rev", "b"))
    assert readers.agp(spark, str(tmp_path / "a.agp"), allow_unknown=True).count() == 4


def test_paf(spark, tmp_path):
    good = "a\t100\t0\t50\t-\tb\t80\t10\t60\t40\t50\t60\tx:i:1\n"
    path = put(tmp_path, "a.paf", good + "a\t100\t0\n" + good.replace("\t50\t-", "\t150\t-") + good.replace("80", "81"))
    s = spark.createDataFrame([("a", 100, 0), ("b", 80, 1)], "name string, len long, seq long")
    assert rows(readers.paf(spark, path, s)) == [(0, 1, True, 0, 50, 10, 60, 40, 50, 60)]
    assert readers.paf(spark, path).count() == 2


def test_reads(spark, tmp_path):
    s = spark.createDataFrame([("a", 100, 0), ("b", 80, 1)], "name string, len long, seq long")
    with gzip.open(tmp_path / "r.bed.gz", "wt") as f:
        f.write("a\t0\t10\tr1/1\t30\nb\t70\t90\tr1/2\t20\na\t5\t7\tr2\t9\nz\t5\t7\tr3\t9\nb\t5\t7\tr3\t9\n")
    assert [r for r in rows(contacts.pair_adjacent(readers.bed_reads(spark, str(tmp_path / "r.bed.gz"), s)).where("aseq is not null and bseq is not null"))] == [(0, 5, 1, 75, 20)]
    p = readers.pa5(spark, put(tmp_path, "r.pa5", "r1\ta\t0\tb\t10\t9\t8\nr2\tz\t0\tb\t10\t9\t8\n"), s, 20)
    assert rows(p) == [(0, 10, 1, 20, 8)]


def test_small_tables(spark, tmp_path):
    g = readers.genes(spark, put(tmp_path, "g.tsv", "# x\ng1\tComplete\tc1\t20\t11\t+\ng2\tMissing\ng3\tFragmented\tc1\t1\t5\t-\ng4\tComplete\tc1\n"))
    assert sorted(rows(g), key=str) == sorted([("g1", "COMPLETE", "c1", 10, 20, "+"), ("g2", "MISSING", None, None, None, None), ("g3", "FRAGMENTED", "c1", 0, 5, "-")], key=str)
    r = readers.regions(spark, put(tmp_path, "r.txt", "c1 7\nc2\nc3 2 9\n"))
    assert sorted(rows(r), key=str) == sorted([("c1", 6, 7), ("c2", None, None), ("c3", 2, 9)], key=str)
    b = readers.placements(spark, put(tmp_path, "p.txt", "c1\t0\t10\t-\t1\t2\t500\nshort\t1\n"), 2)
    assert rows(b) == [("c1", 0, 10, True, 1, 2, 500)]
    f, o = readers.signed_lines(spark, put(tmp_path, "x.assembly", ">c1 1 10\n>c2 2 20\n1 -2\n"))
    frags = f.select("id", "name", "len").withColumnsRenamed({"name": "comp", "len": "y"}).selectExpr("id", "comp", "0L as x", "y")
    assert rows(layout.from_signed(o, frags)) == [(1, 1, "c1", 0, 10, False), (1, 2, "c2", 0, 20, True)]


def test_contact_map_round_trip(spark, tmp_path):
    s = spark.createDataFrame([(0, "a", 100), (1, "b", 80)], "seq long, name string, len long")
    c = spark.createDataFrame([(0, 1, 1, 2, 5)], "aseq long, abin long, bseq long, bbin long, n long")
    writers.contact_map(s, c, writers.map_width(180, 10), str(tmp_path / "m"))
    seqs, width, got, _ = readers.contact_map(spark, str(tmp_path / "m"))
    assert rows(seqs) == rows(s) and rows(width) == [(18,)] and rows(got) == rows(c)


def test_contact_records(spark, tmp_path):
    binary.register(spark)
    r = np.array([(0, 3, 5, 1, 10, 11, 9), (1, 0, 4, 1, 8, 9, 7)], binary.RAW_TYPE)
    (tmp_path / "a.bin").write_bytes(binary.contact_bytes(["x", "y"], [100, 50], r))
    assert rows(spark.read.format("contact_records").option("recordsPerPartition", "1").load(str(tmp_path / "a.bin"))) == [(0, 4, 1, 10, 9), (1, 2, 1, 8, 7)]
    c = np.array([(0, 4, 1, 10, 9)], binary.COMPACT_TYPE)
    (tmp_path / "b.bin").write_bytes(binary.contact_bytes(["x", "y"], [100, 50], c))
    assert rows(spark.read.format("contact_records").load(str(tmp_path / "b.bin"))) == [(0, 4, 1, 10, 9)]


def test_bam(spark, tmp_path):
    binary.register(spark)

    def record(name, flag, ref, pos, ops):
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(ops), flag, 0, -1, -1, 0) + name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops)
        return struct.pack("<i", len(body)) + body

    text = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 100) + record("r1", 65, 0, 10, [(5, 0), (2, 2), (3, 1)]) + record("r1", 129, 0, 50, [(4, 0)])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    (tmp_path / "a.bam").write_bytes(z.compress(text) + z.flush())
    assert rows(spark.read.format("bam_records").load(str(tmp_path / "a.bam"))) == [(0, "r1", 65, 0, 10, 17, 60), (1, "r1", 129, 0, 50, 54, 60)]


def test_typed_lines(spark, tmp_path):
    binary.register(spark)
    p = put(tmp_path, "a.txt", "1 3 aln 2 1\nA 0 10 60 1 5 45\nL 100 90\nR\nD 6\nA 2 0 10 3 0 10\n")
    assert rows(spark.read.format("typed_alignments").load(p)) == [(0, 10, 60, 1, 45, 85, True, 100, 90, 6, 42), (2, 0, 10, 3, 0, 10, False, None, None, 0, 10)]
    m = put(tmp_path, "m.txt", "1 3 map 1 0\nS 1 150\nU 1 4 100\nS 2 150\nU 1 5 -20\n")
    assert rows(spark.read.format("typed_mappings").load(m)) == [(1, 150, 4, 100, False), (2, 150, 5, 20, True)]


def test_writers(spark, tmp_path):
    t = spark.createDataFrame([("a", "ACGT" * 20)], "name string, seq string")
    writers.fasta(t, str(tmp_path / "fa"))
    assert rows(readers.fasta(spark, str(tmp_path / "fa")).select("name", "text")) == [("a", "ACGT" * 20)]
    assert "\n".join(x.value for x in spark.read.text(str(tmp_path / "fa")).collect()) == ">a\n" + "ACGT" * 15 + "\n" + "ACGT" * 5


def test_dictionaries_match(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "name string, len long")
    assert readers.mismatches(a, a).count() == 0
    assert readers.mismatches(a, spark.createDataFrame([("x", 1), ("y", 3)], "name string, len long")).count() == 2
