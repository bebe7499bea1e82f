"""Overlap joins, carried pairs, and contact files written by several tasks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import intervals, layout
from spanloom.sources import binary, readers, writers


def spans(rng, n, seqs=2, top=300_000):
    out = []
    for i in range(n):
        beg = rng.randint(-500, top)
        out.append((0 if rng.random() < 0.9 else rng.randint(1, seqs), beg, beg + rng.choice([1, 3, 60, 64, 65, 4000, 90_000, 0]), i))
    return out


def test_overlap_join_of_short_and_long_intervals(spark):
    rng = random.Random(6)
    a, b = spans(rng, 150), spans(rng, 120)
    x = spark.createDataFrame(a, "a_seq long, a_beg long, a_end long, i long").repartition(3)
    y = spark.createDataFrame(b, "b_seq long, b_beg long, b_end long, j long").repartition(2)
    got = sorted((r.i, r.j) for r in intervals.overlap_join(x, y).collect())
    assert got == sorted((p[3], q[3]) for p in a for q in b if p[0] == q[0] and p[1] < p[2] and q[1] < q[2] and p[1] < q[2] and q[1] < p[2])
    assert intervals.overlap_join(x.limit(0), y).count() == 0
    plan = intervals.overlap_join(x, y)._jdf.queryExecution().optimizedPlan().toString()
    assert any("__bin_a" in line and "__bin_b" in line for line in plan.splitlines() if "Join Inner" in line)


def test_next_mark(spark):
    rng = random.Random(8)
    points = [(rng.randint(0, 2), rng.randint(0, 60)) for _ in range(200)]
    marks = [(s, e) for s in (0, 1) for e in rng.sample(range(0, 50), 9)]
    got = {(r.seq, r.pos): r.end for r in layout.next_mark(spark.createDataFrame(points, "seq long, pos long"), spark.createDataFrame(marks, "seq long, end long")).collect()}
    want = {(s, p): min(e for t, e in marks if t == s and e > p) for s, p in points if any(t == s and e > p for t, e in marks)}
    assert got == want


def test_pairs_are_carried_whole_or_not_at_all(spark):
    parts = spark.createDataFrame([("o", 1, 0, 100, False, 0), ("o", 1, 100, 50, True, 200), ("p", 2, 10, 30, False, 5)], "object string, comp long, x long, y long, rev boolean, b long")
    pairs = [(1, 10, 20, 2, 10, 40), (1, 90, 110, 2, 10, 40), (1, 100, 150, 1, 120, 120), (1, 0, 100, 2, 9, 12), (1, 5, 5, 2, 39, 40), (3, 0, 1, 1, 0, 1)]
    df = spark.createDataFrame([(*p, i) for i, p in enumerate(pairs)], "aseq long, abeg long, aend long, bseq long, bbeg long, bend long, i long")
    got = {r.i: (r.aseq, r.abeg, r.aend, r.bseq, r.bbeg, r.bend) for r in layout.pairs_lifted(df, parts).collect()}
    # on the reversed slice position 120 is the 30th from its end at 250
    assert got == {0: ("o", 10, 20, "p", 5, 35), 2: ("o", 200, 250, "o", 229, 229), 4: ("o", 5, 5, "p", 34, 35)}


def test_backbones_need_both_ends(spark):
    sequences = spark.createDataFrame([(1, 100, False), (2, 100, True)], "seq long, len long, rev boolean")
    marks = spark.createDataFrame([(1, 40, 10, 40), (1, 100, 11, 55), (2, 100, 12, 100)], "seq long, end long, target long, size long")
    pairs = [(1, 0, 40, 2, 0, 10), (1, 30, 41, 2, 0, 10), (1, 44, 50, 2, 0, 1), (1, 45, 50, 2, 99, 100), (1, 40, 45, 1, 0, 1)]
    df = spark.createDataFrame([(*p, i) for i, p in enumerate(pairs)], "aseq long, abeg long, aend long, bseq long, bbeg long, bend long, i long")
    got = {r.i: (r.aseq, r.abeg, r.aend, r.bseq, r.bbeg, r.bend) for r in layout.on_backbone(df, sequences, marks).collect()}
    assert got == {0: (10, 0, 40, 12, 90, 100), 3: (11, 0, 5, 12, 0, 1)}


def contact_rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = sorted((rng.randint(0, 2), rng.randint(0, 2)))
        out.append((a, rng.randint(0, 900), b, rng.randint(0, 900), rng.randint(0, 60)))
    return out


@pytest.fixture
def dictionary(spark):
    return spark.createDataFrame([("x", 1000, 0), ("y", 1000, 1), ("z", 1000, 2)], "name string, len long, seq long")


def test_contact_file_of_two_libraries(spark, tmp_path, dictionary):
    one, two = contact_rows(700), contact_rows(300, 2)
    kind = "aseq long, apos long, bseq long, bpos long, q int"
    path = str(tmp_path / "c.bin")
    writers.contact_file([spark.createDataFrame(one, kind), spark.createDataFrame(two, kind)], dictionary, path, parts=4, records_per_file=150)
    parts = sorted(tmp_path.joinpath("c.bin").glob("part-*"))
    assert len({p.name.split("-")[1] for p in parts}) == 4 and len(parts) >= 7 and not (tmp_path / "c.bin/_temporary").exists()
    assert json.loads((tmp_path / "c.bin/_SUCCESS").read_text()) == {"files": len(parts), "records": 1000}
    got = readers.contacts(spark, path, dictionary)
    assert sorted(map(tuple, got.collect())) == sorted(one + two)
    firsts = [tuple(r)[:2] for r in spark.read.format("contact_records").load(path).collect()]
    assert firsts == sorted(firsts)  # ranges in order of the files
    writers.contact_file([spark.createDataFrame(one[:5], kind)], dictionary, path)
    assert readers.contacts(spark, path, dictionary).count() == 5


def test_raw_contact_file_and_its_order(spark, tmp_path, dictionary):
    rows = [(2, 10, 20, 0, 30, 41, 300), (1, 5, 5, 1, 2, 3, -1)]
    df = spark.createDataFrame(rows, "aseq long, abeg long, aend long, bseq long, bbeg long, bend long, q int")
    writers.contact_file([df], dictionary, str(tmp_path / "r.bin"))
    assert sorted(map(tuple, readers.contacts(spark, str(tmp_path / "r.bin"), dictionary).collect())) == [(0, 35, 2, 15, 255), (1, 5, 1, 2, 0)]


def test_a_failed_task_leaves_nothing(spark, tmp_path, dictionary):
    binary.register(spark)
    df = spark.range(400).repartition(4).select(F.when(F.col("id") == 399, -1).otherwise(F.col("id") % 3).alias("aseq"), F.lit(1).cast("long").alias("apos"), F.lit(2).cast("long").alias("bseq"), F.lit(3).cast("long").alias("bpos"), F.lit(4).alias("q"))
    head = json.dumps({"names": ["x", "y", "z"], "lengths": [1000] * 3})
    with pytest.raises(Exception, match="outside"):
        df.write.format("contact_records").option("dictionary", head).mode("append").save(str(tmp_path / "f"))
    assert not [p for p in tmp_path.joinpath("f").rglob("*") if p.is_file()] if (tmp_path / "f").exists() else True
    good = df.where("aseq >= 0")
    good.write.format("contact_records").option("dictionary", head).mode("append").save(str(tmp_path / "f"))
    with pytest.raises(Exception, match="empty"):
        good.write.format("contact_records").option("dictionary", head).mode("append").save(str(tmp_path / "f"))
    assert spark.read.format("contact_records").load(str(tmp_path / "f")).count() == 399


def test_backbone_contacts_come_with_norms(spark, tmp_path):
    sequences = spark.createDataFrame([(1, 3000, False)], "seq long, len long, rev boolean")
    marks = spark.createDataFrame([(1, 3000, 0, 3000)], "seq long, end long, target long, size long")
    backbones = spark.createDataFrame([("b", 3000, 0)], "name string, len long, seq long")
    pairs = spark.createDataFrame([(1, 10, 60, 1, 2500, 2550), (1, 20, 70, 1, 2990, 3001)], "aseq long, abeg long, aend long, bseq long, bbeg long, bend long")
    writers.backbone_contacts(pairs, marks, sequences, backbones, str(tmp_path / "o"), 1000)
    assert [tuple(r) for r in spark.read.format("contact_records").load(str(tmp_path / "o/contacts")).collect()] == [(0, 35, 0, 2525, 255)]
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "o/norms")).collect()) == [(0, 0), (0, 1), (0, 2)]


def test_one_reader_for_each_kind_of_input(spark, tmp_path, dictionary):
    (tmp_path / "r.1map").write_text("1 3 map 1 0\nS 1 150\nU 1 1 100\nS 2 150\nU 1 2 -20\nS 3 150\nU 1 2 7\n")
    assert [tuple(r) for r in readers.contacts(spark, str(tmp_path / "r.1map"), dictionary).collect()] == [(1, 175, 2, 95, 255)]
    (tmp_path / "r.bed").write_text("x\t0\t10\tr1/1\t30\ny\t70\t90\tr1/2\t20\n")
    assert [tuple(r) for r in readers.contacts(spark, str(tmp_path / "r.bed"), dictionary).collect()] == [(0, 5, 1, 80, 20)]
    (tmp_path / "t").write_text("1 3 aln 2 1\nA 0 10 60 1 5 45\nL 100 90\nD 6\nA 0 9 9 1 5 45\n")
    (tmp_path / "p").write_text("x\t1000\t0\t50\t-\ty\t1000\t10\t60\t40\t50\t60\n")
    assert [tuple(r) for r in readers.alignments(spark, str(tmp_path / "t")).collect()] == [(0, 1, False, 10, 60, 5, 45, 42)]
    assert [tuple(r) for r in readers.alignments(spark, str(tmp_path / "p"), dictionary).collect()] == [(0, 1, True, 0, 50, 10, 60, 40)]
    assert [readers.contact_kind(x) for x in ("a.BAM", "b.bed.gz", "c.pa5", "d.bin/", "e.1map")] == ["bam", "bed", "pa5", "bin", "map"]
    with pytest.raises(ValueError):
        readers.contact_kind("a.txt")
    with pytest.raises(ValueError):
        readers.alignments(spark, str(tmp_path / "p"))
