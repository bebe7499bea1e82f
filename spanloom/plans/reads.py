"""Registered queries over reads, and over files that Spark writes from the supplied tables and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import contacts, intervals, layout, stats
from spanloom.operators.written import shared_folder
from spanloom.plans import adapters as ad
from spanloom.plans.queries import _MERGED, _SLICES, _pairs, _slices, query
from spanloom.session import table
from spanloom.sources import bam, readers, writers


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_FLAGGED = 'flagged AS (SELECT l_suppkey AS seq, (l_orderkey * 7 + l_linenumber * 13) % 19000 AS beg, (l_orderkey * 7 + l_linenumber * 13) % 19000 + l_quantity::BIGINT * 20 AS "end", (l_orderkey * 37 + l_partkey * 5) % 4096 AS flag FROM lineitem)'


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    beg = F.expr("(l_orderkey * 7 + l_linenumber * 13) % 19000")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("seq"), beg.alias("beg"), (beg + F.col("l_quantity").cast("long") * 20).alias("end"), F.expr("(l_orderkey * 37 + l_partkey * 5) % 4096").cast("int").alias("flag"))


@query(f"WITH {_FLAGGED} SELECT flag & 3840 AS skipped, flag & 3844 = 0 AS usable, flag & 3844 = 0 AND flag <> 0 AS pairable, count(*)::BIGINT AS n FROM flagged GROUP BY ALL")
def read_flags(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("flag")
    return _flagged(spark, d).groupBy(f.bitwiseAND(F.lit(3840)).cast("long").alias("skipped"), bam.usable(f).alias("usable"), bam.pairable(f).alias("pairable")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_FLAGGED}, {ad.SEQS}, ev AS (SELECT seq, pos, sum(d)::BIGINT AS d FROM (SELECT seq, beg AS pos, 1 AS d FROM flagged WHERE flag & 3844 = 0 UNION ALL SELECT seq, "end", -1 FROM flagged WHERE flag & 3844 = 0 UNION ALL SELECT seq, 0, 0 FROM seqs UNION ALL SELECT seq, len, 0 FROM seqs) GROUP BY seq, pos),
steps AS (SELECT * FROM (SELECT seq, pos AS beg, lead(pos) OVER (PARTITION BY seq ORDER BY pos) AS "end", sum(d) OVER (PARTITION BY seq ORDER BY pos)::BIGINT AS cov FROM ev) WHERE "end" IS NOT NULL)
SELECT least(cov, 16)::BIGINT AS copies, sum("end" - beg)::BIGINT AS bases FROM steps GROUP BY 1"""
)
def read_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage by the reads that count."""
    return stats.coverage_histogram(intervals.coverage(_flagged(spark, d).where(bam.usable(F.col("flag"))), ad.sequences(spark, d)))


# Pairs carried from sequences to pieces and to backbones


def _interval_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return ad.alns(spark, d).select(c("aread").alias("aseq"), c("abpos").alias("abeg"), c("aepos").alias("aend"), c("bread").alias("bseq"), c("bbpos").alias("bbeg"), c("bepos").alias("bend"), "mlen")


@query(
    f"""WITH {_SLICES}, {ad.ALNS} SELECT x.name AS aseq, abpos - x.beg AS abeg, aepos - x.beg AS aend, y.name AS bseq, bbpos - y.beg AS bbeg, bepos - y.beg AS bend, mlen
FROM alns JOIN pieces x ON x.seq = aread AND abpos >= x.beg AND aepos <= x."end" JOIN pieces y ON y.seq = bread AND bbpos >= y.beg AND bepos <= y."end" """
)
def pairs_on_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of intervals on pieces; those with an end that crosses a break are dropped."""
    p = _slices(spark, d)
    segments = p.select(F.col("name").alias("object"), F.col("seq").alias("comp"), F.col("beg").alias("x"), (F.col("end") - F.col("beg")).alias("y"), F.lit(False).alias("rev"), F.lit(0).cast("long").alias("b"))
    return layout.pairs_lifted(_interval_pairs(spark, d), segments)


_MARKS = """marks AS (SELECT seq, "end", target, "end" - prev + (CASE WHEN seq % 5 = 0 THEN -300 ELSE 200 END) AS size, prev FROM (SELECT seq, unnest([7000 + seq % 50, 12000, 20000]) AS "end", unnest([0, 7000 + seq % 50, 12000]) AS prev, seq * 4 + unnest([0, 1, 2]) AS target FROM seqs)),
place AS (SELECT q.*, target AS seq2, size - ("end" - lo) AS beg2, size - ("end" - hi) AS end2, q.seq AS s FROM (SELECT DISTINCT seq, p, e, CASE WHEN seq % 3 = 0 THEN 20000 - e ELSE p END AS lo, CASE WHEN seq % 3 = 0 THEN 20000 - p ELSE e END AS hi FROM ends) q JOIN marks m ON m.seq = q.seq AND lo >= prev AND lo < "end" WHERE "end" >= hi AND size >= "end" - lo)"""


def _marks(spark: SparkSession, d: str) -> DataFrame:
    first = 7000 + F.col("seq") % 50
    cuts = F.array(*(F.struct(end.cast("long").alias("end"), prev.cast("long").alias("prev"), F.lit(i).alias("i")) for i, (end, prev) in enumerate(((first, F.lit(0)), (F.lit(12000), first), (F.lit(20000), F.lit(12000))))))
    m = ad.sequences(spark, d).select("seq", F.explode(cuts).alias("c"))
    extra = F.when(F.col("seq") % 5 == 0, F.lit(-300)).otherwise(F.lit(200))
    return m.select("seq", "c.end", (F.col("seq") * 4 + F.col("c.i")).alias("target"), (F.col("c.end") - F.col("c.prev") + extra).alias("size"))


@query(
    f"""WITH {ad.SEQS}, {ad.ALNS}, ends AS (SELECT aread AS seq, abpos AS p, aepos AS e FROM alns UNION SELECT bread, bbpos, bepos FROM alns), {_MARKS}
SELECT x.seq2 AS aseq, x.beg2 AS abeg, x.end2 AS aend, y.seq2 AS bseq, y.beg2 AS bbeg, y.end2 AS bend, mlen FROM alns JOIN place x ON x.s = aread AND x.p = abpos AND x.e = aepos JOIN place y ON y.s = bread AND y.p = bbpos AND y.e = bepos"""
)
def pairs_on_backbones(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of intervals on backbones: the first mark beyond an interval's begin decides, and both ends have to lie within."""
    s = ad.sequences(spark, d).select("seq", "len", (F.col("seq") % 3 == 0).alias("rev"))
    return layout.on_backbone(_interval_pairs(spark, d), s, _marks(spark, d))


# Files


@query(f"WITH {ad.MATRIX} SELECT * FROM matrix")
def contact_file_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Contacts of two libraries, written into one contact file and counted from there."""
    p = contacts.canonical(_pairs(spark, d)).select("aseq", "apos", "bseq", "bpos", "q", "name")
    path = scratch(spark, "contacts")
    writers.contact_file([p.where("name % 3 = 0").drop("name"), p.where("name % 3 <> 0").drop("name")], ad.sequences(spark, d), path)
    return contacts.contact_matrix(spark.read.format("contact_records").load(path), 1000)


@query(f"WITH {ad.ALNS} SELECT DISTINCT aread, bread, rev, abpos, aepos, bbpos, bepos, mlen FROM alns WHERE abpos < aepos AND aepos <= 20000 AND bbpos < bepos AND bepos <= 20000")
def paf_file(spark: SparkSession, d: str) -> DataFrame:
    """Alignments as lines of a PAF file, found by their content and read by their names."""
    s = ad.sequences(spark, d)
    name = lambda c: s.select(F.col("seq").alias(c), F.col("name").alias(f"{c}_name"))
    a = ad.alns(spark, d).join(name("aread"), "aread").join(name("bread"), "bread")
    cols = ["aread_name", F.lit(ad.LENGTH), "abpos", "aepos", F.when(F.col("rev"), "-").otherwise("+"), "bread_name", F.lit(ad.LENGTH), "bbpos", "bepos", "mlen", F.col("aepos") - F.col("abpos"), F.lit(60)]
    path = scratch(spark, "paf")
    writers.tabbed(a.select(*((c if isinstance(c, str) else c.alias(f"c{i}")) for i, c in enumerate(cols))), path)
    return readers.alignments(spark, path, s).select("aread", "bread", "rev", "abpos", "aepos", "bbpos", "bepos", "mlen").distinct()


@query(f"WITH {ad.PAIRS} SELECT aseq, (apos + least(apos + 150, 20000)) // 2 AS apos, bseq, (bpos + least(bpos + 150, 20000)) // 2 AS bpos, q FROM pairs")
def pair_file(spark: SparkSession, d: str) -> DataFrame:
    """Pairs as lines of a pair file, recognised by its name and read back as the middles of reads of 150."""
    s = ad.sequences(spark, d)
    name = lambda c: s.select(F.col("seq").alias(c), F.col("name").alias(f"{c}_name"))
    p = _pairs(spark, d).join(name("aseq"), "aseq").join(name("bseq"), "bseq")
    path = f"{scratch(spark, 'pairs')}.pa5"
    writers.tabbed(p.select(F.concat_ws("_", F.lit("r"), "name", "k").alias("read"), "aseq_name", "apos", "bseq_name", "bpos", "q", F.col("q").alias("q2")), path)
    return readers.contacts(spark, path, s)


@query(f"WITH {_FLAGGED}, short AS (SELECT seq, beg, least(\"end\", 20000) AS \"end\" FROM flagged){_MERGED.format(slack=0, of='short')} SELECT * FROM merged")
def bed_file_union(spark: SparkSession, d: str) -> DataFrame:
    """The union of reads that were written as lines of a BED file."""
    s = ad.sequences(spark, d)
    path = scratch(spark, "bed")
    r = _flagged(spark, d).join(s.select("seq", "name"), "seq").select("name", "beg", "end", F.concat(F.lit("r"), F.monotonically_increasing_id()).alias("read"), F.lit(60).alias("q"))
    writers.tabbed(r, path)
    return intervals.merge_ranges(readers.bed_reads(spark, path, s).select("seq", "beg", "end"))
