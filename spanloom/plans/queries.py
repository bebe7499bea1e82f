"""Registered queries of the engine's own operators over the supplied tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import overlap as geo
from spanloom.functions import probability as prob
from spanloom.functions import scale
from spanloom.functions import sequence as seqf
from spanloom.operators import breaks, chaining, contacts, graph, intervals, layout, ranges, scaffold, stats
from spanloom.plans import adapters as ad
from spanloom.session import table
from spanloom.streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name. sql: its CTEs come first."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _ivals(spark: SparkSession, d: str) -> DataFrame:
    return ad.alns(spark, d).select(F.col("aread").alias("seq"), F.col("abpos").alias("beg"), F.col("aepos").alias("end"))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return intervals.coverage(_ivals(spark, d), ad.sequences(spark, d))


def _short(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    return ad.alns(spark, d).where(where).select(F.col("aread").alias("seq"), F.col("abpos").alias("beg"), F.col("aepos").alias("end"))


_SHORT = ad.ALNS + ",\nshort AS (SELECT aread AS seq, abpos AS beg, aepos AS \"end\" FROM alns)"
_MERGED = """,
m1 AS (SELECT *, CASE WHEN beg <= max("end") OVER (PARTITION BY seq ORDER BY beg, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {slack} THEN 0 ELSE 1 END AS new FROM {of}),
m2 AS (SELECT *, sum(new) OVER (PARTITION BY seq ORDER BY beg, "end" ROWS UNBOUNDED PRECEDING) AS run FROM m1),
merged AS (SELECT seq, min(beg) AS beg, max("end") AS "end" FROM m2 GROUP BY seq, run)"""


# Coverage and interval algebra


@query(f"WITH {ad.STEPS} SELECT least(cov, 16)::BIGINT AS copies, sum(\"end\" - beg)::BIGINT AS bases FROM steps GROUP BY 1")
def coverage_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.coverage_histogram(_steps(spark, d))


@query(f"WITH {ad.STEPS} SELECT seq, beg, \"end\", cov FROM steps")
def coverage_segments(spark: SparkSession, d: str) -> DataFrame:
    return _steps(spark, d)


@query(f"WITH {ad.IVALS}, e AS (SELECT seq, beg AS pos, 1 AS d FROM ivals UNION ALL SELECT seq, \"end\", -1 FROM ivals) SELECT seq, pos, sum(d)::BIGINT AS delta FROM e GROUP BY seq, pos HAVING sum(d) <> 0")
def compressed_events(spark: SparkSession, d: str) -> DataFrame:
    return intervals.compressed_events(_ivals(spark, d))


@query(
    f"""WITH {ad.STEPS}, h AS (SELECT k AS copies, coalesce(sum("end" - beg), 0) AS bases FROM range(17) r(k) LEFT JOIN steps ON least(cov, 16) = k GROUP BY k),
c AS (SELECT copies, sum(bases) OVER (ORDER BY copies) AS upto, sum(bases) OVER () AS total FROM h),
l AS (SELECT min(copies) FILTER (upto >= floor(total * 0.5)) AS low, min(copies) FILTER (upto >= floor(total * 0.9)) AS high FROM c),
u AS (SELECT low, least(greatest(low, high) + 1, 16) AS high FROM l),
b AS (SELECT copies, (high + 1) * upto - (copies + 1) * (SELECT upto FROM c WHERE copies = high) AS bend FROM c, u WHERE copies >= low AND copies < high)
SELECT coalesce((SELECT copies FROM b ORDER BY bend DESC, copies LIMIT 1), (SELECT low FROM u))::BIGINT + 1 AS ploidy"""
)
def ploidy_estimate(spark: SparkSession, d: str) -> DataFrame:
    return stats.copy_number(coverage_histogram(spark, d))


@query(f"WITH {_SHORT}{_MERGED.format(slack=0, of='short')} SELECT * FROM merged")
def merged_ranges(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merge_ranges(_short(spark, d))


@query(f"WITH {_SHORT}{_MERGED.format(slack=50, of='short')} SELECT * FROM merged")
def merged_ranges_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merge_ranges(_short(spark, d), 50)


@query(f"WITH {_SHORT}{_MERGED.format(slack=0, of='short')} SELECT seq, sum(\"end\" - beg)::BIGINT AS union_size FROM merged GROUP BY seq")
def range_union_size(spark: SparkSession, d: str) -> DataFrame:
    return intervals.measures(_short(spark, d)).select("seq", "union_size")


_SWEPT = """,
e AS (SELECT seq, pos, sum(d) AS d FROM (SELECT seq, beg AS pos, 1 AS d FROM short UNION ALL SELECT seq, "end", -1 FROM short) GROUP BY seq, pos),
s AS (SELECT seq, lead(pos) OVER w - pos AS size, sum(d) OVER w AS cov FROM e WINDOW w AS (PARTITION BY seq ORDER BY pos))"""


@query(f"WITH {_SHORT}{_SWEPT} SELECT seq, coalesce(sum(size) FILTER (cov = 1), 0)::BIGINT AS once_size FROM s GROUP BY seq")
def range_unique_size(spark: SparkSession, d: str) -> DataFrame:
    return intervals.measures(_short(spark, d)).select("seq", "once_size")


@query(f"WITH {_SHORT}{_MERGED.format(slack=0, of='short')}, u AS (SELECT seq, sum(\"end\" - beg) AS u FROM merged GROUP BY seq), t AS (SELECT seq, sum(\"end\" - beg) AS t FROM short GROUP BY seq) SELECT seq, t::BIGINT AS total, (t - u)::BIGINT AS excess FROM t JOIN u USING (seq)")
def range_multi_overlap(spark: SparkSession, d: str) -> DataFrame:
    return intervals.measures(_short(spark, d)).select("seq", "total", "excess")


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _short(spark, d, "rev"), _short(spark, d, "not rev")


_TWO = ad.ALNS + ",\none AS (SELECT aread AS seq, abpos AS beg, aepos AS \"end\" FROM alns WHERE rev),\ntwo AS (SELECT aread AS seq, abpos AS beg, aepos AS \"end\" FROM alns WHERE NOT rev)"


@query(
    f"""WITH {_TWO}, e AS (SELECT seq, pos, sum(x) AS x, sum(y) AS y FROM (SELECT seq, beg AS pos, 1 AS x, 0 AS y FROM one UNION ALL SELECT seq, "end", -1, 0 FROM one UNION ALL SELECT seq, beg, 0, 1 FROM two UNION ALL SELECT seq, "end", 0, -1 FROM two) GROUP BY seq, pos),
s AS (SELECT seq, lead(pos) OVER w - pos AS size, sum(x) OVER w AS x, sum(y) OVER w AS y FROM e WINDOW w AS (PARTITION BY seq ORDER BY pos))
SELECT seq, sum(size)::BIGINT AS size FROM s WHERE x > 0 AND y > 0 GROUP BY seq"""
)
def pair_intersection(spark: SparkSession, d: str) -> DataFrame:
    return intervals.overlap_size(*_two(spark, d))


@query(
    f"""WITH {_TWO}, e AS (SELECT seq, pos, sum(x) AS x, sum(y) AS y FROM (SELECT seq, beg AS pos, 1 AS x, 0 AS y FROM one UNION ALL SELECT seq, "end", -1, 0 FROM one UNION ALL SELECT seq, beg, 0, 1 FROM two UNION ALL SELECT seq, "end", 0, -1 FROM two) GROUP BY seq, pos),
s AS (SELECT seq, lead(pos) OVER w - pos AS size, sum(x) OVER w AS x, sum(y) OVER w AS y FROM e WINDOW w AS (PARTITION BY seq ORDER BY pos))
SELECT least(x, 4)::BIGINT AS old, least(x + y, 4)::BIGINT AS new, sum(size)::BIGINT AS size FROM s WHERE y > 0 AND size IS NOT NULL GROUP BY 1, 2"""
)
def coverage_change(spark: SparkSession, d: str) -> DataFrame:
    return intervals.coverage_change(*_two(spark, d), cap=4)


@query(
    f"""WITH {_TWO}, e AS (SELECT seq, pos, sum(x) AS x FROM (SELECT seq, beg AS pos, 1 AS x FROM one UNION ALL SELECT seq, "end", -1 FROM one UNION ALL SELECT seq, 25000 - "end" + 40, 1 FROM two UNION ALL SELECT seq, 25000 - beg + 40, -1 FROM two) GROUP BY seq, pos HAVING sum(x) <> 0),
s AS (SELECT seq, pos AS beg, lead(pos) OVER w AS "end", (sum(x) OVER w)::BIGINT AS cov FROM e WINDOW w AS (PARTITION BY seq ORDER BY pos))
SELECT * FROM s WHERE cov > 0"""
)
def step_sum(spark: SparkSession, d: str) -> DataFrame:
    one, two = (intervals.coverage(x) for x in _two(spark, d))
    tasks = ranges.tasks_for(ad.alns(spark, d), 4)  # an alignment gives two steps at most
    return intervals.step_sum(one, two, shift=F.lit(40), mirror=F.lit(25000), tasks=tasks).where("cov > 0")


_GENE_QUERIES = ",\nq AS (SELECT DISTINCT seq, (seq * 37) % 9000 AS beg, (seq * 37) % 9000 + 5000 AS \"end\" FROM seqs)"


@query(
    f"""WITH {ad.STEPS}{_GENE_QUERIES} SELECT q.seq, q.beg, q."end", sum((least(q."end", s."end") - greatest(q.beg, s.beg)) * cov)::BIGINT AS bases,
coalesce(sum(least(q."end", s."end") - greatest(q.beg, s.beg)) FILTER (cov <= 2), 0)::BIGINT AS low FROM q JOIN steps s ON q.seq = s.seq AND q.beg < s."end" AND s.beg < q."end" GROUP BY ALL"""
)
def range_coverage(spark: SparkSession, d: str) -> DataFrame:
    q = ad.sequences(spark, d).select("seq", F.expr("(seq * 37) % 9000").alias("beg"), F.expr("(seq * 37) % 9000 + 5000").alias("end"))
    return intervals.range_coverage(_steps(spark, d), q, 2, bin_size=4000)


@query(
    f"""WITH {ad.STEPS}, w AS (SELECT seq, unnest(range(beg // 1000, ("end" - 1) // 1000 + 1)) AS win, beg, "end", cov FROM steps)
SELECT seq, win, sum((least("end", (win + 1) * 1000) - greatest(beg, win * 1000)) * cov)::BIGINT AS bases, sum(least("end", (win + 1) * 1000) - greatest(beg, win * 1000))::BIGINT AS size FROM w GROUP BY seq, win"""
)
def coverage_windows(spark: SparkSession, d: str) -> DataFrame:
    return intervals.window_coverage(_steps(spark, d), 1000)


@query(
    f"""WITH {ad.STEPS}, w AS (SELECT seq, unnest(range(beg // 1000, ("end" - 1) // 1000 + 1)) AS win, beg, "end", cov FROM steps),
c AS (SELECT seq, win, sum((least("end", (win + 1) * 1000) - greatest(beg, win * 1000)) * cov)::BIGINT AS bases, sum(least("end", (win + 1) * 1000) - greatest(beg, win * 1000))::BIGINT AS size FROM w GROUP BY seq, win)
SELECT seq, win, round(CASE WHEN bases > 0 THEN least(1.0::DOUBLE, 8.0::DOUBLE * size / bases) ELSE 1.0::DOUBLE END, 6) AS norm FROM c"""
)
def coverage_norms(spark: SparkSession, d: str) -> DataFrame:
    return intervals.window_norms(_steps(spark, d), 1000, F.lit(8.0)).withColumn("norm", F.round("norm", 6))


@query(
    f"""WITH {_SHORT}, t AS (SELECT seq, beg, max("end") AS "end" FROM short GROUP BY seq, beg) SELECT a.seq, a.beg AS a_beg, a."end" AS a_end, b.beg AS b_beg, b."end" AS b_end FROM t a JOIN short b ON a.seq = b.seq AND a.beg < b."end" AND b.beg < a."end" """
)
def band_join(spark: SparkSession, d: str) -> DataFrame:
    return intervals.longest_join(_short(spark, d), bin_size=500).select(F.col("a_seq").alias("seq"), "a_beg", "a_end", "b_beg", "b_end")


@query()
def tiling_cover(spark: SparkSession, d: str) -> DataFrame:
    """Fewest intervals that cover each sequence's short intervals."""
    return intervals.tiling_cover(_short(spark, d))


@query(
    f"""WITH {ad.SEQS}, s AS (SELECT seq, unnest([0, 7000, 12000 + (seq % 3 = 1)::INT * 5]) AS beg, unnest([7000, 12000, 20000 - (seq % 5 = 2)::INT]) AS "end" FROM seqs),
g AS (SELECT seq, sum(CASE WHEN coalesce(lag, 0) <> beg THEN 1 ELSE 0 END) + (CASE WHEN max("end") = 20000 THEN 0 ELSE 1 END) AS faults FROM (SELECT *, lag("end") OVER (PARTITION BY seq ORDER BY beg, "end") AS lag FROM s) GROUP BY seq)
SELECT seq, faults::BIGINT AS faults FROM g WHERE faults > 0"""
)
def layout_tiling_check(spark: SparkSession, d: str) -> DataFrame:
    s = ad.sequences(spark, d)
    cut = F.array(F.struct(F.lit(0).alias("beg"), F.lit(7000).alias("end")), F.struct(F.lit(7000).alias("beg"), F.lit(12000).alias("end")), F.struct((12000 + (F.col("seq") % 3 == 1).cast("int") * 5).alias("beg"), (20000 - (F.col("seq") % 5 == 2).cast("int")).alias("end")))
    return intervals.tiling_faults(s.select("seq", F.explode(cut).alias("c")).select("seq", "c.*"), s).withColumn("faults", F.col("faults").cast("long"))


# Alignments and overlaps


@query(
    f"""WITH {ad.ALNS} SELECT aread, bread, rev, abpos, aepos, bbpos, bepos, mlen FROM alns WHERE 0 <= abpos AND abpos < aepos AND aepos <= 20000 AND 0 <= bbpos AND bbpos < bepos AND bepos <= 20000
AND aread <> bread AND (aread < bread OR (aread = bread AND abpos <= bbpos))
AND NOT (mlen = aepos - abpos AND (abpos = 0) <> (aepos = 20000) AND (bbpos = 0) <> (bepos = 20000))"""
)
def alignment_filter(spark: SparkSession, d: str) -> DataFrame:
    a = ad.alns(spark, d).drop("line")
    valid = lambda b, e: (F.col(b) >= 0) & (F.col(b) < F.col(e)) & (F.col(e) <= ad.LENGTH)
    one_end = lambda b, e: (F.col(b) == 0) != (F.col(e) == ad.LENGTH)
    overhang = (F.col("mlen") == F.col("aepos") - F.col("abpos")) & one_end("abpos", "aepos") & one_end("bbpos", "bepos")
    first = (F.col("aread") < F.col("bread")) | ((F.col("aread") == F.col("bread")) & (F.col("abpos") <= F.col("bbpos")))
    return a.where(valid("abpos", "aepos") & valid("bbpos", "bepos") & (F.col("aread") != F.col("bread")) & first & ~overhang)


@query(f"WITH {ad.ALNS}, f AS (SELECT * FROM alns) SELECT aread, bread, rev, abpos, aepos, bbpos, bepos FROM f UNION ALL SELECT bread, aread, rev, bbpos, bepos, abpos, aepos FROM f")
def dual_alignments(spark: SparkSession, d: str) -> DataFrame:
    a = ad.alns(spark, d).select("aread", "bread", "rev", "abpos", "aepos", "bbpos", "bepos")
    return a.unionByName(a.select(F.col("bread").alias("aread"), F.col("aread").alias("bread"), "rev", F.col("bbpos").alias("abpos"), F.col("bepos").alias("aepos"), F.col("abpos").alias("bbpos"), F.col("aepos").alias("bepos")))


@query(
    f"""WITH {ad.ALNS}, o AS (SELECT aread, bread, false AS arev, rev AS brev, abpos, aepos, bbpos, bepos, [1, 16, 34, 68][(line % 4 + 1)::INT]::INT AS type FROM alns)
SELECT * FROM o UNION ALL SELECT bread, aread, NOT brev, NOT arev, bbpos, bepos, abpos, aepos, (((type << 4) | (type >> 4)) & 119)::INT FROM o"""
)
def dual_overlaps(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit(1), F.lit(16), F.lit(34), F.lit(68)), (F.col("line") % 4 + 1).cast("int"))
    o = ad.alns(spark, d).select("aread", "bread", F.lit(False).alias("arev"), F.col("rev").alias("brev"), "abpos", "aepos", "bbpos", "bepos", kind.alias("type"))
    return chaining.symmetric(o)


@query(
    f"""WITH {ad.ALNS}, t AS (SELECT abpos > 2000 AS a0, 20000 - aepos > 2000 AS a1, bbpos > 2000 AS b0, 20000 - bepos > 2000 AS b1, rev FROM alns),
k AS (SELECT (CASE WHEN (a0 AND NOT a1 AND NOT CASE WHEN rev THEN b1 ELSE b0 END AND CASE WHEN rev THEN b0 ELSE b1 END) OR (NOT a0 AND a1 AND CASE WHEN rev THEN b1 ELSE b0 END AND NOT CASE WHEN rev THEN b0 ELSE b1 END) THEN 34 ELSE 0 END
  | CASE WHEN NOT a0 AND NOT a1 THEN 1 ELSE 0 END | CASE WHEN NOT b0 AND NOT b1 THEN 16 ELSE 0 END) AS k FROM t)
SELECT (CASE WHEN k = 0 THEN 68 ELSE k END)::INT AS type, count(*)::BIGINT AS n FROM k GROUP BY 1"""
)
def overlap_types(spark: SparkSession, d: str) -> DataFrame:
    n = F.lit(ad.LENGTH)
    c = F.col
    return ad.alns(spark, d).select(geo.overlap_type(c("abpos"), c("aepos"), n, c("bbpos"), c("bepos"), n, c("rev")).cast("int").alias("type")).groupBy("type").agg(F.count("*").alias("n"))


@query(
    f"""WITH {ad.ALNS}, s AS (SELECT *, (aepos + abpos) / 2.0::DOUBLE AS x, (bepos + bbpos) / 2.0::DOUBLE AS y, (bepos - bbpos)::DOUBLE / (aepos - abpos) AS m FROM alns),
r AS (SELECT *, least(x, CASE WHEN rev THEN (20000 - y) / m ELSE y / m END) AS l, least(20000 - x, CASE WHEN rev THEN y / m ELSE (20000 - y) / m END) AS h FROM s)
SELECT aread, bread, rev, abpos, bbpos, round(x - l, 3) AS e0, round(x + h, 3) AS e1, round(y - CASE WHEN rev THEN h ELSE l END * m, 3) AS f0, round(y + CASE WHEN rev THEN l ELSE h END * m, 3) AS f1 FROM r"""
)
def extended_overlaps(spark: SparkSession, d: str) -> DataFrame:
    n, c = F.lit(ad.LENGTH), F.col
    e = geo.extended(c("abpos"), c("aepos"), n, c("bbpos"), c("bepos"), n, c("rev"))
    return ad.alns(spark, d).withColumn("e", e).select("aread", "bread", "rev", "abpos", "bbpos", *[F.round(c("e")[k], 3).alias(v) for k, v in (("abeg", "e0"), ("aend", "e1"), ("bbeg", "f0"), ("bend", "f1"))])


@query()
def second_copies(spark: SparkSession, d: str) -> DataFrame:
    """Where an alignment covers the middle of a's sequence off the middle of b's; held against the chaining code's own version in the tests."""
    c, n = F.col, F.lit
    r = geo.second_copies(n(5000), n(15000), n(5000), n(15000), c("abpos"), c("aepos"), c("bbpos"), c("bepos"), c("rev"))
    a = ad.alns(spark, d).where("abpos < 15000 and aepos > 5000")
    return a.select("aread", "bread", "abpos", "bbpos", F.explode(r).alias("r")).select("aread", "bread", "abpos", "bbpos", "r.beg", "r.end")


@query(f"WITH {ad.ALNS} SELECT aread, sum(mlen)::DOUBLE * sum(mlen) / sum(mlen * mlen) AS neff FROM alns GROUP BY aread")
def effective_n(spark: SparkSession, d: str) -> DataFrame:
    return stats.effective_number(ad.alns(spark, d), "aread", "mlen")


@query(f"WITH {ad.ALNS} SELECT aread, sum(aepos - abpos)::DOUBLE / 20000 AS copies FROM alns GROUP BY aread")
def avg_copies(spark: SparkSession, d: str) -> DataFrame:
    return ad.alns(spark, d).groupBy("aread").agg((F.sum(F.col("aepos") - F.col("abpos")) / F.lit(ad.LENGTH)).alias("copies"))


@query(
    """WITH f AS (SELECT p_partkey, (p_partkey * 997 + 1000)::DOUBLE AS size FROM part), g AS (SELECT *, log10(greatest(size, 1.0)) AS x FROM f)
SELECT p_partkey, round(0.95 + greatest(0.0, least(1.0, (x - 4.0) / 2.0)) * (0.10 - 0.95), 6)::DOUBLE AS chain, round(0.7 + greatest(0.0, least(1.0, (x - 4.7) / (6.0 - 4.7))) * (0.3 - 0.7), 6)::DOUBLE AS low_copy,
round(size * log2(p_partkey % 9 + 1), 4)::DOUBLE AS scaled FROM g"""
)
def scale_factors(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 997 + 1000).cast("double").alias("size"))
    return p.select("p_partkey", F.round(scale.log_linear(F.col("size"), scale.CHAIN_SIZE), 6).alias("chain"), F.round(scale.log_linear(F.col("size"), scale.LOW_COPY), 6).alias("low_copy"), F.round(scale.scaled_overlap(F.col("size"), F.col("p_partkey") % 9), 4).alias("scaled"))


@query(
    """SELECT p_partkey, (p_partkey * 5 + 7 + (p_partkey * 9 + 2)) // 2 AS mid, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 1000 + 1 ELSE 0 END AS up, p_partkey // 1000 AS down,
CASE WHEN p_partkey * 4000000000 <= 2147483647 THEN 0 ELSE ceil(log2((p_partkey * 4000000000 + 1) / 2147483648.0::DOUBLE))::INT END::INT AS shift FROM part"""
)
def integer_helpers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", scale.midpoint(k * 5 + 7, k * 9 + 2).alias("mid"), scale.windows_up(k, 1000).alias("up"), scale.windows_down(k, 1000).alias("down"), scale.shift_to_int(k * F.lit(4000000000)).cast("int").alias("shift"))


# Contacts


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return contacts.pair_mates(ad.reads(spark, d), ["l_linenumber", "l_partkey", "seq"])


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return contacts.contact_matrix(_pairs(spark, d), 1000)


@query(f"WITH {ad.PAIRS} SELECT * FROM canon")
def pair_contacts(spark: SparkSession, d: str) -> DataFrame:
    return contacts.canonical(_pairs(spark, d)).withColumn("k", F.col("k").cast("long"))


@query(f"WITH {ad.PAIRS} SELECT name, aseq, apos, bseq, bpos, q FROM canon WHERE aseq <> bseq AND q >= 20")
def inter_contacts(spark: SparkSession, d: str) -> DataFrame:
    return contacts.of_kind(contacts.canonical(_pairs(spark, d)), "inter", 20).drop("k")


@query(f"WITH {ad.MATRIX} SELECT * FROM matrix")
def contact_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d)


@query(f"WITH {ad.SYMM} SELECT * FROM symm")
def contact_matrix_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return contacts.symmetric(_matrix(spark, d))


@query(f"WITH {ad.MATRIX} SELECT aseq, abin, bseq, bbin, 2 * n AS n FROM matrix")
def merged_libraries(spark: SparkSession, d: str) -> DataFrame:
    reads = ad.reads(spark, d)
    tasks = ranges.tasks_for(reads)
    one, two = (contacts.contact_matrix(contacts.pair_mates(reads, ["l_linenumber", "l_partkey", "l_suppkey"], tasks=tasks), 1000, tasks) for _ in range(2))
    return contacts.merged_counts(one, two, tasks=tasks)


@query(f"WITH {ad.MATRIX} SELECT bbin - abin AS dist, sum(n)::BIGINT AS n, (sum(sum(n)) OVER (ORDER BY bbin - abin))::BIGINT AS upto FROM matrix WHERE aseq = bseq GROUP BY 1")
def distance_decay(spark: SparkSession, d: str) -> DataFrame:
    return contacts.distance_counts(_matrix(spark, d))


@query()
def span_limit(spark: SparkSession, d: str) -> DataFrame:
    return contacts.span_limit(_matrix(spark, d), 3)


@query(
    f"""WITH {ad.SYMM} SELECT sum(n) FILTER (aseq = bseq)::BIGINT AS intra_links, (sum(n) FILTER (aseq <> bseq) // 2)::BIGINT AS inter_links,
count(DISTINCT (aseq, abin)) FILTER (aseq = bseq) AS intra_bins, count(DISTINCT (aseq, abin)) FILTER (aseq <> bseq) AS inter_bins FROM symm"""
)
def contact_stats(spark: SparkSession, d: str) -> DataFrame:
    return contacts.contact_stats(_matrix(spark, d))


@query(
    f"""WITH {ad.SYMM}, b AS (SELECT aseq AS seq, abin AS bin, sum(n) AS n FROM symm WHERE aseq <> bseq GROUP BY ALL)
SELECT seq, sum(n)::BIGINT AS links, count(*) AS covered, coalesce(sum(n) FILTER (bin < 4), 0)::BIGINT AS head_links, coalesce(sum(n) FILTER (bin >= 16), 0)::BIGINT AS tail_links,
count(*) FILTER (bin < 4) AS head_bins, count(*) FILTER (bin >= 16) AS tail_bins FROM b GROUP BY seq"""
)
def terminal_links(spark: SparkSession, d: str) -> DataFrame:
    return contacts.end_counts(_matrix(spark, d), ad.sequences(spark, d), 1000, 4)


@query()
def linkage_map(spark: SparkSession, d: str) -> DataFrame:
    long = ad.alns(spark, d).groupBy("aread", "bread").agg(F.min("abpos").alias("abpos"), F.max("aepos").alias("aepos"), F.sum("mlen").alias("w")).where("w > 7000")
    return contacts.linkages(_matrix(spark, d), ad.sequences(spark, d), long, 1000, 4, least=1, alpha=0.9).withColumns({c: F.round(c, 9) for c in ("size", "density", "p")})


@query(
    f"""WITH {ad.MATRIX}, {ad.SEQS}, e AS (SELECT aseq AS seq, abin + 1 AS bin, n AS d FROM matrix WHERE aseq = bseq AND bbin - abin > 2 AND bbin - abin <= 12 UNION ALL SELECT aseq, bbin - 1, -n FROM matrix WHERE aseq = bseq AND bbin - abin > 2 AND bbin - abin <= 12
  UNION ALL SELECT seq, unnest(range(0, 20)), 0 FROM seqs), g AS (SELECT seq, bin, sum(d) AS d FROM e GROUP BY ALL)
SELECT seq, bin, (sum(d) OVER (PARTITION BY seq ORDER BY bin))::BIGINT AS span FROM g"""
)
def contact_spans(spark: SparkSession, d: str) -> DataFrame:
    return contacts.link_spans(_matrix(spark, d), ad.sequences(spark, d), 1000, 12)


@query(
    f"""WITH {ad.PAIRS}, {ad.LAYOUT}, s AS (SELECT * FROM segs), p AS (SELECT name, k, q, aseq, apos % 1000 AS apos, bseq, bpos % 1000 AS bpos FROM pairs WHERE q >= 10),
l AS (SELECT x.object::VARCHAR AS an, CASE WHEN x.rev THEN x.b + x.y - 1 - apos ELSE x.b + apos END AS ap, y.object::VARCHAR AS bn, CASE WHEN y.rev THEN y.b + y.y - 1 - bpos ELSE y.b + bpos END AS bp
  FROM p JOIN s x ON x.comp = aseq AND apos < x.y JOIN s y ON y.comp = bseq AND bpos < y.y)
SELECT CASE WHEN an > bn THEN bn ELSE an END AS aname, (CASE WHEN an > bn THEN bp ELSE ap END) >> 3 AS apos, CASE WHEN an > bn THEN an ELSE bn END AS bname, (CASE WHEN an > bn THEN ap ELSE bp END) >> 3 AS bpos FROM l"""
)
def juicer_links(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).withColumn("apos", F.col("apos") % 1000).withColumn("bpos", F.col("bpos") % 1000)
    return contacts.juicer_links(p, layout.offsets(ad.layout(spark, d)), shift=3, min_q=10)


@query(
    f"""WITH RECURSIVE {ad.MATRIX}, s AS (SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 3 = 0 THEN 2500 ELSE 20000 END AS len, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier),
f AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS seq, 0::BIGINT AS bins, 0::BIGINT AS first, 0::BIGINT AS next, 0::BIGINT AS held
  UNION ALL SELECT s.i, s.seq, CASE WHEN s.len < 4000 THEN 0 ELSE (s.len + 999) // 1000 END, CASE WHEN s.len < 4000 OR f.held = 0 THEN f.next ELSE f.next + 1 END,
  CASE WHEN s.len < 4000 THEN f.next + (f.held + s.len >= 4000)::BIGINT ELSE f.next + (f.held > 0)::BIGINT + (s.len + 999) // 1000 END, CASE WHEN s.len < 4000 AND f.held + s.len < 4000 THEN f.held + s.len ELSE 0 END
  FROM f JOIN s ON s.i = f.i + 1),
p AS (SELECT s.seq, k AS bin, f.first + least(k, f.bins) AS pixel FROM f JOIN s USING (i), unnest(range(0, greatest(1, (s.len + 999) // 1000))) AS t(k))
SELECT a.pixel AS x, b.pixel AS y, sum(n)::BIGINT AS n FROM matrix JOIN p a ON aseq = a.seq AND abin = a.bin JOIN p b ON bseq = b.seq AND bbin = b.bin GROUP BY ALL"""
)
def pixel_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Contacts in pixels, every third sequence short and packed with its neighbours."""
    s = ad.sequences(spark, d).select("seq", F.when(F.col("seq") % 3 == 0, 2500).otherwise(F.col("len")).cast("long").alias("len"), F.col("seq").alias("rank"))
    return contacts.pixel_matrix(_matrix(spark, d), contacts.pixels(s, 1000, merge_below=4000))


@query(
    f"""WITH {ad.MATRIX}, t AS (SELECT quantile_cont(n, 0.98) AS c FROM matrix WHERE n > 0) SELECT aseq, abin, bseq, bbin, round(ln(1 + least(n::DOUBLE, c)) / ln(1 + c), 6) AS scaled FROM matrix, t"""
)
def matrix_normalised(spark: SparkSession, d: str) -> DataFrame:
    return stats.matrix_scaled(_matrix(spark, d), "n").select("aseq", "abin", "bseq", "bbin", F.round("scaled", 6).alias("scaled"))


# Layout


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return layout.offsets(ad.layout(spark, d))


@query(f"WITH {ad.LAYOUT} SELECT object, comp, x, y, rev, a, b FROM segs")
def layout_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).drop("part")


_POINTS = "pts AS (SELECT l_orderkey AS seq, l_partkey * 10 AS pos FROM lineitem)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq"), (F.col("l_partkey") * 10).alias("pos"))


@query(f"WITH {ad.LAYOUT}, {_POINTS} SELECT seq, pos, object, CASE WHEN rev THEN b + x + y - 1 - pos ELSE b + pos - x END AS object_pos FROM pts JOIN segs ON comp = seq AND pos >= x AND pos < x + y")
def lift_over(spark: SparkSession, d: str) -> DataFrame:
    return layout.lifted(_points(spark, d), _segments(spark, d))


_OPOINTS = "pts AS (SELECT o_custkey AS object, o_orderkey * 13 % 400000 AS object_pos FROM orders)"


@query(f"WITH {ad.LAYOUT}, {_OPOINTS} SELECT pts.object, object_pos, comp, CASE WHEN rev THEN x + y - 1 - (object_pos - b) ELSE x + object_pos - b END AS comp_pos FROM pts JOIN segs ON segs.object = pts.object AND object_pos >= b AND object_pos < b + y")
def lift_over_inverse(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("object"), F.expr("o_orderkey * 13 % 400000").alias("object_pos"))
    return layout.lowered(p, _segments(spark, d))


@query(
    f"""WITH {ad.LAYOUT}, i AS (SELECT l_orderkey AS seq, l_partkey * 10 AS beg, l_partkey * 10 + l_quantity::BIGINT * 500 AS "end" FROM lineitem)
SELECT seq, beg, "end", object, CASE WHEN rev THEN b + x + y - "end" ELSE b + beg - x END AS obj_beg, CASE WHEN rev THEN b + x + y - beg ELSE b + "end" - x END AS obj_end FROM i JOIN segs ON comp = seq AND beg >= x AND "end" <= x + y"""
)
def interval_lift(spark: SparkSession, d: str) -> DataFrame:
    beg = F.col("l_partkey") * 10
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq"), beg.alias("beg"), (beg + F.col("l_quantity").cast("long") * 500).alias("end"))
    return layout.interval_lifted(i, _segments(spark, d))


_AGP = """,
n AS (SELECT *, row_number() OVER w AS n, coalesce(sum(y) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + (row_number() OVER w - 1) * 100 AS beg FROM parts WINDOW w AS (PARTITION BY object ORDER BY part))"""


@query(
    f"""WITH {ad.LAYOUT}{_AGP} SELECT object, beg + 1 AS obj_beg, beg + y AS obj_end, 2 * n - 1 AS part, 'W' AS kind, comp::VARCHAR AS c1, '1' AS c2, y::VARCHAR AS c3, CASE WHEN rev THEN '-' ELSE '+' END AS c4 FROM n
UNION ALL SELECT object, beg - 99, beg, 2 * n - 2, 'N', '100', 'scaffold', 'yes', 'proximity_ligation' FROM n WHERE n > 1"""
)
def layout_agp(spark: SparkSession, d: str) -> DataFrame:
    return layout.agp(_segments(spark, d))


@query(f"WITH {ad.LAYOUT}, o AS (SELECT object, sum(y)::BIGINT AS len FROM parts GROUP BY object) SELECT object, len, 'scaffold_' || row_number() OVER (ORDER BY len DESC, object) AS name FROM o")
def scaffold_names(spark: SparkSession, d: str) -> DataFrame:
    return layout.by_length(_segments(spark, d).groupBy("object").agg(F.sum("y").alias("len")))


_CUTS = "cuts AS (SELECT DISTINCT s_suppkey AS seq, unnest([3000 + s_suppkey * 7, 11000, 11000 + s_suppkey * 3]) AS pos FROM supplier)"
_SLICES = f"""{_CUTS}, starts AS (SELECT s_suppkey AS seq, 0::BIGINT AS pos FROM supplier UNION ALL SELECT * FROM cuts WHERE pos > 0 AND pos < 20000),
pieces AS (SELECT seq, row_number() OVER w AS k, seq || '_ec_' || row_number() OVER w AS name, pos AS beg, coalesce(lead(pos) OVER w, 20000) AS "end" FROM starts WINDOW w AS (PARTITION BY seq ORDER BY pos))"""


def _slices(spark: SparkSession, d: str) -> DataFrame:
    s = ad.sequences(spark, d)
    cuts = s.select("seq", F.explode(F.array(3000 + F.col("seq") * 7, F.lit(11000).cast("long"), 11000 + F.col("seq") * 3)).alias("pos"))
    return layout.slices(cuts, s)


@query(f"WITH {_SLICES} SELECT * FROM pieces")
def break_slices(spark: SparkSession, d: str) -> DataFrame:
    return _slices(spark, d)


@query(
    f"""WITH {_SLICES}, {ad.ALNS}, a AS (SELECT row_number() OVER (ORDER BY aread, bread, rev, abpos, aepos, bbpos, bepos, mlen) AS id, * FROM (SELECT DISTINCT aread, bread, rev, abpos, aepos, bbpos, bepos, mlen FROM alns)),
cutat AS (SELECT id, p.beg AS pt FROM a JOIN pieces p ON p.seq = aread AND p.beg > abpos AND p.beg < aepos UNION SELECT id, abpos + (CASE WHEN rev THEN bepos - p.beg ELSE p.beg - bbpos END) * (aepos - abpos) // (bepos - bbpos) FROM a JOIN pieces p ON p.seq = bread AND p.beg > bbpos AND p.beg < bepos UNION SELECT id, abpos FROM a),
f AS (SELECT a.*, pt, coalesce(lead(pt) OVER (PARTITION BY id ORDER BY pt), aepos) AS "to" FROM cutat JOIN a USING (id)),
g AS (SELECT *, (pt - abpos) * (bepos - bbpos) // (aepos - abpos) AS lo, ("to" - abpos) * (bepos - bbpos) // (aepos - abpos) AS hi FROM f WHERE "to" > pt),
h AS (SELECT *, CASE WHEN rev THEN bepos - hi ELSE bbpos + lo END AS b0, CASE WHEN rev THEN bepos - lo ELSE bbpos + hi END AS b1 FROM g)
SELECT aread, abpos, bbpos, bread, rev, x.name AS apiece, least(greatest(pt, x.beg), x."end") AS abeg, least(greatest("to", x.beg), x."end") AS aend, y.name AS bpiece, least(greatest(b0, y.beg), y."end") AS bbeg, least(greatest(b1, y.beg), y."end") AS bend
FROM h JOIN pieces x ON x.seq = aread AND (pt + "to") // 2 >= x.beg AND (pt + "to") // 2 < x."end" JOIN pieces y ON y.seq = bread AND (b0 + b1) // 2 >= y.beg AND (b0 + b1) // 2 < y."end" """
)
def split_at_breaks(spark: SparkSession, d: str) -> DataFrame:
    a = ad.alns(spark, d).drop("line").distinct()
    out = layout.split_pairs(a, _slices(spark, d), ("aread", "abpos", "bbpos", "bread"))
    return out.select("aread", "abpos", "bbpos", "bread", "rev", "apiece", "abeg", "aend", "bpiece", "bbeg", "bend")


def _members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select((F.col("c_nationkey").cast("long")).alias("grp"), (F.col("c_custkey") % 2).alias("hap"), F.col("c_custkey").alias("comp"), (F.col("c_custkey") * 7 % 900 + 100).alias("len"), (F.col("c_custkey") * 31 % 1000).alias("pos"), (F.col("c_custkey") % 3 == 0).alias("rev"))


_MEMBERS = "mem AS (SELECT c_nationkey::BIGINT AS grp, c_custkey % 2 AS hap, c_custkey AS comp, c_custkey * 7 % 900 + 100 AS len, c_custkey * 31 % 1000 AS pos, c_custkey % 3 = 0 AS rev FROM customer)"


@query(
    f"""WITH {_MEMBERS}, o AS (SELECT n_regionkey::BIGINT AS scaffold, n_nationkey::BIGINT AS rank, (n_nationkey // 2 * 2)::BIGINT AS grp, n_nationkey % 2 = 1 AS rev FROM nation),
u AS (SELECT * FROM (SELECT *, lag(grp) OVER (PARTITION BY scaffold ORDER BY rank) IS NOT DISTINCT FROM grp AS again FROM o) WHERE NOT again),
j AS (SELECT scaffold, hap, rank, comp, len, u.rev <> mem.rev AS rev, CASE WHEN u.rev THEN -pos ELSE pos END AS key FROM u JOIN mem USING (grp)),
k AS (SELECT *, row_number() OVER w AS n, coalesce(sum(len) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + (row_number() OVER w - 1) * 100 AS beg FROM j WINDOW w AS (PARTITION BY scaffold, hap ORDER BY rank, key, comp))
SELECT scaffold, hap, n, comp, rev, beg, beg + len AS "end" FROM k"""
)
def haplotype_layout(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("scaffold"), F.col("n_nationkey").cast("long").alias("rank"), F.expr("cast(n_nationkey div 2 * 2 as bigint)").alias("grp"), (F.col("n_nationkey") % 2 == 1).alias("rev"))
    return layout.haplotype_layout(o, _members(spark, d))


@query(
    f"""WITH {ad.LAYOUT}, o AS (SELECT object, sum(y) AS size, count(*) AS parts FROM segs GROUP BY object), f AS (SELECT object, coalesce(sum(parts) OVER w, 0) AS first, coalesce(sum(size) OVER w, 0) AS base FROM o WINDOW w AS (ORDER BY object ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT object, part, a + base AS "offset", rev, first + row_number() OVER (PARTITION BY object ORDER BY part) AS id FROM segs JOIN f USING (object)),
l AS (SELECT object, string_agg(CASE WHEN rev THEN '-' ELSE '' END || id::BIGINT, ' ' ORDER BY part) AS line FROM s GROUP BY object)
SELECT object, 2 * part AS part, id::BIGINT AS id, "offset"::BIGINT AS "offset", line FROM s JOIN l USING (object)"""
)
def assembly_annotation(spark: SparkSession, d: str) -> DataFrame:
    return layout.assembly_lines(_segments(spark, d))


@query(f"WITH {ad.LAYOUT} SELECT object, row_number() OVER (PARTITION BY object ORDER BY part) AS part, comp, x, y, rev FROM segs")
def layout_from_signed(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d)
    lines = layout.assembly_lines(s)
    fragments = lines.join(s.select("object", "part", "comp", "x", "y"), ["object", "part"]).select("id", "comp", "x", "y")
    return layout.from_signed(lines.select("object", "line").distinct(), fragments)


# Statistics


@query(
    """WITH t AS (SELECT n_chars AS len, row_number() OVER w AS rn, sum(n_chars) OVER (w ROWS UNBOUNDED PRECEDING) AS upto, sum(n_chars) OVER () AS total FROM documents WINDOW w AS (ORDER BY n_chars DESC, doc_id))
SELECT i * 10 AS decile, max(len) AS n, min(rn) AS l FROM t, range(1, 11) r(i) WHERE upto * 10 >= total * i GROUP BY i"""
)
def nl_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.nl_stats(table(spark, d, "documents"), "n_chars")


_COMPLETE = """c AS (SELECT gene, count(*) FILTER (status = 'COMPLETE') AS c, count(*) FILTER (status = 'FRAGMENTED') AS f FROM genes GROUP BY gene)"""


def _gene_counts(spark: SparkSession, d: str) -> DataFrame:
    return ad.genes(spark, d).groupBy("gene").agg(F.count_if(F.col("status") == "COMPLETE").alias("c"), F.count_if(F.col("status") == "FRAGMENTED").alias("f"))


@query(
    f"""WITH {ad.GENES}, {_COMPLETE} SELECT count(*)::BIGINT AS genes, count(*) FILTER (c > 0) AS complete, count(*) FILTER (c = 1 AND f = 0) AS single, count(*) FILTER (c > 0 AND c + f > 1) AS duplicated, count(*) FILTER (c = 0 AND f > 0) AS fragmented, count(*) FILTER (c = 0 AND f = 0) AS missing FROM c"""
)
def gene_completeness(spark: SparkSession, d: str) -> DataFrame:
    c, f = F.col("c"), F.col("f")
    n = lambda x: F.count_if(x)
    return _gene_counts(spark, d).agg(F.count("*").alias("genes"), n(c > 0).alias("complete"), n((c == 1) & (f == 0)).alias("single"), n((c > 0) & (c + f > 1)).alias("duplicated"), n((c == 0) & (f > 0)).alias("fragmented"), n((c == 0) & (f == 0)).alias("missing"))


@query(f"WITH {ad.GENES}, {_COMPLETE} SELECT least(c + f, 6)::BIGINT AS copies, count(*) AS genes FROM c GROUP BY 1")
def gene_copy_hist(spark: SparkSession, d: str) -> DataFrame:
    return _gene_counts(spark, d).groupBy(F.least(F.col("c") + F.col("f"), F.lit(6)).cast("long").alias("copies")).agg(F.count("*").alias("genes"))


@query(
    f"""WITH {ad.GENES}, {_SLICES} SELECT p.name, count(*) AS hits, count(DISTINCT gene) AS genes FROM genes g JOIN pieces p ON g.seq = p.seq AND g."end" > p.beg AND g.beg < p."end" WHERE status = 'COMPLETE' GROUP BY p.name"""
)
def genes_by_piece(spark: SparkSession, d: str) -> DataFrame:
    g = ad.genes(spark, d).where("status = 'COMPLETE'").select("seq", "beg", "end", "gene")
    j = intervals.band_join(g, _slices(spark, d).select("seq", "beg", "end", "name"), bin_size=5000)
    return j.groupBy(F.col("b_name").alias("name")).agg(F.count("*").alias("hits"), F.countDistinct("a_gene").alias("genes"))


@query(
    f"""WITH {ad.GENES}, {_SLICES}, o AS (SELECT g.gene, g.seq, g.beg, g."end", p.name, greatest(g.beg, p.beg) - p.beg AS pbeg, least(g."end", p."end") - p.beg AS pend, row_number() OVER (PARTITION BY g.gene, g.seq, g.beg, g."end" ORDER BY least(g."end", p."end") - greatest(g.beg, p.beg) DESC, p."end") AS rn
FROM (SELECT DISTINCT gene, seq, beg, "end" FROM genes WHERE status = 'FRAGMENTED') g JOIN pieces p ON g.seq = p.seq AND g."end" > p.beg AND g.beg < p."end") SELECT gene, seq, beg, "end", name, pbeg, pend FROM o WHERE rn = 1"""
)
def genes_remapped(spark: SparkSession, d: str) -> DataFrame:
    """Each gene hit on the piece that it overlaps most, clipped to it."""
    g = ad.genes(spark, d).where("status = 'FRAGMENTED'").select("seq", "beg", "end", "gene").distinct()
    j = intervals.band_join(g, _slices(spark, d).select("seq", "beg", "end", "name"), bin_size=5000).withColumn("size", intervals.overlap_bases())
    best = j.groupBy(F.col("a_gene").alias("gene"), F.col("a_seq").alias("seq"), F.col("a_beg").alias("beg"), F.col("a_end").alias("end")).agg(F.max(F.struct("size", (-F.col("b_end")).alias("o"), "b_beg", "b_end", "b_name")).alias("m"))
    return best.select("gene", "seq", "beg", "end", F.col("m.b_name").alias("name"), (F.greatest("beg", "m.b_beg") - F.col("m.b_beg")).alias("pbeg"), (F.least("end", "m.b_end") - F.col("m.b_beg")).alias("pend"))


@query(
    """WITH c AS (SELECT c_custkey, c_acctbal FROM customer), m AS (SELECT median(c_acctbal) AS med FROM c), d AS (SELECT median(abs(c_acctbal - med)) AS mad FROM c, m)
SELECT c_custkey, round(med, 6) AS med, round(mad, 6) AS mad, 0.6745 * abs(c_acctbal - med) > 1.2 * mad AS outlier FROM c, m, d"""
)
def mad_outliers(spark: SparkSession, d: str) -> DataFrame:
    return stats.mad_outliers(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 1.2).select("c_custkey", F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"), "outlier")


@query(
    f"""WITH {ad.CALLS}, r AS (SELECT *, count(*) OVER (ORDER BY pn) AS i, count(*) OVER () AS n FROM calls), c AS (SELECT max(pn) AS cut FROM r WHERE pn * n <= i * 10000000) SELECT seq, pos, pn, key FROM calls, c WHERE pn <= cut"""
)
def bh_significant(spark: SparkSession, d: str) -> DataFrame:
    return stats.significant(ad.calls(spark, d), "pn", F.lit(10_000_000))


@query(
    """WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders),
q AS (SELECT max(v) FILTER (i = floor(n * 0.1)) AS a, max(v) FILTER (i = floor(n * 0.9)) AS b FROM r)
SELECT o_orderkey, round(greatest(0.0::DOUBLE, 0.1 + 0.8 * (o_totalprice - a) / greatest(b - a, 1e-6)), 6) AS scaled FROM orders, q"""
)
def p10_p90_normalise(spark: SparkSession, d: str) -> DataFrame:
    return stats.spread_scaled(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", F.round("scaled", 6).alias("scaled"))


@query(
    f"""WITH {ad.STEPS}, h AS (SELECT cov AS copies, sum("end" - beg)::BIGINT AS bases FROM steps GROUP BY cov), c AS (SELECT *, sum(bases) OVER (ORDER BY copies) AS upto, sum(bases) OVER () AS total FROM h),
k AS (SELECT copies, greatest(0, least(upto, total - floor(total * 0.1)) - greatest(upto - bases, floor(total * 0.1)))::BIGINT AS kept FROM c)
SELECT sum(kept)::BIGINT AS bases, sum(kept * copies)::BIGINT AS weighted, round(sum(kept * copies)::DOUBLE / sum(kept), 6) AS mean FROM k"""
)
def trimmed_mean_cov(spark: SparkSession, d: str) -> DataFrame:
    return stats.trimmed_mean(stats.coverage_histogram(_steps(spark, d), 1 << 30)).withColumn("mean", F.round("mean", 6))


@query(f"WITH {ad.CALLS} SELECT seq, count(*) AS n, sum(w)::BIGINT AS sizes FROM (SELECT seq, sum(new) OVER (PARTITION BY seq ORDER BY pos) AS s, 1 AS w FROM (SELECT seq, pos, CASE WHEN pos < lag(pos) OVER (PARTITION BY seq ORDER BY pos) + 60 THEN 0 ELSE 1 END AS new FROM calls)) GROUP BY seq, s")
def session_calls(spark: SparkSession, d: str) -> DataFrame:
    return breaks.sessions(ad.calls(spark, d), 60).groupBy("seq", "session").agg(F.count("*").alias("n"), F.count("*").alias("sizes")).drop("session")


@query()
def merged_calls(spark: SparkSession, d: str) -> DataFrame:
    c = ad.calls(spark, d)
    s = c.groupBy("seq").agg((F.max("pos") + 30).alias("len"))
    return breaks.merged_calls(c.select("seq", "pos", (F.col("pn") / 1e9).alias("p")), s, 60)


@query(
    f"""WITH {ad.EDGES}, x AS (SELECT a, b, w / 1000.0::DOUBLE AS s FROM edges), e AS (SELECT *, exp((s - max(s) OVER g) / 0.2) AS e, count(*) OVER g AS n FROM x WINDOW g AS (PARTITION BY a)),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY a) AS p FROM e) SELECT a, b, round(p, 6) AS p, round(CASE WHEN n > 1 THEN 1 - (-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) OVER (PARTITION BY a)) / ln(n) ELSE 1 END, 6)::DOUBLE AS conf FROM p"""
)
def softmax_confidence(spark: SparkSession, d: str) -> DataFrame:
    e = ad.edges(spark, d).select("a", "b", (F.col("w") / 1000.0).alias("s"))
    return stats.softmax_confidence(e, "a", "s").select("a", "b", F.round("p", 6).alias("p"), F.round("conf", 6).alias("conf"))


@query(f"WITH {ad.EDGES} SELECT a, w, rank() OVER (ORDER BY w DESC) AS by_weight, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS in_group FROM edges QUALIFY in_group <= 3")
def ranked_edges(spark: SparkSession, d: str) -> DataFrame:
    """The three heaviest edges of each node, with their rank among all (ranks from counts by weight)."""
    e = ad.edges(spark, d)
    by_w = e.groupBy("w").agg(F.count("*").alias("n")).select("w", (F.coalesce(F.sum("n").over(W.orderBy(F.col("w").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1).alias("by_weight"))
    top = e.withColumn("in_group", F.row_number().over(W.partitionBy("a").orderBy(F.col("w").desc(), "b")).cast("long")).where("in_group <= 3")
    return top.join(by_w, "w").select("a", "w", "by_weight", "in_group")


@query("WITH c AS (SELECT c_mktsegment AS hap, count(*) AS n, sum(c_custkey)::BIGINT AS bases FROM customer GROUP BY 1) SELECT hap, n, bases FROM c")
def haplotype_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("hap")).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("bases"))


@query(f"WITH {ad.EDGES} SELECT sum(CASE WHEN a % 2 = b % 2 THEN w ELSE 0 END)::BIGINT AS same, sum(CASE WHEN a % 2 <> b % 2 THEN w ELSE 0 END)::BIGINT AS apart FROM edges")
def partition_weights(spark: SparkSession, d: str) -> DataFrame:
    same = F.col("a") % 2 == F.col("b") % 2
    return ad.edges(spark, d).agg(F.sum(F.when(same, F.col("w")).otherwise(0)).alias("same"), F.sum(F.when(~same, F.col("w")).otherwise(0)).alias("apart"))


@query(f"WITH {ad.ALNS} SELECT aread % 7 AS grp, bread % 7 AS other, line % 2 AS hap, sum(CASE WHEN rev THEN -mlen ELSE mlen END)::BIGINT AS w FROM alns GROUP BY ALL HAVING sum(CASE WHEN rev THEN -mlen ELSE mlen END) <> 0")
def signed_evidence(spark: SparkSession, d: str) -> DataFrame:
    a = ad.alns(spark, d).groupBy((F.col("aread") % 7).alias("grp"), (F.col("bread") % 7).alias("other"), (F.col("line") % 2).alias("hap"))
    return a.agg(F.sum(F.when(F.col("rev"), -F.col("mlen")).otherwise(F.col("mlen"))).alias("w")).where("w <> 0")


@query("WITH r AS (SELECT DISTINCT c_nationkey AS g, c_custkey AS k, c_custkey - row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS run FROM customer) SELECT g, min(k) AS first, max(k) AS last, count(*) AS n FROM r GROUP BY g, run")
def consecutive_runs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("k"))
    r = c.withColumn("run", F.col("k") - F.row_number().over(W.partitionBy("g").orderBy("k")))
    return r.groupBy("g", "run").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("n")).drop("run")


# Sequence text


@query("SELECT doc_id, reverse(translate(text, 'ACBDGHKMRTUVYacbdghkmrtuvy', 'TGVHCDMKYAABRtgvhcdmkyaabr')) AS rc, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') AS masked FROM documents")
def reverse_complements(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", seqf.reverse_complement(F.col("text")).alias("rc"), seqf.masked(F.col("text")).alias("masked"))


@query("SELECT doc_id, doc_id || ':' || greatest(doc_id % 50 - 10, 0) || '-' || least(n_chars - doc_id % 7 + 3, n_chars) AS name, substring(text, greatest(doc_id % 50 - 10, 0) + 1, greatest(least(n_chars - doc_id % 7 + 3, n_chars) - greatest(doc_id % 50 - 10, 0), 0)) AS sub FROM documents")
def subseq_regions(spark: SparkSession, d: str) -> DataFrame:
    """A slice of each text, clipped at both ends, under the name of its region."""
    t = table(spark, d, "documents")
    beg, end = F.col("doc_id") % 50 - 10, F.col("n_chars") - F.col("doc_id") % 7 + 3
    name = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.greatest(beg, F.lit(0)).cast("string"), F.lit("-"), F.least(end, F.col("n_chars")).cast("string"))
    return t.select("doc_id", name.alias("name"), seqf.subsequence(F.col("text"), beg, end).alias("sub"))


@query("SELECT doc_id AS name, length(text)::BIGINT AS len FROM documents WHERE length(text) >= 100")
def seq_index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.length("text").cast("long").alias("len")).where("len >= 100")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 5 = l_suppkey % 5 AND l_linenumber % 2 = 0) OR (l_partkey % 5 = l_suppkey % 5 AND l_linenumber % 2 = 1) AS mates FROM lineitem""")
def mate_names(spark: SparkSession, d: str) -> DataFrame:
    end = lambda k: F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(f"/{k}")
    a, b = F.concat(F.lit("r"), (F.col("l_partkey") % 5).cast("string"), end(1)), F.concat(F.lit("r"), (F.col("l_suppkey") % 5).cast("string"), end(2))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", seqf.are_mates(a, b).alias("mates"))


# Membership and sets


@query(f"WITH {ad.ALNS}, known AS (SELECT s_suppkey AS seq FROM supplier WHERE s_suppkey % 3 <> 0) SELECT bread AS unknown, count(*) AS n FROM alns ANTI JOIN known ON bread = seq GROUP BY bread")
def unknown_names(spark: SparkSession, d: str) -> DataFrame:
    known = ad.sequences(spark, d).where("seq % 3 <> 0").select(F.col("seq").alias("bread"))
    return ad.alns(spark, d).join(known, "bread", "left_anti").groupBy(F.col("bread").alias("unknown")).agg(F.count("*").alias("n"))


@query(f"WITH {ad.SEQS} SELECT seq, name, len FROM seqs WHERE seq NOT IN (SELECT c_nationkey FROM customer)")
def unplaced(spark: SparkSession, d: str) -> DataFrame:
    """Sequences whose number no group of members has."""
    return ad.sequences(spark, d).join(_members(spark, d).select(F.col("grp").alias("seq")), "seq", "left_anti").select("seq", "name", "len")


@query(f"WITH {ad.ALNS} SELECT aread AS seq, 'both' AS side FROM (SELECT aread FROM alns INTERSECT SELECT c_nationkey FROM customer) UNION ALL SELECT aread, 'first' FROM (SELECT aread FROM alns EXCEPT SELECT c_nationkey FROM customer)")
def shared_sequences(spark: SparkSession, d: str) -> DataFrame:
    x, y = ad.alns(spark, d).select(F.col("aread").alias("seq")), _members(spark, d).select(F.col("grp").alias("seq"))
    return x.intersect(y).withColumn("side", F.lit("both")).unionByName(x.subtract(y).withColumn("side", F.lit("first")))


# Graphs


@query(
    f"""WITH RECURSIVE {ad.EDGES}, strong AS (SELECT least(aread, bread) * 8 + line AS a, greatest(aread, bread) * 8 + line AS b FROM alns WHERE aread <> bread), dual AS (SELECT a, b FROM strong UNION SELECT b, a FROM strong),
r(node, low) AS (SELECT s_suppkey * 8 + k, s_suppkey * 8 + k FROM supplier, range(1, 8) n(k) UNION SELECT b, low FROM r JOIN dual ON node = a) SELECT node, min(low) AS component FROM r GROUP BY node"""
)
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    nodes = ad.sequences(spark, d).select(F.explode(F.sequence(F.lit(1), F.lit(7))).alias("line"), "seq")
    return graph.components(ad.line_edges(spark, d), nodes.select((F.col("seq") * 8 + F.col("line")).alias("node")))


@query()
def spanning_forest(spark: SparkSession, d: str) -> DataFrame:
    return graph.spanning_forest(ad.edges(spark, d))


@query()
def forest_positions(spark: SparkSession, d: str) -> DataFrame:
    f = graph.cut(graph.spanning_forest(ad.edges(spark, d)))
    return graph.forest_positions(f, f.select("a", "b", (F.col("b") - F.col("a")).alias("shift")))


def _signed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Signed edges of all sequences by line number, each of which is a graph of its own."""
    e = ad.line_edges(spark, d)
    e = e.select("a", "b", F.when(F.expr("(a + b) % 3 <> 0"), F.col("w")).otherwise(0).alias("overlap"), F.when(F.expr("(a + b) % 3 = 0"), F.col("w")).otherwise(0).alias("contact"))
    s = ad.sequences(spark, d).select(F.explode(F.sequence(F.lit(1), F.lit(7))).alias("line"), "seq", "len")
    return e, s.select((F.col("seq") * 8 + F.col("line")).alias("node"), (F.col("len") + F.col("seq") * 7 % 100).alias("len"))


@query()
def colour_partition(spark: SparkSession, d: str) -> DataFrame:
    return graph.partition(*_signed(spark, d), k=2, method="greedy")


@query()
def refined_partition(spark: SparkSession, d: str) -> DataFrame:
    return graph.partition(*_signed(spark, d), k=3, method="refine")


@query()
def phase_partition(spark: SparkSession, d: str) -> DataFrame:
    return graph.partition(*_signed(spark, d), k=2, method="phase")


@query()
def label_alignment(spark: SparkSession, d: str) -> DataFrame:
    a = ad.alns(spark, d).where("aread % 13 <> bread % 13")
    e = a.select((F.col("aread") % 13).alias("a"), (F.col("line") % 2).alias("la"), (F.col("bread") % 13).alias("b"), (F.col("mlen") % 2).alias("lb"), F.when(F.col("rev"), -F.col("mlen")).otherwise(F.col("mlen")).cast("double").alias("w"))
    return graph.align_labels(e, 2)


@query()
def communities(spark: SparkSession, d: str) -> DataFrame:
    return graph.communities(ad.edges(spark, d))


@query()
def refined_communities(spark: SparkSession, d: str) -> DataFrame:
    return graph.communities(ad.edges(spark, d), refine=True)


@query()
def line_order(spark: SparkSession, d: str) -> DataFrame:
    return graph.line_order(ad.line_edges(spark, d, 12).withColumn("w", F.col("w").cast("double")))


# Chaining, palindromes, breaks, probabilities


def _chain_input(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Alignments ten times as long, so that chains reach the score limits."""
    a = ad.alns(spark, d).where("aread < bread").drop("line")
    for c in ("abpos", "aepos", "bbpos", "bepos", "mlen"):
        a = a.withColumn(c, F.col(c) * 10)
    return a, ad.sequences(spark, d).withColumn("len", F.col("len") * 10)


@query()
def chain_scores(spark: SparkSession, d: str) -> DataFrame:
    return chaining.chain_table(ad.alns(spark, d).where("aread < bread").drop("line"))


@query()
def chained_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return chaining.overlaps(*_chain_input(spark, d))


@query()
def palindromes(spark: SparkSession, d: str) -> DataFrame:
    """Self-alignments, made by taking each alignment onto its first sequence."""
    a, s = _chain_input(spark, d)
    own = a.withColumn("bread", F.col("aread")).withColumn("rev", F.lit(True))
    return chaining.palindromes(own, s, min_size=100_000, min_density=0.1, min_qual=0.0, min_neff=2.0)


@query()
def break_calls(spark: SparkSession, d: str) -> DataFrame:
    return breaks.call_breaks(contact_spans(spark, d), 1000, 3000, alpha=0.5)


@query()
def poisson_binomial_pvalues(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 40).alias("k"), (F.col("p_size") / 2.0).alias("mean"))
    k = F.col("k")
    return p.select("p_partkey", F.round(prob.poisson_upper_p(k, F.col("mean")), 9).alias("poisson_upper"), F.round(prob.poisson_lower_p(k, F.col("mean")), 9).alias("poisson_lower"), F.round(prob.binomial_upper_p(k, F.lit(60), F.lit(0.25)), 9).alias("binomial_upper"))


# Scaffold groups


@query(
    f"""WITH {ad.STEPS}, l AS (SELECT seq, coalesce(sum("end" - beg) FILTER (cov < 9), 0)::BIGINT AS low FROM steps GROUP BY seq)
SELECT seq, low, low < (0.7 + greatest(0.0, least(1.0, (log10(20000.0::DOUBLE) - 4.7) / (6.0 - 4.7))) * (0.3 - 0.7)) * 20000 AS repeat FROM l"""
)
def repeat_marks(spark: SparkSession, d: str) -> DataFrame:
    return scaffold.repeats(_steps(spark, d), ad.sequences(spark, d), 8)


@query(
    f"""WITH {ad.ALNS}, m AS (SELECT s_suppkey AS seq, s_suppkey % 2 AS grp, s_suppkey % 3 = 0 AS rev FROM supplier WHERE s_suppkey < 6),
o AS (SELECT aread, grp, abpos, aepos, alns.rev <> m.rev AS way FROM alns JOIN m ON bread = seq WHERE aread >= 6),
e AS (SELECT aread, grp, pos, sum(x) AS x FROM (SELECT aread, grp, abpos AS pos, 1 AS x FROM o UNION ALL SELECT aread, grp, aepos, -1 FROM o) GROUP BY ALL),
s AS (SELECT aread, grp, lead(pos) OVER w - pos AS size, sum(x) OVER w AS x FROM e WINDOW w AS (PARTITION BY aread, grp ORDER BY pos)),
c AS (SELECT aread, grp, sum(size) FILTER (x > 0)::BIGINT AS size FROM s GROUP BY ALL),
v AS (SELECT aread, grp, coalesce(sum(aepos - abpos) FILTER (way), 0) > coalesce(sum(aepos - abpos) FILTER (NOT way), 0) AS rev FROM o GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY aread ORDER BY size DESC, grp) AS i FROM c JOIN v USING (aread, grp) WHERE size >= 0.5 * 20000)
SELECT aread AS seq, grp, size, rev FROM k WHERE i = 1"""
)
def recruited_sequences(spark: SparkSession, d: str) -> DataFrame:
    m = ad.sequences(spark, d).where("seq < 6").select((F.col("seq") % 2).alias("grp"), "seq", (F.col("seq") % 3 == 0).alias("rev"))
    return scaffold.recruited(ad.alns(spark, d).select("aread", "bread", "abpos", "aepos", "rev"), m, ad.sequences(spark, d), 0.5)


@query()
def backbone_lines(spark: SparkSession, d: str) -> DataFrame:
    a = ad.alns(spark, d).where("aread < bread").withColumns({"type": F.lit(geo.EXTENDS), "score": F.col("mlen").cast("double")})
    return scaffold.backbones(a, ad.sequences(spark, d), 500)


@query()
def merged_groups(spark: SparkSession, d: str) -> DataFrame:
    p = ad.edges(spark, d).select("a", "b", F.col("w").alias("shared"))
    return scaffold.merged_groups(p, ad.sequences(spark, d).select(F.col("seq").alias("grp"), F.col("len").alias("size")))


@query(
    f"""WITH {ad.ALNS}, e AS (SELECT aread AS seq, unnest([abpos, aepos]) AS pos FROM alns WHERE aepos - abpos >= 400), i AS (SELECT * FROM e WHERE pos > 450 AND pos < 20000 - 450),
r AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY seq ORDER BY pos) <= 450 THEN 0 ELSE 1 END AS new FROM i), g AS (SELECT seq, pos, sum(new) OVER (PARTITION BY seq ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY seq, run ORDER BY pos) AS i, count(*) OVER (PARTITION BY seq, run) AS n FROM g)
SELECT seq, pos, n AS support FROM n WHERE i = (n + 1) // 2 AND NOT EXISTS (SELECT 1 FROM alns WHERE aread = seq AND abpos + 450 <= pos AND aepos - 450 >= pos AND abpos + 450 < aepos - 450)"""
)
def variant_candidates(spark: SparkSession, d: str) -> DataFrame:
    o = ad.alns(spark, d).withColumn("type", F.lit(geo.INTERNAL))
    low = ad.sequences(spark, d).select("seq", F.col("len").alias("low"))
    return scaffold.variant_candidates(o, low, ad.sequences(spark, d), least=400, share=0.01, near=450)


@query(
    f"""WITH {ad.EDGES}, x AS (SELECT a, b, w / 1000.0::DOUBLE AS s FROM edges UNION ALL SELECT b, a, w / 1000.0::DOUBLE FROM edges), e AS (SELECT *, exp((s - max(s) OVER g) / 0.2) AS e, count(*) OVER g AS n FROM x WINDOW g AS (PARTITION BY a)),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY a) AS p FROM e), c AS (SELECT a, b, s, p, CASE WHEN n > 1 THEN 1 - (-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) OVER (PARTITION BY a)) / ln(n) ELSE 1 END::DOUBLE AS conf FROM p)
SELECT u.a, u.b, round(u.conf * v.conf * u.p * v.p * u.s, 6) AS w FROM c u JOIN c v ON u.a = v.b AND u.b = v.a"""
)
def mutual_attention(spark: SparkSession, d: str) -> DataFrame:
    e = ad.edges(spark, d).select("a", "b", (F.col("w") / 1000.0).alias("w"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return scaffold.mutual_attention(both).withColumn("w", F.round("w", 6))


# Streaming extension, over the table at rest


@query("SELECT date_trunc('hour', ts) AS beg, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return ev.windowed(table(spark, d, "events"))


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS beg, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return ev.sessions(table(spark, d, "events"))


from spanloom.plans import reads as _reads  # noqa: E402, F401 - registers the queries over reads and files
