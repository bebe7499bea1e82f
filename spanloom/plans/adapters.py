"""The engine's record types read from the supplied business tables, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.ranges import tasks_for
from spanloom.session import table

LENGTH = 20_000


def sequences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_name").alias("name"), F.lit(LENGTH).cast("long").alias("len"))


def alns(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "supplier").count()
    x = table(spark, d, "lineitem").withColumn("size", F.col("l_quantity").cast("long") * 20)
    x = x.withColumn("abpos", F.expr("(l_orderkey * 7 + l_linenumber * 13) % 19000")).withColumn("bbpos", F.expr("(l_partkey * 11 + l_linenumber * 17) % 19000"))
    return x.select(
        F.col("l_suppkey").alias("aread"), (F.col("l_partkey") % n).alias("bread"), (F.col("l_returnflag") == "R").alias("rev"), "abpos", (F.col("abpos") + F.col("size")).alias("aepos"),
        "bbpos", (F.col("bbpos") + F.col("size")).alias("bepos"), F.expr("size * (100 - cast(round(l_discount * 100) as bigint)) div 100").alias("mlen"), F.col("l_linenumber").cast("long").alias("line"),
    )


def reads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("name"), F.col("l_suppkey").alias("seq"), F.expr("(l_partkey * 31 + l_orderkey * 7) % 20000").alias("pos"), F.col("l_quantity").cast("long").alias("q"), "l_linenumber", "l_partkey", "l_suppkey",
    )


def layout(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as slices with a gap after each."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("object"), F.col("o_orderkey").alias("key"), F.floor("o_totalprice").cast("long").alias("y"), (F.col("o_orderstatus") == "F").alias("rev"))
    w = o.select("object", (F.col("key") * 2).alias("part"), F.lit("W").alias("kind"), F.col("key").alias("comp"), F.lit(0).cast("long").alias("x"), "y", "rev", F.lit(0).cast("long").alias("gap"))
    g = o.select("object", (F.col("key") * 2 + 1).alias("part"), F.lit("N").alias("kind"), F.lit(None).cast("long").alias("comp"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(False).alias("rev"), F.lit(100).cast("long").alias("gap"))
    return w.unionByName(g)


def genes(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "COMPLETE").when(F.col("l_returnflag") == "R", "FRAGMENTED").otherwise("MISSING")
    beg = F.expr("(l_orderkey * 7 + l_linenumber * 13) % 19000")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("gene"), status.alias("status"), F.col("l_suppkey").alias("seq"), beg.alias("beg"), (beg + F.col("l_quantity").cast("long") * 20).alias("end"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    a = alns(spark, d).where("aread <> bread").select(F.least("aread", "bread").alias("a"), F.greatest("aread", "bread").alias("b"), "mlen")
    return a.repartition(tasks_for(table(spark, d, "lineitem")), "a", "b").groupBy("a", "b").agg(F.sum("mlen").alias("w"))


def line_edges(spark: SparkSession, d: str, groups: int | None = None) -> DataFrame:
    """The edges of each line number by itself: nodes are sequence * 8 + line number, so there are seven graphs, and every alignment is used.

    groups: sequences are put together into so many before.
    """
    a = alns(spark, d)
    if groups:
        a = a.withColumns({c: F.col(c) % groups for c in ("aread", "bread")})
    node = lambda f: (f("aread", "bread") * 8 + F.col("line")).alias("a" if f is F.least else "b")
    return a.where("aread <> bread").groupBy(node(F.least), node(F.greatest)).agg(F.sum("mlen").alias("w"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    k = F.expr("o_orderkey % 1000 + 1")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("seq"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long").alias("pos"), (k * k * k).alias("pn"), F.col("o_orderkey").alias("key"))


# The same records in SQL.
SEQS = "seqs AS (SELECT s_suppkey AS seq, s_name AS name, 20000::BIGINT AS len FROM supplier)"
ALNS = """alns AS (SELECT l_suppkey AS aread, l_partkey % (SELECT count(*) FROM supplier) AS bread, l_returnflag = 'R' AS rev, (l_orderkey * 7 + l_linenumber * 13) % 19000 AS abpos,
  (l_orderkey * 7 + l_linenumber * 13) % 19000 + l_quantity::BIGINT * 20 AS aepos, (l_partkey * 11 + l_linenumber * 17) % 19000 AS bbpos, (l_partkey * 11 + l_linenumber * 17) % 19000 + l_quantity::BIGINT * 20 AS bepos,
  l_quantity::BIGINT * 20 * (100 - round(l_discount * 100)::BIGINT) // 100 AS mlen, l_linenumber::BIGINT AS line FROM lineitem)"""
IVALS = ALNS + ",\nivals AS (SELECT aread AS seq, abpos AS beg, aepos AS \"end\" FROM alns)"
STEPS = (
    IVALS
    + ",\n"
    + SEQS
    + """,
ev AS (SELECT seq, pos, sum(d)::BIGINT AS d FROM (SELECT seq, beg AS pos, 1 AS d FROM ivals UNION ALL SELECT seq, "end", -1 FROM ivals UNION ALL SELECT seq, 0, 0 FROM seqs UNION ALL SELECT seq, len, 0 FROM seqs) GROUP BY seq, pos),
steps AS (SELECT * FROM (SELECT seq, pos AS beg, lead(pos) OVER (PARTITION BY seq ORDER BY pos) AS "end", sum(d) OVER (PARTITION BY seq ORDER BY pos)::BIGINT AS cov FROM ev) WHERE "end" IS NOT NULL)"""
)
PAIRS = """reads AS (SELECT l_orderkey AS name, l_suppkey AS seq, (l_partkey * 31 + l_orderkey * 7) % 20000 AS pos, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem),
pairs AS (SELECT a.name, a.i // 2 AS k, a.seq AS aseq, a.pos AS apos, b.seq AS bseq, b.pos AS bpos, least(a.q, b.q) AS q FROM reads a JOIN reads b ON a.name = b.name AND a.i + 1 = b.i AND a.i % 2 = 0),
canon AS (SELECT name, k, CASE WHEN s THEN bseq ELSE aseq END AS aseq, CASE WHEN s THEN bpos ELSE apos END AS apos, CASE WHEN s THEN aseq ELSE bseq END AS bseq, CASE WHEN s THEN apos ELSE bpos END AS bpos, q
  FROM (SELECT *, aseq > bseq OR (aseq = bseq AND apos > bpos) AS s FROM pairs))"""
MATRIX = PAIRS + ",\nmatrix AS (SELECT aseq, apos // 1000 AS abin, bseq, bpos // 1000 AS bbin, count(*)::BIGINT AS n FROM canon GROUP BY ALL)"
SYMM = MATRIX + ",\nsymm AS (SELECT * FROM matrix UNION ALL SELECT bseq, bbin, aseq, abin, n FROM matrix WHERE aseq <> bseq)"
LAYOUT = """parts AS (SELECT o_custkey AS object, o_orderkey AS part, o_orderkey AS comp, floor(o_totalprice)::BIGINT AS y, o_orderstatus = 'F' AS rev FROM orders),
segs AS (SELECT *, 0::BIGINT AS x, coalesce(sum(y) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a,
  coalesce(sum(y + 100) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM parts WINDOW w AS (PARTITION BY object ORDER BY part))"""
GENES = """genes AS (SELECT l_partkey AS gene, CASE l_returnflag WHEN 'A' THEN 'COMPLETE' WHEN 'R' THEN 'FRAGMENTED' ELSE 'MISSING' END AS status, l_suppkey AS seq,
  (l_orderkey * 7 + l_linenumber * 13) % 19000 AS beg, (l_orderkey * 7 + l_linenumber * 13) % 19000 + l_quantity::BIGINT * 20 AS "end" FROM lineitem)"""
EDGES = ALNS + ",\nedges AS (SELECT least(aread, bread) AS a, greatest(aread, bread) AS b, sum(mlen)::BIGINT AS w FROM alns WHERE aread <> bread GROUP BY ALL)"
CALLS = """calls AS (SELECT o_custkey AS seq, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::BIGINT AS pos, (o_orderkey % 1000 + 1) * (o_orderkey % 1000 + 1) * (o_orderkey % 1000 + 1) AS pn, o_orderkey AS key FROM orders)"""
