"""Mixing sources to target weights (op7), with DataFrame functions only.

Every row gets a hash-random key; within its source, rows are range-sorted by it: the key's first digits are the range, so that even a
source with most of the rows is spread over all ranges. Words are summed by range, the sums' prefix gives each range's offset, and a
window inside the range gives each row's. A source's budget is cut exactly: whole epochs first, then the rows in key order, the last of
them in part.

Sources weigh 3, 1, 2, repeating, by code point with null last. They share 150% of all words; a source gets at most twice its own, and
what is over goes to the others by weight. Null texts have no words and are taken with 0. Rows that share key and size are
interchangeable. Texts of any length are counted whole (one that crosses the budget is taken in part); repeated rows are taken one by one;
an empty table gives no rows. `mix` reads the key, the text, the source and the columns to carry, `mixed` returns all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.base import WORD, cut, table, unused, word_count


def random_key(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """sizes: one row a source, with source and source_size. Adds target, by filling all sources to the same level per weight."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    s = sizes.withColumn("weight", weight).withColumn("full", F.col("source_size") * float(epochs) / F.col("weight"))
    order = W.orderBy("full", F.col("source").asc_nulls_last())
    lower = F.coalesce(F.sum(F.col("source_size") * epochs).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    level = (F.sum("source_size").over(W.partitionBy()) * F.lit(share) - lower) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level", level).withColumn("i", F.row_number().over(order))
    fits = F.when(F.col("level") <= F.col("full"), F.col("level"))
    s = s.withColumn("level", F.min_by(fits, F.when(fits.isNotNull(), F.col("i"))).over(W.partitionBy()))
    return s.select("source", "source_size", F.least(F.col("source_size") * float(epochs), F.col("weight") * F.col("level")).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", digits: int = 3, share: float = 1.5, carry: list[str] | None = None) -> DataFrame:
    """(key, source, size, source_size, target, taken) of every row, and the columns to carry along."""
    h = random_key(F.col(key), seed)
    kept = [F.col(c) for c in carry or []]
    rows = cut(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), h.alias("h"), F.substring(h, 1, digits).alias("range"), *kept))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    goal = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), share=share)
    before = F.sum("range_size").over(W.partitionBy("source").orderBy("range")) - F.col("range_size")
    at = ranges.withColumn("range_start", before).alias("a").join(goal.alias("g"), F.col("a.source").eqNullSafe(F.col("g.source"))).select("a.source", "range", "range_start", "source_size", "target")
    joined = rows.alias("r").join(at.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r.range") == F.col("t.range"))).select("r.*", "range_start", "source_size", "target")
    order = W.partitionBy("source", "range").orderBy("h", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    start = F.col("range_start") + F.sum("size").over(order) - F.col("size")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - F.col("epochs") * F.col("source_size") - F.col("start")))
    return joined.withColumn("start", start).withColumn("epochs", epochs).select(F.col("id").alias(key), "source", "size", "source_size", "target", taken.alias("taken"), *(carry or []))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of `docs` as often as they are taken, the last of a source cut after the words taken from it.

    Texts are joined to what is taken of them once. Rows that are equal in key, text and source are taken together, with the other columns
    of the one whose columns have the least hash. All columns are returned, whatever their names.
    """
    from spanloom.llm.near_dedup import distinct_rows

    by, row = [key, text, source], unused(docs, "row")
    named = docs.select(*by, F.xxhash64(*by).alias("row"))
    taken = mix(named.withColumnsRenamed({key: "key", text: "text", source: "source"}), "key", carry=["row"], **options)
    parts = taken.groupBy("row").agg(F.sum("taken").alias("taken"), F.first("size").alias("size")).where("taken > 0")
    parts = parts.withColumn("full", F.expr("taken div size").cast("int")).withColumn("rest", (F.col("taken") % F.col("size")).cast("int"))
    whole, part = F.array_repeat(F.lit(-1), F.col("full")), unused(docs, "part")
    parts = parts.select(F.col("row").alias(row), F.when(F.col("rest") > 0, F.array_append(whole, F.col("rest"))).otherwise(whole).alias(part))
    joined = distinct_rows(docs, by, parts, row).withColumn(part, F.explode(part))
    cut_text = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1)), 1, F.greatest(part, F.lit(0))), " ")
    return joined.select(*[F.when(F.col(part) > 0, cut_text).otherwise(F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
o AS (SELECT *, source_size * 2.0::DOUBLE / weight AS filled FROM s),
l AS (SELECT *, row_number() OVER w AS i, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM o WINDOW w AS (ORDER BY filled, source NULLS LAST)),
g AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, weight * (SELECT min_by(level, i) FROM l WHERE level <= filled)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - d.size AS start,
  CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - start)))::BIGINT AS taken FROM p
"""
