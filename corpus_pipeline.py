"""A corpus from documents to packed sequences, in five stages; part of the subpackage llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the columns of their
input, whatever their names. In every stage null texts count as empty, texts of any length are read whole, an empty table gives no rows,
and rows that share id and text are one document where the stage compares documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.base import cut, table
from spanloom.llm.mixing import mixed
from spanloom.llm.near_dedup import keep_one
from spanloom.llm.packing import pack
from spanloom.llm.quality import passing
from spanloom.llm.substrings import cut_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null and empty texts are rejected, repeated rows are judged one by one."""
    return passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row with the least id stays (null ids last); texts without words are classes of their own."""
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a lesser id holds are cut out; a text that loses nothing stays as it is, one that loses all becomes empty."""
    return cut_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (those without words: never); the one at a source's budget is cut there."""
    return mixed(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token identifiers; an empty text is its separator, repeated rows are packed once each."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: Near duplicates by sketches and packing by tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are checkpointed, as the next one reads them several times."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
