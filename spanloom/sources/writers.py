"""Text outputs, written by Spark: AGP, contact maps, links, reports, sequences."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.scale import midpoint
from spanloom.functions.sequence import wrapped


def tabbed(df: DataFrame, path: str, order: list[str] | None = None, compression: str = "none") -> None:
    """Columns with tabs between them; sorted across files if an order is given."""
    df = df.orderBy(*order) if order else df
    df.select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def agp(rows: DataFrame, path: str) -> None:
    """Rows of `layout.agp`."""
    tabbed(rows.select("object", "obj_beg", "obj_end", "part", "kind", "c1", "c2", "c3", "c4"), path, ["object", "part"])


def map_width(total: int, bins: int) -> int:
    """The bin size that cuts a total length into about so many bins."""
    return 1 + (max(total, 1) - 1) // bins


def contact_map(sequences: DataFrame, contacts: DataFrame, width: int, path: str) -> None:
    """Lines S (name, length), B (bin size) and C (ends and count), in that order."""
    line = lambda *c: F.concat_ws("\t", *[x.cast("string") for x in c])
    s = sequences.select(F.lit(1).alias("o"), F.col("seq").alias("k"), line(F.lit("S"), F.col("name"), F.col("len")).alias("value"))
    b = sequences.sparkSession.range(1).select(F.lit(2).alias("o"), F.lit(0).cast("long").alias("k"), line(F.lit("B"), F.lit(width)).alias("value"))
    c = contacts.select(F.lit(3).alias("o"), F.col("aseq").alias("k"), line(F.lit("C"), *[F.col(x) for x in ("aseq", "abin", "bseq", "bbin", "n")]).alias("value"))
    s.unionByName(b).unionByName(c).orderBy("o", "k", "value").select("value").write.mode("overwrite").text(path)


def links(rows: DataFrame, path: str, compression: str = "none") -> None:
    """Rows of `contacts.juicer_links` as lines of two ends with their fragments 0 and 1."""
    v = F.concat_ws(" ", F.lit("0"), "aname", F.col("apos").cast("string"), F.lit("0"), F.lit("1"), "bname", F.col("bpos").cast("string"), F.lit("1"))
    rows.orderBy("aname", "bname", "apos", "bpos").select(v.alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def fasta(rows: DataFrame, path: str, width: int = 60, compression: str = "none") -> None:
    """rows: name, seq."""
    rows.select(F.concat(F.lit(">"), "name", F.lit("\n"), wrapped(F.col("seq"), width)).alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def groups(placed: DataFrame, path: str) -> None:
    """placed: name, beg, end, grp, hap, scf, under a header."""
    head = placed.sparkSession.range(1).select(F.lit(0).alias("o"), F.lit("#s_id\ts_beg\ts_end\tgrp\thap\tscf").alias("value"))
    body = placed.select(F.lit(1).alias("o"), F.concat_ws("\t", "name", *[F.col(c).cast("string") for c in ("beg", "end", "grp", "hap", "scf")]).alias("value"))
    head.unionByName(body).orderBy("o", "value").select("value").write.mode("overwrite").text(path)


def ploidy(table: DataFrame, path: str) -> None:
    table.select(F.concat(F.lit("Ploidy\t"), F.col("ploidy").cast("string")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def haplotypes(segments: DataFrame, path: str) -> None:
    """One folder a haplotype."""
    segments.write.mode("overwrite").partitionBy("hap").parquet(path)


def contact_file(libraries: list[DataFrame], sequences: DataFrame, path: str, parts: int | None = None, records_per_file: int = 4_000_000) -> None:
    """Pairs of one or several libraries as one folder of contact files, in order of their ends; raw if they have abeg, aend, bbeg, bend, else compact.

    sequences: name, len, seq (from 0, without gaps). The dictionary is in each file's header, so it has to fit one task's memory; the pairs
    are dealt by ranges of their first end and never meet in one place. The lesser sequence's end comes first; q is held to 0 to 255.
    """
    from spanloom.sources import binary

    binary.register(sequences.sparkSession)
    known = sequences.orderBy("seq").select("name", "len").collect()
    both = reduce(DataFrame.unionByName, libraries)
    own = [c for c in ("seq", "beg", "end", "pos") if f"a{c}" in both.columns]
    swap = F.col("aseq") > F.col("bseq")
    ends = [F.when(swap, F.col(f"{o}{c}")).otherwise(F.col(f"{s}{c}")).alias(f"{s}{c}") for s, o in ("ab", "ba") for c in own]
    rows = both.select(*ends, F.greatest(F.lit(0), F.least(F.col("q"), F.lit(255))).cast("int").alias("q"))
    first = "abeg" if "abeg" in rows.columns else "apos"
    rows = rows.repartitionByRange(*([parts] if parts else []), "aseq", first, F.xxhash64(*rows.columns)).sortWithinPartitions("aseq", first, "bseq")
    dictionary = json.dumps({"names": [r["name"] for r in known], "lengths": [r["len"] for r in known]})
    rows.write.format("contact_records").option("dictionary", dictionary).option("recordsPerFile", records_per_file).mode("overwrite").save(path)


def backbone_contacts(pairs: DataFrame, marks: DataFrame, sequences: DataFrame, backbones: DataFrame, path: str, width: int = 1000) -> None:
    """Pairs on backbones as a compact contact file, in `path`/contacts, and their windows' norms (seq, win, norm) in `path`/norms.

    sequences: seq, len, rev; backbones: name, len, seq. Both come from the same pairs (`layout.on_backbone`), which are checkpointed once.
    """
    from spanloom.operators import intervals, layout, stats
    from spanloom.operators.graph import cut

    moved = cut(layout.on_backbone(pairs, sequences, marks))
    middle = {f"{s}pos": midpoint(F.col(f"{s}beg"), F.col(f"{s}end")) for s in "ab"}
    contact_file([moved.withColumns(middle).select("aseq", "apos", "bseq", "bpos", F.lit(255).alias("q"))], backbones, f"{path}/contacts")
    reach = moved.select(F.explode(F.array(*(F.struct(*(F.col(f"{s}{c}").alias(c) for c in ("seq", "beg", "end"))) for s in "ab"))).alias("e")).select("e.*")
    steps = intervals.coverage(reach.where("beg < end"), backbones)
    hist = stats.coverage_histogram(steps, 1 << 30).where("copies > 0")
    mean = stats.trimmed_mean(hist).first()["mean"]
    intervals.window_norms(steps, width, F.lit(float(mean or 1.0))).write.mode("overwrite").parquet(f"{path}/norms")
