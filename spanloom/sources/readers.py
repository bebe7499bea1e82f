"""Text formats as DataFrames. All are read as lines by Spark, split there, and checked; compressed files are read as Spark's codecs do.

File order, where it means something, is the line's place: `ranked` numbers lines by file, partition and place in the partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.scale import zero


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, place): lines that aren't blank, without carriage returns; places grow in file order."""
    t = spark.read.text(path).select(F.rtrim(F.regexp_replace("value", "\r$", "")).alias("line"), F.monotonically_increasing_id().alias("place"))
    return t.where(F.trim("line") != "")


def fields(df: DataFrame, sep: str = r"\s+") -> DataFrame:
    """With f, the fields of each line. A generator keeps them a column: else each condition on a field would split the line again."""
    return df.withColumn("f", F.explode(F.array(F.split(F.trim("line") if sep == r"\s+" else F.col("line"), sep))))


def number(i: int) -> Column:
    return F.try_element_at("f", F.lit(i)).try_cast("long")


def text(i: int) -> Column:
    return F.try_element_at("f", F.lit(i))


def ranked(df: DataFrame, by: str = "place") -> DataFrame:
    """`df` with rank from 0 in order of a place. Places are partition number and line number: counts by partition give each one's offset."""
    part = F.shiftright(by, 33)
    counts = df.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    start = counts.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), zero()).alias("__start"))
    d = df.withColumn("__part", part).join(F.broadcast(start), "__part")
    return d.withColumn("rank", F.col("__start") + F.row_number().over(W.partitionBy("__part").orderBy(by)) - 1).drop("__part", "__start")


def first_of_name(df: DataFrame) -> DataFrame:
    """Of rows that share a name the first one, with seq, its number in file order."""
    kept = df.withColumn("__i", F.row_number().over(W.partitionBy("name").orderBy("place"))).where("__i = 1").drop("__i")
    return ranked(kept).withColumnRenamed("rank", "seq").drop("place")


def index(spark: SparkSession, path: str, min_len: int = 0) -> DataFrame:
    """(name, len, seq) of an index: the first two columns of each line."""
    t = fields(lines(spark, path)).select(text(1).alias("name"), number(2).alias("len"), "place").where(F.col("len") >= min_len)
    return first_of_name(t)


def fasta(spark: SparkSession, path: str, min_len: int = 0, with_text: bool = True) -> DataFrame:
    """(name, len, seq[, text]) of FASTA records; a record begins at a line that begins with >."""
    t = spark.read.option("lineSep", "\n>").text(path).withColumn("place", F.monotonically_increasing_id()).withColumn("value", F.regexp_replace("value", "^>", "")).where(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    t = t.select(F.regexp_extract(head, r"^\s*(\S*)", 1).alias("name"), body.alias("text"), "place").withColumn("len", F.length("text").cast("long")).where(F.col("len") >= min_len)
    out = first_of_name(t)
    return out if with_text else out.drop("text")


def fastq(spark: SparkSession, path: str, min_len: int = 0) -> DataFrame:
    """(name, len, seq, text, quality) of FASTQ records of four lines."""
    t = ranked(lines(spark, path)).withColumn("k", F.expr("rank div 4")).withColumn("i", F.col("rank") % 4)
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("line")))
    r = t.groupBy("k").agg(at(0).alias("head"), at(1).alias("text"), at(3).alias("quality"), F.min("place").alias("place"))
    r = r.select(F.regexp_extract("head", r"^@(\S*)", 1).alias("name"), "text", "quality", F.length("text").cast("long").alias("len"), "place").where(F.col("len") >= min_len)
    return first_of_name(r)


def gfa(spark: SparkSession, path: str, min_len: int = 0) -> DataFrame:
    """(name, len, seq) of segment lines, by their LN tag or their sequence."""
    t = fields(lines(spark, path).where(F.col("line").startswith("S\t")), "\t")
    tag = F.regexp_extract("line", r"\tLN:i:(\d+)", 1)
    length = F.when(tag != "", tag.cast("long")).when(text(3) != "*", F.length(text(3)).cast("long"))
    return first_of_name(t.select(text(2).alias("name"), length.alias("len"), "place").where(F.col("len") >= min_len))


# AGP component types, gaps and orientations.
COMPONENTS = ("A", "D", "F", "G", "O", "P", "W")
GAPS = ("N", "U")
ORIENTATIONS = ("+", "-", "?", "0", "na")


def agp(spark: SparkSession, path: str, allow_unknown: bool = False) -> DataFrame:
    """Parts of an AGP file as `layout.offsets` takes them: object, part, kind (W, or a gap's), comp, x, y, rev, gap, and gap_type, linkage, evidence.

    The file order gives the part; an unknown orientation counts as forward if allowed, else such parts go.
    """
    t = ranked(fields(lines(spark, path).where(~F.col("line").startswith("#")), r"\s+"))
    kind = F.upper(text(5))
    gap, way = kind.isin(*GAPS), F.lower(text(9))
    out = t.select(
        text(1).alias("object"), F.col("rank").alias("part"), F.when(gap, kind).otherwise("W").alias("kind"), F.when(~gap, text(6)).alias("comp"),
        F.when(gap, zero()).otherwise(number(7) - 1).alias("x"), F.when(gap, zero()).otherwise(number(8) - number(7) + 1).alias("y"), (~gap & (way == "-")).alias("rev"),
        F.when(gap, number(6)).otherwise(zero()).alias("gap"), F.when(gap, text(7)).alias("gap_type"), F.when(gap, text(8)).alias("linkage"), F.when(gap, text(9)).alias("evidence"), way.alias("way"), kind.alias("given"),
    )
    known = F.col("way").isin("+", "-") if not allow_unknown else F.col("way").isin(*ORIENTATIONS)
    return out.where(((F.col("kind") != "W") & (F.col("gap") >= 0)) | (F.col("given").isin(*COMPONENTS) & known & (F.col("x") >= 0) & (F.col("y") > 0))).drop("way", "given")


def paf(spark: SparkSession, path: str, sequences: DataFrame | None = None) -> DataFrame:
    """Alignments of a PAF file: lines of 12 columns or more with valid ranges; with sequences (name, len, seq), names and lengths must match, and ids are added."""
    t = fields(lines(spark, path), "\t").where(F.size("f") >= 12)
    t = t.select(
        text(1).alias("qn"), number(2).alias("ql"), number(3).alias("qs"), number(4).alias("qe"), (text(5) == "-").alias("rev"), text(6).alias("tn"), number(7).alias("tl"), number(8).alias("ts"), number(9).alias("te"),
        number(10).alias("ml"), number(11).alias("bl"), number(12).alias("mq"),
    )
    t = t.where("0 <= qs and qs < qe and qe <= ql and 0 <= ts and ts < te and te <= tl")
    if sequences is None:
        return t
    a, b = (sequences.select(F.col("name").alias(n), F.col("len").alias(l), F.col("seq").alias(s)) for n, l, s in (("qn", "ql", "aread"), ("tn", "tl", "bread")))
    return t.join(a, ["qn", "ql"]).join(b, ["tn", "tl"]).select("aread", "bread", "rev", F.col("qs").alias("abpos"), F.col("qe").alias("aepos"), F.col("ts").alias("bbpos"), F.col("te").alias("bepos"), F.col("ml").alias("mlen"), F.col("bl").alias("blen"), "mq")


def bed_reads(spark: SparkSession, path: str, sequences: DataFrame) -> DataFrame:
    """Read records of a BED file as `contacts.pair_adjacent` takes them; records on unknown sequences count as neighbours and go with their pair."""
    from spanloom.functions.sequence import mate_stem

    t = ranked(fields(lines(spark, path)).where(F.size("f") >= 5))
    s = sequences.select(F.col("name").alias("__name"), F.col("seq"), F.col("len"))
    t = t.select(text(1).alias("__name"), number(2).alias("beg"), number(3).alias("end"), text(4).alias("name"), number(5).alias("q"), "rank").join(s, "__name", "left")
    clip = lambda c: F.greatest(zero(), F.least(F.col(c), F.col("len")))
    return t.select("rank", mate_stem(F.col("name")).alias("stem"), "seq", clip("beg").alias("beg"), clip("end").alias("end"), "q")


def pa5(spark: SparkSession, path: str, sequences: DataFrame, read_len: int = 150) -> DataFrame:
    """Pairs, one a line: aseq, apos, bseq, bpos (middles of reads of read_len, clipped), q."""
    from spanloom.functions.scale import midpoint

    t = fields(lines(spark, path)).where(F.size("f") >= 5)
    t = t.select(text(2).alias("an"), number(3).alias("a"), text(4).alias("bn"), number(5).alias("b"), F.least(F.coalesce(number(6), F.lit(255)), F.coalesce(number(7), F.lit(255))).alias("q"))
    for side in ("a", "b"):
        s = sequences.select(F.col("name").alias(f"{side}n"), F.col("seq").alias(f"{side}seq"), F.col("len").alias("__len"))
        t = t.join(s, f"{side}n").withColumn(f"{side}pos", midpoint(F.greatest(zero(), F.least(F.col(side), F.col("__len"))), F.greatest(zero(), F.least(F.col(side) + read_len, F.col("__len"))))).drop("__len")
    return t.select("aseq", "apos", "bseq", "bpos", "q")


def genes(spark: SparkSession, path: str) -> DataFrame:
    """Gene hits of a completeness table: gene, status, name, beg, end (0-based, half-open; ends in order), strand; missing genes have no place."""
    t = fields(lines(spark, path).where(~F.col("line").startswith("#"))).where(F.size("f") >= 2)
    status = F.when(F.lower(text(2)) == "missing", "MISSING").when(F.lower(text(2)) == "fragmented", "FRAGMENTED").otherwise("COMPLETE")
    t = t.withColumn("status", status).where((F.col("status") == "MISSING") | (F.size("f") >= 6))
    here = F.col("status") != "MISSING"
    lo, hi = F.least(number(4), number(5)), F.greatest(number(4), number(5))
    return t.select(text(1).alias("gene"), "status", F.when(here, text(3)).alias("name"), F.when(here, lo - 1).alias("beg"), F.when(here, hi).alias("end"), F.when(here, text(6)).alias("strand"))


def regions(spark: SparkSession, path: str) -> DataFrame:
    """(name, beg, end): a name alone is the whole sequence (nulls), with one number that base, with two the half-open range."""
    t = fields(lines(spark, path))
    n = F.size("f")
    return t.select(text(1).alias("name"), F.when(n == 2, number(2) - 1).when(n > 2, number(2)).alias("beg"), F.when(n == 2, number(2)).when(n > 2, number(3)).alias("end"))


def contact_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sequences (seq, name, len), bin size (width), contacts (aseq, abin, bseq, bbin, n), and notes (key, value) of a contact map's lines."""
    t = fields(lines(spark, path), "\t")
    kind = lambda k: t.where(text(1) == k)
    s = ranked(kind("S")).select(F.col("rank").alias("seq"), text(2).alias("name"), number(3).alias("len"))
    c = kind("C").select(number(2).alias("aseq"), number(3).alias("abin"), number(4).alias("bseq"), number(5).alias("bbin"), number(6).alias("n"))
    notes = t.where(F.col("line").startswith("#")).select(F.trim(F.regexp_extract("line", r"^#+\s*([^:=]*)[:=]", 1)).alias("key"), F.trim(F.regexp_extract("line", r"^[^:=]*[:=](.*)", 1)).alias("value")).where("key <> ''")
    return s, kind("B").select(number(2).alias("width")), c, notes


def placements(spark: SparkSession, path: str, hap: int | None = None) -> DataFrame:
    """(name, beg, end, rev, grp, hap, pos): seven columns or more a line; with a label, that one alone."""
    t = fields(lines(spark, path).where(~F.col("line").startswith("#"))).where(F.size("f") >= 7)
    out = t.select(text(1).alias("name"), number(2).alias("beg"), number(3).alias("end"), (text(4) == "-").alias("rev"), number(5).alias("grp"), number(6).alias("hap"), number(7).alias("pos"))
    return out if hap is None else out.where(F.col("hap") == hap)


def signed_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Fragments (name, id, len) and objects (object, line) of an assembly annotation."""
    t = ranked(lines(spark, path))
    f = fields(t.where(F.col("line").startswith(">"))).select(F.substring(text(1), 2, 1 << 30).alias("name"), number(2).alias("id"), number(3).alias("len"))
    o = ranked(t.where(~F.col("line").startswith(">")).drop("rank"))
    return f, o.select((F.col("rank") + 1).alias("object"), "line")


def selected(sequences: DataFrame, names: DataFrame) -> DataFrame:
    """Sequences in the order in which names (name, rank) ask for them."""
    return sequences.join(names.select("name", "rank"), "name")


def mismatches(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, len, side) of entries of two dictionaries that aren't in both with the same length."""
    a, b = found.select("name", "len"), wanted.select("name", "len")
    return a.join(b, ["name", "len"], "left_anti").withColumn("side", F.lit("found")).unionByName(b.join(a, ["name", "len"], "left_anti").withColumn("side", F.lit("wanted")))


def union_all(tables: list[DataFrame]) -> DataFrame:
    """Several inputs as one bag."""
    return reduce(DataFrame.unionByName, tables)


def is_typed_lines(spark: SparkSession, path: str, kind: str = "aln") -> bool:
    """Whether a file's first line says that it is a typed-line file of a kind: a 1, the kind's length and its name."""
    first = spark.read.text(path).limit(1).first()
    return first is not None and (first["value"] or "").split()[:3] == ["1", str(len(kind)), kind]


def alignments(spark: SparkSession, path: str, sequences: DataFrame | None = None) -> DataFrame:
    """Alignments of a PAF or a typed-line file, told by its first line, as (aread, bread, rev, abpos, aepos, bbpos, bepos, mlen); typed lines bring their own numbers."""
    columns = ("aread", "bread", "rev", "abpos", "aepos", "bbpos", "bepos", "mlen")
    if is_typed_lines(spark, path):
        from spanloom.sources import binary

        binary.register(spark)
        return spark.read.format("typed_alignments").load(path).where("0 <= abpos and abpos < aepos and 0 <= bbpos and bbpos < bepos").select(*columns)
    if sequences is None:
        raise ValueError("alignments by names need sequences (name, len, seq)")
    return paf(spark, path, sequences).select(*columns)


#: What a contact input's name ends in, by kind.
CONTACT_KINDS = {".bam": "bam", ".bin": "bin", "1map": "map", ".bed": "bed", ".bed.gz": "bed", ".pa5": "pa5", ".pa5.gz": "pa5"}


def contact_kind(path: str) -> str:
    """The kind of a contact input by its name."""
    name = path.rstrip("/").lower()
    for end, kind in CONTACT_KINDS.items():
        if name.endswith(end):
            return kind
    raise ValueError(f"{path}: the name has to end in one of {', '.join(CONTACT_KINDS)}, or the kind has to be given")


def contacts(spark: SparkSession, path: str, sequences: DataFrame, kind: str | None = None, read_len: int = 150) -> DataFrame:
    """Pairs (aseq, apos, bseq, bpos, q) of a contact input of any kind, told by its name if not given. Mapped reads without qualities have 255."""
    from spanloom.operators.contacts import pair_adjacent
    from spanloom.sources import bam, binary

    binary.register(spark)
    kind = kind or contact_kind(path)
    columns = ("aseq", "apos", "bseq", "bpos", "q")
    if kind == "bam":
        return bam.contact_pairs(spark, path, sequences)
    if kind == "bin":
        return spark.read.format("contact_records").load(path).select(*columns)
    if kind == "bed":
        return pair_adjacent(bed_reads(spark, path, sequences)).where("aseq is not null and bseq is not null").select(*columns)
    if kind == "pa5":
        return pa5(spark, path, sequences, read_len).select(*columns)
    if kind == "map":
        return mapped_pairs(spark.read.format("typed_mappings").load(path)).select(*columns)
    raise ValueError(f"{kind}: not a kind of contact input")


def mapped_pairs(mapped: DataFrame) -> DataFrame:
    """Pairs of unique mappings (read, len, seq, pos): mates are an odd read and the next one; the middles of both."""
    from spanloom.functions.scale import midpoint

    side = lambda s, odd: mapped.where(F.col("read") % 2 == odd).select((F.col("read") - (1 - odd)).alias("mate"), F.col("seq").alias(f"{s}seq"), midpoint(F.col("pos"), F.col("pos") + F.col("len")).alias(f"{s}pos"))
    return side("a", 1).join(side("b", 0), "mate").select("aseq", "apos", "bseq", "bpos", F.lit(255).alias("q"))
