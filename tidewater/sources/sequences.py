"""Sequence and alignment formats as tables: FASTA, MAF blocks, weight matrices, wig tracks, SAM and feature attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.sequence import cigar_length


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, seq): records split at >, blank and # lines left out. A record is one row, read where its file is split."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r"))
    lines = F.filter(F.split("r", "\r?\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    return records.select(lines.alias("l")).where(F.size("l") > 0).select(F.regexp_extract(F.col("l")[0], r"^(\S+)", 1).alias("id"), F.regexp_replace(F.col("l")[0], r"^\S+\s*", "").alias("description"), F.array_join(F.transform(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), lambda x: F.regexp_replace(x, r"\s+", "")), "").alias("seq"))


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """(block, org, chrom, start, size, strand, src_size, seq); the last row of an organism counts in a block."""
    blocks = spark.read.option("lineSep", "\na ").text(path).select(F.monotonically_increasing_id().alias("block"), "value")
    blocks = blocks.select("block", F.posexplode(F.split("value", "\n")).alias("at", "line")).where(F.col("line").startswith("s "))
    p = F.split(F.trim("line"), r"\s+")
    rows = blocks.select("block", "at", F.substring_index(p[1], ".", 1).alias("org"), F.substring_index(p[1], ".", -1).alias("chrom"), p[2].cast("long").alias("start"), p[3].cast("long").alias("size"), p[4].alias("strand"), p[5].cast("long").alias("src_size"), p[6].alias("seq"))
    last = rows.groupBy("block", "org").agg(F.max(F.struct("at", "chrom", "start", "size", "strand", "src_size", "seq")).alias("r"))
    return last.select("block", "org", "r.chrom", "r.start", "r.size", "r.strand", "r.src_size", "r.seq")


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, factor, weights array<struct<a, c, g, t>>) of records that end with //."""
    records = spark.read.option("lineSep", "//").text(path).select(F.split("value", "\r?\n").alias("l"))
    field = lambda tag: F.element_at(F.filter("l", lambda x: x.startswith(tag + " ")), 1)
    first = lambda tag: F.when(F.size(F.filter("l", lambda x: x.startswith(tag + " "))) > 0, F.trim(F.substring(field(tag), 3, 10_000)))
    counts = F.transform(F.filter("l", lambda x: x.rlike(r"^\d+\s")), lambda x: F.split(F.trim(x), r"\s+"))
    weights = F.transform(counts, lambda p: F.struct(*[p[i + 1].cast("double").alias(b) for i, b in enumerate("acgt")]))
    return records.where(F.exists("l", lambda x: x.startswith("ID "))).select(first("ID").alias("id"), first("AC").alias("name"), first("BF").alias("factor"), weights.alias("weights"))


def fixed_steps(lines: DataFrame, chunk_by: str = "file") -> DataFrame:
    """(chrom, pos, value) of fixedStep wig lines (line, file, pos): position = start + step * place behind the header."""
    head = F.col("line").startswith("fixedStep")
    part = lambda name, d: F.when(F.col("line").rlike(f"{name}=\\S+"), F.regexp_extract("line", f"{name}=(\\S+)", 1)).otherwise(d)
    w = W.partitionBy(chunk_by).orderBy("pos")
    info = F.when(head, F.struct(F.col("pos").alias("at"), part("chrom", "").alias("chrom"), part("start", "1").cast("long").alias("start"), part("step", "1").cast("long").alias("step")))
    rows = lines.withColumn("h", F.last(info, True).over(w)).withColumn("n", F.row_number().over(w))
    first = rows.where(head).select(F.col(chunk_by).alias("hf"), F.col("pos").alias("hp"), F.col("n").alias("hn"))
    met = rows.where(~head & ~F.col("line").startswith("track") & F.col("h").isNotNull()).join(first, (F.col(chunk_by) == F.col("hf")) & (F.col("h.at") == F.col("hp")))
    return met.select("h.chrom", (F.col("h.start") - 1 + F.col("h.step") * (F.col("n") - F.col("hn") - 1)).alias("pos"), F.col("line").cast("double").alias("value"))


def sam_to_bed(sam: DataFrame) -> DataFrame:
    """Mapped reads as bed6; strand from flag 16, length over M, D, N and P."""
    start = F.col("pos").cast("long") - 1
    return sam.where("pos > 0").select(F.col("rName").alias("chrom"), start.alias("start"), (start + cigar_length("cigar")).alias("end"), F.col("qName").alias("name"), cigar_length("cigar", "M").cast("int").alias("score"), F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+").alias("strand"))


def blast_to_bed(m8: DataFrame) -> DataFrame:
    """Hits as bed6 with ends in order."""
    a, b = F.least("tStart", "tEnd").cast("long"), F.greatest("tStart", "tEnd").cast("long")
    return m8.select(F.col("tName").alias("chrom"), (a - 1).alias("start"), b.alias("end"), F.col("qName").alias("name"), F.col("alnScore").cast("int").alias("score"), F.when(F.col("tStart") <= F.col("tEnd"), "+").otherwise("-").alias("strand"))


def gff_to_bed(gff: DataFrame, feature: str | None = None) -> DataFrame:
    rows = gff.where(F.col("feature") == feature) if feature else gff
    return rows.select("chrom", (F.col("start") - 1).alias("start"), "end", F.col("feature").alias("name"), F.coalesce(F.floor(F.col("score").try_cast("double") * 1000), F.lit(0)).cast("int").alias("score"), "strand")


def bed_to_gff(bed: DataFrame, source: str = "bed") -> DataFrame:
    return bed.select("chrom", F.lit(source).alias("source"), F.lit("feature").alias("feature"), (F.col("start") + 1).alias("start"), "end", F.col("score").cast("string").alias("score"), "strand", F.lit(".").alias("frame"), F.col("name").alias("attributes"))


def gff3_attributes(gff: DataFrame) -> DataFrame:
    """Adds the map of k=v;k=v attributes; empty intervals go."""
    return gff.where("start <= end").withColumn("attr", F.str_to_map("attributes", F.lit(";"), F.lit("=")))


def gtf_longest_transcripts(gtf: DataFrame) -> DataFrame:
    """(gene_id, transcript_id, length): each gene's longest transcript by exon span; ties to the smallest id."""
    of = lambda k: F.regexp_extract("attributes", f'{k} "([^"]*)"', 1)
    spans = gtf.where("feature = 'exon'").groupBy(of("gene_id").alias("gene_id"), of("transcript_id").alias("transcript_id")).agg((F.max("end") - F.min("start") + 1).alias("length"))
    best = spans.groupBy("gene_id").agg(F.min(F.struct((-F.col("length")).alias("l"), F.col("transcript_id").alias("t"))).alias("b"))
    return best.select("gene_id", F.col("b.t").alias("transcript_id"), (-F.col("b.l")).alias("length"))


def split_occurrences(vcf: DataFrame) -> DataFrame:
    """A row for each project of an OCCURRENCE=a|n|m|f,... field."""
    o = F.explode(F.split(F.regexp_extract("info", "OCCURRENCE=([^;]*)", 1), ",")).alias("occurrence")
    return vcf.where(F.col("info").contains("OCCURRENCE=")).select("*", o).withColumn("project", F.substring_index("occurrence", "|", 1))


def indels_or_snps(vcf: DataFrame, snps: bool) -> DataFrame:
    """Variants with both alleles of length 1, or the others."""
    single = (F.length("ref") == 1) & (F.length("alt") == 1)
    return vcf.where(single if snps else ~single)


def xml_fields(df: DataFrame, xml: str, paths: dict[str, str], default: str = "") -> DataFrame:
    """Columns from XPath expressions over an XML column; equality predicates go into the paths."""
    return df.select("*", *[F.coalesce(F.nullif(F.xpath_string(xml, F.lit(p)), F.lit("")), F.lit(default)).alias(n) for n, p in paths.items()])


def xml_all(df: DataFrame, xml: str, path: str, out: str) -> DataFrame:
    """A row for each text of an XPath."""
    return df.withColumn(out, F.explode(F.xpath(xml, F.lit(path))))


def match_to_bed(matches: DataFrame) -> DataFrame:
    """(chrom, start, end, name, thick_start, thick_end) of matches (chrom, start, name, site); capitals in the site are its core."""
    lead = F.length("site") - F.length(F.regexp_replace("site", "^[^A-Z]+", ""))
    core = F.length(F.regexp_extract("site", "[A-Z]+", 0))
    return matches.select("chrom", "start", (F.col("start") + F.length("site")).alias("end"), "name", (F.col("start") + lead).alias("thick_start"), (F.col("start") + lead + core).alias("thick_end"))
