"""Tables of word blocks: stretches of a genome with the motif words found in them and the genes beside them.

A block is a row (block, chrom, start, end, score, genes array<string>, words map<string, array<struct<pos, strand>>>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "map<string, array<struct<pos: long, strand: string>>>"


def read_motifs(lines: DataFrame) -> DataFrame:
    """(motif, description) of the `m` lines of a word file."""
    part = F.split("line", "\t")
    return lines.where(F.col("line").startswith("m\t")).select(F.upper(part[1]).alias("motif"), F.coalesce(F.get(part, F.lit(2)), F.lit("")).alias("description"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a word file: a `b` line (chrom, start, end), then n (number), s (score), f (a gene) and w (word, place, strand) lines.

    Records are split at their first line, so a block is one row wherever its file is cut.
    """
    records = spark.read.option("lineSep", "\nb\t").text(path).select(F.split(F.regexp_replace("value", "^b\t", ""), "\r?\n").alias("l"))
    records = records.where(F.size(F.split(F.col("l")[0], "\t")) >= 3).where(~F.col("l")[0].startswith("#"))
    head = F.split(F.col("l")[0], "\t")
    all_of = lambda tag: F.transform(F.filter("l", lambda x: x.startswith(tag + "\t")), lambda x: F.split(F.substring(x, 3, 1_000_000), "\t"))
    first = lambda tag: F.get(F.get(all_of(tag), F.lit(0)), F.lit(0))
    hits = all_of("w")
    names = F.array_distinct(F.transform(hits, lambda w: F.upper(w[0])))
    places = F.transform(names, lambda n: F.transform(F.filter(hits, lambda w: F.upper(w[0]) == n), lambda w: F.struct(w[1].cast("long").alias("pos"), w[2].alias("strand"))))
    return records.select(first("n").cast("long").alias("block"), head[0].alias("chrom"), head[1].cast("long").alias("start"), head[2].cast("long").alias("end"), first("s").cast("double").alias("score"), F.transform(all_of("f"), lambda x: x[0]).alias("genes"), F.map_from_arrays(names, places).alias("words"))


def block_text(blocks: DataFrame) -> DataFrame:
    """(value): the lines of each block, as read_blocks takes them; genes and words in order."""
    genes = F.transform(F.array_sort("genes"), lambda g: F.concat(F.lit("f\t"), g))
    entries = F.transform(F.array_sort(F.map_keys("words")), lambda w: F.transform(F.element_at("words", w), lambda p: F.concat_ws("\t", F.lit("w"), w, p["pos"].cast("string"), p["strand"])))
    lines = F.concat(F.array(F.concat_ws("\t", F.lit("b"), "chrom", F.col("start").cast("string"), F.col("end").cast("string")), F.concat(F.lit("n\t"), F.col("block").cast("string")), F.concat(F.lit("s\t"), F.col("score").cast("string"))), genes, F.flatten(entries))
    return blocks.select(F.array_join(lines, "\n").alias("value"))


def postings(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(motif, block, n) and (block, gene): the inverted index and the flanking genes."""
    words = blocks.select("block", F.explode("words").alias("motif", "hits")).select("motif", "block", F.size("hits").cast("long").alias("n"))
    return words, blocks.select("block", F.explode("genes").alias("gene"))


def filter_words(blocks: DataFrame, least: int = 1, motifs: list[str] | None = None) -> DataFrame:
    """Blocks with the words that occur at least so often in them (and are in the list); blocks without words go."""
    def keep(word: Column, hits: Column) -> Column:
        enough = F.size(hits) >= least
        return enough if motifs is None else enough & word.isin(*motifs)

    return blocks.withColumn("words", F.map_filter("words", keep)).where(F.size("words") > 0)


def filter_blocks(blocks: DataFrame, low: float | None = None, high: float | None = None, chrom: str | None = None, genes: DataFrame | None = None) -> DataFrame:
    """Blocks by score range, chromosome, and having one of the genes (a column `gene`)."""
    out = blocks
    if low is not None:
        out = out.where(F.col("score") >= low)
    if high is not None:
        out = out.where(F.col("score") <= high)
    if chrom is not None:
        out = out.where(F.col("chrom") == chrom)
    if genes is None:
        return out
    hit = blocks.select("block", F.explode("genes").alias("gene")).join(genes.select("gene").distinct(), "gene", "left_semi").select("block").distinct()
    return out.join(hit, "block", "left_semi")


def gene_scores(blocks: DataFrame) -> DataFrame:
    """(gene, score): summed scores of the blocks beside each gene."""
    return blocks.select("score", F.explode(F.array_distinct("genes")).alias("gene")).groupBy("gene").agg(F.sum("score").alias("score"))


def gene_lengths(blocks: DataFrame, tissues: DataFrame) -> DataFrame:
    """(tissue, gene, bp): length of the blocks beside each gene, for (gene, tissue) pairs."""
    sizes = blocks.select((F.col("end") - F.col("start")).alias("bp"), F.explode(F.array_distinct("genes")).alias("gene"))
    return sizes.join(tissues.select("gene", "tissue").distinct(), "gene").groupBy("tissue", "gene").agg(F.sum("bp").alias("bp"))


def gene_words(blocks: DataFrame, least: int = 1) -> DataFrame:
    """(gene, motif, n): occurrences of each word beside each gene, those with at least so many."""
    rows = blocks.select(F.explode(F.array_distinct("genes")).alias("gene"), "words").select("gene", F.explode("words").alias("motif", "hits"))
    return rows.groupBy("gene", "motif").agg(F.sum(F.size("hits")).cast("long").alias("n")).where(F.col("n") >= least)


def words_to_bed(blocks: DataFrame) -> DataFrame:
    """Each occurrence of a word as bed6."""
    rows = blocks.select("chrom", F.explode("words").alias("name", "hits"), "score").select("chrom", "name", "score", F.explode("hits").alias("h"))
    return rows.select("chrom", F.col("h.pos").alias("start"), (F.col("h.pos") + F.length("name")).alias("end"), "name", F.floor("score").cast("int").alias("score"), F.col("h.strand").alias("strand"))


def with_combination(blocks: DataFrame, motifs: list[str], least: int = 1) -> DataFrame:
    """Adds `found`: whether the block holds every word of the combination at least so often."""
    every = [F.coalesce(F.size(F.element_at("words", F.lit(m))), F.lit(0)) >= least for m in motifs]
    found = every[0]
    for c in every[1:]:
        found = found & c
    return blocks.withColumn("found", found)


def combination_matrix(blocks: DataFrame, combinations: dict[str, list[str]]) -> DataFrame:
    """(block, a 0/1 column for each combination of words)."""
    has = lambda ms: F.forall(F.array(*[F.lit(m) for m in ms]), lambda m: F.map_contains_key("words", m))
    return blocks.select("block", *[has(ms).cast("int").alias(n) for n, ms in combinations.items()])


def block_sequences(blocks: DataFrame, rows: DataFrame, spacer: str = "NNNNNNNNN") -> DataFrame:
    """(gene, org, seq): aligned rows (chrom, start, org, seq) of the blocks beside a gene, joined in order with a spacer."""
    met = blocks.select("chrom", "start", F.explode(F.array_distinct("genes")).alias("gene")).join(rows, ["chrom", "start"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chrom", "start", "seq"))), lambda x: x["seq"])
    return met.groupBy("gene", "org").agg(F.array_join(ordered, spacer).alias("seq"))
