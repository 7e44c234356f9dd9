"""Transcripts as ordered chains of exons: comparison of two sets by name and by structure.

A transcript is a row (name, chrom, strand, tx_start, tx_end, cds_start, cds_end, exon_starts, exon_ends) with exons in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACE = ["chrom", "strand", "tx_start", "tx_end"]
COLUMNS = ["name", *PLACE, "cds_start", "cds_end", "exon_starts", "exon_ends"]


def from_exons(exons: DataFrame) -> DataFrame:
    """Transcripts of exon rows (name, chrom, strand, start, end, coding): exons that touch are one, the coding part runs from the first
    coding row to the last; without one it is empty, at the start."""
    rows = exons.where(F.col("start") < F.col("end"))
    parts = F.array_sort(F.collect_list(F.struct("start", "end")))
    out = rows.groupBy("name", "chrom", "strand").agg(parts.alias("p"), F.min(F.when(F.col("coding"), F.col("start"))).alias("c"), F.max(F.when(F.col("coding"), F.col("end"))).alias("d"))
    first = F.slice("p", 1, 1)

    def step(acc, x):
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(x["start"] <= last["end"], longer).otherwise(F.concat(acc, F.array(x)))

    out = out.withColumn("e", F.aggregate(F.slice("p", 2, F.size("p")), first, step))
    start, end = F.col("e")[0]["start"], F.element_at("e", -1)["end"]
    return out.select("name", "chrom", "strand", start.alias("tx_start"), end.alias("tx_end"), F.coalesce("c", start).alias("cds_start"), F.coalesce("d", start).alias("cds_end"), F.transform("e", lambda x: x["start"]).alias("exon_starts"), F.transform("e", lambda x: x["end"]).alias("exon_ends"))


def introns(starts: str, ends: str) -> Column:
    """The splice sites of a transcript: where each exon but the last ends and the next one begins."""
    n = F.greatest(F.size(ends) - 1, F.lit(0))
    return F.arrays_zip(F.slice(ends, 1, n).alias("from"), F.slice(starts, 2, n).alias("to"))


def same_name_classes(a: DataFrame, b: DataFrame, close: int = 10, versions: bool = True) -> DataFrame:
    """(name, exact, same_place, same_introns, same_coding, close, start_close, end_close, overlap) of names with one transcript in each set.

    exact: all columns agree (an unknown chromosome agrees with none); same_place: chromosome, strand and both ends. close: both ends less than `close` apart; start_close and
    end_close: that one end only, the other equal. All but overlap, which needs the chromosome only, ask for one chromosome
    and strand. versions off takes names up to their first dot. Names are counted before they meet, so that many transcripts of
    one name never multiply.
    """
    key = F.col("name") if versions else F.substring_index("name", ".", 1)

    def once(df: DataFrame, p: str) -> DataFrame:
        row = F.struct(*COLUMNS[1:])
        return df.groupBy(key.alias("name")).agg(F.count("*").alias("n"), F.min(row).alias(p)).where("n = 1").drop("n")

    met = once(a, "a").join(once(b, "b"), "name")
    x, y = (lambda c: F.col("a")[c]), (lambda c: F.col("b")[c])
    strand = (x("chrom") == y("chrom")) & (x("strand") == y("strand"))
    start, end = F.abs(x("tx_start") - y("tx_start")), F.abs(x("tx_end") - y("tx_end"))
    place = strand & (start == 0) & (end == 0)
    chain = introns("a.exon_starts", "a.exon_ends") == introns("b.exon_starts", "b.exon_ends")
    flags = {
        "exact": strand & (F.col("a") == F.col("b")), "same_place": place, "same_introns": strand & chain, "same_coding": strand & (x("cds_start") == y("cds_start")) & (x("cds_end") == y("cds_end")),
        "close": strand & (start < close) & (end < close), "start_close": strand & (start > 0) & (start < close) & (end == 0), "end_close": strand & (start == 0) & (end > 0) & (end < close),
        "overlap": (x("chrom") == y("chrom")) & (x("tx_start") < y("tx_end")) & (y("tx_start") < x("tx_end")),
    }
    return met.select("name", *[F.coalesce(v, F.lit(False)).alias(c) for c, v in flags.items()])


def class_totals(classes: DataFrame) -> DataFrame:
    """One row of counts: common names, exact ones, of the others those of equal place, and of the rest each class and those apart."""
    rest = ~F.col("exact") & ~F.col("same_place")
    counts = [F.count_if(rest & F.col(c)).alias(f"n_{c}") for c in ("same_introns", "same_coding", "close", "start_close", "end_close", "overlap")]
    return classes.agg(F.count("*").alias("n_common"), F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact") & F.col("same_place")).alias("n_same_place"), *counts, F.count_if(rest & ~F.col("overlap")).alias("n_apart"))


def structure_matches(a: DataFrame, b: DataFrame, close: int = 10) -> DataFrame:
    """(name, kind, other, n): for each transcript of a the best kind of counterpart in b, whatever the names.

    Kinds, best first: `exons` the same exons; `introns` the same splice sites, at least one; `near` both ends less than `close` apart;
    `none`. other is the least name of that kind and n how many there are. The first two are equi-joins on a digest of the chain, verified
    by the chain itself, the third one on bins of the start; b is grouped before it meets, so pairs are never listed.
    """
    chains = {"exons": F.arrays_zip(F.col("exon_starts").alias("from"), F.col("exon_ends").alias("to")), "introns": introns("exon_starts", "exon_ends")}
    mine = a.select(*COLUMNS)
    for kind, chain in chains.items():
        keyed = lambda df: df.withColumn("chain", chain).withColumn("digest", F.xxhash64("chrom", "strand", "chain"))  # noqa: B023, E731
        groups = keyed(b).where(F.size("chain") > 0).groupBy("digest", "chrom", "strand", "chain").agg(F.min("name").alias("other"), F.count("*").alias("n"))
        groups = groups.select("digest", F.col("chrom").alias("b chrom"), F.col("strand").alias("b strand"), F.col("chain").alias("b chain"), F.struct("other", "n").alias(kind))
        same = (F.col("digest") == F.col("b digest")) & (F.col("chrom") == F.col("b chrom")) & (F.col("strand") == F.col("b strand")) & (F.col("chain") == F.col("b chain"))
        mine = keyed(mine).join(groups.withColumnRenamed("digest", "b digest"), same, "left").drop("chain", "digest", "b digest", "b chrom", "b strand", "b chain")
    places = b.groupBy(*PLACE).agg(F.min("name").alias("other"), F.count("*").alias("n"))
    spread = places.select("chrom", "strand", F.col("tx_start").alias("s"), F.col("tx_end").alias("e"), "other", "n", F.explode(F.array(*[F.floor(F.col("tx_start") / close) + k for k in (-1, 0, 1)])).alias("bin"))
    asked = mine.select(*PLACE).distinct().withColumn("bin", F.floor(F.col("tx_start") / close))
    near = asked.join(spread, ["chrom", "strand", "bin"]).where((F.abs(F.col("tx_start") - F.col("s")) < close) & (F.abs(F.col("tx_end") - F.col("e")) < close))
    near = near.groupBy(*PLACE).agg(F.struct(F.min("other").alias("other"), F.sum("n").alias("n")).alias("near"))
    met = mine.join(near, PLACE, "left")
    kinds = ["exons", "introns", "near"]
    kind = F.coalesce(*[F.when(F.col(k).isNotNull(), k) for k in kinds], F.lit("none"))
    best = F.coalesce(*kinds)
    return met.select("name", kind.alias("kind"), best["other"].alias("other"), F.coalesce(best["n"], F.lit(0)).alias("n"))
