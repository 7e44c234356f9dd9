"""Benchmark statistics of predictions against a reference: sets per object, 0/1 labels, tracks of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import joint_coverage, overlap_join


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; NULL where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0e0))


def set_benchmark(predictions: DataFrame, reference: DataFrame, key: str, value: str) -> DataFrame:
    """One row over the objects on both sides: TP, FN, FP, precision, recall, F and the perfect, partial and missed objects.

    Values meet by an equi-join on (key, value), so no object's values are gathered.
    """
    p, r = (df.select(F.col(key).alias("k"), F.col(value).cast("string").alias("v")).distinct() for df in (predictions, reference))
    sides = p.withColumn("p", F.lit(1)).join(r.withColumn("r", F.lit(1)), ["k", "v"], "full")
    per = sides.groupBy("k").agg(F.count_if(F.col("p").isNotNull() & F.col("r").isNotNull()).alias("tp"), F.count_if(F.col("p").isNull()).alias("fn"), F.count_if(F.col("r").isNull()).alias("fp"))
    both = per.where((F.col("tp") + F.col("fp") > 0) & (F.col("tp") + F.col("fn") > 0))
    tp, fn, fp = F.coalesce(F.sum("tp"), F.lit(0)), F.coalesce(F.sum("fn"), F.lit(0)), F.coalesce(F.sum("fp"), F.lit(0))
    sums = both.agg(F.count("*").alias("n_objects"), tp.alias("tp"), fn.alias("fn"), fp.alias("fp"), F.count_if((F.col("fn") == 0) & (F.col("fp") == 0)).alias("n_perfect"), F.count_if((F.col("tp") > 0) & ((F.col("fn") > 0) | (F.col("fp") > 0))).alias("n_partial"), F.count_if(F.col("tp") == 0).alias("n_missed"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = sums.withColumn("precision", precision).withColumn("recall", recall)
    return out.withColumn("f_score", 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0e0)))


def compare_sets(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_a, n_b, n_common, verdict) of the values of every key on either side."""
    x, y = (df.select(F.col(key).alias("key"), F.col(value).cast("string").alias("v")).distinct() for df in (a, b))
    sides = x.withColumn("a", F.lit(1)).join(y.withColumn("b", F.lit(1)), ["key", "v"], "full")
    n = sides.groupBy("key").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_common"))
    verdict = F.when((F.col("n_a") == 0) | (F.col("n_b") == 0), "absent").when((F.col("n_common") == F.col("n_a")) & (F.col("n_a") == F.col("n_b")), "completeMatch").when(F.col("n_common") == 0, "allDifferent").otherwise("partialMatch")
    return n.withColumn("verdict", verdict)


def confusion(tp: str = "tp", fp: str = "fp", fn: str = "fn", tn: str = "tn") -> dict[str, Column]:
    """Sensitivity, specificity, predictive value, accuracy and correlation of confusion counts, as column expressions."""
    t, f, m, n = (F.col(c).cast("double") for c in (tp, fp, fn, tn))
    return {
        "sensitivity": ratio(t, t + m),
        "specificity": ratio(n, n + f),
        "ppv": ratio(t, t + f),
        "npv": ratio(n, n + m),
        "accuracy": ratio(t + n, t + f + m + n),
        "cc": (t * n - m * f) / F.nullif(F.sqrt((t + m) * (n + f) * (t + f) * (n + m)), F.lit(0e0)),
    }


def binary_benchmark(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row of counts and metrics of two 0/1 columns."""
    p, a = F.col(predicted) == 1, F.col(actual) == 1
    counts = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull()).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    return counts.withColumns(confusion())


def hit_stats(universe: DataFrame, predictions: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """binary_benchmark of membership in two id sets over a universe of ids."""
    flag = lambda df, out: df.select(key, F.lit(1).alias(out)).distinct()
    met = universe.select(key).distinct().join(flag(predictions, "p"), key, "left").join(flag(targets, "t"), key, "left").fillna(0, ["p", "t"])
    return binary_benchmark(met, "p", "t")


def track_benchmark(predictions: DataFrame, reference: DataFrame, genome_size: int) -> DataFrame:
    """Element and nucleotide level figures of two tracks over a genome of a given size: one sweep for positions, one a track for elements."""
    place = ["chrom", "start", "end"]
    hit = overlap_join(reference.select(*place), predictions, "semi").agg(F.count("*").alias("ref_hit"))
    right = overlap_join(predictions.select(*place), reference, "semi").agg(F.count("*").alias("pred_hit"))
    sizes = reference.agg(F.count("*").alias("n_ref")).crossJoin(predictions.agg(F.count("*").alias("n_pred")))
    bp = joint_coverage(predictions, reference).select(F.col("a_bp").alias("pred_bp"), F.col("b_bp").alias("ref_bp"), F.col("both_bp").alias("tp"))
    out = sizes.crossJoin(hit).crossJoin(right).crossJoin(bp)  # one row each
    out = out.withColumn("fp", F.col("pred_bp") - F.col("tp")).withColumn("fn", F.col("ref_bp") - F.col("tp")).withColumn("tn", F.lit(genome_size) - F.col("tp") - F.col("fp") - F.col("fn"))
    out = out.withColumn("element_sn", ratio(F.col("ref_hit"), F.col("n_ref"))).withColumn("element_ppv", ratio(F.col("pred_hit"), F.col("n_pred")))
    return out.withColumns(confusion()).drop("accuracy", "npv")


def motif_benchmark(hits: DataFrame, foreground: DataFrame, n_all: int) -> DataFrame:
    """(motif, n_genes, tp, fp, fn, tn and metrics) of motifs' gene sets against a foreground; hits have motif and gene."""
    genes = hits.select("motif", "gene").distinct().join(foreground.select("gene").distinct().withColumn("f", F.lit(1)), "gene", "left")
    size = foreground.select("gene").distinct().agg(F.count("*").alias("n_fg"))
    per = genes.groupBy("motif").agg(F.count("*").alias("n_genes"), F.count("f").alias("tp")).crossJoin(F.broadcast(size))
    per = per.withColumn("fp", F.col("n_genes") - F.col("tp")).withColumn("fn", F.col("n_fg") - F.col("tp")).withColumn("tn", F.lit(n_all) - F.col("n_genes") - F.col("fn"))
    return per.withColumns(confusion()).drop("n_fg")
