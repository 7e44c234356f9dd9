"""Mixing sources to target weights by hash-threshold histograms, without sorting documents.

Documents get a 36-bit hash. Sizes are summed by source and hash bucket; the bucket in which a source's budget runs out
is the only one refined, by further bits, until it holds about one document. Below the threshold a document is taken once
more than the source's whole passes. Only DataFrame operations; text is read once, sizes are kept as a written table.

Sources are ranked by code point, null last; weights repeat along the ranks. Targets share the budget by weight and stop at
max_epochs times their source's size; what lies above is shared among the others by weight until none is above.

Defined cases: a null text has size 0; a null source is a source of its own; rows with one id share its hash, so repeated
rows are taken alike; a null id is hashed as a value of its own; an empty table gives an empty result; only the id, source
and text columns are read. Reruns agree: hashes depend on ids alone. Texts of any length are counted whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD_PATTERN, fresh_name, named, staged

BITS, LEVELS = 12, 3


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Adds the 0-based rank by source, null last, from range-partitioned order; one number a partition reaches the driver."""
    spark = sources.sparkSession
    ordered = staged(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["p"], r["n"]) for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(before, "p long, before long"))  # a row for each shuffle partition at most
    return ordered.join(offsets, part == F.col("p")).select("source", "source_size", (F.col("before") + place).alias("rank"))


def source_targets(sources: DataFrame, weights: tuple[int, ...], budget: float, max_epochs: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size, rank)."""
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = staged(sources.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * max_epochs).alias("most")))
    total = budget * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("most") < F.col("weight") * F.lit(level)
        full, free, n = table.agg(F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if n == capped:
            break
        capped = n
        if not free:
            break
        level = (total - (full or 0)) / free
    return table.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("weight") * F.lit(float(level or 0.0))).alias("target"))


def _hash(id_col: str):
    return F.shiftrightunsigned(F.xxhash64(named(id_col), F.lit("mix")), 64 - BITS * LEVELS)


def _sizes(docs: DataFrame, id_col: str, source: str, text: str) -> DataFrame:
    words = F.coalesce(F.regexp_count(named(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    return staged(docs.select(named(id_col).alias("id"), named(source).cast("string").alias("source"), words.alias("size"), _hash(id_col).alias("hash")))


def mix_plan(sized: DataFrame, weights: tuple[int, ...], budget: float, max_epochs: int) -> DataFrame:
    """(key: the source, source_size, target, passes, edge): a document is taken passes times, and once more if its hash is below edge."""
    plan = source_targets(ranked_sources(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), weights, budget, max_epochs)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = staged(plan.withColumn("passes", passes).withColumn("left", F.col("target") - F.col("passes") * F.col("source_size")))
    # (source, floor, left): the boundary bucket begins at hash floor; left words remain for it.
    bound = plan.select("source", "left", F.lit(0).cast("long").alias("floor"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = bound.select(F.col("source").alias("s"), "left", "floor")
        near = sized.join(inside, F.col("source").eqNullSafe(F.col("s"))).where((F.col("hash") >= F.col("floor")) & (F.col("hash") < F.col("floor") + (1 << (shift + BITS))))
        buckets = near.groupBy("s", "left", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        run = F.sum("n").over(W.partitionBy("s").orderBy("bucket"))
        crossed = buckets.withColumn("upto", run).where(F.col("upto") > F.col("left"))
        first = crossed.groupBy("s").agg(F.min_by(F.struct("bucket", "n", "upto", "left"), "bucket").alias("b"))
        bound = staged(first.select(F.col("s").alias("source"), (F.col("b.left") - (F.col("b.upto") - F.col("b.n"))).alias("left"), F.shiftleft("b.bucket", shift).alias("floor"), F.col("b.n").alias("n")))
    # The last bucket goes to the side that leaves the source nearer to its target. Without a boundary nothing is left to take.
    edge = bound.select(F.col("source").alias("s"), (F.col("floor") + F.when(F.col("n") < 2 * F.col("left"), 1).otherwise(0)).alias("edge"))
    return staged(plan.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("key"), "source_size", "target", "passes", F.coalesce("edge", F.lit(0)).alias("edge")))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.0, max_epochs: int = 3, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(id, size, source_size, target, taken) of every row: taken is size times the passes in which the mix takes it."""
    sized = _sizes(docs, id_col, source, text)
    plan = mix_plan(sized, weights, budget, max_epochs)
    taken = F.col("size") * (F.col("passes") + F.when(F.col("hash") < F.col("edge"), 1).otherwise(0))
    return sized.join(plan, F.col("source").eqNullSafe(F.col("key"))).select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))


def take_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.0, max_epochs: int = 3, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with all its columns."""
    plan = mix_plan(_sizes(docs, id_col, source, text), weights, budget, max_epochs)
    own = fresh_name("mix plan", docs.columns)
    small = plan.select(F.struct("key", "passes", "edge").alias(own))
    met = docs.join(small, named(source).cast("string").eqNullSafe(named(own)["key"]))
    times = named(own)["passes"] + F.when(_hash(id_col) < named(own)["edge"], 1).otherwise(0)
    return met.withColumn(own, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*map(named, docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return mix_sources(read_table(spark, sf_dir, "documents"))
