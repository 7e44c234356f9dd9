"""Ordered operators: best rows per key, ranks, reciprocal bests, sequential numbering and seeded sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .staging import written


def top_n(df: DataFrame, label: str, score: str, n: int, ties: list[str], out: str = "place") -> DataFrame:
    """The n rows of each label with the highest score; ties fall by the other columns, highest first."""
    place = F.row_number().over(W.partitionBy(label).orderBy(F.desc(score), *[F.desc(t) for t in ties]))
    # The bound stands on the bare row number, which lets each task cut its groups to n rows before the shuffle.
    return df.withColumn(out, place).where(F.col(out) <= n).withColumn(out, F.col(out).cast("long"))


def best_rows(df: DataFrame, key: str, score: str) -> DataFrame:
    """All rows with their key's highest score. A max-aggregate and a join, so a hot key is never sorted in one task."""
    best = df.groupBy(F.col(key).alias("best key")).agg(F.max(score).alias("best score"))
    return df.join(best, (F.col(key) == F.col("best key")) & (F.col(score) == F.col("best score"))).drop("best key", "best score")


def best_by(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """(key, columns) of the row with the greatest order tuple; a partial aggregate, no window."""
    best = df.groupBy(key).agg(F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("b"))
    return best.select(key, *[f"b.{c}" for c in columns])


def best_matches(hits: DataFrame, n: int, max_e: float | None = None, min_identity: float | None = None) -> DataFrame:
    """The best n subjects of each query by e-value: (query, subject, e_value, identity); self hits go, subjects count once."""
    rows = hits.where(F.col("query") != F.col("subject"))
    if max_e is not None:
        rows = rows.where(F.col("e_value") <= max_e)
    if min_identity is not None:
        rows = rows.where(F.col("identity") >= min_identity)
    best = rows.groupBy("query", "subject").agg(F.min(F.struct("e_value", "identity")).alias("b")).select("query", "subject", "b.*")
    place = F.row_number().over(W.partitionBy("query").orderBy("e_value", "subject"))
    return best.withColumn("place", place).where(F.col("place") <= n).withColumn("place", F.col("place").cast("long"))


def reciprocal_best(ab: DataFrame, ba: DataFrame, max_score: float | None = None) -> DataFrame:
    """(a, b) where b is a's best (lowest score) and a is b's."""
    best = lambda df: df.groupBy("query").agg(F.min(F.struct("score", "subject")).alias("m")).select("query", "m.subject", "m.score")
    left = best(ab).select(F.col("query").alias("a"), F.col("subject").alias("b"), F.col("score").alias("score_ab"))
    right = best(ba).select(F.col("query").alias("b"), F.col("subject").alias("a"), F.col("score").alias("score_ba"))
    both = left.join(right, ["a", "b"])
    return both if max_score is None else both.where((F.col("score_ab") < max_score) & (F.col("score_ba") < max_score))


def longest_per(df: DataFrame, key: str, start: str, end: str, name: str) -> DataFrame:
    """(key, name, length) of the longest row of each key; ties go to the smallest name."""
    length = F.col(end) - F.col(start)
    best = df.groupBy(key).agg(F.min(F.struct((-length).alias("l"), F.col(name).alias("n"))).alias("b"))
    return best.select(key, F.col("b.n").alias(name), (-F.col("b.l")).alias("length"))


def median_per(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The row in the middle (length // 2 of the ascending order) of each key."""
    w = W.partitionBy(key)
    at = F.row_number().over(w.orderBy(value, name)) - 1
    middle = F.floor(F.count("*").over(w) / 2)
    return df.withColumn("at", at).withColumn("middle", middle).where("at = middle").drop("at", "middle")


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """1-based position in a global order: range-sorted partitions and one offset a partition, never a single-task window.

    The sorted table is written once and both the offsets and the rows come from it: a second sort could cut its ranges elsewhere.
    """
    ordered = written(df.orderBy(*order).withColumn("at id", F.monotonically_increasing_id()))
    part, place = F.shiftright("at id", 33), F.col("at id").bitwiseAND((1 << 33) - 1)
    ordered = ordered.withColumn("at part", part).withColumn("at place", place)
    sizes = ordered.groupBy("at part").agg(F.count("*").alias("n"))
    before = sizes.select("at part", (F.sum("n").over(W.orderBy("at part")) - F.col("n")).alias("before"))  # a row a partition
    return ordered.join(F.broadcast(before), "at part").withColumn(out, (F.col("before") + F.col("at place") + 1).cast("long")).drop("at id", "at part", "at place", "before")


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, n, min_rank, max_rank, average_rank, dense_rank, percentile) of each distinct value.

    Ranks are sums over distinct values, which come sorted by range; rows themselves are never ranked.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    dense = global_rank(counts, [F.col("value")], "dense_rank")
    chunk = F.floor(F.col("dense_rank") / 4096)
    inside = dense.withColumn("chunk", chunk)
    sums = inside.groupBy("chunk").agg(F.sum("n").alias("m"))
    before = sums.select("chunk", (F.sum("m").over(W.orderBy("chunk")) - F.col("m")).alias("before"))  # a row for 4096 values
    run = F.sum("n").over(W.partitionBy("chunk").orderBy("dense_rank"))
    ranked = inside.join(before, "chunk").withColumn("max_rank", (F.col("before") + run).cast("long"))
    total = df.where(F.col(value).isNotNull()).agg(F.count("*").alias("total"))
    ranked = ranked.crossJoin(F.broadcast(total)).withColumn("min_rank", (F.col("max_rank") - F.col("n") + 1).cast("long"))
    average = (F.col("min_rank") + F.col("max_rank")).cast("double") / F.lit(2e0)
    return ranked.select("value", "n", "min_rank", "max_rank", average.alias("average_rank"), "dense_rank", (average / F.col("total")).alias("percentile"))


def consecutive_number(df: DataFrame, key: str, order: list[str], reverse_when: Column | None = None, out: str = "number") -> DataFrame:
    """1-based number inside each key in order, counted from the end where reverse_when holds.

    Numbers are places in the order of the whole table less the key's first place, so a hot key is spread over tasks.
    """
    ranked = global_rank(df, [F.col(key), *map(F.col, order)], "place in all")
    ends = ranked.groupBy(F.col(key).alias("number key")).agg(F.min("place in all").alias("first place"), F.max("place in all").alias("last place"))
    up, down = F.col("place in all") - F.col("first place") + 1, F.col("last place") - F.col("place in all") + 1
    met = ranked.join(ends, F.col(key).eqNullSafe(F.col("number key")))
    return met.withColumn(out, up if reverse_when is None else F.when(reverse_when, down).otherwise(up)).drop("place in all", "number key", "first place", "last place")


def consecutive_pairs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Each value with the next one of its key in order."""
    return df.withColumn("next_value", F.lead(value).over(W.partitionBy(key).orderBy(*order))).where("next_value is not null")


def sliding_counts(df: DataFrame, key: str, position: str, width: int) -> DataFrame:
    """For each row the rows of its key within `width` positions up to it, itself included."""
    w = W.partitionBy(key).orderBy(position).rangeBetween(-width + 1, 0)
    return df.withColumn("in_window", F.count("*").over(w))


def moving_average(df: DataFrame, key: str, order: list[str], value: str, rows: int) -> DataFrame:
    """Mean of the `rows` values before each row."""
    return df.withColumn("moving_average", F.avg(value).over(W.partitionBy(key).orderBy(*order).rowsBetween(-rows, -1)))


# -- seeded sampling -------------------------------------------------------------------------------------------------


def draw(df: DataFrame, n: int, key: str, seed: int = 1) -> DataFrame:
    """n rows at random: the lowest hashes of key and seed, so the draw does not depend on partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def split_by_hash(df: DataFrame, share: float, key: str, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts by the hash of a key."""
    low = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000)
    return df.where(low), df.where(~low)


def monte_carlo_share(df: DataFrame, value: str, key: str, n: int, replicates: int, threshold: float, seed: int = 1) -> DataFrame:
    """(replicates, reached): in how many draws of about n values the mean reaches the threshold.

    Each replicate takes each row by its hash, so replicates are aggregates in one pass and nothing is sorted.
    """
    total = df.agg(F.count("*").alias("rows"))
    many = df.select(value, key).crossJoin(F.broadcast(total)).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    chance = F.pmod(F.xxhash64(F.lit(seed), "replicate", key), F.lit(1 << 30)).cast("double") / (1 << 30)
    means = many.where(chance < F.lit(float(n)) / F.col("rows")).groupBy("replicate").agg(F.avg(value).alias("mean"))
    return means.agg(F.lit(replicates).cast("long").alias("replicates"), F.count_if(F.col("mean") >= threshold).alias("reached"))


def shuffle_array(values: str | Column, key: str | Column, seed: int = 1) -> Column:
    """An array's elements in a seeded order that its key decides."""
    k = F.col(key) if isinstance(key, str) else key
    v = F.col(values) if isinstance(values, str) else values
    tagged = F.transform(v, lambda x, i: F.struct(F.xxhash64(F.lit(seed), k, i).alias("h"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda t: t["x"])


def bootstrap_replace(df: DataFrame, pool: DataFrame, key: str, share: float, replicates: int, seed: int = 1) -> DataFrame:
    """(replicate, key): in each replicate a share of the keys goes and about as many of the pool's other keys come."""
    rep = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    chance = F.pmod(F.xxhash64(F.lit(seed), "replicate", key), F.lit(1 << 30)).cast("double") / (1 << 30)
    kept = df.select(key, rep).where(chance >= share)
    fresh = pool.select(key).distinct().join(df.select(key), key, "left_anti")
    sizes = df.agg(F.count("*").alias("n")).crossJoin(fresh.agg(F.count("*").alias("m")))
    added = fresh.crossJoin(F.broadcast(sizes)).select(key, rep, "n", "m").where(chance < F.col("n") * share / F.greatest(F.col("m"), F.lit(1)))
    return kept.select("replicate", key).unionByName(added.select("replicate", key))
