"""Operators whose plans once lost rows or depended on a table's size."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import graph, intervals, ranking, table
from tidewater.sources import sinks


@pytest.fixture(scope="module")
def wide(spark):
    return spark.range(400_000).select("id", F.xxhash64("id").alias("v"), F.repeat(F.lit("x"), 20).alias("pad"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("name"))


def default_settings(spark):
    """Shuffle partitions and coalescing as a plain session has them."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    return old


def test_global_rank_keeps_rows(spark, wide):
    old = default_settings(spark)
    try:
        ranked = ranking.global_rank(wide, [F.col("v")], "rank").select("id", "v", "rank", "pad")
        got = ranked.agg(F.count("*").alias("n"), F.count_distinct("rank").alias("d"), F.min("rank").alias("a"), F.max("rank").alias("z")).first()
        assert tuple(got) == (400_000, 400_000, 1, 400_000)
        rows = ranked.select("v", "rank").toArrow().to_pandas().sort_values("rank")
        assert rows["v"].is_monotonic_increasing
        chunks = sinks.chunks(wide, ["v"], 1000).groupBy("chunk").count()
        assert chunks.agg(F.min("count"), F.max("count"), F.count("*")).first() == (1000, 1000, 400)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_value_ranks_of_many(spark, wide):
    old = default_settings(spark)
    try:
        few = wide.select(F.pmod("v", F.lit(100_000)).alias("v"))
        got = ranking.value_ranks(few, "v")
        n = few.select("v").distinct().count()
        assert got.agg(F.count("*"), F.count_distinct("dense_rank"), F.max("dense_rank"), F.max("max_rank")).first() == (n, n, n, 400_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def brute_pairs(left, right):
    return sorted((a, b) for a in left for b in right if a[0] == b[0] and a[1] < b[2] and b[1] < a[2] and a[1] < a[2] and b[1] < b[2])


@pytest.mark.parametrize("longest", [1, 40, 70_000])
def test_overlaps_of_all_lengths(spark, longest):
    draw = random.Random(longest)
    kind = "chrom string, start long, end long, name string"

    def track(n, most):
        out = []
        for i in range(n):
            start = draw.randint(0, 3000) if most < 1000 else draw.randint(0, 200_000)
            out.append((draw.choice("ab"), start, start + draw.choice([0, 1, draw.randint(0, most)]), f"n{i % 50}"))
        return out + out[:3]

    left, right = track(150, longest), track(150, 40)
    a, b = spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)
    got = sorted((tuple(r["l"]), tuple(r["r"])) for r in intervals.overlap_join(a, b).collect())
    assert got == brute_pairs(left, right)
    hit = {x for x, _ in got}
    assert sorted(map(tuple, intervals.overlap_join(a, b, "semi").collect())) == sorted(x for x in left if x in hit)
    assert sorted(map(tuple, intervals.overlap_join(a, b, "anti").collect())) == sorted(x for x in left if x not in hit)
    inside = sorted(x for x in left if x[1] < x[2] and any(x[0] == y[0] and y[1] < y[2] and y[1] <= x[1] and x[2] <= y[2] for y in right))
    assert sorted(map(tuple, intervals.contained_in(a, b).collect())) == inside
    none = a.limit(0)
    assert intervals.overlap_join(none, b).count() == 0 and intervals.overlap_join(a, none, "anti").count() == len(left)


def test_whole_closure(spark):
    """A chain longer than any default depth."""
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)], "child long, parent long")
    assert graph.ancestors(edges).where("node = 60").count() == 60
    assert graph.ancestors(edges, 5).where("node = 60").count() == 5


def test_keep_containing(spark):
    draw = random.Random(4)
    texts = ["".join(draw.choice("abc.") for _ in range(draw.randint(0, 12))) for _ in range(300)] + [None, "a.b"]
    keys = ["abc", "a.b", "ccaab", "zz", None]
    df, k = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(x,) for x in keys], "k string")
    expected = sorted(t for t in texts if t is not None and any(x in t for x in keys if x))
    assert sorted(r[0] for r in table.keep_containing(df, "text", k, "k").collect()) == expected
    assert table.keep_containing(df, "text", k.limit(0), "k").count() == 0
    assert table.keep_containing(df, "text", spark.createDataFrame([("",)], "k string"), "k").count() == len(texts) - 1


def test_equal_features_stay(spark):
    feature = spark.createDataFrame([("c", 5, 9, "x"), ("c", 5, 9, "x")], "chrom string, start long, end long, name string")
    hits = spark.createDataFrame([("c", 0, 20, "d", 100, 1)], "chrom string, start long, end long, to_chrom string, to_start long, score int")
    assert [tuple(r) for r in intervals.lift_features(feature, hits).collect()] == [("d", 105, 109, "x")] * 2


def test_numbers_in_a_hot_key(spark):
    rows = spark.range(50_000).select(F.lit("k").alias("key"), "id")
    got = ranking.consecutive_number(rows, "key", ["id"], reverse_when=F.col("id") % 2 == 0)
    assert got.where(F.col("number") != F.when(F.col("id") % 2 == 0, 50_000 - F.col("id")).otherwise(F.col("id") + 1)).count() == 0


def test_keys_of_all_lengths(spark):
    """A key of one character beside long ones: each class meets by grams of its own."""
    dice = random.Random(12)
    texts = ["".join(dice.choices("abcdé 中", k=dice.randint(0, 60))) for _ in range(150)] + ["q" * 400]
    keys = ["".join(dice.choices("abcdé 中", k=dice.choice([4, 5, 7, 8, 9, 16]))) for _ in range(60)] + [t[3:40] for t in texts[:5] if len(t) > 45] + ["q" * 130, "z"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = sorted(r[0] for r in table.keep_containing(df, "text", spark.createDataFrame([(k,) for k in keys], "k string"), "k").collect())
    assert got == sorted(t for t in texts if any(k in t for k in keys)) and got


def test_lifted_pairs_are_dealt(spark):
    """Small partitions are not put together before their pairs are sorted, so no task holds many of them."""
    feature = spark.createDataFrame([("c", i * 100, i * 100 + 9, f"f{i}") for i in range(50)], "chrom string, start long, end long, name string")
    met = intervals.overlap_join(feature, feature, deal=True)
    assert met.count() == 50
    assert met.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
