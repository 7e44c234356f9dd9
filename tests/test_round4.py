"""Jobs that one task could not take: windows of one chromosome over a stream, pairs of blocks of rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidewater.operators import aggregate as ag
from tidewater.operators import motifs as mo
from tidewater.streaming import stateless

HITS = "chrom string, start long, end long, name string"


@pytest.mark.parametrize("stretch", [20, 64, 1 << 16])
def test_windows_of_a_chromosome_are_work_for_many_tasks(spark, tmp_path, monkeypatch, stretch):
    """Windows that go over the end of a stretch are whole, whichever bucket has it, and are told once, though its last hits came long before."""
    monkeypatch.setattr(stateless, "STRETCH", stretch, raising=False)
    monkeypatch.setattr(stateless, "PACKED_AT_ONCE", 30, raising=False)
    dice = random.Random(stretch)
    rows = [(dice.choice("xxy"), s := dice.randrange(900), s + dice.randint(1, 30), dice.choice(["a", "b", "c", None])) for _ in range(400)]
    rows += rows[:20]
    needed = {"b": 1, "a": 2}
    whole = mo.motif_windows(spark.createDataFrame(rows, HITS), needed, 20).collect()
    expected = sorted((r["chrom"], r["start"], r["end"], r["n"], tuple(m["name"] for m in r["members"])) for r in whole)
    rows.sort(key=lambda r: r[1])
    batches = [rows[:150], rows[150:390], rows[390:], [(c, 10**7, 10**7, None) for c in "xy"]]
    (tmp_path / "in").mkdir()
    stream = stateless.window_clusters(stateless.read_folder(spark, str(tmp_path / "in"), HITS, "json"), needed, 20)
    found, tasks = [], set()

    def take(df, _):
        for *r, task in df.withColumn("task", F.spark_partition_id()).collect():
            found.append((*r[:4], tuple(r[4])))
            tasks.add((r[0], task))

    for batch in batches:
        spark.createDataFrame(batch, HITS).repartition(2).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(0.01)
        stateless.write_batches(stream, take, str(tmp_path / "state")).awaitTermination()
    assert sorted(found) == expected and expected
    if stretch < 900:
        assert len({task for chrom, task in tasks if chrom == "x"}) > 1


def exchanged_bytes(df) -> int:
    """What the exchanges of a plan that has run were given."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if kind == "ShuffleExchangeExec":
            total += node.metrics().get("dataSize").get().value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_correlated_blocks_are_exchanged_packed(spark):
    """A block travels as often as there are blocks: its cells as rows took 40 bytes a cell each time."""
    rows, columns = 2000, 7
    cells = spark.range(rows * columns).select((F.col("id") % rows).alias("r"), (F.col("id") % columns).cast("int").alias("c"), (F.xxhash64("id") % 500).cast("double").alias("v"))
    out = ag.correlation_pairs(cells, "r", "c", "v")
    assert len(out.agg(F.count("*").alias("n"), F.sum("n").alias("cells")).collect()) == 1
    assert len(out.collect()) == rows * (rows - 1) // 2
    assert exchanged_bytes(out) < 16 * rows * columns * 8


@pytest.mark.parametrize("key", ["bigint", "string"])
def test_rows_of_like_columns_are_correlated_as_rows_of_any(spark, key):
    """Two sets of columns that share two; a row with one column of its own, and one that shares none."""
    dice = random.Random(9)
    cells = [(i, c, dice.random() * 9) for i in range(400) for c in (range(4) if i % 3 else range(2, 7))]
    df = spark.createDataFrame(cells + [(7000, 3, 1.0), (7001, 99, 1.0)], "r long, c int, v double").withColumn("r", F.col("r").cast(key))
    side = lambda k, v: df.select(F.col("r").alias(k), "c", F.col("v").alias(v))
    told = side("a", "x").join(side("b", "y"), "c").where("a < b").groupBy("a", "b").agg(F.when(F.count("*") > 1, F.corr("x", "y")).alias("r"), F.count("*").alias("n")).collect()
    got = {(r.a, r.b): (r.r, r.n) for r in ag.correlation_pairs(df, "r", "c", "v").collect()}
    assert len(got) == len(told) == 400 * 399 // 2 + 400
    for r in told:
        assert got[r.a, r.b][1] == r.n and (got[r.a, r.b][0] is None) == (r.r is None) and (r.r is None or abs(got[r.a, r.b][0] - r.r) < 1e-9)


def test_corr_pairs_are_rounded_as_round_has_it(spark, tmp_path, monkeypatch):
    from tidewater.plans import catalogue

    values = [0.0078125, -0.0078125, -1e-9, 0.0, 1.0, -1.0, 0.1234564, -0.9999996, None, float("nan")]
    monkeypatch.setattr(catalogue.ag, "correlation_pairs", lambda *a: spark.createDataFrame([(i, i + 1, v, 7) for i, v in enumerate(values)], "a long, b long, r double, n long"))
    spark.createDataFrame([(1, 1, 2.0)], "l_suppkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = [str(r.r) for r in catalogue.QUERIES["corr_pairs"](spark, str(tmp_path)).orderBy("a").collect()]
    assert got == ["0.007813", "-0.007813", "0.0", "0.0", "1.0", "-1.0", "0.123456", "-1.0", "None", "nan"]
