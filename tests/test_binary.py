"""The binary matrix format: written, read back, looked up by key; attempts that fail leave nothing visible."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidewater.sources import binary

SCHEMA = "key string, values array<double>"


def write(df, path, mode="append", **options):
    df.write.format("tidewater_matrix").mode(mode).options(path=path, **options).save()


def read(spark, path):
    return sorted(((r["key"], tuple(r["values"])) for r in spark.read.format("tidewater_matrix").option("path", path).load().collect()), key=str)


@pytest.mark.parametrize("kind", binary.KINDS)
def test_round_trip(spark, tmp_path, kind):
    binary.register(spark)
    dice, path = random.Random(1), str(tmp_path / "m")
    rows = [(f"k{dice.randrange(80)}\n\"é", [float(dice.randrange(60_000)) for _ in range(7)]) for _ in range(150)] + [(None, [1.0] * 7)]
    write(spark.createDataFrame(rows, SCHEMA).repartition(4), path, kind=kind)
    expected = sorted(((k, tuple(v)) for k, v in rows), key=str)
    assert read(spark, path) == expected
    key = rows[3][0]
    assert sorted(map(tuple, binary.look_up(path, key))) == sorted(tuple(v) for k, v in rows if k == key) and binary.look_up(path, "none") == []
    sizes = sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".bin"))
    assert sizes == len(rows) * 7 * int(kind[1])
    write(spark.createDataFrame([("more", [2.0] * 7)], SCHEMA), path, kind=kind)
    assert read(spark, path) == sorted([*expected, ("more", (2.0,) * 7)], key=str)
    write(spark.createDataFrame([("new", [2.0])], SCHEMA), path, "overwrite", kind=kind)
    assert read(spark, path) == [("new", (2.0,))]


def test_failures_leave_nothing_visible(spark, tmp_path):
    binary.register(spark)
    path = str(tmp_path / "m")
    good = spark.createDataFrame([(f"k{i}", [float(i)] * 3) for i in range(20)], SCHEMA).repartition(3)
    write(good, path)
    before = read(spark, path)
    bad = good.withColumn("values", F.when(F.col("key") == "k7", F.array(F.lit(1.0))).otherwise(F.col("values")))
    for df, options in ((bad, {}), (good.withColumn("values", F.array(F.lit(-1.5))), {"kind": "u2"}), (good.withColumn("values", F.array(F.lit(1.0))), {})):
        with pytest.raises(Exception):
            write(df, path, **options)
        assert read(spark, path) == before
    with pytest.raises(Exception):
        write(good, path, kind="i9")


def test_empty(spark, tmp_path):
    binary.register(spark)
    write(spark.createDataFrame([], SCHEMA), str(tmp_path / "m"))
    assert read(spark, str(tmp_path / "m")) == [] and read(spark, str(tmp_path / "nothing")) == []


def test_scaled(spark):
    df = spark.createDataFrame([(-1.0, 5.0), (1.0, 5.0), (0.25, None), (None, 5.0)], "x double, `y.z` double")
    assert [tuple(r) for r in binary.scaled(df, ["x", "y.z"]).collect()] == [(0, 0), (65_535, 0), (40_959, None), (None, 0)]
