"""Golden records against a plain fold over each cluster, with every step forced to small sizes."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewater.llm import golden

TYPES = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, n long, ts string, trust int, record string"
LEVEL = {"partner": 4, "store": 3, "web": 2, "crm": 1}


def records(seed: int, rows: int, clusters: int, hot: float = 0.4):
    dice = random.Random(seed)
    base = datetime(2024, 1, 1)
    some = lambda values, none=0.2: None if dice.random() < none else dice.choice(values)
    out = []
    for i in range(rows):
        master = 7 if dice.random() < hot else some(range(clusters), 0.1)
        when = None if dice.random() < 0.05 else base + timedelta(seconds=dice.choice([0, 1, 2, 3]) * 86_400 * 20, microseconds=dice.choice([0, 1, 5, dice.randrange(10**12)]))
        out.append((
            None if dice.random() < 0.03 else 1000 + i % (rows - 5), master, some(["partner", "store", "web", "crm", "else"]), when, some(["", " ", "\t\n", "Ann", "Anna", "Änna", "Bo", "x" * 300]), some(["a@x", "b@y", " ", "c@z"]),
            some(["A", "B", "", " C"]), some([1, 2, 3]), some(["retail", "public", "", "web", f"s{i % 50}"]), some([1.005, 2.675, -0.115, float("nan"), float("inf"), 0.0, float(i)]), 1, "clash", 5, "clash",
        ))
    return out


def folded(rows):
    """Plain Python: one cluster after the other."""
    groups = {}
    for r in rows:
        text = lambda x: x if x is not None and x.strip(" \t\n\v\f\r") else None
        groups.setdefault(r[1] if r[1] is not None else r[0], []).append(dict(id=r[0], trust=LEVEL.get(r[2], 0), at=r[3], name=text(r[4]), email=text(r[5]), city=text(r[6]), nation=r[7], segment=text(r[8]), balance=r[9] if r[9] is not None and abs(r[9]) < float("inf") else None))
    last = lambda x: (x is None, x)
    out = {}
    for key, g in groups.items():
        known = [x["at"] for x in g if x["at"]]
        for x in g:
            x["stale"] = not x["at"] or max(known) - x["at"] > timedelta(hours=720)
            x["filled"] = (x["city"] is not None) + (x["nation"] is not None)
        recent = lambda x: (x["at"] is None, -(x["at"] - datetime(2000, 1, 1)) // timedelta(microseconds=1) if x["at"] else 0, -x["trust"], *(last(x["id"]) if x["id"] is not None else (True, 0)))
        trusted = lambda x: (x["stale"], -x["trust"], *recent(x))
        pick = lambda rows, order: min(rows, key=order, default=None)
        name = pick([x for x in g if x["name"]], lambda x: (-len(x["name"]), *trusted(x), x["name"]))
        email = pick([x for x in g if x["email"]], lambda x: (*trusted(x), x["email"]))
        segment = pick([x for x in g if x["segment"]], lambda x: (*recent(x), x["segment"]))
        chosen = segment and segment["segment"]
        balance = pick([x for x in g if x["balance"] is not None], lambda x: (x["segment"] != chosen, *recent(x), x["balance"]))
        address = pick([x for x in g if x["filled"]], lambda x: (-x["filled"], *trusted(x), x["city"] is None, x["city"] or "", x["nation"] is None, x["nation"] or 0))
        of = lambda x, f: x and x[f]
        cents = None if balance is None else int((100 * balance["balance"] + 0.5) // 1)
        out[key] = (key, len(g), sum(x["stale"] for x in g), of(name, "name"), of(email, "email"), chosen, of(address, "city"), of(address, "nation"), cents, of(name, "id"), of(email, "id"), of(segment, "id"), of(balance, "id"), of(address, "id"))
    return out


def check(spark, rows, partitions, limits=golden.Limits()):
    frame = spark.createDataFrame(rows, TYPES).repartition(partitions)
    got = golden.golden_records(frame, limits=limits).collect()
    assert {r[0]: tuple(r) for r in got} == folded(rows)
    assert len(got) == len({r[0] for r in got})


@pytest.mark.parametrize("seed", range(2))
def test_against_a_fold(spark, seed):
    check(spark, records(seed, 400, 60), 3)


@pytest.mark.parametrize("limits", [golden.Limits(3), golden.Limits(2, 10, 20), golden.Limits(1, 7, 0), golden.Limits(64, 5)])
def test_small_steps(spark, limits):
    """Hot clusters, pruning in the middle of a partition, candidates handed on, open clusters carried along."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "6")
    try:
        check(spark, records(11 + limits.dense, 300, 20), 4, limits)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edges(spark):
    blank = [(None, None, None, None, None, None, None, None, None, None, 1, "", 1, "")]
    check(spark, blank, 1)
    check(spark, blank * 3 + [(5, None, "web", datetime(2024, 1, 1), " untrimmed ", None, None, None, None, -0.5, 1, "", 1, "")] * 2, 2)
    exact = datetime(2024, 3, 1)
    check(spark, [(i, 1, "web", exact - timedelta(days=30, microseconds=i), f"n{i}", "e", None, i, "s", 1.0, 1, "", 1, "") for i in range(2)] + [(9, 1, "crm", exact, None, None, None, None, None, None, 1, "", 1, "")], 2)
    empty = golden.golden_records(spark.createDataFrame([], TYPES))
    assert empty.count() == 0 and dict(empty.dtypes)["nation_id"] == "int"


def test_a_zoned_timestamp_and_other_names(spark):
    frame = spark.createDataFrame(records(3, 60, 9), TYPES).withColumn("updated_at", F.col("updated_at").cast("timestamp")).withColumnRenamed("client_id", "client.id")
    got = golden.golden_records(frame, golden.Names(client="client.id"))
    assert {r[0]: tuple(r) for r in got.collect()} == folded(records(3, 60, 9))
