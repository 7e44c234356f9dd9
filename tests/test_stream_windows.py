"""Windows of motifs over a stream, batch by batch, against the same windows over the whole table."""

import random
import time

import pytest

from tidewater.operators import motifs as mo
from tidewater.streaming import stateless

SCHEMA = "chrom string, start long, end long, name string"


@pytest.mark.parametrize("slack", [0, 25])
def test_stream_and_batch_agree(spark, tmp_path, slack):
    dice = random.Random(slack)
    rows = sorted((dice.choice("xy"), s := dice.randrange(600), s + dice.randint(1, 30), dice.choice("abc")) for _ in range(250))
    rows += rows[:20]
    needed = {"a": 2, "b": 1}
    expected = sorted((r["chrom"], r["start"], r["end"], r["n"], tuple(m["name"] for m in r["members"])) for r in mo.motif_windows(spark.createDataFrame(rows, SCHEMA), needed, 20).collect())
    # Hits come by position, shaken within the slack, one file after the other.
    rows.sort(key=lambda r: r[1] + (dice.random() * slack))
    cuts = [0, *sorted(dice.sample(range(len(rows)), 4)), len(rows)]
    batches = [rows[a:b] for a, b in zip(cuts, cuts[1:])] + [[(c, 10**6, 10**6, None) for c in "xy"]]
    found = []
    (tmp_path / "in").mkdir()
    stream = stateless.window_clusters(stateless.read_folder(spark, str(tmp_path / "in"), SCHEMA, "json"), needed, 20, slack)
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(0.01)
        query = stateless.write_batches(stream, lambda df, _: found.extend(tuple(r) for r in df.collect()), str(tmp_path / "state"))
        query.awaitTermination()
        if k == 3:
            assert found  # windows are told before the end
    assert sorted((c, s, e, n, tuple(names)) for c, s, e, n, names in found) == expected and expected


def test_late_hits_are_in_no_window(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = stateless.window_clusters(stateless.read_folder(spark, str(tmp_path / "in"), SCHEMA, "json"), {"a": 1}, 10)
    found = []
    for batch in ([("x", 5, 6, "a"), ("x", 50, 51, "a")], [("x", 7, 8, "a"), ("x", 52, 53, "a")], [("x", 99, 99, None)]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stateless.write_batches(stream, lambda df, _: found.extend(tuple(r) for r in df.collect()), str(tmp_path / "state")).awaitTermination()
    assert sorted(r[:4] for r in found) == [("x", 5, 6, 1), ("x", 50, 53, 2), ("x", 52, 53, 1)]
