"""What the third round's findings on larger tables were about: exchanges, memory and seconds that outgrow the input."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidewater.operators import aggregate as ag
from tidewater.operators import motifs as mo
from tidewater.operators import sequence as sq
from tidewater.streaming import stateless


def plan_of(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_correlated_rows_meet_in_blocks_not_as_joined_cells(spark, monkeypatch):
    """every pair was exchanged once a column; a row without variance ended in an error."""
    monkeypatch.setattr(ag, "BLOCK_ROWS", 30)
    monkeypatch.setattr(ag, "PAIRS_AT_ONCE", 100)
    draw = random.Random(3)
    cells = [(f"{draw.choice('aé𝔸z')}{draw.randrange(30)}", draw.randrange(5), draw.choice([None, 0.1, draw.randrange(99) / 7])) for _ in range(400)]
    cells += [(None, 1, 2.0), ("z", None, 1.0), *(("flat", i, 0.1) for i in range(5))]
    df = spark.createDataFrame(cells, "r string, c int, v double")
    out = ag.correlation_pairs(df, "r", "c", "v")
    assert "Join" not in plan_of(out)
    side = lambda k, v: df.select(F.col("r").alias(k), "c", F.col("v").alias(v))
    pairs = side("a", "x").join(side("b", "y"), "c").where("a < b").groupBy("a", "b")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    flat = (F.count_if(both) < 2) | (F.min(F.when(both, F.col("x"))) == F.max(F.when(both, F.col("x")))) | (F.min(F.when(both, F.col("y"))) == F.max(F.when(both, F.col("y"))))
    told = pairs.agg(F.count("*").alias("n"), flat.alias("flat"), F.collect_list(F.when(both, F.struct("x", "y"))).alias("xy")).collect()
    got = {(r.a, r.b): (r.r, r.n) for r in out.collect()}
    assert len(got) == len(told)
    for row in told:
        r, n = got[row.a, row.b]
        assert n == row.n and (r is None) == row.flat
        if r is not None:
            k = len(row.xy)
            mx, my = sum(p.x for p in row.xy) / k, sum(p.y for p in row.xy) / k
            sxy, sxx, syy = (sum((p[i] - m) * (p[j] - o) for p in row.xy) for i, m, j, o in ((0, mx, 1, my), (0, mx, 0, mx), (1, my, 1, my)))
            assert abs(r - sxy / (sxx * syy) ** 0.5) < 1e-9


#: Blocks with short and empty rows, small letters, other letters, repeated and missing organisms.
ALIGNED = [(1, "o1", "AC-GTACGTA"), (1, "o2", "ACCG-ACGTAC"), (1, "o2", "A--gt"), (2, "o1", "ACGT"), (2, None, "A-GT"), (2, "o3", None), (3, "o2", ""), (None, "o1", "AC-T"), (4, "o1", "----"), (4, "o4", "éCGTN")]


def test_conserved_hits_are_scored_many_blocks_at_a_time(spark):
    """every row of every block was scored by calls of its own."""
    df = spark.createDataFrame([(b * 10 + i, o, s) for i in range(5) for b, o, s in ALIGNED if b] + [(None, o, s) for b, o, s in ALIGNED if not b], "block long, org string, seq string")
    matrix = [[9, 0, 0, 0], [0, 9, 0, 0], [0, 0, 9, 0]]
    got = mo.conserved_hits(df.coalesce(1), "o1", {"m": matrix}, 0.9, 0.9, 1).collect()
    hits = Counter((r.block, r.strand, r.start, r.end, r.n_rows, tuple(r.core_at)) for r in got)
    # By hand: ACG of block 1's reference at 0 (its gap left out) and 4, o2's own behind its gap, which the window at 3 meets too; ACG of block 2's; CGT turned round is ACG.
    assert {h: n for h, n in hits.items() if h[0] == 10} == {(10, "+", 0, 3, 1, (0, 1, 2)): 1, (10, "+", 3, 6, 1, (3, 4, 5)): 1, (10, "+", 4, 7, 2, (4, 5, 6)): 1, (10, "-", 1, 4, 1, (1, 2, 3)): 1, (10, "-", 5, 8, 2, (5, 6, 7)): 1}
    assert {h: n for h, n in hits.items() if h[0] == 20} == {(20, "+", 0, 3, 1, (0, 1, 2)): 1, (20, "-", 1, 4, 1, (1, 2, 3)): 1}
    assert not [h for h in hits if h[0] in (None, 30, 40)]
    texts = ["ACG", "ACG"] * 1000
    n, start, score, count = mo.CoreMatrix(matrix).shared_hits("".join(texts), np.full(2000, 3), np.full(1000, 2), "+", 0.9, 0.9, 2)
    assert (n == np.arange(1000)).all() and not start.any() and (count == 2).all() and (score > 0.99).all()


def test_ungapped_blocks_meet_once(spark):
    """F16: columns were worked out again for every column, and stretches were joined to the rows."""
    df = spark.createDataFrame(ALIGNED, "block long, org string, seq string")
    out = mo.ungapped_blocks(df, 2)
    assert "Join" not in plan_of(out)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(2, 0, 2, "o1", 2, "GT"), (2, 0, 2, None, 1, "GT")], key=str)


def test_shuffled_columns_exchange_rows_not_cells(spark):
    """every cell was exchanged, ranked and joined three times."""
    df = spark.createDataFrame(ALIGNED, "block long, org string, seq string")
    out = sq.shuffled_columns(df)
    assert "Join" not in plan_of(out) and "Window" not in plan_of(out)
    got = {(r.block, r.org): r.seq for r in out.collect()}
    want = {}
    for b, o, s in ALIGNED:
        if b and s:
            want[b, o] = want.get((b, o), "") + s
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert got[2, None][1] == "-" or "C" == got[2, "o1"][got[2, None].index("-")]


def test_windows_of_a_stream_are_handed_on_some_at_a_time():
    """a chromosome's rows were one list of Python objects, its windows one frame."""
    draw = random.Random(7)
    rows = sorted((draw.randrange(400), draw.randrange(500, 600), draw.randrange(2)) for _ in range(900))
    start, end, code = (np.array(c) for c in zip(*rows))
    stop = int(np.searchsorted(start, 350, "right"))
    frames = list(stateless.told_windows(start, end, code, ["b", "a"], {"b": 3, "a": 9}, 8, stop, at_once=50))
    got = [tuple(r) for f in frames for r in f.itertuples(index=False)]
    want = []
    for b in sorted({r[0] for r in rows[:stop]}):
        inside = [r for r in rows if b <= r[0] < b + 8]
        names = [["b", "a"][r[2]] for r in inside]
        if names.count("b") >= 3 and names.count("a") >= 9:
            want.append((b, max(r[1] for r in inside), len(inside), names))
    assert got == want and 50 < len(want) < 340 and max(map(len, frames)) <= 50
