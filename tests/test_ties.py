"""Interval operators on features that repeat, tie and nest, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import benchmark as bm
from tidewater.operators import intervals as iv
from tidewater.operators import sequence as sq

SCHEMA = "chrom string, start long, end long, name string, strand string"


def draw(seed, n=60):
    """Features over few places and names on three chromosomes, some of them equal in all columns."""
    dice = random.Random(seed)
    rows = []
    for _ in range(n):
        start = dice.randrange(0, 90, 3)
        rows.append((dice.choice("xyz"), start, start + dice.choice([0, 1, 3, 3, 6, 12]), dice.choice("ab"), dice.choice("+-")))
    return rows + [dice.choice(rows) for _ in range(n // 2)]


def runs(rows, gap=0, touching=False):
    """Runs of a chromosome's features by the running greatest end."""
    out = []
    for r in sorted(rows):
        last = out[-1] if out and out[-1][0][0] == r[0] else None
        apart = r[1] - max(x[2] for x in last) if last else None
        if last and not (apart > gap if touching else apart >= gap):
            last.append(r)
        else:
            out.append([r])
    return out


@pytest.fixture(scope="module")
def tied(spark):
    """All seeds at once: a chromosome of its own for each."""
    rows = [(f"{seed} {r[0]}", *r[1:]) for seed in range(50) for r in draw(seed)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("chunk", [iv.CHUNK, 16])
def test_islands_and_what_stands_on_them(tied, chunk):
    rows, df = tied
    got = {(r["chrom"], r["island"]) for r in iv.islands(df, chunk=chunk).collect()}
    zero = runs(rows)
    assert got == {(g[0][0], min(r[1] for r in g)) for g in zero}
    assert iv.islands(df, chunk=chunk).count() == len(rows)
    covered = {(r[0], p) for r in rows for p in range(r[1], r[2])}
    assert iv.coverage(df, chunk).first()["bp"] == len(covered)
    # Without length a feature begins runs of its own at its place; those meet in one row.
    joined = {}
    for g in zero:
        key = (g[0][0], g[0][1])
        joined[key] = joined.get(key, []) + g
    merged = {(r["chrom"], r["start"]): (r["end"], r["name"], r["n"]) for r in iv.merge_overlaps(df, chunk=chunk).collect()}
    assert merged == {k: (max(r[2] for r in g), "/".join(r[3] for r in sorted(g)), len(g)) for k, g in joined.items()}
    bare = {(r["chrom"], r["start"]): (r["end"], r["n"]) for r in iv.merge_overlaps(df, None, chunk).collect()}
    assert bare == {k: (e, n) for k, (e, _, n) in merged.items()}
    chains = {(r["chrom"], r["start"]): (r["end"], r["score"]) for r in iv.chain_features(df, 5, chunk=chunk).collect()}
    assert chains == {(g[0][0], g[0][1]): (max(r[2] for r in g), len(g)) for g in runs(rows, 5)}
    longest = sorted((r["chrom"], r["start"], r["end"], r["name"]) for r in iv.longest_in_clump(df, chunk).collect())
    assert longest == sorted(min(g, key=lambda r: (r[1] - r[2], r[1], r[3]))[:4] for g in joined.values())


def test_callers_of_running_values(tied):
    rows, df = tied
    collapsed = sorted((r["chrom"], r["start"], r["end"], r["name"]) for r in iv.collapse_overlaps(df).collect())
    joined = {}
    for g in runs(rows):
        joined.setdefault((g[0][0], g[0][1]), []).extend(g)
    assert collapsed == sorted((c, s, max(r[2] for r in g), min(g, key=lambda r: (r[1], r[2], r[3]))[3]) for (c, s), g in joined.items())
    hits = iv.chain_hits(df, 4).groupBy("chrom", "chain").agg(F.count("*").alias("n"), F.min("start").alias("s")).collect()
    assert sorted((r["chrom"], r["s"], r["n"]) for r in hits) == sorted((g[0][0], g[0][1], len(g)) for g in runs(rows, 4, True))
    cover = sorted((r["chrom"], r["name"], r["start"], r["end"], r["n"]) for r in iv.same_name_cover(df).collect())
    expected, last = [], None
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        if last and last[:2] == [r[0], r[3]]:
            last[2:] = [last[2], max(last[3], r[2]), last[4] + 1]
        else:
            last = [r[0], r[3], r[1], r[2], 1]
            expected.append(last)
    assert cover == sorted(map(tuple, expected))


def test_neighbours(tied):
    rows, df = tied
    order = sorted(rows)
    gaps, pairs, lands = [], [], []
    for c in {r[0] for r in rows}:
        mine = [r for r in order if r[0] == c]
        for i, r in enumerate(mine):
            # The row before is the one with the greatest (start, end), the one behind that with the least start.
            before = max(((x[1], x[2]) for x in mine[:i]), default=None)
            start, end = (r[2], min((x[1] for x in mine[i + 1 :]), default=None)) if r[4] == "-" else (before and before[1], r[1])
            if start is not None and end is not None and start < end:
                gaps.append((c, start, end, r[3], r[4]))
            nxt = mine[i + 1] if i + 1 < len(mine) else None
            if nxt and r[4] == "-" and nxt[4] == "+" and 0 < nxt[1] - r[2] < 9 and r[3] != nxt[3]:
                pairs.append((c, r[3], nxt[3], nxt[1] - r[2]))
        mids = sorted(((r[1] + r[2]) // 2, r[3]) for r in mine)
        for i, (m, n) in enumerate(mids):
            left = (mids[i - 1][0] + m) // 2 if i else m - 10
            right = (m + mids[i + 1][0]) // 2 if i + 1 < len(mids) else m + 10
            lands.append((c, max(left, m - 10, 0), min(right, m + 10), n))
    assert sorted(map(tuple, iv.upstream_gaps(df).collect())) == sorted(gaps) and gaps
    assert sorted(map(tuple, iv.bidirectional_pairs(df, 9).collect())) == sorted(pairs) and pairs
    assert sorted(map(tuple, iv.territories(df, 10).collect())) == sorted(lands)


@pytest.mark.parametrize("width,names", [(0, False), (0, True), (1, False), (7, False), (7, True), (1000, False), (1000, True)])
def test_position_counts(tied, width, names):
    rows, df = tied
    got, spans = {}, 0
    for r in iv.position_counts(df, width, names).collect():
        spans += 1
        for p in range(r["start"], r["end"]):
            assert (r["chrom"], p) not in got
            got[r["chrom"], p] = r["n"]
    expected = {}
    for c, s, e, n, _ in rows:
        for p in range(max(0, s - width + 1), s + 1) if width else range(s, e):
            expected.setdefault((c, p), []).append(n)
    assert got == {k: len(set(v) if names else v) for k, v in expected.items()}
    assert spans <= 2 * len(rows)


def test_runs_above_with_repeated_positions(spark):
    dice = random.Random(4)
    rows = [(c, dice.randrange(40), dice.choice([1.0, 2.0])) for c in "abcdefgh" for _ in range(60)]
    got = sorted(map(tuple, iv.runs_above(spark.createDataFrame(rows, "chrom string, pos long, v double"), "v", 2, 2).select("chrom", "start", "end").collect()))
    expected = []
    for c in "abcdefgh":
        places = sorted({p for x, p, v in rows if x == c and v == 2})
        for p in places:
            if expected and expected[-1][0] == c and expected[-1][2] == p:
                expected[-1][2] = p + 1
            else:
                expected.append([c, p, p + 1])
    assert got == sorted(map(tuple, expected))


@pytest.mark.parametrize("insert", [True, False])
def test_shifts_of_repeated_features(spark, tied, insert):
    rows, df = tied
    dice = random.Random(8)
    gaps = [(c, dice.randrange(60), dice.randrange(4)) for c in {r[0] for r in rows} for _ in range(6)]
    got = sorted(map(tuple, sq.shift_by_gaps(df, spark.createDataFrame(gaps, "chrom string, pos long, len int"), insert).collect()))
    moved = lambda c, p: p + (1 if insert else -1) * sum(g[2] for g in gaps if g[0] == c and g[1] <= p)
    assert got == sorted((c, moved(c, s), moved(c, e), n) for c, s, e, n, _ in rows)


def test_two_tracks(spark, tied):
    rows, df = tied
    other = [(f"{seed} {r[0]}", *r[1:]) for seed in range(40, 60) for r in draw(seed + 500, 20)]
    ref = spark.createDataFrame(other, SCHEMA)
    under = lambda track: {(r[0], p) for r in track for p in range(r[1], r[2])}
    p, r = under(rows), under(other)
    for chunk in (iv.CHUNK, 16):
        assert tuple(iv.joint_coverage(df, ref, chunk).first()) == (len(p), len(r), len(p & r))
    got = bm.track_benchmark(df, ref, 10**6).first()
    hit = lambda track, places: sum(any((x[0], q) in places for q in range(x[1], x[2])) for x in track)
    assert (got["tp"], got["fp"], got["fn"], got["ref_hit"], got["pred_hit"]) == (len(p & r), len(p - r), len(r - p), hit(other, p), hit(rows, r))
    assert tuple(iv.joint_coverage(df.limit(0), ref.limit(0)).first()) == (0, 0, 0)
