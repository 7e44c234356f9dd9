"""Tails by incomplete functions against sums of their terms, missing arguments, and significance of overlaps by shuffled tracks."""

import random
from fractions import Fraction
from math import comb, exp, factorial

from pyspark.sql import functions as F

from tidewater.functions import statistics as st
from tidewater.operators import intervals as iv


def exact(rows):
    return [sum(Fraction(comb(n, i)) * p**i * (1 - p) ** (n - i) for i in range(max(k, 0), n + 1)) for k, n, p in rows]


def test_binomial_and_poisson(spark):
    dice = random.Random(1)
    rows = [(dice.randint(-2, n + 2), n, Fraction(dice.randint(0, 64), 64)) for n in [dice.randint(0, 90) for _ in range(300)]]
    table = spark.createDataFrame([(i, k, n, float(p)) for i, (k, n, p) in enumerate(rows)], "i long, k long, n long, p double")
    got = [r[1] for r in table.select("i", st.pbinom("k", "n", "p")).orderBy("i").collect()]
    assert all(abs(a - float(b)) <= 1e-12 + 1e-10 * float(b) for a, b in zip(got, exact(rows), strict=True))
    rates = [(dice.randint(-1, 40), dice.choice([0.0, 0.01, 1.0, 7.5, 30.0])) for _ in range(200)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rates)], "i long, k long, rate double")
    got = [r[1] for r in table.select("i", st.ppois("k", "rate")).orderBy("i").collect()]
    for a, (k, rate) in zip(got, rates, strict=True):
        b = 1 - sum(exp(-rate) * rate**i / factorial(i) for i in range(max(k, 0)))
        assert abs(a - b) < 1e-12


def test_large_counts(spark):
    """Half of a fair draw's tail, at sizes whose terms nobody would sum."""
    row = spark.createDataFrame([(5 * 10**8, 10**9, 0.5, 1e9)], "k long, n long, p double, rate double")
    a, b = row.select(st.pbinom("k", "n", "p"), st.ppois(F.lit(10**9), "rate")).first()
    assert abs(a - 0.5) < 1e-4 and abs(b - 0.5) < 1e-4


def test_hypergeometric_and_fisher(spark):
    dice = random.Random(2)
    tables = [[dice.randint(0, 12) for _ in range(4)] for _ in range(150)] + [[0, 0, 0, 0], [5, 0, 0, 0]]
    df = spark.createDataFrame([(i, *t, t[0] + t[2], t[0] + t[1], sum(t)) for i, t in enumerate(tables)], "i long, a long, b long, c long, d long, m long, r long, n long")
    for _, own, p, *t in df.select("i", st.phyper("a", "n", "m", "r"), st.fisher_p("a", "b", "c", "d"), "a", "b", "c", "d").collect():
        n, m, r = sum(t), t[0] + t[2], t[0] + t[1]
        chance = {x: Fraction(comb(m, x) * comb(n - m, r - x), comb(n, r)) for x in range(max(0, r + m - n), min(m, r) + 1)}
        assert abs(own - float(sum(c for x, c in chance.items() if x >= t[0]))) < 1e-10
        assert abs(p - float(sum(c for c in chance.values() if c <= chance[t[0]]))) < 1e-10


def test_missing_arguments(spark):
    df = spark.createDataFrame([(1, 3, 0.5), (None, 3, 0.5), (1, None, 0.5), (1, 3, None), (1, 3, float("nan"))], "k long, n long, p double")
    for column in (st.pbinom("k", "n", "p"), st.ppois("k", F.col("p") + F.col("n")), st.phyper("k", "n", "n", F.col("p") * 2), st.fisher_p("k", "n", "k", F.col("p") * 2), st.correlation_p("p", "n")):
        got = [r[0] for r in df.select(column).collect()]
        assert got[0] is not None and got[3] is None and got[4] is None
        assert sum(x is None for x in got) >= 3


def track(dice, n):
    rows = [(dice.choice("xy"), s := dice.randrange(400), s + dice.choice([0, 1, 4, 9]), dice.choice("ab")) for _ in range(n)]
    return rows + rows[: n // 5]


def test_significance(spark):
    """Every round's track is a rearrangement, and counts are those of the tracks themselves."""
    dice = random.Random(3)
    schema = "chrom string, start long, end long, name string"
    own, ref = track(dice, 40), track(dice, 25)
    a, b = spark.createDataFrame(own, schema), spark.createDataFrame(ref, schema).repartition(3)
    tracks = iv.shuffled_tracks(a, 60, 7).collect()
    places = {c: {p for x, s, e, _ in ref if x == c for p in range(s, e)} for c in "xy"}

    def overlaps(rows):
        shared = [sum(p in places[c] for p in range(s, e)) for c, s, e in rows]
        return sum(n > 0 for n in shared), sum(shared)

    rounds = {}
    for r in tracks:
        rounds.setdefault(r["round"], []).append((r["chrom"], r["start"], r["end"]))
    assert len(rounds) == 60
    for rows in rounds.values():
        assert sorted((c, e - s) for c, s, e in rows) == sorted((c, e - s) for c, s, e, _ in own)
    assert len({tuple(sorted(rows)) for rows in rounds.values()}) > 50
    hits, bp = overlaps([r[:3] for r in own])
    each = [overlaps(rows) for rows in rounds.values()]
    got = iv.overlap_significance(a, b, 60, 7).first()
    assert tuple(got)[:5] == (hits, bp, 60, sum(h >= hits for h, _ in each), sum(n >= bp for _, n in each))
    assert got["p"] == (got["as_many"] + 1) / 61 and got["p_bp"] == (got["as_much"] + 1) / 61
    size = sum(max(e for x, _, e, _ in own + ref if x == c) for c in "xy")
    length, share = sum(e - s for _, s, e, _ in own), Fraction(sum(map(len, places.values())), size)
    assert abs(got["binomial_p"] - float(exact([(bp + 1, length, share)])[0])) < 1e-9
    rate = float(length * share)
    assert abs(got["poisson_p"] - (1 - sum(exp(-rate) * rate**i / factorial(i) for i in range(bp + 1)))) < 1e-9


def test_independent_shuffle(spark):
    own = track(random.Random(5), 60)
    df = spark.createDataFrame(own, "chrom string, start long, end long, name string")
    got = [tuple(r) for r in iv.independent_shuffle(df, 3).collect()]
    for part in (lambda r: r[0], lambda r: r[1], lambda r: r[2] - r[1], lambda r: r[3]):
        assert sorted(map(part, got)) == sorted(map(part, own))
    assert sorted(got) != sorted(own)
    assert sorted(got) == sorted(tuple(r) for r in iv.independent_shuffle(df.repartition(5), 3).collect())


def test_covered_blocks(spark):
    dice = random.Random(6)
    rows = [(dice.choice([1, 2, None]), dice.choice("gh"), dice.choice("xy"), s := dice.randrange(60), s + dice.choice([0, 1, 2, 5]), f"s{dice.randrange(3)}") for _ in range(120)]
    df = spark.createDataFrame(rows + rows[:20], "doc long, `g.x` string, chrom string, start long, end long, seq string")
    for chunk in (iv.CHUNK, 8):
        got = {tuple(r)[:3]: tuple(r)[3:] for r in iv.covered_blocks(df, ["doc", "g.x"], "seq", chunk).collect()}
        expected = {}
        for key in {r[:3] for r in rows if r[0] is not None}:
            mine = [r for r in rows if r[:3] == key and r[3] < r[4]]
            covered = {p for r in mine for p in range(r[3], r[4])}
            starts = sorted(p for p in covered if p - 1 not in covered)
            ends = sorted(p + 1 for p in covered if p + 1 not in covered)
            if covered:
                expected[key] = (starts[0], ends[-1], len(starts), [e - s for s, e in zip(starts, ends)], [s - starts[0] for s in starts], sorted({r[5] for r in mine}))
        assert {k: v for k, v in got.items() if k[0] is not None} == expected


def test_packed_rows(spark):
    dice = random.Random(7)
    rows = [(dice.choice("xyz"), s := dice.randrange(200), s + dice.choice([0, 1, 5, 30]), dice.choice("abc")) for _ in range(150)]
    got = sorted(tuple(r) for r in iv.packed_rows(spark.createDataFrame(rows + rows[:20], "chrom string, start long, end long, name string"), chunk=32).collect())
    expected = []
    for c in "xyz":
        ends = []
        for r in sorted(x for x in rows + rows[:20] if x[0] == c):
            at = next((i for i, e in enumerate(ends) if e <= r[1]), len(ends))
            ends[at : at + 1] = [r[2]]
            expected.append((*r, at))
    assert got == sorted(expected)


def test_shuffled_overlaps_by_bucket(spark):
    """Packed rounds in buckets of any size agree with the tracks themselves; features turned round, without length or place count as there."""
    dice = random.Random(12)
    schema = "chrom string, start long, end long, name string"
    own = track(dice, 50) + [("x", 20, 11, "r"), ("x", None, 4, "n"), ("y", 5, None, "n"), ("y", 7, 30, None), (None, 1, 9, "c"), ("w", 2, 8, "w")]
    ref = track(dice, 30)
    a, joined = spark.createDataFrame(own, schema), iv._joined(spark.createDataFrame(ref, schema))
    places = {c: {p for x, s, e, _ in ref if x == c for p in range(s, e)} for c in "xyw"}
    expected = {}
    for r in iv.shuffled_tracks(a, 9, 5).where("start < end").collect():
        shared = sum(p in places[r["chrom"]] for p in range(r["start"], r["end"]))
        hits, bp = expected.get(r["round"], (0, 0))
        expected[r["round"]] = hits + (shared > 0), bp + shared
    for most in (5, 1 << 17):
        got = iv._shuffled_overlaps(a, joined, 9, 5, most).groupBy("round").sum("hits", "bp").collect()
        assert {r[0]: (r[1], r[2]) for r in got} == expected
