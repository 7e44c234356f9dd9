"""Transcript comparison against plain Python."""

import random
from collections import Counter

from tidewater.operators import transcripts as tr

SCHEMA = "name string, chrom string, strand string, tx_start long, tx_end long, cds_start long, cds_end long, exon_starts array<long>, exon_ends array<long>"


def draw(dice, n, names):
    rows = []
    for _ in range(n):
        at, starts, ends = dice.choice([0, 1, 5, 100, 103]), [], []
        for _ in range(dice.randint(1, 3)):
            starts.append(at)
            ends.append(at := at + dice.choice([4, 4, 4, 6]))
            at += 10
        rows.append((dice.choice(names), dice.choice(["chr1", "chr1", "chr2", None]), dice.choice("++-"), starts[0], ends[-1], starts[0] + dice.choice([0, 2]), ends[-1], starts, ends))
    return rows


def test_classes_by_name(spark):
    dice = random.Random(1)
    names = [f"t{i}" for i in range(160)]
    a, b = draw(dice, 150, names), draw(dice, 150, names)
    b += [r for r in dice.sample(a, 30) if Counter(x[0] for x in b)[r[0]] == 0]
    one = lambda rows: {r[0]: r[1:] for r in rows if Counter(x[0] for x in rows)[r[0]] == 1}
    x, y = one(a), one(b)
    expected = {}
    for k in x.keys() & y.keys():
        p, q = x[k], y[k]
        strand = p[0] == q[0] and p[0] is not None and p[1] == q[1]
        s, e = abs(p[2] - q[2]), abs(p[3] - q[3])
        intron = lambda t: list(zip(t[7][:-1], t[6][1:]))
        expected[k] = (p == q and p[0] is not None, strand and s == e == 0, strand and intron(p) == intron(q), strand and p[4:6] == q[4:6], strand and s < 4 and e < 4, strand and 0 < s < 4 and e == 0, strand and s == 0 and 0 < e < 4, p[0] == q[0] and p[0] is not None and p[2] < q[3] and q[2] < p[3])
    classes = tr.same_name_classes(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), 4)
    assert {r[0]: tuple(r)[1:] for r in classes.collect()} == expected and len(expected) > 25
    totals = tr.class_totals(classes).first().asDict()
    rest = [v for v in expected.values() if not v[0] and not v[1]]
    assert totals["n_common"] == len(expected) and totals["n_exact"] == sum(v[0] for v in expected.values()) and totals["n_apart"] == sum(not v[7] for v in rest)
    assert totals["n_close"] == sum(v[4] for v in rest)
    versioned = [(f"{n}.{k}", *r) for k, (n, *r) in enumerate(a)]
    got = tr.same_name_classes(spark.createDataFrame(versioned, SCHEMA), spark.createDataFrame(b, SCHEMA), 4, versions=False)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == expected


def test_matches_by_structure(spark):
    dice = random.Random(2)
    a, b = draw(dice, 120, [f"a{i}" for i in range(500)]), draw(dice, 60, [f"b{i}" for i in range(500)])
    a += a[:5]
    b += b[:5]
    expected = []
    for p in a:
        place = [q for q in b if q[1:3] == p[1:3] and p[1] is not None]
        found = {
            "exons": [q for q in place if q[7:] == p[7:]],
            "introns": [q for q in place if len(p[7]) > 1 and q[7][1:] == p[7][1:] and q[8][:-1] == p[8][:-1]],
            "near": [q for q in place if abs(q[3] - p[3]) < 6 and abs(q[4] - p[4]) < 6],
        }
        kind = next((k for k, v in found.items() if v), "none")
        expected.append((p[0], kind, min(q[0] for q in found[kind]) if kind != "none" else None, len(found.get(kind, []))))
    got = [tuple(r) for r in tr.structure_matches(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), 6).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str) and len({r[1] for r in got}) == 4


def test_from_exons(spark):
    rows = [("t", "chr1", "+", 5, 9, False), ("t", "chr1", "+", 9, 12, True), ("t", "chr1", "+", 20, 25, True), ("t", "chr1", "+", 22, 24, False), ("t", "chr1", "+", 30, 30, True), ("u", "chr1", "-", 3, 4, False)]
    got = sorted(tuple(r) for r in tr.from_exons(spark.createDataFrame(rows, "name string, chrom string, strand string, start long, end long, coding boolean")).collect())
    assert got == [("t", "chr1", "+", 5, 25, 9, 25, [5, 20], [12, 25]), ("u", "chr1", "-", 3, 4, 3, 3, [3], [4])]
