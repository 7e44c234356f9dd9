"""Motif families, consensus search, aligned blocks and core matrices against plain Python."""

import random
from collections import Counter
from itertools import combinations
from math import comb, log, log10

import pytest

from tidewater.operators import graph
from tidewater.operators import motifs as mo

SETS = {c: set(s) for s, c in mo.CODES.items()}
TURN = str.maketrans("ACGT", "TGCA")


def groups(nodes, links):
    root = {n: n for n in nodes}
    while True:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
        if not changed:
            return root


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    dice = random.Random(seed)
    links = [(dice.randrange(300), dice.randrange(300)) for _ in range(150 + 60 * seed)] + [(k, k + 1) for k in range(1000, 1000 + 90 * seed)]
    links += [(5, 5), (7, 8), (8, 7)]
    nodes = {x for e in links if e[0] != e[1] for x in e} | {9999, 9998}
    edges = spark.createDataFrame([*links, (None, 3), (4, None)], "a long, b long")
    lone = spark.createDataFrame([(9999,), (9998,), (9999,), (None,)], "node long")
    got = graph.components(edges, lone).collect()
    assert {r["node"]: r["component"] for r in got} == groups(nodes, [e for e in links if e[0] != e[1]]) and len(got) == len(nodes)
    assert graph.components(edges.limit(0)).count() == 0


def test_motif_families(spark):
    dice = random.Random(4)
    words = ["".join(dice.choices("ACGT", k=dice.choice([4, 5]))) for _ in range(60)]
    rows = [(dice.choice(words), f"g{dice.randrange(40)}") for _ in range(300)] + [("ACgT", "g1"), (None, "g2"), ("TTTTTTT", None)]
    front = {f"g{k}" for k in range(10)} | {"g99"}
    back = {f"g{k}" for k in range(50)} | front
    got = mo.motif_families(spark.createDataFrame(rows, "motif string, gene string"), spark.createDataFrame([(g,) for g in front], "gene string"), spark.createDataFrame([(g,) for g in back], "gene string")).collect()
    plain = {m.upper() for m, _ in rows if m}
    root = groups(plain, [(a, b) for a, b in combinations(sorted(plain), 2) if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1])
    expected = {}
    for family in set(root.values()):
        members = [m for m in plain if root[m] == family]
        genes = {g for m, g in rows if m and g and m.upper() in members}
        k, n, p = len(genes & front), len(genes), len(front) / len(back)
        tail = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        codes = "".join(next(c for c, s in SETS.items() if s == {m[i] for m in members}) for i in range(len(family)))
        expected[family] = (len(members), codes, n, k, -log10(tail))
    assert {r["family"]: tuple(r)[1:5] for r in got} == {f: e[:4] for f, e in expected.items()}
    assert all(abs(r["score"] - expected[r["family"]][4]) < 1e-9 for r in got)


def blocks(seed, n=25):
    """Alignments of a few rows with gaps, N and other letters; some blocks without the reference."""
    dice = random.Random(seed)
    rows = []
    for b in range(n):
        width, orgs = dice.randint(1, 60), dice.sample(["ref", "mouse", "chick", "fish"], dice.randint(1, 4))
        base = dice.choices("ACGT", k=width)
        for o in orgs:
            rows.append((b, o, "".join(dice.choice("acgtN-.") if dice.random() < 0.12 else c for c in base)))
    return rows + [(n, "ref", None), (n + 1, "ref", "-" * 5), (n + 1, "fish", "ACGT-")]


def consensus(ref, others):
    out = ""
    for i, base in enumerate(ref):
        beside = [o[i] for o in others]
        if base in "-N":
            out += base
        elif "-" in beside:
            out += "#"
        else:
            letters = {base} | {x for x in beside if x != "N"}
            out += next((c for c, s in SETS.items() if s == letters), ".")
    return out


def by_block(rows):
    out = {}
    for b, o, s in rows:
        if s is not None:
            out.setdefault(b, {})[o] = s.upper()
    return {b: (x["ref"], [s for o, s in sorted(x.items()) if o != "ref"]) for b, x in out.items() if "ref" in x}


def test_consensus_and_hits(spark):
    rows = blocks(1)
    table = spark.createDataFrame(rows, "block long, org string, seq string")
    expected = {b: consensus(*x) for b, x in by_block(rows).items()}
    got = {r["block"]: (r["consensus"], r["score"]) for r in mo.block_consensus(table, "ref").collect()}
    assert got == {b: (c, sum(c.count(x) for x in "ACGT")) for b, c in expected.items()}
    wanted = ["AC", "RY", "NNN", "gat", "TB"]
    turned = {"A": "T", "C": "G", "G": "C", "T": "A", "R": "Y", "Y": "R", "N": "N", "B": "V"}
    found = set()
    for b, c in expected.items():
        ref = by_block(rows)[b][0]
        for m in wanted:
            for strand, word in (("+", m.upper()), ("-", "".join(turned[x] for x in reversed(m.upper())))):
                for i in range(len(c) - len(m) + 1):
                    if all(x in SETS and SETS[x] <= SETS[w] for x, w in zip(c[i:], word)):
                        at = i - ref[:i].count("-")
                        found.add((b, m, strand, i, at, at + len(m)))
    hits = [tuple(r)[:6] for r in mo.consensus_hits(table, "ref", wanted).collect()]
    assert set(hits) == found and len(hits) == len(found) > 100


def test_slices_blocks_and_columns(spark):
    rows = [r for r in blocks(2) if r[2] is not None]
    table = spark.createDataFrame(rows, "block long, org string, seq string")
    seqs = {(b, o): s for b, o, s in rows}
    dice = random.Random(3)
    places = [(dice.randrange(26), dice.randint(-1, 20), dice.randint(0, 40)) for _ in range(200)]
    got = sorted((r["block"], r["start"], r["end"], r["org"], r["seq"]) for r in mo.alignment_slices(table, "ref", spark.createDataFrame(places, "block long, start long, end long")).collect())
    expected = []
    for b, s, e in places:
        ref = seqs.get((b, "ref"))
        at = [i for i, x in enumerate(ref or "") if x != "-"]
        if 0 <= s < e <= len(at):
            expected += [(b, s, e, o, x[at[s] : at[e - 1] + 1]) for (c, o), x in seqs.items() if c == b]
    assert got == sorted(expected) and got
    parts = {}
    for r in mo.ungapped_blocks(table).collect():
        parts[r["block"], r["org"], r["column"]] = (r["part"], r["start"], r["seq"])
    covered = Counter()
    for (b, o, column), (_, start, seq) in parts.items():
        whole = seqs[b, o]
        assert "-" not in seq and whole[column : column + len(seq)] == seq and start == column - whole[:column].count("-")
        covered[b, o] += len(seq)
    for b in {r[0] for r in rows}:
        mine = {o: s for (c, o), s in seqs.items() if c == b}
        full = sum(all(s[i] != "-" for s in mine.values()) for i in range(len(next(iter(mine.values())))))
        assert all(covered[b, o] == full for o in mine)
    columns = sorted(tuple(r) for r in mo.aligned_columns(table, "ref", "fish").collect() if r["other_place"] is not None)
    back = []
    for (b, o), s in seqs.items():
        if o == "fish" and (b, "ref") in seqs:
            ref, p, q = seqs[b, "ref"], 0, 0
            for x, y in zip(ref, s):
                if x != "-" and y != "-":
                    back.append((b, p, x, "|" if x.upper() == y.upper() else ".", y, q))
                p, q = p + (x != "-"), q + (y != "-")
    assert columns == sorted(back)


MATRICES = {"m1": [[9, 1, 0, 0], [0, 8, 1, 1], [3, 3, 2, 2], [0, 0, 10, 0], [1, 1, 0, 8], [2, 6, 1, 1], [10, 0, 0, 0]], "m2": [[5, 0, 5, 0], [0, 5, 0, 5], [10, 0, 0, 0]]}


def plain_scores(counts, word):
    f = [[(x + 0.001) / (sum(r) + 0.004) for x in r] for r in counts]
    ic = [sum(p * log(4 * p) for p in r) for r in f]
    core = sorted(range(len(f)), key=lambda i: (-ic[i], i))[:5]

    def part(places):
        own = sum(f[i]["ACGT".index(word[i])] * ic[i] for i in places)
        low, high = (sum(g(f[i]) * ic[i] for i in places) for g in (min, max))
        return (own - low) / (high - low)

    return part(core), part(range(len(f)))


def test_core_hits_and_disjoint_ones(spark):
    dice = random.Random(6)
    seqs = [(str(i), "".join(dice.choices("ACGTacgtN", k=dice.randint(0, 90)))) for i in range(30)] + [("n", None)]
    got = {(r["id"], r["start"], r["strand"], r["pattern"]): (r["core"], r["score"]) for r in mo.core_hits(spark.createDataFrame(seqs, "id string, seq string"), MATRICES, 0.6, 0.65).collect()}
    expected = {}
    for i, s in seqs:
        s = (s or "").upper()
        for name, m in MATRICES.items():
            for a in range(len(s) - len(m) + 1):
                for strand, word in (("+", s[a : a + len(m)]), ("-", s[a : a + len(m)][::-1].translate(TURN))):
                    if "N" not in word and (x := plain_scores(m, word)) and x[0] >= 0.6 and x[1] >= 0.65:
                        expected[i, a, strand, name] = x
    assert got.keys() == expected.keys() and len(got) > 50
    assert all(abs(got[k][0] - v[0]) + abs(got[k][1] - v[1]) < 1e-9 for k, v in expected.items())
    hits = mo.core_hits(spark.createDataFrame(seqs, "id string, seq string"), MATRICES, 0.6, 0.65)
    rows = [tuple(r) for r in hits.collect()]
    for closed in (False, True):
        kept = []
        for r in sorted(rows, key=lambda r: (r[0], -r[4], r[1], r[2], r[6], r[5])):
            if not any(k[0] == r[0] and (k[1] <= r[2] and r[1] <= k[2] if closed else k[1] < r[2] and r[1] < k[2]) for k in kept):
                kept.append(r)
        assert sorted(tuple(r) for r in mo.disjoint_hits(hits, closed).collect()) == sorted(kept)


def test_closed_intervals(spark):
    """A feature that lies inside another overlaps it, and with closed ends so do neighbours that touch."""
    rows = [("s", 0, 9, 0.9, 0.9, "+", "a"), ("s", 3, 5, 0.8, 0.8, "+", "a"), ("s", 9, 12, 0.7, 0.7, "+", "a"), ("s", 13, 14, 0.1, 0.6, "-", "a"), ("s", 13, 14, 0.1, 0.6, "-", "a")]
    table = spark.createDataFrame(rows, mo._HITS)
    assert sorted(r["start"] for r in mo.disjoint_hits(table).collect()) == [0, 9, 13]
    assert sorted(r["start"] for r in mo.disjoint_hits(table, True).collect()) == [0, 13]


def test_conserved_hits(spark):
    rows = [r for r in blocks(7, 40) if r[2] is not None]
    table = spark.createDataFrame(rows, "block long, org string, seq string")
    got = {(r["block"], r["pattern"], r["strand"], r["start"]): (r["end"], r["n_rows"], tuple(r["core_at"])) for r in mo.conserved_hits(table, "ref", MATRICES, 0.5, 0.55, 2).collect()}
    expected = {}
    for b, (ref, others) in by_block(rows).items():
        own = [i for i, x in enumerate(ref) if x != "-"]
        for name, m in MATRICES.items():
            k = len(m)
            ic = [sum(p * log(4 * p) for p in [(x + 0.001) / (sum(r) + 0.004) for x in r]) for r in m]
            core = sorted(sorted(range(k), key=lambda i: (-ic[i], i))[:5])
            for a in range(len(own) - k + 1):
                for strand in "+-":
                    n = 0
                    for s in [ref, *others]:
                        word = s[own[a] :].replace("-", "")[:k]
                        word = word if strand == "+" else word[::-1].translate(TURN)
                        if len(word) == k and not set(word) - set("ACGT"):
                            x = plain_scores(m, word)
                            n += x[0] >= 0.5 and x[1] >= 0.55
                    if n >= 2:
                        expected[b, name, strand, a] = (a + k, n, tuple(sorted(a + (i if strand == "+" else k - 1 - i) for i in core)))
    assert got == expected and got
    hits = mo.conserved_hits(table, "ref", MATRICES, 0.5, 0.55, 2)
    places = [(b, p) for b in range(40) for p in (3, 11)]
    near = {(r["block"], r["pattern"], r["strand"], r["start"]) for r in mo.touching_core(hits, spark.createDataFrame(places, "block long, place long")).collect()}
    assert near == {k for k, v in expected.items() if {3, 11} & set(v[2])}


def test_choice_of_matrices():
    assert set(mo.matrix_choice(MATRICES, exclude=("m1",))) == {"m2"} and set(mo.matrix_choice(MATRICES, pattern="1$")) == {"m1"}
    assert set(mo.matrix_choice(MATRICES, least_bits=5)) == {"m1"} and not mo.matrix_choice(MATRICES, least_sites=11)


def test_motif_windows(spark):
    dice = random.Random(9)
    rows = [(dice.choice("xy"), s := dice.randrange(300), s + dice.randint(1, 30), dice.choice("abcd")) for _ in range(150)]
    rows += rows[:10]
    got = {(r["chrom"], r["start"]): (r["end"], r["n"], [tuple(m) for m in r["members"]]) for r in mo.motif_windows(spark.createDataFrame(rows, "chrom string, start long, end long, name string"), {"a": 2, "b": 1}, 20).collect()}
    expected = {}
    for c, s in {(r[0], r[1]) for r in rows if r[3] in "ab"}:
        inside = sorted((r[1], r[2], r[3]) for r in rows if r[0] == c and s <= r[1] < s + 20 and r[3] in "ab")
        if sum(r[2] == "a" for r in inside) >= 2 and any(r[2] == "b" for r in inside):
            expected[c, s] = (max(r[1] for r in inside), len(inside), inside)
    assert got == expected and got
