"""Worked examples with known results, and properties of the interval operators."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions import sequence as fs
from tidewater.functions import statistics as st
from tidewater.operators import aggregate, benchmark, graph, ranking, sequence, table, text
from tidewater.operators import intervals as iv


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_join_keys(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "d")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (4, "w"), (5, "u")], "k int, v string")
    assert [r["k"] for r in table.cogroup_lists(a, b, "k").orderBy("k").collect()] == [1, 3]


def test_best_rows_keep_ties(spark):
    t = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", None), ("b", 0)], "k string, s int")
    assert rows(ranking.best_rows(t, "k", "s")) == [("a", 2), ("a", 2), ("b", 0)]


def test_set_benchmark_example(spark):
    p = spark.createDataFrame([("o", x) for x in "abcdef"], "k string, v string")
    r = spark.createDataFrame([("o", x) for x in "ab"], "k string, v string")
    got = benchmark.set_benchmark(p, r, "k", "v").first()
    assert (got["tp"], got["fn"], got["fp"]) == (2, 0, 4)
    assert got["precision"] == pytest.approx(1 / 3) and got["recall"] == 1 and got["f_score"] == 0.5
    assert benchmark.set_benchmark(p.limit(0), r, "k", "v").first()["n_objects"] == 0


def test_fisher_example():
    odds, p = st.fisher_exact(100, 2, 1000, 5)
    assert odds == 0.25 and p == pytest.approx(0.13007593634330314, rel=1e-9)
    assert st.binomial_tail(0, 10, 0.3) == 1 and st.binomial_tail(10, 10, 0.5) == pytest.approx(0.5**10)
    assert st.poisson_tail(1, 2.0) == pytest.approx(1 - 2.718281828459045**-2)
    assert st.hypergeometric_tail(1, 10, 5, 2) == pytest.approx(1 - 5 * 4 / 90)


def test_sequence_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()[0]
    assert value(fs.reverse_complement(F.lit("ACGTRYn-"))) == "-nRYACGT"
    assert value(fs.translate_dna(F.lit("ATGGCCTAANNA"))) == "MA*X"
    assert value(fs.hamming(F.lit("AACA"), F.lit("AGCT"))) == 2 and value(fs.hamming(F.lit("A"), F.lit("AA"))) == -1
    assert value(fs.kmers(F.lit("ACGT"), 3)) == ["ACG", "CGT"] and value(fs.kmers(F.lit("A"), 3)) == []
    assert value(fs.slice_sequence(F.lit("AACCGGTT"), F.lit(2), F.lit(20), F.lit("-"))) == "AACCGG"
    assert value(fs.cigar_length(F.lit("10M2I3D5N4S"))) == 18
    assert tuple(value(fs.parse_range(F.lit("x range=chr1:10-20 y")))) == ("chr1", 10, 20)
    assert value(fs.base_n(F.lit(255), 16, "0123456789abcdef")) == "ff" and value(fs.base_n(F.lit(0), 2, "01")) == "0"
    assert value(fs.remove_accents(F.lit("Éàü"))) == "Eau" and value(fs.gc_percent(F.lit("GCAT"))) == 50
    assert value(fs.wrap(F.lit("abcdef"), 3)) == "abc\ndef"
    assert fs.iupac_pattern("ARN") == "A[AG][ACGT]"


def test_regex_hits_both_strands(spark):
    seqs = spark.createDataFrame([("s", "ACTGnACTGnACTG"), ("e", None), ("x", "")], "id string, seq string")
    got = rows(sequence.regex_hits(seqs, {"p": "ACTG"}, cut=2))
    assert sorted(got) == [("s", a, a + 4, "AC[2,4]", "+", "p") for a in (0, 5, 10)]
    turned = rows(sequence.regex_hits(seqs, {"p": "CAGT"}))
    assert [r[1:5] for r in turned] == [(0, 4, "CAGT", "-"), (10, 14, "CAGT", "-"), (5, 9, "CAGT", "-")]


def test_alignment_operators(spark):
    aln = spark.createDataFrame([(1, "a", "AC-T"), (1, "b", "AG-T"), (1, "c", "AC-A")], "block int, org string, seq string")
    assert rows(sequence.consensus(aln)) == [(1, "AC-T")]
    assert rows(sequence.reduce_gaps(aln, 0.5)) == [(1, "a", "ACT"), (1, "b", "AGT"), (1, "c", "ACA")]
    two = aln.unionByName(spark.createDataFrame([(2, "a", "GG")], aln.schema))
    assert rows(sequence.concat_alignments(two)) == [("a", "AC-TGG"), ("b", "AG-T--"), ("c", "AC-A--")]
    assert {r[1:3]: round(r[3], 6) for r in rows(sequence.percent_identity(aln))}[("a", "b")] == round(2 / 3, 6)
    ic = {r["pos"]: r["ic"] for r in sequence.information_content(aln).collect()}
    assert ic[0] == pytest.approx(2.0)


def test_weight_matrix():
    m = sequence.WeightMatrix([[0, 0, 0, 9], [9, 0, 0, 0], [0, 0, 0, 9]])
    scores = m.scan("ccTATcc")
    assert scores.argmax() == 2 and scores.max() == pytest.approx(1.0, abs=1e-3) and m.consensus() == "TAT"


def test_nucleotide_strings():
    found = text.nucleotide_strings("the primer ACTGGACTTAGCCATGACTG was used, and acuggacuuagccaugacug too")
    assert [s for _, _, s, _ in found] == ["ACTGGACTTAGCCATGACTG", "ACTGGACTTAGCCATGACTG"]
    found = text.nucleotide_strings("seq ACTG GACT TAGC CATG ACTG CA end")
    assert found[0][2:] == ("ACTGGACTTAGCCATGACTGCA", 6)
    assert text.nucleotide_strings("AAAAAAAAAAAAAAAAAAAAAAAA and this") == []
    assert text.blank_out("<[^>]*>", "a<b>c") == "a   c"


def features(spark, seed, n=150, names="f"):
    draw = random.Random(seed)
    data = []
    for i in range(n):
        start = draw.randrange(0, 4000) * draw.choice([1, 1, 50])
        data.append((draw.choice(["c1", "c2"]), start, start + draw.choice([0, 1, 5, 60, 3000]), f"{names}{i}"))
    return data, spark.createDataFrame(data, "chrom string, start long, end long, name string")


@pytest.mark.parametrize("seed", [1, 2])
def test_overlap_join_is_naive_join(spark, seed):
    a, da = features(spark, seed)
    b, db = features(spark, seed + 10, names="g")
    expected = sorted((x[3], y[3], min(x[2], y[2]) - max(x[1], y[1])) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2])
    assert rows(iv.overlap_join(da, db).select("l.name", F.col("r.name").alias("n2"), "overlap_bp")) == expected
    hit = {e[0] for e in expected}
    assert {r["name"] for r in iv.overlap_join(da, db, "semi").collect()} == hit
    assert sorted(r["name"] for r in iv.overlap_join(da, db, "anti").collect()) == sorted(x[3] for x in a if x[3] not in hit)


@pytest.mark.parametrize("chunk", [100, 1 << 20])
def test_merge_is_naive_merge(spark, chunk):
    a, da = features(spark, 3)
    expected = []
    for c in ("c1", "c2"):
        runs = []
        for x in sorted(f for f in a if f[0] == c and f[1] < f[2]):
            if runs and x[1] < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], x[2])
            else:
                runs.append([x[1], x[2]])
        expected += [(c, s, e) for s, e in runs]
    assert rows(iv.merge_overlaps(da.where("start < end"), chunk=chunk).select("chrom", "start", "end")) == sorted(expected, key=repr)


def test_flatten_is_disjoint_and_complete(spark):
    a, da = features(spark, 4, 60)
    flat = rows(iv.flatten_shortest(da.where("start < end")).select("chrom", "start", "end"))
    covered = set()
    for c, s, e in flat:
        places = {(c, p) for p in range(s, e)}
        assert not covered & places
        covered |= places
    assert covered == {(x[0], p) for x in a for p in range(x[1], x[2])}


@pytest.mark.parametrize("chunk", [50, 1 << 20])
def test_nearest(spark, chunk):
    a, da = features(spark, 5, 40)
    b, db = features(spark, 6, 40, "g")
    got = {r["name"]: (r["left_gene"], r["left_distance"], r["right_gene"], r["right_distance"]) for r in iv.nearest_neighbours(da, db, chunk).collect()}
    for c, s, e, n in a:
        left = max(((y[2], y[3]) for y in b if y[0] == c and y[2] <= s), default=None)
        right = min(((y[1], y[3]) for y in b if y[0] == c and y[1] >= e), default=None)
        assert got[n] == (left and left[1], left and s - left[0], right and right[1], right and right[0] - e)


def test_empty_tables(spark):
    _, da = features(spark, 7, 5)
    none = da.limit(0)
    assert iv.overlap_join(none, da).count() == iv.overlap_join(da, none).count() == iv.merge_overlaps(none).count() == 0
    assert iv.coverage(none).first()["bp"] == 0 and iv.nearest_neighbours(da, none).where("left_gene is null").count() == 5


def test_blocks_round_trip(spark):
    da = spark.createDataFrame([("c", 0, 5, "n"), ("c", 8, 10, "n"), ("c", 4, 6, "n"), ("c", 900, 905, "n")], "chrom string, start long, end long, name string")
    joined = iv.join_blocks(da, 10)
    assert rows(joined) == [("c", "n", 0, 10, [0, 5, 8], [5, 1, 2]), ("c", "n", 900, 905, [0], [5])]
    assert rows(iv.explode_blocks(joined))[0] == ("c", 0, 5)


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c")], "child string, parent string")
    got = {(r[0], r[1]): r[2] for r in graph.ancestors(e).collect()}
    assert got[("a", "c")] == 2 and got[("a", "a")] == 3 and got[("d", "b")] == 3 and len(got) == 12
    assert graph.descendants(e).where("node = 'b'").count() == 3 + 1


def test_table_edges(spark):
    t = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("", "y", 3), (None, "z", 4), ("b", "x", 5)], "k string, v string, n int")
    assert rows(table.collapse(t, "k", order="n")) == [("a", "x"), ("b", "x")]
    assert rows(table.replace_values(t.select("k"), "k", spark.createDataFrame([("a", "A")], "key string, value string"), skip_missing=True)) == [("A",), ("A",)]
    assert rows(table.make_unique(t.select("v", "n").where("v is not null"), "v", ["n"], "n")) == [("x", 1), ("x_DUP_5", 5), ("y", 3), ("z", 4)]
    assert table.drop_constant_columns(t.withColumn("c", F.lit(1))).columns == ["k", "v", "n"]
    assert rows(table.keep_containing(t.where("v is not null").select("v"), "v", t.select(F.lit("(").alias("q")), "q")) == []
    assert rows(table.transpose_head(t.select("n"), ["n"], 3)) == [("n", "1", "2", "3")]
    assert rows(table.multimap_filter(t.where("k = 'a' or k = 'b'"), "k", "v", only_value="x", replace=(["x"], "w"))) == [("a", "w"), ("b", "w")]
    assert rows(aggregate.pair_counts(spark.createDataFrame([("a\tb",), ("a\tc",), ("d",)], "l string"), "l")) == [("a", 2)]
