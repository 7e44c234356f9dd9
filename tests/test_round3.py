"""What the third round's findings were about: plans that stay off the driver, work that is dealt out, results on odd rows."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidewater.functions import statistics as st
from tidewater.operators import aggregate as ag
from tidewater.operators import graph as gr
from tidewater.operators import intervals as iv
from tidewater.operators import motifs as mo
from tidewater.operators import sequence as sq
from tidewater.operators import staging
from tidewater.operators import table as tb
from tidewater.operators import text as tx
from tidewater.plans import extended, forms  # noqa: F401
from tidewater.plans.catalogue import ORACLE_SQL, QUERIES
from tidewater.sources import binary


def plan_of(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_texts_with_many_keys_stay_off_the_driver(spark):
    """the grams of the texts were sent to the driver wherever the planner took the texts for the smaller table."""
    texts = spark.range(40).select("id", F.concat(F.lit("red anchor "), F.col("id").cast("string")).alias("text"))
    keys = spark.range(100_000).select(F.concat(F.lit("anchor 1"), F.col("id").cast("string")).alias("k"))
    out = tb.keep_containing(texts, "text", keys.unionAll(spark.createDataFrame([("r 7",)], "k string")), "k")
    assert "BuildLeft" not in plan_of(out)
    assert sorted(r[0] for r in out.collect()) == [7, *range(10, 20)]


def test_carries_of_many_keys_stay_off_the_driver(spark):
    """a row a key and chunk was sent to every task."""
    rows = spark.range(50).select(F.col("id").cast("string").alias("chrom"), F.explode(F.sequence(F.lit(0), F.lit(20), F.lit(10))).alias("start")).withColumn("end", F.col("start") + 12)
    for run in (iv.prefix_max, iv.prefix_sum, iv.suffix_min):
        assert "Broadcast" not in plan_of(run(rows, F.col("end"), ["start"], "out", True, chunk=10))
    assert {r[0] for r in iv.islands(rows, chunk=10).select("island").collect()} == {0}


def test_hits_of_a_batch_of_sequences(spark):
    """sequences are scanned together; none runs into the next, and empty or missing ones give nothing."""
    matrix = [[8, 0, 1, 1], [0, 9, 0, 1], [1, 1, 7, 1]]
    seqs = [("a", "ACGTNAC"), ("b", "G"), ("c", None), ("d", ""), ("e", "gtacgé"), ("f", "CGT"), ("g", "ACUACG")]
    got = sorted(tuple(r) for r in mo.core_hits(spark.createDataFrame(seqs, "id string, seq string").coalesce(1), {"m": matrix}, 0.9, 0.9).select("id", "start", "end", "strand").collect())
    assert got == [("a", 0, 3, "+"), ("a", 1, 4, "-"), ("e", 2, 5, "+"), ("f", 0, 3, "-"), ("g", 3, 6, "+")]


def test_words_of_a_long_sequence(spark):
    """words of one sequence took the square of its length; pieces have all of them, each once, at its place."""
    text = "".join("ACGT"[(i * i + i // 7) % 4] for i in range(60_000)) + "é𝄞AC"
    df = spark.createDataFrame([("a", text), ("b", text[:66]), ("c", text[:2]), ("d", None)], "id string, seq string")
    words = [text[i : i + 3] for i in range(len(text) - 2)] + [text[i : i + 3] for i in range(64)]
    counts = sq.kmer_counts(df, 3)
    assert {r["kmer"]: r["n"] for r in counts.collect()} == Counter(words)
    track = {(r["id"], r["pos"]): r["n"] for r in sq.kmer_track(df, counts.select("kmer", "n"), 3, 1 << 30).collect()}
    assert len(track) == len(words) and {k[1] for k in track if k[0] == "a"} == set(range(len(text) - 2))


def test_words_are_dealt_before_they_are_made(spark):
    """a small file's words were all made in the one task that reads it; short words' places met by word."""
    df = spark.createDataFrame([(str(i), "ACGTACGTTA") for i in range(100)], "id string, seq string").coalesce(1)
    for out in (sq.kmer_counts(df, 4, True), sq.markov_scores(df, sq.markov_model(df, 2), 2)):
        assert "REPARTITION_BY_NUM" in plan_of(out)
    track = sq.kmer_track(df, sq.kmer_counts(df, 4, True).select("kmer", "n"), 4, 50)
    assert "SortMergeJoin" not in plan_of(track) and track.count() == 700


def test_tails_are_worked_out_once_for_equal_arguments(spark, monkeypatch):
    """each row's tail was summed anew."""
    calls = []
    once = st._each_once([np.array([1.0, 2, 1, 1]), np.array([3.0, 3, 3, 4])], lambda a, b: calls.append((a, b)) or a * b)
    assert once.tolist() == [3, 6, 3, 4] and len(calls) == 3
    df = spark.createDataFrame([(1, 2, 3, 4), (1, 2, 3, 4), (None, 1, 1, 1)], "a int, b int, c int, d int")
    got = [r[0] for r in df.select(st.fisher_p("a", "b", "c", "d")).collect()]
    assert got[0] == got[1] and abs(got[0] - st.fisher_exact(1, 2, 3, 4)[1]) < 1e-9 and got[2] is None


def test_report_read_in_chunks(spark):
    """a file's report was read by one task; now its lines are dealt out by chunks, whatever the chunk."""
    text = ["Identities = 1/2 (x)", "Query= q1 words", "Identities = 1/2 (x)", "> t1 name", " Score = 5.5 bits (9), Expect = 1e-5,", "noise", " Identities = 3/4 (x%)", "> t2", " Identities = 4/4", "Query= q2", " Identities = 9/9", ">t3", "Score = 7 bits, Expect(2) = e-30", "Identities = 1/4"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "file string, pos long, line string")
    expected = {("q1", "t1", 5.5, 1e-5, 75.0, 4), ("q1", "t2", 5.5, 1e-5, 100.0, 4), ("q2", "t3", 7.0, 1e-30, 25.0, 4)}
    for chunk in (1, 3, 1 << 16):
        out = tx.report_hits(lines, chunk)
        assert {tuple(r) for r in out.collect()} == expected and "InPandas" not in plan_of(out)


def test_rows_packed_run_by_run_in_a_stream(spark):
    """each run of overlapping features was a call of its own."""
    rows = [("a", i * 10, i * 10 + 12 if i % 3 else i * 10 + 9, f"n{i}") for i in range(300)] + [("b", 5, 9, "x"), ("b", 6, 8, "y")]
    out = iv.packed_rows(spark.createDataFrame(rows, "chrom string, start long, end long, name string"))
    assert "InPandas" not in plan_of(out)
    got = {r["name"]: r["row"] for r in out.collect()}
    assert (got["x"], got["y"]) == (0, 1) and [got[f"n{i}"] for i in range(6)] == [0, 0, 1, 0, 0, 1]


def test_pairs_of_keys_are_counted_where_a_key_is(spark):
    """every pair of an item's keys was exchanged."""
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (1, "y"), (2, "y"), (2, "y"), (None, "x"), (4, None), (5, None)], "k int, i string")
    out = ag.jaccard_pairs(df, "k", "i")
    assert {(r["a"], r["b"], r["n_common"], round(r["jaccard"], 6)) for r in out.collect()} == {(1, 2, 2, 1.0), (1, 3, 1, 0.5), (2, 3, 1, 0.5)}
    assert "posexplode" in plan_of(out)


def test_blocks_of_names_are_dealt_to_all_tasks(spark):
    """small shuffled partitions were put together before their rows were sorted."""
    df = spark.createDataFrame([("c", str(i % 9), i, i + 5) for i in range(50)], "chrom string, name string, start int, end int")
    assert "REPARTITION_BY_NUM" in plan_of(iv.join_blocks(df, 10))


def test_postings_leave_a_batch_in_parts(spark):
    """all postings of a batch of ten thousand texts were held at once."""
    df = spark.range(1000).select("id", F.lit("a b a").alias("t")).coalesce(1)
    out = ag.inverted_index(df, "id", "t")
    assert out.count() == 2000 and {tuple(r["positions"]) for r in out.collect()} == {(0, 2), (1,)}


def test_customers_without_any_order():
    """only urgent orders counted."""
    assert "WHERE" not in ORACLE_SQL["id_remove"]


def test_rounding_keeps_the_sign_of_zero(spark, tmp_path):
    """SQL rounds a small negative number to -0.0."""
    spark.createDataFrame([(1, [-1e-7, 2.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert str(QUERIES["shuffle_keeps_values"](spark, str(tmp_path)).first()["sorted"]) == "[-0.0, 2.0]"


def test_parts_of_a_matrix_are_bounded(spark, tmp_path, monkeypatch):
    """a task wrote, and another read, all its keys as one part."""
    monkeypatch.setattr(binary, "ROWS_A_PART", 3)
    writer = binary._Writer({"path": str(tmp_path / "m")}, False)
    writer.commit([writer.write(iter([(f"k{i}", [float(i), 1.0]) for i in range(8)])), writer.write(iter([]))])
    reader = binary._Reader({"path": str(tmp_path / "m")})
    parts = reader.partitions()
    assert [p.value["rows"] for p in parts] == [3, 3, 2]
    assert sorted(r for p in parts for r in reader.read(p)) == [(f"k{i}", [float(i), 1.0]) for i in range(8)]
    assert binary.look_up(str(tmp_path / "m"), "k5") == [[5.0, 1.0]]


def test_closures_double_their_depth(spark, monkeypatch):
    """a chain took as many rounds as it has links, each against all pairs found so far."""
    rounds = []
    monkeypatch.setattr(gr, "written", lambda df: rounds.append(1) or staging.written(df))
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(3, 7), (12, 9)], "child int, parent int")
    near = {i: [j for a, j in [(k, k + 1) for k in range(12)] + [(3, 7), (12, 9)] if a == i] for i in range(13)}

    def expected(most=99, stop=()):
        out = {}
        for start in near:
            front, depth = near[start], 1
            while front and depth <= most:
                fresh = [x for x in dict.fromkeys(front) if (start, x) not in out]
                out.update({(start, x): depth for x in fresh})
                front, depth = [y for x in fresh if x not in stop for y in near[x]], depth + 1
        return out

    got = lambda *a: {(r["node"], r["ancestor"]): r["depth"] for r in gr.ancestors(edges, *a).collect()}
    assert got() == expected() and len(rounds) <= 6
    assert got(3) == expected(3) and got(1) == expected(1)
    assert got(None, spark.createDataFrame([(5,), (9,)], "node int")) == expected(stop=(5, 9))
