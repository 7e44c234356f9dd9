"""Readers and writers on small files, and the streams."""

from pyspark.sql import functions as F

from tidewater.sources import delimited, schemas, sequences, sinks
from tidewater.streaming import stateless


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_headers(spark):
    assert schemas.clean_headers(["#chrom", "a-b", "", "a-b", "a-b"]) == ["chrom", "a_b", "col2", "a_b_2", "a_b_3"]
    assert len(schemas.schema_of("bed12").fields) == 12 and len(schemas.schema_of("psl").fields) == 21 and schemas.schema_of("numColumns:2").names == ["col0", "col1"]


def test_tsv(spark, tmp_path):
    path = tmp_path / "a.tab"
    path.write_text('#id\tx y\tx y\n1\t"q\t\n2\t\tz\n')
    df = delimited.read_tsv(spark, str(path), types={"id": "int"})
    assert df.columns == ["id", "x_y", "x_y_2"]
    assert [r["id"] for r in df.orderBy("id").collect()] == [1, 2] and df.where("id = 1").first()["x_y"] == '"q'
    assert delimited.inferred_types(df.select(F.col("id").cast("string").alias("id"))) == {"id": "int"}
    pairs = tmp_path / "p.tab"
    pairs.write_text("a\t1\na\t2\nb\t3\n#c\t4\n")
    assert rows(delimited.read_pairs(spark, str(pairs))) == [("a", "1"), ("b", "3")]
    assert rows(delimited.read_pairs(spark, str(pairs), keep="last")) == [("a", "2"), ("b", "3")]


def test_typed(spark, tmp_path):
    path = tmp_path / "x.bed"
    path.write_text("# c\nchr1\t1\t5\tn\nchr2\t3\t9\n")
    assert rows(delimited.read_typed(spark, str(path), "bed4")) == [("chr1", 1, 5, "n"), ("chr2", 3, 9, "")]
    (tmp_path / "x.sam").write_text("@HD\nr\t16\tchr1\t10\t9\t4M2D1M\t*\t0\t0\tACGTA\t*\nu\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\n")
    assert rows(sequences.sam_to_bed(delimited.read_typed(spark, str(tmp_path / "x.sam"), "sam"))) == [("chr1", 9, 16, "r", 5, "-")]


def test_fasta_round_trip(spark, tmp_path):
    seqs = spark.createDataFrame([("a", "ACGT" * 50), ("b|x|d", "TTT"), ("none", "")], "id string, seq string")
    sinks.write_fasta(seqs, str(tmp_path / "f"))
    back = sequences.read_fasta(spark, str(tmp_path / "f"))
    assert rows(back.select("id", "seq")) == [("a", "ACGT" * 50), ("b|x|d", "TTT")]
    assert rows(sinks.distribute_fasta(seqs.where("id like 'b%'"), 1)) == [("b|d", "TTT", "x")]


def test_maf_and_matrices(spark, tmp_path):
    (tmp_path / "m.maf").write_text("##maf version=1\na score=1\ns hg.chr1 10 4 + 100 AC-GT\ns mm.chr2 5 5 - 90 ACAGT\n\na score=2\ns hg.chr1 20 2 + 100 TT\ns hg.chr1 30 2 + 100 GG\n")
    got = rows(sequences.read_maf(spark, str(tmp_path / "m.maf")).select("org", "chrom", "start", "size", "strand", "src_size", "seq"))
    assert got == [("hg", "chr1", 10, 4, "+", 100, "AC-GT"), ("hg", "chr1", 30, 2, "+", 100, "GG"), ("mm", "chr2", 5, 5, "-", 90, "ACAGT")]
    (tmp_path / "t.dat").write_text("AC  M1\nID  V$A\nP0  A C G T\n01 1 2 3 4 N\n02 0 0 9 0 G\n//\nAC  M2\nID  V$B\n01 1 0 0 0 A\n//\n")
    got = {r["id"]: r for r in sequences.read_matrices(spark, str(tmp_path / "t.dat")).collect()}
    assert got["V$A"]["name"] == "M1" and [tuple(w) for w in got["V$A"]["weights"]] == [(1, 2, 3, 4), (0, 0, 9, 0)] and len(got["V$B"]["weights"]) == 1


def test_wig_and_features(spark, tmp_path):
    (tmp_path / "w.wig").write_text("fixedStep chrom=c1 start=11 step=2\n1\n2\nfixedStep chrom=c2 start=1\n5\n")
    lines = delimited.read_lines(spark, str(tmp_path / "w.wig"))
    assert rows(sequences.fixed_steps(lines)) == [("c1", 10, 1.0), ("c1", 12, 2.0), ("c2", 0, 5.0)]
    vcf = spark.createDataFrame([("1", 5, "i", "A", "AT", ".", ".", "OCCURRENCE=p|1|2|.5,q|1|2|.5;X=1"), ("1", 6, "j", "A", "C", ".", ".", "X=1")], schemas.schema_of("vcf"))
    assert rows(sequences.split_occurrences(vcf).select("id", "project")) == [("i", "p"), ("i", "q")]
    assert [r["id"] for r in sequences.indels_or_snps(vcf, True).collect()] == ["j"]
    xml = spark.createDataFrame([(1, "<a><b k='x'>t</b><b k='y'>u</b></a>")], "i int, x string")
    assert rows(sequences.xml_fields(xml, "x", {"t": "a/b[@k='y']", "n": "a/c"}, "-").select("t", "n")) == [("u", "-")]
    assert rows(sequences.xml_all(xml, "x", "a/b/text()", "t").select("t")) == [("t",), ("u",)]


def test_matrix_market(spark, tmp_path):
    (tmp_path / "m").write_text("%%MatrixMarket\n%\n2 2 2\n1 2 3.5\n2 1 1\n")
    (tmp_path / "r").write_text("g1\tx\ng2\ty\n")
    (tmp_path / "c").write_text("b1\nb2\n")
    assert rows(delimited.read_matrix_market(spark, *(str(tmp_path / x) for x in "mrc"))) == [("g1", "b2", 3.5), ("g2", "b1", 1.0)]


def test_streams(spark, tmp_path):
    data = spark.createDataFrame([(i % 3, f"k{i % 2}") for i in range(10)], "n int, k string")
    data.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = stateless.read_folder(spark, str(tmp_path / "in"), data.schema).where("n > 0")
    stateless.write_batches(stream, lambda df, i: seen.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, seen)) == sorted(map(tuple, data.where("n > 0").collect()))
    done = spark.createDataFrame([("k0",)], "k string")
    assert {r["k"] for r in stateless.only_new(data, done, "k").collect()} == {"k1"}


def test_records(spark, tmp_path):
    from tidewater.operators import graph
    from tidewater.sources import records

    (tmp_path / "o.obo").write_text('format: 1\n\n[Term]\nid: A:1\nname: one\nnamespace: x\nsynonym: "uno" EXACT []\n\n[Term]\nid: A:2\nname: two\nnamespace: x\nis_a: A:1 ! one\n\n[Term]\nid: A:3\nname: old\nis_obsolete: true\n\n[Typedef]\nid: r\n')
    terms = records.read_obo(spark, str(tmp_path / "o.obo"), "x")
    assert rows(terms.select("term", "name", "parents", "synonyms")) == [("A:1", "one", [], ["uno"]), ("A:2", "two", ["A:1"], [])]
    assert rows(graph.ancestors(records.obo_edges(terms))) == [("A:2", "A:1", 1)]
    assert ("unos", "A:1") in rows(graph.synonyms(terms, 3))
    entry = "LOCUS       AB1 12 bp\nDEFINITION  a long\n            title.\nACCESSION   AB1\nSOURCE      x\n  ORGANISM  Homo sapiens\nREFERENCE   1\n  AUTHORS   Li,A. and\n            Bo,C.\n  TITLE     T\n  JOURNAL   J 1\n   PUBMED   77\nFEATURES\n     source  1..12\n             /db_xref=\"taxon:9606\"\nORIGIN\n        1 acgtac gtacgt\n//\n"
    (tmp_path / "g.gb").write_text(entry + entry.replace("AB1", "AB2"))
    got = records.read_genbank(spark, str(tmp_path / "g.gb"))
    assert rows(got.select("accession", "definition", "organism", "taxon", "length", "seq"))[0] == ("AB1", "a long title.", "Homo sapiens", 9606, 12, "ACGTACGTACGT")
    refs, links = records.reference_tables(got)
    assert rows(refs) == [(1, "Li,A. and Bo,C.", "T", "J 1", "77")] and rows(links) == [("AB1", 1), ("AB2", 1)]
    sparse = spark.createDataFrame([(1, {"a": "x"}), (2, {"b": "y"})], "i int, m map<string,string>")
    assert rows(records.map_columns(sparse, "i", "m", missing="-")) == [(1, "x", "-"), (2, "-", "y")]
    (tmp_path / "w").write_text("b\tblock1\nn\t1\nw\tACGT\nw\tTTTT\nb\tblock2\nn\t2\n")
    assert rows(records.tagged_records(spark, str(tmp_path / "w"), "b", ["n", "w"])) == [(["block1"], ["1"], ["ACGT", "TTTT"]), (["block2"], ["2"], [])]


def test_jdbc_in_ranges(spark):
    """Several tasks read a query by ranges of a column; none is lost, repeated or without a value."""
    import uuid

    from tidewater.operators import table
    from tidewater.sources import delimited

    url, options = f"jdbc:derby:memory:tw{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(k * 7 % 101, f"n{k}") for k in range(200)] + [(None, "none"), (-5, "low")]
    table.write_jdbc(spark.createDataFrame(rows, "k int, name string"), url, "t", "overwrite", **options)
    got = delimited.read_jdbc(spark, url, 'SELECT "k" AS "k", "name" AS "name" FROM t', by="k", parts=5, **options)
    assert got.rdd.getNumPartitions() == 5 and sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    none = delimited.read_jdbc(spark, url, 'SELECT "k" AS "k", "name" AS "name" FROM t WHERE "k" > 1000', by="k", **options)
    assert none.count() == 0
