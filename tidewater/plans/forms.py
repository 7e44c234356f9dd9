"""Queries of readers, writers, formats and smaller operators; their rows come from the driver tables or stand in the query.

Formats that the tables lack are spelled from table rows, written to the shared folder, and read back by the reader in question.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as fs
from ..functions import statistics as st
from ..operators import aggregate as ag
from ..operators import benchmark as bm
from ..operators import graph as gr
from ..operators import intervals as iv
from ..operators import ranking as rk
from ..operators import sequence as sq
from ..operators import staging
from ..operators import table as tb
from ..operators import text as tx
from ..operators import words as wd
from ..sources import delimited as dl
from ..sources import records as rc
from ..sources import sequences as src
from ..sources import sinks
from ..streaming import stateless
from .catalogue import _ITEMS, _ROOMY_ITEMS, _ROOMY_SPANS, _SPANS, _SPOTS, items, register, roomy_items, roomy_spans, spans, spots, table


def text_folder(df):
    """Write (value) rows as lines to the shared folder; its path."""
    path = staging.fresh_path(df.sparkSession)
    df.write.text(path)
    return path


#: Part names as DNA: a digest's hexadecimal digits read as bases.
_DNA = "translate(md5(p_name), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def dna(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.expr(_DNA).alias("seq"))


# -- delimited files ----------------------------------------------------------------------------------------------------


@register("tsv_round_trip", "SELECT p_partkey, p_name, p_size FROM part")
def tsv_round_trip(spark, sf):
    path = staging.fresh_path(spark)
    sinks.write_tsv(table(spark, sf, "part", "p_partkey", "p_name", "p_size"), path)
    return dl.read_tsv(spark, path, types={"p_partkey": "long", "p_size": "int"})


@register("csv_round_trip", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', \"x\"' AS c_name FROM customer")
def csv_round_trip(spark, sf):
    path = staging.fresh_path(spark)
    table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(', "x"')).alias("c_name")).write.option("header", True).option("escape", '"').csv(path)
    return dl.read_csv(spark, path)


@register("lines_round_trip", "SELECT c_name AS line FROM customer")
def lines_round_trip(spark, sf):
    return dl.read_lines(spark, text_folder(table(spark, sf, "customer").select(F.col("c_name").alias("value")))).select("line")


@register("comment_lines", "SELECT c_name AS line FROM customer WHERE c_custkey % 3 <> 0")
def comment_lines(spark, sf):
    value = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("#"), "c_name")).otherwise(F.col("c_name"))
    return dl.read_lines(spark, text_folder(table(spark, sf, "customer").select(value.alias("value")))).where(~F.col("line").startswith("#")).select("line")


@register("rows_as_maps", """SELECT '{"r_regionkey":"' || r_regionkey || '","r_name":"' || r_name || '"}' AS json FROM region""")
def rows_as_maps(spark, sf):
    return dl.rows_as_maps(table(spark, sf, "region", "r_regionkey", "r_name")).select(F.to_json("row").alias("json"))


@register("typed_bed", f"""WITH {_SPANS} SELECT chrom, "start", "end", name, CASE WHEN "start" % 2 = 0 THEN 7 END AS score, CASE WHEN "start" % 2 = 0 THEN '+' ELSE '' END AS strand FROM spans""")
def typed_bed(spark, sf):
    even = F.col("start") % 2 == 0
    line = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "name", F.when(even, F.lit("7\t+")))
    return dl.read_typed(spark, text_folder(spans(spark, sf).select(line.alias("value"))), "bed6")


@register("read_pairs", "SELECT 'k' || o_custkey AS key, CAST(min(o_orderkey) AS VARCHAR) AS value FROM orders GROUP BY o_custkey")
def read_pairs(spark, sf):
    own = table(spark, sf, "orders").orderBy("o_orderkey").select(F.concat(F.lit("k"), F.col("o_custkey").cast("string"), F.lit("\t"), F.col("o_orderkey").cast("string")).alias("value"))
    return dl.read_pairs(spark, text_folder(own.coalesce(1)))


@register("matrix_market", "SELECT 'row' || l_suppkey AS row, 'col' || l_linenumber AS \"column\", CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY l_suppkey, l_linenumber")
def matrix_market(spark, sf):
    cells = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))
    suppliers = table(spark, sf, "supplier").select("s_suppkey").distinct()
    low = suppliers.agg(F.min("s_suppkey")).first()[0]
    body = cells.select(F.concat_ws(" ", (F.col("l_suppkey") - low + 1).cast("string"), F.col("l_linenumber").cast("string"), F.col("n").cast("string")).alias("value"))
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate",), ("9 9 9",)], "value string")
    rows = text_folder(suppliers.orderBy("s_suppkey").select(F.concat(F.lit("row"), F.col("s_suppkey").cast("string")).alias("value")).coalesce(1))
    columns = text_folder(spark.range(1, 8).orderBy("id").select(F.concat(F.lit("col"), F.col("id").cast("string")).alias("value")).coalesce(1))
    whole = head.withColumn("at", F.when(F.col("value").startswith("%"), 0).otherwise(1)).unionAll(body.withColumn("at", F.lit(2)))
    return dl.read_matrix_market(spark, text_folder(whole.coalesce(1).sortWithinPartitions("at").select("value")), rows, columns)


@register("inferred_types", "SELECT * FROM (VALUES ('flag', 'bool'), ('key', 'int'), ('price', 'float'), ('one', 'char(1)'), ('name', 'varchar(255)')) AS t(column_name, type)")
def inferred_types(spark, sf):
    rows = table(spark, sf, "orders").select((F.col("o_orderkey") % 2).cast("string").alias("flag"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderstatus").alias("one"), F.col("o_orderpriority").alias("name"))
    return spark.createDataFrame(list(dl.inferred_types(rows).items()), "column_name string, type string")


@register("jdbc_round_trip", "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name FROM nation WHERE n_nationkey > 3")
def jdbc_round_trip(spark, sf):
    """Through a database that lives in the session's own process, so it runs in one process only."""
    import uuid

    url, options = f"jdbc:derby:memory:tw{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    tb.write_jdbc(table(spark, sf, "nation", "n_nationkey", "n_name"), url, "nation", "overwrite", **options)
    return dl.read_jdbc(spark, url, 'SELECT "n_nationkey" AS "n_nationkey", "n_name" AS "n_name" FROM nation WHERE "n_nationkey" > 3', **options)


@register("write_by_value", "SELECT c_custkey, c_mktsegment FROM customer")
def write_by_value(spark, sf):
    path = staging.fresh_path(spark)
    sinks.write_by_value(table(spark, sf, "customer", "c_custkey", "c_mktsegment"), path, "c_mktsegment")
    return spark.read.schema("c_custkey long, c_mktsegment string").option("header", True).option("sep", "\t").csv(path)


@register("saved_tables", "SELECT 'tw_region' AS name, count(*) AS n FROM region UNION ALL SELECT 'tw_nation', count(*) FROM nation")
def saved_tables(spark, sf):
    counts = tb.save_tables({f"tw_{n}": table(spark, sf, n) for n in ("region", "nation")}, staging.fresh_path(spark))
    return spark.createDataFrame(list(counts.items()), "name string, n long")


@register("arff_rows", "SELECT n_nationkey || ',' || n_name || ',?' AS value FROM nation")
def arff_rows(spark, sf):
    return sinks.arff_text(table(spark, sf, "nation", "n_nationkey", "n_name").withColumn("none", F.lit(None).cast("string")), "nation", {"n_name": ["A"]})[1]


@register("html_rows", "SELECT '<tr><td>' || p_partkey || '</td><td>' || replace(p_type, ' ', '&lt;') || '</td></tr>' AS value FROM part")
def html_rows(spark, sf):
    return sinks.html_rows(table(spark, sf, "part").select("p_partkey", F.replace("p_type", F.lit(" "), F.lit("<"))))


@register("xml_rows", "SELECT '<row> <n_nationkey>' || n_nationkey || '</n_nationkey> <n_name>' || n_name || '</n_name> </row>' AS value FROM nation")
def xml_rows(spark, sf):
    return sinks.xml_text(table(spark, sf, "nation", "n_nationkey", "n_name"), "row")


# -- sequence and alignment formats --------------------------------------------------------------------------------------


@register("fasta_round_trip", f"SELECT CAST(p_partkey AS VARCHAR) AS id, '' AS description, {_DNA} AS seq FROM part")
def fasta_round_trip(spark, sf):
    path = staging.fresh_path(spark)
    sinks.write_fasta(dna(spark, sf), path, 10)
    return src.read_fasta(spark, path)


@register("distribute_fasta", f"SELECT 'x|' || p_partkey AS id, {_DNA} AS seq, p_brand AS filename FROM part")
def distribute_fasta(spark, sf):
    named = dna(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_brand"), "id")
    return sinks.distribute_fasta(named.select(F.concat_ws("|", F.lit("x"), "p_brand", "id").alias("id"), "seq"), 1)


_MAF = """m AS (SELECT o_orderkey AS block, 'org' || i AS org, 'c' || o_custkey AS chrom, o_custkey AS "start", CAST(4 AS BIGINT) AS size, '+' AS strand, CAST(100 AS BIGINT) AS src_size, 'ACGT' AS seq FROM orders, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= 1 + o_orderkey % 3)"""


def aligned(spark, sf):
    """Blocks of one to three organisms, one for each order."""
    rows = table(spark, sf, "orders").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), 1 + F.col("o_orderkey") % 3)))
    return rows.select(F.col("o_orderkey").alias("block"), F.concat(F.lit("org"), F.col("i").cast("string")).alias("org"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("chrom"), F.col("o_custkey").alias("start"), F.lit(4).cast("long").alias("size"), F.lit("+").alias("strand"), F.lit(100).cast("long").alias("src_size"), F.lit("ACGT").alias("seq"))


@register("maf_round_trip", f"WITH {_MAF} SELECT org, chrom, \"start\", size, strand, src_size, seq FROM m")
def maf_round_trip(spark, sf):
    return src.read_maf(spark, text_folder(sq.maf_text(aligned(spark, sf)).select("value"))).drop("block")


@register("fasta_to_maf", "SELECT l_orderkey AS block, 'sp' || l_linenumber AS org, 'c1' AS chrom, l_partkey AS \"start\", CAST(3 AS BIGINT) AS size, '-' AS strand, l_partkey + 3 AS src_size, 'A-CG' AS seq FROM lineitem")
def fasta_to_maf(spark, sf):
    head = F.concat(F.lit("sp"), F.col("l_linenumber").cast("string"), F.lit(".c1:"), F.col("l_partkey").cast("string"), F.lit("-"), (F.col("l_partkey") + 3).cast("string"), F.lit("(-)"))
    return sq.fasta_rows_to_maf(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("block"), head.alias("id"), F.lit("A-CG").alias("seq")))


@register("block_species", f"WITH {_MAF} SELECT block, org FROM m WHERE block IN (SELECT block FROM m WHERE org IN ('org1', 'org3') GROUP BY block HAVING count(DISTINCT org) = 2)")
def block_species(spark, sf):
    return sq.blocks_with(aligned(spark, sf), ["org1", "org3"]).select("block", "org")


@register("block_statistics", "SELECT l_orderkey AS block, count(*) AS n_rows, CAST(max(2 + l_linenumber) AS BIGINT) AS width, round(CAST(sum(l_linenumber) AS DOUBLE) / sum(2 + l_linenumber), 9) AS gap_share FROM lineitem GROUP BY 1")
def block_statistics(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("block"), F.concat(F.lit("AC"), F.expr("repeat('-', l_linenumber)")).alias("seq"))
    return sq.block_statistics(rows).withColumn("gap_share", F.round("gap_share", 9))


@register("join_adjacent", """WITH b AS (SELECT o_orderstatus AS chrom, o_orderkey * 4 AS s, 'ACGT' AS w, o_orderkey % 2 AS two FROM orders), n AS (SELECT *, CASE WHEN lag(s) OVER (PARTITION BY chrom ORDER BY s) = s - 4 THEN 0 ELSE 1 END AS new FROM b),
  r AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY s) AS run FROM n) SELECT chrom, min(s) AS "start", 'base' AS org, string_agg(w, '' ORDER BY s) AS seq FROM r GROUP BY chrom, run
  UNION ALL SELECT chrom, min(s), 'other', string_agg(CASE WHEN two = 0 THEN 'TTTT' ELSE '----' END, '' ORDER BY s) FROM r GROUP BY chrom, run HAVING count(*) FILTER (two = 0) > 0""")
def join_adjacent(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("block"), F.col("o_orderstatus").alias("chrom"), (F.col("o_orderkey") * 4).alias("start"), F.lit(4).cast("long").alias("size"))
    rows = o.withColumn("org", F.lit("base")).withColumn("seq", F.lit("ACGT")).unionByName(o.where("block % 2 = 0").withColumn("org", F.lit("other")).withColumn("seq", F.lit("TTTT")))
    return sq.join_adjacent(rows, "base")


_COLUMNS = """a AS (SELECT l_orderkey AS block, 'o' || l_linenumber AS org, CASE WHEN l_linenumber = 1 THEN 'A-C-' WHEN l_linenumber = 2 THEN 'AG--' ELSE 'AGC-' END AS seq FROM lineitem),
  x AS (SELECT block, org, i, substr(seq, i, 1) AS c FROM a, (SELECT unnest(range(1, 5)) AS i)), g AS (SELECT block, i, avg(CASE WHEN c = '-' THEN 1.0 ELSE 0.0 END) AS gaps, mode(c) FILTER (c <> '-') AS best FROM x GROUP BY 1, 2)"""


@register("fill_gaps", f"WITH {_COLUMNS} SELECT block, org, string_agg(CASE WHEN c = '-' AND gaps < 0.6 THEN coalesce(best, c) ELSE c END, '' ORDER BY i) AS seq FROM x JOIN g USING (block, i) WHERE gaps < 1 GROUP BY 1, 2")
def fill_gaps(spark, sf):
    return sq.fill_gaps(gapped(spark, sf), 0.6, 1.0)


def gapped(spark, sf):
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("block"), F.concat(F.lit("o"), n.cast("string")).alias("org"), F.when(n == 1, "A-C-").when(n == 2, "AG--").otherwise("AGC-").alias("seq"))


@register("reduce_gaps", f"WITH {_COLUMNS} SELECT block, org, string_agg(c, '' ORDER BY i) AS seq FROM x JOIN g USING (block, i) WHERE gaps < 0.5 GROUP BY 1, 2")
def reduce_gaps(spark, sf):
    return sq.reduce_gaps(gapped(spark, sf), 0.5)


@register("shuffled_columns", f"WITH {_COLUMNS} SELECT block, org, string_agg(c, '' ORDER BY c) AS letters FROM x GROUP BY 1, 2")
def shuffled_columns(spark, sf):
    """Columns move; each row keeps its letters and its gaps."""
    rows = sq.shuffled_columns(gapped(spark, sf))
    return rows.select("block", "org", F.array_join(F.array_sort(F.split("seq", "")), "").alias("letters"))


@register("concat_alignments", """WITH o AS (SELECT DISTINCT l_linenumber AS n FROM lineitem), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
  SELECT 'o' || n AS org, string_agg(CASE WHEN l.l_orderkey IS NULL THEN '--' ELSE 'AC' END, '' ORDER BY k) AS seq FROM o CROSS JOIN b LEFT JOIN l ON l.l_orderkey = k AND l.l_linenumber = n GROUP BY n""")
def concat_alignments(spark, sf):
    """A block for each order, a row for each line number; the result is one row an organism by its definition."""
    rows = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber").distinct().select(F.col("l_orderkey").alias("block"), F.concat(F.lit("o"), F.col("l_linenumber").cast("string")).alias("org"), F.lit("AC").alias("seq"))
    return sq.concat_alignments(rows)


@register("percent_identity", """WITH a AS (SELECT l_orderkey AS block, 'o' || l_linenumber AS org, CASE WHEN l_linenumber = 1 THEN 'A-C-' WHEN l_linenumber = 2 THEN 'AG--' ELSE 'ATC-' END AS seq FROM lineitem),
  x AS (SELECT block, org, i, substr(seq, i, 1) AS c FROM a, (SELECT unnest(range(1, 5)) AS i) WHERE substr(seq, i, 1) <> '-') SELECT p.block, p.org AS a, q.org AS b, round(avg(CASE WHEN p.c = q.c THEN 1.0 ELSE 0.0 END), 9) AS identity FROM x p JOIN x q ON p.block = q.block AND p.i = q.i AND p.org < q.org GROUP BY 1, 2, 3""")
def percent_identity(spark, sf):
    n = F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("block"), F.concat(F.lit("o"), n.cast("string")).alias("org"), F.when(n == 1, "A-C-").when(n == 2, "AG--").otherwise("ATC-").alias("seq"))
    return sq.percent_identity(rows).withColumn("identity", F.round("identity", 9))


@register("gapped_windows", f"""WITH r AS (SELECT p_partkey AS block, 'o' || p_size % 3 AS org, left(s, 2) || '-' || substr(s, 3, 2) || '--' || substr(s, 5, 1) AS seq FROM (SELECT p_partkey, p_size, {_DNA} AS s FROM part)), w AS (SELECT * FROM (VALUES (0, 2), (1, 4), (3, 5), (4, 8)) AS t(a, z))
  SELECT block, org, CAST(a AS BIGINT) AS "start", CAST(z AS BIGINT) AS "end", substr(seq, a + 1, z - a) AS seq FROM r, w""")
def gapped_windows(spark, sf):
    """Five letters of each part with gaps between them, in windows of two letters."""
    s = lambda a, n: F.substring(F.expr(_DNA), a, n)
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("block"), F.concat(F.lit("o"), (F.col("p_size") % 3).cast("string")).alias("org"), F.concat(s(1, 2), F.lit("-"), s(3, 2), F.lit("--"), s(5, 1)).alias("seq"))
    return sq.gapped_windows(rows, 2)


@register("stockholm", f"SELECT 'p' || p_partkey AS id, left(s, 10) || '-' || substr(s, 11, 9) || '--' AS seq FROM (SELECT p_partkey, {_DNA} AS s FROM part)")
def stockholm(spark, sf):
    """A report for each part, its sequence in two pieces with dots for gaps."""
    k, s = F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.expr(_DNA)
    report = F.concat(F.lit("# STOCKHOLM 1.0\n\n"), k, F.lit("  "), F.substring(s, 1, 10), F.lit(".\n#=GC x\n\n"), k, F.lit("\t"), F.substring(s, 11, 9), F.lit("..\n//"))
    return sq.read_stockholm(dl.read_lines(spark, text_folder(table(spark, sf, "part").select(report.alias("value")))))


def matrices(spark, sf):
    """A matrix of three positions for each supplier."""
    k = F.col("s_suppkey")
    cell = lambda i: F.struct(*[((k + i * j) % 4 + (1 if j == i else 0)).cast("double").alias(b) for j, b in enumerate("acgt")])
    return table(spark, sf, "supplier").select(F.concat(F.lit("m"), k.cast("string")).alias("id"), F.array(cell(1), cell(2), cell(3)).alias("weights"))


@register("matrix_round_trip", "SELECT 'm' || s_suppkey AS id, CAST(3 AS BIGINT) AS width, CAST((s_suppkey + 0) % 4 + (s_suppkey + 1) % 4 + 1 + (s_suppkey + 2) % 4 + (s_suppkey + 3) % 4 AS DOUBLE) AS first_sum FROM supplier")
def matrix_round_trip(spark, sf):
    path = text_folder(sq.matrix_records(matrices(spark, sf)).select(F.rtrim("value", F.lit("\n")).alias("value")))
    w = F.col("weights")[0]
    return src.read_matrices(spark, path).select("id", F.size("weights").cast("long").alias("width"), (w["a"] + w["c"] + w["g"] + w["t"]).alias("first_sum"))


@register("matrix_sequences", "SELECT 'm' || s_suppkey AS id, CAST(7 AS BIGINT) AS n, CAST(21 AS BIGINT) AS letters FROM supplier")
def matrix_sequences(spark, sf):
    """Each position's four counts are the four rests modulo 4 and one more, 7 in all where the step is odd."""
    odd = matrices(spark, sf).select("id", F.array(F.col("weights")[0], F.col("weights")[2], F.col("weights")[0]).alias("weights"))
    rows = sq.matrix_sequences(odd)
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.length(F.regexp_replace("seq", "n", ""))).cast("long").alias("letters"))


@register("rewrite_ids", f"SELECT 'part_' || p_partkey || '_x' AS id, {_DNA} AS seq FROM part")
def rewrite_ids(spark, sf):
    return sq.rewrite_ids(dna(spark, sf), r"^(\d+)$", "part_$1_x")


@register("keep_letters", "SELECT CAST(p_partkey AS VARCHAR) AS id, regexp_replace(p_name, '[^ACGTacgt]', '', 'g') AS seq FROM part WHERE length(regexp_replace(p_name, '[^ACGTacgt]', '', 'g')) > 3")
def keep_letters(spark, sf):
    return sq.keep_letters(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("seq")), 3)


@register("strip_utrs", "SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size % 7 <> 0 THEN 'ATGGCC' END AS cds FROM part")
def strip_utrs(spark, sf):
    """Each part's coding part behind a leader of C and G, whose length gives the frame; a seventh has a peptide that is not there."""
    leader = F.translate(F.substr(F.expr(_DNA), F.lit(1), (F.col("p_size") % 9).cast("int")), "AT", "CG")
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(leader, F.lit("ATGGCCTAA")).alias("cdna"), F.when(F.col("p_size") % 7 != 0, "MA").otherwise("MWW").alias("pep"))
    return sq.strip_utrs(rows)


@register("translated", f"SELECT CAST(p_partkey AS VARCHAR) AS id, array_to_string(list_transform(range(0, 10), lambda k: substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST((strpos('TCAG', substr(s, 3 * k + 1, 1)) - 1) * 16 + (strpos('TCAG', substr(s, 3 * k + 2, 1)) - 1) * 4 + strpos('TCAG', substr(s, 3 * k + 3, 1)) AS BIGINT), 1)), '') AS protein FROM (SELECT p_partkey, {_DNA} AS s FROM part)")
def translated(spark, sf):
    return dna(spark, sf).select("id", fs.translate_dna("seq").alias("protein"))


@register("slice_sequence", f"SELECT CAST(p_partkey AS VARCHAR) AS id, substr(s, CAST(p_size % 20 + 1 AS BIGINT), 5) AS forward, reverse(translate(substr(s, CAST(p_size % 20 + 1 AS BIGINT), 5), 'ACGT', 'TGCA')) AS minus FROM (SELECT p_partkey, p_size, {_DNA} AS s FROM part)")
def slice_sequence(spark, sf):
    start = F.col("p_size") % 20
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_size", F.expr(_DNA).alias("seq"))
    return rows.select("id", fs.slice_sequence("seq", start, start + 5).alias("forward"), fs.slice_sequence("seq", start, start + 5, F.lit("-")).alias("minus"))


@register("identity_pairs", f"SELECT a.id || '/' || b.id AS pair, CAST(len(list_filter(range(1, 33), lambda i: substr(a.s, i, 1) = substr(b.s, i, 1))) AS BIGINT) AS n FROM (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id, {_DNA} AS s FROM part) a JOIN (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id, {_DNA} AS s FROM part) b ON b.k = a.k + 1")
def identity_pairs(spark, sf):
    d = dna(spark, sf)
    b = d.select((F.col("id").cast("long") - 1).cast("string").alias("id"), F.col("id").alias("id_b"), F.col("seq").alias("seq_b"))
    return d.join(b, "id").select(F.concat_ws("/", "id", "id_b").alias("pair"), fs.identity("seq", "seq_b").alias("n"))


@register("gap_runs", "SELECT CAST(p_partkey AS VARCHAR) AS chrom, CAST(p_size AS BIGINT) AS \"start\", CAST(p_size + 3 AS BIGINT) AS \"end\" FROM part")
def gap_runs(spark, sf):
    return sq.gap_runs(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.expr("repeat('A', p_size)"), F.lit("NnN"), F.lit("C")).alias("seq")))


@register("gap_split", f"SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(i AS INTEGER) AS part, CASE WHEN i = 0 THEN {_DNA} ELSE 'ACGT' END AS seq FROM part, (SELECT unnest([0, 1]) AS i)")
def gap_split(spark, sf):
    return sq.gap_split(dna(spark, sf).withColumn("seq", F.concat("seq", F.lit("NNACGTNA"))), 2)


@register("parse_range", "SELECT p_partkey, 'chr' || p_size AS chrom, p_partkey AS \"start\", p_partkey + 10 AS \"end\" FROM part")
def parse_range(spark, sf):
    head = F.concat(F.lit("x range=chr"), F.col("p_size").cast("string"), F.lit(":"), F.col("p_partkey").cast("string"), F.lit("-"), (F.col("p_partkey") + 10).cast("string"), F.lit(" y"))
    return table(spark, sf, "part").select("p_partkey", fs.parse_range(head).alias("r")).select("p_partkey", "r.*")


_SITES = f"""s AS (SELECT CAST(p_partkey AS VARCHAR) AS id, {_DNA} AS seq FROM part), t AS (SELECT id, '+' AS strand, seq AS x FROM s UNION ALL SELECT id, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM s),
  w AS (SELECT id, strand, i, substr(x, i + 1, 4) AS m FROM t, (SELECT unnest(range(0, 29)) AS i))"""


@register("motif_hits", f"WITH {_SITES} SELECT id, CASE WHEN strand = '+' THEN i ELSE 28 - i END AS \"start\", CASE WHEN strand = '+' THEN i + 4 ELSE 32 - i END AS \"end\", m AS match, strand, 'ACRN' AS pattern FROM w WHERE regexp_full_match(m, 'AC[AG][ACGT]')")
def motif_hits(spark, sf):
    return sq.motif_hits(dna(spark, sf), ["ACRN"])


@register("conserved_words", f"WITH s AS (SELECT p_brand AS id, string_agg({_DNA}, 'N' ORDER BY p_partkey) AS seq FROM part GROUP BY 1), k AS (SELECT id, substr(seq, CAST(i AS BIGINT), 3) AS kmer FROM (SELECT id, seq, unnest(range(1, length(seq) - 1)) AS i FROM s)) SELECT kmer, count(*) AS n, count(DISTINCT id) AS n_seqs FROM k GROUP BY 1 HAVING count(DISTINCT id) = (SELECT count(*) FROM s)")
def conserved_words(spark, sf):
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.expr(_DNA).alias("s")))), lambda x: x["s"]), "N")
    return sq.conserved_words(table(spark, sf, "part").groupBy(F.col("p_brand").alias("id")).agg(joined.alias("seq")), 3)


@register("kmer_track", f"WITH s AS (SELECT CAST(p_partkey AS VARCHAR) AS id, {_DNA} AS seq FROM part), k AS (SELECT id, CAST(i AS INTEGER) AS pos, substr(seq, i + 1, 4) AS w FROM s, (SELECT unnest(range(0, 29)) AS i)), n AS (SELECT least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS c, * FROM k), c AS (SELECT c, count(*) AS n FROM n GROUP BY 1) SELECT id, pos, least(c.n, 50) AS n FROM n JOIN c USING (c)")
def kmer_track(spark, sf):
    d = dna(spark, sf)
    return sq.kmer_track(d, sq.kmer_counts(d, 4, True).select("kmer", "n"), 4, 50)


@register("alignment_consensus", f"WITH {_COLUMNS}, n AS (SELECT block, i, c, count(*) AS n FROM x GROUP BY 1, 2, 3), b AS (SELECT block, i, arg_min(c, (-n, c)) AS c, max(n) AS m, sum(n) AS t FROM n GROUP BY 1, 2) SELECT block, string_agg(CASE WHEN m >= 0.6 * t THEN c ELSE 'N' END, '' ORDER BY i) AS seq FROM b GROUP BY 1")
def alignment_consensus(spark, sf):
    return sq.consensus(gapped(spark, sf), 0.6)


# -- features and tracks --------------------------------------------------------------------------------------------------


@register("gff_round_trip", f"""WITH {_ITEMS} SELECT chrom, "start", "end", 'feature' AS name, 0 AS score, strand FROM items""")
def gff_round_trip(spark, sf):
    return src.gff_to_bed(src.bed_to_gff(items(spark, sf).withColumn("score", F.lit("x"))))


@register("gff3_attributes", "SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS line, l_shipmode AS mode FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem) WHERE l_linenumber > 1")
def gff3_attributes(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.lit(2).alias("start"), (F.col("l_linenumber")).alias("end"), F.concat(F.lit("line="), F.col("l_linenumber").cast("string"), F.lit(";mode="), F.col("l_returnflag")).alias("attributes"))
    return src.gff3_attributes(rows).select("l_orderkey", F.col("attr")["line"].alias("line"), F.col("attr")["mode"].alias("mode"))


@register("sam_to_bed", "SELECT 'c' || l_suppkey AS chrom, l_partkey AS \"start\", l_partkey + 10 + l_linenumber AS \"end\", CAST(l_orderkey AS VARCHAR) AS name, 10 AS score, CASE WHEN l_linenumber % 2 = 1 THEN '-' ELSE '+' END AS strand FROM lineitem")
def sam_to_bed(spark, sf):
    n = F.col("l_linenumber")
    sam = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("qName"), F.when(n % 2 == 1, 16).otherwise(0).alias("flag"), F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("rName"), (F.col("l_partkey") + 1).alias("pos"), F.concat(F.lit("4M"), n.cast("string"), F.lit("D2I6M3S")).alias("cigar"))
    return src.sam_to_bed(sam)


@register("blast_to_bed", "SELECT 't' || l_suppkey AS chrom, l_partkey AS \"start\", l_partkey + 30 AS \"end\", 'q' || l_orderkey AS name, l_linenumber AS score, CASE WHEN l_linenumber % 2 = 1 THEN '-' ELSE '+' END AS strand FROM lineitem")
def blast_to_bed(spark, sf):
    n = F.col("l_linenumber")
    low, high = F.col("l_partkey") + 1, F.col("l_partkey") + 30
    return src.blast_to_bed(table(spark, sf, "lineitem").select(F.concat(F.lit("q"), F.col("l_orderkey").cast("string")).alias("qName"), F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("tName"), F.when(n % 2 == 1, high).otherwise(low).alias("tStart"), F.when(n % 2 == 1, low).otherwise(high).alias("tEnd"), n.alias("alnScore")))


@register("report_hits", """SELECT 'q' || p_partkey AS query, 't' || n AS target, CAST(p_size + n AS DOUBLE) + 0.5 AS score, CASE n WHEN 1 THEN 1e-5 ELSE 1e-30 END AS e_value, round(100.0 * p_size / (p_size + n), 6) AS identity, CAST(p_size + n AS BIGINT) AS length FROM part, (SELECT unnest([1, 2]) AS n)""")
def report_hits(spark, sf):
    """A report for each part: a query with two targets."""
    size = F.col("p_size").cast("long")
    text = lambda c: c.cast("string")
    hit = lambda n, e: F.concat(F.lit(f"> t{n} some name\n Score = "), text(size + n), F.lit(f".5 bits (9), Expect = {e}\n Identities = "), text(size), F.lit("/"), text(size + n), F.lit(" (x%)\n"))
    report = F.concat(F.lit("Query= q"), text(F.col("p_partkey")), F.lit(" some words\n\n"), hit(1, "1e-5"), hit(2, "e-30"))
    lines = dl.read_lines(spark, text_folder(table(spark, sf, "part").select(report.alias("value"))))
    return tx.report_hits(lines).withColumn("identity", F.round("identity", 6))


@register("element_rows", """SELECT l_linestatus AS chrom, l_orderkey AS "start", l_orderkey + 9 AS "end", 'e' || l_linenumber AS name, l_linenumber + 40 AS score, '+' AS strand FROM lineitem""")
def element_rows(spark, sf):
    """A line of a report for each line item, with a line that is none before and behind it."""
    text = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit("conserved elements\ne"), text("l_linenumber"), F.lit(" "), F.col("l_linestatus"), F.lit(" "), text("l_orderkey"), F.lit(" "), (F.col("l_orderkey") + 9).cast("string"), F.lit(" x "), (F.col("l_linenumber") + 40).cast("string"), F.lit(".2 0.01\ntotal 2"))
    out = tx.element_rows(dl.read_lines(spark, text_folder(table(spark, sf, "lineitem").select(line.alias("value")))))
    return out.withColumn("score", F.col("score").cast("long"))


@register("fixed_steps", "SELECT 'c' || o_orderkey AS chrom, o_custkey - 1 + n * (1 + o_orderkey % 4) AS pos, CAST(o_orderkey % 100 AS DOUBLE) + n AS value FROM orders, (SELECT unnest([0, 1, 2]) AS n)")
def fixed_steps(spark, sf):
    """Three steps for each order."""
    k = F.col("o_orderkey")
    values = [F.concat(F.lit("\n"), (k % 100 + n).cast("string"), F.lit(".0")) for n in range(3)]
    block = F.concat(F.lit("track x\nfixedStep chrom=c"), k.cast("string"), F.lit(" start="), F.col("o_custkey").cast("string"), F.lit(" step="), (1 + k % 4).cast("string"), *values)
    return src.fixed_steps(dl.read_lines(spark, text_folder(table(spark, sf, "orders").select(block.alias("value")))))


@register("split_occurrences", "SELECT l_orderkey, l_linenumber, p AS project, p || '|1|2|0.5' AS occurrence FROM lineitem, (SELECT unnest(['A', 'B']) AS p) WHERE l_linenumber % 2 = 0")
def split_occurrences(spark, sf):
    info = F.when(F.col("l_linenumber") % 2 == 0, "X=1;OCCURRENCE=A|1|2|0.5,B|1|2|0.5;Y").otherwise("X=1")
    return src.split_occurrences(table(spark, sf, "lineitem", "l_orderkey", "l_linenumber").withColumn("info", info)).drop("info")


@register("indels_or_snps", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 3 = 0")
def indels_or_snps(spark, sf):
    rows = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber").withColumn("ref", F.lit("A")).withColumn("alt", F.when(F.col("l_linenumber") % 3 == 0, "G").otherwise("GT"))
    return src.indels_or_snps(rows, True).select("l_orderkey", "l_linenumber")


@register("match_to_bed", "SELECT 'c' || l_suppkey AS chrom, l_partkey AS \"start\", l_partkey + 8 AS \"end\", 'm' || l_linenumber AS name, l_partkey + 2 AS thick_start, l_partkey + 6 AS thick_end FROM lineitem")
def match_to_bed(spark, sf):
    return src.match_to_bed(table(spark, sf, "lineitem").select(F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("chrom"), F.col("l_partkey").alias("start"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("name"), F.lit("acGTTCac").alias("site")))


@register("rewrite_names", f"""WITH {_SPANS} SELECT chrom, "start", "end", 'order-' || substr(name, 2) || '!' AS name FROM spans""")
def rewrite_names(spark, sf):
    return iv.rewrite_names(spans(spark, sf), r"^o(\d+)$", "order-$1!")


@register("with_length", f"""WITH {_SPANS} SELECT name, "end" - "start" AS length FROM spans WHERE "end" - "start" > 10""")
def with_length(spark, sf):
    return iv.with_length(spans(spark, sf), 10).select("name", "length")


@register("move_by_name", f"""WITH {_SPANS} SELECT name, "start" + CASE WHEN "start" % 2 = 0 THEN 100 ELSE 0 END AS "start" FROM spans""")
def move_by_name(spark, sf):
    s = spans(spark, sf)
    return iv.move_by_name(s, s.where("start % 2 = 0").select(F.col("name").alias("key"), F.lit(100).alias("value"))).select("name", "start")


@register("number_records", f"""WITH {_SPANS} SELECT name || '.' || row_number() OVER (ORDER BY chrom, "start") AS name FROM spans""")
def number_records(spark, sf):
    return rk.global_rank(spans(spark, sf), [F.col("chrom"), F.col("start")], "n").select(F.concat_ws(".", "name", F.col("n").cast("string")).alias("name"))


@register("feature_distances", f"""WITH {_SPANS} SELECT * FROM (SELECT name, lead("start") OVER (PARTITION BY chrom ORDER BY "start", "end", name) - "end" AS distance FROM spans) WHERE distance IS NOT NULL""")
def feature_distances(spark, sf):
    nxt = iv.suffix_min(spans(spark, sf), F.col("start"), ["start", "end", "name"], "next", False)
    return nxt.where("next is not null").select("name", (F.col("next") - F.col("end")).alias("distance"))


@register("trim_blocks", "SELECT l_orderkey, l_linenumber, [0, 10, 18] AS block_starts, [10, 8, l_linenumber + 5] AS block_sizes FROM lineitem")
def trim_blocks(spark, sf):
    """Blocks 0-10, 5-18, 8-17 and 12-(23 + n): the second and last are cut, the third goes."""
    rows = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber").withColumn("block_starts", F.array(*map(F.lit, (0, 5, 8, 12)))).withColumn("block_sizes", F.array(F.lit(10), F.lit(13), F.lit(9), F.col("l_linenumber") + 11))
    return iv.trim_blocks(rows)


@register("exon_blocks", "SELECT l_orderkey, l_linenumber, b AS \"start\", b + 2 AS \"end\" FROM (SELECT l_orderkey, l_linenumber, unnest([l_orderkey * 10 + 0, l_orderkey * 10 + 4]) AS b FROM lineitem) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey * 10 + o_orderkey % 3 * 3 < b + 2 AND b < o_orderkey * 10 + o_orderkey % 3 * 3 + 1)")
def exon_blocks(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.lit("c").alias("chrom"), (F.col("l_orderkey") * 10).alias("start"), F.array(F.lit(0), F.lit(4)).alias("block_starts"), F.array(F.lit(2), F.lit(2)).alias("block_sizes"), "l_orderkey", "l_linenumber")
    place = F.col("o_orderkey") * 10 + F.col("o_orderkey") % 3 * 3
    other = table(spark, sf, "orders").select(F.lit("c").alias("chrom"), place.alias("start"), (place + 1).alias("end"))
    return iv.exon_blocks_without(rows, other, "l_orderkey", "l_linenumber").drop("chrom")


@register("same_name_cover", """WITH s AS (SELECT o_orderstatus AS chrom, o_orderkey AS "start", o_orderkey + 5 AS "end", o_orderpriority AS name FROM orders), n AS (SELECT *, CASE WHEN lag(name) OVER w = name THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY chrom ORDER BY "start")),
  r AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY "start") AS run FROM n) SELECT chrom, name, min("start") AS "start", max("end") AS "end", count(*) AS n FROM r GROUP BY chrom, run, name""")
def same_name_cover(spark, sf):
    return iv.same_name_cover(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("chrom"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 5).alias("end"), F.col("o_orderpriority").alias("name")))


def _runs(test: str) -> str:
    return f"""a AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY "start", "end", name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
  i AS (SELECT *, sum(CASE WHEN reach IS NULL OR {test} THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY "start", "end", name) AS island FROM a)"""


@register("collapse_overlaps", f"""WITH {_ROOMY_SPANS}, {_runs('"start" - reach >= 0')} SELECT chrom, min("start") AS "start", max("end") AS "end", arg_min(name, ("start", "end", name)) AS name FROM i GROUP BY chrom, island""")
def collapse_overlaps(spark, sf):
    return iv.collapse_overlaps(roomy_spans(spark, sf))


@register("chain_hits", f"""WITH {_ROOMY_SPANS}, {_runs('"start" - reach > 6')} SELECT chrom, min("start") AS "start", max("end") AS "end", count(*) AS n FROM i GROUP BY chrom, island""")
def chain_hits(spark, sf):
    return iv.chain_hits(roomy_spans(spark, sf), 6).groupBy("chrom", "chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("chain")


@register("next_feature", f"""WITH {_ROOMY_SPANS}, {_SPOTS}, b AS (SELECT chrom, "start" AS at, min(name) AS gene FROM spots GROUP BY 1, 2) SELECT r.name, b.at AS next_start, b.gene AS next_name FROM spans r ASOF LEFT JOIN b ON r.chrom = b.chrom AND r."end" <= b.at""")
def next_feature(spark, sf):
    return iv.next_of(roomy_spans(spark, sf), spots(spark, sf)).select("name", "next_start", "next_name")


_NEAR = f"""{_ROOMY_SPANS}, {_SPOTS}, e AS (SELECT chrom, "end" AS at, max(name) AS gene FROM spots GROUP BY 1, 2), b AS (SELECT chrom, "start" AS at, min(name) AS gene FROM spots GROUP BY 1, 2),
  n AS (SELECT r.name, e.gene AS lg, r."start" - e.at AS ld, b.gene AS rg, b.at - r."end" AS rd FROM spans r ASOF LEFT JOIN e ON r.chrom = e.chrom AND r."start" >= e.at ASOF LEFT JOIN b ON r.chrom = b.chrom AND r."end" <= b.at)"""


@register("closest_genes", f"""WITH {_NEAR} SELECT name, coalesce(CASE WHEN coalesce(ld, 1000000) < coalesce(rd, 1000000) THEN CASE WHEN ld < 6 THEN lg END ELSE CASE WHEN rd < 6 THEN rg END END, '') AS genes FROM n""")
def closest_genes(spark, sf):
    near = iv.nearest_neighbours(roomy_spans(spark, sf), spots(spark, sf))
    return iv.closest_genes(near, "closest", 6).select("name", F.array_join("genes", ",").alias("genes"))


@register("same_features", """SELECT o_orderkey FROM orders WHERE o_orderkey % 4 < 2""")
def same_features(spark, sf):
    o = table(spark, sf, "orders").select(F.lit("c").alias("chrom"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 1).alias("end"), "o_orderkey", F.concat(F.lit("x/y"), (F.col("o_orderkey") % 4).cast("string")).alias("name"))
    other = o.select("chrom", "start", "end", F.when(F.col("o_orderkey") % 4 < 2, F.concat(F.lit("y"), (F.col("o_orderkey") % 4).cast("string"), F.lit("/z"))).otherwise("w").alias("name"))
    return iv.same_features(o, other).select("o_orderkey")


@register("window_names", f"""WITH {_SPANS}, p AS (SELECT chrom, name, unnest(range(CAST(floor(("start" - 50) / 10) AS BIGINT) + 1, CAST(floor("start" / 10) AS BIGINT) + 1)) * 10 AS pos FROM spans) SELECT chrom, pos, count(DISTINCT name) AS n FROM p WHERE pos >= 0 GROUP BY 1, 2""")
def window_names(spark, sf):
    return iv.window_counts(spans(spark, sf), 50, 10, names=True)


@register("window_density", f"""WITH {_SPANS}, p AS (SELECT chrom, unnest(range("start" - 6, "start" + 1)) AS pos FROM spans) SELECT chrom, pos, count(*) AS n FROM p WHERE pos >= 0 GROUP BY 1, 2""")
def window_density(spark, sf):
    return iv.window_counts(spans(spark, sf), 7)


_NAMED = """f AS (SELECT o_orderstatus AS chrom, o_orderkey * 3 AS "start", o_orderkey * 3 + 2 AS "end", CASE o_orderkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END AS name FROM orders)"""


def named(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(F.col("o_orderstatus").alias("chrom"), (k * 3).alias("start"), (k * 3 + 2).alias("end"), F.when(k % 5 == 0, "a").when(k % 5 == 1, "b").when(k % 5 == 2, "c").otherwise("d").alias("name"))


@register("pair_clusters", f"""WITH {_NAMED} SELECT DISTINCT x.chrom, x."start", y."end" FROM f x JOIN f y ON x.chrom = y.chrom AND y."start" BETWEEN x."end" AND x."end" + 20 AND ((x.name = 'a' AND y.name = 'b') OR (x.name = 'b' AND y.name = 'a'))""")
def pair_clusters(spark, sf):
    return iv.named_clusters(named(spark, sf), "a", "b", 20, both_ways=True)


@register("triple_clusters", f"""WITH {_NAMED} SELECT DISTINCT x.chrom, x."start", z."end" FROM f x JOIN f y ON x.chrom = y.chrom AND y."start" BETWEEN x."end" AND x."end" + 20 JOIN f z ON z.chrom = y.chrom AND z."start" BETWEEN y."end" AND y."end" + 20 WHERE x.name = 'a' AND y.name = 'b' AND z.name = 'c'""")
def triple_clusters(spark, sf):
    return iv.named_clusters(named(spark, sf), "a", "b", 20, "c")


@register("word_windows", f"""WITH {_NAMED}, w AS (SELECT chrom, "start", max("end") OVER v AS "end", count(*) FILTER (name = 'a') OVER v AS na, count(*) FILTER (name = 'b') OVER v AS nb FROM f WHERE name IN ('a', 'b') WINDOW v AS (PARTITION BY chrom ORDER BY "start" RANGE BETWEEN CURRENT ROW AND 29 FOLLOWING)) SELECT DISTINCT chrom, "start", "end" FROM w WHERE na >= 2 AND nb >= 1""")
def word_windows(spark, sf):
    return sq.word_windows(named(spark, sf), {"a": 2, "b": 1}, 30)


@register("spacer_shuffle", f"""WITH {_ROOMY_SPANS}, r AS (SELECT *, coalesce(max("end") OVER (PARTITION BY chrom ORDER BY "start", "end", name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM spans)
  SELECT chrom, count(*) AS n, CAST(sum("end" - "start") AS BIGINT) AS bp, CAST(sum("end" - "start" + greatest("start" - reach, 0)) AS BIGINT) AS last FROM r GROUP BY 1""")
def spacer_shuffle(spark, sf):
    """What a shuffle keeps: the number and length of the features, and where the last one ends."""
    return iv.spacer_shuffle(roomy_spans(spark, sf)).groupBy("chrom").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bp"), F.max("end").alias("last"))


@register("overlap_significance", f"""WITH {_ROOMY_SPANS}, {_SPOTS}, d AS (SELECT DISTINCT chrom, "start" AS s FROM spots), a AS (SELECT p.chrom, p."start" AS s, p."end" AS e, p.name, count(d.s) AS bp FROM spans p LEFT JOIN d ON d.chrom = p.chrom AND d.s >= p."start" AND d.s < p."end" GROUP BY 1, 2, 3, 4),
  x AS (SELECT chrom, max("end") AS reach FROM (SELECT chrom, "end" FROM spans UNION ALL SELECT chrom, "end" FROM spots) GROUP BY 1), g AS (SELECT (SELECT count(*) FROM d) * 1.0 / (SELECT sum(reach) FROM x) AS p)
  SELECT count(*) FILTER (bp > 0) AS overlaps, CAST(sum(bp) AS BIGINT) AS bp, 40 AS rounds, CAST(sum(e - s) AS BIGINT) * any_value(p) >= sum(bp) AS below FROM a, g""")
def overlap_significance(spark, sf):
    """Against 40 shuffled tracks in one plan. Their own counts depend on the seed; the tails say on what side of the expected overlap it lies."""
    out = iv.overlap_significance(roomy_spans(spark, sf), spots(spark, sf), 40)
    sound = (F.col("p") * 41 == F.col("as_many") + 1) & (F.col("p_bp") * 41 == F.col("as_much") + 1) & F.col("poisson_p").between(0, 1)
    return out.where(sound).select("overlaps", "bp", F.col("rounds").cast("int").alias("rounds"), (F.col("binomial_p") > 0.45).alias("below"))


@register("paired_ends", """WITH h AS (SELECT l_orderkey AS clone, CASE WHEN l_linenumber % 2 = 0 THEN 'F' ELSE 'R' END AS side, l_returnflag AS chrom, l_partkey AS s, l_partkey + 10 AS e, l_linestatus AS strand FROM lineitem)
  SELECT DISTINCT f.clone, f.chrom, least(f.s, r.s) AS "start", greatest(f.e, r.e) AS "end" FROM h f JOIN h r ON f.clone = r.clone AND f.chrom = r.chrom AND f.side = 'F' AND r.side = 'R' AND f.strand <> r.strand WHERE greatest(f.e, r.e) - least(f.s, r.s) BETWEEN 20 AND 5000""")
def paired_ends(spark, sf):
    hits = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("clone"), F.when(F.col("l_linenumber") % 2 == 0, "F").otherwise("R").alias("side"), F.col("l_returnflag").alias("chrom"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 10).alias("end"), F.col("l_linestatus").alias("strand"))
    return iv.paired_ends(hits, 20, 5000)


@register("region_classes", f"""WITH {_ROOMY_SPANS}, {_SPOTS}, c AS (SELECT *, CASE WHEN name LIKE '%_1' THEN 'first' ELSE 'even' END AS class FROM spots WHERE name LIKE '%_1' OR regexp_matches(name, '_[246]$')),
  h AS (SELECT class, sum(b."end" - b."start") AS bp FROM spans a JOIN c b ON a.chrom = b.chrom AND b."start" >= a."start" AND b."start" < a."end" GROUP BY 1), o AS (SELECT class, sum("end" - "start") AS class_bp FROM c GROUP BY 1), t AS (SELECT CAST(sum("end" - "start") AS DOUBLE) AS all_bp FROM spans)
  SELECT class, CAST(coalesce(bp, 0) AS BIGINT) AS bp, round(coalesce(bp, 0) / all_bp, 9) AS share, round((coalesce(bp, 0) / all_bp) / (class_bp / 1000000.0), 6) AS ratio FROM o LEFT JOIN h USING (class), t""")
def region_classes(spark, sf):
    out = iv.region_classes(roomy_spans(spark, sf), spots(spark, sf), {"first": "_1$", "even": "_[246]$"}, 1_000_000)
    return out.withColumn("share", F.round("share", 9)).withColumn("ratio", F.round("ratio", 6))


@register("packed_rows", f"""WITH {_SPANS}, e AS (SELECT chrom, "start" AS pos, 1 AS change FROM spans UNION ALL SELECT chrom, "end", -1 FROM spans), l AS (SELECT chrom, sum(change) OVER (PARTITION BY chrom ORDER BY pos, change) AS n FROM e)
  SELECT chrom, n, depth FROM (SELECT chrom, count(*) AS n FROM spans GROUP BY 1) JOIN (SELECT chrom, CAST(max(n) AS BIGINT) AS depth FROM l GROUP BY 1) USING (chrom)""")
def packed_rows(spark, sf):
    """Display rows: as many as features lie over one place, and within each no two overlap, so those that do not count all features."""
    rows = iv.packed_rows(spans(spark, sf))
    before = iv.prefix_max(rows.withColumn("lane", F.concat_ws(" ", "chrom", F.col("row").cast("string"))), F.col("end"), ["start", "end", "name"], "reach", False, by="lane")
    return before.where(F.coalesce(F.col("reach") <= F.col("start"), F.lit(True))).groupBy("chrom").agg(F.count("*").alias("n"), (F.max("row") + 1).alias("depth"))


@register("lift_features", f"""WITH {_SPANS}, h AS (SELECT o_orderstatus AS chrom, o_orderkey AS s, o_orderkey + 3 AS e, o_orderkey + 1000 + o_orderkey % 3 AS t, o_orderkey % 7 AS score FROM orders),
  b AS (SELECT a.chrom, a."start", a."end", a.name, arg_max(h.t - h.s, (h.score, h.t, h.s)) AS shift FROM spans a JOIN h ON a.chrom = h.chrom AND a."start" < h.e AND h.s < a."end" GROUP BY 1, 2, 3, 4) SELECT 'new' AS chrom, "start" + shift AS "start", "end" + shift AS "end", name FROM b UNION ALL SELECT 'new', "start" + shift, "end" + shift, name FROM b""")
def lift_features(spark, sf):
    """Every order twice: copies of a feature stay copies."""
    hits = spans(spark, sf).select("chrom", "start", (F.col("start") + 3).alias("end"), F.lit("new").alias("to_chrom"), (F.col("start") + 1000 + F.col("start") % 3).alias("to_start"), (F.col("start") % 7).alias("score"))
    return iv.lift_features(spans(spark, sf).unionAll(spans(spark, sf)), hits)


@register("region_members", f"""WITH {_SPANS} SELECT name, count(*) OVER (PARTITION BY chrom, "start" // 100) - 1 AS n_others FROM spans""")
def region_members(spark, sf):
    """Each feature with the number of the others of its cluster, which is a stretch of 100 positions."""
    s = spans(spark, sf).withColumn("cluster", F.floor(F.col("start") / 100))
    return s.join(s.groupBy("chrom", "cluster").agg((F.count("*") - 1).alias("n_others")), ["chrom", "cluster"]).select("name", "n_others")


@register("from_closed", f"""WITH {_SPANS} SELECT name, "start", "end" + 1 AS "end" FROM spans""")
def from_closed(spark, sf):
    a, b = iv.from_closed(F.col("start"), F.col("end"))
    return spans(spark, sf).select("name", a.alias("start"), b.alias("end"))


@register("join_line_blocks", """WITH s AS (SELECT l_linestatus AS chrom, CAST(l_orderkey AS VARCHAR) AS name, l_linenumber * 10 AS "start", l_linenumber * 10 + 5 AS "end" FROM lineitem)
  SELECT chrom, name, min("start") AS "start", max("end") AS "end" FROM (SELECT *, sum(new) OVER (PARTITION BY chrom, name ORDER BY "start") AS run FROM (SELECT *, CASE WHEN lag("end") OVER (PARTITION BY chrom, name ORDER BY "start") >= "start" - 10 THEN 0 ELSE 1 END AS new FROM s)) GROUP BY chrom, name, run""")
def join_line_blocks(spark, sf):
    n = F.col("l_linenumber")
    return iv.join_blocks(table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("chrom"), F.col("l_orderkey").cast("string").alias("name"), (n * 10).alias("start"), (n * 10 + 5).alias("end")), 10).select("chrom", "name", "start", "end")


# -- word blocks ---------------------------------------------------------------------------------------------------------


def word_blocks(spark, sf):
    """A block for each order, with a word for each line."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("W"), F.col("l_returnflag")).alias("word"), F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise("+").alias("strand"))
    hits = l.groupBy("l_orderkey", "word").agg(F.array_sort(F.collect_list(F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), "strand"))).alias("hits"))
    words = hits.groupBy("l_orderkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "hits")))).alias("words"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_custkey")
    met = o.join(words, "l_orderkey")
    return met.select(F.col("l_orderkey").alias("block"), F.col("o_orderstatus").alias("chrom"), (F.col("l_orderkey") * 10).alias("start"), (F.col("l_orderkey") * 10 + 9).alias("end"), (F.col("l_orderkey") % 8).cast("double").alias("score"), F.array(F.concat(F.lit("g"), (F.col("o_custkey") % 50).cast("string")), F.lit("h")).alias("genes"), "words")


_BLOCKS = """w AS (SELECT l_orderkey AS block, 'W' || l_returnflag AS motif, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand FROM lineitem),
  b AS (SELECT o_orderkey AS block, o_orderstatus AS chrom, o_orderkey * 10 AS "start", o_orderkey * 10 + 9 AS "end", CAST(o_orderkey % 8 AS DOUBLE) AS score, 'g' || o_custkey % 50 AS gene FROM orders WHERE o_orderkey IN (SELECT block FROM w)),
  g AS (SELECT block, gene FROM b UNION ALL SELECT block, 'h' FROM b)"""


@register("word_motifs", f"SELECT left({_DNA}, 6) AS motif, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS description FROM part")
def word_motifs(spark, sf):
    """A motif line for each part, half of them with a description, among other lines."""
    line = F.concat(F.lit("##words\nm\t"), F.lower(F.substring(F.expr(_DNA), 1, 6)), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\t"), "p_brand")).otherwise(""), F.lit("\nb\tchr1\t1\t2"))
    return wd.read_motifs(dl.read_lines(spark, text_folder(table(spark, sf, "part").select(line.alias("value")))))


@register("word_blocks", f"""WITH {_BLOCKS} SELECT block, chrom, "start", "end", score, gene || ',h' AS genes, count(*) AS n_hits, count(DISTINCT motif) AS n_words FROM b JOIN w USING (block) GROUP BY ALL""")
def word_blocks_round_trip(spark, sf):
    path = text_folder(wd.block_text(word_blocks(spark, sf)))
    hits = F.aggregate(F.map_values("words"), F.lit(0).cast("long"), lambda acc, x: acc + F.size(x))
    return wd.read_blocks(spark, path).select("block", "chrom", "start", "end", "score", F.array_join("genes", ",").alias("genes"), hits.alias("n_hits"), F.size("words").cast("long").alias("n_words"))


@register("word_postings", f"WITH {_BLOCKS} SELECT motif, block, count(*) AS n FROM w JOIN b USING (block) GROUP BY 1, 2")
def word_postings(spark, sf):
    return wd.postings(word_blocks(spark, sf))[0]


@register("word_filter", f"WITH {_BLOCKS} SELECT block, count(*) AS n_words FROM (SELECT block, motif FROM w JOIN b USING (block) GROUP BY 1, 2 HAVING count(*) >= 2 AND motif IN ('WN', 'WR')) GROUP BY 1")
def word_filter(spark, sf):
    return wd.filter_words(word_blocks(spark, sf), 2, ["WN", "WR"]).select("block", F.size("words").cast("long").alias("n_words"))


@register("block_filter", f"WITH {_BLOCKS} SELECT block FROM b WHERE score BETWEEN 2 AND 5 AND chrom = 'F' AND gene IN ('g1', 'g2', 'g3')")
def block_filter(spark, sf):
    genes = spark.createDataFrame([("g1",), ("g2",), ("g3",)], "gene string")
    return wd.filter_blocks(word_blocks(spark, sf), 2, 5, "F", genes).select("block")


@register("gene_scores", f"WITH {_BLOCKS} SELECT gene, sum(score) AS score FROM g JOIN (SELECT block, score FROM b) USING (block) GROUP BY 1")
def gene_scores(spark, sf):
    return wd.gene_scores(word_blocks(spark, sf))


@register("gene_lengths", f"""WITH {_BLOCKS} SELECT 't' || CAST(substr(gene, 2) AS BIGINT) % 3 AS tissue, gene, CAST(sum(9) AS BIGINT) AS bp FROM b GROUP BY 1, 2""")
def gene_lengths(spark, sf):
    tissues = spark.range(50).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("gene"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("tissue"))
    return wd.gene_lengths(word_blocks(spark, sf), tissues)


@register("gene_words", f"WITH {_BLOCKS} SELECT gene, motif, count(*) AS n FROM g JOIN w USING (block) GROUP BY 1, 2 HAVING count(*) >= 3")
def gene_words(spark, sf):
    return wd.gene_words(word_blocks(spark, sf), 3)


@register("words_to_bed", f"""WITH {_BLOCKS} SELECT chrom, pos AS "start", pos + 2 AS "end", motif AS name, CAST(score AS INTEGER) AS score, strand FROM w JOIN b USING (block)""")
def words_to_bed(spark, sf):
    return wd.words_to_bed(word_blocks(spark, sf))


@register("word_combinations", f"WITH {_BLOCKS} SELECT block, CAST(count(DISTINCT motif) FILTER (motif IN ('WA', 'WN')) = 2 AS INTEGER) AS a_and_n, CAST(bool_or(motif = 'WR') AS INTEGER) AS r FROM w JOIN b USING (block) GROUP BY 1")
def word_combinations(spark, sf):
    return wd.combination_matrix(word_blocks(spark, sf), {"a_and_n": ["WA", "WN"], "r": ["WR"]})


@register("word_search", f"WITH {_BLOCKS} SELECT gene, sum(score) AS score FROM g JOIN (SELECT block, score FROM b) USING (block) WHERE block IN (SELECT block FROM w WHERE motif = 'WA' GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1")
def word_search(spark, sf):
    return wd.gene_scores(wd.with_combination(word_blocks(spark, sf), ["WA"], 2).where("found"))


@register("block_sequences", f"""WITH {_BLOCKS} SELECT gene, 'org' AS org, string_agg('S' || block % 3, 'NN' ORDER BY chrom, "start") AS seq FROM b GROUP BY 1""")
def block_sequences(spark, sf):
    blocks = word_blocks(spark, sf).withColumn("genes", F.slice("genes", 1, 1))
    rows = blocks.select("chrom", "start", F.lit("org").alias("org"), F.concat(F.lit("S"), (F.col("block") % 3).cast("string")).alias("seq"))
    return wd.block_sequences(blocks, rows, "NN")


# -- tables, sets, statistics ------------------------------------------------------------------------------------------------


@register("drop_columns", "SELECT n_nationkey, n_name FROM nation")
def drop_columns(spark, sf):
    return tb.drop_columns(table(spark, sf, "nation"), -1)


@register("swap_first_two", "SELECT n_name, n_nationkey, n_regionkey FROM nation")
def swap_first_two(spark, sf):
    return tb.swap_first_two(table(spark, sf, "nation"))


@register("transpose_head", "SELECT 'r_regionkey' AS field, '0' AS row_1, '1' AS row_2 UNION ALL SELECT 'r_name', (SELECT r_name FROM region WHERE r_regionkey = 0), (SELECT r_name FROM region WHERE r_regionkey = 1)")
def transpose_head(spark, sf):
    return tb.transpose_head(table(spark, sf, "region", "r_regionkey", "r_name"), ["r_regionkey"], 2)


@register("field_errors", "SELECT count(*) AS n_lines, count(*) FILTER (p_size % 5 = 0) AS n_bad FROM part")
def field_errors(spark, sf):
    line = F.when(F.col("p_size") % 5 == 0, "a\tb").otherwise("a\tb\tc")
    return tb.field_errors(table(spark, sf, "part").select(line.alias("line")), "line", 3)


@register("token_overlap", "SELECT p_partkey FROM part WHERE p_size % 4 IN (1, 2)")
def token_overlap(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("x=q,t"), (F.col("p_size") % 4).cast("string")).alias("name"))
    return tb.token_overlap(rows, "name", ["t1", "t2"]).select("p_partkey")


@register("prefix_pairs", "SELECT a.o_orderkey AS left_key, b.o_orderkey AS right_key FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderkey % 2 = 0")
def prefix_pairs(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("n"), F.col("o_orderkey").cast("string"), F.lit("_x")).alias("name"))
    pairs = o.where("o_orderkey % 2 = 0").select(F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("a"), F.concat(F.lit("n"), (F.col("o_orderkey") + 1).cast("string")).alias("b"))
    return tb.prefix_pairs(o, o, pairs, "name").select(F.col("left_row.o_orderkey").alias("left_key"), F.col("right_row.o_orderkey").alias("right_key"))


@register("same_gene", "SELECT n_nationkey, r_name, left(r_name, 2) AS short FROM nation JOIN region ON n_regionkey = r_regionkey")
def same_gene(spark, sf):
    region = table(spark, sf, "region")
    first = region.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    second = region.select(F.col("r_name").alias("key"), F.substring("r_name", 1, 2).alias("value"))
    return tb.two_hop(table(spark, sf, "nation", "n_nationkey", "n_regionkey"), "n_regionkey", first, second, ("r_name", "short")).drop("n_regionkey")


@register("sort_table", "SELECT CAST(max(p_size) AS BIGINT) AS top, count(*) AS n FROM (SELECT DISTINCT p_size FROM part)")
def sort_table(spark, sf):
    """Sorted by size, largest first, one row a size; the first row and the number of rows."""
    rows = tb.sort_table(table(spark, sf, "part", "p_partkey", "p_size"), "p_size", "int", reverse=True, unique=True)
    return rk.global_rank(rows, [F.desc("p_size")], "at").agg(F.max(F.when(F.col("at") == 1, F.col("p_size"))).cast("long").alias("top"), F.count("*").alias("n"))


@register("sort_unique", "SELECT p_size, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def sort_unique(spark, sf):
    return tb.sort_table(table(spark, sf, "part", "p_partkey", "p_size"), "p_size", "int", unique=True)


@register("sorted_groups", "SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def sorted_groups(spark, sf):
    rows = tb.sorted_groups(table(spark, sf, "orders", "o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"])
    return rows.select("o_custkey", F.array_join(F.transform("rows", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@register("unsorted_places", "SELECT o_orderkey FROM (SELECT o_orderkey, o_custkey, max(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM orders) WHERE o_custkey < m")
def unsorted_places(spark, sf):
    return tb.unsorted_places(table(spark, sf, "orders", "o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 1000).select("o_orderkey")


@register("concat_frames", "SELECT r_regionkey AS key, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def concat_frames(spark, sf):
    return tb.concat_frames([table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), table(spark, sf, "nation", "n_nationkey", "n_name")])


@register("key_index", "SELECT CAST(k AS VARCHAR) AS key, count(*) AS n, string_agg(DISTINCT s, ',' ORDER BY s) AS sources FROM (SELECT c_nationkey AS k, 'c' AS s FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier) GROUP BY 1")
def key_index(spark, sf):
    return tb.key_index({"c": table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), "s": table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))}, "k")


@register("union_keys", "SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier")
def union_keys(spark, sf):
    return tb.union_keys(table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")), key="k")


@register("only_in_first", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def only_in_first(spark, sf):
    """Customers of nations without a rich supplier."""
    rich = table(spark, sf, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("k"))
    return tb.only_in_first(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), rich, "k").select("c_custkey")


@register("cells_to_records", "SELECT l_orderkey, min(l_partkey) FILTER (l_returnflag = 'A') AS A, min(l_partkey) FILTER (l_returnflag = 'N') AS N FROM lineitem GROUP BY 1")
def cells_to_records(spark, sf):
    return tb.cells_to_records(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", "l_partkey", ["A", "N"])


@register("filled_fields", """SELECT o_orderkey, '{"o_orderstatus":"' || o_orderstatus || '"' || CASE WHEN o_custkey % 2 = 0 THEN ',"even":"' || o_custkey || '"' ELSE '' END || '}' AS json FROM orders""")
def filled_fields(spark, sf):
    return tb.filled_fields(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise("").alias("even"), F.lit(None).cast("string").alias("none")), "o_orderkey")


@register("expand_aliased", "SELECT p_partkey, v AS names FROM part, (SELECT unnest(['BB', 'c']) AS v)")
def expand_aliased(spark, sf):
    return tb.expand_aliased(table(spark, sf, "part", "p_partkey").withColumn("names", F.lit("b, c")), "names", {"b": "BB"})


@register("standoff_join", "SELECT o_orderkey AS doc, o_orderkey * 2 AS \"start\", o_orderkey * 2 + 1 AS \"end\", c_name AS value FROM orders JOIN customer ON o_custkey = c_custkey")
def standoff_join(spark, sf):
    o = table(spark, sf, "orders").withColumn("mention", F.concat(F.lit("m"), F.col("o_orderkey").cast("string")))
    a = o.select(F.col("o_orderkey").alias("doc"), "mention", (F.col("o_orderkey") * 2).alias("start"), (F.col("o_orderkey") * 2 + 1).alias("end"))
    slots = table(spark, sf, "customer").select(F.col("c_custkey").alias("slot"), F.col("c_name").alias("value"))
    return tb.standoff_join(a, o.select("mention", F.col("o_custkey").alias("slot")), slots)


@register("best_of_pairs", "SELECT p_partkey, CASE WHEN p_size % 10 > 4 THEN 'a' ELSE 'b' END AS best FROM part")
def best_of_pairs(spark, sf):
    pairs = F.concat(F.lit("a?s"), (F.col("p_size") % 10).cast("string"), F.lit("|b?s4.5"))
    return table(spark, sf, "part").select("p_partkey", tb.best_of_pairs(pairs).alias("best"))


@register("all_best_hits", "WITH b AS (SELECT o_custkey, max(o_orderpriority) AS m FROM orders GROUP BY 1) SELECT c_custkey, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey), '') AS o_orderkey FROM customer LEFT JOIN b ON c_custkey = b.o_custkey LEFT JOIN orders o ON o.o_custkey = c_custkey AND o.o_orderpriority = b.m GROUP BY 1")
def all_best_hits(spark, sf):
    hits = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderkey")
    return tb.all_best_hits(table(spark, sf, "customer", "c_custkey"), "c_custkey", hits, "o_orderpriority", ["o_orderkey"])


@register("clone_ends", "SELECT l_orderkey AS clone, string_agg(DISTINCT 'a' || l_partkey, ',' ORDER BY 'a' || l_partkey) FILTER (l_linenumber % 2 = 1) AS forward, string_agg(DISTINCT 'a' || l_partkey, ',' ORDER BY 'a' || l_partkey) FILTER (l_linenumber % 2 = 0) AS reverse FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linenumber % 2 = 1) > 0 AND count(*) FILTER (l_linenumber % 2 = 0) > 0")
def clone_ends(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("clone"), F.when(F.col("l_linenumber") % 2 == 1, "F").otherwise("R").alias("end"), F.concat(F.lit("a"), F.col("l_partkey").cast("string"), F.lit(".1")).alias("accession"))
    return tb.clone_ends(rows).select("clone", F.array_join("forward", ",").alias("forward"), F.array_join("reverse", ",").alias("reverse"))


@register("clone_prefixes", "SELECT DISTINCT split_part(o_orderpriority, '-', 1) AS prefix FROM orders")
def clone_prefixes(spark, sf):
    return tb.clone_prefixes(table(spark, sf, "orders"), "o_orderpriority")


@register("listed_ids", "SELECT DISTINCT CAST(unnest([c_nationkey, c_nationkey + 1]) AS VARCHAR) AS id FROM customer")
def listed_ids(spark, sf):
    return tb.listed_ids(table(spark, sf, "customer").select(F.concat(F.col("c_nationkey").cast("string"), F.lit(" , "), (F.col("c_nationkey") + 1).cast("string"), F.lit(",")).alias("ids")), "ids")


@register("share_of_rows", "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0")
def share_of_rows(spark, sf):
    """The four nodes' shares put together: every row that is not skipped, once."""
    o = table(spark, sf, "orders", "o_orderkey")
    return tb.concat_frames([tb.share_of_rows(o, "o_orderkey", 4, i, o.where("o_orderkey % 5 = 0")) for i in range(4)])


@register("to_all_groups", "WITH g AS (SELECT DISTINCT o_custkey AS k, o_orderstatus AS s FROM orders) SELECT c_custkey, s FROM customer JOIN g ON c_custkey = k UNION ALL SELECT c_custkey, s FROM (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT k FROM g)), (SELECT DISTINCT s FROM g)")
def to_all_groups(spark, sf):
    groups = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("s"))
    return tb.to_all_groups(table(spark, sf, "customer", "c_custkey"), groups, "c_custkey", "s").select("c_custkey", "s")


@register("multimap", "SELECT o_custkey AS key, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS \"values\" FROM orders GROUP BY 1")
def multimap(spark, sf):
    return tb.multimap(table(spark, sf, "orders"), "o_custkey", "o_orderpriority").select("key", F.array_join("values", "|").alias("values"))


@register("cogroup_rows", "SELECT c_nationkey AS k, count(DISTINCT c_custkey) AS n_left, count(DISTINCT s_suppkey) AS n_right FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1")
def cogroup_rows(spark, sf):
    rows = tb.cogroup_lists(table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey"), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey"), "k")
    return rows.select("k", F.size("left_rows").cast("long").alias("n_left"), F.size("right_rows").cast("long").alias("n_right"))


@register("pair_lines", "SELECT p_brand AS key, count(*) AS n FROM part WHERE p_size % 2 = 0 GROUP BY 1")
def pair_lines(spark, sf):
    return ag.pair_counts(table(spark, sf, "part").select(F.concat("p_brand", F.lit("\tx"), F.when(F.col("p_size") % 2 == 0, "").otherwise("\ty")).alias("line")), "line")


@register("column_summary", "SELECT CAST(sum(p_size) AS BIGINT) AS sum, avg(p_size) AS avg, min(p_size) AS min, max(p_size) AS max, count(*) AS n FROM part")
def column_summary(spark, sf):
    return ag.column_summary(table(spark, sf, "part"), "p_size")


@register("distinct_tokens", "SELECT DISTINCT unnest(['t' || p_size % 7, 'u']) AS token FROM part WHERE p_size % 2 = 0")
def distinct_tokens(spark, sf):
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("f=t"), (F.col("p_size") % 7).cast("string"), F.lit(",u"))).otherwise("none")
    return ag.distinct_tokens(table(spark, sf, "part").select(text.alias("x")), "x")


@register("by_match_count", "SELECT l_suppkey, count(*) AS n, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS items FROM lineitem GROUP BY 1")
def by_match_count(spark, sf):
    return ag.by_match_count(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag")


@register("frequent_groups", "SELECT l_suppkey, l_returnflag, count(*) AS n, sum(l_quantity) AS total FROM lineitem WHERE l_quantity >= 20 GROUP BY 1, 2")
def frequent_groups(spark, sf):
    return ag.frequent_groups(table(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"], "l_quantity", 20)


@register("annotated_hits", "SELECT p_partkey, CAST(CASE WHEN p_size % 3 IN (0, 1) THEN 2 ELSE 3 END AS BIGINT) AS n_predicted, CAST(1 + CAST(p_size % 3 = 0 AS INTEGER) AS BIGINT) AS n_foreground, CASE WHEN p_size % 3 = 1 THEN 'i1' ELSE '' END AS special FROM part")
def annotated_hits(spark, sf):
    ids = F.concat(F.lit("x,i"), (F.col("p_size") % 3).cast("string"), F.when(F.col("p_size") % 3 == 2, ",y,x").otherwise(""))
    return ag.annotated_hits(table(spark, sf, "part").select("p_partkey", ids.alias("ids")), "ids", ["x", "i0"], ["i1"]).drop("ids")


@register("count_combinations", "WITH g AS (SELECT a AS c0, b AS c1, c AS c2 FROM (SELECT unnest(range(0, 3)) AS a), (SELECT unnest(range(0, 2)) AS b), (SELECT unnest(range(0, 8)) AS c)), n AS (SELECT l_partkey % 3 AS c0, l_suppkey % 2 AS c1, CAST(l_linenumber AS BIGINT) AS c2, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) SELECT c0, c1, c2, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (c0, c1, c2)")
def count_combinations(spark, sf):
    """Line items in every combination of part, supplier and number, empty ones too."""
    n = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 3).alias("c0"), (F.col("l_suppkey") % 2).alias("c1"), F.col("l_linenumber").cast("long").alias("c2")).agg(F.count("*").alias("n"))
    return ag.count_combinations(spark, [2, 1, 7]).join(n, ["c0", "c1", "c2"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@register("sample_covariance", "SELECT round(var_samp(l_quantity), 6) AS var_x, round(var_samp(l_tax), 9) AS var_y, round(covar_samp(l_quantity, l_tax), 9) AS cov FROM lineitem")
def sample_covariance(spark, sf):
    return ag.sample_covariance(table(spark, sf, "lineitem"), "l_quantity", "l_tax").select(F.round("var_x", 6).alias("var_x"), F.round("var_y", 9).alias("var_y"), F.round("cov", 9).alias("cov"))


_CELLS = "c AS (SELECT l_suppkey % 10 AS row, l_linenumber AS col, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


@register("rank_correlation", f"WITH {_CELLS}, w AS (SELECT * FROM c WHERE row IN (SELECT row FROM c GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT col) FROM c))), r AS (SELECT row, col, rank() OVER (PARTITION BY col ORDER BY v) + (count(*) OVER (PARTITION BY col, v) - 1) / 2.0 AS k FROM w) SELECT p.col AS a, q.col AS b, round(corr(p.k, q.k), 9) AS r, count(*) AS n FROM r p JOIN r q ON p.row = q.row AND p.col < q.col GROUP BY 1, 2")
def rank_correlation(spark, sf):
    cells = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("row"), F.col("l_linenumber").alias("col")).agg(F.sum("l_quantity").alias("v"))
    return ag.rank_correlation(cells, "row", "col", "v").withColumn("r", F.round("r", 9))


#: Of ten pairs of values: p is 1 less |r| times a sum of four powers of 1 - r * r.
@register("significant_pairs", f"""WITH {_CELLS}, r AS (SELECT p.col AS a, q.col AS b, corr(p.v, q.v) AS r, count(*) AS n FROM c p JOIN c q ON p.row = q.row AND p.col < q.col GROUP BY 1, 2), t AS (SELECT *, 1 - abs(r) * (1 + 0.5 * (1 - r * r) + 0.375 * power(1 - r * r, 2) + 0.3125 * power(1 - r * r, 3)) AS p FROM r WHERE n = 10)
  SELECT a, b, round(r, 6) AS r, n, round(p, 6) AS p FROM t WHERE p <= 0.9""")
def significant_pairs(spark, sf):
    """Line numbers whose quantities go together over ten groups of suppliers."""
    cells = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("row"), F.col("l_linenumber").alias("col")).agg(F.sum("l_quantity").cast("double").alias("v"))
    return ag.significant_pairs(cells, "col", "row", "v", 0.9).where("n = 10").select("a", "b", F.round("r", 6).alias("r"), "n", F.round("p", 6).alias("p"))


@register("binomial_tails", "SELECT p_partkey, round(list_sum(list_transform(range(CAST(p_size % 5 AS BIGINT), 11), lambda k: exp(lgamma(11) - lgamma(k + 1) - lgamma(11 - k) + k * ln(0.3) + (10 - k) * ln(0.7)))), 9) AS tail FROM part")
def binomial_tails(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(st.pbinom(F.col("p_size") % 5, F.lit(10), F.lit(0.3)), 9).alias("tail"))


@register("poisson_tails", "SELECT p_partkey, round(1 - coalesce(list_sum(list_transform(range(0, CAST(p_size % 8 AS BIGINT)), lambda k: exp(k * ln(2.5) - 2.5 - lgamma(k + 1)))), 0), 9) AS tail FROM part")
def poisson_tails(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(st.ppois(F.col("p_size") % 8, F.lit(2.5)), 9).alias("tail"))


@register("hypergeometric_tails", "SELECT p_partkey, round(list_sum(list_transform(range(CAST(p_size % 4 AS BIGINT), 6), lambda i: exp(lgamma(13) - lgamma(i + 1) - lgamma(13 - i) + lgamma(39) - lgamma(6 - i) - lgamma(34 + i) - lgamma(51) + lgamma(6) + lgamma(46)))), 9) AS tail FROM part")
def hypergeometric_tails(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(st.phyper(F.col("p_size") % 4, F.lit(50), F.lit(12), F.lit(5)), 9).alias("tail"))


@register("fisher_test", """WITH t AS (SELECT p_partkey, CAST(p_size % 7 AS BIGINT) AS a, CAST(p_size % 5 + 1 AS BIGINT) AS b, CAST(p_partkey % 6 + 1 AS BIGINT) AS c, CAST(p_partkey % 11 AS BIGINT) AS d FROM part), m AS (SELECT *, a + b + c + d AS n, a + b AS r, a + c AS k FROM t),
  x AS (SELECT p_partkey, a, i, exp(lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1) + lgamma(n - k + 1) - lgamma(r - i + 1) - lgamma(n - k - r + i + 1) - lgamma(n + 1) + lgamma(r + 1) + lgamma(n - r + 1)) AS p FROM m, (SELECT unnest(range(0, 13)) AS i) WHERE i >= greatest(0, r + k - n) AND i <= least(r, k)),
  o AS (SELECT p_partkey, p AS own FROM x WHERE i = a) SELECT p_partkey, round(least(1.0, sum(p)), 6) AS p FROM x JOIN o USING (p_partkey) WHERE p <= own * 1.0000001 GROUP BY 1""")
def fisher_test(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 7).alias("a"), (F.col("p_size") % 5 + 1).alias("b"), (F.col("p_partkey") % 6 + 1).alias("c"), (F.col("p_partkey") % 11).alias("d"))
    return rows.select("p_partkey", F.round(st.fisher_p("a", "b", "c", "d"), 6).alias("p"))


@register("binomial_score", "SELECT p_partkey, round(-log10(list_sum(list_transform(range(CAST(p_size % 5 AS BIGINT), 11), lambda k: exp(lgamma(11) - lgamma(k + 1) - lgamma(11 - k) + k * ln(0.3) + (10 - k) * ln(0.7))))), 6) + 0 AS score FROM part")
def binomial_score(spark, sf):
    return table(spark, sf, "part").select("p_partkey", (F.round(st.binomial_score(F.col("p_size") % 5, F.lit(10), F.lit(0.3)), 6) + 0).alias("score"))


@register("normal_cdf", """WITH x AS (SELECT c_custkey, (c_acctbal - 4500) / 3000.0 AS x FROM customer), t AS (SELECT *, 1 / (1 + 0.3275911 * abs(x) / sqrt(2.0)) AS t FROM x)
  SELECT c_custkey, round((1 + sign(x) * (1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x / 2))) / 2, 6) AS p FROM t""")
def normal_cdf(spark, sf):
    x = (F.col("c_acctbal") - 4500) / 3000
    return table(spark, sf, "customer").select("c_custkey", F.round(st.normal_cdf(x.cast("double")), 6).alias("p"))


@register("shuffle_keeps_values", "SELECT vec_id, list_sort(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6))) AS sorted FROM embeddings")
def shuffle_keeps_values(spark, sf):
    # Rounding keeps the sign of what becomes zero, as SQL's does.
    rounded = lambda x: F.when(F.round(x, 6) == 0, x * F.lit(0e0)).otherwise(F.round(x, 6))
    return table(spark, sf, "embeddings").select("vec_id", F.array_sort(F.transform(rk.shuffle_array("embedding", "vec_id"), lambda x: rounded(x.cast("double")))).alias("sorted"))


@register("split_is_whole", "SELECT o_orderkey FROM orders")
def split_is_whole(spark, sf):
    a, b = rk.split_by_hash(table(spark, sf, "orders", "o_orderkey"), 0.3, "o_orderkey")
    return a.unionAll(b)


@register("random_sequences", "SELECT CAST(range AS BIGINT) AS id, 30 AS len FROM range(0, (SELECT count(*) FROM part))")
def random_sequences(spark, sf):
    """As many random sequences as there are parts."""
    rows = sq.random_sequences(spark, table(spark, sf, "part").count(), 30, 0.4)
    return rows.select("id", F.length(F.regexp_replace("seq", "[^ACGT]", "")).alias("len"))


@register("mutated_sequences", f"SELECT CAST(p_partkey AS VARCHAR) AS id, 32 AS len, translate({_DNA}, 'ACGT', 'CGTA') AS all_changed FROM part")
def mutated_sequences(spark, sf):
    d = dna(spark, sf)
    some, every = sq.mutated(d, 0.9), sq.mutated(d, 0.0).withColumnRenamed("seq", "all_changed")
    return some.join(every, "id").select("id", F.length("seq").alias("len"), "all_changed")


@register("random_substrings", f"SELECT CAST(p_partkey AS VARCHAR) AS id, 8 AS len, true AS inside FROM part")
def random_substrings(spark, sf):
    d = dna(spark, sf)
    got = sq.random_substrings(d.select("id", F.substring("seq", 1, 8).alias("seq")), d)
    met = got.join(d.select(F.col("id").alias("pool_id"), F.col("seq").alias("whole")), "pool_id")
    return met.select("id", F.length("seq").alias("len"), (F.substr("whole", (F.col("start") + 1).cast("int"), F.length("seq")) == F.col("seq")).alias("inside"))


# -- text ----------------------------------------------------------------------------------------------------------------


@register("highlight", "SELECT n_nationkey, regexp_replace(n_name, '(?i)(an)', '<b>\\1</b>', 'g') AS marked FROM nation")
def highlight(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", fs.highlight("n_name", "an").alias("marked"))


@register("comma_list", "SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def comma_list(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(fs.comma_list(F.array_sort(F.collect_list("o_orderkey"))).alias("orders"))


@register("pack_place", "SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 'chr' || CASE WHEN o_custkey % 4 = 3 THEN 'X' ELSE CAST(o_custkey % 4 AS VARCHAR) END END AS chrom, CASE WHEN o_custkey % 4 > 0 THEN o_orderkey END AS \"start\" FROM orders")
def pack_place(spark, sf):
    k = F.col("o_custkey") % 4
    chrom = F.when(k == 0, "chr6_hap1").when(k == 3, "chrX").otherwise(F.concat(F.lit("chr"), k.cast("string")))
    rows = table(spark, sf, "orders").select("o_orderkey", fs.pack_place(chrom, "o_orderkey", F.col("o_orderkey") + 5).alias("p"))
    return rows.select("o_orderkey", fs.unpack_place("p").alias("u")).select("o_orderkey", "u.chrom", "u.start")


@register("clean_string", "SELECT p_partkey, regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g') AS clean FROM part")
def clean_string(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fs.clean_string("p_type").alias("clean"))


@register("plain_ascii", "SELECT p_partkey, 'Cafe - \"' || p_name || '\" ss alpha' || p_size AS plain FROM part")
def plain_ascii(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fs.plain_ascii(F.concat(F.lit("Café – “"), "p_name", F.lit("” ß α中"), F.col("p_size").cast("string"))).alias("plain"))


@register("remove_accents", "SELECT doc_id, strip_accents('Ünïcode àé ') || doc_id AS plain FROM documents")
def remove_accents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fs.remove_accents(F.concat(F.lit("Ünïcode àé "), F.col("doc_id").cast("string"))).alias("plain"))


@register("base_n", "SELECT o_orderkey, lower(hex(o_orderkey)) AS hex FROM orders")
def base_n(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", fs.base_n("o_orderkey", 16, "0123456789abcdef").alias("hex"))


@register("browser_chrom", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'chr' || p_size WHEN 1 THEN 'chrX' WHEN 2 THEN 'chrM' ELSE 'scaffold_' || p_size END AS chrom FROM part")
def browser_chrom(spark, sf):
    size = F.col("p_size")
    name = F.when(size % 4 == 0, size.cast("string")).when(size % 4 == 1, "X").when(size % 4 == 2, "MT").otherwise(F.concat(F.lit("scaffold_"), size.cast("string")))
    return table(spark, sf, "part").select("p_partkey", fs.browser_chrom(name).alias("chrom"))


@register("iupac_pattern", "SELECT CAST(p_partkey AS VARCHAR) AS id FROM (SELECT p_partkey, " + _DNA + " AS s FROM part) WHERE regexp_matches(s, 'A[CT][ACGT][GC]A')")
def iupac_pattern(spark, sf):
    return dna(spark, sf).where(F.col("seq").rlike(fs.iupac_pattern("AYNSA"))).select("id")


@register("cleaned_text", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[^A-Za-z]+', ' ', 'g')) AS words FROM pages")
def cleaned_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.cleaned("html").alias("words"))


@register("blank_out", "SELECT doc_id, regexp_replace(text, '[0-9]', ' ', 'g') AS blanked FROM documents WHERE text IS NOT NULL")
def blank_out(spark, sf):
    return tx.blanked(table(spark, sf, "documents").where("text is not null"), r"[0-9]", "text", "blanked").select("doc_id", "blanked")


@register("select_html", "SELECT n_nationkey, v AS found FROM nation, (SELECT unnest(['one', 'two words']) AS v)")
def select_html(spark, sf):
    html = F.concat(F.lit('<p>no</p><p class="a x">one</p><p class="b">not</p><p class=\'x\'>two <b>words</b></p>'), F.col("n_name"))
    return tx.select_html(table(spark, sf, "nation").select("n_nationkey", html.alias("html")), "html", "p", "x").select("n_nationkey", "found")


@register("table_cells", "SELECT n_nationkey, CAST(i AS INTEGER) AS row_no, CASE WHEN i = 0 THEN 'h1|h2' ELSE n_name || '|x y' END AS cells FROM nation, (SELECT unnest([0, 1]) AS i)")
def table_cells(spark, sf):
    html = F.concat(F.lit("<table><tr><th>h1</th><th>h2</th></tr><TR><td><b>"), F.col("n_name"), F.lit("</b></td><td>x\n y</td></TR></table>"))
    return tx.table_cells(table(spark, sf, "nation").select("n_nationkey", html.alias("html")), "n_nationkey", "html").select("n_nationkey", "row_no", F.array_join("cells", "|").alias("cells"))


@register("article_fields", "SELECT n_nationkey, n_name AS title, '' AS journal, 'r1|r2' AS refs FROM nation")
def article_fields(spark, sf):
    xml = F.concat(F.lit("<article><front><title>"), F.col("n_name"), F.lit("</title></front><ref>r1</ref><ref>r2</ref></article>"))
    out = tx.article_fields(table(spark, sf, "nation").select("n_nationkey", xml.alias("xml")), "xml", {"title": "/article/front/title", "journal": "//journal"}, "/article/ref/text()")
    return out.select("n_nationkey", "title", "journal", F.array_join("references", "|").alias("refs"))


@register("xml_fields", "SELECT n_nationkey, n_name AS name, 'none' AS missing FROM nation")
def xml_fields(spark, sf):
    xml = F.concat(F.lit('<r><v k="a">'), F.col("n_name"), F.lit('</v><v k="b">x</v></r>'))
    return src.xml_fields(table(spark, sf, "nation").select("n_nationkey", xml.alias("xml")), "xml", {"name": "/r/v[@k='a']", "missing": "/r/z"}, "none").drop("xml")


@register("peptide_strings", "SELECT n_nationkey, 'MKWVTFISLL' AS peptide FROM nation")
def peptide_strings(spark, sf):
    text = F.concat(F.lit("the peptide MKWVTFISLL, not ACGTACGTACGT nor AAAAAAAAAA "), F.col("n_name"))
    return tx.peptide_strings(table(spark, sf, "nation").select("n_nationkey", F.lower("n_name").alias("low"), text.alias("text")).withColumn("text", F.concat(F.regexp_replace("text", "[A-Z]+$", ""), "low")), "n_nationkey")


@register("first_text", "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'plain' ELSE 'xml' END AS source FROM orders")
def first_text(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return tx.first_text({"plain": o.withColumn("text", F.when(F.col("doc_id") % 2 == 0, "t")), "xml": o.withColumn("text", F.lit("x"))}).select("doc_id", "source")


@register("nucleotide_hits", "SELECT o_orderkey AS doc_id, 0 AS seq_no, 'ACGTACGTACGTACGTACGTAC' AS seq FROM orders UNION ALL SELECT o_orderkey, 1, 'TTGACCATTGACCATTGACCA' FROM orders")
def nucleotide_hits(spark, sf):
    text = F.concat(F.lit("we used ACGTACGTACGTACGTACGTAC for order "), F.col("o_orderkey").cast("string"), F.lit(" and 5' uugaccauug accauugacca 3' once"))
    return tx.extract_nucleotides(table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))).select("doc_id", "seq_no", "seq")


@register("stanza_settings", "SELECT n_nationkey, n_name || ' x' AS name, 'bed' AS type FROM nation")
def stanza_settings(spark, sf):
    line = F.concat(F.lit("track name='"), F.col("n_name"), F.lit(" x' type=bed other=\"a b\""))
    return tx.stanza_settings(table(spark, sf, "nation").select("n_nationkey", line.alias("line")), "line", ["name", "type"]).select("n_nationkey", F.col("settings")["name"].alias("name"), F.col("settings")["type"].alias("type"))


@register("regex_places", f"WITH {_SITES}, h AS (SELECT id, strand, i, m FROM w WHERE regexp_full_match(m, 'ACG[AT]')) SELECT id, CASE WHEN strand = '+' THEN i ELSE 28 - i END AS \"start\", CASE WHEN strand = '+' THEN i + 4 ELSE 32 - i END AS \"end\", m AS match, strand, 'p' AS pattern FROM h")
def regex_places(spark, sf):
    """Every match with its place and strand; matches of this pattern cannot overlap."""
    return sq.regex_hits(dna(spark, sf), {"p": "ACG[AT]"})


@register("matrix_places", f"""WITH {_SITES}, v AS (SELECT id, strand, i, list_transform([1, 2, 3], lambda k: strpos('ACGT', substr(m, k, 1))) AS c FROM (SELECT id, strand, i, substr(m, 1, 3) AS m FROM w UNION ALL SELECT id, strand, 29 AS i, substr(x, 30, 3) AS m FROM t)),
  f AS (SELECT [[8.001, 0.001, 1.001, 1.001], [0.001, 9.001, 0.001, 1.001], [1.001, 1.001, 7.001, 1.001]] AS w), q AS (SELECT list_transform(w, lambda r: list_transform(r, lambda x: x / 10.004)) AS p FROM (SELECT [w[1], [x / 1.0 for x in w[2]], w[3]] AS w FROM f)),
  z AS (SELECT list_transform(p, lambda r: list_sum(list_transform(r, lambda y: y * ln(4 * y)))) AS ic, p FROM q), g AS (SELECT [[y * ic[1] for y in p[1]], [y * ic[2] for y in p[2]], [y * ic[3] for y in p[3]]] AS s FROM z),
  e AS (SELECT s, list_min(s[1]) + list_min(s[2]) + list_min(s[3]) AS lo, list_max(s[1]) + list_max(s[2]) + list_max(s[3]) AS hi FROM g)
  SELECT id, CAST(CASE WHEN strand = '+' THEN i ELSE 29 - i END AS BIGINT) AS "start", strand, round((s[1][c[1]] + s[2][c[2]] + s[3][c[3]] - lo) / (hi - lo), 6) AS score FROM v, e WHERE (s[1][c[1]] + s[2][c[2]] + s[3][c[3]] - lo) / (hi - lo) >= 0.9""")
def matrix_places(spark, sf):
    hits = sq.matrix_hits(dna(spark, sf), {"m": [[8, 0, 1, 1], [0, 9, 0, 1], [1, 1, 7, 1]]}, 0.9)
    return hits.select("id", "start", "strand", F.round("score", 6).alias("score"))


# -- ontologies, entries, records -----------------------------------------------------------------------------------------------


@register("obo_closure", "WITH RECURSIVE t AS (SELECT p_partkey AS n, p_partkey // 2 AS a, 1 AS d FROM part WHERE p_partkey > 1 UNION ALL SELECT n, a // 2, d + 1 FROM t WHERE a > 1) SELECT 'T:' || n AS node, 'T:' || a AS ancestor, CAST(d AS BIGINT) AS depth FROM t WHERE a >= 1")
def obo_closure(spark, sf):
    """A binary tree of terms: every node with all its ancestors."""
    k = F.col("p_partkey")
    term = F.concat(F.lit("[Term]\nid: T:"), k.cast("string"), F.lit("\nname: n"), k.cast("string"), F.when(k > 1, F.concat(F.lit("\nis_a: T:"), F.floor(k / 2).cast("string"), F.lit(" ! up"))).otherwise(""), F.lit("\n"))
    path = text_folder(table(spark, sf, "part").where("p_partkey >= 1").select(F.concat(F.lit("\n"), term).alias("value")))
    return gr.ancestors(rc.obo_edges(rc.read_obo(spark, path)))


@register("obo_descendants", "WITH RECURSIVE t AS (SELECT p_partkey AS n, p_partkey // 2 AS a, 1 AS d FROM part WHERE p_partkey > 1 UNION ALL SELECT n, a // 2, d + 1 FROM t WHERE a > 1) SELECT a AS node, n AS descendant FROM t WHERE a >= 1")
def obo_descendants(spark, sf):
    edges = table(spark, sf, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).alias("parent"))
    return gr.descendants(edges).select("node", "descendant")


@register("synonyms", "SELECT name, min(term) AS term FROM (SELECT n_nationkey AS term, unnest([lower(n_name), lower(n_name) || 's', 'nation ' || n_regionkey, 'nation ' || n_regionkey || 's']) AS name FROM nation) WHERE length(name) >= 4 GROUP BY 1")
def synonyms(spark, sf):
    return gr.synonyms(table(spark, sf, "nation").select(F.col("n_nationkey").alias("term"), F.lower("n_name").alias("name"), F.array(F.concat(F.lit("nation "), F.col("n_regionkey").cast("string"))).alias("synonyms")))


def entries(spark, sf, article=None):
    """An entry of a sequence database for each part, in its flat form."""
    k = F.col("p_partkey").cast("string")
    head = F.concat(F.lit("LOCUS       X"), k, F.lit(" 32 bp\nDEFINITION  part "), k, F.lit(",\n            more.\nACCESSION   X"), k, F.lit("\n  ORGANISM  Homo sapiens\nREFERENCE   1\n  AUTHORS   A. B.\n  TITLE     On "), F.col("p_brand"), F.lit("\n  JOURNAL   J\n   PUBMED   "), (F.col("p_size") if article is None else article).cast("string"), F.lit('\nFEATURES\n     source\n                     /db_xref="taxon:'), (F.col("p_size") % 3).cast("string"), F.lit('"\nORIGIN\n        1 '))
    return table(spark, sf, "part").select(F.concat(head, F.lower(F.expr(_DNA)), F.lit("\n//")).alias("value"))


@register("genbank_entries", f"SELECT 'X' || p_partkey AS accession, 'part ' || p_partkey || ', more.' AS definition, 'Homo sapiens' AS organism, CAST(p_size % 3 AS INTEGER) AS taxon, 32 AS length, {_DNA} AS seq FROM part")
def genbank_entries(spark, sf):
    return rc.read_genbank(spark, text_folder(entries(spark, sf))).drop("references")


@register("entry_references", "SELECT title, pubmed, count(*) AS n FROM (SELECT 'On ' || p_brand AS title, CAST(p_size AS VARCHAR) AS pubmed FROM part) GROUP BY 1, 2")
def entry_references(spark, sf):
    refs, links = rc.reference_tables(rc.read_genbank(spark, text_folder(entries(spark, sf))))
    return refs.join(links, "ref_id").groupBy("title", "pubmed").agg(F.count("*").alias("n"))


@register("taxon_sequences", f"WITH p AS (SELECT p_partkey, p_size, p_partkey // 10 * 10 + p_size % 3 AS article, {_DNA} AS seq FROM part) SELECT 'X' || p_partkey AS accession, CAST(p_size % 3 AS INTEGER) AS taxon, seq FROM p WHERE article IN (SELECT article FROM p GROUP BY 1 HAVING count(DISTINCT p_partkey) < 5)")
def taxon_sequences(spark, sf):
    """Articles cite the parts of one ten that have one size modulo 3; those that cite five or more are large."""
    article = F.floor(F.col("p_partkey") / 10) * 10 + F.col("p_size") % 3
    return rc.taxon_sequences(rc.read_genbank(spark, text_folder(entries(spark, sf, article))), 5, 1_000_000)


@register("map_columns", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'x' END AS even, CAST(o_custkey AS VARCHAR) AS key FROM orders")
def map_columns(spark, sf):
    k = F.col("o_custkey")
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(k % 2 == 0, F.create_map(F.lit("key"), k.cast("string"), F.lit("even"), F.lit("x"))).otherwise(F.create_map(F.lit("key"), k.cast("string"))).alias("m"))
    return rc.map_columns(rows, "o_orderkey", "m")


@register("tagged_records", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand || '|' || p_type AS tags FROM part")
def tagged_records(spark, sf):
    value = F.concat(F.lit("ID\t"), F.col("p_partkey").cast("string"), F.lit("\nTG\t"), F.col("p_brand"), F.lit("\nZZ\tx\nTG\t"), F.col("p_type"))
    out = rc.tagged_records(spark, text_folder(table(spark, sf, "part").select(value.alias("value"))), "ID", ["TG"])
    return out.select(F.col("ID")[0].alias("id"), F.array_join("TG", "|").alias("tags")).where("id <> ''")


@register("record_filter", "SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_brand LIKE '%3'")
def record_filter(spark, sf):
    value = F.concat(F.lit("ID\t"), F.col("p_partkey").cast("string"), F.lit("\nTG\t"), F.col("p_brand"), F.lit("\nTG\tother"))
    out = rc.tagged_records(spark, text_folder(table(spark, sf, "part").select(value.alias("value"))), "ID", ["TG"])
    return rc.records_matching(out, "TG", "3$").select(F.col("ID")[0].alias("id"))


# -- best rows, hits, genes ------------------------------------------------------------------------------------------------------


@register("best_by", "SELECT o_custkey, arg_max(o_orderkey, (o_orderpriority, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def best_by(spark, sf):
    return rk.best_by(table(spark, sf, "orders"), "o_custkey", ["o_orderpriority", "o_orderkey"], ["o_orderkey"])


@register("longest_per", "SELECT l_orderkey, arg_min(l_linenumber, (-l_quantity, l_linenumber)) AS l_linenumber, max(l_quantity) AS length FROM lineitem GROUP BY 1")
def longest_per(spark, sf):
    return rk.longest_per(table(spark, sf, "lineitem").withColumn("zero", F.lit(0e0)), "l_orderkey", "zero", "l_quantity", "l_linenumber")


@register("best_genes", "WITH s AS (SELECT o_custkey AS gene, list_sort(list(DISTINCT o_orderpriority)) AS seqs FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 2) SELECT array_to_string(seqs, '|') AS seqs, arg_min(gene, (-coalesce(c_acctbal, 0), gene)) AS gene FROM s LEFT JOIN customer ON c_custkey = gene GROUP BY 1")
def best_genes(spark, sf):
    hits = table(spark, sf, "orders").select(F.col("o_custkey").alias("gene"), F.col("o_orderpriority").alias("seq"))
    weights = table(spark, sf, "customer").select(F.col("c_custkey").alias("gene"), F.col("c_acctbal").alias("weight"))
    return tx.best_genes(hits, weights).select(F.array_join("seqs", "|").alias("seqs"), "gene")


@register("genome_of_hits", "WITH s AS (SELECT l_orderkey, l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, arg_min(l_returnflag, (-n, l_returnflag)) AS l_returnflag, CAST(max(n) AS BIGINT) AS score FROM s GROUP BY 1")
def genome_of_hits(spark, sf):
    hits = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_suppkey").distinct()
    return ag.best_target(hits, "l_orderkey", "l_returnflag", "l_suppkey", "count")


@register("without_contaminants", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1)")
def without_contaminants(spark, sf):
    l = table(spark, sf, "lineitem")
    return tb.keep_in(l, "l_partkey", l.where("l_suppkey = 1"), "l_partkey", invert=True).select("l_orderkey", "l_linenumber")


@register("compare_versions", "WITH a AS (SELECT DISTINCT o_orderpriority AS k, o_custkey % 20 AS v FROM orders), b AS (SELECT DISTINCT o_orderpriority AS k, o_custkey % 30 AS v FROM orders WHERE o_orderstatus = 'F'), s AS (SELECT coalesce(a.k, b.k) AS key, a.v AS av, b.v AS bv FROM a FULL JOIN b ON a.k = b.k AND a.v = b.v) SELECT key, count(av) AS n_a, count(bv) AS n_b, count(*) FILTER (av IS NOT NULL AND bv IS NOT NULL) AS n_common FROM s GROUP BY 1")
def compare_versions(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("k"), (F.col("o_custkey") % 20).alias("v"))
    b = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderpriority").alias("k"), (F.col("o_custkey") % 30).alias("v"))
    return bm.compare_sets(a, b, "k", "v").drop("verdict")


@register("compare_moved", f"""WITH {_SPANS} SELECT count(*) AS n_common, count(*) FILTER ("start" % 2 = 0) AS n_exact, count(*) FILTER ("end" - "start" > "start" % 2) AS n_overlap, count(*) AS n_close, count(*) AS n_near FROM spans""")
def compare_moved(spark, sf):
    """A track against itself with odd starts moved by one."""
    s = spans(spark, sf)
    return iv.name_compare(s, s.withColumn("start", F.col("start") + F.col("start") % 2))


# -- streams -----------------------------------------------------------------------------------------------------------------


@register("stream_rows", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def stream_rows(spark, sf):
    """A folder read as a stream, filtered and written batch by batch; what has been written."""
    out, log = staging.fresh_path(spark), staging.fresh_path(spark)
    schema = table(spark, sf, "customer").schema
    rows = stateless.read_folder(spark, sf, schema, glob="customer.parquet").where("c_acctbal > 0").select("c_custkey", "c_acctbal")
    stateless.write_batches(rows, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), log).awaitTermination()
    return spark.read.parquet(out).select("c_custkey", "c_acctbal")


@register("stream_windows", "SELECT event_type, count(*) AS n FROM events WHERE time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour <= (SELECT max(ts) FROM events) - INTERVAL 10 minute GROUP BY 1")
def stream_windows(spark, sf):
    """Hourly counts of a stream with a watermark of ten minutes; the windows that it closed, summed by type."""
    out, log = staging.fresh_path(spark), staging.fresh_path(spark)
    raw = stateless.read_folder(spark, sf, table(spark, sf, "events").schema, glob="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = stateless.windowed_counts(raw, "ts", "event_type", "1 hour", "10 minutes")
    stateless.write_batches(counts, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), log).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"))


@register("stream_runs", "SELECT user_id, count(*) AS runs, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id, run, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT user_id, event_id, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1")
def stream_runs(spark, sf):
    """Runs of one event type by user, as a stream whose state is each user's open run."""
    out, log = staging.fresh_path(spark), staging.fresh_path(spark)
    raw = stateless.read_folder(spark, sf, table(spark, sf, "events").schema, glob="events.parquet")
    runs = stateless.run_states(raw.select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), F.col("event_type").alias("value")))
    stateless.write_batches(runs, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), log, "update").awaitTermination()
    return spark.read.parquet(out).groupBy(F.col("key").alias("user_id")).agg(F.max("runs").alias("runs"), F.max("n").alias("n"))


@register("stream_clusters", """WITH h AS (SELECT l_linestatus AS chrom, l_orderkey * 10 + l_linenumber AS s, l_orderkey * 10 + l_linenumber + 3 AS e, l_returnflag || l_linenumber % 3 AS name FROM lineitem), f AS (SELECT * FROM h WHERE name IN ('N0', 'N1')), b AS (SELECT DISTINCT chrom, s FROM f), m AS (SELECT chrom, max(s) AS top FROM h GROUP BY 1)
  SELECT b.chrom, b.s AS "start", max(f.e) AS "end", count(*) AS n, string_agg(f.name, ',' ORDER BY f.s, f.e, f.name) AS names FROM b JOIN f ON f.chrom = b.chrom AND f.s >= b.s AND f.s < b.s + 12 JOIN m ON m.chrom = b.chrom WHERE b.s <= top - 12 GROUP BY 1, 2 HAVING count(*) FILTER (f.name = 'N0') >= 1 AND count(*) FILTER (f.name = 'N1') >= 2""")
def stream_clusters(spark, sf):
    """Windows of line items as a stream; those that more items could still join are not told."""
    out, log = staging.fresh_path(spark), staging.fresh_path(spark)
    raw = stateless.read_folder(spark, sf, table(spark, sf, "lineitem").schema, glob="lineitem.parquet")
    place = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    hits = raw.select(F.col("l_linestatus").alias("chrom"), place.cast("long").alias("start"), (place + 3).cast("long").alias("end"), F.concat("l_returnflag", (F.col("l_linenumber") % 3).cast("string")).alias("name"))
    found = stateless.window_clusters(hits, {"N0": 1, "N1": 2}, 12)
    stateless.write_batches(found, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), log).awaitTermination()
    return spark.read.parquet(out).select("chrom", "start", "end", "n", F.array_join("names", ",").alias("names"))


@register("only_new", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def only_new(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey")
    return stateless.only_new(o, o.where("o_orderkey % 3 = 0"), "o_orderkey")
