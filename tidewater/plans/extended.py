"""Queries of the difference, motif, alignment, transcript, significance and binary operators, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import difference as df
from ..operators import graph as gr
from ..operators import intervals as iv
from ..operators import motifs as mo
from ..operators import staging
from ..operators import transcripts as tr
from ..sources import binary
from .catalogue import _ROOMY_ITEMS, _ROOMY_SPANS, register, roomy_items, roomy_spans, table

# -- differences -----------------------------------------------------------------------------------------------------


@register("word_difference")
def word_difference(spark, sf):
    """Each document against the one before it of its source: words that stay, go and come."""
    pairs = df.with_previous(table(spark, sf, "documents"), "source", "doc_id", "text")
    return df.text_difference(pairs).select("id", "n_same", "n_deleted", "n_inserted", F.size("script").alias("n_runs"))


#: Names are short: every choice of a's words is tried against b, words fenced so that a pattern can skip between them.
@register("name_difference", """WITH n AS (SELECT p_partkey AS id, lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS a, p_name AS b FROM part),
  w AS (SELECT id, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM n WHERE a IS NOT NULL),
  m AS (SELECT id, x, y, list_transform(list_filter(range(1, len(x) + 1), lambda i: (k >> CAST(i - 1 AS BIGINT)) % 2 = 1), lambda i: x[i]) AS c FROM w, (SELECT unnest(range(0, 64)) AS k) WHERE k < (1 << len(x))),
  s AS (SELECT id, max(len(c)) AS n_same FROM m WHERE ('<' || array_to_string(y, '><') || '>') LIKE ('%' || CASE WHEN len(c) = 0 THEN '' ELSE '<' || array_to_string(c, '>%<') || '>' END || '%') GROUP BY 1)
  SELECT id, CAST(n_same AS BIGINT) AS n_same, CAST(len(x) - n_same AS BIGINT) AS n_deleted, CAST(len(y) - n_same AS BIGINT) AS n_inserted FROM w JOIN s USING (id)""")
def name_difference(spark, sf):
    pairs = df.with_previous(table(spark, sf, "part"), "p_brand", "p_partkey", "p_name")
    return df.text_difference(pairs).drop("script")


# -- components and motif families -----------------------------------------------------------------------------------


@register("components", """WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey * 7 % 1009 + 1 AS b FROM part WHERE p_size % 2 = 0), u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
  r AS (SELECT DISTINCT a AS node, a AS near FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.near = u.a) SELECT node, min(near) AS component FROM r GROUP BY 1""")
def components(spark, sf):
    k = F.col("p_partkey")
    return gr.components(table(spark, sf, "part").where("p_size % 2 = 0").select(k.alias("a"), (k * 7 % 1009 + 1).alias("b")))


#: Part keys spelled as words of eight bases; a word's genes are the suppliers of its part.
_WORD = "array_to_string(list_transform(range(0, 8), lambda i: substr('ACGT', CAST(1 + ({k} >> CAST(2 * i AS BIGINT)) % 4 AS BIGINT), 1)), '')"


def part_words(spark, sf):
    k = F.col("l_partkey") * 40503 % 65536
    word = F.concat(*[F.substring(F.lit("ACGT"), (F.shiftright(k, 2 * i) % 4 + 1).cast("int"), F.lit(1)) for i in range(8)])
    return table(spark, sf, "lineitem").select(word.alias("motif"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("gene"))


@register("motif_families", f"""WITH RECURSIVE p AS (SELECT DISTINCT l_partkey * 40503 % 65536 AS k, 's' || l_suppkey AS gene FROM lineitem), w AS (SELECT DISTINCT {_WORD.format(k="k")} AS motif, gene FROM p), m AS (SELECT DISTINCT motif FROM w),
  x AS (SELECT motif, i, left(motif, CAST(i AS BIGINT)) || '.' || substr(motif, CAST(i + 2 AS BIGINT)) AS mask FROM m, (SELECT unnest(range(0, 8)) AS i)), u AS (SELECT a.motif AS a, b.motif AS b FROM x a JOIN x b USING (mask) WHERE a.motif <> b.motif),
  r AS (SELECT motif, motif AS near FROM m UNION SELECT r.motif, u.b FROM r JOIN u ON r.near = u.a), f AS (SELECT motif, min(near) AS family FROM r GROUP BY 1),
  l AS (SELECT family, i, array_to_string(list_sort(list_distinct(list(substr(motif, CAST(i + 1 AS BIGINT), 1)))), '') AS bases FROM f, (SELECT unnest(range(0, 8)) AS i) GROUP BY 1, 2),
  c AS (SELECT family, string_agg(CASE bases WHEN 'CT' THEN 'Y' WHEN 'AG' THEN 'R' WHEN 'AC' THEN 'M' WHEN 'GT' THEN 'K' WHEN 'CG' THEN 'S' WHEN 'AT' THEN 'W' WHEN 'ACT' THEN 'H' WHEN 'CGT' THEN 'B' WHEN 'ACG' THEN 'V' WHEN 'AGT' THEN 'D' WHEN 'ACGT' THEN 'N' ELSE bases END, '' ORDER BY i) AS consensus FROM l GROUP BY 1),
  g AS (SELECT DISTINCT family, gene FROM w JOIN f USING (motif)), s AS (SELECT 's' || s_suppkey AS gene FROM supplier), h AS (SELECT 's' || s_suppkey AS gene FROM supplier WHERE s_nationkey < 12),
  q AS (SELECT (SELECT count(*) FROM h) * 1.0 / (SELECT count(*) FROM s) AS p), t AS (SELECT family, count(*) AS n, count(*) FILTER (gene IN (SELECT gene FROM h)) AS k FROM g GROUP BY 1), z AS (SELECT family, count(*) AS n_motifs FROM f GROUP BY 1)
  SELECT family, n_motifs, consensus, n AS n_genes, k AS n_foreground, round(-log10(least(1.0, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)))))), 6) + 0 AS score FROM z JOIN c USING (family) JOIN t USING (family), q""")
def motif_families(spark, sf):
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("gene")
    suppliers = table(spark, sf, "supplier")
    return mo.motif_families(part_words(spark, sf), suppliers.where("s_nationkey < 12").select(name), suppliers.select(name)).withColumn("score", F.round("score", 6) + 0)


# -- alignments ------------------------------------------------------------------------------------------------------

#: A block for each order: its key's digest as 32 bases; every line number is a row with one base changed and one gap.
_ALIGNED = """b AS (SELECT l_orderkey AS block, 'o' || l_linenumber AS org, translate(md5(CAST(l_orderkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s, min(l_partkey) % 30 AS p, min(l_suppkey) % 30 AS g FROM lineitem GROUP BY l_orderkey, l_linenumber),
  d AS (SELECT block, org, left(s, p) || 'A' || substr(s, p + 2) AS s, g FROM b), r AS (SELECT block, org, left(s, g) || '-' || substr(s, g + 2) AS seq FROM d)"""


def order_blocks(spark, sf):
    put = lambda s, at, c: F.concat(F.substr(s, F.lit(1), at), F.lit(c), F.substr(s, at + 2))
    base = F.translate(F.md5(F.col("l_orderkey").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.min("l_partkey") % 30).cast("int").alias("p"), (F.min("l_suppkey") % 30).cast("int").alias("g"))
    return lines.select(F.col("l_orderkey").alias("block"), F.concat(F.lit("o"), F.col("l_linenumber").cast("string")).alias("org"), put(put(base, F.col("p"), "A"), F.col("g"), "-").alias("seq"))


_CONSENSUS = _ALIGNED + """, x AS (SELECT block, org, i, substr(seq, CAST(i AS BIGINT), 1) AS c FROM r, (SELECT unnest(range(1, 33)) AS i)),
  y AS (SELECT block, i, max(c) FILTER (org = 'o1') AS own, count(*) FILTER (org <> 'o1' AND c = '-') AS gaps, array_to_string(list_sort(list_distinct(list(c))), '') AS bases FROM x GROUP BY 1, 2),
  z AS (SELECT block, i, own, CASE WHEN own = '-' THEN '-' WHEN gaps > 0 THEN '#' ELSE CASE bases WHEN 'CT' THEN 'Y' WHEN 'AG' THEN 'R' WHEN 'AC' THEN 'M' WHEN 'GT' THEN 'K' WHEN 'CG' THEN 'S' WHEN 'AT' THEN 'W' WHEN 'ACT' THEN 'H' WHEN 'CGT' THEN 'B' WHEN 'ACG' THEN 'V' WHEN 'AGT' THEN 'D' WHEN 'ACGT' THEN 'N' ELSE bases END END AS code FROM y WHERE own IS NOT NULL),
  k AS (SELECT block, string_agg(own, '' ORDER BY i) AS ref, string_agg(code, '' ORDER BY i) AS consensus, CAST(count(*) FILTER (code IN ('A', 'C', 'G', 'T')) AS BIGINT) AS score FROM z GROUP BY 1)"""


@register("block_consensus", f"WITH {_CONSENSUS} SELECT block, ref, consensus, score FROM k")
def block_consensus(spark, sf):
    return mo.block_consensus(order_blocks(spark, sf), "o1")


@register("consensus_hits", f"""WITH {_CONSENSUS}, p AS (SELECT * FROM (VALUES ('ACRY', '+', '[A][C][AGR][CTY]'), ('ACRY', '-', '[AGR][CTY][G][T]'), ('TNG', '+', '[T][ACGTYRMKSWHBVDN][G]'), ('TNG', '-', '[C][ACGTYRMKSWHBVDN][A]')) AS t(motif, strand, pattern))
  SELECT block, motif, strand, i - 1 AS "column", i - 1 - (length(left(ref, i - 1)) - length(replace(left(ref, i - 1), '-', ''))) AS "start", i - 1 - (length(left(ref, i - 1)) - length(replace(left(ref, i - 1), '-', ''))) + length(motif) AS "end", score
  FROM k, p, (SELECT unnest(range(1, 33)) AS i) WHERE regexp_full_match(substr(consensus, CAST(i AS BIGINT), length(motif)), pattern)""")
def consensus_hits(spark, sf):
    return mo.consensus_hits(order_blocks(spark, sf), "o1", ["ACRY", "TNG"])


@register("alignment_slices", f"""WITH {_ALIGNED}, o AS (SELECT block, seq AS ref FROM r WHERE org = 'o1'), q AS (SELECT o_orderkey AS block, o_custkey % 20 AS s, o_custkey % 20 + 6 AS e FROM orders), l AS (SELECT block, i, row_number() OVER (PARTITION BY block ORDER BY i) - 1 AS k FROM o, (SELECT unnest(range(1, 33)) AS i) WHERE substr(ref, CAST(i AS BIGINT), 1) <> '-'),
  c AS (SELECT q.block, s, e, a.i - 1 AS first, z.i AS last FROM q JOIN l a ON a.block = q.block AND a.k = s JOIN l z ON z.block = q.block AND z.k = e - 1)
  SELECT c.block, s AS "start", e AS "end", first, last, org, substr(seq, CAST(first + 1 AS BIGINT), CAST(last - first AS BIGINT)) AS seq FROM c JOIN r USING (block)""")
def alignment_slices(spark, sf):
    start = F.col("o_custkey") % 20
    return mo.alignment_slices(order_blocks(spark, sf), "o1", table(spark, sf, "orders").select(F.col("o_orderkey").alias("block"), start.alias("start"), (start + 6).alias("end")))


@register("ungapped_blocks", f"""WITH {_ALIGNED}, x AS (SELECT block, i, count(*) FILTER (substr(seq, CAST(i AS BIGINT), 1) = '-') AS gaps FROM r, (SELECT unnest(range(1, 33)) AS i) GROUP BY 1, 2),
  f AS (SELECT block, i, i - row_number() OVER (PARTITION BY block ORDER BY i) AS run FROM x WHERE gaps = 0), s AS (SELECT block, min(i) - 1 AS c, count(*) AS w FROM f GROUP BY block, run HAVING count(*) >= 3),
  n AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY c) - 1 AS part FROM s)
  SELECT block, part, c AS "column", org, CAST(c - (length(left(seq, CAST(c AS BIGINT))) - length(replace(left(seq, CAST(c AS BIGINT)), '-', ''))) AS BIGINT) AS "start", substr(seq, CAST(c + 1 AS BIGINT), CAST(w AS BIGINT)) AS seq FROM n JOIN r USING (block)""")
def ungapped_blocks(spark, sf):
    return mo.ungapped_blocks(order_blocks(spark, sf), 3)


@register("aligned_columns", f"""WITH {_ALIGNED}, o AS (SELECT a.block, a.seq AS a, b.seq AS b FROM r a JOIN r b USING (block) WHERE a.org = 'o1' AND b.org = 'o2'), c AS (SELECT block, i, substr(a, CAST(i AS BIGINT), 1) AS x, substr(b, CAST(i AS BIGINT), 1) AS y FROM o, (SELECT unnest(range(1, 33)) AS i)),
  n AS (SELECT *, sum(CASE WHEN x <> '-' THEN 1 ELSE 0 END) OVER w - 1 AS p, sum(CASE WHEN y <> '-' THEN 1 ELSE 0 END) OVER w - 1 AS q FROM c WINDOW w AS (PARTITION BY block ORDER BY i))
  SELECT block, CAST(p AS BIGINT) AS place, x AS base, CASE WHEN y = '-' THEN ' ' WHEN x = y THEN '|' ELSE '.' END AS kind, nullif(y, '-') AS aligned, CASE WHEN y <> '-' THEN CAST(q AS BIGINT) END AS other_place FROM n WHERE x <> '-'""")
def aligned_columns(spark, sf):
    return mo.aligned_columns(order_blocks(spark, sf), "o1", "o2")


# -- matrices with a core --------------------------------------------------------------------------------------------

#: Six positions, of which the third says least and is not in the core.
MATRIX = [[8, 0, 1, 1], [0, 9, 0, 1], [3, 3, 2, 2], [1, 1, 7, 1], [0, 0, 1, 9], [9, 1, 0, 0]]
_ROWS = ", ".join(f"({i + 1}, {j + 1}, {x}.001)" for i, row in enumerate(MATRIX) for j, x in enumerate(row))
_DNA = "translate(md5(p_name), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@register("core_hits", f"""WITH s AS (SELECT CAST(p_partkey AS VARCHAR) AS id, {_DNA} AS seq FROM part), t AS (SELECT id, '+' AS strand, seq FROM s UNION ALL SELECT id, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM s),
  m AS (SELECT i, j, CAST(c AS DOUBLE) / sum(CAST(c AS DOUBLE)) OVER (PARTITION BY i) AS f FROM (VALUES {_ROWS}) AS v(i, j, c)), q AS (SELECT i, j, f * sum(f * ln(4 * f)) OVER (PARTITION BY i) AS w FROM m),
  e AS (SELECT i, min(w) AS lo, max(w) AS hi FROM q GROUP BY 1), z AS (SELECT sum(lo) AS lo, sum(hi) AS hi, sum(lo) FILTER (i <> 3) AS clo, sum(hi) FILTER (i <> 3) AS chi FROM e),
  p AS (SELECT id, strand, spot, sum(w) AS all_w, sum(w) FILTER (i <> 3) AS core_w FROM t, (SELECT unnest(range(1, 28)) AS spot), q WHERE substr('ACGT', j, 1) = substr(seq, CAST(spot + i - 1 AS BIGINT), 1) GROUP BY 1, 2, 3)
  SELECT id, CASE WHEN strand = '+' THEN spot - 1 ELSE 27 - spot END AS "start", round((core_w - clo) / (chi - clo), 6) AS core, round((all_w - lo) / (hi - lo), 6) AS score, strand FROM p, z WHERE (core_w - clo) / (chi - clo) >= 0.6 AND (all_w - lo) / (hi - lo) >= 0.65""")
def core_hits(spark, sf):
    seqs = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.expr(_DNA).alias("seq"))
    return mo.core_hits(seqs, {"m": MATRIX}, 0.6, 0.65).select("id", "start", F.round("core", 6).alias("core"), F.round("score", 6).alias("score"), "strand")


@register("disjoint_hits")
def disjoint_hits(spark, sf):
    seqs = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.expr(_DNA).alias("seq"))
    return mo.disjoint_hits(mo.core_hits(seqs, {"m": MATRIX, "n": MATRIX[:3]}, 0.4, 0.5))


@register("conserved_hits")
def conserved_hits(spark, sf):
    return mo.conserved_hits(order_blocks(spark, sf), "o1", {"m": MATRIX}, 0.4, 0.5, 2)


@register("motif_windows", """WITH h AS (SELECT l_linestatus AS chrom, l_orderkey * 10 + l_linenumber AS s, l_orderkey * 10 + l_linenumber + 3 AS e, l_returnflag || l_linenumber % 3 AS name FROM lineitem), f AS (SELECT * FROM h WHERE name IN ('N0', 'N1')), b AS (SELECT DISTINCT chrom, s FROM f)
  SELECT b.chrom, b.s AS "start", max(f.e) AS "end", count(*) AS n, string_agg(f.s || ':' || f.name, ',' ORDER BY f.s, f.e, f.name) AS members FROM b JOIN f ON f.chrom = b.chrom AND f.s >= b.s AND f.s < b.s + 12 GROUP BY 1, 2 HAVING count(*) FILTER (f.name = 'N0') >= 1 AND count(*) FILTER (f.name = 'N1') >= 2""")
def motif_windows(spark, sf):
    place = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    hits = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("chrom"), place.alias("start"), (place + 3).alias("end"), F.concat("l_returnflag", (F.col("l_linenumber") % 3).cast("string")).alias("name"))
    shown = F.array_join(F.transform("members", lambda m: F.concat(m["start"].cast("string"), F.lit(":"), m["name"])), ",")
    return mo.motif_windows(hits, {"N0": 1, "N1": 2}, 12).withColumn("members", shown)


# -- tracks ----------------------------------------------------------------------------------------------------------


@register("position_counts", f"""WITH {_ROOMY_ITEMS}, e AS (SELECT chrom, greatest("start" - 999, 0) AS pos, 1 AS change FROM items UNION ALL SELECT chrom, "start" + 1, -1 FROM items), p AS (SELECT chrom, pos, sum(change) AS change FROM e GROUP BY 1, 2 HAVING sum(change) <> 0),
  l AS (SELECT chrom, pos AS "start", lead(pos) OVER w AS "end", sum(change) OVER w AS n FROM p WINDOW w AS (PARTITION BY chrom ORDER BY pos)) SELECT chrom, "start", "end", CAST(n AS BIGINT) AS n FROM l WHERE n > 0""")
def position_counts(spark, sf):
    return iv.position_counts(roomy_items(spark, sf), 1000)


@register("covered_blocks", """WITH f AS (SELECT l_orderkey AS o, l_linestatus AS chrom, l_linenumber * 10 AS s, l_linenumber * 10 + CAST(l_quantity AS BIGINT) % 25 AS e, l_returnflag AS flag FROM lineitem WHERE CAST(l_quantity AS BIGINT) % 25 > 0),
  g AS (SELECT *, max(e) OVER (PARTITION BY o, chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY o, chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM g),
  b AS (SELECT o, chrom, run, min(s) AS s, max(e) AS e FROM i GROUP BY 1, 2, 3), t AS (SELECT o, chrom, string_agg(DISTINCT flag, ',' ORDER BY flag) AS members FROM f GROUP BY 1, 2), z AS (SELECT o, chrom, min(s) AS first FROM b GROUP BY 1, 2)
  SELECT o AS l_orderkey, chrom, min(s) AS "start", max(e) AS "end", count(*) AS block_count, string_agg(e - s, ',' ORDER BY s) AS block_sizes, string_agg(s - first, ',' ORDER BY s) AS block_starts, members FROM b JOIN z USING (o, chrom) JOIN t USING (o, chrom) GROUP BY o, chrom, members""")
def covered_blocks(spark, sf):
    place = F.col("l_linenumber") * 10
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linestatus").alias("chrom"), place.alias("start"), (place + F.col("l_quantity").cast("long") % 25).alias("end"), "l_returnflag")
    out = iv.covered_blocks(lines, ["l_orderkey"], "l_returnflag")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("l_orderkey", "chrom", "start", "end", "block_count", text("block_sizes"), text("block_starts"), text("members"))


@register("independent_shuffle", f"""WITH {_ROOMY_SPANS} SELECT count(*) AS n, CAST(sum("start") AS BIGINT) AS starts, CAST(sum("end" - "start") AS BIGINT) AS bp, count(DISTINCT name) AS names, count(*) FILTER (chrom = 'F') AS on_f FROM spans""")
def independent_shuffle(spark, sf):
    """Starts, lengths, names and chromosomes are those of the track, put together anew."""
    s = iv.independent_shuffle(roomy_spans(spark, sf), 5)
    return s.agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum(F.col("end") - F.col("start")).alias("bp"), F.count_distinct("name").alias("names"), F.count_if(F.col("chrom") == "F").alias("on_f"))


# -- transcripts -----------------------------------------------------------------------------------------------------

#: An order's lines as exons; the other set moves an end, a start, the coding part or all of it, by customer.
_TRANSCRIPTS = """l AS (SELECT l_orderkey AS o, list_sort(list(l_linenumber * 20)) AS s, list_sort(list(l_linenumber * 20 + 5 + l_linenumber)) AS e FROM lineitem GROUP BY 1),
  a AS (SELECT o, 't' || o AS name, 'chr' || o % 3 AS chrom, CASE WHEN o % 2 = 0 THEN '-' ELSE '+' END AS strand, s[1] AS ts, e[len(e)] AS te, s[1] + 2 AS cs, e[len(e)] AS ce, s, e FROM l),
  k AS (SELECT a.*, o_custkey % 6 AS v FROM a JOIN orders ON o = o_orderkey),
  b AS (SELECT name, chrom, strand, CASE v WHEN 2 THEN ts - 3 WHEN 4 THEN ts + 500 ELSE ts END AS ts, CASE v WHEN 1 THEN te + 4 WHEN 4 THEN te + 500 WHEN 5 THEN te + 60 ELSE te END AS te, CASE v WHEN 3 THEN cs + 1 WHEN 4 THEN cs + 500 ELSE cs END AS cs, CASE v WHEN 4 THEN ce + 500 ELSE ce END AS ce, v,
    CASE v WHEN 2 THEN list_concat([s[1] - 3], s[2:]) WHEN 4 THEN list_transform(s, lambda x: x + 500) ELSE s END AS s, CASE v WHEN 1 THEN list_concat(e[1 : len(e) - 1], [te + 4]) WHEN 4 THEN list_transform(e, lambda x: x + 500) WHEN 5 THEN list_concat(e[1 : len(e) - 1], [te + 60]) ELSE e END AS e FROM k)"""


def order_transcripts(spark, sf):
    """Both sets of transcripts."""
    n = F.col("l_linenumber")
    parts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list((n * 20).cast("long"))).alias("exon_starts"), F.array_sort(F.collect_list((n * 20 + 5 + n).cast("long"))).alias("exon_ends"))
    name = F.concat(F.lit("t"), F.col("o").cast("string"))
    start, end = F.col("exon_starts")[0], F.element_at("exon_ends", -1)
    a = parts.select("o", name.alias("name"), F.concat(F.lit("chr"), (F.col("o") % 3).cast("string")).alias("chrom"), F.when(F.col("o") % 2 == 0, "-").otherwise("+").alias("strand"), start.alias("tx_start"), end.alias("tx_end"), (start + 2).alias("cds_start"), end.alias("cds_end"), "exon_starts", "exon_ends")
    k = a.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("o"), (F.col("o_custkey") % 6).alias("v")), "o")
    v = F.col("v")
    moved = lambda c: F.transform(c, lambda x: x + F.when(v == 4, 500).otherwise(0))
    starts = F.transform(moved("exon_starts"), lambda x, i: x - F.when((v == 2) & (i == 0), 3).otherwise(0))
    ends = F.transform(moved("exon_ends"), lambda x, i: x + F.when(i == F.size("exon_ends") - 1, F.when(v == 1, 4).when(v == 5, 60).otherwise(0)).otherwise(0))
    b = k.select("name", "chrom", "strand", (F.col("tx_start") + F.when(v == 2, -3).when(v == 4, 500).otherwise(0)).alias("tx_start"), (F.col("tx_end") + F.when(v == 1, 4).when(v == 4, 500).when(v == 5, 60).otherwise(0)).alias("tx_end"), (F.col("cds_start") + F.when(v == 3, 1).when(v == 4, 500).otherwise(0)).alias("cds_start"), (F.col("cds_end") + F.when(v == 4, 500).otherwise(0)).alias("cds_end"), starts.alias("exon_starts"), ends.alias("exon_ends"))
    return a.drop("o"), b


@register("transcript_classes", f"""WITH {_TRANSCRIPTS} SELECT name, v = 0 AS exact, a.ts = b.ts AND a.te = b.te AS same_place, v <> 4 OR len(a.s) = 1 AS same_introns, v IN (0, 1, 2, 5) AS same_coding,
  abs(a.ts - b.ts) < 10 AND abs(a.te - b.te) < 10 AS "close", v = 2 AS start_close, v = 1 AS end_close, a.ts < b.te AND b.ts < a.te AS overlap FROM a JOIN b USING (name)""")
def transcript_classes(spark, sf):
    return tr.same_name_classes(*order_transcripts(spark, sf))


@register("transcript_totals", f"""WITH {_TRANSCRIPTS}, c AS (SELECT v, a.ts = b.ts AND a.te = b.te AS place, len(a.s) AS n, abs(a.ts - b.ts) < 10 AND abs(a.te - b.te) < 10 AS near, a.ts < b.te AND b.ts < a.te AS over FROM a JOIN b USING (name))
  SELECT count(*) AS n_common, count(*) FILTER (v = 0) AS n_exact, count(*) FILTER (v = 3) AS n_same_place, count(*) FILTER (NOT place AND (v <> 4 OR n = 1)) AS n_same_introns, count(*) FILTER (NOT place AND v IN (1, 2, 5)) AS n_same_coding,
  count(*) FILTER (NOT place AND near) AS n_close, count(*) FILTER (v = 2) AS n_start_close, count(*) FILTER (v = 1) AS n_end_close, count(*) FILTER (NOT place AND over) AS n_overlap, count(*) FILTER (NOT place AND NOT over) AS n_apart FROM c""")
def transcript_totals(spark, sf):
    return tr.class_totals(tr.same_name_classes(*order_transcripts(spark, sf)))


@register("transcript_matches", f"""WITH {_TRANSCRIPTS}, x AS (SELECT chrom, strand, s, e, min(name) AS other, count(*) AS n FROM b GROUP BY ALL), y AS (SELECT chrom, strand, s[2:] AS s, e[1 : len(e) - 1] AS e, min(name) AS other, count(*) AS n FROM b WHERE len(s) > 1 GROUP BY ALL),
  p AS (SELECT chrom, strand, ts, te, min(name) AS other, count(*) AS n FROM b GROUP BY ALL), q AS (SELECT chrom, strand, ts, te FROM a GROUP BY ALL), z AS (SELECT q.chrom, q.strand, q.ts, q.te, min(other) AS other, CAST(sum(n) AS BIGINT) AS n FROM q JOIN p ON p.chrom = q.chrom AND p.strand = q.strand AND abs(p.ts - q.ts) < 10 AND abs(p.te - q.te) < 10 GROUP BY ALL)
  SELECT a.name, CASE WHEN x.n > 0 THEN 'exons' WHEN y.n > 0 THEN 'introns' WHEN z.n > 0 THEN 'near' ELSE 'none' END AS kind, coalesce(x.other, y.other, z.other) AS other, coalesce(x.n, y.n, z.n, 0) AS n FROM a LEFT JOIN x ON x.chrom = a.chrom AND x.strand = a.strand AND x.s = a.s AND x.e = a.e
  LEFT JOIN y ON len(a.s) > 1 AND y.chrom = a.chrom AND y.strand = a.strand AND y.s = a.s[2:] AND y.e = a.e[1 : len(a.e) - 1] LEFT JOIN z ON z.chrom = a.chrom AND z.strand = a.strand AND z.ts = a.ts AND z.te = a.te""")
def transcript_matches(spark, sf):
    return tr.structure_matches(*order_transcripts(spark, sf))


# -- binary matrices -------------------------------------------------------------------------------------------------


@register("binary_matrix", "SELECT l_orderkey || '_' || l_linenumber AS key, CAST(l_quantity AS DOUBLE) AS v0, CAST(l_linenumber AS DOUBLE) AS v1 FROM lineitem")
def binary_matrix(spark, sf):
    """Line items written as a matrix of two columns and read back."""
    binary.register(spark)
    path = staging.fresh_path(spark)
    rows = table(spark, sf, "lineitem").select(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("key"), F.array(F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")).alias("values"))
    rows.write.format("tidewater_matrix").mode("append").option("path", path.removeprefix("file://")).save()
    back = spark.read.format("tidewater_matrix").option("path", path.removeprefix("file://")).load()
    return back.select("key", F.col("values")[0].alias("v0"), F.col("values")[1].alias("v1"))


@register("scaled_points", "WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS z, min(l_partkey) AS b, max(l_partkey) AS y FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(floor(CAST(l_quantity - a AS DOUBLE) / CAST(z - a AS DOUBLE) * 65535) AS BIGINT) AS x, CAST(floor(CAST(l_partkey - b AS DOUBLE) / CAST(y - b AS DOUBLE) * 65535) AS BIGINT) AS y FROM lineitem, e")
def scaled_points(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("x"), F.col("l_partkey").cast("double").alias("y"))
    return binary.scaled(rows, ["x", "y"])
