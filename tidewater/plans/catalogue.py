"""The query catalogue on the driver tables and the DuckDB SQL that states each query's result.

Orders and line items also serve as intervals: chrom is the line or order status, start the order key, and the length
comes from quantity or customer key. Doubles are rounded on both sides where the order of a sum could show.
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
from ..operators import table as tb
from ..operators import text as tx
from ..sources import sequences as src
from ..sources import sinks

QUERIES, ORACLE_SQL = {}, {}


def register(name: str, sql: str | None = None):
    """Register a query under name, with its DuckDB counterpart."""

    if name in QUERIES:
        raise ValueError(f"{name} is registered already")

    def add(query):
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = sql
        return query

    return add


def table(spark, sf_dir: str, name: str, *columns: str):
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def items(spark, sf_dir):
    """Line items as intervals."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("chrom"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.floor("l_quantity")).alias("end"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("name"), F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise("+").alias("strand"))


def spans(spark, sf_dir):
    """Orders as intervals."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("chrom"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.col("o_custkey") % 20 + 1).alias("end"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"))


def roomy_items(spark, sf_dir):
    """All line items as intervals 10 positions apart, so that neighbours overlap or leave a gap."""
    place = F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10
    return table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("chrom"), place.alias("start"), (place + F.floor("l_quantity")).alias("end"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("name"), F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise("+").alias("strand"))


def roomy_spans(spark, sf_dir):
    """All orders as intervals, starts 8 positions apart, so that some overlap and some leave a gap."""
    place = F.col("o_orderkey") * 8
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("chrom"), place.alias("start"), (place + F.col("o_custkey") % 20 + 1).alias("end"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"))


def spots(spark, sf_dir):
    """All line items as intervals of one position among the roomy orders."""
    place = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("chrom"), place.alias("start"), (place + 1).alias("end"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("name"))


_ITEMS = """items AS (SELECT l_linestatus AS chrom, l_orderkey AS "start", l_orderkey + CAST(floor(l_quantity) AS BIGINT) AS "end",
  l_orderkey || '_' || l_linenumber AS name, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand FROM lineitem)"""
_SPANS = """spans AS (SELECT o_orderstatus AS chrom, o_orderkey AS "start", o_orderkey + o_custkey % 20 + 1 AS "end", 'o' || o_orderkey AS name FROM orders)"""
_ROOMY_SPANS = """spans AS (SELECT o_orderstatus AS chrom, o_orderkey * 8 AS "start", o_orderkey * 8 + o_custkey % 20 + 1 AS "end", 'o' || o_orderkey AS name FROM orders)"""
_SPOTS = """spots AS (SELECT l_linestatus AS chrom, l_orderkey * 8 + l_linenumber AS "start", l_orderkey * 8 + l_linenumber + 1 AS "end", l_orderkey || '_' || l_linenumber AS name FROM lineitem)"""
_ROOMY_ITEMS = """items AS (SELECT l_linestatus AS chrom, l_orderkey * 100 + l_linenumber * 10 AS "start", l_orderkey * 100 + l_linenumber * 10 + CAST(floor(l_quantity) AS BIGINT) AS "end",
  l_orderkey || '_' || l_linenumber AS name, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand FROM lineitem)"""
_OVER = 'a.chrom = b.chrom AND a."start" < b."end" AND b."start" < a."end"'


# -- columns, lookups, filters ---------------------------------------------------------------------------------------


@register("cut_columns", "SELECT p_partkey, p_brand, '' AS empty FROM part WHERE p_brand <> ''")
def cut_columns(spark, sf):
    return tb.cut(table(spark, sf, "part"), 0, "p_brand", "empty", drop_incomplete=True)


@register("filter_rows", "SELECT upper(p_type) AS prefix, p_partkey, p_size FROM part WHERE p_size > 10 AND p_type LIKE '%A%'")
def filter_rows(spark, sf):
    return tb.filter_rows(table(spark, sf, "part"), "p_size > 10 and p_type like '%A%'", ["p_partkey", "p_size", "p_name"], ["p_name"], "upper(p_type)")


@register("drop_constant_columns", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def drop_constant_columns(spark, sf):
    return tb.drop_constant_columns(table(spark, sf, "nation").withColumn("same", F.lit("x")))


@register("first_sentence", "SELECT doc_id, CASE WHEN strpos(text, '. ') > 0 THEN left(text, strpos(text, '. ') - 1) ELSE text END AS first_sentence FROM documents")
def first_sentence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tb.first_sentence("text").alias("first_sentence"))


@register("share_of_total", "SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER (), 9) AS share FROM supplier")
def share_of_total(spark, sf):
    return tb.share_of_total(table(spark, sf, "supplier", "s_suppkey", "s_acctbal"), "s_acctbal").select("s_suppkey", F.round("share", 9).alias("share"))


@register("make_unique", "SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) > 1 THEN p_brand || '_DUP_' || p_partkey ELSE p_brand END AS p_brand FROM part")
def make_unique(spark, sf):
    return tb.make_unique(table(spark, sf, "part", "p_partkey", "p_brand"), "p_brand", ["p_partkey"], "p_partkey")


@register("replace_values", "SELECT n_nationkey, CASE WHEN r_name IS NULL THEN CAST(n_regionkey AS VARCHAR) ELSE r_name END AS n_regionkey FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
def replace_values(spark, sf):
    mapping = table(spark, sf, "region").where("r_regionkey < 3").select(F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("value"))
    return tb.replace_values(table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("n_regionkey")), "n_regionkey", mapping)


@register("append_lookup", "SELECT c_custkey, coalesce(n_name, 'NONE') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0")
def append_lookup(spark, sf):
    mapping = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    return tb.append_lookup(table(spark, sf, "customer", "c_custkey", "c_nationkey"), "c_nationkey", mapping, "nation", "NONE").select("c_custkey", "nation")


@register("join_or_none", "SELECT c_custkey, c_name, coalesce(CAST(o_orderkey AS VARCHAR), 'NONE') AS o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_or_none(spark, sf):
    return tb.join_or_none(table(spark, sf, "customer", "c_custkey", "c_name"), table(spark, sf, "orders", "o_custkey", "o_orderkey"), "c_custkey", "o_custkey", "NONE")


@register("lookup_lists", "SELECT c_custkey, coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority), 'noJoinPossible') AS priorities FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def lookup_lists(spark, sf):
    pairs = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"))
    return tb.lookup_lists(table(spark, sf, "customer", "c_custkey"), "c_custkey", pairs, "priorities")


@register("lookup_expand", "SELECT c_custkey, o_orderpriority AS priority FROM customer JOIN orders ON c_custkey = o_custkey")
def lookup_expand(spark, sf):
    pairs = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"))
    return tb.lookup_lists(table(spark, sf, "customer", "c_custkey"), "c_custkey", pairs, "priority", expand=True)


@register("dictionary_last", "SELECT o_custkey AS key, max_by(o_orderstatus, o_orderkey) AS value FROM orders GROUP BY 1")
def dictionary_last(spark, sf):
    return tb.dictionary(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", ["o_orderkey"], "last")


@register("filter_in", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def filter_in(spark, sf):
    return tb.keep_in(table(spark, sf, "customer", "c_custkey", "c_name"), "c_custkey", table(spark, sf, "orders").where("o_orderstatus = 'F'"), "o_custkey")


@register("filter_not_in", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def filter_not_in(spark, sf):
    """Customers without an urgent order."""
    return tb.keep_in(table(spark, sf, "customer", "c_custkey", "c_name"), "c_custkey", table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'"), "o_custkey", invert=True)


@register("filter_prefix_in", "SELECT p_partkey, p_type FROM part WHERE left(p_type, 3) IN (SELECT left(p_type, 3) FROM part WHERE p_size > 45)")
def filter_prefix_in(spark, sf):
    return tb.keep_in(table(spark, sf, "part", "p_partkey", "p_type"), "p_type", table(spark, sf, "part").where("p_size > 45"), "p_type", prefix=3)


@register("filter_by_fields", "SELECT DISTINCT doc_id FROM (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w IN ('the', 'of', 'and') GROUP BY 1) WHERE n >= 5")
def filter_by_fields(spark, sf):
    keys = spark.createDataFrame([("the",), ("of",), ("and",)], "k string")
    return tb.keep_by_fields(table(spark, sf, "documents"), "text", keys, "k", 5, separators=" ").select("doc_id")


@register("filter_containing", "SELECT p_partkey FROM part WHERE p_name LIKE '%re%' OR p_name LIKE '%an%'")
def filter_containing(spark, sf):
    return tb.keep_containing(table(spark, sf, "part"), "p_name", spark.createDataFrame([("re",), ("an",)], "k string"), "k").select("p_partkey")


@register("first_per_key", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def first_per_key(spark, sf):
    return tb.first_per(table(spark, sf, "orders", "o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@register("repeated_keys", "SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS values FROM orders GROUP BY 1 HAVING count(*) BETWEEN 2 AND 12")
def repeated_keys(spark, sf):
    return tb.repeated_keys(table(spark, sf, "orders"), "o_custkey", "o_orderkey", 2, 12)


@register("multimap_filter", """SELECT o_custkey AS key, v AS value FROM (SELECT o_custkey, list(DISTINCT o_orderstatus) AS vs FROM orders GROUP BY 1), unnest(vs) AS u(v)
  WHERE len(vs) < 4 AND len(vs) > 1 AND NOT list_contains(vs, 'P')""")
def multimap_filter(spark, sf):
    return tb.multimap_filter(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", fewer_than=4, more_than=1, not_value="^P$")


@register("common_lines", "SELECT o_orderpriority FROM orders JOIN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus = 'P') USING (o_orderpriority)")
def common_lines(spark, sf):
    o = table(spark, sf, "orders", "o_orderpriority", "o_orderstatus")
    return tb.common_lines(o.select("o_orderpriority"), o.where("o_orderstatus = 'P'"), "o_orderpriority", False)


@register("id_intersect", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def id_intersect(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderstatus")
    of = lambda s: o.where(F.col("o_orderstatus") == s).select("o_custkey")
    return tb.id_intersect(of("F").distinct(), "o_custkey", of("O"), of("P"))


@register("id_remove", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def id_remove(spark, sf):
    """Customers without an order; all orders count."""
    return tb.id_remove(table(spark, sf, "customer"), "c_custkey", table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")))


@register("union_tagged", "SELECT c_custkey AS id, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def union_tagged(spark, sf):
    return tb.union_tagged({"customer": table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "supplier": table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))})


@register("ordered_pairs", "SELECT a.n_regionkey, a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def ordered_pairs(spark, sf):
    return tb.ordered_pairs(table(spark, sf, "nation"), "n_name", "n_regionkey")


@register("coalesce_sources", """SELECT key, value, source FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn) AS rn FROM (
  SELECT o_custkey AS key, max(o_orderpriority) AS value, 'first' AS source, 0 AS turn FROM orders WHERE o_orderstatus = 'P' GROUP BY 1
  UNION ALL SELECT c_custkey, c_mktsegment, 'second', 1 FROM customer)) WHERE rn = 1""")
def coalesce_sources(spark, sf):
    first = table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderpriority").alias("value"))
    second = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    return tb.coalesce_sources("key", "value", ("first", first), ("second", second))


@register("two_hop_lookup", "SELECT c_custkey, c_nationkey, n_regionkey AS region, r_name AS region_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def two_hop_lookup(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("value"))
    b = table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    return tb.two_hop(table(spark, sf, "customer", "c_custkey", "c_nationkey"), "c_nationkey", a, b, ("region", "region_name"))


@register("cogroup_counts", """SELECT k AS o_custkey, a AS n_left, b AS n_right FROM (SELECT o_custkey AS k, count(*) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
  JOIN (SELECT o_custkey AS k, count(*) AS b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) USING (k)""")
def cogroup_counts(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderstatus")
    both = tb.cogroup_lists(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey")
    return both.select("o_custkey", F.size("left_rows").cast("long").alias("n_left"), F.size("right_rows").cast("long").alias("n_right"))


# -- reshaping -------------------------------------------------------------------------------------------------------


@register("expand_multi", "SELECT doc_id, trim(unnest(string_split(text, '|'))) AS part FROM documents")
def expand_multi(spark, sf):
    return tb.expand(table(spark, sf, "documents").select("doc_id", F.col("text").alias("part")), "part").select("doc_id", F.trim("part").alias("part"))


@register("collapse_distinct", "SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1")
def collapse_distinct(spark, sf):
    return tb.collapse(table(spark, sf, "orders", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_custkey")


@register("flatten_values", "SELECT n_regionkey, string_agg(n_name, '/' ORDER BY n_name) AS values FROM nation GROUP BY 1")
def flatten_values(spark, sf):
    return tb.flatten_values(table(spark, sf, "nation"), "n_regionkey", "n_name")


@register("presence_matrix", """SELECT o_custkey, CAST(max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS o_orderstatus_f,
  CAST(max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o_orderstatus_o, CAST(max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS o_orderstatus_p FROM orders GROUP BY 1""")
def presence_matrix(spark, sf):
    return tb.presence_matrix(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


@register("crosstab", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def crosstab(spark, sf):
    return tb.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@register("symmetric_matrix", """WITH v AS (SELECT l_suppkey AS a, l_suppkey + 1 AS b, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1, 2), w AS (SELECT * FROM v UNION ALL SELECT b, a, value FROM v)
  SELECT a, b, max(value) AS value FROM w GROUP BY 1, 2 UNION ALL SELECT DISTINCT a, a, 1.0 FROM w""")
def symmetric_matrix(spark, sf):
    v = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") + 1).alias("b")).agg(F.round(F.sum("l_quantity"), 2).alias("value"))
    return tb.symmetric_long(v, "a", "b", "value")


@register("wide_outer_join", """SELECT coalesce(a.k, b.k) AS key, a.v AS f, b.v AS o FROM (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
  FULL JOIN (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k""")
def wide_outer_join(spark, sf):
    of = lambda s: table(spark, sf, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("value"))
    return tb.outer_none({"f": of("F"), "o": of("O")})


@register("records_to_wide", "SELECT event_id, event_type AS kind, 'NOTFOUND' AS other FROM events")
def records_to_wide(spark, sf):
    made = table(spark, sf, "events").select("event_id", F.concat(F.lit("kind="), "event_type", F.lit(";user="), F.col("user_id").cast("string")).alias("props"))
    return tb.records_to_wide(made, "event_id", "props", ["kind", "other"])


# -- aggregates ------------------------------------------------------------------------------------------------------


@register("uniq_count_ratio", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM orders) AS DOUBLE), 9) AS share FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def uniq_count_ratio(spark, sf):
    return ag.uniq_counts(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], more_than=1).withColumn("share", F.round("share", 9))


@register("group_stats", "SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY 1, 2")
def group_stats(spark, sf):
    return ag.group_stats(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity").withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@register("column_sums", "SELECT round(sum(l_quantity), 2) AS l_quantity, round(sum(l_tax), 2) AS l_tax, CAST(NULL AS DOUBLE) AS l_returnflag FROM lineitem")
def column_sums(spark, sf):
    out = ag.column_sums(table(spark, sf, "lineitem"), ["l_quantity", "l_tax", "l_returnflag"])
    return out.select(*[F.round(c, 2).alias(c) for c in out.columns])


@register("column_profile", """WITH c AS (SELECT 'c_mktsegment' AS column_name, c_mktsegment AS v FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer),
  n AS (SELECT column_name, v, count(*) AS n FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS place FROM n)
  SELECT column_name, count(*) AS n_distinct, max(n) = 1 AS is_unique, string_agg(CASE WHEN place <= 3 THEN v || '=' || n END, ', ' ORDER BY place) AS top_values FROM r GROUP BY 1""")
def column_profile(spark, sf):
    return ag.column_profile(table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"])


@register("best_target_sum", """SELECT o_custkey, o_orderpriority, score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderpriority) AS rn FROM
  (SELECT o_custkey, o_orderpriority, count(o_totalprice) AS score FROM orders GROUP BY 1, 2)) WHERE rn = 1""")
def best_target_sum(spark, sf):
    return ag.best_target(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", "o_totalprice", "count")


@register("group_average_matrix", """WITH c AS (SELECT label, generate_subscripts(embedding, 1) AS dim, unnest(embedding) AS v FROM embeddings)
  SELECT dim, round(avg(v) FILTER (label = 0), 5) AS group_0, round(avg(v) FILTER (label = 1), 5) AS group_1 FROM c GROUP BY 1""")
def group_average_matrix(spark, sf):
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("p", "v")).select("label", (F.col("p") + 1).cast("long").alias("dim"), F.col("v").cast("double").alias("v"))
    out = ag.group_average_matrix(cells, "dim", "label", "v", [0, 1])
    return out.select("dim", *[F.round(c, 5).alias(c) for c in ("group_0", "group_1")])


@register("matrix_profile", "SELECT count(v) AS n_values, count(*) FILTER (v = 0) AS n_zero, count(*) FILTER (v = 0) / CAST(count(v) AS DOUBLE) AS zero_share, min(v) AS min, max(v) AS max FROM (SELECT unnest(embedding) AS v FROM embeddings)")
def matrix_profile(spark, sf):
    return ag.matrix_profile(table(spark, sf, "embeddings"), "embedding")


@register("nonzero_counts", "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x <> 0)) AS BIGINT) AS n_nonzero FROM embeddings")
def nonzero_counts(spark, sf):
    return ag.nonzero_counts(table(spark, sf, "embeddings"), "vec_id", "embedding")


@register("discretize", """SELECT o_orderkey, CAST(greatest(0, least(8, floor((o_totalprice - lo) / ((hi - lo) / 8) + 0.5))) AS BIGINT) AS bin FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)""")
def discretize(spark, sf):
    return ag.discretise(table(spark, sf, "orders", "o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "bin")


@register("minmax_scale", "SELECT s_suppkey, round((s_acctbal - lo) / (hi - lo) * 1000, 6) AS scaled FROM supplier, (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)")
def minmax_scale(spark, sf):
    return ag.minmax_scale(table(spark, sf, "supplier"), "s_acctbal").select("s_suppkey", F.round("scaled", 6).alias("scaled"))


@register("histogram", "SELECT floor(l_quantity / 5) * 5.0::DOUBLE AS bin_start, count(*) AS n, round(count(*) / CAST((SELECT count(l_quantity) FROM lineitem) AS DOUBLE) / 5, 9) AS density FROM lineitem GROUP BY 1")
def histogram(spark, sf):
    return ag.histogram(table(spark, sf, "lineitem"), "l_quantity", 5.0).withColumn("density", F.round("density", 9))


@register("reassign_small_groups", """WITH a AS (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS n1, count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS n2 FROM orders)
  SELECT CASE WHEN n2 >= 200 THEN o_orderpriority || '_' || o_orderstatus WHEN n1 >= 200 THEN o_orderpriority ELSE 'MISC' END AS track, count(*) AS n FROM a GROUP BY 1""")
def reassign_small_groups(spark, sf):
    return ag.roll_up_small(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"], 200).groupBy("track").agg(F.count("*").alias("n"))


@register("doc_term", "SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY 1, 2")
def doc_term(spark, sf):
    return ag.doc_term(table(spark, sf, "documents"), "doc_id", "text")


@register("document_frequency", "SELECT word, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY 1")
def document_frequency(spark, sf):
    return ag.document_frequency(table(spark, sf, "documents"), "doc_id", "text")


@register("inverted_index", """SELECT word, doc_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM (SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word FROM
  (SELECT doc_id, string_split(text, ' ') AS w FROM documents)) GROUP BY 1, 2""")
def inverted_index(spark, sf):
    return ag.inverted_index(table(spark, sf, "documents"), "doc_id", "text").withColumn("positions", F.array_join("positions", ","))


@register("corr_pairs", """WITH c AS (SELECT l_suppkey AS s, l_linenumber AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
  SELECT a.s AS a, b.s AS b, round(corr(a.v, b.v), 6) AS r, count(*) AS n FROM c a JOIN c b ON a.c = b.c AND a.s < b.s GROUP BY 1, 2""")
def corr_pairs(spark, sf):
    cells = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("c")).agg(F.sum("l_quantity").alias("v"))
    # Half away from zero as round() has it, which takes longer by decimals than the pair itself; a rounded -0.0 becomes 0.
    r, millionths = F.col("r"), F.floor(F.abs("r") * 1e6 + 0.5)
    return ag.correlation_pairs(cells, "s", "c", "v").withColumn("r", F.when(F.isnan(r), r).otherwise(F.when(r < 0, -millionths).otherwise(millionths) / 1e6))


@register("jaccard_pairs", """WITH i AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS i FROM lineitem), n AS (SELECT k, count(*) AS n FROM i GROUP BY 1)
  SELECT a.k AS a, b.k AS b, count(*) AS n_common, round(count(*) / CAST(any_value(x.n) + any_value(y.n) - count(*) AS DOUBLE), 9) AS jaccard FROM i a JOIN i b ON a.i = b.i AND a.k < b.k JOIN n x ON x.k = a.k JOIN n y ON y.k = b.k GROUP BY 1, 2""")
def jaccard_pairs(spark, sf):
    return ag.jaccard_pairs(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey").withColumn("jaccard", F.round("jaccard", 9))


@register("variant_merge", """SELECT chrom, pos, ref, alt, CASE WHEN length(ids) > 15 THEN left(ids, 15) || '...' ELSE ids END AS id, ac, 'Q=' || q || ';AC=' || ac AS info FROM
  (SELECT l_returnflag AS chrom, l_partkey AS pos, 'A' AS ref, l_linestatus AS alt, string_agg(DISTINCT CAST(l_orderkey AS VARCHAR), ',' ORDER BY CAST(l_orderkey AS VARCHAR)) AS ids, count(*) AS ac,
   string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS q FROM lineitem GROUP BY 1, 2, 3, 4)""")
def variant_merge(spark, sf):
    v = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("chrom"), F.col("l_partkey").alias("pos"), F.lit("A").alias("ref"), F.col("l_linestatus").alias("alt"), F.col("l_orderkey").cast("string").alias("id"), F.concat(F.lit("Q="), F.col("l_linenumber").cast("string")).alias("info"))
    return ag.merge_variants(v, ["Q"])


# -- ranks and order -------------------------------------------------------------------------------------------------


@register("topn_per_label", """SELECT o_custkey, o_orderkey, o_totalprice, CAST(place AS BIGINT) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS place FROM orders) WHERE place <= 2""")
def topn_per_label(spark, sf):
    return rk.top_n(table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", 2, ["o_orderkey"])


@register("best_rows_ties", "SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, rank() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r = 1")
def best_rows_ties(spark, sf):
    return rk.best_rows(table(spark, sf, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity"), "l_partkey", "l_quantity")


@register("reciprocal_best", """WITH h AS (SELECT l_suppkey AS q, l_partkey AS s, min(l_extendedprice) AS e FROM lineitem GROUP BY 1, 2),
  x AS (SELECT q, s, e FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY e, s) AS r FROM h) WHERE r = 1), y AS (SELECT s, q, e FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY e, q) AS r FROM h) WHERE r = 1)
  SELECT x.q AS a, x.s AS b, x.e AS score_ab, y.e AS score_ba FROM x JOIN y ON x.q = y.q AND x.s = y.s""")
def reciprocal_best(spark, sf):
    h = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("subject")).agg(F.min("l_extendedprice").alias("score"))
    return rk.reciprocal_best(h, h.select(F.col("subject").alias("query"), F.col("query").alias("subject"), "score"))


@register("best_matches", """SELECT "query", subject, e_value, identity, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY "query" ORDER BY e_value, subject) AS place FROM
  (SELECT l_suppkey AS "query", l_partkey AS subject, min(l_extendedprice) AS e_value, arg_min(l_quantity, (l_extendedprice, l_quantity)) AS identity FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2)) WHERE place <= 3""")
def best_matches(spark, sf):
    hits = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("subject"), F.col("l_extendedprice").alias("e_value"), F.col("l_quantity").alias("identity"))
    return rk.best_matches(hits, 3)


@register("rank_percentile", """WITH r AS (SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT value, n, CAST(sum(n) OVER (ORDER BY value) AS BIGINT) AS max_rank, dense_rank() OVER (ORDER BY value) AS dense_rank FROM r)
  SELECT value, n, max_rank - n + 1 AS min_rank, max_rank, (max_rank - n + 1 + max_rank) / 2.0::DOUBLE AS average_rank, dense_rank, (max_rank - n + 1 + max_rank) / 2.0::DOUBLE / (SELECT count(*) FROM lineitem) AS percentile FROM s""")
def rank_percentile(spark, sf):
    return rk.value_ranks(table(spark, sf, "lineitem"), "l_quantity")


@register("rank_compare", """WITH a AS (SELECT o_custkey AS key, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS ra, row_number() OVER (ORDER BY max(o_orderkey) DESC, o_custkey) AS rb FROM orders GROUP BY 1)
  SELECT key, ra AS rank_left, rb AS rank_right, ra / CAST(rb AS DOUBLE) AS ratio FROM a""")
def rank_compare(spark, sf):
    g = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key"))
    return tb.rank_compare(g.agg(F.count("*").alias("value")), g.agg(F.max("o_orderkey").alias("value")))


@register("consecutive_number", "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linestatus = 'F' THEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) ELSE row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) END AS BIGINT) AS number FROM lineitem")
def consecutive_number(spark, sf):
    return rk.consecutive_number(table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_linestatus", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], F.col("l_linestatus") == "F").select("l_orderkey", "l_linenumber", "number")


@register("consecutive_pairs", "SELECT * FROM (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_value FROM orders) WHERE next_value IS NOT NULL")
def consecutive_pairs(spark, sf):
    return rk.consecutive_pairs(table(spark, sf, "orders", "o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], "o_orderkey")


@register("sliding_window_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS in_window FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)")
def sliding_window_count(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return rk.sliding_counts(e, "user_id", "s", 86_400).select("event_id", "in_window")


@register("moving_average", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 4) AS moving_average FROM orders")
def moving_average(spark, sf):
    return rk.moving_average(table(spark, sf, "orders"), "o_custkey", ["o_orderkey"], "o_totalprice", 5).select("o_orderkey", F.round("moving_average", 4).alias("moving_average"))


@register("median_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY o_custkey) // 2 AS mid FROM orders) WHERE place = mid")
def median_per_key(spark, sf):
    return rk.median_per(table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey")


@register("chunk_rows", "SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000) AS BIGINT) AS chunk FROM orders")
def chunk_rows(spark, sf):
    return sinks.chunks(table(spark, sf, "orders", "o_orderkey"), ["o_orderkey"], 1000)


@register("seeded_draw")
def seeded_draw(spark, sf):
    return rk.draw(table(spark, sf, "orders", "o_orderkey"), 100, "o_orderkey")


@register("monte_carlo_share")
def monte_carlo_share(spark, sf):
    return rk.monte_carlo_share(table(spark, sf, "supplier"), "s_acctbal", "s_suppkey", 20, 100, 4500.0)


@register("bootstrap_replace")
def bootstrap_replace(spark, sf):
    customers = table(spark, sf, "customer").select(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("key"))
    parts = table(spark, sf, "part").select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("key"))
    return rk.bootstrap_replace(customers, customers.unionByName(parts), "key", 0.1, 5)


@register("shuffle_values")
def shuffle_values(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", rk.shuffle_array("embedding", "vec_id").alias("embedding"))


# -- intervals -------------------------------------------------------------------------------------------------------


@register("interval_overlap", f"""WITH {_ITEMS}, {_SPANS} SELECT a.name AS item, count(*) AS n, CAST(sum(least(a."end", b."end") - greatest(a."start", b."start")) AS BIGINT) AS bp FROM items a JOIN spans b ON {_OVER} GROUP BY 1""")
def interval_overlap(spark, sf):
    return iv.overlap_join(items(spark, sf), spans(spark, sf)).groupBy(F.col("l.name").alias("item")).agg(F.count("*").alias("n"), F.sum("overlap_bp").alias("bp"))


@register("interval_anti", f"""WITH {_ITEMS}, {_SPANS} SELECT name FROM items a WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE {_OVER})""")
def interval_anti(spark, sf):
    return iv.overlap_join(items(spark, sf), spans(spark, sf), "anti").select("name")


@register("interval_contains", f"""WITH {_ITEMS}, {_SPANS} SELECT name FROM items a WHERE EXISTS (SELECT 1 FROM spans b WHERE a.chrom = b.chrom AND a."start" >= b."start" AND a."end" <= b."end")""")
def interval_contains(spark, sf):
    return iv.contained_in(items(spark, sf), spans(spark, sf)).select("name")


@register("overlap_bp", f"""WITH {_ITEMS}, {_SPANS} SELECT count(*) AS n_pairs, CAST(sum(least(a."end", b."end") - greatest(a."start", b."start")) AS BIGINT) AS bp FROM items a JOIN spans b ON {_OVER}""")
def overlap_bp(spark, sf):
    return iv.overlap_bp(items(spark, sf), spans(spark, sf))


@register("annotate_names", f"""WITH {_ROOMY_SPANS}, {_SPOTS}, p AS (SELECT chrom, unnest(range("start", "end")) AS x, name FROM spans), m AS (SELECT p.name, string_agg(DISTINCT b.name, ',' ORDER BY b.name) AS names FROM p JOIN spots b ON p.chrom = b.chrom AND b."start" = x GROUP BY 1)
  SELECT a.name, coalesce(names, 'None') AS names FROM spans a LEFT JOIN m USING (name)""")
def annotate_names(spark, sf):
    return iv.annotate_names(roomy_spans(spark, sf), spots(spark, sf), ["name"], missing="None").select("name", "names")


@register("nearest_neighbors", f"""WITH {_ROOMY_SPANS}, {_SPOTS}, e AS (SELECT chrom, "end" AS at, max(name) AS gene FROM spots GROUP BY 1, 2), b AS (SELECT chrom, "start" AS at, min(name) AS gene FROM spots GROUP BY 1, 2)
  SELECT r.name, e.gene AS left_gene, r."start" - e.at AS left_distance, b.gene AS right_gene, b.at - r."end" AS right_distance FROM spans r ASOF LEFT JOIN e ON r.chrom = e.chrom AND r."start" >= e.at ASOF LEFT JOIN b ON r.chrom = b.chrom AND r."end" <= b.at""")
def nearest_neighbors(spark, sf):
    return iv.nearest_neighbours(roomy_spans(spark, sf), spots(spark, sf), chunk=1000).select("name", "left_gene", "left_distance", "right_gene", "right_distance")


def _islands_sql(source: str, test: str) -> str:
    return f"""a AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY "start", "end", name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
  i AS (SELECT *, sum(CASE WHEN reach IS NULL OR {test} THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY "start", "end", name) AS island FROM a)"""



@register("merge_overlaps", f"""WITH {_ROOMY_SPANS}, {_islands_sql("spans", '"start" - reach >= 0')} SELECT chrom, min("start") AS "start", max("end") AS "end", string_agg(name, '/' ORDER BY "start", "end", name) AS name, count(*) AS n FROM i GROUP BY chrom, island""")
def merge_overlaps(spark, sf):
    return iv.merge_overlaps(roomy_spans(spark, sf), chunk=1000)


@register("chain_features", f"""WITH {_ROOMY_SPANS}, {_islands_sql("spans", '"start" - reach >= 5')} SELECT chrom, min("start") AS "start", max("end") AS "end", count(*) AS score FROM i GROUP BY chrom, island HAVING count(*) > 1""")
def chain_features(spark, sf):
    return iv.chain_features(roomy_spans(spark, sf), 5, more_than=1, chunk=1000)


@register("longest_in_clump", f"""WITH {_ROOMY_SPANS}, {_islands_sql("spans", '"start" - reach >= 0')} SELECT chrom, "start", "end", name FROM (SELECT *, row_number() OVER (PARTITION BY chrom, island ORDER BY "end" - "start" DESC, "start", name) AS r FROM i) WHERE r = 1""")
def longest_in_clump(spark, sf):
    return iv.longest_in_clump(roomy_spans(spark, sf), chunk=1000)


@register("genome_coverage", f"""WITH {_ROOMY_SPANS}, {_islands_sql("spans", '"start" - reach >= 0')} SELECT CAST(sum(bp) AS BIGINT) AS bp FROM (SELECT max("end") - min("start") AS bp FROM i GROUP BY chrom, island)""")
def genome_coverage(spark, sf):
    return iv.coverage(roomy_spans(spark, sf), chunk=1000)


@register("genome_cc", f"""WITH {_ROOMY_SPANS}, {_SPOTS}, p AS (SELECT DISTINCT chrom, unnest(range("start", "end")) AS x FROM spans), r AS (SELECT DISTINCT chrom, "start" AS x FROM spots),
  n AS (SELECT (SELECT count(*) FROM p) AS pb, (SELECT count(*) FROM r) AS rb, (SELECT count(*) FROM p JOIN r USING (chrom, x)) AS tp)
  SELECT tp, pb - tp AS fp, rb - tp AS fn, round((CAST(tp AS DOUBLE) * (1000000000 - pb - rb + tp) - CAST(rb - tp AS DOUBLE) * (pb - tp)) / sqrt(CAST(rb AS DOUBLE) * (1000000000 - rb) * pb * (1000000000 - pb)), 9) AS cc FROM n""")
def genome_cc(spark, sf):
    return bm.track_benchmark(roomy_spans(spark, sf), spots(spark, sf), 1_000_000_000).select("tp", "fp", "fn", F.round("cc", 9).alias("cc"))


@register("flatten_shortest", f"""WITH {_ROOMY_SPANS}, p AS (SELECT chrom, unnest(range("start", "end")) AS x, "end" - "start" AS len, name FROM spans), w AS (SELECT chrom, x, arg_min(name, (len, name)) AS name FROM p GROUP BY 1, 2),
  g AS (SELECT *, x - row_number() OVER (PARTITION BY chrom, name ORDER BY x) AS run FROM w) SELECT chrom, name, min(x) AS "start", max(x) + 1 AS "end" FROM g GROUP BY chrom, name, run""")
def flatten_shortest(spark, sf):
    return iv.flatten_shortest(roomy_spans(spark, sf))


@register("territories", f"""WITH {_SPANS}, m AS (SELECT *, CAST(floor(("start" + "end") / 2) AS BIGINT) AS mid FROM spans), n AS (SELECT *, lag(mid) OVER w AS a, lead(mid) OVER w AS z FROM m WINDOW w AS (PARTITION BY chrom ORDER BY mid, name))
  SELECT chrom, name, greatest(coalesce(CAST(floor((a + mid) / 2) AS BIGINT), mid - 100), mid - 100, 0) AS "start", least(coalesce(CAST(floor((mid + z) / 2) AS BIGINT), mid + 100), mid + 100) AS "end" FROM n""")
def territories(spark, sf):
    return iv.territories(spans(spark, sf), 100)


@register("upstream_gaps", f"""WITH {_ROOMY_ITEMS}, n AS (SELECT *, lag("end") OVER w AS a, lead("start") OVER w AS z FROM items WINDOW w AS (PARTITION BY chrom ORDER BY "start", "end", name)),
  u AS (SELECT chrom, CASE WHEN strand = '-' THEN "end" ELSE a END AS "start", CASE WHEN strand = '-' THEN z ELSE "start" END AS "end", name, strand FROM n) SELECT * FROM u WHERE "start" < "end" """)
def upstream_gaps(spark, sf):
    return iv.upstream_gaps(roomy_items(spark, sf))


@register("bidirectional_pairs", f"""WITH {_ROOMY_ITEMS}, n AS (SELECT *, lead("start") OVER w AS bs, lead(strand) OVER w AS bt, lead(name) OVER w AS bn FROM items WINDOW w AS (PARTITION BY chrom ORDER BY "start", "end", name))
  SELECT chrom, name AS minus_name, bn AS plus_name, bs - "end" AS gap FROM n WHERE strand = '-' AND bt = '+' AND bs - "end" > 0 AND bs - "end" < 100 AND name <> bn""")
def bidirectional_pairs(spark, sf):
    return iv.bidirectional_pairs(roomy_items(spark, sf), 100)


@register("bins_density", """WITH e AS (SELECT event_type AS chrom, CAST(user_id AS BIGINT) AS s, event_id AS name FROM events), h AS (SELECT chrom, s // 50 AS bin, count(DISTINCT name) AS n FROM e GROUP BY 1, 2),
  a AS (SELECT chrom, unnest(range(min(bin), max(bin) + 1)) AS bin FROM h GROUP BY 1) SELECT a.chrom, a.bin, coalesce(n, 0) AS n_names FROM a LEFT JOIN h ON a.chrom = h.chrom AND a.bin = h.bin""")
def bins_density(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("chrom"), F.col("user_id").alias("start"), (F.col("user_id") + 1).alias("end"), F.col("event_id").alias("name"))
    return iv.bin_density(e, 50)


@register("bin_counts", f"""WITH {_SPANS} SELECT chrom, "start" // 1000 AS bin, count(*) AS n FROM spans GROUP BY 1, 2 HAVING count(*) >= 10""")
def bin_counts(spark, sf):
    return iv.bin_sizes(spans(spark, sf), 1000, 10)


@register("tiles", """SELECT c_mktsegment AS chrom, t AS "start", least(t + 500, size) AS "end" FROM (SELECT c_mktsegment, count(*) * 10 AS size FROM customer GROUP BY 1), unnest(range(0, size, 500)) AS u(t)""")
def tiles(spark, sf):
    return iv.tiles(table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("chrom")).agg((F.count("*") * 10).alias("size")), 500)


@register("interval_explode", f"""WITH {_SPANS} SELECT chrom, unnest(range("start", "end")) AS pos FROM spans""")
def interval_explode(spark, sf):
    return iv.base_positions(spans(spark, sf))


@register("sum_identical", "SELECT l_returnflag AS chrom, l_orderkey AS \"start\", l_orderkey + l_linenumber % 2 + 1 AS \"end\", round(sum(l_quantity), 2) AS score FROM lineitem GROUP BY 1, 2, 3")
def sum_identical(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("chrom"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_linenumber") % 2 + 1).alias("end"), "l_quantity")
    return iv.sum_identical(rows, "l_quantity").withColumn("score", F.round("score", 2))


@register("region_span", f"""WITH {_SPANS} SELECT chrom, min("start") AS "start", max("end") AS "end", chrom || ':' || min("start") || '-' || max("end") AS region FROM spans GROUP BY 1""")
def region_span(spark, sf):
    return iv.region_span(spans(spark, sf))


@register("runs_above", """WITH v AS (SELECT o_orderstatus AS chrom, o_orderkey AS pos, o_orderkey - row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS run FROM orders WHERE o_totalprice BETWEEN 50000 AND 1e9)
  SELECT chrom, min(pos) AS "start", max(pos) + 1 AS "end" FROM v GROUP BY chrom, run HAVING max(pos) + 1 - min(pos) >= 2""")
def runs_above(spark, sf):
    v = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("chrom"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("v"))
    return iv.runs_above(v, "v", 50_000, 1e9, 2)


@register("project_mirror", f"""WITH {_ITEMS} SELECT chrom, 100000000 - "end" AS "start", 100000000 - "start" AS "end", name, CASE strand WHEN '+' THEN '-' ELSE '+' END AS strand FROM items""")
def project_mirror(spark, sf):
    return iv.project(items(spark, sf), 0, 100_000_000)


@register("extend", f"""WITH {_SPANS} SELECT chrom, greatest("start" - 25, 0) AS "start", "end" + 25 AS "end", name FROM spans""")
def extend(spark, sf):
    return iv.extend(spans(spark, sf), 25)


@register("beyond_sizes", f"""WITH {_SPANS}, z AS (SELECT chrom, max("start") AS size FROM spans GROUP BY 1) SELECT s.* FROM spans s JOIN z USING (chrom) WHERE "end" > size""")
def beyond_sizes(spark, sf):
    s = spans(spark, sf)
    return iv.beyond_sizes(s, s.groupBy("chrom").agg(F.max("start").alias("size")))


@register("feature_pairs", f"""WITH s AS (SELECT l_linestatus AS chrom, l_orderkey AS "start", l_orderkey + 2 AS "end", l_returnflag AS name FROM lineitem), a AS (SELECT *, unnest(range("end" + 3, "end" + 13)) AS x FROM s WHERE name = 'A')
  SELECT a.chrom, a."start" AS a_start, a."end" AS a_end, b."start" AS b_start, b."end" AS b_end FROM a JOIN s b ON a.chrom = b.chrom AND b.name = 'R' AND b."start" = a.x""")
def feature_pairs(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("chrom"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + 2).alias("end"), F.col("l_returnflag").alias("name"))
    return iv.feature_pairs(s, "A", "R", 3, 12)


@register("offset_bins", f"""WITH {_ITEMS}, {_SPANS} SELECT CAST(floor((a."start" - b."start") / 5.0) AS BIGINT) AS bin, count(*) AS n FROM items a JOIN spans b ON a.chrom = b.chrom AND a."start" < b."end" + 10 AND b."start" - 10 < a."end" GROUP BY 1""")
def offset_bins(spark, sf):
    return iv.offset_bins(items(spark, sf), spans(spark, sf), 5, 10)


@register("name_compare", """WITH a AS (SELECT o_custkey AS name, any_value(o_orderkey) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) = 1), b AS (SELECT o_custkey AS name, any_value(o_orderkey) AS s FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 HAVING count(*) = 1)
  SELECT count(*) AS n_common, count(*) FILTER (a.s = b.s) AS n_exact, count(*) FILTER (a.s < b.s + 100 AND b.s < a.s + 100) AS n_overlap, count(*) FILTER (2 * abs(a.s - b.s) < 10) AS n_close, count(*) FILTER (2 * abs(a.s - b.s) < 200) AS n_near FROM a JOIN b USING (name)""")
def name_compare(spark, sf):
    of = lambda s: table(spark, sf, "orders").where(F.col("o_orderstatus") == s).select(F.lit("c").alias("chrom"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 100).alias("end"), F.col("o_custkey").alias("name"))
    return iv.name_compare(of("F"), of("O"))


@register("join_blocks", """WITH s AS (SELECT o_orderstatus AS chrom, o_custkey AS name, o_orderkey AS "start", o_orderkey + 3 AS "end" FROM orders), r AS (SELECT *, lag("end") OVER (PARTITION BY chrom, name ORDER BY "start") AS reach FROM s),
  t AS (SELECT chrom, name, greatest("start", coalesce(reach, "start")) AS "start", "end", reach FROM r), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" - reach > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, name ORDER BY "start") AS run FROM t WHERE "start" < "end")
  SELECT chrom, name, min("start") AS "start", max("end") AS "end", count(*) AS n_blocks FROM i GROUP BY chrom, name, run""")
def join_blocks(spark, sf):
    s = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("chrom"), F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 3).alias("end"))
    return iv.join_blocks(s, 500).select("chrom", "name", "start", "end", F.size("block_starts").cast("long").alias("n_blocks"))


# -- benchmarks ------------------------------------------------------------------------------------------------------

_SETS = """p AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS v FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS v FROM orders WHERE o_orderstatus = 'O'),
  f AS (SELECT coalesce(p.k, r.k) AS k, p.v AS pv, r.v AS rv FROM p FULL JOIN r ON p.k = r.k AND p.v = r.v), g AS (SELECT k, count(pv) AS np, count(rv) AS nr, count(*) FILTER (pv IS NOT NULL AND rv IS NOT NULL) AS tp FROM f GROUP BY 1)"""


def _sets(spark, sf):
    o = table(spark, sf, "orders")
    return o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'")


@register("set_benchmark", f"""WITH {_SETS}, b AS (SELECT * FROM g WHERE np > 0 AND nr > 0), s AS (SELECT count(*) AS n_objects, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(nr - tp) AS BIGINT) AS fn, CAST(sum(np - tp) AS BIGINT) AS fp, count(*) FILTER (np = tp AND nr = tp) AS n_perfect,
  count(*) FILTER (tp > 0 AND (np > tp OR nr > tp)) AS n_partial, count(*) FILTER (tp = 0) AS n_missed FROM b) SELECT *, round(tp / CAST(tp + fp AS DOUBLE), 9) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 9) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f_score FROM s""")
def set_benchmark(spark, sf):
    out = bm.set_benchmark(*_sets(spark, sf), "o_custkey", "o_orderpriority")
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f_score")})


@register("hash_compare_sets", f"""WITH {_SETS} SELECT k AS key, np AS n_a, nr AS n_b, tp AS n_common, CASE WHEN np = 0 OR nr = 0 THEN 'absent' WHEN tp = np AND tp = nr THEN 'completeMatch' WHEN tp = 0 THEN 'allDifferent' ELSE 'partialMatch' END AS verdict FROM g""")
def hash_compare_sets(spark, sf):
    return bm.compare_sets(*_sets(spark, sf), "o_custkey", "o_orderpriority")


_CONFUSION = """tp, fp, fn, tn, round(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 9) AS sensitivity, round(tn / CAST(nullif(tn + fp, 0) AS DOUBLE), 9) AS specificity, round(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 9) AS ppv, round(tn / CAST(nullif(tn + fn, 0) AS DOUBLE), 9) AS npv,
  round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 9) AS accuracy, round((CAST(tp AS DOUBLE) * tn - CAST(fn AS DOUBLE) * fp) / nullif(sqrt(CAST(tp + fn AS DOUBLE) * (tn + fp) * (tp + fp) * (tn + fn)), 0), 9) AS cc"""
_METRICS = ("sensitivity", "specificity", "ppv", "npv", "accuracy", "cc")


@register("binary_benchmark", f"""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn FROM labels) SELECT {_CONFUSION} FROM c""")
def binary_benchmark(spark, sf):
    return bm.binary_benchmark(table(spark, sf, "labels"), "quality", "toxic").withColumns({c: F.round(c, 9) for c in _METRICS})


@register("hit_stats", f"""WITH u AS (SELECT c_custkey AS k, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS p, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AS t FROM customer),
  c AS (SELECT count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn FROM u) SELECT {_CONFUSION} FROM c""")
def hit_stats(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return bm.hit_stats(table(spark, sf, "customer"), o.where("o_orderstatus = 'P'"), o.where("o_totalprice > 100000"), "c_custkey").withColumns({c: F.round(c, 9) for c in _METRICS})


@register("motif_benchmark", """WITH h AS (SELECT DISTINCT l_returnflag || l_linestatus AS motif, l_partkey AS gene FROM lineitem), f AS (SELECT DISTINCT p_partkey AS gene FROM part WHERE p_size > 30),
  c AS (SELECT motif, count(*) AS n_genes, count(f.gene) AS tp FROM h LEFT JOIN f USING (gene) GROUP BY 1) SELECT motif, n_genes, tp, n_genes - tp AS fp, (SELECT count(*) FROM f) - tp AS fn FROM c""")
def motif_benchmark(spark, sf):
    hits = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("motif"), F.col("l_partkey").alias("gene"))
    return bm.motif_benchmark(hits, table(spark, sf, "part").where("p_size > 30").select(F.col("p_partkey").alias("gene")), 100_000).select("motif", "n_genes", "tp", "fp", "fn")


@register("hash_div", """SELECT a.k AS key, CASE WHEN b.v = 0 THEN NULL ELSE round(a.v / CAST(b.v AS DOUBLE), 9) END AS ratio FROM (SELECT o_custkey AS k, count(*) AS v FROM orders GROUP BY 1) a JOIN (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'F') AS v FROM orders GROUP BY 1) b ON a.k = b.k""")
def hash_div(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("a"), F.count_if(F.col("o_orderstatus") == "F").alias("b"))
    return n.select("key", F.round(bm.ratio(F.col("a"), F.col("b")), 9).alias("ratio"))


@register("distribution_tails")
def distribution_tails(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return n.select("o_orderpriority", st.pbinom("f", "n", F.lit(0.49)).alias("binomial"), st.ppois("f", F.col("n") * 0.49).alias("poisson"), st.phyper("f", F.lit(1_000_000), F.lit(490_000), "n").alias("hypergeometric"), st.fisher_p("f", F.col("n") - F.col("f"), F.lit(490), F.lit(510)).alias("fisher"))


# -- sequences, text, graphs -----------------------------------------------------------------------------------------


@register("gc_content", "SELECT doc_id, round(100.0 * (length(text) - length(translate(text, 'GC', ''))) / nullif(length(text), 0), 6) AS gc FROM documents")
def gc_content(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(fs.gc_percent("text"), 6).alias("gc"))


@register("revcomp", f"SELECT p_partkey, reverse(translate(p_name, '{fs.COMPLEMENT_FROM}', '{fs.COMPLEMENT_TO}')) AS revcomp FROM part")
def revcomp(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fs.reverse_complement("p_name").alias("revcomp"))


@register("regex_counts", "SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)[acgt]{4}')) AS BIGINT) AS n FROM documents")
def regex_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit("(?i)[acgt]{4}")).cast("long").alias("n"))


@register("regex_hits", """SELECT CAST(doc_id AS VARCHAR) AS id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)[acgt]{5}')) AS m FROM documents) GROUP BY 1""")
def regex_hits(spark, sf):
    seqs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seq"))
    return sq.regex_hits(seqs, {"run": "[acgt]{5}"}, both_strands=False).groupBy("id").agg(F.count("*").alias("n"))


@register("motif_totals", "SELECT 'TGA' AS motif, CAST(sum(len(regexp_extract_all(text, '(?i)TGA'))) AS BIGINT) AS n FROM documents UNION ALL SELECT 'RAT', CAST(sum(len(regexp_extract_all(text, '(?i)[AG]AT'))) AS BIGINT) FROM documents")
def motif_totals(spark, sf):
    return sq.motif_totals(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seq")), ["TGA", "RAT"])


@register("kmer_counts", "WITH k AS (SELECT p_partkey AS id, substr(p_name, i, 4) AS kmer FROM part, unnest(range(1, length(p_name) - 2)) AS u(i)) SELECT kmer, count(*) AS n, count(DISTINCT id) AS n_seqs FROM k GROUP BY 1")
def kmer_counts(spark, sf):
    return sq.kmer_counts(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("seq")), 4)


@register("enumerate_motifs", f"WITH a AS (SELECT unnest(['A', 'C', 'G', 'T']) AS x), m AS (SELECT p.x || q.x || r.x || s.x AS motif FROM a p, a q, a r, a s), e AS (SELECT motif FROM m WHERE motif <= reverse(translate(motif, '{fs.COMPLEMENT_FROM}', '{fs.COMPLEMENT_TO}'))), k AS (SELECT substr(translate(md5(p_name), '0123456789abcdef', 'ACGTACGTACGTACGT'), i, 4) AS w FROM part, (SELECT unnest(range(1, 30)) AS i)), n AS (SELECT least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS motif, count(*) AS n FROM k GROUP BY 1) SELECT motif, coalesce(n, 0) AS n FROM e LEFT JOIN n USING (motif)")
def enumerate_motifs(spark, sf):
    """Every word of four bases with its places on both strands of the parts' names, read as bases."""
    seqs = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr("translate(md5(p_name), '0123456789abcdef', 'ACGTACGTACGTACGT')").alias("seq"))
    found = sq.kmer_counts(seqs, 4, True).select(F.col("kmer").alias("motif"), "n")
    return sq.enumerate_motifs(spark, 4).join(found, "motif", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@register("consensus_columns", """WITH c AS (SELECT p_size AS block, i AS pos, upper(substr(p_brand, i, 1)) AS base FROM part, unnest(range(1, length(p_brand) + 1)) AS u(i)), n AS (SELECT block, pos, base, count(*) AS n FROM c GROUP BY 1, 2, 3),
  b AS (SELECT *, sum(n) OVER (PARTITION BY block, pos) AS t, row_number() OVER (PARTITION BY block, pos ORDER BY n DESC, base) AS r FROM n) SELECT block, string_agg(CASE WHEN n >= t * 0.5 THEN base ELSE 'N' END, '' ORDER BY pos) AS seq FROM b WHERE r = 1 GROUP BY 1""")
def consensus_columns(spark, sf):
    return sq.consensus(table(spark, sf, "part").select(F.col("p_size").alias("block"), F.col("p_partkey").alias("org"), F.col("p_brand").alias("seq")))


@register("hamming_pairs", """SELECT a.n_name AS a, b.n_name AS b, CASE WHEN length(a.n_name) = length(b.n_name) THEN hamming(a.n_name, b.n_name) ELSE -1 END AS d FROM nation a, nation b WHERE a.n_name < b.n_name""")
def hamming_pairs(spark, sf):
    return tb.ordered_pairs(table(spark, sf, "nation"), "n_name").withColumn("d", fs.hamming("a", "b"))


@register("matrix_hits")
def matrix_hits(spark, sf):
    seqs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.upper(F.regexp_replace("text", "[^ACGTacgt]", "")).alias("seq"))
    return sq.matrix_hits(seqs, {"box": [[0, 0, 0, 9], [9, 0, 0, 0], [0, 0, 0, 9], [9, 1, 0, 0], [5, 0, 1, 5], [8, 0, 1, 1]]}, 0.95)


@register("nucleotide_strings")
def nucleotide_strings(spark, sf):
    return tx.extract_nucleotides(table(spark, sf, "documents"))


@register("dna_lines", """SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, seq FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), LATERAL (SELECT regexp_replace(line, '[^ACGTacgt]', '', 'g') AS seq)
  WHERE length(line) > 10 AND length(seq) > length(line) * 0.4""")
def dna_lines(spark, sf):
    return tx.dna_lines(table(spark, sf, "documents")).withColumn("line_no", F.col("line_no").cast("long"))


@register("pattern_contexts", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{3,8}')) AS m FROM documents) GROUP BY 1")
def pattern_contexts(spark, sf):
    return tx.pattern_contexts(table(spark, sf, "documents"), "[0-9]{3,8}").groupBy("doc_id").agg(F.count("*").alias("n"))


@register("disambiguate_chains", """WITH h AS (SELECT l_suppkey AS chain, l_partkey AS seq, l_orderkey AS o, l_linenumber AS l FROM lineitem), s AS (SELECT *, count(*) OVER (PARTITION BY chain) AS n FROM h), m AS (SELECT *, max(n) OVER (PARTITION BY seq) AS b FROM s) SELECT chain, seq, o, l FROM m WHERE n = b""")
def disambiguate_chains(spark, sf):
    h = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("chain"), F.col("l_partkey").alias("seq"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"))
    return tx.disambiguate_chains(h, "chain", "seq")


@register("ancestors", """WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || r_regionkey, 'world' FROM region),
  a AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT a.node, e.parent, a.depth + 1 FROM a JOIN e ON a.ancestor = e.child) SELECT node, ancestor, CAST(min(depth) AS BIGINT) AS depth FROM a GROUP BY 1, 2""")
def ancestors(spark, sf):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = table(spark, sf, "customer").select(key("c", "c_custkey").alias("child"), key("n", "c_nationkey").alias("parent"))
    edges = edges.unionByName(table(spark, sf, "nation").select(key("n", "n_nationkey").alias("child"), key("r", "n_regionkey").alias("parent")))
    edges = edges.unionByName(table(spark, sf, "region").select(key("r", "r_regionkey").alias("child"), F.lit("world").alias("parent")))
    return gr.ancestors(edges)


@register("gtf_longest", """SELECT gene_id, transcript_id, length FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY length DESC, transcript_id) AS r FROM (SELECT 's' || l_suppkey AS gene_id, 'p' || l_partkey AS transcript_id, max(l_orderkey) - min(l_orderkey) + 1 AS length FROM lineitem GROUP BY 1, 2)) WHERE r = 1""")
def gtf_longest(spark, sf):
    attr = F.format_string('gene_id "s%d"; transcript_id "p%d"', "l_suppkey", "l_partkey")
    gtf = table(spark, sf, "lineitem").select(F.lit("exon").alias("feature"), F.col("l_orderkey").alias("start"), F.col("l_orderkey").alias("end"), attr.alias("attributes"))
    return src.gtf_longest_transcripts(gtf)


@register("bed_defaults", """SELECT o_orderstatus AS chrom, o_orderkey - 1 AS "start", o_orderkey AS "end", o_orderpriority AS name, '.' AS strand FROM orders""")
def bed_defaults(spark, sf):
    return sinks.bed_defaults(table(spark, sf, "orders"), {"chrom": "o_orderstatus", "start": "o_orderkey", "name": "o_orderpriority"}, True).select("chrom", "start", "end", "name", "strand")


@register("row_digest", "SELECT n_nationkey, md5(n_name || chr(9) || n_regionkey) AS digest FROM nation")
def row_digest(spark, sf):
    return sinks.row_digest(table(spark, sf, "nation"), "n_name", "n_regionkey").select("n_nationkey", "digest")


@register("fasta_text", "SELECT '>' || p_partkey || chr(10) || rtrim(regexp_replace(p_name, '(.{10})', '\\1' || chr(10), 'g'), chr(10)) AS value FROM part")
def fasta_text(spark, sf):
    return sinks.fasta_text(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("seq")), width=10)


@register("markov_scores", """WITH k AS (SELECT p_partkey AS id, substr(p_name, i, 2) AS c, substr(p_name, i + 2, 1) AS b FROM part, unnest(range(1, length(p_name) - 1)) AS u(i)),
  m AS (SELECT c, b, count(*) / CAST(sum(count(*)) OVER (PARTITION BY c) AS DOUBLE) AS p FROM k GROUP BY 1, 2) SELECT id, count(*) AS n, round(sum(log2(p)), 5) AS log_p FROM k JOIN m USING (c, b) GROUP BY 1""")
def markov_scores(spark, sf):
    seqs = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("seq"))
    return sq.markov_scores(seqs, sq.markov_model(seqs, 2), 2).withColumn("log_p", F.round("log_p", 5))


@register("neighbours_within_one", """WITH m AS (SELECT DISTINCT p_brand AS s FROM part) SELECT a.s AS a, b.s AS b FROM m a JOIN m b ON a.s < b.s AND length(a.s) = length(b.s) AND hamming(a.s, b.s) = 1""")
def neighbours_within_one(spark, sf):
    return sq.neighbours_within_one(table(spark, sf, "part").select(F.col("p_brand").alias("motif")))


@register("shift_by_gaps", f"""WITH {_SPANS}, g AS (SELECT chrom, pos, CAST(sum(sum(len)) OVER (PARTITION BY chrom ORDER BY pos) AS BIGINT) AS moved FROM (SELECT l_linestatus AS chrom, l_orderkey AS pos, CAST(floor(l_quantity) AS BIGINT) AS len FROM lineitem) GROUP BY 1, 2)
  SELECT s.chrom, s."start" + coalesce(a.moved, 0) AS "start", s."end" + coalesce(z.moved, 0) AS "end", s.name FROM spans s ASOF LEFT JOIN g a ON s.chrom = a.chrom AND s."start" >= a.pos ASOF LEFT JOIN g z ON s.chrom = z.chrom AND s."end" >= z.pos""")
def shift_by_gaps(spark, sf):
    gaps = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("chrom"), F.col("l_orderkey").alias("pos"), F.floor("l_quantity").alias("len"))
    return sq.shift_by_gaps(spans(spark, sf), gaps)


@register("motif_clusters", """WITH h AS (SELECT l_partkey AS id, l_returnflag AS pattern, l_orderkey AS s, l_orderkey + 1 AS e FROM lineitem), n AS (SELECT *, lead(s, 2) OVER w AS s3, lead(e, 2) OVER w AS e3 FROM h WINDOW w AS (PARTITION BY id, pattern ORDER BY s, e))
  SELECT id, pattern, s AS "start", e3 AS "end" FROM n WHERE s3 - s <= 500""")
def motif_clusters(spark, sf):
    h = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("pattern"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + 1).alias("end"))
    return sq.motif_clusters(h, 3, 500)


@register("score_vectors", """SELECT o_custkey, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0) AS f, coalesce(max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 0) AS p FROM orders GROUP BY 1""")
def score_vectors(spark, sf):
    v = ag.score_vectors(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "o_totalprice", ["F", "P"])
    return v.select("o_custkey", F.col("scores")[0].alias("f"), F.col("scores")[1].alias("p"))


@register("information_content", """WITH c AS (SELECT p_size AS block, i - 1 AS pos, upper(substr(p_name, i, 1)) AS base FROM part, unnest(range(1, length(p_name) + 1)) AS u(i)), n AS (SELECT block, pos, base, count(*) AS n FROM c WHERE base IN ('A', 'C', 'G', 'T') GROUP BY 1, 2, 3),
  p AS (SELECT block, pos, n / CAST(sum(n) OVER (PARTITION BY block, pos) AS DOUBLE) AS p FROM n) SELECT block, pos, round(2 + sum(p * log2(p)), 6) AS ic FROM p GROUP BY 1, 2""")
def information_content(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_size").alias("block"), F.col("p_partkey").alias("org"), F.col("p_name").alias("seq"))
    return sq.information_content(rows).withColumn("ic", F.round("ic", 6)).withColumn("pos", F.col("pos").cast("long"))
