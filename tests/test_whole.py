"""Queries over whole tables: rows that the registered counterparts' filters drop take part."""

from tests.compare import compare, connect
from tidewater.operators.text import extract_nucleotides, nucleotide_strings
from tidewater.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def whole(spark, name):
    compare(spark, connect(SF), name, QUERIES[name], ORACLE_SQL[name], SF)
    return QUERIES[name](spark, SF)


def test_gaps_of_all_items(spark):
    for name, column in (("upstream_gaps", "name"), ("bidirectional_pairs", "minus_name")):
        orders = whole(spark, name).selectExpr(f"cast(split({column}, '_')[0] as long) as k")
        assert orders.where("k % 50 <> 0").count() > 20 * orders.where("k % 50 = 0").count() > 0


def test_pairs_of_all_suppliers(spark):
    suppliers = spark.read.parquet(f"{SF}/supplier.parquet").count()
    assert suppliers > 40
    assert whole(spark, "corr_pairs").count() == suppliers * (suppliers - 1) // 2
    assert whole(spark, "jaccard_pairs").where("a > 40").count() > 0


def test_replacement_of_all_customers(spark):
    customers = spark.read.parquet(f"{SF}/customer.parquet").count()
    for r in QUERIES["bootstrap_replace"](spark, SF).groupBy("replicate").agg({"*": "count"}).collect():
        assert abs(r[1] - customers) < 0.1 * customers


def test_islands_of_all_orders(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    merged = whole(spark, "merge_overlaps")
    assert merged.agg({"n": "sum"}).first()[0] == orders and 0 < merged.where("n > 1").count() < merged.count() < orders
    islands = merged.count()
    assert whole(spark, "longest_in_clump").count() == islands and 0 < whole(spark, "chain_features").count() < islands
    covered = whole(spark, "genome_coverage").first()["bp"]
    both = whole(spark, "genome_cc").first()
    assert both["tp"] + both["fp"] == covered and min(both["tp"], both["fp"], both["fn"]) > 0
    assert whole(spark, "flatten_shortest").selectExpr("sum(end - start)").first()[0] == covered


def test_neighbours_of_all_orders(spark):
    table = spark.read.parquet(f"{SF}/orders.parquet")
    orders, alone = table.count(), table.where("o_orderstatus = 'P'").count()  # no line item has that status
    found = whole(spark, "nearest_neighbors")
    assert found.count() == orders and found.where("left_gene is null and right_gene is null").count() == alone
    names = whole(spark, "annotate_names")
    assert names.count() == orders and names.where("names rlike '[1-9]_.*,'").count() > orders / 4


def test_shifts_and_pairs_of_all_rows(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert whole(spark, "shift_by_gaps").count() == orders
    assert whole(spark, "feature_pairs").count() > orders  # lines of all numbers pair, not one an order


def test_nucleotides_of_long_texts(spark):
    text = "ACTGGACTTAGCCATGACTG was used, " * 1500
    assert len(nucleotide_strings(text)) == 1500 and nucleotide_strings(text, 1499) == []
    assert extract_nucleotides(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 1500
