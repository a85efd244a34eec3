"""The rules by type in one pass give what the rules of each type give over its own documents."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docproof.operators import checks
from docproof.plans.entries import _mixed, _off
from docproof.sources.tables import load


def test_dispatch_is_the_union(spark, sf_dir):
    lines = _off(load(spark, sf_dir, "inv_line")).withColumn("line_total", F.col("taxable_value"))
    mixed = _mixed(load(spark, sf_dir, "inv_header"), load(spark, sf_dir, "docs")).withColumns({"freight_rate": F.lit(2).cast("decimal(18,2)"), "freight_amount": F.col("actual_weight_kg"), "total_freight": F.col("actual_weight_kg"), "packages_count": F.lit(3), "amount_in_words": F.when(F.col("doc_id") % 3 == 0, "Rupees Ten Only")})
    of = lambda kind: mixed.where(F.col("doc_type") == kind).drop("doc_type")
    of_lines = lambda kind: lines.join(of(kind).select("doc_id"), "doc_id", "left_semi")
    orders = checks.order_checks(of("po"), of_lines("po")).where(~F.startswith("check_id", F.lit("line_math:")))
    alone = reduce(DataFrame.unionByName, [checks.invoice_checks(of("invoice"), of_lines("invoice")), checks.receipt_checks(of("lr")), orders, checks.contract_checks(of("contract"))])
    found = checks.document_checks(mixed, lines)
    show = lambda df: sorted(map(str, df.select("doc_id", "check_id", "status", "severity", "field_keys", F.round("calc", 4).alias("calc"), F.round("printed", 4).alias("printed")).collect()))
    assert show(found) == show(alone) and found.select("check_id").distinct().count() > 10


def test_headers_are_read_once(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.lit("po").alias("doc_type"), F.col("o_totalprice").cast("decimal(18,2)").alias("subtotal"), F.col("o_totalprice").cast("decimal(18,2)").alias("grand_total"), F.lit("27").alias("supplier_gstin"), F.lit("27").alias("place_of_supply"), F.lit(None).cast("date").alias("invoice_date"))
    lines = load(spark, sf_dir, "inv_line")
    plan = checks.document_checks(orders, lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_totalprice#") > 0 and plan.count("Relation [o_orderkey") == 1
