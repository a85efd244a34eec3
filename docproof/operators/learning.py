"""What is learned from finished documents: profiles of vendors that batches add to, and hints for reading the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docproof.functions.normalize import clean_code, shape_mask

KEY = ["tenant_id", "vendor_id"]
#: A position is a hint if it differs by less than this over the examples (fixed value).
STEADY = 0.12


def vendor_batch(docs: DataFrame) -> DataFrame:
    """What a batch of documents says of each vendor, in a form that adds up: docs, first (time and name of the first named
    document), reviewed (of the last one that a person saw), bank (of the last one that a person saw), masks (shape of the
    number -> how often). Needs tenant_id, vendor_id, doc_id, created_at, reviewed_at, name, bank_account, number."""
    at, seen = F.struct("created_at", "doc_id"), F.col("reviewed_at").isNotNull()
    named = lambda value, when: F.when(value.isNotNull() & (value != "") & when, F.struct(at.alias("at"), value.alias("value")))
    base = docs.groupBy(*KEY).agg(F.count("*").alias("docs"), F.min(named(F.col("name"), F.lit(True))).alias("first"), F.max(named(F.col("name"), seen)).alias("reviewed"), F.max(named(clean_code("bank_account"), seen)).alias("bank"))
    counts = docs.where("number <> ''").groupBy(*KEY, shape_mask("number").alias("mask")).agg(F.count("*").alias("n"))
    return base.join(_as_map(counts), KEY, "left")


def _as_map(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mask", "n")))).alias("masks"))


def merged(*batches: DataFrame) -> DataFrame:
    """The sum of batches, in any order and any grouping: counts and histograms add, the earliest and latest stay."""
    rows = batches[0]
    for other in batches[1:]:
        rows = rows.unionByName(other)
    base = rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.min("first").alias("first"), F.max("reviewed").alias("reviewed"), F.max("bank").alias("bank"))
    counts = rows.select(*KEY, F.explode("masks").alias("mask", "n")).groupBy(*KEY, "mask").agg(F.sum("n").alias("n"))
    return base.join(_as_map(counts), KEY, "left")


def profiles(state: DataFrame) -> DataFrame:
    """tenant_id, vendor_id, docs, name (as last reviewed, else as first seen), bank_account, masks."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return state.select(*KEY, "docs", F.coalesce("reviewed.value", "first.value").alias("name"), F.col("bank.value").alias("bank_account"), F.coalesce("masks", none).alias("masks"))


def template_hints(marks: DataFrame, by: list[str]) -> DataFrame:
    """Where each header field stands on the examples of a group, if steadily: by, field_name, n, page (the usual one), x, y (medians of
    the middles), mask (the usual shape of its text, if met twice). Of equally usual ones the smallest.

    Needs doc_id, field_name, line_index, value, kind, page, x0, x1, y0, y1."""
    head = marks.where("line_index is null and value is not null")
    x, y = ((F.col(f"{c}0") + F.col(f"{c}1")) / 2 for c in "xy")
    placed = head.where("page is not null and x0 is not null").withColumns({"x": x.cast("double"), "y": y.cast("double")})
    spots = placed.groupBy(*by, "field_name").agg(F.count("*").alias("n"), F.mode("page", True).alias("page"), F.median("x").alias("x"), F.median("y").alias("y"), F.greatest(F.stddev_pop("x"), F.stddev_pop("y")).alias("spread"))
    shapes = head.where(F.col("kind").isin("string", "gstin", "vehicle", "hsn")).groupBy(*by, "field_name", shape_mask("value").alias("mask")).agg(F.count("*").alias("times"))
    usual = shapes.groupBy(*by, "field_name").agg(F.min(F.struct((-F.col("times")).alias("rank"), "mask")).alias("top")).select(*by, "field_name", F.when(F.col("top.rank") <= -2, F.col("top.mask")).alias("mask"))
    steady = spots.where((F.col("n") >= 2) & (F.col("spread") <= STEADY)).drop("spread")
    return steady.join(usual, [*by, "field_name"], "left")


def correction_hints(marks: DataFrame, by: list[str]) -> DataFrame:
    """by, field_name (of lines: "line item" and the name), corrected, examples (documents of the group), turn (1: most often)."""
    examples = marks.groupBy(*by).agg(F.count_distinct("doc_id").alias("examples"))
    name = F.when(F.col("line_index").isNotNull(), F.concat(F.lit("line item "), "field_name")).otherwise(F.col("field_name"))
    wrong = marks.where((F.col("status") == "corrected") & (F.col("line_index").isNotNull() | F.col("value").isNotNull()))
    counts = wrong.groupBy(*by, name.alias("field_name")).agg(F.count("*").alias("corrected"))
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("corrected"), "field_name"))
    return counts.join(examples, by).withColumn("turn", turn)
