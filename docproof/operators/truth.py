"""Labelled documents and cells of readings as typed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docproof.functions.normalize import normalise, raw_consistent


def cell_field(kind: Column, value: Column, legibility: Column, raw: Column) -> dict[str, Column]:
    """What a cell of a reading gives: value (null if not there), unparseable (something is there that is no value of the
    kind), raw_consistent (whether the text as printed supports the value, null where that cannot be told). A missing
    legibility says that the value is not there."""
    absent = F.coalesce(legibility, F.lit("not_present")) == "not_present"
    typed = F.when(~absent, normalise(kind, value))
    unparseable = ~absent & (F.trim(F.coalesce(value, F.lit(""))) != "") & typed.isNull()
    return {"value": typed, "unparseable": unparseable, "raw_consistent": raw_consistent(kind, typed, F.coalesce(raw, F.lit("")))}


def truth_fields(truths: DataFrame, spec: DataFrame, json_col: str = "truth") -> DataFrame:
    """Labels (doc_id, and JSON with doc_type, fields and line_items) as rows of every field that the type has: doc_id, doc_type,
    field_key, line_index (null in the header), field_name, kind, value (normalised, null where not labelled). Documents of unknown
    types, or whose label is no JSON, give none.

    The label is read once as a variant; ``spec`` (doc_type, name, kind, is_line) says which paths are taken."""
    read = truths.select("doc_id", F.try_parse_json(json_col).alias("truth")).where("truth is not null")
    read = read.select("doc_id", "truth", F.try_variant_get("truth", "$.doc_type", "string").alias("doc_type"))
    part = spec.groupBy(F.col("doc_type").alias("of")).agg(F.collect_list(F.when(~F.col("is_line"), F.struct("name", "kind"))).alias("heads"), F.collect_list(F.when(F.col("is_line"), F.struct("name", "kind"))).alias("columns"))
    rows = read.join(part, F.col("doc_type") == F.col("of"))
    head = rows.select("doc_id", "doc_type", F.lit(None).cast("int").alias("line_index"), F.try_variant_get("truth", "$.fields", "map<string,variant>").alias("cells"), F.col("heads").alias("asked"))
    items = F.try_variant_get("truth", "$.line_items", "array<map<string,variant>>")
    line = rows.select("doc_id", "doc_type", F.posexplode(items).alias("line_index", "cells"), F.col("columns").alias("asked"))
    fields = head.unionByName(line).select("doc_id", "doc_type", "line_index", "cells", F.explode("asked").alias("f"))
    text = F.element_at("cells", F.col("f.name")).try_cast("string")
    key = F.when(F.col("line_index").isNull(), F.col("f.name")).otherwise(F.concat(F.lit("line_items["), F.col("line_index"), F.lit("]."), F.col("f.name")))
    return fields.select("doc_id", "doc_type", key.alias("field_key"), "line_index", F.col("f.name").alias("field_name"), F.col("f.kind").alias("kind"), normalise(F.col("f.kind"), text).alias("value"))
