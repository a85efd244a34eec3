"""Places on pages, pages of documents, and documents rebuilt from stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docproof.operators.records import effective_value

#: The sentence above a text layer (a fixed value).
LAYER_INTRO = (
    "The PDF has a native text layer. Use it to confirm every digit you read from the image; "
    "where the image and the text layer disagree, trust the text layer and add an anomaly note."
)
PAGE_CHARS = 12_000
CORNERS = ("x0", "y0", "x1", "y1")


def bounded_box(box: Column | str) -> Column:
    """A box (x0, y0, x1, y1 in fractions of the page) held to the page; null without all four, or where next to nothing is left."""
    box = F.col(box) if isinstance(box, str) else box
    held = {n: F.when(box[n].isNotNull() & ~F.isnan(box[n].cast("double")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), box[n].cast("double")))) for n in CORNERS}
    wide = (held["x1"] - held["x0"] > 0.001) & (held["y1"] - held["y0"] > 0.001)
    return F.when(wide, F.struct(*[c.alias(n) for n, c in held.items()]))


def on_full_page(box: Column | str, frame: Column | str) -> Column:
    """A box within a trimmed frame as a box of the whole page; without a frame it is one already."""
    box, frame = (F.col(x) if isinstance(x, str) else x for x in (box, frame))
    at = lambda v, a, b: frame[a] + v * (frame[b] - frame[a])
    moved = F.struct(*[at(box[n], n[0] + "0", n[0] + "1").alias(n) for n in CORNERS])
    return F.when(box.isNull() | frame.isNull(), box).otherwise(moved)


def document_pages(pages: DataFrame) -> DataFrame:
    """doc_id, part, pages of a file's pages (doc_id, page_no, document_index): one row for each document found in the file, its pages
    in order; a page without an index, or with 0, belongs to the first."""
    part = F.when(F.col("document_index") != 0, F.col("document_index")).otherwise(1)
    return pages.groupBy("doc_id", F.coalesce(part, F.lit(1)).alias("part")).agg(F.array_sort(F.collect_list("page_no")).alias("pages"))


def text_layers(pages: DataFrame) -> DataFrame:
    """doc_id, block: the text layers of a document's pages (doc_id, page_no, text) under each other, as a model is shown them,
    the first 12,000 characters of each. Pages count from 1 in their order; null texts are empty."""
    cut = F.struct("page_no", F.substring(F.coalesce("text", F.lit("")), 1, PAGE_CHARS).alias("text"))
    ordered = F.array_sort(F.collect_list(cut))
    shown = F.transform(ordered, lambda p, i: F.concat(F.lit("--- page "), (i + 1).cast("string"), F.lit(" text layer ---\n"), p["text"]))
    return pages.groupBy("doc_id").agg(F.concat_ws("\n\n", F.lit(LAYER_INTRO), shown).alias("block"))


def rebuild_lines(fields: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Lines (doc_id, line_index and a column for each name of ``kinds``, in its type) of the values that hold now, after
    corrections. A field that a line lacks, or whose value is none of the type, is null."""
    held = effective_value()
    return fields.where("line_index is not null").groupBy("doc_id", "line_index").agg(*[F.max(F.when(F.col("field_name") == n, held)).try_cast(t).alias(n) for n, t in kinds.items()])


def field_guides(spec: DataFrame) -> DataFrame:
    """doc_type, guide: what a reader is told to look for, from the rows of a specification (doc_type, label, description,
    guidance, place, is_line, name, title, kind, hint), in the order of ``place``."""
    line = F.concat(F.lit("- "), "name", F.lit(": "), "title", F.lit(" ["), "kind", F.lit("]"), F.when(F.coalesce("hint", F.lit("")) != "", F.concat(F.lit(" ("), "hint", F.lit(")"))).otherwise(""))
    listed = lambda which: F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("place", line.alias("line"))))), lambda x: x["line"])
    one = spec.groupBy("doc_type").agg(*[F.max(c).alias(c) for c in ("label", "description", "guidance")], listed(~F.col("is_line")).alias("head"), listed(F.col("is_line")).alias("body"))
    text = F.array(F.concat(F.lit("Expected document type: "), "label", F.lit(" ("), "description", F.lit(").")), F.lit(""), F.lit("Header fields:"))
    columns = F.when(F.size("body") > 0, F.concat(F.array(F.lit(""), F.lit("Line item columns:")), F.col("body"))).otherwise(F.array().cast("array<string>"))
    more = F.when(F.coalesce("guidance", F.lit("")) != "", F.array(F.lit(""), F.col("guidance"))).otherwise(F.array().cast("array<string>"))
    return one.select("doc_type", F.array_join(F.concat(text, "head", columns, more), "\n").alias("guide"))
