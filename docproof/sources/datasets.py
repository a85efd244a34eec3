"""Labelled folders and made-up documents.

A labelled folder holds ``<bucket>/<name>.<ext>`` beside ``<name>.truth.json``. Made-up documents come from ``spark.range`` and hashes of
(seed, id, what for): any row can be made anywhere, again, alone, so generation splits and recovers like any other job.
Their totals are exact by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docproof.functions.gst import STATES, amount_to_words, check_char

MONEY = "decimal(18,2)"
TRUTH = "doc_type string, bucket string, synthetic boolean, fields map<string,string>, line_items array<map<string,string>>"
#: Readable kinds of files, and the cells that a made-up dataset holds (fixed values).
READABLE = ("pdf", "jpg", "jpeg", "png", "tif", "tiff", "webp")
PLAN = (("invoice", "digital"), ("invoice", "good_scan"), ("invoice", "poor_scan"), ("invoice", "bilingual"), ("lr", "carbon"))
GOODS = ("Hex bolt M12", "Ball bearing 6204", "Copper cable", "Steel sheet", "Gear oil", "Cotton waste", "Safety gloves", "PVC pipe", "Bench grinder", "Paint primer")


def labelled(spark: SparkSession, root: str) -> DataFrame:
    """path, name, bucket and the truth's columns for each labelled file below ``root``. Only names of files are read, not what they
    hold; of several files of one name the first by path counts, and truths without a file drop out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    stem = lambda pattern: F.regexp_extract("path", pattern, 1)
    files = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*READABLE)).select(stem(r"^(.*)\.[^./]+$").alias("stem"), "path")
    files = files.groupBy("stem").agg(F.min("path").alias("path"))
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.truth.json")
    truth = texts.select(F.regexp_extract("_metadata.file_path", r"^(.*)\.truth\.json$", 1).alias("stem"), F.from_json("value", TRUTH).alias("t"))
    return files.join(truth, "stem").select("path", F.element_at(F.split("stem", "/"), -1).alias("name"), "t.*")


class Dice:
    """Reproducible choices for a row."""

    def __init__(self, seed: int, *keys: str) -> None:
        self.seed, self.keys = seed, keys

    def number(self, what: str, low: int, high: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(f"{self.seed}/{what}"), *self.keys), F.lit(high - low + 1)) + low).cast("bigint")

    def one(self, what: str, values: tuple) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), self.number(what, 0, len(values) - 1).cast("int"))

    def gstin(self, what: str, state: Column) -> Column:
        letters = F.concat(*[F.char(65 + self.number(f"{what}{i}", 0, 25)) for i in range(5)])
        first = F.concat(state, letters, F.lpad(self.number(f"{what}n", 0, 9999).cast("string"), 4, "0"), F.char(65 + self.number(f"{what}z", 0, 25)), F.lit("1Z"))
        return F.concat(first, check_char(first))


def invoice_lines(spark: SparkSession, n: int, lines: int = 3, seed: int = 7) -> DataFrame:
    """``lines`` lines for each of ``n`` invoices; tax halves are rounded apart, so that the sums are exact."""
    doc, row = Dice(seed, "doc_id"), Dice(seed, "doc_id", "line_index")
    base = spark.range(n).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("line_index"))
    first = doc.number("goods", 0, len(GOODS) - 1)
    rows = base.select(
        "doc_id", "line_index", (doc.number("intra", 1, 10) <= 6).alias("intra"),
        F.get(F.array(*[F.lit(g) for g in GOODS]), ((first + F.col("line_index")) % len(GOODS)).cast("int")).alias("description"),
        row.one("quantity", (10, 25, 40, 50, 100, 120, 250, 500)).cast(MONEY).alias("quantity"),
        (row.number("rate", 1200, 250_000).cast("decimal(18,0)") / 100).cast(MONEY).alias("rate"), doc.one("slab", (5, 12, 18, 18, 28)).cast("decimal(9,2)").alias("gst_rate"),
    ).withColumn("taxable_value", (F.col("quantity") * F.col("rate")).cast(MONEY))
    tax = F.col("taxable_value") * F.col("gst_rate")
    half, whole = F.when(F.col("intra"), F.round(tax / 200, 2).cast(MONEY)), F.when(~F.col("intra"), F.round(tax / 100, 2).cast(MONEY))
    rows = rows.withColumns({"cgst_amount": half, "sgst_amount": half, "igst_amount": whole})
    return rows.withColumn("line_total", (F.col("taxable_value") + F.coalesce(F.col("cgst_amount") * 2, "igst_amount")).cast(MONEY))


def invoice_headers(lines: DataFrame, as_of: str, seed: int = 7) -> DataFrame:
    """The headers of made-up lines: sums of the lines, a total rounded to whole rupees, its words, parties of fitting states."""
    dice, total = Dice(seed, "doc_id"), lambda c: F.sum(c).cast(MONEY).alias(c)
    head = lines.groupBy("doc_id").agg(F.sum("taxable_value").cast(MONEY).alias("subtotal"), *[total(f"{x}_amount") for x in ("cgst", "sgst", "igst")])
    codes = tuple(STATES)[:20]
    at = dice.number("state", 0, len(codes) - 1)
    state = lambda i: F.get(F.array(*[F.lit(c) for c in codes]), (i % len(codes)).cast("int"))
    buyer = state(at + F.when(F.col("igst_amount").isNull(), 0).otherwise(dice.number("away", 1, len(codes) - 1)))
    names = F.create_map(*[F.lit(x) for c in codes for x in (c, STATES[c])])
    exact = F.col("subtotal") + F.coalesce(F.col("cgst_amount") * 2, F.col("igst_amount"))
    rounded = F.round(exact, 0).cast(MONEY)
    day = F.date_sub(F.lit(as_of).cast("date"), dice.number("day", 1, 60).cast("int"))
    start = F.year(F.add_months(day, -3))
    two = lambda x: F.lpad((x % 100).cast("string"), 2, "0")
    return head.select(
        "*", F.nullif((rounded - exact).cast(MONEY), F.lit(0).cast(MONEY)).alias("round_off"), rounded.alias("grand_total"), amount_to_words(rounded.cast("double")).alias("amount_in_words"), day.alias("invoice_date"),
        F.concat(dice.one("mark", ("INV", "TI", "GST")), F.lit("/"), two(start), F.lit("-"), two(start + 1), F.lit("/"), F.lpad(dice.number("number", 1, 4999).cast("string"), 4, "0")).alias("invoice_number"),
        dice.gstin("supplier", state(at)).alias("supplier_gstin"), dice.gstin("buyer", buyer).alias("buyer_gstin"), F.concat_ws("-", buyer, F.element_at(names, buyer)).alias("place_of_supply"),
    )


def receipts(spark: SparkSession, n: int, as_of: str, seed: int = 7) -> DataFrame:
    """``n`` lorry receipts: a charged weight in whole hundreds above the actual one, freight by weight."""
    dice = Dice(seed, "doc_id")
    codes = tuple(STATES)[:20]
    actual = dice.number("actual", 300, 9000)
    rows = spark.range(n).select(
        F.col("id").alias("doc_id"), dice.number("number", 10_000, 99_999).cast("string").alias("lr_number"), F.date_sub(F.lit(as_of).cast("date"), dice.number("day", 1, 20).cast("int")).alias("lr_date"),
        dice.number("packages", 5, 120).alias("packages_count"), actual.cast(MONEY).alias("actual_weight_kg"), (F.ceil(actual / 100) * 100).cast(MONEY).alias("charged_weight_kg"),
        (dice.one("rate", (5, 6, 7, 8, 10)).cast("decimal(9,2)") / 2).cast(MONEY).alias("freight_rate"), F.nullif(dice.one("charges", (0, 150, 250, 400)), F.lit(0)).cast(MONEY).alias("other_charges"),
        dice.gstin("from", dice.one("origin", codes)).alias("consignor_gstin"), dice.gstin("to", dice.one("target", codes)).alias("consignee_gstin"),
    ).withColumn("freight_amount", (F.col("charged_weight_kg") * F.col("freight_rate")).cast(MONEY))
    return rows.withColumn("total_freight", (F.col("freight_amount") + F.coalesce("other_charges", F.lit(0).cast(MONEY))).cast(MONEY))


def truths(spark: SparkSession, each: int, as_of: str, seed: int = 7) -> DataFrame:
    """The truths of a made-up dataset, ``each`` for every cell of ``PLAN``: bucket, name and the truth as JSON."""
    of_type = lambda kind: [b for t, b in PLAN if t == kind]
    text = lambda df, skip=(): F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns if c not in skip]), F.array(*[F.col(c).cast("string") for c in df.columns if c not in skip]))
    lines = invoice_lines(spark, each * len(of_type("invoice")), seed=seed)
    heads = invoice_headers(lines, as_of, seed)
    items = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_index", F.to_json(text(lines, ("doc_id", "line_index", "intra"))).alias("j")))).alias("l"))
    items = items.select("doc_id", F.transform("l", lambda x: F.from_json(x["j"], "map<string,string>")).alias("line_items"))
    invoices = heads.join(items, "doc_id").select("doc_id", F.lit("invoice").alias("doc_type"), text(heads, ("doc_id",)).alias("fields"), "line_items")
    slips = receipts(spark, each * len(of_type("lr")), as_of, seed)
    slips = slips.select("doc_id", F.lit("lr").alias("doc_type"), text(slips, ("doc_id",)).alias("fields"), F.array().cast("array<map<string,string>>").alias("line_items"))
    buckets = F.when(F.col("doc_type") == "lr", F.get(F.array(*map(F.lit, of_type("lr"))), F.floor(F.col("doc_id") / each).cast("int"))).otherwise(F.get(F.array(*map(F.lit, of_type("invoice"))), F.floor(F.col("doc_id") / each).cast("int")))
    rows = invoices.unionByName(slips).withColumn("bucket", buckets).withColumn("synthetic", F.lit(True))
    name = F.format_string("%s_%s_%03d", "doc_type", "bucket", F.col("doc_id") % each)
    return rows.select("bucket", name.alias("name"), F.to_json(F.struct("doc_type", "bucket", "synthetic", "fields", "line_items")).alias("truth"))
