"""Machine-readable codes, readers' output and page words: parsed, and joined to the fields that they speak of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docproof.functions.gst import look_alike
from docproof.functions.normalize import clean_code, fold_digits, parse_amount, parse_date, squeeze, values_agree

#: First bytes of the file types that can be read (fixed values).
MAGIC = {"25504446": "application/pdf", "FFD8FF": "image/jpeg", "89504E470D0A1A0A": "image/png", "49492A00": "image/tiff", "4D4D002A": "image/tiff"}
#: Kinds of fields that a barcode may repeat, and kinds by how they are looked up in a text (fixed values).
BARCODED = ("string", "gstin", "vehicle")
NUMERIC, CODED = ("number", "percent", "integer"), ("gstin", "pan", "ifsc", "vehicle", "hsn")
TAX_ID = r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]\b"


def media_type(content: Column | str) -> Column:
    """By the first bytes; null for what cannot be read."""
    head = F.hex(F.substring(content, 1, 12))
    found = F.when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    for magic, name in MAGIC.items():
        found = found.when(F.startswith(head, F.lit(magic)), name)
    return found


def invoice_token(fields: Column) -> Column:
    """A signed-looking token whose payload holds the fields as JSON within JSON."""
    url_safe = lambda x: F.rtrim(F.translate(F.translate(F.base64(F.encode(x, "utf-8")), "\r\n", ""), "+/", "-_"), F.lit("="))
    return F.concat_ws(".", url_safe(F.lit('{"alg":"RS256"}')), url_safe(F.to_json(F.struct(F.to_json(fields).alias("data"), F.lit("NIC").alias("iss")))), F.lit("c2ln"))


def parse_invoice_token(token: Column | str, schema: str) -> Column:
    """The payload's fields as a struct; null if it is no token."""
    part = F.translate(F.split_part(token, F.lit("."), F.lit(2)), "-_", "+/")
    padded = F.concat(part, F.repeat(F.lit("="), F.pmod(-F.length(part), F.lit(4))))
    return F.from_json(F.get_json_object(F.decode(F.try_to_binary(padded, F.lit("base64")), "utf-8"), "$.data"), schema)


def parse_payment(uri: Column | str) -> tuple[Column, Column, Column]:
    """(payee address, payee name, amount) of a payment link."""
    ask = lambda key: F.try_parse_url(uri, F.lit("QUERY"), F.lit(key))
    plain = lambda x: F.try_url_decode(x)
    return plain(ask("pa")), plain(ask("pn")), plain(ask("am")).try_cast("decimal(18,2)")


def is_barcode(text: Column | str) -> Column:
    return F.rlike(text, F.lit(r"^[A-Za-z0-9/\-]{5,40}$"))


def issuer(text: Column, own: list[str]) -> Column:
    """The first tax identifier in a text that is not the company's own."""
    found = F.regexp_extract_all(F.upper(text), F.lit(TAX_ID), F.lit(0))
    return F.get(F.filter(found, lambda g: ~g.isin(*own)) if own else found, F.lit(0))


def parse_reading(readings: DataFrame, json_col: str = "reading") -> DataFrame:
    """A reader's output as rows: doc_id, line_index (null for headers), field_name, value, raw_text, legibility."""
    cell = "struct<value:string,raw_text:string,legibility:string>"
    parsed = readings.select("doc_id", F.from_json(json_col, f"fields map<string,{cell}>, line_items array<struct<cells:map<string,{cell}>>>").alias("r"))
    head = parsed.select("doc_id", F.lit(None).cast("int").alias("line_index"), F.explode("r.fields").alias("field_name", "c"))
    lines = parsed.select("doc_id", F.posexplode("r.line_items").alias("line_index", "l")).select("doc_id", "line_index", F.explode("l.cells").alias("field_name", "c"))
    absent = F.col("c.legibility") == "not_present"
    return head.unionByName(lines).select("doc_id", "line_index", "field_name", F.when(~absent, F.col("c.value")).alias("value"), "c.raw_text", "c.legibility")


def apply_codes(fields: DataFrame, codes: DataFrame) -> DataFrame:
    """Fields (doc_id, field_name, kind, value) with what codes (doc_id, field_name, source, code_value) say: filled where nothing was
    read, else agrees or not. An e-invoice outranks other sources."""
    rank = F.when(F.col("source") == "einvoice_qr", 0).when(F.col("source") == "upi_qr", 1).otherwise(2)
    best = codes.groupBy("doc_id", "field_name").agg(F.min_by(F.struct("source", "code_value"), F.struct(rank, F.col("source"), F.col("code_value"))).alias("c"))
    rows = fields.join(best, ["doc_id", "field_name"], "left")
    filled = F.col("value").isNull() & F.col("c.code_value").isNotNull()
    agrees = F.when(~filled & F.col("c.code_value").isNotNull(), values_agree("kind", "value", "c.code_value"))
    return rows.select("doc_id", "field_name", F.coalesce("value", "c.code_value").alias("value"), F.col("c.source").alias("code_source"), filled.alias("code_filled"), agrees.alias("code_agrees"))


def code_values(readings: DataFrame, spec: DataFrame) -> DataFrame:
    """Codes read (doc_id, doc_type, source, values as a map) as a row for each field that the document's type knows; spec
    is (doc_type, name)."""
    rows = readings.select("doc_id", "doc_type", "source", F.explode("values").alias("field_name", "code_value")).where("code_value is not null")
    known = spec.select("doc_type", F.col("name").alias("field_name"))
    return rows.join(known, ["doc_type", "field_name"], "left_semi").select("doc_id", "field_name", "source", "code_value")


def barcode_fields(fields: DataFrame, barcodes: DataFrame) -> DataFrame:
    """The fields (doc_id, field_name, kind, value) whose value a barcode (doc_id, code) of the document repeats, whatever
    its spaces and dashes. An equality on the cleaned value, so a document's fields and codes are never paired."""
    said = barcodes.select("doc_id", clean_code("code").alias("__code")).where("__code != ''")
    rows = fields.where(F.col("kind").isin(*BARCODED) & F.col("value").isNotNull()).withColumn("__code", clean_code("value"))
    return rows.join(said, ["doc_id", "__code"], "left_semi").select("doc_id", "field_name", "value")


def text_layers(pages: DataFrame) -> DataFrame:
    """One row for each document whose pages (doc_id, page, text) all have text: what fields are looked up in - numbers,
    dates, the text as one code, the text in small letters."""
    held = F.array_sort(F.collect_list(F.struct("page", "text")))
    whole = pages.groupBy("doc_id").agg(F.array_join(F.transform(held, lambda p: p["text"]), "\n").alias("text"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("bare"))
    text = fold_digits("text")
    numbers = F.regexp_extract_all(text, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0))
    dates = F.regexp_extract_all(text, F.lit(r"[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}|[0-9]{1,2}[\s-]*[A-Za-z]{3,9}[\s,-]*[0-9]{2,4}"), F.lit(0))
    return whole.where("bare = 0").select(
        "doc_id",
        F.array_distinct(F.transform(numbers, lambda x: F.round(parse_amount(x), 2).cast("decimal(18,2)"))).alias("numbers"),
        F.array_distinct(F.transform(dates, lambda x: F.date_format(parse_date(x), "yyyy-MM-dd"))).alias("dates"),
        clean_code("text").alias("code"),
        F.lower(squeeze("text")).alias("plain"),
    )


def grounded(fields: DataFrame, layers: DataFrame) -> DataFrame:
    """Fields (doc_id, field_name, kind, value) with ``in_text_layer``: whether the value stands in the document's text. Null without a
    text layer, without a value, for short strings and for kinds that cannot be looked up."""
    rows = fields.join(layers, "doc_id", "left")
    kind, value = F.col("kind"), F.col("value")
    number = F.round(value.try_cast("decimal(18,4)"), 2).cast("decimal(18,2)")
    holds = lambda a, x: F.coalesce(F.array_contains(a, x), F.lit(False))
    found = F.when(kind.isin(*NUMERIC), holds("numbers", number) | holds("numbers", F.abs(number)))
    found = found.when(kind.isin(*CODED), F.contains("code", value)).when(kind == "date", holds("dates", value))
    found = found.when((kind == "string") & (F.length(value) >= 3), F.contains("plain", F.lower(value)))
    return rows.select(*fields.columns, F.when(value.isNotNull() & F.col("plain").isNotNull(), found).alias("in_text_layer"))


def billed_to(docs: DataFrame, own: DataFrame) -> DataFrame:
    """Whether documents (doc_id, tenant_id, gstin) are billed to the tenant's own identifiers: own, misread (one own one looks alike,
    which is proposed) or other. Only identifiers that are not own meet a tenant's list, which is short."""
    exact = docs.join(own.select("tenant_id", "gstin").distinct(), ["tenant_id", "gstin"], "left_semi").select("doc_id").withColumn("own", F.lit(True))
    rows = docs.where("gstin is not null").join(exact, "doc_id", "left")
    near = rows.where("own is null").select("tenant_id", "gstin").distinct().join(own.select("tenant_id", F.col("gstin").alias("mine")).distinct(), "tenant_id").where(look_alike("gstin", "mine"))
    near = near.groupBy("tenant_id", "gstin").agg(F.count(F.lit(1)).alias("n"), F.min("mine").alias("mine")).where("n = 1").select("tenant_id", "gstin", "mine")
    rows = rows.join(near, ["tenant_id", "gstin"], "left")
    return rows.select("doc_id", F.when(F.col("own"), "own").when(F.col("mine").isNotNull(), "misread").otherwise("other").alias("billed_to"), F.when(F.col("own").isNull(), F.col("mine")).alias("suggest"))


def nearest_words(fields: DataFrame, words: DataFrame) -> DataFrame:
    """Fields (doc_id, page, field_name, value, x, y) with the box of the nearest word (doc_id, page, text, wx, wy) that holds the value."""
    pairs = fields.join(words, ["doc_id", "page"]).where(F.contains(clean_code("text"), clean_code("value")) & (clean_code("value") != ""))
    far = F.pow(F.col("wx") - F.col("x"), F.lit(2)) + F.pow(F.col("wy") - F.col("y"), F.lit(2))
    return pairs.groupBy("doc_id", "page", "field_name").agg(F.min(F.struct(far.alias("far"), "wx", "wy", "text")).alias("w")).select("doc_id", "page", "field_name", "w.text", "w.wx", "w.wy")


def misread(value: Column, key: Column) -> Column:
    """A reader's value with injected errors that depend on a key alone: absent, a digit wrong, or as it is."""
    turn = F.pmod(key, F.lit(10))
    wrong = F.translate(value, "38", "83")
    return F.when(turn == 0, F.lit(None).cast("string")).when(turn == 1, wrong).otherwise(value)
