"""Scores, suggestions, access, templates and pages on small tables, odd rows included."""

import glob

from pyspark.sql import functions as F

from docproof.functions.text import names_match
from docproof.operators import access, layout, risk, scoring


def test_csv_starts_with_the_mark(spark, tmp_path):
    spark.createDataFrame([(1, 'a "b", ₹'), (2, None)], "n int, t string").repartition(2).select("n", "t").transform(lambda d: access.write_csv(d, f"{tmp_path}/x") or d)
    parts = [open(p, "rb").read() for p in glob.glob(f"{tmp_path}/x/*.csv")]
    assert parts and all(p.startswith(b"\xef\xbb\xbfn,t\n") for p in parts)
    assert 'a ""b"", ₹'.encode() in b"".join(parts)


def test_names(spark):
    rows = [("Acme Pvt. Ltd", "ACME PRIVATE LIMITED", True), ("Acme", "Zenith", False), ("", "Acme", None), (None, "Acme", None)]
    got = spark.createDataFrame(rows, "a string, b string, want boolean").select("want", names_match("a", "b").alias("same")).collect()
    assert all(r["same"] == r["want"] for r in got)


def _field(**x):
    base = {"doc_id": 1, "field_key": "total", "line_index": None, "kind": "number", "value": "5", "legibility": "clear", "quality_bucket": "digital", "history": 0.0, "suggested_value": None, "suggestion_reason": None, "required": True}
    return base | x


FIELD = "doc_id long, field_key string, line_index int, kind string, value string, legibility string, quality_bucket string, history double, suggested_value string, suggestion_reason string, required boolean"
CHECK = "doc_id long, ordinal int, check_id string, severity string, status string, message string, field_keys array<string>"


def test_scores_with_few_flags(spark):
    rows = [_field(), _field(doc_id=2, value=None), _field(doc_id=3, legibility=None, quality_bucket=None, history=None), _field(doc_id=4)]
    fields = spark.createDataFrame([tuple(r.values()) for r in rows], FIELD)
    failed = [(4, 2, "grand_total", "error", "fail", "sum", ["total", "total", "other"]), (4, 1, "qr:total", "error", "fail", "code", ["total"]), (4, 3, "hsn", "warn", "fail", "odd", ["total"]), (3, 1, "x", "error", "pass", "", [])]
    checks = spark.createDataFrame(failed, CHECK)
    got = {r["doc_id"]: r for r in scoring.score_fields(fields, checks).collect()}
    assert got[2]["reason_codes"] == ["missing_required", "forced"] and got[2]["band"] == "low"
    assert got[4]["reason_codes"] == ["check:qr:total", "check:grand_total", "warn:hsn", "forced"] and got[4]["reason"] == "code"
    assert got[1]["reason"] is None and not got[1]["needs_review"] and got[1]["band"] == "high"
    assert got[3]["score"] is not None and len(got) == 4
    assert scoring.score_fields(fields.limit(0), checks.limit(0)).isEmpty()


def test_suggestions(spark):
    fields = spark.createDataFrame(
        [(1, "gstin", "gstin", "27AAPFU0939FIZV", None, False, None, None), (1, "total", "number", "8", "9", False, None, None), (1, "kept", "number", "8", "9", False, "1", "mine"), (1, "mended", "number", "8", "9", True, None, None)],
        "doc_id long, field_key string, kind string, value string, code_value string, repaired boolean, suggested_value string, suggestion_reason string",
    )
    checks = spark.createDataFrame(
        [(1, 0, "format:gstin", "fail", "m", ["gstin"], None), (1, 1, "sum", "fail", "no sum", ["total"], None), (1, 2, "sum", "fail", "adds", ["total", "kept"], "1,007.50"), (1, 3, "qr:total", "fail", "m", ["total"], None),
         (1, 4, "qr:kept", "fail", "m", ["kept"], None), (1, 5, "qr:mended", "fail", "m", ["mended"], None), (1, 6, "none", "fail", "m", [], "5")],
        "doc_id long, ordinal int, check_id string, status string, message string, field_keys array<string>, suggest string",
    )
    got = {r["field_key"]: (r["suggested_value"], r["suggestion_reason"]) for r in scoring.suggest(fields, checks).collect()}
    assert got["gstin"][0] == "27AAPFU0939F1ZV" and got["kept"] == ("1", "mine") and got["mended"] == (None, None)
    assert got["total"][1] == "adds" and float(got["total"][0]) == 1007.5


def test_digits_as_printed(spark):
    rows = [("501.00", "Rs 501", "501", ""), ("123456.50", "₹ 1,23,456.50", "123456", "50"), ("-12.5", "(12.5)", "12", "5"), ("7.25", None, "7", "25"), ("7.25", "72", "7", "25"), ("8", "", "8", "")]
    frame = spark.createDataFrame(rows, "v string, raw string, w string, f string").withColumn("v", F.col("v").cast("decimal(18,2)"))
    assert all((r["d"]["whole"], r["d"]["fraction"]) == (r["w"], r["f"]) for r in frame.select("*", scoring.printed_digits("v", "raw").alias("d")).collect())


def test_boxes_and_layers(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    rows = [((-1.0, 0.0, 2.0, 0.5),), ((0.2, 0.2, 0.2005, 0.9),), (None,), ((0.1, None, 0.3, 0.4),), ((float("nan"), 0.0, 1.0, 1.0),)]
    got = [r["b"] for r in spark.createDataFrame(rows, f"b {box}").select(layout.bounded_box("b").alias("b")).collect()]
    assert tuple(got[0]) == (0.0, 0.0, 1.0, 0.5) and got[1:] == [None] * 4
    pages = spark.createDataFrame([(1, 2, "b" * 13_000), (1, 1, None)], "doc_id int, page_no int, text string")
    block = layout.text_layers(pages).first()["block"]
    assert block.index("--- page 1") < block.index("--- page 2") and block.count("b" * 12_000) == 1 and "b" * 12_001 not in block


def test_access_with_nulls(spark):
    rows = [("staff_reviewer", 1, None, 5, 1, 9, True), ("staff_ops", 1, None, 5, 1, 9, False), (None, 1, 5, 5, 1, 1, False), ("reviewer", 1, 5, 5, None, 1, False), ("uploader", 1, 5, 5, None, 1, True), ("admin", 1, 5, None, 1, 1, False), ("admin", 1, 5, 5, None, None, True)]
    frame = spark.createDataFrame(rows, "role string, me int, mine int, tenant int, assigned int, uploaded int, want boolean")
    may = access.may_open(*[F.col(c) for c in ("role", "me", "mine", "tenant", "assigned", "uploaded")])
    assert all(r["may"] == r["want"] for r in frame.select("want", may.alias("may")).collect())


def test_templates(spark):
    docs = spark.createDataFrame([(i, 1, "po", "ready", 7) for i in range(6)] + [(10, 2, "po", "ready", 7), (11, 1, "po", "ready", 8), (12, 1, "po", "failed", 7), (13, 1, "lr", "ready", 7)], "doc_id int, tenant_id int, doc_type string, status string, vendor_id int")
    templates = spark.createDataFrame([(t, 1, "po") for t in range(1, 8)], "template_id int, tenant_id int, doc_type string")
    shown = {1: [0, 1, 1, 2], 2: [0, 1], 3: [0, 1, 10], 4: [0, 1, 11], 5: [0, 1, 12], 6: [0, 1, 13], 7: []}
    examples = spark.createDataFrame([(t, d) for t, ds in shown.items() for d in ds], "template_id int, doc_id int")
    got = {r["template_id"]: (r["vendor_id"], r["problem"]) for r in access.new_templates(templates, examples, docs).collect()}
    assert got == {1: (7, None), 2: (None, "wrong_number"), 3: (None, "not_found"), 4: (None, "several_vendors"), 5: (None, "not_reviewed"), 6: (None, "mixed_types"), 7: (None, "wrong_number")}


def test_backtest(spark):
    rows = spark.range(9000).selectExpr("id as doc_id", "true as is_qa_sample", "id % 2 = 1 as is_high_stakes", "1.0 as bias", "cast(id % 3 > 0 as double) as x", "id % 3 = 0 and pmod(xxhash64(id), 10) < 3 as wrong")
    found = risk.backtest(rows, ["bias", "x"])
    assert found["decision"] == "proposed" and found["high_stakes"] >= found["auto_accept"] > 0.9 and found["labelled"] == 9000
    forced = risk.backtest(rows.withColumn("forced", F.expr("is_high_stakes")), ["bias", "x"])
    assert forced["decision"] == "keep: no certified threshold for high_stakes" and forced["auto_accept"] is None
    assert risk.backtest(rows.where("doc_id < 100"), ["bias", "x"])["decision"] == "keep: too few labelled fields"
