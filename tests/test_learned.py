"""Profiles batch by batch, extractions published as one, and that the new queries have something to say."""

import pytest
from pyspark.sql import functions as F

from docproof.operators import evidence, learning, metrics, publishing, truth
from docproof.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["AG9_internal_metrics", "AG18_cell_measures", "AG19_gate", "AG24_learned_profiles", "AG27_template_hints", "AG27_correction_hints", "RV16_truth_fields"])
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 3


def test_batches_add_up_in_any_order(spark):
    rows = [(1, 7, i, i * 3 % 17, i if i % 3 == 0 else None, f"N{i}" if i % 4 else None, f"ac {i % 5}", f"INV/{i}" if i % 5 else "") for i in range(40)] + [(1, None, 99, 1, None, None, None, None)]
    docs = spark.createDataFrame(rows, "tenant_id int, vendor_id int, doc_id int, created_at int, reviewed_at int, name string, bank_account string, number string")
    whole = sorted(map(str, learning.profiles(learning.vendor_batch(docs.where("vendor_id is not null"))).collect()))
    parts = [learning.vendor_batch(docs.where(f"vendor_id is not null and doc_id % 4 = {i}")) for i in range(4)]
    for order in ((0, 1, 2, 3), (3, 1, 0, 2)):
        a, b, c, d = (parts[i] for i in order)
        assert sorted(map(str, learning.profiles(learning.merged(learning.merged(a, b), learning.merged(c, d))).collect())) == whole
    assert learning.profiles(learning.vendor_batch(docs.limit(0))).count() == 0


def test_deliveries_are_seen_whole(spark, tmp_path):
    store = publishing.Extractions(spark, f"file://{tmp_path}/x")
    docs = lambda *ids: spark.createDataFrame([(i, f"d{i}") for i in ids], "doc_id long, note string")
    fields = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, value string")
    assert store.publish("one", docs(1, 2, 3), fields=fields((1, "a"), (1, "b"), (2, "c")))
    fields((9, "lost")).write.parquet(f"file://{tmp_path}/x/fields/died")  # a job that died before its manifest
    assert store.publish("two", docs(2, 4), fields=fields((4, "d")))
    assert not store.publish("one", docs(1), fields=fields((1, "again")))
    for _ in range(2):
        assert sorted(map(tuple, store.read("fields").collect())) == [(1, "a"), (1, "b"), (4, "d")]
        assert sorted(r["doc_id"] for r in store.read("documents").collect()) == [1, 2, 3, 4]


def test_gate_and_measures_by_hand(spark):
    row = "doc_type string, bucket string, status string, fields long, auto long, wrong long, correct long, auto_wrong long, wrong_flagged long, seconds decimal(9,3), cost decimal(9,4), synthetic boolean, traps int, type_got string"
    from decimal import Decimal as D

    docs = [("po", "digital", "ready", 10, 10, 0, 10, 0, 0, D(1), D("0.01"), False, 0, "po")] * 20 + [("lr", "x", "failed", 0, 0, 0, 0, 0, 0, D(3), D(0), True, 2, None)]
    cells = metrics.evaluation(spark.createDataFrame(docs, row))
    got = {(r["doc_type"], r["bucket"]): r for r in metrics.gate(cells).collect()}
    assert got["po", "digital"]["demo_safe"] and not got["po", "digital"]["reasons"]
    assert got["lr", "x"]["reasons"] == ["contains synthetic documents", "only 1 docs (need 20)", "escape rate unknown above 0.5", "2 blank or illegible trap fields accepted with a value", "field accuracy unknown below 97.0"]
    whole = cells.where("doc_type is null").first()
    assert (whole["documents"], whole["unreadable_or_failed"], whole["straight_through_docs_pct"], whole["mean_seconds"], whole["doc_type_accuracy_pct"]) == (21, 1, 95.24, 1.1, 95.24)
    assert metrics.evaluation(spark.createDataFrame([], row)).count() == 0


def test_absent_terms_and_nulls_in_proofs(spark):
    from decimal import Decimal as D

    check = "doc_id int, check_id string, status string, severity string, field_keys array<string>, calc decimal(38,4), printed decimal(38,4)"
    checks = [(1, "grand_total", "pass", "error", ["total", "cess", "tcs"], D(5), D(5)), (1, "line_tax:0", "pass", "error", ["rate", "amount"], D(5), D("5.3")), (2, "grand_total", "pass", "error", ["total"], D(5), D("5.5")), (3, "grand_total", "pass", "error", ["total"], D(5), D(5)), (3, "line_math:0", "fail", "error", ["total"], D(1), D(2))]
    field = "doc_id int, field_key string, kind string, value string, raw string, legibility string, code_agrees boolean, in_text_layer boolean, master_match boolean"
    fields = [(1, "total", "number", "5", None, "clear", True, True, True), (1, "cess", "number", None, None, "not_present", None, None, None), (1, "tcs", "number", None, None, "illegible", True, True, True), (1, "rate", "percent", "18", "", "clear", None, None, None), (1, "amount", "number", "1234", "1,234", "clear", None, True, None), (2, "total", "number", "5", None, None, False, None, None), (3, "total", "string", "5", None, None, None, True, None)]
    got = {(r["doc_id"], r["field_key"]): r["verified_by"] for r in evidence.verified(spark.createDataFrame(fields, field), spark.createDataFrame(checks, check)).collect()}
    assert got == {(1, "total"): ["arithmetic", "code", "records"], (1, "cess"): ["arithmetic"], (1, "tcs"): [], (1, "rate"): ["arithmetic"], (1, "amount"): ["text_layer"], (2, "total"): [], (3, "total"): ["text_layer"]}


def test_labels_of_odd_shapes(spark):
    spec = spark.createDataFrame([("invoice", "a", "number", False), ("invoice", "b", "string", True)], "doc_type string, name string, kind string, is_line boolean")
    texts = ['{"doc_type": "invoice", "fields": {"a": 2.5, "z": 1}, "line_items": [{"b": "x  y"}, {}]}', '{"doc_type": "invoice"}', '{"doc_type": "other", "fields": {"a": 1}}', "[1", None, '{"doc_type": "invoice", "fields": {"a": null}, "line_items": null}']
    got = truth.truth_fields(spark.createDataFrame(list(enumerate(texts)), "doc_id int, truth string"), spec)
    assert sorted(((r["doc_id"], r["field_key"], r["value"]) for r in got.collect()), key=str) == [(0, "a", "2.5000"), (0, "line_items[0].b", "x y"), (0, "line_items[1].b", None), (1, "a", None), (5, "a", None)]
    assert got.where(F.col("kind").isNull()).isEmpty()


def test_verified_shuffles_once(spark):
    """Fields and rules meet in one shuffle by document, whose rows hold flags; fields of no document are kept and proven by no rule."""
    fields = spark.range(4).selectExpr("nullif(id, 3) as doc_id", "'f' as field_key", "'number' as kind", "cast(1 as decimal(18,2)) as value", "'1' as raw", "'clear' as legibility", "id = 2 as code_agrees", "false as in_text_layer", "false as master_match")
    checks = spark.range(4).selectExpr("nullif(id, 3) as doc_id", "'line_math:0' as check_id", "if(id = 1, 'fail', 'pass') as status", "'error' as severity", "array('f', 'g') as field_keys", "cast(1 as decimal(18,2)) as calc", "cast(1 as decimal(18,2)) as printed")
    found = evidence.verified(fields, checks)
    assert {r["doc_id"]: r["verified_by"] for r in found.collect()} == {0: ["arithmetic"], 1: [], 2: ["arithmetic", "code"], None: []}
    plan = found.select("doc_id", "verified_by")._jdf.queryExecution().optimizedPlan().toString()
    assert found.columns == [*fields.columns, "verified_by"] and "Join" not in plan and plan.count("RepartitionByExpression") == 1
