"""Repairs against the rules run over whole documents, one copy a candidate, and misreads against a plain version."""

from collections import defaultdict
from decimal import Decimal as D
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from docproof.operators import evidence, repair
from docproof.plans.queries import QUERIES, misread
from docproof.sources.tables import load

CENT = D("0.01")


def slow_slips(value, printed=None):
    """(value, reason) of every misread, the first reason of each value."""
    text = (printed or "").lstrip("₹ ").replace(",", "")
    try:
        said = bool(text) and abs(D(text) - abs(value)) < D("0.005")
    except ArithmeticError:
        said = False
    if not said:
        text = str(int(abs(value))) if value == int(value) else f"{abs(value):.2f}"
    whole, _, part = text.partition(".")
    found = {}

    def put(digits, point, why):
        if digits and point > 0:
            number = D(digits[:point] + "." + digits[point:]) * (-1 if value < 0 else 1)
            if abs(number - value) > D("0.004"):
                found.setdefault(number.quantize(CENT), why)

    digits = whole + part
    for i, x in enumerate(digits):
        for y in evidence.SLIPS[x]:
            put(digits[:i] + y + digits[i + 1 :], len(whole), f"a {y} read as a {x}")
        if i < len(whole):
            put(digits[:i] + digits[i + 1 :], len(whole) - 1, "a dropped digit")
            put(digits[: i + 1] + digits[i:], len(whole) + 1, "a doubled digit")
        if digits[i + 1 : i + 2] not in ("", x):
            put(digits[:i] + digits[i + 1] + x + digits[i + 2 :], len(whole), "two digits swapped")
    for factor, why in (("10", "a shifted decimal point"), ("0.1", "a shifted decimal point"), ("100", "a missing decimal point"), ("0.01", "a missing decimal point")):
        if part or D(factor) > 1:
            found.setdefault((value * D(factor)).quantize(CENT, "ROUND_HALF_UP"), why)
    found.pop(value.quantize(CENT), None)
    return found


@pytest.mark.parametrize("value,printed", [("18", None), ("1.25", None), ("501", "₹ 501"), ("501", "501.00"), ("123456.5", "1,23,456.50"), ("-90.05", None), ("7", "8"), ("1000", None), ("0.5", None), ("33.3", "३३.३")])
def test_slips(spark, value, printed):
    got = spark.createDataFrame([(D(value), printed)], "v decimal(18,2), p string").select(evidence.slips("v", F.col("p"))).first()[0]
    fold = printed and printed.translate(str.maketrans("०१२३४५६७८९", "0123456789"))
    assert {r["value"]: r["reason"] for r in got} == slow_slips(D(value), fold)
    assert len(got) == len({r["value"] for r in got})


def test_slips_query_by_brute_force(spark, sf_dir):
    for r in QUERIES["RP3_slips"](spark, sf_dir).collect():
        found = slow_slips(r["rate"], r["printed"])
        assert r["slips"] == "; ".join(sorted(f"{v} {why}" for v, why in found.items()))


def test_each_number_is_misread_once(spark, monkeypatch):
    rows = spark.createDataFrame([(1, D("18"), None), (2, D("18"), None), (3, None, "₹ 1"), (4, D("18"), "18.00"), (5, None, None)], "id int, v decimal(18,2), p string")
    want = {r["id"]: r["n"] for r in rows.select("id", F.size(evidence.slips("v", F.col("p"))).alias("n")).collect()}
    for few in (evidence.FEW, 0):
        monkeypatch.setattr(evidence, "FEW", few)
        found = evidence.with_slips(rows, "v", "p", F.size)
        assert {r["id"]: r["slips"] for r in found.collect()} == want and found.columns == ["id", "v", "p", "slips"]


def slow_search(spark, heads, lines, second):
    """The rules of ``search`` by whole documents: every candidate is a copy of its document with an id of its own."""
    checks = repair.all_checks(heads, lines).collect()
    errors, arithmetic = defaultdict(set), defaultdict(list)
    for c in checks:
        if c["status"] == "fail" and c["severity"] == "error":
            errors[c["doc_id"]].add(c["check_id"])
    values = {(r["doc_id"], r["field_key"]): r["value"] for r in repair.numbers(heads, lines).collect()}
    for r in sorted(evidence.implicated(repair.all_checks(heads, lines), repair.numbers(heads, lines)).collect(), key=lambda r: r["turn"]):
        arithmetic[r["doc_id"]].append(r["field_key"])
    seen = defaultdict(dict)
    for r in second.collect():
        if r["value"] is not None:
            seen[r["doc_id"], r["field_key"]].setdefault(D(r["value"]).quantize(CENT), r["source"])
    tries = []
    for doc, keys in arithmetic.items():
        options = [(k, v, s) for k in keys for v, s in seen[doc, k].items() if abs(v - values[doc, k]) >= D("0.005")]
        guesses = [(k, v, why) for k in keys for v, why in slow_slips(values[doc, k]).items() if v not in seen[doc, k]]
        tries += [(doc, "single", (x,)) for x in options] + [(doc, "slip", (x,)) for x in guesses] + [(doc, "pair", p) for p in combinations(options, 2) if p[0][0] != p[1][0]]
    plan = spark.createDataFrame([(i, doc, [(k, v) for k, v, _ in changes]) for i, (doc, _, changes) in enumerate(tries)], "n long, doc_id long, x array<struct<k: string, v: decimal(18,4)>>").repartition(8).cache()
    at = lambda key: F.element_at(F.map_from_entries("x"), key)
    copy = lambda df, names, key: df.join(plan, "doc_id").withColumns({n: F.coalesce(at(key(n)), n).cast(df.schema[n].dataType) for n in names if n in df.columns}).drop("doc_id", "x").withColumnRenamed("n", "doc_id")
    all_heads = copy(heads, repair.HEADER_FIELDS, F.lit)
    all_lines = copy(lines, repair.LINE_FIELDS, lambda n: F.format_string(f"line_items[%d].{n}", "line_index"))
    after = defaultdict(set)
    for c in repair.all_checks(all_heads, all_lines).where("status = 'fail' and severity = 'error'").select("doc_id", "check_id").collect():
        after[c["doc_id"]].add(c["check_id"])
    good = [t for i, t in enumerate(tries) if not any(c.split(":")[0] in evidence.ARITHMETIC or c not in errors[t[0]] for c in after[i])]
    out = {}
    for doc in arithmetic:
        mine = {kind: {tuple((k, v) for k, v, _ in c): c for d, x, c in good if d == doc and x == kind} for kind in ("single", "pair", "slip")}
        if len(mine["single"]) == 1:
            out[doc] = ("single", *mine["single"].values())
        elif not mine["single"] and len(mine["pair"]) == 1:
            out[doc] = ("pair", *mine["pair"].values())
        elif len(mine["slip"]) == 1:
            out[doc] = ("slip", *mine["slip"].values())
    return out


def as_found(rows):
    return {r["doc_id"]: (r["kind"], sorted((c["field_key"], c["value"], c["source"]) for c in r["changes"])) for r in rows}


def test_search_against_whole_documents(spark, sf_dir):
    tables = misread(load(spark, sf_dir, "inv_line"), load(spark, sf_dir, "inv_header"))
    tables = [t.where("doc_id % 23 < 2").cache() for t in tables]
    got = as_found(repair.search(*tables).collect())
    want = {d: (k, sorted(c)) for d, (k, c) in slow_search(spark, *tables).items()}
    assert got == want and {k for k, _ in got.values()} == {"single", "pair", "slip"}


LINE = "doc_id long, line_index int, quantity decimal(18,2), rate decimal(18,2), discount decimal(18,2), taxable_value decimal(18,2), gst_rate decimal(9,2)"
HEAD = "doc_id long, subtotal decimal(18,2), cgst_amount decimal(18,2), sgst_amount decimal(18,2), igst_amount decimal(18,2), grand_total decimal(18,2), supplier_gstin string, place_of_supply string, invoice_date date"


def test_search_over_sums(spark):
    """What changes a line must fit the header's sums, tax and total too."""
    head = lambda doc, sub, half, total: (doc, D(sub), D(half), D(half), None, D(total), "27ABCDE1234F1Z5", "27", None)
    line = lambda doc, i, q, r, t: (doc, i, D(q), D(r), D(0), D(t), D(18))
    heads = [head(1, 1000, 90, 1180), head(2, 1000, 90, 1180), head(3, 1000, 90, 1810), head(4, 1000, 90, 1180), head(5, 1000, 90, 1180), head(6, 500, 45, 590)]
    lines = [
        line(1, 0, 70, 100, 700), line(1, 1, 3, 100, 300),  # the quantity: 7 by another reading
        line(2, 0, 7, 100, 7000), line(2, 1, 3, 100, 300),  # the amount, and with it the subtotal's sum: a slip
        line(3, 0, 7, 100, 700), line(3, 1, 3, 100, 300),  # the total has two digits swapped
        line(4, 0, 70, 100, 700), line(4, 1, 30, 100, 300),  # two lines fail: a pair of backed values
        line(5, 0, 70, 100, 700), line(5, 1, 30, 100, 300),  # two lines fail, one value backed: a person's case
        line(6, 0, 5, 100, 500),  # nothing fails
    ]
    second = [(1, "line_items[0].quantity", D(7), "zoomed reading"), (1, "line_items[0].rate", D(100), "zoomed reading"), (4, "line_items[0].quantity", D(7), "a"), (4, "line_items[1].quantity", D(3), "b"), (5, "line_items[0].quantity", D(7), "a"), (6, "grand_total", D(1), "a"), (1, "subtotal", None, "a")]
    tables = spark.createDataFrame(heads, HEAD), spark.createDataFrame(lines, LINE), spark.createDataFrame(second, "doc_id long, field_key string, value decimal(18,2), source string")
    got = as_found(repair.search(*tables).collect())
    assert got == {
        1: ("single", [("line_items[0].quantity", D("7.00"), "zoomed reading")]),
        2: ("slip", [("line_items[0].taxable_value", D("700.00"), "two digits swapped")]),
        3: ("slip", [("grand_total", D("1180.00"), "two digits swapped")]),
        4: ("pair", [("line_items[0].quantity", D("7.00"), "a"), ("line_items[1].quantity", D("3.00"), "b")]),
    }
    assert got == {d: (k, sorted(c)) for d, (k, c) in slow_search(spark, *tables).items()}
    assert repair.search(tables[0].limit(0), tables[1].limit(0), tables[2]).count() == 0


def test_changes_reach_every_bad_line(spark):
    """Before misreads of a field are made, it is left out if another line fails too."""
    checks = spark.createDataFrame([(1, "line_math:0", "fail", "error"), (1, "line_math:2", "fail", "error"), (2, "line_math:1", "fail", "error"), (2, "line_math:0", "pass", "error"), (3, "grand_total", "fail", "error")], "doc_id int, check_id string, status string, severity string")
    line = lambda i: f"line_items[{i}].rate"
    rows = spark.createDataFrame([(1, [line(0)]), (1, [line(0), line(2)]), (2, [line(1)]), (2, ["subtotal"]), (3, ["subtotal"]), (3, [line(5)])], "doc_id int, keys array<string>")
    found = repair.reaching(rows, checks, F.transform("keys", lambda k: F.struct(k.alias("field_key"))))
    assert sorted((r["doc_id"], r["keys"]) for r in found.collect()) == [(1, [line(0), line(2)]), (2, [line(1)]), (3, [line(5)]), (3, ["subtotal"])]
