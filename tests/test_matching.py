"""The three-way match against a plain version, line by line."""

import os
import random
from collections import defaultdict
from decimal import Decimal as D

import pyarrow as pa
import pytest

from tests.plain import ratio_of, token_set_of
from docproof.functions import text
from docproof.operators import matching
from docproof.plans.queries import QUERIES
from docproof.sources.scratch import shared_folder

LINE = "doc_id long, line_index int, item_code string, description string, hsn_sac string, quantity decimal(18,2), rate decimal(18,2), gst_rate decimal(9,2), discount decimal(18,2)"
RECEIVED = "doc_id long, receipt_id string, line_index int, item_code string, description string, hsn_sac string, quantity_received decimal(18,2), quantity_accepted decimal(18,2)"


def alike(a, b):
    if a["code"] and b["code"] and a["code"].strip().upper() == b["code"].strip().upper():
        return 100.0
    keep = lambda t, more: "".join(c for c in (t or "").lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789" + more)
    score = max(token_set_of(keep(a["text"], " "), keep(b["text"], " ")), ratio_of(keep(a["text"], ""), keep(b["text"], "")))
    return score + (10 if a["hsn"] and b["hsn"] and a["hsn"][:4] == b["hsn"][:4] else 0)


def pairs_by_hand(orders, lines):
    taken, found = set(), {}
    for score, p, o in sorted(((alike(a, b), p, o) for p, a in enumerate(orders) for o, b in enumerate(lines)), reverse=True):
        if score >= 70 and p not in taken and o not in found:
            taken.add(p)
            found[o] = p
    return found


def match_by_hand(order, receipts, bill):
    issues, lines = [], order["lines"]
    same = lambda x, y: bool(x) and bool(y) and (bare(x).endswith(bare(y)) or bare(y).endswith(bare(x)))
    bare = lambda x: "".join(c for c in x.upper() if c.isalnum()).lstrip("0")
    if bill["po"] and not same(bill["po"], order["number"]):
        issues.append(("reference", "block", None))
    accepted = defaultdict(D)
    for r in receipts:
        if r["po"] and not same(r["po"], order["number"]):
            issues.append(("reference", "block", None))
        if r["bill"] and bill["number"] and not same(r["bill"], bill["number"]):
            issues.append(("reference", "warn", None))
        to = pairs_by_hand(lines, r["lines"])
        for i, x in enumerate(r["lines"]):
            if i in to:
                accepted[to[i]] += x["accepted"] if x["accepted"] is not None else x["received"] or D(0)
            else:
                issues.append(("extra_line", "warn", i))
    if len({x["supplier"] for x in (order, bill, *receipts)} - {None, ""}) > 1:
        issues.append(("supplier", "block", None))
    to, due = pairs_by_hand(lines, bill["lines"]), D(0)
    for i, x in enumerate(bill["lines"]):
        if i not in to:
            issues.append(("extra_line", "block", i))
            continue
        o = lines[to[i]]
        if x["rate"] is not None and o["rate"] is not None and x["rate"] > o["rate"] * D("1.005"):
            issues.append(("price", "block", i))
        if x["quantity"] is not None:
            if receipts and x["quantity"] > accepted[to[i]]:
                issues.append(("quantity", "block", i))
            if o["quantity"] is not None and x["quantity"] > o["quantity"]:
                issues.append(("quantity", "block", i))
            if o["rate"] is not None:
                due += (min(x["quantity"], accepted[to[i]]) if receipts else x["quantity"]) * o["rate"] - (x["discount"] or 0)
        if x["gst"] is not None and o["gst"] is not None and abs(x["gst"] - o["gst"]) > D("0.001"):
            issues.append(("tax", "block", i))
    issues += [("missing_line", "warn", p) for p in range(len(lines)) if p not in to.values() and receipts and accepted[p] > 0]
    if bill["subtotal"] is not None and bill["lines"] and len(to) == len(bill["lines"]) and abs(bill["subtotal"] - due) > max(D(1), due * D("0.001")):
        issues.append(("total", "block", None))
    status = "incomplete" if not lines or not bill["lines"] else "mismatch" if any(s == "block" for _, s, _ in issues) else "matched"
    return status, issues, to


def scene(dice, plain):
    names = ["MS Hex Bolt M12 x 50", "M.S. HEX BOLT M12x50", "Copper wire 2.5 sqmm", "copper wire 4 sqmm", "Paint white 20 l", None, "Gasket"]
    pick = lambda *x: x[0] if plain else dice.choice(x)
    line = lambda i: {"code": pick(f"C{i}", f"c{i} ", "C0", None, ""), "text": dice.choice(names), "hsn": pick("7318", "73181500", None), "quantity": pick(D("10.00"), D("12.00"), None), "rate": pick(D("5.00"), D("5.20"), None), "gst": pick(D("18.00"), D("12.00"), None), "discount": pick(None, D("2.00"))}
    lines = [line(i) for i in range(dice.randrange(0 if not plain else 1, 5))]
    copy = lambda: [x | {"text": dice.choice(names)} if not plain and dice.random() < 0.3 else dict(x) for x in lines if plain or dice.random() < 0.9]
    billed = copy() + ([line(9)] if not plain and dice.random() < 0.3 else [])
    order = {"number": "PO-007", "supplier": pick("S1", None), "lines": lines}
    receipts = [{"po": pick("007", "PO 8", None), "bill": pick("I-1", "I-2", ""), "supplier": pick("S1", "S2", None), "lines": [x | {"received": x["quantity"], "accepted": pick(x["quantity"], None, D("3.00"))} for x in copy()]} for _ in range(1 if plain else dice.randrange(3))]
    subtotal = sum((x["quantity"] or 0) * (x["rate"] or 0) for x in lines)
    return order, receipts, {"po": pick("po007", None, "9"), "number": pick("I-1", None), "supplier": pick("S1", "S2", ""), "subtotal": pick(D(subtotal), None, D("1.00")), "lines": billed}


def test_three_way_by_hand(spark):
    dice = random.Random(3)
    scenes = [scene(dice, i % 7 == 0) for i in range(120)]
    plain = lambda d, i, x: (d, i, x["code"], x["text"], x["hsn"], x["quantity"], x["rate"], x["gst"], x["discount"])
    tables = [
        spark.createDataFrame([(d, o["number"], o["supplier"]) for d, (o, _, _) in enumerate(scenes)], "doc_id long, po_number string, supplier_gstin string"),
        spark.createDataFrame([plain(d, i, x) for d, (o, _, _) in enumerate(scenes) for i, x in enumerate(o["lines"])], LINE),
        spark.createDataFrame([(d, f"r{n}", r["po"], r["bill"], r["supplier"]) for d, (_, rs, _) in enumerate(scenes) for n, r in enumerate(rs)], "doc_id long, receipt_id string, po_reference string, supplier_invoice_reference string, supplier_gstin string"),
        spark.createDataFrame([(d, f"r{n}", i, x["code"], x["text"], x["hsn"], x["received"], x["accepted"]) for d, (_, rs, _) in enumerate(scenes) for n, r in enumerate(rs) for i, x in enumerate(r["lines"])], RECEIVED),
        spark.createDataFrame([(d, b["number"], b["po"], b["supplier"], b["subtotal"]) for d, (_, _, b) in enumerate(scenes)], "doc_id long, invoice_number string, po_reference string, supplier_gstin string, subtotal decimal(18,2)"),
        spark.createDataFrame([plain(d, i, x) for d, (_, _, b) in enumerate(scenes) for i, x in enumerate(b["lines"])], LINE),
    ]
    lines, issues = matching.three_way(*tables)
    status = {r["doc_id"]: r["status"] for r in matching.match_results(tables[4], tables[1], lines, issues).collect()}
    got, pairs = defaultdict(list), defaultdict(dict)
    for r in issues.collect():
        got[r["doc_id"]].append((r["kind"], r["severity"], r["line_index"]))
    for r in lines.where("po_line is not null").collect():
        pairs[r["doc_id"]][r["line_index"]] = r["po_line"]
    key = lambda x: (x[0], x[1], -1 if x[2] is None else x[2])
    for d, parts in enumerate(scenes):
        want = match_by_hand(*parts)
        assert (status[d], sorted(got[d], key=key), pairs[d]) == (want[0], sorted(want[1], key=key), want[2]), d
    assert {"matched", "mismatch", "incomplete"} == set(status.values())


def test_greedy_of_many_and_equal_lines(spark):
    """Documents of equal lines, of ties, of lines without texts and of hundreds of lines, against the plain fold."""
    dice = random.Random(12)
    words = ["bolt", "nut", "washer", "m8", "m10", "zinc", "hex", "long", "aa", "aa1", "steel"]
    name = lambda n: " ".join(dice.choices(words, k=n))
    docs = {
        1: ([("x", "bolt m8", "7318")] * 6, [("x", "bolt m8", "7318")] * 4),
        2: ([(None, "bolt m8", "7318")] * 5 + [(None, "bolt", None)] * 2, [(None, "m8 bolt zinc", "7318")] * 3 + [(None, "bolt m8", None)] * 4),
        3: ([(None, "", "1")] * 2 + [(" a1", None, None)], [("A1 ", "other", None), (None, "", "1")]),
        4: ([(None, "aa aa aa aa", None)], [(None, "aa1", None), (None, "a a", None)]),
    }
    for d in range(5, 25):
        some = lambda k: [(dice.choice([None, None, f"c{dice.randrange(4)}"]), name(dice.randrange(0, 4)), dice.choice([None, "7318", "73181500", "84"])) for _ in range(k)]
        docs[d] = some(dice.randrange(0, 9)), some(dice.randrange(0, 9))
    docs[99] = [(None, f"{name(2)} {i}", None) for i in range(150)], [(None, f"{name(2)} {i}", None) for i in range(150)]
    table = lambda k, x: spark.createDataFrame([(d, i, *r) for d, both in docs.items() for i, r in enumerate(both[k])], f"doc_id long, {x}_index int, {x}_code string, {x}_text string, {x}_hsn string").repartition(4)
    got = defaultdict(dict)
    for r in matching.matched_lines(table(0, "a"), table(1, "b")).collect():
        got[r["doc_id"]][r["b_index"]] = r["a_index"]
    line = lambda r: dict(zip(("code", "text", "hsn"), r, strict=True))
    for d, (a, b) in docs.items():
        assert got[d] == pairs_by_hand([line(r) for r in a], [line(r) for r in b]), d
    scored = matching.similarity(table(0, "a").where("doc_id < 25"), table(1, "b").where("doc_id < 25"), 70.0)
    want = {(d, i, j): s for d, (a, b) in docs.items() if d < 25 for i, x in enumerate(a) for j, y in enumerate(b) if (s := alike(line(x), line(y))) >= 70}
    assert {(r["doc_id"], r["a_index"], r["b_index"]): r["score"] for r in scored.collect()} == pytest.approx(want)
    assert matching.matched_lines(table(0, "a").limit(0), table(1, "b")).count() == 0


def test_each_different_pair_is_scored_once(monkeypatch):
    scored = []
    monkeypatch.setattr(text, "_alike", lambda a, b: scored.append((a, b)) or float(len(a)))
    text._remembered.cache_clear()
    monkeypatch.setattr(text, "_remembered", text._alike)
    got = text._alike_once(pa.array(["aa", "b", None, "aa", "aa"] * 50), pa.array(["x", "x", "x", "x", None] * 50))
    assert got.tolist() == [2.0, 1.0, 0.0, 2.0, 0.0] * 50 and sorted(scored) == [("aa", "x"), ("b", "x")]


def _written(spark):
    folder = shared_folder(spark).removeprefix("file://") + "/docproof"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_greedy_takes_all_ties_in_one_pass(spark):
    """Different texts at one score, which went one pair a round; classes that meet others again with what they have left."""
    table = lambda x, texts: spark.createDataFrame([(1, i, None, t, None) for i, t in enumerate(texts)], f"doc_id long, {x}_index int, {x}_code string, {x}_text string, {x}_hsn string")
    before = _written(spark)
    found = matching.matched_lines(table("a", [f"bolt {i:02}" for i in range(40)]), table("b", [f"bolt {i:02}x" for i in range(40)]))
    assert found.count() == 40 and _written(spark) == before
    scores = spark.createDataFrame([(1, a, b, 80.0) for a in ([9, 1], [5]) for b in ([7, 2], [4])], "doc_id long, a_lines array<int>, b_lines array<int>, score double")
    assert sorted((r["a_index"], r["b_index"]) for r in matching._greedy(scores).collect()) == [(1, 2), (5, 4), (9, 7)]


def test_reference_issues_pair_no_lines(spark, sf_dir):
    before = _written(spark)
    QUERIES["MT4_reference_issues"](spark, sf_dir)
    assert {x.rsplit("-", 1)[0] for x in _written(spark) - before} == {"match-headers", "match-receipts"}


def test_documents_are_joined_without_broadcasts(spark):
    """Tables of a row a document look small by their files, and the driver could not hold them."""
    docs = spark.range(5).selectExpr("id as doc_id", "'r' as receipt_id", "'PO-1' as po_number", "'1' as po_reference", "'I' as invoice_number", "'J' as supplier_invoice_reference", "'S' as supplier_gstin", "1.0 as subtotal")
    found = matching.reference_issues(docs, docs.drop("po_number", "invoice_number"), docs.drop("po_number"))
    assert found.count() == 5 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    results = matching.match_results(docs, docs, docs.selectExpr("doc_id", "subtotal as payable"), found)
    assert "Broadcast" not in results._jdf.queryExecution().executedPlan().toString()
