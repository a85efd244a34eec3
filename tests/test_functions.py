"""Scalars against known values."""

import hashlib
import hmac
import math

import pytest
from pyspark.sql import functions as F

from docproof.functions import gst, text
from docproof.functions import normalize as norm
from docproof.operators import checks, codes, evidence, matching, metrics, records, repair, risk
from docproof.plans.queries import QUERIES
from tests import plain
from docproof.sources import datasets


def ask(spark, f, rows, schema):
    return [r["out"] for r in spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}").select("i", f.alias("out")).orderBy("i").collect()]


def test_amounts(spark):
    said = {"₹ 1,23,456.50/-": 123456.5, "(1,200.00)": -1200, "nil": 0, "-": 0, "Rs.500 only": 500, "१२३": 123, "−5": -5, "+7": 7, "abc": None, "": None, "1.2.3": None, ".5": 0.5, "450-": 450, None: None}
    got = ask(spark, norm.parse_amount("x").cast("double"), list(said), "x string")
    assert got == list(said.values())
    assert ask(spark, norm.parse_int("x"), ["12", "12.5", "x"], "x string") == [12, None, None]
    assert ask(spark, norm.parse_percent("x").cast("double"), ["9% + 9%", "18", "x+1", ""], "x string") == [18, 18, None, None]


def test_dates(spark):
    said = {"2025-02-05": "2025-02-05", "05/06/2025": "2025-06-05", "31-2-25": None, "5 Jun 2025": "2025-06-05", "March 3rd, 2024": "2024-03-03", "5 जून 2025": "2025-06-05", "१-७-24": "2024-07-01", "soon": None, None: None}
    assert ask(spark, F.date_format(norm.parse_date("x"), "yyyy-MM-dd"), list(said), "x string") == list(said.values())


def test_codes(spark):
    assert ask(spark, gst.gstin_problem("x"), ["27AAPFU0939F1ZV", "24AAACC1206D1ZM", "27AAPFU0939F1ZY", "99X", "98AAPFU0939F1ZV", "", None], "x string") == [None, None, "checksum", "format", "state", None, None]
    assert ask(spark, gst.state_code("x"), ["27-Maharashtra", "Maharashtra (27)", "ORISSA", "Delhi", "nadu", "x", None], "x string") == ["27", "27", "21", "07", None, None, None]
    assert ask(spark, gst.look_alike("a", "b"), [("27AAPFU0939F1ZV", "27AAPFUO939F1ZV"), ("27AAPFU0939F1ZV", "27AAPFU0939F1ZV"), ("27AAPFU0939F1ZV", "27AAPFX0939F1ZV")], "a string, b string") == [True, False, False]
    assert ask(spark, gst.repairs("x"), ["27AAPFUO939F1ZV", "27AAPFU0939F1ZV"], "x string") == [["27AAPFU0939F1ZV"], []]
    assert ask(spark, norm.shape_mask("x"), ["INV/24-25/0123"], "x string") == ["AAA/99-99/9999"]
    assert ask(spark, norm.safe_cell("x"), ["=1+1", "-5", "@x", "ok", "+1e3"], "x string") == ["'=1+1", "-5", "'@x", "ok", "+1e3"]
    assert ask(spark, norm.indian_grouping(F.col("x")), [123456.0, -1234567.5, 12.0, None], "x double") == ["₹1,23,456.00", "-₹12,34,567.50", "₹12.00", "-"]
    assert ask(spark, norm.financial_year("x", "2025-06-30"), ["INV/24-25/04", "24/26", "2023-24", "99-00", None], "x string") == [2024, None, 2023, None, None]


def test_words(spark):
    said = {
        "Rupees One Lakh Twenty Three Thousand Four Hundred Fifty Six and Fifty Paise Only": 123456.5,
        "एक लाख तेईस हज़ार चार सौ छप्पन रुपये मात्र": 123456,
        "पाँच सौ रुपये पचास पैसे": 500.5,
        "fifty paise": 0.5,
        "two crore": 2e7,
        "five hundred thousand two hundred and one": 500201,
        "hundred five thousand": 105000,
        "thousand crore": 10001000,
        "hundred": None,
        "सौ": 100,
        "दो करोड़ पाँच लाख": 20500000,
        "seven rupees and five paise": 7.05,
        "many rupees": None,
        "": None,
        "only": None,
    }
    assert [None if x is None else float(x) for x in ask(spark, gst.words_to_amount("x"), [(x,) for x in said], "x string")] == list(said.values())
    numbers = [0.0, 1.0, 21.05, 100.0, 999999.99, 12345678.9, 305000.0]
    assert ask(spark, gst.words_to_amount(gst.amount_to_words("x")).cast("double"), numbers, "x double") == numbers


def test_comparison(spark):
    rows = [("number", "10.00", "10.001"), ("number", "10", "11"), ("string", "A b", "ab."), ("text", None, None), ("text", "a", None)]
    assert ask(spark, norm.values_agree("k", "a", "b"), rows, "k string, a string, b string") == [True, False, True, True, False]
    said = "12, Industrial Area Phase II, Near Railway {}, Pune"
    rows = [("text", said.format("Station"), said.format("Statin")), ("text", said.format("Station"), "14, Market Yard, Opposite the Bus Stand, Nagpur"), ("text", "Railway Station", "Railway Statin"), ("string", said.format("Station"), said.format("Statin"))]
    assert ask(spark, norm.values_agree("k", "a", "b"), rows, "k string, a string, b string") == [True, False, False, False]
    assert ask(spark, norm.parse_amount("x").cast("double"), ["\t12.5\n", "\u00a07 "], "x string") == [12.5, 7.0]
    dates = {" 5th Jun, 2025\t": "2025-06-05", "jun. 5 2025": "2025-06-05", "5/6-25": "2025-06-05", "5june25": "2025-06-05", "5 6 2025": None, "june 5 25": None, "2025-6-5": "2025-06-05", "25-6-5": None, "5-जून-2025": "2025-06-05", "5 ju 2025": None, "31/02/2025": None, "123/1/2025": None}
    assert [str(x) if x else None for x in ask(spark, norm.parse_date("x"), list(dates), "x string")] == list(dates.values())
    rows = [("number", "12.5", "Rs 12.50"), ("number", "12.5", "13"), ("date", "2025-06-05", "5/6/25"), ("gstin", "AB1", "ab-1"), ("text", "x", "x"), ("number", None, "1")]
    assert ask(spark, norm.raw_consistent("k", "v", "r"), rows, "k string, v string, r string") == [True, False, True, True, None, None]


def test_similarity():
    slow = lambda a, b: max([0, *(1 + slow(a[:i], b[:j]) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j])])
    for a, b in [("abcde", "badce"), ("aab", "aba"), ("", "x"), ("hexbolt", "heXbolt"), ("aaa", "aa")]:
        assert plain.common(a, b) == slow(a, b)
    assert plain.ratio_of("abc", "abc") == 100 and plain.token_set_of("ms hex bolt", "hex bolt ms m12") == 100 and plain.token_set_of("", "a") == 0


def test_native_similarity_is_the_plain_one(spark):
    import random

    dice = random.Random(8)
    word = lambda: "".join(dice.choices("abcdehlmort0 1", k=dice.randrange(1, 9)))
    pairs = [(" ".join(word() for _ in range(dice.randrange(0, 6))), " ".join(word() for _ in range(dice.randrange(0, 6)))) for _ in range(300)]
    pairs += [(x, "".join(dice.sample(x, len(x)))) for x in ("abcdefgh" * n for n in (7, 8, 16, 30))] + [("a" * 62, "a" * 63), ("ab" * 62, "ba" * 62), ("", ""), ("", "x"), ("क१🙂", "१क🙂🙂"), ("x" * 125, "x" * 125 + "y"), ("bolt m8 bolt", "m8 bolt")]
    rows = spark.createDataFrame(pairs, "a string, b string").repartition(4).select("a", "b", text.common_length("a", "b").alias("n"), text.ratio("a", "b").alias("r"), text.token_set_ratio("a", "b").alias("t")).collect()
    for r in rows:
        assert (r["n"], r["r"], r["t"]) == (plain.common(r["a"], r["b"]), plain.ratio_of(r["a"], r["b"]), pytest.approx(plain.token_set_of(r["a"], r["b"]), abs=1e-9)), r
    assert spark.createDataFrame([("a", None)], "a string, b string").select(text.ratio("a", "b"), text.token_set_ratio("b", "a")).first() == (None, None)
    plan = spark.createDataFrame(pairs, "a string, b string").select(text.token_set_ratio("a", "b"))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_matching(spark):
    scores = spark.createDataFrame([(1, 0, 0, 90.0), (1, 0, 1, 90.0), (1, 1, 1, 80.0), (1, 1, 0, 75.0), (1, 2, 2, 60.0)], "doc_id long, a_index int, b_index int, score double")
    assert sorted((r["a_index"], r["b_index"]) for r in matching.greedy_pairs(scores).collect()) == [(0, 1), (1, 0)]
    assert ask(spark, matching.same_reference("a", "b"), [("PO-0012", "12"), ("PO-12", "po12"), ("12", "13"), ("", "1"), (None, "1")], "a string, b string") == [True, True, False, False, None]


def test_line_rules(spark):
    rows = [(1, 0, "100", "450", "100 NOS", "450"), (1, 1, "2", "10", None, "20.5"), (1, 2, "2", "10", None, "21"), (1, 3, None, "10", None, "20")]
    lines = spark.createDataFrame(rows, "doc_id long, line_index int, q string, r string, rate_per string, t string").selectExpr("doc_id", "line_index", "cast(q as decimal(18,2)) quantity", "cast(r as decimal(18,2)) rate", "rate_per", "cast(t as decimal(18,2)) taxable_value", "cast(null as decimal(9,2)) gst_rate")
    assert {r["check_id"]: r["status"] for r in checks.line_checks(lines).collect()} == {"line_math:0": "pass", "line_math:1": "pass", "line_math:2": "fail"}


def test_slips_and_signals(spark):
    assert ask(spark, evidence.history_signal("c", "t"), [(0, 0), (90, 100)], "c int, t int") == [0.0, pytest.approx(0.0, abs=1e-12)]


def test_pseudonym(spark):
    key, long = "k" * 10, "k" * 100
    for k in (key, long):
        assert ask(spark, records.hmac_sha256(F.col("x"), k), ["some text"], "x string") == [hmac.new(k.encode(), b"some text", hashlib.sha256).hexdigest()]


def test_quantile(spark):
    rows = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4, 4)] + [("b", 7)], "k string, v int")
    assert {r["k"]: (r["q0"], r["q50"], r["q95"]) for r in metrics.nearest_quantile(rows, "k", "v", 0.0, 0.5, 0.95).collect()} == {"a": (1, 3, 4), "b": (7, 7, 7)}


def test_exact_tails():
    exact = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    for k, n, p in [(0, 10, 0.1), (3, 50, 0.05), (20, 400, 0.04), (5, 5, 0.3), (1, 600, 0.003), (100, 5000, 0.02)]:
        assert risk.binomial_tail(k, n, p) == pytest.approx(exact(k, n, p), abs=1e-9)
    assert risk.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9) and risk.upper_bound(0, 0, 0.05) == 1.0


def test_certificate_holds(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "cast(round((id % 100) / 100, 2) as double) as score", "pmod(xxhash64(id), 1000) < case when id % 100 < 50 then 200 else 0 end as wrong")
    found = risk.certify(rows, 0.01, 0.05)
    assert found["threshold"] is not None and 0.4 < found["threshold"] <= 0.5 and found["upper"] <= 0.0101
    assert risk.certify(rows.limit(0), 0.01, 0.05)["threshold"] is None


def test_certificates_by_hand(spark):
    """Corrected fields of high score count, each group has its own alpha, the fit half guides, and only sampled documents certify."""

    def straight(cal, guide, alpha, delta):
        p = lambda rows, t: (lambda n, k: risk.binomial_tail(k, n, alpha) if n >= 1 else 1.0)(sum(s >= t for s, _ in rows), sum(w for s, w in rows if s >= t))
        steps, found = sorted({s for s, _ in cal}, reverse=True), None
        start = min(range(len(steps)), key=lambda i: p(guide, steps[i]))
        for t in steps[start:]:
            if p(cal, t) > delta:
                break
            found = t
        return found

    # one field a document, so the design effect is 1; errors lie at 0.6 to 0.7, above the middle
    every = [(i, i % 100 / 100, i % 3 > 0, 60 <= i % 100 < 70 and i % 2 == 0 or i % 100 < 30, i % 7 != 0) for i in range(24_000)]
    fields = spark.createDataFrame([(i, 0, s, h, "corrected" if w else "auto", "1", "2" if w else None) for i, s, h, w, _ in every], "doc_id long, line_index int, score double, is_high_stakes boolean, status string, value string, final_value string")
    docs = spark.createDataFrame([(i, q, "x") for i, _, _, _, q in every], "doc_id long, is_qa_sample boolean, reviewed_at string")
    got = risk.certificates(risk.labelled(fields, docs))
    fit = {i for i, *_ in every if hashlib.sha256(str(i).encode()).digest()[0] < 128}
    for group, alpha in (("normal", 0.01), ("high_stakes", 0.003)):
        mine = [(i, s, w) for i, s, h, w, q in every if q and h == (group == "high_stakes")]
        want = straight([(s, w) for i, s, w in mine if i not in fit], [(s, w) for i, s, w in mine if i in fit], alpha, 0.025)
        assert want is not None and want > 0.65 and got[group]["threshold"] == want
    unsampled = risk.certificates(risk.labelled(fields, docs.withColumn("is_qa_sample", F.lit(False))))
    assert [c["threshold"] for c in unsampled.values()] == [None, None]


def test_certificate_query_has_both_groups(spark, sf_dir):
    assert [r["stakes"] for r in QUERIES["RC9_certificate"](spark, sf_dir).orderBy("stakes").collect()] == ["high_stakes", "normal"]


def test_refit_recovers_weights(spark):
    rows = spark.range(6000).selectExpr("1.0 as bias", "cast(id % 2 as double) as x", "cast(pmod(xxhash64(id), 1000) < case when id % 2 = 1 then 900 else 300 end as int) as y")
    w = risk.refit(rows, ["bias", "x"], "y")
    assert w["bias"] == pytest.approx(math.log(3 / 7), abs=0.15) and w["x"] == pytest.approx(math.log(9) - math.log(3 / 7), abs=0.2)


def test_labelled_folder(spark, tmp_path):
    (tmp_path / "digital").mkdir()
    for name in ("a.pdf", "a.jpg", "b.txt", "c.png"):
        (tmp_path / "digital" / name).write_bytes(b"x")
    for name in ("a", "b", "d"):
        (tmp_path / "digital" / f"{name}.truth.json").write_text('{"doc_type": "invoice", "bucket": "digital", "fields": {"total": 5},\n "line_items": [{"quantity": 2}]}')
    found = datasets.labelled(spark, f"file://{tmp_path}").collect()
    assert [(r["name"], r["path"].rsplit("/", 1)[1], r["bucket"], r["fields"], r["line_items"]) for r in found] == [("a", "a.jpg", "digital", {"total": "5"}, [{"quantity": "2"}])]


def test_synthetic_documents_are_exact(spark):
    from docproof.plans.queries import QUERIES

    found = {r["rule"]: r for r in QUERIES["SRC13_synthetic"](spark, "").collect()}
    assert {"line_math", "line_tax", "line_total", "lines_sum_subtotal", "tax_sum", "grand_total", "amount_in_words", "tax_type_vs_state", "total_freight", "freight_math"} <= set(found)
    assert {k: r["failed"] for k, r in found.items() if r["failed"]} == {}
    heads = datasets.invoice_headers(datasets.invoice_lines(spark, 50), "2024-06-30")
    assert heads.where(gst.gstin_problem("supplier_gstin").isNotNull() | gst.gstin_problem("buyer_gstin").isNotNull()).isEmpty()
    again = datasets.invoice_headers(datasets.invoice_lines(spark, 80).where("doc_id < 50"), "2024-06-30")
    assert heads.exceptAll(again).isEmpty()


def test_grounding(spark):
    pages = spark.createDataFrame([(1, 2, "Date 05/06/2025"), (1, 1, "Total ₹ 1,23,456.50\nGSTIN 27AAPFU 0939F1ZV  Acme   Ltd"), (2, 1, "x"), (2, 2, None)], "doc_id int, page int, text string")
    asked = [("number", "123456.5"), ("number", "-123456.50"), ("number", "99"), ("number", "x"), ("gstin", "27AAPFU0939F1ZV"), ("string", "ACME LTD"), ("string", "Ac"), ("date", "2025-06-05"), ("date", "2025-05-06"), ("text", "Acme"), ("string", None)]
    fields = spark.createDataFrame([(1, str(i), k, v) for i, (k, v) in enumerate(asked)] + [(2, "0", "string", "xxx"), (3, "0", "string", "xxx")], "doc_id int, field_name string, kind string, value string")
    rows = {(r["doc_id"], int(r["field_name"])): r["in_text_layer"] for r in codes.grounded(fields, codes.text_layers(pages)).collect()}
    assert [rows[1, i] for i in range(len(asked))] == [True, True, False, False, True, True, None, True, False, None, None]
    assert rows[2, 0] is None and rows[3, 0] is None


def test_empty_reports(spark):
    gate = spark.createDataFrame([], "doc_type string, quality string, passed boolean")
    assert [tuple(r) for r in metrics.readiness(gate).collect()] == [("no_eval_run", 0, [])]


def test_failed_jobs_and_retries(spark):
    docs = spark.createDataFrame([(1, "processing"), (2, "ready"), (3, None), (None, "processing"), (4, "failed"), (5, "processing")], "doc_id long, status string")
    jobs = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,), (99,)], "doc_id long")
    after = records.fail_processing(docs, jobs)
    assert sorted(map(str, after.collect())) == sorted(map(str, spark.createDataFrame([(1, "failed"), (2, "ready"), (3, None), (None, "processing"), (4, "failed"), (5, "processing")], docs.schema).collect()))
    again, answers = records.retry(after, jobs)
    assert {(r[0], r[1]) for r in again.collect()} == {(1, "uploaded"), (2, "ready"), (3, None), (None, "processing"), (4, "failed"), (5, "processing")}
    assert sorted(map(tuple, answers.collect())) == [(1, True), (2, False), (3, False)]


def test_needs_reread_with_nulls(spark):
    flags = "value string, legibility string, high boolean, raw boolean, settled boolean"
    rows = [("1", "clear", False, None, False), ("1", "clear", None, False, None), ("1", "clear", True, True, True), (None, "not_present", True, False, False), (None, "illegible", False, None, False), (None, None, None, None, None), ("1", "partly_legible", False, True, False)]
    f = spark.createDataFrame(rows, flags)
    no = F.lit(False)
    got = f.select(evidence.needs_reread(F.col("value"), F.col("legibility"), F.col("high"), no, F.col("raw"), no, F.col("settled"))).collect()
    assert [r[0] for r in got] == [False, True, False, False, True, False, True]
