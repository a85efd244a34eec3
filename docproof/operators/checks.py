"""Rules over documents: each gives rows (doc_id, check_id, status, severity, field_keys, calc, printed).

Line rules are row expressions, and header rules need lines only as sums, grouped once a document; all rules of a scope
are built as one array of structs and exploded, so that a table is read once for all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docproof.functions.gst import RATES, STATES, gstin_problem, state_code, words_to_amount
from docproof.functions.normalize import HSN, IFSC, VEHICLE, financial_year
from docproof.settings import DEFAULTS, Settings

MONEY = "decimal(18,2)"
ZERO = F.lit
FORMATS = {"vehicle": VEHICLE, "ifsc": IFSC, "hsn": HSN, "eway_bill_number": "^[0-9]{12}$", "irn": "^[0-9a-fA-F]{64}$"}


def dec(x: str) -> Column:
    return F.lit(x).cast("decimal(18,5)")


def within(a: Column, b: Column, absolute: str, relative: str) -> Column:
    """|a - b| <= max(absolute, relative * max(|a|, |b|))."""
    return F.abs(a - b) <= F.greatest(dec(absolute), dec(relative) * F.greatest(F.abs(a), F.abs(b)))


def same(a: Column, b: Column, s: Settings = DEFAULTS) -> Column:
    return within(a, b, s.amount_abs, s.amount_rel)


def zero(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0).cast(MONEY))


def _check(name: str | Column, when: Column, ok: Column, keys: list[str | Column], severity: str | Column = "error", calc: Column | None = None, printed: Column | None = None) -> Column:
    """A check's row, or null where it does not apply."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    number = lambda x: (F.lit(None) if x is None else x).cast("decimal(38,4)")
    return F.when(
        when,
        F.struct(
            lit(name).alias("check_id"),
            F.when(ok, "pass").otherwise("fail").alias("status"),
            lit(severity).alias("severity"),
            F.array(*map(lit, keys)).alias("field_keys"),
            number(calc).alias("calc"),
            number(printed).alias("printed"),
        ),
    )


def _chosen(checks: dict[str, Column], only: tuple[str, ...] | None) -> list[Column]:
    """The checks of the families asked for: what is not asked for is not in the plan."""
    return [c for name, c in checks.items() if only is None or name.split(":")[0] in only]


def _rows(df: DataFrame, checks: list[Column]) -> DataFrame:
    return df.select("doc_id", F.explode(F.array_compact(F.array(*checks))).alias("c")).select("doc_id", "c.*")


def _optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with the columns that it lacks as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def per_factor(rate_per: Column | str) -> Column:
    n = F.regexp_extract(rate_per, r"^\s*([0-9]+)", 1).try_cast("int")
    return F.when(n > 1, n).otherwise(1)


def line_checks(lines: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """Invoice lines: quantity times rate, tax, legal rate, total."""
    lines = _optional(lines, dict.fromkeys(("discount", "cgst_amount", "sgst_amount", "igst_amount", "line_total"), MONEY) | {"rate_per": "string", "gst_rate": "decimal(9,2)"})
    q, r, t, pct, total = (F.col(c) for c in ("quantity", "rate", "taxable_value", "gst_rate", "line_total"))
    disc = zero("discount")
    tol = lambda x, rel: F.greatest(dec("0.51"), F.abs(x) * dec(rel))
    straight = (q * r).cast("decimal(18,4)") - disc
    per = per_factor("rate_per")
    per_unit = (q * r / per).cast("decimal(18,4)") - disc
    close = lambda calc: F.abs(calc - t) <= tol(t, "0.0005")
    use_per = ~close(straight) & (per > 1)
    calc = F.when(use_per, per_unit).otherwise(straight)
    heads = [F.col(f"{h}_amount") for h in ("cgst", "sgst", "igst")]
    tax = reduce(lambda a, b: a + b, map(zero, heads))
    has_tax = F.coalesce(*heads).isNotNull()
    due = (t * pct / 100).cast("decimal(18,4)")
    total_ok = (F.abs(total - t) <= dec("0.51")) | ((tax > 0) & (F.abs(total - t - tax) <= dec("0.51")))
    total_ok |= F.coalesce((tax == 0) & (F.abs(total - t - due) <= tol(total, "0.0005")), F.lit(False))
    key = lambda *names: [F.format_string(f"line_items[%d].{n}", "line_index") for n in names]
    name = lambda n: F.concat(F.lit(f"{n}:"), F.col("line_index"))
    found = {
        "line_math": _check(name("line_math"), q.isNotNull() & r.isNotNull() & t.isNotNull(), close(calc), key("quantity", "rate", "discount", "taxable_value"), calc=calc, printed=t),
        "line_tax": _check(name("line_tax"), t.isNotNull() & pct.isNotNull() & has_tax, F.abs(due - tax) <= F.greatest(dec("0.51"), tax * dec("0.001")), key("taxable_value", "gst_rate", "cgst_amount", "sgst_amount", "igst_amount"), calc=due, printed=tax),
        "gst_slab": _check(name("gst_slab"), pct.isNotNull() & ~pct.isin(*[F.lit(x).cast("decimal(9,2)") for x in RATES]), F.lit(False), key("gst_rate")),
        "line_total": _check(name("line_total"), total.isNotNull() & t.isNotNull(), total_ok, key("taxable_value", "line_total", "cgst_amount", "sgst_amount", "igst_amount"), calc=t + tax, printed=total),
    }
    return _rows(lines, _chosen(found, only))


def with_line_sums(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Headers with what their rules need of the lines, grouped once."""
    lines = _optional(lines, dict.fromkeys(("cgst_amount", "sgst_amount", "igst_amount", "line_total"), MONEY))
    total = lambda c: F.sum(c).cast(MONEY)
    t, pct = F.col("taxable_value"), F.col("gst_rate")
    sums = lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines_n"),
        F.count("taxable_value").alias("lines_taxed"),
        total("taxable_value").alias("lines_taxable"),
        F.count(F.when(t.isNotNull() & pct.isNotNull(), 1)).alias("lines_rated"),
        F.sum((t * pct / 100).cast("decimal(18,4)")).cast("decimal(20,4)").alias("lines_due"),
        F.max(F.when(t.isNotNull(), pct)).alias("lines_top_rate"),
        *[total(f"{h}_amount").alias(f"lines_{h}") for h in ("cgst", "sgst", "igst")],
        F.count("line_total").alias("lines_totalled"),
        total("line_total").alias("lines_total"),
    )
    return headers.join(sums, "doc_id", "left")


def date_check(name: str, as_of: str) -> Column:
    d, today = F.col(name), F.lit(as_of).cast("date")
    ahead, old = d > F.date_add(today, 1), d < F.date_sub(today, 3 * 365)
    return _check(f"date:{name}", d.isNotNull(), ~(ahead | old), [name], F.when(old, "warn").otherwise("error"))


def invoice_checks(headers: DataFrame, lines: DataFrame, s: Settings = DEFAULTS, only: tuple[str, ...] | None = None) -> DataFrame:
    """Invoice headers: sums, tax, states, total, round-off, words, identifiers, dates."""
    return header_checks(with_line_sums(headers, lines), s, only)


def header_checks(headers: DataFrame, s: Settings = DEFAULTS, only: tuple[str, ...] | None = None) -> DataFrame:
    """``invoice_checks`` of headers that carry the sums of their lines (``with_line_sums``)."""
    h, rules = _header_rules(headers, s)
    return _rows(h, _chosen(rules, only))


def _header_rules(headers: DataFrame, s: Settings) -> tuple[DataFrame, dict[str, Column]]:
    money = ("cgst_amount", "sgst_amount", "igst_amount", "cess_amount", "tcs_amount", "other_charges", "discount_total", "round_off")
    said = "amount_in_words" in headers.columns
    h = _optional(headers, dict.fromkeys(money, MONEY) | {"amount_in_words": "string", "buyer_gstin": "string", "due_date": "date"})
    if said:  # a column of its own, so that the words are read once and not for each rule
        h = h.withColumn("words_amount", words_to_amount("amount_in_words"))
    sub, gt = F.col("subtotal"), F.col("grand_total")
    cgst, sgst, igst = (F.col(f"{x}_amount") for x in ("cgst", "sgst", "igst"))
    oc, disc = zero("other_charges"), zero("discount_total")
    tax = zero(cgst) + zero(sgst) + zero(igst)
    variants = lambda base, out=(F.lit(0), oc, -disc, oc - disc): [base + x for x in out]
    any_same = lambda values, b: reduce(lambda x, y: x | y, [same(v, b, s) for v in values])
    n = F.coalesce("lines_n", F.lit(0))
    extra = sub - F.col("lines_taxable")
    expected = F.col("lines_due") + F.when(extra > 0, (extra * F.col("lines_top_rate") / 100).cast("decimal(20,4)")).otherwise(0)
    all_rated = (n > 0) & (F.col("lines_rated") == n)
    eff = F.round((tax / sub * 100).cast("decimal(20,6)"), 2)
    slab = reduce(lambda a, b: a | b, [F.abs(eff - dec(r)) <= dec("0.05") for r in RATES])
    inclusive = (n > 0) & (F.col("lines_totalled") == n) & same(F.col("lines_total"), gt, s) & same(sub + tax, gt, s)
    rate_ok = F.when(all_rated, within(expected, tax, "2", s.amount_rel)).otherwise(slab | F.coalesce(inclusive, F.lit(False)))
    base = sub + tax + zero("cess_amount") + zero("tcs_amount") + zero("round_off")
    sup = F.substring("supplier_gstin", 1, 2)
    sup = F.when(sup.isin(*STATES), sup)
    buyer = F.substring("buyer_gstin", 1, 2)
    place = F.coalesce(state_code("place_of_supply"), F.when(buyer.isin(*STATES), buyer))
    split, whole = (zero(cgst) > 0) | (zero(sgst) > 0), zero(igst) > 0
    words = F.col("words_amount") if said else F.lit(None).cast(MONEY)
    checks = {
        "lines_sum_subtotal": _check("lines_sum_subtotal", (n > 0) & sub.isNotNull() & (F.col("lines_taxed") == n), any_same(variants(F.col("lines_taxable")), sub), ["subtotal"], calc=F.col("lines_taxable"), printed=sub),
        **{f"tax_sum:{x}": _check(f"tax_sum:{x}_amount", F.col(f"lines_{x}").isNotNull() & F.col(f"{x}_amount").isNotNull(), same(F.col(f"lines_{x}"), F.col(f"{x}_amount"), s), [f"{x}_amount"], calc=F.col(f"lines_{x}"), printed=F.col(f"{x}_amount")) for x in ("cgst", "sgst", "igst")},
        "tax_rate_reconcile": _check("tax_rate_reconcile", (sub > 0) & (cgst.isNotNull() | igst.isNotNull()), rate_ok, ["cgst_amount", "sgst_amount", "igst_amount", "subtotal"], F.when(all_rated | (n == 0), "error").otherwise("warn")),
        "cgst_eq_sgst": _check("cgst_eq_sgst", cgst.isNotNull() & sgst.isNotNull() & ((cgst != 0) | (sgst != 0)), F.abs(cgst - sgst) <= dec("0.02"), ["cgst_amount", "sgst_amount"]),
        "tax_type_vs_state": _check("tax_type_vs_state", sup.isNotNull() & place.isNotNull() & (tax > 0), F.when(sup == place, split & ~whole).otherwise(whole & ~split), ["cgst_amount", "sgst_amount", "igst_amount", "place_of_supply", "supplier_gstin"]),
        "grand_total": _check("grand_total", gt.isNotNull() & sub.isNotNull(), any_same(variants(base), gt), ["grand_total", "subtotal", *money], calc=F.coalesce(*[F.when(same(v, gt, s), v) for v in variants(base, (oc - disc, oc, -disc, F.lit(0)))], base + oc - disc), printed=gt),
        "round_off": _check("round_off", F.col("round_off").isNotNull(), F.abs("round_off") < 1, ["round_off"]),
        "amount_in_words:skip": F.when(F.col("amount_in_words").isNotNull() & gt.isNotNull() & words.isNull(), F.struct(F.lit("amount_in_words").alias("check_id"), F.lit("skip").alias("status"), F.lit("warn").alias("severity"), F.array(F.lit("amount_in_words")).alias("field_keys"), F.lit(None).cast("decimal(38,4)").alias("calc"), F.lit(None).cast("decimal(38,4)").alias("printed"))),
        "amount_in_words": _check("amount_in_words", words.isNotNull() & gt.isNotNull(), F.abs(words - gt) < 1, ["amount_in_words", "grand_total"], calc=words, printed=gt),
        "gstin_distinct": _check("gstin_distinct", (F.col("supplier_gstin") != "") & (F.col("supplier_gstin") == F.col("buyer_gstin")), F.lit(False), ["supplier_gstin", "buyer_gstin"]),
        "date": date_check("invoice_date", s.print_as_of),
        "due_after_invoice": _check("due_after_invoice", F.col("due_date") < F.col("invoice_date"), F.lit(False), ["due_date", "invoice_date"], "warn"),
    }
    return h, checks


def receipt_checks(headers: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Lorry receipts."""
    return _rows(*_receipt_rules(headers, s))


def _receipt_rules(headers: DataFrame, s: Settings) -> tuple[DataFrame, list[Column]]:
    h = _optional(headers, {"amount_in_words": "string", "consignor_gstin": "string", "consignee_gstin": "string", "lr_date": "date"})
    cw, aw, rate, fr, total = (F.col(c) for c in ("charged_weight_kg", "actual_weight_kg", "freight_rate", "freight_amount", "total_freight"))
    w = F.coalesce(cw, aw)
    bases = [w * rate, (w * rate / 100).cast("decimal(20,4)"), (w * rate / 1000).cast("decimal(20,4)"), F.col("packages_count") * rate, rate]
    words = words_to_amount("amount_in_words")
    calc = fr + zero("other_charges")
    return (
        h,
        [
            _check("charged_ge_actual", cw < aw, F.lit(False), ["charged_weight_kg", "actual_weight_kg"], "warn"),
            _check("freight_math", rate.isNotNull() & fr.isNotNull(), reduce(lambda a, b: a | b, [F.coalesce(same(b, fr, s), F.lit(False)) for b in bases]), ["freight_rate", "freight_amount", "charged_weight_kg", "packages_count"], "warn"),
            _check("total_freight", total.isNotNull() & fr.isNotNull(), same(calc, total, s), ["total_freight", "freight_amount", "other_charges"], calc=calc, printed=total),
            _check("amount_in_words", words.isNotNull() & total.isNotNull(), F.abs(words - total) < 1, ["amount_in_words", "total_freight"], calc=words, printed=total),
            _check("gstin_distinct", (F.col("consignor_gstin") != "") & (F.col("consignor_gstin") == F.col("consignee_gstin")), F.lit(False), ["consignor_gstin", "consignee_gstin"], "warn"),
            date_check("lr_date", s.print_as_of),
        ],
    )


def order_checks(headers: DataFrame, lines: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Purchase orders: headers (subtotal, taxes, grand_total, po_date) and lines (quantity, rate, discount, line_total)."""
    heads = ("cgst_amount", "sgst_amount", "igst_amount", "other_charges")
    h = _optional(headers, dict.fromkeys(heads, MONEY) | {"po_date": "date"})
    lines = _optional(lines, {"discount": MONEY})
    calc, amount = (F.col("quantity") * F.col("rate")).cast("decimal(18,4)") - zero("discount"), F.col("line_total")
    of_lines = _rows(lines, [_check(F.concat(F.lit("line_math:"), F.col("line_index")), calc.isNotNull() & amount.isNotNull(), F.abs(calc - amount) <= F.greatest(dec("0.51"), F.abs(amount) * dec("0.0005")), [F.format_string(f"line_items[%d].{n}", "line_index") for n in ("quantity", "rate", "discount", "line_total")], calc=calc, printed=amount)])
    sums = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count("line_total").alias("known"), F.sum("line_total").cast(MONEY).alias("total"))
    return of_lines.unionByName(_rows(h.join(sums, "doc_id", "left"), _order_rules("n", "known", "total", s)))


def _order_rules(n: str, known: str, of_lines: str, s: Settings) -> list[Column]:
    """An order's header against the number, the known number and the sum of its lines' totals."""
    heads = ("cgst_amount", "sgst_amount", "igst_amount", "other_charges")
    sums, total = F.col(of_lines), F.col("subtotal") + reduce(lambda a, b: a + b, map(zero, heads))
    return [
        _check("lines_sum_subtotal", (F.col(n) > 0) & (F.col(n) == F.col(known)) & F.col("subtotal").isNotNull(), same(sums, F.col("subtotal"), s), ["subtotal"], calc=sums, printed=F.col("subtotal")),
        _check("grand_total", F.col("subtotal").isNotNull() & F.col("grand_total").isNotNull(), same(total, F.col("grand_total"), s), ["grand_total", "subtotal", *heads], calc=total, printed=F.col("grand_total")),
        date_check("po_date", s.print_as_of),
    ]


def document_checks(headers: DataFrame, lines: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The rules of every header by its ``doc_type`` (invoice, lr, po, contract; others have none of their own): one table of documents, read
    once, with the rules of all types as one array of which each type keeps its own. ``lines`` are those of invoices and orders,
    grouped once. Columns of other types are null."""
    numbers = dict.fromkeys(("charged_weight_kg", "actual_weight_kg", "freight_rate", "freight_amount", "total_freight"), MONEY) | {"packages_count": "int"}
    days = dict.fromkeys(("po_date", "effective_date", "expiry_date", "lr_date", "due_date"), "date")
    texts = dict.fromkeys(("amount_in_words", "consignor_gstin", "consignee_gstin", "buyer_gstin"), "string")
    h, invoice = _header_rules(with_line_sums(_optional(headers, numbers | days | texts), lines), s)
    of = lambda kind, rules: F.when(F.col("doc_type") == kind, F.array(*rules))
    rules = F.coalesce(
        of("invoice", invoice.values()), of("lr", _receipt_rules(h, s)[1]), of("po", _order_rules("lines_n", "lines_totalled", "lines_total", s)), of("contract", _contract_rules())
    )
    return h.select("doc_id", F.explode(F.array_compact(rules)).alias("c")).select("doc_id", "c.*")


def goods_receipt_checks(lines: DataFrame) -> DataFrame:
    rec, acc = F.col("quantity_received"), F.col("quantity_accepted")
    return _rows(lines, [_check(F.concat(F.lit("accept_reject:"), F.col("line_index")), rec.isNotNull() & acc.isNotNull(), F.abs(acc + zero("quantity_rejected") - rec) <= dec("0.001"), [F.format_string(f"line_items[%d].{n}", "line_index") for n in ("quantity_received", "quantity_accepted", "quantity_rejected")])])


def contract_checks(headers: DataFrame) -> DataFrame:
    return _rows(headers, _contract_rules())


def _contract_rules() -> list[Column]:
    return [_check("term_dates", F.col("expiry_date") <= F.col("effective_date"), F.lit(False), ["effective_date", "expiry_date"])]


def required_check(values: DataFrame, spec: DataFrame) -> DataFrame:
    """values (doc_id, doc_type, field_name, value); spec (doc_type, name, required): documents with what they lack."""
    have = values.where("value is not null").select("doc_id", F.col("field_name").alias("name")).distinct()
    docs = values.select("doc_id", "doc_type").distinct()
    missing = docs.join(F.broadcast(spec.where("required")), "doc_type").join(have, ["doc_id", "name"], "left_anti")
    listed = missing.groupBy("doc_id").agg(F.sort_array(F.collect_set("name")).alias("missing"))
    out = docs.join(listed, "doc_id", "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
    return out.select("doc_id", F.lit("required_fields").alias("check_id"), F.when(F.size("missing") == 0, "pass").otherwise("fail").alias("status"), F.lit("warn").alias("severity"), F.col("missing").alias("field_keys"))


def format_problem(kind: Column | str, value: Column | str) -> Column:
    """Name of what is wrong with a typed value, or null."""
    kind, value = (F.col(x) if isinstance(x, str) else x for x in (kind, value))
    found = F.when(kind == "gstin", gstin_problem(value))
    for name, pattern in FORMATS.items():
        bare = F.regexp_replace(value, " ", "") if name == "eway_bill_number" else value
        found = found.when((kind == name) & ~bare.rlike(pattern), name)
    return found


def year_check(headers: DataFrame, number: str, day: str, as_of: str) -> DataFrame:
    """The financial year in a document's number against its date; where day and month swapped fit, they are proposed."""
    start_year, d = financial_year(number, as_of), F.col(day)
    start, end = F.make_date(start_year, F.lit(4), F.lit(1)), F.make_date(start_year + 1, F.lit(3), F.lit(31))
    swapped = F.to_date(F.try_to_timestamp(F.when(F.dayofmonth(d) <= 12, F.format_string("%04d-%02d-%02d", F.year(d), F.dayofmonth(d), F.month(d))), F.lit("yyyy-MM-dd")))
    inside, fits = d.between(start, end), swapped.between(start, end)
    rows = headers.where(start_year.isNotNull() & d.isNotNull())
    return rows.select(
        "doc_id",
        F.lit("fy_date").alias("check_id"),
        F.when(inside, "pass").otherwise("fail").alias("status"),
        F.when(~inside & ~F.coalesce(fits, F.lit(False)), "warn").otherwise("error").alias("severity"),
        F.when(~inside & fits, swapped).alias("suggest"),
    )
