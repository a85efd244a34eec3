"""Queries of single rules and measures that share a function with others, each with SQL written from the rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from docproof.functions import normalize as norm
from docproof.operators import checks, evidence, matching, metrics, records, repair
from docproof.plans.queries import EQ, MATCH_SQL, STATUS, TAX, Z, double, variants
from docproof.plans.registry import NOW, ORACLES, QUERIES, query
from docproof.settings import DEFAULTS

SUMS = "s as (select doc_id, count(*) as n, cast(sum(cast(taxable_value + case when item_code % 31 = 0 then 7 else 0 end as decimal(18,2))) as decimal(18,2)) as total from inv_line group by 1)"


def _off(lines):
    """Lines of which some are printed 7 higher than they add up to."""
    return lines.withColumn("taxable_value", (F.col("taxable_value") + F.when(F.col("item_code") % 31 == 0, 7).otherwise(0)).cast("decimal(18,2)"))


@query("CK8_lines_sum_subtotal", "inv_header", "inv_line", sql=f"""
    , {SUMS} select h.doc_id, 'lines_sum_subtotal' as check_id, {STATUS.format(ok=variants('s.total', 'h.subtotal'))}, 'error' as severity from inv_header h join s on s.doc_id = h.doc_id where subtotal is not null""")
def _(headers, lines):
    return checks.invoice_checks(headers, _off(lines), only=("lines_sum_subtotal",)).select("doc_id", "check_id", "status", "severity")


@query("CK18_order", "inv_header", "inv_line", sql=f"""
    , {SUMS}, l as (select *, cast(taxable_value + case when item_code % 31 = 0 then 7 else 0 end as decimal(18,2)) as t from inv_line)
    select doc_id, 'line_math:' || line_index as check_id, case when abs(quantity * rate - discount - t) <= greatest(0.51, abs(t) * 0.0005) then 'pass' else 'fail' end as status from l union all
    select h.doc_id, 'lines_sum_subtotal', case when {EQ.format(a='s.total', b='h.subtotal')} then 'pass' else 'fail' end from inv_header h join s on s.doc_id = h.doc_id where subtotal is not null union all
    select doc_id, 'grand_total', case when {EQ.format(a=f'(subtotal + {TAX} + {Z("other_charges")})', b='grand_total')} then 'pass' else 'fail' end from inv_header where subtotal is not null and grand_total is not null""")
def _(headers, lines):
    return checks.order_checks(headers, _off(lines).withColumnRenamed("taxable_value", "line_total")).select("doc_id", "check_id", "status")


def _mixed(headers, docs):
    """Headers of all types in one table: weights for receipts, dates for contracts, totals for invoices and orders."""
    kind = F.when(F.col("doc_id") % 6 == 0, "contract").otherwise(F.col("doc_type"))
    rows = headers.join(docs.select("doc_id", kind.alias("doc_type")), "doc_id")
    weight = (F.col("doc_id") % 100).cast("decimal(18,2)")
    return rows.withColumns({"effective_date": F.col("invoice_date"), "expiry_date": F.col("due_date"), "actual_weight_kg": weight, "charged_weight_kg": (weight + F.when(F.col("doc_id") % 4 == 0, -1).otherwise(1)).cast("decimal(18,2)")}).drop("due_date")


@query("CK0_dispatch", "inv_header", "inv_line", "docs", sql=f"""
    , k as (select h.*, case when h.doc_id % 6 = 0 then 'contract' else d.doc_type end as doc_type from inv_header h join docs d on d.doc_id = h.doc_id), {SUMS}
    select k.doc_id, 'grand_total' as check_id, {STATUS.format(ok=variants(f'subtotal + {TAX} + ' + Z('round_off'), 'grand_total'))} from k where doc_type = 'invoice' and grand_total is not null and subtotal is not null
    union all select k.doc_id, 'grand_total', case when {EQ.format(a=f'(subtotal + {TAX} + {Z("other_charges")})', b='grand_total')} then 'pass' else 'fail' end from k where doc_type = 'po' and grand_total is not null and subtotal is not null
    union all select k.doc_id, 'lines_sum_subtotal', {STATUS.format(ok=variants('s.total', 'k.subtotal'))} from k join s on s.doc_id = k.doc_id where doc_type = 'invoice' and subtotal is not null
    union all select k.doc_id, 'lines_sum_subtotal', case when {EQ.format(a='s.total', b='k.subtotal')} then 'pass' else 'fail' end from k join s on s.doc_id = k.doc_id where doc_type = 'po' and subtotal is not null
    union all select doc_id, 'charged_ge_actual', 'fail' from k where doc_type = 'lr' and doc_id % 4 = 0 union all select doc_id, 'term_dates', 'fail' from k where doc_type = 'contract' and due_date <= invoice_date""")
def _(headers, lines, docs):
    found = checks.document_checks(_mixed(headers, docs), _off(lines).withColumn("line_total", F.col("taxable_value") + F.when(F.col("item_code") % 31 == 0, 7).otherwise(0) * 0))
    return found.where(F.col("check_id").isin("grand_total", "lines_sum_subtotal", "charged_ge_actual", "term_dates")).select("doc_id", "check_id", "status")


@query("CK3_dates", "inv_header", sql=f"""
    , d as (select doc_id, 'invoice_date' as n, invoice_date as d from inv_header union all select doc_id, 'due_date', due_date from inv_header)
    select doc_id, 'date:' || n as check_id, case when d > date '{DEFAULTS.print_as_of}' + 1 or d < date '{DEFAULTS.print_as_of}' - 1095 then 'fail' else 'pass' end as status, case when d < date '{DEFAULTS.print_as_of}' - 1095 then 'warn' else 'error' end as severity from d where d is not null""")
def _(headers):
    rules = F.array(*[checks.date_check(n, DEFAULTS.print_as_of) for n in ("invoice_date", "due_date")])
    return headers.select("doc_id", F.inline(F.array_compact(rules))).select("doc_id", "check_id", "status", "severity")


@query("CK16_gstin_distinct", "inv_header", "inv_line", sql="select doc_id, 'gstin_distinct' as check_id, 'fail' as status, 'error' as severity from inv_header where doc_id % 10 = 3 and supplier_gstin <> ''")
def _(headers, lines):
    buyer = F.when(F.col("doc_id") % 10 == 3, F.col("supplier_gstin")).when(F.col("doc_id") % 10 == 4, "").when(F.col("doc_id") % 10 < 3, "27AAPFU0939F1ZV")
    return checks.invoice_checks(headers.withColumn("buyer_gstin", buyer), lines, only=("gstin_distinct",)).select("doc_id", "check_id", "status", "severity")


@query("CK0b_tolerance", "inv_line", sql=f"select doc_id, line_index, {EQ.format(a='taxable_value', b='(quantity * rate)')} as equal from inv_line")
def _(lines):
    return lines.select("doc_id", "line_index", checks.same(F.col("taxable_value"), F.col("quantity") * F.col("rate")).alias("equal"))


@query("CK4b_per_factor", "inv_line", sql=r"select doc_id, line_index, case when try_cast(regexp_extract(rate_per, '^\s*([0-9]+)', 1) as int) > 1 then cast(regexp_extract(rate_per, '^\s*([0-9]+)', 1) as int) else 1 end as per from inv_line")
def _(lines):
    return lines.select("doc_id", "line_index", checks.per_factor("rate_per").alias("per"))


@query("CK23_financial_year", "inv_header", sql="""select doc_id, invoice_number, case when cast(substring(invoice_number, 5, 2) as int) between 15 and 25 and (cast(substring(invoice_number, 5, 2) as int) + 1) % 100 = cast(substring(invoice_number, 8, 2) as int)
    then 2000 + cast(substring(invoice_number, 5, 2) as int) end as year from inv_header""")
def _(headers):
    return headers.select("doc_id", "invoice_number", norm.financial_year("invoice_number", DEFAULTS.print_as_of).alias("year"))


@query("SC1_fold_digits", "prints", sql="select doc_id, line_index, translate(amount || '１२', '०१२३४५६७८९１２', '012345678912') as folded from prints")
def _(prints):
    return prints.select("doc_id", "line_index", norm.fold_digits(F.concat("amount", F.lit("１２"))).alias("folded"))


@query("SC9_code_forms", "tax_ids", sql="""
    , c as (select supplier_id, upper(substring(first14, 3, 4)) || case when supplier_id % 3 = 0 then '0' else 'O' end || lpad(cast(supplier_id % 1000000 as varchar), 6, '0') as ifsc, substring(first14, 3, 10) || case when supplier_id % 4 = 0 then '1' else '' end as pan, substring('73181500', 1, cast(supplier_id % 9 as int)) as hsn from tax_ids)
    select supplier_id, supplier_id % 3 = 0 as ifsc, supplier_id % 4 <> 0 as pan, length(hsn) in (4, 6, 8) as hsn from c""")
def _(ids):
    i, head = F.col("supplier_id"), F.substring("first14", 3, 4)
    ifsc = F.concat(head, F.when(i % 3 == 0, "0").otherwise("O"), F.lpad((i % 1000000).cast("string"), 6, "0"))
    pan, hsn = F.concat(F.substring("first14", 3, 10), F.when(i % 4 == 0, "1").otherwise("")), F.substring(F.lit("73181500"), F.lit(1), (i % 9).cast("int"))
    return ids.select("supplier_id", ifsc.rlike(norm.IFSC).alias("ifsc"), pan.rlike(norm.PAN).alias("pan"), hsn.rlike(norm.HSN).alias("hsn"))


@query("SC11_comparable", "prints", sql="""select doc_id, line_index, regexp_replace(lower(date_text), '[^a-z0-9ऀ-ॿ]', '', 'g') as words, cast(round(cast(item_code as decimal(18,4)) / 8, 2) as decimal(18,2))::varchar as number, code_text as other from prints""")
def _(prints):
    return prints.select("doc_id", "line_index", norm.comparable(F.lit("text"), "date_text").alias("words"), norm.comparable(F.lit("percent"), (F.col("item_code").cast("decimal(18,4)") / 8).cast("decimal(18,4)").cast("string")).alias("number"), norm.comparable(F.lit("code"), "code_text").alias("other"))


@query("RV2_numbers_agree", "inv_line", sql="select doc_id, line_index, case when item_code % 5 = 4 then false else item_code % 5 < 2 end as agree from inv_line")
def _(lines):
    n = F.col("item_code") % 5
    other = F.when(n == 0, F.col("rate")).when(n == 1, F.col("rate").cast("decimal(18,4)") + F.lit("0.004").cast("decimal(18,4)")).when(n == 2, F.col("rate") + F.lit("0.01").cast("decimal(18,4)")).when(n == 3, -F.col("rate"))
    return lines.select("doc_id", "line_index", norm.values_agree(F.lit("number"), F.col("rate").cast("string"), other.cast("string")).alias("agree"))


@query("RV11_account", "docs", sql="select doc_id, 'AC' || (doc_id % 3) || 'X' || vendor_id as account from docs")
def _(docs):
    return docs.select("doc_id", norm.clean_code(F.concat(F.lit(" ac-"), F.col("doc_id") % 3, F.lit("/x "), F.col("vendor_id"))).alias("account"))


@query("CF1_history", "docs", "fields", sql="""
    , c as (select d.tenant_id, f.is_high_stakes, count(*) as t, count(*) filter (where f.status = 'confirmed') as c from docs d join fields f on f.doc_id = d.doc_id where f.status <> 'auto' group by all),
    p as (select *, least(greatest((c + 9.0) / (t + 10.0), 0.0001), 0.9999)::double as p from c) select tenant_id, is_high_stakes, round(ln(p / (1 - p)) - ln(0.9 / 0.1), 9) as shift from p""")
def _(docs, fields):
    rows = fields.where("status <> 'auto'").select("doc_id", "is_high_stakes", "status").join(docs.select("doc_id", "tenant_id"), "doc_id")
    counts = rows.groupBy("tenant_id", "is_high_stakes").agg(F.count("*").alias("t"), F.count_if(F.col("status") == "confirmed").alias("c"))
    return counts.select("tenant_id", "is_high_stakes", F.round(evidence.history_signal("c", "t"), 9).alias("shift"))


@query("PF15_overdue", "docs", sql=f"select doc_id, coalesce(reviewed_at is null and review_due_at < {NOW}, false) as overdue from docs")
def _(docs):
    late = F.col("reviewed_at").isNull() & (F.col("review_due_at") < F.lit(DEFAULTS.as_of).cast("timestamp_ntz"))
    return docs.select("doc_id", F.coalesce(late, F.lit(False)).alias("overdue"))


def _part_of_dashboard(name: str, *columns: str) -> None:
    """A block of the dashboard as a query of its own."""
    QUERIES[name] = lambda spark, sf_dir: QUERIES["AG1_dashboard"](spark, sf_dir).select("tenant_id", *columns)
    ORACLES[name] = f"select tenant_id, {', '.join(columns)} from ({ORACLES['AG1_dashboard']})"


_part_of_dashboard("AG2_today", "today_processed", "today_received", "today_needed_review", "today_ready")
_part_of_dashboard("AG3_queue", "queue_open", "queue_overdue", "queue_oldest_due")
_part_of_dashboard("AG4_turnaround", "turnaround_average", "turnaround_median", "on_time_pct", "reviewed")
_part_of_dashboard("AG5_accuracy", "first_pass_accuracy_pct", "straight_through_pct", "time_saved_hours")


@query("AG14_percent", "docs", sql="""select tenant_id, doc_type, cast(round(cast(cast(100 * count(*) filter (where reviewed_at is not null) as decimal(18,0)) / nullif(count(*) filter (where status = 'exported'), 0) as decimal(18,8)), 1) as double) as pct from docs group by all""")
def _(docs):
    return docs.groupBy("tenant_id", "doc_type").agg(metrics.percent(F.count("reviewed_at"), F.count_if(F.col("status") == "exported")).alias("pct"))


def _line_problem(name: str, problem: str, sql: str) -> None:
    """One kind of difference between an invoice's line and its order or receipt."""

    def run(orders, receipts, invoices):
        return matching.match_lines(orders, receipts, invoices).where(F.array_contains("problems", problem)).select("doc_id", "line_index")

    query(name, "po_line", "grn_line", "inv_line", sql=f"with {MATCH_SQL} select doc_id, line_index from m where {sql}")(run)


_line_problem("MT7_quantity_accepted", "quantity_accepted", "q_po is not null and has_receipt and quantity > coalesce(accepted, 0)")


@query("MT8_quantity_ordered", "po_line", "grn_line", "inv_line", sql=f"with {MATCH_SQL} select doc_id, line_index from m where quantity > q_po - 20")
def _(orders, receipts, invoices):
    """Against orders of 20 less than the given ones, so that some lines are above them."""
    found = matching.match_lines(orders.withColumn("quantity", (F.col("quantity") - 20).cast("decimal(18,2)")), receipts, invoices)
    return found.where(F.array_contains("problems", "quantity_ordered")).select("doc_id", "line_index")


_line_problem("MT9_tax_rate", "tax", "abs(gst_rate - g_po) > 0.001")
_line_problem("MT11_extra_line", "extra_line", "q_po is null")


@query("MT10_payable", "po_line", "grn_line", "inv_line", sql=f"with {MATCH_SQL} select doc_id, cast(sum(payable) as double) as payable from q group by 1 having sum(payable) is not null")
def _(orders, receipts, invoices):
    return matching.match_lines(orders, receipts, invoices).groupBy("doc_id").agg(F.sum("payable").alias("payable")).where("payable is not null").select("doc_id", double("payable").alias("payable"))


@query("EV2_exact", "inv_line", sql="""
    , l as (select *, quantity * rate - discount as straight, case when rate_per = '100 NOS' then 100 else 1 end as per from inv_line),
    m as (select *, case when abs(straight - taxable_value) > greatest(0.51, abs(taxable_value) * 0.0005) and per > 1 then cast(quantity * rate as decimal(18,4)) / per - discount else straight end as calc from l)
    select doc_id, 'line_math:' || line_index as check_id, abs(calc - taxable_value) <= 0.011 as exact from m""")
def _(lines):
    exact = F.abs(F.col("calc") - F.col("printed")) <= F.lit("0.011").cast("decimal(9,3)")
    return checks.line_checks(lines, ("line_math",)).select("doc_id", "check_id", exact.alias("exact"))


@query("RP1_failing", "inv_header", "inv_line", sql=f"""
    , {SUMS} select h.doc_id, 'lines_sum_subtotal' as check_id from inv_header h join s on s.doc_id = h.doc_id where subtotal is not null and not ({variants('s.total', 'h.subtotal')})
    union all select doc_id, 'grand_total' from inv_header where grand_total is not null and subtotal is not null and not ({variants(f'subtotal + {TAX} + ' + Z('round_off'), 'grand_total')})
    union all select doc_id, 'cgst_eq_sgst' from inv_header where abs(cgst_amount - sgst_amount) > 0.02""")
def _(headers, lines):
    """Of sums, totals and heads; warnings and rules that are no arithmetic do not count."""
    found = checks.invoice_checks(headers, _off(lines), only=("lines_sum_subtotal", "grand_total", "cgst_eq_sgst", "due_after_invoice", "tax_type_vs_state"))
    return repair.failing(found).select("doc_id", "check_id")


@query("SO4_latest_row", "docs", sql="select tenant_id, vendor_id, doc_id, status from (select *, row_number() over (partition by tenant_id, vendor_id order by docs.created_at desc, doc_id desc) as r from docs) where r = 1")
def _(docs):
    last = docs.groupBy("tenant_id", "vendor_id").agg(F.max_by(F.struct("doc_id", "status"), F.struct("created_at", "doc_id")).alias("last"))
    return last.select("tenant_id", "vendor_id", "last.doc_id", "last.status")


@query("SE2_sets", "docs", "runs", sql="""select 'both' as part, doc_id from (select vendor_id as doc_id from docs intersect select doc_id from runs) union all select 'documents', doc_id from (select vendor_id as doc_id from docs except select doc_id from runs)
    union all select 'any', doc_id from (select vendor_id as doc_id from docs union select doc_id from runs)""")
def _(docs, runs):
    a, b = docs.select(F.col("vendor_id").alias("doc_id")), runs.select("doc_id")
    named = lambda name, df: df.select(F.lit(name).alias("part"), "doc_id")
    return named("both", a.intersect(b)).unionByName(named("documents", a.subtract(b))).unionByName(named("any", a.union(b).distinct()))


@query("SRC5_table_scan", "docs", sql="select doc_id, status, quality_bucket from docs where tenant_id = 3 and status in ('ready', 'exported') and created_at >= timestamp '1996-01-01' and doc_type is not null")
def _(docs):
    asked = (F.col("tenant_id") == 3) & F.col("status").isin("ready", "exported") & (F.col("created_at") >= F.lit("1996-01-01").cast("timestamp_ntz")) & F.col("doc_type").isNotNull()
    return docs.where(asked).select("doc_id", "status", "quality_bucket")


@query("PF5_review_right", "docs", sql="select doc_id, case cast(doc_id % 4 as int) when 0 then true when 2 then doc_id % 3 = 0 else false end as may from docs")
def _(docs):
    """A reviewer of the same company, one of another, staff with and without the company's trust, an uploader."""
    n = F.col("doc_id") % 4
    role = F.when(n < 2, "reviewer").when(n == 2, "staff_reviewer").otherwise("uploader")
    return docs.select("doc_id", records.can_review(role, F.when(n == 1, F.col("tenant_id") + 1).otherwise(F.col("tenant_id")), F.col("tenant_id"), F.col("doc_id") % 3 == 0).alias("may"))


@query("AG29_headlines", "inv_line", "fields", sql="""
    , l as (select *, quantity * rate - discount as straight, case when rate_per = '100 NOS' then 100 else 1 end as per from inv_line),
    m as (select *, case when abs(straight - taxable_value) > greatest(0.51, abs(taxable_value) * 0.0005) and per > 1 then cast(quantity * rate as decimal(18,4)) / per - discount else straight end as calc from l),
    bad as (select distinct doc_id from m where abs(calc - taxable_value) > greatest(0.51, abs(taxable_value) * 0.0005)), slab as (select distinct doc_id from inv_line where gst_rate not in (0, 0.1, 0.25, 1, 1.5, 3, 5, 6, 7.5, 12, 18, 28, 40)),
    f as (select doc_id, 'Quantity (line ' || (line_index + 1) || ')' as label, row_number() over (partition by doc_id order by line_index) as turn, count(*) over (partition by doc_id) as n from fields where needs_review),
    n as (select doc_id, max(n) as n, max(label) filter (where turn = 1) as one, max(label) filter (where turn = 2) as two from f group by 1),
    a as (select doc_id, 'Quantity × rate doesn''t match a line amount' as p from bad union all select s.doc_id, 'An unusual GST rate' from slab s left join bad b on b.doc_id = s.doc_id where b.doc_id is null)
    select coalesce(a.doc_id, n.doc_id) as doc_id, case when p is not null then p || case when n > 1 then ' (+' || (n - 1) || ' more)' else '' end when n = 1 then 'Confirm ' || one else 'Confirm ' || one || ', ' || two || case when n > 2 then ' +' || (n - 2) else '' end end as headline
    from a full join n on n.doc_id = a.doc_id""")
def _(lines, fields):
    label = F.concat(F.lit("Quantity (line "), F.col("line_index") + 1, F.lit(")"))
    return evidence.headlines(checks.line_checks(lines), fields.where("needs_review").select("doc_id", label.alias("label"), F.col("line_index").alias("place")))


@query("AG30_cost", "runs", sql="""
    , r as (select doc_id, latency_ms % 5000 as i, latency_ms % 5000 // 4 as c, latency_ms % 700 as o, latency_ms % 3 as m from runs where error is null)
    select doc_id, case when bool_or(m = 2) then null else cast(round(cast(sum((i - c) * case m when 0 then 3 else 15 end + c * case m when 0 then 0.3 else 1.5 end + o * case m when 0 then 15 else 75 end) as decimal(28,10)) / 1000000, 4) as double) end as cost from r group by 1""")
def _(runs):
    """Tokens made of the latency; one model in three has no price."""
    ms = F.col("latency_ms")
    calls = runs.select("doc_id", "error", F.concat(F.lit("m"), ms % 3).alias("model"), (ms % 5000).alias("tokens_in"), F.floor(ms % 5000 / 4).alias("tokens_cached"), (ms % 700).alias("tokens_out"))
    prices = runs.sparkSession.createDataFrame([("m0", "3", "0.3", "15"), ("m1", "15", "1.5", "75")], "model string, a string, b string, c string").selectExpr("model", "cast(a as decimal(9,4)) price_in", "cast(b as decimal(9,4)) price_cached", "cast(c as decimal(9,4)) price_out")
    return metrics.run_costs(calls, prices)


@query("JN5_same_upload", "docs", sql="""
    , d as (select doc_id, tenant_id, docs.created_at as made_at, 'h' || (vendor_id % 40) as sha from docs), f as (select tenant_id, sha, min_by(doc_id, struct_pack(a := made_at, b := doc_id)) as first from d group by all)
    select d.doc_id, d.tenant_id, nullif(first, d.doc_id) as same_as, first <> d.doc_id as already_uploaded from d join f on f.tenant_id = d.tenant_id and f.sha = d.sha""")
def _(docs):
    rows = docs.withColumn("content_sha256", F.concat(F.lit("h"), F.col("vendor_id") % 40))
    return records.same_content(rows, rows.select("doc_id", "tenant_id", "content_sha256"))


@query("JN8_active_template", "docs", sql="""
    , k as (select *, vendor_id % 30 as vendor_key from docs), t as (select tenant_id, vendor_key, doc_type, doc_id as template_id, 'look at ' || doc_id as hints, case when doc_id % 3 = 0 then 'draft' else 'active' end as status, k.created_at as made_at from k where doc_id % 4 < 2 and doc_type is not null),
    n as (select tenant_id, vendor_key, doc_type, max_by(template_id, struct_pack(a := made_at, b := template_id)) as template_id from t where status = 'active' group by all)
    select k.doc_id, n.template_id, 'look at ' || n.template_id as hints from k left join n on n.tenant_id = k.tenant_id and n.vendor_key = k.vendor_key and n.doc_type = k.doc_type""")
def _(docs):
    rows = docs.withColumn("vendor_key", F.col("vendor_id") % 30)
    made = rows.where("doc_id % 4 < 2 and doc_type is not null").select("tenant_id", "vendor_key", "doc_type", F.col("doc_id").alias("template_id"), F.concat(F.lit("look at "), "doc_id").alias("hints"), F.when(F.col("doc_id") % 3 == 0, "draft").otherwise("active").alias("status"), "created_at")
    return records.active_template(rows, made)


KEY = "a key of the tests"


def hmac_sql(text: str, key: str = KEY) -> str:
    """HMAC-SHA256 of a text in DuckDB: two digests over the padded key."""
    raw = key.encode().ljust(64, b"\0")
    blob = lambda x: "unhex('" + bytes(b ^ x for b in raw).hex() + "')"
    return f"sha256({blob(0x5C)} || unhex(sha256({blob(0x36)} || encode({text}))))"


NUMBER = "'INV|' || supplier_gstin || '|' || regexp_replace(upper(invoice_number), '[^A-Z0-9]', '', 'g')"


@query("SC24_keyed_dedupe", "inv_header", sql=f"select doc_id, case when doc_id % 7 > 0 then substring({hmac_sql(NUMBER)}, 1, 32) end as key from inv_header")
def _(headers):
    number = F.when(F.col("doc_id") % 7 > 0, F.lower("invoice_number")).otherwise("")
    return headers.select("doc_id", records.keyed_dedupe(F.lit("inv"), F.col("supplier_gstin"), number, KEY).alias("key"))


@query("SC23_keyed_pseudonym", "supplier", sql=f"select s_suppkey as supplier_id, substring({hmac_sql('upper(trim(s_name))')}, 1, 32) as pseudonym from supplier")
def _(suppliers):
    return suppliers.select(F.col("s_suppkey").alias("supplier_id"), records.pseudonym(F.concat(F.lit(" "), F.lower("s_name")), KEY).alias("pseudonym"))


LAYOUT = [("number", "Invoice no.", "string", False, 0), ("day", "Date", "date", False, 1), ("note", "Note", "string", False, 2), ("quantity", "Quantity", "number", True, 3)]


@query("SNK1_table", "inv_header", "inv_line", "docs", sql="""
    , h as (select h.*, d.reviewed_at is not null as seen from inv_header h join docs d on d.doc_id = h.doc_id where d.doc_type = 'invoice')
    select h.doc_id as "Document ID", case when seen then 'Reviewed' else 'Auto-verified' end as "Status", invoice_number as "Voucher", strftime(invoice_date, '%d/%m/%Y') as "Date", case when h.doc_id % 2 = 0 then chr(39) || '=note' else '' end as "Note",
        coalesce(cast(line_index + 1 as varchar), '') as "Line no.", coalesce(cast(quantity as varchar), '') as "Qty" from h left join inv_line l on l.doc_id = h.doc_id""")
def _(headers, lines, docs):
    """A profile with two names of its own and its own way to write dates."""
    spec = headers.sparkSession.createDataFrame(LAYOUT, "name string, label string, kind string, is_line boolean, place int")
    own = docs.where("doc_type = 'invoice'")
    none, text = F.lit(None).cast("int"), lambda n, v: F.struct(F.lit(n).alias("field_name"), v.cast("string").alias("value"))
    head = headers.select("doc_id", none.alias("line_index"), F.inline(F.array(text("number", F.col("invoice_number")), text("day", F.col("invoice_date")), text("note", F.when(F.col("doc_id") % 2 == 0, "=note")))))
    body = lines.select("doc_id", "line_index", F.lit("quantity").alias("field_name"), F.col("quantity").cast("string").alias("value"))
    fields = head.unionByName(body).join(own.select("doc_id"), "doc_id", "left_semi")
    return records.export_table(own.join(headers.select("doc_id"), "doc_id", "left_semi"), fields, spec, {"number": "Voucher", "line.quantity": "Qty"}, "dd/MM/yyyy")


CONDITION = "s as (select 'overall' as condition, * from v union all select 'printed', * from v where not v and not has_handwriting union all select 'vernacular', * from v where v union all select 'handwritten', * from v where has_handwriting)"
PCT = "cast(round(cast(cast(100 * ({n}) as decimal(18,0)) / nullif(({d}), 0) as decimal(18,8)), 1) as double)"


@query("AG15_conditions_report", "docs", "fields", "evaluated", sql=f"""
    , c as (select doc_id, count(*) as ft, count(*) filter (where status = 'corrected') as fx, count(*) filter (where not needs_review) as fo, count(*) filter (where not needs_review and status = 'corrected') as fe from fields group by 1),
    v as (select d.*, coalesce(ft, 0) as ft, coalesce(fx, 0) as fx, coalesce(fo, 0) as fo, coalesce(fe, 0) as fe, languages in ('english,hindi', 'tamil') as v from docs d left join c on c.doc_id = d.doc_id where status in ('ready', 'exported') and processed_at is not null), {CONDITION},
    o as (select condition, count(*) as documents, {PCT.format(n='sum(ft - fx)', d='sum(ft)')} as accuracy_pct from s group by 1),
    q as (select condition, {PCT.format(n='sum(fo - fe)', d='sum(fo)')} as spot_accuracy_pct, count(*) as spot_documents, cast(sum(fo) as bigint) as spot_fields from s where is_qa_sample and reviewed_at is not null group by 1),
    t as (select condition, count(distinct strftime(processed_at, '%Y-%m-%d')) as days, min(strftime(processed_at, '%Y-%m-%d')) as first_day from s group by 1),
    b as (select 'overall' as condition, {PCT.format(n='sum(correct)', d='sum(fields)')} as benchmark_pct from evaluated where not synthetic union all select 'printed', {PCT.format(n='sum(correct)', d='sum(fields)')} from evaluated where not synthetic and bucket in ('digital', 'good_scan', 'poor_scan'))
    select o.condition, documents, accuracy_pct, spot_accuracy_pct, spot_documents, spot_fields, days, first_day, benchmark_pct from o left join q on q.condition = o.condition left join t on t.condition = o.condition left join b on b.condition = o.condition""")
def _(docs, fields, evaluated):
    found = metrics.conditions_report(metrics.with_field_counts(docs, fields), evaluated)
    return found.select("condition", "documents", "accuracy_pct", "spot_accuracy_pct", "spot_documents", "spot_fields", F.size("trend").cast("long").alias("days"), F.element_at("trend", 1)["day"].alias("first_day"), "benchmark_pct")
