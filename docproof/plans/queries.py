"""The registered queries, by the ids of the operator inventory, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docproof import streaming
from docproof.functions import gst
from docproof.functions import normalize as norm
from docproof.operators import routing, checks, codes, evidence, layout, matching, metrics, records, repair, risk
from docproof.plans.registry import NOW, ORACLES, QUERIES, query
from docproof.settings import DEFAULTS
from docproof.sources import datasets
from docproof.sources.scratch import kept, shared_folder
from docproof.sources.tables import load

double = lambda c: F.col(c).cast("double")


# --- scalars ---------------------------------------------------------------------------------------------------------

FOLDED = "translate({x}, '०१२३४५६७८९', '0123456789')"


@query("SC2_parse_amount", "prints", sql=rf"""
    with t as (select doc_id, line_index, trim({FOLDED.format(x='amount')}) as t from prints),
    b as (select *, t like '(%)' as neg0, trim(regexp_replace(case when t like '(%)' then substring(t, 2, length(t) - 2) else t end, '(₹|rs\.?|inr|rupees?|/-|\bonly\b)', '', 'gi')) as b from t),
    c as (select *, regexp_replace(b, '-$', '') as c from b),
    d as (select *, neg0 or c like '-%' as neg, replace(replace(regexp_replace(c, '^[-+]', ''), ',', ''), ' ', '') as d from c)
    select doc_id, line_index, cast(case when lower(t) in ('nil', '-') then 0 when regexp_full_match(d, '[0-9]+(\.[0-9]+)?|\.[0-9]+') then (case when neg then -1 else 1 end) * cast(d as decimal(18,4)) end as double) as amount from d""")
def _(prints):
    return prints.select("doc_id", "line_index", norm.parse_amount("amount").cast("double").alias("amount"))


@query("SC3_parse_int", "prints", sql=rf"""
    with t as (select doc_id, line_index, amount, trim({FOLDED.format(x='amount')}) as t from prints),
    b as (select *, t like '(%)' as neg0, trim(regexp_replace(case when t like '(%)' then substring(t, 2, length(t) - 2) else t end, '(₹|rs\.?|inr|rupees?|/-|\bonly\b)', '', 'gi')) as b from t),
    c as (select *, regexp_replace(b, '-$', '') as c from b),
    d as (select *, neg0 or c like '-%' as neg, replace(replace(regexp_replace(c, '^[-+]', ''), ',', ''), ' ', '') as d from c),
    e as (select *, case when lower(t) in ('nil', '-') then 0 when regexp_full_match(d, '[0-9]+(\.[0-9]+)?|\.[0-9]+') then (case when neg then -1 else 1 end) * cast(d as decimal(18,4)) end as v from d)
    select doc_id, line_index, amount, case when v = floor(v) then cast(v as bigint) end as n from e""")
def _(prints):
    return prints.select("doc_id", "line_index", "amount", norm.parse_int("amount").alias("n"))


@query("SC4_parse_percent", "prints", sql=r"""
    select doc_id, line_index, cast(case when percent_text = '9% + 9%' then 18 when percent_text = '18 %' then 18 when percent_text = '2.5+2.5' then 5
        when regexp_full_match(percent_text, '[0-9]+%') then cast(replace(percent_text, '%', '') as int) end as double) as pct from prints""")
def _(prints):
    return prints.select("doc_id", "line_index", norm.parse_percent("percent_text").cast("double").alias("pct"))


@query("SC5_parse_date", "prints", sql=rf"""
    with t as (select doc_id, line_index, {FOLDED.format(x="replace(lower(date_text), ',', ' ')")} as t from prints),
    p as (select *, case when regexp_full_match(t, '[0-9]{{4}}-[0-9]+-[0-9]+') then t
        when regexp_full_match(t, '[0-9]+/[0-9]+/[0-9]+') then split_part(t, '/', 3) || '-' || split_part(t, '/', 2) || '-' || split_part(t, '/', 1)
        when regexp_full_match(t, '[0-9]+-3-25') then '2025-03-' || split_part(t, '-', 1)
        when t like '% jun 2025' or t like '% जून 2025' then '2025-06-' || split_part(t, ' ', 1)
        when t like 'march %' then '2024-03-' || regexp_extract(t, 'march ([0-9]+)', 1) end as iso from t)
    select doc_id, line_index, strftime(try_strptime(split_part(iso, '-', 1) || '-' || lpad(split_part(iso, '-', 2), 2, '0') || '-' || lpad(split_part(iso, '-', 3), 2, '0'), '%Y-%m-%d'), '%Y-%m-%d') as day from p""")
def _(prints):
    return prints.select("doc_id", "line_index", F.date_format(norm.parse_date("date_text"), "yyyy-MM-dd").alias("day"))


@query("SC8_clean_code", "prints", sql=r"""select doc_id, line_index, regexp_replace(upper(code_text), '[^A-Z0-9]', '', 'g') as code,
    regexp_matches(regexp_replace(upper(code_text), '[^A-Z0-9]', '', 'g'), '^([A-Z]{2}[0-9]{1,2}[A-Z]{0,3}[0-9]{1,4}|[0-9]{2}BH[0-9]{4}[A-Z]{1,2})$') as vehicle from prints""")
def _(prints):
    code = norm.clean_code("code_text")
    return prints.select("doc_id", "line_index", code.alias("code"), code.rlike(norm.VEHICLE).alias("vehicle"))


@query("SC10_normalise", "prints", sql=r"""
    select doc_id, line_index, nullif(regexp_replace(upper(code_text), '[^A-Z0-9]', '', 'g'), '') as code, nullif(trim(regexp_replace(date_text, '\s+', ' ', 'g')), '') as text from prints""")
def _(prints):
    return prints.select("doc_id", "line_index", norm.normalise(F.lit("vehicle"), "code_text").alias("code"), norm.normalise(F.lit("text"), "date_text").alias("text"))


@query("SC12_values_agree", "fields", sql=r"""
    select doc_id, line_index, case when final_value is null then false else abs(cast(value as decimal(18,2)) - cast(final_value as decimal(18,2))) < 0.005 end as agree from fields""")
def _(fields):
    return fields.select("doc_id", "line_index", norm.values_agree(F.lit("number"), "value", "final_value").alias("agree"))


@query("SC13_raw_consistent", "fields", sql=r"""
    select doc_id, line_index, case when final_value is null then null else abs(cast(value as decimal(18,4)) - cast(final_value as decimal(18,4))) < 0.005 end as ok from fields""")
def _(fields):
    return fields.select("doc_id", "line_index", norm.raw_consistent(F.lit("number"), "final_value", F.concat(F.lit("Rs. "), F.col("value"))).alias("ok"))


@query("SC14_shape_mask", "inv_header", sql="select regexp_replace(regexp_replace(invoice_number, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') as mask, count(*) as n from inv_header group by 1")
def _(headers):
    return headers.groupBy(norm.shape_mask("invoice_number").alias("mask")).agg(F.count(F.lit(1)).alias("n"))


CHAR_OF = "cast(strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substring(first14, i, 1)) - 1 as int) * (2 - i % 2)"
CHECK_CHAR = f"""t as (select supplier_id, first14, last1, sum(({CHAR_OF}) // 36 + ({CHAR_OF}) % 36) as total from tax_ids, (select unnest(range(1, 15)) as i) group by all),
    g as (select supplier_id, first14, last1, substring('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast((36 - total % 36) % 36 + 1 as int), 1) as c from t)"""


@query("SC16_check_char", "tax_ids", sql=f"with {CHECK_CHAR} select supplier_id, c from g")
def _(ids):
    return ids.select("supplier_id", gst.check_char("first14").alias("c"))


@query("RV9_stated_numbers", "tax_ids", sql=f"""with {CHECK_CHAR}, u as (select distinct supplier_id % 25 as tenant_id, case when supplier_id % 3 = 0 then first14 || last1 else first14 || c end as x, c from g where supplier_id % 4 <> 1),
    b as (select tenant_id, x, not regexp_matches(x, '^[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][1-9A-Z]Z[0-9A-Z]$') or cast(substring(x, 1, 2) as int) not between 1 and 38 or substring(x, 15, 1) <> c as bad from u)
    select tenant_id, coalesce(string_agg(x, ',' order by x) filter (where not bad), '') as gstins, coalesce(string_agg(x, ',' order by x) filter (where bad), '') as rejected from b group by 1""")
def _(ids):
    """Numbers in small letters with blanks, some wrong; blank rows; every number twice."""
    right = F.concat("first14", F.when(F.col("supplier_id") % 3 == 0, F.col("last1")).otherwise(gst.check_char("first14")))
    text = F.when(F.col("supplier_id") % 4 == 1, "  ").otherwise(F.concat(F.lit(" "), F.lower(right), F.lit(" ")))
    rows = ids.select((F.col("supplier_id") % 25).alias("tenant_id"), text.alias("gstin"))
    found = records.stated_numbers(rows.unionAll(rows))
    return found.select("tenant_id", F.array_join("gstins", ",").alias("gstins"), F.array_join("rejected", ",").alias("rejected"))


@query("SC17_gstin_problem", "tax_ids", sql=f"""with {CHECK_CHAR}
    select supplier_id, kind, case when not regexp_matches(x, '^[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][1-9A-Z]Z[0-9A-Z]$') then 'format'
        when cast(substring(x, 1, 2) as int) not between 1 and 38 then 'state' when substring(x, 15, 1) <> c then 'checksum' end as problem
    from (select supplier_id, c, 'given' as kind, first14 || last1 as x from g union all select supplier_id, c, 'right', first14 || c from g) u""")
def _(ids):
    both = ids.select("supplier_id", F.explode(F.array(F.struct(F.lit("given").alias("kind"), F.concat("first14", "last1").alias("x")), F.struct(F.lit("right").alias("kind"), F.concat("first14", gst.check_char("first14")).alias("x")))).alias("v"))
    return both.select("supplier_id", "v.kind", gst.gstin_problem("v.x").alias("problem"))


@query("SC18_state_code", "inv_header", sql="select place_of_supply, substring(place_of_supply, 1, 2) as code, count(*) as n from inv_header group by all")
def _(headers):
    return headers.groupBy("place_of_supply", gst.state_code("place_of_supply").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("SC19_words_round_trip", "inv_header")
def _(headers):
    rows = headers.where("grand_total is not null").select("doc_id", double("grand_total").alias("amount"), gst.amount_to_words("grand_total").alias("words"))
    return rows.withColumn("back", gst.words_to_amount("words").cast("double"))


@query("CK0c_indian_grouping", "inv_header")
def _(headers):
    return headers.select("doc_id", norm.indian_grouping("grand_total").alias("shown"))


@query("CK26_look_alike", "tax_ids")
def _(ids):
    x = F.concat("first14", gst.check_char("first14"))
    return ids.select("supplier_id", gst.look_alike(x, F.translate(x, "0", "O")).alias("zero_as_o"), gst.look_alike(x, F.translate(x, "Z", "X")).alias("z_as_x"))


@query("CK27_repairs", "tax_ids")
def _(ids):
    return ids.select("supplier_id", gst.repairs(F.translate(F.concat("first14", gst.check_char("first14")), "1", "I")).alias("repairs"))


@query("SC23_pseudonym", "customer")
def _(customers):
    return customers.select("c_custkey", records.pseudonym("c_name", "a key").alias("pseudonym"))


@query("SC24_dedupe_key", "inv_header", sql="select doc_id, 'invoice|' || supplier_gstin || '|' || replace(replace(invoice_number, '/', ''), '-', '') as k from inv_header")
def _(headers):
    return headers.select("doc_id", records.dedupe_key(F.lit("invoice"), "supplier_gstin", "invoice_number").alias("k"))


@query("SC31_region", "prints", sql="""select doc_id, line_index, case when item_code % 100 < 33 then 'top' when item_code % 100 < 66 then 'middle' else 'bottom' end || ' ' ||
    case when item_code % 97 < 33 then 'left' when item_code % 97 < 66 then 'centre' else 'right' end as region from prints""")
def _(prints):
    return prints.select("doc_id", "line_index", records.masks_of_region((F.col("item_code") % 97).cast("decimal(9,2)") / 100, (F.col("item_code") % 100).cast("decimal(9,2)") / 100).alias("region"))


@query("SC32_classify", "documents", sql="""
    with t as (select doc_id, regexp_replace(lower('Tax ' || case when doc_id % 3 = 0 then 'Invoice' when doc_id % 3 = 1 then 'freight bilty' else 'agreement' end || '  ' || text), '\\s+', ' ', 'g') as t from documents)
    select doc_id, case when length(t) < 40 then null when doc_id % 3 = 0 then 'invoice' when doc_id % 3 = 1 then 'lr' end as kind from t""")
def _(docs):
    word = F.when(F.col("doc_id") % 3 == 0, "Invoice").when(F.col("doc_id") % 3 == 1, "freight bilty").otherwise("agreement")
    return docs.select("doc_id", records.classify(F.concat(F.lit("Tax "), word, F.lit("  "), F.col("text"))).alias("kind"))


@query("SC33_page_groups", "inv_line", sql="""
    with p as (select doc_id, line_index as page_no, case when item_code % 3 = 0 then null else item_code % 5 end as number from inv_line),
    q as (select *, last_value(number ignore nulls) over (partition by doc_id order by page_no rows between unbounded preceding and 1 preceding) as last from p)
    select doc_id, page_no, 1 + sum(case when number <> last then 1 else 0 end) over (partition by doc_id order by page_no) as grp from q""")
def _(lines):
    pages = lines.select("doc_id", F.col("line_index").alias("page_no"), F.when(F.col("item_code") % 3 != 0, F.col("item_code") % 5).alias("number"))
    return records.page_groups(pages).select("doc_id", "page_no", F.col("group").alias("grp"))


# --- predicates and projections --------------------------------------------------------------------------------------


@query("PF1_effective_value", "fields", sql="select doc_id, line_index, case when status = 'corrected' then final_value else value end as v from fields")
def _(fields):
    return fields.select("doc_id", "line_index", records.effective_value().alias("v"))


@query("PF2_visible", "docs", sql="select doc_id from docs where tenant_id = 3 and vendor_id % 4 = 1")
def _(docs):
    rows = docs.withColumns({"assigned_to": F.col("vendor_id") % 4, "uploaded_by": F.col("vendor_id") % 7})
    return records.visible(rows, "reviewer", 3, 1).select("doc_id")


@query("PF6_document_list", "docs", sql="select doc_id, status, cast(created_at as varchar) as created_at from docs where status in ('ready', 'exported') and doc_type = 'invoice' order by docs.created_at desc, doc_id limit 500")
def _(docs):
    return docs.where(F.col("status").isin("ready", "exported") & (F.col("doc_type") == "invoice")).orderBy(F.desc("created_at"), "doc_id").limit(500).select("doc_id", "status", F.col("created_at").cast("string").alias("created_at"))


@query("PF9_needed_review", "docs", "fields", sql="""select d.doc_id, review_entered_at is not null and (not is_qa_sample or coalesce(n, 0) > 0) as needed
    from docs d left join (select doc_id, count(*) as n from fields where needs_review group by 1) f on f.doc_id = d.doc_id""")
def _(docs, fields):
    return metrics.with_field_counts(docs, fields).select("doc_id", metrics.needed_review().alias("needed"))


@query("PF10_vernacular", "docs", sql="select languages, languages in ('english,hindi', 'tamil') as v, count(*) as n from docs group by all")
def _(docs):
    return docs.groupBy("languages", metrics.vernacular().alias("v")).agg(F.count(F.lit(1)).alias("n"))


@query("PF12_retention", "docs", sql=f"""select doc_id from docs where blob_purged_at is null and (coalesce(blob_expires_at <= {NOW}, false) or created_at <= {NOW} - interval '168' hour)""")
def _(docs):
    return records.retention_due(docs).select("doc_id")


@query("PF14_shortened", "docs", sql=f"select doc_id, cast(least(coalesce(blob_expires_at, {NOW}), {NOW} + interval '24' hour) as varchar) as expiry from docs")
def _(docs):
    return docs.select("doc_id", records.shortened("blob_expires_at").cast("string").alias("expiry"))


@query("PF16_thresholds", "docs", sql="""
    with c as (select doc_type, max_by(0.80 + (doc_id % 15) * 0.01, struct_pack(a := created_at, b := doc_id)) as t from docs where doc_type is not null and status <> 'ready' group by 1)
    select d.tenant_id, c.doc_type, cast(max(greatest(t, 0.70 + (tenant_id % 25) * 0.01)) as double) as threshold from docs d join c on c.doc_type = d.doc_type group by all""")
def _(docs):
    hundredth = F.lit("0.01").cast("decimal(9,2)")
    config = docs.where("doc_type is not null and status <> 'ready'").groupBy("doc_type").agg(F.max_by(F.lit("0.80").cast("decimal(9,2)") + (F.col("doc_id") % 15).cast("decimal(9,0)") * hundredth, F.struct("created_at", "doc_id")).alias("t"))
    own = F.lit("0.70").cast("decimal(9,2)") + (F.col("tenant_id") % 25).cast("decimal(9,0)") * hundredth
    return docs.select("tenant_id", "doc_type").distinct().join(config, "doc_type").select("tenant_id", "doc_type", F.greatest("t", own).cast("double").alias("threshold"))


# --- rules -----------------------------------------------------------------------------------------------------------

LINE_OK = """abs(calc - taxable_value) <= greatest(0.51, taxable_value * 0.0005)"""
LINE_SQL = f"""l as (select *, quantity * rate - discount as straight, case when rate_per = '100 NOS' then 100 else 1 end as per from inv_line),
    m as (select *, case when abs(straight - taxable_value) > greatest(0.51, abs(taxable_value) * 0.0005) and per > 1 then cast(quantity * rate as decimal(18,4)) / per - discount else straight end as calc from l)"""


@query("CK4_line_math", "inv_line", sql=f"with {LINE_SQL} select doc_id, line_index, case when abs(calc - taxable_value) <= greatest(0.51, abs(taxable_value) * 0.0005) then 'pass' else 'fail' end as status from m")
def _(lines):
    rows = checks.line_checks(lines.drop("cgst_amount"), ("line_math",)).where(F.startswith("check_id", F.lit("line_math:")))
    return rows.select("doc_id", F.split_part("check_id", F.lit(":"), F.lit(2)).cast("int").alias("line_index"), "status")


@query("CK30_recheck", "inv_line", "fields", sql="with c as (select doc_id, line_index, cast(case when status = 'corrected' then final_value else value end as decimal(18,2)) as quantity from fields), "
    + LINE_SQL.replace("from inv_line", "from (select i.* exclude (quantity), c.quantity from inv_line i join c on c.doc_id = i.doc_id and c.line_index = i.line_index)", 1)
    + " select doc_id, line_index from m where abs(calc - taxable_value) > greatest(0.51, abs(taxable_value) * 0.0005)")
def _(lines, fields):
    """Lines whose arithmetic fails once corrections hold."""
    now = layout.rebuild_lines(fields, {"quantity": "decimal(18,2)"})
    failed = checks.line_checks(lines.drop("quantity").join(now, ["doc_id", "line_index"]), ("line_math",)).where("status = 'fail' and check_id like 'line_math:%'")
    return failed.select("doc_id", F.split_part("check_id", F.lit(":"), F.lit(2)).cast("int").alias("line_index"))


@query("CK5_line_tax", "inv_line", sql="""select doc_id, line_index, case when abs(cast(taxable_value * gst_rate as decimal(18,4)) / 100 - tax_amount) <= greatest(0.51, tax_amount * 0.001) then 'pass' else 'fail' end as status from inv_line""")
def _(lines):
    rows = checks.line_checks(lines.withColumnRenamed("tax_amount", "igst_amount"), ("line_tax",)).where(F.startswith("check_id", F.lit("line_tax:")))
    return rows.select("doc_id", F.split_part("check_id", F.lit(":"), F.lit(2)).cast("int").alias("line_index"), "status")


@query("CK6_gst_slab", "inv_line", sql="select gst_rate_text, count(*) as n from (select cast(cast(gst_rate as int) as varchar) as gst_rate_text, gst_rate from inv_line) where gst_rate not in (0, 0.1, 0.25, 1, 1.5, 3, 5, 6, 7.5, 12, 18, 28, 40) group by 1")
def _(lines):
    rows = checks.line_checks(lines, ("gst_slab",)).where(F.startswith("check_id", F.lit("gst_slab:")))
    bad = rows.select("doc_id", F.split_part("check_id", F.lit(":"), F.lit(2)).cast("int").alias("line_index"))
    return lines.join(bad, ["doc_id", "line_index"]).groupBy(F.col("gst_rate").cast("int").cast("string").alias("gst_rate_text")).agg(F.count(F.lit(1)).alias("n"))


@query("CK7_line_total", "inv_line", sql="""select doc_id, line_index, case when abs(line_total - taxable_value) <= 0.51 or (tax_amount > 0 and abs(line_total - taxable_value - tax_amount) <= 0.51) or
        (tax_amount = 0 and abs(line_total - taxable_value - cast(taxable_value * gst_rate as decimal(18,4)) / 100) <= greatest(0.51, line_total * 0.0005)) then 'pass' else 'fail' end as status
    from (select *, taxable_value + case when item_code % 3 = 0 then 0 when item_code % 5 = 0 then 7 else tax_amount end as line_total from inv_line)""")
def _(lines):
    total = F.col("taxable_value") + F.when(F.col("item_code") % 3 == 0, 0).when(F.col("item_code") % 5 == 0, 7).otherwise(F.col("tax_amount"))
    rows = checks.line_checks(lines.withColumn("line_total", total.cast("decimal(18,2)")).withColumnRenamed("tax_amount", "igst_amount"), ("line_total",)).where(F.startswith("check_id", F.lit("line_total:")))
    return rows.select("doc_id", F.split_part("check_id", F.lit(":"), F.lit(2)).cast("int").alias("line_index"), "status")


EQ = "abs({a} - {b}) <= greatest(1.0, 0.00002 * greatest(abs({a}), abs({b})))"
Z = lambda c: f"coalesce({c}, 0)"
TAX = f"({Z('cgst_amount')} + {Z('sgst_amount')} + {Z('igst_amount')})"


def invoice_rule(name: str, check_id: str, sql: str) -> None:
    """Registers one invoice rule: its rows from the common plan, against SQL of its own."""

    def run(headers, lines):
        rows = checks.invoice_checks(headers, lines.withColumnRenamed("tax_amount", "line_tax"), only=(check_id.split(":")[0],)).where(F.startswith("check_id", F.lit(check_id)))
        return rows.select("doc_id", "check_id", "status", "severity")

    query(name, "inv_header", "inv_line", sql=sql)(run)


def variants(base: str, target: str) -> str:
    oc, disc = Z("other_charges"), Z("discount_total")
    return " or ".join("(" + EQ.format(a=f"({base} + {x})", b=target) + ")" for x in ("0", oc, f"-{disc}", f"{oc} - {disc}"))


STATUS = "case when {ok} then 'pass' else 'fail' end as status"
invoice_rule("CK11_cgst_eq_sgst", "cgst_eq_sgst", f"select doc_id, 'cgst_eq_sgst' as check_id, {STATUS.format(ok='abs(cgst_amount - sgst_amount) <= 0.02')}, 'error' as severity from inv_header where cgst_amount is not null and sgst_amount is not null and (cgst_amount <> 0 or sgst_amount <> 0)")
invoice_rule("CK12_tax_type_vs_state", "tax_type_vs_state", f"""select doc_id, 'tax_type_vs_state' as check_id, case when (case when substring(supplier_gstin, 1, 2) = substring(place_of_supply, 1, 2)
    then ({Z('cgst_amount')} > 0 or {Z('sgst_amount')} > 0) and not {Z('igst_amount')} > 0 else {Z('igst_amount')} > 0 and not ({Z('cgst_amount')} > 0 or {Z('sgst_amount')} > 0) end) then 'pass' else 'fail' end as status, 'error' as severity
    from inv_header where {TAX} > 0""")
invoice_rule("CK13_grand_total", "grand_total", f"select doc_id, 'grand_total' as check_id, {STATUS.format(ok=variants(f'subtotal + {TAX} + ' + Z('round_off'), 'grand_total'))}, 'error' as severity from inv_header where grand_total is not null and subtotal is not null")
invoice_rule("CK14_round_off", "round_off", f"select doc_id, 'round_off' as check_id, {STATUS.format(ok='abs(round_off) < 1')}, 'error' as severity from inv_header where round_off is not null")
invoice_rule("CK16_due_after_invoice", "due_after_invoice", "select doc_id, 'due_after_invoice' as check_id, 'fail' as status, 'warn' as severity from inv_header where due_date < invoice_date")
invoice_rule("CK3_date", "date:", f"""select doc_id, 'date:invoice_date' as check_id, case when invoice_date > date '{DEFAULTS.print_as_of}' + 1 or invoice_date < date '{DEFAULTS.print_as_of}' - 1095 then 'fail' else 'pass' end as status,
    case when invoice_date < date '{DEFAULTS.print_as_of}' - 1095 then 'warn' else 'error' end as severity from inv_header""")
invoice_rule("CK10_tax_rate_reconcile", "tax_rate_reconcile", f"""with s as (select doc_id, sum(cast(taxable_value * gst_rate as decimal(18,4)) / 100) as due from inv_line group by 1)
    select h.doc_id, 'tax_rate_reconcile' as check_id, case when abs(due - {TAX}) <= greatest(2, 0.00002 * greatest(abs(due), abs({TAX}))) then 'pass' else 'fail' end as status, 'error' as severity
    from inv_header h join s on s.doc_id = h.doc_id where subtotal > 0""")


@query("CK9_tax_sum", "inv_header", "inv_line", sql=f"""with s as (select doc_id, sum(cast(case when item_code % 31 = 0 then tax_amount + 3 else tax_amount end as decimal(18,2))) as igst from inv_line group by 1)
    select h.doc_id, 'tax_sum:igst_amount' as check_id, case when {EQ.format(a='s.igst', b='h.igst_amount')} then 'pass' else 'fail' end as status from inv_header h join s on s.doc_id = h.doc_id where igst_amount is not null""")
def _(headers, lines):
    odd = F.when(F.col("item_code") % 31 == 0, F.col("tax_amount") + 3).otherwise(F.col("tax_amount")).cast("decimal(18,2)")
    return checks.invoice_checks(headers, lines.withColumn("igst_amount", odd), only=("tax_sum",)).where(F.startswith("check_id", F.lit("tax_sum:"))).select("doc_id", "check_id", "status")


@query("CK15_amount_in_words", "inv_header", "inv_line")
def _(headers, lines):
    said = F.when(F.col("doc_id") % 11 == 0, "rupees many only").otherwise(gst.amount_to_words(F.col("grand_total") + F.when(F.col("doc_id") % 10 == 0, 5).otherwise(0)))
    return checks.invoice_checks(headers.withColumn("amount_in_words", said), lines, only=("amount_in_words",)).where("check_id = 'amount_in_words'").select("doc_id", "status", "severity")


@query("CK17_receipt", "inv_line", sql=f"""
    with r as (select doc_id * 100 + line_index as doc_id, quantity * 10 as cw, quantity * 10 + case when item_code % 9 = 0 then 1 else 0 end as aw, rate, line_index % 5 as packages,
        cast(case cast(item_code % 4 as int) when 0 then quantity * 10 * rate when 1 then quantity * rate / 10 when 2 then rate else rate + 7 end as decimal(18,2)) as fr, item_code from inv_line)
    select doc_id, 'charged_ge_actual' as check_id, 'fail' as status from r where cw < aw union all
    select doc_id, 'freight_math', case when {' or '.join('(' + EQ.format(a=f'({b})', b='fr') + ')' for b in ('cw * rate', 'cast(cw * rate as decimal(18,4)) / 100', 'cast(cw * rate as decimal(18,4)) / 1000', 'packages * rate', 'rate'))} then 'pass' else 'fail' end from r union all
    select doc_id, 'total_freight', case when item_code % 6 = 0 then 'fail' else 'pass' end from r""")
def _(lines):
    q, r, i = F.col("quantity"), F.col("rate"), F.col("item_code")
    fr = F.when(i % 4 == 0, q * 10 * r).when(i % 4 == 1, q * r / 10).when(i % 4 == 2, r).otherwise(r + 7).cast("decimal(18,2)")
    rows = lines.select((F.col("doc_id") * 100 + F.col("line_index")).alias("doc_id"), (q * 10).cast("decimal(18,2)").alias("charged_weight_kg"), (q * 10 + F.when(i % 9 == 0, 1).otherwise(0)).cast("decimal(18,2)").alias("actual_weight_kg"), r.alias("freight_rate"), (F.col("line_index") % 5).alias("packages_count"), fr.alias("freight_amount"), F.lit(3).cast("decimal(18,2)").alias("other_charges"), (fr + 3 + F.when(i % 6 == 0, 100).otherwise(0)).cast("decimal(18,2)").alias("total_freight"))
    return checks.receipt_checks(rows).select("doc_id", "check_id", "status")


@query("CK19_goods_receipt", "grn_line", sql="""select doc_id, 'accept_reject:' || line_index as check_id, case when abs(quantity_accepted + coalesce(quantity_rejected, 0) - quantity_received) <= 0.001 then 'pass' else 'fail' end as status
    from grn_line where quantity_received is not null and quantity_accepted is not null""")
def _(lines):
    return checks.goods_receipt_checks(lines).select("doc_id", "check_id", "status")


@query("CK20_contract", "inv_header", sql="select doc_id, 'term_dates' as check_id, 'fail' as status from inv_header where due_date <= invoice_date")
def _(headers):
    return checks.contract_checks(headers.select("doc_id", F.col("invoice_date").alias("effective_date"), F.col("due_date").alias("expiry_date"))).select("doc_id", "check_id", "status")


@query("CK1_required_fields", "inv_header", sql="""select doc_id, case when subtotal is null or round_off is null then 'fail' else 'pass' end as status,
    concat_ws(',', case when round_off is null then 'round_off' end, case when subtotal is null then 'subtotal' end) as missing from inv_header""")
def _(headers):
    spark = headers.sparkSession
    spec = spark.createDataFrame([("invoice", "subtotal", True), ("invoice", "round_off", True), ("invoice", "other_charges", False)], "doc_type string, name string, required boolean")
    values = headers.select("doc_id", F.lit("invoice").alias("doc_type"), F.expr("stack(3, 'subtotal', cast(subtotal as string), 'round_off', cast(round_off as string), 'other_charges', cast(other_charges as string)) as (field_name, value)"))
    return checks.required_check(values, spec).select("doc_id", "status", F.array_join("field_keys", ",").alias("missing"))


@query("CK2_formats", "prints", sql=r"""select doc_id, line_index, case when not regexp_matches(regexp_replace(upper(code_text), '[^A-Z0-9]', '', 'g'), '^([A-Z]{2}[0-9]{1,2}[A-Z]{0,3}[0-9]{1,4}|[0-9]{2}BH[0-9]{4}[A-Z]{1,2})$') then 'vehicle' end as problem from prints""")
def _(prints):
    return prints.select("doc_id", "line_index", checks.format_problem(F.lit("vehicle"), norm.clean_code("code_text")).alias("problem"))


FY_SQL = """with f as (select doc_id, day, 2000 + cast(substring(invoice_number, 5, 2) as int) as y from (select doc_id, invoice_number, case when doc_id % 4 = 0 then cast(invoice_date + interval '8' month as date) else invoice_date end as day from inv_header)),
    g as (select *, make_date(y, 4, 1) as a, make_date(y + 1, 3, 31) as b, try_strptime(printf('%04d-%02d-%02d', year(day), case when day(day) <= 12 then day(day) else 99 end, month(day)), '%Y-%m-%d') as swapped from f where y between 2015 and 2025)
    select doc_id, case when day between a and b then 'pass' else 'fail' end as status, case when day between a and b or coalesce(swapped between a and b, false) then 'error' else 'warn' end as severity,
        case when not (day between a and b) and swapped between a and b then strftime(swapped, '%Y-%m-%d') end as suggest from g"""


@query("CK24_fy_date", "inv_header", sql=FY_SQL)
def _(headers):
    day = F.when(F.col("doc_id") % 4 == 0, F.add_months("invoice_date", 8)).otherwise(F.col("invoice_date"))
    return checks.year_check(headers.withColumn("day", day), "invoice_number", "day", DEFAULTS.print_as_of).select("doc_id", "status", "severity", F.date_format("suggest", "yyyy-MM-dd").alias("suggest"))


@query("CK22_code_agrees", "fields", sql="""select doc_id, line_index, case when code is null then null when abs(cast(value as decimal(18,2)) - code) < 0.005 then 'pass' else 'fail' end as status
    from (select *, case when doc_id % 3 = 0 then cast(value as decimal(18,2)) + case when doc_id % 12 = 0 then 1 else 0 end end as code from fields)""")
def _(fields):
    """Two of three documents have no code, so their status is null."""
    code = F.when(F.col("doc_id") % 3 == 0, F.col("value").cast("decimal(18,2)") + F.when(F.col("doc_id") % 12 == 0, 1).otherwise(0))
    rows = fields.withColumn("code", code.cast("string"))
    status = F.when(norm.values_agree(F.lit("number"), "value", "code"), "pass").otherwise("fail")
    return rows.select("doc_id", "line_index", F.when(F.col("code").isNotNull(), status).alias("status"))


@query("CK25_line_count", "inv_header", "inv_line", sql="""select h.doc_id, case when h.line_count + case when h.doc_id % 16 = 0 then 1 else 0 end = coalesce(n, 0) then 'pass' else 'fail' end as status
    from inv_header h left join (select doc_id, count(*) as n from inv_line group by 1) l on l.doc_id = h.doc_id""")
def _(headers, lines):
    stated = F.col("line_count") + F.when(F.col("doc_id") % 16 == 0, 1).otherwise(0)
    rows = checks.with_line_sums(headers, lines)
    return rows.select("doc_id", F.when(stated == F.coalesce("lines_n", F.lit(0)), "pass").otherwise("fail").alias("status"))


# --- joins, duplicates, vendors --------------------------------------------------------------------------------------


@query("JN1_labelled_fields", "fields", "docs", sql="""select f.doc_id, line_index, d.doc_type, f.status from fields f join docs d on d.doc_id = f.doc_id where d.doc_type = 'invoice' and reviewed_at is not null""")
def _(fields, docs):
    return fields.join(docs.where("doc_type = 'invoice' and reviewed_at is not null"), "doc_id").select("doc_id", "line_index", "doc_type", fields["status"])


@query("JN2_pick_reviewers", "docs", sql="""
    with u as (select tenant_id, tenant_id * 10 + i as user_id, i * 7 % 5 as created_rank from (select distinct tenant_id from docs) t, (select unnest(range(0, 5)) as i) r),
    n as (select tenant_id * 10 + doc_id % 5 as user_id, count(*) as load from docs where status = 'needs_review' and reviewed_at is null and doc_id % 3 > 0 group by 1)
    select tenant_id, user_id, load from (select u.tenant_id, u.user_id, coalesce(load, 0) as load, row_number() over (partition by u.tenant_id order by coalesce(load, 0), created_rank, u.user_id) as r from u left join n on n.user_id = u.user_id) where r = 1""")
def _(docs):
    users = docs.select("tenant_id").distinct().select("tenant_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("tenant_id", (F.col("tenant_id") * 10 + F.col("i")).alias("user_id"), (F.col("i") * 7 % 5).alias("created_rank"))
    assigned = docs.where("doc_id % 3 > 0").withColumn("assigned_to", F.col("tenant_id") * 10 + F.col("doc_id") % 5)
    return records.pick_reviewers(users, assigned)


@query("JN3_fields_of", "fields", "docs", sql="select doc_id, line_index from fields where doc_id in (select doc_id from docs where is_qa_sample)")
def _(fields, docs):
    return fields.join(docs.where("is_qa_sample").select("doc_id"), "doc_id", "left_semi").select("doc_id", "line_index")


KEYED = "k as (select doc_id, tenant_id, status, created_at, 'invoice|' || vendor_id || '|' || (doc_id % 40) as dedupe_key from docs)"


@query("JN4_duplicates", "docs", sql=f"""with {KEYED}, f as (select tenant_id, dedupe_key, min(struct_pack(a := created_at, b := doc_id)) as first, count(*) as copies from k group by 1, 2 having count(*) > 1)
    select k.doc_id, f.first.b as first_doc_id, copies, k.doc_id = f.first.b as wins from k join f on f.tenant_id = k.tenant_id and f.dedupe_key = k.dedupe_key""")
def _(docs):
    return records.duplicates(docs.withColumn("dedupe_key", F.concat_ws("|", F.lit("invoice"), "vendor_id", F.col("doc_id") % 40)))


@query("JN5_same_content", "documents", sql="select doc_id, sha256(text) as h, count(*) over (partition by sha256(text)) as copies from documents qualify count(*) over (partition by sha256(text)) > 1")
def _(docs):
    h = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    again = h.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return h.join(again, "h").select("doc_id", "h", "copies")


VENDOR = "v as (select tenant_id, vendor_id, doc_id, created_at, reviewed_at, 'V' || vendor_id || case when doc_id % 6 = 0 then ' Ltd' else '' end as name, 'ac-' || (doc_id % 3) as bank, case when doc_id % 5 = 0 then 'A-' || doc_id else 'INV/' || (doc_id % 10) end as number from docs)"


@query("JN6_vendor_profiles", "docs", sql=f"""with {VENDOR}, m as (select tenant_id, vendor_id, regexp_replace(regexp_replace(number, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') as mask, count(*) as n from v group by all),
    u as (select tenant_id, vendor_id, max_by(mask, struct_pack(n := n, m := mask)) as usual_mask, sum(n) as numbers from m group by all)
    select v.tenant_id, v.vendor_id, count(*) as docs, coalesce(max_by(name, struct_pack(a := created_at, b := doc_id)) filter (where reviewed_at is not null), min_by(name, struct_pack(a := created_at, b := doc_id))) as name,
        max_by('AC' || substring(bank, 4), struct_pack(a := created_at, b := doc_id)) filter (where reviewed_at is not null) as bank_account, max(usual_mask) as usual_mask, cast(max(numbers) as bigint) as numbers
    from v join u on u.tenant_id = v.tenant_id and u.vendor_id = v.vendor_id group by 1, 2""")
def _(docs):
    rows = docs.withColumns({"name": F.concat(F.lit("V"), "vendor_id", F.when(F.col("doc_id") % 6 == 0, " Ltd").otherwise("")), "bank_account": F.concat(F.lit("ac-"), F.col("doc_id") % 3), "number": F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("A-"), "doc_id")).otherwise(F.concat(F.lit("INV/"), F.col("doc_id") % 10))})
    return records.vendor_profiles(rows)


@query("JN7_history_signal", "docs", "fields", sql="""select vendor_id, case when t > 0 then ln(p / (1 - p)) - ln(0.9 / 0.1) else 0 end as shift
    from (select vendor_id, t, least(greatest((c + 9.0) / (t + 10.0), 0.0001), 0.9999)::double as p from (select d.vendor_id, count(f.doc_id) as t, count(*) filter (where f.status = 'confirmed') as c from docs d left join (select doc_id, status from fields where status <> 'auto') f on f.doc_id = d.doc_id group by 1))""")
def _(docs, fields):
    looked = fields.where("status <> 'auto'").select("doc_id", F.col("status").alias("said"))
    sums = docs.join(looked, "doc_id", "left").groupBy("vendor_id").agg(F.count("said").alias("t"), F.count_if(F.col("said") == "confirmed").alias("c"))
    return sums.select("vendor_id", evidence.history_signal("c", "t").alias("shift"))


@query("JN8_latest_template", "docs", sql="select tenant_id, vendor_id, max_by(doc_id, struct_pack(a := created_at, b := doc_id)) as doc_id from docs where doc_type = 'invoice' and status = 'exported' group by all")
def _(docs):
    return docs.where("doc_type = 'invoice' and status = 'exported'").groupBy("tenant_id", "vendor_id").agg(F.max_by("doc_id", F.struct("created_at", "doc_id")).alias("doc_id"))


@query("JN10_truth_vs_read", "fields", "inv_line", sql="""
    select coalesce(f.doc_id, t.doc_id) as doc_id, coalesce(f.line_index, t.line_index) as line_index,
           case when f.v is null and t.q is null then 'absent' when f.v is null then 'missed' when t.q is null then 'extra' when cast(f.v as decimal(18,2)) = t.q then 'right' else 'wrong' end as outcome
    from (select doc_id, line_index, case when doc_id % 7 > 0 then value end as v from fields) f
    full join (select doc_id, line_index, case when doc_id % 11 > 0 then quantity end as q from inv_line) t on t.doc_id = f.doc_id and t.line_index = f.line_index""")
def _(fields, lines):
    """Some readings and some truths are null; every line has an outcome."""
    f = fields.select("doc_id", "line_index", F.when(F.col("doc_id") % 7 > 0, F.col("value")).alias("value"))
    t = lines.select("doc_id", "line_index", F.when(F.col("doc_id") % 11 > 0, F.col("quantity")).alias("quantity"))
    read, true = F.col("value").isNotNull(), F.col("quantity").isNotNull()
    outcome = F.when(~read & ~true, "absent").when(~read, "missed").when(~true, "extra").when(F.col("value").cast("decimal(18,2)") == F.col("quantity"), "right").otherwise("wrong")
    return f.join(t, ["doc_id", "line_index"], "full").select("doc_id", "line_index", outcome.alias("outcome"))


@query("JN15_parents", "docs", sql="select c.doc_id, p.doc_id as parent_id, p.status as parent_status from docs c join docs p on p.doc_id = c.doc_id // 8 * 8 and p.doc_id <> c.doc_id")
def _(docs):
    parents = docs.select(F.col("doc_id").alias("parent_id"), F.col("status").alias("parent_status"))
    children = docs.select("doc_id", (F.floor(F.col("doc_id") / 8) * 8).cast("bigint").alias("parent_id"))
    return children.join(parents, "parent_id").where("parent_id <> doc_id").select("doc_id", "parent_id", "parent_status")


# --- three-way match -------------------------------------------------------------------------------------------------


@query("AG20_received", "grn_line", sql="""select doc_id, item_code, cast(sum(coalesce(quantity_received, 0)) as double) as received, cast(sum(coalesce(quantity_accepted, quantity_received, 0)) as double) as accepted,
    bool_or(quantity_accepted is not null) as has_accept from grn_line group by all""")
def _(receipts):
    return matching.received(receipts).select("doc_id", "item_code", double("received").alias("received"), double("accepted").alias("accepted"), "has_accept")


MATCH_SQL = """
    g as (select doc_id, item_code, sum(coalesce(quantity_accepted, quantity_received, 0)) as accepted from grn_line group by all),
    hg as (select distinct doc_id from grn_line),
    i as (select *, row_number() over (partition by doc_id, item_code order by line_index) as turn from inv_line),
    m as (select i.doc_id, i.line_index, i.item_code, i.quantity, i.rate, i.gst_rate, i.discount, p.quantity as q_po, p.rate as r_po, p.gst_rate as g_po, case when i.turn = 1 then g.accepted end as accepted, hg.doc_id is not null as has_receipt
          from i left join po_line p on p.doc_id = i.doc_id and p.item_code = i.item_code and i.turn = 1 left join g on g.doc_id = i.doc_id and g.item_code = i.item_code and i.turn = 1 left join hg on hg.doc_id = i.doc_id),
    q as (select *, concat_ws(',', case when q_po is null then 'extra_line' end, case when q_po is not null and rate > r_po * 1.005 then 'price' end, case when q_po is not null and has_receipt and quantity > coalesce(accepted, 0) then 'quantity_accepted' end,
          case when q_po is not null and quantity > q_po then 'quantity_ordered' end, case when q_po is not null and abs(gst_rate - g_po) > 0.001 then 'tax' end) as problems,
          case when q_po is not null then case when has_receipt then least(quantity, coalesce(accepted, 0)) else quantity end * r_po - discount end as payable from m)"""


@query("MT6_line_problems", "po_line", "grn_line", "inv_line", sql=f"with {MATCH_SQL} select doc_id, line_index, problems, cast(payable as double) as payable from q")
def _(orders, receipts, invoices):
    return matching.match_lines(orders, receipts, invoices).select("doc_id", "line_index", F.array_join("problems", ",").alias("problems"), double("payable").alias("payable"))


@query("MT13_match_status", "po_line", "grn_line", "inv_line", "inv_header", sql=f"""with {MATCH_SQL},
    l as (select doc_id, count(*) as lines, sum(case when problems = '' then 0 else len(string_split(problems, ',')) end) as issues, cast(sum(payable) as decimal(18,2)) as payable, bool_and(q_po is not null) as matched from q group by 1),
    b as (select distinct doc_id, item_code from q where q_po is not null),
    u as (select g.doc_id, count(*) as n from g join (select distinct doc_id, item_code from po_line) p on p.doc_id = g.doc_id and p.item_code = g.item_code left join b on b.doc_id = g.doc_id and b.item_code = g.item_code where accepted > 0 and b.doc_id is null group by 1),
    s as (select r.doc_id, count(*) as n from grn_line r left join po_line p on p.doc_id = r.doc_id and p.item_code = r.item_code where p.doc_id is null group by 1),
    o as (select doc_id, count(*) as n from po_line group by 1),
    f as (select h.doc_id, cast(coalesce(l.issues, 0) + case when coalesce(l.matched and abs(h.subtotal - l.payable) > greatest(1, l.payable * 0.001), false) then 1 else 0 end as bigint) as blocks,
          coalesce(u.n, 0) + coalesce(s.n, 0) as notes, cast(l.payable as double) as payable, l.doc_id is null or o.doc_id is null as incomplete
          from inv_header h left join l on l.doc_id = h.doc_id left join u on u.doc_id = h.doc_id left join s on s.doc_id = h.doc_id left join o on o.doc_id = h.doc_id)
    select doc_id, blocks, notes, payable, case when incomplete then 'incomplete' when blocks > 0 then 'mismatch' else 'matched' end as status from f""")
def _(orders, receipts, invoices, headers):
    return matching.match_documents(orders, receipts, invoices, headers)


@query("MT3_same_reference", "inv_header", sql=r"""
    , r as (select doc_id, case doc_id % 8 when 0 then '00' || doc_id when 1 then 'inv-' || doc_id when 2 then doc_id::varchar when 3 then doc_id || 'x' when 4 then 'पीओ/' || doc_id when 5 then 'क-ख' when 6 then '-/-' else 'पीओ/१२' end as a,
                  case when doc_id % 8 = 4 then 'पीओ ' || doc_id when doc_id % 8 = 7 then case when doc_id % 16 = 7 then 'पीओ-१२' else 'पीओ-१३' end else doc_id::varchar end as b from inv_header),
    n as (select doc_id, ltrim(regexp_replace(upper(a), '[^\p{L}\p{N}]', '', 'g'), '0') as a, ltrim(regexp_replace(upper(b), '[^\p{L}\p{N}]', '', 'g'), '0') as b from r)
    select doc_id, a <> '' and b <> '' and (right(a, length(b)) = b or right(b, length(a)) = a) as same from n""")
def _(headers):
    """References of Latin letters, of others, and of none."""
    n, key = F.col("doc_id") % 8, F.col("doc_id").cast("string")
    a = F.when(n == 0, F.concat(F.lit("00"), key)).when(n == 1, F.concat(F.lit("inv-"), key)).when(n == 2, key).when(n == 3, F.concat(key, F.lit("x"))).when(n == 4, F.concat(F.lit("पीओ/"), key)).when(n == 5, "क-ख").when(n == 6, "-/-").otherwise("पीओ/१२")
    b = F.when(n == 4, F.concat(F.lit("पीओ "), key)).when(n == 7, F.when(F.col("doc_id") % 16 == 7, "पीओ-१२").otherwise("पीओ-१३")).otherwise(key)
    return headers.select("doc_id", matching.same_reference(a, b).alias("same"))


@query("MT5_supplier_consistent", "inv_header", "grn_line", sql="""select h.doc_id, count(distinct x) > 1 as differs from inv_header h join (select doc_id, case when line_index % 9 = 8 then 'other' else 'same' end as x from grn_line) g on g.doc_id = h.doc_id group by 1""")
def _(headers, receipts):
    x = F.when(F.col("line_index") % 9 == 8, "other").otherwise("same")
    return headers.select("doc_id").join(receipts.select("doc_id", x.alias("x")), "doc_id").groupBy("doc_id").agg((F.count_distinct("x") > 1).alias("differs"))


def _whole_match(orders, receipts, invoices, headers):
    """The tables of ``three_way``: an order and a bill for each header, and a receipt where lines were received. Headers and
    receipts are written once, since each is read several times."""
    headers = kept(headers.select("doc_id", "invoice_number", "supplier_gstin", "subtotal"), "match-headers")
    key = F.col("doc_id").cast("string")
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("item_code")) - 1
    hsn = lambda df: df.withColumn("hsn_sac", F.lit("7318"))
    order = headers.select("doc_id", F.concat(F.lit("PO-"), key).alias("po_number"), "supplier_gstin")
    said = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("00"), key)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("po "), key)).when(F.col("doc_id") % 4 == 3, F.concat(key, F.lit("x")))
    bill = F.when(F.col("doc_id") % 5 == 0, "INV/0").otherwise(F.col("invoice_number"))
    supplier = F.when(F.col("doc_id") % 9 == 0, "X").otherwise(F.col("supplier_gstin"))
    slips = receipts.select("doc_id").distinct().join(headers.hint("merge"), "doc_id").select("doc_id", F.lit("r").alias("receipt_id"), said.alias("po_reference"), bill.alias("supplier_invoice_reference"), supplier.alias("supplier_gstin"))
    slips = kept(slips, "match-receipts")
    bills = headers.select("doc_id", "invoice_number", F.when(F.col("doc_id") % 6 == 0, "PO 1").otherwise(F.concat(F.lit("po-"), key)).alias("po_reference"), "supplier_gstin", "subtotal")
    return order, hsn(orders.withColumn("line_index", turn)), slips, hsn(receipts.withColumn("receipt_id", F.lit("r"))), bills, hsn(invoices)


@query("MT4_reference_issues", "po_line", "grn_line", "inv_line", "inv_header", sql=r"""
    , o as (select doc_id, 'PO-' || doc_id as po, supplier_gstin as supplier, invoice_number as number from inv_header),
    b as (select doc_id, case when doc_id % 6 = 0 then 'PO 1' else 'po-' || doc_id end as ref from inv_header),
    g as (select distinct r.doc_id, case r.doc_id % 4 when 0 then '00' || r.doc_id when 1 then 'po ' || r.doc_id when 3 then r.doc_id || 'x' end as ref, case when r.doc_id % 5 = 0 then 'INV/0' else o.number end as bill,
                 case when r.doc_id % 9 = 0 then 'X' else o.supplier end as supplier from grn_line r join o on o.doc_id = r.doc_id),
    p as (select b.doc_id, 'block' as severity, b.ref as x, o.po as y from b join o on o.doc_id = b.doc_id union all select g.doc_id, 'block', g.ref, o.po from g join o on o.doc_id = g.doc_id
          union all select g.doc_id, 'warn', g.bill, o.number from g join o on o.doc_id = g.doc_id),
    n as (select *, ltrim(regexp_replace(upper(x), '[^\p{L}\p{N}]', '', 'g'), '0') as nx, ltrim(regexp_replace(upper(y), '[^\p{L}\p{N}]', '', 'g'), '0') as ny from p where x <> '')
    select doc_id, 'reference' as kind, severity, count(*) as n from n where nx = '' or ny = '' or not (ends_with(nx, ny) or ends_with(ny, nx)) group by all
    union all select g.doc_id, 'supplier', 'block', 1 from g join o on o.doc_id = g.doc_id where g.supplier <> o.supplier""")
def _(orders, receipts, invoices, headers):
    order, _, slips, _, bills, _ = _whole_match(orders, receipts, invoices, headers)
    return matching.reference_issues(order, slips, bills).groupBy("doc_id", "kind", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("MT14_three_way", "po_line", "grn_line", "inv_line", "inv_header")
def _(orders, receipts, invoices, headers):
    """No SQL, since lines are paired greedily by the similarity of their texts; a test holds it against a plain version."""
    tables = _whole_match(orders, receipts, invoices, headers)
    lines, issues = matching.three_way(*tables)
    return matching.match_results(tables[4], tables[1], lines, issues)


def _named(lines: DataFrame, side: str, text, code) -> DataFrame:
    return lines.select("doc_id", F.col("line_index").alias(f"{side}_index"), code.alias(f"{side}_code"), text.alias(f"{side}_text"), F.lit("7318").alias(f"{side}_hsn"))


@query("MT1_similarity", "inv_line")
def _(lines):
    return matching.similarity(_named(lines, "a", F.col("description"), F.when(F.col("item_code") % 3 == 0, F.col("item_code").cast("string"))), _named(lines, "b", F.concat(F.upper("description"), F.lit(".")), F.when(F.col("item_code") % 3 == 0, F.col("item_code").cast("string"))), 70.0)


@query("MT2_greedy_match", "inv_line")
def _(lines):
    code = F.lit(None).cast("string")
    return matching.matched_lines(_named(lines, "a", F.col("description"), code), _named(lines, "b", F.concat(F.upper("description"), F.lit(".")), code))


# --- dashboards ------------------------------------------------------------------------------------------------------

FC = """fc as (select doc_id, count(*) as fields_total, count(*) filter (where needs_review) as fields_flagged, count(*) filter (where status = 'corrected') as fields_corrected, count(*) filter (where status = 'corrected' and needs_review) as fields_caught,
        count(*) filter (where not needs_review) as fields_open, count(*) filter (where not needs_review and status = 'corrected') as fields_escaped from fields group by 1),
    d as (select docs.*, coalesce(fields_total, 0) as ft, coalesce(fields_flagged, 0) as ff, coalesce(fields_corrected, 0) as fx, coalesce(fields_caught, 0) as fk, coalesce(fields_open, 0) as fo, coalesce(fields_escaped, 0) as fe,
        review_entered_at is not null and (not is_qa_sample or coalesce(fields_flagged, 0) > 0) as needed, status in ('ready', 'exported') and processed_at is not null as done from docs left join fc on fc.doc_id = docs.doc_id)"""
PCT = "cast(round(cast(cast(100 * ({n}) as decimal(18,0)) / nullif(({d}), 0) as decimal(18,8)), 1) as double)"
RECENT = f"created_at >= {NOW} - interval '30' day"
TODAY = f"{RECENT} and created_at >= date_trunc('day', {NOW})"


@query("AG1_dashboard", "docs", "fields", sql=f"""with {FC}, r as (select *, date_diff('second', review_entered_at, reviewed_at) / 60.0 as took, {RECENT} as recent, {TODAY} as today, reviewed_at is null and status in ('needs_review', 'unreadable') as waiting, {RECENT} and reviewed_at is not null and needed as rev from d)
    select tenant_id, count(*) filter (where today and processed_at is not null) as today_processed, count(*) filter (where today) as today_received, count(*) filter (where today and needed) as today_needed_review,
        count(*) filter (where today and status in ('ready', 'exported')) as today_ready, count(*) filter (where waiting) as queue_open, count(*) filter (where waiting and review_due_at < {NOW}) as queue_overdue,
        cast(min(review_due_at) filter (where waiting) as varchar) as queue_oldest_due, round(avg(took) filter (where rev), 3) as turnaround_average, round(median(took) filter (where rev), 3) as turnaround_median,
        {PCT.format(n="count(*) filter (where rev and reviewed_at <= review_due_at)", d="count(*) filter (where rev)")} as on_time_pct, count(*) filter (where rev) as reviewed,
        {PCT.format(n="coalesce(sum(ft - fx) filter (where recent and done), 0)", d="coalesce(sum(ft) filter (where recent and done), 0)")} as first_pass_accuracy_pct,
        {PCT.format(n="count(*) filter (where recent and done and ff = 0)", d="count(*) filter (where recent and done)")} as straight_through_pct,
        cast(round(cast(coalesce(sum(ft - ff) filter (where recent and done), 0) * 8 as decimal(18,4)) / 3600, 1) as double) as time_saved_hours, count(*) filter (where recent) as documents, count(*) filter (where recent and done) as completed
    from r group by 1""")
def _(docs, fields):
    return metrics.dashboard(metrics.with_field_counts(docs, fields))


@query("AG6_daily_trend", "docs", "fields", sql=f"""with {FC} select strftime(processed_at, '%Y-%m-%d') as day, {PCT.format(n='sum(ft - fx)', d='sum(ft)')} as accuracy, {PCT.format(n='count(*) filter (where ff = 0)', d='count(*)')} as straight_through, count(*) as documents from d where done group by 1""")
def _(docs, fields):
    return metrics.daily_trend(metrics.with_field_counts(docs, fields))


@query("AG7_by_type", "docs", "fields", sql=f"with {FC} select doc_type, count(*) as documents, count(*) filter (where needed) as needed_review from d where doc_type is not null group by 1")
def _(docs, fields):
    return metrics.by_type(metrics.with_field_counts(docs, fields))


@query("AG8_spot_check", "docs", "fields", sql=f"with {FC} select {PCT.format(n='sum(fo - fe)', d='sum(fo)')} as accuracy_pct, count(*) as documents, cast(sum(fo) as bigint) as fields, cast(sum(fe) as bigint) as escapes from d where is_qa_sample and reviewed_at is not null")
def _(docs, fields):
    return metrics.spot_check(metrics.with_field_counts(docs, fields))


SLICES = "(values ('doc_type', coalesce(doc_type, 'unknown')), ('quality', coalesce(quality_bucket, 'unknown')), ('language', case when languages = 'english' then 'english_only' else 'hindi/bilingual' end), ('handwriting', case when has_handwriting then 'handwriting' else 'printed' end))"


@query("AG10_slices", "fields", "docs", sql=f"""with {FC}, s as ({' union all '.join(f"select '{k}' as dimension, {v} as slice, * from d where done and ft > 0" for k, v in (("doc_type", "coalesce(doc_type, 'unknown')"), ("quality", "coalesce(quality_bucket, 'unknown')"), ("language", "case when languages = 'english' then 'english_only' else 'hindi/bilingual' end"), ("handwriting", "case when has_handwriting then 'handwriting' else 'printed' end")))})
    select dimension, slice, count(*) as documents, cast(sum(ft) as bigint) as fields, {PCT.format(n='sum(ft - fx)', d='sum(ft)')} as first_pass_accuracy_pct, {PCT.format(n='sum(ff)', d='sum(ft)')} as field_review_rate_pct,
        cast(sum(case when is_qa_sample and reviewed_at is not null then fo else 0 end) as bigint) as spot_check_fields,
        {PCT.format(n='sum(case when is_qa_sample and reviewed_at is not null then fe else 0 end)', d='sum(case when is_qa_sample and reviewed_at is not null then fo else 0 end)')} as escape_rate_pct from s group by 1, 2""")
def _(fields, docs):
    return metrics.slices(fields, docs)


@query("AG11_calibration", "fields", sql=f"""select cast(least(9, floor(round(cast(score as decimal(9,4)) * 10, 4))) as int) as bucket, count(*) as reviewed, {PCT.format(n="count(*) filter (where status = 'corrected')", d='count(*)')} as error_rate_pct
    from fields where status in ('confirmed', 'corrected') group by 1""")
def _(fields):
    return metrics.calibration(fields)


@query("AG12_nearest_quantile", "docs", sql="""select doc_type, cast(list_sort(list(processing_ms))[cast(least(count(*) - 1, floor(0.5 * count(*))) as int) + 1] as double) as q50, cast(list_sort(list(processing_ms))[cast(least(count(*) - 1, floor(0.95 * count(*))) as int) + 1] as double) as q95
    from docs where doc_type is not null group by 1""")
def _(docs):
    return metrics.nearest_quantile(docs.where("doc_type is not null"), "doc_type", "processing_ms", 0.5, 0.95).select("doc_type", double("q50").alias("q50"), double("q95").alias("q95"))


@query("AG13_efficiency", "docs", "runs", "fields", sql=f"""with c as (select doc_id, count(*) as calls from runs where error is null group by 1), x as (select coalesce(calls, 0) as calls from docs left join c on c.doc_id = docs.doc_id),
    a as (select round(avg(calls), 4) as calls_per_doc, {PCT.format(n='count(*) filter (where calls = 1)', d='count(*)')} as one_call_pct from x),
    b as (select {PCT.format(n='count(*) filter (where proven)', d='count(*)')} as proven_pct, {PCT.format(n='count(*) filter (where agree)', d='count(*)')} as reread_pct from fields) select * from a cross join b""")
def _(docs, runs, fields):
    return metrics.efficiency(docs, runs, fields)


@query("AG15_conditions", "docs", "fields", sql=f"""with {FC}, v as (select *, languages in ('english,hindi', 'tamil') as v from d where done), s as (select 'overall' as condition, * from v union all select 'printed', * from v where not v and not has_handwriting union all select 'vernacular', * from v where v union all select 'handwritten', * from v where has_handwriting)
    select condition, count(*) as documents, cast(sum(ft) as bigint) as fields, {PCT.format(n='sum(ft - fx)', d='sum(ft)')} as accuracy_pct, sum(ft) >= 200 as measured, {PCT.format(n='sum(fk)', d='sum(fx)')} as caught_pct, {PCT.format(n='count(*) filter (where ff = 0)', d='count(*)')} as no_review_pct from s group by 1""")
def _(docs, fields):
    return metrics.conditions(metrics.with_field_counts(docs, fields))


@query("AG18_evaluation_cells", "docs", "fields", sql=f"""with {FC}, c as (select doc_type, coalesce(quality_bucket, 'unknown') as quality, count(*) as documents, cast(sum(ft) as bigint) as fields, {PCT.format(n='sum(fe)', d='sum(fo)')} as escape_rate_pct, {PCT.format(n='sum(ft - fx)', d='sum(ft)')} as accuracy_pct from d where doc_type is not null group by 1, 2),
    r as (select *, concat_ws(',', case when documents < 20 then 'documents' end, case when coalesce(escape_rate_pct > 0.5, true) then 'escapes' end, case when coalesce(accuracy_pct < 97, true) then 'accuracy' end) as reasons from c) select *, reasons = '' as passed from r""")
def _(docs, fields):
    return metrics.evaluation_cells(metrics.with_field_counts(docs, fields))


@query("SNK7_report", "docs", "fields", sql=f"""with {FC}, c as (select doc_type, coalesce(quality_bucket, 'unknown') as quality, count(*) as documents, cast(sum(ft) as bigint) as fields, {PCT.format(n='sum(fe)', d='sum(fo)')} as escape_rate_pct, {PCT.format(n='sum(ft - fx)', d='sum(ft)')} as accuracy_pct from d where doc_type is not null group by 1, 2),
    r as (select *, concat_ws(',', case when documents < 20 then 'documents' end, case when coalesce(escape_rate_pct > 0.5, true) then 'escapes' end, case when coalesce(accuracy_pct < 97, true) then 'accuracy' end) as reasons from c) select doc_type, quality, concat('| ', doc_type, ' | ', quality, ' | ', documents, ' | ', coalesce(cast(accuracy_pct as varchar), '-'), ' | ', coalesce(cast(escape_rate_pct as varchar), '-'), ' | ', case when reasons = '' then 'pass' else 'fail' end, ' |') as markdown from r""")
def _(docs, fields):
    return metrics.report(metrics.evaluation_cells(metrics.with_field_counts(docs, fields))).drop("json")


@query("AG21_document_rollup", "fields", "inv_line", sql="""select f.doc_id, count(*) as total, count(*) filter (where needs_review) as flagged, min(score) as least_score, bool_and(abs(quantity * rate - discount - taxable_value) <= greatest(0.51, abs(taxable_value) * 0.0005)) as arithmetic_ok
    from fields f join inv_line l on l.doc_id = f.doc_id and l.line_index = f.line_index group by 1""")
def _(fields, lines):
    bad = checks.line_checks(lines.drop("rate_per")).where("status = 'fail' and check_id like 'line_math:%'").select("doc_id").distinct().withColumn("bad", F.lit(True))
    counts = metrics.with_field_counts(fields.select("doc_id").distinct(), fields)
    return counts.join(bad, "doc_id", "left").select("doc_id", F.col("fields_total").alias("total"), F.col("fields_flagged").alias("flagged"), "least_score", F.col("bad").isNull().alias("arithmetic_ok"))


@query("AG22_evidence_summary", "fields", sql="select doc_id, count(*) as fields, count(*) filter (where proven) as proven, count(*) filter (where agree) as agreed, count(*) filter (where not proven and not agree) as open from fields group by 1")
def _(fields):
    return fields.groupBy("doc_id").agg(F.count(F.lit(1)).alias("fields"), F.count_if("proven").alias("proven"), F.count_if("agree").alias("agreed"), F.count_if(~F.col("proven") & ~F.col("agree")).alias("open"))


@query("AG23_vendor_stats", "docs", "fields", sql="""select tenant_id, vendor_id, field_name, count(*) as total, count(*) filter (where f.status <> 'corrected') as correct from docs d join fields f on f.doc_id = d.doc_id where f.status <> 'auto' or is_qa_sample group by all""")
def _(docs, fields):
    rows = fields.join(docs.select("doc_id", "tenant_id", "vendor_id", "is_qa_sample"), "doc_id").where("status <> 'auto' or is_qa_sample")
    return rows.groupBy("tenant_id", "vendor_id", "field_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") != "corrected").alias("correct"))


@query("AG25_own_numbers", "docs", sql="""select tenant_id, gstin from (select tenant_id, 'G' || (vendor_id % 9) as gstin, count(*) as n from docs where reviewed_at is not null group by all) where n >= 3
    union select distinct tenant_id, 'G' || tenant_id || 'X' from docs""")
def _(docs):
    seen = docs.where("reviewed_at is not null").select("tenant_id", F.concat(F.lit("G"), F.col("vendor_id") % 9).alias("gstin"))
    return records.own_numbers(seen, docs.select("tenant_id", F.concat(F.lit("g-"), "tenant_id", F.lit("x")).alias("gstin")).distinct())


@query("AG26_dominant_type", "intake", sql="""
    , r as (select tenant_id, filed_type, row_number() over (partition by tenant_id order by intake.created_at desc, doc_id desc) as r from intake where filed_type is not null),
    c as (select tenant_id, filed_type, count(*) as n, min(r) as first from r where r <= 200 group by all),
    t as (select tenant_id, max_by(filed_type, struct_pack(n := n, f := -first)) as usual_type, cast(sum(n) as bigint) as seen, max(n) as most from c group by 1)
    select * from t where seen >= 20 and most >= 0.85 * seen""")
def _(docs):
    return routing.usual_type(docs.withColumnRenamed("filed_type", "doc_type"))


@query("AG31_worst_page", "docs", sql="select tenant_id, case min(case quality_bucket when 'poor_scan' then 1 when 'good_scan' then 2 when 'digital' then 3 end) when 1 then 'poor_scan' when 2 then 'good_scan' else 'digital' end as quality from docs group by 1")
def _(docs):
    rank = F.when(F.col("quality_bucket") == "poor_scan", 1).when(F.col("quality_bucket") == "good_scan", 2).when(F.col("quality_bucket") == "digital", 3)
    return docs.groupBy("tenant_id").agg(F.coalesce(F.min_by("quality_bucket", rank), F.lit("digital")).alias("quality"))


# --- evidence, scores, repair ----------------------------------------------------------------------------------------


@query("EV1_proven", "inv_line", sql=f"""with {LINE_SQL}, g as (select *, abs(calc - taxable_value) as off, gst_rate not in (0, 0.1, 0.25, 1, 1.5, 3, 5, 6, 7.5, 12, 18, 28, 40) as odd from m)
    select doc_id, 'line_items[' || line_index || '].' || n as field_key from g, (values ('quantity'), ('rate'), ('discount'), ('taxable_value')) v(n) where off <= 0.011""")
def _(lines):
    return evidence.proven_by_arithmetic(checks.line_checks(lines))


@query("EV3_strong_text", "prints", sql="select doc_id, line_index, length(regexp_replace(amount, '[^0-9]', '', 'g')) >= 4 as strong from prints")
def _(prints):
    return prints.select("doc_id", "line_index", evidence.strong_text("amount", F.lit(True)).alias("strong"))


@query("EV5_needs_reread", "fields", sql="""with f as (select *, case status when 'auto' then 'clear' when 'confirmed' then 'partly_legible' when 'corrected' then case when is_high_stakes then 'not_present' else 'illegible' end end as legibility, case when status = 'corrected' and not agree then null else value end as v from fields)
    select doc_id, line_index, case when proven then false when v is null then legibility in ('illegible', 'partly_legible') else is_high_stakes or legibility <> 'clear' or score < 0.2 end as again from f""")
def _(fields):
    """A corrected field counts as unread where the readings differ; a low score stands for a raw text that does not fit."""
    corrected = F.col("status") == "corrected"
    legibility = F.when(corrected, F.when(F.col("is_high_stakes"), "not_present").otherwise("illegible")).when(F.col("status") == "confirmed", "partly_legible").otherwise("clear")
    value = F.when(~corrected | F.col("agree"), F.col("value"))
    again = evidence.needs_reread(value, legibility, F.col("is_high_stakes"), F.lit(None).cast("boolean"), F.col("score") >= 0.2, F.lit(False), F.col("proven"))
    return fields.select("doc_id", "line_index", again.alias("again"))


@query("EV6_reread_targets", "cells", sql="""
    , asked as (select * from cells where not (coalesce(proven, false) or coalesce(code_filled, false))
        and case when value is null then coalesce(legibility in ('illegible', 'partly_legible'), false)
            else coalesce(is_high_stakes, false) or coalesce(hard, false) or coalesce(legibility <> 'clear', false) or coalesce(not raw_consistent, false) or coalesce(unparseable, false) end)
    select doc_id, place, turn from (select doc_id, place, row_number() over (partition by doc_id order by case when is_high_stakes then 0 else 1 end, case when legibility = 'clear' then 1 else 0 end,
        case when line_index is null then 0 else 1 end, coalesce(line_index, 0), place) as turn from asked) where turn <= 40""")
def _(cells):
    return evidence.reread_targets(cells).select("doc_id", "place", "turn")


@query("EV7_reread_outcome", "fields", sql="select doc_id, line_index, case when is_high_stakes then 'illegible' when final_value is null then 'differ' when value = final_value then 'agree' else 'differ' end as outcome from fields")
def _(fields):
    return fields.select("doc_id", "line_index", evidence.reread_outcome("value", "final_value", ~F.col("is_high_stakes")).alias("outcome"))


@query("RP2_implicated", "long_line", sql=f"""with {LINE_SQL.replace('inv_line', 'long_line').replace('- discount', '- coalesce(discount, 0)')}, k as (select doc_id, line_index, n, i, 'line_items[' || line_index || '].' || n as field_key from m, (values ('quantity', 0), ('rate', 1), ('discount', 2), ('taxable_value', 3)) v(n, i)
        where abs(calc - taxable_value) > greatest(0.51, abs(taxable_value) * 0.0005) and case n when 'quantity' then quantity when 'rate' then rate when 'discount' then discount else taxable_value end is not null)
    select doc_id, field_key, turn from (select *, row_number() over (partition by doc_id order by line_index, i) as turn from k) where turn <= 14""")
def _(lines):
    """Documents of many lines, so that the limit cuts; most have no discount, which is then no field to mend."""
    names = ("quantity", "rate", "discount", "taxable_value")
    values = lines.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.format_string(f"line_items[%d].{n}", "line_index")) for n in names]))).alias("field_key"))
    return evidence.implicated(checks.line_checks(lines), values)


@query("RP3_slips", "inv_line")
def _(lines):
    """Misreads of each line's rate, every third printed with commas and decimals; a test holds the query against a plain version."""
    printed = F.when(F.col("item_code") % 3 == 0, F.concat(F.lit("₹ "), F.format_number(F.col("rate").cast("double"), 2)))
    shown = lambda found: F.array_join(F.array_sort(F.transform(found, lambda x: F.concat(x["value"].cast("string"), F.lit(" "), x["reason"]))), "; ")
    return evidence.with_slips(lines.select("doc_id", "line_index", "rate", printed.alias("printed")), "rate", "printed", shown)


@query("CF3_score", "fields", sql="select doc_id, line_index, 1 / (1 + exp(-(2.0 + case when proven then 1.5 else 0 end + case when agree then 2.5 else -3.5 * (case when needs_review then 1 else 0 end) end))) as score from fields")
def _(fields):
    yes = lambda c: c.cast("int")
    signals = {"proven": yes(F.col("proven")), "agree": yes(F.col("agree")), "disagree": yes(~F.col("agree") & F.col("needs_review"))}
    return fields.select("doc_id", "line_index", evidence.score(signals).alias("score"))


@query("CF4_route", "fields", sql="""with r as (select doc_id, line_index, score, is_high_stakes, item_code5 as failed, doc_id % 4 = 0 as doc_failed, case when is_high_stakes then 0.95 else 0.9 end as t from (select *, status = 'corrected' as item_code5 from fields)),
    s as (select *, case when doc_failed then score * 0.8::double else score end as shown, failed or score < t as review from r)
    select doc_id, line_index, round(shown, 6) as shown, review, case when shown >= t and not review then case when doc_failed then 'medium' else 'high' end when shown >= 0.6 and not failed then 'medium' else 'low' end as band from s""")
def _(fields):
    shown, review, band = evidence.route(F.col("score"), F.col("is_high_stakes"), F.col("status") == "corrected", F.col("doc_id") % 4 == 0)
    return fields.select("doc_id", "line_index", F.round(shown, 6).alias("shown"), review.alias("review"), band.alias("band"))


# --- queues, review, export ------------------------------------------------------------------------------------------

JOBS = "j as (select event_id as job_id, ts as created_at, ts + (event_id % 90) * interval '1' minute as run_after, case cast(event_id % 4 as int) when 0 then 'queued' when 1 then 'running' when 2 then 'done' else 'failed' end as status, ts as locked_at, event_id % 5 as attempts from events)"


def _jobs(events: DataFrame) -> DataFrame:
    state = F.when(F.col("event_id") % 4 == 0, "queued").when(F.col("event_id") % 4 == 1, "running").when(F.col("event_id") % 4 == 2, "done").otherwise("failed")
    return events.select(F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"), (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 90).cast("int"))).alias("run_after"), state.alias("status"), F.col("ts").alias("locked_at"), (F.col("event_id") % 5).alias("attempts"))


@query("ST2_claimable", "events", sql=f"with {JOBS} select job_id from j where status = 'queued' and run_after <= timestamp '2024-01-15 00:00:00' order by created_at, job_id limit 50")
def _(events):
    return streaming.claimable(_jobs(events), "2024-01-15 00:00:00", 50).select("job_id")


@query("ST3_retry_delay", "events", sql=f"with {JOBS} select job_id, case cast(attempts as int) when 1 then 30 when 2 then 60 when 0 then 15 end as wait from j where status = 'failed'")
def _(events):
    return _jobs(events).where("status = 'failed'").select("job_id", streaming.retry_delay("attempts").alias("wait"))


@query("ST4_stale", "events", sql=f"with {JOBS} select job_id, status = 'running' and locked_at < timestamp '2024-01-20 00:00:00' - interval '30' minute as requeued from j")
def _(events):
    return streaming.stale(_jobs(events), "2024-01-20 00:00:00").select("job_id", "requeued")


@query("ST8_one_winner", "docs", sql=f"with {KEYED}, r as (select doc_id, row_number() over (partition by tenant_id, dedupe_key order by created_at, doc_id) as r from k) select doc_id from r where r = 1")
def _(docs):
    keyed = docs.withColumn("dedupe_key", F.concat_ws("|", F.lit("invoice"), "vendor_id", F.col("doc_id") % 40))
    return keyed.groupBy("tenant_id", "dedupe_key").agg(F.min_by("doc_id", F.struct("created_at", "doc_id")).alias("doc_id")).select("doc_id")


@query("SO2_review_queue", "docs", "fields", sql=f"""with {FC} select doc_id, is_qa_sample and ff = 0 as spot_only, coalesce(review_due_at < {NOW}, false) as overdue from d where status in ('needs_review', 'unreadable') and reviewed_at is null order by 2, review_due_at nulls last, doc_id limit 300""")
def _(docs, fields):
    return records.review_queue(metrics.with_field_counts(docs, fields)).select("doc_id", "spot_only", "overdue")


@query("SO5_recent_examples", "docs", sql="""with r as (select tenant_id, vendor_id, doc_id, row_number() over (partition by tenant_id, vendor_id order by docs.reviewed_at desc, doc_id) as r from docs where reviewed_at is not null)
    select tenant_id, vendor_id, count(*) as n, min(doc_id) as least_id from r where r <= 5 group by all having count(*) >= 3""")
def _(docs):
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("tenant_id", "vendor_id").orderBy(F.desc("reviewed_at"), "doc_id"))
    recent = docs.where("reviewed_at is not null").withColumn("r", turn).where("r <= 5")
    return recent.groupBy("tenant_id", "vendor_id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least_id")).where("n >= 3")


@query("RV1_field_actions", "fields", "corrections", sql="""
    , a as (select doc_id, cast(correction_id % 4 as int) as line_index, action, created_at, correction_id, case cast(correction_id % 3 as int) when 0 then '1,2' || (correction_id % 10) || '0.50' when 1 then '' else 'abc' end as said from corrections),
    ok as (select *, case when said like '1%' then cast(replace(said, ',', '') as decimal(18,4)) end as v from a where action = 'confirm' or said <> 'abc'),
    l as (select doc_id, line_index, bool_or(action = 'correct') as ever, arg_max_null(v, case when action = 'correct' then struct_pack(a := created_at, b := correction_id) end) as v from ok group by all)
    select f.doc_id, f.line_index, case when l.doc_id is null then f.status when l.ever or f.status = 'corrected' then 'corrected' else 'confirmed' end as status,
           case when l.ever then cast(l.v as double) else cast(f.final_value as double) end as final_value
    from fields f left join l on l.doc_id = f.doc_id and l.line_index = f.line_index""")
def _(fields, corrections):
    said = F.when(F.col("correction_id") % 3 == 0, F.concat(F.lit("1,2"), F.col("correction_id") % 10, F.lit("0.50"))).when(F.col("correction_id") % 3 == 1, "").otherwise("abc")
    log = corrections.select("doc_id", (F.col("correction_id") % 4).cast("int").alias("line_index"), F.lit("quantity").alias("field_name"), "action", said.alias("value"), "created_at", "correction_id")
    done, _ = records.act_on_fields(fields.withColumn("kind", F.lit("number")), log)
    return done.select("doc_id", "line_index", "status", F.col("final_value").cast("double").alias("final_value"))


@query("PF11_pending", "fields", sql="select doc_id, count(*) filter (where needs_review and status not in ('confirmed', 'corrected')) as pending, count(*) filter (where needs_review and status not in ('confirmed', 'corrected')) = 0 as ready from fields group by 1")
def _(fields):
    return records.ready_to_complete(fields)


@query("RV1_apply_actions", "fields", "corrections", sql="""with l as (select doc_id, max_by(action, struct_pack(a := created_at, b := correction_id)) as action, bool_or(action = 'correct') as ever from corrections group by 1)
    select f.doc_id, line_index, case when l.doc_id is null then status when ever or status = 'corrected' then 'corrected' else 'confirmed' end as status from fields f left join l on l.doc_id = f.doc_id""")
def _(fields, corrections):
    return records.apply_actions(fields, corrections).select("doc_id", "line_index", "status")


@query("RV3_same_label", "fields", sql="select doc_id, line_index, coalesce(abs(cast(value as decimal(18,4)) - cast(final_value as decimal(18,4))) < 0.005, value is not distinct from final_value) as same from fields")
def _(fields):
    return fields.select("doc_id", "line_index", risk.same_label("value", "final_value").alias("same"))


@query("SNK1_export", "inv_header", "inv_line", sql="""select h.doc_id, strftime(invoice_date, '%d-%m-%Y') as invoice_date, invoice_number, coalesce(cast(grand_total as varchar), '') as grand_total, coalesce(cast(l.line_index + 1 as varchar), '') as line_no, coalesce(cast(l.quantity as varchar), '') as line_quantity
    from inv_header h left join inv_line l on l.doc_id = h.doc_id""")
def _(headers, lines):
    return records.export_rows(headers, lines, ["invoice_date", "invoice_number", "grand_total"], ["quantity"])


@query("SNK4_safe_cell", "prints", sql=r"""select doc_id, line_index, case when regexp_matches(amount, '^[=+@-]') and not regexp_full_match(amount, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)') then '''' || amount else amount end as cell from prints""")
def _(prints):
    return prints.select("doc_id", "line_index", norm.safe_cell("amount").alias("cell"))


# --- risk and audit --------------------------------------------------------------------------------------------------


@query("RC1_half", "docs", sql="select doc_id, case when substring(sha256(cast(doc_id as varchar)), 1, 1) in ('0', '1', '2', '3', '4', '5', '6', '7') then 'fit' else 'cal' end as half from docs")
def _(docs):
    return docs.select("doc_id", risk.half("doc_id").alias("half"))


LABELLED = """w as (select f.doc_id, line_index, cast(round(cast(score as decimal(9,6)), 4) as decimal(6,4)) as score, case when f.status = 'corrected' then not coalesce(abs(cast(final_value as decimal(18,4)) - cast(value as decimal(18,4))) < 0.005, false) when f.status = 'confirmed' or (is_qa_sample and f.status = 'auto') then false end as wrong
    from fields f join docs d on d.doc_id = f.doc_id where reviewed_at is not null)"""


@query("RC2_labelled", "fields", "docs", sql=f"with {LABELLED} select doc_id, line_index, wrong from w where wrong is not null")
def _(fields, docs):
    return risk.labelled(fields, docs).select("doc_id", "line_index", "wrong")


@query("RC4_design_effect", "fields", "docs", sql=f"""with {LABELLED}, g as (select doc_id, count(*)::double as m, sum(wrong::int)::double as k from w where wrong is not null group by 1), s as (select count(*) as groups, sum(m) as n, sum(k) as e, sum(m * m) as mm, sum(k * k / m) as b from g),
    a as (select *, (b - e * e / n) / (groups - 1) as msb, (e - b) / (n - groups) as msw, (n - mm / n) / (groups - 1) as m0 from s), c as (select *, greatest(0, (msb - msw) / (msb + (m0 - 1) * msw)) as icc from a)
    select cast(n as bigint) as n, groups, cast(e as bigint) as errors, round(icc, 9) as icc, round(n / groups, 9) as mean_size, round(1 + (n / groups - 1) * icc, 9) as effect from c""")
def _(fields, docs):
    return risk.design_effect(risk.labelled(fields, docs)).select("n", "groups", "errors", *[F.round(c, 9).alias(c) for c in ("icc", "mean_size", "effect")])


@query("RC8_cumulative", "fields", "docs", sql=f"with {LABELLED}, e as (select score, count(*) as f, sum(wrong::int) as x from w where wrong is not null group by 1) select cast(score as double) as score, cast(sum(f) over (order by e.score desc) as bigint) as fields, cast(sum(x) over (order by e.score desc) as bigint) as errors from e")
def _(fields, docs):
    return risk.cumulative(risk.labelled(fields, docs)).select(double("score").alias("score"), "fields", "errors")


@query("RC7_tails", "fields", "docs")
def _(fields, docs):
    return risk.with_tails(risk.cumulative(risk.labelled(fields, docs)), 0.3)


@query("RC9_certificate", "fields", "docs")
def _(fields, docs):
    """One row a stakes group; the threshold is null where nothing can be certified."""
    names = ("threshold", "accepted", "errors", "p_value", "upper")
    found = risk.certificates(risk.labelled(fields, docs))
    return fields.sparkSession.createDataFrame([(group, *(c.get(x) for x in names)) for group, c in found.items()], "stakes string, threshold double, accepted long, errors long, p_value double, upper double")


@query("RC10_backtest", "fields", "docs")
def _(fields, docs):
    """One row: what the refit and the certificates come to."""
    rows = risk.labelled(fields, docs).withColumns({"bias": F.lit(1.0), "forced": F.lit(False)})
    found = risk.backtest(rows, ["bias", "proven", "agree", "score"])
    return fields.sparkSession.createDataFrame([tuple(found[c] for c in ("labelled", "fit", "auto_accept", "high_stakes", "decision"))], "labelled long, fit long, auto_accept double, high_stakes double, decision string")


@query("RC3_refit", "fields", "docs")
def _(fields, docs):
    rows = risk.labelled(fields, docs).select(F.lit(1.0).alias("bias"), F.col("proven").cast("int").alias("proven"), F.col("agree").cast("int").alias("agree"), F.col("score").alias("history"), (~F.col("wrong")).cast("int").alias("right"))
    return fields.sparkSession.createDataFrame(list(risk.refit(rows, ["bias", "proven", "agree", "history"], "right").items()), "feature string, weight double")


@query("AU2_broken_links", "events", sql="""with b as (select event_id as seq, event_type || '|' || user_id as body, case when event_id = 0 then '' else sha256(cast(event_id - 1 as varchar)) end as prev_hash from events), h as (select seq, body, prev_hash, case when seq % 997 = 5 then 'x' else sha256(prev_hash || body) end as hash from b)
    select h.seq, h.hash = sha256(h.prev_hash || h.body) as own, h.prev_hash = coalesce(p.hash, '') as linked from h left join h p on p.seq + 1 = h.seq where not (h.hash = sha256(h.prev_hash || h.body) and h.prev_hash = coalesce(p.hash, ''))""")
def _(events):
    prev = F.when(F.col("event_id") == 0, "").otherwise(F.sha2((F.col("event_id") - 1).cast("string"), 256))
    log = events.select(F.col("event_id").alias("seq"), F.concat_ws("|", "event_type", "user_id").alias("body"), prev.alias("prev_hash"))
    log = log.withColumn("hash", F.when(F.col("seq") % 997 == 5, "x").otherwise(F.sha2(F.concat("prev_hash", "body"), 256)))
    return records.broken_links(log)


@query("RT2_qa_sample", "docs")
def _(docs):
    return docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(10_000)) < int(10_000 * DEFAULTS.qa_rate)).select("doc_id")


@query("QL2_quality_bucket", "prints", sql="""select doc_id, line_index, case when item_code % 10 = 0 then 'digital' when item_code % 200 >= 100 and item_code % 70 >= 35 and item_code % 20 >= 12 and item_code % 5 < 3 then 'good_scan' else 'poor_scan' end as bucket from prints""")
def _(prints):
    i = F.col("item_code")
    return prints.select("doc_id", "line_index", records.quality_bucket(i % 10 == 0, i % 200, (i % 70) / 100, i % 20, i % 5).alias("bucket"))


@query("flagship", "inv_header", "inv_line", sql=f"""with {LINE_SQL}, c as (
    select 'line_math' as check_id, 'error' as severity, abs(calc - taxable_value) <= greatest(0.51, abs(taxable_value) * 0.0005) as ok from m union all
    select 'gst_slab', 'error', false from inv_line where gst_rate not in (0, 0.1, 0.25, 1, 1.5, 3, 5, 6, 7.5, 12, 18, 28, 40) union all
    select 'lines_sum_subtotal', 'error', {variants('subtotal', 'subtotal')} from inv_header where line_count > 0 union all
    select 'grand_total', 'error', {variants(f'subtotal + {TAX} + ' + Z('round_off'), 'grand_total')} from inv_header where grand_total is not null and subtotal is not null)
    select check_id, severity, count(*) as n, count(*) filter (where not ok) as failed from c group by 1, 2""")
def flagship(headers, lines):
    plain = lines.drop("tax_amount")
    rows = checks.line_checks(plain, ("line_math", "gst_slab")).unionByName(checks.invoice_checks(headers, plain, only=("lines_sum_subtotal", "grand_total"))).withColumn("check_id", evidence.family())
    return rows.groupBy("check_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "fail").alias("failed"))


# --- streams ---------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of a folder as they arrive, as documents."""
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    rows = streaming.arrivals(spark, f"{sf_dir}/orders.parquet*", schema)
    return rows.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("vendor_id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderstatus") == "F").alias("corrected"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.concat_ws("|", "o_custkey", F.col("o_orderkey") % 40).alias("dedupe_key"))


def _work(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/docproof/stream-{uuid.uuid4().hex}"


def stream_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _work(spark)
    streaming.drain(streaming.first_of_each(_stream(spark, sf_dir), ["dedupe_key"]), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").groupBy("dedupe_key").agg(F.count(F.lit(1)).alias("rows"))


def stream_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _work(spark)
    streaming.learn(_stream(spark, sf_dir), ["vendor_id"], f"{folder}/out", f"{folder}/state")
    return streaming.learned(spark, ["vendor_id"], f"{folder}/out")


QUERIES |= {"ST6_stream_first": stream_first, "ST9_stream_profiles": stream_profiles}
ORACLES |= {
    "ST6_stream_first": "select distinct o_custkey || '|' || (o_orderkey % 40) as dedupe_key, cast(1 as bigint) as rows from orders",
    "ST9_stream_profiles": "select o_custkey as vendor_id, count(*) as documents, count(*) filter (where o_orderstatus = 'F') as corrected from orders group by 1",
}


# --- codes, readers, the rest ----------------------------------------------------------------------------------------


@query("SRC1_media_type", "prints", sql="select doc_id, line_index, case cast(item_code % 4 as int) when 0 then 'application/pdf' when 1 then 'image/png' when 2 then 'image/jpeg' end as kind from prints")
def _(prints):
    i = F.col("item_code") % 4
    body = F.concat(F.unhex(F.when(i == 0, "255044462D312E37").when(i == 1, "89504E470D0A1A0A00").when(i == 2, "FFD8FFE0").otherwise("6674797068656963")), F.encode("amount", "utf-8"))
    return prints.select("doc_id", "line_index", codes.media_type(body).alias("kind"))


@query("SC37_invoice_token", "inv_header", sql="select doc_id, invoice_number as doc_no, supplier_gstin as seller, cast(grand_total as double) as total, cast(line_count as int) as items from inv_header where grand_total is not null")
def _(headers):
    fields = F.struct(F.col("invoice_number").alias("DocNo"), F.col("supplier_gstin").alias("SellerGstin"), F.col("grand_total").alias("TotInvVal"), F.col("line_count").alias("ItemCnt"))
    read = codes.parse_invoice_token("token", "DocNo string, SellerGstin string, TotInvVal decimal(18,2), ItemCnt int")
    rows = headers.where("grand_total is not null").select("doc_id", codes.invoice_token(fields).alias("token")).select("doc_id", read.alias("r"))
    return rows.select("doc_id", F.col("r.DocNo").alias("doc_no"), F.col("r.SellerGstin").alias("seller"), double("r.TotInvVal").alias("total"), F.col("r.ItemCnt").alias("items"))


@query("SC38_payment", "customer", sql="select c_custkey, 'c' || c_custkey || '@bank' as payee, c_name || ' & co' as name, cast(round(cast(c_acctbal as decimal(18,2)), 2) as double) as amount from customer where c_acctbal >= 0")
def _(customers):
    uri = F.concat(F.lit("upi://pay?pa=c"), "c_custkey", F.lit("%40bank&pn="), F.url_encode(F.concat("c_name", F.lit(" & co"))), F.lit("&am="), F.col("c_acctbal").cast("decimal(18,2)"))
    payee, name, amount = codes.parse_payment("uri")
    return customers.where("c_acctbal >= 0").select("c_custkey", uri.alias("uri")).select("c_custkey", payee.alias("payee"), name.alias("name"), amount.cast("double").alias("amount"))


@query("SC39_barcode", "prints", sql=r"select doc_id, line_index, regexp_full_match(code_text, '[A-Za-z0-9/\-]{5,40}') as plain, regexp_full_match(replace(code_text, ' ', ''), '[A-Za-z0-9/\-]{5,40}') as joined from prints")
def _(prints):
    return prints.select("doc_id", "line_index", codes.is_barcode("code_text").alias("plain"), codes.is_barcode(F.replace("code_text", F.lit(" "))).alias("joined"))


@query("SC34_issuer", "inv_header", sql="select doc_id, case when supplier_gstin = '03ABCDE1234F1Z5' then '27AAPFU0939F1ZV' else supplier_gstin end as issuer from inv_header")
def _(headers):
    text = F.concat(F.lit("to 03abcde1234f1z5 from "), F.lower("supplier_gstin"), F.lit(" or 27AAPFU0939F1ZV"))
    return headers.select("doc_id", codes.issuer(text, ["03ABCDE1234F1Z5"]).alias("issuer"))


@query("SC42_parse_reading", "fields", sql="select doc_id, line_index, field_name, case when needs_review then null else value end as value, value as raw_text from fields")
def _(fields):
    cell = F.struct(F.col("value"), F.col("value").alias("raw_text"), F.when(F.col("needs_review"), "not_present").otherwise("clear").alias("legibility"))
    lines = fields.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_index", cell.alias("c"), "field_name")), lambda a, b: a["line_index"] - b["line_index"]).alias("l"))
    reading = F.to_json(F.struct(F.transform("l", lambda x: F.struct(F.create_map(x["field_name"], x["c"]).alias("cells"))).alias("line_items")))
    return codes.parse_reading(lines.select("doc_id", reading.alias("reading"))).select("doc_id", "line_index", "field_name", "value", "raw_text")


@query("EV4_apply_codes", "inv_header", sql="""select doc_id, case when doc_id % 6 = 0 then case when doc_id % 4 = 0 then 'Q' else 'U' end when true then invoice_number end as value, case when doc_id % 4 = 0 then 'einvoice_qr' when doc_id % 3 = 0 then 'upi_qr' end as code_source,
    doc_id % 6 = 0 as code_filled, case when doc_id % 6 <> 0 and (doc_id % 4 = 0 or doc_id % 3 = 0) then false end as code_agrees from inv_header""")
def _(headers):
    fields = headers.select("doc_id", F.lit("invoice_number").alias("field_name"), F.lit("string").alias("kind"), F.when(F.col("doc_id") % 6 != 0, F.col("invoice_number")).alias("value"))
    name = F.lit("invoice_number").alias("field_name")
    said = headers.where("doc_id % 3 = 0").select("doc_id", name, F.lit("upi_qr").alias("source"), F.lit("U").alias("code_value")).unionByName(headers.where("doc_id % 4 = 0").select("doc_id", name, F.lit("einvoice_qr").alias("source"), F.lit("Q").alias("code_value")))
    return codes.apply_codes(fields, said).select("doc_id", "value", "code_source", "code_filled", "code_agrees")


@query("JN13_billed_to", "inv_header", sql="""select doc_id, case cast(doc_id % 3 as int) when 0 then 'own' when 1 then 'misread' else 'other' end as billed_to, case when doc_id % 3 = 1 then supplier_gstin end as suggest from inv_header""")
def _(headers):
    read = F.when(F.col("doc_id") % 3 == 0, F.col("supplier_gstin")).when(F.col("doc_id") % 3 == 1, F.concat(F.substring("supplier_gstin", 1, 14), F.lit("S"))).otherwise("27AAPFU0939F1ZV")
    own = headers.select("tenant_id", F.col("supplier_gstin").alias("gstin")).distinct()
    return codes.billed_to(headers.select("doc_id", "tenant_id", read.alias("gstin")), own)


@query("JN14_nearest_word", "fields", sql="""with w as (select doc_id, value as text, line_index as wx, line_index * 2 as wy from fields), p as (select f.doc_id, f.line_index, w.text, w.wx, w.wy, row_number() over (partition by f.doc_id, f.line_index order by (w.wx - f.line_index - 1) ** 2 + (w.wy - f.line_index * 2) ** 2, w.wx, w.wy, w.text) as r
    from fields f join w on w.doc_id = f.doc_id and w.text = f.value) select doc_id, line_index, text, wx, wy from p where r = 1""")
def _(fields):
    words = fields.select("doc_id", F.lit(1).alias("page"), F.col("value").alias("text"), F.col("line_index").alias("wx"), (F.col("line_index") * 2).alias("wy"), F.col("value").alias("whole"))
    asked = fields.select("doc_id", F.lit(1).alias("page"), F.col("line_index").cast("string").alias("field_name"), "value", (F.col("line_index") + 1).alias("x"), (F.col("line_index") * 2).alias("y"))
    exact = codes.nearest_words(asked.withColumn("value", F.concat(F.lit("v"), F.col("value"), F.lit("e"))), words.withColumn("text", F.concat(F.lit("v"), F.col("text"), F.lit("e"))))
    return exact.select("doc_id", F.col("field_name").cast("int").alias("line_index"), F.regexp_replace("text", "[ve]", "").alias("text"), "wx", "wy")


@query("SRC12_misread", "fields", sql="select doc_id, line_index, case when (doc_id + line_index) % 10 = 0 then null when (doc_id + line_index) % 10 = 1 then translate(value, '38', '83') else value end as value from fields")
def _(fields):
    return fields.select("doc_id", "line_index", codes.misread(F.col("value"), F.col("doc_id") + F.col("line_index")).alias("value"))


@query("AU1_append_chain", "events")
def _(events):
    return records.append_chain(events.select(F.col("user_id").alias("tenant_id"), F.col("event_id").alias("seq"), "event_type").withColumnRenamed("event_type", "body"))


@query("PF18_safe_meta", "prints", sql=r"select doc_id, line_index, regexp_full_match(amount, '[A-Za-z0-9_.:\-/]{0,80}') as safe from prints")
def _(prints):
    return prints.select("doc_id", "line_index", records.safe_meta("amount").alias("safe"))


@query("PF19_blank_fields", "docs", sql="select doc_id, name as field_name, 'pending' as status from docs join (values ('invoice', 'number'), ('invoice', 'total'), ('lr', 'number')) s(doc_type, name) on s.doc_type = docs.doc_type where docs.status = 'needs_review'")
def _(docs):
    spec = docs.sparkSession.createDataFrame([("invoice", "number"), ("invoice", "total"), ("lr", "number")], "doc_type string, name string")
    return records.blank_fields(docs.where("status = 'needs_review'"), spec)


@query("QL3_unreadable", "prints", sql="select doc_id, line_index, case when item_code % 50 = 0 then 'blank' when item_code % 20 = 1 then 'faded' when item_code % 9 < 5 then 'small' when item_code % 6 = 0 then 'blurry' end as reason from prints")
def _(prints):
    i = F.col("item_code")
    return prints.select("doc_id", "line_index", records.unreadable_reason((i % 50) / 100, (i % 20 - 1) / 10 + F.when(i % 20 == 0, 1).otherwise(0), i % 9, i % 6).alias("reason"))


@query("RV4_can_review", "docs", sql="select doc_id, case when vendor_id % 5 = 0 then tenant_id % 2 = 0 else vendor_id % 5 in (1, 2, 3) and tenant_id = doc_id % 25 end as may from docs")
def _(docs):
    role = F.get(F.array(*[F.lit(x) for x in ("staff_reviewer", "admin", "manager", "reviewer", "uploader")]), (F.col("vendor_id") % 5).cast("int"))
    return docs.select("doc_id", records.can_review(role, F.col("doc_id") % 25, F.col("tenant_id"), F.col("tenant_id") % 2 == 0).alias("may"))


@query("RV6_document_detail", "fields", sql="select doc_id, string_agg(line_index || '=' || value, ';' order by line_index) as detail from fields group by 1")
def _(fields):
    rows = F.array_sort(F.collect_list(F.struct("line_index", "value")))
    return fields.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: F.concat_ws("=", r["line_index"], r["value"])), ";").alias("detail"))


@query("SO1_latest", "docs", sql="select doc_id from docs order by docs.created_at desc, doc_id limit 100")
def _(docs):
    return docs.orderBy(F.desc("created_at"), "doc_id").limit(100).select("doc_id")


@query("SE1_languages", "docs", sql="select tenant_id, string_agg(l, ',' order by l) as languages from (select distinct tenant_id, unnest(string_split(languages, ',')) as l from docs) where l <> 'other' group by 1")
def _(docs):
    spoken = docs.select("tenant_id", F.explode(F.split("languages", ",")).alias("l")).where("l <> 'other'")
    return spoken.groupBy("tenant_id").agg(F.array_join(F.array_sort(F.collect_set("l")), ",").alias("languages"))


@query("JN11_code_values", "docs", sql="""with s as (select doc_id, doc_type, case when doc_id % 2 = 0 then 'einvoice_qr' else 'upi_qr' end as source from docs where doc_type is not null),
    v as (select doc_id, doc_type, source, 'number' as field_name, 'N' || doc_id as code_value from s union all select doc_id, doc_type, source, 'total', case when doc_id % 3 = 0 then null else cast(doc_id as varchar) end from s union all select doc_id, doc_type, source, 'other', 'x' from s)
    select doc_id, field_name, source, code_value from v where code_value is not null and (field_name = 'number' and doc_type in ('invoice', 'lr') or field_name = 'total' and doc_type = 'invoice')""")
def _(docs):
    spec = docs.sparkSession.createDataFrame([("invoice", "number"), ("invoice", "total"), ("lr", "number")], "doc_type string, name string")
    values = F.create_map(F.lit("number"), F.concat(F.lit("N"), "doc_id"), F.lit("total"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("string")), F.lit("other"), F.lit("x"))
    read = docs.where("doc_type is not null").select("doc_id", "doc_type", F.when(F.col("doc_id") % 2 == 0, "einvoice_qr").otherwise("upi_qr").alias("source"), values.alias("values"))
    return codes.code_values(read, spec)


@query("JN12_barcode_fields", "prints", sql="""with c as (select doc_id, line_index, item_code, code_text, upper(regexp_replace(code_text, '[^A-Za-z0-9]', '', 'g')) as code from prints)
    select doc_id, cast(line_index as varchar) as field_name, code_text as value from c where item_code % 4 <> 0 and code in (select code from c d where d.doc_id = c.doc_id and d.line_index % 2 = 0)""")
def _(prints):
    kind = F.when(F.col("item_code") % 4 == 0, "number").when(F.col("item_code") % 4 == 1, "vehicle").otherwise("string")
    fields = prints.select("doc_id", F.col("line_index").cast("string").alias("field_name"), kind.alias("kind"), F.col("code_text").alias("value"))
    return codes.barcode_fields(fields, prints.where("line_index % 2 = 0").select("doc_id", F.upper(F.replace("code_text", F.lit(" "))).alias("code")))


@query("SC36_grounded", "inv_line", sql="""with p as (select doc_id, line_index, 'Line ' || line_index || ':  ' || description || ' qty ' || quantity as text, description, quantity from inv_line),
    w as (select doc_id, lower(string_agg(regexp_replace(text, '\\s+', ' ', 'g'), ' ' order by line_index)) as plain, list(cast(line_index as decimal(18,2))) || list(quantity) as numbers from p group by 1)
    select p.doc_id, p.line_index, n as field_name, case n when 'quantity' then list_contains(w.numbers, cast(p.quantity + p.line_index % 2 as decimal(18,2)))
        when 'description' then contains(w.plain, lower(case when p.line_index % 2 = 0 then p.description else p.description || ' x' end)) end as in_text_layer
    from p join w on w.doc_id = p.doc_id, (values ('quantity'), ('description'), ('address')) v(n)""")
def _(lines):
    page = F.format_string("Line %d:  %s qty %s", "line_index", "description", F.col("quantity").cast("string"))
    layers = codes.text_layers(lines.select("doc_id", F.col("line_index").alias("page"), page.alias("text")))
    odd = F.col("line_index") % 2
    asked = F.array(
        F.struct(F.lit("quantity").alias("field_name"), F.lit("number").alias("kind"), (F.col("quantity") + odd).cast("decimal(18,2)").cast("string").alias("value")),
        F.struct(F.lit("description").alias("field_name"), F.lit("string").alias("kind"), F.when(odd == 0, F.upper("description")).otherwise(F.concat("description", F.lit(" x"))).alias("value")),
        F.struct(F.lit("address").alias("field_name"), F.lit("text").alias("kind"), F.col("description").alias("value")),
    )
    return codes.grounded(lines.select("doc_id", "line_index", F.explode(asked).alias("a")).select("doc_id", "line_index", "a.*"), layers).select("doc_id", "line_index", "field_name", "in_text_layer")


@query("AG16_benchmark", "docs", "fields", sql=f"""with {FC}, b as (select *, case when has_handwriting then 'handwritten' when languages = 'tamil' then 'vernacular' else quality_bucket end as bucket from d where not is_qa_sample),
    s as (select 'overall' as condition, * from b union all select 'printed', * from b where bucket in ('digital', 'good_scan', 'poor_scan') union all select bucket, * from b where bucket in ('handwritten', 'vernacular'))
    select condition, count(*) as documents, cast(sum(ft) as bigint) as fields, {PCT.format(n='sum(ft - fx)', d='sum(ft)')} as field_accuracy_pct, {PCT.format(n='sum(fe)', d='sum(fo)')} as escape_rate_pct from s group by 1 having sum(ft) > 0""")
def _(docs, fields):
    bucket = F.when(F.col("has_handwriting"), "handwritten").when(F.col("languages") == "tamil", "vernacular").otherwise(F.col("quality_bucket"))
    rows = metrics.with_field_counts(docs, fields)
    return metrics.benchmark(rows.select(bucket.alias("bucket"), F.col("is_qa_sample").alias("synthetic"), F.col("fields_total").alias("fields"), F.col("fields_open").alias("auto"), (F.col("fields_total") - F.col("fields_corrected")).alias("correct"), F.col("fields_escaped").alias("auto_wrong")))


@query("AG17_readiness", "docs", "fields", sql=f"""with {FC}, c as (select doc_type, coalesce(quality_bucket, 'unknown') as quality, count(*) as n, {PCT.format(n='sum(fe)', d='sum(fo)')} as escapes, {PCT.format(n='sum(ft - fx)', d='sum(ft)')} as right_pct from d where doc_type is not null group by 1, 2)
    select case when count(*) > 0 then 'ok' else 'no_eval_run' end as status, count(*) as cells, coalesce(string_agg(doc_type || '/' || quality, ',' order by doc_type || '/' || quality) filter (where n >= 20 and escapes <= 20 and right_pct >= 80), '') as ready from c""")
def _(docs, fields):
    cells = metrics.evaluation_cells(metrics.with_field_counts(docs, fields))
    passed = (F.col("documents") >= 20) & (F.col("escape_rate_pct") <= 20) & (F.col("accuracy_pct") >= 80)
    return metrics.readiness(cells.select("doc_type", "quality", passed.alias("passed"))).select("status", "cells", F.array_join("ready", ",").alias("ready"))


@query("AG28_offline_summary", "docs", sql="""with r as (select coalesce(doc_type, 'none') as bucket, quality_bucket, case when doc_id % 11 = 0 then 'blank' end as reason, doc_id % 3 = 0 as fixed, doc_id % 4 = 0 as coded, cast(doc_id % 5 as bigint) as compared, cast(doc_id % 2 as bigint) as disagree, doc_id % 9 as run, cast(doc_id % 2 as bigint) as failed, doc_id % 800 as ms from docs),
    k as (select bucket, string_agg(quality_bucket || '=' || n, ',' order by quality_bucket) as kinds from (select bucket, quality_bucket, count(*) as n from r where quality_bucket is not null group by 1, 2) group by 1)
    select r.bucket, count(*) as docs, any_value(kinds) as quality_buckets, count(reason) as refused_unreadable, count(*) filter (where fixed) as auto_corrected, count(*) filter (where coded) as docs_with_codes, cast(sum(compared) as bigint) as code_fields_compared, cast(sum(disagree) as bigint) as code_fields_disagree,
        cast(sum(run) as bigint) as checks_run, cast(sum(failed) as bigint) as checks_failed_on_truth, cast(round(sum(ms) / count(*)) as bigint) as mean_ms from r left join k on k.bucket = r.bucket group by 1""")
def _(docs):
    i = F.col("doc_id")
    some = lambda n: F.when(i % n == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.coalesce("doc_type", F.lit("none")).alias("bucket"), "quality_bucket", F.when(i % 11 == 0, "blank").alias("unreadable_reason"), some(3).alias("corrections"), some(4).alias("codes"), (i % 5).alias("compared"), (i % 2).alias("disagree"), (i % 9).alias("checks_run"), (i % 2).alias("checks_failed"), (i % 800).alias("ms"))
    found = metrics.offline_summary(rows)
    kinds = F.array_join(F.transform(F.map_entries("quality_buckets"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return found.withColumn("quality_buckets", F.nullif(kinds, F.lit("")))


@query("CK28_vendor_checks", "docs", sql="""with v as (select *, 'Vendor' || vendor_id as name, 'ac-' || vendor_id || case when doc_id % 32 in (0, 1) then 'x' else '' end as account, case when doc_id % 5 = 0 then 'AA/9' when doc_id % 5 = 1 then 'A-99' else 'AAA99' end as mask from docs),
    h as (select * from v where doc_id % 2 = 0), p as (select tenant_id, vendor_id, upper(replace(last(account order by created_at, doc_id) filter (where reviewed_at is not null), '-', '')) as account, count(*) as n from h group by 1, 2),
    n as (select v.doc_id, v.tenant_id, v.vendor_id, case when v.doc_id % 7 = 0 then 'qqqq' else name end as name, upper(replace(v.account, '-', '')) as account, mask, p.account as known, p.n from v join p on p.tenant_id = v.tenant_id and p.vendor_id = v.vendor_id where v.doc_id % 2 = 1)
    select doc_id, 'vendor_name' as check_id, 'warn' as severity from n where name = 'qqqq' union all select doc_id, 'vendor_bank_changed', 'error' from n where account <> known
    union all select doc_id, 'invoice_number_format', 'warn' from n where n >= 3 and not exists (select 1 from h where h.tenant_id = n.tenant_id and h.vendor_id = n.vendor_id and h.mask = n.mask)""")
def _(docs):
    i = F.col("doc_id")
    rows = docs.select(
        "doc_id", "tenant_id", "vendor_id", "created_at", "reviewed_at", F.concat(F.lit("Vendor"), "vendor_id").alias("name"),
        F.concat(F.lit("ac-"), "vendor_id", F.when((i % 32).isin(0, 1), "x").otherwise("")).alias("bank_account"), F.when(i % 5 == 0, "IN/7").when(i % 5 == 1, "T-42").otherwise("GST08").alias("number"),
    )
    return records.vendor_checks(rows.where("doc_id % 2 = 1").withColumn("name", F.when(i % 7 == 0, "qqqq").otherwise(F.col("name"))), rows.where("doc_id % 2 = 0"))


@query("PF13_review_expiry", "docs", sql=f"""select doc_id, cast(case when k > x then x else k end as timestamp) as kept_until from (select doc_id, created_at + interval '{DEFAULTS.retention_cap_hours}' hour as x,
    case when blob_expires_at is null then created_at + interval '{DEFAULTS.retention_cap_hours}' hour when blob_expires_at > d then blob_expires_at else d end as k from (select *, review_due_at + (doc_id % 200) * interval '1' hour + interval '48' hour as d from docs where review_due_at is not null))""")
def _(docs):
    due = F.expr("review_due_at + (doc_id % 200) * interval '1' hour")  # some past the cap
    return docs.where("review_due_at is not null").select("doc_id", records.review_expiry("created_at", "blob_expires_at", due).cast("timestamp").alias("kept_until"))


IN_WORK = "case when processed_at is null then 'processing' else status end"


@query("RV8_job_failure", "docs", "runs", sql=f"select doc_id, case when processed_at is null and doc_id in (select doc_id from runs where error is not null) then 'failed' else {IN_WORK} end as status from docs")
def _(docs, runs):
    return records.fail_processing(docs.withColumn("status", F.expr(IN_WORK)), runs.where("error is not null")).select("doc_id", "status")


@query("RV5_retry", "docs", "runs", sql="select doc_id, processed_at is null and doc_id in (select doc_id from runs where error is not null) as accepted from docs")
def _(docs, runs):
    """Every document is asked for again; only those that failed are taken."""
    failed = records.fail_processing(docs.withColumn("status", F.expr(IN_WORK)), runs.where("error is not null"))
    return records.retry(failed, docs)[1]


@query("QL9_page_edge", "docs", sql="select doc_id, cast(case when p > 15 and e > 1400 then 1400 when p between 7 and 15 and e > 1800 then 1800 else e end as bigint) as edge from (select doc_id, doc_id % 30 + 1 as p, 1200 + doc_id % 7 * 200 as e from docs)")
def _(docs):
    i = F.col("doc_id")
    return docs.select("doc_id", records.page_edge(1200 + i % 7 * 200, i % 30 + 1).cast("long").alias("edge"))


def misread(lines: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Invoices of which one line is misread - its quantity with a zero too many, of every third document its rate too, of every
    seventh the grand total - and what a second reading of every second document saw."""
    first = F.col("line_index") == 0
    rows = lines.select("doc_id", "line_index", "rate_per", "discount", "taxable_value", "gst_rate", F.when(first & (F.col("doc_id") % 5 > 0), F.col("quantity") * 10).otherwise(F.col("quantity")).cast("decimal(18,2)").alias("quantity"), F.when(first & (F.col("doc_id") % 3 == 0), F.col("rate") + 100).otherwise(F.col("rate")).cast("decimal(18,2)").alias("rate"))
    heads = headers.select("doc_id", "invoice_date", "subtotal", "grand_total", "cgst_amount", F.col("cgst_amount").alias("sgst_amount"), "igst_amount", "other_charges", "discount_total", "round_off", "supplier_gstin", "place_of_supply")
    key = lambda n: F.format_string(f"line_items[%d].{n}", "line_index")
    seen = lines.where("line_index = 0 and doc_id % 2 = 0").select("doc_id", F.explode(F.array(*[F.struct(key(f).alias("field_key"), F.col(f).alias("value"), F.lit("zoomed reading").alias("source")) for f in ("quantity", "rate")])).alias("s"))
    total = headers.where("doc_id % 4 = 0").select("doc_id", F.struct(F.lit("grand_total").alias("field_key"), (F.col("subtotal") + F.col("tax_total")).cast("decimal(18,2)").alias("value"), F.lit("signed code").alias("source")).alias("s"))
    return heads, rows, seen.unionByName(total).select("doc_id", "s.*")


@query("RP5_search", "inv_line", "inv_header")
def _(lines, headers):
    """A test holds it against rules run over whole documents, candidate by candidate."""
    found = repair.search(*misread(lines, headers))
    shown = F.transform("changes", lambda c: F.concat(c["field_key"], F.lit(": "), c["old"].cast("decimal(18,2)"), F.lit(" -> "), c["value"], F.lit(" ("), c["source"], F.lit(")")))
    return found.select("doc_id", "kind", F.array_join(shown, "; ").alias("changes"))


def synthetic_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed rules over made-up invoices and receipts, by rule: none, since they are exact."""
    lines = datasets.invoice_lines(spark, 1000)
    heads = datasets.invoice_headers(lines, DEFAULTS.print_as_of)
    found = checks.line_checks(lines).unionByName(checks.invoice_checks(heads, lines)).unionByName(checks.receipt_checks(datasets.receipts(spark, 1000, DEFAULTS.print_as_of)))
    return found.groupBy(evidence.family().alias("rule")).agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("status") == "fail").alias("failed"))


def synthetic_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truths of a made-up dataset, as written and read back."""
    folder = _work(spark)
    datasets.truths(spark, 100, DEFAULTS.print_as_of).write.partitionBy("bucket").json(folder)
    return spark.read.json(folder).select("bucket", "name", F.from_json("truth", datasets.TRUTH).alias("t")).groupBy("bucket", "t.doc_type").agg(F.count_distinct("name").alias("documents"), F.sum(F.size("t.line_items")).alias("lines"))


QUERIES |= {"SRC13_synthetic": synthetic_invoices, "SRC15_dataset": synthetic_dataset}
ORACLES["SRC15_dataset"] = "select bucket, doc_type, cast(100 as bigint) as documents, cast(case when doc_type = 'lr' then 0 else 300 end as bigint) as lines from (values ('digital', 'invoice'), ('good_scan', 'invoice'), ('poor_scan', 'invoice'), ('bilingual', 'invoice'), ('carbon', 'lr')) v(bucket, doc_type)"

from docproof.plans import decisions, entries, learned, review  # noqa: E402, F401  (register their queries)
