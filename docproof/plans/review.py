"""Queries over scores, suggestions, access, templates and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docproof.functions.text import names_match
from docproof.operators import access, evidence, layout, records, scoring
from docproof.plans.registry import NOW, ORACLES, QUERIES, query
from docproof.sources.tables import load

# --- scores ----------------------------------------------------------------------------------------------------------

LOGIT = "ln({p} / (1 - {p}))"
RATE = "least(greatest((seen_right + 9.0::double) / (seen + 10.0::double), 0.0001::double), 0.9999::double)"
#: Signals by their conditions; a null counts as false.
SIGNALS = {
    "legibility_clear": "legibility = 'clear' and value is not null", "absent_optional": "value is null and legibility = 'not_present' and not required",
    "legibility_partly": "legibility = 'partly_legible'", "legibility_illegible": "legibility = 'illegible'", "proven": "proven",
    "agree": "double_read and agreement", "disagree": "double_read and not agreement", "raw_inconsistent": "not raw_consistent", "raw_consistent": "raw_consistent",
    "in_text_layer": "in_text_layer", "not_in_text_layer": "not in_text_layer", "format_ok": "format_ok", "format_bad": "not format_ok",
    "doc_check_failed": "bad > 0", "quality_digital": "quality_bucket = 'digital'", "quality_poor": "quality_bucket = 'poor_scan'", "handwriting": "handwriting",
    "indic_script": "indic_script", "unparseable": "unparseable", "missing_required": "false", "code_match": "code_agrees and not code_filled",
    "code_filled": "code_filled", "code_mismatch": "not code_agrees", "zoom_illegible": "zoom_illegible", "repaired": "repaired", "master_match": "master_match",
}
SIGNAL_SQL = f"""c as (select doc_id, field_key, count(*) filter (where status = 'pass') as passed, count(*) filter (where status = 'fail' and severity = 'error' and check_id not like 'format:%') as failed from findings group by 1, 2),
    b as (select doc_id, count(*) as bad from findings where status = 'fail' and severity = 'error' group by 1),
    s as (select r.*, coalesce(bad, 0) > 0 as doc_failed, {", ".join(f"cast(coalesce({e}, false) as double) as x_{n}" for n, e in SIGNALS.items())},
        cast(least(2, coalesce(passed, 0)) as double) as x_checks_passed, cast(least(2, coalesce(failed, 0)) as double) as x_checks_failed,
        case when seen > 0 then {LOGIT.format(p=RATE)} - {LOGIT.format(p="0.9::double")} else 0 end as x_history
        from readings r left join c on c.doc_id = r.doc_id and c.field_key = r.field_key left join b on b.doc_id = r.doc_id)"""
NAMES = sorted([*SIGNALS, "checks_passed", "checks_failed", "history"])


def _rows(readings: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    return readings.withColumn("history", evidence.history_signal("seen_right", "seen")), findings.withColumn("field_keys", F.array("field_key"))


@query("CF2_features", "readings", "findings", sql=f"with {SIGNAL_SQL} select doc_id, line_index, {', '.join(f'round(x_{n}, 6) as {n}' for n in NAMES)} from s")
def _(readings, findings):
    x = F.col("signals")
    return scoring.features(*_rows(readings, findings)).select("doc_id", "line_index", *[F.round(x[n], 6).alias(n) for n in NAMES])


TOTAL = " + ".join([str(float(evidence.WEIGHTS["bias"])), *[f"{evidence.WEIGHTS[n]} * x_{n}" for n in NAMES]])


@query("CF4_score_document", "readings", "findings", sql=f"""with {SIGNAL_SQL},
    w as (select *, 1 / (1 + exp(-({TOTAL}))) as raw, case when high_stakes then 0.95::double else 0.9::double end as t from s),
    why as (select doc_id, field_key, case when severity = 'warn' then 3 when check_id like 'qr:%' then -1 else 0 end as rank, ordinal as turn, case severity when 'warn' then 'warn:' else 'check:' end || check_id as code, message as words from findings where status = 'fail'
        union all select doc_id, field_key, 0, 100001, 'repaired', coalesce(suggestion_reason, 'Corrected automatically; please confirm') from s where repaired
        union all select doc_id, field_key, 1, 100002, 'disagree', case when found_on_zoom then 'Found only on the zoomed re-read' else 'Two readings differ' end from s where x_disagree = 1 and not repaired
        union all select doc_id, field_key, 1, 100003, 'suggestion', coalesce(suggestion_reason, 'Suggested ' || suggested_value) from s where suggested_value is not null and not repaired
        union all select doc_id, field_key, 1, 100004, 'illegible_zoom', 'Unreadable even when zoomed in' from s where zoom_illegible
        union all select doc_id, field_key, 1, 100005, 'unparseable', 'Not a valid ' || kind from s where unparseable
        union all select doc_id, field_key, 1, 100006, 'illegible', 'Not legible on the document' from s where legibility = 'illegible'
        union all select doc_id, field_key, 2, 100007, 'partly_legible', 'Partly unclear on the document' from s where legibility = 'partly_legible' and value is not null
        union all select doc_id, field_key, 2, 100008, 'raw_inconsistent', 'Doesn''t match the text as printed' from s where x_raw_inconsistent = 1
        union all select doc_id, field_key, 2, 100009, 'not_in_text_layer', 'Not in the PDF''s text' from s where x_not_in_text_layer = 1 and high_stakes),
    g as (select doc_id, field_key, min(rank) as rank, first(words order by rank, turn) as words, string_agg(code, ',' order by rank, turn) as codes from why group by 1, 2),
    h as (select w.*, g.words, g.codes, coalesce(g.rank <= 1, false) or (high_stakes and legibility = 'partly_legible' and value is not null) as hard, case when doc_failed then raw * 0.8::double else raw end as shown from w left join g on g.doc_id = w.doc_id and g.field_key = w.field_key),
    n as (select *, hard or raw < t as review from h)
    select doc_id, line_index, round(shown, 4) as score, review as needs_review, case when shown >= t and not review then case when doc_failed then 'medium' else 'high' end when shown >= 0.6 and not hard then 'medium' else 'low' end as band,
        case when review then coalesce(words, case when value is null then 'Check it isn''t on the document' else 'Not proven; please confirm' end) end as reason,
        concat_ws(',', coalesce(codes, case when review then 'low_score' end), case when hard then 'forced' end) as codes from n""")
def _(readings, findings):
    done = scoring.score_fields(*_rows(readings, findings))
    return done.select("doc_id", "line_index", "score", "needs_review", "band", "reason", F.array_join("reason_codes", ",").alias("codes"))


@query("CK29_suggestions", "readings", "findings", sql="""with p as (select f.doc_id, f.field_key, case when check_id like 'line_math:%' then '7' else '9' end as new, case when check_id like 'line_math:%' then message else 'value encoded in the signed e-invoice QR' end as why, row_number() over (partition by f.doc_id, f.field_key order by ordinal) as turn
        from findings f join readings r on r.doc_id = f.doc_id and r.field_key = f.field_key where status = 'fail' and (check_id like 'line_math:%' or (check_id like 'qr:%' and k % 2 = 0)) and suggested_value is null and not repaired)
    select r.doc_id, line_index, coalesce(suggested_value, new) as suggested_value, coalesce(suggestion_reason, why) as reason from readings r left join p on p.doc_id = r.doc_id and p.field_key = r.field_key and turn = 1""")
def _(readings, findings):
    """Arithmetic proposes 7; the signed code holds 9 for every second field and nothing for the others."""
    fields = readings.withColumns({"kind": F.lit("string"), "code_value": F.when(F.col("k") % 2 == 0, "9")})
    found = findings.withColumns({"field_keys": F.array("field_key"), "suggest": F.when(F.startswith("check_id", F.lit("line_math:")), "7")})
    return scoring.suggest(fields, found).select("doc_id", "line_index", "suggested_value", F.col("suggestion_reason").alias("reason"))


@query("RP6_apply", "readings", sql="""select doc_id, line_index, case when k % 4 = 1 then value end as alt_value, case when k % 4 = 1 then '5' else value end as value, k % 4 = 1 or repaired as repaired, case when k % 4 = 1 then false else agreement end as agreement,
    case when k % 4 = 2 then '6' else suggested_value end as suggested_value, case when k % 4 = 2 then '6 would make every total add up (the print may contain a misread digit)' when k % 4 = 1 then 'Corrected from ' || value || ' to 5: the second reading agrees and the totals add up' else suggestion_reason end as reason from readings""")
def _(readings):
    new = lambda n, value, source: readings.where(F.col("k") % 4 == n).select("doc_id", "field_key", F.lit(value).alias("new"), F.lit(source).alias("source"))
    done = scoring.apply_repairs(readings.withColumn("alt_value", F.lit(None).cast("string")), new(1, "5", "second reading"), new(2, "6", "a misread digit"))
    return done.select("doc_id", "line_index", "alt_value", "value", "repaired", "agreement", "suggested_value", F.col("suggestion_reason").alias("reason"))


@query("RP4_printed_digits", "inv_line", sql="""with p as (select doc_id, line_index, rate, case cast(item_code % 4 as int) when 0 then 'Rs. 1,' || rate when 1 then 'Rs. ' || rate when 2 then cast(floor(rate) as bigint) || ' only' end as raw, item_code from inv_line)
    select doc_id, line_index, cast(cast(floor(rate) as bigint) as varchar) as whole, case when item_code % 4 = 1 or rate <> floor(rate) then split_part(cast(rate as varchar), '.', 2) else '' end as fraction from p""")
def _(lines):
    """A print with other digits, the value in full, its whole part alone, or none."""
    i = F.col("item_code") % 4
    raw = F.when(i == 0, F.concat(F.lit("Rs. 1,"), "rate")).when(i == 1, F.concat(F.lit("Rs. "), "rate")).when(i == 2, F.concat(F.floor("rate").cast("string"), F.lit(" only")))
    return lines.select("doc_id", "line_index", scoring.printed_digits("rate", raw).alias("d")).select("doc_id", "line_index", "d.*")


@query("RV10_tags", "readings", sql="select doc_id, line_index, concat_ws(', ', case when proven then 'adds up' end, case when in_text_layer then 'in the PDF text' end, case when master_match then 'matches your records' end) as tags from readings")
def _(readings):
    kinds = {"proven": "arithmetic", "code_agrees": "code", "in_text_layer": "text_layer", "master_match": "records"}
    proof = F.array_compact(F.array(*[F.when(F.col(c), k) for c, k in kinds.items()]))
    return readings.select("doc_id", "line_index", F.array_join(scoring.reviewer_tags(proof), ", ").alias("tags"))


# --- access, export, guards ------------------------------------------------------------------------------------------

ROLES = ("admin", "manager", "reviewer", "uploader", "staff_reviewer", "staff_ops", None)
ROLE_SQL = "case cast(vendor_id % 7 as int) when 0 then 'admin' when 1 then 'manager' when 2 then 'reviewer' when 3 then 'uploader' when 4 then 'staff_reviewer' when 5 then 'staff_ops' end"


def _role():
    return F.get(F.array(*map(F.lit, ROLES)), (F.col("vendor_id") % 7).cast("int"))


@query("PF3_permission", "docs", sql=f"""with g(role, perms) as (values ('admin', ',document.upload,document.view_all,document.view_assigned,review.work,review.assign,dashboard.view,export.run,match.run,template.manage,user.manage,audit.view,'),
        ('manager', ',document.upload,document.view_all,document.view_assigned,review.work,review.assign,dashboard.view,export.run,match.run,template.manage,'), ('reviewer', ',document.view_assigned,review.work,'), ('uploader', ',document.upload,document.view_own_uploads,'),
        ('staff_reviewer', ',document.view_assigned,review.work,'), ('staff_ops', ',metrics.internal,')),
    r as (select doc_id, {ROLE_SQL} as role, case cast(doc_id % 5 as int) when 0 then 'audit.view' when 1 then 'export.run' when 2 then 'document.upload' when 3 then 'review.work' else 'no.such' end as permission from docs)
    select doc_id, r.role, permission, coalesce(contains(perms, ',' || permission || ','), false) as allowed from r left join g on g.role = r.role""")
def _(docs):
    asked = F.get(F.array(*map(F.lit, ("audit.view", "export.run", "document.upload", "review.work", "no.such"))), (F.col("doc_id") % 5).cast("int"))
    return docs.select("doc_id", _role().alias("role"), asked.alias("permission")).withColumn("allowed", access.can("role", "permission"))


@query("PF4_may_open", "docs", sql=f"""select doc_id, coalesce(case when role like 'staff%' then role = 'staff_reviewer' and coalesce(doc_id % 4 = 1, false) when doc_id % 3 = 0 then false when role in ('admin', 'manager') then true when role = 'reviewer' then doc_id % 4 = 1 when role = 'uploader' then doc_id % 5 = 1 end, false) as may_open
    from (select doc_id, {ROLE_SQL} as role from docs)""")
def _(docs):
    rows = docs.select("doc_id", "tenant_id", _role().alias("role"))
    person = F.when(~F.startswith("role", F.lit("staff")) | F.col("role").isNull(), F.col("tenant_id") + (F.col("doc_id") % 3 == 0).cast("int"))
    i = F.col("doc_id")
    return rows.select("doc_id", access.may_open(F.col("role"), F.lit(1), person, F.col("tenant_id"), i % 4, i % 5).alias("may_open"))


@query("PF7_summary", "docs", sql="""select doc_id, case doc_type when 'invoice' then 'Tax invoice' when 'lr' then 'Lorry receipt / GR / bilty' when 'po' then 'Purchase order' when 'grn' then 'Goods receipt note' end as doc_type_label,
    case status when 'ready' then 'Ready to export' when 'needs_review' then 'Needs review' when 'exported' then 'Exported' else status end as status_label, quality_bucket as quality, blob_purged_at is null as available from docs""")
def _(docs):
    return access.document_summary(docs).select("doc_id", "doc_type_label", "status_label", "quality", "available")


@query("PF8_field_view", "fields", sql="select doc_id, line_index, field_name as name, case when status = 'corrected' then final_value else value end as value, value as extracted_value, needs_review, status, is_high_stakes as high_stakes from fields")
def _(fields):
    return access.field_view(fields)


@query("SNK6_export", "docs", sql=f"select doc_id, 'exported' as status, cast({NOW} as varchar) as exported_at from docs where doc_type = 'po' and status in ('ready', 'exported')")
def _(docs):
    return access.export_ready(docs, "po", again=True).select("doc_id", "status", F.col("exported_at").cast("string").alias("exported_at"))


def written_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as CSV and read back as text columns; readers take the mark off again."""
    from docproof.plans.queries import _work

    folder = _work(spark)
    access.write_csv(load(spark, sf_dir, "inv_line").select("doc_id", "line_index", F.concat("description", F.lit(', "₹"')).alias("description"), "quantity"), folder)
    back = spark.read.csv(folder, header=True, escape='"')
    return back.toDF("doc_id", "line_index", "description", "quantity").select(F.col("doc_id").cast("long"), F.col("line_index").cast("int"), "description", "quantity")


QUERIES["SNK3_csv"] = written_csv


def _put_csv_oracle() -> None:
    from docproof.sources.tables import with_clause

    ORACLES["SNK3_csv"] = with_clause("inv_line") + """ select doc_id, line_index, description || ', "₹"' as description, cast(quantity as varchar) as quantity from inv_line"""


_put_csv_oracle()


@query("MT15_match_guard", "docs", sql="""with s as (select cast(floor(doc_id / 6) as bigint) as match_id, doc_id, case when doc_id % 19 = 0 then 'invoice' else doc_type end as role, doc_type, case when doc_id % 29 = 0 then null else status end as status from docs where doc_type is not null)
    select match_id, case when count(*) > count(status) then 'not_found' when count(*) filter (where role = 'po') <> 1 or count(*) filter (where role = 'invoice') <> 1 or count(*) filter (where role <> doc_type or role not in ('po', 'grn', 'invoice')) > 0 then 'wrong_types'
        when count(*) filter (where status not in ('ready', 'exported')) > 0 then 'not_ready' end as problem from s group by 1""")
def _(docs):
    sets = docs.where("doc_type is not null").select(F.floor(F.col("doc_id") / 6).alias("match_id"), "doc_id", F.when(F.col("doc_id") % 19 == 0, "invoice").otherwise(F.col("doc_type")).alias("role"))
    return access.match_guard(sets, docs.where("doc_id % 29 <> 0"))


@query("SO3_audit_feed", "events", sql="select event_id as seq, event_type as event from events where user_id % 7 = 3 order by event_id desc limit 1000")
def _(events):
    return access.audit_feed(events.select(F.col("event_id").alias("seq"), F.col("event_type").alias("event"), (F.col("user_id") % 7).alias("tenant_id")), 3, 5000).select("seq", "event")


@query("RV7_run_log", "runs", sql="select run_id, doc_id, case when error is null then latency_ms else 0 end as latency_ms, case when error is null then latency_ms % 900 else 0 end as input_tokens, case when error is null then latency_ms % 70 else 0 end as output_tokens, error from runs")
def _(runs):
    used = {"input_tokens": F.col("latency_ms") % 900, "output_tokens": F.col("latency_ms") % 70}
    return access.run_rows(runs.withColumns(used)).select("run_id", "doc_id", "latency_ms", "input_tokens", "output_tokens", "error")


# --- types and templates ---------------------------------------------------------------------------------------------


@query("UD3_extra_fields", "part", sql="""with e as (select 'invoice' as doc_type, lower(trim(' F' || p_partkey % 50 || case when p_partkey % 3 = 0 then '-x ' else '_ok' end)) as name, case when p_partkey % 50 % 4 = 0 then '' else repeat('L' || p_partkey % 50, 40) end as label, case when p_partkey % 50 % 5 = 0 then 'blob' else 'number' end as kind, p_partkey % 50 % 2 = 0 as high_stakes from part),
    g as (select distinct doc_type, name, substring(case when label = '' then name else label end, 1, 80) as label, case kind when 'blob' then 'string' else kind end as kind, high_stakes from e where regexp_matches(name, '^[a-z][a-z0-9_]{1,40}$') and name <> 'f7_ok')
    select 'invoice' as doc_type, 'f7_ok' as name, 'Seven' as label, 'date' as kind, true as high_stakes union all select * from g""")
def _(part):
    i = F.col("p_partkey") % 50
    name = F.concat(F.lit(" F"), i, F.when(F.col("p_partkey") % 3 == 0, "-x ").otherwise("_ok"))
    extras = part.select(F.lit("invoice").alias("doc_type"), name.alias("name"), F.when(i % 4 == 0, "").otherwise(F.repeat(F.concat(F.lit("L"), i), 40)).alias("label"), F.when(i % 5 == 0, "blob").otherwise("number").alias("kind"), (i % 2 == 0).alias("high_stakes"))
    spec = part.sparkSession.createDataFrame([("invoice", "f7_ok", "Seven", "date", True)], "doc_type string, name string, label string, kind string, high_stakes boolean")
    return access.with_extra_fields(spec, extras)


TEMPLATE_SQL = "t as (select tenant_id * 100000 + vendor_id as template_id, tenant_id, min(doc_type) as doc_type from docs group by 1, 2), e as (select tenant_id * 100000 + case when doc_id % 41 = 0 then vendor_id + 1 else vendor_id end as template_id, doc_id from docs where doc_type = 'invoice' or doc_id % 5 = 0)"


@query("UD4_new_templates", "docs", sql=f"""with {TEMPLATE_SQL}, r as (select t.*, e.doc_id, d.tenant_id as dt, d.doc_type as dd, d.status, d.vendor_id from t left join e on e.template_id = t.template_id left join docs d on d.doc_id = e.doc_id),
    a as (select template_id, case when count(doc_id) not between 3 and 5 then 'wrong_number' when count(*) filter (where coalesce(dt <> tenant_id, true)) > 0 then 'not_found' when count(*) filter (where coalesce(dd <> doc_type, true)) > 0 then 'mixed_types'
        when count(*) filter (where status not in ('ready', 'exported')) > 0 then 'not_reviewed' when min(vendor_id) <> max(vendor_id) then 'several_vendors' end as problem, min(vendor_id) as v from r group by 1)
    select template_id, case when problem is null then v end as vendor_id, problem from a""")
def _(docs):
    """A template a vendor, of its first type; some examples are another vendor's, named twice."""
    key = lambda v: F.col("tenant_id") * 100_000 + v
    templates = docs.groupBy(key(F.col("vendor_id")).alias("template_id"), "tenant_id").agg(F.min("doc_type").alias("doc_type"))
    vendor = F.when(F.col("doc_id") % 41 == 0, F.col("vendor_id") + 1).otherwise(F.col("vendor_id"))
    examples = docs.where("doc_type = 'invoice' or doc_id % 5 = 0").select(key(vendor).alias("template_id"), "doc_id")
    return access.new_templates(templates, examples.unionAll(examples.where("doc_id % 2 = 0")), docs)


@query("UD5_activate", "docs", sql="""with t as (select doc_id as template_id, tenant_id, case when doc_id % 13 = 0 then null else vendor_id end as vendor_id, doc_type, case when doc_id % 2 = 0 then 'active' else 'draft' end as status from docs),
    c as (select tenant_id, vendor_id, doc_type, max(template_id) as newest from t where template_id % 3 = 0 and vendor_id is not null and doc_type is not null group by 1, 2, 3)
    select template_id, case when template_id = newest then 'active' when newest is not null and (status = 'active' or template_id % 3 = 0) then 'retired' else status end as status from t left join c on c.tenant_id = t.tenant_id and c.vendor_id = t.vendor_id and c.doc_type = t.doc_type""")
def _(docs):
    i = F.col("doc_id")
    templates = docs.select(i.alias("template_id"), "tenant_id", F.when(i % 13 != 0, F.col("vendor_id")).alias("vendor_id"), "doc_type", F.when(i % 2 == 0, "active").otherwise("draft").alias("status"))
    return access.activate(templates, templates.where("template_id % 3 = 0").select("template_id")).select("template_id", "status")


# --- pages -----------------------------------------------------------------------------------------------------------

BOX_SQL = "b as (select doc_id, line_index, item_code % 130 / 100.0::double - 0.1::double as x0, item_code % 90 / 100.0::double as y0, item_code % 130 / 100.0::double + case when item_code % 3 = 0 then -0.1::double else 0.2::double end as x1, case when item_code % 17 = 0 then null else item_code % 90 / 100.0::double + 0.15::double end as y1 from inv_line)"
HELD_SQL = "h as (select doc_id, line_index, greatest(0, least(1, x0)) as x0, greatest(0, least(1, y0)) as y0, greatest(0, least(1, x1)) as x1, greatest(0, least(1, y1)) as y1 from b where x0 is not null and y1 is not null), k as (select * from h where x1 - x0 > 0.001 and y1 - y0 > 0.001)"


def _box():
    x, y = F.col("item_code") % 130 / 100.0, F.col("item_code") % 90 / 100.0
    right = x + F.when(F.col("item_code") % 3 == 0, -0.1).otherwise(0.2)
    return F.struct((x - 0.1).alias("x0"), y.alias("y0"), right.alias("x1"), F.when(F.col("item_code") % 17 != 0, y + 0.15).alias("y1"))


def _corners(box):
    return [F.round(box[n], 6).alias(n) for n in layout.CORNERS]


@query("SC29_boxes", "inv_line", sql=f"with {BOX_SQL}, {HELD_SQL} select b.doc_id, b.line_index, round(k.x0, 6) as x0, round(k.y0, 6) as y0, round(k.x1, 6) as x1, round(k.y1, 6) as y1 from b left join k on k.doc_id = b.doc_id and k.line_index = b.line_index")
def _(lines):
    return lines.select("doc_id", "line_index", layout.bounded_box(_box()).alias("b")).select("doc_id", "line_index", *_corners(F.col("b")))


@query("SC30_full_page", "inv_line", sql=f"""with {BOX_SQL}, {HELD_SQL} select doc_id, line_index, round(case when doc_id % 3 = 0 then x0 else 0.1 + x0 * (0.9::double - 0.1::double) end, 6) as x0, round(case when doc_id % 3 = 0 then y0 else 0.2 + y0 * (0.7::double - 0.2::double) end, 6) as y0,
    round(case when doc_id % 3 = 0 then x1 else 0.1 + x1 * (0.9::double - 0.1::double) end, 6) as x1, round(case when doc_id % 3 = 0 then y1 else 0.2 + y1 * (0.7::double - 0.2::double) end, 6) as y1 from k""")
def _(lines):
    frame = F.when(F.col("doc_id") % 3 != 0, F.struct(F.lit(0.1).alias("x0"), F.lit(0.2).alias("y0"), F.lit(0.9).alias("x1"), F.lit(0.7).alias("y1")))
    boxes = lines.select("doc_id", "line_index", layout.bounded_box(_box()).alias("b"), frame.alias("f")).where("b is not null")
    return boxes.select("doc_id", "line_index", layout.on_full_page("b", "f").alias("b")).select("doc_id", "line_index", *_corners(F.col("b")))


@query("SC35_document_pages", "inv_line", sql="""select doc_id, cast(coalesce(nullif(case when item_code % 7 = 0 then null else item_code % 3 end, 0), 1) as bigint) as part, string_agg(line_index + 1, ',' order by line_index) as pages from inv_line group by 1, 2""")
def _(lines):
    pages = lines.select("doc_id", (F.col("line_index") + 1).alias("page_no"), F.when(F.col("item_code") % 7 != 0, F.col("item_code") % 3).alias("document_index"))
    return layout.document_pages(pages).select("doc_id", F.col("part").cast("long").alias("part"), F.array_join("pages", ",").alias("pages"))


@query("RV24_text_layers", "inv_line", sql=f"""select doc_id, sha256('{layout.LAYER_INTRO}' || chr(10) || chr(10) || string_agg('--- page ' || (line_index + 1) || ' text layer ---' || chr(10) || coalesce(substring(case when item_code % 9 = 0 then null else repeat(description || ' ', 500) end, 1, 12000), ''), chr(10) || chr(10) order by line_index)) as sha from inv_line group by 1""")
def _(lines):
    text = F.when(F.col("item_code") % 9 != 0, F.repeat(F.concat("description", F.lit(" ")), 500))
    return layout.text_layers(lines.select("doc_id", F.col("line_index").alias("page_no"), text.alias("text"))).select("doc_id", F.sha2("block", 256).alias("sha"))


@query("RV23_field_guides", "part", sql="""with f as (select distinct p_partkey % 40 as i from part), s as (select 'type' || i % 4 as doc_type, i, i % 3 = 0 and i % 4 <> 2 as is_line, '- f' || i || ': Field ' || i || ' [' || case when i % 2 = 0 then 'number' else 'string' end || ']' || case when i % 5 = 0 then ' (as printed)' else '' end as line from f)
    select doc_type, 'Expected document type: ' || upper(doc_type) || ' (made up).' || chr(10) || chr(10) || 'Header fields:' || coalesce(chr(10) || string_agg(line, chr(10) order by i) filter (where not is_line), '')
        || coalesce(chr(10) || chr(10) || 'Line item columns:' || chr(10) || string_agg(line, chr(10) order by i) filter (where is_line), '') || case when doc_type = 'type1' then chr(10) || chr(10) || 'Read twice.' else '' end as guide from s group by 1""")
def _(part):
    """Made-up types, one without lines, one with a word of advice."""
    i, kind = F.col("i"), F.concat(F.lit("type"), F.col("i") % 4)
    spec = part.select((F.col("p_partkey") % 40).alias("i")).distinct().select(
        kind.alias("doc_type"), F.upper(kind).alias("label"), F.lit("made up").alias("description"), F.when(i % 4 == 1, "Read twice.").alias("guidance"), i.alias("place"), ((i % 3 == 0) & (i % 4 != 2)).alias("is_line"),
        F.concat(F.lit("f"), i).alias("name"), F.concat(F.lit("Field "), i).alias("title"), F.when(i % 2 == 0, "number").otherwise("string").alias("kind"), F.when(i % 5 == 0, "as printed").alias("hint"),
    )
    return layout.field_guides(spec)


@query("CK31_rebuild", "fields", sql="select doc_id, line_index, cast(case when status = 'corrected' then final_value else value end as decimal(18,2)) as quantity from fields")
def _(fields):
    return layout.rebuild_lines(fields, {"quantity": "decimal(18,2)"})


@query("SO6_notes", "readings", sql="select doc_id, string_agg(legibility, ',' order by first_line) as notes from (select doc_id, legibility, min(line_index) as first_line from readings group by 1, 2) group by 1")
def _(readings):
    return records.distinct_in_order(readings, "doc_id", "line_index", "legibility").select("doc_id", F.array_join("legibility", ",").alias("notes"))


@query("SC41_names", "customer")
def _(customers):
    """Every name against itself written otherwise, or with other digits."""
    i = F.col("c_custkey")
    other = F.when(i % 2 == 0, F.concat(F.upper("c_name"), F.lit(" PVT. LTD"))).otherwise(F.concat(F.lit("Other trader "), i))
    return customers.select(i.alias("vendor_id"), names_match(F.concat("c_name", F.lit(" Private Limited")), other).alias("same"))
