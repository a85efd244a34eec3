"""The driver's tables, and the domain tables made of them.

``ADAPTERS`` are definitions in the common subset of Spark's and DuckDB's SQL; each may read raw tables and earlier
adapters by their names in braces. ``load`` gives one as a DataFrame - a lazy plan, so filters and columns reach the
scans - and ``with_clause`` gives the same definitions as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

ADAPTERS: dict[str, str] = {
    # the line index is dense, since (order, line number) is no key
    "inv_line": """
        select l_orderkey as doc_id,
               cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                    l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 as int) as line_index,
               l_partkey as item_code, p_name as description, l_suppkey as supplier_id,
               cast(l_quantity as decimal(18,2)) as quantity, cast(p_retailprice as decimal(18,2)) as rate,
               cast(case when l_partkey % 11 = 0 then cast(l_extendedprice as decimal(18,2))
                    else cast(cast(l_quantity as decimal(18,2)) * cast(p_retailprice as decimal(18,2)) as decimal(18,2)) end as decimal(18,2)) as taxable_value,
               cast(cast(l_tax as decimal(9,2)) * 100 as decimal(9,2)) as gst_rate,
               cast(cast(l_quantity as decimal(18,2)) * cast(p_retailprice as decimal(18,2)) * cast(l_tax as decimal(9,2)) as decimal(18,2)) as tax_amount,
               case when l_partkey % 23 = 0 then '100 NOS' when l_partkey % 7 = 0 then 'NOS' else null end as rate_per,
               cast(case when l_partkey % 19 = 0 then 5 else 0 end as decimal(18,2)) as discount,
               l_returnflag, l_linestatus
        from {lineitem} join {part} on p_partkey = l_partkey""",
    "inv_header": """
        select o_orderkey as doc_id, c_nationkey as tenant_id, o_custkey as buyer_id, cast(o_orderdate + interval '24' year as date) as invoice_date,
               cast(o_orderdate + (24 * 12) * interval '1' month + (o_orderkey % 40 - 5) * interval '1' day as date) as due_date,
               case o_orderstatus when 'F' then 'ready' when 'O' then 'needs_review' else 'exported' end as status,
               t.subtotal, t.tax as tax_total,
               cast(case when o_orderkey % 7 = 0 then cast(o_totalprice as decimal(18,2)) else t.subtotal + t.tax end as decimal(18,2)) as grand_total,
               coalesce(t.n, 0) as line_count,
               case when o_orderkey % 2 = 0 then cast(t.tax * cast(0.5 as decimal(3,1)) as decimal(18,2)) else null end as cgst_amount,
               case when o_orderkey % 2 = 0 then cast(t.tax * cast(0.5 as decimal(3,1)) as decimal(18,2)) + cast(case when o_orderkey % 26 = 0 then 1 else 0 end as decimal(18,2)) else null end as sgst_amount,
               case when o_orderkey % 2 = 1 then t.tax else null end as igst_amount,
               cast(case when o_orderkey % 15 = 0 then 100 else null end as decimal(18,2)) as other_charges,
               cast(case when o_orderkey % 21 = 0 then 50 else null end as decimal(18,2)) as discount_total,
               cast(case when o_orderkey % 5 = 0 then o_orderkey % 4 else null end as decimal(18,2)) * cast(0.4 as decimal(3,1)) as round_off,
               concat(lpad(cast(c_nationkey + 1 as varchar(2)), 2, '0'), 'ABCDE1234F1Z5') as supplier_gstin,
               concat(lpad(cast((c_nationkey + case when o_orderkey % 2 = 0 then 0 else 3 end) % 25 + 1 as varchar(2)), 2, '0'),
                      case when o_orderkey % 3 = 0 then '-State' else '' end) as place_of_supply,
               concat('INV/', lpad(cast((year(o_orderdate) + 24) % 100 as varchar(2)), 2, '0'), '-', lpad(cast((year(o_orderdate) + 25) % 100 as varchar(2)), 2, '0'), '/', cast(o_orderkey as varchar(20))) as invoice_number
        from {orders} join {customer} on c_custkey = o_custkey
        left join (select doc_id, cast(sum(taxable_value) as decimal(18,2)) as subtotal, cast(sum(tax_amount) as decimal(18,2)) as tax,
                          cast(count(*) as bigint) as n from {inv_line} group by doc_id) t on t.doc_id = o_orderkey""",
    "grn_line": """
        select doc_id, line_index, item_code, description, quantity as quantity_received,
               case l_returnflag when 'A' then quantity when 'R' then cast(quantity - 1 as decimal(18,2)) else null end as quantity_accepted,
               case l_returnflag when 'R' then cast(1 as decimal(18,2)) else null end as quantity_rejected
        from {inv_line} where l_linestatus = 'F'""",
    "po_line": """
        select distinct doc_id, item_code, description, cast(50 as decimal(18,2)) as quantity,
               case when item_code % 13 = 0 then cast(rate - 1 as decimal(18,2)) else rate end as rate,
               cast(5 as decimal(9,2)) as gst_rate
        from {inv_line} where item_code % 17 <> 0""",
    "docs": """
        select o_orderkey as doc_id, c_nationkey as tenant_id, o_custkey as vendor_id,
               case substring(o_orderpriority, 1, 1) when '1' then 'invoice' when '2' then 'lr' when '3' then 'po' when '4' then 'grn' else null end as doc_type,
               case o_orderstatus when 'F' then 'ready' when 'O' then 'needs_review' else 'exported' end as status,
               case cast(o_orderkey % 4 as int) when 0 then 'digital' when 1 then 'good_scan' when 2 then 'poor_scan' else null end as quality_bucket,
               case cast(o_orderkey % 5 as int) when 0 then 'english,hindi' when 1 then 'other' when 2 then 'tamil' else 'english' end as languages,
               o_orderkey % 6 = 0 as has_handwriting, o_orderkey % 20 = 3 as is_qa_sample,
               o_orderdate as created_at,
               case when o_orderkey % 9 = 0 then null else o_orderdate + (o_orderkey % 50) * interval '1' minute end as processed_at,
               case when o_orderkey % 4 < 2 then o_orderdate + interval '60' minute else null end as review_entered_at,
               case when o_orderkey % 4 < 2 then o_orderdate + interval '300' minute else null end as review_due_at,
               case when o_orderkey % 4 = 0 then o_orderdate + (60 + o_orderkey % 400) * interval '1' minute else null end as reviewed_at,
               case when o_orderkey % 10 = 0 then null else o_orderdate + interval '72' hour end as blob_expires_at,
               case when o_orderkey % 3 = 0 then o_orderdate else null end as blob_purged_at,
               cast(o_totalprice as decimal(18,2)) as processing_ms
        from {orders} join {customer} on c_custkey = o_custkey""",
    "fields": """
        select doc_id, line_index, 'quantity' as field_name, item_code % 5 = 0 as needs_review,
               case when item_code % 10 = 0 then 'corrected' when item_code % 5 = 0 then 'confirmed' else 'auto' end as status,
               cast(cast(item_code % 101 as decimal(9,2)) / 100 as double) as score, item_code % 3 = 0 as is_high_stakes,
               cast(quantity as varchar(30)) as value,
               case when item_code % 10 = 0 then cast(cast(quantity + cast(item_code % 20 as decimal(9,2)) as decimal(18,2)) as varchar(30)) else null end as final_value,
               item_code % 4 = 0 as proven, item_code % 7 = 0 as agree
        from {inv_line}""",
    "runs": """
        select event_id as run_id, user_id as doc_id, ts as created_at, case when event_type = 'error' then 'model error' else null end as error,
               cast(cast(value as decimal(18,2)) * 100 as bigint) as latency_ms
        from {events} where event_type in ('error', 'view', 'signup')""",
    "corrections": """
        select event_id as correction_id, user_id as doc_id, ts as created_at, case when event_type = 'purchase' then 'correct' else 'confirm' end as action,
               cast(cast(value as decimal(18,2)) * 100 as bigint) as time_on_field_ms
        from {events} where event_type in ('click', 'purchase')""",
    # fields with all that a score looks at, and rules that name them
    "readings": """
        select f.doc_id, f.line_index, concat('line_items[', cast(f.line_index as varchar(10)), '].quantity') as field_key, f.k, 'number' as kind,
               case cast(k % 7 as int) when 0 then 'illegible' when 1 then 'partly_legible' when 2 then 'not_present' else 'clear' end as legibility,
               case when k % 7 = 2 and f.doc_id % 2 = 0 then null else f.value end as value, f.is_high_stakes as high_stakes, k % 5 = 0 as required,
               f.proven, k % 3 <> 0 as double_read, f.agree as agreement, case when k % 4 = 1 then null else k % 4 > 0 end as raw_consistent,
               case when k % 9 = 1 then null else k % 9 > 0 end as in_text_layer, case when k % 11 = 1 then null else k % 11 > 0 end as format_ok,
               k % 13 = 0 as unparseable, case when k % 8 > 1 then null else k % 8 = 0 end as code_agrees, k % 24 = 0 as code_filled,
               k % 17 = 0 as zoom_illegible, k % 19 = 0 as repaired, case when k % 6 = 0 then true else null end as master_match,
               case when k % 10 = 0 then '12' else null end as suggested_value, case when k % 20 = 0 then 'the totals add up' else null end as suggestion_reason,
               k % 15 = 0 as found_on_zoom, cast(d.vendor_id % 12 as bigint) as seen, cast(case when d.vendor_id % 5 > d.vendor_id % 12 then d.vendor_id % 12 else d.vendor_id % 5 end as bigint) as seen_right,
               d.quality_bucket, d.has_handwriting as handwriting, d.languages like '%hindi%' or d.languages like '%tamil%' as indic_script
        from (select *, doc_id * 7 + line_index * 3 as k from {fields}) f join {docs} d on d.doc_id = f.doc_id""",
    "findings": """
        select doc_id, line_index * 10 as ordinal, concat('line_math:', cast(line_index as varchar(10))) as check_id, 'error' as severity,
               case when item_code % 11 = 0 then 'fail' else 'pass' end as status, 'the line does not multiply out' as message, concat('line_items[', cast(line_index as varchar(10)), '].quantity') as field_key from {inv_line}
        union all
        select doc_id, line_index * 10 + 1, concat('hsn:', cast(line_index as varchar(10))), 'warn', 'fail', 'an unusual code', concat('line_items[', cast(line_index as varchar(10)), '].quantity') from {inv_line} where item_code % 31 = 0
        union all
        select doc_id, line_index * 10 + 2, concat('format:', cast(line_index as varchar(10))), 'error', 'fail', 'misread', concat('line_items[', cast(line_index as varchar(10)), '].quantity') from {inv_line} where item_code % 53 = 0
        union all
        select doc_id, line_index * 10 + 3, concat('qr:', cast(line_index as varchar(10))), 'error', 'fail', 'the signed code differs', concat('line_items[', cast(line_index as varchar(10)), '].quantity') from {inv_line} where item_code % 97 = 0
        union all
        select doc_id, line_index * 10 + 4, concat('line_tax:', cast(line_index as varchar(10))), 'error', 'pass', 'fits', concat('line_items[', cast(line_index as varchar(10)), '].quantity') from {inv_line} where item_code % 2 = 0""",
    # what is known of a document on arrival, of a first look at it, and of its reading
    "intake": """
        select doc_id, tenant_id, created_at, case when tenant_id % 3 = 0 and doc_id % 10 <> 0 then 'invoice' else doc_type end as filed_type,
               case when doc_id % 5 = 0 then coalesce(doc_type, 'memo') end as declared_type,
               case cast(doc_id % 8 as int) when 1 then 'einvoice_qr' when 2 then 'barcode' end as code_source,
               case when doc_id % 7 = 3 then doc_type end as text_type,
               case cast(doc_id % 11 as int) when 2 then 'grn' when 3 then 'letter' end as type_hint,
               cast(case when doc_id % 3 = 0 then 1 else 1 + doc_id % 17 end as int) as pages,
               case when doc_id % 13 = 0 then doc_id - 1 end as parent_id,
               quality_bucket, coalesce(quality_bucket = 'digital', false) as is_digital,
               cast(case when doc_id % 16 = 0 then 2 when doc_id % 16 = 4 then 1 end as int) as local_groups,
               doc_id % 9 <> 4 as looked, case cast(doc_id % 6 as int) when 0 then 'po' when 1 then 'letter' when 2 then 'contract' when 3 then null else 'lr' end as look_type,
               case when doc_id % 4 = 1 then 'tamil' when doc_id % 4 = 2 then 'other' else 'english' end as look_language, doc_id % 14 = 5 as look_handwriting,
               cast(case when doc_id % 3 = 1 then 2 else 1 end as int) as look_groups,
               cast(case when doc_id % 19 = 0 then 40 when doc_id % 19 = 1 then 1 else 0 end as int) as unreadable_pages, doc_id % 29 = 0 as indic_text,
               case cast(doc_id % 9 as int) when 0 then null when 1 then 'po' when 2 then 'letter' when 3 then 'invoice' else doc_type end as observed_type,
               languages, has_handwriting, case when doc_id % 31 = 0 then 'illegible' else 'clear' end as legibility, cast(doc_id % 4 as int) as targets
        from {docs}""",
    # nine fields a line, three of the first line's in the header, for limits by document
    "cells": """
        select f.doc_id, cast(f.line_index * 9 + n.i as int) as place, case when f.line_index = 0 and n.i < 3 then null else f.line_index end as line_index,
               case when (f.k + n.i) % 6 = 1 then null else f.value end as value,
               case cast((f.k * 3 + n.i) % 5 as int) when 0 then 'illegible' when 1 then 'partly_legible' when 2 then 'not_present' when 3 then null else 'clear' end as legibility,
               (f.k + n.i * n.i) % 4 = 0 as is_high_stakes, f.doc_id % 3 = 0 as hard, case when (f.k + n.i) % 7 < 2 then null else (f.k + n.i) % 7 > 3 end as raw_consistent,
               (f.k + n.i) % 11 = 0 as unparseable, (f.k + n.i) % 5 = 2 as proven, case when n.i = 7 then true end as code_filled
        from {readings} f join (select 0 as i union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7 union all select 8) n on n.i >= 0""",
    # long documents: the lines of many orders under one id
    "long_line": """
        select doc_id - doc_id % 256 as doc_id, cast(row_number() over (partition by doc_id - doc_id % 256 order by doc_id, line_index) - 1 as int) as line_index,
               item_code, quantity, rate, taxable_value, gst_rate, rate_per, case when discount = 0 then null else discount end as discount
        from {inv_line}""",
    # finished documents with what an evaluation counts of them
    "evaluated": """
        select d.doc_id, d.doc_type, coalesce(d.quality_bucket, 'unknown') as bucket, case when d.doc_id % 23 = 0 then 'unreadable' when d.status = 'exported' then 'ready' else d.status end as status,
               coalesce(t.fields, 0) as fields, coalesce(t.auto, 0) as auto, coalesce(t.wrong, 0) as wrong, coalesce(t.fields, 0) - coalesce(t.wrong, 0) as correct, coalesce(t.auto_wrong, 0) as auto_wrong,
               coalesce(t.wrong_flagged, 0) as wrong_flagged, cast(d.processing_ms * cast(0.001 as decimal(4,3)) as decimal(18,3)) as seconds, cast(d.doc_id % 400 as decimal(9,4)) * cast(0.0001 as decimal(5,4)) as cost,
               d.quality_bucket is null and d.doc_id % 50 = 0 as synthetic, case when d.doc_id % 211 = 0 then 1 else 0 end as traps, case when d.doc_id % 37 = 0 then 'other' else d.doc_type end as type_got
        from {docs} d left join (select doc_id, count(*) as fields, count(case when not needs_review then 1 end) as auto, count(case when status = 'corrected' then 1 end) as wrong,
               count(case when status = 'corrected' and not needs_review then 1 end) as auto_wrong, count(case when status = 'corrected' and needs_review then 1 end) as wrong_flagged from {fields} group by doc_id) t on t.doc_id = d.doc_id
        where d.doc_type is not null""",
    # the numbers of lines, each with what might prove it
    "proofs": """
        select doc_id, line_index, field_name, concat('line_items[', cast(line_index as varchar(10)), '].', field_name) as field_key, kind, value, tax_amount, item_code,
               case when k % 6 = 0 then '' when k % 6 = 1 then null else concat('₹ ', cast(value as varchar(30))) end as raw,
               case when value is not null then 'clear' when k % 2 = 0 then 'not_present' else 'illegible' end as legibility,
               case when k % 5 = 0 then true when k % 5 = 1 then false end as code_agrees, case when k % 4 < 2 then true when k % 4 = 2 then false end as in_text_layer, case when k % 9 = 0 then true end as master_match
        from (select l.doc_id, l.line_index, n.field_name, n.kind, l.item_code + n.i as k, l.item_code, l.tax_amount,
                     case n.i when 0 then l.quantity when 1 then l.rate when 2 then case when l.discount = 0 then null else l.discount end when 3 then l.taxable_value else cast(l.gst_rate as decimal(18,2)) end as value
              from {inv_line} l join (select 0 as i, 'quantity' as field_name, 'number' as kind union all select 1, 'rate', 'number' union all select 2, 'discount', 'number' union all select 3, 'taxable_value', 'number' union all select 4, 'gst_rate', 'percent') n on n.i >= 0)""",
    # where fields stood on documents of a vendor
    "marks": """
        select f.doc_id, d.tenant_id, d.vendor_id % 7 as vendor_id, concat('f', cast(f.k % 5 as varchar(3))) as field_name, case when f.line_index >= 4 then f.line_index end as line_index, 'string' as kind, f.status,
               case when f.k % 13 = 0 then null else concat('INV-', cast(f.k % 1000 as varchar(5))) end as value, cast(case when f.k % 17 = 0 then null else 1 + f.k % 2 end as int) as page,
               cast(f.k % 5 * 15 + f.k % 7 as decimal(9,2)) * cast(0.01 as decimal(3,2)) as x0, cast(f.k % 5 * 15 + f.k % 7 + 10 as decimal(9,2)) * cast(0.01 as decimal(3,2)) as x1,
               cast(case when f.k % 5 = 4 then f.k % 90 else f.k % 11 end as decimal(9,2)) * cast(0.01 as decimal(3,2)) as y0, cast(case when f.k % 5 = 4 then f.k % 90 else f.k % 11 end + 4 as decimal(9,2)) * cast(0.01 as decimal(3,2)) as y1
        from (select *, doc_id + line_index * 3 as k from {fields}) f join {docs} d on d.doc_id = f.doc_id""",
    # readings as text, in the forms that documents print
    "prints": """
        select doc_id, line_index,
               case cast(item_code % 12 as int) when 0 then concat('₹ ', cast(quantity as varchar(30)), '/-') when 1 then concat('(', cast(rate as varchar(30)), ')')
                    when 2 then concat('Rs. 1,23,', lpad(cast(item_code % 1000 as varchar(10)), 3, '0'), '.50') when 3 then 'nil'
                    when 4 then translate(cast(rate as varchar(30)), '0123456789', '०१२३४५६७८९') when 5 then concat('-', cast(quantity as varchar(30)))
                    when 6 then concat(cast(rate as varchar(30)), ' only') when 7 then concat(cast(rate as varchar(30)), '-') when 8 then 'abc'
                    when 9 then concat('INR', cast(item_code as varchar(30))) when 10 then '.5' else '' end as amount,
               case cast(item_code % 5 as int) when 0 then '9% + 9%' when 1 then '18 %' when 2 then '2.5+2.5' when 3 then concat(cast(item_code % 29 as varchar(5)), '%') else 'x + 1' end as percent_text,
               case cast(item_code % 7 as int) when 0 then concat('2025-', cast(item_code % 14 as varchar(2)), '-05') when 1 then concat(cast(item_code % 33 as varchar(2)), '/06/2025')
                    when 2 then concat(cast(item_code % 31 as varchar(2)), '-3-25') when 3 then concat(cast(item_code % 30 as varchar(2)), ' Jun 2025')
                    when 4 then concat('March ', cast(item_code % 32 as varchar(2)), ', 2024') when 5 then concat(cast(item_code % 29 as varchar(2)), ' जून 2025') else 'soon' end as date_text,
               concat(case when item_code % 2 = 0 then 'mh' else '2x' end, ' 12-', 'ab/', lpad(cast(item_code % 10000 as varchar(5)), 4, '0')) as code_text,
               item_code
        from {inv_line}""",
    # 14 characters of an identifier and a last one that is right for some
    "tax_ids": """
        select s_suppkey as supplier_id, concat(lpad(cast(s_suppkey % 45 as varchar(2)), 2, '0'), 'ABCD', substring('EFGHIJKLMNOPQRSTUVWXYZ', cast(s_suppkey % 22 as int) + 1, 1),
               lpad(cast(s_suppkey * 37 % 10000 as varchar(4)), 4, '0'), substring('KLMNOPQRST', cast(s_suppkey % 10 as int) + 1, 1), case when s_suppkey % 13 = 0 then '0' else '1' end, 'Z') as first14,
               substring('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(s_suppkey % 36 as int) + 1, 1) as last1
        from {supplier}""",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in RAW:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = ADAPTERS[name]
    return spark.sql(text, **{x: load(spark, sf_dir, x) for x in dict.fromkeys(re.findall(r"\{(\w+)\}", text))})


def needed(name: str) -> list[str]:
    """The adapters that ``name`` reads, itself last."""
    found: list[str] = []
    for x in re.findall(r"\{(\w+)\}", ADAPTERS[name]):
        if x in ADAPTERS:
            found += needed(x)
    return list(dict.fromkeys([*found, name]))


def with_clause(*names: str) -> str:
    every = list(dict.fromkeys(x for n in names for x in needed(n)))
    return "with " + ",\n".join(f"{n} as ({re.sub(r'[{](\w+)[}]', r'\1', ADAPTERS[n])})" for n in every)
