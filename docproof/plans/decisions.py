"""Queries of routing and of what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docproof.operators import routing
from docproof.plans.registry import query

KNOWN = "('invoice', 'lr', 'po', 'grn', 'contract')"


def routed(intake: DataFrame) -> DataFrame:
    """The intake table with its first look as a struct and the habits of its tenants, through both steps."""
    habits = routing.usual_type(intake.withColumnRenamed("filed_type", "doc_type")).select("tenant_id", "usual_type")
    look = F.struct(F.col("look_type").alias("document_type"), F.array("look_language").alias("languages"), F.col("look_handwriting").alias("handwriting_present"), F.col("look_groups").alias("groups"))
    rows = intake.join(habits, "tenant_id", "left").withColumn("triage", F.when(F.col("looked"), look))
    rows = rows.withColumns({"languages": F.split("languages", ","), "handwriting": F.col("has_handwriting")})
    return routing.after_reading(routing.before_reading(rows))


@query("RT1_routing", "intake", sql=f"""
    , r as (select tenant_id, filed_type, row_number() over (partition by tenant_id order by intake.created_at desc, doc_id desc) as r from intake where filed_type is not null),
    c as (select tenant_id, filed_type, count(*) as n, min(r) as first from r where r <= 200 group by all),
    u as (select tenant_id, max_by(filed_type, struct_pack(n := n, f := -first)) as usual from c group by 1 having sum(n) >= 20 and max(n) >= 0.85 * sum(n)),
    a as (select i.*, u.usual, i.pages > 1 and i.parent_id is null as multi,
                 case when declared_type in {KNOWN} then declared_type when code_source = 'einvoice_qr' then 'invoice' when text_type is not null then text_type when type_hint in {KNOWN} then type_hint end as free
          from intake i left join u on u.tenant_id = i.tenant_id),
    b as (select *, case when free is null and not multi then usual end as guessed, case when multi and is_digital then local_groups end as local from a),
    d as (select *, (multi and local is null and not (is_digital and pages <= 4)) or (free is null and guessed is null) as needs_look from b),
    e as (select *, needs_look and looked as seen from d),
    f as (select *, coalesce(free, case when seen then look_type end, guessed, 'invoice') as kind, case when multi and seen then look_groups when local is not null then local else 1 end as parts from e),
    g as (select *, case when kind = 'contract' then least(pages, 40) when kind in {KNOWN} then least(pages, 12) else 0 end as pages_read,
                 coalesce(quality_bucket = 'poor_scan', false) or kind = 'lr' or indic_text or (seen and (look_handwriting or look_language = 'tamil')) as hard from f),
    h as (select *, case when parts > 1 and parent_id is null then 'split' when kind not in {KNOWN} then 'needs_human' when unreadable_pages >= pages_read then 'unreadable' else 'read' end as first_outcome,
                 declared_type in {KNOWN} and declared_type is not null as declared from g),
    j as (select *, first_outcome = 'read' and observed_type is not null and observed_type <> kind as differs, coalesce(observed_type in {KNOWN}, false) as observed_known from h)
    select doc_id, free as free_type, guessed, needs_look as needs_triage, parts, kind as doc_type, pages_read, hard, case when hard then 'complex' else 'clean' end as model, case when hard then 'high' else 'medium' end as effort,
           case quality_bucket when 'digital' then 1800 when 'good_scan' then 2200 else 2576 end as edge,
           case when differs and not declared and not observed_known then 'needs_human' when first_outcome = 'read' and legibility = 'illegible' then 'unreadable' else first_outcome end as outcome,
           case when first_outcome = 'needs_human' or (differs and not declared and not observed_known) then null when differs and not declared then observed_type else kind end as final_type,
           case when differs and declared then 'uploaded as ' || kind || ', looks like ' || case when observed_known then observed_type else 'something else' end end as remark,
           hard or (first_outcome = 'read' and (has_handwriting or languages like '%hindi%' or languages = 'tamil')) as hard_after,
           case when first_outcome <> 'read' then 0 when differs and not declared and observed_known then 2 else 1 end as readings,
           case when first_outcome = 'read' and not (differs and not declared and not observed_known) and targets > 0 then 1 else 0 end as zooms
    from j""")
def _(intake):
    return routed(intake).select(
        "doc_id", "free_type", "guessed", "needs_triage", "parts", "doc_type", "pages_read", "hard", "model", "effort", "edge", "outcome", "final_type", "remark", "hard_after", "readings", "zooms"
    )


