"""Who may do what, what a person sees of documents and fields, exports, templates and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docproof.operators.records import effective_value
from docproof.settings import DEFAULTS, Settings

#: Roles that hold each permission (fixed values).
PERMISSIONS = {
    "document.upload": ("admin", "manager", "uploader"),
    "document.view_all": ("admin", "manager"),
    "document.view_assigned": ("reviewer", "staff_reviewer", "admin", "manager"),
    "document.view_own_uploads": ("uploader",),
    "review.work": ("reviewer", "staff_reviewer", "admin", "manager"),
    "review.assign": ("admin", "manager"),
    "dashboard.view": ("admin", "manager"),
    "export.run": ("admin", "manager"),
    "match.run": ("admin", "manager"),
    "template.manage": ("admin", "manager"),
    "user.manage": ("admin",),
    "audit.view": ("admin",),
    "metrics.internal": ("staff_ops",),
}
#: Names of types and states as people read them (fixed values).
TYPE_NAMES = {"invoice": "Tax invoice", "lr": "Lorry receipt / GR / bilty", "po": "Purchase order", "grn": "Goods receipt note", "contract": "Contract"}
STATUS_NAMES = {
    "uploaded": "Queued", "processing": "Reading document…", "needs_review": "Needs review", "ready": "Ready to export",
    "unreadable": "Couldn't read", "failed": "Couldn't process", "exported": "Exported", "split": "Split into documents",
}
DONE = ("ready", "exported")
EXTRA_KINDS = ("string", "text", "number", "integer", "date", "percent")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _map(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])


def can(role: Column | str, permission: Column | str) -> Column:
    """Whether a role holds a permission; unknown ones and nulls hold none."""
    held = F.create_map(*[x for p, roles in PERMISSIONS.items() for x in (F.lit(p), F.array(*map(F.lit, roles)))])
    return F.coalesce(F.array_contains(F.try_element_at(held, _c(permission)), _c(role)), F.lit(False))


def may_open(role: Column, user: Column, user_tenant: Column, tenant: Column, assigned_to: Column, uploaded_by: Column) -> Column:
    """Whether a person may see a document. Staff (no tenant) see what is assigned to them, if they review; others see their own
    tenant's: all of it, what is assigned to them, or what they uploaded, by role."""
    mine = F.when(can(role, F.lit("document.view_all")), True).when(role == "reviewer", assigned_to == user).when(role == "uploader", uploaded_by == user)
    staff = (role == "staff_reviewer") & (assigned_to == user)
    return F.coalesce(F.when(user_tenant.isNull(), staff).otherwise((user_tenant == tenant) & mine), F.lit(False))


def document_summary(docs: DataFrame) -> DataFrame:
    """Documents as listed, with the names of their type and state; a state without a name shows itself."""
    kind, state = F.try_element_at(_map(TYPE_NAMES), F.col("doc_type")), F.try_element_at(_map(STATUS_NAMES), F.col("status"))
    plain = [c for c in ("created_at", "processed_at", "review_due_at", "reviewed_at", "assigned_to", "is_qa_sample") if c in docs.columns]
    return docs.select("doc_id", "doc_type", kind.alias("doc_type_label"), "status", F.coalesce(state, "status").alias("status_label"), *plain, F.col("quality_bucket").alias("quality"), F.col("blob_purged_at").isNull().alias("available"))


def field_view(fields: DataFrame) -> DataFrame:
    """Fields as a reviewer sees them: the value that holds beside the one that was read."""
    return fields.select("doc_id", "line_index", F.col("field_name").alias("name"), effective_value().alias("value"), F.col("value").alias("extracted_value"), "needs_review", "status", F.col("is_high_stakes").alias("high_stakes"))


def export_ready(docs: DataFrame, doc_type: str, again: bool = False, s: Settings = DEFAULTS) -> DataFrame:
    """Documents of a type that are ready (with ``again`` also those exported before), as they are after their export. Write
    them in the order of ``created_at`` (``records.export_rows`` makes the rows)."""
    taken = docs.where((F.col("doc_type") == doc_type) & F.col("status").isin(*(DONE if again else DONE[:1])))
    return taken.withColumns({"status": F.lit("exported"), "exported_at": F.lit(s.as_of).cast("timestamp_ntz")})


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header and a byte order mark at the start of each part, so that spreadsheets take it for UTF-8."""
    first, *rest = rows.columns
    rows.select(F.col(first).alias("﻿" + first), *rest).write.csv(path, header=True, encoding="UTF-8", escape='"')


def match_guard(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """match_id, problem of sets (match_id, doc_id, role): not_found, wrong_types (one order and one invoice, receipts else),
    not_ready, or null where the match may run."""
    rows = sets.join(docs.select("doc_id", "doc_type", "status"), "doc_id", "left")
    one = lambda role: F.count_if(F.col("role") == role) == 1
    fits = F.coalesce((F.col("doc_type") == F.col("role")) & F.col("role").isin("po", "grn", "invoice"), F.lit(False))
    lost, typed = F.count_if(F.col("status").isNull()) > 0, one("po") & one("invoice") & (F.count_if(~fits) == 0)
    open_ = F.count_if(~F.coalesce(F.col("status").isin(*DONE), F.lit(False))) > 0
    return rows.groupBy("match_id").agg(F.when(lost, "not_found").when(~typed, "wrong_types").when(open_, "not_ready").alias("problem"))


def audit_feed(log: DataFrame, tenant: int, most: int = 200) -> DataFrame:
    """A tenant's latest audit events, newest first, at most 1,000."""
    return log.where(F.col("tenant_id") == tenant).orderBy(F.desc("seq")).limit(min(most, 1000))


def run_rows(results: DataFrame) -> DataFrame:
    """Runs as they are logged: one that failed has its error and counts no tokens and no time."""
    ok = F.col("error").isNull()
    return results.withColumns({c: F.when(ok, F.col(c)).otherwise(0) for c in ("input_tokens", "output_tokens", "latency_ms")})


def with_extra_fields(spec: DataFrame, extras: DataFrame) -> DataFrame:
    """``spec`` (doc_type, name, label, kind, high_stakes) with a template's own fields (the same columns): names of small
    letters, digits and underscores that the type has not; unknown kinds are plain text, labels are cut at 80 characters
    and default to the name. Of extras of one name the first by label and kind stays, so that names are unique."""
    name = F.lower(F.trim("name"))
    good = extras.withColumn("name", name).where(F.rlike("name", F.lit("^[a-z][a-z0-9_]{1,40}$"))).join(spec.select("doc_type", "name"), ["doc_type", "name"], "left_anti")
    label = F.substring(F.coalesce(F.nullif("label", F.lit("")), F.col("name")), 1, 80)
    kind = F.when(F.col("kind").isin(*EXTRA_KINDS), F.col("kind")).otherwise("string")
    rows = good.select("doc_type", "name", label.alias("label"), kind.alias("kind"), F.coalesce("high_stakes", F.lit(False)).alias("high_stakes"))
    once = rows.groupBy("doc_type", "name").agg(F.min(F.struct("label", "kind", "high_stakes")).alias("x")).select("doc_type", "name", "x.*")
    return spec.select(*once.columns).unionByName(once)


def new_templates(templates: DataFrame, examples: DataFrame, docs: DataFrame, least: int = 3, most: int = 5) -> DataFrame:
    """template_id, vendor_id, problem for templates (template_id, tenant_id, doc_type) over examples (template_id, doc_id):
    wrong_number, not_found, mixed_types, not_reviewed, several_vendors, or null for a good draft. Repeated examples count once."""
    own = docs.select("doc_id", F.col("tenant_id").alias("__tenant"), F.col("doc_type").alias("__type"), "status", "vendor_id")
    rows = templates.join(examples.distinct(), "template_id", "left").join(own, "doc_id", "left")
    known = F.coalesce(F.col("__tenant") == F.col("tenant_id"), F.lit(False))
    n = F.count("doc_id")
    alike = F.coalesce(F.col("__type") == F.col("doc_type"), F.lit(False))
    done = F.coalesce(F.col("status").isin(*DONE), F.lit(False))
    problem = (
        F.when((n < least) | (n > most), "wrong_number").when(F.count_if(~known) > 0, "not_found").when(F.count_if(~alike) > 0, "mixed_types")
        .when(F.count_if(~done) > 0, "not_reviewed").when(F.min("vendor_id") != F.max("vendor_id"), "several_vendors")
    )
    return rows.groupBy("template_id").agg(F.when(problem.isNull(), F.min("vendor_id")).alias("vendor_id"), problem.alias("problem"))


def activate(templates: DataFrame, chosen: DataFrame) -> DataFrame:
    """``templates`` (template_id, tenant_id, vendor_id, doc_type, status) after those of ``chosen`` (template_id) were made
    active: what was active for the same tenant, vendor and type retires. One without a vendor stays as it is; of several
    chosen for the same the one with the largest template_id is active at the end."""
    key = ["tenant_id", "vendor_id", "doc_type"]
    now = templates.join(chosen.distinct(), "template_id", "left_semi").where("vendor_id is not null").groupBy(*key).agg(F.max("template_id").alias("__new"), F.collect_set("template_id").alias("__all"))
    mine = F.col("template_id") == F.col("__new")
    old = F.col("__new").isNotNull() & ((F.col("status") == "active") | F.array_contains("__all", F.col("template_id")))
    return templates.join(now, key, "left").withColumn("status", F.when(mine, "active").when(old, "retired").otherwise(F.col("status"))).drop("__new", "__all")
