"""Company and vendor knowledge, duplicates, access, queues, reviews, exports and the audit chain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docproof.functions.gst import gstin_problem
from docproof.functions.normalize import clean_code, normalise, safe_cell, shape_mask
from docproof.functions.text import ratio
from docproof.settings import DEFAULTS, Settings


#: Weights of the words that tell a document's type (fixed values).
VOTES = {
    "invoice": {"tax invoice": 5, "bill of supply": 5, "invoice no": 3, "invoice number": 3, "inv no": 2, "invoice date": 2, "e-invoice": 2, "irn": 1, "कर बीजक": 5, "बीजक": 3},
    "lr": {"lorry receipt": 6, "consignment note": 6, "bilty": 5, "builty": 5, "l.r. no": 5, "lr no": 4, "g.r. no": 4, "goods consignment": 4, "consignor": 3, "truck no": 2, "freight": 2, "बिल्टी": 5},
    "po": {"purchase order": 6, "p.o. no": 3, "po number": 3, "po no": 2, "delivery schedule": 2},
    "grn": {"goods receipt note": 6, "goods received note": 6, "grn no": 5, "material inward": 5, "inward note": 4, "accepted qty": 3, "rejected qty": 3, "mrn": 2},
    "contract": {"this agreement": 4, "hereinafter": 4, "witnesseth": 4, "rate contract": 5, "whereas": 3, "agreement": 2, "effective date": 2},
}


def hmac_sha256(text: Column, key: str) -> Column:
    """HMAC-SHA256 in hexadecimal, from two plain digests over padded keys."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in raw))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(text, "utf-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def pseudonym(value: Column | str, key: str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.substring(hmac_sha256(F.upper(F.trim(value)), key), 1, 32)


def dedupe_key(kind: Column | str, issuer: Column | str, number: Column | str) -> Column:
    kind, issuer, number = (F.col(x) if isinstance(x, str) else x for x in (kind, issuer, number))
    return F.when((issuer != "") & (number != ""), F.concat_ws("|", kind, clean_code(issuer), clean_code(number)))


def keyed_dedupe(kind: Column | str, issuer: Column | str, number: Column | str, key: str) -> Column:
    """``dedupe_key`` as a pseudonym: equal for equal documents, and telling nothing of issuer or number."""
    return pseudonym(dedupe_key(kind, issuer, number), key)


def same_content(docs: DataFrame, arrived: DataFrame) -> DataFrame:
    """``arrived`` (doc_id, tenant_id, content_sha256) with same_as: the first document of the tenant (by created_at, doc_id) that holds the very
    bytes, itself apart, and already_uploaded. The flag informs; nothing is refused."""
    first = docs.groupBy("tenant_id", "content_sha256").agg(F.min(F.struct("created_at", "doc_id")).alias("first"))
    rows = arrived.join(first.select("tenant_id", "content_sha256", F.col("first.doc_id").alias("first_doc")), ["tenant_id", "content_sha256"], "left")
    same = F.when(F.col("first_doc") != F.col("doc_id"), F.col("first_doc"))
    return rows.select("doc_id", "tenant_id", same.alias("same_as"), same.isNotNull().alias("already_uploaded"))


def active_template(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, template_id, hints: the newest active template of each document's tenant, vendor and type, or nulls."""
    keys = ["tenant_id", "vendor_key", "doc_type"]
    newest = templates.where("status = 'active'").groupBy(*keys).agg(F.max_by(F.struct("template_id", "hints"), F.struct("created_at", "template_id")).alias("t"))
    return docs.join(newest, keys, "left").select("doc_id", "t.template_id", "t.hints")


def export_table(docs: DataFrame, fields: DataFrame, spec: DataFrame, rename: dict[str, str] | None = None, day: str = "dd-MM-yyyy", lines: bool = True) -> DataFrame:
    """Documents of one type as the table that accounting systems take: Document ID, Status, a column for each field of the
    header under its label or the profile's name, and with ``lines`` Line no. and the columns of lines (profile names "line.<field>");
    a row a line, or one for a document without. Cells are text, dates as the profile writes them, missing ones empty.

    docs: doc_id, reviewed_at; fields: doc_id, line_index, field_name, value; spec: name, label, kind, is_line, place."""
    rename = rename or {}
    shown = sorted(spec.collect(), key=lambda r: r["place"])  # the fields of a type, some dozens
    text = lambda r: F.date_format(F.col("value").try_cast("date"), day) if r["kind"] == "date" else safe_cell(F.col("value"))
    pick = lambda r: F.max(F.when(F.col("field_name") == r["name"], text(r)))
    of = lambda is_line: [r for r in shown if r["is_line"] == is_line]
    head_name = {r["name"]: rename.get(r["name"], r["label"]) for r in of(False)}
    line_name = {r["name"]: rename.get(f"line.{r['name']}", f"Line {r['label']}") for r in of(True)} if lines else {}
    head = fields.where("line_index is null").groupBy("doc_id").agg(F.lit(1).alias("__h"), *[pick(r).alias(head_name[r["name"]]) for r in of(False)])
    rows = docs.select("doc_id", F.when(F.col("reviewed_at").isNotNull(), "Reviewed").otherwise("Auto-verified").alias("Status")).join(head, "doc_id", "left")
    if lines:
        body = fields.where("line_index is not null").groupBy("doc_id", "line_index").agg(F.lit(1).alias("__l"), *[pick(r).alias(line_name[r["name"]]) for r in of(True)])
        rows = rows.join(body.withColumn("Line no.", (F.col("line_index") + 1).cast("string")), "doc_id", "left")
    every = ["Status", *head_name.values(), *(["Line no.", *line_name.values()] if lines else [])]
    return rows.select(F.col("doc_id").alias("Document ID"), *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in every])


def duplicates(docs: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """Documents whose key an earlier one of the tenant has; the first (created_at, doc_id) wins. Keys are reduced before they
    join back, so a key that many documents share is one row on its side."""
    live = docs.where(F.col(key).isNotNull() & (F.col("status") != "failed"))
    first = live.groupBy("tenant_id", key).agg(F.min(F.struct("created_at", "doc_id")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    found = live.join(first, ["tenant_id", key])
    return found.select("doc_id", F.col("first.doc_id").alias("first_doc_id"), "copies", (F.col("doc_id") == F.col("first.doc_id")).alias("wins"))


def vendor_profiles(docs: DataFrame) -> DataFrame:
    """Per tenant and vendor: documents, latest reviewed (else first) name, bank account as last reviewed, the usual shape of numbers."""
    at = F.struct("created_at", "doc_id")
    seen = F.col("reviewed_at").isNotNull()
    base = docs.groupBy("tenant_id", "vendor_id").agg(
        F.count(F.lit(1)).alias("docs"),
        F.coalesce(F.max_by(F.when(seen, F.col("name")), F.when(seen, at)), F.min_by("name", at)).alias("name"),
        F.max_by(F.when(seen, clean_code("bank_account")), F.when(seen, at)).alias("bank_account"),
    )
    masks = docs.groupBy("tenant_id", "vendor_id", shape_mask("number").alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    usual = masks.groupBy("tenant_id", "vendor_id").agg(F.max_by("mask", F.struct("n", "mask")).alias("usual_mask"), F.sum("n").alias("numbers"))
    return base.join(usual, ["tenant_id", "vendor_id"], "left")


def vendor_checks(docs: DataFrame, history: DataFrame, least_ratio: float = 80.0, least_numbers: int = 3) -> DataFrame:
    """Invoices (doc_id, tenant_id, vendor_id, name, bank_account, number) against their vendor's earlier ones: another name, another
    bank account, a number in a form not seen before. Rows (doc_id, check_id, severity) of what fails.

    A vendor's history is one row, and its number forms meet by equality, so a vendor with a third of all invoices adds
    rows on the left side alone."""
    key = ["tenant_id", "vendor_id"]
    profile = vendor_profiles(history).select(*key, F.col("name").alias("__name"), F.col("bank_account").alias("__account"), "numbers")
    forms = history.select(*key, shape_mask("number").alias("mask")).distinct().withColumn("__seen", F.lit(True))
    rows = docs.withColumn("mask", shape_mask("number")).join(profile, key).join(forms, [*key, "mask"], "left")
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    account = clean_code("bank_account")
    failing = lambda name, severity, when: F.when(when, F.struct(F.lit(name).alias("check_id"), F.lit(severity).alias("severity")))
    renamed = (F.col("name") != "") & (F.col("__name") != "") & (ratio(bare("__name"), bare("name")) < least_ratio)
    moved = (account != "") & (F.col("__account") != "") & (account != F.col("__account"))
    odd = (F.col("number") != "") & (F.col("numbers") >= least_numbers) & F.col("__seen").isNull()
    found = [failing("vendor_name", "warn", renamed), failing("vendor_bank_changed", "error", moved), failing("invoice_number_format", "warn", odd)]
    return rows.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("c")).select("doc_id", "c.*")


def own_numbers(seen: DataFrame, stated: DataFrame, least: int = 3) -> DataFrame:
    """A tenant's own identifiers: those stated, and those that ``least`` reviewed documents were billed to."""
    learned = seen.groupBy("tenant_id", "gstin").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("tenant_id", "gstin")
    return stated.select("tenant_id", clean_code("gstin").alias("gstin")).unionByName(learned).distinct()


def visible(docs: DataFrame, role: str, tenant: int | None = None, user: int | None = None) -> DataFrame:
    """Row-level security: what a role may see."""
    mine = F.col("tenant_id") == F.lit(tenant)
    rules = {"admin": mine, "manager": mine, "reviewer": mine & (F.col("assigned_to") == F.lit(user)), "uploader": mine & (F.col("uploaded_by") == F.lit(user)), "staff_reviewer": F.col("assigned_to") == F.lit(user)}
    return docs.where(rules.get(role, F.lit(False)))


def review_queue(docs: DataFrame, most: int = 300, s: Settings = DEFAULTS) -> DataFrame:
    """Open documents, pure spot checks last, then by what is due first."""
    open_ = docs.where(F.col("status").isin("needs_review", "unreadable") & F.col("reviewed_at").isNull())
    pure = F.col("is_qa_sample") & (F.col("fields_flagged") == 0)
    overdue = F.coalesce(F.col("review_due_at") < F.lit(s.as_of).cast("timestamp_ntz"), F.lit(False))
    return open_.withColumns({"spot_only": pure, "overdue": overdue}).orderBy("spot_only", F.asc_nulls_last("review_due_at"), "doc_id").limit(most)


def pick_reviewers(users: DataFrame, docs: DataFrame) -> DataFrame:
    """Each tenant's reviewer with the least open load; ties go to the earliest account."""
    load = docs.where("status = 'needs_review' and reviewed_at is null").groupBy(F.col("assigned_to").alias("user_id")).agg(F.count(F.lit(1)).alias("load"))
    order = Window.partitionBy("tenant_id").orderBy(F.coalesce("load", F.lit(0)), "created_rank", "user_id")
    return users.join(load, "user_id", "left").withColumn("turn", F.row_number().over(order)).where("turn = 1").select("tenant_id", "user_id", F.coalesce("load", F.lit(0)).alias("load"))


def effective_value() -> Column:
    return F.when(F.col("status") == "corrected", F.col("final_value")).otherwise(F.col("value"))


def apply_actions(fields: DataFrame, actions: DataFrame) -> DataFrame:
    """Fields after the log of review actions: the last action decides; a confirmed correction stays corrected."""
    at = F.struct("created_at", "correction_id")
    last = actions.groupBy("doc_id").agg(F.max_by("action", at).alias("action"), F.max(F.when(F.col("action") == "correct", 1).otherwise(0)).alias("ever"))
    status = F.when(F.col("action").isNull(), F.col("status")).when((F.col("ever") == 1) | (F.col("status") == "corrected"), "corrected").otherwise("confirmed")
    return fields.join(last, "doc_id", "left").withColumn("status", status).drop("action", "ever")


def act_on_fields(fields: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields, rejected actions) after the log of actions on single fields, known by doc_id, line_index and field_name.

    A confirmation keeps the value that holds; a correction sets ``final_value`` to its own, normalised by the field's
    ``kind``, where an empty one means that the field is absent. Corrections that are no value of the kind are rejected and
    change nothing. The last correction holds; once corrected, a field stays so."""
    key = ["doc_id", "line_index", "field_name"]
    known = actions.join(fields.select(*key, "kind"), key)
    known = known.withColumn("new", normalise("kind", "value"))
    bad = (F.col("action") == "correct") & (F.coalesce("value", F.lit("")) != "") & F.col("new").isNull() | ~F.col("action").isin("confirm", "correct")
    at = F.when(F.col("action") == "correct", F.struct("created_at", "correction_id"))
    last = known.where(~bad).groupBy(*key).agg(F.max(F.col("action") == "correct").alias("ever"), F.max_by("new", at).alias("new"))
    status = F.when(F.col("ever").isNull(), F.col("status")).when(F.col("ever") | (F.col("status") == "corrected"), "corrected").otherwise("confirmed")
    value = F.when(F.col("ever"), F.col("new")).otherwise(F.col("final_value"))
    done = fields.join(last, key, "left").withColumn("status", status).withColumn("final_value", value).drop("ever", "new")
    return done, known.where(bad).select(*actions.columns)


def ready_to_complete(fields: DataFrame) -> DataFrame:
    """doc_id, pending (flagged fields that nobody acted on), ready (none is left)."""
    pending = F.count_if(F.col("needs_review") & ~F.coalesce(F.col("status").isin("confirmed", "corrected"), F.lit(False)))
    return fields.groupBy("doc_id").agg(pending.alias("pending"), (pending == 0).alias("ready"))


def retention_due(docs: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Documents whose file must go: not purged, and expired or older than the cap."""
    now = F.lit(s.as_of).cast("timestamp_ntz")
    old = F.col("created_at") <= now - F.expr(f"interval {s.retention_cap_hours} hours")
    return docs.where(F.col("blob_purged_at").isNull() & (F.coalesce(F.col("blob_expires_at") <= now, F.lit(False)) | old))


def shortened(expiry: Column | str, s: Settings = DEFAULTS) -> Column:
    now = F.lit(s.as_of).cast("timestamp_ntz")
    return F.least(F.coalesce(expiry, now), now + F.expr(f"interval {s.retention_grace_hours} hours"))


def review_expiry(created: Column | str, expires: Column | str, due: Column | str, s: Settings = DEFAULTS) -> Column:
    """Until when a document in review is kept: two days past its due time if that is later, but never past the cap."""
    created, expires, due = (F.col(x) if isinstance(x, str) else x for x in (created, expires, due))
    cap = created + F.expr(f"interval '{s.retention_cap_hours}' hour")
    return F.least(cap, F.greatest(F.coalesce(expires, cap), due + F.expr("interval '48' hour")))


def fail_processing(docs: DataFrame, failed: DataFrame) -> DataFrame:
    """``docs`` after the jobs of ``failed`` (doc_id) gave up: only documents still in processing become failed."""
    gone = failed.select(F.col("doc_id").alias("__failed")).distinct()
    status = F.when(F.col("__failed").isNotNull() & (F.col("status") == "processing"), "failed").otherwise(F.col("status"))
    return docs.join(gone, docs["doc_id"] == gone["__failed"], "left").withColumn("status", status).drop("__failed")


def retry(docs: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with the failed ones among ``asked`` (doc_id) back to uploaded, and for each document asked for (known ones,
    once) whether it was accepted: only failed ones are."""
    wanted = asked.select(F.col("doc_id").alias("__asked")).distinct()
    both = docs.join(wanted, docs["doc_id"] == wanted["__asked"], "left")
    accepted = F.col("__asked").isNotNull() & F.coalesce(F.col("status") == "failed", F.lit(False))
    answers = both.where("__asked is not null").select("doc_id", accepted.alias("accepted"))
    return both.withColumn("status", F.when(accepted, "uploaded").otherwise(F.col("status"))).drop("__asked"), answers


def page_edge(edge: Column, pages: Column) -> Column:
    """The longest side, in pixels, at which pages are sent: smaller for long documents."""
    return F.when(pages <= 6, edge).otherwise(F.least(edge, F.when(pages <= 15, 1800).otherwise(1400)))


def export_rows(headers: DataFrame, lines: DataFrame, header_columns: list[str], line_columns: list[str]) -> DataFrame:
    """A row a line with its header repeated, and one for documents without lines; cells as text."""
    head = headers.select("doc_id", *[_cell(headers, c).alias(c) for c in header_columns])
    body = lines.select("doc_id", (F.col("line_index") + 1).cast("string").alias("line_no"), *[_cell(lines, c).alias(f"line_{c}") for c in line_columns])
    rows = head.join(body, "doc_id", "left")
    return rows.select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns if c != "doc_id"])


def _cell(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.simpleString()
    return F.date_format(name, "dd-MM-yyyy") if kind == "date" else safe_cell(F.col(name)) if kind == "string" else F.col(name).cast("string")


def broken_links(log: DataFrame, shards: int | None = None) -> DataFrame:
    """Where a hash chain (seq, body, prev_hash, hash) breaks: a row's own digest, or its link to the row before. Neighbours meet by
    an equi-join on the sequence number, so that the whole log is never sorted in one task."""
    before = log.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("before"))
    own = F.col("hash") == F.sha2(F.concat(F.col("prev_hash"), F.col("body")), 256)
    linked = F.col("prev_hash") == F.coalesce("before", F.lit(""))
    return log.join(before, "seq", "left").where(~(own & linked)).select("seq", own.alias("own"), linked.alias("linked"))


def classify(text: Column | str) -> Column:
    """The document's type by weighted keywords, twice in the first 400 characters; null if unsure."""
    text = F.regexp_replace(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), r"\s+", " ")
    head = F.substring(text, 1, 400)
    one = lambda where, word, weight: F.when(where.contains(word), weight).otherwise(0)
    total = lambda words: reduce(lambda a, b: a + b, [one(text, w, n) + one(head, w, n) for w, n in words.items()])
    ranked = F.sort_array(F.array(*[F.struct(total(words).alias("votes"), F.lit(-i).alias("turn"), F.lit(kind).alias("kind")) for i, (kind, words) in enumerate(VOTES.items())]), asc=False)
    top, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    sure = (F.length(text) >= 40) & (top["votes"] >= 5) & (top["votes"] * 10 >= F.greatest(second["votes"], F.lit(1)) * 16)
    return F.when(sure, top["kind"])


def page_groups(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_no, number) with their group: a page with another number than the last one known starts a new one."""
    order = Window.partitionBy("doc_id").orderBy("page_no")
    last = F.last("number", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce((F.col("number") != last).cast("int"), F.lit(0))
    return pages.withColumn("starts", starts).withColumn("group", F.sum("starts").over(order) + 1).drop("starts")


def masks_of_region(x: Column | str, y: Column | str) -> Column:
    """Where on a page: top, middle or bottom, and left, centre or right."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    word = lambda v, a, b, c: F.when(v < 0.33, a).when(v < 0.66, b).otherwise(c)
    return F.concat_ws(" ", word(y, "top", "middle", "bottom"), word(x, "left", "centre", "right"))


def quality_bucket(digital: Column, sharp: Column, contrast: Column, char_height: Column, skew: Column) -> Column:
    """digital; good when sharp, contrasty, large enough and straight; else poor."""
    good = (sharp >= 100) & (contrast >= 0.35) & (char_height >= 12) & (F.abs(skew) < 3)
    return F.when(digital, "digital").when(good, "good_scan").otherwise("poor_scan")


def append_chain(log: DataFrame, by: str = "tenant_id") -> DataFrame:
    """Hashes of a new log (seq, body), each over the one before. An append is sequential by nature: one chain for each ``by``, so
    that tasks share the work; a chain's rows are folded in their order."""
    import hashlib
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, last = None, ""
        for batch in batches:
            before, own = [], []
            for key, body in zip(batch[by], batch["body"], strict=True):
                last = "" if key != chain else last
                before.append(last)
                chain, last = key, hashlib.sha256((last + body).encode()).hexdigest()
                own.append(last)
            yield batch.assign(prev_hash=before, hash=own)

    kind = log.schema[by].dataType.simpleString()
    rows = log.select(by, "seq", "body").repartition(by).sortWithinPartitions(by, "seq")
    return rows.mapInPandas(run, f"{by} {kind}, seq long, body string, prev_hash string, hash string")


def safe_meta(x: Column | str) -> Column:
    """Audit details that hold no personal data: a short word of plain characters."""
    return F.rlike(x, F.lit(r"^[A-Za-z0-9_.:\-/]{0,80}$"))


def blank_fields(docs: DataFrame, spec: DataFrame) -> DataFrame:
    """A pending row for each field of a document's type, for documents that nothing could be read of."""
    return docs.join(F.broadcast(spec), "doc_type").select("doc_id", F.col("name").alias("field_name"), F.lit("pending").alias("status"))


def unreadable_reason(ink: Column, contrast: Column, char_height: Column, sharp: Column) -> Column:
    """Why a page cannot be read: blank, faded, small or blurry; null if it can."""
    return F.when(ink < 0.002, "blank").when(contrast < 0.06, "faded").when(char_height < 5, "small").when(sharp < 1, "blurry")


def can_review(role: Column, tenant: Column, doc_tenant: Column, managed: Column) -> Column:
    """Whether a person may be given a document: of its tenant with review rights, or staff where the tenant's review is managed."""
    return F.when(role == "staff_reviewer", managed).otherwise(role.isin("admin", "manager", "reviewer") & (tenant == doc_tenant))


def distinct_in_order(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """``by`` and the distinct values of ``value`` as an array, each where it first occurs. Repeats go before values are gathered."""
    once = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.min(order).alias("__at"))
    gathered = F.array_sort(F.collect_list(F.struct("__at", value)))
    return once.groupBy(by).agg(F.transform(gathered, lambda x: x[value]).alias(value))


def stated_numbers(rows: DataFrame) -> DataFrame:
    """tenant_id, gstins, rejected: the tax numbers that a tenant states as its own (tenant_id, gstin), cleaned, sorted, each once, and
    those of them that are none. A tenant's list is taken over only if ``rejected`` is empty; blank ones do not count."""
    clean = rows.where(F.trim("gstin") != "").select("tenant_id", clean_code("gstin").alias("gstin")).distinct()
    checked = clean.withColumn("bad", gstin_problem("gstin").isNotNull())
    kept = lambda bad: F.array_sort(F.collect_list(F.when(bad, F.col("gstin"))))
    return checked.groupBy("tenant_id").agg(kept(~F.col("bad")).alias("gstins"), kept(F.col("bad")).alias("rejected"))
