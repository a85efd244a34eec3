"""Which way a document takes: its type, whether it is looked at first or split, and who reads it how.

Every decision is an ordered table of (condition, value): the first condition that holds decides, null counting as
false. ``decided`` compiles a table to one CASE, and all tables of a step to one projection, so a whole step is row
expressions over documents; only the habit of a tenant (``usual_type``) needs a grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Types that are read, and the most pages of each (fixed values).
PAGES = {"invoice": 12, "lr": 12, "po": 12, "grn": 12, "contract": 40}
#: Languages that are as easy to read as none (fixed values).
EASY = ("english", "other")
#: Longest edge of a page image by its quality, and for all others (fixed values).
EDGES, EDGE = {"digital": 1800, "good_scan": 2200}, 2576
#: A tenant's habit: how many recent documents count, how many are needed, and the share of one type (fixed values).
RECENT, LEAST_DOCS, LEAST_SHARE = 200, 20, "0.85"
#: Digital documents of so many pages need no look at first (fixed value).
SHORT = 4


def decided(table: list[tuple[Column, Column | str | int | bool | None]], otherwise: Column | str | int | bool | None = None) -> Column:
    """The value of the first condition that holds."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = None
    for condition, value in table:
        out = F.when(condition, lit(value)) if out is None else out.when(condition, lit(value))
    return out.otherwise(lit(otherwise))


def known(kind: Column) -> Column:
    return F.coalesce(kind.isin(*PAGES), F.lit(False))


def holds(flag: Column | str) -> Column:
    return F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False))


def usual_type(docs: DataFrame) -> DataFrame:
    """tenant_id, usual_type: the type of most of a tenant's last ``RECENT`` documents (doc_id, tenant_id, doc_type, created_at) that
    have one, if these are enough and it has its share; of equally many the one met most recently. The newest of each
    group of rows are found before they meet by tenant, so a large tenant is not one task's sort."""
    newest = [F.desc("created_at"), F.desc("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    typed = docs.where("doc_type is not null").select("tenant_id", "doc_id", "doc_type", "created_at", part.alias("part"))
    few = typed.withColumn("turn", F.row_number().over(Window.partitionBy("tenant_id", "part").orderBy(*newest))).where(F.col("turn") <= RECENT)
    recent = few.withColumn("turn", F.row_number().over(Window.partitionBy("tenant_id").orderBy(*newest))).where(F.col("turn") <= RECENT)
    counts = recent.groupBy("tenant_id", "doc_type").agg(F.count("*").alias("n"), F.min("turn").alias("first"))
    top = counts.groupBy("tenant_id").agg(F.max_by("doc_type", F.struct("n", -F.col("first"))).alias("usual_type"), F.max("n").alias("most"), F.sum("n").alias("seen"))
    safe = known(F.col("usual_type")) & (F.col("seen") >= LEAST_DOCS) & (F.col("most") >= F.col("seen") * F.lit(LEAST_SHARE).cast("decimal(4,2)"))
    return top.where(safe).select("tenant_id", "usual_type", "seen", "most")


def before_reading(docs: DataFrame) -> DataFrame:
    """``docs`` with what is decided before a page is read.

    Needs: declared_type, code_source (of a code on the first pages), text_type (of the text layer), type_hint, usual_type,
    pages, parent_id, is_digital, local_groups (number of documents that the text layer tells apart, null if it cannot), triage
    (struct document_type, languages, handwriting_present, groups; null if there was no look or it failed), quality_bucket,
    unreadable_pages, indic_text.

    Adds: free_type, guessed, needs_triage, parts, doc_type, pages_read, hard, model, effort, edge, outcome (split,
    needs_human, unreadable or read)."""
    col, triage = F.col, F.col("triage")
    free = decided([(known(col("declared_type")), col("declared_type")), (col("code_source") == "einvoice_qr", "invoice"), (known(col("text_type")), col("text_type")), (known(col("type_hint")), col("type_hint"))], F.lit(None).cast("string"))
    rows = docs.withColumn("free_type", free).withColumn("multi", (col("pages") > 1) & col("parent_id").isNull())
    rows = rows.withColumn("guessed", F.when(col("free_type").isNull() & ~col("multi"), col("usual_type")))
    local = F.when(col("multi") & holds("is_digital"), col("local_groups"))
    batch = col("multi") & local.isNull() & ~(holds("is_digital") & (col("pages") <= SHORT))
    nameless = col("free_type").isNull() & col("guessed").isNull()
    rows = rows.withColumns({"local": local, "needs_triage": batch | nameless})
    seen = F.when(col("needs_triage"), triage)  # a look that was not asked for decides nothing
    parts = decided([(col("multi") & seen.isNotNull(), F.coalesce(seen["groups"], F.lit(1))), (col("local").isNotNull(), col("local"))], 1)
    kind = F.coalesce(col("free_type"), seen["document_type"], col("guessed"), F.lit("invoice"))
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PAGES.items() for x in kv]), kind), F.lit(0))
    foreign = F.exists(F.coalesce(seen["languages"], F.array().cast("array<string>")), lambda x: ~x.isin(*EASY))
    hard = holds(col("quality_bucket") == "poor_scan") | (kind == "lr") | holds("indic_text") | holds(seen["handwriting_present"]) | holds(foreign)
    rows = rows.withColumns({"parts": parts, "doc_type": kind, "pages_read": F.least("pages", limit), "hard": hard})
    outcome = [
        ((col("parts") > 1) & col("parent_id").isNull(), "split"),
        (~known(col("doc_type")), "needs_human"),
        ((col("pages_read") > 0) & (col("unreadable_pages") >= col("pages_read")), "unreadable"),
    ]
    return rows.withColumns({
        "model": decided([(col("hard"), "complex")], "clean"),
        "effort": decided([(col("hard"), "high")], "medium"),
        "edge": decided([(col("quality_bucket") == x, n) for x, n in EDGES.items()], EDGE),
        "outcome": decided(outcome, "read"),
    }).drop("local", "multi")


def after_reading(rows: DataFrame) -> DataFrame:
    """``before_reading``'s rows with what follows from the reading: needs observed_type, languages, handwriting, legibility
    and targets (fields to be read again).

    A type that was only inferred gives way to the one observed, and the pages are read again for it; a declared one stays,
    with a remark. Adds: final_type, remark, hard_after, readings (calls to read pages), zooms (0 or 1), and replaces outcome by
    the last one (also needs_human, unreadable)."""
    col = F.col
    reading = col("outcome") == "read"
    declared, differs = known(col("declared_type")), holds(col("observed_type") != col("doc_type"))
    foreign = F.exists(F.coalesce("languages", F.array().cast("array<string>")), lambda x: ~x.isin(*EASY))
    stranger = reading & differs & ~declared & ~known(col("observed_type"))
    again = reading & differs & ~declared & known(col("observed_type"))
    lost = reading & ~stranger & holds(col("legibility") == "illegible")
    remark = decided([(reading & differs & declared & known(col("observed_type")), F.concat(F.lit("uploaded as "), "doc_type", F.lit(", looks like "), "observed_type")), (reading & differs & declared, F.concat(F.lit("uploaded as "), "doc_type", F.lit(", looks like something else")))], F.lit(None).cast("string"))
    return rows.withColumns({
        "final_type": decided([(stranger | (col("outcome") == "needs_human"), None), (again, col("observed_type"))], col("doc_type")),
        "remark": remark,
        "hard_after": col("hard") | (reading & (holds("handwriting") | holds(foreign))),
        "readings": decided([(~reading, 0), (again, 2)], 1),
        "zooms": decided([(reading & ~stranger & (col("targets") > 0), 1)], 0),
        "outcome": decided([(stranger, "needs_human"), (lost, "unreadable")], col("outcome")),
    })
