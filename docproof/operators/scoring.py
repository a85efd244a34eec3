"""Signals, scores and reasons of fields; suggestions and repairs put to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docproof.functions import gst
from docproof.functions.normalize import fold_digits, normalise
from docproof.operators import evidence
from docproof.settings import DEFAULTS, Settings

#: Priority and words of each reason by its code (fixed values).
REASONS = {
    "missing_required": (1, "Not found on the document"),
    "repaired": (0, "Corrected automatically; please confirm"),
    "disagree": (1, "Two readings differ"),
    "suggestion": (1, "Suggested "),
    "illegible_zoom": (1, "Unreadable even when zoomed in"),
    "unparseable": (1, "Not a valid "),
    "illegible": (1, "Not legible on the document"),
    "partly_legible": (2, "Partly unclear on the document"),
    "raw_inconsistent": (2, "Doesn't match the text as printed"),
    "not_in_text_layer": (2, "Not in the PDF's text"),
}
FOUND_ON_ZOOM = "Found only on the zoomed re-read"
UNPROVEN, ABSENT = "Not proven; please confirm", "Check it isn't on the document"
#: What proved a value, as a reviewer reads it (fixed values).
TAGS = {"arithmetic": "adds up", "text_layer": "in the PDF text", "records": "matches your records"}

#: Columns of a field that may be left out, and what stands for them.
OPTIONAL = {
    "proven": False, "double_read": False, "agreement": None, "raw_consistent": None, "in_text_layer": None, "format_ok": None,
    "code_agrees": None, "code_filled": False, "zoom_illegible": False, "repaired": False, "master_match": None, "unparseable": False,
    "found_on_zoom": False, "required": False, "high_stakes": False, "handwriting": False, "indic_script": False,
}


def _flags(fields: DataFrame) -> dict[str, Column]:
    return {n: F.col(n) if n in fields.columns else F.lit(x).cast("boolean") for n, x in OPTIONAL.items()}


def _sure(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _by_field(checks: DataFrame) -> DataFrame:
    """(doc_id, field_key) with how often rules passed and failed there, and the reasons that failures give. A field is
    named by few rules, so its list is short."""
    keys = checks.select("doc_id", "ordinal", "check_id", "severity", "status", "message", F.explode(F.array_distinct("field_keys")).alias("field_key"))
    failed, error = F.col("status") == "fail", F.col("severity") == "error"
    rank = F.when(~error, 3).when(evidence.family().isin(*evidence.SPECIFIC), -1).otherwise(0)
    code = F.concat(F.when(error, "check:").otherwise("warn:"), "check_id")
    reason = F.struct(rank.alias("rank"), F.col("ordinal").cast("long").alias("turn"), code.alias("code"), F.col("message").alias("words"))
    return keys.groupBy("doc_id", "field_key").agg(
        F.count_if(F.col("status") == "pass").alias("__passed"),
        F.count_if(failed & error & (evidence.family() != "format")).alias("__failed"),
        F.collect_list(F.when(failed, reason)).alias("__reasons"),
    )


def features(fields: DataFrame, checks: DataFrame) -> DataFrame:
    """``fields`` with ``signals`` (a struct of numbers by name), ``doc_failed`` and the failures that concern each.

    ``fields``: doc_id, field_key, line_index (null: header), kind, value, legibility, quality_bucket, history (see
    ``evidence.history_signal``), suggested_value, suggestion_reason, and the flags of ``OPTIONAL`` as far as known.
    ``checks``: doc_id, ordinal, check_id, severity, status, message, field_keys. Null flags say nothing either way."""
    flag = _flags(fields)
    bad = checks.where("status = 'fail' and severity = 'error'").select("doc_id", F.lit(True).alias("doc_failed")).distinct()
    rows = fields.join(_by_field(checks), ["doc_id", "field_key"], "left").join(bad, "doc_id", "left").withColumn("doc_failed", _sure(F.col("doc_failed")))
    value, legible = F.col("value").isNotNull(), F.col("legibility")
    twice = F.least(F.lit(2), F.coalesce("__passed", F.lit(0))), F.least(F.lit(2), F.coalesce("__failed", F.lit(0)))
    x = {
        "legibility_clear": (legible == "clear") & value,
        "absent_optional": ~value & (legible == "not_present") & ~_sure(flag["required"]),
        "legibility_partly": legible == "partly_legible",
        "legibility_illegible": legible == "illegible",
        "proven": flag["proven"],
        "agree": flag["double_read"] & flag["agreement"],
        "disagree": flag["double_read"] & ~flag["agreement"],
        "raw_inconsistent": ~flag["raw_consistent"],
        "raw_consistent": flag["raw_consistent"],
        "in_text_layer": flag["in_text_layer"],
        "not_in_text_layer": ~flag["in_text_layer"],
        "format_ok": flag["format_ok"],
        "format_bad": ~flag["format_ok"],
        "doc_check_failed": F.col("doc_failed"),
        "quality_digital": F.col("quality_bucket") == "digital",
        "quality_poor": F.col("quality_bucket") == "poor_scan",
        "handwriting": flag["handwriting"],
        "indic_script": flag["indic_script"],
        "unparseable": flag["unparseable"],
        "missing_required": flag["required"] & ~value & F.col("line_index").isNull(),
        "code_match": flag["code_agrees"] & ~_sure(flag["code_filled"]),
        "code_filled": flag["code_filled"],
        "code_mismatch": ~flag["code_agrees"],
        "zoom_illegible": flag["zoom_illegible"],
        "repaired": flag["repaired"],
        "master_match": flag["master_match"],
    }
    numbers = {n: _sure(c).cast("double") for n, c in x.items()}
    numbers |= {"checks_passed": twice[0].cast("double"), "checks_failed": twice[1].cast("double"), "history": F.coalesce(F.col("history").cast("double"), F.lit(0.0))}
    return rows.withColumn("signals", F.struct(*[c.alias(n) for n, c in sorted(numbers.items())]))


def score_fields(fields: DataFrame, checks: DataFrame, weights: dict[str, float] | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """``features`` with ``raw``, ``score`` (after the document's penalty), ``needs_review``, ``band``, ``reason`` and
    ``reason_codes``: reasons by priority, then in the order in which they arise; a grave one sends the field to a person
    whatever its score, and so does a partly legible value of high stakes."""
    rows = features(fields, checks)
    flag, x = {n: _sure(c) for n, c in _flags(fields).items()}, F.col("signals")
    names = rows.schema["signals"].dataType.names
    rows = rows.withColumn("raw", evidence.score({n: x[n] for n in names}, weights))
    value, legible = F.col("value"), F.coalesce("legibility", F.lit(""))
    suggested = F.col("suggested_value")
    words = {code: F.lit(text) for code, (_, text) in REASONS.items()}
    words["repaired"] = F.coalesce("suggestion_reason", words["repaired"])
    words["disagree"] = F.when(flag["found_on_zoom"], FOUND_ON_ZOOM).otherwise(words["disagree"])
    words["suggestion"] = F.coalesce("suggestion_reason", F.concat(words["suggestion"], suggested.cast("string")))
    words["unparseable"] = F.concat(words["unparseable"], F.col("kind"))
    holds = {
        "missing_required": x["missing_required"] == 1,
        "repaired": flag["repaired"],
        "disagree": (x["disagree"] == 1) & ~flag["repaired"],
        "suggestion": suggested.isNotNull() & ~flag["repaired"],
        "illegible_zoom": flag["zoom_illegible"],
        "unparseable": flag["unparseable"],
        "illegible": legible == "illegible",
        "partly_legible": (legible == "partly_legible") & value.isNotNull(),
        "raw_inconsistent": x["raw_inconsistent"] == 1,
        "not_in_text_layer": (x["not_in_text_layer"] == 1) & flag["high_stakes"],
    }
    later = 1 << 40  # after every rule's own reason
    own = [F.when(c, F.struct(F.lit(REASONS[n][0]).alias("rank"), F.lit(later + i).alias("turn"), F.lit(n).alias("code"), words[n].alias("words"))) for i, (n, c) in enumerate(holds.items())]
    none = F.array().cast("array<struct<rank:int,turn:bigint,code:string,words:string>>")
    rows = rows.withColumn("__all", F.array_sort(F.concat(F.coalesce("__reasons", none), F.array_compact(F.array(*own)))))
    unsure = flag["high_stakes"] & holds["partly_legible"]
    rows = rows.withColumn("hard", F.exists("__all", lambda r: r["rank"] <= 1) | unsure)
    shown, review, band = evidence.route(F.col("raw"), flag["high_stakes"], F.col("hard"), F.col("doc_failed"), s)
    first = F.coalesce(F.get("__all", F.lit(0))["words"], F.when(value.isNull(), ABSENT).otherwise(UNPROVEN))
    codes = F.when(review & (F.size("__all") == 0), F.array(F.lit("low_score"))).otherwise(F.transform("__all", lambda r: r["code"]))
    forced = F.when(F.col("hard"), F.array(F.lit("forced"))).otherwise(F.array().cast("array<string>"))
    done = {"score": F.round(shown, 4), "needs_review": review, "band": band, "reason": F.when(review, first), "reason_codes": F.concat(codes, forced)}
    return rows.withColumns(done).drop("__all", "__reasons", "__passed", "__failed")


def suggest(fields: DataFrame, checks: DataFrame) -> DataFrame:
    """``fields`` (doc_id, field_key, kind, value, code_value, repaired, suggested_value, suggestion_reason) with what failed
    rules propose for the first field that they name: a rule's own value, the signed code's, or the only valid tax number one
    look-alike away. The first proposal holds; repaired fields and those with a suggestion stay as they are."""
    failed = checks.where("status = 'fail' and size(field_keys) > 0").select("doc_id", "ordinal", "check_id", "message", "suggest", F.col("field_keys")[0].alias("field_key"))
    open_ = fields.where("suggested_value is null and not coalesce(repaired, false)").select("doc_id", "field_key", "kind", "value", "code_value")
    kind = evidence.family()
    fixes = gst.repairs("value")
    rows = failed.join(open_, ["doc_id", "field_key"]).withColumn("fixes", F.when((kind == "format") & (F.col("kind") == "gstin"), fixes))
    lone = F.size("fixes") == 1
    stated = F.coalesce("suggest", F.lit("")) != ""
    new = F.when(stated, normalise("kind", "suggest")).when(kind == "qr", F.col("code_value")).when(lone, F.get("fixes", F.lit(0)))
    why = F.when(stated, F.col("message")).when(kind == "qr", "value encoded in the signed e-invoice QR").otherwise("the only valid GSTIN one look-alike character away from what was read")
    first = rows.select("doc_id", "field_key", "ordinal", new.alias("new"), why.alias("why")).where("new is not null").groupBy("doc_id", "field_key").agg(F.min_by(F.struct("new", "why"), "ordinal").alias("s"))
    merged = {"suggested_value": F.coalesce("suggested_value", "s.new"), "suggestion_reason": F.coalesce("suggestion_reason", "s.why")}
    return fields.join(first, ["doc_id", "field_key"], "left").withColumns(merged).drop("s")


def apply_repairs(fields: DataFrame, repairs: DataFrame, suggestions: DataFrame) -> DataFrame:
    """``fields`` after repairs (doc_id, field_key, new, source) took effect and lone proposals of the same columns were noted.
    A repair keeps what was read as ``alt_value`` and ends agreement; a proposal changes no value."""
    done = repairs.select("doc_id", "field_key", F.struct("new", "source").alias("__r"))
    noted = suggestions.select("doc_id", "field_key", F.struct("new", "source").alias("__s"))
    rows = fields.join(done, ["doc_id", "field_key"], "left").join(noted, ["doc_id", "field_key"], "left")
    hit, hint = F.col("__r").isNotNull(), F.col("__s").isNotNull()
    text = lambda c: F.col(c).cast("string")
    why = F.concat(F.lit("Corrected from "), text("value"), F.lit(" to "), text("__r.new"), F.lit(": the "), text("__r.source"), F.lit(" agrees and the totals add up"))
    hinted = F.concat(text("__s.new"), F.lit(" would make every total add up (the print may contain "), text("__s.source"), F.lit(")"))
    new = {
        "alt_value": F.when(hit, F.col("value")).otherwise(F.col("alt_value")),
        "value": F.when(hit, F.col("__r.new")).otherwise(F.col("value")),
        "repaired": hit | _sure(F.col("repaired")),
        "agreement": F.when(hit, False).otherwise(F.col("agreement")),
        "suggested_value": F.when(hint, F.col("__s.new")).otherwise(F.col("suggested_value")),
        "suggestion_reason": F.when(hint, hinted).when(hit, why).otherwise(F.col("suggestion_reason")),
    }
    return rows.withColumns(new).drop("__r", "__s")


def printed_digits(value: Column | str, raw: Column | str) -> Column:
    """(whole, fraction): the digits as printed if the print's first number is the value, else the value's own, with two
    decimals unless it is whole. ``value`` is a decimal."""
    value = F.col(value) if isinstance(value, str) else value
    number = F.replace(F.regexp_extract(fold_digits(raw), r"[0-9][0-9,]*(\.[0-9]+)?", 0), F.lit(","), F.lit(""))
    same = F.coalesce(F.abs(number.try_cast("decimal(38,6)") - F.abs(value)) < F.lit("0.005").cast("decimal(9,3)"), F.lit(False))
    own = F.abs(value).cast("decimal(38,2)").cast("string")
    plain = F.when(value == F.floor(value), F.split_part(own, F.lit("."), F.lit(1))).otherwise(own)
    digits = F.when(same, number).otherwise(plain)
    return F.struct(F.split_part(digits, F.lit("."), F.lit(1)).alias("whole"), F.split_part(digits, F.lit("."), F.lit(2)).alias("fraction"))


def reviewer_tags(verified_by: Column | str) -> Column:
    """What proved a value, in the reviewer's words; other kinds of proof carry their own tags."""
    names = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])
    return F.array_compact(F.transform(verified_by, lambda v: F.try_element_at(names, v)))
