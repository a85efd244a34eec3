"""Proof of values, choice of what to read again, scores, routing and repair."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docproof.functions.normalize import fold_digits
from docproof.settings import DEFAULTS, Settings
from docproof.sources.scratch import kept

#: Rules tight enough to prove their values, and rates that cannot pass misread (fixed values).
EXACT = ("line_math", "line_total", "lines_sum_subtotal", "tax_sum", "grand_total", "amount_in_words", "total_freight")
RATE = ("line_tax", "tax_rate_reconcile")
ARITHMETIC = (*EXACT, *RATE, "cgst_eq_sgst", "round_off", "accept_reject")
#: The order in which a line's and then a header's rules are listed.
CHECK_ORDER = ("line_math", "line_tax", "gst_slab", "line_total", "accept_reject", "lines_sum_subtotal", "tax_sum", "tax_rate_reconcile", "cgst_eq_sgst", "tax_type_vs_state", "grand_total", "round_off", "freight_math", "total_freight", "amount_in_words")
#: Digits for which a digit is mistaken (fixed values).
SLIPS = {"0": "869", "1": "74", "2": "73", "3": "859", "4": "91", "5": "638", "6": "5809", "7": "12", "8": "30695", "9": "4807"}
#: Weights of the signals (fixed values).
WEIGHTS = {
    "bias": 2.0, "legibility_clear": 0.5, "absent_optional": 2.0, "legibility_partly": -2.0, "legibility_illegible": -5.0,
    "proven": 1.5, "agree": 2.5, "disagree": -3.5, "raw_inconsistent": -2.5, "raw_consistent": 0.3, "in_text_layer": 2.0,
    "not_in_text_layer": -2.0, "format_ok": 1.0, "format_bad": -4.0, "checks_passed": 0.8, "checks_failed": -4.0,
    "doc_check_failed": 0.0, "quality_digital": 1.0, "quality_poor": -1.0, "handwriting": -0.7, "indic_script": -0.5,
    "history": 1.0, "unparseable": -4.0, "missing_required": -6.0, "code_match": 4.0, "code_filled": 3.0,
    "code_mismatch": -4.0, "zoom_illegible": -2.0, "repaired": -3.0, "master_match": 1.5,
}
#: Checks whose failure explains itself best, and phrases of headlines by priority (fixed values).
SPECIFIC = ("qr", "own_gstin", "fy_date", "duplicate", "vendor_bank_changed")
PHRASES = {
    "grand_total": "invoice total doesn't add up",
    "tax_type_vs_state": "tax type doesn't match the states (IGST vs CGST+SGST)",
    "tax_rate_reconcile": "tax amount doesn't match the GST rate",
    "tax_sum": "tax amount doesn't match the line items",
    "cgst_eq_sgst": "CGST and SGST don't match",
    "lines_sum_subtotal": "line items don't add up to the taxable value",
    "line_tax": "a line's GST doesn't match its rate",
    "line_math": "quantity × rate doesn't match a line amount",
    "total_freight": "freight total doesn't add up",
    "freight_math": "freight doesn't match weight × rate",
    "amount_in_words": "amount in words doesn't match the total",
    "round_off": "round-off is too large",
    "format:": "a GSTIN / code looks misread",
    "gst_slab": "an unusual GST rate",
    "accept_reject": "accepted + rejected quantity doesn't equal received",
    "date:": "a date looks wrong",
    "required_fields": "some required details are missing",
}


def family(check_id: Column | str = "check_id") -> Column:
    return F.split_part(F.col(check_id) if isinstance(check_id, str) else check_id, F.lit(":"), F.lit(1))


def proven_by_arithmetic(checks: DataFrame, percent_fields: tuple[str, ...] = ("gst_rate",)) -> DataFrame:
    """(doc_id, field_key) that an exact passing rule holds, or a passing rate rule for rates; none that an error implicates."""
    exact = family().isin(*EXACT) & (F.abs(F.col("calc") - F.col("printed")) <= F.lit("0.011").cast("decimal(9,3)"))
    good = checks.where((F.col("status") == "pass") & (exact | family().isin(*RATE)))
    keys = good.select("doc_id", family().isin(*RATE).alias("rate"), F.explode("field_keys").alias("field_key"))
    name = F.element_at(F.split("field_key", r"\."), -1)
    keys = keys.where(~F.col("rate") | name.isin(*percent_fields)).select("doc_id", "field_key").distinct()
    bad = checks.where("status = 'fail' and severity = 'error'").select("doc_id", F.explode("field_keys").alias("field_key")).distinct()
    return keys.join(bad, ["doc_id", "field_key"], "left_anti")


def verified(fields: DataFrame, checks: DataFrame) -> DataFrame:
    """``fields`` with verified_by: what proves each, of arithmetic, code, text_layer and records, in this order.

    Fields have doc_id, field_key, kind, value, raw, legibility, code_agrees, in_text_layer, master_match. A rule that holds exactly proves
    the values in it, and also that a term printed nowhere is absent; a rule of rates proves percentages alone; nothing
    that a failing error names is proven by arithmetic. In the text, a number counts from four digits on.

    Fields and what rules say of them go by document in one shuffle, in their order and without what is not asked for: neighbours are
    alike then and pack well. A join on both keys would scatter them."""
    exact = family().isin(*EXACT) & (F.abs(F.col("calc") - F.col("printed")) <= F.lit("0.011").cast("decimal(9,3)"))
    rate = family().isin(*RATE)
    named = checks.select("doc_id", ((F.col("status") == "pass") & exact).alias("exact"), ((F.col("status") == "pass") & rate).alias("rate"), ((F.col("status") == "fail") & (F.col("severity") == "error")).alias("bad"), F.explode("field_keys").alias("field_key"))
    bits = lambda flags: reduce(lambda a, b: a.bitwiseOR(b), [F.when(x, F.lit(1 << i)).otherwise(0) for i, x in enumerate(flags)])
    named = named.where("doc_id is not null and (exact or rate or bad)").select("doc_id", "field_key", bits(F.col(x) for x in ("exact", "rate", "bad")).alias("__by"))
    sure = lambda x: F.coalesce(x if isinstance(x, Column) else F.col(x), F.lit(False))
    there, numeric = F.col("value").isNotNull(), F.col("kind").isin("number", "integer", "percent")
    absent = ~there & sure(F.col("legibility") == "not_present")
    text = there & sure("in_text_layer") & sure(strong_text(F.coalesce(F.nullif("raw", F.lit("")), F.col("value").cast("string")), numeric))
    own = there | absent, there & sure(F.col("kind") == "percent"), there & sure("code_agrees"), text, there & sure("master_match")
    both = fields.withColumn("__own", bits(own)).unionByName(named, allowMissingColumns=True).repartition("doc_id")
    rows = both.withColumn("__by", F.bit_or("__by").over(Window.partitionBy("doc_id", "field_key"))).where("__own is not null")
    has = lambda x, i: F.coalesce(F.col(x), F.lit(0)).bitwiseAND(1 << i) > 0
    sums = ~has("__by", 2) & ((has("__by", 0) & has("__own", 0)) | (has("__by", 1) & has("__own", 1)))
    found = F.array(F.when(sums, "arithmetic"), *[F.when(has("__own", i), x) for i, x in enumerate(("code", "text_layer", "records"), 2)])
    return rows.withColumn("verified_by", F.array_compact(found)).drop("__by", "__own")


def strong_text(raw: Column | str, numeric: Column) -> Column:
    """A short number is in any text by chance; it proves nothing."""
    return ~numeric | (F.length(F.regexp_replace(raw, "[^0-9]", "")) >= 4)


def needs_reread(value: Column, legibility: Column, high_stakes: Column, hard: Column, raw_consistent: Column, unparseable: Column, settled: Column) -> Column:
    """Whether a field is to be read again: never a settled one (proven, or filled from a code); one without a value if it
    is there but hard to read; else what is costly, on a hard document, or doubtful. A null flag counts as false, of
    ``raw_consistent`` as unknown."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    unread = legibility.isin("illegible", "partly_legible")
    doubtful = high_stakes, hard, legibility != "clear", ~raw_consistent, unparseable
    return ~sure(settled) & sure(F.when(value.isNull(), unread).otherwise(reduce(lambda a, b: a | b, map(sure, doubtful))))


def reread_targets(fields: DataFrame, most: int = 40) -> DataFrame:
    """The fields that a second reading is asked for, of each document the first ``most``: high stakes first, then what is not
    clear, then header fields, then by line; equal ones in the document's order.

    Needs doc_id, place (order in the document), line_index (null in the header), value, legibility, is_high_stakes, hard,
    raw_consistent, unparseable, proven and code_filled; adds turn."""
    flag = lambda x: F.coalesce(F.col(x), F.lit(False))
    asked = needs_reread(F.col("value"), F.col("legibility"), F.col("is_high_stakes"), F.col("hard"), F.col("raw_consistent"), F.col("unparseable"), flag("proven") | flag("code_filled"))
    order = Window.partitionBy("doc_id").orderBy(F.desc(flag("is_high_stakes")), F.col("legibility").eqNullSafe("clear"), F.col("line_index").isNotNull(), F.coalesce("line_index", F.lit(0)), "place")
    return fields.where(asked).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most)


def reread_outcome(first: Column | str, second: Column | str, legible: Column) -> Column:
    """agree, differ, found (only on the second reading) or illegible."""
    first, second = (F.col(x) if isinstance(x, str) else x for x in (first, second))
    return F.when(~legible, "illegible").when(first.isNull() & second.isNotNull(), "found").when(first.eqNullSafe(second), "agree").otherwise("differ")


def implicated(checks: DataFrame, values: DataFrame, most: int = 14) -> DataFrame:
    """The fields of failing arithmetic in the order of the checks (lines by number, then the header), each where it is first
    named, at most ``most`` a document. ``values``: doc_id, field_key of the fields that hold a number."""
    bad = checks.where((F.col("status") == "fail") & (F.col("severity") == "error") & family().isin(*ARITHMETIC))
    part = F.split_part("check_id", F.lit(":"), F.lit(2))
    line, rank = part.try_cast("int"), F.array_position(F.array(*map(F.lit, CHECK_ORDER)), family())
    keys = bad.select("doc_id", F.struct(line.isNull().alias("header"), line.alias("line"), rank.alias("rank"), part.alias("part")).alias("check"), F.posexplode("field_keys").alias("pos", "field_key"))
    first = keys.groupBy("doc_id", "field_key").agg(F.min(F.struct("check", "pos")).alias("at")).join(values.select("doc_id", "field_key").distinct(), ["doc_id", "field_key"], "left_semi")
    return first.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "field_key"))).where(F.col("turn") <= most).select("doc_id", "field_key", "turn")


def printed_digits(value: Column, raw: Column | None = None) -> tuple[Column, Column]:
    """(whole, fraction) of a number as it is printed: the first number of ``raw`` where that is the value, else the value
    itself, with two decimals unless it is whole."""
    size = F.abs(value)
    plain = F.when(size == F.floor(size), F.floor(size).cast("string")).otherwise(F.format_string("%.2f", size.cast("double")))
    if raw is not None:
        printed = F.regexp_replace(F.regexp_extract(fold_digits(raw), r"[0-9][0-9,]*(?:\.[0-9]+)?", 0), ",", "")
        plain = F.when(F.abs(printed.try_cast("decimal(38,6)") - size) < F.lit("0.005").cast("decimal(4,3)"), printed).otherwise(plain)
    return F.split_part(plain, F.lit("."), F.lit(1)), F.split_part(plain, F.lit("."), F.lit(2))


def slips(value: Column | str, raw: Column | None = None) -> Column:
    """Plausible misreads of a printed number, as an array of (value, reason), each value once: a digit mistaken, a digit of
    the whole part dropped or doubled, two neighbours swapped, the decimal point shifted or lost (which a whole number
    cannot lose)."""
    value = (F.col(value) if isinstance(value, str) else value).cast("decimal(20,4)")
    whole, fraction = printed_digits(value, raw)
    bound = F.struct(whole.alias("whole"), fraction.alias("fraction"), value.alias("value"))
    signed = F.when(value < 0, -1).otherwise(1)
    rows = bind(bound, lambda x: bind(F.concat(x["whole"], x["fraction"]), lambda digits: _misreads(digits, F.length(x["whole"]), x["fraction"] != "", F.abs(x["value"]))))
    rows = F.transform(rows, lambda y: F.struct(F.round(y["value"] * signed, 2).cast("decimal(18,2)").alias("value"), y["reason"].alias("reason")))
    rows = bind(rows, lambda y: F.filter(y, lambda z: z["value"].isNotNull() & (F.abs(z["value"] - value) > F.lit("0.004").cast("decimal(4,3)"))))
    return bind(rows, lambda y: bind(F.transform(y, lambda z: z["value"]), lambda values: F.filter(y, lambda z, i: F.array_position(values, z["value"]) == i + 1)))


#: Up to so many different numbers, their misreads are broadcast: some 30 MB.
FEW = 20_000


def with_slips(rows: DataFrame, value: str, raw: str, shown: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with slips: what ``shown`` makes of the misreads of each number. Numbers repeat, so each different one, as printed, is
    worked out once, written and joined."""
    known = rows.select(F.col(value).alias("__value"), F.col(raw).alias("__raw")).distinct()
    known = known.repartition(rows.sparkSession.sparkContext.defaultParallelism)  # few bytes, and much work
    known = kept(known.withColumn("slips", shown(slips("__value", F.col("__raw")))), "slips")
    known = F.broadcast(known) if known.count() <= FEW else known.hint("merge")
    return rows.join(known, F.col(value).eqNullSafe(F.col("__value")) & F.col(raw).eqNullSafe(F.col("__raw"))).drop("__value", "__raw")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def _misreads(digits: Column, point: Column, broken: Column, value: Column) -> Column:
    """(value, reason) of the misreads of a number's digits, ``point`` of them before the decimal point; null where none is."""
    table = F.create_map(*[F.lit(y) for kv in SLIPS.items() for y in kv])
    n, one = F.length(digits), F.lit(1)
    part = lambda a, b: F.substring(digits, a, b)
    at = lambda i: part(i, one)
    put = lambda i, y, skip: F.concat(part(one, i - 1), y, part(i + skip, n))
    number = lambda text, whole: F.concat(F.substring(text, F.lit(1), whole), F.lit("."), F.substring(text, whole + 1, n + 1)).try_cast("decimal(20,4)")
    found = lambda text, whole, why: F.when(whole > 0, F.struct(number(text, whole).alias("value"), why.alias("reason")))
    looks = lambda i: F.filter(F.split(F.coalesce(F.element_at(table, at(i)), F.lit("")), ""), lambda c: c != "")
    mistaken = lambda i: F.transform(looks(i), lambda c: found(put(i, c, 1), point, F.concat(F.lit("a "), c, F.lit(" read as a "), at(i))))
    others = lambda i: F.array(
        F.when(i <= point, found(put(i, F.lit(""), 1), point - 1, F.lit("a dropped digit"))),
        F.when(i <= point, found(put(i, F.concat(at(i), at(i)), 1), point + 1, F.lit("a doubled digit"))),
        F.when((i < n) & (at(i) != at(i + 1)), found(put(i, F.concat(at(i + 1), at(i)), 2), point, F.lit("two digits swapped"))),
    )
    moved = {"10": "shifted", "0.1": "shifted", "100": "missing", "0.01": "missing"}
    factors = F.array(*[F.when(broken | F.lit(float(f) > 1), F.struct((value * F.lit(f).cast("decimal(6,2)")).cast("decimal(20,4)").alias("value"), F.lit(f"a {why} decimal point").alias("reason"))) for f, why in moved.items()])
    return F.filter(F.concat(F.flatten(F.transform(F.sequence(one, n), lambda i: F.concat(mistaken(i), others(i)))), factors), lambda y: y.isNotNull())


def history_signal(correct: Column | str, total: Column | str) -> Column:
    """Shift of the log odds that a vendor's history gives: 0 without, growing with evidence."""
    correct, total = (F.col(x) if isinstance(x, str) else x for x in (correct, total))
    logit = lambda p: F.ln(p / (1 - p))
    p = F.least(F.greatest((correct + 9.0) / (total + 10.0), F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.when(total > 0, logit(p) - logit(F.lit(0.9))).otherwise(0.0)


def score(signals: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """The logistic score of signals by name; what is missing counts 0."""
    w = WEIGHTS | (weights or {})
    total = reduce(lambda a, b: a + b, [F.lit(w.get(k, 0.0)) * x.cast("double") for k, x in signals.items()], F.lit(w["bias"]))
    return 1 / (1 + F.exp(-total))


def route(raw: Column, high_stakes: Column, failed_here: Column, doc_failed: Column, s: Settings = DEFAULTS) -> tuple[Column, Column, Column]:
    """(score with the document's penalty, needs_review, band)."""
    shown = F.when(doc_failed, raw * s.document_penalty).otherwise(raw)
    threshold = F.when(high_stakes, s.high_stakes).otherwise(s.auto_accept)
    review = failed_here | (raw < threshold)
    band = F.when((shown >= threshold) & ~review, F.when(doc_failed, "medium").otherwise("high")).when((shown >= 0.6) & ~failed_here, "medium").otherwise("low")
    return shown, review, band


def headlines(checks: DataFrame, flagged: DataFrame) -> DataFrame:
    """What a document is to be looked at for: doc_id, headline. The first phrase by priority of its failed checks, with the number
    of other flagged fields; without such a check the labels of the first two flagged fields.

    ``flagged``: doc_id, and label and place (order in the document) of each field that a person is to look at."""
    rank = reduce(lambda a, b: F.when(F.startswith("check_id", F.lit(b[1])), b[0]).otherwise(a), reversed(list(enumerate(PHRASES))), F.lit(None).cast("int"))
    names = F.array(*[F.lit(p[0].upper() + p[1:]) for p in PHRASES.values()])
    worst = checks.where("status = 'fail'").withColumn("rank", rank).where("rank is not null").groupBy("doc_id").agg(F.min("rank").alias("rank"))
    turn = flagged.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "label")))
    counts = turn.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("turn") == 1, F.col("label"))).alias("one"), F.max(F.when(F.col("turn") == 2, F.col("label"))).alias("two"))
    rows = worst.join(counts, "doc_id", "full").withColumn("n", F.coalesce("n", F.lit(0)))
    more = F.when(F.col("n") > 1, F.concat(F.lit(" (+"), F.col("n") - 1, F.lit(" more)"))).otherwise("")
    rest = F.when(F.col("n") > 2, F.concat(F.lit(" +"), F.col("n") - 2)).otherwise("")
    asked = F.when(F.col("n") == 1, F.concat(F.lit("Confirm "), "one")).otherwise(F.concat(F.lit("Confirm "), "one", F.lit(", "), "two", rest))
    return rows.select("doc_id", F.when(F.col("rank").isNotNull(), F.concat(F.get(names, F.col("rank")), more)).otherwise(asked).alias("headline"))
