"""Three-way match of purchase orders, goods receipts and invoices: all triples in one job.

``three_way`` pairs the lines of an order with those of each receipt and of the invoice best score first - equal codes,
else similar texts - and lists every difference, with those of references and suppliers. ``match_lines`` and
``match_documents`` are the plain form for lines that all have codes. Lines only ever meet within their document, by
equi-joins, so the plan scales with documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush
from itertools import pairwise
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docproof.functions.text import words_alike
from docproof.operators.checks import zero
from docproof.settings import DEFAULTS, Settings
from docproof.sources.scratch import kept


def same_reference(a: Column | str, b: Column | str) -> Column:
    """Equal up to case, punctuation and leading zeros, or one the end of the other. Letters and digits of all scripts count;
    where nothing of either is left, it proves nothing."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    bare = lambda x: F.ltrim(F.regexp_replace(F.upper(x), r"[^\p{L}\p{N}]", ""), F.lit("0"))
    return (bare(a) != "") & (bare(b) != "") & (bare(a).endswith(bare(b)) | bare(b).endswith(bare(a)))


def received(receipts: DataFrame) -> DataFrame:
    """Receipt lines summed to (doc_id, item_code): received, accepted (received where nothing else is said), has_accept."""
    acc, rec = F.col("quantity_accepted"), F.col("quantity_received")
    return receipts.groupBy("doc_id", "item_code").agg(F.sum(zero(rec)).cast("decimal(18,2)").alias("received"), F.sum(zero(F.coalesce(acc, rec))).cast("decimal(18,2)").alias("accepted"), F.bool_or(acc.isNotNull()).alias("has_accept"))


def _once(lines: DataFrame) -> DataFrame:
    """Lines with their turn among those of the same item, so that repeated items match one to one."""
    return lines.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "item_code").orderBy("line_index")))


def match_lines(orders: DataFrame, receipts: DataFrame, invoices: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Invoice lines with their order line and receipt, and the problems of each."""
    turn = F.row_number().over(Window.partitionBy("doc_id", "item_code").orderBy("quantity", "rate", "gst_rate"))
    po = orders.select("doc_id", "item_code", F.col("quantity").alias("q_po"), F.col("rate").alias("r_po"), F.col("gst_rate").alias("g_po"), turn.alias("turn"))
    got = received(receipts).withColumn("turn", F.lit(1))
    rows = _once(invoices).join(po, ["doc_id", "item_code", "turn"], "left").join(got, ["doc_id", "item_code", "turn"], "left")
    has_receipt = receipts.select("doc_id").distinct().withColumn("has_receipt", F.lit(True))
    rows = rows.join(has_receipt, "doc_id", "left").withColumn("has_receipt", F.coalesce("has_receipt", F.lit(False)))
    q, r, g = F.col("quantity"), F.col("rate"), F.col("gst_rate")
    acc, on_po = zero("accepted"), F.col("q_po").isNotNull()
    more = lambda x: (F.lit(1) + F.lit(x).cast("decimal(9,4)") / 100).cast("decimal(12,6)")
    problems = F.array_compact(
        F.array(
            F.when(~on_po, "extra_line"),
            F.when(on_po & (r > F.col("r_po") * more(s.price_pct)), "price"),
            F.when(on_po & F.col("has_receipt") & (q > acc * more(s.quantity_pct)), "quantity_accepted"),
            F.when(on_po & (q > F.col("q_po")), "quantity_ordered"),
            F.when(on_po & (F.abs(g - F.col("g_po")) > F.lit("0.001").cast("decimal(9,3)")), "tax"),
        )
    )
    payable = F.when(on_po, F.when(F.col("has_receipt"), F.least(q, acc)).otherwise(q) * F.col("r_po") - zero("discount"))
    return rows.select("doc_id", "line_index", "item_code", "quantity", "rate", "q_po", "r_po", F.col("accepted"), "has_receipt", problems.alias("problems"), payable.cast("decimal(18,2)").alias("payable"))


def match_documents(orders: DataFrame, receipts: DataFrame, invoices: DataFrame, headers: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """One row an invoice: number of blocking issues and notes, payable amount, status."""
    lines = match_lines(orders, receipts, invoices, s)
    of_lines = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.size("problems")).cast("bigint").alias("line_issues"), F.sum("payable").cast("decimal(18,2)").alias("payable"), F.bool_and(F.col("q_po").isNotNull()).alias("all_matched"))
    billed = lines.where("q_po is not null").select("doc_id", "item_code").distinct()
    unbilled = received(receipts).where("accepted > 0").join(orders.select("doc_id", "item_code").distinct(), ["doc_id", "item_code"], "left_semi").join(billed, ["doc_id", "item_code"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("unbilled"))
    stray = receipts.join(orders.select("doc_id", "item_code").distinct(), ["doc_id", "item_code"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("stray"))
    ordered = orders.groupBy("doc_id").agg(F.count(F.lit(1)).alias("ordered"))
    rows = headers.select("doc_id", "subtotal")
    for part in (of_lines, unbilled, stray, ordered):
        rows = rows.join(part, "doc_id", "left")
    off = F.abs(F.col("subtotal") - F.col("payable")) > F.greatest(F.lit(s.match_abs).cast("decimal(9,2)"), F.col("payable") * F.lit("0.001").cast("decimal(9,3)"))
    total = F.coalesce((F.col("all_matched") & off).cast("bigint"), F.lit(0))
    blocks = F.coalesce("line_issues", F.lit(0)) + total
    notes = F.coalesce("unbilled", F.lit(0)) + F.coalesce("stray", F.lit(0))
    status = F.when(F.col("lines").isNull() | F.col("ordered").isNull(), "incomplete").when(blocks > 0, "mismatch").otherwise("matched")
    return rows.select("doc_id", blocks.cast("bigint").alias("blocks"), notes.cast("bigint").alias("notes"), F.col("payable").cast("double").alias("payable"), status.alias("status"))


def _bare(x: Column | str, keep: str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))), f"[^{keep}]", "")


ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "


def _side(lines: DataFrame, x: str) -> DataFrame:
    """The different lines of each document on one side (doc_id, x_code, x_text, x_hsn): what their scores need, and their indexes, largest
    first."""
    code = F.when(F.col(f"{x}_code") != "", F.upper(F.trim(f"{x}_code")))
    rows = lines.select("doc_id", F.col(f"{x}_index").alias("index"), code.alias(f"{x}_code"), _bare(f"{x}_text", "a-z0-9 ").alias(f"{x}_words"), F.when(F.col(f"{x}_hsn") != "", F.substring(f"{x}_hsn", 1, 4)).alias(f"{x}_head"))
    once = rows.groupBy(*[c for c in rows.columns if c != "index"]).agg(F.sort_array(F.collect_list("index"), asc=False).alias(f"{x}_lines"))
    has = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(f"{x}_words").contains(c), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(ALPHABET)])
    words = F.array_distinct(F.filter(F.split(f"{x}_words", r"\s+"), lambda w: w != ""))
    return once.withColumns({f"{x}_has": has, f"{x}_set": words}).withColumn(f"{x}_least", F.length(F.array_join(f"{x}_set", "")))


def similarity(a: DataFrame, b: DataFrame, least: float = 0.0) -> DataFrame:
    """Pairs of lines of the same document that score ``least`` or more: a (doc_id, a_index, a_code, a_text, a_hsn), b alike."""
    found = _scored(_side(a, "a"), _side(b, "b"), least)
    return found.select("doc_id", F.explode("a_lines").alias("a_index"), "b_lines", "score").select("doc_id", "a_index", F.explode("b_lines").alias("b_index"), "score")


def _scored(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """The pairs of different lines that score ``least`` or more.

    Lines that are alike letter for letter were taken together before, and a pair is compared only if a bound allows
    it: lines that share a word, or whose letters leave room for so long a common subsequence - each letter that one
    line has and the other has not is one less, against the letters of its different words. The bounds are integer operations inside the join, so pairs
    beyond them are neither kept nor sent, and none that scores enough is lost."""
    same_code = F.coalesce(F.col("a_code") == F.col("b_code"), F.lit(False))
    hsn = F.when(F.col("a_head") == F.col("b_head"), 10.0).otherwise(0.0)
    gone = lambda x, y: F.bit_count(F.col(f"{x}_has").bitwiseAND(F.bitwise_not(F.col(f"{y}_has"))))
    size = lambda x: F.length(f"{x}_words")
    room = F.least(size("a") - gone("a", "b"), size("b") - gone("b", "a"))
    possible = F.lit(200.0) * room >= (F.lit(least) - hsn) * (F.col("a_least") + F.col("b_least"))
    pairs = a.join(b.hint("merge"), "doc_id").where(same_code | possible | F.arrays_overlap("a_set", "b_set") | F.lit(least <= 0))
    text = words_alike(*[F.when(~same_code, F.col(x)) for x in ("a_words", "b_words")])
    return pairs.select("doc_id", "a_lines", "b_lines", F.when(same_code, 100.0).otherwise(text + hsn).alias("score")).where(F.col("score") >= least)


def greedy_pairs(scores: DataFrame, least: float = DEFAULTS.least_similarity) -> DataFrame:
    """One-to-one pairs of each document from scored pairs (doc_id, a_index, b_index, score), best score first; ties go to the larger
    index."""
    one = scores.where(F.col("score") >= least).select("doc_id", F.array("a_index").alias("a_lines"), F.array("b_index").alias("b_lines"), "score")
    return _greedy(one)


def _greedy(pairs: DataFrame) -> DataFrame:
    """Greedy pairs of pairs of line classes (doc_id, a_lines, b_lines, score), whose lines come largest first: a window
    sorts each document's, best score first, and one pass takes them. A class gives its lines from the largest down, so of a
    document only the number that each class has given is held."""
    best = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc(F.get("a_lines", F.lit(0))), F.desc(F.get("b_lines", F.lit(0))))
    ranked = pairs.select("doc_id", F.row_number().over(best).alias("turn"), "score", "a_lines", "b_lines")
    kind = pairs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(_take, f"doc_id {kind}, a_index int, b_index int, score double")


def _lists(column: pa.Array) -> list[list[int]]:
    values, ends = column.flatten().to_pylist(), column.offsets.to_pylist()
    return [values[i - ends[0] : j - ends[0]] for i, j in pairwise(ends)]


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs taken, from those of whole documents in order. Of pairs that share a score the larger line a goes first, and takes the
    largest free line b; classes whose next line is smaller than what may still come wait on a heap."""
    doc = score = None
    given: tuple[dict[int, int], dict[int, int]] = ({}, {})  # of a class, by its largest line: how many lines it has given
    lines: list[int] = []  # the class that is being read, and those that it meets at this score
    others: list[list[int]] = []
    waiting: list[tuple[int, list[int], list[list[int]]]] = []
    found: list[tuple] = []

    def read() -> None:
        if lines and (n := given[0].get(lines[0], 0)) < len(lines):
            heappush(waiting, (-lines[n], lines, others))

    def settle(above: float) -> None:
        while waiting and -waiting[0][0] > above:
            line, own, met = heappop(waiting)
            free = [(b[n], b[0]) for b in met if (n := given[1].get(b[0], 0)) < len(b)]
            if not free:
                continue
            b, top = max(free)
            found.append((doc, -line, b, score))
            n = given[0][own[0]] = given[0].get(own[0], 0) + 1
            given[1][top] = given[1].get(top, 0) + 1
            if n < len(own):
                heappush(waiting, (-own[n], own, met))

    def taken(kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * 4
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (kind, pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["doc_id", "a_index", "b_index", "score"])

    kind = None
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        plain = (batch.column(x).to_pylist() for x in ("doc_id", "turn", "score"))
        for of, place, next_score, a, b in zip(*plain, _lists(batch.column("a_lines")), _lists(batch.column("b_lines")), strict=True):
            if place == 1 or next_score != score or a[0] != lines[0]:
                read()
                same = place > 1 and next_score == score
                settle(a[0] if same else -inf)
                if place == 1:
                    doc, given = of, ({}, {})
                score, lines, others = next_score, a, []
            others.append(b)
        yield taken(kind)
    if kind is not None:
        read()
        settle(-inf)
        yield taken(kind)


def matched_lines(a: DataFrame, b: DataFrame, least: float = DEFAULTS.least_similarity) -> DataFrame:
    """``greedy_pairs`` of the pairs of ``similarity``, by classes of equal lines."""
    return _greedy(_scored(_side(a, "a"), _side(b, "b"), least))


def _paired(orders: DataFrame, lines: DataFrame, keys: list[str], s: Settings) -> DataFrame:
    """keys, po_line, line_index: the lines of each group that an order line takes, best score first."""
    side = lambda df, x, *more: df.select(*more, F.col("line_index").alias(f"{x}_index"), F.col("item_code").cast("string").alias(f"{x}_code"), F.col("description").alias(f"{x}_text"), F.col("hsn_sac").alias(f"{x}_hsn"))
    group = F.struct(*keys)
    of_lines = side(lines.withColumn("group", group), "b", "group").withColumnRenamed("group", "doc_id")
    of_orders = side(lines.select(*keys, group.alias("group")).distinct().join(orders.hint("merge"), "doc_id"), "a", "group").withColumnRenamed("group", "doc_id")
    pairs = matched_lines(of_orders, of_lines, s.least_similarity)
    return pairs.select("doc_id.*", F.col("a_index").alias("po_line"), F.col("b_index").alias("line_index"))


def _issue(kind: str, severity: str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity")))


def _issues(rows: DataFrame, *found: Column, line: str | None = None, receipt: str | None = None) -> DataFrame:
    """A row for each issue that a row has: doc_id, kind, severity, line_index, receipt_id."""
    col = lambda x: F.lit(None) if x is None else F.col(x)
    return rows.select("doc_id", F.inline(F.array_compact(F.array(*found))), col(line).cast("int").alias("line_index"), col(receipt).cast("string").alias("receipt_id"))


def reference_issues(orders: DataFrame, receipts: DataFrame, invoices: DataFrame) -> DataFrame:
    """The issues of ``three_way`` that need no lines: references to other orders and invoices, and suppliers that differ. Tables
    of documents never meet by broadcast: what a file tells of their size is a fraction of what the driver would hold."""
    given = lambda x: F.coalesce(F.col(x), F.lit("")) != ""
    named = orders.select("doc_id", F.coalesce("po_number", F.lit("")).alias("po_number")).hint("merge")
    order_named = F.coalesce("po_number", F.lit(""))
    other_order = given("po_reference") & ~same_reference(F.col("po_reference"), order_named)
    other_bill = given("supplier_invoice_reference") & given("invoice_number") & ~same_reference("supplier_invoice_reference", "invoice_number")
    bills = invoices.select("doc_id", "po_reference").join(named, "doc_id", "left")
    slips = receipts.join(named, "doc_id", "left").join(invoices.select("doc_id", "invoice_number").hint("merge"), "doc_id", "left")
    suppliers = reduce(DataFrame.unionByName, [x.select("doc_id", "supplier_gstin") for x in (orders, receipts, invoices)])
    suppliers = suppliers.where("supplier_gstin <> ''").groupBy("doc_id").agg(F.min("supplier_gstin").alias("a"), F.max("supplier_gstin").alias("b"))
    of_bills = _issues(bills, _issue("reference", "block", other_order))
    of_slips = _issues(slips, _issue("reference", "block", other_order), _issue("reference", "warn", other_bill), receipt="receipt_id")
    return of_bills.unionByName(of_slips).unionByName(_issues(suppliers, _issue("supplier", "block", F.col("a") != F.col("b"))))


def three_way(orders: DataFrame, order_lines: DataFrame, receipts: DataFrame, receipt_lines: DataFrame, invoices: DataFrame, invoice_lines: DataFrame, s: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(lines, issues) of every match, known by doc_id.

    orders: doc_id, po_number, supplier_gstin; receipts: doc_id, receipt_id, po_reference, supplier_invoice_reference,
    supplier_gstin; invoices: doc_id, invoice_number, po_reference, supplier_gstin, subtotal. Lines: doc_id (and receipt_id),
    line_index, item_code, description, hsn_sac and their numbers. A missing number proves no difference.

    lines: doc_id, line_index, po_line (null if not ordered), received, accepted (null without a receipt), payable.
    issues: doc_id, kind, severity (block or warn), line_index (of the invoice's or receipt's line, or null), receipt_id.
    Lines are written once before they are matched and once after, since each is read several times."""
    line = ("doc_id", "line_index", "item_code", "description", "hsn_sac")
    order_lines = kept(order_lines.select(*line, "quantity", "rate", "gst_rate"), "match-order-lines")
    receipt_lines = kept(receipt_lines.select(*line, "receipt_id", "quantity_received", "quantity_accepted"), "match-receipt-lines")
    invoice_lines = kept(invoice_lines.select(*line, "quantity", "rate", "gst_rate", "discount"), "match-invoice-lines")
    order = order_lines.select("doc_id", F.col("line_index").alias("po_line"), F.col("quantity").alias("q_po"), F.col("rate").alias("r_po"), F.col("gst_rate").alias("g_po")).hint("merge")
    got = receipt_lines.select("doc_id", "receipt_id", "line_index", "quantity_received", "quantity_accepted")
    got = kept(got.join(_paired(order_lines, receipt_lines, ["doc_id", "receipt_id"], s).hint("merge"), ["doc_id", "receipt_id", "line_index"], "left"), "received-lines")
    rec = zero("quantity_received")
    sums = got.where("po_line is not null").groupBy("doc_id", "po_line").agg(F.sum(rec).alias("received"), F.sum(F.coalesce("quantity_accepted", rec)).alias("accepted"))
    with_receipt = receipts.select("doc_id").distinct().withColumn("has_receipt", F.lit(True)).hint("merge")
    rows = invoice_lines.select("doc_id", "line_index", "quantity", "rate", "gst_rate", "discount").join(_paired(order_lines, invoice_lines, ["doc_id"], s).hint("merge"), ["doc_id", "line_index"], "left")
    rows = kept(rows.join(order, ["doc_id", "po_line"], "left").join(sums.hint("merge"), ["doc_id", "po_line"], "left").join(with_receipt, "doc_id", "left"), "billed-lines")
    q, r, on_po, receipt = F.col("quantity"), F.col("rate"), F.col("po_line").isNotNull(), F.col("has_receipt")
    accepted = F.when(receipt, zero("accepted"))
    more = lambda x: (F.lit(1) + F.lit(x).cast("decimal(9,4)") / 100).cast("decimal(12,6)")
    payable = F.when(on_po & q.isNotNull() & F.col("r_po").isNotNull(), F.when(receipt, F.least(q, accepted)).otherwise(q) * F.col("r_po") - zero("discount"))
    rows = rows.withColumn("payable", payable.cast("decimal(18,2)")).withColumn("paid_for", accepted)

    billed = rows.where(on_po).select("doc_id", "po_line").hint("merge")
    totals = rows.groupBy("doc_id").agg(F.bool_and(on_po).alias("all_ordered"), F.coalesce(F.sum("payable"), F.lit(0)).alias("due")).join(invoices.select("doc_id", "subtotal").hint("merge"), "doc_id")
    off = F.abs(F.col("subtotal") - F.col("due")) > F.greatest(F.lit(s.match_abs).cast("decimal(9,2)"), F.col("due") * F.lit("0.001").cast("decimal(9,3)"))
    of_lines = [
        _issue("extra_line", "block", ~on_po),
        _issue("price", "block", on_po & (r > F.col("r_po") * more(s.price_pct))),
        _issue("quantity", "block", on_po & receipt & (q > F.col("paid_for") * more(s.quantity_pct))),
        _issue("quantity", "block", on_po & (q > F.col("q_po"))),
        _issue("tax", "block", on_po & (F.abs(F.col("gst_rate") - F.col("g_po")) > F.lit("0.001").cast("decimal(9,3)"))),
    ]
    found = [
        reference_issues(orders, receipts, invoices),
        _issues(got, _issue("extra_line", "warn", F.col("po_line").isNull()), line="line_index", receipt="receipt_id"),
        _issues(rows, *of_lines, line="line_index"),
        _issues(sums.where("accepted > 0").join(billed, ["doc_id", "po_line"], "left_anti"), _issue("missing_line", "warn", F.lit(True)), line="po_line"),
        _issues(totals, _issue("total", "block", F.col("all_ordered") & off)),
    ]
    lines = rows.select("doc_id", "line_index", "po_line", F.when(receipt, zero("received")).alias("received"), F.col("paid_for").alias("accepted"), "payable")
    return lines, reduce(DataFrame.unionByName, found)


def match_results(invoices: DataFrame, order_lines: DataFrame, lines: DataFrame, issues: DataFrame) -> DataFrame:
    """doc_id, status (incomplete, mismatch or matched), blocks, notes, payable: one row an invoice, from ``three_way``."""
    counted = issues.groupBy("doc_id").agg(F.count_if(F.col("severity") == "block").alias("blocks"), F.count_if(F.col("severity") == "warn").alias("notes"))
    billed = lines.groupBy("doc_id").agg(F.sum("payable").cast("decimal(18,2)").alias("payable"), F.lit(True).alias("has_lines"))
    ordered = order_lines.select("doc_id").distinct().withColumn("has_order", F.lit(True))
    rows = reduce(lambda a, b: a.join(b.hint("merge"), "doc_id", "left"), (counted, billed, ordered), invoices.select("doc_id"))
    blocks, notes = (F.coalesce(x, F.lit(0)) for x in ("blocks", "notes"))
    status = F.when(F.col("has_lines").isNull() | F.col("has_order").isNull(), "incomplete").when(blocks > 0, "mismatch").otherwise("matched")
    return rows.select("doc_id", status.alias("status"), blocks.cast("bigint").alias("blocks"), notes.cast("bigint").alias("notes"), F.col("payable").cast("double").alias("payable"))
