"""Dashboards and measures over documents and fields: one pass of conditional aggregates each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docproof.settings import DEFAULTS, Settings

#: The quality buckets of a labelled evaluation that stand for a condition (fixed values).
BENCHMARK = {"printed": ("digital", "good_scan", "printed", "poor_scan"), "vernacular": ("bilingual", "vernacular"), "handwritten": ("handwritten",)}
DONE = ("ready", "exported")


def percent(n: Column, d: Column) -> Column:
    """100 n / d to one decimal place, half up on decimals; null where d is 0."""
    return F.round((F.lit(100) * n.cast("decimal(18,0)") / F.nullif(d, F.lit(0).cast("bigint")).cast("decimal(18,0)")).cast("decimal(18,8)"), 1).cast("double")


def needed_review() -> Column:
    """Sent to a person because something was flagged, not merely for a spot check."""
    return F.col("review_entered_at").isNotNull() & (~F.col("is_qa_sample") | (F.coalesce("fields_flagged", F.lit(0)) > 0))


def vernacular() -> Column:
    return F.exists(F.split("languages", ","), lambda x: ~x.isin("english", "other"))


def with_field_counts(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Documents with their fields' counts: total, flagged, corrected, caught (corrected among flagged), looked_at."""
    counts = fields.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("fields_total"),
        F.count_if("needs_review").alias("fields_flagged"),
        F.count_if(F.col("status") == "corrected").alias("fields_corrected"),
        F.count_if((F.col("status") == "corrected") & F.col("needs_review")).alias("fields_caught"),
        F.count_if(~F.col("needs_review")).alias("fields_open"),
        F.count_if(~F.col("needs_review") & (F.col("status") == "corrected")).alias("fields_escaped"),
        F.min("score").alias("least_score"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in counts.columns if c.startswith("fields_")}
    return docs.join(counts, "doc_id", "left").withColumns(zero)


def _minutes(a: str, b: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, {a}, {b})") / 60


def dashboard(docs: DataFrame, days: int = 30, s: Settings = DEFAULTS) -> DataFrame:
    """One row a tenant, of documents with field counts: today, queue, turnaround, accuracy, time saved, totals."""
    now = F.lit(s.as_of).cast("timestamp_ntz")
    recent = F.col("created_at") >= now - F.expr(f"interval {days} days")
    today = recent & (F.col("created_at") >= F.date_trunc("day", now))
    finished = recent & F.col("status").isin(*DONE) & F.col("processed_at").isNotNull()
    waiting = F.col("reviewed_at").isNull() & F.col("status").isin("needs_review", "unreadable")
    reviewed = recent & F.col("reviewed_at").isNotNull() & needed_review()
    took = F.when(reviewed, _minutes("review_entered_at", "reviewed_at"))
    n = lambda c: F.count_if(c)
    total = lambda c, value: F.coalesce(F.sum(F.when(c, value)), F.lit(0))
    fields, corrected = total(finished, F.col("fields_total")), total(finished, F.col("fields_corrected"))
    return docs.groupBy("tenant_id").agg(
        n(today & F.col("processed_at").isNotNull()).alias("today_processed"),
        n(today).alias("today_received"),
        n(today & needed_review()).alias("today_needed_review"),
        n(today & F.col("status").isin(*DONE)).alias("today_ready"),
        n(waiting).alias("queue_open"),
        n(waiting & (F.col("review_due_at") < now)).alias("queue_overdue"),
        F.min(F.when(waiting, F.col("review_due_at"))).cast("string").alias("queue_oldest_due"),
        F.round(F.avg(took), 3).alias("turnaround_average"),
        F.round(F.median(took), 3).alias("turnaround_median"),
        percent(n(reviewed & (F.col("reviewed_at") <= F.col("review_due_at"))), n(reviewed)).alias("on_time_pct"),
        n(reviewed).alias("reviewed"),
        percent(fields - corrected, fields).alias("first_pass_accuracy_pct"),
        percent(n(finished & (F.col("fields_flagged") == 0)), n(finished)).alias("straight_through_pct"),
        F.round((total(finished, F.col("fields_total") - F.col("fields_flagged")) * s.seconds_per_field).cast("decimal(18,4)") / 3600, 1).cast("double").alias("time_saved_hours"),
        n(recent).alias("documents"),
        n(finished).alias("completed"),
    )


def daily_trend(docs: DataFrame) -> DataFrame:
    rows = docs.where(F.col("status").isin(*DONE) & F.col("processed_at").isNotNull())
    return rows.groupBy(F.date_format("processed_at", "yyyy-MM-dd").alias("day")).agg(percent(F.sum(F.col("fields_total") - F.col("fields_corrected")), F.sum("fields_total")).alias("accuracy"), percent(F.count_if(F.col("fields_flagged") == 0), F.count(F.lit(1))).alias("straight_through"), F.count(F.lit(1)).alias("documents"))


def by_type(docs: DataFrame) -> DataFrame:
    return docs.where("doc_type is not null").groupBy("doc_type").agg(F.count(F.lit(1)).alias("documents"), F.count_if(needed_review()).alias("needed_review"))


def spot_check(docs: DataFrame) -> DataFrame:
    """Accuracy of the fields that nobody was asked about, on documents that were checked as a sample."""
    rows = docs.where(F.col("is_qa_sample") & F.col("reviewed_at").isNotNull())
    return rows.agg(percent(F.sum(F.col("fields_open") - F.col("fields_escaped")), F.sum("fields_open")).alias("accuracy_pct"), F.count(F.lit(1)).alias("documents"), F.sum("fields_open").alias("fields"), F.sum("fields_escaped").alias("escapes"))


def slices(fields: DataFrame, docs: DataFrame) -> DataFrame:
    """Measures by type, quality, language and handwriting, from one join: documents fan out to their four keys."""
    key = lambda dim, value: F.struct(F.lit(dim).alias("dimension"), value.alias("slice"))
    keys = F.array(
        key("doc_type", F.coalesce("doc_type", F.lit("unknown"))),
        key("quality", F.coalesce("quality_bucket", F.lit("unknown"))),
        key("language", F.when(F.exists(F.split("languages", ","), lambda x: x != "english"), "hindi/bilingual").otherwise("english_only")),
        key("handwriting", F.when(F.col("has_handwriting"), "handwriting").otherwise("printed")),
    )
    sampled = F.col("is_qa_sample") & F.col("reviewed_at").isNotNull()
    rows = docs.where(F.col("status").isin(*DONE) & F.col("processed_at").isNotNull())
    rows = with_field_counts(rows, fields).where("fields_total > 0").select(F.explode(keys).alias("k"), "*")
    return rows.groupBy("k.dimension", "k.slice").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("fields_total").alias("fields"),
        percent(F.sum(F.col("fields_total") - F.col("fields_corrected")), F.sum("fields_total")).alias("first_pass_accuracy_pct"),
        percent(F.sum("fields_flagged"), F.sum("fields_total")).alias("field_review_rate_pct"),
        F.sum(F.when(sampled, F.col("fields_open")).otherwise(0)).alias("spot_check_fields"),
        percent(F.sum(F.when(sampled, F.col("fields_escaped")).otherwise(0)), F.sum(F.when(sampled, F.col("fields_open")).otherwise(0))).alias("escape_rate_pct"),
    )


def conditions(docs: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Accuracy by overlapping conditions; below ``least_fields`` a figure is no claim."""
    hand = F.col("has_handwriting")
    names = F.array_compact(F.array(F.lit("overall"), F.when(~vernacular() & ~hand, "printed"), F.when(vernacular(), "vernacular"), F.when(hand, "handwritten")))
    rows = docs.where(F.col("status").isin(*DONE) & F.col("processed_at").isNotNull()).select(F.explode(names).alias("condition"), "*")
    fields, wrong = F.sum("fields_total"), F.sum("fields_corrected")
    return rows.groupBy("condition").agg(F.count(F.lit(1)).alias("documents"), fields.alias("fields"), percent(fields - wrong, fields).alias("accuracy_pct"), (fields >= s.least_fields).alias("measured"), percent(F.sum("fields_caught"), wrong).alias("caught_pct"), percent(F.count_if(F.col("fields_flagged") == 0), F.count(F.lit(1))).alias("no_review_pct"))


def conditions_report(docs: DataFrame, evaluated: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """``conditions`` with what backs each: spot_accuracy_pct, spot_documents and spot_fields of its sampled and reviewed documents, trend (day and
    accuracy of each processed day) and benchmark_pct of the labelled evaluation. Documents have their fields' counts."""
    hand = F.col("has_handwriting")
    names = F.array_compact(F.array(F.lit("overall"), F.when(~vernacular() & ~hand, "printed"), F.when(vernacular(), "vernacular"), F.when(hand, "handwritten")))
    rows = docs.where(F.col("status").isin(*DONE) & F.col("processed_at").isNotNull()).select(F.explode(names).alias("condition"), "*")
    spot = rows.where(F.col("is_qa_sample") & F.col("reviewed_at").isNotNull()).groupBy("condition").agg(percent(F.sum(F.col("fields_open") - F.col("fields_escaped")), F.sum("fields_open")).alias("spot_accuracy_pct"), F.count("*").alias("spot_documents"), F.sum("fields_open").alias("spot_fields"))
    daily = rows.groupBy("condition", F.date_format("processed_at", "yyyy-MM-dd").alias("day")).agg(percent(F.sum(F.col("fields_total") - F.col("fields_corrected")), F.sum("fields_total")).alias("accuracy"))
    trend = daily.groupBy("condition").agg(F.array_sort(F.collect_list(F.struct("day", "accuracy"))).alias("trend"))  # a row a day
    bench = benchmark(evaluated).select("condition", F.col("field_accuracy_pct").alias("benchmark_pct"))
    found = conditions(docs, s)
    for part in (spot, trend, bench):
        found = found.join(part, "condition", "left")
    return found


def run_costs(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """doc_id, cost: what the calls for each document cost, by tokens and the prices of a million of them. runs: doc_id, model,
    tokens_in, tokens_cached (part of tokens_in), tokens_out, error; prices: model, price_in, price_cached, price_out. Failed calls are not charged;
    a model without a price makes the cost unknown."""
    million = F.lit(1_000_000)
    rows = runs.where("error is null").join(F.broadcast(prices), "model", "left")  # a row a model
    fresh = F.col("tokens_in") - F.col("tokens_cached")
    cost = (fresh * F.col("price_in") + F.col("tokens_cached") * F.col("price_cached") + F.col("tokens_out") * F.col("price_out")) / million
    whole = F.when(F.count("*") == F.count(cost), F.sum(cost.cast("decimal(28,10)")))
    return rows.groupBy("doc_id").agg(F.round(whole, 4).cast("double").alias("cost"))


def calibration(fields: DataFrame) -> DataFrame:
    bucket = F.least(F.lit(9), F.floor(F.round(F.col("score").cast("decimal(9,4)") * 10, 4))).cast("int")
    return fields.where(F.col("status").isin("confirmed", "corrected")).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("reviewed"), percent(F.count_if(F.col("status") == "corrected"), F.count(F.lit(1))).alias("error_rate_pct"))


def nearest_quantile(rows: DataFrame, key: str, value: str, *qs: float) -> DataFrame:
    """Of each key's sorted values the one at index min(n - 1, floor(q n)) from 0. Values are counted first, so that a key's rows
    never meet in one task uncounted."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(key).orderBy(value)
    placed = counted.withColumns({"last": F.sum("c").over(upto), "n": F.sum("c").over(Window.partitionBy(key))})
    at = lambda q: F.least(F.col("n") - 1, F.floor(F.lit(str(q)).cast("decimal(9,4)") * F.col("n")))
    return placed.groupBy(key).agg(*[F.min(F.when(F.col("last") > at(q), F.col(value))).alias(f"q{round(100 * q)}") for q in qs])


def efficiency(docs: DataFrame, runs: DataFrame, fields: DataFrame) -> DataFrame:
    """Calls a document, and shares of documents with one call and of fields proven and re-read."""
    calls = runs.where("error is null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("calls"))
    of_docs = docs.select("doc_id").join(calls, "doc_id", "left").agg(F.round(F.avg(F.coalesce("calls", F.lit(0))), 4).alias("calls_per_doc"), percent(F.count_if(F.col("calls") == 1), F.count(F.lit(1))).alias("one_call_pct"))
    of_fields = fields.agg(percent(F.count_if("proven"), F.count(F.lit(1))).alias("proven_pct"), percent(F.count_if("agree"), F.count(F.lit(1))).alias("reread_pct"))
    return of_docs.join(of_fields)


def evaluation_cells(docs: DataFrame) -> DataFrame:
    """Cells of type and quality with the gate's reasons: too few documents, escapes, accuracy."""
    cell = docs.where("doc_type is not null").groupBy("doc_type", F.coalesce("quality_bucket", F.lit("unknown")).alias("quality")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("fields_total").alias("fields"), percent(F.sum("fields_escaped"), F.sum("fields_open")).alias("escape_rate_pct"), percent(F.sum(F.col("fields_total") - F.col("fields_corrected")), F.sum("fields_total")).alias("accuracy_pct")
    )
    reasons = F.array_compact(F.array(F.when(F.col("documents") < 20, "documents"), F.when(F.coalesce(F.col("escape_rate_pct") > 0.5, F.lit(True)), "escapes"), F.when(F.coalesce(F.col("accuracy_pct") < 97, F.lit(True)), "accuracy")))
    return cell.withColumn("reasons", F.array_join(reasons, ",")).withColumn("passed", F.col("reasons") == "")


def percent2(n: Column, d: Column) -> Column:
    """100 n / d to two decimal places, half up on decimals; null where d is 0."""
    return F.round((F.lit(100) * n.cast("decimal(18,0)") / F.nullif(d.cast("bigint"), F.lit(0).cast("bigint")).cast("decimal(18,0)")).cast("decimal(18,8)"), 2).cast("double")


def internal_metrics(docs: DataFrame, fields: DataFrame, days: int = 30, s: Settings = DEFAULTS) -> DataFrame:
    """Finished documents of all tenants in the window, sliced by type, quality, language and handwriting and as a whole, in one
    pass of grouping sets over documents with their fields' counts: dimension, slice and six measures."""
    since = F.lit(s.as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    sampled = F.col("is_qa_sample") & F.col("reviewed_at").isNotNull()
    cut = {
        "by_doc_type": F.coalesce("doc_type", F.lit("unknown")),
        "by_quality_bucket": F.coalesce("quality_bucket", F.lit("unknown")),
        "by_language": F.when(F.exists(F.split("languages", ","), lambda x: x != "english"), "hindi/bilingual").otherwise("english_only"),
        "by_handwriting": F.when(F.col("has_handwriting"), "handwriting").otherwise("printed"),
    }
    rows = docs.where((F.col("created_at") >= since) & F.col("processed_at").isNotNull() & F.col("status").isin(*DONE))
    rows = with_field_counts(rows, fields).where("fields_total > 0").withColumns(cut | {"spot": F.when(sampled, F.col("fields_open")).otherwise(0), "spot_wrong": F.when(sampled, F.col("fields_escaped")).otherwise(0)})
    found = rows.groupingSets([[], *[[x] for x in cut]], *cut).agg(
        F.grouping_id().alias("set"), F.count("*").alias("documents"), F.sum("fields_total").alias("fields"),
        percent(F.sum(F.col("fields_total") - F.col("fields_corrected")), F.sum("fields_total")).alias("first_pass_accuracy_pct"), percent(F.sum("fields_flagged"), F.sum("fields_total")).alias("field_review_rate_pct"),
        F.sum("spot").cast("bigint").alias("spot_check_fields"), percent(F.sum("spot_wrong"), F.sum("spot")).alias("escape_rate_pct"),
    )
    names = F.array(*map(F.lit, cut))
    given = F.array_position(F.array(*[F.col(x).isNotNull() for x in cut]), F.lit(True)).cast("int")
    whole = F.col("set") == (1 << len(cut)) - 1
    return found.select(F.when(whole, "overall").otherwise(F.get(names, given - 1)).alias("dimension"), F.coalesce(*cut, F.lit("all")).alias("slice"), "documents", "fields", "first_pass_accuracy_pct", "field_review_rate_pct", "spot_check_fields", "escape_rate_pct")


def internal_totals(docs: DataFrame, runs: DataFrame, corrections: DataFrame, days: int = 30, s: Settings = DEFAULTS) -> DataFrame:
    """One row of the window: documents, latencies, calls and errors, turnaround, share on time, seconds a field. Quantiles are
    values at the nearest index, found from counts of values."""
    since = F.lit(s.as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    one = F.lit(1).alias("one")
    recent = docs.where((F.col("created_at") >= since) & F.col("processed_at").isNotNull())
    reviewed = recent.where("reviewed_at is not null and review_entered_at is not null")
    late = nearest_quantile(recent.where("processing_ms <> 0").select(one, "processing_ms"), "one", "processing_ms", 0.5, 0.95).select("one", F.col("q50").alias("latency_p50"), F.col("q95").alias("latency_p95"))
    turn = nearest_quantile(reviewed.select(one, _minutes("review_entered_at", "reviewed_at").alias("minutes")), "one", "minutes", 0.5, 0.9).select("one", F.col("q50").alias("turnaround_p50_min"), F.col("q90").alias("turnaround_p90_min"))
    spent = nearest_quantile(corrections.where(F.col("created_at") >= since).where("time_on_field_ms <> 0").select(one, "time_on_field_ms"), "one", "time_on_field_ms", 0.5).select("one", F.round(F.col("q50") / 1000, 1).cast("double").alias("seconds_per_field_p50"))
    rows = recent.groupBy().agg(F.count("*").alias("documents")).withColumn("one", F.lit(1))
    on_time = reviewed.groupBy().agg(percent(F.count_if(F.col("reviewed_at") <= F.col("review_due_at")), F.count("*")).alias("on_time_pct")).withColumn("one", F.lit(1))
    calls = runs.where(F.col("created_at") >= since).groupBy().agg(F.count("*").alias("model_calls"), F.count("error").alias("model_errors")).withColumn("one", F.lit(1))
    for part in (late, turn, spent, on_time, calls):
        rows = rows.join(part, "one", "left")
    return rows.drop("one")


def evaluation(evaluated: DataFrame) -> DataFrame:
    """The thirteen measures of each cell (doc_type, bucket) of evaluated documents, and of all together (both null): documents,
    unreadable_or_failed, field_accuracy_pct, auto_accept_pct, escape_rate_pct, error_catch_rate_pct, straight_through_docs_pct,
    all_fields_correct_docs_pct, mean_seconds, mean_cost, synthetic_docs, trap_violations, doc_type_accuracy_pct.

    Needs doc_type, bucket (neither null), status, fields, auto, wrong, correct, auto_wrong, wrong_flagged, seconds, cost, synthetic, traps,
    type_got."""
    n, count = F.count("*"), F.count_if
    mean = lambda x, places: F.round(F.sum(F.col(x).cast("decimal(18,6)")) / n, places).cast("double")
    cells = evaluated.withColumn("own_type", F.col("doc_type")).groupingSets([["doc_type", "bucket"], []], "doc_type", "bucket").agg(
        n.alias("documents"), count(F.col("status").isin("unreadable", "failed")).alias("unreadable_or_failed"), percent2(F.sum("correct"), F.sum("fields")).alias("field_accuracy_pct"), percent2(F.sum("auto"), F.sum("fields")).alias("auto_accept_pct"),
        percent2(F.sum("auto_wrong"), F.sum("auto")).alias("escape_rate_pct"), percent2(F.sum("wrong_flagged"), F.sum("wrong")).alias("error_catch_rate_pct"), percent2(count(F.col("status") == "ready"), n).alias("straight_through_docs_pct"),
        percent2(count((F.col("fields") > 0) & (F.col("wrong") == 0)), n).alias("all_fields_correct_docs_pct"), mean("seconds", 1).alias("mean_seconds"), mean("cost", 4).alias("mean_cost"),
        count("synthetic").alias("synthetic_docs"), F.sum("traps").cast("bigint").alias("trap_violations"), percent2(count(F.col("type_got") == F.col("own_type")), n).alias("doc_type_accuracy_pct"),
    )
    return cells.where("documents > 0")


#: What a cell must reach to be shown (fixed values).
GATE = {"documents": 20, "escape_rate_pct": 0.5, "field_accuracy_pct": 97.0}


def gate(cells: DataFrame) -> DataFrame:
    """doc_type, bucket, reasons, demo_safe: why a cell of ``evaluation`` may not be shown."""
    asked = F.array(
        F.when(F.col("synthetic_docs") > 0, "contains synthetic documents"),
        F.when(F.col("documents") < GATE["documents"], F.concat(F.lit("only "), "documents", F.lit(f" docs (need {GATE['documents']})"))),
        F.when(F.coalesce(F.col("escape_rate_pct") > GATE["escape_rate_pct"], F.lit(True)), F.concat(F.lit("escape rate "), F.coalesce(F.col("escape_rate_pct").cast("string"), F.lit("unknown")), F.lit(f" above {GATE['escape_rate_pct']}"))),
        F.when(F.col("trap_violations") > 0, F.concat("trap_violations", F.lit(" blank or illegible trap fields accepted with a value"))),
        F.when(F.coalesce(F.col("field_accuracy_pct") < GATE["field_accuracy_pct"], F.lit(True)), F.concat(F.lit("field accuracy "), F.coalesce(F.col("field_accuracy_pct").cast("string"), F.lit("unknown")), F.lit(f" below {GATE['field_accuracy_pct']}"))),
    )
    return cells.where("doc_type is not null").select("doc_type", "bucket", F.array_compact(asked).alias("reasons")).withColumn("demo_safe", F.size("reasons") == 0)


def benchmark(evaluated: DataFrame) -> DataFrame:
    """Accuracy by condition from evaluated documents (bucket, synthetic, fields, auto, correct, auto_wrong); synthetic ones do not count."""
    names = F.array_compact(F.array(F.lit("overall"), *[F.when(F.col("bucket").isin(*buckets), name) for name, buckets in BENCHMARK.items()]))
    rows = evaluated.where(~F.coalesce("synthetic", F.lit(False))).select(F.explode(names).alias("condition"), "*")
    found = rows.groupBy("condition").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("fields").alias("fields"), percent(F.sum("correct"), F.sum("fields")).alias("field_accuracy_pct"), percent(F.sum("auto_wrong"), F.sum("auto")).alias("escape_rate_pct")
    )
    return found.where("fields > 0")


def readiness(gate: DataFrame) -> DataFrame:
    """One row: which cells of a gate report (doc_type, quality, passed) may be shown; no_eval_run for an empty report."""
    passed = F.array_sort(F.collect_list(F.when(F.col("passed"), F.concat_ws("/", "doc_type", "quality"))))
    return gate.agg(F.when(F.count(F.lit(1)) > 0, "ok").otherwise("no_eval_run").alias("status"), F.count(F.lit(1)).alias("cells"), passed.alias("ready"))


def offline_summary(checked: DataFrame) -> DataFrame:
    """Per bucket of checked documents (bucket, quality_bucket, unreadable_reason, corrections, codes, compared, disagree,
    checks_run, checks_failed, ms): counts, the quality buckets as a map, and the mean time."""
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    part = checked.groupBy("bucket", "quality_bucket").agg(
        F.count(F.lit(1)).alias("docs"), F.count("unreadable_reason").alias("refused_unreadable"), F.count_if(some("corrections")).alias("auto_corrected"), F.count_if(some("codes")).alias("docs_with_codes"),
        *[F.sum(c).alias(c) for c in ("compared", "disagree", "checks_run", "checks_failed", "ms")],
    )
    kinds = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("quality_bucket").isNotNull(), F.struct("quality_bucket", "docs")))))
    total = lambda c, name: F.sum(c).alias(name)
    return part.groupBy("bucket").agg(
        total("docs", "docs"), kinds.alias("quality_buckets"), *[total(c, c) for c in ("refused_unreadable", "auto_corrected", "docs_with_codes")], total("compared", "code_fields_compared"),
        total("disagree", "code_fields_disagree"), total("checks_run", "checks_run"), total("checks_failed", "checks_failed_on_truth"), F.round(F.sum("ms") / F.sum("docs")).cast("long").alias("mean_ms"),
    )


def report(cells: DataFrame) -> DataFrame:
    """Each of ``evaluation_cells`` as a line of JSON and one of Markdown. Write either column as text."""
    rows = cells.withColumn("gate", F.when(F.col("passed"), "pass").otherwise("fail"))
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("doc_type", "quality", "documents", "accuracy_pct", "escape_rate_pct", "gate")]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |"))
    return rows.select("doc_type", "quality", F.to_json(F.struct(*rows.columns)).alias("json"), line.alias("markdown"))
