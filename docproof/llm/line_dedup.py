"""Removal of repeated passages by overlapping windows of three lines, with DataFrame functions only.

Every run of three consecutive lines is hashed (twice 64 bits). Of the places where a window occurs anywhere in the
corpus, the first - smallest doc_id, then smallest line number - stays; the lines that later occurrences cover are merged
per document and removed. A passage of n >= 3 repeated lines is covered by n - 2 overlapping windows, so it goes whole.

The windows travel as hashes. At the end only texts that may lose lines shuffle: their keys fall into buckets of which
the occupied ones are known, at most ``BUCKETS``; all other texts pass straight. With m texts that lose lines, a share of
1 - exp(-m / BUCKETS) of the others shuffles along: 1 % at 10 thousand, 9 % at 100 thousand, 61 % at a million; beyond
some millions every text does, with the same result. The count of windows is pre-aggregated before its shuffle, and the join back reads
written tables, so adaptive execution can split a window that very many documents share.

A row is known by its id and a digest of its text, so rows that share an id, or have none, keep their own lines.

Defined results: null text counts as empty and has no lines; texts of fewer than three lines stay as they are; windows of
blank lines only (white space of any ASCII kind) do not count; a null id sorts after all others, and rows of one id by their texts' digests; rows equal
in id and text are one document, repeated, and lose the same lines. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docproof.llm.common import plain, save

WIDTH = 3
#: A line that is not blank.
SAID = r"[^\x20\x09-\x0D]"
#: A row's identity: whether it has no id, its id, and the first 60 bits of its text's digest.
KEY = ["lone", "id", "print"]
#: Of the keys' hashes; the occupied ones are broadcast, at most this many 8-byte numbers.
BUCKETS = 1 << 20


def _windows(docs: DataFrame) -> DataFrame:
    """The key, pos, a, b: a row for each window, where a and b are its two hashes."""
    line = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"), x.rlike(SAID).alias("said"))
    hashed = docs.select(*KEY, F.transform(F.split("text", "\n"), line).alias("h")).where(F.size("h") >= WIDTH)
    parts = [F.slice("h", F.lit(i + 1), F.size("h") - (WIDTH - 1)) for i in range(WIDTH)]
    zipped = F.arrays_zip(*[p.alias(f"l{i}") for i, p in enumerate(parts)])
    rows = hashed.select(*KEY, F.posexplode(zipped).alias("pos", "w"))
    at = [F.col("w").getField(f"l{i}") for i in range(WIDTH)]
    said = at[0]["said"] | at[1]["said"] | at[2]["said"]
    return rows.where(said).select(*KEY, "pos", F.xxhash64(*[x["a"] for x in at]).alias("a"), F.xxhash64(*[x["b"] for x in at]).alias("b"))


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_lines, n_removed and text (what is left)."""
    text, key = plain(text_col), F.col(id_col).cast("long")
    base = docs.select(key.isNull().alias("lone"), F.coalesce(key, F.lit(0)).alias("id"), F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("print"), text.alias("text"))
    windows = save(_windows(base), "windows")
    place = F.struct(*KEY, "pos")
    first = save(windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("a", "b", "first"), "repeated")
    later = windows.join(first, ["a", "b"]).where(place != F.col("first")).select(*KEY, "pos")
    covered = later.select(*KEY, F.explode(F.sequence("pos", F.col("pos") + (WIDTH - 1))).alias("line")).distinct().groupBy(*KEY).agg(F.collect_list("line").alias("covered"))
    covered = save(covered, "covered")
    # texts that surely lose nothing pass straight; only those in a bucket of a covered document meet their lines
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS))
    buckets = F.broadcast(covered.select(bucket.alias("bucket")).distinct())
    lines = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n"))
    placed = base.withColumn("bucket", bucket)
    straight = placed.join(buckets, "bucket", "left_anti").select(*KEY, F.size(lines).alias("n"), F.lit(0).alias("gone"), "text")
    rows = placed.join(buckets, "bucket", "left_semi").select(*KEY, lines.alias("lines")).join(covered.hint("merge"), KEY, "left")
    kept = F.when(F.col("covered").isNull(), F.col("lines")).otherwise(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "covered"), lambda i: F.get("lines", i)))
    cut = rows.select(*KEY, F.size("lines").alias("n"), F.coalesce(F.size("covered"), F.lit(0)).alias("gone"), F.array_join(kept, "\n").alias("text"))
    return straight.unionByName(cut).select(
        F.when(~F.col("lone"), F.col("id")).alias("doc_id"), F.col("n").cast("long").alias("n_lines"), F.col("gone").cast("long").alias("n_removed"), "text"
    )
