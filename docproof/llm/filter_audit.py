"""How filters interact: what each removes in every order, and its Shapley share of all removals.

Each row gets a mask of the filters that it fails; rows count by part and mask. A part's removals are then the
multilinear polynomial f(x) = sum over masks m of n(m) * (1 - product over i in m of (1 - x_i)): at the corner where
exactly the filters of S are 1 it is the number of rows that S removes. Its coefficient at the set T is
-(-1)^|T| * (rows that fail all of T). Survivors, removals and rows that fail one filter only are corner values; a
filter's Shapley value is the integral of its partial derivative along the diagonal from 0 to 1, which for each
coefficient is c(T) / |T|: exact rationals, scaled by the number of orders. The same polynomials of labelled rows give
what an order loses of them.

Rows are reduced to narrow ones (id, part, mask, digest of the text) before anything shuffles. A repeat is known by its
group's smallest id: groups are counted by digest, part, labels and mask first, so that a group of any size is a few
rows when its digest meets the others.

Defined results: null text counts as empty; null lang is the part ''; a null id is smaller than none and has none
smaller, so it fails no repeat filter and makes no other row fail; of rows that share the smallest id of a text none
fails; of several label rows of an id the largest value counts; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docproof.llm.common import SPACE, plain, save

MIN_WORDS = 200
MIN_DISTINCT = 50
MAX_CAPITALS = 3
SIGNS = "#$%&*|"
#: The filter that compares rows with each other; the others look at a row's own text.
REPEAT = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """letter -> whether a text fails: A under 200 words, B under 50 % distinct words, C over 3 % capitals, D holds a sign."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words),
        "C": 100 * capitals.cast("long") > MAX_CAPITALS * F.char_length(text),
        "D": text.rlike(f"[{SIGNS}]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: rows by the set of filters that they fail. Bit i of ``mask`` is the i-th of ``filters``
    (default: ``text_filters``), the last one the repeat filter."""
    text = plain(text_col)
    filters = text_filters(text) if filters is None else filters
    own = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(False)).cast("int") * (1 << i) for i, x in enumerate(filters.values())], F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), plain(part_col).alias("part"), own.alias("own"), F.unhex(F.sha2(text, 256)).alias("print"))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = rows.join(known, rows["id"] == known["label_id"], "left")
    flags = [F.coalesce(F.col(x) == 1, F.lit(False)).alias(y) for x, y in (("quality", "is_good"), ("toxic", "is_toxic"))]
    kind = ["print", "part", "own", "is_good", "is_toxic"]
    by_id = rows.select("id", "part", "own", "print", *flags).groupBy("id", *kind).agg(F.count("*").alias("n"))
    groups = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"), F.sum(F.when(F.col("id").isNull(), F.col("n"))).alias("n_null"))
    groups = save(groups, "audit-groups")  # read twice below; texts are read once
    least = groups.groupBy("print").agg(F.min("first").alias("least"))
    groups = groups.join(least.withColumnRenamed("print", "of"), F.col("print") == F.col("of"))
    stay = F.coalesce("n_null", F.lit(0)) + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    repeat = 1 << len(filters)
    both = groups.select("part", "is_good", "is_toxic", F.explode(F.array(F.struct(F.col("own").alias("mask"), stay.alias("n")), F.struct((F.col("own") + repeat).alias("mask"), (F.col("n") - stay).alias("n")))).alias("x"))
    count = F.col("x.n")
    return both.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum(count).alias("n"), F.sum(F.when(F.col("is_good"), count).otherwise(0)).alias("good"), F.sum(F.when(F.col("is_toxic"), count).otherwise(0)).alias("toxic"))


def coefficients(counts: dict[int, int], size: int) -> list[int]:
    """Coefficient of the removal polynomial at each set of filters (bits)."""
    fails_all = [sum(n for m, n in counts.items() if m & t == t) for t in range(1 << size)]
    return [0] + [fails_all[t] * (1 if t.bit_count() % 2 else -1) for t in range(1, 1 << size)]


def corner(poly: list[int], chosen: int) -> int:
    """The polynomial where exactly the ``chosen`` filters are 1: the rows that these remove."""
    return sum(c for t, c in enumerate(poly) if t & chosen == t)


def shapley(poly: list[int], i: int) -> Fraction:
    """The integral over t from 0 to 1 of the i-th partial derivative at (t, ..., t)."""
    return sum((Fraction(c, t.bit_count()) for t, c in enumerate(poly) if t >> i & 1), Fraction(0))


def orders(part: str, counts: dict[int, tuple[int, int, int]], letters: str) -> Iterator[tuple]:
    """The rows of one part: every order of the filters, step by step."""
    size = len(letters)
    everything = (1 << size) - 1
    rows, good, toxic = (coefficients({m: x[k] for m, x in counts.items()}, size) for k in range(3))
    total = sum(x[0] for x in counts.values())
    value = {s: (corner(rows, s), corner(good, s), corner(toxic, s)) for s in range(everything + 1)}
    share = [shapley(rows, i) * factorial(size) for i in range(size)]
    for order in permutations(range(size)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed, lost_good, lost_toxic = (a - b for a, b in zip(value[after], value[before], strict=True))
            alone = value[everything][0] - value[everything ^ 1 << i][0]
            yield part, "".join(letters[x] for x in order), step, total - value[after][0], removed, value[1 << i][0] - removed, alone, lost_good, lost_toxic, int(share[i])
            before = after


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """A row per part, order of the filters and step, of ``mask_counts``. A part is at most 2^len(letters) counts."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, found in zip(batch["part"], batch["counts"], strict=True):
                by_mask = {int(x["mask"]): (int(x["n"]), int(x["good"]), int(x["toxic"])) for x in found}
                yield pd.DataFrame(orders(part, by_mask, letters), columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return parts.mapInPandas(run, SCHEMA)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters A to E over whole texts, E being the repeat of a smaller id's text."""
    return audit(mask_counts(docs, labels), "ABCD" + REPEAT)
