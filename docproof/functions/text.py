"""Similarity of strings by their longest common subsequence, as expressions of the JVM.

The subsequence is found by rows of bits: a word of ``BITS`` positions of the shorter string per step, a step per letter of
the longer one. Words have 62 bits, so that a sum of two with its carry stays in a signed 64-bit number. ``words_alike``, which
joins run over many pairs of few different texts, goes by Arrow batches instead and scores each different pair of a batch once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 62


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def letters(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(?s)."), F.lit(0))


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _masks(chars: Column) -> Column:
    """letter -> the positions where it stands, as bits; of at most ``BITS`` letters."""
    bit = lambda i: F.call_function("shiftleft", _long(1), i)
    where = lambda y: F.aggregate(F.transform(chars, lambda c, i: F.when(c == y, bit(i)).otherwise(_long(0))), _long(0), lambda s, v: s + v)
    return bind(F.array_distinct(chars), lambda keys: F.map_from_arrays(keys, F.transform(keys, where)))


def _one_word(short: Column, long: Column) -> Column:
    size = F.size(short)
    full = F.call_function("shiftleft", _long(1), size) - 1

    def run(x: Column) -> Column:
        hit = lambda row, y: row.bitwiseAND(F.coalesce(F.element_at(x["masks"], y), _long(0)))
        step = lambda row, y: bind(hit(row, y), lambda u: (row + u).bitwiseOR(row - u).bitwiseAND(x["full"]))
        return F.bit_count(F.aggregate(x["long"], x["full"], step))

    return size - bind(F.struct(_masks(short).alias("masks"), full.alias("full"), long.alias("long")), run)


def _many_words(short: Column, long: Column) -> Column:
    """As ``_one_word`` over an array of words, lowest first, with the carry of each into the next."""
    every, size = (1 << BITS) - 1, F.size(short)
    parts = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / BITS).cast("int")), lambda w: F.slice(short, w * BITS + 1, F.lit(BITS)))
    words = F.transform(parts, lambda p: F.struct(_masks(p).alias("masks"), (F.call_function("shiftleft", _long(1), F.size(p)) - 1).alias("full")))

    def step(x: Column, row: Column, y: Column) -> Column:
        def word(state: Column, w: Column) -> Column:
            old, at = row[w], x["words"][w]
            u = old.bitwiseAND(F.coalesce(F.element_at(at["masks"], y), _long(0)))
            return bind(u, lambda u: bind(old + u + state["carry"], lambda s: F.struct(
                F.array_append(state["row"], s.bitwiseAND(_long(every)).bitwiseOR(old - u).bitwiseAND(at["full"])).alias("row"), F.shiftright(s, BITS).alias("carry"))))

        none = F.struct(F.array().cast("array<bigint>").alias("row"), _long(0).alias("carry"))
        return F.aggregate(F.sequence(F.lit(0), F.size(x["words"]) - 1), none, word, lambda s: s["row"])

    def run(x: Column) -> Column:
        start = F.transform(x["words"], lambda w: w["full"])
        last = F.aggregate(x["long"], start, lambda row, y: step(x, row, y))
        return F.aggregate(last, F.lit(0), lambda n, w: n + F.bit_count(w))

    return size - bind(F.struct(words.alias("words"), long.alias("long")), run)


def common_length(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common subsequence; null where either string is."""
    a, b = letters(_c(a)), letters(_c(b))
    pair = F.when(F.size(a) <= F.size(b), F.struct(a.alias("short"), b.alias("long"))).otherwise(F.struct(b.alias("short"), a.alias("long")))

    def run(x: Column) -> Column:
        n = F.size(x["short"])
        return F.when(n == 0, 0).when(n <= BITS, _one_word(x["short"], x["long"])).otherwise(_many_words(x["short"], x["long"]))

    return F.when(a.isNotNull() & b.isNotNull(), bind(pair, run))


def ratio(a: Column | str, b: Column | str) -> Column:
    """200 * common / total letters; of two empty strings 100."""
    a, b = _c(a), _c(b)
    total = F.length(a) + F.length(b)
    return F.when(a == b, 100.0).when(total > 0, F.lit(200.0) * common_length(a, b) / total)


def token_set_ratio(a: Column | str, b: Column | str) -> Column:
    """The best ratio among the shared words and either side's words in order; 0 where a side has no words. The shared words
    begin both sides, so only the words that differ are compared letter by letter."""
    a, b = _c(a), _c(b)
    words = lambda x: F.array_sort(F.array_distinct(F.filter(F.split(x, r"\s+"), lambda w: w != "")))
    sets = bind(F.struct(words(a).alias("x"), words(b).alias("y")), lambda s: F.struct(
        s["x"].alias("x"), s["y"].alias("y"), *(F.array_join(w, " ").alias(n) for n, w in (("both", F.array_intersect(s["x"], s["y"])), ("left", F.array_except(s["x"], s["y"])), ("right", F.array_except(s["y"], s["x"]))))))

    def best(s: Column) -> Column:
        both, left, right = (F.length(s[n]) for n in ("both", "left", "right"))
        whole = lambda n: both + 1 + n
        shared = F.greatest(F.lit(200.0) * (both + 1 + common_length(s["left"], s["right"])) / (whole(left) + whole(right)), F.lit(200.0) * both / (both + whole(left)), F.lit(200.0) * both / (both + whole(right)))
        return F.when((F.size(s["x"]) == 0) | (F.size(s["y"]) == 0), 0.0).when((both > 0) & ((left == 0) | (right == 0)), 100.0).when(both == 0, ratio(s["left"], s["right"])).otherwise(shared)

    return F.when(a.isNotNull() & b.isNotNull(), bind(sets, best))


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one row of bits of any length."""
    a, b = sorted((a, b), key=len)
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for y in b:
        if hit := row & masks.get(y, 0):
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _ratio(a: str, b: str) -> float:
    return 100.0 if a == b else 200.0 * _common(a, b) / (len(a) + len(b))


def _alike(a: str, b: str) -> float:
    """The greater of ``token_set_ratio`` of two texts of words and ``ratio`` of their letters."""
    squashed = _ratio(a.replace(" ", ""), b.replace(" ", ""))
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return squashed
    both, left, right = (" ".join(sorted(w)) for w in (x & y, x - y, y - x))
    if not both:
        return max(squashed, _ratio(left, right))
    if not left or not right:
        return 100.0
    shared, n, m = len(both), len(both) + 1 + len(left), len(both) + 1 + len(right)
    return max(squashed, 200.0 * (shared + 1 + _common(left, right)) / (n + m), 200.0 * shared / (shared + n), 200.0 * shared / (shared + m))


#: Texts up to this length are remembered from batch to batch, with their scores.
SHORT = 200
_remembered = lru_cache(maxsize=20_000)(_alike)


def _alike_once(a: pa.Array, b: pa.Array) -> np.ndarray:
    """``_alike`` of two columns, of each different pair once; 0 where either is null."""
    a, b = a.dictionary_encode(), b.dictionary_encode()
    width = len(b.dictionary) + 1
    pairs, place = np.unique((a.indices.fill_null(-1).to_numpy().astype(np.int64) + 1) * width + b.indices.fill_null(-1).to_numpy() + 1, return_inverse=True)
    left, right = (None, *a.dictionary.to_pylist()), (None, *b.dictionary.to_pylist())
    texts = ((left[i], right[j]) for i, j in zip(*(k.tolist() for k in np.divmod(pairs, width)), strict=True))
    one = lambda x, y: 0.0 if x is None or y is None else (_remembered if len(x) + len(y) <= SHORT else _alike)(x, y)
    return np.array([one(x, y) for x, y in texts])[place]


def words_alike(a: Column | str, b: Column | str) -> Column:
    """The greater of ``token_set_ratio`` and, white space aside, ``ratio`` of two texts of words in ASCII; 0 where either is null."""

    @F.arrow_udf("double")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(_alike_once(a, b))

    return alike.asNondeterministic()(_c(a), _c(b))  # else a filter of its result runs it once more


def names_match(a: Column | str, b: Column | str, least: float = 85.0) -> Column:
    """Whether two company names are one: letters and digits alone, pvt and ltd spelled out; null where either is empty."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    bare = lambda x: F.regexp_replace(F.replace(F.replace(F.lower(x), F.lit("pvt"), F.lit("private")), F.lit("ltd"), F.lit("limited")), "[^a-z0-9]", "")
    return F.when((a != "") & (b != ""), ratio(bare(a), bare(b)) >= least)
