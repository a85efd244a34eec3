"""Near duplicates by SimHash with Golay-code fuzzy hashing.

A fingerprint has 64 bits, cut into four segments of 16. Two fingerprints that differ in at most 4 bits spread at most
4 errors over the segments, so by the pigeonhole principle one of these holds:

* some segment has no error, and then of the other three at least one has 0 or 1 (three with two each would be 6);
* every segment has exactly one error, and then each has one half without any.

A segment with at most one error is found through the binary Golay code [23, 12, 7]: read as a (shortened) 23-bit word,
every segment decodes to the one codeword within distance 3. The *filed* side keeps the index of that codeword. The
*asking* side emits the index for each word within one bit of its segment - few, because most of them decode alike - so
an error of one bit cannot hide a pair. Keys are (exact segment, codeword of another) and, for the last case, the exact
halves of three segments, one key for each of the eight ways to choose them. Every key tells about 24 bits. The join
verifies the distance itself, and reports a pair under its first key only.

Components come from the links by contraction (see ``components``) on tables in the shared folder. Only distinct
fingerprints take part, so exact copies, however many, cost one row; each document then gets the label of its
fingerprint. Joins that a frequent fingerprint could skew read written tables, so that adaptive execution can split them.

Defined results: null text is the empty text; texts without words share the fingerprint zero and link like any other;
rows with a null id get the component of their fingerprint, and null where no row of it has an id; repeated rows are
kept as they are. ``drop_near_copies`` keeps of each component the row with the smallest id, of rows that share that id the
one with the smallest digest of its text, and rows without an id; rows equal in id and text stay or go together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docproof.llm.common import plain, save, spread, without

SHINGLE = 4
MAX_ERRORS = 4
SEED = 42
#: The generator polynomial of the binary Golay code (a fixed value).
GOLAY = 0b110001110101
EXACT_THEN_NEAR = [(a, b) for a in range(4) for b in range(4) if a != b]


def fingerprint_of(text: str, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint: a bit is 1 if set in over half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < size:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=False)], dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """64 bits: those that over half of the hashes have set."""
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):  # bounds the unpacked bits of a very long text
        part = hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """id, fp (the 64 bits as a signed long), and the columns ``more``."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(x) for x in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("id"), *more, fp(plain(text_col)).alias("fp"))


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit word: the index of its codeword, and the indices for all words within one bit (rows padded by
    repeating the first)."""
    remainder = np.arange(1 << 23, dtype=np.int32)
    for bit in range(22, 10, -1):
        remainder ^= np.where(remainder >> bit & 1, GOLAY << (bit - 11), 0).astype(np.int32)
    leader = np.zeros(1 << 11, dtype=np.int32)
    units = [1 << i for i in range(23)]
    errors = [0, *units, *(a | b for a in units for b in units if a < b), *(a | b | c for a in units for b in units for c in units if a < b < c)]
    leader[remainder[errors]] = errors
    word = np.arange(1 << 16, dtype=np.int32)
    index = (word ^ leader[remainder[: 1 << 16]]) >> 11
    near = np.stack([index, *(index[word ^ (1 << i)] for i in range(16))], axis=1)
    near.sort(axis=1)
    again = np.zeros_like(near, dtype=bool)
    again[:, 1:] = near[:, 1:] == near[:, :-1]
    near[again] = -1
    return index.astype(np.int64), near.astype(np.int64)


def _keys(fp: np.ndarray, asking: bool) -> tuple[np.ndarray, np.ndarray]:
    """(key, row of its fingerprint). A key: the kind, then the exact segment and the codeword's index, or three halves."""
    index, near = golay_tables()
    segments = [((fp >> (16 * i)) & 0xFFFF).astype(np.int64) for i in range(4)]
    rows = np.arange(len(fp))
    keys, owners = [], []

    def put(key: np.ndarray, valid: np.ndarray) -> None:
        at = np.nonzero(valid)
        keys.append(key[at])
        owners.append(rows[at[0]])

    for kind, (a, b) in enumerate(EXACT_THEN_NEAR):
        codes = near[segments[b]] if asking else index[segments[b]][:, None]
        put((kind << 32) | (segments[a] << 12)[:, None] | codes, codes >= 0)
    for pattern in range(8):
        halves = [(segments[i] >> 8 * (pattern >> i & 1)) & 0xFF for i in range(3)]
        key = (len(EXACT_THEN_NEAR) + pattern << 32) | halves[0] << 16 | halves[1] << 8 | halves[2]
        put(key[:, None], np.ones((len(fp), 1), dtype=bool))
    return np.concatenate(keys), np.concatenate(owners)


def fuzzy_keys(prints: DataFrame, asking: bool) -> DataFrame:
    """key, fp (and group, where ``prints`` has it): the rows that the asking or the filed side brings to the join."""
    more = ["group"] if "group" in prints.columns else []

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy()
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                key, row = _keys(part, asking)
                yield pd.DataFrame({"key": key, "fp": part[row], **{x: batch[x].to_numpy()[at : at + 4096][row] for x in more}})

    return prints.select("fp", *more).mapInPandas(emit, "key long, fp long" + ", group int" * len(more))


def _errors(i: int) -> str:
    return f"bit_count((a.fp ^ b.fp) & {((0xFFFF << (16 * i)) + (1 << 63)) % (1 << 64) - (1 << 63)}L)"


def links(prints: DataFrame) -> DataFrame:
    """a, b with a < b: every pair of distinct fingerprints that differ in at most ``MAX_ERRORS`` bits, once. Where
    ``prints`` has a group (an int), only fingerprints of different groups meet, equal ones too."""
    pattern = " + ".join(f"if((a.fp ^ b.fp) & {0xFF << 16 * i}L = 0, 0, {1 << i})" for i in range(3))
    first = "case " + " ".join(f"when {_errors(a)} = 0 and {_errors(b)} <= 1 then {kind}" for kind, (a, b) in enumerate(EXACT_THEN_NEAR)) + f" else {len(EXACT_THEN_NEAR)} + {pattern} end"
    prints = spread(prints)
    filed, asking = fuzzy_keys(prints, False).alias("a"), fuzzy_keys(prints, True).alias("b")
    order = "(a.fp < b.fp and a.group != b.group or a.fp = b.fp and a.group < b.group)" if "group" in prints.columns else "a.fp < b.fp"
    close = F.expr(f"a.key = b.key and {order} and bit_count(a.fp ^ b.fp) <= {MAX_ERRORS} and shiftright(a.key, 32) = {first}")
    # a broadcast would go by the size of the fingerprints, not of their many keys
    return asking.join(filed.hint("merge"), close).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node in reach) for the nodes of ``edges`` (a, b). Each round every node points to the
    smallest of itself and its neighbours, pointers jump along themselves to the roots, and the edges are drawn anew
    between roots; edges within a root vanish, so a dense group costs its links once. Tables are cut from their history
    each round."""
    found = None
    while True:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = save(near.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "points")
        while True:
            further = points.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = save(points.join(further, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "points")
            points = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        to = points.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = points if found is None else save(found.join(to, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        drawn = edges.join(points.select(F.col("node").alias("a"), F.col("root").alias("c")), "a").join(points.select(F.col("node").alias("b"), F.col("root").alias("d")), "b")
        edges = save(drawn.where("c != d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return found


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, place (a digest of the text), fp and first: the smallest (id, place) of the component, null without ids."""
    texts = docs.select(F.col(id_col).alias("id"), plain(text_col).alias("text"))
    prints = save(fingerprints(texts.withColumn("place", F.xxhash64("text")), "id", "text", "place"), "fingerprints")
    known = F.when(F.col("id").isNotNull(), F.struct("id", "place"))
    distinct = save(prints.groupBy(F.col("fp").alias("node")).agg(F.min(known).alias("first")), "nodes")
    edges = save(links(distinct.select(F.col("node").alias("fp"))), "links")
    rooted = distinct.join(components(edges), "node", "left").select(F.col("node").alias("fp"), F.coalesce("root", "node").alias("root"), "first")
    rooted = save(rooted, "roots")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return prints.join(save(rooted.drop("first").join(smallest, "root").select("fp", "first"), "components"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id."""
    found = _labelled(docs, id_col, text_col)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns; of each component one document stays."""
    found = _labelled(docs, id_col, text_col)
    return without(docs, found.where("id is not null and struct(id, place) != first").select("id", "place"), id_col, text_col)
