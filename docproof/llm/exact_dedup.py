"""Exact deduplication in two passes over a Bloom filter.

Pass 1 sets ``PROBES`` positions for every text hash and keeps the positions that were hit twice or more: the bits of a
Bloom filter of *possibly repeated* hashes. Every task makes its own filters (hit, hit again) in chunks of ``CHUNK`` bits, packed, and
the chunks are merged by OR: what two tasks hit, or one twice, is hit again. A hash fills a few bytes of a chunk and no
row of its own, and a text that fills a third of the table the same bits as any other. Pass 2 tests every row against
that filter. A row with a position that was hit once is certainly unique and passes straight through; the others shuffle
by hash and are grouped exactly, so false positives cost time and never results.

The filter holds ``BITS_PER_ROW`` bits a row and at most ``MAX_BITS`` (128 MB): what is broadcast has that bound. Beyond
it (90 million rows) the share of false positives grows, to all rows in the end; then ids and hashes shuffle, never texts, and the result
stays exact.

Defined results: null text counts as empty, and empty texts are equal to each other; a null ``doc_id`` stays only where
its whole group has no other id; rows that repeat a ``doc_id`` stay or go together; an empty table gives an empty one.
Columns other than id and text are not looked at, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docproof.llm.common import SPACE, plain, save

PROBES = 3
BITS_PER_ROW = 12
MIN_BITS, MAX_BITS = 1 << 16, 1 << 30
#: Bits of a filter's chunk, and positions that a task holds before it hands its chunks on.
CHUNK, HELD = 1 << 16, 1 << 22


def text_hash(text: str = "text") -> F.Column:
    return F.sha2(F.regexp_replace(plain(text), SPACE, " "), 256)


def _positions(sha: str, bits: int) -> list[F.Column]:
    a, b = F.xxhash64(F.col(sha)), F.xxhash64(F.col(sha), F.lit(1))
    return [F.pmod(F.xxhash64(a, b, F.lit(i)), F.lit(bits)) for i in range(PROBES)]


def _chunks(positions: np.ndarray) -> pd.DataFrame:
    """The filters (hit, hit again) of these positions, a row for each chunk that has any."""
    at, hits = np.unique(positions, return_counts=True)
    chunk, first = np.unique(at // CHUNK, return_index=True)
    rows = []
    for number, a, b in zip(chunk.tolist(), first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
        bits = np.zeros((2, CHUNK), dtype=bool)
        bits[0, at[a:b] % CHUNK] = True
        bits[1, at[a:b][hits[a:b] > 1] % CHUNK] = True
        rows.append((number, zlib.compress(np.packbits(bits, axis=1, bitorder="little").tobytes(), 1)))
    return pd.DataFrame(rows, columns=["chunk", "bits"])


def repeated_filter(hashes: DataFrame, sha: str, rows: int) -> np.ndarray:
    """Pass 1. The bits that two or more probes hit, packed; its size depends on ``rows`` and has a bound."""
    bits = min(MAX_BITS, max(MIN_BITS, 1 << max(0, rows * BITS_PER_ROW - 1).bit_length()))

    def hit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.to_numpy().ravel())
            n += held[-1].size
            if n >= HELD:
                yield _chunks(np.concatenate(held))
                held, n = [], 0
        if held:
            yield _chunks(np.concatenate(held))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        once, again = np.zeros((2, CHUNK // 8), dtype=np.uint8)
        for packed in group["bits"]:
            more, twice = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(2, -1)
            again |= twice | once & more
            once |= more
        return pd.DataFrame({"chunk": group["chunk"].iloc[:1], "bits": [again.tobytes()]})

    found = hashes.select(*_positions(sha, bits)).mapInPandas(hit, "chunk long, bits binary")
    packed = np.zeros(bits // 64, dtype=np.int64)
    width = CHUNK // 64
    for row in found.groupBy("chunk").applyInPandas(merge, "chunk long, bits binary").toLocalIterator():
        packed[row["chunk"] * width : (row["chunk"] + 1) * width] = np.frombuffer(row["bits"], dtype=np.int64)
    return packed


def mark_possible(df: DataFrame, sha: str, packed: np.ndarray, name: str) -> DataFrame:
    """Pass 2. Adds ``name``: false where the hash is certainly unique. Only the positions go to Python."""
    held = df.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf("boolean")
    def possible(*at: pd.Series) -> pd.Series:
        words = held.value
        out = np.ones(len(at[0]), dtype=bool)
        for x in at:
            x = x.to_numpy()
            out &= ((words[x >> 6] >> (x & 63)) & 1).astype(bool)
        return pd.Series(out)

    return df.withColumn(name, possible(*_positions(sha, len(packed) * 64)))


def _groups(flagged: DataFrame) -> DataFrame:
    return save(flagged.groupBy("sha").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n")), "exact-groups")


def with_groups(hashes: DataFrame) -> DataFrame:
    """A written table with the columns id and sha, and keep (the id that stays) and n (the group's size) added."""
    rows = mark_possible(hashes, "sha", repeated_filter(hashes, "sha", hashes.count()), "again")
    once = rows.where("not again").drop("again").withColumn("keep", F.col("id")).withColumn("n", F.lit(1).cast("long"))
    more = rows.where("again").drop("again")
    return once.unionByName(more.join(_groups(more), "sha"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = with_groups(save(docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("sha")), "exact-hashes"))
    return found.select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns, without the copies. Rows whose hash is certainly unique do not shuffle."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), text_hash(text_col).alias("sha"))
    hashes = save(rows.select("id", "sha"), "exact-hashes")
    packed = repeated_filter(hashes, "sha", hashes.count())
    groups = _groups(mark_possible(hashes, "sha", packed, "again").where("again"))
    rows = mark_possible(rows, "sha", packed, "again")
    kept = rows.where("again").join(groups, "sha").where(F.col("id").eqNullSafe(F.col("keep"))).select("row.*")
    return rows.where("not again").select("row.*").unionByName(kept)
