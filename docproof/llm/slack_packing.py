"""Minimum bin slack packing of token sequences.

Each bin gets the fullest combination of the lengths that are left, found by a subset-sum dynamic programme over bitsets:
bit s of a set says that some combination of the lengths so far adds up to s. Longest lengths come first and the search
ends as soon as a bin can be full, so that of equally full combinations one of the longest pieces is taken. The
combination is then removed, as often as the counts allow: while all its lengths are left it stays a fullest one, since
removing pieces never makes a fuller one possible.

The plan needs the number of pieces of each length only: at most ``CAPACITY`` numbers whatever the corpus holds. Each
combination leaves fewer of one of its lengths than it takes, at most capacity / length, and at least halves them when that
length comes up again, so there are fewer than 4 * CAPACITY combinations, each of at most sqrt(2 * CAPACITY) different
lengths: bounds that do not depend on the data, which is why the driver may hold them.
Pieces find their places by rank: a task numbers its pieces of each length as it writes them, the numbers of earlier tasks
are added by a running sum over (length, task), and the rank among all pieces of a length points into the plan. No rows of
one length ever meet in one task.

Only documents longer than a bin are cut, into whole bins and a last piece.

Defined results: null and empty texts are one piece, the closing id alone; repeated rows and rows with a null id are
packed like any other; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docproof.llm.common import plain, save
from docproof.llm.encoders import word_bpe
from docproof.llm.packing import END_ID

CAPACITY = 4096
#: Texts whose pieces leave a task together.
SLICE = 500


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """length -> how many, of a combination of the ``counts`` that fills a bin as far as any can."""
    reached, items = [1], []
    within = (1 << capacity + 1) - 1
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left and not reached[-1] >> capacity:  # copies by powers of two: any number of them can be made up
            part = min(part, left)
            items.append((length, part))
            reached.append(reached[-1] | reached[-1] << length * part & within)
            left, part = left - part, part * 2
        if reached[-1] >> capacity:
            break
    chosen, at = {}, reached[-1].bit_length() - 1
    for (length, part), before in zip(reversed(items), reversed(reached[:-1]), strict=True):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + part
            at -= length * part
    return chosen


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, length -> how many in each) until no piece is left."""
    left, plan = {k: n for k, n in counts.items() if n}, []
    while left:
        chosen = fullest(left, capacity)
        bins = min(left[length] // k for length, k in chosen.items())
        plan.append((bins, chosen))
        for length, k in chosen.items():
            left[length] -= k * bins
            if not left[length]:
                del left[length]
    return plan


def _places(plan: list[tuple[int, dict[int, int]]]) -> pd.DataFrame:
    """A row per combination and length: ranks from ``rank`` on go, ``k`` to a sequence, to ``sequence`` and after,
    from ``offset`` on. Sorted by length and rank."""
    rows, used, sequence = [], {}, 0
    for bins, chosen in plan:
        starts = accumulate((length * k for length, k in chosen.items()), initial=0)
        for (length, k), offset in zip(chosen.items(), starts):
            rows.append((length, used.get(length, 0), k, sequence, offset))
            used[length] = used.get(length, 0) + k * bins
        sequence += bins
    return pd.DataFrame(rows, columns=["length", "rank", "k", "sequence", "offset"], dtype="int64").sort_values(["length", "rank"], ignore_index=True)


def cut_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, task and nth (its number among the task's pieces of that
    length), and with ``with_ids`` its ids (little-endian unsigned 32-bit). Write it before use: a task's numbers hold for
    the rows that it wrote."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end, task = word_bpe(tokenizer), np.array([END_ID], dtype="<u4").tobytes(), TaskContext.get().partitionId()
        met = [0] * (capacity + 1)
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                rows = batch.iloc[at : at + SLICE]
                out = []
                for doc, text in zip(rows["id"].astype("Int64"), rows["text"], strict=True):
                    ids = encode(text) + end
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + capacity)]
                        length = len(part) // 4
                        out.append((doc, piece, start, length, zlib.crc32(part), task, met[length], *[part] * with_ids))
                        met[length] += 1
                frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", *["ids"] * with_ids])
                yield frame.astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), plain(text_col).alias("text")).mapInPandas(run, schema)


def pack_by_slack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with ``with_ids`` ids."""
    pieces = save(cut_pieces(docs, tokenizer, id_col, text_col, capacity, with_ids), "pieces")
    by_task = pieces.groupBy(F.col("task").alias("in_task"), F.col("length").alias("of_length")).agg(F.count("*").alias("n"))
    counts = {r["of_length"]: r["n"] for r in by_task.groupBy("of_length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = _places(plan_bins(counts, capacity))
    shared = docs.sparkSession.sparkContext.broadcast({x: places[x].to_numpy() for x in places})
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("of_length").orderBy("in_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(by_task.select("in_task", "of_length", earlier.alias("earlier")), (F.col("task") == F.col("in_task")) & (F.col("length") == F.col("of_length")))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = shared.value
        firsts, ends = np.unique(at["length"], return_index=True)
        ends = np.append(ends, len(at["length"]))
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            row = np.zeros(len(batch), dtype=np.int64)
            for value in np.unique(length):
                which, group = length == value, np.searchsorted(firsts, value)
                row[which] = ends[group] + np.searchsorted(at["rank"][ends[group] : ends[group + 1]], rank[which], side="right") - 1
            copy, slot = np.divmod(rank - at["rank"][row], at["k"][row])
            placed = batch[kept].astype({"doc_id": "Int64"}).assign(sequence_id=at["sequence"][row] + copy, offset=at["offset"][row] + slot * length)
            yield placed.assign(ids=batch["ids"]) if with_ids else placed

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids
    return ranked.select(*kept, (F.col("earlier") + F.col("nth")).alias("rank"), *["ids"] * with_ids).mapInPandas(place, schema)
