"""Harmonic packing of token sequences.

A sequence holds ``CAPACITY`` tokens. Class k takes the pieces of length in (CAPACITY/(k+1), CAPACITY/k], and each bin of
class k is filled with exactly k of them; lengths up to CAPACITY/``CLASSES`` share one last class, filled bin by bin
until the next piece no longer fits. Tasks fill their own bins, so nothing shuffles and more workers need nothing from
each other.

Documents may be cut freely, and cutting makes the classes tight: whole sequences are cut off first, and a remainder
stays in one piece only if k of its length leave at most ``SLACK`` of a bin empty. Otherwise a piece of the next lower
power of two is cut off it, of which a bin takes exactly CAPACITY/length. What is left at a task's end in unfilled bins -
fewer than k pieces a class - goes, longest first, into common bins, cut where one is full, so a task pads one sequence.

Defined results: null and empty texts are one piece, the closing id alone; repeated rows and rows with a null id are
packed like any other; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docproof.llm.common import plain
from docproof.llm.encoders import word_bpe

CAPACITY = 2048
CLASSES = 32
SLACK = 0.02
END_ID = 1


def cut(length: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths of a document's pieces, in order."""
    pieces = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        piece = rest if rest <= capacity // CLASSES or k * rest >= (1 - SLACK) * capacity else 1 << (rest.bit_length() - 1)
        pieces.append(piece)
        rest -= piece
    return pieces


class HarmonicBins:
    """The open bins of one task. ``put`` gives (sequence, offset) at once: a piece's place never changes."""

    def __init__(self, first: int, capacity: int = CAPACITY) -> None:
        self.next, self.capacity = first, capacity
        self.open: dict[int, list] = {}

    def put(self, item, length: int) -> list:
        """Holds the item until its bin is full; returns the (item, length, sequence, offset) of bins filled by it."""
        k = min(self.capacity // length, CLASSES)
        held = self.open.setdefault(k, [])
        filled = []
        if k == CLASSES and sum(x[1] for x in held[-1:]) and self.used + length > self.capacity:
            filled = self.close(k)
            held = self.open.setdefault(k, [])
        held.append((item, length))
        if k == CLASSES:
            self.used = self.used + length if len(held) > 1 else length
        elif len(held) == k:
            return self.close(k)
        return filled

    def close(self, k: int) -> list:
        sequence, offset, out = self.next, 0, []
        for item, length in self.open.pop(k):
            out.append((item, 0, length, sequence, offset))
            offset += length
        self.next += 1
        return out

    def flush(self) -> Iterator[tuple]:
        """What is held in unfilled bins, longest first, into common bins; pieces are cut where one is full."""
        left = sorted((x for held in self.open.values() for x in held), key=lambda x: -x[1])
        self.open.clear()
        offset = 0
        for item, length in left:
            done = 0
            while done < length:
                part = min(length - done, self.capacity - offset)
                yield item, done, part, self.next, offset
                done, offset = done + part, offset + part
                if offset == self.capacity:
                    self.next, offset = self.next + 1, 0


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (the piece's own token
    ids, little-endian unsigned 32-bit). ``sequence_id`` has the task's number in its upper bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = word_bpe(tokenizer), np.array([END_ID], dtype="<u4").tobytes()
        bins = HarmonicBins(TaskContext.get().partitionId() << 32, capacity)

        def rows(found) -> pd.DataFrame:
            out = []
            for (doc, start, total, ids), skip, length, sequence, offset in found:
                part = ids[4 * skip : 4 * (skip + length)]
                out.append((doc, start + skip, length, zlib.crc32(part), total, sequence, offset, part))
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
            return frame.astype({"doc_id": "Int64"})

        for batch in batches:
            found = []
            for doc, text in zip(batch["id"].astype("Int64"), batch["text"], strict=True):
                ids, start = encode(text) + end, 0
                total = len(ids) // 4
                for length in cut(total, capacity):
                    part = ids[4 * start : 4 * (start + length)]
                    found += bins.put((None if doc is pd.NA else doc, start, total, part), length)
                    start += length
                if len(found) > 2_000:
                    yield rows(found)
                    found = []
            if found:
                yield rows(found)
        if bins.open:
            yield rows(bins.flush())

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return docs.select(F.col(id_col).cast("long").alias("id"), plain(text_col).alias("text")).mapInPandas(run, schema)
