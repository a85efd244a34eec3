"""Alignment of two tokenizers' tokens by the places where both end, in DataFrame operations.

A (byte-level BPE) and B (piece BPE) cut the same bytes. The relational core, ``align``, explodes each side's tokens with
their positions, sums their lengths in a window to get byte ends, joins the two sides on text and end to find the cuts,
counts the cuts before each token to get its group, and joins the sides' groups; links are the pairs within a group.

Texts are long and repeat their words, so the texts that the core sees are passages: parts at whose borders both
tokenizers always cut, because neither A's pre-tokenizer nor any piece of B's vocabulary crosses such a border (``PASSAGE``
states the borders; ``Tokenizers`` checks the vocabulary and takes whole texts where a piece crosses one). A border is a
cut, so a document's groups are those of its passages in turn. Documents are numbered lists of passages, kept in blocks of
about ``BLOCK`` characters that share one list of passages; each different passage of the corpus is aligned once, and its
results come back to the blocks by two joins:

1. ``split``: blocks of (documents as passage numbers, passages), written in buckets by block, and their ``places``
   (passage, block, number), in buckets by passage.
2. ``lexicon``: each different passage once, with A's and B's ids.
3. ``align``: its groups; ``links`` are the pairs of each.
4. ``count_pairs``: documents that hold an id pair linked, over all documents.
5. ``measure``: per passage its counts, then per document their sums and its groups.

What returns to a block meets it in a cogroup, where numpy and Arrow gather it along the documents' lists.

Tables by passage have the same buckets, so whatever joins, sums or windows by passage moves nothing; only what returns to
the blocks, and links on their way to their counts and back, shuffle.
A block is bounded, whatever a document's copies do; an id pair
that occurs in every document is one row a block before it is counted.

Defined results: texts that are null or empty, or whose tokens of A or B do not join to the very bytes of a space and the
text, have no tokens: zeros and empty groups; rows that share a doc_id, or have none, are documents of their own; an empty
table gives an empty one.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docproof.llm.common import plain, release, save, setting, shared_dir
from docproof.llm.encoders import byte_letters
from docproof.llm.pieces import BYTE, MARK, NORMAL, USER_DEFINED, load

#: Characters of text in a block; a longer document is a block of its own. The larger, the fewer passages are listed in more than
#: one block; a block's lists take some four times its text in a task's memory.
BLOCK = 16_000_000
#: Passages that are encoded in one call.
SLICE = 2_000

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_OTHER = r"\x00-@\[-`{-\x7f"
#: Borders: a letter before an ASCII sign; an ASCII sign or letter before a space or line feed; a lone line feed before either.
_BORDER = rf"(?<=[{_LETTER}])(?=[{_OTHER}])|(?<=[!-~])(?=[ \n])|(?<=[!-~{_LETTER}]\n)(?=[!-~{_LETTER}])"
#: A passage from one border to the next; the first three forms are the frequent ones, the last is any.
PASSAGE = rf" ?[{_LETTER}]+(?=[{_OTHER}]|\Z)|(?<=[!-~{_LETTER}])\n(?=[!-~{_LETTER}])| ?[!-@\[-`{{-~]+(?=[ \n]|\Z)|(?s:.)(?:(?!{_BORDER})(?s:.))*"


def _cutter(crossed: bool) -> Callable[[str], list[str]]:
    """text -> its passages: the whole text, if a piece crosses a border."""
    return (lambda text: [text]) if crossed else re.compile(PASSAGE).findall


class Tokenizers:
    """Ids of passages under A and B, and the bytes that each id stands for."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        with open(byte_level) as file:
            model = json.load(file)
        letters = {letter: b for b, letter in byte_letters().items()}
        named = model["model"]["vocab"] | {x["content"]: x["id"] for x in model["added_tokens"]}
        self.a_bytes = {i: bytes(letters[x] for x in token) if all(x in letters for x in token) else token.encode() for token, i in named.items()}
        self.b = load(pieces)
        self.b_bytes = {i: bytes([self.b.bytes[i]]) if kind == BYTE else name.replace(MARK, " ").encode() for i, (name, kind) in enumerate(zip(self.b.names, self.b.kinds, strict=True))}
        border = re.compile(_BORDER)
        self.crossed = any(border.search(x.replace(MARK, " ")) for x, k in zip(self.b.names, self.b.kinds, strict=True) if k in (NORMAL, USER_DEFINED))
        plain_map = not (self.b.map.units or self.b.squeeze) and self.b.escape and self.b.dummy_prefix
        if not plain_map or model["normalizer"] or model["pre_tokenizer"]["type"] != "ByteLevel" or model["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("the borders and the joined bytes are right for a byte-level A and a B that only marks spaces")
        self.passages = _cutter(self.crossed)

    def encode(self, passages: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        found = [x.ids for x in self.a.encode_batch_fast(passages, add_special_tokens=False)]
        return found, self.b.library.encode([x.replace(" ", MARK) for x in passages], num_threads=1)

    def exact(self, passage: str, a: list[int], b: list[int]) -> bool:
        """Whether both sides' tokens join to the passage's own bytes."""
        data = passage.encode("utf-8", "surrogatepass")
        return b"".join(map(self.a_bytes.__getitem__, a)) == data == b"".join(map(self.b_bytes.__getitem__, b))


@lru_cache(maxsize=2)
def load_both(byte_level: str, pieces: str) -> Tokenizers:
    return Tokenizers(byte_level, pieces)


class _Numbers(dict):
    """Numbers what it is asked for in the order of first questions."""

    def __missing__(self, key):
        self[key] = found = len(self)
        return found


def split(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row per block: block, doc_id (array), passages (array), docs (for each document the numbers of its passages). Its tasks
    load no tokenizers."""
    crossed = load_both(byte_level, pieces).crossed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, task, made = _cutter(crossed), TaskContext.get().partitionId(), 0
        ids, lists, numbers, size = [], [], _Numbers(), 0

        def row() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            inner = pa.ListArray.from_arrays(offsets, np.concatenate(lists))
            whole = lambda x: pa.ListArray.from_arrays(np.array([0, len(x)], dtype=np.int32), x)
            columns = [pa.array([task << 32 | made]), whole(pa.array(ids, type=pa.int64())), whole(pa.array(list(numbers), type=pa.string())), whole(inner)]
            return pa.RecordBatch.from_arrays(columns, names=["block", "doc_id", "passages", "docs"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if ids and size + len(text) > block:
                    yield row()
                    ids, lists, numbers, size, made = [], [], _Numbers(), 0, made + 1
                    release()
                ids.append(doc)
                lists.append(np.fromiter(map(numbers.__getitem__, cut(" " + text) if text else ()), dtype=np.int32))
                size += len(text)
        if ids:
            yield row()
        del ids, lists, numbers
        release()

    found = docs.select(F.col(id_col).cast("long").alias("id"), plain(text_col).alias("text")).mapInArrow(run, "block long, doc_id array<long>, passages array<string>, docs array<array<int>>")
    return _in_buckets(found, "block")


def places(blocks: DataFrame) -> DataFrame:
    """passage, block, pos: where each passage stands in the blocks' lists."""
    rows = blocks.select(F.posexplode("passages").alias("pos", "passage"), "block")
    return _in_buckets(rows.repartition(_buckets(blocks.sparkSession), "passage"), "passage")


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _in_buckets(df: DataFrame, key: str) -> DataFrame:
    """``df`` written in as many buckets as a shuffle has partitions, and read back."""
    spark, name = df.sparkSession, f"docproof_{key}_{uuid.uuid4().hex}"
    df.write.bucketBy(_buckets(spark), key).option("path", f"{shared_dir(spark)}/docproof/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def lexicon(places: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Each different passage once: passage, a, b (arrays of ids; null where their bytes are not the passage's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load_both(byte_level, pieces)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column(0).to_pylist()
                a, b = both.encode(texts)
                exact = [both.exact(*x) for x in zip(texts, a, b, strict=True)]
                sides = [pa.array([x if ok else None for x, ok in zip(side, exact, strict=True)], type=pa.list_(pa.int32())) for side in (a, b)]
                yield pa.RecordBatch.from_arrays([part.column(0), *sides], names=["passage", "a", "b"])
        release()

    return _in_buckets(places.select("passage").distinct().mapInArrow(run, "passage string, a array<int>, b array<int>"), "passage")


def _sizes(spark: SparkSession, found: dict[int, bytes], name: str) -> DataFrame:
    """Bytes of each id; as many rows as the vocabulary."""
    return F.broadcast(spark.createDataFrame([(i, len(x)) for i, x in found.items()], f"{name} int, size int"))


def align(lexicon: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """passage, groups: array of (a, b), the ids of both sides between two neighbouring cuts, in order."""
    both, spark = load_both(byte_level, pieces), lexicon.sparkSession

    def tokens(side: str, sizes: dict[int, bytes]) -> DataFrame:
        found = lexicon.where(F.col(side).isNotNull()).select("passage", F.posexplode(side).alias("pos", side))
        end = F.sum("size").over(Window.partitionBy("passage").orderBy("pos"))
        return found.join(_sizes(spark, sizes, side), side).select("passage", side, end.alias("end"))

    def groups(own: DataFrame, other: DataFrame, side: str) -> DataFrame:
        ends = other.select(F.col("passage").alias("of"), F.col("end").alias("other_end"))
        met = own.join(ends, (F.col("passage") == F.col("of")) & (F.col("end") == F.col("other_end")), "left")
        before = Window.partitionBy("passage").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
        met = met.withColumn("group", F.coalesce(F.sum(F.col("other_end").isNotNull().cast("int")).over(before), F.lit(0)))
        ids = F.sort_array(F.collect_list(F.struct("end", side)))
        return met.groupBy("passage", "group").agg(F.transform(ids, lambda x: x[side]).alias(side))

    a, b = tokens("a", both.a_bytes), tokens("b", both.b_bytes)
    joined = groups(a, b, "a").join(groups(b, a, "b"), ["passage", "group"])
    in_order = F.sort_array(F.collect_list(F.struct("group", "a", "b")))
    with setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        return _in_buckets(joined.groupBy("passage").agg(F.transform(in_order, lambda g: F.struct(g["a"].alias("a"), g["b"].alias("b"))).alias("groups")), "passage")


class Pairs:
    """Id pairs as numbers a * (size of B's vocabulary) + b, 32-bit where they fit."""

    def __init__(self, size_a: int, size_b: int) -> None:
        self.size_b, self.kind = size_b, "int" if size_a * size_b < 1 << 31 else "long"

    def of(self, a: F.Column, b: F.Column) -> F.Column:
        return a.cast(self.kind) * F.lit(self.size_b).cast(self.kind) + b.cast(self.kind)

    def a(self, pair: F.Column | str) -> F.Column:
        return F.floor(F.col(pair) / self.size_b if isinstance(pair, str) else pair / self.size_b).cast("int")


def group_links(group: F.Column, pairs: Pairs) -> F.Column:
    """The id pairs of a group and how many occurrences each has."""
    times = lambda side, x: F.when(F.size(side) == 1, 1).otherwise(F.size(F.filter(side, lambda y: y == x)))
    of = lambda x: F.transform(F.array_distinct(group["b"]), lambda y: F.struct(pairs.of(x, y).alias("pair"), (times(group["a"], x) * times(group["b"], y)).alias("times")))
    return F.flatten(F.transform(F.array_distinct(group["a"]), of))


def links(aligned: DataFrame, pairs: Pairs) -> DataFrame:
    """passage, pair, times: the linked id pairs of each group of each passage."""
    return aligned.select("passage", F.explode("groups").alias("g")).select("passage", F.inline(group_links(F.col("g"), pairs)))


#: Passages whose results a task gathers at a time.
GATHER = 200_000


def forget() -> None:
    """Hands the tokenizers of earlier stages back, where a Python worker that gathers still holds them."""
    load_both.cache_clear()
    load.cache_clear()
    release()


def _by_block(blocks: DataFrame, places: DataFrame, passages: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``run`` makes of each block (doc_id, docs) and of its passages' rows (pos, and the columns of ``passages``; none
    where a passage has no such row)."""
    columns = [x for x in passages.columns if x != "passage"]
    rows = places.join(passages, "passage").select("block", "pos", *columns).repartition(_buckets(blocks.sparkSession), "block")
    own = blocks.select("block", "doc_id", "docs")

    def gather(block: pa.Table, rows: pa.Table) -> pa.Table:
        forget()
        return run(block, rows)

    return own.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(gather, schema)


def _numbered(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The passages of a block's documents one after another, and where each document's start (and the last one's end)."""
    docs = block.column("docs").combine_chunks().flatten()
    offsets = docs.offsets.to_numpy().astype(np.int64)
    return docs.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _slices(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about ``GATHER`` passages."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + GATHER, "right")) - 1)
        yield first, min(last, n)
        first = last


def _by_place(rows: pa.Table, name: str, n: int) -> np.ndarray:
    """A column of numbers by its rows' places; 0 where there is no row."""
    found = np.zeros(n, dtype=np.int64)
    found[rows.column("pos").to_numpy()] = rows.column(name).to_numpy()
    return found


def _held(block: pa.Table, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The id pairs that documents of a block hold linked, and how many of them hold each."""
    flat, starts = _numbered(block)
    lists = rows.column("pairs").combine_chunks()
    values, local = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    size = int(flat.max(initial=-1)) + 1
    begin, length = np.zeros(size, dtype=np.int64), np.full(size, -1, dtype=np.int64)
    at, offsets = rows.column("pos").to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    begin[at], length[at] = offsets[:-1] - offsets[0], np.diff(offsets)
    docs = np.zeros(len(values), dtype=np.int64)
    for first, last in _slices(starts):
        part = flat[starts[first] : starts[last]]
        n = length[part]
        missing = np.concatenate([[0], np.cumsum(n < 0)])
        n = np.maximum(n, 0)
        ends = np.concatenate([[0], np.cumsum(n)])
        of = local[np.repeat(begin[part] - ends[:-1], n) + np.arange(ends[-1])]
        for i, j in zip((starts[first:last] - starts[first]).tolist(), (starts[first + 1 : last + 1] - starts[first]).tolist(), strict=True):
            if missing[i] == missing[j]:  # a text with a passage without tokens has none
                docs[of[ends[i] : ends[j]]] += 1  # once, however often the document repeats it
    return values[docs > 0], docs[docs > 0]


def count_pairs(blocks: DataFrame, places: DataFrame, aligned: DataFrame, pairs: Pairs) -> DataFrame:
    """pair, docs, best: in how many documents an id pair is linked, and whether no pair of its A id is in more."""
    own = F.array_distinct(F.flatten(F.transform("groups", lambda g: F.transform(group_links(g, pairs), lambda x: x["pair"]))))

    def count(block: pa.Table, rows: pa.Table) -> pa.Table:
        values, docs = _held(block, rows) if rows.num_rows else ([], [])
        return pa.table({"pair": pa.array(values, kind), "docs": pa.array(docs, pa.int64())})

    kind = pa.int32() if pairs.kind == "int" else pa.int64()
    found = _by_block(blocks, places, aligned.select("passage", own.alias("pairs")), count, f"pair {pairs.kind}, docs long")
    counts = save(found.groupBy("pair").agg(F.sum("docs").alias("docs")), "pair-counts").withColumn("a", pairs.a("pair"))
    best = counts.groupBy(F.col("a").alias("of")).agg(F.max("docs").alias("most"))  # at most one row an id of A's vocabulary
    return counts.join(F.broadcast(best), F.col("a") == F.col("of")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def measure(aligned: DataFrame, counts: DataFrame, pairs: Pairs) -> DataFrame:
    """Per passage: groups as text, n_a, n_b, n_groups, n_links, n_best and count_sum."""
    scores = links(aligned, pairs).join(counts, "pair").groupBy(F.col("passage").alias("of"))
    scores = scores.agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    number = lambda side: F.aggregate("groups", F.lit(0).cast("long"), lambda n, g: n + F.size(g[side]))
    text = F.array_join(F.transform("groups", lambda g: F.concat(F.array_join(g["a"].cast("array<string>"), ","), F.lit("|"), F.array_join(g["b"].cast("array<string>"), ","))), ";")
    own = aligned.select("passage", text.alias("groups"), number("a").alias("n_a"), number("b").alias("n_b"), F.size("groups").cast("long").alias("n_groups"))
    return own.join(scores, F.col("passage") == F.col("of")).drop("of")


NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _gathered(block: pa.Table, rows: pa.Table) -> pa.Table:
    """A row per document of a block: sums of its passages' numbers, and their groups in turn; zeros and no groups where a
    passage has no tokens."""
    flat, starts = _numbered(block)
    size = int(flat.max(initial=-1)) + 1
    place = np.full(size, -1, dtype=np.int64)
    place[rows.column("pos").to_numpy()] = np.arange(rows.num_rows)
    numbers = {x: _by_place(rows, x, size) for x in NUMBERS}
    texts, ids = rows.column("groups").combine_chunks(), block.column("doc_id").combine_chunks().flatten()
    made = []
    for first, last in _slices(starts):
        part, at = flat[starts[first] : starts[last]], starts[first : last + 1] - starts[first]

        def sums(x: np.ndarray, at: np.ndarray = at) -> np.ndarray:
            ends = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
            return ends[at[1:]] - ends[at[:-1]]

        whole = sums(place[part] < 0) == 0
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), texts.take(pa.array(np.maximum(place[part], 0)))) if rows.num_rows else None
        groups = pc.if_else(pa.array(whole), pc.binary_join(lists, ";"), "") if lists is not None else pa.array([""] * (last - first), pa.string())
        made.append(pa.RecordBatch.from_arrays([ids[first:last], *(pa.array(np.where(whole, sums(numbers[x][part]), 0)) for x in NUMBERS), groups], names=["doc_id", *NUMBERS, "groups"]))
    return pa.Table.from_batches(made)


def align_documents(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair no other pair of its A id exceeds),
    count_sum (over links, documents that hold the pair) and groups (``a1,a2|b1;a3|b2,b3``)."""
    both = load_both(byte_level, pieces)
    pairs = Pairs(max(both.a_bytes) + 1, max(both.b_bytes) + 1)
    blocks = split(docs, byte_level, pieces, id_col, text_col, block)
    where = places(blocks)
    aligned = align(lexicon(where, byte_level, pieces), byte_level, pieces)
    schema = "doc_id long, " + "".join(f"{x} long, " for x in NUMBERS) + "groups string"
    return _by_block(blocks, where, measure(aligned, count_pairs(blocks, where, aligned, pairs), pairs), _gathered, schema)
