"""Near copies by SimHash with Golay-code keys, counted exactly on five-word runs.

Two texts are near copies where the Jaccard similarity of their sets of ``WORDS``-word runs is ``LEAST`` or more, case and
spacing aside. Candidates come from ``PRINTS`` fingerprints of 64 bits over a text's words (a word counts twice at most), which
an edited word moves by few bits, where it changes five runs. Fingerprints meet through the Golay keys of ``simhash``: each
asks its keys, and where it differs in at most 4 bits from the least or the greatest fingerprint that files one, their texts
are compared. Two fingerprints alone at a key always meet, of many at one key each meets two at most; texts found alike are
a group.

Every comparison counts the similarity itself. What lies further apart than 4 bits in all fingerprints (an appended passage
changes many words), or met neither end of a crowded key, has an exact way of its own: texts that share one of ``BANDS`` hashes
of ``ROWS`` minimum hashes are compared too where their bucket is not yet one group. A pair at 0.8 shares none with a probability
of (1 - 0.8 ** 5) ** 32 = 3e-6, a closer pair with less.

Only texts of different sets take part. Each such bucket has a centre, the member that meets most others in its buckets. A text
x is compared with the centre c of each of its buckets, and what tells them apart is kept: the runs that x lacks and those
it adds. A text linked with its centre is done. For the others those differences say exactly how much two texts around one
centre share - |c| less what either lacks, plus what both lack, plus what both add - so the join of the texts around a
centre counts the similarity itself and lets only links through; sets and texts are never sent once a pair. Pairs inside
a centre's largest component are not asked for, and of a text outside it, only whether it has any link into it. Texts around
one centre that are alike, but no near copies, are still compared pair by pair in the join.

Defined results: null text is the empty text; texts without words are alike, and texts of fewer words than a run are one
run. Of a component the row with the smallest id stays, of rows that share that id the one with the smallest hash of its
text; a row with a null id stays; rows equal in id and text stay or go together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docproof.llm.common import plain, save, spread, without
from docproof.llm.simhash import MAX_ERRORS, components, fuzzy_keys, majority

WORDS, LEAST = 5, 0.8
PRINTS = 2
BANDS, ROWS = 32, 5
SEED = 42
SLICE = 128
#: Of the texts' hashes; the occupied ones are broadcast, at most this many 8-byte numbers.
BUCKETS = 1 << 20


def runs(text: str, size: int = WORDS) -> np.ndarray:
    """The sorted hashes of the different runs of words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=False)], dtype=np.uint64))


@cache
def _mixers() -> tuple[np.ndarray, np.ndarray]:
    mask, factor = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)
    return mask, factor | np.uint64(1)


def bands_of(found: np.ndarray) -> np.ndarray:
    """One hash a band of the set's minimum hashes."""
    mask, factor = _mixers()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 512):  # small tables stay in the cache
        mixed = (found[at : at + 512] ^ mask) * factor
        mixed ^= mixed >> np.uint64(32)
        np.minimum(least, mixed.min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(part.tobytes(), i) for i, part in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64)


def prints_of(text: str) -> np.ndarray:
    """Fingerprints over the different words; those that occur more than once count twice."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(PRINTS, dtype=np.uint64)
    found, times = np.unique(np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], dtype=np.uint64), return_counts=True)
    found = np.concatenate([found, found[times > 1]])
    mask, factor = _mixers()
    mixed = (found ^ mask[:PRINTS]) * factor[:PRINTS]
    mixed = (mixed ^ mixed >> np.uint64(32)) * factor[PRINTS : 2 * PRINTS]  # the low bits of a product tell little
    return np.array([majority(x) for x in mixed ^ mixed >> np.uint64(32)], dtype=np.uint64)


def _sketches(texts: DataFrame) -> DataFrame:
    """id, place (a hash of the text), node (a hash of the set), size (of the set), bands, prints."""

    @F.pandas_udf("node long, size int, bands array<long>, prints array<long>")
    def sketch(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for text in batch:  # a text's set goes as soon as it is read
            found = runs(text)
            rows.append((xxhash.xxh64_intdigest(found.tobytes(), SEED), len(found), bands_of(found).view(np.int64), prints_of(text).view(np.int64)))
        found = pd.DataFrame(rows, columns=["node", "size", "bands", "prints"])
        return found.assign(node=found["node"].astype(np.uint64).to_numpy().view(np.int64))

    return texts.select("id", F.xxhash64("text").alias("place"), sketch("text").alias("s")).select("id", "place", "s.*")


def _texts_of(asked: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, text of the nodes that are asked for."""
    places = save(nodes.join(asked, "node", "left_semi").select("node", "place"), "places")
    # only texts in a bucket of one that is asked for shuffle
    bucket = F.pmod("place", F.lit(BUCKETS))
    placed = texts.select("text", F.xxhash64("text").alias("place")).withColumn("bucket", bucket)
    some = placed.join(F.broadcast(places.select(bucket.alias("bucket")).distinct()), "bucket", "left_semi")
    return save(some.join(places, "place").groupBy("node").agg(F.first("text").alias("text")), "texts")


def _differences(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """For pairs (node, centre): base (the size of the centre's set), lost (its runs that the node lacks), extra (the node's
    runs that it lacks)."""

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core_text, core = "", runs("")
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):  # a set takes more bytes than its text, so few leave at a time
                part = batch.slice(at, SLICE)
                base, sides = [], ([], [])
                for text, of in zip(part.column("text"), part.column("core"), strict=True):
                    if (of := of.as_py()) != core_text:  # rows come by centre
                        core_text, core = of, runs(of)
                    own = runs(text.as_py())
                    base.append(len(core))
                    sides[0].append(np.setdiff1d(core, own, assume_unique=True).view(np.int64))
                    sides[1].append(np.setdiff1d(own, core, assume_unique=True).view(np.int64))
                lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), np.concatenate(x)) for x in sides]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("centre"), pa.array(base, pa.int32()), *lists], names=["node", "centre", "base", "lost", "extra"])

    cores = texts.select(F.col("node").alias("centre"), F.col("text").alias("core"))
    # a file of texts is much smaller than they are
    both = pairs.join(texts.hint("merge"), "node").join(cores.hint("merge"), "centre").select("node", "centre", "text", "core")
    return both.mapInArrow(differ, "node long, centre long, base int, lost array<long>, extra array<long>")


def _around(centres: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between texts around one centre that lie in different groups, with a centre's largest group by its root;
    ``centres`` has node, centre, group and the differences."""
    sizes = centres.groupBy("centre", "group").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("centre").agg(F.count(F.lit(1)).alias("groups"), F.max_by("group", F.struct("n", "group")).alias("big"))
    mixed = save(mixed.where("groups > 1").select("centre", "big"), "mixed")
    size = (F.col("base") - F.size("lost") + F.size("extra")).alias("size")
    left = save(centres.join(mixed, "centre").select("centre", "node", "group", "big", "base", size, "lost", "extra"), "left")
    outside = left.where("group != big")
    near = f"least(a.size, b.size) >= {least}D * greatest(a.size, b.size)"
    close = "(a.base - size(a.lost) - size(b.lost) + {0}) * {1}D >= {2:.9f}D * (a.size + b.size)"  # both >= least * (x + y - both)
    most = close.format("least(size(a.lost), size(b.lost)) + least(size(a.extra), size(b.extra))", 1 + least, least - 1e-9)
    both = "(a.base - size(a.lost) - size(b.lost) + size(array_intersect(a.lost, b.lost)) + size(array_intersect(a.extra, b.extra)))"
    exact = f"{both} >= {least}D * (a.size + b.size - {both})"
    met = f"a.centre = b.centre and {near} and {most} and {exact}"
    # the largest group is one already, so whether any of it is linked is enough
    joined = outside.alias("a").join(left.where("group = big").alias("b"), F.expr(met), "left_semi")
    joined = joined.select("node", F.col("big").alias("root"))
    found = outside.alias("a").join(outside.alias("b"), F.expr(f"{met} and a.group != b.group and a.node < b.node"))
    links = found.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    return links.unionByName(joined.select(F.least("node", "root").alias("a"), F.greatest("node", "root").alias("b"))).distinct()


def _near(a: str, b: str, least: float) -> F.Column:
    """Whether sets of these sizes can be as similar as that."""
    return F.least(a, b) >= least * F.greatest(a, b)


def _by_keys(nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (node, centre) of texts whose fingerprints meet under a Golay key and differ in at most ``MAX_ERRORS`` bits. The
    least and the greatest fingerprint that file a key are its centres; all ask, so their number grows with the texts alone."""
    found = None
    for i in range(PRINTS):
        own = save(nodes.select("node", "size", F.col("prints")[i].alias("fp")), "prints")
        of = own.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("first"))  # of equal fingerprints one files and asks
        first = save(of.select("fp", "first.node", "first.size"), "filed")
        prints = spread(first.select("fp"))
        ends = save(fuzzy_keys(prints, False).groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")), "ends")
        close = " or ".join(f"(fp != {x} and bit_count(fp ^ {x}) <= {MAX_ERRORS})" for x in ("low", "high"))
        met = fuzzy_keys(prints, True).alias("a").join(ends.hint("merge").alias("b"), F.expr(f"a.key = b.key and ({close})"))
        met = met.select("fp", F.explode(F.array("low", "high")).alias("to")).where(f"fp != to and bit_count(fp ^ to) <= {MAX_ERRORS}")
        met = save(met.select(F.least("fp", "to").alias("fp"), F.greatest("fp", "to").alias("to")).distinct(), "met")
        centre = first.select(F.col("fp").alias("to"), F.col("node").alias("centre"), F.col("size").alias("core"))
        by_key = first.join(met, "fp").join(centre, "to").select("node", "size", "centre", "core")
        same = own.join(centre.withColumnRenamed("to", "fp"), "fp").where("node != centre").select("node", "size", "centre", "core")
        pairs = by_key.unionByName(same).where(_near("size", "core", least)).select(F.least("node", "centre").alias("node"), F.greatest("node", "centre").alias("centre"))
        found = pairs if found is None else found.unionByName(pairs)
    return save(found.distinct(), "by-keys")


def _linked(differences: DataFrame, least: float) -> DataFrame:
    """a, b: the pairs that are near copies."""
    close = (F.col("base") - F.size("lost")) >= least * (F.col("base") + F.size("extra"))
    return differences.where(close).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("node").unionByName(pairs.select(F.col("centre").alias("node"))).distinct()


def _labelled(docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """id, place (a hash of the text) and first: the smallest (id, place) of the component, null without ids."""
    texts = docs.select(F.col(id_col).alias("id"), plain(text_col).alias("text"))
    sketches = save(_sketches(texts), "sketches")
    known = F.when(F.col("id").isNotNull(), F.struct("id", "place"))
    firsts = [F.min(known).alias("label"), F.min("place").alias("place"), *(F.first(x).alias(x) for x in ("size", "bands", "prints"))]
    nodes = save(sketches.groupBy("node").agg(*firsts), "nodes")

    near = _by_keys(nodes, least)
    edges = save(_linked(_differences(near, _texts_of(_ends(near), nodes, texts)), least), "edges")
    groups = components(edges).withColumnRenamed("root", "group")

    keys = nodes.select(F.explode("bands").alias("key"), "node")
    shared = save(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    members = keys.join(shared.hint("merge"), "key").join(groups, "node", "left").select("key", "node", "n", F.coalesce("group", "node").alias("group"))
    members = save(members, "members")
    mixed = members.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    mixed = save(mixed.where("low != high").select("key"), "mixed")  # in other buckets all are one group
    members = save(members.join(mixed, "key"), "members")
    met = save(members.groupBy("node").agg(F.sum("n").alias("met")), "met")
    ranked = save(members.join(met, "node").select("key", "node", "met"), "ranked")
    centre = save(ranked.groupBy("key").agg(F.max_by("node", F.struct("met", "node")).alias("centre")), "centres")
    apart = save(ranked.join(centre, "key").where("node != centre").select("node", "centre").distinct(), "apart")

    differences = save(_differences(apart, _texts_of(_ends(apart), nodes, texts)), "differences")
    edges = save(edges.unionByName(_linked(differences, least)).distinct(), "edges")
    groups = components(edges).withColumnRenamed("root", "group")
    more = _around(differences.join(groups, "node", "left").withColumn("group", F.coalesce("group", "node")), least)

    rooted = components(save(edges.unionByName(more), "links"))
    rooted = save(nodes.join(rooted, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "label"), "roots")
    smallest = rooted.groupBy("root").agg(F.min("label").alias("first"))
    label = save(rooted.join(smallest, "root").select("node", "first"), "components")
    return sketches.select("id", "place", "node").join(label, "node").select("id", "place", "first")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row a document: doc_id, component_id (the smallest id among its near copies, theirs, and so on)."""
    return _labelled(docs, id_col, text_col, least).select(F.col("id").alias("doc_id"), F.col("first.id").alias("component_id"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns; of each component one document stays."""
    found = _labelled(docs, id_col, text_col, LEAST)
    return without(docs, found.where("id is not null and struct(id, place) != first").select("id", "place"), id_col, text_col)
