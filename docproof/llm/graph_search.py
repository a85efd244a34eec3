"""Approximate nearest neighbours with robust-pruned directed graphs, one for each shard.

Equal vectors form one node that remembers its smallest ids, as many as a result can show. Nodes are dealt to shards of
bounded size by a hash, apart by length and by magnitude (``OCTAVES`` powers of two a class), so that a shard's vectors
can be scaled to one range. In each shard a graph grows in batches: a greedy beam search from the medoid proposes
neighbours for the batch's nodes, relaxed distance pruning (an edge goes if a kept neighbour is nearer to its end by the
factor ``ALPHA``) keeps diverse ones, and the reverse edges are added and pruned alike. A shard is written as one row.

A task takes shards and streams the queries through them, block by block from their written table, with a beam search in
each; neither the index nor the queries shuffle or are copied. Where a search reaches fewer nodes than a result needs,
that query is compared with the whole shard. The shards' answers are merged by distance.

All distances are sums of squared differences in double precision, in the search of vectors scaled by a power of two
(exact), and for the score of the original ones; no expansion into norms loses digits of far or tiny vectors.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an
id; vectors of different lengths are never compared; ties go to the smaller id; a table without queries or candidates
gives an empty result; rows that repeat an id are candidates once for each different vector, and show once, with the
nearest; a query id that repeats asks with the smallest of its vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docproof.llm.common import save, write

SHARD_ROWS = 4096
QUERY_BLOCK = 2048
DEGREE = 28
BEAM = 56
ALPHA = 1.2
BATCH = 256
OCTAVES = 128


def squares(difference: np.ndarray) -> np.ndarray:
    return np.einsum("...d,...d->...", difference, difference)


class Graph:
    """A directed graph over the rows of ``vectors``; ``out`` has each row's neighbours, padded with -1."""

    def __init__(self, vectors: np.ndarray, out: np.ndarray | None = None) -> None:
        _, power = np.frexp(np.abs(vectors).max())
        self.power = -int(power)
        self.x = self.scaled(vectors)
        self.start = int(np.argmin(squares(self.x - self.x.mean(axis=0))))
        self.out = out

    def scaled(self, vectors: np.ndarray) -> np.ndarray:
        """In the graph's range. What lies far outside is cut off where its squares stay finite: from there all of the
        shard is equally far."""
        with np.errstate(over="ignore", under="ignore"):
            return np.clip(np.ldexp(np.ascontiguousarray(vectors, dtype=np.float64), self.power), -1e150, 1e150)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy beam search for many queries at once: (ids, squared scaled distances) of each beam, the rows visited."""
        return self._walk(self.scaled(queries), beam)

    def _walk(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, rows = len(queries), np.arange(len(queries))
        ids = np.full((n, beam), -1)
        dist = np.full((n, beam), np.inf)
        done = np.ones((n, beam), dtype=bool)
        ids[:, 0], done[:, 0] = self.start, False
        dist[:, 0] = squares(queries - self.x[self.start])
        seen = np.zeros((n, len(self.x)), dtype=bool)
        seen[:, self.start] = True
        visited = []
        while len(rows):
            at = np.argmin(np.where(done[rows], np.inf, dist[rows]), axis=1)
            live = ~done[rows, at]
            rows, at = rows[live], at[live]
            if not len(rows):
                break
            node = ids[rows, at]
            done[rows, at] = True
            step = np.full(n, -1)
            step[rows] = node
            visited.append(step)
            near = self.out[node]
            fresh = near >= 0
            fresh &= ~seen[rows[:, None], near]
            seen[rows[:, None], near] |= fresh
            d = np.where(fresh, squares(self.x[near] - queries[rows, None]), np.inf)
            all_d = np.concatenate([dist[rows], d], axis=1)
            best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            take = lambda a, best=best: np.take_along_axis(a, best, axis=1)
            dist[rows] = take(all_d)
            ids[rows] = take(np.concatenate([ids[rows], np.where(fresh, near, -1)], axis=1))
            done[rows] = take(np.concatenate([done[rows], ~fresh], axis=1))
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1), np.stack(visited, axis=1)

    def prune(self, nodes: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
        """At most ``degree`` diverse neighbours for each node, from its row of candidates (padded with -1). Candidates
        are taken relative to their node: what the norms between them lose is small against their distance to it."""
        candidates = np.sort(candidates, axis=1)
        bad = (candidates < 0) | (candidates == nodes[:, None])
        bad[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
        v = self.x[candidates] - self.x[nodes, None]
        norm = squares(v)
        to_node = np.where(bad, np.inf, norm)
        out = np.full((len(nodes), degree), -1)
        rows = np.arange(len(nodes))
        for k in range(degree):
            at = np.argmin(to_node, axis=1)
            open_ = np.isfinite(to_node[rows, at])
            if not open_.any():
                break
            out[open_, k] = candidates[rows, at][open_]
            d = norm + norm[rows, at, None] - 2 * np.matmul(v, v[rows, at][:, :, None])[:, :, 0]
            to_node[alpha * alpha * np.maximum(d, 0) <= to_node] = np.inf
            to_node[rows, at] = np.inf
        return out

    def build(self, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7) -> Graph:
        n, dice = len(self.x), np.random.default_rng(seed)
        self.out = np.full((n, degree), -1)
        order = dice.permutation(n)
        order = np.concatenate([[self.start], order[order != self.start]])
        first = order[: min(n, 2 * degree)]
        self.out[first] = self.prune(first, np.tile(first, (len(first), 1)), alpha, degree)
        for at in range(len(first), n, BATCH):
            nodes = order[at : at + BATCH]
            ids, _, visited = self._walk(self.x[nodes], beam)
            self.out[nodes] = self.prune(nodes, np.concatenate([ids, visited], axis=1), alpha, degree)
            self._reverse(nodes, alpha, degree)
        return self

    def _reverse(self, nodes: np.ndarray, alpha: float, degree: int) -> None:
        ends, starts = self.out[nodes].ravel(), np.repeat(nodes, degree)
        starts, ends = starts[ends >= 0], ends[ends >= 0]
        order = np.argsort(ends, kind="stable")
        starts, ends = starts[order], ends[order]
        to, first, count = np.unique(ends, return_index=True, return_counts=True)
        for size in np.unique(count):
            mine = np.nonzero(count == size)[0]
            incoming = starts[first[mine][:, None] + np.arange(size)]
            both = np.concatenate([self.out[to[mine]], incoming], axis=1)
            self.out[to[mine]] = self.prune(to[mine], both, alpha, degree)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; sums of squares that leave its range are taken from scaled differences."""
    with np.errstate(over="ignore", under="ignore"):
        difference = x - y
        found = squares(difference)
        odd = ~((found > 1e-280) & (found < np.inf))
        out = np.sqrt(found)
        if odd.any():
            half = x[odd] / 2 - np.broadcast_to(y, x.shape)[odd] / 2
            most = np.abs(half).max(axis=-1, keepdims=True)
            out[odd] = np.where(most[:, 0] > 0, most[:, 0] * np.sqrt(squares(half / np.where(most > 0, most, 1))) * 2, 0)
    return out


def vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (doubles): the rows that take part."""
    ok = "id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)"
    return table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(ok)


def build_index(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A written table with a row for each shard: size (of its vectors) and, an entry for each different vector, v,
    members (its k + 1 smallest ids) and near (the places of its neighbours)."""
    rows = vectors(table, id_col, vector_col).withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    nodes = save(rows.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("members")), "nodes")
    shards = max(1, -(-nodes.count() // shard_rows))
    magnitude = F.floor(F.log2(F.array_max(F.transform("v", lambda x: F.abs(x)))) / OCTAVES).cast("int")
    nodes = nodes.select(F.size("v").alias("size"), magnitude.alias("magnitude"), F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard"), "v", "members")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("members", key=lambda m: m.map(lambda ids: ids[0]), kind="stable", ignore_index=True)
        x = _matrix(group["v"])
        near = Graph(x).build().out
        return pd.DataFrame({"size": [x.shape[1]], "v": [x.ravel()], "members": [group["members"].tolist()], "near": [[row[row >= 0] for row in near]]})

    schema = "size int, v array<double>, members array<array<long>>, near array<array<int>>"
    return save(nodes.groupBy("size", "magnitude", "shard").applyInPandas(build, schema), "graph")


def _blocks(folder: str) -> Iterator[pd.DataFrame]:
    """The written queries in blocks of bounded size."""
    from pyarrow import dataset, fs

    store, place = fs.FileSystem.from_uri(folder)
    for batch in dataset.dataset(place, filesystem=store, format="parquet").to_batches(columns=["id", "v"], batch_size=QUERY_BLOCK):
        if batch.num_rows:
            yield batch.to_pandas()


def search_index(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score for ``queries`` (id, v): the k nearest found, without the query's own id."""
    asked = write(queries, "asked")

    def answers(graph: Graph, x: np.ndarray, members: list, ask: np.ndarray, q: np.ndarray) -> list[tuple]:
        found = []
        ids, _, _ = graph.search(q, max(beam, k + 1))
        for query, vector, row in zip(ask, q, ids, strict=True):
            row = row[row >= 0]
            if len(row) < min(len(x), k + 1):
                row = np.arange(len(x))
            hits, shown = [], set()
            for s, m in sorted((s, m) for s, i in zip(distances(x[row], vector), row, strict=True) for m in members[i] if m != query):
                if m not in shown and len(hits) < k:
                    hits.append((query, m, s))
                    shown.add(m)
            found += hits
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, v, members, near in zip(batch["size"], batch["v"], batch["members"], batch["near"], strict=True):
                x = np.asarray(v, dtype=np.float64).reshape(-1, size)
                out = np.full((len(x), max(1, *(len(a) for a in near), 1)), -1)
                for i, row in enumerate(near):
                    out[i, : len(row)] = row
                graph = Graph(x, out)
                for block in _blocks(asked):
                    block = block[block["v"].map(len) == size]
                    for at in range(0, len(block), BATCH):
                        part = block.iloc[at : at + BATCH]
                        yield pd.DataFrame(answers(graph, x, members, part["id"].to_numpy(), _matrix(part["v"])), columns=["query_id", "vec_id", "score"])

    spread = index.repartition(max(index.sparkSession.sparkContext.defaultParallelism, index.count()))
    found = spread.mapInPandas(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest of each row whose id is divisible by ``every``, among all rows but its own."""
    queries = vectors(table, id_col, vector_col).where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    return search_index(build_index(table, id_col, vector_col, k, shard_rows), queries, k)
