"""Approximate nearest neighbours by balanced posting lists.

A bounded sample is split by balanced bisection; the parts' means are centroids, held in memory
with a neighbour graph. Every vector goes to the list of its nearest centroid and, if it
lies near a border, to others too. A query walks the graph to the nearest centroids and
searches those lists whose distance is within a ratio of the nearest one's, up to a number
that grows slower than the lists. The number of lists grows with the square root of the
vectors. Equal vectors are one entry, and large lists are dealt in blocks, so no task depends
on how vectors repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import group_starts, whole_groups
from .store import materialize, partitions
from .vectors import cosines, matrix, unit, usable

#: Vectors of the sample in each list at least, and most lists; their product bounds the sample
#: that the centroids are fitted on: the vectors with the smallest hash.
PART, MAX_LISTS = 16, 16_384
#: Lists for n vectors: LISTS times the square root of n.
LISTS = 4
#: A vector is replicated to at most REPLICAS lists, within BORDER of its nearest distance.
REPLICAS, BORDER = 3, 1.2
#: A query searches the nearest lists within RATIO of its nearest centroid's distance, at most EXTRA
#: and TIMES the number of lists to the power PROBES.
RATIO, EXTRA, TIMES, PROBES = 1.4, 12, 2.3, 0.6
#: Links of each centroid in the graph.
DEGREE = 24
#: Entries of a list, and queries, that a task compares at once.
BLOCK = 4096


@dataclass
class Lists:
    """Centroids (unit rows) and their neighbour graph."""

    centroids: np.ndarray
    graph: np.ndarray

    def walk(self, rows: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For unit ``rows``: the nearest centroids found by best-first search of the graph, and
        their distances, nearest first. Unused places have distance infinity."""
        n, k = len(rows), len(self.centroids)
        beam = min(beam, k)
        seen = np.zeros((n, k), bool)
        ids = np.zeros((n, beam), np.int64)
        dist = np.full((n, beam), np.inf)
        done = np.ones((n, beam), bool)
        who = np.arange(n)
        ids[:, 0], done[:, 0], seen[:, 0] = 0, False, True
        dist[:, 0] = self._distance(rows, np.zeros((n, 1), np.int64))[:, 0]
        while True:
            open_ = np.where(done, np.inf, dist)
            at = open_.argmin(1)
            active = np.isfinite(open_[who, at])
            if not active.any():
                break
            w = who[active]
            done[w, at[active]] = True
            near = self.graph[ids[w, at[active]]]
            d = self._distance(rows[w], near)
            d[seen[w[:, None], near]] = np.inf
            seen[w[:, None], near] = True
            all_d = np.concatenate([dist[w], d], 1)
            all_i = np.concatenate([ids[w], near], 1)
            all_x = np.concatenate([done[w], ~np.isfinite(d)], 1)
            order = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            dist[w], ids[w], done[w] = (np.take_along_axis(x, order, 1) for x in (all_d, all_i, all_x))
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)

    def _distance(self, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        products = np.einsum("nd,nkd->nk", rows, self.centroids[ids])
        return np.sqrt(np.maximum(2 - 2 * products, 0))

    def homes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: the nearest list, and further ones near a border unless an already
        chosen list's centroid is nearer to theirs than the vector is."""
        ids, dist = self.walk(rows, 6 * REPLICAS)
        take = np.zeros(ids.shape, bool)
        take[:, 0] = True
        for c in range(1, ids.shape[1]):
            close = np.isfinite(dist[:, c]) & (dist[:, c] <= BORDER * dist[:, 0] + 1e-12) & (take.sum(1) < REPLICAS)
            for e in range(c):
                apart = np.sqrt(np.maximum(2 - 2 * (self.centroids[ids[:, e]] * self.centroids[ids[:, c]]).sum(1), 0))
                close &= ~take[:, e] | (apart > dist[:, c] * 0.5)
            take[:, c] = close
        row, at = np.nonzero(take)
        return row, ids[row, at]

    def routes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs that a query searches."""
        lists = len(self.centroids)
        most = min(lists, EXTRA + int(np.ceil(TIMES * lists**PROBES)))
        ids, dist = self.walk(rows, most + most // 4)
        ids, dist = ids[:, :most], dist[:, :most]
        row, at = np.nonzero(np.isfinite(dist) & (dist <= RATIO * dist[:, :1] + 1e-12))
        return row, ids[row, at]


def n_lists(vectors: int) -> int:
    """The power of two nearest to LISTS times the square root of ``vectors``, so that each list
    has PART of them at least."""
    most = max(1, min(MAX_LISTS, vectors // PART))
    return min(1 << max(0, round(np.log2(max(1.0, LISTS * vectors**0.5)))), 1 << (most.bit_length() - 1))


def build_lists(sample: np.ndarray, lists: int, seed: int = 5) -> Lists:
    """Centroids of ``lists`` (a power of two) equal parts of the sample and their graph."""
    rng = np.random.default_rng(seed)
    rows = unit(sample)
    parts = [np.arange(len(rows))]
    while len(parts) < lists:
        parts = [half for part in parts for half in _halves(rows, part, rng)]
    means = np.stack([rows[p].mean(0) for p in parts])
    means[np.abs(means).max(1) < 1e-12] = rows[0]
    centroids = unit(means)
    k = len(centroids)
    degree = min(DEGREE, k)
    most = max(1, degree - degree // 4)
    near = np.concatenate([np.argsort(-(centroids[s : s + 512] @ centroids.T), axis=1)[:, :most] for s in range(0, k, 512)])
    ring = (np.arange(k)[:, None] + np.array([1, *(k // d for d in range(2, degree // 4 + 1))])[None]) % k
    return Lists(centroids, np.concatenate([near, ring], 1))


def _halves(rows: np.ndarray, part: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Two equal halves along the line between two means."""
    x = rows[part]
    means = x[rng.choice(len(x), 2, replace=False)]
    for _ in range(6):
        side = x @ (means[1] - means[0])
        upper = side > np.median(side)
        if upper.all() or not upper.any():
            break
        means = np.stack([x[~upper].mean(0), x[upper].mean(0)])
    order = np.argsort(x @ (means[1] - means[0]), kind="stable")
    return [part[order[: len(x) // 2]], part[order[len(x) // 2 :]]]


def nearest(df: DataFrame, queries: F.Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows found by cosine for each row where ``queries`` holds.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (the cosine in double
    precision on the original vectors), nearest first, ties to the smaller key; a row is no
    candidate for its own key. Rows with a null key, and vectors that are null, empty, zero or
    hold null or non-finite components, take no part. Rows that repeat key and vector count once.
    Vectors of different length compare as if padded with zeros. Only the k + 1 smallest keys
    of equal vectors can be among the nearest, so only those are carried: nothing is lost. An
    empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    rows = df.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"), queries.alias("q"))
    rows = rows.groupBy("k", "v").agg(F.max("q").alias("q"))
    first = F.row_number().over(Window.partitionBy("h", "v").orderBy("k"))
    few = rows.withColumn("h", F.xxhash64("v")).withColumn("r", first).where(F.col("r") <= k + 1)
    entries = materialize(few.groupBy("h", "v").agg(F.sort_array(F.collect_list("k")).alias("keys")).select("h", "v", "keys"), "vectors")
    many = n_lists(entries.count())
    sample = entries.orderBy("h", "v").limit(PART * many).select("v").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = build_lists(matrix(sample.column("v")), many)
    width = lists.centroids.shape[1]

    def place(routed: bool):
        """Adds ``lists``, those of each row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    x = unit(matrix(part.column("v"), width)[:, :width])
                    row, home = (lists.routes if routed else lists.homes)(x)
                    ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                    found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(home, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, "lists"])

        return run

    vector_type = entries.schema["v"].dataType.simpleString()
    postings = entries.select("v", "keys").mapInArrow(place(False), f"v {vector_type}, keys array<long>, lists array<int>")
    postings = materialize(postings, "postings").select("v", "keys", F.explode("lists").alias("list"))
    asked = rows.where("q").select("v", "k").mapInArrow(place(True), f"v {vector_type}, k long, lists array<int>")
    asked = materialize(asked, "routes").select("v", "k", F.explode("lists").alias("list"))

    def blocks(kind: DataFrame, name: str) -> DataFrame:
        return kind.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    plan = F.broadcast(materialize(blocks(postings, "p").join(blocks(asked, "a"), "list"), "list-blocks"))  # a row per list: MAX_LISTS at most
    cell = ["list", "i", "j"]
    left = postings.join(plan, "list").select("list", F.pmod(F.xxhash64("keys"), "p").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("a") - 1)).alias("j"), F.lit(None).cast("long").alias("query"), "keys", "v")
    right = asked.join(plan, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i"), F.pmod(F.xxhash64("k"), "a").cast("int").alias("j"), F.col("k").alias("query"), F.array().cast("array<long>").alias("keys"), "v")
    dealt = left.unionByName(right).repartition(partitions(spark), *cell).sortWithinPartitions(*cell)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, cell, 4096):
            starts = [*group_starts(table, cell).tolist(), table.num_rows]
            query = table.column("query").to_numpy(zero_copy_only=False)
            is_query = ~np.isnan(query.astype(float))
            ids = table.column("query").to_pylist()
            x = matrix(table.column("v"))
            keys = table.column("keys").to_pylist()
            u = unit(x)
            out_q, out_k, out_s = [], [], []
            for a, b in zip(starts, starts[1:]):
                asks, has = np.flatnonzero(is_query[a:b]) + a, np.flatnonzero(~is_query[a:b]) + a
                if not len(asks) or not len(has):
                    continue
                for at in range(0, len(asks), 256):
                    some = asks[at : at + 256]
                    s = u[some] @ u[has].T
                    # entries within rounding of the k-th best are all scored, whatever their number; one may be the query's own
                    least = np.partition(s, len(has) - 1 - k, axis=1)[:, len(has) - 1 - k] if len(has) > k + 1 else np.full(len(some), -2.0)
                    r, c = np.nonzero(s >= least[:, None] - 1e-9)
                    exact = -cosines(x[some[r]], x[has[c]])
                    ends = np.searchsorted(r, np.arange(len(some) + 1))
                    for i, q in enumerate(some):
                        got = sorted((exact[e], kk) for e in range(ends[i], ends[i + 1]) for kk in keys[has[c[e]]] if kk != ids[q])[:k]
                        out_q.extend([ids[q]] * len(got))
                        out_k.extend(kk for _, kk in got)
                        out_s.extend(-ss for ss, _ in got)
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_k, pa.int64()), pa.array(out_s, pa.float64())], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 nearest of every embedding whose id is divisible by 50, among all others."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
