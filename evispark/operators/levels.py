"""Parents in a sequence of levels, found in parallel within one sequence.

The parent of a row is the nearest earlier row of a smaller level. A sequence is cut into chunks
of neighbouring rows. What a chunk means to later ones is, for each level, its last row below that
level: a staircase that two neighbouring chunks combine by taking the later row, level by level.
So a running maximum over chunks gives each chunk what it inherits, and rows of one sequence need
not meet in one task. Only the staircases (a row per chunk) are ordered by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Largest level; a row above it is an error.
DEEPEST = 99


def nearest_below(level: np.ndarray, n: np.ndarray, inherited: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each row's nearest earlier row of a smaller level, -1 if none: in these rows, or in
    ``inherited[k]``, the last earlier row below level k. Also what the next rows inherit."""
    parent, after = np.full(len(level), -1, np.int64), inherited.copy()
    for k in np.unique(level).tolist():
        mine = np.flatnonzero(level == k)
        last = np.maximum.accumulate(np.where(level < k, n, -1))
        parent[mine] = np.maximum(last[mine], inherited[k])
    for k in range(1, DEEPEST + 1):
        below = np.flatnonzero(level < k)
        if len(below):
            after[k] = n[below[-1]]
    return parent, after


def chunk_parents(df: DataFrame, sequence: str, chunk: str, order: str, level: str) -> DataFrame:
    """Add ``parent``, the ``order`` of the nearest earlier row of a smaller level, and ``root``, the
    ``order`` of the record's first row (the row itself at level 0), both null where there is none.

    The rows of a chunk must lie next to each other in one partition, by rising ``order`` (a long, at
    least 0); chunks of a sequence are ordered by ``chunk``, and ``order`` rises over them. ``df`` is
    computed twice. Levels over DEEPEST or below 0 fail the query.
    """
    at = [df.columns.index(c) for c in (sequence, chunk, order, level)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, inherited = None, np.full(DEEPEST + 1, -1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            levels = batch.column(at[3]).to_numpy(zero_copy_only=False).astype(np.int64)
            if levels.min() < 0 or levels.max() > DEEPEST:
                raise ValueError(f"level {levels.max()} is over {DEEPEST}, or a level is below 0")
            keys = list(zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist()))
            n = batch.column(at[2]).to_numpy(zero_copy_only=False).astype(np.int64)
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            parent, root = np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64)
            for a, b in zip(edges, edges[1:]):
                if keys[a] != here:
                    here, inherited = keys[a], np.full(DEEPEST + 1, -1, np.int64)
                before = inherited[1]
                parent[a:b], inherited = nearest_below(levels[a:b], n[a:b], inherited)
                root[a:b] = np.maximum(np.maximum.accumulate(np.where(levels[a:b] == 0, n[a:b], -1)), before)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parent), pa.array(root)], [*batch.schema.names, "parent", "root"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    local = df.mapInArrow(run, f"{kinds}, parent long, root long")

    tops = df.groupBy(F.col(sequence).alias("s_"), F.col(chunk).alias("c_"), F.col(level).alias("l")).agg(F.max(order).alias("n"))
    tops = tops.groupBy("s_", "c_").agg(F.collect_list(F.struct("l", "n")).alias("tops"))  # at most one a level
    below = lambda k: F.array_max(F.transform(F.filter("tops", lambda x: x["l"] < k), lambda x: x["n"]))
    stairs = tops.select("s_", "c_", F.transform(F.sequence(F.lit(1), F.lit(DEEPEST)), lambda k: F.coalesce(below(k), F.lit(-1))).alias("last"))
    stairs = stairs.select("s_", "c_", F.posexplode("last").alias("k", "last"))
    earlier = Window.partitionBy("s_", "k").orderBy("c_").rowsBetween(Window.unboundedPreceding, -1)
    carried = stairs.withColumn("last", F.max("last").over(earlier)).groupBy("s_", "c_").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "last"))), lambda x: x["last"]).alias("inherited"))  # DEEPEST entries
    out = local.join(carried, F.col(sequence).eqNullSafe(F.col("s_")) & F.col(chunk).eqNullSafe(F.col("c_")), "left")
    inherited = lambda k: F.try_element_at("inherited", k)
    found = lambda own, k: F.nullif(F.when(F.col(own) >= 0, F.col(own)).otherwise(F.when(F.col(level) > 0, F.coalesce(inherited(k), F.lit(-1))).otherwise(F.lit(-1))), F.lit(-1))
    return out.select(*(F.col(c) for c in df.columns), found("parent", F.greatest(F.col(level), F.lit(1)).cast("int")).alias("parent"), found("root", F.lit(1)).alias("root"))
