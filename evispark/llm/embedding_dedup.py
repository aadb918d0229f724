"""Embedding near-dedup: random-hyperplane sign hashing, exact cosines, components.

Each of TABLES tables hashes a vector to the signs of its products with BITS random
hyperplanes. Vectors that share a label and a table's signs are compared exactly. Equal
vectors are one node, so copies are never compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import chain, forest, group_starts, whole_groups
from .components import connected_components
from .store import materialize, partitions
from .vectors import cosines, matrix, unit, usable

#: A pair at cosine 0.98 shares 20 signs of one table with probability 0.27, and those of one
#: table of 24 at least with probability 0.9994.
BITS, TABLES, SEED = 20, 24, 11
#: Rows of one bucket that a task compares at once; larger buckets are dealt in pairs of blocks.
BLOCK = 1024


def hyperplanes(width: int) -> np.ndarray:
    """Normals of all tables; those of a shorter vector are the first components of these."""
    return np.stack([np.random.default_rng((SEED, i)).normal(size=BITS * TABLES) for i in range(width)], 1)


def signatures(rows: np.ndarray) -> np.ndarray:
    """One integer of BITS signs per row and table."""
    signs = (unit(rows) @ hyperplanes(rows.shape[1]).T > 0).reshape(len(rows), TABLES, BITS)
    return (signs * (1 << np.arange(BITS))).sum(2).astype(np.int32)


def link_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """Links and components of all rows.

    Rows link if their labels are equal and not null and their cosine is ``threshold`` or more,
    in double precision. Returns ``key``, ``n_links`` (other rows linked directly),
    ``component_id`` (smallest key reachable, itself included) and ``kept`` (whether it is the
    row's own key). A vector that is null, empty, zero or holds null or non-finite components,
    and a row with a null label, links with nothing. Vectors of different length compare as if
    padded with zeros. Rows with a null key link and count, and have the smallest key of their
    component, null if it has none; they are kept if it has none. Repeated rows are rows of their
    own. An empty table gives an empty result; other columns are not read.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"), F.col(label).alias("l"))
    rows = rows.withColumn("ok", usable(F.col("v")) & F.col("l").isNotNull())
    classes = rows.where("ok").groupBy("l", "v").agg(F.min("k").alias("low"), F.count("*").alias("n"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                signs = signatures(matrix(batch.column("v")))
                yield batch.append_column("signs", pa.ListArray.from_arrays(np.arange(0, signs.size + 1, TABLES, dtype=np.int32), signs.ravel()))

    shape = classes.withColumn("node", F.monotonically_increasing_id())
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shape.schema)
    nodes = materialize(shape.mapInArrow(sign, f"{kinds}, signs array<int>"), "vector-classes")

    keyed = nodes.select("node", "l", F.posexplode("signs").alias("t", "sign"))
    group = ["l", "t", "sign"]
    shared = materialize(keyed.groupBy(*group).agg(F.count("*").alias("m")).where("m > 1"), "sign-buckets")
    dealt = keyed.join(shared, group).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node")
    cell = [*group, "i", "j"]
    dealt = dealt.join(nodes.select("node", "v", "n", "signs"), "node").repartition(partitions(df.sparkSession), *cell).sortWithinPartitions(*cell)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, cell, 4096):
            starts = [*group_starts(table, cell).tolist(), table.num_rows]
            node, own, copies = (table.column(c).to_numpy() for c in ("node", "own", "n"))
            tables, i, j = (table.column(c).to_numpy() for c in ("t", "i", "j"))
            signs = matrix(table.column("signs")).astype(np.int32)
            raw = matrix(table.column("v"))
            x = unit(raw)
            counts = np.zeros(table.num_rows, np.int64)
            found_a, found_b = [], []
            for a, b in zip(starts, starts[1:]):
                product = x[a:b] @ x[a:b].T
                near = product >= threshold
                p, q = np.nonzero(np.abs(product - threshold) < 1e-9)  # summed in one order, whatever the block
                near[p, q] = cosines(raw[a:b][p], raw[a:b][q]) >= threshold
                np.fill_diagonal(near, False)
                if i[a] != j[a]:
                    near &= own[a:b, None] != own[None, a:b]
                if not near.any():
                    continue
                for t in range(tables[a]):  # a pair counts in the first table that it shares
                    near &= signs[a:b, t][:, None] != signs[None, a:b, t]
                counts[a:b] = near @ copies[a:b]
                left, right = chain(forest(*np.nonzero(np.triu(near)), b - a))
                found_a.append(node[a:b][left])
                found_b.append(node[a:b][right])
            hit = counts > 0
            ends_a, ends_b = (np.concatenate([np.zeros(0, np.int64), *f]) for f in (found_a, found_b))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[hit], ends_a])), pa.array(np.concatenate([node[hit], ends_b])), pa.array(np.concatenate([counts[hit], np.zeros(len(ends_a), np.int64)]))], ["a", "b", "links"])

    found = materialize(dealt.mapInArrow(verify, "a long, b long, links long"), "vector-links")
    roots = connected_components(found.where("a != b").select("a", "b"))
    direct = found.groupBy("a").agg(F.sum("links").alias("links"))
    member = nodes.select("node", "l", "v", "low", "n").join(roots.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left").join(direct, F.col("node") == F.col("a"), "left")
    member = materialize(member.select("l", "v", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "vector-members")
    lowest = materialize(member.groupBy("root").agg(F.min("low").alias("component")), "vector-lowest")
    member = materialize(member.join(lowest, "root").select(F.xxhash64("l", "v").alias("h"), F.col("l").alias("l_"), F.col("v").alias("v_"), "n_links", "component"), "vector-members")
    own = F.when(F.col("ok"), F.xxhash64("l", "v"))
    out = rows.withColumn("h_", own).join(member, (F.col("h_") == F.col("h")) & (F.col("l") == F.col("l_")) & (F.col("v") == F.col("v_")), "left")
    component = F.when(F.col("ok"), F.col("component")).otherwise(F.col("k"))
    return out.select(
        F.col("k").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("k").eqNullSafe(component).alias("kept"),
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all embeddings at cosine 0.98 within labels."""
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
