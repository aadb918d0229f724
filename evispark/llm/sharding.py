"""Sharding by a weighted hash tree of regions, racks and shards.

A key descends from the root: at each level every child draws ln(u) / weight, where u is a
hash of the key and the child, and the largest draw wins. A child's draw depends on its own
weight alone, so a changed weight moves keys only into or out of the subtrees whose weights
change. A shard that is added later opens a region of its own, so it only takes keys itself.
Everything is built-in SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize

#: Buckets of each shard in which slots are numbered apart; the numbering scales with them.
BUCKETS = 4096


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(n_shards: int, base: int = 24, rack_shards: int = 4, region_racks: int = 2) -> list[Leaf]:
    """Tree of ``n_shards`` equal shards: the first ``base`` fill racks and regions in order,
    each later one has a region of its own."""
    leaves = []
    for s in range(min(n_shards, base)):
        rack = s // rack_shards
        leaves.append(Leaf(rack // region_racks, rack % region_racks, s))
    first = -(-base // (rack_shards * region_racks))
    return leaves + [Leaf(first + s - base, 0, s) for s in range(base, n_shards)]


def _levels(leaves: list[Leaf]) -> list[dict[int, list[tuple[int, float]]]]:
    """For each level, the children (id, weight) of each node; ids are unique in a level."""
    out: list[dict[int, dict[int, float]]] = [{}, {}, {}]
    for x in leaves:
        if x.weight > 0:
            rack = x.region * 100_003 + x.rack
            for level, (parent, child) in enumerate(((0, x.region), (x.region, rack), (rack, x.shard))):
                children = out[level].setdefault(parent, {})
                children[child] = children.get(child, 0.0) + x.weight
    return [{p: sorted(c.items()) for p, c in level.items()} for level in out]


def choose_shard(key: Column, leaves: list[Leaf]) -> Column:
    """Shard of ``key`` (null is a key too); null if no leaf has weight."""
    node = F.lit(0)
    for level, children in enumerate(_levels(leaves)):
        entries = [x for parent, kids in children.items() for x in (F.lit(parent), F.array(*[F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("w")) for i, w in kids]))]
        if not entries:
            return F.lit(None).cast("int")
        kids = F.element_at(F.create_map(*entries), node)
        node = F.array_max(F.transform(kids, _draw(key, level)))["id"]
    return node


def _draw(key: Column, level: int) -> Callable[[Column], Column]:
    """Draw of one child of a level."""

    def draw(child: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), child["id"]), 11).cast("double") + 0.5) * F.lit(2.0**-53)
        return F.struct((F.ln(u) / child["w"]).alias("draw"), child["id"].alias("id"))

    return draw


def shard_rows(df: DataFrame, n_shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every row by its key.

    Returns ``key``, ``size`` (UTF-8 bytes of the text, none for null, plus 8), ``text_crc32``
    (0 for null), ``law`` ('key'), ``shard``, ``slot`` (0, 1, ... within the shard) and
    ``grown_shard`` (with one more shard). Rows with a null key share one shard. Rows that agree
    in key, size and checksum are counted before the shuffle and numbered one after the other,
    so repeats of one key never meet in a task as rows until they are written. An empty table
    gives an empty result; other columns are not read.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias("k"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"))
    rows = materialize(rows.groupBy("k", "size", "crc").agg(F.count("*").alias("n")), "shard-rows")
    placed = rows.select("*", choose_shard(F.col("k"), layout(n_shards)).alias("shard"), choose_shard(F.col("k"), layout(n_shards + 1)).alias("grown"), F.pmod(F.xxhash64("k", "size", "crc"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("total"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "bucket").orderBy("k", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(base, ["shard", "bucket"])
    return numbered.select(
        F.col("k").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(F.col("base") + F.col("first"), F.col("base") + F.col("first") + F.col("n") - 1)).alias("slot"),
        F.col("grown").alias("grown_shard"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by the ``key`` law."""
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
