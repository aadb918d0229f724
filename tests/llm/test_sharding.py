import math
import struct
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from evispark.llm.sharding import Leaf, choose_shard, layout, shard_rows


def xx(seed, value, width="<q"):
    return xxhash.xxh64_intdigest(struct.pack(width, value), seed)


def slow_shard(key, leaves):
    """The definition: at each level the child with the largest ln(u) / weight."""
    nodes, left = 0, leaves
    for level, of in enumerate((lambda x: x.region, lambda x: x.region * 100_003 + x.rack, lambda x: x.shard)):
        best = None
        for child in sorted({of(x) for x in left}):
            weight = sum(x.weight for x in left if of(x) == child)
            h = xx(42, key) if key is not None else 42
            h = xx(xx(h, level, "<i"), child, "<i")
            draw = (math.log(((h >> 11) + 0.5) * 2.0**-53) / weight, child)
            best = max(best, draw) if best else draw
        left = [x for x in left if of(x) == best[1]]
        nodes = best[1]
    return nodes


def shards(spark, keys, leaves):
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", choose_shard(F.col("k"), leaves).alias("s"))
    return {r.k: r.s for r in df.collect()}


def test_matches_definition_and_slots(spark):
    rows = [(i * 7, "é" * (i % 5)) for i in range(500)] + [(None, "x"), (None, None), (3, ""), (3, ""), (3, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = shard_rows(df).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(k), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in rows)
    for r in got:
        assert r.shard == slow_shard(r.doc_id, layout(24)) and r.grown_shard == slow_shard(r.doc_id, layout(25))
        assert r.grown_shard in (r.shard, 24) and r.law == "key"
    for shard, n in Counter(r.shard for r in got).items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))


def test_growth_and_balance(spark):
    keys = list(range(20_000))
    before = shards(spark, keys, layout(24))
    counts = Counter(before.values())
    assert set(counts) == set(range(24)) and max(counts.values()) < 1.2 * len(keys) / 24
    for n in (25, 26, 27):
        after = shards(spark, keys, layout(n))
        assert all(after[k] in (before[k], n - 1) for k in keys) and 0 < sum(after[k] != before[k] for k in keys) < 1.3 * len(keys) / n
        before = after


def test_weights_confine_movement(spark):
    keys = list(range(10_000))
    leaves = layout(24)
    heavier = [Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in leaves]
    before, after = shards(spark, keys, leaves), shards(spark, keys, heavier)
    region = {x.shard: x.region for x in leaves}
    rack = {x.shard: (x.region, x.rack) for x in leaves}
    moved = [k for k in keys if before[k] != after[k]]
    assert moved and all(region[after[k]] == 0 for k in moved)
    assert all(after[k] == 5 or rack[before[k]] != rack[after[k]] for k in moved)
    assert Counter(after.values())[5] > 2 * Counter(before.values())[5]


def test_empty_and_weightless(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shard_rows(df).collect() == []
    assert shards(spark, [1], [Leaf(0, 0, 0, 0.0)]) == {1: None}
