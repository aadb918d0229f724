"""Pairs of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Candidates share a bucket: a band of BAND MinHash values (a pair at 0.8 is in none of BANDS
bands with probability 5e-6) or a table of the covering masks of its SimHash. Every link is
verified on the whole sets of shingle hashes. Each node is compared with the first one of its
buckets; buckets that then still hold several components are compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import group_starts, slices, whole_groups
from .components import connected_components
from .memory import claim
from .store import materialize, partitions

SEED = 42
BAND, BANDS = 6, 40
#: Bytes of MinHash values that a pair is estimated by, and how many must agree: 64 of 128 lies
#: over 8 deviations below what a pair at 0.8 has.
SKETCH, AGREE = 128, 64
#: Rows of one bucket that a task compares at once.
BLOCK = 1024
FACTORS = np.random.default_rng(11).integers(0, 2**63, BAND * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle_words: int) -> tuple[np.ndarray, int]:
    """Sorted hashes of the distinct shingles, and the SimHash, as ``fingerprints`` defines them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64), 0
    n = max(1, len(words) - shingle_words + 1)
    h = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle_words] if n > 1 else words), SEED) for i in range(n)], "<u8")
    votes = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.unique(h), int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        z = (z ^ (z >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return z ^ (z >> np.uint64(33))


def set_id(h: np.ndarray) -> int:
    """Order-free hash of a set, as a signed long; 0 for the empty set."""
    return int(np.add.reduce(_mix(h), dtype=np.uint64).astype(np.uint64).view(np.int64)) if len(h) else 0


def min_hashes(h: np.ndarray) -> np.ndarray:
    low = np.full(len(FACTORS), np.uint64(2**64 - 1))
    for s in range(0, len(h), 256):
        low = np.minimum(low, (h[None, s : s + 256] * FACTORS[:, None]).min(1))
    return _mix(low)


def sketches(docs: DataFrame, shingle_words: int) -> DataFrame:
    """``key``, ``th``, ``id`` (of the set), ``fp``, ``bands`` and ``sketch`` of rows ``k``, ``th``, ``t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near-copies", lambda: None)
        for batch in batches:
            for part in slices(batch, 2):
                ids, fps, bands, sketch = [], [], [], []
                for text in part.column(2).to_pylist():
                    h, fp = shingle_set(text, shingle_words)
                    low = min_hashes(h)
                    ids.append(set_id(h))
                    fps.append(fp)
                    bands.append(np.add.reduce(_mix(low.reshape(BANDS, BAND) + np.arange(BAND, dtype=np.uint64)), 1).view(np.int64))
                    sketch.append(low[:SKETCH].astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.int64()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["key", "th", "id", "fp", "bands", "sketch"])

    return docs.select("k", "th", "t").mapInArrow(run, "key long, th long, id long, fp long, bands array<long>, sketch binary")


def _sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near-copies", lambda: None)
        for batch in batches:
            for part in slices(batch, 0):
                found = [shingle_set(t, shingle_words)[0] for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(h) for h in found], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())], ["id", "body"])

    return docs.select("t").mapInArrow(run, "id long, body binary").dropDuplicates(["id"])


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle_words: int) -> DataFrame:
    """The pairs ``a``, ``b`` at 0.8 or more."""
    need = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(nodes.select("id", "low"), "id")
    need = materialize(need.select(F.col("low").alias("k")).distinct(), "near-needed")
    sets = materialize(_sets(docs.join(need, "k", "left_semi"), shingle_words), "near-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(5 * both >= 4 * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    rows = pairs.join(sets.select(F.col("id").alias("a"), F.col("body").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("body").alias("y")), "b")
    return materialize(rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "near-links")


def _cross_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of one bucket that are of different components and that their sketches let pass."""
    keys = ["t", "key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, 5000):
            n, starts = table.num_rows, group_starts(table, keys)
            ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
            ids, root = table.column("id").to_numpy(), table.column("root").to_numpy()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(n, SKETCH)
            at, step = np.arange(n), 1
            while True:
                at = at[at + step < ends[at]]
                if not len(at):
                    break
                a = at[root[at] != root[at + step]]
                a = a[(sketch[a] == sketch[a + step]).sum(1) >= AGREE]
                x, y = ids[a], ids[a + step]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
                step += 1

    dealt = rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_links(docs: DataFrame, nodes: DataFrame, masks: list[int], shingle_words: int) -> DataFrame:
    """Edges ``a``, ``b`` between ids of ``nodes`` (id, low, fp, bands, sketch) that connect those
    at 0.8 or more; ``docs`` has the keys ``k`` and texts ``t``."""
    by_fp = F.array(*[F.struct(F.lit(-1 - t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
    by_band = F.transform("bands", lambda x, t: F.struct(t.alias("t"), x.alias("key")))
    keyed = nodes.where("id != 0").select("id", F.explode(F.concat(by_fp, by_band)).alias("x")).select("id", "x.t", "x.key")
    shared = materialize(keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("id").alias("lead")).where("n > 1"), "near-buckets")
    rows = materialize(keyed.join(shared, ["t", "key"]).select("t", "key", "id", "n", "lead"), "near-rows")
    first = materialize(rows.where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "near-pairs")
    links = _verified(first, docs, nodes, shingle_words)
    found = connected_components(links)
    rows = rows.join(found, rows["id"] == found["node"], "left").select("t", "key", "id", "n", F.coalesce("root", "id").alias("root"))
    rows = materialize(rows, "near-rows")
    open_ = rows.groupBy("t", "key").agg((F.min("root") != F.max("root")).alias("several")).where("several").select("t", "key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.join(open_, ["t", "key"]).join(nodes.select("id", "sketch"), "id").withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "root", "sketch")
    rest = materialize(_cross_pairs(rows), "near-pairs").join(first, ["a", "b"], "left_anti")
    return links.unionByName(_verified(materialize(rest, "near-pairs"), docs, nodes, shingle_words))
