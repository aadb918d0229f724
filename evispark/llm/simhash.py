"""SimHash near-dedup with covering locality-sensitive hashing.

A text's fingerprint is the 64-bit majority vote of the hashes of its word shingles. For
radius r, a random map sends each bit position to a vector of r + 1 bits; for every non-zero
vector v, table v keeps the positions whose vector has odd product with v. Up to r differing
positions span at most r dimensions, so some v is orthogonal to all of them, and that table
masks all differing bits away: every pair within the radius collides in some table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import chain, forest, group_starts, slices, whole_groups
from .components import connected_components
from .memory import claim
from .near_copies import near_links, sketches
from .store import bound_batches, materialize, partitions

SEED = 42
#: Rows of one bucket that a task compares at once; larger buckets are split into blocks.
BLOCK = 1024


def fingerprint(text: str | None, shingle_words: int = 4) -> int:
    """Unsigned 64-bit SimHash of one text; 0 without words."""
    return int(fingerprints([text], shingle_words)[0])


def fingerprints(texts: list[str | None], shingle_words: int = 4) -> np.ndarray:
    """Unsigned 64-bit SimHashes. A-Z is lowered; words are runs without ASCII white space;
    a text with fewer words than a shingle has one shingle, a text without words (null and
    empty texts too) has fingerprint zero."""
    out = np.zeros(len(texts), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    owners: list[int] = []
    sizes: list[int] = []

    def flush() -> None:
        h = np.array(hashes, dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        major = (2 * votes > np.array(sizes)[:, None]).astype(np.uint8)
        out[owners] = np.packbits(major, axis=1, bitorder="little").view("<u8")[:, 0]
        for x in (hashes, owners, sizes):
            x.clear()

    for i, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        n = len(words) - shingle_words + 1
        if n <= 1:
            hashes.append(digest(joined, SEED))
            n = 1
        else:
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = [0, *ends[: n - 1].tolist()]
            hashes.extend([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle_words - 1 :] - 1).tolist())])
        owners.append(i)
        sizes.append(n)
        if len(hashes) > 100_000:
            flush()
    if hashes:
        flush()
    return out


def add_fingerprints(df: DataFrame, key: str, text: str, shingle_words: int) -> DataFrame:
    """``key`` and ``fp`` (the fingerprint's bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash", lambda: None)
        for batch in batches:
            for part in slices(batch, 1):
                fps = fingerprints(part.column(1).to_pylist(), shingle_words)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], ["key", "fp"])

    return df.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "key long, fp long")


def covering_masks(radius: int, bits: int = 64, seed: int = 7) -> list[int]:
    """One mask per table: 2 ** (radius + 1) - 1 tables, about half of the bits in each."""
    vectors = np.random.default_rng(seed).integers(0, 2 ** (radius + 1), bits)
    return [
        sum(1 << i for i in range(bits) if bin(int(vectors[i]) & v).count("1") % 2)
        for v in range(1, 2 ** (radius + 1))
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_edges(fps: DataFrame, radius: int) -> DataFrame:
    """Edges ``a``, ``b`` that connect exactly the fingerprints within ``radius`` bits.

    ``fps`` has distinct longs ``fp``. Buckets with one member are dropped by a count that is
    combined before the shuffle. A bucket over BLOCK rows is dealt to pairs of blocks, so that
    no task sees more than two blocks of it. A task keeps a chain through each component
    that the links it verified form, not every pair.
    """
    masks = [_signed(m) for m in covering_masks(radius)]
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
    keyed = fps.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    shared = materialize(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        keyed.join(shared, ["t", "key"])
        .select("t", "key", "fp", n_blocks.alias("blocks"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    dealt = dealt.repartition(partitions(fps.sparkSession), "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["t", "key", "i", "j"]):
            fp = table.column("fp").to_numpy()
            a, b = _close_pairs(fp.view(np.uint64), group_starts(table, ["t", "key", "i", "j"]), radius)
            names, at = np.unique(fp, return_inverse=True)
            x, y = chain(forest(at[a], at[b], len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[x]), pa.array(names[y])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _close_pairs(fp: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one group within ``radius`` bits. Links of a whole row with later rows are
    reduced as they come, so the pairs kept stay near the number of rows."""
    n = len(fp)
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    found_a, found_b, kept = [], [], 0
    rows = np.arange(n)
    step = 1
    while True:
        rows = rows[rows + step < ends[rows]]
        if not len(rows):
            break
        close = np.bitwise_count(fp[rows] ^ fp[rows + step]) <= radius
        found_a.append(rows[close])
        found_b.append(rows[close] + step)
        kept += int(close.sum())
        if kept > 8 * n + 100_000:
            x, y = chain(forest(np.concatenate(found_a), np.concatenate(found_b), n))
            found_a, found_b, kept = [x], [y], len(x)
        step += 1
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *found_a]), np.concatenate([empty, *found_b])


def simhash_groups(df: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 4, radius: int = 4) -> DataFrame:
    """Fingerprint and component of every row.

    Returns ``key``, ``fingerprint`` (16 lowercase hex digits) and ``component_id``: the
    smallest key reachable over links between fingerprints that differ in at most ``radius``
    bits. Equal fingerprints are one node, so copies are never expanded into pairs. Rows with
    a null key keep their fingerprint but take no part in links: their component is null.
    Repeated keys keep one row each. An empty table gives an empty result. Other columns of
    ``df`` are not read.
    """
    bound_batches(df.sparkSession)
    docs = materialize(add_fingerprints(df, key, text, shingle_words), "fingerprints")
    nodes = materialize(docs.where("key is not null").groupBy("fp").agg(F.min("key").alias("low")), "nodes")
    found = connected_components(fingerprint_edges(nodes.select("fp"), radius))
    member = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    member = materialize(member, "members")
    lowest = materialize(member.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    member = materialize(member.join(lowest, "root").select("fp", "component_id"), "members")
    return docs.join(member.withColumnRenamed("fp", "fp_"), docs["fp"] == F.col("fp_"), "left").select(
        F.col("key").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("key").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one document of each group kept: the one with the smallest key, and where that
    has several texts in the group, the smallest text hash.

    Texts are linked if the Jaccard similarity of their shingle sets is 0.8 or more, which is
    verified exactly; candidates are those within ``radius`` bits and those that share a MinHash
    band (near_copies). Texts without words are one group. Rows with a null key are all kept;
    rows that repeat a kept key and text are kept with it.
    """
    bound_batches(docs.sparkSession)
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(text).cast("string").alias("t"))
    drawn = materialize(sketches(rows, shingle_words), "sketches")
    one = drawn.groupBy("id").agg(F.min("key").alias("low"), F.min(F.struct("key", "th")).alias("first"), F.min("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = materialize(one, "nodes")
    links = near_links(rows, nodes, [_signed(m) for m in covering_masks(radius)], shingle_words)
    found = connected_components(links)
    member = nodes.join(found, nodes["id"] == found["node"], "left").select("id", "first", F.coalesce("root", "id").alias("root"))
    member = materialize(member, "members")
    lowest = materialize(member.groupBy("root").agg(F.min("first").alias("kept")), "lowest")
    member = materialize(member.select("id", "root").join(lowest, "root").select("id", "kept"), "members")
    gone = materialize(drawn.select("key", "th", "id").join(member, "id").where(F.struct("key", "th") != F.col("kept")).select(F.col("key").alias("_gone"), F.col("th").alias("_th")).distinct(), "gone")
    return docs.join(gone, (docs[key] == gone["_gone"]) & (F.xxhash64(docs[text].cast("string")) == gone["_th"]), "left_anti")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents: 4-word shingles, radius 4."""
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
