"""Token ids in binary shards with a minimal perfect hash index per shard.

A store is a folder. Each shard has ``<name>.ids``, the raw ids of its documents one after
the other (unsigned, little-endian, 16 bits wide if the vocabulary allows, else 32), and
``<name>.mph``, its index. The index hashes a document key to a slot in constant time by
levels of bit arrays (a key that is alone on its bit of a level is settled there; its slot is
the bit's rank); the slot holds a fingerprint of the key, its offset and its length. A key
that is not in the shard is refused by the fingerprint. ``manifest`` (Parquet) lists shards in
key order with the count of ids before each.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import bound_batches, new_path, partitions
from .tokens import encoder

MAGIC = b"EVTOK\x01"
SHARD_IDS = 8_000_000
SHARD_DOCS = 200_000
LEVELS = 48
SLOTS = np.dtype([("fingerprint", "<u4"), ("length", "<u4"), ("offset", "<u8")])


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer of ``x`` under ``seed``."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def key_hashes(keys: np.ndarray, nulls: np.ndarray, occurrence: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of (key or null, how many equal keys stand before it)."""
    base = _mix(keys.astype(np.int64).view(np.uint64), seed)
    base = np.where(nulls, _mix(np.full(len(keys), 0xA5A5, np.uint64), seed + 1), base)
    return _mix(base ^ _mix(occurrence.astype(np.uint64), seed + 2), seed + 3)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit hashes, with about four bits for each."""

    def __init__(self, words: list[np.ndarray]):
        self.words = words
        counts = [np.bitwise_count(w).astype(np.int64) for w in words]
        ends = np.cumsum([0, *[int(c.sum()) for c in counts]])
        self.ranks = [np.concatenate([[0], np.cumsum(c)[:-1]]) + e for c, e in zip(counts, ends)]

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        words, left, level = [], hashes, 0
        while len(left):
            if level == LEVELS:
                raise ValueError("equal hashes")
            n_words = len(left) * 2 // 64 + 1
            at = _mix(left, 100 + level) % np.uint64(n_words * 64)
            alone = np.bincount(at.astype(np.int64), minlength=n_words * 64) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8").copy())
            left = left[~alone[at.astype(np.int64)]]
            level += 1
        return cls(words)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where no level has it."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for level, (words, ranks) in enumerate(zip(self.words, self.ranks)):
            if not len(left):
                break
            at = _mix(hashes[left], 100 + level) % np.uint64(len(words) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (ranks[word] + np.bitwise_count(below).astype(np.int64))[hit]
            left = left[~hit]
        return out


def _occurrence(keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """Position of each key in its run of equal keys (keys are sorted, nulls first)."""
    n = len(keys)
    new = np.ones(n, bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])
    starts = np.flatnonzero(new)
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def pack_index(keys: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, width: int) -> bytes:
    """Index file of one shard; documents come in the order of the payload."""
    occurrence = _occurrence(keys, nulls)
    for seed in range(1, 1000):
        hashes = key_hashes(keys, nulls, occurrence, seed)
        try:
            perfect = PerfectHash.build(hashes)
            break
        except ValueError:
            continue
    else:
        raise ValueError("no seed gives the keys distinct hashes")
    slots = np.zeros(len(keys), SLOTS)
    at = perfect.slots(hashes)
    slots["fingerprint"][at] = (hashes >> np.uint64(32)).astype(np.uint32)
    slots["length"][at] = lengths
    slots["offset"][at] = np.cumsum(lengths) - lengths
    head = json.dumps({"docs": len(keys), "width": width, "seed": seed, "levels": [len(w) for w in perfect.words]}).encode()
    parts = [MAGIC, struct.pack("<I", len(head)), head, *[w.astype("<u8").tobytes() for w in perfect.words], slots.tobytes(), keys.astype("<i8").tobytes(), np.packbits(nulls, bitorder="little").tobytes()]
    return b"".join(parts)


class ShardIndex:
    """Reads an index file. ``find`` is constant time for each key."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not an index file")
        at = len(MAGIC)
        (size,) = struct.unpack_from("<I", data, at)
        at += 4
        head = json.loads(data[at : at + size])
        at += size
        self.docs, self.width, self.seed = head["docs"], head["width"], head["seed"]
        words = []
        for n in head["levels"]:
            words.append(np.frombuffer(data, "<u8", n, at))
            at += 8 * n
        self.hash = PerfectHash(words)
        self.slots = np.frombuffer(data, SLOTS, self.docs, at)
        at += SLOTS.itemsize * self.docs
        self.keys = np.frombuffer(data, "<i8", self.docs, at)
        at += 8 * self.docs
        self.nulls = np.unpackbits(np.frombuffer(data, np.uint8, (self.docs + 7) // 8, at), count=self.docs, bitorder="little").astype(bool)

    def find(self, keys: np.ndarray, nulls: np.ndarray, occurrence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, offset, length) of each key; offsets count ids from the shard's start."""
        hashes = key_hashes(keys, nulls, occurrence, self.seed)
        at = self.hash.slots(hashes)
        got = self.slots[np.maximum(at, 0)] if self.docs else np.zeros(len(keys), SLOTS)
        found = (at >= 0) & (got["fingerprint"] == (hashes >> np.uint64(32)).astype(np.uint32))
        return found, got["offset"].astype(np.int64), got["length"].astype(np.int64)


def _put(uri: str, data: bytes) -> None:
    """Write a file whole: under another name first, so a task that dies leaves no half file."""
    fs, path = pafs.FileSystem.from_uri(uri)
    attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
    with fs.open_output_stream(f"{path}.{attempt}.part") as out:
        out.write(data)
    fs.move(f"{path}.{attempt}.part", path)


def read_file(uri: str) -> bytes:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def write_store(df: DataFrame, key: str, text: str, path: str, tokenizer: str, spaces: bool, end_id: int, width: int = 2) -> DataFrame:
    """Encode all rows and write them in ascending ``key`` order; returns the manifest.

    Null texts count as empty: each document has at least its end id. Null keys come first;
    rows with equal keys are ordered by their text's hash, and any number of them is dealt
    over many tasks. An empty table makes a store without shards. ``width`` is the bytes of an
    id, 2 or 4; an id that does not fit is refused. Other columns are not read.
    """
    spark = df.sparkSession
    bound_batches(spark)
    fs, local = pafs.FileSystem.from_uri(path)
    fs.create_dir(local, recursive=True)
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("r"))
    rows = rows.repartitionByRange(partitions(spark), "k", "h", "r").sortWithinPartitions("k", "h", "r").select("k", "t")
    kind, largest = {2: ("<u2", 2**16 - 1), 4: ("<u4", 2**32 - 1)}[width]
    if end_id > largest:
        raise ValueError(f"the end id does not fit {width} bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, spaces, end_id), TaskContext.get().partitionId()
        keys: list[int | None] = []
        ids: list[bytes] = []
        sizes: list[int] = []
        shard = total = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, total
            name = f"{part:06d}-{shard:05d}"
            nulls = np.array([k is None for k in keys], bool)
            _put(f"{path}/{name}.ids", b"".join(ids))
            _put(f"{path}/{name}.mph", pack_index(np.array([k or 0 for k in keys], np.int64), nulls, np.array(sizes, np.int64), width))
            row = pa.RecordBatch.from_pylist([{"shard": name, "first_key": keys[0], "last_key": keys[-1], "n_docs": len(keys), "n_ids": total}], MANIFEST)
            shard, total = shard + 1, 0
            for x in (keys, ids, sizes):
                x.clear()
            return row

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = np.frombuffer(enc.encode(t.as_py()), "<u4")
                if len(raw) and int(raw.max()) > largest:
                    raise ValueError(f"id {raw.max()} does not fit {width} bytes")
                keys.append(k)
                ids.append(raw.astype(kind).tobytes())
                sizes.append(len(raw))
                total += len(raw)
                if total >= SHARD_IDS or len(keys) >= SHARD_DOCS:
                    yield flush()
        if keys:
            yield flush()

    shards = rows.mapInArrow(run, "shard string, first_key long, last_key long, n_docs long, n_ids long")
    shards.write.parquet(f"{path}/shards")
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    manifest = spark.read.parquet(f"{path}/shards").withColumn("start", F.coalesce(before, F.lit(0)))
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


MANIFEST = pa.schema([("shard", pa.string()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read_store(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """One row per stored document, each fetched by its key through the shard's index:
    ``key``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32`` (of the
    ids as 32-bit integers) and ``shard``."""
    manifest = spark.read.parquet(f"{path}/manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                index = ShardIndex(read_file(f"{path}/{name}.mph"))
                found, offset, length = index.find(index.keys, index.nulls, _occurrence(index.keys, index.nulls))
                if not found.all():
                    raise ValueError(f"{name}: the index misses a key of its own")
                ids = np.frombuffer(read_file(f"{path}/{name}.ids"), f"<u{index.width}").astype("<u4")
                sums = [zlib.crc32(ids[o : o + n]) for o, n in zip(offset.tolist(), length.tolist())]
                cols = [pa.array(index.keys, mask=index.nulls), pa.array(offset + base), pa.array(length), pa.array(sums, pa.int64()), pa.array([name] * index.docs, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, [key, "start", "n_tokens", "ids_crc32", "shard"])

    dealt = manifest.select("shard", "start").repartition(partitions(spark), "shard")
    return dealt.mapInArrow(run, f"{key} long, start long, n_tokens long, ids_crc32 long, shard string")


def _order(key: int | None) -> tuple[int, int]:
    """Keys as they are sorted: null first."""
    return (0, 0) if key is None else (1, key)


class TokenStore:
    """Keyed access from one process: ``get(key)`` reads an index and one slice of a payload."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        rows = spark.read.parquet(f"{path}/manifest").orderBy("shard").select("shard", "first_key", "last_key").collect()
        self.shards = [(r.shard, _order(r.first_key), _order(r.last_key)) for r in rows]
        self.last = [last for _, _, last in self.shards]
        self.indexes: dict[str, ShardIndex] = {}

    def get(self, key: int | None, occurrence: int = 0) -> np.ndarray | None:
        """Ids of the document, None if there is none with this key. ``occurrence`` counts
        documents with the same key within a shard."""
        for name, first, _ in self.shards[bisect_left(self.last, _order(key)) :]:
            if first > _order(key):
                return None
            if name not in self.indexes:
                self.indexes[name] = ShardIndex(read_file(f"{self.path}/{name}.mph"))
            index = self.indexes[name]
            found, offset, length = index.find(np.array([key or 0], np.int64), np.array([key is None]), np.array([occurrence]))
            if found[0]:
                fs, local = pafs.FileSystem.from_uri(f"{self.path}/{name}.ids")
                with fs.open_input_file(local) as f:
                    f.seek(int(offset[0]) * index.width)
                    return np.frombuffer(f.read(int(length[0]) * index.width), f"<u{index.width}").astype(np.uint32)
        return None


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through a store: encoded, written, and read back by key."""
    import public_tokenizers

    path = new_path(spark, "token-store")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_store(docs, "doc_id", "text", path, public_tokenizers.path("byte_bpe_50k.json"), True, 2)
    return read_store(spark, path)
