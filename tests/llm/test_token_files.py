import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evispark.llm import token_files
from evispark.llm.store import new_path
from evispark.llm.token_files import PerfectHash, TokenStore, key_hashes, read_store, write_store

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 50_000)
    keys = np.unique(keys)
    hashes = key_hashes(keys, np.zeros(len(keys), bool), np.zeros(len(keys), int), 1)
    built = PerfectHash.build(hashes)
    assert sorted(built.slots(hashes).tolist()) == list(range(len(keys)))
    assert sum(len(w) for w in built.words) * 64 < 7 * len(keys)


def brute(rows):
    library, out, start = Tokenizer.from_file(PATH), [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_DOCS", 7)
    rows = [(i * 37 % 1009, f"text {i} " * (i % 40)) for i in range(100)] + [(-5, None), (None, "null key"), (2000, ""), (2001, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit("clash")).repartition(5)
    path = new_path(spark, "t")
    write_store(df, "doc_id", "text", path, PATH, True, 2)
    got = sorted((tuple(r)[:4] for r in read_store(spark, path).collect()), key=lambda r: r[1])
    assert got == brute(rows)
    store, library = TokenStore(spark, path), Tokenizer.from_file(PATH)
    for key, text in rows:
        assert store.get(key).tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2]
    assert store.get(5000) is None and store.get(-6) is None


def test_repeated_keys_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b b"), (None, None), (None, "")], "doc_id long, text string")
    path = new_path(spark, "t")
    write_store(df, "doc_id", "text", path, PATH, True, 2)
    got = sorted((tuple(r)[:4] for r in read_store(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 1, 1, 1]
    assert sum(r[2] for r in got) == got[-1][1] + got[-1][2]
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in brute(df.collect()))
    path = new_path(spark, "t")
    write_store(df.limit(0), "doc_id", "text", path, PATH, True, 2)
    assert read_store(spark, path).collect() == []
