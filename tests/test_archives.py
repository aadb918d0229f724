"""Folder and ZIP sources on local files, and places of files."""

import hashlib
import os
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from evispark.sources.archives import ZipReader, folder_files, nearest_places, zip_archive_members


def test_folder_source(spark, tmp_path):
    for name in ["a/x.txt", "a/b/c/y.txt", ".hidden", "_under/z", "a/.dot/q", "node_modules/no", "a/__pycache__/no", "w w/é.txt", "empty"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode() if name != "empty" else b"")
    files = folder_files(spark, str(tmp_path))
    rows = {r.relative_path: r for r in files.collect()}
    assert sorted(rows) == [".hidden", "_under/z", "a/.dot/q", "a/b/c/y.txt", "a/x.txt", "empty", "w w/é.txt"]
    assert all(r.sha256 == hashlib.sha256(b"" if p == "empty" else p.encode()).hexdigest() and r.size_bytes == os.path.getsize(r.path) for p, r in rows.items())
    assert files.rdd.getNumPartitions() > 3
    for depth in ("0", "2", "9"):
        assert {r.relative_path for r in folder_files(spark, str(tmp_path), depth=depth, hash="false").collect()} == set(rows)
    assert [r.relative_path for r in folder_files(spark, str(tmp_path / "a"), excluded="b,c,.dot,__pycache__").collect()] == ["x.txt"]
    assert folder_files(spark, str(tmp_path / "a" / "b"), excluded="a").count() == 0  # an ancestor's name
    assert folder_files(spark, str(tmp_path), excluded="y.txt").where("relative_path like '%y.txt'").count() == 0


def members(path):
    with zipfile.ZipFile(path) as z:
        return sorted((i.filename.replace("\\", "/"), i.file_size, i.compress_size, f"{zlib.crc32(z.read(i)):08x}", hashlib.sha256(z.read(i)).hexdigest()) for i in z.infolist() if not i.is_dir())


def found(df):
    return sorted((r.member_path, r.size_bytes, r.compressed_size_bytes, r.crc32, r.sha256) for r in df.collect())


def test_one_archive_on_many_tasks(spark, tmp_path):
    rng = random.Random(1)
    with zipfile.ZipFile(tmp_path / "a.ZIP", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("dir/", "")
        for i in range(60):
            z.writestr(f"dir{i % 3}/m{i}.bin", rng.randbytes(rng.randrange(3000)))
        z.writestr("back\\slash.txt", b"x" * 50_000)
    df = zip_archive_members(spark, str(tmp_path / "a.ZIP"), split="8000")
    assert df.rdd.getNumPartitions() > 5 and found(df) == members(tmp_path / "a.ZIP")
    with zipfile.ZipFile(tmp_path / "b.wacz", "w") as z:
        z.writestr("one", b"1")
    (tmp_path / "c.txt").write_bytes(b"no archive")
    both = zip_archive_members(spark, str(tmp_path))
    assert found(both) == sorted(members(tmp_path / "a.ZIP") + members(tmp_path / "b.wacz"))
    assert {r.crc32 for r in zip_archive_members(spark, str(tmp_path), hash="false").where("sha256 is null").collect()} == {m[3] for m in found(both)}


def test_names_are_filtered_in_the_source(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(9):
            z.writestr(f"d{i % 3}/m{i}.txt", b"abc")
    for options, want in [({"names": '["d1/m4.txt"]'}, 1), ({"names": '["d1/m4.txt", "d0/m0.txt", "q"]'}, 2), ({"prefix": "d2/"}, 3), ({"prefix": "d2/", "suffix": "5.txt"}, 1), ({"names": '["d1/m4.txt"]', "prefix": "d0"}, 0), ({}, 9)]:
        df = zip_archive_members(spark, str(tmp_path / "a.zip"), split="5", **options)
        assert df.count() == want and df.rdd.getNumPartitions() <= max(want, 1) + 1, options
    assert zip_archive_members(spark, str(tmp_path / "a.zip")).where("member_path = 'd1/m4.txt'").count() == 1


def test_archive_over_two_gigabytes(tmp_path):
    """A sparse prefix of 5 GB: members lie behind it, and only they and the directory are read."""
    path = tmp_path / "big.zip"
    with open(path, "wb") as f:
        f.truncate(5 << 30)
    with zipfile.ZipFile(path, "a", zipfile.ZIP_DEFLATED) as z:
        for i in range(40):
            z.writestr(f"m{i:02d}", bytes([i]) * 1000)
    reader = ZipReader({"path": str(path), "split": "50"})
    parts = reader.partitions()
    rows = [r for p in parts for r in reader.read(p)]
    assert len(parts) > 5 and [r[1] for r in rows] == [f"m{i:02d}" for i in range(40)]
    assert all(r[5] == hashlib.sha256(bytes([i]) * 1000).hexdigest() for i, r in enumerate(rows))


def test_what_is_no_archive(spark, tmp_path):
    (tmp_path / "x.zip").write_bytes(b"nothing")
    with pytest.raises(Exception, match="not a readable ZIP archive"):
        zip_archive_members(spark, str(tmp_path / "x.zip")).collect()
    with pytest.raises(Exception, match="none.zip"):
        zip_archive_members(spark, str(tmp_path / "none.zip")).collect()
    (tmp_path / "empty").mkdir()
    assert zip_archive_members(spark, str(tmp_path / "empty")).count() == 0


def test_nearest_places(spark):
    files = spark.createDataFrame([(p,) for p in ["/r/out/a.txt", "/r/a.txt", "/r/b.txt", "c.txt", "/r/s2/d/e.txt", "/r/s1/d/e.txt", "/r/s1/d/f.txt", "/q/g.txt", None]], "path string")
    rows = [("/r/out/m.json", x) for x in ["a.txt", "b.txt", "c.txt", "d/e.txt", "d/f.txt", "none", "", None, "/q/g.txt", "a.txt"]] + [("m.json", "c.txt"), (None, "c.txt")]
    wanted = spark.createDataFrame(rows, "manifest_path string, relative_path string").withColumn("x", F.lit(1))
    got = [(r.manifest_path, r.relative_path, r.local_path, r.tier) for r in nearest_places(wanted, files, siblings=True).collect()]
    want = {"a.txt": ("/r/out/a.txt", 0), "b.txt": ("/r/b.txt", 1), "c.txt": ("c.txt", 2), "d/e.txt": ("/r/s1/d/e.txt", 3), "d/f.txt": ("/r/s1/d/f.txt", 3), "/q/g.txt": ("/q/g.txt", 0)}
    assert sorted(got, key=str) == sorted([(m, p, *(want.get(p, (None, None)) if m == "/r/out/m.json" else ("c.txt", 0) if m else (None, None))) for m, p in rows], key=str)
    plain = {r.relative_path: r.local_path for r in nearest_places(wanted, files).collect()}
    assert plain["d/e.txt"] is None and plain["b.txt"] == "/r/b.txt"
