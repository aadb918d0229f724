"""Folders and ZIP archives as data sources that read by range and split by what they hold.

Both go through Arrow's file systems (local paths, hdfs://, s3://, gs://), in executors. A folder is
split by its sub-folders; an archive larger than a split by runs of its members, planned from its
central directory, which is read from the end of the file. Contents are streamed: nothing is held
whole, and a member is never extracted to disk.
"""

from __future__ import annotations

import hashlib
import json
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Folder names that a scan leaves out.
EXCLUDED = (".git", "__pycache__", "node_modules", ".venv")
BLOCK = 1 << 20
FILE = "path string, relative_path string, size_bytes long, modified timestamp, sha256 string, content binary"
MEMBER = "zip_path string, member_path string, size_bytes long, compressed_size_bytes long, crc32 string, sha256 string"


def open_fs(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path if "://" in path or path.startswith(("file:", "/")) else f"/{path}")


def _digest(stream) -> str:
    digest = hashlib.sha256()
    while block := stream.read(BLOCK):
        digest.update(block)
    return digest.hexdigest()


@dataclass
class Folder(InputPartition):
    """Files of one folder, or of all below it."""

    path: str
    deep: bool


class FolderReader(DataSourceReader):
    """Options: ``excluded`` (names, separated by commas), ``depth`` (levels of folders that the driver
    lists to split the work; each folder below is listed by one task), ``hash`` (false: no digests),
    ``links`` (false: local symbolic links are passed over), ``content`` (bytes: files up to this size
    come with their content; 0, the default: none does)."""

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.excluded = frozenset(n for n in options.get("excluded", ",".join(EXCLUDED)).split(",") if n)
        self.depth = int(options.get("depth", 1))
        self.hash = options.get("hash", "true").lower() != "false"
        self.links = options.get("links", "true").lower() != "false"
        self.content = int(options.get("content", 0))

    def _skips(self, path: str) -> bool:
        return not self.excluded.isdisjoint(path.split("/")) or (not self.links and os.path.islink(path))

    def partitions(self) -> list[Folder]:
        system, root = open_fs(self.root)
        if self._skips(root):  # a name above the root counts, too
            return [Folder("", False)]
        found, level = [], [root]
        for _ in range(self.depth):
            found += [Folder(p, False) for p in level]
            level = sorted(i.path for p in level for i in system.get_file_info(arrow_fs.FileSelector(p)) if i.type == arrow_fs.FileType.Directory and not self._skips(i.path))
        return found + [Folder(p, True) for p in level]

    def read(self, partition: Folder) -> Iterator[tuple]:
        if not partition.path:
            return
        system, root = open_fs(self.root)
        waiting = [partition.path]
        while waiting:
            for info in system.get_file_info(arrow_fs.FileSelector(waiting.pop())):
                if self._skips(info.path):
                    continue
                if info.type == arrow_fs.FileType.Directory:
                    if partition.deep:
                        waiting.append(info.path)
                elif info.type == arrow_fs.FileType.File:
                    digest = None
                    if self.hash:
                        with system.open_input_file(info.path) as stream:
                            digest = _digest(stream)
                    content = None
                    if info.size <= self.content:
                        with system.open_input_file(info.path) as stream:
                            content = stream.read()
                    yield info.path, info.path[len(root.rstrip("/")) + 1 :], info.size, info.mtime, digest, content


class FolderSource(DataSource):
    """``archive_folder``: every file below a folder, those with a dot or an underscore before their name
    included, except where a part of the path is an excluded name (the root's own ancestors count)."""

    @classmethod
    def name(cls) -> str:
        return "archive_folder"

    def schema(self) -> str:
        return FILE

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(self.options)


@dataclass
class Members(InputPartition):
    """Members ``first`` to before ``last`` of archives, by their central directories; all if ``last`` is -1."""

    archives: list[str]
    first: int
    last: int


class ZipReader(DataSourceReader):
    """Options: ``path`` (an archive, or a folder of .zip and .wacz files), ``split`` (bytes of a task,
    128 MB), ``hash`` (false: no digests; then only central directories are read), and what members to
    take: ``names`` (a JSON list), ``prefix``, ``suffix``. Names are compared before a member is read.
    They are options and no pushed filters, as Spark 4.1 keeps a filter that a Python source has
    taken for later queries on the same DataFrame.
    """

    def __init__(self, options: dict):
        self.root = options["path"]
        self.split = int(options.get("split", 128 << 20))
        self.hash = options.get("hash", "true").lower() != "false"
        self.names = frozenset(json.loads(options.get("names", "[]")))
        self.prefix, self.suffix = options.get("prefix", ""), options.get("suffix", "")

    def _wants(self, name: str) -> bool:
        return (not self.names or name in self.names) and name.startswith(self.prefix) and name.endswith(self.suffix)

    @staticmethod
    def _members(book: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
        return [i for i in book.infolist() if not i.is_dir()]

    @staticmethod
    def _open(stream, path: str) -> zipfile.ZipFile:
        try:
            return zipfile.ZipFile(stream)
        except zipfile.BadZipFile as e:
            raise ValueError(f"not a readable ZIP archive: {path}") from e

    def partitions(self) -> list[Members]:
        system, root = open_fs(self.root)
        info = system.get_file_info(root)
        if info.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        listed = [info] if info.type == arrow_fs.FileType.File else [i for i in system.get_file_info(arrow_fs.FileSelector(root, recursive=True)) if i.type == arrow_fs.FileType.File and i.path.lower().endswith((".zip", ".wacz"))]
        found, small, held = [], [], 0
        for i in sorted(listed, key=lambda i: i.path):
            if i.size <= self.split:
                if held + i.size > self.split and small:
                    found, small, held = [*found, Members(small, 0, -1)], [], 0
                small.append(i.path)
                held += i.size
                continue
            with system.open_input_file(i.path) as stream, self._open(stream, i.path) as book:
                first = size = 0
                members = self._members(book)
                for n, m in enumerate(members):
                    size += m.compress_size if self._wants(m.filename.replace("\\", "/")) else 0
                    if size >= self.split or n == len(members) - 1:
                        found.append(Members([i.path], first, n + 1))
                        first, size = n + 1, 0
        return [*found, Members(small, 0, -1)] if small else found or [Members([], 0, 0)]

    def read(self, partition: Members) -> Iterator[tuple]:
        system, _ = open_fs(self.root)
        for path in partition.archives:
            with system.open_input_file(path) as stream, self._open(stream, path) as book:
                members = self._members(book)
                for m in members[partition.first : partition.last if partition.last >= 0 else None]:
                    name = m.filename.replace("\\", "/")
                    if self._wants(name):
                        digest = None
                        if self.hash:
                            with book.open(m) as member:
                                digest = _digest(member)
                        yield path, name, m.file_size, m.compress_size, f"{m.CRC:08x}", digest


class ZipSource(DataSource):
    """``zip_members``: a row per member of ZIP and WACZ archives, with digests of streamed contents."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema: StructType) -> ZipReader:
        return ZipReader(self.options)


def folder_files(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """Files below ``root`` by the ``archive_folder`` source."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("archive_folder").options(**options).load(root)


def zip_archive_members(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Members of the archives at ``path`` by the ``zip_members`` source."""
    spark.dataSource.register(ZipSource)
    return spark.read.format("zip_members").options(**options).load(path)


def nearest_places(wanted: DataFrame, files: DataFrame, siblings: bool = False) -> DataFrame:
    """``wanted`` (``manifest_path``, ``relative_path``, more) with ``local_path`` and ``tier``: the first of
    0 below the manifest's folder, 1 below that folder's parent, 2 the path itself, and, with
    ``siblings``, 3 below a folder in that parent (the first by name) that is a path in ``files``
    (``path``). Null where there is none.

    Places are tried by joins over whole paths; for siblings a file's path, cut behind each of its
    folders, meets (parent, rest). Dots in relative paths are not resolved. Repeated rows stay.
    """
    folder = F.regexp_replace("manifest_path", "/?[^/]*$", "")
    parent = F.regexp_replace(folder, "/?[^/]*$", "")
    under = lambda base, rest: F.concat_ws("/", F.nullif(base, F.lit("")), rest)
    rooted = lambda base: F.when(F.col("manifest_path").startswith("/") & (base == ""), F.lit("")).otherwise(base)
    keys = wanted.select("manifest_path", "relative_path").where("manifest_path is not null and relative_path is not null and relative_path <> ''").distinct()
    absolute = F.col("relative_path").startswith("/")
    places = F.array(F.when(absolute, F.col("relative_path")).otherwise(under(rooted(folder), F.col("relative_path"))), F.when(absolute, F.col("relative_path")).otherwise(under(rooted(parent), F.col("relative_path"))), F.col("relative_path"))
    paths = files.select("path").where("path is not null").distinct()
    tried = keys.select("manifest_path", "relative_path", F.posexplode(places).alias("tier", "path"))
    found = tried.join(paths, "path").select("manifest_path", "relative_path", F.struct("tier", "path").alias("at"))
    if siblings:
        parts = F.split("path", "/")
        cuts = paths.select("path", parts.alias("p")).where(F.size("p") > 2).select("path", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 2)).alias("i"))
        cuts = cuts.select("path", F.array_join(F.slice("p", 1, F.col("i")), "/").alias("parent"), F.array_join(F.slice("p", F.col("i") + 2, F.size("p")), "/").alias("rest"))
        asked = keys.select("manifest_path", "relative_path", parent.alias("parent"), F.col("relative_path").alias("rest"))
        hit = asked.join(cuts, ["parent", "rest"])
        found = found.unionByName(hit.select("manifest_path", "relative_path", F.struct(F.lit(3).alias("tier"), "path").alias("at")))
    best = found.groupBy("manifest_path", "relative_path").agg(F.min("at").alias("at"))
    return wanted.join(best, ["manifest_path", "relative_path"], "left").select(*wanted.columns, F.col("at.path").alias("local_path"), F.col("at.tier").alias("tier"))
