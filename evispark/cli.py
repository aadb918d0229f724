"""Command line: ``python -m evispark.cli COMMAND INPUT OUTPUT``; tables go to Parquet.

Exit codes: 0, 1 for a failed strict audit, 2 for wrong usage.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import publish, terms
from .operators.policy import path_finding
from .plans import packet, packets
from .sources import archives, files, gedcom, stores

#: Tables of an archive's output folder, and the columns that are read of them.
TABLES = {
    "people_index": packets.PEOPLE, "families_index": packets.FAMILIES, "source_links": packets.LINKS,
    "archive_manifest": packets.MANIFEST,
}


def _privacy_audit(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select(F.col("value").alias("path")).withColumn("f", path_finding(F.col("path")))
    return rows.where("f.rule is not null").select("path", "f.rule", "f.severity")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A JSON list of the folder; empty if the file is not there (people are required)."""
    schema = T.StructType.fromDDL(", ".join(f"{c} {kind}" for c, kind in TABLES[name].items()))
    return files.read_json_list(spark, f"{folder.rstrip('/')}/{name}.json", schema, missing_ok=name != "people_index")


def _packets(spark: SparkSession, folder: str, profile: str) -> DataFrame:
    return packets.packet_lines(*(_table(spark, folder, name) for name in TABLES), profile)


def _packet_sources(spark: SparkSession, folder: str, profile: str) -> DataFrame:
    return packets.packet_sources(_table(spark, folder, "people_index"), _table(spark, folder, "source_links"), _table(spark, folder, "archive_manifest"), profile)


def _export(spark: SparkSession, folder: str, profile: str) -> DataFrame:
    links = _table(spark, folder, "source_links").withColumn("ordinal", F.monotonically_increasing_id())  # a list is read in order by one task
    return packet.export_rows(_table(spark, folder, "archive_manifest"), links, _table(spark, folder, "people_index"), packets.PROFILES[profile])


def _boundary(spark: SparkSession, repository: str, listed: list[str]) -> DataFrame:
    """Tracked paths, the texts of audited types, and remotes; git lists the first and the last."""
    paths = stores.tracked_paths(spark, repository)
    texts = archives.folder_files(spark, repository, excluded=".git", hash="false", content=str(terms.MOST_BYTES))
    texts = texts.where("content is not null").select(F.col("relative_path").alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return terms.boundary_findings(paths, texts.join(paths, "path", "left_semi"), stores.git_remotes(spark, repository), listed)


COMMANDS = {
    "scan": lambda s, a: files.manifest(archives.folder_files(s, a.input)),
    "inspect-archives": lambda s, a: files.inspect_formats(files.scan_files(s, a.input)),
    "inspect-zip": lambda s, a: archives.zip_archive_members(s, a.input),
    "sidecars": lambda s, a: files.read_sidecars(files.scan_files(s, a.input)),
    "parse-gedcom": lambda s, a: gedcom.persons(gedcom.read_nodes(s, a.input)),
    "gedcom-families": lambda s, a: gedcom.families(gedcom.read_nodes(s, a.input)),
    "parse-genotypes": lambda s, a: files.read_genotypes(s, a.input),
    "privacy-audit": lambda s, a: _privacy_audit(s, a.input),
    "packets": lambda s, a: _packets(s, a.input, a.profile),
    "packet-sources": lambda s, a: _packet_sources(s, a.input, a.profile),
    "export": lambda s, a: _export(s, a.input, a.profile),
    "static-site": lambda s, a: publish.static_site_rows(_table(s, a.input, "archive_manifest")),
    "bibliography": lambda s, a: publish.bibliography_items(_table(s, a.input, "archive_manifest")),
    "boundary-audit": lambda s, a: _boundary(s, a.input, a.term),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="evispark")
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--strict", action="store_true", help="fail an audit that finds a blocker, or any boundary term")
    parser.add_argument("--profile", choices=sorted(packets.PROFILES), default="private_full")
    parser.add_argument("--term", action="append", default=[], help="a term that a boundary audit forbids; may be repeated")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = spark or SparkSession.builder.appName("evispark").getOrCreate()
    out = COMMANDS[args.command](spark, args)
    packets.write_packets(out, args.output) if args.command == "packets" else out.write.parquet(args.output)
    if args.strict and args.command == "privacy-audit":
        return int(not spark.read.parquet(args.output).where("severity = 'blocker'").isEmpty())
    if args.strict and args.command == "boundary-audit":
        return int(not spark.read.parquet(args.output).isEmpty())
    return 0


if __name__ == "__main__":
    sys.exit(main())
