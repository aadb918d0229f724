"""Folders that an archive works with: configuration, evidence, tracked paths, workbooks, inventories."""

from __future__ import annotations

import io
import json
import subprocess
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from functools import reduce
from pathlib import Path
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.html import page_text
from ..operators.policy import DEFAULT_CONFIDENCE, DEFAULT_LABEL
from .archives import folder_files

#: File types of a private inventory.
INVENTORY = [".ged", ".htm", ".html", ".jpeg", ".jpg", ".pdf", ".png", ".webp"]


@dataclass
class Config:
    """Settings with their defaults; keys that are not settings are ignored."""

    default_privacy_label: str = DEFAULT_LABEL
    default_source_confidence: str = DEFAULT_CONFIDENCE
    artifact_id_patterns: list[str] = field(default_factory=list)
    excluded_directory_names: list[str] = field(default_factory=lambda: [".git", "__pycache__"])
    manual_source_links: list[dict] = field(default_factory=list)
    packet_default_profile: str = "private_full"
    packet_citation_note: str = "Citation-ready notes require human review before publication."
    zip_member_contexts: list[dict] = field(default_factory=list)


def load_config(path: str) -> Config:
    """Settings of a JSON object; a missing file or another document is an error."""
    raw = json.loads(Path(path).read_text("utf-8-sig"))
    if not isinstance(raw, dict):
        raise ValueError("the configuration must be a JSON object")
    return Config(**{f.name: raw[f.name] for f in fields(Config) if f.name in raw})


def resolve_paths(manifest: DataFrame, listing: DataFrame, folder: str) -> DataFrame:
    """``manifest`` with ``local_path``: the file of ``listing`` (``path``) below the manifest's folder, else
    below that folder's parent, else at the path itself; null where there is none."""
    parent = str(Path(folder).parent)
    places = [F.concat(F.lit(f"{p.rstrip('/')}/"), F.col("relative_path")) for p in (folder, parent)] + [F.col("relative_path")]
    rows = manifest.select("relative_path", F.posexplode(F.array(*places)).alias("_rank", "path")).distinct()
    found = rows.join(listing.select("path").distinct(), "path").groupBy("relative_path").agg(F.min_by("path", "_rank").alias("local_path"))
    return manifest.join(found, "relative_path", "left")


def read_evidence(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All ``*.evidence.json`` documents of a folder, with ``file``; broken documents are an error."""
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.evidence.json").json(folder, multiLine=True, mode="FAILFAST")
    return rows.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def import_envelopes(checked: DataFrame, private: str, previews: str, preview: F.Column) -> int:
    """Write the valid envelopes (no ``errors``) to the private folder and their previews, which hold
    nothing private, to the other; returns how many were refused. The input is computed once: what is
    previewed is what was written, and envelopes are counted in that pass."""
    seen = Observation()
    is_valid = F.coalesce("errors", F.lit("")) == ""
    counted = checked.observe(seen, F.count_if(~is_valid).alias("refused"))
    counted.where(is_valid).drop("errors").write.json(private)
    written = checked.sparkSession.read.schema(checked.drop("errors").schema).json(private)
    written.select("envelope_id", preview.alias("preview")).write.json(previews)
    return int(seen.get["refused"] or 0)


def tracked_paths(spark: SparkSession, repository: str) -> DataFrame:
    """Paths that git tracks; outside a repository, all files below the folder but those of tools."""
    found = subprocess.run(["git", "ls-files", "-z"], cwd=repository, capture_output=True, text=True, check=False)
    if found.returncode == 0:
        paths = [p for p in found.stdout.split("\0") if p]
    else:
        tools = {".git", ".pytest_cache", ".ruff_cache", "__pycache__"}
        paths = [p.relative_to(repository).as_posix() for p in Path(repository).rglob("*") if p.is_file() and not tools & set(p.parts)]
    return spark.createDataFrame([(p,) for p in sorted(paths)], "path string")


def git_remotes(spark: SparkSession, repository: str) -> DataFrame:
    """Lines of the configured remotes; none outside a repository."""
    found = subprocess.run(["git", "remote", "-v"], cwd=repository, capture_output=True, text=True, check=False)
    lines = [(x.strip(),) for x in found.stdout.splitlines() if x.strip()] if found.returncode == 0 else []
    return spark.createDataFrame(lines, "line string")


#: Parts of workbooks that a release may not hold.
UNSAFE_MEMBERS = ["xl/media/", "embeddings/", "vbaproject", "externallinks/", "customxml/"]
CELLS = "path string, sheet string, row int, col int, value string, kind string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def workbook_cells(files: DataFrame) -> DataFrame:
    """Cells of XLSX files (``path``, ``content``): sheet, row and column from 1, value as text and kind
    (text, number, boolean, date). Empty cells have no row; a file that is no workbook is an error, and so
    is one with media, embedded objects, macros, outside links or custom XML. Sheets are read as
    streams; shared texts are held."""

    def column(reference: str) -> int:
        n = 0
        for c in reference.rstrip("0123456789"):
            n = 26 * n + ord(c) - 64
        return n

    def read(content: bytes) -> Iterator[tuple[str, int, int, str, str]]:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            names = set(book.namelist())
            refused = [n for n in names if any(part in n.lower() for part in UNSAFE_MEMBERS)]
            if refused:
                raise ValueError(f"workbook member not allowed: {min(refused)}")
            shared = []
            if "xl/sharedStrings.xml" in names:
                shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
            targets = {r.get("Id"): r.get("Target").removeprefix("/xl/") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
            for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
                with book.open(f"xl/{targets[sheet.get(_RELATION)]}") as stream:
                    for _, cell in ElementTree.iterparse(stream):  # a cell at a time
                        if cell.tag == f"{_MAIN}row":
                            cell.clear()
                        if cell.tag != f"{_MAIN}c":
                            continue
                        kind, v = cell.get("t", "n"), cell.find(f"{_MAIN}v")
                        text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) if kind == "inlineStr" else v.text if v is not None else None
                        if text is None:
                            continue
                        at = cell.get("r")
                        value = shared[int(text)] if kind == "s" else {"1": "true", "0": "false"}.get(text, text) if kind == "b" else text
                        yield sheet.get("name"), int(at.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ")), column(at), value, {"b": "boolean", "n": "number", "d": "date"}.get(kind, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(path, *r) for r in read(content)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "sheet", "row", "col", "value", "kind"])

    return files.select("path", "content").mapInArrow(run, CELLS)


def private_inventory(spark: SparkSession, roots: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(artifacts, receipts) of local roots, listed and hashed by tasks, never copied.

    Artifacts are files of the allowed types below their root that are no links: id, hash, size,
    format, time, and for HTML the visible text and the page's own addresses, all under the private
    label. A receipt says of each root ``inventoried`` or why it was not available.
    """
    rows, receipts = [], []
    for name, root in sorted(roots.items()):
        base = Path(root)
        receipts.append((name, "inventoried" if base.is_dir() else "FileNotFoundError"))
        if base.is_dir():
            rows.append(folder_files(spark, str(base.resolve()), excluded="", links="false").withColumn("root_id", F.lit(name)))
    empty = "root_id string, relative_path string, path string, size_bytes long, modified timestamp, sha256 string"
    files = reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame([], empty)
    form = F.lower(F.regexp_extract("relative_path", r"(\.[^./]+)$", 1))
    kept = files.where(form.isin(INVENTORY))
    pages = [r for r in roots.values() if Path(r).is_dir()]
    if pages:
        html = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[hH][tT][mM]*").load([str(Path(r).resolve()) for r in pages])
        html = html.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), page_text(F.decode("content", "UTF-8")).alias("page"))
        kept = kept.join(html, "path", "left").select(*kept.columns, F.col("page.text").alias("extracted_text"), F.col("page.urls").alias("source_url_hints"))
    else:
        kept = kept.select("*", F.lit(None).cast("string").alias("extracted_text"), F.lit(None).cast("array<string>").alias("source_url_hints"))
    out = kept.select("root_id", "relative_path", F.left("sha256", F.lit(24)).alias("artifact_id"), "sha256", "size_bytes", form.alias("format"), F.lit("do_not_share").alias("privacy_label"), F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("modified_at"), "extracted_text", "source_url_hints")
    return out, spark.createDataFrame(receipts, "root_id string, availability string")
