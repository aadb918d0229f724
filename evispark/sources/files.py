"""Readers of archive folders, JSON and CSV records, genotype exports and containers."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import artifact_id, category, extension
from ..operators.policy import DEFAULT_CONFIDENCE, DEFAULT_LABEL

EXCLUDED = (".git", "__pycache__", "node_modules", ".venv")


def scan_files(spark: SparkSession, root: str, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Relative path, size, time and content of all files, except below excluded folder names.

    Spark's own listing: files whose names start with a dot or underscore are not seen.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = root.split(":", 1)[-1].rstrip("/")
    relative = F.regexp_replace("path", "^[a-z]+:/*" + plain.lstrip("/") + "/", "")
    parts = F.slice(F.split(relative, "/"), 1, F.greatest(F.size(F.split(relative, "/")) - 1, F.lit(0)))
    rows = files.select(relative.alias("relative_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content", parts.alias("_p"))
    return rows.where(~F.arrays_overlap("_p", F.array(*map(F.lit, excluded)))).drop("_p")


def manifest(files: DataFrame, label: str = DEFAULT_LABEL, confidence: str = DEFAULT_CONFIDENCE) -> DataFrame:
    """One manifest row per scanned file, of ``scan_files`` or of the ``archive_folder`` source."""
    digest = F.col("sha256") if "sha256" in files.columns else F.sha2("content", 256)
    name = F.element_at(F.split("relative_path", "/"), -1)
    ext = extension(F.col("relative_path"))
    return files.select(
        "relative_path",
        name.alias("filename"),
        ext.alias("extension"),
        category(ext).alias("file_category"),
        "size_bytes",
        digest.alias("sha256"),
        F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("modified_time_iso"),
        artifact_id(name).alias("artifact_id"),
        F.lit(label).alias("privacy_label"),
        F.lit(confidence).alias("source_confidence"),
    )


def read_json_list(spark: SparkSession, path: str, schema: T.StructType, missing_ok: bool = False) -> DataFrame:
    """Rows of a JSON file that holds a list of objects; a missing file is empty if allowed."""
    if missing_ok and not spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def read_sidecars(files: DataFrame) -> DataFrame:
    """(relative_path, ordinal, record as JSON) from JSON, YAML and CSV sidecar files: a list of
    records, an object with ``records``, or one record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = raw.decode("utf-8-sig", "replace")
                if path.lower().endswith(".csv"):
                    data = list(csv.DictReader(io.StringIO(body)))
                elif path.lower().endswith((".yaml", ".yml")):
                    import yaml

                    data = yaml.safe_load(body)
                else:
                    data = json.loads(body)
                if isinstance(data, dict):
                    data = data["records"] if isinstance(data.get("records"), list) else [data]
                rows += [(path, i, json.dumps(r, sort_keys=True, default=str)) for i, r in enumerate(data or []) if isinstance(r, dict)]
            yield pa.RecordBatch.from_pydict({"relative_path": [r[0] for r in rows], "ordinal": pa.array([r[1] for r in rows], pa.int64()), "record": [r[2] for r in rows]}, schema=pa.schema([("relative_path", pa.string()), ("ordinal", pa.int64()), ("record", pa.string())]))

    wanted = files.where(F.lower("relative_path").rlike(r"\.(json|ya?ml|csv)$")).select("relative_path", "content")
    return wanted.mapInArrow(run, "relative_path string, ordinal long, record string")


def read_genotypes(spark: SparkSession, path: str) -> DataFrame:
    """Lines of genotype exports: kind (comment, header, row, malformed), line number and fields."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "line"))
    f = F.split(F.trim("line"), r"\s+")
    comment = F.ltrim("line").startswith("#")
    header = F.lower(F.get(f, F.lit(0))) == "rsid"
    kind = F.when(comment, "comment").when(header, "header").when(F.size(f) < 5, "malformed").otherwise("row")
    fields = [F.when(kind == "row", F.get(f, F.lit(i))).alias(n) for i, n in enumerate(("rsid", "chromosome", "position", "allele1", "allele2"))]
    return raw.where("trim(line) <> ''").select((F.col("i") + 1).alias("line_no"), kind.alias("kind"), *fields, F.when(comment, F.col("line")).alias("comment"))


def genotype_hits(rows: DataFrame, whitelist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First observation of each whitelisted rsid with its duplicates and call status, and the
    whitelist entries that were not seen."""
    key = F.lower("rsid")
    seen = rows.where("kind = 'row'").withColumn("k", key).join(whitelist.select(key.alias("k")).distinct(), "k", "left_semi")
    first = seen.groupBy("k").agg(F.min_by(F.struct("line_no", "chromosome", "position", "allele1", "allele2"), "line_no").alias("o"), (F.count("*") - 1).alias("n_duplicates"))
    no_call = F.upper("o.allele1").isin("0", "-", "--", "N", "") | F.upper("o.allele2").isin("0", "-", "--", "N", "")
    hits = whitelist.withColumn("k", key).join(first, "k").select(*whitelist.columns, "o.*", F.when(no_call, "no_call").otherwise("called").alias("call_status"), "n_duplicates")
    return hits, whitelist.withColumn("k", key).join(first, "k", "left_anti").drop("k")


MEMBER = "zip_path string, member_path string, size_bytes long, compressed_size_bytes long, sha256 string, crc32 string"


def zip_members(files: DataFrame) -> DataFrame:
    """A row per member of ZIP and WACZ files, hashed as a stream and never extracted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for info in z.infolist():
                        if info.is_dir():
                            continue
                        digest, crc = hashlib.sha256(), 0
                        with z.open(info) as member:
                            while block := member.read(1 << 20):
                                digest.update(block)
                                crc = zlib.crc32(block, crc)
                        rows.append({"zip_path": path, "member_path": info.filename, "size_bytes": info.file_size, "compressed_size_bytes": info.compress_size, "sha256": digest.hexdigest(), "crc32": f"{crc:08x}"})
            kinds = pa.schema([("zip_path", pa.string()), ("member_path", pa.string()), ("size_bytes", pa.int64()), ("compressed_size_bytes", pa.int64()), ("sha256", pa.string()), ("crc32", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return files.where(F.lower("relative_path").rlike(r"\.(zip|wacz)$")).select("relative_path", "content").mapInArrow(run, MEMBER)


def inspect_formats(files: DataFrame) -> DataFrame:
    """Web and document metadata: title and source URL of HTML, pages of PDF, kind of package."""
    from ..functions.html import page_source_url, page_title

    ext = extension(F.col("relative_path"))
    body = F.decode("content", "UTF-8")
    is_html, is_pdf = ext.isin(".html", ".htm"), ext == ".pdf"
    pages = F.size(F.regexp_extract_all(F.decode("content", "ISO-8859-1"), F.lit(r"/Type\s*/Page(?![A-Za-z])"), F.lit(0)))
    signed = F.decode(F.substring("content", 1, 4), "ISO-8859-1") == "%PDF"
    return files.where(ext.isin(".html", ".htm", ".pdf", ".warc", ".warc.gz", ".wacz")).select(
        "relative_path",
        ext.alias("file_type"),
        F.when(is_html, page_title(F.when(is_html, body))).alias("html_title"),
        F.when(is_html, page_source_url(F.when(is_html, body))).alias("probable_source_url"),
        F.when(is_pdf & signed & (pages > 0), pages).alias("pdf_page_count"),
        F.when(ext == ".wacz", "wacz").when(ext.isin(".warc", ".warc.gz"), "warc").alias("package_format"),
    )


def strict_json(path: str, limit: int = 2 * 1024 * 1024) -> dict:
    """A JSON object from a small plain file: no link, no repeated key in any case, no NaN."""
    p = Path(path)
    if p.is_symlink() or p.stat().st_size > limit:
        raise ValueError(f"{path}: a link, or larger than {limit} bytes")

    def pairs(items: list) -> dict:
        keys = [k.casefold() for k, _ in items]
        if len(set(keys)) < len(keys):
            raise ValueError(f"{path}: repeated key")
        return dict(items)

    def refuse(x: str):
        raise ValueError(f"{path}: {x} is no JSON number")

    data = json.loads(p.read_text("utf-8-sig"), object_pairs_hook=pairs, parse_constant=refuse)
    if not isinstance(data, dict):
        raise ValueError(f"{path}: not an object")
    return data
