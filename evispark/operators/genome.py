"""Whitelisted genotype observations: annotations, header metadata and summaries without genotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Annotation fields, scope of an annotation, header words, and the public note.
ANNOTATIONS = ["gene", "label", "category", "source_url", "evidence_note", "limitations", "public_summary_allowed"]
SCOPE = "Educational metadata only; not medical, diagnostic, or deterministic."
HEADER_WORDS = {"generated_at": ["generated", "date"], "array_version": ["array", "chip"], "converter_version": ["converter"], "reference_build_note": ["build", "reference"]}
HEADER = ["rsid", "chromosome", "position", "allele1", "allele2"]
PUBLIC_NOTE = "A private local raw DNA file was checked against a curated whitelist. This summary intentionally excludes raw genotypes and SNP-level calls."


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of whitelist entries in rsid order; an entry without an rsid is an error."""
    kind = "rsid string, gene string, label string, category string, source_url string, evidence_note string, limitations string, public_summary_allowed boolean"
    rows = spark.read.json(path, schema=kind, multiLine=True, mode="FAILFAST")
    rsid = F.trim(F.coalesce("rsid", F.lit("")))
    checked = F.when(rsid != "", rsid).otherwise(F.raise_error(F.lit("a whitelist entry has no rsid")))
    return rows.withColumns({"rsid": checked, "public_summary_allowed": F.coalesce("public_summary_allowed", F.lit(False))}).orderBy(F.lower("rsid"))


def is_header(fields: Column) -> Column:
    """Whether the first five fields of a line are the column names."""
    return F.coalesce(F.transform(F.slice(fields, 1, len(HEADER)), F.lower) == F.array(*map(F.lit, HEADER)), F.lit(False))


def header_metadata(comments: DataFrame, line: str, comment: str, by: list[str] | None = None) -> DataFrame:
    """The first comment that names each kind of metadata, null where none does."""
    low = F.lower(comment)
    first = []
    for name, words in HEADER_WORDS.items():
        said = low.contains(words[0])
        for word in words[1:]:
            said = said | low.contains(word)
        first.append(F.min_by(F.when(said, F.col(comment)), F.when(said, F.col(line))).alias(name))
    return comments.groupBy(*(by or [])).agg(*first)


def crossref(hits: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Hits with the annotations of their whitelist entry and ``interpretation_scope``; hits that no
    entry names stay bare. Of entries that share an rsid in lower case one counts."""
    known = whitelist.select(F.lower("rsid").alias("_k"), *[F.col(a) for a in ANNOTATIONS if a in whitelist.columns], F.lit(SCOPE).alias("interpretation_scope")).dropDuplicates(["_k"])
    bare = hits.drop(*ANNOTATIONS)
    return bare.join(known, F.lower(bare["rsid"]) == known["_k"], "left").drop("_k")


def parse_manifest(rows: DataFrame, hits: DataFrame, missing: DataFrame) -> DataFrame:
    """One row: lines read, hits, missing entries, malformed lines and the ids observed more than once
    (those of the whitelist, sorted)."""
    read = rows.agg(F.count_if(F.col("kind").isin("row", "malformed")).alias("rows_read"), F.count_if(F.col("kind") == "malformed").alias("malformed_row_count"))
    seen = hits.agg(F.count("*").alias("hit_count"), F.array_sort(F.collect_set(F.when(F.col("n_duplicates") > 0, F.lower("rsid")))).alias("duplicate_rsids"))
    lost = missing.agg(F.count("*").alias("missing_count"))
    return read.crossJoin(seen).crossJoin(lost).withColumn("duplicate_rsid_count", F.size("duplicate_rsids"))  # one row each


def public_summary(manifest: DataFrame) -> DataFrame:
    """The counts of a parse that may be published; nothing about single observations."""
    return manifest.select(F.lit(True).alias("genome_whitelist_checked"), F.lit("public_summary_only").alias("privacy_label"), F.lit(False).alias("raw_file_copied"), F.lit(False).alias("raw_genotypes_included"), "hit_count", "missing_count", "malformed_row_count", F.lit(PUBLIC_NOTE).alias("summary_note"))
