"""Projections for publication: static site, bibliography, genotype-free summaries. Plans only: nothing
is sent anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .policy import PUBLIC_ALLOWED, is_raw_dna


def static_site_rows(manifest: DataFrame) -> DataFrame:
    """Public rows whose paths name nothing private."""
    private = F.lower("relative_path").rlike("private|living|do_not_share") | is_raw_dna(F.col("relative_path"))
    rows = manifest.where(F.col("privacy_label").isin(PUBLIC_ALLOWED) & ~private)
    return rows.select("relative_path", F.coalesce("artifact_id", "filename", "relative_path").alias("title"), "file_category", "privacy_label")


def bibliography_items(manifest: DataFrame) -> DataFrame:
    """Bibliography payload of each row as a struct, with a title that is never null."""
    title = F.coalesce(F.nullif(F.trim("artifact_id"), F.lit("")), F.nullif(F.trim("filename"), F.lit("")), "relative_path")
    return manifest.select("relative_path", F.struct(F.lit("document").alias("item_type"), title.alias("title"), F.col("sha256").alias("archive_location"), F.array("privacy_label", "source_confidence").alias("tags")).alias("payload"))


def observation_conflicts(df: DataFrame, first: str, second: str) -> DataFrame:
    """Two readings of one field, both kept, flagged if both are filled and differ."""
    a, b = F.nullif(F.trim(first), F.lit("")), F.nullif(F.trim(second), F.lit(""))
    return df.withColumn("conflict", F.coalesce(a != b, F.lit(False)))


def memorial_status(df: DataFrame) -> DataFrame:
    """rejected, conflict, verified or possible, in that order; the headstone counts only with a
    photo, a matching name, no conflict and a review."""
    c = {n: F.coalesce(F.col(n), F.lit(False)) for n in ("rejected", "dates_conflict", "identity_reviewed", "name_matches", "has_photo", "human_reviewed")}
    status = F.when(c["rejected"], "rejected").when(c["dates_conflict"], "conflict").when(c["identity_reviewed"] & c["name_matches"], "verified").otherwise("possible")
    return df.withColumn("status", status).withColumn("headstone_evidence", c["has_photo"] & c["name_matches"] & ~c["dates_conflict"] & c["human_reviewed"])


def evidence_class(df: DataFrame) -> DataFrame:
    """conflicted > unresolved > inferred_probable > documented > bounded."""
    c = F.col
    label = F.when(F.coalesce("conflict", F.lit(False)), "conflicted").when(F.coalesce("unresolved", F.lit(False)), "unresolved").when(F.coalesce("inferred", F.lit(False)), "inferred_probable").when(c("birth").isNotNull() & c("death").isNotNull(), "documented").otherwise("bounded")
    return df.withColumn("evidence_class", label)
