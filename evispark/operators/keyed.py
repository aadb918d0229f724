"""Explicit links: records that name an artifact and a person, and contexts of ZIP members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, last_truthy, notes_list, path_key, zip_key
from .policy import CONFIDENCE, PRIVACY

REVIEW = "needs_review"


def resolve_people(records: DataFrame, person: Column, gedcom: Column, people: DataFrame) -> DataFrame:
    """``records`` with ``found``, the struct (person_id, gedcom_id) of the person whose id is
    ``person``, else of the one whose GEDCOM id is ``gedcom``; null where neither is known."""
    by_id = people.where("person_id is not null").dropDuplicates(["person_id"]).select(F.col("person_id").alias("_p"), F.struct("person_id", "gedcom_id").alias("_by_id"))
    by_gedcom = people.where("gedcom_id is not null").dropDuplicates(["gedcom_id"]).select(F.col("gedcom_id").alias("_g"), F.struct("person_id", "gedcom_id").alias("_by_gedcom"))
    rows = records.withColumns({"_person": blank_to_null(person), "_gedcom": blank_to_null(gedcom)})
    rows = rows.join(by_id, rows["_person"] == by_id["_p"], "left").join(by_gedcom, rows["_gedcom"] == by_gedcom["_g"], "left")
    return rows.withColumn("found", F.coalesce("_by_id", "_by_gedcom")).drop("_p", "_g", "_person", "_gedcom", "_by_id", "_by_gedcom")


def artifact_keys(path: Column, artifact: Column) -> Column:
    """Keys of an artifact, strongest first: its path, then its id."""
    path, artifact = blank_to_null(path), blank_to_null(artifact)
    return F.array_compact(F.array(F.concat(F.lit("path:"), path_key(path)), F.concat(F.lit("artifact:"), artifact)))


def explicit_links(records: DataFrame, people: DataFrame, order: str, own_path: Column | None = None) -> DataFrame:
    """The last record in ``order`` of each key that names a known person: ``key``, ``person_id``,
    ``gedcom_id``, ``privacy_label``, ``source_confidence``, ``notes``.

    A record has ``relative_path``, ``local_path``, ``artifact_id``, ``person_id``, ``person_slug``
    and ``gedcom_id``; one without a path has ``own_path``, its sidecar's. Records of unknown
    persons are left out before the last is taken. The last place of each key is found first and its
    record fetched by a join: links in an aggregate would make each task sort all its records. Of
    records with the same key and place the largest link counts.
    """
    person = F.coalesce(blank_to_null(F.col("person_id")), blank_to_null(F.col("person_slug")))
    rows = resolve_people(records, person, F.col("gedcom_id"), people).where("found is not null")
    path = F.coalesce(blank_to_null(F.col("relative_path")), blank_to_null(F.col("local_path")), own_path if own_path is not None else F.lit(None).cast("string"))
    keyed = rows.select(F.explode(artifact_keys(path, F.col("artifact_id"))).alias("key"), F.struct("found.person_id", "found.gedcom_id", "privacy_label", "source_confidence", "notes").alias("link"), order)
    last = keyed.groupBy("key").agg(F.max(order).alias("last_")).withColumnRenamed("key", "key_")  # of numbers: hashed, not sorted
    kept = keyed.join(last, (F.col("key") == F.col("key_")) & (F.col(order) == F.col("last_")))
    return kept.groupBy("key").agg(F.max("link").alias("link")).select("key", "link.*")


def with_link(manifest: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``manifest`` with the struct ``name``: the link of its path key, else of its artifact key."""
    fields = F.struct(*[c for c in links.columns if c != "key"])
    rows = manifest.withColumns({"_path": F.concat(F.lit("path:"), path_key(F.col("relative_path"))), "_artifact": F.concat(F.lit("artifact:"), blank_to_null(F.col("artifact_id")))})
    for key in ("_path", "_artifact"):
        side = links.select(F.col("key").alias(f"{key}_key"), fields.alias(f"{key}_link"))
        rows = rows.join(side, rows[key] == side[f"{key}_key"], "left")
    return rows.withColumn(name, F.coalesce("_path_link", "_artifact_link")).drop("_path", "_artifact", "_path_key", "_artifact_key", "_path_link", "_artifact_link")


def link_rows(manifest: DataFrame, method: Column, match: str, note: Column, default_label: str, default_confidence: str) -> DataFrame:
    """Source links of ``manifest`` rows with the struct ``match`` (null: needs review).

    Labels are the first valid one of match, manifest and default; a match's confidence is its own
    if valid, else the source confidence; a row without a match has a confidence of needs_review.
    """
    m = F.col(match)
    label = last_truthy(default_label, PRIVACY, m["privacy_label"], F.col("privacy_label"), F.lit(default_label))
    source = last_truthy(default_confidence, CONFIDENCE, m["source_confidence"], F.col("source_confidence"), F.lit(default_confidence))
    own = F.coalesce(m["source_confidence"], F.when(method == "manual_config", F.lit("confirmed")).otherwise(F.lit("family_identified")))
    path = F.regexp_replace(F.regexp_replace(F.lower("relative_path"), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")
    return manifest.select(
        F.concat(path, F.lit("--"), F.coalesce(m["person_id"], F.lit("needs-review"))).alias("link_id"),
        blank_to_null(F.col("artifact_id")).alias("artifact_id"),
        "relative_path",
        m["person_id"].alias("person_id"),
        m["gedcom_id"].alias("gedcom_id"),
        F.when(m.isNull(), F.lit(REVIEW)).otherwise(method).alias("match_method"),
        F.when(m.isNull(), F.lit(REVIEW)).when(own.isin(CONFIDENCE), own).otherwise(source).alias("match_confidence"),
        label.alias("privacy_label"),
        source.alias("source_confidence"),
        F.when(m.isNull(), F.array(note)).otherwise(F.concat(F.array(note), notes_list(m["notes"]))).alias("review_notes"),
    )


def context_match(members: DataFrame, contexts: DataFrame) -> DataFrame:
    """``members`` (zip_path, member_path) with ``context``, the position ``ord`` of the context whose
    prefix of the member's path is longest, the first configured of equal ones.

    A context may name a ZIP file (its last path part counts) and may have no prefix. The prefixes
    of a path that end at a slash are exploded and equi-joined, so contexts may be of any number.
    """
    name = F.lower(F.element_at(F.split(F.replace("zip_path", F.lit("\\"), F.lit("/")), "/"), -1))
    rows = members.withColumns({"_id": F.xxhash64("zip_path", "member_path"), "_zip": name, "_path": zip_key(F.col("member_path"))})
    cuts = F.expr("concat(array(0), filter(sequence(1, greatest(length(_path), 1)), i -> substr(_path, i, 1) = '/'))")
    probes = rows.select("zip_path", "member_path", "_zip", "_path", F.explode(cuts).alias("_n")).withColumn("_prefix", F.substring(F.col("_path"), F.lit(1), F.col("_n")))
    own = F.lower(F.element_at(F.split(F.replace(F.coalesce("zip_filename", F.lit("")), F.lit("\\"), F.lit("/")), "/"), -1))
    asked = contexts.select(zip_key(F.col("member_prefix")).alias("_prefix"), own.alias("_only"), "ord")
    hits = probes.join(asked, "_prefix").where("_only = '' or _only = _zip")
    best = hits.groupBy("zip_path", "member_path").agg(F.min_by("ord", F.struct(-F.col("_n"), F.col("ord"))).alias("context"))
    return members.join(best, ["zip_path", "member_path"], "left")


# Notes of members that were inspected.
MEMBER_NOTES = ["ZIP member inspected locally without extraction.", "Association is folder/config metadata only and needs human review."]
NO_CONTEXT = "No ZIP member family context matched this member."
NO_PERSON = "ZIP context matched, but no known person identifier was resolved."


def context_people(members: DataFrame, contexts: DataFrame, people: DataFrame) -> DataFrame:
    """``members`` with their context's person and GEDCOM ids, those of the known person where there is
    one and the configured ones otherwise, and ``review_notes``."""
    known = resolve_people(contexts, F.col("person_id"), F.col("gedcom_id"), people)
    known = known.select(
        F.col("ord").alias("context"),
        F.when(F.col("found").isNotNull(), F.col("found.person_id")).otherwise(blank_to_null(F.col("person_id"))).alias("person_id"),
        F.when(F.col("found").isNotNull(), F.col("found.gedcom_id")).otherwise(blank_to_null(F.col("gedcom_id"))).alias("gedcom_id"),
        notes_list(F.col("notes")).alias("_notes"),
    )
    rows = members.join(known, "context", "left")
    state = F.when(F.col("context").isNull(), F.lit(NO_CONTEXT)).when(F.col("person_id").isNull() & F.col("gedcom_id").isNull(), F.lit(NO_PERSON))
    notes = F.concat(F.array(*map(F.lit, MEMBER_NOTES)), F.array_compact(F.array(state)), F.coalesce("_notes", F.array().cast("array<string>")))
    return rows.withColumn("review_notes", notes).drop("_notes")
