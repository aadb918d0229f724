"""Document validators: each gives all errors of a row as codes in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import rule_errors
from .policy import CONFIDENCE, PRIVACY

#: Vocabularies of evidence, claims and receipts.
ROLES = ["observation", "recollection", "documentary_record", "inference", "hypothesis"]
TIERS = ["R4", "R3", "R2", "R1", "P0"]
SCOPES = ["private_research", "expert_review", "public_release", "withheld"]
SOURCE_CLASSES = ["family_held_artifact", "account_capture", "user_export", "public_archive", "public_web_source", "research_instrument", "first_person_report"]
RELATIONS = ["supports", "contradicts", "contextualizes"]
REVIEW = ["draft", "needs_review", "human_confirmed", "withdrawn"]
PROJECTIONS = ["archive_metadata", "evidence_metadata", "genome_summary_counts", "longitudinal_summary_counts", "multimodal_summary_counts"]
CONTENT_FLAGS = ["direct_identifiers", "genotypes", "health_measurements", "local_paths", "personal_recollections", "private_values", "raw_artifacts", "source_artifact_hashes"]
CANNOT_SUPPORT = ["artifact_authenticity", "biological_relationship", "claim_validation", "identity_verification", "medical_or_genetic_interpretation", "private_source_reconstruction"]
MUST_NOT_SUPPORT = ["claim_validation", "identity_verification", "medical_or_genetic_interpretation", "private_source_reconstruction"]
RECEIPT_FIELDS = ["boundary_contract", "cannot_support", "consent_scope", "contains", "human_reviewed", "privacy_label", "privacy_tier", "private_content_withheld", "producer", "projection_kind", "public_projection_sha256", "public_projection_item_count", "receipt_id", "schema_version", "source_schema"]
DIGEST = "^[0-9a-f]{64}$"
ABSOLUTE = r"^(/|\\\\)|:\\"


def filled(c: Column) -> Column:
    return c.isNotNull() & (F.length(F.trim(c)) > 0)


def _within(array: Column, allowed: list[str]) -> Column:
    return F.size(F.array_except(array, F.array(*map(F.lit, allowed)))) == 0


def envelope_errors(df: DataFrame) -> DataFrame:
    """Evidence envelopes with ``errors`` (empty if valid). Needs the envelope's flat columns,
    ``provenance`` as a struct, and ``secret_keys``, the paths of forbidden keys."""
    text = ["envelope_id", "schema_version", "recorded_at", "source_class", "evidence_role", "privacy_tier", "privacy_label", "source_confidence"]
    vocabularies = [("schema_version", ["1.0"]), ("source_class", SOURCE_CLASSES), ("evidence_role", ROLES), ("privacy_tier", TIERS), ("privacy_label", PRIVACY), ("source_confidence", CONFIDENCE)]
    c = F.col
    locator, digest = c("local_locator_ref"), c("integrity_sha256")
    released = F.coalesce(F.array_contains("consent_scopes", "public_release"), F.lit(False))
    rules = [(f"{n}:required", filled(c(n))) for n in text]
    rules += [(f"{n}:vocabulary", c(n).isin(v)) for n, v in vocabularies]
    rules += [(f"{n}:list", c(n).isNotNull() & F.forall(n, filled)) for n in ("consent_scopes", "subject_ids", "claim_ids")]
    rules += [
        ("consent_scopes:vocabulary", _within(F.coalesce("consent_scopes", F.array().cast("array<string>")), SCOPES)),
        ("consent_scopes:tier", ~(c("privacy_tier").isin("R4", "R3") & released)),
        ("source_confidence:inference", ~(c("evidence_role").isin("inference", "hypothesis") & (c("source_confidence") == "confirmed"))),
        ("integrity_sha256:digest", digest.isNull() | F.lower(digest).rlike(DIGEST)),
        ("local_locator_ref:opaque", locator.isNull() | (filled(locator) & ~locator.rlike(ABSOLUTE))),
    ]
    rules += [(f"provenance.{n}:required", filled(c(f"provenance.{n}"))) for n in ("capture_method", "captured_at", "source_owner")]
    rules.append(("secret_keys", F.size(F.coalesce("secret_keys", F.array().cast("array<string>"))) == 0))
    return df.withColumn("errors", rule_errors(rules))


def claim_findings(claims: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Findings (record_id, code, severity) of claims: their own rules, repeated ids, and links
    to evidence that is not there."""
    c = F.col
    rules = [(f"{n}:required", filled(c(n))) for n in ("claim_id", "statement", "claim_type")]
    rules += [("privacy_label:vocabulary", c("privacy_label").isin(PRIVACY)), ("review_status:vocabulary", c("review_status").isin(REVIEW))]
    rules += [(f"{n}:list", c(n).isNotNull() & F.forall(n, filled)) for n in ("subject_ids", "limitations")]
    rules.append(("evidence_links:relation", F.forall("evidence_links", lambda x: x["relation"].isin(RELATIONS))))
    own = claims.select("claim_id", F.explode(F.split(rule_errors(rules), "; ")).alias("code")).where("code <> ''")
    twice = claims.groupBy("claim_id").count().where("count > 1").select("claim_id", F.lit("claim_id:repeated").alias("code"))
    links = claims.select("claim_id", F.explode("evidence_links.envelope_id").alias("envelope_id"))
    lost = links.join(envelopes.select("envelope_id"), "envelope_id", "left_anti").select("claim_id", F.lit("evidence_links:missing").alias("code"))
    return own.unionByName(twice).unionByName(lost).select(F.col("claim_id").alias("record_id"), "code", F.lit("blocker").alias("severity"))


def claim_graph(claims: DataFrame, envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of claims and evidence; edges run from evidence to claim."""
    nodes = claims.select(F.col("claim_id").alias("id"), F.lit("claim").alias("kind"), "privacy_label").unionByName(envelopes.select(F.col("envelope_id").alias("id"), F.lit("evidence").alias("kind"), "privacy_label"))
    edges = claims.select(F.col("claim_id").alias("to"), F.explode("evidence_links").alias("l")).select("to", F.col("l.envelope_id").alias("from"), F.col("l.relation").alias("relation"))
    return nodes, edges.distinct()


def receipt_errors(df: DataFrame, payload: str, producer: str, schema_version: str, contract: str) -> DataFrame:
    """Public receipts (JSON text in ``payload``) with ``errors``. The schema is closed, and values
    must have the exact JSON type: a count given as true is no count.

    A payload is parsed once and its fields are taken out once, in projections of their own that all
    rules refer to."""
    names = lambda c: F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    fields = lambda c, listed: F.try_variant_get(c, "$", f"struct<{','.join(f'{n}:variant' for n in listed)}>")
    parsed = df.select("*", F.try_parse_json(payload).alias("v_"), names(F.col(payload)).alias("keys_"), names(F.get_json_object(payload, "$.contains")).alias("flags_"))
    parsed = parsed.withColumn("f_", fields(F.col("v_"), RECEIPT_FIELDS))
    parsed = parsed.withColumns({"contains_": fields(F.col("f_.contains"), CONTENT_FLAGS), "codes_": F.try_variant_get("f_.cannot_support", "$", "array<string>")})
    keys, flags, codes = F.col("keys_"), F.col("flags_"), F.col("codes_")

    def typed(field: str, kind: str) -> Column:
        return F.schema_of_variant(field) == kind

    def text(field: str) -> Column:
        return F.when(typed(f"f_.{field}", "STRING"), F.try_variant_get(f"f_.{field}", "$", "string"))

    count = F.try_variant_get("f_.public_projection_item_count", "$", "long")
    exact = [("schema_version", schema_version), ("boundary_contract", contract), ("producer", producer), ("privacy_tier", "P0"), ("privacy_label", "public_ok"), ("consent_scope", "public_release")]
    rules = [("json", F.col("v_").isNotNull()), ("fields:missing", F.size(F.array_except(F.array(*map(F.lit, RECEIPT_FIELDS)), keys)) == 0), ("fields:unknown", _within(keys, RECEIPT_FIELDS))]
    rules += [(f"{n}:value", text(n) == want) for n, want in exact]
    rules += [(f"{n}:value", typed(f"f_.{n}", "BOOLEAN") & F.try_variant_get(f"f_.{n}", "$", "boolean")) for n in ("human_reviewed", "private_content_withheld")]
    rules += [
        ("receipt_id:pattern", text("receipt_id").rlike("^[A-Za-z0-9][A-Za-z0-9._-]{2,127}$")),
        ("source_schema:pattern", text("source_schema").rlike("^[A-Za-z0-9][A-Za-z0-9._/-]{2,127}$")),
        ("projection_kind:vocabulary", text("projection_kind").isin(PROJECTIONS)),
        ("public_projection_sha256:digest", text("public_projection_sha256").rlike(DIGEST)),
        ("public_projection_item_count:range", typed("f_.public_projection_item_count", "BIGINT") & count.between(0, 1_000_000)),
        ("contains:fields", F.array_sort(flags) == F.array(*map(F.lit, sorted(CONTENT_FLAGS)))),
    ]
    rules += [(f"contains.{n}", typed(f"contains_.{n}", "BOOLEAN") & ~F.try_variant_get(f"contains_.{n}", "$", "boolean")) for n in CONTENT_FLAGS]
    rules += [
        ("cannot_support:list", (F.size(codes) > 0) & (F.size(F.array_distinct(codes)) == F.size(codes))),
        ("cannot_support:vocabulary", _within(codes, CANNOT_SUPPORT)),
        ("cannot_support:required", F.size(F.array_except(F.array(*map(F.lit, MUST_NOT_SUPPORT)), codes)) == 0),
    ]
    return parsed.select(*(F.col(c) for c in df.columns), rule_errors(rules).alias("errors"))


def source_findings(sources: DataFrame, register: str = "register") -> DataFrame:
    """Findings of source registers: empty required fields, URLs that are not https, and ids
    repeated within a register (ordinals tell which)."""
    c = F.col
    lists = ("urls", "supports", "cannot_support")
    rules = [(f"{n}:required", filled(c(n))) for n in ("id", "title", "source_type", "evidence_role")]
    rules += [(f"{n}:required", c(n).isNotNull() & (F.size(n) > 0)) for n in lists]
    rules.append(("urls:https", F.forall(F.coalesce("urls", F.array().cast("array<string>")), lambda u: u.startswith("https://"))))
    own = sources.select(register, "id", F.explode(F.split(rule_errors(rules), "; ")).alias("code")).where("code <> ''")
    twice = sources.groupBy(register, "id").count().where("count > 1").select(register, "id", F.lit("id:repeated").alias("code"))
    return own.unionByName(twice).withColumn("severity", F.lit("blocker"))
