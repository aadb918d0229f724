"""Privacy rules: export decisions, packets, previews, path audits. Null never passes a rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Privacy and confidence labels, their defaults, and what the profiles allow.
PRIVACY = ["public_ok", "public_summary_only", "private_family_only", "expert_review_only", "do_not_share", "living_person_redacted", "raw_dna_never_export"]
CONFIDENCE = ["confirmed", "probable", "family_identified", "personal_recollection", "needs_review", "public_secondary", "private_artifact"]
DEFAULT_LABEL, DEFAULT_CONFIDENCE = "private_family_only", "needs_review"
PUBLIC_ALLOWED = ["public_ok", "public_summary_only"]
EXPERT_ALLOWED = ["public_ok", "public_summary_only", "expert_review_only"]
#: Marks of raw genetic data, and what each path rule looks for.
RAW_DNA = "raw_dna|raw-dna|ancestrydna|genotype"
DNA_NAME = "ancestrydn|ancestry-dna|ancestry_dna|dna-data|dna_data|rawdata|raw-data|raw_data|raw_dna|raw-dna|genotype"
OUTPUT_FOLDERS = "out|outputs|exports|packets|genome-output"
CONTROLLED_FOLDERS = "account-captures|browser-captures|local-vault|raw|raw-data|raw-vault|private-archive|private_archive|private-evidence"
MEDIA = "avi|heic|jpeg|jpg|mkv|mov|mp4|pdf|png|tif|tiff|webp"
PATH_RULES = [
    ("raw_dna_file", rf"({DNA_NAME})[^/]*\.(txt|csv|tsv|zip)$", "blocker"),
    ("genealogy_export", r"^(?!tests/fixtures/sample_tree\.synthetic\.ged$).*\.(ged|gedcom)$", "blocker"),
    ("private_archive_bundle", r"\.(zip|warc|wacz|7z|rar)$", "review"),
    ("secret_or_environment_file", r"(^|/)\.env$|(^|/)\.env\.(?!example$)[^/]*$|\.(pem|key|p12|pfx)$", "blocker"),
    ("local_output_folder", rf"(^|/)({OUTPUT_FOLDERS})(/|$)", "review"),
    ("controlled_evidence_folder", rf"(^|/)({CONTROLLED_FOLDERS})(/|$)", "blocker"),
    ("media_or_document_file", rf"\.({MEDIA})$", "review"),
]


def effective_label(link: Column, manifest: Column) -> Column:
    """The link's label, else the manifest's, else the private default."""
    return F.coalesce(F.nullif(F.trim(link), F.lit("")), F.nullif(F.trim(manifest), F.lit("")), F.lit(DEFAULT_LABEL))


def is_raw_dna(*texts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *texts)).rlike(RAW_DNA)


def export_decision(label: Column, raw_dna: Column, living: Column, profile: str) -> Column:
    """struct(include, reasons): raw DNA, then do_not_share, then the profile's own rule.

    ``profile`` is public, expert_review or private_full; any other one includes nothing. An
    unknown state of life counts as living, an unknown raw-DNA test as raw.
    """
    raw, live = F.coalesce(raw_dna, F.lit(True)) | (label == "raw_dna_never_export"), F.coalesce(living, F.lit(True))
    if profile == "public":
        rules = [F.when(~label.isin(PUBLIC_ALLOWED), F.lit("label_not_public")), F.when(live, F.lit("potentially_living")), F.when(label == "living_person_redacted", F.lit("living_redacted"))]
    elif profile == "expert_review":
        rules = [F.when(~label.isin(EXPERT_ALLOWED), F.lit("label_not_expert"))]
    else:
        rules = [F.when(F.lit(profile != "private_full"), F.lit("unknown_profile"))]
    reasons = F.when(raw, F.array(F.lit("raw_dna"))).when(label == "do_not_share", F.array(F.lit("do_not_share"))).otherwise(F.array_compact(F.array(*rules)))
    return F.struct((F.size(reasons) == 0).alias("include"), F.array_join(reasons, ",").alias("reasons"))


def packet_keeps(label: Column, raw_dna: Column, profile: str) -> Column:
    """Packet rule, unlike exports: ``private_full`` keeps do_not_share."""
    allowed = {"public": label.isin(PUBLIC_ALLOWED), "expert_review": label.isin(EXPERT_ALLOWED), "private_full": F.lit(True)}
    return F.coalesce(allowed.get(profile, F.lit(False)) & ~raw_dna & (label != "raw_dna_never_export"), F.lit(False))


def preview(tier: Column, consent: Column, public_ok: Column, value: Column) -> Column:
    """The value if it is P0, flagged public and released by consent; else null."""
    return F.when(F.coalesce((tier == "P0") & public_ok & F.array_contains(consent, "public_release"), F.lit(False)), value)


def path_finding(path: Column) -> Column:
    """struct(rule, severity) of the first path rule that matches, by lower case and forward
    slashes; null fields if none does."""
    low = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    found = None
    for rule, pattern, severity in PATH_RULES:
        value = F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))
        found = F.when(low.rlike(pattern), value) if found is None else found.when(low.rlike(pattern), value)
    return found
